"""Queries of the operators between retrieval and an answer, over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, batching
from .kept import _terms_sql
from .registry import query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_RELATIONS = "CASE doc_id % 4 WHEN 0 THEN {a}'supports', 'contradicts'{b} WHEN 1 THEN {a}'analog'{b} WHEN 2 THEN {a}'contradicts'{b} ELSE {e} END"


@query(
    "assessment_join",
    f"""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'direct_support' WHEN doc_id % 3 = 0 THEN 'risk' ELSE 'insufficient' END AS role, toxic = 1 AS risk, {_RELATIONS.format(a='[', b=']', e='[]::VARCHAR[]')} AS rel FROM labels),
             o AS (SELECT *, CASE WHEN role <> 'insufficient' THEN role WHEN list_contains(rel, 'supports') AND list_contains(rel, 'contradicts') THEN 'mixed' WHEN list_contains(rel, 'analog') THEN 'analog_support' WHEN list_contains(rel, 'contradicts') THEN 'counter' ELSE role END AS overall_role FROM r JOIN documents USING (doc_id))
        SELECT doc_id, overall_role, CASE overall_role WHEN 'mixed' THEN 'partial_support' ELSE overall_role END AS evidence_role, overall_role IN ('direct_support', 'analog_support', 'mixed') OR list_contains(rel, 'supports') AS is_supporting,
               overall_role IN ('counter', 'mixed') OR list_contains(rel, 'contradicts') AS is_contradicting, risk OR overall_role = 'risk' AS is_safety_risk FROM o WHERE overall_role <> 'insufficient' OR risk""",
)
def assessment_join(spark, sf):
    role = F.when(F.col("quality") == 1, "direct_support").when(F.col("doc_id") % 3 == 0, "risk").otherwise("insufficient")
    reviews = _t(spark, sf, "labels").select("doc_id", F.lit(1).alias("seq"), role.alias("role"), F.expr(_RELATIONS.format(a="array(", b=")", e="cast(array() as array<string>)")).alias("relations"), F.lit(False).alias("is_supporting"), F.lit(False).alias("is_contradicting"), (F.col("toxic") == 1).alias("is_safety_risk"))
    return assembly.assess(_t(spark, sf, "documents").select("doc_id"), reviews, "doc_id")


@query(
    "claim_ranking",
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, CAST(o_totalprice AS DOUBLE) DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 12""",
)
def claim_ranking(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "contested").otherwise("supported").alias("status"), F.col("o_totalprice").cast("double").alias("confidence"))
    return assembly.rank_claims(o, ("o_custkey",), then="o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query(
    "reply_fields",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'all' ELSE concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'overall_benefit' END, 'body_lesion_recist', 'cns_lm_recist', 'csf_trajectory', 'symptom_trajectory', CASE WHEN conv_id % 3 = 0 THEN 'toxicity' END) END AS missing FROM conversations""",
)
def reply_fields(spark, sf):
    fields = {"overall_benefit": F.when(F.col("turn") % 2 != 0, "x"), "toxicity": F.when(F.col("conv_id") % 3 != 0, "x"), "confidence": F.lit("x")}
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(assembly.missing_fields(fields, F.when(F.col("role") != "user", F.lit(1))), ",").alias("missing"))


@query(
    "labelled_replies",
    """SELECT conv_id, turn, role, md5(CASE WHEN text IS NULL THEN NULL WHEN length(text) % 3 <> 0 THEN text END) AS said FROM conversations""",
)
def labelled_replies(spark, sf):
    """Each turn's whole text in a labelled object, between the text itself and an object whose label is unknown."""
    label = F.when(F.length("text") % 3 == 0, "maybe").when(F.length("text") % 3 == 1, "获益").otherwise("不获益")
    told = F.to_json(F.struct(F.lit("?").alias("benefit_binary"), "text")), F.to_json(F.struct("text", label.alias("benefit_binary")))
    said = F.concat("text", F.lit(" {broken, "), told[0], F.lit(" then "), told[1], F.col("text"), F.lit('{"benefit_binary": "获益"'))
    return _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5(F.get_json_object(assembly.labelled_reply(said), "$.text")).alias("said"))


@query(
    "merged_parts",
    """WITH p AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list('{"r": "' || role || '", "a": 1}' ORDER BY turn) || list('{"a": 1, "r": "' || role || '"}' ORDER BY turn) AS rows FROM conversations GROUP BY conv_id),
             u AS (SELECT conv_id, roles, list_distinct(list_transform(roles, lambda x: '{"a":1,"r":"' || x || '"}')) AS d FROM p)
        SELECT conv_id, array_to_string(list_sort(list_distinct(roles)), ',') AS strings, CAST(len(d) AS INTEGER) AS n_rows, array_to_string(list_sort(d), ';') AS rows FROM u""",
)
def merged_parts(spark, sf):
    part = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(part.alias("p")).select("conv_id", F.transform("p", lambda x: x["role"]).alias("roles"))
    both = F.concat(F.transform("roles", lambda x: F.concat(F.lit('{"r": "'), x, F.lit('", "a": 1}'))), F.transform("roles", lambda x: F.concat(F.lit('{"a": 1, "r": "'), x, F.lit('"}'))))
    c = c.select("conv_id", assembly.merge_strings(F.array("roles", "roles")).alias("s"), assembly.merge_rows(both).alias("d"))
    return c.select("conv_id", F.array_join(F.array_sort("s"), ",").alias("strings"), F.size("d").alias("n_rows"), F.array_join(F.array_sort("d"), ";").alias("rows"))


@query(
    "proven_findings",
    """WITH c AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS allowed FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey),
             f AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem WHERE l_linenumber IN (2, 4) GROUP BY l_orderkey)
        SELECT l_orderkey, CAST(len(ids) AS INTEGER) AS n FROM f JOIN c USING (l_orderkey) WHERE list_has_all(allowed, ids)""",
)
def proven_findings(spark, sf):
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    claims = line.where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_set("part").alias("allowed")).withColumn("source_text", F.lit(""))
    findings = line.where("l_linenumber in (2, 4)").groupBy("l_orderkey").agg(F.collect_set("part").alias("evidence_ids"))
    return assembly.proven_findings(findings, claims, ("l_orderkey",))[0].select("l_orderkey", F.size("evidence_ids").alias("n"))


_TRACE = "SELECT user_id, event_type, event_id, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS id FROM events"


@query(
    "trace_hits",
    f"""WITH h AS (SELECT user_id, id, min(event_id) AS first_at FROM ({_TRACE}) WHERE event_type <> 'view' AND id <> '' GROUP BY user_id, id)
        SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS INTEGER) AS rank FROM h QUALIFY rank <= 5""",
)
def trace_hits(spark, sf):
    hit = F.array(F.struct((F.floor("value") % 7).cast("string").alias("id"), F.col("event_type").alias("text")))
    tool = F.when(F.col("event_type") == "view", "open_page").otherwise("bm25_search")
    calls = _t(spark, sf, "events").select("user_id", F.lit(0).alias("step"), F.col("event_id").alias("call"), tool.alias("tool_name"), hit.alias("hits"))
    return assembly.raw_hits(calls, ("user_id",), 5).select("user_id", "id", "rank")


@query(
    "case_nodes",
    r"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other-' || doc_id ELSE 'case_' || (doc_id // 10) || '_node_' || (doc_id % 10) END AS id FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN id ELSE 'case_' || (doc_id // 10) END AS case_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 10 END AS INTEGER) AS node FROM i""",
)
def case_nodes(spark, sf):
    named = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("other-"), F.col("doc_id"))).otherwise(F.concat(F.lit("case_"), F.floor(F.col("doc_id") / 10), F.lit("_node_"), F.col("doc_id") % 10))
    return _t(spark, sf, "documents").select("doc_id", assembly.case_and_node(named).alias("c")).select("doc_id", "c.*")


_GOLD = "Thin there onand 2024-05 progression eren"


@query(
    "gold_prefilter",
    f"""SELECT doc_id, round(len(list_filter(['Thin', 'there', 'onand', '2024-05', 'progression', 'eren'], lambda t: contains(lower(text), lower(t)))) / 6.0::DOUBLE, 4) AS lexical, contains(text, '2024-05') AS date_hit, contains(lower(text), 'progression') AS outcome_hit,
               lexical >= 0.35 OR date_hit AND outcome_hit AS passes FROM documents WHERE text IS NOT NULL""",
)
def gold_prefilter(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", assembly.gold_overlap(F.lit(_GOLD), F.col("text")).alias("g")).select("doc_id", "g.*")


@query(
    "publication_dates",
    """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) WHEN 2 THEN make_date(year(o_orderdate), 12, 31) ELSE last_day(CAST(o_orderdate AS DATE)) END, '%Y-%m-%d') AS published FROM orders""",
)
def publication_dates(spark, sf):
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy/M")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy MMM"))
    return _t(spark, sf, "orders").select("o_orderkey", text.publication_date(forms).alias("published"))


@query(
    "numbered_batches",
    """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier WHERE s_suppkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7)) SELECT s_suppkey, CAST(position AS BIGINT) AS position, CAST(position // 8 AS BIGINT) AS batch FROM r""",
)
def numbered_batches(spark, sf):
    held = _t(spark, sf, "lineitem").where("l_quantity > 49 and l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    return batching.batch_ids(batching.not_done(_t(spark, sf, "supplier").select("s_suppkey"), held, "s_suppkey"), ["s_suppkey"], 8, groups=4).select("s_suppkey", "position", "batch")


_HEAD = text.REFERENCE_HEADING


def _body_sql(t: str) -> str:
    return rf"CASE WHEN regexp_matches({t}, '(?im:{_HEAD})') THEN regexp_replace(regexp_extract({t}, '(?s)\A(.*)(?im:{_HEAD})', 1), '\s+\z', '') ELSE coalesce({t}, '') END"


@query(
    "reference_sections",
    rf"""WITH d AS (SELECT doc_id, text AS own, concat(text, chr(10), '## 7. References:', chr(10), text, ' [DOI] [PubMed] Google Scholar') AS cited, replace(text, '. ', chr(10) || 'references' || chr(10)) AS headed FROM documents)
        SELECT doc_id, md5({_body_sql("own")}) AS own, md5({_body_sql("cited")}) AS cited, md5({_body_sql("headed")}) AS headed, coalesce(len(regexp_extract_all(cited, '{text.REFERENCE_POINTER}')) >= 3, false) AS is_list FROM d""",
)
def reference_sections(spark, sf):
    """Whole texts: as they are, with a list of references below, and with a heading in place of each end of a sentence."""
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit("\n## 7. References:\n"), F.coalesce("text", F.lit("")), F.lit(" [DOI] [PubMed] Google Scholar"))
    d = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("own"), cited.alias("cited"), F.replace("text", F.lit(". "), F.lit("\nreferences\n")).alias("headed"))
    return d.select("doc_id", *(F.md5(text.strip_references(F.col(c))).alias(c) for c in ("own", "cited", "headed")), text.is_reference_list(F.col("cited")).alias("is_list"))


@query(
    "event_type_parts",
    """WITH s AS (SELECT conv_id, turn, role, list_transform(string_split(replace(replace(replace(text, '. ', '+'), ' of ', '+ Toxicity +'), ' the ', ' treat '), '+'), lambda x: lower(trim(x))) AS l FROM conversations WHERE text <> ''),
             k AS (SELECT conv_id, turn, role, list_transform(l, lambda s: CASE WHEN s IN ('diagnosis', 'molecular', 'treatment', 'response', 'progression', 'toxicity', 'metastasis', 'ddi', 'outcome', 'other') THEN s WHEN contains(s, 'metasta') THEN 'metastasis' WHEN contains(s, 'tox') OR contains(s, 'adverse') THEN 'toxicity' WHEN contains(s, 'molec') OR contains(s, 'mutation') THEN 'molecular'
                   WHEN contains(s, 'diagn') THEN 'diagnosis' WHEN contains(s, 'treat') OR contains(s, 'therapy') THEN 'treatment' WHEN contains(s, 'resp') THEN 'response' WHEN contains(s, 'prog') THEN 'progression' ELSE 'other' END) AS t FROM s)
        SELECT conv_id, turn, role, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS types FROM k""",
)
def event_type_parts(spark, sf):
    """Sentences of whole turns as parts of a type, with words in them that name one."""
    raw = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit("+")), F.lit(" of "), F.lit("+ Toxicity +")), F.lit(" the "), F.lit(" treat "))
    return _t(spark, sf, "conversations").where("text <> ''").select("conv_id", "turn", "role", F.array_join(text.event_types(raw), ",").alias("types"))


_PLAIN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), '(?m)#.*$', ' ', 'g'), '\b(?:AND|OR|NOT)\b', ' ', 'g'), '[()"]', ' ', 'g')"""


@query(
    "query_adaptation",
    rf"""WITH w AS (SELECT conv_id, turn, role, list_filter(string_split(trim(regexp_replace({_PLAIN_SQL}, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM (SELECT conv_id, turn, role, replace(replace(text, ' of ', ' OR '), '. ', '[Title] (') AS text FROM conversations)),
             m AS (SELECT conv_id, turn, role, l, list_transform(l, lambda x: lower(x)) AS low FROM w)
        SELECT conv_id, turn, role, array_to_string(list_filter(l, lambda x, i: list_position(low, lower(x)) = i)[1:64], ' ') AS adapted FROM m""",
)
def query_adaptation(spark, sf):
    """All turns as search strings: a common word as an operator, ends of sentences as field tags and brackets."""
    asked = F.replace(F.replace("text", F.lit(" of "), F.lit(" OR ")), F.lit(". "), F.lit("[Title] ("))
    return _t(spark, sf, "conversations").select("conv_id", "turn", "role", text.adapt_query(asked).alias("adapted"))


@query("retrieval_term_lists", f"SELECT item_id, array_to_string({_terms_sql('lower(text)')}, ',') AS terms FROM (SELECT item_id, text || ' 40 mg of 12.5% t790m' AS text FROM benchmark)")
def retrieval_term_lists(spark, sf):
    """The terms of every item, in their order, with doses after its text."""
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(text.retrieval_terms(F.concat("text", F.lit(" 40 mg of 12.5% t790m"))), ",").alias("terms"))


@query(
    "reply_objects",
    """SELECT conv_id, turn, role, md5(CASE WHEN turn % 4 <> 3 THEN text END) AS reply, CASE WHEN role = 'user' THEN '{"api_key":"[REDACTED]","n":' || turn || '}' ELSE '{"key":"' || md5(text) || '","n":' || turn || '}' END AS safe, md5(regexp_replace(text, '[^A-Za-z0-9_.-]', '_', 'g')) AS name FROM conversations""",
)
def reply_objects(spark, sf):
    """Each turn's whole text in an object that is the reply, stands in a fence after the text, between texts, or is cut off."""
    body, t = F.to_json(F.struct("conv_id", "text")), F.col("text")
    said = F.when(F.col("turn") % 4 == 0, body).when(F.col("turn") % 4 == 1, F.concat(t, F.lit("\n```json\n"), body, F.lit("\n```\n"), t)).when(F.col("turn") % 4 == 2, F.concat(t, body, t)).otherwise(F.concat(t, F.left(body, F.length(body) - 1)))
    secret = F.when(F.col("role") == "user", F.to_json(F.struct(t.alias("api_key"), F.col("turn").alias("n")))).otherwise(F.to_json(F.struct(F.md5("text").alias("key"), F.col("turn").alias("n"))))
    return _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5(F.get_json_object(text.json_object(said), "$.text")).alias("reply"), text.redact(secret).alias("safe"), F.md5(text.safe_id(t)).alias("name"))


@query(
    "prediction_evidence",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders),
             r AS (SELECT o_custkey, o_orderkey, 0 AS side, 0 AS place, 'direct' AS evidence_role, o_orderkey % 23 AS n FROM o WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, o_orderkey, 0, 1, 'direct', o_orderkey % 29 FROM o WHERE o_orderstatus <> 'P'
                   UNION ALL SELECT o_custkey, o_orderkey, 1, 0, 'counter', o_orderkey % 31 FROM o WHERE o_orderstatus <> 'P'),
             f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey, n ORDER BY o_orderkey, side, place) = 1),
             e AS (SELECT DISTINCT o_custkey, o_orderkey % 23 AS n FROM o),
             j AS (SELECT *, n % 17 AS t FROM f JOIN e USING (o_custkey, n) QUALIFY row_number() OVER (PARTITION BY o_custkey, n % 17 ORDER BY o_orderkey, side, place) = 1)
        SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, side, place) AS INTEGER) AS rank, CAST(n AS VARCHAR) AS id, evidence_role, 'text ' || t AS content FROM j QUALIFY rank <= 8""",
)
def prediction_evidence(spark, sf):
    o = _t(spark, sf, "orders")
    n = lambda m: (F.col("o_orderkey") % m).cast("string")
    status = F.when(F.col("o_orderstatus") == "P", "rejected_by_safety_gate").otherwise("supported")
    none = F.lit(None).cast("array<string>")
    claims = o.select("o_custkey", F.col("o_orderkey").alias("claim_order"), status.alias("status"), F.lit("case").alias("claim_scope"), none.alias("direct"), F.array(n(23), n(29)).alias("supporting"), F.array(n(31)).alias("counter"))
    held = o.select("o_custkey", (F.col("o_orderkey") % 23).alias("n")).distinct()
    evidence = held.select("o_custkey", F.col("n").cast("string").alias("id"), F.concat(F.lit(" text  "), F.col("n") % 17).alias("text"), F.lit("case").alias("type"), F.lit(None).cast("string").alias("pub_date"))
    return assembly.compact_evidence(claims, evidence, ("o_custkey",)).select("o_custkey", "rank", "id", "evidence_role", "content")


@query(
    "nested_values",
    r"""WITH t AS (SELECT conv_id, turn, role, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM conversations)
        SELECT conv_id, md5(array_to_string(list_sort(list_distinct(list(turn::VARCHAR) || list(text) FILTER (WHERE text <> ''))), '|')) AS ids,
               md5(concat_ws('|', string_agg(concat_ws('|', CASE WHEN turn <> 0 THEN turn END, nullif(role, ''), nullif(said, '')), '|' ORDER BY turn, role, text), CASE WHEN conv_id <> 0 THEN conv_id END)) AS leaves FROM t GROUP BY conv_id""",
)
def nested_values(spark, sf):
    """Conversations as JSON texts: what stands under two names at any depth, and all leaves in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    body = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns).select("conv_id", F.to_json(F.struct("turns", "conv_id")).alias("body"))
    return body.select("conv_id", F.md5(F.array_join(assembly.strings_under(F.col("body"), ("turn", "text")), "|")).alias("ids"), F.md5(F.array_join(assembly.leaf_texts(F.col("body")), "|")).alias("leaves"))


@query(
    "citation_records",
    """SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'c' || doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'p' || doc_id END AS pmid, CAST(doc_id AS BIGINT) AS start_char, substr(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 1, 500) AS quoted_span FROM documents WHERE doc_id IS NOT NULL""",
)
def citation_records(spark, sf):
    d = _t(spark, sf, "documents").where(F.col("doc_id").isNotNull())
    own = F.when(F.col("doc_id") % 2 == 0, "own").otherwise(F.lit(""))
    meta = F.concat(F.lit('{"case_id": "c'), F.col("doc_id"), F.lit('", "pmid": "p'), F.col("doc_id"), F.lit('"}'))
    items = d.select(F.col("doc_id").alias("chunk_id"), "text", own.alias("pmid"), meta.alias("metadata_json"), F.concat(F.lit('{"start_char": '), F.col("doc_id"), F.lit("}")).alias("citation_json"))
    return assembly.citation_records(items).select("chunk_id", "case_id", "pmid", "start_char", "quoted_span")


@query(
    "bounded_evidence",
    r"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS level FROM orders WHERE o_orderstatus <> 'P'),
             r AS (SELECT o_custkey, o_orderkey, 0 AS place, 'partial' AS support_level, o_orderkey % 23 AS n FROM o WHERE level = 0 UNION ALL SELECT o_custkey, o_orderkey, 1, 'partial', o_orderkey % 29 FROM o WHERE level = 0
                   UNION ALL SELECT o_custkey, o_orderkey, 0, 'analog', o_orderkey % 31 FROM o WHERE level = 1),
             f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey, n ORDER BY o_orderkey, place) = 1),
             e AS (SELECT doc_id AS n, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1600) AS content FROM documents)
        SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, place) AS INTEGER) AS rank, CAST(n AS VARCHAR) AS id, support_level, md5(content) AS digest FROM f JOIN e USING (n) WHERE content <> '' QUALIFY rank <= 10""",
)
def bounded_evidence(spark, sf):
    """Partial and analogous support of each customer's orders; the evidence is the documents that they refer to."""
    o, key = _t(spark, sf, "orders"), F.col("o_orderkey")
    n = lambda m: (key % m).cast("string")
    status = F.when(F.col("o_orderstatus") == "P", "rejected_by_safety_gate").otherwise("supported")
    level = F.when(key % 3 == 0, "partial").when(key % 3 == 1, "analog").otherwise("direct")
    claims = o.select("o_custkey", key.alias("claim_order"), status.alias("status"), level.alias("support_level"), F.lit("case").alias("claim_scope"), F.lit(None).cast("string").alias("subject_entity"), F.array(n(23), n(29)).alias("partial"), F.array(n(31)).alias("analog"))
    evidence = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("pub_date"))
    return assembly.bounded_evidence(claims, evidence, ("o_custkey",)).select("o_custkey", "rank", "id", "support_level", F.md5("content").alias("digest"))
