"""Queries over kept tables: a postings index that grows and searches of it, and retrieval batches over a state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import excerpt, text
from ..operators import batch, dense, lexical, resample, substrings
from ..operators.postings import PostingsIndex
from ..operators.sizes import broadcast_up_to
from ..sources.folders import stored
from ..streaming.eventlog import EventLog
from ..streaming.sessions import ConversationState
from .registry import query
from .retrieval import _ask, _ASK_SQL, _CHUNKS_SQL, _hash_sql, _t, bm25_sql, chunks, tokens_sql


def grown(spark: SparkSession, sf: str) -> PostingsIndex:
    """An index of all documents that came in two batches, half of them later."""
    docs, index = _t(spark, sf, "documents"), PostingsIndex(spark)
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    index.add(docs.where(~later))
    index.add(docs.where(later))
    return index


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("kept_index_batch", bm25_sql("(SELECT doc_id AS id, text FROM documents)", "(SELECT item_id AS query_id, text FROM benchmark)", 5))
def kept_index_batch(spark, sf):
    return _shown(grown(spark, sf).search(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), top_k=5))


@query("kept_index_subset", bm25_sql("(SELECT doc_id AS id, text FROM documents WHERE lang = 'en' AND source <> 'src0')", _ASK_SQL, 10))
def kept_index_subset(spark, sf):
    ids = _t(spark, sf, "documents").where("lang = 'en' and source <> 'src0'").select(F.col("doc_id").alias("id"))
    return _shown(grown(spark, sf).search(_ask(spark), within=ids))


@query("kept_index_doc_freq", f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM {tokens_sql('documents', 'doc_id')}) GROUP BY term")
def kept_index_doc_freq(spark, sf):
    return grown(spark, sf).doc_freq()


def _terms_sql(low: str) -> str:
    """Query terms of a lower-cased text, as functions.text.retrieval_terms has them for texts without CJK."""
    phrases = ", ".join(f"'{p}'" for p in text.CLINICAL_PHRASES)
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    raw = rf"list_filter(list_concat(list_transform(regexp_extract_all(trim(regexp_replace({low}, '\s+', ' ', 'g')), '[a-z][a-z0-9_.+-]*|\d+(?:\.\d+)?(?:\s*(?:mg|g|%|周|月|天))?'), lambda w: trim(w)), list_filter([{phrases}], lambda p: contains({low}, p))), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i)[1:64] FROM (SELECT {raw} AS l))"


def _held_sql(t: str, parts: str, words: str) -> str:
    return f"(regexp_matches({t}, '{parts}') OR list_has_any(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}_]+'), ['{words}']))"


def _types_sql(t: str) -> dict[str, str]:
    return {
        "early": _held_sql(t, "early|initial|first assessment|response", "cr', 'pr', 'orr', 'dcr"),
        "progress": _held_sql(t, "resistan|progress|relapse", "pd"),
        "toxic": _held_sql(t, "toxicit|adverse", "ae"),
        "outcome": _held_sql(t, "outcome|survival|death", "pfs', 'os"),
    }


def _details_sql(n: int, state: str, said: str) -> str:
    """Common table d{n}: the details of a round, over the state before them; said: the texts of its actions."""
    words = ", ".join(f"'{w}'" for w in batch.CLINICAL.split("(?:")[1].split(")")[0].split("|"))
    return f"""
             m{n} AS (SELECT query_id, doc_id, max((score, -row)) AS top FROM (SELECT query_id, id, score, row_number() OVER (ORDER BY id) AS row FROM (SELECT query_id, id, max(score) AS score FROM {state} GROUP BY ALL)) JOIN ch USING (id) GROUP BY query_id, doc_id),
             n{n} AS (SELECT query_id, doc_id FROM m{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY top DESC) <= 10),
             t{n} AS (SELECT item_id AS query_id, {_terms_sql(f"lower(concat_ws(' ', text, {said}))")} AS terms FROM benchmark),
             e{n} AS (SELECT query_id, doc_id, id, len(list_filter(terms, lambda t: contains(lower(text), t))) / greatest(1, len(terms))::DOUBLE + least(0.25::DOUBLE, 0.025::DOUBLE * len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({words})))) AS score
                      FROM n{n} JOIN t{n} USING (query_id) JOIN ch USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, id) <= 3),
             d{n} AS (SELECT query_id, 'document_detail' AS channel, {n} AS round, 0 AS pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank, id, round(score, 6) AS score FROM e{n})"""


def _plus_sql(wants: str, has: str, by: float) -> str:
    return f"CASE WHEN {wants} AND {has} THEN {by}::DOUBLE ELSE 0 END"


_ASKS = "(SELECT item_id AS query_id, text FROM benchmark)"
_LATER = "split_part(text, chr(10), 2)"
_A, _F = _types_sql("lower(ask)"), _types_sql("found")
_BATCH_SQL = rf"""
        WITH ch AS (SELECT printf('%010d#%06d', doc_id, chunk_order) AS id, doc_id, chunk AS text FROM {_CHUNKS_SQL}),
             hd AS {_hash_sql(tokens_sql('ch', 'id'), 'id')}, hq AS {_hash_sql(tokens_sql('benchmark', 'item_id'), 'item_id')},
             dn AS (SELECT item_id AS query_id, id, sum(hd.weight * hq.weight) AS score FROM hd JOIN hq USING (bucket) GROUP BY ALL HAVING round(score, 9) > 0),
             dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dn QUALIFY rank <= 30),
             pl AS (SELECT query_id, doc_id, max(score) AS dense, string_agg(lower(text), ' ' ORDER BY lower(text)) AS found FROM dr JOIN ch USING (id) GROUP BY ALL),
             pa AS (SELECT query_id, doc_id, dense, found, text AS ask, {_terms_sql('lower(text)')} AS terms FROM pl JOIN {_ASKS} USING (query_id)),
             pb AS (SELECT query_id, doc_id, 0.7::DOUBLE * dense + 0.3::DOUBLE * len(list_filter(terms, lambda t: contains(found, t))) / greatest(1, len(terms)) AS locator, terms, {', '.join(f'({_A[k]} OR {_F[k]}) AS w_{k}' for k in _A)} FROM pa QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(locator, 9) DESC, doc_id) <= 30),
             pc AS (SELECT pb.*, ch.id, {_held_sql('lower(text)', 'early|initial|first', "cr', 'pr', 'orr', 'dcr")} AS early, {_held_sql('lower(text)', 'resistan|progress|relapse', 'pd')} AS progress, {_held_sql('lower(text)', 'toxicit|adverse', 'ae')} AS toxic, {_held_sql('lower(text)', 'response|outcome|survival', "pfs', 'os")} AS outcome,
                           len(list_filter(terms, lambda t: contains(lower(text), t))) / greatest(1, len(terms))::DOUBLE AS cover FROM pb JOIN ch USING (doc_id)),
             pd AS (SELECT query_id, doc_id, id, locator, cover + {_plus_sql('w_early', 'early', 0.35)} + {_plus_sql('w_progress', 'progress', 0.30)} + {_plus_sql('w_toxic', 'toxic', 0.30)} + {_plus_sql('w_outcome', 'outcome', 0.20)} - {_plus_sql('w_early', '(progress AND NOT early)', 0.35)} AS score,
                           CASE WHEN early THEN 1 WHEN toxic OR progress AND NOT w_progress THEN 2 ELSE 3 END AS bucket FROM pc),
             pe AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, bucket ORDER BY round(score, 9) DESC, id) = 1),
             pf AS (SELECT query_id, doc_id, id, 0.55::DOUBLE * locator + 0.45::DOUBLE * score AS score FROM pe QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(pe.score, 9) DESC, id) <= 3),
             pg AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, id) > 1 AS INT) AS sibling FROM pf),
             ph AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sibling, round(score, 9) DESC, id) AS rank FROM pg QUALIFY rank <= 32),
             b1 AS ({bm25_sql('(SELECT id, text FROM ch)', _ASKS, 20)}),
             b2 AS ({bm25_sql('(SELECT id, text FROM ch)', f"(SELECT item_id AS query_id, {_LATER} AS text FROM benchmark)", 20)}),
             sw AS (SELECT DISTINCT query_id, unnest(list_filter(tokens, lambda w: length(w) >= 9)) AS value FROM {tokens_sql(_ASKS, 'query_id')}),
             se AS (SELECT DISTINCT id, unnest(list_filter(tokens, lambda w: length(w) >= 9)) AS value FROM {tokens_sql('ch', 'id')}),
             st AS (SELECT query_id, id, count(*) / any_value(n)::DOUBLE AS score FROM se JOIN sw USING (value) JOIN (SELECT query_id, count(*) AS n FROM sw GROUP BY query_id) USING (query_id) GROUP BY query_id, id),
             sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM st QUALIFY rank <= 20),
             s1 AS (SELECT query_id, 'step3_then_step2_search' AS channel, 1 AS round, 0 AS pos, rank, id, round(score, 6) AS score FROM ph UNION ALL SELECT query_id, 'dense_search', 1, 0, rank, id, round(score, 6) FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, 'bm25_search', 1, 1, rank, id, score FROM b1),{_details_sql(1, 's1', "text || ' ' || text")},
             s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM d1 UNION ALL SELECT query_id, 'structured_search', 2, 0, rank, id, round(score, 6) FROM sr UNION ALL SELECT query_id, 'bm25_search', 2, 1, rank, id, score FROM b2),{_details_sql(2, 's2', f"rtrim(text || ' ' || {_LATER})")},
             lf AS (SELECT query_id, channel, id, min((round, pos, rank)) AS first FROM (SELECT * FROM s2 UNION ALL SELECT * FROM d2) GROUP BY query_id, channel, id),
             li AS (SELECT query_id, channel, id, row_number() OVER (PARTITION BY query_id, channel ORDER BY first, id) AS rank FROM lf),
             fu AS (SELECT query_id, id, sum(1 / (60.0::DOUBLE + rank)) AS rrf, count(*) AS n_channels, max(CASE channel WHEN 'document_detail' THEN 1 ELSE 0 END) AS is_detail,
                           min(CASE WHEN rank <= 3 THEN CASE channel WHEN 'bm25_search' THEN 1 WHEN 'dense_search' THEN 2 WHEN 'step3_then_step2_search' THEN 3 WHEN 'document_detail' THEN 4 END * 100 + rank END) AS kept FROM li GROUP BY query_id, id),
             la AS (SELECT *, CASE WHEN kept IS NOT NULL THEN 0 WHEN is_detail = 1 AND row_number() OVER (PARTITION BY query_id, kept IS NULL, is_detail ORDER BY round(rrf, 12) DESC, id) <= 5 THEN 1 ELSE 2 END AS lane FROM fu),
             po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lane, kept NULLS LAST, round(rrf, 12) DESC, id) AS rank FROM la)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, id, doc_id, round(rrf, 9) AS rrf, n_channels, lane, md5(text) AS digest FROM po JOIN ch USING (id) WHERE rank <= 12"""


@query("retrieval_batch", _BATCH_SQL)
def retrieval_batch(spark, sf):
    """Two rounds for every benchmark item: dense, lexical and located details of its text; then its long words and its answer."""
    rows = chunks(_t(spark, sf, "documents")).select(F.format_string("%010d#%06d", "doc_id", "chunk_order").alias("chunk_id"), "doc_id", F.col("chunk").alias("text"))
    rows = stored(rows, "batch-chunks")
    vectors = stored(dense.hash_vectors(rows, "chunk_id", F.col("text")), "batch-vectors")
    goals = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    answer = F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit(""))
    plan = ((1, 0, "dense_search", F.col("text")), (1, 1, "bm25_search", F.col("text")), (2, 0, "structured_search", F.col("text")), (2, 1, "bm25_search", answer))
    actions = goals.select("query_id", F.explode(F.array(*(F.struct(F.lit(r).alias("round"), F.lit(p).alias("pos"), F.lit(c).alias("channel"), t.alias("text")) for r, p, c, t in plan))).alias("a")).select("query_id", "a.*")

    def near(asks: DataFrame, k: int = 20) -> DataFrame:
        return dense.vector_search(vectors, stored(dense.hash_vectors(asks, "query_id", F.col("text")), "batch-asks"), top_k=k)

    def long_words(docs: DataFrame, key: str, to: str) -> DataFrame:
        return docs.select(F.col(key).alias(to), F.explode(F.filter(text.tokenize(F.col("text")), lambda w: F.length(w) >= 9)).alias("value"))

    searches = {
        "dense_search": near,
        "bm25_search": lambda asks: lexical.search(rows, asks, id_col="chunk_id", top_k=20),
        "structured_search": lambda asks: batch.structured(long_words(rows, "chunk_id", "id"), long_words(asks, "query_id", "query_id")),
    }
    _, found = batch.run(goals, actions, rows, searches, locate=lambda asks: batch.locate_then_detail(asks, near(asks, 30), rows))
    return found.select("query_id", "rank", "id", "doc_id", F.round("rrf", 9).alias("rrf"), "n_channels", "lane", F.md5("text").alias("digest"))


_SIGNAL_SQL = excerpt.SIGNAL.replace("(?iU)", "(?i)")
_ROOM = "(700 - a.used - CASE WHEN len(a.c) > 0 THEN 5 ELSE 0 END)"
_EXCERPT_SQL = rf"""
        WITH h AS ({bm25_sql('(SELECT doc_id AS id, text FROM documents)', _ASKS, 5)}),
             r AS (SELECT query_id, id, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS norm, list_filter(regexp_extract_all(lower(b.text), '{excerpt.TERM}'), lambda t: length(t) >= 2) AS raw FROM h JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id),
             t AS (SELECT query_id, id, norm, term, min(k) AS k FROM (SELECT query_id, id, norm, unnest(raw) AS term, generate_subscripts(raw, 1) AS k FROM r) GROUP BY query_id, id, norm, term),
             p AS (SELECT query_id, id, term, k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i, len(pieces) AS n FROM (SELECT query_id, id, term, k, string_split(lower(norm), term) AS pieces FROM t)),
             c AS (SELECT query_id, id, sum(length(piece)) OVER (PARTITION BY query_id, id, k ORDER BY i) + (i - 1) * length(term) AS loc, k, i, n FROM p),
             c3 AS (SELECT query_id, id, loc, 0 AS w FROM c WHERE i < n QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY k, i) <= {excerpt.CENTRES}),
             s AS (SELECT query_id, id, regexp_split_to_array(flat, '{_SIGNAL_SQL}') AS pieces, regexp_extract_all(flat, '{_SIGNAL_SQL}') AS found FROM (SELECT query_id, id, regexp_replace(norm, '[À-ɏ]', 'q', 'g') AS flat FROM r)),
             c2 AS (SELECT query_id, id, sum(a + b) OVER (PARTITION BY query_id, id ORDER BY i) - b AS loc, 1 AS w FROM (SELECT query_id, id, i, length(pieces[i]) AS a, length(found[i]) AS b FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM s))),
             l AS (SELECT query_id, id, list({{'c': []::STRUCT(s BIGINT, e BIGINT)[], 'used': 0::BIGINT, 'over': false, 's': greatest(0, loc - 140)::BIGINT, 'e': least(length(norm), loc + 140)::BIGINT}} ORDER BY w, loc) AS ws FROM (SELECT * FROM c3 UNION ALL SELECT * FROM c2) JOIN r USING (query_id, id) GROUP BY query_id, id),
             z AS (SELECT r.query_id, r.id, norm, list_reduce(list_prepend({{'c': [{{'s': 0::BIGINT, 'e': 175::BIGINT}}], 'used': 175::BIGINT, 'over': false, 's': 0::BIGINT, 'e': 0::BIGINT}}, coalesce(ws, [])), lambda a, x:
                       CASE WHEN a.over OR len(list_filter(a.c, lambda q: x.s >= q.s AND x.e <= q.e)) > 0 THEN a
                            WHEN {_ROOM} <= {excerpt.LEAST_ROOM} THEN {{'c': a.c, 'used': a.used, 'over': true, 's': x.s, 'e': x.e}}
                            WHEN least(x.e, x.s + {_ROOM}) - x.s > {excerpt.LEAST_WINDOW} THEN {{'c': list_append(a.c, {{'s': x.s, 'e': least(x.e, x.s + {_ROOM})}}), 'used': a.used + least(x.e, x.s + {_ROOM}) - x.s, 'over': false, 's': x.s, 'e': x.e}}
                            ELSE a END).c AS c FROM r LEFT JOIN l ON l.query_id = r.query_id AND l.id = r.id),
             y AS (SELECT query_id, id, norm, c, array_to_string(list_transform(list_sort(c), lambda q: trim(substr(norm, q.s + 1, q.e - q.s))), ' ... ') AS cut FROM z)
        SELECT query_id, id, CASE WHEN length(norm) <= 700 THEN norm WHEN len(c) = 1 THEN left(norm, 697) || '...' WHEN length(cut) > 700 THEN rtrim(left(cut, 697)) || '...' ELSE cut END AS excerpt FROM y"""


@query("query_excerpts", _EXCERPT_SQL)
def query_excerpts(spark, sf):
    """Excerpts of the best documents of every benchmark item, around the item's own terms."""
    docs, asks = _t(spark, sf, "documents").select("doc_id", "text"), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("ask"))
    hits = lexical.search(docs, asks, query_text=F.col("ask"), top_k=5).select("query_id", F.col("id").alias("doc_id"))
    hits = broadcast_up_to(stored(hits.join(asks, "query_id"), "excerpt-hits"), 200_000)  # texts stay where they are read
    rows = hits.join(docs, "doc_id")
    return rows.select("query_id", F.col("doc_id").alias("id"), excerpt.query_excerpt(F.col("text"), F.col("ask"), 700).alias("excerpt"))


@query("ordered_log", "SELECT row_number() OVER (ORDER BY event_id % 3, ts, event_id) AS seq, event_id, event_type FROM events")
def ordered_log(spark, sf):
    """All events, appended in three batches, one of which comes again."""
    events, log = _t(spark, sf, "events"), EventLog(spark)
    for k in (0, 1, 1, 2):
        log.append(events.where(F.col("event_id") % 3 == k), k)
    return log.read().select("seq", "event_id", "event_type")


_SAID = "md5(string_agg({0}, chr(10) ORDER BY turn))"


@query(
    "conversation_states",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations),
             r AS (SELECT conv_id, {_SAID.format("turn::VARCHAR || role || text")} AS recent FROM t WHERE n <= 3 GROUP BY conv_id),
             q AS (SELECT conv_id, count(*) AS n_turns, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS question, md5(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS answer FROM conversations GROUP BY conv_id)
        SELECT conv_id::VARCHAR AS session_id, n_turns, question, answer, recent FROM q JOIN r USING (conv_id)""",
)
def conversation_states(spark, sf):
    """All conversations, turn by turn in three batches that come out of order."""
    turns, state = _t(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id"), ConversationState(spark)
    for k, part in enumerate(("turn >= 4", "turn < 2", "turn between 2 and 3")):
        state.append(turns.where(part), k)
    said = F.array_join(F.transform("recent", lambda r: F.concat(r["turn"].cast("string"), r["role"], r["text"])), "\n")
    return state.read().select("session_id", "n_turns", F.md5("question.text").alias("question"), F.md5("answer.text").alias("answer"), F.md5(said).alias("recent"))


@query(
    "substring_matches",
    """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS needle FROM benchmark),
             n AS (SELECT * FROM w WHERE length(needle) >= 7 OR length(needle) = 2)
        SELECT item_id, needle, count(*) AS n_docs, min(doc_id) AS first_doc FROM n JOIN documents ON contains(lower(text), needle) GROUP BY item_id, needle""",
)
def substring_matches(spark, sf):
    """Long and two-letter words of every benchmark item, wherever documents contain them, also inside words."""
    words = _t(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("needle")).distinct()
    words = words.where("length(needle) >= 7 OR length(needle) = 2")
    pairs = substrings.containing(_t(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text")), words.select(F.col("needle").alias("needle_id"), "needle").distinct())
    per = pairs.groupBy(F.col("needle_id").alias("needle")).agg(F.count("*").alias("n_docs"), F.min("text_id").alias("first_doc"))
    return words.join(per, "needle").select("item_id", "needle", "n_docs", "first_doc")


@query("resampled_return_rate")
def resampled_return_rate(spark, sf):
    """Intervals of the share of returned lines, by line number, over all of lineitem."""
    rows = _t(spark, sf, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("back"))
    return resample.bootstrap(rows, {"back": F.col("back"), "of": F.lit(1)}, F.col("back") / F.nullif(F.col("of"), F.lit(0.0)), keys=("l_linenumber",), n=400)


@query("shuffled_priorities")
def shuffled_priorities(spark, sf):
    return resample.shuffled_baseline(_t(spark, sf, "orders"), F.col("o_orderpriority"))
