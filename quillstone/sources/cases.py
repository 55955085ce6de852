"""The layered case corpus as DataFrames: documents, profiles, timeline events, evidence chunks, entity index.

Three folders of JSON files (extracted text, cleaned text, structured events) are read with explicit schemas and joined
by the stem of their file names. `legacy_stems` keeps a known quirk of older tools, which lost documents that only the
structured layer has; it is off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

STEP1 = "pmid string, source_file string, extraction_method string, title string, author string, date string, url string, hostname string, description string, categories string, tags string, text string, text_length int, fingerprint string, license string"
STEP2 = "text string, is_case_report boolean, rejection_reason string, provenance struct<source_filename:string,source_pmid:string,original_file:string,cleaning_timestamp:string,model:string>, cleaning_stats struct<original_length:int,cleaned_length:int,reduction_ratio:double>, metadata struct<title:string,author:string,date:string,publication_date:string>"
STEP3 = """provenance struct<source_filename:string,source_pmid:string,extraction_timestamp:string,document_type:string,confidence_score:double>,
baseline_clinical_profile struct<age:int,sex:string,smoking_status:string,pack_years:double,diagnosis_date:string,cancer_type:string,histology:string,tnm_stage_system:string,tnm_stage:string,overall_stage:string,baseline_primary_site:string,metastatic_sites_at_baseline:array<string>,presenting_symptoms:array<string>,baseline_molecular_alterations:array<string>>,
timeline_events array<struct<time:string,event_type:string,molecular:struct<alterations:array<string>,sample:string>,treatment:struct<line:string,regimen:array<string>,type:string,dosage:map<string,string>>,response:struct<best:string,duration_months:double>,safety:struct<adverse_events:array<string>,dose_adjustments:array<string>>,toxicities:array<struct<event:string,grade:string>>,metastatic_sites:array<string>>>,
drug_interaction struct<involved_drugs:array<string>>, outcome_summary struct<survival_months:double,survival_status:string,cause_of_death:string,last_follow_up:string>, knowledge_annotation struct<key_findings:array<string>,ddi_relevance:string,generalizability:string>"""
LAYERS = {"step1_extracted": (STEP1, r"([^/]+?)(?:_tr)?\.json$"), "step2_cleaned": (STEP2, r"([^/]+?)(?:_tr_cleaned)?\.json$"), "step3_structured": (STEP3, r"([^/]+?)(?:_tr_cleaned)?(?:\.json)?\.json$")}
NONE = "cast(array() as array<string>)"


def layer(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row a file: stem and a struct of its fields, null in the fields that a file does not have."""
    schema, stem = LAYERS[name]
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/{name}/*.json")
    return raw.select(F.regexp_extract(F.url_decode(F.input_file_name()), stem, 1).alias("stem"), F.struct(*raw.columns).alias(name[:5]))


def unified(spark: SparkSession, root: str, legacy_stems: bool = False) -> DataFrame:
    """stem, step1, step2, step3: a full outer join of the layers."""
    one, two, three = (layer(spark, root, n) for n in LAYERS)
    return one.join(two, "stem", "full").join(three, "stem", "left" if legacy_stems else "full")


def documents(cases: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """pages: source_file, html of original articles, whose citation date goes before every other date."""
    c = cases if pages is None else cases.join(pages.select(F.col("source_file").alias("_file"), "html"), F.col("step1.source_file") == F.col("_file"), "left")
    meta = T.meta_publication_date(F.col("html")) if pages is not None else F.lit(None).cast("string")
    kept = lambda *cs: F.coalesce(*(F.nullif(x, F.lit("")) for x in cs))
    date = F.coalesce(meta, T.publication_date(F.col("step1.date")), T.publication_date(F.col("step2.metadata.publication_date")))
    source = F.when(meta.isNotNull(), "citation_publication_date").when(F.col("step1").isNotNull(), "step1_date_fallback")
    return c.select(
        F.col("stem").alias("doc_id"),
        F.when(F.col("step3").isNotNull(), "step3_structured").when(F.col("step2").isNotNull(), "step2_cleaned").otherwise("step1_extracted").alias("source_layer"),
        kept(F.col("step3.provenance.source_pmid"), F.col("step2.provenance.source_pmid"), F.col("step1.pmid")).alias("pmid"),
        kept(F.col("step2.metadata.title"), F.col("step1.title")).alias("title"),
        date.alias("date"),
        kept(F.col("step3.provenance.source_filename"), F.col("step1.source_file")).alias("source_file"),
        F.col("step1.url").alias("source_url"),
        F.col("step1.hostname").alias("hostname"),
        F.lit("en").alias("language"),
        T.document_type(kept(F.col("step2.metadata.title"), F.col("step1.title")), F.col("step3.provenance.document_type"), F.col("step2.is_case_report"), F.col("step2.rejection_reason")).alias("document_type"),
        F.struct(F.col("step1.fingerprint").alias("step1_fingerprint"), source.alias("publication_date_source"), F.col("step2.is_case_report").alias("is_case_report"), F.col("step2.rejection_reason").alias("rejection_reason"), F.col("step3.provenance.confidence_score").alias("step3_confidence_score")).alias("metadata"),
    )


def profiles(cases: DataFrame) -> DataFrame:
    p = "step3.baseline_clinical_profile"
    flat = F.flatten(F.transform(F.col("step3.timeline_events"), lambda e: F.coalesce(e["molecular"]["alterations"], F.expr(NONE))))
    own = F.coalesce(F.col(f"{p}.baseline_molecular_alterations"), F.expr(NONE))
    names = ["age", "sex", "smoking_status", "pack_years", "diagnosis_date", "cancer_type", "histology", "tnm_stage_system", "tnm_stage", "overall_stage"]
    return cases.select(
        F.concat("stem", F.lit("#case-1")).alias("case_id"), F.col("stem").alias("doc_id"), *(F.col(f"{p}.{n}").alias(n) for n in names), F.col(f"{p}.baseline_primary_site").alias("primary_site"),
        *(F.coalesce(F.col(f"{p}.{n}"), F.expr(NONE)).alias(n) for n in ("metastatic_sites_at_baseline", "presenting_symptoms")),
        F.when(F.size(own) > 0, own).otherwise(F.coalesce(flat, F.expr(NONE))).alias("baseline_molecular_alterations"),
    )


def event_summary(profile: Column, e: Column) -> Column:
    """Text of an event: what it is about, then named facts, those that are there."""
    some = lambda xs, sep: F.nullif(F.array_join(xs, sep), F.lit(""))
    named = lambda name, v: F.concat(F.lit(f"{name}="), v)
    text = lambda v: F.nullif(v, F.lit(""))
    months = F.when(e["response"]["duration_months"] == F.floor(e["response"]["duration_months"]), e["response"]["duration_months"].cast("long").cast("string")).otherwise(e["response"]["duration_months"].cast("string"))
    harms = F.array_distinct(F.concat(F.coalesce(F.transform(e["toxicities"], lambda t: t["event"]), F.expr(NONE)), F.coalesce(e["safety"]["adverse_events"], F.expr(NONE))))
    return F.concat_ws(
        ", ", text(profile["cancer_type"]), text(profile["histology"]), some(e["molecular"]["alterations"], " / "), text(e["treatment"]["line"]), some(e["treatment"]["regimen"], " + "), named("response", text(e["response"]["best"])), named("time", text(e["time"])),
        named("dosage", F.when(F.size(e["treatment"]["dosage"]) > 0, F.to_json(e["treatment"]["dosage"]))), named("response_duration_months", months), named("toxicities", some(harms, " / ")),
        named("dose_adjustments", F.when(F.size(e["safety"]["dose_adjustments"]) > 0, F.to_json(e["safety"]["dose_adjustments"]))), named("metastatic_sites", some(e["metastatic_sites"], " / ")),
    )


def events(cases: DataFrame) -> DataFrame:
    p = F.col("step3.baseline_clinical_profile")
    e = cases.where("step3 is not null").select("stem", p.alias("p"), F.posexplode("step3.timeline_events").alias("pos", "e"))
    row, none = F.col("e"), F.expr(NONE)
    arr = lambda c: F.coalesce(c, none)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(none)
    found = T.genes_and_alterations(arr(row["molecular"]["alterations"]))
    entities = F.struct(*(T.distinct_terms(c).alias(n) for n, c in {
        "cancer_types": one(F.col("p.cancer_type")), "histologies": one(F.col("p.histology")), "genes": found["genes"], "gene_alterations": found["alterations"], "drugs": arr(row["treatment"]["regimen"]), "lines_of_therapy": one(row["treatment"]["line"]),
        "responses": one(row["response"]["best"]), "toxicities": arr(F.transform(row["toxicities"], lambda t: t["event"])), "metastatic_sites": arr(row["metastatic_sites"]), "ddi_terms": none,
    }.items()))
    return e.select(
        F.format_string("%s#case-1#event-%03d", "stem", F.col("pos") + 1).alias("event_id"), F.col("stem").alias("doc_id"), F.concat("stem", F.lit("#case-1")).alias("case_id"), (F.col("pos") + 1).alias("event_no"),
        F.coalesce(F.nullif(row["time"], F.lit("")), F.lit("unknown")).alias("time"), T.event_types(row["event_type"]).alias("event_types"), event_summary(F.col("p"), row).alias("summary_text"), entities.alias("entities"), F.to_json("e").alias("raw_json"),
    )


def chunks(cases: DataFrame, docs: DataFrame, evts: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """Text chunks of the cleaned text, or the extracted one where that is empty, without reference lists; then a chunk for
    each event; then one of the structured facts. Chunk ids count over all three kinds, chunk_order is the place in the text."""
    level = docs.select(F.col("doc_id"), T.evidence_level(F.col("document_type")).alias("level"))
    clean = F.nullif(F.col("step2.text"), F.lit(""))
    body = cases.select(F.col("stem").alias("doc_id"), F.when(clean.isNotNull(), "step2_cleaned").otherwise("step1_extracted").alias("layer"), F.posexplode(T.chunk_text(T.strip_references(F.coalesce(clean, F.col("step1.text"))), size, overlap)).alias("chunk_order", "text"))
    body = body.where(~T.is_reference_list(F.col("text"))).join(level, "doc_id").select("doc_id", F.lit(0).alias("kind"), "chunk_order", F.lit(None).cast("string").alias("event_id"), F.lit("case_text_chunk").alias("chunk_type"), "text", F.col("level").alias("evidence_level"), "layer")
    fact = F.lit("structured_extraction_evidence")
    ev = evts.select("doc_id", F.lit(1).alias("kind"), F.col("event_no").alias("chunk_order"), "event_id", F.lit("event_chunk").alias("chunk_type"), F.col("summary_text").alias("text"), fact.alias("evidence_level"), F.lit("step3_structured").alias("layer"))
    parts = [F.when(F.col(f"step3.{n}").isNotNull(), F.concat(F.lit(f"{n}="), F.to_json(f"step3.{n}"))) for n in ("baseline_clinical_profile", "outcome_summary", "knowledge_annotation")]
    st = cases.where("step3 is not null").select(F.col("stem").alias("doc_id"), F.lit(2).alias("kind"), F.lit(0).alias("chunk_order"), F.lit(None).cast("string").alias("event_id"), F.lit("structured_field_chunk").alias("chunk_type"), F.concat_ws("\n", *parts).alias("text"), fact.alias("evidence_level"), F.lit("step3_structured").alias("layer")).where("text <> ''")
    all_ = body.unionByName(ev).unionByName(st)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "chunk_order"))
    return all_.withColumn("chunk_id", F.format_string("%s#chunk-%06d", "doc_id", n)).withColumn("case_id", F.concat("doc_id", F.lit("#case-1"))).drop("kind")


def entity_index(evts: DataFrame) -> DataFrame:
    """ref_id, case_id, entity_type, entity_value (lower case) of the events' entities."""
    fields = [f.name for f in evts.schema["entities"].dataType.fields]
    typed = lambda n: F.transform(F.col(f"entities.{n}"), lambda v: F.struct(F.lit(n).alias("entity_type"), F.lower(v).alias("entity_value")))
    pairs = F.flatten(F.array(*map(typed, fields)))
    return evts.select(F.col("event_id").alias("ref_id"), "case_id", F.explode(pairs).alias("e")).select("ref_id", "case_id", "e.*").distinct()


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, status of built tables."""
    rows = [(n, t.count()) for n, t in sorted(tables.items())]
    return spark.createDataFrame([(n, c, "ready" if c else "missing") for n, c in rows], "name string, rows long, status string")


def refresh_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` with the columns of `new` where it has the key, its own ones elsewhere."""
    cols = [c for c in new.columns if c != key]
    fresh = new.select(key, F.struct(*cols).alias("_new"), F.lit(True).alias("_has"))
    return old.join(fresh, key, "left").select(*(F.coalesce(F.when(F.col("_has"), F.col(f"_new.{c}")), F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in `new`, and the new rows (the last one given of a key by all columns)."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in new.columns if c != key))
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
