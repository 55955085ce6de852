"""Lookups in the drug knowledge tables, for a table of wanted terms at once, and the rule chunks built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from . import substrings


def term(c: Column) -> Column:
    return F.lower(normalize_text(c))


def by_names(rows: DataFrame, wanted: DataFrame, *names: Column, aliases: Column | None = None) -> DataFrame:
    """Rows with any of the wanted terms (query_id, term) among their names: exploded, so it is an equi join."""
    every = F.array(*names) if aliases is None else F.concat(F.array(*names), F.coalesce(aliases, F.array().cast("array<string>")))
    named = rows.withColumn("_name", F.explode(F.array_distinct(F.filter(F.transform(every, term), lambda x: F.coalesce(x, F.lit("")) != ""))))
    w = wanted.select("query_id", term(F.col("term")).alias("_name")).distinct()
    return named.join(w, "_name").drop("_name").dropDuplicates(["query_id", *rows.columns])


def by_mutation(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose mutation equals or contains a wanted term; distinct mutations meet distinct terms by their n-grams."""
    w = wanted.select("query_id", term(F.col("term")).alias("_term")).where(F.coalesce("_term", F.lit("")) != "").distinct()
    names = rows.select(term(F.col("mutation")).alias("text")).distinct()
    pairs = substrings.containing(names.select(F.col("text").alias("text_id"), "text"), w.select(F.col("_term").alias("needle_id"), F.col("_term").alias("needle")).distinct())
    hits = w.join(pairs, F.col("_term") == F.col("needle_id")).select("query_id", F.col("text_id").alias("_mutation")).distinct()
    return rows.join(hits, term(F.col("mutation")) == F.col("_mutation")).drop("_mutation")


def case_interactions(rows: DataFrame, *, drugs: list[str], mutations: list[str], interactions: list[str], top_k: int = 20) -> DataFrame:
    """Cases (row_no, drugs, alterations, interaction_type) with a wanted drug, mutation and interaction, first ones by row_no."""
    have = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), term)
    lits = lambda xs: F.array(*(F.lit(x.strip().lower()) for x in xs))
    out = rows
    if drugs:
        out = out.where(F.arrays_overlap(have(F.col("drugs")), lits(drugs)))
    if mutations:
        out = out.where(F.exists(have(F.col("alterations")), lambda a: F.exists(lits(mutations), lambda m: a.contains(m))))
    if interactions:
        out = out.where(term(F.col("interaction_type")).isin(*[x.strip().lower() for x in interactions]))
    return out.orderBy("row_no").limit(top_k)


def expansion(names: DataFrame, pk: DataFrame, rules: DataFrame, wanted: DataFrame, most: int = 24) -> DataFrame:
    """query_id, terms: the wanted terms, then names of the drugs, then enzymes of these, then interaction terms of those;
    distinct, at most `most`."""
    n = by_names(names, wanted, F.col("drug_name"), F.col("generic_name"), F.col("brand_name"), aliases=F.col("alias"))
    n = n.select("query_id", F.explode(F.concat(F.array("drug_name", "generic_name", "brand_name"), F.coalesce("alias", F.array().cast("array<string>")))).alias("term"))
    drugs = wanted.select("query_id", "term").unionByName(n)
    p = by_names(pk, drugs, F.col("drug_name"), F.col("related_pk_drug")).select("query_id", F.explode(F.array("enzyme_transporter", "pk_interaction_type")).alias("term"), F.col("enzyme_transporter").alias("enzyme"))
    r = rules.withColumn("_e", term(F.col("enzyme_transporter"))).join(p.select("query_id", term(F.col("enzyme")).alias("_e")).distinct(), "_e").select("query_id", F.col("ddi_likelihood").alias("term"))
    ranked = [t.select("query_id", term(F.col("term")).alias("term")).where("term <> ''").withColumn("src", F.lit(i)) for i, t in enumerate((wanted, n, p, r))]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).unionByName(ranked[3]).groupBy("query_id", "term").agg(F.min("src").alias("src"))
    w = Window.partitionBy("query_id").orderBy("src", "term")
    every = every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return every.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))


def rule_chunks(names: DataFrame, rules: DataFrame, pk: DataFrame, mutations: DataFrame) -> DataFrame:
    """doc_id, text, evidence_level: one chunk for each row of the knowledge tables, in a fixed wording."""
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    pair = lambda **kw: F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in kw.items()))
    c = F.col
    parts = [
        names.select(F.lit("drug_name_map").alias("doc_id"), pair(drug_name=c("drug_name"), generic_name=c("generic_name"), brand_name=c("brand_name"), aliases=joined(c("alias"))).alias("text")),
        rules.select(F.lit("ddi_rule").alias("doc_id"), pair(enzyme_or_transporter=c("enzyme_transporter"), role1=c("role1"), role2=c("role2"), ddi_likelihood=c("ddi_likelihood"), notes=c("notes")).alias("text")),
        pk.select(F.lit("drug_pk_relation").alias("doc_id"), pair(drug=c("drug_name"), role=c("role"), enzyme_or_transporter=c("enzyme_transporter"), interaction_type=c("pk_interaction_type"), related_pk_drug=c("related_pk_drug"), adme=c("adme_desc")).alias("text")),
        mutations.select(F.lit("mutation_drug_map").alias("doc_id"), pair(mutation=c("mutation"), recommended_or_reported_drugs=joined(c("drugs"))).alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("chunk_type", F.lit("ddi_rule_chunk")).withColumn("evidence_level", F.lit("drug_label_or_ddi_rule_evidence"))
