import re

from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_white_space_of_any_script(spark):
    assert one(spark, "　a \n b\t", T.normalize_text) == "a b"


def test_tokens_and_cjk_grams(spark):
    assert one(spark, "The EGFR-L858R of 肺腺癌 4.5", T.tokenize) == ["egfr-l858r", "4.5", "肺腺", "腺癌", "肺腺癌"]
    assert one(spark, None, T.tokenize) is None
    assert one(spark, "", T.tokenize) == []


def test_retrieval_terms_are_distinct_and_capped(spark):
    terms = one(spark, "osimertinib 80 mg Osimertinib 奥希替尼", T.retrieval_terms)
    assert terms[:3] == ["osimertinib", "80 mg", "奥希替尼"] and len(terms) == len(set(terms))
    assert len(one(spark, " ".join(f"w{i}x" for i in range(100)), T.retrieval_terms)) == 64


def plain_chunks(text, size, overlap):
    t, out, a = re.sub(r"\s+", " ", text).strip(), [], 0
    while a < len(t):
        out.append(t[a : a + size])
        if a + size >= len(t):
            break
        a += size - overlap
    return out


def test_chunks_equal_a_plain_loop(spark):
    for n in (0, 1, 9, 10, 11, 18, 19, 57):
        text = "".join(chr(97 + i % 26) for i in range(n))
        assert one(spark, text, lambda c: T.chunk_text(c, 10, 2)) == plain_chunks(text, 10, 2)


def test_references_are_cut_at_the_last_heading(spark):
    assert one(spark, "Body cites reference 1 in context.\n\nReferences\n1. Author. Paper. DOI", T.strip_references) == "Body cites reference 1 in context."
    assert one(spark, "正文\n6. 参考文献\n1. x", T.strip_references) == "正文"
    assert one(spark, "正文\n参 考 文 献\n1. x", T.strip_references) == "正文"
    kept = "The reference cohort was used in this study."
    assert one(spark, kept, T.strip_references) == kept
    assert one(spark, None, T.strip_references) == ""


def test_reference_lists(spark):
    assert one(spark, "[DOI] [PubMed] Google Scholar", T.is_reference_list) is True
    assert one(spark, "see [DOI]", T.is_reference_list) is False


def test_publication_dates(spark):
    cases = {"2021 Aug": "2021-08-31", "2020-02": "2020-02-29", "2019/4": "2019-04-30", "2018": "2018-12-31", "2020-01-05": "2020-01-05", "March 2021": "2021-03-31", "2021 Aug 3": "2021-08-03", "August 3 2021": "2021-08-03", "soon": None, "": None, "2021 Foo": None}
    for raw, want in cases.items():
        assert one(spark, raw, T.publication_date) == want, raw
    assert one(spark, '<META content="2021 Aug" name="citation_publication_date">', T.meta_publication_date) == "2021-08-31"


def test_event_types(spark):
    assert one(spark, "Diagnosis + molecular testing + therapy + diagnosis", T.event_types) == ["diagnosis", "molecular", "treatment"]
    assert one(spark, None, T.event_types) == ["other"]


def test_document_types(spark):
    df = spark.createDataFrame([("A retrospective cohort of patients with NSCLC", False), ("Systematic review of EGFR inhibitors", False), ("x", True), ("A case of lung cancer", None), ("A case of lung cancer", False)], "t string, c boolean")
    got = [r[0] for r in df.select(T.document_type(F.col("t"), None, F.col("c"))).collect()]
    assert got == ["cohort_or_observational_study", "review", "case_report", "case_report", "other_literature"]


def test_distinct_terms_keep_the_first_spelling(spark):
    df = spark.createDataFrame([(["EGFR", " egfr", "", "KRAS", None],)], "x array<string>")
    assert df.select(T.distinct_terms(F.col("x"))).first()[0] == ["EGFR", "KRAS"]


def test_query_adaptation(spark):
    out = one(spark, "(EGFR[tiab] AND osimertinib) OR EGFR # note", T.adapt_query)
    assert out == "EGFR osimertinib"
    assert one(spark, "term " * 80, T.adapt_query) == "term"


def test_json_and_redaction(spark):
    assert one(spark, 'say ```json\n{"a": 1}\n``` done', T.json_object) == '{"a": 1}'
    assert one(spark, "no object", T.json_object) is None
    assert one(spark, '{"api_key": "k", "n": {"Authorization": "x y"}, "keep": 1}', T.redact) == '{"api_key": "[REDACTED]", "n": {"Authorization": "[REDACTED]"}, "keep": 1}'


def test_benefit_levels(spark):
    cases = {"明显获益": 0, "无明显获益": 2, "无明显获益（x）": 0, "病情稳定": 1, "未获益": 2, "PD": 3, "": 2, "?": 2}
    for raw, k in cases.items():
        assert one(spark, raw, L.benefit_level) == L.BENEFIT_LEVELS[k], raw


def test_word_boundaries_next_to_cjk(spark):
    hit = lambda t: one(spark, t, lambda c: c.rlike(L.DDI))
    assert not hit("是否有相互作用？") and hit("药物 相互作用 风险")
    dose = lambda t: one(spark, t, lambda c: c.rlike(L.DOSE))
    assert not dose("奥希替尼80mg") and dose("奥希替尼 80 mg")


def test_verdicts(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (1, 2, 1, 0), (0, 1, 0, 0), (3, 1, 1, 0)], "s int, c int, r int, h int")
    got = [x[0] for x in df.select(L.verdict(*(F.col(k) for k in "scrh"))).collect()]
    assert got == ["insufficient_evidence", "needs_caution_due_to_contradiction_or_risk", "not_supported", "supported_with_monitoring"]
