"""Text functions as column expressions; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the lexical index leaves out.
STOPWORDS = ("the", "and", "or", "of", "to", "in", "for", "a", "an", "with", "on", "is", "are", "by", "from", "at", "as")

#: Clinical phrases that stay whole in queries and chunks.
CLINICAL_PHRASES = (
    "非小细胞肺癌", "小细胞肺癌", "肺腺癌", "肺鳞癌", "乳腺癌", "结直肠癌",
    "脑膜转移", "脑转移", "骨转移", "肝转移", "淋巴结转移", "胸膜转移",
    "基因突变", "基因扩增", "基因融合", "耐药突变", "外显子缺失",
    "奥希替尼", "伏美替尼", "阿美替尼", "埃克替尼", "吉非替尼", "厄洛替尼",
    "卡马替尼", "赛沃替尼", "特泊替尼", "培美曲塞", "卡铂", "顺铂",
    "靶向治疗", "联合治疗", "单药治疗", "一线治疗", "二线治疗", "既往治疗",
    "部分缓解", "完全缓解", "疾病稳定", "疾病进展", "临床反应", "客观缓解率",
    "无进展生存", "总生存期", "症状改善", "影像学", "脑脊液", "转氨酶升高",
    "肝毒性", "不良反应", "停药", "减量",
)

CJK = r"[\x{4e00}-\x{9fff}]+"
#: Patterns of headings, pointers and study designs.
REFERENCE_HEADING = r"^\s*(?:#{1,6}\s*)?(?:\d+(?:\.\d+)*[.)]?\s*)?(?:references?(?:\s+and\s+notes)?|bibliography|参\s*考\s*文\s*献|参\s*考\s*资\s*料)\s*:?[ \t]*$"
REFERENCE_POINTER = r"(?i)(?:\[\s*(?:doi|pubmed)\s*\]|google\s+scholar|pmc\s+free\s+article)"
TRIAL = r"(?iU)\b(?:randomi[sz]ed|phase\s*[i1-4v]+|clinical\s+trial|controlled\s+trial)\b|临床试验|随机对照"
COHORT = r"(?iU)\b(?:cohort|retrospective|prospective|observational|real[- ]world|case[- ]control|cross[- ]sectional)\b|队列|回顾性|前瞻性|观察性|统计分析"
REVIEW = r"(?iU)\b(?:systematic\s+review|meta[- ]analysis|literature\s+review|review)\b|系统综述|荟萃分析|综述"
CASE_REPORT = r"(?iU)\b(?:case\s+report|case\s+presentation|a\s+case\s+of)\b|病例报告|个案报道"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def normalize_text(text: Column) -> Column:
    """White space of any script collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ngrams(span: Column, width: int) -> Column:
    """Overlapping runs of `width` characters; none where the span is shorter."""
    return F.when(F.length(span) >= width, F.transform(F.sequence(F.lit(0), F.length(span) - width), lambda i: F.substring(span, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case latin tokens without stop words, then 2-, 3- and 4-grams of each CJK span; an array in that order."""
    # neither token holds white space, so none is collapsed; most texts have no CJK span to be cut
    t = F.lower(text)
    latin = F.filter(_all(t, r"[a-z0-9\-+.]++"), lambda w: ~w.isin(*STOPWORDS))
    cjk = F.flatten(F.transform(_all(t, CJK), lambda s: F.concat(*(ngrams(s, n) for n in (2, 3, 4)))))
    return F.when(t.rlike(r"[\x{4e00}-\x{9fff}]"), F.concat(latin, cjk)).otherwise(latin)


def retrieval_terms(text: Column, most: int = 64) -> Column:
    """Query terms: latin tokens and numbers with units, clinical phrases, CJK 2- and 4-grams; distinct, in that order, capped."""
    t = F.lower(normalize_text(text))
    latin = F.transform(_all(t, r"[a-z][a-z0-9_.+-]*|\d+(?:\.\d+)?(?:\s*(?:mg|g|%|周|月|天))?"), lambda w: F.trim(w))
    phrases = F.filter(F.array(*map(F.lit, CLINICAL_PHRASES)), lambda p: t.contains(p))
    cjk = F.flatten(F.transform(_all(t, CJK), lambda s: F.concat(ngrams(s, 2), ngrams(s, 4))))
    kept = F.filter(F.concat(latin, phrases, cjk), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def chunk_text(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Array of windows of `size` characters of the normalised text, each starting `overlap` before the end of the one before."""
    step = size - overlap

    def cut(t: Column) -> Column:
        n = F.length(t)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    # one element, so that the text is normalised once and not for each window
    return F.get(F.transform(F.array(normalize_text(text)), cut), 0)


def strip_references(text: Column) -> Column:
    """The text up to its last reference heading, without white space at its end; unchanged where there is none."""
    head = f"(?im:{REFERENCE_HEADING})"
    cut = F.regexp_extract(text, rf"(?s)\A(.*){head}", 1)
    return F.when(text.rlike(head), F.regexp_replace(cut, r"(?U)\s+\z", "")).otherwise(F.coalesce(text, F.lit("")))


def is_reference_list(text: Column, least: int = 3) -> Column:
    return F.coalesce(F.size(_all(text, REFERENCE_POINTER)) >= least, F.lit(False))


def publication_date(value: Column) -> Column:
    """A bibliographic date as yyyy-MM-dd; months and years alone become their last day; null where nothing parses."""
    # bound once, as it is referred to many times
    return F.get(F.transform(F.array(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), lambda raw: _date(raw)), 0)


def _date(raw: Column) -> Column:
    last = lambda y, m: F.date_format(F.last_day(F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-01")), "yyyy-MM-dd")), "yyyy-MM-dd")
    part = lambda pattern, k: F.nullif(F.regexp_extract(raw, pattern, k), F.lit(""))
    name = "([A-Za-z]{3,9})"

    def month(text: Column) -> Column:
        known = F.array(*map(F.lit, MONTHS))
        full = F.array(*map(F.lit, ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")))
        m = F.lower(text)
        place = F.when(F.array_position(known, m) > 0, F.array_position(known, m)).otherwise(F.array_position(full, m))
        return F.when(place > 0, place.cast("string"))

    day = lambda y, m, d: F.date_format(F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    ym, my = rf"^(\d{{4}}) {name}$", rf"^{name} (\d{{4}})$"
    ymd, mdy = rf"^(\d{{4}}) {name} (\d{{1,2}})$", rf"^{name} (\d{{1,2}}) (\d{{4}})$"
    return F.coalesce(
        F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw),
        F.when(raw.rlike(r"^\d{4}[-/]\d{1,2}$"), last(part(r"^(\d{4})[-/](\d{1,2})$", 1), part(r"^(\d{4})[-/](\d{1,2})$", 2))),
        F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-12-31"))),
        last(part(ym, 1), month(part(ym, 2))),
        last(part(my, 2), month(part(my, 1))),
        day(part(ymd, 1), month(part(ymd, 2)), part(ymd, 3)),
        day(part(mdy, 3), month(part(mdy, 1)), part(mdy, 2)),
    )


def meta_publication_date(html: Column) -> Column:
    """The citation_publication_date of a page's meta tags, in either order of attributes."""
    a = F.regexp_extract(html, r"(?i)<meta\b[^>]*\bname=[\"']citation_publication_date[\"'][^>]*\bcontent=[\"']([^\"']+)[\"'][^>]*>", 1)
    b = F.regexp_extract(html, r"(?i)<meta\b[^>]*\bcontent=[\"']([^\"']+)[\"'][^>]*\bname=[\"']citation_publication_date[\"'][^>]*>", 1)
    return publication_date(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def event_types(raw: Column) -> Column:
    """The parts of an event type between plus signs, mapped to the known types; distinct, in order."""
    known = ("diagnosis", "molecular", "treatment", "response", "progression", "toxicity", "metastasis", "ddi", "outcome", "other")

    def one(seg: Column) -> Column:
        s = F.lower(F.trim(seg))
        rules = (("metastasis", ("metasta",)), ("toxicity", ("tox", "adverse")), ("molecular", ("molec", "mutation")), ("diagnosis", ("diagn",)), ("treatment", ("treat", "therapy")), ("response", ("resp",)), ("progression", ("prog",)))
        out = F.when(s.isin(*known), s)
        for name, needles in rules:
            hit = s.contains(needles[0])
            for x in needles[1:]:
                hit = hit | s.contains(x)
            out = out.when(hit, F.lit(name))
        return out.otherwise(F.lit("other"))

    return F.when(F.coalesce(raw, F.lit("")) == "", F.array(F.lit("other"))).otherwise(F.array_distinct(F.transform(F.split(raw, r"\+"), one)))


def document_type(title: Column, declared: Column | None = None, is_case_report: Column | None = None, rejection: Column | None = None) -> Column:
    """Study design: what is declared, a case report by decision, then the title, then the reason of rejection, then the title's case pattern."""
    none = F.lit(None).cast("string")
    declared, rejection = F.nullif(F.trim(declared if declared is not None else none), F.lit("")), F.coalesce(rejection if rejection is not None else none, F.lit(""))
    case = is_case_report if is_case_report is not None else F.lit(None).cast("boolean")
    t = F.coalesce(title, F.lit(""))
    out = F.when(declared.isNotNull(), declared).when(case, "case_report")
    for text in (t, rejection):
        out = out.when(text.rlike(TRIAL), "clinical_trial").when(text.rlike(REVIEW), "review").when(text.rlike(COHORT), "cohort_or_observational_study")
    return out.when(F.coalesce(case, F.lit(True)) & t.rlike(CASE_REPORT), "case_report").otherwise("other_literature")


def evidence_level(document_type: Column) -> Column:
    d = F.lower(document_type)
    return (
        F.when(d == "case_report", "case_report_evidence").when(d == "clinical_trial", "clinical_trial_evidence")
        .when(d == "cohort_or_observational_study", "cohort_or_observational_evidence").when(d == "review", "review_evidence").otherwise("other_literature_evidence")
    )


def genes_and_alterations(texts: Column) -> Column:
    """Struct of genes (runs of 2 to 8 capitals and digits) and alteration texts of an array, each distinct without regard to case, first spelling kept."""
    distinct = lambda xs: F.aggregate(xs, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    clean = F.filter(texts, lambda x: F.coalesce(x, F.lit("")) != "")
    genes = F.flatten(F.transform(clean, lambda x: _all(x, r"(?U)\b[A-Z0-9]{2,8}\b")))
    altered = F.transform(F.filter(clean, lambda x: F.lower(x).rlike("mutation|del|fusion|amplification|ins|exon")), lambda x: F.trim(x))
    return F.struct(distinct(genes).alias("genes"), distinct(altered).alias("alterations"))


def distinct_terms(values: Column) -> Column:
    """Array without blanks and without repeats regardless of case; the first spelling stays."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def adapt_query(text: Column, most: int = 64) -> Column:
    """A search string without field tags, boolean words, comment marks and repeats: distinct words, at most `most`."""
    t = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", " "), r"(?m)#.*$", " ")
    t = F.regexp_replace(t, r"(?U)\b(?:AND|OR|NOT)\b", " ")
    return F.array_join(F.slice(distinct_terms(F.split(normalize_text(F.regexp_replace(t, r"[()\"]", " ")), " ")), 1, most), " ")


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9_.-]", "_")


def json_object(text: Column) -> Column:
    """The JSON object in a reply: the whole, else in a fence, else from the first to the last brace; null where none parses."""
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.trim(c))
    return F.coalesce(ok(text), ok(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), ok(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))


def redact(data: Column, keys: tuple[str, ...] = ("api_key", "authorization", "password", "secret", "token")) -> Column:
    """A JSON text whose values of sensitive keys, at any depth, are masked (string, number or word values)."""
    pattern = r'(?i)("(?:' + "|".join(keys) + r')"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}\]\s]+)'
    return F.regexp_replace(data, pattern, r'$1"[REDACTED]"')
