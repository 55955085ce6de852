"""The queries opN_<name> over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, toxicity, turns, warc
from .common import table
from .decontaminate import leaks
from .jaccard import groups
from .linededup import LineIndex
from .mixing import mix
from .neighbours import nearest
from .records import round_trip
from .spelling import variants
from .suffixdup import GRAM, MIX, PASSAGE, PRIMES, cut, factors
from .tokencount import count_documents


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap", "overlap")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(spark, table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, index = table(spark, sf_dir, "documents"), LineIndex(spark)
    index.insert(docs)
    return index.dedupe(docs, indexed=True).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(turns.repair(turns.damage(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_nearest": op2_nearest,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_records": op6_token_records,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {
    "op2_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             f AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
        SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (h)""",
}

#: Sizes, targets and the mix, pass by pass, over plain windows.
_MIX_PASS = """
             {n}c AS (SELECT d.*, g.gap, sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM {p}d d JOIN {p}g g ON d.source IS NOT DISTINCT FROM g.source WHERE NOT taken AND size > 0 AND size <= gap AND rank IS NOT NULL),
             {n}t AS (SELECT source, doc_id, size, upto FROM {n}c WHERE upto <= gap),
             {n}d AS (SELECT d.doc_id, d.source, d.size, d.rank, d.whole, d.source_size, d.target, d.taken OR t.doc_id IS NOT NULL AS taken FROM {p}d d LEFT JOIN {n}t t USING (doc_id)),
             {n}g AS (SELECT g.source, g.gap - coalesce(max(t.upto), 0) AS gap FROM {p}g g LEFT JOIN {n}t t ON t.source IS NOT DISTINCT FROM g.source GROUP BY g.source, g.gap),"""

ORACLES["op3_source_mix"] = (
    r"""
        WITH s0 AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                           (CAST('0x' || substr(md5(doc_id || ':17'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
             s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s0 GROUP BY source),
             s2 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2 * source_size::DOUBLE AS most FROM s1),
             s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
             s4 AS (SELECT source, source_size, CASE WHEN level * w >= most THEN most ELSE max(CASE WHEN level * w < most THEN level END) OVER () * w END AS target FROM s3),
             s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s4),
             ag AS (SELECT source, target - floor(rate) * source_size AS gap FROM s5),
             m0 AS (SELECT s0.source, gap, any_value(source_size)::DOUBLE / nullif(count(*) FILTER (WHERE size > 0), 0) AS mean FROM s0 JOIN ag ON s0.source IS NOT DISTINCT FROM ag.source JOIN s1 ON s0.source IS NOT DISTINCT FROM s1.source GROUP BY s0.source, gap),
             m1 AS (SELECT m0.source, j, CAST(ceil(mean * 2.0::DOUBLE ** j) AS BIGINT) AS long, sum(least(size, CAST(ceil(mean * 2.0::DOUBLE ** j) AS BIGINT))) AS mass, any_value(gap) AS gap FROM m0 JOIN s0 ON s0.source IS NOT DISTINCT FROM m0.source CROSS JOIN range(21) r(j) WHERE size > 0 AND size <= gap GROUP BY m0.source, j, mean),
             m2 AS (SELECT source, long, least(1.0::DOUBLE, gap / mass) AS t FROM m1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN mass >= gap THEN j ELSE 41 - j END) = 1),
             ad0 AS (SELECT s0.doc_id, s0.source, s0.size, s0.u, CAST(floor(rate) AS INTEGER) AS whole, CASE WHEN ag.gap > 0 AND size > 0 AND size <= ag.gap THEN least(t * least(1.0::DOUBLE, long::DOUBLE / size), 1 - 1e-9) END AS p, source_size, target
                     FROM s0 JOIN s5 ON s0.source IS NOT DISTINCT FROM s5.source JOIN ag ON s0.source IS NOT DISTINCT FROM ag.source LEFT JOIN m2 ON s0.source IS NOT DISTINCT FROM m2.source),
             ad1 AS (SELECT *, u / (1 - u) * ((1 - p) / p) AS odds FROM ad0 WHERE p > 0),
             ad AS (SELECT doc_id, source, size, odds / (1 + odds) AS rank, whole, source_size, target, false AS taken FROM ad1 UNION ALL SELECT doc_id, source, size, NULL, whole, source_size, target, false FROM ad0 WHERE coalesce(p, 0) <= 0),"""
    + "".join(_MIX_PASS.format(p=p, n=n) for p, n in zip("abc", "bcd", strict=True))
    + """
             z AS (SELECT 1)  -- ends the list of passes
        SELECT doc_id, size, source_size, target, CAST((whole + taken::INT) * size AS BIGINT) AS taken FROM dd"""
)

ORACLES["op5_ngram_jaccard"] = r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x1c-\x1f\x{85}\x{a0}]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
             c AS (SELECT g, min(doc_id) AS rep, count(*) AS copies FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g),
             x AS (SELECT rep, copies, len(g) AS n, unnest(g) AS t FROM c),
             p AS (SELECT a.rep AS a, b.rep AS b, b.copies FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n, b.copies HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
             r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
             k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
             l AS (SELECT a, CAST(sum(copies) AS BIGINT) AS links FROM p GROUP BY a)
        SELECT s.doc_id, coalesce(class_id, s.doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(copies, 1) AS BIGINT) AS copies, CAST(len(s.g) AS INTEGER) AS n_shingles
        FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN k ON k.node = c.rep LEFT JOIN l ON l.a = c.rep"""

_GRAMS = "list_distinct(CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < 5 THEN [array_to_string({0}, ' ')] ELSE list_transform(range(1, CAST(len({0}) - 3 AS BIGINT)), lambda i: array_to_string({0}[i:i + 4], ' ')) END)"
_HELD = "CAST(len(list_filter({0}, lambda g: contains(p, ' ' || g || ' '))) AS DOUBLE)"

ORACLES["op9_decontaminate"] = rf"""
        WITH b AS (SELECT item_id, trim(text, ' ' || chr(10)) AS t FROM benchmark),
             i0 AS (SELECT item_id, regexp_extract_all(lower(split_part(t, chr(10), 1)), '[\p{{L}}\p{{N}}_]+') AS q, regexp_extract_all(lower(CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END), '[\p{{L}}\p{{N}}_]+') AS a FROM b),
             it AS (SELECT item_id, q, a, len(q) + len(a) AS n_words, {_GRAMS.format('q')} AS gq, {_GRAMS.format('a')} AS ga FROM i0 WHERE len(q) + len(a) > 0),
             st AS (SELECT count(*) AS n, avg(n_words) AS mean, CAST(max(n_words) AS BIGINT) AS step FROM it),
             tf AS (SELECT item_id, n_words, term, count(*) AS tf FROM (SELECT item_id, n_words, unnest(list_concat(q, a)) AS term FROM it) GROUP BY ALL),
             df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
             wt AS (SELECT item_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / mean)) AS w FROM tf JOIN df USING (term), st),
             lim AS (SELECT item_id, 0.4::DOUBLE * sum(w) AS least FROM wt GROUP BY item_id),
             d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
             pa AS (SELECT doc_id, j, ws[j * step + 1:(j + 2) * step] AS p FROM (SELECT doc_id, ws, step, unnest(range(CAST(greatest(1, ceil(len(ws) / CAST(step AS DOUBLE))) AS BIGINT))) AS j FROM d, st)),
             sc AS (SELECT doc_id, j, item_id, sum(w) AS score FROM (SELECT doc_id, j, unnest(list_distinct(p)) AS term FROM pa) JOIN wt USING (term) GROUP BY ALL),
             h AS (SELECT doc_id, j, item_id, score, ' ' || array_to_string(p, ' ') || ' ' AS p, gq, ga FROM sc JOIN lim USING (item_id) JOIN pa USING (doc_id, j) JOIN it USING (item_id) WHERE score >= least),
             o AS (SELECT doc_id, j, item_id, score, {_HELD.format('gq')} / nullif(len(gq), 0) AS question_overlap, {_HELD.format('ga')} / nullif(len(ga), 0) AS answer_overlap, ({_HELD.format('gq')} + {_HELD.format('ga')}) / (len(gq) + len(ga)) AS overlap FROM h)
        SELECT doc_id, item_id, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap, round(overlap, 6) AS overlap
        FROM o WHERE coalesce(question_overlap, 1) >= 0.6 AND coalesce(answer_overlap, 1) >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, score DESC, j) = 1"""

_RUN = " + ".join(f"x[i + {k}] * {f}" for k, f in enumerate(factors(), 1))

ORACLES["op7_suffix_repeats"] = rf"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
             w AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
             r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
             g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
             s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g) GROUP BY doc_id, part),
             p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS free FROM s),
             k AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS tail, string_agg(hex(b[free + 1:lo]), '' ORDER BY lo) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
             xs AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) // 2) AS x FROM documents),
             hs AS (SELECT doc_id, list_transform(range(CAST(len(x) - {GRAM - 1} AS BIGINT)), lambda i: {_RUN}) AS s FROM xs WHERE len(x) >= {PASSAGE}),
             os AS (SELECT doc_id, list_transform(s, lambda v: (v % {PRIMES[0]} * {MIX[0]} % {PRIMES[1]} + v // {PRIMES[0]} * {MIX[1]} % {PRIMES[1]}) % {PRIMES[1]} * 2147483648 + v % {PRIMES[0]}) AS h FROM hs),
             rs AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, CAST(len(h) - {PASSAGE - GRAM - 1} AS BIGINT)), lambda i: list_min(h[i:i + {PASSAGE - GRAM}])))) AS run FROM os),
             sp AS (SELECT DISTINCT doc_id FROM rs WHERE run IN (SELECT run FROM rs GROUP BY run HAVING count(*) > 1))
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               CASE WHEN spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[tail + 1:n]))) END AS kept_sha256,
               CAST(sp.doc_id IS NOT NULL AS INTEGER) AS shares_passage FROM d LEFT JOIN k USING (doc_id) LEFT JOIN sp USING (doc_id)"""

#: The 256 remainders of crc32, from their rule.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crc FROM (WITH RECURSIVE s AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM s WHERE k < 8) SELECT i, v FROM s WHERE k = 8)"
#: crc32 of a list of bytes: the bytes follow the start value.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda c, b: xor(c // 256, crc[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295)"
_BYTES = "list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"

ORACLES["op11_spelling_variants"] = rf"""
        WITH RECURSIVE t AS ({_CRC_TABLE}),
             r0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')) AS run FROM documents),
             r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r0 GROUP BY ALL),
             h AS (SELECT run, n, {_CRC.format(_BYTES.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)"))} AS h FROM r, t),
             w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
             k AS (SELECT DISTINCT word, n, unnest(list_append(list_transform(range(length(word)), lambda i: left(word, i) || '?' || substr(word, i + 2)), word)) AS k, 0 AS less FROM w
                   UNION SELECT word, n, unnest(list_transform(range(length(word)), lambda i: left(word, i) || substr(word, i + 2))) AS k, 1 AS less FROM w),
             p AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word AND a.less + b.less < 2),
             f AS (SELECT word, count(*) AS n_near, arg_max(other, m) AS any_form, max(m) AS m FROM p GROUP BY word),
             b AS (SELECT p.word, min(other) AS form FROM p JOIN f ON p.word = f.word AND p.m = f.m GROUP BY p.word),
             x AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN form END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN b ON b.word = w.word),
             c AS (SELECT word, word AS at FROM x UNION ALL SELECT c.word, x.form FROM c JOIN x ON x.word = c.at WHERE x.form IS NOT NULL),
             e AS (SELECT c.word, c.at AS root FROM c JOIN x ON x.word = c.at WHERE x.form IS NULL)
        SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM x JOIN e USING (word)"""

ORACLES["op12_line_dedup"] = r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT row, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT row, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
             m AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) > 1)
        SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> l.doc_id OR owner IS NOT NULL AND l.doc_id IS NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR owner = l.doc_id), '')) AS kept_sha256
        FROM l LEFT JOIN m USING (k) GROUP BY row"""

_STEP = "CASE {q}::VARCHAR || {r} WHEN '0s' THEN 1 WHEN '0u' THEN 2 WHEN '1u' THEN 2 WHEN '2a' THEN 3 WHEN '3u' THEN 2 END"
ORACLES["op13_turn_repair"] = rf"""
        WITH RECURSIVE t AS ({_CRC_TABLE}),
             c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
             c1 AS (SELECT conv_id, turn, role, text, {_CRC.format(_BYTES.format('key'))} % 20 AS h FROM c0, t),
             c2 AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c1 WHERE h <> 0),
             c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM c2),
             c4 AS (SELECT *, left(role, 1) AS r, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM c3),
             ids AS (SELECT DISTINCT conv_id FROM conversations),
             n AS (SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(i) AS rows
                   FROM ids LEFT JOIN c4 ON c4.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
             g AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair, lag(i) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c4) WHERE before IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
             o AS (SELECT * FROM (VALUES (0, '', 0, 0, NULL, NULL), (0, 'I', 2, 5, 'user:', NULL), (0, 'II', 3, 10, 'user:', 'assistant:'), (1, '', 1, 0, NULL, NULL), (1, 'I', 2, 5, 'user:', NULL), (1, 'II', 3, 10, 'user:', 'assistant:'),
                                         (2, '', 2, 0, NULL, NULL), (2, 'I', 3, 5, 'assistant:', NULL), (3, '', 3, 0, NULL, NULL), (3, 'I', 2, 5, 'user:', NULL)) v(q, ins, dest, paid, one, two)),
             e AS (SELECT q, ins || label AS label, label AS edit, dest, paid, one, two FROM o, (VALUES ('K'), ('R')) l(label) UNION ALL SELECT q, 'D', 'D', q, 0, NULL, NULL FROM o WHERE ins = ''),
             a AS (SELECT e.q, e.label, e.edit, r.r, paid + CASE edit WHEN 'R' THEN 1 WHEN 'D' THEN 2 ELSE 0 END AS paid, one, two,
                          CASE edit WHEN 'D' THEN dest WHEN 'R' THEN CASE dest WHEN 2 THEN 3 ELSE 2 END ELSE {_STEP.format(q='dest', r='r.r')} END AS too, CASE WHEN edit = 'R' THEN CASE dest WHEN 2 THEN 'assistant' ELSE 'user' END END AS new_role FROM e, (SELECT DISTINCT r FROM c4) r),
             w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS said, 1 AS best FROM ids
                   UNION ALL
                   SELECT * FROM (
                       SELECT w.conv_id, w.i + 1, a.too, w.cost + a.paid + CASE WHEN c4.fault = 't' AND a.edit <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || a.label AS audit,
                              w.said || list_filter([a.one, a.two, CASE a.edit WHEN 'K' THEN c4.role || ':' || c4.text WHEN 'R' THEN a.new_role || ':' || c4.text END], lambda x: x IS NOT NULL) AS said,
                              row_number() OVER (PARTITION BY w.conv_id, a.too ORDER BY w.cost + a.paid + CASE WHEN c4.fault = 't' AND a.edit <> 'D' THEN 5 ELSE 0 END, w.audit || a.label) AS best
                       FROM w JOIN c4 ON c4.conv_id IS NOT DISTINCT FROM w.conv_id AND c4.i = w.i + 1 JOIN a ON a.q = w.q AND a.r = c4.r WHERE a.too IS NOT NULL AND (a.edit = 'D' OR c4.fault NOT IN ('b', 'd'))) WHERE best = 1),
             z AS (SELECT w.conv_id, cost + o.paid AS cost, audit || ins AS audit, said || list_filter([one, two], lambda x: x IS NOT NULL) AS said FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i JOIN o ON o.q = w.q WHERE o.dest IN (0, 3)
                   QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + o.paid, audit || ins) = 1)
        SELECT n.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
        FROM n JOIN z ON z.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM n.conv_id"""
