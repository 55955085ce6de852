import hashlib
import zlib

import numpy as np
import pytest

from quillstone.llm import records, tokencount, warc
from quillstone.llm.common import file_system, read_range, scratch
from quillstone.llm.wordcode import WordEncoder

DOCS = [
    (5, "The quick brown fox, the QUICK one. It's 3.5 km!"), (1, None), (2, ""), (9, "á é ΣΑΣ 日本語  x\ty z"), (9, "again the same id"), (None, "no id"), (7, "<|endoftext|> odd <|startoftext|>words don't I'LL"),
    (3, "a.b,c. d." * 50), (4, "word " * 40_000), (8, "the the the"), (8, "the the the"),
]
SCHEMA = "doc_id long, text string, file string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "clash", "clash") for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder()


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(encoder):
    texts = [t for _, t in DOCS] + ["x" * 3000, "İ i̇", "ᄀ ᅡ", "a ́b", "e.́ f,́g", "..a., b", "'s.'s 'll"]
    for _ in range(2):  # the second time from what is known
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == [plain(encoder, t) for t in texts]
    small = WordEncoder(known=3, young=3)
    assert [np.frombuffer(small.encode([t])[0], "<u2").tolist() for t in texts] == [plain(encoder, t) for t in texts]


def test_records_round_trip(spark, docs, encoder):
    where = scratch(spark, "t")
    manifest = records.write_records(docs, where, file_bytes=4000, partitions=3)
    assert manifest.count() > 3
    rows = records.read_records(manifest, where, chunk_bytes=500, with_ids=True).orderBy("start").collect()
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = [(d, [*plain(encoder, t), 2]) for d, t in order]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in rows] == want
    at = 0
    for r, (_, ids) in zip(rows, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = rows[4]  # a shuffled read: by the index alone
    payload, _ = records.unframe(read_range(where, one["file"], one["offset"], 10_000_000), 0)
    assert payload[9:] == one["ids"]


def test_damage_is_found():
    data = bytearray(records.frame(b"payload of a record"))
    assert records.unframe(bytes(data), 0) == (b"payload of a record", len(data))
    for i in range(len(data)):
        bad = bytes(data[:i]) + bytes([data[i] ^ 1]) + bytes(data[i + 1 :])
        with pytest.raises(ValueError):
            records.unframe(bad, 0)


@pytest.mark.parametrize("file_bytes", [64, 16 << 20])
def test_flat_counts(spark, docs, encoder, file_bytes):
    """Every row, the text that holds separators, the null id and the repeated rows included, against plain encoding."""
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencount.count_documents(spark, docs, file_bytes=file_bytes).collect()), key=str)
    assert got == sorted(((d, len(plain(encoder, t)) + 1) for d, t in DOCS), key=str)
    assert dict(got)[7] == len(plain(encoder, dict(DOCS)[7])) + 1


def test_flat_counts_of_texts_that_hold_separators(spark, docs, encoder):
    """A separator in a text must not shift the counts of the documents after it, nor drop the last ones."""
    more = [(20, "<|endoftext|>"), (21, "after one"), (22, "a <|endoftext|><|endoftext|> b " * 40), (22, "the same id, three words more"), (23, "the last of its stream")]
    rows = DOCS + more
    for frame in (docs.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)):
        given = [(r["doc_id"], r["text"]) for r in frame.collect()]
        got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencount.count_documents(spark, frame, file_bytes=64).collect()), key=str)
        assert got == sorted(((d, len(plain(encoder, t)) + 1) for d, t in given), key=str)


def write_ids(spark, where, streams):
    rows = []
    fs, path = file_system(where)
    fs.create_dir(path)
    for s, files in enumerate(streams):
        for k, ids in enumerate(files):
            with fs.open_output_stream(f"{path}/s{s}_{k}.tok") as f:
                f.write(np.array(ids, "<u2").tobytes())
            rows.append((s, k, f"s{s}_{k}.tok", 2 * len(ids), []))
    return spark.createDataFrame(rows, tokencount.FILES)


def test_separators_across_blocks_and_files(spark):
    rng = np.random.default_rng(2)
    streams = [[rng.integers(0, 5, n).tolist() for n in sizes] for sizes in ([37, 0, 90, 5], [4], [0], [64, 64])]
    streams.append([[9] * 50, [9] * 30, [0, 9, 9]])  # a document over several files, and an open end
    streams.append([[0, 0, 0]])
    where = scratch(spark, "t")
    files = write_ids(spark, where, streams)
    for block in (2, 6, 16, 1 << 20):
        got = {(r["stream"], r["ordinal"]): (r["start"], r["n_tokens"], r["closed"]) for r in tokencount.scan(files, where, end_id=0, block_bytes=block).collect()}
        want = {}
        for s, parts in enumerate(streams):
            start, k = 0, 0
            flat = [x for p in parts for x in p]
            for i, x in enumerate(flat):
                if x == 0:
                    want[s, k] = (start, i - start + 1, True)
                    start, k = i + 1, k + 1
            if start < len(flat):
                want[s, k] = (start, len(flat) - start, False)
        assert got == want, block
    with pytest.raises(Exception, match="whole number"):
        tokencount.scan(spark.createDataFrame([(0, 0, "s0_0.tok", 3, [])], tokencount.FILES), where, end_id=0).collect()


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert records.round_trip(spark, empty).count() == 0 and tokencount.count_documents(spark, empty).count() == 0


def test_warc_round_trip(spark):
    trap = warc.pack(77, "http://trap", b"inner", hashlib.sha1(b"inner").hexdigest(), None)  # a whole record as payload
    html = ["<p>x</p>", None, "", "same " * 300, "same " * 300, "same " * 300, "short", "short", trap.decode(), "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n", "long " * 60_000, trap.decode() * 30]
    rows = [(i * 3 % 13 + 100, f"http://h/{i} x", h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    where = scratch(spark, "t")
    manifest = warc.write_archives(pages.coalesce(1), where, file_bytes=20_000)
    for block in (300, 5_000, 4 << 20):
        got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest, where, block).collect())
        first = max(p for p, _, h, _ in rows if h == "same " * 300)
        want = []
        for p, _, h, _ in rows:
            b = (h or "").encode()
            again = h == "same " * 300 and p != first
            want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
        assert got == sorted(want), block
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    assert warc.round_trip(spark, spark.createDataFrame([(None, None, None, "x")], pages.schema)).first()["payload_bytes"] == 0


def test_warc_urls_of_any_length(spark):
    """A header longer than a read-ahead must not end its file's chain."""
    rows = [(i, f"http://h/{i}?" + "q" * n, f"<p>{i}</p>") for i, n in enumerate([3, 100_000, 20, 16_300, 16_384, 2_000_000, 5])]
    rows.append((50, "http://h/t", "x\r\n\r\nWARC/1.1\r\n" + "no field\r\n" * 5000 + "\r\n\r\nWARC/1.1\r\na:" + "b" * 50_000))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    where = scratch(spark, "t")
    manifest = warc.write_archives(pages, where)
    for block in (50_000, 4 << 20):
        got = sorted((r["page_id"], r["payload_digest"]) for r in warc.read_archives(manifest, where, block).collect())
        assert got == [(i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows], block


def test_warc_ids_of_all_longs(spark):
    ids = [-(1 << 63), -(10**18), -1, 0, 10**18 - 1, 10**18, 1234567890123456789, (1 << 63) - 1]
    pages = spark.createDataFrame([(i, "http://h", "same " * 300) for i in ids], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect())
    assert got == [(i, None if i == ids[-1] else ids[-1]) for i in ids]
    for x, n in (("9223372036854775808", None), ("-9223372036854775809", None), ("0" * 30 + "7", 7), ("7" * 30, None), ("", None)):
        assert warc.describe(0, 0, 1, {"x-page-id": x})["page_id"] == n


def test_warc_repeats_of_all_kinds(spark):
    """Null ids among repeats, repeated rows, one payload of most rows, over several tasks; a filter that lets everything through changes nothing."""
    rows = [(None if i % 7 == 0 else i, f"u{i}", ("same " * 300, "other " * 250, f"own {i} " * 200, "none " * 240)[i % 4]) for i in range(80)] + [(76, "u76", "same " * 300)] * 3
    rows += [(None, "u", "null only " * 200)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    first: dict = {}
    for p, _, h in rows:
        if p is not None:
            first[h] = max(p, first.get(h, p))
    times = {h: sum(x[2] == h for x in rows) for _, _, h in rows}
    want = []
    for p, _, h in rows:
        again = times[h] > 1 and h in first and p != first[h]
        want.append((p, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    for held in (warc.in_sieve, lambda bits, digest: True):
        kept, warc.in_sieve = warc.in_sieve, held
        try:
            got = warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        finally:
            warc.in_sieve = kept
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sieve_holds_all_digests(spark):
    digests = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(4000)]
    bits = warc.sieve(spark.createDataFrame([(d,) for d in digests[:1000]], "digest string"))
    assert all(warc.in_sieve(bits, d) for d in digests[:1000]) and sum(warc.in_sieve(bits, d) for d in digests[1000:]) < 150
    assert not warc.in_sieve(warc.sieve(spark.createDataFrame([], "digest string")), digests[0])


def test_warc_lost_records_are_an_error(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 40) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    where = scratch(spark, "t")
    manifest = warc.write_archives(pages, where)
    fs, base = file_system(where)
    name = f"{base}/{manifest.first()['file']}"
    with fs.open_input_file(name) as f:
        data = f.read()
    at = data.index(b"X-Page-Id: 7\r\n")
    with fs.open_output_stream(name) as f:
        f.write(data[:at] + data[at:].replace(b"Content-Length: ", b"Content-Xength: ", 1))
    for block in (2_000, 4 << 20):
        with pytest.raises(ValueError, match="of 30 records reached"):
            warc.read_archives(manifest, where, block).count()


def test_pointer_jumping():
    assert warc.jump(np.array([1, 2, 2, 4, 4])).tolist() == [2, 2, 2, 4, 4]


def test_fake_headers_in_a_payload_cost_no_payload_each(spark):
    """4,000 headers in a page claim 4 MB each, which the file has behind them; none of them is read or hashed."""
    import time

    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4000000\r\n\r\n"
    plain = fake.replace("WARC/1.1", "WARX/1.1")
    took = []
    for text in (plain, fake):
        pages = spark.createDataFrame([(1, "u", text * 4000), (2, "v", "x" * 6_000_000)], "page_id long, url string, html string")
        began = time.time()
        rows = {r.page_id: r for r in warc.round_trip(spark, pages.coalesce(1)).collect()}
        took.append(time.time() - began)
        assert rows[1].payload_digest == hashlib.sha1((text * 4000).encode()).hexdigest() and rows[2].payload_bytes == 6_000_000
    assert took[1] < 2 * took[0] + 5
