"""Operators against brute force, exact round trips and held-out accuracy; nulls, ties, empty and long inputs."""

import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, forest, hosts, leaks, mixing, rangecoder, shared, textscan, tokens, toxicity, warc, weaklabels
from corvane.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}
random.seed(3)
LEX = ["w%d" % i for i in range(200)] + ["Über", "ÉTÉ", "a", "B"]
say = lambda n: " ".join(random.choice(LEX) for _ in range(n))


def odd_rows():
    base, long = say(120), say(20_000)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE\ttwo"), (9, long), (10, long + " end"), (11, say(300)), (11, base), (12, "a b c d"), (13, " x y"), (None, say(9))]
    return [(i, t, "en", None if i == 7 else f"s{(i or 0) % 4}", None) for i, t in rows]


def test_near_duplicates_equal_brute_force(texts):
    rows = odd_rows()
    rows = [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in [x[0] for x in rows[:k]]]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for i, t, *_ in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(texts(rows)).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_near_duplicates_of_crowded_regions(texts):
    base = say(400).split()
    rows = []
    for i in range(300):
        w = list(base)
        for k in random.sample(range(400), 8):
            w[k] = f"x{i}_{k}"
        rows.append((i + 1, " ".join(w), "en", "s", None))
    rows.append((0, " ".join(base), "en", "s", None))
    got = forest.near_duplicates(texts(rows), cap=64).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 301


def test_empty_tables(texts):
    none = texts([])
    bench = none.select(F.col("doc_id").alias("item_id"), "text")
    assert forest.near_duplicates(none).count() == 0
    assert leaks.contamination(none, bench).count() == 0
    assert mixing.mix(none).count() == 0
    assert tokens.length_histogram(tokens.encoded_lengths(none, vocabulary())).count() == 0
    assert weaklabels.quality(none).count() == 0
    labels = none.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    assert toxicity.toxicity(none, labels).count() == 0


def test_contamination_equals_brute_force(spark, texts):
    rows = odd_rows()
    passage = say(14)
    rows += [(20, say(30) + " " + passage + " " + say(5), "en", "s", 0), (21, passage.upper() + "! " + passage, "en", "s", 0), (22, " ".join(passage.split()[:9]), "en", "s", 0)]
    items = [(1, passage), (2, "one two"), (3, None), (4, "..."), (None, passage), (5, passage), (30, say(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for i, t, *_ in rows:
        w, hit, found = find(t), set(), set()
        for item, it in items:
            v = find(it)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        found |= {str(item)} - {"None"}
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for chunk in (leaks.CHUNK_BYTES, 40):
        got = [tuple(r) for r in leaks.report(leaks.contamination(texts(rows), bench, chunk_bytes=chunk)).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    longest = {(r.item_id, r.item_word): (r.words, r.doc_id, r.doc_word) for r in leaks.longest_matches(texts(rows), bench).collect()}
    assert longest["1", 0] == (14, 20, 30) and longest["1", 4] == (10, 20, 34)


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    for vocab in (2, 300, 49_408, 200_000):
        for n, block in ((1, 1), (1, 512), (700, 512), (512, 512), (5000, 16), (30_000, 64)):
            skewed = (vocab * rng.random(n) ** 6).astype(np.uint32)
            for ids in (rng.integers(0, vocab, n).astype(np.uint32), skewed, np.full(n, vocab - 1, np.uint32), np.tile(skewed[: n // 9 + 1], 9)[:n]):
                order0 = rangecoder.Order0.of(ids, vocab)
                packed = order0.pack()
                assert (rangecoder.decode(rangecoder.encode(ids, block, order0, vocab), n, block, rangecoder.Order0.unpack(packed)) == ids).all()
    same = np.full(4000, 7, np.uint32)
    assert sum(map(len, rangecoder.encode(same, 4000, rangecoder.Order0.of(same, 49_408), 49_408))) < 400


def test_range_coder_beats_zlib_on_documents(spark):
    enc = tokens.TokenEncoder(vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").toArrow()["text"]
    ids = np.concatenate([enc.encode_slice(data, offsets)[0] for _, _, data, offsets in textscan.slices(docs)])
    n = np.array([len(ids)])
    whole = sum(map(len, tokens.file_bytes(iter([(n, n < 0, n, ids)]), 49_408)))
    assert whole < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_token_ids_round_trip(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = odd_rows() + [(30, "<|endoftext|> İi ΑΣ́ é\tx\u0085y\x0bz", "en", "s", 0)]
    folder = shared.new_folder(spark, "ids")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_ids(tokens.write_ids(texts(rows), vocabulary(), folder), folder).collect())
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_id_file_checks_blocks():
    ids = np.arange(5000, dtype=np.uint32)
    counts = np.array([0, 4000, 0, 1, 999, 0])
    keys, null = np.array([5, 1, 2, 0, 9, -3]), np.array([False, False, False, True, False, False])
    ends = np.cumsum(counts)
    want = [(None if v else k, ids[b - c : b].tolist()) for k, v, c, b in zip(keys.tolist(), null.tolist(), counts.tolist(), ends.tolist(), strict=True)]
    for group in (1 << 20, 1000, 333, 5000):
        data = b"".join(tokens.file_bytes(iter([(keys, null, counts, ids)]), 49_408, group))
        assert [(k, x.tolist()) for k, x in tokens.read_file(io.BytesIO(data))] == want
        two = iter([(keys[:2], null[:2], counts[:2], ids[:4000]), (keys[2:], null[2:], counts[2:], ids[4000:])])
        assert [(k, x.tolist()) for k, x in tokens.read_file(io.BytesIO(b"".join(tokens.file_bytes(two, 49_408, group))))] == want
    for at in range(20, len(data) - 20, 97):
        bad = bytearray(data)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            list(tokens.read_file(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(tokens.read_file(io.BytesIO(data[:-30])))


def test_warc_round_trip(spark):
    page = "<html>" + say(50) + "</html>"
    rows = [(1, "http://a/b c\r\nX: y", page), (2, None, page), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9000), (None, "u", page), (2, None, page)] + [(100 + i, "http://h/", f"{i} " + say(40)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared.new_folder(spark, "warc")
    got = warc.read_archives(warc.write_archives(pages.repartition(1), folder), folder).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.page_id is None or r.page_id < 10)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    body = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.page_id is None or (r.payload_bytes == len(body[r.page_id]) and r.payload_digest == warc.digest(body[r.page_id]) and r.payload in (None, body[r.page_id]))


def test_warc_reader_refuses_faults():
    good = warc.record(1, "http://x/", b"body", None)
    data = b"".join(warc.archive(iter([good] * 3)))
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 3
    many = b"".join(warc.archive(iter([warc.record(i, "http://x/", say(60).encode(), None) for i in range(100)])))
    assert struct.unpack("<I", many[:4])[0] == warc.DICTIONARY_MAGIC and len(list(warc.read_archive(io.BytesIO(many)))) == 100
    wrong = [good.replace(b"body", b"bodx"), good.replace(b"Content-Length: ", b"Content-Length: 9"), good.replace(b"WARC-Date", b"X"), good.replace(b"WARC/1.1", b"HTTP"), good[:-2]]
    for bad in wrong:
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(b"".join(warc.archive(iter([bad]))))))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_mixing_targets(texts):
    rows = [(i, say(1 + i % 50), "en", ("a", "b", None)[i % 3] if i % 10 else "tiny", 0) for i in range(400)] + odd_rows()
    got = mixing.mix(texts(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.mixed_source, []).append(r)
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= 1 and sum(r.size for r in x) == x[0].source_size
    assert abs(sum(x[0].target for x in by.values()) - sum(r.size for r in got)) < 0.01
    again = mixing.mix(texts(rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_inversion(spark):
    knots = ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0))
    t = [r.t for r in spark.range(11).select(mixing.invert(F.col("id") / 10, knots).alias("t")).collect()]
    area = lambda x: sum(np.interp((np.arange(20000) + 0.5) / 20000 * x, *zip(*knots, strict=True))) * x / 20000
    assert all(abs(area(x) / mixing.integral(knots) - k / 10) < 1e-6 for k, x in enumerate(t))


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q=/en/", "https://com/en/", "http://notcom/en/", "http://x.net/de/", "http://example.net/de/8", "no scheme", None, "http://u:p@h.org:80/es/#/", "http://x.org?/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([(1, None)], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("com", "/en/", "com/en/", "block") and got[2][2] is None
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][:2] == ("", "") and got[6][:2] == ("", "")
    assert got[7][:3] == ("u:p@h.org:80", "/es/", None) and got[8][1:3] == ("", None)


def test_bad_hosts_are_blocked(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.example/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    seen = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "page_id long, good int")
    got = hosts.judge(pages, seen).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict) for r in got} == {("bad.example", "block"), ("good.example", "allow")}


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:740] = x[100]
    rows = [(i, x[i].tolist()) for i in range(1500)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0, 2.0]), (2400, [None] * 16), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 1500, 100))
    assert got[100] == list(range(700, 710))
    right = 0
    for q in got:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        o = np.lexsort((np.arange(1500), d))
        right += len(set(o[o != q][:10]) & set(got[q]))
    assert right >= 0.9 * 10 * len(got)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    got = toxicity.toxicity(docs, train).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    clean = [r for r in got if r.y == 0]
    assert sum(r.toxic == (r.y == 1) for r in got) >= 0.9 * len(got) and sum(r.toxic for r in clean) <= 0.03 * len(clean)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = weaklabels.quality(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_length_histogram(texts):
    rows = odd_rows()
    got = {r.length: r for r in tokens.length_histogram(tokens.encoded_lengths(texts(rows), vocabulary())).collect()}
    lengths = sorted(r.length for r in tokens.encoded_lengths(texts(rows), vocabulary()).collect())
    for n, r in got.items():
        assert (r.n_docs, r.docs_up_to, r.tokens_over) == (lengths.count(n), sum(x <= n for x in lengths), sum(x for x in lengths if x > n))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)


def test_extra_columns_with_clashing_names(texts):
    rows = texts(odd_rows()).selectExpr("*", "1 as id", "2 as k", "3 as size", "4 as x", "5 as n", "6 as component")
    assert forest.near_duplicates(rows).count() == mixing.mix(rows, keep=["k", "size", "id"]).count() == weaklabels.quality(rows).count() == len(odd_rows())


def test_encoder_equals_the_library_on_random_strings():
    import random
    from array import array

    from corvane.llm import tokens
    from corvane.llm.queries import vocabulary

    enc, r = tokens.TokenEncoder(vocabulary()), random.Random(5)
    # marks beside words, apostrophes, digits, composing and unusual characters, special tokens, all kinds of space
    some = [*"aAzZ09 '\n\t.,&<|>≠̸́éÉßÑñ…Σσİ漢 \x1f\x85\xa0ﬁ½٣’sStTlmd", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "é,", "ŉ!"]
    many = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(10_000)] + ["a" * 300 + " b", "É" * 300, "", " "]
    for x in many[:2000]:
        assert enc.encode(x) == array("I", enc.library.encode(x, add_special_tokens=False).ids).tobytes(), repr(x)
    assert enc.encode(None) == b""
    # many rows at a time, with a table that is cleared again and again
    tokens.CACHED_PIECES, kept = 1000, tokens.CACHED_PIECES
    got = []
    for _, _, data, offsets in textscan.slices(pa.array([None, *many]), docs=100):
        ids, edges = enc.encode_slice(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tokens.CACHED_PIECES = kept
    assert got == [[]] + [enc.library.encode(x, add_special_tokens=False).ids for x in many]
