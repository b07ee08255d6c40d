"""Credential spans against plain scans and all pairs of spans; paragraphs, distances, long and odd texts."""

import hashlib
import random
import re

from corvane.llm import credentials, queries

KEY = "Ab3" * 12
ROLE = {k: r for r, kinds in credentials.ROLES.items() for k in kinds}


def base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(credentials.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(credentials.ACCESS, text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(credentials.HEX, text) if len(m[0]) >= 24])


def linked(text):
    """Weak spans that any other span in reach completes."""
    spans = [(a, credentials.KINDS[k], len(re.findall(r"\n[ \t\r]*\n", text[:a]))) for a, k, _ in credentials.scan(text)]
    near = lambda a, scope, role: any(ROLE.get(k) == role and s == scope and abs(b - a) <= credentials.REACH for b, k, s in spans)
    return [(a, k) for a, k, s in spans if k in credentials.NEEDS and all(near(a, s, r) for r in credentials.NEEDS[k])]


def texts_of(rng):
    parts = ["token = abcdef", "Secret: x", "api-key=1234567", "apiKey='AKIA" + "Z" * 16, "AKIA12", "deadbeef" * 3, "deadbeef", KEY, "a" * 40, "user: root", "x.y@example.com", "https://h.example/p?q=1", "redis://r", "\n\n", "\n \t\n", "\n\n\n", "pad " * 60, "é𝔘ß", "\x0b", '"passwd" : "hunter22"', "password:token: abcdefgh"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(150)]


def test_spans_equal_plain_scans_and_all_pairs(spark, texts):
    given = [None, "", " "] + texts_of(random.Random(2)) + ["user: root " + "pad " * 120_000 + KEY, (KEY + " ") * 2000 + "login=me", "x" * 300_000, "." * 100_000 + "@", "a@b.c" * 5000]
    given += given[5:8]
    rows = [(i % 140 if i else None, t, "en", None, None) for i, t in enumerate(given)]
    got = sorted((str(r.doc_id), r.spans, r.linked, r.all_spans) for r in credentials.find(texts(rows).withColumnRenamed("source", "kind").withColumnRenamed("lang", "row")).collect())
    want = []
    for i, t, *_ in rows:
        s = [(a, credentials.KINDS[k], b) for a, k, b in base(t or "")]
        ends = {(a, credentials.KINDS[k]): b for a, k, b in credentials.scan(t or "")}
        w = [(a, k, ends[a, k]) for a, k in linked(t)] if t and len(t) < 5000 else None
        want.append((str(i), s, w))
    assert len(got) == len(want)
    for i, s, w in want:
        assert any(g[0] == i and [tuple(x) for x in g[1]] == s and (w is None or [tuple(x) for x in g[2]] == w) and len(g[3]) == len(g[1]) + len(g[2]) for g in got)
    assert sum(bool(w) for _, _, w in want) > 20 and any(g[1] and not g[2] for g in got)


def test_weak_parts_need_each_other(spark, texts):
    near = {1: KEY, 2: f"user: root {KEY}", 3: f"user: root\n\n{KEY}", 4: "user: root " + "pad " * 120 + KEY, 5: f"https://a.b {KEY}", 6: f"https://a.b {KEY} user: root", 7: "mail a@b.c token = abcdef0"}
    got = {r.doc_id: [s.kind for s in r.linked] for r in credentials.find(texts([(i, t, "", "", 0) for i, t in near.items()])).collect()}
    assert got == {1: [], 2: ["login", "key"], 3: [], 4: [], 5: [], 6: ["endpoint", "key", "login"], 7: ["address"]}


def test_query_of_a_text(spark, texts, tmp_path):
    texts([(1, 'é token = "abcdef"', "", "", 0), (2, None, "", "", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op12_credentials(spark, str(tmp_path)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].spans) == (1, 0, 0, "assign:2:17")
    assert got[1].base_sha256 == hashlib.sha256(b"assign:2:17").hexdigest() and got[2].spans == ""


def test_empty_table(spark, texts):
    assert credentials.find(texts([])).collect() == []
