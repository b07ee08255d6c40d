"""Repairs against a search of all edits, long conversations against a table of all states; nulls, ties, losses, spooled texts."""

import hashlib
import itertools
import random
import re
import zlib

from corvane.llm import queries, repair

SHAPE = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def table(rows, marks):
    """Least (cost, audit, repaired rows) by state, row by row, with up to two insertions between rows."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if i in NEXT[state]:
                        way = (cost + 5, audit + "I", (*out, (role, "")))
                        best[NEXT[state][i]] = min(best.get(NEXT[state][i], way), way)
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, marks, strict=True):
        grown = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 2, "D", ())]
            if fault in ("", "truncated"):
                charge = cost + 5 * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    ways.append((role[:1], charge, "K", ((role, text),)))
                ways += [(i, charge + 1, "R", ((r, text),)) for i, r in (("u", "user"), ("a", "assistant")) if i in NEXT[state]]
            for to, c, e, more in ways:
                to = to if to in ("", "s") or e == "D" else to
                way = (c, audit + e, out + more)
                grown[to] = min(grown.get(to, way), way)
        best = inserted(grown)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    names = list(dict.fromkeys(r[0] for r in rows))
    found = []
    for conv in names:
        after = []
        for c, turn, role, text in rows:
            show = lambda v: " " if v is None else str(v)
            by = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            if c != conv or by == 0:
                continue
            role, text = "user" if by == 4 else show(role), "" if by == 1 else re.sub("[.!?]", "", show(text)) if by == 2 else show(text)
            after += [(turn, role, text)] * (2 if by == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(after)
        cost, audit, out = table(after, marks)
        turns = {t for t, *_ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(found, key=str)


def given(rng, convs=150):
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((c if c else None, None if rng.random() < 0.05 else turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut", " \n", "", None, "Why? ", "é."]) if rng.random() < 0.6 else f"t{len(rows)}."))
    return rows + rows[:9]


def test_equals_a_table_of_all_states(spark, tmp_path):
    rows = given(random.Random(4))
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op13_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_audit_is_the_least_of_all_edits():
    """Every string of edits, for short conversations."""
    rng = random.Random(9)
    for _ in range(60):
        rows = [(k, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b.", "", "cut"])) for k in range(rng.randrange(4))]
        marks = faults(rows)
        ways = []
        for n in range(len(rows) + 4):
            for edits in itertools.product("DIKR", repeat=n):
                at, cost, shape = 0, 0, ""
                for e in edits:
                    if e == "I":
                        cost, shape = cost + 5, shape + "?"
                        continue
                    if at == len(rows) or (marks[at] in ("blank", "duplicate") and e != "D"):
                        break
                    cost += {"D": 2, "K": 0, "R": 1}[e] + 5 * (marks[at] == "truncated" and e != "D")
                    shape += {"D": "", "K": rows[at][1][0], "R": "?"}[e]
                    at += 1
                else:
                    if at == len(rows) and any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*("ua" if c == "?" else c for c in shape))):
                        ways.append((cost, "".join(edits)))
        codes = bytes(repair._code(r[1][0], m) for r, m in zip(rows, marks, strict=True))
        assert repair.cheapest(codes) == min(ways)


def test_segments_of_a_long_conversation_give_the_same():
    rng = random.Random(11)
    for n in (7, 40, 300):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b.", "", "cut", f"n{k}.", f"m{k}."])) for k in range(n)]
        marks = faults(rows)
        codes = bytes(repair._code(r[1][0], m) for r, m in zip(rows, marks, strict=True))
        assert repair.cheapest(codes, 3) == repair.cheapest(codes, 10_000) == table(rows, marks)[:2]


def test_long_conversation_with_spooled_texts(spark):
    rng = random.Random(12)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice([".", "?", "", "x"])) for k in range(4000)] + [(2, 0, "user", "y" * 300_000 + "."), (3, 0, None, None)]
    df = spark.createDataFrame(rows, SHAPE).withColumn("lost", repair.F.col("conv_id") == 3)
    whole = sorted(map(tuple, repair.report(df, repair.F.col("lost")).collect()))
    assert whole == sorted(map(tuple, repair.report(df, repair.F.col("lost"), spool=2000).collect()))
    assert whole[2] == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    said = [r for r in repair.repaired(df.where("conv_id = 1")).orderBy("place").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in said)) and [r.place for r in said] == list(range(len(said)))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest() == whole[0][8]


def test_empty_table(spark):
    assert repair.report(spark.createDataFrame([], SHAPE)).collect() == [] and repair.repaired(spark.createDataFrame([], SHAPE)).collect() == []
