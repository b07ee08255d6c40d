"""Credentials in texts: single secrets, and parts that make one only together.

Base spans count alone: assigned secrets, access identifiers, long hexadecimal runs. Weak spans (bare mixed keys, logins,
addresses, endpoints) are reported only if what complements them stands in the same paragraph within REACH code points:
a key needs an identifier, a login or address needs a secret, an endpoint needs both.

A text is scanned by regular expressions, a batch at a time; what it holds goes to a settled table, without the text.
The interval join runs on that table: spans are dealt into bins of REACH code points, a bin's first and last start of each role
are all that its own and the two next bins need, and so each weak span meets one row, however many spans a text has.

Null and empty texts have no spans. Rows that repeat an id are each answered.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared

#: The base kinds, in the order of reports, and their patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The least number of characters (of the second group where there is one).
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEY = r"[A-Za-z0-9+/_-]{32,}={0,2}"
LOGIN = r"""(user|username|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
ENDPOINT = r"""[a-z][a-z0-9+]{1,15}://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "key", "login", "address", "endpoint")
BASE = 3
ROLES = {"secret": ("assign", "hex", "key"), "identifier": ("access", "login", "address")}
NEEDS = {"key": ("identifier",), "login": ("secret",), "address": ("secret",), "endpoint": ("identifier", "secret")}
REACH = 400

_folded = re.IGNORECASE | re.ASCII
# runs start where they begin, so that no pattern looks at a long run more than a few times
_LOOK = (
    re.compile(ASSIGN, _folded),
    re.compile(r"AKIA[A-Z0-9]{16,}"),
    re.compile(r"[0-9a-f]{24,}"),
    re.compile(r"(?<![A-Za-z0-9+/_-])" + KEY),
    re.compile(LOGIN, _folded),
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"(?<![A-Za-z0-9+])" + ENDPOINT),
)
_GAP = re.compile(r"\n[ \t\r]*\n")
_MIXED = tuple(re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int32())])


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, base ones and weak candidates, in order."""
    found = []
    for kind, look in enumerate(_LOOK[:BASE]):
        found += [(m.start(), kind, m.end()) for m in look.finditer(text) if kind or len(m[2]) >= LEAST["assign"]]
    taken, at = sorted((a, b) for a, _, b in found), 0
    for kind in range(BASE, len(KINDS)):
        for m in _LOOK[kind].finditer(text):
            a, b = m.span()
            if KINDS[kind] == "key":
                if not all(x.search(text, a, b) for x in _MIXED):
                    continue
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                if any(x < b and y > a for x, y in taken[at : at + BASE]):
                    continue
            found.append((a, kind, b))
    return sorted(found)


@shared.lean
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column(2).to_pylist():
            found = scan(text or "")
            gaps = [m.end() for m in _GAP.finditer(text)] if found else []
            scope, rows = 0, []
            for a, kind, b in found:
                while scope < len(gaps) and gaps[scope] <= a:
                    scope += 1
                rows.append({"start": a, "kind": kind, "end": b, "scope": scope})
            spans.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))], ["row", "id", "spans"])


def _is(kind: Column, names: tuple[str, ...]) -> Column:
    return kind.isin(*[KINDS.index(n) for n in names])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, spans, linked): a row for each row of docs; base spans and linked weak ones as (start, kind, end) by start, then kind as in KINDS."""
    of = docs.select(F.monotonically_increasing_id().alias("row"), F.col(shared.quoted(key)).alias("id"), F.col(shared.quoted(text)).cast("string").alias("text"))
    kind = of.schema["id"].dataType.simpleString()
    pieces = shared.settle(of.mapInArrow(_scanned, f"row long, id {kind}, spans array<struct<start: long, kind: int, end: long, scope: int>>"), "spans")
    weak = F.exists("spans", lambda s: s.kind >= BASE)
    spans = pieces.where(weak).select("row", F.explode("spans").alias("s")).select("row", "s.*", F.floor(F.col("s.start") / reach).alias("bin"))
    # the first and last start of each role in a bin, as seen by that bin and by its neighbours
    starts = [F.when(_is(F.col("kind"), kinds), F.col("start")).alias(role) for role, kinds in ROLES.items()]
    bins = spans.select("row", "scope", "bin", *starts).groupBy("row", "scope", "bin").agg(*[f(r).alias(f"{n}_{r}") for r in ROLES for n, f in (("first", F.min), ("last", F.max))])
    seen = bins.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("bin", F.col("bin") + F.col("step"))
    side = lambda step, c: F.max(F.when(F.col("step") == step, F.col(c)))
    seen = seen.groupBy("row", "scope", "bin").agg(*[x.alias(f"{n}_{r}") for r in ROLES for n, x in (("before", side(1, f"last_{r}")), ("own", side(0, f"last_{r}")), ("after", side(-1, f"first_{r}")))])
    within = lambda r: F.coalesce(F.col(f"before_{r}") >= F.col("start") - reach, F.lit(False)) | F.coalesce(F.col(f"after_{r}") <= F.col("start") + reach, F.lit(False))
    near = {r: F.col(f"own_{r}").isNotNull() | within(r) for r in ROLES}
    complete = F.lit(False)
    for name, roles in NEEDS.items():
        complete = complete | (_is(F.col("kind"), (name,)) & functools.reduce(operator.and_, (near[r] for r in roles)))
    linked = spans.where(F.col("kind") >= BASE).join(seen, ["row", "scope", "bin"]).where(complete).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    names = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter("spans", lambda s: s.kind < BASE), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    named = lambda x: F.transform(F.array_sort(x), lambda s: F.struct(s.start.alias("start"), F.get(names, s.kind).alias("kind"), s.end.alias("end")))
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    x = pieces.withColumn("base", base).join(linked, "row", "left").withColumn("linked", F.coalesce("linked", none))
    return x.select(F.col("id").alias(key), named(F.col("base")).alias("spans"), named(F.col("linked")).alias("linked"), named(F.concat("base", "linked")).alias("all_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
