"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a blank cell, after lower-casing.
BLANKS = ("", "nan", "none", "nat", "null", "n/a")
SEPARATOR = " | "


def fold(x: Column) -> Column:
    """Lower case with the sharp s spelled out."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def split_list_cell(x: Column) -> Column:
    """Items of a ;-separated cell, trimmed, empty ones dropped, repeated ones kept; blank cells have none."""
    items = F.filter(F.transform(F.split(x, ";"), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(x.isNull() | F.lower(F.trim(x)).isin("", "nan", "none"), F.array().cast("array<string>")).otherwise(items)


def split_multi(x: Column) -> Column:
    """Items cut at ; and line ends, first spelling of each kept, in order."""
    items = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[;\r\n]+"), lambda v: F.trim(v)), lambda v: v != "")
    return F.filter(items, lambda v, i: F.array_position(F.transform(items, match_key), match_key(v)) == i + 1)


def match_key(x: Column) -> Column:
    """Key of a title or field: dashes alike, one space, folded case."""
    return fold(F.trim(F.regexp_replace(F.translate(x, "–—‑−", "----"), r"\s+", " ")))


def display(x: Column) -> Column:
    """A cell's text, blank spellings and null as an empty string."""
    v = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(v).isin(*BLANKS), "").otherwise(v)


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def singular(x: Column) -> Column:
    """English plural endings taken off a word of more than three letters."""
    return singular_of(fold(x))


def singular_of(v: Column) -> Column:
    """The same for a word that is folded already."""
    n = F.length(v)
    cut = lambda k: F.left(v, n - k)
    out = F.when(n <= 3, v).when(v.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
    for end in ("ches", "shes", "ses", "xes", "zes"):
        out = out.when(v.endswith(end) & (n > len(end) + 2), cut(len(end)))
    return out.when(v.endswith("s") & ~v.rlike("(ss|us|is)$"), cut(1)).otherwise(v)


def phrase(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def words_of(phrase: Column) -> Column:
    """The tokens that `phrase` joined."""
    return F.when(phrase == "", F.array().cast("array<string>")).otherwise(F.split(phrase, " "))


def content_tokens(x: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens(x), lambda t: (F.length(t) > 2) & ~t.isin(*stop))


def labelled(parts: list[tuple[str, Column]], separator: str = SEPARATOR) -> Column:
    """`Label: value` parts, empty ones dropped."""
    return F.concat_ws(separator, *[F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts])


def cut_at_separator(x: Column, most: int, separator: str = SEPARATOR) -> Column:
    """At most so many characters, cut before the last separator where there is one."""
    head = F.left(x, F.lit(most))
    at = F.locate(separator[::-1], F.reverse(head))
    return F.when(F.length(x) <= most, x).when(at > 0, F.left(head, F.length(head) - at - len(separator) + 1)).otherwise(head)


def content_hash(*parts: Column) -> Column:
    """16 hexadecimal digits of SHA-256 over the parts, each ended by a unit separator."""
    return F.left(F.sha2(F.concat(*[F.concat(p, F.lit("\x1f")) for p in parts]), 256), F.lit(16))


def bag_hash(digests: Column) -> Column:
    """An aggregate: a hash of a group's hexadecimal digests that doesn't depend on their order, from sums of their 32-bit parts and their number."""
    part = lambda i: F.conv(F.substring(digests, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(",", *sums, F.count(digests).cast("string")), 256)


def suitability_tokens(x: Column) -> Column:
    """Words of more than two letters, slashes and dashes as spaces, edge punctuation off."""
    words = F.split(F.translate(fold(x), "/-", "  "), r"\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[,;:()]+|[,;:()]+$", "")), lambda w: F.length(w) > 2)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def overlap(query: Column, b: Column) -> Column:
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, b)) / n).otherwise(0.0)


def hash_split(seed: str, key: Column) -> Column:
    """train 70, validation 15, test 15 of 100 by SHA-256 of seed:key."""
    v = F.conv(F.left(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), F.lit(8)), 16, 10).cast("long") % 100
    return F.when(v < 70, "train").when(v < 85, "validation").otherwise("test")


def normalized(v: Column) -> Column:
    """A vector of length one; zero vectors stay."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def normalize_header(x: Column) -> Column:
    """A column header for alias resolution: every run of other characters than ASCII letters and digits is one space, lower case; blanks are empty."""
    return F.when(F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*BLANKS), "").otherwise(F.lower(F.trim(F.regexp_replace(x, "[^0-9a-zA-Z]+", " "))))


def humanize(x: Column) -> Column:
    """A field's name as said aloud: underscores as spaces, one space, folded case."""
    return fold(F.trim(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "_", " "), r"\s+", " ")))


def spans(x: Column) -> Column:
    """Words of letters and digits of any script: array of (surface, word, start, end), counted in characters.

    Offsets come from the texts between words, so no pattern is matched twice; null and wordless texts give an empty array.
    """
    text = F.coalesce(x, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)
    before = F.split(text, r"[\p{L}\p{N}]+", -1)
    empty = F.array().cast("array<struct<surface:string,word:string,start:int,end:int>>")

    def add(done: Column, pair: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1)["end"]).otherwise(0)
        start = (last + F.length(pair["gap"])).cast("int")
        return F.concat(done, F.array(F.struct(pair["w"].alias("surface"), fold(pair["w"]).alias("word"), start.alias("start"), (start + F.length(pair["w"])).cast("int").alias("end"))))

    pairs = F.zip_with(words, F.slice(before, F.lit(1), F.size(words)), lambda w, gap: F.struct(w.alias("w"), gap.alias("gap")))
    return F.aggregate(pairs, empty, add)


def cell_items(x: Column) -> Column:
    """Items of a cell as a search view takes them: blank spellings have none, empty items are dropped."""
    return F.when(display(x) == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(display(x), ";"), lambda v: F.trim(v)), lambda v: v != ""))


def joined_once(parts: Column, separator: str = " ") -> Column:
    """Non-empty values, each once, in their order."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda v: v.isNotNull() & (v != ""))), separator)


def embedding_text(parts: list[tuple[str, Column]]) -> Column:
    """`Label: value` lines, empty values left out."""
    return labelled(parts, "\n")
