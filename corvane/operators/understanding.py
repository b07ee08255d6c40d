"""Requests in batch: phrases found by their first two words and then by all, context gates, requirement tiers, reserved short forms, expanded texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.settled import settle

#: Words around a mention that tell how much it is wanted.
REQUIRED_WORDS = ("including", "include", "containing", "contains", "require", "required")
PREFERRED_WORDS = ("by", "per", "where")
DOWNGRADE_WORDS = ("about", "like", "maybe", "ideally", "prefer", "preferably", "optionally", "any")
DOWNGRADE_PHRASES = ("related to", "such as", "similar to", "if possible")
GROUPING_PHRASES = ("grouped by", "broken down by", "split by", "for each", "filtered by")
REQUEST_WORDS = ("with", "show", "showing", "need", "needs")
BOUNDARIES = ("but", "then", "also")
MOST_REQUIRED = 4
#: Phrases of a lexicon that each task may hold.
BOOK = 100_000
#: Reserved short forms, what they stand for, and those that hold in any case.
RESERVED = {
    "TA": ("Time Away", "topic"),
    "HC": ("Headcount", "field"),
    "FTE": ("FTE", "topic"),
    "OOO": ("Out of Office", "topic"),
    "PTO": ("Time Off", "topic"),
    "LOA": ("Leave of Absence", "topic"),
    "FMLA": ("Leave of Absence", "topic"),
    "YTD": ("Year to Date", "topic"),
    "EEO": ("Equal Employment Opportunity", "topic"),
    "HRIS": ("HR Information System", "topic"),
    "LMS": ("Learning Management System", "topic"),
    "ATS": ("Applicant Tracking System", "topic"),
    "BU": ("Business Unit", "topic"),
    "CC": ("Cost Center", "topic"),
}
ANY_CASE = ("HC", "FTE", "OOO", "PTO")
TA_RECRUITING = ("partner", "recruiter", "talent", "acquisition")
TA_AWAY = ("away", "leave", "absence", "time", "pto")


def variants(word: Column) -> Column:
    """Forms of a word that a phrase may hold: itself, its singular, and with an s where it has more than three letters."""
    return variants_of(word, T.singular(word))


def variants_of(word: Column, singular: Column) -> Column:
    more = F.when(F.length(word) > 3, F.array(F.concat(word, F.lit("s")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word, singular), more))


def find_phrases(requests: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, start, end, phrase, …, morphological): every occurrence of every phrase, nested ones too.

    requests: (query_id, words); phrases: (phrase, words, …). An equi-join on the forms of the first two words (of one, where a
    phrase has no more), then all words are compared in place, so work is that of occurrences of pairs of words, not of requests
    times phrases; the forms of a request's words are made once. A lexicon of up to BOOK phrases goes to every task, so that no
    common word is one task's; a larger one is met by a shuffle. A phrase without words occurs nowhere. Rows repeat as phrases do.
    """
    spark = requests.sparkSession
    book = settle(phrases.where(F.size("words") > 0).withColumnRenamed("words", "p").withColumns({"first": F.col("p")[0], "second": F.coalesce(F.get("p", F.lit(1)), F.lit(""))}))
    if book.count() <= BOOK:
        book = F.broadcast(book)
    # a column of its own by a shuffle, since a short file is one task's and forms take most of the time
    spread = requests.select("query_id", "words").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    # spelled out over the array, so that each word is folded once
    folded = F.transform("words", lambda w: F.struct(w.alias("w"), T.fold(w).alias("v")))
    forms = F.transform(folded, lambda s: variants_of(s["w"], T.singular_of(s["v"])))
    at = spread.select("query_id", "words", forms.alias("forms"))
    at = at.select("query_id", "words", "forms", F.posexplode("forms").alias("start", "f"))
    seconds = F.concat(F.array(F.lit("")), F.coalesce(F.get("forms", F.col("start") + 1), F.array().cast("array<string>")))
    at = at.withColumn("first", F.explode("f")).withColumn("second", F.explode(F.array_distinct(seconds))).drop("f")
    x = at.join(book, ["first", "second"]).where(F.col("start") + F.size("p") <= F.size("words"))
    fits = F.forall(F.zip_with(F.slice("forms", F.col("start") + 1, F.size("p")), "p", lambda f, p: F.array_contains(f, p)), lambda v: v)
    same = F.slice("words", F.col("start") + 1, F.size("p")) == F.col("p")
    return x.where(fits).select("query_id", "start", (F.col("start") + F.size("p")).alias("end"), (~same).alias("morphological"), *[c for c in phrases.columns if c != "words"])


def context_holds(words: Column, start: Column, end: Column, window: Column, any_of: Column, none_of: Column) -> Column:
    """Whether the text of a span and so many words around it (all where the window is 0) has one of any_of and none of none_of, as substrings; empty lists ask nothing."""
    n = F.size(words)
    reach = F.when(F.coalesce(window, F.lit(0)) == 0, n).otherwise(window)
    low, high = F.greatest(F.lit(0), start - reach), F.least(n, end + reach)
    text = F.array_join(F.slice(words, low + 1, high - low), " ")
    has = lambda terms: F.exists(terms, lambda t: F.contains(text, t))
    return ((F.size(any_of) == 0) | has(any_of)) & ((F.size(none_of) == 0) | ~has(none_of))


def _after(words: Column, mark: str) -> Column:
    at = F.array_position(words, mark).cast("int")
    return F.when(at > 0, F.slice(words, at + 1, F.size(words))).otherwise(words)


def _before(words: Column, mark: str) -> Column:
    at = F.array_position(words, mark).cast("int")
    return F.when(at > 0, F.slice(words, F.lit(1), at - 1)).otherwise(words)


def _last(words: Column, k: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - k, F.lit(0)) + 1, F.lit(k))


def requirement(x: DataFrame) -> DataFrame:
    """x (words, start, end, kind, origin, confidence, …) with tier: REQUIRED, PREFERRED or MENTIONED, from the words around each mention.

    Eight words before and three after, cut at boundary words; words that play a mention down win over all others. A field's own
    name is required; other fields need a rule, confidence of 0.88 and request words. Guessed spellings and confidence under
    0.8 are at most preferred.
    """
    low = F.greatest(F.lit(0), F.col("start") - 8)
    left, right = F.slice("words", low + 1, F.col("start") - low), F.slice("words", F.col("end") + 1, F.lit(3))
    for mark in BOUNDARIES:
        left, right = _after(left, mark), _before(right, mark)
    y = x.withColumn("_left", left).withColumn("_right", right)
    y = y.withColumn("_near", F.concat(_last(F.col("_left"), 4), F.slice("_right", 1, 2))).withColumn("_phrase", F.array_join(_last(F.col("_left"), 4), " "))
    among = lambda words, marks: F.arrays_overlap(words, F.array(*map(F.lit, marks)))
    ends = lambda marks: F.col("_phrase").rlike("(" + "|".join(marks) + ")$")
    down = among(F.col("_near"), DOWNGRADE_WORDS) | F.col("_phrase").rlike("|".join(DOWNGRADE_PHRASES))
    asked = F.coalesce(F.try_element_at("_left", F.lit(-1)).isin(*REQUEST_WORDS), F.lit(False))
    field = F.col("kind") == "field"
    literal = field & (F.col("origin") == "literal") & (F.col("confidence") == 1.0)
    by_rule = field & (F.col("origin") == "phrase_rule") & (F.col("confidence") >= 0.88) & (among(F.col("_left"), REQUIRED_WORDS) | ends(("must have",)) | asked)
    preferred = among(F.col("_near"), PREFERRED_WORDS) | ends(GROUPING_PHRASES)
    showing = F.coalesce(F.get("words", F.col("start") - 1) == "showing", F.lit(False)) & (F.col("start") > 0)
    needed = literal | by_rule | (~preferred & showing)
    soft = F.col("origin").isin("typo", "morphological") | (F.col("confidence") < 0.8)
    tier = F.when(down, "MENTIONED").when(needed & ~soft, "REQUIRED").when(needed | preferred, "PREFERRED").otherwise("MENTIONED")
    return y.withColumn("tier", tier).drop("_left", "_right", "_near", "_phrase")


def limit_required(x: DataFrame, most: int = MOST_REQUIRED) -> DataFrame:
    """At most so many required mentions a request: the least confident, then the latest, then the first by name become preferred."""
    w = Window.partitionBy("query_id", "tier").orderBy(F.col("confidence").desc(), "start", F.lower("canonical").desc())
    return x.withColumn("_r", F.row_number().over(w)).withColumn("tier", F.when((F.col("tier") == "REQUIRED") & (F.col("_r") > most), "PREFERRED").otherwise(F.col("tier"))).drop("_r")


def expanded_text(requests: DataFrame, concepts: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, text, expanded): the request, then each confident concept that it doesn't name already, best first.

    concepts: (query_id, kind, canonical, confidence); a concept is a kind and a folded name, with its best confidence.
    """
    best = concepts.groupBy("query_id", "kind", F.lower("canonical").alias("folded")).agg(F.max("confidence").alias("confidence"), F.min("canonical").alias("canonical")).where(F.col("confidence") >= least)
    names = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "kind", "folded", "canonical"))).alias("found"))
    x = requests.join(names, "query_id", "left")
    base = T.phrase(F.col("text"))
    new = F.array_distinct(F.transform(F.filter(F.coalesce("found", F.array().cast("array<struct<c:double,kind:string,folded:string,canonical:string>>")), lambda s: ~F.contains(base, T.phrase(s["canonical"]))), lambda s: s["canonical"]))
    return x.select("query_id", "text", F.concat_ws(" ", "text", F.when(F.size(new) > 0, F.array_join(new, " "))).alias("expanded"))


def short_form(surface: Column, context: Column) -> Column:
    """Struct (canonical, kind) of a reserved short form, else null. Most hold in capitals only; TA depends on the words around it."""
    upper = F.upper(surface)
    meaning = lambda name, kind: F.struct(F.lit(name).alias("canonical"), F.lit(kind).alias("kind"))
    near = lambda words: F.arrays_overlap(context, F.array(*map(F.lit, words)))
    out = F.when((upper == "TA") & near(TA_RECRUITING), meaning("Recruiter", "field")).when((upper == "TA") & near(TA_AWAY), meaning("Time Away", "topic"))
    for form, (name, kind) in RESERVED.items():
        fits = (upper == form) if form in ANY_CASE else (surface == form)
        out = out.when(fits, meaning(name, kind))
    return out


def lexicon_faults(rules: DataFrame, kinds: tuple[str, ...]) -> list[str]:
    """Faults of a lexicon (id, kind, phrase, canonical, priority, suppresses): unknown kinds, phrases whose rules of one priority suppress different things, cycles.

    A lexicon is written by hand and fits on the driver.
    """
    rows = [r.asDict() for r in rules.collect()]
    faults = [f"unknown kind {r['kind']} in {r['id']}" for r in rows if r["kind"] not in kinds]
    targets: dict[tuple, set] = {}
    after: dict[str, set] = {}
    for r in rows:
        wanted = frozenset(s.lower() for s in r["suppresses"])
        targets.setdefault((r["phrase"].lower(), r["priority"]), set()).add(wanted)
        after.setdefault(r["canonical"].lower(), set()).update(wanted)
    faults += [f"conflicting suppressions of {p} at priority {k}" for (p, k), t in targets.items() if len(t) > 1]
    # peel off names that suppress nothing left; whatever stays is on or before a cycle
    left = {k: set(v) for k, v in after.items() if v}
    while done := [k for k, v in left.items() if not v & left.keys()]:
        for k in done:
            del left[k]
    return faults + ([f"suppression cycle among {sorted(left)}"] if left else [])
