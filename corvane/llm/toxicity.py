"""Toxicity by a classifier chain over hashed linear models.

Categories are predicted one after another; the log odds of earlier categories are features
of later ones. In training they come from models that have not seen the row (out of fold).

Features are presences in a text: words (A-Z lower-cased, runs of digits, a-z and non-ASCII)
and their beginnings of 3 to 7 bytes, hashed to 2 ** HASH_BITS numbers. For each category the
FEATURES numbers that are the clearest signs of it are used. A fold's predictions come from
models that have seen none of its rows, in choosing features neither.

Models are fitted on at most SAMPLE labelled rows, those of the smallest hash of their key.
Scoring covers all rows and whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import linear, shared, textscan

HASH_BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7)
FEATURES = 384
SAMPLE = 20_000
FOLDS = 3
LEAST_SEEN = 4
#: Rows of which the driver holds a matrix at a time.
HELD = 2048
#: Used features are signs of the category: this far beyond chance, and this many times as common in it.
LEAST_Z, LIFT = 4.5, 3
#: Further columns of labels that categories may use.
LABEL_COLUMNS: tuple[str, ...] = ()
#: Fixed words that split labelled toxic texts into weak categories.
INSULT = ("clown", "dumb", "fool", "idiot", "loser", "moron", "stupid")
CONTEMPT = ("disgusting", "filth", "garbage", "pathetic", "scum", "trash", "worthless")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of each word and beginning; a pair may come repeatedly."""
    start, end, bounds = textscan.words(data, offsets, textscan.NOT_ALNUM)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows, numbers = [row], [textscan.word_hashes(data, start, end) >> np.uint64(64 - HASH_BITS)]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        rows.append(row[long])
        h = textscan.word_hashes(data, start[long], start[long] + k)
        numbers.append(textscan.mix64(h + np.uint64(k)) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(rows), np.concatenate(numbers).astype(np.int64)


def _distinct(row: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * width + number)
    return key // width, key % width


class Chain:
    """Fitted models: for each category its feature numbers, weights, intercept and weights of earlier log odds."""

    def __init__(self, names: list[str]):
        self.names = names
        self.numbers: list[np.ndarray] = []
        self.weights: list[tuple[np.ndarray, np.ndarray, float]] = []

    def table(self) -> tuple[np.ndarray, int]:
        """Place of each feature number among all models' features, or -1."""
        used = np.unique(np.concatenate(self.numbers)) if self.numbers else np.zeros(0, np.int64)
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        return place, len(used)

    def logits(self, n: int, row: np.ndarray, place_of: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Log odds (rows, categories) from distinct (row, place) pairs."""
        out = np.zeros((n, len(self.names)))
        for k, (own, earlier, intercept) in enumerate(self.weights):
            w = np.zeros(size)
            w[place[self.numbers[k]]] = own
            out[:, k] = intercept + np.bincount(row, weights=w[place_of], minlength=n)[:n] + out[:, :k] @ earlier
        return out


class _Presences:
    """Which features each of many rows has, as lists of places; matrices are made for a few rows at a time."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = [chunk.to_numpy(zero_copy_only=False) for chunk in lists.chunks]
        values = [v for chunk in lists for v in chunk]
        self.places = np.frombuffer(b"".join(values), "<u2")
        self.ends = np.concatenate([[0], np.cumsum([len(v) // 2 for v in values], dtype=np.int64)])

    def block(self, rows: np.ndarray, use: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Columns of the rows: presences at the places in use, those rows of more, and ones."""
        column = np.full(1 << 16, -1, np.int32)
        column[use] = np.arange(len(use))
        start, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        to, row = column[self.places[at]], np.repeat(np.arange(len(rows)), size)
        out = np.zeros((len(rows), len(use) + more.shape[1] + 1), np.float32)
        out[row[to >= 0], to[to >= 0]] = 1
        out[:, len(use) : -1] = more[rows]
        out[:, -1] = 1
        return out


def _sample(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], key: str, text: str, sample: int) -> DataFrame:
    """(key, text, one 0/1 column per category) of labelled rows; of rows with one key the largest text and label count."""
    used = [c for c in labels.columns if c != key and c in ("quality", "toxic", *LABEL_COLUMNS)]
    given = labels.groupBy(key).agg(*[F.max(c).alias(c) for c in used]).where(F.col(key).isNotNull()).withColumnRenamed(key, "labelled_key")
    chosen = given.orderBy(F.xxhash64("labelled_key"), "labelled_key").limit(sample)
    # at most `sample` rows of a few numbers: small enough to send to all
    x = docs.select(F.col(key).alias("document_key"), F.col(text).cast("string").alias("document_text")).join(F.broadcast(chosen), F.col("document_key") == F.col("labelled_key"))
    x = x.groupBy("document_key", *[c for c in given.columns if c != "labelled_key"]).agg(F.max("document_text").alias("document_text"))
    return x.select("document_key", "document_text", *[F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories.values())])


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit the chain. Categories are 0/1 columns over the labels' columns and document_text, in chain order."""
    names = list(categories)
    k = len(names)
    rows = shared.settle(_sample(docs, labels, categories, key, text, sample), "labelled")

    rows = rows.withColumn("fold", F.pmod(F.xxhash64("document_key", F.lit(1)), F.lit(FOLDS)).cast("int"))

    @shared.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FOLDS, k + 1, 1 << HASH_BITS), np.int32)
        for batch in batches:
            y, folds = np.stack([batch.column(2 + c).to_numpy() for c in range(k)]), batch.column(2 + k).to_numpy()
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                row, number = _distinct(*_features(data, offsets), 1 << HASH_BITS)
                fold = folds[at:end][row]
                for f in range(FOLDS):
                    r, x = row[fold == f], number[fold == f]
                    seen[f, k] += np.bincount(x, minlength=1 << HASH_BITS).astype(np.int32)
                    for c in range(k):
                        seen[f, c] += np.bincount(x[y[c, at:end][r] == 1], minlength=1 << HASH_BITS).astype(np.int32)
        for f in range(FOLDS):
            some = np.flatnonzero(seen[f, k])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), f, np.int32)), *(pa.array(s[some].astype(np.int64)) for s in seen[f])], ["f", "fold", *(f"a{c}" for c in range(k)), "n"])

    labelled = {r[0]: r[1:] for r in rows.groupBy("fold").agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"y{c}"), F.lit(0)) for c in range(k)]).collect()}
    whole = FOLDS  # the last choice leaves no fold out
    totals = [np.sum([v for f, v in labelled.items() if f != out] or [[0] * (k + 1)], axis=0).tolist() for out in range(FOLDS + 1)]
    counts = rows.mapInArrow(count, "f long, fold int, " + ", ".join(f"a{c} long" for c in range(k)) + ", n long")
    counts = counts.groupBy("f", "fold").agg(F.sum("n").alias("n"), *[F.sum(f"a{c}").alias(f"a{c}") for c in range(k)])
    # each count goes to all choices but that which leaves its fold out
    choices = F.filter(F.array(*[F.lit(o) for o in range(FOLDS + 1)]), lambda o: o != F.col("fold"))
    counts = counts.withColumn("out", F.explode(choices)).groupBy("f", "out").agg(F.sum("n").alias("n"), *[F.sum(f"a{c}").alias(f"a{c}") for c in range(k)])
    signs = []
    for c in range(k):
        of = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("out") + 1)
        n, pos, neg = of([t[0] for t in totals]), of([max(t[1 + c], 1) for t in totals]), of([max(t[0] - t[1 + c], 1) for t in totals])
        a, b = F.col(f"a{c}"), F.col("n") - F.col(f"a{c}")
        z = (a / pos - b / neg) / F.sqrt(F.greatest(F.col("n") / F.greatest(n, F.lit(1.0)) * (1 - F.col("n") / (n + 1)), F.lit(1e-12)) * (1 / pos + 1 / neg))
        signs.append(F.when((F.col("n") >= LEAST_SEEN) & (z >= LEAST_Z) & (a * neg >= LIFT * b * pos), F.struct(F.lit(c).alias("c"), z.alias("z"))))
    signs = counts.select("f", "out", F.inline(F.array_compact(F.array(*signs))))
    best = Window.partitionBy("out", "c").orderBy(F.col("z").desc(), "f")
    chosen: dict[tuple[int, int], list[int]] = {}
    for r in signs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FEATURES).select("out", "c", "f").collect():
        chosen.setdefault((r.out, r.c), []).append(r.f)
    numbers = {(out, c): np.array(sorted(chosen.get((out, c), [])), np.int64) for out in range(FOLDS + 1) for c in range(k)}
    chain = Chain(names)
    chain.numbers = list(numbers.values())
    place, size = chain.table()  # of the features of all choices
    chain.numbers = [numbers[whole, c] for c in range(k)]

    @shared.lean
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                row, number = _features(data, offsets)
                p = place[number]
                row, p = _distinct(row[p >= 0], p[p >= 0].astype(np.int64), max(size, 1))
                cut = np.searchsorted(row, np.arange(end - at + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at).cast(pa.int64()), pa.array([p[cut[i] : cut[i + 1]].astype("<u2").tobytes() for i in range(end - at)], pa.binary()), *(batch.column(2 + c).slice(at, end - at).cast(pa.int32()) for c in range(k + 1))],
                    ["document_key", "p", *(f"y{c}" for c in range(k)), "fold"],
                )

    picked = rows.mapInArrow(pick, "document_key long, p binary, " + ", ".join(f"y{c} int" for c in range(k)) + ", fold int").orderBy("document_key").toArrow()
    x = _Presences(picked.column("p"))
    y = np.array([picked.column(f"y{c}").to_numpy() for c in range(k)], np.float64).reshape(k, len(picked)).T
    fold = picked.column("fold").to_numpy().astype(np.int64)
    held_out = np.zeros((len(picked), k))
    for c in range(k):
        earlier = held_out[:, :c]

        def model(use: np.ndarray, those: np.ndarray, truth: np.ndarray, earlier: np.ndarray = earlier) -> tuple[np.ndarray, float]:
            return linear.fit_blocks(lambda a, b: x.block(those[a:b], place[use], earlier), len(use) + earlier.shape[1], truth[those], size=HELD)

        for f in range(FOLDS):
            w, b = model(numbers[f, c], np.flatnonzero(fold != f), y[:, c])
            out = np.flatnonzero(fold == f)
            for at in range(0, len(out), HELD):
                some = out[at : at + HELD]
                held_out[some, c] = x.block(some, place[numbers[f, c]], earlier)[:, :-1] @ w + b
        own = len(chain.numbers[c])
        w, b = model(chain.numbers[c], np.arange(len(picked)), y[:, c])
        chain.weights.append((w[:own], w[own:], b))
    chain.held_out, chain.truth = held_out, y
    return chain


def _judge(chain: Chain, names: list[str]):
    place, size = chain.table()
    model = Chain(chain.names)
    model.numbers, model.weights = chain.numbers, chain.weights

    @shared.lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                row, number = _features(data, offsets)
                p = place[number]
                row, p = _distinct(row[p >= 0], p[p >= 0].astype(np.int64), max(size, 1))
                logits = model.logits(end - at, row, p, place, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *(pa.array(linear.sigmoid(c)) for c in logits.T)], names)

    return judge, ", ".join([f"{shared.quoted(names[0])} long", *(f"{shared.quoted(c)} double" for c in names[1:])])


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category>...) for each row; a null or empty text has the probabilities of no feature."""
    judge, shape = _judge(chain, [key, *(f"p_{c}" for c in chain.names)])
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("x"))
    return rows.mapInArrow(judge, shape)


def scored(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with a column of each category's probability, and these columns' names."""
    judge, shape = _judge(chain, [key, *(f"p_{c}" for c in chain.names)])
    return shared.carry(docs, [(key, "long"), (text, "string")], judge, shape, drop=1)


def categories() -> dict[str, Column]:
    """Chain order of the tables at hand: two weak categories of labelled toxic texts, then the label itself."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    says = lambda words: F.lower("document_text").rlike(r"\b(" + "|".join(words) + r")\b")
    return {"insult": toxic & says(INSULT), "contempt": toxic & says(CONTEMPT), "toxic": toxic}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_insult, p_contempt, p_toxic, toxic) for each row of docs."""
    chain = fit(docs, labels, categories(), sample=sample)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= threshold)
