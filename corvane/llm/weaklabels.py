"""Quality by weak labels: heuristic labellers, EM over their votes, and a hashed linear scorer.

Each labeller votes good (1), bad (-1) or nothing (0) on measures of the whole text. The
votes of all rows are counted by pattern (at most 3 ** 8), so EM sees the whole corpus in a
table of fixed size. EM estimates for each labeller how often it votes what on good and bad
texts, and the share of good ones. The posterior of a row's pattern is its soft label.

A linear scorer on hashed word forms is then fitted to the soft labels of at most SAMPLE rows
(those of the smallest hash of their key) and scores every row; kept rows have a score of at
least the threshold. A null or empty text gets the votes and the score of a text of no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import linear, shared, textscan

SAMPLE = 8_000
FORM_DIMS, WORD_DIMS = 512, 512
#: Labellers are made so that at most this share of good texts gets a bad vote; it keeps EM's classes apart.
MOST_WRONG = 0.003
_CLASS = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower or non-ASCII, 2 upper, 3 digit, 4 sentence mark, 5 white space
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 4
_CLASS[textscan.SPACES] = 5
LABELLERS = ("capitals", "symbols", "shouting", "bars", "variety", "word_length", "sentences", "digits")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def votes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (rows, labellers), and features (rows, FORM_DIMS + WORD_DIMS): shares of words."""
    rows = len(offsets) - 1
    start, end, bounds = textscan.words(data, offsets, textscan.SPACES)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    kind = _CLASS[data]
    count = [_per_row(kind == k, offsets) for k in range(6)]
    letters, ink = np.maximum(count[1] + count[2], 1), np.maximum(np.diff(offsets) - count[5], 1)
    per = lambda chars: _per_row(np.isin(data, np.frombuffer(chars, np.uint8)), offsets)
    hashes = textscan.word_hashes(data, start, end)
    _, edges = textscan.shingle_sets(hashes, bounds, 1)
    variety = np.diff(edges) / some
    measures = (count[2] / letters, count[0] / ink, per(b"!?") / some, per(b"|") / some, variety, ink / some, per(b".!?") / some, count[3] / ink)
    bad = (0.5, 0.08, 0.4, 0.15, None, None, None, 0.3)
    out = np.zeros((rows, len(LABELLERS)), np.int8)  # a lack of symbols and the like is no sign of quality: no good votes there
    for k, m in enumerate(measures):
        if bad[k] is not None:
            out[m >= bad[k], k] = -1
    out[variety > 0.5 / (1 + n / 3000), 4] = 1
    out[variety < 0.25 / (1 + n / 1000), 4] = -1
    out[(measures[5] < 2) | (measures[5] > 20), 5] = -1
    out[(measures[6] >= 0.02) & (measures[6] <= 0.3), 6] = 1
    out[(n >= 30) & (measures[6] < 0.01), 6] = -1
    out[n == 0] = 0
    out[n == 0, 4] = -1
    # forms of words: class of first and last byte, length, whether all upper
    f = np.zeros((rows, FORM_DIMS + WORD_DIMS), np.float32)
    if len(start):
        row = np.repeat(np.arange(rows), n)
        upper = np.concatenate(([0], np.cumsum(kind == 2)))
        whole = (upper[end] - upper[start]) * 2 > end - start
        form = (kind[start].astype(np.int64) * 6 + kind[end - 1]) * 14 + np.minimum(end - start, 7) * 2 - 2 + whole
        place = np.concatenate([row * f.shape[1] + form % FORM_DIMS, row * f.shape[1] + FORM_DIMS + (hashes >> np.uint64(55)).astype(np.int64) % WORD_DIMS])
        f = np.bincount(place, minlength=f.size)[: f.size].reshape(f.shape).astype(np.float32)
        f /= some[:, None]
    return out, f


class Posterior:
    """Shares of votes on good and bad texts, by EM over counted patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        k = len(LABELLERS)
        # start: bad votes are rare on good texts; good votes say little
        self.good = np.tile([0.02, 0.38, 0.6], (k, 1))
        self.bad = np.tile([0.3, 0.2, 0.5], (k, 1))
        self.share = 0.8
        self.accuracy = np.full(k, 0.7)
        if not len(patterns):
            return
        one = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
        for _ in range(rounds):
            p = self.of(patterns)
            new = []
            for w, old in ((counts * p, self.good), (counts * (1 - p), self.bad)):
                prior = 10 * (np.array([0.02, 0.38, 0.6]) if old is self.good else np.array([0.3, 0.2, 0.5]))
                x = np.einsum("i,ikv->kv", w, one) + prior
                x /= x.sum(1, keepdims=True)
                if old is self.good:
                    over = np.maximum(x[:, 0] - MOST_WRONG, 0)
                    x[:, 0] -= over
                    x[:, 1] += over
                new.append(x)
            share = (np.dot(counts, p) + 8) / (counts.sum() + 10)
            done = max(np.abs(new[0] - self.good).max(), np.abs(new[1] - self.bad).max()) < 1e-9
            (self.good, self.bad), self.share = new, share
            if done:
                break
        right = self.share * self.good[:, 2] + (1 - self.share) * self.bad[:, 0]
        self.accuracy = right / np.maximum(right + self.share * self.good[:, 0] + (1 - self.share) * self.bad[:, 2], 1e-12)

    def of(self, patterns: np.ndarray) -> np.ndarray:
        each = np.arange(len(LABELLERS))
        odds = np.log(self.share / (1 - self.share)) + (np.log(self.good[each, patterns + 1]) - np.log(self.bad[each, patterns + 1])).sum(1)
        return linear.sigmoid(odds)


def _code(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)


def _pattern(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, kept) for each row of docs."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("x"))

    @shared.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in textscan.slices(batch.column(1)):
                seen += np.bincount(_code(votes(data, offsets)[0]), minlength=len(seen))
        some = np.flatnonzero(seen)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["code", "n"])

    counted = sorted(tuple(r) for r in rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n")).collect())
    codes, counts = np.array([c for c, _ in counted], np.int64), np.array([n for _, n in counted], np.float64)
    model = Posterior(_pattern(codes), counts)

    @shared.lean
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textscan.slices(batch.column(1)):
                v, f = votes(data, offsets)
                p = model.of(v)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([r.astype("<f2").tobytes() for r in f], pa.binary())], ["p", "f"])

    # keys of the smallest hash first, so that the texts of a bounded number of rows are read
    ids = F.broadcast(rows.select("k").where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(sample).withColumnRenamed("k", "chosen"))
    some = rows.join(ids, F.col("k") == F.col("chosen"), "left_semi").mapInArrow(examples, "p double, f binary")
    got = some.orderBy("p", "f").limit(sample).collect()
    x = np.stack([np.frombuffer(r.f, "<f2") for r in got]).astype(np.float32) if got else np.zeros((0, FORM_DIMS + WORD_DIMS), np.float32)
    weights, intercept = linear.fit_logistic(x * 10, np.array([r.p for r in got]), ridge=0.1, rounds=200)

    @shared.lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in textscan.slices(batch.column(1)):
                v, f = votes(data, offsets)
                s = linear.sigmoid(f.astype(np.float64) @ weights * 10 + intercept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(model.of(v)), pa.array(s), pa.array(s >= threshold)], ["doc_id", "posterior", "score", "kept"])

    return rows.mapInArrow(judge, "doc_id long, posterior double, score double, kept boolean")
