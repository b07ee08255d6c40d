"""Benchmark decontamination by suffix arrays over the words of training shards.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is a run
of `width` words of a benchmark item; an item of fewer words, but not none, is one window.

Each task turns its documents into shards, sorts the suffixes of a shard that could hold a
match (they start in a run of benchmark words as long as the shortest window) and looks up
every benchmark suffix by binary search. That gives the longest verbatim match of each
benchmark suffix with its place, and all places of each window. Documents are not shuffled.

The benchmark goes to the tasks as files in the shared folder, each of at most CHUNK_BYTES
of text; a task holds one at a time, so its size isn't bounded by memory.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared, textscan

CHUNK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_hit long, items array<string>"
MATCH = "item_id string, item_word long, words long, doc_id long, doc_word long"


class Items:
    """A chunk of benchmark items: word numbers of all items, each item ended by -1."""

    def __init__(self, vocabulary: np.ndarray, text: np.ndarray, ids: list[str | None], bounds: np.ndarray, width: int):
        self.vocabulary, self.text, self.ids, self.bounds = vocabulary, text, ids, bounds
        length = np.diff(bounds) - 1
        start, size, item = [], [], []
        for k in np.flatnonzero(length > 0):
            n = max(1, int(length[k]) - width + 1)
            start.append(bounds[k] + np.arange(n))
            size.append(np.full(n, min(width, int(length[k]))))
            item.append(np.full(n, k))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.start, self.size, self.item = join(start), join(size), join(item)
        self.least = int(self.size.min()) if len(self.size) else 1
        self.longest = int(length.max(initial=1))
        self.suffix = np.flatnonzero(text >= 0)

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]], width: int) -> Items:
        hashes, counts = [], []
        for _, _, data, offsets in textscan.slices(pa.array([t for _, t in rows], pa.large_string())):
            start, end, bounds = textscan.words(data, offsets, textscan.NOT_ALNUM)
            hashes.append(textscan.word_hashes(data, start, end))
            counts.append(np.diff(bounds))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        vocabulary, number = np.unique(h, return_inverse=True)
        bounds = np.concatenate(([0], np.cumsum(n + 1)))
        text = np.full(int(bounds[-1]), -1, np.int64)
        inside = np.ones(len(text), bool)
        inside[bounds[1:] - 1] = False
        text[inside] = number + 1
        return Items(vocabulary, text, [i for i, _ in rows], bounds, width)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, text=self.text, ids=np.array(["\0" if i is None else "=" + i for i in self.ids], dtype=str), bounds=self.bounds)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes, width: int) -> Items:
        x = np.load(io.BytesIO(data))
        return Items(x["vocabulary"], x["text"], [None if i == "\0" or i == "" else i[1:] for i in x["ids"].tolist()], x["bounds"], width)


class SuffixArray:
    """Suffixes of a shard's runs of benchmark words, sorted as deep as the longest item."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, items: Items):
        # a separator of 0 between documents, so that no run crosses them
        docs = len(bounds) - 1
        spread = np.zeros(len(words) + docs + 1, np.int64)
        spread[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(bounds)) + 1] = words
        change = np.flatnonzero(np.diff((spread > 0).astype(np.int8), append=0, prepend=0))
        begin, end = change[::2], change[1::2]
        long = end - begin >= items.least
        begin, end = begin[long], end[long]
        size = end - begin + 1
        first = np.cumsum(size) - size
        self.text = np.zeros(int(size.sum()) + 1, np.int64)
        at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(begin, size)
        inside = at < np.repeat(end, size)
        self.text[:-1][inside] = spread[at[inside]]
        # place in the shard's words: minus one separator for each document up to here
        where = at - 1
        self.doc = np.searchsorted(bounds[1:] + np.arange(docs) + 1, at, "left") if docs else at
        self.place = where - self.doc
        n = len(self.text)
        rank, k = self.text, 1
        while k < items.longest and n > 1:
            key = (rank << 32) | np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)])[:n]
            values, rank = np.unique(key, return_inverse=True)
            k *= 2
            if len(values) == n:
                break
        order = np.argsort(rank, kind="stable")
        self.order = order[self.text[order] > 0]

    def _compare(self, items: Items, query: np.ndarray, limit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words with the suffix at the given text place, and whether the suffix is smaller than the query."""
        common, smaller = np.zeros(len(query), np.int64), np.zeros(len(query), bool)
        live = np.arange(len(query))
        while len(live):
            a, b = items.text[query[live] + common[live]], self.text[at[live] + common[live]]
            full = common[live] >= limit[live]
            equal = (a == b) & ~full
            smaller[live] = np.where(full, False, b < a)
            common[live[equal]] += 1
            live = live[equal]
        return common, smaller

    def lower(self, items: Items, query: np.ndarray, limit: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.order))
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) >> 1
            _, smaller = self._compare(items, query[live], limit[live], self.order[mid])
            low[live] = np.where(smaller, mid + 1, low[live])
            high[live] = np.where(smaller, high[live], mid)
        return low

    def longest(self, items: Items, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the order, longest common words and text place of a longest match of each benchmark suffix."""
        limit = np.full(len(query), 1 << 40)
        low = self.lower(items, query, limit)
        best, place = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for near in (low, low - 1):
            good = np.flatnonzero((near >= 0) & (near < len(self.order)))
            at = self.order[near[good]]
            common, _ = self._compare(items, query[good], limit[good], at)
            more = common > best[good]
            best[good[more]], place[good[more]] = common[more], at[more]
        return low, best, place

    def upper(self, items: Items, query: np.ndarray, limit: np.ndarray, low: np.ndarray) -> np.ndarray:
        """End of the suffixes that start with the first `limit` words of the query, which low is the first of."""
        high = np.full(len(query), len(self.order))
        low = low.copy()
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) >> 1
            common, _ = self._compare(items, query[live], limit[live], self.order[mid])
            inside = common >= limit[live]
            low[live] = np.where(inside, mid + 1, low[live])
            high[live] = np.where(inside, high[live], mid)
        return low


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def stage_items(benchmark: DataFrame, item: str, text: str, width: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[str, int]:
    """Benchmark chunks as files in the shared folder: (folder, number). The driver holds one chunk at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder, n = shared.new_folder(spark, "items"), max(1, -(-size // chunk_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        found = sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        shared.write_file(folder, f"{k}.npz", [Items.of(found, width).packed()])
    return folder, n


def _shards(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at, end, data, offsets in textscan.slices(batch.column(1), docs=1 << 20, size=SHARD_BYTES):
            # words are found in smaller slices, to keep the byte arrays small
            hashes, counts = [], []
            column = batch.column(1).slice(at, end - at)
            for _, _, part, off in textscan.slices(column):
                start, stop, bounds = textscan.words(part, off, textscan.NOT_ALNUM)
                hashes.append(textscan.word_hashes(part, start, stop))
                counts.append(np.diff(bounds))
            yield batch.column(0).slice(at, end - at), np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


_held: dict[tuple, Items] = {}


def _items(folder: str, k: int, width: int) -> Items:
    if (folder, k, width) not in _held:
        _held.clear()
        with shared.open_file(folder, f"{k}.npz") as f:
            _held[folder, k, width] = Items.unpacked(f.read(), width)
    return _held[folder, k, width]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("x"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items): words of each row, those inside any window's occurrence, items with occurring windows.

    A null or empty text has no words. Items are sorted as strings and distinct; an item with a
    null id marks words but isn't listed. Repeated rows and ids are judged each on its own.
    """
    return _rows(docs, key, text).mapInArrow(_judge(benchmark, width, item, item_text, chunk_bytes), RESULT)


def judged(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, list[str]]:
    """docs with the columns n_words, n_hit and items of contamination(), and these columns' names."""
    return shared.carry(docs, [(key, "long"), (text, "string")], _judge(benchmark, width, item, item_text, chunk_bytes), RESULT, drop=1)


def _judge(benchmark: DataFrame, width: int, item: str, item_text: str, chunk_bytes: int):
    folder, n = stage_items(benchmark, item, item_text, width, chunk_bytes)

    @shared.lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, hashes, bounds in _shards(batches):
            docs_here = len(bounds) - 1
            hit = np.zeros(len(hashes), bool)
            found: list[set[str]] = [set() for _ in range(docs_here)]
            for k in range(n):
                items = _items(folder, k, width)
                array = SuffixArray(_numbers(hashes, items.vocabulary), bounds, items)
                if not len(array.order) or not len(items.start):
                    continue
                low, best, _ = array.longest(items, items.suffix)
                longest = np.zeros(len(items.text), np.int64)
                longest[items.suffix] = best
                w = np.flatnonzero(longest[items.start] >= items.size)
                if not len(w):
                    continue
                start, size, item_of = items.start[w], items.size[w], items.item[w]
                low = array.lower(items, start, size)
                high = array.upper(items, start, size, low)
                _, one = np.unique(np.stack([low, high, size]), axis=1, return_index=True)
                edge = np.zeros(len(hashes) + 1, np.int64)
                for a, b, s in zip(low[one], high[one], size[one], strict=True):
                    place = array.place[array.order[a:b]]
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + s, -1)
                hit |= np.cumsum(edge[:-1]) > 0
                for a, b, which in zip(low, high, item_of, strict=True):
                    if items.ids[which] is not None:
                        for d in np.unique(array.doc[array.order[a:b]]):
                            found[d].add(items.ids[which])
            total = np.concatenate(([0], np.cumsum(hit)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "items"],
            )

    return judge


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Longest verbatim match of each benchmark suffix over all shards, of at least the shortest window's words.

    (item_id, item_word, words, doc_id, doc_word); ties go to the smallest document and place.
    """
    folder, n = stage_items(benchmark, item, item_text, width, chunk_bytes)

    @shared.lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, hashes, bounds in _shards(batches):
            for k in range(n):
                items = _items(folder, k, width)
                array = SuffixArray(_numbers(hashes, items.vocabulary), bounds, items)
                if not len(array.order) or not len(items.start):
                    continue
                low, best, _ = array.longest(items, items.suffix)
                good = np.flatnonzero(best >= items.least)
                query, size = items.suffix[good], best[good]
                low = array.lower(items, query, size)
                high = array.upper(items, query, size, low)
                # of equally long matches in this shard the smallest document, then place
                rows = []
                ids = keys.to_numpy(zero_copy_only=False)
                for q, s, a, b in zip(query, size, low, high, strict=True):
                    at = array.order[a:b]
                    d = array.doc[at]
                    p = array.place[at] - bounds[d]
                    o = np.lexsort((p, ids[d]))[0]
                    it = int(np.searchsorted(items.bounds, q, "right")) - 1
                    rows.append((items.ids[it], int(q - items.bounds[it]), int(s), keys[int(d[o])].as_py(), int(p[o])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)], ["item_id", "item_word", "words", "doc_id", "doc_word"])

    rows = _rows(docs, key, text).mapInArrow(search, MATCH)
    best = F.max_by(F.struct("words", "doc_id", "doc_word"), F.struct("words", -F.col("doc_id"), -F.col("doc_word"))).alias("m")
    return rows.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "m.*")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(found: DataFrame) -> DataFrame:
    """The columns of the report from those of contamination()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
