"""Token ids: encoding whole texts, exact length histograms, and a binary id format.

A null or empty text has no ids but the end id. Texts are cut at ASCII white space, which
the word-level vocabulary drops, and inside words where it cuts for certain. Pieces are found
and hashed by NumPy, a slice of documents at a time; each distinct piece is encoded once by the
tokenizers library in each worker while a bounded table keeps it, and the ids of a text are
gathered from that table. Any other vocabulary must be used with whole=True, which encodes
whole texts.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import rangecoder, shared, textscan

CACHED_PIECES = 1_500_000
#: Longer pieces are not kept: hashes of very long strings can be made to collide.
LONGEST_PIECE = 256
LANES, BLOCK = 8192, 512
# What the word-level vocabulary takes apart by itself: runs of letters (1), single digits (2), runs of other characters (3).
# Letters are ASCII ones and those of U+00C0 to U+024F but U+0130: neither NFC nor lower case takes these apart.
_kinds = np.full(256, 3, np.uint8)
_kinds[[*range(65, 91), *range(97, 123)]] = 1
_kinds[48:58] = 2
_odd = np.zeros(256, bool)
_odd[0x80:] = _odd[:0x20] = _odd[0x7F] = _odd[0x27] = True
_odd[textscan.SPACES] = False
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_KIND, _ODD, _SPACE, _FOLD = (t.tobytes() for t in (_kinds, _odd, textscan.SPACES, _fold))
#: Bytes of text worked on at a time: what they grow to stays in a core's cache.
SLICE = 1 << 18


class _Known:
    """Hashes of pieces and their ids, in arrays: an open-addressing table that grows."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.start, self.length, self.ids = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 17, np.uint32)
        self.count = self.used = 0

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where unknown; no hash may be 0."""
        at = self._first(h)
        key = self.keys.take(at)
        out = np.where(key == h, self.values.take(at), np.int32(-1))
        todo = ((key != h) & (key != 0)).nonzero()[0]
        last = len(self.keys) - 1
        while len(todo):
            at[todo] = (at[todo] + 1) & last
            key, want = self.keys.take(at[todo]), h[todo]
            same = key == want
            out[todo[same]] = self.values.take(at[todo[same]])
            todo = todo[~same & (key != 0)]
        return out

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        at, last = self._first(h), len(self.keys) - 1
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys.take(at[todo]) == 0]
            self.keys[at[free]] = h[free]
            mine = free[self.keys.take(at[free]) == h[free]]
            self.values[at[mine]] = values[mine]
            todo = todo[self.keys.take(at[todo]) != h[todo]]
            at[todo] = (at[todo] + 1) & last

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New pieces of different hashes, and their ids."""
        n, raw = len(h), np.frombuffer(b"".join(ids), "<u4")
        while 2 * (self.count + n) > len(self.keys):
            old, values = self.keys, self.values
            self.keys, self.values = np.zeros(2 * len(old), np.uint64), np.zeros(2 * len(old), np.int32)
            self._place(old[old != 0], values[old != 0])
        self.start, self.length = (x if self.count + n <= len(x) else np.concatenate([x, np.zeros(len(x) + n, np.int64)]) for x in (self.start, self.length))
        if self.used + len(raw) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(raw), np.uint32)])
        length = np.fromiter(map(len, ids), np.int64, n) // 4
        self.length[self.count : self.count + n] = length
        self.start[self.count : self.count + n] = self.used + np.cumsum(length) - length
        self.ids[self.used : self.used + len(raw)] = raw
        self._place(h, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count += n
        self.used += len(raw)


class TokenEncoder:
    """Ids of texts by the tokenizers library; each distinct piece is encoded once while it is kept."""

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.whole = whole
        if not whole:
            # the same vocabulary for words that are normalised and cut already
            self.ascii, self.latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
            self.ascii.normalizer = self.latin.normalizer = normalizers.Sequence([])
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.library.get_vocab()
        self.word_end = np.zeros(max(words.values(), default=0) + 1, bool)
        self.word_end[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known = _Known()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], by) -> list[bytes]:
        """Ids of one word each, by one call for many: each ends with an id of a word's end."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(by.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            if len(ends) != len(some):
                out += self._library(some)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends][:-1], ends, strict=True)]
        return out

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, bounds by row, starts of those that may hold anything, bytes with A-Z lower-cased in all others)."""
        start, end, bounds = textscan.words(data, offsets, textscan.SPACES)
        raw = data.tobytes()
        kind, odd, space, folded = (np.frombuffer(bytearray(raw.translate(t)), d) for t, d in ((_KIND, np.uint8), (_ODD, bool), (_SPACE, bool), (_FOLD, np.uint8)))
        lead = np.flatnonzero(data - np.uint8(0xC3) <= 6)
        code = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
        lead = lead[(code <= 0x24F) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)]
        kind[lead] = kind[lead + 1] = 1
        # words with other characters, controls, apostrophes or <| are left in one piece
        odd[lead] = odd[lead + 1] = False
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        first = odd.copy()
        first[1:] &= ~odd[:-1]
        first[start] |= odd[start]
        whole = np.searchsorted(start, np.flatnonzero(first), "right") - 1
        whole = whole[np.concatenate([[True], whole[1:] != whole[:-1]])] if len(whole) else whole
        size = end[whole] - start[whole]
        inner = np.repeat(start[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
        folded[inner] = data[inner]
        cut = kind == 2
        cut[1:] |= kind[1:] != kind[:-1]
        cut[inner] = False
        cut &= ~space
        cut[start] = True
        # a piece ends where the next one starts, or with its word
        last = np.zeros(len(data), bool)
        last[:-1] = cut[1:]
        last &= ~space
        last[end - 1] = True
        first = np.flatnonzero(cut)
        return first, np.flatnonzero(last) + 1, np.searchsorted(first, offsets), start[whole], folded

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their bounds by row) of UTF-8 texts."""
        if self.whole or not len(data):
            raw = data.tobytes()
            ids = self._library([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]) if len(data) else []
            return np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]) if ids else np.zeros(len(offsets), np.int64)
        if self.known.count > CACHED_PIECES:
            self.known.clear()
        start, end, bounds, whole, folded = self._pieces(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = textscan.word_hashes(folded, start, end, textscan.EXACT)
        h[h == 0] = 1
        long = np.flatnonzero(end - start > LONGEST_PIECE)
        number = self.known.find(h)
        number[long] = -1
        missing = np.flatnonzero(number < 0)
        extra: list[bytes] = []
        if len(missing):
            raw = folded.tobytes()
            kept = missing[end[missing] - start[missing] <= LONGEST_PIECE]
            _, at = np.unique(h[kept], return_index=True)
            new = np.concatenate([kept[at], long])
            text = np.array([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)], object)
            # one after the other: plain words of ASCII, of other Latin letters too, of anything
            sort = np.fromiter((not x.isascii() for x in text), np.int8, len(text))
            sort[np.isin(start[new], whole)] = 2
            order = np.argsort(sort, kind="stable")
            new, text = new[order], text[order].tolist()
            a, b = np.searchsorted(sort[order], [1, 2]).tolist()
            ids = self._words(text[:a], self.ascii) + self._words([x.lower() for x in text[a:b]], self.latin) + self._library(text[b:])
            brief = end[new] - start[new] <= LONGEST_PIECE
            if brief.all():
                self.known.add(h[new], ids)
            else:
                self.known.add(h[new[brief]], [x for x, y in zip(ids, brief.tolist(), strict=True) if y])
                extra = [x for x, y in zip(ids, brief.tolist(), strict=True) if not y]
                long = new[~brief]
            number[kept] = self.known.find(h[kept])
        if not extra:
            return self._gather(self.known.start, self.known.length, self.known.ids, number, bounds)
        # pieces too long to keep stand behind the known ones for this slice only
        n, size = self.known.count, np.array([len(x) // 4 for x in extra], np.int64)
        number[long] = np.arange(n, n + len(extra))
        starts = np.concatenate([self.known.start[:n], self.known.used + np.cumsum(size) - size])
        ids = np.concatenate([self.known.ids[: self.known.used], np.frombuffer(b"".join(extra), "<u4")])
        return self._gather(starts, np.concatenate([self.known.length[:n], size]), ids, number, bounds)

    @staticmethod
    def _gather(start: np.ndarray, length: np.ndarray, ids: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = length.take(number)
        end = np.cumsum(size)
        at = np.arange(int(end[-1]))
        at += np.repeat(start.take(number) - end + size, size)
        return ids.take(at), np.concatenate([[0], end])[bounds]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text; null has none."""
        found = [np.diff(self.encode_slice(data, offsets)[1]) for _, _, data, offsets in textscan.slices(column, size=SLICE)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def encode(self, text: str | None) -> bytes:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_slice(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()


_encoders: dict[tuple[str, bool], TokenEncoder] = {}


def encoder(path: str, whole: bool = False) -> TokenEncoder:
    """The worker's encoder for a vocabulary file."""
    if (path, whole) not in _encoders:
        _encoders[path, whole] = TokenEncoder(path, whole)
    return _encoders[path, whole]


def encoded_lengths(docs: DataFrame, path: str, text: str = "text", end_ids: int = 1, whole: bool = False) -> DataFrame:
    """(length): number of ids of each row's text, with the end ids; null and empty texts have only those."""

    @shared.lean
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, whole)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(batch.column(0)) + end_ids, pa.int64())], ["length"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame, bin_bits: int = 10) -> DataFrame:
    """One row per distinct length: answers for every context limit.

    n_docs of exactly this length; docs_up_to, tokens_up_to: of this length or less;
    docs_over, tokens_over: of more; truncated_tokens: what remains if each document is cut
    to this length; quantile: share of documents of this length or less. For a limit between
    two lengths, truncated = tokens_up_to(lower) + docs_over(lower) * limit. No documents: no rows.

    Suffix sums run in two levels, bins of 2 ** bin_bits lengths and lengths in a bin, so
    that no task holds more than a bin of lengths or the list of bins.
    """
    # the exchange by length carries counts only: partial counts are made before it
    counts = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("bin", F.shiftright("length", bin_bits))
    counts = shared.settle(counts, "lengths")  # both levels read it: texts are encoded once
    bins = counts.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    whole = Window.partitionBy(F.lit(0)).orderBy("bin")
    bins = bins.select(
        "bin",
        (F.sum("d").over(whole) - F.col("d")).alias("d0"),
        (F.sum("t").over(whole) - F.col("t")).alias("t0"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("all_docs"),
        F.sum("t").over(Window.partitionBy(F.lit(0))).alias("all_tokens"),
    )
    upto = Window.partitionBy("bin").orderBy("length")
    x = counts.join(bins, "bin").withColumns({
        "docs_up_to": F.col("d0") + F.sum("n_docs").over(upto),
        "tokens_up_to": F.col("t0") + F.sum(F.col("n_docs") * F.col("length")).over(upto),
    })
    over = F.col("all_docs") - F.col("docs_up_to")
    return x.select(
        "length", "n_docs", "docs_up_to", "tokens_up_to", over.alias("docs_over"),
        (F.col("all_tokens") - F.col("tokens_up_to")).alias("tokens_over"),
        (F.col("tokens_up_to") + over * F.col("length")).alias("truncated_tokens"),
        F.round(F.col("docs_up_to") / F.col("all_docs"), 9).alias("quantile"),
    )


# The file format. Header: magic, vocabulary size. Then groups: number of ids, ids in a block,
# documents that end in the group, bytes of the distribution and of the list of documents; for
# each block payload bytes and CRC-32 of its ids as little-endian unsigned 32-bit integers; the
# distribution; the list (zlib: keys, whether null, numbers of ids in this group); the payloads.
# A document may go on over groups. A group without ids or documents ends the file.
MAGIC = b"CVIDS2\n\0"
_GROUP = struct.Struct("<IIIII")


def _crc(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data, before) if len(ids) else before


def _pack(ids: np.ndarray, keys: np.ndarray, null: np.ndarray, counts: np.ndarray, vocab: int) -> Iterator[bytes]:
    listed = zlib.compress(keys.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes(), 1)
    order0 = rangecoder.Order0.of(ids, vocab) if len(ids) else None
    payloads = rangecoder.encode(ids, BLOCK, order0, vocab) if len(ids) else []
    packed = order0.pack() if len(ids) else b""
    yield _GROUP.pack(len(ids), BLOCK, len(keys), len(packed), len(listed))
    heads = np.empty((len(payloads), 2), "<u4")
    heads[:, 0] = [len(p) for p in payloads]
    heads[:, 1] = [_crc(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    yield heads.tobytes()
    yield packed
    yield listed
    yield b"".join(payloads)


def file_bytes(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], vocab: int, group: int = LANES * BLOCK) -> Iterator[bytes]:
    """A file of documents, from parts (keys, whether null, number of ids of each, all their ids).

    Not more than a part and a group of ids is held.
    """
    yield MAGIC + struct.pack("<I", vocab)
    none = np.zeros(0, np.int64)
    keys, null, counts, ids = none, none.astype(bool), none, np.zeros(0, np.uint32)
    open_ids = 0  # ids of the first document that earlier groups have
    for part in parts:
        keys, null, counts, ids = (np.concatenate(x) for x in zip((keys, null, counts, ids), part, strict=True))
        while len(ids) >= group:
            ends = np.cumsum(counts) - open_ids
            n = int(np.searchsorted(ends, group, "right"))
            here = counts[:n].copy()
            if n:
                here[0] -= open_ids
            yield from _pack(ids[:group], keys[:n], null[:n], here, vocab)
            open_ids = group - int(ends[n - 1]) if n else open_ids + group
            keys, null, counts, ids = keys[n:], null[n:], counts[n:], ids[group:].copy()
    if len(keys):
        counts = counts.copy()
        counts[0] -= open_ids
        yield from _pack(ids, keys, null, counts, vocab)
    yield _GROUP.pack(0, 0, 0, 0, 0)


def read_groups(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, whether null, numbers of ids here, ids) of each group; ids behind the last document's go on in the next group.

    Raises ValueError where a block's checksum or a length is wrong.
    """

    def exactly(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("id file ends early")
        return bytes(data)

    def unzipped(data: bytes) -> bytes:
        try:
            return zlib.decompress(data)
        except zlib.error as fault:
            raise ValueError("a group's list is broken") from fault

    if exactly(8) != MAGIC:
        raise ValueError("not an id file")
    exactly(4)
    while True:
        n, block, docs, packed, listed = _GROUP.unpack(exactly(_GROUP.size))
        if not n and not docs:
            return
        heads = np.frombuffer(exactly(8 * -(-n // block)) if n else b"", "<u4").reshape(-1, 2)
        order0 = rangecoder.Order0.unpack(exactly(packed)) if n else None
        raw = unzipped(exactly(listed))
        if len(raw) != 13 * docs:
            raise ValueError("a group's list has another length")
        keys, null, counts = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs) > 0, np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
        ends = np.cumsum(heads[:, 0], dtype=np.int64).tolist()
        body = exactly(ends[-1] if ends else 0)
        ids = rangecoder.decode([body[a:b] for a, b in zip([0, *ends][:-1], ends, strict=True)], n, block, order0) if n else np.zeros(0, np.uint32)
        if [_crc(ids[at : at + block]) for at in range(0, n, block or 1)] != heads[:, 1].tolist():
            raise ValueError("block checksum differs")
        if int(counts.sum()) > n:
            raise ValueError("documents and ids differ in length")
        yield keys, null, counts, ids


def read_file(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of each document of a file."""
    held: list[np.ndarray] = []
    for keys, null, counts, ids in read_groups(stream):
        ends = np.cumsum(counts).tolist()
        for key, none, a, b in zip(keys.tolist(), null.tolist(), [0, *ends][:-1], ends, strict=True):
            yield None if none else key, np.concatenate([*held, ids[a:b]])
            held = []
        held.append(ids[ends[-1] if ends else 0 :])
    if sum(map(len, held)):
        raise ValueError("documents and ids differ in length")


def write_ids(docs: DataFrame, path: str, folder: str, vocab: int = 49_408, end_id: int = 1, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Write ids of whole texts to files in ascending key order, null keys first; a settled table of files.

    Rows of one key are ordered by text, so that a repeated task writes the same bytes. An
    empty table writes no document. Columns of the result: part int, n_docs, n_tokens, n_bytes long.
    """

    @shared.lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, whole), TaskContext.get().partitionId()
        n_docs = n_tokens = 0

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal n_docs, n_tokens
            for batch in batches:
                keys, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                for at, end, data, offsets in textscan.slices(batch.column(1), size=SLICE):
                    ids, bounds = enc.encode_slice(data, offsets)
                    counts = np.diff(bounds) + 1
                    n_docs += end - at
                    n_tokens += int(counts.sum())
                    yield keys[at:end], null[at:end], counts, np.insert(ids, bounds[1:], np.uint32(end_id))

        size = shared.write_file(folder, f"{part:06d}.ids", file_bytes(_joined(parts(), LANES * BLOCK), vocab))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [size]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("x"))
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "x")
    return shared.settle(rows.mapInArrow(write, "part int, n_docs long, n_tokens long, n_bytes long"), "id-files")


def _joined(parts: Iterator[tuple[np.ndarray, ...]], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts put together until they have the least number of ids."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[3])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The list of files goes through the driver: a few numbers for each file, not for documents.
    """
    spark = files.sparkSession
    listed = sorted(tuple(r) for r in files.select("part", "n_tokens").collect())
    starts = np.cumsum([0] + [n for _, n in listed]).tolist()
    parts = [p for p, _ in listed]

    @shared.lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, before, crc = starts[k], 0, 0  # before, crc: of a document that earlier groups began
                with shared.open_file(folder, f"{parts[k]:06d}.ids") as f:
                    for keys, null, counts, ids in read_groups(f):
                        ends = np.cumsum(counts).tolist()
                        data = np.ascontiguousarray(ids, "<u4").data.cast("B") if len(ids) else b""
                        crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *ends][:-1], ends, strict=True)]
                        sizes = counts.copy()
                        if len(sizes):
                            crcs[0] = zlib.crc32(data[: 4 * ends[0]], crc)
                            sizes[0] += before
                            before, crc = 0, 0
                            stops = at + np.cumsum(sizes)
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=null), pa.array(stops - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            at = int(stops[-1])
                        rest = ends[-1] if ends else 0
                        crc = zlib.crc32(data[4 * rest :], crc)
                        before += len(ids) - rest
                if before:
                    raise ValueError("documents and ids differ in length")

    n = len(parts)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
