"""Document fingerprints by one-permutation MinHash over word shingles.

Words are maximal runs of characters other than ASCII white space, A-Z lower-cased. Each shingle of five
words (all words, where there are fewer) is hashed once; the leading bits of the hash name its bin and each
bin keeps its least hash. An empty bin takes the value of the first bin with a value in a random order of
its own, the same for every text (optimal densification: the donor is a uniform choice among the bins with
values, and two texts choose alike as far as they are alike). The bits kept of a bin are the lowest of its
value, mixed with the number of the bin, so that one donated value doesn't repeat its bits.

Equal texts have equal fingerprints. A text without words (null counts as empty) has the empty fingerprint,
whose likeness is 1 to itself and 0 to any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, materialise

BINS, BITS, SHINGLE = 256, 4, 5
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_KNOWN_WORDS = 200_000


class _Words(dict):
    """Hashes of words, kept for a while: the same few words make up most of a text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 13)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


class Fingerprinter:
    """Fingerprints of texts with ``bins`` (a power of two) bins of ``bits`` (1, 2, 4 or 8) bits each."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, seed: int = 13) -> None:
        if bins & (bins - 1) or bins < 2 or bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two, and bits 1, 2, 4 or 8")
        self.bins, self.bits, self.shingle, self.words = bins, bits, shingle, _Words()
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.number = np.arange(bins, dtype=np.uint64) * _STEP
        #: The place of bin j in the order in which bin i looks for a donor.
        self.order = np.argsort(np.random.default_rng(seed).random((bins, bins)), axis=1).argsort(axis=1).astype(np.int16 if bins <= 1 << 15 else np.int32)

    def shingles(self, text: bytes) -> np.ndarray:
        """A hash of each shingle, repeats included."""
        words = text.lower().split()
        each = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.shingle, len(each))
        if not size:
            return each
        h = np.full(len(each) - size + 1, _START)
        for i in range(size):
            h = h * _MIX[0] + each[i : len(each) - size + 1 + i]
        return _mixed(h)

    def values(self, text: bytes) -> np.ndarray | None:
        """The kept bits of each bin, a number a bin; None for a text without words."""
        h = np.sort(self.shingles(text))
        if not len(h):
            return None
        bins = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        full, least = bins[first], h[first]
        donor = np.empty(self.bins, np.int64)
        donor[full] = np.arange(len(full))
        if len(full) < self.bins:
            empty = np.ones(self.bins, bool)
            empty[full] = False
            empty = np.flatnonzero(empty)
            donor[empty] = self.order[np.ix_(empty, full)].argmin(axis=1)
        return (_mixed(least[donor] + self.number) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, values: np.ndarray | None) -> bytes:
        """The bits of all bins one after the other; nothing for a text without words."""
        if values is None:
            return b""
        per = 8 // self.bits
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * np.uint8(self.bits)
        return (values.reshape(-1, per) << shifts).sum(axis=1).astype(np.uint8).tobytes()

    def unpack(self, packed: bytes) -> np.ndarray | None:
        if not packed:
            return None
        per = 8 // self.bits
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * np.uint8(self.bits)
        return ((np.frombuffer(packed, np.uint8)[:, None] >> shifts) & np.uint8((1 << self.bits) - 1)).ravel()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated share of common shingles: equal bins, less those that are equal by chance (one in 2^bits)."""
        if a is None or b is None:
            return float(a is b)
        chance = 0.5**self.bits
        return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / self.bins - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, fingerprint BINARY)`` of every document, whatever its id; rows are told apart by nothing, so repeated ones repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(**options)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([maker.pack(maker.values(t or b"")) for t in texts], pa.binary())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint binary")


def likeness(pairs: DataFrame, a: str, b: str, into: str = "likeness", **options) -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints; null counts as the fingerprint of an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(**options)
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            found = pa.array([maker.likeness(maker.unpack(x or b""), maker.unpack(y or b"")) for x, y in zip(left, right, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return pairs.mapInArrow(run, pairs.withColumn(into, F.lit(0.0)).schema)


def with_half_replaced(text: str, following: str) -> str:
    """``text`` with the last half of its code points (rounded down) replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_MADE = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row of ``docs``.

    The edited text of a document is ``with_half_replaced`` by the next one in the order of the ids, the
    first after the last; a single document is followed by itself. Null ids come last, rows of one id in the
    order of a hash of their texts. Null texts are empty. An empty table gives none.

    Texts move once, into ranges of the ids, and each task goes through its range with two documents at a
    time. The last document of a range and the first of the next meet afterwards: two rows a range.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def completed(maker: Fingerprinter, text: str, own: np.ndarray | None, following: str, other: np.ndarray | None) -> list:
        edited = with_half_replaced(text, following).encode()
        values = maker.values(edited)
        return [len(text), hashlib.sha256(edited).hexdigest(), maker.pack(own), maker.pack(values), maker.likeness(own, values), maker.likeness(own, other)]

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, part, before, rows = Fingerprinter(**options), TaskContext.get().partitionId(), None, []
        nothing, schema = [None] * 6, None

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            schema = pa.schema([("id", batch.column(0).type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                                ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.string()), ("part", pa.int32()), ("text", pa.string())])
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(lo, SLICE_ROWS)
                for id_, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    text = text or ""
                    values = maker.values(text.encode())
                    if before is None:
                        rows.append([None, *nothing[:2], maker.pack(values), *nothing[:3], "first", part, text])
                    else:
                        rows.append([before[0], *completed(maker, *before[1:], text, values), None, part, None])
                    before = (id_, text, values)
                yield out()
        if before is not None:
            rows.append([before[0], *nothing[:2], maker.pack(before[2]), *nothing[:3], "last", part, before[1]])
            yield out()

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(**options)
        for batch in batches:
            ids, *given = (batch.column(i) for i in range(5))
            made = [completed(maker, t, maker.unpack(f), u, maker.unpack(g)) for t, f, u, g in zip(*(c.to_pylist() for c in given), strict=True)]
            types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=["id", *(x.split()[0] for x in _MADE.split(", "))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.asc_nulls_last("id"), F.asc("tie")]
    # A range may begin among the rows of one id, even among equal rows: nth tells them apart.
    ranged = rows.repartitionByRange(*order, F.asc("nth")).sortWithinPartitions(*order, F.asc("nth")).select("id", "text")
    made = materialise(ranged.mapInArrow(through, f"id {kind}, {_MADE}, edge string, part int, text string"))
    first, last = (made.where(F.col("edge") == e) for e in ("first", "last"))
    # One row for each range that isn't empty.
    ring = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("following"))
    after = first.select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = last.join(ring, "part").join(after, "following").select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(closed, f"id {kind}, {_MADE}")
    return made.where("edge IS NULL").drop("edge", "part", "text").unionByName(ends)
