"""Removal of long repeated byte strings, over a logarithmic family of sparse suffix indexes.

Every string of ``length`` (200) bytes has one anchor: the leftmost of its 32-byte substrings with the
smallest hash. Equal strings have equal anchors at equal places, so it suffices to index the suffixes
that begin at anchors, one for about every 65 bytes. A run of the index is those suffixes of a batch
of documents in the order of their anchors' keys, with counts; it is the sparse counterpart of a
suffix array, ordered by hash instead of by bytes.

- A new batch gets a run of its own and is merge-scanned against the runs that are there: both sides
  are bucketed by key and sorted, so that equal keys meet bucket by bucket, without a shuffle. Only keys
  that occur twice, in two runs or in the batch itself, can begin a long match.
- Then runs of equal rank are merged into one of the next rank, again bucket by bucket, so n batches
  leave at most log2(n) + 1 runs, and each key is rewritten that often at most.
- The starts of all strings with one anchor are consecutive, and so are the bytes they cover: the
  anchor's context. Where a whole context occurs twice, all its starts repeat. The other contexts
  under a repeated key are compared byte by byte, for each start apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, identity, join_spread, map_slices, materialise, one_of_each, release, shared_dir, utf8

KEY_BYTES = 32
_TABLE = np.random.default_rng(10).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Bytes of text that are hashed together; a longer text is hashed by pieces of this size.
_AT_A_TIME = 1 << 19


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the KEY_BYTES bytes from each position on, by doubling."""
    h, width, power = _TABLE[data], 1, _BASE
    while width < KEY_BYTES:
        h = h[:-width] + h[width:] * np.uint64(power)
        width, power = 2 * width, power * power % 2**64
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    return h ^ (h >> np.uint64(29))


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts one after the other: each anchor's key and position, and the first and last start of its strings."""
    h = _hashes(data)
    width = length - KEY_BYTES + 1
    # Of equal hashes the leftmost is the least, as the position is in the low half.
    order = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([order, np.full(-len(order) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    inside = np.zeros(len(data) + 1, np.int32)  # starts whose string ends inside its text
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= length
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none
    at = (least[starts] & ~_HIGH).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(starts)]]) - 1
    return h[at[first]], at[first], starts[first], starts[last]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, row, mark)`` of every document; a null text is empty."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row, mark = identity(F.col("id"), F.col("text"))
    return src.withColumns({"row": row, "mark": mark})


def suffixes(keyed: DataFrame, length: int) -> DataFrame:
    """``(row, place, key, context)`` of each anchor; ``place`` packs mark, first start, number of starts less 1, and bytes before the anchor.

    A long text is taken by pieces that overlap by ``length`` - 1 bytes, so that each string lies in one. An
    anchor whose starts lie in two pieces has two entries then, with other starts, which are compared alike.
    """

    def some(pieces: list[bytes], owner: np.ndarray, base: np.ndarray, rows: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([len(t) for t in pieces])
        raw = b"".join(pieces)
        key, at, first, last = _anchors(np.frombuffer(raw, np.uint8), ends, length)
        piece = np.searchsorted(ends, first, "right")
        doc, begin = owner[piece], np.concatenate([[0], ends])[piece] - base[piece]
        context = np.fromiter(map(xxhash.xxh3_64_intdigest, (raw[i:j] for i, j in zip(first.tolist(), (last + length).tolist(), strict=True))), np.uint64, len(first))
        place = marks[doc] << 48 | (first - begin) << 16 | (last - first) << 8 | (at - first)
        return [rows[doc], place, key.view(np.int64), context.view(np.int64)]

    def run(part: pa.RecordBatch) -> dict[str, object]:
        texts, rows, marks = utf8(part.column(0)), part.column(1).to_numpy(), part.column(2).to_numpy()
        out, held, size = [[np.zeros(0, np.int64)] * 4], [], 0

        def flush() -> None:  # the arrays take some hundred bytes for each byte of text
            if held:
                out.append(some([h[2] for h in held], np.array([h[0] for h in held]), np.array([h[1] for h in held]), rows, marks))
                held.clear()

        for i, text in enumerate(texts):
            for k in range(0, len(text) - length + 1, _AT_A_TIME):
                piece = text[k : k + _AT_A_TIME + length - 1]
                if size + len(piece) > _AT_A_TIME:
                    flush()
                    size = 0
                held.append((i, k, piece))
                size += len(piece)
        flush()
        return dict(zip(("row", "place", "key", "context"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    return map_slices(keyed.where(F.octet_length("text") >= length).select("text", "row", "mark"), run, "row bigint, place bigint, key bigint, context bigint")


class SuffixFamily:
    """Runs of anchored suffixes, as bucketed tables in the shared folder.

    ``add`` takes a batch of ``suffixes``; ``repeated`` gives the keys found at least twice in all batches.
    """

    def __init__(self, spark: SparkSession, length: int = 200, folder: str | None = None):
        if not KEY_BYTES <= length <= 287:
            raise ValueError(f"length must be between {KEY_BYTES} and 287")
        self.spark, self.length, self.folder = spark, length, folder or shared_dir(spark)
        self.buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))  # the most that Spark takes
        self.name = f"tideflow_{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []  # rank and table, ranks falling
        self.found: list[DataFrame] = []
        self.written = 0

    def _write_run(self, counted: DataFrame) -> str:
        """``counted(key, n)`` as a table of one sorted file for each bucket of keys."""
        table = f"{self.name}_{self.written}"
        counted.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/run-{self.written}").saveAsTable(table)
        self.written += 1
        return table

    def _drop_run(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        drop_path(self.spark, f"{self.folder}/run-{table.rsplit('_', 1)[1]}")

    def add(self, batch: DataFrame) -> None:
        """Index a batch of ``suffixes``: scan it against all runs for equal keys, then merge runs while the last two have one rank."""
        run = self._write_run(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        new = self.spark.table(run)
        shared = new.where("n > 1")
        for _, level in self.levels:
            old = self.spark.table(level).withColumnRenamed("n", "others")
            shared = shared.unionByName(new.join(old, "key").select("key", (F.col("n") + F.col("others")).alias("n")))
        self.found.append(materialise(shared, f"{self.folder}/found-{len(self.found)}"))
        self.levels.append((0, run))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels[-2:]
            x, y = self.spark.table(a), self.spark.table(b)
            both = x.join(y, x.key == y.key, "full_outer").select(F.coalesce(x.key, y.key).alias("key"), (F.coalesce(x.n, F.lit(0)) + F.coalesce(y.n, F.lit(0))).alias("n"))
            self.levels[-2:] = [(rank + 1, self._write_run(both))]
            self._drop_run(a)
            self._drop_run(b)

    def repeated(self) -> DataFrame:
        """``(key, n)``: the keys that occur at least twice over all batches, each once, with a count of its suffixes in two of the runs at least."""
        return reduce(DataFrame.unionByName, self.found).groupBy("key").agg(F.max("n").alias("n"))

    def close(self) -> None:
        """Delete the runs and what was found."""
        for _, table in self.levels:
            self.spark.sql(f"DROP TABLE {table}")
        self.levels, self.found = [], []
        drop_path(self.spark, self.folder)


_STARTS = "row bigint, mark bigint, lo bigint, hi bigint"


def _same_bytes(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of ``contexts(key, row, place, bytes)``, by comparing all strings of a key that lie alike to the anchor."""

    def compare(members: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        spans = [((p & 0xFF), (p >> 8 & 0xFF)) for _, p, _ in members]  # bytes before the anchor, starts less 1
        twice: list[list[int]] = [[] for _ in members]
        for shift in range(-max(b for b, _ in spans), max(n - b for b, n in spans) + 1):
            seen: dict[bytes, int] = {}
            for i, (before, last) in enumerate(spans):
                k = shift + before
                if 0 <= k <= last:
                    j = seen.setdefault(members[i][2][k : k + length], i)
                    if j != i:
                        twice[i].append(k)
                        if not twice[j] or twice[j][-1] != shift + spans[j][0]:
                            twice[j].append(shift + spans[j][0])
        for (row, place, _), ks in zip(members, twice, strict=True):
            first = place >> 16 & 0xFFFFFFFF
            for k in ks:
                if k - 1 not in ks:
                    end = k
                    while end + 1 in ks:
                        end += 1
                    yield row, place >> 48, first + k, first + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, out = [], None, []
        for batch in batches:
            for key, row, place, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != held_key:
                    out += compare(held) if len(held) > 1 else ()
                    held, held_key = [], key
                held.append((row, place, data))
            yield _starts_batch(out)
            out = []
        out += compare(held) if len(held) > 1 else ()
        yield _starts_batch(out)

    return contexts.select("key", "row", "place", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, _STARTS)


def _starts_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("row", "mark", "lo", "hi"))})


def _narrowed(contexts: DataFrame, length: int) -> DataFrame:
    """``contexts(key, row, place, bytes)`` under narrower keys, with ``n``, the contexts under each; those that are alone there go.

    A common string of ``length`` bytes holds the anchor and, before it or after it, at least half of the other bytes. So a context is
    put under the hash of the half before its anchor and of that after it, where it has as many bytes, and two with a common string meet.
    """
    half = -(-(length - KEY_BYTES) // 2)
    before, size = F.col("place").bitwiseAND(F.lit(0xFF)).cast("int"), F.octet_length("bytes")
    sides = ((0, before - half, before >= half), (1, before + KEY_BYTES, size - before - KEY_BYTES >= half))
    under = F.array_compact(F.array(*(F.when(there, F.xxhash64("key", F.lit(side), F.substring(F.col("bytes"), at + 1, F.lit(half)))) for side, at, there in sides)))
    each = contexts.select(F.explode(under).alias("key"), "row", "place", "bytes")
    sizes = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_spread(each.withColumn("nth", F.xxhash64("row", "place")), sizes, ["key"], sizes, "nth").drop("nth")


def _same_digests(contexts: DataFrame, length: int) -> DataFrame:
    """As ``_same_bytes``, for keys with so many contexts that they are dealt out: by counted digests of their strings, some 65 a context."""

    def strings(part: pa.RecordBatch) -> dict[str, object]:
        out = []
        for key, row, place, data in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            before, last, first = place & 0xFF, place >> 8 & 0xFF, place >> 16 & 0xFFFFFFFF
            for k in range(last + 1):
                digest = xxhash.xxh3_128_digest(data[k : k + length])
                out.append((key ^ (k - before), digest, row, place >> 48, first + k))
        names = ("at", "digest", "row", "mark", "start")
        return {n: pa.array([r[i] for r in out], pa.binary() if n == "digest" else pa.int64()) for i, n in enumerate(names)}

    each = materialise(map_slices(contexts.select("key", "row", "place", "bytes"), strings, "at bigint, digest binary, row bigint, mark bigint, start bigint"))
    twice = materialise(each.groupBy("at", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = join_spread(each.withColumn("nth", F.xxhash64("row", "start")), twice.drop("n"), ["at", "digest"], twice, "nth")
    return found.select("row", "mark", F.col("start").alias("lo"), F.col("start").alias("hi"))


def repeated_starts(docs: DataFrame, id_col: str, text_col: str, length: int = 200, batches: int | None = None, crowd: int = 2_000) -> DataFrame:
    """``(row, mark, lo, hi)``: in the rows of ``_keyed``, the starts lo..hi of strings that start anywhere else too."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    every = materialise(suffixes(keyed, length), f"{folder}/suffixes")
    if batches is None:  # each batch is scanned against all before it, so their number grows with the logarithm of the input
        batches = 2 + (every.count() >> 22).bit_length()
    family = SuffixFamily(spark, length, f"{folder}/family")
    try:
        for i in range(batches):
            family.add(every.where(F.pmod("row", F.lit(batches)) == i))
        keys = materialise(family.repeated())
    finally:
        family.close()
    hits = join_spread(every.withColumn("nth", F.xxhash64("row", "place")), keys.drop("n"), ["key"], keys, "nth").drop("nth")
    hits = materialise(hits, f"{folder}/hits")
    drop_path(spark, f"{folder}/suffixes")
    release(spark)
    groups = materialise(hits.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("one")))
    twice = groups.where("n > 1").select("key", "context", "n")
    whole = join_spread(hits.withColumn("nth", F.xxhash64("row", "place")), twice.drop("n"), ["key", "context"], twice, "nth").select("row", "place").distinct()
    mark, first = F.shiftright("place", 48), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    whole = materialise(whole.select("row", mark.alias("mark"), first.alias("lo"), (first + F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))).alias("hi")))
    # One anchor for each different context, where a key has several.
    sizes = materialise(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    several = join_spread(groups.select("key", "context", "one"), sizes.withColumnRenamed("n", "n_contexts"), ["key"], sizes, "context")
    several = materialise(several.select("one.row", F.shiftright("one.place", 48).alias("mark"), "one.place", "key", "n_contexts"))
    drop_path(spark, f"{folder}/hits")
    release(spark)
    wanted = several.groupBy("row", "mark").agg(F.collect_list(F.struct("place", "key", "n_contexts")).alias("anchors"))

    def cut(part: pa.RecordBatch) -> dict[str, object]:
        texts, anchors = utf8(part.column(0)), part.column(2)
        owner = np.repeat(np.arange(len(texts)), anchors.value_lengths().to_numpy())
        place, key, n = (anchors.flatten().field(i).to_numpy() for i in range(3))
        first = place >> 16 & 0xFFFFFFFF
        ends = first + (place >> 8 & 0xFF) + length
        parts = [texts[o][i:j] for o, i, j in zip(owner.tolist(), first.tolist(), ends.tolist(), strict=True)]
        return {"key": key, "n_contexts": n, "row": part.column(1).to_numpy()[owner], "place": place, "bytes": pa.array(parts, pa.binary())}

    # Repeated rows are one text: an anchor's context is cut once.
    texts = one_of_each(keyed.select("text", "row", "mark"), ["row", "mark"]).join(wanted, ["row", "mark"]).select("text", "row", "anchors")
    contexts = materialise(map_slices(texts, cut, "key bigint, n_contexts bigint, row bigint, place bigint, bytes binary"))
    release(spark)
    narrowed = materialise(_narrowed(contexts.where(F.col("n_contexts") > crowd), length))
    columns = ["key", "row", "place", "bytes"]
    few = contexts.where(F.col("n_contexts") <= crowd).select(*columns).unionByName(narrowed.where(F.col("n") <= crowd).select(*columns))
    few = materialise(_same_bytes(few, length))
    many = materialise(_same_digests(narrowed.where(F.col("n") > crowd), length))
    release(spark)
    return whole.unionByName(few).unionByName(many)


def _runs(starts: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """For each text the maximal runs of bytes in strings that begin at its ``starts``."""
    flat, at, out = starts.flatten(), 0, []
    first, end = flat.field("lo").to_numpy(), flat.field("hi").to_numpy() + length
    for n in pc.fill_null(starts.value_lengths(), 0).to_pylist():
        lo, hi = first[at : at + n], end[at : at + n]
        at += n
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        cuts = np.flatnonzero(lo[1:] > hi[:-1])
        out.append(list(zip(lo[[0, *(cuts + 1)]].tolist(), hi[[*cuts, n - 1]].tolist(), strict=True)) if n else [])
    return out


def _with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with the list ``__starts`` of each by ``(__row, __mark)``, null for none; rows that repeat many times are dealt out."""
    keys = ["__row", "__mark"]
    listed = starts.groupBy(F.col("row").alias("__row"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct("lo", "hi")).alias("__starts"))
    sizes = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_spread(rows.withColumn("__nth", F.monotonically_increasing_id()), listed, keys, sizes, "__nth", "left").drop("__nth", *keys)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batches: int | None = None, crowd: int = 2_000) -> DataFrame:
    """One row for each document: id, ``n_bytes``, ``spans ARRAY<STRUCT<lo, hi>>`` and ``kept BINARY``.

    ``spans`` are the maximal runs of bytes that lie in a string of ``length`` bytes which also starts
    anywhere else, in this document or another; ``kept`` is the other bytes. Null texts count as empty;
    texts under ``length`` bytes keep all; a repeated row is its own repetition; an empty table gives
    no rows; other columns are ignored. A very long text is hashed by pieces and held whole only to be cut.
    ``batches`` is how many batches the family takes in, by default two and one more each time the input
    doubles from 4 million anchors on. The contexts of one key meet in one task, which compares their bytes;
    those of a key with over ``crowd`` different ones are put under narrower keys, two at most for each (``_narrowed``),
    and of those that have over ``crowd``, too, the strings are compared by counted 128-bit digests, dealt out by
    them. The result depends on neither.
    """
    starts = repeated_starts(docs, id_col, text_col, length, batches, crowd)

    def cut(part: pa.RecordBatch) -> dict[str, object]:
        spans, kept, sizes = [], [], []
        for text, runs in zip(utf8(part.column(1)), _runs(part.column(2), length), strict=True):
            at, left = 0, []
            for lo, hi in runs:
                left.append(text[at:lo])
                at = hi
            kept.append(b"".join([*left, text[at:]]))
            sizes.append(len(text))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in runs])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return {"id": part.column(0), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col).withColumnsRenamed({"row": "__row", "mark": "__mark"})
    texts = _with_starts(keyed, starts).select("id", "text", "__starts")
    return map_slices(texts, cut, f"id {kind}, n_bytes bigint, spans array<struct<lo: bigint, hi: bigint>>, kept binary").withColumnRenamed("id", id_col)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", length: int = 200, batches: int | None = None, crowd: int = 2_000) -> DataFrame:
    """``docs`` with the repeated strings of ``remove_repeats`` cut out of the texts, and ``size_col`` counted anew where there is one.

    Characters that lose some of their bytes to a cut go wholly. No document goes; a text that lost
    everything is empty, a null text stays null. Ids may be null or repeat; all columns are kept.
    """
    starts = repeated_starts(docs, id_col, text_col, length, batches, crowd)
    row, mark = identity(F.col(id_col), F.col(text_col))
    marked = _with_starts(docs.withColumns({"__row": row, "__mark": mark}), starts).select(*(F.col(f"`{c}`") for c in docs.columns), "__starts")
    place, starts_at, kinds = docs.columns.index(text_col), len(docs.columns), docs.schema

    def run(part: pa.RecordBatch) -> dict[str, object]:
        texts = part.column(place).to_pylist()
        for i, runs in enumerate(_runs(part.column(starts_at), length)):
            if runs:
                data, at, left = texts[i].encode(), 0, []
                for lo, hi in runs:
                    left.append(data[at:lo].decode("utf-8", "ignore"))
                    at = hi
                texts[i] = "".join([*left, data[at:].decode("utf-8", "ignore")])
        out = {f.name: part.column(i) for i, f in enumerate(kinds)} | {text_col: pa.array(texts, pa.string())}
        if size_col in out:
            out[size_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field(size_col).type)
        return out

    return map_slices(marked, run, kinds)


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of the rows of ``remove_repeats``."""
    return cut.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every string of 200 bytes by its MD5, as hex digits cut from pieces of the texts.
ORACLE_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, b, substr(h, 1000 * b + 1, 1398) AS h, length(h) // 2 - 500 * b - 199 AS n FROM d, unnest(range(0, length(h) // 1000 + 1)) u(b)),
s AS MATERIALIZED (SELECT k, 500 * b + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM w, unnest(range(0, greatest(0, least(500, n)))) u(i)),
t AS (SELECT k, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
m AS (SELECT k, i, i > 200 + coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -1000) AS fresh FROM t),
r AS (SELECT k, run, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT k, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY k ORDER BY i) AS run FROM m) GROUP BY k, run),
g AS (SELECT k, run, hi, lo, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY k ORDER BY lo) IS NULL AS final FROM r),
c AS (SELECT g.k, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || coalesce(any_value(CASE WHEN final THEN substr(h, 2 * hi + 1) END), '') AS kept FROM g JOIN d USING (k) GROUP BY g.k)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (k)
"""
