"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Each
document's signature holds each of its terms once for each level: level j where the term occurs 2^j times or
more. Documents of like size are kept in blocks of one signature width, sliced by bit: a row of bits over
the documents for each bit of the signature.

A term is possibly in those documents where all of its slices are set, which is never too few. The sum of the
weights of the possible terms, level by level, times what a level can add to a score, is an upper bound of the
score. The documents with the highest bounds are scored exactly; the least of their best ``top`` scores is
a threshold, and every document whose bound reaches it is scored exactly, too. So the result is exact,
whatever the width of the signatures.

Score of a document for an item: the sum over the item's terms, repeats included, of
``w * ((10^9 * tf) div (1000 * tf + 12 * m))``, where w is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, m is
``75 + (25 * n * N) div L``, N counts the documents with a term, L all their terms, n those of the document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, identity, materialise

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_LEVEL = 0x9E3779B97F4A7C15
BITS_PER_ENTRY, PROBES = 12, 5
_BLOCK_BITS = 8 << 20
_MAX_TERMS = 2_000_000
_ITEMS_AT_ONCE = 1_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in their order; none for null."""
    return (text or b"").translate(_TERM_BYTES).split()


def _hash(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def _bits(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits of a signature of ``width`` that stand for each term at a level, ``PROBES`` columns."""
    h = _mixed(hashes + np.uint64(level * _LEVEL % 2**64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(width)).astype(np.int64)


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * n * n_docs) // max(n_terms, 1)


def saturation(tf: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written once: blocks of signatures, and how many documents hold each term of ``vocabulary``.

    A row is a block (``width``, ``levels``, the documents' ``ids``, ``row`` and ``mark`` of each by
    ``identity``, the ``text_row`` and ``text_mark`` of its text alone, its number of terms ``n``, and the
    slices) or the counts of a task (``n_docs``, ``n_terms``, ``places`` in the vocabulary and their ``df``).
    Documents without terms are in neither. Blocks hold 8 to 4,096 documents and about a megabyte.
    """
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        df, n_docs, n_terms, kind = np.zeros(len(vocabulary), np.int64), 0, 0, None

        def row(**columns: object) -> pa.RecordBatch:
            types = {"width": pa.int32(), "levels": pa.int32(), "ids": pa.list_(kind), **{c: pa.list_(pa.int64()) for c in ("rows", "marks", "text_rows", "text_marks", "n")}, "slices": pa.binary(),
                     "n_docs": pa.int64(), "n_terms": pa.int64(), "places": pa.list_(pa.int32()), "df": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], t) for c, t in types.items()], names=list(types))

        def block(size: int) -> pa.RecordBatch:
            found = waiting.pop(size)
            width, count = BITS_PER_ENTRY << size, len(found)
            bits, levels = np.zeros((width, count), np.uint8), max(len(f[6]) for f in found)
            for j in range(levels):
                at = [(k, f[6][j]) for k, f in enumerate(found) if len(f[6]) > j]
                hashes = np.concatenate([h for _, h in at])
                owner = np.repeat([k for k, _ in at], [len(h) for _, h in at])
                bits.ravel()[(_bits(hashes, j, width) * count + owner[:, None]).ravel()] = 1
            ids, rows, marks, text_rows, text_marks, n = (list(c) for c in list(zip(*found, strict=True))[:6])
            return row(width=width, levels=levels, ids=ids, rows=rows, marks=marks, text_rows=text_rows, text_marks=text_marks, n=n, slices=np.packbits(bits, axis=1).tobytes())

        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(5)), strict=True))
                for key, text in zip(keys, part.column(5).cast(pa.binary()).to_pylist(), strict=True):
                    counts = Counter(terms(text))
                    if not counts:
                        continue
                    tf = np.fromiter(counts.values(), np.int64, len(counts))
                    n = int(tf.sum())
                    n_docs, n_terms = n_docs + 1, n_terms + n
                    for t in counts.keys() & place.keys():
                        df[place[t]] += 1
                    hashes, levels = _hash(list(counts)), []
                    while len(hashes):
                        levels.append(hashes)
                        more = tf >= 1 << len(levels)
                        hashes, tf = hashes[more], tf[more]
                    size = max(3, (sum(map(len, levels)) - 1).bit_length())
                    waiting.setdefault(size, []).append((*key, n, levels))
                    if len(waiting[size]) >= min(4096, max(8, _BLOCK_BITS // (BITS_PER_ENTRY << size))):
                        yield block(size)
        while waiting:
            yield block(next(iter(waiting)))
        if n_docs:
            seen = np.flatnonzero(df)
            yield row(n_docs=n_docs, n_terms=n_terms, places=seen.tolist(), df=df[seen].tolist())

    kind = docs.schema[id_col].dataType.simpleString()
    (row, mark), (text_row, text_mark) = identity(F.col(id_col), F.col(text_col)), identity(F.lit(None).cast("int"), F.col(text_col))
    ready = docs.select(F.col(id_col).alias("id"), row.alias("row"), mark.alias("mark"), text_row.alias("text_row"), text_mark.alias("text_mark"), F.col(text_col).alias("text"))
    lists = ", ".join(f"{c} array<bigint>" for c in ("rows", "marks", "text_rows", "text_marks", "n"))
    return materialise(ready.mapInArrow(run, f"width int, levels int, ids array<{kind}>, {lists}, slices binary, n_docs bigint, n_terms bigint, places array<int>, df array<bigint>"))


class Queries:
    """Items as weighted terms: ``weights[i]`` of the terms at ``places[i]`` in ``hashes``."""

    def __init__(self, items: list[list[bytes]], weight: dict[bytes, int]) -> None:
        known = sorted({t for item in items for t in item if weight.get(t)})
        self.terms, at = known, {t: i for i, t in enumerate(known)}
        self.hashes, self.weight = _hash(known), np.array([weight[t] for t in known], np.int64)
        counted = [Counter(t for t in item if t in at) for item in items]
        self.places = [np.array([at[t] for t in c], np.int64) for c in counted]
        self.weights = [np.array([n * weight[t] for t, n in c.items()], np.int64) for c in counted]

    def bounds(self, slices: bytes, width: int, levels: int, m: np.ndarray) -> Iterator[np.ndarray]:
        """For each item the upper bounds of the scores of a block's documents."""
        count = len(m)
        rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
        gains = [saturation(1, m)] + [saturation((2 << j) - 1, m) - saturation((1 << j) - 1, m) for j in range(1, levels)]
        possible, left = [], np.arange(len(self.hashes))
        for j in range(levels):
            each = np.bitwise_and.reduce(rows[_bits(self.hashes[left], j, width)], axis=1)
            if possible:
                each &= possible[-1][1][possible[-1][0][left]]
            some = each.any(axis=1)
            left, slot = left[some], np.full(len(self.hashes), -1)
            slot[left] = np.arange(len(left))
            possible.append((slot, each[some]))
        for places, weights in zip(self.places, self.weights, strict=True):
            total = np.zeros(count, np.int64)
            for gain, (slot, each) in zip(gains, possible, strict=True):
                at = slot[places]
                if not (at >= 0).any():
                    break
                # Sums of weights are whole numbers far below 2^53.
                sums = weights[at >= 0].astype(float) @ np.unpackbits(each[at[at >= 0]], axis=1, count=count)
                total += sums.astype(np.int64) * gain
            yield total


def _candidates(index: DataFrame, queries: Queries, n_docs: int, n_terms: int, kind: str, top: int, least: np.ndarray | None) -> DataFrame:
    """``(item, id, row, mark, text_row, text_mark, bound)``: the ``top`` highest bounds of each item within a task, or all from ``least`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        id_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int32(), id_type, *[pa.int64()] * 5)
            names = ["item", "id", "row", "mark", "text_row", "text_mark", "bound"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                block = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                n = np.array(block["n"].as_py(), np.int64)
                keys, rows = [block[c].values for c in ("ids", "rows", "marks", "text_rows", "text_marks")], []
                for item, bound in enumerate(queries.bounds(block["slices"].as_py(), block["width"].as_py(), block["levels"].as_py(), length_factor(n, n_docs, n_terms))):
                    if least is not None:
                        chosen = np.flatnonzero(bound >= least[item])
                    else:
                        chosen = np.argpartition(-bound, top - 1)[:top] if len(bound) > top else np.arange(len(bound))
                        floor = best[item][-1][-1] if len(best.get(item, ())) == top else 0
                        chosen = chosen[bound[chosen] > floor]
                    if len(chosen):
                        found = list(zip([item] * len(chosen), *(c.take(pa.array(chosen)).to_pylist() for c in keys), bound[chosen].tolist(), strict=True))
                        if least is not None:
                            rows += found
                        else:
                            best[item] = sorted([*best.get(item, ()), *found], key=lambda r: -r[-1])[:top]
                    if len(rows) >= 8192:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)
        if best:
            yield out([r for found in best.values() for r in found])

    blocks = index.where("width IS NOT NULL").select("width", "levels", "ids", "rows", "marks", "text_rows", "text_marks", "n", "slices")
    return blocks.mapInArrow(run, f"item int, id {kind}, row bigint, mark bigint, text_row bigint, text_mark bigint, bound bigint")


_TEXT, _ROW = ["text_row", "text_mark"], ["row", "mark"]


def _scored(found: DataFrame, docs: DataFrame, queries: Queries, n_docs: int, n_terms: int, id_col: str, text_col: str) -> DataFrame:
    """``(item, text_row, text_mark, score)`` of the texts of ``found``, each text read once and scored for all its items."""
    row, mark = identity(F.col(id_col), F.col(text_col))
    # One row of each text; the items of a text are as many as there are items at most.
    wanted = found.groupBy(*_TEXT).agg(F.min(F.struct(*_ROW)).alias("one"), F.collect_set("item").alias("items")).select("one.*", *_TEXT, "items")
    texts = docs.select(row.alias("row"), mark.alias("mark"), F.col(text_col).alias("text")).join(wanted, _ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part, rows = batch.slice(lo, SLICE_ROWS), []
                for text_row, text_mark, text, items in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                    counts = Counter(terms(text))
                    m = int(length_factor(np.int64(sum(counts.values())), n_docs, n_terms))
                    for item in items:
                        score = sum(int(w) * saturation(counts[queries.terms[p]], m) for p, w in zip(queries.places[item], queries.weights[item], strict=True) if queries.terms[p] in counts)
                        rows.append((item, text_row, text_mark, score))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)], names=["item", *_TEXT, "score"])

    scores = texts.select(*_TEXT, "text", "items").mapInArrow(run, "item int, text_row bigint, text_mark bigint, score bigint")
    return scores.groupBy("item", *_TEXT).agg(F.max("score").alias("score"))  # a row that is repeated is scored as often


def _foremost(rows: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group; all others go before the shuffle, but for that many a task."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= top).drop("__k")


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, id, score)``: the ``top`` documents with the highest scores above 0 for each different row of ``items``.

    Equal scores are ranked by ascending id, null last. Documents and items without a term (null texts too)
    are in no result; repeated documents each have a rank of their own, repeated items one result. Copies
    of a text are scored once, and only the ``top`` smallest ids of a text can be in a result.

    Items are taken to the tasks, a thousand at a time, with their terms, of which there may be two million;
    more are an error, and are to be searched for in several calls.
    """
    spark, kind, item_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = [(r[0], terms(r[1].encode())) for r in items.select(item_col, item_text_col).where(F.col(item_text_col).isNotNull()).distinct().toLocalIterator()]
    vocabulary = sorted({t for _, found in asked for t in found})
    if len(vocabulary) > _MAX_TERMS:
        raise ValueError(f"the items have {len(vocabulary)} terms, more than {_MAX_TERMS}; search for fewer at a time")
    index = build_index(docs, vocabulary, id_col, text_col)
    totals = index.where("n_docs IS NOT NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    counted = index.where("n_docs IS NOT NULL").select(F.explode(F.arrays_zip("places", "df"))).select("col.*").groupBy("places").agg(F.sum("df").alias("df"))
    df = {r.places: r.df for r in counted.toLocalIterator()}  # terms of the vocabulary
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i, t in enumerate(vocabulary) if i in df}
    results, by_text = None, [F.asc_nulls_last("id"), *_ROW]
    for lo in range(0, max(len(asked), 1), _ITEMS_AT_ONCE):
        chunk = asked[lo : lo + _ITEMS_AT_ONCE]
        queries = Queries([found for _, found in chunk], weight)
        given = (queries, n_docs, n_terms)
        likely = materialise(_foremost(_candidates(index, *given, kind, top, None), ["item"], [F.desc("bound"), *by_text], top))
        exact = likely.join(_scored(likely, docs, *given, id_col, text_col), ["item", *_TEXT]).where("score > 0")
        # At most a thousand numbers.
        enough = {r.item: r.least for r in exact.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).toLocalIterator()}
        least = np.array([enough.get(i, 1) for i in range(len(chunk))], np.int64)
        possible = materialise(_foremost(_candidates(index, *given, kind, top, least), ["item", *_TEXT], by_text, top))
        scored = possible.join(_scored(possible, docs, *given, id_col, text_col), ["item", *_TEXT]).where("score > 0")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *by_text))
        named = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(chunk)], f"item int, item_id {item_kind}")
        ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(named), "item").select("item_id", "rank", "id", "score")
        results = ranked if results is None else results.unionByName(ranked)
    return results


ORACLE_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf, any_value(CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1))) AS BIGINT)) AS w FROM i JOIN d USING (term), c GROUP BY item_id, term),
m AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM n, c),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
