"""Near-duplicate documents by SimHash over word shingles."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, identity, join_spread, map_slices, materialise, utf8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)
#: The 14 sets of four byte positions whose numbers cancel out: any three positions are in exactly one of them.
_FOURS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: So many of them lie within six positions; within five lies one, within four at most one.
_LEAST_SHARED = 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, as an unsigned integer; 0 for a text without words (null too)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    tally = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = tally @ _BITS  # by byte and bit
    return int(np.packbits((2 * ones > n).astype(np.uint8).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, row, mark, fp BIGINT)`` for every document; ``row`` and ``mark`` tell it from others (``identity``)."""

    def run(part: pa.RecordBatch) -> dict[str, object]:
        values = [_signed(fingerprint(t, shingle, seed)) for t in utf8(part.column(3))]
        return {"id": part.column(0), "row": part.column(1), "mark": part.column(2), "fp": pa.array(values, pa.int64())}

    kind = docs.schema[id_col].dataType.simpleString()
    row, mark = identity(F.col(id_col), F.col(text_col))
    return map_slices(docs.select(F.col(id_col).alias("id"), row.alias("row"), mark.alias("mark"), F.col(text_col).alias("text")), run, f"id {kind}, row bigint, mark bigint, fp bigint")


def links(distinct: DataFrame, max_bits: int = 2, posting_cap: int = 64) -> DataFrame:
    """Edges ``(a, b)`` with the connectivity of all pairs of ``distinct(fp)`` within ``max_bits`` (2) bits.

    Two fingerprints at 2 bits or fewer share at least 6 of their 8 positional bytes. The inverted
    index posts each fingerprint under its bytes at 14 sets of four positions, chosen so that two
    fingerprints meet in 3 postings or more exactly if they share 6 positional bytes or more. The
    postings that each pair shares are counted, pairs below 3 dropped, and the rest verified by their
    differing bits. (Lists of single positional bytes would hold a 256th of all fingerprints each.)

    A list of over ``posting_cap`` members is not paired: its pairs would grow with the square. The index
    holds such members once more, under their 65 bit patterns at distance 0 and 1: two fingerprints are
    within 2 bits exactly if they share such a pattern, and all that share one are linked, so one edge to
    the smallest suffices, at 65 rows for each member whatever the size of the list. Nothing is lost
    between the two: a linked pair that meets in a long list is found there, as both are members, and of
    any other all shared postings are counted. The cap moves work from one to the other, never a result.
    """
    if max_bits != 2:
        raise ValueError("postings and patterns are laid out for two bits")
    masks = [_signed(sum(0xFF << (8 * i) for i in c)) for c in _FOURS]
    posts = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("p")).select("fp", "p.c", "p.k")
    lists = posts.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(posts.join(lists, ["c", "k"]))
    short = met.where(F.col("n") <= posting_cap).drop("n")
    pairs = short.alias("x").join(short.alias("y"), ["c", "k"]).where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    tallied = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= _LEAST_SHARED)
    verified = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowd = met.where(F.col("n") > posting_cap).select("fp").distinct()
    patterns = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    hubs = crowd.select("fp", F.explode(patterns).alias("hub"))
    heads = hubs.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starred = hubs.join(heads, "hub").where("fp != b").select(F.col("fp").alias("a"), "b")
    return verified.unionByName(starred).distinct()


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, posting_cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with ``(id, row, mark, fp, nth)``; each fingerprint with its ``label``, the component's fingerprint; each fingerprint's rows ``n``."""
    printed = materialise(fingerprints(docs, id_col, text_col, shingle).withColumn("nth", F.monotonically_increasing_id()))
    nodes = materialise(printed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = components(links(nodes.select("fp"), max_bits, posting_cap)).withColumnRenamed("node", "fp")
    rooted = materialise(nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    return printed, rooted, nodes.select("fp", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, posting_cap: int = 64) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links of ``max_bits`` or fewer
    differing bits. Equal fingerprints are one node of the link graph. Null, empty and word-free
    texts have fingerprint zero and are linked like any other; repeated rows come out repeatedly;
    a null id never is a component's id unless no other is there; an empty table gives no rows. A text
    is taken whole, however long, and is held once in a task with 8 bytes for each of its words; other
    columns are ignored.
    """
    printed, rooted, sizes = _classed(docs, id_col, text_col, shingle, max_bits, posting_cap)
    roots = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(roots, "label").select("fp", "component_id")
    return join_spread(printed, of_print, ["fp"], sizes, "nth").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, posting_cap: int = 64) -> DataFrame:
    """``docs`` with exactly one row of each component: that with the smallest id, a null id after all others.

    Of several rows with that id the one with the smallest hash of id and text stays, and of rows equal in
    both any one. All columns are kept; an empty table stays empty.
    """
    printed, rooted, sizes = _classed(docs, id_col, text_col, shingle, max_bits, posting_cap)
    each = join_spread(printed, rooted.select("fp", "label"), ["fp"], sizes, "nth")
    first = each.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "mark")).alias("first"))
    winners = first.select(F.col("first.row").alias("__row"), F.col("first.mark").alias("__mark"))
    row, mark = identity(F.col(id_col), F.col(text_col))
    # Rows equal in id and text are thinned out before they are shuffled, so none of them can crowd a task.
    order = F.row_number().over(Window.partitionBy("__row", "__mark").orderBy("__row"))
    single = docs.withColumns({"__row": row, "__mark": mark}).withColumn("__n", order).where("__n = 1")
    return single.join(winners, ["__row", "__mark"], "left_semi").select(*docs.columns)
