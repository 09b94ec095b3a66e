"""Document quality rules with verdicts on whole hosts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identity, join_spread, map_slices, materialise, utf8

_SPACES = [32, *range(9, 14)]
_SYMBOLS = list(b"#*$%&|<>")
_WINDOW = 8
_MIX = np.random.default_rng(5).integers(1, 2**63, _WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur at least twice."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for j in range(_WINDOW):
        windows += hashes[j : j + n] * _MIX[j]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Equal windows hash alike. Those that hash alike are told apart by the numbers of their words, a hash at a time.
    starts = np.flatnonzero(np.isin(windows, twice))
    starts = starts[np.argsort(windows[starts], kind="stable")]
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    same = np.ones(len(starts) - 1, bool)
    for j in range(_WINDOW):
        same &= numbers[starts[1:] + j] == numbers[starts[:-1] + j]
    covered = np.zeros(len(words) + 1, np.int64)
    if (same == (windows[starts[1:]] == windows[starts[:-1]])).all():
        again = np.zeros(len(starts), bool)
        again[1:] |= same
        again[:-1] |= same
        starts = starts[again]
    else:  # two windows with one hash: by their words
        times = Counter(tuple(numbers[i : i + _WINDOW].tolist()) for i in starts.tolist())
        starts = np.array([i for i in starts.tolist() if times[tuple(numbers[i : i + _WINDOW].tolist())] > 1], np.int64)
    covered[starts] += 1
    np.add.at(covered, starts + _WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    data = text or b""
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_chars = len(data) - int(seen[0x80:0xC0].sum()) - int(seen[_SPACES].sum())
    return len(words), word_chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeated_words(words)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, host, row, mark, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of whole texts; a null text counts as empty.

    ``row`` and ``mark`` tell rows apart that differ in id, text or host.
    """

    def run(part: pa.RecordBatch) -> dict[str, object]:
        rows = [_counts(t) for t in utf8(part.column(4))]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {n: part.column(i) for i, n in enumerate(("id", "host", "row", "mark"))} | {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, host_col)}
    row, mark = identity(F.col(id_col), F.col(text_col), F.col(host_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), row.alias("row"), mark.alias("mark"), F.col(text_col).alias("text"))
    return map_slices(src, run, f"id {kinds[id_col]}, host {kinds[host_col]}, row bigint, mark bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint")


def host_verdicts(judged: DataFrame, max_rate: float = 0.5, max_weight: float = 1e6) -> DataFrame:
    """``(host, n_docs, n_failed, host_rate, host_rejected)`` of ``judged(host, base_failed)``.

    The failure rates of all hosts give a beta prior by moments: its mean is the overall rate, its
    weight is what the spread between hosts leaves after binomial noise. Each host's rate is shrunk
    to the prior mean by that weight; a host is rejected where the shrunk rate is over ``max_rate``.
    One host alone, or hosts no further apart than noise, get ``max_weight``: all have the mean rate.
    """
    hosts = materialise(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")))
    all_docs, all_failed, n_hosts = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count(F.lit(1))).first()
    if not all_docs:
        return hosts.select("*", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_rejected"))
    mean = all_failed / all_docs
    spread = hosts.agg(F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - mean, 2))).first()[0] / all_docs
    between = spread - mean * (1 - mean) * (n_hosts - 1) / all_docs
    weight = min(max_weight, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else max_weight
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.5) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, its host's shrunk rate, ``kept``, and ``row`` and ``mark``, which identify it.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_percent`` % of words in repeated
    windows of eight. ``kept``: neither that nor a rejected host. A null text has no words and so
    fails; a null host is a host of its own; repeated rows each count; an empty table gives no rows. A
    text is taken whole, however long: its words are held once and 8 bytes for each window. Other columns
    are ignored.
    """
    counted = document_counts(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = materialise(counted.withColumn("base_failed", failed))
    # A key without nulls; rows of a large host are dealt out.
    of_host = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")).alias("of_host")
    hosts = materialise(host_verdicts(judged, max_host_rate).select(of_host, "host_rate", "host_rejected", F.col("n_docs").alias("n")))
    told = join_spread(judged.withColumns({"of_host": of_host, "nth": F.monotonically_increasing_id()}), hosts.drop("n"), ["of_host"], hosts.select("of_host", "n"), "nth")
    return told.select(
        F.col("id").alias(id_col), F.col("host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "row", "mark")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """``docs`` without the rows whose verdict is not ``kept``.

    Each row by its own verdict: a good row stays where a bad one shares its id, or both ids are null.
    """
    bad = judge(docs, id_col, text_col, host_col, **options).where("NOT kept").select(F.col("row").alias("__row"), F.col("mark").alias("__mark"))
    rejected, keys = materialise(bad.groupBy("__row", "__mark").agg(F.count(F.lit(1)).alias("n"))), ["__row", "__mark"]
    row, mark = identity(F.col(id_col), F.col(text_col), F.col(host_col))
    marked = docs.withColumns({"__row": row, "__mark": mark, "__nth": F.monotonically_increasing_id()})
    return join_spread(marked, rejected.select(*keys), keys, rejected, "__nth", "left_anti").select(*docs.columns)


#: DuckDB; the thresholds are those of ``judge``.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
s AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w),
g AS (SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram FROM s),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS k FROM t WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY source),
m AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, count(*) AS hosts FROM h),
v AS (SELECT any_value(m.mean) AS mean, sum(h.n * pow(h.f / h.n - m.mean, 2)) / any_value(m.n) - any_value(m.mean * (1 - m.mean) * (m.hosts - 1) / m.n) AS between_var FROM h, m),
p AS (SELECT mean, CASE WHEN between_var > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / between_var - 1)) ELSE 1e6 END AS weight FROM v),
x AS (SELECT source, (f + mean * weight) / (n + weight) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
