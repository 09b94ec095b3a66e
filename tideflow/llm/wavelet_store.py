"""Token ids of a corpus as wavelet matrices, one compressed file for each shard."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, qualified, shared_dir

_MAGIC = b"TFWM0002"
#: Bits of a plane that are compressed together: 64 KB.
_CHUNK = 1 << 19
_SLICE_ROWS = 4096
#: Tails: any ASCII punctuation but the apostrophe, which may begin a contraction.
_WORD_AND_TAIL = r"""(?s)^(?P<word>.*?)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"""


class Plane:
    """A bit sequence in chunks of ``_CHUNK`` bits, with the ones before each chunk: rank and select look at one chunk."""

    def __init__(self, n: int, before: np.ndarray, fetch: Callable[[int], np.ndarray]):
        self.n, self.before, self.fetch = n, before, fetch  # fetch: the 64-bit words of a chunk
        self.ones = int(before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)
        counts = np.add.reduceat(np.bitwise_count(words), np.arange(0, len(words), _CHUNK // 64), dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        return cls(len(bits), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), lambda c: words[c * (_CHUNK // 64) : (c + 1) * (_CHUNK // 64)])

    def bits(self) -> np.ndarray:
        words = [self.fetch(c) for c in range(len(self.before) - 1)]
        return np.unpackbits(np.concatenate([np.zeros(0, np.uint64), *words]).view(np.uint8), count=self.n, bitorder="little").view(bool)

    def rank1(self, i: int) -> int:
        """Ones before position ``i``."""
        if i >= self.n:
            return self.ones
        chunk, at = divmod(i, _CHUNK)
        words, (word, bit) = self.fetch(chunk), divmod(at, 64)
        return int(self.before[chunk]) + int(np.bitwise_count(words[:word]).sum()) + (int(words[word]) & ((1 << bit) - 1)).bit_count()

    def bit(self, i: int) -> int:
        chunk, at = divmod(i, _CHUNK)
        return int(self.fetch(chunk)[at // 64]) >> (at % 64) & 1

    def select(self, bit: int, places: np.ndarray) -> np.ndarray:
        """Positions of the ``places``-th (from 0, ascending) ones or zeros."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * _CHUNK, self.n) - self.before
        chunk, out = np.searchsorted(before, places, "right") - 1, np.empty(len(places), np.int64)
        for c in np.unique(chunk).tolist():
            mine = chunk == c
            found = np.flatnonzero(np.unpackbits(self.fetch(c).view(np.uint8), count=min(_CHUNK, self.n - c * _CHUNK), bitorder="little") == bit)
            out[mine] = c * _CHUNK + found[places[mine] - before[c]]
        return out


class WaveletMatrix:
    """Bit planes of a sequence, highest bit first; each plane's zeros go before its ones for the next.

    ``access``, ``rank`` and ``locate`` take one or two chunks of each plane, wherever the planes are.
    """

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.bits = n, planes, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, x = [], np.ascontiguousarray(ids)
        for level in range(bits - 1, -1, -1):
            ones = (x & x.dtype.type(1 << level)) != 0
            planes.append(Plane.of(ones))
            x = np.concatenate([x[~ones], x[ones]])
        return cls(len(ids), planes)

    def ids(self, dtype: type = np.uint32) -> np.ndarray:
        """The whole sequence: the stable partitions undone from the lowest plane up."""
        x = np.zeros(self.n, dtype)
        for k in range(self.bits - 1, -1, -1):
            ones, back = self.planes[k].bits(), np.empty(self.n, dtype)
            zeros = self.n - self.planes[k].ones
            back[~ones] = x[:zeros]
            back[ones] = x[zeros:] | dtype(1 << (self.bits - 1 - k))
            x = back
        return x

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank1(i)
            i = self.n - plane.ones + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token >> self.bits:
            return 0, 0
        for k, plane in enumerate(self.planes):
            a, b = plane.rank1(lo), plane.rank1(hi)
            zeros = self.n - plane.ones
            lo, hi = (zeros + a, zeros + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs before position ``end``."""
        lo, hi = self._range(token, max(0, min(end, self.n)))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def locate(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        for k in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (self.bits - 1 - k) & 1
            at = self.planes[k].select(bit, at - (self.n - self.planes[k].ones) if bit else at)
        return at


def dump(ids: np.ndarray, doc_ids: pa.Array, lengths: list[int], bits: int, end_id: int | None = None) -> bytes:
    """A shard's file: magic, length of the header, header (JSON), rank directory, table of documents (Arrow, zstd), chunks of planes (zstd).

    The rank directory has for each plane the ones before each chunk, and for each chunk its bytes in the file.
    """
    matrix, pack = WaveletMatrix.build(ids, bits), zstandard.ZstdCompressor(level=1)
    sink = pa.BufferOutputStream()
    table = pa.record_batch({"id": doc_ids, "n_tokens": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    documents = pack.compress(sink.getvalue().to_pybytes())
    chunks = [[pack.compress(p.fetch(c).tobytes()) for c in range(len(p.before) - 1)] for p in matrix.planes]
    directory = np.concatenate([np.zeros(0, "<i8"), *(np.array([*p.before, *map(len, own)], "<i8") for p, own in zip(matrix.planes, chunks, strict=True))]).tobytes()
    head = json.dumps({"n": len(ids), "bits": bits, "chunk": _CHUNK, "end_id": end_id, "directory": len(directory), "documents": len(documents)}).encode()
    return b"".join([_MAGIC, struct.pack("<I", len(head)), head, directory, documents, *(c for own in chunks for c in own)])


class Shard:
    """A shard's file by ``read(offset, size)``: ``matrix`` reads the chunks that a question needs, ``documents()`` the table."""

    def __init__(self, read: Callable[[int, int], bytes]):
        start = read(0, 12)
        if start[:8] != _MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", start, 8)
        head = json.loads(read(12, size))
        if head["chunk"] != _CHUNK:
            raise ValueError(f"chunks of {head['chunk']} bits")
        self.read, self.n, self.end_id, self.table = read, head["n"], head["end_id"], (12 + size + head["directory"], head["documents"])
        n_chunks = -(-self.n // _CHUNK)
        directory = np.frombuffer(read(12 + size, head["directory"]), "<i8").reshape(head["bits"], 2 * n_chunks + 1)
        ends = sum(self.table) + np.cumsum(directory[:, n_chunks + 1 :]).reshape(head["bits"], n_chunks)

        def plane(k: int) -> Plane:
            sizes = directory[k, n_chunks + 1 :]

            @lru_cache(maxsize=2)
            def fetch(c: int) -> np.ndarray:
                return np.frombuffer(zstandard.ZstdDecompressor().decompress(read(int(ends[k, c] - sizes[c]), int(sizes[c]))), np.uint64)

            return Plane(self.n, directory[k, : n_chunks + 1], fetch)

        self.matrix = WaveletMatrix(self.n, [plane(k) for k in range(head["bits"])])

    def documents(self) -> pa.RecordBatch:
        """``(id, n_tokens)`` of the documents, in their order."""
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.read(*self.table))).read_all().combine_chunks()
        return table.to_batches()[0]


def load(data: bytes) -> Shard:
    """A shard from the bytes of its file."""
    return Shard(lambda at, size: data[at : at + size])


def open_shard(path: str) -> Shard:
    """A shard whose file is read by ranges."""
    fs, place = _filesystem(path)
    file = fs.open_input_file(place)
    return Shard(lambda at, size: file.read_at(size, at))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ChunkEncoder:
    """The tokenizers library over the distinct chunks between ASCII spaces, which no token of the vocabulary crosses.

    Closing punctuation is a token run of its own, so a chunk's ids are those of its word and of that
    run. Words of letters go to the library many at a time; each ends in a token that marks a word's end.
    """

    def __init__(self, path: str, known_cap: int = 300_000, joined: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocab.values()).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known_cap, self.joined = known_cap, joined
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, self.dtype).tobytes() for c in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        groups, out = [words[i : i + self.joined] for i in range(0, len(words), self.joined)], []
        for group, coded in zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, self.dtype)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) != len(group):  # a letter that is lower-cased to more than letters
                out += self._one_by_one(group)
                continue
            data, size, at = ids.tobytes(), ids.itemsize, 0
            for cut in (cuts * size).tolist():
                out.append(data[at:cut])
                at = cut
        return out

    def _packed(self, chunks: pa.StringArray) -> list[bytes]:
        """The packed ids of distinct chunks."""
        cut = pc.extract_regex(chunks, _WORD_AND_TAIL)
        word, tail = cut.field("word"), cut.field("tail").dictionary_encode()
        # Up to U+012F every letter has one letter as its lower case; words with others are left as they are.
        word = pc.if_else(pc.match_substring_regex(word, r"[^\x00-\x{12F}]"), word, pc.utf8_lower(word)).dictionary_encode()
        # U+0130 becomes more than a letter in lower case, and that would run into the tail.
        plain = pc.and_(pc.utf8_is_alpha(word.dictionary), pc.invert(pc.match_substring(word.dictionary, "\u0130"))).to_numpy(zero_copy_only=False).tolist()
        names, at = word.dictionary.to_numpy(zero_copy_only=False).tolist(), word.indices.to_numpy().tolist()
        tails, tail_at = tail.dictionary.to_pylist(), tail.indices.to_numpy().tolist()
        known, former = self.known, self.former
        new = [w for w, p in zip(names, plain, strict=True) if p and w not in known]
        old = [w for w in new if w in former]
        known.update(zip(old, map(former.__getitem__, old), strict=True))
        if old:
            new = [w for w in new if w not in known]
        known.update(zip(new, self._words(new), strict=True))
        whole = [k for k, i in enumerate(at) if not plain[i]]
        others = [chunks[k].as_py() for k in whole]
        new = [c for c in {*others, *tails} if c not in known]
        known.update(zip(new, self._one_by_one(new), strict=True))
        ids, ends = [known[w] if p else b"" for w, p in zip(names, plain, strict=True)], [known[t] for t in tails]
        out = [ids[i] + ends[k] for i, k in zip(at, tail_at, strict=True)]
        for k, c in zip(whole, others, strict=True):
            out[k] = known[c]
        if len(known) > self.known_cap:
            self.former, self.known = known, {}
        return out

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The packed ids of each text: split into chunks, coded by distinct chunk, and put together again."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        packed, at = self._packed(coded.dictionary), coded.indices.to_numpy()
        size = np.dtype(self.dtype).itemsize
        pool, sizes = np.frombuffer(b"".join(packed), self.dtype), np.fromiter(map(len, packed), np.int64, len(packed)) // size
        begins = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[at]) if len(at) else np.zeros(0, np.int64)
        before = np.concatenate([[0], ends])
        ids = pool[np.repeat(begins[at] - before[:-1], sizes[at]) + np.arange(before[-1])] if len(at) else pool[:0]
        cuts, data = (before[chunks.offsets.to_numpy()] * size).tolist(), ids.tobytes()
        return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_shards(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 1, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode whole texts and write their ids in ascending ``id_col`` order; returns the manifest.

    The texts are range-partitioned by id and sorted; each task cuts its run of documents into shards
    of about ``shard_tokens`` ids and writes each to a file of ``out_dir`` (a folder that all executors
    share, by default under ``spark.checkpoint.dir``), under its final name only once it is whole, so a
    task that runs again does no harm. Manifest: ``(part, seq, path, n_docs, n_tokens)``, and ``start``,
    the ids in all shards before. A document is never split. Null texts count as empty and get the end
    id alone; rows with a null id come first; repeated ids are kept, in the order of a hash of their texts,
    so that they can be dealt out; an empty table writes no file. A text is taken whole, however long, and
    lies in one shard, which it may make larger. Other columns are ignored.
    """
    spark = docs.sparkSession
    out_dir = qualified(spark, out_dir or shared_dir(spark))  # as Spark reads it, for those who don't ask Spark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        ids, held, held_tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{out_dir}/shard-{part:06d}-{seq:05d}.wm"
            lengths = [len(x) // np.dtype(coder.dtype).itemsize for x in held]
            data = dump(np.frombuffer(b"".join(held), coder.dtype), pa.concat_arrays(ids), lengths, coder.bits, end_id)
            fs, place = _filesystem(path)
            fs.create_dir(os.path.dirname(place), recursive=True)
            temporary = f"{place}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, place)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": [len(held)], "n_tokens": [sum(lengths)]})

        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE_ROWS):
                rows = batch.slice(lo, _SLICE_ROWS)
                coded, at = [x + end for x in coder.encode(rows.column(1))], 0
                while at < len(coded):
                    to = at
                    while to < len(coded) and held_tokens < shard_tokens:
                        held_tokens += len(coded[to]) // np.dtype(coder.dtype).itemsize
                        to += 1
                    ids.append(rows.column(0).slice(at, to - at))
                    held += coded[at:to]
                    at = to
                    if held_tokens >= shard_tokens:
                        yield flush()
                        ids, held, held_tokens, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = src.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    manifest = materialise(ordered.mapInArrow(run, "part int, seq int, path string, n_docs bigint, n_tokens bigint"))
    # Running totals in two steps, so that one task sees one row for each partition and not for each shard.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("part_start") + F.col("inside")).drop("inside", "part_start")


def read_documents(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the shards' files alone.

    A file that holds fewer end ids than documents, which its planes tell by rank, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _filesystem(path)
                with fs.open_input_stream(place) as f:
                    shard = load(f.read())
                matrix, table = shard.matrix, shard.documents()
                if shard.end_id is not None and matrix.count(shard.end_id) < table.num_rows:
                    raise ValueError(f"{path} is damaged")
                narrow = np.uint16 if matrix.bits <= 16 else np.uint32
                ids, lengths = matrix.ids(narrow), table.column(1).to_numpy()
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"id": table.column(0), "start": pa.array(start + ends - lengths), "n_tokens": table.column(1), "ids_crc32": pa.array(sums, pa.int64())})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("path", "start").repartition(n, "path")  # a number, or few small rows would go to one task
    return spread.mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)
