"""BPE as a deterministic automaton over tokens, compiled from the merges of a byte-level tokenizer file."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Fixed: the pre-split of byte-level tokenizers.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD = regex.compile(r"[^\S \n]|[\0\x1c-\x1f]")
_NEVER = 1 << 40


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: themselves where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """States are the tokens that may come last; arcs are labelled with tokens, each with its bytes.

    It starts as one state with a loop for each byte. Every merge (a, b) at its rank adds a gadget: a
    state and arcs for ab, and no arc b any longer from a state that ends in an open a. A state ends
    in its token and in the right parts of that, each open until the rank that joined it; an arc
    begins with its token and the left parts of that. An arc is thus barred from a state if one of
    the gadgets joins an open end with an open beginning. Of all token sequences with the bytes of a
    word, the automaton accepts exactly the one that merging in rank order gives.

    Arcs are tabulated when first asked for: the full table has a cell for each pair of tokens.
    """

    def __init__(self, path: str, cache_size: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char, model = _byte_of_char(), spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.labels[i] = bytes(of_char[c] for c in t) if t not in self.special else t.encode()
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.cache_size, self.known, self.former, self.arcs = cache_size, {}, {}, {}
        self.gadgets: dict[int, int] = {}  # a, b -> rank
        n = len(self.labels)
        self.ends: list[tuple] = [((i, _NEVER),) for i in range(n)]  # open ends: (token, rank that closes it)
        self.begins: list[tuple] = [((i, _NEVER),) for i in range(n)]
        self.start: dict[bytes, int] = {self.labels[i]: i for t, i in vocab.items() if len(t) == 1}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self._add_gadget(vocab[a], vocab[b], vocab[a + b], rank)
        self.trie = ahocorasick.Automaton()  # of the labels, a character for each byte
        self.longest: dict[str, int] = {}  # by path in the trie: the longest token that begins it
        self.shorter = [-1] * n
        for label, i in sorted(self.start.items()):  # prefixes come first
            text, best = label.decode("latin-1"), -1
            for k in range(1, len(text)):
                best = self.longest.setdefault(text[:k], best)
            self.shorter[i], self.longest[text] = best, i
            self.trie.add_word(text, i)
        self.widths = [len(x) for x in self.labels]
        self.reach = max(self.widths)  # no label is longer

    def _add_gadget(self, a: int, b: int, ab: int, rank: int) -> None:
        made = self.labels[a] in self.start and self.labels[b] in self.start and self._open(a, b)
        self.gadgets.setdefault(a << 20 | b, rank)
        if made and self.labels[ab] not in self.start:  # else its bytes are merged in another way before
            self.start[self.labels[ab]] = ab
            self.ends[ab] = ((ab, _NEVER), *((t, min(r, rank)) for t, r in self.ends[b]))
            self.begins[ab] = ((ab, _NEVER), *((t, min(r, rank)) for t, r in self.begins[a]))

    def _open(self, u: int, v: int) -> bool:
        ranks = self.gadgets
        for x, closed in self.ends[u]:
            for y, joined in self.begins[v]:
                r = ranks.get(x << 20 | y)
                if r is not None and r < closed and r <= joined:  # of equal ranks, the left one goes first
                    return False
        return True

    def encode_piece(self, word: bytes) -> list[int]:
        """The tokens of one pre-split piece: its only accepted path, sought by backtracking, longest arcs first.

        A prefix has one accepted path too, so a position from which no arc leads on is no boundary, and
        is not tried again.
        """
        text = word.decode("latin-1")
        n, path, dead, reach = len(text), [], None, self.reach
        matched, longest, arcs, shorter, widths = self.trie.longest_prefix, self.longest, self.arcs, self.shorter, self.widths
        at, state, arc = 0, -1, None
        while at < n:
            if arc is None:
                rest = text[at : at + reach]
                arc = longest.get(rest[: matched(rest)], -1)
            while arc >= 0:
                if dead is None or at + widths[arc] not in dead:
                    if state < 0:
                        break
                    ok = arcs.get(state << 20 | arc)
                    if ok is None:
                        if len(arcs) > 500_000:
                            arcs.clear()
                        ok = arcs[state << 20 | arc] = self._open(state, arc)
                    if ok:
                        break
                arc = shorter[arc]
            if arc >= 0:
                path.append(arc)
                at, state, arc = at + widths[arc], arc, None
                continue
            if not path:
                raise ValueError("no path: a byte is missing from the vocabulary")
            dead = dead or set()
            dead.add(at)
            last = path.pop()
            at, arc, state = at - widths[last], shorter[last], path[-1] if path else -1
        return path

    def _chunk(self, chunk: str) -> bytes:
        known, pieces = self.known, _PIECES.findall(chunk)
        if len(pieces) == 1:
            return array("I", self.encode_piece(chunk.encode())).tobytes()
        return b"".join([known.get(p) or self._learn(p) for p in pieces])

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk or piece that is not among the known; kept for two generations of ``cache_size`` entries."""
        ids = self.former.get(chunk) or self._chunk(chunk)
        if len(chunk) < 60:
            if len(self.known) >= self.cache_size:
                self.former = dict(self.known)
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Cut at single spaces and line ends between other characters, where pieces always begin."""
        if _ODD.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
            return self._chunk(text)
        get, learn = self.known.get, self._learn
        chunks = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join([get(c) or learn(c) for c in chunks])

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text. The strings of special tokens in it become those tokens."""
        parts, done = [text or ""], []
        if any(t in parts[0] for t in self.special):
            cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            parts = cut.split(parts[0])
        for p in parts:
            if p in self.special:
                done.append(np.array([self.special[p]], np.uint32).tobytes())
            elif p:
                done.append(self._plain(p))
        return np.frombuffer(b"".join(done), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """One for each worker process; compiling takes about a second."""
    return Automaton(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, ids ARRAY<INT>, decoded)`` of every whole text: its token ids, and the text decoded from those.

    Columns named in ``keep`` are passed on.

    ``path``: a byte-level BPE file of the tokenizers library, readable on every executor. Null and
    empty texts have no ids and decode to the empty text. Rows are mapped one by one, without a
    shuffle: repeated rows repeat, an empty table stays empty. A text is taken whole, however long. Other
    columns are left out; ``keep`` must not name the id, ``ids`` or ``decoded``, which is an error.
    """
    if clash := {id_col, "ids", "decoded"} & set(keep):
        raise ValueError(f"keep names {', '.join(sorted(clash))}")

    def run(part: pa.RecordBatch) -> dict[str, object]:
        auto = automaton(path)
        ids = [auto.encode(t) for t in part.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
        return {"__id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), values), "decoded": pa.array([auto.decode(x) for x in ids], pa.string())} | {c: part.column(2 + i) for i, c in enumerate(keep)}

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keep)
    passed = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return map_slices(src, run, f"__id {kinds[id_col]}, ids array<int>, decoded string{passed}").withColumnRenamed("__id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of the rows of ``encode_decode``."""
    return coded.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
