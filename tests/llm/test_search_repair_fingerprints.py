"""Lexical search, conversation repair and fingerprints against brute-force versions, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tideflow.llm import bit_sliced_search, conversation_repair, minhash, queries  # noqa: E402

WORDS = "the of and shore river lantern über élan ñandú 漢字 stone, cloud. keep! 3.5 don't I'll -- ***".split()
SCHEMA = "doc_id long, text string, row long, mark long, item string, fingerprint string, level long, kind string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x", "y", 2, "z") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage = make(50)
    rows = [(100 - i, t) for i, t in enumerate([None, "", " \n\t ", "--- ***", "one", "One two", make(40), make(40), passage, f"{make(9)} {passage}", make(4000), "the " * 700])]
    rows += [(200 + i, passage) for i in range(30)] + [(None, passage), (None, None), (7, "copy of one"), (7, "copy of one"), (7, "another of seven")]
    rows += [(1000 + i, make(rng.randint(1, 90))) for i in range(120)]
    return rows


# Search

def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranking(docs, items, top=20):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for id_, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if score > 0:
                found.append((-score, id_ is None, id_ or 0, id_))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, texts, monkeypatch):
    rng = random.Random(9)
    items = [(1, "the river Über"), (2, texts[8][1]), (3, "nothing here matches zzz"), (4, None), (5, ""), (6, "the the the of of stone"), (6, "the the the of of stone"), (None, "élan 漢字 3")]
    items += [(10 + i, " ".join(rng.choices(WORDS, k=12))) for i in range(6)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = _ranking(texts, items)
    for settings in ({}, {"BITS_PER_ENTRY": 1, "PROBES": 1}, {"_BLOCK_BITS": 1, "_ITEMS_AT_ONCE": 3}):  # false positives, small blocks, several turns
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(bit_sliced_search, name, value)
            got = bit_sliced_search.search(_docs(spark, texts), asked)
            assert got.columns == ["item_id", "rank", "id", "score"]
            assert sorted(map(tuple, got.collect()), key=str) == expected
    assert bit_sliced_search.search(_docs(spark, texts), asked, top=3).count() == len(_ranking(texts, items, 3))


def test_search_of_and_in_nothing(spark, texts):
    asked = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert bit_sliced_search.search(_docs(spark, []), asked).count() == 0
    assert bit_sliced_search.search(_docs(spark, texts), asked.where("item_id > 1")).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bit_sliced_search, "_MAX_TERMS", 1)
        with pytest.raises(ValueError, match="2 terms"):
            bit_sliced_search.search(_docs(spark, texts), asked)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(50)]
    docs = [Counter({w: int(n) for w, n in zip(words, rng.geometric(0.3, 50) - 1, strict=True) if n}) for _ in range(40)]
    width, levels = 64, 6
    bits = np.zeros((width, len(docs)), np.uint8)
    for k, c in enumerate(docs):
        for j in range(levels):
            held = [w for w in c if c[w] >= 1 << j]
            bits[bit_sliced_search._bits(bit_sliced_search._hash(held), j, width).ravel(), k] = 1
    asked = bit_sliced_search.Queries([words[:7], [words[3]] * 4], {w: 10 + i for i, w in enumerate(words)})
    m = np.array([75 + sum(c.values()) for c in docs])
    for item, bounds in zip((words[:7], [words[3]] * 4), asked.bounds(np.packbits(bits, axis=1).tobytes(), width, levels, m), strict=True):
        exact = [sum((10 + words.index(w)) * bit_sliced_search.saturation(c[w], int(f)) for w in item if c[w]) for c, f in zip(docs, m, strict=True)]
        assert all(b >= e for b, e in zip(bounds, exact, strict=True))


def test_search_equals_its_sql(spark, data_dir):
    assert_same(spark, data_dir, queries.queries()["op12_bit_sliced_search"], queries.oracle_sql()["op12_bit_sliced_search"])


# Conversations

def _path(rows):
    """Cost and audit by a plain shortest path over (row, state), ordered by cost and audit."""
    heap, seen, to = [(0, "", 0, "")], set(), {"": "u", "s": "u", "u": "a", "a": "u"}
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", i, to[state]))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                if initial == to[state] or (not state and initial == "s"):
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, to[state]))


def _mended(conversations):
    by: dict = {}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = by.setdefault(conv, [])
        if kind == 0:
            continue
        text, role = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, "user" if kind == 4 else role
        digest = hashlib.sha256(f"{'-' if conv is None else conv}/{len(role)}:{role}{text}".encode()).digest()
        rows += [(turn is not None, turn or 0, role, digest, text, turn)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[:4])
        seen, codes, faults = set(), [], Counter()
        for r in rows:
            words = re.sub("[\x20\x09-\x0d]+$", "", r[4])
            fault = "blank" if not words else "duplicate" if (r[2], r[4]) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((r[2], r[4]))
            faults[fault] += 1
            codes.append((r[2][:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = _path(codes)
        given, made = iter(rows), []
        for edit in audit:
            r = next(given) if edit != "I" else None
            if edit != "D":
                due = "assistant" if made and made[-1].startswith("u") else "user"
                made.append(f"{r[2] if edit == 'K' else due}:{r[4] if r else ''}")
        turns = [r[5] for r in rows if r[5] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, kind string, part string, n long"


def _conversations():
    rng, rows = random.Random(4), []
    texts = ["Yes.", "No!", "well", " ", "", "What now?", None, "as I said. ", "über\n", "ends here.\x0b"]
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"Long {t % 150}{'.' * (t % 9 > 0)}") for t in range(900)]  # one conversation of many pieces, its texts come again
    rows += [(501, 3, "user", "The same.")] * 700 + [(501, None, "user", "The same.")] + rows[:5]  # repeated rows
    rows += [(502, t, "user", "Asked.") for t in range(40)]
    return rows


@pytest.mark.parametrize(("piece_rows", "partitions"), [(256, 4), (5, 7), (1, 2)])
def test_repairs_equal_brute_force(spark, piece_rows, partitions):
    rows = _conversations()
    table = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], _CONVERSATIONS).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = conversation_repair.repair(conversation_repair.damage(table), table, piece_rows)
        got = {r.conv_id: tuple(r[c] for c in _REPORT) for r in conversation_repair.with_digest(done).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _mended(rows)
    for conv, roles in done.one_by_one().orderBy("part", "piece", "place").groupBy("conv_id").agg(F.collect_list(F.substring("role", 1, 1))).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(roles)), conv


def test_conversations_without_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.with_digest(conversation_repair.repair(table, table)).count() == 0
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    got = {r.conv_id: tuple(r[c] for c in _REPORT) for r in conversation_repair.with_digest(conversation_repair.repair(table, ids)).collect()}
    assert got == dict.fromkeys((1, None), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_searches_from_both_sides_find_the_least_audit():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [(rng.choice("suaauux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        assert conversation_repair.cheapest(rows) == _path(rows)
    assert conversation_repair.cheapest([], conversation_repair.ASSISTANT, (conversation_repair.START,)) is None


def test_given_conversations(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in _REPORT) for r in queries.queries()["op11_conversation_repair"](spark, data_dir).collect()} == _mended(rows)


# Fingerprints

def _shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _plain_fingerprint(maker, text):
    """One-permutation hashing bin by bin, an empty one looking through the others in its order."""
    hashes = maker.shingles(text).tolist()
    if not hashes:
        return ""
    bins = {}
    for h in hashes:
        b = h >> int(maker.shift)
        bins[b] = min(h, bins.get(b, h))
    made = ""
    for i in range(maker.bins):
        donor = i if i in bins else min(bins, key=lambda j: maker.order[i][j])
        value = np.array([bins[donor]], np.uint64) + maker.number[i : i + 1]
        made += f"{int(minhash._mixed(value)[0]) & 15:x}"
    return made


def test_fingerprints_equal_brute_force(spark, texts):
    got = minhash.edit_likeness(_docs(spark, texts)).select("id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")), F.lower(F.hex("edited_fingerprint")), "near_edited", "near_next").collect()
    maker = minhash.Fingerprinter()
    tie = {t: h for t, h in spark.createDataFrame([(t,) for _, t in texts], "t string").select("t", F.xxhash64("t")).collect()}
    ordered = [(i, t or "") for i, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]]))]
    expected = []
    for k, (id_, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [_plain_fingerprint(maker, t.encode()) for t in (text, edited, after)]
        near = [float(prints[0] == p) if "" in (prints[0], p) else max(0.0, (sum(a == b for a, b in zip(prints[0], p, strict=True)) / 256 - 1 / 16) / (15 / 16)) for p in prints[1:]]
        expected.append((id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *near))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_likeness_estimates_common_shingles():
    rng, maker, off = random.Random(2), minhash.Fingerprinter(), []
    for size in (8, 30, 200, 3000):
        for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
            a = [f"w{rng.random()}" for _ in range(size)]
            b = a[: int(share * size)] + [f"v{rng.random()}" for _ in range(size - int(share * size))]
            x, y = " ".join(a), " ".join(b)
            true = len(_shingles(x) & _shingles(y)) / len(_shingles(x) | _shingles(y))
            off.append(abs(maker.likeness(maker.values(x.encode()), maker.values(y.encode())) - true))
    assert np.mean(off) < 0.03 and max(off) < 0.15
    assert maker.likeness(maker.values(b"just one"), maker.values(b"another text")) < 0.2


def test_fingerprints_of_little(spark):
    assert minhash.edit_likeness(_docs(spark, [])).count() == 0
    alone = minhash.edit_likeness(_docs(spark, [(1, "äb c")])).first()
    assert (alone.n_chars, alone.edited_sha256, alone.near_next) == (4, hashlib.sha256("äbäb".encode()).hexdigest(), 1.0)
    pairs = minhash.fingerprints(_docs(spark, [(1, "a b c d e f"), (2, "A b c\nd e f"), (3, None), (4, " ")])).withColumnRenamed("fingerprint", "left")
    same = minhash.likeness(pairs.join(pairs.withColumnsRenamed({"id": "other", "left": "right"})), "left", "right")
    assert {(r.id, r.other): r.likeness for r in same.collect()} == {(i, j): float((i < 3) == (j < 3)) for i in range(1, 5) for j in range(1, 5)}
    for wrong in ({"bins": 100}, {"bits": 3}):
        with pytest.raises(ValueError):
            minhash.Fingerprinter(**wrong)
    for bits in (1, 2, 8):
        maker = minhash.Fingerprinter(bins=64, bits=bits)
        values = maker.values(b"some words that are of no import")
        assert (maker.unpack(maker.pack(values)) == values).all() and len(maker.pack(values)) == 8 * bits


# Repeated rows and hosts at the end of Unicode

def test_repeated_rows_do_not_multiply_contexts(spark, monkeypatch):
    from tideflow.llm import suffix_family

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(60))
    copy = f"{passage} {' '.join(word() for _ in range(40))}"
    rows = [(None, copy)] * 2000 + [(1, f"{word()} {passage}"), (2, f"{passage} {word()}"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    compare, crowds = suffix_family._same_bytes, []
    monkeypatch.setattr(suffix_family, "_same_bytes", lambda contexts, length: crowds.append(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bytes").alias("of")).collect()) or compare(contexts, length))
    got = suffix_family.digests(suffix_family.remove_repeats(docs)).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(None, len(copy), len(copy), 1, 2000), (1, len(passage) + 7, len(passage), 1, 1), (2, len(passage) + 7, len(passage) + 1, 1, 1), (3, 0, 0, 0, 2)}
    assert crowds[0] and all(r.n == r.of <= 3 for r in crowds[0])
    cut = suffix_family.cut_texts(docs.withColumns({"row": F.lit(1), "n_chars": F.length("text")}))
    assert cut.columns == ["doc_id", "text", "row", "n_chars"] and cut.where("text = ''").count() == 2001 and cut.where("text IS NULL").count() == 1


def test_crowded_keys_are_narrowed(spark, monkeypatch):
    """Hundreds of different contexts of one anchor: some share a string of 200 bytes with another, most only what is around the anchor."""
    from tideflow.llm import suffix_family

    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    middle, left, right = word(120), word(90), word(90)
    texts = [word(150) + middle + word(150) for _ in range(300)] + [word(60) + left + middle + word(150) for _ in range(30)] + [word(150) + middle + right + word(60) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def removed(text, others):
        gone = [False] * len(text)
        for i in range(len(text) - 199):
            if text[i : i + 200] in others:
                gone[i : i + 200] = [True] * 200
        return sum(gone)

    seen = Counter(w for t in texts for w in {t[i : i + 200] for i in range(len(t) - 199)})
    repeated = {w for w, n in seen.items() if n > 1}
    expected = {i: removed(t, repeated) for i, t in enumerate(texts)}
    assert sum(map(bool, expected.values())) == 60
    digests, strings = suffix_family._same_digests, []
    monkeypatch.setattr(suffix_family, "_same_digests", lambda contexts, length: strings.append(contexts.count()) or digests(contexts, length))
    for crowd in (400, 40, 10):
        got = suffix_family.digests(suffix_family.remove_repeats(docs, crowd=crowd)).collect()
        assert {r.doc_id: r.n_removed for r in got} == expected
    assert strings[0] == strings[1] == 0 and 0 < strings[2] <= 400  # narrower keys are enough, but where thirty share one


def test_url_rules_at_the_last_character_and_on_odd_rows(spark):
    from tideflow.llm import url_filter

    last = "\U0010ffff"
    urls = [f"http://{last}{last}.com/x"] * 60 + [f"http://{last}.com/x", "http://com/", "http://com/" + "y" * (1 << 20), f"http://comx/{last}", None, "no scheme", "://", "http:///only/path"] * 3
    pages = spark.createDataFrame([(None if i % 3 else 7, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    rules = spark.createDataFrame([("com", "/", "block"), (f"{last}.com", "/x", "allow"), ("", "/only", "block"), (None, "/", "block")], "host string, path string, verdict string")
    for ranges in (1, 4, 50):
        got = url_filter.judge(pages, rules, ranges=ranges, per_range=3)
        found = Counter((r.host[-6:], r.path[:9], r.rule, r.verdict) for r in got.collect())
        assert found == {(f"{last}{last}.com", "/x", "com/", "block"): 60, (f"{last}.com", "/x", f"{last}.com/x", "allow"): 3, ("com", "/", "com/", "block"): 3, ("com", "/" + "y" * 8, "com/", "block"): 3,
                         ("comx", f"/{last}", None, "allow"): 3, ("", "", None, "allow"): 9, ("", "/only/pat", "/only", "block"): 3}
        assert got.groupBy("page_id").count().count() == 2
    assert sorted(r[0] for r in spark.createDataFrame([(s,) for s in url_filter._seats(spark, 37)], "s int").select(F.pmod(F.hash("s"), F.lit(37))).collect()) == list(range(37))
