"""Fast sketches, term pipeline and prefix trie: brute force and edge cases on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import fast_sketches, prefix_trie, term_pipeline

LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG.replace("w17 ", "x "), None), (4, "", "b"), (5, None, "b"), (6, "one two", "b"),
    (7, "One  two", "c"), (None, "lost words here and there", None), (8, "!!! ???", "c"), (9, "w1 w2 w3 w4 w5", "c"), (9, "w1 w2 w3 w4 w5", "c"),
    (None, "lost words here and there", None), (10, "Ärger im Haus, ärger im haus", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like working columns must not disturb anything
    rows = [(*r, 7, "n", 1, 2) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, k string, key int, block int").repartition(3)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))}


def linked(sets, t):
    label, changed = list(range(len(sets))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if label[i] != label[j] and a and b and 100 * len(a & b) >= t * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_every_coordinate_of_a_sketch_fills():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 7, 40, 500, 5000])
    values = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    made = fast_sketches.sketch(values, sizes)
    assert made.shape == (6, fast_sketches.COORDINATES) and (made != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    # alone or together, in any order: the same sketch
    assert (fast_sketches.sketch(values[3:10][::-1], np.array([7])) == made[2]).all()


@pytest.mark.parametrize("size", [30, 200, 2000])
def test_sketches_agree_as_often_as_sets_are_alike(size):
    rng = np.random.default_rng(size)
    agree, j = [], []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, size + size // 4).astype(np.uint64)
        a, b = both[:size], both[size // 4 :]
        one, two = (fast_sketches.sketch(x, np.array([len(x)]))[0] for x in (a, b))
        agree.append((one == two).mean())
        j.append((size - size // 4) / (size + size // 4))
    assert abs(np.mean(agree) - np.mean(j)) < 0.02
    assert min(agree) > j[0] - 6 * (j[0] * (1 - j[0]) / fast_sketches.COORDINATES) ** 0.5


@pytest.mark.parametrize("words,t", [(3, 85), (5, 80)])
def test_sketched_near_copies(docs, words, t):
    got = collections.Counter(map(tuple, fast_sketches.near_copies(docs, words, t).collect()))
    sets = [shingles(r[1], words) for r in ROWS]
    label, want = linked(sets, t), collections.Counter()
    for i, (doc_id, *_) in enumerate(ROWS):
        smallest = min((ROWS[j][0] for j in range(len(ROWS)) if label[j] == label[i] and ROWS[j][0] is not None), default=None)
        want[(doc_id, len(sets[i]), smallest, doc_id == smallest)] += 1
    assert got == want
    assert fast_sketches.near_copies(docs.filter("false"), words, t).count() == 0


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_sketched_crowd(spark, monkeypatch, block_rows):
    """Many overlapping near copies, also where a bucket is cut into several blocks."""
    monkeypatch.setattr(fast_sketches, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        words = [f"v{j}" for j in range(90)]
        for p in rng.choice(90, rng.integers(0, 5), replace=False):
            words[p] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 3) for _, t in rows]
    got = fast_sketches.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(linked(sets, 85)))


def ranked(docs, items, k):
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    tf = [collections.Counter(terms(t)) for _, t in docs]
    size = [sum(x.values()) for x in tf]
    n, total, df = sum(1 for x in size if x), sum(size), collections.Counter(t for x in tf for t in x)
    wanted, out = collections.defaultdict(set), collections.Counter()
    for item_id, text in items:
        wanted[item_id] |= set(terms(text))
    for item_id, ts in wanted.items():
        scores = []
        for (doc_id, _), x, m in zip(docs, tf, size):
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * x[t] // (1000 * x[t] + 20 * (50 + 50 * m * n // total))) for t in ts if x[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        for rank, (s, _, doc_id) in enumerate(sorted(scores)[:k], 1):
            out[(item_id, rank, doc_id, -s)] += 1
    return out


ITEMS = [(1, "Lost words, w1 w2!"), (2, None), (2, "one"), (None, "haus ÄRGER ärger"), (3, "..."), (4, LONG), (5, "nowhere")]


@pytest.mark.parametrize("k", [2, 50])
def test_term_pipeline(spark, docs, k):
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, bundle int, term int")
    got = collections.Counter(map(tuple, term_pipeline.search(docs, items, k).collect()))
    assert got == ranked([r[:2] for r in ROWS], ITEMS, k)
    assert term_pipeline.search(docs.filter("false"), items, k).count() == 0
    assert term_pipeline.search(docs, items.filter("false"), k).count() == 0


def test_term_pipeline_in_blocks_bundles_and_slices(spark, monkeypatch):
    """Bounds that prune, several blocks and bundles, and more terms than are sent at once."""
    for name, value in (("BLOCK_DOCS", 64), ("BUNDLE", 4), ("SENT_TERMS", 50)):
        monkeypatch.setattr(term_pipeline, name, value)
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"t{min(int(rng.zipf(1.3)), 140)}" for _ in range(n))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(500)]
    items = [(i, text(12)) for i in range(11)]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(2)
    got = collections.Counter(map(tuple, term_pipeline.search(table(docs, "doc_id"), table(items, "item_id"), 5).collect()))
    assert got == ranked(docs, items, 5)


def test_double_array_holds_its_paths_and_no_other():
    rng = np.random.default_rng(2)
    paths = [tuple(rng.integers(0, 6, rng.integers(0, 8)).tolist()) for _ in range(400)]
    flat, offsets = np.array([s for p in paths for s in p]), np.cumsum([0, *map(len, paths)])
    base, check = prefix_trie.pack(flat, offsets)
    slots = prefix_trie.walk(base, check, flat, offsets)
    assert (slots > 0).all()
    prefixes = [p[: i + 1] for p in paths for i in range(len(p))]
    assert len(set(zip(prefixes, slots.tolist()))) == len(set(prefixes)) == len(set(slots.tolist())) == (check >= 0).sum()
    other = [tuple(rng.integers(0, 6, 9).tolist()) for _ in range(200)]
    found = prefix_trie.walk(base, check, np.array([s for p in other for s in p]), np.arange(201) * 9).reshape(200, 9)
    known = set(prefixes)
    assert all((found[i, d] >= 0) == (p[: d + 1] in known) for i, p in enumerate(other) for d in range(9))


def trie_rows(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - math.fmod(c, 100), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, mine in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in mine if whole[c] == node)))
        out.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def conversations():
    rng, rows = np.random.default_rng(7), []
    for c in [*range(0, 12), *range(100, 130), 205, 207, -3, 400]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"turn {rng.integers(0, 2)} of {turn}"))
    rows += [(6, None, None, None), (7, None, "system", "ä" * 9), (None, 1, "user", "nobody"), (8, 99, "user", None)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # equal conversations
    rows += [(131, t, "user", f"long {t % 3}") for t in range(300)]  # more than one piece
    return rows + [(132, t, "user", f"long {t % 3}") for t in range(200)]


@pytest.mark.parametrize("shard,ids", [(2048, 4096), (5, 3)])
def test_prefix_trie(spark, monkeypatch, shard, ids):
    monkeypatch.setattr(prefix_trie, "SHARD_PIECES", shard)
    monkeypatch.setattr(prefix_trie, "END_IDS", ids)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, d int, node int, seg int")
    turns = prefix_trie.rebuilt_turns(table.repartition(3))
    assert collections.Counter(map(tuple, prefix_trie.prefix_nodes(turns).collect())) == trie_rows(rows)
    assert prefix_trie.prefix_nodes(prefix_trie.rebuilt_turns(table.filter("false"))).count() == 0
