"""Edge cases and brute-force versions of the corpus operators on small tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import brown_lm, decontamination, jaccard_join, line_dedup, mixing, pivot_search, sharding, substring_dedup, toxicity
from tidewatch.llm.components import components

LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG.replace("w17 ", "x "), None), (4, "", "b"), (5, None, "b"), (6, "one two", "b"),
    (7, "one  two", "c"), (None, "lost words here and there", None), (8, "!!! ???", "c"), (9, "w1 w2 w3 w4 w5", "c"), (9, "w1 w2 w3 w4 w5", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like working columns must not disturb anything
    rows = [(*r, 7, "n", 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, k string, slot int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0))}


@pytest.mark.parametrize("words,t", [(4, 85), (5, 80)])
def test_near_copies(docs, empty, words, t):
    got = jaccard_join.near_copies(docs, words, t)
    seen = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    sets = [shingles(x[1], words) for x in ROWS]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= t * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = collections.Counter()
    for i, (doc_id, *_) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if label[j] == label[i] and ROWS[j][0] is not None]
        want[(doc_id, len(sets[i]), min(ids, default=None))] += 1
    assert seen == want
    assert jaccard_join.near_copies(empty, words, t).count() == 0


def test_near_copies_of_a_crowd(spark):
    """Many overlapping near copies: components equal those of all pairs."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for p in rng.choice(60, rng.integers(0, 4), replace=False):
            words[p] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85).collect()}
    sets, label, changed = [shingles(t, 2) for _, t in rows], list(range(120)), True
    while changed:
        changed = False
        for i in range(120):
            for j in range(120):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[j] > label[i]:
                    label[j], changed = label[i], True
    assert got == dict(enumerate(label))


def test_near_copies_inside_a_group(spark, monkeypatch):
    """Families of a text, a copy too far from it and a near copy of that copy: no link inside a group of one prefix is lost."""
    rng = np.random.default_rng(11)
    rows, inside = [], 0
    for f in range(900):
        one = [f"f{f}w{i}" for i in range(60)]
        two = list(one)
        for p in rng.choice(60, 2, replace=False):
            two[p] = f"f{f}x{p}"
        three = list(two)
        three[rng.integers(60)] = f"f{f}y"
        family = [" ".join(x) for x in (one, two, three)]
        rows += [(3 * f + i, t) for i, t in enumerate(family)]
        n = [jaccard_join.shingle_sets([t.encode()], 4)[0] for t in family]
        inside += len({len(x) for x in n}) == 1 and len({x[: jaccard_join.bounds(85)[0](len(x))].tobytes() for x in n}) == 1
    assert inside > 10
    # as in a large corpus, where copies lie in different blocks of the count and their shingles are not seen as frequent
    monkeypatch.setattr(jaccard_join, "_frequent", lambda docs, words: np.zeros(0, np.int64))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    want = {}
    for i, t in rows:
        mine = shingles(t, 4)
        want[i] = next((want[j] for j in range(i - i % 3, i) if 100 * len(mine & (s := shingles(rows[j][1], 4))) >= 85 * len(mine | s)), i)
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong == 0, f"{wrong} of {len(want)} rows; {inside} families of one prefix"


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.label) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(links.filter("false")).count() == 0


def test_mix(docs, empty):
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size"), mixing.document_key(F.col("doc_id"), F.col("text")).alias("key"))
    got = mixing.mix(sizes, mixing.weighted_targets(sizes, mixing.WEIGHTS)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 3 for r in got)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in got))
    again = mixing.mix(sizes, mixing.weighted_targets(sizes, mixing.WEIGHTS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    none = sizes.filter("false")
    assert mixing.mix(none, mixing.weighted_targets(none, mixing.WEIGHTS)).count() == 0


def test_mix_inclusion_odds_and_bound(spark):
    """200 sources of equal documents: how often a length is sampled is its inclusion probability; little stays open."""
    lengths = [3] * 60 + [9] * 60 + [40] * 60 + [150] * 6
    rows = [(f"{s}-{i}", f"s{s:03d}", n) for s in range(200) for i, n in enumerate(lengths)]
    total = sum(lengths)
    # the longest class is certain; the other three share what stays by their powers of two
    room = 6 * 150 + 1200
    docs = spark.createDataFrame(rows, "key string, source string, size long")
    targets = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.lit(float(total + room)))
    scale = 1200 / sum(60 * n * w for n, w in ((3, 2), (9, 8), (40, 32)))
    first = mixing.mix(docs, targets, rounds=1).collect()
    share = {n: sum(r.copies - 1 for r in first if r.size == n) / (200 * lengths.count(n)) for n in set(lengths)}
    assert share[150] == 1
    for n, w in ((3, 2), (9, 8), (40, 32)):
        p = scale * w
        assert share[n] == pytest.approx(p, abs=4 * (p * (1 - p) / (200 * 60)) ** 0.5)
    got = mixing.mix(docs, targets).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
    assert all(0 <= total + room - n <= 40 / 2**5 or total + room - n < 3 for n in taken.values())


def test_mix_rows_that_repeat_a_key_stay_within_the_room(spark):
    rows = [("same", "a", 5)] * 30 + [(f"k{i}", "a", 5) for i in range(70)] + [("same", None, 7), ("none", None, 0)]
    docs = spark.createDataFrame(rows, "key string, source string, size long")
    targets = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.col("source_size") * 0.5)
    got = mixing.mix(docs, targets).collect()
    assert len(got) == len(rows)
    assert len({r.copies for r in got if r.key == "same" and r.source == "a"}) == 1
    taken = sum(r.copies * r.size for r in got if r.source == "a")
    assert 245 <= taken <= 250


def test_shards_equal_one_by_one_insertion():
    rng = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in zip(rng.choice(256, 60, replace=False), rng.integers(1, 9, 60))}
    nodes, total = sharding.virtual_nodes(5, 4, 256), sum(counts.values())
    room = sharding.capacities(total, 5, 0.0)
    assert max(room) - min(room) <= 1 and sum(room) == total
    want, left = [], list(room)
    for slot in sorted(counts):
        for rank in range(counts[slot]):
            i = next((i for i, (at, _) in enumerate(nodes) if at >= slot), 0)
            while not left[nodes[i][1]]:
                i = (i + 1) % len(nodes)
            left[nodes[i][1]] -= 1
            want.append((slot, rank, nodes[i][1]))
    got = [(slot, rank, shard) for slot, lo, hi, shard, _ in sharding.walk(counts, nodes, room) for rank in range(lo, hi)]
    assert got == want


def test_shards(docs, empty):
    out = sharding.assign(docs, sharding.ring_key(F.col("doc_id"), F.md5("text")), shards=4).collect()
    places = collections.defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert len(out) == len(ROWS) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1
    assert sharding.assign(empty, F.col("doc_id"), shards=4).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "W100, w101 w102-w103 w104 w105 w106 w107 w108 w109 w110"), (2, "two"), (3, None), (4, ""), (None, "one"), (5, "nowhere at all")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.summarize(*decontamination.found_windows(docs, items)).collect()
    by = {r.doc_id: (r.n_hit, r.n_items) for r in got}
    assert len(got) == len(ROWS)
    assert by[1] == by[2] == by[3] == (11, 1) and by[6] == by[7] == (1, 1) and by[9] == by[4] == by[5] == by[None] == (0, 0)
    assert decontamination.summarize(*decontamination.found_windows(empty, items)).count() == 0
    assert decontamination.summarize(*decontamination.found_windows(docs, items.filter("false"))).filter("contaminated").count() == 0


def test_substrings(docs, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 5).collect())
    assert got[(1, 3000, 0)] == 1 and got[(2, 3000, 3000)] == 1 and got[(3, 3000, 2999)] == 1
    assert got[(9, 5, 5)] == 2 and got[(None, 5, 0)] == 1 and got[(5, 0, 0)] == 1
    assert substring_dedup.remove_repeats(empty, 5).count() == 0
    assert substring_dedup.levels(50) == [7, 13, 25, 50]


@pytest.mark.parametrize("sent", [1 << 23, 0])
def test_substrings_of_rows_that_share_an_id(spark, monkeypatch, sent):
    """Rows without id and rows of one id have different texts: each loses its own repeats only."""
    monkeypatch.setattr(substring_dedup, "SENT_MARKS", sent)
    passage = " ".join(f"p{i}" for i in range(8))
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, passage), (None, f"{passage} {own('a', 20)}"), (None, own("b", 30)), (None, f"{own('c', 9)} {passage}"), (7, own("d", 25)), (7, f"{own('e', 3)} {passage} {own('f', 12)}")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect())
    left = [" ".join(w for w in t.split() if i == 1 or w not in passage.split()) for i, t in rows]
    assert got == collections.Counter((i, len(t.split()), len(t.split()) - len(k.split()), k) for (i, t), k in zip(rows, left))


def test_lines(spark, docs, empty):
    rows = [(1, "A common line, quite long indeed!\nother text"), (2, "a common line quite long indeed\nnew words"), (3, None), (4, ""), (5, "--\n--")]
    got = {r.doc_id: r for r in line_dedup.remove_near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].kept == "new words" and got[3].kept is None and got[5].n_removed == 0
    assert line_dedup.remove_near_lines(docs).count() == len(ROWS)
    assert line_dedup.remove_near_lines(empty).count() == 0


def test_all_lines_of_a_hash_meet(spark):
    """Lines of the same words share a hash; each near one goes, not only those like the first or last of the hash."""
    words = [f"longer{i}word{i * i}" for i in range(14)] + ["ab", "cd"]
    rows = []
    for g, order in enumerate([words, words[::-1], words[1::2] + words[::2], words[7:] + words[:7]]):
        at = order.index("ab")
        near = order[:at] + order[at + 1 :] + ["ab"] if at < 15 else ["ab", *order[:-1]]
        rows += [(10 * g, " ".join(order)), (10 * g + 1, " ".join(near))]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 10 == 1) for i, _ in rows}


def test_block_keys_are_shuffled_once(spark, monkeypatch):
    """Neighbouring hashes come from one exchange of block keys joined with itself, and are those of all pairs."""
    rng = np.random.default_rng(11)
    hashes = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)]
    hashes += [x ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 4) for x in hashes[:12]]
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(line_dedup, "materialize", noted)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs, near = line_dedup.candidate_pairs(spark.createDataFrame(list(enumerate(hashes)), "h long, sh long"))
        got = {(r.a, r.b) for r in pairs.collect()}
        seen = {(r.sh, r.sh2) for r in near.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if ((hashes[i] ^ hashes[j]) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and seen == {tuple(sorted((hashes[i], hashes[j]))) for i, j in want}
    assert "blocks" not in plans and "ReusedExchange" in plans["near-hashes"]


def test_lines_of_very_many_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_WORDS", 150)
    words = [f"w{i % 61}" for i in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:400], "another", *words[400:]])), (3, "short line")]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 7]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.3]), (302, [0.1, float("nan"), 0.0, 0.0]), (303, []), (304, [5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in pivot_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, pivots=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: np.array([int(np.floor(256 * x)) for x in e] + [0] * (4 - len(e))) for i, e in rows if e and all(x is not None and x == x for x in e)}
    want = {q: sorted(((i, int(v[q] @ x)) for i, x in v.items() if i != q), key=lambda t: (-t[1], t[0]))[:5] for q in v if q % 50 == 0}
    assert dict(got) == want
    assert pivot_search.top_k(vectors.filter("false"), vectors, 5).count() == 0


def test_language_model(docs, empty):
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = brown_lm.score_texts(docs.withColumn("held", held), passes=2).collect()
    tokens = [((t or "").lower().split() + [None], i is not None and i % 3 == 0) for i, t, _ in ROWS]
    c = collections.Counter(w for ws, h in tokens if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for ws, _ in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 1e-9 for r in got)
    assert brown_lm.score_texts(empty.withColumn("held", F.lit(False))).count() == 0


def test_scoring_moves_no_word_lists(docs):
    """Texts meet the counts of their words by a numbered chunk; its list of hashes and training counts stay behind."""
    scored = brown_lm.score_texts(docs.withColumn("held", F.lit(False)), passes=1)
    plan = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (meets,) = [line for line in plan if "FlatMapCoGroupsInArrow" in line]
    assert "codes#" in meets and "vocab#" not in meets and "train#" not in meets
    assert dict(brown_lm.code_texts(docs.withColumn("held", F.lit(False))).dtypes)["chunk"] == "bigint"


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "river", "walks", "stone", "green"], 12)) + (" awfulness" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(train, labels)
    assert model.rules and model.rest < 0.3
    ask = spark.createDataFrame([(1, "the awfu1ness"), (2, "a w f u l n e s s"), (3, "the awwwfulness"), (4, "the green"), (5, None), (6, "")], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.3 for r in toxicity.score(ask, model).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    assert toxicity.train(train, labels.filter("false")).rest == 0.0


def test_toxicity_of_long_tokens_and_short_spaced_words(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "river", "walks", "stone", "green"], 12)) + (" awfulness vex" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    model.rules.setdefault("=vex", 0.9)
    ask = [(1, "the aw" + "f" * 90 + "ulness"), (2, "_".join(["river", "stone"] * 8 + ["awfu1ness"] + ["green"] * 4)), (3, "the v e x walks"), (4, "_".join(["river", "st0ne"] * 12)), (5, "r i v"), (6, "stone" + "." * 5000 + "awfu1ness")]
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        kept = after
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    left = corpus_pipeline.drop_near_copies(spark, odd, sf)
    assert left.count() == docs.limit(3).select("text").distinct().count()
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 0
