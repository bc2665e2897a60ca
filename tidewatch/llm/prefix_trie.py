"""Prefix trie of conversations: double-array tries per prefix shard, their shared nodes merged globally.

A conversation is a sequence of turns. Pieces of at most ``SPAN`` turns, each under the node where it starts, are
range-partitioned by that node and their first turns, with the conversation id last, so that any number of equal
conversations, and a conversation of any length, is cut over tasks. A run of sorted pieces is one shard: its turns get
dense ids, its paths are packed into BASE and CHECK arrays (the child of slot s by id c is BASE[s] + c if CHECK there
says s), and the nodes come from walking them. Upper nodes occur in several shards; one aggregate by node hash merges
what the shards say of them.

Sums over subtrees need no walk over the merged tree. The smallest member of a node owns it, and owns all of its own
deeper turns as well; so a turn that its conversation does not own is one saved repetition, a conversation counts as
a leaf where it owns a childless end, and both are suffix sums along conversations, summed by node in a second walk.

A node's hash is a sum over its turns of 64-bit hashes of (place, role, text), in two lanes of 32 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm.common import discard
from tidewatch.operators.ordered import grouped_index, running_totals

#: Turns of a piece, and pieces packed as one shard.
SPAN, SHARD_PIECES = 64, 2048
#: Ids joined into one string before a node's are hashed in order.
END_IDS = 4096
#: Holes that a node with several children tries before it takes fresh slots.
TRIED_HOLES = 8
_LANE = (1 << 32) - 1
_TURNS = "array<struct<d:long,turn:long,len:long,lo:long,hi:long>>"


def pack(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK arrays of the trie of paths given one after another as dense ids; the root is slot 0."""
    sizes = np.diff(offsets)
    base, check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
    at, holes, level = np.zeros(len(sizes), np.int64), np.zeros(0, np.int64), 0
    width = int(symbols.max()) + 1 if len(symbols) else 1
    live = np.flatnonzero(sizes > 0)
    while len(live):
        mine = symbols[offsets[live] + level]
        pairs, child = np.unique(at[live] * width + mine, return_inverse=True)
        parent, symbol = pairs // width, pairs % width
        parents, first, n = np.unique(parent, return_index=True, return_counts=True)
        slots = np.zeros(len(pairs), np.int64)
        # nodes of several children: the first hole where all fit, else fresh slots
        for f, k in zip(first[n > 1].tolist(), n[n > 1].tolist()):
            shape = symbol[f : f + k] - symbol[f]
            for hole in holes[:TRIED_HOLES].tolist():
                want = shape + hole
                if want[-1] < len(check) and (check[want] == -1).all():
                    break
            else:
                want = shape + len(check)
                grown = int(shape[-1]) + 1
                holes = np.concatenate([holes, np.arange(len(check), len(check) + grown)])
                base, check = np.append(base, np.zeros(grown, np.int64)), np.append(check, np.full(grown, -1, np.int64))
            slots[f : f + k] = want
            check[want] = parent[f]
            holes = holes[check[holes] == -1]
        # nodes of one child: any free slot
        one = first[n == 1]
        fresh = max(0, len(one) - len(holes))
        slots[one] = np.concatenate([holes[: len(one)], np.arange(len(check), len(check) + fresh)])
        base, check = np.append(base, np.zeros(fresh, np.int64)), np.append(check, np.full(fresh, -1, np.int64))
        holes = holes[len(one) :]
        check[slots] = parent
        base[parents] = slots[first] - symbol[first]
        at[live] = slots[child.ravel()]
        level += 1
        live = live[sizes[live] > level]
    return base, check


def walk(base: np.ndarray, check: np.ndarray, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Slot reached after each symbol of each path, -1 from where the trie does not hold it."""
    out = np.full(len(symbols), -1, np.int64)
    at, sizes, level = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets), 0
    live = np.flatnonzero(sizes > 0)
    while len(live):
        place = offsets[live] + level
        slot = base[at[live]] + symbols[place]
        known = (slot >= 0) & (slot < len(check))
        known[known] = check[slot[known]] == at[live][known]
        out[place[known]] = at[live[known]] = slot[known]
        level += 1
        live = live[known]
        live = live[sizes[live] > level]
    return out


def rebuilt_turns(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, d, turn, len, ...) of conversations rebuilt on the first turns of their block's first one.

    Turns are ordered by ``turn`` (NULL first), ties by the hash of role and text; NULL role or text is empty; rows
    without conv_id take no part. Conversation c starts with the first h = crc32(c) % ``heads`` turns of conversation
    c - c % ``block`` (all if fewer, none if absent); its own turns after its first h follow. Every conversation also
    has a row of depth 0.
    """
    c = F.col
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    lean = conversations.filter(c("conv_id").isNotNull()).select(
        c("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(F.coalesce(c("role").cast("string"), F.lit("")), text).alias("hash"), F.length(text).cast("long").alias("len"),
    )
    turns = materialize(grouped_index(lean, ["conv_id"], ["turn", "hash"], "pos").select("conv_id", "pos", "hash", "len"), "turns")
    # at most 5 turns of every block's first conversation
    first = turns.filter((c("conv_id") % block == 0) & (c("pos") < heads)).withColumnRenamed("conv_id", "base")
    have = first.groupBy("base").agg(F.count("*").alias("have"))
    h = F.crc32(c("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", (c("conv_id") - c("conv_id") % block).alias("base"), h.alias("h"))
    convs = convs.join(have, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken"))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (c("pos") - c("h") + c("taken")).alias("d"), c("hash").alias("turn"), "len")
    head = convs.filter("h > 0").join(first, "base").filter("pos <= h").select("conv_id", c("pos").alias("d"), c("hash").alias("turn"), "len")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("len"))
    return own.union(head).union(root)


def pieces(turns: DataFrame) -> DataFrame:
    """Conversations cut into pieces of ``SPAN`` turns: (conv_id, seg, turns, n, len, lo, hi and their sums up to the piece's end and in all).

    ``turns`` has (conv_id, d, turn, len), d from 1 without gaps, and one row of depth 0 for every conversation.
    """
    c = F.col
    h = F.xxhash64("d", "turn")
    one = F.struct("d", "turn", "len", F.when(c("d") > 0, h.bitwiseAND(F.lit(_LANE))).otherwise(0).alias("lo"), F.when(c("d") > 0, F.shiftrightunsigned(h, 32)).otherwise(0).alias("hi"))
    seg = F.greatest(F.floor((c("d") - 1) / SPAN), F.lit(0)).cast("long")
    held = turns.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(one)).alias("turns"))  # at most SPAN + 1
    held = held.withColumn("turns", F.filter("turns", lambda t: t.d > 0).cast(_TURNS))
    total = lambda name: F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t[name])
    held = held.select("conv_id", "seg", "turns", F.size("turns").cast("long").alias("own_n"), total("lo").alias("own_lo"), total("hi").alias("own_hi"))
    sums = {"n": c("own_n"), "lo": c("own_lo"), "hi": c("own_hi")}
    return running_totals(held, ["conv_id"], ["seg"], sums, totals=True)


def _sharded(held: DataFrame) -> DataFrame:
    """Pieces in the order of shards: by the node they start from, their first turns, then the conversation."""
    c = F.col
    root = (F.shiftleft((c("hi") - c("own_hi")).bitwiseAND(F.lit(_LANE)), 32)).bitwiseOR((c("lo") - c("own_lo")).bitwiseAND(F.lit(_LANE)))
    firsts = [F.get("turns", F.lit(i))["turn"] for i in range(4)]
    order = [c("seg"), c("root"), *firsts, c("conv_id")]
    return held.withColumn("root", root).repartitionByRange(*order).sortWithinPartitions(*order)


class _Shard:
    """One run of pieces as arrays: paths of dense ids behind a first id for the node where the piece starts."""

    def __init__(self, batch: pa.RecordBatch):
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.conv, self.seg, self.root = (column[n].to_numpy() for n in ("conv_id", "seg", "root"))
        turns = column["turns"]
        flat = turns.flatten()
        self.sizes = np.diff(turns.offsets.to_numpy())
        turn, length, lo, hi = (flat.field(i).to_numpy() for i in (1, 2, 3, 4))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.path = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        start = np.zeros(self.offsets[-1], bool)
        start[self.offsets[:-1]] = True
        depth_in = np.arange(len(start)) - self.offsets[self.path]
        self.depth = self.seg[self.path] * SPAN + depth_in
        self.length = self._spread(start, 0, length)
        # node hash after each symbol: lanes of the start plus the turns' so far
        lanes = []
        for part, of_root in ((lo, self.root & _LANE), (hi, (self.root >> 32) & _LANE)):
            run = np.cumsum(self._spread(start, of_root, part).astype(np.uint64))
            before = np.concatenate([[np.uint64(0)], run])[self.offsets[:-1]]
            lanes.append((run - before[self.path]) & np.uint64(_LANE))
        self.node = ((lanes[1] << np.uint64(32)) | lanes[0]).view(np.int64)
        # dense ids in order of level and path, so that siblings lie close together; starts and turns have ids of their own
        keys = self._spread(start, self.root ^ (self.seg << 1), turn)
        order = np.lexsort((np.arange(len(keys)), depth_in, ~start))
        for kind in (True, False):
            these = order[start[order] == kind]
            _, first, inverse = np.unique(keys[these], return_index=True, return_inverse=True)
            rank = np.empty(len(first), np.int64)
            rank[np.argsort(first)] = np.arange(len(first))
            if kind:
                self.symbols, shift = np.zeros(len(keys), np.int64), len(first)
                self.symbols[these] = rank[inverse.ravel()]
            else:
                self.symbols[these] = rank[inverse.ravel()] + shift
        self.start, self.keys = start, keys
        self.base, self.check = pack(self.symbols, self.offsets)
        self.slot = walk(self.base, self.check, self.symbols, self.offsets)
        self.prior = np.where(start, 0, np.concatenate([[0], self.node[:-1]]))
        #: Positions that stand for a node of this shard: deeper starts were counted where they end.
        self.counted = ~start | (self.depth == 0)

    @staticmethod
    def _spread(start, at_start, inside):
        out = np.zeros(len(start), np.int64)
        out[start] = at_start
        out[~start] = inside
        return out


def _runs(batches, make):
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_PIECES):
            shard = _Shard(batch.slice(at, SHARD_PIECES))
            yield pa.RecordBatch.from_pydict(make(shard))


def _first_walk(batches):
    """Shards with their arrays and, per slot, the node's hash, parent, depth, length, conversations and smallest conversation."""

    def make(s: _Shard):
        n = len(s.check)
        at, where = s.slot[s.counted], s.path[s.counted]
        count, least = np.bincount(at, minlength=n), np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, at, s.conv[where])
        cells = {}
        for name, values in (("node", s.node), ("parent", s.prior), ("depth", s.depth), ("len", s.length)):
            cells[name] = np.zeros(n, np.int64)
            cells[name][at] = values[s.counted]
        cells |= {"n_convs": count, "conv_id": least, "base": s.base, "check": s.check}
        ids = np.zeros(int(s.symbols.max(initial=-1)) + 1, np.int64)
        ids[s.symbols] = s.keys
        return {"alphabet": pa.array([ids])} | {k: pa.array([v]) for k, v in cells.items()}

    return _runs(batches, make)


_SHARD_COLUMNS = ["alphabet", "node", "parent", "depth", "len", "n_convs", "conv_id", "base", "check"]


def tries(held: DataFrame) -> DataFrame:
    """One row per shard: the double array (base, check; alphabet maps dense ids to turn hashes) and per slot what the shard knows of its node."""
    schema = ", ".join(f"`{n}` array<long>" for n in _SHARD_COLUMNS)
    return _sharded(held).select("conv_id", "seg", "root", "turns").mapInArrow(_first_walk, schema)


def _second_walk(batches):
    """(depth, node, leaves, saved) that a shard's conversations add to each of its nodes."""

    def make_rows(batch):
        s = _Shard(batch)
        leaf, later, until = (batch.column(i).to_numpy() for i in (4, 5, 6))
        loose = np.where(s.depth < until[s.path], s.length, 0)
        run = np.cumsum(loose)
        ends = run[s.offsets[1:] - 1]
        saved = ends[s.path] - run + loose + later[s.path]
        at = s.slot[s.counted]
        slots, first, inverse = np.unique(at, return_index=True, return_inverse=True)
        sums = []
        for values in (leaf[s.path], saved):
            out = np.zeros(len(slots), np.int64)
            np.add.at(out, inverse.ravel(), values[s.counted])
            sums.append(out)
        keys = (s.depth[s.counted][first], s.node[s.counted][first])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *sums)], ["depth", "node", "leaves", "saved"])

    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_PIECES):
            yield make_rows(batch.slice(at, SHARD_PIECES))


def _joined_ids(batches):
    """Runs of ids of one node, sorted, as comma-joined strings of at most END_IDS ids."""
    for batch in batches:
        depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(conv):
            continue
        change = np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1
        starts = np.concatenate([[0], change, [len(conv)]])
        cuts = sorted({x for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) for x in range(a, b, END_IDS)})
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)])]
        yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(node[cuts]), pa.array(conv[cuts]), pa.array(texts)], ["depth", "node", "first", "ids"])


def _hashed_ids(batches):
    """SHA-256 of each node's strings, which arrive in order; one digest is open at a time."""
    key, digest = None, None
    for batch in batches:
        out = []
        for depth, node, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (depth, node) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (depth, node), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows):
    depth, node, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(text, pa.string())], ["depth", "node", "ends_sha256"])


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (conv_id, d, turn, len; see ``pieces``).

    conv_id (smallest member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves (childless
    nodes in the subtree), saved_tokens (sum over the subtree of (n_convs - 1) * len of the last turn), ends_sha256
    (of the ids of conversations that end there, ascending, comma-joined). No conversations, no rows.
    """
    c = F.col
    key = ["depth", "node"]
    held = materialize(pieces(turns), "pieces")
    shards = materialize(tries(held), "tries")
    slots = shards.select(F.explode(F.arrays_zip(*[n for n in _SHARD_COLUMNS if n not in ("alphabet", "base")])).alias("s")).select("s.*").filter("n_convs > 0")
    nodes = slots.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("len").alias("len"), F.max("parent").alias("parent"))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((c("depth") - 1).alias("depth"), c("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, key, "left").fillna(0, ["n_children"]), "trie-nodes")

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("until"), F.max((c("n_children") == 0).cast("long")).alias("leaf"))
    owned = held.join(owners, "conv_id", "left").withColumn("until", F.coalesce("until", F.lit((1 << 62)))).withColumn("leaf", F.coalesce("leaf", F.lit(0)).cast("long"))
    loose = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + F.when(t.d < c("until"), t.len).otherwise(0))
    owned = running_totals(owned.withColumn("loose", loose), ["conv_id"], ["seg"], {"so_far": c("loose")}, totals=True)
    owned = _sharded(owned).select("conv_id", "seg", "root", "turns", "leaf", (c("so_far_total") - c("so_far")).alias("later"), "until")
    sums = owned.mapInArrow(_second_walk, "depth long, node long, leaves long, saved long").groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    end = F.shiftleft(c("hi").bitwiseAND(F.lit(_LANE)), 32).bitwiseOR(c("lo").bitwiseAND(F.lit(_LANE)))
    ends = held.filter("n = n_total and (own_n > 0 or seg = 0)").select(c("n").alias("depth"), end.alias("node"), "conv_id")
    order = [*key, "conv_id"]
    joined = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, node long, first long, ids string")
    hashes = joined.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed_ids, "depth long, node long, ends_sha256 string")

    above = nodes.select((c("depth") + 1).alias("depth"), c("node").alias("parent"), c("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, key).join(hashes, key, "left").join(above, ["depth", "parent"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def query(spark, sf_dir) -> DataFrame:
    """op13: the prefix trie of all rebuilt conversations."""
    return prefix_nodes(materialize(rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "rebuilt"))


ORACLE_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, i, r) AS (
  SELECT conv_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, xor(b >> 1, 3988292384 * (b & 1))
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(r, ascii(s[i // 8 + 1])::BIGINT) ELSE r END AS b FROM crc WHERE i < 8 * length(s)) AS step),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(r, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT h.conv_id, 1 AS part, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE pos > h
  UNION ALL
  SELECT h.conv_id, 0, pos, role, text FROM h JOIN t ON t.conv_id = base WHERE pos <= h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(role) || md5(text) AS turn, length(text) AS len FROM parts),
paths AS (SELECT conv_id, d, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, len FROM placed),
r AS (
  SELECT conv_id, d, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), 'root') AS parent, len FROM paths
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM ids),
nodes AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS len, max(parent) AS parent FROM r GROUP BY d, node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
sub AS (SELECT DISTINCT a.node AS v, b.node AS u FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT v, count(*) FILTER (WHERE children.n IS NULL) AS n_leaves, sum((n_convs - 1) * len)::BIGINT AS saved_tokens
  FROM sub JOIN nodes ON nodes.node = u LEFT JOIN children ON children.node = u GROUP BY v),
last AS (SELECT conv_id, max_by(node, d) AS node FROM r GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM last GROUP BY node)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON up.node = nodes.parent LEFT JOIN children ON children.node = nodes.node
  JOIN sums ON v = nodes.node LEFT JOIN ends ON ends.node = nodes.node
"""
