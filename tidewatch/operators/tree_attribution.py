"""Shapley values of boosted trees by mask lookups, linear in the rows.

Along a root-to-leaf path every feature has one interval; a row's mask says which intervals it satisfies. What a leaf
adds to each feature depends on that mask only, so each leaf gets a table of 2^features rows, and a row is explained
by one lookup per leaf. There are two kinds of tables:

* interventional, against background rows: for a row with mask a and a background row with mask b, a leaf counts if
  every feature is in one of them; with U = a minus b and V = b minus a, every j in U gets
  +value (u-1)! v! / (u+v)! and every j in V gets -value u! (v-1)! / (u+v)!. The sum over the background is a sum over
  the lattice of masks b, taken bit by bit with the size of a and b as a polynomial's exponent;
* path-dependent, without background: a feature outside the coalition passes every split with the share of training
  weight that went the leaf's way.

Tables are made by Spark, a leaf a row, and sent to the tasks in parts of at most ``SENT_BYTES``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from math import factorial, inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of tables that a task holds at a time; rows pass through one part after the other.
SENT_BYTES = 1 << 27


def leaf_paths(model, spark, folder: str) -> list[dict]:
    """Leaves of a fitted tree ensemble as feature intervals; size is bounded by trees times 2^depth.

    ``share`` is, per feature, the part of the training weight that goes the leaf's way at its splits on that feature.
    """
    path = f"{folder}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # model metadata
        nodes[r["treeID"]][r["id"]] = r
    leaves = []

    def walk(tree, node_id, box):
        node = nodes[tree][node_id]
        if node["leftChild"] < 0:
            feats = sorted(box)
            leaves.append(
                {
                    "features": feats,
                    "low": [box[f][0] for f in feats],
                    "high": [box[f][1] for f in feats],
                    "share": [box[f][2] for f in feats],
                    "value": float(node["prediction"]) * float(model.treeWeights[tree]),
                }
            )
            return
        f = node["split"]["featureIndex"]
        cut = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = box.get(f, (-inf, inf, 1.0))
        weight = lambda i: float(nodes[tree][i]["impurityStats"][0])  # noqa: E731  weighted rows of a regression node
        left = weight(node["leftChild"]) / (weight(node["leftChild"]) + weight(node["rightChild"]))
        walk(tree, node["leftChild"], {**box, f: (low, min(high, cut), share * left)})
        walk(tree, node["rightChild"], {**box, f: (max(low, cut), high, share * (1 - left))})

    for tree in sorted(nodes):
        walk(tree, 0, {})
    return leaves


def _masks(x: np.ndarray, leaf: dict) -> np.ndarray:
    """Bit j is set when the row satisfies the j-th interval of the leaf."""
    out = np.zeros(len(x), dtype=np.int64)
    for bit, (f, low, high) in enumerate(zip(leaf["features"], leaf["low"], leaf["high"])):
        out |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << bit
    return out


def background_masks(background: DataFrame, features: list[str], leaves: list[dict]) -> DataFrame:
    """(leaf, mask, n) over the background rows: per-batch counts, then one small grouped sum."""

    def count(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            rows = []
            for i, leaf in enumerate(leaves):
                values, n = np.unique(_masks(x, leaf), return_counts=True)
                rows += [(i, int(v), int(c)) for v, c in zip(values, n)]
            yield pd.DataFrame(rows, columns=["leaf", "mask", "n"])

    per_batch = background.select(*features).mapInPandas(count, "leaf int, mask bigint, n bigint")
    return per_batch.groupBy("leaf", "mask").agg(F.sum("n").alias("n"))


def _by_overlap(counts: np.ndarray, d: int, without: int | None = None) -> np.ndarray:
    """[a, k]: background rows whose mask holds all that a lacks and k features of a (``without`` not among them)."""
    grid = np.zeros((2,) * d + (d + 1,))
    grid[..., 0] = counts.reshape((2,) * d)
    for bit in range(d):
        axis = d - 1 - bit  # the first axis is the highest bit
        out = np.moveaxis(grid, axis, 0)
        lacks, holds = out[0], out[1]
        more = np.zeros_like(holds)
        if bit != without:
            more[..., 1:] = holds[..., :-1]
        grid = np.moveaxis(np.stack([holds, lacks + more]), 0, axis)
    return grid.reshape(1 << d, d + 1)


def _bits(d: int) -> np.ndarray:
    """[mask, feature] 0/1."""
    return (np.arange(1 << d)[:, None] >> np.arange(d)) & 1


def interventional_table(leaf: dict, masks: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """[row mask, path feature] attributions of a leaf against background masks that occur ``n`` of ``total`` times."""
    d = len(leaf["features"])
    counts = np.zeros(1 << d)
    np.add.at(counts, masks, n)
    inside, k = _bits(d), np.arange(d + 1)
    up, down = np.zeros((d + 1, d + 1)), np.zeros((d + 1, d + 1))  # by size of the row's mask and overlap
    for size in range(d + 1):
        for over in range(size + 1):
            u, v = size - over, d - size
            if u:
                up[size, over] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                down[size, over] = factorial(u) * factorial(v - 1) / factorial(u + v)
    size = inside.sum(1)
    lost = (_by_overlap(counts, d) * down[size][:, k]).sum(1)
    table = -lost[:, None] * (1 - inside)
    for j in range(d):
        table[:, j] += inside[:, j] * (_by_overlap(counts, d, j) * up[size][:, k]).sum(1)
    return table * leaf["value"] / total


def path_table(leaf: dict) -> np.ndarray:
    """[row mask, path feature] path-dependent attributions of a leaf."""
    d = len(leaf["features"])
    inside, share = _bits(d), np.array(leaf["share"])
    table = np.zeros((1 << d, d))
    for j in range(d):
        # coefficient k: coalitions of k other features, each feature by its mask or its share
        poly = np.zeros((1 << d, d))
        poly[:, 0] = 1.0
        for f in range(d):
            if f != j:
                grown = poly * share[f]
                grown[:, 1:] += poly[:, :-1] * inside[:, f : f + 1]
                poly = grown
        weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        table[:, j] = (poly * weight).sum(1) * (inside[:, j] - share[j]) * leaf["value"]
    return table


def contribution_table(leaves: list[dict], counts: DataFrame) -> DataFrame:
    """(leaf, cells): interventional tables from the background's (leaf, mask, n), one group a leaf."""

    def make(table):
        leaf = leaves[table.column("leaf")[0].as_py()]
        n = table.column("n").to_numpy()
        cells = interventional_table(leaf, table.column("mask").to_numpy(), n, int(n.sum()))  # every row has a mask in every leaf
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "cells": pa.array([cells.ravel()])})

    return counts.groupBy("leaf").applyInArrow(make, "leaf int, cells array<double>")


def path_tables(spark, leaves: list[dict]) -> DataFrame:
    """(leaf, cells): path-dependent tables, a leaf a row."""

    def make(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([path_table(leaves[i]).ravel() for i in ids], pa.list_(pa.float64()))], ["leaf", "cells"])

    return spark.range(len(leaves)).mapInArrow(make, "leaf int, cells array<double>")


def _parts(leaves: list[dict]) -> list[range]:
    """Runs of leaves whose tables stay within SENT_BYTES (one leaf at least)."""
    out, first, held = [], 0, 0
    for i, leaf in enumerate(leaves):
        size = 8 * (len(leaf["features"]) << len(leaf["features"]))
        if held + size > SENT_BYTES and i > first:
            out.append(range(first, i))
            first, held = i, 0
        held += size
    return [*out, range(first, len(leaves))]


def tree_attributions(rows: DataFrame, keys: list[str], features: list[str], leaves: list[dict], tables: DataFrame) -> DataFrame:
    """Long (keys, feature, phi) in margin space: one lookup per row and leaf, no shuffle.

    ``tables`` is (leaf, cells) of ``contribution_table`` or ``path_tables``; leaves without a table add nothing.
    """
    types = dict(rows.dtypes)
    sums = [f"_phi{i}" for i in range(len(features))]
    names = [*keys, *features, *sums]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{f}` double" for f in [*features, *sums]])
    wide = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], *[F.lit(0.0).alias(s) for s in sums])
    for part in _parts(leaves):
        made = tables.filter(F.col("leaf").between(part.start, part.stop - 1)).toArrow()  # at most SENT_BYTES
        found = {}
        for i, cells in zip(made.column("leaf").to_pylist(), made.column("cells")):
            d = len(leaves[i]["features"])
            if d:
                found[i] = cells.values.to_numpy().reshape(1 << d, d)
        sent = rows.sparkSession.sparkContext.broadcast(found)

        def explain(batches, sent=sent):
            for batch in batches:
                column = dict(zip(batch.schema.names, batch.columns))
                x = np.column_stack([column[f].to_numpy(zero_copy_only=False) for f in features])
                phi = np.column_stack([column[s].to_numpy() for s in sums])
                for i, table in sent.value.items():
                    phi[:, leaves[i]["features"]] += table[_masks(x, leaves[i])]
                yield pa.RecordBatch.from_arrays([*[column[n] for n in (*keys, *features)], *[pa.array(phi[:, j]) for j in range(len(sums))]], names)

        wide = wide.mapInArrow(explain, schema)
    return wide.select(*keys, *[F.col(s).alias(f) for s, f in zip(sums, features)]).unpivot(keys, features, "feature", "phi")


def tree_margin(x: np.ndarray, leaves: list[dict]) -> np.ndarray:
    """Ensemble margin of in-memory rows, for checks of the attributions."""
    out = np.zeros(len(x))
    for leaf in leaves:
        out += np.where(_masks(x, leaf) == (1 << len(leaf["features"])) - 1, leaf["value"], 0.0)
    return out


def path_base(leaves: list[dict]) -> float:
    """Expected margin of the path-dependent form: what the parts of a row add up to is its margin less this."""
    return float(sum(leaf["value"] * np.prod(leaf["share"]) for leaf in leaves))
