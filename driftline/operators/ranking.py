"""A boosted ranker of series within steps: trees grown on the derivatives of a pairwise loss.

Loss: log(1 + exp(worse - better)) over all pairs of a broken and a clean series
at the same step, each pair alike, as in the metric. A group's rows are one record:
channels as bins of 8 bits, in arrays, some thousands of rows at most; a crowded
step is many records, and their rows meet each other all the same. Pairs are not
made: a row's derivatives depend on the other class only through a smooth function
of the row's score. Each record adds up its part of that function at fixed scores
(NODES to a unit), a step's parts are added, and between those scores the function
is a polynomial, as exact as a sum over the pairs themselves.

Scale: a round begins with one pass for those sums, a row a step; a pass over the
groups then answers with sums of derivatives by (model, node, channel, bin); a task
adds up its groups first. What meets on the driver is that table, whose size the
parameters bound, however many rows there are. A level of all trees of all folds is
one pass; scores are made anew from the trees, so that nothing but the groups and
the steps' sums is stored and a lost task costs its own groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.learn import folds, rank_groups
from driftline.session import ship, table

#: A tree: for each inner node (channel, bin; rows at most that bin go left), and the values of its leaves; nodes of a level side by side.
Tree = tuple[list[tuple[int, int]], np.ndarray]


#: Scores in each unit at which sums over the other class are made. The nearest pole of what is added up is pi away, so 20 leave some 1e-16 of it.
NODES = 20


def _nodes(cells: np.ndarray) -> np.ndarray:
    """The scores of units (from cells[k] to one more) at which sums are made, a row a unit."""
    return cells[:, None] + 0.5 + 0.5 * np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def against(at: np.ndarray, score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(4, scores): first and second derivatives of the loss of a broken row with each score at, over all clean ones of score, and of a
    clean row over all broken ones."""
    values, which = np.unique(score, return_inverse=True)
    up, down = (np.bincount(which, y == c, len(values)) for c in (1, 0))
    out, block = np.zeros((4, len(at))), max(1, 4_000_000 // max(1, len(values)))
    for k in range(0, len(at), block):
        ahead = np.clip(at[k : k + block, None] - values[None], -50, 50)
        lost = 1 / (1 + np.exp(ahead))  # of a pair in which the row is the better one
        flat = lost * (1 - lost)
        out[:, k : k + block] = -(lost @ down), flat @ down, (1 - lost) @ up, flat @ up
    return out


def _between(sums: np.ndarray, cells: np.ndarray, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of rows from against() at the nodes of cells, by the polynomials through them."""
    values, which = np.unique(score, return_inverse=True)
    k = np.clip(np.floor(values).astype(int) - int(cells[0]), 0, len(cells) - 1)
    order = np.arange(NODES)
    waves = np.cos(order[:, None] * np.pi * (order + 0.5) / NODES) * np.where(order == 0, 1.0, 2.0)[:, None] / NODES
    parts = sums.reshape(4, len(cells), NODES) @ waves.T
    here = np.polynomial.chebyshev.chebvander(2 * (values - cells[k]) - 1, NODES - 1)
    made = np.einsum("vn,pvn->pv", here, parts[:, k])[:, which]
    return np.where(y == 1, made[0], made[2]), np.where(y == 1, made[1], made[3])


def derivatives(score: np.ndarray, y: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the pairwise loss at each row's score. most: different values of scores, beyond which sums over
    the others are made at nodes, with the same result."""
    values, which = np.unique(score, return_inverse=True)
    if len(values) > most:
        cells = np.arange(np.floor(values[0]), np.floor(values[-1]) + 1)
        return _between(against(_nodes(cells).ravel(), score, y), cells, score, y)
    made = against(values, score, y)[:, which]
    return np.where(y == 1, made[0], made[2]), np.where(y == 1, made[1], made[3])


def walked(x: np.ndarray, splits: list[tuple[int, int]], depth: int) -> np.ndarray:
    """The node of each row, within its level, after so many levels."""
    node = np.zeros(len(x), int)
    for level in range(depth):
        at = np.array(splits[(1 << level) - 1 : (1 << (level + 1)) - 1])
        node = 2 * node + (x[np.arange(len(x)), at[node, 0]] > at[node, 1])
    return node


def scored(x: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    return sum((values[walked(x, splits, depth)] for splits, values in trees), np.zeros(len(x)))


def grouped(rows: DataFrame, names: list[str], bins: int, most: int, n: int) -> tuple[DataFrame, list]:
    """One record a group (step, chunk): ids, targets, folds and binned channels; and the bins' edges."""
    edges = rows.approxQuantile(names, [k / bins for k in range(1, bins)], 0.001)
    edges = [sorted(set(e)) for e in edges]
    binned = []
    for c, e in zip(names, edges):
        bin_of = F.size(F.filter(F.array(*(F.lit(v) for v in e)), lambda v: v < F.col(c))) if e else F.lit(0)
        binned.append(F.coalesce(bin_of, F.lit(0)).cast("byte").alias(c))
    data = folds(rank_groups(rows, most), n).select("id", "step", "chunk", "target", "fold", F.array(*binned).alias("x"))
    one = data.groupBy("step", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "target", "fold", "x"))).alias("r"))
    part = lambda f: F.transform("r", lambda r: r[f]).alias(f)
    return table(one.select("step", part("id"), part("target"), part("fold"), F.flatten(part("x")).alias("x"))), edges


def _records(rows: pa.RecordBatch, channels: int):
    for k in range(rows.num_rows):
        of = {c: rows.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("id", "target", "fold", "x")}
        yield rows.column("step")[k].as_py(), of["id"], of["target"].astype(int), of["fold"].astype(int), of["x"].astype(int).reshape(-1, channels)


def _cells(trees: list[Tree]) -> np.ndarray:
    """The units that the trees' scores may lie in."""
    return np.arange(np.floor(sum(v.min() for _, v in trees)), np.floor(sum(v.max() for _, v in trees)) + 1)


def _beside(groups: DataFrame, models: list[list[Tree]], depth: int, channels: int) -> DataFrame:
    """groups with others: against() of the step's rows at the nodes of each model, all its records together, of the rows that are not of
    the model's fold. A step is one row of these sums, and steps are no more than the longest series has."""
    cells = [_cells(trees) for trees in models]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for step, _, y, fold, x in _records(b, channels):
                sums = [against(_nodes(cells[k]).ravel(), scored(x[fold != k], trees, depth), y[fold != k]).ravel() for k, trees in enumerate(models)]
                yield pa.RecordBatch.from_arrays([pa.array([step]), pa.array([np.concatenate(sums)], pa.list_(pa.float64()))], ["step", "others"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in parts["others"]], axis=0)
        return pa.table({"step": [parts["step"][0].as_py()], "others": pa.array([total], pa.list_(pa.float64()))})

    schema = "step long, others array<double>"
    sums = groups.mapInArrow(part, schema).groupBy("step").applyInArrow(added, schema)
    return groups.join(F.broadcast(table(sums)), "step")


def _sums(groups: DataFrame, models: list[list[Tree]], growing: list[list], level: int, depth: int, channels: int, bins: int) -> np.ndarray:
    """(model, node, channel, bin, 2): sums of derivatives over all groups (with others), of the rows that are not of the model's fold."""
    shape = (len(models), 1 << level, channels, bins, 2)
    cells = [_cells(trees) for trees in models]
    ends = np.cumsum([4 * NODES * len(c) for c in cells])[:-1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for n, (_, _, y, fold, x) in enumerate(_records(b, channels)):
                others = np.split(b.column("others")[n].values.to_numpy(), ends)
                for k, trees in enumerate(models):
                    mine = fold != k
                    if not mine.any():
                        continue
                    z = x[mine]
                    made = _between(others[k], cells[k], scored(z, trees, depth), y[mine])
                    node = walked(z, growing[k], level)
                    at = ((node[:, None] * channels + np.arange(channels)) * bins + z).ravel()
                    for d in (0, 1):
                        total[k, ..., d] += np.bincount(at, np.repeat(made[d], channels), (1 << level) * channels * bins).reshape(shape[1:4])
        flat = total.reshape(-1, 2)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some, 0]), pa.array(flat[some, 1])], ["at", "g", "h"])

    found = groups.mapInArrow(added, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out = np.zeros((int(np.prod(shape[:4])), 2))
    for r in found:
        out[r["at"]] = r["g"], r["h"]
    return out.reshape(shape)


def best_split(sums: np.ndarray, ridge: float) -> tuple[int, int]:
    """(channel, bin) of the split of a node that gains most; the last bin, which splits nothing, if none does."""
    left = np.cumsum(sums, axis=1)
    whole = left[0, -1]
    gain = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gains = gain(left) + gain(whole - left) - gain(whole)
    gains[:, -1] = 0.0
    c, b = np.unravel_index(int(gains.argmax()), gains.shape)
    return (int(c), int(b)) if gains[c, b] > 1e-9 else (0, sums.shape[1] - 1)


def listwise(rows: DataFrame, names: list[str], n: int = 5, rounds: int = 12, depth: int = 3, bins: int = 32, rate: float = 0.3, ridge: float = 1.0, most: int = 8000) -> DataFrame:
    """(id, step, target, fold, score): each fold's scores by the trees of the others. most: rows of a step that are one record; all rows of a step are compared."""
    ship(rows.sparkSession)
    channels = len(names)
    groups, _ = grouped(rows, names, bins, most, n)
    models: list[list[Tree]] = [[] for _ in range(n)]
    for _ in range(rounds):
        growing: list[list] = [[] for _ in range(n)]
        together = _beside(groups, models, depth, channels)
        for level in range(depth):
            sums = _sums(together, models, growing, level, depth, channels, bins)
            for k in range(n):
                growing[k] += [best_split(node, ridge) for node in sums[k]]
        for k in range(n):
            leaves = []
            for node, (c, b) in enumerate(growing[k][(1 << (depth - 1)) - 1 :]):
                left = sums[k, node, c, : b + 1].sum(axis=0)
                leaves += [left, sums[k, node, c].sum(axis=0) - left]
            leaves = np.array(leaves)
            models[k].append((growing[k], -rate * leaves[:, 0] / (leaves[:, 1] + ridge)))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for step, ids, y, fold, x in _records(b, channels):
                score = np.zeros(len(ids))
                for k in range(n):
                    score[fold == k] = scored(x[fold == k], models[k], depth)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), step)), pa.array(y), pa.array(fold), pa.array(score)], ["id", "step", "target", "fold", "score"])

    return groups.mapInArrow(answered, "id long, step long, target long, fold long, score double")
