"""Exact top-k search by pivot-table elimination.

Every vector keeps its distances to a few pivots. For a query, the largest
difference of the two rows of such distances is a lower bound of its distance to
a vector, and with both norms an upper bound of their inner product. Within a
block, candidates are evaluated in order of that bound, until it is below the
k-th best score found: no later one can matter, not even as a tie. A first pass
over the vectors of the same nearest pivot gives every query a score to start
from, so that most of a block is never evaluated where the data cluster.

Scale: vectors are dealt to cells along their nearest pivot. Of a cell the driver
knows the range of its distances to every pivot and its largest norm (one row a
pivot); with these a query whose bound for the whole cell is below its score
never goes there. A query is sent to the cells that are left, in blocks of a
bounded part of the vectors and a bounded chunk of the queries; vectors are only
repeated for the chunks their cell has. A block answers with its k best of each
query.

Components are turned into integers, floor(scale * x), and scores are exact at any
size: where doubles could not hold a sum, products are summed as long integers,
and where longs could not, as integers without bounds. A score beyond a long ends
the query with an error that says so. Bounds have slack by the size of the norms.

Edge cases: vectors null, of another length than most, or with null or non-finite
components take no part; zero vectors do. Ties go to the smaller id. Rows with the
same id are rows of their own: each is a candidate of all others, and each that is
a query has its own k rows of result. Fewer candidates than k: all. Empty tables
give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.ann import ANSWER, _merge, usable
from driftline.session import durable, ship


def choose(rows: np.ndarray, pivots: int, seed: int) -> np.ndarray:
    """Pivots far from each other: each next one is the row farthest from those before."""
    if not len(rows):
        return rows
    at = [int(np.random.default_rng(seed).integers(len(rows)))]
    gap = ((rows - rows[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(pivots, len(rows)) and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[at[-1]]) ** 2).sum(axis=1))
    return rows[at]


def table(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum(0.0, (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * rows @ pivots.T))


def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, held as doubles, in long integers; exact."""
    largest = float(np.abs(rows).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, len(q))
    if largest < 2.0**53:
        return (rows @ q).astype(np.int64)
    if largest < 2.0**62 and max(np.abs(rows).max(), np.abs(q).max()) < 2.0**62:
        return (rows.astype(np.int64) * q.astype(np.int64)).sum(axis=1)
    whole = [int(x) for x in q]
    out = [sum(int(a) * b for a, b in zip(row, whole)) for row in rows]
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise OverflowError("an inner product is beyond a long")
    return np.array(out, np.int64)


def _slack(norm2) -> np.ndarray:
    """How far a distance may be off, by the squared norms behind it."""
    return np.maximum(1e-3, np.sqrt(1e-13 * np.asarray(norm2, np.float64)))


def _upper(q_norm, v_norm, low) -> np.ndarray:
    """An upper bound of the inner product from squared norms and a lower bound of the distance."""
    both = q_norm + v_norm
    return np.floor((both - np.maximum(0.0, low - _slack(both)) ** 2) / 2 + np.maximum(1e-3, 1e-13 * both))


def best(q_rows, q, q_table, v_rows, v_ids, v, v_table, k: int, floor=None, step: int = 64) -> list[tuple[int, int, int, int]]:
    """(query's row, row, id, score) of each query's k best rows of a block; floor: scores below it need not come."""
    q_norm, v_norm, out = (q**2).sum(axis=1), (v**2).sum(axis=1), []
    # Asked once a block: can doubles hold every sum of it?
    plain = float(np.abs(v).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * q.shape[-1] < 2.0**53
    for i in range(len(q)):
        low = np.abs(v_table - q_table[i]).max(axis=1) if v_table.shape[1] else np.zeros(len(v))
        high = _upper(q_norm[i], v_norm, low)
        need = -math.inf if floor is None or np.isnan(floor[i]) else np.nextafter(floor[i], -np.inf)
        may = np.flatnonzero((high >= need) & (v_rows != q_rows[i]))
        may = may[np.argsort(-high[may], kind="stable")]
        got_s, got = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(may), step):
            if high[may[at]] < need:
                break
            some = may[at : at + step]
            got_s, got = np.append(got_s, (v[some] @ q[i]).astype(np.int64) if plain else scores(v[some], q[i])), np.append(got, some)
            order = np.lexsort((v_rows[got], v_ids[got], ~got_s))[:k]  # ~x falls as x rises, for any long
            got_s, got = got_s[order], got[order]
            if len(got_s) == k:
                need = max(need, np.nextafter(float(got_s[-1]), -np.inf))
        out += [(int(q_rows[i]), int(v_rows[b]), int(v_ids[b]), int(x)) for b, x in zip(got, got_s)]
    return out


_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def _reach(stats, pivots: int):
    """What is known of each pivot's vectors: numbers, nearest and farthest distance to every pivot, largest squared norm."""
    near = [r["near"] for r in stats]
    lo = np.array([[r[f"lo{j}"] for j in range(pivots)] for r in stats])
    hi = np.array([[r[f"hi{j}"] for j in range(pivots)] for r in stats])
    return near, lo, hi, np.array([r["norm2"] for r in stats])


def surviving(q: np.ndarray, q_table: np.ndarray, floor: np.ndarray, reach) -> np.ndarray:
    """(query, cell) booleans: cells whose bound for the query is not below its floor. A floor that is not known (NaN) drops nothing."""
    _, lo, hi, norm2 = reach
    q_norm, need = (q**2).sum(axis=1), np.where(np.isnan(floor), -np.inf, floor)
    low = np.stack([np.maximum(0.0, np.maximum(q_table - hi[c], lo[c] - q_table)).max(axis=1) for c in range(len(norm2))], axis=1)
    return _upper(q_norm[:, None], norm2[None], low) >= np.nextafter(need, -np.inf)[:, None]


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id: str = "vec_id", vector: str = "embedding", pivots: int = 48, sample: int = 4096, block_rows: int = 8192, chunk_rows: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose id is divisible by every.

    sample: rows that pivots are chosen from, at most.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  beyond that a double has no fraction
    rows = usable(vectors, id, vector, zero=True).select("row", "id", F.transform("v", lambda x: whole(x * scale)).alias("v"))
    rows = durable(rows)
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "v").limit(sample).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not picked:
        return empty
    points = choose(np.array([r["v"] for r in picked], np.float64), pivots, seed)
    shared = spark.sparkContext.broadcast(points)

    def to_pivot(batches):
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                if np.abs(v).max() >= 2.0**63:
                    raise OverflowError("a component is beyond a long")
                t = table(v, shared.value)
                yield b.assign(t=list(t), near=t.argmin(axis=1), norm2=(v**2).sum(axis=1))

    placed = durable(rows.mapInPandas(to_pivot, "row long, id long, v array<double>, t array<double>, near long, norm2 double"))
    asked = (F.col("id") % every == 0).cast("long")
    ends = [f(F.col("t")[j]).alias(f"{n}{j}") for j in range(len(points)) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = placed.groupBy("near").agg(F.count("*").alias("n"), F.sum(asked).alias("q"), F.max("norm2").alias("norm2"), *ends).collect()  # one row a pivot
    if not sum(r["q"] for r in stats):
        return empty
    reach = spark.sparkContext.broadcast(_reach(stats, len(points)))
    parts = {r["near"]: math.ceil(r["n"] / block_rows) for r in stats}
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), _by_cell(parts)).cast("int")).select("near", "part", "row", "id", "v", "t")
    queries = placed.where(F.col("id") % every == 0).select(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.col("v").alias("q"), F.col("t").alias("qt"), "near")

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            floor = a["floor"].to_numpy(np.float64)
            names = dict(zip(a["qrow"], a["qid"]))
            out = best(a["qrow"].to_numpy(), np.stack(a["q"].to_numpy()), np.stack(a["qt"].to_numpy()), b["row"].to_numpy(), b["id"].to_numpy(), np.stack(b["v"].to_numpy()), np.stack(b["t"].to_numpy()), k, floor)
            out = [(r, names[r], *x) for r, *x in out]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_row", "vec_id", "score"])

    keys = ["near", "part", "chunk"]

    def compared(some: DataFrame, against: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """Queries (qrow, qid, q, qt, floor, near, part) with the vectors of their cells; sizes: queries that a cell has."""
        chunks = _by_cell({c: math.ceil(n / chunk_rows) for c, n in sizes.items()})
        left = some.withColumn("chunk", F.pmod(F.xxhash64("qrow", F.lit(4)), chunks).cast("int"))
        right = against.where(F.col("near").isin([c for c, n in sizes.items() if n])).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(cell, _FOUND)

    first = queries.withColumn("part", F.lit(0)).withColumn("floor", F.lit(float("nan")))
    begun = compared(first, placed.where("part = 0"), {r["near"]: r["q"] for r in stats})
    floors = begun.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    queries = queries.join(floors, queries["qrow"] == floors["query_row"], "left").select("qrow", "qid", "q", "qt", "floor")

    def to_cells(batches):
        for b in batches:
            if len(b):
                near = np.array(reach.value[0])
                keep = surviving(np.stack(b["q"].to_numpy()), np.stack(b["qt"].to_numpy()), b["floor"].to_numpy(np.float64), reach.value)
                yield b.assign(cells=[near[x] for x in keep])

    queries = durable(queries.mapInPandas(to_cells, "qrow long, qid long, q array<double>, qt array<double>, floor double, cells array<long>"))
    sizes = {r["near"]: r["n"] for r in queries.select(F.explode("cells").alias("near")).groupBy("near").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    spread = queries.select("qrow", "qid", "q", "qt", "floor", F.explode("cells").alias("near"))
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), _by_cell(parts) - 1)))
    return _merge(compared(spread, placed, sizes), k).select(*ANSWER)


def _by_cell(numbers: dict[int, int]) -> Column:
    """A pivot's number of parts or chunks, at least 1, looked up by near; one entry a pivot."""
    known = F.create_map(*(F.lit(int(x)) for c, n in sorted(numbers.items()) for x in (c, max(1, n))))
    return F.coalesce(F.try_element_at(known, F.col("near").cast("int")), F.lit(1))
