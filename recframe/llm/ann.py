"""Operator 2: nearest neighbours by inner product through collision counting.

Method (query-aware collision counting, Huang et al. 2015): M random lines; each
keeps its vectors in an array sorted by projection.  A query lays a window
centred on its own projection over every array.  A vector in the windows of
enough lines is a candidate: its places in the arrays are compared with the ends
of the windows.  Virtual rehashing widens the windows by RATIO until enough
candidates are found; then the candidates are verified by their inner product in
double precision.

Inner products are turned into distances by one more coordinate: vectors are
divided by the largest norm of the table and padded to unit length, queries are
scaled to unit length, so the nearest is the one with the largest product.

Spark deals vectors into shards and queries into blocks, each of bounded size;
every (shard, block) pair is one group, which returns its best k ids per query,
and a per-query top k merges them.  Repeated rows are reduced to one before; the
rows of one vec_id with unlike vectors are spread over the shards.

Defined cases: vectors that are null, empty, zero, of another length than most,
or that hold null or non-finite components take no part, neither as query nor as
candidate; a vec_id that is null is no query and no candidate; a vec_id that
occurs in several rows counts once, with its best score; with fewer than k
candidates all are returned; ties go to the smaller vec_id; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_STEP = 20
LINES = 128
SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
#: Rows of a shard whose collisions are counted at once.
TILE = 1_024
#: First half width of a window, its growth, and the share of lines that must collide.
START, RATIO, ROUNDS = 1.0, 1.25, 8
THRESHOLD = 0.6
#: A round ends the search once it has K + this share of the shard as candidates.
ENOUGH = 0.25


def lines(dim: int, m: int = LINES, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class CollisionIndex:
    """Sorted projections of one shard of unit vectors (rows of x) and the place of
    each row on every line; ``ids`` may come in several rows."""

    def __init__(self, x: np.ndarray, proj: np.ndarray, ids: np.ndarray):
        p = np.ascontiguousarray((x @ proj).T)
        order = np.argsort(p, axis=1)  # rows of equal projection are in a window together, in any order
        self.sorted = np.take_along_axis(p, order, axis=1)
        self.m, self.n = p.shape
        self.kind = np.uint16 if self.n < 1 << 16 else np.uint32
        self.count = np.uint8 if self.m < 1 << 8 else np.uint32
        place = np.empty((self.m, self.n), self.kind)
        np.put_along_axis(place, order, np.arange(self.n, dtype=self.kind)[None], axis=1)
        self.places = [np.ascontiguousarray(place[:, a:a + TILE]) for a in range(0, self.n, TILE)]
        known, self.which = np.unique(ids, return_inverse=True)
        self.n_ids = len(known)

    def distinct(self, rows: np.ndarray) -> int:
        return len(rows) if self.n_ids == self.n else int(np.count_nonzero(np.bincount(self.which[rows], minlength=self.n_ids)))

    def windows(self, centres: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of every query's window on every line in round r."""
        half = START * RATIO ** r
        lo = np.stack([np.searchsorted(self.sorted[j], centres[:, j] - half) for j in range(self.m)], 1)
        hi = np.stack([np.searchsorted(self.sorted[j], centres[:, j] + half, side="right") for j in range(self.m)], 1)
        return lo.astype(self.kind), (hi - lo).astype(self.kind)

    def tally(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """On how many lines each row lies in the window.  A place before a window
        wraps round to a large number, so one comparison tests both its ends."""
        lo, size = lo[:, None], size[:, None]
        return np.concatenate([np.add.reduce((place - lo < size).view(np.uint8), axis=0, dtype=self.count) for place in self.places])

    def candidates(self, centres: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query (row of projections): rows that collide often enough, of
        ``k`` ids at least if there are as many.  They come from the first round that
        finds enough of them; as a wider window loses none, the search for that
        round starts where the query before ended."""
        need = min(self.n_ids, k + int(ENOUGH * self.n_ids))
        least = int(np.ceil(THRESHOLD * self.m))
        rounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def collide(q: int, r: int) -> tuple[np.ndarray, int]:
            if r not in rounds:
                rounds[r] = self.windows(centres, r)
            got = np.flatnonzero(self.tally(*(w[q] for w in rounds[r])) >= least)
            return got, self.distinct(got)

        r = 0
        for q in range(len(centres)):
            got, n = collide(q, r)
            while n < need and r < ROUNDS - 1:
                r += 1
                got, n = collide(q, r)
                if n >= need:
                    break
            else:
                while n >= need and r > 0:
                    fewer, m = collide(q, r - 1)
                    if m < need:
                        break
                    got, n, r = fewer, m, r - 1
            # the widest windows still leave too few: everything is verified
            yield got if n >= min(self.n_ids, k) else np.arange(self.n)


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of the best k ids found for each query in one shard."""
    length = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1) / norm ** 2))
    unit = np.hstack([x / norm, length[:, None]])
    proj = lines(unit.shape[1])
    index = CollisionIndex(unit, proj, ids)
    centres = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]) @ proj
    qs, vs, ss = [], [], []
    for i, found in enumerate(index.candidates(centres, k + 1)):
        found = found[ids[found] != q_ids[i]]
        score = np.einsum("ij,j->i", np.take(x, found, axis=0), q[i])
        if index.n_ids < index.n:  # the best row of each id
            order = np.lexsort((-score, ids[found]))
            one = ids[found[order]]
            order = order[np.append(True, one[1:] != one[:-1])[:len(one)]]
            found, score = found[order], score[order]
        if len(found) > k:
            # all rows tied with the k-th best stay, so that ids can break the tie
            cut = np.partition(score, len(score) - k)[len(score) - k]
            pick = np.flatnonzero(score >= cut)
            pick = pick[np.lexsort((ids[found[pick]], -score[pick]))][:k]
        else:
            pick = np.arange(len(found))
        qs.append(np.full(len(pick), q_ids[i]))
        vs.append(ids[found[pick]])
        ss.append(score[pick])
    return np.concatenate(qs), np.concatenate(vs), np.concatenate(ss)


def _usable(vec: str) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda v: v != 0) & F.col("vec_id").isNotNull()


def nearest(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the registered query."""
    spark = embeddings.sparkSession
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(_usable("vec"))
    sizes = v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % query_step == 0).cast("long")).alias("q"),
                                                      F.max(F.expr("sqrt(aggregate(vec, 0D, (a, x) -> a + x * x))")).alias("norm"))
    top = sizes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, vec_id long, score double"
    out = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], out)
    dim, norm = int(top["dim"]), float(top["norm"])
    v = v.where(F.size("vec") == dim).distinct()  # repeated rows
    shards = max(1, -(-top["n"] // SHARD_ROWS))
    q_blocks = max(1, -(-(top["q"] or 0) // BLOCK_ROWS))
    # every row goes to its shard once for each block of queries, every query to its block once for each shard
    rows = v.select(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("g"), "vec_id", "vec")
    asked = (v.where(F.col("vec_id") % query_step == 0)
             .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("g"),
                     F.col("vec_id").alias("query_id"), F.col("vec").alias("q")))

    def matrix(col: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks]).reshape(-1, dim)

    def run(part: pa.Table, ask: pa.Table) -> pa.Table:
        if not part.num_rows or not ask.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        got = search_block(part.column("vec_id").to_numpy(), matrix(part.column("vec")), ask.column("query_id").to_numpy(), matrix(ask.column("q")), norm, k)
        return pa.Table.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    found = rows.groupBy("s", "g").cogroup(asked.groupBy("s", "g")).applyInArrow(run, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
