"""Operator 4: uniform shuffle into shards of exact sizes (native).

1. Rows are dealt to P parts by a hash of their id and text; the parts are counted.
2. The communication matrix (rows that part p sends to shard s) is drawn from
   the multivariate hypergeometric law with the part counts and shard sizes as
   margins: P * shards numbers of control data, drawn on the driver from the
   P counts.
3. Inside each part rows are permuted (ranked by a seeded hash); the matrix row
   cuts the permutation into the runs that go to each shard.
4. In the shard rows are permuted again: a second hash gives a random cell and a
   rank in it; cell counts give the offset, so no task sorts a whole shard.

Law ``rows``: shard sizes differ by one row at most.  Defined cases: a null text
has no bytes (size 8, crc32 0); repeated rows are separate rows with slots of
their own (which copy gets which slot is immaterial, the copies being equal);
an empty table gives an empty result; extra columns are carried unless named
shard or slot (replaced).  Columns with names of the operator's own use
(_part, _rank, ...) are carried too, in a struct.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PART = 20_000
ROWS_PER_CELL = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good: exact inversion
    that walks out from the mode, so the work is a few standard deviations."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo

    def ln_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    left = right = mode
    p_left = p_right = math.exp(ln_choose(good, mode) + ln_choose(bad, draws - mode) - ln_choose(good + bad, draws))
    u = rng.random() - p_left
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(part_counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Row p: how many rows of part p go to each shard.  The law is that of a
    uniform permutation of all rows cut into shards of n // n_shards rows (the
    first n % n_shards shards have one more)."""
    rng = random.Random(seed)
    n = sum(part_counts)
    room = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    rows = []
    for count in part_counts:
        row, to_place, others = [], count, sum(room)
        for s in range(n_shards):
            others -= room[s]
            take = hypergeometric(rng, room[s], others, to_place)
            row.append(take)
            to_place -= take
        room = [r - t for r, t in zip(room, row, strict=True)]
        rows.append(row)
    return rows


def shuffle_to_shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, content: str = "text") -> DataFrame:
    """All columns of ``docs`` plus shard (int) and slot (long, gapless from 0).

    ``content`` names the column that, with doc_id, identifies a row."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    key = F.xxhash64(F.col("doc_id"), F.col(content))
    rows = docs.select(F.struct(*kept).alias("_row"), key.alias("_key"))
    n = docs.count()
    n_parts = max(1, -(-n // ROWS_PER_PART))
    n_cells = max(1, -(-n // (n_shards * ROWS_PER_CELL)))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(n_parts)).cast("int"))

    counted = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(n_parts)], n_shards, seed)
    cuts = [(p, [sum(row[:s + 1]) for s in range(n_shards)]) for p, row in enumerate(matrix)]
    # n_parts * n_shards numbers: control data, a few bytes for each ROWS_PER_PART rows
    limits = spark.createDataFrame(cuts, "_part int, _cuts array<long>")

    first = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key")
    placed = (parts.withColumn("_rank", F.row_number().over(first) - 1)
              .join(limits, "_part")
              .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
              .withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed + 2), "_key"), F.lit(n_cells)).cast("int"))
              .select("_row", "_key", "shard", "_cell"))
    before = Window.partitionBy("shard").orderBy("_cell")
    offsets = (placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
               .select("shard", "_cell", (F.sum("_n").over(before) - F.col("_n")).alias("_offset")))
    second = Window.partitionBy("shard", "_cell").orderBy(F.xxhash64(F.lit(seed + 3), "_key"), "_key")
    return (placed.withColumn("_rank", F.row_number().over(second) - 1)
            .join(offsets, ["shard", "_cell"])
            .select("_row.*", "shard", (F.col("_offset") + F.col("_rank")).cast("long").alias("slot")))


def shard_digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The columns of the registered query; texts are not moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text).cast("long") + 8).alias("size"))
    return shuffle_to_shards(slim, n_shards, content="text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
