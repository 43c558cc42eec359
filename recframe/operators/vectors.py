"""Vector operators.

Exact top-k (J14) is a block-pair matrix join: queries and items are dealt to
blocks of bounded bytes by a hash, every query block meets every item block in
one cogroup, the pair is multiplied in tiles of bounded bytes, and a final
``row_number() <= k`` per query (planned as a WindowGroupLimit) merges the
blocks' best.  Nothing goes through the driver but the two row counts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.session import cut_lineage, store
from recframe.sources.published import PublishedTable

EPS = 1e-8
#: Bytes of float64 vectors in one block, and of scores in one tile.
BLOCK_BYTES, TILE_BYTES = 8 << 20, 4 << 20
#: Scores closer than this to the cut are computed again term by term, so that equal vectors tie exactly.
MARGIN = 1e-9
#: Vectors that are sent to every executor.
SENT_VECTORS = 10_000
#: Recall that the IVF search aims at, above the 0.9 asked for, and the items it is measured on.
IVF_RECALL, IVF_SAMPLE = 0.95, 200


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l2norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v, eps: float = EPS) -> Column:
    """v / (‖v‖ + ε) as ARRAY<DOUBLE>; the norm is evaluated once per row
    (``array_repeat``), not once per element, so the cost is O(d)."""
    den = F.array_repeat(l2norm(v) + F.lit(eps), F.size(_c(v)))
    return F.zip_with(_c(v), den, lambda x, n: x.cast("double") / n)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + EPS)


def _trim() -> None:
    """Give the memory of a finished block pair back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _vectors(table: pa.Table, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of one block."""
    col = table.column(vec_col).combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return table.column(id_col).to_numpy(), _unit(flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0)))


def _tile_topk(k: int, tile_bytes: int, out: pa.Schema):
    """Best k items (score desc, id asc) of an item block for each query of a query block."""
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        qids, q = _vectors(left, "query_id", "_qv")
        iids, x = _vectors(right.sort_by("item_id"), "item_id", "_iv")  # position = id order
        kk, rows = min(k, len(iids)), max(1, tile_bytes // (8 * len(iids)))
        step = max(1, tile_bytes // (16 * q.shape[1]))
        parts = []
        for lo in range(0, len(qids), rows):
            s = q[lo:lo + rows] @ x.T
            kth = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
            qi, ii = np.nonzero(s >= kth[:, None] - MARGIN)
            score = np.empty(len(qi))
            for at in range(0, len(qi), step):  # a sum over one row adds in the same order for every row
                score[at:at + step] = (q[qi[at:at + step] + lo] * x[ii[at:at + step]]).sum(axis=1)
            order = np.lexsort((ii, -score, qi))
            qi, ii, score = qi[order], ii[order], score[order]
            keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < kk
            parts.append((qi[keep] + lo, ii[keep], score[keep]))
        qi, ii, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        del x, q, parts
        _trim()
        return pa.Table.from_arrays([pa.array(qids[qi], out.field(0).type), pa.array(iids[ii], out.field(1).type), pa.array(score)], schema=out)
    return fn


def vector_topk_exact(queries: DataFrame, items: DataFrame, k: int, q_id: str = "query_id",
                      q_vec: str = "embedding", i_id: str = "id", i_vec: str = "embedding",
                      block_bytes: int = BLOCK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Cosine top-k items per query (score desc, item id asc).

    Returns (query_id, item_id, score, rank).  With Q query and I item blocks a
    query is sent to I cogroups and an item to Q, so the exchange carries
    queries × I + items × Q vectors, and each task holds two blocks and a tile
    whatever the tables' sizes.  Null vectors take no part; equal rows
    (repeated id and vector) share a block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    q = queries.where(F.col(q_vec).isNotNull()).select(F.col(q_id).alias("query_id"), F.col(q_vec).alias("_qv"))
    i = items.where(F.col(i_vec).isNotNull()).select(F.col(i_id).alias("item_id"), F.col(i_vec).alias("_iv"))
    n_q = q.count()
    n_i, dim = i.agg(F.count(F.lit(1)), F.max(F.size("_iv"))).first()
    per_block = max(1, block_bytes // (8 * (dim or 1)))
    q_blocks, i_blocks = max(1, -(-n_q // per_block)), max(1, -(-n_i // per_block))
    qs = q.select("*", F.pmod(F.xxhash64("query_id", "_qv"), F.lit(q_blocks)).alias("_qb"),
                  F.explode(F.sequence(F.lit(0).cast("long"), F.lit(i_blocks - 1).cast("long"))).alias("_ib"))
    its = i.select("*", F.pmod(F.xxhash64("item_id", "_iv"), F.lit(i_blocks)).alias("_ib"),
                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("_qb"))
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("item_id", i.schema["item_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    best = (qs.groupBy("_qb", "_ib").cogroup(its.groupBy("_qb", "_ib"))
            .applyInArrow(_tile_topk(k, tile_bytes, to_arrow_schema(schema)), schema))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_items(items: DataFrame, k: int, i_id: str = "id", i_vec: str = "embedding") -> DataFrame:
    """The k nearest other items of every item (itself excluded)."""
    q = items.select(F.col(i_id).alias("query_id"), F.col(i_vec).alias("embedding"))
    res = vector_topk_exact(q, items, k + 1, "query_id", "embedding", i_id, i_vec)
    res = res.where(F.col("query_id") != F.col("item_id")).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return res.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk_ivf(queries: DataFrame, items: DataFrame, k: int, nlist: int | None = 100, nprobe: int | None = 10,
                    q_id: str = "query_id", q_vec: str = "embedding", i_id: str = "id", i_vec: str = "embedding",
                    seed: int = 42) -> DataFrame:
    """KMeans (``pyspark.ml``) clusters over unit item vectors; each
    query searches the items of its ``nprobe`` nearest centroids exactly
    (equi join on cluster id).  ``nlist`` None: the square root of the number
    of items; ``nprobe`` None: as many as a sample of items needs for a recall
    of ``IVF_RECALL`` against the exact search."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    unit = items.select(i_id, i_vec, array_to_vector(normalize(i_vec)).alias("_features"))
    n_items = unit.count()
    nlist = round(n_items ** 0.5) if nlist is None else nlist
    km = KMeans(k=max(1, min(nlist, n_items)), seed=seed, featuresCol="_features", predictionCol="cluster").fit(unit)
    assigned = km.transform(unit).select(i_id, i_vec, "cluster")
    cents = np.vstack(km.clusterCenters())  # nlist × d, bounded by the index size
    if nprobe is None:
        nprobe = _probes_for_recall(assigned, cents, k, i_id, i_vec)
    probe = _nearest_centroids(queries.select(q_id, q_vec), cents, nprobe, q_id, q_vec)
    best = _search_lists(probe.select(F.col(q_id).alias("query_id"), F.col("_q").alias("_qv"), "cluster"),
                         assigned.select(F.col(i_id).alias("item_id"), F.col(i_vec).alias("_iv"), "cluster"), k, cents.shape[1])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_lists(probe: DataFrame, items: DataFrame, k: int, dim: int, block_bytes: int = BLOCK_BYTES,
                  tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Best k items of each probed list, list by list as matrix products.  A long
    list, or one that many queries probe, is cut into block pairs as in the exact
    search; the sizes of the lists (one row a list) say how many."""
    from pyspark.sql.pandas.types import to_arrow_schema
    per_block = max(1, block_bytes // (8 * max(1, dim)))
    blocks = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_block)).alias(name))
    sizes = F.broadcast(store(blocks(probe, "_nq").join(blocks(items, "_ni"), "cluster"), "lists"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    qs = probe.join(sizes, "cluster").select("cluster", "query_id", "_qv", F.pmod(F.xxhash64("query_id", "_qv"), "_nq").alias("_qb"), every("_ni").alias("_ib"))
    its = items.join(sizes, "cluster").select("cluster", "item_id", "_iv", F.pmod(F.xxhash64("item_id", "_iv"), "_ni").alias("_ib"), every("_nq").alias("_qb"))
    schema = T.StructType([probe.schema["query_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())])
    keys = ["cluster", "_qb", "_ib"]
    return qs.groupBy(*keys).cogroup(its.groupBy(*keys)).applyInArrow(_tile_topk(k, tile_bytes, to_arrow_schema(schema)), schema)


def _probes_for_recall(assigned: DataFrame, cents: np.ndarray, k: int, i_id: str, i_vec: str) -> int:
    """Fewest probes that reach IVF_RECALL on IVF_SAMPLE items as queries; their
    k exact neighbours each (a fixed bound) come to the driver."""
    sample = assigned.orderBy(F.xxhash64(i_id), i_id).limit(IVF_SAMPLE).select(F.col(i_id).alias("query_id"), F.col(i_vec).alias("embedding"))
    rows = sample.collect()
    if not rows:
        return 1
    q = _unit(np.vstack([np.asarray(r[1], dtype=np.float64) for r in rows]))
    place = np.argsort(np.argsort(-(q @ cents.T), axis=1, kind="stable"), axis=1)
    at = {r[0]: i for i, r in enumerate(rows)}
    true = vector_topk_exact(sample, assigned, k, "query_id", "embedding", i_id, i_vec)
    pairs = true.join(assigned.select(F.col(i_id).alias("item_id"), "cluster"), "item_id").select("query_id", "cluster").collect()
    need = np.sort([place[at[r[0]], r[1]] for r in pairs])
    return int(need[int(np.ceil(IVF_RECALL * len(need))) - 1]) + 1


def _nearest_centroids(queries: DataFrame, cents: np.ndarray, nprobe: int, q_id: str, q_vec: str,
                       tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(q_id, _q, cluster): a row for each of a query's ``nprobe`` nearest centroids.

    Python holds a tile of scores and gives each vector back once, with the list of its
    clusters; the rows are made of it afterwards, one by one."""
    cu = cents  # KMeans centres of unit vectors; nearest by inner product
    npb = min(nprobe, len(cu))
    qtype = queries.schema[q_id].dataType
    vtype = queries.schema[q_vec].dataType
    schema = T.StructType([T.StructField(q_id, qtype), T.StructField("_q", vtype),
                           T.StructField("_near", T.ArrayType(T.IntegerType()))])
    step = max(1, tile_bytes // (8 * max(cu.shape)))

    def fn(batches):
        for batch in batches:
            for lo in range(0, len(batch), step):
                b = batch.slice(lo, step)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                s = _unit(flat.reshape(len(b), -1)) @ cu.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :npb].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * npb), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[q_id, "_q", "_near"])
        _trim()
    return queries.where(F.col(q_vec).isNotNull()).select(q_id, q_vec).mapInArrow(fn, schema).select(q_id, "_q", F.explode("_near").alias("cluster"))


def list_diversity(lists: DataFrame, vectors: DataFrame, list_col: str = "query_id", item_col: str = "item_id",
                   v_id: str = "id", v_vec: str = "embedding") -> DataFrame:
    """1 − mean off-diagonal cosine of the items in each list, via
    ‖Σu‖² − Σ‖u‖² over unit vectors u (no pairwise join)."""
    v = vectors.select(F.col(v_id).alias(item_col), normalize(v_vec).alias("_u"))
    j = lists.select(list_col, item_col).join(v, item_col)
    per_item = j.select(list_col, item_col, F.aggregate("_u", F.lit(0.0), lambda a, x: a + x * x).alias("_sq"),
                        F.posexplode("_u").alias("_d", "_x"))
    dims = per_item.groupBy(list_col, "_d").agg(F.sum("_x").alias("_s"))
    tot = dims.groupBy(list_col).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"))
    sq = j.groupBy(list_col).agg(F.sum(F.aggregate("_u", F.lit(0.0), lambda a, x: a + x * x)).alias("_n2"),
                                 F.count(F.lit(1)).alias("_k"))
    r = tot.join(sq, list_col)
    kk = F.col("_k")
    return r.select(list_col, F.when(kk > 1, 1 - (F.col("_ss") - F.col("_n2")) / (kk * (kk - 1)))
                    .otherwise(F.lit(None).cast("double")).alias("diversity"))


def in_batch_loss(pairs: DataFrame, temperature: float = 0.05, batch: str = "batch_id", pos: str = "pos",
                  u: str = "u", v: str = "v", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per batch, mean softmax cross-entropy of u_i·v_j / T against the
    diagonal, and top-1 accuracy (argmax, lowest index on ties).

    One batch is one group (a training batch, bounded by definition); its logits
    are computed in tiles of rows, so memory is the batch's vectors and a tile."""
    schema = T.StructType([pairs.schema[batch], T.StructField("loss", T.DoubleType()), T.StructField("accuracy", T.DoubleType())])

    def fn(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(pos).to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        left, right = (np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table), -1) for c in (u, v))
        loss, hits = 0.0, 0
        rows = max(1, tile_bytes // (8 * len(table)))
        for lo in range(0, len(table), rows):
            s = left[lo:lo + rows] @ right.T / temperature
            at = np.arange(len(s))
            top = s.max(axis=1)
            loss += float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[at, at + lo]).sum())
            hits += int((s.argmax(axis=1) == at + lo).sum())
        return pa.table({batch: table.column(batch).slice(0, 1), "loss": [loss / len(table)], "accuracy": [hits / len(table)]})

    return pairs.select(batch, pos, u, v).groupBy(batch).applyInArrow(fn, schema)


def embedding_lookup(df: DataFrame, key: str, table: DataFrame, t_id: str = "id", t_vec: str = "embedding",
                     dim: int | None = None, out: str = "embedding") -> DataFrame:
    """Id → vector; missing ids get the zero vector of the table width."""
    d = dim or len(table.select(t_vec).first()[0])
    t = table.select(F.col(t_id).alias("_eid"), F.col(t_vec).alias("_evec"))
    j = df.join(t, df[key] == t._eid, "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), d)
    return j.withColumn(out, F.coalesce(F.col("_evec"), zero)).drop("_eid", "_evec")


def _mean_vector(vectors) -> Column:
    """Mean of a list of vectors, place by place over the values that are there."""
    def add(acc, v):
        return F.zip_with(acc, v, lambda a, x: F.struct(
            (F.coalesce(a["s"], F.lit(0.0)) + F.coalesce(x, F.lit(0.0))).alias("s"),
            (F.coalesce(a["n"], F.lit(0)) + F.when(x.isNull(), 0).otherwise(1)).alias("n")))
    return F.aggregate(_c(vectors), F.array().cast("array<struct<s:double,n:int>>"), add,
                       lambda acc: F.transform(acc, lambda a: F.when(a["n"] > 0, a["s"] / a["n"])))


def tag_embedding(items: DataFrame, tag_vectors: DataFrame, id_col: str = "id", tags_col: str = "tags",
                  dim: int | None = None) -> DataFrame:
    """Parse tags (F08), mean of the known tag vectors, L2-normalised;
    no known tag → zero vector.  ``tag_vectors`` = (tag, vector)."""
    from recframe.functions.scalar import parse_tags
    d = dim or len(tag_vectors.select("vector").first()[0])
    ex = items.select(id_col, F.explode(parse_tags(tags_col)).alias("tag"))
    # neither is broadcast unless told: lists and vectors are larger than Spark takes them to be
    tag_vectors = store(tag_vectors.select("tag", "vector"), "tags")
    tag_vectors = F.broadcast(tag_vectors) if tag_vectors.limit(SENT_VECTORS + 1).count() <= SENT_VECTORS else tag_vectors.hint("merge")
    j = ex.join(tag_vectors, "tag").where(F.size("vector") > 0).select(id_col, F.col("vector").cast("array<double>").alias("_v"))
    # an item's few vectors meet whole and are added place by place, not exploded to a row a dimension
    vec = j.groupBy(id_col).agg(F.collect_list("_v").alias("_vs")).select(id_col, _mean_vector("_vs").alias("_mean"))
    vec = vec.select(id_col, normalize("_mean").alias("tag_embedding"))
    zero = F.array_repeat(F.lit(0.0), d)
    return items.select(id_col).join(vec, id_col, "left").select(
        id_col, F.coalesce("tag_embedding", zero).alias("tag_embedding"))


def hash_vector(text, dim: int) -> Column:
    """E21 without an encoder: a unit vector made of md5(text#i), i < dim."""
    raw = F.array(*[F.conv(F.substring(F.md5(F.concat(F.coalesce(_c(text), F.lit("")), F.lit(f"#{i}"))), 1, 8), 16, 10).cast("double") / float(1 << 31) - 1.0
                    for i in range(dim)])
    # as a lambda's variable the digests are made once, not at each place where the norm reads them
    return F.element_at(F.transform(F.array(raw), lambda v: normalize(v)), 1)  # noqa: PLW0108 (the second argument is not an index)


def text_embedding(df: DataFrame, text_col: str, id_col: str, dim: int = 64, encoder=None) -> DataFrame:
    """Batch encoder over Arrow batches (``encoder`` maps a
    list of texts to an (n, dim) array); without one, hashed unit vectors."""
    # texts are small and their encoding is not: a table of few files is spread over the tasks first
    df = df.select(id_col, text_col).repartition(id_col, text_col)
    if encoder is None:
        return df.select(id_col, hash_vector(text_col, dim).alias("embedding"))
    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        for pdf in batches:
            m = np.asarray(encoder(pdf[text_col].fillna("").astype(str).tolist()), dtype=np.float64)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(m)})
    return df.mapInPandas(fn, schema)


class EmbeddingCache:
    """Vectors kept by the SHA-256 of their text in a published table; a run
    computes only the texts that are new, once each, and appends them."""

    def __init__(self, table: PublishedTable, dim: int = 64, encoder=None, compact_after: int = 16):
        self.table, self.dim, self.encoder, self.compact_after = table, dim, encoder, compact_after

    def embed(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, embedding, cached): cached tells whether the vector was there before."""
        texts = df.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        current = self.table.current()
        version = current["version"] if current else 0
        todo = texts.groupBy("key").agg(F.first("text").alias("text"))
        if current:
            todo = todo.join(self.table.read().select("key"), "key", "left_anti")
        todo = cut_lineage(todo)
        if current is None or not todo.isEmpty():
            new = text_embedding(todo, "text", "key", self.dim, self.encoder).withColumn("added", F.lit(version + 1))
            self.table.append(new)
            if max(len(names) for names in self.table.current()["folders"].values()) > self.compact_after:
                self.table.compact()
        vectors = self.table.read()
        return texts.drop("text").join(vectors, "key").select(id_col, "embedding", (F.col("added") <= version).alias("cached"))
