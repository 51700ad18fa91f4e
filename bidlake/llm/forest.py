"""Approximate nearest neighbours by a hash-prefix forest, dealt over shards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.session import cut

#: Trees, bits of a hash string, rows of a shard (of queries: of a block) on average.
TREES, BITS, SHARD, BLOCK = 24, 32, 8192, 1024
#: Candidates that the trees of a shard must give a query together, as a share of the shard's rows (a row found in several trees counts in each).
SHARE = 0.9
_INDEX = "shard int, ids binary, vectors binary, keys binary, places binary"
_QUERIES = "block int, ids binary, vectors binary, keys binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors of the most frequent length (ties: the shorter) that aren't zero and have only finite components."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("v") == F.col("n")).drop("n")  # one row


def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims + 1, TREES * BITS))


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A string of BITS signs for each row and tree, the first sign as highest bit."""
    bits = (x @ planes > 0).reshape(len(x), TREES, BITS)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


def build_forest(rows: DataFrame, shards: int, dims: int, longest: float, seed: int = 11) -> DataFrame:
    """One row a shard: ids, vectors, and for each tree the sorted hash strings with the places of their vectors.

    Vectors get one more component, which makes all as long as the longest, so that the largest inner product is the smallest angle.
    """

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(axis=1)))
        keys = hash_strings(np.column_stack([x, extra]), _planes(dims, seed))
        places = np.argsort(keys, axis=0, kind="stable")
        keys = np.take_along_axis(keys, places, axis=0)
        data = [a.tobytes() for a in (part["id"].to_numpy(np.int64), x, np.ascontiguousarray(keys.T), np.ascontiguousarray(places.T.astype(np.int32)))]
        return pd.DataFrame([[part["shard"].iloc[0], *data]], columns=["shard", "ids", "vectors", "keys", "places"])

    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, _INDEX)


def query_blocks(rows: DataFrame, blocks: int, dims: int, seed: int = 11) -> DataFrame:
    """One row a block of queries, with their hash strings."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        keys = hash_strings(np.column_stack([x, np.zeros(len(x))]), _planes(dims, seed))
        data = [a.tobytes() for a in (part["id"].to_numpy(np.int64), x, keys)]
        return pd.DataFrame([[part["block"].iloc[0], *data]], columns=["block", "ids", "vectors", "keys"])

    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, _QUERIES)


def levels(keys: np.ndarray, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query and tree the stretch of the sorted array to take: from, to.

    All trees stand at one level, first at that of the longest prefix that any has in common with the query, and ascend
    together, a bit at a time, until their stretches together hold ``enough``.
    """
    n, trees = queries.shape
    low, high = np.zeros((n, trees), np.int64), np.zeros((n, trees), np.int64)
    deepest = np.zeros(n, np.int64)
    for t in range(trees):
        at = np.searchsorted(keys[t], queries[:, t])
        for side in (np.maximum(at - 1, 0), np.minimum(at, keys.shape[1] - 1)):
            differ = keys[t][side] ^ queries[:, t]
            shared = BITS - np.where(differ > 0, np.floor(np.log2(differ.astype(np.float64) + (differ == 0))) + 1, 0).astype(np.int64)
            deepest = np.maximum(deepest, shared)
    level, going = deepest.copy(), np.arange(n)
    while len(going):
        shift = (BITS - level[going]).astype(np.uint64)
        for t in range(trees):
            first = (queries[going, t] >> shift) << shift
            low[going, t] = np.searchsorted(keys[t], first)
            high[going, t] = np.searchsorted(keys[t], first + (np.uint64(1) << shift))
        short = ((high[going] - low[going]).sum(axis=1) < enough) & (level[going] > 0)
        going = going[short]
        level[going] -= 1
    return low, high


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components, so that equal vectors score equal."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[j]
    return total


def search(index: dict, block: dict, dims: int, k: int, share: float) -> pd.DataFrame:
    """The best k of a shard's candidates for each query of a block."""
    ids, x = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["vectors"], np.float64).reshape(-1, dims)
    keys = np.frombuffer(index["keys"], np.uint64).reshape(TREES, -1)
    places = np.frombuffer(index["places"], np.int32).reshape(TREES, -1)
    qids, q = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["vectors"], np.float64).reshape(-1, dims)
    low, high = levels(keys, np.frombuffer(block["keys"], np.uint64).reshape(-1, TREES), max(math.ceil(share * len(ids)), TREES * min(len(ids), 4 * k)))
    parts = []
    for i in range(len(qids)):
        taken = np.zeros(len(ids), bool)
        for t in range(TREES):
            taken[places[t, low[i, t] : high[i, t]]] = True
        taken[ids == qids[i]] = False
        found = np.flatnonzero(taken)
        if not len(found):
            continue
        rough = x[found] @ q[i]
        if len(found) > k:
            worst = np.partition(rough, -k)[-k]
            found = found[rough >= worst - 1e-9 * max(1.0, abs(worst))]
        scores = exact_scores(x[found], q[i])
        best = np.lexsort((ids[found], -scores))[:k]
        parts.append((np.full(len(best), qids[i]), ids[found[best]], scores[best]))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found, by largest inner product, of each query among the rows of ``vectors`` with another id.

    Every row is indexed: rows are dealt by a hash of their id to shards of about SHARD rows, each with a small forest; each block
    of about BLOCK queries is held against each shard. Per shard, trees descend to longest-prefix matches and ascend together
    until they give ``share`` of the shard's rows, and each tree on average min(rows, 4 k) at least, so that a shard of a few hundred rows is read whole; candidates are scored exactly and the shards' best merged. The
    more a query's neighbours stand out from the rest, the smaller a share does; the default suits vectors without any structure.

    Vectors that are null, zero, of another length than most, or with null or non-finite components take no part, nor rows with a null id.
    With fewer candidates than ``k`` all are returned; ties go to the smaller id. Repeated rows are candidates of their own; a
    repeated query is answered once. An empty table gives no rows. Returns query_id, rank, vec_id, score.
    """
    rows = cut(usable(vectors, id_col, vector_col))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    dims, longest = int(about["dims"] or 1), float(about["longest"] or 0.0)
    shards = max(1, math.ceil(about["n"] / SHARD))
    asked = usable(queries, id_col, vector_col).filter(F.size("v") == dims).dropDuplicates(["id"])
    asked = cut(asked)
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    forest = cut(build_forest(rows, shards, dims, longest)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    packed = query_blocks(asked, blocks, dims).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(index: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search(index.iloc[0].to_dict(), block.iloc[0].to_dict(), dims, k, share)

    found = forest.groupBy("shard", "block").cogroup(packed.groupBy("shard", "block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
