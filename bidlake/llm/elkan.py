"""Centroid clustering of integer vectors by Elkan's bounds, exact at every tie."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.session import cut, remove, written

#: Vectors of a block, the unit that is stored and worked on.
BLOCK = 2048
#: Components up to this size are worked on as 64-bit numbers (64 squared differences stay below 2^62), larger ones as Python's.
PLAIN = 1 << 27
#: Room for the rounding of a root, a sum or a difference: several times what these can lose.
SLACK = 2.0**-49
_SUM = "decimal(38,0)"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, exactly; as Python's integers where one is large. ``scale`` is a power of two."""
    if x.size == 0 or np.abs(x).max() * scale <= PLAIN:
        return np.floor(x * scale).astype(np.int64)
    whole = np.empty(x.shape, object)
    for place, value in np.ndenumerate(x):  # a value of 2^53 and above is an integer already
        whole[place] = math.floor(value * scale) if abs(value) < 2.0**53 else int(value) * scale
    return whole


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` to one centroid."""
    if x.dtype != object and c.dtype != object:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Roots as floating-point numbers that are certainly not too small (``up``) or not too large."""
    if squares.dtype == object:
        most = float(np.finfo(np.float64).max)
        roots = [math.isqrt(int(s)) + (1 if up else 0) for s in squares]
        values = np.array([float(r) if r < int(most) else (math.inf if up else most) for r in roots])
    else:
        values = np.sqrt(squares.astype(np.float64))
    return values * (1 + SLACK) if up else values * (1 - SLACK)


def between(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the distance of each two centroids, not too large, and of each centroid to the nearest other."""
    half = np.array([_root(squared(centroids, c), up=False) / 2 for c in centroids]).reshape(len(centroids), -1)
    return half, np.where(np.eye(len(centroids), dtype=bool), np.inf, half).min(axis=1)


def assign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> int:
    """Bring ``near``, ``upper`` and ``lower`` up to date in place for centroids that have moved by at most ``moved``; returns the distances worked out.

    A centroid is passed over only if a bound says that it is strictly farther than the present one; all others are settled by exact
    integers, of which equal ones go to the smaller number.
    """
    upper += moved[near]
    upper *= 1 + SLACK
    lower -= moved
    np.maximum(lower, 0, out=lower)
    lower *= 1 - SLACK
    half, nearest_other = between(centroids)
    rows = np.flatnonzero(~(nearest_other[near] > upper))
    if not len(rows):
        return 0
    made = 0
    best: np.ndarray = np.zeros(len(x), object if x.dtype == object or centroids.dtype == object else np.int64)
    for j in range(len(centroids)):  # tight upper bounds, where anything is open
        own = rows[near[rows] == j]
        best[own] = squared(x[own], centroids[j])
        made += len(own)
    upper[rows] = _root(best[rows], up=True)
    lower[rows, near[rows]] = _root(best[rows], up=False)
    for j in range(len(centroids)):
        asked = rows[(near[rows] != j) & ~(lower[rows, j] > upper[rows]) & ~(half[near[rows], j] > upper[rows])]
        if not len(asked):
            continue
        found = squared(x[asked], centroids[j])
        made += len(asked)
        lower[asked, j] = _root(found, up=False)
        closer = (found < best[asked]) | (found == best[asked]) & (j < near[asked])
        taken = asked[closer]
        near[taken], best[taken] = j, found[closer]
        upper[taken] = _root(best[taken], up=True)
    return made


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, v) of the rows whose vectors have exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter((F.size(v) == dims) & finite).select(F.col(id_col).alias("id"), v.alias("v"))


def starting_rows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """The ``k`` rows with the smallest hexadecimal SHA-256 of ``seed:id``; equal hashes by components, null ids last."""
    named = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    return named.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k)


def _packed(rows: DataFrame, scale: int, dims: int) -> DataFrame:
    """Blocks of vectors: ids, the components in the smallest integer width that holds them (or as decimal text), and no bounds yet."""
    kind = rows.schema["id"].dataType
    schema = T.StructType().add("ids", T.ArrayType(kind)).add("width", "integer").add("vectors", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = integers(np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dims), scale)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *_stored(x)], names=schema.names)

    return rows.select("id", "v").mapInArrow(work, schema)


def _stored(x: np.ndarray) -> list[pa.Array]:
    if x.dtype == object:
        return [pa.array([0], pa.int32()), pa.array([",".join(map(str, x.ravel())).encode()], pa.binary())]
    most = int(np.abs(x).max()) if x.size else 0
    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    return [pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())]


def _loaded(width: int, data: bytes, dims: int) -> np.ndarray:
    if width:
        return np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)
    return np.array([int(v) for v in data.decode().split(",")], object).reshape(-1, dims)


_BOUNDS = "near binary, upper binary, lower binary, counts array<bigint>, sums array<struct<at:int,limb:int,s:bigint>>"
#: Bits of a lower limb of a sum that doesn't fit 62 bits.
LIMB = 40


def limbs(value: int) -> list[tuple[int, int]]:
    """(limb, part) with value = sum of part * 2^(LIMB * limb); small values have one."""
    out = []
    while abs(value) >= 1 << 62:
        out.append((len(out), value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return [*out, (len(out), value)]


def _round(blocks: DataFrame, old: list[list[int]], new: list[list[int]], dims: int) -> DataFrame:
    """Every block with its vectors assigned anew, and the counts and sums of its clusters."""
    k, first = len(new), "near" not in blocks.columns
    names = ["ids", "width", "vectors", "near", "upper", "lower"]
    schema = T.StructType([*blocks.select("ids", "width", "vectors").schema.fields, *T.StructType.fromDDL(_BOUNDS).fields, T.StructField("made", T.LongType())])

    sums_type = pa.list_(pa.struct([("at", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, centroids = _centroid_array(old), _centroid_array(new)
        moved = np.array([_root(squared(before[j : j + 1], centroids[j]), up=True)[0] for j in range(k)])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = _loaded(row.column(1)[0].as_py(), row.column(2)[0].as_py(), dims)
                if first:
                    near, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), k))
                else:
                    near, upper, lower = (np.frombuffer(row.column(3 + j)[0].as_py(), t).copy() for j, t in enumerate((np.int32, np.float64, np.float64)))
                    lower = lower.reshape(-1, k)
                made = assign(x, near, upper, lower, centroids, moved)
                sums = [(j * dims + d, limb, part) for j in range(k) if (near == j).any() for d, s in enumerate(x[near == j].sum(axis=0)) for limb, part in limbs(int(s))]
                own = [near.tobytes(), upper.tobytes(), lower.tobytes()]
                columns = [*row.columns[:3], *[pa.array([b], pa.binary()) for b in own], pa.array([np.bincount(near, minlength=k).tolist()], pa.list_(pa.int64())), pa.array([[dict(zip(("at", "limb", "s"), x)) for x in sums]], sums_type), pa.array([made], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.select(*(names[:3] if first else names)).mapInArrow(work, schema)


def _centroid_array(centroids: list[list[int]]) -> np.ndarray:
    plain = all(abs(v) <= PLAIN for c in centroids for v in c)
    return np.array(centroids, np.int64 if plain else object)


def _means(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The floor of the mean of each cluster, exactly; an empty one stays. One row a cluster and component comes to the driver."""
    k = len(centroids)
    sums = [0] * (k * dims)
    for at, limb, s in blocks.select(F.inline("sums")).groupBy("at", "limb").agg(F.sum(F.col("s").cast(_SUM))).collect():
        sums[at] += int(s) << (LIMB * limb)
    counts = dict(blocks.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect())
    return [[sums[j * dims + d] // counts[j] for d in range(dims)] if counts.get(j) else centroids[j] for j in range(k)]


def _distances(blocks: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(ids, near, distances): the exact squared distance to the assigned centroid; null beyond a 64-bit number."""
    schema = T.StructType([blocks.schema["ids"], *T.StructType.fromDDL("near array<int>, distances array<bigint>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _centroid_array(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _loaded(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), dims)
                near = np.frombuffer(batch.column(3)[i].as_py(), np.int32)
                out = np.zeros(len(x), object)
                for j in range(len(c)):
                    own = np.flatnonzero(near == j)
                    out[own] = squared(x[own], c[j])
                found = [int(d) if d < 1 << 63 else None for d in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([near.tolist()], pa.list_(pa.int32())), pa.array([found], pa.list_(pa.int64()))], names=schema.names)

    return blocks.select("ids", "width", "vectors", "near").mapInArrow(work, schema)


def elkan_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector after ``rounds`` rounds and a last assignment.

    Vectors with exactly ``dims`` components, none null or non-finite, become integers floor(scale * x). Centroids start as the ``k``
    rows with the smallest SHA-256 of ``seed:id``. A round assigns every vector to the nearest centroid (squared distance, ties to the
    smaller number) and puts the floor of the mean in place of each centroid that has vectors. Each vector keeps an upper bound of the distance
    to its centroid and a lower one for every centroid; with half the distances between centroids they let most distances be left
    out. Bounds are rounded to the safe side and pruning is strict, so every tie is settled by exact integers.

    Blocks of vectors with their bounds go through a written table a round, so that a lost executor repeats one round of its own
    blocks; the driver holds ``k`` centroids, and a sum a cluster and component. No vectors, no rows; fewer than ``k``: as many clusters. Repeated rows count each; a
    null id takes part, last in the order of the start. Squared distances, and their sums, beyond a 64-bit number are null. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, id_col, vector_col, dims)
    start = [r["v"] for r in starting_rows(rows, k, seed).collect()]  # k rows
    centroids = integers(np.array(start, np.float64).reshape(-1, dims), scale).tolist()
    state, folder = written(_packed(rows, scale, dims))
    old = centroids
    for turn in range(rounds + 1 if centroids else 0):
        fresh, next_folder = written(_round(state, old, centroids, dims))
        remove(spark, folder)
        state, folder = fresh, next_folder
        old, centroids = centroids, _means(state, centroids, dims) if turn < rounds else centroids
    if not centroids:
        remove(spark, folder)
        kind = rows.schema["id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields]))
    held = cut(_distances(state, centroids, dims))
    remove(spark, folder)
    each = held.select(F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("near").alias("cluster"), F.col("distances").alias("distance"))))
    whole = {r["cluster"]: r["s"] for r in each.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast(_SUM))).alias("s")).collect()}  # a row a cluster
    fits = lambda s: F.lit(int(s) if s is not None and s < 1 << 63 else None).cast("long")
    total = None if None in whole.values() else sum(whole.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.array(*values)[F.col("cluster")]
    out: list[Column] = [F.col("id").alias(id_col), F.col("cluster"), F.col("distance")]
    return each.select(
        *out,
        of_cluster([fits(whole.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
        fits(total).alias("inertia"),
        of_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )
