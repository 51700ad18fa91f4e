"""Near-duplicates by bottom-k sketches: inverted lists, estimates on union sketches, exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.llm.shingles import shingle_sets, text_chunks
from bidlake.operators.components import list_components
from bidlake.operators.prefilter import likely_among
from bidlake.session import cut, let_go, unused

#: Retained values a sketch; sketches of sets linked at 0.8 have at least SHARED in common but for a chance below 1e-7.
SKETCH, SHARED = 48, 22
#: Parts of 15 bits that may fall together within a sketch, so that fewer are counted as common; more do with a chance below 1e-7.
COLLIDING = 4
#: Bits of the parities of a whole set: as many differ as elements do, or fewer.
PARITIES = 512
_PARITY = [f"p{i}" for i in range(PARITIES // 64)]


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def node_of(items: np.ndarray) -> int | None:
    """A 63-bit digest of a whole set."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest()) >> 1 if len(items) else None


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, node) of every row; the node is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, ends in text_chunks(batch.column(1)):
                found = [(len(items), node_of(items)) for items in shingle_sets(data, ends, words)]
                sizes, nodes = zip(*found)
                yield _batch(["id", "n_shingles", "node"], batch.column(0).slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(work, f"id {kind}, n_shingles long, node long")


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int = SKETCH) -> DataFrame:
    """(id, node, n, sketch, p0, p1, ...) of rows with words: the k smallest values of the set, and the parities of all."""
    names = ["id", "node", "n", "sketch", *_PARITY]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, ends in text_chunks(batch.column(1)):
                sets = [(at + i, items) for i, items in enumerate(shingle_sets(data, ends, words)) if len(items)]
                odd = np.stack([np.zeros(PARITIES, np.uint8), *(np.bincount(items & (PARITIES - 1), minlength=PARITIES) & 1 for _, items in sets)])[1:].astype(np.uint8)
                bits = np.packbits(odd, axis=1).view(np.int64)
                ids = batch.column(0).take(pa.array([i for i, _ in sets], pa.int64()))
                nodes, sizes = pa.array([node_of(items) for _, items in sets], pa.int64()), pa.array([len(items) for _, items in sets], pa.int64())
                yield _batch(names, ids, nodes, sizes, _lists([items[:k] for _, items in sets]), *[pa.array(bits[:, i]) for i in range(len(_PARITY))])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, node long, n long, sketch array<long>, {', '.join(f'{p} long' for p in _PARITY)}"
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(work, schema)


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, items) of the first column's texts: all shingles; texts without any are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, ends in text_chunks(batch.column(0)):
                sets = [items for items in shingle_sets(data, ends, words) if len(items)]
                yield _batch(["node", "items"], pa.array(map(node_of, sets), pa.int64()), _lists(sets))

    return texts.mapInArrow(work, "node long, items array<long>")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shingle-set size and the component of rows linked by 100 * intersection >= percent * union.

    Sets equal as wholes are one node. Each node's SKETCH smallest hashes are its sketch. For the inverted lists, a sketch's values
    are taken rarest first, as many as a link can't avoid: all but one less than the values that linked sketches share (for sets no
    larger than ``SKETCH * percent / 100``, whose partners' sketches are whole sets too, that is exact; for larger ones SHARED).
    Pairs from the lists (see ``list_components``) must pass a bound on their differing elements that loses no link, the
    parities, then an estimate on the smallest values of the union, then the exact count on full sets, read again from the texts.

    Rows with a null or wordless text have an empty set and are each their own component; a null id is only its component's
    smallest where no other is; repeated ids are rows of their own. ``percent`` is to be 80 or more.
    Returns id, n_shingles, component_id, kept (id = component_id); an empty table gives no rows.
    """
    rows = cut(shingled(docs, id_col, text_col, words))
    first = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("first_id"))
    found = sketches(docs, id_col, text_col, words)
    nodes = cut(found.drop("id").dropDuplicates(["node"]))
    let_go(docs.sparkSession)
    values = nodes.select(F.col("node").alias("id"), "n", F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    often = cut(values.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("f")).filter("f > 1"))
    let_go(docs.sparkSession)
    mine = W.partitionBy("id")
    whole = SKETCH * percent // 100
    need = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(SHARED))
    postings = (
        likely_among(values, F.col("key"), often, "key")
        .join(often, "key")
        .withColumn("rank", F.col("m") - F.count(F.lit(1)).over(mine))  # values that no other sketch has
        .withColumn("_at", F.col("rank") + F.row_number().over(mine.orderBy("f", "key")))
        .filter(F.col("_at") <= F.col("m") - need + 1)
        .select("key", "id", "rank", F.col("n").alias("size"))
    )
    parts = F.transform("sketch", lambda v: F.shiftrightunsigned(v, 24).bitwiseAND(0x7FFF).cast("short"))
    about = nodes.select(F.col("node").alias("id"), "n", *_PARITY, parts.alias("parts"))

    def near(x: str, y: str) -> Column:
        """Not too many differing elements, and as many common parts of sketch values as linked sets have, or more."""
        whole = (F.col(f"{x}.n") <= SKETCH) | (F.col(f"{y}.n") <= SKETCH)
        apart = _differing(f"{x}.", f"{y}.") * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)
        return apart & (whole | (F.size(F.array_intersect(f"{x}.parts", f"{y}.parts")) >= SHARED - COLLIDING))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = about.withColumnRenamed("id", "a").alias("x"), about.withColumnRenamed("id", "b").alias("y")
        close = cut(pairs.join(x, "a").join(y, "b").filter(near("x", "y")).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb")))
        met = likely_among(nodes.select("node", "sketch"), F.col("node"), close.select(F.explode(F.array("a", "b")).alias("node")), "node")
        sx, sy = (met.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        likely = cut(close.join(sx, "a").join(sy, "b").filter(_alike("sa", "sb", "na", "nb", percent)).select("a", "b", "na", "nb"))
        if not likely.head(1):
            return likely
        wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = cut(first.join(wanted, "node").select(F.xxhash64("first_id").alias("_hash")))
        texts = likely_among(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.xxhash64("_id"), ids, "_hash").select("_text")  # nulls have a hash
        sets = likely_among(full_sets(texts, words), F.col("node"), wanted, "node").join(wanted, "node").dropDuplicates(["node"])  # texts of other ids go here
        held = likely.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
        both = F.size(F.array_intersect("ia", "ib"))
        return held.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")

    linked = list_components(postings, verify, near, about, percent)
    placed = first.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(names, "root").select("node", "component_id")
    out = rows.join(placed, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _differing(x: str, y: str) -> Column:
    """Bits in which two sets' parities differ: no more than elements that only one of them has."""
    return reduce(add, [F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in _PARITY])


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first, by id and hash of the text, of their group of near-duplicates; rows without words all stay.

    Of rows equal in id and text one stays. Only where ids are repeated do keys carry the hash; else ids alone say as much.
    """
    b = unused(docs.columns)
    if docs.groupBy(id_col).count().filter("count > 1").limit(1).count():
        key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))  # a null id comes last
        keyed, name = docs.withColumn(f"{b}key", key).dropDuplicates([id_col, f"{b}key"]), f"{b}key"
    else:
        keyed, name = docs, id_col
    found = cut(near_duplicates(keyed.select(name, text_col), words, percent, name, text_col).filter("kept").select(F.col(name).alias(f"{b}kept")))
    return keyed.join(found, F.col(name).eqNullSafe(F.col(f"{b}kept")), "left_semi").select(*docs.columns)


def _alike(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """Whether the share of the smallest values of the union that both have allows the similarity; exact if the sketches are whole sets."""
    both = F.array_intersect(x, y)
    least = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    exact = 100 * F.size(both) >= percent * (F.col(n) + F.col(m) - F.size(both))
    return F.when((F.col(n) <= SKETCH) & (F.col(m) <= SKETCH), exact).otherwise(F.size(F.array_intersect(least, both)) >= SHARED)
