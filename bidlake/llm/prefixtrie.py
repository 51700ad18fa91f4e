"""The prefix trie of conversations: chains owned by the smallest conversation, found by binary search over digest minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.session import cut, let_go

#: Turns that a rebuilt conversation takes from the first of its family, and the size of a family.
HEADS, FAMILY = 9, 5
DIGEST = ["a", "b"]


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, str] | None = None, digests: list[str] | None = None, nth: str | None = None) -> DataFrame:
    """``rows`` with running sums, running exclusive-ors and the number (from 0) of each row within its key, none of which needs a key in one task.

    Rows are range-partitioned by key and ``order`` and cut there, so that a key with many rows lies in several partitions. Each partition works
    out its own; a key that goes on from earlier partitions also gets what they hold of it, which is at most one row a border.
    ``sums`` names the new column of each summed one; digests are replaced. Rows equal in ``order`` stand either way.
    """
    sums, digests = sums or {}, digests or []
    ranged = cut(rows.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    totals = [F.sum(c).alias(f"_sum_{c}") for c in sums] + [F.bit_xor(c).alias(f"_xor_{c}") for c in digests]
    pieces = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"), *totals)
    ends = ranged.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    # Keys at a partition's ends are the only ones that can lie in several: at most two rows a partition.
    bordering = ends.select(F.explode(F.array("_low", "_high")).alias(key)).groupBy(key).count().filter("count > 1").select(key)
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = pieces.join(F.broadcast(bordering), key)
    carried = parts.select(
        F.col(key).alias("_key"),
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.coalesce(F.bit_xor(f"_xor_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in digests],
    )
    within = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = ranged.join(F.broadcast(carried), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    new = {n: F.sum(c).over(within) + F.coalesce(f"_before_{c}", F.lit(0)) for c, n in sums.items()}
    new |= {c: F.bit_xor(c).over(within).bitwiseXOR(F.coalesce(f"_before_{c}", F.lit(0).cast("long"))) for c in digests}
    if nth:
        new[nth] = F.row_number().over(within) - 1 + F.coalesce("_rows_before", F.lit(0))
    return met.withColumns(new).select(*[c for c in rows.columns if c not in new], *new)


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, a, b, bytes) of every row with a conversation: two 64-bit hashes of role and text, and the text's UTF-8 bytes; null role or text: empty.

    From here on no text is moved.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    named = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    return named.select("conv", "turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("bytes"))


def in_order(digests: DataFrame) -> DataFrame:
    """(conv, depth, a, b, bytes), depth from 1, by turn; a null turn is first, equal turns stand by their hashes, so that texts needn't be sorted."""
    placed = running(digests, "conv", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], nth="nth")
    return placed.select("conv", (F.col("nth") + 1).alias("depth"), "a", "b", "bytes")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first, and all their ids, as (conv, depth, a, b, bytes) and (conv).

    Conversation c takes the first h turns of c - c % 5, h being the CRC-32 of its decimal id modulo 9, then its own after its first h.
    The heads are at most 8 turns of a family's first, each taken by at most 5; own turns stay where they are but for their depth.
    """
    lengths = cut(ordered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    first = F.col("conv") - F.pmod(F.col("conv"), F.lit(FAMILY))
    heads = lengths.select("conv", first.alias("first"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).alias("h"))
    known = heads.join(lengths.select(F.col("conv").alias("first"), F.col("n").alias("of_first")), "first", "left")
    plan = cut(known.select("conv", "first", "h", F.least("h", F.coalesce("of_first", F.lit(0))).alias("taken")))
    own = ordered.join(plan.select("conv", "h", "taken"), "conv").filter("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    of_first = ordered.filter(F.col("depth") < HEADS).filter(F.pmod("conv", F.lit(FAMILY)) == 0).withColumnRenamed("conv", "first")
    head = plan.filter("taken > 0").join(of_first, "first").filter("depth <= taken").select("conv", "depth", "a", "b", "bytes")
    return own.unionByName(head), plan.select("conv")


def _owners(asked: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, depth, ..., owner) of asked prefixes (conv, depth, a, b, ...)."""
    return asked.join(minima.select("depth", *DIGEST, "owner"), ["depth", *DIGEST]).drop(*DIGEST)


def first_owned(prefixes: DataFrame, minima: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv, head, parent) of every conversation that owns a prefix: the least depth at which it is the smallest of all that begin alike, and who owns the prefix before.

    Who is smallest at a depth is so at all greater depths, so the depth is found by halving. ``whole`` has (conv, depth, owner) of whole conversations:
    those that don't own their last prefix own none. Each batch joins a prefix a conversation with the minima by digest, where Spark splits skewed digests.
    """
    least = minima.filter("depth = 0").select(F.col("owner").alias("conv"))  # one row: it owns all its prefixes, the root included
    searched = cut(whole.filter("owner = conv and depth > 0").join(F.broadcast(least), "conv", "left_anti").select("conv", F.lit(1).cast("long").alias("low"), F.col("depth").alias("high")))
    while searched.filter("low < high").head(1):
        asked = searched.filter("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        held = _owners(asked.join(prefixes.select("conv", "depth", *DIGEST), ["conv", "depth"]), minima)
        stepped = held.select("conv", F.when(F.col("owner") == F.col("conv"), F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(F.col("owner") == F.col("conv"), F.col("depth")).otherwise(F.col("high")).alias("high"))
        searched = cut(stepped.unionByName(searched.filter("low >= high")))
        let_go(prefixes.sparkSession)
    before = searched.select("conv", F.col("low").alias("head"), (F.col("low") - 1).alias("depth"))
    inner = _owners(before.filter("depth > 0").join(prefixes.select("conv", "depth", *DIGEST), ["conv", "depth"]), minima).select("conv", "head", F.col("owner").alias("parent"))
    outer = before.filter("depth = 0").crossJoin(F.broadcast(least.withColumnRenamed("conv", "parent"))).select("conv", "head", "parent")  # one row
    return cut(inner.unionByName(outer).unionByName(least.select("conv", F.lit(0).cast("long").alias("head"), F.lit(None).cast("long").alias("parent"))))


def chain_totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """(conv, *values): each chain's values with those of all chains below it, of chains (conv, parent, *values).

    From the bottom up by doubling: after round k a chain holds the values of those less than 2^k chains below it, and adds what
    those exactly 2^k below hold. Sums are combined before they are shuffled, so a chain may have any number of others below it.
    """
    held = cut(chains.select("conv", F.col("parent").alias("above"), *values))
    while held.filter("above is not null").head(1):
        given = held.filter("above is not null").groupBy("above").agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumnRenamed("above", "conv")
        higher = held.select(F.col("conv").alias("above"), F.col("above").alias("_next"))
        added = held.join(given, "conv", "left").join(higher, "above", "left")
        held = cut(added.select("conv", F.col("_next").alias("above"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        let_go(chains.sparkSession)
    return held.select("conv", *values)


def id_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of (owner, depth, conv): the SHA-256 of each node's ids in ascending order, joined by commas.

    The ids of a node are cut by ranges and joined within them, so that a node with very many comes as a few long pieces; these go through
    the hash one after another in one task, as a SHA-256 must, of which no two need be in memory.
    """
    ranged = cut(ends.select("owner", "depth", "conv").repartitionByRange("owner", "depth", "conv").withColumn("_part", F.spark_partition_id()))
    joined = ranged.groupBy("owner", "depth", "_part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))  # within a range

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (owner, depth) == key:
                    digest.update(b",")
                else:
                    done += [(*key, digest.hexdigest())] if key else []
                    key, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _digest_rows(done)
        yield _digest_rows([(*key, digest.hexdigest())] if key else [])

    placed = joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "_part").select("owner", "depth", "_part", "ids")
    return placed.mapInArrow(work, "conv long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["conv", "depth", "ends_sha256"])


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every different sequence of first turns of (conv, depth, a, b, bytes); ``convs`` has all conversations, also those without turns.

    Returns conv_id (the smallest with that beginning), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Sequences are told apart by two 64-bit exclusive-ors of hashes of turn and depth: of n different ones about n^2 / 2^129 pairs are taken for
    equal. Without conversations there are no rows.
    """
    salted = turns.select("conv", "depth", *[F.xxhash64("depth", c).alias(c) for c in DIGEST], "bytes")
    prefixes = cut(running(salted, "conv", [F.col("depth")], digests=DIGEST))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "owner", "n_convs", zero.alias("bytes"))
    minima = cut(prefixes.groupBy("depth", *DIGEST).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")).unionByName(root))
    last = prefixes.groupBy("conv").agg(F.max(F.struct("depth", *DIGEST)).alias("_last")).select("conv", "_last.*")
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("depth", *DIGEST)])
    whole = cut(_owners(ends, minima).select("conv", "depth", "owner"))
    chains = first_owned(prefixes, minima, whole)

    nodes = minima.select(F.col("owner").alias("conv"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    hung = chains.filter("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("head") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    length = whole.filter("owner = conv").select("conv", F.col("depth").alias("length"))
    about = nodes.join(length, "conv").join(hung, ["conv", "depth"], "left").withColumn("hung", F.coalesce("hung", zero))
    about = about.select("conv", "depth", "n_convs", "saved", (F.col("hung") + F.when(F.col("depth") < F.col("length"), 1).otherwise(0)).alias("n_children"))
    about = cut(about.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    own = about.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = cut(chain_totals(chains.join(own, "conv"), ["leaves", "saved"]))
    given = chains.filter("parent is not null").join(totals, "conv").groupBy(F.col("parent").alias("conv"), (F.col("head") - 1).alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    weighed = about.join(given, ["conv", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", zero) for c in ("leaves", "saved")}).drop("_leaves", "_saved")
    summed = running(weighed, "conv", [F.col("depth").desc()], sums={"leaves": "n_leaves", "saved": "saved_tokens"})

    shown = summed.join(chains.select("conv", F.col("head").alias("depth"), "parent", F.lit(True).alias("is_head")), ["conv", "depth"], "left").join(id_digests(whole), ["conv", "depth"], "left")
    return shown.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("is_head"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns as it stands: see ``trie_nodes``.

    Turns are taken in ascending order, a null turn first, equal turns by their hashes; a null role or text is an empty one; repeated rows are turns of their
    own. Rows with a null conversation belong to none and are left out. One conversation, beginning or group of copies may hold most of the
    rows. Other columns don't matter.
    """
    turns = cut(in_order(turn_digests(conversations, conv_col, turn_col, role_col, text_col)))
    return trie_nodes(turns, turns.select("conv").distinct())


def family_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes of a table (conv_id, turn, role, text)."""
    turns, convs = rebuilt(cut(in_order(turn_digests(conversations))))
    return trie_nodes(turns, convs)
