"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.operators.running import running_totals
from bidlake.session import cut, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, and the most times that a source is gone through.
BLOCK, EPOCHS = 128, 3
#: The golden ratio's fraction in units of 2^-31, odd, so that the points of one period are all different.
CYCLE, STEP = 1 << 31, 1327217885
CELLS = 1024


def word_count(text) -> F.Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """Targets of (source, source_size): weights 1, 2, 3 repeating by code point, null last, capped and reshared.

    With one level t for all, a source gets min(3 * size, t * weight); t makes the sum that of all sizes.
    That is what resharing the excess by weight until none is above ends at. Sorted by 3 * size / weight,
    the capped sources come first, so running sums over one row a source find t without a loop.
    """
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_cap", "_rank")
    upto, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    levels = (
        sources.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("_rank") - 1) % 3 + 1).cast("double"))
        .withColumn("_cap", EPOCHS * F.col("source_size") / F.col("weight"))
        .withColumn("_left", total - F.coalesce(F.sum(EPOCHS * F.col("source_size")).over(upto), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("weight").over(after))
    )
    # The first source that its level leaves uncapped has the level of all.
    level = F.min(F.when(F.col("_level") <= F.col("_cap"), F.struct("_cap", "_rank", "_level"))).over(W.partitionBy())["_level"]
    return levels.withColumn("target", F.least(EPOCHS * F.col("source_size").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0)))).select(
        "source", "source_size", "weight", "target", "_rank"
    )


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots (position, source number, rank): the i-th point i * phi mod 1 falls into one source's share of [0, 1).

    The slots of a source are ranked in order. The points give a source its share of the slots up to a few;
    a source that is a few short gets them after the others, and ranks past its target are left out.
    """
    running = W.orderBy("_rank")
    shares = targets.filter("target > 0").withColumn("_high", F.sum("target").over(running) / F.sum("target").over(W.partitionBy()))
    shares = shares.withColumn("_low", F.coalesce(F.lag("_high").over(running), F.lit(0.0))).withColumn("_need", F.ceil(F.col("target") / block))
    cells = shares.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_low") * CELLS), F.least(F.lit(CELLS - 1).cast("long"), F.floor(F.col("_high") * CELLS))))
    ).select("_rank", "_low", "_high", "_cell", "_need")
    spark = targets.sparkSession
    n = targets.agg(F.coalesce(F.ceil(F.sum("target") / block), F.lit(0)).alias("n")).first()["n"]
    points = (
        spark.range(0, n)
        .withColumnRenamed("id", "at")
        .withColumn("_u", ((F.col("at") + 1) % CYCLE * STEP % CYCLE) / F.lit(float(CYCLE)))
        .withColumn("_cell", F.floor(F.col("_u") * CELLS))
    )
    hit = (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high"))
    drawn = points.join(F.broadcast(cells), "_cell").filter(hit).select("_rank", "at", F.lit(1).alias("_one"))  # a row a source and cell
    ranked = cut(running_totals(drawn, ["_rank", "at"], "_one", "_before", "_pos").select("_rank", "at", "_pos"))  # used three times
    firsts = ranked.groupBy("_rank").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_got"))
    inside = ranked.join(F.broadcast(firsts), "_rank").select("at", "_rank", (F.col("_pos") - F.col("_first")).alias("slot"))  # a row a source
    short = shares.join(firsts, "_rank", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    extra = (
        short.filter("_got < _need").select("_rank", F.explode(F.sequence(F.col("_got"), F.col("_need") - 1)).alias("slot"))
    ).select((F.lit(n) + F.col("slot")).alias("at"), "_rank", "slot")
    return inside.unionByName(extra)


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each row; one row per row of ``docs``.

    The rows of a source, shuffled by a hash of id and seed, form an endless tape that repeats; it is cut into
    blocks of ``block`` words, and the source's slot of rank r in the schedule takes block r, up to the source's target.
    So a source's taken words are its target rounded down, and no row is taken more than 3 times.

    A null text or one without words has size 0 and gives nothing; a null source is a source of its own, the last; equal
    ids and repeated rows are rows of their own; an empty table gives no rows; other columns are left out.
    Returns id, source, size, source_size, target, taken, and ``first_slot``, the schedule position of the row's first words (null: none).
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_mixed")
    )
    tape = running_totals(rows, ["source", "_mixed", "_id", "size"], "size", "_start", "_nth")
    sizes = cut(tape.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_start").alias("_zero")))
    targets = cut(source_targets(sizes.drop("_zero")).join(sizes.select(F.col("source").alias("_s"), "_zero"), F.col("_s").eqNullSafe(F.col("source"))).drop("_s"))
    known = tape.withColumnRenamed("source", "_s").join(F.broadcast(targets), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")  # a row a source
    known = cut(known.withColumn("_start", F.col("_start") - F.col("_zero")))  # a few numbers a row, used twice
    goal = F.floor("target").cast("long")
    spans = (
        known.filter("size > 0")
        .select("_nth", "_rank", "size", "source_size", goal.alias("_goal"), "_start", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("_epoch"))
        .withColumn("_from", F.col("_start") + F.col("_epoch") * F.col("source_size"))
        .withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_goal")))
        .filter("_from < _to")
        .withColumn("slot", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
        .select("_nth", "_rank", "slot", (F.least("_to", (F.col("slot") + 1) * block) - F.greatest("_from", F.col("slot") * block)).alias("_words"))
    )
    taken = (
        spans.join(schedule(targets, block), ["_rank", "slot"])
        .groupBy("_nth")
        .agg(F.sum("_words").alias("taken"), F.min("at").alias("first_slot"))
    )
    return known.join(taken, "_nth", "left").select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def repeat_documents(docs: DataFrame, block: int = BLOCK, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as often as ``mix_sources`` goes through it, begun passes counted; rows that it doesn't take are left out.

    Rows equal in id and source get the same number of copies, the largest of theirs. Columns stay as they are.
    """
    found = mix_sources(docs, block, seed, id_col, text_col, source_col).filter("taken > 0")
    b = unused(docs.columns)
    most = F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(f"{b}times")
    times = found.groupBy(F.col(id_col).alias(f"{b}id"), F.col("source").alias(f"{b}source")).agg(most)
    met = docs.join(times, docs[id_col].eqNullSafe(times[f"{b}id"]) & docs[source_col].eqNullSafe(times[f"{b}source"])).filter(word_count(docs[text_col]) > 0)
    return met.withColumn(f"{b}copy", F.explode(F.sequence(F.lit(1), F.col(f"{b}times")))).select(*docs.columns)
