"""Reports, life cycle of jobs, and replays of recorded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Failures that end an item at once, and those after which an agent isn't tried again.
ABORTING = ["prompt_injection", "blocked_url"]
FINAL = ["login_required", "registration_required", "captcha", "not_found", "expired", "blocked_url"]
#: Walls that end the loop of generating and running.
HARD_WALLS = ["login_required", "registration_required", "captcha", "expired"]


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ground_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Each expected URL with what was got: Missing, Failed, Under, Over or Exact, and recall capped at 1."""
    joined = truth.join(results, "url", "left")
    got = F.coalesce("got", F.lit(0))
    flag = F.when(F.col("got").isNull(), "Missing").when(got == 0, "Failed").when(got < F.col("expected"), "Under").when(got > F.col("expected"), "Over").otherwise("Exact")
    recall = F.when(F.col("expected") > 0, F.least(F.lit(1.0), got / F.col("expected"))).otherwise(F.when(got > 0, 1.0).otherwise(0.0))
    return joined.select("url", "expected", got.alias("got"), flag.alias("flag"), recall.alias("recall"))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two reports that only one has, or whose values differ; nulls equal nulls."""
    a, b = left.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a")), right.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, keys, "full_outer").withColumn("kind", kind).filter("kind is not null").select(*keys, "a", "b", "kind")


def costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Money of a run: tokens by the model's prices for a million; models without a price cost nothing. Prices are a catalogue, a row a model."""
    priced = runs.join(F.broadcast(prices), "model", "left")
    zero = F.lit(0)
    return priced.select("id", ((F.col("tokens_in") * F.coalesce("price_in", zero) + F.col("tokens_out") * F.coalesce("price_out", zero)) / 1e6).alias("cost"))


def model_report(runs: DataFrame) -> DataFrame:
    """By model: runs, successes, runtimes with the upper median, and runtime a success and a document.

    The median is read off running counts of different runtimes, so no model's runs are collected.
    """
    each = runs.groupBy("model", "runtime_units").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("model").orderBy("runtime_units"))
    placed = each.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy("model")))
    median = placed.filter("upto > all div 2").groupBy("model").agg(F.min("runtime_units").alias("upper_median"))
    solved = _count(F.col("success"))
    sums = runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), solved.alias("solved"), F.min("runtime_units").alias("shortest"), F.max("runtime_units").alias("longest"), F.sum("downloaded").alias("documents"),
        (F.sum("runtime_units") / F.when(solved > 0, solved)).alias("per_success"), (F.sum("runtime_units") / F.when(F.sum("downloaded") > 0, F.sum("downloaded"))).alias("per_document"),
    )
    return sums.join(median, "model")


def causes(items: DataFrame, key: str) -> DataFrame:
    """Failures by their message's first 120 letters, and their share of all failures of the key."""
    each = items.filter("status = 'failed'").groupBy(key, F.substring("error_message", 1, 120).alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(key)))


def replayed(items: DataFrame, most: int | None = None, stops: list[str] | None = None) -> DataFrame:
    """Attempts that are really made: a job's items in order until one succeeds, ``most`` are made, or one fails for a reason in ``stops``."""
    ended = (F.col("status") == "success") | (F.col("status") == "failed") & F.coalesce(F.col("failure_category").isin(stops or []), F.lit(False))
    before = W.partitionBy("job_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    placed = items.withColumn("attempt", F.row_number().over(W.partitionBy("job_id").orderBy("id"))).withColumn("over", F.coalesce(F.bool_or(ended).over(before), F.lit(False)))
    made = placed.filter(~F.col("over")) if most is None else placed.filter(~F.col("over") & (F.col("attempt") <= most))
    return made.select("job_id", "attempt", "id", "status")


def outcomes(made: DataFrame) -> DataFrame:
    """One row a job of the attempts made: how many, and whether the last succeeded."""
    return made.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("status") == "success").alias("success"))


def cascade_wins(items: DataFrame) -> DataFrame:
    """By domain and strategy the jobs that it was first to solve."""
    first = items.filter("status = 'success'").groupBy("job_id").agg(F.min(F.struct("id", "domain", "strategy")).alias("w"))
    return first.groupBy(F.col("w.domain").alias("domain"), F.col("w.strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("wins"))


def created(urls: DataFrame) -> DataFrame:
    """Items of new jobs from (job_id, position, url): blank URLs left out, the rest pending and numbered anew, at most 500 a job."""
    trimmed = urls.withColumn("url", F.trim("url")).filter("url <> ''")
    nth = F.row_number().over(W.partitionBy("job_id").orderBy("position"))
    return trimmed.withColumn("item", nth).filter("item <= 500").select("job_id", "item", "url", F.lit("pending").alias("status"))


def stopped(items: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Items after the jobs of ``job_ids`` were stopped: what wasn't done has failed and says so."""
    marked = items.join(job_ids.select("job_id").distinct().withColumn("stop", F.lit(True)), "job_id", "left")
    now = F.coalesce("stop", F.lit(False)) & F.col("status").isin("pending", "running")
    return marked.select("id", "job_id", F.when(now, "failed").otherwise(F.col("status")).alias("status"), F.when(now, "Stopped by user").otherwise(F.col("error_message")).alias("error_message"))


def without_jobs(rows: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Rows that are left when jobs are deleted with all that hangs on them."""
    return rows.join(job_ids.select("job_id").distinct(), "job_id", "left_anti")


def guarded(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Whether the stored scraper of an item's domain may run: none, recorded by an agent, retired, or hit. One template a domain."""
    joined = items.join(templates.select("domain", "source", "retired"), "domain", "left")
    guard = F.when(F.col("source").isNull(), "no_template").when(F.col("source") == "cua", "agent_template").when(F.col("retired"), "retired").otherwise("hit")
    return joined.select("id", guard.alias("guard"))


def registered(templates: DataFrame, manual: DataFrame) -> DataFrame:
    """Templates after manual ones came: they replace all but manual ones, which stay as they are."""
    old = templates.select("domain", "source", "code")
    kept = old.join(manual.select("domain"), "domain", "left_anti").unionByName(old.join(manual.select("domain"), "domain", "left_semi").filter("source = 'manual'"))
    added = manual.select("domain", F.lit("manual").alias("source"), "code").join(old.filter("source = 'manual'").select("domain"), "domain", "left_anti")
    return kept.unionByName(added)
