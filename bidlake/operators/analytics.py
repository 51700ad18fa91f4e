"""Aggregations over items, attempts, runs, jobs and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.functions import classify, rules


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def succeeded() -> Column:
    return F.col("status") == "success"


def failed() -> Column:
    return F.col("status") == "failed"


def kpis(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: jobs, items by state, share of successes among finished items, cost."""
    by_item = items.agg(F.count(F.lit(1)).alias("items"), _count(succeeded()).alias("succeeded"), _count(failed()).alias("failed"), _count(F.col("status") == "pending").alias("pending"))
    by_job = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("cost_units").alias("cost_units"))
    done = F.col("succeeded") + F.col("failed")
    return by_item.join(by_job).withColumn("success_rate", F.when(done > 0, F.col("succeeded") / done).otherwise(0.0))  # one row each


def strategy_distribution(items: DataFrame) -> DataFrame:
    """Every strategy, also those without an item."""
    spark = items.sparkSession
    known = spark.createDataFrame([(s,) for s in rules.STRATEGIES], "strategy string")
    counted = items.groupBy("strategy").agg(F.count(F.lit(1)).alias("items"), _count(succeeded()).alias("successes"))
    return known.join(counted, "strategy", "left").na.fill(0, ["items", "successes"])


def error_categories(items: DataFrame) -> DataFrame:
    """Failed items by the category that their message has now."""
    by_message = items.filter(failed()).groupBy("error_message").agg(F.count(F.lit(1)).alias("n"))
    return by_message.groupBy(classify.error_category(F.col("error_message")).alias("category")).agg(F.sum("n").alias("n"))


def outcome_buckets(items: DataFrame) -> DataFrame:
    """Finished items by outcome bucket."""
    by_message = items.filter(succeeded() | failed()).groupBy(succeeded().alias("_fine"), F.when(failed(), F.col("error_message")).alias("_message")).agg(F.count(F.lit(1)).alias("n"))
    bucket = classify.outcome_bucket(classify.error_category(F.col("_message")), F.col("_fine"))
    found = by_message.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    return found.withColumn("label", classify.bucket_label(F.col("bucket"))).withColumn("needs_manual", classify.needs_manual(F.col("bucket")))


def needs_manual(items: DataFrame) -> DataFrame:
    """Items whose stored category a human can resolve."""
    bucket = classify.outcome_bucket(F.col("failure_category"))
    found = items.withColumn("bucket", bucket).filter(F.col("failure_category").isNotNull() & classify.needs_manual(F.col("bucket")))
    return found.select("id", "bucket", classify.bucket_label(F.col("bucket")).alias("label"), F.substring("error_message", 1, 300).alias("reason"), classify.suggested_action(F.col("bucket")).alias("action"), F.col("url").alias("retry_url"))


def by_model(runs: DataFrame, key: str = "model") -> DataFrame:
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"), (_count(F.col("success")) / F.count(F.lit(1))).alias("success_rate"), (F.sum("runtime_units") / F.count(F.lit(1))).alias("avg_runtime_units"),
        F.sum("downloaded").alias("documents"),
    )


def by_strategy(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Finished items by strategy; a job's cost is shared by all of its items, of which only the finished ones are summed."""
    sizes = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("_size"))
    costs = jobs.filter("cost_units > 0").select(F.col("id").alias("job_id"), "cost_units")
    shares = items.filter(succeeded() | failed()).groupBy("job_id", "strategy").agg(F.count(F.lit(1)).alias("n"), _count(succeeded()).alias("s"), F.sum("runtime_seconds").alias("r"))
    share = F.floor(F.coalesce("cost_units", F.lit(0)) * F.col("n") / F.col("_size"))
    joined = shares.join(sizes, "job_id").join(costs, "job_id", "left").withColumn("_share", share)
    out = joined.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(F.sum("n").alias("total"), F.sum("s").alias("success"), F.sum("r").alias("_r"), F.sum("_share").alias("cost_units"))
    return out.select("strategy", "total", "success", (F.col("success") / F.col("total")).alias("success_rate"), (F.col("_r") / F.col("total")).alias("avg_runtime_s"), "cost_units")


def by_platform(items: DataFrame) -> DataFrame:
    """Finished items by platform of their URL, with the most frequent strategy (ties: by name)."""
    by_url = items.filter(succeeded() | failed()).groupBy("url", F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"), _count(succeeded()).alias("s"))
    done = classify.with_classes(by_url, "url", {"platform": classify.platform(F.col("_value"))}).groupBy("platform", "strategy")
    counted = done.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = F.row_number().over(W.partitionBy("platform").orderBy(F.desc("n"), "strategy"))
    ranked = counted.withColumn("_most", most)
    out = ranked.groupBy("platform").agg(F.sum("n").alias("total"), F.sum("s").alias("success"), F.max(F.when(F.col("_most") == 1, F.col("strategy"))).alias("dominant_strategy"))
    return out.withColumn("success_rate", F.col("success") / F.col("total"))


def attempts_of(items: DataFrame) -> DataFrame:
    """Items rolled up to one row a job with its attempts in order, as they are recorded."""
    attempt = F.struct("iterations", "id", "strategy", succeeded().alias("success"), F.col("runtime_seconds").cast("string").alias("duration_s"))
    return items.groupBy("job_id").agg(F.sort_array(F.collect_list(attempt)).alias("attempts_detail"))


def by_attempts(recorded: DataFrame) -> DataFrame:
    """Every attempt counts; a duration that is no number counts 0."""
    each = recorded.select(F.explode("attempts_detail").alias("a")).select("a.*")
    duration = F.coalesce(F.col("duration_s").try_cast("double"), F.lit(0.0))
    out = each.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(F.count(F.lit(1)).alias("attempts"), _count(F.col("success")).alias("successes"), F.sum(duration).alias("_d"))
    return out.select("strategy", "attempts", "successes", (F.col("successes") / F.col("attempts")).alias("success_ratio"), (F.col("_d") / F.col("attempts")).alias("avg_duration_s"))


def failures_top(items: DataFrame, most: int = 15) -> DataFrame:
    """The most frequent stored categories of failed items (ties: by name)."""
    return items.filter(failed() & F.col("failure_category").isNotNull()).groupBy("failure_category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "failure_category").limit(most)


def scraper_health(templates: DataFrame) -> DataFrame:
    s, f = F.col("success_count"), F.col("failure_count")
    return templates.select("domain", "success_count", "failure_count", (s / F.when(s + f > 0, s + f)).alias("success_rate"), classify.health(s, f).alias("health"), classify.should_retire(s, f).alias("retire"))


def job_rollup(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """A job succeeds or fails with all of its items, else it is partial; one without items has failed none and done none."""
    counted = items.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), _count(succeeded()).alias("successes"), _count(succeeded() | failed()).alias("completed"))
    joined = jobs.join(counted, "id", "left").na.fill(0, ["total", "successes", "completed"])
    status = F.when((F.col("total") > 0) & (F.col("successes") == F.col("total")), "success").when(F.col("successes") == 0, "failed").otherwise("partial")
    return joined.select("id", "total", "successes", "completed", status.alias("status"))


def diagnostics(items: DataFrame) -> DataFrame:
    """By job: items by raw state, categories of failures, domains."""
    category = F.when(failed(), classify.error_category(F.col("error_message")))
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("items"), _count(succeeded()).alias("success"), _count(failed()).alias("failed"), _count(F.col("status") == "pending").alias("pending"),
        F.countDistinct("domain").alias("domains"), F.countDistinct(category).alias("categories"),
    )


def error_report(items: DataFrame) -> DataFrame:
    """Failed items with category and risk of their message."""
    rows = items.filter(failed())
    category = classify.error_category(F.col("error_message"))
    return rows.select("job_id", "id", "domain", "strategy", "error_message", category.alias("category"), classify.error_risk(category).alias("risk"))


def attempt_report(items: DataFrame, recorded: DataFrame) -> DataFrame:
    """A row for each attempt of ``recorded`` (job_id, attempts_detail) of jobs with failed items; a failed item of a job without any keeps one row.

    The attempts are exploded, and each carries its place, counted from 1.
    """
    failures = items.filter(failed()).select("job_id").distinct()
    each = recorded.select("job_id", F.posexplode_outer("attempts_detail").alias("place", "a")).join(failures, "job_id")
    return each.select("job_id", (F.col("place") + 1).alias("attempt"), F.col("a.id").alias("id"), F.col("a.strategy").alias("strategy"), F.col("a.success").alias("success"), F.col("a.duration_s").try_cast("double").alias("duration_s"))


def batch_forecast(urls: DataFrame) -> DataFrame:
    """One row on (position, url): all, different, repeated, expected successes in hundredths; only first occurrences count.

    Repeats are counted first, so that each different URL is classified once and a frequent one is no group in one task.
    """
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n")).repartition(parts)  # Spark would gather so few bytes in one or two tasks
    rated = each.withColumn("p", F.round(classify.expected_success(classify.url_type(F.col("url"))) * 100).cast("long"))
    total, different = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return rated.agg(total.alias("total"), different.alias("unique"), (total - different).alias("duplicates"), F.sum("p").alias("expected_hundredths"))


def histogram(items: DataFrame, bounds: list[int], column: str) -> DataFrame:
    """Cumulative buckets: how many values are at most each bound."""
    row = items.agg(*[_count(F.col(column) <= b).alias(f"le_{b}") for b in bounds], F.count(column).alias("le_inf"))
    names = [f"le_{b}" for b in bounds] + ["le_inf"]
    stacked = ", ".join(f"'{n}', {n}" for n in names)
    return row.selectExpr(f"stack({len(names)}, {stacked}) AS (bucket, n)")


def consensus_recall(runs: DataFrame) -> DataFrame:
    """What share of the most that any model got from a URL each model got, over its URLs."""
    best = runs.groupBy("url", "model").agg(F.max("downloaded").alias("got"))
    ceiling = F.max("got").over(W.partitionBy("url"))
    held = best.withColumn("_ceiling", ceiling).filter("_ceiling > 0")
    return held.groupBy("model").agg(F.sum("got").alias("got"), F.sum("_ceiling").alias("ceiling"), (F.sum("got") / F.sum("_ceiling")).alias("recall"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Mean and median runtime, runtime a success, and rank by successes."""
    out = runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), _count(F.col("success")).alias("solved"), (F.sum("runtime_units") / F.count(F.lit(1))).alias("mean_runtime"), F.median("runtime_units").alias("median_runtime"),
        (F.sum("runtime_units") / F.when(_count(F.col("success")) > 0, _count(F.col("success")))).alias("runtime_per_success"),
    )
    return out.withColumn("place", F.rank().over(W.orderBy(F.desc("solved"))))


def model_matrix(runs: DataFrame, models: list[str]) -> DataFrame:
    """Successes by domain and model, 0 where there is none."""
    wide = runs.filter("success").groupBy("domain").pivot("model", models).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def best_model(runs: DataFrame) -> DataFrame:
    """For each URL the run with most documents, then the shortest, then the first model by name."""
    first = F.row_number().over(W.partitionBy("url").orderBy(F.desc("downloaded"), "runtime_units", "model", "id"))
    return runs.withColumn("_n", first).filter("_n = 1").select("url", F.col("model").alias("best_model"), "downloaded")


def evaluate(runs: DataFrame) -> DataFrame:
    """Recall against the expected number, capped at 1; with none expected it is 1 if there is any. Success asks for both half of them and one file."""
    recall = F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col("downloaded") / F.col("expected"))).otherwise(F.when(F.col("downloaded") > 0, 1.0).otherwise(0.0))
    return runs.select("id", recall.alias("recall"), (F.col("success") & (F.col("downloaded") > 0) & (recall >= 0.5)).alias("solved"))
