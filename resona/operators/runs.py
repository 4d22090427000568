"""Views over a table of runs: list, summaries and provider usage.

runs: run_id, study_id, status, created_at, models (array of struct stage, model), calls, cache_hits, tokens, retries, duration_s.
prices: model, price (per million tokens); a model without a price costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.files import number_rows


def with_cost(runs: DataFrame, prices: DataFrame, billed: str = "label") -> DataFrame:
    """Add models_text and cost: the run's tokens at the price of the model of its billed stage."""
    models = F.array_join(F.transform("models", lambda m: F.concat(m["stage"], F.lit(":"), m["model"])), ",")
    used = F.filter("models", lambda m: m["stage"] == billed)
    named = runs.withColumn("models_text", models).withColumn("model", F.get(used, F.lit(0))["model"])
    return named.join(prices, "model", "left").withColumn(
        "cost", F.coalesce(F.col("tokens") * F.col("price") / 1e6, F.lit(0.0))).drop("model", "price")


def run_list(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """All runs, newest first, with their place (a range sort, numbered by task)."""
    ordered = checkpointed(with_cost(runs, prices).orderBy(F.desc("created_at"), F.desc("run_id")))
    return number_rows(ordered, "place").withColumnRenamed("models_text", "models_used")


def summaries(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Per study and status: number, newest, cost, and which models were used (a bounded vocabulary)."""
    return with_cost(runs, prices).groupBy("study_id", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("newest"), F.max("run_id").alias("last_run"),
        F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_set("models_text")), ";").alias("models"))


def usage(runs: DataFrame) -> DataFrame:
    """Per run: provider calls, cache hits, tokens, retries, and calls per minute (null without a duration)."""
    minutes = F.when(F.col("duration_s") > 0, F.col("duration_s") / 60)
    return runs.select("run_id", "study_id", "calls", "cache_hits", "tokens", "retries", (F.col("calls") / minutes).alias("per_minute"))
