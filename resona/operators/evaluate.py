"""Label evaluation. Rows are reduced to counts per (true, predicted) first; scores use the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _scores(counted: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where a base is empty."""
    def part(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    p, r = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    return (counted.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def _label_table(df: DataFrame, labels: list[str]) -> DataFrame:
    rows = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("label", F.explode(rows))


def label_scores(pairs: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """Per label of the given list; a missing prediction counts as a miss."""
    counts = _label_table(pair_counts(pairs, by), labels)
    t = F.col("y_true").eqNullSafe(F.col("label"))
    p = F.col("y_pred").eqNullSafe(F.col("label"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return _scores(counts.groupBy(*by, "label").agg(
        total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn")))


def macro_f1(pairs: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    scores = label_scores(pairs, labels, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    totals = pair_counts(pairs, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("y_pred").isNull(), F.col("n")).otherwise(0)).alias("abstain"))
    return scores.join(totals, by).withColumn("abstain_rate", F.col("abstain") / F.col("n"))


def multilabel_scores(pairs: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """Per label, each label a yes/no question; y_true and y_pred are arrays."""
    seen = pairs.select(*by, "y_true", "y_pred", F.explode(F.array_union("y_true", "y_pred")).alias("label"))
    t, p = F.array_contains("y_true", F.col("label")), F.array_contains("y_pred", F.col("label"))
    counts = seen.groupBy(*by, "label").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    grid = _label_table(pairs.select(*by).distinct(), labels)
    return _scores(grid.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn"]))


def confusion(pairs: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """Cells of the labels x labels matrix, zero where no pair fell; other pairs are left out."""
    counts = pair_counts(pairs, by).where(F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels))
    grid = (_label_table(pairs.select(*by).distinct(), labels).withColumnRenamed("label", "y_true")
            .withColumn("y_pred", F.explode(F.array(*[F.lit(x) for x in labels]))))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def cohen_kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of two annotators (y_true, y_pred) corrected for chance."""
    counts = pair_counts(pairs, by)
    marginals = (
        counts.select(*by, F.inline(F.array(
            F.struct(F.lit("a").alias("side"), F.col("y_true").alias("label"), "n"),
            F.struct(F.lit("b").alias("side"), F.col("y_pred").alias("label"), "n"))))
        .groupBy(*by, "label").agg(
            F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("ca"),
            F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("cb")))
    observed = counts.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(0)).alias("same"))
    expected = marginals.join(observed, by).groupBy(*by).agg(
        F.sum((F.col("ca") / F.col("total")) * (F.col("cb") / F.col("total"))).alias("pe"))
    po = F.col("same") / F.col("total")
    kappa = (F.when(F.col("pe") == 1.0, F.when(po == 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise((po - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))))
    return observed.join(expected, by).withColumn("kappa", kappa)


def confidence_bin(c: Column, bins: int = 10) -> Column:
    """Bin whose literal bounds i/bins hold c; the last bin includes 1, other values have none."""
    inner = sum((F.when(c >= F.lit(i / bins), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return F.when((c >= 0) & ((c < 1) | (c == 1)), inner)


def calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over (confidence, correct)."""
    per_bin = rows.groupBy(*by, confidence_bin(F.col("confidence"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"),
        F.avg("confidence").alias("conf"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def resolve_gold(gold: DataFrame) -> DataFrame:
    """One gold row per post: the last human label, otherwise the first seed label."""
    human = F.col("annotator_type") == "human"
    w = W.partitionBy("study_id", "post_id").orderBy(
        human.desc(), F.when(human, -F.col("gold_seq")).otherwise(F.col("gold_seq")))
    return gold.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def double_annotated(gold: DataFrame, field: str) -> DataFrame:
    """Pairs of the first two annotators by name on their common posts, last label of each."""
    names = gold.select("study_id", "annotator").distinct()
    order = W.partitionBy("study_id").orderBy("annotator")
    first_two = names.withColumn("who", F.row_number().over(order)).where("who <= 2")
    picked = gold.join(first_two, ["study_id", "annotator"])
    per_post = picked.groupBy("study_id", "post_id").agg(*[
        F.max_by(F.struct(F.col(field).alias("v")), F.when(F.col("who") == k, F.col("gold_seq"))).alias(side)
        for k, side in ((1, "a"), (2, "b"))],
        *[F.max(F.col("who") == k).alias(f"has_{k}") for k in (1, 2)])
    return per_post.where("has_1 and has_2").select(
        "study_id", "post_id", F.col("a.v").alias("y_true"), F.col("b.v").alias("y_pred"))


def matched(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions and gold of their common posts, with whether relevance agrees."""
    fields = ["relevant", "topics", "stance", "emotion", "irony"]
    g = gold.select("study_id", "post_id", *[F.col(f).alias(f"gold_{f}") for f in fields])
    both = predictions.select("study_id", "post_id", *fields, "confidence").join(g, ["study_id", "post_id"])
    return both.withColumn("correct", F.col("relevant").eqNullSafe(F.col("gold_relevant")))


def pairs_of(matched_rows: DataFrame, field: str, only_gold: bool = True) -> DataFrame:
    rows = matched_rows.where(F.col(f"gold_{field}").isNotNull()) if only_gold else matched_rows
    return rows.select("study_id", F.col(f"gold_{field}").alias("y_true"), F.col(field).alias("y_pred"))


def run_summary(matched_rows: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """One row per study: agreement, calibration error and macro F1 per label field."""
    base = matched_rows.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("replay_agreement"))
    out = base.join(calibration_error(matched_rows, ["study_id"]), "study_id", "left")
    for field, labels in vocabularies.items():
        scored = macro_f1(pairs_of(matched_rows, field), labels, ["study_id"]).select(
            "study_id", F.col("macro_f1").alias(f"{field}_f1"))
        out = out.join(scored, "study_id", "left")
    return out


def record(summary: DataFrame, baseline: DataFrame, gold: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """The evaluation record of a study: gold rows, test size, the baseline's and the run's scores, calibration, throughput.

    seconds: study_id, posts, duration_s of the run; without it throughput is null.
    """
    counts = gold.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_gold"))
    out = summary.join(counts, "study_id").join(baseline.withColumnRenamed("test", "n_evaluated"), "study_id", "left")
    if seconds is None:
        return out.withColumn("per_minute", F.lit(None).cast("double"))
    minute = F.greatest(F.col("duration_s"), F.lit(0.001)) / 60
    return out.join(seconds, "study_id", "left").withColumn("per_minute", F.round(F.col("posts") / minute, 1)).drop("posts", "duration_s")


def against_targets(summary: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Long view (study, measure, value, target, met); what was not measured stays null."""
    have = {c[:-3]: c for c in summary.columns if c.endswith("_f1")}
    rows = F.array(*[F.struct(
        F.lit(m).alias("measure"),
        (F.col(have[m]) if m in have else F.lit(None)).cast("double").alias("value"),
        F.lit(t).alias("target")) for m, t in targets.items()])
    return summary.select("study_id", F.inline(rows)).withColumn("met", F.col("value") >= F.col("target"))
