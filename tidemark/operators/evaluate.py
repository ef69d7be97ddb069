"""Exact ranking metrics, curves and breakdowns for scored rows, per group of models or folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order_stats import running_totals
from tidemark.sources import config


def _by_score(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the whole input of every rank metric."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.sum((1 - F.col(label)).cast("long")).alias("_neg")
    )


def _ranked(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Distinct scores, highest first, with the positives and negatives so far and in all."""
    return running_totals(_by_score(df, keys, label, score), keys, [score], ["_pos", "_neg"], descending=True)


def _auc() -> Column:
    """Positives times the negatives they beat, ties counted half; NULL where a class is missing."""
    beaten = F.col("_neg_all") - F.col("_neg_upto") + F.col("_neg") / 2
    pairs = F.max("_pos_all").cast("double") * F.max("_neg_all")
    return F.try_divide(F.sum(F.col("_pos") * beaten), pairs)


def _average_precision() -> Column:
    step = F.col("_pos") * (F.col("_pos_upto") / (F.col("_pos_upto") + F.col("_neg_upto")))
    return F.when(F.max("_neg_all") > 0, F.try_divide(F.sum(step), F.max("_pos_all")))


def _brier(score: str) -> Column:
    missed = F.col("_pos") * F.pow(F.col(score) - 1, 2) + F.col("_neg") * F.pow(F.col(score), 2)
    return F.sum(missed) / F.sum(F.col("_pos") + F.col("_neg"))


def roc_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL where only one class occurs."""
    return _ranked(df, keys, label, score).groupBy(*keys).agg(_auc().alias("roc_auc"))


def score_curve(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC and precision-recall points at every distinct score, with the base rate."""
    tp, fp = F.col("_pos_upto"), F.col("_neg_upto")
    positives, negatives = F.col("_pos_all"), F.col("_neg_all")
    return _ranked(df, keys, label, score).select(
        *keys,
        F.col(score).alias("threshold"),
        F.try_divide(tp, positives).alias("tpr"),
        F.try_divide(fp, negatives).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        (positives / (positives + negatives)).alias("base_rate"),
    )


def average_precision(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Sum of recall steps times precision over distinct scores, highest first; NULL for one class."""
    return _ranked(df, keys, label, score).groupBy(*keys).agg(_average_precision().alias("average_precision"))


def brier_score(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier_score"))


def topk_metrics(
    df: DataFrame, keys: list[str], tie: str, ks: list[int] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """Precision and recall among the k best rows of each group; k is cut at the group size.

    Only the largest k rows of each group and map task are shuffled. Equal scores go by ``tie``.
    """
    ks = sorted(ks or config.K_VALUES)
    ranked = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    top = df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= ks[-1])
    hits = top.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("_rank") <= k, F.col(label))), F.lit(0)).alias(f"_tp_{k}") for k in ks]
    )
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    joined = hits.join(totals, on=keys) if keys else hits.join(totals)
    cases = [F.struct(F.lit(k).alias("k"), F.col(f"_tp_{k}").cast("long").alias("true_positives")) for k in ks]
    rows = joined.select(*keys, "_n", "_p", F.inline(F.array(*cases)))
    return rows.select(
        *keys,
        "k",
        "true_positives",
        (F.col("true_positives") / F.least(F.col("k"), F.col("_n"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("true_positives"), F.col("_p")), F.lit(0.0)).alias("recall"),
    )


def threshold_metrics(
    df: DataFrame, keys: list[str], thresholds: list[float] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """Flagged rows, precision and recall at fixed thresholds: conditional sums, one pass."""
    thresholds = thresholds or config.THRESHOLDS
    parts = [F.sum(label).alias("_p")]
    for i, t in enumerate(thresholds):
        parts.append(F.count_if(F.col(score) >= t).alias(f"_flagged_{i}"))
        parts.append(F.sum(F.when(F.col(score) >= t, F.col(label)).otherwise(0)).alias(f"_tp_{i}"))
    cases = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_flagged_{i}").alias("flagged"),
            F.col(f"_tp_{i}").cast("long").alias("true_positives"),
        )
        for i, t in enumerate(thresholds)
    ]
    rows = df.groupBy(*keys).agg(*parts).select(*keys, "_p", F.inline(F.array(*cases)))
    zero = F.lit(0.0)
    return rows.select(
        *keys,
        "threshold",
        "flagged",
        F.coalesce(F.try_divide(F.col("true_positives"), F.col("flagged")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("true_positives"), F.col("_p")), zero).alias("recall"),
    )


def calibration_bins(
    df: DataFrame, keys: list[str], bins: int = 10, label: str = "label", score: str = "score"
) -> DataFrame:
    """Mean score and mean label per half-open bin; a score of 1.0 falls in no bin."""
    step = 1.0 / bins
    bin_no = sum(((F.col(score) >= F.lit(i * step)).cast("int") for i in range(1, bins)), F.lit(0))
    inside = df.where((F.col(score) >= 0) & (F.col(score) < 1))
    return (
        inside.withColumn("bin", bin_no)
        .groupBy(*keys, "bin")
        .agg(
            F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("n")
        )
    )


def score_histogram(
    df: DataFrame, keys: list[str], bins: int = 50, low: float = 0.0, high: float = 1.0, score: str = "score"
) -> DataFrame:
    """Counts per equal-width bin, numbered from 1; the upper bound belongs to the last bin."""
    bucket = F.least(F.width_bucket(F.col(score), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.withColumn("bin", bucket).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def group_breakdown(df: DataFrame, group: str, label: str = "label", score: str = "score") -> DataFrame:
    """Rows, positives, rate and mean score of each class per group."""
    positive = F.col(label) == 1
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("positives"),
        F.avg(label).alias("positive_rate"),
        F.coalesce(F.avg(F.when(positive, F.col(score))), F.lit(0.0)).alias("mean_score_positive"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_score_negative"),
    )


def share_by(df: DataFrame, group: str) -> DataFrame:
    """Counts per value and their share of all rows."""
    counted = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counted.withColumn("share", F.col("n") / F.sum("n").over(whole))


def score_summary(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean, exact median, maximum and counts above one half and one quarter."""
    from tidemark.operators.order_stats import exact_quantiles

    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.max(score).alias("max"),
        F.count_if(F.col(score) > 0.5).alias("above_half"),
        F.count_if(F.col(score) > 0.25).alias("above_quarter"),
    )
    medians = exact_quantiles(df, keys, [score], 0.5).withColumnRenamed(score, "median")
    return plain.join(medians, on=keys, how="left") if keys else plain.join(medians)


def metric_table(
    df: DataFrame, keys: list[str], tie: str, ks: list[int] | None = None, label: str = "label", score: str = "score"
) -> DataFrame:
    """All metrics as rows (keys, metric, value).

    AUC, average precision and Brier score come from one pass over the distinct scores.
    """
    whole = _ranked(df, keys, label, score).groupBy(*keys).agg(
        _auc().alias("roc_auc"), _average_precision().alias("average_precision"), _brier(score).alias("brier_score")
    )
    at_k = topk_metrics(df, keys, tie, ks, label, score)
    named = F.array(
        *[
            F.struct(F.concat(F.lit(f"{kind}_at_"), F.col("k").cast("string")).alias("metric"), F.col(kind).alias("value"))
            for kind in ("precision", "recall")
        ]
    )
    wide = whole.unpivot(keys, ["roc_auc", "average_precision", "brier_score"], "metric", "value")
    return wide.unionByName(at_k.select(*keys, F.inline(named)))


def fold_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds, missing values skipped."""
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def fold_pivot(metrics: DataFrame, models: list[str], metric: str) -> DataFrame:
    """One row per fold, one column per model."""
    chosen = metrics.where(F.col("metric") == metric)
    return chosen.groupBy("fold").pivot("model", models).agg(F.first("value"))


def blend(a: Column, b: Column, weights: tuple[float, float] = config.BLEND_WEIGHTS) -> Column:
    return a * weights[0] + b * weights[1]


def verdict(auc: Column) -> Column:
    """Quality word for a mean AUC."""
    result = F.lit(config.WEAK_VERDICT)
    for limit, word in reversed(config.VERDICTS):
        result = F.when(auc > limit, word).otherwise(result)
    return result
