"""Labels, folds, leakage and the ranking metrics on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import (
    E_SQL,
    FOLDS,
    LABELLED_SQL,
    SCORED_SQL,
    SOURCES,
    TIERED_SQL,
    entity_periods,
    labelled,
    query,
    read,
    scored,
    tiered_periods,
)
from tidemark.operators import evaluate, explore, label

_FOLD_ROWS = " UNION ALL ".join(
    f"SELECT *, {n} AS fold, CASE WHEN period <= {train} THEN 'train' WHEN period = {val} THEN 'val' ELSE 'test' END"
    f" AS split FROM labelled WHERE period <= {train} OR period IN ({val}, {test})"
    for n, train, val, test in FOLDS
)
_FOLDS_SQL = f"WITH labelled AS ({LABELLED_SQL}) {_FOLD_ROWS}"
_SCORED_FOLDS_SQL = f"WITH labelled AS ({SCORED_SQL}) SELECT * FROM ({_FOLD_ROWS}) AS f"


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.walk_forward_folds(labelled(spark, sf_dir), F.col("period"), FOLDS)


def scored_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.walk_forward_folds(scored(spark, sf_dir), F.col("period"), FOLDS)


@query(
    "forward_label",
    LABELLED_SQL,
    texts="tier target_tier",
    ints="entity period orders label target_year",
    doubles="value",
)
def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir)


@query(
    "attach_labels",
    f"""SELECT t.entity, t.tier, t.period, t.largest, l.label, l.target_tier
        FROM ({TIERED_SQL}) AS t JOIN ({LABELLED_SQL}) AS l USING (entity, tier, period)""",
    texts="tier target_tier",
    ints="entity period label",
    doubles="largest",
)
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiered_periods(spark, sf_dir)
    return label.attach_labels(rows, labelled(spark, sf_dir), ["entity", "tier", "period"], ["label", "target_tier"])


@query(
    "label_stats",
    f"""SELECT tier, period, count(*) AS n, sum(label) AS positives, avg(label) AS positive_rate
        FROM ({LABELLED_SQL}) AS l GROUP BY GROUPING SETS ((), (tier), (period))""",
    texts="tier",
    ints="period n positives",
    doubles="positive_rate",
)
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_distribution(labelled(spark, sf_dir), "tier", "period")


@query(
    "labeling_report",
    f"""SELECT (SELECT count(*) FROM ({TIERED_SQL}) AS t) AS total_observations, count(*) AS observations,
               sum(label) AS positives, count(*) - sum(label) AS negatives, avg(label) AS positive_rate,
               (SELECT count(*) FROM ({TIERED_SQL}) AS t WHERE tier NOT IN ('1-URGENT', '2-HIGH')) - count(*)
                   AS excluded_lookforward
        FROM ({LABELLED_SQL}) AS l""",
    ints="total_observations observations positives negatives excluded_lookforward",
    doubles="positive_rate",
)
def labeling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.labeling_report(tiered_periods(spark, sf_dir), labelled(spark, sf_dir), "tier", SOURCES)


@query(
    "single_class_periods",
    f"""SELECT period, min(label) AS only_class, count(*) AS n FROM ({LABELLED_SQL}) AS l
        GROUP BY period HAVING min(label) = max(label)""",
    ints="period only_class n",
)
def single_class_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.single_class_periods(labelled(spark, sf_dir), "period")


@query("walk_forward_folds", _FOLDS_SQL, texts="tier split", ints="entity period label fold")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(spark, sf_dir)


_BOUNDS = ", ".join(
    f"{fn}(CASE WHEN split = '{split}' THEN period END) AS {split}_{fn}"
    for split in ("train", "val", "test")
    for fn in ("min", "max")
)


@query(
    "leakage_report",
    f"""WITH f AS ({_FOLDS_SQL}),
        bounds AS (SELECT fold, {_BOUNDS} FROM f GROUP BY fold),
        shared AS (SELECT fold, count(*) AS shared_keys FROM (
            SELECT fold, entity, period FROM f WHERE split = 'train'
            INTERSECT SELECT fold, entity, period FROM f WHERE split = 'val') AS both_sides GROUP BY fold)
        SELECT bounds.*, coalesce(shared_keys, 0) AS shared_keys,
               concat_ws('; ', CASE WHEN train_max >= val_min THEN 'train overlaps val' END,
                         CASE WHEN train_max >= test_min THEN 'train overlaps test' END,
                         CASE WHEN val_max >= test_min THEN 'val overlaps test' END,
                         CASE WHEN shared_keys > 0 THEN 'keys in both train and val' END) AS warnings
        FROM bounds LEFT JOIN shared USING (fold)""",
    texts="warnings",
    ints="fold train_min train_max val_min val_max test_min test_max shared_keys",
)
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.leakage_report(folds(spark, sf_dir), "entity", "period", F.col("period"))


@query(
    "topk_metrics",
    f"""WITH s AS ({_SCORED_FOLDS_SQL}),
        r AS (SELECT *, row_number() OVER (PARTITION BY fold, split ORDER BY score DESC, row_id) AS rn FROM s),
        t AS (SELECT fold, split, count(*) AS n, sum(label) AS p FROM s GROUP BY fold, split),
        h AS (SELECT fold, split, k, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS true_positives
              FROM r CROSS JOIN (VALUES (10), (20), (50), (100)) AS ks(k) GROUP BY fold, split, k)
        SELECT fold, split, k, true_positives, true_positives / least(k, n) AS precision,
               CASE WHEN p = 0 THEN 0 ELSE true_positives / p END AS recall FROM h JOIN t USING (fold, split)""",
    texts="split",
    ints="fold k true_positives",
    doubles="precision recall",
)
def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.topk_metrics(scored_folds(spark, sf_dir), ["fold", "split"], "row_id")


@query(
    "threshold_metrics",
    f"""WITH s AS ({_SCORED_FOLDS_SQL}),
        c AS (SELECT fold, split, t / 10.0::DOUBLE AS threshold, sum(label) AS p,
                     count(*) FILTER (WHERE score >= t / 10.0::DOUBLE) AS flagged,
                     coalesce(sum(label) FILTER (WHERE score >= t / 10.0::DOUBLE), 0) AS tp
              FROM s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS t) AS ts GROUP BY fold, split, t)
        SELECT fold, split, threshold, flagged, CASE WHEN flagged = 0 THEN 0 ELSE tp / flagged END AS precision,
               CASE WHEN p = 0 THEN 0 ELSE tp / p END AS recall FROM c""",
    texts="split",
    ints="fold flagged",
    doubles="threshold precision recall",
)
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_metrics(scored_folds(spark, sf_dir), ["fold", "split"])


@query(
    "roc_auc",
    f"""SELECT tier, sum(CASE WHEN label = 1 THEN avg_rank END) AS rank_sum,
               (sum(CASE WHEN label = 1 THEN avg_rank END) - sum(label) * (sum(label) + 1) / 2)
                   / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0) AS roc_auc
        FROM (SELECT tier, label, rank() OVER (PARTITION BY tier ORDER BY score)
                     + (count(*) OVER (PARTITION BY tier, score) - 1) / 2 AS avg_rank
              FROM ({SCORED_SQL}) AS s) AS r GROUP BY tier""",
    texts="tier",
    doubles="roc_auc",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(scored(spark, sf_dir), ["tier"])


_CURVE_SQL = f"""
    SELECT tier, score, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, p, n, tp AS gain FROM (
        SELECT tier, score, sum(label) AS tp, sum(1 - label) AS fp,
               sum(sum(label)) OVER (PARTITION BY tier) AS p, sum(sum(1 - label)) OVER (PARTITION BY tier) AS n
        FROM ({SCORED_SQL}) AS s GROUP BY tier, score) AS c
    WINDOW w AS (PARTITION BY tier ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
"""


@query(
    "average_precision",
    f"SELECT tier, sum(gain / p * (tp / (tp + fp))) AS average_precision FROM ({_CURVE_SQL}) AS c GROUP BY tier",
    texts="tier",
    doubles="average_precision",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(scored(spark, sf_dir), ["tier"])


@query(
    "roc_points",
    f"""SELECT tier, score AS threshold, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS precision, p / (p + n)
               AS base_rate FROM ({_CURVE_SQL}) AS c""",
    texts="tier",
    doubles="threshold tpr fpr precision base_rate",
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_curve(scored(spark, sf_dir), ["tier"])


@query(
    "brier",
    f"SELECT tier, avg((score - label) * (score - label)) AS brier_score FROM ({SCORED_SQL}) AS s GROUP BY tier",
    texts="tier",
    doubles="brier_score",
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.brier_score(scored(spark, sf_dir), ["tier"])


@query(
    "calibration_bins",
    f"""SELECT tier, bin, avg(score) AS mean_score, avg(label) AS mean_label, count(*) AS n
        FROM (SELECT *, (SELECT count(*) FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i) AS b
                         WHERE score >= i * 0.1::DOUBLE) AS bin FROM ({SCORED_SQL}) AS s) AS binned
        WHERE score < 1 GROUP BY tier, bin""",
    texts="tier",
    ints="bin n",
    doubles="mean_score mean_label",
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.calibration_bins(scored(spark, sf_dir), ["tier"])


@query(
    "score_histogram",
    f"""SELECT label, least(CAST(floor(score * 50 / 1.0) AS BIGINT) + 1, 50) AS bin, count(*) AS n
        FROM ({SCORED_SQL}) AS s GROUP BY ALL""",
    ints="label bin n",
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_histogram(scored(spark, sf_dir), ["label"])


@query(
    "group_breakdown",
    f"""SELECT tier, count(*) AS n, sum(label) AS positives, avg(label) AS positive_rate,
               coalesce(avg(score) FILTER (WHERE label = 1), 0) AS mean_score_positive,
               avg(score) FILTER (WHERE label = 0) AS mean_score_negative FROM ({SCORED_SQL}) AS s GROUP BY tier""",
    texts="tier",
    ints="n positives",
    doubles="positive_rate mean_score_positive mean_score_negative",
)
def group_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_breakdown(scored(spark, sf_dir), "tier")


@query(
    "destination_share",
    f"""SELECT target_tier, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
        FROM ({LABELLED_SQL}) AS l WHERE label = 1 GROUP BY target_tier""",
    texts="target_tier",
    ints="n",
    doubles="share",
)
def destination_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.share_by(labelled(spark, sf_dir).where("label = 1"), "target_tier")


_METRIC_SQL = f"""
    SELECT fold, 'value' AS model, 'brier_score' AS metric, avg((score - label) * (score - label)) AS value
    FROM ({_SCORED_FOLDS_SQL}) AS s WHERE split = 'test' GROUP BY fold
    UNION ALL
    SELECT fold, 'half', 'brier_score', avg((score / 2 - label) * (score / 2 - label))
    FROM ({_SCORED_FOLDS_SQL}) AS s WHERE split = 'test' GROUP BY fold
"""


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_folds(spark, sf_dir).where("split = 'test'")
    models = F.array(
        F.struct(F.lit("value").alias("model"), F.col("score").alias("score")),
        F.struct(F.lit("half").alias("model"), (F.col("score") / 2).alias("score")),
    )
    long = rows.select("fold", "label", F.inline(models))
    return evaluate.brier_score(long, ["fold", "model"]).select(
        "fold", "model", F.lit("brier_score").alias("metric"), F.col("brier_score").alias("value")
    )


@query(
    "fold_summary",
    f"SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS std FROM ({_METRIC_SQL}) AS m GROUP BY model, metric",
    texts="model metric",
    doubles="mean std",
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_summary(_fold_metrics(spark, sf_dir), ["model"])


@query(
    "fold_pivot",
    f"""SELECT fold, max(CASE WHEN model = 'value' THEN value END) AS value,
               max(CASE WHEN model = 'half' THEN value END) AS half FROM ({_METRIC_SQL}) AS m GROUP BY fold""",
    ints="fold",
    doubles="value half",
)
def fold_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fold_pivot(_fold_metrics(spark, sf_dir), ["value", "half"], "brier_score")


@query(
    "metric_table",
    f"""SELECT tier, 'brier_score' AS metric, avg((score - label) * (score - label)) AS value
        FROM ({SCORED_SQL}) AS s GROUP BY tier
        UNION ALL
        SELECT tier, 'average_precision', sum(gain / p * (tp / (tp + fp))) FROM ({_CURVE_SQL}) AS c GROUP BY tier
        UNION ALL
        SELECT tier, 'roc_auc', sum(gain * (n - fp + (fp - fp_before) / 2)) / (max(p) * max(n)) FROM (
            SELECT *, coalesce(lag(fp) OVER (PARTITION BY tier ORDER BY score DESC), 0) AS fp_before
            FROM ({_CURVE_SQL}) AS c) AS d GROUP BY tier
        UNION ALL
        SELECT tier, 'precision_at_10', sum(label) / 10 FROM (
            SELECT tier, label, row_number() OVER (PARTITION BY tier ORDER BY score DESC, row_id) AS rn
            FROM ({SCORED_SQL}) AS s) AS r WHERE rn <= 10 GROUP BY tier
        UNION ALL
        SELECT tier, 'recall_at_10', sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / sum(label) FROM (
            SELECT tier, label, row_number() OVER (PARTITION BY tier ORDER BY score DESC, row_id) AS rn
            FROM ({SCORED_SQL}) AS s) AS r GROUP BY tier""",
    texts="tier metric",
    doubles="value",
)
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metric_table(scored(spark, sf_dir), ["tier"], "row_id", [10])


@query(
    "blend",
    f"SELECT row_id, 0.5 * score + 0.5 * (orders / (orders + 4)) AS blended FROM ({SCORED_SQL}) AS s",
    ints="row_id",
    doubles="blended",
)
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("orders") / (F.col("orders") + 4)
    return scored(spark, sf_dir).withColumn("blended", evaluate.blend(F.col("score"), other))


@query(
    "score_summary",
    f"""SELECT tier, count(*) AS n, avg(score) AS mean, median(score) AS median, max(score) AS max,
               count(*) FILTER (WHERE score > 0.5) AS above_half, count(*) FILTER (WHERE score > 0.25) AS above_quarter
        FROM ({SCORED_SQL}) AS s GROUP BY tier""",
    texts="tier",
    ints="n above_half above_quarter",
    doubles="mean median max",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_summary(scored(spark, sf_dir), ["tier"])


@query(
    "class_weight",
    f"""SELECT fold, split, count(*) FILTER (WHERE label = 0) / nullif(sum(label), 0) AS weight
        FROM ({_FOLDS_SQL}) AS f GROUP BY fold, split""",
    texts="split",
    ints="fold",
    doubles="weight",
)
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.models.learners import class_weights

    return class_weights(folds(spark, sf_dir), ["fold", "split"])


@query(
    "outcome_map",
    f"""SELECT entity, tier, period, CASE WHEN label = 1 THEN 'Breakout' WHEN label = 0 THEN '-' ELSE 'TBD' END AS outcome,
               coalesce(CASE tier WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END, tier) AS shown
        FROM ({TIERED_SQL}) AS t LEFT JOIN (SELECT entity, tier, period, label FROM ({LABELLED_SQL}) AS l) AS l
        USING (entity, tier, period)""",
    texts="tier outcome shown",
    ints="entity period",
)
def outcome_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions import scalar

    keys = ["entity", "tier", "period"]
    marked = tiered_periods(spark, sf_dir).join(labelled(spark, sf_dir).select(*keys, "label"), on=keys, how="left")
    names = {"3-MEDIUM": "Medium", "5-LOW": "Low"}
    return marked.withColumns(
        {
            "outcome": scalar.outcome_text(F.col("label")),
            "shown": scalar.mapping(names, F.col("tier"), F.coalesce("tier", F.lit("N/A"))),
        }
    )


@query(
    "near_miss_flag",
    f"""SELECT row_id, score, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = entity
               AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS INT) AS near_miss
        FROM (SELECT * FROM ({SCORED_SQL}) AS s WHERE label = 0 ORDER BY score DESC, row_id LIMIT 50) AS top""",
    ints="row_id near_miss",
    doubles="score",
)
def near_miss_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = scored(spark, sf_dir).where("label = 0")
    top = explore.top_rows(misses, 50, [F.col("score").desc(), F.col("row_id").asc()])
    history = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), "o_orderpriority")
    return explore.seen_in_target(
        top, history, "entity", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "near_miss"
    )


@query(
    "reason_lookup",
    f"""SELECT row_id, CASE WHEN reasons = '' THEN 'model uncertainty' ELSE reasons END AS reason FROM (
            SELECT row_id, concat_ws('; ', CASE WHEN f.balance >= 5000 THEN 'high balance' END,
                       CASE WHEN f.quantity < 100 THEN 'low quantity (' || CAST(f.quantity AS BIGINT) || ')' END,
                       CASE WHEN f.segment = 'MACHINERY' AND f.orders < 2 THEN 'few orders' END) AS reasons
            FROM (SELECT * FROM ({SCORED_SQL}) AS s WHERE label = 1 ORDER BY score, row_id LIMIT 200) AS low
            LEFT JOIN (SELECT entity, period, balance, quantity, segment, orders
                       FROM ({E_SQL}) AS e) AS f USING (entity, period)) AS r""",
    texts="reason",
    ints="row_id",
)
def reason_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scored(spark, sf_dir).where("label = 1").select("row_id", "entity", "period", "score")
    low = explore.top_rows(hits, 200, [F.col("score").asc(), F.col("row_id").asc()])
    found = explore.look_up(low, entity_periods(spark, sf_dir), ["entity", "period"], [F.col("name").asc()])
    low_quantity = F.concat(F.lit("low quantity ("), F.col("quantity").cast("long").cast("string"), F.lit(")"))
    checks = [
        (F.col("balance") >= 5000, "high balance"),
        (F.col("quantity") < 100, low_quantity),
        ((F.col("segment") == "MACHINERY") & (F.col("orders") < 2), "few orders"),
    ]
    return found.withColumn("reason", explore.reasons(checks))
