"""Learners, calibration, search, attribution, scoring and the validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import E_SQL, FOLDS, SCORED_SQL, entity_periods, query, scored
from tidemark.models import attribution, learners, proxy, search
from tidemark.operators import explore
from tidemark.operators.label import walk_forward_folds
from tidemark.operators.select import align
from tidemark.plans import report, score, train
from tidemark.shared import keep

INPUTS = ["largest", "orders", "score", "value"]
META = ["row_id", "entity", "tier", "period", "target_tier"]
ROUNDS = 10
_SMALL = {"max_leaves": 0, "max_depth": 3, "rate": 0.1, "row_share": 0.8, "feature_share": 0.8}


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(walk_forward_folds(scored(spark, sf_dir), F.col("period"), FOLDS), "folds")


def second_fold(spark: SparkSession, sf_dir: str):
    return train.load_fold(fold_rows(spark, sf_dir), 2, INPUTS)


def boosted(splits: dict[str, DataFrame], shape: dict | None = None):
    return learners.train_boosted(splits["train"], splits["val"], shape or _SMALL, ROUNDS)


@query("baseline_lr", ints="row_id label", doubles="score")
def baseline_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, splits = second_fold(spark, sf_dir)
    test = splits["test"].drop("score")
    return learners.with_probability(learners.train_baseline(splits["train"]), test, "score")


@query("boosted_a", ints="row_id label", doubles="prob")
def boosted_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, splits = second_fold(spark, sf_dir)
    shape = learners.SHAPE_A
    return learners.with_probability(boosted(splits, shape), splits["test"], "prob")


@query("boosted_b", ints="row_id label", doubles="prob")
def boosted_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, splits = second_fold(spark, sf_dir)
    shape = learners.SHAPE_B
    return learners.with_probability(boosted(splits, shape), splits["test"], "prob")


@query(
    "align_features",
    f"SELECT entity, period, orders, 0 AS never_seen, value FROM ({E_SQL}) AS e",
    ints="entity period",
    doubles="orders never_seen value",
)
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved feature list in its order: a missing one is 0, the others are dropped."""
    rows = entity_periods(spark, sf_dir)
    saved = [c for c in learners.feature_columns(rows, ["entity", "period"]) if c in ("orders", "value")]
    return align(rows, [saved[0], "never_seen", saved[1]], ["entity", "period"])


def _calibrated(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = fold_rows(spark, sf_dir).where("fold = 2")
    calibrator = learners.Calibrator.fit(rows.where("split = 'val'"), "score", method)
    return calibrator.transform(rows.where("split = 'test'"), "score", "calibrated")


# Isotonic fit by its max-min form: the largest over starts of the smallest over ends of the mean label.
_ISOTONIC_SQL = f"""
    WITH points AS (
        SELECT score, sum(label) AS y, count(*) AS w, row_number() OVER (ORDER BY score) AS i
        FROM ({SCORED_SQL}) AS s WHERE period = 1997 GROUP BY score),
    running AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(w) OVER (ORDER BY i) AS cw FROM points),
    spans AS (
        SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS m
        FROM running AS a JOIN running AS b ON a.i <= b.i),
    lowest AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM spans),
    fitted AS (SELECT i, max(m) AS fit FROM lowest GROUP BY i),
    curve AS (SELECT score AS x, fit, lead(score) OVER (ORDER BY score) AS next_x, lead(fit) OVER (ORDER BY score) AS next_fit,
                     row_number() OVER (ORDER BY score) AS i
              FROM points JOIN fitted USING (i))
    SELECT row_id, label, score,
           CASE WHEN score <= (SELECT min(x) FROM curve) THEN (SELECT fit FROM curve ORDER BY x LIMIT 1)
                WHEN next_x IS NULL THEN fit
                ELSE fit + (next_fit - fit) * (score - x) / (next_x - x) END AS calibrated
    FROM (SELECT * FROM ({SCORED_SQL}) AS s WHERE period = 1998) AS t
    ASOF LEFT JOIN curve ON t.score >= curve.x
"""


@query("calibrate_isotonic", _ISOTONIC_SQL, ints="row_id label", doubles="score calibrated")
def calibrate_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "isotonic")


@query("calibrate_platt", ints="row_id label", doubles="score calibrated")
def calibrate_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "platt")


@query("random_search", texts="parameters", doubles="auc")
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, splits = second_fold(spark, sf_dir)
    _, trials = search.random_search(splits["train"], splits["val"], search.SPACE_A, 3, 5)
    rows = [(str(sorted(point.items())), auc) for point, auc in trials]
    return spark.createDataFrame(rows, "parameters string, auc double")


@query("attribution", texts="feature", ints="row_id", doubles="base_value value contribution")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, splits = second_fold(spark, sf_dir)
    return attribution.explain(boosted(splits), splits["test"], ["row_id"], inputs.features)


@query(
    "attribution_total",
    f"SELECT row_id, 1 AS adds_up FROM ({SCORED_SQL}) AS s WHERE period = {FOLDS[1][3]}",
    ints="row_id adds_up",
)
def attribution_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether base value and contributions of a test row add up to its margin."""
    inputs, splits = second_fold(spark, sf_dir)
    model = boosted(splits)
    parts = attribution.explain(model, splits["test"], ["row_id"], inputs.features)
    totals = parts.groupBy("row_id").agg((F.first("base_value") + F.sum("contribution")).alias("total"))
    joined = model.transform(splits["test"].select("row_id", "features")).join(totals, "row_id", "left")
    return joined.select("row_id", F.coalesce(F.abs(F.col("total") - F.col("margin")) < 1e-9, F.lit(False)).cast("int").alias("adds_up"))


@query("combined_importance", texts="feature", doubles="importance")
def combined_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, splits = second_fold(spark, sf_dir)
    first, second = boosted(splits), boosted(splits, {**_SMALL, "max_depth": 4})
    tables = attribution.generate_explanations(first, second, splits["test"], ["row_id"], inputs.features)
    return tables["importance"]


_PARTS = " UNION ALL ".join(
    f"SELECT entity * 10000 + period AS row_id, '{c}' AS feature, coalesce({c}, 0) / {scale}.0 - 1 AS contribution FROM ({E_SQL}) AS e"
    for c, scale in (("value", 262147), ("quantity", 151), ("orders", 3))
)


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic additive table in the form of an attribution."""
    scales = {"value": 262147.0, "quantity": 151.0, "orders": 3.0}
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / s - 1).alias("contribution"))
            for c, s in scales.items()
        ]
    )
    rows = entity_periods(spark, sf_dir).withColumn("row_id", F.col("entity") * 10000 + F.col("period"))
    return rows.select("row_id", F.inline(parts)).withColumn("value", F.col("contribution") + 1)


@query(
    "importance",
    f"SELECT feature, avg(abs(contribution)) AS importance FROM ({_PARTS}) AS p GROUP BY feature",
    texts="feature",
    doubles="importance",
)
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.importance(_contributions(spark, sf_dir))


@query(
    "top_contributions",
    f"""SELECT row_id, feature, rank, contribution FROM (
            SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank
            FROM ({_PARTS}) AS p) AS r WHERE rank <= 2""",
    texts="feature",
    ints="row_id rank",
    doubles="contribution",
)
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.top_contributions(_contributions(spark, sf_dir), ["row_id"], 2)


@query(
    "top_features",
    f"""SELECT feature, avg(abs(contribution)) AS importance FROM ({_PARTS}) AS p GROUP BY feature
        ORDER BY importance DESC, feature LIMIT 2""",
    texts="feature",
    doubles="importance",
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = attribution.importance(_contributions(spark, sf_dir))
    return explore.top_rows(table, 2, [F.col("importance").desc(), F.col("feature").asc()])


@query(
    "averaged_importance",
    f"""SELECT feature, (avg(abs(contribution)) + avg(abs(contribution / 2 + 1))) / 2 AS importance
        FROM ({_PARTS}) AS p GROUP BY feature""",
    texts="feature",
    doubles="importance",
)
def averaged_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _contributions(spark, sf_dir)
    second = first.withColumn("contribution", F.col("contribution") / 2 + 1)
    return attribution.combined_importance(attribution.importance(first), attribution.importance(second))


@query(
    "mean_contributions",
    f"SELECT row_id, feature, (contribution + (contribution / 2 + 1)) / 2 AS contribution FROM ({_PARTS}) AS p",
    texts="feature",
    ints="row_id",
    doubles="contribution",
)
def mean_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _contributions(spark, sf_dir)
    second = first.withColumn("contribution", F.col("contribution") / 2 + 1)
    return attribution.mean_contributions(first, second, ["row_id"])


@query("proxy_regression", ints="entity period", doubles="proxy residual")
def proxy_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned goods per order, known for some rows, predicted for all complete ones."""
    rows = entity_periods(spark, sf_dir).withColumn("rate", F.col("returned") / F.col("orders") / 100)
    flags = {"in_building": "BUILDING", "in_machinery": "MACHINERY"}
    prepared, names = proxy.proxy_features(rows, ["orders", "quantity", "finished"], "segment", flags)
    kept = keep(prepared, "proxy")
    sides = proxy.proxy_training_rows(kept, names, "rate", "period", ["entity", "period"], "1999")
    model, _ = proxy.train_proxy(*sides, "rate", ROUNDS)
    return proxy.apply_proxy(kept, model, names, "rate", "proxy", "residual")


@query("batch_score", ints="row_id", doubles="prob_a prob_b prob_ensemble prob_calibrated")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last test year scored with models of the fold before; one input is missing there."""
    folds = fold_rows(spark, sf_dir)
    inputs, splits = train.load_fold(folds, 2, INPUTS)
    first, second = boosted(splits), boosted(splits, {**_SMALL, "max_depth": 4})
    _, _, calibrator = train.evaluate_fold(first, second, splits, META, "row_id")
    fresh = folds.where("fold = 3 AND split = 'test'").drop("largest")
    return score.score(fresh, inputs, first, second, calibrator, ["row_id"])[0]


@query("fold_metrics", texts="model metric", doubles="value")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, splits = second_fold(spark, sf_dir)
    first, second = boosted(splits), boosted(splits, {**_SMALL, "max_depth": 4})
    return train.evaluate_fold(first, second, splits, META, "row_id", "isotonic")[1]


_TESTED = " UNION ALL ".join(f"SELECT *, {n} AS fold FROM s WHERE period = {test}" for n, _, _, test in FOLDS)
_REPORT_SQL = f"""
    WITH s AS ({SCORED_SQL}), p AS ({_TESTED}), totals AS (SELECT count(*) AS n, sum(label) AS pos FROM p),
    e AS ({E_SQL}),
    best AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM p),
    hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS high,
                    row_number() OVER (ORDER BY score, row_id) AS low FROM p WHERE label = 1),
    misses AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM p WHERE label = 0)
    SELECT 'top' AS section, CAST(row_id AS VARCHAR) AS name, score AS amount FROM best WHERE rn <= 20
    UNION ALL SELECT 'true_positives', CAST(row_id AS VARCHAR), score FROM hits WHERE high <= 20
    UNION ALL SELECT 'missed', CASE WHEN e.balance >= 5000 THEN 'high balance' ELSE 'model uncertainty' END, score
        FROM hits JOIN e USING (entity, period) WHERE low <= 20
    UNION ALL SELECT 'thresholds', CAST(t / 10.0::DOUBLE AS VARCHAR),
        coalesce(sum(label) FILTER (WHERE score >= t / 10.0::DOUBLE) / nullif(count(*) FILTER (WHERE score >= t / 10.0::DOUBLE), 0), 0)
        FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS t) AS ts GROUP BY t
    UNION ALL SELECT 'top_k', CAST(k AS VARCHAR), sum(CASE WHEN rn <= k THEN label ELSE 0 END) / max(pos)
        FROM best CROSS JOIN totals CROSS JOIN (SELECT unnest([10, 20, 50, 100, 200, 500]) AS k) AS ks GROUP BY k
    UNION ALL SELECT 'false_positives', CAST(row_id AS VARCHAR),
        CAST(entity IN (SELECT entity FROM p WHERE tier = '3-MEDIUM') AS INT) FROM misses WHERE rn <= 50
    UNION ALL SELECT 'per_fold', CAST(fold AS VARCHAR), sum(label) FROM p GROUP BY fold
    UNION ALL SELECT 'per_league', tier, avg(label) FROM p GROUP BY tier
    UNION ALL SELECT 'destinations', target_tier, count(*) / max(pos) FROM p CROSS JOIN totals WHERE label = 1 GROUP BY target_tier
    UNION ALL SELECT 'top_features', feature, avg(abs(contribution)) FROM ({_PARTS}) AS parts GROUP BY feature
"""


@query("validation_report", _REPORT_SQL, texts="section name", doubles="amount")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report tables on the deterministic score, one line per figure."""
    rows = walk_forward_folds(scored(spark, sf_dir), F.col("period"), FOLDS).where("split = 'test'")
    predictions = keep(rows.withColumnRenamed("score", "prob_calibrated"), "predictions")
    known = keep(entity_periods(spark, sf_dir), "entities")
    summary = spark.createDataFrame([], "model string, metric string, mean double")
    tables = report.validation_report(
        predictions,
        known,
        predictions,
        attribution.importance(_contributions(spark, sf_dir)),
        summary,
        "row_id",
        "entity",
        "period",
        "tier",
        "target_tier",
        F.col("tier") == "3-MEDIUM",
        explore.reasons([(F.col("balance") >= 5000, "high balance")]),
    )
    figures = {
        "top": ("row_id", "prob_calibrated"), "true_positives": ("row_id", "prob_calibrated"),
        "missed": ("reason", "prob_calibrated"), "thresholds": ("threshold", "precision"), "top_k": ("k", "recall"),
        "false_positives": ("row_id", "near_miss"), "per_fold": ("fold", "positives"), "per_league": ("tier", "positive_rate"),
        "destinations": ("target_tier", "share"), "top_features": ("feature", "importance"),
    }
    lines = [
        tables[section].select(
            F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(amount).cast("double").alias("amount")
        )
        for section, (name, amount) in figures.items()
    ]
    result = lines[0]
    for line in lines[1:]:
        result = result.unionByName(line)
    return result
