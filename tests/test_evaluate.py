import numpy as np
import pytest

from tidemark.operators import evaluate

RANKED = [(i, l, 0.9 - 0.1 * i) for i, l in enumerate([1, 1, 1] + [0] * 7)]
SCHEMA = "id int, label int, score double"


def at(df, k):
    row = df.where(f"k = {k}").first()
    return row["precision"], row["recall"]


def test_topk(frame):
    df = evaluate.topk_metrics(frame(RANKED, SCHEMA), [], "id", [2, 3, 5, 10, 50])
    assert at(df, 5) == (0.6, 1.0) and at(df, 3) == (1.0, 1.0) and at(df, 2)[1] == pytest.approx(2 / 3)
    assert at(df, 10) == (0.3, 1.0) and at(df, 50) == (0.3, 1.0)


def test_topk_without_positives(frame):
    df = evaluate.topk_metrics(frame([(1, 0, 0.5)], SCHEMA), [], "id", [1])
    assert at(df, 1) == (0.0, 0.0)


def test_perfect_ranking(frame):
    rows = [(i, 0, i / 10) for i in range(5)] + [(i, 1, i / 10 + 0.1) for i in range(5, 10)]
    df = frame(rows, SCHEMA)
    assert evaluate.roc_auc(df, []).first()[0] == 1.0 and evaluate.average_precision(df, []).first()[0] == 1.0


def test_one_class_is_null(frame):
    df = frame([(1, 1, 0.5), (2, 1, 0.6)], SCHEMA)
    assert evaluate.roc_auc(df, []).first()[0] is None and evaluate.average_precision(df, []).first()[0] is None


def test_metrics_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.random(600), 2)
    label = (rng.random(600) < score * 0.5).astype(int)
    df = spark.createDataFrame([(i, int(l), float(s)) for i, (l, s) in enumerate(zip(label, score))], SCHEMA)
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert evaluate.roc_auc(df, []).first()[0] == pytest.approx(wins / len(pos) / len(neg))
    ap, recall = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        chosen = label[score >= t]
        ap += (chosen.sum() / label.sum() - recall) * chosen.mean()
        recall = chosen.sum() / label.sum()
    assert evaluate.average_precision(df, []).first()[0] == pytest.approx(ap)
    assert evaluate.brier_score(df, []).first()[0] == pytest.approx(np.mean((score - label) ** 2))
    flagged = {round(r["threshold"], 1): (r["flagged"], r["precision"]) for r in evaluate.threshold_metrics(df, []).collect()}
    for t, (n, precision) in flagged.items():
        assert n == (score >= t).sum() and precision == pytest.approx(label[score >= t].mean() if n else 0.0)


def test_brier_of_a_sure_model(frame):
    df = frame([(0, 0, 0.0), (1, 0, 0.0), (2, 1, 1.0), (3, 1, 1.0)], SCHEMA)
    assert evaluate.brier_score(df, []).first()[0] == 0.0


def test_score_one_is_in_no_calibration_bin(frame):
    df = frame([(0, 0, 0.05), (1, 1, 0.95), (2, 1, 1.0), (3, 0, 0.3), (4, 1, 0.31)], SCHEMA)
    bins = {r["bin"]: r["n"] for r in evaluate.calibration_bins(df, []).collect()}
    assert bins == {0: 1, 9: 1, 2: 1, 3: 1}  # 0.3 is below the third edge, 3 * 0.1


def test_blend_and_summary(frame):
    df = frame([(0.2, 0.4), (0.8, 0.6), (0.5, 0.3)], "a double, b double")
    blended = [r[0] for r in df.select(evaluate.blend(df.a, df.b, (0.6, 0.4))).collect()]
    assert blended == pytest.approx([0.28, 0.72, 0.42])
    folds = frame([(1, "m", "roc_auc", 0.8), (2, "m", "roc_auc", 0.85), (3, "m", "roc_auc", None)], "fold int, model string, metric string, value double")
    row = evaluate.fold_summary(folds, ["model"]).first()
    assert row["mean"] == pytest.approx(0.825) and row["std"] == pytest.approx(0.025)


def test_verdict(frame):
    df = frame([(0.8,), (0.7,), (0.65,)], "auc double")
    assert [r[0] for r in df.select(evaluate.verdict(df.auc)).collect()] == ["STRONG", "MODERATE", "WEAK"]
