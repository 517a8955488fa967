"""Metrics against a small model in plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelake.functions import num
from judgelake.operators import metrics, probe, reward, splitting, validate
from judgelake.operators.score import log_sum_exp, weighted_score

SCHEMA = (
    "model string, question_id string, answer_id bigint, parse_ok boolean, num_rules bigint, weight_sum bigint, rule_matches bigint, weighted_rule_matches bigint, "
    "vector_exact boolean, score_exact boolean, gold_total_score bigint, pred_total_score double, gold array<int>, pred array<int>"
)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        gold, pred = ([rng.randint(0, 1) for _ in range(3)] for _ in range(2))
        ok = rng.random() > 0.2
        w = [3, 1, 1]
        g, p = (sum(a * b for a, b in zip(v, w, strict=True)) for v in (gold, pred))
        m = [int(a == b) for a, b in zip(gold, pred, strict=True)]
        rows.append(("m", f"q{i // 3}", i % 3, ok, 3, 5, sum(m) if ok else 0, sum(a * b for a, b in zip(m, w, strict=True)) if ok else 0, ok and gold == pred, ok and g == p, g, float(p) if ok else None, gold, pred if ok else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_suite_against_plain_python(spark, seed):
    rows = made(seed, 40)
    got = metrics.metric_suite(spark.createDataFrame(rows, SCHEMA)).first().asDict()
    ok = [r for r in rows if r[3]]
    assert got["samples_total"] == 40 and got["samples_parse_ok"] == len(ok)
    assert got["rule_hamming_accuracy"] == pytest.approx(sum(r[6] for r in ok) / (3 * len(ok)), abs=1e-6)
    tp, fp, fn, tn = (sum(a == x and b == y for r in ok for a, b in zip(r[12], r[13], strict=True)) for x, y in ((1, 1), (0, 1), (1, 0), (0, 0)))
    assert got["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), abs=1e-6)
    pairs = right = 0
    for q in {r[1] for r in rows}:
        for a, b in itertools.combinations([r for r in ok if r[1] == q], 2):
            pairs += 1
            s = lambda x: (x > 0) - (x < 0)
            right += s(a[10] - b[10]) == s(a[11] - b[11])
    assert got["pairwise_order_accuracy"] == pytest.approx(right / pairs, abs=1e-6)
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    g, p = rank([r[10] for r in ok]), rank([r[11] for r in ok])
    mg, mp = sum(g) / len(g), sum(p) / len(p)
    rho = sum((a - mg) * (b - mp) for a, b in zip(g, p, strict=True)) / math.sqrt(sum((a - mg) ** 2 for a in g) * sum((b - mp) ** 2 for b in p))
    assert got["score_spearman"] == pytest.approx(rho, abs=1e-6)


def test_nothing_parsed(spark):
    rows = [r[:3] + (False, 3, 5, 0, 0, False, False, r[10], None, r[12], None) for r in made(3, 6)]
    got = metrics.metric_suite(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["rule_hamming_error"] == 1.0 and got["score_mae"] == 0.0 and got["rule_hamming_error_per_sample_all_samples"] == 1.0


def test_empty(spark):
    assert metrics.metric_suite(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_of_rows_does_not_count(spark):
    rows = made(5, 30)
    a = metrics.metric_suite(spark.createDataFrame(rows, SCHEMA)).first()
    b = metrics.metric_suite(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).first()
    assert a == b


def test_scores(spark):
    row = spark.sql("select array(1D, 0D, 1D) as v, array(2D, null, -3D) as w, array(1D) as short, array(0D) as zero").select(
        weighted_score(F.col("v"), F.col("w")), weighted_score(F.col("short"), F.col("w")), weighted_score(F.col("v"), F.col("zero")), weighted_score(F.lit(None).cast("array<double>"), F.col("w")),
        log_sum_exp(F.array(F.lit(0.0), F.lit(0.0))), log_sum_exp(F.array().cast("array<double>")), num.sigmoid(F.lit(-800.0)), num.softplus(F.lit(800.0)),
    ).first()
    assert list(row) == pytest.approx([5 / 6, 1.0, 0.0, 0.0, math.log(2), float("-inf"), 0.0, 800.0])


def test_reward(spark):
    df = spark.createDataFrame([("Rule 1: Verdict: yes\nRule 2: Verdict: no", [("a", "b", 1.0), ("c", "d", None)]), ("?", [("a", "b", 9.0)])], "t string, r array<struct<title:string,description:string,weight:double>>")
    plain = [r[0] for r in df.select(reward.explicit_joint(F.array("t"), F.col("r"))).collect()]
    assert [(x["score"], x["criterion_scores"], x["num_parse_failures"]) for x in plain] == [(0.5, [1, 0], 0), (0.0, [0], 1)]
    kept = df.select(reward.explicit_joint(F.array("t"), F.col("r"), fallback=True)).collect()[1][0]
    assert kept["score"] == 1.0 and kept["fallback_used"]


def test_splits(spark):
    ids = spark.createDataFrame([(f"i{k}",) for k in range(101)] + [("i1",), (None,)], "id string")
    got = splitting.fraction_split(ids, "id", {"a": 0.4, "b": 0.1, "c": 0.5})
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"a": 40, "b": 10, "c": 51}
    nested = splitting.nested_split(ids, "id", [5, 10], 3, 4)
    small, large = ({r["id"] for r in nested.filter(f"train_size = {s} and split = 'train'").collect()} for s in (5, 10))
    assert small < large and len(large) == 10
    assert validate.splits_disjoint(got, "id", "split").count() == 0
    assert splitting.fraction_split(ids.limit(0), "id", {"a": 0.5, "b": 0.5}).count() == 0


def test_exact_shuffle():
    ids = [str(k) for k in range(10)]
    parts = splitting.exact_fraction_split(ids, {"a": 0.25, "b": 0.25, "c": 0.5}, 42)
    assert [len(p) for p in parts.values()] == [2, 2, 6] and sorted(sum(parts.values(), [])) == ids
    assert splitting.exact_order(ids, 7) == splitting.exact_order(ids, 7)


def test_sweep_and_calibration(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.1, 0.3, 0.5, 0.9, 1.0]), rng.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "p double, y int")
    for r in metrics.threshold_sweep(df, "p", "y").collect():
        assert r["tp"] == sum(y for p, y in rows if p >= r["threshold"]) and r["tn"] == sum(1 - y for p, y in rows if p < r["threshold"])
    bins = {}
    for p, y in rows:
        bins.setdefault(min(int(p * 10), 9), []).append((p, y))
    ece = sum(abs(sum(p for p, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(rows)
    assert metrics.calibration_error(df, "p", "y").first()["ece"] == pytest.approx(ece, abs=1e-6)


@pytest.mark.parametrize("few", [0, 1000])
def test_orders_against_all_pairs(spark, few):
    rng = random.Random(6)
    rows = [("m", f"q{q}", a, rng.choice([True, True, True, False]), rng.choice([0, 1, 2, 5]) if q else rng.randint(0, 300), rng.choice([None, 0.5, 1.0, 2.0]) if q else rng.random()) for q in range(4) for a in range(150 if q == 0 else 12)]
    df = spark.createDataFrame(rows, "model string, question_id string, answer_id bigint, parse_ok boolean, gold_total_score bigint, pred_total_score double")
    got = {r["question_id"]: (r["pairs"], r["right"]) for r in metrics.figures_of_cells(metrics.score_cells(df), few=few).collect()}
    sign = lambda a, b: (a > b) - (a < b)
    for q in got:
        read = [(r[4], r[5]) for r in rows if r[1] == q and r[3]]
        right = sum(a[0] == b[0] if None in (a[1], b[1]) and a[1] == b[1] else None not in (a[1], b[1]) and sign(a[0], b[0]) == sign(a[1], b[1]) for a, b in itertools.combinations(read, 2))
        assert got[q] == (len(read) * (len(read) - 1) // 2, right), q


def test_network(spark):
    rng = random.Random(12)
    rows = []
    for k in range(400):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append(([a, b], int(a * b > 0), k % 4 == 0))
    df = spark.createDataFrame([*rows, (None, 1, False)], "v array<double>, y int, held boolean")
    head = probe.train_network(df, "v", "y", "held", hidden=12, epochs=40, rate=0.1)
    scored = probe.network_probability(df, "v", head).collect()
    right = sum((r["p"] >= 0.5) == (r["y"] == 1) for r in scored if r["v"] is not None)
    assert right > 0.9 * 400 and scored[-1]["p"] is None and 0 < head["best_epoch"] <= 40
    linear = probe.train_network(df, "v", "y", "held", epochs=5)
    assert len(linear["weights"]) == 3 and linear["best_dev_loss"] > head["best_dev_loss"]


def test_gradient():
    rng = np.random.default_rng(3)
    for hidden in (0, 4):
        net = probe.Network(3, hidden)
        w, x, y = rng.normal(size=net.length), rng.normal(size=(5, 3)), np.array([0, 1, 1, 0, 1])
        loss = lambda w: (lambda z: (np.logaddexp(0, z) - y * z).sum())(net.logits(w, x)[0])  # noqa: B023, E731
        z, kept = net.logits(w, x)
        got = net.gradient(w, x, 1 / (1 + np.exp(-z)) - y, kept)
        for i in range(net.length):
            e = np.zeros(net.length)
            e[i] = 1e-6
            assert got[i] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-6, abs=1e-5)
