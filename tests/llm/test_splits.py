"""Groups against union-find, splits against the plan."""

import random

import pytest
from pyspark.sql import functions as F

from judgelake.llm import components, splits
from judgelake.runtime import Stage

BANK = "record_id bigint, question_id string, data_source string, candidates array<struct<candidate_id:string>>, node string, key string, u bigint"


def bank(spark, rows):
    return spark.createDataFrame([(i, q, s, None if c is None else [None if x is None else (x,) for x in c], "clash", "clash", 1) for i, q, s, c in rows], BANK)


def specs(spark):
    return spark.createDataFrame([("shared_id",), (None,)], "candidate_id string")


def plan(spark):
    return spark.createDataFrame([("train", 0.65), ("dev", 0.15), ("heldout", 0.2), ("none", 0.0)], "split_role string, share double")


def groups(spark, rows):
    return {(r["record_id"], r["group_id"]) for r in splits.tied_groups(bank(spark, rows), specs(spark)).collect()}


def test_spellings_of_ids(spark):
    same = ["q_00ab34cd56ef7890", "Q-00AB34CD56EF7890", " q00ab34cd56ef7890\n", "00ab34cd56ef7890", "#q_00ab34cd56ef7890"]
    numbers = ["1000234", "q_1000234", " 1000234", "001000234", "1000234.0", "1,000,234", "+1000234"]
    rows = [(i, q, "s", None) for i, q in enumerate(same)] + [(10 + i, q, "s", None) for i, q in enumerate(numbers)]
    rows += [(30, "q_00ab34cd56ef7891", "s", None), (31, "1000235", "s", None), (32, None, "s", None), (33, " ", "s", None), (34, None, "s", [None]), (35, "", "s", [])]
    assert groups(spark, rows) == {(i, 0) for i in range(5)} | {(10 + i, 10) for i in range(7)}


def test_shared_specs_tie_nothing(spark):
    rows = [(1, "1", "s", ["shared_id", "resp_a"]), (2, "2", "s", ["SHARED-ID", "x"]), (3, "3", "s", ["RESP_a", "resp_a"])]
    assert groups(spark, rows) == {(1, 1), (3, 1)}


def test_chains_and_hubs_against_union_find(spark):
    rng = random.Random(3)
    rows = [(i, str(i // 2 + 100), "s", [f"resp_{(i + 1) // 2}"]) for i in range(40)]  # one chain of 40
    rows += [(100 + i, "777", "s", []) for i in range(30)]  # one hub
    rows += [(200 + i, str(rng.randint(5000, 5030)), "s", [f"resp_z{rng.randint(0, 60)}"]) for i in range(60)]
    rows += rows[:5]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, q, _, cs in rows:
        for k in [("q", q), *(("c", c) for c in cs)]:
            parent[find(k)] = find(i)
    members = {}
    for i in {r[0] for r in rows}:
        members.setdefault(find(i), []).append(i)
    assert groups(spark, rows) == {(i, min(v)) for v in members.values() if len(v) > 1 for i in v}


def test_empty(spark):
    assert groups(spark, []) == set()
    assert splits.assign_splits(bank(spark, []), specs(spark), plan(spark)).count() == 0


def test_long_chain_settles(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {r["root"] for r in components.contract(edges, Stage(spark)).collect()} == {0}


@pytest.mark.parametrize("hub", [0, 200])
def test_splits_keep_groups_and_shares(spark, hub):
    rng = random.Random(1)
    rows = [(i, str(rng.randint(1000, 1450)), rng.choice(["a", "b", None]), None) for i in range(600)] + [(5000 + i, "9999", "a", None) for i in range(hub)]
    got = splits.assign_splits(bank(spark, rows), specs(spark), plan(spark), shard=150).collect()
    assert len(got) == len(rows)
    role_of = {}
    for r in got:
        assert role_of.setdefault(r["component_id"], r["split_role"]) == r["split_role"]
    sizes = {}
    for r in got:
        sizes[r["split_role"]] = sizes.get(r["split_role"], 0) + 1
    for name, share in (("train", 0.65), ("dev", 0.15), ("heldout", 0.2)):
        assert abs(sizes[name] / len(rows) - share) < 0.02


def test_balance(spark):
    bank = spark.createDataFrame([(i, f"q_{i // 3}", "a" if i % 2 else None, None) for i in range(300)], "record_id bigint, question_id string, data_source string, candidates array<struct<candidate_id:string>>")
    specs = spark.createDataFrame([], "candidate_id string")
    plan = spark.createDataFrame([("train", 0.8), ("dev", 0.2)], "split_role string, share double")
    rows = splits.split_balance(bank, specs, plan).collect()
    assert len(rows) == 4 and sum(r["records"] for r in rows) == sum(r["hashed_records"] for r in rows) == 300
    assert all(abs(r["records"] - r["wanted"]) <= 3 for r in rows)
