"""Flat tables of both origins: every node of p2_found, linked to its parent, with all scalar fields."""

import json
from pathlib import Path

import pytest

from judgelake.operators import shred
from judgelake.plans import registry

DATA = Path("/root/testdata/sf0.001")

CANDIDATE = {
    "candidate_id": "a", "model_path": "p", "temperature": "0.5", "top_p": 1, "response": "r", "score": 0.25, "num_parse_failures": 1.0,
    "reward_result": {"score": 1, "fallback_used": True, "judge_attempts": 2, "criterion_scores": [1, None], "criterion_weights": "[2, 3, 4]", "criterion_parse_ok": {"1": 1, "2": False}, "criterion_yes_probs": 0.5},
}


def flat(spark, lines, table):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    return [r.asDict() for r in shred.flat_json(df, "line_id", "line", "bank_lines", table).orderBy("record_id", *(["cand_pos"] if table != "records" else []), *(["crit_pos"] if table == "criteria" else [])).collect()]


def test_lines(spark):
    lines = [json.dumps({"question_id": "q", "question": "?", "candidates": [CANDIDATE, None, {"response": "s", "reward_result": 0.5}]}), "{", json.dumps({"candidates": None})]
    assert [(r["node"], r["parent"], r["kind"], r["question_id"]) for r in flat(spark, lines, "records")] == [("$", None, "object", "q"), ("$", None, "null", None), ("$", None, "object", None)]
    first, second, third = flat(spark, lines, "candidates")
    assert list(first) == list(shred.FLAT["candidates"])
    assert (first["node"], first["parent"], first["result_node"]) == ("$.candidates[0]", "$", "$.candidates[0].reward_result")
    assert [first[f] for f in ("model_path", "temperature", "top_p", "response", "score", "num_parse_failures")] == ["p", 0.5, 1.0, "r", 0.25, 1]
    assert [first[f"result_{f}"] for f in ("score", "fallback_used", "judge_attempts", "parse_source")] == [1.0, True, 2, None]
    assert (second["kind"], second["cand_pos"], second["response"]) == ("null", 1, None)
    assert (third["score"], third["result_score"]) == (None, 0.5)
    rows = flat(spark, lines, "criteria")
    assert {r["parent"] for r in rows} == {"$.candidates[0]"}
    assert [(r["crit_pos"], r["node"], r["kind"]) for r in rows] == [
        (0, "$.candidates[0].reward_result.criterion_scores[0]", "scalar"), (1, "$.candidates[0].reward_result.criterion_scores[1]", "null"), (2, None, None),
    ]
    assert [tuple(r[f] for f in shred.CRITERION_FIELDS) for r in rows] == [(1.0, 2.0, True, 0.5), (None, 3.0, False, None), (None, 4.0, None, None)]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_both_origins_hold_every_node(spark):
    records, candidates, criteria = (registry.QUERIES[f"p2_flat_{t}"](spark, str(DATA)) for t in ("records", "candidates", "criteria"))
    for df, table in ((records, "records"), (candidates, "candidates"), (criteria, "criteria")):
        assert dict(df.dtypes) == shred.FLAT[table]
    keys = ["origin", "record_id"]
    found = sorted(map(tuple, registry.QUERIES["p2_found"](spark, str(DATA)).collect()))
    made = [(*r, -1, -1) for r in records.select(keys).collect()] + [(*r, -1) for r in candidates.select(*keys, "cand_pos").collect()]
    made += map(tuple, criteria.filter("node is not null").select(*keys, "cand_pos", "crit_pos").collect())
    assert sorted(made) == found
    assert {r[0] for r in made if r[3] >= 0} == {"response_bank", "bank_lines"}
    by_adjacency = {t: registry.QUERIES[f"p2_{t}"](spark, str(DATA)) for t in ("records", "candidates", "criteria")}
    assert sorted(map(repr, records.select("origin", "record_id", "node", "kind").collect())) == sorted(map(repr, by_adjacency["records"].collect()))
    for df, table in ((candidates, "candidates"), (criteria, "criteria")):
        extract = by_adjacency[table].withColumnRenamed("candidate_node", "parent")
        same = [c if c not in ("parse_source", "judge_attempts", "fallback_used") else f"result_{c}" for c in extract.columns]
        assert sorted(map(repr, df.filter("node is not null").select(*same).toDF(*extract.columns).collect())) == sorted(map(repr, extract.collect()))
    for name in ("p2_typed_candidates", "p2_typed_criteria"):
        plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
        assert "bank_lines" not in plan
    for child, parent in ((candidates, records), (criteria, candidates)):
        held = parent.select(*keys, parent["node"].alias("parent"))
        assert child.join(held, [*keys, "parent"], "left_anti").count() == 0
