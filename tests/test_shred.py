"""Shredding of records of every shape."""

import json

from pyspark.sql import functions as F

from judgelake.operators import shred

C = {"candidate_id": "a", "response": "r"}


def nodes(lines, spark):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string").withColumn("scalar", F.lit("clash")).withColumn("node", F.lit(1))
    tables = shred.entity_tables(shred.shred_json(df, "line_id", "line", "bank_lines"), {"candidate_id": "string"})
    return sorted(tuple(r)[1:] for r in shred.nodes_found(tables).collect()), tables


def own(lines, spark):
    return [x for x in nodes(lines, spark)[0] if x[1] >= 0]


def scored(scores):
    return [C | {"reward_result": {"score": 1, "criterion_scores": scores}}]


def test_unreadable_lines_have_their_own_row(spark):
    lines = [None, "", "  ", "{", "[1]", "null", '{"candidates": [{"a": NaN}]}', "# x", '{"a": 1} {"b": 2}']
    assert nodes(lines, spark)[0] == [(i, -1, -1) for i in range(len(lines))]


def test_shapes_of_candidates(spark):
    shapes = [
        ([C, None], [(0, -1), (1, -1)]), (C, [(0, -1)]), ({"x": {"response": "r"}, "y": None}, [(0, -1), (1, -1)]), (json.dumps([C]), [(0, -1)]),
        ([[C], [[C]]], [(0, -1), (1, -1)]), (None, []), ([], []), ({}, []), ([json.dumps(C)], [(0, -1)]),
    ]
    for shape, expected in shapes:
        assert [x[1:] for x in own([json.dumps({"candidates": shape})], spark)] == expected


def test_shapes_of_scores(spark):
    shapes = [([1, None, 0.5], 3), (1.0, 1), (0, 1), ("[1, 0]", 2), ({"1": 1, "2": None}, 2), (None, 0), ([], 0), ([[1], [0, 1]], 3), ("0.5", 1)]
    for shape, n in shapes:
        assert len([x for x in own([json.dumps({"candidates": scored(shape)})], spark) if x[2] >= 0]) == n
    text = json.dumps({"candidates": [C | {"reward_result": json.dumps({"criterion_scores": [1, 1]})}]})
    assert len(own([text], spark)) == 3
    assert len(own([json.dumps({"candidates": [C | {"reward_result": 0.5}]})], spark)) == 1
    assert len(own([json.dumps({"candidates": [C | {"criterion_scores": [1]}]})], spark)) == 2


def test_marks_around_and_deep_nesting(spark):
    assert len(nodes(["﻿ \n" + json.dumps({"candidates": [C]}) + "\n﻿"], spark)[0]) == 2
    assert nodes(["[" * 100_000], spark)[0] == [(0, -1, -1)]


def test_ids_from_keys_become_columns(spark):
    rows = nodes([json.dumps({"candidates": {"x": {"response": "r"}}})], spark)[1]["candidates"].collect()
    assert [(r["candidate_id"], r["cand_pos"]) for r in rows] == [("x", 0)]


def test_typed_columns(spark):
    schema = "record_id bigint, candidates array<struct<candidate_id:string,reward_result:struct<criterion_scores:array<double>>>>, parent string"
    rows = [(1, [("a", ([1.0, None],)), None, ("b", None)], "p"), (2, None, "p"), (3, [], "p"), (1, None, "p")]
    made = shred.shred_columns(spark.createDataFrame(rows, schema), "record_id", "response_bank", ["candidates"])
    tables = shred.entity_tables(made, {"candidate_id": "string"})
    found = sorted(tuple(r)[1:] for r in shred.nodes_found(tables).collect())
    assert found == [(1, -1, -1), (1, -1, -1), (1, 0, -1), (1, 0, 0), (1, 0, 1), (1, 1, -1), (1, 2, -1), (2, -1, -1), (3, -1, -1)]
    assert sorted((r["cand_pos"], r["candidate_id"]) for r in tables["candidates"].collect()) == [(0, "a"), (1, None), (2, "b")]
    assert shred.nodes_found(shred.entity_tables(made.limit(0))).count() == 0
