from pathlib import Path

import pytest
from pyspark.sql import functions as F

from judgelake.operators import align, flatten, reward, validate
from judgelake.plans import registry
from judgelake.sources import readers, writers
from judgelake.streaming import usage

BENCH = "record_id bigint, " + readers.BENCH


def bench(spark):
    rule = lambda i, t: ("q", str(i), t, f"rule {i}")
    rows = [
        (1, "q", "?", None, [rule(1, "hard"), rule(2, "soft")], [
            (0, "m", "x", None, [(1, "hard", "", "No"), (1, "hard", "", "Yes "), (9, "soft", "", "yes")]), (None, "m", "y", 7, None), None]),
        (2, "q2", "?", None, [], [(0, "m", "x", 1, None)]), (3, None, "?", None, None, None),
    ]
    return spark.createDataFrame(rows, BENCH)


def test_samples(spark):
    rows = flatten.flatten_samples(bench(spark)).orderBy("pos").collect()
    assert [(r["sample_id"], r["gold_verdicts"], r["gold_total_score"]) for r in rows] == [("q_0", [1, 0], 3), ("q_-1", [0, 0], 7)]
    assert flatten.criterion_items(flatten.flatten_samples(bench(spark))).count() == 4


def test_regroup_puts_slices_in_place(spark):
    schema = "record_id bigint, cand_pos bigint, group_start int, size int, vector array<int>, ok boolean, text string, n int, rubric array<struct<weight:double>>"
    parts = spark.createDataFrame([(1, 0, 2, 2, [1], False, "b", 4, [(1.0,)]), (1, 0, 0, 2, [1, 0], True, "a", 4, [(1.0,)])], schema)
    row = flatten.regroup(parts).first()
    assert (row["vector"], row["parsed"], row["raw_text"], row["failures"]) == ([1, 0, 1, 0], False, "a\n\nb", 2)


def scored(spark, rows):
    schema = "record_id bigint, question_id string, candidates array<struct<candidate_id:string,score:double,reward_result:struct<criterion_scores:array<double>,criterion_weights:array<double>,num_parse_failures:bigint>>>"
    return spark.createDataFrame([(k, q, [(c, s, (v, w, f)) for c, s, v, w, f in cs]) for k, (q, cs) in enumerate(rows)], schema)


def test_alignment(spark):
    a = scored(spark, [("q", [("c", 9.0, [0.0], [1.0], 0), ("c", 0.5, [1.0, 0.9], [1.0, -2.0], 0)]), ("r", [("c", 0.0, None, None, 1), ("d", 1.0, [1.0], [1.0], 0)]), ("s", [("c", 1.0, [1.0, None], [1.0, 1.0], 0)])])
    b = scored(spark, [("q", [("c", 0.6, [1.0, 1.0], [5.0, 5.0], 0)]), ("r", [("c", 1.0, [1.0], [1.0], 0)]), ("s", [("c", 1.0, [1.0, 1.0], [1.0, 1.0], 0)])])
    rows = {r["candidate_id"]: r for r in align.alignment(align.shared_pairs(a, b)).collect()}
    assert set(rows) == {None, "c"} and rows[None]["samples_total"] == 3 and rows[None]["samples_parse_ok"] == 1 and rows[None]["samples_parse_failed"] == 2
    assert rows["c"]["rule_penalty_accuracy"] == 0.0 and rows["c"]["rule_positive_accuracy"] == 1.0 and rows["c"]["rule_weighted_accuracy_abs"] == 0.333333 and rows["c"]["score_within_0p10_rate"] == 1.0
    assert (rows["c"]["rule_weighted_accuracy_positive"], rows["c"]["rule_weighted_accuracy_penalty_abs"], rows["c"]["score_spearman"]) == (1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        align.shared_pairs(a, scored(spark, [("other", [("c", 0.6, [1.0], [5.0], 0)])]))


def test_alignment_orders_pairs(spark):
    a = scored(spark, [("q", [(c, s, [1.0], [1.0], 0) for c, s in (("a", 0.1), ("b", 0.2), ("c", 0.3))])])
    b = scored(spark, [("q", [(c, s, [1.0], [1.0], 0) for c, s in (("a", 0.1), ("b", 0.4), ("c", 0.3))])])
    row = next(r for r in align.alignment(align.shared_pairs(a, b)).collect() if r["overall"] == 1)
    assert (row["pairwise_pairs_total"], row["pairwise_order_accuracy"], row["score_spearman"]) == (3, 0.666667, 0.5)


def test_violations(spark):
    ids = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "id string")
    assert {(r["check"], r["key"]) for r in validate.ids_unique(ids, "id").collect()} == {("id_repeated", "a"), ("id_blank", " "), ("id_blank", None)}
    told = lambda df: {(r["check"], r["key"], r["detail"]) for r in df.collect()}
    rows = spark.createDataFrame([("a", "train"), ("b", "dev"), ("c", None)], "id string, role string")
    assert told(validate.expected_counts(rows.na.drop(), "role", {"train": 2, "test": 1})) == {("split_count", "train", "2,1"), ("split_count", "dev", "0,1"), ("split_count", "test", "1,0")}
    lookup = spark.createDataFrame([("a", "train"), ("b", "train")], "id string, role string")
    assert told(validate.role_consistent(rows, lookup, "id", "role")) == {("role_differs", "b", "dev,train")}
    bank = spark.createDataFrame([(1, [("x",), ("y",)]), (2, [("y",), (None,)]), (3, None)], "record_id bigint, candidates array<struct<candidate_id:string>>")
    assert told(validate.candidate_ids_equal(bank, "record_id", ["x", "y"])) == {("candidate_ids", "2", "y,"), ("candidate_ids", "3", "")}


def test_last_of_repeated_candidates(spark):
    bank = scored(spark, [("q", [("c", 1.0, [1.0], [1.0], 0), ("d", 2.0, None, None, 0), ("c", 3.0, [0.0], [1.0], 0), (None, 4.0, None, None, 0)]), ("r", [])])
    df = flatten.keyed_candidates(bank)
    assert {(r["candidate_id"], r["cand_pos"], r["c"]["score"]) for r in df.collect()} == {("c", 2, 3.0), ("d", 1, 2.0)}
    assert "Exchange" not in df._jdf.queryExecution().toString()


def test_narrow_scans(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    for name in ("score_summary", "run_summary", "weighted_score", "threshold_sweep", "bank_items", "keyed_candidates", "alignment"):
        plan = registry.QUERIES[name](spark, str(data))._jdf.queryExecution().executedPlan().toString()
        assert "raw_judge_response" not in plan and "response:string" not in plan, name
    for name in ("flatten_samples", "criterion_items", "grade_totals", "sft_targets", "mixed_quality"):
        plan = registry.QUERIES[name](spark, str(data))._jdf.queryExecution().executedPlan().toString()
        assert "answer_text" not in plan and "justification" not in plan, name
    plan = registry.QUERIES["candidate_text_profile"](spark, str(data))._jdf.queryExecution().executedPlan().toString()
    assert "reward_result" not in plan


def test_readers_and_writers(spark, tmp_path):
    for name, body in {"a.txt": "x # note\n\n y\nx\n", "b.json": '["x", "y"]', "c.json": '{"train": ["x", "y"]}'}.items():
        (tmp_path / name).write_text(body)
        assert sorted(r["id"] for r in readers.id_list(spark, str(tmp_path / name)).collect()) == ["x", "y"]
    (tmp_path / "d.json").write_text('{"unknown": ["x"]}')
    with pytest.raises(Exception, match="none of the keys"):
        readers.id_list(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "lines.jsonl").write_text('{"id": "x"}\n\n{"id": "x"}\n{"other": 1}\n')
    with pytest.raises(ValueError, match="line 4"):
        readers.required_ids(spark, str(tmp_path / "lines.jsonl"), "id")
    (tmp_path / "lines.jsonl").write_text('{"id": "x"}\n{"id": "y"}\n{"id": "x"}\n')
    assert sorted(r["id"] for r in readers.required_ids(spark, str(tmp_path / "lines.jsonl"), "id").collect()) == ["x", "y"]
    assert readers.first_present(spark, [str(tmp_path / "none.jsonl"), str(tmp_path / "lines.jsonl")], "id string").count() == 3
    (tmp_path / "artifact.json").write_text('{"weights": [1], "bias": 0}')
    assert readers.artifact(spark, str(tmp_path / "artifact.json"), ["weights"])["bias"] == 0
    with pytest.raises(ValueError, match="layer"):
        readers.artifact(spark, str(tmp_path / "artifact.json"), ["weights", "layer"])
    (tmp_path / "bench.json").write_text('[{"question_id": "1", "answers": [{"answer_id": 1}]}, {"question_id": "2"}]')
    assert readers.json_array(spark, str(tmp_path / "bench.json"), readers.BENCH).count() == 2
    assert readers.settings('﻿export A="1"\nB=2 \n# c\nA=3\n') == {"A": "1", "B": "2"}
    df = spark.createDataFrame([(1, [1, 2], "a,\n\"b\"")], "k int, v array<int>, t string")
    writers.csv_table(df, str(tmp_path / "csv"))
    back = readers.vector_cells(readers.csv_table(spark, str(tmp_path / "csv"), "k int, v string, t string"), "v").first()
    assert tuple(back) == (1, [1, 2], 'a,\n"b"')
    writers.json_array(df, str(tmp_path / "small.json"))
    writers.markdown(df.select("k", "t"), str(tmp_path / "small.md"), "T")
    assert "| 1 |" in (tmp_path / "small.md").read_text()
    writers.markdown_chunks(spark.range(5).select("id", F.concat(F.lit("t"), "id").alias("t")), "id", "t", str(tmp_path / "chunks"), 2)
    assert len(list((tmp_path / "chunks").glob("chunk=*"))) == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1_700_000_000.0 + 600 * i, "b", "m", 10, 1, {"prompt_tokens": "5", "completion_tokens": "{}"}) for i in range(12)]
    log = spark.createDataFrame([*rows, rows[0]], usage.SCHEMA)
    log.write.parquet(str(tmp_path / "log"))
    query = usage.usage_stream(spark, str(tmp_path / "log"), lateness="0 seconds").writeStream.format("memory").queryName("usage_test").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r["start"], r["calls"], r["prompt_tokens"]) for r in usage.windowed(log).collect()}
    stream = {(r["start"], r["calls"], r["prompt_tokens"]) for r in spark.sql("select * from usage_test").collect()}
    assert stream and stream <= batch and sum(x[1] for x in batch) == 12


def test_scoring_stream(spark, tmp_path):
    schema = "id bigint, split string, texts array<string>, rubric array<struct<title:string,description:string,weight:double>>"
    requests = [(1, "train", ["Rule 1: Verdict: Yes"], [("a", "b", 2.0)]), (2, "test", ["Rule 1: Verdict: Yes"], [("a", "b", 2.0)]), (3, "train", ["?"], [("a", "b", 2.0)])]
    spark.createDataFrame(requests, schema).write.parquet(str(tmp_path / "in"))
    score = lambda df: df.select("id", reward.compute_score(F.col("texts"), F.col("rubric"), F.col("split"))["score"].alias("score"))
    query = usage.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), score, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {(r["id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    told = usage.health(query)
    assert (told["active"], told["error"]) == (False, None)


def test_tagged_rubric(spark):
    df = spark.sql("select array(named_struct('criterion', 'c', 'points', 2, 'tags', array('x', 'axis:depth')), named_struct('criterion', 'd', 'points', null, 'tags', null)) as r")
    assert [tuple(x) for x in df.select(flatten.tagged_rubric(F.col("r"))).first()[0]] == [("depth", "c", 2.0), ("criterion", "d", 1.0)]
