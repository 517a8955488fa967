"""Rewards, prompts, banks, audits, splits and checks against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from judgelake import runtime
from judgelake.functions import num, prompt
from judgelake.operators import audit, banks, metrics, probe, reward, splitting

RUBRIC = [("a", "x", 3.0), ("b", "y", -1.0), ("c", "z", None)]
SCHEMA = "texts array<string>, rubric array<struct<title:string,description:string,weight:double>>, split string"


def score(spark, texts, rubric=RUBRIC, split="train", **options):
    df = spark.createDataFrame([(texts, rubric, split)], SCHEMA)
    return df.select(reward.compute_score(F.col("texts"), F.col("rubric"), F.col("split"), **options).alias("r")).first()["r"]


GOOD = "Rule 1: Verdict: Yes\nRule 2: Verdict: No\nRule 3: Verdict: Yes"


def test_joint(spark):
    r = score(spark, ["hm", GOOD])
    assert (r["score"], r["criterion_scores"], r["criterion_weights"], r["judge_attempts"], r["parse_source"], r["num_parse_failures"]) == (0.8, [1.0, 0.0, 1.0], [3.0, 1.0, 1.0], 2, "judge", 0)
    r = score(spark, ["hm", "hm", "hm", GOOD])
    assert (r["score"], r["parse_source"], r["num_parse_failures"], r["criterion_parse_ok"], r["judge_attempts"]) == (0.0, "parse_failed", 3, [False] * 3, 3)
    r = score(spark, ["hm"], fallback=True, threshold=3.0)
    assert (r["score"], r["fallback_used"], r["criterion_scores"], r["raw_parse_success"], r["raw_num_parse_failures"], r["num_parse_failures"]) == (0.6, True, [1.0, 0.0, 0.0], False, 3, 0)
    assert score(spark, ["1. Yes\n2. No\n3. Yes"])["score"] == 0.8 and score(spark, ["1. Yes\n2. No\n3. Yes"], strict=True)["score"] == 0.0


def test_single_and_implicit(spark):
    r = score(spark, [r"\boxed{1}", "no idea"], strategy="explicit_per_criterion")
    assert (r["score"], r["criterion_parse_ok"], r["num_parse_failures"], r["raw_parse_success"]) == (0.6, [True, False, False], 2, False)
    assert score(spark, [r"\boxed{10}"], strategy="implicit")["score"] == 1.0
    assert score(spark, ["what"], strategy="implicit")["num_parse_failures"] == 1


def test_gate_and_own_function(spark):
    assert score(spark, [GOOD], split="test")["parse_source"] == "test_split" and score(spark, [GOOD], split="test", score_test=True)["score"] == 0.8
    assert score(spark, [GOOD], rubric=[])["parse_source"] == "no_rubric" and score(spark, None)["parse_source"] == "no_judge_text"
    own = lambda texts, rubric: reward.zero_result(rubric, "own")
    assert score(spark, [GOOD], strategy=own)["parse_source"] == "own"
    with pytest.raises(ValueError):
        score(spark, [GOOD], strategy="other")


def test_judge_calls(spark):
    rows = spark.createDataFrame([(k, f"Rules (2):\n1. a\n2. b {k}") for k in range(40)], "k int, prompt string").repartition(3)
    failed = set()

    def judge(text):
        if text.endswith(" 7"):
            raise RuntimeError
        if text.endswith(" 8") and text not in failed:
            failed.add(text)
            raise RuntimeError
        return reward.stub_judge(text)

    got = {r["k"]: r["answer"] for r in reward.call_judge(rows, "prompt", judge).collect()}
    assert len(got) == 40 and got[7] == "" and got[8].startswith("Rule 1: stated. Verdict: ") and got[8].count("\n") == 1


def test_prompts(spark):
    df = spark.createDataFrame([("a {b}", None)], "q string, r string")
    row = df.select(prompt.filled("{{x}} {q}|{r}", {"q": F.col("q"), "r": F.col("r")}), prompt.replaced("{q} {b}", {"q": F.col("q"), "b": F.lit("c")})).first()
    assert list(row) == ["{x} a {b}|", "a c c"]
    with pytest.raises(KeyError):
        prompt.filled("{none}", {})
    assert [prompt.model_spec(x) for x in ("a", "a::b", "a::b::c")] == [("a", "a", None), ("a", "b", None), ("a", "b", "c")]
    with pytest.raises(ValueError):
        prompt.model_spec("a::b::c::d")


def test_bank_build(spark):
    specs = banks.spec_matrix(spark, [("M 1", "p")], [("M 1", "p", 0.7, 0.9)])
    questions = spark.createDataFrame([("q", "?", None)], "question_id string, question string, reference_answer string")
    answers = [("q", "m_1_greedy", "x"), ("q", "m_1_sampled", None)]
    made = banks.bank_build(questions, spark.createDataFrame(answers, "question_id string, candidate_id string, response string"), specs).first()["candidates"]
    assert [(c["candidate_id"], c["response"], c["temperature"]) for c in made] == [("reference_answer", "", 0.0), ("m_1_greedy", "x", 0.0), ("m_1_sampled", None, 0.7)]
    for bad in (answers[:1], [*answers, ("q", "other", "x")], [answers[0], answers[0]]):
        with pytest.raises(Exception, match="match the specs"):
            banks.bank_build(questions, spark.createDataFrame(bad, "question_id string, candidate_id string, response string"), specs).collect()


def test_nested_bank(spark):
    questions = spark.createDataFrame([("q", [("a", "b", 2.0), ("a", "b", None)]), ("r", [])], "question_id string, rubric array<struct<title:string,description:string,weight:double>>")
    rows = [("q", "c", 1, 0.2, 0.0, None), ("q", "c", 0, 0.9, 1.0, -2.0)]
    schema = "question_id string, candidate_id string, rule_index bigint, prob double, score double, weight double"
    made = banks.nested_bank(spark.createDataFrame(rows, schema), questions).collect()
    assert len(made) == 1 and made[0]["candidates"][0]["score"] == pytest.approx(2 / 3) and made[0]["candidates"][0]["reward_result"]["criterion_scores"] == [1.0, 0.0]
    with pytest.raises(Exception, match="differ in number"):
        banks.nested_bank(spark.createDataFrame(rows[:1], schema), questions).collect()


def test_audit(spark):
    key = spark.createDataFrame([("i", "p", "Yes", "No", "2"), ("j", "p", "No", "No", None), ("k", "q", "Yes", "Yes", "x")], "item_id string, pair_id string, gpt_rule_1 string, gpt_rule_2 string, rule_1_weight string")
    sheet = spark.createDataFrame([("i", " TRUE", "y"), ("j", "n", "0"), ("z", "y", "y")], "item_id string, human_rule_1 string, human_rule_2 string")
    rows = audit.joined(key, sheet, rules=2)
    told = {r["rule"]: r for r in audit.agreement(rows).collect()}
    assert (told[None]["compared"], told[None]["missing"], told[None]["agreement"], told[None]["weighted_agreement"], told[None]["no_yes"]) == (4, 2, 0.75, 0.8, 1)
    items = audit.items(rows)
    assert tuple(audit.preferences(items).first()) == (1, 1, 0, 0)
    row = audit.scores(items).first()
    assert (row["items_complete"], round(row["score_mae_norm"], 6), row["score_pearson_norm"]) == (2, 0.166667, pytest.approx(1.0))
    assert audit.scores(items.limit(0)).first()["score_pearson_norm"] is None
    wide = audit.to_wide(audit.to_criteria(key, ["item_id"], 2, {"j": "gpt_rule_{}"}), ["item_id"], 2, {"j": "gpt_rule_{}"})
    assert {tuple(r) for r in wide.collect()} == {("i", "Yes", "No"), ("j", "No", "No"), ("k", "Yes", "Yes")}


def test_splits(spark):
    ids = spark.createDataFrame([(str(k % 10), k) for k in range(20)] + [(None, 99)], "id string, n int")
    made = splitting.exact_split(ids, "id", {"a": 3, "b": 7})
    assert sorted(r["count"] for r in made.groupBy("split").count().collect()) == [3, 7]
    with pytest.raises(ValueError):
        splitting.exact_split(ids, "id", {"a": 3})
    roles = splitting.role_split(ids, "id", ["n"], 2, 3).collect()
    assert len(roles) == 5 and all(r["n"] < 10 for r in roles)
    with pytest.raises(ValueError):
        splitting.role_split(ids, "id", ["n"], 8, 3)
    part = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x string")
    assert splitting.split_from_ids(ids, "id", {"train": part("1", "2"), "dev": part("3")}).count() == 6
    with pytest.raises(ValueError, match="split_overlap"):
        splitting.split_from_ids(ids, "id", {"train": part("1"), "dev": part("1")})
    with pytest.raises(ValueError, match="id_"):
        splitting.split_from_ids(ids, "id", {"train": part("1"), "dev": part("77")}, cover=True)
    manifest = {"splits": {"2": {"train_question_ids": ["1", "2"], "dev_question_ids": ["3"]}}}
    assert splitting.manifest_parts(spark, manifest, 2)["train"].count() == 2
    with pytest.raises(ValueError):
        splitting.manifest_parts(spark, manifest, 3)
    with pytest.raises(Exception, match="whole number"):
        splitting.by_number(part("1", "x"), "x").collect()
    assert [r["x"] for r in splitting.by_number(part("10", "9"), "x").collect()] == ["9", "10"]
    assert splitting.sample_rows(ids, "id", 4).count() == 8 and splitting.shuffled_rows(ids, "n", 5, F.col("n") > 3).count() == 5


def test_numbers(spark):
    assert [num.back_off(k) for k in (1, 2, 9)] == [1.0, 2.0, 30.0] and num.batch_size(100, 30) == 3 and num.batch_size(1, 30) == 1
    assert [probe.select_layers(x, 24) for x in ("last", "auto", "-1,1,24", "")] == [[24], [6, 12, 18, 24], [24, 1], []] and probe.select_layers("all", 3) == [1, 2, 3]
    for bad in ("7", "0", "-4"):
        with pytest.raises(ValueError):
            probe.select_layers(bad, 3)
    assert [r[0] for r in spark.createDataFrame([("Y",), (" Not sure",), ("?",), ("u",), (None,)], "x string").select(audit.label(F.col("x"))).collect()] == ["Yes", "Unsure", "Unsure", "", ""]


def test_threshold_starts_from_a_half(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.2, 0)], "p double, y bigint")
    assert metrics.best_threshold(metrics.threshold_sweep(rows, "p", "y")).first()["threshold"] == 0.5
    rows = spark.createDataFrame([(0.3, 1), (0.25, 1), (0.2, 0)], "p double, y bigint")
    assert metrics.best_threshold(metrics.threshold_sweep(rows, "p", "y")).first()["threshold"] == 0.21
    layers = spark.createDataFrame([(2, 0.9, 0.8, 0.7, 0.3), (1, 0.9, 0.8, 0.7, 0.3), (0, 0.9, 0.8, 0.7, 0.4)], "layer int, macro_f1 double, balanced_accuracy double, accuracy double, loss double")
    assert metrics.best_layer(layers).first()["layer"] == 1


def test_no_private_folder_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class N:
                                @staticmethod
                                def isDefined():
                                    return False

                            return N

                    return S

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster)
