import random

from judgelake.llm import cutoff

ENDS = ["the river slows.", "the valley narrows at dusk.", "nobody saw the second lamp.", "every ledger was copied twice.", "rain fell on the harbour!"]


def values(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(ENDS).capitalize() for _ in range(rng.randint(3, 8))) + rng.choice(["", "", "", "\nAnswer: blue", "\n| lamp | 4 |"]) for _ in range(n)]


def test_held_out_accuracy():
    model = cutoff.train(values(600), [80])
    rng = random.Random(9)
    whole = values(200, 7)
    cut = [t[: rng.randint(40, len(t) - 6)].rstrip(".!") + rng.choice(["", "…", " [truncated]", "&am"]) for t in whole]
    cut = [c for c in cut if c and not c.rstrip().endswith((".", "!"))]
    assert sum(model.score(t) < 0.6 for t in whole) / len(whole) > 0.97
    assert sum(model.score(t) >= 0.6 for t in cut) / len(cut) > 0.9


def test_every_value_counts(spark, bank_schema):
    whole = values(120)
    rows = [(i, "q", "train", "s", "?", "x", "y", [("c", "m", t, ([t, None, t[:41]],))]) for i, t in enumerate(whole)]
    rows += [(900, "q", None, None, None, "x", "y", [None, ("c", None, None, None), ("c", None, "", ([],)), ("c", None, "  ", (None,)), ("c", None, "x" * 100_000, None)]), (901, "q", None, None, None, "x", "y", None)]
    df = spark.createDataFrame(rows, bank_schema)
    scored = cutoff.find_cut(df, sample=200).collect()
    assert len(scored) == 120 * 3 + 1
    found = {(r["record_id"], r["cand_pos"], r["field"], r["value_pos"]) for r in scored if r["cut"]}
    made = {(i, 0, "raw_judge_responses", 2) for i, t in enumerate(whole) if t[:41].rstrip()[-1] not in ".!"}
    assert len(made & found) > 0.9 * len(made)
    assert {r["level"] for r in cutoff.cut_report(df).collect()} == {"data_source", "model_name"}


def test_many_limits_of_one_field_leave_those_of_another(spark):
    sizes = [100 + 20 * k for k in range(70)]
    rows = [("raw_judge_responses", "x" * n) for n in sizes for _ in range(60)] + [("response", "x" * 90)] * 50
    limits, _ = cutoff.survey(spark.createDataFrame(rows, "field string, value string"))
    assert sorted(limits["raw_judge_responses"]) == sizes and limits["response"] == [90]


def test_empty(spark, bank_schema):
    assert cutoff.cut_cases(spark.createDataFrame([], bank_schema)).count() == 0
    assert cutoff.cut_cases(spark.createDataFrame([(1, None, None, None, None, None, None, [("c", "m", "Yes.", None)])], bank_schema)).count() == 0
