"""Verdict texts against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from judgelake.functions import parse
from judgelake.functions import text as X

CASES = [
    ("Rule 1: a. Verdict: Yes\nRule 2: b. Verdict: No", [1, 0], [1, 0]),
    ("Rule 2: b. Verdict: N\nrule 1: x Verdict: y", [1, 0], [1, 0]),
    ("Rule 1: a. Verdict: Yes\nRule 1: a. Verdict: No\nRule 2: z Verdict: Yes", [0, 1], [0, 1]),
    ("Rule 1: a. Verdict: Yes\nRule 3: b. Verdict: No", None, None),
    ("Rule 1 - Verdict = yes.\nRule 2: No", None, [1, 0]),
    ("1. Yes\n2. No", None, [1, 0]),
    ('"Rule 1": "Yes",\n"Rule 2": "No"', None, [1, 0]),
    ("1. Yes.\n2. No.", None, None),
    ("• Rule 1: fine, Yes\nRule 2: No", None, None),
    ("* Rule 1) so it is, True\n- Rule 2: FALSE", None, [1, 0]),
    ("Rule 1: fine, Yes.\nRule 2: No", None, None),
    ("Rule 1: fine, 1\nRule 2: bad, 0", None, [1, 0]),
    ("Rule 1 verdict 1 indeed\nRule 2: Verdict- N, sadly", None, [1, 0]),
    ("So Rule 1 has Answer = y here\nand Rule 2 Satisfied: false", None, [1, 0]),
    ("- 1] Yes\nRule 2 - no", None, [1, 0]),
    ("1:: Yes\n2: No", None, None),
    (",1: Yes,\n,2 = 'no',", None, [1, 0]),
    ("1: Yesterday\n2: Nope", None, [1, 0]),
    ("Rule 1: Verdict: Yes\nRule 2: Verdict: Yes\nRule 3: Verdict: No", None, None),
    ("Rule 1: Verdict: Yes\nRule 2: maybe\nRule 3: Verdict: No", None, None),
    ("Rule 1: Verdict: Yes\nRule 3: Verdict: No\n2. Yes", None, None),
    ("", None, None),
    (None, None, None),
    ("  Rule 1:   x Verdict: yes \u0085Rule 2: Verdict: no ", None, None),
]


@pytest.mark.parametrize("text,strict,relaxed", CASES)
def test_verdicts(spark, text, strict, relaxed):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(parse.strict(F.col("t"), F.lit(2)).alias("s"), parse.relaxed(F.col("t"), F.lit(2)).alias("r")).first()
    assert (row["s"], row["r"]) == (strict, relaxed)


def test_no_rules(spark):
    df = spark.createDataFrame([("some words",), ("",), ("Rule 1: Verdict: Yes",)], "t string")
    assert [r[0] for r in df.select(parse.strict(F.col("t"), F.lit(0))).collect()] == [[], None, None]


def test_wrong_rules_stay_among_the_hits(spark):
    text = "Rule 3: a. Verdict: Yes\nRule 4: a. Verdict: Yes\n1. Yes\n2. No"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(parse.relaxed(F.col("t"), F.lit(2)), parse.relaxed(F.col("t"), F.lit(2), carry=False), parse.source(F.col("t"), F.lit(2))).first()
    assert list(row) == [None, None, "failed"]


def test_scores_in_boxes(spark):
    rows = [
        (r"so \boxed{1}", 1, 1, 0.0), (r"\boxed{1} then \boxed{0}", 1, 1, 0.0), (r"\boxed{3} and \boxed{9}", None, None, 2 / 9), (r"\boxed{11}", None, None, 1.0), ("0 or 1", None, 0, 0.0), ("it is 0.5", None, 0, None),
        ("value 7 of 10", None, None, 6 / 9), (r"\boxed{ nan }", None, None, 1.0), (r"\boxed{x} 4", None, None, 3 / 9), (r"\boxed{01}", 1, 1, 0.0), ("none", None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    found = df.select(parse.binary(F.col("t"), strict=True), parse.binary(F.col("t")), parse.likert(F.col("t")), parse.likert(F.col("t"), strict=True)).collect()
    for got, (text, strict, binary, likert) in zip(found, rows, strict=True):
        assert (got[0], got[1]) == (strict, binary), text
        assert got[2] == (None if likert is None else pytest.approx(likert)), text
        assert (got[3] is None) == (likert is None or "boxed" not in text or "x" in text.replace("boxed", "")), text


def test_failures(spark):
    rows = [
        ("Rule 1: Verdict: yes\nRule 2: Verdict: no", "parser_mismatch_strict_should_have_parsed"), ("", "empty_response"), (None, "empty_response"), ("  \n", "empty_response"), ("Rule 1: yes\nRule 2: no", "strict_only_failure"),
        ("<think>Rule 1", "unclosed_thinking"), ("<think>so</think> \n", "reasoning_only_no_final_content"), ("Rule 1: Verdict: yes", "partial_rule_lines"), ("Verdict: yes", "partial_verdict_lines"), ("hello", "no_rule_lines"),
        ("Rule 1: hm\nRule 2: hm", "malformed_rule_lines"), ("Rule 1: Verdict: yes\nRule 9: Verdict: no", "malformed_rule_lines"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    found = [r[0] for r in df.select(parse.failure(F.col("t"), F.lit(2))).collect()]
    assert [f["reason"] for f in found] == [r[1] for r in rows]
    assert (found[0]["rule_line_count"], found[0]["verdict_line_count"], found[0]["strict_parse_ok"], found[5]["contains_think"]) == (2, 2, True, True)


def test_sequence(spark):
    df = spark.createDataFrame([("Rule 1: Verdict: yes\nRule 2: Verdict: no",), ("Rule 2: Verdict: yes\nRule 1: Verdict: no",), ("Rule 1: yes\nso\nRule 1: no\nRule 2) yes, it is\nRule 1: no",), ("Rule 1: yes\nso\nRule 2: no",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.sequential(F.col("t"), F.lit(2))).collect()] == [[1, 0], None, [0, 1], None, None]


def test_texts(spark):
    row = spark.sql("select ' a  b ' as x, 'abcdefghij' as y, array(struct('user' as role, 'hi' as content), struct('bOT' as role, 'yo' as content)) as m, 'Ümlaut & Co.' as s").select(
        X.collapsed(F.col("x")), X.shortened(F.col("y"), 6), X.shortened(F.col("y"), 3), X.dialogue(F.col("m")), X.slug(F.col("s")), X.rough_tokens(F.col("x")), X.after_last(F.lit("a ## b ## c "), "##"),
        X.unfenced(F.lit("```json\n{}\n```")), X.first_line(F.lit(" \n\n one \n two")),
    ).first()
    assert list(row) == ["a b", "abc...", "abc", "User: hi\nBot: yo", "mlaut_co", 2, "c", "{}", "one"]


def test_criteria(spark):
    df = spark.createDataFrame([("Correct units", "Essential  Criteria: States kelvin."), ("Pitfall", "Pitfall Criteria: Guesses."), (None, "Says so."), ("", None)], "t string, d string")
    form = lambda f, **k: [r[0] for r in df.select(X.criterion(F.col("t"), F.col("d"), f, **k)).collect()]
    assert form("canonical")[:3] == ["The response satisfies this criterion: Correct units: States kelvin.", "The response avoids this pitfall: Pitfall: Guesses.", "The response satisfies this criterion: Says so."]
    assert form("compact")[0] == "Correct units: States kelvin." and form("full")[0] == "Correct units: Essential Criteria: States kelvin."
    assert form("title_only") == ["Correct units", "Pitfall", "Says so.", ""] and form("description_only", limit=10)[0] == "Essenti..."
    rule = X.bench_criterion(F.lit(" a  b "), F.lit(True)), X.bench_criterion(F.lit("c"), F.lit(None).cast("boolean"), "full"), X.one_line(F.lit(" a\r\nb ")), X.question_key(F.lit(""), F.lit("[]"))
    assert list(spark.range(1).select(*rule).first())[:3] == ["The response satisfies this hard rule: a b", "c [Soft Rule]", "a b"]
