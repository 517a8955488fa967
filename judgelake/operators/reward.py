"""Reward of a response from what a judge said: strategies, the gate of the test split, and the call of a judge.

A strategy is a function of columns, so that rewards are computed in the JVM beside the text; a function of one's own
can be registered in STRATEGIES or given to compute_score. Only calling the judge needs Python.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions import parse
from judgelake.functions.num import back_off, ratio
from judgelake.operators.score import fallback_verdicts

RESULT = "score double, criterion_scores array<double>, criterion_weights array<double>, criterion_parse_ok array<boolean>, num_parse_failures bigint, judge_attempts bigint, parse_source string, fallback_used boolean, raw_parse_success boolean, raw_num_parse_failures bigint"
RESULT_TYPE = "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in RESULT.split(", ")) + ">"


def weights_of(rubric: Column) -> Column:
    """|weight| of each criterion, 1 where it has none."""
    return F.transform(rubric, lambda r: F.abs(F.coalesce(r["weight"], F.lit(1.0))).cast("double"))


def _share(scores: Column, weights: Column) -> Column:
    """Sum of score times weight over the sum of positive weights; 0 without any."""
    both = F.zip_with(scores, weights, lambda s, w: s * w)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return ratio(total(both), total(F.filter(weights, lambda w: w > 0)))


def _result(score: Column, scores: Column, rubric: Column, ok: Column, attempts: Column, source: Column, fallback: Column, raw_failures: Column) -> Column:
    failures = F.size(F.filter(ok, lambda x: ~x))
    return F.struct(
        score.alias("score"), scores.cast("array<double>").alias("criterion_scores"), weights_of(rubric).alias("criterion_weights"), ok.alias("criterion_parse_ok"),
        failures.cast("bigint").alias("num_parse_failures"), attempts.cast("bigint").alias("judge_attempts"), source.alias("parse_source"), fallback.alias("fallback_used"),
        (raw_failures == 0).alias("raw_parse_success"), raw_failures.cast("bigint").alias("raw_num_parse_failures"),
    ).cast(RESULT_TYPE)


def zero_result(rubric: Column, source: str = "parse_failed", attempts: Column | None = None) -> Column:
    """The result of a failure: every criterion 0 and unparsed."""
    n = F.size(rubric)
    return _result(F.lit(0.0), F.transform(rubric, lambda r: F.lit(0.0)), rubric, F.transform(rubric, lambda r: F.lit(False)), F.lit(1) if attempts is None else attempts, F.lit(source), F.lit(False), n)


def explicit_joint(texts: Column, rubric: Column, strict: bool = False, fallback: bool = False, threshold: float = 5.0, most: int = 3) -> Column:
    """texts: the judge's answers to one question about all criteria, in the order of the attempts. The first readable
    one of at most so many attempts counts; without one the result is zero or, if asked for, the fallback by weight."""
    n = F.size(rubric)
    read = (lambda t: parse.strict(t, n)) if strict else (lambda t: parse.relaxed(t, n))
    tried = F.transform(F.slice(texts, 1, most), lambda t, i: F.struct((i + 1).alias("attempt"), read(t).alias("v")))

    def of(first: Column) -> Column:
        yes = F.transform(rubric, lambda r: F.lit(True))
        made = _result(_share(first["v"].cast("array<double>"), weights_of(rubric)), first["v"], rubric, yes, first["attempt"], F.lit("judge"), F.lit(False), F.lit(0))
        attempts = F.size(F.slice(texts, 1, most))
        if fallback:
            kept = fallback_verdicts(rubric, threshold)
            other = _result(_share(kept.cast("array<double>"), weights_of(rubric)), kept, rubric, yes, attempts, F.lit("rubric_weight_fallback"), F.lit(True), n)
        else:
            other = zero_result(rubric, attempts=attempts)
        return F.when(first["v"].isNotNull(), made).otherwise(other)

    return parse.bound(F.get(F.filter(tried, lambda x: x["v"].isNotNull()), F.lit(0)), of)


def explicit_per_criterion(texts: Column, rubric: Column, strict: bool = False) -> Column:
    """texts: one answer with a boxed 0 or 1 for each criterion; an unreadable or absent one is 0 and fails by itself."""
    said = F.transform(rubric, lambda r, i: parse.binary(F.get(texts, i), strict))

    def of(read: Column) -> Column:
        scores, ok = F.transform(read, lambda x: F.coalesce(x, F.lit(0)).cast("double")), F.transform(read, lambda x: x.isNotNull())
        failures = F.size(F.filter(ok, lambda x: ~x))
        return _result(_share(scores, weights_of(rubric)), scores, rubric, ok, F.lit(1), F.lit("per_criterion_boxed"), F.lit(False), failures)

    return parse.bound(said, of)


def implicit(texts: Column, rubric: Column, strict: bool = False) -> Column:
    """One rating from 1 to 10 for all; 0 where there is none."""
    none = F.array().cast("array<double>")
    value = parse.likert(F.get(texts, F.lit(0)), strict)
    empty = F.array()
    return F.struct(
        F.coalesce(value, F.lit(0.0)).alias("score"), none.alias("criterion_scores"), none.alias("criterion_weights"), empty.cast("array<boolean>").alias("criterion_parse_ok"),
        F.when(value.isNull(), 1).otherwise(0).cast("bigint").alias("num_parse_failures"), F.lit(1).cast("bigint").alias("judge_attempts"), F.lit("likert").alias("parse_source"),
        F.lit(False).alias("fallback_used"), value.isNotNull().alias("raw_parse_success"), F.when(value.isNull(), 1).otherwise(0).cast("bigint").alias("raw_num_parse_failures"),
    ).cast(RESULT_TYPE)


#: Strategies by name: (texts, rubric, strict=...) -> result.
STRATEGIES: dict[str, Callable[..., Column]] = {"explicit_joint": explicit_joint, "explicit_per_criterion": explicit_per_criterion, "implicit": implicit}


def compute_score(texts: Column, rubric: Column, split: Column, strategy: str | Callable[..., Column] = "explicit_joint", score_test: bool = False, **options) -> Column:
    """Reward result by a strategy's name or a function of one's own. The test split earns 0 unless asked for; so do
    rows without a rubric and rows without any judge's text."""
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {sorted(STRATEGIES)} or a function")
    made = (STRATEGIES[strategy] if isinstance(strategy, str) else strategy)(texts, rubric, **options)
    empty = F.array().cast(rubric_type())
    out = F.when(F.coalesce(F.size(rubric), F.lit(0)) <= 0, zero_result(empty, "no_rubric")).when(F.coalesce(F.size(texts), F.lit(0)) <= 0, zero_result(rubric, "no_judge_text")).otherwise(made)
    gated = F.coalesce(split == "test", F.lit(False)) & F.lit(not score_test)
    return F.when(gated, zero_result(empty, "test_split")).otherwise(out)


def rubric_type() -> str:
    return "array<struct<title:string,description:string,weight:double>>"


def stub_judge(prompt: str) -> str:
    """A judge without a model: an answer that depends on the prompt only, in the form that it asks for."""
    rules = max(1, prompt.count("\n1. ") and sum(1 for line in prompt.split("\n") if line.split(". ", 1)[0].isdigit()))
    return "\n".join(f"Rule {k}: stated. Verdict: {'Yes' if (len(prompt) + k) % 2 else 'No'}" for k in range(1, rules + 1))


def call_judge(rows: DataFrame, prompt: str, judge: Callable[[str], str] = stub_judge, answer: str = "answer", workers: int = 8, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """rows with the judge's answer to a column's prompts: so many calls at a time in each task, each tried again after a
    growing pause; what fails every time is an empty answer. Order and number of rows stay."""
    shape = rows.schema.simpleString()

    def once(text: str | None) -> str:
        for k in range(1, attempts + 1):
            try:
                return judge(text or "") or ""
            except Exception:  # noqa: BLE001 - a judge may fail in any way; the row must not
                if k < attempts and wait:
                    time.sleep(back_off(k, wait))
        return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                yield batch.assign(**{answer: list(pool.map(once, batch[prompt].tolist()))})

    return rows.mapInPandas(run, f"{shape[7:-1]},{answer}:string")


def choice_log_probability(tokens: Column, mean: bool = False) -> Column:
    """Log probability of each spelling of a choice from those of its tokens (array of arrays): their sum or mean."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.transform(tokens, lambda xs: total(xs) / F.greatest(F.size(xs), F.lit(1)) if mean else total(xs))
