"""From nested records to one row per sample, candidate or criterion decision, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions.text import kind

HARD, SOFT = 3, 1


def rule_weights(rubric: Column) -> Column:
    return F.transform(rubric, lambda r: F.when(r["type"] == "hard", HARD).otherwise(SOFT))


def gold_verdicts(rubric: Column, grade: Column) -> Column:
    """Verdict of each rule in the rubric's order: the last grade of a rule counts, none is a no."""
    last = lambda rule: F.try_element_at(F.filter(grade, lambda g: g["rule_id"].cast("string") == rule), F.lit(-1))
    name = lambda r, i: F.coalesce(r["rule_id"], (i + 1).cast("string"))
    yes = lambda v: F.coalesce(F.lower(F.trim(v)) == "yes", F.lit(False))
    return F.transform(rubric, lambda r, i: F.when(yes(last(name(r, i))["verdict"]), 1).otherwise(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def flatten_samples(bench: DataFrame, texts: bool = True) -> DataFrame:
    """One row per answer of each question with a rubric, with model and response if texts are asked for. A stored total
    wins over the computed one."""
    rows = bench.filter(F.coalesce(F.size("refined_rubric"), F.lit(0)) > 0).select("record_id", "question_id", "refined_rubric", F.posexplode("answers").alias("pos", "a"))
    answer = F.coalesce(F.col("a.answer_id"), F.lit(-1).cast("bigint"))
    rows = rows.filter(F.col("a").isNotNull()).select(
        "record_id", "question_id", answer.alias("answer_id"), F.col("pos").cast("bigint").alias("pos"),
        F.concat_ws("_", F.coalesce("question_id", F.lit("")), answer.cast("string")).alias("sample_id"),
        *([F.col("a.model").alias("model"), F.col("a.answer_text").alias("response")] if texts else []), "refined_rubric",
        F.size("refined_rubric").cast("bigint").alias("num_rules"), rule_weights(F.col("refined_rubric")).alias("rule_weights"),
        gold_verdicts(F.col("refined_rubric"), F.coalesce("a.grade", F.expr("array()"))).alias("gold_verdicts"), F.col("a.total_score").alias("stored"),
    )
    computed = dot(F.col("gold_verdicts"), F.col("rule_weights"))
    return rows.withColumn("computed_total", computed).withColumn("gold_total_score", F.coalesce("stored", computed)).drop("stored")


def criterion_items(samples: DataFrame) -> DataFrame:
    """One row per sample and rule."""
    each = F.arrays_zip(F.col("refined_rubric"), F.col("rule_weights"), F.col("gold_verdicts"))
    return samples.select("record_id", "pos", "sample_id", F.posexplode(each).alias("rule_index", "x")).select(
        "record_id", "pos", "sample_id", F.col("rule_index").cast("bigint").alias("rule_index"), F.col("x.refined_rubric.rule_id").alias("rule_id"),
        F.col("x.refined_rubric.type").alias("rule_type"), F.col("x.rule_weights").cast("bigint").alias("weight"), F.col("x.gold_verdicts").cast("bigint").alias("gold"),
    )


def candidates(bank: DataFrame, *extra: str, allowed: list[str] | None = None) -> DataFrame:
    """One row per candidate that isn't null, with its place; only those of the allowed ids if any are given."""
    rows = bank.select("record_id", "question_id", *extra, F.posexplode("candidates").alias("cand_pos", "c"))
    rows = rows.filter(F.col("c").isNotNull()).withColumn("cand_pos", F.col("cand_pos").cast("bigint"))
    return rows if allowed is None else rows.filter(F.col("c.candidate_id").isin(allowed))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row of each key in an order; unlike a plain distinct it says which row stays.

    An aggregate rather than a window: rows of a hot key are reduced before they are shuffled. Null keys are a key.
    """
    others = [c for c in rows.columns if c not in keys]
    best = (F.max_by if last else F.min_by)(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def keyed_candidates(bank: DataFrame, *extra: str) -> DataFrame:
    """One row per record and candidate id; of repeated ids the last counts. Null ids name nothing.

    Repeats stand in one array, so they are dropped there, before rows are made: nothing is shuffled.
    """
    backward = F.reverse(F.transform("candidates", lambda c: c["candidate_id"]))
    last = lambda c, i: F.array_position(backward, c["candidate_id"]) == F.size("candidates") - i
    each = F.transform("candidates", lambda c, i: F.struct(i.cast("bigint").alias("cand_pos"), c.alias("c"), F.coalesce(last(c, i), F.lit(False)).alias("last")))
    rows = bank.select("record_id", "question_id", *extra, F.inline(F.filter(each, lambda x: x["last"])))
    return rows.select("record_id", "question_id", *extra, "cand_pos", "c", F.col("c.candidate_id").alias("candidate_id"))


def parse_clean(result: Column, rubric: Column) -> Column:
    """Labels can be trusted: no failures, one score for each rule, at least one, none null."""
    scores = result["criterion_scores"]
    return F.coalesce(
        (F.coalesce(result["num_parse_failures"], F.lit(0)) == 0) & (F.size(scores) == F.size(rubric)) & (F.size(scores) > 0) & ~F.exists(scores, lambda s: s.isNull()),
        F.lit(False),
    )


def bank_items(bank: DataFrame, allowed: list[str] | None = None, labelled: bool = True) -> DataFrame:
    """One row per criterion decision: kind and weight (null or absent is 1) of the criterion, label by 0.5.

    Labelled rows come from candidates with clean labels only; otherwise every candidate counts and every label is 0.
    """
    rows = keyed_candidates(bank, "rubric")
    if allowed is not None:
        rows = rows.filter(F.col("candidate_id").isin(allowed))
    rows = rows.filter(parse_clean(F.col("c.reward_result"), F.col("rubric")) if labelled else F.size("rubric") > 0)
    scores = F.col("c.reward_result.criterion_scores") if labelled else F.transform("rubric", lambda r: F.lit(0.0))
    each = F.arrays_zip(F.col("rubric"), scores.alias("s"))
    return rows.select("record_id", "candidate_id", F.posexplode(each).alias("rule_index", "x")).select(
        "record_id", "candidate_id", F.col("rule_index").cast("bigint").alias("rule_index"), F.col("x.rubric.title").alias("title"),
        kind(F.col("x.rubric.title"), F.col("x.rubric.description")).alias("kind"),
        F.coalesce("x.rubric.weight", F.lit(1.0)).alias("weight"), F.when(F.col("x.s") >= 0.5, 1).otherwise(0).cast("bigint").alias("label"),
    )


def rubric_groups(bank: DataFrame, size: int) -> DataFrame:
    """Contiguous slices of each rubric with at most size rules; an error for a size below 1."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    starts = F.sequence(F.lit(0), F.size("rubric") - 1, F.lit(size))
    rows = bank.filter(F.size("rubric") > 0).select("record_id", "rubric", F.posexplode(starts).alias("group_index", "start"))
    return rows.select(
        "record_id", F.col("group_index").cast("bigint").alias("group_index"), F.col("start").cast("bigint").alias("group_start"),
        F.least(F.col("start") + size, F.size("rubric")).cast("bigint").alias("group_end"), F.slice("rubric", F.col("start") + 1, size).alias("rules"),
    )


def regroup(parts: DataFrame) -> DataFrame:
    """Slices (record_id, cand_pos, group_start, size, vector, ok, text, n, rubric) put together by offset: gaps are 0, a
    sample is parsed if all its slices are, failures are the rules of unparsed slices, texts are joined by blank lines."""
    one = F.struct("group_start", "vector", "ok", "text")
    rows = parts.groupBy("record_id", "cand_pos").agg(
        F.sort_array(F.collect_list(one)).alias("g"), F.max("n").alias("n"), F.bool_and("ok").alias("parsed"), F.any_value("rubric").alias("rubric"),
        F.sum(F.when(F.col("ok"), 0).otherwise(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))).alias("failures"),
    )
    holds = lambda g, i: (g["group_start"] <= i) & (i < g["group_start"] + F.size(g["vector"]))
    value = lambda i: F.try_element_at(F.filter("g", lambda g: F.coalesce(holds(g, i), F.lit(False))), F.lit(-1))
    made = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.coalesce(F.get(value(i)["vector"], (i - value(i)["group_start"]).cast("int")), F.lit(0)))
    return rows.select(
        "record_id", "cand_pos", "parsed", "failures", "rubric", F.when(F.col("n") > 0, made).alias("vector"),
        F.array_join(F.filter(F.col("g")["text"], lambda t: t.isNotNull()), "\n\n").alias("raw_text"),
    )


def wide_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Criterion rows put back to one row per sample: labels in the rules' order and the sum of weights met."""
    rows = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rule_index", "label", "weight"))).alias("xs"))
    met = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["label"] * F.abs(x["weight"]))
    return rows.select(*keys, F.col("xs")["label"].alias("labels"), met.alias("met"))


def tagged_rubric(rubric: Column, prefix: str = "axis:") -> Column:
    """Criteria of the form criterion, points, tags as title, description, weight; the title is the first tagged axis."""
    axis = lambda r: F.try_element_at(F.filter(r["tags"], lambda t: t.startswith(prefix)), F.lit(1))
    title = lambda r: F.coalesce(F.substring(axis(r), len(prefix) + 1, 1000), F.lit("criterion"))
    return F.transform(rubric, lambda r: F.struct(title(r).alias("title"), r["criterion"].alias("description"), F.coalesce(r["points"], F.lit(1)).cast("double").alias("weight")))


def spec_coverage(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Each way of answering with the candidates that bear its id and those of them whose settings differ from it."""
    name = lambda c: F.lower(F.trim(c))
    told = specs.select(name("candidate_id").alias("k"), "candidate_id", "model_name", "generation_mode", "temperature", "top_p")
    same = F.lit(True)
    for c in ("model_name", "generation_mode", "temperature", "top_p"):
        same &= F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}"))
    met = rows.select(name("c.candidate_id").alias("k"), "c").join(told.alias("s"), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("different"))
    return told.join(met, "k", "left").select("candidate_id", F.coalesce("n", F.lit(0)).alias("candidates"), F.coalesce("different", F.lit(0)).alias("different"))
