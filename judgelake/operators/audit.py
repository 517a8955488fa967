"""Audits: verdicts of human readers beside those of a judge, from wide sheets to agreement.

A sheet has one row per item with columns of each rule; a key has the judge's verdict, the weight and the kind of each
rule. Rows of the key count whether or not the sheet has them; what the sheet lacks is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions.num import pearson_or_null
from judgelake.functions.text import trimmed


#: Spellings of a reader who can't decide.
UNSURE = ("unsure", "not sure", "not_sure", "tie", "unknown", "?")


def label(x: Column) -> Column:
    """Yes, No, Unsure or, for anything else, an empty string."""
    plain = F.lower(trimmed(F.coalesce(x.cast("string"), F.lit(""))))
    return F.when(plain.isin("yes", "y", "1", "true"), "Yes").when(plain.isin("no", "n", "0", "false"), "No").when(plain.isin(*UNSURE), "Unsure").otherwise("")


def to_criteria(wide: DataFrame, keys: list[str], rules: int, fields: dict[str, str]) -> DataFrame:
    """One row per item and rule; fields: name -> column pattern with {} for the rule's number. Absent columns are null."""
    known = set(wide.columns)
    each = lambda k: F.struct(F.lit(k).cast("bigint").alias("rule"), *[(F.col(p.format(k)) if p.format(k) in known else F.lit(None)).cast("string").alias(n) for n, p in fields.items()])
    return wide.select(*keys, F.inline(F.array(*[each(k) for k in range(1, rules + 1)])))


def to_wide(criteria: DataFrame, keys: list[str], rules: int, fields: dict[str, str]) -> DataFrame:
    """The reverse of to_criteria: one row per item, one column per field and rule."""
    cell = lambda n, k: F.max(F.when(F.col("rule") == k, F.col(n))).alias(fields[n].format(k))
    return criteria.groupBy(*keys).agg(*[cell(n, k) for k in range(1, rules + 1) for n in fields])


def joined(key: DataFrame, sheet: DataFrame, item: str = "item_id", pair: str = "pair_id", rules: int = 6) -> DataFrame:
    """(item, pair, rule, judge, human, weight) of every rule of the key; the last row of an item in the sheet counts."""
    judged = to_criteria(key, [item, pair], rules, {"judge": "gpt_rule_{}", "weight": "rule_{}_weight"})
    told = to_criteria(sheet, [item], rules, {"human": "human_rule_{}"}).groupBy(item, "rule").agg(F.max(label(F.col("human"))).alias("human"))
    rows = judged.join(told, [item, "rule"], "left")
    weight = F.coalesce(F.nullif(trimmed(F.col("weight")), F.lit("")).try_cast("double"), F.lit(1.0))
    return rows.select(F.col(item).alias("item"), F.col(pair).alias("pair"), "rule", label(F.col("judge")).alias("judge"), F.coalesce("human", F.lit("")).alias("human"), weight.alias("weight"))


def agreement(rows: DataFrame) -> DataFrame:
    """By rule and, with a null rule, in all: compared, missing and unsure criteria, agreement plain and weighted, and
    the four cells of judge and human. Agreement of nothing is null."""
    read = F.col("human").isin("Yes", "No")
    same = read & (F.col("human") == F.col("judge"))
    sums = rows.groupingSets([[], ["rule"]], "rule").agg(
        F.count_if(read).alias("compared"), F.count_if(F.col("human") == "").alias("missing"), F.count_if(F.col("human") == "Unsure").alias("unsure"), F.count_if(same).alias("same"),
        F.sum(F.when(read, F.col("weight")).otherwise(0.0)).alias("w"), F.sum(F.when(same, F.col("weight")).otherwise(0.0)).alias("ws"),
        *[F.count_if((F.col("judge") == j) & (F.col("human") == h)).alias(f"{j}_{h}".lower()) for j in ("Yes", "No") for h in ("Yes", "No")],
    )
    return sums.select(
        "rule", "compared", "missing", "unsure", F.try_divide("same", "compared").alias("agreement"), F.try_divide("ws", "w").alias("weighted_agreement"), "yes_yes", "yes_no", "no_yes", "no_no"
    )


def items(rows: DataFrame) -> DataFrame:
    """Scores of each item by judge and human, and whether the human read all of its rules."""
    yes = lambda c: F.sum(F.when(F.col(c) == "Yes", F.col("weight")).otherwise(0.0))
    out = rows.groupBy("item", "pair").agg(
        F.bool_and(F.col("human").isin("Yes", "No")).alias("complete"), yes("judge").alias("judge_score"), yes("human").alias("human_score"), F.sum("weight").alias("most")
    )
    return out.withColumns({f"{c}_norm": F.try_divide(f"{c}_score", "most") for c in ("judge", "human")})


def scores(item_rows: DataFrame) -> DataFrame:
    """Over complete items: mean distance and correlation of the normalised scores; null where undefined."""
    done = item_rows.filter("complete")
    return done.agg(
        F.count(F.lit(1)).alias("items_complete"), F.avg(F.abs(F.col("human_norm") - F.col("judge_norm"))).alias("score_mae_norm"), pearson_or_null(F.col("human_norm"), F.col("judge_norm")).alias("score_pearson_norm")
    )


def preferences(item_rows: DataFrame, *by: str) -> DataFrame:
    """Pairs of exactly two complete items: compared pairs (neither side tied), agreeing ones, ties of the human.

    A pair is reduced to its count and its first and last item, so that no list of a pair's items is ever made.
    """
    one = F.struct("item", "judge_score", "human_score")
    pairs = item_rows.filter("complete").groupBy(*by, "pair").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("a"), F.max(one).alias("b")).filter("n = 2")
    side = lambda c: F.signum(F.col(f"a.{c}_score") - F.col(f"b.{c}_score"))
    told = (side("judge") != 0) & (side("human") != 0)
    sums = [F.count_if(told).alias("pairs"), F.count_if(told & (side("judge") == side("human"))).alias("agree"), F.count_if(side("human") == 0).alias("human_ties"), F.count_if(side("judge") == 0).alias("judge_ties")]
    return pairs.groupBy(*by).agg(*sums) if by else pairs.agg(*sums)
