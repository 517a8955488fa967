"""Splits and samples of ids.

The order of ids comes from a hash of seed and id, so that any engine gives the same one; positions come from one
global sort of the distinct ids (two of its columns only). The exact mode repeats the seeded shuffle of a standard
library on a list of ids that the caller declares small.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from judgelake.operators.flatten import first_of_each
from judgelake.operators.validate import not_covered, require_none, splits_disjoint


def hashed_order(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, rank, n): 0-based place of each distinct id in the hashed order, and how many there are."""
    named = ids.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
    hashed = named.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256))
    # Ranks by bucket of the hash: counts of 4096 buckets give each its first rank, a window sorts within a bucket.
    bucketed = hashed.withColumn("b", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    first = sizes.select("b", (F.sum("m").over(W.orderBy("b")) - F.col("m")).alias("base"), F.sum("m").over(W.partitionBy()).alias("n"))
    place = F.row_number().over(W.partitionBy("b").orderBy("h", key)) - 1
    return bucketed.join(first, "b").select(key, (F.col("base") + place).alias("rank"), "n")


def exact_order(ids: list[str], seed: int) -> list[str]:
    """The ids in the order of a seeded standard shuffle of their positions."""
    places = list(range(len(ids)))
    random.Random(seed).shuffle(places)
    return [ids[p] for p in places]


def exact_fraction_split(ids: list[str], fractions: dict[str, float], seed: int) -> dict[str, list[str]]:
    """Cut the shuffled positions at half-even rounded sizes; the last split takes the rest; the input's order stays."""
    places = list(range(len(ids)))
    random.Random(seed).shuffle(places)
    names, start, out = list(fractions), 0, {}
    for i, name in enumerate(names):
        end = len(ids) if i == len(names) - 1 else min(len(ids), start + round(len(ids) * fractions[name]))
        out[name] = [ids[p] for p in sorted(places[start:end])]
        start = end
    return out


def _roles(ranked: DataFrame, cuts: list[tuple[str, Column]]) -> Column:
    role = F.lit(None).cast("string")
    for name, end in reversed(cuts):
        role = F.when(F.col("rank") < end, name).otherwise(role)
    return role


def fraction_split(ids: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, split): half-even rounded sizes of each fraction in turn, the last split takes the rest."""
    ranked = hashed_order(ids, key, seed)
    names, end, cuts = list(fractions), F.lit(0), []
    for name in names[:-1]:
        end = end + F.bround(F.col("n") * fractions[name]).cast("bigint")
        cuts.append((name, end))
    return ranked.select(key, _roles(ranked, [*cuts, (names[-1], F.col("n"))]).alias("split"))


def count_split(ids: DataFrame, key: str, counts: dict[str, int], rest: str, seed: int = 42) -> DataFrame:
    """(key, split): so many ids for each split in turn, the rest for the last."""
    ranked = hashed_order(ids, key, seed)
    end, cuts = 0, []
    for name, size in counts.items():
        end += size
        cuts.append((name, F.lit(end)))
    return ranked.select(key, _roles(ranked, [*cuts, (rest, F.col("n"))]).alias("split"))


def ratio_split(ids: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """(key, split): max(1, floor(n * ratio)) ids for evaluation, the rest for training."""
    ranked = hashed_order(ids, key, seed)
    size = F.greatest(F.lit(1), F.floor(F.col("n") * ratio))
    return ranked.select(key, F.when(F.col("rank") < size, "eval").otherwise("train").alias("split"))


def nested_split(ids: DataFrame, key: str, train_sizes: list[int], dev: int, heldout: int, seed: int = 42) -> DataFrame:
    """(key, train_size, split): shared dev and heldout ids, training sets that are prefixes of one another."""
    ranked = hashed_order(ids, key, seed).withColumn("train_size", F.explode(F.array(*[F.lit(s) for s in train_sizes])))
    place = F.col("rank") - (dev + heldout)
    split = F.when(F.col("rank") < dev, "dev").when(F.col("rank") < dev + heldout, "heldout").when(place < F.col("train_size"), "train")
    return ranked.select(key, F.col("train_size").cast("bigint").alias("train_size"), split.alias("split")).filter("split is not null")


def sample_pairs(samples: DataFrame, n: int, seed: int = 20260524) -> DataFrame:
    """n questions that have two answers of different total, each with one such pair; all by hashed order.

    The pair is the answer first in the hashed order and the first one after it with another total.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id")), 256)
    # First of each total, then the two first totals: a hot question comes down to its distinct totals before it is one row.
    firsts = samples.groupBy("question_id", "gold_total_score").agg(F.min(F.struct(h.alias("h"), "sample_id")).alias("x"))
    ordered = firsts.groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("x.h", "x.sample_id", "gold_total_score"))), 1, 2).alias("xs"))
    first, other = F.get("xs", F.lit(0)), F.get("xs", F.lit(1))
    drawn = ordered.select("question_id", first.alias("a"), other.alias("b")).filter("b is not null")
    ranked = drawn.join(hashed_order(drawn, "question_id", seed).filter(F.col("rank") < n), "question_id")
    return ranked.select(
        F.format_string("P%03d", F.col("rank") + 1).alias("pair_id"), "question_id", F.col("a.sample_id").alias("first_sample"), F.col("b.sample_id").alias("second_sample"),
    )


def exact_split(ids: DataFrame, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """(key, split) of given sizes, which must sum to the number of distinct ids; an error otherwise."""
    n = ids.filter(F.col(key).isNotNull()).select(key).distinct().count()
    if sum(sizes.values()) != n:
        raise ValueError(f"sizes sum to {sum(sizes.values())}, but there are {n} ids")
    names = list(sizes)
    return count_split(ids, key, {k: sizes[k] for k in names[:-1]}, names[-1], seed)


def role_split(rows: DataFrame, key: str, order: list[str], dev: int, test: int, seed: int = 42) -> DataFrame:
    """The first row of each id, with a column split_role, for dev and test ids of fixed numbers; other ids are left
    out. An error if there are too few ids."""
    ranked = hashed_order(rows, key, seed)
    n = ranked.agg(F.max("n")).first()[0] or 0
    if n < dev + test:
        raise ValueError(f"{dev + test} ids needed, {n} found")
    role = F.when(F.col("rank") < dev, "dev").when(F.col("rank") < dev + test, "test")
    picked = ranked.select(F.col(key).alias("_key"), role.alias("split_role")).filter("split_role is not null")
    single = first_of_each(rows.filter(F.col(key).isNotNull()).drop("split_role"), [key], order)
    return single.join(picked, single[key].cast("string") == F.col("_key")).drop("_key")


def split_from_ids(rows: DataFrame, key: str, parts: dict[str, DataFrame], cover: bool = False) -> DataFrame:
    """rows with the split that their id is listed in; parts: split -> ids (one column). Ids listed in two splits are
    an error, and, if the parts must cover all, so are ids that only one side has."""
    listed = None
    for name, ids in parts.items():
        one = ids.select(F.col(ids.columns[0]).cast("string").alias("_id"), F.lit(name).alias("split")).filter("_id is not null").distinct()
        listed = one if listed is None else listed.unionByName(one)
    if listed is None or listed.limit(1).count() == 0:
        raise ValueError("no split ids")
    require_none(splits_disjoint(listed, "_id", "split"))
    if cover:
        require_none(not_covered(listed.select(F.col("_id").alias("id")), rows.select(F.col(key).cast("string").alias("id")), "id"))
    return rows.drop("split").join(listed, rows[key].cast("string") == F.col("_id")).drop("_id")


def manifest_parts(spark: SparkSession, manifest: dict, train_size: int) -> dict[str, DataFrame]:
    """Parts for split_from_ids of a manifest's split of one training size; an error where it has none."""
    split = (manifest.get("splits") or {}).get(str(train_size))
    if split is None:
        raise ValueError(f"no split of training size {train_size} in the manifest")
    return {name: spark.createDataFrame([(str(x),) for x in split.get(f"{name}_question_ids", [])], "id string") for name in ("train", "dev", "heldout")}


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of n ids, first by hashed order."""
    return rows.join(hashed_order(rows, key, seed).filter(F.col("rank") < n).select(F.col(key).alias("_key")), rows[key].cast("string") == F.col("_key"), "left_semi")


def first_rows(rows: DataFrame, order: list[str], n: int, holds: Column | None = None) -> DataFrame:
    """The first n rows in an order, of those that meet a condition if one is given."""
    return (rows if holds is None else rows.filter(holds)).orderBy(*order).limit(n)


def shuffled_rows(rows: DataFrame, key: str, n: int, holds: Column, seed: int = 42) -> DataFrame:
    """n rows that meet a condition, in the hashed order of their id."""
    return rows.filter(holds).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def by_number(rows: DataFrame, key: str) -> DataFrame:
    """Rows in the order of their ids as whole numbers; an id that is none is an error."""
    number = F.col(key).try_cast("bigint")
    checked = F.when(F.col(key).isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a whole number: "), F.col(key).cast("string"))).cast("bigint")).otherwise(number)
    return rows.withColumn("_number", checked).orderBy("_number").drop("_number")


def distinct_in_order(values: Column) -> Column:
    """An array without repeats, each value where it first stood."""
    return F.array_distinct(values)
