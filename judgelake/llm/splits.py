"""Splits that keep related records together.

Records are tied by equal question ids or candidate ids (:func:`tie_keys`, :func:`tied_groups`). Whole groups go to
splits by component swap search (:func:`assign_splits`): a hashed assignment is improved by annealing, in which
single components move or two exchange their splits if that lowers the deviation of sizes and label counts from the
wanted shares; several annealings run in parallel from different seeds and the best stays.

Components with more than 1/HEAVY of all records are at most HEAVY in number, so they are annealed together first;
all others are spread by hash over shards of bounded size, each annealed by a task of its own against its part of
what the heavy ones leave over. Nothing about all records or components reaches the driver.

Defined results: null and blank ids tie nothing; records without a group of others are components of their own; a
null label counts as a label of its own; empty tables give empty results; repeated record ids are one record; ids
in columns of clashing names are taken from the columns named in the call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.components import contract, stars
from judgelake.runtime import Stage

HEAVY = 2048
SHARD_COMPONENTS = 4000
REPLICAS = 4
#: Labels balanced each by itself; those beyond the commonest are balanced together.
LABELS = 64


def canonical_id(raw: Column, prefix: str) -> Column:
    """One spelling of an id: case, blanks, joining and leading marks, a leading prefix and the number format don't count.

    A plain number loses sign, grouping, leading zeros and a zero fraction. Null where nothing is left.
    """
    plain = F.lower(F.translate(raw, "０１２３４５６７８９", "0123456789"))
    plain = F.regexp_replace(plain, r"(?U)[\s\p{Cc}\p{Cf}]+", "")
    plain = F.regexp_replace(plain, rf"^[^\p{{L}}\p{{N}}]*(?:{prefix})?[^\p{{L}}\p{{N}}]*(?=.)", "")
    number = F.regexp_replace(F.regexp_replace(plain, r"[,_']", ""), r"\.0*$", "")
    plain = F.when(number.rlike(r"^\d+$"), F.regexp_replace(number, r"^0+(?=\d)", "")).otherwise(
        F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")
    )
    return F.when(plain != "", plain)


def tie_keys(bank: DataFrame, specs: DataFrame, record_id: str = "record_id") -> DataFrame:
    """(node, key) for each key a record holds: its question id and its candidates' ids, without those of specs."""
    question = canonical_id(F.col("question_id"), "q")
    keys = F.concat(
        F.array(F.concat(F.lit("q:"), question)),
        F.coalesce(
            F.transform("candidates", lambda c: F.concat(F.lit("c:"), canonical_id(c["candidate_id"], "resp"))),
            F.array().cast("array<string>"),
        ),
    )
    rows = bank.filter(F.col(record_id).isNotNull()).select(
        F.col(record_id).cast("bigint").alias("node"), F.explode(F.array_distinct(F.array_compact(keys))).alias("key")
    )
    common = specs.select(F.concat(F.lit("c:"), canonical_id(F.col("candidate_id"), "resp")).alias("key")).filter("key is not null").distinct()
    return rows.join(common, "key", "left_anti")


def tied_groups(bank: DataFrame, specs: DataFrame, record_id: str = "record_id") -> DataFrame:
    """(record_id, group_id) of every record tied to another one; group_id is the smallest record id of the group."""
    groups = contract(stars(tie_keys(bank, specs, record_id)), Stage(bank.sparkSession))
    return groups.select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))


def anneal(sizes: np.ndarray, labels: np.ndarray, want: np.ndarray, want_labels: np.ndarray, start: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Component swap search over one shard.

    sizes[c], labels[c, l]: records of a component, in all and by label; want[s], want_labels[s, l]: records wanted in
    each split. Returns the best assignment met and its cost, the squared deviation of sizes and of label counts.
    """
    rng = np.random.default_rng(seed)
    n, splits = len(sizes), len(want)
    scale = max(float(sizes.sum()), 1.0)
    at = start.copy()
    off = -want.astype(float)
    off_labels = -want_labels.astype(float)
    np.add.at(off, at, sizes)
    np.add.at(off_labels, at, labels)

    def cost() -> float:
        return float((off**2).sum() + (off_labels**2).sum())

    now = cost()
    best, least = at.copy(), now
    if n < 1 or splits < 2:
        return best, least
    hot = max(now / max(n, 1), 1e-9)
    picks = rng.integers(0, n, size=(steps, 2))
    turns = rng.integers(1, splits, size=steps)
    swap = rng.random(steps) < 0.5
    luck = -np.log(rng.random(steps) + 1e-300)
    for k in range(steps):
        a, b = picks[k]
        s = at[a]
        if swap[k]:
            t = at[b]
            if s == t:
                continue
            d, dl = sizes[a] - sizes[b], labels[a] - labels[b]
        else:
            t = (s + turns[k]) % splits
            d, dl = sizes[a], labels[a]
        delta = 2 * d * (off[t] - off[s] + d) + 2 * float((dl * (off_labels[t] - off_labels[s] + dl)).sum())
        if delta <= hot * (1 - k / steps) ** 2 * luck[k]:
            off[s] -= d
            off[t] += d
            off_labels[s] -= dl
            off_labels[t] += dl
            at[a] = t
            if swap[k]:
                at[b] = s
            now += delta
            if now < least - 1e-9 * scale:
                best, least = at.copy(), now
    return best, least


def _search(part: pd.DataFrame, want: np.ndarray, want_labels: np.ndarray, names: list[str], start: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    sizes = part["size"].to_numpy(dtype=float)
    labels = np.vstack([np.asarray(x, dtype=float) for x in part["labels"]]) if len(part) else np.zeros((0, want_labels.shape[1]))
    return anneal(sizes, labels, want, want_labels, start, seed, min(200_000, 2_000 + 12 * len(part)))


def assign_splits(bank: DataFrame, specs: DataFrame, plan: DataFrame, label: str = "data_source", record_id: str = "record_id", seed: int = 17, heavy: int = HEAVY, shard: int = SHARD_COMPONENTS, replicas: int = REPLICAS, labels: int = LABELS) -> DataFrame:
    """(record_id, component_id, split_role) of every record, in the shares of plan (split_role, share)."""
    spark = bank.sparkSession
    stage = Stage(spark)
    rows = plan.filter("share > 0").groupBy("split_role").agg(F.sum("share").alias("share")).orderBy("split_role").collect()  # a few splits
    if not rows:
        raise ValueError("the plan has no split with a share")
    names, shares = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    shares = shares / shares.sum()
    records = bank.filter(F.col(record_id).isNotNull()).groupBy(F.col(record_id).cast("bigint").alias("record_id")).agg(F.min(label).alias("label"))
    groups = tied_groups(bank, specs, record_id)
    records = stage.keep(records.join(groups, "record_id", "left").select("record_id", F.coalesce("group_id", "record_id").alias("component_id"), "label"))
    known = [r[0] for r in records.groupBy("label").count().orderBy(F.desc("count"), "label").limit(labels).collect()]
    of = {x: i for i, x in enumerate(known)}
    place = F.coalesce(*[F.when(F.col("label").eqNullSafe(F.lit(x)), F.lit(i)) for x, i in of.items()], F.lit(len(known)))
    width = len(known) + 1
    components = stage.keep(
        records.groupBy("component_id").agg(
            F.count(F.lit(1)).alias("size"), F.array(*[F.count_if(place == i) for i in range(width)]).alias("labels")
        )
    )
    totals = components.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c"), *[F.sum(F.col("labels")[i]).alias(f"l{i}") for i in range(width)]).first()
    total, count = totals["n"] or 0, totals["c"] or 0
    label_totals = np.array([totals[f"l{i}"] or 0 for i in range(width)], dtype=float)
    big = components.filter(F.col("size") * heavy > total).orderBy("component_id").toPandas()  # at most `heavy` rows
    want, want_labels = shares * total, shares[:, None] * label_totals[None, :]
    heaviest = spark.sparkContext.broadcast(big)

    def anneal_heavy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                part = heaviest.value
                start = np.random.default_rng([seed, k]).choice(len(names), size=len(part), p=shares)
                at, value = _search(part, want, want_labels, names, start, seed + k)
                yield pd.DataFrame({"replica": [k], "cost": [value], "at": [at.tolist()]})

    tries = spark.range(replicas, numPartitions=replicas).mapInPandas(anneal_heavy, "replica bigint, cost double, at array<bigint>")
    at = tries.agg(F.min_by("at", F.struct("cost", "replica"))).first()[0]
    left, left_labels = want.copy(), want_labels.copy()
    for c, s in enumerate(at):
        left[s] -= big["size"].iloc[c]
        left_labels[s] -= np.asarray(big["labels"].iloc[c], dtype=float)
    fixed = spark.createDataFrame([(int(c), names[s]) for c, s in zip(big["component_id"], at, strict=True)], "component_id bigint, split_role string")
    light = components.filter(F.col("size") * heavy <= total)
    shards = max(1, -(-(count - len(big)) // shard))
    ratio, ratio_labels = np.maximum(left, 0), np.maximum(left_labels, 0)
    ratio = ratio / ratio.sum() if ratio.sum() > 0 else shares
    sums = ratio_labels.sum(axis=0)
    ratio_labels = np.where(sums > 0, ratio_labels / np.maximum(sums, 1e-12), ratio[:, None])

    def improve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("component_id")
        own = float(part["size"].sum())
        own_labels = np.sum(np.vstack([np.asarray(x, dtype=float) for x in part["labels"]]), axis=0)
        picked = np.random.default_rng([seed, *map(int, key)]).choice(len(names), size=len(part), p=ratio)
        found, value = _search(part, ratio * own, ratio_labels * own_labels[None, :], names, picked, seed + int(key[1]))
        return pd.DataFrame({"shard": key[0], "replica": key[1], "cost": value, "component_id": part["component_id"], "split_role": [names[s] for s in found]})

    spread = light.withColumn("shard", F.pmod(F.xxhash64("component_id", F.lit(seed)), F.lit(shards)).cast("int"))
    copies = spread.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    tried = stage.keep(copies.groupBy("shard", "replica").applyInPandas(improve, "shard int, replica int, cost double, component_id bigint, split_role string"))
    best = tried.groupBy("shard").agg(F.min_by("replica", F.struct("cost", "replica")).alias("replica"))
    chosen = tried.join(best, ["shard", "replica"], "left_semi").select("component_id", "split_role").unionByName(fixed)
    return records.join(chosen, "component_id").select("record_id", "component_id", "split_role")


def split_balance(bank: DataFrame, specs: DataFrame, plan: DataFrame, label: str = "data_source", record_id: str = "record_id") -> DataFrame:
    """Of each split and label: wanted records, records it has, and records it would have by hash of the component alone."""
    stage = Stage(bank.sparkSession)
    assigned = stage.keep(assign_splits(bank, specs, plan, label, record_id))
    records = bank.filter(F.col(record_id).isNotNull()).groupBy(F.col(record_id).cast("bigint").alias("record_id")).agg(F.min(label).alias("label"))
    shares = plan.filter("share > 0").groupBy("split_role").agg(F.sum("share").alias("share"))
    rows = shares.orderBy("split_role").collect()  # a few splits
    total, luck = sum(r["share"] for r in rows), F.pmod(F.xxhash64("component_id", F.lit("start")), F.lit(1 << 30)) / (1 << 30)
    hashed, sum_ = F.lit(rows[-1]["split_role"]), total
    for r in reversed(rows):
        hashed = F.when(luck < sum_ / total, r["split_role"]).otherwise(hashed)
        sum_ -= r["share"]
    both = assigned.join(records, "record_id").withColumn("hashed", hashed)
    counted = lambda c, name: both.groupBy("label", F.col(c).alias("split_role")).agg(F.count(F.lit(1)).alias(name))
    labels = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r["split_role"]).alias("split_role"), F.lit(r["share"] / total).alias("share")) for r in rows])).alias("s")
    out = labels.select("label", "n", each).select("label", "s.split_role", (F.col("n") * F.col("s.share")).alias("wanted"))
    for name, column in (("records", "split_role"), ("hashed_records", "hashed")):
        c = counted(column, name).select(F.col("label").alias("l"), F.col("split_role").alias("r"), name)
        out = out.join(c, F.col("label").eqNullSafe(F.col("l")) & (F.col("split_role") == F.col("r")), "left").drop("l", "r")
    return out.select("split_role", "label", "wanted", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("hashed_records", F.lit(0)).alias("hashed_records"))
