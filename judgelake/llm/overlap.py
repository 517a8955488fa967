"""Records of evaluation splits whose question also stands in the training split, exactly or almost.

Questions are hashed after case, punctuation and white space normalisation; equal hashes are one class, so copies
cost one row each however many there are. Exact overlaps are joins of these hashes. A hash of the whole text can't
see slips, layout or exchanged words, so classes are joined on further hashes of canonical parts. Two such classes
have the same multiset of numbers; numbers of at most RARE classes are a key by themselves. Others, and classes
without numbers, add words: of two classes with at least SHARED of their words in common, words ordered by rarity over
all classes, each has a common word within its prefix, and two within the prefix that is longer by one word (prefix
filtering as in similarity joins). A word met in at most RARE classes is a key by itself, and any two prefix words
that are met more often are one together, so that no class is without keys whatever its words. Every candidate pair
is then verified word by word. Pairs are formed between classes and expanded to the pairs of one training and one
evaluation record only at the end; both joins cut a key of many rows into cells of about CELL by CELL rows.

Defined results: long questions are read whole; null, empty and wordless questions and records of no or another role form no pairs; equal record
ids form no pair; repeated rows give one pair; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.text import distance, fold, number, slip, words_of
from judgelake.runtime import Stage

SHARED = 0.65
#: Share of the shorter question's words that must be the same letter by letter, slips not counted.
LEAST_SHARED = 0.6
#: A sentence without number or name in this share of all classes, and in STOCK_LEAST of them, is a stock instruction.
STOCK_SHARE, STOCK_LEAST = 0.001, 8
#: A word in this share of all classes, and in COMMON_LEAST of them, is no name.
COMMON_SHARE, COMMON_LEAST = 0.0003, 8
#: Numbers, or a word, met in no more classes than this are selective enough to be a join key by themselves.
RARE = 50
#: Words of a question that is joined by each of its words, however frequent.
FEW = 3
#: Rows of a key on either side of a join that meet in one task.
CELL = 1000
ROLES = {"train": ["train", "training"], "evaluation": ["dev", "heldout", "test", "development", "validation", "valid", "val", "holdout", "testing", "eval", "evaluation"]}

_SENTENCE = regex.compile(r"(?<=[.?!。？！])\s+|\n+")
_INNER_CAPITAL = regex.compile(r"(?<=[\p{Ll}\p{N},;)] )\p{Lu}\p{Ll}+")


def side(role: Column) -> Column:
    """'train', 'evaluation' or null, in any spelling of the role."""
    plain = F.regexp_replace(F.lower(role), r"[^a-z]", "")
    return F.when(plain.isin(ROLES["train"]), "train").when(plain.isin(ROLES["evaluation"]), "evaluation")


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


CLASS_SCHEMA = "class binary, sentences array<struct<h:binary,plain:boolean,words:array<string>>>, names array<string>"


def canonical_questions(rows: DataFrame) -> DataFrame:
    """record_id, side, label with the class hash and the canonical sentences of each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {"class": [], "sentences": [], "names": []}
            for text in batch.column("question").to_pylist():
                shouted = text.upper() == text
                parts, every, names = [], [], set()
                for sentence in _SENTENCE.split(text.replace("\xa0", " ")):
                    found = [number(w) if w[0].isdigit() else w for w in words_of(fold(sentence))]
                    if not found:
                        continue
                    inner = [] if shouted else [w for x in _INNER_CAPITAL.findall(sentence) for w in words_of(fold(x))]
                    names.update(inner)
                    plain = not inner and not any(w[0].isdigit() for w in found)
                    parts.append({"h": _digest(found), "plain": plain, "words": found})
                    every += found
                data["class"].append(_digest(every) if every else None)
                data["sentences"].append(parts)
                data["names"].append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_id"), batch.column("side"),
                 pa.array(data["class"], pa.binary()),
                 pa.array(data["sentences"], pa.list_(pa.struct([("h", pa.binary()), ("plain", pa.bool_()), ("words", pa.list_(pa.string()))]))),
                 pa.array(data["names"], pa.list_(pa.string()))],
                names=["record_id", "side", "class", "sentences", "names"],
            )

    return rows.mapInArrow(run, f"record_id bigint, side string, {CLASS_SCHEMA}").filter("class is not null")


def same_question(a: dict, b: dict) -> bool:
    """Word-by-word check of two classes whose numbers agree. a, b: words (with repeats), common (words met in many
    classes), names (words written as names)."""
    x, y = Counter(a["words"]), Counter(b["words"])
    shared = sum((x & y).values())
    least = min(sum(x.values()), sum(y.values()))
    if shared < LEAST_SHARED * least:
        return False
    more, less = x - y, y - x
    common, names = a["common"] | b["common"], a["names"] | b["names"]
    rest_more, rest_less = list(more.elements()), list(less.elements())
    for w in list(rest_more):
        for v in rest_less:
            both_names = (w in names and w not in common) and (v in names and v not in common)
            neither = w not in names and v not in names and min(len(w), len(v)) > 4
            if not both_names and (slip(w, v) or neither and distance(w, v) <= 2):
                rest_more.remove(w)
                rest_less.remove(v)
                shared += 1
                break
    named = lambda ws: [w for w in ws if w not in common and (w in names or len(w) > 4)]
    if any(w in names and w not in common for w in (*rest_more, *rest_less)):
        return False
    if named(rest_more) and named(rest_less):
        return False
    return shared >= 0.75 * least and min(len(rest_more), len(rest_less)) <= max(2, 0.2 * least)


def _met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on key. A key of many rows is cut into cells: each of its rows of one side goes to one row of cells,
    each of the other side to one column, and only cells of about CELL by CELL rows meet in a task."""
    # Only keys of more than CELL rows are listed, so these tables are small beside the sides.
    parts = lambda side, name: side.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name)).filter(F.col(name) > 1)
    down, across = parts(left, "down"), parts(right, "across")

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.join(down, key, "left").join(across, key, "left")
        hashed = F.pmod(F.xxhash64(*side.columns), F.coalesce(own, F.lit(1))).cast("int")
        return rows.select(*side.columns, hashed.alias(f"of_{own}"), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"of_{other}"))

    return placed(left, "down", "across").join(placed(right, "across", "down"), [key, "of_down", "of_across"]).drop("of_down", "of_across")


def overlaps(bank: DataFrame, record_id: str = "record_id", question: str = "question", role: str = "split_role", shared: float = SHARED) -> DataFrame:
    """(train_id, evaluation_id): each pair of a training and an evaluation record that ask the same question."""
    stage = Stage(bank.sparkSession)
    rows = bank.select(F.col(record_id).cast("bigint").alias("record_id"), side(F.col(role)).alias("side"), F.col(question).cast("string").alias("question"))
    rows = rows.filter("side is not null and record_id is not null and length(question) > 0")
    records = stage.keep(canonical_questions(rows))
    members = records.select("record_id", "side", "class").distinct()
    # Texts of one class may be divided into sentences in several ways; the least division counts for all.
    classes = stage.keep(
        records.groupBy("class").agg(
            F.min("sentences").alias("sentences"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"),
            F.bool_or(F.col("side") == "train").alias("in_train"), F.bool_or(F.col("side") == "evaluation").alias("in_evaluation"),
        )
    )
    n_classes = classes.count()
    total = max(STOCK_LEAST, STOCK_SHARE * n_classes)
    stock = (
        classes.select(F.explode("sentences").alias("s")).filter("s.plain").groupBy(F.col("s.h").alias("h")).count()
        .filter(F.col("count") >= total).select("h")
    )
    sentences = classes.select("class", "names", "in_train", "in_evaluation", F.posexplode("sentences").alias("place", "s"))
    kept = sentences.join(stock, F.col("s.h") == F.col("h"), "left").withColumn("stock", F.col("h").isNotNull())
    bodies = kept.groupBy("class").agg(
        F.first("names").alias("names"), F.first("in_train").alias("in_train"), F.first("in_evaluation").alias("in_evaluation"),
        F.flatten(F.sort_array(F.collect_list(F.when(~F.col("stock"), F.struct("place", "s.words"))))["words"]).alias("own"),
        F.flatten(F.sort_array(F.collect_list(F.struct("place", "s.words")))["words"]).alias("every"),
    )
    is_number = lambda w: w.rlike(r"^\d")
    words = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every"))
    bodies = stage.keep(
        bodies.select(
            "class", "names", "in_train", "in_evaluation",
            F.filter(words, lambda w: ~is_number(w)).alias("words"), "every",
            F.array_join(F.sort_array(F.filter(words, is_number)), " ").alias("numbers"),
        )
    )
    tokens = bodies.select("class", F.explode(F.array_distinct("words")).alias("word"))
    met = bodies.select(F.explode(F.array_distinct("every")).alias("word"))  # stock sentences tell what is common
    rarity = met.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = tokens.join(rarity, "word").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    common_numbers = bodies.groupBy("numbers").count().filter((F.col("numbers") == "") | (F.col("count") > RARE)).select("numbers", F.lit(True).alias("often"))
    n = F.size(F.array_distinct("words"))
    unique = n - F.size("ranked")  # words of one class only come first in the order and can't be shared
    longer = F.slice("ranked", 1, F.greatest(n - F.ceil(n * shared).cast("int") - unique + 2, F.lit(2)))
    none = F.expr("array()").cast("array<struct<df:bigint,word:string>>")
    bodies = bodies.drop("every").join(ranked, "class", "left").join(common_numbers, "numbers", "left").withColumn("ranked", F.coalesce("ranked", none)).withColumn("longer", longer)
    often = F.filter("longer", lambda r: r["df"] > RARE)["word"]
    pairs = F.flatten(F.transform(often, lambda w: F.transform(F.filter(often, lambda v: v > w), lambda v: F.xxhash64("numbers", w, v))))
    # Where a question has so few words, one that holds a few more may share a single one with it.
    alone = F.when(n <= FEW, F.transform("ranked", lambda r: F.xxhash64("numbers", r["word"]))).otherwise(F.array().cast("array<bigint>"))
    single = F.transform(F.filter("ranked", lambda r: r["df"] <= RARE), lambda r: F.xxhash64("numbers", r["word"]))
    keys = F.when(F.col("often"), F.concat(single, pairs, alone)).otherwise(F.array(F.xxhash64("numbers")))
    bag = F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w))
    bodies = stage.keep(
        bodies.select(
            "class", "names", "in_train", "in_evaluation", "words", "numbers", keys.alias("keys"), bag.alias("bag"),
            F.filter("ranked", lambda r: r["df"] >= max(COMMON_LEAST, COMMON_SHARE * n_classes))["word"].alias("common"),
        )
    )
    keyed = bodies.select("class", "in_train", "in_evaluation", F.explode(F.array_distinct("keys")).alias("key"))
    left = keyed.filter("in_train").select("key", F.col("class").alias("a"))
    right = keyed.filter("in_evaluation").select("key", F.col("class").alias("b"))
    candidates = _met(left, right, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    facts = bodies.select("class", "words", "numbers", "common", "names")
    bags = lambda p: bodies.select(F.col("class").alias(p), F.col("bag").alias(f"{p}_bag"), F.size("words").alias(f"{p}_size"), F.col("numbers").alias(f"{p}_numbers"))
    # Common words, and as many more as the repeats of one side could be, must reach what same_question asks for.
    repeats = F.least(F.col("a_size") - F.size("a_bag"), F.col("b_size") - F.size("b_bag"))
    alike = F.size(F.array_intersect("a_bag", "b_bag")) + repeats >= LEAST_SHARED * F.least("a_size", "b_size")
    candidates = stage.keep(candidates.join(bags("a"), "a").join(bags("b"), "b").filter("a_numbers = b_numbers").filter(alike).select("a", "b"))
    side_of = lambda p: facts.select(F.col("class").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("words", "numbers", "common", "names")])
    joined = candidates.join(side_of("a"), "a").join(side_of("b"), "b").filter("a_numbers = b_numbers")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            keep = [
                same_question(*({"words": of[f"{p}_words"][i], "common": set(of[f"{p}_common"][i]), "names": set(of[f"{p}_names"][i])} for p in "ab"))
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = stage.keep(joined.mapInArrow(verify, "a binary, b binary"))
    same = bodies.filter("in_train and in_evaluation").select(F.col("class").alias("a"), F.col("class").alias("b"))
    linked = stage.keep(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same))
    train = members.filter("side = 'train'").select(F.col("class").alias("a"), F.col("record_id").alias("train_id"))
    evaluation = members.filter("side = 'evaluation'").select(F.col("class").alias("b"), F.col("record_id").alias("evaluation_id"))
    asked = _met(linked, evaluation, "b").select("a", "evaluation_id")
    return _met(train, asked, "a").filter("train_id <> evaluation_id").select("train_id", "evaluation_id").distinct()


def overlap_pairs(bank: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b), record_id_a < record_id_b."""
    found = overlaps(bank)
    return found.select(F.least("train_id", "evaluation_id").alias("record_id_a"), F.greatest("train_id", "evaluation_id").alias("record_id_b"))


def overlap_report(bank: DataFrame) -> DataFrame:
    """Per split_role and data_source of the evaluation records: records, overlapping records and pairs."""
    hits = overlaps(bank).groupBy(F.col("evaluation_id").alias("record_id")).agg(F.count(F.lit(1)).alias("pairs"))
    plain = F.regexp_replace(F.lower("split_role"), r"[^a-z]", "")
    rows = bank.filter(side(F.col("split_role")) == "evaluation").select("record_id", plain.alias("split_role"), "data_source").distinct()
    return rows.join(hits, "record_id", "left").groupBy("split_role", "data_source").agg(
        F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )
