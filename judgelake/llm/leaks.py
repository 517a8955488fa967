"""Passages of held-out items in a corpus: spaced-seed hashing with substitution-tolerant verification.

Seeds are hashes of SEED words chosen by fixed masks that skip a position, taken from the items and from every
document; since all masks share one hash space, a seed also meets a passage into which a word was put or in which
one was exchanged. What other items hold as well (stock instructions, common phrases) is little evidence or none, however few
they are: seeds are counted over all different texts of items, in Spark. Hits of one item are chained along a document,
the chain is extended over slips and exchanged words, and its matched words are weighed by their rarity among the items.

The items are the stated query set: they are read in blocks of a bounded number of words, each block's seed table
(its size is checked by construction) goes to the tasks, and the documents are scanned once per block in Arrow
batches, without a shuffle of the corpus. Every document is read whole.

Defined results: long texts are read whole; null, empty and wordless texts hold no passage; repeated items are found each; repeated documents
give repeated rows once per doc_id; null ids are left out; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.text import fold, slip, words_of
from judgelake.runtime import Stage

MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
SEED = 4
SPAN = max(mask[-1] for mask in MASKS) + 1
#: A seed is stock in a text if more than STOCK times as many texts hold it as hold what is usual for that text.
STOCK = 3
#: A passage has at least so many matched words of at least this weight together; a word of one item only weighs 1.
LEAST_WORDS, LEAST_WEIGHT = 8, 3.5
#: Words of items whose seeds go to the tasks at once.
BLOCK_WORDS = 400_000
#: Documents whose seeds are looked up at once.
TOGETHER = 100
#: Words of a document, and of an item, that may lie between two hits of one passage.
GAP_DOCUMENT, GAP_ITEM = 14, 5

_TAG = regex.compile(r"</?[a-zA-Z!][^<>]{0,200}>")
_HYPHEN = regex.compile(r"(?<=\p{L})[-­‐](?:[ \t]*(?:\\r)?(?:\\n|\n|\r\n)[ \t>|*#]*| )(?=\p{Ll}|\p{Lu}{2})")
_ESCAPE = regex.compile(r"\\[nrt]")
_CODE = regex.compile(r"\\u([0-9a-fA-F]{4})")


def passage_words(text: str) -> list[str]:
    """Canonical words without markup, entities, escapes and hyphens at line ends."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m.group()[1:3].lower() in ("br", "p>", "di", "/p", "li", "/d", "td", "tr", "h1") else "", text)
    if "&" in text:
        text = html.unescape(text)
    if "-" in text or "­" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
        if "\\u" in text:
            text = _CODE.sub(lambda m: chr(int(m.group(1), 16)), text)
    return words_of(fold(text))


_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def seed_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k, off in enumerate(mask):
        h ^= ids[off : off + n] * _MULTIPLY[k]
        h = (h << np.uint64(13)) | (h >> np.uint64(51))
    return h * _MULTIPLY[0]


class SeedTable:
    """Words, weights and seeds of one block of item texts."""

    def __init__(self, items: list[tuple[int, list[str], list[float], list[int]]]) -> None:
        """items: (item id, canonical words, weight of each word, kept seeds as place * len(MASKS) + mask)."""
        self.items = [x[0] for x in items]
        self.words = [x[1] for x in items]
        self.weights = [x[2] for x in items]
        self.number: dict[str, int] = {}
        hashes, owner, place = [], [], []
        for t, (_, words, _, kept) in enumerate(items):
            ids = self.ids(words, True)
            kept_seeds = np.array(sorted(kept), dtype=np.int32)
            for m, mask in enumerate(MASKS):
                at = kept_seeds[kept_seeds % len(MASKS) == m]
                hashes.append(seed_hashes(ids, mask)[at // len(MASKS)])
                owner.append(np.full(len(at), t, dtype=np.int32))
                place.append(at)
        all_hashes = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, dtype=np.int32))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, dtype=np.int32))[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, words: list[str], learn: bool = False) -> np.ndarray:
        number = self.number
        if learn:
            for w in words:
                if w not in number:
                    number[w] = len(number) + 1
            return np.array([number[w] for w in words], dtype=np.uint64)
        return np.array([number.get(w, 0) for w in words], dtype=np.uint64)

    def hits(self, documents: list[list[str]]) -> tuple[np.ndarray, ...]:
        """(document, owner, document place, item place, masks) of every seed met, for many documents at once."""
        sizes = np.array([len(w) for w in documents], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + SPAN)])[:-1]
        ids = np.zeros(int((sizes + SPAN).sum()), dtype=np.uint64)  # words that no item has, and the gaps, are 0
        for start, words in zip(starts, documents, strict=True):
            ids[start : start + len(words)] = self.ids(words)
        found: list[list[np.ndarray]] = []
        for d, mask in enumerate(MASKS):
            h = seed_hashes(ids, mask)
            near = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(self.hashes, h[near], "left")
            times = np.searchsorted(self.hashes, h[near], "right") - low
            at = np.repeat(near, times)
            k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            document = np.searchsorted(starts, at, "right") - 1
            place = self.place[k]
            found.append([document, self.owner[k].astype(np.int64), at - starts[document], place // len(MASKS), d * len(MASKS) + place % len(MASKS)])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def passages(self, documents: list[list[str]]) -> list[dict[int, tuple[float, int]]]:
        """For each document the best passage of each item text: weight and number of matched words."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in documents]
        if not documents or not len(self.hashes):
            return out
        document, owner, at, place, masks = self.hits(documents)
        key = document * len(self.items) + owner
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.diff(key[order], append=-1)) + 1
        start = 0
        for end in ends.tolist():
            group, start = order[start:end], end
            first = group[0]
            n, o = int(document[first]), int(owner[first])
            pairs = set()
            for a, p, m in zip(at[group].tolist(), place[group].tolist(), masks[group].tolist(), strict=True):
                for x, y in zip(MASKS[m // len(MASKS)], MASKS[m % len(MASKS)], strict=True):
                    pairs.add((a + x, p + y))
            weights = self.weights[o]
            straight = len({d - i for d, i in pairs}) == 1
            best = (self.line if straight else self.chain)(documents[n], self.words[o], weights, pairs)
            if best[1]:
                out[n][o] = best
        return out

    def line(self, words: list[str], item: list[str], weights: list[float], pairs: set[tuple[int, int]]) -> tuple[float, int]:
        """What chain gives where all pairs are equally far apart: then the pair before is always the best to go on from."""
        best, top, here = (0.0, 0), None, None
        for d, i in sorted(pairs):
            w = weights[i]
            then = (d, i, w, 1, d, i)
            if here and i - here[1] <= GAP_ITEM:
                total, count = here[2] + w, here[3] + 1
                for k in range(1, i - here[1]):
                    near, own = words[here[0] + k], item[here[1] + k]
                    if not near[0].isdigit() and slip(near, own):
                        total, count = total + 0.5 * weights[here[1] + k], count + 1
                    else:
                        total -= max(0.1, weights[here[1] + k])
                if total > w:
                    then = (d, i, total, count, here[4], here[5])
            here = then
            if here[2] > best[0]:
                best, top = (here[2], here[3]), here
        return self.extend(words, item, weights, top) if top else best

    def chain(self, words: list[str], item: list[str], weights: list[float], pairs: set[tuple[int, int]]) -> tuple[float, int]:
        """Heaviest chain of matched words that run forward in both texts with short gaps.

        A word of the item that is missing costs its weight, so another number or name costs most; a slip counts half;
        words put in between cost little.
        """
        best = (0.0, 0)
        ends: list[tuple[int, int, float, int, int, int]] = []  # document place, item place, weight, words, start of chain
        for d, i in sorted(pairs):
            w = weights[i]
            here = (d, i, w, 1, d, i)
            for e in ends:
                gd, gi = d - e[0], i - e[1]
                if 0 < gd <= GAP_DOCUMENT and 0 < gi <= GAP_ITEM:
                    total, count = e[2] + w - 0.05 * max(0, gd - gi), e[3] + 1
                    for k in range(1, gi):
                        near = words[e[0] + k] if gd == gi else ""
                        if near and slip(near, item[e[1] + k]) and not near[0].isdigit():
                            total, count = total + 0.5 * weights[e[1] + k], count + 1
                        else:
                            total -= max(0.1, weights[e[1] + k])
                    if total > here[2]:
                        here = (d, i, total, count, e[4], e[5])
            ends = [e for e in ends if d - e[0] <= GAP_DOCUMENT]
            ends.append(here)
            if here[2] > best[0]:
                best = (here[2], here[3])
                top = here
        return self.extend(words, item, weights, top) if best[1] else best

    def extend(self, words: list[str], item: list[str], weights: list[float], chain: tuple[int, int, float, int, int, int]) -> tuple[float, int]:
        """Carry a chain on at both ends, over slips and single exchanged or inserted words."""
        total, count = chain[2], chain[3]
        for d, i, step in ((chain[0], chain[1], 1), (chain[4], chain[5], -1)):
            run, more = 0.0, 0
            while run > -0.5:
                d, i = d + step, i + step
                if not (0 <= d < len(words) and 0 <= i < len(item)):
                    break
                if words[d] == item[i]:
                    run, more = run + weights[i], more + 1
                elif not words[d][0].isdigit() and slip(words[d], item[i]):
                    run, more = run + 0.5 * weights[i], more + 1
                elif 0 <= d + step < len(words) and words[d + step] == item[i]:
                    d, run, more = d + step, run + weights[i] - 0.05, more + 1
                else:
                    run -= max(0.1, weights[i])
                if run > 0:
                    total, count, run, more = total + run, count + more, 0.0, 0
        return total, count


def _texts(items: DataFrame, item_id: str, fields: list[str]) -> DataFrame:
    """(item, text, words): canonical words of each field of each item; text is the same for equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [passage_words(t) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.string()))], names=["item", "text", "words"])

    texts = items.filter(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("item"), F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text")
    )
    return texts.filter("length(text) > 0").mapInArrow(run, "item bigint, text binary, words array<string>").filter(F.size("words") >= SEED)


def item_evidence(items: DataFrame, item_id: str, fields: list[str], stage: Stage) -> tuple[DataFrame, int]:
    """(item, words, weights, seeds) of each item text, and the number of words of all of them.

    A seed's count is the number of different texts that hold it, a word's the least count of the seeds over it. What
    other texts hold as well says less about this one: a word weighs its rarity times the cube of usual / count, where
    usual is the count that LEAST_WORDS words of the text keep within. Seeds of more than STOCK times as many texts
    are left out.
    """
    texts = stage.keep(_texts(items, item_id, fields))
    single = stage.keep(texts.select("text", "words").dropDuplicates(["text"]))
    sums = single.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).first()
    n = sums["n"]
    none = F.array().cast("array<struct<seed:int,h:bigint>>")

    def seeds_of(m: int, mask: tuple[int, ...]) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - mask[-1] - 1)
        seed = F.transform(starts, lambda i: F.struct((i * len(MASKS) + m).alias("seed"), F.xxhash64(*[F.element_at("words", i + off + 1) for off in mask]).alias("h")))
        return F.when(F.size("words") > mask[-1], seed).otherwise(none)

    made = [seeds_of(m, mask) for m, mask in enumerate(MASKS)]
    seeds = stage.keep(single.select("text", F.inline(F.concat(*made))))
    shared = seeds.select("text", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    counted = stage.keep(seeds.join(shared, "h", "left").select("text", "seed", F.coalesce("texts", F.lit(1)).alias("texts")))
    offsets = F.element_at(F.array(*[F.array(*map(F.lit, mask)) for mask in MASKS]), (F.col("seed") % len(MASKS) + 1).cast("int"))
    places = counted.select("text", "texts", F.explode(offsets).alias("off"), F.floor(F.col("seed") / len(MASKS)).cast("int").alias("start"))
    least = places.groupBy("text", (F.col("start") + F.col("off")).alias("place")).agg(F.min("texts").alias("texts"))
    met = single.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    words = single.select("text", F.posexplode("words").alias("place", "word")).join(met, "word").join(least, ["text", "place"])
    rarity = F.log((n + 1) / (F.col("df") + 0.5)) / math.log((n + 1) / 1.5)
    by_text = words.groupBy("text").agg(
        F.sort_array(F.collect_list(F.struct("place", rarity.alias("rarity"), "texts"))).alias("at"), F.sort_array(F.collect_list("texts")).alias("counts")
    ).withColumn("usual", F.element_at("counts", F.least(F.size("counts"), F.lit(LEAST_WORDS))))
    weight = F.transform("at", lambda x: x["rarity"] * F.least(F.lit(1.0), F.pow(F.col("usual") / x["texts"], F.lit(3))))
    weighed = by_text.select("text", "usual", weight.alias("weights"))
    kept = counted.join(weighed.select("text", "usual"), "text").filter(F.col("texts") <= STOCK * F.col("usual")).groupBy("text").agg(F.collect_list("seed").alias("seeds"))
    return stage.keep(texts.join(weighed, "text").join(kept, "text").select("item", "words", "weights", "seeds")), int(sums["words"] or 0)


def item_tables(items: DataFrame, item_id: str, fields: list[str], block_words: int = BLOCK_WORDS) -> Iterator[SeedTable]:
    """Seed tables of the items, block by block; only one block at a time is on the driver."""
    texts, total = item_evidence(items, item_id, fields, Stage(items.sparkSession))
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for k in range(blocks):
        rows = texts.filter(block == k).orderBy("item", "words").collect()  # about block_words words
        if rows:
            yield SeedTable([tuple(r) for r in rows])


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("question", "reference_answer"), least_words: int = LEAST_WORDS, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """(doc_id, item_id, weight, words): documents with the items of which they hold a passage."""
    sc = documents.sparkSession.sparkContext
    source = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("length(text) > 0")
    out = None
    for table in item_tables(items, item_id, list(fields)):
        shared = sc.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                rows = []
                names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for start in range(0, len(names), TOGETHER):
                    documents = [passage_words(t) for t in bodies[start : start + TOGETHER]]
                    for doc, found in zip(names[start:], table.passages(documents), strict=False):
                        best: dict[int, tuple[float, int]] = {}
                        for owner, (weight, count) in found.items():
                            if weight >= least_weight and count >= least_words:
                                item = table.items[owner]
                                best[item] = max(best.get(item, (0.0, 0)), (weight, count))
                        rows += [(doc, item, w, c) for item, (w, c) in best.items()]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)],
                    names=["doc_id", "item_id", "weight", "words"],
                )

        part = source.mapInArrow(run, "doc_id bigint, item_id bigint, weight double, words int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, weight double, words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("weight").alias("weight"), F.max("words").alias("words"))
