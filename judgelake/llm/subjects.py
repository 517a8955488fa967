"""Subjects of documents: weighted terms in a multi-pattern automaton, sentence by sentence.

The terms aren't written down but curated from all documents: word sequences (Han signs: sign sequences) that labelled
documents of one subject hold far more often than others give a first automaton; the sentences of the corpus in which it
is sure of a subject that the document is labelled with (of an unlabelled document: of which another sentence is too)
say, sentence by sentence, which terms go with which subject, and give the final weights (log-odds, so that common words
weigh nothing and rare ones much). A sentence is about the subject with the highest sum of weights, normalised by the
sentence's length, if that exceeds the subject's threshold; a document has each subject that at least LEAST_SENTENCES of
its sentences are about. Thresholds are those of a grid that agree best with the labels of all labelled documents, each
read with weights that leave out the sentences of its own FOLDS-th part of them.

Every text is divided into its words once and kept so; texts are shuffled only where there are more than BROADCAST
labelled documents. Terms are counted over numbered words and summed per portion before they are shuffled; they are
weighed there and ranked, and at most TERMS terms of each subject and script, a documented size, reach the driver.

Defined results: long texts are read whole; null, empty and blank texts and those without terms have no row; labels in any case or repeated count
once, unknown ones not; repeated documents count per doc_id; without labels or documents there are no rows.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgelake.llm.leaks import _CODE, _ESCAPE, _TAG
from judgelake.llm.text import fold, words_of
from judgelake.runtime import Stage

LEAST_SENTENCES = 3
#: Terms a subject has at most in one script.
TERMS = 3000
#: Documents, or sentences, in which a term must stand.
SUPPORT_DOCUMENTS, SUPPORT_SENTENCES = 2, 3
#: Parts of the labelled documents; the thresholds read each with weights from all documents but its own part.
FOLDS = 2
#: Labelled documents whose labels go to the texts; of more, both sides are shuffled.
BROADCAST = 1_000_000
#: Lead of a sentence's subject that makes it sure.
SURE = 1.5
#: Labelled pairs whose worth the agreement over all subjects has beside that of one subject.
PRIOR = 50
GRID = tuple(round(0.5 + 0.25 * k, 2) for k in range(24))

_STOP = re.compile(r"(?<=[.!?])\s+|(?<=[。！？；])")
#: The same, and words, where all is ASCII.
_ASCII_STOP, _ASCII_WORD = re.compile(r"(?<=[.!?])\s+"), re.compile(r"[0-9]+(?:[.,][0-9]+)*|[a-z]+")
#: A line that goes on in lower case or with a number and a word is the rest of a wrapped sentence.
_REST = regex.compile(r"\s*(?:\p{Ll}|\d+(?:\.\d+)?\s+\p{Ll})")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def sentences(text: str) -> Iterator[list[str]]:
    """Canonical words of each sentence or line."""
    if "\\" in text:
        text = _ESCAPE.sub("\n", text)
        if "\\u" in text:
            text = _CODE.sub(lambda m: chr(int(m.group(1), 16)), text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if m.group()[1:3].lower() in ("br", "p>", "/p", "li", "/l", "h1", "/h", "di", "/d") else " ", text)
    whole = ""
    for line in text.split("\n"):
        if whole and _REST.match(line):
            whole += " " + line
            continue
        yield from _of_line(whole)
        whole = line
    yield from _of_line(whole)


def _of_line(line: str) -> Iterator[list[str]]:
    if line.isascii():
        for part in _ASCII_STOP.split(line.lower()):
            if found := _ASCII_WORD.findall(part):
                yield found
        return
    for part in _STOP.split(line):
        if part and (found := words_of(fold(part))):
            yield found


class Automaton:
    """Term weights by subject, as one automaton over words."""

    def __init__(self, subjects: list[str], weights: dict[str, dict[int, float]]) -> None:
        self.subjects = subjects
        made = ahocorasick.Automaton()
        for term, by in weights.items():
            made.add_word(f"{term} ", (len(term) + 1, tuple(by.items())))
        self.size = len(weights)
        if weights:
            made.make_automaton()
        self.made = made

    def scores(self, words: str) -> list[tuple[int, float, float]]:
        """(subject, score, lead over the next one) of each sentence, a line of words; subject -1 where no term stands."""
        if not words:
            return []
        if not self.size:
            return [(-1, 0.0, 0.0)] * (words.count("\n") + 1)
        text = words.replace("\n", " \n") + " \n"  # no term goes on behind a line
        out = []
        begin, stop = 0, text.find("\n")
        sums: dict[int, float] = {}
        for end, (length, by) in self.made.iter_long(text):
            while end > stop:
                out.append(_best(sums, text, begin, stop))
                begin, stop, sums = stop + 1, text.find("\n", stop + 1), {}
            start = end - length + 1
            if start > begin and text[start - 1] != " ":
                continue
            for s, w in by:
                sums[s] = sums.get(s, 0.0) + w
        while stop >= 0:
            out.append(_best(sums, text, begin, stop))
            begin, stop, sums = stop + 1, text.find("\n", stop + 1), {}
        return out


def _best(sums: dict[int, float], text: str, begin: int, stop: int) -> tuple[int, float, float]:
    """(subject, score, lead) of a sentence that goes from begin to stop, with a blank behind each word."""
    if not sums:
        return -1, 0.0, 0.0
    scale = max(1.0, text.count(" ", begin, stop) / 25)
    if len(sums) == 1:
        ((s, first),) = sums.items()
        return s, first / scale, first / scale
    (s, first), (_, second) = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:2]
    return s, first / scale, (first - max(0.0, second)) / scale


#: Scripts whose terms are ranked apart, so that no language with many documents leaves another without terms.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul")


def weigh(counts: DataFrame, totals: list[float], support: float, least: float, subjects: int, top: int = TERMS) -> dict[str, dict[int, float]]:
    """Log-odds weights of the terms that speak for a subject, the best top ones of each subject and script.

    counts (term, subject, n): where the term stands. Classes from subjects on count as others, but have no terms.
    """
    rows = counts.select("term", F.col("subject").alias("s"), F.col("n").alias("k"), F.sum("n").over(Window.partitionBy("term")).alias("all"))
    rows = rows.filter((F.col("all") >= support) & (F.col("s") < subjects) & (F.col("k") >= support))
    total = F.element_at(F.array(*map(F.lit, map(float, totals))), F.col("s") + 1)
    k, others = F.col("k"), F.greatest(F.lit(float(sum(totals))) - total, F.lit(1.0))
    odds = F.log((k + 0.2) / (total + 1.0)) - F.log((F.col("all") - k + 0.2) / (others + 1.0))
    rows = rows.filter(total > 0).withColumn("w", odds * k / (k + 1.0)).filter(F.col("w") >= least)
    script = F.coalesce(*[F.when(F.col("term").rlike(rf"\p{{Is{name}}}"), name) for name in SCRIPTS], F.lit("other"))
    rank = F.row_number().over(Window.partitionBy("s", "script").orderBy(F.desc(F.col("w") * F.log1p("k")), F.desc("term")))
    best = rows.withColumn("script", script).withColumn("rank", rank).filter(F.col("rank") <= top)
    out: dict[str, dict[int, float]] = defaultdict(dict)
    for term, s, w in best.select("term", "s", "w").collect():  # at most top terms of each subject and script
        out[term][s] = round(w, 4)
    return dict(out)


#: Characters of text whose counts are summed in a worker before they leave it.
PORTION = 16_000_000


def _cells(keys: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, n): sentences of each class that hold a key. at: the sentence of each key; classes: the class of each sentence."""
    small = keys.max(initial=0) < 1 << 24  # they are numbers in a row, so that the products below don't overflow
    distinct, number = (None, keys) if small else np.unique(keys, return_inverse=True)
    held, _ = np.unique(number * len(classes) + at, return_counts=True)  # a sentence counts once; with counts it is sorted, which is faster than hashed
    width = int(classes.max(initial=0)) + 1
    cells, n = np.unique(held // len(classes) * width + classes[held % len(classes)], return_counts=True)
    key = cells // width
    return key if distinct is None else distinct[key], cells % width, n


def term_counts(lines: list[str], classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, class, n): the sentences of each class that hold a term, once each.

    Terms are words, pairs of longer words, triples around a short word ("burden of proof"), and sequences of two to four
    Han signs. lines: the words of each sentence with blanks between them. They are counted as numbers; pairs get numbers
    of their own before they are made longer, so that no number of words overflows.
    """
    split = pc.split_pattern(pa.array(lines, pa.string()), " ")
    coded = split.flatten().dictionary_encode()
    known, size = coded.dictionary, len(coded.dictionary)
    w = coded.indices.to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(lines)), np.diff(split.offsets.to_numpy()))
    names = known.to_pylist()
    sign = np.array([bool(_HAN.match(x)) for x in names], bool)[w]
    plain = ~sign & np.array([not x[:1].isdigit() for x in names], bool)[w]
    length = np.array([len(x) for x in names], np.int64)[w]

    def next_to(x: np.ndarray, k: int) -> np.ndarray:
        """x of the word k further on in the same sentence, else nothing."""
        out = np.zeros_like(x)
        out[:-k] = np.where(at[:-k] == at[k:], x[k:], 0) if k < len(x) else 0
        return out

    one = plain & (length > 2)
    long = plain & (length > 3)
    pair = long & next_to(long, 1)
    triple = long & next_to(plain & ~long, 1) & next_to(long, 2)
    signs = [sign & next_to(sign, 1)]
    for k in (2, 3):
        signs.append(signs[-1] & next_to(sign, k))
    first = np.flatnonzero(pair | triple | signs[0])
    pairs, number = np.unique(w[first] * size + w[first + 1], return_inverse=True)
    of = np.zeros(len(w), np.int64)
    of[first] = number
    place, pair_place, triple_place, four_place = map(np.flatnonzero, (one, pair | signs[0], triple | signs[1], signs[2]))
    word = lambda x: known.take(pa.array(x))
    pair_of = lambda x: pc.binary_join_element_wise(word(pairs[x] // size), word(pairs[x] % size), " ")
    groups = [
        (w[place], place, word),
        (of[pair_place], pair_place, pair_of),
        (of[triple_place] * size + w[triple_place + 2], triple_place, lambda x: pc.binary_join_element_wise(pair_of(x // size), word(x % size), " ")),
        (of[four_place] * len(pairs) + of[four_place + 2], four_place, lambda x: pc.binary_join_element_wise(pair_of(x // len(pairs)), pair_of(x % len(pairs)), " ")),
    ]
    terms, of_class, counts = [], [], []
    for keys, places, said in groups:
        if len(keys):
            key, cls, n = _cells(keys, at[places], classes)
            terms.append(said(key))
            of_class.append(cls)
            counts.append(n)
    if not terms:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.concat_arrays(terms), np.concatenate(of_class), np.concatenate(counts)


#: (words, labels, fold) of a document -> its sentences that count, and the classes of each, which share it.
Choice = Callable[[str, list[int] | None, int | None], tuple[list[str], list[tuple[int, ...]]]]


def _counted(divided: DataFrame, chooser: Callable[[], Choice], stage: Stage, support: float) -> tuple[DataFrame, dict[int, float]]:
    """(term, class, n) counts over all rows of the terms that stand in support sentences, and totals of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = chooser()
        numbers: dict[tuple[int, ...], int] = {}
        lines: list[str] = []
        of: list[int] = []
        size = 0

        def summed() -> pa.RecordBatch:
            terms, shared, n = term_counts(lines, np.array(of, np.int64))
            sums = np.bincount(of, minlength=len(numbers))
            terms = pa.concat_arrays([terms, pa.nulls(len(sums), pa.string())])
            shared, n = np.concatenate([shared, np.arange(len(sums))]), np.concatenate([n, sums])
            sizes = np.array([len(x) for x in numbers], np.int64)
            row = np.repeat(np.arange(len(n)), sizes[shared])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes[shared]) - sizes[shared], sizes[shared])
            classes = np.array([c for x in numbers for c in x], np.int32)[(np.cumsum(sizes) - sizes)[shared[row]] + nth]
            return pa.RecordBatch.from_arrays([terms.take(pa.array(row)), pa.array(classes), pa.array(n[row] / sizes[shared[row]])], names=["term", "class", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("words", "labels", "fold")), strict=True):
                chosen, classes = choose(*row)
                lines += chosen
                of += [numbers.setdefault(c, len(numbers)) for c in classes]
                size += len(row[0])
                if size >= PORTION:
                    yield summed()
                    lines, of, size = [], [], 0
        if lines:
            yield summed()

    # By term alone, and terms that stand too seldom go before the sums of classes are made, so that no further exchange is needed.
    rows = divided.select("words", "labels", "fold").mapInArrow(run, "term string, class int, n double").repartition("term")
    rows = rows.withColumn("all", F.sum("n").over(Window.partitionBy("term"))).filter(F.col("term").isNull() | (F.col("all") >= support))
    kept = stage.keep(rows.groupBy("term", "class").agg(F.sum("n").alias("n")))
    return kept.filter("term is not null"), {r["class"]: r["n"] for r in kept.filter("term is null").collect()}


def find_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, least_sentences: int = LEAST_SENTENCES, terms: int = TERMS) -> DataFrame:
    """(doc_id, subject, sentences): each document with each subject that enough of its sentences are about."""
    spark = documents.sparkSession
    stage = Stage(spark)
    names = [r[0] for r in areas.filter("subject is not null").select("subject").distinct().orderBy("subject").collect()]  # a few areas
    empty = spark.createDataFrame([], "doc_id bigint, subject string, sentences int")
    if not names:
        return empty
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n.strip().lower()), F.lit(i))])
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stage.keep(
        labels.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.try_element_at(place, F.lower(F.trim("subject"))).alias("s")).filter("s is not null")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("labels")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    )
    number = known.count()
    if not number:
        return empty

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ["\n".join(map(" ".join, sentences(text))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "labels", "fold")), pa.array(words, pa.string())], names=["doc_id", "labels", "fold", "words"])

    joined = docs.join(F.broadcast(known) if number <= BROADCAST else known, "doc_id", "left").select("doc_id", "labels", "fold", "text")
    divided = stage.keep(joined.mapInArrow(divide, "doc_id bigint, labels array<int>, fold int, words string"))
    labelled = divided.filter("labels is not null")

    def from_labels(words: str, subjects: list[int], fold: int) -> tuple[list[str], list[tuple[int, ...]]]:
        lines = words.split("\n")
        return lines, [tuple(subjects)] * len(lines)

    counts, totals = _counted(labelled, lambda: from_labels, stage, SUPPORT_DOCUMENTS * 0.75)
    first = Automaton(names, weigh(counts.withColumnRenamed("class", "subject"), [totals.get(s, 0.0) for s in range(len(names))], SUPPORT_DOCUMENTS * 0.75, 1.3, len(names), terms))
    if not first.size:
        return empty

    # What the sentences that the first automaton is sure of say of the terms, those of each part of the labelled documents apart.
    seed = spark.sparkContext.broadcast(pickle.dumps(first))
    width = len(names) + 1

    def from_sentences() -> Choice:
        scores = pickle.loads(seed.value).scores

        def choose(words: str, subjects: list[int] | None, fold: int | None) -> tuple[list[str], list[tuple[int, ...]]]:
            lines = words.split("\n") if words else []
            parts = scores(words)
            if subjects is None:
                tally = Counter(s for s, _, lead in parts if s >= 0 and lead > SURE)
                subjects = [s for s, k in tally.items() if k > 1]
            apart = width * (0 if fold is None else fold + 1)
            chosen, classes = [], []
            for line, (s, _, lead) in zip(lines, parts, strict=True):
                if s < 0 or lead > SURE and s in subjects:
                    chosen.append(line)
                    classes.append((apart + (len(names) if s < 0 else s),))  # what stands in sentences without any subject is no term
            return chosen, classes

        return choose

    counts, totals = _counted(divided, from_sentences, stage, SUPPORT_SENTENCES)

    def learned(without: int | None) -> Automaton:
        """From the sentences of all documents, or of all but a part of the labelled ones."""
        left = [k for k in range(FOLDS + 1) if without is None or k != without + 1]
        rows = counts.filter(F.floor(F.col("class") / width).isin(left)).repartition("term").groupBy("term", (F.col("class") % width).alias("subject")).agg(F.sum("n").alias("n"))
        return Automaton(names, weigh(rows, [sum(totals.get(k * width + s, 0.0) for k in left) for s in range(width)], SUPPORT_SENTENCES, 1.2, len(names), terms))

    def tally_by(automaton: Broadcast, grids: list[tuple[float, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sentences about each subject of a document, under each threshold of the subject's grid."""
            scores = pickle.loads(automaton.value).scores
            for batch in batches:
                ids, subjects, counted = [], [], []
                for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    leads: dict[int, list[float]] = defaultdict(list)
                    for s, _, lead in scores(words):
                        if s >= 0:
                            leads[s].append(lead)
                    for s, xs in leads.items():
                        if len(xs) >= least_sentences:
                            xs.sort()
                            ids.append(doc)
                            subjects.append(s)
                            counted.append([len(xs) - bisect_left(xs, g) for g in grids[s]])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects, pa.int32()), pa.array(counted, pa.list_(pa.int32()))], names=["doc_id", "s", "counted"])

        return tally

    shape = "doc_id bigint, s int, counted array<int>"
    shared = [spark.sparkContext.broadcast(pickle.dumps(learned(x))) for x in (None, *range(FOLDS))]
    tried = [labelled.filter(F.col("fold") == k).select("doc_id", "words").mapInArrow(tally_by(shared[k + 1], [GRID] * len(names)), shape) for k in range(FOLDS)]
    marks = F.broadcast(known) if number <= BROADCAST else known
    held = labelled.select("doc_id", "labels")
    best = _thresholds(reduce(DataFrame.unionByName, tried).join(marks.select("doc_id", "labels"), "doc_id"), held, least_sentences, len(names))
    chosen = tally_by(shared[0], [(GRID[k],) for k in best])
    found = divided.select("doc_id", "words").mapInArrow(chosen, shape).withColumn("sentences", F.col("counted")[0]).filter(F.col("sentences") >= least_sentences)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("s") + 1)
    return found.select("doc_id", name.alias("subject"), "sentences").dropDuplicates(["doc_id", "subject"])


def _thresholds(tried: DataFrame, held: DataFrame, least_sentences: int, subjects: int) -> list[int]:
    """Place in GRID of the threshold of each subject that agrees best (F1) with the labels.

    tried: doc_id, s, counted, labels. A subject's own counts are read beside those over all subjects, scaled to PRIOR
    labelled pairs, so that a few labels don't decide; of those equal to three places the threshold nearest to 2 is taken.
    """
    right = F.array_contains("labels", F.col("s"))
    over = [F.col("counted")[k] >= least_sentences for k in range(len(GRID))]
    sums = {r["s"]: r for r in tried.groupBy("s").agg(*[F.count_if(right & x).alias(f"r{k}") for k, x in enumerate(over)], *[F.count_if(x).alias(f"a{k}") for k, x in enumerate(over)]).collect()}
    wanted = {r["s"]: r["count"] for r in held.select(F.explode("labels").alias("s")).groupBy("s").count().collect()}
    of = lambda s, name: sums[s][name] if s in sums else 0
    scale = PRIOR / max(1, sum(wanted.values()))
    best = []
    for s in range(subjects):
        quality = []
        for k, g in enumerate(GRID):
            hits, given = (of(s, f"{x}{k}") + scale * sum(r[f"{x}{k}"] for r in sums.values()) for x in "ra")
            quality.append((round(2 * hits / max(1e-9, given + wanted.get(s, 0) + PRIOR * bool(wanted)), 3), -abs(g - 2.0), k))
        best.append(max(quality)[2])
    return best


def subject_report(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Documents of each subject by source, with their share of the source's documents."""
    found = find_subjects(documents, labels, areas).select("doc_id", "subject")
    source = F.regexp_replace(F.regexp_replace(F.lower("source"), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")  # spellings of one source
    rows = documents.filter("doc_id is not null").select("doc_id", source.alias("source")).dropDuplicates(["doc_id"])
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("source_documents"))
    made = rows.join(found, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"))
    joined = made.join(sizes, made["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
    return joined.select("source", "subject", "documents", "source_documents", (F.col("documents") / F.col("source_documents")).alias("share"))
