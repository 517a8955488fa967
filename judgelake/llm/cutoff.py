"""Values that were cut off by a field limit or mid-transfer, found by hashed logistic regression.

Positives are made: intact values are cut at places drawn at random or at the lengths at which unfinished values pile
up, some with the marks that cutting software leaves or within an escape sequence. A logistic regression on hashed
features of the closing characters, the last words, the open brackets, fences and quotations, the punctuation since
the last sentence end and the length to the limit is fitted on SAMPLE values of each field (a documented bound) and
then scores every value. Values that the first fit takes for cut are left out of the second fit.

Limits are read off the lengths of all values: a length at which LEAST_AT_LIMIT unfinished values or more stand, and
more than PEAK times as many as at the lengths around it. A longer value without any punctuation ends as it is
written, unless it is marked or stands at a limit. Every value is read whole.

Defined results: null, empty and blank values are no cases; every place of an array counts, nulls included; repeated
rows give one case per record id; empty tables give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.text import fold, words_of
from judgelake.runtime import Stage

#: Values of each field on which the model is fitted, fewer where they would have more than SAMPLE_CHARS characters.
SAMPLE = 8000
SAMPLE_CHARS = 40_000_000
DIMENSIONS = 1 << 15
THRESHOLD = 0.6
LEAST_AT_LIMIT, PEAK = 6, 4.0

#: What cutting software leaves at the end of a value.
CUT_MARKS = ["…", "...", "[...]", "[…]", "[truncated]", "[cut]", "<cut>", "(truncated)", "<truncated>", "�", "\\", "-"]
_MARK = regex.compile(r"\s*(?:…|\.\.\.|\[(?:\.\.\.|…|truncated|cut|snip)\]|<(?:cut|truncated)>|\(truncated\)|�+)\s*$", regex.I)
_HALF_ESCAPE = regex.compile(r"(?:&(?:#?\w{0,6})|%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|<[/a-zA-Z][^<>\s]{0,8})$")
#: Openings of a bracket, quotation, formula, code block or list in which a value may break off.
OPENINGS = [" (", " “", ' "', "\n\n$$\n\\frac{", " [", "\n```\n", "\n- ", " **", "\n| "]
_ESCAPES = ["&amp;", "&quot;", "&#39;", "%E2%80%94", "%20", "\\u00e9", "\\u2019", "\\n", "<b>", "</p>"]
_LAST_STOP = regex.compile(r"[.!?。！？](?=\s|$|[\"'”»)\]])|[。！？]")
_PAUSE = regex.compile(r"[.,;:!?…](?=\s|$)|[。，、；：！？]|[-|*•`$]")
_TOKEN = regex.compile(r"\p{L}+|\d+(?:[.,]\d+)*|[^\s\p{L}\d]")
_ROW = regex.compile(r"^(\W*)(\p{L}+|\d+)?(?:\s+\p{L}+){0,2}?\s*([:=|.)-]?)")


def _shape(token: str) -> str:
    return "9" if token[0].isdigit() else ("A" if token[0].isupper() else "a") if token[0].isalpha() else token


class Model:
    """What scoring needs: weights, limits, and the words met within sampled values."""

    def __init__(self, limits: list[int], known: frozenset[str]) -> None:
        self.limits, self.known = frozenset(limits), known
        self.weights = np.zeros(DIMENSIONS)

    def names(self, text: str) -> list[str]:
        """Features of one value, as names."""
        body = text.rstrip()
        marked = _MARK.search(body)
        core = body[: marked.start()] if marked and marked.start() else body
        tail = body[-240:]
        last_line = tail[tail.rfind("\n") + 1 :]
        line = last_line.strip()
        stop = None
        for stop in _LAST_STOP.finditer(tail):  # noqa: B007
            pass
        since = tail[stop.end() :] if stop else tail
        open_sentence = _TOKEN.findall(since)
        tokens = _TOKEN.findall(tail[-90:])
        end = tokens[-1] if tokens else ""
        kind = _shape(end) if end else ""
        word = end.lower()
        known = "number" if kind == "9" else ("known" if word in self.known else "new") + kind if kind in ("a", "A") else "sign"
        whole_words = len(body) < 90 and len(body.split())
        unpunctuated = not any(c in body for c in ".!?。")
        bare = not _PAUSE.search(body)  # written without any punctuation: no end can be missing
        shape = "".join(_shape(t) for t in _TOKEN.findall(line)) if len(line) < 90 else "long"
        row = _ROW.match(line)
        head = (row.group(1) + (row.group(2) or "").lower() + row.group(3)) if row else ""
        at_limit = len(core) in self.limits or len(body) in self.limits or len(text) in self.limits
        opened = "".join(
            x for x, bad in (
                ("f", body.count("```") % 2), ("{", body.count("{") > body.count("}")), ("[", body.count("[") > body.count("]")),
                ("(", body.count("(") > body.count(")")), ("$", body.count("$$") % 2), ('"', body.count('"') % 2),
                ("q", body.count("“") > body.count("”")), ("«", body.count("«") > body.count("»")), ("*", body.count("**") % 2),
            ) if bad
        )
        n_open = min(len(open_sentence), 12)
        half = _HALF_ESCAPE.search(body)
        final = body[-1:] if not body[-1:].isalnum() else kind
        out = [
            "bias", f"final {final}", f"final2 {body[-2:]}", f"known {known}", f"open {opened}", f"limit {at_limit}",
            f"limit {at_limit} {final}", f"since {n_open} {kind}", f"word {word}", f"words {' '.join(t.lower() if _shape(t) != '9' else '9' for t in tokens[-2:])}",
            f"shape {shape}", f"head {head} {final}", f"head {head} {known}", f"end {known} {n_open > 0} {unpunctuated}",
            f"suffix {word[-3:]} {kind}", f"short {whole_words and min(whole_words, 8)} {known}", f"plain {unpunctuated} {min(len(body) // 60, 5)}",
            f"bare {bare} {min(len(body) // 60, 4)}", f"mark {bool(marked)}", f"half {bool(half)} {body[half.start()] if half else ''}", f"tail {' '.join(_shape(t) for t in tokens[-4:])}",
        ]
        out += [f"opened {x} {final}" for x in opened]
        return out

    def index(self, text: str) -> list[int]:
        return [crc32(n.encode("utf-8", "surrogatepass")) & (DIMENSIONS - 1) for n in self.names(text)]

    def fit(self, rows: list[list[int]], labels: np.ndarray, rounds: int = 250, decay: float = 3e-4) -> None:
        """Adam on the logistic loss over all rows, given as their indexed features."""
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n, w = len(rows), self.weights * 0
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], n), -30, 30)))
            g = np.bincount(flat, (p - labels)[owner], DIMENSIONS) / n + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = w

    def unpunctuated(self, text: str) -> bool:
        """A text of some length written without any punctuation, neither marked nor at a limit: it ends as it is written."""
        body = text.rstrip()
        return len(body.split()) > 20 and not _PAUSE.search(body) and not _MARK.search(body) and not _HALF_ESCAPE.search(body) and len(body) not in self.limits

    def score(self, text: str) -> float:
        if self.unpunctuated(text):
            return 0.0
        return self.probability(self.index(text))

    def probability(self, row: list[int]) -> float:
        z = float(self.weights[row].sum())
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def cut_artificially(text: str, limits: list[int], rng: random.Random) -> str | None:
    """A cut version of an intact value; None where it is too short to be cut."""
    if len(text) < 30:
        return None
    least = max(20, len(text) // 4)
    under = [x for x in limits if least <= x < len(text) - 2]
    at = rng.choice(under) if under and rng.random() < 0.4 else rng.randint(min(least, len(text) - 3), len(text) - 2)
    cut = text[:at]
    if rng.random() < 0.2:  # broken off within something that was opened
        stops = [m.end() for m in _LAST_STOP.finditer(text) if m.end() >= least]
        opening = rng.choice(OPENINGS)
        words = text[:at].split()
        inner = f"{rng.uniform(1, 500):.3g}" if "{" in opening else " ".join(words[: rng.randint(1, 4)]) if words else "x"
        if "`" in opening:
            inner = f"{words[0].lower() if words else 'x'} = ({rng.uniform(1, 500):.3g} +"
        elif rng.random() < 0.4 and len(inner) > 4 and "{" not in opening:
            inner = inner[: rng.randint(2, len(inner))] + rng.choice(["", ","])
        return (text[: rng.choice(stops)] if stops else cut.rstrip()) + opening + inner
    if not cut.strip() or cut.rstrip()[-1] in ".!?。":  # cut between two sentences: nobody could tell
        cut = text[: at - 4] if at > 30 else cut
    luck = rng.random()
    if luck < 0.2:
        cut = cut + rng.choice(CUT_MARKS)
    elif luck < 0.25:
        cut = cut + " " + rng.choice(CUT_MARKS[2:9])
    elif luck < 0.35:
        escape = rng.choice(_ESCAPES)
        cut += escape[: rng.randint(1, len(escape) - 1)]
    return cut


def train(texts: list[str], limits: list[int], seed: int = 11) -> Model:
    """Model of one field from a sample of its values."""
    rng = random.Random(seed)
    met: dict[str, int] = {}
    for t in texts:
        for w in set(words_of(fold(t))[:-1]):
            met[w] = met.get(w, 0) + 1
    known = frozenset(w for w, c in met.items() if c >= 2)
    model = Model(limits, known)
    at_limit = set(limits)
    bare = lambda t: _MARK.sub("", t.rstrip())
    bald = lambda t: t.rstrip()[-1:].isalnum() or t.rstrip()[-1:] == ","
    # What ends in a mark of cutting is no intact value to begin with, nor what ends bald at a limit, unless most values do.
    usual = sum(map(bald, texts)) > 0.75 * len(texts)
    whole = [t for t in texts if bare(t) == t.rstrip() and (usual or not (len(t) in at_limit and bald(t)))] or texts
    rows = [model.index(t) for t in whole]
    intact = range(len(whole))
    for rounds in (120, 120, 250):
        cuts = [c for i in intact if (c := cut_artificially(whole[i], limits, rng))]
        if not cuts or not intact:
            break
        model.fit([rows[i] for i in intact] + [model.index(c) for c in cuts], np.concatenate([np.zeros(len(intact)), np.ones(len(cuts))]), rounds)
        intact = [i for i, t in enumerate(whole) if model.unpunctuated(t) or model.probability(rows[i]) < THRESHOLD]
    return model


def bank_values(bank: DataFrame, record_id: str = "record_id") -> DataFrame:
    """(record_id, cand_pos, field, value_pos, data_source, model_name, value): one row per value that isn't blank."""
    candidates = bank.filter(F.col(record_id).isNotNull()).select(
        F.col(record_id).cast("bigint").alias("record_id"), "data_source", F.posexplode("candidates").alias("cand_pos", "c")
    )
    values = F.concat(
        F.array(F.struct(F.lit("response").alias("field"), F.lit(-1).alias("value_pos"), F.col("c.response").alias("value"))),
        F.coalesce(
            F.transform("c.reward_result.raw_judge_responses", lambda x, i: F.struct(F.lit("raw_judge_responses").alias("field"), i.alias("value_pos"), x.alias("value"))),
            F.array().cast("array<struct<field:string,value_pos:int,value:string>>"),
        ),
    )
    rows = candidates.select("record_id", F.col("cand_pos").cast("bigint"), "data_source", F.col("c.model_name").alias("model_name"), F.inline(values))
    return rows.filter(F.col("value").rlike(r"\S")).withColumn("value_pos", F.col("value_pos").cast("bigint"))


def survey(values: DataFrame) -> tuple[dict[str, list[int]], dict[str, tuple[int, int]]]:
    """Limits, and numbers of values and characters, of each field (field, value), in one pass over them.

    A limit is a length at which unfinished values pile up; lengths count without a mark of cutting.
    """
    end = F.right(F.rtrim("value"), F.lit(24))
    bare = F.regexp_replace(end, r"(?:…|\.\.\.|\s*\[(?:\.\.\.|truncated|cut)\]|<cut>|�+)$", "")
    unfinished = end.rlike(r"[\p{L}\p{N},\\]$") | (bare != end)
    rows = values.select("field", (F.length(F.rtrim("value")) - F.length(end) + F.length(bare)).alias("length"), unfinished.alias("u"))
    lengths = rows.groupBy("field", "length").agg(F.count(F.lit(1)).alias("all"), F.count_if("u").alias("n"))
    lengths = Stage(values.sparkSession).keep(lengths)  # one row for each length that occurs
    totals = {r["field"]: (r["n"], r["c"]) for r in lengths.groupBy("field").agg(F.sum("all").alias("n"), F.sum(F.col("all") * F.col("length")).alias("c")).collect()}
    around = lengths.filter("n > 0").select("field", "n", "length", F.explode(F.array([F.lit(k) for k in range(-4, 5)])).alias("step"))
    around = around.groupBy("field", (F.col("length") + F.col("step")).alias("length")).agg(F.sum("n").alias("sum"))
    peaks = lengths.filter(F.col("n") >= LEAST_AT_LIMIT).join(around, ["field", "length"]).filter(F.col("n") > PEAK * ((F.col("sum") - F.col("n")) / 8 + 1))
    limits: dict[str, list[int]] = {}
    for row in peaks.orderBy("field", F.desc("n"), "length").collect():  # peaks are few, whatever the number of values
        limits.setdefault(row["field"], []).append(row["length"])
    return limits, totals


def sampled(values: DataFrame, key: list[str], totals: dict[str, tuple[int, int]], sample: int) -> dict[str, list[str]]:
    """At most sample values of each field, those first by a hash of their key; the documented bound."""
    draw = F.pmod(F.xxhash64("field", *key), F.lit(1 << 30))
    share = F.lit(0)
    most = {field: min(sample, max(1, int(SAMPLE_CHARS * n / max(chars, 1)))) for field, (n, chars) in totals.items()}
    for field, (n, _) in totals.items():
        share = F.when(F.col("field") == field, int(min(1.0, 1.2 * most[field] / max(n, 1)) * (1 << 30))).otherwise(share)
    picked = values.filter(draw < share).select("field", draw.alias("draw"), *key, "value")
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("draw", *key).limit(max(1, 2 * sum(most.values()))).collect():
        if len(own := out.setdefault(r["field"], [])) < most[r["field"]]:
            own.append(r["value"])
    return out


def find_cut(bank: DataFrame, record_id: str = "record_id", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """bank_values without the value, with score and cut (boolean) for every value."""
    values = bank_values(bank, record_id)
    limits, totals = survey(values)
    drawn = sampled(values, ["record_id", "cand_pos", "value_pos"], totals, sample)
    models = {field: train(drawn[field], limits.get(field, [])) for field in sorted(drawn)}
    shared = bank.sparkSession.sparkContext.broadcast(models)
    columns = ["record_id", "cand_pos", "field", "value_pos", "data_source", "model_name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            scores = [models[f].score(v) for f, v in zip(batch.column("field").to_pylist(), batch.column("value").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())],
                names=[*columns, "score", "cut"],
            )

    return values.select(*columns, "value").mapInArrow(
        run, "record_id bigint, cand_pos bigint, field string, value_pos bigint, data_source string, model_name string, score double, cut boolean"
    )


def cut_cases(bank: DataFrame) -> DataFrame:
    """(record_id, cand_pos, field, value_pos) of the values that were cut."""
    return find_cut(bank).filter("cut").select("record_id", "cand_pos", "field", "value_pos")


def cut_report(bank: DataFrame) -> DataFrame:
    """Values, cut values and their share per field, data_source and model_name, and with either of them left out."""
    scored = Stage(bank.sparkSession).keep(find_cut(bank).select("field", "data_source", "model_name", "cut"))
    totals = scored.groupBy("field", "data_source", "model_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("k"))
    sums = [F.sum("n").alias("n_values"), F.sum("k").alias("n_cut"), (F.sum("k") / F.sum("n")).alias("share")]
    by = lambda level, source, model: totals.groupBy("field", source.alias("data_source"), model.alias("model_name")).agg(*sums).withColumn("level", F.lit(level))
    none = F.lit(None).cast("string")
    return by("data_source", F.col("data_source"), none).unionByName(by("model_name", none, F.col("model_name")))
