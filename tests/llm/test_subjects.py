import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from judgelake.llm import subjects

TERMS = {"biology": ["enzyme", "stem cell", "pollen", "habitat"], "law": ["verdict", "burden of proof", "tenant", "court"], "sport": ["referee", "penalty kick", "medal", "sprint"]}
FORMS = ["The {a} slowly changes the {b}.", "Nobody expected that the {a} follows the {b}.", "Here the {a} stands beside the {b}.", "Both the {a} and the {b} appeared late."]


def text(subject_counts, rng):
    out = [rng.choice(FORMS).format(a=rng.choice(TERMS[s]), b=rng.choice(TERMS[s])) for s, n in subject_counts for _ in range(n)]
    return " ".join(out + ["Open the page to see more entries."])


def frames(spark, n=150):
    rng = random.Random(2)
    names = list(TERMS)
    rows, truth = [], {}
    for i in range(n):
        main, other = rng.sample(names, 2)
        both = rng.random() < 0.3
        rows.append((i, text([(main, 4), (other, 4 if both else 1)], rng), "S ", "clash"))
        truth[i] = {main, other} if both else {main}
    labels = [(i, s.upper() if i % 5 else s, "a") for i in range(0, n, 2) for s in truth[i]] + [(2, "cooking", "a"), (None, "law", "a"), (4, None, "a")]
    rows += [(9001, None, None, "c"), (9002, " ", None, "c"), (9003, "Open the page.", None, "c"), (0, rows[0][1], "s", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, subject string")
    return docs, spark.createDataFrame([*labels, labels[0]], "doc_id bigint, subject string, annotator string"), spark.createDataFrame([(s, s, s) for s in names], "subject string, title string, description string"), truth


def test_held_out_accuracy(spark):
    docs, labels, areas, truth = frames(spark)
    got = {}
    rows = subjects.find_subjects(docs, labels, areas).collect()
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len({(r["doc_id"], r["subject"]) for r in rows}) == len(rows)
    assert not {9001, 9002, 9003} & set(got)
    held = [i for i in truth if i % 2]
    assert sum(got.get(i) == truth[i] for i in held) > 0.9 * len(held)
    assert {r["source"] for r in subjects.subject_report(docs, labels, areas).collect()} == {"s"}


def test_empty(spark):
    docs, labels, areas, _ = frames(spark, 10)
    assert subjects.find_subjects(docs, labels.limit(0), areas).count() == 0
    assert subjects.find_subjects(docs.limit(0), labels, areas).count() == 0
    assert subjects.find_subjects(docs, labels, areas.limit(0)).count() == 0


def test_sentences():
    assert [" ".join(s) for s in subjects.sentences("One two.\nThree four\nfive six. 酶很少。细胞膜。")] == ["one two", "three four five six", "酶 很 少", "细 胞 膜"]


def test_terms_are_ranked_within_their_subject_and_script(spark):
    rows = [(f"plain{i}", 2, 900.0) for i in range(50)]  # sentences without subject
    rows += [(f"law{i}", 1, 90.0 - i) for i in range(20)] + [("shared", 0, 20.0), ("shared", 1, 20.0), ("shared", 2, 20.0)]
    rows += [("酶 很", 0, 4.0), ("суд", 1, 4.0), ("rare", 0, 2.0), ("common", 0, 5.0), ("common", 1, 50.0)]
    counts = spark.createDataFrame(rows, "term string, subject int, n double")
    got = subjects.weigh(counts, [100.0, 1000.0, 9000.0], 3, 1.2, 2, 5)
    assert sum(t.startswith("law") for t in got) == 5
    assert {"酶 很", "суд", "shared"} <= set(got)
    assert not any(t.startswith("plain") or t == "rare" for t in got)
    assert got["shared"].keys() == {0}
    assert got["shared"][0] == round((math.log(20.2 / 101) - math.log(40.2 / 10001)) * 20 / 21, 4)


def test_every_labelled_document_is_learned_from(spark):
    rng = random.Random(3)
    last = [r[0] for r in spark.range(12_040).orderBy(F.xxhash64("id").desc()).limit(40).collect()]  # in a draw by hash of 12,000 there were none of them
    rare = {"music": ["violin", "sonata", "choir", "grand piano"]}
    about = {i: "music" if i in set(last) else rng.choice(list(TERMS)) for i in range(12_040)}
    words = TERMS | rare
    rows = [(i, " ".join(rng.choice(FORMS).format(a=rng.choice(words[s]), b=rng.choice(words[s])) for _ in range(4)), "s") for i, s in about.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, s, "a") for i, s in about.items()], "doc_id bigint, subject string, annotator string")
    areas = spark.createDataFrame([(s, s, s) for s in words], "subject string, title string, description string")
    got = {r["doc_id"] for r in subjects.find_subjects(docs, labels, areas).filter("subject = 'music'").collect()}
    assert got == set(last)


def test_thresholds_come_from_all_labels(spark, monkeypatch):
    docs, labels, areas, truth = frames(spark)
    seen = []
    real = subjects._thresholds
    monkeypatch.setattr(subjects, "_thresholds", lambda tried, held, *rest: seen.append((tried, held)) or real(tried, held, *rest))
    subjects.find_subjects(docs, labels, areas)
    ((tried, held),) = seen
    assert {r["doc_id"] for r in held.collect()} == {i for i in truth if i % 2 == 0}
    assert len({r["doc_id"] for r in tried.collect()}) > 70


def term_candidates(words):
    out = set()
    for i, w in enumerate(words):
        plain = [not (x[0].isdigit() or subjects._HAN.match(x)) for x in words[i : i + 3]]
        if subjects._HAN.match(w):
            for k in range(2, 5):
                if i + k <= len(words) and all(map(subjects._HAN.match, words[i : i + k])):
                    out.add(" ".join(words[i : i + k]))
        elif plain[0] and len(w) > 2:
            out.add(w)
            if len(w) > 3 and len(plain) > 1 and plain[1]:
                if len(words[i + 1]) > 3:
                    out.add(" ".join(words[i : i + 2]))
                elif len(plain) > 2 and plain[2] and len(words[i + 2]) > 3:
                    out.add(" ".join(words[i : i + 3]))
    return out


def test_term_counts():
    rng = random.Random(4)
    of = ["a", "of", "the", "12", "1.5", "burden", "proof", "суд", "закон", *"酶很少细胞膜"]
    lines = [" ".join(rng.choices(of, k=rng.randint(1, 12))) for _ in range(400)] + [""]
    classes = np.array([rng.randrange(3) for _ in lines])
    terms, cls, n = subjects.term_counts(lines, classes)
    wanted = Counter((t, int(c)) for line, c in zip(lines, classes, strict=True) if line for t in term_candidates(line.split(" ")))
    assert len(terms) == len(wanted)
    assert dict(zip(zip(terms.to_pylist(), cls.tolist(), strict=True), n.tolist(), strict=True)) == wanted
    assert len(subjects.term_counts(["12 of"], np.array([0]))[0]) == 0
