import random

from judgelake.llm import overlap
from judgelake.llm.text import number, slip, words

A = "Table 12 lists the lattice beside the crystal and gives 49.5 hours for Stythquulo. Is it true that the barrier of Drystras must explain the monomer, and why?"
B = "Neither the liability nor the due process limits the plaintiff past the month. Describe how Pruskalynd could mirror an easement without touching the negligence."


def pairs(spark, rows):
    schema = "record_id bigint, split_role string, data_source string, question string, key string, class string"
    df = spark.createDataFrame([(i, r, "s", q, "clash", "clash") for i, r, q in rows], schema)
    return {tuple(r) for r in overlap.overlap_pairs(df).collect()}


def test_variants(spark):
    rows = [
        (1, "train", A), (2, " Dev", A.upper()), (3, "TEST", "Please answer: " + A), (4, "held-out", A.replace("that", "taht").replace("why", "whhy")), (5, "dev", A.replace("49.5", "49.6")),
        (6, "dev", A.replace("Drystras", "Klorenta")), (7, "train", A), (8, "unknown", A), (9, None, A), (10, "dev", "  ".join(A.split())), (11, "dev", ". ".join(reversed(A[:-1].split(". "))) + "?"),
        (12, "train", B), (13, "dev", B.replace("the month", "month")), (14, "dev", None), (15, "dev", ""), (16, "train", " ?! "), (17, "dev", " ?! "), (18, "dev", A.replace("e", "е", 1)),
    ]
    expected = {tuple(sorted((t, e))) for t in (1, 7) for e in (2, 3, 4, 10, 11, 18)} | {(12, 13)}
    assert pairs(spark, rows) == expected


def test_repeats_and_empty(spark):
    assert pairs(spark, [(1, "train", A), (1, "train", A), (2, "dev", A), (2, "dev", A)]) == {(1, 2)}
    assert pairs(spark, [(1, "train", A), (1, "dev", A)]) == set()
    assert pairs(spark, []) == set()
    long = "word " * 20000 + "Kelpira 17"
    assert pairs(spark, [(1, "train", long), (2, "test", long + "!")]) == {(1, 2)}


def test_report(spark):
    df = spark.createDataFrame([(1, "train", "s", A), (2, "Dev", "s", A), (3, "dev", None, B)], "record_id bigint, split_role string, data_source string, question string")
    assert {tuple(r) for r in overlap.overlap_report(df).collect()} == {("dev", "s", 1, 1, 1), ("dev", None, 1, 0, 0)}


def test_words():
    assert words("Ｃａｆé​ NAÏVE 中文 1,5") == ["cafe", "naive", "中", "文", "1,5"]
    assert [number(x) for x in ("1,000", "01.50", "7,5", "0")] == ["1000", "1.5", "7.5", "0"]
    assert slip("taht", "that") and slip("wheen", "when") and not slip("late", "rare") and not slip("a", "b")


def test_common_words_only(spark):
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)})
    asked = [rng.sample(vocabulary, 18) for _ in range(2000)]
    rows = [(k, "train", " ".join(words)) for k, words in enumerate(asked)]
    for k in range(200):
        slipped = asked[k * 10][:]
        slipped[k % 18] += "x"
        rows.append((10_000 + k, "test", " ".join(slipped)))
    bank = spark.createDataFrame(rows, "record_id bigint, split_role string, question string")
    found = {(r[0], r[1]) for r in overlap.overlap_pairs(bank).collect()}
    assert found == {(k * 10, 10_000 + k) for k in range(200)}


def test_cells_change_nothing(spark, monkeypatch):
    rows = [(k, "train" if k % 2 else "dev", "What does the quiet harbour keep?" if k % 3 else f"What does the quiet harbour of Tol{'abcdefgh'[k % 8]}en keep?") for k in range(120)]
    bank = spark.createDataFrame(rows, "record_id bigint, split_role string, question string")
    whole = sorted(overlap.overlap_pairs(bank).collect())
    monkeypatch.setattr(overlap, "CELL", 7)
    assert sorted(overlap.overlap_pairs(bank).collect()) == whole and len(whole) > 1000
