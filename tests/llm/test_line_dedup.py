import random
from collections import defaultdict

import pytest

from stratalog.llm import line_dedup
from stratalog.llm.base import SPACE_CHARS


def brute(rows, min_words):
    """For each line, the longest run from it that stands at an earlier place too,
    without overlap, found by comparing line by line; rows are (doc_id, text), ids
    unique."""
    places, kept = defaultdict(list), {}
    ordered = [(d, t or "", [x.strip(SPACE_CHARS) for x in (t or "").split("\n") if x.strip(SPACE_CHARS)]) for d, t in sorted(rows, key=lambda r: r[0])]
    for k, (d, text, lines) in enumerate(ordered):
        gone = [False] * len(lines)
        for i, line in enumerate(lines):
            best = 0
            for other, j in places[line]:
                theirs, m = ordered[other][2], 0
                while i + m < len(lines) and j + m < len(theirs) and lines[i + m] == theirs[j + m]:
                    m += 1
                # In the same text the earlier copy must end before this one begins.
                best = max(best, min(m, i - j) if other == k else m)
            places[line].append((k, i))
            if sum(len(x.split()) for x in lines[i : i + best]) >= min_words:
                gone[i : i + best] = [True] * best
        out, at, deleting = [], 0, False
        for line in text.split("\n"):
            if line.strip(SPACE_CHARS):
                deleting = gone[at]
                at += 1
            if not deleting:
                out.append(line)
        kept[d] = (len(lines), sum(gone), "\n".join(out))
    return kept


def run(spark, rows, min_words):
    df = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words, report=True)
    return {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"] or "") for r in df.collect()}


@pytest.mark.parametrize("min_words", [3, 8, 50])
def test_equals_brute_force(spark, min_words, monkeypatch):
    monkeypatch.setattr(line_dedup, "BATCH_ROWS", 40)
    rng = random.Random(min_words)
    vocabulary = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5, 12, 60]))) for _ in range(25)]
    passage = [f"passage line {i} with some words in it" for i in range(9)]
    rows = []
    for d in range(90):
        lines = [rng.choice([*vocabulary, "", f"own {d} {rng.random()}"]) for _ in range(rng.randrange(14))]
        if rng.random() < 0.4:
            a = rng.randrange(3)
            k = rng.randrange(len(lines) + 1)
            lines[k:k] = passage[a : a + rng.randrange(1, 9)]
        rows.append((d, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "\n".join(["again and again"] * 40)), (205, " a \n\n b\t\n")]
    rng.shuffle(rows)
    assert run(spark, rows, min_words) == brute(rows, min_words)


def test_long_passages_go_and_clean_texts_stay(spark):
    passage = "\n".join(f"this is line number {i} of a passage of many words" for i in range(6))
    clean = "\n".join(f"clean {i} text that nobody else has written down" for i in range(30))
    rows = [(1, "intro one\n" + passage + "\noutro one"), (2, clean), (3, "intro two\n" + passage + "\noutro two"), (4, "short\nlines\nonly"), (5, "short\nlines\nonly")]
    got = run(spark, rows, 50)
    assert got[1][1] == 0 and got[2][1] == 0 and got[4][1] == 0 and got[5][1] == 0
    assert got[3] == (8, 6, "intro two\noutro two")


def test_repeats_nulls_clashing_columns_and_empty_table(spark):
    text = "\n".join(f"line {i} of some words" for i in range(20))
    rows = [(1, text, 7, "x"), (1, text, 8, "y"), (None, text, 9, "z"), (3, text, 10, "w")]
    df = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, seq int, runs string"))
    assert df.columns == ["doc_id", "text", "seq", "runs"]
    got = sorted((r["seq"], r["runs"], bool(r["text"])) for r in df.collect())
    # The null id comes first and keeps its text; equal rows share their lot.
    assert got == [(7, "x", False), (8, "y", False), (9, "z", True), (10, "w", False)]
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_copy_stays_where_copies_overlap(spark):
    rows = [(1, "\n".join(["x"] * 120)), (2, "\n".join(["again and again"] * 40)), (3, "\n".join(["a b c", "d e"] * 30))]
    got = run(spark, rows, 50)
    assert got == brute(rows, 50)
    assert [len(got[d][2].split()) for d in (1, 2, 3)] == [50, 51, 50]


def test_join_counted_splits_heavy_keys(spark, monkeypatch):
    from stratalog.llm import base

    monkeypatch.setattr(base, "HEAVY", 3)
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 100) for i in range(60)], "id long, k long")
    table = rows.groupBy("k").count().where("k <> 3").selectExpr("k", "count AS n", "k * 10 AS v")
    got = base.join_counted(rows, table, ["k"], "n", ["id"], rows.count())
    assert got.columns == ["id", "k", "v"]
    assert sorted(map(tuple, got.collect())) == sorted((i, k, None if k == 3 else 10 * k) for i, k in ((i, i % 7 if i % 2 else 100) for i in range(60)))
