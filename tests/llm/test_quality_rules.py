import random
import re
from collections import Counter

from pyspark.sql import functions as F

from stratalog.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c d a b c", "x\x0by\x0cz", "ü ü ü\nü ü ü\n\n#|", "1 2 3 4 1 2 3 9 2 3 4"]
    texts += [" ".join(rng.choice("abcdé1") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "of", "12 "]) for _ in range(20_000)), "w" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.measure(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "few words", "# " * 60, good + " " + "$" * 30, "a b c " * 40]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    book = q.ledger(df).persist()
    assert [r["kept"] for r in q.apply_policy(book, "v1").orderBy("doc_id").collect()] == [True, False, False, False, False]
    assert [r["kept"] for r in q.apply_policy(book, "base").orderBy("doc_id").collect()] == [True, False, False, True, False]
    rows = {r["rule"]: r for r in q.ablations(book, "v1").collect()}
    masks = [r["fail_mask"] & q.mask_of(q.POLICIES["v1"]) for r in book.collect()]
    bits = {r.name: 1 << r.bit for r in q.RULES}
    for name, r in rows.items():
        assert r["n_rejected"] == sum(m & bits[name] != 0 for m in masks) and r["n_only_by_it"] == sum(m == bits[name] for m in masks)
        assert r["n_docs"] == 5 and r["n_kept"] == 1
    assert q.ablations(book.withColumn("g", F.lit("x")), "base", "g").count() == 2
    book.unpersist()


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.apply_policy(q.ledger(empty)).count() == 0
    plan = q.ledger(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
