import random
import re

import pytest

from stratalog.llm import jaccard_join
from stratalog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, rows):
    df = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def cluster(rng, n, words, rate):
    """Edited copies of one text, and copies of copies."""
    texts = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    for _ in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(max(2, int(words * rate)))):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(3)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(3)
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_dense_clusters(spark, seed):
    rng = random.Random(seed)
    texts = cluster(rng, 150, 120, 0.06) + cluster(rng, 60, 60, 0.05) + cluster(rng, 25, 9, 0.3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) + " " + passage for _ in range(40)]
    texts += [texts[3]] * 6 + ["", "  \n", "One", "one", "one two three", "ONE two three", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_blocks_and_flushes_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "QUERIES", 3)
    monkeypatch.setattr(jaccard_join, "PAIRS", 5)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 999)
    monkeypatch.setattr(jaccard_join, "SALT_ENTRIES", 50)
    rng = random.Random(5)
    rows = list(enumerate(cluster(rng, 80, 80, 0.08)))
    assert run(spark, rows) == brute(rows)


def test_prefix_lemma_holds_for_unequal_sizes():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 200)
        a = set(rng.sample(range(10**9), n))
        b = set(rng.sample(sorted(a), max(1, int(n * rng.uniform(0.75, 1))))) | set(rng.sample(range(10**9), rng.randrange(n // 4 + 1)))
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        (pa, na), (pb, nb) = jaccard_join.prefix_sizes(len(a)), jaccard_join.prefix_sizes(len(b))
        shared = len(set(sorted(a)[:pa]) & set(sorted(b)[:pb]))
        assert shared >= na and shared >= nb


def test_nulls_repeats_and_empty_tables(spark):
    assert run(spark, []) == {}
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(1, text, "a"), (1, "other " * 9, "b"), (2, text, "c"), (None, text, "d")], "doc_id long, text string, component string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(rows).collect() if r["doc_id"] is not None)
    assert got == [(False, 1, 1, 1), (False, 1, 26, 1), (False, 2, 26, 1)]
    assert [r["component_id"] for r in jaccard_join.near_duplicates(rows).where("doc_id IS NULL").collect()] == [None]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10**6), 120)
    links = list(zip(ids[:60], ids[1:60])) + [(ids[60], x) for x in ids[61:100]] + [(ids[100], ids[100])]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(ids[:60]) for x in ids[:60]} | {x: min(ids[60:100]) for x in ids[60:100]}


def test_stars_take_no_round(spark, monkeypatch):
    from stratalog.llm import components as module

    written = []
    monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(1) or cut(df))
    stars = [(i % 5, i) for i in range(5, 60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([(b, a) for a, b in stars], "a long, b long")).collect()}
    assert got == {i: i % 5 for i in range(60)} and len(written) == 1
    # A link between two stars, one from a centre to a smaller id, and a chain.
    links = [*((a + 100, b + 100) for a, b in stars), (107, 108), (0, 100), (201, 202), (202, 203), (203, 204)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i + 100: {0: 0, 3: 102}.get(i % 5, 100 + i % 5) for i in range(60)} | {0: 0} | dict.fromkeys(range(201, 205), 201)
    assert got == want
