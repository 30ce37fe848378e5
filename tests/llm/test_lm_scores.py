import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import lm_scores as lm


def texts(rng, n):
    """Two languages: a word tells which one follows."""
    out = []
    for i in range(n):
        language = rng.choice(["a", "b"])
        out.append((i, " ".join(f"{language}{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(20, 120)))))
    return out


def check(got, rows):
    seen = Counter()
    for d, t in rows:
        if not lm.held_out(d):
            seen.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(seen.values()), len(seen)
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 10 == 0, len(words), sum(w in seen for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


@pytest.mark.parametrize("head", [60_000, 30, 0])
def test_scores_and_the_shuffle_join_beyond_the_head(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "KNOWN", 2 * head)
    monkeypatch.setattr(lm, "FLUSH_WORDS", 25)
    rng = random.Random(1)
    rows = texts(rng, 400) + [(1000, None), (1001, ""), (1002, "Ünseen WORD"), (1003, "A1 a1\x0bB2")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")).collect()}
    check(got, rows)
    held = [r for r in got.values() if r["held_out"]]
    base, model = sum(r["base_score"] for r in held), sum(r["score"] for r in held)
    assert model <= 0
    if head == 60_000:
        assert model > base + 0.02 * sum(r["n_tokens"] for r in held)


def test_score_equals_a_plain_sum_over_all_items(spark, monkeypatch):
    """Each token's probability by a softmax over classes and one over the class's
    items, written out token by token."""
    monkeypatch.setattr(lm, "HEAD", 30)
    monkeypatch.setattr(lm, "KNOWN", 50)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda table, items, *rest: kept.setdefault("m", train(table, items, *rest)))
    rows = texts(random.Random(5), 60) + [(900, "never seen"), (901, "a1 " * 9000)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m, items = kept["m"], kept["m"].items
    seen = Counter(w for d, t in rows if not lm.held_out(d) for w in lm.tokens(t))
    mass, types = Counter(), Counter()
    head = sorted(seen, key=lambda w: (-seen[w], w))[: lm.HEAD]
    for w, c in seen.items():
        if w not in head:
            mass[lm.band_of(w)] += c
            types[lm.band_of(w)] += 1
    memo = {}

    def log_p(context, w):
        if (context, w) not in memo:
            h = sum(m.s[j] * m.r[items.item(x)] for j, x in enumerate(context)).astype(np.float64)
            i = items.item(w)
            k = items.cls[i]
            s = m.c[:, :-1] @ h + m.c[:, -1]
            own = slice(items.start[k], items.start[k] + items.size[k])
            t = m.q[own, :-1] @ h + m.q[own, -1]
            p = s[k] - np.log(np.exp(s).sum()) + t[i - items.start[k]] - np.log(np.exp(t).sum())
            b = lm.band_of(w)
            memo[context, w] = p / np.log(10) + (0 if w in head else math.log10((seen[w] + 0.1) / (mass[b] + 0.1 * (types[b] + 1))))
        return memo[context, w]

    for d, text in rows:
        ws = lm.tokens(text)
        before = [lm.END] * lm.ORDER + ws
        want = sum(log_p(tuple(before[i + lm.ORDER - 1 - j] for j in range(lm.ORDER)), w) for i, w in enumerate(ws))
        assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_scores_do_not_depend_on_partitions_or_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "PORTION", 3000)
    rows = texts(random.Random(2), 300)
    turned = rows[::-1]

    def scores(rows, n):
        return {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()}

    one, eight = scores(rows, 1), scores(turned, 8)
    assert all(eight[d] == pytest.approx(s, rel=1e-5, abs=1e-4) for d, s in one.items())


def small_items(n=9):
    words = [b"w%d" % i for i in range(n)]
    return lm.Items(words, np.array([50.0 / (i + 1) for i in range(n)]), np.full(lm.BANDS, 0.5), n), words


def test_probabilities_sum_to_one():
    items, _ = small_items()
    model = lm.Model(items)
    trainer, rng = lm.Trainer(model, 0), np.random.default_rng(0)
    for _ in range(30):
        trainer.learn(rng.integers(0, items.n, (200, lm.ORDER)), rng.integers(0, items.n, 200))
    for _ in range(3):
        context = np.repeat(rng.integers(0, items.n, (1, lm.ORDER)), items.n, axis=0)
        assert np.exp(model.log_p(context, np.arange(items.n))).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("back", [0, 2])
def test_noise_contrast_learns_which_word_follows(back):
    """The target follows from the word ``back`` places before the last one."""
    items, words = small_items(8)
    ids = np.array([items.item(w) for w in words])
    rng = np.random.default_rng(3)
    target = rng.integers(0, 8, 120_000)
    context = rng.integers(0, 8, (120_000, lm.ORDER))
    context[:, back] = np.where(rng.random(120_000) < 0.95, (target + 1) % 8, context[:, back])
    model = lm.Model(items)
    trainer = lm.Trainer(model, 1)
    for a in range(0, 120_000, 500):
        trainer.learn(ids[context[a : a + 500]], ids[target[a : a + 500]])
    sure = model.log_p(*(x[np.argsort(ids[target[:4000]])] for x in (ids[context[:4000]], ids[target[:4000]])))
    assert sure.mean() > np.log(0.4)


def test_ties_at_the_border_of_the_known_words(spark, monkeypatch):
    counted = spark.createDataFrame([(b"a", 9), (b"b", 5), (b"c", 5), (b"d", 5), (b"e", 1)], "word binary, c long")
    for head, want in ((0, []), (1, [b"a"]), (3, [b"a"]), (4, [b"a", b"b", b"c", b"d"]), (9, [b"a", b"b", b"c", b"d", b"e"])):
        monkeypatch.setattr(lm, "KNOWN", head)
        words, count, least = lm._known(counted)
        assert words == want and all(c >= least for c in count)
        assert counted.where(f"c >= {least}").count() == len(want)


def test_bands_are_alike_in_both_languages_of_the_code(spark):
    words = [b"", b"a", b"ab", b"abc", "héé".encode(), b"longer word"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(w,) for w in words], "word binary")
    got = [r[0] for r in df.select(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(lm.BANDS))).collect()]
    assert got == [lm.band_of(w) for w in words]


def test_gathers_with_the_input_and_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = lm.score(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    assert got[0]["base_score"] == pytest.approx(0.0) and got[0]["score"] <= 0
