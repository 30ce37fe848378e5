import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from stratalog.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger().fit(*pii.training_windows([]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "@", ".", "b.c", "-", "+", "1", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", "(", ")", " ", "é", "_%", "x@y.z", "1.2.3.4", "+1 (017) 555-7713", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    t = pii.Tagger()
    t.p = {k: rng.normal(0, 0.4, v.shape) for k, v in t.p.items()}
    x, y = rng.integers(1, 90, (2, 6)), rng.integers(0, pii.TAGS, (2, 6))

    def likelihood():
        e = t.emissions(x).astype(float)
        total = 0.0
        for w in range(2):
            paths = np.zeros(pii.TAGS)
            paths = e[w, 0].copy()
            score = e[w, 0, y[w, 0]]
            for k in range(1, 6):
                m = paths[:, None] + t.p["trans"]
                paths = np.log(np.exp(m - m.max(0)).sum(0)) + m.max(0) + e[w, k]
                score += t.p["trans"][y[w, k - 1], y[w, k]] + e[w, k, y[w, k]]
            total += score - (np.log(np.exp(paths - paths.max()).sum()) + paths.max())
        return total / 2

    grad = t.gradient(x, y)
    for name in t.p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in t.p[name].shape) if name != "emb" else (int(x[0, rng.integers(6)]), int(rng.integers(pii.EMBEDDED)))
            kept = t.p[name][at]
            values = []
            for d in (1e-3, -1e-3):
                t.p[name][at] = kept + d
                values.append(likelihood())
            t.p[name][at] = kept
            assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.03, abs=2e-3), name


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    t = pii.Tagger()
    t.p["trans"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    scores = [rng.normal(0, 1, (n, pii.TAGS)).astype(np.float32) for n in (1, 3, 2, 4, 1)]
    for s, path in zip(scores, t.viterbi(scores)):
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(t.p["trans"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(pii.TAGS), repeat=len(s)), key=value)
        assert value(path.tolist()) == pytest.approx(value(best), abs=1e-4)


def test_held_out_spellings_are_found_and_clean_text_is_left_alone(tagger):
    rng = np.random.Generator(np.random.PCG64(999))
    hit = personal = false = clean = 0
    for _ in range(300):
        spelling, kind = pii.generated(rng)
        text = "Once upon a time there was " + spelling + " and then it went on for a while."
        base = pii.base_spans(text)
        every = base + pii.added(text, base, pii.decode(tagger, [text])[0])
        if kind and pii.well_formed(kind, spelling):
            personal += 1
            hit += any(k == kind for k, _, _ in every)
        elif not kind:
            clean += 1
            false += bool(every)
    assert hit > 0.8 * personal and false < 0.05 * clean
    long = "no personal data here, only words. " * 3000
    assert pii.decode(tagger, [long]) == [[]]


def test_spans_over_window_edges_are_found_whole(tagger):
    for shift in range(0, 64, 7):
        text = "x" * shift + " some words (243) 555-5526 and more words after that to fill"
        found = pii.added(text, [], pii.decode(tagger, [text])[0])
        assert all(text[a:b].startswith("(243)") and text[a:b].endswith("5526") for _, a, b in found)


def test_documents(spark, tagger):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (None, "1.2.3.4"), (4, "call (243) 555-5526 today"), (4, "plain")]
    df = pii.find(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string"), tagger)
    got = df.collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == "email:5:13" and by[1]["n_email"] == 1 and by[1]["base_sha256"] == hashlib.sha256(b"email:5:13").hexdigest()
    assert by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[None]["n_ip"] == 1
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"), tagger).count() == 0


@pytest.mark.parametrize("kind, spelling", [("phone", "555.123.4567"), ("phone", "5551234567"), ("email", "john_at_example_dot_com"), ("email", "john {at} example.com"), ("email", "john <at> example.com"), ("email", "name [at] host\n[dot] org")])
def test_spellings_without_a_pattern_are_added(tagger, kind, spelling):
    hits = 0
    for before, after in (("Once upon a time there was ", " and then it went on for a while."), ("You can reach me under ", " or after six, she said."), ("the report of the house was sent by ", " to the others who had gone")):
        text = before + spelling + after
        hits += (kind, len(before), len(before) + len(spelling)) in pii.added(text, [], pii.decode(tagger, [text])[0])
    assert hits >= 2


def test_decoded_spans_add_every_spelling_and_unknown_ones():
    text = "(243) 555-5526, (243) 555-5527"
    assert pii.added(text, [], [("phone", 0, len(text))]) == [("phone", 0, 14), ("phone", 16, 30)]
    assert pii.added("=bob AT host DOT org=", [], [("email", 0, 21)]) == [("email", 1, 20)]
    assert pii.added("<bob -at- host -dot- org>", [], [("email", 0, 25)]) == [("email", 1, 24)]
    assert pii.added("555_123_4567", [], [("phone", 0, 12)]) == [("phone", 0, 12)]
    assert pii.added("bob and org, 12345678", [], [("email", 0, 11), ("phone", 13, 21)]) == []


def test_all_zones_of_a_sampled_text_are_learned():
    text = ("1 " + "x" * 200) * 9
    assert len(pii.zones(text)) == 9
    assert len(pii.training_windows([text])[0]) - len(pii.training_windows([""])[0]) > 12


def test_secrets_are_found_and_told_apart(spark, tagger):
    secret = "0c497b5014f705c0be648d68b816f88c209136eb"
    rows = [(1, f'the house token = "{secret}" was there and then it went on for a while'), (2, "Once upon a time there was a house of 12 rooms and 1200 windows, built in 1911."), (3, f"mail a.b@c.de or {secret} now")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    at = rows[0][1].index(secret)
    assert got[1]["secrets"] == f"secret:{at}:{at + 40}" and got[1]["spans"] == "" and (got[1]["n_spans"], got[1]["n_found"]) == (0, 1)
    assert got[2]["n_found"] == 0
    assert got[3]["n_found"] == 2 and got[3]["n_secrets"] == 1 and got[3]["spans"] == "email:5:13"


def test_the_sample_is_bounded_and_equal_rows_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "training_windows", lambda texts: seen.append(texts) or (None, None))
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, x, y: self)
    rows = [(7, "call 1 now")] * 300 + [(None, "call 2 now")] * 50 + [(i, f"number {i}") for i in range(40)] + [(99, "none here"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pii.fit(docs, sample=1000)
    assert sorted(seen[-1]) == sorted({t for _, t in rows if t and any(c in "0123456789@" for c in t)})
    pii.fit(docs, sample=5)
    assert len(seen[-1]) == 5
    pii.fit(docs.limit(0))
    assert seen[-1] == []


def test_find_learns_from_its_documents(spark):
    text = "Once upon a time there was a house and the number was {} and then it went on for a while as nobody was home. " * 3
    rows = [(i, text.format(i, f"a{i}@b.org", f"10.0.0.{i}")) for i in range(40)] + [(100, "You can reach me under (243) 555-5526 or after six, she said.")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_email"] == got[i]["n_ip"] == 1 for i in range(40))
    assert got[100]["n_added"] == 1 and got[100]["spans"] == "phone:23:37"
