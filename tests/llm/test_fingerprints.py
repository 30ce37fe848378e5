import hashlib
import random

import numpy as np
import pytest

from stratalog.llm import fingerprints as fp


def gear(data):
    h, out = 0, []
    for i in range(len(data)):
        h = sum(int(fp.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % 2**32
        out.append(h)
    return out


def chunks(data):
    """One byte at a time, from the definition."""
    h, out, at = gear(data), [], 0
    while at < len(data):
        end = at + 1
        while end < len(data):
            n = end - at
            bits = fp.HARD if n < fp.NORMAL else fp.EASY
            if n >= fp.MAXIMUM or n >= fp.MINIMUM and h[end - 1] >> (32 - bits) == 0:
                break
            end += 1
        out.append((at, end))
        at = end
    return out


def test_boundaries_equal_the_definition():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (0, 1, 31, 32, 33, 64, 500, 3000)] + [b"a" * 1000]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    text, a, b = fp.chunk_ends(fp.gear_hashes(np.frombuffer(b"".join(texts), np.uint8)), starts, ends)
    for i, t in enumerate(texts):
        got = sorted((x - starts[i], y - starts[i]) for k, x, y in zip(text, a, b) if k == i)
        assert got == chunks(t)


def test_insertions_move_few_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(1500))
    a = fp.fingerprint(text)
    assert fp.containment(a, a) == 1 and fp.fingerprint(text) == a
    assert fp.containment(a, fp.fingerprint("inserted at the start " + text)) > 0.97
    assert fp.containment(a, fp.fingerprint(text[:4000] + "XX" + text[4000:])) > 0.95
    assert fp.containment(fp.fingerprint(text[:3000]), a) > 0.9
    assert fp.containment(a, fp.fingerprint("".join(rng.choices("klmnop ", k=9000)))) < 0.05


@pytest.mark.parametrize("partitions", [1, 4])
def test_edits_equal_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(fp, "SLICE_CHARS", 700)
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choices("abc dé\n", k=rng.randrange(400)))) for i in range(80)]
    rows += [(1, None), (4, ""), (7, rows[0][1]), (240, "z"), (None, "no id")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        shuffled = rng.sample(rows, len(rows))
        got = {r["doc_id"]: r for r in fp.with_edits(spark.createDataFrame(shuffled, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.fingerprint(t) and r["edited_fingerprint"] == fp.fingerprint(edited)
        assert r["near_edited"] == pytest.approx(fp.containment(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(fp.containment(r["fingerprint"], fp.fingerprint(nxt)))


def test_one_row_repeats_and_empty_table(spark):
    one = fp.with_edits(spark.createDataFrame([(5, "abc", 1)], "doc_id long, text string, own int")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = fp.with_edits(spark.createDataFrame([(5, "abc"), (5, "abc"), (5, "abd")], "doc_id long, text string")).collect()
    assert len(same) == 3
    assert fp.with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
