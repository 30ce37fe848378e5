import random
import zlib

import numpy as np
import pytest

from stratalog.llm import packing, token_files
from stratalog.llm.tokens import ChunkTokenizer

PIECES = ["a", "Th", "é", " ", "  ", "\n", " \n", "'s", "'", "’", "12", "²", "_", "!!", "ß", "Σ", "İ", "\x01", "\x1c", "\xa0", "\t", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", "中", "ñ", "...", "'ll", "\x85", "Ⅷ", "é", "thane,", "Ergebnis."]


@pytest.fixture(scope="module")
def plain():
    """The library's own, as the file makes it, nothing set."""
    from tokenizers import Tokenizer

    from stratalog.llm.tokens import public_path

    return {k: Tokenizer.from_file(public_path(k)) for k in ("byte", "word")}


@pytest.fixture(scope="module")
def tokenizers():
    return {k: ChunkTokenizer(k) for k in ("byte", "word")}


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_equal_the_library(tokenizers, plain, kind):
    tok, rng = tokenizers[kind], random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(14))) for _ in range(4000)] + ["", "word " * 3000, "x" * 5000, "hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "A<|ENDOFTEXT|>b"]
    assert tok.encode([]) == []
    for text, ids in zip(texts, tok.encode(texts)):
        assert list(np.frombuffer(ids, tok.code)) == plain[kind].encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_every_token_is_reached_and_ids_ascend_in_merge_order(tokenizers, kind):
    import json

    from stratalog.llm.tokens import public_path

    model = json.load(open(public_path(kind), encoding="utf-8"))["model"]
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    assert ids == sorted(ids)
    # Merging the pieces of a token by the listed pairs, in order, ends with it.
    rank = {tuple(m): i for i, m in enumerate(merges)}
    rng = random.Random(0)
    for token in rng.sample(sorted(vocabulary), 3000):
        if token.startswith("<|"):
            continue
        word = token.removesuffix("</w>")
        parts = list(word)
        if word != token:
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 40))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = [parts[best] + parts[best + 1]]


def slow_lengths(counts, limit):
    """Package-merge on lists of symbols."""
    single = sorted((n, [s]) for s, n in enumerate(counts) if n)
    items = list(single)
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(items[::2], items[1::2])]
        items = sorted(single + pairs, key=lambda x: x[0])
    out = [0] * len(counts)
    for _, symbols in items[: 2 * len(single) - 2]:
        for s in symbols:
            out[s] += 1
    return out


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_code_lengths_are_optimal_within_the_limit(limit):
    rng = random.Random(limit)
    for n in (2, 3, 9, 16):
        counts = np.array([int(1.9 ** rng.randrange(20)) for _ in range(n)])
        got, want = token_files.code_lengths(counts, limit), slow_lengths(counts.tolist(), limit)
        assert got.max() <= limit and (got * counts).sum() == (np.array(want) * counts).sum()
        assert sum(2.0 ** -int(x) for x in got) == 1
    assert token_files.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and token_files.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(20, int), 4)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 9000])
def test_bits_round_trip_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.6, n).astype(np.int64), 499)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=500))
    payload, checkpoints = token_files.pack_bits(ids, token_files.canonical_codes(lengths), lengths)
    tables = token_files.decoding_tables(lengths)
    if n:
        assert (token_files.unpack_bits(payload, checkpoints, n, tables) == ids).all()
    for block in range(len(checkpoints) // 8):
        k = min(token_files.BLOCK, n - block * token_files.BLOCK)
        one = token_files.unpack_bits(payload, checkpoints[8 * block : 8 * block + 8], k, tables)
        assert (one == ids[block * token_files.BLOCK :][:k]).all()


def test_files_round_trip(spark, plain, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "Ergebnis", "x1!", "ñandú"], k=rng.randrange(40)))) for i in rng.sample(range(1000), 60)]
    rows += [(None, "no id"), (2000, None), (2001, ""), (2002, "same"), (2002, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = token_files.round_trip(df, with_ids=True).collect()
    at = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, t), r in zip(ordered, sorted(got, key=lambda r: r["start"]), strict=True):
        ids = plain["word"].encode(t or "", add_special_tokens=False).ids + [1]
        packed = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, at, len(ids), zlib.crc32(packed), packed)
        at += len(ids)
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_pack(lengths, capacity):
    """Best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plans_pack_everything_and_are_no_worse_than_best_fit(seed):
    rng, capacity = random.Random(seed), 64
    lengths = [min(capacity, int(rng.expovariate(0.06)) + 1) for _ in range(rng.randrange(1, 900))]
    demand = np.bincount(lengths, minlength=capacity + 1)
    for plan in (packing.best_fit(demand, capacity), packing.rounded(packing.fractional(demand, capacity), demand, capacity), packing.solve(demand, capacity)):
        packed = np.zeros(capacity + 1, int)
        for held, n in plan:
            assert sum(held) <= capacity and n > 0
            for x in held:
                packed[x] += n
        assert (packed == demand).all()
    assert sum(n for _, n in packing.best_fit(demand, capacity)) == brute_pack(lengths, capacity)
    assert packing.lower_bound(demand, capacity) <= sum(n for _, n in packing.solve(demand, capacity)) <= brute_pack(lengths, capacity)


def test_packing_of_documents(spark, plain):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "Ergebnis", "x1!"], k=rng.randrange(60)))) for i in range(60)] + [(100, None), (101, ""), (102, "word " * 200), (102, "word " * 200), (None, "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string")
    got = packing.pack_documents(df, capacity=32, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in rows[:62]:
        ids, at = plain["byte"].encode(t or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"], bytes(r["ids"])) == (k, at, zlib.crc32(part), part) and (k == 0 or r["length"] == 32)
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert len(by_doc[102]) == 2 * len({r["piece"] for r in by_doc[102]})
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
