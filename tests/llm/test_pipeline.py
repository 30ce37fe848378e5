import random
from collections import Counter

import corpus_pipeline
import duckdb
import test_jaccard_join
import test_line_dedup
import test_quality_rules

from stratalog.llm import mixing, packing, quality_rules
from stratalog.llm import queries as llm_queries
from stratalog.llm.tokens import ChunkTokenizer


def corpus():
    rng = random.Random(12)
    sentence = lambda: " ".join(f"{rng.choice('abcdefgh')}word{rng.randrange(3000)}" for _ in range(rng.randrange(6, 14))) + "."
    passage = [sentence() for _ in range(8)]
    texts = ["\n".join(sentence() for _ in range(rng.randrange(6, 30))) for _ in range(60)]
    texts += ["\n".join([sentence(), *passage, sentence(), sentence(), sentence(), sentence(), sentence()]) for _ in range(6)]
    texts += [texts[2], texts[2], texts[5]]
    texts += [t.replace(t.split()[7], "changed").replace("\n", " ") for t in texts[10:18]]
    texts += ["spam spam spam " * 60, "few words", "# $ % " * 80, "", None]
    rng.shuffle(texts)
    return [(i, t, "en", rng.choice(["one", "one", "two", None]), len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_quality(text):
    n, chars, symbols, dup, repeats = test_quality_rules.brute(text)
    words = (text or "").split()
    lines = len([x for x in (text or "").split("\n") if x.strip()])
    letters = sum(any(c.isalpha() for c in w) for w in words)
    return not (n < 50 or 100 * repeats > 50 * n or 100 * symbols > 10 * n or 100 * dup > 50 * lines or 100 * letters < 60 * n or chars < 2 * n or chars > 20 * n)


def test_stages_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, ""))
        outs.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in outs[:-1])

    want = {d: t for d, t, *_ in rows if kept_by_quality(t)}
    assert {r["doc_id"]: r["text"] for r in outs[0].collect()} == want and len(want) > 60

    want = {d: t for d, (_, _, t) in test_line_dedup.brute(list(want.items()), 50).items() if t.strip()}
    got = outs[1].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)

    want = {d: want[d] for d, (_, c) in test_jaccard_join.brute(list(want.items())).items() if c == d}
    assert {r["doc_id"]: r["text"] for r in outs[2].collect()} == want

    mixed = outs[3].collect()
    assert {r["doc_id"]: r["text"] for r in mixed} == want
    order = {(r["source"], r["doc_id"]): (r["slot"], r["place"]) for r in mixing.schedule(outs[2]).collect()}
    assert {(r["source"], r["doc_id"]) for r in mixed} == set(order)
    in_order = [order[r["source"], r["doc_id"]] for r in corpus_pipeline.mixed(spark, outs[2], "").collect()]
    assert in_order == sorted(in_order)

    tok, pieces = ChunkTokenizer("byte"), outs[4].collect()
    sizes = Counter()
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {d: len(tok.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(sizes.values()) // packing.CAPACITY) + 2


def test_empty_repeated_null_and_clashing_rows(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(10)) for i in range(8))
    for rows in ([], [(None, text, "en", None, 1), (None, text + " more", "en", None, 1), (3, text + "\nown words here", "en", "s", 1), (3, text + "\nother words there", "en", "s", 1)]):
        docs = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA + ", n_words int, slot string")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.cut(stage(spark, docs, ""))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "slot"]
        assert corpus_pipeline.cut(corpus_pipeline.STAGES[-1][1](spark, docs, "")).count() == docs.count()


def test_registered_queries(spark):
    names = llm_queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = names["op8_quality_rules"](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({llm_queries.oracle_sql()['op8_quality_rules']})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)
    n = con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    for name in ("op1_mixing", "op7_line_dedup", "op9_jaccard_join"):
        assert names[name](spark, sf).count() == n
    assert set(quality_rules.POLICIES) >= {"base", "v1"}


def test_groups_are_of_rows_and_not_of_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " end"
    rows = [(1, a), (1, b), (1, near(b)), (2, near(a)), (None, c), (None, near(c)), (None, d), (3, near(d)), (4, e), (4, e)]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "x", "y") for r in rows], SCHEMA + ", id string, row string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[1, a] == 1 and got[3, near(d)] == 1 and got[4, e] == 1
    assert got[1, b] + got[1, near(b)] == 1 and got[None, c] + got[None, near(c)] == 1 and sum(got.values()) == 5
    # Later stages keep rows that share an id.
    docs = corpus_pipeline.cut(out)
    mixed = corpus_pipeline.cut(corpus_pipeline.mixed(spark, docs, ""))
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == got
    tok = ChunkTokenizer("byte")
    want = sum(len(tok.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in got)
    assert sum(r["length"] for r in corpus_pipeline.packed(spark, mixed, "").collect()) == want


def test_sequences_follow_the_mixed_order(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices(["the", "Ergebnis", "x1!"], k=rng.choice([5, 20, 60, 700, 1500])))) for i in range(600)]
    for seed in (1, 2):
        mixture = random.Random(seed).sample(texts, len(texts))
        at = {d: i for i, (d, _) in enumerate(mixture)}
        df = spark.createDataFrame([(*r, "en", "s", 0, i) for i, r in enumerate(mixture)], SCHEMA + ", nth int")
        written = corpus_pipeline.cut(df.repartitionByRange(7, "nth").sortWithinPartitions("nth"))
        got = corpus_pipeline.packed(spark, written, "").collect()
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for v in places.values():
            assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= packing.CAPACITY
        # As few sequences as without an order.
        plain = packing.pack_documents(df).collect()
        assert len(places) == len({r["sequence_id"] for r in plain})
        key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        assert sorted(map(key, got)) == sorted(map(key, plain))
        # Sequences have the order of their tokens' mean places, and all stand near theirs.
        order = {(r["doc_id"], r["piece"]): k for k, r in enumerate(sorted(got, key=lambda r: (at[r["doc_id"]], r["piece"])))}
        means = {s: 0 for s in sorted(places)}
        for r in got:
            means[r["sequence_id"]] += order[r["doc_id"], r["piece"]] * r["length"] / sum(n for _, n in places[r["sequence_id"]])
        assert list(means) == list(range(len(means))) and all(x <= y + 1e-6 for x, y in zip(list(means.values()), list(means.values())[1:]))
        off = [abs(r["sequence_id"] / len(places) - order[r["doc_id"], r["piece"]] / len(got)) for r in got]
        assert sum(off) / len(off) < 0.2  # 0.33 by chance
