import random
from collections import Counter

import pytest

from stratalog.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 997, "b": 3}, dict.fromkeys("abcdefg", 3), {"a": 5}])
def test_period_deviates_by_less_than_a_block(weights):
    slots, whole = mixing.period(weights), sum(weights.values())
    assert sorted(s for v in slots.values() for s in v) == list(range(whole))
    for k, w in weights.items():
        for t in range(whole + 1):
            given = sum(s < t for s in slots[k])
            assert abs(given * whole - w * t) < whole
        for j, s in enumerate(slots[k]):
            assert j * whole // w <= s < -(-(j + 1) * whole // w)  # between release and deadline


def test_phases_schedule_every_block_once_and_stay_in_bounds():
    rng = random.Random(2)
    for _ in range(20):
        weights = {k: rng.randrange(1, 30) for k in "abcd"}
        blocks = {k: rng.randrange(0, 90) for k in "abcd"}
        seen, order = Counter(), {}
        for p in mixing.phases(weights, blocks):
            given = Counter()
            for k, n in p.blocks.items():
                w = len(p.slots[k])
                for j in range(n):
                    slot = p.start + j // w * p.length + p.slots[k][j % w]
                    assert slot not in order
                    order[slot] = (k, p.first[k] + j)
                seen[k] += n
            end = p.start + sum(p.blocks.values())
            for t in range(p.start, end):
                given[order[t][0]] += 1
                for k in p.blocks:
                    assert abs(given[k] * p.length - len(p.slots[k]) * (t - p.start + 1)) < p.length
        assert seen == Counter({k: n for k, n in blocks.items() if n}) and sorted(order) == list(range(len(order)))


def test_quantised():
    assert mixing.quantised({"a": 1, "b": 2}, 10) == {"a": 3, "b": 7}
    assert sum(mixing.quantised({i: 1 for i in range(7)}, 100).values()) == 100
    assert mixing.quantised({"a": 0, "b": 0}, 4) == {"a": 2, "b": 2}
    assert mixing.quantised({}) == {}


def test_schedule_equals_a_simulation(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "x", "x", "y", "z", None]), "t" * rng.randrange(120)) for i in range(200)]
    rows += [(5, "x", "twice"), (None, "y", "no id"), (7, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"x": 6.0, "y": 3.0, "z": 1.0}
    got = mixing.schedule(df, weights, 100).collect()
    units = Counter()
    for d, s, t in rows:
        units[s, d] += len(t or "")
    want, blocks = {}, Counter()
    for s in {s for s, _ in units}:
        total = 0
        for place, d in enumerate(sorted((d for x, d in units if x == s), key=lambda d: (d is not None, d))):
            want[s, d] = [units[s, d], total // 100, place]
            blocks[s] = max(blocks[s], total // 100 + 1)
            total += units[s, d]
    targets = mixing.quantised({s: weights.get(s, 1.0) for s in blocks})
    for p in mixing.phases(targets, dict(blocks)):
        for k, n in p.blocks.items():
            for j in range(n):
                w = targets[k]
                slot = p.start + j // w * p.length + p.slots[k][j % w]
                for key, v in want.items():
                    if key[0] == k and v[1] == p.first[k] + j:
                        v += [p.number, slot]
    assert {(r["source"], r["doc_id"]): [r["size"], r["block"], r["place"], r["phase"], r["slot"]] for r in got} == want
    mixed = mixing.mix(df.withColumnRenamed("text", "text").selectExpr("*", "1 AS slot", "2 AS size"), weights, 100)
    assert mixed.columns == ["doc_id", "source", "text", "slot", "size"]
    order = {(r["source"], r["doc_id"]): (r["slot"], r["place"]) for r in got}
    places = [order[r["source"], r["doc_id"]] for r in mixed.collect()]
    assert len(places) == len(rows) and places == sorted(places)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.schedule(df).count() == 0 and mixing.mix(df).count() == 0


@pytest.mark.parametrize("given", [None, {"s7": 5.0, "s8": 1.0, None: 2.0}])
def test_more_sources_than_the_driver_plans_for(spark, given):
    n = mixing.MAX_SOURCES + 500
    rows = [(i, f"s{i % n}", "t" * (20 + i % 60)) for i in range(3 * n)]
    rows += [(10 * n + i, "big", "t" * 250) for i in range(700)] + [(1, None, "no source"), (2, "empty", ""), (3, "long", "t" * 950), (4, "long", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.schedule(df, given, 100).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((d, s) for d, s, _ in rows)
    # A slot is one block of one source, and a source's blocks keep their order.
    owner, last = {}, {}
    for r in sorted(got, key=lambda r: r["slot"]):
        assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert last.get(r["source"], (-1, -1)) <= (r["block"], r["place"]) or r["block"] == last[r["source"]][0]
        last[r["source"]] = (r["block"], r["place"])
    sizes, ends = Counter(), {}
    for d, s, t in sorted(rows, key=lambda r: r[0]):
        ends[s] = sizes[s] // 100
        sizes[s] += len(t)
    slots = sum(b + 1 for b in ends.values())
    assert 0 <= min(owner) and max(owner) < slots
    if given is None:
        # "big" has a target share of its own until the others end.
        root = {s: max(x, 0) ** mixing.FLATTEN for s, x in sizes.items()}
        share = root["big"] / sum(root.values())
        assert share > mixing.OWN_SHARE
        weights = mixing.quantised({"big": share, "rest": 1 - share})
        others = sum(b + 1 for s, b in ends.items() if s != "big")
        until = others * mixing.RESOLUTION // weights["rest"]
        for t in range(0, until, 97):
            done = sum(owner.get(x, ("", 0))[0] == "big" for x in range(t))
            assert done <= t * weights["big"] / mixing.RESOLUTION + 1
    mixed = mixing.mix(df, given, 100)
    assert mixed.count() == len(rows)


def test_small_targets_are_not_rounded_up():
    weights = mixing.quantised({"a": 0.6, "b": 0.4 - 1e-5, "c": 1e-5})
    assert sum(weights.values()) == pytest.approx(100_000, rel=0.01) and weights["c"] == 1
    plan = mixing.phases(weights, {"a": 70_000, "b": 50_000, "c": 5})
    drawn = sum(plan[0].blocks.values())
    assert abs(plan[0].blocks["c"] - 1e-5 * drawn) < 1
    # The driver's work is bounded whatever the weights.
    assert sum(mixing.quantised({i: 1.0 if i else 1e-12 for i in range(500)}).values()) <= mixing.SLOTS / 500 + 500


@pytest.mark.parametrize("small", [50, 900, 2000])
def test_one_rule_for_any_number_of_sources(spark, monkeypatch, small):
    # All sources end together, so all keep to their targets from end to end: "mid" is
    # below OWN_SHARE, and far above the mean of those that are.
    blocks = {f"s{i}": 1 for i in range(small)} | {"big": small // 8, "mid": small // 100, None: 1}
    rows = [(i, s, "t" * 10) for s, n in blocks.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.schedule(df, {s: float(n) for s, n in blocks.items() if n}, 10).collect()
    at = {r["slot"]: r["source"] for r in got}
    assert sorted(at) == list(range(len(rows))) and Counter(at.values()) == Counter(s for _, s, _ in rows)
    for s in ("big", "mid", "s0", f"s{small - 1}", None):
        given = 0
        for t in range(len(rows)):
            given += at[t] == s
            assert abs(given - blocks[s] * (t + 1) / len(rows)) < 5
    # Nothing changes at a number of sources.
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    assert sorted(map(str, mixing.schedule(df, {s: float(n) for s, n in blocks.items() if n}, 10).collect())) == sorted(map(str, got))
