import pytest

from stratalog.llm import licenses
from stratalog.llm.license_texts import TEMPLATES

BEFORE, AFTER = "Some ordinary words come first. " * 30, " And the story goes on after it. " * 30


@pytest.mark.parametrize("name", TEMPLATES)
def test_every_template_is_found_in_place(name):
    text = BEFORE + TEMPLATES[name] + AFTER
    (hit,) = licenses.scan(text)
    assert hit["license"] == name and hit["n_differences"] == 0 and hit["start"] == len(BEFORE)
    assert licenses.words_of(text[hit["start"] : hit["end"]])[0] == licenses.words_of(TEMPLATES[name])[0]


def test_changed_wordings_are_confirmed_word_by_word():
    text = BEFORE + TEMPLATES["MIT"].replace("free of charge", "without charge").replace("merge, ", "") + AFTER
    (hit,) = licenses.scan(text)
    assert hit["license"] == "MIT" and hit["differences"] == "-free -of +without -merge"
    assert licenses.scan("Licensed under the Imaginary License, Version 2.0.") == []
    assert licenses.scan("The warranty of my car and its licence plate, a long story of copyright.") == []
    (upper,) = licenses.scan("RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!")
    assert upper["license"] == "MIT (line)"


def test_neighbouring_licences_are_all_found():
    names = ["MIT (line)", "CC-BY-NC-4.0 (line)", "Apache-2.0 (line)", "MIT (line)"]
    text = "\n".join(TEMPLATES[n] for n in names)
    assert [h["license"] for h in licenses.scan(text)] == names
    assert [h["license"] for h in licenses.scan(TEMPLATES["ISC"] + "\n\n" + TEMPLATES["BSD-3-Clause"])] == ["ISC", "BSD-3-Clause"]


def test_long_texts_are_scanned_whole():
    filler = "copyright and licence words everywhere "
    text = filler * 2500 + TEMPLATES["MIT"] + " " + filler * 500
    assert "MIT" in [h["license"] for h in licenses.scan(text)]


def test_ranking_prefers_the_template_itself():
    words = licenses.words_of(TEMPLATES["GPL-3.0-or-later"])[0]
    best = licenses.reductions(words)[0]
    assert licenses._templates()[best[1]][0] == "GPL-3.0-or-later" and best[0] > 0.8


def test_documents(spark):
    rows = [(1, TEMPLATES["MIT (line)"]), (2, None), (3, ""), (None, "x " + TEMPLATES["CC0-1.0"]), (1, TEMPLATES["MIT (line)"])]
    got = licenses.scan_documents(spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "CC0-1.0"), (1, "MIT (line)"), (1, "MIT (line)")]
    assert licenses.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CC = "This work is licensed under a Creative Commons {} International License. To view a copy, write to Creative Commons."


@pytest.mark.parametrize("name", ["Attribution-ShareAlike 4.0", "Attribution-NonCommercial-ShareAlike 4.0", "Attribution-NoDerivatives 4.0", "Attribution-NonCommercial-NoDerivatives 4.0"])
def test_long_creative_commons_notices(name):
    (hit,) = licenses.scan(BEFORE + CC.format(name) + AFTER)
    short = {"Attribution": "BY", "ShareAlike": "SA", "NonCommercial": "NC", "NoDerivatives": "ND", "4.0": "4.0"}
    assert hit["license"] == "-".join(["CC", *(short[w] for w in name.replace(" ", "-").split("-"))])


def test_licences_are_not_taken_for_their_relatives():
    gpl, lgpl = TEMPLATES["GPL-3.0-or-later"], TEMPLATES["LGPL-3.0-or-later"]
    assert [h["license"] for h in licenses.scan(gpl.replace("GNU General", "GNU Affero General"))] == ["AGPL-3.0-or-later"]
    assert [h["license"] for h in licenses.scan(lgpl.replace("version 3", "version 2.1"))] == ["LGPL-2.1-or-later"]
    assert licenses.scan(gpl.replace("version 3", "version 4")) == []
    assert licenses.scan(TEMPLATES["MPL-2.0"].replace("v. 2.0", "v. 1.1").replace("MPL/2.0", "MPL/1.1")) == []
    # Other changes, and clauses without their numbers, are no other licence.
    (hit,) = licenses.scan(TEMPLATES["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))
    assert hit["license"] == "BSD-3-Clause" and hit["n_differences"] == 3


def test_every_template_is_compared_in_a_block_of_many():
    names = [n for n in TEMPLATES if len(licenses.words_of(TEMPLATES[n])[0]) > licenses.SHORT]
    found = [h["license"] for h in licenses.scan("\n\n".join(TEMPLATES[n] for n in names))]
    assert set(names) <= set(found)


def _levenshtein(a, b):
    """Word by word; a replaced word counts once."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_over_templates_and_places(seed):
    """Wordings with some words replaced, several in a text: what is found is what
    was set in, where it was; the number of differences is the least possible."""
    import random

    rng = random.Random(seed)
    filler = "and then the story of a small house went on for quite a while in the cold".split()
    names = [n for n in TEMPLATES if n != "BSD (disclaimer)"]
    rng.shuffle(names)
    for at in range(0, len(names), 6):
        words, planted = [], []
        for name in names[at : at + 6]:
            words += rng.choices(filler, k=rng.randrange(90, 200))
            wording = licenses.words_of(TEMPLATES[name])[0]
            changed = list(wording)
            if len(wording) > licenses.SHORT:
                plain = [i for i in range(2, len(wording) - 2) if wording[i] in ("the", "of", "and", "to", "in", "or", "by", "is", "this", "any")]
                for i in rng.sample(plain, min(len(plain), int(licenses.DIFFERENT * len(wording)), rng.randrange(4))):
                    changed[i] = "zebra"
            planted.append((name, len(words), len(words) + len(changed), sum(x != y for x, y in zip(wording, changed))))
            words += changed
        words += rng.choices(filler, k=100)
        text = " ".join(words)
        spans = licenses.words_of(text)[1]
        got = [(h["license"], h["start"], h["end"], h["n_differences"]) for h in licenses.scan(text)]
        assert got == [(n, spans[a][0], spans[b - 1][1], d) for n, a, b, d in planted]
        for (name, a, b, d), hit in zip(planted, got):
            assert d == _levenshtein(licenses.words_of(TEMPLATES[name])[0], words[a:b])


def test_a_replaced_word_counts_once():
    text = TEMPLATES["MPL-2.0"].replace("subject", "bound").replace("distributed", "sent")
    (hit,) = licenses.scan(BEFORE + text + AFTER)
    assert hit["license"] == "MPL-2.0" and hit["n_differences"] == 2 and hit["differences"] == "-subject +bound -distributed +sent"


def test_templates_that_save_the_same_are_told_apart_by_their_wording():
    twice = TEMPLATES["MIT (line)"] + " " + TEMPLATES["MIT (line)"]
    assert [h["license"] for h in licenses.scan(twice)] == ["MIT (line)"] * 2
