"""License scans by conditional compression.

1. Candidate blocks: words around licence terms (CUES) in the whole text; terms as
   near to each other as any template's (see ``reach``) are in one block, so a block
   is as long as the licence it holds. Words are compared
   in lower case, without punctuation around them.
2. A block is compressed by zstandard alone and with each template as a raw
   dictionary; the share of bytes saved ranks the templates.
3. In this order, every template of whose words the block has enough is compared
   word by word, and the first that is confirmed wins: one of up to SHORT words must
   stand there exactly, a longer one with at most DIFFERENT of its words replaced,
   left out or added (a replaced word counts once), none of which names a version or
   another licence. Of templates that save the same, that with fewer differences
   wins, then the longer wording. The wording found is taken out of the block and
   what is left on either side is looked at again, so several licences are all found.

Blocks are cut at BLOCK_WORDS words with an overlap of OVERLAP, more than any
template has, so memory and work per block are bounded and a long text loses
nothing.

One row per finding; a text without one has none. Defined results: a null or
empty text has no finding; a null doc_id is kept; repeated rows are scanned each
for itself; an empty table gives an empty table. Columns other than doc_id and
text aren't read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import lean
from stratalog.llm.license_texts import TEMPLATES

#: Stems that make a word a licence term.
CUES = "licen[cs]|copyright|redistribut|sublicens|public domain|creative commons|warrant(?:y|ies)|hereby granted"
BLOCK_WORDS, OVERLAP = 2_000, 400
LEVEL = 9
SHORT, DIFFERENT = 20, 0.1
#: Words that tell one licence from another.
NAMING = frozenset("affero lesser gnu mozilla eclipse attribution sharealike noncommercial noderivatives noderivs later".split())

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")
_CUE = re.compile(CUES, re.I)


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


@cache
def _templates() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for name, text in TEMPLATES.items():
        words = words_of(text)[0]
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False)))
    return out


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)


def reductions(block: list[str]) -> list[tuple[float, int]]:
    """(share of the block's compressed size that a template saves, its number),
    best first."""
    data = " ".join(block).encode()
    alone = len(_plain().compress(data))
    saved = [(1 - len(c.compress(data)) / alone, k) for k, (_, _, c) in enumerate(_templates())]
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def differences(template: list[str], block: list[str]) -> tuple[int, int, list[str], int] | None:
    """The stretch of the block that matches the template best, how its wording
    differs ("-word" is missing there, "+word" added), and in how many words."""
    blocks = difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]
    # The longest common stretch places the template; what lies farther away than
    # it reaches can't belong to it.
    if not blocks:
        return None
    core = max(blocks, key=lambda m: m.size)
    slack = len(template) // 5 + 1
    a = max(0, core.b - core.a - slack)
    b = min(len(block), core.b + len(template) - core.a + slack)
    inner = [m for m in difflib.SequenceMatcher(None, template, block[a:b], autojunk=False).get_matching_blocks() if m.size]
    if not inner:
        return None
    start, end = a + inner[0].b, a + inner[-1].b + inner[-1].size
    out, number = [], 0
    for tag, i, j, k, n in difflib.SequenceMatcher(None, template, block[start:end], autojunk=False).get_opcodes():
        if tag != "equal":
            out += ["-" + w for w in template[i:j]] + ["+" + w for w in block[start + k : start + n]]
            number += max(j - i, n - k)
    # Words of the template before and after what was found are left out.
    return start, end, out, number


def renamed(template: list[str], stretch: list[str]) -> bool:
    """Whether the differences make it another licence or version."""

    def names(words: list[str], i: int, j: int) -> bool:
        for k in range(i, j):
            before = words[k - 1] if k else ""
            if NAMING & set(words[k].split("-")) or words[k] == "library" and before == "gnu":
                return True
            # A number is a version by its place; others number clauses or years.
            if re.fullmatch(r"v?[0-9]+(\.[0-9]+)*", words[k]) and ("." in words[k] or words[k][0] == "v" or before in ("version", "v", "license", "licence")):
                return True
        return False

    steps = difflib.SequenceMatcher(None, template, stretch, autojunk=False).get_opcodes()
    return any(tag != "equal" and (names(template, i, j) or names(stretch, k, n)) for tag, i, j, k, n in steps)


def _terms(spans: list[tuple[int, int]], text: str) -> list[int]:
    """Numbers of the words in which licence terms begin."""
    terms, at = [], 0
    for m in _CUE.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        terms.append(at)
    return terms


@cache
def reach() -> int:
    """The most words that a template has between two terms, or before the first or
    after the last one, and a tenth for changes."""
    longest = 0
    for text in TEMPLATES.values():
        spans = words_of(text)[1]
        marks = [-1, *_terms(spans, text), len(spans)]
        longest = max(longest, *(b - a for a, b in zip(marks, marks[1:])))
    return int(longest * (1 + DIFFERENT)) + 1


def _blocks(words: list[str], spans: list[tuple[int, int]], text: str) -> Iterator[tuple[int, int]]:
    """Ranges of words around licence terms."""
    joined: list[list[int]] = []
    for t in _terms(spans, text):
        if joined and t - joined[-1][1] <= reach():
            joined[-1][1] = t
        else:
            joined.append([t, t])
    for a, b in joined:
        a, b = max(0, a - reach()), min(len(words), b + reach() + 1)
        for k in range(a, max(a + 1, b - OVERLAP), BLOCK_WORDS - OVERLAP):
            yield k, min(b, k + BLOCK_WORDS)


def scan(text: str | None) -> list[dict]:
    """Findings of a text, by start."""
    if not text or not _CUE.search(text):
        return []
    words, spans = words_of(text)
    found: dict[tuple[int, int], dict] = {}

    def search(a: int, b: int) -> None:
        block = words[a:b]
        if not block or not _CUE.search(" ".join(block)):
            return
        held = Counter(block)
        # Each template word that the block hasn't is a difference, so no match is
        # lost here, and a block without a candidate needs no compression.
        able = {k for k, (_, template, _) in enumerate(_templates()) if _missing(k, held) <= _allowed(template)}
        best = None
        for saved, k in reductions(block) if able else []:
            if best and saved < best[0]:
                break
            match = _confirmed(k, block) if k in able else None
            if match and (best is None or (match[3], match[0] - match[1]) < (best[2][3], best[2][0] - best[2][1])):
                best = (saved, k, match)
        if best:
            saved, k, (start, end, changed, number) = best
            name, template, _ = _templates()[k]
            s, e = a + start, a + end
            found.setdefault((s, e), {"license": name, "start": spans[s][0], "end": spans[e - 1][1], "reduction": saved, "n_words": len(template), "n_differences": number, "differences": " ".join(changed)})
            search(a, s)
            search(e, b)

    for a, b in _blocks(words, spans, text):
        search(a, b)
    # Overlapping blocks find the same licence, or a part of it.
    out: list[dict] = []
    for key in sorted(found, key=lambda k: (k[0], -k[1])):
        if not out or found[key]["start"] >= out[-1]["end"]:
            out.append(found[key])
    return out


@cache
def _counts(k: int) -> Counter:
    return Counter(_templates()[k][1])


def _missing(k: int, held: Counter) -> int:
    return sum(n - held[w] for w, n in _counts(k).items() if held[w] < n)


def _allowed(template: list[str]) -> float:
    return 0 if len(template) <= SHORT else DIFFERENT * len(template)


def _exact(template: list[str], block: list[str]) -> tuple[int, int, list[str], int] | None:
    n = len(template)
    for k in range(len(block) - n + 1):
        if block[k] == template[0] and block[k : k + n] == template:
            return k, k + n, [], 0
    return None


def _confirmed(k: int, block: list[str]) -> tuple[int, int, list[str], int] | None:
    """Where template ``k`` stands in the block, if its wording confirms it."""
    template = _templates()[k][1]
    match = _exact(template, block)
    if match is None and len(template) > SHORT:
        match = differences(template, block)
    if match is None or match[3] > _allowed(template) or match[2] and renamed(template, block[match[0] : match[1]]):
        return None
    return match


COLUMNS = "doc_id long, license string, start long, end long, reduction double, n_words long, n_differences long, differences string"


def scan_documents(docs: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *(f[n] for n in names[1:])) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in scan(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    # Texts without a term never leave the JVM.
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(f"(?i){CUES}"))
    return some.mapInArrow(lean(run), ", ".join(f"`{c.split()[0]}` {c.split()[1]}" for c in COLUMNS.split(", ")))
