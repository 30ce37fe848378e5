"""Token ids of whole texts by a public tokenizer's file, in batches.

Ids equal those of the ``tokenizers`` library's ``encode`` on the whole text, with
add_special_tokens=False and nothing else set (tested against it): a special
token's string within a text becomes that token. Most ids are found faster:

* They are merged by tiktoken's engine, given the file's vocabulary as ranks. It
  merges any two neighbours whose joint string is a token, the library only
  listed pairs; as every token of the file is reached from its own characters
  and ids ascend in merge order (both tested), the results are equal.
* The "word" kind drops white space, so a chunk between spaces has the same ids
  wherever it stands: each distinct chunk of a batch is encoded once and the ids
  are gathered by numpy. Nothing is kept between batches.
* Texts outside the range for which this holds, and texts with a special token's
  string in upper or lower case, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters encoded at once, but for a longer text.
BATCH_CHARS = 24_000_000

#: kind -> file of public_tokenizers. "byte": a space belongs to the word after
#: it; "word": lower case, white space is dropped, tokens know the word's end.
FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}

# The byte-level pattern of the first file, and the pieces of the
# second one's, for characters below U+0250.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+)"

#: Stands for a word's end while merging.
END = "\x01"
# Below U+0250 nothing composes and lower case doesn't depend on neighbours.
_BEYOND = re.compile(r"[^\x02-\x1b\x20-ɏ]")


def public_path(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(FILES[kind])


def byte_of_character() -> dict[str, int]:
    """Byte-level files write a printable byte as itself and the others, in
    order, as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    to_byte, suffix = byte_of_character(), "</w>"
    table = {}
    for token, i in vocabulary.items():
        word = token.removesuffix(suffix) if token != suffix else token
        table[bytes(to_byte[c] for c in word) + (END.encode() if word != token else b"")] = i
    return table


class ChunkTokenizer:
    def __init__(self, kind: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path or public_path(kind))
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        special = {str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()}
        # In any case: the file may look for them in lower-cased text.
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)", re.IGNORECASE).search
        table = ranks({t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special})
        pattern = BYTE_PATTERN if kind == "byte" else f"[^{END}]*{END}"
        self.merge = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for b, i in table.items() if b.endswith(END.encode())]] = True

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.code)

    def _marked(self, chunks: pa.Array) -> pa.Array:
        """Chunks with END after each piece; those of letters and perhaps one
        stop, the most, need no search for pieces."""
        letters = pc.match_substring_regex(chunks, r"^\p{L}+$")
        stopped = pc.match_substring_regex(chunks, r"^\p{L}+[.,]$")
        other = pc.invert(pc.or_(letters, stopped))
        words = pc.filter(chunks, stopped)
        found = pc.replace_substring_regex(pc.filter(chunks, other), pattern=WORD_PIECES, replacement=r"\1" + END)
        parts = [
            pc.binary_join_element_wise(pc.filter(chunks, letters), END, ""),
            pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, -1), END, pc.utf8_slice_codeunits(words, -1), END, ""),
            # What stands between pieces is white space, to be dropped.
            pc.replace_substring_regex(found, pattern=r"[\s\x0b\x{85}\x{a0}]+", replacement=""),
        ]
        at = np.concatenate([np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (letters, stopped, other)])
        return pa.concat_arrays(parts).take(pa.array(np.argsort(at)))

    def _words(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and how many each has."""
        marked = self._marked(chunks)
        n_pieces = pc.count_substring(marked, END).to_numpy(zero_copy_only=False)
        ids = np.array(self.merge("".join(marked.to_pylist())), self.code)
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        return ids, np.diff(ends[np.cumsum(n_pieces)], prepend=0).astype(np.int32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed integers (``self.code``, native order)."""
        if self.kind == "byte":
            return [self._library(t).tobytes() if self.special(t) else array(self.code, self.merge(t)).tobytes() for t in texts]
        beyond = [_BEYOND.search(t) is not None or self.special(t) is not None for t in texts]
        out = [self._library(t).tobytes() if far else b"" for t, far in zip(texts, beyond)]
        safe = [i for i, far in enumerate(beyond) if not far]
        if not safe:
            return out
        lists = pc.split_pattern(pa.array([texts[i].lower().replace("\n", " ") for i in safe], pa.string()), " ")
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().dictionary_encode()
        ids, counts = self._words(flat.dictionary)
        codes = flat.indices.to_numpy()
        n = counts[codes]
        stops = np.cumsum(n, dtype=np.int64)
        first = np.cumsum(counts, dtype=np.int64) - counts
        at = np.repeat((first[codes] - stops + n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        packed = ids[at].tobytes()
        bounds = np.append(0, stops)[np.append(0, np.cumsum(sizes))] * self.width
        for k, i in enumerate(safe):
            out[i] = packed[bounds[k] : bounds[k + 1]]
        return out


_workers: dict[tuple, ChunkTokenizer] = {}


def tokenizer(kind: str, path: str | None = None) -> ChunkTokenizer:
    """This process's tokenizer; reused workers load it once."""
    if (kind, path) not in _workers:
        _workers[kind, path] = ChunkTokenizer(kind, path)
    return _workers[kind, path]


def slices(n: int, sizes: list[int], budget: int):
    """Ranges of consecutive items whose sizes sum to about ``budget`` at most."""
    at, total = 0, 0
    for i in range(n):
        if i > at and total + sizes[i] > budget:
            yield at, i
            at, total = i, 0
        total += sizes[i]
    if n > at:
        yield at, n
