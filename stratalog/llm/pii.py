"""Personal data spans: patterns, and a character BiLSTM-CRF that adds to them.

``base_spans`` finds e-mail addresses, IP addresses, payment cards and phone
numbers by the contract's patterns, in time linear in the text. The model, a
character-level bidirectional LSTM with CRF transitions over B/I tags of the four
kinds and of secrets (keys and tokens, which no pattern finds), is trained in numpy
on the driver from labelled spans: windows of at most SAMPLE_DOCS documents (those
with the smallest hash of doc_id among the ones with a digit or @, of a range of
hashes that holds OVER * SAMPLE_DOCS documents on average; equal rows count once)
labelled by the patterns, and generated spellings that the patterns don't know
(name at host dot org, phones without +, dotted cards, secrets) set into such
windows.

Every place of every text with a digit, an @ or an "at" before a dot is within
windows of WINDOW characters that overlap by half. Their emission scores are
averaged, weighted to a window's middle, and each run of overlapping windows is
decoded by one Viterbi pass, so a span over a window's edge is found whole. Every
known spelling in a decoded span is added, or all of it if it has none but what
its kind can't do without (see ``stretches``), unless it touches a base span; base
spans stay as they are. Secrets are told apart from personal data: ``spans`` has
the four kinds, ``secrets`` the others.

Memory: a task holds one text and the windows of a few thousand places. The model
is some thousand numbers, shipped with the function.

Defined results: a null or empty text has no spans; a null doc_id is kept;
repeated rows are searched each for itself; an empty table gives an empty table
(training then uses generated windows alone). Columns other than doc_id and text
aren't read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import lean

KINDS = ("email", "ip", "card", "phone")
#: What the model tags.
TAGGED = (*KINDS, "secret")
#: Bound of the labelled sample, and how many times as many are looked at for it.
SAMPLE_DOCS, OVER = 1_000, 50
#: Characters of a sampled text that are learned from (all are searched).
SAMPLE_CHARS = 20_000
WINDOW, STRIDE = 64, 32
EMBEDDED, HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 24, 6, 48, 0.02, 11
#: Windows whose scores are computed at once.
WINDOWS_AT_ONCE = 2048

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits, so the look-behind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: Where windows are laid.
_PLACE = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])(?=(?s:.){1,40}?(?:(?<![A-Za-z])[Dd][Oo][Tt](?![A-Za-z])|\.[A-Za-z]))")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    ended = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > ended and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            ended = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _DIGITS.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Known spellings give a decoded span's exact places; one of another spelling is
# added as it is, if it has what its kind can't do without (see ``_fits``).
_AT, _DOT = r"(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s|_at_)", r"(?:\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s|_dot_)"
_AT_THEN_DOT = re.compile(r"[a-z0-9].*?(?:@|(?<![a-z])at(?![a-z])).*?[a-z0-9].*?(?:\.|(?<![a-z])dot(?![a-z])).*?[a-z0-9]", re.I | re.S)
_FORMS = {
    "email": re.compile(rf"[\w.%+-]+\s?{_AT}\s?[\w-]+(?:\s?{_DOT}\s?[\w-]+)+", re.I | re.A),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|\()?[0-9][ ().0-9/-]{7,20}[0-9](?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])"),
}


def _fits(kind: str, text: str) -> bool:
    digits = _DIGITS.sub("", text)
    if kind == "ip":
        parts = [p for p in _DIGITS.split(text) if p]
        return len(parts) == 4 and _octets(".".join(parts))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "secret":
        # Long, without a space, and of both letters and digits throughout.
        return len(text) >= 16 and len(text.split()) == 1 and 4 <= len(digits) <= len(text) - 4
    return bool(_AT_THEN_DOT.search(text))


def stretches(kind: str, text: str) -> list[tuple[int, int]]:
    """What a decoded span adds: every known spelling in it, else all of it
    without the signs at its ends, if that fits its kind."""
    found = [m.span() for m in _FORMS[kind].finditer(text) if _fits(kind, m.group())]
    if not found and (m := re.search(r"[+(]?[^\W_](?:.*[^\W_])?", text, re.S)) and _fits(kind, m.group()):
        found = [m.span()]
    return found


def well_formed(kind: str, text: str) -> tuple[int, int] | None:
    """The longest stretch of a span that has its kind's form."""
    return max(stretches(kind, text), key=lambda s: s[1] - s[0], default=None)


# Characters: 0 outside the text, printable ASCII, line ends, other letters, others.
def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where(points < 128, points - 30, 98).astype(np.int64)
    out[points < 32] = 1
    out[(points >= 128) & (points < 0xC0)] = 99
    return out


N_CODES, TAGS = 100, 1 + 2 * len(TAGGED)


def tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * TAGGED.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, parameters: dict[str, np.ndarray] | None = None):
        if parameters is None:
            g = np.random.Generator(np.random.PCG64(SEED))
            draw = lambda *shape: (g.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
            parameters = {"emb": g.normal(0, 0.3, (N_CODES, EMBEDDED)).astype(np.float32), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
            for side in "fb":
                parameters |= {f"wx{side}": draw(EMBEDDED, 4 * HIDDEN), f"wh{side}": draw(HIDDEN, 4 * HIDDEN), f"c{side}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        self.p = parameters

    def _lstm(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time-major x; gates in, forget, out, cell."""
        p, steps = self.p, range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        wx = x @ p["wx" + side] + p["c" + side]
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in steps:
            z = wx[t] + h @ p["wh" + side]
            gates, cell = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, h_before = c, h
            c = f * c + i * cell
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, cell, before, tc, h_before))
        return out

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """[window, place, tag] of windows of codes."""
        x = self.p["emb"][windows.T]
        h = np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], axis=2)
        return (h @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _crf_gradient(self, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of log-likelihood; e: [t, window, tag], y: [t, window]."""
        n, b, _ = e.shape
        trans = self.p["trans"]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = -np.exp(alpha + beta - z[:, None])
        np.add.at(de, (np.arange(n)[:, None], np.arange(b), y), 1)
        dtrans = np.zeros_like(trans)
        for t in range(1, n):
            dtrans -= np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        return de, dtrans

    def gradient(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, codes_ = self.p, windows.T
        x, kept = p["emb"][codes_], {"f": [], "b": []}
        h = np.concatenate([self._lstm(x, s, kept[s]) for s in "fb"], axis=2)
        de, dtrans = self._crf_gradient(h @ p["out"] + p["bias"], y.T)
        grad = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum(axis=(0, 1)), "trans": dtrans}
        dh_all, dx = de @ p["out"].T, np.zeros_like(x)
        for k, side in enumerate("fb"):
            dz = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
            before = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, cell, c, tc, h_before in reversed(kept[side]):
                dh = dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * cell * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cell * cell)], axis=1)
                before[t] = h_before
                dh, dc = dz[t] @ p["wh" + side].T, dc * f
            grad |= {"wx" + side: np.einsum("tbe,tbz->ez", x, dz), "wh" + side: np.einsum("tbh,tbz->hz", before, dz), "c" + side: dz.sum(axis=(0, 1))}
            dx += dz @ p["wx" + side].T
        grad["emb"] = np.zeros_like(p["emb"])
        np.add.at(grad["emb"], codes_, dx)
        return {k: v / len(windows) for k, v in grad.items()}

    def fit(self, windows: np.ndarray, y: np.ndarray) -> Tagger:
        """Adam over shuffled batches."""
        g = np.random.Generator(np.random.PCG64(SEED))
        m, v, step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for epoch in range(EPOCHS):
            order = g.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                step += 1
                for k, d in self.gradient(windows[order[a : a + BATCH]], y[order[a : a + BATCH]]).items():
                    d = np.clip(d, -5, 5)
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    rate = RATE * (1 - epoch / (EPOCHS + 1))
                    self.p[k] = (self.p[k] + rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each [place, tag] array; equal lengths run together."""
        out: list[np.ndarray | None] = [None] * len(scores)
        trans = self.p["trans"]
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            longest = len(scores[some[-1]])
            # Padding after the end with zeros doesn't change the best tags before
            # it but for the last transition, so each path is read from its end.
            e = np.zeros((longest, len(some), TAGS), np.float32)
            for j, k in enumerate(some):
                e[: len(scores[k]), j] = scores[k]
            best, back = e[0].copy(), np.zeros((longest, len(some), TAGS), np.int8)
            ends = np.array([len(scores[k]) for k in some])
            final = np.where((ends == 1)[:, None], best, 0)
            for t in range(1, longest):
                s = best[:, :, None] + trans
                back[t] = s.argmax(axis=1)
                best = s.max(axis=1) + e[t]
                final[ends == t + 1] = best[ends == t + 1]
            tag, paths = final.argmax(axis=1), np.zeros((longest, len(some)), np.int8)
            for t in range(longest - 1, -1, -1):
                here = ends > t
                paths[t, here] = tag[here]
                tag = np.where(here, back[t, np.arange(len(some)), tag], tag)
            for j, k in enumerate(some):
                out[k] = paths[: len(scores[k]), j]
        return out


def spans_of(path: np.ndarray, offset: int) -> list[Span]:
    out, at = [], 0
    inside = np.append(path, 0)
    while at < len(path):
        if inside[at] and inside[at] % 2 == 1:
            end = at + 1
            while inside[end] == inside[at] + 1:
                end += 1
            out.append((TAGGED[(int(inside[at]) - 1) // 2], offset + at, offset + end))
            at = end
        else:
            at += 1
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Ranges [start, end) of the text to search, in whole strides."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _PLACE.search(text, at):
        a = max(0, (m.start() // STRIDE - 1) * STRIDE)
        b = min(len(text), (m.start() // STRIDE + 2) * STRIDE)
        # Places of this stride need no more windows; the at-dot form reaches on.
        at = (m.start() // STRIDE + 1) * STRIDE
        if text[m.start()] in "aA":
            at, b = m.start() + 1, min(len(text), b + STRIDE)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(code: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows over [a, b), overlapping by half, and their starts."""
    starts = np.arange(a, max(a + 1, b - STRIDE), STRIDE)
    places = starts[:, None] + np.arange(WINDOW)
    return np.where(places < len(code), code[np.minimum(places, len(code) - 1)], 0), starts


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)


def decode(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """The model's spans in each text."""
    jobs, parts = [], []
    for i, text in enumerate(texts):
        for a, b in zones(text):
            windows, starts = _windows(codes(text[a : b + WINDOW]), 0, b - a)
            jobs.append((i, a, b, starts))
            parts.append(windows)
    out: list[list[Span]] = [[] for _ in texts]
    if not jobs:
        return out
    whole = np.concatenate(parts)
    e = np.concatenate([tagger.emissions(whole[k : k + WINDOWS_AT_ONCE]) for k in range(0, len(whole), WINDOWS_AT_ONCE)])
    scores, at = [], 0
    for _, a, b, starts in jobs:
        total, weight = np.zeros((b - a + 2 * WINDOW, TAGS), np.float32), np.zeros(b - a + 2 * WINDOW, np.float32)
        for s in starts.tolist():
            total[s : s + WINDOW] += e[at] * _WEIGHT[:, None]
            weight[s : s + WINDOW] += _WEIGHT
            at += 1
        scores.append(total[: b - a] / np.maximum(weight[: b - a], 1e-6)[:, None])
    for (i, a, _, _), path in zip(jobs, tagger.viterbi(scores)):
        out[i] += spans_of(path, a)
    return out


def added(text: str, base: list[Span], model: list[Span]) -> list[Span]:
    out = []
    for kind, a, b in model:
        for c, d in stretches(kind, text[a:b]):
            if all(a + d <= x or y <= a + c for _, x, y in base):
                out.append((kind, a + c, a + d))
    return out


def generated(rng: np.random.Generator) -> tuple[str, str | None]:
    """A spelling and its kind (None: not personal)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    form = rng.integers(18)
    if form >= 16:
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        mixed = lambda n: "".join(letters[c] for c in rng.integers(0, len(letters), n))
        return pick(rng.bytes(20).hex(), rng.bytes(16).hex(), rng.bytes(20).hex(), mixed(int(rng.integers(24, 41))), "key-" + mixed(28), mixed(32).upper()), "secret"
    if form < 4:
        at, dot = pick(("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("_at_", "_dot_"), (" {at} ", pick(".", " {dot} ")), (" <at> ", pick(".", " <dot> ")), (" [at] ", "\n[dot] "))
        return f"{word()}{pick('', '.', '_')}{pick('', d(2))}{at}{word()}{dot}{pick('com', 'org', 'example' + dot + 'com', 'net')}", "email"
    if form < 6:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if form < 8:
        sep, n = pick("", " ", "-", ".", "_"), d(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        return sep.join(n[i : i + 4] for i in range(0, 16, 4)), "card"
    if form < 12:
        return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"{d(4)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", d(10), f"+{d(2)} {d(3)} {d(6)}"), "phone"
    return pick(f"20{d(2)}-0{pick('1', '9')}-1{d(1)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", d(int(rng.integers(1, 9))), f"{d(2)}:{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"{word()} at {word()}", f"{d(2)}/{d(2)}/{d(4)}"), None


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    x, y = [], []

    def take(text: str, spans: list[Span], a: int, b: int) -> None:
        label = tags(len(text), spans)
        windows, starts = _windows(codes(text), a, b)
        for window, s in zip(windows, starts.tolist()):
            x.append(window)
            y.append(np.pad(label[s : s + WINDOW], (0, max(0, WINDOW - len(label[s : s + WINDOW])))))

    for text in texts:
        spans = base_spans(text)
        # Labels only: in the texts searched, the model alone decides on secrets.
        spans += added(text, spans, [("secret", *m.span()) for m in _FORMS["secret"].finditer(text)])
        for a, b in zones(text):
            take(text, spans, a, b)
    around = [t for t in texts if len(t) > 200] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore. " * 4, "And then, one day, it went on for a while as nobody there was home. The others had gone out to see the sea. " * 4]
    for _ in range(3200):
        t = around[rng.integers(len(around))]
        k = int(rng.integers(0, len(t) - 150))
        at = int(rng.integers(20, 90))
        spelling, kind = generated(rng)
        left = re.sub("[0-9@]", "e", t[k : k + at]) + " "
        text = left + spelling + " " + re.sub("[0-9@]", "e", t[k + at : k + 150])
        spans = [(kind, len(left), len(left) + len(spelling))] if kind else []
        a = max(0, (len(left) // STRIDE - 1) * STRIDE)
        take(text, spans, a, min(len(text), a + 3 * STRIDE))
    return np.stack(x), np.stack(y)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Tagger:
    """Train on the driver from at most ``sample`` documents."""
    share = min(1.0, OVER * sample / max(1, docs.count()))
    some = docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    if share < 1:
        some = some.where(F.col("h") <= int(share * (1 << 64)) - (1 << 63))
    some = some.where(F.col("text").rlike("[0-9@]"))
    # Hashes first, so that a task sends two numbers for each of its smallest, not a
    # text; the texts that are meant follow, each once.
    hashed = some.select("h", F.xxhash64("text").alias("t"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    smallest = [tuple(r) for r in hashed.select("h", "t").distinct().orderBy("h", "t").limit(sample).collect()]
    if not smallest:
        return Tagger().fit(*training_windows([]))
    wanted = docs.sparkSession.createDataFrame(smallest, "h long, t long")  # ``sample`` rows
    rows = hashed.where(F.col("h") <= smallest[-1][0]).join(F.broadcast(wanted), ["h", "t"]).dropDuplicates(["h", "t"])
    return Tagger().fit(*training_windows([r["text"] for r in rows.orderBy("h", "t").collect()]))


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, n_secrets long, secrets string, n_found long"


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Counts and digest of the base spans, all spans, and secrets of every text;
    ``n_found`` counts all of them."""
    parameters = (tagger or fit(docs)).p
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(parameters)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                texts = [t or "" for t in batch.column(1)[k : k + 1000].to_pylist()]
                rows = []
                for text, more in zip(texts, decode(model, texts)):
                    base = base_spans(text)
                    new, secrets = [], []
                    for span in added(text, base, more):
                        (secrets if span[0] == "secret" else new).append(span)
                    every = sorted(base + new, key=lambda s: (s[1], KINDS.index(s[0])))
                    kinds = [s[0] for s in base]
                    rows.append((*(kinds.count(x) for x in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(new), len(every), len(secrets), joined(secrets), len(every) + len(secrets)))
                types = [*[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1000], *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), COLUMNS)
