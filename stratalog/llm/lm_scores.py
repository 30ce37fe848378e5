"""Log-bilinear language model scores, trained in numpy by noise contrast.

Tokens: a text's words, A-Z in lower case, then one end. Documents whose
crc32(doc_id as text) mod 10 is not 0 train, the others are held out.

1. ``counts``: the training tokens' counts, summed map-side, then by word; the
   whole vocabulary stays a distributed table.
2. Items: the HEAD most frequent words, each its own, and BANDS bands of all other
   words, seen or not, by their last three bytes. Every item has a learnt vector
   as context and as target. The ORDER items before a token, each times a vector of
   its position, add up to a prediction h; sqrt(items) classes of equal mass, by
   falling frequency, normalise in two levels: P(class | h) P(item | class, h),
   both log-bilinear (h . q + b).
3. Training tokens are dealt by a hash of (doc_id, text) to portions of PORTION
   tokens on average, and portions to ROUNDS rounds. A portion learns, in the order
   of doc_id and ids, from its round's start: noise-contrastive estimation of both
   levels, with noise classes shared by a batch and noise items within the target's
   class. A round's result is the mean of its portions, each row weighted by its
   updates, added up in two steps. Every training token is used once, and the
   number of tasks or files changes nothing.
4. Products of batches of predictions with all classes, and with all items of a
   class, give exact normalisers. A band's word is one of the band by its smoothed
   count: log P(band | h) + log((count + 0.1) / mass), with one unseen type a band
   in the mass, as in the base score.

KNOWN bounds what is broadcast: words that tie at its border are all beyond it;
their counts come by a shuffle join with the vocabulary table. Each text becomes
ids once; training and scoring read that table.

Memory: a task counts FLUSH_WORDS distinct words at once and holds the KNOWN words,
one model and a batch. The driver holds the KNOWN words and one model.

Defined results: a null or empty text is the end alone; a null doc_id counts as
the empty text (crc32 0: held out); repeated rows are scored, and train, each for
itself (rows equal in doc_id and text one after the other, in one portion); an
empty table gives an empty table, no training token gives scores from the
smoothing alone. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import cut, drop_table, lean, scratch

SMOOTH = 0.1
#: Words with vectors of their own, bands of other words (together 65,536 at most:
#: items are 16 bits wide), words of context, dimensions.
HEAD, BANDS, ORDER, DIMENSIONS = 32_000, 256, 3, 16
#: Words whose counts are broadcast, those of the head first.
KNOWN = 200_000
FLUSH_WORDS = 500_000
#: Tokens of a portion, rounds of averaging.
PORTION, ROUNDS = 4_000_000, 3
#: Training: tokens of a batch, noise classes of a batch, noise items of a token,
#: rate, start's seed.
BATCH, NOISE_CLASSES, NOISE_ITEMS, RATE, SEED = 4_096, 32, 2, 0.2, 7
#: Floats of a block of a model on its way, of products held at once.
BLOCK, CELLS = 1 << 16, 1 << 17
#: Bytes that a worker may keep while it trains or scores.
KEEP = 32 << 20
#: The end's key: no word has a space.
END = b" "


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    # bytes.lower() and split() know ASCII letters and white space only.
    return [*(text or "").encode().lower().split(), END]


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from zip(batch.column(0)[a : a + 256].to_pylist(), batch.column(1)[a : a + 256].to_pylist())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) of the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for doc_id, text in _rows(batches):
            if not held_out(doc_id):
                seen.update(tokens(text))
                if len(seen) > FLUSH_WORDS:
                    yield from flush()
                    seen = Counter()
        if seen:
            yield from flush()

    return _texts(docs).mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def band_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BANDS


class _Places(dict):
    """Places of known words; of any other, the number of known words plus its band."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + zlib.crc32(word[-3:]) % BANDS


class Items:
    """Head words and bands, numbered by falling mass, and their classes.

    ``of_place``: the item of each known word, then of each band.
    """

    def __init__(self, words: list[bytes], count: np.ndarray, band_mass: np.ndarray, n_words: int):
        """Known words and their counts, the ``n_words`` of the head first; counts of
        each band's words."""
        mass = np.concatenate([count[:n_words], band_mass])
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int64)
        place[order] = np.arange(len(mass))
        self.of_band = place[n_words:]
        self.places = _Places(zip(words, range(len(words))))
        beyond = [self.of_band[band_of(w)] for w in words[n_words:]]
        self.of_place = np.concatenate([place[:n_words], np.array(beyond, np.int64), self.of_band]).astype(np.uint16)
        self.n = len(mass)
        p = (mass + SMOOTH)[order]
        p /= p.sum()
        k = int(np.ceil(np.sqrt(self.n)))
        share = np.minimum(((np.cumsum(p) - p / 2) * k).astype(np.int64), k - 1)
        self.start = np.flatnonzero(np.append(True, np.diff(share) != 0))
        self.size = np.diff(np.append(self.start, self.n))
        self.cls = np.repeat(np.arange(len(self.start)), self.size)
        self.class_p = np.add.reduceat(p, self.start)
        self.log_p = np.log(p / self.class_p[self.cls]).astype(np.float32)
        self.end = self.item(END)

    def item(self, word: bytes) -> int:
        return int(self.of_place[self.places[word]])

    def look(self, words: list[bytes]) -> np.ndarray:
        """Each word's place."""
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))


def contexts(ids: np.ndarray, end: int) -> np.ndarray:
    """[token, position]: the items before each token of a text; ends before it."""
    padded = np.concatenate([np.full(ORDER, end, ids.dtype), ids[:-1]])
    return np.stack([padded[ORDER - 1 - j : len(padded) - j] for j in range(ORDER)], axis=1)


#: A model's arrays; each is followed by its rows' AdaGrad sums and updates.
PARTS = ("r", "q", "c", "s")


class Model:
    """r: items as context, q: items as targets, c: classes, s: positions; the last
    column of q and c is the bias."""

    def __init__(self, items: Items):
        self.items = items
        start = np.random.Generator(np.random.PCG64(SEED))
        n, k, d = items.n, len(items.start), DIMENSIONS
        self.r, self.q, self.c = (start.normal(0, 0.1, (rows, d + extra)).astype(np.float32) for rows, extra in ((n, 0), (n, 1), (k, 1)))
        self.q[:, -1], self.c[:, -1] = items.log_p, np.log(items.class_p)
        self.s = np.repeat((1 / (1 + np.arange(ORDER, dtype=np.float32)))[:, None], d, axis=1)
        self.grown = {part: np.full(len(getattr(self, part)), 1.0, np.float32) for part in PARTS}

    def predict(self, context: np.ndarray) -> np.ndarray:
        h = self.s[0] * self.r[context[:, 0]]
        for j in range(1, ORDER):
            h += self.s[j] * self.r[context[:, j]]
        return h

    def flat(self, weights: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """All rows with their sums; with ``weights``, times them, and the weights."""
        out = []
        for part in PARTS:
            rows = np.concatenate([getattr(self, part), self.grown[part][:, None]], axis=1)
            if weights is not None:
                w = weights[part][:, None]
                rows = np.concatenate([rows * w, w], axis=1)
            out.append(rows.ravel())
        return np.concatenate(out)

    def use(self, flat: np.ndarray, weighted: bool = False) -> Model:
        """Take rows from ``flat``; ``weighted``: sums of rows times weights, where
        rows without weight stay."""
        at = 0
        for part in PARTS:
            mine = getattr(self, part)
            rows = flat[at : at + len(mine) * (mine.shape[1] + 1 + weighted)].reshape(len(mine), -1)
            at += rows.size
            if weighted:
                seen = rows[:, -1] > 0
                rows, to = rows[seen, :-1] / rows[seen, -1:], np.flatnonzero(seen)
            else:
                to = slice(None)
            mine[to], self.grown[part][to] = rows[:, :-1], rows[:, -1]
        return self

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log P(target | context) of tokens sorted by target."""
        items = self.items
        h = self.predict(context)
        h = np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)  # the bias's input is one
        cls = items.cls[target]
        out = _log_share(h, self.c, cls)
        edges = np.flatnonzero(np.append(True, np.diff(cls) != 0))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cls)]):
            k = int(cls[a])
            first, size = int(items.start[k]), int(items.size[k])
            if size > 1:
                out[a:b] += _log_share(h[a:b], self.q[first : first + size], target[a:b] - first)
        return out


def _log_share(h: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """h . v of the chosen vectors minus the logarithm of the sum of exp(h . v) over
    all, in pieces of rows that stay in the cache."""
    out, ones = np.empty(len(h)), np.ones(len(vectors), np.float32)
    step = max(1, CELLS // len(vectors))
    for a in range(0, len(h), step):
        s = h[a : a + step] @ vectors.T
        own = s[np.arange(len(s)), chosen[a : a + step]]
        with np.errstate(over="ignore"):
            total = np.exp(s) @ ones
        if not (np.isfinite(total).all() and (total > 1e-30).all()):
            top = s.max(axis=1)
            own, total = own - top, np.exp(s - top[:, None]).sum(axis=1)
        out[a : a + step] = own - np.log(total)
    return out


class Trainer:
    def __init__(self, model: Model, seed: int):
        self.m = model
        self.noise = np.random.Generator(np.random.PCG64(seed))
        self.cumulative = np.cumsum(model.items.class_p)
        self.class_noise = np.log(NOISE_CLASSES * model.items.class_p).astype(np.float32)
        self.item_noise = np.log(NOISE_ITEMS / model.items.size).astype(np.float32)
        self.weights = {part: np.zeros(len(model.grown[part]), np.float32) for part in PARTS}

    def _step(self, part: str, rows: np.ndarray, gradient: np.ndarray, ordered: bool = False) -> None:
        """AdaGrad, one sum a row, on the rows' summed gradients."""
        if not ordered:
            order = np.argsort(rows, kind="stable")
            rows, gradient = rows[order], gradient[order]
        first = np.flatnonzero(rows[1:] != rows[:-1])
        first += 1
        first = np.concatenate([[0], first])
        total, touched = np.add.reduceat(gradient, first, axis=0), rows[first]
        self.weights[part][touched] += np.diff(first, append=len(rows))
        grown = self.m.grown[part][touched] + np.einsum("ij,ij->i", total, total) / np.float32(DIMENSIONS)
        self.m.grown[part][touched] = grown
        total *= (np.float32(RATE) / np.sqrt(grown))[:, None]
        getattr(self.m, part)[touched] += total

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        m, items = self.m, self.m.items
        order = np.argsort(target, kind="stable")
        context, target = context[order], target[order]
        cls = items.cls[target]
        seen = [m.r[context[:, j]] for j in range(ORDER)]
        # The bias's input is one.
        wide = np.ones((len(target), DIMENSIONS + 1), np.float32)
        wide[:, :-1] = sum(s * r for s, r in zip(m.s, seen))
        noise = np.minimum(np.searchsorted(self.cumulative, self.noise.random(NOISE_CLASSES, np.float32)), len(items.start) - 1)
        ct, cn = m.c[cls], m.c[noise]
        with np.errstate(over="ignore"):
            gp = 1 / (1 + np.exp(np.einsum("ij,ij->i", wide, ct) - self.class_noise[cls]))
            gn = wide @ -cn.T
            gn += self.class_noise[noise]
            np.exp(gn, out=gn)
            gn += 1
            np.divide(-1, gn, out=gn)
            dh = gn @ cn
            ct *= gp[:, None]
            dh += ct
            # Tokens of classes with more than one item learn within their class;
            # noise is uniform there, as a class's items are about as frequent.
            many = np.flatnonzero(items.size[cls] > 1)
            t, k, w = target[many], cls[many], wide[many]
            size, offset = items.size[k], self.item_noise[k]
            drawn = items.start[k] + np.minimum((self.noise.random((NOISE_ITEMS, len(t)), np.float32) * size).astype(np.int64), size - 1)
            qt = m.q[t]
            ip = 1 / (1 + np.exp(np.einsum("ij,ij->i", w, qt) - offset))
            qt *= ip[:, None]
            moved = [ip[:, None] * w]
            for d in drawn:
                qn = m.q[d]
                jn = -1 / (1 + np.exp(offset - np.einsum("ij,ij->i", w, qn)))
                qn *= jn[:, None]
                qt += qn
                moved.append(jn[:, None] * w)
        dh[many] += qt
        dh = dh[:, :-1]
        self._step("c", cls, gp[:, None] * wide, ordered=True)
        self._step("c", noise, gn.T @ wide)
        if len(t):
            self._step("q", np.concatenate([t, *drawn.astype(t.dtype)]), np.concatenate(moved))
        moves = np.stack([np.einsum("ij,ij->j", r, dh) for r in seen])
        self._step("r", context.T.ravel(), np.concatenate([s * dh for s in m.s]))
        self._step("s", np.arange(ORDER), moves / np.float32(np.sqrt(len(dh))), ordered=True)


READ = "row long, doc_id string, portion long, n_tokens long, n_known long, base double, ids binary, word binary, tf long, round long"
#: Rounds of rows that don't train: held-out texts, words beyond the known ones.
HELD_OUT, BEYOND = -1, -2


def read(docs: DataFrame, known, portions: int, rounds: int) -> DataFrame:
    """A written table by ``round`` with two kinds of rows: a text's ids, counts of
    tokens and base score without the words beyond the known ones; and those words
    of a text (row, word, tf)."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, band_mass, n_head = known.value
        items = _items(key, known.value)
        logs, n_known = np.concatenate([np.log10(count + SMOOTH), np.zeros(BANDS)]), len(words)
        at = TaskContext.get().partitionId() << 33
        schema = pa.schema([(n, t) for n, t in zip(READ.replace(",", "").split()[::2], [pa.int64(), pa.string(), *[pa.int64()] * 3, pa.float64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])])
        texts, rest = [], ([], [], [])

        def flush():
            columns = [*zip(*texts)]
            n, k = len(texts), len(rest[0])
            by_name = dict(zip(("row", "doc_id", "portion", "n_tokens", "n_known", "base", "ids", "round"), columns))
            yield pa.RecordBatch.from_arrays([pa.array(by_name[f.name], f.type) if f.name in by_name else pa.nulls(n, f.type) for f in schema], schema=schema)
            by_name = {"row": rest[0], "word": rest[1], "tf": rest[2], "round": np.full(k, BEYOND)}
            yield pa.RecordBatch.from_arrays([pa.array(by_name[f.name], f.type) if f.name in by_name else pa.nulls(k, f.type) for f in schema], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256).to_pydict()
                for doc_id, portion, text in zip(piece["doc_id"], piece["portion"], piece["text"]):
                    ws = tokens(text)
                    places = items.look(ws)
                    beyond = np.flatnonzero(places >= n_known).tolist()
                    if beyond:
                        times = Counter(map(ws.__getitem__, beyond))
                        rest[0].extend([at] * len(times))
                        rest[1].extend(times)
                        rest[2].extend(times.values())
                    ids = items.of_place[places].astype("<u2", copy=False).tobytes()
                    texts.append((at, doc_id, portion, len(ws), len(ws) - len(beyond), float(logs[places].sum()), ids, HELD_OUT if held_out(doc_id) else portion % rounds))
                    at += 1
                if len(rest[0]) > 50_000 or len(texts) >= 2_000:
                    yield from flush()
                    texts, rest = [], ([], [], [])
        if texts:
            yield from flush()

    dealt = _texts(docs).withColumn("portion", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.coalesce("text", F.lit(""))), F.lit(portions)))
    path = scratch(docs.sparkSession)
    dealt.mapInArrow(lean(run), READ).write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(READ).parquet(path)


def train(table: DataFrame, items: Items, known, portions: int, rounds: int) -> Model:
    """One pass over the training tokens, in rounds of portions."""
    key, model = uuid.uuid4().hex, Model(items)
    for at in range(rounds):
        model = _round(table.where(F.col("round") == at), model, known, key, -(-(portions - at) // rounds), rounds)
    return model


def _round(rows: DataFrame, model: Model, words, key: str, portions: int, rounds: int) -> Model:
    start = rows.sparkSession.sparkContext.broadcast(model.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, portion, trainer, held, size = _items(key, words.value), None, None, [], 0

        def learn(at_least: int):
            nonlocal held, size
            context, target = (np.concatenate(x) for x in zip(*held))
            done = len(target) - len(target) % at_least
            for a in range(0, done, BATCH):
                trainer.learn(context[a : a + BATCH][: done - a], target[a : a + BATCH][: done - a])
            held, size = [(context[done:], target[done:])], len(target) - done

        def finish():
            learn(1)
            flat = trainer.m.flat(trainer.weights)
            for a in range(0, len(flat), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([portion], pa.int64()), pa.array([a // BLOCK], pa.int32()), pa.array([flat[a : a + BLOCK].astype("<f4").tobytes()], pa.binary())],
                    ["salt", "block", "values"],
                )

        for batch in batches:
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != portion:
                    if portion is not None:
                        yield from finish()
                    portion, held, size = p, [], 0
                    trainer = Trainer(Model(items).use(start.value), SEED + p)
                ids = np.frombuffer(ids, "<u2")
                held.append((contexts(ids, items.end), ids))
                size += len(ids)
                if size >= 8 * BATCH:
                    learn(BATCH)
        if portion is not None:
            yield from finish()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.float64)
        for v in table["values"]:
            total = total + np.frombuffer(v.as_buffer(), "<f4")
        return pa.table({"salt": table["salt"][:1], "block": table["block"][:1], "values": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema = "salt long, block int, values binary"
    # Two steps of sums: about sqrt(portions) models in each.
    salts = max(1, round(portions**0.5))
    dealt = rows.repartitionById(portions, F.floor(F.col("portion") / rounds).cast("int")).sortWithinPartitions("portion", "doc_id", "ids")
    models = dealt.select("portion", "ids").mapInArrow(lean(run, KEEP), schema)
    halves = models.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("salt", "block").applyInArrow(add, schema)
    done = halves.withColumn("salt", F.lit(0).cast("long")).groupBy("salt", "block").applyInArrow(add, schema).collect()  # one model
    start.unpersist()
    if done:
        model.use(np.concatenate([np.frombuffer(r["values"], "<f4") for r in sorted(done, key=lambda r: r["block"])]), weighted=True)
    return model


_held: dict = {}


def _items(key: str, words: tuple) -> Items:
    """This worker's items; built once per model."""
    if key not in _held:
        _held.clear()
        _held[key] = Items(*words)
    return _held[key]


def _known(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray, int]:
    """Words by falling count, KNOWN at most, their counts, and the least count.

    They are those from a count on. It is found from a histogram of the counts'
    logarithms (some hundred rows), then from one of the counts in the step where
    the border is, so nothing else reaches the driver.
    """
    step = F.floor(F.log2("c") * 8).cast("int").alias("step")
    number = F.count(F.lit(1)).alias("n")
    least, held = None, 0
    for at, n, c in sorted(map(tuple, vocabulary.groupBy(step).agg(number, F.min("c")).collect()), reverse=True):
        if held + n > KNOWN:
            for c, n in sorted(map(tuple, vocabulary.where(step == at).groupBy("c").agg(number).collect()), reverse=True):
                held += n
                if held > KNOWN:
                    break
                least = c
            break
        held, least = held + n, c
    if least is None:
        return [], np.zeros(0), (vocabulary.agg(F.max("c")).first()[0] or 0) + 1
    top = vocabulary.where(F.col("c") >= least).toArrow()
    words, count = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda i: (-count[i], words[i]))
    return [words[i] for i in order], count[order], least


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    vocabulary = cut(counts(docs))
    whole = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_types = int(whole["n"] or 0), int(whole["v"])
    words, count, least = _known(vocabulary)
    n_head = min(HEAD, len(words))
    band_mass, band_types = np.zeros(BANDS), np.zeros(BANDS)
    for w, c in zip(words[n_head:], count[n_head:]):
        band_mass[band_of(w)] += c
        band_types[band_of(w)] += 1
    band = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(BANDS)).alias("band")
    for r in vocabulary.where(F.col("c") < least).groupBy(band).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        band_mass[r["band"]] += r["c"]
        band_types[r["band"]] += r["n"]
    known = spark.sparkContext.broadcast((words, count, band_mass, n_head))
    portions = max(1, -(-n_train // PORTION))
    rounds = min(ROUNDS, portions)
    table = read(docs, known, portions, rounds)
    items = Items(words, count, band_mass, n_head)
    model = train(table, items, known, portions, rounds)
    shared = spark.sparkContext.broadcast((band_types, model.flat()))
    key = uuid.uuid4().hex
    base_mass = n_train + SMOOTH * (n_types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_types, flat = shared.value
        words, count, band_mass, n_head = known.value
        items = _items(key, known.value)
        model = Model(items).use(flat)
        # What a band's word pays for the choice in its band; its smoothed count is
        # in the base score's sum, and head words' there are taken off.
        share = np.zeros(items.n)
        share[items.of_place[:n_head]] = -np.log10(count[:n_head] + SMOOTH)
        share[items.of_band] = -np.log10(band_mass + SMOOTH * (band_types + 1))
        for batch in batches:
            texts = [np.frombuffer(i, "<u2") for i in batch.column(2).to_pylist()]
            total, first = np.zeros(len(texts)), 0
            while first < len(texts):
                last, size = first + 1, len(texts[first])
                while last < len(texts) and size < 8 * BATCH:
                    size += len(texts[last])
                    last += 1
                target = np.concatenate(texts[first:last])
                doc = np.repeat(np.arange(first, last), [len(i) for i in texts[first:last]])
                context = np.concatenate([contexts(i, items.end) for i in texts[first:last]])
                for a in range(0, len(target), 8 * BATCH):
                    order = np.argsort(target[a : a + 8 * BATCH], kind="stable") + a
                    t = target[order]
                    total += np.bincount(doc[order], model.log_p(context[order], t) / np.log(10) + share[t], len(texts))
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), batch.column(5), pa.array(total)], ["row", "doc_id", "n_tokens", "n_known", "base", "model"])

    texts = table.where(F.col("round") >= HELD_OUT).select("row", "doc_id", "ids", "n_tokens", "n_known", "base")
    rows = texts.mapInArrow(lean(run, KEEP), "row long, doc_id string, n_tokens long, n_known long, base double, model double")
    # The exact way for words beyond the known ones. Those seen in training are in
    # the vocabulary; the others have count 0.
    rare = table.where(F.col("round") == BEYOND).select("row", "word", "tf").join(vocabulary, "word", "left")
    log_count = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH))
    extra = rare.groupBy("row").agg(F.sum(F.col("tf") * log_count).alias("extra"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("found"))
    both = rows.join(extra, "row", "left")
    base = F.col("base") + F.coalesce(F.col("extra"), F.lit(0.0))
    doc_type = docs.schema["doc_id"].dataType
    return both.select(
        F.col("doc_id").cast(doc_type).alias("doc_id"),
        (F.crc32(F.coalesce("doc_id", F.lit(""))) % 10 == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(float(np.log10(base_mass)))).alias("base_score"),
        (F.col("model") + base).alias("score"),
    )
