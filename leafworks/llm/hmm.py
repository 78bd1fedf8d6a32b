"""Language-model scoring by a hidden Markov model.

Latent states emit symbols: the ``FREQUENT`` commonest words have one each, all others share a symbol
with the words of the same ending, and the end of a text is a symbol. A rare word's probability is that
of its symbol in the state, times (c + 1) / (n + v + 1) of its count c among the n tokens and v words of the
symbol; the last 1 is left for words never seen, which are one word to their symbol (as they are one to the
base). So it is a proper probability of texts whose unseen words are told apart by their symbols only, and the
counts of all words of the training texts take part, however many they are.

1. Words are counted in tasks and summed by word (a table that grows with the corpus, never collected).
2. Texts are encoded once as symbols; rare words travel beside them and are joined with their counts.
3. Baum-Welch: from a start on ``WARM`` texts, each iteration runs scaled forward and backward recursions
   over all training texts, sums the expected counts (states x symbols) by block of symbols, and
   re-estimates. The model is bounded by its parameters.
4. The scaled forward recursion over whole texts gives the exact likelihood.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import pack_texts, settle, slices, squeeze, text_bytes, unpack_texts, unsqueeze, width
from leafworks.llm.quality import held_out

STATES, FREQUENT, ENDINGS = 8, 32_768, 1024
WARM, WARM_ROUNDS, ROUNDS = 400, 12, 3
#: Iterations over all texts end when the log likelihood gains less than this share of itself.
TOLERANCE = 2e-3
#: About as many chunks make a task.
CHUNKS_A_TASK = 64
BLOCK = 2048
#: Tokens that a task has in hand at once; a longer text is taken alone.
TOKENS = 1_000_000
NO_ID = np.iinfo(np.int64).max


class Symbols(dict):
    """Word to symbol; words that aren't among the frequent ones by their last three bytes."""

    def __missing__(self, word: bytes) -> int:
        return self.frequent + zlib.crc32(word[-3:]) % ENDINGS

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.frequent = len(words)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over the rows of ``docs(text)``, settled; without the end of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for batch in slices(batches, "text"):
            for text in text_bytes(batch.column("text")):
                counts.update(text.lower().split())
                if len(counts) > 400_000:
                    yield out()
        if counts:
            yield out()

    return settle(docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "hmm-counts")


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of ``counts(word, c)`` with the highest counts and these, ``most`` at most: all words whose count
    reaches the smallest bar that so many or fewer reach. The bar comes from a histogram of counts (by powers
    of 2 ** (1 / 16), then by count within the slice where it lies), so no task sends its own best words."""
    power = F.floor(F.log2("c") * 16).cast("int")
    left, bar = most, None
    for row in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("p")).collect():
        if row.n > left:
            inside = counts.filter(power == row.p).groupBy("c").count().orderBy(F.desc("c")).collect()
            for c, n in inside:
                if n > left:
                    break
                left, bar = left - n, c
            break
        left, bar = left - row.n, row.least
    if bar is None:
        return []
    found = [(bytes(r.word), r.c) for r in counts.filter(F.col("c") >= bar).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def symbol_counts(counts: DataFrame, words: list[bytes], ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each symbol."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Symbols(shared.value)
        n = len(get) + ENDINGS
        tokens, kinds = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            own = np.fromiter(map(get.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            tokens += np.bincount(own, batch.column("c").to_numpy(), n).astype(np.int64)
            kinds += np.bincount(own, minlength=n)
        seen = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(tokens[seen]), pa.array(kinds[seen])], names=["symbol", "tokens", "kinds"])

    n = len(words) + ENDINGS + 1
    tokens, kinds = np.zeros(n), np.zeros(n)
    for r in counts.mapInArrow(run, "symbol bigint, tokens bigint, kinds bigint").groupBy("symbol").agg(F.sum("tokens"), F.sum("kinds")).collect():  # n rows at most
        tokens[r[0]], kinds[r[0]] = r[1], r[2]
    tokens[-1], kinds[-1] = ends, ends > 0
    return tokens, kinds


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``docs(doc_id, text, train)`` as settled chunks of symbols, rare words beside them."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, part = Symbols(shared.value), TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text")):
            sequences, rare = [], []
            for text in text_bytes(batch.column("text")):
                found = text.lower().split()
                own = np.empty(len(found) + 1, np.uint16)
                own[:-1] = np.fromiter(map(get.__getitem__, found), np.uint16, len(found))
                own[-1] = get.frequent + ENDINGS
                sequences.append(own)
                rare.append(b" ".join([found[i] for i in np.flatnonzero(own[:-1] >= get.frequent).tolist()]))
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            blobs = [squeeze(ids), squeeze(train), squeeze(np.array([len(x) for x in sequences], np.int64)), squeeze(np.concatenate(sequences)), pack_texts(rare)]
            yield pa.RecordBatch.from_arrays([pa.array([part << 16 | k]), *[pa.array([x], pa.binary()) for x in blobs]], names=["chunk", "ids", "train", "lengths", "symbols", "rare"])

    return settle(docs.select("doc_id", "text", "train").mapInArrow(run, "chunk bigint, ids binary, train binary, lengths binary, symbols binary, rare binary"), "hmm-encoded")


class Ragged:
    """Sequences side by side, longest first, to step through together."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.symbols = symbols
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), side="left").tolist()  # with length > t

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.starts[: self.active[t]] + t]


def forward(model: Model, seq: Ragged) -> np.ndarray:
    """Natural log likelihood of each sequence, in the order given."""
    out = np.zeros(len(seq.lengths))
    alpha = None
    for t, n in enumerate(seq.active):
        alpha = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else alpha[:n] @ model.move) * model.emit[seq.at(t)]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty_like(out)
    back[seq.order] = out
    return back


def expect(model: Model, seq: Ragged, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    """Add the expected counts of the sequences to ``start``, ``move`` and ``emit``; returns the log likelihood."""
    k, total = len(model.start), 0.0
    places = np.concatenate(([0], np.cumsum(seq.active)))
    store, scales = np.empty((places[-1], k), np.float32), np.empty(places[-1])
    alpha = None
    for t, n in enumerate(seq.active):
        alpha = (np.broadcast_to(model.start, (n, k)) if t == 0 else alpha[:n] @ model.move) * model.emit[seq.at(t)]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        store[places[t] : places[t + 1]] = alpha
        scales[places[t] : places[t + 1]] = scale
    total = float(np.log(scales).sum())
    beta, pairs, order = np.zeros((0, k)), np.zeros((k, k)), np.empty(places[-1], np.int64)
    for t in range(len(seq.active) - 1, -1, -1):
        n, held = seq.active[t], len(beta)
        now = store[places[t] : places[t + 1]]
        if held < n:  # sequences that end here
            beta = np.concatenate([beta, np.ones((n - held, k))])
        symbols = seq.at(t)
        order[places[t] : places[t + 1]] = symbols
        ahead = beta * model.emit[symbols] / scales[places[t] : places[t + 1]][:, None]
        now *= beta  # the state's posterior
        if t:
            before = store[places[t - 1] : places[t - 1] + n]
            pairs += before.T @ ahead
            beta = ahead @ model.move.T
        else:
            start += now.sum(axis=0)
    move += pairs * model.move
    for s in range(k):
        emit[:, s] += np.bincount(order, store[:, s], len(emit))
    return total


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
    """Counts to probabilities; ``share`` of the symbols smooths the emissions, so none is 0."""
    strength = 50.0 + 1e-3 * emit.sum(axis=0)
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), (emit + share[:, None] * strength) / (emit.sum(axis=0) + strength))


def first_model(states: int, share: np.ndarray, seed: int) -> Model:
    noise = np.random.default_rng(seed).gamma(2.0, size=(len(share), states)) * share[:, None]
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, noise / noise.sum(axis=0))


def _gathered(batches: Iterator[pa.RecordBatch], train: bool) -> Iterator[tuple]:
    """(chunk, row, doc_id, train of each sequence), lengths and symbols of up to TOKENS tokens."""
    held, tokens = [], 0

    def out():
        keys = [np.concatenate([h[i] for h in held]) for i in range(6)]
        held.clear()
        return keys

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("chunk", "ids", "train", "lengths", "symbols")}
            ids, flag, lengths, symbols = unsqueeze(row["ids"], np.int64), unsqueeze(row["train"], np.uint8), unsqueeze(row["lengths"], np.int64), unsqueeze(row["symbols"], np.uint16)
            if train:
                symbols, lengths = symbols[np.repeat(flag, lengths) > 0], lengths[flag > 0]
                ids, flag = ids[flag > 0], flag[flag > 0]
            if not len(lengths):
                continue
            if tokens and tokens + len(symbols) > TOKENS:
                yield out()
                tokens = 0
            held.append((np.full(len(lengths), row["chunk"]), np.arange(len(lengths)), ids, flag, lengths, symbols))
            tokens += len(symbols)
    if held:
        yield out()


def baum_welch(chunks: DataFrame, model: Model, share: np.ndarray, parts: int = 1) -> tuple[Model, float]:
    """One iteration over all training texts: the next model, and the log likelihood (natural) under ``model``."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))
    states, symbols = len(model.start), len(share)
    blocks = -(-symbols // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        start, move, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0
        for _, _, _, _, lengths, seq in _gathered(batches, True):
            likelihood += expect(m, Ragged(seq, lengths), start, move, emit)
        blobs = [squeeze(emit[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)] + [squeeze(np.concatenate([start, move.ravel(), [likelihood]]))]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[b] = sums.get(b, 0) + unsqueeze(x, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([squeeze(x) for x in sums.values()], pa.binary())], names=["block", "counts"])

    # summed in two steps, so that no task adds up more than about the root of the number of tasks
    made = chunks.select("chunk", "ids", "train", "lengths", "symbols").mapInArrow(run, "block int, counts binary")
    if parts > 1:
        made = made.withColumn("part", F.spark_partition_id() % parts).repartition((blocks + 1) * parts, "block", "part").mapInArrow(add, "block int, counts binary")
    summed = made.repartition(blocks + 1, "block").mapInArrow(add, "block int, counts binary")
    found = {r.block: unsqueeze(bytes(r.counts), float) for r in summed.collect()}  # the model's size
    emit = np.concatenate([found[b] for b in range(blocks)]).reshape(symbols, states)
    start, move, likelihood = np.split(found[blocks], [states, states + states * states])
    return estimate(start, move.reshape(states, states), emit, share), float(likelihood[0])


def warm_start(chunks: DataFrame, model: Model, share: np.ndarray, texts: int) -> Model:
    """Iterations over the first ``texts`` training texts of some chunks, to begin from."""
    # numbers alone are ordered, or else every task sends chunks
    chosen = [r.chunk for r in chunks.select("chunk").orderBy(F.xxhash64(F.lit(9), "chunk")).limit(4).collect()]
    rows = chunks.filter(F.col("chunk").isin(chosen)).select("train", "lengths", "symbols").orderBy(F.xxhash64(F.lit(9), "chunk")).collect()
    lengths, symbols = [], []
    for r in rows:
        n, flag, s = unsqueeze(bytes(r.lengths), np.int64), unsqueeze(bytes(r.train), np.uint8), unsqueeze(bytes(r.symbols), np.uint16)
        for a, b, f in zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), flag.tolist()):
            if f and b - a < 2000:
                lengths.append(b - a)
                symbols.append(s[a:b])
    step = max(1, len(lengths) // texts)
    lengths, symbols = lengths[::step][:texts], symbols[::step][:texts]
    if not lengths:
        return model
    seq = Ragged(np.concatenate(symbols), np.array(lengths))
    for _ in range(WARM_ROUNDS):
        start, move, emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
        expect(model, seq, start, move, emit)
        model = estimate(start, move, emit, share)
    return model


def lm_scores(docs: DataFrame, states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS, seed: int = 3, tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of ``docs(doc_id, text)``.

    Learns from rows whose crc32 of the id (as text) mod 7 isn't 2. base_score: add-one unigram; score:
    log10 of the model's probability of the whole text, its end included. Null and blank texts are the
    end alone; a row without an id is a training text; repeated rows are counted as often as they are
    there; with no training texts the counts are 0 and the states alike; an empty table gives an empty table.
    """
    if frequent + ENDINGS >= 1 << 16:
        raise ValueError("frequent and ENDINGS must leave the symbols below 65,536")
    docs = docs.select("doc_id", "text", (~held_out(F.col("doc_id"), 7, 2)).alias("train"))
    counts = word_counts(docs.filter("train"))
    # counts once more by the driver: numbers only, and the frequent words, `frequent` at most
    tokens, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    ends = docs.filter("train").count()
    n, v = (tokens or 0) + ends, kinds + (ends > 0)
    top = frequent_words(counts, frequent)
    words = [w for w, _ in top]
    per_symbol, distinct = symbol_counts(counts, words, ends)
    share = (per_symbol + 1) / (per_symbol.sum() + len(per_symbol))
    chunks = encoded(docs, words)
    model = warm_start(chunks, first_model(states, share, seed), share, WARM)
    parts, before = math.isqrt(chunks.count() // CHUNKS_A_TASK), None
    for _ in range(rounds):
        model, likelihood = baum_welch(chunks, model, share, parts)
        if before is not None and likelihood - before < tolerance * abs(before):
            break
        before = likelihood

    # what a token adds besides its symbol: nothing, or the part of a rare symbol that all its words share
    spread, known = np.zeros(len(share)), np.zeros(len(share))
    spread[len(words) : -1] = -np.log10(per_symbol[len(words) : -1] + distinct[len(words) : -1] + 1)
    known[: len(words)] = np.log10(np.array([c for _, c in top], float) + 1)
    known[-1] = math.log10(ends + 1)
    is_known = np.zeros(len(share))
    is_known[: len(words)], is_known[-1] = 1, ends > 0
    shared = docs.sparkSession.sparkContext.broadcast(((model.start, model.move, model.emit), spread, known, is_known))
    floor = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spread, known, is_known = shared.value
        m = Model(*model)
        for chunk, row, ids, train, lengths, symbols in _gathered(batches, False):
            likelihood = forward(m, Ragged(symbols, lengths)) / math.log(10)
            at = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x[symbols], at) for x in (spread, known, is_known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk << 24 | row), pa.array(ids, mask=ids == NO_ID), pa.array(train == 0), pa.array(lengths), pa.array(likelihood + sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))],
                names=["key", "doc_id", "held_out", "n_tokens", "model", "logs", "n_top"],
            )

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column("chunk")[i].as_py()
                keys, found, times = [], [], []
                for row, text in enumerate(unpack_texts(batch.column("rare")[i].as_py())):
                    own = Counter(text.split())
                    keys += [chunk << 24 | row] * len(own)
                    found += own
                    times += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.int32())], names=["key", "word", "times"])

    texts = chunks.select("chunk", "ids", "train", "lengths", "symbols").mapInArrow(run, "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, model double, logs double, n_top bigint")
    rare = (
        chunks.select("chunk", "rare")
        .mapInArrow(rare_words, "key bigint, word binary, times int")
        .join(counts, "word")
        .groupBy("key")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"), F.sum("times").alias("n_rare"))
    )
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return texts.join(rare, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
