"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut (the first piece is the short one); pieces that fill a sequence
stand alone, the others are dealt out by hash into shards of about ``SHARD`` pieces. A shard is a packing
problem of its own, worked on by several islands: each holds a population of groupings that starts from
best-fit decreasing and randomised orders. Crossover injects whole well-filled bins of one parent into the
other, bins that repeat an injected piece are dissolved, and the displaced pieces are put back best fit,
longest first. After each epoch an island's elite migrates to the next island. A shard at its lower
bound (words / size, rounded up) is done. Sharding costs less than one sequence for each shard.
"""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator
from json import loads as load_json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import settle, slices, squeeze, unsqueeze, width

SHARD = 4096
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 4, 8
NO_ID = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level pre-tokenizer cuts a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(json: str) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE file as bytes by id, if its merges are ranked by id; else None."""
    file = load_json(json)
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = model["vocab"]
    joined = [x.replace(" ", "", 1) if isinstance(x, str) else "".join(x) for x in model["merges"]]
    ids = [vocabulary.get(x) for x in joined]
    if None in ids or any(a >= b for a, b in zip(ids, ids[1:])) or len(vocabulary) != 256 + len(ids):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), as the tokenizers file has them.

    A byte-level BPE whose ids are its merge ranks is run by the faster of two equal implementations
    (the tests hold it against the other); any other file by the ``tokenizers`` library, and so is a text
    that the faster one gives up on (about a million white-space characters in a row).
    """

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json, self.fast, self._slow = json, None, None
        ranks = byte_ranks(json)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.json)
            self._slow.encode_special_tokens = True
        return self._slow

    def one(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its regular expressions have a stack of a fixed size
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return list(map(self.one, texts))
        return [np.array(x.ids, "<u4").tobytes() for x in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(docs: DataFrame, size: int, end: int, vocabulary: str | None, ids: bool) -> DataFrame:
    """``(rid, doc_id, piece, start, length, ids_crc32[, ids])``, settled; rid is a row number of no meaning."""
    json = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_text())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(json.value), np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            found = encode([x or "" for x in batch.column("text").to_pylist()])
            for doc, own in zip(batch.column("doc_id").to_pylist(), found):
                own += last
                n = len(own) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = own[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    made = docs.select("doc_id", "text").mapInArrow(run, schema)
    return settle(made.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")


def best_fit(sizes: list[int], order, room: int, bins: list[list[int]]) -> list[list[int]]:
    """Put the pieces in ``order`` into the fullest of ``bins`` that takes them, or into new ones."""
    free_at: dict[int, list[int]] = {}
    open_ = 0
    for k, own in enumerate(bins):
        if free := room - sum(sizes[i] for i in own):
            free_at.setdefault(free, []).append(k)
            open_ |= 1 << free
    for i in order:
        need = sizes[i]
        fits = open_ >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            stack = free_at[free]
            k = stack.pop()
            if not stack:
                open_ &= ~(1 << free)
            bins[k].append(i)
            free -= need
        else:
            k, free = len(bins), room - need
            bins.append([i])
        if free:
            free_at.setdefault(free, []).append(k)
            open_ |= 1 << free
    return bins


def cross(sizes: list[int], room: int, one: list[list[int]], other: list[list[int]], rng: random.Random) -> list[list[int]]:
    """Well-filled bins of ``other`` injected into ``one``; what that displaces goes back best fit."""
    full = sorted(other, key=lambda b: -sum(sizes[i] for i in b))[: max(1, len(other) // 2)]
    taken = [b for b in full if rng.random() < 0.5] or full[:1]
    inside = {i for b in taken for i in b}
    kept, displaced = [list(b) for b in taken], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    # the worst bin is dissolved as well, else nothing new may come of two alike parents
    worst = min(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
    displaced += kept.pop(worst)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, room, kept)


def worth(sizes: list[int], room: int, bins: list[list[int]]) -> tuple[int, float]:
    """Smaller is better: bins, then how far they are from some full and some empty ones."""
    return len(bins), -sum((sum(sizes[i] for i in b) / room) ** 2 for b in bins)


def evolve(sizes: list[int], room: int, population: list[list[list[int]]], seed: int) -> list[list[list[int]]]:
    """One epoch; the best grouping comes first."""
    rng, bound = random.Random(seed), -(-sum(sizes) // room)
    n = len(sizes)
    if not population:
        order = sorted(range(n), key=lambda i: -sizes[i])
        population = [best_fit(sizes, order, room, [])]
        while len(population) < POPULATION and len(population[0]) > bound:
            population.append(best_fit(sizes, sorted(range(n), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2)), room, []))
    ranked = sorted(((worth(sizes, room, x), x) for x in population), key=lambda x: x[0])
    for _ in range(OFFSPRING):
        if ranked[0][0][0] <= bound:
            break
        a, b = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
        child = cross(sizes, room, ranked[a][1], ranked[b][1], rng)
        ranked = sorted([*ranked, (worth(sizes, room, child), child)], key=lambda x: x[0])[:POPULATION]
    return [x for _, x in ranked]


def _flat(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _grouped(flat: np.ndarray) -> list[list[int]]:
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


FIELDS = ("rid", "doc_id", "piece", "start", "length", "ids_crc32")


def _shards(rest: DataFrame, number: int) -> DataFrame:
    """One settled row for each shard: its pieces, longest first."""
    home = F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(number)).cast("int").alias("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = {c: np.concatenate([(b.column(c).fill_null(NO_ID) if c == "doc_id" else b.column(c)).to_numpy(zero_copy_only=False) for b in batches]).astype(np.int64) for c in ("shard", *FIELDS)}
        order = np.lexsort((rows["rid"], -rows["length"], rows["shard"]))
        shard = rows["shard"][order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int32()), *[pa.array([squeeze(rows[c][own])], pa.binary()) for c in FIELDS]], names=["shard", *FIELDS])

    dealt = rest.select(home, *FIELDS).repartition(width(rest.sparkSession), "shard")
    return settle(dealt.mapInArrow(run, "shard int, " + ", ".join(f"{c} binary" for c in FIELDS)), "pack-shards")


def _epoch(shards: DataFrame, held: DataFrame | None, size: int, epoch: int, seed: int) -> DataFrame:
    """``(shard, island, bins, worth, population)`` after one epoch on each island of each shard."""
    islands = shards.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    if held is None:
        islands = islands.withColumns({"population": F.lit(None).cast("binary"), "guest": F.lit(None).cast("binary")})
    else:
        guests = held.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        islands = islands.join(held.select("shard", "island", "population"), ["shard", "island"]).join(guests, ["shard", "island"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sizes = unsqueeze(row["length"], np.int64).tolist()
                n, before = len(sizes), []
                if row["population"] is not None:
                    flat = unsqueeze(row["population"], np.int32)
                    before = [_grouped(flat[k : k + n]) for k in range(0, len(flat), n)] + [_grouped(unsqueeze(row["guest"], np.int32))]
                after = evolve(sizes, size, before, seed + 1000 * row["shard"] + 10 * row["island"] + epoch)
                flat = [_flat(x, n) for x in after]
                bins, value = worth(sizes, size, after[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int32()), pa.array([row["island"]], pa.int32()), pa.array([bins], pa.int32()), pa.array([value], pa.float64()), pa.array([squeeze(np.concatenate(flat))], pa.binary()), pa.array([squeeze(flat[0])], pa.binary())],
                    names=["shard", "island", "bins", "worth", "population", "elite"],
                )

    spread = islands.repartition(2 * width(shards.sparkSession), "shard", "island")
    return settle(spread.mapInArrow(run, "shard int, island int, bins int, worth double, population binary, elite binary"), "pack-epoch")


def pack(docs: DataFrame, size: int = 1024, end: int = 2, vocabulary: str | None = None, ids: bool = False, seed: int = 11) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])`` of ``docs(doc_id, text)``.

    A document is its ids and then ``end``; only one of more than ``size`` ids is cut, into pieces of
    ``size`` of which the first may be shorter. Pieces of a sequence follow each other without gaps.
    Null and empty texts are the end id alone; repeated rows and rows without an id are documents of
    their own; an empty table gives an empty table.
    """
    cut = pieces(docs, size, end, vocabulary, ids)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.filter(F.col("length") == size).select("rid", *columns, (F.col("rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < size)
    number = max(1, round(rest.count() / SHARD))
    shards = _shards(rest, number)
    held = None
    for epoch in range(EPOCHS):
        held = _epoch(shards, held, size, epoch, seed)
    best = held.groupBy("shard").agg(F.min_by("elite", F.struct("bins", "worth", "island")).alias("elite"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: unsqueeze(batch.column(c)[i].as_py(), np.int64) for c in FIELDS}
                bins = unsqueeze(batch.column("elite")[i].as_py(), np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(own["length"][order])
                new = np.flatnonzero(np.diff(bins[order], prepend=-1))
                base = np.repeat(ends[new] - own["length"][order][new], np.diff(np.append(new, len(order))))
                offset = np.empty(len(order), np.int64)
                offset[order] = ends - own["length"][order] - base
                doc = pa.array(own["doc_id"], mask=own["doc_id"] == NO_ID)
                rest = [pa.array(own["piece"].astype(np.int32)), *[pa.array(own[c]) for c in ("start", "length", "ids_crc32")]]
                seq = (int(batch.column("shard")[i].as_py()) << 24 | bins) * 2
                yield pa.RecordBatch.from_arrays([pa.array(own["rid"]), doc, *rest, pa.array(seq), pa.array(offset)], names=["rid", *columns, "sequence_id", "offset"])

    packed = shards.join(best, "shard").select("shard", *FIELDS, "elite").mapInArrow(run, "rid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    out = full.unionByName(packed)
    if ids:
        out = out.join(cut.select("rid", "ids"), "rid")
    return out.drop("rid")
