"""Texts linked at a Jaccard similarity of their distinct word shingles, exactly: every pair at the similarity is
found, and no pair below it is linked.

Two sets of n and m shingles with a similarity of t have t * max(n, m) shingles in common at least, so in any
one order of all shingles their first n - ceil(t n) + 1 and m - ceil(t m) + 1 have one in common (prefix
filtering). Sets meet in a bucket for each shingle of their prefixes; pairs whose sizes or places in the
prefix rule the similarity out go, and so do those whose parity sketches differ in more bits than the sets could
in shingles; all others are verified on the whole sets. Whole sets are not kept but made again from the texts
that a pair is left of. The order only moves work: shingles
that are common in a sample of texts come last. Buckets of shingles that the sample has often are split into
parts, and every pair of parts is a task of its own.

First verified are the links that the trie self-join of SimHash fingerprints finds (of the distinct shingles, so that
a repeated line has no more weight than any other), which hold most near copies together, and some neighbours of
each set in its buckets; then, in rounds, the pairs of a bucket that are not connected yet. A pair that is connected by
then needs no link of its own, so the components are those of all links. A round takes the most alike of a set's pairs
only, so that a large group of near copies is connected by a few links of each member; the next takes ``MORE`` times as
many of those that are still not connected, and the last is the one that leaves no pair out. Postings carry
a short sketch, so that pairs that are too different go inside a bucket and make no rows. No fingerprint
decides anything: it proposes, and the whole sets of shingles are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafworks.llm._base import drop, recorded, settle, slices, squeeze, text_bytes, unsqueeze, width
from leafworks.llm.components import connected
from leafworks.llm.simhash import links, majority, named_by, one_of_each, shingle_hashes

#: One text in this many is looked at for common shingles, and so many of those are told apart.
SAMPLED, COMMON = 64, 1 << 16
#: Members of a bucket, as the sample has it, beyond which it is split.
HOT = 4096
#: Neighbours of a set that are verified before all pairs, out of how many, and bits by which fingerprints may differ that are.
NEIGHBOURS, AHEAD, BUDGET = 3, 32, 4
#: Pairs of a set that are verified in the first round of those not connected, and times as many in each next one.
FIRST, MORE = 16, 16
#: Bits of the sketch that postings carry.
SHORT = 512
#: Bits of the filter of the sets to make again; with more sets it lets more of the others pass, none less.
FILTER_BITS = 1 << 24
#: Pairs that a task holds at once.
AT_ONCE = 1 << 20


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def least_common(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t n)."""
    return -(-n * t.numerator // t.denominator)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a sample of different texts has more than twice, ascending, and the number of texts that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text in text_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["h"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


def sketch(own: np.ndarray, bits: int = 0) -> bytes:
    """Parities of the numbers of shingles by their low bits; as many bits as shingles or more, a power of two, if not given."""
    bits = bits or (max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64)
    count = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def sets(docs: DataFrame, words: int, t: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(doc_id, fp, mark, size, sketch, bits, prefix)`` of every row: the hash that names its set, its SimHash, its
    sketches, the short one last, and the prefix in the common order."""
    known, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, marks, sizes, sketches, short, prefixes = [], [], [], [], [], []
            for text in text_bytes(batch.column("text")):
                own = shingle_set(text, words)
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    weight = np.where(known[at] == own, counts[at], 0)
                p = len(own) - int(least_common(len(own), t)) + 1 if len(own) else 0
                fps.append(xxhash.xxh64_intdigest(own.tobytes()))
                marks.append(majority(own[:, None])[0])
                sizes.append(len(own))
                sketches.append(sketch(own))
                short.append(sketch(own, SHORT))
                prefixes.append(own[np.lexsort((own, weight))[:p]].tobytes())
            names = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, marks)]
            arrays = [batch.column("doc_id"), *names, pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (sketches, short, prefixes))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "mark", "size", "sketch", "bits", "prefix"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp bigint, mark bigint, size int, sketch binary, bits binary, prefix binary")


def whole_sets(docs: DataFrame, words: int, fps: DataFrame) -> DataFrame:
    """``(fp, whole)``: the shingles, ascending, of each of the sets ``fps(fp)``."""
    bits = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = fps.select(bits.alias("bit")).selectExpr("shiftright(bit, 6) w", "shiftleft(1L, cast(bit & 63 as int)) v").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    asked = np.zeros(FILTER_BITS // 64, np.int64)
    asked[found.column("w").to_numpy()] = found.column("v").to_numpy()
    packed = squeeze(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = unsqueeze(packed, np.int64)
        for batch in slices(batches, "text"):
            names, wholes = [], []
            for text in text_bytes(batch.column("text")):
                whole = shingle_set(text, words).tobytes()
                name = xxhash.xxh64_intdigest(whole)
                bit = name & FILTER_BITS - 1
                if int(asked[bit >> 6]) >> (bit & 63) & 1:
                    names.append(name)
                    wholes.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(wholes, pa.binary())], names=["fp", "whole"])

    return docs.select("text").mapInArrow(run, "fp bigint, whole binary").join(fps, "fp", "left_semi").dropDuplicates(["fp"])


CELL = ["h", "i", "j"]
POSTING = "h bigint, i int, j int, side int, node bigint, size int, place int"


def postings(distinct: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each shingle of each prefix, in each pair (i, j) of parts that it belongs to."""
    known, counts = common
    parts = -(-counts * SAMPLED // HOT)
    hot, parts = known[parts > 1], parts[parts > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "prefix"):
            own = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            n = np.array([len(x) for x in own])
            h = np.concatenate(own)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(own)), n)
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            node = batch.column("fp").to_numpy()[row]
            share = np.ones(len(h), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                share = np.where(hot[at] == h, parts[at], 1)
            mixed = (node.view(np.uint64) ^ h) * np.uint64(0x9E3779B97F4A7C15)
            mine = ((mixed >> np.uint64(33)) % share.astype(np.uint64)).astype(np.int64)
            take = np.repeat(np.arange(len(h)), share)
            other = np.arange(len(take)) - np.repeat(np.cumsum(share) - share, share)
            me = mine[take]
            i, j, side = np.minimum(me, other), np.maximum(me, other), (me > other)
            columns = [h[take].view(np.int64), i.astype(np.int32), j.astype(np.int32), side.astype(np.int32), node[take]]
            columns += [batch.column("size").to_numpy()[row][take].astype(np.int32), place[take].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "i", "j", "side", "node", "size", "place"])

    return distinct.select("fp", "size", "prefix").mapInArrow(run, POSTING)


def _cells(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:
    """The rows of a task by cell, side and size, and where each cell starts and ends."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return None
    found = pa.Table.from_batches(rows)
    x = {c: found.column(c).to_numpy() for c in found.column_names if c != "bits"}
    if "bits" in found.column_names:
        x["bits"] = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint64).reshape(-1, SHORT // 64)
    order = np.lexsort((x["node"], x["size"], x["side"], x["j"], x["i"], x["h"]))
    x = {c: v[order] for c, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(x["h"]) != 0) | (np.diff(x["i"]) != 0) | (np.diff(x["j"]) != 0)
    starts = np.flatnonzero(new)
    return x, starts, np.append(starts[1:], len(order))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of cells that have more than one."""
    if (found := _cells(batches)) is not None:
        x, starts, ends = found
        keep = np.repeat(ends - starts > 1, ends - starts)
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in x.values()], names=list(x))


def possible(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sizes and places allow for rows ``a`` and ``b`` of one bucket, of different sets, to be similar."""
    n, m = x["size"][a].astype(np.int64), x["size"][b].astype(np.int64)
    need = -(-t.numerator * (n + m) // (t.numerator + t.denominator))
    # a first shingle in common cannot lie further on; at a later one, the bucket of the first has the pair
    most = np.minimum(n - x["place"][a], m - x["place"][b])
    return (x["node"][a] != x["node"][b]) & (np.minimum(n, m) >= least_common(np.maximum(n, m), t)) & (most >= need)


def apart(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the short sketches of rows ``a`` and ``b``: at most as many as shingles that only one has."""
    return np.bitwise_count(x["bits"][a] ^ x["bits"][b]).sum(axis=1, dtype=np.int64)


def alike(differ: np.ndarray, sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of so many shingles, both together, may be similar if at least ``differ`` are in one only."""
    return differ * (t.numerator + t.denominator) <= sizes * (t.denominator - t.numerator)


def _near(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of rows (a, b), those that may be similar, and by how many bits they differ."""
    fine = possible(x, a, b, t)
    a, b = a[fine], b[fine]
    differ = apart(x, a, b)
    fine = alike(differ, x["size"][a].astype(np.int64) + x["size"][b], t)
    return a[fine], b[fine], differ[fine]


def _pairs(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        lo, hi = np.minimum(x["node"][a], x["node"][b]), np.maximum(x["node"][a], x["node"][b])
        order = np.lexsort((~more, hi, lo))
        lo, hi, more = lo[order], hi[order], more[order]
        new = np.append(True, (np.diff(lo) != 0) | (np.diff(hi) != 0))
        yield pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new]), pa.array(more[new])], names=["a", "b", "more"])


def marked(prints: DataFrame, budget: int) -> DataFrame:
    """``(a, b)``: sets whose fingerprints the trie self-join links, each with the first set of its own fingerprint or
    that of the fingerprint it is linked with."""
    sets_ = prints.select("fp", "mark").distinct()
    first = settle(sets_.groupBy("mark").agg(F.min("fp").alias("first")), "shingle-marks")
    same = sets_.join(first, "mark").filter("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    found = links(first.select(F.col("mark").alias("fp")), budget)
    one = found.join(first.select(F.col("mark").alias("a"), F.col("first").alias("p")), "a")
    two = one.join(first.select(F.col("mark").alias("b"), F.col("first").alias("q")), "b")
    return same.unionByName(two.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def paired(live: DataFrame, t: Fraction) -> DataFrame:
    """The postings, with the short sketches, that may be similar to another one of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _cells(batches)) is None:
            return
        x, starts, ends = found
        end = np.repeat(ends, ends - starts)
        has, here, step = np.zeros(len(end), bool), np.arange(len(end)), 1
        while len(here := here[here + step < end[here]]):
            a = here[~(has[here] & has[here + step])]
            a, b, _ = _near(x, a, a + step, t)
            has[a] = has[b] = True
            step += 1
        bits = pa.array([row.tobytes() for row in x.pop("bits")[has]], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(v[has]) for v in x.values()), bits], names=[*x, "bits"])

    return live.select(*(c.split()[0] for c in POSTING.split(", ")), "bits").repartition(8 * width(live.sparkSession), *CELL).mapInArrow(run, POSTING + ", bits binary")


def neighbours(live: DataFrame, t: Fraction) -> DataFrame:
    """``(a, b)``: for each set in a cell the most alike of those that follow by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _cells(batches)) is None:
            return
        x, starts, ends = found
        end = np.repeat(ends, ends - starts)
        here, near = np.arange(len(end)), []
        for step in range(1, AHEAD + 1):
            here = here[here + step < end[here]]
            near.append(_near(x, here, here + step, t))
        a, b, differ = map(np.concatenate, zip(*near))
        order = np.lexsort((differ, a))
        a, b = a[order], b[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < NEIGHBOURS
        yield from _pairs(x, a[few], b[few], np.zeros(few.sum(), bool))

    return live.repartition(8 * width(live.sparkSession), *CELL).mapInArrow(run, "a bigint, b bigint, more boolean").select("a", "b")


def unconnected(live: DataFrame, t: Fraction, most: int) -> DataFrame:
    """``(a, b, more)``: pairs of a cell that may be similar and whose ``root`` differs, for each row up to ``most`` with
    later ones, the most alike; more: the row has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _cells(batches)) is None:
            return
        x, starts, ends = found
        mixed = np.minimum.reduceat(x["root"], starts) != np.maximum.reduceat(x["root"], starts)
        kept, held = [], 0
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            m = s + int(np.searchsorted(x["side"][s:e], 1)) if x["i"][s] != x["j"][s] else e
            for at in range(s, m):
                b = np.arange(at + 1, e) if m == e and x["i"][s] == x["j"][s] else np.arange(m, e)
                b = b[x["root"][b] != x["root"][at]]
                a, b, differ = _near(x, np.full(len(b), at), b, t)
                if more := len(b) > most:
                    b = b[np.argsort(differ, kind="stable")[:most]]
                kept.append((a[: len(b)], b, np.full(len(b), more)))
                held += len(b)
                if held > AT_ONCE:
                    yield from _pairs(x, *map(np.concatenate, zip(*kept)))
                    kept, held = [], 0
        if held:
            yield from _pairs(x, *map(np.concatenate, zip(*kept)))

    return live.repartition(8 * width(live.sparkSession), *CELL).mapInArrow(run, "a bigint, b bigint, more boolean")


def sketched(pairs: DataFrame, distinct: DataFrame, t: Fraction) -> DataFrame:
    """The ``pairs(a, b)``, each once, whose sketches allow for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            sizes = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            for k, (p, q) in enumerate(zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())):
                p, q = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
                q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) if len(p) < len(q) else q
                differ = int(np.bitwise_count(p ^ q).sum())
                fine[k] = alike(differ, int(sizes[k]), t)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    pairs = pairs.distinct()
    one = pairs.join(distinct.select(F.col("fp").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("p")), "a")
    two = one.join(distinct.select(F.col("fp").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("q")), "b")
    return settle(two.select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a bigint, b bigint"), "shingle-pairs")


def verified(pairs: DataFrame, docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The ``pairs(a, b)`` of sets whose similarity is ``t`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(batch.column("p"), batch.column("q"))):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                fine[k] = same * t.denominator >= t.numerator * (len(both) - same)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    used = settle(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "shingle-used")
    with recorded() as held_at:
        held = settle(whole_sets(docs, words, used), "shingle-held")
    one = pairs.join(held.select(F.col("fp").alias("a"), F.col("whole").alias("p")), "a")
    two = one.join(held.select(F.col("fp").alias("b"), F.col("whole").alias("q")), "b")
    links = settle(two.select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint"), "shingle-links")
    drop(docs.sparkSession, held_at)
    return links


def similar_sets(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row and ``(v, root)`` of every ``fp`` with a link; equal sets have one ``fp``."""
    t = Fraction(str(similarity))
    common = common_shingles(docs, words)
    prints = settle(sets(docs, words, t, common), "shingle-sets")
    distinct = prints.select("fp", "size", "prefix").dropDuplicates(["fp"])
    live = settle(postings(distinct, common).repartition(8 * width(docs.sparkSession), *CELL).mapInArrow(shared, POSTING), "shingle-live")
    own = prints.select("fp", "size", "sketch", "bits").join(live.select(F.col("node").alias("fp")).distinct(), "fp", "left_semi")
    sketches = settle(own.dropDuplicates(["fp"]), "shingle-sketches")
    live = settle(paired(live.join(sketches.select(F.col("fp").alias("node"), "bits"), "node"), t), "shingle-paired")
    by_chance = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a")
    some = lambda pairs: sketched(pairs, sketches, t).withColumn("k", F.row_number().over(by_chance))
    few = some(neighbours(live, t)).filter(F.col("k") <= NEIGHBOURS).drop("k")
    few = few.unionByName(sketched(marked(prints, BUDGET), sketches, t)).distinct()
    near = verified(settle(few, "shingle-few"), docs, words, t)
    roots, most, more = connected(near), FIRST, True
    while more:
        rooted = live.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        asked = settle(unconnected(rooted, t, most), "shingle-asked")
        ranked = settle(some(asked.select("a", "b")), "shingle-ranked")
        more = not (asked.filter("more").isEmpty() and ranked.filter(F.col("k") > most).isEmpty())
        near = near.unionByName(verified(ranked.filter(F.col("k") <= most).drop("k"), docs, words, t))
        roots, most = connected(near), most * MORE
    return prints.select("doc_id", "fp"), roots


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``simhash.near_duplicates``, but rows are linked if the Jaccard similarity of their distinct word shingles is
    ``similarity`` or more, exactly; fp names the set of shingles."""
    prints, roots = similar_sets(docs, words, similarity)
    return named_by(prints, prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), roots)


def one_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each component of ``similar``: the one with the smallest id, nulls last. Rows
    are told apart by id and text, so rows without an id, or with one id and different texts, count each for itself."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    own = docs.withColumn("doc_id", key)
    kept = one_of_each(own, similar(own, words, similarity))
    return kept.withColumn("doc_id", F.col("doc_id.id")).select(*docs.columns)
