"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Distinct fingerprints are routed to tasks by blocks of bits. A fingerprint of 64 bits with a budget of b
differing bits has b + 1 blocks, and two that are linked agree in one block at least, so each link is found in
some (block, value) bucket. Inside a task the fingerprints of a bucket, sorted, are a binary trie whose nodes
are ranges of the sorted array; node pairs are traversed together, differing bits are added up, and a
pair is dropped as soon as the sum exceeds the budget, or if all its members are connected already. Small
node pairs are compared at once.
A bucket with more than ``HOT`` members is split into parts, and every pair of parts is a task of its
own, so nothing is lost or gathered in one place. Tasks don't give out links but, for each fingerprint,
the smallest one that it is connected with inside the task; ``connected`` joins those up.

Few differing bits of 64 mean nearly equal texts. For all links at a similarity of word shingles see ``shingles``,
which takes these links first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import CHUNK_BYTES, settle, slices, text_bytes, width
from leafworks.llm.components import connected

#: Members of a bucket beyond which it is split.
HOT = 8192
#: Comparisons that a task makes at once.
AT_ONCE = 1 << 21


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the ``words``-word shingles of ``text``, A-Z lower-cased, repeats included."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if n <= words:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> np.ndarray:
    """One row of words whose bits are set in over half the rows of ``hashes`` (uint64); no rows: zeros."""
    n, wide = hashes.shape
    ones = np.zeros(64 * wide, np.int64)
    for at in range(0, n, 255 << 6):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + (255 << 6)], "<u8").view(np.uint8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        # sums of up to 255 rows fit in a byte
        ones += bits[:full].reshape(-1, 255, 64 * wide).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of 64 bits of the shingles of ``text``; no words: 0."""
    return int(majority(shingle_hashes(text, words, seed)[:, None])[0])


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs(doc_id, text)``; fp: a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * CHUNK_BYTES):
            texts = text_bytes(batch.column("text"))
            fps = pa.array(np.fromiter((fingerprint(x, words) for x in texts), np.uint64, len(texts)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp bigint")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, bits) of budget + 1 blocks of a 64-bit word."""
    ends = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _near(keys: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of columns (a, b) of ``keys``, those with up to ``budget`` differing bits."""
    spent = np.zeros(len(a), np.int64)
    for word in keys:
        spent = spent + np.bitwise_count(word[a] ^ word[b])
        fine = spent <= budget
        a, b, spent = a[fine], b[fine], spent[fine]
    return a, b


def trie_links(keys: np.ndarray, pairs: np.ndarray, budget: int) -> np.ndarray:
    """Labels that connect members of ``keys`` with up to ``budget`` differing bits.

    ``keys``: members by column, the word (uint64) of the leading bits in the first row.
    ``pairs``: rows (from, to, from, to) of ranges to compare; each range is sorted, and a row holds the
    same range twice or two ranges apart. A label is the index of a member, its own if it has no links.
    """
    n = keys.shape[1]
    label = np.arange(n)
    own = pairs[pairs[:, 0] == pairs[:, 2]]
    inside = np.zeros(n + 1, np.int64)  # neighbours first: large groups of near copies are then mostly connected
    np.add.at(inside, own[:, 0], 1)
    np.add.at(inside, np.maximum(own[:, 1] - 1, own[:, 0]), -1)
    next_to = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    label = _merge(label, *_near(keys, next_to, next_to + 1, budget))
    stack = [(pairs.astype(np.int64), np.zeros(len(pairs), np.int64), 64 * len(keys) - 1)]
    while stack:
        node, spent, bit = stack.pop()
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        done = (changes[node[:, 1] - 1] == changes[node[:, 0]]) & (changes[node[:, 3] - 1] == changes[node[:, 2]]) & (label[node[:, 0]] == label[node[:, 2]])
        node, spent = node[~done], spent[~done]
        na, nb = node[:, 1] - node[:, 0], node[:, 3] - node[:, 2]
        small = (na * nb <= 1024) | (bit < 0)
        if small.any():
            todo, work = node[small], (na * nb)[small]
            cut = np.searchsorted(np.cumsum(work), np.arange(AT_ONCE, work.sum() + AT_ONCE, AT_ONCE), side="left")
            for lo, hi in zip([0, *cut[:-1] + 1], [*cut + 1]):
                part, n = todo[lo:hi], work[lo:hi]
                if not len(part):
                    continue
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(part[:, 3] - part[:, 2], n)
                a, b = np.repeat(part[:, 0], n) + at // wide, np.repeat(part[:, 2], n) + at % wide
                label = _merge(label, *_near(keys, a, b, budget))
        node, spent = node[~small], spent[~small]
        if not len(node):
            continue
        if len(node) > 1 << 16:  # go deep before going wide
            for at in range(0, len(node), 1 << 16):
                stack.append((node[at : at + (1 << 16)], spent[at : at + (1 << 16)], bit))
            continue
        word = keys[len(keys) - 1 - bit // 64]
        ones = np.concatenate(([0], np.cumsum((word >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)))
        mid = lambda lo, hi: hi - (ones[hi] - ones[lo])
        a0, a1, b0, b1 = node.T
        am, bm = mid(a0, a1), mid(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1)]
        kids.append(tuple(x[~same] for x in (am, a1, b0, bm, spent + 1)))
        joined = np.concatenate([np.stack(x, axis=1) for x in kids])
        joined = joined[(joined[:, 0] < joined[:, 1]) & (joined[:, 2] < joined[:, 3]) & (joined[:, 4] <= budget)]
        if len(joined):
            stack.append((joined[:, :4], joined[:, 4], bit - 1))
    return label


def _by_block(fps: DataFrame, budget: int) -> DataFrame:
    """A row ``(fp, k, v)`` for each block of each fingerprint: the block's number and value."""
    value = lambda shift, bits: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
    own = F.array(*[F.struct(F.lit(k).alias("k"), value(*x).alias("v")) for k, x in enumerate(blocks(budget))])
    return fps.select("fp", F.explode(own).alias("x")).select("fp", "x.*")


def links(fps: DataFrame, budget: int) -> DataFrame:
    """``(a, b)``: edges that connect distinct fingerprints ``fps(fp)`` exactly as the links found in their blocks do."""
    spread = _by_block(fps, budget)
    hot = spread.groupBy("k", "v").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("k", "v", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = settle(hot, "simhash-hot")
    columns = [*spread.columns[:-2], "k", "v"]
    if hot.isEmpty():
        dealt = spread.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int")
        cell = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"), F.when(F.col("own") > o, 1).otherwise(0).alias("side")),
        )
        split = spread.join(hot, ["k", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
        dealt = split.select(*columns, F.explode(cell).alias("c")).select(*columns, "c.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        node = rows.column("fp").to_numpy()
        words = node.view(np.uint64)[None, :]
        k, v, i, j, side = (rows.column(c).to_numpy() for c in ("k", "v", "i", "j", "side"))
        order = np.lexsort((*words[::-1], side, j, i, v, k))
        node, k, v, i, j, side = (x[order] for x in (node, k, v, i, j, side))
        words = np.ascontiguousarray(words[:, order])
        new = np.ones(len(node), bool)
        new[1:] = (np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(node))
        cells = np.stack([starts, ends, starts, ends], axis=1)
        for c in np.flatnonzero(i[starts] != j[starts]):
            m = starts[c] + np.searchsorted(side[starts[c] : ends[c]], 1)
            cells[c] = starts[c], m, m, ends[c]
        cells = cells[(cells[:, 0] < cells[:, 1]) & (cells[:, 2] < cells[:, 3]) & (cells[:, 3] - cells[:, 0] > 1)]
        label = trie_links(words, cells, budget)
        out = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[label[out]]), pa.array(node[out])], names=["a", "b"])

    return dealt.repartition(2 * width(fps.sparkSession), "k", "v", "i", "j").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, budget: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in ``budget`` bits of 64 or fewer are linked; component_id is the smallest
    doc_id reachable over links, itself included. Null and blank texts have fingerprint 0 and are linked
    like any other; null ids are passed over by the minimum (a component of null ids alone has null);
    repeated rows share a fingerprint and so a component; an empty table gives an empty table.
    """
    prints = settle(fingerprints(docs, words), "simhash-prints")
    return components_of(prints, budget)


def components_of(prints: DataFrame, budget: int) -> DataFrame:
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "simhash-distinct")
    return named_by(prints, distinct, connected(links(distinct.select("fp"), budget)))


def named_by(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """``prints(doc_id, fp)`` and the smallest doc_id of the component that ``roots(v, root)`` has for each fp."""
    rooted = settle(
        distinct.alias("d").join(roots.alias("r"), F.col("d.node") == F.col("r.v"), "left").select("d.fp", "d.least", F.coalesce("r.root", "d.node").alias("root")), "simhash-rooted"
    )
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    names = settle(rooted.join(least, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with one row left of each component of ``named(doc_id, component_id)``: the one with the smallest
    id. Of rows that share an id one stays; rows without an id count as one document for each component of theirs."""
    named = settle(named, "simhash-named")
    kept = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = settle(kept, "simhash-kept")
    again = kept.filter("_rows > 1")
    # texts move here whatever the size of the table of ids, so that the plan is the same for all inputs
    joined = docs.alias("d").join(kept.hint("merge").alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))).select("d.*", "_rows")
    if again.isEmpty():
        return joined.drop("_rows")
    return joined.filter("_rows = 1").drop("_rows").unionByName(joined.filter("_rows > 1").drop("_rows").dropDuplicates(["doc_id"]))
