"""Approximate nearest neighbours by cosine: probed lists scanned with adaptive dimensions.

Unit vectors are turned by a random rotation, so that any leading dimensions are a fair sample of all, and
put into inverted lists, which are cells of two levels: a centroid, and one of ``residuals`` centroids of what
is left. Both are fitted to at most ``SAMPLE`` vectors; every vector is indexed. There are about as many cells
as give ``PER_LIST`` vectors to each, up to MOST_LISTS x MOST_RESIDUALS.
A query probes the cells whose centres are nearest. How many is measured, not set: the neighbours of ``CHECKS``
queries are found by brute force among all rows (one pass), and the number of cells is the smallest that holds
``AIM`` of them. So it follows from the data: few cells where there are clusters, a large share where
vectors are spread evenly over many dimensions, and a share that falls as the table grows.
A list is stored in column blocks of ``COLUMNS`` dimensions: after each block, the hypothesis that a
candidate is nearer than the k-th best so far is tested on the partial distance, and rejected candidates are
abandoned; ``STRICT`` is the number of standard deviations that the test allows. What is left has its cosine
computed on the original vectors, in doubles.
A cell with more than ``GROUP`` vectors is split into parts, and cells and parts are dealt into groups of
about ``GROUP`` vectors; a query goes once to each group, with the cells that it probes there, and the k
best of each group are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafworks.llm._base import settle, width
from leafworks.llm.vectors import finite, matrix, same_length

SAMPLE, MOST_LISTS, MOST_RESIDUALS, PER_LIST, GROUP = 20_000, 4096, 256, 16, 8192
CHECKS, AIM, LEAST_PROBES = 64, 0.95, 8
COLUMNS, STRICT, LEADS = 16, 2.5, 64
#: Rows that are compared with centroids at once.
AT_ONCE = 1024


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # squares may overflow or vanish else
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to each point."""
    half = (centres * centres).sum(axis=1) / 2
    parts = [np.argmax(points[at : at + AT_ONCE] @ centres.T - half, axis=1) for at in range(0, len(points), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 8, unit_length: bool = True) -> np.ndarray:
    """Centroids, on the unit sphere or free; an empty cell keeps its place."""
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = closest(points, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, points[:, j], k) for j in range(points.shape[1])], axis=1)
        size = np.sqrt((sums * sums).sum(axis=1)) if unit_length else count
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


class Cells:
    """Lists of two levels: cell c * residuals + r has its centre at ``first[c] + second[r]``."""

    def __init__(self, points: np.ndarray, n: int, seed: int, per_list: int = PER_LIST):
        lists = max(1, min(MOST_LISTS, n // per_list, len(points)))
        self.first = k_means(points, lists, seed) if len(points) else np.zeros((1, points.shape[1]))
        # a power of two, so that a cell keeps its place while a table grows a little
        many = min(MOST_RESIDUALS, len(points), n // (per_list * lists)) if lists == MOST_LISTS else 1
        self.residuals = 1 << max(0, many.bit_length() - 1) if many else 1
        self.second = np.zeros((1, points.shape[1]))
        if self.residuals > 1:
            self.second = k_means(points - self.first[closest(points, self.first)], self.residuals, seed + 1, unit_length=False)
        self.number = len(self.first) * self.residuals
        # half the squared lengths of the centres
        self.half = ((self.first**2).sum(axis=1)[:, None] / 2 + self.first @ self.second.T + (self.second**2).sum(axis=1)[None, :] / 2).ravel()

    def of(self, points: np.ndarray) -> np.ndarray:
        own = closest(points, self.first)
        return own * self.residuals + (closest(points - self.first[own], self.second) if self.residuals > 1 else 0)

    def nearness(self, point: np.ndarray) -> np.ndarray:
        """Of all cells to a point; larger is nearer."""
        return (self.first @ point)[:, None].repeat(self.residuals, axis=1).ravel() + np.tile(self.second @ point, len(self.first)) - self.half

    def nearest(self, point: np.ndarray, count: int) -> np.ndarray:
        if count >= self.number:
            return np.arange(self.number)
        return np.argpartition(-self.nearness(point), count - 1)[:count]

    def rank(self, point: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer than each of ``cells``."""
        near = self.nearness(point)
        return (near[None, :] > near[cells][:, None]).sum(axis=1)


def scan(blocks: list[np.ndarray], query: np.ndarray, alive: np.ndarray, k: int, strict: float = STRICT) -> np.ndarray:
    """Of the row numbers ``alive``, those that may be among the ``k`` nearest to ``query`` (rotated unit vectors)."""
    if len(alive) <= k:
        return alive
    d = len(query)
    cuts = list(range(0, d, COLUMNS)) + [d]
    part = lambda b, who: ((blocks[b][who] - query[cuts[b] : cuts[b + 1]]) ** 2).sum(axis=1)
    partial = part(0, alive)
    # the first bar: the k-th best of the candidates that lead after the first block
    lead = np.argpartition(partial, min(LEADS, len(alive)) - 1)[: max(k, LEADS)]
    whole = partial[lead] + sum(part(b, alive[lead]) for b in range(1, len(blocks)))
    bar = np.partition(whole, k - 1)[k - 1]
    for b in range(1, len(blocks) + 1):
        seen = cuts[b]
        # a partial distance times d / seen estimates the whole; its relative deviation is about this
        deviation = np.sqrt(2 / seen * (1 - seen / d))
        keep = partial * (d / seen) <= bar * (1 + strict * deviation) * (1 + 1e-9) + 1e-12
        alive, partial = alive[keep], partial[keep]
        if b < len(blocks):
            partial = partial + part(b, alive)
    return alive


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, each row's sums in the same order."""
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def probe_count(listed: DataFrame, asked: DataFrame, k: int, cells: Cells, turn: np.ndarray, aim: float, seed: int) -> int:
    """The number of cells to probe that finds ``aim`` of the neighbours of CHECKS queries."""
    chosen = [r.rid for r in asked.select("rid").orderBy(F.xxhash64(F.lit(seed + 7), "rid")).limit(CHECKS).collect()]
    held = asked.filter(F.col("rid").isin(chosen)).select("rid", "v").toArrow()
    if not held.num_rows:
        return LEAST_PROBES
    rids, queries = held.column("rid").to_numpy(), unit(matrix(held.column("v").combine_chunks()))
    shared = listed.sparkSession.sparkContext.broadcast((rids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, queries = shared.value
        best = np.zeros((0, 4))
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                rid, cell = some.column("rid").to_numpy(), some.column("list").to_numpy()
                score = unit(matrix(some.column("v"))) @ queries.T
                score[rid[:, None] == rids[None, :]] = -9
                top = np.argpartition(-score, min(k, len(rid)) - 1, axis=0)[: min(k, len(rid))]
                q = np.tile(np.arange(len(rids)), len(top))
                rows = np.stack([q, score[top.ravel(), q], cell[top.ravel()], rid[top.ravel()]], axis=1)
                best = np.concatenate([best, rows[rows[:, 1] > -9]])
                order = np.lexsort((best[:, 3], -best[:, 1], best[:, 0]))
                best = best[order]
                first = np.flatnonzero(np.diff(best[:, 0], prepend=-1))
                best = best[np.arange(len(best)) - np.repeat(first, np.diff(np.append(first, len(best)))) < k]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), pa.array(best[:, 1]), pa.array(best[:, 2].astype(np.int32))], names=["q", "score", "cell"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    found = listed.select("list", "rid", "v").mapInArrow(run, "q int, score double, cell int").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).select("q", "cell").toArrow()
    q, cell = found.column("q").to_numpy(), found.column("cell").to_numpy()
    if not len(q):
        return LEAST_PROBES
    turned = queries @ turn
    ranks = np.sort(np.concatenate([cells.rank(turned[i], cell[q == i]) for i in np.unique(q)]))
    return max(LEAST_PROBES, int(ranks[min(len(ranks) - 1, int(np.ceil(aim * len(ranks))))]) + 1)


def nearest(table: DataFrame, every: int = 50, k: int = 5, probes: float | None = None, seed: int = 1, aim: float = AIM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: about the ``k`` nearest rows to every query, by cosine.

    Queries: rows whose vec_id is divisible by ``every``; candidates: every row but the query's own; ties go
    to the smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do rows without an id; of several lengths only the commonest takes part. Of rows that share an
    id each is a row of its own; queries that share an id give the results of the one numbered first.
    ``probes``: share of the cells that a query probes (at least LEAST_PROBES cells); measured by default.
    """
    usable, d = same_length(finite(table, nonzero=True))
    rows = settle(usable.withColumn("rid", F.monotonically_increasing_id()), "ann-rows")
    n = rows.count()
    spark = table.sparkSession
    # hashes alone are ordered, and the vectors of the sample fetched by what they must stay below
    by_hash = F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1 << 40))
    some = rows.filter(by_hash < F.lit(int((1 << 40) * min(1.0, 0.9 * SAMPLE / n)))) if n > SAMPLE else rows
    sample = some.select("rid", "v").limit(SAMPLE).toArrow().sort_by("rid") if n else None
    turn = rotation(d, seed) if d else np.zeros((0, 0))
    points = unit(matrix(sample.column("v").combine_chunks())) @ turn if n else np.zeros((0, 0))
    cells = Cells(points, n, seed)
    shared = spark.sparkContext.broadcast((turn, cells))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, cells = shared.value
        for batch in batches:
            own = cells.of(unit(matrix(batch.column("v"))) @ turn) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *[batch.column(c) for c in ("rid", "vec_id", "v")]], names=["list", "rid", "vec_id", "v"])

    listed = settle(rows.mapInArrow(index, "list int, rid bigint, vec_id bigint, v array<double>"), "ann-index")
    parts = np.ones(cells.number, np.int64)
    sizes = listed.groupBy("list").count().toArrow()  # a row for each cell, of which there are a bounded number
    parts[sizes.column("list").to_numpy()] = -(-sizes.column("count").to_numpy() // GROUP)
    offset = np.cumsum(parts) - parts
    groups = max(1, -(-n // GROUP))
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = asked.join(asked.groupBy("vec_id").agg(F.min("rid").alias("rid")), ["vec_id", "rid"]).select("rid", "vec_id", "v")
    count = max(LEAST_PROBES, round(probes * cells.number)) if probes is not None else probe_count(listed, asked, k, cells, turn, aim, seed)
    count = min(cells.number, count)
    dealt = spark.sparkContext.broadcast((offset, parts))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, parts = dealt.value
        for batch in batches:
            own, rid = batch.column("list").to_numpy(), batch.column("rid").to_numpy()
            cell = offset[own] + (rid * 0x9E3779B1 >> 7) % parts[own]
            empty = pa.array([None] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array((cell % groups).astype(np.int32)), pa.array(cell), empty, *[batch.column(c) for c in ("rid", "vec_id", "v")]], names=names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (turn, cells), (offset, parts) = shared.value, dealt.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, to, wanted = [], [], []
            for i, point in enumerate(unit(matrix(batch.column("v"))) @ turn):
                own = cells.nearest(point, count)
                size = parts[own]
                all_ = np.arange(size.sum()) + np.repeat(offset[own] - (np.cumsum(size) - size), size)
                order = np.argsort(all_ % groups, kind="stable")
                met, first = np.unique((all_ % groups)[order], return_index=True)
                at += [i] * len(met)
                to += met.tolist()
                wanted += np.split(all_[order], first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(to, np.int32)), pa.array([None] * len(at), pa.int64()), pa.array(wanted, pa.list_(pa.int64())), *[batch.column(c).take(pa.array(at)) for c in ("rid", "vec_id", "v")]], names=names
            )

    names = ["g", "cell", "cells", "rid", "vec_id", "v"]
    schema = "g int, cell bigint, cells array<bigint>, rid bigint, vec_id bigint, v array<double>"
    both = listed.mapInArrow(home, schema).unionByName(asked.mapInArrow(probe, schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group, rid, ids = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("g", "rid", "vec_id"))
        cell = np.concatenate([b.column("cell").fill_null(-1).to_numpy() for b in held])
        cells = [x for b in held for x in b.column("cells").to_pylist()]
        v = np.concatenate([matrix(b.column("v")) for b in held])
        turned = unit(v) @ turn
        for g in np.unique(group):
            base = np.flatnonzero((group == g) & (cell >= 0))
            base = base[np.lexsort((rid[base], cell[base]))]
            own, blocks = cell[base], [np.ascontiguousarray(turned[base, a : a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]
            out = []
            for q in np.flatnonzero((group == g) & (cell < 0)):
                want = np.array(cells[q])
                lo, size = np.searchsorted(own, want), np.searchsorted(own, want, side="right")
                size -= lo
                who = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
                found = base[scan(blocks, turned[q], who[rid[base[who]] != rid[q]], k)]
                score = cosines(v[found], v[q])
                top = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(top), ids[q]), ids[found][top], score[top]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    found = both.repartition(max(width(spark), min(groups, 8 * width(spark))), "g").mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
