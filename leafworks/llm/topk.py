"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Rows are dealt into blocks of about ``BLOCK``; each block is an index of its own: for every dimension,
postings (row, component) in segments by quantised component. For a query, segments are processed by
descending quantised impact |query component x segment value|. Accumulators hold, for each row, the score so
far and how much of the row's and of the query's squares is still unread; the product of the roots of those
two bounds what the row may yet gain or lose (Cauchy and Schwarz). The rows that lead are scored exactly, and
the k-th best of them is the bar. A search ends only on proof: rows whose bound lies below the bar are out,
and once the others are so few that scoring them exactly costs less than reading on, they are scored.
``Index.top`` tells how many postings it read.

A block's index is built once, by the task that holds the block; packs of queries are sent to all blocks and
read one after the other, and the k results of each block are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafworks.llm._base import settle, squeeze, unsqueeze, width
from leafworks.llm.vectors import finite, matrix, same_length

BLOCK, QUERIES = 8192, 256
#: Segments of a dimension: its components are quantised in steps of their standard deviation over this.
FINE = 8
#: Postings read between two looks at the bounds, as a share of all; and of the first look.
ROUND, FIRST = 0.05, 0.3
#: Rows that lead and are scored for the bar, in multiples of k.
LEADS = 4
#: The search ends when scoring the rows that are left costs this share of reading on.
WORTH = 2 / 3


class Index:
    """Rows of integers, their postings by dimension and quantised value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, d = rows.shape
        self.norms = (rows.astype(float) ** 2).sum(axis=1)
        step = max(1.0, np.floor(rows.std() / FINE)) if n else 1.0
        level = np.floor(rows / step).astype(np.int64)
        base = level.min(axis=0) if n else np.zeros(d, np.int64)
        span = int((level - base).max()) + 1 if n else 1
        key = (np.arange(d)[None, :] * span + level - base).ravel()
        order = np.argsort(key, kind="stable")
        found, starts = np.unique(key[order], return_index=True)
        self.who = (order // d).astype(np.int32)
        self.value = rows.ravel()[order].astype(float)
        self.starts, self.ends = starts, np.append(starts[1:], len(order))
        self.dim = found // span
        self.middle = (found % span + base[self.dim] + 0.5) * step

    def top(self, query: np.ndarray, k: int, banned: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row numbers, exact scores, postings read) of rows that may be among the k best; all that are, are there."""
        n, d = self.rows.shape
        everyone = np.arange(n)
        if n - (banned >= 0) <= k:
            members = everyone[everyone != banned]
            return members, self.rows[members] @ query, 0
        q = query.astype(float)
        order = np.argsort(-np.abs(q[self.dim] * self.middle), kind="stable")
        done = np.cumsum((self.ends - self.starts)[order])
        score, own, asked = np.zeros(n), self.norms.copy(), np.full(n, float(q @ q))
        at, read, bar = 0, 0, -np.inf
        tiny = 1e-9 * (1 + np.sqrt(self.norms.max() * (q @ q)))  # sums of doubles
        members, share = everyone, FIRST
        while at < len(order):
            to = min(len(order), int(np.searchsorted(done, share * done[-1])) + 1)
            some = order[at:to]
            sizes = self.ends[some] - self.starts[some]
            place = np.arange(sizes.sum()) + np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            who, value, part = self.who[place], self.value[place], np.repeat(q[self.dim[some]], sizes)
            score += np.bincount(who, part * value, n)
            own -= np.bincount(who, value * value, n)
            asked -= np.bincount(who, part * part, n)
            at, read, share = to, read + len(place), share + ROUND
            if banned >= 0:
                score[banned] = -np.inf
            lead = np.argpartition(score, n - LEADS * k)[n - LEADS * k :] if LEADS * k < n else everyone
            lead = lead[lead != banned]
            bar = max(bar, float(np.partition(self.rows[lead] @ query, len(lead) - k)[len(lead) - k]))
            upper = score + np.sqrt(np.maximum(own, 0) * np.maximum(asked, 0)) + tiny
            members = np.flatnonzero(upper >= bar)
            if len(members) * d <= WORTH * (n * d - read):
                break
        members = members[members != banned]
        return members, self.rows[members] @ query, read


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def blocked(rows: DataFrame, number: int, salt: int) -> DataFrame:
    """``rows(rid, vec_id, v)`` packed into ``number`` settled rows ``(block, ids, rids, numbers)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            block, v = batch.column("block").to_numpy(), matrix(batch.column("v")).astype(np.int64)
            for b in np.unique(block).tolist():
                mine = block == b
                held.setdefault(b, []).append((batch.column("vec_id").to_numpy()[mine], batch.column("rid").to_numpy()[mine], v[mine]))
        for b, parts in held.items():
            ids, rids, v = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(rids)
            blobs = [squeeze(ids[order]), squeeze(rids[order]), squeeze(v[order])]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["block", "ids", "rids", "numbers"])

    home = F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(number)).cast("int").alias("block")
    dealt = rows.select(home, "rid", "vec_id", "v").repartition(max(1, min(number, 8 * width(rows.sparkSession))), "block")
    return settle(dealt.mapInArrow(run, "block int, ids binary, rids binary, numbers binary"), "topk-blocks")


def quantised_top_k(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the highest inner products for every query.

    Components are floor(scale * x). Queries: rows whose vec_id is divisible by ``every``; candidates: every
    row but the query's own; ties go to the smaller vec_id. Vectors that are null or empty, or hold null or
    non-finite components, take no part, nor do rows without an id; of several lengths only the commonest
    (ties: the longest) takes part. Of rows that share an id each is a row of its own: a query row is not its
    own candidate but another row with its id is; results of queries that share an id are those of the one
    that was numbered first. A table with one row, or none, gives an empty table.
    """
    usable, length = same_length(finite(table, nonzero=False))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = settle(usable.select("vec_id", whole.alias("v")).withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    if m:
        first = asked.groupBy("vec_id").agg(F.min("rid").alias("rid"))
        asked = asked.join(first, ["vec_id", "rid"])
    blocks, packs = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    base = blocked(rows, blocks, 1).withColumn("pack", F.lit(-1))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_to")
    packed = blocked(asked, packs, 2).select(everywhere, F.col("block").alias("pack"), "ids", "rids", "numbers").withColumnRenamed("_to", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, rids = None, None, np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, own = unsqueeze(row["ids"], np.int64), unsqueeze(row["rids"], np.int64)
                numbers = unsqueeze(row["numbers"], np.int64).reshape(len(ids), -1)
                if row["pack"] < 0:  # a block comes before the queries that are put to it
                    held, index, rids = row["block"], Index(ids, numbers), own
                    continue
                if held != row["block"]:  # no row was dealt into this block
                    continue
                out: list[tuple[np.ndarray, ...]] = []
                for q, rid, vector in zip(ids, own, numbers):
                    at = int(np.searchsorted(rids, rid))
                    found, scores, _ = index.top(vector, k, at if at < len(rids) and rids[at] == rid else -1)
                    keep = best(index.ids[found], scores, k)
                    out.append((np.full(len(keep), q), index.ids[found][keep], scores[keep]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    both = base.unionByName(packed).repartition(max(1, min(blocks, 8 * width(table.sparkSession))), "block").sortWithinPartitions("block", "pack")
    found = both.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
