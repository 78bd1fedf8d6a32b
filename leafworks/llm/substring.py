"""Removal of repeated passages, by anchors at difference-cover positions.

A window of ``window`` words is repeated if its word sequence starts earlier too. In place of hashing
every window, only the ``ANCHOR`` words at positions p with p mod ``PERIOD`` in ``COVER`` are hashed. COVER
is a difference cover: for any two starts i, j there is a shift d < PERIOD that brings both i + d and j + d
to cover positions, so two equal windows of ANCHOR + PERIOD - 1 words or more share an aligned anchor.

1. Texts are written once as compressed chunks; every later step deals with chunks.
2. Anchors, first combined in the chunk, are dealt out by hash; those that occur again go back.
3. Windows around such anchors (the matches extended to the full length) are hashed whole with 96 bits,
   combined in the chunk and dealt out by hash; all but the earliest of each go back as repeated.
4. The words under repeated windows go.

A passage in every document costs one row for each chunk, never one group of all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafworks.llm._base import deltas, from_low_bytes, low_bytes, pack_texts, settle, slices, squeeze, text_bytes, undeltas, unpack_texts, unsqueeze, width

PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8
#: Bytes of an anchor's hash beside its bucket (a clash costs a comparison), and of a window's second hash.
NEAR, EXACT = 6, 4
#: Chunks (of about 2 MB of text each) whose share a bucket holds.
PER_BUCKET = 16
#: A row without an id comes after all others.
NO_ID = np.iinfo(np.int64).max


class _Words(dict):
    """Word to 64-bit hash; kept small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` of the hashed ``words``, by doubling; by start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, level, size = None, 0, words, 1
    while length:
        if length & 1:
            piece = level[done : done + n]
            out = piece if out is None else _join(out, piece, salt)
            done += size
        length >>= 1
        if length:
            level = _join(level[:-size], level[size:], salt)
            size *= 2
    return out


def _layout(texts: list[bytes], cache: dict) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the hashes of all words on end, and where each text ends among them."""
    words = [x.split() for x in texts]
    ends = np.cumsum([len(x) for x in words], dtype=np.int64)
    hashes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = 0
    for x in words:
        hashes[at : at + len(x)] = np.fromiter(map(cache.__getitem__, x), np.uint64, len(x))
        at += len(x)
    return words, hashes, ends


def _places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in its text, and words from it to the text's end, of each word."""
    n = np.diff(ends, prepend=0)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return place, np.repeat(n, n) - place


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: whether each row begins a group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return new


def chunked(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs(doc_id, text, *carry)`` as settled chunks, each with the values of its rows; ``carry``: strings."""
    names = ["chunk", "ids", "texts", *[f"carry{i}" for i in range(len(carry))]]
    schema = "chunk bigint, " + ", ".join(f"{x} binary" for x in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text")):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            packed = [pack_texts(text_bytes(batch.column("text")))]
            for c in carry:  # a byte before each value tells nulls from empty strings
                packed.append(pack_texts([b"" if x is None else b"=" + x.encode() for x in batch.column(c).to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), *[pa.array([x], pa.binary()) for x in (squeeze(ids), *packed)]], names=names)

    return settle(docs.select("doc_id", "text", *carry).mapInArrow(run, schema), "passage-chunks")


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in _each(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def bucket_count(chunks: DataFrame) -> int:
    """Buckets by the input's size, each with what about PER_BUCKET chunks have, so that a task holds a fixed amount."""
    return max(4 * width(chunks.sparkSession), chunks.count() // PER_BUCKET)


def anchors_again(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """``(chunk, at)``: places (in the chunk) of anchors that occur more than once, as packed arrays."""
    names, kinds = ["bucket", "chunk", "once", "at", "often", "known"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for row in _each(batches):
            _, hashes, ends = _layout(unpack_texts(row["texts"]), cache)
            place, left = _places(ends)
            h = window_hashes(hashes, ANCHOR)
            place, left = place[: len(h)], left[: len(h)]
            at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= ANCHOR) & (place + left >= window))
            h = h[at]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = _runs(h)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h)))
            often = h[first[count > 1]]
            known = np.sort(at[np.repeat(count > 1, count)])
            h, at = h[first[count == 1]], at[first[count == 1]]
            order = np.argsort(at)
            h, at = h[order], at[order]
            b, b2 = (h % np.uint64(buckets)).astype(np.int64), (often % np.uint64(buckets)).astype(np.int64)
            order, order2 = np.argsort(b, kind="stable"), np.argsort(b2, kind="stable")
            cut, cut2 = np.searchsorted(b[order], np.arange(buckets + 1)), np.searchsorted(b2[order2], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                x, y = order[cut[k] : cut[k + 1]], order2[cut2[k] : cut2[k + 1]]
                if len(x) or len(y):
                    rows.append((k, row["chunk"], low_bytes(h[x], NEAR), deltas(at[x]), low_bytes(often[y], NEAR), None))
            if len(known):
                rows.append((row["chunk"] % buckets, row["chunk"], None, None, None, deltas(known)))
            yield _rows(names, kinds, rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            out = [(r["chunk"], r["known"]) for r in held if r["known"] is not None]
            held = [r for r in held if r["known"] is None]
            once = [from_low_bytes(r["once"], NEAR) for r in held]
            h = np.concatenate([*once, *(from_low_bytes(r["often"], NEAR) for r in held), np.zeros(0, np.uint64)])
            order = np.argsort(h, kind="stable")
            new = _runs(h[order])
            count = np.diff(np.append(np.flatnonzero(new), len(h)))
            again = np.zeros(len(h), bool)
            again[order] = np.repeat(count > 1, count)
            at = 0
            for r, x in zip(held, once):
                hit = again[at : at + len(x)]
                at += len(x)
                if hit.any():
                    out.append((r["chunk"], deltas(undeltas(r["at"])[hit])))
            if out:
                yield _rows(["chunk", "at"], [pa.int64(), pa.binary()], out)

    entries = chunks.select("chunk", "texts").mapInArrow(emit, "bucket int, chunk bigint, once binary, at binary, often binary, known binary")
    return entries.repartition(max(width(chunks.sparkSession), buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(match, "chunk bigint, at binary")


def _gathered(replies: DataFrame) -> DataFrame:
    # a chunk's replies are as bounded as the chunk
    return replies.groupBy("chunk").agg(F.collect_list("at").alias("ats"))


def windows_again(chunks: DataFrame, hits: DataFrame, window: int, buckets: int) -> DataFrame:
    """``(chunk, at)``: starts (in the chunk) of windows whose sequence starts earlier too, as packed arrays."""
    names, kinds = ["bucket", "chunk", "h1", "h2", "ids", "place", "at", "known"], [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    reach = window - ANCHOR

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for row in _each(batches):
            _, hashes, ends = _layout(unpack_texts(row["texts"]), cache)
            ids = np.repeat(unsqueeze(row["ids"], np.int64), np.diff(ends, prepend=0))
            place, left = _places(ends)
            marks = np.zeros(len(hashes) + reach + 2, np.int64)
            for x in row["ats"]:
                marks[undeltas(x) + 1] = 1
            seen = np.cumsum(marks)
            n = max(0, len(hashes) - window + 1)
            at = np.flatnonzero((seen[reach + 1 : reach + 1 + n] > seen[:n]) & (left[:n] >= window))
            h1, h2 = window_hashes(hashes, window)[at], window_hashes(hashes, window, 0x5BD1E995)[at] & np.uint64((1 << 8 * EXACT) - 1)
            ids, place = ids[at], place[at]
            order = np.lexsort((place, ids, h2, h1))
            h1, h2, ids, place, at = (x[order] for x in (h1, h2, ids, place, at))
            new = _runs(h1, h2)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (ids != ids[lead]) | (place != place[lead])
            known, keep = np.sort(at[later]), np.flatnonzero(~later)
            keep = keep[np.argsort(at[keep])]
            h1, h2, ids, place, at = (x[keep] for x in (h1, h2, ids, place, at))
            b = (h1 % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                if len(x := order[cut[k] : cut[k + 1]]):
                    rows.append((k, row["chunk"], low_bytes(h1[x], 8), low_bytes(h2[x], EXACT), squeeze(ids[x]), squeeze(place[x].astype(np.uint32)), deltas(at[x]), None))
            if len(known):
                rows.append((row["chunk"] % buckets, row["chunk"], None, None, None, None, None, deltas(known)))
            if rows:
                yield _rows(names, kinds, rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            out = [(r["chunk"], r["known"]) for r in held if r["known"] is not None]
            held = [r for r in held if r["known"] is None]
            if held:
                first = [from_low_bytes(r["h1"], 8) for r in held]
                size = [len(x) for x in first]
                h1, h2 = np.concatenate(first), np.concatenate([from_low_bytes(r["h2"], EXACT) for r in held])
                ids = np.concatenate([unsqueeze(r["ids"], np.int64) for r in held])
                place = np.concatenate([unsqueeze(r["place"], np.uint32) for r in held])
                order = np.lexsort((place, ids, h2, h1))
                new = _runs(h1[order], h2[order])
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                later = np.zeros(len(h1), bool)
                later[order] = (ids[order] != ids[lead]) | (place[order] != place[lead])
                at = 0
                for r, n in zip(held, size):
                    hit = later[at : at + n]
                    at += n
                    if hit.any():
                        out.append((r["chunk"], deltas(undeltas(r["at"])[hit])))
            if out:
                yield _rows(["chunk", "at"], [pa.int64(), pa.binary()], out)

    joined = chunks.select("chunk", "ids", "texts").join(_gathered(hits), "chunk")
    entries = joined.mapInArrow(emit, "bucket int, chunk bigint, h1 binary, h2 binary, ids binary, place binary, at binary, known binary")
    return entries.repartition(max(width(chunks.sparkSession), buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(match, "chunk bigint, at binary")


def cleaned(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs(doc_id, text, lang, source, n_chars)`` with the texts that ``without_repeats`` leaves.

    The other columns travel as they are, but n_chars is that of the new text. No row goes: a text of which
    nothing is left becomes empty.
    """
    return without_repeats(docs, window, carry=["lang", "source"]).select(
        "doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")
    )


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a window that begins at one of ``starts``."""
    marks = np.zeros(n + window + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return np.cumsum(marks)[:n] > 0


def without_repeats(docs: DataFrame, window: int = 20, texts: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, text, spans], *carry)`` of every row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` words over it has a sequence that starts earlier as well: at a
    smaller doc_id, or earlier in the same document. ``text`` is the input's where nothing goes, else the
    kept words joined by one space; ``spans``: (from, to) of the removed words, in words.
    Windows are judged on the input. Null and blank texts have no words; a row without an id comes after
    all others; rows with the same id and text are one document to each other, so none is the earlier;
    texts shorter than a window are kept; an empty table gives an empty table. ``window`` must be at
    least ANCHOR + PERIOD - 1 = 20.
    """
    if window < ANCHOR + PERIOD - 1:
        raise ValueError(f"window must be at least {ANCHOR + PERIOD - 1}")
    carry = carry or []
    chunks = chunked(docs, carry)
    buckets = bucket_count(chunks)
    again = windows_again(chunks, anchors_again(chunks, window, buckets), window, buckets)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))] * texts
    fields += [(c, pa.string()) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            raw = unpack_texts(row["texts"])
            ids = unsqueeze(row["ids"], np.int64)
            words = [x.split() for x in raw]
            ends = np.cumsum([len(x) for x in words], dtype=np.int64)
            starts = [undeltas(x) for x in row["ats"] or ()]
            gone = covered(np.concatenate(starts), int(ends[-1]), window) if starts else None
            others = [[x[1:].decode() if x else None for x in unpack_texts(row[f"carry{k}"])] for k in range(len(carry))]
            rows = []
            for i, own in enumerate(words):
                cut = gone[ends[i] - len(own) : ends[i]] if gone is not None else None
                n = int(cut.sum()) if cut is not None else 0
                kept = [w for w, g in zip(own, cut.tolist()) if not g] if n else own
                joined = b" ".join(kept)
                out = (None if ids[i] == NO_ID else int(ids[i]), len(own), n, hashlib.sha256(joined).hexdigest())
                if texts:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], cut, [0])).astype(np.int8))).reshape(-1, 2).tolist() if n else []
                    out += ((joined if n else raw[i]).decode("utf-8", "replace"), edges)
                rows.append(out + tuple(x[i] for x in others))
            yield _rows([x for x, _ in fields], [x for _, x in fields], rows)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string, spans array<array<int>>" * texts + "".join(f", {c} string" for c in carry)
    return chunks.join(_gathered(again), "chunk", "left").mapInArrow(run, schema)
