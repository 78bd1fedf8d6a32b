"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafworks.llm import ann, components, hmm, mixing, packing, quality, shingles, simhash, substring, tokencount, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words)))) for i in range(n)]
    rows += [(n + i, f"{rng.choice(vocabulary)} {passage}\t{rng.choice(vocabulary)}") for i in range(6)]
    rows += [(n + 10, rows[3][1]), (n + 11, rows[3][1]), (n + 12, None), (n + 13, ""), (n + 14, " \n "), (n + 15, "A b C"), (n + 16, "long " * 9000 + "tail")]
    return rows + [rows[5], rows[5]]  # repeated rows


# ---- 1


def test_hmm_counts_and_base(docs):
    rows = corpus()
    got = hmm.lm_scores(docs(rows), states=3, frequent=50, rounds=1).collect()
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        own = tokens(text[r.doc_id])
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert {r.doc_id for r in got if r.held_out} == {i for i in text if zlib.crc32(str(i).encode()) % 7 == 2}


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [[0, 1, 4, 2], [3], [2, 2, 1, 0, 4, 3]]
    got = hmm.forward(model, hmm.Ragged(np.concatenate(seqs), np.array([len(s) for s in seqs])))
    for s, x in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        assert x == pytest.approx(math.log(total))


def test_baum_welch_expects_what_paths_say():
    rng = np.random.default_rng(4)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T)
    s = [0, 3, 1, 2]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    hmm.expect(model, hmm.Ragged(np.array(s), np.array([4])), start, move, emit)
    want_move, want_emit, total = np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * model.emit[s[0], path[0]] * math.prod(model.move[a, b] * model.emit[o, b] for a, b, o in zip(path, path[1:], s[1:]))
        total += p
        for a, b in zip(path, path[1:]):
            want_move[a, b] += p
        for o, z in zip(s, path):
            want_emit[o, z] += p
    assert np.allclose(move, want_move / total, atol=1e-5) and np.allclose(emit, want_emit / total, atol=1e-5)


def test_hmm_empty_table(docs):
    assert hmm.lm_scores(docs([]).limit(0), rounds=1, frequent=10).collect() == []


# ---- 2


def mix_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, target double, weight double")


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", None, "é"]), "en", 1, 0.0, 0.0) for i in range(300)] + [(900, None, "a", "en", 0, 0.0, 0.0), (901, "", "z", "en", 0, 0.0, 0.0)]
    rows += rows[:2]
    got = mixing.mix(mix_table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(mix_table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, "one two three  four", f"s{i % 4}", "en", 19, 0.0, 0.0) for i in range(40)]
    out = mixing.mixed_documents(mix_table(spark, rows))
    want = mixing.mix(mix_table(spark, rows)).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    assert mixing.mix(mix_table(spark, rows).limit(0)).collect() == []


# ---- 3


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    rows = corpus()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs(rows), size=64, ids=True).collect()
    want = Counter((i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    by_doc = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, own in by_doc.items():
        copies = sum(n for (d, _), n in want.items() if d == i)
        ids = next(x for (d, x) in want if d == i)
        assert len(own) % copies == 0
        parts = {r.piece: r for r in own}
        assert b"".join(parts[k].ids for k in sorted(parts)) == ids
        assert all(parts[k].length == 64 for k in parts if k) and sum(parts[k].length for k in parts) == len(ids) // 4
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 64) * 1.05 + 1
    assert packing.pack(docs([]).limit(0)).collect() == []


def test_fast_encoder_equals_the_library():
    from tokenizers import Tokenizer

    json = open(packing.default_vocabulary()).read()
    slow = Tokenizer.from_str(json)
    slow.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c", "it's  I'LL 'd", "é ü 中文 😀", "<|endoftext|> x", "1234 56.7", "\t\tx \x85 y", "x" * 3000, " leading", "trailing \n", "a\u00a0b\u3000c", "\x1c\x1d z"]
    encode = packing.Encoder(json)
    assert encode.fast
    for t, x in zip(texts, encode(texts)):
        assert np.frombuffer(x, "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids


def test_texts_that_break_the_fast_encoder(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = [" " * 1_200_000 + "a", "\n" * 1_200_000, "x" * 200_000]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in texts]
    rows = packing.pack(docs(list(enumerate(texts))), ids=True).collect()
    for i, ids in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == ids.tobytes() and all(r.length <= 1024 for r in own)


def triplets(n, seed):
    """Sizes that fill n bins of 1000 exactly, three to a bin, where best fit decreasing needs many more."""
    rng, sizes = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    return sizes


def test_genetic_packing_gains_on_best_fit():
    gained = 0
    for seed in range(12):
        sizes = triplets(40, seed)
        first = packing.best_fit(sizes, sorted(range(120), key=lambda i: -sizes[i]), 1000, [])
        population = []
        for epoch in range(6):
            population = packing.evolve(sizes, 1000, population, 100 * seed + epoch)
        assert 40 <= len(population[0]) <= len(first)
        gained += len(first) - len(population[0])
    assert gained >= 6


def test_crossover_keeps_every_piece_once():
    sizes, rng = triplets(20, 3), random.Random(5)
    one, other = (packing.best_fit(sizes, rng.sample(range(60), 60), 1000, []) for _ in range(2))
    for _ in range(20):
        child = packing.cross(sizes, 1000, one, other, rng)
        assert sorted(i for b in child for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 1000 for b in child)


def test_the_elite_migrates(spark):
    sizes = triplets(20, 9)
    optimum = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(20)]
    alone = [[i] for i in range(60)]
    blob = lambda bins: packing.squeeze(packing._flat(bins, 60))
    shards = spark.createDataFrame([(0, packing.squeeze(np.array(sizes, np.int64)))], "shard int, length binary")
    held = spark.createDataFrame([(0, 0, blob(optimum), blob(optimum)), (0, 1, blob(alone), blob(alone))], "shard int, island int, population binary, elite binary")
    after = {r.island: r for r in packing._epoch(shards, held, 1000, 1, 11).collect()}
    assert len(after) == packing.ISLANDS and after[0].bins == after[1].bins == 20
    arrived = packing._grouped(packing.unsqueeze(bytes(after[1].elite), np.int32))
    assert sorted(map(sorted, arrived)) == optimum


def test_genetic_packing_beats_or_equals_best_fit():
    rng = random.Random(7)
    sizes = [rng.randint(100, 500) for _ in range(150)]
    first = packing.best_fit(sizes, sorted(range(150), key=lambda i: -sizes[i]), 1000, [])
    population = packing.evolve(sizes, 1000, packing.evolve(sizes, 1000, [], 1), 2)
    for bins in population:
        assert sorted(i for b in bins for i in b) == list(range(150))
        assert all(sum(sizes[i] for i in b) <= 1000 for b in bins)
    assert len(population[0]) <= len(first)


# ---- 4 and 5


def vectors(spark, n=700, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    rows += [(5000, None, 0), (5100, [float("nan")] * d, 0), (5200, [0.0] * (d - 1) + [None], 0), (5300, [float("inf")] * d, 0), (5400, [], 0), (None, rows[1][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int"), x


def test_top_k_is_exact(spark):
    table, x = vectors(spark)
    z = np.floor(1024 * x).astype(int)
    got = topk.quantised_top_k(table).collect()
    assert {r.query_id for r in got} == set(range(0, 700, 100))
    for q in range(0, 700, 100):
        scores = z @ z[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, scores[i]) for i in order]
    assert topk.quantised_top_k(table.limit(0)).collect() == []


def test_top_k_stops_on_proof():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    z = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    z[9] = z[0]
    index, read, rescored = topk.Index(np.arange(4000), z), [], []
    for q in range(0, 4000, 200):
        found, scores, n = index.top(z[q], 10, q)
        own = z @ z[q]
        want = [i for i in np.lexsort((np.arange(4000), -own)) if i != q][:10]
        keep = topk.best(index.ids[found], scores, 10)
        assert found[keep].tolist() == want and scores[keep].tolist() == own[want].tolist()
        read.append(n / z.size)
        rescored.append(len(found) / 4000)
    assert np.mean(read) < 0.5 and max(read) < 0.6 and np.mean(rescored) < 0.5
    few = topk.Index(np.arange(3), z[:3])
    assert few.top(z[0], 10, 0)[0].tolist() == [1, 2] and topk.Index(np.arange(0), z[:0]).top(z[0], 10, -1)[0].tolist() == []


def test_vectors_with_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.9, 0.1]), (7, [1.0, 0.5]), (8, [0.0, 1.0]), (8, [0.5, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r.query_id, r.vec_id) for r in sorted(topk.quantised_top_k(table).collect(), key=lambda r: r["rank"])]
    assert got == [(100, 7), (100, 100), (100, 8), (100, 8)]
    near = [(r.query_id, r.vec_id) for r in sorted(ann.nearest(table).collect(), key=lambda r: r["rank"])]
    assert near == [(100, 100), (100, 7), (100, 8), (100, 8)]


@pytest.mark.parametrize("kind, most", [("even", 0.6), ("clustered", 0.05), ("two levels", 0.1)])
def test_measured_probes(spark, monkeypatch, kind, most):
    rng = np.random.default_rng(4)
    d, n = (16, 3000) if kind == "even" else (64, 4000)
    x = rng.normal(size=(n, d))
    if kind != "even":
        x = 0.3 * x + rng.normal(size=(80, d))[rng.integers(0, 80, n)]
    if kind == "two levels":
        monkeypatch.setattr(ann, "MOST_LISTS", 16)
    seen, plain = [], ann.probe_count
    monkeypatch.setattr(ann, "probe_count", lambda *a: seen.append((plain(*a), a[3])) or seen[-1][0])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(table).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for r in got:
        scores = u @ u[r.query_id]
        scores[r.query_id] = -9
        hit += len(set(r.v) & set(np.argsort(-scores)[:5].tolist()))
    (count, cells), = seen
    assert len(got) == n // 50 and hit / (5 * len(got)) >= 0.9 and count <= most * cells.number
    assert (cells.residuals > 1) == (kind == "two levels")


def test_nearest_neighbours_recall(spark):
    table, x = vectors(spark, 3000)
    got = ann.nearest(table, probes=0.5).collect()
    hit = 0
    for q in range(0, 3000, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in own}
        scores = x @ x[q]
        scores[q] = -9
        for r in own:
            assert r.score == pytest.approx(scores[r.vec_id])
        hit += len({r.vec_id for r in own} & set(np.argsort(-scores)[:5].tolist()))
    assert hit / (60 * 5) >= 0.9
    few = table.filter("vec_id < 3")
    assert len(ann.nearest(few).collect()) == 2 and ann.nearest(table.limit(0)).collect() == []


# ---- 6


def test_ratios_and_dual_descent():
    """Against ratios by hand, and the optimality conditions of the hinge-loss problem."""
    rng = np.random.default_rng(2)
    y = (rng.random(120) < 0.4).astype(int)
    rows = [np.unique(rng.integers(0, 30, 8) + 12 * t) for t in y]
    alpha, c = 1.0, 1.0
    weights, bias, _, _ = quality.fit(rows, y, alpha, c, epochs=2000)
    dim = 1 << quality.BITS
    p, q = (alpha + np.bincount(np.concatenate([x for x, t in zip(rows, y) if t == k]), minlength=dim) for k in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    used = ratio != 0
    w = np.where(used, weights / np.where(used, ratio, 1), 0)
    sign = np.where(y > 0, 1.0, -1.0)
    x = np.zeros((120, dim))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / math.sqrt(len(own))
    cost = np.where(y > 0, c * 120 / (2 * y.sum()), c * 120 / (2 * (120 - y.sum())))
    value = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * (x @ w + b))).sum()
    best = value(w, bias)
    seen = np.unique(np.concatenate(rows))
    for _ in range(500):  # the objective is convex, and no step makes it smaller by more than descent leaves
        step = rng.normal(size=len(seen) + 1) * 10.0 ** rng.integers(-4, 0)
        moved = w.copy()
        moved[seen] += step[:-1]
        assert value(moved, bias + step[-1]) >= best * (1 - 2e-3)
    assert best < 0.5 * value(np.zeros(dim), 0.0)


def test_clashing_labels_count_as_none(spark, docs):
    words = ["alpha beta gamma", "BUY!! NOW!!", "delta epsilon zeta", "WIN!! BIG!!"]
    rows = [(i, words[i % 4] + f" w{i}") for i in range(40)] + [(1, "a second text of an id")]
    clean = [(i, 1 - i % 2) for i in range(40)]
    one, two = (spark.createDataFrame(x, "doc_id long, quality int") for x in ([c for c in clean if c[0] != 6], [*clean, (6, 0)]))
    by = lambda t: sorted((r.doc_id, r.score) for r in quality.classify(docs(rows), t).collect())
    assert by(one) == by(two) == by(two.orderBy("quality"))


def test_quality_held_out(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeklmnort") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        text = " ".join(word() for _ in range(rng.randint(5, 60)))
        if i % 5 == 1:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split())
        rows.append((i, text))
        labels.append((i, 0 if i % 5 == 1 else 1, 0))
    labels += [(None, 1, 0), (3, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows += [(1000, None), (1001, ""), (None, "x"), (1002, "w " * 50000)]
    got = quality.classify(docs(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    bare = quality.classify(docs(rows[:5]), table.limit(0)).collect()
    assert {r.score for r in bare} == {0.5}
    assert quality.classify(docs([]).limit(0), table).collect() == []


# ---- 7


@pytest.mark.parametrize("fallback", [False, True])
def test_token_counts_equal_the_library(spark, docs, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.default_pieces()
    library = Tokenizer(models.Unigram(pieces, 0, fallback))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    texts = [t for _, t in corpus() if t is not None] + ["日本語 テスト", "a▁b", "<unk> ☃☃ x☃", "déjà-vu\u3000x\x85y", "\x1c a\x1db", "zzzzqqqqxxxx" * 20]
    rows = list(enumerate(texts)) + [(9000, None)]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs(rows), byte_fallback=fallback).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in rows}


def test_token_count_ties():
    from tokenizers import Tokenizer, models

    rng = random.Random(5)
    for _ in range(40):
        pieces = [("<unk>", 0.0)] + [(p, float(rng.randint(-3, 0))) for p in {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 3))) for _ in range(8)}]
        library, counter = Tokenizer(models.Unigram(pieces, 0, False)), tokencount.Counter(pieces)
        for _ in range(20):
            word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
            assert counter.word(word) == len(library.encode(word).ids), (pieces, word)


# ---- 8


def removed(rows, window=20):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (rows[k][0], s))
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(docs):
    rows = corpus()
    rng = random.Random(9)
    long = " ".join(f"p{rng.randint(0, 9**6)}" for _ in range(60))
    rows += [(2000 + i, f"{'x ' * (i % 17)}q{i} {' '.join(long.split()[i % 9 : 35 + i % 20])} y{i}") for i in range(40)] + [(None, long), (-5, long)]
    got = substring.without_repeats(docs(rows), texts=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == removed(rows)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
    assert substring.without_repeats(docs([]).limit(0)).collect() == []
    assert substring.cleaned(docs(rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_cover_meets_every_difference():
    for i, j in itertools.product(range(substring.PERIOD), repeat=2):
        assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


# ---- 9


def simhash_by_hand(text, words=4):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs):
    rows = corpus(n=120)
    rng = random.Random(11)
    base = " ".join(f"v{rng.randint(0, 500)}" for _ in range(400)).split()
    for k in range(60):
        own = list(base)
        own[rng.randrange(400)] = f"n{k}"
        rows.append((3000 + k, " ".join(own)))
    got = simhash.near_duplicates(docs(rows), words=4, budget=4).collect()
    prints = {(i, simhash_by_hand(t)) for i, t in rows}
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in got} == prints and len(got) == len(rows)
    ids = sorted({f for _, f in prints})
    label = {f: f for f in ids}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in itertools.combinations(ids, 2):
        if (a ^ b).bit_count() <= 4:
            label[root(a)] = root(b)
    least = {}
    for i, f in prints:
        least[root(f)] = min(least.get(root(f), i), i)
    assert all(r.component_id == least[root(r.fp & (1 << 64) - 1)] for r in got)
    kept = simhash.one_of_each(docs(rows), simhash.near_duplicates(docs(rows), words=4, budget=4))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs([]).limit(0)).collect() == []


def test_similar_texts(docs):
    rng = random.Random(12)
    text = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(60):
        base = text(rng.randint(60, 400))
        rows.append((10 * g, " ".join(base)))
        group[10 * g] = 10 * g
        for k in range(1, 4):  # copies with a word in 60 changed: similar; the last one half new: not
            own = list(base)
            for at in range(rng.randrange(60), len(own), 60):
                own[at] = f"n{k}"
            if k == 3:
                own = own[: len(own) // 2] + text(len(own) - len(own) // 2)
            rows.append((10 * g + k, " ".join(own)))
            group[10 * g + k] = 10 * g if k < 3 else 10 * g + k
    rows += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A b"), (None, "only one"), rows[0]]
    got = shingles.similar(docs(rows), words=5, similarity=0.8).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.component_id for r in got}
    assert (found[9000], found[9001], found[9002], found[9003], found[None]) == (9000, 9000, 9002, 9002, None)
    assert sum(found[i] == c for i, c in group.items()) / len(group) >= 0.97
    assert all(found[i] == i for i, c in group.items() if c == i)
    assert shingles.similar(docs([]).limit(0)).collect() == []


def test_similar_is_exact(docs, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLED", 1)
    monkeypatch.setattr(shingles, "HOT", 8)
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    line = text(14)
    rows = [(k, " ".join(line * 20 + text(100))) for k in range(20)]  # a line 20 times and other words: not similar
    for g in range(40):  # edits that leave similarities on both sides of 0.8
        base = text(104)
        rows.append((100 + 10 * g, " ".join(base)))
        for k in range(1, 6):
            own = list(base)
            own[: 5 * k] = text(5 * k)
            rows.append((100 + 10 * g + k, " ".join(own)))
    rows.append((900, " ".join(["a b c d e f"] * 9)))
    rows.append((901, " ".join(["a b c d e f"] * 3)))
    of = {}
    for i, x in rows:
        w = x.split()
        of[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in of}
    for a, b in itertools.combinations(of, 2):
        if label[a] != label[b] and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]):
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if c == hi else c for i, c in label.items()}
    got = {r.doc_id: r.component_id for r in shingles.similar(docs(rows), words=5, similarity=0.8).collect()}
    assert got == label and 100 < len(set(label.values())) < len(rows)


@pytest.mark.parametrize("first", [1, 16])
def test_large_group_of_near_copies_is_not_paired_out(docs, monkeypatch, first):
    monkeypatch.setattr(shingles, "SAMPLED", 1)
    monkeypatch.setattr(shingles, "FIRST", first, raising=False)
    made = Counter()
    for name in ("sketched", "verified"):

        def counted(pairs, *more, name=name, f=getattr(shingles, name)):
            made[name] += pairs.select("a", "b").distinct().count()
            return f(pairs, *more)

        monkeypatch.setattr(shingles, name, counted)
    rng = random.Random(23)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for k in range(500):  # one to four words of their own, so that pairs are on both sides of 0.8
        own = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3, 4))):
            own[at] = f"n{k}x{at}"
        rows.append((k, " ".join(own)))
    long = [f"l{k}" for k in range(3000)]  # longer than short sketches tell apart
    for k in range(20):
        own = list(long)
        for at in rng.sample(range(3000), rng.choice((20, 50, 80))):
            own[at] = f"m{k}x{at}"
        rows.append((1000 + k, " ".join(own)))
    of = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in rows)}
    label = {i: i for i in of}
    for a, b in itertools.combinations(of, 2):
        if label[a] != label[b] and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]):
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if c == hi else c for i, c in label.items()}
    got = {r.doc_id: r.component_id for r in shingles.similar(docs(rows), words=5, similarity=0.8).collect()}
    assert got == label and max(Counter(label.values()).values()) > 200 and len(set(label.values())) > 20
    assert made["sketched"] + made["verified"] <= 20 * len(rows)


def test_one_row_of_each_component_without_ids(docs):
    rng = random.Random(22)
    a, b, c = (" ".join(f"v{rng.randint(0, 5000)}" for _ in range(100)) for _ in range(3))
    rows = [(None, a), (None, a + " x"), (None, b), (7, c), (7, b + " y"), (8, c + " z"), (8, c + " z")]
    kept = shingles.one_of_similar(docs(rows), words=5, similarity=0.8).collect()
    assert sorted((r.doc_id or 0, r.text[:20]) for r in kept) == sorted([(0, a[:20]), (7, c[:20]), (7, b[:20])])


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(150):
        x = base
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(signed))], "doc_id long, fp long")
    found = simhash.components_of(table, 4).collect()
    ids = {i: x for i, x in enumerate(sorted(signed))}
    seen, todo = {0}, [0]
    while todo:
        a = todo.pop()
        for b in ids:
            if b not in seen and ((ids[a] ^ ids[b]) & (1 << 64) - 1).bit_count() <= 4:
                seen.add(b)
                todo.append(b)
    assert {r.doc_id for r in found if r.component_id == 0} == seen


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in components.connected(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.connected(edges.limit(0)).collect() == []


# ---- 10


def rule_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_templates(spark):
    given = ["http://a.example.com/en/71", "https://EXAMPLE.com/en/8?x#y", "http://com/en/1", "http://xcom/en/1", "http://a.net/de/81", "http://a.example.net/de/8", "http://b.org/es/", "http://b.org/EN/1", "no", None, "", "x://", "x://h", "x://h?q=/a", "x://h#/a", "a://b.com/en/://c", "http://q.com/" + "s/" * 50]
    given += [f"http://q.com/fr/{i}.html" for i in range(30)] + [f"http://q.com/t/{'abcdefgh'[i % 8]}{'xyz' * (i % 3)}/p" for i in range(30)]
    given.append(given[0])
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(given)], "page_id long, url string, html string, host string")
    got = urls.judge(pages).collect()
    assert len(got) == len(given)
    for r in got:
        host, path, rule, verdict = rule_by_hand(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    bad = spark.createDataFrame([(f"http://q.com/fr/{i + 500}.html", True) for i in range(20)] + [("http://q.com/t/ab/p", False)], "url string, bad boolean")
    judged = {r.page_id: r.verdict for r in urls.judge(pages, labels=bad).collect() if r.rule is None}
    assert all(judged[i] == "block" for i, u in enumerate(given) if u and "/fr/" in u) and all(judged[i] == "allow" for i, u in enumerate(given) if u and "/t/" in u)
    assert urls.judge(pages.limit(0)).collect() == []


def tree_by_hand(pages):
    """(template, score) of each (host, path, bad or None), by the definition."""
    def segments(path):
        out = []
        for s in path.split("/"):
            if s and any(c in "0123456789" for c in s):
                m = re.search(r"(\.[a-z]{1,5})$", s)
                out.append("*" + (m[1] if m else ""))
            elif s:
                out.append(s)
        return out[: urls.DEPTH - 1] + ["/".join(out[urls.DEPTH - 1 :])] if len(out) > urls.DEPTH else out

    shapes = [(h, segments(p), b) for h, p, b in pages]
    named = [[] for _ in shapes]
    for level in range(urls.DEPTH):
        parents = {}
        for i, (h, s, b) in enumerate(shapes):
            if len(s) > level and not s[level].startswith("*"):
                parents.setdefault((h, tuple(named[i])), []).append(i)
        names = {}
        for parent, own in parents.items():
            branch, below = {}, Counter(shapes[i][1][level + 1] if len(shapes[i][1]) > level + 1 else "/" for i in own)
            for i in own:
                branch.setdefault(shapes[i][1][level], []).append(i)
            labels = [shapes[i][2] for i in own if shapes[i][2] is not None]
            for s, mine in branch.items():
                kids = Counter(shapes[i][1][level + 1] if len(shapes[i][1]) > level + 1 else "/" for i in mine)
                chi = sum((kids[c] - len(mine) * n / len(own)) ** 2 / (len(mine) * n / len(own)) for c, n in below.items())
                free, deeper = len(below) - 1, any(c != "/" for c in kids)
                form = deeper and len(mine) >= urls.LEAST and chi <= free + urls.Z * math.sqrt(2 * free) + 1e-9
                seen = [shapes[i][2] for i in mine if shapes[i][2] is not None]
                rest, both, differs = len(labels) - len(seen), False, False
                if seen and rest:
                    both, pooled = True, sum(labels) / len(labels)
                    error = math.sqrt(pooled * (1 - pooled) * (1 / len(seen) + 1 / rest))
                    differs = error > 0 and abs(sum(seen) / len(seen) - (sum(labels) - sum(seen)) / rest) >= urls.Z * error
                many = len(branch) > urls.BRANCHES and len(own) < urls.REPEATS * len(branch)
                alike = len(branch) > 1 and not differs and (form or (both and not deeper))
                names[parent, s] = "*" if many else "+" if alike else s
        for i, (h, s, b) in enumerate(shapes):
            if len(s) > level:
                named[i] = named[i] + [names.get(((h, tuple(named[i])), s[level]), s[level])]
    groups = {}
    for i, (h, s, b) in enumerate(shapes):
        groups.setdefault((h, tuple(named[i])), []).append(b)
    score = {}
    for key, own in groups.items():
        known = [b for b in own if b is not None]
        a = 1 + urls.UNSEEN * (len(own) - len(known))
        score[key] = (sum(known) + a) / (len(known) + 2 * a) if known else 0.5
    return [("/" + "/".join(named[i]), score[h, tuple(named[i])]) for i, (h, s, b) in enumerate(shapes)]


def test_url_tree_against_brute_force(spark):
    rng = random.Random(6)
    given = []
    for host in ("a.example.com", "b.example.com", "c.example.net", "d.example.org", "e.example.info"):
        for _ in range(160):
            kind = rng.random()
            if kind < 0.6:
                path = f"/{rng.choice(['en', 'en', 'en', 'de', 'fr', 'es'])}/{rng.randint(1, 9999)}{rng.choice(['', '', '', '.html', '/'])}"
            elif kind < 0.8:
                path = f"/tag/{''.join(rng.choice('abcdefgh') for _ in range(3))}"
            elif kind < 0.9:
                path = f"/shop/{rng.choice(['red', 'blue'])}/{rng.choice(['cart', 'list'])}/x/y/z/{rng.choice(['p', 'q'])}/{rng.randint(1, 5)}"
            else:
                path = rng.choice(["/", "", "/about", "/help", "/en/"])
            given.append(f"https://{host}{path}")
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    parts = [rule_by_hand(u) for u in given]
    want = tree_by_hand([(h, p, None if v is None else int(v == "block")) for h, p, _, v in parts])
    verdicts = Counter()
    for i, ((h, p, rule, verdict), (template, score)) in enumerate(zip(parts, want)):
        r = got[i]
        assert r.template == template and r.score == pytest.approx(score)
        assert r.verdict == (verdict or ("block" if score >= urls.REJECT else "allow"))
        verdicts[rule is None, r.verdict] += 1
    assert all(verdicts[k] > 20 for k in itertools.product((True, False), ("allow", "block")))
