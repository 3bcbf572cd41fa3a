"""Whitening, the Merkle manifest and hidden Markov scores against plain code."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import hmm_scoring, merkle_manifest, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, rid long, word string"
ODD = [
    (1, None, None, None, None, "x", "y", 1, "w"),
    (2, "", "en", "", 0, None, None, 1, None),
    (4, "line\nfeeds\n here", "en", "a", 1, None, None, 1, None),
    (4, "line\nfeeds\n here", "en", "a", 1, None, None, 1, None),
    (None, "no id\n", None, "a", None, None, None, 1, None),
    (None, "no id\n", None, None, None, None, None, 1, None),
    (6, "word \x0b\x0c\n" * 60_000, "en", "é", 1, None, None, 1, None),
    (7, "Ängström İX straße <end> \x85   　", "en", "z", -5, None, None, 1, None),
    (-3, "long" * 50_000, "en", "\U0001f600", 1, None, None, 1, None),
    (10, "x\r\ny", "￿", "￿", 2**62, None, None, 1, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int, component string")


def check_whitening(rows, k=4):
    """Against numpy's eigh over the distinct vectors."""
    found = [r for r in rows["out"]]
    x = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, (_, v, *_) in enumerate(rows["in"]) if v is not None and len(v) == rows["d"] and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    w, u = np.linalg.eigh(c.T @ c / n)
    w, u = w[::-1], u[:, ::-1]
    k = min(k, int((w > 1e-12 * w[0]).sum()))
    assert len(found) == len(x) * k
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = np.zeros(k)
    for i, v in x.items():
        vec_id = rows["in"][i][0]
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        own = (v - s / n) @ u[:, :k] / np.sqrt(w[:k])
        for j in range(k):
            r = by[vec_id, j + 1][0]
            if not signs[j] and abs(own[j]) > 1e-3:
                signs[j] = np.sign(own[j] * r.whitened)
            assert r.n == n and r.deviation == (exact if exact < 2**63 else None)
            assert r.whitened == pytest.approx(own[j] * (signs[j] or 1), abs=1e-8)
            assert r.explained == pytest.approx(w[j] / w.sum(), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("d,n", [(1, 30), (3, 50), (24, 300), (80, 400)])
def test_whitening_agrees_with_eigh(spark, d, n):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(n, d)) * np.linspace(2, 0.5, d) + 1
    rows = [(i, [float(c) for c in r], 1, None, None, None) for i, r in enumerate(v)]
    rows += [(n + i, rows[0][1], 1, None, None, None) for i in range(200)]
    check_whitening({"in": rows, "out": whitening.whiten(vectors(spark, rows)).collect(), "d": d})


def test_whitening_widens_its_block(spark):
    """A flat spectrum beyond the first block's columns still ends in few passes."""
    rng = np.random.default_rng(5)
    frame = vectors(spark, [(i, [float(c) for c in r], 1, None, None, None) for i, r in enumerate(rng.normal(size=(2000, 48)))])
    fit, d = whitening.fit_list(frame.select(whitening.whole_numbers().alias("x")))
    found = whitening.spectrum(fit, d, 4)
    assert found.passes < 40 and found.residuals.max() < 1e-13


def test_whitening_defines_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], 1, "a", 1, "c"), (2, None, 1, "a", 1, "c"), (3, [nan, 1.0], 1, None, None, None), (4, [inf, 1.0], 1, None, None, None), (5, [None, 1.0], 1, None, None, None), (6, [0.5, 0.25], None, None, None, None), (7, [-0.0, 3.0], None, None, None, None), (None, [1.0, -2.0], None, None, None, None), (8, [1.0], None, None, None, None), (9, [], None, None, None, None)]
    check_whitening({"in": [r for r in rows if r[1] != [1.0]], "out": whitening.whiten(vectors(spark, rows)).collect(), "d": 2})
    assert whitening.whiten(vectors(spark, [])).count() == 0
    same = [(i, [0.5, 0.25], 1, None, None, None) for i in range(5)]
    assert whitening.whiten(vectors(spark, same)).count() == 0  # no variance, no component
    huge = [(1, [3e30, 1.0], 1, None, None, None), (2, [-3e30, 2.0], 1, None, None, None), (3, [0.0, 1.5], 1, None, None, None)]
    out = whitening.whiten(vectors(spark, huge)).collect()
    assert out and all(r.deviation is None for r in out if r.vec_id != 3)
    line = [(i, [float(i), 2.0 * i, 0.0], 1, None, None, None) for i in range(20)]
    assert {r.component for r in whitening.whiten(vectors(spark, line)).collect()} == {1}  # rank one


def test_exact_deviation_beyond_fast_integers():
    x = np.array([[2**40, -(2**41)], [3, 5]])
    assert whitening.deviations(x, 2, (2**40 + 3, 5 - 2**41)) == [None, None]
    assert whitening.deviations(np.array([[7, 9]]), 10, (3, 4)) == [67**2 + 86**2]


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Root and for each leaf the siblings (before, after) of each level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            run = i // 3 * 3
            way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], ways


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        leaves = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(*(r[c] for c in merkle_manifest.FIELDS)), r["text"]) for r in by[s]), key=lambda x: x[:3])
        subs[s] = (leaves, *plain_tree([x[2] for x in leaves]))
    root, tops = plain_tree([subs[s][1] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        leaves, sub, ways = subs[s]
        lookup = {}
        for r in by[s]:
            lookup.setdefault((r["doc_id"], plain_leaf(*(r[c] for c in merkle_manifest.FIELDS))), r)
        for (known, doc_id, leaf, _), way in zip(leaves, ways):
            doc_id = doc_id if known else None
            r = lookup[doc_id, leaf]
            value = leaf
            if known and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r["text"] is not None:
                value = plain_leaf(doc_id, s, r["lang"], r["n_chars"], r["text"].replace("\n", ""))
            for before, after in way + top:
                value = h(before + value + after)
            out[doc_id, leaf, sub, root, h("".join(b + a for b, a in way + top)), value, value == root] += 1
    return out


def as_counter(frame):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in frame.collect())


def test_manifest_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert as_counter(merkle_manifest.verify(docs)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_odd_rows(spark, odd):
    assert as_counter(merkle_manifest.verify(odd)) == plain_manifest([r.asDict() for r in odd.collect()])
    assert merkle_manifest.verify(odd.where("false")).count() == 0
    one = odd.where("doc_id = 6")
    found = merkle_manifest.verify(one).first()
    assert found.leaf == found.subroot == found.root and found.proof_sha256 == h("")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 82, 700])
def test_manifest_over_partition_edges(spark, monkeypatch, n):
    """Partitions of a few leaves and rounds of two partitions, so that runs of all levels lie over edges."""
    monkeypatch.setattr(merkle_manifest, "LEAVES", 5)
    monkeypatch.setattr(merkle_manifest, "MERGED", 2 if n < 100 else 8)
    rng = random.Random(n)
    rows = [(i, f"t{i}\n", "en", "hot" if rng.random() < 0.7 else f"s{rng.randrange(max(1, n // 3))}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert as_counter(merkle_manifest.verify(docs)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_mountains_leave_what_a_tree_needs():
    for total, start, stop in [(10, 0, 10), (10, 2, 7), (28, 9, 28), (81, 1, 80), (5, 4, 5)]:
        leaves = [h(str(i)) for i in range(total)]
        whole = {(0, i): v for i, v in enumerate(leaves)}
        merkle_manifest.climb(whole, total)
        peaks, made = merkle_manifest.mountains(leaves[start:stop], start, total)
        assert all(whole[level, at] == v for level, at, v in peaks + made)
        parts = [merkle_manifest.mountains(leaves[a:b], a, total)[0] for a, b in ((0, start), (start, stop), (stop, total)) if a < b]
        held = {(level, at): v for p in parts for level, at, v in p}
        merkle_manifest.climb(held, total)
        assert held[merkle_manifest.height(total), 0] == whole[merkle_manifest.height(total), 0]


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def check_base(frame, sizes=hmm_scoring.Sizes()):
    rows = frame.select("doc_id", "text").collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    counts = Counter(t for r, out in zip(rows, held) if not out for t in [*plain_tokens(r.text), ("end",)])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r, out in zip(rows, held):
        tokens = [*plain_tokens(r.text), ("end",)]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        expected[r.doc_id, out, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4)] += 1
    found = hmm_scoring.score(frame, sizes).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
    assert all(math.isfinite(r.score) for r in found)
    return found


def test_hmm_counts_and_scores(spark, sf_dir, odd):
    found = check_base(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)  # both are negative
    check_base(odd)
    assert hmm_scoring.score(odd.where("false")).count() == 0
    nothing = hmm_scoring.score(odd.where(hmm_scoring.held_out())).collect()
    assert all(r.base_score == 0 and math.isfinite(r.score) for r in nothing)


def test_hmm_small_tables_force_misses(spark, sf_dir):
    """Few broadcast words: the rest come by the join, and base scores stay exact."""
    check_base(spark.read.parquet(f"{sf_dir}/documents.parquet"), hmm_scoring.Sizes(words=64, broadcast=256, classes=32))


def random_model(rng, states, symbols):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm_scoring.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def plain_counts(model, ids):
    """Likelihood and expected counts by all paths."""
    k = len(model.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for path in product(range(k), repeat=len(ids)):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            p *= model.move[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
        total += p
        start[path[0]] += p
        for t, s in enumerate(path):
            emit[ids[t], s] += p
            if t:
                move[path[t - 1], s] += p
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("group", [1 << 18, 3])
def test_recursions_against_all_paths(monkeypatch, group):
    """Also with groups so small that a text goes by stretches."""
    monkeypatch.setattr(hmm_scoring, "GROUP", group)
    rng = np.random.default_rng(3)
    model = random_model(rng, 3, 5)
    rows = [rng.integers(0, 5, n) for n in (1, 7, 2, 2, 5, 1, 8)]
    counts = hmm_scoring.Counts.none(5, 3)
    hmm_scoring.expect(model, rows, counts)
    plain = [plain_counts(model, r) for r in rows]
    assert hmm_scoring.log_likelihoods(model, rows) == pytest.approx([math.log10(p[0]) for p in plain])
    assert counts.log == pytest.approx(sum(math.log10(p[0]) for p in plain))
    for found, k in ((counts.start, 1), (counts.move, 2), (counts.emit, 3)):
        assert found == pytest.approx(sum(p[k] for p in plain))
    assert hmm_scoring.Counts.of(counts.flat(), 5, 3).emit == pytest.approx(counts.emit)


def test_baum_welch_raises_the_likelihood(spark, sf_dir):
    docs = hmm_scoring.texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    learned = docs.where(~hmm_scoring.held_out())
    known = hmm_scoring.vocabulary(hmm_scoring.word_counts(learned), learned.count())
    model, logs = hmm_scoring.trained(hmm_scoring.encoded(docs, known), known, passes=5)
    assert logs == sorted(logs)
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1)


def test_word_shares_sum_to_one(spark):
    """Over known words and one unknown word for each class."""
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 1 + i % 5) for i in range(40_000)], "word binary, c long").withColumn("c", F.col("c").cast("long"))
    known = hmm_scoring.vocabulary(counts, 10)
    model = hmm_scoring.model_of(hmm_scoring.Counts(np.ones(2), np.ones((2, 2)), np.stack([hmm_scoring.unigrams(known)] * 2, axis=1)), known)
    shares = 10 ** known.share(known.symbols, known.counts)
    total = (model.emit[known.symbols, 0] * shares).sum() + model.emit[0, 0]
    unknown = (model.emit[1 + known.sizes.words :, 0] * known.unknown / (known.inside + known.unknown)).sum()
    assert known.total == 40_000 * 3 + 10 and total + unknown == pytest.approx(1, abs=1e-9)
