"""Operators 1 to 5 against brute force, and their defined results for odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociflow.llm import embedding_dedup, quality_qda, simhash_dedup, token_counts, topk_search
from lociflow.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string"
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "a", 0, None, None),
    (3, "  two  spaces\n ▁x\t\0 <s> <unk>\n", "en", "a", 1, None, None),
    (None, "no id here", None, None, None, None, None),
    (4, "Same text as the other one here", "en", "a", 1, None, None),
    (4, "Same text as the other one here", "en", "a", 1, None, None),
    (5, "same TEXT as the other one here", "en", "a", 1, None, None),
    (6, "word " * 90_000, "en", "a", 1, None, None),
    (7, "long" * 50_000, "en", "a", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_token_counts(spark, docs, odd):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for frame in (docs, odd):
        rows = frame.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in rows)
        assert sorted((str(r[0]), *r[1:]) for r in token_counts.count_tokens(frame, model).collect()) == want
    assert token_counts.count_tokens(odd.limit(0), model).count() == 0


def test_token_counts_fuzz():
    random.seed(1)
    c = token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    c.load(("the\0\nthe\0of", bytes(c.encode(["the", "\nthe", "of"]))))
    texts = ["".join(random.choice(" \n\t▁aé漢\0<s>theof 🙂") for _ in range(random.randrange(40))) for _ in range(3000)]
    assert c.exact and c.count(texts) == [len(x) for x in c.model.encode(texts)]


def test_embedding_dedup(spark, sf_dir):
    inf, nan = math.inf, math.nan
    base = [float(i % 7 - 3) for i in range(8)]
    rows = [(i, v, l, "x") for i, (v, l) in enumerate([(None, 1), ([], 1), ([0.0] * 8, 1), ([inf] * 8, 1), ([nan] + [1.0] * 7, 1), ([None] + [1.0] * 7, 1), (base, None), (base, 1), (base, 1), ([2 * x for x in base], 1), (base, 2), (base[:4], 1), ([1e300 * x for x in base], 1)])]
    rows += [(7, base, 1, "x"), (None, base, 1, "x"), (20, [1.0] + [0.0] * 7, 1, "x"), (21, [1.0, 0.2031] + [0.0] * 6, 1, "x"), (22, [1.0, 0.2030] + [0.0] * 6, 1, "x")]
    small = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for frame in (small, whole):
        data = [(i, r.vec_id, r.embedding, r.label) for i, r in enumerate(frame.collect())]
        good = [x for x in data if x[1] is not None and x[3] is not None and x[2] and all(v is not None and math.isfinite(v) for v in x[2]) and any(x[2])]
        e = {x[0]: np.array(x[2], float) / np.abs(x[2]).max() for x in good}
        pairs = [(a, b) for a in good for b in good if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and e[a[0]] @ e[b[0]] / math.sqrt((e[a[0]] @ e[a[0]]) * (e[b[0]] @ e[b[0]])) >= 0.98]
        root = roots({x[1] for x in data if x[1] is not None}, [(a[1], b[1]) for a, b in pairs])
        n = {x[0]: 0 for x in data}
        for a, b in pairs:
            n[a[0]] += 1
            n[b[0]] += 1
        want = sorted((str(x[1]), n[x[0]], root.get(x[1]), x[1] is not None and root[x[1]] == x[1]) for x in data)
        assert sorted((str(r[0]), *r[1:]) for r in embedding_dedup.near_duplicates(frame).collect()) == want
        parts = embedding_dedup.near_duplicates(frame, list_rows=5)
        assert sorted((str(r[0]), *r[1:]) for r in parts.collect()) == want
    assert embedding_dedup.near_duplicates(small.limit(0)).count() == 0


def test_top_k(spark, sf_dir):
    rows = [(0, [0.5, 0.25], None), (100, [1.0, -1.0], None), (1, [0.5, 0.25], None), (2, [0.5, 0.25], None), (3, None, None), (4, [None, 1.0], None), (5, [math.nan, 1.0], None), (6, [1.0], None), (None, [1.0, 1.0], None), (200, [1.0], None), (7, [0.0009, -0.0009], None), (100, [1.0, -1.0], None), (8, [1e12, 1e12], None)]
    frames = [spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")]
    for frame in frames:
        data = [(r.vec_id, [math.floor(1024 * v) for v in r.embedding]) for r in frame.collect() if r.vec_id is not None and r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
        want = []
        for q, v in {q: v for q, v in data if q % 100 == 0}.items():
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in data if c != q and len(w) == len(v))
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:10])]
        for block in (1 << 25, 600):
            assert sorted(tuple(r) for r in topk_search.top_k(frame, block_bytes=block).collect()) == sorted(want)
    assert topk_search.top_k(frames[0].limit(0)).count() == 0


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs, odd):
    for frame in (docs, odd):
        rows = [(r.doc_id, plain_simhash(r.text)) for r in frame.collect()]
        with_id = [r for r in rows if r[0] is not None]
        linked = [(a, b) for a, x in with_id for b, y in with_id if a < b and (x ^ y).bit_count() <= 4]
        root = roots({a for a, _ in with_id}, linked)
        want = sorted((str(a), f"{x:016x}", root.get(a)) for a, x in rows)
        assert sorted((str(r[0]), *r[1:]) for r in simhash_dedup.near_duplicates(frame).collect()) == want
        kept = simhash_dedup.keep_one(frame)
        assert kept.columns == frame.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(a) for a in root if root[a] == a] + ["None"] * (len(rows) - len(with_id)))
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprint_links_by_parts(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.add(v)
    signed = [v - (v >> 63 << 64) for v in values]
    linked = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = roots(signed, linked)
    for size in (4096, 4):
        edges = simhash_dedup.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_rows=size)
        assert roots(signed, [tuple(r) for r in edges.collect()]) == want


def test_bk_tree():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) & np.uint64(0xFFFF))
    tree = simhash_dedup.BKTree(values)
    for radius in (0, 3, 6):
        found = sorted((int(p), int(q)) for a, b in tree.within(values[:50], radius) for p, q in zip(a, b))
        assert found == sorted((i, j) for i in range(50) for j in range(len(values)) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius)


def test_quality(spark, docs, odd, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet")
    many = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    out = {r.doc_id: r for r in quality_qda.score_documents(many, labels).collect()}
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out}
    good = [out[i].predicted for i, q in known.items() if q == 1]
    bad = [out[i].predicted for i, q in known.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05
    assert quality_qda.score_documents(odd, labels).count() == len(ODD)
    assert {r.score for r in quality_qda.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_qda.score_documents(odd.limit(0), labels).count() == 0
    kept = quality_qda.keep_good(many, labels)
    assert kept.columns == many.columns and kept.count() == sum(r.predicted for r in out.values())
    assert quality_qda.keep_good(odd, labels).columns == odd.columns


def test_quality_by_plain_formulas(spark, odd, sf_dir):
    """Scores again from the statistics: class covariances shrunken, densities by determinant and solve."""
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    extra = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("score", F.lit("a")).withColumn("x", F.lit("b"))
    frame = docs.withColumn("score", F.lit("a")).withColumn("x", F.lit("b")).unionByName(extra.withColumn("doc_id", -F.col("doc_id")))
    rows = [(r.doc_id, np.array(quality_qda.statistics(r.text))) for r in frame.collect()]
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    seen = [(known[i], x) for i, x in rows if i in known and known[i] in (0, 1)]
    y, x = np.array([a for a, _ in seen]), np.stack([b for _, b in seen])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-5] = 1
    z = (x - centre) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(covs)) / len(y)
    density = []
    for k in (0, 1):
        c = (1 - quality_qda.SHRINK_POOLED) * covs[k] + quality_qda.SHRINK_POOLED * pooled
        c = (1 - quality_qda.SHRINK_IDENTITY) * c + quality_qda.SHRINK_IDENTITY * np.trace(c) / len(c) * np.eye(len(c))
        d = np.clip((np.stack([v for _, v in rows]) - centre) / scale, -8, 8) - z[y == k].mean(axis=0)
        density.append(np.log(((y == k).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d * np.linalg.solve(c, d.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    got = quality_qda.score_documents(frame, labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(float(s), 6)) for (i, _), s in zip(rows, want))
    kept = quality_qda.keep_good(frame, labels)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
