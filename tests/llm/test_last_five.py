"""Operators 6 to 10 against brute force, and their defined results for odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociflow.llm import hilbert_shards, license_scan, mixing, packing, url_rules
from lociflow.llm.queries import vocabulary

from test_first_five import DOCS, ODD

JSON, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


# 6 licence scans


def test_license_scan(spark, docs, odd):
    rows = {r.doc_id: r for r in license_scan.scan_documents(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        want = {f for line in t.split("\n") for f, n in {"GPL-3.0": "GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "Proprietary": "All rights reserved."}.items() if n in line}
        assert set(rows[i].families) == want
        for f in rows[i].findings:
            assert "icense" in t[f.start : f.end] or t[f.start : f.end] == "All rights reserved"
    assert license_scan.scan_documents(odd).count() == len(ODD)
    assert license_scan.scan_documents(odd.limit(0)).count() == 0


def test_scanner_families_and_prose():
    scanner = license_scan.train(["the quick brown fox jumps over the lazy dog and is not licensed to do so in public"] * 30)
    for family, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert [x[2] for x in scanner.scan("some words go before it\n" + t + "\nand after")] == [family], t
    assert not scanner.scan("The general public may obtain a copy of the software under the terms.\nA license version 2 of work.\nmit apache gnu")
    long = "word " * 50_000 + "Released under the MIT License. " + "word " * 50_000
    assert [x[2] for x in scanner.scan(long)] == ["MIT"] and scanner.scan(None) == [] and scanner.scan("") == []


# 7 URL filters


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_judge(urls):
    def rule(h, p):
        fits = [(len(a + b), a + b, v) for a, b, v in url_rules.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits)[1:] if fits else (None, None)

    def items(h, p):
        return {"h:" + re.sub("[0-9]+", "0", x) for x in h.split(".") if x} | {"p:" + re.sub("[0-9]+", "0", x) for x in p.split("/") if x}

    parsed = [(i, *plain_parse(u)) for i, u in urls]
    labelled = [(items(h, p), rule(h, p)[1]) for _, h, p in parsed if rule(h, p)[0] and items(h, p)]
    counts, both = Counter(), Counter()
    for its, v in labelled:
        for n in (1, 2):
            for c in itertools.combinations(sorted(its), n):
                counts[c] += 1
                both[c, v] += 1
    least = max(url_rules.MIN_SUPPORT * len(labelled), url_rules.LEAST_PAGES)
    mined = [(both[c, v] / counts[c], both[c, v] / len(labelled), v, c) for c, v in both if both[c, v] >= math.ceil(least) and both[c, v] / counts[c] >= url_rules.MIN_CONFIDENCE]
    out = []
    for i, h, p in parsed:
        r, v = rule(h, p)
        if r is None:
            fits = [m for m in mined if set(m[3]) <= items(h, p)]
            v = max(fits)[2] if fits else url_rules.DEFAULT
        out.append((str(i), h, p, r, v))
    return sorted(out, key=str)


def test_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url")
    odd = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/x?y#z"), (None, "http://a.net/fr/"), (7, "http://anet/fr/"), (7, "http://com/"), (8, "http://x.com"), (9, "http://x.org/a://b.com/"), (10, "http://ÉA.org/ é/%20/12/3a4"), (11, "x" * 200_000 + "://h.net/es/" + "y/" * 50_000)]
    wide = spark.createDataFrame([(i, u, "v", "h") for i, u in odd], "page_id long, url string, verdict string, host string")
    for frame in (pages, wide):
        want = plain_judge([(r.page_id, r.url) for r in frame.collect()])
        assert sorted(((str(r[0]), *r[1:]) for r in url_rules.judge(frame).collect()), key=str) == want
    assert url_rules.judge(wide.limit(0)).count() == 0


def test_long_equal_urls(spark):
    """Labelled URLs of many segments, equal and with parts in common, and unlisted ones with some of their items."""
    rng = random.Random(4)
    part = lambda k, n: "/".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for i in range(n))
    urls = ["http://q.net/es/" + part("u", 120)] * 12 + ["http://r.com/" + part("v", 40)] * 9
    urls += ["http://s.com/" + "/".join(rng.sample(part("w", 25).split("/"), 14)) for _ in range(60)] + ["http://t.net/fr/" + "/".join(rng.sample(part("w", 25).split("/"), 12)) for _ in range(60)]
    urls += ["http://x.org/" + "/".join(rng.sample(part("u", 120).split("/") + part("v", 40).split("/") + part("w", 25).split("/"), k)) for k in range(1, 60)] + ["http://y.org/none"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(((str(r[0]), *r[1:]) for r in url_rules.judge(frame).collect()), key=str)
    assert got == plain_judge(list(enumerate(urls))) and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_very_long_equal_urls(spark):
    """A class of 20,000 items is one item to the miner."""
    urls = ["http://q.net/es/" + "/".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000 % 10]}{'ab'[i // 10000]}" for i in range(20_000))] * 30 + ["http://x.org/akuea", "http://x.org/akueb/z", "http://x.org/z"]
    out = {r.page_id: r.verdict for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [out[i] for i in (0, 30, 31, 32)] == ["block", "block", "block", "allow"]


# 8 packing


def check_packing(frame, tokenizer):
    rows = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in frame.collect()]
    out = packing.pack(frame, JSON, RANKS).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens] += r.length
        mine = [ids for d, ids in rows if d == r.doc_id and len(ids) == r.doc_tokens]
        assert any(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in mine)
    want = Counter()
    for d, ids in rows:
        want[d, len(ids)] += len(ids)
    assert pieces == want
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(sequences) == list(range(len(sequences)))
    starts = defaultdict(list)
    for r in out:
        starts[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for key, spans in starts.items():
        copies = want[key] // key[1]
        covered = Counter()
        for s, n in spans:
            covered[s] += 1
            covered[s + n] -= 1
        run = 0
        for place in sorted(covered):
            run += covered[place]
            assert run == (copies if place < key[1] else 0)
    return padding


def test_packing(spark, docs, odd, tokenizer):
    assert check_packing(docs, tokenizer) == 0
    assert check_packing(odd, tokenizer) == 0
    assert packing.pack(odd.limit(0), JSON, RANKS).count() == 0


def test_packing_uses_patterns(spark):
    rng = random.Random(4)
    demand = Counter()
    for _ in range(60):  # a demand that whole patterns can meet
        cuts = [0, *sorted(rng.sample(range(1, 2048), rng.randrange(1, 5))), 2048]
        for a, b in zip(cuts, cuts[1:]):
            demand[b - a] += rng.randrange(20, 60)
    plan = packing.cutting_stock(demand)
    used = Counter()
    for sizes, times in zip(plan.patterns, plan.times):
        assert sizes.sum() == 2048 and times > 0
        for s in sizes:
            used[int(s)] += times
    assert all(used[s] <= demand.get(s, 0) for s in used)
    assert sum(s * n for s, n in used.items()) > 0.8 * sum(s * n for s, n in demand.items())
    slots = packing.Slots.of(plan)
    taken = set()
    for s, n in demand.items():
        sequence, offset = slots.place(s, np.arange(n))
        for q, o in zip(sequence, offset):
            if q >= 0:
                span = {(int(q), int(o) + i) for i in range(s)}
                assert not span & taken
                taken |= span
    assert len(taken) == slots.sequences * 2048
    assert packing.cutting_stock({}).patterns == [] and packing.cutting_stock({1024: 5}).times == [2]


def test_encoder_fuzz(tokenizer):
    rng = random.Random(2)
    own = packing.encoder(JSON, RANKS)
    texts = []
    for i in range(4000):
        text = "".join(rng.choice(" \n\t'aéß漢🙂1২.,!s\xa0\x1c\u2028  xyz x") for _ in range(rng.randrange(50)))
        texts.append(text + "<|endoftext|> x" if i % 50 == 0 else re.sub(r"\s+", " ", text).strip() if i % 2 else text)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


# 9 sharding


def test_hilbert_curve():
    for n, bits in ((2, 3), (3, 4), (4, 2)):
        cells = {hilbert_shards.hilbert_index(p, bits): p for p in itertools.product(range(1 << bits), repeat=n)}
        assert sorted(cells) == list(range(1 << bits * n))
        assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(len(cells) - 1))


def test_sharding(spark, docs, odd, tmp_path):
    for frame in (docs, odd):
        rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in frame.collect()]
        out = hilbert_shards.assign(frame).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(rows, key=str)
        by, slots = Counter(), defaultdict(list)
        for r in out:
            by[r.shard] += r.size
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(by.values()) <= sum(s for _, s, _ in rows) / 16 + max(s for _, s, _ in rows)
    assert hilbert_shards.assign(odd.limit(0)).count() == 0
    for folder, frame in (("odd", odd), ("clash", docs.select("*", F.col("source").alias("shard"), F.col("doc_id").alias("slot"), F.col("doc_id").alias("rid")))):
        where = hilbert_shards.write_shards(frame, str(tmp_path / folder))
        back = spark.read.parquet(str(tmp_path / folder))
        assert sorted(map(str, back.select(*frame.columns).collect())) == sorted(map(str, frame.collect()))
        assert set(back.columns) - set(frame.columns) == {"shard_" if "shard" in frame.columns else "shard"} and where.count() == frame.count()
    hilbert_shards.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r.doc_id for r in back.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_equal_texts_and_long_values(spark, docs):
    """No other text stands between equal texts of a language and source; sources that differ late are ranked apart."""
    copies = spark.createDataFrame([(10_000 + i, f"copy {i % 3}", "en", "s" * 70 + "ab"[i % 2], 6) for i in range(600)], docs.schema)
    frame = docs.unionByName(copies)
    place = {r.doc_id: (r.shard, r.slot) for r in hilbert_shards.assign(frame).collect()}
    order = sorted(frame.collect(), key=lambda r: place[r.doc_id])
    spans = defaultdict(list)
    for i, r in enumerate(order):
        spans[r.lang, r.source, r.text].append(i)
    assert all(order[i].text == k[2] for k, at in spans.items() for i in range(at[0], at[-1]))
    assert max(map(len, spans.values())) == 100
    ranks = {r.source_value: r.source_code for r in hilbert_shards.codes(frame.withColumn("size", F.lit(1)), "source").collect()}
    assert ranks["s" * 70 + "a"] < ranks["s" * 70 + "b"]
    values = sorted((v for v in ranks if v is not None))
    assert [ranks[v] for v in values] == sorted(ranks[v] for v in values)


def test_files_are_skipped_by_footers(spark, tmp_path):
    """Of files cut along the curve, footers let a filter on any one dimension skip many; of files in doc_id order, few."""
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    hilbert_shards.write_shards(docs, str(tmp_path / "curve"), shards=32)
    docs.repartitionByRange(32, "doc_id").write.parquet(str(tmp_path / "plain"))

    def read(folder, column, value):
        """Share of the files whose footers don't rule the value out."""
        files = sorted((tmp_path / folder).rglob("*.parquet"))
        hit = 0
        for f in files:
            groups = pq.ParquetFile(f).metadata
            stats = [groups.row_group(g).column(groups.schema.names.index(column)).statistics for g in range(groups.num_row_groups)]
            hit += any(s is None or not s.has_min_max or s.min <= value <= s.max for s in stats)
        return hit / len(files)

    rows = docs.select("lang", "source", "n_chars").collect()
    for column, most in (("lang", 0.75), ("source", 0.75), ("n_chars", 0.75)):
        values = sorted({r[column] for r in rows if r[column] is not None})
        some = values[:: max(1, len(values) // 20)]
        mean = {folder: sum(read(folder, column, v) for v in some) / len(some) for folder in ("curve", "plain")}
        print(column, mean)
        assert mean["curve"] < most * mean["plain"]


# 10 mixing


def plain_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [k for k in names if k not in stopped]
        left = total - sum(stopped.values())
        out = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = [k for k in open_ if out[k] > 3 * sizes[k]]
        if not over:
            return out | stopped
        stopped |= {k: 3 * sizes[k] for k in over}


def test_mixing(spark, docs, odd):
    extra = spark.createDataFrame([(100, "one two three", "en", "\ue000", 1, "a", "b"), (101, "x " * 5, "en", "\U0001f600", 1, "a", "b"), (102, " \n", None, "empty", 0, None, None)], DOCS)
    for frame, block in ((docs, 256), (docs, 16), (odd.unionByName(extra), 256), (odd.unionByName(extra), 4)):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in frame.collect()]
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        want = plain_targets(sizes)
        out = mixing.mix_counts(frame, block=block).collect()
        assert sorted(((r.doc_id, r["size"], r.source_size) for r in out), key=str) == sorted(((d, n, sizes[s]) for d, s, n in rows), key=str)
        of = {(d, n): s for d, s, n in rows}
        taken = Counter()
        for r in out:
            s = of[r.doc_id, r["size"]]
            assert abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
            taken[s] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        assert sorted(map(str, mixing.mix_counts(frame, block=block).collect())) == sorted(map(str, out))
    assert mixing.mix_counts(odd.limit(0)).count() == 0


def long_hash(*values):
    """What the engine's 64-bit hash gives for longs (and, in a tuple of one, an int): each seeds the next."""
    h = 42
    for v in values:
        raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (h >> 63 << 64)


def plain_permuted(x, n, *key):
    for r in range(1, mixing.ROUNDS + 1) if n > 1 else ():
        other = (long_hash((mixing.SEED,), *key, (r,)) - x) % n
        if long_hash((mixing.SEED + 1,), *key, (r,), max(x, other)) % 2:
            x = other
    return x


def plain_mix(rows, block, shard):
    """Of rows (source, size) in order, what each slot takes: {(row number, out_shard, out_slot): (at, n)}."""
    names = sorted({s for s, _ in rows if s is not None}, key=lambda x: [ord(c) for c in x]) + [None] * any(s is None for s, _ in rows)
    sizes = {s: sum(n for t, n in rows if t == s) for s in names}
    want = plain_targets(sizes)
    sources = []
    for sid, s in enumerate(names):
        words = math.floor(want[s] + 0.5)
        if sizes[s]:
            passes, rest = divmod(words, sizes[s])
            blocks = -(-sizes[s] // block)
            n = passes * blocks + -(-rest // block)
            sources.append((sid, s, passes, rest, blocks, n))
    every = sum(x[-1] for x in sources)
    owner = [sid for sid, *_, n in sources for _ in range(n)]
    drawn = defaultdict(lambda: defaultdict(int))
    for i in range(every):
        drawn[i // shard][owner[long_hash((mixing.SEED + 2,), i) % every]] += 1
    total = {x[0]: sum(d[x[0]] for d in drawn.values()) for x in sources}
    open_ = [(sid, j) for sid, *_, n in sources for j in range(total[sid], n)]
    over_before, so_far = {}, 0
    for sid, *_, n in sources:
        over_before[sid] = so_far
        so_far += max(0, total[sid] - n)
    of = {x[0]: x for x in sources}
    line, slots = Counter(), {}
    for k in sorted(drawn):
        slot = 0
        for sid in sorted(drawn[k]):
            for _ in range(drawn[k][sid]):
                j = plain_permuted(line[sid], total[sid], (-2,), (sid,))
                n = of[sid][-1]
                slots[k, plain_permuted(slot, min(shard, every - k * shard), (-1,), k)] = (sid, j) if j < n else open_[j - n + over_before[sid]]
                line[sid] += 1
                slot += 1
    start, stretches = Counter(), defaultdict(list)
    for i, (s, n) in enumerate(rows):
        for b in range(start[s] // block, -(-(start[s] + n) // block)) if n else ():
            low, high = max(start[s], b * block), min(start[s] + n, (b + 1) * block)
            stretches[s, b].append((i, low - start[s], low - b * block, high - low))
        start[s] += n
    out = {}
    for (k, slot), (sid, j) in slots.items():
        _, s, passes, rest, blocks, _ = of[sid]
        turn = min(j // blocks, passes)
        rank, whole = j - turn * blocks, sizes[s] // block
        b = plain_permuted(rank, whole, (sid,), turn) if rank < whole else rank
        most = rest % block if turn == passes and rank == rest // block else block
        for i, at, inside, n in stretches[s, b]:
            if min(n, most - inside) > 0:
                out[i, k, slot] = (at, min(n, most - inside))
    return out


def test_every_slot(spark, docs, odd):
    """Draws, permutations, blocks and words of the whole mix, made again in plain Python."""
    extra = spark.createDataFrame([(100 + i, f"word{i} " * (7 * i % 90), "en", "bcd"[i % 3], 1, "a", "b") for i in range(60)], DOCS)
    for frame, block in ((docs, 16), (odd.where("doc_id <> 6 or doc_id is null").unionByName(extra), 4)):
        rows = [(r.rid, r.source, r["size"]) for r in mixing.numbered(frame.coalesce(1)).orderBy("rid").collect()]
        want = plain_mix([r[1:] for r in rows], block, mixing.SHARD)
        got = {}
        for r in mixing.mix_counts(frame.coalesce(1), block=block).collect():
            for p in r.places:
                got[r.doc_id, r["size"], p.out_shard, p.out_slot, p.at] = p.n
            assert r.taken == sum(p.n for p in r.places)
        ids = [r.doc_id for r in frame.coalesce(1).collect()]
        assert got == {(ids[i], rows[i][2], k, slot, at): n for (i, k, slot), (at, n) in want.items()}
        assert block == 4 or len({k for _, k, _ in want}) > 1


def test_mixed_rows_stand_by_slot(spark, docs):
    """Rows of one output shard are in one partition, in the order of the first slot that holds their words."""
    first, takes = defaultdict(dict), Counter()
    for r in mixing.mix_counts(docs, block=16).collect():
        takes[r.doc_id] = -(-r.taken // max(r["size"], 1))
        first[r.doc_id] = sorted((p.out_shard, p.out_slot) for p in r.places)
    rows = mixing.mix_documents(docs, block=16).select("doc_id", F.spark_partition_id().alias("part")).collect()
    once = [(r.part, first[r.doc_id][0]) for r in rows if takes[r.doc_id] == 1]
    place = defaultdict(set)
    for part, (shard, _) in once:
        place[shard].add(part)
    assert len(once) > 30 and all(len(p) == 1 for p in place.values())
    for part in {p for p, _ in once}:
        slots = [s for p, s in once if p == part]
        assert slots == sorted(slots)


def test_permutation_and_slots(spark):
    for n in (1, 2, 3, 17, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
        assert n < 1000 or sum(a.p == b for b, a in enumerate(got)) < 20
    sources = mixing.targets(spark.createDataFrame([("a", 100_000), ("b", 40_000), (None, 30)], "source string, source_size long"))
    slots = mixing.slots(sources, block=16).collect()
    assert sorted((r.out_shard * mixing.SHARD + r.out_slot) for r in slots) == list(range(len(slots)))
    whole = Counter(r.sid for r in slots)
    # the draw of a shard is multinomial: every count within six deviations, and their spread as such a law has it
    counts = mixing.draws(mixing.places(sources, 16), 64).collect()
    scores = [(r.drawn - 64 * whole[r.sid] / len(slots)) ** 2 / (64 * whole[r.sid] / len(slots) * (1 - whole[r.sid] / len(slots))) for r in counts if (r.out_shard + 1) * 64 <= len(slots) and whole[r.sid] > 1000]
    assert max(scores) < 36 and 0.8 < sum(scores) / len(scores) < 1.2 and len(scores) > 200
    # totals are exact: each source's places, once each
    for sid, size in enumerate((100_000, 40_000, 30)):
        words = next(r.words for r in sources.collect() if r.sid == sid)
        assert whole[sid] == words // size * -(-size // 16) + -(-(words % size) // 16)
        assert max(Counter((r["pass"], r.block) for r in slots if r.sid == sid).values()) == 1


def test_mixed_documents(spark, docs, odd):
    for frame in (docs, odd):
        counts = Counter()
        for r in mixing.mix_counts(frame, block=32).collect():
            counts[r.doc_id] += r.taken
        mixed = mixing.mix_documents(frame, block=32)
        assert mixed.columns == frame.columns and mixed.dtypes == frame.dtypes
        texts = defaultdict(set)
        for r in frame.collect():
            texts[r.doc_id].add(r.text)
        got = Counter()
        for r in mixed.collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
            got[r.doc_id] += len(words)
            assert r.n_chars == len(r.text)
            assert r.text in texts[r.doc_id] or not Counter(words) - Counter(w for t in texts[r.doc_id] for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert +got == +counts
