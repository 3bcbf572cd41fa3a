"""Relationship matrices as pairs grm(i, j, n, value) with j <= i, and what is derived from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.plans.storage import keep, place
from lociflow.sources.files import located

#: Individuals of a tile of the matrix, markers of a block, blocks that a task holds of a pair of tiles (8 MB each), and
#: cells that it gathers at once.
TILE, MARKERS, BLOCKS, CELLS = 512, 1024, 16, 1 << 21


#: Individuals of a tile at most, and blocks whose runs a task holds of a pair of tiles, of products by codes. Up to SMALL,
#: tiles are those of TILE.
LARGE, SMALL, HELD = 2048, 4096, 128
#: Markers whose frequencies are broadcast.
BROADCAST = 1 << 20
#: Types of dosages, which aren't whole.
FRACTIONS = ("double", "float", "decimal")


def pair_products(x: DataFrame, *by: str, of: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(i, j, n, s) over rows x(iid, sid, x): markers that both have, and the sum of products, by tiles of the matrix.
    With columns `by` of the markers, those of each of their values apart. Missing values (null) count neither in n nor
    in s.

    Tasks gather their cells to packed runs for each marker block and individual tile, before any shuffle; the runs go to
    each pair of tiles that theirs is in. A task adds up the matrix products of a pair's blocks and returns two arrays;
    these are added by pair, and only then made rows. So the shuffles hold each value once for each tile of individuals
    (12 bytes) and each entry once for every BLOCKS blocks (or more often, where pairs are fewer than the cores): no row
    is made for a pair of individuals and a block. of: a table (iid, sid) that x comes from, from which the tiles are
    told without x's own steps. weight: a column with a number of the marker, whose sum over the markers that both have
    comes as w, from the same tasks, as matrices of all pairs are not to be joined. Where all of a pair of tiles is in one
    task, its rows come from that task.
    """
    more = [weight] if weight else []
    cells = x.where("x is not null").select(F.col("iid").cast("long").alias("iid"), F.col("sid").cast("long").alias("sid"), F.col("x").cast("double").alias("x"), *[F.col(c).cast("double").alias("w") for c in more], *by)
    # one row for each tile, TILE times fewer than the individuals
    known = (x if of is None else of).groupBy((F.col("iid") / TILE).cast("long").alias("t")).agg(F.max("iid").alias("i"), F.max("sid").alias("m")).collect()
    sums = ["s", "w"] if weight else ["s"]
    schema = "".join(f"{c} {x.schema[c].dataType.simpleString()}, " for c in by) + "i long, j long, n long, " + ", ".join(f"{c} double" for c in sums)
    if not known:
        return x.sparkSession.createDataFrame([], schema)
    blocks = max(r.m for r in known) // MARKERS + 1
    # many individuals with few markers: larger tiles, so that the runs go to fewer of them
    tile = TILE if blocks > 2 or max(r.i for r in known) < SMALL else LARGE
    tiles = sorted({r.t * TILE // tile for r in known})
    pairs = len(tiles) * (len(tiles) + 1) // 2
    parts = max(-(-blocks // BLOCKS), min(blocks, -(-2 * x.sparkSession.sparkContext.defaultParallelism // pairs)))
    kinds = "".join(f"{c} {x.schema[c].dataType.simpleString()}, " for c in by)
    names = ["x", "w"] if weight else ["x"]

    def runs(table: pa.Table) -> pa.RecordBatch:
        iid, sid, x = (table[c].to_numpy() for c in ("iid", "sid", "x"))
        b, t = sid // MARKERS, iid // tile
        of, values = np.zeros(len(x), np.int64), [()]
        if by:
            coded = pd.MultiIndex.from_arrays([table[c].to_pylist() for c in by])
            of, values = coded.factorize()
        order = np.lexsort((t, b, of))
        at = ((iid - t * tile) * MARKERS + sid - b * MARKERS).astype(np.int32)[order]
        b, t, of, x = b[order], t[order], of[order], x[order]
        more = [table["w"].to_numpy()[order]] if weight else []
        starts = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (of[1:] != of[:-1]))))
        ends = [*starts[1:], len(x)]
        named = [pa.array([values[k][i] for k in of[starts]], table[c].type) for i, c in enumerate(by)]
        cut = lambda v: pa.array([v[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(b[starts]), pa.array(t[starts]), *named, cut(at), cut(x), *map(cut, more)], ["b", "t", *by, "at", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CELLS:
                yield runs(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield runs(pa.Table.from_batches(held))

    packed = cells.mapInArrow(pack, f"b long, t long, {kinds}at binary, " + ", ".join(f"{c} binary" for c in names))
    all_ = F.array(*[F.lit(t).cast("long") for t in tiles])
    as_first = F.transform(F.filter(all_, lambda u: u <= F.col("t")), lambda u: F.struct(F.col("t").alias("t"), u.alias("u"), F.lit(0).alias("side")))
    as_second = F.transform(F.filter(all_, lambda u: u > F.col("t")), lambda u: F.struct(u.alias("t"), F.col("t").alias("u"), F.lit(1).alias("side")))
    sides = packed.select("b", *by, "at", *names, F.explode(F.concat(as_first, as_second)).alias("k")).select("b", (F.col("b") % parts).alias("part"), "k.t", "k.u", "k.side", *by, "at", *names)

    def products(t: int, u: int, batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        n, *out = (np.zeros((tile, tile)) for _ in range(1 + len(sums)))
        dense: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, side, at, x, *w in zip(*(batch.column(c).to_pylist() for c in ("b", "side", "at", *names))):
                if (b, side) not in dense:
                    dense[b, side] = np.full(tile * MARKERS, np.nan), np.zeros(MARKERS)
                at = np.frombuffer(at, np.int32)
                dense[b, side][0][at] = np.frombuffer(x)
                for v in w:
                    dense[b, side][1][at % MARKERS] = np.frombuffer(v)
        for b in {b for b, _ in dense}:
            pair = [dense.get((b, side)) for side in ((0, 0) if t == u else (0, 1))]
            if pair[0] is None or pair[1] is None:
                continue
            have = [~np.isnan(p).reshape(tile, MARKERS) for p, _ in pair]
            width = int(np.flatnonzero(have[0].any(axis=0))[-1]) + 1  # what stands beyond is nobody's
            have = [h[:, :width] for h in have]
            value = [np.where(h, p.reshape(tile, MARKERS)[:, :width], 0) for h, (p, _) in zip(have, pair)]
            have = [h.astype(np.float32) for h in have]
            out[0] += value[0] @ value[1].T
            n += have[0] @ have[1].T
            if weight:
                out[1] += (have[0] * pair[0][1][:width]) @ have[1].T.astype(np.float64)
        return [n.astype(np.int64), *out]

    def entries(of: list, t: int, u: int, n: np.ndarray, *out: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, tile, 64):
            i, j = np.nonzero(n[at : at + 64])
            i += at
            lower = i + t * tile >= j + u * tile
            i, j = i[lower], j[lower]
            if len(i):
                yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()] * len(i), k.type) for k in of], pa.array(i + t * tile), pa.array(j + u * tile), pa.array(n[i, j]), *[pa.array(v[i, j]) for v in out]], [*by, "i", "j", "n", *sums])

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, u = key[1].as_py(), key[2].as_py()
        yield from entries(list(key[3:]), t, u, *products(t, u, batches))

    def product(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, u = key[1].as_py(), key[2].as_py()
        found = products(t, u, batches)
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([u]), *[pa.array([k.as_py()], k.type) for k in key[3:]], *[pa.array([v.tobytes()], pa.binary()) for v in found]], ["t", "u", *by, "n", *sums])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, u = key[0].as_py(), key[1].as_py()
        found = [np.zeros((tile, tile), np.int64), *(np.zeros((tile, tile)) for _ in sums)]
        for batch in batches:
            for v, c in zip(found, ("n", *sums)):
                for a in batch.column(c).to_pylist():
                    v += np.frombuffer(a, v.dtype).reshape(tile, tile)
        yield from entries(list(key[2:]), t, u, *found)

    grouped = sides.groupBy("part", "t", "u", *by)
    if parts == 1:
        return grouped.applyInArrow(whole, schema)
    kept = grouped.applyInArrow(product, f"t long, u long, {kinds}n binary, " + ", ".join(f"{c} binary" for c in sums))
    return kept.groupBy("t", "u", *by).applyInArrow(add, schema)


class Codes:
    """cells(iid, sid, code), codes from 0 and under `size`, packed once and kept: products and counts read the runs.

    Tasks pack their cells, without a shuffle, to runs of codes by block and tile, of 2, 4 or 8 bits a cell. A run holds
    what differs from the marker before, compressed, as neighbours are often alike. Runs are written once to the shared
    folder, under the group of blocks and the tile that they are of, and each pair of tiles reads those of its two: however
    many pairs a tile is in, the disk holds its runs once. Null codes are missing.
    """

    def __init__(self, cells: DataFrame, size: int):
        if size > 255:
            raise ValueError("over 255 codes")
        self.spark, self.size = cells.sparkSession, size
        self.bits = 2 if size < 4 else 4 if size < 16 else 8
        cells = cells.select(F.col("iid").cast("long").alias("iid"), F.col("sid").cast("long").alias("sid"), F.col("code").cast("short").alias("code"))
        at = lambda c, n, whole, rest: (F.floor(F.col(c) / n).cast("int").alias(whole), F.pmod(F.col(c), F.lit(n)).cast("short").alias(rest))
        packed = cells.where("code is not null").select(*at("sid", MARKERS, "b", "col"), *at("iid", TILE, "t", "row"), "code").mapInArrow(_packer(TILE, size, self.bits), RUN)
        self.runs = _shelved(packed.withColumn("g", F.floor(F.col("b") / HELD)), "g", "t")
        self.files = _shelves(self.runs)
        self.fine = sorted({t for _, t in self.files})

    def tiling(self) -> tuple[int, list[int], int]:
        """Of products: TILEs in a tile, the tiles, and the tasks of a pair, whose sums must be added where they are more
        than one: only where the pairs are fewer than the cores."""
        cores = self.spark.sparkContext.defaultParallelism
        of = lambda times: sorted({t // times for t in self.fine})
        many = lambda times: len(of(times)) * (len(of(times)) + 1) // 2
        times = 1 if (self.fine[-1] + 1) * TILE <= SMALL else LARGE // TILE
        while times > 1 and many(times) < 3 * cores:  # else tasks wait for the last one
            times //= 2
        parts = cores // many(times)
        if parts > 1:
            parts = min(parts, self.runs.agg(F.count_distinct("b")).first()[0])
        return times, of(times), max(1, parts)

    def counts(self) -> DataFrame:
        """(sid, c0, c1...): how many cells of a marker have each code."""
        schema = "sid long, " + ", ".join(f"c{k} long" for k in range(self.size))
        if not self.fine:
            return self.spark.createDataFrame([], schema)
        tile, size, bits, block = TILE, self.size, self.bits, MARKERS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, *run in zip(*(batch.column(c).to_pylist() for c in ("b", "width", "at", "x"))):
                    code = _codes([(0, *run)], tile, tile, bits, block)
                    found = [(code == k + 1).sum(axis=1) for k in range(size)]
                    m = np.flatnonzero(np.any(found, axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array(b * block + m), *[pa.array(c[m].astype(np.int64)) for c in found]], ["sid", *[f"c{k}" for k in range(size)]])

        each = self.runs.select("b", "width", "at", "x").mapInArrow(count, schema)
        return each.groupBy("sid").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(size)])

    def products(self, values: DataFrame, sets: int = 1) -> DataFrame:
        """As coded_products()."""
        columns = ["n", "s"] if sets == 1 else [f"{c}{k}" for k in range(sets) for c in "ns"]
        schema = "i long, j long, " + ", ".join(f"{c} {'long' if c[0] == 'n' else 'double'}" for c in columns)
        if not self.fine:
            return self.spark.createDataFrame([], schema)
        times, tiles, parts = self.tiling()
        each, tile, size, bits, held, block = TILE, TILE * times, self.size, self.bits, HELD, MARKERS
        numbered = [f"v{k}" for k in range(size)] + ["k"] * (sets > 1)

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sid = b.column("sid").to_numpy()
                v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbered])
                for at in np.unique(sid // block):
                    own = sid // block == at
                    yield _batch([(at, -1, 0, (sid[own] - at * block).astype(np.int32).tobytes(), v[own].tobytes())])

        v = values.select(F.col("sid").cast("long").alias("sid"), *[F.get("v", F.lit(k)).cast("double").alias(f"v{k}") for k in range(size)], *[F.col("k").cast("int")] * (sets > 1)).mapInArrow(numbers, RUN)
        tables = _shelves(_shelved(v.withColumn("g", F.floor(F.col("b") / held)), "g", "t"))
        files, groups = self.files, sorted({g for g, _ in self.files})
        # the pairs of two tiles take longest
        todo = sorted(((t, u, part) for t in tiles for u in tiles if u <= t for part in range(parts)), key=lambda k: k[0] == k[1])

        def sums(t: int, u: int, part: int) -> tuple[np.ndarray, np.ndarray]:
            n, s = np.zeros((sets, tile, tile), np.float32), np.zeros((sets, tile, tile))
            more, seen = np.zeros((sets, tile, tile), np.int64), 0
            for g in groups:
                rows: dict[int, tuple[list, list, list]] = {}
                of_tile = lambda t: [(k, f) for k in range(times) for f in files.get((g, t * times + k), [])]  # noqa: B023, E731
                for side, found in enumerate((of_tile(t), of_tile(u) if t != u else [], [(0, f) for f in tables.get((g, -1), [])])):
                    for k, f in found:
                        for b, *run in _read(f):
                            if b % parts == part:
                                rows.setdefault(b, ([], [], []))[side].append((k, *run))
                for first, second, table in rows.values():
                    if not first or not (second or t == u):
                        continue
                    number, of = np.full((block, size + 1), np.nan), np.zeros(block, np.int64)
                    for _, _, at, x in table:
                        at, x = np.frombuffer(at, np.int32), np.frombuffer(x).reshape(-1, len(numbered))
                        number[at, 1:] = x[:, :size]
                        if sets > 1:
                            of[at] = x[:, size]
                    there = ~np.isnan(number)
                    value, have = [], []
                    for runs in (first, second)[: 1 + (t != u)]:
                        place = _codes(runs, each, tile, bits, block) + np.arange(0, number.size, size + 1, dtype=np.int32)[:, None]
                        value.append(np.where(there, number, 0).ravel()[place])
                        have.append(there.astype(np.float32).ravel()[place])
                    for q in range(sets):
                        own = np.flatnonzero(of == q) if sets > 1 else slice(None)
                        s[q] += value[0][own].T @ value[-1][own]
                        n[q] += have[0][own].T @ have[-1][own]
                    seen += 1
                    if seen % 1024 == 0:  # a million markers, which single precision still counts exactly
                        more += n.astype(np.int64)
                        n[:] = 0
            return more + n.astype(np.int64), s

        def entries(t: int, u: int, n: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, tile, 64):
                i, j = np.nonzero(n[:, at : at + 64].any(axis=0))
                i += at
                lower = i + t * tile >= j + u * tile
                i, j = i[lower], j[lower]
                if len(i):
                    both = [pa.array(x[i, j].astype(k)) for q in range(sets) for x, k in ((n[q], np.int64), (s[q], np.float64))]
                    yield pa.RecordBatch.from_arrays([pa.array(i + t * tile), pa.array(j + u * tile), *both], ["i", "j", *columns])

        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    yield todo[k]

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, u, part in mine(batches):
                yield from entries(t, u, *sums(t, u, part))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, u, part in mine(batches):
                n, s = sums(t, u, part)
                for q in range(sets):
                    for at in range(0, tile, 256):  # a few MB a row, and none for individuals that aren't there
                        if n[q, at : at + 256].any():
                            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([u], pa.int32()), pa.array([q]), pa.array([at]), pa.array([n[q, at : at + 256].astype(np.int32).tobytes()], pa.binary()), pa.array([s[q, at : at + 256].tobytes()], pa.binary())], ["t", "u", "q", "at", "n", "s"])

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, u = key[0].as_py(), key[1].as_py()
            n, s = np.zeros((sets, tile, tile), np.int64), np.zeros((sets, tile, tile))
            for b in batches:
                for q, at, x, y in zip(*(b.column(c).to_pylist() for c in ("q", "at", "n", "s"))):
                    n[q, at : at + 256] += np.frombuffer(x, np.int32).reshape(-1, tile)
                    s[q, at : at + 256] += np.frombuffer(y).reshape(-1, tile)
            yield from entries(t, u, n, s)

        tasks = self.spark.range(0, len(todo), 1, len(todo))  # a task for each pair and part
        if parts == 1:
            return tasks.mapInArrow(whole, schema)
        return tasks.mapInArrow(product, "t int, u int, q long, at long, n binary, s binary").groupBy("t", "u").applyInArrow(add, schema)


RUN = "b int, t int, width int, at binary, x binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["b", "t", "width", "at", "x"])


def _packer(tile: int, size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (b, t, row, col, code) to runs."""
    each, wide, most = 8 // bits, MARKERS, CELLS

    def folded(dense: np.ndarray) -> bytes:
        out = dense[:, ::each].copy()
        for e in range(1, each):
            out |= dense[:, e::each] << (bits * e)
        out[1:] ^= out[:-1].copy()
        return pa.compress(out.tobytes(), "zstd", asbytes=True)

    def runs(table: pa.Table) -> Iterator[tuple]:
        block, tile_, row, column, code = (table[c].to_numpy() for c in ("b", "t", "row", "col", "code"))
        if code.min() < 0 or code.max() >= size:
            raise ValueError("a code without a number")
        code = (code + 1).astype(np.uint8)
        if (block[1:] < block[:-1]).any():
            order = np.argsort(block, kind="stable")
            block, tile_, row, column, code = (x[order] for x in (block, tile_, row, column, code))
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for start, end in zip(edges, edges[1:]):
            b, t, r, m, x = block[start], tile_[start:end], row[start:end].astype(np.int32), column[start:end].astype(np.int32), code[start:end]
            there = np.zeros(wide, bool)
            there[m] = True
            markers, first = np.flatnonzero(there).astype(np.int32), int(t.min())
            span = (int(t.max()) - first + 1) * tile
            line = (np.cumsum(there) - 1)[m]
            if span * len(markers) * bits <= 40 * len(x):  # most of the cells are there
                dense = np.zeros((len(markers), span), np.uint8)
                dense[line, (t - first) * tile + r] = x
                for k in range(span // tile):
                    own = dense[:, k * tile : (k + 1) * tile]
                    some = np.flatnonzero(own.any(axis=0))
                    if len(some):
                        own = own[:, : -(-(int(some[-1]) + 1) // each) * each]
                        yield b, first + k, own.shape[1] // each, markers.tobytes(), folded(own)
                continue
            for u in pd.unique(t):
                k = np.flatnonzero(t == u)
                height = int(r[k].max()) + 1
                some = np.unique(line[k])
                if height * len(some) * bits > 40 * len(k):  # few of the run's cells are there
                    yield b, u, 0, (r[k] * wide + m[k]).tobytes(), x[k].tobytes()
                    continue
                dense = np.zeros((len(some), -(-height // each) * each), np.uint8)
                dense[np.searchsorted(some, line[k]), r[k]] = x[k]
                yield b, u, dense.shape[1] // each, markers[some].tobytes(), folded(dense)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                yield _batch(list(runs(pa.Table.from_batches(held))))
                held, rows = [], 0
        if rows:
            yield _batch(list(runs(pa.Table.from_batches(held))))

    return pack


def _codes(runs: list[tuple], tile: int, wide: int, bits: int, block: int) -> np.ndarray:
    """Codes plus 1 (markers, individuals) of a block's runs (k, width, at, x), of the k-th of the `wide` individuals' tiles;
    0 is missing."""
    code, each = np.zeros((block, wide), np.uint8), 8 // bits
    for k, width, at, x in runs:
        at, own = np.frombuffer(at, np.int32), code[:, k * tile : (k + 1) * tile]
        if not width:
            own[at % block, at // block] = np.frombuffer(x, np.uint8)
            continue
        x = np.frombuffer(pa.decompress(x, len(at) * width, "zstd"), np.uint8).reshape(len(at), width)
        x = np.bitwise_xor.accumulate(x, axis=0)
        some = np.zeros((len(at), width * each), np.uint8)
        for e in range(each):
            some[:, e::each] = (x >> (bits * e)) & ((1 << bits) - 1)
        have = np.zeros((len(at), tile), np.uint8)
        have[:, : min(tile, some.shape[1])] = some[:, :tile]
        own[at] |= have  # another task's run may hold others of these markers' cells
    return code


def _shelved(runs: DataFrame, *by: str) -> DataFrame:
    """Runs, compressed already, kept in a folder for each value of `by`."""
    path = place(runs.sparkSession, "tables")
    runs.write.partitionBy(*by).option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return runs.sparkSession.read.schema(runs.schema).parquet(path)


def _shelves(runs: DataFrame) -> dict[tuple[int, int], list[str]]:
    found: dict[tuple[int, int], list[str]] = {}
    for f in runs.inputFiles():
        g, t = re.search(r"/g=(-?\d+)/t=(-?\d+)/", f).groups()
        found.setdefault((int(g), int(t)), []).append(f)
    return found


def _read(file: str) -> Iterator[tuple]:
    """(b, width, at, x) of the file's rows."""
    system, path = located(file)
    with system.open_input_file(path) as source:
        table = pq.read_table(source, columns=["b", "width", "at", "x"])
    return zip(*(table[c].to_pylist() for c in ("b", "width", "at", "x")))


def coded_products(cells: DataFrame, values: DataFrame, size: int, sets: int = 1) -> DataFrame:
    """(i, j, n, s) as of pair_products, of cells(iid, sid, code) whose number is the one that values(sid, v) has at the
    code (from 0, under `size`) in its array v. Null codes, null numbers and markers without values are missing.

    A pair of tiles has one task, which reads the runs of its two (see Codes) HELD blocks at a time, and its rows come from
    that task. Tiles are larger where individuals are many: a run is read once for each tile. Where the pairs are fewer
    than the cores, blocks are dealt to several tasks, whose sums are added before they become rows.

    With more than one of sets, values has the set of a marker in k (from 0), and the columns are n0, s0, n1, s1...: as
    many matrices from one pass, in one row, so that they need not be joined by pair.
    """
    return Codes(cells, size).products(values, sets)


def variances(g: DataFrame) -> DataFrame:
    """(sid, mu, var = 2pq) of the polymorphic markers of g."""
    return g.groupBy("sid").agg(F.avg("gt").alias("mu")).withColumn("var", F.col("mu") * (1 - F.col("mu") / 2)).where("var > 1e-50")


def counted(codes: Codes) -> DataFrame:
    """As variances(), of packed calls, so that g is read once."""
    mu = (F.col("c1") + 2 * F.col("c2")) / (F.col("c0") + F.col("c1") + F.col("c2"))
    return codes.counts().select("sid", mu.alias("mu")).withColumn("var", F.col("mu") * (1 - F.col("mu") / 2)).where("var > 1e-50")


def centred(g: DataFrame) -> DataFrame:
    """g with mu and var = 2pq of each marker, polymorphic ones alone. Up to BROADCAST markers (24 bytes each) their values
    go to g, which isn't shuffled."""
    f = keep(variances(g))
    return g.join(F.broadcast(f) if f.count() <= BROADCAST else f, "sid").where("gt is not null")


def marker_products(g: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """(i, j, n, s) of g(iid, sid, gt) with calls of 0, 1 or 2: products of number(gt), which may use the marker's mu
    and var. Dosages, which aren't whole, go as numbers."""
    if g.schema["gt"].dataType.typeName() in FRACTIONS:
        return pair_products(centred(g).select("iid", "sid", number(F.col("gt")).alias("x")), of=g)
    codes = Codes(g.select("iid", "sid", F.col("gt").alias("code")), 3)
    return codes.products(counted(codes).select("sid", F.array(*[number(F.lit(k)) for k in range(3)]).alias("v")))


def standard(x: Column) -> Column:
    return (x - F.col("mu")) / F.sqrt("var")


def grm(g: DataFrame, algorithm: int = 0) -> DataFrame:
    """Additive matrix: 0: mean of z_i z_j over shared markers; 1: sum of centred products over n * mean(2pq)."""
    if algorithm == 0:
        return marker_products(g, standard).select("i", "j", "n", (F.col("s") / F.col("n")).alias("value"))
    if g.schema["gt"].dataType.typeName() in FRACTIONS:
        f, p = variances(g), marker_products(g, lambda x: x - F.col("mu"))
    else:
        codes = Codes(g.select("iid", "sid", F.col("gt").alias("code")), 3)
        f = keep(counted(codes))  # read twice
        p = codes.products(f.select("sid", F.array(*[F.lit(k) - F.col("mu") for k in range(3)]).alias("v")))
    return p.join(F.broadcast(f.agg(F.avg("var").alias("mean_var")))).select("i", "j", "n", (F.col("s") / F.col("n") / F.col("mean_var")).alias("value"))


def grm_of_sets(g: DataFrame, of: Column, sets: int) -> DataFrame:
    """(i, j, n0, s0, n1, s1...): number and sum of the additive matrix of each set of markers, of(sid) from 0, where any
    set has the pair, from one pass over the calls (0, 1 or 2)."""
    codes = Codes(g.select("iid", "sid", F.col("gt").alias("code")), 3)
    return codes.products(counted(codes).select("sid", F.array(*[standard(F.lit(k)) for k in range(3)]).alias("v"), of.alias("k")), sets)


def grm_sums(g: DataFrame, snp: DataFrame) -> DataFrame:
    """(chr, i, j, n, s): what each chromosome adds to the number and the sum of the additive matrix."""
    x = centred(g).join(snp.select("sid", "chr"), "sid")
    return pair_products(x.select("chr", "iid", "sid", standard(F.col("gt")).alias("x")), "chr", of=g)


def grm_dominance(g: DataFrame) -> DataFrame:
    mu = F.col("mu")
    code = lambda x: F.when(x == 1, mu).when(x == 2, 2 * mu - 2).otherwise(0.0)
    p = marker_products(g, lambda x: (code(x) - mu * mu / 2) / F.col("var"))
    return p.select("i", "j", "n", (F.col("s") / F.col("n")).alias("value"))


def grm_x(g: DataFrame, ind: DataFrame, dosage_compensation: int | None = None) -> DataFrame:
    """Matrix of X markers: a male's z weighs sqrt(1/2), then sqrt(2) under full dosage compensation (1) or sqrt(1/2)
    without (0)."""
    more = {None: 1.0, 1: 2.0**0.5, 0: 0.5**0.5}[dosage_compensation]
    # a weight of the individual is a factor of all its products; a row an individual is broadcast
    w = F.when(F.col("sex") == 1, F.lit(0.5**0.5 * more)).otherwise(1.0)
    side = lambda k: F.broadcast(ind.select(F.col("iid").alias(k), w.alias(f"w{k}")))
    p = marker_products(g, standard).join(side("i"), "i").join(side("j"), "j")
    return p.select("i", "j", "n", (F.col("s") * F.col("wi") * F.col("wj") / F.col("n")).alias("value"))


def grm_inbred(a: DataFrame) -> DataFrame:
    return a.withColumn("value", F.col("value") / 2)


def f3_diagonal(g: DataFrame, a: DataFrame) -> DataFrame:
    """The matrix with 1 + F3 on its diagonal, over the markers that an individual has."""
    x, mu = F.col("gt"), F.col("mu")
    d = centred(g).groupBy("iid").agg((1 + F.avg((x * x - (1 + mu) * x + mu * mu / 2) / F.col("var"))).alias("f3"))
    j = a.join(F.broadcast(d.withColumnRenamed("iid", "i")), "i", "left")  # a row an individual
    return j.select("i", "j", "n", F.when(F.col("i") == F.col("j"), F.col("f3")).otherwise(F.col("value")).alias("value"))


def grm_within(g: DataFrame, ind: DataFrame, population: str = "pop") -> DataFrame:
    """Mean products of calls (0, 1, 2) standardised by marker and population: (gt - mean) / sd (n - 1), 0 where the call is
    missing or constant. As from_standardised() of markers.standardise_within(), but a marker has a mean and an sd for
    each population, which is all that is aggregated, and its codes are (population, call)."""
    pops = sorted((r[0] for r in ind.select(population).distinct().collect()), key=lambda p: (p is None, p))  # a row a population
    if 4 * len(pops) > 255:
        from lociflow.operators.markers import standardise_within

        return from_standardised(standardise_within(g, ind, population))
    place = F.lit(None).cast("int")
    for k, p in enumerate(pops):
        place = F.when(F.col(population).eqNullSafe(F.lit(p)), k).otherwise(place)
    cells = g.join(F.broadcast(ind.select("iid", place.alias("k"))), "iid")  # a row an individual
    own = cells.groupBy("sid", "k").agg(F.avg("gt").alias("m"), F.stddev_samp("gt").alias("s"))
    number = lambda c: F.coalesce(F.when(F.col("s") > 1e-12, (F.lit(c) - F.col("m")) / F.col("s")), F.lit(0.0))
    held = own.groupBy("sid").agg(*[F.first(F.when(F.col("k") == k, F.array(number(0), number(1), number(2), F.lit(0.0))), ignorenulls=True).alias(f"k{k}") for k in range(len(pops))])
    none = F.array(*[F.lit(None).cast("double")] * 4)
    values = held.select("sid", F.concat(*[F.coalesce(f"k{k}", none) for k in range(len(pops))]).alias("v"))
    p = coded_products(cells.select("iid", "sid", (4 * F.col("k") + F.coalesce("gt", F.lit(3))).alias("code")), values, 4 * len(pops))
    return p.select("i", "j", "n", (F.col("s") / F.col("n")).alias("value"))


def from_standardised(x: DataFrame) -> DataFrame:
    """Mean products of rows that are standardised already, as within populations."""
    p = pair_products(x)
    return p.select("i", "j", "n", (F.col("s") / F.col("n")).alias("value"))


def summary(a: DataFrame) -> DataFrame:
    kind = F.when(F.col("i") == F.col("j"), "diagonal").otherwise("off_diagonal")
    return a.groupBy(kind.alias("part")).agg(F.count("*").alias("pairs"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of value * n over sum of n, for pairs that all parts have; 0 where no marker is."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    s = u.groupBy("i", "j").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s")).where(F.col("k") == len(parts))
    return s.select("i", "j", "n", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("value"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a holds beside b: (A1 n1 - A2 n2) / (n1 - n2)."""
    return rest(a.join(b.select("i", "j", F.col("n").alias("m"), F.col("value").alias("w")), ["i", "j"]))


def rest(j: DataFrame) -> DataFrame:
    """As subtract(), of both in one row: (i, j, n, value) without m markers of value w."""
    return j.select("i", "j", (F.col("n") - F.col("m")).alias("n"), F.when(F.col("n") > F.col("m"), (F.col("value") * F.col("n") - F.col("w") * F.col("m")) / (F.col("n") - F.col("m"))).alias("value"))


def align(a: DataFrame, ids: DataFrame) -> DataFrame:
    """The matrix over ids(old, new) alone, renumbered; pairs turn so that j <= i."""
    side = lambda k, name: F.broadcast(ids.select(F.col("old").alias(k), F.col("new").alias(name)))  # noqa: E731  # a row an individual
    p = a.join(side("i", "x"), "i").join(side("j", "y"), "j")
    return p.select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"), "n", "value")


def prune(a: DataFrame, cutoff: float) -> DataFrame:
    """iid of individuals that a single pass removes: of each pair above the cutoff the one in more such pairs, and of
    a tie the larger."""
    over = keep(a.where((F.col("i") != F.col("j")) & (F.col("value") > cutoff)).select("i", "j"))  # read three times
    degree = over.select(F.explode(F.array("i", "j")).alias("iid")).groupBy("iid").agg(F.count("*").alias("d"))
    side = lambda k: F.broadcast(degree.select(F.col("iid").alias(k), F.col("d").alias(f"d{k}")))  # noqa: E731  # a row an individual
    j = over.join(side("i"), "i").join(side("j"), "j")
    return j.select(F.when(F.col("dj") > F.col("di"), F.col("j")).otherwise(F.col("i")).alias("iid")).distinct()


def relatives(a: DataFrame, cutoff: float) -> DataFrame:
    return a.where((F.col("i") != F.col("j")) & (F.col("value") > cutoff))


def singletons(a: DataFrame, cutoff: float) -> DataFrame:
    """Individuals without a relative above the cutoff."""
    own = F.col("i") == F.col("j")
    each = a.where(own | (F.col("value") > cutoff)).select(F.explode(F.array("i", "j")).alias("iid"), own.alias("own"))
    # one pass, summed to a row an individual in the tasks
    return each.groupBy("iid").agg(F.bool_and("own").alias("alone")).where("alone").select("iid")


def sparse(a: DataFrame, cutoff: float, constant: float | None = None) -> DataFrame:
    """Pairs of at least the cutoff, with their value or a constant off the diagonal."""
    kept = a.where((F.col("value") >= cutoff) | (F.col("i") == F.col("j")))
    return kept if constant is None else kept.withColumn("value", F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(constant))


def big_k(a: DataFrame, cutoff: float) -> DataFrame:
    """Off-diagonal values under the cutoff become 0."""
    return a.withColumn("value", F.when((F.col("i") == F.col("j")) | (F.col("value") >= cutoff), F.col("value")).otherwise(0.0))


def adjust(a: DataFrame, causal_share: float = 0.0) -> DataFrame:
    """Shrink for sampling error of markers: off-diagonals times 1 - (c + 1/n) / var(off), diagonals about 1 by
    1 - (c + 1/n) / var(diagonal)."""
    own, a = F.col("i") == F.col("j"), keep(a)  # read twice
    v = F.broadcast(a.agg(F.var_samp(F.when(own, F.col("value"))).alias("vd"), F.var_samp(F.when(~own, F.col("value"))).alias("vo")))
    noise = F.lit(causal_share) + 1 / F.col("n")
    return a.join(v).select("i", "j", "n", F.when(own, 1 + (1 - noise / F.col("vd")) * (F.col("value") - 1)).otherwise((1 - noise / F.col("vo")) * F.col("value")).alias("value"))


def compensate(a: DataFrame, ind: DataFrame, full: bool = True) -> DataFrame:
    """Rescale an X matrix for dosage compensation: male pairs by 2 (full) or 1/2 (none), mixed by their root."""
    f = 2.0 if full else 0.5
    s = ind.select("iid", "sex")
    side = lambda k: F.broadcast(s.select(F.col("iid").alias(k), F.col("sex").alias(f"s{k}")))  # noqa: E731  # a row an individual
    j = a.join(side("i"), "i").join(side("j"), "j")
    males = (F.col("si") == 1).cast("int") + (F.col("sj") == 1).cast("int")
    return j.select("i", "j", "n", (F.col("value") * F.when(males == 2, f).when(males == 1, f**0.5).otherwise(1.0)).alias("value"))


def erm(probes: DataFrame, algorithm: int = 1) -> DataFrame:
    """Expression relationships of probes(iid, probe, val): 1: standardised by probe; 2: centred by probe, over the
    summed variances of the shared probes; 3: centred by individual, over the root of both sums of squares. All are
    then scaled to a mean diagonal of 1."""
    p = probes.where("val is not null").select("iid", F.col("probe").alias("sid"), "val")
    if algorithm == 3:
        m = p.groupBy("iid").agg(F.avg("val").alias("m"))
        c = p.join(m, "iid").select("iid", "sid", (F.col("val") - F.col("m")).alias("x"))
        own = c.groupBy("iid").agg(F.sum(F.col("x") * F.col("x")).alias("ss"))
        side = lambda k, name: F.broadcast(own.select(F.col("iid").alias(k), F.col("ss").alias(name)))  # noqa: E731  # a row an individual
        a = pair_products(c).join(side("i", "ss"), "i").join(side("j", "tt"), "j").select("i", "j", "n", (F.col("s") / F.sqrt(F.col("ss") * F.col("tt"))).alias("value"))
        diagonal = own.select((F.col("ss") / F.sqrt(F.col("ss") * F.col("ss"))).alias("value"))
    else:
        m = p.groupBy("sid").agg(F.avg("val").alias("m"), F.var_samp("val").alias("v")).where("v > 1e-30")
        c = p.join(m, "sid").withColumn("d", F.col("val") - F.col("m"))
        if algorithm == 1:
            x = c.select("iid", "sid", (F.col("d") / F.sqrt("v")).alias("x"))
            a = pair_products(x).select("i", "j", "n", (F.col("s") / F.col("n")).alias("value"))
            diagonal = x.groupBy("iid").agg((F.sum(F.col("x") * F.col("x")) / F.count("x")).alias("value"))
        else:
            a = pair_products(c.select("iid", "sid", F.col("d").alias("x"), "v"), weight="v").select("i", "j", "n", (F.col("s") / F.col("w")).alias("value"))
            diagonal = c.groupBy("iid").agg((F.sum(F.col("d") * F.col("d")) / F.sum("v")).alias("value"))
    # the diagonal comes from the probes, so that the pairs are made once
    scale = F.broadcast(diagonal.agg(F.avg("value").alias("scale")))
    return a.join(scale).select("i", "j", "n", (F.col("value") / F.col("scale")).alias("value"))


def interaction(a: DataFrame, env: DataFrame, categorical: bool = False) -> DataFrame:
    """Gene by environment: value * e_i e_j, or value for pairs of one class and 0 for others; env(iid, e)."""
    side = lambda k: F.broadcast(env.select(F.col("iid").alias(k), F.col("e").alias(f"e{k}")))  # noqa: E731  # a row an individual
    j = a.join(side("i"), "i").join(side("j"), "j")
    w: Column = (F.col("ei") == F.col("ej")).cast("double") if categorical else F.col("ei") * F.col("ej")
    return j.select("i", "j", "n", (F.col("value") * w).alias("value"))


def dense(a: DataFrame, limit: int = 20_000, individuals: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and the full matrix, on the driver, for at most `limit` individuals. individuals: a table (iid) of them, by which
    the limit is checked without the matrix, which is then made once. Pairs come as bytes, not as rows."""
    own = a.where("i = j").select("i") if individuals is None else individuals.select("iid")
    if own.limit(limit + 1).count() > limit:
        raise ValueError(f"a dense matrix of over {limit} individuals is not gathered")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "value"))
                yield pa.RecordBatch.from_arrays([pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (i, j)] + [pa.array([value.tobytes()], pa.binary())], ["i", "j", "value"])

    rows = a.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("value").cast("double")).mapInArrow(pack, "i binary, j binary, value binary").collect()
    read = lambda x, n: np.frombuffer(pa.decompress(x, 8 * n, "zstd"), np.int64)
    found = [(read(r.i, len(r.value) // 8), read(r.j, len(r.value) // 8)) for r in rows]
    ids = np.sort(np.concatenate([i[i == j] for i, j in found] or [np.zeros(0, np.int64)]))
    m = np.zeros((len(ids), len(ids)))
    for (i, j), r in zip(found, rows):
        x, y = np.searchsorted(ids, i), np.searchsorted(ids, j)
        m[x, y] = m[y, x] = np.frombuffer(r.value)
    return ids, m


def matrix_rows(ids: np.ndarray, m: np.ndarray) -> Iterator[pd.DataFrame]:
    x, y = np.tril_indices(len(ids))
    yield pd.DataFrame({"i": ids[x], "j": ids[y], "value": m[x, y]})
