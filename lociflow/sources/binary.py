"""Binary genotype and matrix files as Spark data sources: partitions are ranges of markers or matrix rows, of which a
task reads the bytes alone. Writers encode in tasks, whose parts the sink joins to one file."""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociflow.sources.files import Ranges, exists, write_joined

#: First bytes of a marker-major genotype file.
MAGIC = b"\x6c\x1b\x01"
#: Two bits of a call to its count of the first allele; 1 is missing.
CALLS = np.array([2.0, np.nan, 1.0, 0.0])


@dataclass
class Range(InputPartition):
    start: int
    end: int


def _ranges(n: int, rows: int) -> list[Range]:
    return [Range(s, min(s + rows, n)) for s in range(0, n, rows)] or [Range(0, 0)]


class BedSource(DataSource):
    """format("lociflow_bed"): options path, individuals, markers; rows (iid, sid, gt), numbered from 0 in file order."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_bed"

    def schema(self) -> str:
        return "iid long, sid long, gt double"

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options["path"], int(self.options["individuals"]), int(self.options["markers"]), int(self.options.get("rows", 1024)))


class BedReader(DataSourceReader):
    calls = CALLS
    head = 3

    def __init__(self, path: str, individuals: int, markers: int, rows: int):
        self.path, self.n, self.m, self.rows = path, individuals, markers, rows
        self.width = (individuals + 3) // 4
        with Ranges(path) as f:
            if f.size() < 3 or f.get(0, 3) != MAGIC:
                raise ValueError(f"{path} is no marker-major genotype file")
            if f.size() != 3 + self.width * markers:
                raise ValueError(f"{path} doesn't hold {markers} markers of {individuals} individuals")

    def partitions(self) -> list[Range]:
        return _ranges(self.m, self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        k = partition.end - partition.start
        with Ranges(self.path) as f:
            raw = np.frombuffer(f.get(self.head + partition.start * self.width, k * self.width), np.uint8).reshape(k, self.width)
        codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(k, -1)[:, : self.n]
        gt = self.calls[codes].ravel()
        iid = np.tile(np.arange(self.n), k)
        sid = np.repeat(np.arange(partition.start, partition.end), self.n)
        yield pa.RecordBatch.from_arrays([pa.array(iid), pa.array(sid), pa.array(gt, mask=np.isnan(gt))], ["iid", "sid", "gt"])


def read_bed(spark: SparkSession, path: str, individuals: int, markers: int, rows: int = 1024) -> DataFrame:
    spark.dataSource.register(BedSource)
    return spark.read.format("lociflow_bed").options(path=path, individuals=individuals, markers=markers, rows=rows).load()


def pack_calls(gt: np.ndarray) -> bytes:
    """Rows of counts (nan missing), one marker each, as two-bit calls."""
    code = np.where(np.isnan(gt), 1, np.where(gt == 2, 0, np.where(gt == 1, 2, 3))).astype(np.uint8)
    return _two_bits(code)


def _two_bits(code: np.ndarray) -> bytes:
    """Rows of codes 0 to 3, four to a byte, the first lowest; a row's last byte is filled with zeros."""
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % 4))).reshape(len(code), -1, 4)
    return (code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6).astype(np.uint8).tobytes()


def encoded(packed: DataFrame, encode) -> DataFrame:
    """(raw) in order of sid: encode(x) of markers (sid, x: counts by individual, nan missing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [encode(v.values.to_numpy(zero_copy_only=False).astype(float)[None, :]) for v in b.column("x")]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    return packed.select("sid", "x").orderBy("sid").mapInArrow(run, "raw binary")


def write_bed(packed: DataFrame, path: str) -> None:
    """Write markers (sid, x: counts by individual, nan missing), in order of sid."""
    write_joined(encoded(packed, pack_calls), raw=(path, MAGIC))


class PgenSource(BedSource):
    """format("lociflow_pgen"): option path; rows (iid, sid, gt) of a file of fixed-width hard calls (storage mode 2)."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_pgen"

    def reader(self, schema) -> DataSourceReader:
        return PgenReader(self.options["path"], int(self.options.get("rows", 1024)))


class PgenReader(BedReader):
    """Calls count the alternative allele; 3 is missing. The header names the numbers of markers and individuals."""

    calls = np.array([0.0, 1.0, 2.0, np.nan])
    head = 12

    def __init__(self, path: str, rows: int):
        with Ranges(path) as f:
            size = f.size()
            magic, mode, self.m, self.n, _ = struct.unpack("<2sBIIB", f.get(0, min(size, self.head)).ljust(self.head, b"\0"))
        if magic != MAGIC[:2]:
            raise ValueError(f"{path} is no PGEN file")
        if mode != 2:
            raise ValueError("only fixed-width hard calls (storage mode 2) are read")
        self.path, self.rows, self.width = path, rows, (self.n + 3) // 4
        if size != self.head + self.width * self.m:
            raise ValueError(f"{path} doesn't hold {self.m} markers of {self.n} individuals")


def read_pgen(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    spark.dataSource.register(PgenSource)
    return spark.read.format("lociflow_pgen").options(path=path, rows=rows).load()


def write_pgen(packed: DataFrame, path: str, individuals: int) -> None:
    """Write markers (sid, x: counts by individual, nan missing), in order of sid, as fixed-width hard calls: counts 0, 1
    and 2, and 3 where missing."""
    encode = lambda x: _two_bits(np.nan_to_num(x, nan=3).astype(np.uint8))
    write_joined(encoded(packed, encode), raw=(path, struct.pack("<2sBIIB", MAGIC[:2], 2, packed.count(), individuals, 0x40)))


class GrmSource(DataSource):
    """format("lociflow_grm"): options prefix, individuals; rows (i, j, n, value) of PREFIX.grm.bin and .grm.N.bin."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_grm"

    def schema(self) -> str:
        return "i long, j long, n double, value double"

    def reader(self, schema) -> DataSourceReader:
        return GrmReader(self.options["prefix"], int(self.options["individuals"]), int(self.options.get("rows", 2048)))


class GrmReader(DataSourceReader):
    def __init__(self, prefix: str, individuals: int, rows: int):
        self.prefix, self.n, self.rows = prefix, individuals, rows

    def partitions(self) -> list[Range]:
        return _ranges(self.n, self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        a, b = partition.start * (partition.start + 1) // 2, partition.end * (partition.end + 1) // 2

        def get(suffix: str) -> np.ndarray:
            with Ranges(f"{self.prefix}{suffix}") as f:
                return np.frombuffer(f.get(4 * a, 4 * (b - a)), "<f4")

        value = get(".grm.bin")
        n = get(".grm.N.bin") if exists(f"{self.prefix}.grm.N.bin") else np.ones(len(value))
        i = np.repeat(np.arange(partition.start, partition.end), np.arange(partition.start, partition.end) + 1)
        j = np.arange(a, b) - i * (i + 1) // 2
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n.astype(float)), pa.array(value.astype(float))], ["i", "j", "n", "value"])


def read_grm(spark: SparkSession, prefix: str, individuals: int) -> DataFrame:
    spark.dataSource.register(GrmSource)
    return spark.read.format("lociflow_grm").options(prefix=prefix, individuals=individuals).load()


def write_grm(a: DataFrame, ids: list[tuple[str, str]], prefix: str) -> None:
    """Lower triangle as 32-bit floats, in row order, with the list of ids."""

    def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [pa.array([b.column(c).to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary()) for c in ("value", "n")]
            yield pa.RecordBatch.from_arrays(raw, ["value", "n"])

    write_joined(a.orderBy("i", "j").select("value", "n").mapInArrow(floats, "value binary, n binary"), value=(f"{prefix}.grm.bin", b""), n=(f"{prefix}.grm.N.bin", b""))
    lines = a.sparkSession.createDataFrame([(k, f"{x}\t{y}\n") for k, (x, y) in enumerate(ids)], "at long, line string")
    write_joined(lines.orderBy("at").select(F.encode("line", "UTF-8").alias("line")), line=(f"{prefix}.grm.id", b""))


def write_ld(pairs: DataFrame, snp: DataFrame, path: str) -> None:
    """LD windows in binary: for each marker in order of (chr, bp, sid) how many correlations follow (4 bytes), then these
    as 4-byte floats, first its own, then those with the markers after it.

    pairs: (sid1, sid2, r) of all pairs of a window of the varying markers, sid1 the earlier; a marker's own count says
    where its window ends. Beside it path + ".snp" lists the markers.
    """
    order = F.struct("chr", "bp", "sid")
    place = snp.select("sid", order.alias("at"))
    after = pairs.join(place.withColumnRenamed("sid", "sid2"), "sid2").groupBy(F.col("sid1").alias("sid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda c: c["r"].cast("float")).alias("r"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [np.array([1.0, *(x.as_py() or ())], "<f4") for x in b.column("r")]
            ids = [f"{x}\n".encode() for x in b.column("sid").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<I", len(x)) + x.tobytes() for x in r], pa.binary()), pa.array(ids, pa.binary())], ["window", "ids"])

    rows = place.join(after, "sid", "left").orderBy("at").select("sid", "r").mapInArrow(windows, "window binary, ids binary")
    write_joined(rows, window=(path, b""), ids=(f"{path}.snp", b""))


class LdSource(DataSource):
    """format("lociflow_ld"): options path; rows (sid1, sid2, r) of write_ld()'s file, a marker with itself left out."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_ld"

    def schema(self) -> str:
        return "sid1 long, sid2 long, r double"

    def reader(self, schema) -> DataSourceReader:
        return LdReader(self.options["path"], int(self.options.get("rows", 1024)))


class LdReader(DataSourceReader):
    """The counts are read once, by ranges that run ahead; a task reads its markers' bytes."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        with Ranges(f"{path}.snp") as f:
            self.sids = np.array(f.get(0, f.size()).split(), np.int64)
        self.places = np.zeros(len(self.sids) + 1, np.int64)
        with Ranges(path) as f:
            counts = f.stream()
            for k in range(len(self.sids)):
                self.places[k] = counts.tell()
                counts.seek(4 * struct.unpack("<I", counts.read(4))[0], 1)
            self.places[-1] = f.size()

    def partitions(self) -> list[Range]:
        return _ranges(len(self.sids), self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with Ranges(self.path) as f:
            for k in range(partition.start, partition.end):
                at, end = int(self.places[k]), int(self.places[k + 1])
                r = np.frombuffer(f.get(at + 4, end - at - 4), "<f4")[1:].astype(float)
                n = len(r) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n - 1, self.sids[k])), pa.array(self.sids[k + 1 : k + n]), pa.array(r)], ["sid1", "sid2", "r"])


def read_ld(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LdSource)
    return spark.read.format("lociflow_ld").option("path", path).load()


class BgenSource(DataSource):
    """format("lociflow_bgen"): options path; rows (sid, name, chr, bp, a1, a2, iid, p0, p1, p2) of layout 2, two alleles."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_bgen"

    def schema(self) -> str:
        return "sid long, name string, chr string, bp long, a1 string, a2 string, iid long, p0 double, p1 double, p2 double"

    def reader(self, schema) -> DataSourceReader:
        return BgenReader(self.options["path"], int(self.options.get("rows", 256)), self.options.get("index"))


class BgenReader(DataSourceReader):
    """The header is read once. The markers' places come from an index beside the file, if one is named, or else from one
    pass that skips the probability blocks, by ranges that run ahead."""

    def __init__(self, path: str, rows: int, index: str | None = None):
        self.path, self.rows = path, rows
        with Ranges(path) as whole:
            f = whole.stream()
            offset, header, self.m, self.n = struct.unpack("<4I", f.read(16))
            magic = f.read(4)
            if magic not in (b"bgen", b"\0\0\0\0"):
                raise ValueError(f"{path} is no BGEN file")
            f.seek(header)
            flags = struct.unpack("<I", f.read(4))[0]
            self.compression, layout = flags & 3, flags >> 2 & 15
            if layout != 2:
                raise ValueError("only layout 2 is read")
            if index:
                self.numbers, self.places = zip(*((k, row[3]) for k, row in enumerate(read_bgen_index(index, None)) if row[5] == 2)) or ((), ())
                return
            f.seek(offset + 4)
            self.places, self.numbers = [], range(self.m)
            for _ in range(self.m):
                self.places.append(f.tell())
                self._skip_names(f)
                size = struct.unpack("<I", f.read(4))[0]
                f.seek(size, 1)

    @staticmethod
    def _skip_names(f) -> tuple[str, str, int, list[str]]:
        text = lambda kind: f.read(struct.unpack(f"<{kind}", f.read(struct.calcsize(kind)))[0]).decode()
        text("H")
        name, chrom = text("H"), text("H")
        bp, k = struct.unpack("<IH", f.read(6))
        return name, chrom, bp, [text("I") for _ in range(k)]

    def partitions(self) -> list[Range]:
        return _ranges(len(self.places), self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with Ranges(self.path) as whole:
            f = whole.stream()
            for k in range(partition.start, partition.end):
                sid = self.numbers[k]
                f.seek(self.places[k])
                name, chrom, bp, alleles = self._skip_names(f)
                size = struct.unpack("<I", f.read(4))[0]
                block = f.read(size)
                if len(alleles) != 2:
                    continue
                if self.compression:
                    whole = struct.unpack("<I", block[:4])[0]
                    block = zlib.decompress(block[4:]) if self.compression == 1 else pa.Codec("zstd").decompress(block[4:], decompressed_size=whole).to_pybytes()
                p0, p1, p2 = probabilities(block)
                n, same = len(p0), lambda v, t=pa.string(): pa.array([v] * len(p0), t)
                missing = np.isnan(p0)
                yield pa.RecordBatch.from_arrays([same(sid, pa.int64()), same(name), same(chrom), same(bp, pa.int64()), same(alleles[0].upper()), same(alleles[1].upper()), pa.array(np.arange(n)), *[pa.array(p, mask=missing) for p in (p0, p1, p2)]], ["sid", "name", "chr", "bp", "a1", "a2", "iid", "p0", "p1", "p2"])


def probabilities(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(0), P(1), P(2) copies of the second allele from a probability block; nan where missing."""
    n, _k, low, high = struct.unpack("<IHBB", block[:8])
    if low != 2 or high != 2:
        raise ValueError("only diploid genotypes are read")
    ploidy = np.frombuffer(block, np.uint8, n, 8)
    phased, bits = block[8 + n], block[9 + n]
    raw = np.frombuffer(block, np.uint8, offset=10 + n)
    if bits in (8, 16, 32):
        v = raw.view(f"<u{bits // 8}")[: 2 * n].astype(float)
    else:
        flat = np.unpackbits(raw, bitorder="little")[: 2 * n * bits].reshape(-1, bits)
        v = flat @ (2.0 ** np.arange(bits))
    a, b = (v / (2.0**bits - 1)).reshape(n, 2).T
    p0, p1 = (a * b, a * (1 - b) + b * (1 - a)) if phased else (a, b)
    gone = ploidy & 0x80 != 0
    return tuple(np.where(gone, np.nan, p) for p in (p0, p1, 1 - p0 - p1))


def read_bgen(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """index: a .bgi file of the same markers; with it no pass over the file finds their places."""
    spark.dataSource.register(BgenSource)
    return spark.read.format("lociflow_bgen").options(path=path, **({"index": index} if index else {})).load()


def probability_block(p0: np.ndarray, p1: np.ndarray) -> bytes:
    """A compressed block of unphased diploid probabilities (nan missing) in 16 bits."""
    gone = np.isnan(p0) | np.isnan(p1)
    a = np.rint(np.where(gone, 0, p0) * 65535).astype(np.int64)
    b = np.minimum(np.rint(np.where(gone, 0, p1) * 65535).astype(np.int64), 65535 - a)
    ploidy = np.where(gone, 0x82, 2).astype(np.uint8)
    block = struct.pack("<IHBB", len(a), 2, 2, 2) + ploidy.tobytes() + bytes([0, 16]) + np.stack([a, b], axis=1).astype("<u2").tobytes()
    return struct.pack("<I", len(block)) + zlib.compress(block)


def write_bgen(markers: DataFrame, path: str, individuals: int) -> None:
    """Write markers (sid, name, chr, bp, a1, a2, p0, p1: arrays by individual, nan missing), in order of sid, as layout 2
    with compressed 16-bit probabilities and without names of individuals."""
    text = lambda kind, value: struct.pack(f"<{kind}", len(value.encode())) + value.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for sid, name, chrom, bp, a1, a2, p0, p1 in zip(*(b.column(c) for c in ("sid", "name", "chr", "bp", "a1", "a2", "p0", "p1"))):
                block = probability_block(*(p.values.to_numpy(zero_copy_only=False) for p in (p0, p1)))
                names = text("H", str(sid)) + text("H", name.as_py()) + text("H", chrom.as_py()) + struct.pack("<IH", bp.as_py(), 2) + text("I", a1.as_py()) + text("I", a2.as_py())
                raw.append(names + struct.pack("<I", len(block)) + block)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    rows = markers.select("sid", "name", F.col("chr").cast("string").alias("chr"), F.col("bp").cast("long").alias("bp"), "a1", "a2", "p0", "p1").orderBy("sid").mapInArrow(run, "raw binary")
    head = struct.pack("<4I", 20, 20, markers.count(), individuals) + b"bgen" + struct.pack("<I", 2 << 2 | 1)
    write_joined(rows, raw=(path, head))


def read_bgen_index(path: str, alleles: int | None = 2) -> list[tuple]:
    """(chromosome, position, rsid, file_start, size, alleles) of markers with so many alleles (None: of all) from a .bgi
    index, in order of the file. The index is copied to the driver, as its format needs a local file."""
    import sqlite3

    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "index")
        with Ranges(path) as f, open(local, "wb") as out:
            out.write(f.get(0, f.size()))
        with sqlite3.connect(f"file:{local}?mode=ro", uri=True) as db:
            rows = db.execute("SELECT chromosome, position, rsid, file_start_position, size_in_bytes, number_of_alleles FROM Variant ORDER BY file_start_position").fetchall()
    return rows if alleles is None else [r[:5] for r in rows if r[5] == alleles]
