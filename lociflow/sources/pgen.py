"""PGEN files of records of varying width (storage mode 0x10): two-bit calls, one-bit calls with exceptions, differences
from one value or from an earlier marker, and dosages as lists, for marked individuals or for all.

A header names each record's kind and length, from which a partition of markers knows its bytes. A marker that is told
by its differences needs the last one that isn't: the partition begins there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lociflow.functions.ranks import numbered
from lociflow.plans.storage import keep
from lociflow.sources import binary
from lociflow.sources.files import Ranges, write_joined

#: First bytes; markers of a block of the header; exceptions of a group of a list; markers that a task encodes one after the
#: other; and how far a dosage may be from a count to be its call.
MAGIC, BLOCK, GROUP, CHAIN, NEAR = b"\x6c\x1b\x10", 1 << 16, 64, 64, 0.1
MISSING, SCALE, NO_DOSAGE = 3, 16384, 65535
LISTED, ALL, MARKED = 0x20, 0x40, 0x60


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def two_bits(raw: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    return (b[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)[:n]


def bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n]


def listed(ids: np.ndarray, n: int, codes: np.ndarray | None = None) -> bytes:
    """Individuals as a list: their number, each group's first, each group's bytes beyond 63, two-bit codes (if any), and
    steps between a group's."""
    if not len(ids):
        return varint(0)
    groups = [ids[s : s + GROUP] for s in range(0, len(ids), GROUP)]
    wide = (n.bit_length() + 7) // 8
    steps = [b"".join(varint(int(v)) for v in np.diff(g)) for g in groups]
    head = varint(len(ids)) + b"".join(int(g[0]).to_bytes(wide, "little") for g in groups) + bytes(len(s) - 63 for s in steps[:-1])
    return head + (binary._two_bits(codes[None, :]) if codes is not None else b"") + b"".join(steps)


def read_listed(raw: bytes, at: int, n: int, coded: bool) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(individuals, codes, end) of a list."""
    count, at = read_varint(raw, at)
    ids, codes = np.zeros(count, np.int64), np.zeros(0, np.uint8) if coded else None
    if not count:
        return ids, codes, at
    groups, wide = -(-count // GROUP), (n.bit_length() + 7) // 8
    first = [int.from_bytes(raw[at + g * wide : at + (g + 1) * wide], "little") for g in range(groups)]
    at += groups * wide + groups - 1
    if coded:
        size = -(-count // 4)
        codes = two_bits(raw[at : at + size], count)
        at += size
    for g in range(groups):
        ids[g * GROUP] = v = first[g]
        for k in range(g * GROUP + 1, min(count, (g + 1) * GROUP)):
            step, at = read_varint(raw, at)
            ids[k] = v = v + step
    return ids, codes, at


def decoded(kind: int, raw: bytes, n: int, base: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a record: codes 0 to 2 and 3 for missing; counts with dosages, nan where missing. base: codes of
    the last record that stands alone."""
    way, at = kind & 7, 0
    if way == 0:
        at = -(-n // 4)
        codes = two_bits(raw[:at], n)
    else:
        if way == 1:
            at = 1 + -(-n // 8)
            codes = (raw[0] >> 2) + (raw[0] & 3) * bits(raw[1:at], n)
        elif way in (2, 3):
            if base is None:
                raise ValueError("a record's differences are from no record")
            codes = base.copy()
        elif way in (4, 6, 7):
            codes = np.full(n, way - 4, np.uint8)
        else:
            raise ValueError(f"records of kind {kind} are not read")
        ids, other, at = read_listed(raw, at, n, True)
        codes[ids] = other
        if way == 3:
            codes = np.array([2, 1, 0, 3], np.uint8)[codes]
    if kind & 8:
        raise ValueError("markers of over two alleles are not read")
    if kind & 16:  # phase: skipped
        hets = int((codes == 1).sum())
        size = 1 + hets // 8
        if raw[at] & 1:
            size += -(-(int(bits(raw[at : at + size], hets + 1).sum()) - 1) // 8)
        at += size
    counts = np.where(codes == MISSING, np.nan, codes.astype(float))
    form = kind & MARKED
    if form:
        if form == LISTED:
            ids, _, at = read_listed(raw, at, n, False)
        elif form == MARKED:
            size = -(-n // 8)
            ids, at = np.flatnonzero(bits(raw[at : at + size], n)), at + size
        else:
            ids = np.arange(n)
        values = np.frombuffer(raw, "<u2", len(ids), at).astype(float)
        counts[ids] = np.where(values == NO_DOSAGE, np.nan, values / SCALE)
    return codes.astype(np.uint8), counts


def encoded(x: np.ndarray, base: np.ndarray | None) -> tuple[int, bytes, np.ndarray]:
    """(kind, record, codes) of counts or dosages (nan missing), by the shortest form."""
    n = len(x)
    near = np.rint(x)
    codes = np.where(np.isnan(x) | (np.abs(x - near) > NEAR), MISSING, np.nan_to_num(near)).astype(np.uint8)
    forms = [(0, binary._two_bits(codes[None, :]))]
    size = np.bincount(codes, minlength=4)
    one, two = sorted(np.argsort(-size, kind="stable")[:2].tolist())
    others = np.flatnonzero((codes != one) & (codes != two))
    forms.append((1, bytes([one << 2 | two - one]) + np.packbits(codes == two, bitorder="little").tobytes() + listed(others, n, codes[others])))
    for value in (0, 2, 3):
        others = np.flatnonzero(codes != value)
        if len(others) <= n // 4:
            forms.append((4 + value, listed(others, n, codes[others])))
    if base is not None:
        turned = np.array([2, 1, 0, 3], np.uint8)[codes]
        for way, target in ((2, codes), (3, turned)):
            others = np.flatnonzero(target != base)
            if len(others) <= n // 4:
                forms.append((way, listed(others, n, target[others])))
    kind, raw = min(forms, key=lambda f: (len(f[1]), f[0]))
    stored = np.rint(np.nan_to_num(x) * SCALE).astype(np.uint16)
    told = np.flatnonzero(~np.isnan(x) & (stored != codes.astype(np.int64) * SCALE))
    if len(told):
        marks = np.zeros(n, bool)
        marks[told] = True
        tracks = [(LISTED, listed(told, n) + stored[told].tobytes()), (MARKED, np.packbits(marks, bitorder="little").tobytes() + stored[told].tobytes()), (ALL, np.where(np.isnan(x), NO_DOSAGE, stored).astype("<u2").tobytes())]
        form, track = min(tracks, key=lambda f: (len(f[1]), f[0]))
        kind, raw = kind | form, raw + track
    return kind, raw, codes


def header(kinds: np.ndarray, lengths: np.ndarray, individuals: int) -> bytes:
    """Magic, numbers, a byte that says how kinds (8 bits) and lengths (4 bytes) stand, each block's first byte, and then the
    blocks' kinds and lengths."""
    m = len(kinds)
    blocks = [slice(s, min(s + BLOCK, m)) for s in range(0, m, BLOCK)]
    size = 12 + 8 * len(blocks) + 5 * m
    before = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    places = b"".join(struct.pack("<Q", size + int(before[b.start])) for b in blocks)
    return MAGIC + struct.pack("<IIB", m, individuals, 7 | 0x40) + places + b"".join(kinds[b].astype(np.uint8).tobytes() + lengths[b].astype("<u4").tobytes() for b in blocks)


@dataclass
class Records(InputPartition):
    """Markers from start on, with the kinds and places of these and of `lead` markers before, and where the last ends."""

    start: int
    lead: int
    kinds: np.ndarray
    places: np.ndarray


class RecordSource(DataSource):
    """format("lociflow_pgen_records"): option path; rows (iid, sid, gt), numbered from 0 in file order; gt is the count of
    the alternative allele, or its dosage where there is one."""

    @classmethod
    def name(cls) -> str:
        return "lociflow_pgen_records"

    def schema(self) -> str:
        return "iid long, sid long, gt double"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"], int(self.options.get("rows", 1024)))


class RecordReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        with Ranges(path) as f:
            head = f.get(0, min(12, f.size()))
            if head[:3] != MAGIC or len(head) < 12:
                raise ValueError(f"{path} is no PGEN file of records")
            self.m, self.n, form = struct.unpack("<IIB", head[3:])
            if form & 15 > 7:
                raise ValueError("headers of this form are not read")
            wide, whole, alleles, flags = (form & 3) + 1, bool(form & 4), form >> 4 & 3, form >> 6 == 3
            blocks = -(-self.m // BLOCK)
            firsts, at = np.frombuffer(f.get(12, 8 * blocks), "<u8"), 12 + 8 * blocks
            self.kinds, self.places = np.zeros(self.m, np.uint8), np.zeros(self.m + 1, np.int64)
            for b in range(blocks):
                s, e = b * BLOCK, min((b + 1) * BLOCK, self.m)
                k = e - s
                size = k if whole else -(-k // 2)
                raw = np.frombuffer(f.get(at, size), np.uint8)
                self.kinds[s:e] = raw if whole else np.stack([raw & 15, raw >> 4], axis=1).reshape(-1)[:k]
                lengths = np.frombuffer(f.get(at + size, k * wide), np.uint8).reshape(k, wide) @ (1 << 8 * np.arange(wide, dtype=np.int64))
                at += size + k * (wide + alleles) + (-(-k // 8) if flags else 0)
                self.places[s : e + 1] = int(firsts[b]) + np.concatenate(([0], np.cumsum(lengths)))

    def partitions(self) -> list[Records]:
        alone = np.flatnonzero((self.kinds & 7 != 2) & (self.kinds & 7 != 3))
        out = []
        for s in range(0, self.m, self.rows):
            e = min(s + self.rows, self.m)
            at = np.searchsorted(alone, s, side="right") - 1
            first = int(alone[at]) if at >= 0 else s
            # a block begins where its header says: ends are places of their own
            out.append(Records(s, s - first, self.kinds[first:e].copy(), self.places[first : e + 1].copy()))
        return out or [Records(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        k, places, base = len(partition.kinds), partition.places, None
        if not k:
            return
        with Ranges(self.path) as f:
            raw = f.get(int(places[0]), int(places[-1] - places[0]))
        iid = pa.array(np.arange(self.n))
        for i in range(k):
            kind = int(partition.kinds[i])
            if i < partition.lead and i:  # between the record that stands alone and the first wanted one
                continue
            codes, counts = decoded(kind, raw[places[i] - places[0] : places[i + 1] - places[0]], self.n, base)
            if kind & 7 not in (2, 3):
                base = codes
            if i >= partition.lead:
                yield pa.RecordBatch.from_arrays([iid, pa.array(np.full(self.n, partition.start + i - partition.lead)), pa.array(counts, mask=np.isnan(counts))], ["iid", "sid", "gt"])


def read_pgen(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """(iid, sid, gt) of a PGEN file of either storage mode."""
    with Ranges(path) as f:
        mode = f.get(2, 1)
    if mode != MAGIC[2:]:
        return binary.read_pgen(spark, path, rows)
    spark.dataSource.register(RecordSource)
    return spark.read.format("lociflow_pgen_records").options(path=path, rows=rows).load()


def write_pgen_records(markers: DataFrame, path: str, individuals: int) -> None:
    """Write markers (sid, x: counts or dosages by individual, nan missing), in order of sid, each by its shortest record.

    CHAIN markers at a time are encoded one after the other, as differences are from the last that stands alone; the driver
    holds five bytes a marker for the header."""

    def chain(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((p, v.values.to_numpy(zero_copy_only=False).astype(float)) for b in batches for p, v in zip(b.column("place").to_pylist(), b.column("x"))), key=lambda r: r[0])
        out, base = [], None
        for place, x in rows:
            kind, raw, codes = encoded(x, base)
            if kind & 7 not in (2, 3):
                base = codes
            out.append((place, kind, len(raw), raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["place", "kind", "length", "raw"])

    placed = numbered(markers.select("sid", "x"), "sid")
    records = keep(placed.groupBy(F.floor(F.col("place") / CHAIN).alias("chain")).applyInArrow(chain, "place long, kind int, length long, raw binary"))
    told = records.orderBy("place").select("kind", "length").toArrow()
    head = header(told["kind"].to_numpy(), told["length"].to_numpy(), individuals)
    write_joined(records.orderBy("place").select("raw"), raw=(path, head))
