"""PGEN records: round trips of each kind, and a file laid out by hand."""

import struct

import numpy as np
import pytest

from lociflow.sources import binary, pgen


def kinds_of(n, seed):
    """Rows that want each kind of record: (name, counts)."""
    rng = np.random.default_rng(seed)
    rare = np.where(rng.random(n) < 0.02, 1.0, 0.0)
    yield "any", rng.choice([0.0, 1.0, 2.0, np.nan], n)
    yield "few", rare
    yield "alternative", 2 - np.where(rng.random(n) < 0.02, 1.0, 0.0)
    yield "missing", np.where(rng.random(n) < 0.02, 1.0, np.nan)
    two = np.where(rng.random(n) < 0.01, 2.0, rng.choice([0.0, 1.0], n))
    yield "one bit", two
    near = two.copy()
    near[rng.integers(0, n, 3)] = np.nan
    yield "differences", near
    yield "turned", 2 - near
    some = rare.copy()
    some[[1, n - 1]] = [0.75, 1.3]
    yield "few dosages", some
    yield "many dosages", np.where(rng.random(n) < 0.4, rng.random(n) * 2, rare)
    all_ = rng.random(n) * 2
    all_[3] = np.nan
    yield "dosages", all_


@pytest.mark.parametrize("n", [5, 64, 257, 3000])
def test_records_round_trip(n):
    base, seen = None, set()
    for _, x in kinds_of(n, n):
        kind, raw, codes = pgen.encoded(x, base)
        got_codes, got = pgen.decoded(kind, raw, n, base)
        assert np.array_equal(got_codes, codes)
        assert np.array_equal(np.isnan(got), np.isnan(x)) and np.nanmax(np.abs(got - x), initial=0) <= 0.5 / pgen.SCALE
        if kind & 7 not in (2, 3):
            base = codes
        seen |= {("way", kind & 7), ("dosage", kind & 0x60)}
    if n == 3000:
        assert seen == {("way", w) for w in (0, 1, 2, 3, 4, 6, 7)} | {("dosage", d) for d in (0, 0x20, 0x40, 0x60)}


def test_lists():
    rng = np.random.default_rng(0)
    for n, count in [(300, 0), (300, 1), (300, 64), (300, 65), (70_000, 5000), (2**24 + 5, 200)]:
        ids = np.sort(rng.choice(n, count, replace=False))
        codes = rng.integers(0, 4, count).astype(np.uint8)
        raw = b"x" + pgen.listed(ids, n, codes) + b"tail"
        got, got_codes, at = pgen.read_listed(raw, 1, n, True)
        assert np.array_equal(got, ids) and np.array_equal(got_codes, codes) and raw[at:] == b"tail"
        got, none, at = pgen.read_listed(pgen.listed(ids, n), 0, n, False)
        assert np.array_equal(got, ids) and none is None


def test_phase_is_skipped():
    """Hets 0, 1, 3 and 6 with phases for all (first bit 0) or for two of them (first bit 1), and then a dosage list."""
    codes = np.array([1, 1, 0, 1, 2, 3, 1], np.uint8)
    dosage = pgen.listed(np.array([2]), 7) + struct.pack("<H", 8192)
    for phase in (bytes([0b10110]), bytes([0b00111, 0b01])):
        raw = binary._two_bits(codes[None, :]) + phase + dosage
        _, counts = pgen.decoded(0x10 | pgen.LISTED, raw, 7, None)
        assert counts[[0, 1, 2, 3, 4, 6]].tolist() == [1, 1, 0.5, 1, 2, 1] and np.isnan(counts[5])
    with pytest.raises(ValueError, match="two alleles"):
        pgen.decoded(8, binary._two_bits(codes[None, :]), 7, None)


def test_file_laid_out_by_hand(spark, tmp_path):
    """Four-bit kinds, two-byte lengths, allele counts and flags in the header, five individuals."""
    one = binary._two_bits(np.array([[0, 1, 2, 3, 1]], np.uint8))
    two = pgen.listed(np.array([4]), 5, np.array([2], np.uint8))  # differs from the first by individual 4
    three = pgen.listed(np.array([0]), 5, np.array([1], np.uint8))  # all 0 but individual 0
    records = [one, two, three]
    head = b"\x6c\x1b\x10" + struct.pack("<IIB", 3, 5, 1 | 1 << 4 | 3 << 6)
    body = bytes([0 | 2 << 4, 4]) + b"".join(struct.pack("<H", len(r)) for r in records) + bytes([2, 2, 2]) + bytes([0b101])
    path = tmp_path / "a.pgen"
    path.write_bytes(head + struct.pack("<Q", len(head) + 8 + len(body)) + body + b"".join(records))
    for rows in (1, 2, 100):
        got = {(r.sid, r.iid): r.gt for r in pgen.read_pgen(spark, str(path), rows).collect()}
        want = [[0, 1, 2, None, 1], [0, 1, 2, None, 2], [1, 0, 0, 0, 0]]
        assert got == {(s, i): v for s, row in enumerate(want) for i, v in enumerate(row)}


def test_file_round_trip(spark, tmp_path, monkeypatch):
    """Partitions that begin at differences read on from the record before them; blocks of the header are small here."""
    monkeypatch.setattr(pgen, "BLOCK", 16)
    n, rows = 90, []
    for seed in range(12):
        rows += [x for _, x in kinds_of(n, seed)]
    frame = spark.createDataFrame([(3 * k + 1, [float(v) for v in x]) for k, x in enumerate(rows)], "sid long, x array<double>").repartition(5)
    path = f"file://{tmp_path}/a.pgen"
    pgen.write_pgen_records(frame, path, n)
    reader = pgen.RecordReader(path, 7)
    assert any(p.lead for p in reader.partitions()) and len(reader.kinds) == len(rows)
    for p in reader.partitions():
        for batch in reader.read(p):
            s = batch.column("sid")[0].as_py()
            got = batch.column("gt").to_numpy(zero_copy_only=False).astype(float)
            assert np.array_equal(np.isnan(got), np.isnan(rows[s])) and np.nanmax(np.abs(got - rows[s]), initial=0) <= 0.5 / pgen.SCALE
    monkeypatch.undo()
    pgen.write_pgen_records(frame, path, n)
    assert pgen.read_pgen(spark, path, 7).count() == n * len(rows)
    (tmp_path / "bad.pgen").write_bytes(b"\x6c\x1b\x10\0")
    with pytest.raises(Exception, match="no PGEN"):
        pgen.read_pgen(spark, str(tmp_path / "bad.pgen")).count()
