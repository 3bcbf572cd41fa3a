"""Readers and writers of file formats, by round trips and small files."""

import struct
import zlib

import numpy as np
import pytest

from lociflow.sources import binary, text


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.write_text(content)
        return str(p)

    return put


def values(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_individual_files(spark, write):
    fam = text.read_fam(spark, write("a.fam", "f1 i1 0 0 1 -9\nf2\ti2 0 0 2 1.5\nf3 i3 0 0 x NA\n"))
    assert values(fam.select("fid", "iid", "sex", "pheno")) == [("f1", "i1", 1, None), ("f2", "i2", 2, 1.5), ("f3", "i3", 0, None)]
    psam = text.read_psam(spark, write("a.psam", "##note\n#IID SEX AGE\ni1 1 30\ni2 2 31\n"))
    assert values(psam) == [("i1", "i1", 1), ("i2", "i2", 2)]
    with pytest.raises(ValueError):
        text.read_psam(spark, write("b.psam", "#IID AGE\ni1 3\n"))
    sample = text.read_sample(spark, write("a.sample", "ID_1 ID_2 missing sex\n0 0 0 D\nf1 i1 0 1\n"))
    assert values(sample) == [("f1", "i1", 0.0)]
    assert text.same_samples(fam, fam) and not text.same_samples(fam, fam.limit(2))
    ph = text.read_phenotypes(spark, write("a.phen", "FID IID y1 y2\nf1 i1 1.5 NA\nf2 i2 -9 2\n"))
    assert values(ph) == [("f1", "i1", 1, 1.5), ("f1", "i1", 2, None), ("f2", "i2", 1, None), ("f2", "i2", 2, 2.0)]
    cov = text.read_covariates(spark, write("a.cov", "f1 i1 1 2\nf2 i2 NA 3\n"))
    assert values(cov) == [("f1", "i1", 1.0, 2.0)]


def test_marker_files(spark, write):
    bim = text.read_bim(spark, write("a.bim", "1\trs1\t0\t100\ta\tg\nX rs2 0 200 C T\n7 rs3 0 300 c t\n"), high=22)
    assert values(bim.select("idx", "chr", "name", "bp", "a1", "a2")) == [(0, 1, "rs1", 100, "A", "G"), (2, 7, "rs3", 300, "C", "T")]
    pvar = text.read_pvar(spark, write("a.pvar", "##x\n#CHROM POS ID REF ALT\n1 100 rs1 G A\nMT 5 rs2 c t\n"))
    assert values(pvar) == [(1, "rs1", 100, "A", "G"), (26, "rs2", 5, "T", "C")]
    genes = text.read_genes(spark, write("g1", "1 10 20 AAA\nX 5 6 BBB\n"))
    assert values(genes) == [("AAA", 1, 10, 20), ("BBB", 23, 5, 6)]
    sets = text.read_sets(spark, write("s", "set1\nrs1 rs2\nrs1\nEND\nset2 rs9 END\n"))
    assert values(sets) == [("set1", "rs1"), ("set1", "rs2"), ("set2", "rs9")]
    many = text.read_many(text.read_genes, spark, [write("g2", "1 1 2 A\n"), write("g3", "2 1 2 B\n")])
    assert values(many.select("name", "file")) == [("A", 0), ("B", 1)]


def test_tables(spark, write):
    ma = text.read_sumstat(spark, write("a.ma", "SNP A1 A2 freq b se p N\nrs1 a g 0.2 0.1 0.01 1e-8 1000\nrs2 a g 0.2 NA 0.01 0.1 1000\nrs3 a g 0.2 0.1 0 0.1 1000\n"))
    assert values(ma) == [("rs1", "A", "G", 0.2, 0.1, 0.01, 1e-08, 1000.0)]
    assert text.read_trait_list(spark, write("t", "bmi f1\nt2d f2 0.3 0.1\n"))[1] == {"name": "t2d", "file": "f2", "sample_prevalence": 0.3, "population_prevalence": 0.1}
    l2 = text.read_ld_scores(spark, write("1.l2.ldscore", "CHR SNP BP L2\n1 rs1 5 1.5\n"))
    assert values(l2) == [("rs1", 1.5)]
    p = text.read_probes(spark, write("e", "FID IID p1 p2\nf i 1 -9\n"))
    assert values(p) == [("f", "i", "p1", 1.0), ("f", "i", "p2", None)]
    assert values(text.read_effects(spark, write("q", "rs1 0.5\nrs2\n"))) == [("rs1", 0.5), ("rs2", None)]
    assert values(text.read_genetic_map(spark, write("m", "position rate map\n10 1 0.5\n"), 3)) == [(3, 10, 0.5)]
    sp = text.read_sparse_grm(spark, write("s.sp", "0 0 1\n1 0 0.5\n1 1 1\n"))
    assert values(sp) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)]
    assert values(text.read_grm_text(spark, write("s.grm", "1 1 10 1.0\n2 1 9 0.1\n"))) == [(0, 0, 10.0, 1.0), (1, 0, 9.0, 0.1)]


def test_dosages(spark, write):
    d = text.read_mach(spark, write("i", "SNP A1 A2 F M Q Rsq\nrs1 A G 0 0 0 0.9\nrs2 A G 0 0 0 0.1\n"), write("d", "f->i1 ML_DOSE 0.5 1.5\n"), 0.3)
    assert values(d) == [("i1", "rs1", 0.5)]
    b = text.read_beagle(spark, write("b", "marker alleleA alleleB i1 i2\nrs1 A G 0.5 2\n"))
    assert values(b) == [("i1", "rs1", 0.5), ("i2", "rs1", 2.0)]
    r = text.read_raw_genotypes(spark, write("r", "header\nrs1,s1,a,G,0.9\nrs1,s2,A,G,0.2\n"), skip=1)
    assert values(r) == [("s1", "rs1", "A", "G"), ("s2", "rs1", "0", "0")]


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    gt = rng.choice([0.0, 1.0, 2.0, np.nan], size=(37, 13))
    path = str(tmp_path / "a.bed")
    binary.write_bed(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(gt)], "sid long, x array<double>"), path)
    back = binary.read_bed(spark, path, 13, 37, rows=5)
    assert back.rdd.getNumPartitions() == 8
    got = {(r.sid, r.iid): r.gt for r in back.collect()}
    assert all((got[i, j] is None and np.isnan(gt[i, j])) or got[i, j] == gt[i, j] for i in range(37) for j in range(13))
    (tmp_path / "bad.bed").write_bytes(b"\x6c\x1b\x00" + bytes(37 * 4))
    with pytest.raises(Exception):
        binary.read_bed(spark, str(tmp_path / "bad.bed"), 13, 37).count()


def test_grm_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(i, j, 10.0 + i, i + j / 8) for i in range(5) for j in range(i + 1)], "i long, j long, n double, value double")
    binary.write_grm(a, [(f"f{i}", f"i{i}") for i in range(5)], str(tmp_path / "m"))
    assert values(binary.read_grm(spark, str(tmp_path / "m"), 5)) == values(a)


@pytest.mark.parametrize("compression", [0, 1])
@pytest.mark.parametrize("bits", [8, 16])
def test_bgen(spark, tmp_path, compression, bits):
    top = 2**bits - 1
    probs = [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    block = struct.pack("<IHBB", 3, 2, 2, 2) + bytes([2, 2, 0x82]) + bytes([0, bits]) + b"".join(int(p * top).to_bytes(bits // 8, "little") for pair in probs for p in pair)
    body = struct.pack("<I", len(block)) + zlib.compress(block) if compression else block
    names = b"".join(struct.pack("<H", len(x)) + x for x in (b"id", b"rs1", b"01")) + struct.pack("<IH", 77, 2) + b"".join(struct.pack("<I", 1) + x for x in (b"A", b"G"))
    raw = struct.pack("<4I", 20, 20, 1, 3) + b"bgen" + struct.pack("<I", 2 << 2 | compression) + names + struct.pack("<I", len(body)) + body
    path = tmp_path / "a.bgen"
    path.write_bytes(raw)
    rows = sorted(binary.read_bgen(spark, str(path)).collect(), key=lambda r: r.iid)
    assert [(r.name, r.bp, r.a1, r.p0, r.p1, r.p2) for r in rows] == [("rs1", 77, "A", 1.0, 0.0, 0.0), ("rs1", 77, "A", 0.0, 1.0, 0.0), ("rs1", 77, "A", None, None, None)]


def test_bgen_round_trip(spark, tmp_path):
    """By a pass over the file and by an index; also at a file:// address, and with a marker of one individual."""
    import sqlite3

    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], size=(23, 11))
    p[rng.random((23, 11)) < 0.1] = np.nan
    rows = [(i, f"rs{i}", 1 + i % 3, 100 + i, "A", "GT", [float(v) for v in x[:, 0]], [float(v) for v in x[:, 1]]) for i, x in enumerate(p)]
    markers = spark.createDataFrame(rows, "sid long, name string, chr int, bp long, a1 string, a2 string, p0 array<double>, p1 array<double>").repartition(4)
    path = f"file://{tmp_path}/a.bgen"
    binary.write_bgen(markers, path, 11)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.bgen"]  # no part is left
    got = {(r.sid, r.iid): r for r in binary.read_bgen(spark, path).collect()}
    assert len(got) == 23 * 11
    for (s, i), r in got.items():
        assert (r.name, r.chr, r.bp, r.a2) == (f"rs{s}", str(1 + s % 3), 100 + s, "GT")
        assert (r.p0 is None and np.isnan(p[s, i, 0])) or np.abs(np.array([r.p0, r.p1, r.p2]) - p[s, i]).max() < 4e-5
    reader = binary.BgenReader(path, 5)
    index = str(tmp_path / "a.bgi")
    with sqlite3.connect(index) as db:
        db.execute("CREATE TABLE Variant (chromosome, position, rsid, number_of_alleles, file_start_position, size_in_bytes)")
        db.executemany("INSERT INTO Variant VALUES ('1', 1, 'x', ?, ?, 1)", [(3 if k == 4 else 2, at) for k, at in enumerate(reader.places)])
    few = {(r.sid, r.iid): r for r in binary.read_bgen(spark, path, index).collect()}
    assert few == {k: v for k, v in got.items() if k[0] != 4}


def test_joined_parts_keep_their_order(spark, tmp_path):
    """Parts of many tasks, and a failing task, which leaves no file."""
    from pyspark.sql import functions as F

    from lociflow.sources.files import write_joined

    rows = spark.range(5000).repartition(7).orderBy("id")
    path = str(tmp_path / "deep" / "x.txt")
    write_joined(rows.select(F.encode(F.concat(F.col("id").cast("string"), F.lit("\n")), "UTF-8").alias("line")), line=(path, b"head\n"))
    assert (tmp_path / "deep" / "x.txt").read_text().split() == ["head", *map(str, range(5000))]
    bad = rows.select(F.encode(F.when(F.col("id") == 4000, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")), "UTF-8").alias("line"))
    with pytest.raises(Exception, match="stop"):
        write_joined(bad, line=(str(tmp_path / "y.txt"), b""))
    assert not (tmp_path / "y.txt").exists()
    write_joined(rows.where("false").select(F.encode(F.lit("x"), "UTF-8").alias("line")), line=(str(tmp_path / "z"), b"only"))
    assert (tmp_path / "z").read_bytes() == b"only"


def test_bgen_index(tmp_path):
    import sqlite3

    path = str(tmp_path / "a.bgi")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE Variant (chromosome, position, rsid, number_of_alleles, file_start_position, size_in_bytes)")
        db.executemany("INSERT INTO Variant VALUES (?,?,?,?,?,?)", [("1", 5, "rs1", 2, 100, 10), ("1", 6, "rs2", 3, 110, 10)])
    assert binary.read_bgen_index(path) == [("1", 5, "rs1", 100, 10)]


def test_streams(spark, tmp_path):
    from lociflow.streaming import accumulate

    rows = [(i, s, (i + s) % 3) for i in range(6) for s in range(4)]
    g = spark.createDataFrame(rows, "iid long, sid long, gt int")
    g.repartition(3).write.parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    q = accumulate.running_frequencies(stream).writeStream.outputMode("complete").format("memory").queryName("freqs").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("freqs")) == values(accumulate.running_frequencies(g))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert accumulate.event_windows(e).agg({"n": "sum"}).first()[0] == e.count() == accumulate.sessions(e).agg({"n": "sum"}).first()[0]


def test_many_bim_files_keep_all_chromosomes(spark, tmp_path):
    """Scaffolds are numbered far beyond a thousand; without a highest chromosome none is left out."""
    for k in (0, 1):
        (tmp_path / f"{k}.bim").write_text("".join(f"{c}\trs{c}\t0\t{c}\tA\tG\n" for c in (1 + k, 999 + k, 1001 + k, 2401 + k)))
    read = lambda s, p: text.read_bim(s, p, autosomes=1000)
    many = text.read_many(read, spark, [str(tmp_path / f"{k}.bim") for k in (0, 1)])
    assert sorted((r.file, r.chr, r.idx) for r in many.collect()) == [(k, c + k, i) for k in (0, 1) for i, c in enumerate((1, 999, 1001, 2401))]
    assert text.read_bim(spark, str(tmp_path / "0.bim"), high=999).count() == 2
