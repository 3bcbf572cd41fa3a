"""Queries of the file formats: each writes a file from the fixture's tables, reads it back, and has the SQL of what the
file holds. Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import relatedness as rel
from lociflow.plans.catalog import DOSE, GRM, SCAN, STEADY, WINDOW_R, R, _dosages, query, rounded, steady
from lociflow.plans.fixture import Fixture
from lociflow.plans.storage import keep, place
from lociflow.sources import binary, pgen, text


def line(*parts: str | Column) -> Column:
    """Fields (columns, or expressions as text) as one line: numbers as text, null as NA."""
    return F.concat_ws(" ", *[F.coalesce((F.expr(p) if isinstance(p, str) else p).cast("string"), F.lit("NA")) for p in parts])


def written(f: Fixture, rows: DataFrame, *fields: str | Column, order: str | None = None, head: tuple[str, ...] = ()) -> str:
    """Path of a text file of rows, after the lines of head; in one part, so that these come first."""
    spark = f.ind.sparkSession
    path = place(spark)
    # an order column is needed for formats whose lines count
    body = rows.select((F.col(order) if order else F.lit(0)).cast("long").alias("o"), line(*fields).alias("value"))
    top = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "o long, value string")
    top.unionByName(body).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


def spark_of(f: Fixture) -> SparkSession:
    return f.ind.sparkSession


F_, I_ = "concat('f', fid)", "concat('i', iid)"
F_SQL, I_SQL = "concat('f', fid) AS fid", "concat('i', ind.iid) AS iid"


def named(f: Fixture) -> DataFrame:
    return f.ind.join(f.pheno, "iid").withColumn("odd", F.when(F.col("iid") % 7 != 0, F.col("y")))


@query(f"SELECT {F_SQL}, {I_SQL}, '0' AS fa, '0' AS mo, CAST(CASE WHEN ind.iid % 11 = 0 THEN 0 ELSE sex END AS INT) AS sex, CASE WHEN ind.iid % 7 <> 0 THEN {R('y', 'pheno')[:-9]} END AS pheno FROM ind JOIN pheno ON ind.iid = pheno.iid")
def sc1_fam(f: Fixture) -> DataFrame:
    path = written(f, named(f), F_, I_, F.lit(0), F.lit(0), F.when(F.col("iid") % 11 == 0, F.lit("x")).otherwise(F.col("sex").cast("string")), F.coalesce(F.col("odd").cast("string"), F.lit("-9")))
    return rounded(text.read_fam(spark_of(f), path), "pheno")


@query(f"SELECT {F_SQL}, {I_SQL}, sex FROM ind")
def sc2_psam(f: Fixture) -> DataFrame:
    return text.read_psam(spark_of(f), written(f, f.ind, F_, I_, "sex", "bal", head=("##made here", "#FID IID SEX BAL")))


@query(f"SELECT {F_SQL}, {I_SQL}, CAST(ind.iid % 5 AS DOUBLE) / 8 AS missing FROM ind")
def sc3_oxford_sample(f: Fixture) -> DataFrame:
    return text.read_sample(spark_of(f), written(f, f.ind, F_, I_, F.col("iid") % 5 / 8, "sex", head=("ID_1 ID_2 missing sex", "0 0 0 D")))


@query("""SELECT 'all' AS of, (SELECT count(*) FROM (SELECT fid, iid FROM ind EXCEPT SELECT s_nationkey, s_suppkey + 1 FROM supplier)) = 0 AND (SELECT count(*) FROM ind) = (SELECT count(*) FROM supplier) AS same
UNION ALL SELECT 'women', (SELECT count(*) FROM (SELECT fid, iid FROM ind EXCEPT SELECT fid, iid FROM ind WHERE sex = 2)) = 0""")
def sc4_same_samples(f: Fixture) -> DataFrame:
    s = spark_of(f)
    one = text.read_fam(s, written(f, f.ind, F_, I_, F.lit(0), F.lit(0), "sex", F.lit(-9)))
    rows = [(name, text.same_samples(one, text.read_psam(s, written(f, some, F_, I_, "sex", head=("#FID IID SEX",))))) for name, some in (("all", f.ind), ("women", f.ind.where("sex = 2")))]
    return s.createDataFrame(rows, "of string, same boolean")


@query(f"SELECT DISTINCT {F_SQL}, {I_SQL} FROM ind WHERE iid % 3 = 0")
def sc5_id_list(f: Fixture) -> DataFrame:
    some = f.ind.where("iid % 3 = 0")
    return text.read_ids(spark_of(f), written(f, some.unionByName(some.where("iid % 6 = 0")), F_, I_))


@query(f"SELECT {F_SQL}, {I_SQL}, t.trait::INT AS trait, CASE t.trait WHEN 1 THEN CASE WHEN ind.iid % 7 <> 0 THEN round(y, 6) + 0.0 END ELSE round(bal, 6) + 0.0 END AS y FROM ind JOIN pheno ON ind.iid = pheno.iid CROSS JOIN (VALUES (1), (2)) t(trait)")
def sc5_phenotypes(f: Fixture) -> DataFrame:
    return rounded(text.read_phenotypes(spark_of(f), written(f, named(f), F_, I_, "odd", "bal", head=("FID IID y bal",))), "y")


BIM = ("chr", "name", "0", "bp", "lower(a1)", "a2")


@query("SELECT CAST(sid - 1 AS BIGINT) AS idx, chr, name, bp, a1, a2 FROM snp WHERE chr <= 22")
def sc6_bim(f: Fixture) -> DataFrame:
    b = text.read_bim(spark_of(f), written(f, f.snp, *BIM, order="sid"), high=22, autosomes=1000)
    return b.select(F.col("idx").cast("long").alias("idx"), "chr", "name", "bp", "a1", "a2")


@query("SELECT chr, name, bp, a1, a2 FROM snp")
def sc7_pvar(f: Fixture) -> DataFrame:
    return text.read_pvar(spark_of(f), written(f, f.snp, "chr", "bp", "name", "a2", F.lower("a1"), head=("##made here", "#CHROM POS ID REF ALT")), autosomes=1000)


@query("SELECT CAST(chr % 2 AS INT) AS file, count(*) AS n, sum(bp) AS bp FROM snp GROUP BY chr % 2")
def sc8_many_files(f: Fixture) -> DataFrame:
    read = lambda s, p: text.read_bim(s, p, autosomes=1000)
    many = text.read_many(read, spark_of(f), [written(f, f.snp.where(f"chr % 2 = {k}"), *BIM, order="sid") for k in (0, 1)])
    return many.groupBy("file").agg(F.count("*").alias("n"), F.sum("bp").cast("decimal(38,0)").cast("long").alias("bp"))


@query("SELECT iid, sid, CAST(gt AS DOUBLE) AS gt FROM g")
def sc9_bed(f: Fixture) -> DataFrame:
    from lociflow.operators.linkage import packed

    path = place(spark_of(f)) + ".bed"
    binary.write_bed(packed(f.g, f.snp), path)
    ids = [r.iid for r in f.ind.select("iid").orderBy("iid").collect()]
    back = binary.read_bed(spark_of(f), path, len(ids), f.snp.count())
    return back.select((F.col("iid") + 1).alias("iid"), (F.col("sid") + 1).alias("sid"), "gt")


@query(f"{DOSE} SELECT g.iid, g.sid, name, CAST(chr AS VARCHAR) AS chr, bp, a1, a2, round(1 - p1 - p2, 4) + 0.0 AS p0, round(p1, 4) + 0.0 AS p1, round(p2, 4) + 0.0 AS p2 FROM g JOIN snp ON g.sid = snp.sid LEFT JOIN d ON d.iid = g.iid AND d.sid = g.sid")
def sc10_bgen(f: Fixture) -> DataFrame:
    from lociflow.operators.linkage import packed

    path, spark = f"{place(spark_of(f))}.bgen", spark_of(f)
    probability = lambda p, name: packed(f.g.join(_dosages(f), ["iid", "sid"], "left").select("iid", "sid", p.alias("gt")), f.snp).select("sid", F.col("x").alias(name))
    both = probability(1 - F.col("p1") - F.col("p2"), "p0").join(probability(F.col("p1"), "p1"), "sid")
    binary.write_bgen(keep(both.join(f.snp, "sid")), path, f.ind.count())
    back = binary.read_bgen(spark, path)
    four = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return back.select((F.col("iid") + 1).alias("iid"), (F.col("sid") + 1).alias("sid"), "name", "chr", F.col("bp").cast("int").alias("bp"), "a1", "a2", four("p0"), four("p1"), four("p2"))


@query("SELECT iid, sid, CAST(gt AS DOUBLE) AS gt FROM g")
def sc12_pgen(f: Fixture) -> DataFrame:
    from lociflow.operators.linkage import packed

    path = place(spark_of(f)) + ".pgen"
    binary.write_pgen(packed(f.g, f.snp), path, f.ind.count())
    return binary.read_pgen(spark_of(f), path).select((F.col("iid") + 1).alias("iid"), (F.col("sid") + 1).alias("sid"), "gt")


@query(f"{DOSE} SELECT g.iid, g.sid, round(p1 + 2 * p2, 3) + 0.0 AS gt FROM g LEFT JOIN d ON d.iid = g.iid AND d.sid = g.sid UNION ALL SELECT iid, sid + 1000000, CAST(gt AS DOUBLE) FROM g")
def sc12_pgen_records(f: Fixture) -> DataFrame:
    """Dosages, and after them all hard calls again, as records of varying width."""
    from lociflow.operators.linkage import packed

    path, spark = f"{place(spark_of(f))}.pgen", spark_of(f)
    dosage = f.g.join(_dosages(f), ["iid", "sid"], "left").select("iid", "sid", (F.col("p1") + 2 * F.col("p2")).alias("gt"))
    m = f.snp.count()
    markers = packed(dosage).select("sid", "x").unionByName(packed(f.g).select((F.col("sid") + m).alias("sid"), "x"))
    pgen.write_pgen_records(markers, path, f.ind.count())
    back = pgen.read_pgen(spark, path)
    sid = F.when(F.col("sid") < m, F.col("sid") + 1).otherwise(F.col("sid") - m + 1_000_001)
    return back.select((F.col("iid") + 1).alias("iid"), sid.alias("sid"), (F.round("gt", 3) + F.lit(0.0)).alias("gt"))


@query(f"{GRM} SELECT i - 1 AS i, j - 1 AS j, CAST(n AS DOUBLE) AS n, round(value, 4) + 0.0 AS value FROM grm")
def sc16_grm_text(f: Fixture) -> DataFrame:
    a = text.read_grm_text(spark_of(f), written(f, rel.grm(f.g), "i", "j", "n", "value"))
    return a.withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(f"{GRM} SELECT i - 1 AS i, j - 1 AS j, CAST(n AS DOUBLE) AS n, round(value, 4) + 0.0 AS value FROM grm")
def sc16_grm_binary(f: Fixture) -> DataFrame:
    path = place(spark_of(f))
    binary.write_grm(rel.grm(f.g), [], path)
    return binary.read_grm(spark_of(f), path, f.ind.count()).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(f"{GRM}, sp AS (SELECT i, j, value FROM grm WHERE i = j OR value >= 0.05) SELECT i, j, {R('value', 'value')} FROM sp UNION ALL SELECT j AS i, i AS j, {R('value', 'value')} FROM sp WHERE i <> j")
def sc17_sparse_grm(f: Fixture) -> DataFrame:
    return rounded(text.read_sparse_grm(spark_of(f), written(f, rel.sparse(rel.grm(f.g), 0.05), "i", "j", "value")), "value")


@query(f"SELECT {F_SQL}, {I_SQL}, {R('bal', 'c1')}, CAST(sex AS DOUBLE) AS c2 FROM ind WHERE iid % 7 <> 0")
def sc18_quantitative_covariates(f: Fixture) -> DataFrame:
    return rounded(text.read_covariates(spark_of(f), written(f, f.ind, F_, I_, F.when(F.col("iid") % 7 != 0, F.col("bal")), "sex")), "c1")


@query(f"SELECT {F_SQL}, {I_SQL}, seg AS c1 FROM ind")
def sc18_discrete_covariates(f: Fixture) -> DataFrame:
    return text.read_covariates(spark_of(f), written(f, f.ind, F_, I_, "seg"), quantitative=False)


@query(f"{SCAN} SELECT concat('rs', sid) AS snp, a1, a2, {STEADY('af', 'freq')}, {STEADY('b', 'b')}, {STEADY('se', 'se')}, CAST(n AS DOUBLE) AS n FROM (SELECT scan.*, snp.a1, snp.a2 FROM scan JOIN snp ON scan.sid = snp.sid) WHERE sid % 9 <> 0")
def sc19_summary_statistics(f: Fixture) -> DataFrame:
    from lociflow.operators.association import linear_scan

    d = linear_scan(f.g, f.pheno).join(f.snp.select("sid", "name", "a1", "a2"), "sid")
    path = written(f, d, "name", F.lower("a1"), "a2", "af", F.when(F.col("sid") % 9 != 0, F.col("b")), "se", F.lit(0.5), "n", head=("SNP A1 A2 freq b se p N",))
    return steady(text.read_sumstat(spark_of(f), path).drop("p"), "freq", "b", "se")


@query("SELECT concat('t', pop) AS name, concat('file', pop) AS file, CASE WHEN pop > 1 THEN pop / 10 END AS sample_prevalence, CASE WHEN pop > 1 THEN pop / 20 END AS population_prevalence FROM (SELECT DISTINCT CAST(pop AS DOUBLE) AS p, pop FROM ind)")
def sc20_trait_list(f: Fixture) -> DataFrame:
    pops = f.ind.select("pop").distinct()
    path = written(f, pops, F.concat(F.lit("t"), "pop"), F.concat(F.lit("file"), "pop"), F.when(F.col("pop") > 1, F.col("pop") / 10), F.when(F.col("pop") > 1, F.col("pop") / 20))
    return spark_of(f).createDataFrame([tuple(t.values()) for t in text.read_trait_list(spark_of(f), path)], "name string, file string, sample_prevalence double, population_prevalence double")


@query("SELECT name AS snp, CAST(1 + sid % 13 AS DOUBLE) / 8 AS l2 FROM snp")
def sc21_ld_scores(f: Fixture) -> DataFrame:
    return text.read_ld_scores(spark_of(f), written(f, f.snp, "chr", "name", "bp", (1 + F.col("sid") % 13) / 8, head=("CHR SNP BP L2",)))


@query("SELECT concat('g', chr, '_', t) AS name, chr, CAST(1000 + t * 100000 AS BIGINT) AS start, CAST(91000 + t * 100000 AS BIGINT) AS \"end\" FROM (SELECT DISTINCT chr, CAST((bp - 1000) // 100000 AS BIGINT) AS t FROM snp WHERE chr <= 22)")
def sc22_genes(f: Fixture) -> DataFrame:
    return text.read_genes(spark_of(f), written(f, f.genes.where("chr <= 22"), "chr", "start", "end", "name"))


@query("SELECT DISTINCT concat('set', blk % 9) AS name, name AS snp FROM snp")
def sc22_sets(f: Fixture) -> DataFrame:
    sets = f.snp.groupBy(F.concat(F.lit("set"), F.col("blk") % 9).alias("s")).agg(F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("v"))
    return text.read_sets(spark_of(f), written(f, sets, F.concat("s", F.lit("\n"), "v", F.lit("\nEND"))))


@query(f"SELECT {F_SQL}, {I_SQL}, concat('p', k) AS probe, CASE WHEN (ind.iid + k) % 6 <> 0 THEN {R('bal * k', 'v')[:-5]} END AS val FROM ind CROSS JOIN range(1, 5) r(k)")
def sc23_expression(f: Fixture) -> DataFrame:
    values = [F.when((F.col("iid") + k) % 6 != 0, F.col("bal") * k) for k in range(1, 5)]
    return rounded(text.read_probes(spark_of(f), written(f, f.ind, F_, I_, *values, head=("FID IID p1 p2 p3 p4",))), "val")


@query("SELECT name AS snp, CASE WHEN sid % 2 = 0 THEN CAST(sid AS DOUBLE) / 16 END AS effect FROM snp WHERE sid % 5 = 0")
def sc24_effects(f: Fixture) -> DataFrame:
    some = f.snp.where("sid % 5 = 0")
    return text.read_effects(spark_of(f), written(f, some, F.when(F.col("sid") % 2 == 0, F.concat_ws(" ", "name", (F.col("sid") / 16).cast("string"))).otherwise(F.col("name"))))


@query("SELECT CAST(2 AS INT) AS chr, CAST(bp AS BIGINT) AS pos, CAST(bp AS DOUBLE) / 1024 AS map_cm FROM snp WHERE chr = 2")
def sc25_genetic_map(f: Fixture) -> DataFrame:
    return text.read_genetic_map(spark_of(f), written(f, f.snp.where("chr = 2"), "bp", F.lit(1), F.col("bp") / 1024, head=("position rate map",)), 2)


def dose(sid: str = "sid", iid: str = "iid") -> Column:
    return (F.col(sid) * 7 + F.col(iid) * 3) % 17 / 8


@query("SELECT concat('i', ind.iid) AS iid, name, CAST((sid * 7 + iid * 3) % 17 AS DOUBLE) / 8 AS dose FROM ind CROSS JOIN snp WHERE sid <= 60 AND sid % 10 >= 3")
def sc13_mach(f: Fixture) -> DataFrame:
    some = f.snp.where("sid <= 60")
    info = written(f, some, "name", "a1", "a2", F.lit(0), F.lit(0), F.lit(0), F.col("sid") % 10 / 10, order="sid", head=("SNP A1 A2 F M Q Rsq",))
    rows = f.ind.join(some).groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("sid", dose().alias("d")))).alias("v"))
    doses = written(f, rows, F.concat(F.lit("f->i"), "iid"), F.lit("ML_DOSE"), F.array_join(F.transform("v", lambda x: x["d"].cast("string")), " "))
    return text.read_mach(spark_of(f), info, doses, 0.3)


@query("SELECT concat('i', ind.iid) AS iid, name, CAST((sid * 7 + iid * 3) % 17 AS DOUBLE) / 8 AS dose FROM ind CROSS JOIN snp WHERE sid <= 60")
def sc14_beagle(f: Fixture) -> DataFrame:
    ids = [r.iid for r in f.ind.select("iid").orderBy("iid").collect()]
    rows = f.ind.join(f.snp.where("sid <= 60")).groupBy("name", "a1", "a2").agg(F.array_sort(F.collect_list(F.struct("iid", dose().alias("d")))).alias("v"))
    path = written(f, rows, "name", "a1", "a2", F.array_join(F.transform("v", lambda x: x["d"].cast("string")), " "), head=("marker alleleA alleleB " + " ".join(f"i{i}" for i in ids),))
    return text.read_beagle(spark_of(f), path)


@query("SELECT concat('i', iid) AS iid, name, CASE WHEN q >= 7 THEN a1 ELSE '0' END AS a1, CASE WHEN q >= 7 THEN a2 ELSE '0' END AS a2 FROM (SELECT iid, name, a1, a2, (iid + sid) % 11 AS q FROM ind CROSS JOIN snp WHERE sid <= 60)")
def sc15_array_report(f: Fixture) -> DataFrame:
    rows = f.ind.join(f.snp.where("sid <= 60")).select(F.concat_ws(",", "name", F.concat(F.lit("i"), "iid"), F.lower("a1"), "a2", ((F.col("iid") + F.col("sid")) % 11 / 10).cast("string")).alias("v"))
    return text.read_raw_genotypes(spark_of(f), written(f, rows, "v", head=("[Data]",)), skip=1)


@query(f"{WINDOW_R.format(w=100000)} SELECT sid1, sid2, {R('CAST(s / (n - 1) AS FLOAT)::DOUBLE', 'r')} FROM wp CROSS JOIN nn")
def sk8_ld_windows(f: Fixture) -> DataFrame:
    from lociflow.operators import linkage

    path = place(spark_of(f))
    varies = f.g.groupBy("sid").agg(F.min("gt").alias("a"), F.max("gt").alias("b")).where("a < b").select("sid")
    binary.write_ld(linkage.window_pairs(f.g, f.snp, 100_000), f.snp.join(varies, "sid"), path)
    return rounded(binary.read_ld(spark_of(f), path), "r")


@query("SELECT concat('rs', sid) AS snp, a1, (sid % 11 - 5) / 10.0::DOUBLE AS effect FROM snp")
def x3_effects(f: Fixture) -> DataFrame:
    path = place(spark_of(f))
    text.write_effects(f.snp.select(F.col("name").alias("snp"), "a1", F.lit(0.25).alias("freq"), ((F.col("sid") % 11 - 5) / 10.0).alias("effect")), path)
    back = spark_of(f).read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.col("QTL").alias("snp"), F.col("RefAllele").alias("a1"), F.col("Effect").cast("double").alias("effect"))
