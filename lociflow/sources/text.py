"""Readers of the text formats: a DataFrame for each, with missing tokens as null and alleles in upper case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.ranks import numbered_lines
from lociflow.functions.text import chromosome, number, tokens


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines (plain or gz) as arrays of fields `t`."""
    return spark.read.text(path).where(F.trim("value") != "").select(tokens(F.col("value")).alias("t"))


def _field(k: int):
    return F.col("t")[k]


def _text(k: int):
    return F.when(~F.upper(_field(k)).isin("NA", "NAN", "."), _field(k))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, fa, mo, sex (1, 2, else 0), pheno."""
    sex = F.coalesce(F.when(_field(4).isin("1", "2"), _field(4).cast("int")), F.lit(0))
    return lines(spark, path).where(F.size("t") >= 6).select(_field(0).alias("fid"), _field(1).alias("iid"), _field(2).alias("fa"), _field(3).alias("mo"), sex.alias("sex"), number(_field(5)).alias("pheno"))


def _headed(spark: SparkSession, path: str, mark: str = "#") -> tuple[list[str], DataFrame]:
    """Names of the last line that starts with mark (the first line otherwise), and the lines that don't."""
    head = [r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(200).collect()]
    marked = [x for x in head if x.startswith(mark)]
    names = (marked[-1] if marked else head[0]).lstrip(mark).split()
    body = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(mark)))
    if not marked:
        body = body.where(F.col("value") != head[0])
    return names, body.select(tokens(F.col("value")).alias("t"))


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, sex of a headed sample file; without FID, iid serves for both."""
    names, body = _headed(spark, path)
    at = {n.upper(): i for i, n in enumerate(names)}
    if "IID" not in at or "SEX" not in at:
        raise ValueError("IID and SEX are needed")
    sex = F.coalesce(F.when(_field(at["SEX"]).isin("1", "2"), _field(at["SEX"]).cast("int")), F.lit(0))
    return body.select(_field(at.get("FID", at["IID"])).alias("fid"), _field(at["IID"]).alias("iid"), sex.alias("sex"))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, missing of a sample file with two header lines, which must name ID_1 ID_2 missing and then types."""
    head = [r.value.split() for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2 or [x.lower() for x in head[0][:3]] != ["id_1", "id_2", "missing"] or head[1][:3] != ["0", "0", "0"]:
        raise ValueError("not a sample file")
    body = lines(spark, path).where(~((F.lower(_field(0)) == "id_1") | ((_field(0) == "0") & (_field(1) == "0") & (_field(2) == "0"))))
    return body.select(_field(0).alias("fid"), _field(1).alias("iid"), number(_field(2)).alias("missing"))


def same_samples(one: DataFrame, two: DataFrame) -> bool:
    """Whether two files list the same individuals."""
    a, b = one.select("fid", "iid"), two.select("fid", "iid")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def read_ids(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    names = ("fid", "iid")[:columns] if columns == 2 else ("name",)
    return lines(spark, path).select(*[_field(k).alias(n) for k, n in enumerate(names)]).distinct()


def read_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(fid, iid, trait from 1, y): a row for each value, null where missing."""
    values = F.posexplode(F.slice("t", 3, 1_000_000)).alias("k", "v")
    return lines(spark, path).where(~F.upper(_field(0)).isin("FID", "#FID")).select(_field(0).alias("fid"), _field(1).alias("iid"), values).select("fid", "iid", (F.col("k") + 1).alias("trait"), number(F.col("v")).alias("y"))


def read_covariates(spark: SparkSession, path: str, quantitative: bool = True) -> DataFrame:
    """fid, iid and c1, c2, ... of complete rows; numbers or levels."""
    rows = lines(spark, path).where(~F.upper(_field(0)).isin("FID", "#FID"))
    first = rows.first()
    n = len(first.t) - 2 if first else 0
    make = number if quantitative else (lambda c: F.when(~F.upper(c).isin("NA", "NAN", ".", "-9"), c))
    return rows.select(_field(0).alias("fid"), _field(1).alias("iid"), *[make(_field(k + 2)).alias(f"c{k + 1}") for k in range(n)]).dropna()


def read_bim(spark: SparkSession, path: str, low: int = 1, high: int | None = None, autosomes: int = 22) -> DataFrame:
    """idx (order in the file), chr, name, gd, bp, a1, a2; chromosomes outside low..high are left out, without high those
    under low alone."""
    rows = numbered_lines(lines(spark, path), "idx").withColumn("idx", F.col("idx").cast("int"))
    out = rows.select("idx", chromosome(_field(0), autosomes).alias("chr"), _field(1).alias("name"), number(_field(2)).alias("gd"), _field(3).cast("int").alias("bp"), F.upper(_field(4)).alias("a1"), F.upper(_field(5)).alias("a2"))
    return out.where((F.col("chr") >= low) if high is None else F.col("chr").between(low, high))


def read_pvar(spark: SparkSession, path: str, autosomes: int = 22) -> DataFrame:
    """chr, name, bp, a1 (ALT), a2 (REF); the header names the columns, else chr id [cm] bp alt ref."""
    head = [r.value for r in spark.read.text(path).limit(200).collect() if r.value.startswith("#")]
    if head:
        names, body = _headed(spark, path)
        at = {n.upper(): i for i, n in enumerate(names)}
        k = [at[n] for n in ("CHROM", "ID", "POS", "ALT", "REF")]
    else:
        body = lines(spark, path)
        k = [0, 1, 3, 4, 5] if len(body.first().t) >= 6 else [0, 1, 2, 3, 4]
    return body.select(chromosome(_field(k[0]), autosomes).alias("chr"), _field(k[1]).alias("name"), _field(k[2]).cast("int").alias("bp"), F.upper(_field(k[3])).alias("a1"), F.upper(_field(k[4])).alias("a2"))


def read_many(read, spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files of a format, with the file's number."""
    out = None
    for k, p in enumerate(paths):
        d = read(spark, p).withColumn("file", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


def read_mach(spark: SparkSession, info: str, dose: str, least_rsq: float = 0.0) -> DataFrame:
    """(iid, name, dose) of MaCH dosages, for markers of at least this Rsq."""
    markers = numbered_lines(lines(spark, info).where(F.upper(_field(0)) != "SNP"), "k").select("k", _field(0).alias("name"), number(_field(6)).alias("rsq"))
    rows = lines(spark, dose).select(F.element_at(F.split(_field(0), "->"), -1).alias("iid"), F.posexplode(F.slice("t", 3, 10_000_000)).alias("k", "v"))
    return rows.join(markers.where(F.col("rsq") >= least_rsq), "k").select("iid", "name", number(F.col("v")).alias("dose"))


def read_beagle(spark: SparkSession, dose: str) -> DataFrame:
    """(iid, name, dose) of marker-major dosages: marker, alleles A and B, then a value for each individual."""
    head = spark.read.text(dose).first().value.split()
    rows = lines(spark, dose).where(_field(0) != head[0]).select(_field(0).alias("name"), F.posexplode(F.slice("t", 4, 10_000_000)).alias("k", "v"))
    return rows.select(F.element_at(F.array(*[F.lit(x) for x in head[3:]]), F.col("k") + 1).alias("iid"), "name", number(F.col("v")).alias("dose"))


def read_raw_genotypes(spark: SparkSession, path: str, skip: int = 0, cutoff: float = 0.7) -> DataFrame:
    """(iid, name, a1, a2) of an array report SNP, sample, allele 1, allele 2, GenCall score; low scores give 0."""
    rows = numbered_lines(spark.read.text(path), "k").where(F.col("k") >= skip)
    t = rows.select(tokens(F.regexp_replace("value", "[,\t]", " ")).alias("t"))
    good = number(_field(4)) >= cutoff
    return t.select(_field(1).alias("iid"), _field(0).alias("name"), F.when(good, F.upper(_field(2))).otherwise("0").alias("a1"), F.when(good, F.upper(_field(3))).otherwise("0").alias("a2"))


def read_grm_text(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, n, value) of lower-triangle text, whose ids start at 1; ours start at 0."""
    return lines(spark, path).select((_field(0).cast("long") - 1).alias("i"), (_field(1).cast("long") - 1).alias("j"), number(_field(2)).alias("n"), _field(3).cast("double").alias("value"))


def read_sparse_grm(spark: SparkSession, path: str) -> DataFrame:
    """Both halves (i, j, value) of a sparse matrix of 0-based pairs."""
    a = lines(spark, path).select(_field(0).cast("long").alias("i"), _field(1).cast("long").alias("j"), _field(2).cast("double").alias("value"))
    return a.unionByName(a.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def read_sumstat(spark: SparkSession, path: str) -> DataFrame:
    """snp, a1, a2, freq, b, se, p, n; rows with a missing effect or error, or se 0, are left out."""
    rows = lines(spark, path).where(F.size("t") >= 8).select(_field(0).alias("snp"), F.upper(_field(1)).alias("a1"), F.upper(_field(2)).alias("a2"), *[_field(k).try_cast("double").alias(n) for k, n in ((3, "freq"), (4, "b"), (5, "se"), (6, "p"), (7, "n"))])
    return rows.where("b is not null and se > 0")


def read_trait_list(spark: SparkSession, path: str) -> list[dict]:
    """Traits with their files and prevalences, on the driver."""
    out = []
    for r in lines(spark, path).collect():
        v = [None if x.upper() in ("NA", ".") else float(x) for x in r.t[2:4]] + [None, None]
        out.append({"name": r.t[0], "file": r.t[1], "sample_prevalence": v[0], "population_prevalence": v[1]})
    return out


def read_ld_scores(spark: SparkSession, path: str) -> DataFrame:
    """snp and l2: the second and the last column of score files (a glob over chromosomes, plain or gz)."""
    return lines(spark, path).where(F.upper(_field(0)) != "CHR").select(_field(1).alias("snp"), F.element_at("t", -1).cast("double").alias("l2"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """name, chr, start, end: without a header `chr start end name`, with one by its names."""
    head = spark.read.text(path).first().value.split()
    rows = lines(spark, path)
    if head[0].lower() == "gene":
        return rows.where(F.lower(_field(0)) != "gene").select(_field(0).alias("name"), chromosome(_field(1)).alias("chr"), _field(2).cast("long").alias("start"), _field(3).cast("long").alias("end"))
    return rows.select(_field(3).alias("name"), chromosome(_field(0)).alias("chr"), _field(1).cast("long").alias("start"), _field(2).cast("long").alias("end"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, snp), distinct, of a stream of tokens: a set's name, its markers, END."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\bEND\b")).alias("v")).where(F.trim(F.regexp_replace("v", r"\s+", " ")) != "")
    t = text.select(tokens(F.col("v")).alias("t"))
    return t.select(_field(0).alias("name"), F.explode(F.slice("t", 2, 10_000_000)).alias("snp")).distinct()


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(fid, iid, probe, val) of a matrix headed FID IID probe names; -9 and NA are null."""
    head = spark.read.text(path).first().value.split()
    names = F.array(*[F.lit(x) for x in head[2:]])
    rows = lines(spark, path).where(_field(0) != head[0]).select(_field(0).alias("fid"), _field(1).alias("iid"), F.posexplode(F.slice("t", 3, 1_000_000)).alias("k", "v"))
    return rows.select("fid", "iid", F.element_at(names, F.col("k") + 1).alias("probe"), number(F.col("v")).alias("val"))


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """(snp, effect) of causal markers; effect is null where the file has none."""
    return lines(spark, path).select(_field(0).alias("snp"), F.when(F.size("t") > 1, F.get("t", F.lit(1)).try_cast("double")).alias("effect"))


def read_genetic_map(spark: SparkSession, path: str, chr_: int) -> DataFrame:
    """(chr, pos, map_cm) of a HapMap file: position, rate, distance."""
    return lines(spark, path).where(_field(0).try_cast("long").isNotNull()).select(F.lit(chr_).alias("chr"), _field(0).cast("long").alias("pos"), _field(2).cast("double").alias("map_cm"))


def write_text(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated text, missing values as NA."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", "NA").csv(path)


def write_effects(effects: DataFrame, path: str) -> None:
    """A simulation's effects(snp, a1, freq, effect): header QTL, RefAllele, Frequency, Effect."""
    write_text(effects.select(F.col("snp").alias("QTL"), F.col("a1").alias("RefAllele"), F.col("freq").alias("Frequency"), F.col("effect").alias("Effect")), path)


def write_phenotypes(y: DataFrame, path: str) -> None:
    """Lines of family, individual and the phenotypes in the order of y's further columns, NA where missing; no header."""
    write_text(y, path, header=False)


def write_genotype_matrix(g: DataFrame, path: str) -> None:
    """A line for each individual: iid, then its calls by sid, NA where missing. g: (iid, sid, gt), all pairs."""
    calls = F.array_sort(F.collect_list(F.struct("sid", F.coalesce(F.col("gt").cast("string"), F.lit("NA")).alias("v"))))
    rows = g.groupBy("iid").agg(calls.alias("calls"))
    rows.select(F.concat_ws(" ", F.col("iid").cast("string"), F.array_join(F.transform("calls", lambda c: c["v"]), " "))).write.mode("overwrite").text(path)


def read_genotype_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(iid, place from 0, gt) of such a matrix."""
    return lines(spark, path).select(_field(0).cast("long").alias("iid"), F.posexplode(F.slice("t", 2, 100_000_000)).alias("place", "v")).select("iid", "place", number(F.col("v")).alias("gt"))


def write_model(spark: SparkSession, path: str, **parts) -> None:
    """A fitted model's arrays and numbers, by name, as one Parquet table (name, shape, values)."""
    import numpy as np

    rows = [(k, list(np.shape(v)), [float(x) for x in np.ravel(v)]) for k, v in parts.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> dict:
    """The arrays (numbers: arrays without dimension) that write_model() wrote."""
    import numpy as np

    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
