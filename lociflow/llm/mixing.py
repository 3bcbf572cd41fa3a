"""Mixing sources to target weights by blocks, with DataFrame operations alone.

A source's words, document after document, are cut into blocks of BLOCK words (the last may be short). The words that
a source gives make places of one block each: full passes over its blocks, then a part of one more, whose last place
may be cut short. The mix has as many slots as all sources have places, in output shards. Each slot draws a source, by
the sources' shares of places, so a shard's source counts are a multinomial draw. The draws of all shards stand in a
line for each source, and a keyed permutation sends draw to place; as draws miss a source's places by about the root
of their number, what a source draws too much goes to places that others draw too little. A place maps to a block by a
pseudorandom permutation of its source and pass, computed from its index alone, and blocks join by index. So each slot
of each shard has its block, and each source gives exactly its target's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import WORD, materialise, offsets

BLOCK = 256
#: Slots of an output shard at least, and output shards at most; beyond both, shards grow.
SHARD, MOST_SHARDS = 1024, 65_536
#: Cells that the range of draws is cut into, by which a draw finds its source.
CELLS = 1024
ROUNDS = 24
REPEATS = 3
SEED = 20240229


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 for each key: in each round an index changes places with its mirror around a keyed point,
    or not, as a hash of the greater of the two says; so a round undoes itself and no index needs a second try."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(SEED), *key, r) - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)).otherwise(index.cast("long"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with sid, target (double) and words (target as whole words).

    Sources by code point, null last, take the weights in turn. Sorted by what they may give per weight, the sources
    that stop at repeats * source_size come first; the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("sid", F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("most", F.col("cap") / F.col("weight"))
    before = Window.orderBy("most", "sid").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("level", left / weight_left)
    # the level rises while sources stop; that of the first that doesn't is what all others share by
    shared = shared.withColumn("final", F.min(F.when(F.col("most") > F.col("level"), F.struct("most", "sid", "level"))).over(all_)["level"])
    target = F.when(F.col("final").isNull() | (F.col("most") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return shared.withColumn("target", target).select("source", "source_size", "sid", "target", F.round("target").cast("long").alias("words"))


def numbered(docs: DataFrame) -> DataFrame:
    """Rows (rid, part, doc_id, source, size) of docs, written, so that rid stays the same."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"), "doc_id", "source", word_count().alias("size")))


def places(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source with places: how its places fill its blocks, and where they stand among all places.

    sources: as targets() gives them. whole blocks, blocks with a short one, full passes, whole blocks `more` of one
    more pass and the `last` words of one; n places, n_before of sources before, all of all sources.
    """
    full, rest = F.floor(F.col("words") / F.col("source_size")), F.col("words") % F.col("source_size")
    s = sources.where("source_size > 0").select("sid", F.floor(F.col("source_size") / block).alias("whole"), F.ceil(F.col("source_size") / block).alias("blocks"), full.alias("passes"), F.floor(rest / block).alias("more"), (rest % block).alias("last"))
    s = s.withColumn("n", F.col("passes") * F.col("blocks") + F.col("more") + (F.col("last") > 0).cast("long")).where("n > 0")
    return offsets(s, "sid", "n").withColumn("all", F.sum("n").over(Window.partitionBy()))


def draws(placed: DataFrame, shard: int = SHARD, most_shards: int = MOST_SHARDS) -> DataFrame:
    """(out_shard, sid, drawn, width): how many slots of each output shard draw each source; width: slots of the shard.

    A slot draws one of all places by a hash of its number, and so that place's source.
    """
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(shard).cast("long"), F.ceil(F.col("all") / most_shards))
    shards = placed.agg(F.max("all").alias("all")).where("all > 0").withColumn("width", size)
    shards = shards.withColumn("out_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / F.col("width"))))).repartition(tasks, "out_shard")
    first = F.col("out_shard") * F.col("width")
    held = F.least("width", F.col("all") - first)
    slots = shards.withColumn("slot", F.explode(F.sequence(first, first + held - 1)))
    step = F.ceil(F.col("all") / CELLS)
    drawn = slots.select("out_shard", held.alias("width"), F.pmod(F.xxhash64(F.lit(SEED + 2), "slot"), "all").alias("place"), step.alias("step")).withColumn("cell", F.floor(F.col("place") / F.col("step")))
    # CELLS rows, and one more for each source
    spans = placed.select("sid", "n_before", (F.col("n_before") + F.col("n")).alias("n_end"), F.explode(F.sequence(F.floor(F.col("n_before") / step), F.floor((F.col("n_before") + F.col("n") - 1) / step))).alias("cell"))
    found = drawn.join(spans, "cell").where("place >= n_before and place < n_end")
    return found.groupBy("out_shard", "sid").agg(F.count("*").alias("drawn"), F.first("width").alias("width"))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most_shards: int = MOST_SHARDS) -> DataFrame:
    """(out_shard, out_slot, sid, pass, block, words) of every slot of the mix, by its shard's draw.

    words is null for a whole block, else the number of its first words; pass counts from 0. Windows run over output
    shards, which are at most most_shards for a source.
    """
    placed = materialise(places(sources, block))
    counts = materialise(draws(placed, shard, most_shards))
    line = Window.partitionBy("sid").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("out_shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    runs = counts.withColumn("before", F.coalesce(F.sum("drawn").over(line), none)).withColumn("slot_before", F.coalesce(F.sum("drawn").over(inside), none))
    # what each source draws over or under its places, which add up to as much
    total = placed.select("sid", "n").join(counts.groupBy("sid").agg(F.sum("drawn").alias("sum")), "sid", "left").withColumn("sum", F.coalesce("sum", none))
    total = total.withColumn("over", F.greatest(none, F.col("sum") - F.col("n"))).withColumn("under", F.greatest(none, F.col("n") - F.col("sum")))
    total = materialise(offsets(total, "sid", "over", "under"))
    # few rows that make many: dealt to all tasks, and written, as both cases below read them
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = runs.join(total.select("sid", "n", "sum", "over_before"), "sid").repartition(tasks, "out_shard", "sid").withColumn("k", F.explode(F.sequence(none, F.col("drawn") - 1)))
    each = materialise(each.select("out_shard", permuted(F.col("slot_before") + F.col("k"), F.col("width"), F.lit(-1), F.col("out_shard")).alias("out_slot"), "sid", "n", "over_before", permuted(F.col("before") + F.col("k"), F.col("sum"), F.lit(-2), F.col("sid")).alias("j")))
    kept = each.where("j < n").select("out_shard", "out_slot", "sid", "j")
    spare = each.where("j >= n").select("out_shard", "out_slot", (F.col("j") - F.col("n") + F.col("over_before")).alias("spare"))
    open_ = total.where("under > 0").withColumn("k", F.explode(F.sequence(none, F.col("under") - 1))).select("sid", (F.col("sum") + F.col("k")).alias("j"), (F.col("under_before") + F.col("k")).alias("spare"))
    dealt = kept.unionByName(spare.join(open_, "spare").select("out_shard", "out_slot", "sid", "j"))
    dealt = dealt.join(placed.select("sid", "whole", "blocks", "passes", "more", "last"), "sid")
    dealt = dealt.withColumn("pass", F.least(F.floor(F.col("j") / F.col("blocks")), F.col("passes"))).withColumn("rank", F.col("j") - F.col("pass") * F.col("blocks"))
    # a short block stays last in each pass
    index = F.when(F.col("rank") < F.col("whole"), permuted(F.col("rank"), F.col("whole"), F.col("sid"), F.col("pass"))).otherwise(F.col("rank"))
    words = F.when((F.col("pass") == F.col("passes")) & (F.col("rank") == F.col("more")), F.col("last"))
    return dealt.select("out_shard", "out_slot", "sid", "pass", index.alias("block"), words.alias("words"))


def taken_pieces(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each slot takes of each document: (rid, doc_id, size, source_size, target, out_shard, out_slot, pass, at,
    n): n words of the document from word `at` on. One row with null slot and n = 0 for a document's stretch of a block
    that no slot takes, and for a document without words."""
    named = rows.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("of", "source", "words")
    parts = offsets(named.groupBy("sid", "part").agg(F.sum("size").alias("n")), "part", "n", by="sid")
    run = Window.partitionBy("sid", "part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.join(parts.select("sid", "part", "n_before"), ["sid", "part"]).withColumn("start", F.col("n_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    cut = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.select("rid", "doc_id", "size", "source_size", "target", "sid", "block", F.coalesce(low - F.col("start"), F.lit(0)).alias("at"), F.coalesce(high - low, F.lit(0)).alias("length"), (low - F.col("block") * block).alias("inside"))
    joined = cut.join(slots(sources, block), ["sid", "block"], "left")
    n = F.when(F.col("out_shard").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("length"), F.coalesce("words", F.lit(block)) - F.col("inside"))))
    return joined.select("rid", "doc_id", "size", "source_size", "target", "out_shard", "out_slot", "pass", "at", n.alias("n"))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("size").alias("source_size"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken and places of each row of docs (doc_id, text, source).

    size counts words; a null or empty text has none, and null is a source of its own, the last. The words taken from a
    source are its target rounded, and no document gives over `repeats` times its size. places says where the mix holds
    them: (out_shard, out_slot, at, n), n words of the document from word `at` on, in order of the slots. Repeated rows
    are rows of their own, as are rows without doc_id; other columns aren't read. The same files give the same mix.
    """
    rows = numbered(docs)
    sources = materialise(targets(source_sizes(rows), weights, repeats))
    pieces = taken_pieces(rows, sources, block)
    place = F.when(F.col("n") > 0, F.struct("out_shard", "out_slot", "at", "n"))
    out = pieces.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(place)).alias("places"))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "places")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each pass that takes a document, with the text's words
    that it takes (the whole text where all are) and n_chars, if there is one, of that text. A row belongs to the output
    shard and slot that first hold its words: rows of SHARD slots of an output shard (all of it, but in very large mixes)
    are in one partition, in the order of their slots."""
    columns = docs.columns
    kept = materialise(docs.select(F.monotonically_increasing_id().alias("__rid"), F.spark_partition_id().alias("__part"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")))
    rows = materialise(kept.select(F.col("__rid").alias("rid"), F.col("__part").alias("part"), F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count("row.text").alias("size")))
    sources = materialise(targets(source_sizes(rows), weights, repeats))
    pieces = taken_pieces(rows, sources, block).where("n > 0")
    # stretches of a document are as many as its blocks
    times = pieces.groupBy("rid", "pass", "size").agg(F.sum("n").alias("words"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"), F.min(F.struct("out_shard", "out_slot")).alias("first"))
    joined = kept.join(times, F.col("__rid") == F.col("rid"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["at"] + 1).cast("int"), s["n"].cast("int")))), "")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(cut)
    out = joined.withColumn("__text", text).repartition("first.out_shard", F.floor(F.col("first.out_slot") / SHARD)).sortWithinPartitions("first", "rid")
    chosen = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[chosen.get(c, F.col("row").getField(c)).alias(c) for c in columns])
