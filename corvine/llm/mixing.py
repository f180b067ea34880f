"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets are shares of all sizes by weight; a target stops at ``MOST`` times its source's size and
the excess is shared again.  A source's documents are dealt into blocks by hash.  Whole passes over
a source take every block once; the rest of the target takes blocks in a permuted order, and of the
last block the documents that come nearest to what is missing.  That fixes how many blocks each
source gives (its quota).  A tree then splits the quotas among the output shards: at each node the
left half's part of every source is a hypergeometric draw given what the sources before it got, so
each shard gets an exact number of blocks and the quotas are kept exactly.  A source's block draws
go to the shards in runs of the permuted order, hence disjoint; inside a shard rows are ordered by
a hash that is fresh for each copy.

All of it is DataFrame operations.  Block tables have at most ``2 ** 16`` rows and one a source, and
tables by source one row a source; documents meet them by equi-joins and are never exploded.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own,
the last; repeated rows are separate documents, but those with equal ids share a fate; an empty table
gives an empty result.  Draws depend on ids, sources and the seed only, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept
from .quality_rules import words_of

MOST, BLOCK_WORDS, BLOCKS, FILLS = 3, 1 << 17, 1 << 16, 4


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = MOST) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: water filling with caps in one sorted pass.

    With sources sorted by cap over weight, those below the water level stop at their cap; the level
    is the first ``(total - caps before) / weights from here`` that is not above the source's own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), pick))
    weighed = weighed.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("own", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("own", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("own"), F.struct("own", "level"))).over(everything)
    return leveled.withColumn("target", F.least("cap", F.coalesce(water["level"], F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "weight", "target")


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Marked items among ``drawn`` of ``population``, by inversion around the mode.

    Weights relative to the mode are summed ten and more standard deviations to both sides.
    """

    def ratio(k: Column) -> Column:  # weight of k + 1 over that of k
        return (marked - k) * (drawn - k) / ((k + 1) * (population - marked - drawn + k + 1))

    low, high = F.greatest(F.lit(0), drawn + marked - population), F.least(drawn, marked)
    spread = F.sqrt(drawn * (marked / population) * (1 - marked / population)) * 10 + 10
    state = lambda w, s: F.struct(w.alias("w"), s.alias("s"))
    one = state(F.lit(1.0), F.lit(0.0))

    def around(mode: Column) -> Column:
        first, last = F.greatest(low, mode - F.ceil(spread)), F.least(high, mode + F.ceil(spread))
        steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        up = F.aggregate(steps(mode, last - 1), one, lambda a, k: state(a["w"] * ratio(k), a["s"] + a["w"] * ratio(k)))
        down = F.aggregate(F.reverse(steps(first, mode - 1)), one, lambda a, k: state(a["w"] / ratio(k), a["s"] + a["w"] / ratio(k)))

        def invert(d: Column) -> Column:
            goal = uniform * (1 + up["s"] + d["s"])
            begin = F.struct(d["w"].alias("w"), d["w"].alias("s"), first.alias("k"))
            walk = lambda a, k: F.when(a["s"] >= goal, a).otherwise(F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"] * ratio(k)).alias("s"), (k + 1).alias("k")))
            return F.aggregate(steps(first, last - 1), begin, walk, lambda a: a["k"])

        return _let(down, invert)

    mode = F.floor((drawn + 1) * (marked + 1) / (population + 2))
    return F.when(low >= high, low).otherwise(_let(F.greatest(low, F.least(high, mode)), around))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, place, blocks`` from one row with the array ``quotas``; ``shards`` is a power of two."""
    nodes = quotas.select(F.lit(0).alias("shard"), F.col("quotas").cast("array<bigint>").alias("quotas"))
    for depth in range(int(math.log2(shards))):

        def uniform(place: Column, depth: int = depth) -> Column:
            return (F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), F.col("shard"), place), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
        start = F.struct(total.alias("all"), F.floor((total + F.pmod(F.col("shard"), F.lit(2))) / 2).cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("got"))
        step = lambda a, q: _let(hypergeometric(a["all"], q, a["left"], uniform(F.size(a["got"]))).cast("bigint"), lambda x: F.struct((a["all"] - q).alias("all"), (a["left"] - x).alias("left"), F.concat(a["got"], F.array(x)).alias("got")))
        nodes = nodes.withColumn("got", F.aggregate("quotas", start, step, lambda a: a["got"]))
        rest = F.zip_with("quotas", "got", lambda q, x: q - x)
        half = F.explode(F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("got").alias("quotas")), F.struct((2 * F.col("shard") + 1).alias("shard"), rest.alias("quotas"))))
        nodes = nodes.select(half.alias("half")).select("half.*")
    return nodes.select("shard", F.posexplode("quotas").alias("place", "blocks"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), shards: int = 8, seed: int = 11, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``mix_size, mix_source_size, mix_target, mix_places``.

    ``mix_places`` has ``copy, shard, key`` for each time the mix takes the row: rows of a shard in
    the order of ``key`` are the shuffled output.
    """
    size = F.coalesce(F.size(words_of(docs[text].cast("string"))), F.lit(0))
    rows = docs.withColumns({"mix_size": F.when(docs[text].isNull(), 0).otherwise(size).cast("long"), "mix_source": docs[source].cast("string"), "mix_hash": F.xxhash64(F.lit(seed), docs[doc_id].cast("string"))})
    slim = kept(rows.select(docs[doc_id].cast("string").alias("id"), "mix_source", "mix_hash", "mix_size"))
    sources = slim.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"))
    named = targets(sources, weights)
    block_words = F.greatest(F.lit(BLOCK_WORDS), F.ceil(F.sum("source_size").over(Window.partitionBy()) / BLOCKS))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    named = named.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    named = named.withColumn("passes", passes.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    named = kept(named.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))

    def blocked(frame: DataFrame, *more: str) -> DataFrame:
        own = named.select(F.col("source").alias("of_source"), "n_blocks", *more)
        joined = frame.join(own, F.col("mix_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
        return joined.withColumn("mix_block", F.pmod("mix_hash", "n_blocks")).drop("n_blocks")

    sums = blocked(slim).groupBy("mix_source", "mix_block").agg(F.sum("mix_size").alias("words"))
    blocks = sums.join(named.withColumnRenamed("source", "of_source"), F.col("mix_source").eqNullSafe(F.col("of_source"))).drop("of_source")
    permuted = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed), "mix_block"), "mix_block")
    blocks = blocks.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    lacking = F.col("rest") - F.col("before")
    blocks = blocks.withColumn("part", F.when(F.col("words") <= lacking, "whole").when((lacking > 0.5) & (F.col("words") > 0), "cut").otherwise("none"))
    blocks = kept(blocks.select("mix_source", "mix_block", "place", "passes", "rank", "part", lacking.alias("lacking")))

    cut = blocked(slim).join(_renamed(blocks.where("part = 'cut'").select("mix_source", "mix_block", "lacking")), _same_block(), "inner")
    cut = cut.groupBy("mix_source", "id", "mix_hash", "lacking").agg(F.sum("mix_size").alias("words")).where("words > 0")
    along = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    whole = Window.partitionBy("mix_source")
    cut = cut.withColumn("taken", F.lit(False)).withColumn("missing", F.col("lacking"))
    downward = Window.partitionBy("mix_source").orderBy(F.desc("words"), F.xxhash64(F.lit(seed + 1), "id"), "id")
    for turn in range(1 + FILLS):  # in permuted order while there is room for the largest; then the largest that still fit
        goal = F.col("missing") - (F.max("words").over(whole) if turn == 0 else 0)
        cut = cut.withColumn("goal", goal).withColumn("able", ~F.col("taken") & (F.col("words") <= F.col("goal")))
        cut = cut.withColumn("upto", F.sum(F.when(F.col("able"), F.col("words")).otherwise(0)).over(downward if turn else along))
        cut = cut.withColumn("now", F.col("able") & (F.col("upto") <= F.col("goal")))
        filled = F.sum(F.when(F.col("now"), F.col("words")).otherwise(0)).over(whole)
        cut = cut.withColumn("missing", F.col("missing") - filled).withColumn("taken", F.col("taken") | F.col("now"))
    cut = cut.withColumn("off", F.when(~F.col("taken"), F.abs(F.col("missing") - F.col("words"))))
    cut = cut.withColumn("nearest", F.min(F.struct(F.col("off").isNull(), "off", "id")).over(whole))
    nearest = F.col("nearest")
    fits = (F.col("id") == nearest["id"]) & (F.col("off") < F.col("missing"))
    cut = cut.withColumn("fits", F.coalesce(fits, F.lit(False)))
    extra = kept(cut.where("taken or fits").select(F.col("id").alias("cut_id"), F.lit(True).alias("cut_taken")).distinct())

    quota = F.col("passes") * F.count("*").over(Window.partitionBy("place")) + F.sum((F.col("part") != "none").cast("long")).over(Window.partitionBy("place"))
    counted = blocks.withColumn("quota", quota).select("place", "quota").distinct()
    order = counted.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("all"))
    shares = split_quotas(order.select(F.transform("all", lambda x: x["quota"]).alias("quotas")), shards, seed)
    ends = shares.withColumn("end", F.sum("blocks").over(Window.partitionBy("place").orderBy("shard")))
    ends = ends.where("blocks > 0").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    per_pass = F.count("*").over(Window.partitionBy("place"))
    copies = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("part") == "none", 1).otherwise(0))
    copies = F.when((F.col("passes") == 0) & (F.col("part") == "none"), F.array().cast("array<bigint>")).otherwise(copies)
    drawn = blocks.withColumn("per_pass", per_pass).join(ends, "place", "left")
    at = lambda c: F.get(F.filter("ends", lambda e: e["end"] > c * F.col("per_pass") + F.col("rank")), 0)["shard"]
    drawn = drawn.select("mix_source", "mix_block", "passes", "part", F.transform(copies, lambda c: F.struct(c.alias("copy"), at(c).alias("shard"))).alias("draws"))
    drawn = kept(drawn)

    out = blocked(rows, F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    out = out.join(_renamed(drawn), _same_block(), "left").drop("b_source", "b_block")
    out = out.join(extra, F.col("cut_id") == out[doc_id].cast("string"), "left")
    count = F.col("passes") + F.when(F.col("part") == "whole", 1).when((F.col("part") == "cut") & F.coalesce("cut_taken", F.lit(False)), 1).otherwise(0)
    places = F.transform(F.slice("draws", 1, count.cast("int")), lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), "mix_hash", d["copy"]).alias("key")))
    return out.select(*[out[c] for c in docs.columns], "mix_size", "mix_source_size", "mix_target", F.coalesce(places, F.array().cast("array<struct<copy:bigint,shard:int,key:bigint>>")).alias("mix_places"))


def _renamed(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({"mix_source": "b_source", "mix_block": "b_block"})


def _same_block() -> Column:
    return F.col("mix_source").eqNullSafe(F.col("b_source")) & (F.col("mix_block") == F.col("b_block"))
