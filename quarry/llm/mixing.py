"""Mixing of sources to target weights by Sainte-Lague apportionment, in DataFrame
operations only.

Targets are weighted shares of all words, none above a multiple of its source's size;
the excess is shared anew by weight. Equal-token blocks are then allocated to sources
by the highest quotients target / (2 a + 1), and a source's quota to its shards in the
same way. A shard lays its documents out in a seeded order, cuts them in equal blocks,
takes every block quota // blocks times, and quota % blocks blocks, a seeded choice,
once more.

The highest quotients are found without a row a block: with divisors a little above
and below the right one, each unit's quota is bracketed, brackets hold about two
seats a unit, and only those compete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialised, table

WEIGHTS, LIMIT = (5, 2, 1), 3
#: Words of a block, whatever the table's size: a target is met within about one.
BLOCK_WORDS = 16
#: Fixed primes above any number of blocks in a shard; one steps through the blocks in a seeded order.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)


def words_in(text: Column) -> Column:
    """Number of runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds target to source, source_size: shares by weight of all words, at most limit
    times the size.

    In the order of limit * size / weight the full sources come first, so one pass of
    running sums finds the level at which the rest share. One row a source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, total = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    # the first source that isn't full sets the level of all after it
    first = F.min_by(F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level")), F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("most") / F.col("weight"))).over(total)
    share = F.coalesce(F.col("weight") * first, F.col("most"))
    return rows.withColumn("target", F.least("most", share)).select("source", "source_size", "target")


def apportioned(units: DataFrame, seats: str, group: list[str], order: list[str], share: str = "share", most: str = "most") -> DataFrame:
    """Adds quota: seats of each group, allocated by Sainte-Lague to its units.

    share is a unit's weight (of the group's sum), most the seats it may have. Ties go
    by order. No row a seat is made.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    n, total = F.count("*").over(w), F.sum(share).over(w)
    # divisors: total / (seats - n / 2) gives at most, total / (seats + n / 2) at least the right number of seats
    rows = units.withColumn("_n", n).withColumn("_total", total)
    low = F.floor(F.try_divide(F.col(share), F.col("_total")) * (F.col(seats) - F.col("_n") / 2.0) + 0.5 - 1e-9)
    high = F.floor(F.try_divide(F.col(share), F.col("_total")) * (F.col(seats) + F.col("_n") / 2.0) + 0.5 + 1e-9)
    low, high = F.greatest(F.lit(0), F.coalesce(low, F.lit(0))).cast("long"), F.greatest(F.lit(0), F.coalesce(high, F.lit(0))).cast("long")
    rows = rows.withColumn("_low", F.least(low, F.col(most))).withColumn("_high", F.least(high, F.col(most)))
    rows = rows.withColumn("_rest", F.col(seats) - F.sum("_low").over(w))
    seat = rows.select(*units.columns, "_low", "_rest", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))).alias("_a"))
    best = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(F.desc_nulls_last(F.col(share) / (2 * F.col("_a") + 1)), *order)
    won = (F.row_number().over(best) <= F.col("_rest")) & F.col("_a").isNotNull()
    return seat.withColumn("_won", won.cast("long")).groupBy(*units.columns).agg((F.max("_low") + F.sum("_won")).alias("quota"))


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, shard_words: int = 1 << 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents.

    taken counts words with repeats, at most LIMIT times the size. A source's sum comes
    near its target: a shard is cut in equal blocks, as many as it holds of
    block_words words, rounded, but one at least, and quotas count these. Documents
    without words take none; a null source is a source of its own, the last; repeated
    rows are each a document; an empty table gives an empty one. Reruns and other
    partitionings give the same rows.
    """
    spark = documents.sparkSession
    sized = materialised(documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = lambda x: x.withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    aimed = targets(sources).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int"))
    aimed = materialised(named(aimed), "targets")
    draw = F.xxhash64("doc_id", "size", F.lit(seed))
    placed = named(sized).join(aimed, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = materialised(shards.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("long")), "shards")
    # a source's target counts in blocks of its own, which aren't quite block_words long
    own = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    units = aimed.join(own, "source").withColumn("share", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)))
    units = units.withColumn("seats", F.round(F.sum("share").over(Window.partitionBy(F.lit(1)))).cast("long")).withColumn("most", LIMIT * F.col("blocks"))
    quotas = materialised(apportioned(units, "seats", [], ["source"]).select("source", F.col("quota").alias("source_quota")), "quotas")
    shares = shards.join(quotas, "source").withColumn("share", F.col("words").cast("double")).withColumn("most", F.when(F.col("words") > 0, LIMIT * F.col("blocks")).otherwise(0))
    shared = apportioned(shares, "source_quota", ["source"], ["shard"]).select("source", "shard", "words", "blocks", "quota")
    order = Window.partitionBy("source", "shard").orderBy(draw, "doc_id", "size")
    laid = placed.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(shared, ["source", "shard"]).withColumn("_from", F.col("_end") - F.col("size"))
    # block k of n covers words floor(k * words / n) to floor((k + 1) * words / n) of the shard
    n, words = F.col("blocks"), F.col("words")
    edge = lambda k: F.floor(k * words / n)
    stride = F.element_at(F.array(*(F.lit(p) for p in STRIDES)), (F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.lit(len(STRIDES))) + 1).cast("int")).cast("long")
    turn = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 3)), n)
    times = lambda k: F.floor(F.col("quota") / n) + F.when(F.pmod(k * F.col("_stride") + F.col("_turn"), n) < F.pmod(F.col("quota"), n), 1).otherwise(0)
    laid = laid.withColumn("_stride", stride).withColumn("_turn", turn)
    first, last = F.floor(F.try_divide(F.col("_from") * n, words)), F.least(n - 1, F.floor(F.try_divide((F.col("_end") - 1) * n, words)) + 1)
    over = lambda k: F.greatest(F.lit(0), F.least(F.col("_end"), edge(k + 1)) - F.greatest(F.col("_from"), edge(k)))
    taken = F.aggregate(F.sequence(F.greatest(F.lit(0), first - 1).cast("long"), last.cast("long")), F.lit(0).cast("long"), lambda acc, k: acc + (over(k) * times(k)).cast("long"))
    return laid.select("doc_id", "size", "source_size", "target", F.when((F.col("size") > 0) & (words > 0), taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
