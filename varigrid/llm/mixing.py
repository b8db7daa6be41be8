"""Mixing sources to target weights in blocks of equal tokens, apportioned by Sainte-Lague.

Documents are dealt by a seeded hash to shards of a few hundred. Each source's documents form one stream, shard by shard and in seeded
order within a shard, cut into blocks of ``block`` tokens. A source's target is met by whole passes over its stream and, for
the rest, by blocks that an even, seeded selection spreads over all shards, so remainders add up over shards. The blocks of the
rest go to the sources by the highest quotients of what they miss, each within one block of it; the last, partial block
of a stream counts by its words. Tokens are words here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varigrid.llm.common import n_words, store

WEIGHTS = (5, 2, 1)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources (source, source_size) with their place by code point, null last, from 0, counted without one task for all.

    The driver gets one number for each partition of sources.
    """
    parted = store(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before, total = {}, 0
    for r in parted.groupBy("part").count().orderBy("part").collect():
        before[r.part], total = total, total + r["count"]
    shift = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("part")] if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return parted.withColumn("place", own + shift).drop("part")


def targets(sources: DataFrame, total: float, most: int = 3) -> DataFrame:
    """Add target to sources (source_size, weight): shares of ``total`` by weight, none above ``most`` times its size.

    The excess of a source is shared by weight among those below, again and again until none is above. Each round is an
    aggregate whose two numbers reach the driver.
    """
    cap, scale = F.lit(float(most)) * F.col("source_size"), -1.0
    sums = sources.agg(F.sum("weight").cast("double").alias("w")).first()
    now = total / sums.w if sums.w else 0.0
    while now > scale:
        scale = now
        r = sources.agg(F.sum(F.when(F.col("weight") * scale > cap, cap)).alias("full"), F.sum(F.when(F.col("weight") * scale <= cap, F.col("weight"))).cast("double").alias("w")).first()
        if not r.w:
            break
        now = (total - (r.full or 0.0)) / r.w
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(scale), cap))


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str, within: bool = False) -> DataFrame:
    """Sainte-Lague: column ``quota`` gives each party its share of its group's seats (equal in a group) by votes.

    Seats go to the highest quotients votes / (2 n - 1), ties to the smaller party. Rounding at the natural divisor comes
    first; what is over or missing goes by quotient among a number of next seats that provably suffices. With ``within``, votes
    are in seats: each party has the whole seats of its votes and at most one for the fraction, so seats beyond that stay free.
    """
    all_ = Window.partitionBy(group)
    x = parties.withColumn("w_", F.sum(votes).over(all_)).withColumn("unit_", F.when(F.col(seats) > 0, F.col("w_") / F.col(seats)))
    x = x.withColumn("a_", F.floor(votes).cast("long") if within else F.coalesce(F.floor(F.col(votes) / F.col("unit_") + 0.5), F.lit(0)).cast("long"))
    x = x.withColumn("d_", F.when(F.col("w_") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("a_").over(all_)).withColumn("s_", F.count(F.lit(1)).over(all_))
    reach = F.when(F.col("w_") > 0, F.floor(F.col(votes) * (F.abs("d_") + F.col("s_")) / F.col("w_")) + 2).otherwise(F.lit(0)).cast("long")
    steps = F.when(F.col("d_") > 0, F.sequence(F.col("a_") + 1, F.col("a_") + reach)).when((F.col("d_") < 0) & (F.col("a_") > 0), F.sequence(F.greatest(F.col("a_") - reach + 1, F.lit(1)), F.col("a_")))
    if within:
        steps = F.when((F.col("d_") > 0) & (F.col(votes) > F.col("a_")), F.array(F.col("a_") + 1))
    seat = x.where((F.col("d_") != 0) & (reach > 0)).select(group, party, "d_", votes, F.explode(steps).alias("n_"))
    quotient = F.col(votes) / (2 * F.col("n_") - 1)
    sign = F.signum("d_")
    order = Window.partitionBy(group).orderBy(F.desc(quotient * sign), F.asc_nulls_last(F.when(sign > 0, F.col(party))), F.desc_nulls_first(F.when(sign < 0, F.col(party))), F.col("n_") * sign)
    change = seat.where(F.col(votes) > 0).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= F.abs("d_")).groupBy(group, F.col(party).alias("p_")).agg(F.sum(sign).cast("long").alias("c_"))
    change = change.withColumnRenamed(group, "g_")
    return x.join(change, (F.col(group) == F.col("g_")) & F.col(party).eqNullSafe(F.col("p_")), "left").withColumn("quota", F.col("a_") + F.coalesce("c_", F.lit(0))).drop("w_", "unit_", "a_", "d_", "s_", "g_", "p_", "c_")


def words_before(x: Column, block: int, times: Column, blocks: Column, shift: Column) -> Column:
    """Words before stream position x in the ``times`` of ``blocks`` blocks that an even, seeded selection takes."""
    full = F.floor(x / block)
    taken = lambda b: F.floor((b * times + shift) / blocks)
    return (taken(full) * block + (taken(full + 1) - taken(full)) * (x - full * block)).cast("long")


def _quotas(sources: DataFrame, block: int, seed: int, together: int = 4096) -> DataFrame:
    """Add blocks (of a source's stream), repeats (whole passes), shift and once (selected blocks) to sources (source, source_size, target, place).

    ``once`` is apportioned among at most ``together`` sources at a time; what such groups miss is carried on to the next one.
    """
    size = F.col("source_size")
    x = sources.withColumn("blocks", F.ceil(size / block)).withColumn("repeats", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)))
    x = x.withColumn("shift", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source"), "blocks")).otherwise(F.lit(0)))
    rest, before, last = F.greatest(F.col("target") - F.col("repeats") * size, F.lit(0.0)), F.col("shift") * F.lit(block), size - (F.col("blocks") - 1) * block
    # The selection takes the last block as its number shift + 1.
    votes = F.when(rest <= before, rest / block).when(rest < before + last, F.col("shift") + (rest - before) / last).otherwise((rest + block - last) / block)
    x = store(x.withColumn("votes", F.when(size > 0, votes).otherwise(F.lit(0.0))).withColumn("group", F.floor(F.col("place") / together)), "votes")
    sums = x.groupBy("group").agg(F.sum("votes").alias("v_")).withColumn("to_", F.sum("v_").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)))
    seats = sums.select("group", (F.floor(F.col("to_") + 0.5) - F.floor(F.col("to_") - F.col("v_") + 0.5)).cast("long").alias("seats"))
    return apportion(x.join(seats, "group"), "group", "source", "votes", "seats", within=True).withColumnRenamed("quota", "once")


def _starts(parts: DataFrame, together: int = 1024) -> DataFrame:
    """Add start, the words of the source in shards before, to parts (shard, source, part_size)."""
    x = parts.withColumn("run_", F.floor(F.col("shard") / together))
    runs = x.groupBy("source", "run_").agg(F.sum("part_size").alias("n_"))
    runs = runs.select(F.col("source").alias("source_"), F.col("run_").alias("run"), (F.sum("n_").over(Window.partitionBy("source").orderBy("run_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("from_"))
    own = F.sum("part_size").over(Window.partitionBy("source", "run_").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size")
    x = x.withColumn("own_", own).join(runs, (F.col("run_") == F.col("run")) & F.col("source").eqNullSafe(F.col("source_")))
    return x.select("shard", "source", "part_size", (F.col("from_") + F.col("own_")).alias("start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 64, seed: int = 17, shard_documents: int = 256, most: int = 3) -> DataFrame:
    """How often the mix takes each document's words.

    Returns for every row of ``docs`` (doc_id, source, text): doc_id, fp (hash of the text), source, size, source_size, target
    (its source's), repeats (whole passes), low and high (positions in its shard's part of the stream, from the block in which that begins),
    once, blocks, shift (the selection, from there), taken.
    Sources in code point order, null last, weigh ``weights``, repeating. A null or empty text has size 0 and is taken 0
    times; an empty table gives no rows; rows that repeat a doc_id are documents of their own and tied rows share a
    place in the order. A very long text is cut by blocks like any other; other columns are ignored. taken is at most ``most`` times size. The order depends on doc_id, text and seed alone.
    """
    fp = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = docs.select("doc_id", fp.alias("fp"), "source", n_words(F.col("text")).alias("size"))
    total = store(sized, "sizes")
    counted = total.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    shards = max(1, -(-counted.n // shard_documents))
    by = F.xxhash64(F.lit(seed), "doc_id", "fp")
    rows = total.withColumn("order_", by).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order_"), F.lit(shards)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.array(*(F.lit(w) for w in weights))[F.pmod(F.col("place"), F.lit(len(weights))).cast("int")]
    sources = store(targets(ranked_sources(sizes).withColumn("weight", weight), float(counted.size), most), "targets")
    parts = rows.groupBy("shard", "source").agg(F.sum("size").alias("part_size"))
    quotas = _quotas(sources, block, seed).select("source", "source_size", "target", "blocks", "repeats", "once", "shift")
    parts = _join_source(_starts(parts), quotas).withColumn("from", F.col("start") % block)
    # The selection at the first block of the part: its number times once can be above 2^63.
    wide = lambda x: x.cast("decimal(19,0)")
    first = wide(F.floor(F.col("start") / block)) * wide(F.col("once")) + F.col("shift")
    parts = store(parts.withColumn("shift", F.when(F.col("blocks") > 0, first % wide(F.col("blocks"))).otherwise(F.lit(0)).cast("long")), "quotas")
    stream = Window.partitionBy("shard", "source").orderBy("order_", "doc_id", "fp").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("high", F.sum("size").over(stream))
    q = parts.select(F.col("shard").alias("shard_"), F.col("source").alias("source_"), "from", "source_size", "target", "blocks", "repeats", "once", "shift")
    rows = rows.join(q, (F.col("shard") == F.col("shard_")) & F.col("source").eqNullSafe(F.col("source_"))).drop("shard_", "source_")
    rows = rows.withColumn("high", F.col("high") + F.col("from")).withColumn("low", F.col("high") - F.col("size"))
    before = lambda x: words_before(F.col(x), block, F.col("once"), F.greatest("blocks", F.lit(1)), F.col("shift"))
    rows = rows.withColumn("taken", (F.col("repeats") * F.col("size") + F.when(F.col("once") > 0, before("high") - before("low")).otherwise(F.lit(0))).cast("long"))
    return rows.select("doc_id", "fp", "source", "size", "source_size", "target", F.col("repeats").cast("int").alias("repeats"), "low", "high", "once", "blocks", "shift", "taken")


def _join_source(left: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "source_")
    return left.join(s, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
