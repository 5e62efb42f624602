"""Exact percentiles for each key without a state that holds a key's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.durable import stored

#: Keys of at most so many values are aggregated as they are; beyond, there are at most ``HOT_KEYS`` keys.
FEW, HOT_KEYS = 100_000, 10_000
BINS, ROUNDS = 1024, 64


def percentile(values: DataFrame, p: float, few: int = FEW) -> DataFrame:
    """(key, percentile, n) of ``values`` (key, value): the interpolated percentile, as Spark's ``percentile`` gives it.

    Keys with few values go through the built-in aggregate, whose state is bounded by ``few`` then. For the others, all
    at once, the ranks on either side are selected by narrowing: a histogram of each key's range, the bin that holds the
    rank, a histogram of that bin, until a bin has few values or only one. Histograms are partial sums; what is broadcast
    are two ranges for each of at most ``HOT_KEYS`` keys. Null keys and values take no part.
    """
    own = stored(values.where(F.col("key").isNotNull() & F.col("value").isNotNull()).select("key", F.col("value").cast("double").alias("value")), "values")
    few = max(few, own.count() // HOT_KEYS)
    sizes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    hot = stored(sizes.where(F.col("n") > few), "hot")
    rest = own.join(F.broadcast(hot.select("key")), "key", "left_anti").groupBy("key").agg(F.percentile("value", p).alias("percentile"), F.count("*").alias("n"))
    if not hot.limit(1).count():
        return rest
    at = (F.col("n") - 1) * F.lit(float(p))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("nth")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("nth")))
    ranges = hot.select("key", at.alias("at"), "n", "lo", "hi", F.inline(sides)).withColumn("left", F.col("n"))
    for _ in range(ROUNDS):
        ranges = stored(ranges, "ranges")
        wide = (F.col("lo") < F.col("hi")) & (F.col("left") > few)
        if not ranges.where(wide).limit(1).count():
            break
        open_, closed = ranges.where(wide), ranges.where(~wide)
        inside = own.join(F.broadcast(open_), "key").where(F.col("value").between(F.col("lo"), F.col("hi")))
        step = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        bins = inside.groupBy("key", "side", "at", "n", "nth", F.least(step, F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        before = F.sum("left").over(W.partitionBy("key", "side").orderBy("bin")) - F.col("left")
        found = bins.withColumn("before", before).where((F.col("nth") >= F.col("before")) & (F.col("nth") < F.col("before") + F.col("left")))
        ranges = closed.unionByName(found.select("key", "at", "n", "lo", "hi", "side", (F.col("nth") - F.col("before")).alias("nth"), "left"))
    else:
        raise RuntimeError("ranges did not narrow")
    single = F.col("lo") == F.col("hi")
    # What is left has few values a key and side: they are numbered.
    near = own.join(F.broadcast(ranges.where(~single)), "key").where(F.col("value").between(F.col("lo"), F.col("hi")))
    nth = F.row_number().over(W.partitionBy("key", "side").orderBy("value")) - 1
    picked = near.withColumn("place", nth).where(F.col("place") == F.col("nth")).select("key", "at", "n", "side", "value")
    ends = picked.unionByName(ranges.where(single).select("key", "at", "n", "side", F.col("lo").alias("value"))).groupBy("key", "at", "n").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.col("at") - F.floor("at")
    return rest.unionByName(ends.select("key", ((1 - share) * F.col("low") + share * F.col("high")).alias("percentile"), "n"))
