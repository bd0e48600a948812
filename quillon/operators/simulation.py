"""Synthetic workloads from seeds, and the cost of shaping them: DataFrames all the way.

Random numbers are digests of (seed, names), so a workload is the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.conversations import due_at

CANARY_KINDS = ("email", "phone", "card", "ipv4", "token", "name", "host")


def drawn(seed: Column, *names: Column | str) -> Column:
    """A number in [0, 1) that follows from a seed and names."""
    parts = [seed.cast("string"), *[F.lit(n) if isinstance(n, str) else n.cast("string") for n in names]]
    return F.conv(F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def fake_token(seed: Column, length: int = 40) -> Column:
    return F.left(F.concat(F.sha2(F.concat(F.lit("token/"), seed.cast("string")), 256), F.sha2(F.concat(F.lit("more/"), seed.cast("string")), 256)), F.lit(length))


def canary(kind: Column, seed: Column) -> Column:
    """A value of a kind that no text holds by chance."""
    t = fake_token(seed)
    n = lambda at, k: F.lpad((F.conv(F.substring(t, at, 6), 16, 10).cast("long") % 10**k).cast("string"), k, "0")
    return (
        F.when(kind == "email", F.concat(F.substring(t, 1, 8), F.lit("@c"), F.substring(t, 9, 6), F.lit(".net"))).when(kind == "phone", F.concat(F.lit("+1 ("), (F.lit(200) + n(1, 2).cast("int")).cast("string"), F.lit(") 555-"), n(7, 4)))
        .when(kind == "card", F.concat(F.lit("4"), n(1, 5), n(7, 5), n(13, 4))).when(kind == "ipv4", F.concat(F.lit("8."), *[x for k in (1, 7, 13) for x in ((n(k, 3).cast("int") % 250).cast("string"), F.lit("."))][:-1]))
        .when(kind == "token", F.concat(F.lit("ghp_"), F.left(t, F.lit(36)))).when(kind == "name", F.concat(F.lit("Zq"), F.translate(F.substring(t, 1, 6), "0123456789", "aeioulmnrs"))).otherwise(F.concat(F.lit("h-"), F.substring(t, 1, 8), F.lit(".internal")))
    )


def conversations(spark: SparkSession, seeds: int, rounds: int) -> DataFrame:
    """seed, round, input, output: token numbers of each round of each conversation."""
    grid = spark.range(seeds).select(F.col("id").alias("seed")).select("seed", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    size = lambda name, scale: F.ceil(-F.log(1 - drawn(F.col("seed"), name, F.col("round"))) * scale).cast("long")
    return grid.select("seed", "round", size("input", 900.0).alias("input"), size("output", 300.0).alias("output"))


def shaped_costs(rounds: DataFrame, step: int, read_price: float = 0.1, write_price: float = 1.25, keep: int = 10, stub: int = 20) -> DataFrame:
    """Per conversation: cost with old inputs as stubs, and without; in tokens of uncached input.

    Prefixes that did not change are read, the rest is written. A new cutoff makes everything after it new.
    """
    so_far = Window.partitionBy("seed").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    sized = rounds.withColumn("total", F.sum(F.col("input") + F.col("output")).over(so_far))
    sized = sized.withColumn("saved_upto", F.sum(F.greatest(F.lit(0), F.col("input") - stub)).over(so_far))
    cut = sized.withColumn("cutoff", due_at(F.col("round"), F.col("total"), step, keep))
    # what stubs save is a running sum, looked up at the cutoff
    upto = cut.select("seed", F.col("round").alias("cutoff"), F.col("saved_upto").alias("saved"), F.col("total").alias("total_at_cutoff"))
    joined = cut.join(upto, ["seed", "cutoff"], "left").fillna(0, ["saved", "total_at_cutoff"])
    by = Window.partitionBy("seed").orderBy("round")
    before = lambda c: F.lag(c, 1, 0).over(by)
    raw_read, raw_total = before("total"), F.col("total")
    moved = F.col("cutoff") != before("cutoff")
    shaped_total = F.col("total") - F.col("saved")
    kept_prefix = F.when(moved, F.greatest(F.lit(0), before("total_at_cutoff") - before("saved"))).otherwise(before("total") - before("saved"))
    costs = joined.select("seed", "round", (raw_read * read_price + (raw_total - raw_read) * write_price).alias("off"), (kept_prefix * read_price + (shaped_total - kept_prefix) * write_price).alias("on"), shaped_total.alias("shaped"), raw_total.alias("raw"))
    return costs.groupBy("seed").agg(F.round(F.sum("on"), 2).alias("cost_on"), F.round(F.sum("off"), 2).alias("cost_off"), F.max("shaped").alias("largest_on"), F.max("raw").alias("largest_off"))


def requests_of(items: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, n, upto: the successive requests of a session, one before each answer."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return items.where("role = 'assistant'").select(key, n.cast("long").alias("n"), (F.col(order) - 1).alias("upto"))


def smallest_failing(items: Sequence, fails: Callable[[list], bool]) -> list:
    """Delta debugging: a part of a failing list that fails, of which nothing can be left out. On the driver."""
    found, pieces = list(items), 2
    while len(found) >= 2:
        size = -(-len(found) // pieces)
        for at in range(0, len(found), size):
            rest = found[:at] + found[at + size :]
            if rest and fails(rest):
                found, pieces = rest, max(2, pieces - 1)
                break
        else:
            if size == 1:
                break
            pieces = min(len(found), 2 * pieces)
    return found
