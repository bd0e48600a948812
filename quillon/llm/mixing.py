"""Mixing sources to target weights by systematic sampling.

Each source gets a target (its share of all words by weight, at most CAP times its own words). A
document's expected number of copies is target / source size. Documents of a source are put in a
fixed order, expected copies are prefix-summed, one offset in [0, 1) is added per source, and a
document is emitted once per integer that its interval crosses. The order runs through strata of
similar size, so that the words taken stay near the target and not only the number of copies.

The prefix sum is distributed: documents fall into cells (source, size stratum, first digits of a
digest of doc_id) of about CELL_ROWS rows; cell counts are prefix-summed on two small levels, and a
rank is needed only within a cell. A source with a third of all rows is therefore many cells.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source
of size 0 has target 0 and its documents are taken 0 times; ties and repeated rows are ordered by
digest, doc_id and size, and each row counts; null doc_ids are ranked like any other; an empty table
gives an empty table; other columns are ignored. Reruns agree, as nothing depends on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, read_table, stored

WEIGHTS = (5, 2, 1)
CAP = 3
CELL_ROWS = 4096
SEED = "mix-1"
#: Copies of up to so many ids (16 bytes each) are sent to all executors; beyond that texts are dealt by id.
BROADCAST_IDS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, size -> source, source_size, target: one row per source.

    Water-filling in closed form: by falling weight per word, a source is capped if its share of
    what the sources before it left exceeds cap times its size.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.partitionBy(F.lit(0)).orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    return (
        total.withColumn("weight", weight.cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("left", F.sum("source_size").over(whole) - (F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit")))
        .withColumn("left_weight", F.sum("weight").over(whole) - (F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")))
        .withColumn("level", F.col("left") / F.col("left_weight"))
        # the first level that does not cap its source holds for all later ones
        .withColumn("first_free", F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "source", "level"))).over(whole))
        .select("source", "source_size", "source_rows", F.least(F.col("limit"), F.coalesce(F.col("first_free.level") * F.col("weight"), F.col("limit"))).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, text -> doc_id, source, size, source_size, target, copies, taken."""
    sized = stored(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    return mix_sized(sized, weights, cap, seed)


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    targets = source_targets(sized, weights, cap)
    digits = max(0, math.ceil(math.log(max(1, sized.count()) / CELL_ROWS, 16)))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    length = F.length(F.col("size").cast("string"))
    cells = (
        sized.withColumn("digest", digest)
        # integer strata: the number of digits and the first two digits of the size
        .withColumn("stratum", length * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int"))
        .withColumn("cell", F.substring("digest", 1, digits))
    )
    key = ["source", "stratum", "cell"]
    counts = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    strata = counts.groupBy("source", "stratum").agg(F.sum("n").alias("n_stratum"))
    before = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)
    strata = strata.select(F.col("source").alias("s1"), F.col("stratum").alias("t1"), (F.sum("n_stratum").over(before) - F.col("n_stratum")).alias("before_stratum"))
    within = Window.partitionBy("source", "stratum").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(*key, (F.sum("n").over(within) - F.col("n")).alias("before_cell"))
    offsets = offsets.join(strata, F.col("source").eqNullSafe(F.col("s1")) & (F.col("stratum") == F.col("t1")))
    offsets = offsets.select(F.col("source").alias("s2"), F.col("stratum").alias("t2"), F.col("cell").alias("c2"), (F.col("before_stratum") + F.col("before_cell")).alias("before"))

    rank = F.row_number().over(Window.partitionBy(*key).orderBy("digest", "doc_id", "size"))
    ranked = cells.withColumn("rank_in_cell", rank.cast("long"))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("stratum") == F.col("t2")) & (F.col("cell") == F.col("c2")))
    targets = targets.select(F.col("source").alias("s3"), "source_size", "target")
    ranked = ranked.join(targets, F.col("source").eqNullSafe(F.col("s3")))
    # one offset per source, a multiple of 2^-16, so that whole expectations stay whole
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    last = F.col("before") + F.col("rank_in_cell")
    crossed = F.floor(last * expected + offset) - F.floor((last - 1) * expected + offset)
    copies = F.when(F.col("size") > 0, F.least(F.lit(cap), crossed)).otherwise(0).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns.

    Rows that repeat an id, or have none, share the copies of their id: the first ones in a fixed order
    get the remainder.
    """
    per_id = mix(docs, **parameters).groupBy(F.col("doc_id").alias("__id")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    per_id = stored(per_id.where("__copies > 0"), "mix-copies")
    few = per_id.count() <= BROADCAST_IDS
    packed = docs.select(F.col("doc_id").alias("__doc_id"), F.struct(*docs.columns).alias("__row"))

    def joined(copies: DataFrame) -> DataFrame:
        return packed.join(F.broadcast(copies) if few else copies, F.col("__doc_id").eqNullSafe(F.col("__id")))

    out = joined(per_id.where("__rows = 1")).select("__row", "__copies")
    repeated = per_id.where("__rows > 1")
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy("__doc_id").orderBy(F.xxhash64("__row"), "__row"))
        own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(place <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
        out = out.union(joined(repeated).select("__row", own.alias("__copies")))
    return out.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select("__row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 3.0 * source_size AS cap FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS lv FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
free AS (SELECT arg_min(lv, cap / w) AS lv FROM levels WHERE cap >= lv * w),
targets AS (SELECT l.source, l.source_size, CAST(least(l.cap, coalesce(f.lv * l.w, l.cap)) AS DOUBLE) AS target, (('0x' || substr(md5('mix-1/' || coalesce(l.source, '')), 1, 4))::INT) / 65536.0::DOUBLE AS u FROM levels l CROSS JOIN free f),
ranked AS (SELECT s.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
  row_number() OVER (PARTITION BY s.source ORDER BY length(CAST(s.size AS VARCHAR)) * 100 + CAST(substr(CAST(s.size AS VARCHAR), 1, 2) AS INT), md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size) AS r
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN least(3, floor(r * e + u) - floor((r - 1) * e + u)) * size ELSE 0 END AS BIGINT) AS taken
FROM ranked
"""
