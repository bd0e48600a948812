"""Quality rules: base limits, then a robust multivariate outlier test per language and source.

Each text becomes a short vector of transformed statistics (smoothed, so that short texts are not
outliers by chance). For every (lang, source) the minimum covariance determinant estimate is searched from
three starts (all rows; medians and quartile ranges; spatial signs about the medians) by concentration
steps: distances under the present centre and covariance, then centre and covariance of the nearest
rows, up to the H share (over half; bins of equal distance stay whole). Steps go on until no group's
least determinant falls by LEAST_FALL, at most STEPS times, and the least determinant of all starts and
steps wins. Texts whose Mahalanobis distance exceeds the cut-off go.

The steps are distributed: distances fall into fine logarithmic bins, moments are summed per (group,
bin) with map-side combination, and a running sum over the few bins of a group gives the moments of
its nearest rows. So one step is one small aggregation, a source with a third of all rows is no hot
task, and nothing but moments leaves the executors. Groups with fewer than MIN_GROUP rows use their
language's estimate, and such languages the estimate of all rows.

The determinant is that of the regularised covariance (minimum regularised covariance determinant): a
statistic that is the same in nearly all texts of a group (no symbols at all, say) makes the plain
determinant zero whatever the rest, and would reject any text that differs a little. FLOORS, the least
spreads that count, are the target added to every covariance.

Defined cases: null, empty and blank texts have no words and fail the base limits; null languages and
sources are groups of their own; repeated rows and null doc_ids keep one row each and count each time;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, dropped, give_back, looked_up, read_table, small_batches, stored
from .textstats import BASE, statistics

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
NAMES = ("x_length", "x_symbols", "x_lines", "x_repeats")
FLOORS = (0.06, 0.15, 0.15, 0.15)
DIMS = len(NAMES)
H = 0.75
STEPS = 12
LEAST_FALL = 1e-3
MIN_GROUP = 200
TAIL = 1e-8
#: Estimates (about 300 bytes) of up to so many pairs of language and source are sent to all executors.
BROADCAST_KEYS = 50_000


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


CUTOFF = chi_square_quantile(1 - TAIL, DIMS)


def consistency(share: float) -> float:
    """Makes the covariance of a nearest share that of all rows, were they normal."""
    return 1.0 if share >= 1 else share / chi_square_cdf(chi_square_quantile(share, DIMS), DIMS + 2)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text -> doc_id, lang, source and BASE."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            rows = np.array([statistics(t, more=False) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(rows[:, k]) for k in range(len(BASE)))], names=["doc_id", "lang", "source", *BASE])
        give_back()

    columns = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(*columns).mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{b} long" for b in BASE))


def with_statistics(docs: DataFrame, prefix: str) -> DataFrame:
    """All columns of docs as they are, and BASE under prefixed names: row by row, so texts do not move."""
    schema = docs.select(*docs.columns, *(F.lit(0).cast("long").alias(prefix + b) for b in BASE)).schema

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            rows = np.array([statistics(t, more=False) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, k]) for k in range(len(BASE)))], names=[*batch.schema.names, *(prefix + b for b in BASE)])
        give_back()

    return docs.mapInArrow(count, schema)


def with_vector(stats: DataFrame) -> DataFrame:
    n, prior = F.col("n_words"), 50
    return stats.withColumns(
        {
            "x_length": F.log((F.col("word_chars") + 5 * prior) / (n + prior)),
            "x_symbols": F.asinh(10 * F.col("n_symbols") / (n + prior)),
            "x_lines": F.sqrt(20 * F.col("n_dup_lines") / (n + 2 * prior)),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / (n + prior)),
            "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        }
    )


KEY = ["k_lang", "k_source"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds k_lang and k_source, which are never null."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))
    return rows.withColumns({"k_lang": lang, "k_source": source})


def groups_of(stats: DataFrame) -> DataFrame:
    """Keyed rows with base_failed -> k_lang, k_source, grp, levels: the group whose estimate holds for a pair,
    and the groups whose estimates its rows take part in (its own, its language's, all), if any pair needs them."""
    n = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    pairs = stats.groupBy(*KEY).agg(n.alias("n_group"))
    by_lang = pairs.groupBy("k_lang").agg(F.sum("n_group").alias("n_lang"), F.max(F.col("n_group") < MIN_GROUP).alias("lang_wanted"))
    lang_rest = F.col("lang_wanted") & (F.col("n_lang") >= MIN_GROUP)
    all_wanted = not by_lang.where(F.col("n_lang") < MIN_GROUP).isEmpty()
    lang = F.concat(F.length("k_lang"), F.lit(":"), "k_lang")
    own, of_lang = F.concat(lang, F.lit("/"), "k_source"), F.concat(lang, F.lit("/*"))
    grp = F.when(F.col("n_group") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, of_lang).otherwise("*")
    levels = F.array(F.when(F.col("n_group") >= MIN_GROUP, own), F.when(lang_rest, of_lang), F.when(F.lit(all_wanted), F.lit("*")))
    return pairs.join(by_lang, "k_lang").select(*KEY, grp.alias("grp"), F.array_compact(levels).alias("levels"))


MOMENTS = ["m_n", *(f"m_{i}" for i in range(DIMS)), *(f"m_{i}_{j}" for i in range(DIMS) for j in range(i, DIMS))]
ESTIMATE = "grp string, start int, center array<double>, inverse array<double>, determinant double"


def _moments(x: list | None = None) -> list:
    x = x or [F.col(c) for c in NAMES]
    return [F.count(F.lit(1)).cast("double").alias("m_n"), *(F.sum(x[i]).alias(f"m_{i}") for i in range(DIMS)), *(F.sum(x[i] * x[j]).alias(f"m_{i}_{j}") for i in range(DIMS) for j in range(i, DIMS))]


def covariance_of(moments: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    n = moments["m_n"]
    center = np.array([moments[f"m_{i}"] / n for i in range(DIMS)])
    covariance = np.empty((DIMS, DIMS))
    for i in range(DIMS):
        for j in range(i, DIMS):
            covariance[i, j] = covariance[j, i] = moments[f"m_{i}_{j}"] / n - center[i] * center[j]
    return center, covariance


def regularised(covariance: np.ndarray, share: float) -> np.ndarray:
    """Made consistent for the share of rows that it is of, and kept away from singular by the target FLOORS."""
    return covariance * consistency(share) + np.diag(np.square(FLOORS))


def _solved(grp: str, start: int, center: np.ndarray, covariance: np.ndarray) -> tuple:
    return grp, start, center.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.det(covariance))


def _first_estimates(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three starts per group: all rows; medians and quartile ranges; spatial signs about the medians."""
    for batch in batches:
        out = []
        for r in batch.to_dict("records"):
            middle, spread = np.array(r["middle"]), np.array(r["spread"])
            center, covariance = covariance_of(r)
            _, signs = covariance_of({m: r["s" + m] for m in MOMENTS})
            scale = np.maximum(spread, FLOORS)
            out.append(_solved(r["grp"], 0, center, regularised(covariance, 1.0)))
            out.append(_solved(r["grp"], 1, middle, np.diag(scale**2)))
            out.append(_solved(r["grp"], 2, middle, DIMS * signs * np.outer(scale, scale) + np.diag(np.square(FLOORS))))
        yield pd.DataFrame(out, columns=["grp", "start", "center", "inverse", "determinant"])


def _next_estimates(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_solved(r["grp"], r["start"], center, regularised(covariance, r["m_n"] / r["n"])) for r in batch.to_dict("records") for center, covariance in [covariance_of(r)]]
        yield pd.DataFrame(rows, columns=["grp", "start", "center", "inverse", "determinant"])


def _distance(center: str = "center", inverse: str = "inverse"):
    d = [F.col(c) - F.col(center)[i] for i, c in enumerate(NAMES)]
    terms = [d[i] * d[j] * F.col(inverse)[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)]
    return sum(terms[1:], terms[0])


def _starts(rows: DataFrame) -> DataFrame:
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"q_{i}") for i, c in enumerate(NAMES)]
    # 1.349: the distance of the quartiles of a normal distribution, in standard deviations
    middle, spread = F.array(*[F.col(f"q_{i}")[1] for i in range(DIMS)]), F.array(*[(F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349 for i in range(DIMS)])
    classical = stored(rows.groupBy("grp").agg(*_moments(), *quartiles).select("grp", *MOMENTS, middle.alias("middle"), spread.alias("spread")), "mcd-moments")
    scaled = [(F.col(c) - F.col("middle")[i]) / F.greatest(F.col("spread")[i], F.lit(FLOORS[i])) for i, c in enumerate(NAMES)]
    length = F.sqrt(sum((z * z for z in scaled[1:]), scaled[0] * scaled[0]))
    signs = [F.when(length > 0, z / length).otherwise(0.0).alias(f"u_{i}") for i, z in enumerate(scaled)]
    signed = looked_up(rows, classical.select("grp", "middle", "spread"), ["grp"], BROADCAST_KEYS).select("grp", *signs)
    signed = signed.groupBy("grp").agg(*_moments([F.col(f"u_{i}") for i in range(DIMS)]))
    both = classical.join(signed.select("grp", *(F.col(m).alias("s" + m) for m in MOMENTS)), "grp")
    return both.mapInPandas(_first_estimates, ESTIMATE)


def robust_estimates(rows: DataFrame, steps: int = STEPS, h: float = H) -> DataFrame:
    """grp, x_* (a stored table) -> grp, center, inverse, determinant: of the three starts of each group the
    one whose concentration steps end at the least determinant."""
    estimates = stored(_starts(rows), "mcd-start")
    n_estimates = estimates.count()
    within = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    made: list[DataFrame] = []
    for step in range(steps):
        now = estimates.select("grp", "start", "center", "inverse")  # three rows a group
        binned = looked_up(rows, now, ["grp"], BROADCAST_KEYS, n_estimates)
        binned = binned.select("grp", "start", *NAMES, F.floor(F.log2(_distance() + 1e-6) * 32).cast("int").alias("bin"))
        per_bin = binned.groupBy("grp", "start", "bin").agg(*_moments())
        total = F.sum("m_n").over(Window.partitionBy("grp", "start"))
        running = per_bin.select("grp", "start", "bin", total.alias("n"), *(F.sum(m).over(within).alias(m) for m in MOMENTS))
        full = F.col("m_n") >= h * F.col("n")
        within_share = (F.col("m_n") <= h * F.col("n")) & (2 * F.col("m_n") > F.col("n"))
        choice = F.row_number().over(Window.partitionBy("grp", "start").orderBy(F.when(within_share, 0).when(full, 1).otherwise(2), F.when(within_share, -F.col("bin")).otherwise(F.col("bin"))))
        nearest = running.withColumn("choice", choice).where("choice = 1").select("grp", "start", "n", *MOMENTS)
        estimates = stored(nearest.mapInPandas(_next_estimates, ESTIMATE), f"mcd-{step}")
        made.append(estimates)
        if step and _settled(made):
            break
    every = functools.reduce(DataFrame.union, made) if made else estimates
    best = every.groupBy("grp").agg(F.min(F.struct("determinant", "start", "center", "inverse")).alias("b"))
    return best.select("grp", "b.center", "b.inverse", "b.determinant")


def _settled(made: list[DataFrame]) -> bool:
    """Whether the last step lowered no group's least determinant by LEAST_FALL or more."""
    before = functools.reduce(DataFrame.union, made[:-1]).groupBy("grp").agg(F.min("determinant").alias("was"))
    now = made[-1].groupBy("grp").agg(F.min("determinant").alias("now"))
    return now.join(before, "grp").where(F.col("now") < (1 - LEAST_FALL) * F.col("was")).isEmpty()


def fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statistics of docs, and the estimate that holds for each of their keys; both stored."""
    small_batches(docs.sparkSession)
    stats = stored(with_vector(_keyed(text_statistics(docs))), "quality-stats")
    groups = stored(groups_of(stats), "quality-groups")
    good = looked_up(stats.where(~F.col("base_failed")).select(*KEY, *NAMES), groups.select(*KEY, "levels"), KEY, BROADCAST_KEYS)
    rows = stored(good.select(F.explode("levels").alias("grp"), *NAMES), "quality-rows")
    estimates = robust_estimates(rows)
    of_key = stored(groups.join(estimates, "grp", "left").select(*KEY, "center", "inverse", "determinant"), "quality-estimates")
    dropped(groups, rows)
    return stats, of_key


def _kept():
    return ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text -> doc_id, BASE, base_failed, distance (squared), kept."""
    stats, of_key = fitted(docs)
    judged = looked_up(stats, of_key, KEY, BROADCAST_KEYS).withColumn("distance", _distance())
    return judged.select("doc_id", *BASE, "base_failed", "distance", _kept().alias("kept"))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are.

    Statistics are counted a second time beside the texts, which costs less than to move texts by id,
    and holds for rows without an id of their own.
    """
    stats, of_key = fitted(docs)
    dropped(stats)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counted = _keyed(with_vector(with_statistics(packed, ""))).drop("text")
    judged = looked_up(counted, of_key, KEY, BROADCAST_KEYS).withColumn("distance", _distance())
    return judged.where(_kept()).select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
