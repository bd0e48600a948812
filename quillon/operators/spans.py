"""From findings to edits: unions of spans, representatives, propagation, rendering, audits.

Findings are rows (keys, rule_id, category, start, end, value). Windows are partitioned by text, whose
findings are bounded by its length; texts themselves are joined to their collected edits once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), touching: bool = False) -> DataFrame:
    """Adds `island`, from 1 within a text: spans that overlap share one; touching ones too if asked for."""
    order = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), *[c for c in ("rule_id",) if c in spans.columns])
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > reach) if touching else (F.col("start") >= reach)
    opened = F.when(reach.isNull() | new, 1).otherwise(0)
    return spans.withColumn("opened", opened).withColumn("island", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("opened")


def merged_ranges(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), touching: bool = True) -> DataFrame:
    """keys, start, end of the union."""
    return islands(spans, keys, touching).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def representatives(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per island: its range and the finding that stands for it.

    Secrets come first, then findings that cover the island exactly, then the smaller rule id.
    """
    placed = islands(findings, keys)
    of_island = Window.partitionBy(*keys, "island")
    ranged = placed.withColumns({"from": F.min("start").over(of_island), "to": F.max("end").over(of_island)})
    exact = (F.col("start") == F.col("from")) & (F.col("end") == F.col("to"))
    rank = F.row_number().over(of_island.orderBy((F.col("category") != "secret").asc(), (~exact).asc(), "rule_id", "start", "end"))
    first = ranged.withColumn("rank", rank).where("rank = 1")
    return first.select(*keys, "island", F.col("from").alias("start"), F.col("to").alias("end"), "rule_id", "category", "value")


def starts_of(text: Column, value: Column) -> Column:
    """Every place of a value in a text, those that overlap too: the text is cut before each with a look-ahead, and
    lengths are summed. A null or empty value is nowhere."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, F.when(F.length(value) > 0, quoted).otherwise(F.lit("(?!)")), -1)
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + F.length(p))).alias("all"))
    cuts = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])
    none = F.array().cast("array<int>")
    return F.concat(F.when(F.startswith(text, value) & (F.length(value) > 0), F.array(F.lit(0))).otherwise(none), F.coalesce(cuts, none))


#: Values shorter than this are fragments (a local part of one letter, say), whose copies mean nothing.
LEAST_VALUE = 2


def propagated(findings: DataFrame, texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings, and every other place of their values in the same text, overlapping ones too.

    A copy of personal data within a longer identifier is left alone. Numbers of JSON documents and customer
    numbers of digits only are known by their labels and not sought; strings of documents (column json_kind)
    are sought as they are written, without quotes, and decoded. A text meets its values once, as an array.
    """
    kind = F.col("json_kind") if "json_kind" in findings.columns else F.lit(None).cast("string")
    bare = (F.col("rule_id") == "pii-customer-number") & F.col("value").rlike("^[0-9]+$")
    sought = findings.withColumn("kind", kind).where((F.coalesce(F.col("kind"), F.lit("")) != "number") & ~bare)
    forms = F.when((F.col("kind") == "string") & F.col("value").rlike('^".*"$'), F.array("value", F.expr("substring(value, 2, length(value) - 2)"), F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0)))).otherwise(F.array("value"))
    values = sought.withColumn("value", F.explode(F.array_compact(F.array_distinct(forms)))).where(F.length("value") >= LEAST_VALUE)
    values = values.groupBy(*keys, "value").agg(F.min(F.struct((F.col("category") != "secret").alias("pii"), "rule_id", "category")).alias("best"))
    listed = values.groupBy(*keys).agg(F.collect_list(F.struct("value", "best.rule_id", "best.category")).alias("sought"))
    whole = F.col(text)
    identifier = r"[\p{L}\p{N}_]"

    def places(v: Column) -> Column:
        n = F.length(v["value"])
        clear = lambda at: (v["category"] == "secret") | ~(F.when(at > 0, F.substring(whole, at, F.lit(1))).otherwise("").rlike(identifier) | F.substring(whole, at + n + 1, F.lit(1)).rlike(identifier))
        return F.transform(F.filter(starts_of(whole, v["value"]), clear), lambda at: F.struct(v["rule_id"].alias("rule_id"), v["category"].alias("category"), at.alias("start"), (at + n).alias("end"), v["value"].alias("value")))

    rows = texts.select(*keys, whole).join(listed, list(keys))
    copies = rows.select(*keys, F.explode(F.flatten(F.transform("sought", places))).alias("c")).select(*keys, "c.*")
    own = findings.select(*keys, "rule_id", "category", "start", "end", "value")
    return own.union(copies).dropDuplicates([*keys, "start", "end", "value"])


def edits(reps: DataFrame, replacement: Column) -> DataFrame:
    """Representatives -> edits."""
    return reps.withColumn("replacement", replacement)


def tag(category: Column, rule_id: Column) -> Column:
    return F.concat(F.lit("["), F.upper(category), F.lit(":"), rule_id, F.lit("]"))


def render(texts: DataFrame, changes: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text and n_edits: texts with their edits (start, end, replacement) carried out.

    Edits must not overlap; those of a text are collected (bounded by its length) and folded from left to
    right. Texts without edits pass through unread.
    """
    listed = changes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("changes"))
    rows = texts.join(listed, list(keys), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.col(text)

    def step(acc: Column, e: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(whole, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"]).alias("out"), e["end"].alias("at"))

    done = F.aggregate("changes", start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    out = F.when(F.col("changes").isNull(), whole).otherwise(done)
    return rows.select(*keys, out.alias(text), F.coalesce(F.size("changes"), F.lit(0)).cast("long").alias("n_edits"))


def to_original(offset: Column, changes: Column) -> Column:
    """An offset in an edited text, in the text before. changes: array<struct<start,end,replacement>> in order."""
    start = F.struct(F.lit(0).alias("shift"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, e: Column) -> Column:
        begin = e["start"] + acc["shift"]
        end = begin + F.length(e["replacement"])
        found = F.coalesce(acc["found"], F.when(offset < begin, offset - acc["shift"]).when(offset < end, e["start"]))
        return F.struct((acc["shift"] + F.length(e["replacement"]) - (e["end"] - e["start"])).alias("shift"), found.alias("found"))

    return F.aggregate(changes, start, step, lambda acc: F.coalesce(acc["found"], offset - acc["shift"]))


def without_protected(findings: DataFrame, protected: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings that touch no protected range (keys, start, end)."""
    p = protected.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    same = [F.col(k) == F.col(f"p_{k}") for k in keys]
    return findings.join(p, [*same, F.col("start") < F.col("p_end"), F.col("end") > F.col("p_start")], "left_anti")


def allowed(findings: DataFrame, tags: str = "allow_tags") -> DataFrame:
    """Findings of categories that the row's tags do not allow; `all` allows everything."""
    given = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    return findings.where(~F.array_contains(given, "all") & ~F.array_contains(given, F.col("category")))


def audit(expected: DataFrame, replaced: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per text: expected ranges that no replacement covers, their exposed characters, and replacements
    that touch no expected range."""
    e = expected.select(*keys, F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    r = replaced.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    meets = (F.col("e_start") < F.col("r_end")) & (F.col("e_end") > F.col("r_start"))
    covered = F.sum(F.when(meets, F.least("e_end", "r_end") - F.greatest("e_start", "r_start")).otherwise(0))
    per_expected = e.join(r, list(keys), "left").groupBy(*keys, "e_start", "e_end").agg(F.coalesce(covered, F.lit(0)).alias("covered"))
    misses = per_expected.groupBy(*keys).agg(
        F.count_if(F.col("covered") < F.col("e_end") - F.col("e_start")).alias("misses"),
        F.sum(F.greatest(F.col("e_end") - F.col("e_start") - F.col("covered"), F.lit(0))).cast("long").alias("exposed_chars"),
    )
    per_replaced = r.join(e, list(keys), "left").groupBy(*keys, "r_start", "r_end").agg(F.max(F.coalesce(meets, F.lit(False))).alias("wanted"))
    false = per_replaced.groupBy(*keys).agg(F.count_if(~F.col("wanted")).alias("false_redactions"))
    return misses.join(false, list(keys), "full_outer").fillna(0)
