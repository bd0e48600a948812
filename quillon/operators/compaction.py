"""Passes that shorten tool outputs without losing what they say. Each is text -> text; compact() runs them
in order and keeps a pass only if its result is shorter. Lines are the one thing that takes rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHARS = 2000


def strip_control_sequences(v: Column) -> Column:
    """Escape sequences but colours go; a lone carriage return becomes a line feed; NULs go."""
    plain = F.regexp_replace(v, "\\x1b\\[[0-9;?]*[A-Za-ln-z]|\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)|\\x1b[()][A-Z0-9]|\\x1b[=>78cDEHM]", "")
    plain = F.regexp_replace(plain, "\\r(?!\\n)", "\n")
    return F.regexp_replace(plain, "\\x00", "")


COLOUR = "\\x1b\\[[0-9;]*m"
PROGRESS = r"[0-9]+(?:\.[0-9]+)?\s?%|\b[0-9]+/[0-9]+\b|\b[0-9]+(?:\.[0-9]+)?\s?(?:[KMGT]i?B|[kMG]B|B)(?:/s)?\b"


def progress_shape(line: Column) -> Column:
    """A progress row (a share, a count of a total, a size or a rate) with its numbers blanked; null for other lines."""
    plain = F.regexp_replace(line, COLOUR, "")
    return F.when(plain.rlike(PROGRESS), F.regexp_replace(plain, r"[0-9]+(?:\.[0-9]+)?", "#"))


def _islands(lines: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds a number for each run of neighbours with an equal value."""
    by = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("v", value)
    new = F.when(F.lag("v").over(by).eqNullSafe(F.col("v")) & (F.lag("pos").over(by) == F.col("pos") - 1), 0).otherwise(1)
    return marked.withColumn("new", new).withColumn(name, F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("v", "new")


def collapse_repeated_lines(rows: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10, blank: int = 4) -> DataFrame:
    """key, text, n_collapsed: runs of `least` equal lines become one line and a note, `blank` empty ones become one,
    and of `least` progress rows that differ in numbers only the first and the last stay.

    Gaps and islands over exploded lines. Texts with fewer lines than a run needs pass whole.
    """
    many = F.size(F.split(F.col(text), "\n", -1)) >= min(least, blank)
    short = rows.where(~F.coalesce(many, F.lit(False))).select(key, F.col(text), F.lit(0).cast("long").alias("n_collapsed"))
    lines = rows.where(many).select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    equal = _islands(lines, key, F.col("line"), "run")
    of_run = Window.partitionBy(key, "run")
    empty = F.trim("line") == ""
    sized = equal.withColumn("n", F.count(F.lit(1)).over(of_run)).withColumn("in_run", F.when(empty, F.col("n") >= blank).otherwise((F.col("n") >= least) & (F.trim(F.regexp_replace("line", COLOUR, "")) != "")))
    shape = F.when(~F.col("in_run"), progress_shape(F.col("line")))
    # lines without a shape are runs of their own
    similar = _islands(sized, key, F.coalesce(shape, F.concat(F.lit("\0"), F.col("pos").cast("string"))), "same")
    of_same = Window.partitionBy(key, "same")
    counted = similar.withColumns({"m": F.count(F.lit(1)).over(of_same), "first": F.min("pos").over(of_same), "last": F.max("pos").over(of_same), "run_first": F.min("pos").over(of_run), "shape": shape})
    in_same = F.col("shape").isNotNull() & (F.col("m") >= least)
    shown = (
        F.when(F.col("in_run") & (F.col("pos") > F.col("run_first")), F.lit(None)).when(F.col("in_run") & empty, F.lit(""))
        .when(F.col("in_run"), F.format_string("%s\n[%d more identical lines]", F.col("line"), F.col("n") - 1))
        .when(in_same & (F.col("pos") == F.col("first")), F.format_string("%s\n[%d similar progress lines]", F.col("line"), F.col("m") - 2))
        .when(in_same & (F.col("pos") < F.col("last")), F.lit(None)).otherwise(F.col("line"))
    )
    starts = (F.col("in_run") & (F.col("pos") == F.col("run_first"))) | (in_same & (F.col("pos") == F.col("first")))
    kept = counted.select(key, "pos", shown.alias("s"), starts.alias("starts"))
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("pos", "s")))).alias("all"), F.count_if(F.col("starts")).alias("n_collapsed"))
    return listed.select(key, F.array_join("all.s", "\n").alias(text), "n_collapsed").unionByName(short)


TIMESTAMP = r"^(?:\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\]?|[A-Z][a-z]{2} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}) ?"


def strip_log_timestamps(v: Column, least: int = 10) -> Column:
    """Time stamps at the start of lines go when at least so many lines have one."""
    lines = F.split(v, "\n", -1)
    stamped = F.size(F.filter(lines, lambda x: x.rlike(TIMESTAMP)))
    return F.when(stamped >= least, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, TIMESTAMP, "")), "\n")).otherwise(v)


BLOB_HEAD = 12


def collapse_blobs(v: Column, least: int = 1000) -> Column:
    """Base64 or hexadecimal runs of so many characters, with 8 different ones among the first 64, become their
    length and first characters."""
    pattern = rf"[A-Za-z0-9+/_-]{{{least},}}+={{0,2}}"
    pieces, blobs = F.split(v, pattern, -1), F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
    varied = lambda b: F.size(F.array_distinct(F.split(F.left(b, F.lit(64)), ""))) >= 8
    note = lambda b: F.concat(F.lit("[encoded blob, "), F.length(b).cast("string"), F.lit(" chars, starting "), F.left(b, F.lit(BLOB_HEAD)), F.lit("]"))
    shown = F.transform(blobs, lambda b: F.when(varied(b), note(b)).otherwise(b))
    return F.when(F.size(blobs) == 0, v).otherwise(F.array_join(F.flatten(F.zip_with(pieces, F.concat(shown, F.array(F.lit(""))), lambda p, s: F.array(p, s))), ""))


def minify_json(v: Column) -> Column:
    """White space outside strings goes where the whole text is JSON."""
    # strings and their escapes are matched first, so white space in them is never a match of its own
    small = F.regexp_replace(v, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")
    return F.when(F.trim(v).rlike(r"^[\[{]") & F.call_function("try_parse_json", v).isNotNull(), small).otherwise(v)


def _shorter(old: Column, new: Column) -> Column:
    return F.when(F.length(new) < F.length(old), new).otherwise(old)


def compact(rows: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_CHARS) -> DataFrame:
    """key, text: texts of some length after all five passes, each kept only if its result is shorter. Only texts
    that are long enough are cut into lines."""
    long = F.length(text) >= least
    plain = rows.where(~F.coalesce(long, F.lit(False))).select(key, text)
    cleared = rows.where(long).select(key, _shorter(F.col(text), strip_control_sequences(F.col(text))).alias(text))
    collapsed = collapse_repeated_lines(cleared, text, key).select(key, F.col(text).alias("collapsed"))
    out = cleared.join(collapsed, key).select(key, _shorter(F.col(text), F.col("collapsed")).alias(text))
    for one in (strip_log_timestamps, collapse_blobs, minify_json):
        out = out.select(key, _shorter(F.col(text), one(F.col(text))).alias(text))
    return out.unionByName(plain)


def rare_categories(values: DataFrame, doc: str, field: str, value: str) -> DataFrame:
    """Adds rare: whether a value of a field is rare among its items.

    Fields with 2 or more values and at most half as many as items: a value is rare that comes at most
    max(1, a tenth of the items) times; where over half of the items would be rare, none is.
    """
    per_value = values.groupBy(doc, field, value).agg(F.count(F.lit(1)).alias("n_value"))
    per_field = Window.partitionBy(doc, field)
    counted = per_value.withColumns({"n_items": F.sum("n_value").over(per_field), "n_values": F.count(F.lit(1)).over(per_field)})
    usable = (F.col("n_values") >= 2) & (F.col("n_values") * 2 <= F.col("n_items"))
    rare = usable & (F.col("n_value") <= F.greatest(F.lit(1), F.floor(F.col("n_items") / 10)))
    marked = counted.withColumn("maybe", rare)
    share = F.sum(F.when(F.col("maybe"), F.col("n_value")).otherwise(0)).over(per_field)
    return marked.withColumn("rare", F.col("maybe") & (share * 2 <= F.col("n_items"))).select(doc, field, value, "n_value", "rare")


def outliers(values: DataFrame, doc: str, value: str, sigmas: float = 3.0, least: int = 10) -> DataFrame:
    """Adds outlier: over so many population deviations from the mean of its group, of `least` numbers or more.

    Moments are aggregated and joined back, so a large group is no window in one task.
    """
    moments = values.groupBy(doc).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), F.count(value).alias("n"))
    joined = values.join(moments, doc)
    return joined.withColumn("outlier", (F.col("n") >= least) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sigma"))).drop("mean", "sigma", "n")


def crushed(items: DataFrame, doc: str = "doc_id", pos: str = "pos", rare: str = "rare", first: int = 3, last: int = 2, most: int = 20, least: int = 30) -> DataFrame:
    """Items that a long array keeps: the first and last ones, and up to `most` rare ones in order."""
    by = Window.partitionBy(doc)
    n = F.count(F.lit(1)).over(by)
    nth_rare = F.sum(F.when(F.col(rare), 1).otherwise(0)).over(by.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    marked = items.withColumns({"n_items": n, "nth_rare": nth_rare})
    keep = (F.col("n_items") < least) | (F.col(pos) < first) | (F.col(pos) >= F.col("n_items") - last) | (F.col(rare) & (F.col("nth_rare") <= most))
    return marked.where(keep).drop("n_items", "nth_rare")


def with_gap_markers(kept: DataFrame, n_items: Column, doc: str = "doc_id", pos: str = "pos", item: str = "item") -> DataFrame:
    """doc, items: kept items of an array in order, with a note for each gap between them and at its end."""
    before = F.coalesce(F.lag(pos).over(Window.partitionBy(doc).orderBy(pos)), F.lit(-1))
    note = lambda n: F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit(" similar item"), F.when(n > 1, "s").otherwise(""), F.lit(" omitted]")))
    marked = kept.withColumns({"gap": note(F.col(pos) - before - 1), "n_items": n_items})
    listed = marked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "gap", F.col(item).cast("string").alias("item")))).alias("all"), (F.max("n_items") - F.max(pos) - 1).alias("rest"))
    parts = F.flatten(F.transform("all", lambda x: F.array(x["gap"], x["item"])))
    return listed.select(doc, F.array_compact(F.concat(parts, F.array(note(F.col("rest"))))).alias("items"))
