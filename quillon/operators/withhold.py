"""Withholding of tool results, images and lines, markers of prompt caches, and titles in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import clean_title
from quillon.operators.guards import secret_path

NOTICE = "[withheld: the file may hold secrets]"
IMAGE_NOTICE = "[image withheld]"
#: Fields that hold wire settings and not text, by their path in a request.
CONTROL_PATH = r"(?:^|\.)(?:model|role|type|stop_reason|finish_reason|media_type|tool_choice(?:\.type)?|stream|temperature|top_p|max_tokens|cache_control\.type|service_tier|object)$"
#: Fields that hold identifiers a provider gave out.
REFERENCE_PATH = r"(?:^|\.)(?:id|tool_use_id|tool_call_id|call_id|previous_response_id|response_id|signature|encrypted_content)$"
IMAGE_PATH = r"(?:^|\.)(?:source\.data|image_url(?:\.url)?|inline_?[dD]ata\.data|image_base64)$"


def is_protocol_control(path: Column) -> Column:
    return path.rlike(CONTROL_PATH)


def is_chain_reference(path: Column, value: Column) -> Column:
    """An identifier at its place, and shaped as one."""
    return path.rlike(REFERENCE_PATH) & value.rlike(r"^[A-Za-z0-9_\-+/=.:]{6,}$")


def is_image_payload(path: Column, value: Column) -> Column:
    return path.rlike(IMAGE_PATH) & (value.rlike("^data:image/") | (value.rlike(r"^[A-Za-z0-9+/\s]+=*$") & (F.length(value) >= 64)))


def scannable_number(n: Column) -> Column:
    """Whole numbers long enough to be an identifier; null for others."""
    return F.when((F.abs(n) >= 1e6) & (F.abs(n) < 1e21) & (n == F.floor(n)), F.format_string("%.0f", n.cast("double")))


def withhold_lines(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Search output: lines that name a secret file, or stand below a heading that does, become a notice.

    Headings are lines that are a path alone; one holds until the next empty line.
    """
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    heading = F.col("line").rlike(r"^[\w./~-]+$") & F.col("line").rlike("[./]")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.trim("line") == "", F.lit("")).when(heading, F.col("line"))
    named = F.regexp_extract("line", r"^([^\s:]+):", 1)
    under = lines.withColumn("heading", F.last(state, ignorenulls=True).over(so_far))
    hide = (secret_path(named) | secret_path(F.coalesce("heading", F.lit("")))) & ~heading & (F.trim("line") != "")
    shown = under.select(key, "pos", F.when(hide, F.lit(NOTICE)).otherwise(F.col("line")).alias("line"), hide.alias("hide"))
    listed = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"), F.count_if(F.col("hide")).alias("n_withheld"))
    return listed.select(key, F.array_join("all.line", "\n").alias(text), "n_withheld")


def withhold_secret_reads(results: DataFrame, calls: DataFrame, key: str = "call_id") -> DataFrame:
    """Results of calls that read a secret file become a notice. calls: key, path."""
    bad = calls.where(secret_path(F.col("path"))).select(F.col(key).alias("bad_call")).distinct()
    marked = results.join(bad, F.col(key) == F.col("bad_call"), "left")
    return marked.withColumn("text", F.when(F.col("bad_call").isNotNull(), F.lit(NOTICE)).otherwise(F.col("text"))).drop("bad_call")


def withhold_images(items: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Image items become a notice unless the prompt before them allowed images. items: allow_tags, is_image."""
    asked = F.when(F.col("role") == "user", F.array_contains("allow_tags", "images") | F.array_contains("allow_tags", "all"))
    allowed = F.coalesce(F.last(asked, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return items.withColumn("text", F.when(F.col("is_image") & ~allowed, F.lit(IMAGE_NOTICE)).otherwise(F.col("text")))


def cache_markers(items: DataFrame, key: str = "conv_id", order: str = "pos") -> DataFrame:
    """key, n-th marker and where it is. items: marked."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return items.where("marked").withColumn("nth", nth).select(key, "nth", order)


def marker_room(present: Column, redundant: Column, most: int = 4) -> Column:
    return most - present + F.when(redundant, 1).otherwise(0)


def mark_boundaries(items: DataFrame, wanted: DataFrame, key: str = "conv_id", order: str = "pos", most: int = 4) -> DataFrame:
    """key, pos: the last markable item at or before each wanted place; at most so many, the later ones.

    items: markable; wanted: key, at. Both are put on one line and carried forward, without a range join.
    """
    points = items.where("markable").select(key, F.col(order).alias("place"), F.col(order).alias("pos"), F.lit(0).alias("kind"))
    asks = wanted.select(key, F.col("at").alias("place"), F.lit(None).cast(points.schema["pos"].dataType).alias("pos"), F.lit(1).alias("kind"))
    so_far = Window.partitionBy(key).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = points.union(asks).withColumn("pos", F.last("pos", ignorenulls=True).over(so_far)).where("kind = 1 and pos is not null").select(key, "pos").distinct()
    later = F.row_number().over(Window.partitionBy(key).orderBy(F.col("pos").desc()))
    return found.withColumn("later", later).where(F.col("later") <= most).drop("later")


def title_ask(prompt: Column) -> Column:
    """Which request for a name a prompt is; null for others."""
    return F.when(prompt.rlike(r"(?i)\b(?:write|generate|give|create) (?:a|an?) (?:\w+[ ,]+){0,4}title\b"), "title").when(prompt.rlike(r"(?i)\bname (?:for )?(?:this|the) (?:branch|session|conversation)\b"), "name")


def title_from(reply: Column) -> Column:
    """The title in a reply: a JSON field, else the first line."""
    field = F.coalesce(F.get_json_object(reply, "$.title"), F.get_json_object(reply, "$.name"))
    return clean_title(F.coalesce(field, F.regexp_extract(reply, r"^\s*([^\n]*)", 1)))


def renamed_in(text: Column) -> Column:
    """The last name that a user gave to the session."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^/rename\s+(.+)$"), F.lit(1))
    return F.when(F.size(found) > 0, clean_title(F.element_at(found, -1)))


def redacted_path(path: Column, finds: str) -> Column:
    """Segments of a path that match go; identifiers that a provider gave out pass."""
    keep = r"^(?:msg|resp|chatcmpl|file|batch|run|thread|asst)[_-][A-Za-z0-9]+$"
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(keep), s).otherwise(F.regexp_replace(s, finds, "[redacted]"))), "/")
