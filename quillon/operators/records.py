"""Records of requests: cache misses, statistics by route, status, log parts, earlier thinking, cache behaviours."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import once
from quillon.operators.conversations import first_change

# cache misses

#: Texts of up to 2 ** STEPS characters are compared.
STEPS = 26


def first_difference(a: Column, b: Column) -> Column:
    """How many characters two texts share from their start: halving steps, so each text is read about once."""
    shorter = F.least(F.length(a), F.length(b))

    def step(at: Column, size: Column) -> Column:
        same = (at + size <= shorter) & (F.substring(a, at + 1, size) == F.substring(b, at + 1, size))
        return F.when(same, at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(STEPS, -1, -1)]), F.lit(0), step)


def without_markers(body: Column) -> Column:
    """A JSON text without its cache_control fields."""
    field = r'"cache_control"\s*:\s*(?:\{[^{}]*\}|null)'
    return F.regexp_replace(F.regexp_replace(body, r",\s*" + field, ""), field + r"\s*,?", "")


def _listed(holder: Column, *names: str) -> Column:
    """The JSON texts of the items of the first of the fields that an object has; a string is one item.

    Within a string quotes are escaped, so `"name": [` stands for a field that holds an array.
    """
    is_array = holder.rlike('"(?:' + "|".join(names) + r')"\s*:\s*\[')
    found = F.coalesce(*[F.get_json_object(holder, f"$.{n}") for n in names])
    return once(found, lambda value: F.when(is_array, F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>")))


def prompt_blocks(body: Column) -> Column:
    """array<struct<at,text>>: tools, system prompts, then each message's blocks, without markers."""

    def of_field(plain: Column, k: str) -> Column:
        return F.transform(_listed(plain, k), lambda x, i: F.struct(F.concat(F.lit(k + "["), i.cast("string"), F.lit("]")).alias("at"), x.alias("text")))

    def of_message(m: Column, i: Column) -> Column:
        content = F.coalesce(F.get_json_object(m, "$.content"), F.get_json_object(m, "$.parts"))
        name = F.concat(F.lit("m"), i.cast("string"))
        inner = F.transform(_listed(m, "content", "parts"), lambda x, j: F.struct(F.concat(name, F.lit("["), j.cast("string"), F.lit("]")).alias("at"), x.alias("text")))
        return F.when(content.isNull(), F.array(F.struct(name.alias("at"), m.alias("text")))).otherwise(inner)

    def of_body(plain: Column) -> Column:
        top = [of_field(plain, k) for k in ("tools", "system", "instructions", "systemInstruction")]
        return F.concat(*top, F.flatten(F.transform(_listed(plain, "messages", "input", "contents"), of_message)))

    return once(without_markers(body), of_body)


def first_changed_block(previous: Column, missed: Column, start: int = 200) -> Column:
    """struct<index,previous,missed>: the first prompt block that two bodies do not share; null where they share all."""
    side = lambda blocks, at: F.when(at < F.size(blocks), F.struct(F.get(blocks, at)["at"].alias("at"), F.left(F.get(blocks, at)["text"], F.lit(start)).alias("start")))

    def of_blocks(x: Column) -> Column:
        a, b = x["a"], x["b"]
        changed = first_change(F.transform(a, lambda y: y["text"]), F.transform(b, lambda y: y["text"]))
        return once(changed, lambda at: F.when(at.isNotNull(), F.struct(at.alias("index"), side(a, at).alias("previous"), side(b, at).alias("missed"))))

    return once(F.struct(prompt_blocks(previous).alias("a"), prompt_blocks(missed).alias("b")), of_blocks)


def miss_meta(misses: DataFrame, reach: int = 300) -> DataFrame:
    """Adds what a miss is filed with: diverges_at, sizes, both bodies around it and the first changed block."""
    at = first_difference(F.col("previous"), F.col("missed"))
    begin = F.greatest(F.lit(0), F.col("diverges_at") - reach)
    around = lambda c: F.substring(F.col(c), begin + 1, F.col("diverges_at") + reach - begin)
    return misses.withColumn("diverges_at", at).withColumns(
        {"previous_size": F.length("previous"), "missed_size": F.length("missed"), "previous_around": around("previous"), "missed_around": around("missed"), "first_changed": first_changed_block(F.col("previous"), F.col("missed"))}
    )


def save_misses(misses: DataFrame, path: str) -> None:
    """Append misses, a folder for each kind (step or turn), so that retention reads one kind at a time."""
    misses.withColumn("kind", F.when(F.col("is_step"), "step").otherwise("turn")).write.mode("append").partitionBy("kind").parquet(path)


def read_misses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_escape = re.compile(r"(?<!\\)(?:\\\\)*(\\(?:u[0-9A-Fa-f]{0,3})?|)$")


def clamped(text: str | None, limit: int) -> str | None:
    """A JSON text cut to `limit` characters, then to where its values are whole with the open brackets closed.

    The longest cut that parses wins; what is no array or object, or has no such cut, is cut plain.
    """
    if text is None or len(text) <= limit:
        return text
    head = text[:limit]
    if head[:1] not in ("{", "["):
        return head
    closing: list[str] = []
    cuts: list[tuple[int, str]] = []  # where to cut, and what closes it
    quoted, at = -1, 0
    while at < len(head):
        c = head[at]
        if quoted >= 0:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = -1
                cuts.append((at + 1, "".join(reversed(closing))))
        elif c == '"':
            quoted = at
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
            cuts.append((at + 1, "".join(reversed(closing))))
        elif c in "}]" and closing:
            closing.pop()
            cuts.append((at + 1, "".join(reversed(closing))))
        elif c == ",":
            cuts.append((at, "".join(reversed(closing))))
        at += 1
    end = "".join(reversed(closing))
    if quoted >= 0:  # within a string: before an escape that is not whole
        cuts.append((len(head) - len(_escape.search(head, quoted + 1)[1]), '"' + end))
    else:
        cuts.append((len(head), end))
    for cut, close in reversed(cuts):
        try:
            json.loads(head[:cut] + close)
        except ValueError:
            continue
        return head[:cut] + close
    return head


def clamp_to_json(limit: int):
    """A Column function: clamped() in Arrow batches, as built-in expressions have no JSON parser that stops early."""

    @F.pandas_udf("string")
    def clamp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: clamped(t, limit))

    return clamp


# statistics and status


def request_stats(requests: DataFrame, *by: str) -> DataFrame:
    """Counts, scan time and what shaping saved, by route or any other columns."""
    total = lambda c: F.sum(c).alias(c)
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n_requests"), F.sum("scan_ms").alias("scan_ms_total"), F.max("scan_ms").alias("scan_ms_max"), *[total(c) for c in ("masked", "compacted", "saved_chars")])


def status_book(requests: DataFrame, session: str = "session", order: str = "id") -> DataFrame:
    """Per request: how many came, the total masked, and how much of it since the last typed prompt.

    requests: prompts (typed so far), total. A new prompt makes the total before it the baseline.
    """
    by = Window.partitionBy(session).orderBy(order)
    before = F.lag("total").over(by)
    typed = F.col("prompts") > F.lag("prompts").over(by)
    marked = requests.withColumns({"n_requests": F.row_number().over(by), "base": F.when(typed, before)})
    baseline = F.coalesce(F.last("base", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return marked.withColumn("turn_total", F.greatest(F.lit(0), F.col("total") - baseline)).drop("base")


def latest_status(book: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The newest row of each session or route."""
    columns = [c for c in book.columns if c != key]
    newest = book.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s"))
    return newest.select(key, "s.*")


def usage_text(usage: Column) -> Column:
    """in/read/write/out."""
    return F.concat_ws("/", *[usage[c].cast("string") for c in ("input", "cache_read", "cache_write", "output")])


def cache_trail(style: Column, session: Column, is_main: Column, model: Column, markers: Column) -> Column:
    """The part of a log row on the prompt cache: the session's end, the model, and where markers stand."""
    at = F.when(session.isNotNull(), F.concat(F.lit(" session="), F.right(session, F.lit(8)))).otherwise("")
    named = F.when(F.length(model) > 0, F.concat(F.lit(" model="), F.regexp_replace(model, r"\s", "_"))).otherwise("")
    places = F.when((style == "anthropic") & is_main, F.concat(F.lit(" markers="), F.coalesce(F.nullif(F.array_join(markers, ","), F.lit("")), F.lit("none")))).otherwise("")
    return F.concat(at, named, places)


def price_summary(prices: DataFrame) -> DataFrame:
    """provider, line: how many models a provider has."""
    counted = prices.groupBy("provider").agg(F.count_distinct("model").alias("n"))
    return counted.select("provider", F.format_string("%s: %d models", F.col("provider"), F.col("n")).alias("line"))


def fixture_summary(results: DataFrame) -> DataFrame:
    """Totals over fixtures; those unsupported, limited or unmeasured are counted apart and add nothing else."""
    measured = (F.col("support") == "supported") & ~F.col("unavailable")
    total = lambda c: F.coalesce(F.sum(F.when(measured, F.col(c))), F.lit(0)).cast("long").alias(c)
    return results.agg(
        F.count(F.lit(1)).alias("n_fixtures"), F.count_if(F.col("support") == "unsupported").alias("n_unsupported"), F.count_if(F.col("support") == "limitation").alias("n_limitations"),
        F.count_if((F.col("support") == "supported") & F.col("unavailable")).alias("n_unavailable"), *[total(c) for c in ("misses", "exposed_chars", "false_redactions", "omissions")],
    )


def simulator_totals(reports: DataFrame, by: str = "format") -> DataFrame:
    """Sums over runs; the largest prompts are maxima, and runs with violations are counted."""
    sums = [F.sum(c).alias(c) for c in ("requests", "steps", "cost_on", "cost_off")]
    return reports.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), *sums, F.max("largest_on").alias("largest_on"), F.max("largest_off").alias("largest_off"), F.count_if(F.col("violations") > 0).alias("failing"))


def memo_hash(text: Column, seed: int) -> Column:
    """A seeded 64-bit hash: equal texts, equal hashes; another seed, other hashes."""
    return F.xxhash64(F.lit(seed).cast("long"), text)


# conversations


def earlier_thinking(entries: DataFrame, replies: DataFrame, session: str = "session") -> DataFrame:
    """entries: session, id, pos, digest; replies: session, id, count, last, thinking -> session, id, at, thinking.

    For each place in a request's conversation, the thinking of the newest earlier request of the session whose
    conversation ended there with the same entry. Both are put on one line by (session, place, digest) and the
    newest reply is carried forward, so requests are not compared in pairs.
    """
    nothing = F.lit(None).cast("string")
    asks = entries.select(session, "id", (F.col("pos") + 1).alias("at"), "digest", nothing.alias("reply"))
    ends = replies.where(F.length("thinking") > 0).select(session, "id", F.col("count").alias("at"), F.col("last").alias("digest"), F.col("thinking").alias("reply"))
    before = Window.partitionBy(session, "at", "digest").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    found = asks.union(ends).withColumn("thinking", F.last("reply", ignorenulls=True).over(before))
    lengths = entries.groupBy(session, "id").agg(F.max("pos").alias("last_pos"))
    found = found.where("reply is null and thinking is not null").join(lengths, [session, "id"])
    return found.where(F.col("at") <= F.col("last_pos")).select(session, "id", "at", "thinking")


def last_asked(items: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, at: the newest item that asks; -1 where none does."""
    return items.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col(order))), F.lit(-1)).alias("at"))


def forked_at(items: DataFrame, key: str = "conv_id", order: str = "turn", start: str = "<fork-boilerplate>") -> DataFrame:
    """key, at: where a fork's own conversation starts; -1 where it is none."""
    fork = (F.col("role") == "user") & F.startswith("text", F.lit(start))
    return items.groupBy(key).agg(F.coalesce(F.min(F.when(fork, F.col(order))), F.lit(-1)).alias("at"))


def keeps_tail(before: DataFrame, after: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, kept: whether the last item is of the same role afterwards."""
    last = lambda d, name: d.groupBy(key).agg(F.max_by("role", order).alias(name))
    both = last(before, "was").join(last(after, "is"), key, "left")
    return both.select(key, F.coalesce(F.col("was") == F.col("is"), F.lit(False)).alias("kept"))


def part_digests(body: Column) -> Column:
    """A SHA-1 for each part of a request in the order that providers cache them: model, tools, system, messages."""
    plain = without_markers(body)
    top = [F.sha1(F.coalesce(F.get_json_object(plain, f"$.{k}"), F.lit("null"))) for k in ("model", "tools", "system")]
    messages = _listed(plain, "messages", "input", "contents")
    return F.concat(F.array(*top), F.transform(messages, lambda m: F.sha1(m)))


def spread_batches(texts: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """key, order, size -> batch: largest first onto the lightest of n batches, within each key.

    Each choice depends on those before it; a key's sizes (not texts) are folded as one array.
    """
    listed = texts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), F.col(order).alias("o")))).alias("all"))
    start = F.struct(F.array(*[F.lit(0).cast("long")] * n).alias("loads"), F.array().cast("array<int>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["minus"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["out"], F.array(at)).alias("out"))

    placed = listed.select(key, F.explode(F.arrays_zip(F.col("all.o").alias("o"), F.aggregate("all", start, put, lambda acc: acc["out"]).alias("batch"))).alias("z"))
    return placed.select(key, F.col("z.o").alias(order), F.col("z.batch").alias("batch"))


# three behaviours of prompt caches: blocks are (session, id, pos, prefix digest, tokens)

MIN_PREFIX_TOKENS = 1024
LOOKBACK = 20


def _totals(blocks: DataFrame, session: str) -> DataFrame:
    upto = F.sum("tokens").over(Window.partitionBy(session, "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("upto", upto)


def pointed_cache(blocks: DataFrame, session: str = "session", least: int = MIN_PREFIX_TOKENS) -> DataFrame:
    """session, id, read, uncached: each request leaves a point at its end and one before its last asking block
    (column asks), and reads up to the furthest point that earlier ones left."""
    counted = _totals(blocks, session)
    ends = counted.groupBy(session, "id").agg(F.max("pos").alias("last"), F.max(F.when(F.col("asks"), F.col("pos"))).alias("asked"), F.sum("tokens").alias("total"))
    marked = counted.join(ends, [session, "id"])
    left = (F.col("pos") == F.col("last")) | (F.col("pos") == F.col("asked") - 1)
    earlier = F.max(F.when(left, 1)).over(Window.partitionBy(session, "prefix").orderBy("id").rangeBetween(Window.unboundedPreceding, -1))
    hit = marked.withColumn("hit", earlier.isNotNull())
    per = hit.groupBy(session, "id").agg(F.max("total").alias("total"), F.coalesce(F.max(F.when(F.col("hit"), F.col("upto"))), F.lit(0)).alias("read"))
    read = F.when(F.col("read") >= least, F.col("read")).otherwise(F.lit(0))
    return per.select(session, "id", read.alias("read"), (F.col("total") - read).alias("uncached"))


def implicit_cache(blocks: DataFrame, session: str = "session", least: int = MIN_PREFIX_TOKENS) -> DataFrame:
    """session, id, read, uncached: every prefix of an earlier request can be read."""
    counted = _totals(blocks, session)
    earlier = F.count(F.lit(1)).over(Window.partitionBy(session, "prefix").orderBy("id").rangeBetween(Window.unboundedPreceding, -1))
    per = counted.withColumn("hit", earlier > 0).groupBy(session, "id").agg(F.sum("tokens").alias("total"), F.coalesce(F.max(F.when(F.col("hit"), F.col("upto"))), F.lit(0)).alias("read"))
    read = F.when(F.col("read") >= least, F.col("read")).otherwise(F.lit(0))
    return per.select(session, "id", read.alias("read"), (F.col("total") - read).alias("uncached"))


def marked_cache(blocks: DataFrame, session: str = "session", lookback: int = LOOKBACK) -> DataFrame:
    """session, id, read, written, uncached: requests write at their markers (column marked), and a marker reads
    from the nearest entry within `lookback` blocks before it.

    What is in the cache is known from markers of earlier requests; within a request, markers are folded in order.
    """
    counted = _totals(blocks, session)
    earlier = F.max(F.when(F.col("marked"), 1)).over(Window.partitionBy(session, "prefix").orderBy("id").rangeBetween(Window.unboundedPreceding, -1))
    by = Window.partitionBy(session, "id").orderBy("pos")
    # the nearest entry at or before a marker; an entry of the request's own markers counts for later markers only
    stored_before = F.last(F.when(F.col("was_stored"), F.struct("pos", "upto")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    own_before = F.last(F.when(F.col("marked"), F.struct("pos", "upto")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = counted.withColumn("was_stored", earlier.isNotNull()).withColumns({"s": stored_before, "o": own_before}).where("marked")
    near = lambda c: F.when(F.col("pos") - F.col(c)["pos"] <= lookback, F.col(c)["upto"])
    # covered so far is the marker before; beyond it a marker reads up to the nearest entry and writes the rest
    covered = F.coalesce(F.col("o")["upto"], F.lit(0))
    hit = F.greatest(covered, F.coalesce(near("s"), F.lit(0)))
    per = marked.select(session, "id", (hit - covered).alias("read"), (F.col("upto") - hit).alias("written")).groupBy(session, "id").agg(F.sum("read").alias("read"), F.sum("written").alias("written"))
    totals = counted.groupBy(session, "id").agg(F.sum("tokens").alias("total"))
    joined = totals.join(per, [session, "id"], "left").fillna(0, ["read", "written"])
    return joined.select(session, "id", "read", "written", (F.col("total") - F.col("read") - F.col("written")).alias("uncached"))
