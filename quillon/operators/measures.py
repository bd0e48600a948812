"""Statistics of requests: usage, prices, prompt-cache behaviour, breaks, cold starts, leaks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


USAGE = ("input", "cache_read", "cache_write", "output")


def usage_of(reply: Column, style: Column) -> Column:
    """Usage of a JSON reply as a struct of USAGE, where input never includes what was read from the cache.

    Styles: anthropic counts them apart; chat, responses and gemini count cached tokens within the input.
    """
    n = lambda path: F.coalesce(F.get_json_object(reply, path).cast("long"), F.lit(0).cast("long"))
    own = F.struct(n("$.usage.input_tokens").alias("input"), n("$.usage.cache_read_input_tokens").alias("cache_read"), n("$.usage.cache_creation_input_tokens").alias("cache_write"), n("$.usage.output_tokens").alias("output"))

    def within(prompt: str, cached: str, out: str) -> Column:
        read = F.least(n(cached), n(prompt))
        return F.struct((n(prompt) - read).alias("input"), read.alias("cache_read"), F.lit(0).cast("long").alias("cache_write"), n(out).alias("output"))

    return (
        F.when(style == "anthropic", own)
        .when(style == "chat", within("$.usage.prompt_tokens", "$.usage.prompt_tokens_details.cached_tokens", "$.usage.completion_tokens"))
        .when(style == "responses", within("$.usage.input_tokens", "$.usage.input_tokens_details.cached_tokens", "$.usage.output_tokens"))
        .when(style == "gemini", within("$.usageMetadata.promptTokenCount", "$.usageMetadata.cachedContentTokenCount", "$.usageMetadata.candidatesTokenCount"))
    )


def merged_usage(parts: DataFrame, reply: str = "reply") -> DataFrame:
    """Partial usages of one reply, by field the largest; input is the largest prompt without cached tokens."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    best = parts.groupBy(reply).agg(F.max(prompt).alias("prompt"), F.max("cache_read").alias("cache_read"), F.max("cache_write").alias("cache_write"), F.max("output").alias("output"))
    return best.select(reply, F.greatest(F.lit(0).cast("long"), F.col("prompt") - F.col("cache_read") - F.col("cache_write")).alias("input"), "cache_read", "cache_write", "output")


def usage_totals(usage: DataFrame, *by: str) -> DataFrame:
    return usage.groupBy(*by).agg(F.count(F.lit(1)).alias("n_replies"), *[F.sum(c).alias(c) for c in USAGE])


def cost(read: Column, write: Column, uncached: Column, read_price: Column, write_price: Column) -> Column:
    return read * read_price + write * write_price + uncached


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds read_price, write_price by model: the exact name, else the base name, else the most cautious of all.

    prices: model, read_price, write_price; a table of models, broadcast by its size.
    """
    from quillon.functions.text import model_base

    exact = prices.select(F.col("model").alias("p_model"), F.col("read_price").alias("r1"), F.col("write_price").alias("w1"))
    base = prices.groupBy(model_base(F.col("model")).alias("p_base")).agg(F.max("read_price").alias("r2"), F.max("write_price").alias("w2"))
    worst = prices.agg(F.max("read_price"), F.max("write_price")).first()
    joined = usage.join(exact, F.col("model") == F.col("p_model"), "left").join(base, model_base(F.col("model")) == F.col("p_base"), "left")
    return joined.select(*usage.columns, F.coalesce("r1", "r2", F.lit(worst[0])).alias("read_price"), F.coalesce("w1", "w2", F.lit(worst[1])).alias("write_price"))


def price_ratios(prices: DataFrame) -> DataFrame:
    """provider, model, input, cache_read, cache_write -> prices of the cache over that of the input."""
    ratio = lambda c: F.round(F.col(c) / F.col("input"), 4)
    return prices.where("input > 0").select("provider", "model", ratio("cache_read").alias("read_price"), ratio("cache_write").alias("write_price"))


def cold_starts(replies: DataFrame, session: str = "session", ts: str = "ts", lifetime_s: int = 300) -> DataFrame:
    """Adds idle_s (since the session's last reply) and cold (the cache's lifetime is over)."""
    before = F.lag(ts).over(Window.partitionBy(session).orderBy(ts))
    idle = (micros(ts) - micros(before)) / 1e6
    return replies.withColumn("idle_s", idle).withColumn("cold", F.coalesce(F.col("idle_s") > lifetime_s, F.lit(False)))


def cold_warning(idle: Column, lifetime_s: int, write: Column, read: Column, least: int = 15_000) -> Column:
    return (idle > lifetime_s) & (write >= least) & (read <= write)


def cache_breaks(requests: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """requests: key, order, digests (array by part), agent, redaction and shaping change flags.

    Adds broke_at (the first part that is not as in the request before, where that one does not simply go
    on) and cause.
    """
    from quillon.operators.conversations import first_change

    before = F.lag("digests").over(Window.partitionBy(key).orderBy(order))
    at = first_change(before, F.col("digests"))
    broke = before.isNotNull() & at.isNotNull() & (at < F.size(before))
    marked = requests.withColumn("broke_at", F.when(broke, at))
    cause = F.when(F.col("agent_changed"), "agent").when(F.col("redaction_changed"), "redaction").when(F.col("shaping_changed"), "shaping").otherwise("other")
    return marked.withColumn("cause", F.when(F.col("broke_at").isNotNull(), cause))


def break_counts(breaks: DataFrame) -> DataFrame:
    return breaks.where("broke_at is not null").groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def closest_reply(replies: DataFrame, session: str = "session") -> DataFrame:
    """session, id, prefixes (running digests): the earlier reply of the session with the longest shared start.

    Running digests make the shared start an equality: prefixes are exploded and each looks up the latest
    earlier request that had it, so the cost is one row per prefix and not per pair of requests.
    """
    points = replies.select(session, "id", F.posexplode("prefixes").alias("pos", "prefix"))
    earlier = F.max("id").over(Window.partitionBy(session, "prefix").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    shared = points.withColumn("earlier", earlier).where("earlier is not null")
    best = shared.groupBy(session, "id").agg(F.max(F.struct("pos", "earlier")).alias("best"))
    return best.select(session, "id", F.col("best.earlier").alias("closest"), (F.col("best.pos") + 1).alias("shared"))


def expected_read(prompt: Column, body: Column, changed: Column) -> Column:
    return prompt * (body - changed) / body


def short_read(read: Column, expected: Column, least: int = 4096) -> Column:
    return (expected >= least) & (read < expected * 0.5)


def tallies(entries: DataFrame, most: int = 200) -> DataFrame:
    """Per session: counts and the last time; the most recent sessions only."""
    per = entries.groupBy("session").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("kind").alias("n_kinds"), F.max("time").alias("last_time"))
    return per.orderBy(F.col("last_time").desc(), "session").limit(most)


def new_replacements(entries: DataFrame) -> DataFrame:
    """kind -> all replacements, and how many (kind, stand_in) pairs."""
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stand_in").alias("n_new"))


def leak_places(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy("source").agg(F.count_distinct("digest", "place").alias("n_places"))


def retained(rows: DataFrame, kind: str, time: str, size: str, per_kind: int, max_age_days: int, total_bytes: int) -> DataFrame:
    """Retention: not older than some days, the newest of each kind, and the newest up to a total size.

    The newest time is an aggregate. The running total is over what is left of the counts per kind, so it is bounded
    by them.
    """
    newest = rows.agg(F.max(time)).first()[0]
    fresh = rows.where(F.col(time) >= F.lit(newest) - F.expr(f"interval {max_age_days} days"))
    ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.col(time).desc(), size))).where(F.col("rank") <= per_kind)
    total = F.sum(size).over(Window.partitionBy(F.lit(1)).orderBy(F.col("rank"), F.col(time).desc(), kind).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).where(F.col("total") <= total_bytes).drop("rank", "total")


def newest_per_session(rows: DataFrame, session: str, order: str, n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def badge(model: Column, used: Column, limit: Column, read: Column) -> Column:
    return F.concat_ws(" · ", model, F.concat(F.round(100 * used / limit, 0).cast("int").cast("string"), F.lit("%")), F.concat(F.lit("read "), read.cast("string")))


def snippet(text: Column, value: Column, reach: int = 100) -> Column:
    """The text around a value, which is marked; null where it is not there."""
    at = F.call_function("locate", value, text)
    begin = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, begin, at - begin), F.lit("»"), value, F.lit("«"), F.substring(text, at + F.length(value), F.lit(reach))))


def plan_windows(headers: Column) -> Column:
    """Headers (a map) -> used shares of the five-hour and seven-day plan windows, within 0 and 100; null where absent."""
    share = lambda k: F.try_element_at(headers, F.lit(k)).cast("double") * 100
    used = lambda k: F.when(share(k).isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), share(k))))
    return F.struct(used("anthropic-ratelimit-unified-5h-utilization").alias("five_hours"), used("anthropic-ratelimit-unified-7d-utilization").alias("seven_days"))


def cache_model(requests: DataFrame, session: str = "session", lifetime_s: int = 300, least: int = 1024) -> DataFrame:
    """session, id, ts, blocks (array<struct<prefix,tokens>>) -> read, written and uncached tokens per request.

    A provider that keeps every prefix for some time: a request reads up to the last prefix that an earlier
    request of the session had within the lifetime (at least `least` tokens) and writes the rest.
    """
    points = requests.select(session, "id", "ts", F.posexplode("blocks").alias("pos", "block"))
    cum = F.sum("block.tokens").over(Window.partitionBy(session, "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    points = points.withColumn("upto", cum)
    last_ts = F.lag("ts").over(Window.partitionBy(session, "block.prefix").orderBy("ts", "id"))
    hit = points.withColumn("warm", (micros("ts") - micros(last_ts)) <= lifetime_s * 1_000_000)
    per = hit.groupBy(session, "id").agg(F.max("upto").alias("total"), F.coalesce(F.max(F.when(F.col("warm") & (F.col("upto") >= least), F.col("upto"))), F.lit(0)).alias("read"))
    return per.select(session, "id", "total", "read", (F.col("total") - F.col("read")).alias("written"))
