"""Sources and sinks of conversation data: request bodies, event streams, journals, caches.

Four wire formats are read into one canonical table of items (conv_id, pos, role, kind, text, call_id,
name, arguments). Bodies are JSON strings; what does not parse, nests too deep or is too large goes to a
quarantine table with its reason, never silently away.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_CHARS = 32 << 20
MAX_DEPTH = 256


def format_for_path(path: Column) -> Column:
    return (
        F.when(path.rlike(r"/messages(?:\?|$)"), "anthropic").when(path.rlike(r"/chat/completions(?:\?|$)"), "chat")
        .when(path.rlike(r"/responses(?:\?|$)"), "responses").when(path.rlike(r":(?:streamG|g)enerateContent(?:\?|$)"), "gemini")
    )


def json_depth(body: Column) -> Column:
    """Nesting of a JSON text: the deepest running count of brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def checked_requests(rows: DataFrame, body: str = "body", max_chars: int = MAX_CHARS, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Requests that can be read, and the others with a status and a reason."""
    text = F.col(body)
    reason = (
        F.when(text.isNull(), "no body").when(F.length(text) > max_chars, "too large").when(~F.trim(text).rlike(r"^\{"), "not an object")
        .when(F.call_function("try_parse_json", text).isNull(), "not JSON").when(json_depth(text) > max_depth, "too deep")
    )
    marked = rows.withColumn("reason", reason)
    refused = marked.where("reason is not null").withColumn("status", F.when(F.col("reason") == "too large", 413).when(F.col("reason") == "not an object", 415).otherwise(400))
    return marked.where("reason is null").drop("reason"), refused


def _text_of(value: Column) -> Column:
    """A content field: a string, or the joined texts of its parts."""
    parts = F.from_json(value, "array<struct<type:string,text:string>>")
    return F.when(F.trim(value).rlike(r"^\["), F.array_join(F.filter(parts.getField("text"), lambda t: t.isNotNull()), "")).otherwise(value)


def items(requests: DataFrame, body: str = "body", style: str = "format", key: str = "conv_id") -> DataFrame:
    """key, pos, role, text of all messages of requests in the formats anthropic, chat, responses and gemini."""
    message = "array<struct<role:string,content:string,type:string,output:string,name:string,arguments:string,call_id:string>>"
    gemini = "array<struct<role:string,parts:array<struct<text:string>>>>"
    plain = F.when(F.col(style) == "responses", F.from_json(F.get_json_object(body, "$.input"), message)).otherwise(F.from_json(F.get_json_object(body, "$.messages"), message))
    common = F.transform(plain, lambda m: F.struct(F.coalesce(m["role"], F.when(m["type"].rlike("_output$"), "tool"), F.lit("assistant")).alias("role"), F.coalesce(_text_of(m["content"]), m["output"], m["arguments"]).alias("text")))
    other = F.transform(F.from_json(F.get_json_object(body, "$.contents"), gemini), lambda m: F.struct(F.when(m["role"] == "model", "assistant").otherwise(F.coalesce(m["role"], F.lit("user"))).alias("role"), F.array_join(F.filter(m["parts"]["text"], lambda t: t.isNotNull()), "").alias("text")))
    chosen = F.when(F.col(style) == "gemini", other).otherwise(common)
    return requests.select(key, F.posexplode(chosen).alias("pos", "m")).select(key, "pos", "m.role", "m.text")


def to_body(rows: DataFrame, style: str, key: str = "conv_id") -> DataFrame:
    """Items back to one request body per conversation, in a format."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("all"))
    if style == "gemini":
        contents = F.transform("all", lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), F.array(F.struct(m["text"].alias("text"))).alias("parts")))
        return listed.select(key, F.to_json(F.struct(contents.alias("contents"))).alias("body"))
    messages = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return listed.select(key, F.to_json(F.struct(messages.alias("input" if style == "responses" else "messages"))).alias("body"))


def sse_events(rows: DataFrame, raw: str = "raw", *keys: str) -> DataFrame:
    """Server-sent events of a text: keys, pos, event, data (its lines joined)."""
    blocks = F.filter(F.split(F.col(raw), r"\r?\n\r?\n"), lambda b: F.length(F.trim(b)) > 0)
    exploded = rows.select(*keys, F.posexplode(blocks).alias("pos", "block"))
    data = F.regexp_extract_all("block", F.lit(r"(?m)^data: ?(.*?)\r?$"), F.lit(1))
    event = F.regexp_extract("block", r"(?m)^event: ?(.*?)\r?$", 1)
    return exploded.select(*keys, "pos", F.when(event != "", event).alias("event"), F.array_join(data, "\n").alias("data")).where(F.length("data") > 0)


def to_sse(event: Column, data: Column) -> Column:
    return F.concat(F.when(event.isNotNull(), F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise(""), F.lit("data: "), F.regexp_replace(data, "\n", "\ndata: "), F.lit("\n\n"))


def reply_text(raw: Column) -> Column:
    """The text of a whole JSON reply of any format."""
    content = F.from_json(F.get_json_object(raw, "$.content"), "array<struct<type:string,text:string>>")
    return F.coalesce(F.get_json_object(raw, "$.choices[0].message.content"), F.array_join(F.filter(content["text"], lambda t: t.isNotNull()), ""), F.get_json_object(raw, "$.output_text"), F.get_json_object(raw, "$.candidates[0].content.parts[0].text"))


def thinking_text(raw: Column) -> Column:
    content = F.from_json(F.get_json_object(raw, "$.content"), "array<struct<type:string,thinking:string>>")
    return F.array_join(F.filter(content, lambda c: c["type"] == "thinking")["thinking"], "")


def journal_line(entries: DataFrame) -> DataFrame:
    """One text row per request, as a log sink writes it."""
    line = F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.col("route"), F.col("status").cast("string"), F.format_string("%dms", F.col("scan_ms")), F.format_string("redacted=%d", F.col("redacted")))
    return entries.select(line.alias("value"))


def append_journal(rows: DataFrame, path: str) -> None:
    """Append-only rows (digest, original, seq)."""
    rows.write.mode("append").parquet(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame | None:
    """The live rows of a journal: the newest of each digest; null where there is no journal yet."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("seq").desc()))).where("nth = 1").drop("nth")


def compacted(spark: SparkSession, path: str, to: str, ratio: float = 2.0) -> bool:
    """Write the live rows of a journal to another path when it holds `ratio` times as many; tells whether it did."""
    live = read_journal(spark, path)
    if live is None or spark.read.parquet(path).count() < ratio * live.count():
        return False
    live.write.mode("overwrite").parquet(to)
    return True


def scan_cache(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """Stored findings of texts by digest, of the same rules only."""
    try:
        return spark.read.parquet(path).where(F.col("fingerprint") == fingerprint)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def pages_since(entries: DataFrame, since: int) -> DataFrame:
    """What a poll gets: entries after an id, in order."""
    return entries.where(F.col("id") > since).orderBy("id")


# Free mail providers, forges and their relays, and second-level labels below country codes.
MAIL_PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "outlook.de", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.de", "ymail.com", "icloud.com", "me.com", "mac.com", "proton.me", "protonmail.com", "pm.me",
    "gmx.de", "gmx.net", "gmx.at", "gmx.com", "web.de", "t-online.de", "posteo.de", "mailbox.org", "aol.com", "mail.com", "fastmail.com", "hey.com", "tutanota.com", "tuta.io", "zoho.com", "yandex.ru", "mail.ru", "qq.com", "163.com",
)
FORGES = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")
SECOND_LEVEL = "co|com|ac|org|net|gov|edu|ne|or"


def mail_domain(address: Column, public: tuple[str, ...] = MAIL_PROVIDERS + FORGES) -> Column:
    """The registrable domain of an address; null for free providers, forges' relays and example domains."""
    domain = F.regexp_replace(F.lower(F.trim(F.substring_index(address, "@", -1))), r"\.$", "")
    sound = domain.rlike(r"^[a-z0-9-]+(?:\.[a-z0-9-]+)+$")
    long = domain.rlike(rf"\.(?:{SECOND_LEVEL})\.[a-z0-9-]+$")
    registrable = F.when(long, F.substring_index(domain, ".", -3)).otherwise(F.substring_index(domain, ".", -2))
    own = ~registrable.isin(*public) & ~registrable.rlike(r"^(?:users\.)?noreply\.|^example\.(?:com|org|net)$")
    return F.when(F.contains(address, F.lit("@")) & sound & own, registrable)


def remote_host(url: Column) -> Column:
    """Host of a git remote: an address, or user@host:path."""
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z+]+://(?:[^@/]*@)?([^/:]+)", 1), F.lit("")), F.regexp_extract(url, r"^(?:[^@/\s]+@)?([^/:\s]+):", 1)), F.lit(""))


def remote_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[^@\s]+@(?:github\.com|gitlab\.com|bitbucket\.org|codeberg\.org):([^/]+)/", 1), F.lit(""))


def remote_urls(config: Column) -> Column:
    return F.regexp_extract_all(config, F.lit(r"(?m)^\s*url\s*=\s*(\S+)"), F.lit(1))
