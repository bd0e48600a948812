"""Queries over conversations, shaping and statistics, each with the same question in plain SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import compaction as K
from quillon.operators import conversations as C
from quillon.operators import guards as G
from quillon.operators import measures as M
from quillon.operators import shell as S
from quillon.plans.detection import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("conversation_turns", "SELECT conv_id, turn, role, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS assistant_turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, greatest(0, CAST(ceil(length(text) / 4.0) AS BIGINT) - 50) AS gain FROM conversations")
def conversation_turns(spark, sf_dir):
    return C.sizes(table(spark, sf_dir, "conversations")).drop("text")


@query("typed_prompts", """WITH t AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations), f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'user' AND length(text) > 0),
l AS (SELECT conv_id, n, split_part(ltrim(text), chr(10), 1) AS line FROM f WHERE k = 1) SELECT conv_id, n AS n_prompts, left(CASE WHEN regexp_matches(line, '[.!?]\\s') THEN regexp_extract(line, '^(.*?[.!?])\\s', 1) ELSE line END, 80) AS first_prompt FROM l""")
def typed_prompts(spark, sf_dir):
    return C.typed_prompts(table(spark, sf_dir, "conversations")).where("n_prompts > 0")


@query("conversation_title", """WITH t AS (SELECT conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, arg_min(t, turn) AS t FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS title FROM f""")
def conversation_title(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = items.select(F.col("conv_id").alias("session"), F.lit("guess").alias("source"), (-F.col("turn")).alias("seq"), F.col("text").alias("title"))
    return C.session_titles(first).select(F.col("session").alias("conv_id"), "title")


_word = "regexp_matches(text, '\\b[Ii]diot|%%%')"


@query("sticky_labels", "SELECT conv_id, turn, bool_or(regexp_matches(text, '[0-9]{3}')) OVER w AS untrusted, bool_or(role = 'system') OVER w AS private FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sticky_labels(spark, sf_dir):
    return C.sticky_labels(table(spark, sf_dir, "conversations"), F.col("text").rlike("[0-9]{3}"), F.col("role") == "system").select("conv_id", "turn", "untrusted", "private")


TAGGED = "CASE WHEN turn % 4 = 0 THEN '[allow:pii, secret] ' || text ELSE text END"


@query("tag_carry_forward", """WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND turn % 4 = 0 THEN 'pii|secret' ELSE '' END AS tags FROM conversations),
g AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM t) SELECT g.conv_id, g.turn, coalesce(u.tags, '') AS tags FROM g LEFT JOIN t u ON u.conv_id = g.conv_id AND u.turn = g.at""")
def tag_carry_forward(spark, sf_dir):
    items = table(spark, sf_dir, "conversations")
    marked = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 4 == 0), F.concat(F.lit("[allow:pii, secret] "), "text")).otherwise(F.col("text"))
    return C.with_turn_tags(items.withColumn("text", marked)).select("conv_id", "turn", F.array_join("allow_tags", "|").alias("tags"))


@query("session_numbering", "WITH s AS (SELECT user_id AS client, user_id * 1000 + CAST(value AS BIGINT) % 7 AS session, min(ts) AS first_seen FROM events GROUP BY 1, 2) SELECT client, session, row_number() OVER (PARTITION BY client ORDER BY first_seen, session) AS n FROM s")
def session_numbering(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), (F.col("user_id") * 1000 + F.round("value").cast("long") % 7).alias("session"), "ts")
    first = events.groupBy("client", "session").agg(F.min("ts").alias("first_seen"))
    return C.session_numbers(first).select("client", "session", F.col("n").cast("long").alias("n"))


SQL["session_numbering"] = "WITH s AS (SELECT user_id AS client, user_id * 1000 + CAST(round(value) AS BIGINT) % 7 AS session, min(ts) AS first_seen FROM events GROUP BY 1, 2) SELECT client, session, row_number() OVER (PARTITION BY client ORDER BY first_seen, session) AS n FROM s"


@query("dedupe_outputs", "WITH d AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_doc FROM documents) SELECT doc_id, first_doc, first_doc < doc_id AS is_repeat FROM d")
def dedupe_outputs(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("turn"), "text")
    return C.repeated_outputs(items).select(F.col("turn").alias("doc_id"), F.col("first_turn").alias("first_doc"), "is_repeat")


@query("repeated_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, l FROM l), g AS (SELECT doc_id, i, l[i] AS line, CASE WHEN i > 1 AND l[i] = l[i - 1] THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), n AS (SELECT doc_id, run, any_value(line) AS line, count(*) AS n FROM r GROUP BY doc_id, run) SELECT doc_id, count(*) FILTER (WHERE CASE WHEN trim(line) = '' THEN n >= 4 ELSE n >= 2 END) AS n_collapsed FROM n GROUP BY doc_id""")
def repeated_lines(spark, sf_dir):
    return K.collapse_repeated_lines(table(spark, sf_dir, "documents"), least=2).select("doc_id", "n_collapsed")


@query("log_timestamp_strip", """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, md5(string_agg(CASE WHEN n >= 10 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ ') END || 'event ' || event_id::VARCHAR, chr(10) ORDER BY event_id)) AS stripped FROM (SELECT *, count(*) OVER (PARTITION BY event_type, date_trunc('day', ts)) AS n FROM events) GROUP BY 1, 2""")
def log_timestamp_strip(spark, sf_dir):
    """Logs of a day and type of event, with a time stamp before each line, that are taken off again."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" event "), F.col("event_id").cast("string"))
    logs = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("all"))
    return logs.select("event_type", "day", F.md5(K.strip_log_timestamps(F.array_join("all.line", "\n"))).alias("stripped"))


@query("json_minify", "SELECT event_id, replace(props, ' ', '') AS small FROM events")
def json_minify(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.minify_json(F.col("props")).alias("small"))


@query("json_field_scan", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("blob_collapse")
def blob_collapse(spark, sf_dir):
    """Texts with a base64 copy of themselves behind, collapsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", "")).alias("text"))
    return docs.select("doc_id", F.length(K.collapse_blobs(F.col("text"))).cast("long").alias("n_chars"), F.length("text").cast("long").alias("before"))


@query("compact_outputs")
def compact_outputs(spark, sf_dir):
    return K.compact(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "page_id").select("page_id", F.md5("html").alias("text_hash"))


@query("crush_rare_values", """WITH v AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n_value FROM orders GROUP BY 1, 2), c AS (SELECT *, sum(n_value) OVER w AS n_items, count(*) OVER w AS n_values FROM v WINDOW w AS (PARTITION BY o_orderstatus)),
m AS (SELECT *, n_values >= 2 AND n_values * 2 <= n_items AND n_value <= greatest(1, floor(n_items / 10.0)) AS maybe FROM c), s AS (SELECT *, sum(CASE WHEN maybe THEN n_value ELSE 0 END) OVER (PARTITION BY o_orderstatus) AS share FROM m) SELECT o_orderstatus, o_orderpriority, n_value, maybe AND share * 2 <= n_items AS rare FROM s""")
def crush_rare_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.lit("priority").alias("field"), "o_orderpriority")
    return K.rare_categories(rows, "o_orderstatus", "field", "o_orderpriority").drop("field")


@query("crush_outliers", "WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sigma, count(value) AS n FROM events GROUP BY event_type) SELECT event_id, n >= 10 AND abs(value - mean) > 2.0 * sigma AS outlier FROM events JOIN m USING (event_type)")
def crush_outliers(spark, sf_dir):
    return K.outliers(table(spark, sf_dir, "events"), "event_type", "value", sigmas=2.0).select("event_id", "outlier")


@query("crush_array", """WITH i AS (SELECT l_suppkey, l_quantity >= 49 AS rare, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos FROM lineitem),
k AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n, sum(CASE WHEN rare THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY pos) AS nth FROM i) SELECT l_suppkey, pos FROM k WHERE n < 30 OR pos < 3 OR pos >= n - 2 OR (rare AND nth <= 20)""")
def crush_array(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", pos.cast("long").alias("pos"), (F.col("l_quantity") >= 49).alias("rare"))
    return K.crushed(items, "l_suppkey").select("l_suppkey", "pos")


@query("stub_masking", """WITH s AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, a <= 2 AND length(text) >= 400 AS masked FROM s""")
def stub_masking(spark, sf_dir):
    return C.masked(C.sizes(table(spark, sf_dir, "conversations")), F.lit(2), 400).select("conv_id", "turn", "masked")


@query("output_ids", "SELECT doc_id, left(replace(replace(base64(unhex(sha256(text))), '+', '-'), '/', '_'), 12) AS id FROM documents")
def output_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.output_id(F.col("text")).alias("id"))


@query("cutoff_fold")
def cutoff_fold(spark, sf_dir):
    items = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("conv_id"), F.col("event_id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), F.round("value").cast("int") % 200).alias("text"))
    return C.cutoffs(items, least=500)


USAGE_SQL = "u AS (SELECT event_id AS reply, user_id AS session, ts, 'model-' || CAST(user_id % 3 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '-20250101' ELSE '' END AS model, CAST(round(value * 10) AS BIGINT) AS input, CAST(event_id % 997 AS BIGINT) AS cache_read, CAST(event_id % 31 AS BIGINT) AS cache_write, CAST(event_id % 113 AS BIGINT) AS output FROM events)"


def usage_rows(spark, sf_dir):
    """Usage rows that follow from events."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    model = F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"), F.when(F.col("user_id") % 2 == 0, "-20250101").otherwise(""))
    return e.select(i.alias("reply"), F.col("user_id").alias("session"), "ts", model.alias("model"), F.round(F.col("value") * 10).cast("long").alias("input"), (i % 997).alias("cache_read"), (i % 31).alias("cache_write"), (i % 113).alias("output"))


@query("usage_totals", f"WITH {USAGE_SQL} SELECT session, count(*) AS n_replies, sum(input)::BIGINT AS input, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(output)::BIGINT AS output FROM u GROUP BY session")
def usage_totals(spark, sf_dir):
    return M.usage_totals(usage_rows(spark, sf_dir), "session")


@query("usage_merge", f"WITH {USAGE_SQL}, m AS (SELECT session AS reply, max(input + cache_read + cache_write) AS p, max(cache_read) AS cache_read, max(cache_write) AS cache_write, max(output) AS output FROM u GROUP BY session) SELECT reply, greatest(0, p - cache_read - cache_write) AS input, cache_read, cache_write, output FROM m")
def usage_merge(spark, sf_dir):
    return M.merged_usage(usage_rows(spark, sf_dir).drop("reply").withColumnRenamed("session", "reply"))


@query("usage_normalised", "WITH u AS (SELECT event_id, CAST(round(value * 10) AS BIGINT) AS p, CAST(event_id % 997 AS BIGINT) AS c, event_id % 2 = 0 AS own FROM events) SELECT event_id, CASE WHEN own THEN p ELSE p - least(c, p) END AS input, CASE WHEN own THEN c ELSE least(c, p) END AS cache_read FROM u")
def usage_normalised(spark, sf_dir):
    rows = usage_rows(spark, sf_dir)
    own = F.format_string('{"usage":{"input_tokens":%d,"cache_read_input_tokens":%d}}', "input", "cache_read")
    chat = F.format_string('{"usage":{"prompt_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d}}}', "input", "cache_read")
    even = F.col("reply") % 2 == 0
    used = M.usage_of(F.when(even, own).otherwise(chat), F.when(even, "anthropic").otherwise("chat"))
    return rows.select(F.col("reply").alias("event_id"), used["input"].alias("input"), used["cache_read"].alias("cache_read"))


@query("price_lookup", f"""WITH {USAGE_SQL}, p AS (SELECT * FROM (VALUES ('model-0', 0.1, 1.25), ('model-1-20250101', 0.2, 1.5), ('other', 0.5, 2.0)) t(model, r, w)),
b AS (SELECT regexp_replace(model, '-20[0-9]{{6}}$', '') AS model, max(r) AS r, max(w) AS w FROM p GROUP BY 1)
SELECT reply, coalesce(p.r, b.r, 0.5)::DOUBLE AS read_price, round(cache_read * coalesce(p.r, b.r, 0.5)::DOUBLE + cache_write * coalesce(p.w, b.w, 2.0)::DOUBLE + input, 6) AS cost FROM u LEFT JOIN p ON p.model = u.model LEFT JOIN b ON b.model = regexp_replace(u.model, '-20[0-9]{{6}}$', '')""")
def price_lookup(spark, sf_dir):
    prices = spark.createDataFrame([("model-0", 0.1, 1.25), ("model-1-20250101", 0.2, 1.5), ("other", 0.5, 2.0)], "model string, read_price double, write_price double")
    rows = M.priced(usage_rows(spark, sf_dir), prices)
    return rows.select("reply", "read_price", F.round(M.cost(F.col("cache_read"), F.col("cache_write"), F.col("input"), F.col("read_price"), F.col("write_price")), 6).alias("cost"))


@query("cold_starts", "WITH l AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idle FROM events) SELECT event_id, coalesce(idle / 1e6 > 3600, false) AS cold FROM l")
def cold_starts(spark, sf_dir):
    return M.cold_starts(table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")), "user_id", "ts", 3600).select("event_id", "cold")


@query("cache_breaks", """WITH i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn, (conv_id * 31 + turn * 17) % 5 = 0 AS edits FROM conversations),
r AS (SELECT conv_id, p, turn, (turn * 7 + conv_id) % (p - 1) AS spot FROM i WHERE p > 2 AND edits) SELECT CASE WHEN turn % 3 = 0 THEN 'agent' WHEN turn % 3 = 1 THEN 'redaction' ELSE 'shaping' END AS cause, count(*) AS n, CAST(sum(spot) AS BIGINT) AS places FROM r GROUP BY 1""")
def cache_breaks(spark, sf_dir):
    """Requests that grow by an item a time; some have one part changed, at a place that follows from their ids. Each
    request is held against the one before as it would have been without the change."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    grown = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list(F.sha1(F.concat_ws("/", "conv_id", "turn", "role", "text"))).over(so_far).alias("d"))
    size, edits = F.size("d"), (F.col("conv_id") * 31 + F.col("turn") * 17) % 5 == 0
    at = ((F.col("turn") * 7 + F.col("conv_id")) % (size - 1)).cast("int")
    changed = F.when(edits & (size > 2), F.transform("d", lambda x, i: F.when(i == at, F.concat(x, F.lit("'"))).otherwise(x))).otherwise(F.col("d"))
    flags = ((F.col("turn") % 3 == 0).alias("agent_changed"), (F.col("turn") % 3 == 1).alias("redaction_changed"), F.lit(True).alias("shaping_changed"))
    # a pair per item: the request before it, and this one
    before = grown.select(F.concat_ws("/", "conv_id", "turn").alias("pair"), F.lit(0).alias("nth"), F.expr("slice(d, 1, greatest(size(d) - 1, 0))").alias("digests"), *flags)
    now = grown.select(F.concat_ws("/", "conv_id", "turn").alias("pair"), F.lit(1).alias("nth"), changed.alias("digests"), *flags)
    return M.cache_breaks(before.union(now), "pair", "nth").where("broke_at is not null").groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.sum("broke_at").cast("long").alias("places"))


@query("closest_reply", """WITH p AS (SELECT o_custkey AS session, o_orderkey AS id, unnest([1, 2, 3]) AS pos, o_orderpriority, o_orderstatus, o_orderkey FROM orders), x AS (SELECT session, id, pos, CASE pos WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderstatus || o_orderpriority ELSE o_orderstatus || o_orderpriority || CAST(o_orderkey % 3 AS VARCHAR) END AS prefix FROM p),
e AS (SELECT session, id, pos, max(id) OVER (PARTITION BY session, prefix ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM x) SELECT session, id, arg_max(earlier, pos) AS closest, max(pos)::INT AS shared FROM e WHERE earlier IS NOT NULL GROUP BY session, id""")
def closest_reply(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    two = F.concat("o_orderstatus", "o_orderpriority")
    prefixes = F.array(F.col("o_orderstatus"), two, F.concat(two, (F.col("o_orderkey") % 3).cast("string")))
    return M.closest_reply(o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), prefixes.alias("prefixes")))


@query("retention_topn", """WITH f AS (SELECT event_id, event_type, ts, length(props) AS size, max(ts) OVER () AS newest FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, size, event_id) AS k FROM f WHERE ts >= newest - INTERVAL 14 DAYS)
SELECT event_type, count(*) AS n FROM r WHERE k <= 50 GROUP BY event_type""")
def retention_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.length("props").alias("size"))
    return M.retained(rows, "event_type", "ts", "size", 50, 14, 10**12).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("newest_per_session", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def newest_per_session(spark, sf_dir):
    return M.newest_per_session(table(spark, sf_dir, "events"), "user_id", "event_id", 3).select("user_id", "event_id")


@query("session_tallies", "SELECT session, n_entries, n_kinds FROM (SELECT user_id AS session, count(*) AS n_entries, count(DISTINCT event_type) AS n_kinds, max(event_id) AS t FROM events GROUP BY 1) ORDER BY t DESC, session LIMIT 200")
def session_tallies(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.col("event_id").alias("time"))
    return M.tallies(entries).drop("last_time")


@query("leak_places", "SELECT event_type AS source, count(DISTINCT (user_id, props)) AS n_places FROM events GROUP BY 1")
def leak_places(spark, sf_dir):
    return M.leak_places(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("digest"), F.col("props").alias("place")))


@query("badge_text", f"WITH {USAGE_SQL} SELECT reply, concat_ws(' · ', model, CAST(CAST(round(100.0 * cache_read / 997, 0) AS INT) AS VARCHAR) || '%', 'read ' || CAST(cache_read AS VARCHAR)) AS badge FROM u")
def badge_text(spark, sf_dir):
    rows = usage_rows(spark, sf_dir)
    return rows.select("reply", M.badge(F.col("model"), F.col("cache_read"), F.lit(997), F.col("cache_read")).alias("badge"))


@query("html_text_scan", "SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"[^\"]*\"')) AS n_links, len(regexp_extract_all(html, '&[a-z]+;')) AS n_references FROM pages")
def html_text_scan(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", count(r'(?i)<a\s[^>]*href="[^"]*"').alias("n_links"), count("&[a-z]+;").alias("n_references"))


@query("url_query_scan", "WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS pair FROM pages WHERE contains(url, '?')) SELECT page_id, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2) AS value FROM q")
def url_query_scan(spark, sf_dir):
    pairs = F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")
    rows = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?"))).select("page_id", F.explode(pairs).alias("pair"))
    return rows.select("page_id", F.split_part("pair", F.lit("="), F.lit(1)).alias("name"), F.split_part("pair", F.lit("="), F.lit(2)).alias("value"))


@query("guard_selectors", """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Write' WHEN 2 THEN 'WebFetch' ELSE 'mcp__db__run' END AS tool, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN tool = 'Bash' AND k = 0 THEN 'deny' WHEN tool = 'Write' AND k IN (1, 2) OR tool LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'prompt' WHEN tool = 'WebFetch' THEN 'allow' END AS decision FROM c""")
def guard_selectors(spark, sf_dir):
    k = F.col("o_orderkey")
    tool = F.when(k % 4 == 0, "Bash").when(k % 4 == 1, "Write").when(k % 4 == 2, "WebFetch").otherwise("mcp__db__run")
    command = F.when(k % 5 == 0, "rm -rf build").otherwise("ls -l src")
    path = F.when((k % 5).isin(1, 2), "conf/app.toml").otherwise("src/app.py")
    calls = table(spark, sf_dir, "orders").select("o_orderkey", tool.alias("tool"), F.to_json(F.struct(command.alias("command"), path.alias("file_path"))).alias("arguments"))
    return G.decide(calls, ["Bash(command:rm *)"], ["Write(file_path:conf/*)", "mcp__*"], ["WebFetch"]).select("o_orderkey", "decision")


@query("shell_programs")
def shell_programs(spark, sf_dir):
    commands = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("cat f"), (F.col("o_orderkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " | sed -i s/a/b/ x").otherwise(" | grep -c '; x'")).alias("command"))
    return S.with_programs(commands).select("o_orderkey", F.size("programs").alias("n_programs"), "only_reads")


@query("known_value_search", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def known_value_search(spark, sf_dir):
    """Passages of the benchmark that stand whole in documents: joined by words inside them, then compared.

    A passage's first and last words may be parts of a document's words; those between are words of it. Up to
    five of them are looked up among the document's windows of as many words, so the cost is one row per window
    and not per pair of texts. Passages of one or two words have none between and are compared with every text.
    """
    words = lambda c: F.split(c, r"\s+")
    window = lambda c, i, n: F.array_join(F.slice(c, i, n), " ")
    inner = F.least(F.size(words(F.col("text"))) - 2, F.lit(5))
    passages = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("passage"), inner.alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    looked_up = passages.where("n > 0").withColumn("key", window(words(F.col("passage")), F.lit(2), F.col("n")))
    lengths = F.broadcast(looked_up.select("n").distinct())  # 1 to 5
    w = docs.select("doc_id", words(F.col("text")).alias("w")).join(lengths, F.size("w") >= F.col("n"))
    keys = w.select("doc_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: window(F.col("w"), i, F.col("n")))).alias("key"))
    candidates = keys.join(looked_up.select("item_id", "n", "key"), ["n", "key"]).select("doc_id", "item_id").distinct()
    full = candidates.join(passages.select("item_id", "passage"), "item_id").join(docs, "doc_id")
    found = full.where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    short = passages.where("n <= 0").join(docs, F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    return found.unionByName(short)


@query("valid_requests", "WITH b AS (SELECT conv_id, length(text) = 0 OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS bad FROM conversations) SELECT conv_id, NOT bool_or(coalesce(bad, false)) AS valid FROM b GROUP BY conv_id")
def valid_requests(spark, sf_dir):
    return C.valid_requests(table(spark, sf_dir, "conversations"))


@query("prefix_digests")
def prefix_digests(spark, sf_dir):
    return C.prefix_digests(table(spark, sf_dir, "conversations"))


@query("prompt_cache_model")
def prompt_cache_model(spark, sf_dir):
    """Requests that follow from events: each session's prompts grow by a block of tokens a time.

    A session is a user's month, so its length does not grow with the number of users or months.
    """
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM"))
    e = table(spark, sf_dir, "events").select(session.alias("session"), F.col("event_id").alias("id"), "ts")
    grown = e.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("ts", "id")))
    blocks = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.cast("string").alias("prefix"), F.lit(400).alias("tokens")))
    return M.cache_model(grown.select("session", "id", "ts", blocks.alias("blocks")), lifetime_s=86_400)


@query("tumbling_event_stats", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_stats(spark, sf_dir):
    """An addition: tumbling windows over events."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


@query("session_event_stats", """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_event_stats(spark, sf_dir):
    """An addition: session windows with a gap of an hour."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "n")
