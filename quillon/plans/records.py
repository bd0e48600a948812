"""Queries over records of requests, each with the same question in plain SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import records as R
from quillon.operators.conversations import prefix_digests
from quillon.plans.detection import table
from quillon.session import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("first_differences", """WITH p AS (SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS a FROM conversations)
SELECT conv_id, turn, CAST(coalesce(list_position(list_transform(generate_series(1, least(length(a), length(b))), lambda i: a[i] = b[i]), false) - 1, least(length(a), length(b))) AS INT) AS at FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def first_differences(spark, sf_dir):
    """Each text against the one before of its role."""
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before is not null and text is not null")
    return rows.select("conv_id", "turn", R.first_difference(F.col("before"), F.col("text")).alias("at"))


def positions(spark, sf_dir: str) -> DataFrame:
    """conv_id, pos, role, text: items numbered from 0."""
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", pos.alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))


POSITIONS = "p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, coalesce(text, '') AS text FROM conversations)"


def _body(rows: DataFrame, changed: bool, name: str) -> DataFrame:
    """One body per conversation; in the changed one the middle item's text has another start."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    text = F.when(F.col("pos") == F.floor(n / 2), F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text")) if changed else F.col("text")
    listed = rows.select("conv_id", F.struct("pos", "role", text.alias("content")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return listed.select("conv_id", F.to_json(F.struct(F.lit("be brief").alias("system"), messages.alias("messages"))).alias(name))


@query("miss_meta", f"""WITH {POSITIONS}, n AS (SELECT conv_id, count(*) // 2 AS k FROM p GROUP BY 1)
SELECT conv_id, CAST(k + 1 AS INT) AS index, 'm' || k || '[0]' AS at, left(text, 200) AS previous_start, left('x' || text, 200) AS missed_start, 1 AS grown, 300 AS before
FROM p JOIN n USING (conv_id) WHERE pos = k AND k > 0 AND text <> '' AND left(text, 1) <> 'x' AND (SELECT sum(length(q.text)) FROM p q WHERE q.conv_id = p.conv_id AND q.pos < k) > 300""")
def miss_meta(spark, sf_dir):
    """Two requests that differ within their middle message."""
    rows = positions(spark, sf_dir)
    of_conv = Window.partitionBy("conv_id")
    middle = F.floor(F.count(F.lit(1)).over(of_conv) / 2)
    sized = rows.withColumn("k", middle).withColumn("n_before", F.sum(F.when(F.col("pos") < F.col("k"), F.length("text")).otherwise(0)).over(of_conv))
    usable = sized.where("pos = k and k > 0 and text <> '' and left(text, 1) <> 'x' and n_before > 300").select("conv_id")
    misses = _body(rows, False, "previous").join(_body(rows, True, "missed"), "conv_id").join(usable, "conv_id", "left_semi")
    found = R.miss_meta(misses)
    split = F.instr("previous_around", F.substring("previous", F.col("diverges_at") - 299, F.lit(300)))
    return found.select("conv_id", "first_changed.index", F.col("first_changed.previous.at").alias("at"), F.col("first_changed.previous.start").alias("previous_start"), F.col("first_changed.missed.start").alias("missed_start"), (F.col("missed_size") - F.col("previous_size")).alias("grown"), (split + 299).alias("before"))


@query("saved_misses", "SELECT CASE WHEN event_type = 'purchase' THEN 'step' ELSE 'turn' END AS kind, count(*) AS n, sum(length(props)) AS chars, count(DISTINCT user_id) AS n_sessions FROM events GROUP BY 1")
def saved_misses(spark, sf_dir):
    """Misses are written to folders by kind and read back."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_type") == "purchase").alias("is_step"), F.col("props").alias("previous"))
    path = shared_path(spark, "misses")
    R.save_misses(e, path)
    return R.read_misses(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("previous")).alias("chars"), F.count_distinct("session").alias("n_sessions"))


@query("clamped_json")
def clamped_json(spark, sf_dir):
    """Bodies cut at several sizes and made whole again; tests hold them against a search over all cuts."""
    bodies = _body(positions(spark, sf_dir), False, "body").withColumn("limit", F.explode(F.array(F.lit(300), F.lit(1000))))
    whole = bodies.withColumn("whole", F.when(F.col("limit") == 300, R.clamp_to_json(300)(F.col("body"))).otherwise(R.clamp_to_json(1000)(F.col("body"))))
    return whole.select("conv_id", "limit", F.length("whole").alias("n"), F.call_function("try_parse_json", "whole").isNotNull().alias("parses"))


REQUESTS = "SELECT l_returnflag AS route, l_shipdate, l_linenumber AS scan_ms, l_suppkey % 5 AS masked, l_partkey % 3 AS compacted, CAST(l_quantity AS BIGINT) AS saved_chars FROM lineitem"


@query("request_stats", f"SELECT route, count(*) AS n_requests, sum(scan_ms) AS scan_ms_total, max(scan_ms) AS scan_ms_max, sum(masked) AS masked, sum(compacted) AS compacted, sum(saved_chars) AS saved_chars FROM ({REQUESTS}) GROUP BY route")
def request_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("route"), F.col("l_linenumber").alias("scan_ms"), (F.col("l_suppkey") % 5).alias("masked"), (F.col("l_partkey") % 3).alias("compacted"), F.col("l_quantity").cast("long").alias("saved_chars"))
    return R.request_stats(rows, "route")


def _status_rows(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("event_type").alias("route"), F.count_if(F.col("event_type") == "click").over(so_far).alias("prompts"), (F.col("event_id") * 7 % 31).alias("total"))


STATUS = """e AS (SELECT user_id AS session, event_id AS id, event_type AS route, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS prompts, event_id * 7 % 31 AS total FROM events),
s AS (SELECT *, row_number() OVER w AS n_requests, lag(total) OVER w AS before, prompts > lag(prompts) OVER w AS typed FROM e WINDOW w AS (PARTITION BY session ORDER BY id)),
b AS (SELECT *, sum(CASE WHEN typed THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY id) AS part FROM s),
k AS (SELECT *, greatest(0, total - coalesce(CASE WHEN part = 0 THEN 0 ELSE first_value(before) OVER (PARTITION BY session, part ORDER BY id) END, 0)) AS turn_total FROM b)"""


@query("status_book", f"WITH {STATUS} SELECT session, id, n_requests, total, turn_total FROM k")
def status_book(spark, sf_dir):
    return R.status_book(_status_rows(spark, sf_dir)).select("session", "id", "n_requests", "total", "turn_total")


@query("latest_status", f"WITH {STATUS} SELECT route, max(id) AS id, arg_max(session, id) AS session, arg_max(turn_total, id) AS turn_total FROM k GROUP BY route")
def latest_status(spark, sf_dir):
    return R.latest_status(R.status_book(_status_rows(spark, sf_dir)), "route").select("route", "id", "session", "turn_total")


@query("usage_texts", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber AS usage FROM lineitem")
def usage_texts(spark, sf_dir):
    usage = F.struct(F.col("l_quantity").cast("long").alias("input"), F.col("l_partkey").alias("cache_read"), F.col("l_suppkey").alias("cache_write"), F.col("l_linenumber").alias("output"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.usage_text(usage).alias("usage"))


@query("cache_trails", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' session=' || right('ses_' || o_custkey * 1000003, 8) END || ' model=' || replace(o_orderpriority, ' ', '_')
|| CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN ' markers=' || CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'system[0]' ELSE 'system[0],m' || o_orderkey % 7 || '[0]' END ELSE '' END AS trail FROM orders""")
def cache_trails(spark, sf_dir):
    k = F.col("o_orderkey")
    session = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("ses_"), (F.col("o_custkey") * 1000003).cast("string")))
    message = F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("[0]"))
    markers = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("system[0]"))).otherwise(F.array(F.lit("system[0]"), message))
    style = F.when(F.col("o_orderstatus") == "F", "anthropic").otherwise("chat")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.cache_trail(style, session, k % 2 == 0, F.col("o_orderpriority"), markers).alias("trail"))


@query("price_summary", "SELECT p_brand AS provider, p_brand || ': ' || count(DISTINCT p_type) || ' models' AS line FROM part GROUP BY 1")
def price_summary(spark, sf_dir):
    return R.price_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model")))


FIXTURES = "SELECT CASE l_orderkey % 7 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'limitation' ELSE 'supported' END AS support, l_partkey % 11 = 0 AS unavailable, l_linenumber AS misses, l_suppkey % 9 AS exposed_chars, l_partkey % 2 AS false_redactions, l_orderkey % 3 AS omissions FROM lineitem"


@query("fixture_totals", f"""SELECT count(*) AS n_fixtures, count(*) FILTER (support = 'unsupported') AS n_unsupported, count(*) FILTER (support = 'limitation') AS n_limitations, count(*) FILTER (support = 'supported' AND unavailable) AS n_unavailable,
sum(misses) FILTER (support = 'supported' AND NOT unavailable) AS misses, sum(exposed_chars) FILTER (support = 'supported' AND NOT unavailable) AS exposed_chars, sum(false_redactions) FILTER (support = 'supported' AND NOT unavailable) AS false_redactions, sum(omissions) FILTER (support = 'supported' AND NOT unavailable) AS omissions FROM ({FIXTURES})""")
def fixture_totals(spark, sf_dir):
    support = F.when(F.col("l_orderkey") % 7 == 0, "unsupported").when(F.col("l_orderkey") % 7 == 1, "limitation").otherwise("supported")
    rows = table(spark, sf_dir, "lineitem").select(support.alias("support"), (F.col("l_partkey") % 11 == 0).alias("unavailable"), F.col("l_linenumber").alias("misses"), (F.col("l_suppkey") % 9).alias("exposed_chars"), (F.col("l_partkey") % 2).alias("false_redactions"), (F.col("l_orderkey") % 3).alias("omissions"))
    return R.fixture_summary(rows)


@query("simulator_totals", """SELECT l_linestatus AS format, count(*) AS runs, sum(l_linenumber) AS requests, sum(l_suppkey % 4) AS steps, sum(CAST(l_quantity AS BIGINT)) AS cost_on, sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS cost_off, max(l_partkey) AS largest_on, max(l_partkey + l_suppkey) AS largest_off, count(*) FILTER (l_partkey % 13 = 0) AS failing FROM lineitem GROUP BY 1""")
def simulator_totals(spark, sf_dir):
    on = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("format"), F.col("l_linenumber").alias("requests"), (F.col("l_suppkey") % 4).alias("steps"), on.alias("cost_on"), (on + F.col("l_linenumber")).alias("cost_off"), F.col("l_partkey").alias("largest_on"), (F.col("l_partkey") + F.col("l_suppkey")).alias("largest_off"), F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0).alias("violations"))
    return R.simulator_totals(rows)


@query("memo_hashes", "SELECT lang, count(*) AS n, count(DISTINCT text) AS n_texts, 2 * count(DISTINCT text) AS n_hashes FROM documents GROUP BY lang")
def memo_hashes(spark, sf_dir):
    """Two seeds give each distinct text two hashes that nothing else has."""
    hashed = table(spark, sf_dir, "documents").select("lang", "text", F.explode(F.array(R.memo_hash(F.col("text"), 1), R.memo_hash(F.col("text"), 2))).alias("h"))
    return hashed.groupBy("lang").agg((F.count(F.lit(1)) / 2).cast("long").alias("n"), F.count_distinct("text").alias("n_texts"), F.count_distinct("h").alias("n_hashes"))


def _requests(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The requests before each answer, as (session, id, pos, ...) blocks; and the items themselves."""
    items = positions(spark, sf_dir)
    digest = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    asked = items.where("role = 'assistant' and pos > 0").select("conv_id", F.col("pos").alias("id"))
    blocks = asked.join(items.withColumn("digest", digest), "conv_id").where("pos < id")
    return blocks.withColumnRenamed("conv_id", "session"), items


@query("earlier_thinking", f"WITH {POSITIONS} SELECT r.conv_id AS session, r.pos AS id, e.pos AS at, md5(e.text) AS thinking FROM p r JOIN p e ON r.conv_id = e.conv_id AND e.pos < r.pos WHERE r.role = 'assistant' AND e.role = 'assistant' AND e.pos > 0 AND e.text <> ''")
def earlier_thinking(spark, sf_dir):
    blocks, items = _requests(spark, sf_dir)
    last = F.lag(F.sha2(F.concat_ws("\n", "role", "text"), 256)).over(Window.partitionBy("conv_id").orderBy("pos"))
    replies = items.withColumn("last", last).where("role = 'assistant' and pos > 0").select(F.col("conv_id").alias("session"), F.col("pos").alias("id"), F.col("pos").alias("count"), "last", F.col("text").alias("thinking"))
    return R.earlier_thinking(blocks.select("session", "id", "pos", "digest"), replies).withColumn("thinking", F.md5("thinking"))


@query("last_asked", "SELECT conv_id, coalesce(max(turn) FILTER (role = 'user'), -1) AS at FROM conversations GROUP BY 1")
def last_asked(spark, sf_dir):
    return R.last_asked(table(spark, sf_dir, "conversations"))


@query("forked_at", "SELECT conv_id, coalesce(min(turn) FILTER (role = 'user' AND (conv_id * 7 + turn) % 5 = 0), -1) AS at FROM conversations GROUP BY 1")
def forked_at(spark, sf_dir):
    items = table(spark, sf_dir, "conversations")
    told = (F.col("conv_id") * 7 + F.col("turn")) % 5 == 0
    return R.forked_at(items.withColumn("text", F.when(told, F.concat(F.lit("<fork-boilerplate>"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("see <fork-boilerplate>"), F.coalesce("text", F.lit(""))))))


NUMBERED = """m AS (SELECT conv_id, turn, '{"role":"' || role || '","turn":' || turn || '}' AS plain FROM conversations)"""


def _numbered_body(spark, sf_dir: str) -> DataFrame:
    """Messages of a role and a number; every third has a cache marker."""
    marker = F.when(F.col("turn") % 3 == 0, F.struct(F.lit("ephemeral").alias("type")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.struct("role", "turn", marker.alias("cache_control")).alias("m")).alias("x"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("all"))
    return listed.select("conv_id", F.to_json(F.struct(F.lit("base").alias("model"), F.col("all.m").alias("messages"))).alias("body"))


@query("unmarked_messages", f"""WITH {NUMBERED} SELECT conv_id, '{{"model":"base","messages":[' || string_agg(plain, ',' ORDER BY turn) || ']}}' AS body, count(*) FILTER (turn % 3 = 0) AS n_markers FROM m GROUP BY conv_id""")
def unmarked_messages(spark, sf_dir):
    bodies = _numbered_body(spark, sf_dir)
    return bodies.select("conv_id", R.without_markers(F.col("body")).alias("body"), F.regexp_count("body", F.lit("cache_control")).cast("long").alias("n_markers"))


@query("part_digests", f"""WITH {NUMBERED} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 2 AS pos, sha1(plain) AS digest FROM m UNION ALL SELECT DISTINCT conv_id, unnest([0, 1, 2]), unnest([sha1('base'), sha1('null'), sha1('null')]) FROM m""")
def part_digests(spark, sf_dir):
    bodies = _numbered_body(spark, sf_dir)
    return bodies.select("conv_id", F.posexplode(R.part_digests(F.col("body"))).alias("pos", "digest"))


@query("keeps_tail", "WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) SELECT a.conv_id, coalesce(arg_max(a.role, a.turn) = arg_max(b.role, b.turn), false) AS kept FROM conversations a JOIN l ON a.conv_id = l.conv_id LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn AND (a.conv_id % 4 > 0 OR b.turn < l.last) GROUP BY 1")
def keeps_tail(spark, sf_dir):
    """In every fourth conversation the last item is taken away."""
    items = table(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    after = items.withColumn("last", last).where((F.col("conv_id") % 4 > 0) | (F.col("turn") < F.col("last")))
    return R.keeps_tail(items, after)


@query("spread_batches")
def spread_batches(spark, sf_dir):
    """Texts of a conversation onto four batches, largest first; tests hold it against a plain loop."""
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return R.spread_batches(sized, "conv_id", "turn", 4)


CACHED = f"""{POSITIONS}, t AS (SELECT *, 40 * CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM p), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS upto FROM t),
r AS (SELECT conv_id, pos AS id FROM p WHERE role = 'assistant' AND pos > 0), tot AS (SELECT r.conv_id, r.id, u.upto AS total FROM r JOIN u ON u.conv_id = r.conv_id AND u.pos = r.id - 1)"""


def _cache_blocks(spark, sf_dir: str) -> DataFrame:
    blocks, _ = _requests(spark, sf_dir)
    numbered = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    prefixes = prefix_digests(numbered).withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).select(F.col("conv_id").alias("session"), "pos", "prefix")
    tokens = 40 * F.ceil(F.length("text") / 4).cast("long")
    return blocks.join(prefixes, ["session", "pos"]).select("session", "id", "pos", "prefix", tokens.alias("tokens"), (F.col("role") == "user").alias("asks"), ((F.col("pos") == 0) | (F.col("pos") == F.col("id") - 1)).alias("marked"))


@query("implicit_cache", f"""WITH {CACHED}, h AS (SELECT r.conv_id, r.id, max(u.upto) AS hit FROM r JOIN r q ON q.conv_id = r.conv_id AND q.id < r.id JOIN u ON u.conv_id = q.conv_id AND u.pos = q.id - 1 GROUP BY 1, 2)
SELECT conv_id AS session, id, CASE WHEN hit >= 1024 THEN hit ELSE 0 END AS read, total - CASE WHEN hit >= 1024 THEN hit ELSE 0 END AS uncached FROM tot LEFT JOIN h USING (conv_id, id)""")
def implicit_cache(spark, sf_dir):
    return R.implicit_cache(_cache_blocks(spark, sf_dir))


@query("pointed_cache", f"""WITH {CACHED}, points AS (SELECT conv_id, id, id - 1 AS pos FROM r UNION ALL SELECT r.conv_id, r.id, max(p.pos) - 1 FROM r JOIN p ON p.conv_id = r.conv_id AND p.pos < r.id AND p.role = 'user' GROUP BY 1, 2),
h AS (SELECT r.conv_id, r.id, max(u.upto) AS hit FROM r JOIN points q ON q.conv_id = r.conv_id AND q.id < r.id JOIN u ON u.conv_id = q.conv_id AND u.pos = q.pos GROUP BY 1, 2)
SELECT conv_id AS session, id, CASE WHEN hit >= 1024 THEN hit ELSE 0 END AS read, total - CASE WHEN hit >= 1024 THEN hit ELSE 0 END AS uncached FROM tot LEFT JOIN h USING (conv_id, id)""")
def pointed_cache(spark, sf_dir):
    return R.pointed_cache(_cache_blocks(spark, sf_dir))


@query("marked_cache", f"""WITH {CACHED}, b AS (SELECT r.conv_id, r.id, max(q.id) AS before FROM r LEFT JOIN r q ON q.conv_id = r.conv_id AND q.id < r.id GROUP BY 1, 2),
x AS (SELECT b.conv_id, b.id, b.before, f.upto AS first, CASE WHEN b.id - b.before <= 20 THEN e.upto ELSE 0 END AS near, total FROM b JOIN tot USING (conv_id, id) JOIN u f ON f.conv_id = b.conv_id AND f.pos = 0 LEFT JOIN u e ON e.conv_id = b.conv_id AND e.pos = b.before - 1),
y AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE first END AS read0, greatest(first, coalesce(near, 0)) AS hit FROM x)
SELECT conv_id AS session, id, read0 + hit - first AS read, first - read0 + total - hit AS written, 0 AS uncached FROM y""")
def marked_cache(spark, sf_dir):
    return R.marked_cache(_cache_blocks(spark, sf_dir))
