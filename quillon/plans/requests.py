"""Queries over documents, tool calls, learned values, streams and settings, with the same question in plain SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import compaction as K
from quillon.operators import conversations as C
from quillon.operators import documents as D
from quillon.operators import guards as G
from quillon.operators import hidden as H
from quillon.operators import inventory as I
from quillon.operators import learned as L
from quillon.operators import scan, spans
from quillon.operators import settings as S
from quillon.operators import shell
from quillon.operators.rules import Rule
from quillon.plans.detection import RULES, THREE, THREE_SQL, _near, table
from quillon.session import shared_path
from quillon.streaming import rewriters as W

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = b"quillon test key"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CONTEXT = ("the", "of", "de", "der", "la", "card", "call", "from")


@query("context_scores", f"WITH {THREE_SQL} SELECT doc_id, rule_id, start_at, CASE WHEN list_has_any({_near}, ['the', 'of', 'de', 'der', 'la', 'card', 'call', 'from']) THEN 1.0 ELSE 0.4 END::DOUBLE AS score FROM found JOIN documents USING (doc_id)")
def context_scores(spark, sf_dir):
    """Rules whose context words only raise the score."""
    from dataclasses import replace

    rules = [replace(RULES[i], context=CONTEXT, required=False) for i in THREE]
    return scan.scan(table(spark, sf_dir, "documents"), rules).select("doc_id", "rule_id", F.col("start").alias("start_at"), "score")


@query("overlapping_places", """WITH v AS (SELECT doc_id, text, substr(text, 1 + (doc_id % 7)::INT, 2) AS value FROM documents WHERE length(text) >= 9)
SELECT doc_id, len(list_filter(range(1, length(text)), lambda i: text[i] = value[1] AND text[i + 1] = value[2])) AS n, list_min(list_filter(range(1, length(text)), lambda i: text[i] = value[1] AND text[i + 1] = value[2])) - 1 AS first, list_max(list_filter(range(1, length(text)), lambda i: text[i] = value[1] AND text[i + 1] = value[2])) - 1 AS last FROM v""")
def overlapping_places(spark, sf_dir):
    """Every place of two characters of each text, overlapping ones too."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 9")
    value = F.expr("substring(text, 1 + cast(doc_id % 7 as int), 2)")
    found = docs.select("doc_id", spans.starts_of(F.col("text"), value).alias("at"))
    return found.select("doc_id", F.size("at").cast("long").alias("n"), F.array_min("at").cast("long").alias("first"), F.array_max("at").cast("long").alias("last"))


@query("propagated_values", """WITH v AS (SELECT doc_id, text, unnest([substr(text, 2, 3), substr(text, 2, 2)]) AS value, unnest(['secret', 'pii']) AS category FROM documents WHERE length(text) >= 9),
w AS (SELECT doc_id, text, value, min(category = 'pii') AS pii FROM v GROUP BY ALL), a AS (SELECT doc_id, text, value, pii, unnest(list_filter(range(1, length(text) - length(value) + 2), lambda i: substr(text, i, length(value)) = value)) AS i FROM w),
k AS (SELECT doc_id, value, CAST(i - 1 AS INT) AS start FROM a WHERE NOT pii OR NOT (regexp_matches(CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END, '[\\pL\\pN_]') OR regexp_matches(substr(text, i + length(value), 1), '[\\pL\\pN_]')) UNION SELECT doc_id, value, 1 FROM v)
SELECT doc_id, value, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM k GROUP BY 1, 2""")
def propagated_values(spark, sf_dir):
    """Short secrets and pieces of personal data, found again in their texts."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 9")
    one = lambda n, category: docs.select("doc_id", F.lit("r").alias("rule_id"), F.lit(category).alias("category"), F.lit(1).alias("start"), F.lit(1 + n).alias("end"), F.substring("text", 2, n).alias("value"))
    found = spans.propagated(one(3, "secret").union(one(2, "pii")), docs)
    places = found.select("doc_id", "value", "start").distinct()
    return places.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


# JSON documents

CUSTOMER_JSON = """'{"id": ' || c_custkey || ', "login": {"password": "pw-' || c_name || '", "tags": ["a\\"b", ' || c_nationkey || ', null]}, "ssn": "' || c_custkey * 7919 || '"}'"""


def _customers(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit('{"id": '), k, F.lit(', "login": {"password": "pw-'), "c_name", F.lit('", "tags": ["a\\"b", '), F.col("c_nationkey").cast("string"), F.lit(', null]}, "ssn": "'), (F.col("c_custkey") * 7919).cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))


@query("json_scalars", f"""WITH d AS (SELECT c_custkey AS doc_id, c_name, c_nationkey, {CUSTOMER_JSON} AS t FROM customer), s AS (SELECT doc_id, t, unnest(['id', 'login.password', 'login.tags[0]', 'login.tags[1]', 'ssn']) AS path, unnest([NULL, 'secret', NULL, NULL, 'pii']) AS label, unnest([doc_id::VARCHAR, '"pw-' || c_name || '"', '"a\\"b"', c_nationkey::VARCHAR, '"' || doc_id * 7919 || '"']) AS raw, unnest(['"id": ', '"password": ', '"tags": [', '"a\\"b", ', '"ssn": ']) AS before FROM d)
SELECT doc_id, path, label, strpos(t, before) + length(before) - 1 AS start, strpos(t, before) + length(before) - 1 + length(raw) AS "end" FROM s""")
def json_scalars(spark, sf_dir):
    found = D.scalars(_customers(spark, sf_dir))
    return found.select("doc_id", "path", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("plain_string_spans", """WITH d AS (SELECT p_partkey, '{"a": "x' || repeat('\\', (p_partkey % 4)::INT) || 'n' || p_name || '"}' AS t, (p_partkey % 4)::INT AS k FROM part WHERE p_partkey % 4 IN (0, 2))
SELECT p_partkey, k, CASE s WHEN 8 THEN true WHEN 7 THEN k = 0 ELSE true END AS plain, s FROM (SELECT p_partkey, k, unnest([8 + k, 7]) AS s0, unnest([8, 7]) AS s FROM d)""")
def plain_string_spans(spark, sf_dir):
    """Spans of a JSON string that start behind it and at an escape."""
    k = (F.col("p_partkey") % 4).cast("int")
    rows = table(spark, sf_dir, "part").where("p_partkey % 4 in (0, 2)").select("p_partkey", k.alias("k"), F.concat(F.lit('{"a": "x'), F.repeat(F.lit("\\"), k), F.lit("n"), "p_name", F.lit('"}')).alias("t"))
    each = rows.select("*", F.explode(F.array(F.lit(8), F.lit(7))).alias("s"))
    start = F.when(F.col("s") == 8, F.col("k") + 8).otherwise(F.lit(7)) + F.lit(0)
    end = F.when(F.col("s") == 8, F.length("t") - 2).otherwise(F.lit(9))
    return each.select("p_partkey", "k", "s", D.in_plain_string(F.col("t"), F.lit(6), F.length("t") - 1, start, end).alias("plain"))


@query("redacted_json_shapes", f"""WITH d AS (SELECT c_custkey AS doc_id, {CUSTOMER_JSON} AS t, c_name FROM customer) SELECT doc_id, length(t) AS n, 2 AS n_edits, false AS shows_password, false AS shows_ssn, true AS parses FROM d""")
def redacted_json_shapes(spark, sf_dir):
    """Bodies with their password and number replaced by values of the same length; nothing else changes."""
    rows = _customers(spark, sf_dir)
    out = D.redacted_values(rows, [RULES["pii-email"]] if "pii-email" in RULES else [], "text").join(rows.select("doc_id", F.col("text").alias("was")), "doc_id")
    value = lambda c, path: F.get_json_object(c, path)
    return out.select("doc_id", F.length("text").cast("long").alias("n"), F.col("n_edits").cast("int").alias("n_edits"), (value("text", "$.login.password") == value("was", "$.login.password")).alias("shows_password"), (value("text", "$.ssn") == value("was", "$.ssn")).alias("shows_ssn"), F.call_function("try_parse_json", "text").isNotNull().alias("parses"))


@query("pre_passes", """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_encoded, 1 AS n_turned, 1 AS n_cookies, 'see ' || CASE WHEN c_custkey % 2 = 0 THEN '[encoded data withheld]' ELSE to_base64(encode('harmless text of no interest ' || c_custkey)) END || ' and [turned value withheld] end' || chr(10) || 'Cookie: sid=[cookie]' AS text FROM customer""")
def pre_passes(spark, sf_dir):
    """An encoded block, a rot13 copy of a known value and a cookie, one behind the other."""
    k = F.col("c_custkey")
    inner = F.when(k % 2 == 0, F.concat(F.lit("the token is tok_"), k.cast("string"), F.lit(" keep it"))).otherwise(F.concat(F.lit("harmless text of no interest "), k.cast("string")))
    coded = F.regexp_replace(F.base64(F.encode(inner, "utf-8")), r"\s", "")
    text = F.concat(F.lit("see "), coded, F.lit(" and "), T.rot13(F.lit("Secretvalue")), F.lit(" end\nCookie: sid="), k.cast("string"))
    values = spark.createDataFrame([("Secretvalue",)], "value string")
    return D.pre_passes(table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text")), r"tok_[0-9]+", values)


PAIRS = "SELECT 'host-' || n_nationkey AS stand_in, 'box.' || lower(replace(n_name, ' ', '-')) AS value FROM nation"


def _pairs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("host-"), F.col("n_nationkey").cast("string")).alias("stand_in"), F.concat(F.lit("box."), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("value"))


@query("swapped_bodies", f"""WITH n AS ({PAIRS}), c AS (SELECT c_custkey AS reply, value AS v, stand_in AS s FROM customer JOIN n ON stand_in = 'host-' || c_nationkey)
SELECT reply, CASE reply % 4 WHEN 0 THEN '{{"id":"' || s || '","content":[{{"type":"text","text":"at ' || v || '."}},{{"type":"tool_use","input":{{"command":"ping ' || v || '"}}}}]}}' WHEN 1 THEN '{{"model":"' || s || '","choices":[{{"message":{{"content":"at ' || v || '.","tool_calls":[{{"function":{{"arguments":"{{\\"h\\":\\"' || v || '\\"}}"}}}}]}}}}]}}'
WHEN 2 THEN '{{"id":"' || s || '","output":[{{"type":"message","content":[{{"type":"output_text","text":"at ' || v || '."}}]}},{{"type":"function_call","arguments":"{{\\"h\\":\\"' || v || '\\"}}"}}]}}' ELSE '{{"responseId":"' || s || '","candidates":[{{"content":{{"parts":[{{"text":"at ' || v || '."}},{{"functionCall":{{"name":"f","args":{{"h":"' || v || '"}}}}}}]}}}}]}}' END AS body FROM c""")
def swapped_bodies(spark, sf_dir):
    """Whole replies of four formats: texts and arguments are swapped back, ids and models are not."""
    s, r = F.concat(F.lit("host-"), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 4
    bodies = (
        '{"id":"@","content":[{"type":"text","text":"at @."},{"type":"tool_use","input":{"command":"ping @"}}]}',
        '{"model":"@","choices":[{"message":{"content":"at @.","tool_calls":[{"function":{"arguments":"{\\"h\\":\\"@\\"}"}}]}}]}',
        '{"id":"@","output":[{"type":"message","content":[{"type":"output_text","text":"at @."}]},{"type":"function_call","arguments":"{\\"h\\":\\"@\\"}"}]}',
        '{"responseId":"@","candidates":[{"content":{"parts":[{"text":"at @."},{"functionCall":{"name":"f","args":{"h":"@"}}}]}}]}',
    )
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (r + 1).cast("int"))
    style = F.element_at(F.array(*[F.lit(f) for f in W.FORMATS]), (r + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reply"), style.alias("style"), F.replace(body, F.lit("@"), s).alias("body"))
    return D.swapped_bodies(rows, _pairs(spark, sf_dir)).select("reply", "body")


@query("crushed_json")
def crushed_json(spark, sf_dir):
    """Events of a user as one JSON array, crushed; tests hold it against a plain loop."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))).alias("text"))
    return e.select("user_id", F.length(D.crush_json(F.col("text"))).alias("n"), F.length("text").alias("before"))


@query("gap_markers", """WITH i AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), k AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM i WHERE pos < 3 OR pos >= n - 2 OR o_orderkey % 5 = 0),
g AS (SELECT doc_id, pos, o_orderkey::VARCHAR AS item, pos - coalesce(before, -1) - 1 AS gap FROM k) SELECT doc_id, string_agg(CASE WHEN gap > 0 THEN '[' || gap || ' similar item' || CASE WHEN gap > 1 THEN 's' ELSE '' END || ' omitted],' ELSE '' END || item, ',' ORDER BY pos) AS items FROM g GROUP BY doc_id""")
def gap_markers(spark, sf_dir):
    by = Window.partitionBy("doc_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item"))
    placed = rows.withColumns({"pos": F.row_number().over(by.orderBy("item")) - 1, "n": F.count(F.lit(1)).over(by)})
    kept = placed.where("pos < 3 or pos >= n - 2 or item % 5 = 0")
    return K.with_gap_markers(kept, F.col("n")).select("doc_id", F.array_join("items", ",").alias("items"))


@query("progress_lines", """SELECT l_orderkey AS doc_id, CASE WHEN count(*) >= 3 THEN 'start' || chr(10) || min(l_linenumber) || '% done of ' || l_orderkey || chr(10) || '[' || count(*) - 2 || ' similar progress lines]' || chr(10) || max(l_linenumber) || '% done of ' || l_orderkey || chr(10) || 'end'
ELSE 'start' || chr(10) || string_agg(l_linenumber || '% done of ' || l_orderkey, chr(10) ORDER BY l_linenumber) || chr(10) || 'end' END AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def progress_lines(spark, sf_dir):
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit("% done of "), F.col("l_orderkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    logs = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("all"))
    text = F.concat(F.lit("start\n"), F.array_join("all.line", "\n"), F.lit("\nend"))
    return K.collapse_repeated_lines(logs.select("doc_id", text.alias("text")), least=3).select("doc_id", "text")


# tool calls

@query("heredoc_spans", """SELECT o_orderkey, length('cat <<EOF > f' || o_custkey) + 1 AS start, length('cat <<EOF > f' || o_custkey) + 1 + (o_orderkey % 4) * (length('rm -rf /' || o_orderkey) + 1) AS "end", 2 AS n_programs FROM orders""")
def heredoc_spans(spark, sf_dir):
    body = F.repeat(F.concat(F.lit("rm -rf /"), F.col("o_orderkey").cast("string"), F.lit("\n")), (F.col("o_orderkey") % 4).cast("int"))
    commands = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("cat <<EOF > f"), F.col("o_custkey").cast("string"), F.lit("\n"), body, F.lit("EOF\nls -l")).alias("command"))
    found = shell.with_programs(commands).withColumn("h", F.explode(shell.heredoc_spans(F.col("command"))))
    return found.select("o_orderkey", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.size("programs").alias("n_programs"))


CALLS = """c AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'cat conf/.env' WHEN 1 THEN 'grep -r .env src' WHEN 2 THEN 'cp ~/.ssh/id_{rsa,ed25519} /tmp' WHEN 3 THEN 'curl -b sid=1 http://x.net' WHEN 4 THEN 'jq .key conf/app.json' ELSE 'ls -l ' || o_custkey END AS command FROM orders)"""


def _commands(spark, sf_dir: str) -> DataFrame:
    commands = ("cat conf/.env", "grep -r .env src", "cp ~/.ssh/id_{rsa,ed25519} /tmp", "curl -b sid=1 http://x.net", "jq .key conf/app.json")
    k = (F.col("o_orderkey") % 6).cast("int")
    command = F.when(k < 5, F.element_at(F.array(*[F.lit(c) for c in commands]), F.least(k, F.lit(4)) + 1)).otherwise(F.concat(F.lit("ls -l "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", command.alias("command"))


@query("blocked_secret_access", f"WITH {CALLS} SELECT o_orderkey, (command LIKE 'cat conf/%' OR command LIKE 'cp %' OR command LIKE 'curl -b%') AND o_orderkey % 5 > 0 OR o_orderkey % 7 = 0 AND o_orderkey % 5 > 0 AS blocked FROM c")
def blocked_secret_access(spark, sf_dir):
    """Commands that read secret files or send cookies, and calls that target one, unless secrets are allowed."""
    k = F.col("o_orderkey")
    tags = F.when(k % 5 == 0, F.array(F.lit("secret"))).otherwise(F.array().cast("array<string>"))
    targets = F.when(k % 7 == 0, F.array(F.lit("a.txt"), F.lit("certs/server.pem"))).otherwise(F.array(F.lit("a.txt")))
    return shell.blocks_secret_access(_commands(spark, sf_dir).withColumns({"allow_tags": tags, "targets": targets})).select("o_orderkey", "blocked")


@query("shell_data_blanked", f"WITH {CALLS} SELECT o_orderkey, replace(replace(command, 'grep -r .env', 'grep -r     '), 'jq .key', 'jq     ') AS command FROM c")
def shell_data_blanked(spark, sf_dir):
    return _commands(spark, sf_dir).select("o_orderkey", shell.blanked(F.col("command")).alias("command"))


@query("path_candidates", """WITH p AS (SELECT unnest([0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 5]) AS k, unnest(['cat', 'conf/.env', 'grep', 'src', 'cp', '~/.ssh/id_rsa', '~/.ssh/id_ed25519', '/tmp', 'curl', '1', 'jq', 'conf/app.json', 'ls', NULL]) AS path) SELECT o_orderkey, coalesce(path, o_custkey::VARCHAR) AS path FROM orders JOIN p ON o_orderkey % 6 = k""")
def path_candidates(spark, sf_dir):
    return _commands(spark, sf_dir).select("o_orderkey", F.explode(shell.candidates(F.col("command"))).alias("path"))


@query("unguarded_tools", "SELECT DISTINCT user_id AS request, event_type || '_' || CASE event_id % 4 WHEN 0 THEN 'send' WHEN 1 THEN 'list' WHEN 2 THEN 'update' ELSE 'delete' END AS tool FROM events WHERE event_id % 4 IN (0, 2, 3) AND event_id % 3 > 0 AND NOT (event_type = 'click' AND event_id % 4 = 0)")
def unguarded_tools(spark, sf_dir):
    k = F.col("event_id")
    tool = F.concat("event_type", F.lit("_"), F.element_at(F.array(F.lit("send"), F.lit("list"), F.lit("update"), F.lit("delete")), (k % 4 + 1).cast("int")))
    arguments = F.when(k % 3 == 0, F.array(F.lit("command"))).otherwise(F.array(F.lit("to")))
    offers = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), tool.alias("tool"), arguments.alias("arguments"))
    return G.unguarded_tools(offers, reviewed=("click_send",))


@query("input_notes", "SELECT doc_id, doc_id % 3 < 2 AS holds FROM documents WHERE text IS NOT NULL")
def input_notes(spark, sf_dir):
    """Notes at the start or the end of an input are told from those quoted within one."""
    note, k = F.lit("[120 characters of this earlier call's input left out]"), F.col("doc_id") % 3
    inner = F.concat(F.lit("x"), F.regexp_replace("text", r"\s+$", ""), F.lit("x"))
    value = F.when(k == 0, F.concat(note, inner)).when(k == 1, F.concat(inner, F.lit(" "), note, F.lit("\n"))).otherwise(F.concat(inner, note, inner))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", G.holds_input_note(F.to_json(F.struct(value.alias("command")))).alias("holds"))


@query("spelled_values", "SELECT c_custkey AS call_id, c_name AS value FROM customer WHERE c_custkey % 3 < 2")
def spelled_values(spark, sf_dir):
    """Customers' names spelled in bytes, in hexadecimal or percent escapes, within arguments."""
    k = F.col("c_custkey") % 3
    spelled = F.when(k == 0, F.element_at(I.spelled(F.col("c_name")), 1)).when(k == 1, F.element_at(I.spelled(F.col("c_name")), 2)).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer")
    calls = rows.select(F.col("c_custkey").alias("call_id"), F.to_json(F.struct(F.concat(F.lit("printf '"), spelled, F.lit("'")).alias("command"))).alias("arguments"))
    return G.spells_masked(calls, rows.select(F.col("c_name").alias("value")))


@query("revealed_hidden", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 0 ELSE 1 + CASE WHEN length(text) > 3 THEN 1 ELSE 0 END END AS runs FROM conversations WHERE text IS NOT NULL AND length(text) > 0")
def revealed_hidden(spark, sf_dir):
    """Invisible runs in what was put in; a model's own turns stay as they are."""
    zero = F.lit("​​")
    hidden = F.concat(F.left("text", F.lit(2)), zero, F.when(F.length("text") > 3, F.concat(F.substring("text", 3, 1), F.lit("⁠"), F.expr("substring(text, 4)"))).otherwise(F.expr("substring(text, 3)")))
    items = table(spark, sf_dir, "conversations").where("text is not null and length(text) > 0").withColumn("text", hidden)
    shown = F.when(F.col("role") == "assistant", F.col("text")).otherwise(H.reveal(F.col("text")))
    return items.select("conv_id", "turn", F.regexp_count(shown, F.lit(r"\[hidden characters\]")).alias("runs"))


# learned values

def _learned(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("value"), F.lit("pii-swapped").alias("rule_id"), F.col("s_suppkey").cast("long").alias("since"))


NOTES = """t AS (SELECT o_orderkey AS doc_id, o_orderkey % 90 AS seen, (o_custkey % 100) + 1 AS k, CASE o_orderkey % 3 WHEN 0 THEN 'ask ' || lower(s_name) || ' now' WHEN 1 THEN 'ask x' || s_name || ' now' ELSE '(' || s_name || ')' END AS text, s_name FROM orders JOIN supplier ON s_suppkey = (o_custkey % 100) + 1)"""


def _notes(spark, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    joined = o.withColumn("k", F.col("o_custkey") % 100 + 1).join(s, "k")
    text = F.when(k == 0, F.concat(F.lit("ask "), F.lower("s_name"), F.lit(" now"))).when(k == 1, F.concat(F.lit("ask x"), "s_name", F.lit(" now"))).otherwise(F.concat(F.lit("("), "s_name", F.lit(")")))
    return joined.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 90).alias("seen"), text.alias("text"))


@query("swapped_findings", f"""WITH {NOTES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 4 ELSE 1 END AS start, CASE doc_id % 3 WHEN 0 THEN lower(s_name) ELSE s_name END AS value FROM t WHERE doc_id % 3 <> 1 AND k <= seen""")
def swapped_findings(spark, sf_dir):
    """Learned suppliers' names, whole tokens in any case, only in texts first seen when they were known."""
    return L.swapped_findings(_notes(spark, sf_dir), _learned(spark, sf_dir)).select("doc_id", "start", "value")


@query("recalled_values", f"""WITH {NOTES} SELECT doc_id, k AS since, CASE doc_id % 3 WHEN 0 THEN 4 ELSE 1 END AS start, length(s_name) AS n FROM t WHERE doc_id % 3 <> 1""")
def recalled_values(spark, sf_dir):
    """The same names, kept on disk as keyed digests and found again."""
    path = shared_path(spark, "recall")
    L.remembered(_learned(spark, sf_dir), KEY).write.parquet(path)
    found = L.find(_notes(spark, sf_dir), L.load(spark, path), KEY)
    return found.select("doc_id", "since", "start", (F.col("end") - F.col("start")).cast("long").alias("n"))


@query("kept_values", "WITH v AS (SELECT props AS value, arg_max(event_type, event_id) AS rule_id, min(event_id) AS since, max(event_id) AS last FROM events GROUP BY 1) SELECT value, rule_id, since FROM v ORDER BY last DESC, value LIMIT 50")
def kept_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("props").alias("value"), F.col("event_type").alias("rule_id"), F.col("event_id").alias("seq"))
    return L.keep_newest(e, 50)


@query("stray_stand_ins", f"""WITH n AS ({PAIRS}), l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1) SELECT DISTINCT conv_id, 'host-' || turn % 25 AS stand_in FROM conversations JOIN l USING (conv_id) WHERE turn > coalesce(last, -1) AND conv_id % 2 = 0""")
def stray_stand_ins(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("wrote (host-"), (F.col("turn") % 25).cast("string"), F.lit(") to a file")).alias("text"), (F.col("conv_id") % 2 == 0).alias("is_local"))
    return L.stray_stand_ins(items, _pairs(spark, sf_dir))


@query("synthetic_values", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN c_nationkey < 25 ELSE false END AS is_synthetic FROM customer""")
def synthetic_values(spark, sf_dir):
    """Stand-ins, two of them joined by @, one joined to something else, and others."""
    k, s = F.col("c_custkey") % 4, F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"))
    value = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("@host-1"))).when(k == 2, F.concat(F.lit("me@"), s)).otherwise(F.concat(s, F.lit("0x")))
    return L.synthetic(table(spark, sf_dir, "customer").select("c_custkey", value.alias("value")), _pairs(spark, sf_dir)).select("c_custkey", "is_synthetic")


@query("all_stand_ins", "SELECT c_custkey AS doc_id, c_custkey % 3 < 2 AS only FROM customer")
def all_stand_ins(spark, sf_dir):
    k, s = F.col("c_custkey") % 3, F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"))
    text = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(" host-2@host-3\n"))).otherwise(F.concat(s, F.lit(" and")))
    return L.all_stand_ins(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), _pairs(spark, sf_dir))


@query("mangled_stand_ins", "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'HOST-' || c_nationkey WHEN 1 THEN 'host_' || c_nationkey ELSE 'Host' || c_nationkey || 's' END AS token, 'host-' || c_nationkey AS stand_in FROM customer WHERE c_custkey % 4 < 3")
def mangled_stand_ins(spark, sf_dir):
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    token = F.when(k == 0, F.concat(F.lit("HOST-"), n)).when(k == 1, F.concat(F.lit("host_"), n)).when(k == 2, F.concat(F.lit("Host"), n, F.lit("s"))).otherwise(F.concat(F.lit("host-"), n))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("on "), token, F.lit(", it says")).alias("text"))
    return L.mangled(rows, _pairs(spark, sf_dir))


@query("avoided_candidates", """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part), c AS (SELECT DISTINCT p_type AS stand_in FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT 'admin' UNION SELECT '--')
SELECT stand_in, stand_in = 'admin' OR stand_in = '--' OR NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_split_to_array(lower(stand_in), '[^a-z0-9]+')) AS p) WHERE p <> '' AND p NOT IN (SELECT word FROM w)) AS avoid FROM c""")
def avoided_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split(F.lower("p_name"), "[^a-z0-9]+")).alias("word")).distinct()
    extra = spark.createDataFrame([("admin",), ("--",)], "stand_in string")
    candidates = p.select(F.col("p_type").alias("stand_in")).union(p.select("p_name")).union(extra).distinct()
    return L.avoided(candidates, words)


@query("rule_labels", "SELECT * FROM (VALUES ('pii-email', 'email'), ('pii-phone-us', 'phone'), ('pii-credit-card', 'card'), ('pii-ipv4-public', 'ip'), ('pii-ssn', 'id')) t(rule_id, label)")
def rule_labels(spark, sf_dir):
    rows = spark.createDataFrame([(i,) for i in ("pii-email", "pii-phone-us", "pii-credit-card", "pii-ipv4-public", "pii-ssn")], "rule_id string")
    return rows.select("rule_id", L.label_for_rule(F.col("rule_id")).alias("label"))


def _calls(spark, sf_dir: str) -> DataFrame:
    c, k, s = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4, F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"))
    command = F.when(k == 0, F.concat(F.lit("cat /etc/"), F.lit("hosts "), s)).when(k == 1, F.concat(F.lit("curl http://x "), s)).when(k == 2, F.concat(F.lit("tr a-z n-za-m <<< "), s)).otherwise(F.concat(F.lit("git push --force "), s))
    tags = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("all"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("c_custkey").alias("call_id"), F.lit("Bash").alias("tool"), F.to_json(F.struct(command.alias("command"))).alias("arguments"), tags.alias("allow_tags"))


SWAP = f"""n AS ({PAIRS}), c AS (SELECT c_custkey AS call_id, c_custkey % 4 AS k, c_custkey % 5 = 0 AS free, stand_in, value FROM customer JOIN n ON stand_in = 'host-' || c_nationkey),
b AS (SELECT *, CASE k WHEN 0 THEN 'cat /etc/hosts ' WHEN 1 THEN 'curl http://x ' WHEN 2 THEN 'tr a-z n-za-m <<< ' ELSE 'git push --force ' END AS start FROM c)"""


@query("swap_back_plans", f"""WITH {SWAP} SELECT call_id, '{{"command":"' || start || CASE WHEN k = 1 AND NOT free THEN stand_in ELSE value END || '"}}' AS arguments, CASE WHEN k = 1 AND NOT free THEN '' ELSE stand_in END AS resolved, CASE WHEN k = 1 AND NOT free THEN stand_in ELSE '' END AS egress FROM b""")
def swap_back_plans(spark, sf_dir):
    planned = L.plan_swap_back(_calls(spark, sf_dir), _pairs(spark, sf_dir))
    return planned.select("call_id", "arguments", F.array_join("resolved", ",").alias("resolved"), F.array_join("egress", ",").alias("egress"))


@query("swapped_tool_arguments", f"""WITH {SWAP}, g AS (SELECT *, CASE WHEN free THEN NULL WHEN k = 2 THEN 'turns letters' WHEN k = 3 THEN 'destroys history' END AS notice FROM b) SELECT call_id, '{{"command":"' || start || CASE WHEN k = 1 AND NOT free OR notice IS NOT NULL THEN stand_in ELSE value END || '"}}' AS arguments, notice FROM g""")
def swapped_tool_arguments(spark, sf_dir):
    return L.swap_tool_arguments(_calls(spark, sf_dir), _pairs(spark, sf_dir)).select("call_id", "arguments", "notice")


# streams

def _reply_events(spark, sf_dir: str, style: str) -> DataFrame:
    """Answers as streamed events: text in pieces of 17 characters, then a tool call in pieces of 11."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("reply"), F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.struct("conv_id", "turn")).alias("arguments"))
    pieces = lambda c, n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / n).cast("int") - 1, F.lit(0))), lambda i: F.substring(c, i * n + 1, F.lit(n)))
    text, call = pieces(F.col("text"), 17), pieces(F.col("arguments"), 11)
    as_json = lambda x, name: F.to_json(F.struct(x.alias(name)))

    def filled(template: dict, name: str | None = None, of: F.Column | None = None):
        raw = F.lit(json.dumps(template, separators=(",", ":")))
        return raw if of is None else F.replace(raw, F.lit('"@"'), F.expr("substring(j, 6, length(j) - 6)") if False else F.regexp_replace(F.regexp_replace(as_json(of, "x"), r'^\{"x":', ""), r"\}$", ""))

    if style == "anthropic":
        block = lambda i, b: {"type": "content_block_start", "index": i, "content_block": b}
        parts = [F.array(filled(block(0, {"type": "text", "text": ""}))), F.transform(text, lambda x: filled({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "@"}}, "t", x)), F.array(filled({"type": "content_block_stop", "index": 0}), filled(block(1, {"type": "tool_use", "id": "t", "name": "f", "input": {}}))), F.transform(call, lambda x: filled({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "@"}}, "t", x)), F.array(filled({"type": "content_block_stop", "index": 1}))]
    elif style == "chat":
        choice = lambda d, r=None: {"id": "c", "choices": [{"index": 0, "delta": d, "finish_reason": r}]}
        parts = [F.transform(text, lambda x: filled(choice({"content": "@"}), "t", x)), F.transform(call, lambda x: filled(choice({"tool_calls": [{"index": 0, "function": {"name": "f", "arguments": "@"}}]}), "t", x)), F.array(filled(choice({}, "tool_calls")), F.lit("[DONE]"))]
    elif style == "responses":
        parts = [F.transform(text, lambda x: filled({"type": "response.output_text.delta", "item_id": "m", "content_index": 0, "delta": "@"}, "t", x)), F.array(filled({"type": "response.output_item.done", "item": {"id": "m"}})), F.transform(call, lambda x: filled({"type": "response.function_call_arguments.delta", "item_id": "f", "delta": "@"}, "t", x)), F.array(filled({"type": "response.function_call_arguments.done", "item_id": "f"}), filled({"type": "response.completed"}))]
    else:
        part = lambda p, **more: {"candidates": [{"index": 0, "content": {"role": "model", "parts": [p]}, **more}]}
        parts = [F.transform(text, lambda x: filled(part({"text": "@"}), "t", x)), F.array(F.concat(F.lit('{"candidates":[{"index":0,"content":{"role":"model","parts":[{"functionCall":{"name":"f","args":'), F.col("arguments"), F.lit('}}]},"finishReason":"STOP"}]}')))]
    listed = rows.select("reply", F.concat(*parts).alias("all"))
    return listed.select("reply", F.posexplode("all").alias("pos", "data"), F.size("all").alias("n")).select("reply", F.col("pos").cast("long").alias("seq"), F.lit(style).alias("style"), F.lit(None).cast("string").alias("event"), "data", (F.col("pos") == F.col("n") - 1).alias("done"))


TEXT_AT = {"anthropic": "$.delta.text", "chat": "$.choices[0].delta.content", "responses": "$.delta", "gemini": None}
CALL_AT = {"anthropic": "$.delta.partial_json", "chat": "$.choices[0].delta.tool_calls[0].function.arguments", "responses": "$.delta", "gemini": "$.candidates[0].content.parts[0].functionCall.args"}
REPLIES = "SELECT conv_id || '/' || turn AS reply, md5(coalesce(text, '')) AS text_hash, '{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}' AS arguments, 0 AS n_cut FROM conversations WHERE role = 'assistant'"


def _held(spark, sf_dir: str, style: str) -> DataFrame:
    """What a client reads of the held events: the text, the call, and how many pieces but the last end within a word."""
    out = W.hold_events(_reply_events(spark, sf_dir, style))
    get = F.get_json_object
    if style == "gemini":
        parts = F.from_json(get("data", "$.candidates[0].content.parts"), "array<struct<text:string,functionCall:struct<args:string>>>")
        read = out.select("reply", "seq", "part", F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("t"), F.array_max(F.transform(parts, lambda p: p["functionCall"]["args"])).alias("c"))
    else:
        is_call = F.col("data").contains("partial_json") | F.col("data").contains("call_arguments.delta") | F.col("data").contains("tool_calls\":[")
        read = out.select("reply", "seq", "part", F.when(~is_call, F.coalesce(get("data", TEXT_AT[style]), F.lit(""))).otherwise("").alias("t"), F.when(is_call, F.nullif(get("data", CALL_AT[style]), F.lit(""))).alias("c"))
    last = F.max(F.when(F.length("t") > 0, F.struct("seq", "part"))).over(Window.partitionBy("reply"))
    cut = (F.length("t") > 0) & (F.struct("seq", "part") < last) & ~F.col("t").rlike(r"\s$") & (F.length("t") < 160)
    joined = read.withColumn("cut", cut).groupBy("reply").agg(F.array_sort(F.collect_list(F.struct("seq", "part", "t"))).alias("all"), F.max("c").alias("arguments"), F.count_if("cut").cast("int").alias("n_cut"))
    return joined.select("reply", F.md5(F.array_join("all.t", "")).alias("text_hash"), "arguments", "n_cut")


for _style in W.FORMATS:
    query(f"held_events_{_style}", REPLIES)(lambda spark, sf_dir, style=_style: _held(spark, sf_dir, style))


@query("thinking_events", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || user_id ELSE '' END AS thinking FROM events""")
def thinking_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k, v = (F.col("event_id") / 2).cast("long") % 4, F.concat("event_type", F.col("user_id").cast("string"))
    thinks = F.col("event_id") % 2 == 0
    s = lambda **f: F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))
    anthropic = F.when(thinks, s(type=F.lit("content_block_delta"), delta=F.struct(F.lit("thinking_delta").alias("type"), v.alias("thinking")))).otherwise(s(type=F.lit("content_block_delta"), delta=F.struct(F.lit("text_delta").alias("type"), v.alias("text"))))
    chat = F.when(thinks, s(choices=F.array(F.struct(F.struct(v.alias("reasoning_content")).alias("delta"))))).otherwise(s(choices=F.array(F.struct(F.struct(v.alias("content")).alias("delta")))))
    responses = F.when(thinks, s(type=F.lit("response.reasoning_text.delta"), delta=v)).otherwise(s(type=F.lit("response.output_text.delta"), delta=v))
    gemini = s(candidates=F.array(F.struct(F.struct(F.array(F.struct(v.alias("text"), thinks.alias("thought"))).alias("parts")).alias("content"))))
    style = F.element_at(F.array(*[F.lit(f) for f in W.FORMATS]), (k + 1).cast("int"))
    data = F.when(k == 0, anthropic).when(k == 1, chat).when(k == 2, responses).otherwise(gemini)
    return e.select("event_id", W.thinking_of_event(style, data).alias("thinking"))


@query("usage_events", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey - least(l_suppkey, l_partkey) END AS input, CASE WHEN l_linenumber % 2 = 0 THEN least(l_suppkey, l_partkey) END AS cache_read FROM lineitem")
def usage_events(spark, sf_dir):
    usage = F.struct(F.col("l_partkey").alias("prompt_tokens"), F.struct(F.col("l_suppkey").alias("cached_tokens")).alias("prompt_tokens_details"), F.lit(1).alias("completion_tokens"))
    data = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(usage.alias("usage")))).otherwise(F.to_json(F.struct(F.lit("x").alias("id"))))
    found = W.usage_of_event(F.lit("chat"), data)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found["input"].alias("input"), found["cache_read"].alias("cache_read"))


# settings

CONFIG = {
    "rules": [{"id": "own-order", "category": "pii", "pattern": r"ORD-[0-9]{3,}"}], "inventory": [{"id": "i1", "literal": "Brand#13"}, {"id": "i2", "literal": "brand#21", "case_sensitive": True}],
    "generalize": [{"terms": ["STANDARD", "STANDARD POLISHED"], "phrase": "some kind"}], "guards": {"deny": ["Bash(command:rm *)"], "prompt": ["Write"], "allow": ["Read"]}, "watch": {"terms": ["ab", "Click", "click", "purchase"], "action": "block"},
    "read_prices": {"1-*": 0.1, "2-*": 0.25, "3-*": 7},
}


def _settings(spark) -> S.Settings:
    path = shared_path(spark, "settings") + ".json"
    spark.createDataFrame([(json.dumps(CONFIG),)], "value string").coalesce(1).write.text(path)
    return S.user_settings(S.read_config(spark, path))


@query("user_rules", "SELECT p_partkey AS doc_id, CASE WHEN p_brand = 'Brand#13' THEN 'i1' ELSE 'own-order' END AS rule_id, CASE WHEN p_brand = 'Brand#13' THEN 7 ELSE 5 + length(p_brand) + 2 END AS start FROM part WHERE p_brand = 'Brand#13' OR p_partkey >= 100 UNION ALL SELECT p_partkey, 'own-order', 5 + length(p_brand) + 2 FROM part WHERE p_brand = 'Brand#13' AND p_partkey >= 100")
def user_rules(spark, sf_dir):
    """A user's rule and inventory over texts, beside no default rule."""
    rules = S.active_rules([], _settings(spark))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("order: "), "p_brand", F.lit(" "), F.lit("ORD-").cast("string"), F.col("p_partkey").cast("string")).alias("text"))
    rows = rows.withColumn("text", F.regexp_replace("text", "^order: ", "brand: "))
    return scan.scan(rows, rules).select("doc_id", "rule_id", F.when(F.col("rule_id") == "own-order", F.col("start") - 1).otherwise(F.col("start")).alias("start"))


@query("generalized_terms", "SELECT p_partkey, regexp_replace(p_type, '\\bSTANDARD POLISHED\\b|\\bSTANDARD\\b', 'some kind', 'g') AS kind FROM part")
def generalized_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.generalized(F.col("p_type"), _settings(spark)).alias("kind"))


@query("read_price_globs", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 0.1 WHEN o_orderpriority LIKE '2-%' THEN 0.25 ELSE 0.5 END::DOUBLE AS price FROM orders")
def read_price_globs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.read_price(F.col("o_orderpriority"), _settings(spark).read_prices, F.lit(0.5)).alias("price"))


@query("watched_terms", "SELECT event_type AS term, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def watched_terms(spark, sf_dir):
    terms = list(_settings(spark).watch)
    found = scan.watched(table(spark, sf_dir, "events"), terms, "event_type", ("event_id",))
    return found.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("guard_script", "SELECT * FROM (VALUES (1, 'deny', true), (3, 'prompt', true), (4, 'none', true), (5, 'none', false)) t(line, decision, passed)")
def guard_script(spark, sf_dir):
    script = 'deny Bash command="rm -rf x"\n# a comment\nprompt Write file_path=a\nnone Bash command="ls"\nallow Bash command="ls"'
    return S.run_guard_script(spark, script, _settings(spark)).select("line", "decision", "passed")


@query("runtime_inventory", "SELECT 's' || min(s_suppkey) AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'Host' || s_nationkey ELSE 'host' || s_nationkey END AS literal FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'user' || n, 'extra' || n FROM (SELECT unnest([1, 2]) AS n)")
def runtime_inventory(spark, sf_dir):
    """The session's inventory from rows, each literal once, and more rows added for the next batch."""
    even = F.col("s_nationkey") % 2 == 0
    literal = F.concat(F.when(even, F.lit("Host")).otherwise("host"), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").groupBy(literal.alias("literal"), even.alias("even")).agg(F.min("s_suppkey").alias("k"))
    found = rows.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), "literal", F.lit(False).alias("case_sensitive"), F.lit(True).alias("token"), F.lit("net").alias("source"))
    again = found.withColumn("literal", F.upper("literal")).withColumn("id", F.concat(F.lit("z"), "id"))
    S.set_runtime_inventory(found, "query_inventory")
    more = S.inventory_literals(spark, [{"id": f"user{n}", "literal": f"extra{n}"} for n in (1, 2)])
    return S.refreshed("query_inventory", again.unionByName(more)).select("id", "literal")


@query("read_back_outputs", "SELECT d.doc_id AS request, md5(d.text) AS text FROM documents d WHERE d.text IS NOT NULL")
def read_back_outputs(spark, sf_dir):
    """Every text shortened, stored by its content, and read back by the id that its note names."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    store = S.originals(docs.withColumnRenamed("doc_id", "id"), most=1 << 30, most_chars=1 << 50)
    asked = docs.select(F.col("doc_id").alias("request"), T.output_id(F.col("text")).alias("output_id"))
    return S.read_back(asked, store).select("request", F.md5("text").alias("text"))


@query("observed_edits", f"WITH {THREE_SQL} SELECT count(*) AS n_edits, sum(end_at - start_at) AS n_chars, 0 AS n_secrets FROM found")
def observed_edits(spark, sf_dir):
    """Counts of edits, had as a side of counting them."""
    found = scan.scan(table(spark, sf_dir, "documents"), [RULES[i] for i in THREE])
    edits, watch = S.observe_redactions(found)
    edits.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(watch.get[k] for k in ("n_edits", "n_chars", "n_secrets"))], "n_edits long, n_chars long, n_secrets long")


@query("self_test", "SELECT * FROM (VALUES ('card', 0), ('name', 4), ('phone', 0)) t(kind, leaked)")
def self_test(spark, sf_dir):
    """Synthetic values through three rules: those that no rule knows leak in every shape."""
    rules = [RULES[i] for i in THREE]

    def mask(rows: DataFrame) -> DataFrame:
        found = spans.representatives(scan.scan(rows, rules, keys=("id",)), ("id",))
        return spans.render(rows, found.select("id", "start", "end", spans.tag(F.col("category"), F.col("rule_id")).alias("replacement")), "text", ("id",))

    return S.self_test(spark, mask, [("card", "4539 1488 0343 6467"), ("phone", "+1 (415) 555-2671"), ("name", "Zq Laoem")])


# inventories

@query("os_identities", "SELECT DISTINCT kind, literal FROM (SELECT 'user' AS kind, 'u' || s_suppkey AS literal, s_suppkey FROM supplier WHERE length('u' || s_suppkey) >= 3 AND s_suppkey % 5 > 0 UNION ALL SELECT 'host', 'box-' || s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 'home', '/home/u' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 5 > 0)")
def os_identities(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    common = F.col("s_suppkey") % 5 == 0
    hosts = table(spark, sf_dir, "supplier").select(k.alias("source"), F.when(common, "root").otherwise(F.concat(F.lit("u"), k)).alias("user"), F.concat(F.lit("box-"), F.col("s_nationkey").cast("string")).alias("host"), F.when(common, "/root").otherwise(F.concat(F.lit("/home/u"), k)).alias("home"))
    return I.os_identity(hosts).select("kind", "literal").distinct()


@query("repository_remotes", "SELECT DISTINCT 'host' AS kind, 'git.n' || s_nationkey || '.net' AS literal FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT DISTINCT 'owner', 'team' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 1")
def repository_remotes(spark, sf_dir):
    n = F.col("s_nationkey").cast("string")
    url = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://git.n"), n, F.lit(".net/a/b.git"))).otherwise(F.concat(F.lit("git@github.com:team"), n, F.lit("/b.git")))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source"), F.lit("src/x/.git/config").alias("path"), F.concat(F.lit('[remote "origin"]\n\turl = '), url).alias("text"))
    return I.repository_remotes(files)


@query("tailnet_names", "SELECT DISTINCT 'box' || s_suppkey AS literal FROM supplier UNION SELECT DISTINCT 'box' || s_suppkey || '.tail' || s_nationkey || '.ts.net' FROM supplier UNION SELECT DISTINCT 'tail' || s_nationkey || '.ts.net' FROM supplier UNION SELECT DISTINCT 'peer' || s_suppkey FROM supplier")
def tailnet_names(spark, sf_dir):
    k, n = F.col("s_suppkey").cast("string"), F.concat(F.lit("tail"), F.col("s_nationkey").cast("string"), F.lit(".ts.net"))
    own = F.struct(F.concat(F.lit("Box"), k).alias("HostName"), F.concat(F.lit("box"), k, F.lit("."), n, F.lit(".")).alias("DNSName"))
    peer = F.create_map(F.lit("k"), F.struct(F.concat(F.lit("peer"), k).alias("HostName"), F.lit("").alias("DNSName")))
    text = F.to_json(F.struct(own.alias("Self"), peer.alias("Peer"), n.alias("MagicDNSSuffix")))
    return I.tailnet_names(table(spark, sf_dir, "supplier").select(k.alias("source"), text.alias("text"))).select("literal").distinct()


@query("code_gates", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS is_code, CASE p_partkey % 4 WHEN 3 THEN true ELSE false END AS beside FROM part""")
def code_gates(spark, sf_dir):
    """A labelled value as a declaration, before a call, as a string, and beside an identity label."""
    k = F.col("p_partkey") % 4
    before = F.when(k == 0, "const ").when(k == 1, "").when(k == 2, "const ").otherwise("login as owner: ")
    value = F.when(k == 2, F.concat(F.lit('user = "'), F.col("p_brand"), F.lit('"'))).when(k == 3, F.col("p_brand")).otherwise(F.concat(F.lit("user = "), F.col("p_brand")))
    after = F.when(k == 1, "(x)").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", before.alias("b"), value.alias("v"), F.concat(before, value, after).alias("t"))
    m = F.struct(F.length("b").alias("start"), (F.length("b") + F.length("v")).alias("end"), F.col("v").alias("value"))
    return rows.withColumn("m", m).select("p_partkey", T.code_assignment(F.col("t"), F.col("m")).alias("is_code"), T.beside_identity_label(F.col("t"), F.col("m")).alias("beside"))
