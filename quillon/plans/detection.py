"""Queries over detection, spans and stand-ins, each with the same question in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import validators as V
from quillon.operators import scan, spans, standins
from quillon.operators.rules import DEFAULT_RULES, Rule
from quillon.session import stored

RULES = {r.id: r for r in DEFAULT_RULES}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def match_sql(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text", name: str = "m") -> str:
    """Rows (key, start_at, end_at, value) of a pattern, as common table expressions that end in `name`."""
    p = _quoted(pattern)
    return f"""{name}0 AS (SELECT {key}, regexp_extract_all({text}, {p}) AS w, regexp_split_to_array({text}, {p}) AS g FROM {source} WHERE regexp_matches({text}, {p})),
{name}1 AS (SELECT {key}, w, g, unnest(generate_series(1, len(w))) AS i FROM {name}0),
{name} AS (SELECT {key}, w[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS INT) AS start_at,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) AS INT) AS end_at FROM {name}1)"""


LUHN_SQL = "list_sum(list_transform(generate_series(1, len(d)), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) * 2 > 9 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END)) % 10 = 0"
_cards = ", ".join(f"'{c}'" for c in V.TEST_CARDS)
CARD_SQL = f"""{match_sql(RULES["pii-credit-card"].pattern)},
cards AS (SELECT * FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM m) WHERE len(d) BETWEEN 12 AND 19 AND {LUHN_SQL} AND d NOT IN ({_cards}))"""
IP_SQL = f"""{match_sql(RULES["pii-ipv4-public"].pattern, name="q")},
octets AS (SELECT *, CAST(split_part(value, '.', 1) AS INT) a, CAST(split_part(value, '.', 2) AS INT) b, CAST(split_part(value, '.', 3) AS INT) c, CAST(split_part(value, '.', 4) AS INT) e FROM q),
addresses AS (SELECT * FROM octets WHERE greatest(a, b, c, e) <= 255 AND regexp_matches(value, '^(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}$')
  AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)))"""
PHONE_SQL = match_sql(RULES["pii-phone-us"].pattern, name="p")


def _findings(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "documents"), [RULES[i] for i in ids])


def _plain(findings: DataFrame) -> DataFrame:
    return findings.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "value")


@query("scan_credit_card", f"WITH {CARD_SQL} SELECT doc_id, start_at, end_at, value FROM cards")
def scan_credit_card(spark, sf_dir):
    return _plain(_findings(spark, sf_dir, "pii-credit-card"))


@query("scan_phone_us", f"WITH {PHONE_SQL} SELECT doc_id, start_at, end_at, value FROM p")
def scan_phone_us(spark, sf_dir):
    return _plain(_findings(spark, sf_dir, "pii-phone-us"))


@query("scan_ipv4_public", f"WITH {IP_SQL} SELECT doc_id, start_at, end_at, value FROM addresses")
def scan_ipv4_public(spark, sf_dir):
    return _plain(_findings(spark, sf_dir, "pii-ipv4-public"))


TOKEN_PATTERN = r'token = "[0-9a-f]{40}"'


@query("scan_labelled_token", f"WITH {match_sql(TOKEN_PATTERN)} SELECT doc_id, start_at, end_at, value FROM m")
def scan_labelled_token(spark, sf_dir):
    rule = Rule("labelled-token", "secret", TOKEN_PATTERN, hint="token = ")
    return _plain(scan.scan(table(spark, sf_dir, "documents"), [rule]))


@query("scan_all_rules_counts")
def scan_all_rules_counts(spark, sf_dir):
    """Findings of all rules by rule, category and language. Patterns with look-around have no plain SQL."""
    docs = table(spark, sf_dir, "documents")
    found = scan.scan(docs, DEFAULT_RULES, keys=("doc_id", "lang"))
    return found.groupBy("rule_id", "category", "lang").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("value").alias("n_values"), F.count_distinct("doc_id").alias("n_docs"))


THREE = ("pii-credit-card", "pii-phone-us", "pii-ipv4-public")
THREE_SQL = f"""{CARD_SQL}, {IP_SQL}, {PHONE_SQL},
found AS (SELECT doc_id, 'pii-credit-card' AS rule_id, 'pii' AS category, start_at, end_at, value FROM cards UNION ALL SELECT doc_id, 'pii-phone-us', 'pii', start_at, end_at, value FROM p
  UNION ALL SELECT doc_id, 'pii-ipv4-public', 'pii', start_at, end_at, value FROM addresses)"""


@query("finding_counts_by_lang", f"WITH {THREE_SQL} SELECT rule_id, lang, count(*) AS n_findings, count(DISTINCT value) AS n_values FROM found JOIN documents USING (doc_id) GROUP BY rule_id, lang")
def finding_counts_by_lang(spark, sf_dir):
    found = scan.scan(table(spark, sf_dir, "documents"), [RULES[i] for i in THREE], keys=("doc_id", "lang"))
    return found.groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("value").alias("n_values"))


@query("distinct_values_by_rule", f"WITH {THREE_SQL} SELECT rule_id, value, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY rule_id, value")
def distinct_values_by_rule(spark, sf_dir):
    return _findings(spark, sf_dir, *THREE).groupBy("rule_id", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("finding_distinct_places", f"WITH {THREE_SQL} SELECT DISTINCT doc_id, rule_id, start_at, end_at FROM (SELECT * FROM found UNION ALL SELECT * FROM found)")
def finding_distinct_places(spark, sf_dir):
    found = _findings(spark, sf_dir, *THREE)
    return scan.distinct_findings(found.union(found)).select("doc_id", "rule_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("mask_preview", f"WITH {THREE_SQL}, k AS (SELECT DISTINCT value, CAST(least(4, floor(length(value) / 8.0)) AS INT) AS k FROM found) SELECT value, left(value, k) || '****' || right(value, k) AS preview FROM k")
def mask_preview(spark, sf_dir):
    return _findings(spark, sf_dir, *THREE).select("value").distinct().select("value", T.masked_preview(F.col("value")).alias("preview"))


_near = "list_transform(regexp_split_to_array(lower(substr(text, greatest(start_at - 24, 0) + 1, least(start_at, 24)) || ' ' || substr(text, end_at + 1, 24)), '\\s+'), lambda w: regexp_replace(w, '^[\\pP\\pS]+|[\\pP\\pS]+$', '', 'g'))"


@query("context_gate_counts", f"WITH {THREE_SQL}, near AS (SELECT rule_id, list_has_any({_near}, ['the', 'of', 'de', 'der', 'la', 'card', 'call', 'from']) AS hit FROM found JOIN documents USING (doc_id)) SELECT rule_id, hit AS has_context, count(*) AS n FROM near GROUP BY rule_id, hit")
def context_gate_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = ("the", "of", "de", "der", "la", "card", "call", "from")
    found = scan.scan(docs, [RULES[i] for i in THREE], keys=("doc_id", "text"))
    near = scan.has_near_word(F.col("text"), F.struct("start", "end"), words, 3)
    return found.select("rule_id", near.alias("has_context")).groupBy("rule_id", "has_context").agg(F.count(F.lit(1)).alias("n"))


SPANS = """a AS (SELECT doc_id, unnest(generate_series(0, 19)) AS k, n_chars FROM documents),
s AS (SELECT doc_id, CAST((doc_id * 31 + k * 97) % greatest(n_chars, 50) AS INT) AS start_at, CAST((doc_id * 31 + k * 97) % greatest(n_chars, 50) + 3 + (doc_id * 7 + k * 13) % 17 AS INT) AS end_at, 'r' || CAST((doc_id + k) % 5 AS VARCHAR) AS rule_id,
  CASE WHEN (doc_id + k) % 3 = 0 THEN 'secret' ELSE 'pii' END AS category FROM a),
o AS (SELECT *, max(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, end_at DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_at >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_at, end_at DESC, rule_id ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


def _spans(spark, sf_dir) -> DataFrame:
    """Twenty spans per document, as its numbers make them; many overlap or touch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "n_chars")
    begin = (F.col("doc_id") * 31 + F.col("k") * 97) % F.greatest("n_chars", F.lit(50))
    return docs.select(
        "doc_id", begin.cast("int").alias("start"), (begin + 3 + (F.col("doc_id") * 7 + F.col("k") * 13) % 17).cast("int").alias("end"),
        F.concat(F.lit("r"), ((F.col("doc_id") + F.col("k")) % 5).cast("string")).alias("rule_id"), F.when((F.col("doc_id") + F.col("k")) % 3 == 0, "secret").otherwise("pii").alias("category"), F.lit("").alias("value"),
    )


@query("span_union", f"WITH {SPANS} SELECT doc_id, min(start_at) AS start_at, max(end_at) AS end_at, count(*) AS n FROM i GROUP BY doc_id, island")
def span_union(spark, sf_dir):
    return spans.islands(_spans(spark, sf_dir)).groupBy("doc_id", "island").agg(F.min("start").alias("start_at"), F.max("end").alias("end_at"), F.count(F.lit(1)).alias("n")).drop("island")


@query("range_merge_touching", f"WITH {SPANS}, t AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_at, end_at DESC, rule_id ROWS UNBOUNDED PRECEDING) AS isl FROM o) SELECT doc_id, min(start_at) AS start_at, max(end_at) AS end_at FROM t GROUP BY doc_id, isl")
def range_merge_touching(spark, sf_dir):
    return spans.merged_ranges(_spans(spark, sf_dir)).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("span_representative", f"""WITH {SPANS}, r AS (SELECT *, min(start_at) OVER w AS f, max(end_at) OVER w AS t FROM i WINDOW w AS (PARTITION BY doc_id, island)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY category <> 'secret', NOT (start_at = f AND end_at = t), rule_id, start_at, end_at) AS k FROM r) SELECT doc_id, f AS start_at, t AS end_at, rule_id, category FROM k WHERE k = 1""")
def span_representative(spark, sf_dir):
    return spans.representatives(_spans(spark, sf_dir)).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "rule_id", "category")


@query("value_propagation", f"""WITH {THREE_SQL}, v AS (SELECT DISTINCT doc_id, value FROM found), c AS (SELECT v.doc_id, value, string_split(text, value) AS g FROM v JOIN documents USING (doc_id)),
e AS (SELECT doc_id, value, g, unnest(generate_series(1, len(g) - 1)) AS i FROM c), pl AS (SELECT doc_id, value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(value) AS INT) AS start_at FROM e),
b AS (SELECT pl.doc_id, value, start_at, text FROM pl JOIN documents USING (doc_id)),
ok AS (SELECT doc_id, value, start_at FROM b WHERE NOT regexp_matches(CASE WHEN start_at > 0 THEN substr(text, start_at, 1) ELSE '' END, '[\\pL\\pN_]') AND NOT regexp_matches(substr(text, start_at + length(value) + 1, 1), '[\\pL\\pN_]')
  UNION SELECT doc_id, value, start_at FROM found) SELECT DISTINCT doc_id, value, start_at FROM ok""")
def value_propagation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan.scan(docs, [RULES[i] for i in THREE])
    return spans.propagated(found, docs).select("doc_id", "value", F.col("start").alias("start_at"))


@query("redacted_text_hash", f"""WITH {PHONE_SQL}, {IP_SQL.replace("q0", "y0").replace("q1", "y1").replace("q AS", "q AS")}
SELECT doc_id, sha256(regexp_replace(text, {_quoted(RULES["pii-phone-us"].pattern)}, '[PII:pii-phone-us]', 'g')) AS text_hash, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS n_edits FROM documents d""")
def redacted_text_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    reps = spans.representatives(scan.scan(docs, [RULES["pii-phone-us"]]))
    done = spans.render(docs, spans.edits(reps, spans.tag(F.col("category"), F.col("rule_id"))))
    return done.select("doc_id", F.sha2("text", 256).alias("text_hash"), "n_edits")


SQL["redacted_text_hash"] = f"""WITH {PHONE_SQL}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, sha256(regexp_replace(text, {_quoted(RULES["pii-phone-us"].pattern)}, '[PII:pii-phone-us]', 'g')) AS text_hash, coalesce(n.n, 0) AS n_edits FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("redaction_all_rules")
def redaction_all_rules(spark, sf_dir):
    """Whole redaction: all rules, propagation, union, representatives, stand-ins, rendering."""
    docs = table(spark, sf_dir, "documents")
    found = spans.propagated(stored(scan.scan(docs, DEFAULT_RULES), "findings"), docs)
    reps = spans.representatives(found)
    kind = standins.kind_of(F.col("category"), F.col("rule_id"))
    done = spans.render(docs, spans.edits(reps, standins.stand_in(kind, F.col("value"))))
    return done.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"), "n_edits")


@query("window_split_counts", "SELECT doc_id, CAST(floor(greatest(length(text) - 1, 0) / 1500.0) AS BIGINT) + 1 AS n_windows, CAST(length(text) + floor(greatest(length(text) - 1, 0) / 1500.0) * 500 AS BIGINT) - CASE WHEN length(text) > 0 THEN CAST(greatest(0, 500 - (length(text) - floor(greatest(length(text) - 1, 0) / 1500.0) * 1500)) AS BIGINT) * CASE WHEN floor((length(text) - 1) / 1500.0) > 0 THEN 1 ELSE 0 END ELSE 0 END AS window_chars FROM documents")
def window_split_counts(spark, sf_dir):
    """With small windows, so that the small tables have several."""
    cut = scan.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2000, overlap=500)
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.length("window")).cast("long").alias("window_chars"))


@query("placeholder_filter", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM documents) SELECT word FROM w WHERE regexp_matches(word, '^(\\$\\{[^}]*\\}|\\$[A-Za-z_]\\w*|\\{\\{[^}]*\\}\\}|<[^<>]+>|%[A-Za-z_]\\w*%|\\[[A-Za-z _-]+\\])$')
OR lower(word) IN ('admin', 'password', 'passw0rd', 'secret', 'root', 'guest', 'test', 'default', 'postgres', '123456', 'letmein', 'qwerty', 'minioadmin', 'hunter2') OR regexp_matches(lower(word), '(^|[^a-z])(example|placeholder|changeme|change_me|your|sample|dummy|fake|redacted|insert|replace|todo|xxx+|foobar|lorem)([^a-z]|$)')
OR (length(word) > 1 AND len(list_distinct(string_split(word, ''))) = 1)""")
def placeholder_filter(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word")).distinct()
    return words.where(T.is_placeholder(F.col("word")))


@query("entropy_of_tokens", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{16,}')) AS token FROM documents), c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM w),
k AS (SELECT token, ch, count(*) AS n FROM c GROUP BY token, ch) SELECT token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM k GROUP BY token""")
def entropy_of_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{16,}"), F.lit(0))).alias("token")).distinct()
    return words.select("token", F.round(T.entropy(F.col("token")), 6).alias("entropy"))


@query("rot13_copies", "SELECT doc_id, md5(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS turned FROM documents")
def rot13_copies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.rot13(F.col("text"))).alias("turned"))


# Digit strings that follow from part keys, so that each scheme has valid and invalid ones.
_digit_sql = "SELECT p_partkey, list_transform(string_split(lpad(CAST((p_partkey * 7919 * 104729) % 1000000000000 AS VARCHAR), 12, '0'), ''), lambda x: CAST(x AS INT)) AS d FROM part"


def _sum_sql(weights) -> str:
    return " + ".join(f"d[{i + 1}] * {w}" for i, w in enumerate(weights))


@query("checksum_validators", f"""WITH n AS ({_digit_sql}), v AS (SELECT p_partkey, (d[12] = CASE WHEN ({_sum_sql(V.MY_NUMBER)}) % 11 <= 1 THEN 0 ELSE 11 - ({_sum_sql(V.MY_NUMBER)}) % 11 END) AS my_number,
  (d[10] = (10 - ({_sum_sql(V.KOREAN_BUSINESS)} + CAST(floor(d[9] * 5 / 10.0) AS INT)) % 10) % 10) AS korean_business,
  (list_sum(list_transform(generate_series(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN d[i] * 2 > 9 THEN d[i] * 2 - 9 ELSE d[i] * 2 END ELSE d[i] END)) % 10 = 0) AS luhn FROM n) SELECT * FROM v""")
def checksum_validators(spark, sf_dir):
    number = F.lpad(((F.col("p_partkey") * 7919 * 104729) % 1000000000000).cast("string"), 12, "0")
    return table(spark, sf_dir, "part").select("p_partkey", V.my_number(number).alias("my_number"), V.korean_business(F.left(number, F.lit(10))).alias("korean_business"), V.luhn(number).alias("luhn"))


@query("spanish_nif_validator", f"WITH n AS (SELECT p_partkey, (p_partkey * 48271) % 100000000 AS n, chr(65 + CAST(p_partkey % 26 AS INT)) AS l FROM part) SELECT p_partkey, substr('{V.SPANISH_LETTERS}', CAST(n % 23 AS INT) + 1, 1) = l AS valid FROM n")
def spanish_nif_validator(spark, sf_dir):
    value = F.concat(F.lpad(((F.col("p_partkey") * 48271) % 100000000).cast("string"), 8, "0"), F.char(65 + F.col("p_partkey") % 26))
    return table(spark, sf_dir, "part").select("p_partkey", V.spanish_nif(value).alias("valid"))


@query("iban_validator", """WITH n AS (SELECT p_partkey, lpad(CAST((p_partkey * 31) % 100 AS VARCHAR), 2, '0') AS c, lpad(CAST((p_partkey * 7919 * 104729) % 1000000000000 AS VARCHAR), 18, '0') AS b FROM part)
SELECT p_partkey, (CAST(b || '1314' || c AS HUGEINT) % 97 = 1) AS valid FROM n""")
def iban_validator(spark, sf_dir):
    check = F.lpad(((F.col("p_partkey") * 31) % 100).cast("string"), 2, "0")
    body = F.lpad(((F.col("p_partkey") * 7919 * 104729) % 1000000000000).cast("string"), 18, "0")
    return table(spark, sf_dir, "part").select("p_partkey", V.iban(F.concat(F.lit("DE"), check, body)).alias("valid"))


@query("reserved_ipv4_validator", """WITH n AS (SELECT p_partkey, (p_partkey * 37) % 260 AS a, (p_partkey * 11) % 256 AS b, (p_partkey * 5) % 256 AS c FROM part)
SELECT p_partkey, (a > 255 OR a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)) AS reserved FROM n""")
def reserved_ipv4_validator(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.concat_ws(".", ((k * 37) % 260).cast("string"), ((k * 11) % 256).cast("string"), ((k * 5) % 256).cast("string"), F.lit("9"))
    return table(spark, sf_dir, "part").select("p_partkey", V.reserved_ipv4(value).alias("reserved"))


TERMS = ["thion", "that the", "idiot"]


@query("watch_terms_hits", "WITH t AS (SELECT unnest(['thion', 'that the', 'idiot']) AS term), n AS (SELECT doc_id, term, least(3, len(string_split(lower(text), term)) - 1) AS n FROM documents, t) SELECT doc_id, term, CAST(n AS BIGINT) AS n FROM n WHERE n > 0")
def watch_terms_hits(spark, sf_dir):
    return scan.watched(table(spark, sf_dir, "documents"), TERMS).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("inventory_token_join", "WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), names AS (SELECT DISTINCT lower(n_name) AS w FROM nation UNION SELECT 'idiot' UNION SELECT 'thion') SELECT doc_id, w AS token, count(*) AS n FROM w JOIN names USING (w) GROUP BY doc_id, w")
def inventory_token_join(spark, sf_dir):
    """Known literals found as whole tokens: the tokens are joined to the inventory."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("token"))
    known = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("token")).union(spark.createDataFrame([("idiot",), ("thion",)], "token string")).distinct()
    return tokens.join(known, "token").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("respelled_names", """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\pL\\pN]+') AS w FROM documents), e AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w), p AS (SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS pair FROM e),
n AS (SELECT 'The Of' AS name, unnest(['the of', 'of the']) AS pair UNION ALL SELECT 'de-la', unnest(['de la', 'la de'])) SELECT doc_id, CAST(place AS INT) AS place, name FROM p JOIN n USING (pair)""")
def respelled_names(spark, sf_dir):
    names = spark.createDataFrame([("The Of",), ("de-la",)], "name string")
    return scan.respelled(table(spark, sf_dir, "documents"), names)


@query("standin_stability")
def standin_stability(spark, sf_dir):
    """Every value's stand-in, from two scans: once per value."""
    found = _findings(spark, sf_dir, *THREE)
    return standins.mapping(found.union(found))


@query("standin_shape", f"WITH {THREE_SQL} SELECT rule_id, value, length(value) AS n_chars, true AS same_length, true AS differs FROM (SELECT DISTINCT rule_id, value FROM found WHERE rule_id <> 'pii-ipv4-public')")
def standin_shape(spark, sf_dir):
    pairs = standins.mapping(_findings(spark, sf_dir, *THREE)).where("rule_id <> 'pii-ipv4-public'")
    return pairs.select("rule_id", "value", F.length("value").cast("long").alias("n_chars"), (F.length("stand_in") == F.length("value")).alias("same_length"), (F.col("stand_in") != F.col("value")).alias("differs"))


@query("standin_subnet_grouping", "SELECT CAST(o_custkey % 250 AS BIGINT) AS net, 1::BIGINT AS n_prefixes, count(DISTINCT o_orderkey % 200) AS n_addresses FROM orders GROUP BY 1")
def standin_subnet_grouping(spark, sf_dir):
    """Addresses made from keys: one stand-in prefix per real /24."""
    value = F.concat(F.lit("8.8."), (F.col("o_custkey") % 250).cast("string"), F.lit("."), (F.col("o_orderkey") % 200).cast("string"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 250).alias("net"), value.alias("v")).distinct()
    made = rows.select("net", "v", standins.ipv4(F.col("v")).alias("s"))
    return made.groupBy("net").agg(F.count_distinct(F.substring_index("s", ".", 3)).alias("n_prefixes"), F.count_distinct("s").alias("n_addresses"))


@query("swapback_roundtrip")
def swapback_roundtrip(spark, sf_dir):
    """Texts with tokens replaced by stand-ins, and swapped back: all equal to the text before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("card "), ((F.col("doc_id") * 7919 * 104729) % 1000000000000 + 4000000000000000).cast("string"), F.lit(" of "), "lang").alias("text"))
    pairs = standins.mapping(docs.select(F.lit("pii").alias("category"), F.lit("pii-credit-card").alias("rule_id"), F.split("text", " ")[1].alias("value")))
    masked = docs.join(pairs, F.split("text", " ")[1] == F.col("value")).select("doc_id", F.expr("replace(text, value, stand_in)").alias("text"))
    back = standins.swapped_back(masked, pairs)
    return back.join(docs.withColumnRenamed("text", "before"), "doc_id").select("doc_id", (F.col("text") == F.col("before")).alias("same"), "n_swapped")


@query("ambiguous_standins", "SELECT 's' || CAST(o_custkey % 700 AS VARCHAR) AS stand_in, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def ambiguous_standins(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 700).cast("string")).alias("stand_in"), F.col("o_orderpriority").alias("value"))
    return standins.ambiguous(pairs).select("stand_in", "n_values")


@query("numbered_tokens", f"""WITH {THREE_SQL}, f AS (SELECT category, value, min(doc_id) AS d FROM found GROUP BY category, value), g AS (SELECT f.category, f.value, d, min(start_at) AS s FROM f JOIN found ON found.value = f.value AND found.doc_id = d GROUP BY 1, 2, 3)
SELECT category, value, '[' || upper(category) || '_' || CAST(row_number() OVER (PARTITION BY category ORDER BY d, s, value) AS VARCHAR) || ']' AS token FROM g""")
def numbered_tokens(spark, sf_dir):
    return standins.numbered_tokens(_findings(spark, sf_dir, *THREE))
