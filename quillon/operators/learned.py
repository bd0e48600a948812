"""Values learned from swaps: kept as keyed digests, found again in later texts, and the guarded way back.

A text's word runs are exploded with their places; runs of neighbours as long as a learned value has are joined
to it, by its shape and keyed digest or by its text. So the cost is one row per word and value length, not one
per value.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import hmac_sha256
from quillon.operators import guards, scan, standins
from quillon.operators.withhold import NOTICE

KEPT = 2_000
RUN = r"[\p{L}\p{N}_]+"


def digest(value: Column, key: bytes) -> Column:
    return F.left(hmac_sha256(key, F.lower(value)), F.lit(32))


def shape(value: Column) -> Column:
    """struct<runs,length,lead,core>: word runs, characters, those before the first run, and first to last run."""
    lead = F.length(F.regexp_extract(value, r"^([^\p{L}\p{N}_]*)", 1))
    trail = F.length(F.regexp_extract(value, r"([^\p{L}\p{N}_]*)$", 1))
    return F.struct(F.regexp_count(value, F.lit(RUN)).alias("runs"), F.length(value).alias("length"), lead.alias("lead"), (F.length(value) - lead - trail).alias("core"))


def remembered(values: DataFrame, key: bytes) -> DataFrame:
    """value, rule_id, since -> digest, shape, rule_id, since: what may be written to storage. No value is in it."""
    kept = values.where(scan.learnable(F.col("value")) & F.col("value").rlike(RUN))
    return kept.select(digest(F.col("value"), key).alias("digest"), shape(F.col("value")).alias("s"), "rule_id", "since").select("digest", "s.*", "rule_id", "since")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """Kept digests of a folder, those whose shapes are whole only; null where there are none yet."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    sound = F.col("digest").rlike("^[0-9a-f]{32}$") & F.col("rule_id").isNotNull() & (F.col("runs") > 0) & (F.col("core") > 0) & (F.col("lead") >= 0) & (F.col("length") >= F.col("lead") + F.col("core"))
    return rows.where(sound)


def keep_newest(learned: DataFrame, most: int = KEPT) -> DataFrame:
    """value, rule_id, seq -> the newest `most` values with their last rule; `since` stays that of the first time."""
    one = learned.groupBy("value").agg(F.max_by("rule_id", "seq").alias("rule_id"), F.min("seq").alias("since"), F.max("seq").alias("last"))
    return one.orderBy(F.col("last").desc(), "value").limit(most).drop("last")


def _spans(texts: DataFrame, shapes: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, start, end, found and the columns of shapes: spans of a text with as many word runs and as long from
    first to last as a shape says. shapes: runs, core, lead, length, ..."""
    lengths = sorted(r.runs for r in shapes.select("runs").distinct().collect())  # a few small numbers, however many values there are
    listed = texts.select(*keys, scan.matches(text, RUN).alias("m"))
    listed = listed.select(*keys, "m", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("m"))).alias("r"))
    at = listed.select(*keys, F.col("r").alias("runs"), F.explode(F.transform(F.sequence(F.lit(1), F.size("m") - F.col("r") + 1), lambda i: F.struct(F.element_at("m", i)["start"].alias("a"), F.element_at("m", i + F.col("r") - 1)["end"].alias("b")))).alias("x"))
    cores = at.select(*keys, "runs", F.col("x.a").alias("a"), (F.col("x.b") - F.col("x.a")).alias("core"))
    met = cores.join(shapes, ["runs", "core"]).withColumn("start", F.col("a") - F.col("lead")).where("start >= 0")
    placed = met.join(texts.select(*keys, F.col(text).alias("whole")), list(keys))
    return placed.withColumn("end", F.col("start") + F.col("length")).withColumn("found", F.expr("substring(whole, start + 1, length)")).drop("whole", "a").where(F.length("found") == F.col("length"))


def find(texts: DataFrame, kept: DataFrame, key: bytes, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept values that texts hold, without the values themselves: by shape first, then by keyed digest."""
    shapes = kept.select("runs", "core", "lead", "length").distinct()
    spans = _spans(texts, shapes, text, keys).withColumn("digest", digest(F.col("found"), key))
    return spans.join(kept.select("digest", "rule_id", "since"), "digest").select(*keys, "rule_id", "since", "start", "end", F.col("found").alias("value")).distinct()


def swapped_findings(texts: DataFrame, learned: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), seen: str = "seen") -> DataFrame:
    """Findings of learned values (value, rule_id, since) in any case and as whole tokens, in texts first seen
    (column seen) when the value was known or later.

    Spans are cut by shape alone and then met by their text, so that values of one shape are not all tried at each
    span; of a value that was learned repeatedly the first time counts.
    """
    shaped = learned.where(F.col("value").rlike(RUN)).select(F.lower("value").alias("low"), "rule_id", "since", shape(F.col("value")).alias("s")).select("low", "rule_id", "since", "s.*")
    sized = ["runs", "core", "lead", "length"]
    first = shaped.groupBy("low", "rule_id", *sized).agg(F.min("since").alias("since"))
    spans = _spans(texts, first.select(*sized).distinct(), text, keys).withColumn("low", F.lower("found")).join(first, ["low", *sized])
    timely = spans.join(texts.select(*keys, seen), list(keys)).where(F.col("since") <= F.col(seen))
    return timely.select(*keys, "rule_id", F.lit("pii").alias("category"), "start", "end", F.col("found").alias("value")).distinct()


# stand-ins that are where they should not be

def _tokens(rows: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(standins.WORD), F.lit(0))).alias("token"))


def stray_stand_ins(items: DataFrame, pairs: DataFrame, key: str = "conv_id", order: str = "turn", most: int = 20) -> DataFrame:
    """key, stand_in: stand-ins that local tools' results after the last model turn hold: one was written to disk.

    items: role, text, is_local. The first `most` of a conversation are reported, as the report is for a reader.
    """
    last = F.max(F.when(F.col("role") == "assistant", F.col(order))).over(Window.partitionBy(key))
    tail = items.withColumn("last", F.coalesce(last, F.lit(-1))).where((F.col(order) > F.col("last")) & F.col("is_local"))
    found = _tokens(tail, "text", (key, order)).join(pairs.select(F.col("stand_in").alias("token")).distinct(), "token")
    first = found.groupBy(key, F.col("token").alias("stand_in")).agg(F.min(order).alias("at"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("at", "stand_in"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "stand_in")


def synthetic(values: DataFrame, pairs: DataFrame, value: str = "value") -> DataFrame:
    """Adds is_synthetic: a value that is a stand-in already, or two of them joined by @."""
    known = pairs.select(F.col("stand_in").alias("known")).distinct()
    at = F.regexp_extract(F.col(value), r"^(.+)@([^@]+)$", 1), F.regexp_extract(F.col(value), r"^(.+)@([^@]+)$", 2)
    parts = values.select(value).distinct().select(value, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col(value).alias("part")), F.struct(F.lit(1).alias("k"), at[0].alias("part")), F.struct(F.lit(2).alias("k"), at[1].alias("part")))).alias("p"))
    hits = parts.select(value, "p.k", "p.part").join(known, F.col("part") == F.col("known")).groupBy(value).agg(F.collect_set("k").alias("ks"))
    marked = hits.select(value, (F.array_contains("ks", 0) | (F.array_contains("ks", 1) & F.array_contains("ks", 2))).alias("is_synthetic"))
    return values.join(marked, value, "left").fillna(False, ["is_synthetic"])


def all_stand_ins(rows: DataFrame, pairs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, only: whether a text holds nothing but stand-ins, joined by white space or @."""
    words = rows.select(*keys, F.explode_outer(F.filter(F.split(F.col(text), r"[\s@]+"), lambda w: w != "")).alias("token"))
    known = pairs.select(F.col("stand_in").alias("token")).distinct().withColumn("is_known", F.lit(True))
    return words.join(known, "token", "left").groupBy(*keys).agg(F.bool_and(F.coalesce("is_known", F.lit(False))).alias("only"))


def mangled(rows: DataFrame, pairs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, token, stand_in: stand-ins in a form that swapping back does not take: another case, other marks
    between their parts, or a suffix. Both sides are reduced to letters and digits and joined."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    known = pairs.select("stand_in").distinct().withColumn("plain", plain(F.col("stand_in"))).where(F.length("plain") >= 4)
    token = _tokens(rows, text, keys)
    forms = token.withColumn("plain", F.explode(F.array_distinct(F.array(plain(F.col("token")), F.regexp_replace(plain(F.col("token")), "(?:s|es|ed|ing)$", "")))))
    exact = pairs.select(F.col("stand_in").alias("token")).distinct()
    return forms.join(known, "plain").where(F.col("token") != F.col("stand_in")).join(exact, "token", "left_anti").select(*keys, "token", "stand_in").distinct()


# Words that no stand-in may be.
COMMON_WORDS = tuple("the and for are but not you all can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use admin test user data file home main name node root server".split())


def avoided(candidates: DataFrame, corpus_words: DataFrame, candidate: str = "stand_in") -> DataFrame:
    """Adds avoid: a candidate that is one common word, has no letter or digit, or whose parts all stand in the corpus.

    corpus_words: word, lower-cased.
    """
    parts = F.filter(F.split(F.lower(F.col(candidate)), "[^a-z0-9]+"), lambda w: w != "")
    each = candidates.select(candidate).distinct().select(candidate, F.explode_outer(parts).alias("word"), F.size(parts).alias("n"))
    known = corpus_words.select("word").distinct().withColumn("there", F.lit(True))
    judged = each.join(known, "word", "left").groupBy(candidate).agg(
        (F.bool_and(F.coalesce("there", F.lit(False))) | (F.max("n") == 0) | ((F.max("n") == 1) & F.bool_or(F.coalesce(F.col("word").isin(*COMMON_WORDS), F.lit(False))))).alias("avoid")
    )
    return candidates.join(judged, candidate)


# Labels of stand-ins by rule.
LABELS = (("host", "host|bucket|ssid"), ("user", "user|login|home"), ("name", "name"), ("email", "mail"), ("phone", "phone"), ("ip", "ipv[46]|subnet"), ("card", "card|iban|account"), ("id", "ssn|passport|steuer|nir|rrn|resident|customer"))


def label_for_rule(rule_id: Column, custom: Column | None = None) -> Column:
    """A rule's own label, else the first that its id names, else pii."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in LABELS:
        out = out.when(F.lower(rule_id).rlike(pattern), F.lit(name))
    out = out.otherwise(F.lit("pii"))
    return out if custom is None else F.coalesce(custom, out)


# the guarded way back

WEB_TOOLS = ("WebFetch", "WebSearch", "web_fetch", "web_search", "fetch")
SHELL_TOOLS = ("Bash", "bash", "shell")


def leaves_machine(tool: Column, arguments: Column) -> Column:
    """Whether a call's arguments go off the machine: web tools, and commands that reach the network."""
    return tool.isin(*WEB_TOOLS) | (tool.isin(*SHELL_TOOLS) & F.coalesce(guards.reaches_network(guards.shell_command(arguments)), F.lit(False)))


def plan_swap_back(calls: DataFrame, pairs: DataFrame, key: str = "call_id", tool: str = "tool", arguments: str = "arguments", tags: str = "allow_tags") -> DataFrame:
    """key, tool, arguments, resolved, unresolved, egress: arguments with stand-ins as values, and which were swapped,
    which two values share, and which stay as they would leave the machine, unless personal data may."""
    from quillon.operators.documents import json_text

    given = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    stays = leaves_machine(F.col(tool), F.col(arguments)) & ~(F.array_contains(given, "pii") | F.array_contains(given, "all"))
    marked = calls.select(key, tool, arguments, tags, stays.alias("stays"))
    pieces = F.regexp_extract_all(F.col(arguments), F.lit(standins.PIECES), F.lit(0))
    exploded = marked.select(key, "stays", F.posexplode_outer(pieces).alias("pos", "stand_in"))
    known = standins.resolved(pairs).select("stand_in", "value", F.lit(True).alias("is_known"))
    met = exploded.join(known, "stand_in", "left")
    swapped = F.when(F.col("value").isNotNull() & ~F.col("stays"), json_text(F.col("value"))).otherwise(F.col("stand_in"))
    kind = F.when(F.col("is_known") & F.col("stays"), "egress").when(F.col("is_known") & F.col("value").isNull(), "unresolved").when(F.col("is_known"), "resolved")
    listed = met.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", swapped.alias("t")))).alias("all"), *[F.array_sort(F.collect_set(F.when(kind == k, F.col("stand_in")))).alias(k) for k in ("resolved", "unresolved", "egress")]
    )
    return marked.join(listed, key).select(key, tool, tags, F.array_join("all.t", "").alias(arguments), "resolved", "unresolved", "egress")


def swap_tool_arguments(calls: DataFrame, pairs: DataFrame, key: str = "call_id") -> DataFrame:
    """plan_swap_back, with a notice and the arguments as they were for calls that a guard refuses.

    Guards, in order: a note as input, letters turned, secret files or cookies, history destroyed. A tag
    `once:` with the approval id of the call lets it through.
    """
    planned = plan_swap_back(calls, pairs, key)
    original = calls.select(key, F.col("arguments").alias("given"))
    joined = planned.join(original, key)
    command = F.coalesce(guards.shell_command(F.col("arguments")), F.lit(""))
    secret = F.exists(guards.write_targets(F.col("arguments")), guards.secret_path) | guards.sends_cookies(command) | F.exists(F.split(command, r"[\s;|&<>]+"), guards.secret_path)
    tags = F.coalesce(F.col("allow_tags"), F.array().cast("array<string>"))
    may = lambda t: F.array_contains(tags, t) | F.array_contains(tags, "all")
    approval = F.left(F.sha2(F.concat_ws("\n", "tool", "given"), 256), F.lit(8))
    note = F.when(guards.holds_input_note(F.col("given")), "input is a note").when(guards.unmasks(command) & ~may("pii"), "turns letters").when(secret & ~may("secret"), NOTICE).when(guards.destroys_history(command) & ~may("protected"), "destroys history")
    free = F.exists(tags, lambda t: t == F.concat(F.lit("once:"), approval)) & ~guards.holds_input_note(F.col("given"))
    notice = F.when(~free, note)
    return joined.select(key, "tool", F.when(notice.isNull(), F.col("arguments")).otherwise(F.col("given")).alias("arguments"), "resolved", "unresolved", "egress", approval.alias("approval"), notice.alias("notice"))
