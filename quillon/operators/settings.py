"""The user's part: settings, rules and inventories, guard and watch lists, prices, observers, scripts and self-test.

Settings are small and read on the driver; what they say becomes rules, Columns or tables.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import glob_pattern, output_id
from quillon.operators import guards, inventory
from quillon.operators.rules import Rule, fingerprint, generalize_pattern, inventory_rule, with_overrides

MOST_TERMS = 200
LEAST_TERM = 3


def read_config(spark: SparkSession, path: str) -> dict | None:
    """A JSON file of settings, on any file system that Spark reads; None where it is absent or no object."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    try:
        value = json.loads(rows[0].value) if rows else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@dataclass(frozen=True)
class Settings:
    rules: tuple[Rule, ...] = ()
    inventory: tuple[dict, ...] = ()
    generalize: tuple[tuple[str, str], ...] = ()  # pattern, phrase
    context_window: int = 3
    style: str = "lookalike"  # or tokens
    deny: tuple[str, ...] = ()
    prompt: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    watch: tuple[str, ...] = ()
    watch_action: str = "flag"  # or block
    watch_known: bool = False
    read_prices: dict[str, float] = field(default_factory=dict)


def _strings(value: object) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def guard_policy(config: dict) -> dict[str, tuple[str, ...]]:
    """Selectors of each guard list; one that cannot be read is an error, as it would guard nothing."""
    given = config.get("guards") or {}
    lists = {name: tuple(_strings(given.get(name))) for name in ("deny", "prompt", "allow")}
    for selector in (s for found in lists.values() for s in found):
        guards.parse_selector(selector)
    return lists


def watch_policy(config: dict) -> tuple[tuple[str, ...], str, bool]:
    """Terms of LEAST_TERM characters or more, each once in any case, at most MOST_TERMS as the report is read by
    people; what to do on a hit; and whether the inventory's values are watched too."""
    given = config.get("watch") or {}
    terms = {t.strip().lower(): t.strip() for t in reversed(_strings(given.get("terms"))) if len(t.strip()) >= LEAST_TERM}
    action = given.get("action")
    return tuple(reversed(terms.values()))[:MOST_TERMS], action if action in ("flag", "block") else "flag", given.get("known") is True


def read_prices(config: dict) -> dict[str, float]:
    """Model glob -> price of reading the cache over that of new input, within (0, 1]; others are left out."""
    given = config.get("read_prices") or {}
    return {k: float(v) for k, v in given.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v <= 1} if isinstance(given, dict) else {}


def read_price(model: Column, prices: dict[str, float], otherwise: Column) -> Column:
    """The price of the first glob that takes a model."""
    out = otherwise
    for glob, price in reversed(prices.items()):
        out = F.when(model.rlike(glob_pattern(glob)), F.lit(price)).otherwise(out)
    return out


def user_settings(config: dict | None) -> Settings:
    """All settings of a configuration; what is absent keeps its default, an unknown validator is an error."""
    config = config or {}
    known = set(Rule.__dataclass_fields__)
    own = [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k in known}).checked() for r in config.get("rules") or []]
    general = [(generalize_pattern(_strings(g.get("terms")), g.get("whole_words", True)), str(g.get("phrase", ""))) for g in config.get("generalize") or [] if _strings(g.get("terms"))]
    window = config.get("context_window")
    terms, action, with_known = watch_policy(config)
    return Settings(
        rules=tuple(own), inventory=tuple(e for e in config.get("inventory") or [] if isinstance(e, dict) and e.get("id") and e.get("literal")), generalize=tuple(general),
        context_window=window if isinstance(window, int) and 1 <= window <= 50 else 3, style=config.get("style") if config.get("style") in ("lookalike", "tokens") else "lookalike",
        watch=terms, watch_action=action, watch_known=with_known, read_prices=read_prices(config), **guard_policy(config),
    )


def active_rules(defaults: Iterable[Rule], settings: Settings, runtime: Iterable[dict] = ()) -> list[Rule]:
    """Default rules with the user's, and a rule for each inventory entry, the user's and those of the session."""
    own = with_overrides(list(defaults), list(settings.rules))
    entries = {e["id"]: e for e in [*settings.inventory, *runtime]}
    literals = [inventory_rule(e["id"], e["literal"], token=e.get("token", True), case_sensitive=e.get("case_sensitive", False), label=e.get("label", "")) for e in entries.values()]
    return [replace(r, window=settings.context_window) if r.context and r.window == 3 else r for r in own] + literals


INVENTORY = "id string, literal string, case_sensitive boolean, token boolean, source string"


def inventory_literals(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Inventory entries as a table: what joins by literal read instead of rules."""
    rows = [(e["id"], e["literal"], bool(e.get("case_sensitive", False)), bool(e.get("token", True)), e.get("source", "user")) for e in entries]
    return spark.createDataFrame(rows, INVENTORY)


def set_runtime_inventory(found: DataFrame, view: str = "runtime_inventory") -> DataFrame:
    """Replace the session's inventory by rows of INVENTORY, each literal once; queries read the view."""
    one = found.groupBy(F.when(F.col("case_sensitive"), F.col("literal")).otherwise(F.lower("literal")).alias("key")).agg(F.min_by(F.struct("id", "literal", "case_sensitive", "token", "source"), "id").alias("e")).select("e.*")
    one.createOrReplaceTempView(view)
    return one


def refreshed(view: str, found: DataFrame, most: int = 1000) -> DataFrame:
    """Add to the session's inventory what hosts say now, for the next micro-batch: old entries stay as they are."""
    return set_runtime_inventory(inventory.merged(found.sparkSession.table(view), found, most), view)


def generalized(text: Column, settings: Settings) -> Column:
    out = text
    for pattern, phrase in settings.generalize:
        out = F.regexp_replace(out, pattern, F.lit(phrase.replace("\\", "\\\\").replace("$", "\\$")))
    return out


def observed(rows: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Counts that are had as a side of the next action on rows: activity, or redactions as ranges, never values."""
    watch = Observation(name)
    return rows.observe(watch, *[m.alias(k) for k, m in measures.items()]), watch


def observe_redactions(edits: DataFrame, name: str = "redactions") -> tuple[DataFrame, Observation]:
    """Edits (start, end, category) and, once they are written, how many there were and how long."""
    return observed(edits, name, n_edits=F.count(F.lit(1)), n_chars=F.sum(F.col("end") - F.col("start")), n_secrets=F.count_if(F.col("category") == "secret"))


def write_window_results(findings: DataFrame, rules: Iterable[Rule], path: str, digest: str = "digest", mode: str = "append") -> None:
    """Value-free results of scanned texts: ranges by digest, under the rules' fingerprint, for sources.wire.scan_cache."""
    ranges = findings.groupBy(digest).agg(F.array_sort(F.collect_set(F.struct("start", "end", "rule_id", "category"))).alias("ranges"))
    ranges.withColumn("fingerprint", F.lit(fingerprint(list(rules)))).write.mode(mode).parquet(path)


# scripts of guard steps


@dataclass(frozen=True)
class Step:
    line: int
    kind: str  # allow, deny, prompt or none
    tool: str
    arguments: str


def guard_script(text: str) -> list[Step]:
    """Steps of a script: `deny Bash command="rm -rf x"`; empty lines and those that start with # are left out."""
    steps = []
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        words = shlex.split(line)
        if len(words) < 2 or words[0] not in ("allow", "deny", "prompt", "none"):
            raise ValueError(f"line {n} is no step: {line!r}")
        steps.append(Step(n, words[0], words[1], json.dumps(dict(w.partition("=")[::2] for w in words[2:]))))
    return steps


def run_guard_script(spark: SparkSession, text: str, settings: Settings) -> DataFrame:
    """line, tool, wanted, decision, passed: each step of a script held against the guard lists."""
    steps = guard_script(text)
    calls = spark.createDataFrame([(s.line, s.tool, s.arguments, s.kind) for s in steps], "line int, tool string, arguments string, wanted string")
    decided = guards.decide(calls, list(settings.deny), list(settings.prompt), list(settings.allow))
    decision = F.coalesce("decision", F.lit("none"))
    return decided.select("line", "tool", "wanted", decision.alias("decision"), (F.col("wanted") == decision).alias("passed"))


# shortened outputs and their way back


def originals(outputs: DataFrame, text: str = "text", order: str = "id", most: int = 10_000, most_chars: int = 64 << 20) -> DataFrame:
    """id, text: content-addressed store of shortened outputs; the newest of each content, up to a count and a size.

    Both limits are the store's own. The count is a top-k by rows; the size is a running sum over those alone.
    """
    from pyspark.sql import Window

    newest = outputs.where(F.col(text).isNotNull()).groupBy(output_id(F.col(text)).alias("output_id")).agg(F.max(order).alias("last"), F.first(text).alias(text))
    kept = newest.orderBy(F.col("last").desc(), "output_id").limit(most)
    total = F.sum(F.length(text).cast("long")).over(Window.orderBy(F.col("last").desc(), "output_id").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("total", total).where(F.col("total") <= most_chars).select("output_id", text)


def read_back(asked: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """asked (request, output_id) -> request, output_id, text: what a reader of shortened outputs gets; null where the
    store has it no more."""
    return asked.join(store, "output_id", "left").select("request", "output_id", text)


# self-test

def self_test(spark: SparkSession, mask: Callable[[DataFrame], DataFrame], canaries: list[tuple[str, str]]) -> DataFrame:
    """kind, leaked: synthetic values sent through `mask` (id, text -> id, text) in texts of several shapes. A run may
    serve only if none leaked."""
    shapes = ("{}", "see {} there", "a={}\nb", "(\"{}\")")
    rows = [(f"{kind}/{n}", kind, value, shape.format(value)) for kind, value in canaries for n, shape in enumerate(shapes)]
    sent = spark.createDataFrame(rows, "id string, kind string, value string, text string")
    back = mask(sent.select("id", "text")).select("id", F.col("text").alias("out"))
    leaked = F.contains("out", F.col("value")) | F.col("out").isNull()
    return sent.join(back, "id", "left").groupBy("kind").agg(F.count_if(leaked).alias("leaked"))


def takes(glob: str, name: str) -> bool:
    """Whether a tool's or model's name is one of a glob's, as the lists of settings have them."""
    return fnmatchcase(name, re.sub(r"\*{2,}", "*", glob))
