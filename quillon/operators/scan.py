"""Detection: rules over a text column give findings, one row each, without Python code or a shuffle.

Two steps. The first reads a text once: one projection holds a condition for each rule (a cheap literal hint, then its
pattern), so what goes on are the few pairs of a text and a rule that matches there. The second step is one expression
for all rules, which takes pattern, group and gates from the rule's row: regexp_extract_all gives the matches and split
the gaps between them, so offsets are running sums. The plan does not grow with the number of rules but for
the conditions.
Offsets are in code points, from 0, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.validators import validator
from quillon.operators.rules import NEEDS, Rule


def sql_text(v: str) -> str:
    """A string as an SQL literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches_of(text: str, p: str, group: str, with_group: bool) -> str:
    whole = f"regexp_extract_all({text}, {p}, 0)"
    value = f"regexp_extract_all({text}, {p}, {group})" if with_group else whole
    found = f"zip_with({whole}, {value}, (w, v) -> named_struct('w', w, 'v', v))"
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size({whole})), {found}, (g, f) -> named_struct('g', coalesce(length(g), 0), 'w', f.w, 'v', f.v))"
    inside = "length(x.w) - length(substring_index(x.w, x.v, -1)) - length(x.v)" if with_group else "0"
    start = f"acc.at + x.g + {inside}"
    one = f"array(named_struct('start', {start}, 'end', {start} + length(x.v), 'value', x.v))"
    empty = "cast(array() as array<struct<start:int,end:int,value:string>>)"
    return f"aggregate({pairs}, named_struct('at', 0, 'out', {empty}), (acc, x) -> named_struct('at', acc.at + x.g + length(x.w), 'out', concat(acc.out, if(length(x.v) > 0, {one}, {empty}))), acc -> acc.out)"


def matches_sql(text: str, pattern: str, group: int = 0) -> str:
    """array<struct<start,end,value>> of a pattern's matches in an SQL expression; of a group if one is named
    (empty ones are left out). One fold over the matches and the gaps before them.

    A label comes before its value, so a group's place is its last one in the match.
    """
    return _matches_of(text, sql_text(pattern), str(group), bool(group))


def matches(text: str, pattern: str, group: int = 0) -> Column:
    return F.expr(matches_sql(text, pattern, group))


def near_words(text: Column, m: Column, window: int) -> Column:
    """Lower-case words within window * 8 characters on either side of a match."""
    reach = window * 8
    return T.context_tokens(_around(text, m, reach))


def _around(text: Column, m: Column, reach: Column | int) -> Column:
    before = F.substring(text, F.greatest(m["start"] - reach, F.lit(0)) + 1, F.least(m["start"], reach if isinstance(reach, Column) else F.lit(reach)))
    return F.concat(before, F.lit(" "), F.substring(text, m["end"] + 1, reach if isinstance(reach, Column) else F.lit(reach)))


def near_any(text: Column, m: Column, words: Column, window: Column) -> Column:
    """Whether one of an array of words is near a match: those of ASCII letters as whole words, others as part of
    the text. False for no words."""
    around = _around(text, m, window * 8)
    ascii_words, others = F.filter(words, lambda w: w.rlike(r"^[\x00-\x7F]*$")), F.filter(words, lambda w: ~w.rlike(r"^[\x00-\x7F]*$"))
    return F.coalesce(F.arrays_overlap(T.context_tokens(around), ascii_words), F.lit(False)) | F.exists(others, lambda w: F.contains(F.lower(around), w))


def has_near_word(text: Column, m: Column, words: tuple[str, ...], window: int) -> Column:
    return near_any(text, m, F.array(*[F.lit(w) for w in words]).cast("array<string>"), F.lit(window))


def shaped_as_secret(value: Column, number: bool = False) -> Column:
    """Not a placeholder, a piece of code or prose; a plain number only if that is allowed."""
    shaped = ~T.is_not_secret_shaped(value) | value.rlike("^[0-9]+$") if number else ~T.is_not_secret_shaped(value)
    return ~T.is_placeholder(value) & shaped & ~T.is_code_identifier(value) & ~value.rlike(r"\(.*\)|^\w+\[|=>")


RULE = "k int, rule_id string, category string, pattern string, grp int, min_entropy double, validator string, context array<string>, required boolean, excluded array<string>, near int"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A row per rule, numbered: what the second step reads. As small as the list of rules that a user wrote."""
    rows = [(k, r.id, r.category, r.pattern, r.group, float(r.min_entropy), r.validator, list(r.context), r.required, list(r.excluded), r.window) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def matching_rules(text: str, rules: list[Rule]) -> Column:
    """array<int>: the numbers of the rules whose patterns match a text. Conditions that rules share, and literal
    hints, come before patterns."""
    def condition(r: Rule) -> str:
        tests = [f"contains({text}, {sql_text(r.hint)})"] if r.hint else []
        return " and ".join([*tests, f"{text} rlike {sql_text(r.pattern)}"])

    def numbered(group: list[int]) -> str:
        return "array_compact(array(" + ", ".join(f"if({condition(rules[k])}, {k}, null)" for k in group) + "))"

    parts = []
    for name in ["", *NEEDS]:
        if group := [k for k, r in enumerate(rules) if r.needs == name]:
            parts.append(f"if({text} rlike {sql_text(NEEDS[name])}, {numbered(group)}, cast(array() as array<int>))" if name else numbered(group))
    return F.expr(f"concat({', '.join(parts)})" if parts else "cast(array() as array<int>)")


def _gates(text: Column, m: Column, rules: list[Rule]) -> Column:
    """Shape, entropy, validator and context, in this order, as the rule's row asks for them."""
    value = m["value"]
    number = F.col("validator").isin("literal-password", "literal-credential")
    shaped = F.when((F.col("category") == "secret") & (F.col("grp") > 0), F.when(number, shaped_as_secret(value, True)).otherwise(shaped_as_secret(value))).otherwise(True)
    valid = F.when(F.col("validator") == "", F.lit(True))
    for name in sorted({r.validator for r in rules} - {""}):
        valid = valid.when(F.col("validator") == name, validator(name)(value))
    entropic = F.when(F.col("min_entropy") > 0, T.entropy(value) >= F.col("min_entropy")).otherwise(True)
    near = F.when((F.size("context") > 0) & F.col("required"), near_any(text, m, F.col("context"), F.col("near"))).otherwise(True)
    far = F.when(F.size("excluded") > 0, ~near_any(text, m, F.col("excluded"), F.col("near"))).otherwise(True)
    long = F.length(value) >= F.when(F.col("category") == "pii", 3).otherwise(1)
    return long & shaped & entropic & valid & near & far


def scan(rows: DataFrame, rules: Iterable[Rule], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text -> keys and one row per finding."""
    rules = list(rules)
    names = [f"key_{n}" for n in range(len(keys))]  # keys may be called as a rule's columns are
    own = rows.where(F.col(text).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("scanned"))
    pairs = own.select("*", F.explode(matching_rules("scanned", rules)).alias("k")).join(F.broadcast(rule_table(rows.sparkSession, rules)), "k")
    found = F.expr(f"if(grp > 0, {_matches_of('scanned', 'pattern', 'grp', True)}, {_matches_of('scanned', 'pattern', '0', False)})")
    scanned = F.col("scanned")
    passed = F.filter(found, lambda m: _gates(scanned, m, rules))  # before rows are made of matches, as a row carries its text
    weak = lambda m: (F.size("context") > 0) & ~F.col("required") & ~near_any(scanned, m, F.col("context"), F.col("near"))
    scored = F.transform(passed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.when(weak(m), 0.4).otherwise(1.0).alias("score")))
    return pairs.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "rule_id", "category", F.explode(scored).alias("m")).select(*keys, "rule_id", "category", "m.*")


def scan_once(rows: DataFrame, rules: Iterable[Rule], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """scan() with each distinct text scanned once, joined back by digest. Worth it where texts repeat often."""
    keyed = rows.withColumn("digest", F.sha2(text, 256))
    distinct = keyed.groupBy("digest").agg(F.first(text).alias(text))
    found = scan(distinct, rules, text, ("digest",))
    return keyed.select("digest", *keys).join(found, "digest").select(*keys, "rule_id", "category", "start", "end", "value", "score")


def windows(rows: DataFrame, text: str = "text", size: int = 65_536, overlap: int = 8_192) -> DataFrame:
    """Texts cut into overlapping windows: all columns but text, and at (offset), window."""
    others = [c for c in rows.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return rows.select(*others, text, F.explode(starts).alias("at")).select(*others, "at", F.substring(F.col(text), F.col("at") + 1, F.lit(size)).alias("window"))


def distinct_findings(findings: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per rule, category and place."""
    return findings.dropDuplicates([*keys, "rule_id", "category", "start", "end"])


def distinct_values(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["category", "value"])


def respelled(rows: DataFrame, names: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Known names of two words found in another case, with another joiner, or reversed.

    names: name. Pairs of neighbouring words are joined to both orders of the lower-case names, so the
    cost is one row per word pair and not per name.
    """
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    pairs = rows.select(*keys, words.alias("w")).select(*keys, F.posexplode("w").alias("place", "first"), "w")
    pairs = pairs.select(*keys, "place", F.concat_ws(" ", "first", F.get("w", F.col("place") + 1)).alias("pair")).where(F.contains("pair", F.lit(" ")))
    parts = F.split(F.lower("name"), r"[^\p{L}\p{N}]+")
    known = names.select("name", F.explode(F.array_distinct(F.array(F.array_join(parts, " "), F.array_join(F.reverse(parts), " ")))).alias("pair")).where(F.size(parts) == 2)
    return pairs.join(known, "pair").select(*keys, "place", "name")


def watched(rows: DataFrame, terms: list[str], text: str = "text", keys: tuple[str, ...] = ("doc_id",), per_term: int = 3, per_row: int = 20) -> DataFrame:
    """Where watch terms (any case) stand: at most per_term places of a term and per_row in all, as reported."""
    low = f"lower(`{text}`)"

    def places(term: str) -> Column:
        return F.transform(F.slice(matches(low, _literal(term.lower())), 1, per_term), lambda m: F.struct(F.lit(term).alias("term"), m["start"].alias("start")))

    arrays = [places(t) for t in terms]
    hits = F.slice(F.array_sort(F.flatten(F.array(*arrays)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), 1, per_row)
    return rows.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def _literal(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def learnable(v: Column) -> Column:
    """A value worth finding again: 3 characters or more, not letters only, no short number, no program."""
    return (F.length(v) >= 3) & ~v.rlike("^[A-Za-z]+$") & ~v.rlike("^[0-9]{1,6}$") & ~T.is_program_name(v)


def value_shape(v: Column) -> Column:
    """Word runs, length, leading and trailing marks: what a learned value is looked up by first."""
    return F.struct(F.regexp_count(v, F.lit(r"[\p{L}\p{N}]+")).alias("runs"), F.length(v).alias("length"), F.regexp_extract(v, r"^([^\p{L}\p{N}]*)", 1).alias("lead"), F.regexp_extract(v, r"([^\p{L}\p{N}]*)$", 1).alias("trail"))


def occurrence_numbers(calls: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Derived call ids: conversation, name and the n-th occurrence of that name."""
    n = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    return calls.withColumn("call_id", F.sha2(F.concat_ws("/", F.col(key).cast("string"), F.col(name), n.cast("string")), 256))
