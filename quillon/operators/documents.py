"""JSON documents as tables of scalars with their places, and redaction and swapping of what they hold.

A document is walked once (Arrow batches: no built-in expression keeps offsets) and gives a row per scalar:
path, key, kind, start and end in the raw text. Everything after that is relational: scalars are scanned as
texts, findings become edits of the raw text, and edits are rendered once per document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import scan, spans, standins
from quillon.operators.hidden import cookie_headers, encoded_blocks
from quillon.operators.rules import Rule
from quillon.operators.withhold import IMAGE_PATH, is_chain_reference, is_protocol_control

MAX_CHARS = 65_536
#: Strings longer than this are withheld unscanned.
MAX_SCAN = 2_000_000
TOO_LONG = "[withheld: too long to scan]"
OMITTED = "[omitted: could not be checked]"
# Labels whose fields are sensitive, without case and marks.
SECRET_LABELS = frozenset("password passwd passphrase pwd secret clientsecret token accesstoken refreshtoken authtoken apikey apitoken privatekey secretkey credential credentials authorization cookie sessionid pin otp".split())
PII_LABELS = frozenset("ssn socialsecuritynumber taxid iban cardnumber creditcard creditcardnumber passport passportnumber driverslicense dateofbirth dob phone phonenumber mobile email emailaddress fullname firstname lastname surname".split())
#: Fields with authenticated ciphertext: one changed character makes the provider refuse them.
OPAQUE_PATH = r"(?:^|\.)(?:encrypted_content|encryptedContent|thoughtSignature|thought_signature|signature)$"

_token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+', re.DOTALL)


def label(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def label_category(key: str | None) -> str | None:
    name = label(key or "")
    return "secret" if name in SECRET_LABELS else "pii" if name in PII_LABELS else None


def scalars_of(text: str | None) -> tuple[str, list[tuple]]:
    """Status (text, json, malformed or incomplete), and path, key, kind, start, end, value of each string and
    number that is a value. Keys are not values; null, true and false are left out."""
    if text is None or not text.lstrip()[:1] in ("{", "["):
        return "text", []
    if len(text) > MAX_CHARS:
        return "incomplete", []
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return "malformed", []
    out: list[tuple] = []
    open_: list[list] = []  # [kind, the key or index that holds now]
    key_next = False
    for m in _token.finditer(text):
        token = m[0]
        if token in "{[":
            open_.append([token, None if token == "{" else 0])
            key_next = token == "{"
        elif token in "}]":
            open_.pop()
            key_next = False
        elif token == ",":
            if open_[-1][0] == "[":
                open_[-1][1] += 1
            key_next = open_[-1][0] == "{"
        elif token == ":":
            key_next = False
        elif key_next:
            open_[-1][1] = json.loads(token)
        elif token not in ("null", "true", "false"):
            path = "".join(f"[{k}]" if kind == "[" else f".{k}" for kind, k in open_).removeprefix(".")
            key = open_[-1][1] if open_ and open_[-1][0] == "{" else None
            is_text = token[0] == '"'
            out.append((path, key, "string" if is_text else "number", m.start(), m.end(), json.loads(token) if is_text else token))
    return "json", out


SCALAR = "struct<path:string,key:string,kind:string,start:int,end:int,value:string,label:string>"


def scalars(rows: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, status, and a row per scalar (nulls where a text has none)."""

    @F.pandas_udf(f"struct<status:string,scalars:array<{SCALAR}>>")
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("path", "key", "kind", "start", "end", "value")
        for batch in batches:
            found = [scalars_of(t) for t in batch]
            yield pd.DataFrame({"status": [s for s, _ in found], "scalars": [[{**dict(zip(names, x, strict=True)), "label": label_category(x[1])} for x in xs] for _, xs in found]})

    return rows.select(*keys, walked(F.col(text)).alias("w")).select(*keys, "w.status", F.explode_outer("w.scalars").alias("s")).select(*keys, "status", "s.*")


def sensitive_scalars(walked: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings for values under sensitive keys: strings with their quotes, as the raw text has them."""
    found = walked.where("label is not null and length(value) > 0")
    return found.select(*keys, F.concat(F.lit("structured-"), "label", F.lit("-field")).alias("rule_id"), F.col("label").alias("category"), "start", "end", "value", F.lit(1.0).alias("score"), F.col("kind").alias("json_kind"))


def in_plain_string(text: Column, scalar_start: Column, scalar_end: Column, start: Column, end: Column) -> Column:
    """Whether a span is inside a JSON string's quotes, holds no escape and does not begin within one."""
    inside = (start > scalar_start) & (end < scalar_end)
    own = F.substring(text, start + 1, end - start)
    before = F.substring(text, scalar_start + 1, start - scalar_start)
    return inside & ~F.contains(own, F.lit("\\")) & ~before.rlike(r"(?<!\\)(?:\\\\)*\\(?:u[0-9A-Fa-f]{0,3})?$")


def json_text(value: Column) -> Column:
    """A text as the inside of a JSON string."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        plain = F.replace(plain, F.lit(c), F.lit(name))
    return plain


def scannable(walked: DataFrame) -> DataFrame:
    """Adds action: pass (protocol settings, references, ciphertext, images), withhold (too long) or scan."""
    path, value, size = F.col("path"), F.col("value"), F.length("value")
    image = path.rlike(IMAGE_PATH) & (value.rlike("^data:image/") | (value.rlike(r"^[A-Za-z0-9+/\s]+=*$") & (size >= 64)))
    number = (F.col("kind") == "number") & ~(value.rlike(r"^-?[0-9]{7,21}$"))
    passes = path.rlike(OPAQUE_PATH) | is_protocol_control(path) | is_chain_reference(path, value) | image | number
    return walked.withColumn("action", F.when(passes, "pass").when(size > MAX_SCAN, "withhold").otherwise("scan"))


def redacted_values(rows: DataFrame, rules: Iterable[Rule], text: str = "body", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text, n_edits: JSON bodies with what rules find in their strings and long numbers, and values
    under sensitive keys, replaced by stand-ins; what is no JSON is scanned as one text.

    A number stays one if its stand-in is digits. A body too large to walk is omitted whole.
    """
    walked = scannable(scalars(rows, text, keys))
    place = (*keys, "path", "start")
    texts = walked.where("action = 'scan'").withColumnRenamed("start", "at")
    at = (*keys, "at", "kind")
    found = scan.scan(texts, rules, "value", at)
    own = found.select(*keys, "at", "kind", "rule_id", "category", "start", "end", "value")
    labelled = texts.where("label is not null and length(value) > 0").select(*keys, "at", "kind", F.concat(F.lit("structured-"), "label", F.lit("-field")).alias("rule_id"), F.col("label").alias("category"), F.lit(0).alias("start"), F.length("value").alias("end"), "value")
    reps = spans.representatives(own.unionByName(labelled), at)
    kind = standins.kind_of(F.col("category"), F.col("rule_id"))
    changes = reps.select(*at, "start", "end", standins.stand_in(kind, F.col("value")).alias("replacement"))
    done = spans.render(texts.select(*at, "value"), changes, "value", at).where("n_edits > 0")
    quoted = F.concat(F.lit('"'), json_text(F.col("value")), F.lit('"'))
    new = F.when((F.col("kind") == "number") & F.col("value").rlike(r"^-?[1-9][0-9]{0,14}$"), F.col("value")).otherwise(quoted)
    ends = texts.select(*keys, "at", F.col("end").alias("scalar_end"))
    edits = done.join(ends, [*keys, "at"]).select(*keys, F.col("at").alias("start"), F.col("scalar_end").alias("end"), new.alias("replacement"))
    long = walked.where("action = 'withhold'").select(*keys, "start", "end", F.lit(f'"{TOO_LONG}"').alias("replacement"))
    status = walked.groupBy(*keys).agg(F.first("status").alias("status"))
    plain = rows.join(status.where("status in ('text', 'malformed')").select(*keys), list(keys), "left_semi")
    in_text = spans.representatives(spans.propagated(scan.scan(plain, rules, text, keys), plain, text, keys), keys)
    of_text = in_text.select(*keys, "start", "end", standins.stand_in(standins.kind_of(F.col("category"), F.col("rule_id")), F.col("value")).alias("replacement"))
    out = spans.render(rows.select(*keys, text), edits.unionByName(long).unionByName(of_text), text, keys)
    checked = out.join(status, list(keys), "left")
    return checked.select(*keys, F.when(F.col("status") == "incomplete", F.lit(OMITTED)).otherwise(F.col(text)).alias(text), "n_edits")


def pre_passes(rows: DataFrame, finds: str, values: DataFrame | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text, n_encoded, n_turned, n_cookies: encoded blocks that decode to a finding, rot13 copies of known
    values (column value) as whole words, then cookie headers; each on what the one before left."""
    blocks = F.filter(encoded_blocks(F.col(text)), lambda x: x["decoded"].rlike(finds))
    one = rows.select(*keys, text, F.transform(blocks, lambda x: x["block"]).alias("blocks"))
    one = one.select(*keys, F.aggregate("blocks", F.col(text), lambda acc, b: F.replace(acc, b, F.lit("[encoded data withheld]"))).alias(text), F.size("blocks").alias("n_encoded"))
    if values is not None:
        from quillon.functions.text import rot13

        turned = values.select(rot13(F.col("value")).alias("stand_in"), F.lit("[turned value withheld]").alias("value")).distinct()
        swapped = standins.swapped_back(one, turned, text, keys).withColumnRenamed("n_swapped", "n_turned")
        one = swapped.join(one.select(*keys, "n_encoded"), list(keys))
    else:
        one = one.withColumn("n_turned", F.lit(0).cast("long"))
    hidden = cookie_headers(F.col(text))
    count = F.regexp_count(hidden, F.lit(r"\[cookie\]")) - F.regexp_count(text, F.lit(r"\[cookie\]"))
    return one.select(*keys, hidden.alias(text), "n_encoded", "n_turned", count.cast("long").alias("n_cookies"))


#: Paths of what a model said and of what tools are called with, by wire format.
REPLY_PATHS = {
    "anthropic": r"^content\[[0-9]+\]\.(?:text|input(?:[.\[].*)?)$",
    "chat": r"^choices\[[0-9]+\]\.message\.(?:content|tool_calls\[[0-9]+\]\.function\.arguments(?:[.\[].*)?)$",
    "responses": r"^output\[[0-9]+\]\.(?:content\[[0-9]+\]\.text|arguments(?:[.\[].*)?|input)$",
    "gemini": r"^candidates\[[0-9]+\]\.content\.parts\[[0-9]+\]\.(?:text|functionCall\.args[.\[].*)$",
}

def swapped_bodies(rows: DataFrame, pairs: DataFrame, style: str = "style", text: str = "body", keys: tuple[str, ...] = ("reply",)) -> DataFrame:
    """Whole JSON replies with stand-ins in texts and tool arguments swapped back; other fields stay as they are.

    pairs: stand_in, value. Tokens of the raw text are joined to the pairs, so the cost does not grow with them.
    """
    walked = scalars(rows, text, keys).join(rows.select(*keys, style), list(keys))
    wanted = F.lit(False)
    for name, path in REPLY_PATHS.items():
        wanted = wanted | ((F.col(style) == name) & F.col("path").rlike(path))
    places = walked.where(wanted & (F.col("kind") == "string")).select(*keys, F.col("start").alias("from"), F.col("end").alias("to"))
    raw = rows.join(places, list(keys)).select(*keys, "from", F.expr(f"substring(`{text}`, `from` + 1, `to` - `from`)").alias("raw"))
    tokens = raw.select(*keys, "from", F.explode(scan.matches("raw", standins.WORD)).alias("m")).select(*keys, (F.col("from") + F.col("m.start")).alias("start"), (F.col("from") + F.col("m.end")).alias("end"), F.col("m.value").alias("stand_in"))
    known = standins.resolved(pairs).where("value is not null").select("stand_in", json_text(F.col("value")).alias("replacement"))
    return spans.render(rows.select(*keys, text), tokens.join(known, "stand_in").select(*keys, "start", "end", "replacement"), text, keys)


# crushing

FIRST, LAST, RARE, LEAST, SHRINK = 3, 2, 20, 30, 0.8
_missing = object()


def _rare(items: list[dict]) -> set[int]:
    """Places of items with a rare value of a field, or a number far from the field's mean."""
    found: set[int] = set()
    n = len(items)
    for key in {k for item in items for k in item}:
        values = [item.get(key, _missing) for item in items]
        named = {i: "absent" if v is _missing else json.dumps(v) for i, v in enumerate(values) if not isinstance(v, (dict, list))}
        counts = pd.Series(named, dtype=object).value_counts()
        if 2 <= len(counts) <= n / 2:
            few = {i for i, v in named.items() if counts[v] <= max(1, n // 10)}
            if len(few) <= n / 2:
                found |= few
        numbers = {i: float(v) for i, v in enumerate(values) if isinstance(v, (int, float)) and not isinstance(v, bool)}
        if len(numbers) >= 10:
            s = pd.Series(numbers)
            if (sigma := s.std(ddof=0)) > 0:
                found |= set(s.index[(s - s.mean()).abs() > 3 * sigma])
    return found


def _crushed(node: object, depth: int = 0) -> tuple[object, int]:
    if depth > 32 or not isinstance(node, (list, dict)):
        return node, 0
    if isinstance(node, dict):
        inner = {k: _crushed(v, depth + 1) for k, v in node.items()}
        return {k: v for k, (v, _) in inner.items()}, sum(c for _, c in inner.values())
    inner = [_crushed(v, depth + 1) for v in node]
    items, omitted = [v for v, _ in inner], sum(c for _, c in inner)
    if len(items) < LEAST or not all(isinstance(x, dict) for x in items):
        return items, omitted
    ends = set(range(FIRST)) | set(range(len(items) - LAST, len(items)))
    keep = ends | set(sorted(_rare(items) - ends)[:RARE])
    out: list[object] = []
    gap = 0
    for i, item in enumerate([*items, None]):
        if i < len(items) and i not in keep:
            gap += 1
            continue
        if gap:
            out.append(f"[{gap} similar item{'s' * (gap > 1)} omitted]")
            gap = 0
        if i < len(items):
            out.append(item)
    return out, omitted + len(items) - len(keep)


def crushed_json(text: str | None) -> str | None:
    """Long arrays of objects without their unremarkable items; unchanged if nothing goes or too little is saved."""
    if text is None or text.strip()[:1] not in ("{", "["):
        return text
    try:
        value, omitted = _crushed(json.loads(text))
    except (ValueError, RecursionError):
        return text
    small = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return small if omitted and len(small) <= SHRINK * len(text) else text


def crush_json(column: Column) -> Column:
    @F.pandas_udf("string")
    def crush(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(crushed_json)

    return crush(column)
