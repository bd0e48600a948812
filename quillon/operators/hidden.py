"""Text that hides: invisible characters, encoded copies, sensitive fields of JSON, cookies, queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import rot13

INVISIBLE = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}\\x{E0000}-\\x{E007F}]"
SENSITIVE_KEY = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|authorization|cookie|ssn|iban|card[_-]?number)"


def hidden_runs(v: Column) -> Column:
    """array<struct<at,n>>: runs of invisible characters."""
    runs = F.regexp_extract_all(v, F.lit(f"{INVISIBLE}+"), F.lit(0))
    gaps = F.split(v, f"{INVISIBLE}+", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda g, r: F.struct(F.length(g).alias("g"), F.length(r).alias("r")))
    step = lambda acc, p: F.struct((acc["at"] + p["g"] + p["r"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("at"), p["r"].alias("n")))).alias("out"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def reveal(v: Column) -> Column:
    """Runs of invisible characters become a visible marker; direction overrides go unless the text is right-to-left."""
    rtl = v.rlike(r"[\u0590-\u08FF]")
    plain = F.when(rtl, v).otherwise(F.regexp_replace(v, "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]", ""))
    return F.regexp_replace(plain, "[\\x{200B}\\x{2060}-\\x{2064}\\x{FEFF}\\x{E0000}-\\x{E007F}]+", "[hidden characters]")


def encoded_blocks(v: Column, least: int = 24) -> Column:
    """array<struct<block,decoded>>: base64 and hexadecimal runs that decode to text."""
    base64 = F.regexp_extract_all(v, F.lit(rf"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{{4}}){{{least // 4},}}(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?(?![A-Za-z0-9+/=])"), F.lit(0))
    hexes = F.regexp_extract_all(v, F.lit(rf"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{{2}}){{{least // 2},}}(?![0-9A-Fa-f])"), F.lit(0))
    readable = lambda b, raw: F.struct(b.alias("block"), F.call_function("try_validate_utf8", raw.cast("string")).alias("decoded"))
    one = F.transform(base64, lambda b: readable(b, F.call_function("try_to_binary", b, F.lit("base64"))))
    two = F.transform(hexes, lambda b: readable(b, F.unhex(b)))
    return F.filter(F.concat(one, two), lambda x: x["decoded"].isNotNull() & ~x["decoded"].rlike(r"[\x00-\x08\x0E-\x1F]"))


def withheld(v: Column, finds: str, marker: str = "[encoded data withheld]") -> Column:
    """Blocks whose decoding matches a pattern are withheld whole."""
    bad = F.transform(F.filter(encoded_blocks(v), lambda x: x["decoded"].rlike(finds)), lambda x: x["block"])
    return F.aggregate(bad, v, lambda acc, b: F.replace(acc, b, F.lit(marker)))


def turned_copies(v: Column, value: Column) -> Column:
    """The text without rot13 copies of a known value."""
    return F.replace(v, rot13(value), F.lit("[turned value withheld]"))


def sensitive_fields(v: Column) -> Column:
    """array<struct<key,value>>: string fields of a JSON text whose keys name something sensitive."""
    pattern = r'"([^"\\]*)"\s*:\s*"((?:[^"\\]|\\.)*+)"'
    pairs = F.arrays_zip(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(v, F.lit(pattern), F.lit(2)).alias("value"))
    return F.filter(pairs, lambda p: p["key"].rlike(SENSITIVE_KEY) & (F.length(p["value"]) > 0))


def assignments(v: Column) -> Column:
    """array<struct<key,value>>: lines `key = value` with a sensitive key."""
    pattern = rf"(?m)^\s*(?:export\s+)?[\"']?([\w.-]*{SENSITIVE_KEY[4:]}[\w.-]*)[\"']?\s*[:=]\s*[\"']?([^\s\"',;]+)"
    pattern = "(?i)" + pattern
    return F.arrays_zip(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(v, F.lit(pattern), F.lit(2)).alias("value"))


def cookie(v: Column, set_cookie: Column) -> Column:
    """Values of a cookie string go; of Set-Cookie only the first pair's, attributes stay."""
    parts = F.split(v, ";")
    hide = lambda p: F.regexp_replace(p, "=.*$", "=[cookie]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(set_cookie & (i > 0), p).otherwise(hide(p))), ";")


def cookie_headers(v: Column) -> Column:
    hidden = F.regexp_replace(v, r"(?im)^(\s*Set-Cookie:\s*[^=;\s]+=)[^;\r\n]*", "$1[cookie]")
    return F.regexp_replace(hidden, r"(?im)((?:^\s*Cookie:\s*|;\s*(?=[^=;\r\n]+=[^;\r\n]*(?:;|$)))[^=;\r\n]+=)[^;\r\n]*", "$1[cookie]")


def query_values(url: Column) -> Column:
    """array<struct<name,value>> of a query string, decoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("name"), F.when(F.contains(p, F.lit("=")), decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("value")))


def redacted_headers(headers: Column, finds: str, passed: tuple[str, ...] = ("authorization", "x-api-key", "content-type", "content-length", "accept", "host", "user-agent")) -> Column:
    """Header values that match a pattern go; credential and protocol headers pass."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*passed), v).otherwise(F.regexp_replace(v, finds, "[redacted]")))
