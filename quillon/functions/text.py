"""Scalar functions on text, as Column builders over built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def entropy(v: Column) -> Column:
    """Shannon entropy in bits per character, over code points; 0 for the empty text."""
    characters = F.filter(F.split(v, ""), lambda c: c != "")
    n = F.size(characters).cast("double")
    counts = F.transform(F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))
    return F.when(n > 0, total).otherwise(F.when(v.isNotNull(), 0.0))


def masked_preview(v: Column) -> Column:
    """Up to 4 characters, and at most an eighth, from each end around ****."""
    k = F.least(F.lit(4), F.floor(F.length(v) / 8)).cast("int")
    return F.concat(F.left(v, k), F.lit("****"), F.when(k > 0, F.right(v, k)).otherwise(""))


def short_preview(v: Column) -> Column:
    """First two, last one and the length; less of short values."""
    n = F.length(v)
    return F.when(n >= 8, F.concat(F.left(v, F.lit(2)), F.lit("…"), F.right(v, F.lit(1)), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("… ("), n.cast("string"), F.lit(")")))


def escaped_pattern(v: Column) -> Column:
    """The text as a pattern that matches it."""
    return F.regexp_replace(v, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: * within a segment, ** across, ? one character, {a,b} either."""
    out, depth, at = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**", at):
            out.append(".*")
            at += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out.append(re.escape(glob[at]))
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + ")" * depth + "$"


def context_tokens(v: Column) -> Column:
    """Words split at white space, without punctuation and symbols at their ends, in lower case."""
    words = F.transform(F.split(F.lower(v), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.filter(words, lambda w: w != "")


def rot13(v: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = lower[13:] + lower[:13] + upper[13:] + upper[:13]
    return F.translate(v, lower + upper, turned)


def is_program_name(v: Column) -> Column:
    return F.lower(v).rlike(r"^(python[0-9.]*|node|deno|bun|bunx|npm|npx|yarn|pnpm|ruby|perl|bash|sh|zsh|php|java|cargo|uv|uvx|pip[0-9.]*|go|make)$")


def key_describes(v: Column) -> Column:
    """The key says something about a secret instead of holding one."""
    return F.lower(v).rlike(r"[_-]?(name|id|type|kind|path|file|url|uri|length|count|limit|expiry|expires|ttl|policy|hint|label|field|header|prefix|enabled|required)s?$")


def is_code_identifier(v: Column) -> Column:
    return v.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$")


def reads_as_words(v: Column) -> Column:
    """Runs of one case or of digits are 2.5 characters long on average, or more."""
    runs = F.regexp_count(v, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"))
    return (F.length(v) >= 8) & (F.length(F.regexp_replace(v, "[^A-Za-z0-9]", "")) / F.greatest(runs, F.lit(1)) >= 2.5)


def is_placeholder(v: Column) -> Column:
    """Slots, references, customary default credentials and marker words."""
    slot = v.rlike(r"^(\$\{[^}]*\}|\$[A-Za-z_]\w*|\{\{[^}]*\}\}|<[^<>]+>|%[A-Za-z_]\w*%|\[[A-Za-z _-]+\])$")
    same = v.rlike(r"^(.)\1+$")
    marker = F.lower(v).rlike(r"(^|[^a-z])(example|placeholder|changeme|change_me|your|sample|dummy|fake|redacted|insert|replace|todo|xxx+|foobar|lorem)([^a-z]|$)")
    default = F.lower(v).isin("admin", "password", "passw0rd", "secret", "root", "guest", "test", "default", "postgres", "123456", "letmein", "qwerty", "minioadmin", "hunter2")
    return slot | same | marker | default


def is_not_secret_shaped(v: Column) -> Column:
    """Addresses, paths, constants, header names, numbers and dotted names."""
    return (
        v.rlike(r"^[a-z][a-z0-9+.-]*://[^@\s]*$") | v.rlike(r"^(\.{0,2}/)?([\w.-]+/)+[\w.-]*$") | v.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$")
        | v.rlike("^[A-Z][a-z]+(-[A-Z][a-z]+)+$") | v.rlike(r"^[+-]?[0-9][0-9.,:]*$") | v.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")
    )


def model_base(v: Column) -> Column:
    """A model's name without a suffix in brackets or a date."""
    return F.regexp_replace(F.regexp_replace(v, r"\[[^\]]*\]$", ""), r"-20\d{6}$", "")


def clean_title(v: Column) -> Column:
    one_line = F.trim(F.regexp_replace(v, r"\s+", " "))
    bare = F.regexp_replace(one_line, "^[\"'“”‘’`]+|[\"'“”‘’`]+$", "")
    return F.when(F.length(bare) > 80, F.concat(F.rtrim(F.left(bare, F.lit(79))), F.lit("…"))).otherwise(bare)


def note_kind(tag: Column, v: Column) -> Column:
    """What a note is about: its tag and first line, with numbers blanked."""
    first = F.regexp_extract(v, r"^\s*([^\n]*)", 1)
    return F.left(F.concat(tag, F.lit(": "), F.regexp_replace(first, "[0-9]+", "#")), F.lit(120))


def output_id(v: Column) -> Column:
    """Twelve characters of the URL-safe base64 of SHA-256."""
    return F.left(F.translate(F.base64(F.unhex(F.sha2(v, 256))), "+/", "-_"), F.lit(12))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from built-in digests. The key is at most a block long."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def code_assignment(text: Column, m: Column) -> Column:
    """A labelled match whose value is a code expression and no string: declared or set as a member before it, or
    followed by an operator or a call. Quoted values are none."""
    before = F.substring(text, F.greatest(m["start"] - 16, F.lit(0)) + 1, F.least(m["start"], F.lit(16)))
    after = F.substring(text, m["end"] + 1, F.lit(8))
    declared = before.rlike(r"(?:\b(?:const|let|var|val|final|auto)\s+|[\w)\]]\.)$")
    return ~m["value"].rlike("[:=]\\s*[\"']") & (declared | after.rlike(r"^\s*(?:[=!]==?|&&|\|\||\?\??|[(\[])"))


def beside_identity_label(text: Column, m: Column) -> Column:
    """A match right after an identity label, or in front of a host."""
    before = F.substring(text, F.greatest(m["start"] - 24, F.lit(0)) + 1, F.least(m["start"], F.lit(24)))
    after = F.substring(text, m["end"] + 1, F.lit(2))
    return before.rlike("(?i)\\b(?:user(?:name)?|login|owner|account|author|email|ssh|home|host)\\b[\\s\"'`=:/~]*$") | after.rlike("^[\"'`]?@")


def is_prose_assignment(v: Column) -> Column:
    """A sentence about credentials, which a labelled pattern took for one: four words or more, one of them such a word."""
    return (F.regexp_count(v, F.lit(r"[A-Za-z]{2,}")) >= 4) & v.rlike(r"(?i)\b(?:password|passphrase|secret|token|key|credential)s?\b") & v.rlike(r"[a-z] [a-z]")
