"""Predicates on tool calls: selectors, commands that send or read, protected changes, secret files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import glob_pattern

SECRET_PATHS = r"(?i)(?:^|/)(?:\.env(?:\.[\w.-]+)?|\.netrc|\.npmrc|\.pypirc|id_(?:rsa|dsa|ecdsa|ed25519)|[^/]+\.(?:pem|key|p12|pfx)|kubeconfig|\.kube/config|\.aws/credentials|\.git-credentials)$"
NETWORK = r"(?i)(?:^|[;&|\s(])(?:curl|wget|nc|ncat|ssh|scp|sftp|rsync|ftp|telnet|httpie|http)\s"
SENDS = r"(?i)(?:^|[;&|\s(])(?:curl\b[^|;&]*\s(?:-d|--data\S*|-F|--form|-T|--upload-file|-X\s*(?:POST|PUT|PATCH))\b|scp\s|rsync\s[^|;&]*:|git\s+push\b|nc\s|aws\s+s3\s+(?:cp|sync)\b|gh\s+(?:gist|issue|pr)\s+create\b)"
READS_OUTSIDE = r"(?i)(?:^|[;&|\s(])(?:curl|wget|lynx|w3m|git\s+(?:clone|fetch|pull)|gh\s+\w+\s+view|npm\s+view)\b"
COPIES = r"(?i)(?:^|[;&|\s(])(?:cp|mv|install|dd|tee|rsync)\s|[^0-9&>]>{1,2}\s*[^&\s]"
DESTROYS = r"(?i)\bgit\s+(?:[^|;&]*\s)?(?:push\s[^|;&]*(?:--force\b|-f\b|--force-with-lease)|reset\s[^|;&]*--hard\b|clean\s[^|;&]*-\w*f|branch\s[^|;&]*-D\b|checkout\s+(?:--\s+)?\.(?:\s|$)|restore\s+\.|stash\s+(?:drop|clear)|reflog\s+expire|filter-branch|update-ref\s+-d)"
SENDS_COOKIE = r"(?i)\b(?:curl|wget)\b[^|;&]*(?:\s-b\s|--cookie\b|--load-cookies\b|-H\s*['\"]?Cookie:)"
UNMASKS = r"(?i)\brot13\b|\btr\s+['\"]?[a-z]-?[a-z]|codecs\.(?:de|en)code\([^)]*rot|y/[a-z]+/[a-z]+/i?"


def secret_path(path: Column) -> Column:
    return path.rlike(SECRET_PATHS)


def reaches_network(command: Column) -> Column:
    return command.rlike(NETWORK)


def sends_out(command: Column) -> Column:
    return command.rlike(SENDS)


def reads_outside(tool: Column, command: Column) -> Column:
    return tool.isin("WebFetch", "WebSearch", "web_search", "fetch") | F.coalesce(command.rlike(READS_OUTSIDE), F.lit(False))


def copies_data(command: Column) -> Column:
    return command.rlike(COPIES)


def destroys_history(command: Column) -> Column:
    return command.rlike(DESTROYS)


def sends_cookies(command: Column) -> Column:
    return command.rlike(SENDS_COOKIE)


def unmasks(command: Column) -> Column:
    return command.rlike(UNMASKS)


def shell_command(arguments: Column) -> Column:
    """The command line of a shell call: a string, or an argument vector."""
    given = F.coalesce(F.get_json_object(arguments, "$.command"), F.get_json_object(arguments, "$.cmd"), F.get_json_object(arguments, "$.script"))
    vector = F.from_json(given, "array<string>")
    return F.when(given.rlike(r"^\s*\["), F.coalesce(F.array_join(vector, " "), given)).otherwise(given)


def write_targets(arguments: Column) -> Column:
    one = F.coalesce(*[F.get_json_object(arguments, f"$.{k}") for k in ("file_path", "path", "notebook_path", "target_file")])
    patched = F.regexp_extract_all(F.coalesce(F.get_json_object(arguments, "$.patch"), F.get_json_object(arguments, "$.input"), F.lit("")), F.lit(r"(?m)^(?:\*\*\* (?:Add|Update|Delete) File: |\+\+\+ b/)(.+)$"), F.lit(1))
    return F.array_compact(F.concat(F.array(one), patched))


def parse_selector(text: str) -> tuple[str, list[tuple[str, str]]]:
    """`tool(arg:pattern, ...)` -> tool glob and (argument, glob) pairs; commas and colons may be escaped."""
    m = re.fullmatch(r"\s*([^()\s]+)\s*(?:\((.*)\))?\s*", text, re.DOTALL)
    if not m:
        raise ValueError(f"not a selector: {text!r}")
    pairs = []
    for part in re.split(r"(?<!\\),", m[2] or ""):
        if part.strip():
            name, colon, pattern = part.strip().partition(":")
            pairs.append((name.strip(), pattern.replace("\\,", ",").strip()) if colon else ("", part.strip()))
    return m[1], pairs


def selects(selector: str, tool: Column, arguments: Column) -> Column:
    """Whether a selector takes a call; an argument without a name stands for the usual ones."""
    glob, pairs = parse_selector(selector)
    out = tool.rlike(glob_pattern(glob))
    for name, pattern in pairs:
        names = [name] if name else ["command", "file_path", "path", "url"]
        value = F.coalesce(*[F.get_json_object(arguments, f"$.{n}") for n in names])
        out = out & F.coalesce(value.rlike("(?s)" + glob_pattern(pattern.replace("*", "**") if name in ("", "command") else pattern)), F.lit(False))
    return out


def decide(calls: DataFrame, deny: list[str], prompt: list[str], allow: list[str]) -> DataFrame:
    """Adds decision: deny before prompt before allow; null where no selector takes the call."""
    any_of = lambda s: F.coalesce(F.greatest(*[selects(x, F.col("tool"), F.col("arguments")) for x in s], F.lit(False), F.lit(False)), F.lit(False)) if s else F.lit(False)
    return calls.withColumn("decision", F.when(any_of(deny), "deny").when(any_of(prompt), "prompt").when(any_of(allow), "allow"))


# What names of tools say that they do, and tools that the harness runs for itself.
ACTS = r"(?i)(?:write|edit|delete|remove|create|update|send|post|upload|exec|run|shell|terminal|push|deploy|move|rename|publish|commit|merge|drop|kill)"
OWN_TOOLS = r"(?i)^(?:todo|task|cron|plan|update_plan|skill|agent|sendmessage)"
GUARDED_TOOLS = ("Bash", "bash", "Read", "Write", "Edit", "MultiEdit", "Glob", "Grep", "LS", "WebFetch", "WebSearch")
GUARDED_ARGUMENTS = ("command", "cmd", "script", "file_path", "path", "patch", "url")
INPUT_NOTE = r"\[[0-9]+ (?:more )?characters? of this earlier call's input (?:left out|removed)"


def unguarded_tools(offers: DataFrame, key: str = "request", tool: str = "tool", arguments: str = "arguments", reviewed: tuple[str, ...] = ()) -> DataFrame:
    """key, tool: tools offered whose names say that they act and that no guard reads."""
    name = F.col(tool)
    read = name.isin(*GUARDED_TOOLS) | name.rlike(OWN_TOOLS) | F.arrays_overlap(F.coalesce(F.col(arguments), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in GUARDED_ARGUMENTS]))
    for glob in reviewed:
        read = read | name.rlike(glob_pattern(glob))
    return offers.where(name.rlike(ACTS) & ~read).select(key, tool).distinct()


def holds_input_note(arguments: Column) -> Column:
    """A call whose input starts or ends with a note that stood for an earlier input: never what was meant."""
    strings = F.regexp_extract_all(arguments, F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    return F.exists(strings, lambda v: v.rlike(r"^(?:\s|\\[nrt])*" + INPUT_NOTE) | v.rlike(INPUT_NOTE + r"[^\]]*\](?:\s|\\[nrt])*$"))


def spelled_out(text: Column) -> Column:
    """Runs of byte escapes in a text, read back: \\x41, %41, 0x41, \\101 and \\u0041, three units or more."""
    text = F.replace(text, F.lit("\\\\"), F.lit("\\"))  # JSON doubles backslashes
    hexes = lambda pattern, unit: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.array_join(F.regexp_extract_all(r, F.lit(unit), F.lit(1)), ""))
    found = F.concat(
        hexes(r"(?:\\x[0-9A-Fa-f]{2}){3,}", r"\\x(..)"), hexes(r"(?:%[0-9A-Fa-f]{2}){3,}", "%(..)"), hexes(r"(?:0x[0-9A-Fa-f]{2}[,\s]*){3,}", "0x(..)"), hexes(r"(?:\\u00[0-9A-Fa-f]{2}){3,}", r"\\u00(..)"),
        F.transform(F.regexp_extract_all(text, F.lit(r"(?:\\[0-3][0-7]{2}){3,}"), F.lit(0)), lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"\\([0-7]{3})"), F.lit(1)), lambda o: F.lpad(F.conv(o, 8, 16), 2, "0")), "")),
    )
    return F.filter(F.transform(found, lambda h: F.call_function("try_validate_utf8", F.unhex(h).cast("string"))), lambda v: v.isNotNull())


def spells_masked(calls: DataFrame, values: DataFrame, key: str = "call_id", arguments: str = "arguments") -> DataFrame:
    """key, value: calls whose arguments spell a masked value byte by byte. Decoded runs are cut into words and
    joined to the values (column value), so the cost does not grow with their number."""
    decoded = calls.select(key, F.explode(spelled_out(F.col(arguments))).alias("run"))
    words = decoded.select(key, F.explode(F.array_distinct(F.concat(F.array("run"), F.split("run", r"[\s,;\"']+")))).alias("value"))
    return words.join(values.select("value").distinct(), "value").select(key, "value").distinct()
