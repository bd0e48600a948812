"""Stand-ins: keyed, stable substitutes that keep the shape and relations of values, and the way back.

Everything derives from HMAC-SHA256 of the value under one key, composed from built-in digests: the same
value has the same stand-in on every executor, without shared state. Relations: addresses of one /24
keep a common prefix, a user's name is the same alone and in an e-mail address, lengths and classes of
characters stay. Collisions are made explicit by a mapping table: a stand-in that two values share
resolves to neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import hmac_sha256
from quillon.functions.validators import ipv6_groups

TEST_KEY = b"quillon test key"
CONSONANTS, VOWELS = "bcdfghjklmnprstvwz", "aeiou"
# Kinds by rule.
KINDS = (
    ("email", "email|user-at-host-mail"), ("ipv4", "ipv4|tailscale-ip"), ("ipv6", "ipv6"), ("mac", "^pii-mac$"), ("home", "home-user"), ("host", "host|ssid|bucket"),
    ("user", "user"), ("name", "name"), ("digits", "card|phone|ssn|postal|number|account|passport|rrn|brn|nir|steuer|resident|customer|iban"),
)


def kind_of(category: Column, rule_id: Column) -> Column:
    out = F.when(category == "secret", F.lit("secret"))
    for kind, pattern in KINDS:
        out = out.when(rule_id.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("label"))


def _bits(value: Column, kind: str, key: bytes) -> Column:
    """64 hexadecimal digits that depend on value, kind and key."""
    return hmac_sha256(key, F.concat(F.lit(kind + "\0"), value))


def _number(bits: Column, at: int, length: int) -> Column:
    return F.conv(F.substring(bits, at, length), 16, 10).cast("long")


def same_shape(value: Column, kind: str, key: bytes = TEST_KEY) -> Column:
    """Digits become digits, vowels vowels, consonants consonants; case, length and marks stay."""
    bits = _bits(value, kind, key)
    # more bits than a digest has characters: digests of the digest, as many as the length needs
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 16).cast("int")), lambda i: F.sha2(F.concat(bits, i.cast("string")), 256))
    stream = F.array_join(blocks, "")
    letters = F.lit(CONSONANTS), F.lit(VOWELS)

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        low = F.lower(c)
        pick = lambda s, size: F.substring(s, n % size + 1, F.lit(1))
        new = F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(low.rlike("[aeiou]"), pick(letters[1], len(VOWELS))).when(low.rlike("[a-z]"), pick(letters[0], len(CONSONANTS))).otherwise(c)
        return F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def ipv4(value: Column, key: bytes = TEST_KEY) -> Column:
    """In 240.0.0.0/5; one /24 per real /24, and the last number stays."""
    net, last = F.substring_index(value, ".", 3), F.substring_index(value, ".", -1)
    bits = _bits(net, "ipv4", key)
    return F.concat_ws(".", (240 + _number(bits, 1, 2) % 8).cast("string"), _number(bits, 3, 2).cast("string"), _number(bits, 5, 2).cast("string"), last)


def ipv6(groups: Column, key: bytes = TEST_KEY) -> Column:
    """From eight groups: in 2001:db8::/32, one /64 per real /64, the interface hashed."""
    net, whole = _bits(F.array_join(F.slice(groups, 1, 4), ":"), "ipv6-net", key), _bits(F.array_join(groups, ":"), "ipv6", key)
    return F.concat(F.lit("2001:db8:"), F.substring(net, 1, 4), F.lit(":"), F.substring(net, 5, 4), *[x for i in range(4) for x in (F.lit(":"), F.substring(whole, 1 + 4 * i, 4))])


def mac(value: Column, key: bytes = TEST_KEY) -> Column:
    """Locally administered; separator and case stay."""
    bits = _bits(F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", "")), "mac", key)
    separator = F.when(F.contains(value, F.lit("-")), "-").otherwise(":")
    plain = F.concat(F.lit("02"), *[x for i in range(5) for x in (separator, F.substring(bits, 1 + 2 * i, 2))])
    return F.when(value.rlike("[A-F]"), F.upper(plain)).otherwise(plain)


def user(value: Column, key: bytes = TEST_KEY) -> Column:
    return same_shape(F.lower(value), "user", key)


def host(value: Column, key: bytes = TEST_KEY) -> Column:
    """Each label mapped; role words and the last label stay."""
    labels = F.split(F.lower(value), r"\.")
    kept = "^(www|mail|smtp|imap|ns[0-9]*|db[0-9]*|web|api|dev|test|prod|staging|gateway|router|localhost)$"
    mapped = F.transform(labels, lambda x, i: F.when(x.rlike(kept) | ((i == F.size(labels) - 1) & (F.size(labels) > 1)), x).otherwise(same_shape(x, "host", key)))
    return F.array_join(mapped, ".")


def email(value: Column, key: bytes = TEST_KEY) -> Column:
    return F.concat(user(F.substring_index(value, "@", 1), key), F.lit("@"), host(F.substring_index(value, "@", -1), key))


def stand_in(kind: Column, value: Column, key: bytes = TEST_KEY) -> Column:
    """Dispatch by kind. A result equal to the value is marked, so that it never passes for one."""
    plain = (
        F.when(kind == "email", email(value, key)).when(kind == "ipv4", ipv4(value, key)).when((kind == "ipv6") & ipv6_groups(value).isNotNull(), ipv6(ipv6_groups(value), key)).when(kind == "mac", mac(value, key)).when(kind == "host", host(value, key)).when(kind == "user", user(value, key))
        .when(kind == "home", same_shape(value, "user", key)).when(kind == "digits", same_shape(value, "digits", key)).when(kind == "name", same_shape(value, "name", key)).when(kind == "secret", same_shape(value, "secret", key)).otherwise(same_shape(value, "label", key))
    )
    return F.when(plain == value, F.concat(plain, F.lit("-x"))).otherwise(plain)


def mapping(findings: DataFrame, key: bytes = TEST_KEY) -> DataFrame:
    """kind, value, rule_id, stand_in: one row per distinct value and kind."""
    kinds = findings.select(kind_of(F.col("category"), F.col("rule_id")).alias("kind"), "value", "rule_id")
    distinct = kinds.groupBy("kind", "value").agg(F.min("rule_id").alias("rule_id"))
    return distinct.withColumn("stand_in", stand_in(F.col("kind"), F.col("value"), key))


def resolved(pairs: DataFrame) -> DataFrame:
    """stand_in -> value; null where several values share it."""
    return pairs.groupBy("stand_in").agg(F.when(F.count_distinct("value") == 1, F.min("value")).alias("value"), F.count_distinct("value").alias("n_values"))


def ambiguous(pairs: DataFrame) -> DataFrame:
    return resolved(pairs).where("n_values > 1")


def numbered_tokens(findings: DataFrame, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """category, value, token: tokens numbered within a category in the order of first appearance.

    First places are aggregated first, so only distinct values are ordered. They are dealt out by ranges of (category,
    place); a value's number is its place in its range and what the ranges before hold of its category.
    """
    from quillon.session import stored

    first = findings.groupBy("category", "value").agg(F.min(F.struct(*order)).alias("first"))
    ranged = stored(first.repartitionByRange("category", "first", "value").withColumn("cell", F.spark_partition_id()), "token-cells")
    held = ranged.groupBy("category", "cell").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("category").orderBy("cell")) - F.col("held")  # a row per range
    within = F.row_number().over(Window.partitionBy("category", "cell").orderBy("first", "value"))
    placed = ranged.withColumn("within", within).join(F.broadcast(held.select("category", "cell", before.alias("before"))), ["category", "cell"])
    n = F.col("within") + F.col("before")
    return placed.select("category", "value", F.concat(F.lit("["), F.upper("category"), F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))


#: A text as tokens and what is between them: escapes of JSON, white space, words without marks at their ends, marks.
_MARKS = r"\s\"'(),;<>\[\]{}\\"
WORD = rf"[^{_MARKS}]*[^{_MARKS}.:!?]"
PIECES = rf"\\u[0-9a-fA-F]{{4}}|\\.|\s+|{WORD}|[.:!?]+|[\"'(),;<>\[\]{{}}\\]"


def swapped_back(rows: DataFrame, pairs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts with stand-ins that stand as whole tokens replaced by their values; ambiguous ones stay.

    Texts are split at white space and marks and joined to the mapping by token, so the cost does not grow with the
    number of stand-ins; white space comes back as it was.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    exploded = rows.select(*keys, F.posexplode_outer(tokens).alias("pos", "token"))
    known = resolved(pairs).where("value is not null").select(F.col("stand_in").alias("token"), "value")
    swapped = exploded.join(known, "token", "left")
    listed = swapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", "token").alias("t")))).alias("all"), F.count("value").alias("n_swapped"))
    return listed.select(*keys, F.array_join("all.t", "").alias(text), "n_swapped")
