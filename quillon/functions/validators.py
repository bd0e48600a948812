"""Checksum and shape predicates as Column builders: value -> boolean, null for null.

All are built-in expressions, so they stay in whole-stage code. VALIDATORS is the registry by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import once

Predicate = Callable[[Column], Column]

# Published test card numbers.
TEST_CARDS = (
    "4111111111111111", "4242424242424242", "4012888888881881", "4222222222222", "4000056655665556", "5555555555554444", "5105105105105100", "5200828282828210",
    "2223003122003222", "378282246310005", "371449635398431", "6011111111111117", "6011000990139424", "3056930009020004", "30569309025904", "38520000023237", "3530111333300000", "3566002020360505",
)
# Weights, letters and maps of the national number schemes.
MY_NUMBER = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
KOREAN_RESIDENT = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
KOREAN_BUSINESS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
CHINESE_RESIDENT = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHINESE_CHECK = "10X98765432"
SPANISH_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ITALIAN_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def digit(v: Column, at: int) -> Column:
    """The digit at a place from 1; null where it is none."""
    return F.substring(v, at, 1).try_cast("int")


def weighted(v: Column, weights: tuple[int, ...]) -> Column:
    terms = [digit(v, i + 1) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def _sure(condition: Column, v: Column) -> Column:
    """False rather than null for a value that does not parse."""
    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(condition, F.lit(False)))


def luhn(v: Column) -> Column:
    d = digits(v)
    return _sure((F.length(d) > 1) & F.call_function("luhn_check", d), v)


def real_card(v: Column) -> Column:
    return luhn(v) & F.length(digits(v)).between(12, 19) & ~digits(v).isin(*TEST_CARDS)


def real_aws_key(v: Column) -> Column:
    return ~F.endswith(v, F.lit("EXAMPLE"))


def my_number(v: Column) -> Column:
    d = digits(v)
    rest = weighted(d, MY_NUMBER) % 11
    return _sure((F.length(d) == 12) & (digit(d, 12) == F.when(rest <= 1, 0).otherwise(11 - rest)), v)


def french_nir(v: Column) -> Column:
    c = F.regexp_replace(F.upper(v), r"[\s.\-]", "")
    plain = F.regexp_replace(F.regexp_replace(c, "^(.{5})2A", "$119"), "^(.{5})2B", "$118")
    number, key = F.substring(plain, 1, 13).try_cast("long"), F.substring(plain, 14, 2).try_cast("long")
    return _sure(plain.rlike("^[0-9]{15}$") & (key == 97 - number % 97), v)


def _letter_number(c: Column) -> Column:
    """0 for 0 and A, 1 for 1 and B, and so on."""
    return F.coalesce(c.try_cast("int"), F.ascii(c) - 65)


def codice_fiscale(v: Column) -> Column:
    c = F.upper(F.regexp_replace(v, r"\s", ""))
    odd = F.array(*[F.lit(x) for x in ITALIAN_ODD])
    total = F.lit(0)
    for i in range(15):
        number = _letter_number(F.substring(c, i + 1, 1))
        total = total + (F.get(odd, number) if i % 2 == 0 else number)
    # omocodia: letters may stand for digits in the seven numeric places
    shape = c.rlike("^[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]$")
    return _sure(shape & (F.ascii(F.substring(c, 16, 1)) - 65 == total % 26), v)


def german_id(v: Column) -> Column:
    d = digits(v)
    product = F.lit(10)
    for i in range(10):
        s = (digit(d, i + 1) + product) % 10
        product = (F.when(s == 0, 10).otherwise(s) * 2) % 11
    check = (11 - product) % 10
    return _sure((F.length(d) == 11) & ~F.startswith(d, F.lit("0")) & (digit(d, 11) == check), v)


def spanish_nif(v: Column) -> Column:
    c = F.regexp_replace(F.upper(v), r"[\s\-]", "")
    plain = F.translate(F.substring(c, 1, 1), "XYZ", "012")
    number = F.concat(plain, F.substring(c, 2, 7)).try_cast("int")
    letter = F.substring(F.lit(SPANISH_LETTERS), number % 23 + 1, F.lit(1))
    return _sure(c.rlike("^[XYZ0-9][0-9]{7}[A-Z]$") & (F.substring(c, 9, 1) == letter), v)


def korean_resident(v: Column) -> Column:
    d = digits(v)
    return _sure((F.length(d) == 13) & (digit(d, 13) == (11 - weighted(d, KOREAN_RESIDENT) % 11) % 10), v)


def korean_business(v: Column) -> Column:
    d = digits(v)
    total = weighted(d, KOREAN_BUSINESS) + F.floor(digit(d, 9) * 5 / 10)
    return _sure((F.length(d) == 10) & (digit(d, 10) == (10 - total % 10) % 10), v)


def chinese_resident(v: Column) -> Column:
    c = F.upper(v)
    check = F.substring(F.lit(CHINESE_CHECK), (weighted(c, CHINESE_RESIDENT) % 11 + 1).cast("int"), F.lit(1))
    return _sure(c.rlike("^[0-9]{17}[0-9X]$") & (F.substring(c, 18, 1) == check), v)


def _octets(v: Column) -> tuple[Column, ...]:
    parts = F.split(v, r"\.")
    return tuple(F.get(parts, F.lit(i)).try_cast("int") for i in range(4))


def reserved_ipv4(v: Column) -> Column:
    """Not a public address, or not an address at all."""
    a, b, c, _ = octets = _octets(v)
    well_formed = v.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & (F.greatest(*octets) <= 255)
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)) | ((b == 88) & (c == 99)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.when(v.isNull(), F.lit(None)).otherwise(~F.coalesce(well_formed, F.lit(False)) | F.coalesce(special, F.lit(True)))


def ipv6_groups(v: Column) -> Column:
    """The eight groups as lower-case hexadecimal without leading zeros; null where v is no address."""
    part = lambda halves, k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    sound = lambda plain: plain.rlike("^[0-9a-f:]+$") & ~plain.rlike(":::|^:[^:]|[^:]:$")

    def filled(left: Column, right: Column, n_halves: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        return F.when(n_halves == 2, F.when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing.cast("int")), right))).when((n_halves == 1) & (F.size(left) == 8), left)

    def shown(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    def of_halves(halves: Column) -> Column:
        return once(F.struct(part(halves, 0).alias("left"), part(halves, 1).alias("right"), F.size(halves).alias("n")), lambda x: once(filled(x["left"], x["right"], x["n"]), shown))

    plain = F.lower(F.regexp_replace(F.regexp_replace(v, "%.*$", ""), r"/\d+$", ""))
    return once(plain, lambda p: F.when(sound(p), once(F.split(p, "::"), of_halves)))


def _number(groups: Column, i: int) -> Column:
    return F.conv(F.get(groups, F.lit(i)), 16, 10).cast("int")


def private_ipv6(v: Column) -> Column:
    """Link-local or unique-local, and more than a bare prefix."""

    def local(groups: Column) -> Column:
        first, rest = _number(groups, 0), F.slice(groups, 2, 7)
        return (first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF)) & F.exists(rest, lambda g: g != "0")

    return _sure(once(ipv6_groups(v), local), v)


def reserved_ipv6(v: Column) -> Column:
    def special(groups: Column) -> Column:
        first, second = _number(groups, 0), _number(groups, 1)
        return ~first.between(0x2000, 0x3FFF) | ((first == 0x2001) & second.isin(0x0DB8, 0, 0x10)) | first.between(0x3FFF, 0x3FFF)

    return F.when(v.isNull(), F.lit(None)).otherwise(F.coalesce(once(ipv6_groups(v), special), F.lit(True)))


def japanese_phone(v: Column) -> Column:
    return digits(v).rlike("^0[0-9]{9,10}$") & ~digits(v).rlike("^(0120|0800)")


def iban_sum(v: Column) -> Column:
    """The number modulo 97, with the first four characters last; null outside 15 to 34 characters."""
    c = F.upper(F.regexp_replace(v, r"[\s\-]", ""))
    moved = F.concat(F.substring(c, 5, 100), F.substring(c, 1, 4))
    step = lambda acc, ch: (acc * F.when(_letter_value(ch) > 9, 100).otherwise(10) + _letter_value(ch)) % 97
    total = F.aggregate(F.split(moved, ""), F.lit(0), step)
    return F.when(F.length(c).between(15, 34) & c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), total)


def _letter_value(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), c.try_cast("int")).when(c == "", 0).otherwise(F.ascii(c) - 55)


def iban(v: Column) -> Column:
    """The whole value, or the value without its last group, checks."""
    return _sure((iban_sum(v) == 1) | (iban_sum(F.regexp_replace(v, r"\s+\S+$", "")) == 1), v)


def literal_password(v: Column) -> Column:
    """Quoted, a PIN, or of mixed kinds; not a reference, a template or a placeholder."""
    quoted = v.rlike("^([\"']).+\\1$")
    bare = F.regexp_replace(v, "^[\"']|[\"']$", "")
    mixed = bare.rlike("[a-zA-Z]") & bare.rlike("[0-9]|[^\\w\\s]")
    return (quoted | bare.rlike("^[0-9]{4,12}$") | mixed) & (F.length(bare) >= 4) & ~reference_or_placeholder(bare)


def reference_or_placeholder(v: Column) -> Column:
    words = "(?i)^(x+|\\*+|\\.+|changeme|password|passwd|secret|example|placeholder|redacted|none|null|true|false|undefined|your[-_ ].*|my[-_ ].*|test|dummy|todo)$"
    return v.rlike(r"^(\$\{?\w|\$\(|%\w+%|<[^>]+>|\{\{|process\.env|os\.environ|env\.)") | v.rlike(words)


def literal_credential(v: Column) -> Column:
    return (F.length(v) >= 4) & ~v.rlike(r"\s|\$\{|\{\{|<[^>]*>") & ~v.rlike("^([a-z]+|[A-Z]+)$")


def prose_password(v: Column) -> Column:
    return literal_password(v) & v.rlike("[A-Za-z]") & v.rlike("[0-9]")


def customer_number(v: Column) -> Column:
    return F.regexp_count(v, F.lit("[0-9０-９]")) >= 2


def national_insurance(v: Column) -> Column:
    c = F.upper(F.regexp_replace(v, r"\s", ""))
    return c.rlike("^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$") & ~c.rlike("^(BG|GB|KN|NK|NT|TN|ZZ)")


def international_phone(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(9, 15) & ~d.rlike(r"^(\d)\1+$")


def aws_secret(v: Column) -> Column:
    return ~v.rlike("^[0-9a-fA-F]+$") & v.rlike("[a-z]") & v.rlike("[A-Z]")


VALIDATORS: dict[str, Predicate] = {
    "luhn": real_card, "luhn-only": luhn, "aws-key": real_aws_key, "mynumber-jp": my_number, "nir-fr": french_nir, "codice-fiscale-it": codice_fiscale, "steuer-id-de": german_id,
    "dni-nie-es": spanish_nif, "rrn-kr": korean_resident, "brn-kr": korean_business, "resident-id-cn": chinese_resident, "public-ipv4": lambda v: ~reserved_ipv4(v), "public-ipv6": lambda v: ~reserved_ipv6(v),
    "private-ipv6": private_ipv6, "phone-jp": japanese_phone, "iban": iban, "literal-password": literal_password, "literal-credential": literal_credential, "prose-password": prose_password,
    "customer-number": customer_number, "nino-uk": national_insurance, "phone-intl": international_phone, "aws-secret-shape": aws_secret,
}


def validator(name: str) -> Predicate:
    if name not in VALIDATORS:
        raise ValueError(f"unknown validator {name!r}; there are {', '.join(sorted(VALIDATORS))}")
    return VALIDATORS[name]
