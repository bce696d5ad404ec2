"""Format-preserving Feistel pseudonyms, as DataFrame expressions only.

Card numbers, phone numbers, social security numbers, IPv4 addresses and calendar dates that pass their validity rules are
permuted within their own format by a keyed Feistel network over two halves of the value, so the result is again valid,
equal values get equal pseudonyms in every document, and the key's owner can invert them. E-mail local parts and secrets
have no numeric format; they get keyed digests in their own layout of letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import fresh

ROUNDS = 8

# The formats, in the order in which they are tried at a place.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
KEY_ID = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
SECRET = r"\b(?i:password|passwd|secret|token|api_key)\s*[=:]\s*\"?[A-Za-z0-9+/_-]{8,}\"?"
DATE = r"(?<![\d-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
ANY = "|".join([EMAIL, KEY_ID, SECRET, DATE, SSN, IP, PHONE, CARD])
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 73,049 days, to the end of 2099


def _mix(key: str, kind: str, i: Column, value: Column) -> Column:
    """Round function: 60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column, inverse: bool = False) -> Column:
    """Keyed permutation of the pairs (0 <= left < left_size, 0 <= right < right_size); an even number of rounds."""

    def step(s: Column, i: Column) -> Column:
        # even rounds change the left part, odd ones the right part
        even = i % 2 == 0
        a = F.when(even, s["a"] + _mix(key, kind, i, s["b"]) % left_size).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(s["b"] + _mix(key, kind, i, s["a"]) % right_size)
        return F.struct(F.pmod(a, left_size).alias("a"), F.pmod(b, right_size).alias("b"))

    def undo(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, s["a"] - _mix(key, kind, i, s["b"]) % left_size).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise(s["b"] - _mix(key, kind, i, s["a"]) % right_size)
        return F.struct(F.pmod(a, left_size).alias("a"), F.pmod(b, right_size).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b")), undo if inverse else step)


def _bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(key: str, kind: str, digits: Column, inverse: bool = False) -> Column:
    """Permutation of the digit strings of one length (2 to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    sizes = [F.pow(F.lit(10), n).cast("bigint") for n in (half, rest)]
    out = _feistel(key, kind, F.left(digits, half).cast("bigint"), F.right(digits, rest).cast("bigint"), *sizes, inverse)
    return _bound(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))


def _laid_out(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(layout, ""), start, put, lambda s: s["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, beginning with the last."""
    value = lambda c, i: F.when(i % 2 == 0, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    body = F.left(digits, F.length(digits) - 1)
    return (_luhn_sum(body) + F.right(digits, F.lit(1)).cast("int")) % 10 == 0


def _card(key: str, x: Column, digits: Column, inverse: bool) -> Column:
    """All digits but the last are permuted, the last is the check digit of the others."""
    body = _digits(key, "card", F.left(digits, F.length(digits) - 1), inverse)
    return _bound(body, lambda b: _laid_out(x, F.concat(b, F.pmod(-_luhn_sum(b), F.lit(10)).cast("string"))))


def _phone(key: str, x: Column, digits: Column, inverse: bool) -> Column:
    """The country code and the first digit of the area stay; what follows is permuted."""
    start = F.length(F.regexp_replace(F.regexp_extract(x, r"^\+\d{1,3}(?=[ (-])|^\+\d", 0), r"\+", "")) + 1
    tail = _digits(key, "phone", F.substring(digits, start + 1, F.length(digits)), inverse)
    return _laid_out(x, F.concat(F.left(digits, start), tail))


def _ip(key: str, x: Column, inverse: bool) -> Column:
    o = [F.split_part(x, F.lit("."), F.lit(k + 1)).cast("int") for k in range(4)]
    out = _feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), inverse)
    part = lambda v, high: (F.floor(v / 256) if high else v % 256).cast("string")
    return _bound(out, lambda s: F.concat_ws(".", part(s["a"], True), part(s["a"], False), part(s["b"], True), part(s["b"], False)))


def _date(key: str, x: Column, inverse: bool) -> Column:
    day = F.datediff(F.try_to_date(x), F.lit(FIRST_DAY).cast("date"))
    out = _feistel(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), inverse)
    return _bound(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")).cast("string"))


def _ssn(key: str, x: Column, inverse: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01 and serials from 0001 are permuted among themselves."""
    area = F.substring(x, 1, 3).cast("int")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (F.substring(x, 5, 2).cast("int") - 1) * 9999 + F.substring(x, 8, 4).cast("int") - 1
    out = _feistel(key, "ssn", place, rest, F.lit(898), F.lit(99 * 9999), inverse)
    area_of = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
    pad = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
    return _bound(out, lambda s: F.concat_ws("-", pad(area_of(s["a"]), 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4)))


def _digest(key: str, kind: str, x: Column) -> Column:
    """Letters for letters and digits for digits, taken from a keyed digest of the value; other signs stay."""
    stream = F.transform(F.sequence(F.lit(0), F.floor(F.length(x) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x), 256))
    hexes = F.array_join(stream, "")

    def put(h: Column) -> Column:
        sign = lambda c, i: (
            F.when(c.rlike("[0-9]"), F.translate(F.substring(h, i + 1, F.lit(1)), "abcdef", "031425"))
            .when(c.rlike("[a-z]"), F.translate(F.substring(h, i + 1, F.lit(1)), "0123456789", "ghijklmnop"))
            .when(c.rlike("[A-Z]"), F.upper(F.translate(F.substring(h, i + 1, F.lit(1)), "0123456789", "ghijklmnop")))
            .otherwise(c)
        )
        return F.array_join(F.transform(F.split(x, ""), sign), "")

    return _bound(hexes, put)


def pseudonym(x: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a string that matches ANY; the string itself where it fails its format's validity rules.

    ``inverse`` maps numbers and dates back; digests cannot be mapped back and stay.
    """
    digits = F.regexp_replace(x, "[^0-9]", "")
    whole = lambda p: x.rlike(f"^(?:{p})$")
    stay = lambda c: x if inverse else c
    local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    name = F.regexp_extract(x, r"^(?i:password|passwd|secret|token|api_key)\s*[=:]\s*\"?", 0)
    return (
        F.when(whole(EMAIL), stay(F.concat(_digest(key, "mail", local), F.lit("@"), host)))
        .when(whole(KEY_ID), stay(F.concat(F.left(x, F.lit(4)), _digest(key, "key", F.substring(x, 5, 16)))))
        .when(name != "", stay(F.concat(name, _digest(key, "secret", F.substring(x, F.length(name) + 1, F.length(x))))))
        .when(whole(DATE), F.coalesce(_date(key, x, inverse), x))
        .when(whole(SSN), _ssn(key, x, inverse))
        .when(whole(IP), _ip(key, x, inverse))
        .when(whole(PHONE), _phone(key, x, digits, inverse))
        .when(F.length(digits).between(13, 19) & luhn_valid(digits), _card(key, x, digits, inverse))
        .otherwise(x)
    )


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with the pseudonyms in ``text`` and a column n_private (bigint), the number of replaced values.

    Whoever has ``key`` can map numbers and dates back; an empty key is an error.

    Null texts stay null with 0. Values that fail their validity rules (a card number without its check digit, a date that
    is no day) stay. The work is done inside each row: nothing is shuffled, whatever group a value belongs to. An existing
    column n_private is replaced; repeated rows get equal results.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    own = [c for c in docs.columns if c.lower() != "n_private"]
    hits, new, parts = (fresh(docs, n) for n in ("_hits", "_new", "_parts"))
    found = docs.withColumn(hits, F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    mapped = found.withColumn(new, F.transform(hits, lambda x: pseudonym(x, key, inverse)))
    cut = F.when(F.size(hits) > 0, F.split("text", ANY, -1))
    joined = F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda p, h: F.concat(p, h)), "")
    out = mapped.withColumn(parts, cut)
    changed = F.aggregate(F.zip_with(hits, new, lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    text = F.when(F.size(hits) > 0, joined).otherwise(F.col("text"))
    return out.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in own], changed.alias("n_private"))
