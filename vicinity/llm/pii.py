"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A value is found by pattern, validated (Luhn, mod 97, calendar, number ranges) and permuted within its own format by a
keyed Feistel network, so equal values stay equal in every document, different values stay different, and whoever holds
the key can undo it.  Separators and case stay where they are.  Two networks:

* strings: two halves of characters; in each round one half is shifted, character by character within its class
  (digit, lower or upper letter, hex letter), by a keyed digest of the other half.
* numbers below a * b: a pair (left, right) in Z_a x Z_b, shifted in turn by keyed digests of the other part.  Any
  composite range works without rejection: 400 Gregorian years are 189 * 773 days.

Check digits are computed anew.  Text around the values is never touched; numbers that fail validation stay as they are.

Defined results: a null text stays null with no finding; values are found left to right without overlap, the first kind
of ``KINDS`` that matches at a place wins; equal rows give equal results; a host name of more than 127 labels counts up
to the 127th.  The key is an argument or a Spark setting and stands nowhere in this code.  Like any literal it is part of
the query plan: keep plans and event logs as close as the key.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark setting with the key of the pseudonyms.
KEY_SETTING = "spark.vicinity.pii.key"
ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EPOCH = "1800-01-01"
DAYS = (189, 773)
#: Of these, the days after the 12th of a month.
LATE_DAYS = (9, 9833)

#: Kind and pattern, by precedence.  Fixed formats.  Every repeated group is bounded: the matcher recurses once for each
#: turn of a group, while repeated classes of characters are loops.  A host name has 127 labels at most.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<=[\"'])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?=[\"'])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\p{L}\p{N}/-])",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Only texts with such a character can hold a value; the others skip the search.
POSSIBLE = "[0-9@]"

LONG = "long"


def keyed(key: str, kind: Column, turn: Column | int, part: Column) -> Column:
    """64 hex digits: the keyed digest that drives a round."""
    turn = F.lit(str(turn)) if isinstance(turn, int) else turn.cast("string")
    return F.sha2(F.concat_ws("|", F.lit(key), kind, turn, part), 256)


def _number(hexits: Column, length: int = 12) -> Column:
    return F.conv(F.substring(hexits, 1, length), 16, 10).cast(LONG)


def number_feistel(x: Column, a: int, b: int, kind: Column, key: str, undo: bool = False) -> Column:
    """The permutation of 0 .. a * b - 1."""
    both = F.array(F.struct(F.floor(x / b).cast(LONG).alias("l"), (x % b).cast(LONG).alias("r")))

    def run(s: Column) -> Column:
        left, right = pair_feistel(s["l"], s["r"], a, b, kind, key, undo)
        return left * b + right

    return F.get(F.transform(both, run), 0)


def pair_feistel(left: Column, right: Column, a: int, b: int, kind: Column, key: str, undo: bool = False) -> tuple[Column, Column]:
    """The permutation of Z_a x Z_b, or its inverse: one fold over the rounds."""
    state = F.struct(left.alias("l"), right.alias("r"))
    turns = F.array(*[F.lit(t) for t in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])

    def step(s: Column, t: Column) -> Column:
        sign = F.lit(-1 if undo else 1).cast(LONG)
        even = t % 2 == 0
        digest = _number(keyed(key, kind, t, F.when(even, s["r"]).otherwise(s["l"]).cast("string")))
        return F.struct(F.when(even, F.pmod(s["l"] + sign * (digest % a), F.lit(a).cast(LONG))).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * (digest % b), F.lit(b).cast(LONG))).alias("r"))

    out = F.aggregate(turns, state, step, lambda s: F.array(s["l"], s["r"]))
    return out[0], out[1]


def _shifted(half: Column, other: Column, kind: Column, key: str, turn: Column, sign: int, hexits: bool) -> Column:
    """``half`` with every character moved within its class by the digest of ``other``."""
    blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.char_length(half) / 16).cast("int")), lambda b: keyed(key, kind, F.concat_ws(".", turn.cast("string"), b.cast("string")), other)), "")

    def one(i: Column) -> Column:
        c = F.substring(half, i + 1, 1)
        shift = F.conv(F.substring(blocks, i * 4 + 1, 4), 16, 10).cast("int") * sign
        moved = c
        for chars in ((DIGITS + "abcdef", DIGITS + "ABCDEF") if hexits else (DIGITS, LOWER, UPPER)):
            at = F.instr(F.lit(chars), c)
            moved = F.when((at > 0) & moved.eqNullSafe(c), F.substring(F.lit(chars), F.pmod(at - 1 + shift, F.lit(len(chars))) + 1, F.lit(1))).otherwise(moved)
        return moved

    return F.when(half == "", half).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(half) - 1), one), ""))


def string_feistel(text: Column, kind: Column, key: str, undo: bool = False, hexits: bool = False) -> Column:
    """The permutation of strings with the same classes of characters in the same places, or its inverse."""
    cut_at = F.floor(F.char_length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), cut_at).alias("l"), F.substring(text, cut_at + 1, F.char_length(text)).alias("r"))
    turns = F.array(*[F.lit(t) for t in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])
    sign = -1 if undo else 1

    def step(s: Column, t: Column) -> Column:
        even = t % 2 == 0
        return F.struct(F.when(even, _shifted(s["l"], s["r"], kind, key, t, sign, hexits)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(_shifted(s["r"], s["l"], kind, key, t, sign, hexits)).alias("r"))

    return F.aggregate(turns, state, step, lambda s: F.concat(s["l"], s["r"]))


def _bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(form: Column, chars: Column, places: str = "[0-9]") -> Column:
    """``form`` with the characters that match ``places`` replaced, in order, by ``chars``."""
    seen = lambda i: F.char_length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), f"(?!{places})(?s:.)", ""))
    one = lambda i: F.when(F.substring(form, i + 1, F.lit(1)).rlike(f"^{places}$"), F.substring(chars, seen(i), F.lit(1))).otherwise(F.substring(form, i + 1, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(form) - 1), one), "")


def with_luhn_digit(payload: Column) -> Column:
    fits = F.filter(F.array(*[F.lit(d) for d in DIGITS]), lambda d: F.call_function("luhn_check", F.concat(payload, d)))
    return F.concat(payload, F.get(fits, 0))


def mod97(text: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10, Z is 35) as one number."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(value(c) > 9, (s * 100 + value(c)) % 97).otherwise((s * 10 + value(c)) % 97))


def _card(m: Column, key: str, undo: bool) -> Column:
    def run(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.char_length(d) - 1)
        return F.when(F.call_function("luhn_check", d), refill(m, with_luhn_digit(string_feistel(payload, F.lit("card"), key, undo))))

    return _bind(digits_of(m), run)


def _iban(m: Column, key: str, undo: bool) -> Column:
    def run(c: Column) -> Column:
        country, account = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.char_length(c))
        valid = (mod97(F.concat(account, country, F.substring(c, 3, 2))) == 1) & F.char_length(c).between(15, 34)
        made = _bind(string_feistel(account, F.lit("iban"), key, undo),
                     lambda n: F.concat(country, F.lpad((98 - mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        return F.when(valid, refill(m, made, "[0-9A-Z]"))

    return _bind(F.regexp_replace(m, " ", ""), run)


def _late_rank(date: Column) -> Column:
    """Rank of a date among the dates from ``EPOCH`` on whose day is after the 12th."""
    months = (F.year(date) - 1800) * 12 + F.month(date) - 1
    return _late_before(months) + F.dayofmonth(date) - 13


def _late_before(months: Column) -> Column:
    start = F.lit(EPOCH).cast("date")
    return F.datediff(F.add_months(start, months), start) - 12 * months


def _late_date(rank: Column) -> Column:
    """The date of a rank: the last month whose first rank is not above it, within two of the mean month length."""
    guess = F.floor(rank / 18.436875).cast("int")
    months = F.array_max(F.filter(F.sequence(guess - 2, guess + 2), lambda m: (m >= 0) & (_late_before(m) <= rank)))
    return _bind(months, lambda m: F.date_add(F.add_months(F.lit(EPOCH).cast("date"), m), (rank - _late_before(m) + 12).cast("int")))


def _date(m: Column, key: str, undo: bool) -> Column:
    """Day first where that is a date, else month first; the latter are permuted among themselves, so that the form of
    a pseudonym reads the way its value did."""
    start, dot = F.lit(EPOCH).cast("date"), F.substring(m, 3, 1)
    year, first, second = F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)
    known = lambda d: _bind(d.try_cast("date"), lambda x: F.when((x >= start) & (x < F.lit("2200-01-01").cast("date")), x))
    part = {"d": "dd", "m": "MM", "y": "yyyy"}
    written = lambda order: lambda d: F.concat(F.date_format(d, part[order[0]]), dot, F.date_format(d, part[order[1]]), dot, F.date_format(d, part[order[2]]))
    moved = lambda d: F.date_add(start, number_feistel(F.datediff(d, start).cast("long"), *DAYS, F.lit("date"), key, undo).cast("int"))
    late = lambda d: _bind(number_feistel(_late_rank(d).cast("long"), *LATE_DAYS, F.lit("date"), key, undo), _late_date)

    def slashed(d: Column) -> Column:
        return F.when(d["dmy"].isNotNull(), _bind(moved(d["dmy"]), written("dmy"))).when(d["mdy"].isNotNull(), _bind(late(d["mdy"]), written("mdy")))

    both = F.struct(known(F.concat_ws("-", year, second, first)).alias("dmy"), known(F.concat_ws("-", year, first, second)).alias("mdy"))
    return F.when(m.rlike("^[0-9]{4}-"), _bind(known(m), lambda d: F.date_format(moved(d), "yyyy-MM-dd"))).otherwise(_bind(both, slashed))


def _phone(m: Column, key: str, undo: bool) -> Column:
    """The national digits move; the country code, which ends at the first separator, stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ (-])|^\+[0-9]", 0)
    national = F.substring(m, F.char_length(code) + 1, F.char_length(m))
    valid = F.char_length(digits_of(m)).between(8, 15)
    return F.when(valid, F.concat(code, refill(national, string_feistel(digits_of(national), F.lit("phone"), key, undo))))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas, as 666 is never given, times 99 groups on the left; 9999 serials on the right
    left, right = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1
    a, b = pair_feistel(left, right, 898 * 99, 9999, F.lit("ssn"), key, undo)

    def text(p: Column) -> Column:
        rank = F.floor(p["a"] / 99)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(rank + F.when(rank >= 665, 2).otherwise(1), 3), pad(p["a"] % 99 + 1, 2), pad(p["b"] + 1, 4))

    return F.when(valid, _bind(F.struct(a.alias("a"), b.alias("b")), text))


def _ip(m: Column, key: str, undo: bool) -> Column:
    def run(o: Column) -> Column:
        octet = lambda i: F.get(o, i)
        valid = ~F.exists(o, lambda x: x > 255)
        a, b = pair_feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, F.lit("ip"), key, undo)
        text = _bind(F.struct(a.alias("a"), b.alias("b")), lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))
        return F.when(valid, text)

    return _bind(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), run)


def _email(m: Column, key: str, undo: bool) -> Column:
    top = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    rest = F.substring(m, F.lit(1), F.char_length(m) - F.char_length(top))
    return F.concat(string_feistel(rest, F.lit("email"), key, undo), top)


def kind_of(m: Column) -> Column:
    """The kind of a found value, by its form alone and in the order of ``KINDS``."""
    return (F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]{2}[0-9]{2}") & ~m.rlike("^[0-9A-F]{32,64}$"), "iban").when(m.rlike("^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), "secret")
            .when(m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date").when(m.rlike(r"^(?:\+|\(|[0-9]{3}-[0-9]{3}-)"), "phone")
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-"), "ssn").when(m.contains("."), "ip").otherwise("card"))


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a found value; null if the value is not valid for its kind."""
    kind = kind_of(m)
    made = {"email": _email(m, key, undo), "iban": _iban(m, key, undo), "secret": string_feistel(m, F.lit("secret"), key, undo, hexits=True), "date": _date(m, key, undo),
            "phone": _phone(m, key, undo), "ssn": _ssn(m, key, undo), "ip": _ip(m, key, undo), "card": _card(m, key, undo)}
    out = F.lit(None).cast("string")
    for name, value in reversed(made.items()):
        out = F.when(kind == name, value).otherwise(out)
    return out


def session_key(spark: SparkSession) -> str:
    """The key in ``KEY_SETTING``.  Where it is unset, a random one that is kept there until the session ends, so that
    pseudonyms link within the session and nobody can undo them after it."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymize(docs: DataFrame, text_col: str, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced, and a column ``__vicinity_found``: an array of (kind, pseudonym)."""
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    each = lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key, undo).alias("made"))
    out = docs.withColumn("__vicinity_values", F.when(text.rlike(POSSIBLE), F.transform(found, each)))
    # the pieces between the values, with each value's replacement after its piece
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.transform("__vicinity_values", lambda v: F.coalesce(v["made"], v["value"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size("__vicinity_values") > 0, F.array_join(pieces, "")).otherwise(text))
    kept = F.transform(F.filter("__vicinity_values", lambda v: v["made"].isNotNull()), lambda v: F.struct(v["kind"].alias("kind"), v["made"].alias("pseudonym")))
    return out.withColumn("__vicinity_found", F.coalesce(kept, F.array().cast("array<struct<kind:string,pseudonym:string>>"))).drop("__vicinity_values")


def pii_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Per document its pseudonymised text, how many values were replaced, and of which kinds; without a key, by the
    session's."""
    key = key or session_key(docs.sparkSession)
    out = pseudonymize(docs.select("doc_id", "text"), "text", key)
    kinds = F.array_join(F.array_sort(F.transform("__vicinity_found", lambda v: v["kind"])), ",")
    return out.select("doc_id", "text", F.size("__vicinity_found").cast("long").alias("n_found"), kinds.alias("kinds"))
