"""Pseudonyms: validity, linkage, reversal, and an independent reading of one network."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vicinity.llm import pii

KEY = "a key for tests"


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def card(seed):
    p = "".join(random.Random(seed).choice("0123456789") for _ in range(15))
    return next(p + d for d in "0123456789" if luhn(p + d))


def feistel_text(s, kind, classes=("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    """A plain reading of the network over strings."""
    half = len(s) // 2
    left, right = s[:half], s[half:]
    for t in range(8):
        part, other = (left, right) if t % 2 == 0 else (right, left)
        stream = "".join(hashlib.sha256(f"{KEY}|{kind}|{t}.{b}|{other}".encode()).hexdigest() for b in range(len(part) // 16 + 1))
        moved = []
        for i, c in enumerate(part):
            cls = next((x for x in classes if c in x), None)
            moved.append(cls[(cls.index(c) + int(stream[4 * i: 4 * i + 4], 16)) % len(cls)] if cls else c)
        left, right = ("".join(moved), right) if t % 2 == 0 else (left, "".join(moved))
    return left + right


def feistel_pair(left, right, a, b, kind):
    """A plain reading of the network over Z_a x Z_b."""
    for t in range(8):
        d = int(hashlib.sha256(f"{KEY}|{kind}|{t}|{right if t % 2 == 0 else left}".encode()).hexdigest()[:12], 16)
        left, right = ((left + d) % a, right) if t % 2 == 0 else (left, (right + d) % b)
    return left, right


def filled(form, chars, cls):
    it = iter(chars)
    return re.sub(cls, lambda _: next(it), form)


def plain_date(v):
    first = datetime.date(1800, 1, 1)
    iso = re.fullmatch("([0-9]{4})-([0-9]{2})-([0-9]{2})", v)
    if not iso:
        x, dot, y, _, year = re.fullmatch("(..)(.)(..)(.)(....)", v).groups()
        try:
            day, late = datetime.date(int(year), int(y), int(x)), False
        except ValueError:
            day, late = datetime.date(int(year), int(x), int(y)), True
    else:
        day, late = datetime.date(*map(int, iso.groups())), False
    if late:
        days = [d for n in range(189 * 773) if (d := first + datetime.timedelta(n)).day > 12]
        assert len(days) == 9 * 9833
        l, r = feistel_pair(*divmod(days.index(day), 9833), 9, 9833, "date")
        return days[l * 9833 + r].strftime(f"%m{dot}%d{dot}%Y")
    l, r = feistel_pair(*divmod((day - first).days, 773), 189, 773, "date")
    made = first + datetime.timedelta(l * 773 + r)
    return made.isoformat() if iso else made.strftime(f"%d{dot}%m{dot}%Y")


def plain_pseudonym(kind, v):
    """Each kind's pseudonym, read from the module's docstring and done in plain Python."""
    if kind == "email":
        name, top = v.rsplit(".", 1)
        return feistel_text(name, "email") + "." + top
    if kind == "secret":
        return v[0] + feistel_text(v[1:-1], "secret", ("0123456789abcdef", "0123456789ABCDEF")) + v[-1]
    if kind == "iban":
        c = v.replace(" ", "")
        n = feistel_text(c[4:], "iban")
        check = 98 - int("".join(str(int(x, 36)) for x in n + c[:2] + "00")) % 97
        return filled(v, f"{c[:2]}{check:02d}{n}", "[0-9A-Z]")
    if kind == "date":
        return plain_date(v)
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}(?=[ (-])|\+[0-9]|", v).group()
        rest = v[len(code):]
        return code + filled(rest, feistel_text(re.sub("[^0-9]", "", rest), "phone"), "[0-9]")
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        a, g, n = map(int, v.split("-"))
        l, r = feistel_pair(areas.index(a) * 99 + g - 1, n - 1, 898 * 99, 9999, "ssn")
        return f"{areas[l // 99]:03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if kind == "ip":
        o = list(map(int, v.split(".")))
        l, r = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return ".".join(map(str, (*divmod(l, 256), *divmod(r, 256))))
    d = re.sub("[^0-9]", "", v)
    payload = feistel_text(d[:-1], "card")
    return filled(v, next(payload + x for x in "0123456789" if luhn(payload + x)), "[0-9]")


def run(docs_of, texts, undo=False):
    out = pii.pseudonymize(docs_of(list(enumerate(texts)), extra=True), "text", KEY, undo).orderBy("doc_id").collect()
    return [r["text"] for r in out], [[f["kind"] for f in r["__vicinity_found"]] for r in out]


def test_cards_match_an_independent_network(spark, docs_of):
    cards = [card(i) for i in range(30)]
    made, kinds = run(docs_of, [f"pay {c}!!" for c in cards])
    for c, m in zip(cards, made):
        d = m[4:-2]
        payload = feistel_text(c[:-1], "card")
        assert d[:-1] == payload and luhn(d) and d != c
    assert all(k == ["card"] for k in kinds)


VALUES = {
    "email": ["und.34@mail7.example.com", "a.b+c_d@x-y.co.uk", "A1@B2.org"], "phone": ["+1 (017) 555-7713", "+1-212-555-0199", "(212) 555-0199", "212-555-0199", "+49 30 1234567"],
    "ip": ["233.254.104.120", "0.0.0.0", "255.255.255.255"], "ssn": ["123-45-6789", "899-99-9999", "667-01-0001"], "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "date": ["2024-02-29", "31.12.1999", "01/02/2003", "12/31/1999"], "secret": ['"04dbebab91ab85687d33eeaaf9ac699e1188f962"'], "card": ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005"],
}


def test_every_kind_keeps_its_form_and_can_be_undone(spark, docs_of):
    texts = [f"start {v} and {v}, end" for vs in VALUES.values() for v in vs]
    made, kinds = run(docs_of, texts)
    want = [[k, k] for k, vs in VALUES.items() for _ in vs]
    assert kinds == want
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for t, m, k in zip(texts, made, kinds):
        assert m != t or k[0] == "ip"
        if k[0] not in ("ip", "iban", "secret"):
            assert shape(m) == shape(t)
        first, second = re.fullmatch(r"start (.*) and (.*), end", m).groups()
        assert first == second
    assert run(docs_of, made, undo=True)[0] == texts


def test_every_kind_matches_an_independent_network(spark, docs_of):
    pairs = [(k, v) for k, vs in VALUES.items() for v in vs]
    made, _ = run(docs_of, [f"see {v} here" for _, v in pairs])
    assert made == [f"see {plain_pseudonym(k, v)} here" for k, v in pairs]


@pytest.mark.parametrize("text", [
    "me@" + "ab." * 200_000 + "com", "x" * 1_000_000, "@" * 100_000, "a@" * 100_000, "1-" * 100_000, "A1 " * 100_000, "+1 " * 100_000, "a.b@c" * 50_000, "1.2." * 100_000, "0" * 500_000],
    ids=["labels", "word", "ats", "a@", "1-", "A1", "+1", "a.b@c", "dots", "zeros"])
def test_long_unbroken_texts_end(spark, docs_of, text):
    made, kinds = run(docs_of, [text])
    assert len(made[0]) == len(text) and set(kinds[0]) <= {"email"}


def test_host_names_count_up_to_127_labels(spark, docs_of):
    whole, long = "me@" + "ab." * 126 + "com", "me@" + "ab." * 300 + "com"
    made, kinds = run(docs_of, [whole, long])
    assert kinds == [["email"], ["email"]] and made[0].endswith(".com") and made[1].endswith("ab." * 170 + "com") and not made[1].startswith("me@")


def test_the_key_is_the_sessions_or_random(spark, docs_of):
    spark.conf.unset(pii.KEY_SETTING)
    try:
        df = docs_of([(1, "mail a.person@example.org")])
        one, two = (pii.pii_report(df).head()["text"] for _ in range(2))
        spark.conf.set(pii.KEY_SETTING, "another")
        other = pii.pii_report(df).head()["text"]
        assert one == two and one != other and other == pii.pii_report(df, "another").head()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_equal_values_link_across_forms(spark, docs_of):
    made, _ = run(docs_of, ["4111 1111 1111 1111", "4111111111111111", "+1 (212) 555-0199", "(212) 555-0199", "2001-12-31", "31.12.2001"])
    digits = [re.sub("[^0-9]", "", m) for m in made]
    assert digits[0] == digits[1] and digits[2] == "1" + digits[3]
    y, m, d = made[4].split("-")
    assert made[5] == f"{d}.{m}.{y}"


def test_invalid_and_other_numbers_stay(spark, docs_of):
    texts = [None, "", "no digits", "4111111111111112", "300.1.1.1", "1.2.3", "version 1.2.3.4.5", "000-12-3456", "666-12-3456", "2023-02-30", "31/31/2000", "DE89370400440532013001", "x4111111111111111", "41111111111111111111",
             "3.14 and 2,000 and 12:30", "a@b", '"04dbebab91"', "2300-01-01", "99 " * 20000]
    made, kinds = run(docs_of, texts)
    assert made == texts and not any(kinds)


def test_neighbours_do_not_swallow_each_other(spark, docs_of):
    a, b = card(1), card(2)
    made, kinds = run(docs_of, [f"{a} {b}", f"{a}\n{a[:-1]}{(int(a[-1]) + 1) % 10}", f"mail x@y.com,z@y.com;1.2.3.4 {a}"])
    assert kinds == [["card", "card"], ["card"], ["email", "email", "ip", "card"]]
    assert made[0].split(" ")[0] == made[1].split("\n")[0] == made[2].split(" ")[2]


def test_networks_are_permutations(spark):
    got = [r[0] for r in spark.range(21 * 13).select(pii.number_feistel(F.col("id"), 21, 13, F.lit("k"), "key")).collect()]
    assert sorted(got) == list(range(21 * 13)) and got != sorted(got)
    late = spark.range(9 * 9833).where("id % 97 = 0 or id < 50 or id > 88440").select("id", pii._late_rank(pii._late_date(F.col("id").cast("int"))).alias("r"))
    assert late.where("id <> r").count() == 0


def test_report_repeats_and_empty(spark, docs_of):
    got = pii.pii_report(docs_of([(1, f"{card(3)} x@y.com"), (1, f"{card(3)} x@y.com"), (2, None)]), KEY).collect()
    assert sorted((r["doc_id"], r["n_found"], r["kinds"]) for r in got) == [(1, 2, "card,email"), (1, 2, "card,email"), (2, 0, "")]
    assert pii.pii_report(docs_of([]), KEY).count() == 0
