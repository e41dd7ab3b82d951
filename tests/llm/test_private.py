"""Pseudonyms: permutations, formats, linkage, and what is left alone."""

import datetime
import random
import re

import pytest

from corpuscat.llm.private import cover, cover_documents, permute, permute_text, pseudonym

KEY = b"a test key"
SCHEMA = "doc_id bigint, text string, kinds string"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_permute_is_one_to_one(n):
    assert sorted(permute(x, n, KEY, "t") for x in range(n)) == list(range(n))
    assert n < 97 or [permute(x, n, KEY, "t") for x in range(n)] != [permute(x, n, b"other", "t") for x in range(n)]


def test_text_keeps_its_layout():
    rng = random.Random(1)
    seen = {}
    for _ in range(2_000):
        v = "".join(rng.choice("aZ3") + rng.choice("09xY.") for _ in range(3))
        new = permute_text(v, KEY, "t")
        shape = [re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))) for x in (v, new)]
        assert shape[0] == shape[1] and seen.setdefault(new, v) == v


VALUES = {
    "card": ["4465758382889437", "4465-7583-8288-9437", "378282246310005"],
    "ip": ["227.5.221.1", "10.0.0.255"],
    "date": ["1990-02-28", "28.02.1990", "02/28/1990", "2000/1/2"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "phone": ["+1 (521) 555-2373", "(521) 555-2373", "+49 30 1234567", "415-555-1234"],
    "email": ["bosbt.42@mail8.example.com", "A.b+c@x-y.org"],
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_each_kind(kind):
    for v in VALUES[kind]:
        text, kinds = cover(f"Say {v}, then ({v}) and {v}.", KEY)
        new = pseudonym(kind, v, KEY)
        assert kinds == [kind] * 3 and v not in text and text == f"Say {new}, then ({new}) and {new}."
        assert pseudonym(kind, new, KEY) is not None and cover(f"x {new} y", KEY)[1] == [kind]
        if kind not in ("ip", "date"):
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new)))
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new))


def test_equal_values_stay_linked_whatever_their_separators():
    bare, dashed = (re.sub(r"\D", "", pseudonym("card", v, KEY)) for v in VALUES["card"][:2])
    assert bare == dashed
    a, b = (pseudonym("date", v, KEY) for v in VALUES["date"][:2])
    assert datetime.datetime.strptime(a, "%Y-%m-%d") == datetime.datetime.strptime(b, "%d.%m.%Y")
    assert len({pseudonym("ssn", f"123-45-{k:04d}", KEY) for k in range(1, 500)}) == 499


@pytest.mark.parametrize("text", ["", "Plain words only.", "Version 4.0.0, 3.14 and 1,000,000", "4465758382889438 fails its check", "999.1.1.1 or 256.2.3.4", "31.02.1990", "000-12-3456",
                                  'token = "f33e61083db5dbdf4bd236990f7bab1f2223b6a1"', "room 12-34, p. 5-6", "2024", "a@b", "DE89370400440532013001"])
def test_clean_texts_stay(text):
    assert cover(text, KEY) == (text, [])


IBANS = ["ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "SE4550000000058398257466", "CZ6508000000192000145399", "PL61109010140000071219812874", "NO9386011117947", "PL61 1090 1014 0000 0712 1981 2874"]


@pytest.mark.parametrize("kind,value", [("iban", v) for v in IBANS] + [(k, v) for k, vs in VALUES.items() for v in vs])
@pytest.mark.parametrize("after", ["EUR", "I paid", "PAID NOW", "A1", "BIC ABCD 2024 X"])
def test_followed_by_capital_words(kind, value, after):
    text, kinds = cover(f"To {value} {after}", KEY)
    assert kinds == [kind] and text == f"To {pseudonym(kind, value, KEY)} {after}"


@pytest.mark.parametrize("phone", ["415 555 1234", "1 415 555 1234", "030 1234567", "0151 23456789", "020 7946 0958", "030/1234567", "01 23 45 67 89", "01.23.45.67.89"])
def test_phones_of_a_country(phone):
    text, kinds = cover(f"Call {phone} NOW or {phone}.", KEY)
    assert kinds == ["phone"] * 2 and phone not in text and cover(text, KEY)[0].startswith("Call ")


@pytest.mark.parametrize("before,after", [("-", ""), (".", ""), ("_", "_"), ("+", "-"), ("--", " -"), ("- ", "-x")])
def test_addresses_beside_punctuation(before, after):
    text, kinds = cover(f"{before}a.b@c.example.com{after}", KEY)
    assert kinds == ["email"] and text == before + pseudonym("email", "a.b@c.example.com", KEY) + after


@pytest.mark.parametrize("shape", ["{m:02}/{d:02}/{y}", "{d:02}/{m:02}/{y}", "{d:02}.{m:02}.{y}", "{m:02}.{d:02}.{y}", "{y}-{m:02}-{d:02}"])
def test_dates_are_one_to_one_in_each_order(shape):
    """Two hundred years: as many pseudonyms as strings, each a date of its order that decodes."""
    strings = set()
    day = datetime.date(1900, 1, 1)
    while day.year < 2100:
        strings.add(shape.format(y=day.year, m=day.month, d=day.day))
        day += datetime.timedelta(days=1)
    new = {v: pseudonym("date", v, KEY) for v in strings}
    assert len(set(new.values())) == len(strings)
    for v in random.Random(2).sample(sorted(strings), 300):
        assert pseudonym("date", new[v], KEY, back=True) == v and cover(f"on {new[v]} x", KEY)[1] == ["date"]


def test_both_slash_orders_together():
    month_first = {f"{m:02}/{d:02}/{y}" for y in range(1950, 1990) for m in range(1, 13) for d in range(1, 29)}
    day_first = {f"{d:02}/{m:02}/{y}" for y in range(1950, 1990) for m in range(1, 13) for d in range(13, 29)}
    both = month_first | day_first
    assert len({pseudonym("date", v, KEY) for v in both}) == len(both)


PHONES = ["030 1234567", "01 23 45 67 89", "+4915123456789", "+49 151 23456789", "415-555-1234", "415 555 1234", "1 415 555 1234", "+1 (521) 555-2373", "(0521) 555-2373", "+351 912 345 678", "+81 90 1234 5678"]


@pytest.mark.parametrize("kind,value", [("phone", v) for v in PHONES] + [(k, v) for k, vs in VALUES.items() for v in vs])
def test_found_again_and_decoded(kind, value):
    """A decoder that knows the format alone: what is kept is kept, what comes out is found as its kind and undone."""
    new, kinds = cover(f"see {value} today", KEY)
    new = new[4:-6]
    assert kinds == [kind] and new != value and cover(f"see {new} today", KEY)[1] == [kind]
    back = pseudonym(kind, new, KEY, back=True)
    if kind == "date":  # noughts before a number may differ
        back, value = ([int(x) for x in re.split(r"\D", v)] for v in (back, value))
    assert back == value
    if kind == "phone":
        code = re.match(r"\+49|\+351|\+81|\+1|0|1 |\(0|", value)[0]
        assert new.startswith(code) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", value)


def test_phones_are_one_to_one():
    for shape in ("030 {:07}", "+49{:011}", "415-{:03}-0000"):
        strings = [shape.format(k) for k in range(200, 900)]
        assert len({pseudonym("phone", v, KEY) for v in strings}) == len(strings)


def test_timestamps_and_order_numbers():
    assert cover("1990-02-28T10:00:00Z", KEY) == (pseudonym("date", "1990-02-28", KEY) + "T10:00:00Z", ["date"])
    for text in ("12-05-2020-77", "order 3/05/2020/771", "1990-02-28Z"):
        assert cover(text, KEY) == (text, [])


def test_two_cards_side_by_side():
    text, kinds = cover("4465758382889437 4465758382889437 x", KEY)
    assert kinds == ["card", "card"] and len(set(text.split()[:2])) == 1


def test_documents(spark):
    rows = [(1, "mail a.b@c.example.com", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing", "k"), (4, "nothing", "k"), (None, "ip 10.1.2.3", "k"), (5, "w " * 100_000 + "4465758382889437", "k")]
    got = cover_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), KEY).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] is None and by[2]["n_private"] == 0 and by[4]["text"] == "nothing" and by[3]["text"] == ""
    assert by[1]["kinds"] == ["email"] and by[None]["kinds"] == ["ip"] and by[5]["kinds"] == ["card"]
    assert cover_documents(spark.createDataFrame([], SCHEMA), KEY).count() == 0


def test_no_planted_value_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pattern = r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b"
    before = {v for r in docs.collect() for v in re.findall(pattern, r["text"] or "") if len(v) != 16 or not v.isdigit() or luhn(v)}
    after = "\n".join(r["text"] for r in cover_documents(docs, KEY).collect())
    assert len(before) > 30 and not [v for v in before if v in after]
