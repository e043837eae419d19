import pytest
from pyspark.sql import functions as F

from sparkloom.functions import casts, dates, normalize, predicates


def values(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").withColumn("y", fn(F.col("x")))
    return [r.y for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn,yes,no",
    [
        (predicates.is_pk_phone, ["03001234567", "0321-9876543", "+92 333 5551234", "00923451122334", "3001234567", "92-300-1234567"], ["12345", "02135551234", "abcde"]),
        (predicates.is_cnic, ["35201-1234567-1", "3520112345671"], ["12345-67"]),
        (predicates.is_email, ["user.name+x@mail.example"], ["not-an-email", "a@b"]),
        (predicates.is_datetime, ["2024-01-15", "15/08/1990", "2024-01-10T10:15:30", "2024-01-10T10:15:30.5Z", "1705300000", "1705300000123"], ["", "hello there", "12345", "2024-13-45"]),
        (predicates.is_clock, ["12:36:53 AM", "1:30 pm", "14:20:00", "0:45", "1h 30m", "45s", "36 mins 5 secs"], ["2024-01-15", "soon", "1/2"]),
        (predicates.is_currency, ["PKR 145,000", "$2,500.50", "Rs 95"], ["145", "Rs", "rs. 5.5.5"]),
        (predicates.is_percent, ["36%", "-1.5 %"], ["36", "%"]),
        (predicates.is_ip, ["192.168.1.10", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"], ["256.1.1.1", "::1"]),
        (predicates.is_url, ["https://x.example/a", "WWW.x.example", "ftp://hh"], ["x.example", "http:// a"]),
        (predicates.is_age, ["0", "28.0", "120"], ["121", "28.5", "-1", "x"]),
        (predicates.is_address, ["House 5, Canal Road", "12 Main Street"], ["Road", "Broadcasting tower"]),
    ],
)
def test_predicates(spark, fn, yes, no):
    assert values(spark, fn, yes + no) == [True] * len(yes) + [False] * len(no)


def test_first_kind_wins(spark):
    texts = ["03001234567", "1705300000123", "+14155550100", "0", "f", "m", "5", "-10", "-10.5", "250", "x", None, " ", "nan"]
    assert values(spark, predicates.kind, texts) == [
        "phone_pakistan", "cnic_pakistan", "phone_international", "boolean", "boolean", "gender", "age", "numeric_integer", "numeric_float", "numeric_integer", "other", None, None, None,
    ]


def test_phones(spark):
    texts = ["03001234567", "+92 300 1234567", "3001234567", "0321-9876543", "02135551234", "+92 0300 1234567", None, "nan", "", "abc"]
    assert values(spark, normalize.clean_phone, texts) == ["923001234567"] * 3 + ["923219876543", "922135551234", "92920300" + "1234567", None, None, None, None]
    assert values(spark, lambda c: normalize.clean_phone(c, "formatted"), ["03001234567", "123"]) == ["+92 300 1234567", "+92 123"]
    assert values(spark, lambda c: normalize.clean_phone(c, "03"), ["+923001234567"]) == ["03001234567"]
    assert values(spark, normalize.clean_intl_phone, ["+1 (415) 555-0100", "123"]) == ["+14155550100", None]


def test_cnic_currency_boolean(spark):
    assert values(spark, normalize.clean_cnic, ["3520112345671", "35201-1234567-1", " 12 ", "", None]) == ["35201-1234567-1"] * 2 + ["12", None, None]
    texts = ["PKR 145,000", "$2,500.50", "Rs. 95000", "PKR 1,000 - 2,000", "-$500", "1e5", "n/a", None, "free"]
    assert values(spark, normalize.clean_currency, texts) == [145000.0, 2500.5, 95000.0, 1000.0, -500.0, 1.0, None, None, None]
    assert values(spark, normalize.clean_boolean, ["Yes", " 1 ", "inactive", "F", "maybe", None]) == [True, True, False, False, None, None]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("12:36:53 AM", "0:36:53"), ("12:36:53 PM", "12:36:53"), ("01:15:30 AM", "1:15:30"), ("01:15:30 PM", "13:15:30"), ("12:00:00 AM", "0:00:00"), ("12:00:00 PM", "12:00:00"),
        ("11:59:59 PM", "23:59:59"), ("0:36:53", "0:36:53"), ("00:36:53", "0:36:53"), ("14:20:00", "14:20:00"), ("36m 53s", "0:36:53"), ("2213", "0:36:53"), ("1:75", "1:75:00"),
        ("90 mins", "1:30:00"), ("1h 30m 15s", "1:30:15"), ("2024-01-15 07:05:09", "7:05:09"), ("soon", "soon"), (None, None), ("nan", None), ("", None),
    ],
)
def test_durations(spark, text, expected):
    assert values(spark, normalize.clean_duration, [text]) == [expected]


def test_long_durations(spark):
    assert values(spark, lambda c: normalize.clean_duration(c, "HH:MM:SS"), ["12:36:53 AM", "01:15:30 AM"]) == ["00:36:53", "01:15:30"]


def test_datetimes(spark):
    texts = ["2024/01/15 10:30:00", "05/01/2024", "15/08/1990", "1705300000", "1705300000500", "2024-01-10T10:15:30+05:00", "Jan 5, 2024", "x", None]
    assert values(spark, normalize.clean_datetime, texts) == [
        "2024-01-15 10:30:00", "2024-05-01 00:00:00", "1990-08-15 00:00:00", "2024-01-15 06:26:40", "2024-01-15 06:26:40", "2024-01-10 10:15:30", "2024-01-05 00:00:00", None, None,
    ]
    assert values(spark, dates.parse_datetime, ["-10.5", "2024-01"]) == [None, None]


def test_texts(spark):
    assert values(spark, normalize.clean_text, ["  a \t b\n", "\x01", "", None, "x\x07y"]) == ["a b", None, None, None, "xy"]
    assert values(spark, lambda c: normalize.clean_text(c, "title"), ["o'neil mc-donald a1b"]) == ["O'Neil Mc-Donald A1B"]


def test_numbers(spark):
    assert values(spark, casts.number, ["1d", "inf", "NaN", " 1.5 ", ".5", "1e3", "x", None]) == [None, None, None, 1.5, 0.5, 1000.0, None, None]
    doubles = spark.createDataFrame([(1e7,), (1234567890.5,), (0.0005,), (2.0,), (None,)], "x double")
    assert [r.y for r in doubles.select(casts.text(F.col("x"), "double").alias("y")).collect()] == ["10000000.0", "1234567890.5", "0.0005", "2.0", None]


def test_dates_in_any_layout(spark):
    from sparkloom.functions.dates import parse_date_text
    from sparkloom.functions.normalize import clean_datetime

    texts = ["Tuesday, 5 March 2024 14:30", "2024.03.05", "5th of March 2024", "March 2024", "14:30", "no date 1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", clean_datetime(F.col("t"), any_layout=True).alias("d")).orderBy("i").collect()]
    assert got == ["2024-03-05 14:30:00", "2024-03-05 00:00:00", "2024-03-05 00:00:00", None, None, None, None]
    assert parse_date_text("March 2024") is None


def test_e164_needs_its_package(spark):
    import pytest

    from sparkloom.functions.normalize import e164_phone

    try:
        import phonenumbers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            e164_phone(F.lit("1"))


def test_delimiters_are_those_of_the_sniffer():
    import csv
    import random

    from sparkloom.sources.readers import _steady_delimiter

    rng = random.Random(3)
    for _ in range(3000):
        letters = rng.choices(",;\t|: ab1", k=rng.randint(1, 5))
        line = lambda: "".join(rng.choices(letters, k=rng.randint(0, 6)))
        same = line()
        text = "\n".join(same if rng.random() < 0.9 else line() for _ in range(rng.randint(0, 45)))
        try:
            want = csv.Sniffer().sniff(text, ",;\t|:").delimiter
        except csv.Error:
            want = ""
        assert _steady_delimiter(text) == want, text


def test_delimiters_are_told_fast():
    """The sniffer takes about as long for a hundred heads as this for two thousand."""
    import csv
    import time

    from sparkloom.sources.readers import sniff_delimiter

    heads = [f"a;b;c\n1;2;{k}\n" * 5 for k in range(2000)]
    began = time.process_time()
    for h in heads[:200]:
        csv.Sniffer().sniff(h, ",;\t|:")
    between = time.process_time()
    assert {sniff_delimiter(h) for h in heads[:200]} == {";"}
    assert time.process_time() - between < (between - began) / 3

def test_texts_that_are_told_from_dates_unparsed_are_none(spark):
    """What no_date() keeps from the parser the parser reads as no date; texts that it does read are passed on."""
    import random

    import pyspark.sql.functions as F

    from sparkloom.functions.dates import no_date, parse_date_text

    rng = random.Random(5)
    words = "no date of March june FRI Friday 4th 5 2021 10:30 7pm pm EST ABCDEF z Nan inf th st T ad utc 3/4/2021 12-May-2020 - , foo Sept 10h30m m hours x7 at".split()
    texts = ["".join(w + rng.choice((" ", " ", ", ", "-", "")) for w in rng.choices(words, k=rng.randint(1, 6))).strip() for _ in range(6000)]
    texts += ["March of foo 2021", "5 March 2021 10:30 EST", "no date 77", "4th of March 2021"]
    told = {r.c: r.no for r in spark.createDataFrame([(t,) for t in texts], "c string").select("c", no_date(F.col("c")).alias("no")).collect()}

    def read(text):
        try:
            return parse_date_text(text)
        except Exception:
            return None

    assert told["no date 77"] and sum(told.values()) > 1000
    assert not [t for t, no in told.items() if no and read(t) is not None]
    assert not any(told[t] for t in texts[-4:] if t != "no date 77")
