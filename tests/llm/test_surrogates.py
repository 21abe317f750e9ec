"""Surrogates: kinds, check digits, coreference, distinctness, awkward texts."""

import re

import pytest
from pyspark.sql import functions as F

from strandbook.llm import surrogates

KEY = "a key of the tests"
SCHEMA = "doc_id long, text string"


def replaced(spark, texts, key=KEY):
    rows = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), SCHEMA), key).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)], [r.found for r in sorted(rows, key=lambda r: r.doc_id)]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def mod97(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def test_kinds_and_formats(spark):
    texts = [
        "Mail ann@x.org or ANN@x.org, call +1 202-555-0100; Mrs Ada Byron.",
        "ann@x.org and bob@y.net at 10.1.2.3, Mrs Ada Byron",
        None,
        "",
        "nothing here, not even 12:30 or std::add",
        "card 4111 1111 1111 1111 but order 1234567890123 and 4111111111111112",
        "IBAN GB82 WEST 1234 5698 7654 32, not GB00 WEST 1234 5698 7654 32",
        "v6 2001:db8::1 and fe80:0:0:0:1:2:3:4",
        "ssn 078-05-1120, born on 1990-02-28, DOB: 31.12.1975",
        'token = "' + "0af3" * 10 + '"',
    ]
    got, found = replaced(spark, texts)
    assert got[2:5] == texts[2:5] and found[2] == found[3] == found[4] == []
    assert "ann@" not in got[0].lower() and "Ada" not in got[0] and "10.1.2.3" not in got[1]
    first = got[1].split()[0]
    assert first in got[0] and first != got[1].split()[2] and re.fullmatch(r"[a-z]{3}@[a-z]\.org", first)
    assert got[0].split("Mrs ")[1].rstrip(".") == got[1].split("Mrs ")[1]
    assert re.search(r"call \+1 \d{3}-\d{3}-\d{4};", got[0])
    assert found[5] == ["card"] and "order 1234567890123 and 4111111111111112" in got[5]
    card = re.match(r"card (\d{4} \d{4} \d{4} \d{4}) but", got[5])[1]
    assert card != "4111 1111 1111 1111" and luhn(card) and card[0] == "4"
    assert found[6] == ["iban"] and got[6].endswith("not GB00 WEST 1234 5698 7654 32")
    iban = re.match(r"IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d),", got[6])[1]
    assert iban != "GB82 WEST 1234 5698 7654 32" and mod97(iban)
    assert found[7] == ["ipv6", "ipv6"] and re.fullmatch(r"v6 [0-9a-f]{4}:[0-9a-f]{4}::[0-9a-f]{4} and (?:[0-9a-f]{4}:){7}[0-9a-f]{4}", got[7])
    assert found[8] == ["ssn", "birth_date", "birth_date"] and re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}, born on \d{4}-\d\d-\d\d, DOB: \d\d\.\d\d\.\d{4}", got[8])
    assert "1990-02-28" not in got[8] and "31.12.1975" not in got[8]
    assert found[9] == ["secret"] and re.fullmatch(r'token = "[0-9a-f]{40}"', got[9])
    assert replaced(spark, texts)[0] == got and replaced(spark, texts, "another")[0] != got


def test_names(spark):
    texts = [
        "Mr Juan Carlos García met Mrs A. B. Jones. García left; GARCÍA came back, garcía did not.",
        "My name is Ada Byron. Contact Ada Byron, Dr Ludwig van Beethoven or Dr. Byron.",
        "Dear Customer, contact us. Prof Ada Byron",
        "г-жа Анна Иванова и г-н Пётр Петров",
        "Byron without a title in this document stays",
    ]
    got, found = replaced(spark, texts)
    assert not re.search("Juan|Carlos|García|GARCÍA|Jones", got[0]) and "garcía did not" in got[0]
    assert re.match(r"Mr \w+ \w+ (\w+) met Mrs [A-Z]\. [A-Z]\. \w+\. \1 left; ", got[0])
    family = re.match(r"Mr \w+ \w+ (\w+)", got[0])[1]
    assert family.upper() in got[0]
    assert "Byron" not in got[1] and "Beethoven" not in got[1] and " van " in got[1]
    m = re.match(r"My name is (\w+) (\w+)\. Contact (\w+) (\w+), Dr \w+ van \w+ or Dr\. (\w+)\.", got[1])
    assert m[1] == m[3] and m[2] == m[4] == m[5]
    assert got[2].startswith("Dear Customer, contact us. Prof ") and got[2].split()[-1] == m[2]
    w = got[3].split()
    assert w[1].endswith("на") and w[2].endswith("ова") and w[5].endswith("н") and w[6].endswith("ов") and all(re.fullmatch(r"[А-Я][а-я]+", x) for x in (w[1], w[2], w[5], w[6]))
    assert got[4] == texts[4] and found[4] == []


def test_many_labels_and_long_texts_do_not_recurse(spark):
    n = 100_000
    texts = [
        "mail a@b" + ".b" * n + ".com end",
        "x." * n + " and a.b@c.org",
        "1-" * n, "+1 " + "2 " * n, "GB82" + " AAAA" * n, ":" * n, "1:" * n, "Mr " + "A. " * n, "Mr " + "Abc " * 2000, "4" * n, "f" * n, "Contact " * 2000, "é" * n + "@", "((" * n,
    ]
    got, found = replaced(spark, texts)
    assert found[0] == ["email"] and got[0].startswith("mail ") and got[0].endswith(".com end") and "a@b" not in got[0]
    assert found[1] == ["email"] and "a.b@c.org" not in got[1]
    assert found[10] == ["secret"] and len(got[10]) == n


def test_distinct_entities_stay_distinct(spark):
    # one-letter local parts and one-letter hosts have few values, so most first surrogates collide
    mails = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    phones = [f"+49 {i}{i % 10} {i % 7}" for i in range(10, 60)]
    names = [f"Mr {''.join(chr(97 + (i // 26**k) % 26) for k in range(3)).capitalize()}" for i in range(0, 3000, 7)]
    texts = mails + phones + names
    got, _ = replaced(spark, texts)
    assert len(set(got)) == len(set(texts)) and not set(got) & set(texts)
    twice, _ = replaced(spark, texts + texts[::-1])
    assert twice[: len(texts)] == twice[len(texts) :][::-1] == got


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 5), (1, "a@b.org", 5), (None, "a@b.org", 6), (2, None, None)], "doc_id long, text string, v long")
    docs = docs.withColumns({c: F.lit("kept") for c in ("row", "salts", "names", "pattern", "made", "unit", "__v", "__salts")}).withColumn("found", F.lit(0))
    out = surrogates.replace(docs, KEY)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 4 and len({r.text for r in rows}) == 2 and all(r.row == r.salts == r.names == r.pattern == r.made == r.unit == "kept" for r in rows)
    assert sorted((r.v or 0) for r in rows) == [0, 5, 5, 6]
    assert surrogates.replace(docs.limit(0), KEY).count() == 0
    assert surrogates.drawn_key(spark) != surrogates.drawn_key(spark)
    spark.conf.set(surrogates.KEY_SETTING, "k")
    try:
        assert surrogates.drawn_key(spark) == "k"
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)


@pytest.mark.parametrize("salt", [0, 5])
def test_hmac_equals_the_library(spark, salt):
    import hashlib
    import hmac

    got = spark.range(1).select(surrogates.digest(F.lit("email:é@x"), F.lit(salt), KEY)).first()[0]
    want = [hmac.new(KEY.encode(), m.encode(), hashlib.sha256).hexdigest() for m in (f"email:é@x|{salt}", f"email:é@x|{salt}|more")]
    assert got == "".join(want)
