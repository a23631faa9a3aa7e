import hashlib
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from cuewright.llm import pii_feistel as pii
from tests.llm.helpers import clashing, edges, table

KEY = "k"


def scrub(spark, texts, key=KEY):
    df = pii.pseudonymise(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), key)
    return {r.doc_id: (r.pii_text, r.pii_kinds) for r in df.collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_chars(word, key, tag):
    """The character network in plain Python."""
    cut = len(word) // 2
    left, right = word[:cut], word[cut:]

    def move(part, stream):
        out = ""
        for i, c in enumerate(part):
            step = int(stream[2 * (i % 32) : 2 * (i % 32) + 2], 16)
            for base, size in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + size:
                    c = chr((ord(c) - base + step) % size + base)
                    break
            out += c
        return out

    for i in range(pii.ROUNDS):
        stream = lambda other: hashlib.sha256(f"{key}|{tag}|{len(word)}|{i}|{other}".encode()).hexdigest()  # noqa: E731,B023
        if i % 2 == 0:
            left = move(left, stream(right))
        else:
            right = move(right, stream(left))
    return left + right


def plain_pair(left, right, sizes, key, tag):
    for i in range(pii.ROUNDS):
        f = lambda other: int(hashlib.sha256(f"{key}|{tag}|{i}|{other}".encode()).hexdigest()[:12], 16)  # noqa: E731,B023
        if i % 2 == 0:
            left = (left + f(right)) % sizes[0]
        else:
            right = (right + f(left)) % sizes[1]
    return left, right


def test_formats_and_checks(spark):
    texts = [
        "card 4111 1111 1111 1111, or 4111-1111-1111-1111 and 4111111111111111; not 4111111111111112",
        "born 1984-02-29, 29.02.1984, 01/12/2020; never 1985-02-29 or 31.04.2020",
        "from 10.0.0.1 and 10.0.0.1 but not 10.0.0.256 or 1.2.3.4.5",
        "call +1 (217) 555-0100 or +49 30 1234567",
        "ssn 123-45-6789, not 000-12-3456 or 666-12-3456",
        "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88 3704 0044 0532 0130 00",
        "mail Jo.Doe7@mail.example.com twice: Jo.Doe7@mail.example.com",
        "plain 12 345, version 4.0, 2024 and 3.14",
    ]
    out = scrub(spark, texts)
    text, kinds = out[0]
    cards = re.findall(r"\d(?:[ -]?\d){15}", text)
    assert kinds == ["card"] * 3 and cards[3] == "4111111111111112"
    plain = [re.sub(r"\D", "", c) for c in cards]
    assert plain[0] == plain[1] == plain[2] != "4111111111111111" and luhn(plain[0])
    assert cards[0][4::5] == "   " and cards[1][4::5] == "---"
    payload = plain_chars("411111111111111", KEY, "card")
    assert plain[0][:-1] == payload
    text, kinds = out[1]
    assert kinds == ["date"] * 3 and "1985-02-29" in text and "31.04.2020" in text
    iso, german = re.search(r"born (\S+), (\S+),", text).groups()
    n = (date(1984, 2, 29) - date(1800, 1, 1)).days
    day, place = plain_pair(n // 773, n % 773, pii.DAY_HALVES, KEY, "date")
    assert iso == (date(1800, 1, 1) + timedelta(day * 773 + place)).isoformat()
    assert german == ".".join(reversed(iso.split("-")))
    text, kinds = out[2]
    a, b = re.search(r"from (\S+) and (\S+) but", text).groups()
    assert a == b != "10.0.0.1" and kinds == ["ipv4"] * 2 and "10.0.0.256" in text and "1.2.3.4.5" in text
    left, right = plain_pair(10 * 256, 1, (65536, 65536), KEY, "ipv4")
    assert a == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    text, kinds = out[3]
    assert kinds == ["phone"] * 2 and re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+49 \d\d \d{7}$", text) and "555-0100" not in text
    text, kinds = out[4]
    assert kinds == ["ssn"] and "000-12-3456" in text and "666-12-3456" in text and "123-45-6789" not in text
    text, kinds = out[5]
    assert kinds == ["iban"] * 2 and "DE88 3704 0044 0532 0130 00" in text
    for found in re.findall(r"[A-Z]{2}\d\d[A-Z0-9 ]{12,}\d(?= and|,)", text)[:2]:
        packed = found.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    text, kinds = out[6]
    first, second = re.findall(r"(\S+)@mail\.example\.com", text)
    assert first == second and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d", first) and first != "Jo.Doe7"
    assert out[7] == (texts[7], [])


def test_networks_permute(spark):
    numbers = spark.range(1000).select(F.format_string("%03d", "id").alias("w"))
    assert numbers.select(pii.permute_chars(F.col("w"), KEY, F.lit("t")).alias("p")).distinct().count() == 1000
    pairs = spark.range(7 * 11).select(F.floor(F.col("id") / 11).alias("l"), (F.col("id") % 11).alias("r"))
    assert pairs.select(pii.permute_pair(F.col("l"), F.col("r"), (7, 11), KEY, "t").alias("p")).distinct().count() == 77
    areas = spark.range(0, 898 * 99 * 9999, 9_999_999).select(
        F.floor(F.col("id") / (99 * 9999)).alias("a"), F.floor(F.col("id") / 9999 % 99).alias("g"), (F.col("id") % 9999).alias("s")
    )
    area = F.when(F.col("a") >= 665, F.col("a") + 2).otherwise(F.col("a") + 1)
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.col("g") + 1).cast("string"), 2, "0"), F.lpad((F.col("s") + 1).cast("string"), 4, "0"))
    made = areas.select(pii._ssn(ssn, KEY).alias("p"))
    assert made.distinct().count() == areas.count()
    assert made.where(~F.col("p").rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")).count() == 0


def test_key_matters_and_edges(spark):
    card = "x 4111111111111111 y"
    assert scrub(spark, [card])[0] != scrub(spark, [card], "other")[0]
    df = clashing(edges(spark), "kind", "pii")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == [*df.columns, "pii_text", "pii_kinds"] and out.count() == 11
    for r in out.collect():
        assert r.pii_text == (r.text or "") and r.pii_kinds == []
    assert pii.pseudonymise(table(spark, []), KEY).count() == 0


def test_values_inside_and_behind_failing_candidates(spark):
    texts = {
        "+1 (826) 555-4081 190.137.223.9": ["phone", "ipv4"],
        "+44 20 7946 0958 190.137.223.9": ["phone", "ipv4"],
        "+49 30 1234567 4111 1111 1111 1111": ["phone", "card"],
        "4111 1111 1111 1111 123": ["card"],
        "4111 1111 1111 1111 12/27": ["card"],
        "10 4111111111111111": ["card"],
        "BE68 5390 0754 7034 250 EUR": ["iban"],
        "+1 (487) 555-7209 12": ["phone"],
        "2020-02-03T10:11:12 and 2020-02-03": ["date", "date"],
        "2020-02-03 10.0.0.1 123-45-6789 a.b@example.com 01.02.2020": ["date", "ipv4", "ssn", "email", "date"],
        "4111 1111 1111 1111 5500 0000 0000 0004 +1 (217) 555-0100 DE89 3704 0044 0532 0130 00": ["card", "card", "phone", "iban"],
        "+49 30 1234567.user@example.com": ["phone", "email"],
    }
    out = scrub(spark, list(texts))
    assert {t: out[i][1] for i, t in enumerate(texts)} == texts
    alone = scrub(spark, ["+1 (826) 555-4081", "190.137.223.9", "4111 1111 1111 1111", "BE68 5390 0754 7034", "+1 (487) 555-7209", "2020-02-03"])
    phone, address, card, iban, phone2, day = (alone[i][0] for i in range(6))
    got = [out[i][0] for i in range(len(texts))]
    assert got[0] == f"{phone} {address}" and got[3] == f"{card} 123" and got[4] == f"{card} 12/27"
    assert got[5] == "10 " + card.replace(" ", "") and got[6] == f"{iban} 250 EUR" and got[7] == f"{phone2} 12"
    assert got[8] == f"{day}T10:11:12 and {day}"
