"""Format-preserving pseudonyms for validated personal numbers, dates and addresses, by keyed Feistel networks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import packed, whole_text

ROUNDS = 8
EPOCH = "1800-01-01"
#: Days of one Gregorian cycle, 1800 to 2199: 189 * 773, the two halves of the date network.
DAY_HALVES = (189, 773)

#: Candidate shapes. A place may have several candidates, of several kinds and lengths; validation decides among them.
LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|(?<=\d)(?!\d))[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}\b"
#: A date ends at a word's edge or before the T of a time.
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}(?:\b|(?=[Tt]))"
DAY_DATE = r"\b\d{2}([./])\d{2}\%d\d{4}(?:\b|(?=[Tt]))"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
#: Characters that show every candidate of a place but an address, the value behind it, and what must not follow either.
WINDOW = 100
#: The start of any candidate, as an empty match; group 1 an e-mail address, the last one the window.
PLACE = rf"(?=({EMAIL})|{IBAN}|{PHONE}|{ISO_DATE}|{DAY_DATE % 2}|{IPV4}|{SSN}|{CARD})(?=([\s\S]{{1,{WINDOW}}}))"
PLACE_WINDOW = 3


def _number(col: Column) -> Column:
    return col.cast("long")


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9]", "")


def _keyed(key: str, *parts: Column) -> Column:
    """SHA-256 of key and parts in hex: the round function."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tag: str) -> Column:
    """A keyed permutation of Z_a x Z_b as struct (l, r): each round adds a keyed hash of one half to the other."""
    a, b = sizes

    def turn(state: Column, i: Column) -> Column:
        l2 = F.when(
            i % 2 == 0, (state["l"] + _number(F.conv(F.substring(_keyed(key, F.lit(tag), i, state["r"]), 1, 12), 16, 10))) % a
        ).otherwise(state["l"])
        r2 = F.when(
            i % 2 == 1, (state["r"] + _number(F.conv(F.substring(_keyed(key, F.lit(tag), i, state["l"]), 1, 12), 16, 10))) % b
        ).otherwise(state["r"])
        return F.struct(l2.alias("l"), r2.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(chars: Column, stream: Column) -> Column:
    """Add the key stream (hex, two digits a character, repeating) to each character inside its own alphabet."""

    def one(c: Column, i: Column) -> Column:
        step = _number(F.conv(F.substring(stream, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10))
        moved = lambda base, size: F.char((F.ascii(c) - base + step) % size + base)
        return (
            F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)
        )

    return F.transform(chars, one)


def permute_chars(word: Column, key: str, tag: Column) -> Column:
    """A keyed permutation of strings that keeps length and the alphabet of every character (digit, a-z, A-Z, other)."""
    cut = F.floor(F.char_length(word) / 2).cast("int")
    halves = F.struct(
        F.substring(word, F.lit(1), cut).alias("l"), F.substring(word, cut + 1, F.char_length(word).cast("int")).alias("r")
    )

    def turn(state: Column, i: Column) -> Column:
        moved = lambda part, other: F.array_join(_shifted(F.split(part, ""), _keyed(key, tag, F.char_length(word), i, other)), "")
        l2 = F.when(i % 2 == 0, moved(state["l"], state["r"])).otherwise(state["l"])
        r2 = F.when(i % 2 == 1, moved(state["r"], state["l"])).otherwise(state["r"])
        return F.struct(l2.alias("l"), r2.alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn)
    return F.concat(done["l"], done["r"])


def reformat(shape: Column, payload: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``payload``."""

    def step(state: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(state["o"], F.when(digit, F.substring(payload, state["i"], F.lit(1))).otherwise(c)).alias("o"),
            (state["i"] + F.when(digit, F.lit(1)).otherwise(F.lit(0))).alias("i"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")), step)["o"]


def luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn sum; the rightmost digit has place ``from_right`` (0: not doubled)."""
    placed = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when((i + from_right) % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(placed, F.lit(0), lambda a, x: a + x)


def mod97(alnum: Column) -> Column:
    """Remainder of an IBAN's check number: letters count as 10 to 35."""
    turned = F.concat(F.substring(alnum, F.lit(5), F.char_length(alnum).cast("int")), F.substring(alnum, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _card(item: Column, key: str) -> Column:
    payload = permute_chars(F.substring(_digits(item), F.lit(1), (F.char_length(_digits(item)) - 1).cast("int")), key, F.lit("card"))
    check = F.pmod(F.lit(10) - luhn_sum(payload, 1) % 10, F.lit(10))
    return reformat(item, F.concat(payload, check.cast("string")))


def _phone(item: Column, key: str) -> Column:
    country = F.regexp_extract(item, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substring(item, (F.char_length(country) + 1).cast("int"), F.char_length(item).cast("int"))
    return F.concat(country, reformat(rest, permute_chars(_digits(rest), key, F.concat(F.lit("phone"), country))))


def _iban(item: Column, key: str) -> Column:
    packed = F.replace(item, F.lit(" "), F.lit(""))
    country = F.substring(packed, 1, 2)
    account = permute_chars(F.substring(packed, F.lit(5), F.char_length(packed).cast("int")), key, F.concat(F.lit("iban"), country))
    check = F.lpad((F.lit(98) - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    whole = F.concat(country, check, account)
    spaced = F.array_join(
        F.transform(F.split(item, " "), lambda g, i: F.substring(whole, _before(item, i) + 1, F.char_length(g).cast("int"))), " "
    )
    return spaced


def _before(item: Column, i: Column) -> Column:
    """Characters, without spaces, before the i-th group of ``item``."""
    groups = F.slice(F.split(item, " "), F.lit(1), i)
    return F.aggregate(groups, F.lit(0), lambda a, g: a + F.char_length(g)).cast("int")


def _octet(item: Column, n: int) -> Column:
    return _number(F.split_part(item, F.lit("."), F.lit(n)))


def _address(item: Column, key: str) -> Column:
    done = permute_pair(_octet(item, 1) * 256 + _octet(item, 2), _octet(item, 3) * 256 + _octet(item, 4), (65536, 65536), key, "ipv4")
    halves = [done["l"], done["r"]]
    return F.concat_ws(".", *[p.cast("string") for h in halves for p in (F.floor(h / 256), h % 256)])


def _day(item: Column) -> Column:
    return F.coalesce(
        F.when(F.substring(item, 5, 1) == "-", F.try_to_date(item, "yyyy-MM-dd")),
        F.when(F.substring(item, 3, 1) == ".", F.try_to_date(item, "dd.MM.yyyy")),
        F.when(F.substring(item, 3, 1) == "/", F.try_to_date(item, "dd/MM/yyyy")),
    )


def _date(item: Column, key: str) -> Column:
    number = F.datediff(_day(item), F.lit(EPOCH).cast("date"))
    a, b = DAY_HALVES
    done = permute_pair(F.floor(number / b), number % b, (a, b), key, "date")
    day = F.date_add(F.lit(EPOCH).cast("date"), (done["l"] * b + done["r"]).cast("int"))
    return (
        F.when(F.substring(item, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd"))
        .when(F.substring(item, 3, 1) == ".", F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )


def _ssn(item: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999, numbered without gaps."""
    area = _number(F.substring(item, 1, 3))
    packed = F.when(area > 666, area - 2).otherwise(area - 1)
    done = permute_pair(packed * 99 + _number(F.substring(item, 5, 2)) - 1, _number(F.substring(item, 8, 4)) - 1, (898 * 99, 9999), key, "ssn")
    index = F.floor(done["l"] / 99)
    parts = ((F.when(index >= 665, index + 2).otherwise(index + 1), 3), (done["l"] % 99 + 1, 2), (done["r"] + 1, 4))
    return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])


def _email(item: Column, key: str) -> Column:
    local, host = F.split_part(item, F.lit("@"), F.lit(1)), F.split_part(item, F.lit("@"), F.lit(2))
    return F.concat(permute_chars(local, key, F.concat(F.lit("email"), F.lower(host))), F.lit("@"), host)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shape(window: Column, shape: str) -> Column:
    """What ``shape`` matches behind the first character of ``window``; empty if nothing."""
    return F.regexp_extract(window, rf"^[\s\S]({shape})", 1)


def _heads(item: Column, separators: str) -> Column:
    """``item`` and its shorter forms: what ends at a border of its groups."""

    def cut(groups: Column) -> Column:
        length = lambda k: F.aggregate(F.slice(groups, F.lit(1), k), F.lit(-1), lambda a, g: a + F.char_length(g) + 1)
        return F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.substring(item, F.lit(1), length(k).cast("int")))

    return _let(F.split(item, separators), cut)


def _one(window: Column, shape: str, test: Callable[[Column], Column]) -> Column:
    return F.filter(F.array(_shape(window, shape)), lambda v: (v != "") & test(v))


def _ibans(window: Column) -> Column:
    whole = lambda v: v.rlike(f"^{IBAN}$") & (mod97(F.replace(v, F.lit(" "), F.lit(""))) == 1)
    return _let(_shape(window, IBAN), lambda s: F.when(s != "", F.filter(_heads(s, " "), whole)))


def _phones(window: Column) -> Column:
    """Those of 8 to 15 digits; behind country code 1 a number has 11 digits with it, if any candidate does."""
    whole = lambda v: v.rlike(f"^{PHONE}$") & F.char_length(_digits(v)).between(8, 15)
    american = lambda v: v.startswith("+1") & (F.char_length(_digits(v)) == 11)
    chosen = lambda vs: F.when(F.exists(vs, american), F.filter(vs, american)).otherwise(vs)
    return _let(_shape(window, PHONE), lambda s: F.when(s != "", _let(F.filter(_heads(s, "[ .-]"), whole), chosen)))


def _cards(window: Column) -> Column:
    whole = lambda v: v.rlike(r"^\d(?:[ -]?\d){12,18}$") & (luhn_sum(_digits(v), 0) % 10 == 0)
    return _let(_shape(window, CARD), lambda s: F.when(s != "", F.filter(_heads(s, "[ -]"), whole)))


def _dates(window: Column) -> Column:
    known = lambda v: F.coalesce(_day(v).between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))
    return _one(window, f"{ISO_DATE}|{DAY_DATE % 2}", known)


def _addresses(window: Column) -> Column:
    return _one(window, IPV4, lambda s: s.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}"))


def _ssns(window: Column) -> Column:
    return _one(window, SSN, lambda s: s.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"))


#: kind, valid values at a place (the window starts one character before it), pseudonym. The first kind with a value decides.
KINDS: list[tuple[str, Callable[[Column], Column], Callable[[Column, str], Column]]] = [
    ("email", lambda w: _one(w, EMAIL, lambda s: F.lit(True)), _email),
    ("iban", _ibans, _iban),
    ("phone", _phones, _phone),
    ("date", _dates, _date),
    ("ipv4", _addresses, _address),
    ("ssn", _ssns, _ssn),
    ("card", _cards, _card),
]


def _found(window: Column, kinds: list) -> Column:
    """Struct (kind, items) of the first of ``kinds`` with valid values at the place; null if none."""

    def named(name: str, values: Callable[[Column], Column]) -> Column:
        return _let(values(window), lambda vs: F.when(F.size(vs) > 0, F.struct(F.lit(name).alias("kind"), vs.alias("items"))))

    return F.coalesce(*[named(name, values) for name, values, _ in kinds])


def _value(window: Column, email: Column) -> Column:
    """Struct (kind, item) of the value at a place: the longest valid one, counting the value one separator behind it.

    So a number does not take the first digits of the value that follows it.
    """

    def length(v: Column) -> Column:
        behind = _found(F.substring(window, F.char_length(v) + 2, F.lit(WINDOW)), KINDS)
        return F.char_length(v) + F.coalesce(F.array_max(F.transform(behind["items"], F.char_length)), F.lit(0))

    def pick(values: Column) -> Column:
        ranked = F.transform(values, lambda v: F.struct(length(v).alias("n"), F.char_length(v).alias("own"), v.alias("v")))
        return F.when(F.size(values) > 1, F.array_max(ranked)["v"]).otherwise(F.get(values, F.lit(0)))

    address = F.when(email != "", F.struct(F.lit("email").alias("kind"), F.array(email).alias("items")))
    found = F.coalesce(address, _found(window, KINDS[1:]))
    return _let(found, lambda f: F.when(f.isNotNull(), F.struct(f["kind"].alias("kind"), pick(f["items"]).alias("item"))))


def _pseudonym(found: Column, key: str) -> Column:
    new = F
    for name, _, make in KINDS:
        new = new.when(found["kind"] == name, make(found["item"], key))
    return new


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``pii_text`` and ``pii_kinds`` (one entry per value replaced, in order).

    Equal values get equal pseudonyms in all documents, whatever their separators; different values of a kind and
    format get different ones. The text between the values is untouched. Numbers that fail their check (Luhn, mod 97,
    octets, calendar) stay, but the values inside them are found: every start at a border of digit groups
    and every length that ends at one is tried, and the search goes on just behind a value. A value must lie within one line. A null text is empty and has no values.
    The key is the caller's secret.
    """

    def scrub(line: Column) -> Column:
        # The first piece is no place; every other one starts at a place.
        pieces = F.split(F.concat(F.lit("\n"), line), PLACE, -1)
        emails, windows = (F.regexp_extract_all(line, F.lit(PLACE), F.lit(g)) for g in (1, PLACE_WINDOW))
        return _let(pieces, lambda p: fold(p, F.zip_with(emails, windows, lambda e, w: F.struct(e.alias("email"), w.alias("window")))))

    def fold(pieces: Column, places: Column) -> Column:
        before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, -1, 1))
        behind = F.slice(pieces, F.lit(2), F.size(pieces))
        parts = F.zip_with(
            F.zip_with(before, behind, lambda b, p: F.struct(b.alias("before"), p.alias("piece"))),
            places,
            lambda p, x: F.struct(p["piece"].alias("piece"), x["email"].alias("email"), F.concat(p["before"], x["window"]).alias("window")),
        )

        def state(skip: Column, line: Column, kinds: Column) -> Column:
            return F.struct(skip.cast("int").alias("skip"), line.alias("line"), kinds.alias("kinds"))

        def rest(piece: Column, n: Column) -> Column:
            return F.substring(piece, n + 1, F.char_length(piece))

        def step(so_far: Column, x: Column) -> Column:
            """``skip``: characters from this place on that belong to the value before."""
            piece, size = x["piece"], F.char_length(x["piece"])
            inside = state(F.greatest(so_far["skip"] - size, F.lit(0)), F.concat(so_far["line"], rest(piece, so_far["skip"])), so_far["kinds"])

            def replaced(v: Column) -> Column:
                n = F.char_length(v["item"])
                line = F.concat(so_far["line"], _pseudonym(v, key), rest(piece, n))
                taken = state(F.greatest(n - size, F.lit(0)), line, F.concat(so_far["kinds"], F.array(v["kind"])))
                return F.when(v.isNotNull(), taken).otherwise(state(F.lit(0), F.concat(so_far["line"], piece), so_far["kinds"]))

            return F.when(so_far["skip"] > 0, inside).otherwise(_let(_value(x["window"], x["email"]), replaced))

        start = state(F.lit(0), F.substring(F.get(pieces, F.lit(0)), 2, 1 << 30), F.array().cast("array<string>"))
        return _let(F.aggregate(parts, start, step), lambda s: F.struct(s["line"].alias("line"), s["kinds"].alias("kinds")))

    untouched = lambda line: F.struct(line.alias("line"), F.array().cast("array<string>").alias("kinds"))
    lines = F.transform(
        F.split(whole_text(text), "\n", -1), lambda line: F.when(line.rlike(PLACE), scrub(line)).otherwise(untouched(line))
    )
    rows = docs.select(packed(docs).alias("row"), lines.alias("lines"))
    return rows.select(
        "row.*",
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("pii_text"),
        F.flatten(F.transform("lines", lambda x: x["kinds"])).alias("pii_kinds"),
    )
