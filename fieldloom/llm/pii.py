"""PII pseudonyms that keep their format, with DataFrame expressions only.

Personal values are found by one pattern, which also tells the kind of each, and validated (check
digits, octets, calendar dates). Each is replaced by a keyed permutation of itself within its
format: a Feistel network over its letters and digits, in which every round shifts one half's
characters, within their own alphabets, by a keyed hash of the other half. Equal values get equal
pseudonyms everywhere, cards, accounts and phones whatever separators they are written with;
different values of a kind stay different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh, table

ROUNDS = 8
#: What can be personal, in the order in which it is tried. Repeated groups are possessive or bounded: others recurse in
#: Java, once for each turn, and a long value would overflow the stack.
_NAMED = r"\b(?:password|passwd|token|secret|api_key|apikey)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    # quoted: all that is quoted; right after an equals sign, with a digit: up to the next blank or delimiter; else from eight characters on
    "secret": rf"(?<={_NAMED} ?[=:] ?\")[^\s\"]++(?=\")|(?<={_NAMED} ?[=:] ?')[^\s']++(?=')"
              rf"|(?<={_NAMED}=)(?=[^\s\"'<>,;&0-9]*+[0-9])[^\s\"'<>,;&]++|(?<={_NAMED} ?[=:] ?[\"']?)[A-Za-z0-9_/+-]{{8,}}+",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?<sep>[/.])[0-9]{2}\k<sep>[12][0-9]{3})(?![A-Za-z0-9])(?![./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![A-Za-z0-9])"
             r"|(?<![A-Za-z0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![A-Za-z0-9])",
    # as cards are written: without separators, in fours (and perhaps a shorter rest), or as 4-6-5 and 4-6-4
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?<{kind}>{p})" for kind, p in PATTERNS.items())
#: Texts without any of this hold nothing that the patterns find.
HINT = r"[0-9@]|AKIA|(?:password|passwd|token|secret|api_key|apikey) ?[=:]"
#: Around a found value, between the kinds' places in it, and what escapes these three in a text.
EDGE, PLACE, ESCAPE = "\x01", "\x02", "\x03"
ESCAPES = {ESCAPE: "\x04", EDGE: "\x05", PLACE: "\x06"}
TAGGED = EDGE + PLACE.join(f"${{{kind}}}" for kind in KINDS) + EDGE
#: All dates that the patterns can find, from FIRST_DAY to LAST_DAY: DAYS of them. LATE of them have a day
#: of the month above 12. Both numbers are products, so pairs of numbers stand for the dates exactly.
FIRST_DAY, LAST_DAY = "1000-01-01", "2999-12-31"
DAYS, LATE = (945, 773), (45, 9833)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def _digest(key: str, kind: str, round_: Column, other: Column) -> Column:
    """A round's keyed digest of the other half."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), round_.cast("string"), F.lit("|"), other), 256)


def _noise(digest: Column, at: Column) -> Column:
    """A pseudo-random number for position ``at``."""
    return F.conv(F.substr(digest, F.pmod(at * 5, F.lit(58)) + 1, F.lit(6)), 16, 10).cast("int")


def _shift(char: Column, by: Column, alphabet: str | None) -> Column:
    """The character moved on within its alphabet (digits, A-Z, a-z, or the one given)."""
    def within(letters: str) -> Column:
        at = F.instr(F.lit(letters), char) - 1
        return F.substr(F.lit(letters), F.pmod(at + by, F.lit(len(letters))) + 1, F.lit(1))

    if alphabet:
        return within(alphabet)
    return (F.when(char.between("0", "9"), within("0123456789"))
            .when(char.between("A", "Z"), within("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(char.between("a", "z"), within("abcdefghijklmnopqrstuvwxyz")).otherwise(char))


def feistel(value: Column, key: str, kind: str, alphabet: str | None = None) -> Column:
    """A keyed permutation of the strings with ``value``'s length and classes of characters."""
    def one_round(chars: Column, r: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        left = r % 2 == 0  # the half that is shifted in this round
        other = F.array_join(F.when(left, F.slice(chars, half + 1, F.size(chars) - half)).otherwise(F.slice(chars, F.lit(1), half)), "")
        return _let(_digest(key, kind, r, other), lambda d: F.transform(
            chars, lambda c, i: F.when((i < half) == left, _shift(c, _noise(d, i), alphabet)).otherwise(c)))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.split(value, ""), one_round, lambda chars: F.array_join(chars, ""))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _refill(shape: Column, bare: Column) -> Column:
    """``shape`` with its letters and digits replaced, in order, by those of ``bare``."""
    return _let(bare, lambda b: F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Za-z]"), F.substr(b, F.length(_bare(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that a check digit will follow."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _luhn(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("A", "Z"), (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban_check(country: Column, account: Column) -> Column:
    return F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")


def _pair(key: str, kind: str, number: Column, sides: tuple[int, int]) -> Column:
    """A keyed permutation of the numbers below the product of ``sides``, as pairs of digits."""
    def one_round(acc: Column, r: Column) -> Column:
        high_next = F.pmod(acc["high"] + _noise(_digest(key, kind, r, acc["low"].cast("string")), F.lit(0)), F.lit(sides[0]))
        low_next = F.pmod(acc["low"] + _noise(_digest(key, kind, r, acc["high"].cast("string")), F.lit(0)), F.lit(sides[1]))
        even = r % 2 == 0
        return F.struct(F.when(even, high_next).otherwise(acc["high"]).alias("high"), F.when(even, acc["low"]).otherwise(low_next).alias("low"))

    start = F.struct(F.floor(number / sides[1]).cast("int").alias("high"), F.pmod(number, F.lit(sides[1])).cast("int").alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda acc: acc["high"].cast("long") * sides[1] + acc["low"])


def _late_day(number: Column) -> Column:
    """The ``number``-th date with a day of the month above 12: twelve days of each month are skipped."""
    def date(month: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), (number + 12 * (month + 1)).cast("int"))

    near = F.floor(number / (LATE[0] * LATE[1] / 24_000)).cast("int")
    months = F.sequence(F.greatest(near - 2, F.lit(0)), near + 2)
    fits = F.filter(months, lambda m: ((F.year(date(m)) - 1000) * 12 + F.month(date(m)) - 1 == m) & (F.dayofmonth(date(m)) > 12))
    return date(F.get(fits, F.lit(0)))


def _date(value: Column, key: str) -> Column:
    """The date moved among all dates. Written by numbers with the year last, it is read day first if it
    can be; those that can only be month first move among themselves, so no two dates meet."""
    iso = value.substr(5, 1) == "-"
    sep = value.substr(3, 1)
    dotted = F.translate(value, ".", "/")
    day = F.to_date(F.try_to_timestamp(F.when(iso, value).otherwise(dotted), F.when(iso, F.lit("yyyy-MM-dd")).otherwise(F.lit("dd/MM/yyyy"))))
    month_first = F.to_date(F.try_to_timestamp(dotted, F.lit("MM/dd/yyyy")))
    first = F.lit(FIRST_DAY).cast("date")

    def written(to: Column, one: str, two: str) -> Column:
        return _let(to, lambda t: F.when(iso, F.date_format(t, "yyyy-MM-dd")).otherwise(
            F.concat(F.date_format(t, one), sep, F.date_format(t, two), sep, F.date_format(t, "yyyy"))))

    moved = F.date_add(first, _pair(key, "date", F.datediff(day, first), DAYS).cast("int"))
    late = F.datediff(month_first, first) - 12 * ((F.year(month_first) - 1000) * 12 + F.month(month_first))
    moved_late = _let(_pair(key, "late", late, LATE), _late_day)
    return (F.when(day.isNotNull(), written(moved, "dd", "MM"))
            .when(~iso & month_first.isNotNull(), written(moved_late, "MM", "dd")).otherwise(value))


def _ip(value: Column, key: str) -> Column:
    o = [F.substring_index(F.substring_index(value, ".", n), ".", -1).cast("long") for n in (1, 2, 3, 4)]
    moved = _pair(key, "ip", ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], (65536, 65536))
    return _let(moved, lambda m: F.concat_ws(".", *[F.pmod(F.shiftright(m, by), F.lit(256)).cast("string") for by in (24, 16, 8, 0)]))


def _valid_part(value: Column, valid: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of the longest beginning of ``value``, cut at separators, that is ``valid``, and the rest as
    it is; all as it is where none is. A card may stand before its expiry date, an account before a word."""
    ends = F.filter(F.sequence(F.length(value), F.lit(1), F.lit(-1)), lambda i: F.substr(value, i + 1, F.lit(1)).isin("", " ", "-"))
    fits = F.filter(ends, lambda i: valid(_bare(F.substr(value, F.lit(1), i))))
    return _let(F.get(fits, F.lit(0)), lambda i: F.when(i.isNull(), value).otherwise(F.concat(use(F.substr(value, F.lit(1), i)), F.substr(value, i + 1))))


def _card(value: Column, key: str) -> Column:
    def body(bare: Column) -> Column:
        return F.substr(bare, F.lit(1), F.length(bare) - 1)

    return _valid_part(value, lambda b: (F.length(b) >= 13) & (_luhn(body(b)) == F.substr(b, F.length(b), F.lit(1))),
                       lambda v: _refill(v, _let(feistel(body(_bare(v)), key, "card"), lambda x: F.concat(x, _luhn(x)))))


def _iban(value: Column, key: str) -> Column:
    def new(v: Column) -> Column:
        country = F.substr(v, F.lit(1), F.lit(2))
        return _refill(v, _let(feistel(F.substr(_bare(v), F.lit(5)), key, "iban"), lambda x: F.concat(country, _iban_check(country, x), x)))

    return _valid_part(value, lambda b: (F.length(b) >= 12) & (_mod97(F.concat(F.substr(b, F.lit(5)), F.substr(b, F.lit(1), F.lit(4)))) == 1), new)


def _phone(value: Column, key: str) -> Column:
    code = F.when(value.startswith("+"), F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[^0-9])", 0)).otherwise("")
    return _let(code, lambda c: F.concat(c, _let(F.substr(value, F.length(c) + 1), lambda n: _refill(n, feistel(_bare(n), key, "phone")))))


def pseudonym(value: Column, kind: str, key: str) -> Column:
    """The pseudonym of a value of a kind; the value itself where it does not validate."""
    if kind == "email":
        return F.concat(feistel(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))
    if kind == "key":
        return F.concat(F.lit("AKIA"), feistel(F.substr(value, F.lit(5)), key, "key"))
    if kind == "hex":
        return feistel(value, key, "hex", "0123456789abcdef")
    if kind == "secret":
        return feistel(value, key, "secret")
    if kind == "ssn":
        return _refill(value, feistel(_bare(value), key, "ssn"))
    return {"ip": _ip, "date": _date, "iban": _iban, "phone": _phone, "card": _card}[kind](value, key)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Columns of ``docs`` with ``text`` pseudonymised, and ``n_found, n_replaced int``.

    Null text stays null with counts 0; empty and very long texts are treated whole, and so are values
    of any length. Numbers whose check digits fail and impossible dates stay. Repeated rows get equal
    results; columns named ``n_found`` or ``n_replaced`` are replaced, others come back as they were. An empty
    table gives an empty result. Nothing is shuffled.
    """
    docs = docs.drop("n_found", "n_replaced")
    found, new = fresh(docs, "found", "new")
    plain = F.col(text)
    for sign, code in ESCAPES.items():
        plain = F.replace(plain, F.lit(sign), F.lit(ESCAPE + code))
    # Every value goes between two edges, in its kind's place: text, value, text, value, ..., text.
    out = docs.withColumn(found, F.when(F.col(text).rlike(HINT), F.split(F.regexp_replace(plain, ANY, TAGGED), EDGE, -1)))

    def replaced(value: Column) -> Column:
        def by_kind(places: Column) -> Column:
            result = None
            for i, kind in enumerate(KINDS):
                chosen = pseudonym(places[i], kind, key)
                result = F.when(places[i] != "", chosen) if result is None else result.when(places[i] != "", chosen)
            return result

        return _let(F.split(value, PLACE, -1), by_kind)

    out = out.withColumn(new, F.transform(found, lambda v, i: F.when(i % 2 == 0, v).otherwise(replaced(v))))
    joined = F.array_join(new, "")
    for sign, code in reversed(ESCAPES.items()):
        joined = F.replace(joined, F.lit(ESCAPE + code), F.lit(sign))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: F.translate(a, PLACE, "") != b), lambda x: x))
    some = F.size(found) > 1
    return out.select(*[F.when(some, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns],
                      F.when(some, F.floor(F.size(found) / 2)).otherwise(0).cast("int").alias("n_found"), F.when(some, changed).otherwise(0).cast("int").alias("n_replaced"))


#: The queries' key; a real run passes its own.
DEMO_KEY = "a key for tests"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", "n_found", "n_replaced")
