"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses; DataFrame operations only.

One scan finds candidates, each is validated (Luhn, octet ranges, calendar, issued ranges), and what is valid is permuted within
its own format by a keyed Feistel network. A value's domain is written as a product a * b and each round adds a keyed hash of one
half to the other, modulo that half's size, so the map is a bijection of exactly the valid values: equal values
get equal pseudonyms in every document, different values different ones, and the key holder can reverse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import let

ROUNDS = 8
#: The Gregorian cycle has 146097 = 189 * 773 days; the one that pseudonyms stay in begins here.
CYCLE_START, CYCLE_A, CYCLE_B = "1800-01-01", 189, 773
#: Of the cycle's days, all but the first twelve of each of its 4800 months; they lie in 297 * 298 = LATE + 9.
MONTHS, LATE, LATE_A, LATE_B = 4800, 146097 - 12 * 4800, 297, 298

#: Candidates by kind, in the order in which they are tried; none starts or ends inside a longer word or number.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\w|[.-]\d)",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "date": r"(?<![\w.+/-])(?:\d{4}-\d{2}-\d{2}(?=[Tt]\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\w|[./-]\d))",
}
ANY = "|".join(PATTERNS.values())
#: Country calling codes of one digit and of two; all others have three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What any candidate holds; a cheap test that most texts fail.
HINT = r"@|[0-9][0-9]|[0-9][.][0-9]"


def _keyed(key: str, kind: str, i: Column, x: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, a: int | Column, b: int | Column, key: str, kind: str, reverse: bool = False) -> Column:
    """A keyed bijection of [0, a * b) by alternating modular Feistel rounds; a and b up to 1e9."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    sign = -1 if reverse else 1

    def step(s: Column, i: Column) -> Column:
        to_left = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(to_left, F.pmod(s["l"] + sign * F.pmod(_keyed(key, kind, i, s["r"]), a), a)).otherwise(s["l"]).alias("l"), F.when(to_left, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(_keyed(key, kind, i, s["l"]), b), b)).alias("r"))

    rounds = F.array(*map(F.lit, range(ROUNDS)[:: -1 if reverse else 1]))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; digits at an odd (1) or even (0) distance from the right end count double."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when(F.pmod(n - i, F.lit(2)) == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order; the rest stays."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct((s["i"] + is_digit.cast("int")).alias("i"), F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def _number(digits: Column, key: str, kind: str, reverse: bool) -> Column:
    """A digit string permuted among those of its length (2 to 18)."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    return F.lpad(permuted(digits.cast("long"), _power(n - low), _power(low), key, kind, reverse).cast("string"), n, "0")


def _card(m: Column, key: str, reverse: bool) -> Column:
    def of(d: Column) -> Column:
        body = _number(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", reverse)
        checked = let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, let(checked, lambda c: _refilled(m, c)))

    return let(_digits(m), of)


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """The country code stays: what a separator sets off, else by the plan of calling codes."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    code = F.when(code == "", F.regexp_extract(m, CALLING_CODE, 0)).otherwise(code)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, let(let(_digits(rest), lambda d: _number(d, key, "phone", reverse)), lambda d: _refilled(rest, d)))


def _ip(m: Column, key: str, reverse: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    ok = F.forall(F.split(m, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
    v = permuted(F.aggregate(o, F.lit(0).cast("long"), lambda s, x: s * 256 + x), 65536, 65536, key, "ip", reverse)
    part = lambda k: F.pmod(F.shiftright(v, k), F.lit(256)).cast("string")
    return F.when(ok, F.concat_ws(".", *map(part, (24, 16, 8, 0))))


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    at = area - 1 - (area > 666).cast("long")
    v = permuted((at * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", reverse)
    new = F.floor(v / (99 * 9999)).cast("long")
    new = new + 1 + (new >= 665).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(ok, F.concat_ws("-", pad(new, 3), pad(F.pmod(F.floor(v / 9999), F.lit(99)).cast("long") + 1, 2), pad(F.pmod(v, F.lit(9999)) + 1, 4)))


def _late(m: Column, key: str, reverse: bool) -> Column:
    """Day/month/year with a day over 12, permuted among such dates, so that the pseudonym is none of month/day/year."""
    start = F.lit(CYCLE_START).cast("date")
    date = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date")
    month = ((F.year(date) - 1800) * 12 + F.month(date) - 1).cast("long")
    nth = F.datediff(date, start) - 12 * (month + 1)
    # The domain has nine values more than there are dates: what lands on one moves on, ten times at most.
    step = lambda x: permuted(x, LATE_A, LATE_B, key, "datedd/MM/yyyy", reverse)
    new = F.aggregate(F.array(*map(F.lit, range(LATE_A * LATE_B - LATE))), step(nth), lambda x, _: F.when(x < LATE, x).otherwise(step(x)))

    def back(n: Column) -> Column:
        """The date at a place: its month is the last that begins at or before it, at most one off a constant rate."""
        begin = lambda k: F.datediff(F.add_months(start, k.cast("int")), start) - 12 * k
        guess = F.floor(n * MONTHS / LATE).cast("long")
        at = F.array_max(F.filter(F.transform(F.array(*map(F.lit, range(-2, 3))), lambda d: guess + d), lambda k: begin(k) <= n))
        return let(at, lambda k: F.date_add(start, (n + 12 * (k + 1)).cast("int")))

    return F.when((nth >= 0) & (nth < LATE), let(new, lambda n: F.date_format(back(n), "dd/MM/yyyy")))


def _date(m: Column, key: str, reverse: bool, day_first: bool = True) -> Column:
    """Year-month-day; month/day/year, or with day_first day/month/year where only that is a date; day.month.year."""

    def moved(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(CYCLE_START).cast("date")).cast("long")
        new = F.date_add(F.lit(CYCLE_START).cast("date"), permuted(day, CYCLE_A, CYCLE_B, key, "date" + form, reverse).cast("int"))
        return F.when((day >= 0) & (day < CYCLE_A * CYCLE_B), F.date_format(new, form))

    slashed = F.when(F.substring(m, 1, 2).cast("int") <= 12, moved("MM/dd/yyyy"))
    if day_first:
        slashed = slashed.otherwise(_late(m, key, reverse))
    return F.when(m.contains("-"), moved("yyyy-MM-dd")).when(m.contains("."), moved("dd.MM.yyyy")).otherwise(slashed)


def _shifted(text: Column, by: Column, sign: int) -> Column:
    """Letters and digits moved within their own class by bytes of a hash; other characters stay."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        k = sign * F.conv(F.substring(by, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda base, n: F.char(F.pmod(F.ascii(c) - base + k, F.lit(n)) + base)
        return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def _email(m: Column, key: str, reverse: bool) -> Column:
    """The part before @ as a Feistel network over its two halves of characters; the host stays."""
    at = F.locate("@", m)
    name, host = F.substring(m, F.lit(1), at - 1), F.substring(m, at, F.length(m))
    half = F.ceil(F.length(name) / 2).cast("int")  # a name of one character is only shifted
    start = F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r"))
    sign = -1 if reverse else 1
    mac = lambda i, x: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), x), 256)

    def step(s: Column, i: Column) -> Column:
        to_left = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(to_left, _shifted(s["l"], mac(i, s["r"]), sign)).otherwise(s["l"]).alias("l"), F.when(to_left, s["r"]).otherwise(_shifted(s["r"], mac(i, s["l"]), sign)).alias("r"))

    return F.concat(F.aggregate(F.array(*map(F.lit, range(4)[:: -1 if reverse else 1])), start, step, lambda s: F.concat(s["l"], s["r"])), host)


def _kind(m: Column) -> Column:
    """By what tells the patterns apart; a match of ANY is one of them."""
    return (
        F.when(m.contains("@"), "email").when(m.startswith("+"), "phone").when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), "date").otherwise("card")
    )


def pseudonym(m: Column, key: str, reverse: bool = False, day_first: bool = True) -> Column:
    """The pseudonym of one candidate; null if it is not valid."""
    k = _kind(m)
    by_kind = {"email": _email, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": lambda *a: _date(*a, day_first), "card": _card}
    out = F.lit(None).cast("string")
    for kind, f in by_kind.items():
        out = F.when(k == kind, f(m, key, reverse)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, column: str = "text", reverse: bool = False, day_first: bool = True) -> DataFrame:
    """docs with `column` rewritten and n_pseudonyms added: a projection, without a shuffle or any Python on executors.

    Null stays null with 0 pseudonyms, empty stays empty. Texts of any length are rewritten whole; candidates that are
    not valid stay as they are. Repeated rows get equal results, no rows give none. Other columns are passed on; one
    called n_pseudonyms is replaced. Slashed dates whose first part is over 12 are day/month/year; with day_first=False they stay as they are.
    Dates outside the 400 years from 1800 on stay too, as do phone numbers that neither start with + nor have a listed form, IBANs and IPv6
    addresses, which have no format here. reverse=True with the same key and day_first undoes it."""
    text = F.col(column)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hits = "__pii_hits"
    out = docs.withColumn(hits, F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: F.struct(m.alias("m"), pseudonym(m, key, reverse, day_first).alias("p"))))
    glued = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(hits), lambda t, h: F.concat(t, F.coalesce(h["p"], h["m"], F.lit("")))), "")
    out = out.withColumn(column, F.when(F.size(hits) > 0, glued).otherwise(text))
    return out.withColumn("n_pseudonyms", F.size(F.filter(hits, lambda h: h["p"].isNotNull()))).drop(hits)
