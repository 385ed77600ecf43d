"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

Values are found by pattern and validated (Luhn digit, octets, calendar, numbering rules). A valid value is a pair of
numbers (l, r) below (a, b); rounds add a keyed hash of one half to the other, which is a bijection of the pairs, so
equal values get equal pseudonyms in every document, different values of a kind get different ones, and a pseudonym
passes the same validation. Values that fail validation are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
START, STOP = r"(?<![A-Za-z0-9])(?<![0-9][.-])", r"(?![A-Za-z0-9])(?![.-][0-9])"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
ADDRESS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3})"
PATTERN = f"{EMAIL}|{START}(?:{PHONE}|{ADDRESS}|{DATE}|{SOCIAL}|{CARD}){STOP}"
FIRST_DAY, DAYS = "1800-01-01", 146097  # one cycle of the calendar: 189 * 773 days


def keyed(key: str, kind: str, i: Column, half: Column) -> Column:
    """48-bit number that depends on key, kind, round and half."""
    digest = F.sha2(F.concat(F.lit(f"{key}:{kind}:"), i.cast("string"), F.lit(":"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permuted(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """Struct (l, r): the permuted pair of numbers below a and b."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = F.struct(((s["l"] + keyed(key, kind, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), ((s["r"] + keyed(key, kind, i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def part(digits: Column, start: int, length: int) -> Column:
    return F.substring(digits, start, length).cast("long")


def padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order; all other characters stay."""
    def step(s: Column, p: Column) -> Column:
        c = F.substr(value, p, F.lit(1))
        own = F.struct(F.concat(s["t"], F.substr(digits, s["k"] + 1, F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))
        return F.when(c.rlike("[0-9]"), own).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step)["t"]


def luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled; valid numbers give a multiple of ten."""
    n = F.length(digits)

    def step(total: Column, p: Column) -> Column:
        d = F.substr(digits, p, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - p) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def card(key: str, value: Column) -> Column:
    """First digit kept, check digit made anew."""
    digits = digits_of(value)
    n = F.length(digits) - 2
    body, low = F.substr(digits, F.lit(2), n), F.ceil(n / 2).cast("int")
    high = n - low
    new = permuted(key, "card", F.substr(body, F.lit(1), high), F.substr(body, high + 1, low),
                   F.pow(F.lit(10.0), high).cast("long"), F.pow(F.lit(10.0), low).cast("long"))
    made = F.transform(F.array(new), lambda s: F.concat(F.substring(digits, 1, 1), padded(s["l"], high), padded(s["r"], low)))[0]
    whole = F.transform(F.array(made), lambda m: F.concat(m, ((10 - luhn(F.concat(m, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return F.when(luhn(digits) % 10 == 0, refilled(value, whole)).otherwise(value)


def phone(key: str, value: Column) -> Column:
    """Area and exchange codes stay in 200-999; a country digit stays."""
    digits = digits_of(value)
    lead = F.substr(digits, F.lit(1), F.length(digits) - 10)
    ten = F.substr(digits, F.length(digits) - 9, F.lit(10))
    number = ((part(ten, 1, 3) - 200) * 800 + part(ten, 4, 3) - 200) * 10000 + part(ten, 7, 4)
    new = permuted(key, "phone", F.floor(number / 80000), number % 80000, 80000, 80000)

    def text(s: Column) -> Column:
        v = s["l"] * 80000 + s["r"]
        area, rest = F.floor(v / 8000000), v % 8000000
        return F.concat(lead, (area + 200).cast("string"), (F.floor(rest / 10000) + 200).cast("string"), padded(rest % 10000, 4))

    return refilled(value, F.transform(F.array(new), text)[0])


def address(key: str, value: Column) -> Column:
    """IPv4 addresses with octets up to 255 and no leading zeros."""
    p = F.split(value, r"\.")
    valid = value.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    new = permuted(key, "address", p[0].cast("long") * 256 + p[1].cast("long"), p[2].cast("long") * 256 + p[3].cast("long"), 65536, 65536)
    text = F.transform(F.array(new), lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))[0]
    return F.when(valid, text).otherwise(value)


def social(key: str, value: Column) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    d = digits_of(value)
    area, group, serial = part(d, 1, 3), part(d, 4, 2), part(d, 6, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    new = permuted(key, "social", (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1, serial - 1, 88902, 9999)

    def text(s: Column) -> Column:
        a = F.floor(s["l"] / 99) + 1
        return F.concat(padded(a + F.when(a >= 666, 1).otherwise(0), 3), padded(s["l"] % 99 + 1, 2), padded(s["r"] + 1, 4))

    return F.when(valid, refilled(value, F.transform(F.array(new), text)[0])).otherwise(value)


def date(key: str, value: Column) -> Column:
    """Calendar dates of 1800-2199, permuted as day numbers: equal days in different formats stay linked. With slashes
    month first, or day first where that alone is a date."""
    d = digits_of(value)

    def made(y: Column, m: Column, day: Column, form: str) -> Column:
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
        valid = y.between(1800, 2199) & m.between(1, 12) & (day >= 1) & (day <= last)
        iso = F.when(valid, F.concat(padded(y, 4), F.lit("-"), padded(m, 2), F.lit("-"), padded(day, 2)))
        number = F.datediff(iso.cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        new = permuted(key, "date", F.floor(number / 773), number % 773, DAYS // 773, 773)
        text = F.transform(F.array(new), lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * 773 + s["r"]).cast("int")), form))[0]
        return F.when(valid, refilled(value, text))

    iso = made(part(d, 1, 4), part(d, 5, 2), part(d, 7, 2), "yyyyMMdd")
    month_first = made(part(d, 5, 4), part(d, 1, 2), part(d, 3, 2), "MMddyyyy")
    day_first = made(part(d, 5, 4), part(d, 3, 2), part(d, 1, 2), "ddMMyyyy")
    return F.coalesce(F.when(value.contains("-"), iso).when(value.contains("/"), F.coalesce(month_first, day_first)).otherwise(day_first), value)


def email(key: str, value: Column) -> Column:
    """Letters and digits of the local part are shifted within their class by the other half's keyed hash."""
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def shifted(text: Column, i: Column, other: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}:email:"), i.cast("string"), F.lit(":"), other), 256)

        def step(done: Column, p: Column) -> Column:
            c = F.substr(text, p, F.lit(1))
            by = F.conv(F.substr(digest, p * 2 - 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda first, size: F.char(F.lit(first) + (F.ascii(c) - first + by) % size)
            return F.concat(done, F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c))

        return F.when(F.length(text) == 0, text).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(""), step))

    def step(s: Column, i: Column) -> Column:
        odd = F.struct(shifted(s["l"], i, s["r"]).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), shifted(s["r"], i, s["l"]).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step)
    return F.transform(F.array(end), lambda s: F.concat(s["l"], s["r"], F.substr(value, F.length(local) + 1, F.length(value))))[0]


def pseudonym(key: str, value: Column) -> Column:
    """Pseudonym of one found value; its form decides the kind."""
    forms = ((EMAIL, email), (PHONE, phone), (ADDRESS, address), (DATE, date), (SOCIAL, social))
    chosen = reduce(lambda w, f: w.when(value.rlike(f"^(?:{f[0]})$"), f[1](key, value)), forms[1:], F.when(value.contains("@"), email(key, value)))
    return chosen.otherwise(card(key, value))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """docs with the values in text_col replaced, and the number of replaced ones in count_col (None: no such column).

    Null and empty texts stay as they are with count 0; a column already named count_col is replaced. All rows and all
    other columns are kept, whatever their ids.
    """
    text = F.col(text_col)
    may = text.contains("@") | text.rlike("[0-9]")
    found = docs.withColumn("__found", F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), 0)))
    new = F.transform("__found", lambda m: pseudonym(key, m))
    made = found.withColumn("__made", F.when(F.size("__found") > 0, new))
    whole = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.concat("__made", F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")
    out = {text_col: F.when(F.col("__made").isNotNull(), whole).otherwise(text)}
    if count_col:
        changed = F.size(F.filter(F.zip_with("__found", "__made", lambda x, y: x != y), lambda z: z))
        out[count_col] = F.when(F.col("__made").isNotNull(), changed).otherwise(0)
    return made.withColumns(out).drop("__found", "__made")
