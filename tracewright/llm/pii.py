"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Patterns find candidates; cards must pass the Luhn check, addresses have octets
up to 255, dates exist, identity numbers have an issued form. A valid value is
a pair of residues (a, b), and ROUNDS times one of them in turn has a keyed hash
of the other added, modulo its own size. That permutes the values of a format
among themselves: no two meet, equal ones stay equal in every document, and the
key's holder can go back (`restore`). Separators stay, check digits are made
anew. In an email address letters and digits of the local part are permuted
among strings of the same shape. All is built-in expressions.

An address's format is the places and widths of its octets with leading zeros,
and the widths of the others; all addresses without such zeros are one format.
Domains of email addresses stay, as do letters beyond ASCII before the @ and
what is left of them; phone numbers are told by their form alone.

A date's format is how it is written: year first, or the widths of its first
two fields and which of them is the day. Each such set of strings is numbered
and permuted by itself, so that no string lands where one of another set may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import without

ROUNDS = 10
KINDS = ("email", "date", "ip", "ssn", "phone", "card")
ADDED = ("pseudonymised", *(f"n_{k}" for k in KINDS))

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,9}"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))
#: What any candidate has; most texts have none of it.
MAYBE = "[0-9@]"
#: Dates are of the YEARS years from here on; 400 years have as many days wherever they begin.
FIRST_YEAR, YEARS = 1800, 400
#: The days of October to December.
LAST_MONTHS = 92


@dataclass(frozen=True)
class Key:
    """The secret, and whether pseudonyms are made or taken back."""

    secret: str
    back: bool = False


@dataclass(frozen=True)
class Dates:
    """The days from `first` on, to the 9th or to the month's end, of the first `months` months of each year: n in all, permuted as pairs of residues of a and b."""

    months: int
    first: int
    to_ninth: bool
    a: int
    b: int
    n: int


#: What can be written in fields of two and two digits, one and one and so on; "swapped" are those that only read month first.
#: a * b is n, or n + 1 where n is prime: the number beyond n is passed on to where it leads itself.
ALL_DAYS = Dates(12, 1, False, 189, 773, 146_097)
SWAPPED = Dates(12, 13, False, 9, 9833, 88_497)
ONE_ONE = Dates(9, 1, True, 180, 180, 32_400)
ONE_TWO = Dates(12, 1, True, 180, 240, 43_200)
ONE_TWO_SWAPPED = Dates(9, 13, False, 157, 421, 66_097)
TWO_ONE = Dates(9, 1, False, 259, 422, 109_297)


def hashed(key: Key, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit(kind), i.cast("string"), half), 256)


def turns(key: Key) -> Column:
    """The rounds, in the order that they are taken in."""
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if key.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body of the value, which is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def permuted(a: Column, b: Column, size_a: Column, size_b: Column, key: Key, kind: str, body) -> Column:
    """body of the pair (a, b) of residues after the rounds; sizes may differ, and both tweak the hash."""

    def rounds(s: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            even = i % 2 == 0
            other = F.when(even, x["b"]).otherwise(x["a"])
            f = number(F.substring(hashed(key, kind, i, F.concat_ws(";", s["a"].cast("string"), s["b"].cast("string"), other.cast("string"))), 1, 15))
            moved = lambda v, size: F.pmod(v - f if key.back else v + f, size)
            return F.struct(F.when(even, moved(x["a"], s["a"])).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(moved(x["b"], s["b"])).alias("b"))

        return F.aggregate(turns(key), F.struct(s["x"].alias("a"), s["y"].alias("b")), step)

    start = F.struct(size_a.cast("long").alias("a"), size_b.cast("long").alias("b"), a.cast("long").alias("x"), b.cast("long").alias("y"))
    return let(let(start, rounds), body)


def permuted_digits(digits: Column, key: Key, kind: str, body) -> Column:
    """body of another string of as many digits, up to 30."""

    def of(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        size = lambda n: F.pow(F.lit(10.0), n).cast("long")
        joined = lambda x: F.concat(F.lpad(x["a"].cast("string"), left, F.lit("0")), F.lpad(x["b"].cast("string"), right, F.lit("0")))
        return permuted(F.substr(d, F.lit(1), left), F.substr(d, left + 1), size(left), size(right), key, kind, joined)

    return let(let(digits, of), body)


def luhn(digits: Column) -> Column:
    """Sum of the digits of a bound string, of which every second from the right counts twice."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def written_as(digits: Column, form: Column) -> Column:
    """form with the digits of a bound string in place of its own."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(x: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(F.concat(x["s"], F.when(own, F.substr(digits, x["k"], F.lit(1))).otherwise(c)).alias("s"), (x["k"] + own.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda x: x["s"])


def card(m: Column, key: Key) -> Column:
    def of(digits: Column) -> Column:
        checked = lambda p: F.concat(p, ((10 - luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))
        new = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", lambda p: let(checked(p), lambda d: written_as(d, m)))
        return F.when(luhn(digits) % 10 == 0, new)

    return let(F.regexp_replace(m, "[^0-9]", ""), of)


def phone(m: Column, key: Key) -> Column:
    def of(country: Column) -> Column:
        rest = F.substr(m, F.length(country) + 1)
        return F.concat(country, permuted_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", lambda d: written_as(d, rest)))

    return let(F.regexp_extract(m, r"^\+[0-9]{1,3}(?![0-9])", 0), of)


def ip(m: Column, key: Key) -> Column:
    """Plain addresses among plain ones; where an octet has leading zeros, among those with octets as wide, led by zeros in the same places."""
    byte = lambda v, d: (F.floor(v / d) % 256).cast("string")

    def plain(o: Column) -> Column:
        dotted = lambda x: F.concat_ws(".", byte(x["a"], 256), byte(x["a"], 1), byte(x["b"], 256), byte(x["b"], 1))
        return permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", dotted)

    def padded(o: Column) -> Column:
        """o has an octet's text, width, and the first and the number of the values that are written so."""
        value = lambda i: o[i]["text"].cast("int") - o[i]["first"]
        written = lambda i, v: F.lpad((v + o[i]["first"]).cast("long").cast("string"), o[i]["width"], F.lit("0"))
        high = lambda i, v: written(i, F.floor(v / o[i + 1]["n"]))
        low = lambda i, v: written(i, v % o[i]["n"])
        dotted = lambda x: F.concat_ws(".", high(0, x["a"]), low(1, x["a"]), high(2, x["b"]), low(3, x["b"]))
        pair = lambda i: (value(i) * o[i + 1]["n"] + value(i + 1), o[i]["n"] * o[i + 1]["n"])
        (a, size_a), (b, size_b) = pair(0), pair(2)
        return permuted(a, b, size_a, size_b, key, "padded ip", dotted)

    def written_so(text: Column) -> Column:
        width, led = F.length(text), F.startswith(text, F.lit("0")) & (F.length(text) > 1)
        first = F.when(led | (width == 1), 0).when(width == 2, 10).otherwise(100)
        n = F.when(led & (width == 3), 100).when(led | (width == 1), 10).when(width == 2, 90).otherwise(156)
        return F.struct(text.alias("text"), width.alias("width"), first.alias("first"), n.alias("n"))

    def of(parts: Column) -> Column:
        own = let(parts.cast("array<int>"), plain)
        led = let(F.transform(parts, written_so), padded)
        return F.when(F.forall(parts, lambda t: t.cast("int") <= 255), F.when(F.exists(parts, lambda t: t.rlike("^0[0-9]")), led).otherwise(own))

    return let(F.split(m, r"\."), of)


def ssn(m: Column, key: Key) -> Column:
    """Areas 001 to 899 without 666, groups and serials from 1 on."""
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")

    def of(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        written = lambda x: F.concat_ws("-", pad(x["a"] + 1 + (x["a"] >= 665).cast("int"), 3), pad(F.floor(x["b"] / 9999) + 1, 2), pad(x["b"] % 9999 + 1, 4))
        return F.when(issued, permuted(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", written))

    return let(F.split(m, "-").cast("array<int>"), of)


def date(m: Column, key: Key) -> Column:
    """Year first, or day before month; where that is no date, month before day. Fields keep their widths, and what reads month first does so still."""
    first_day = F.lit(f"{FIRST_YEAR}-01-01").cast("date")
    mark, iso = F.regexp_extract(m, "[^0-9]", 0), F.contains(m, F.lit("-"))
    read = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    params = lambda s: F.struct(*[F.lit(v).alias(c) for c, v in vars(s).items()])

    def before(s: Column, month: Column) -> Column:
        """How many days the set has before a month, which is counted through the years."""
        year = F.floor(month / s["months"])
        days = F.datediff(F.make_date((year + FIRST_YEAR).cast("int"), (month % s["months"] + 1).cast("int"), F.lit(1)), first_day)
        return F.when(s["to_ninth"], 9 * month).otherwise(days - F.when(s["months"] == 9, LAST_MONTHS * year).otherwise(0) - (s["first"] - 1) * month)

    def of(p: Column) -> Column:
        one = (F.length(p[0]) == 1, F.length(p[1]) == 1)

        def written(s: Column, x: Column, at: Column) -> Column:
            """The date with number `at` of the set."""
            guess = F.floor(at * YEARS * s["months"] / s["n"])  # months differ by so little that it is the month beside, if not this

            def found(month: Column) -> Column:
                d, mo = (at - before(s, month) + s["first"]).cast("string"), (month % s["months"] + 1).cast("string")
                y = (F.floor(month / s["months"]) + FIRST_YEAR).cast("string")
                a, b = (F.when(x["swapped"], v).otherwise(w) for v, w in ((mo, d), (d, mo)))
                fields = F.concat(F.lpad(a, F.length(p[0]), F.lit("0")), mark, F.lpad(b, F.length(p[1]), F.lit("0")), mark, y)
                return F.when(iso, F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))).otherwise(fields)

            near = F.array(*[F.greatest(guess + d, F.lit(0)) for d in (-1, 0, 1)])
            return let(F.array_max(F.filter(near, lambda g: before(s, g) <= at)), found)

        def moved(x: Column) -> Column:
            s, day = x["of"], x["day"]
            month = (F.year(day) - FIRST_YEAR) * s["months"] + F.month(day) - 1
            once = lambda v: permuted(F.floor(v / s["b"]), v % s["b"], s["a"], s["b"], key, "date", lambda q: q["a"] * s["b"] + q["b"])
            inside = lambda v: F.when(v < s["n"], v).otherwise(once(v))
            new = let(let(before(s, month) + F.dayofmonth(day) - s["first"], once), inside)
            return F.when(F.year(day).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), let(new, lambda at: written(s, x, at)))

        def kind(x: Column) -> Column:
            swapped = x["day"].isNull()
            by = F.when(iso | ~one[0] & ~one[1] & ~swapped, params(ALL_DAYS)).when(one[0] & one[1], params(ONE_ONE)).when(one[1], params(TWO_ONE))
            by = by.when(one[0], F.when(swapped, params(ONE_TWO_SWAPPED)).otherwise(params(ONE_TWO))).otherwise(params(SWAPPED))
            return let(F.struct(by.alias("of"), F.coalesce(x["day"], x["other"]).alias("day"), swapped.alias("swapped")), moved)

        day = F.when(iso, read(p[0], p[1], p[2])).otherwise(read(p[2], p[1], p[0]))
        return let(F.struct(day.alias("day"), F.when(~iso, read(p[2], p[0], p[1])).alias("other")), kind)

    return let(F.split(m, "[/.-]"), of)


def email(m: Column, key: Key) -> Column:
    def shifted(half: Column, stream: Column) -> Column:
        def one(s: Column) -> Column:
            def at(p: Column) -> Column:
                c, k = F.substr(half, p, F.lit(1)), number(F.substr(s, 2 * p - 1, F.lit(2)))
                within = lambda first, n: F.char(F.pmod(F.ascii(c) - ord(first) + (-k if key.back else k), F.lit(n)) + ord(first))
                return F.when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).when(c.between("0", "9"), within("0", 10)).otherwise(c)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), at), "")

        return F.when(F.length(half) > 0, let(stream, one)).otherwise("")

    def rounds(s: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            even = i % 2 == 0
            stream = hashed(key, "email", i, F.concat(s["shape"], F.lit(";"), F.when(even, x["b"]).otherwise(x["a"])))
            return F.struct(F.when(even, shifted(x["a"], stream)).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(shifted(x["b"], stream)).alias("b"))

        left = F.floor(F.length(s["local"]) / 2).cast("int")
        halves = F.struct(F.substr(s["local"], F.lit(1), left).alias("a"), F.substr(s["local"], left + 1).alias("b"))
        return F.aggregate(turns(key), halves, step, lambda x: F.concat(x["a"], x["b"], F.substr(m, F.length(s["local"]) + 1)))

    local = F.substring_index(m, "@", 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(local, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    return let(F.struct(local.alias("local"), shape.alias("shape")), rounds)


def replaced(m: Column, key: Key) -> Column:
    """kind and text of a candidate's pseudonym; kind is null, and the text its own, where it isn't valid."""
    by = {"email": (EMAIL, email), "date": (DATE, date), "ip": (IP, ip), "ssn": (SSN, ssn), "phone": (PHONE, phone), "card": (CARD, card)}
    kind = F.when(F.contains(m, F.lit("@")), "email")
    for k in KINDS[1:]:
        kind = kind.when(m.rlike(f"^(?:{by[k][0]})$"), k)

    def of(kind: Column) -> Column:
        new = F.when(kind == "email", email(m, key))
        for k in KINDS[1:]:
            new = new.when(kind == k, by[k][1](m, key))
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, m).alias("text")))

    return let(kind, of)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", back: bool = False) -> DataFrame:
    """Adds pseudonymised (the text) and n_email, n_date, n_ip, n_ssn, n_phone and n_card (values replaced) to every row.

    What isn't valid stays: a number that fails its check, an octet over 255, a
    day that isn't in the calendar or outside 1800 to 2199, and so does an
    address whose local part has over 64 characters. A day has one pseudonym
    however often it is written in one way; year first and day first with two
    digits each agree in it, other ways of writing have their own. Null text
    gives null and zeros, a text without candidates itself. A value may lie at
    either end of a text of any length. Rows are independent: repeated ones
    have equal results. Input columns named as an added one are replaced;
    others are kept. The key is part of the plan: treat plans and logs as
    confidential as itself. With `back` pseudonyms are taken back.
    """
    own = Key(key, back)
    out = without(docs, *ADDED, "__found").withColumn("__found", F.when(F.col(text).rlike(MAYBE), F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda m: replaced(m, own))))
    woven = F.array_join(F.flatten(F.zip_with(F.split(F.col(text), ANY, -1), F.transform("__found", lambda x: x["text"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    count = lambda k: F.coalesce(F.size(F.filter("__found", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    new = F.when(F.size("__found") > 0, woven).otherwise(F.col(text))
    return out.withColumns({"pseudonymised": new} | {f"n_{k}": count(k) for k in KINDS}).drop("__found")


def restore(docs: DataFrame, key: str, *, text: str = "pseudonymised") -> DataFrame:
    """Adds restored: the text before pseudonymise with this key."""
    kept = without(docs, "restored").select(F.col(text).alias("__text"), F.struct("*").alias("__row"))
    return pseudonymise(kept, key, text="__text", back=True).select("__row.*", F.col("pseudonymised").alias("restored"))
