"""Format-preserving Feistel pseudonyms, by DataFrame functions only.

One pattern finds candidates in a text; each is validated (Luhn for card numbers, octets of IPv4 addresses, the calendar
for dates, the number plan for phones, group rules for social security numbers, mod 97 for IBANs) and then permuted by a
keyed Feistel network over exactly the values of its format, so the result is a valid value of the same format, equal
values stay equal everywhere, and the owner of the key can undo it with restore(). Mail addresses and quoted credentials
have no numeric domain: they get a keyed one-way pseudonym of the same shape. Anything that fails validation stays as it
is.

Domains: cards of 13 to 19 digits permute all but the check digit, which is computed anew; dates of 1800 to 2199 the
146,097 days of four centuries (189 * 773); IPv4 2**32; social security numbers the numbers that can be issued; IBANs
their last digits (two check digits computed anew; at most 16 trailing digits are permuted). Phones of country code 1 or
none are of the number plan if area and exchange lie in 200 to 999, and permute among such numbers; those that have the
shape but not the plan are personal data all the same and permute among each other; those of other country codes permute
ten digits.

Cases: a null text stays null, an empty one empty; null doc_ids and repeated rows are handled row by row; an empty table
stays empty; other columns pass unchanged, and `n_pseudonyms` replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_SECRET = r"(?:token|secret|password|passwd|api_key|apikey) ?[:=] ?\"[^\"\n]+\""
_PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
_GROUPS = r"[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}"
_DASHED = r"[0-9]+(?:-[0-9]+)+|[0-9]+(?:/[0-9]+)+"
_DOTTED = r"[0-9]+(?:\.[0-9]+)+"
_WORD = r"[A-Za-z0-9]*[0-9][A-Za-z0-9]*"
#: Alternatives in this order; each is a maximal run of its characters, so no look-around is needed.
PATTERN = "|".join((_MAIL, _SECRET, _PHONE, _GROUPS, _DASHED, _DOTTED, _WORD))
GATE = r"[0-9]|@|(?:token|secret|password|passwd|api_key|apikey) ?[:=] ?\""


def _number(text: Column) -> Column:
    return F.when(text == "", F.lit(0).cast("long")).otherwise(text.cast("long"))


def _round(key: str, kind: str, i: Column, value: Column) -> Column:
    """60 keyed bits of a value."""
    return F.conv(F.substr(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value.cast("string")), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, back: bool = False) -> Column:
    """A struct (l, r): the permuted pair within left_size * right_size values. Even rounds add to l, odd ones to r; back undoes it."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        add = lambda a, b: a - b if back else a + b
        l = F.when(even, F.pmod(add(acc["l"], _round(key, kind, i, acc["r"])), left_size.cast("long"))).otherwise(acc["l"])
        r = F.when(even, acc["r"]).otherwise(F.pmod(add(acc["r"], _round(key, kind, i, acc["l"])), right_size.cast("long")))
        return F.struct(l.alias("l"), r.alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A digit string of up to 36 digits permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    pair = feistel(_number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, n - half)), _ten(half), _ten(n - half), key, kind, back)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))[0]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is a check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _with_luhn(body: Column) -> Column:
    return F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))[0]


def _like(shape: Column, digits: Column) -> Column:
    """digits in the places of the digits of shape."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda acc, c: F.when((c >= "0") & (c <= "9"), F.struct(F.concat(acc["out"], F.substr(digits, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


def _card(m: Column, key: str, back: bool = False) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back)
    return _like(m, _with_luhn(body))


PLAN, AREAS, LINES = 200, 800, 10_000


def _phone(m: Column, key: str, back: bool = False) -> Column:
    """Of the number plan: area and exchange from PLAN to 999, each in place."""

    def written(area: Column, exchange: Column, line: Column) -> Column:
        return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad(exchange.cast("string"), 3, "0"), F.lpad(line.cast("string"), 4, "0"))

    d = F.regexp_replace(m, "[^0-9]", "")
    keep = F.length(d) - 10
    area, exchange, line = (F.substr(d, keep + at, F.lit(n)).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    ten = lambda pair, f: F.transform(F.array(pair), f)[0]
    plan = ten(feistel((area - PLAN) * 100 + F.floor(line / 100), (exchange - PLAN) * 100 + line % 100, F.lit(AREAS * 100), F.lit(AREAS * 100), key, "phone", back), lambda p: written(F.floor(p["l"] / 100) + PLAN, F.floor(p["r"] / 100) + PLAN, p["l"] % 100 * 100 + p["r"] % 100))
    # outside the plan: any exchange of the areas below PLAN, then the exchanges below PLAN of the others
    place = F.when(area < PLAN, area * 1000 + exchange).otherwise(PLAN * 1000 + (area - PLAN) * PLAN + exchange)
    low = PLAN * 1000
    shape = ten(feistel(place, line, F.lit(low + AREAS * PLAN), F.lit(LINES), key, "phone shape", back), lambda p: F.when(p["l"] < low, written(F.floor(p["l"] / 1000), p["l"] % 1000, p["r"])).otherwise(written(F.floor((p["l"] - low) / PLAN) + PLAN, (p["l"] - low) % PLAN, p["r"])))
    abroad = permuted_digits(F.substr(d, keep + 1, F.lit(10)), key, "phone abroad", back)
    new = F.when((keep > 0) & (F.substr(d, F.lit(1), keep) != "1"), abroad).when((area >= PLAN) & (exchange >= PLAN), plan).otherwise(shape)
    return _like(m, F.concat(F.substr(d, F.lit(1), keep), new))


def _ip(m: Column, key: str, back: bool = False) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4", back)
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))[0]


_FIRST_DAY = "1800-01-01"


def _date_value(m: Column) -> Column:
    """The date of yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy or dd.mm.yyyy, or null if there is no such day in 1800-2199."""
    p = F.split(m, r"[-/.]")
    front = m.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$")
    back = m.rlike(r"^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$")
    iso = F.when(front, F.concat_ws("-", p[0], p[1], p[2])).when(back, F.concat_ws("-", p[2], p[1], p[0]))
    day = iso.try_cast("date")
    return F.when(day.between(F.lit(_FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), day)


def _date(m: Column, key: str, back: bool = False) -> Column:
    at = F.datediff(_date_value(m), F.lit(_FIRST_DAY).cast("date")).cast("long")
    pair = feistel(F.floor(at / 773), at % 773, F.lit(189), F.lit(773), key, "date", back)
    day = F.transform(F.array(pair), lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * 773 + p["r"]).cast("int")))[0]
    return F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(m.rlike("^[0-9]{4}/"), F.date_format(day, "yyyy/MM/dd")).when(m.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))


def _ssn(m: Column, key: str, back: bool = False) -> Column:
    """Areas 001-899 without 666 (898), groups 01-99, serials 0001-9999, each in place: the domain is 898 * 99 by 9999."""
    a = F.substr(m, F.lit(1), F.lit(3)).cast("long")
    head = (F.when(a > 666, a - 2).otherwise(a - 1)) * 99 + F.substr(m, F.lit(5), F.lit(2)).cast("long") - 1
    pair = feistel(head, F.substr(m, F.lit(8), F.lit(4)).cast("long") - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)

    def written(p: Column) -> Column:
        area = F.floor(p["l"] / 99)
        area = F.when(area + 1 >= 666, area + 2).otherwise(area + 1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.transform(F.array(pair), written)[0]


def _mod97(rearranged: Column) -> Column:
    """The remainder by 97 of an IBAN whose first four characters stand at its end."""
    code = lambda c: F.when((c >= "0") & (c <= "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(rearranged, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when((c >= "0") & (c <= "9"), 10).otherwise(100) + code(c)) % 97))


def _iban(m: Column, key: str, back: bool = False) -> Column:
    tail = F.regexp_extract(F.substr(m, F.lit(5), F.length(m) - 4), "[0-9]{1,16}$", 0)
    body = F.concat(F.substr(m, F.lit(5), F.length(m) - 4 - F.length(tail)), permuted_digits(tail, key, "iban", back))
    country = F.substr(m, F.lit(1), F.lit(2))
    return F.transform(F.array(body), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))[0]


def _mail(m: Column, key: str) -> Column:
    h = F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(m)), 256)
    return F.concat(F.lit("user."), F.substr(h, F.lit(1), F.lit(12)), F.lit("@"), F.substr(h, F.lit(13), F.lit(8)), F.lit(".example.invalid"))


def _secret(m: Column, key: str) -> Column:
    """The quoted value gives way to as many hex digits of its keyed hash (at most 64 different ones, repeated)."""
    value = F.regexp_extract(m, '"([^"]+)"', 1)
    h = F.sha2(F.concat(F.lit(f"{key}|secret|"), value), 256)
    shown = F.substr(F.repeat(h, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value))
    return F.concat(F.regexp_extract(m, '^[^"]*"', 0), shown, F.lit('"'))


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes its validation, else null."""
    d = F.regexp_replace(m, "[^0-9]", "")
    octets = F.split(m, r"\.")
    return (
        F.when(m.contains("@"), F.lit("mail"))
        .when(m.contains('"'), F.lit("secret"))
        .when(m.contains("("), F.lit("phone"))
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), F.lit("card")))
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda x: (x.cast("int") < 256) & ((F.length(x) == 1) | ~x.startswith("0"))), F.lit("ipv4")))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit("ssn")))
        .when(m.rlike(r"^(?:[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})$"), F.lit("phone"))
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.when(_mod97(F.concat(F.substr(m, F.lit(5), F.length(m) - 4), F.substr(m, F.lit(1), F.lit(4)))) == 1, F.lit("iban")))
        .when(_date_value(m).isNotNull(), F.lit("date"))
    )


TWO_WAY = (("phone", _phone), ("card", _card), ("ipv4", _ip), ("ssn", _ssn), ("iban", _iban), ("date", _date))


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    out = m
    for name, f in () if back else (("mail", _mail), ("secret", _secret)):
        out = F.when(kind == name, f(m, key)).otherwise(out)
    for name, f in TWO_WAY:
        out = F.when(kind == name, f(m, key, back)).otherwise(out)
    return out


def restore(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """What pseudonymise() did undone by the same key: numbers and dates come back, mail addresses and credentials don't."""
    return pseudonymise(docs, key, column, back=True)


def pseudonymise(docs: DataFrame, key: str, column: str = "text", back: bool = False) -> DataFrame:
    """docs with pseudonyms in `column`, and n_pseudonyms, the number of replaced values in the row."""
    rest = [c for c in docs.columns if c != "n_pseudonyms"]
    text = F.col(f"`{column}`")
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    marked = docs.select(*(F.col(f"`{c}`") for c in rest), F.when(text.rlike(GATE), found).alias("_found"))
    some = F.exists("_found", lambda x: x["kind"].isNotNull())
    swapped = F.transform("_found", lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["kind"], key, back)))
    pieces = F.zip_with(F.split(text, PATTERN, -1), swapped, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    new_text = F.when(some, F.array_join(pieces, "")).otherwise(text)
    n = F.coalesce(F.size(F.filter("_found", lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long")
    return marked.select(*(new_text.alias(c) if c == column else F.col(f"`{c}`") for c in rest), F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_pseudonyms"))


#: The key of the registered query; a deployment passes its own.
KEY = "public-test-key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
