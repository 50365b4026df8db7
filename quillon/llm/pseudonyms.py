"""Format-preserving pseudonyms for personal data, with SQL functions only.

Values are found by one pattern, validated, and replaced by a keyed permutation of the same format,
so equal values get equal pseudonyms in every document and different values never get the same:

    card     13 to 19 digits with a valid Luhn sum  ->  same first digit, valid sum
    phone    NANP number, in its own punctuation    ->  valid NANP number
             other ten digits in phone notation     ->  ten digits that are no NANP number
    ssn      valid area, group and serial           ->  valid area, group and serial
    ip       four octets                            ->  four octets
    date     a calendar day of 1700 to 2099         ->  such a day, in the same notation
    email    local part (the domain stays)          ->  letters to letters, digits to digits
    secret   access keys and values after password, token, secret, api_key  ->  likewise

Where a run of up to 19 digits fails the Luhn sum, the longest valid run between its blanks or
hyphens is the card. Its pseudonym is drawn again where it would make a longer run valid, so that
`reveal` finds the same run; it then differs from that of the card standing alone.

Numbers are permuted by an alternating Feistel network on Z_a x Z_b, where a * b is exactly the
number of values of the format, so no value ever leaves it. Strings are permuted by the same network
over two halves of characters, each shifted within its own class. Round functions are SHA-256 of
key, format, round and the other half. `reveal=True` runs the rounds backwards.

A text is split at the pattern once; it is one projection without a shuffle, and texts without a
digit or @ are not searched. Defined results: null stays null with 0 replacements; a candidate that
fails its validation stays as it is; other columns are kept and clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

ROUNDS, STRING_ROUNDS = 8, 4
#: Draws of a card inside a longer run; each fails with a probability of about 1/10 for each longer run.
WALK = 32
#: The session setting that holds the key; its name is one that Spark redacts. The registered query
#: has a key of its own where it is unset, as its pseudonyms protect nobody.
KEY_SETTING, QUERY_KEY = "spark.quillon.pseudonym.secret", "registered-query"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
NANP = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
#: Any ten digits, with +1, parentheses or hyphens and dots, which plain figures do not have.
DIGITS10 = r"\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|(?:1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
PHONE = rf"(?<![0-9+])(?:{NANP}|{DIGITS10})(?![0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:(?:1[7-9]|20)[0-9]{2}([/-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2(?:1[7-9]|20)[0-9]{2})(?![0-9])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?[^\s\"]{6,})"
PATTERN = "|".join((SECRET, EMAIL, PHONE, IP, SSN, DATE, CARD))
_SECRET_HEAD = r"^(?:AKIA|(?i:password|passwd|pwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?)"
#: Day 0 of the 400 Gregorian years from 1700; 400 years have 189 * 773 days.
_FIRST_DAY, _DAYS = "1700-01-01", (189, 773)


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def prf(key: str, tag: Column, step: Column, value: Column, size: Column) -> Column:
    """A keyed number below size."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, step.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"), size)


def permute(index: Column, a, b, tag: str | Column, key: str, reveal: bool = False) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    a, b = _long(a), _long(b)
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    sign = F.lit(-1 if reveal else 1).cast("bigint")
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.call_function("div", index, b).alias("l"), F.pmod(index, b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + sign * prf(key, tag, i, s["r"], a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * prf(key, tag, i, s["l"], b), b).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(steps, start, turn, lambda s: s["l"] * b + s["r"])


def permute_text(text: Column, tag: str, key: str, reveal: bool = False) -> Column:
    """A keyed permutation of strings of one pattern of digits, lower and upper case letters."""
    sign = -1 if reveal else 1
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    steps = F.sequence(F.lit(STRING_ROUNDS - 1), F.lit(0), F.lit(-1)) if reveal else F.sequence(F.lit(0), F.lit(STRING_ROUNDS - 1))

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            low, size = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65), F.when(c.between("0", "9"), 10).otherwise(26)
            by = prf(key, F.lit(tag), F.concat_ws(".", i.cast("string"), at.cast("string")), other, size.cast("bigint"))
            return F.when(low.isNull(), c).otherwise(F.chr(low + F.pmod(F.ascii(c) - low + sign * by, size)))

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.split(part, "(?!^)(?!$)"), one), ""))

    def turn(s: Column, i: Column) -> Column:
        left = F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        return F.when(i % 2 == 0, left).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r")))

    return F.aggregate(steps, start, turn, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced one by one."""
    def one(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _card(m: Column, key: str, reveal: bool) -> Column:
    d = _digits(m)
    n = F.length(d) - 2
    a, b = _power(F.ceil(n / 2).cast("int")), _power(F.floor(n / 2).cast("int"))
    body = permute(F.substring(d, F.lit(2), n).cast("bigint"), a, b, F.concat(F.lit("card"), n.cast("string")), key, reveal)
    head = F.concat(F.substring(d, 1, 1), F.lpad(body.cast("string"), n, "0"))
    check = F.pmod(-luhn_sum(F.concat(head, F.lit("0"))), F.lit(10))
    return _refill(m, F.concat(head, check.cast("string")))


def _card_run(m: Column) -> Column:
    """(n, at) of the longest, then first run of m between its blanks and hyphens that is a valid card, n negative."""
    at = F.sequence(F.lit(1), F.length(m))
    mark = lambda i: ~F.substring(m, i, F.lit(1)).between("0", "9")
    starts = F.filter(at, lambda i: (i == 1) | ((i > 1) & mark(i - 1)))
    ends = F.filter(at, lambda i: (i == F.length(m)) | mark(i + 1))
    runs = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda e: e > a), lambda e: F.struct((a - e - 1).alias("n"), a.alias("at")))))

    def valid(x: Column) -> Column:
        d = _digits(F.substring(m, x["at"], -x["n"]))
        return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)

    return F.get(F.array_sort(F.filter(runs, valid)), F.lit(0))


def _card_within(m: Column, key: str, reveal: bool) -> Column:
    """m with the valid card in it replaced, null if there is none."""
    def made(run: Column) -> Column:
        before, after = F.substring(m, F.lit(1), run["at"] - 1), F.substring(m, run["at"] - run["n"], F.length(m))

        def draw(s: Column, _: Column) -> Column:
            new = F.transform(F.array(s["v"]), lambda v: _card(v, key, reveal))
            tried = F.transform(new, lambda v: F.struct(v.alias("v"), (_card_run(F.concat(before, v, after)) == run).alias("done")))
            return F.when(s["done"], s).otherwise(F.get(tried, F.lit(0)))

        start = F.struct(F.substring(m, run["at"], -run["n"]).alias("v"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, draw, lambda s: F.concat(before, s["v"], after))

    return F.get(F.transform(F.filter(F.array(_card_run(m)), lambda x: x.isNotNull()), made), F.lit(0))


def _phone(m: Column, key: str, reveal: bool) -> Column:
    d = F.right(_digits(m), F.lit(10))
    index = ((F.substring(d, 1, 3).cast("bigint") - 200) * 800 + F.substring(d, 4, 3).cast("bigint") - 200) * 10000 + F.substring(d, 7, 4).cast("bigint")
    x = permute(index, 80_000, 80_000, "phone", key, reveal)
    made = F.concat((F.floor(x / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(x / 10_000), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(x, F.lit(10_000)).cast("string"), 4, "0"))
    # The 3.6 * 10^9 other numbers: an area below 200, then an area from 200 with an exchange below 200.
    rest = F.when(d < "2", d.cast("bigint")).otherwise(2_000_000_000 + ((F.substring(d, 1, 3).cast("bigint") - 200) * 200 + F.substring(d, 4, 3).cast("bigint")) * 10_000 + F.substring(d, 7, 4).cast("bigint"))
    y = permute(rest, 60_000, 60_000, "phone10", key, reveal)
    z = y - 2_000_000_000
    other = F.when(z < 0, y).otherwise((F.call_function("div", z, _long(2_000_000)) + 200) * 10_000_000 + F.pmod(z, F.lit(2_000_000)))
    made = F.when(d.rlike("^[2-9][0-9]{2}[2-9]"), made).otherwise(F.lpad(other.cast("string"), 10, "0"))
    return _refill(m, F.concat(F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 10), made))


def _ip(m: Column, key: str, reveal: bool) -> Column:
    octet = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("bigint")
    x = permute(((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4), 65_536, 65_536, "ip", key, reveal)
    return F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _ssn(m: Column, key: str, reveal: bool) -> Column:
    area = F.split_part(m, F.lit("-"), F.lit(1)).cast("bigint")
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    x = permute((area * 99 + F.split_part(m, F.lit("-"), F.lit(2)).cast("bigint") - 1) * 9999 + F.split_part(m, F.lit("-"), F.lit(3)).cast("bigint") - 1, 898 * 99, 9999, "ssn", key, reveal)
    area = F.floor(x / (99 * 9999))
    area = F.when(area >= 665, area + 2).otherwise(area + 1)
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(x / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(x, F.lit(9999)) + 1).cast("string"), 4, "0"))


def _day(m: Column) -> Column:
    """The day that a date names, null if there is none; month first between slashes."""
    iso = F.when(m.rlike("^[0-9]{4}"), F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
    iso = iso.when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.try_to_date(iso.otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))), "yyyy-MM-dd")


def _date(m: Column, key: str, reveal: bool) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")
    x = F.date_add(first, permute(F.datediff(_day(m), first).cast("bigint"), *_DAYS, "date", key, reveal).cast("int"))
    y, mo, d = (F.lpad(f(x).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2)))
    mark = F.substring(m, 5, 1)
    return F.when(m.rlike("^[0-9]{4}"), F.concat(y, mark, mo, mark, d)).when(m.contains("."), F.concat_ws(".", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))


def pseudonym(m: Column, key: str, reveal: bool = False) -> Column:
    """The pseudonym of one match of PATTERN; the match itself where it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    local = F.regexp_extract(m, "^[^@]+", 0)
    head = F.regexp_extract(m, _SECRET_HEAD, 0)
    made = (
        F.when(whole(SECRET), F.concat(head, permute_text(F.substring(m, F.length(head) + 1, F.length(m)), "secret", key, reveal)))
        .when(m.contains("@"), F.concat(permute_text(local, "email", key, reveal), F.substring(m, F.length(local) + 1, F.length(m))))
        .when(whole(PHONE), _phone(m, key, reveal))
        .when(whole(IP), _ip(m, key, reveal))
        .when(whole(SSN), _ssn(m, key, reveal))
        .when(whole(DATE), F.when(_day(m).isNotNull(), _date(m, key, reveal)).otherwise(m))
        .when(whole(CARD) & (luhn_sum(_digits(m)) % 10 == 0), _card(m, key, reveal))
        .when(whole(CARD), _card_within(m, key, reveal))
    )
    return F.coalesce(made, m)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, reveal: bool = False) -> DataFrame:
    """docs with the text pseudonymised, and n_replaced. The key is an argument or the session's
    setting KEY_SETTING; without either it is an error. It is a literal of the plan, so keep plans and
    event logs as safe as the key."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key or set {KEY_SETTING}")
    found, made = free_name(docs, "pii_found"), free_name(docs, "pii_made")
    docs = docs.drop("n_replaced")
    may = F.col(text).rlike(r"[0-9@]|(?i:password|passwd|pwd|token|secret|api_key)")
    rows = docs.withColumn(found, F.when(may, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(made, F.transform(found, lambda m: pseudonym(m, key, reveal)))
    between = F.split(F.col(text), PATTERN, -1)
    filled = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(F.col(made), i), F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda x: x))
    out = [F.when(F.size(found) > 0, filled).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out, F.when(F.size(found) > 0, changed).otherwise(F.lit(0)).cast("bigint").alias("n_replaced"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get(KEY_SETTING, QUERY_KEY))
