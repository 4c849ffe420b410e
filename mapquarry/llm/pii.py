"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern and validated (check digits, octet ranges, calendar, number
plans). Every repeat of a group is bounded, as the regular expression engine takes stack for each turn
of one; repeats of a single class aren't groups. A keyed Feistel network permutes each valid value within its own format: the two halves
of the value's rank are added, in turn, to a keyed hash of the other half modulo the half's size.
The network is a bijection for a fixed key, so equal values get equal pseudonyms in every document
and different values stay different. Check digits are recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feistel rounds, and characters that one network permutes (longer strings are cut).
ROUNDS, CHUNK = 8, 24
#: The key of a production run comes from the caller; this one keeps runs comparable.
KEY = "mapquarry-demo-key"

# Patterns of the candidates.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
IPV4 = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE_ISO = r"(?<![0-9A-Za-z/.-])[12][0-9]{3}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])(?![0-9]|[-/.][0-9])"
DATE_DAY = r"(?<![0-9A-Za-z/.-])[0-9]{1,2}[-/.][0-9]{1,2}[-/.][12][0-9]{3}(?![0-9]|[-/.][0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
PHONE_WORLD = r"(?<![0-9A-Za-z])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z])"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
HEX_KEY = r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,256}+(?![0-9A-Za-z])"
#: Country calling codes of one and two digits; all others have three.
CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: One scan: most places fail at the first look-behind or at the first character of a group.
ANY = (
    rf"(?<![0-9A-Za-z])(?:{EMAIL}|(?=[0-9+(])(?:{'|'.join((IPV4, SSN, DATE_ISO, DATE_DAY, PHONE, CARD, PHONE_WORLD))})"
    rf"|(?=[A-Z]{{2}})(?:{IBAN}|{ACCESS_KEY})|{HEX_KEY})"
)
#: A text without these has no candidate at all.
HINT = "[0-9@]|AKIA"

# Alphabets by radix, as the characters they use and as the digits of that radix.
LETTERS, BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Days from the first date that is permuted; 400 years have 189 * 773 days.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1700-01-01", 189, 773


def _hash(key: Column, tweak: Column, i: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, tweak, i, x), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: Column, tweak: Column) -> Column:
    """Keyed permutation of pairs with ``left < left_size`` and ``right < right_size``."""

    def turn(acc: Column, i: Column) -> Column:
        a, b = acc["l"], acc["r"]
        return F.when(
            i % 2 == 0, F.struct(((a + _hash(key, tweak, i, b)) % left_size).alias("l"), b.alias("r"))
        ).otherwise(F.struct(a.alias("l"), ((b + _hash(key, tweak, i, a)) % right_size).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(radix: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(radix**k) for k in range(CHUNK // 2 + 1)]), n + 1)


def permute(s: Column, radix: int, key: Column, tweak: str) -> Column:
    """Permutation of the strings of ``s``'s length over the first ``radix`` of ``0-9a-z``."""

    def chunk(i: Column) -> Column:
        part = F.substr(s, i * CHUNK + 1, F.lit(CHUNK))
        n = F.length(part)
        a, b = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
        number = lambda x: F.coalesce(F.conv(x, radix, 10).cast("long"), F.lit(0).cast("long"))
        out = feistel(
            number(F.substr(part, F.lit(1), a)), number(F.substr(part, a + 1, b)), _power(radix, a), _power(radix, b),
            key, F.concat(F.lit(tweak), n, F.lit("."), i),
        )
        digits = lambda x, w: F.when(w > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), w, F.lit("0"))).otherwise("")
        return F.transform(F.array(out), lambda o: F.concat(digits(o["l"], a), digits(o["r"], b)))[0]

    chunks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / CHUNK).cast("int"))
    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(chunks, chunk), ""))


def only(m: Column, pattern: str) -> Column:
    return F.regexp_replace(m, pattern, "")


def refill(m: Column, wanted: str, new: Column) -> Column:
    """``m`` with its characters of class ``[wanted]`` replaced in turn by those of ``new``."""
    keep = f"[^{wanted}]"

    def at(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        k = F.length(only(F.substr(m, F.lit(1), i), keep))
        return F.when(c.rlike(f"[{wanted}]"), F.substr(new, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def luhn(digits: Column) -> Column:
    """Check digit of a number without one."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def mod97(s: Column) -> Column:
    """Remainder of a string of digits and capital letters (A = 10 ... Z = 35) by 97."""
    step = lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    digits = only(m, "[^0-9]")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    good = F.length(digits).between(13, 19) & (luhn(body) == F.substr(digits, F.length(digits), F.lit(1))) & only(digits, "0").cast("string").rlike(".")
    made = F.transform(F.array(permute(body, 10, key, "card")), lambda b: F.concat(b, luhn(b)))[0]
    return F.when(good, refill(m, "0-9", made)).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    digits = only(m, "[^0-9]")
    head, tail = F.substr(digits, F.lit(1), F.length(digits) - 10), F.substr(digits, F.length(digits) - 9, F.lit(10))
    area = F.substring(tail, 1, 3).cast("int") - 200
    line = (F.substring(tail, 4, 3).cast("long") - 200) * 10000 + F.substring(tail, 7, 4).cast("long")
    out = feistel(area, line, F.lit(800), F.lit(8_000_000), key, F.lit("phone"))
    made = F.transform(
        F.array(out), lambda o: F.concat(head, o["l"] + 200, F.floor(o["r"] / 10000) + 200, F.lpad((o["r"] % 10000).cast("string"), 4, "0"))
    )[0]
    return refill(m, "0-9", made)


def _phone_world(m: Column, key: Column) -> Column:
    """Country code, separators, a trunk zero and the first national digit (the number plan's kind) stay.

    A number has 7 to 15 digits and at least 4 of them after those that stay. A North American number is the same
    value with and without its +1 and separators, so it goes the way of those.
    """
    digits = only(m, "[^0-9]")
    american = m.startswith("+") & digits.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$")
    head = F.regexp_extract(digits, rf"^(?:{CODES}|[0-9]{{3}})0?[0-9]", 0)
    tail = F.substr(digits, F.length(head) + 1, F.length(digits))
    good = F.length(digits).between(7, 15) & (F.length(head) > 0) & (F.length(tail) >= 4)
    return F.when(american, _phone(m, key)).when(good, refill(m, "0-9", F.concat(head, permute(tail, 10, key, "world")))).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = F.transform(
        F.array(out),
        lambda o: F.concat_ws("-", pad(F.when(o["l"] < 665, o["l"] + 1).otherwise(o["l"] + 2), 3), pad(F.floor(o["r"] / 9999) + 1, 2), pad(o["r"] % 9999 + 1, 4)),
    )[0]
    return F.when(good, made).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    p = [F.split(m, "\\.")[k].cast("int") for k in range(4)]
    out = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    byte = lambda x: F.concat_ws(".", F.floor(x / 256), x % 256)
    return F.transform(F.array(out), lambda o: F.concat_ws(".", byte(o["l"]), byte(o["r"])))[0]


def _date(m: Column, key: Column) -> Column:
    """Calendar dates of 1700-2099 with the year first or last; of two readings day first is tried last.

    Separators, order and leading zeros stay. A day or month written with one digit gets a second one where the new date
    needs it: all spellings of a date are one value, which comes before the width.
    """
    p = F.split(m, "[-/.]")
    year_first = F.length(p[0]) == 4
    y = F.when(year_first, p[0]).otherwise(p[2]).cast("int")
    dot = m.contains(".")
    month_first = ~year_first & ~dot & (p[0].cast("int") <= 12)
    mo = F.when(year_first, p[1]).when(month_first, p[0]).otherwise(p[1]).cast("int")
    d = F.when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0]).cast("int")
    day = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    out = feistel(F.floor(at / DAYS_RIGHT), at % DAYS_RIGHT, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key, F.lit("date"))
    sep = F.regexp_extract(m, "[-/.]", 0)
    wide = lambda x, like: F.lpad(x.cast("string"), F.greatest(F.length(like), F.length(x.cast("string"))), F.lit("0"))

    def spell(o: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (o["l"] * DAYS_RIGHT + o["r"]).cast("int"))
        yy, mm, dd = F.year(new).cast("string"), F.month(new), F.dayofmonth(new)
        return (
            F.when(year_first, F.concat(yy, sep, wide(mm, p[1]), sep, wide(dd, p[2])))
            .when(month_first, F.concat(wide(mm, p[0]), sep, wide(dd, p[1]), sep, yy))
            .otherwise(F.concat(wide(dd, p[0]), sep, wide(mm, p[1]), sep, yy))
        )

    good = day.isNotNull() & at.between(0, DAYS_LEFT * DAYS_RIGHT - 1)
    return F.when(good, F.transform(F.array(out), spell)[0]).otherwise(m)


def _iban(m: Column, key: Column) -> Column:
    flat = only(m, " ")
    country, body = F.substring(flat, 1, 2), F.substr(flat, F.lit(5), F.length(flat))
    good = (mod97(F.concat(body, F.substring(flat, 1, 4))) == 1) & F.length(flat).between(15, 34)
    fresh = refill(body, "0-9", permute(only(body, "[^0-9]"), 10, key, "iban"))
    made = F.transform(
        F.array(fresh), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    )[0]
    return F.when(good, refill(m, "0-9A-Z", made)).otherwise(m)


def _email(m: Column, key: Column) -> Column:
    """The local part, lower-cased: its letters and its digits are permuted; the domain stays."""
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
    letters = permute(F.translate(only(local, "[^a-z]"), LETTERS, BASE26), 26, key, "mail")
    spelled = refill(local, "a-z", F.translate(letters, BASE26, LETTERS))
    return F.concat(refill(spelled, "0-9", permute(only(local, "[^0-9]"), 10, key, "mail-digits")), F.lit("@"), domain)


def _access_key(m: Column, key: Column) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(permute(F.lower(F.substr(m, F.lit(5), F.lit(16))), 36, key, "access")))


def _hex_key(m: Column, key: Column) -> Column:
    return permute(m, 16, key, "hex")


KINDS = (
    ("email", EMAIL, _email), ("ip", IPV4, _ip), ("iban", IBAN, _iban), ("ssn", SSN, _ssn), ("date", DATE_ISO, _date),
    ("date", DATE_DAY, _date), ("phone", PHONE, _phone), ("card", CARD, _card), ("phone", PHONE_WORLD, _phone_world),
    ("access_key", ACCESS_KEY, _access_key), ("hex_key", HEX_KEY, _hex_key),
)


def pseudonym(m: Column, key: Column) -> tuple[Column, Column]:
    """Kind and pseudonym of a candidate; an invalid candidate keeps its text."""
    kind, new = F.lit("none"), m
    for name, pattern, make in reversed(KINDS):
        whole = m.rlike(rf"\A(?:{pattern})\z")
        kind, new = F.when(whole, F.lit(name)).otherwise(kind), F.when(whole, make(m, key)).otherwise(new)
    return kind, new


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, text, n_replaced, kinds (of the replaced values, in order).

    A null text stays null and an empty one empty, with 0 replacements. Whatever isn't a valid value
    stays as it is, to the character: so do parts of runs too long for their kind (a local part of more
    than 64 characters, a label of more than 63, a hexadecimal run of more than 256). Texts of any length are scanned whole. A null doc_id
    stays null; repeated rows are rewritten each, alike; other columns are ignored; an empty table
    gives none.
    """
    k = F.lit(key)

    def of(m: Column) -> Column:
        kind, new = pseudonym(m, k)
        return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))

    hinted = F.col("text").rlike(HINT)
    found = F.when(hinted, F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), of))
    changed = F.filter("found", lambda x: x["old"] != x["new"])
    pieces = F.zip_with(F.split("text", ANY, -1), F.col("found"), lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit(""))))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("found", found).select(
        "doc_id", F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), F.greatest(F.size(changed), F.lit(0)).alias("n_replaced"),
        F.coalesce(F.transform(changed, lambda x: x["kind"]), F.array().cast("array<string>")).alias("kinds"),
    )
