"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates are found by pattern, validated, and permuted under a key within their own
format, so that equal values stay equal across documents, different ones stay different, and a
value's form (digits, separators, check digits) is kept. The permutation is an alternating
Feistel network over a product of two ranges, ``left`` below a and ``right`` below b, with
rounds keyed by SHA-256; any a and b will do, so each format permutes exactly its valid values:

card      all digits but the first and the check digit, which is worked out again (Luhn)
phone     the last ten digits of a number, or all but the first of a shorter one
ssn       the valid combinations of area, group and serial number
iban      the digits of the account part; check digits are worked out again (modulo 97)
ip        the four octets
date      the days of its century, written as it was (year first, or day and month first)

E-mail addresses, access keys and assigned secrets have no number format: their signs become
keyed digests of the same length (addresses: of fixed length), again equal for equal values.

A number that fails validation is left as it is. Defined results: a null text stays null, with
no finds; an empty one stays empty. Where two forms fit, the one that begins first counts, then the one
listed first. Repeated rows are treated alike, an empty table gives no row; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "secret", "ip", "date", "ssn", "iban", "card", "phone")
#: The forms looked for, the first that fits counts.
#: No more labels than a domain name can have: a group that is repeated without bound costs the
#: regex engine stack for each repetition.
EMAIL = r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
ACCESS_KEY = r"\bA(?:KI|SI)A[0-9A-Z]{16}\b"
SECRET = (
    r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key))[ ]?[=:][ ]?[\"']?"
    r"(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{8,}"
)
#: Four numbers behind a word for a version are one.
IP = (
    r"(?<![\w.])(?<![Vv]ersion[ ])(?<![Vv]er\.[ ])(?<![Rr]elease[ ])(?<![Bb]uild[ ])"
    r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
)
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?<ds>[./])\d{1,2}\k<ds>\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Registered countries by the length of their numbers.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    end = f"[ ]?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{groups}}}{end}"


#: The length that the country has, or else any (see ``_iban`` for words behind it).
IBAN = (
    rf"\b(?:{'|'.join(_iban_of(*x) for x in IBAN_COUNTRIES.items())}"
    r"|[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)\b"
)
CARD = (
    r"(?<![\d-])(?:\d{13,19}|\d{4}(?<cs>[ -])\d{4}\k<cs>\d{4}\k<cs>\d{1,7}"
    r"|3\d{3}(?<as>[ -])\d{6}\k<as>\d{5})(?![\d-])"
)
#: One more digit of a number, unless a date, an SSN, an address or a card begins there.
_MORE = (
    r"(?:\d|\.\d|[ -](?!\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d\d-\d\d|\d{3}-\d\d-\d{4}"
    r"|(?:\d{1,3}\.){3}\d|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|3\d{3}[ -]\d{6}[ -]\d|\d{13})\d)"
)
#: A leading 0 that neither goes on a longer number nor begins a date.
_ZERO = r"(?<![\w+])(?<!\d[.,/-])(?!\d{1,2}[ ./-]\d{1,2}[ ./-]\d{4}(?!\d))"
#: + and groups; an area code in brackets; three, three and four digits with one separator, as
#: in North America; France and Spain; + or 00 and groups; 0, an area code and groups. Groups of
#: digits with none of these are figures, not numbers to call.
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,5}(?![\w-])"
    r"|(?<![\w+])\((?:[2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]\d{4}|0\d{1,4}\)[ .-]?\d{3,4}[ .-]\d{3,5})(?![\w-])"
    r"|(?<![\w+])(?<!\d[.,/-])[2-9]\d{2}(?<ps>[ .-])[2-9]\d{2}\k<ps>\d{4}(?![\w-])(?![.,]\d)"
    r"|(?<![\w+])\+\d{8,15}(?!\d)"
    r"|(?<![\w+])(?:\+33(?:[ .-]?\(0\))?|\+34)(?:[ .-]?\d){9}(?!\d)"
    rf"|{_ZERO}0[1-9](?:[ .-]\d{{2}}){{4}}(?!\d)"
    rf"|(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(0\)[ .-]?\d{_MORE}{{3,10}}|\(\d{{1,4}}\)[ .-]?\d{_MORE}{{3,7}})"
    r"(?!\d)"
    rf"|(?<![\w+])\+\d{_MORE}{{7,14}}(?!\d)"
    rf"|{_ZERO}(?=00[1-9]\d{{0,3}}[ .-]\d)00{_MORE}{{6,13}}(?!\d)"
    rf"|{_ZERO}0[1-9]\d{{0,4}}(?=[ ./-])(?:/\d|{_MORE}){_MORE}{{2,8}}(?!\d)"
)
FOUND = "|".join([EMAIL, ACCESS_KEY, SECRET, IP, DATE, SSN, IBAN, CARD, PHONE])
#: What every form has; texts without it are not searched further.
HINT = r"[0-9@]|A(?:KI|SI)A|(?i:token|password|passwd|pwd|secret|api[_-]?key)"


def _number(text: Column, kind: str = "bigint") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs ``left < a, right < b``, as a struct ``l, r``."""

    def code(step: Column, half: Column) -> Column:
        digest = F.substring(_keyed(key, tweak, step, half), 1, 13)
        return F.conv(digest, 16, 10).cast("bigint")

    def turn(state: Column, step: Column) -> Column:
        on_left = F.struct(
            F.pmod(state["l"] + F.pmod(code(step, state["r"]), a), a).alias("l"),
            state["r"].alias("r"),
        )
        on_right = F.struct(
            state["l"].alias("l"),
            F.pmod(state["r"] + F.pmod(code(step, state["l"]), b), b).alias("r"),
        )
        return F.when(step % 2 == 0, on_left).otherwise(on_right)

    first = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of digits as another of the same length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    pair = feistel(
        _number(F.substring(digits, F.lit(1), half)),
        _number(F.substring(digits, half + 1, rest)),
        _ten_to(half),
        _ten_to(rest),
        key,
        F.concat(tweak, F.length(digits).cast("string")),
    )
    return _let(
        pair,
        lambda p: F.concat(
            F.when(half > 0, F.lpad(p["l"].cast("string"), half, "0")).otherwise(""),
            F.lpad(p["r"].cast("string"), rest, "0"),
        ),
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _signs(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def in_place(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, one by one, by ``digits``."""

    def write(state: Column, sign: Column) -> Column:
        is_digit = sign.between("0", "9")
        put = F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(sign)
        at = state["at"] + is_digit.cast("int")
        return F.struct(F.concat(state["out"], put).alias("out"), at.alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(_signs(text), first, write, lambda state: state["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` is 1 if the last digit counts once, 0 if it counts double."""

    def add(state: Column, sign: Column) -> Column:
        once = sign.cast("int")
        twice = once * 2 - F.when(once > 4, 9).otherwise(0)
        even = state["at"] % 2 == doubled
        return F.struct(
            (state["sum"] + F.when(even, twice).otherwise(once)).alias("sum"),
            (state["at"] + 1).alias("at"),
        )

    first = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at"))
    return F.aggregate(_signs(F.reverse(digits)), first, add, lambda state: state["sum"])


def _mod97(text: Column) -> Column:
    """The number that letters and digits stand for in an IBAN, modulo 97."""

    def add(state: Column, sign: Column) -> Column:
        is_digit = sign.between("0", "9")
        value = F.when(is_digit, F.ascii(sign) - 48).otherwise(F.ascii(sign) - 55)
        return (state * F.when(is_digit, 10).otherwise(100) + value) % 97

    return F.aggregate(_signs(text), F.lit(0), add)


def _card(found: Column, key: str) -> Column:
    digits = _digits(found)
    body = F.substring(digits, F.lit(2), F.length(digits) - 2)

    def renewed(new: Column) -> Column:
        payload = F.concat(F.substring(digits, 1, 1), new)
        check = F.pmod(10 - luhn_sum(payload, 0) % 10, F.lit(10))
        return in_place(found, F.concat(payload, check.cast("string")))

    valid = luhn_sum(digits, 1) % 10 == 0
    return F.when(valid, _let(permuted_digits(body, key, F.lit("card")), renewed))


def _phone(found: Column, key: str) -> Column:
    digits = _digits(found)
    kept = F.when(F.length(digits) > 10, F.length(digits) - 10).otherwise(1)
    body = F.substring(digits, kept + 1, F.length(digits) - kept)
    new = permuted_digits(body, key, F.lit("phone"))
    valid = F.length(digits).between(8, 15)
    return F.when(valid, in_place(found, F.concat(F.substring(digits, F.lit(1), kept), new)))


def _ssn(found: Column, key: str) -> Column:
    digits = _digits(found)
    area = _number(F.substring(digits, 1, 3))
    group, serial = _number(F.substring(digits, 4, 2)), _number(F.substring(digits, 6, 4))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(
        area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1,
        F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"),
    )
    new = _let(
        pair,
        lambda p: F.concat(
            F.lpad((p["l"] + 1 + (p["l"] >= 665).cast("int")).cast("string"), 3, "0"),
            F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )
    return F.when(valid, in_place(found, new))


def _iban(found: Column, key: str) -> Column:
    # Words behind a number whose country has no known length: the longest valid reading counts.
    parts = F.split(found, " ")
    ends = F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "),
    )
    valid = F.filter(ends, _is_iban)
    return _let(
        F.get(valid, F.lit(0)),
        lambda number: F.concat(
            _new_iban(number, key), F.substring(found, F.length(number) + 1, F.length(found))
        ),
    )


def _is_iban(number: Column) -> Column:
    plain = F.regexp_replace(number, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))
    return F.length(plain).between(15, 34) & (_mod97(turned) == 1)


def _new_iban(found: Column, key: str) -> Column:
    plain = F.regexp_replace(found, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    # Two networks of at most 15 digits each: 30 digits are too many for one bigint pair.
    digits = _digits(account)
    head = F.floor(F.length(digits) / 2).cast("int")
    new = F.concat(
        permuted_digits(F.substring(digits, F.lit(1), head), key, F.lit("iban1")),
        permuted_digits(
            F.substring(digits, head + 1, F.length(digits) - head),
            key,
            F.concat(F.lit("iban2|"), F.substring(digits, F.lit(1), head), F.lit("|")),
        ),
    )

    def renewed(account: Column) -> Column:
        check = 98 - _mod97(F.concat(account, country, F.lit("00")))
        whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)
        return in_place(found, _digits(whole))

    return _let(in_place(account, new), renewed)


def _ip(found: Column, key: str) -> Column:
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x < 256)
    pair = feistel(
        octets[0] * 256 + octets[1], octets[2] * 256 + octets[3],
        F.lit(65536), F.lit(65536), key, F.lit("ip"),
    )
    new = _let(
        pair,
        lambda p: F.concat_ws(
            ".",
            F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"),
            F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string"),
        ),
    )
    return F.when(valid, new)


def _date(found: Column, key: str) -> Column:
    """Two readings of day and month are possible; day first is taken if it is a date."""
    sign = F.regexp_extract(found, "[./-]", 0)
    parts = F.split(found, "[./-]")
    year_first = F.length(parts[0]) == 4

    def as_date(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    iso = as_date(parts[0], parts[1], parts[2])
    day_first = as_date(parts[2], parts[1], parts[0])
    month_first = as_date(parts[2], parts[0], parts[1])
    day = F.when(year_first, iso).otherwise(F.coalesce(day_first, month_first))
    american = ~year_first & day_first.isNull()

    def renewed(date: Column) -> Column:
        start = F.make_date(F.floor(F.year(date) / 100).cast("int") * 100, F.lit(1), F.lit(1))
        # A century's days as a product: 75 x 487 if it begins with a leap year, else 92 x 397.
        long = F.year(start) % 400 == 0
        a, b = F.when(long, 75).otherwise(92), F.when(long, 487).otherwise(397)
        at = F.datediff(date, start)
        pair = feistel(
            F.floor(at / b), at % b, a, b, key, F.concat(F.lit("date"), start.cast("string"))
        )
        new = _let(pair, lambda p: F.date_add(start, (p["l"] * b + p["r"]).cast("int")))

        def written(new: Column) -> Column:
            y, m, d = (F.date_format(new, x) for x in ("yyyy", "MM", "dd"))
            return (
                F.when(year_first, F.concat_ws("-", y, m, d))
                .when(american, F.concat(m, sign, d, sign, y))
                .otherwise(F.concat(d, sign, m, sign, y))
            )

        return _let(new, written)

    return F.when(day.isNotNull() & (F.year(day) >= 1000), _let(day, renewed))


def _digest(key: str, tweak: str, value: Column, size: Column | int) -> Column:
    """A hexadecimal digest of any size."""
    size = F.lit(size) if isinstance(size, int) else size
    steps = F.sequence(F.lit(0), F.floor(size / 64).cast("int"))

    def blocks(own: Column) -> Column:  # of the value's own digest: a long value is read once
        return F.array_join(F.transform(steps, lambda i: _keyed(key, F.lit(tweak), i, own)), "")

    return F.substring(_let(_keyed(key, F.lit(tweak), value), blocks), F.lit(1), size)


def _email(found: Column, key: str) -> Column:
    local, domain = F.substring_index(found, "@", 1), F.lower(F.substring_index(found, "@", -1))
    return F.concat(
        F.lit("u"), _digest(key, "local", F.lower(found), 12), F.lit("@d"),
        _digest(key, "domain", domain, 8), F.when(local.isNotNull(), ".example"),
    )


def _secret(found: Column, key: str) -> Column:
    is_key = found.rlike(f"^{ACCESS_KEY}$")
    value = F.regexp_extract(found, r"[A-Za-z0-9+/_-]+$", 0)
    before = F.substring(found, F.lit(1), F.length(found) - F.length(value))
    new = F.concat(before, _digest(key, "secret", value, F.length(value)))
    body = F.upper(_digest(key, "access", found, 16))
    return F.when(is_key, F.concat(F.substring(found, 1, 4), body)).otherwise(new)


def _pseudonym(found: Column, key: str) -> Column:
    """The kind of a find and what stands for it; a null kind and itself if it is not valid."""
    forms = [
        ("email", EMAIL, _email), ("secret", f"{ACCESS_KEY}|{SECRET}", _secret), ("ip", IP, _ip),
        ("date", DATE, _date), ("ssn", SSN, _ssn), ("iban", IBAN, _iban), ("card", CARD, _card),
        ("phone", PHONE, _phone),
    ]
    out = F.struct(F.lit(None).cast("string").alias("kind"), found.alias("new"))
    for kind, form, make in reversed(forms):
        whole = found.rlike(f"^(?:{form})$")
        out = F.when(whole, _let(make(found, key), _named(kind, found))).otherwise(out)
    return out


def _named(kind: str, found: Column):
    return lambda new: F.struct(
        F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, found).alias("new")
    )


def _count(finds: str, kind: str) -> Column:
    return F.size(F.filter(finds, lambda f: F.coalesce(f["kind"] == kind, F.lit(False))))


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pseudonymise(
    docs: DataFrame, key: str, text: str = "text", counts: str | None = "pii"
) -> DataFrame:
    """``docs`` with ``text`` made free of personal data and, if ``counts`` names a column, a
    map from kind to the number of values replaced. ``key`` is secret. Where ``docs`` has a
    column of that name, it stays and the map has underscores behind its name."""
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    finds = _free(docs, "finds")
    gaps, counts = _free(docs, "gaps"), counts and _free(docs, counts)
    found = F.when(hinted, F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0)))
    out = docs.withColumn(finds, F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn(gaps, F.when(F.size(finds) > 0, F.split(F.col(text), FOUND)))
    out = out.withColumn(finds, F.transform(finds, lambda m: _pseudonym(m, key)))
    ends = F.concat(F.transform(finds, lambda f: f["new"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, ends, lambda gap, end: F.concat(gap, end)), "")
    out = out.withColumn(text, F.when(F.size(finds) > 0, joined).otherwise(F.col(text)))
    if counts:
        named = [x for kind in KINDS for x in (F.lit(kind), _count(finds, kind))]
        out = out.withColumn(counts, F.create_map(*named))
    return out.drop(finds, gaps)
