"""Operator 1, personal data: format-preserving Feistel pseudonyms, native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)"
IPV4 = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
PHONE = r"(?<![\w+.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4})(?!\w|-\d)"
WORLD_PHONE = r"(?<![\w+])\+(?!1)\d(?:[ .()-]{0,2}\d){7,13}(?!\w)"
PLAIN = {"email": EMAIL, "date": DATE, "ipv4": IPV4, "ssn": SSN, "phone": PHONE, "world_phone": WORLD_PHONE}
#: Groups of digits and capitals, parted by one space or hyphen, up to where another kind begins: cards and IBANs are looked for within.
_GROUP = r"[A-Z0-9]++(?![A-Za-z0-9])"
RUN = rf"(?:(?<!\w)(?<!\d\.)(?=(?:\d[ -]?){{12}}\d)|(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})){_GROUP}(?:[ -](?!{'|'.join(PLAIN.values())}){_GROUP})*+"
KINDS = PLAIN | {"run": RUN}
ANY = "|".join(KINDS.values())
#: ISO 13616: the countries of each IBAN length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
COUNTRY_IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
ROUNDS = 8


def _number(digest: Column, digits: int = 14) -> Column:
    """A non-negative bigint from the first hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def feistel_number(left: Column, right: Column, a: Column, b: Column, key: Column) -> Column:
    """Permute the pairs of 0..a-1 and 0..b-1: struct(l, r). Rounds add keyed digests in turn."""

    def turn(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, state["r"]).otherwise(state["l"])
        drawn = _number(F.sha2(F.concat_ws(":", key, k.cast("string"), other.cast("string")).cast("binary"), 256))
        return F.struct(
            F.when(even, F.pmod(state["l"] + F.pmod(drawn, a), a)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(drawn, b), b)).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def feistel_text(text: Column, key: Column) -> Column:
    """Permute a string among those of its pattern: digits stay digits, letters keep their case, the rest stands."""

    def shifted(part: Column, digest: Column) -> Column:
        def one(p: Column) -> Column:
            c = F.substr(part, p, F.lit(1))
            draw = F.conv(F.substr(digest, ((p - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            return (
                F.when(c.between("0", "9"), F.char(F.lit(48) + (code - 48 + draw) % 10))
                .when(c.between("a", "z"), F.char(F.lit(97) + (code - 97 + draw) % 26))
                .when(c.between("A", "Z"), F.char(F.lit(65) + (code - 65 + draw) % 26))
                .otherwise(c)
            )

        places = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, one), "")

    def turn(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        digest = F.sha2(F.concat_ws(":", key, k.cast("string"), F.when(even, state["r"]).otherwise(state["l"])).cast("binary"), 256)
        return F.struct(
            F.when(even, shifted(state["l"], digest)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(shifted(state["r"], digest)).alias("r"),
        )

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(out["l"], out["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _power(width: Column) -> Column:
    return F.rpad(F.lit("1"), width + 1, "0").cast("bigint")


def _refill(pattern: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``pattern`` with its digits (or characters of ``kind``) replaced by ``digits``, one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        digit = c.rlike(f"^{kind}$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substr(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(pattern, ""), start, step)["out"]


def _permuted_digits(digits: Column, key: Column) -> Column:
    half = (F.length(digits) / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, F.length(digits))
    out = feistel_number(left, right, _power(half), _power(F.length(digits) - half), key)
    return F.concat(_padded(out["l"], half), _padded(out["r"], F.length(digits) - half))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit undoubled."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, n * 2 - 9).otherwise(n * 2))

    parts = F.transform(F.reverse(F.split(digits, "")), value)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def iban_remainder(compact: Column) -> Column:
    """ISO 7064: the account before country and check digits, letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substr(compact, F.lit(5), F.length(compact)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.when(digit, (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _permuted_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return _refill(m, F.concat(body, check.cast("string")))


def _iban(m: Column, key: Column) -> Column:
    compact = F.regexp_replace(m, "[ -]", "")
    country, account = F.substr(compact, F.lit(1), F.lit(2)), F.substr(compact, F.lit(5), F.length(compact))
    new = feistel_text(account, F.concat(key, country))
    check = _padded(98 - iban_remainder(F.concat(country, F.lit("00"), new)), 2)
    return _refill(m, F.concat(country, check, new), "[A-Z0-9]")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


_HEAD = "^[A-Z]{2}[0-9]{2}"
_REGULAR = "^[A-Z]{2}[0-9]{2}(?:(?:[A-Z0-9]{4}){2,7}[A-Z0-9]{0,3}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)[ -]?$"


def _rank(span: Column) -> Column:
    """2 of an IBAN of its country's length, 1 of another IBAN in regular groups or of a card, else 0."""

    def of(compact: Column) -> Column:
        iban = F.when(iban_remainder(compact) != 1, 0).when(compact.rlike(f"^(?:{COUNTRY_IBAN})$"), 2).when(span.rlike(_REGULAR), 1).otherwise(0)
        card = F.when(luhn_sum(compact) % 10 == 0, 1).otherwise(0)
        return F.when(compact.rlike("^[0-9]{13,19}$"), card).when(compact.rlike(f"{_HEAD}[A-Z0-9]{{8,31}}$"), iban).otherwise(0)

    return _let(F.regexp_replace(span, "[ -]", ""), of)


def _run(m: Column, key: str) -> Column:
    """A run with its cards and IBANs replaced: struct(out, n).

    From each group on, the spans of whole groups are tried, and of those that
    validate the longest is taken, but first one of its country's length; the
    next begins after it.
    """

    def of(parts: Column) -> Column:
        n = F.size(parts)
        joined = lambda at, count: F.array_join(F.slice(parts, at, count), "")

        def best(i: Column) -> Column:
            first = F.element_at(parts, i)
            most = F.when(first.rlike(_HEAD), 32).when(first.rlike("^[0-9]+[ -]?$"), 19).otherwise(0)
            sizes = F.when(most > 0, F.sequence(F.lit(1), F.least(most, n - i + 1)))
            return F.struct(i.alias("at"), F.array_max(F.transform(sizes, lambda k: F.struct(_rank(joined(i, k)).alias("rank"), k.alias("k")))).alias("hit"))

        hits = F.filter(F.transform(F.sequence(F.lit(1), n), best), lambda h: h["hit"]["rank"] > 0)

        def replaced(span: Column) -> Column:
            return F.when(span.rlike(_HEAD), _iban(span, F.lit(f"{key}:iban"))).otherwise(_card(span, F.lit(f"{key}:card")))

        def step(state: Column, h: Column) -> Column:
            def put(span: Column) -> Column:
                def with_new(new: Column) -> Column:
                    before = joined(state["at"], h["at"] - state["at"])
                    return F.struct((h["at"] + h["hit"]["k"]).alias("at"), F.concat(state["out"], before, new).alias("out"), (state["n"] + (new != span).cast("int")).alias("n"))

                return _let(replaced(span), with_new)

            return F.when(h["at"] >= state["at"], _let(joined(h["at"], h["hit"]["k"]), put)).otherwise(state)

        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(hits, start, step, lambda z: F.struct(F.concat(z["out"], joined(z["at"], n)).alias("out"), z["n"].alias("n")))

    return _let(F.regexp_extract_all(m, F.lit("[A-Z0-9]+[ -]?"), 0), of)


def _ipv4(m: Column, key: Column) -> Column:
    part = F.transform(F.split(m, "\\."), lambda x: x.cast("bigint"))
    out = feistel_number(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key)
    return F.concat_ws(".", *[x.cast("string") for side in (out["l"], out["r"]) for x in ((side / 256).cast("bigint"), side % 256)])


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(s), F.lit(n)).cast("bigint") for s, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel_number(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key)
    new = (out["l"] / 99).cast("bigint")
    return F.concat_ws("-", _padded(F.when(new > 664, new + 2).otherwise(new + 1), 3), _padded(out["l"] % 99 + 1, 2), _padded(out["r"] + 1, 4))


def _phone(m: Column, key: Column) -> Column:
    """Ten digits after an optional 1. Area and exchange codes from 200 stay so, and lower ones stay lower."""
    digits = F.right(_digits(m), F.lit(10))
    area, exchange, line = (F.substr(digits, F.lit(s), F.lit(n)).cast("bigint") for s, n in ((1, 3), (4, 3), (7, 4)))
    low, size = (lambda x: F.when(x >= 200, 200).otherwise(0)), (lambda x: F.when(x >= 200, 800).otherwise(200))
    codes = size(exchange)
    out = feistel_number((area - low(area)) * codes + exchange - low(exchange), line, size(area) * codes, F.lit(10_000), key)
    new = F.concat(_padded((out["l"] / codes).cast("bigint") + low(area), 3), _padded(out["l"] % codes + low(exchange), 3), _padded(out["r"], 4))
    prefix = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _refill(m, F.concat(prefix, new))


def _world_phone(m: Column, key: Column) -> Column:
    digits = _digits(m)
    return _refill(m, F.concat(F.substr(digits, F.lit(1), F.lit(2)), _permuted_digits(F.substr(digits, F.lit(3), F.length(digits)), key)))


#: Dates move within these spans of years, whole leap cycles but for the outermost: (first year, last year, factors of
#: the number of days, factors of the number of days over 12 of a month). Together they hold every year of four digits but 0000.
_SPANS = (
    (1, 303, (111, 997), (615, 109)),
    (304, 1503, (567, 773), (27, 9833)),
    (1504, 1903, (189, 773), (9, 9833)),
    (1904, 2099, (147, 487), (147, 295)),
    (2100, 2499, (189, 773), (9, 9833)),
    (2500, 9699, (3402, 773), (162, 9833)),
    (9700, 9999, (276, 397), (12, 5531)),
)


def _span(year: Column) -> Column:
    """The span that holds the year: struct(first, a, b, c, d); null for a null year."""
    spans = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("first", "a", "b", "c", "d"), (s[0], *s[2], *s[3]), strict=True)]) for s in _SPANS])
    return F.get(spans, F.size(F.filter(F.array(*[F.lit(s[0]) for s in _SPANS]), lambda first: first <= year)) - 1)


def _permuted_day(day: Column, key: Column) -> Column:
    def in_span(span: Column) -> Column:
        first = F.make_date(span["first"], F.lit(1), F.lit(1))

        def moved(at: Column) -> Column:
            return _let(feistel_number((at / span["b"]).cast("bigint"), at % span["b"], span["a"], span["b"], key), lambda x: F.date_add(first, (x["l"] * span["b"] + x["r"]).cast("int")))

        return _let(F.date_diff(day, first).cast("bigint"), moved)

    return _let(_span(F.year(day)), in_span)


#: Days over 12 before each month of a common year.
_LATE_DAYS = [0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202]


def _permuted_late_day(day: Column, month: Column, year: Column, key: Column) -> Column:
    """DD/MM/YYYY of a valid date with a day over 12, permuted among all such dates of its span of years."""
    leap = lambda y: ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")
    leaps = lambda y: F.floor((y - 1) / 4) - F.floor((y - 1) / 100) + F.floor((y - 1) / 400)
    before_month = lambda m, y: F.element_at(F.array(*map(F.lit, _LATE_DAYS)), m) + F.when(m > 2, leap(y)).otherwise(0)

    def in_span(span: Column) -> Column:
        before_year = lambda y: ((y - span["first"]) * 221 + leaps(y) - leaps(span["first"])).cast("bigint")

        def written(new: Column) -> Column:
            def in_year(y: Column) -> Column:
                def in_month(rest: Column) -> Column:
                    last = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: before_month(m, y) <= rest))
                    return _let(last, lambda m: F.concat_ws("/", _padded(rest - before_month(m, y) + 13, 2), _padded(m, 2), _padded(y, 4)))

                return _let(new - before_year(y), in_month)

            guess = span["first"] + F.floor(new / 221.2425).cast("int")
            return _let(F.array_max(F.filter(F.sequence(guess - 1, guess + 1), lambda y: before_year(y) <= new)), in_year)

        def moved(at: Column) -> Column:
            return _let(feistel_number((at / span["d"]).cast("bigint"), at % span["d"], span["c"], span["d"], key), lambda x: _let(x["l"] * span["d"] + x["r"], written))

        return _let(before_year(year) + before_month(month, year) + day - 13, moved)

    return _let(_span(year), in_span)


#: Layouts of dates; between slashes the month comes first.
_LAYOUTS = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}-", "dd-MM-yyyy"), (r"^\d{2}/", "MM/dd/yyyy"))


def _date(m: Column, key: Column) -> Column:
    def by_layout(value) -> Column:
        out = F.lit(None)
        for pattern, layout in reversed(_LAYOUTS):
            out = F.when(m.rlike(pattern), value(layout)).otherwise(out)
        return out

    # Month first between slashes, but day first with a day over 12 in front.
    day, month, year = (F.substr(m, F.lit(s), F.lit(n)).cast("int") for s, n in ((1, 2), (4, 2), (7, 4)))
    late = m.rlike(r"^(?:1[3-9]|[23]\d)/\d{2}/\d{4}$")
    valid = F.try_to_date(m, "dd/MM/yyyy").isNotNull()
    new = _let(_permuted_day(by_layout(lambda layout: F.try_to_date(m, layout)), key), lambda moved: by_layout(lambda layout: F.date_format(moved, layout)))
    return F.coalesce(F.when(late, F.when(valid, _permuted_late_day(day, month, year, key))).otherwise(new), m)


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(local, F.concat(key, F.lower(F.substring_index(m, "@", -1)))), F.substr(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match and how many values changed, struct(out, n); what fails validation stays as it is."""
    makers = {"email": _email, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "world_phone": _world_phone}
    out = _run(m, key)
    for kind in reversed(PLAIN):
        whole = _let(makers[kind](m, F.lit(f"{key}:{kind}")), lambda new: F.struct(new.alias("out"), (new != m).cast("int").alias("n")))
        out = F.when(m.rlike(f"^(?:{PLAIN[kind]})$"), whole).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace personal data in ``text_col`` by keyed pseudonyms of the same format.

    Cards (Luhn), IBANs (mod 97), social security numbers, phones, IPv4
    addresses and dates are validated and permuted by a Feistel network within
    the valid values of their format, so pseudonyms validate too, equal values
    stay equal in all documents, and different ones stay different. Dates of
    the years 0001 to 9999 move within their span of years (``_SPANS``: 1904 to
    2099 is one); between slashes the month comes first unless the first number
    is over 12, and such day-first dates are permuted in day, month and year
    among themselves, so a day over 12 written first and the same day written
    in another layout get different pseudonyms. Of e-mail addresses the local
    part is permuted among strings of its pattern; addresses link only where
    they are written in the same case.

    Cards and IBANs are looked for in runs of groups of digits and capitals, at
    every group, so neighbours (a date of expiry, a currency) do not hide them.
    Groups that have the form of another kind are read as that kind, and digits
    after a digit and a dot as decimals.

    All columns are kept; ``n_replaced`` (long, the values that changed) is
    added or replaced. Null texts stay null with 0; empty ones stay empty. No
    shuffle and no state: every row stands alone, and tables may be empty.
    """
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    fakes = F.transform(found, lambda m: pseudonym(m, key))
    between = F.split(text, ANY, -1)
    rewritten = F.array_join(F.flatten(F.zip_with(between, fakes, lambda a, b: F.array(a, F.coalesce(b["out"], F.lit(""))))), "")
    touched = text.rlike("[0-9@]")
    changed = F.aggregate(fakes, F.lit(0), lambda n, z: n + z["n"]).cast("long")
    return docs.select(
        *[F.when(touched, rewritten).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_replaced"],
        F.when(touched, changed).otherwise(F.lit(0)).cast("long").alias("n_replaced"),
    )


#: The key of the registered query; a deployment passes its own secret.
DEMO_KEY = "tessera-demo-key"


def op1_pii_pseudonyms(spark, sf_dir):
    """Texts of all documents with pseudonyms in place of personal data."""
    return pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
