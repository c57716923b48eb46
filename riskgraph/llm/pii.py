"""PII: validated numbers, dates and addresses replaced by keyed Feistel pseudonyms of the same format.

DataFrame and SQL functions only. A text is cut at its matches, each match is mapped inside the row, and the parts are
joined again, so nothing is shuffled. Equal values get equal pseudonyms in every document, and different values of
a kind get different ones. Every kind maps onto valid values of its own format only:

=======  ======================================================================  ==============================
kind     what is found                                                           what is permuted
=======  ======================================================================  ==============================
email    local part @ domain                                                     letters and digits of the local part
ip       four numbers of 0 to 255 without leading zeros                          the 32-bit address
date     calendar days 1900-01-01 to 2099-11-13, as Y-M-D, D.M.Y or M/D/Y        the day's number
phone    +1 (ddd) ddd-dddd and +1 ddd ddd dddd with its separators               the ten digits
ssn      ddd-dd-dddd, no part all zeros                                          the nine digits, part by part
card     13 to 19 digits, plain or in groups, with a right check digit           all digits but the check digit, which is made anew
=======  ======================================================================  ==============================

Cards are searched in what the other kinds leave. Inside a run of digits every stretch of whole groups is tried, so a short number or an
expiry date beside a card doesn't hide it; of overlapping stretches with right check digits, one in printed groups goes first.

Numbers that fail their check, such as a wrong check digit, and days outside the calendar stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "date", "phone", "ssn", "card")

#: The local part takes a whole run and never gives characters back, and no start lies inside a run, so runs without an @ are read once.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
_DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)"
_PHONE = r"(?<!\w)\+1[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}(?!\w)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_OTHER = "|".join((_EMAIL, _IP, _DATE, _PHONE, _SSN))
#: A maximal run of digits with single blanks and hyphens, in which cards are searched. Possessive, so that long runs need no stack.
_RUN = r"(?<![\w.-])\d(?:[ -]?\d){12,}+\w*+"
#: Lengths of the groups that cards are printed in.
_PRINTED = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3")
_HINT = r"@|[0-9]"

_ROUNDS = 6
_FIRST_DAY, _DAYS_HIGH, _DAYS_LOW = "1900-01-01", 250, 292  # 73,000 days


def _rand(key: str, tag: str, k: Column, value: Column) -> Column:
    """A keyed pseudorandom non-negative number of 56 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def _feistel(x: Column, high: Column | int, low: Column | int, key: str, tag: str) -> Column:
    """A keyed permutation of 0 .. high * low - 1: a Feistel network whose halves are added modulo their sizes."""
    high, low = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (high, low))
    start = F.struct(F.floor(x / low).cast("long").alias("l"), F.pmod(x, low).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        return F.when(
            k % 2 == 0, F.struct(F.pmod(s["l"] + _rand(key, tag, k, s["r"]), high).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _rand(key, tag, k, s["l"]), low).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, turn, lambda s: s["l"] * low + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 18), halves of powers of ten."""
    n = F.length(digits)
    low = F.round(F.pow(F.lit(10.0), F.floor(n / 2).cast("double"))).cast("long")
    high = F.round(F.pow(F.lit(10.0), (n - F.floor(n / 2)).cast("double"))).cast("long")
    halves = F.struct(F.substr(digits, F.lit(1), n - F.floor(n / 2)).cast("long").alias("l"), F.substr(digits, n - F.floor(n / 2) + 1, n).cast("long").alias("r"))

    def turn(s: Column, k: Column) -> Column:
        return F.when(
            k % 2 == 0, F.struct(F.pmod(s["l"] + _rand(key, tag, k, F.concat_ws(":", n, s["r"])), high).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _rand(key, tag, k, F.concat_ws(":", n, s["l"])), low).alias("r")))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), halves, turn,
        lambda s: F.concat(F.lpad(s["l"].cast("string"), (n - F.floor(n / 2)).cast("int"), "0"), F.lpad(s["r"].cast("string"), F.floor(n / 2).cast("int"), "0")),
    )


def _laid_over(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits``, one after the other; all else stays."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    chars = F.split(m, "")
    put = F.aggregate(
        F.filter(chars, lambda c: c != ""), start,
        lambda s, c: F.when(
            c.rlike("^[0-9]$"), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substr(digits, s["at"] + 1, F.lit(1))).alias("out"))
        ).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))),
    )
    return put["out"]


def _luhn(digits: Column, check: bool) -> Column:
    """The sum of the check-digit rule; without ``check`` a place for the missing check digit is assumed."""
    n = F.length(digits)
    places = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: _doubled(F.substr(digits, i, F.lit(1)).cast("int"), F.pmod(n - i, F.lit(2)) == (1 if check else 0)),
    )
    return F.aggregate(places, F.lit(0), lambda a, b: a + b)


def _doubled(d: Column, double: Column) -> Column:
    return F.when(double, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def _email(m: Column, key: str) -> Column:
    """Local part of one character class pattern onto another of the same pattern: a Feistel network over its halves."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    cut = F.ceil(n / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), cut).alias("l"), F.substr(local, cut + 1, n).alias("r"))

    def shifted(half: Column, by: Column, k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            v = _rand(key, "email", k, F.concat_ws(":", by, n, i))
            rolled = lambda first, size: F.chr(F.pmod(F.ascii(c) - first + v, F.lit(size)) + first)
            return F.when(c.rlike("^[a-z]$"), rolled(97, 26)).when(c.rlike("^[A-Z]$"), rolled(65, 26)).when(c.rlike("^[0-9]$"), rolled(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def turn(s: Column, k: Column) -> Column:
        return F.when(k % 2 == 0, F.struct(shifted(s["l"], s["r"], k).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], k).alias("r"))
        )

    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), domain)


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    x = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    y = _feistel(x, 65536, 65536, key, "ip")
    return F.concat_ws(".", *[F.pmod(F.floor(y / (256 ** k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])


_DATE_FORMATS = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy"))


def _day(m: Column) -> Column:
    """Days since the first day of the calendar; null for what is no date in it."""
    day = F.lit(None).cast("timestamp")
    for pattern, form in reversed(_DATE_FORMATS):
        day = F.when(m.rlike(pattern), F.try_to_timestamp(m, F.lit(form))).otherwise(day)
    number = F.datediff(day.cast("date"), F.lit(_FIRST_DAY).cast("date"))
    return F.when(number.between(0, _DAYS_HIGH * _DAYS_LOW - 1), number)


def _date(m: Column, key: str) -> Column:
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), _feistel(_day(m).cast("long"), _DAYS_HIGH, _DAYS_LOW, key, "date").cast("int"))
    out = F.date_format(day, _DATE_FORMATS[2][1])
    for pattern, form in _DATE_FORMATS[:2]:
        out = F.when(m.rlike(pattern), F.date_format(day, form)).otherwise(out)
    return out


def _ssn(m: Column, key: str) -> Column:
    """Parts 001-999, 01-99 and 0001-9999 as one number, so that no part becomes all zeros."""
    d = _digits(m)
    x = ((F.substr(d, F.lit(1), F.lit(3)).cast("long") - 1) * 99 + F.substr(d, F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + F.substr(d, F.lit(6), F.lit(4)).cast("long") - 1
    y = _feistel(x, 999 * 99, 9999, key, "ssn")
    return F.format_string("%03d-%02d-%04d", F.floor(y / (99 * 9999)) + 1, F.pmod(F.floor(y / 9999), F.lit(99)) + 1, F.pmod(y, F.lit(9999)) + 1)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = _permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    last = F.pmod(10 - F.pmod(_luhn(body, check=False), F.lit(10)), F.lit(10))
    return _laid_over(m, F.concat(body, last.cast("string")))


def _is_card(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]{13,19}$"), F.pmod(_luhn(digits, check=True), F.lit(10)) == 0).otherwise(False)


def _part(kind: str | None, found: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), found.alias("found"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _cards(run: Column) -> Column:
    """A run as (kind, found) of its cards and of what lies between them."""
    none = F.lit(None).cast("int")

    def split_at(groups: Column, gaps: Column) -> Column:
        n = F.size(groups)
        several = lambda i, j: F.slice(groups, i, j - i + 1)

        def ends(i: Column) -> Column:
            right = F.filter(F.sequence(i, F.least(i + 18, n)), lambda j: _is_card(F.array_join(several(i, j), "")))
            printed = lambda j: (i == j) | F.array_join(F.transform(several(i, j), lambda g: F.length(g).cast("string")), "-").isin(*_PRINTED)
            return _let(right, lambda r: F.struct(F.array_min(F.filter(r, printed)).alias("printed"), F.array_max(r).alias("longest")))

        def taken(found: Column, i: Column) -> Column:
            own = found[i - 1]
            later = F.exists(F.slice(found, i + 1, own["longest"] - i), lambda f: f["printed"].isNotNull())
            return F.when(own["printed"].isNotNull(), own["printed"]).when(own["longest"].isNotNull() & ~later, own["longest"]).otherwise(none)

        gap = lambda k: F.coalesce(F.get(gaps, k - 1), F.lit(""))

        def spelled(i: Column, n: Column) -> Column:
            return F.array_join(F.zip_with(F.slice(groups, i, n), F.slice(gaps, i, n), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")

        def put(s: Column, i: Column, j: Column) -> Column:
            plain = F.concat(gap(s["upto"]), spelled(s["upto"] + 1, i - s["upto"] - 1))
            card = F.concat(spelled(i, j - i), groups[j - 1])
            more = F.struct(j.alias("upto"), F.concat(s["parts"], F.array(_part(None, plain), _part("card", card))).alias("parts"))
            return F.when((i > s["upto"]) & j.isNotNull(), more).otherwise(s)

        start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<kind:string,found:string>>").alias("parts"))
        numbers = F.sequence(F.lit(1), n)
        picks = _let(F.transform(numbers, ends), lambda found: F.transform(numbers, lambda i: F.struct(i.alias("i"), taken(found, i).alias("j"))))
        rest = lambda s: F.concat(s["parts"], F.array(_part(None, F.concat(gap(s["upto"]), spelled(s["upto"] + 1, n - s["upto"])))))
        return F.aggregate(picks, start, lambda s, p: put(s, p["i"], p["j"]), rest)

    return _let(
        F.struct(F.split(run, "[ -]").alias("groups"), F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)).alias("gaps")),
        lambda r: split_at(r["groups"], r["gaps"]),
    )


def _rest(text: Column) -> Column:
    """Text without values of the other kinds as (kind, found) of its cards and of what lies between them."""
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    parts = F.zip_with(
        F.split(text, _RUN, -1), runs, lambda plain, run: F.when(run.isNull(), F.array(_part(None, plain))).otherwise(F.concat(F.array(_part(None, plain)), _cards(run)))
    )
    return F.when(text.rlike(_RUN), F.flatten(parts)).otherwise(F.array(_part(None, text)))


def kind_of(m: Column) -> Column:
    """The kind of a match, null if its value isn't valid."""
    octets = F.split(m, r"\.")
    right = F.forall(octets, lambda p: (p.cast("int") <= 255) & ~p.rlike("^0."))
    d = _digits(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(right, "ip"))
        .when(m.rlike(f"^(?:{_DATE})$"), F.when(_day(m).isNotNull(), "date"))
        .when(m.startswith("+"), "phone")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike("^000|-00-|-0000$"), "ssn"))
        .when(_is_card(d), "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    phone = F.concat(F.lit("+1"), _laid_over(F.substr(m, F.lit(3), F.length(m)), _permuted_digits(F.substr(_digits(m), F.lit(2), F.lit(10)), key, "phone")))
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key))
        .when(kind == "phone", phone).when(kind == "ssn", _ssn(m, key)).when(kind == "card", _card(m, key)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a column ``pii`` of (kind, found, pseudonym) for each value, in order.

    All other columns stay. A null text stays null with a null list; a text without values has an empty list. The
    result depends on the text and ``key`` alone. Keep the key secret: whoever has it can undo the pseudonyms.
    """
    some = F.col(text).rlike(_HINT)
    others = F.regexp_extract_all(F.col(text), F.lit(_OTHER), F.lit(0))
    value = lambda m: F.array(F.struct(kind_of(m).alias("kind"), m.alias("found")))
    cut = F.flatten(F.zip_with(F.split(F.col(text), _OTHER, -1), others, lambda plain, m: F.when(m.isNull(), _rest(plain)).otherwise(F.concat(_rest(plain), value(m)))))
    parts = F.when(some, cut).otherwise(F.array().cast("array<struct<kind:string,found:string>>"))
    named = docs.withColumn("_named", F.when(F.col(text).isNotNull(), parts))
    mapped = named.withColumn(
        "_mapped", F.transform("_named", lambda s: F.struct(s["kind"].alias("kind"), s["found"].alias("found"), pseudonym(s["found"], s["kind"], key).alias("pseudonym")))
    )
    joined = F.array_join(F.transform("_mapped", lambda s: s["pseudonym"]), "")
    return mapped.withColumn(text, F.when(F.size("_mapped") > 0, joined).otherwise(F.col(text))).withColumn(
        "pii", F.filter("_mapped", lambda s: s["kind"].isNotNull())
    ).drop("_named", "_mapped")


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_<kind> for every kind) of ``docs(doc_id, text)``; counts of a null text are 0."""
    done = pseudonymise(docs.select("doc_id", "text"), key)
    count = lambda kind: F.coalesce(F.size(F.filter("pii", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", *[count(k) for k in KINDS])
