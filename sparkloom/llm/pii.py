"""Format-preserving Feistel pseudonyms for personal data in texts.

Every value that a pattern finds and a check accepts is replaced by another of the
same format, by a keyed permutation: equal values get equal pseudonyms in every
document, different values different ones, and the text around them stays.

- card: 13 to 19 digits that pass the Luhn test; all but the last are permuted and
  the last made anew, so pseudonyms pass the test too. Separators stay.
- ssn: three, two and four digits with valid parts, permuted among valid numbers.
- ip: four parts up to 255, permuted as two 16-bit halves.
- date: a day of the calendar as yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy from 1700 on,
  permuted among the days of its 400 years; a pseudonym is a day of the calendar too.
- phone: 7 to 15 digits in a usual form; digits after a country code are permuted.
- email: letters and digits before the last dot are permuted, each among its kind.
- secret: the value of a `token`, `key`, `secret` or `password` that holds a digit.

Numbers with two bounded parts go through a Feistel network of modular additions on
the parts; strings of signs through one whose halves add to each other a key stream
of SHA-256, each sign within its kind (digits, hexadecimal signs, small and capital
letters). Both are bijections. What looks like such a value and fails its check (a
card number with a wrong last digit) is left alone.

Null texts stay null. Each row is treated alone; nothing is looked up or collected.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEFT, _RIGHT = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
#: Patterns in order of preference at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": _LEFT + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _RIGHT,
    "ssn": _LEFT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _RIGHT,
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _RIGHT,
    "card": _LEFT + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})" + _RIGHT,
    "secret": r"(?<![A-Za-z])(?i:token|secret|password|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_\-+/]{16,}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
#: 400 years have the same number of days wherever they begin: 189 * 773.
FIRST_DAY, CYCLE = "1700-01-01", 146097
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _apply(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def feistel_number(key: str, kind: Column, a: Column, b: Column, below_a: Column, below_b: Column) -> Column:
    """A permutation of the pairs (a, b) of longs below two bounds, by modular additions; a struct of a and b."""

    def turn(p, t):
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, t.cast("string"), p["b"].cast("string")).cast("binary"), 256)
        moved = (p["a"] + F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") % p["ma"]) % p["ma"]
        return F.struct(p["b"].alias("a"), moved.alias("b"), p["mb"].alias("ma"), p["ma"].alias("mb"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), below_a.cast("long").alias("ma"), below_b.cast("long").alias("mb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _shifted(sign: Column, by: Column, mode: Column) -> Column:
    """A sign moved within its kind; mode: hex, HEX or plain."""
    digit = sign.between("0", "9")
    kind = F.when((mode == "hex") & (digit | sign.between("a", "f")), _DIGITS + "abcdef").when((mode == "HEX") & (digit | sign.between("A", "F")), _DIGITS + "ABCDEF")
    kind = kind.when(digit, _DIGITS).when(sign.between("a", "z"), _LOWER).when(sign.between("A", "Z"), _UPPER).otherwise("")
    return _apply(kind, lambda k: F.when((sign != "") & (F.instr(k, sign) > 0), F.substring(k, ((F.instr(k, sign) - 1 + by) % F.length(k) + 1).cast("int"), F.lit(1))).otherwise(sign))


def feistel_signs(key: str, kind: Column, text: Column, mode: Column) -> Column:
    """A permutation of the strings of one format: signs go to signs of their kind, others stay."""

    def turn(p, t):
        stream = F.sha2(F.concat_ws("|", F.lit(key), kind, t.cast("string"), F.array_join(p["b"], "")).cast("binary"), 256)

        def moved(s):
            return F.transform(p["a"], lambda c, i: _shifted(c, F.conv(F.substring(F.sha2(F.concat(s, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long"), mode))

        return F.struct(p["b"].alias("a"), _apply(stream, moved).alias("b"))

    def whole(chars):
        half = F.floor(F.size(chars) / 2).cast("int")
        start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda p: F.array_join(F.concat(p["a"], p["b"]), ""))

    return F.when(F.length(text) > 1, _apply(F.split(text, ""), whole)).otherwise(text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order."""
    chars = F.split(form, "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(state, c):
        digit = c.between("0", "9") & (c != "")
        return F.struct(F.concat(state["s"], F.when(digit, F.substring(digits, state["i"], F.lit(1))).otherwise(c)).alias("s"), (state["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(chars, start, step, lambda x: x["s"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last stands at an even distance from the check digit's place."""
    signs = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(signs, value), F.lit(0), lambda a, x: a + x)


def valid_card(text: Column) -> Column:
    d = _digits(text)
    return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$")


def _part(text: Column, separator: str, i: int) -> Column:
    return F.get(F.split(text, separator), F.lit(i - 1)).try_cast("long")


def valid_ip(text: Column) -> Column:
    return F.forall(F.split(text, "\\."), lambda x: x.try_cast("int") <= 255)


def valid_ssn(text: Column) -> Column:
    area = _part(text, "-", 1)
    return (area > 0) & (area != 666) & (area < 900) & (_part(text, "-", 2) > 0) & (_part(text, "-", 3) > 0)


def _day(text: Column) -> Column:
    iso = F.when(text.contains("-"), text).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    return F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso.try_cast("date"))


def valid_date(text: Column) -> Column:
    day = _day(text)
    return day.isNotNull() & (day >= F.lit(FIRST_DAY).cast("date"))


_CYCLE = 146097  # days in 400 years, 189 * 773


def valid_phone(text: Column) -> Column:
    return F.length(_digits(text)).between(7, 15)


def _accepted(kind: str, m: Column) -> Column:
    checks = {"ip": valid_ip, "date": valid_date, "ssn": valid_ssn, "phone": valid_phone, "card": valid_card}
    if kind == "secret":
        return F.regexp_extract(m, r"[A-Za-z0-9_\-+/]{16,}$", 0).rlike("[0-9]")
    return checks[kind](m) if kind in checks else F.lit(True)


_ALONE = {
    "email": "@",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "secret": r"[:=]",
    "phone": r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$",
}


def kind_of(m: Column) -> Column:
    """The kind of a found value that its check accepts, else null."""
    found = F.when(_accepted("card", m), F.lit("card"))
    for kind in reversed(_ALONE):
        found = F.when(m.rlike(_ALONE[kind]), F.when(_accepted(kind, m), F.lit(kind))).otherwise(found)
    return found


_VALUE = r"[A-Za-z0-9_\-+/]{16,}$"


def _split(m: Column, kind: Column) -> Column:
    """A value's parts: lead, body (to be permuted by signs) and tail, or the numbers a and b with their bounds."""
    digits = _digits(m)
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    secret = F.regexp_extract(m, _VALUE, 0)
    last = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    cut = lambda n: F.substring(m, F.lit(1), F.length(m) - n)
    lead = F.when(kind == "phone", code).when(kind == "secret", cut(F.length(secret))).otherwise("")
    tail = F.when(kind == "email", last).otherwise("")
    body = F.when(kind == "card", F.substring(digits, F.lit(1), F.length(digits) - 1)).when(kind == "phone", _digits(F.substring(m, F.length(code) + 1, F.length(m))))
    body = body.when(kind == "email", cut(F.length(last))).when(kind == "secret", secret).otherwise("")
    mode = F.when((kind == "secret") & secret.rlike("^[0-9a-f]+$"), "hex").when((kind == "secret") & secret.rlike("^[0-9A-F]+$"), "HEX").otherwise("plain")
    octet = [_part(m, "\\.", i) for i in (1, 2, 3, 4)]
    area, group, serial = (_part(m, "-", i) for i in (1, 2, 3))
    days = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    pair = lambda *x: F.struct(*[F.lit(v).cast("long").alias(n) if isinstance(v, int) else v.cast("long").alias(n) for v, n in zip(x, ("a", "b", "ma", "mb"), strict=True)])
    numbers = F.when(kind == "ip", pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536))
    numbers = numbers.when(kind == "ssn", pair(F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999))
    numbers = numbers.when(kind == "date", pair(F.floor(days % CYCLE / 773), days % CYCLE % 773, 189, 773))
    return F.struct(lead.alias("lead"), body.alias("body"), tail.alias("tail"), mode.alias("mode"), numbers.alias("numbers"), F.floor(days / CYCLE).alias("cycle"))


def _spelled(m: Column, kind: Column, parts: Column, body: Column, n: Column) -> Column:
    """The pseudonym of m in its own format, from its permuted parts."""
    padded = lambda c, size: F.lpad(c.cast("long").cast("string"), size, "0")
    check = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    after = F.substring(m, F.length(parts["lead"]) + 1, F.length(m))
    area = F.floor(n["a"] / 99) + 1
    ssn = F.concat_ws("-", padded(F.when(area >= 666, area + 1).otherwise(area), 3), padded(n["a"] % 99 + 1, 2), padded(n["b"] + 1, 4))
    ip = F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(n["a"] / 256), n["a"] % 256, F.floor(n["b"] / 256), n["b"] % 256)])
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (parts["cycle"] * CYCLE + n["a"] * 773 + n["b"]).cast("int")).cast("string")
    sign = F.substring(m, 3, 1)
    date = _apply(day, lambda d: F.when(m.contains("-"), d).otherwise(F.concat(F.substring(d, 9, 2), sign, F.substring(d, 6, 2), sign, F.substring(d, 1, 4))))
    out = F.when(kind == "card", _refilled(m, check)).when(kind == "phone", F.concat(parts["lead"], _refilled(after, body))).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "date", date)
    return out.otherwise(F.concat(parts["lead"], body, parts["tail"]))


def pseudonym_of(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind that was accepted; without a kind the value itself."""

    def made(parts):
        n = parts["numbers"]
        moved = F.struct(feistel_signs(key, kind, parts["body"], parts["mode"]).alias("body"), feistel_number(key, kind, n["a"], n["b"], n["ma"], n["mb"]).alias("n"))
        return _apply(moved, lambda x: _spelled(m, kind, parts, x["body"], x["n"]))

    return F.when(kind.isNull(), m).otherwise(_apply(_split(m, kind), made))


def pseudonymised(docs: DataFrame, key: str = "corpus", text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """All rows and columns, with pseudonyms in the text; found_col adds an array of (kind, pseudonym) of what was replaced, in place of a column of that name.

    The key is a parameter of the job; with another key the pseudonyms can't be linked.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("t"))
    row = row.withColumn("found", F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))  # every kind holds a digit or an @
    row = row.withColumn("found", F.when(F.size("found") > 0, F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    row = row.withColumn("found", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), pseudonym_of(x["m"], x["kind"], key).alias("now"))))
    pieces = F.split("t", ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.transform("found", lambda x: x["now"]), F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    row = row.withColumn("t", F.when(F.col("found").isNotNull(), woven).otherwise(F.col("t")))
    columns = [F.col("t").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != found_col]
    if found_col:
        columns.append(F.coalesce(F.filter("found", lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind: string, now: string>>")).alias(found_col))
    return row.select(*columns)
