"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated values are permuted by a keyed Feistel network within their format: a card number becomes another number with
the same check, a date another date, an address another address. Equal values become equal pseudonyms in every
document, and different ones stay different, so that records stay linked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds with their patterns; where two match at one place, the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d.]*\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/.-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?!\d)",
    "number": r"(?<![A-Za-z\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![A-Za-z\d])",
}
DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")
#: Days are permuted within blocks of this size, counted from 1900-01-01: 256 times 288 days, over 201 years.
DAYS = (256, 288)
#: Valid first parts of social security numbers: 001 to 665 and 667 to 899.
AREAS = 898


def union_pattern() -> str:
    # The only group that is referred to is the first one.
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def keyed(key: str, *parts: Column) -> Column:
    """A number from 0 to 2**48 - 1 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 12), 16, 10).cast("long")


def letters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def permute_text(key: str, value: Column) -> Column:
    """Permutes digits among digits and letters among letters of their case; other characters stay where they are."""

    def turn(c: Column, n: Column) -> Column:
        moved = lambda first, size: F.char(F.lit(first) + (F.ascii(c) - first + n) % size)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

    def shift(half: Column, other: Column, i: Column) -> Column:
        return F.transform(half, lambda c, j: turn(c, keyed(key, F.lit("text"), i, j, F.array_join(other, ""))))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shift(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shift(s["b"], s["a"], i).alias("b")))

    chars = letters(value)
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, 1, half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))
    return F.aggregate(F.lit(list(range(ROUNDS))), start, step, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))


def permute_pair(key: str, kind: Column, a: Column, b: Column, m: Column, n: Column) -> Column:
    """Permutes the pairs of numbers below m and n: a struct a, b."""

    def step(s: Column, i: Column) -> Column:
        one = F.struct(((s["a"] + keyed(key, kind, i, s["b"])) % m).alias("a"), s["b"].alias("b"))
        two = F.struct(s["a"].alias("a"), ((s["b"] + keyed(key, kind, i, s["a"])) % n).alias("b"))
        return F.when(i % 2 == 0, one).otherwise(two)

    return F.aggregate(F.lit(list(range(ROUNDS))), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def bare(value: Column) -> Column:
    """Letters and digits alone: what is permuted, however a value is spelled."""
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def laid(form: Column, plain: Column) -> Column:
    """The letters and digits of plain where form has some; form's separators stay."""

    def step(s: Column, c: Column) -> Column:
        own = c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")
        return F.struct((s["i"] + own.cast("int")).alias("i"), F.concat(s["s"], F.when(own, F.substring(plain, s["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(letters(form), F.struct(F.lit(0).alias("i"), F.lit("").alias("s")), step, lambda s: s["s"])


def cased(form: Column, plain: Column) -> Column:
    """plain with capitals where form, of the same length, has some."""
    return F.array_join(F.zip_with(letters(form), letters(plain), lambda f, c: F.when(f.between("A", "Z"), F.upper(c)).otherwise(c)), "")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn sum, modulo 10, of a string of digits; the last one counts once."""
    doubled = F.transform(F.reverse(letters(value)), lambda c, i: F.when(i % 2 == 1, F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10


def mod97(value: Column) -> Column:
    """Of the number that a string of digits and capitals (A is 10) stands for."""
    return F.aggregate(letters(value), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def case_of(pairs: list[tuple[Column, Column]]) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out


def case(kind: Column, **values: Column) -> Column:
    return case_of([(kind == k, v) for k, v in values.items()])


def described(v: Column) -> Column:
    """struct v, kind (the first that the whole value matches), and for dates form and days since 1900-01-01."""
    kind = case_of([(F.regexp_like(v, F.lit(f"^(?:{p})$")), F.lit(k)) for k, p in PATTERNS.items()])
    zeros = F.regexp_replace(v, r"\d", "0")
    form = case_of([(zeros == form.translate(str.maketrans("yMd", "000")), F.lit(form)) for form in DATES])
    days = [(zeros == form.translate(str.maketrans("yMd", "000")), F.datediff(F.try_to_timestamp(v, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))) for form in DATES]
    return F.struct(v.alias("v"), kind.alias("kind"), form.alias("form"), case_of(days).alias("days"))


def taken_apart(x: Column) -> Column:
    """Adds body (text to be permuted) or a, b, m, n (numbers to be permuted); neither for values that aren't valid.

    Of a body letters and digits are permuted as if it had no separators, of an email as if it were in lower case, so that
    spellings of one value are linked. Emails keep their domain, phone numbers (7 to 15 digits) a country code, IBANs (with a valid check) country and check
    digits. Long numbers are valid if their check digit is right, or with 16 digits, as accounts without a check have; all
    but the last digit is body. Addresses are two halves, dates days within a block, security numbers their rank."""
    v, kind = x["v"], x["kind"]
    plain = F.replace(v, F.lit(" "), F.lit(""))
    account = F.when(mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1, F.substring(plain, 5, 60))
    code = F.length(F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])", 0))
    n_digits = F.length(digits(v))
    phone = F.when(n_digits.between(7, 15), bare(F.substring(v, code + 1, F.lit(60))))
    number = F.when((n_digits == 16) | (luhn(digits(v)) == 0), F.call_function("left", digits(v), n_digits - 1))
    body = case(kind, email=F.lower(F.substring_index(v, "@", 1)), phone=phone, number=number, iban=account)
    m, n = DAYS
    at = F.pmod(x["days"], F.lit(m * n))
    part = lambda i: F.get(F.split(v, r"\."), F.lit(i)).cast("long")
    area, group, serial = (F.substring(v, a, k).cast("long") for a, k in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(valid, F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1)
    a = case(kind, ip=part(0) * 256 + part(1), date=F.floor(at / n), ssn=rank)
    b = case(kind, ip=part(2) * 256 + part(3), date=at % n, ssn=serial - 1)
    sizes = (case(kind, ip=F.lit(i), date=F.lit(d), ssn=F.lit(s)).cast("long") for i, d, s in ((65536, m, AREAS * 99), (65536, n, 9999)))
    return F.struct(v.alias("v"), kind.alias("kind"), x["form"].alias("form"), x["days"].alias("days"), body.alias("body"), a.alias("a"), b.alias("b"), *(z.alias(c) for z, c in zip(sizes, "mn", strict=True)))


def permuted(key: str, x: Column) -> Column:
    text = F.when(x["body"].isNotNull(), permute_text(key, x["body"]))
    pair = F.when(x["a"].isNotNull() & x["b"].isNotNull(), permute_pair(key, x["kind"], x["a"], x["b"], x["m"], x["n"]))
    return F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["form"].alias("form"), x["days"].alias("days"), text.alias("text"), pair.alias("pair"))


def put_together(x: Column) -> Column:
    """struct kind, value; kind is null where the value stays."""
    v, text, a, b = x["v"], x["text"], x["pair"]["a"], x["pair"]["b"]
    code = F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])", 0)
    check = (luhn(digits(v)) - luhn(F.concat(digits(text), F.lit("0"))) + 10) % 10
    country = F.substring(v, 1, 2)
    checks = F.lpad((98 - mod97(F.concat(text, country, F.lit("00")))).cast("string"), 2, "0")
    octets = F.concat_ws(".", *(y.cast("string") for half in (a, b) for y in (F.floor(half / 256), half % 256)))
    m, n = DAYS
    day = F.date_add(F.lit("1900-01-01").cast("date"), (F.floor(x["days"] / (m * n)) * (m * n) + a * n + b).cast("int"))
    date = case_of([(x["form"] == form, F.date_format(day, form)) for form in DATES])
    area = F.floor(a / 99)
    ssn = F.concat_ws("-", *(F.lpad(y.cast("string"), k, "0") for y, k in ((F.when(area >= 665, area + 2).otherwise(area + 1), 3), (a % 99 + 1, 2), (b + 1, 4))))
    new = case(
        x["kind"],
        email=F.concat(cased(F.substring_index(v, "@", 1), text), F.lit("@"), F.substring_index(v, "@", -1)),
        phone=F.when(text.isNotNull(), F.concat(code, laid(F.substring(v, F.length(code) + 1, F.lit(60)), text))),
        number=F.when(text.isNotNull(), laid(v, F.concat(text, check.cast("string")))),
        iban=F.concat(country, checks, laid(F.substring(v, 5, 60), text)),
        ip=F.when(a.isNotNull(), octets),
        # A year beyond four digits has no place in the format: such a date (after 9700) stays.
        date=F.when(F.length(date) == F.length(v), date),
        ssn=F.when(a.isNotNull(), ssn),
    )
    return F.struct(F.when(new.isNotNull(), x["kind"]).alias("kind"), F.coalesce(new, v).alias("value"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str = "kinds") -> DataFrame:
    """Replaces text_col by the text with pseudonyms and adds kinds_col, the kinds of the values found, in their order.

    A null text stays null, without kinds; an empty one and those without a value stay as they are, an empty table gives no
    rows, repeated rows become alike, and texts of any length are worked on whole. Numbers of 16 digits count without a right
    check digit too (kind number): account numbers have none. Values that match a pattern but aren't valid stay as they are, and so does
    all other text. Rows, their number and other columns stay, whatever their names; a column named as kinds_col is refused.
    The key stands in the plan: give it by a name that the session redacts, or keep plans and event logs private."""
    if kinds_col in docs.columns:
        raise ValueError(f"there is a column {kinds_col}: choose another name for kinds_col")
    found_col, new_col = "__inkwell_found", "__inkwell_new"
    pattern = union_pattern()
    text = F.col(text_col).cast("string")
    some = F.when(F.regexp_like(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = docs.withColumn(found_col, some)
    df = df.withColumn(new_col, F.transform(found_col, described))
    for step in (taken_apart, lambda x: permuted(key, x), put_together):
        df = df.withColumn(new_col, F.transform(new_col, step))
    between = F.split(text, pattern, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.col(new_col), lambda t, v: F.array(t, F.coalesce(v["value"], F.lit(""))))), "")
    kinds = F.coalesce(F.filter(F.transform(new_col, lambda v: v["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return df.withColumn(kinds_col, kinds).withColumn(text_col, F.when(F.size(found_col) > 0, joined).otherwise(text)).drop(found_col, new_col)
