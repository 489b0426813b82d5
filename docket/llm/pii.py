"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

Candidates found by one regular expression are validated (Luhn for card numbers, ranges of octets, real dates)
and replaced by a keyed permutation within their format, a Feistel network whose round function is SHA-256 of key, kind and
the other half. Equal values get equal pseudonyms in every document, whatever separators stand
between their digits, different values different ones, and whoever has the key can invert them.

A run of digits that is no card as a whole is searched for cards between its separators.

Kinds: email (ASCII letters and digits of name and domain, not the last label), phone (digits after the country code), card (valid
by Luhn: payload permuted, check digit recomputed; other runs of digits stay), ssn, ip (32 bits), date (day number, in ISO or
day-month-year form; those of 1900-01-01 .. 2099-08-05 among themselves, all others of the years 1 to 9999 among themselves),
secret (runs of 32 to 64 hex digits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.common import texts

# What each kind looks like. The first alternative that matches at a place is taken.
EMAIL = r"[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,127}\p{L}{2,63}"  # as many labels as a name can have
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\-/.]?\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"\+\d{8,15}(?!\d)|\+\d{1,3}[ \-.]?\(?\d{2,4}\)?(?:[ \-.]?\d{2,4}){2,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ \-.]\d{4}(?!\d)|(?<![\d\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])"
NUMBER = r"(?<!\d)\d(?:[ \-]?\d){12,999}(?!\d)"  # between the others; longer runs are cut at a separator
CANDIDATE = "|".join(f"(?:{x})" for x in (EMAIL, SECRET, IP, DATE, SSN, PHONE))
ROUNDS = 6
DATE_BASE, OTHER_BASE = 270, 1892  # 270 ** 2 days from 1900-01-01; 1892 ** 2 is the least square that all other days fit in
FIRST_DAY, OTHER_DAYS = 693_595, 3_579_159  # from 0001-01-01 to 1900-01-01; days of the years 1 to 9999 without those
KINDS = ("email", "secret", "ip", "date", "ssn", "phone", "card")


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _shifted(text: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each letter or digit moved within its own alphabet, or as a hex digit, by four hex digits of the digest; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(F.sha2(F.concat(digest, (F.floor(i / 15)).cast("string")), 256), 1, 64).substr((i % 15 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
        if hexadecimal:
            return F.lower(F.conv(((F.conv(c, 16, 10).cast("int") + by) % 16).cast("string"), 10, 16))
        moved = lambda base, n: F.chr((F.ascii(c) - base + by) % n + base)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute_text(text: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """Feistel network over the characters of a text: same length, same kind of character at each place (or all lower hex digits)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), half).alias("a"), text.substr(half + 1, F.length(text)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        digest = _sha(F.lit(key), F.lit(kind), r.cast("string"), s["b"])
        return F.struct(s["b"].alias("a"), F.when(s["a"] == "", "").otherwise(_shifted(s["a"], digest, hexadecimal)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def permute_number(number: Column, kind: str, key: str, base: int) -> Column:
    """Feistel network over 0 .. base * base - 1."""
    start = F.struct(F.floor(number / base).cast("long").alias("a"), (number % base).cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        by = F.conv(F.substring(_sha(F.lit(key), F.lit(kind), r.cast("string"), s["b"].cast("string")), 1, 12), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), ((s["a"] + by) % base).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * base + s["b"])


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits that stand before a check digit."""
    digits = F.reverse(F.split(payload, ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("long"))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return (_luhn_sum(digits.substr(F.lit(1), F.length(digits) - 1)) + F.right(digits, F.lit(1)).cast("int")) % 10 == 0


def _put_back(original: Column, digits: Column) -> Column:
    """``original`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["o"], F.when(digit, digits.substr(s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(original, ""), start, step, lambda s: s["o"])


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it does not validate."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(F.replace(m, F.lit("/"), F.lit(".")), "dd.MM.yyyy"))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(f"^(?:{SECRET})$"), "secret")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), F.when(day >= F.lit("0001-01-01").cast("date"), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(?:000|666|9..)|-00-|-0000$"), "ssn"))
        .when(m.startswith("+") | m.startswith("(") | m.rlike(r"^\d{3}[\-.]\d{3}[\-.]\d{4}$"), "phone")
    )


def _cards(run: Column) -> Column:
    """A run of digits as an array of (kind, value) that make it up: cards, and what is none with a null kind.

    The run itself if it is valid and of even groups (the last may be shorter), else its valid sub-runs of 13 to 19 digits from
    separator to separator that do not overlap: first those that are written as cards are (4-4-4-4, 4-6-5 or without separators), then
    from the left, long before short. A valid run of uneven groups goes whole if it holds no sub-run that is written as cards are.
    """
    part = lambda kind, value: F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"))
    size = lambda groups: F.length(F.array_join(groups, "")).cast("int")
    valid = lambda digits: F.when(F.length(digits).between(13, 19), luhn_valid(digits)).otherwise(False)
    groups = F.split(run, "[ -]")

    def spans(i: Column) -> Column:
        start = size(F.slice(groups, F.lit(1), i)) + i

        def span(j: Column) -> Column:
            some = F.slice(groups, i + 1, j - i + 1)
            shape = F.array_join(F.transform(some, lambda g: F.length(g).cast("string")), "-")
            rank = F.when((i == j) | shape.isin("4-4-4-4", "4-6-5"), 0).otherwise(1)
            return F.struct(rank.alias("rank"), start.alias("a"), (-size(some) - (j - i)).alias("less"), F.array_join(some, "").alias("digits"))

        return F.filter(F.transform(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), span), lambda s: valid(s["digits"]))

    found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), spans)))
    sizes = F.transform(groups, F.length)
    even = F.forall(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(1))), lambda n: n == sizes[0]) & (F.element_at(sizes, -1) <= sizes[0])
    whole = valid(F.regexp_replace(run, "[^0-9]", "")) & (even | ~F.exists(found, lambda s: s["rank"] == 0))
    found = F.transform(found, lambda s: F.struct(s["a"].alias("a"), (s["a"] - s["less"]).alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    chosen = F.array_sort(F.aggregate(found, none, lambda out, s: F.when(F.exists(out, lambda o: (o["a"] < s["b"]) & (s["a"] < o["b"])), out).otherwise(F.concat(out, F.array(s)))))
    begun = F.struct(F.array().cast("array<struct<kind:string,value:string>>").alias("out"), F.lit(0).alias("at"))
    cut = lambda a, b: run.substr(a + 1, b - a)
    step = lambda s, c: F.struct(F.concat(s["out"], F.array(part(None, cut(s["at"], c["a"])), part("card", cut(c["a"], c["b"])))).alias("out"), c["b"].alias("at"))
    inside = F.aggregate(chosen, begun, step, lambda s: F.concat(s["out"], F.array(part(None, cut(s["at"], F.length(run))))))
    return F.when(whole, F.array(part("card", run))).otherwise(inside)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The replacement of a validated candidate."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    last = F.regexp_extract(m, r"\.\p{L}+$", 0)
    body = m.substr(F.lit(1), F.length(m) - F.length(last))
    email = F.concat(permute_text(body, "email", key), last)
    octet = lambda k: F.split(m, r"\.")[k].cast("long")
    number = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    ip_array = F.transform(F.array(permute_number(number, "ip", key, 65536)), lambda n: F.concat_ws(".", F.floor(n / 16777216), F.floor(n / 65536) % 256, F.floor(n / 256) % 256, n % 256))
    iso = m.contains("-")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.replace(m, F.lit("/"), F.lit(".")), "dd.MM.yyyy"))
    number_of_day = F.datediff(day, F.lit("0001-01-01")).cast("long")
    usual = lambda n: n.between(FIRST_DAY, FIRST_DAY + DATE_BASE**2 - 1)
    near = permute_number(number_of_day - FIRST_DAY, "date", key, DATE_BASE) + FIRST_DAY
    place = F.when(number_of_day < FIRST_DAY, number_of_day).otherwise(number_of_day - DATE_BASE**2)
    # Cycle walking: what falls out of the days is permuted again. One value in 7,000 does, so never 12 times in a row.
    walk = lambda n, k: F.when((k > 1) & (n < OTHER_DAYS), n).otherwise(permute_number(n, "other date", key, OTHER_BASE))
    far = F.aggregate(F.sequence(F.lit(1), F.lit(12)), place, walk, lambda n: F.when(n < FIRST_DAY, n).otherwise(n + DATE_BASE**2))
    moved = F.date_add(F.lit("0001-01-01").cast("date"), F.when(usual(number_of_day), near).otherwise(far).cast("int"))
    date = F.transform(F.array(moved), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), F.substring(m, 3, 1), F.date_format(d, "MM"), F.substring(m, 6, 1), F.date_format(d, "yyyy"))))[0]
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ \-.(])", 0)
    local = m.substr(F.length(code) + 1, F.length(m))
    phone = F.concat(code, _put_back(local, permute_text(F.regexp_replace(local, "[^0-9]", ""), "phone", key)))
    payload = F.transform(F.array(permute_text(digits.substr(F.lit(1), F.length(digits) - 1), "card", key)), lambda p: F.concat(p, ((10 - _luhn_sum(p) % 10) % 10).cast("string")))[0]
    secret = F.transform(F.array(permute_text(F.lower(m), "secret", key, True)), lambda d: F.when(m == F.upper(m), F.upper(d)).otherwise(d))[0]
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", secret)
        .when(kind == "ip", ip_array[0])
        .when(kind == "date", date)
        .when(kind == "ssn", _put_back(m, permute_text(digits, "ssn", key)))
        .when(kind == "phone", phone)
        .when(kind == "card", _put_back(m, payload))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, n_found, and found: array of (kind, value, pseudonym) in text order.

    A null text is empty and stays so. A candidate that does not validate stays as it is and is not in ``found``. Text outside of
    values is unchanged byte for byte. Equal values have equal pseudonyms in all rows under one key. Rows are
    independent: no shuffle, repeated rows and rows without an id are treated like any other, other columns are ignored. Texts of any length are read
    whole; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    plain = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))
    between = lambda text, pattern: F.split(text, pattern, -1)
    matches = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ended = lambda found: F.concat(found, F.array(F.lit("")))
    gap = lambda g: F.flatten(F.zip_with(between(g, NUMBER), ended(matches(g, NUMBER)), lambda x, run: F.concat(F.array(plain(x)), F.when(run == "", F.array(plain(run))).otherwise(_cards(run)))))
    other = lambda m: F.struct(F.when(m != "", kind_of(m)).alias("kind"), m.alias("value"))
    parts = F.flatten(F.zip_with(between("text", CANDIDATE), ended(matches("text", CANDIDATE)), lambda g, m: F.concat(gap(g), F.array(other(m)))))
    done = F.transform("f", lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), F.when(f["kind"].isNotNull(), pseudonym(f["value"], f["kind"], key)).otherwise(f["value"]).alias("pseudonym")))
    found = F.filter("r", lambda r: r["kind"].isNotNull())
    rows = rows.withColumn("f", parts).withColumn("r", done)
    return rows.select(
        "doc_id",
        F.array_join(F.transform("r", lambda r: r["pseudonym"]), "").alias("text"),
        F.size(found).cast("long").alias("n_found"),
        found.alias("found"),
    )
