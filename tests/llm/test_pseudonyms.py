"""Pseudonyms against a plain Python version, character by character, on a whole table and on forms that are easy to miss."""

import datetime
import hashlib

import pytest
import regex

from docket.llm import pii, queries

SF = "/root/testdata/sf0.001"
FIRST = datetime.date(1, 1, 1)


def sha(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def feistel_text(text, kind, key, hexadecimal=False):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(1, 7):
        digest, out = sha(key, kind, str(r), b), []
        for i, c in enumerate(a):
            by = int(hashlib.sha256((digest + str(i // 15)).encode()).hexdigest()[i % 15 * 4 :][:4], 16)
            if hexadecimal:
                out.append(f"{(int(c, 16) + by) % 16:x}")
            else:
                base, n = next(((x, m) for x, m, low, high in ((48, 10, "0", "9"), (97, 26, "a", "z"), (65, 26, "A", "Z")) if low <= c <= high), (None, None))
                out.append(c if n is None else chr((ord(c) - base + by) % n + base))
        a, b = b, "".join(out)
    return a + b


def feistel_number(n, kind, key, base):
    a, b = divmod(n, base)
    for r in range(1, 7):
        a, b = b, (a + int(sha(key, kind, str(r), str(b))[:12], 16)) % base
    return a * base + b


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10


def day_of(m):
    try:
        return datetime.date.fromisoformat(m) if "-" in m else datetime.date(int(m[6:]), int(m[3:5]), int(m[:2]))
    except ValueError:
        return None


def kind_of(m):
    whole = lambda p: regex.fullmatch(p, m)
    if "@" in m:
        return "email"
    if whole(pii.SECRET):
        return "secret"
    if whole(r"\d{1,3}(\.\d{1,3}){3}"):
        return "ip" if all(int(o) < 256 for o in m.split(".")) else None
    if whole(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}"):
        return "date" if day_of(m) else None
    if whole(r"\d{3}-\d{2}-\d{4}"):
        return None if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000" else "ssn"
    return "phone"


def put_back(m, digits):
    given = iter(digits)
    return "".join(next(given) if c in "0123456789" else c for c in m)


def pseudonym(m, kind, key):
    digits = regex.sub("[^0-9]", "", m)
    if kind == "email":
        at = m.rindex(".")
        return feistel_text(m[:at], kind, key) + m[at:]
    if kind == "secret":
        out = feistel_text(m.lower(), kind, key, True)
        return out.upper() if m == m.upper() else out
    if kind == "ip":
        n = feistel_number(int.from_bytes(bytes(map(int, m.split("."))), "big"), kind, key, 65536)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date":
        n, first, last = (day_of(m) - FIRST).days, (datetime.date(1900, 1, 1) - FIRST).days, (datetime.date(2099, 8, 5) - FIRST).days
        if first <= n <= last:
            n = feistel_number(n - first, "date", key, 270) + first
        else:
            others = (datetime.date(9999, 12, 31) - FIRST).days - (last - first)
            n = feistel_number(n if n < first else n - 72900, "other date", key, 1892)
            while n >= others:
                n = feistel_number(n, "other date", key, 1892)
            n += 72900 * (n >= first)
        d = FIRST + datetime.timedelta(n)
        return f"{d.year:04}-{d.month:02}-{d.day:02}" if "-" in m else f"{d.day:02}{m[2]}{d.month:02}{m[5]}{d.year:04}"
    if kind == "phone":
        code = regex.match(r"\+\d{1,3}(?=[ \-.(])|", m)[0]
        return code + put_back(m[len(code) :], feistel_text(regex.sub("[^0-9]", "", m[len(code) :]), kind, key))
    if kind == "ssn":
        return put_back(m, feistel_text(digits, kind, key))
    payload = feistel_text(digits[:-1], "card", key)
    return put_back(m, payload + str(-luhn(payload + "0") % 10))


def cards(run):
    """Spans of the cards in a run of digits."""
    groups = [(g.start(), g.end()) for g in regex.finditer(r"\d+", run)]
    plain = lambda a, b: regex.sub(r"\D", "", run[a:b])
    found, sizes = [], [b - a for a, b in groups]
    for i, (a, _) in enumerate(groups):
        for j, (_, b) in enumerate(groups[i : i + 19], i):
            if 13 <= len(plain(a, b)) <= 19 and luhn(plain(a, b)) == 0:
                shape = [y - x for x, y in groups[i : j + 1]]
                found.append((not (i == j or shape in ([4] * 4, [4, 6, 5])), a, a - b, b))
    even = set(sizes[:-1]) <= {sizes[0]} and sizes[-1] <= sizes[0]
    if 13 <= len(plain(0, len(run))) <= 19 and luhn(plain(0, len(run))) == 0 and (even or all(f[0] for f in found)):
        return [(0, len(run))]
    chosen = []
    for _, a, _, b in sorted(found):
        if all(b <= x or y <= a for x, y in chosen):
            chosen.append((a, b))
    return sorted(chosen)


def pseudonymised(text, key):
    out, found, at = [], [], 0

    def gap(part):
        last = 0
        for m in regex.finditer(pii.NUMBER, part):
            out.append(part[last : m.start()])
            last, inside = m.start(), 0
            for a, b in cards(m[0]):
                out.append(m[0][inside:a])
                found.append(("card", m[0][a:b], pseudonym(m[0][a:b], "card", key)))
                out.append(found[-1][2])
                inside = b
            out.append(m[0][inside:])
            last = m.end()
        out.append(part[last:])

    for m in regex.finditer(pii.CANDIDATE, text):
        gap(text[at : m.start()])
        kind = kind_of(m[0])
        if kind:
            found.append((kind, m[0], pseudonym(m[0], kind, key)))
        out.append(found[-1][2] if kind else m[0])
        at = m.end()
    gap(text[at:])
    return "".join(out), found


def test_query_equals_the_plain_version(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_pseudonyms(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        want, found = pseudonymised(text or "", "docket")
        assert (got[i].text, got[i].n_found, got[i].kinds) == (want, len(found), ",".join(k for k, *_ in found))
    assert sum(r.n_found for r in got.values()) > 20


CASES = {
    "+33 12 34 56 78": ["phone"], "41 11 11 11 11 11 11 11": ["card"], "order 43 4111 1111 1111 1111": ["card"], "order 4711 4111 1111 1111 1111 ok": ["card"],
    "2099-12-31 and 1899-05-01 and 0001-01-01 and 9999-12-31": ["date"] * 4, "31.12.2150, 01/02.1700": ["date"] * 2, "0000-01-01 2023-02-29": [],
    "a@b.c.d.e.f.g.h.i.example.org": ["email"], "jo@münchen.example": ["email"], "A1" * 16 + " " + "0f" * 32: ["secret"] * 2, "ab" * 33: [],
    "192.168.1.7 999.1.1.1": ["ip"], "078-05-1120 and 000-12-3456": ["ssn"], "": [],
}


def test_forms_that_are_easy_to_miss(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pseudonymise(df, "k").collect():
        want, found = pseudonymised(texts[r.doc_id], "k")
        assert [f.kind for f in r.found] == CASES[texts[r.doc_id]], texts[r.doc_id]
        assert (r.text, [tuple(f) for f in r.found]) == (want, found)
        assert all(f.value != f.pseudonym for f in r.found)
    card = lambda t: [f[2] for f in pseudonymised(t, "k")[1]]
    assert card("42 4111 1111 1111 1111") == card("4111 1111 1111 1111")  # linked across documents


@pytest.mark.parametrize("size", [32, 33])
def test_secrets_are_permuted(size):
    values = {f"{k:0{size}x}" for k in range(3000)}
    out = {feistel_text(v, "secret", "k", True) for v in values}
    assert len(out) == 3000 and all(len(v) == size and set(v) <= set("0123456789abcdef") for v in out)
