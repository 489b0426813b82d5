"""Terms in texts against a regular expression of all terms, longest first; blocks of terms give the same."""

import random
import re

import pytest

from docket.operators import surfaces

TERMS = ["tape", "blue tape", "Tape dispenser", "a-b", "b c", "c", "straße", "x_1", "", "12", "tape"]


def plain(text, terms):
    ordered = sorted({t for t in terms if t}, key=len, reverse=True)
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, ordered)) + r")\b", text or "", re.I)]


def some_texts(seed):
    rng = random.Random(seed)
    parts = ["tape", "Blue TAPE", "tapes", "blue", "dispenser", "a-b", "b c", "c", "Straße", "x_1", "12", "112", ",", ".", "\n", "é", "İ"]
    return [(i, rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))) for i in range(120)] + [(900, None), (901, ""), (902, "blue tape " * 4000)]


@pytest.mark.parametrize("most_bytes", [32 << 20, 150])
def test_spans(spark, most_bytes):
    rows = some_texts(1)
    texts = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, spans_ int")
    terms = spark.createDataFrame([(t,) for t in TERMS] + [(None,)], "term string")
    out = surfaces.masked_spans(surfaces.term_spans(texts, terms, most_bytes=most_bytes))
    assert out.columns == ["id", "text", "spans_", "spans", "rest"]
    got = {r.id: r for r in out.collect()}
    for i, t in rows:
        want = plain(t, TERMS)
        assert [(s.start, s.end, s.term.lower()) for s in got[i].spans] == want
        rest = t or ""
        for a, b, _ in reversed(want):
            rest = rest[:a] + surfaces.MASK + rest[b:]
        assert got[i].rest == rest


def test_closures(spark):
    texts = spark.createDataFrame([(1, "Send 12 rolls of blue tape"), (2, "and Tape"), (3, "12 7"), (4, None), (5, "glue")], "id long, text string")
    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    got = {r.id: r.left for r in surfaces.closures(texts, frame("12", "blue tape"), frame("tape", "glue")).collect()}
    assert got == {1: None, 2: "tape", 3: "digit", 4: None, 5: "glue"}
    assert {r.id: r.left for r in surfaces.closures(texts, frame(), frame()).collect()} == {1: "digit", 2: None, 3: "digit", 4: None, 5: None}
