"""Review and audit operators on small inputs: nulls, ties, empty tables, malformed files."""

import math

import pytest
from pyspark.sql import functions as F

from docket.functions import columns as C
from docket.operators import orders, review
from docket.sources import files


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def strings(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_violations_and_asks(spark):
    def kinds(quantity, price, unit_text, unit, selling, active=True):
        lit = lambda v, t: F.lit(v).cast(t)
        return one(spark, orders.violations(lit(quantity, "long"), lit(price, "long"), lit(unit_text, "string"), lit(unit, "string"), lit(selling, "string"), F.lit(2), F.lit(9), F.lit(100), F.lit(active)))[0]

    assert kinds(1, None, None, None, None) == ["unresolvable_product"]
    assert kinds(1, 99, None, None, "box") == ["below_moq", "price_mismatch"] and kinds(10, 100, "box", "box", "box", False) == ["discontinued", "above_max"]
    assert kinds(1, 99, "crate", None, "box") == ["unresolvable_unit"] and kinds(1, 99, "roll", "roll", "box") == ["unit_mismatch"] and kinds(None, None, None, None, "box") == []
    q = F.array(F.lit(1), F.lit(None).cast("int"))
    got = one(spark, orders.asks(q, F.lit(None).cast("string"), F.lit(2)), orders.asks(F.array(F.lit(1)), F.lit(None).cast("string"), F.lit(1)))
    assert got[0] == ["quantity", "delivery_site"] and got[1] == []


def test_reason_and_messages(spark):
    r = one(spark, review.reason(strings("x"), strings("y"), F.lit(1)), review.reason(strings(), strings("is a Reply"), F.lit(1)), review.reason(strings(), strings(), F.lit(1)))
    assert [tuple(x) for x in r] == [("violation", "x"), ("reply", "is a Reply"), ("band", "1 field — model moderately confident")]
    m = one(spark, review.submitted_message(F.lit(None).cast("string"), F.lit("O1"), F.lit(1), F.lit(123450)), review.held_message(F.lit("P"), strings("a", "b"), strings()))
    assert m[0] == "Order (no PO) accepted into the ERP as O1 — 1 line, $1,234.50." and m[1] == "Order P held for manual mapping — 2 product(s) not matched to a SKU: a, b."


def test_field_confidences(spark):
    tokens = ['{"po', '": ', '"A', '1"', ', "q": ', "5", ', "r": ', "5", "}"]
    df = spark.createDataFrame(
        [(tokens, [-1.0, -1.0, -0.2, -0.4, -1.0, -0.5, -1.0, -0.7, -1.0], [("po", "po", '"A1"'), ("q", "q", "5"), ("r", "r", "5"), ("s", "s", "9")]), ([], [], []), (None, None, None)],
        "t array<string>, l array<double>, f array<struct<path:string,key:string,value:string>>",
    )
    got = [r.m for r in df.select(review.field_confidences("t", "l", "f").alias("m")).collect()]
    assert got[0] == pytest.approx({"po": math.exp(-0.3), "q": math.exp(-0.5), "r": math.exp(-0.7)}) and got[1:] == [{}, {}]
    assert [tuple(x) for x in df.select(review.token_spans(F.col("t")).alias("s")).first().s][:3] == [(0, 4), (4, 7), (7, 9)]


def test_coverage_sample(spark):
    rows = spark.createDataFrame([(k, k % 10 == 0, k < 50) for k in range(200)], "id long, tenth boolean, low boolean")
    strata = {"tenth": F.col("tenth"), "low": F.col("low")}
    got = {r.id for r in review.coverage_sample(rows, strata, 8, 30, "id", 1).collect()}
    assert len(got) == 30 and sum(k % 10 == 0 for k in got) >= 8 and sum(k < 50 for k in got) >= 8
    assert got == {r.id for r in review.coverage_sample(rows.repartition(7), strata, 8, 30, "id", 1).collect()}
    with pytest.raises(ValueError, match="tenth"):
        review.coverage_sample(rows, strata, 21, 30, "id", 1)


def test_verdict_file(spark):
    text = ['{"id": "a", "realistic": true, "labels_correct": null, "notes": ""}', "", "{", '{"id": "d"}', '{"id": "e", "realistic": 1, "labels_correct": null, "notes": ""}', '{"id": "f", "realistic": null, "labels_correct": false, "notes": 3}', '{"id": "x", "realistic": null, "labels_correct": false, "notes": ""}', "[1]"]
    lines = spark.createDataFrame([(k + 1, v) for k, v in enumerate(text)], "line int, value string")
    expected = spark.createDataFrame([(k + 1, v) for k, v in enumerate("abcdefghi")], "line int, id string")
    got = {r.line: r.problem for r in review.verdict_problems(lines, expected).collect()}
    assert got == {2: "blank line", 3: "invalid JSON", 4: "keys", 5: "verdict is not true, false or null", 6: "notes is not a string", 7: "id out of order", 8: "keys", 9: "missing line"}
    assert review.verdict_problems(lines.limit(1), expected.limit(0)).first().problem == "line too many"
    none = spark.createDataFrame([], "realistic boolean, labels_correct boolean")
    assert tuple(review.verdict_progress(none).first()) == (0,) * 8


def test_authored_blocks(spark):
    head = "### HUM-0001\nFrom: A@B.c\nSent: 2026-03-05 09:00\nClass: {}\nSubject: s\n\n"
    sound = head.format("new_order") + "Hello\n\n\n```gold\n{}\n```\n"
    cases = {
        sound: None, head.format("what") + "x": "class", sound.replace("2026", "2025"): "sent", sound.replace("03-05", "02-30"): "sent", "### HUM-1\nx": "header", "### HUM-0001\nFrom: a\n": "truncated",
        sound.replace("\n```\n", "\n"): "open fence", sound + "more": "text after the fence", sound.replace("Hello", ""): "empty body", head.format("new_order") + "Hello": "gold missing", sound.replace("new_order", "other"): "gold not allowed",
    }
    for text, error in cases.items():
        df = spark.createDataFrame([(text,)], "t string")
        r = files.authored_blocks(df, "t", r"HUM-\d{4}", "Australia/Sydney", 2026, ["new_order", "other"], ["new_order"]).collect()
        assert [x.error for x in r] == [error], text
    both = spark.createDataFrame([(sound + sound.replace("0001", "0002"),), (None,), ("",)], "t string")
    got = files.authored_blocks(both, "t", r"HUM-\d{4}", "Australia/Sydney", 2026, ["new_order"], ["new_order"]).orderBy("id").collect()
    assert [(r.id, r.sender, r.body, r.gold) for r in got] == [("HUM-0001", "a@b.c", "Hello", "{}"), ("HUM-0002", "a@b.c", "Hello", "{}")]


def test_tables(spark):
    req = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "id int, hash string")
    cache = spark.createDataFrame([(1, "h", "p"), (2, "g", "q"), (3, None, "r")], "id int, hash string, payload string")
    assert {r.id: (r.outcome, r.payload) for r in review.cache_lookup(req, cache, ["id"], ["hash"]).collect()} == {1: ("hit", "p"), 2: ("stale", None), 3: ("hit", "r")}
    items = spark.createDataFrame([(1, "approved", {"a": "b"}, "x"), (2, "approved", None, "x"), (3, "rejected", {}, "x"), (4, "edited", {"a": "b"}, None), (5, "pending", {"a": "b"}, "x")], "id int, status string, edits map<string,string>, extraction string")
    assert {(r.id, r.correction_type) for r in review.corrections(items).collect()} == {(1, "edited"), (3, "rejected")} and [r.id for r in review.training_corrections(items).collect()] == [1]
    a = spark.createDataFrame([(1, "k"), (1, "k"), (2, "k"), (3, "j")], "id int, kind string")
    got = {r.kind: (r.flagged, r.derived, r.matched, r.reconciled) for r in review.ledger(a, a.where("id < 3"), "id", "kind").collect()}
    assert got == {"k": (2, 2, 2, True), "j": (1, 0, 0, False)}


def test_masks(spark):
    s = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, C.masked(F.lit("ab abc b"), s("ab", "abc"), "#"), C.contained(F.lit("abc"), s("ab", "abc")), C.contained(F.lit("abc ab"), s("ab", "abc")), C.contained(F.lit("x"), F.array().cast("array<string>")))
    assert tuple(r) == ("# # b", False, True, True)
    r = one(spark, C.transposed(F.lit("abc"), F.lit(2)), C.transposed(F.lit("abc"), F.lit(3)), C.transposed(F.lit(""), F.lit(1)), C.price_text(F.lit(1205)))
    assert tuple(r) == ("acb", "abc", "", "$12.05")
