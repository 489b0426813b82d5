"""The review as windows and as a stream against a plain fold; keyed tables and sources read once under replays and crashes."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docket.operators import reviewing
from docket.operators.evaluation import ORDER_FIELDS
from docket.operators.flow import apply_edits, missing_after
from docket.plans.streams import rocks_state
from docket.sources import store
from docket.streaming import inbox, reviews, upserts

START = datetime.datetime(2024, 1, 1)
LINE = {"product_text": "Tape", "quantity": 5, "unit_text": None, "unit_price_text": None, "item_notes": None}
EDITS = [
    None, {}, {"buyer_name_text": "C"}, {"buyer_name_text": "C", "line_items.0.quantity": "500"}, {"line_items.0.product_text": "none"}, {"line_items.0.quantity": " 7 ", "line_items.0.product_text": "box", "buyer_name_text": "D"},
    {"line_items.0": "__deleted__"}, {"line_items.99999999999.product_text": "a"}, {"line_items.0.quantity": "--3"}, {"line_items.0.quantity": "a lot"},
    {"customer_po_text": "Q", "requested_date_text": "r", "delivery_address_text": "d", "buyer_name_text": "é", "line_items.0.product_text": "BOX ", "line_items.0.quantity": "9"},
]
CATALOGUE = {"tape": (1, 100), "box": (2, 50)}


def order(i):
    if i % 9 == 0:
        return None
    return {"customer_po_text": "P1", "requested_date_text": "soon", "delivery_address_text": "x", "buyer_name_text": None if i % 3 == 0 else "B", "notes": None, "line_items": [dict(LINE)] if i % 4 else []}


def log_rows(seed, items=50):
    rng, rows = random.Random(seed), []
    at = lambda s: START + datetime.timedelta(seconds=s)
    for i in range(items):
        rows.append((i, at(rng.randint(0, 2)), 0, "submitted", order(i), None))
        rows += [(i, at(1 + k // 2), k + 1, rng.choice(["approved"] * 3 + ["edited", "edited", "rejected"]), None, rng.choice(EDITS)) for k in range(rng.randint(0, 12))]
    rows.append((7, at(9), 99, "submitted", order(8), None))  # a second submission of an item changes nothing
    rows.append((1000, at(1), 1, "approved", None, None))  # never submitted
    return rows


def plain(rows):
    """Each item's decisions one after the other."""
    out = {}
    for i in sorted({r[0] for r in rows}):
        s = None
        for _, _, _, action, extraction, edits in sorted((r for r in rows if r[0] == i), key=lambda r: (r[1], r[2])):
            if action == "submitted" or s is None:
                if action == "submitted" and s is None:
                    s = {"from": extraction, "status": "pending", "edits": {}, "n": 0, "refused": 0, "sent": 0, "held": 0, "id": None, "amends": None, "for": None}
                continue
            edits = dict(edits or {})
            s["n"] += 1
            if action == "approved" and not reviews.complete(reviews.edited(s["from"], s["edits"])):
                s["refused"] += 1
                continue
            if action != "approved" or edits:
                s["edits"] = edits
            s["status"] = "approved" if action == "edited" and not edits else action
            version = reviews.version(s["edits"])
            if action != "approved" or s["id"] and s["for"] == version:
                continue
            lines = reviews.edited(s["from"], s["edits"])["line_items"]
            known = [CATALOGUE.get(" ".join((x["product_text"] or "").lower().split())) for x in lines]
            if lines and all(c and x["quantity"] is not None and c[0] <= x["quantity"] <= c[1] for c, x in zip(known, lines)):
                new = "ORD-" + hashlib.sha256(f"{i}|{version}".encode()).hexdigest()[:8].upper()
                s |= {"amends": s["id"], "id": new, "for": version, "sent": s["sent"] + 1}
            else:
                s |= {"held": s["held"] + 1, "for": s["for"] if s["id"] else version}
        if s:
            out[i] = (i, s["status"], reviews.version(s["edits"]), s["n"], s["refused"], s["sent"], s["held"], s["id"] is not None, s["id"], s["amends"], s["for"])
    return [out[i] for i in sorted(out)]


@pytest.fixture(scope="module")
def dims(spark):
    terms = spark.createDataFrame([("tape", "T"), ("box", "B")], "term string, sku string")
    return terms, spark.createDataFrame([("T", 1, 100, 250), ("B", 2, 50, 100)], "sku string, moq long, most long, price_cents long")


def test_one_order_edited_in_rows_and_columns(spark):
    """The row form of the state machine and the column form agree on every order and set of edits."""
    cases = [(order(i), dict(e or {})) for i in (0, 1, 3, 4, 6) for e in EDITS]
    df = spark.createDataFrame(cases, f"o {reviewing.ORDER}, e map<string,string>")
    made = apply_edits(F.col("o"), F.col("e"))
    got = df.select(made.alias("made"), (F.size(missing_after(made, ORDER_FIELDS)) == 0).alias("complete"), reviewing.version_of(F.col("e")).alias("version")).collect()
    for (o, e), r in zip(cases, got):
        assert reviews.edited(o, e) == r.made.asDict(True)
        assert (reviews.complete(reviews.edited(o, e)), reviews.version(e)) == (r.complete, r.version)


@pytest.mark.parametrize("seed", [1, 2])
def test_review(spark, dims, seed):
    rows = log_rows(seed)
    got = sorted(tuple(r) for r in reviewing.review(spark.createDataFrame(rows, reviewing.LOG), *dims).collect())
    assert got == plain(rows)
    assert sum(r[4] for r in got) and sum(r[6] for r in got) and any(r[9] for r in got)  # refused, held and amended ones are there


def test_review_of_nothing(spark, dims):
    assert reviewing.review(spark.createDataFrame([], reviewing.LOG), *dims).collect() == []


def test_review_stream_restarts(spark, dims, tmp_path):
    """Three runs from one checkpoint; the second is cut off after its table is merged, before its batch is logged, and so runs again."""
    rows, (terms, products) = log_rows(3), dims
    table = upserts.KeyedTable(spark, f"{tmp_path}/table", reviewing.STATE, ["item"], 4)
    schema, merge, merged = spark.createDataFrame([], reviewing.LOG).schema, table.merge, []

    def cut_off(rows_, batch, fold):
        merged.append(merge(rows_, batch, fold))
        if len(merged) == 2:
            raise RuntimeError("executor lost")

    table.merge = cut_off
    for k, (a, b) in enumerate([(0, 2), (2, 4), (4, 99)]):
        part = [r for r in rows if a <= (r[1] - START).total_seconds() < b]
        spark.createDataFrame(part, reviewing.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = lambda: reviews.review_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, terms, products, f"{tmp_path}/checkpoint")
        with rocks_state(spark):
            if k == 1:
                with pytest.raises(Exception, match="executor lost"):
                    run()
            assert run() == 1
    assert merged == [True, True, False, True]
    want = {r[0]: r for r in plain(rows)}
    got = {r.item: tuple(r) for r in table.read().collect()}
    assert got == {i: want[i] for i in got}
    assert all(want[i][3] == 0 for i in set(want) - set(got))


def usage(spark, rows):
    return spark.createDataFrame(rows, "org string, n long")


def test_keyed_table(spark, tmp_path):
    table = upserts.KeyedTable(spark, f"{tmp_path}/t", "org string, n long", ["org"], 4)
    add = upserts.adding(["org"], ["n"])
    assert table.read().collect() == []
    assert table.merge(usage(spark, [("a", 1), ("b", 2), ("a", 3), (None, 5)]), 0, add)
    assert not table.merge(usage(spark, [("a", 1000)]), 0, add)
    assert table.merge(usage(spark, []), 1, add)
    before = table._version()[1]["where"]
    assert table.merge(usage(spark, [("a", 10)]), 2, add)
    after = table._version()[1]["where"]
    assert sum(before.get(b) != v for b, v in after.items()) == 1  # the other buckets are as they were
    assert {r.org: r.n for r in table.read().collect()} == {"a": 14, "b": 2, None: 5}
    assert table.merge(usage(spark, [("b", 1)]), 0, add, writer="other")  # batches are counted by writer
    assert not table.merge(usage(spark, [("b", 1)]), 2, add)
    assert {r.org: r.n for r in table.read().collect()} == {"a": 14, "b": 3, None: 5}


def test_keyed_table_crash_and_race(spark, tmp_path, monkeypatch):
    table = upserts.KeyedTable(spark, f"{tmp_path}/t", "org string, n long", ["org"], 4)
    add = upserts.adding(["org"], ["n"])
    table.merge(usage(spark, [("a", 1)]), 0, add)
    put = store.put

    def crash(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(store, "put", crash)
    with pytest.raises(OSError):
        table.merge(usage(spark, [("a", 2)]), 1, add)
    monkeypatch.setattr(store, "put", put)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]  # the data lie there, but no record names them
    other = upserts.KeyedTable(spark, f"{tmp_path}/t", "org string, n long", ["org"], 4)

    def late(rows, fold=add):
        def inner(old, new):
            other.merge(usage(spark, [("c", 7)]), 0, add, writer="other")  # commits in between
            return fold(old, new)

        return inner

    with pytest.raises(FileExistsError):
        table.merge(usage(spark, [("a", 2)]), 1, late(None))
    assert table.merge(usage(spark, [("a", 2)]), 1, add)
    assert {r.org: r.n for r in table.read().collect()} == {"a": 3, "c": 7}
    table.merge(usage(spark, [("a", 1)]), 2, add)
    assert len(store.names(spark, f"{tmp_path}/t/data")) <= 4 and len(store.names(spark, f"{tmp_path}/t/log")) == 2  # what no version names is gone


def test_replacing(spark, tmp_path):
    table = upserts.KeyedTable(spark, f"{tmp_path}/t", "org string, plan string, at long", ["org"], 2)
    rows = lambda *r: spark.createDataFrame(r, "org string, plan string, at long")
    fold = upserts.replacing(["org"], ["at"])
    table.merge(rows(("a", "pro", 5), ("b", "free", 1), ("a", "old", 4)), 0, fold)
    table.merge(rows(("a", "late", 3), ("b", "tie", 1)), 1, fold)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "pro", 5), ("b", "tie", 1)]


def test_inbox(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, body string").schema
    error = F.when(F.col("body").isNull(), "empty").when(F.col("body") == "bad", "bad")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda hook=None: inbox.consume(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), error, f"{tmp_path}/out", f"{tmp_path}/log", hook)
    rows = lambda dead: sorted(tuple(r)[:-1] for r in inbox.consumed(spark, f"{tmp_path}/out", schema, dead).collect())
    assert rows(False) == rows(True) == []
    put((1, "x"), (2, "bad"), (3, None))

    def killed(*_):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed)  # the rows are written, the batch is not logged
    assert run() == 1
    assert (rows(False), rows(True)) == ([(1, "x")], [(2, "bad", "bad"), (3, None, "empty")])
    assert run() == 0  # a second start reads nothing
    put((4, "bad"))
    put((5, "y"), (1, "x"))
    assert run() == 1
    assert (rows(False), rows(True)) == ([(1, "x"), (1, "x"), (5, "y")], [(2, "bad", "bad"), (3, None, "empty"), (4, "bad", "bad")])
