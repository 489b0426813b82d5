"""Corpus statistics, contracts between scenario fields, coverage, and the small text rules of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.columns import bucket, masked, price_text, ratio

# Words for quantities and days.
NUMBER_WORDS = {6: "half a dozen", 12: "a dozen", 24: "two dozen"}
RELATIVE_DAYS = {3: "in 3 days", 5: "in 5 days", 7: "in a week", 10: "in 10 days", 14: "in a fortnight"}
PRICE_FACTORS = (0.85, 0.9, 0.95, 1.1)


def corpus_stats(records: DataFrame, flags: str, lists: dict[str, str]) -> DataFrame:
    """(kind, name, n, rate) over records: flags set, values of the ``lists`` columns (kind -> array or plain column), in one pass over the rows.

    A rate is n by records; of arrays that may hold a value twice it is the number of values per record.
    """
    flat = [F.transform(F.map_keys(F.map_filter(flags, lambda k, v: v)), lambda k: F.struct(F.lit("flag").alias("kind"), k.alias("name")))]
    for kind, c in lists.items():
        values = F.col(c) if dict(records.dtypes)[c].startswith("array") else F.array(F.col(c).cast("string"))
        flat.append(F.transform(F.filter(values, lambda v: v.isNotNull()), _named(kind)))
    total = records.agg(F.count("*").alias("records"))
    out = records.select(F.explode(F.concat(*flat)).alias("s")).groupBy("s.kind", "s.name").agg(F.count("*").alias("n")).join(total)  # one row
    return out.select("kind", "name", "n", ratio(F.col("n"), F.col("records")).alias("rate"))


def _named(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name"))


def class_mix_problems(mix: DataFrame, classes: list[str]) -> DataFrame:
    """(class, problem): classes without a weight, unknown ones, weights that are not above zero."""
    known = mix.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    out = lambda df, what: df.select("class", F.lit(what).alias("problem"))
    return out(known.join(mix, "class", "left_anti"), "missing").union(out(mix.join(known, "class", "left_anti"), "unknown")).union(out(mix.where(~F.coalesce(F.col("weight") > 0, F.lit(False))), "weight"))


def reference_problem(po: Column, temporal: Column) -> Column:
    """An amendment or cancellation names exactly one of an order number and a time."""
    return F.when(po.isNull() == temporal.isNull(), "reference")


def change_problem(change: Column, line: Column, quantity: Column, unit: Column, phrase: Column, date: Column) -> Column:
    """A change of date carries a phrase and a date and no line; a change of an item a line and neither; a removal no quantity or unit."""
    dated = line.isNull() & phrase.isNotNull() & date.isNotNull()
    item = line.isNotNull() & phrase.isNull() & date.isNull()
    return F.when((change == "date_change") & ~dated, "date").when((change != "date_change") & ~item, "item").when((change == "remove_item") & (quantity.isNotNull() | unit.isNotNull()), "removal")


def impure(records: DataFrame, key: str, prefix: str) -> DataFrame:
    """Records whose id is not of the namespace ``prefix``."""
    return records.where(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def coverage(records: DataFrame, counts: dict[str, tuple[int, Column]], distinct: dict[str, tuple[int, Column]]) -> DataFrame:
    """(what, wanted, found, met): rows that a predicate holds for, and distinct values, against their minimum; one pass."""
    named = {**{n: (m, F.count_if(c)) for n, (m, c) in counts.items()}, **{n: (m, F.count_distinct(c)) for n, (m, c) in distinct.items()}}
    row = records.agg(*(c.alias(f"c{k}") for k, (_, c) in enumerate(named.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("what"), F.lit(m).cast("long").alias("wanted"), F.col(f"c{k}").alias("found")) for k, (n, (m, _)) in enumerate(named.items())))
    return row.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.found") >= F.col("r.wanted")).alias("met"))


def gate_verdict(metrics: DataFrame, regressed: str) -> DataFrame:
    """One row: passed if no metric regressed."""
    return metrics.agg(F.count("*").alias("metrics"), F.coalesce(~F.bool_or(regressed), F.lit(True)).alias("passed"))


def gain_gate(gain: Column, drop: Column, most: float = 0.05) -> Column:
    """Something gained and less than ``most`` lost."""
    return (gain > 0) & (drop < most)


def expanded_po(template: Column, *keys: Column) -> Column:
    """A purchase-order number of a template: each '#' becomes a digit told by the keys and its place."""
    return F.array_join(F.transform(F.split(template, ""), lambda c, i: F.when(c == "#", bucket(10, *keys, i).cast("string")).otherwise(c)), "")


def unclosed(text: Column, surfaces: Column, terms: Column) -> Column:
    """What is left of a text after its surfaces are masked though a surface should have held it: "digit", or the first term."""
    rest = masked(text, surfaces)
    left = F.filter(terms, lambda w: F.lower(rest).contains(F.lower(w)))
    return F.when(rest.rlike(r"\d"), "digit").otherwise(F.get(left, F.lit(0)))


def corrupted_price(cents: Column, pick: Column) -> Column:
    """A wrong price: the true one times the factor that ``pick`` chooses, rounded half to even, one less where that changes nothing."""
    wrong = F.bround(cents * F.element_at(F.array(*map(F.lit, PRICE_FACTORS)), (pick % len(PRICE_FACTORS) + 1).cast("int")), 0).cast("long")
    return F.when(wrong == cents, cents - 1).otherwise(wrong)


def _lookup(names: dict[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))


def number_words(quantity: Column) -> Column:
    return F.try_element_at(_lookup(NUMBER_WORDS), quantity.cast("int"))


def quantity_of(words: Column) -> Column:
    return F.try_element_at(_lookup({v: k for k, v in NUMBER_WORDS.items()}), F.lower(F.trim(words)))


def relative_phrase(days: Column) -> Column:
    return F.try_element_at(_lookup(RELATIVE_DAYS), days.cast("int"))


def due_date(sent: Column, phrase: Column) -> Column:
    """The date that a relative phrase means, as '5 July'; null for another phrase."""
    days = F.try_element_at(_lookup({v: k for k, v in RELATIVE_DAYS.items()}), F.lower(F.trim(phrase)))
    return F.date_format(F.date_add(sent.cast("date"), days), "d MMMM")


def rendered_line(quantity: Column, unit: Column, product: Column, cents: Column) -> Column:
    """An order line as a customer writes it: '5 cartons of X @ $1.20', without what is not stated."""
    return F.concat_ws(" ", quantity.cast("string"), F.concat(unit, F.lit(" of")), product, F.when(cents.isNotNull(), F.concat(F.lit("@ "), price_text(cents))))


def gold_surfaces(order: Column) -> Column:
    """The texts of an order that its message must show: header fields and line fields that are neither null nor empty."""
    head = F.array(*(order[f] for f in ("customer_po_text", "requested_date_text", "delivery_address_text", "buyer_name_text")))
    lines = F.flatten(F.transform(order["line_items"], lambda i: F.array(i["product_text"], i["quantity"].cast("string"), i["unit_text"], i["unit_price_text"])))
    return F.filter(F.concat(head, lines), lambda s: s.isNotNull() & (s != ""))


def ordinary_tokens(tokens: Column) -> Column:
    """Tokens without the special ones, '<|...|>'."""
    return F.filter(tokens, lambda t: ~(t.startswith("<|") & t.endswith("|>")))


def latest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` rows last in order, oldest first: a top-k."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)
