"""Order rules, roll-up, review queue, edits, metering, corpus engineering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.functions.columns import bucket

ROUTES = {"new_order": "extract", "amendment": "extract", "cancellation": "cancel", "inquiry": "inquiry", "other": "discard"}


def route_of(label: Column) -> Column:
    """Route of an e-mail class; null for anything else."""
    out = F.lit(None).cast("string")
    for k, v in ROUTES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def violations(quantity: Column, price: Column, unit_text: Column, unit: Column, selling_unit: Column, moq: Column, most: Column, list_price: Column, active: Column) -> Column:
    """Kinds of violation of a line. ``unit`` is what the stated ``unit_text`` resolves to; ``selling_unit`` is null for an
    unknown product. Quantity and price are judged only where no unit is stated or it is the selling unit."""
    known = selling_unit.isNotNull()
    fits = known & (unit_text.isNull() | F.coalesce(unit == selling_unit, F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(~known, "unresolvable_product"),
            F.when(known & ~active, "discontinued"),
            F.when(known & unit_text.isNotNull() & unit.isNull(), "unresolvable_unit"),
            F.when(known & unit_text.isNotNull() & (unit != selling_unit), "unit_mismatch"),
            F.when(fits & (quantity < moq), "below_moq").when(fits & (quantity > most), "above_max"),
            F.when(fits & (price != list_price), "price_mismatch"),
        )
    )


def asks(quantities: Column, address: Column, sites: Column) -> Column:
    """What to ask the sender: a quantity if any line has none, the site if no address is given and there are several."""
    return F.array_compact(F.array(F.when(F.exists(quantities, lambda q: q.isNull()), "quantity"), F.when(address.isNull() & (sites > 1), "delivery_site")))


def merged_asks(first: Column, then: Column) -> Column:
    """What to ask after both the rules and the message itself: the one's asks and then the other's, repeats kept; null is none."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(first, none), F.coalesce(then, none))


def route_order(n_violations: Column, n_asks: Column) -> Column:
    return F.when(n_violations > 0, "exception").when(n_asks > 0, "clarification").otherwise("touchless")


def build_orders(lines: DataFrame, order: str) -> DataFrame:
    """Per order from lines (sku, quantity, moq, most, price_cents): blocked if any line is unresolved or its quantity missing, below or above."""
    q = F.col("quantity")
    issue = F.when(F.col("sku").isNull(), "unresolved").when(q.isNull(), "missing").when(q < F.col("moq"), "below_moq").when(q > F.col("most"), "above_max")
    x = lines.withColumn("issue", issue)
    total = F.sum(F.when(F.col("sku").isNotNull() & q.isNotNull(), q * F.col("price_cents")).otherwise(0))
    return x.groupBy(order).agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("issue") == "unresolved").alias("unresolved"), F.count_if(F.col("issue").isNotNull() & (F.col("issue") != "unresolved")).alias("issues"),
        F.coalesce(total, F.lit(0)).cast("long").alias("total_cents"), F.bool_or(F.col("issue").isNotNull()).alias("blocked"),
    )


def priority(n_violations: Column, n_asks: Column, n_band: Column) -> Column:
    return 10 * n_violations + 4 * n_asks + n_band


def in_band(c: Column, low: float = 0.80, high: float = 0.95) -> Column:
    return c.between(low, high)


def queue(items: DataFrame, tenant: object | None = None, limit: int | None = None) -> DataFrame:
    """Items of one tenant (all if None) by priority, then id; with a limit, a top-k."""
    seen = items if tenant is None else items.where(F.col("org_id") == tenant)
    ordered = seen.orderBy(F.desc("priority"), "id")
    return ordered.limit(limit) if limit is not None else ordered


def latest_decision(log: DataFrame, item: str, time: str, tie: str) -> DataFrame:
    """Status and edits of each item: an approval without edits keeps those before it, every other decision sets them (a rejection
    to none); an edit without edits is an approval."""
    none = F.coalesce(F.col("edits"), F.lit("")) == ""
    order = F.struct(F.col(time), F.col(tie))
    status = F.when((F.col("action") == "edited") & none, "approved").otherwise(F.col("action"))
    sets = F.when(~((F.col("action") == "approved") & none), order)
    last = log.groupBy(item).agg(F.max_by(status, order).alias("status"), F.max_by(F.coalesce(F.col("edits"), F.lit("")), sets).alias("edits"), F.count("*").alias("decisions"))
    return last.select(item, "status", F.nullif(F.col("edits"), F.lit("")).alias("edits"), "decisions")


def amendment_chain(sent: DataFrame, item: str, order_id: str, time: str, tie: str) -> DataFrame:
    """Each submission with the order id of the one before it for the same item."""
    w = Window.partitionBy(item).orderBy(time, tie)
    return sent.withColumn("amends", F.lag(order_id).over(w)).withColumn("revision", F.row_number().over(w))


def apply_line_edits(lines: Column, edits: Column, fields: list[str]) -> Column:
    """Array of line structs after a map of edits 'line_items.<i>.<field>' -> text; '' clears a field, 'line_items.<i>' -> 'delete' removes a line.

    A path one past the last line appends, and so may the next; a path further out has no effect.
    """
    keys = F.coalesce(F.map_keys(edits), F.array().cast("array<string>"))
    places = F.array_sort(F.array_distinct(F.transform(F.filter(keys, lambda k: k.rlike(r"^line_items\.\d+\.")), lambda k: F.split(k, r"\.")[1].try_cast("int"))))
    n = F.aggregate(places, F.size(lines), lambda n, i: F.when(i == n, n + 1).otherwise(n))

    def value(i: Column, f: str) -> Column:
        path = F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}"))
        return F.when(F.array_contains(keys, path), F.nullif(F.element_at(edits, path), F.lit(""))).otherwise(F.get(lines, i)[f].cast("string"))

    gone = lambda i: F.coalesce(F.try_element_at(edits, F.concat(F.lit("line_items."), i.cast("string"))) == "delete", F.lit(False))
    index = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~gone(i))
    return F.transform(index, lambda i: F.struct(*(value(i, f).alias(f) for f in fields)))


def usage(events: DataFrame, org: str, time: str, **sums: Column) -> DataFrame:
    """Per org and UTC month: number of events and the given sums."""
    return events.groupBy(F.col(org).alias("org_id"), F.date_format(time, "yyyy-MM").alias("period")).agg(F.count("*").alias("events"), *(F.sum(c).alias(n) for n, c in sums.items()))


def quota_status(used: DataFrame, orgs: DataFrame) -> DataFrame:
    """Usage with its org's quota; an org without one is allowed."""
    return used.join(orgs.select("org_id", "quota"), "org_id", "left").withColumn("allowed", F.coalesce(F.col("events") < F.col("quota"), F.lit(True)))


def rate_limited(events: DataFrame, identity: str, time: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Running count in each identity's fixed window, whether it is within the limit, and seconds until the window ends if not."""
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    epoch = F.floor(at / seconds)
    w = Window.partitionBy(identity, "window").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    x = events.withColumn("window", epoch).withColumn("used", F.count("*").over(w))
    return x.withColumn("allowed", F.col("used") <= limit).withColumn("retry_after", F.when(F.col("used") > limit, seconds - F.pmod(at, F.lit(seconds))))


def apportion(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``; equal remainders in name order. One row per class of a small domain."""
    all_ = weights.agg(F.sum(weight).alias("all"))
    x = weights.join(F.broadcast(all_)).withColumn("exact_num", F.col(weight) * total)
    x = x.withColumn("base", F.floor(F.col("exact_num") / F.col("all")).cast("long")).withColumn("rest", F.pmod(F.col("exact_num"), F.col("all")))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), name))
    return x.select(name, (F.col("base") + (rank <= left).cast("long")).alias("share"))


def split_of(key: Column, seed: int, shares: dict[str, int]) -> Column:
    """Split of a row by its hash; shares in per cent."""
    b, out, upto = bucket(100, F.lit(seed), key), None, 0
    for name, share in shares.items():
        upto += share
        out = F.when(b < upto, name) if out is None else out.when(b < upto, name)
    return out


def leaked(split: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``split`` whose key also occurs in ``other``."""
    return split.join(other.select(*on).distinct(), on, "left_semi")


def nested_prefixes(rows: DataFrame, key: str, seed: int, sizes: list[int]) -> DataFrame:
    """(key, size) for the first n rows of one seeded order, n in sizes: each set holds the smaller ones. A top-k per size, no full sort."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    top = rows.select(key, order.alias("o")).orderBy("o", key).limit(max(sizes))
    ranked = top.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o", key)))  # at most max(sizes) rows
    return ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("n <= size").select(key, "size")


def stratified_sample(rows: DataFrame, strata: dict[str, Column], minima: int, key: str, seed: int) -> DataFrame:
    """At least ``minima`` rows of every stratum (all if it has fewer): the least hashed ids of each."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in strata.items())))
    each = rows.select(key, F.explode(names).alias("stratum"), F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))).alias("o"))
    w = Window.partitionBy("stratum").orderBy("o", key)
    return each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= minima).select("stratum", key)


def sft_messages(system: str, subject: Column, body: Column, answer: Column) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)), message("assistant", answer))
