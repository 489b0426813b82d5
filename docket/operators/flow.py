"""Review and fulfilment: edits on whole orders, the approve flow as a fold over decisions, queue views and small projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.operators.evaluation import LINE, ORDER, ORDER_FIELDS, empty_order
from docket.operators.orders import ROUTES, in_band, priority, route_of

# The mark of a deleted line, the fields of a line, ids that were there from the start.
DELETED = "__deleted__"
LINE_FIELDS = ("product_text", "quantity", "unit_text", "unit_price_text", "item_notes")
SEED_ID = r"^EXC-\d{4}$"


def apply_edits(extraction: Column, edits: Column) -> Column:
    """An order (ORDER) after a map of edits path -> text; a null order starts empty.

    Header paths are field names, line paths 'line_items.<place>.<field>' with places of the original list; one past the end appends,
    and so may the next; further out has no effect. A quantity that is a whole number becomes one, any other is null. The value DELETED
    of a path 'line_items.<place>' takes the line away after all other edits; a place that no line has is ignored.
    """
    given = F.struct(F.coalesce(extraction, empty_order()).alias("base"), F.coalesce(edits, F.create_map().cast("map<string,string>")).alias("edits"))
    return once(given, lambda x: _edited(x["base"], x["edits"]))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row: Spark works an expression out again wherever the function of a transform or filter names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _edited(base: Column, edits: Column) -> Column:
    """apply_edits() of an order and a map that are not null and stand in columns or are bound by once()."""
    at = lambda k: F.split(k, r"\.")[1].try_cast("int")
    path = lambda i, f="": F.concat(F.lit("line_items."), i.cast("string"), F.lit(f))
    head = [F.when(F.map_contains_key(edits, F.lit(f)), F.try_element_at(edits, F.lit(f))).otherwise(base[f]).alias(f) for f in (*ORDER_FIELDS, "notes")]
    bound = lambda own: F.struct(
        F.coalesce(base["line_items"], F.array().cast(f"array<{LINE}>")).alias("lines"), own.alias("edits"), F.array_compact(F.transform(F.map_keys(own), at)).alias("touched"),
        F.array_sort(F.array_distinct(F.transform(F.map_keys(F.map_filter(own, lambda k, v: v != DELETED)), at))).alias("set"), F.map_keys(F.map_filter(edits, lambda k, v: v == DELETED)).alias("gone"),
    )

    def value(x: Column, i: Column, f: str) -> Column:
        text = F.try_element_at(x["edits"], path(i, f".{f}"))
        new = F.when(text.rlike(r"^\s*-*\d+\s*$"), F.trim(text).try_cast("bigint")) if f == "quantity" else text
        return F.when(F.map_contains_key(x["edits"], path(i, f".{f}")), new).otherwise(F.get(x["lines"], i)[f]).alias(f)

    def lines(x: Column) -> Column:
        n = F.aggregate(x["set"], F.size(x["lines"]), lambda n, i: F.when(i == n, n + 1).otherwise(n))
        kept = once(n, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
        kept = F.when(F.size(x["gone"]) > 0, F.filter(kept, lambda i: ~F.array_contains(x["gone"], path(i)))).otherwise(kept)
        whole = lambda i: F.struct(*(value(x, i, f) for f in LINE_FIELDS)).cast(LINE)
        edited = F.transform(kept, lambda i: F.when(F.get(x["lines"], i).isNull() | F.array_contains(x["touched"], i), whole(i)).otherwise(F.get(x["lines"], i)))
        still = (F.size(x["touched"]) == 0) & (F.size(x["gone"]) == 0) & ~F.exists(x["lines"], lambda i: i.isNull())
        return F.when(still, x["lines"]).otherwise(edited)

    of_lines = F.map_filter(edits, lambda k, v: k.rlike(r"^line_items\.\d+\."))
    return F.struct(*head, once(of_lines, lambda own: once(bound(own), lines)).alias("line_items")).cast(ORDER)


def missing_after(order: Column, required: tuple = ("customer_po_text", "delivery_address_text"), line_required: tuple = ("product_text", "quantity")) -> Column:
    """Required fields of an edited order that are null or empty; an order without lines misses "line_items". An approval asks for all ORDER_FIELDS, see reviewing.py."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    head = F.array(*(F.when(blank(order[f]), F.lit(f)) for f in required), F.when(F.size(order["line_items"]) < 1, F.lit("line_items")))
    per = F.flatten(F.transform(order["line_items"], lambda x, i: F.array(*(F.when(blank(x[f]), F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}"))) for f in line_required))))
    return F.array_compact(F.concat(head, per))


def same_edits(a: Column, b: Column) -> Column:
    """Whether two maps of edits are equal whatever the order of their entries; null is empty."""
    entries = lambda m: F.coalesce(F.array_sort(F.map_entries(m)), F.array().cast("array<struct<key:string,value:string>>"))
    return entries(a) == entries(b)


def edit_draft(original: Column, edits: Column) -> Column:
    """The edits that change something: entries whose value is not the original's."""
    return F.map_filter(edits, lambda k, v: ~v.eqNullSafe(F.try_element_at(original, k)))


def approve_flow(log: DataFrame, item: str, time: str, tie: str) -> DataFrame:
    """Where each item stands after its decisions (action, edits, missing, fits, receipt) in order.

    An approval that misses required fields is refused and changes nothing. An approval without edits keeps those before; every other
    decision sets them; an edit without edits is an approval. An approval is sent unless the same edits were sent already. A sending that
    does not fit is held; it does not erase the receipt of an order that was sent before. What is sent after that amends it.
    """
    state = "struct<status:string,edits:string,submitted:boolean,order_id:string,amends:string,for_edits:string,refused:bigint,sent:bigint>"
    begin = F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("edits"), F.lit(False).alias("submitted"), *(F.lit(None).cast("string").alias(n) for n in ("order_id", "amends", "for_edits")), F.lit(0).cast("bigint").alias("refused"), F.lit(0).cast("bigint").alias("sent")).cast(state)

    def step(s: Column, d: Column) -> Column:
        approved, none = d["action"] == "approved", F.coalesce(d["edits"], F.lit("")) == ""
        edits = F.when(approved & none, s["edits"]).otherwise(F.nullif(d["edits"], F.lit("")))
        status = F.when((d["action"] == "edited") & none, "approved").otherwise(d["action"])
        send = approved & ~(s["submitted"] & s["for_edits"].eqNullSafe(edits))
        out = lambda new, old: F.when(send & d["fits"], new).when(send & ~s["submitted"], F.lit(None).cast("string")).otherwise(old)
        now = F.struct(
            status.alias("status"), edits.alias("edits"), (s["submitted"] | (send & d["fits"])).alias("submitted"), out(d["receipt"], s["order_id"]).alias("order_id"),
            out(F.when(s["submitted"], s["order_id"]), s["amends"]).alias("amends"), F.when(send & (d["fits"] | ~s["submitted"]), edits).otherwise(s["for_edits"]).alias("for_edits"),
            s["refused"].alias("refused"), (s["sent"] + (send & d["fits"]).cast("bigint")).alias("sent"),
        )
        refused = s.withField("refused", s["refused"] + 1)
        return F.when(approved & d["missing"], refused.cast(state)).otherwise(now.cast(state))

    decisions = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), "action", "edits", "missing", "fits", "receipt")))
    return log.groupBy(item).agg(F.aggregate(decisions, begin, step).alias("s")).select(item, "s.*")


def fulfilments(built: DataFrame, order: str) -> DataFrame:
    """What becomes of each built order: submitted with a receipt of its content, or held for mapping."""
    ok = ~F.col("blocked") & (F.col("n_lines") > 0)
    receipt = F.concat(F.lit("ORD-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col(order).cast("string"), "n_lines", "total_cents"), 256), 1, 8)))
    return built.select(order, ok.alias("submitted"), F.when(ok, receipt).alias("order_id"), F.when(ok, "submitted").otherwise("held_for_mapping").alias("reason"))


def erp_lines(lines: DataFrame) -> DataFrame:
    """Lines of an order as the ERP takes them: the catalogue's price, not the stated one; unresolved lines and those without quantity stay out."""
    x = lines.where("sku is not null and quantity is not null")
    return x.withColumn("line_cents", F.col("quantity") * F.col("price_cents"))


def branches(messages: DataFrame, label: str) -> DataFrame:
    """Each message with its route and the steps that it takes; an unknown label stops after classification."""
    route = route_of(F.col(label))
    steps = {"extract": ["classify", "extract", "finalize"], "cancel": ["classify", "cancel", "finalize"], "inquiry": ["classify", "finalize"], "discard": ["classify", "finalize"]}
    assert set(steps) == set(ROUTES.values())
    path = F.array(F.lit("classify"))
    for name, s in steps.items():
        path = F.when(route == name, F.array(*map(F.lit, s))).otherwise(path)
    return messages.withColumn("route", route).withColumn("steps", path)


def review_items(states: DataFrame, low: float = 0.80, high: float = 0.95) -> DataFrame:
    """Review items of pipeline states (confidence map, asks, violations): flags of fields within the band, priority, pending."""
    band = F.map_filter("confidence", lambda k, v: in_band(v, low, high))
    x = states.withColumn("band_fields", F.array_sort(F.map_keys(band)))
    return x.withColumn("priority", priority(F.size("violations"), F.size("asks"), F.size("band_fields"))).withColumn("status", F.lit("pending"))


def queue_summary(items: DataFrame) -> DataFrame:
    """Items in all, with asks, with fields in the band, with violations."""
    return items.agg(F.count("*").alias("items"), *(F.count_if(F.size(c) > 0).alias(f"with_{c}") for c in ("asks", "band_fields", "violations")))


def current_items(events: DataFrame, item: str, time: str) -> DataFrame:
    """The queue after its events (added, deleted, fulfilled): items added and not deleted since, with the latest outcome."""
    last = lambda kind, value: F.max_by(value, F.when(F.col("kind") == kind, F.col(time)))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col(time)))
    x = events.groupBy(item).agg(at("added").alias("added"), at("deleted").alias("deleted"), last("fulfilled", F.col("value")).alias("outcome"))
    return x.where("added is not null and (deleted is null or deleted < added)").select(item, "added", "outcome")


def deletable(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``items`` without the wanted ones; ids of SEED_ID cannot be deleted."""
    return items.join(wanted.where(~F.col(key).rlike(SEED_ID)).select(key).distinct(), key, "left_anti")


def point(items: DataFrame, key: str, wanted: object, org: object) -> DataFrame:
    """The item of an id if it is the org's own; one of another org is like none."""
    return items.where((F.col(key) == wanted) & (F.col("org_id") == org))


def migrated(items: DataFrame, default_org: str = "org-demo") -> DataFrame:
    """Queue records of any age: a missing org is the default's, a fulfilment without for_edits covers the edits as they are."""
    f = F.col("fulfillment")
    stamped = f.withField("for_edits", F.coalesce(f["for_edits"], F.col("edits"), F.create_map().cast("map<string,string>")))
    return items.withColumn("org_id", F.coalesce("org_id", F.lit(default_org))).withColumn("fulfillment", F.when(f.isNotNull(), stamped))


def shown(items: DataFrame) -> DataFrame:
    """What a reader of the queue gets: no org_id, the fulfilment as one struct."""
    out = F.when(F.col("order_id").isNotNull() | F.col("reason").isNotNull(), F.struct("order_id", "reason", "amends"))
    return items.select(*(c for c in items.columns if c not in ("org_id", "order_id", "reason", "amends")), out.alias("fulfillment"))


def subtype(*kinds: Column) -> Column:
    return F.coalesce(*kinds, F.lit(""))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of tokens at prices per million; null without a price."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def identity(subject: Column, address: Column) -> Column:
    """Who is limited: the token's subject, else the address, else all others together."""
    return F.coalesce(subject, address, F.lit("anonymous"))


def item_line(quantity: Column, unit: Column, product: Column, style: Column, typo: Column, packs: Column, price: Column) -> Column:
    """A line of evidence: quantity, unit and product with what is special about it."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    extras = F.array_compact(F.array(F.concat(F.lit("style="), style), F.when(typo, F.lit("typo")), F.concat(F.lit("trap(packs="), packs.cast("string"), F.lit(")")), F.when(price != "", F.concat(F.lit("price="), price))))
    return F.concat(dash(quantity), F.lit(" "), dash(unit), F.lit(" × "), product, F.lit(" ("), F.array_join(extras, ", "), F.lit(")"))


def active_flags(flags: Column) -> Column:
    """Names of the flags that are set, in order."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda k, v: v)))
