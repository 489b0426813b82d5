"""The review of extracted orders: what each decision does, and what is sent of the orders that come out.

A log has item, at, seq (breaks ties), action ("submitted", "approved", "edited", "rejected"), extraction (ORDER, of a submission; null for
one that was routed away) and edits (map path -> text). An approval claims that the order is complete: one whose item, as edited so far, misses required
fields is refused and changes nothing. All is windows over an item's decisions, which spill, whatever their number; no list of them is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.functions.columns import norm_text
from docket.operators.evaluation import ORDER, ORDER_FIELDS
from docket.operators.flow import apply_edits, missing_after
from docket.operators.orders import build_orders
from docket.sources.store import written

EDITS = "map<string,string>"
NONE = "[]"  # the version without edits
RESUMED = "was:"
LOG = f"item bigint, at timestamp, seq bigint, action string, extraction {ORDER}, edits {EDITS}"
OUTCOME = f"item bigint, at timestamp, seq bigint, refused boolean, accepted boolean, status string, version string, made {ORDER}"
STATE = "item bigint, status string, version string, decisions bigint, refused bigint, sent bigint, held bigint, submitted boolean, order_id string, amends string, for_edits string"


def version_of(edits: Column) -> Column:
    """Edits as a text that does not depend on the order of their entries."""
    return F.to_json(F.coalesce(F.array_sort(F.map_entries(edits)), F.array().cast("array<struct<key:string,value:string>>")))


def given_edits() -> Column:
    """The edits of a row of a log; a submission has none, whatever stands there."""
    return F.coalesce(F.when(F.col("action") != "submitted", F.col("edits")), F.create_map().cast(EDITS))


def orders_of(log: DataFrame) -> DataFrame:
    """(item, version, made, bad) of every order that a submitted item may come to: its submission under each of its decisions' edits and under none,
    and whether that misses required fields. An order is made once, however many decisions have its edits."""
    first = log.where("action = 'submitted'").groupBy("item").agg(F.min_by(F.struct("extraction"), F.struct("at", "seq")).alias("origin"))
    edits = log.select("item", given_edits().alias("edits")).withColumn("version", version_of(F.col("edits")))
    edits = edits.groupBy("item", "version").agg(F.any_value("edits").alias("edits"))
    made = written(edits.join(first.hint("merge"), "item").select("item", "version", apply_edits(F.col("origin.extraction"), F.col("edits")).alias("made")), "orders")
    return made.withColumn("bad", F.size(missing_after(F.col("made"), ORDER_FIELDS)) > 0)


def decided(log: DataFrame, orders: DataFrame) -> DataFrame:
    """outcomes() without the orders made; ``orders`` is orders_of() the log. Rows with ``turn`` 0, if the log has that column, tell where items stood before
    it: submissions, and one row with the status as action after RESUMED. They come first and have no outcome."""
    if "turn" not in log.columns:
        log = log.withColumn("turn", F.lit(1))
    item = Window.partitionBy("item").orderBy("turn", "at", "seq")
    so_far = item.rowsBetween(Window.unboundedPreceding, 0)
    x = log.select("item", "turn", "at", "seq", "action", version_of(given_edits()).alias("given"))
    x = x.join(orders.select("item", F.col("version").alias("given"), "bad").hint("merge"), ["item", "given"])  # an item that was never submitted has no orders
    x = x.withColumn("bad_first", F.max(F.when(F.col("action") == "submitted", F.col("bad"))).over(so_far)).where("bad_first is not null and action <> 'submitted'")
    x = x.withColumn("some", F.col("given") != NONE).withColumn("fixed", F.col("action") != "approved")
    x = x.withColumn("bad", F.when(F.col("fixed") | F.col("some"), F.col("bad"))).withColumn("part", F.sum(F.col("fixed").cast("long")).over(so_far))
    before = Window.partitionBy("item", "part").orderBy("turn", "at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    at_first = (F.col("part") == 0) & F.col("bad_first")  # no decision has set edits yet
    x = x.withColumn("refused", ~F.col("fixed") & (F.coalesce(F.max("bad").over(before), F.lit(False)) | at_first))
    sets = F.when(F.col("fixed") | (F.col("some") & ~F.col("refused")), F.col("given"))
    turn = F.when(F.col("fixed"), F.when((F.col("action") == "edited") & ~F.col("some"), "approved").otherwise(F.regexp_replace("action", f"^{RESUMED}", ""))).when(~F.col("refused"), "approved")
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    x = x.withColumn("version", F.coalesce(last(sets), F.lit(NONE))).withColumn("status", F.coalesce(last(turn), F.lit("pending")))
    return x.where("turn > 0").select("item", "at", "seq", "refused", (~F.col("fixed") & ~F.col("refused")).alias("accepted"), "status", "version")


def edits_of(version: Column) -> Column:
    """The edits that version_of() tells."""
    return F.map_from_entries(F.from_json(version, "array<struct<key:string,value:string>>"))


def resumed(before: DataFrame, submitted: DataFrame, decisions: DataFrame, batch: int) -> DataFrame:
    """A log for decided() of one batch of decisions (LOG) on items that stand as ``before`` (STATE) tells. ``submitted`` has item, batch, at, seq and
    extraction of each first submission; one of an earlier batch comes before all decisions of this one."""
    old = F.col("batch") < batch
    touched = decisions.select("item").distinct().hint("merge")
    none = F.lit(None).cast(EDITS).alias("edits")
    first = submitted.join(touched, "item", "left_semi").select("item", F.when(old, 0).otherwise(1).alias("turn"), F.when(~old, F.col("at")).alias("at"), F.when(~old, F.col("seq")).otherwise(0).alias("seq"), F.lit("submitted").alias("action"), "extraction", none)
    stood = before.join(touched, "item", "left_semi").select("item", F.lit(0), F.lit(None).cast("timestamp"), F.lit(1).cast("bigint"), F.concat(F.lit(RESUMED), "status"), F.lit(None).cast(ORDER), edits_of(F.col("version")))
    return first.union(stood).union(decisions.select("item", F.lit(1), "at", "seq", "action", F.lit(None).cast(ORDER), "edits"))


def outcomes(log: DataFrame) -> DataFrame:
    """What each decision does (OUTCOME): whether it is refused or accepted (an approval that stands), and the item's status, edits
    (as version) and, of an accepted one, order after it. Decisions before an item's submission are left out, like those of an unknown item.

    Edits are set by every decision but an approval without any, which keeps them. Whether an approval stands depends on the order as it is then. Since only approvals
    are refused, and a refused one changes nothing, that is decided between one edit or rejection and the next: the first order that
    misses a field refuses all approvals after it.
    """
    orders = orders_of(log)
    made = F.when(F.col("accepted"), F.col("made")).alias("made")
    return decided(log, orders).join(orders.drop("bad").hint("merge"), ["item", "version"]).select("item", "at", "seq", "refused", "accepted", "status", "version", made)


def fitting(versions: DataFrame, terms: DataFrame, products: DataFrame) -> DataFrame:
    """(item, version, fits) of orders (item, version, made): whether every line resolves to a product and keeps to its quantities.

    ``terms`` has term (normalised) and sku, ``products`` sku, moq, most and price_cents.
    """
    lines = versions.select(F.struct("item", "version").alias("v"), F.explode_outer("made.line_items").alias("l")).select("v", norm_text(F.col("l.product_text")).alias("term"), F.col("l.quantity").alias("quantity"))
    priced = lines.join(terms.join(products, "sku").select("term", "sku", "moq", "most", "price_cents"), "term", "left")
    return build_orders(priced, "v").select("v.item", "v.version", (~F.col("blocked")).alias("fits"))


def receipt(item: Column, version: Column) -> Column:
    """The order id of a version of an item: told by what is sent, so that a sending that is repeated has the same."""
    return F.concat(F.lit("ORD-"), F.upper(F.substring(F.sha2(F.concat_ws("|", item.cast("string"), version), 256), 1, 8)))


def settled(before: DataFrame, told: DataFrame, terms: DataFrame, products: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """States (STATE) of all items of ``before`` (STATE, one row an item) and ``told`` (OUTCOME) after these outcomes.

    An accepted approval is sent unless what was sent last has the same edits. One that does not fit is held: it does not erase the receipt of what
    was sent before. What is sent after that amends it. for_edits tells what the record of sending covers. Orders made are taken from ``orders`` (item, version, made) where that is given, and ``told`` needs none.
    """
    tried = told.where("accepted")
    if orders is None:
        versions = tried.groupBy("item", "version").agg(F.any_value("made").alias("made"))
    else:
        versions = orders.join(tried.select("item", "version").hint("merge"), ["item", "version"], "left_semi").select("item", "version", "made")
    tried = tried.join(fitting(versions, terms, products), ["item", "version"]).select("item", F.lit(1).alias("turn"), "at", "seq", "version", "fits", receipt(F.col("item"), F.col("version")).alias("order_id"), F.lit(None).cast("string").alias("amends"))
    prior = before.where("submitted").select("item", F.lit(0), F.lit(None).cast("timestamp"), F.lit(None).cast("bigint"), "for_edits", F.lit(True), "order_id", "amends")
    order = Window.partitionBy("item").orderBy("turn", "at", "seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    x = tried.union(prior).withColumn("open", ~F.coalesce(F.last(F.when(F.col("fits"), F.col("version")), ignorenulls=True).over(earlier) == F.col("version"), F.lit(False)))
    x = x.withColumn("goes", F.col("fits") & F.col("open"))
    x = x.withColumn("amends", F.when(F.col("turn") == 0, F.col("amends")).otherwise(F.last(F.when(F.col("goes"), F.col("order_id")), ignorenulls=True).over(earlier)))
    place = F.struct("turn", "at", "seq")
    sent = x.groupBy("item").agg(
        F.count_if(F.col("goes") & (F.col("turn") == 1)).alias("sent"), F.count_if(~F.col("fits") & F.col("open")).alias("held"),
        F.max_by(F.when(F.col("goes"), F.struct("order_id", "amends", F.col("version").alias("for_edits"))), F.when(F.col("goes"), place)).alias("last"), F.max_by("version", place).alias("tried"),
    )
    place = F.struct("at", "seq")
    turns = told.groupBy("item").agg(F.max_by("status", place).alias("status"), F.max_by("version", place).alias("version"), F.count("*").alias("decisions"), F.count_if("refused").alias("refused"))
    now = turns.join(sent, "item", "left")
    both = before.alias("b").join(now.alias("n"), "item", "full")
    either = lambda c, other=None: F.coalesce(f"n.{c}", f"b.{c}", F.lit(other)).alias(c)
    total = lambda c: (F.coalesce(f"b.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).cast("bigint").alias(c)
    recorded = lambda c: F.coalesce(f"n.last.{c}", f"b.{c}").alias(c) if c == "order_id" else F.when(F.col("n.last").isNotNull(), F.col(f"n.last.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    for_edits = F.coalesce("n.last.for_edits", F.when(F.coalesce("b.submitted", F.lit(False)), F.col("b.for_edits")).otherwise(F.coalesce("n.tried", "b.for_edits")))
    return both.select(
        "item", either("status", "pending"), either("version", NONE), total("decisions"), total("refused"), total("sent"), total("held"),
        (F.coalesce("b.submitted", F.lit(False)) | F.col("n.last").isNotNull()).alias("submitted"), recorded("order_id"), recorded("amends"), for_edits.alias("for_edits"),
    )


def review(log: DataFrame, terms: DataFrame, products: DataFrame) -> DataFrame:
    """Where every submitted item stands (STATE) after the whole log."""
    spark = log.sparkSession
    orders = orders_of(log)
    states = settled(spark.createDataFrame([], STATE), written(decided(log, orders), "decided"), terms, products, orders)
    items = log.where("action = 'submitted'").select("item").distinct()
    quiet = items.join(states, "item", "left_anti").select("item", F.lit("pending"), F.lit(NONE), *(F.lit(0).cast("bigint"),) * 4, F.lit(False), *(F.lit(None).cast("string"),) * 3)
    return states.union(quiet)
