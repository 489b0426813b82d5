"""Catalogue and customer book: readers of their nested files, integrity problems as rows, and joins with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.columns import norm_text

PRODUCT = "struct<sku:string,name:string,category:string,aliases:array<string>,unit:string,pack_size:int,moq:int,max_qty:int,unit_price_cents:bigint,active:boolean>"
CATALOGUE = f"version int, company string, units map<string,array<string>>, products array<{PRODUCT}>"
CONTACT = "struct<name:string,email:string,role:string,phone:string>"
ADDRESS = "struct<label:string,line1:string,line2:string,suburb:string,state:string,postcode:string>"
CUSTOMER = f"customer_id:string,company:string,domains:array<string>,contacts:array<{CONTACT}>,delivery_addresses:array<{ADDRESS}>,po_template:string,style:struct<tone:string,signoff:string>"
BOOK = f"version int, customers array<struct<{CUSTOMER}>>"
# What codes and addresses look like.
SKU = r"^[A-Z]{3}-[A-Z0-9]{2,3}-\d{3}$"
CUSTOMER_ID = r"^CUST-\d{4}$"
DOMAIN = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$"
PHONE, POSTCODE, PO_TEMPLATE = r"^\+61\d{9}$", r"^\d{4}$", r"^[A-Z0-9/#-]+$"
STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "ACT", "NT")


def catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(products, units) of a catalogue file: one row a product, in order (place), and one a unit with its aliases; cached, as they are small dimensions."""
    book = spark.read.schema(CATALOGUE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    products = book.select(F.posexplode("products").alias("place", "p")).select("place", "p.*").cache()
    return products, book.select(F.explode("units").alias("unit", "aliases")).cache()


def customer_book(spark: SparkSession, path: str) -> DataFrame:
    """One row a customer of a book file, in order (place)."""
    book = spark.read.schema(BOOK).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return book.select(F.posexplode("customers").alias("place", "c")).select("place", "c.*").cache()


def _problems(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, problem) of each check that fails; a check that is null passes."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(~ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    return df.select(F.col(key).alias("key"), F.explode(failed).alias("problem"))


def _repeated(df: DataFrame, key: Column, problem: str) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(problem).alias("problem"))


def _unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def product_problems(products: DataFrame, units: DataFrame) -> DataFrame:
    """(key, problem): malformed and repeated codes, aliases that are not normalised or repeated, ranges, unknown units, terms of two products or units."""
    normal = lambda a: F.forall(a, lambda x: x == norm_text(x))
    own = _problems(products, "sku", {"sku": F.col("sku").rlike(SKU), "aliases": normal(F.col("aliases")), "alias repeated": _unique(F.col("aliases")), "range": F.col("max_qty") >= F.col("moq")})
    unknown = products.join(units, "unit", "left_anti").select(F.col("sku").alias("key"), F.lit("unit").alias("problem"))
    terms = products.select(F.explode(F.concat(F.array(norm_text(F.col("name"))), F.array_distinct(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("term"))
    unit_terms = units.select(F.explode(F.concat(F.array("unit"), "aliases")).alias("term"))
    aliases = _problems(units, "unit", {"unit aliases": normal(F.col("aliases"))})
    return own.union(unknown).union(aliases).union(_repeated(products, F.col("sku"), "sku repeated")).union(_repeated(terms, F.col("term"), "term repeated")).union(_repeated(unit_terms, F.col("term"), "unit term repeated"))


def customer_problems(customers: DataFrame, id_pattern: str | None = None) -> DataFrame:
    """(key, problem): malformed domains, addresses and templates, contacts outside of the domains, labels, what two customers share, and ids that
    do not match ``id_pattern``, which is CUSTOMER_ID for a book of the usual form; without a pattern ids are not judged."""
    c, a, d = F.col("contacts"), F.col("delivery_addresses"), F.col("domains")
    every = lambda xs, ok: F.forall(xs, ok)
    checks = {
        "domain": every(d, lambda x: x.rlike(DOMAIN)), "domain repeated": _unique(d), "email": every(c, lambda x: x["email"].rlike(EMAIL)), "phone": every(c, lambda x: x["phone"].rlike(PHONE)),
        "state": every(a, lambda x: x["state"].isin(*STATES)), "postcode": every(a, lambda x: x["postcode"].rlike(POSTCODE)), "template": F.col("po_template").rlike(PO_TEMPLATE) & F.col("po_template").contains("#"),
        "contact": every(c, lambda x: F.array_contains(d, F.substring_index(x["email"], "@", -1))), "label repeated": _unique(F.transform(a, lambda x: x["label"])), "nobody": (F.size(c) > 0) & (F.size(a) > 0) & (F.size(d) > 0),
    }
    if id_pattern is not None:
        checks = {"id": F.col("customer_id").rlike(id_pattern), **checks}
    emails = customers.select(F.explode(c).alias("x")).select("x.email")
    shared = _repeated(customers.select(F.explode(F.array_distinct(d)).alias("x")), F.col("x"), "shared domain").union(_repeated(emails, F.col("email"), "shared email"))
    return _problems(customers, "customer_id", checks).union(_repeated(customers, F.col("customer_id"), "id repeated")).union(shared)


def sender_role(messages: DataFrame, sender: str, customers: DataFrame) -> DataFrame:
    """Messages with the customer of the sender's domain and the role of the contact who has just that address; null where there is none."""
    owners = customers.select(F.explode("domains").alias("sender_domain"), F.col("customer_id").alias("sender_customer"))
    roles = customers.select(F.col("customer_id").alias("sender_customer"), F.explode("contacts").alias("x")).select("sender_customer", F.col("x.email").alias("sender_email"), F.col("x.role").alias("role"))
    x = messages.withColumn("sender_domain", F.substring_index(F.lower(F.trim(sender)), "@", -1)).join(owners, "sender_domain", "left")
    return x.withColumn("sender_email", F.col(sender)).join(roles, ["sender_customer", "sender_email"], "left").drop("sender_email", "sender_domain")


def active_products(products: DataFrame, categories: list[str] = ()) -> DataFrame:
    """Products on sale, of other categories than the given ones."""
    other = ~F.coalesce(F.col("category").isin(*categories), F.lit(False)) if categories else F.lit(True)
    return products.where(F.coalesce("active", F.lit(True)) & other)
