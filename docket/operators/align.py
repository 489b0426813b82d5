"""Line items: best assignment of predicted to gold items, and fuzzy matching of names."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docket.functions.columns import norm_text

EXHAUSTIVE = 8
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # what columns.norm_equal takes for white space
COUNTS = ("correct", "strict_correct", "wrong", "hallucination", "miss", "null_agree")


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (i, j) of the greatest total weight; up to eight items a side by dynamic programming over sets, beyond
    that greedily by (-weight, i, j). Of equal totals the one whose choices for i = 0, 1, ... come first; pairs of weight 0 go."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if not n or not m:
        return []
    if n > EXHAUSTIVE or m > EXHAUSTIVE:
        used_i, used_j, out = set(), set(), []
        for w, i, j in sorted((-w, i, j) for i, row in enumerate(weights) for j, w in enumerate(row) if w > 0):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                out.append((i, j))
        return sorted(out)
    if n > m:
        return sorted((i, j) for j, i in assign([list(c) for c in zip(*weights)]))
    best: dict[tuple[int, int], float] = {}

    def value(i: int, free: int) -> float:
        if i == n:
            return 0.0
        key = (i, free)
        if key not in best:
            best[key] = max(weights[i][j] + value(i + 1, free & ~(1 << j)) for j in range(m) if free >> j & 1)
        return best[key]

    free, out = (1 << m) - 1, []
    for i in range(n):
        j = next(j for j in range(m) if free >> j & 1 and abs(weights[i][j] + value(i + 1, free & ~(1 << j)) - value(i, free)) < 1e-9)
        free &= ~(1 << j)
        if weights[i][j] > 0:
            out.append((i, j))
    return out


def brute_assign(weights: list[list[float]]) -> float:
    """Greatest total weight by trying all orders (for tests)."""
    n, m = len(weights), len(weights[0])
    if n > m:
        return brute_assign([list(c) for c in zip(*weights)])
    return max(sum(weights[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def assign_all(weights: np.ndarray) -> np.ndarray:
    """assign() of many records of one shape (records, n, m), n <= m <= EXHAUSTIVE: the column of each row, -1 where its weight is 0.

    One table over sets of free columns serves all records: values[i][r, free] is the best total of rows i and on.
    """
    records, n, m = weights.shape
    sets, at = np.arange(1 << m), np.arange(records)
    values = [np.zeros((records, 1 << m))] * (n + 1)
    for i in reversed(range(n)):
        values[i] = np.full((records, 1 << m), -np.inf)
        for j in range(m):
            with_j = sets[sets >> j & 1 == 1]
            values[i][:, with_j] = np.maximum(values[i][:, with_j], weights[:, i, j, None] + values[i + 1][:, with_j ^ 1 << j])
    free, out = np.full(records, (1 << m) - 1), np.full((records, n), -1)
    for i in range(n):
        for j in range(m):
            rest = free & ~(1 << j)
            first = (out[:, i] < 0) & (free >> j & 1 == 1) & (np.abs(weights[:, i, j] + values[i + 1][at, rest] - values[i][at, free]) < 1e-9)
            out[first, i] = j
        free = free & ~(1 << out[:, i])
    out[np.take_along_axis(weights, out[:, :, None], 2)[:, :, 0] == 0] = -1
    return out


def comparable(texts: pa.Array) -> pa.Array:
    """columns.norm_equal() of whole columns: Arrow does plain ASCII, Python the others."""
    if not pa.types.is_string(texts.type):
        return texts
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, "[\t-\r]|  ")))
    out = pc.ascii_trim(pc.ascii_lower(texts), " ")
    if not pc.all(plain, min_count=0).as_py():
        rest = pc.filter(texts, pc.invert(plain))
        out = pc.replace_with_mask(out, pc.fill_null(pc.invert(plain), False), pa.array([WHITE.sub(" ", x.casefold()).strip(" ") for x in rest.to_pylist()], texts.type))
    return out


def _codes(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the items' values, the same for equal values, -1 for none."""
    numbers = pa.concat_arrays(parts).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return numbers[: len(parts[0])], numbers[len(parts[0]) :]


def _assigned(sizes: list[np.ndarray], codes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, i, j) of the pairs, in order. ``sizes``: numbers of items a record; ``codes``: of product, quantity, unit and price, items of all records in a row.

    Records of the same numbers of items are assigned together; those of over EXHAUSTIVE items one by one, greedily.
    """
    starts = [np.cumsum(n) - n for n in sizes]

    def weights(records: np.ndarray, n: int, m: int) -> np.ndarray:
        g, p = starts[0][records, None] + np.arange(n), starts[1][records, None] + np.arange(m)
        equal = lambda c: c[0][g][:, :, None] == c[1][p][:, None, :]
        return 3.0 * equal(codes[0]) + sum(equal(c) & (c[0][g] >= 0)[:, :, None] for c in codes[1:])

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # record, i, j
    for n, m in np.unique(np.stack(sizes, 1), axis=0):
        own = np.flatnonzero((sizes[0] == n) & (sizes[1] == m))
        for records in np.array_split(own, len(own) // 2000 + 1) if n and m else ():
            w = weights(records, n, m)
            if max(n, m) > EXHAUSTIVE:
                for r, one in zip(records, w):
                    pairs = np.array(assign(one.tolist()), np.int64).reshape(-1, 2)
                    found.append((np.full(len(pairs), r), pairs[:, 0], pairs[:, 1]))
            else:
                choice = assign_all(w if n <= m else w.transpose(0, 2, 1))
                r, a = np.nonzero(choice >= 0)
                b = choice[r, a]
                found.append((records[r], *((a, b) if n <= m else (b, a))))
    record, i, j = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((i, record))
    return record[order], i[order], j[order]


def _pairs(records: int, record: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(record, minlength=records))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["i", "j"]))


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


PAIRS = ArrayType(StructType([StructField("i", IntegerType()), StructField("j", IntegerType())]))
SLOTS = ArrayType(StructType([StructField("field", StringType()), *(StructField(c, LongType()) for c in COUNTS)]))


@arrow_udf(PAIRS)
def aligned(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Assignment of two arrays of (product, quantity, unit, price): product counts 3, the others 1 each. Whole batches at a time."""
    items = [a.flatten() for a in (gold, pred)]
    codes = [_codes([pc.struct_field(x, f) for x in items]) for f in ("product", "quantity", "unit", "price")]
    return _pairs(len(gold), *_assigned([_sizes(gold), _sizes(pred)], codes))


def _read(gold: pa.Array, pred: pa.Array) -> tuple:
    """Sizes of the lists, per field its values on both sides and their codes by comparable(), and the assignment."""
    items, sizes = [a.flatten() for a in (gold, pred)], [_sizes(gold), _sizes(pred)]
    raw = {f.name: [pc.struct_field(x, f.name) for x in items] for f in list(gold.type.value_type)[:4]}
    codes = [_codes([comparable(x) for x in parts]) for parts in raw.values()]
    return sizes, raw, codes, _assigned(sizes, codes)


@arrow_udf(PAIRS)
def paired(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """aligned() of line items whose first four fields are product, quantity, unit and price, by their comparable() values."""
    return _pairs(len(gold), *_read(gold, pred)[-1])


@arrow_udf(StructType([StructField("pairs", PAIRS), StructField("fields", SLOTS)]))
def compared(gold: pa.Array, pred: pa.Array, gold_head: pa.Array, pred_head: pa.Array) -> pa.Array:
    """paired() line items, and COUNTS of each field of the heads (structs of texts) and of the lines.

    Slots of an unpaired gold item are misses, of an unpaired predicted one hallucinations.
    """
    sizes, raw, codes, (record, i, j) = _read(gold, pred)
    n, heads = len(gold), [f.name for f in gold_head.type]
    g, p = ((np.cumsum(s) - s)[record] + at for s, at in zip(sizes, (i, j)))
    owners = [np.repeat(np.arange(n), s) for s in sizes]
    over = lambda test: np.bincount(record[test], minlength=n)
    tally = np.zeros((n, len(heads) + len(raw), len(COUNTS)), np.int64)
    for k, f in enumerate(heads):
        parts = [pc.struct_field(x, f) for x in (gold_head, pred_head)]
        (a, b), (x, y) = _codes([comparable(c) for c in parts]), _codes(parts)
        two = (a >= 0) & (b >= 0)
        tally[:, k] = np.stack([two & (a == b), two & (x == y), two & (a != b), (a < 0) & (b >= 0), (a >= 0) & (b < 0), (a < 0) & (b < 0)], 1)
    for k, (own, parts) in enumerate(zip(codes, raw.values()), len(heads)):
        strict = _codes(parts)
        has_g, has_p = own[0][g] >= 0, own[1][p] >= 0
        two, right = over(has_g & has_p), over(has_g & (own[0][g] == own[1][p]))
        held = [np.bincount(o[c >= 0], minlength=n) for o, c in zip(owners, own)]
        tally[:, k] = np.stack([right, over(has_g & (strict[0][g] == strict[1][p])), two - right, held[1] - two, held[0] - two, over(~has_g & ~has_p)], 1)
    names = [*heads, *raw]
    slots = pa.StructArray.from_arrays([pa.array(names * n, pa.string()), *(pa.array(c) for c in tally.reshape(-1, len(COUNTS)).T)], names=["field", *COUNTS])
    fields = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), slots)
    return pa.StructArray.from_arrays([_pairs(n, record, i, j), fields], names=["pairs", "fields"])


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b), 100 for two empty texts; LCS by bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & mask
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_sort(c: Column) -> Column:
    """Normalised text with its words in order."""
    return F.array_join(F.array_sort(F.split(norm_text(c), " ")), " ")


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


def _numbered_grams(c: Column) -> Column:
    """Pairs of neighbouring characters, the ends marked, each with its number among equal ones."""
    padded = F.concat(F.lit("\x02"), c, F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def close_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(a, b): pairs of the texts left.a and right.b among which are all whose ratio is ``floor`` or more.

    Of texts of lengths x and y with an LCS of s / 2 * (x + y), s = floor / 100, at least (1.5 * s - 1) * (x + y) + 1 pairs of neighbours are
    common. So the rarest pairs of each side, but as many as that less one, must share one: an equi-join on rare keys. For floors
    under 70, where that says nothing, texts meet by their lengths.
    """
    s = floor / 100
    f = s / (2 - s)
    a, b = left.select("a").distinct(), right.select("b").distinct()
    close = (F.length("b") >= F.ceil(F.length("a") * f - 1e-9)) & (F.length("b") <= F.floor(F.length("a") / f + 1e-9))
    if floor < 70:
        sized = a.withColumn("size", F.explode(F.sequence(F.ceil(F.length("a") * f - 1e-9).cast("int"), F.floor(F.length("a") / f + 1e-9).cast("int"))))
        return sized.join(b.withColumn("size", F.length("b")).hint("merge"), "size").select("a", "b")
    common = (1.5 * s - 1) * (1 + f)
    both = a.select(F.lit("a").alias("side"), F.col("a").alias("text")).union(b.select(F.lit("b"), "b")).withColumn("g", F.explode(_numbered_grams(F.col("text"))))
    rarity = both.groupBy("g").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("side", "text").orderBy("n", "g"))
    some = both.join(rarity.hint("shuffle_hash"), "g").withColumn("rank", rank).where(F.col("rank") <= F.length("text") + 1 - F.ceil(F.length("text") * common - 1e-9))
    met = some.where("side = 'a'").select("g", F.col("text").alias("a")).join(some.where("side = 'b'").select("g", F.col("text").alias("b")).hint("merge"), "g")
    return met.where(close).select("a", "b").distinct()


def resolve(mentions: DataFrame, mention: str, dictionary: DataFrame, term: str, target: str, floor: float = 80.0, alias: str | None = None, place: str | None = None) -> DataFrame:
    """Dictionary resolution: exact by normalised term, else the best token-sorted ratio of at least ``floor``.

    With ``place``, the order of the dictionary, an exact term means its last target and equal ratios the first term; without, the
    greatest target and the smallest. Targets are of any type. Only distinct mentions without an exact match are compared, and only with
    terms that close_pairs() finds. Returns mention, target, score and method: name_exact, alias_exact (the column ``alias``
    marks a term as no name), fuzzy or unresolved.
    """
    is_name = F.lit(True) if alias is None else ~F.coalesce(F.col(alias), F.lit(False))
    at = F.col(target) if place is None else F.col(place)
    terms = dictionary.select(norm_text(F.col(term)).alias("term"), F.col(target).alias("target"), is_name.alias("is_name"), at.alias("place"))
    last = F.max_by(F.struct("target", "is_name"), F.struct("place", "is_name"))
    terms = terms.groupBy("term").agg(last.alias("last"), F.min("place").alias("first")).select("term", "last.target", "last.is_name", "first")
    wanted = mentions.select(F.col(mention).alias("mention"), norm_text(F.col(mention)).alias("norm")).distinct()
    # Every side here grows with the input, and texts take many times what the planner reckons from the files: none is broadcast.
    exact = wanted.join(terms.hint("merge"), F.col("norm") == F.col("term"), "left")
    rest = exact.where("target is null").select("mention", token_sort(F.col("mention")).alias("a"))
    keys = terms.select("target", F.col("target").alias("tie") if place is None else F.col("first").alias("tie"), token_sort(F.col("term")).alias("b"))
    scored = close_pairs(rest.where("a is not null"), keys, floor).withColumn("score", _ratio("a", "b")).where(F.col("score") >= floor)
    top = rest.join(scored.hint("merge"), "a").join(keys.hint("merge"), "b").groupBy("mention").agg(F.min_by(F.struct("target", "score"), F.struct(-F.col("score"), F.col("tie"))).alias("t"))
    fuzzy = top.select("mention", F.col("t.target").alias("target"), F.col("t.score").alias("score"), F.lit("fuzzy").alias("method"))
    hit = exact.where("target is not null").select("mention", "target", F.lit(100.0).alias("score"), F.when(F.col("is_name"), "name_exact").otherwise("alias_exact").alias("method"))
    none = rest.join(fuzzy.hint("merge"), "mention", "left_anti").select("mention", F.lit(None).cast(terms.schema["target"].dataType).alias("target"), F.lit(0.0).alias("score"), F.lit("unresolved").alias("method"))
    return hit.unionByName(fuzzy).unionByName(none)


def resolve_keyed(mentions: DataFrame, mention: str, keys: DataFrame) -> DataFrame:
    """Each row with the target whose key its mention is: by code (upper case) or by normalised term, whichever entry comes first.

    ``keys``: (kind, term, target, place), kind "code" or "term". One equi-join over both kinds instead of a join on "or".
    """
    wanted = mentions.select(F.col(mention).alias("mention")).distinct()
    code, term = F.upper(F.trim("mention")), norm_text(F.col("mention"))
    asked = wanted.select("mention", F.explode(F.array(F.struct(F.lit("code").alias("kind"), code.alias("term")), F.struct(F.lit("term").alias("kind"), term.alias("term")))).alias("k")).select("mention", "k.*")
    found = asked.join(keys, ["kind", "term"]).groupBy("mention").agg(F.min_by("target", "place").alias("target"))
    return mentions.join(found, F.col(mention) == F.col("mention"), "left").drop("mention") if mention != "mention" else mentions.join(found, "mention", "left")


def resolve_sender(messages: DataFrame, sender: str, customers: DataFrame, domains: str, customer: str) -> DataFrame:
    """Each message with the customer one of whose domains its sender's address has, null if none."""
    owners = customers.select(F.explode(domains).alias("domain"), F.col(customer))
    return messages.withColumn("domain", F.substring_index(F.lower(F.trim(sender)), "@", -1)).join(owners, "domain", "left")
