"""The operators of this subpackage as registered queries, each over its whole table, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.clusters import cluster_vectors
from docket.llm.common import table
from docket.llm.decontaminate import contaminated
from docket.llm.exact_dedup import exact_groups
from docket.llm.licences import scan_licences
from docket.llm.mainpage import extract_main
from docket.llm.maxent import language_scores
from docket.llm.negatives import mine_negatives
from docket.llm.packing import pack
from docket.llm.pii import pseudonymise
from docket.llm.quality import quality_scores
from docket.llm.simhash import near_duplicates
from docket.llm.substrings import remove_repeats
from docket.llm.tokenfile import read_token_files, write_token_files


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), key="docket")
    return found.select("doc_id", "text", "n_found", F.array_join("found.kind", ",").alias("kinds"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may part the bytes of a character
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).select("doc_id", "n_found", F.array_join("families", ",").alias("families"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, scale=256, salt=2)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", moved.alias("label")), positives=5, negatives=10, low=30, high=90, every=100)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_pseudonyms, op4_suffix_dedup, op5_exact_dedup, op6_licences, op7_simhash, op8_token_files, op9_main_text, op10_quality, op11_clusters, op12_negatives, op13_language_model)}

def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds as one chain of common table expressions."""
    dot = "list_dot_product"
    near = f"select vec_id, x, c as cluster, d from (select v.vec_id, v.x, c.c, ({dot}(v.x, v.x) - 2 * {dot}(v.x, c.y) + {dot}(c.y, c.y))::BIGINT d from v, C c) qualify row_number() over (partition by vec_id order by d, c) = 1"
    parts = [
        "v as materialized (select vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)",
        f"c0 as materialized (select row_number() over (order by h) - 1 as c, x as y from (select sha256('2:' || vec_id) h, x from v order by h limit {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} as materialized ({near.replace(' C c', f' c{r} c')})",
            f"m{r} as (select cluster, i, sum(e::BIGINT) s, count(*) n from (select cluster, unnest(x) e, unnest(range(1, 65)) i from a{r}) group by all)",
            f"n{r} as (select cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE order by i) y from m{r} group by cluster)",
            f"c{r + 1} as materialized (select c, coalesce(n.y, c.y) y from c{r} c left join n{r} n on n.cluster = c.c)",
        ]
    parts.append(f"a as materialized ({near.replace(' C c', f' c{rounds} c')})")
    return f"with {', '.join(parts)} select vec_id, cluster::INTEGER as cluster, d as distance, (sum(d) over (partition by cluster))::BIGINT as cluster_inertia, (sum(d) over ())::BIGINT as inertia, sha256(array_to_string(list_transform(y, lambda e: e::BIGINT::VARCHAR), ',')) as centroid_sha256 from a join c{rounds} c on c.c = a.cluster"


ORACLE_SQL = {
    "op1_decontamination": r"""
with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from benchmark),
     s as (select distinct item_id, array_to_string(w[k:k + 4], ' ') g from (select item_id, w, unnest(range(1, len(w) - 3)) k from i)),
     n as (select item_id, count(*) n from s group by item_id),
     d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w from documents),
     g as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) k from d))
select doc_id, s.item_id, count(*)::DOUBLE / any_value(n.n) as containment
from s join g using (g) join n on n.item_id = s.item_id
group by doc_id, s.item_id having count(*)::DOUBLE / any_value(n.n) >= 0.8 - 1e-9""",
    "op5_exact_dedup": """
with g as (select coalesce(text, '') t, max(doc_id) keep_id, count(*) group_size from documents group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(coalesce(d.text, '')) as text_sha256
from documents d join g on coalesce(d.text, '') = g.t""",
    "op11_clusters": _lloyd_sql(),
    "op12_negatives": """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = len(embedding)),
s as materialized (select a.vec_id a, b.vec_id b, a.label = b.label as same, list_dot_product(a.x, b.x)::BIGINT s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, (row_number() over (partition by p.a, p.b order by n.s desc, n.b))::INTEGER as rank, n.b as negative_id, p.s as positive_score, n.s as negative_score
from p join s n on n.a = p.a and not n.same and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s
qualify rank <= 10""",
}
