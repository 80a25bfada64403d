"""Registered queries of the training-data operators, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, clustering, components, heavy_hitters, overlaps, packing, setjoin, sketchjoin, subjects, vectors


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = clustering.clusters(table(spark, d, "fx_stacked"), "entity_id", "sig", 0.85)
    return clustering.same_cluster_pairs(members)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.clusters(table(spark, d, "fx_stacked"), "entity_id", "sig", 0.85)[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = overlaps.set_overlaps(table(spark, d, "fx_csr"), "row_id", "item", "weight", "load_batch", 3, 10)
    return setjoin.expand(pairs, members, "row_a", "row_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.frequent_values(table(spark, d, "fx_kmer_counts"), "kmer", "cnt", 2, 1000, "obs_id").select("kmer")


def p3_top(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.top_values(table(spark, d, "fx_kmer_counts"), "kmer", "cnt", 100, "obs_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = setjoin.similar_sets(table(spark, d, "fx_sketch_file"), "entity_id", "kmers", 3, 5)
    return setjoin.expand(pairs, members, "entity_a", "entity_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = components.neighbour_links(table(spark, d, "fx_knn"))
    return components.components(links, "row_id", "other")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = sketchjoin.similar_sequences(table(spark, d, "fx_sequences"), "seq_id", "seq", 12, 1, 2)
    return setjoin.expand(pairs, members, "seq_a", "seq_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(table(spark, d, "fx_stacked"), "entity_id", "sig", "num_neighbors", 5, 0.65)
    return near.select(F.least("entity", "neighbour").alias("entity_a"), F.greatest("entity", "neighbour").alias("entity_b")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    n = bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    items = n.select("doc_id", "n_tokens", F.lit(1).alias("segments"), F.greatest(F.col("n_tokens") - 1, F.lit(0)).alias("loss_tokens"))
    return packing.pack(items, "doc_id", ["n_tokens", "segments", "loss_tokens"], [4096, 128, 4096])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = subjects.fit(docs, table(spark, d, "doc_labels"), table(spark, d, "subjects"))
    return subjects.document_subjects(docs, model)


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p3_found, p3_top, p4_found, p5_found, p6_found, p7_found, p8_ids, p9_containers, p10_found)}

_COSINES = """
        with u as (select entity_id as id, any_value(sig) as sig, max(num_neighbors) as k from fx_stacked where sig is not null group by entity_id),
             v as (select id, coalesce(k, 5) as k, list_transform(sig, lambda x: coalesce(x, 0.0)) as sig from u),
             n as (select id, k, list_transform(sig, lambda x: x / sqrt(list_dot_product(sig, sig))) as sig from v where list_dot_product(sig, sig) > 0),
             s as (select x.id as a, y.id as b, x.k as k, round(list_dot_product(x.sig, y.sig), 9) as sim from n x join n y on x.id <> y.id)
"""

ORACLE = {
    # on tables whose clusters are cliques, the clusters' pairs are all similar pairs
    "p1_found": _COSINES + "select a as entity_a, b as entity_b from s where a < b and sim >= 0.85",
    "p2_found": """
        with m as (select distinct row_id, item from fx_csr where coalesce(weight, 1) <> 0),
             n as (select row_id, count(*) as n from m group by row_id),
             p as (select x.row_id as row_a, y.row_id as row_b, count(*) as c
                   from m x join m y on x.item = y.item and x.row_id < y.row_id group by 1, 2)
        select row_a, row_b from p join n x on x.row_id = row_a join n y on y.row_id = row_b
        where c * 10 >= 3 * least(x.n, y.n)""",
    "p4_found": """
        with m as (select distinct entity_id as e, unnest(kmers) as k from fx_sketch_file),
             t as (select e, k from m where k is not null),
             n as (select e, count(*) as n from t group by e),
             p as (select x.e as entity_a, y.e as entity_b, count(*) as c from t x join t y on x.k = y.k and x.e < y.e group by 1, 2)
        select entity_a, entity_b from p join n x on x.e = entity_a join n y on y.e = entity_b
        where c * 5 >= 3 * (x.n + y.n - c)""",
    "p6_found": """
        with s as (select distinct seq_id, upper(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g')) as q from fx_sequences where seq is not null),
             w as (select seq_id, unnest(list_transform(range(1, greatest(length(q) - 10, 1)), lambda i: substr(q, i, 12))) as f from s),
             c as (select distinct seq_id, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) as k from w where length(f) = 12 and regexp_full_match(f, '[ACGT]+')),
             n as (select seq_id, count(*) as n from c group by seq_id),
             p as (select x.seq_id as seq_a, y.seq_id as seq_b, count(*) as c from c x join c y on x.k = y.k and x.seq_id < y.seq_id group by 1, 2)
        select seq_a, seq_b from p join n x on x.seq_id = seq_a join n y on y.seq_id = seq_b
        where c * 2 >= x.n + y.n - c""",
    "p7_found": _COSINES + """,
             r as (select a, b, k, row_number() over (partition by a order by sim desc, b) as rk from s where sim >= 0.65)
        select distinct least(a, b) as entity_a, greatest(a, b) as entity_b from r where rk <= k""",
    "p3_found": """
        with o as (select distinct obs_id, kmer, cnt from fx_kmer_counts where kmer is not null and cnt is not null),
             t as (select kmer, sum(cnt) as total from o group by kmer)
        select kmer from t where total * 1000 >= 2 * (select sum(total) from t)""",
    "p3_top": """
        with o as (select distinct obs_id, kmer, cnt from fx_kmer_counts where kmer is not null and cnt is not null)
        select kmer, cast(sum(cnt) as bigint) as total,
               cast(row_number() over (order by sum(cnt) desc, kmer) as integer) as rk
        from o group by kmer order by total desc, kmer limit 100""",
    "p5_found": """
        with recursive l as (
            select distinct r, i from (
                select row_id as r, unnest(indices) as i, unnest(data) as s from fx_knn where len(indices) > 0)
            where s > 0 and i <> -1 and i <> r),
        e as (select r as a, i as b from l union select i, r from l),
        c as (select a as v, a as g from e union select c.v, e.b from c join e on c.g = e.a)
        select min(g) as group_id, v as record_id from c group by v""",
}
