"""SQL functions and table functions for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: name(arguments) and body of each expression function
FUNCTIONS = {
    "h60(x STRING) RETURNS BIGINT": "CAST(conv(substr(md5(x), 1, 15), 16, 10) AS BIGINT)",
    "canonical_kmer(x STRING) RETURNS STRING": "least(x, reverse(translate(x, 'ACGT', 'TGCA')))",
    "jaccard_from_registers(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (p, q) -> if(p = q, 1, 0)), 0, (s, v) -> s + v) / CAST(size(a) AS DOUBLE)",
    "mash_distance(j DOUBLE, k INT) RETURNS DOUBLE": "if(j > 0, ln((1 + j) / (2 * j)) / greatest(k, 1), double('Infinity'))",
    "intersection_size(j DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE": "j * (a + b) / (1 + j)",
    "containment_index(j DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE": "if(a > 0, j * (a + b) / (1 + j) / a, 0)",
}


@udtf(returnType="pos int, kmer string", useArrow=False)
class Kmers:
    """``kmers(seq, k)``: the sequence's k-mers by position."""

    def eval(self, seq: str, k: int):
        if seq is not None and k is not None and k > 0:
            for i in range(len(seq) - k + 1):
                yield i + 1, seq[i : i + k]


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("kmers", Kmers)
