"""Features of raw entities: k-mers, minimizers, shingles, intervals, junctions.

All return long frames ``[entity, ...]``. Rows whose id or text is null give no features.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60

#: Published reductions of the amino-acid alphabet, one class per group.
ALPHABETS = {
    "protein20": "A C D E F G H I K L M N P Q R S T V W Y",
    "protein14": "A C D EQ FY G H IV KR LM N P ST W",
    "protein8": "AST C DHN EKQR FWY G ILMV P",
    "protein6": "AST CP DEHKNQR FWY G ILMV",
    "dna": "A C G T",
    "dna2": "AG CT",
    "dnac": "A C GT",
}


def clean(seq: Column) -> Column:
    """A sequence without blanks and line ends, in upper case."""
    return F.upper(F.regexp_replace(seq, "[ \\t\\r\\n]", ""))


def reduce_alphabet(seq: Column, alphabet: str) -> Column:
    """Letters replaced by the first letter of their class; other letters stay."""
    groups = ALPHABETS[alphabet].split(" ")
    return F.translate(seq, "".join(groups), "".join(g[0] * len(g) for g in groups))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a DNA k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def spacing(spec: str) -> list[int]:
    """Offsets of a spaced seed from its gaps, such as "0,1,1,0" or "0,1x2,0"."""
    gaps: list[int] = []
    for part in spec.split(","):
        n, _, times = part.partition("x")
        gaps += [int(n)] * int(times or 1)
    offsets = [0]
    for g in gaps:
        offsets.append(offsets[-1] + g + 1)
    return offsets


def kmers(df: DataFrame, entity: str, seq: str, k: int, letters: str = "ACGT", canon: bool = True, offsets: list[int] | None = None) -> DataFrame:
    """``[entity, pos, kmer]``: every k-mer of the given letters, by position from 1.

    A sequence shorter than the seed gives none. ``canon`` holds for unspaced DNA only; there
    is no length limit on k. ``letters`` empty: any letter."""
    span = (offsets[-1] + 1) if offsets else k
    if k < 1 or (offsets and len(offsets) != k):
        raise ValueError("k must be positive and match the spacing")
    src = df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.col(seq).alias("s")).where(F.length("s") >= span)
    if offsets:
        one = lambda i: F.concat(*[F.substring(F.col("s"), i + o, F.lit(1)) for o in offsets])
    else:
        one = lambda i: F.substring(F.col("s"), i, F.lit(k))
    out = src.select("entity", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("s") - (span - 1)), one)).alias("p", "kmer"))
    if letters:
        out = out.where(F.col("kmer").rlike(f"^[{re.escape(letters)}]+$"))
    if canon and not offsets and set(letters) == set("ACGT"):
        out = out.withColumn("kmer", canonical(F.col("kmer")))
    return out.select("entity", (F.col("p") + 1).alias("pos"), "kmer")


def entropy(kmer: Column, letters: str = "ACGT") -> Column:
    """Shannon entropy (bits) of a k-mer's letters."""
    n = F.length(kmer)
    total = F.lit(0.0)
    for c in letters:
        p = (n - F.length(F.replace(kmer, F.lit(c), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def minimizers(features: DataFrame, window: int, by_entropy: bool = False, seed: str | None = None, hpc: bool = False) -> DataFrame:
    """``[entity, pos, h]``: the smallest hash of each run of ``window`` consecutive k-mers.

    ``features [entity, pos, kmer]``; an entity with fewer k-mers than the window gives its
    smallest one. ``by_entropy`` prefers k-mers of high entropy. ``hpc`` drops an item equal
    to the one before it."""
    h = h60(F.col("kmer"), seed)
    src = features.withColumn("h", h)
    by = Window.partitionBy("entity").orderBy("pos")
    frame = by.rowsBetween(0, window - 1)
    rn = src.withColumn("i", F.row_number().over(by)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    if by_entropy:
        score = F.col("h") / (1 + entropy(F.col("kmer")))
        rn = rn.withColumn("m", F.min(F.struct(score.alias("x"), F.col("h").alias("y"))).over(frame)["y"])
    else:
        rn = rn.withColumn("m", F.min("h").over(frame))
    out = rn.where(F.col("i") <= F.greatest(F.col("n") - (window - 1), F.lit(1))).select("entity", "pos", F.col("m").alias("h"))
    return drop_repeats(out, "h") if hpc else out


def drop_repeats(df: DataFrame, item: str) -> DataFrame:
    """Consecutive equal items of an entity, in order of ``pos``, reduced to one."""
    before = F.lag(item).over(Window.partitionBy("entity").orderBy("pos"))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(item))).drop("_b")


def sequence_of(df: DataFrame, item: str) -> DataFrame:
    """``[entity, items]``: an entity's items as one array in order of ``pos``."""
    packed = F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("x"))))
    return df.groupBy("entity").agg(F.transform(packed, lambda e: e["x"]).alias("items"))


def shingles(df: DataFrame, entity: str, text: str, n: int = 5) -> DataFrame:
    """``[entity, shingle]``: distinct runs of n words, in lower case. A text with fewer
    words gives none."""
    w = F.split(F.lower(F.trim(F.col(text))), "\\s+")
    src = df.where(F.col(entity).isNotNull() & F.col(text).isNotNull()).select(F.col(entity).alias("entity"), w.alias("w")).where(F.size("w") >= n)
    run = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))
    return src.select("entity", F.explode(F.array_distinct(run)).alias("shingle")).distinct()


def entity_words(df: DataFrame, entity: str, text: str) -> DataFrame:
    """``[entity, words]``: the words of each of an entity's texts."""
    src = df.where(F.col(entity).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.collect_set(text).alias("t"))
    return src.select("entity", F.transform("t", lambda t: F.split(F.lower(F.trim(t)), "\\s+")).alias("words"))


def shingle_array(words: Column, n: int = 5) -> Column:
    """The shingles, of ``shingles``, of an array of texts' words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.flatten(F.transform(F.filter(words, lambda w: F.size(w) >= n), runs))


def interval_items(df: DataFrame, entity: str, chrom: str, start: str, end: str, weight: str | None = None, normalize: bool = False) -> DataFrame:
    """``[entity, item, weight]``: the bases of half-open intervals. Weight 1, the interval's
    own, or 1/length with ``normalize``; intervals of no length give nothing."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if normalize:
        w = w / (F.col(end) - F.col(start))
    base = F.explode(F.sequence(F.col(start), F.col(end) - 1))
    src = df.where(F.col(start) < F.col(end)).select(F.col(entity).alias("entity"), F.col(chrom).alias("c"), base.alias("p"), w.alias("weight"))
    return src.select("entity", F.concat_ws(":", F.col("c"), F.col("p").cast("string")).alias("item"), "weight")


def junction_items(df: DataFrame, ratio: bool = True) -> DataFrame:
    """``[entity, item, weight]`` of splice counts ``[sample, junction, num, den]``: the
    junction up to its third colon, weighted num/den or num; zeros are skipped."""
    key = F.regexp_extract(F.regexp_replace("junction", "^chr", ""), "^([^:]*:[^:]*:[^:]*)", 1)
    w = F.when(F.col("den") > 0, F.col("num") / F.col("den")) if ratio else F.col("num").cast("double")
    return df.where("num <> 0").select(F.col("sample").alias("entity"), key.alias("item"), w.alias("weight")).where("weight is not null")


def csr_items(df: DataFrame, row: str, item: str, weight: str | None) -> DataFrame:
    """``[entity, item, weight]`` of sparse rows: null weight 1, weight 0 absent, repeated
    items once with their largest weight."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    src = df.where(F.col(row).isNotNull() & F.col(item).isNotNull()).select(F.col(row).alias("entity"), F.col(item).alias("item"), w.alias("weight"))
    return src.where("weight <> 0").groupBy("entity", "item").agg(F.max("weight").alias("weight"))
