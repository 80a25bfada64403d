"""Registered queries of the core operators and their SQL twins.

Each query runs over its whole tables. The SQL is written for an engine with md5, lists and
lambdas; ``h60`` has the same value in both dialects, so sketches compare register by
register. Doubles are rounded to 9 decimals in the last projection only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.hashing import h60
from ..functions.hashing import sql_h60 as H
from ..operators import counting as C
from ..operators import features as K
from ..operators import filters as FL
from ..operators import neighbours as N
from ..operators import pairs as P
from ..operators import sketches as S
from ..runtime import cut, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r9(c):
    return F.round(c, 9)


# ---- documents: word shingles -------------------------------------------------------------


def _shingles(spark, d, n=5):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return K.shingles(spread(docs), "doc_id", "text", n)


_SH = r"""
 b as (select doc_id as entity, string_split_regex(lower(trim(text)), '\s+') as w from documents where text is not null),
 sh as (select distinct entity, array_to_string(list_slice(w, i, i + 4), ' ') as shingle
        from (select entity, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5))"""
_DREG = f"{_SH}, r as (select entity, cast({H('shingle')} % 128 as integer) as reg, min({H('shingle')}) as v from sh group by 1, 2)"
_DPAIR = f"{_DREG}, p as (select x.entity as i, y.entity as j, count(*) as eq from r x join r y on x.reg = y.reg and x.v = y.v and x.entity < y.entity group by 1, 2)"


@query(f"with {_SH} select entity, count(*) as shingles from sh group by entity")
def doc_shingles(spark, d):
    return _shingles(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("shingles"))


@query(f"with {_DREG} select entity, reg, v from r")
def doc_shingle_oph(spark, d):
    return S.oph(_shingles(spark, d), "shingle", 128)


@query(f"with {_DREG} select entity, round(128.0 * 128 / (sum(v / 1152921504606846976.0) + 128 - count(*)), 9) as card from r group by entity")
def doc_oph_cardinality(spark, d):
    return S.oph_cardinality(S.oph(_shingles(spark, d), "shingle", 128), 128).select("entity", r9("card").alias("card"))


def _mask_sql(regs: str, size: int) -> str:
    words = ", ".join(f"bit_or(case when reg // 32 = {w} then cast(1 as bigint) << (reg % 32) else 0 end) as m{w}" for w in range(size // 32))
    return f"mk as (select entity, {words} from {regs} group by entity)"


def _filled_sql(size: int) -> str:
    """Registers filled in either of two entities, from their masks a and b."""
    return "(" + " + ".join(f"cast(bit_count(a.m{w} | b.m{w}) as integer)" for w in range(size // 32)) + ")"


def _doc_pairs(spark, d):
    """``[i, j, eq, filled]``: registers equal, and filled on either side."""
    regs = cut(S.oph(_shingles(spark, d), "shingle", 128))
    return P.with_filled(P.register_pairs(regs), regs, 128)


_DFILL = f"{_DPAIR}, {_mask_sql('r', 128)}, f as (select i, j, eq, {_filled_sql(128)} as filled from p join mk a on a.entity = i join mk b on b.entity = j)"


@query(f"""with {_DFILL}, e as (select i, j, cast(eq as double) / filled as s from f union all select j, i, cast(eq as double) / filled from f),
 k as (select i, j, round(s, 9) as score, rank() over (partition by i order by s desc) as rk from e)
 select i, j, score, cast(rk as integer) as rk from k where rk <= 5""")
def doc_nearest_topk(spark, d):
    scored = _doc_pairs(spark, d).select("i", "j", (F.col("eq") / F.col("filled")).alias("score"))
    return N.topk(N.both_ways(scored, "score"), "score", 5).select("i", "j", r9("score").alias("score"), "rk")


@query(f"""with {_SH}, n as (select entity, count(*) as n from sh group by entity),
 p as (select x.entity as i, y.entity as j, count(*) as c from sh x join sh y on x.shingle = y.shingle and x.entity < y.entity group by 1, 2)
 select i, j, round(c / cast(a.n + b.n - c as double), 9) as score from p join n a on a.entity = i join n b on b.entity = j where c * 5 >= 4 * (a.n + b.n - c)""")
def doc_threshold_graph(spark, d):
    """Near-duplicate documents: exact Jaccard similarity of five-word shingles from 0.8 on.
    Sketches choose the pairs to verify: the equal share of the filled registers may lie
    five standard errors below 0.8, which a similar pair does once in some millions."""
    likely = P.likely_pairs(cut(S.oph(_shingles(spark, d), "shingle", 128)), 128, 0.8, 2)
    docs = K.entity_words(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    x, y = docs.select(F.col("entity").alias("i"), F.col("words").alias("x")), docs.select(F.col("entity").alias("j"), F.col("words").alias("y"))
    met = P.shuffled(P.shuffled(likely).join(x, "i")).join(y, "j").select("i", "j", K.shingle_array(F.col("x")).alias("x"), K.shingle_array(F.col("y")).alias("y"))
    q = met.select("i", "j", F.size(F.array_intersect("x", "y")).alias("c"), F.size(F.array_union("x", "y")).alias("u"))
    return q.where(F.col("c") * 5 >= 4 * F.col("u")).select("i", "j", r9(F.col("c") / F.col("u")).alias("score"))


# ---- sequences: k-mers and their relatives ------------------------------------------------


def _seqs(spark, d):
    s = spread(table(spark, d, "fx_sequences")).where("seq is not null")
    return s.select(F.col("seq_id").alias("entity"), K.clean(F.col("seq")).alias("seq")).distinct()


_SEQ = "s as (select distinct seq_id as entity, upper(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g')) as seq from fx_sequences where seq is not null)"


def _km(k: int, canon: bool = True, src: str = "seq", letters: str = "ACGT") -> str:
    m = "least(f, reverse(translate(f, 'ACGT', 'TGCA')))" if canon else "f"
    return (
        f"{_SEQ}, w as (select entity, i as pos, substr({src}, i, {k}) as f from (select entity, seq, unnest(range(1, length(seq) - {k} + 2)) as i from s where length(seq) >= {k})), "
        f"km as (select entity, cast(pos as integer) as pos, {m} as kmer from w where regexp_full_match(f, '[{letters}]+'))"
    )


def _kmers(spark, d, k, **kw):
    return K.kmers(_seqs(spark, d), "entity", "seq", k, **kw)


@query(f"with {_km(12)} select entity, pos, kmer from km")
def seq_canonical_kmers(spark, d):
    return _kmers(spark, d, 12)


@query(f"with {_km(31, canon=False)} select entity, count(*) as n, count(distinct kmer) as distinct_kmers from km group by entity")
def seq_long_kmers(spark, d):
    return _kmers(spark, d, 31, canon=False).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kmer").alias("distinct_kmers"))


@query(
    f"with {_SEQ}, w as (select entity, i as pos, substr(seq, i, 1) || substr(seq, i + 1, 1) || substr(seq, i + 3, 1) || substr(seq, i + 4, 1) || substr(seq, i + 7, 1) as kmer "
    "from (select entity, seq, unnest(range(1, length(seq) - 6)) as i from s where length(seq) >= 8)) select entity, cast(pos as integer) as pos, kmer from w where regexp_full_match(kmer, '[ACGT]+')"
)
def seq_spaced_kmers(spark, d):
    return _kmers(spark, d, 5, offsets=K.spacing("0,1,0,2"))


@query(f"with {_km(10, canon=False, src=chr(116) + 'ranslate(seq, ' + chr(39) + 'AGCT' + chr(39) + ', ' + chr(39) + 'AACC' + chr(39) + ')')} select kmer, count(*) as n from km group by kmer")
def seq_reduced_alphabet(spark, d):
    two = _seqs(spark, d).select("entity", K.reduce_alphabet(F.col("seq"), "dna2").alias("seq"))
    return K.kmers(two, "entity", "seq", 10, canon=False).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


_MIN = (
    f"{_km(12)}, q as (select entity, pos, {H('kmer')} as h from km), "
    "z as (select entity, pos, min(h) over (partition by entity order by pos rows between current row and 9 following) as h, "
    "row_number() over (partition by entity order by pos) as i, count(*) over (partition by entity) as n from q), "
    "mi as (select entity, pos, h from z where i <= greatest(n - 9, 1))"
)


@query(f"with {_MIN} select entity, pos, h from mi")
def seq_minimizers(spark, d):
    return K.minimizers(_kmers(spark, d, 12), 10)


@query(f"with {_MIN}, l as (select *, lag(h) over (partition by entity order by pos) as b from mi) select entity, pos, h from l where b is null or b <> h")
def seq_hpc_minimizers(spark, d):
    return K.minimizers(_kmers(spark, d, 12), 10, hpc=True)


@query(
    f"with {_km(12)}, q as (select entity, pos, {H('kmer')} as h, "
    + " + ".join(f"coalesce(-nullif((12 - length(replace(kmer, '{c}', ''))) / 12.0, 0) * log2(nullif((12 - length(replace(kmer, '{c}', ''))) / 12.0, 0)), 0)" for c in "ACGT")
    + " as e from km), z as (select entity, pos, min(struct_pack(x := h / (1 + e), y := h)) over (partition by entity order by pos rows between current row and 9 following) as m, "
    "row_number() over (partition by entity order by pos) as i, count(*) over (partition by entity) as n from q) select entity, pos, m.y as h from z where i <= greatest(n - 9, 1)"
)
def seq_entropy_minimizers(spark, d):
    return K.minimizers(_kmers(spark, d, 12), 10, by_entropy=True)


@query(f"with {_MIN} select entity, string_agg(cast(h as varchar), ',' order by pos) as items from mi group by entity")
def seq_minimizer_sequence(spark, d):
    seq = K.sequence_of(K.minimizers(_kmers(spark, d, 12), 10), "h")
    return seq.select("entity", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(f"with {_km(12)}, u as (select distinct entity, kmer from km), q as (select *, {H('kmer')} as h from u), z as (select *, row_number() over (partition by entity order by h, kmer) as r from q) select entity, kmer, h from z where r <= 16")
def seq_bottom_k(spark, d):
    return C.bottom_k(C.exact_sets(_kmers(spark, d, 12), "kmer"), "kmer", 16)


@query(f"with {_km(12)}, t as (select kmer from km group by kmer having count(distinct entity) > 20) select entity, count(*) as n from km where kmer not in (select kmer from t) group by entity")
def seq_blocked_kmers(spark, d):
    km = _kmers(spark, d, 12)
    common = km.groupBy("kmer").agg(F.countDistinct("entity").alias("n")).where("n > 20")
    return FL.block(km, common, "kmer").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_km(12)} select entity, pos, kmer from km where {H('kmer')} < 115292150460684697")
def seq_downsampled(spark, d):
    return FL.downsample(_kmers(spark, d, 12), "kmer", 0.1)


@query(f"with {_km(12)} select entity, kmer, count(*) as cnt from km group by 1, 2 having count(*) >= 2")
def seq_min_count(spark, d):
    return FL.min_count(C.counts(_kmers(spark, d, 12), "kmer"), 2)


@query(f"with {_km(12)} select entity, count(distinct kmer) as card from km group by entity")
def seq_exact_cardinality(spark, d):
    return C.cardinality(_kmers(spark, d, 12), "kmer")


@query(
    f"with {_km(12)}, q as (select entity, kmer, {H('kmer')} as h from km), r as (select entity, cast(h % 32 as integer) as reg, min(h) as v, arg_min(kmer, h) as item from q group by 1, 2), "
    "c as (select entity, kmer, count(*) as cnt from km group by 1, 2) select r.entity, reg, item, cnt from r join c on c.entity = r.entity and c.kmer = item"
)
def seq_oph_winners(spark, d):
    km = _kmers(spark, d, 12)
    return S.winners(S.oph(km, "kmer", 32, keep=True), km, "kmer")


@query(
    f"with {_km(12)}, o as (select entity, pos, kmer, row_number() over (partition by entity, kmer order by pos) as n from km), "
    f"x as (select entity, pos, kmer, kmer || '#' || n as x, unnest(range(0, 4)) as reg from o), h as (select *, {H(chr(120) + ' || ' + chr(39) + '|' + chr(39) + ' || reg')} as h from x), "
    "z as (select *, row_number() over (partition by entity, reg order by h, x) as r from h) "
    f"select entity, cast(reg as integer) as reg, {H('string_agg(kmer, ' + chr(39) + '|' + chr(39) + ' order by pos, kmer)')} as v from z where r <= 2 group by entity, reg"
)
def seq_order_minhash(spark, d):
    return S.orderminhash(_kmers(spark, d, 12), "kmer", 4, 2)


_SPAIR = f"""{_km(12)}, r as (select entity, cast({H('kmer')} % 64 as integer) as reg, min({H('kmer')}) as v from km group by 1, 2), {_mask_sql('r', 64)},
 e as (select x.entity as i, y.entity as j, count(*) as eq from r x join r y on x.reg = y.reg and x.v = y.v and x.entity < y.entity group by 1, 2),
 st as (select distinct entity, kmer from km), sn as (select entity, count(*) as n from st group by entity),
 fw as (select st.entity, kmer from st join sn on sn.entity = st.entity where n < 64),
 mt as (select distinct least(x.entity, y.entity) as i, greatest(x.entity, y.entity) as j, count(*) as c from fw x join st y on x.kmer = y.kmer and x.entity <> y.entity group by x.entity, y.entity),
 p as (select i, j from e join mk a on a.entity = i join mk b on b.entity = j where eq * 4 >= {_filled_sql(64)}
  union select i, j from mt join sn a on a.entity = i join sn b on b.entity = j where c * 4 >= a.n + b.n - c)"""


def _seq_similar(spark, d):
    """``[i, j]``: pairs with a quarter or more of their filled registers equal; reads of
    fewer distinct 12-mers than registers also by their exact Jaccard similarity."""
    sets = cut(C.exact_sets(_kmers(spark, d, 12), "kmer"))
    regs = cut(S.oph(sets, "kmer", 64))
    near = P.with_filled(P.register_pairs(regs), regs, 64).where(F.col("eq") * 4 >= F.col("filled")).select("i", "j")
    n = cut(sets.groupBy("entity").agg(F.count(F.lit(1)).alias("card")))
    few = P.shuffled(sets).join(n.where("card < 64").select("entity"), "entity").select(F.col("entity").alias("x"), "kmer")
    met = P.shuffled(few).join(sets.select(F.col("entity").alias("y"), "kmer"), "kmer").where("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    met = met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "shared").distinct()
    exact = P.with_sizes(met, n, "card").where(F.col("shared") * 4 >= F.col("a") + F.col("b") - F.col("shared")).select("i", "j")
    return near.unionByName(exact).distinct()


@query(f"with {_SPAIR} select i, j, cast(levenshtein(x.seq, y.seq) as integer) as dist from p join s x on x.entity = i join s y on y.entity = j")
def seq_edit_distance(spark, d):
    s = _seqs(spark, d)
    x, y = s.select(F.col("entity").alias("i"), F.col("seq").alias("x")), s.select(F.col("entity").alias("j"), F.col("seq").alias("y"))
    left = P.shuffled(P.shuffled(_seq_similar(spark, d)).join(x, "i"))
    return left.join(y, "j").select("i", "j", F.levenshtein("x", "y").alias("dist"))


@query()
def seq_minimizer_edit(spark, d):
    seqs = K.sequence_of(K.minimizers(_kmers(spark, d, 12), 10, hpc=True), "h")
    return P.sequence_edit(_seq_similar(spark, d), seqs)


@query(f"with {_MIN}, n as (select entity, row_number() over (partition by entity order by pos) as k, h from mi) select x.entity as i, y.entity as j, count(*) as matches from n x join n y on x.k = y.k and x.h = y.h and x.entity < y.entity group by 1, 2")
def seq_positional(spark, d):
    mi = K.minimizers(_kmers(spark, d, 12), 10)
    num = mi.select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("pos")).alias("pos"), "h")
    return P.positional(num, "h")


# ---- sparse rows: exact measures and sketches ---------------------------------------------


def _csr(spark, d):
    return K.csr_items(table(spark, d, "fx_csr"), "row_id", "item", "weight")


_CSR = "m as (select row_id as entity, item, max(coalesce(weight, 1)) as weight from fx_csr where coalesce(weight, 1) <> 0 group by 1, 2)"
_CPAIR = f"{_CSR}, n as (select entity, count(*) as n, sum(weight) as w from m group by entity), p as (select x.entity as i, y.entity as j, count(*) as shared, sum(least(x.weight, y.weight)) as wmin, sum(x.weight * y.weight) as dot from m x join m y on x.item = y.item and x.entity < y.entity group by 1, 2), q as (select p.*, a.n as a, b.n as b, a.w as wa, b.w as wb from p join n a on a.entity = i join n b on b.entity = j)"


@query(f"with {_CSR} select entity, round(sum(weight), 9) as total_weight, count(*) as updates from m group by entity")
def csr_totals(spark, d):
    return C.totals(_csr(spark, d), "weight").select("entity", r9("total_weight").alias("total_weight"), "updates")


@query(f"""with {_CPAIR}, x as (select *, shared / cast(a + b - shared as double) as jac from q)
 select i, j, round(jac, 9) as jaccard, round(shared / cast(a as double), 9) as containment, round(shared / cast(least(a, b) as double), 9) as symmetric_containment,
 cast(shared as bigint) as intersection, cast(a + b - shared as bigint) as union_size, round(ln((1 + jac) / (2 * jac)) / 21, 9) as mash from x""")
def csr_exact_measures(spark, d):
    m = _csr(spark, d)
    q = P.with_sizes(P.shared_items(m, "item"), C.cardinality(m, "item"), "card")
    jac = F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))
    q = q.withColumn("jac", jac)
    return q.select(
        "i", "j", r9("jac").alias("jaccard"), r9(F.col("shared") / F.col("a")).alias("containment"), r9(F.col("shared") / F.least("a", "b")).alias("symmetric_containment"),
        F.col("shared").alias("intersection"), (F.col("a") + F.col("b") - F.col("shared")).alias("union_size"), r9(M.mash_distance(F.col("jac"), 21)).alias("mash"),
    )


@query(f"with {_CPAIR} select i, j, round(wmin / (wa + wb - wmin), 9) as weighted_jaccard from q")
def csr_weighted_jaccard(spark, d):
    m = _csr(spark, d)
    q = P.with_sizes(P.shared_items(m, "item", "weight"), C.totals(m, "weight"), "total_weight")
    return q.select("i", "j", r9(F.col("wmin") / (F.col("a") + F.col("b") - F.col("wmin"))).alias("weighted_jaccard"))


@query(f"with {_CPAIR}, l as (select entity, sqrt(sum(weight * weight)) as l from m group by entity) select i, j, round(dot / (x.l * y.l), 9) as cosine from q join l x on x.entity = i join l y on y.entity = j")
def csr_cosine(spark, d):
    m = _csr(spark, d)
    norms = m.groupBy("entity").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l"))
    return P.with_sizes(P.shared_items(m, "item", "weight"), norms, "l").select("i", "j", r9(F.col("dot") / (F.col("a") * F.col("b"))).alias("cosine"))


@query(f"with {_CSR}, h as (select entity, item, {H('cast(item as varchar)')} / weight as h from m), z as (select *, row_number() over (partition by entity order by h, item) as r from h) select entity, item, round(h / 1152921504606846976.0, 9) as h from z where r <= 16")
def csr_weighted_bottom_k(spark, d):
    return C.bottom_k(_csr(spark, d), "item", 16, "weight").select("entity", "item", r9(F.col("h") / (1 << 60)).alias("h"))


@query(f"with {_CSR}, h as (select entity, {H('cast(item as varchar)')} as h, weight as w from m) select entity, cast(h % 64 as integer) as cell, round(sum(case when (h >> 40) % 2 = 1 then w else -w end), 9) as v from h group by 1, 2")
def csr_count_sketch(spark, d):
    return C.count_sketch(_csr(spark, d), "item", 64, "weight").select("entity", "cell", r9("v").alias("v"))


_CREG = f"{_CSR}, h as (select entity, {H('cast(item as varchar)')} as h from m), r as (select entity, cast(h % 64 as integer) as reg, min(h) as v from h group by 1, 2)"
_DENSE = f"{_CREG}, ev as (select distinct entity, unnest(range(0, 64)) as reg from r), em as (select ev.entity, ev.reg from ev anti join r on r.entity = ev.entity and r.reg = ev.reg), dn as (select em.entity, cast(em.reg as integer) as reg, arg_min(r.v, {H('em.reg || ' + chr(39) + '~' + chr(39) + ' || r.reg')}) as v from em join r on r.entity = em.entity group by 1, 2), de as (select * from r union all select * from dn)"


def _oph(spark, d):
    return S.oph(_csr(spark, d), "item", 64)


@query(f"with {_DENSE} select entity, reg, v from de")
def csr_densified(spark, d):
    return S.densify(_oph(spark, d), 64)


@query(f"with {_DENSE} select entity, reg, {H('cast(v as varchar)')} >> 52 as sig from de")
def csr_bbit(spark, d):
    return S.bbit(S.densify(_oph(spark, d), 64), 8)


@query(f"with {_DENSE}, g as (select entity, reg, {H('cast(v as varchar)')} >> 52 as sig from de) select x.entity as i, y.entity as j, round(greatest(0, (count(*) / 64.0 - 0.00390625) / 0.99609375), 9) as j_bbit from g x join g y on x.reg = y.reg and x.sig = y.sig and x.entity < y.entity group by 1, 2 having count(*) >= 8")
def csr_bbit_similarity(spark, d):
    sig = S.bbit(S.densify(_oph(spark, d), 64), 8)
    return P.register_pairs(sig, "sig").where("eq >= 8").select("i", "j", r9(M.bbit_similarity(F.col("eq") / 64, 8)).alias("j_bbit"))


@query(f"with {_CREG} select entity, reg, {H('cast(v as varchar)')} as sig from r")
def csr_signatures(spark, d):
    return S.signatures(_oph(spark, d))


@query(f"with {_CREG}, u as (select entity, count(*) as n from r group by entity) select r.entity, reg, round(-ln(1 - v / 1152921504606846976.0) / n, 9) as v from r join u on u.entity = r.entity")
def csr_oph_exponential(spark, d):
    return S.oph_exponential(_oph(spark, d), 64).select("entity", "reg", r9("v").alias("v"))


_SET = f"{_CSR}, e as (select entity, item, unnest(range(0, 16)) as reg from m), ss as (select entity, cast(reg as integer) as reg, min(-ln(({H('item || ' + chr(39) + '|' + chr(39) + ' || reg')} + 1) / 1152921504606846976.0)) as v from e group by 1, 2)"


@query(f"with {_SET} select entity, reg, round(v, 9) as v from ss")
def csr_setsketch(spark, d):
    return S.setsketch(_csr(spark, d), "item", 16).select("entity", "reg", r9("v").alias("v"))


@query(f"with {_SET} select entity, round(16.0 / sum(v), 9) as card from ss group by entity")
def csr_setsketch_cardinality(spark, d):
    return S.setsketch_cardinality(S.setsketch(_csr(spark, d), "item", 16), 16).select("entity", r9("card").alias("card"))


_DISC = f"{_SET}, di as (select entity, reg, cast(least(greatest(floor(1 - ln(v / 20.0) / ln(1.2)), 0), 255) as bigint) as k from ss)"


@query(f"with {_DISC} select entity, reg, k from di")
def csr_discrete_setsketch(spark, d):
    return S.discretise(S.setsketch(_csr(spark, d), "item", 16), *S.PRESETS["byte"])


@query(f"with {_DISC} select entity, round(16 * (1 - 1 / 1.2) / (20.0 * ln(1.2) * sum(pow(1.2, -k))), 6) as card from di group by entity")
def csr_discrete_cardinality(spark, d):
    b, a, q = S.PRESETS["byte"]
    return S.discrete_cardinality(S.discretise(S.setsketch(_csr(spark, d), "item", 16), b, a, q), 16, b, a).select("entity", F.round("card", 6).alias("card"))


def _discrete_pairs(spark, d):
    b, a, q = S.PRESETS["byte"]
    m = _csr(spark, d)
    disc = S.discretise(S.setsketch(m, "item", 16), b, a, q)
    arrays = S.wide(disc.withColumnRenamed("k", "v"), 16)
    return P.with_sizes(P.compare_arrays(P.shared_items(m, "item"), arrays), C.cardinality(m, "item"), "card")


@query(f"""with {_DISC}, n as (select entity, count(*) as n from m group by entity),
 p as (select x.entity as i, y.entity as j from m x join m y on x.item = y.item and x.entity < y.entity group by 1, 2),
 c as (select i, j, count(*) filter (x.k > y.k) / 16.0 as gt, count(*) filter (x.k < y.k) / 16.0 as lt from p join di x on x.entity = i join di y on y.entity = j and y.reg = x.reg group by 1, 2),
 g as (select i, j, (1 - pow(1.2, -gt)) / (1 - 1 / 1.2) as ga, (1 - pow(1.2, -lt)) / (1 - 1 / 1.2) as gb, a.n as a, b.n as b from c join n a on a.entity = i join n b on b.entity = j),
 u as (select *, case when ga + gb >= 1 then a + b else (a + b) / (2 - ga - gb) end as un from g)
 select i, j, round(greatest(a + b - un, 0) / un, 9) as similarity from u""")
def csr_compressed_similarity(spark, d):
    q = _discrete_pairs(spark, d)
    return q.select("i", "j", r9(M.compressed_similarity(F.col("gt") / 16, F.col("lt") / 16, F.col("a"), F.col("b"), 1.2)).alias("similarity"))


@query()
def csr_joint_ml(spark, d):
    return P.joint_ml(_discrete_pairs(spark, d), 1.2).select("i", "j", F.round("j_ml", 6).alias("j_ml"))


_UNIT = "item || '#' || r"


@query(f"""with {_CSR}, e as (select entity, {_UNIT} as x from (select entity, item, weight, unnest(range(1, cast(ceil(weight) as bigint) + 1)) as r from m)
  where r <= weight or ({H(_UNIT + " || '!'")} + 1) / 1152921504606846976.0 <= weight - (r - 1))
 select entity, cast({H('x')} % 32 as integer) as reg, min({H('x')}) as v from e group by 1, 2""")
def csr_bagminhash(spark, d):
    return S.bagminhash(_csr(spark, d), "item", "weight", 32)


@query(f"with {_CSR}, e as (select entity, item, weight, unnest(range(0, 8)) as reg from m), v as (select entity, cast(reg as integer) as reg, item, -ln(({H('item || ' + chr(39) + '|' + chr(39) + ' || reg')} + 1) / 1152921504606846976.0) / weight as v from e) select entity, reg, round(min(v), 9) as v, arg_min(item, v) as item from v group by 1, 2")
def csr_probminhash(spark, d):
    return S.probminhash(_csr(spark, d), "item", "weight", 8).select("entity", "reg", r9("v").alias("v"), "item")


@query()
def csr_icws(spark, d):
    return S.icws(_csr(spark, d), "item", "weight", 8)


@query(f"with {_CREG} select entity % 10 as entity, reg, min(v) as v from r group by 1, 2")
def csr_merged(spark, d):
    regs = _oph(spark, d)
    return S.merge(regs, regs.select("entity", (F.col("entity") % 10).alias("g")).distinct(), "g")


@query(f"with {_CREG} select x.entity as i, y.entity as j, count(*) as eq from r x join r y on x.reg = y.reg and x.v = y.v and x.entity % 5 <> 0 and y.entity % 5 = 0 group by 1, 2")
def csr_panel(spark, d):
    regs = _oph(spark, d)
    return P.panel(regs.where("entity % 5 <> 0"), regs.where("entity % 5 = 0"))


@query(f"with {_CREG}, l as (select distinct ids as i, c as j from (select ids, unnest(constituents) as c from fx_greedy) where c is not null), q as (select l.i, l.j, count(*) as eq from l join r x on x.entity = l.i join r y on y.entity = l.j and y.reg = x.reg and y.v = x.v group by 1, 2) select l.i, l.j, coalesce(eq, 0) as eq from l left join q on q.i = l.i and q.j = l.j")
def csr_pair_list(spark, d):
    want = table(spark, d, "fx_greedy").select(F.col("ids").alias("i"), F.explode("constituents").alias("j")).where("j is not null")
    return P.listed(want, _oph(spark, d))


_EDGE = f"{_CPAIR}, e as (select i, j, round(shared / cast(a + b - shared as double), 9) as score from q), bo as (select i, j, score from e union all select j, i, score from e)"


def _csr_edges(spark, d):
    m = _csr(spark, d)
    q = P.with_sizes(P.shared_items(m, "item"), C.cardinality(m, "item"), "card")
    return q.select("i", "j", r9(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("score"))


@query(f"with {_EDGE}, k as (select *, rank() over (partition by i order by score desc) as rk from bo) select i, j, score, cast(rk as integer) as rk from k where rk <= 3")
def csr_exact_knn(spark, d):
    return N.topk(N.both_ways(_csr_edges(spark, d), "score"), "score", 3)


def _band_sql(size: int, levels: int) -> str:
    plan = ", ".join(f"({lv}, {sub}, {r}, {len(rs)})" for lv, sub, rs in N.band_plan(size, levels) for r in rs)
    key = H("string_agg(cast(v as varchar), ',' order by de.reg)")
    return f"bp(level, sub, reg, width) as (values {plan}), bk as (select entity, level, sub, {key} as key from de join bp on bp.reg = de.reg group by entity, level, sub, width having count(*) = width)"


_CA = "ca as (select x.entity as i, y.entity as j, max(x.level) as level, count(*) as hits from bk x join bk y on x.level = y.level and x.sub = y.sub and x.key = y.key and x.entity <> y.entity group by 1, 2)"
_CAND = f"{_DENSE}, {_band_sql(64, 3)}, {_CA}, cr as (select *, row_number() over (partition by i order by level desc, hits desc, j) as r from ca)"


@query(f"with {_CAND} select i, j, cast(level as integer) as level, hits from cr where r <= 10")
def csr_lsh_candidates(spark, d):
    return N.candidates(N.band_keys(S.densify(_oph(spark, d), 64), 64, 3), most=10)


_FINE = f"{_CSR}, h as (select entity, {H('cast(item as varchar)')} as h from m), r as (select entity, cast(h % 512 as integer) as reg, min(h) as v from h group by 1, 2), cc as (select distinct x.entity as i, y.entity as j from r x join r y on x.reg = y.reg and x.v = y.v and x.entity <> y.entity)"


@query(f"with {_FINE}, n as (select entity, count(*) as n from m group by entity), sh as (select cc.i, cc.j, count(*) as s from cc join m x on x.entity = i join m y on y.entity = j and y.item = x.item group by 1, 2), sc as (select i, j, round(s / cast(a.n + b.n - s as double), 9) as score from sh join n a on a.entity = i join n b on b.entity = j), k as (select *, rank() over (partition by i order by score desc) as rk from sc) select i, j, score, cast(rk as integer) as rk from k where rk <= 3")
def csr_knn_refined(spark, d):
    m = _csr(spark, d)
    # every set that shares one of 512 registers is rescored: recall 0.9 and more against
    # csr_exact_knn, the exact form, whose neighbours may share a single item. Sets share a
    # register where an item is the smallest of its register in both, so the rows of one
    # inverted index tell the candidates and what they share
    h = h60(F.col("item"))
    low = F.min("h").over(Window.partitionBy("entity", "reg"))
    src = m.select("entity", "item", h.alias("h")).withColumn("reg", F.pmod("h", F.lit(512)).cast("int")).select("entity", "item", (F.col("h") == low).alias("low"))
    x, y = src.select(F.col("entity").alias("i"), "item", F.col("low").alias("x")), src.select(F.col("entity").alias("j"), "item", F.col("low").alias("y"))
    met = P.shuffled(x).join(y, "item").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"), F.max(F.col("x") & F.col("y")).alias("near"))
    exact = met.where("near").select("i", "j", "shared")
    sized = P.with_sizes(exact, C.cardinality(m, "item"), "card")
    scored = sized.select("i", "j", r9(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).alias("score"))
    return N.topk(N.both_ways(scored, "score"), "score", 3)


@query(f"""with recursive {_EDGE}, od as (select entity, row_number() over (order by n desc, entity) as pos from n),
 nb as (select bo.i, list(bo.j order by score desc, od.pos) as l from bo join od on od.entity = bo.j where score >= 0.1 group by bo.i),
 st as (select entity, pos, coalesce(l, []) as l from od left join nb on nb.i = od.entity),
 g as (select pos, [entity] as reps, entity as member, entity as rep from st where pos = 1
  union all select st.pos, case when len(list_filter(st.l, lambda x: list_contains(g.reps, x))) > 0 then g.reps else list_append(g.reps, st.entity) end,
  st.entity, coalesce(list_filter(st.l, lambda x: list_contains(g.reps, x))[1], st.entity) from g join st on st.pos = g.pos + 1)
 select member, rep from g""")
def csr_greedy_clusters(spark, d):
    m = _csr(spark, d)
    card = C.cardinality(m, "item")
    # one global order over the entities (not over their items)
    order = card.select("entity", F.row_number().over(Window.orderBy(F.desc("card"), "entity")).alias("pos"))
    return N.greedy_clusters(FL.threshold(_csr_edges(spark, d), "score", 0.1), order)


@query("""with u as (select row_id, any_value(cardinality) as card, any_value(signature) as sig from fx_csr_sketch group by row_id),
 r as (select row_id, unnest(range(1, len(sig) + 1)) as reg, unnest(sig) as v from u),
 p as (select x.row_id as i, y.row_id as j, count(*) as eq from r x join r y on x.reg = y.reg and x.v = y.v and x.row_id < y.row_id group by 1, 2)
 select i, j, round(eq / 128.0, 9) as similarity, round(eq / 128.0 * (a.card + b.card) / (1 + eq / 128.0), 6) as intersection
 from p join u a on a.row_id = i join u b on b.row_id = j""")
def csr_sketch_estimates(spark, d):
    u = table(spark, d, "fx_csr_sketch").groupBy("row_id").agg(F.first("cardinality", True).alias("card"), F.first("signature", True).alias("sig"))
    regs = u.select(F.col("row_id").alias("entity"), F.posexplode("sig").alias("reg", "v")).where("v is not null")
    q = P.with_sizes(P.register_pairs(regs), u.withColumnRenamed("row_id", "entity"), "card").withColumn("s", M.similarity(F.col("eq"), 128))
    return q.select("i", "j", r9("s").alias("similarity"), F.round(M.intersection(F.col("s"), F.col("a"), F.col("b")), 6).alias("intersection"))


# ---- counters, neighbour lists, panels, vectors, events ------------------------------------


_OBS = "o as (select distinct obs_id, sample_id, kmer, cnt from fx_kmer_counts where kmer is not null and cnt is not null)"


def _obs(spark, d):
    c = table(spark, d, "fx_kmer_counts").where("kmer is not null and cnt is not null")
    return c.select("obs_id", "sample_id", "kmer", "cnt").distinct()


@query(f"with {_OBS} select sample_id as entity, kmer, cast(sum(cnt) as bigint) as cnt from o group by 1, 2")
def kmer_exact_counts(spark, d):
    return C.counts(_obs(spark, d).withColumnRenamed("sample_id", "entity"), "kmer", "cnt")


@query(f"with {_OBS} select sample_id, cast(kmer % 257 as integer) as cell, cast(sum(case when (kmer // 257) % 2 = 1 then cnt else -cnt end) as bigint) as v from o group by 1, 2")
def kmer_counters(spark, d):
    signed = F.when(F.expr("(kmer div 257) % 2 = 1"), F.col("cnt")).otherwise(-F.col("cnt"))
    rows = _obs(spark, d)
    return rows.groupBy("sample_id", F.expr("cast(kmer % 257 as int)").alias("cell")).agg(F.sum(signed).alias("v"))


@query(f"with {_OBS} select kmer, cast(sum(cnt) as bigint) as cnt from o group by kmer having sum(cnt) >= 3")
def kmer_min_count(spark, d):
    o = _obs(spark, d).withColumn("entity", F.lit(0))
    return FL.min_count(C.counts(o, "kmer", "cnt"), 3).select("kmer", "cnt")


@query("with e as (select row_id, unnest(indices) as nbr, unnest(data) as score from fx_knn) select row_id, nbr, round(max(cast(score as double)), 6) as score from e where nbr <> -1 and nbr <> row_id and score > 0 group by 1, 2")
def knn_edges(spark, d):
    e = F.explode(F.arrays_zip(F.col("indices").alias("n"), F.col("data").alias("s"))).alias("e")
    rows = table(spark, d, "fx_knn").select("row_id", e).select("row_id", F.col("e.n").alias("nbr"), F.col("e.s").cast("double").alias("score"))
    return FL.nonzero(rows.where("nbr <> -1 and nbr <> row_id"), "score").groupBy("row_id", "nbr").agg(F.round(F.max("score"), 6).alias("score"))


_FILE = "f as (select distinct entity_id as entity, coalesce(is_query, false) as is_query, kmers from fx_sketch_file where kmers is not null), g as (select distinct entity, unnest(kmers) as k, is_query from f), t as (select distinct entity, k, is_query from g where k is not null)"


@query(f"with {_FILE}, db as (select entity as ref, k from t where not is_query), n as (select ref, count(*) as n from db group by ref), h as (select t.entity as query, ref, count(*) as hit from t join db on db.k = t.k where is_query group by 1, 2) select query, h.ref, round(hit / cast(n as double), 9) as coverage, 1.0::double as mean_depth from h join n on n.ref = h.ref")
def file_containment(spark, d):
    f = table(spark, d, "fx_sketch_file").select(F.col("entity_id").alias("entity"), F.coalesce("is_query", F.lit(False)).alias("is_query"), F.explode("kmers").alias("k")).where("k is not null")
    db = f.where("not is_query").select(F.col("entity").alias("ref"), "k")
    return N.containment(f.where("is_query").select("entity", "k").distinct(), db, "k", digits=9)


@query("with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select x.vec_id as i, y.vec_id as j, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 9) as score from v x join v y on x.vec_id <> y.vec_id), k as (select *, rank() over (partition by i order by score desc) as rk from s) select i, j, score, cast(rk as integer) as rk from k where rk <= 5")
def embedding_cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), "embedding").repartition(spark.sparkContext.defaultParallelism)
    pairs = v.select(F.col("entity").alias("i")).join(v.select(F.col("entity").alias("j")), F.col("i") < F.col("j"))
    return N.topk(N.both_ways(P.cosine(pairs, v, "embedding").select("i", "j", r9("cosine").alias("score")), "score"), "score", 5)


@query(f"with e as (select user_id as entity, event_type || ':' || cast(extract(hour from ts) as integer) as item, cast(sum(value) as double) as w from events group by 1, 2), x as (select entity, item, w, unnest(range(0, 8)) as reg from e where w > 0), v as (select entity, cast(reg as integer) as reg, item, -ln(({H('item || ' + chr(39) + '|' + chr(39) + ' || reg')} + 1) / 1152921504606846976.0) / w as v from x) select entity, reg, round(min(v), 9) as v, arg_min(item, v) as item from v group by 1, 2")
def user_probminhash(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.concat_ws(":", "event_type", F.hour("ts").cast("string")).alias("item"), "value")
    return S.probminhash(e, "item", "value", 8).select("entity", "reg", r9("v").alias("v"), "item")


@query(f"with e as (select cast(ts as date) as day, {H('cast(user_id as varchar)')} as h from events where user_id is not null) select cast(day as varchar) as day, cast(h % 64 as integer) as reg, min(h) as v from e group by 1, 2")
def daily_user_sketch(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("entity"), "user_id")
    return S.oph(e, "user_id", 64).select(F.col("entity").alias("day"), "reg", "v")


@query(f"with e as (select {H('cast(user_id as varchar)')} as h, cast(ts as date) as day from events where user_id is not null), r as (select day, cast(h % 64 as integer) as reg, min(h) as v from e group by 1, 2) select month(day) as entity, reg, min(v) as v from r group by 1, 2")
def monthly_user_rollup(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("entity"), "user_id")
    daily = S.oph(e, "user_id", 64).select(F.col("entity").alias("day"), F.month("entity").cast("bigint").alias("month"), "reg", "v")
    return S.rollup(daily, "day", "month")


@query("with i as (select p_partkey, p_brand, p_size, p_size + p_partkey % 7 as e from part) select p_brand || ':' || b as item, round(sum(1.0 / (e - p_size)), 9) as weight from (select p_brand, p_size, e, unnest(range(p_size, e)) as b from i where p_size < e) group by 1")
def interval_bases(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("bigint").alias("s"), (F.col("p_size") + F.col("p_partkey") % 7).alias("e"))
    items = K.interval_items(p, "p_partkey", "p_brand", "s", "e", normalize=True)
    return items.groupBy("item").agg(r9(F.sum("weight")).alias("weight"))


@query(f"with l as (select l_orderkey as entity, {H('cast(l_partkey as varchar)')} as h, l_quantity as w from lineitem) select cast(h % 257 as integer) as cell, round(sum(case when (h >> 40) % 2 = 1 then w else -w end), 3) as v from l group by 1")
def lineitem_count_sketch(spark, d):
    l = table(spark, d, "lineitem").select(F.lit(0).alias("entity"), "l_partkey", "l_quantity")
    return C.count_sketch(l, "l_partkey", 257, "l_quantity").select("cell", F.round("v", 3).alias("v"))


@query(f"with b as (select o_custkey as entity, {H('cast(l_partkey as varchar)')} as h from lineitem join orders on o_orderkey = l_orderkey) select entity, cast(h % 16 as integer) as reg, min(h) as v from b group by 1, 2")
def basket_oph(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity")), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.oph(b, "l_partkey", 16)
