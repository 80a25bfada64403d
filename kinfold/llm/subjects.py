"""Subjects of documents by mined class-association rules.

1. Fit, on a bounded sample of labelled documents: the running text is read from the
   markup; word sequences of up to four words that are far more frequent under some subject
   than overall become items; every run of up to six items of a sentence is a transaction,
   with the document's subjects; parallel frequent-pattern growth mines the rules {items} ->
   subject. A rule with two items that is hardly surer than a rule with one of them is
   redundant and pruned. Confidences are smoothed towards the subjects' priors.
2. Score, all documents in one pass over their whole texts: the mentions of a document are
   the longest items it contains, each with the evidence of its best matching rule. The
   subjects' shares are the mixture under which this evidence is most likely, which settles
   words that belong to several subjects by the rest of the document.
3. A subject is given where its share reaches a threshold near one sixth, calibrated on the
   labelled sample.

Documents are read in the language that their function words tell, since the stated one
may be missing or wrong.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .markup import running_text, words

#: A few function words of each language.
FUNCTION_WORDS = {
    "en": "the of and is in we with for that to",
    "de": "der die das und ist von mit wir den für eine nicht",
    "fr": "le la les des et est une dans pour nous du sur",
    "es": "el la los las de y es una para en que del con",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LONGEST = 4  # words of an item
_RUN = 6  # items of a transaction, in mining and in scoring alike
_FEW, _OFTEN = 4.0, 3  # in a class of fewer labelled documents, repetition within one counts


def language(sentences: list[list[str]]) -> str:
    """The language whose function words are most frequent; English if there are none."""
    count = Counter(chain.from_iterable(sentences))
    used = {k: sum(count.get(w, 0) for w in v) for k, v in _FUNCTION.items()}
    best = max(used, key=used.get)
    return best if used[best] else "en"


def parsed(text: str | None) -> tuple[str, list[list[str]]]:
    sentences = [w for s in running_text(text).split("\n") if (w := words(s))]
    return language(sentences), sentences


def normal_subject(col):
    """A subject's spelling without case, outer blanks and the choice of separator."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_\-]+", "_")


@dataclass
class SubjectModel:
    subjects: list[str]
    prior: np.ndarray
    single: dict[str, dict[tuple[str, ...], np.ndarray]] = field(default_factory=dict)
    double: dict[str, dict[tuple, np.ndarray]] = field(default_factory=dict)
    threshold: float = 1 / 6
    density: float = 0.1

    def __post_init__(self) -> None:
        self.rules = {k: _Rules(d, self.double.get(k, {}), self.prior) for k, d in self.single.items()}

    def shares(self, text: str | None) -> np.ndarray:
        return self.shares_of(*parsed(text))

    def shares_of(self, lang: str, sentences: list[list[str]]) -> np.ndarray:
        """The share of each subject among a text's mentions; zeros where mentions are
        rarer than ``density`` a sentence."""
        none = np.zeros(len(self.subjects))
        rules = self.rules.get(lang)
        if not rules or not sentences:
            return none
        rows: list[int] = []
        best, partners = rules.best, rules.partners
        for s in sentences:
            found = munch(s, rules.rows, rules.starts)
            sure = list(found)
            for i, x in enumerate(found):
                if x in partners:
                    mine = partners[x]
                    for j in range(i + 1, min(i - i % _RUN + _RUN, len(found))):
                        if (p := mine.get(found[j])) is not None:
                            sure[i] = p if best[p] > best[sure[i]] else sure[i]
                            sure[j] = p if best[p] > best[sure[j]] else sure[j]
            rows += sure
        if len(rows) < self.density * sum(len(s) > 3 for s in sentences) or not rows:
            return none
        odds = rules.odds[rows]
        share = np.full(len(none), 1 / len(none))
        for _ in range(15):
            share = share * ((1 / (odds @ share)) @ odds) / len(rows)
        return share


class _Rules:
    """A language's rules as rows of one matrix, first those of single items.

    ``rows`` numbers the items and ``starts`` has the lengths of those that begin with a
    word, ``partners`` the rows of an item's rules with another one, ``odds`` the rules'
    evidence against the priors, and ``best`` how sure each is."""

    def __init__(self, single: dict, double: dict, prior: np.ndarray) -> None:
        self.rows = {g: i for i, g in enumerate(single)}
        self.starts = starts(single)
        self.partners: dict[int, dict[int, int]] = {}
        for r, (a, b) in enumerate(double, len(single)):
            self.partners.setdefault(self.rows[a], {})[self.rows[b]] = r
            self.partners.setdefault(self.rows[b], {})[self.rows[a]] = r
        p = np.array([*single.values(), *double.values()])
        self.odds, self.best = p / prior, p.max(axis=1).tolist()


def starts(items) -> dict[str, list[int]]:
    """By first word, the lengths of the items that begin with it, the longest first."""
    found: dict[str, set[int]] = {}
    for g in items:
        found.setdefault(g[0], set()).add(len(g))
    return {w: sorted(n, reverse=True) for w, n in found.items()}


def munch(sentence: list[str], items: dict, starts: dict[str, list[int]]) -> list:
    """What ``items`` has for the items of a sentence, left to right, the longest first at
    each place."""
    found, after = [], 0
    for at, w in enumerate(sentence):
        if w in starts and at >= after:
            for n in starts[w]:
                if at + n <= len(sentence) and (x := items.get(tuple(sentence[at : at + n]))) is not None:
                    found.append(x)
                    after = at + n
                    break
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """``[doc_id, text, classes]`` of at most ``sample`` labelled documents, chosen by a
    hash of their id, and the subjects as spelled in answers. Labels of no known subject
    are left out, repeated ones count once. The chosen ids, at most ``sample``, go to the
    documents, so that no other text is shuffled or sorted."""
    names = [r[0] for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    known = subjects.where("subject is not null").select(normal_subject(F.col("subject")).alias("key"), F.col("subject").alias("s")).dropDuplicates(["key"])
    pairs = labels.where("doc_id is not null").select("doc_id", normal_subject(F.col("subject")).alias("key")).join(known, "key")
    chosen = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("classes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return texts, names


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = 20_000) -> SubjectModel:
    """Rules and threshold from at most ``sample`` labelled documents; this bound of the
    sample is the only one, and it bounds the items and rules that are found in it.

    An item needs two documents. In a subject with fewer than four labelled documents a
    word sequence that one of them repeats counts for more, by the logarithm of its number,
    so that a subject with a single labelled document has items as well."""
    spark = docs.sparkSession
    texts, names = labelled_sample(docs, labels, subjects, sample)
    size = len(names)
    place = {s: i for i, s in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parsed(t) for t in b.column(1).to_pylist()]
            text = ["\n".join(" ".join(s) for s in g[1]) for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(text, pa.string()), b.column(2)], ["doc_id", "lang", "words", "classes"])

    read_docs = cut(texts.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(read, "doc_id bigint, lang string, words string, classes array<string>"))
    weight = F.lit(1.0) / F.size("classes")
    masses = read_docs.select(F.explode("classes").alias("c"), weight.alias("w")).groupBy("c").agg(F.sum("w").alias("w")).collect()
    prior = np.zeros(size)
    for r in masses:
        prior[place[r["c"]]] = r["w"]
    few = {i for i in range(size) if 0 < prior[i] < _FEW}
    if not prior.sum():
        return SubjectModel(names, np.full(size, 1 / max(size, 1)))
    prior = (prior + 0.5) / (prior + 0.5).sum()
    # words in over two fifths of a language's documents begin and end no item; there are at
    # most two and a half times as many of them as a document has words
    docs_in = read_docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    used = read_docs.select("lang", F.explode(F.array_distinct(F.split("words", r"\s+"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c"))
    stop: dict[str, set[str]] = {}
    for r in used.join(docs_in, "lang").where(F.col("c") > F.greatest(0.4 * F.col("n"), F.lit(3.0))).select("lang", "w").collect():
        stop.setdefault(r["lang"], set()).add(r["w"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, gram, cls, w = [], [], [], []
            for _, k, text, classes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                no, seen = stop.get(k, set()), Counter()
                for line in text.split("\n"):
                    s = line.split(" ")
                    for at in range(len(s)):
                        if s[at] not in no:
                            for n in range(1, min(_LONGEST, len(s) - at) + 1):
                                if s[at + n - 1] not in no:
                                    seen[" ".join(s[at : at + n])] += 1
                for g, often in seen.items():
                    for c in classes:
                        lang.append(k)
                        gram.append(g)
                        cls.append(place[c])
                        w.append((1 + math.log(often) if often >= _OFTEN and place[c] in few else 1) / len(classes))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(cls, pa.int32()), pa.array(w, pa.float64())], ["lang", "g", "c", "w"])

    seen = read_docs.mapInArrow(grams, "lang string, g string, c int, w double")
    each = [F.sum(F.when(F.col("c") == i, F.col("w")).otherwise(0.0)).alias(f"c{i}") for i in range(size)]
    stats = seen.groupBy("lang", "g").agg(F.sum("w").alias("n"), *each).where(F.col("n") >= 1.99)
    z = F.greatest(*[(F.col(f"c{i}") - F.col("n") * float(p)) / F.sqrt(F.col("n") * float(p * (1 - p))) for i, p in enumerate(prior)], F.lit(0.0))
    lift = F.greatest(*[F.col(f"c{i}") / F.col("n") / float(p) for i, p in enumerate(prior)], F.lit(0.0))
    kept = stats.select("lang", "g", z.alias("z"), lift.alias("l")).where("z >= 3 and l >= 2").select("lang", "g").collect()
    items: dict[str, dict[tuple[str, ...], str]] = {}
    for r in kept:
        items.setdefault(r["lang"], {})[tuple(r["g"].split(" "))] = f"{r['lang']}\t{r['g']}"
    if not items:
        return SubjectModel(names, prior)
    first = {k: starts(v) for k, v in items.items()}

    def transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, k, text, classes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tags = [f"\t{place[c]}" for c in classes]
                for line in text.split("\n"):
                    found = munch(line.split(" "), items.get(k, {}), first.get(k, {}))
                    for at in range(0, len(found), _RUN):
                        out.append(sorted(set(found[at : at + _RUN])) + tags)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])

    baskets = cut(read_docs.mapInArrow(transactions, "items array<string>"))
    n = baskets.count()
    if not n:
        return SubjectModel(names, prior)
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, 1.5 / n), minConfidence=0.0).fit(baskets).freqItemsets
    is_tag = lambda x: x.startswith("\t")
    tags, terms = F.filter("items", is_tag), F.filter("items", lambda x: ~x.startswith("\t"))
    rules = mined.where((F.size(tags) == 1) & F.size(terms).between(1, 2)).select(F.array_sort(terms).alias("a"), F.element_at(tags, 1).alias("c"), "freq")
    found = rules.groupBy("a").agg(F.collect_list(F.struct("c", "freq")).alias("f"), F.sum("freq").alias("n")).where((F.size("a") == 1) | (F.col("n") >= 5))
    counts: dict[tuple[str, ...], np.ndarray] = {}
    for r in found.select("a", "f").collect():
        v = counts[tuple(r["a"])] = np.zeros(size)
        for c, freq in r["f"]:
            v[int(c[1:])] = freq
    single: dict[str, dict] = {}
    double: dict[str, dict] = {}
    sure: dict[str, float] = {}
    for a, v in counts.items():
        if len(a) == 1:
            k, g = a[0].split("\t")
            p = single.setdefault(k, {})[tuple(g.split(" "))] = (v + prior) / (v.sum() + 1)
            sure[a[0]] = p.max()
    for a, v in counts.items():
        if len(a) == 2:
            p = (v + prior) / (v.sum() + 1)
            if p.max() > max(sure.get(x, 1.0) for x in a) + 0.05:  # else redundant
                k = a[0].split("\t")[0]
                double.setdefault(k, {})[tuple(sorted(tuple(x.split("\t")[1].split(" ")) for x in a))] = p
    model = SubjectModel(names, prior, single, double)
    model.threshold = _calibrated(read_docs, model, place)
    return model


def _calibrated(read_docs: DataFrame, model: SubjectModel, place: dict[str, int]) -> float:
    """The threshold nearest to one sixth whose F1 on the labelled sample is within 0.003
    of the best between 0.1 and 0.25."""
    shared = read_docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            s = [shared.value.shares_of(k, [x.split(" ") for x in t.split("\n")] if t else []).tolist() for k, t in text]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.list_(pa.float64())), b.column(2)], ["s", "classes"])

    scored = read_docs.select("lang", "words", "classes").repartition(2 * read_docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "s array<double>, classes array<string>")
    grid = [round(0.1 + 0.01 * i, 2) for i in range(16)]
    known = F.create_map(*[x for s, i in place.items() for x in (F.lit(s), F.lit(i))])
    one = scored.select(F.posexplode("s").alias("i", "p"), F.transform("classes", lambda c: known[c]).alias("y"))
    one = one.select("p", F.array_contains("y", F.col("i")).alias("hit"))
    cells = one.agg(
        F.sum(F.col("hit").cast("int")).alias("pos"),
        *[F.sum((F.col("hit") & (F.col("p") >= t)).cast("int")).alias(f"t{i}") for i, t in enumerate(grid)],
        *[F.sum((F.col("p") >= t).cast("int")).alias(f"a{i}") for i, t in enumerate(grid)],
    ).first()
    if not cells["pos"]:
        return 1 / 6
    f1 = [2 * (cells[f"t{i}"] or 0) / ((cells[f"a{i}"] or 0) + cells["pos"]) for i in range(len(grid))]
    return min((t for t, f in zip(grid, f1, strict=True) if f >= max(f1) - 0.003), key=lambda t: abs(t - 1 / 6))


def document_subjects(docs: DataFrame, model: SubjectModel) -> DataFrame:
    """``[doc_id, subject]`` for every subject whose share reaches the model's threshold.

    A null, empty or blank text, one without running text and one about none of the
    subjects give no row; a repeated document gives its rows once; other columns than
    doc_id and text are not read. The model is broadcast; its size is bounded by the
    labelled sample it was fitted on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, found = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for c in np.flatnonzero(m.shares(t) >= m.threshold):
                        ids.append(i)
                        found.append(m.subjects[c])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["doc_id", "subject"])

    src = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return src.mapInArrow(run, "doc_id bigint, subject string").distinct()
