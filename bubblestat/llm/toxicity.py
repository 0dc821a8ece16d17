"""Toxicity: a sparse logistic classifier, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from xxhash import xxh3_64_intdigest

from .common import cut, forget

#: Terms that name groups; terms of a line replace each other in counterfactual sentences.
IDENTITY_TERMS = [
    "women men woman man girls boys girl boy female male transgender nonbinary",
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "black white asian latino african european arab indian chinese mexican",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "immigrants refugees citizens foreigners natives migrants",
    "disabled blind deaf autistic elderly young",
    "femmes hommes musulmans chrétiens juifs noirs blancs arabes immigrés homosexuels",
    "frauen männer muslime christen juden schwarze weiße araber ausländer homosexuelle",
    "mujeres hombres musulmanes cristianos judíos negros blancos árabes inmigrantes homosexuales",
]
_SWAP = {a: b for line in IDENTITY_TERMS for ts in [line.split()] for a, b in zip(ts, ts[1:] + ts[:1], strict=True)}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
#: Lengths of the beginnings of words that are features beside whole words, so that unseen endings don't hide a stem.
STEMS = (3, 4, 5, 6)


def features(text: str | None) -> set[str]:
    return _own(set(_WORD.findall((text or "").lower())))


def _own(words: set[str]) -> set[str]:
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def swapped(text: str | None, swap: dict[str, str] = _SWAP) -> list[str]:
    """Counterfactuals of a text: for each term of swap in it the text with that term replaced by the one that stands for it, and nothing else."""
    terms = sorted({w for w in _WORD.findall((text or "").lower()) if w in swap})
    return [_WORD.sub(lambda m, a=a: swap[a] if m[0].lower() == a else m[0], text) for a in terms]


def _changes(words: set[str], swap: dict[str, str], at: dict[str, int]) -> Iterator[dict[int, float]]:
    """For each term of swap among a text's words: 1 at features that go, and -1 at those that come, when it is swapped alone."""
    terms = sorted(words & swap.keys())
    counts = Counter(f for w in words for f in _own({w}) if f in at) if terms else {}
    for a in terms:
        before, after = _own({a}), _own({swap[a]})
        yield {at[f]: 1.0 for f in before - after if f in at and counts[f] == 1} | {at[f]: -1.0 for f in after - before if f in at and not counts[f]}


@dataclass(frozen=True)
class Model:
    """pairs: counterfactual pairs that taught it; swap: the terms swapped in them."""

    bias: float
    weights: dict[str, float]
    pairs: int = 0
    swap: dict[str, str] = field(default_factory=dict)

    def score(self, texts: pd.Series) -> np.ndarray:
        weights, starts = self.weights, {w[:3] for w in self.weights}
        logits = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            near = {w for w in set(_WORD.findall((t or "").lower())) if w[:3] in starts or len(w) < 3}
            if near:
                own = near | {f"{w[:k]}*" for w in near for k in STEMS if len(w) > k}
                logits[i] += sum(sorted(weights[f] for f in own if f in weights))
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _masked(sentence: str) -> list[tuple[int, str]]:
    """(hash, word) for each word of a sentence of four and more: the hash of all its other words and of the place left open."""
    words = _WORD.findall(sentence)
    if len(words) < 4:
        return []
    return [(xxh3_64_intdigest(" ".join([*words[:k], "_", *words[k + 1 :]])) - (1 << 63), w) for k, w in enumerate(words)]


def _rings(texts: DataFrame, least: int, max_terms: int) -> dict[str, str]:
    """Which word replaces which: words that alternate in sentences otherwise equal, of texts that aren't toxic, in a ring.

    A word joins the open sentence that most words share; a ring counts if two or more of its words alternate in `least` sentences. Only words of rings, at most max_terms, reach the driver."""

    def open_sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                rows = {r for t in b["text"][i : i + 64] for s in _SENTENCE.findall((t or "").lower()) for r in _masked(s)}
                yield pd.DataFrame(sorted(rows), columns=["slot", "word"])

    held = texts.where("toxic = 0").select("text").mapInPandas(open_sentences, "slot long, word string").distinct()
    shared = held.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    some = cut(held.join(shared, "slot"), "toxic")
    best = some.groupBy("word").agg(F.max(F.struct("n", "slot")).alias("b"), F.count("*").alias("slots")).where(F.col("slots") >= least).select("word", F.col("b.slot").alias("ring"))
    proved = some.join(best, "word").groupBy("ring", "slot").agg(F.count("*").alias("n")).where("n > 1").groupBy("ring").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rings: dict[int, list[str]] = {}
    for r in best.join(proved, "ring").orderBy(F.desc("n"), "ring", "word").limit(max_terms).collect():
        rings.setdefault(r["ring"], []).append(r["word"])
    forget(some)
    return {a: b for ring in rings.values() if len(ring) > 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 16_000, max_features: int = 800, min_gain: float = 30.0, least: int = 5, max_terms: int = 400, fairness: float = 10.0, ridge: float = 2e-4) -> Model:
    """A model from at most max_rows labelled texts that are not held out, the first by a hash of doc_id.

    Only that bounded sample is broadcast, joined and fitted; of rows that share a doc_id, the text of the least hash teaches. Features are words and
    beginnings of words that toxic texts hold more often, by likelihood ratio (min_gain and up, at most max_features, ties by name); a text has each or
    not, and its length doesn't count. The fit minimises log loss, a ridge, and `fairness` times the mean squared change of the logit when terms of
    a labelled text are swapped, one at a time: identity terms of the fixed list, and words (at most max_terms) that alternate in `least` and more sentences otherwise
    equal of texts that aren't toxic, as names of groups do that the list doesn't know. So a neutral mention can't carry weight
    that its replacement doesn't, be it by a beginning that it shares with a toxic word. A corpus without such words teaches no pair, and the fit is a plain one. Labels other
    than 0 and 1 are left out. With one class or none the score is a constant. Null texts teach as empty ones; texts of any length are taken whole, one at a time.
    """
    taught = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = taught.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = cut(sample, "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = cut(texts.select("toxic", "text"), "toxic")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b[i : i + 64]
                found = [(f, y) for t, y in zip(part["text"], part["toxic"], strict=True) for f in features(t)]
                yield pd.DataFrame(found, columns=["f", "y"])

    p_all, n_all = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not p_all or not n_all:
        return Model(float(np.log((p_all + 0.5) / (n_all + 0.5))) if p_all or n_all else -3.0, {})
    counts = texts.mapInPandas(listed, "f string, y int").groupBy("f").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    part = lambda x, row, column: F.when(x > 0, x * F.log(x * (p_all + n_all) / (row * column))).otherwise(0.0)
    p, n = F.col("p"), F.col("n")
    gain = 2 * (part(p, p + n, F.lit(p_all)) + part(n, p + n, F.lit(n_all)) + part(p_all - p, p_all + n_all - p - n, F.lit(p_all)) + part(n_all - n, p_all + n_all - p - n, F.lit(n_all)))
    rated = cut(counts.where("p >= 3").select("f", "p", "n", gain.alias("gain")), "toxic")
    leaning = rated.where((p * n_all > n * p_all) & (F.col("gain") >= min_gain))
    names = [r["f"] for r in leaning.orderBy(F.desc("gain"), "f").limit(max_features).collect()]
    swap = _rings(texts, least, max_terms) | _SWAP
    names += sorted({*swap} - {*names})
    at = {f: i for i, f in enumerate(names)}

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["toxic"], "own": [sorted(at[f] for f in features(t) if f in at) for t in b["text"]]})

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(at), len(at))), 0
        for b in batches:
            for t in b["text"]:
                for d in _changes(set(_WORD.findall((t or "").lower())), swap, at):
                    n += 1
                    if d:
                        i, v = np.fromiter(d.keys(), int, len(d)), np.fromiter(d.values(), float, len(d))
                        total[np.ix_(i, i)] += np.outer(v, v)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": [-1, *i], "j": [-1, *j], "v": [float(n), *total[i, j]]})

    rows = texts.mapInPandas(indexed, "y int, own array<int>").collect()  # max_rows short lists at most
    rows.sort(key=lambda r: (r["y"], r["own"]))
    x, y = np.zeros((len(rows), len(names)), np.float32), np.array([r["y"] for r in rows], np.float32)
    for i, r in enumerate(rows):
        x[i, r["own"]] = 1
    moved, pairs = np.zeros((len(names), len(names))), 0
    for i, j, v in texts.mapInPandas(changes, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).toLocalIterator():  # at most the square of the features
        if i < 0:
            pairs = int(v)
        else:
            moved[i, j] = v
    for table in (sample, texts, rated):
        forget(table)
    weights, bias = _minimise(x, y, moved, fairness / max(pairs, 1), ridge)
    return Model(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, pairs, swap)


def _minimise(x: np.ndarray, y: np.ndarray, moved: np.ndarray, fairness: float, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent with Adam's step sizes; the bias bears no penalty. moved: the sum over counterfactuals of the outer product of what changes in a text's features."""
    n, k = x.shape
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for step in range(1, steps + 1):
        z = x @ w[:k].astype(np.float32) + np.float32(w[k])
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(x.T @ e / n + 2 * ridge * w[:k], e.mean())
        g[:k] += 2 * fairness * (moved @ w[:k])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (0.01 ** (step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:k], float(w[k])


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs' rows as (doc_id, held_out, score, predicted); the text, whole, is all that a score depends on.

    Null and empty texts have the score of a text without features. A null doc_id is not held out. Repeated rows stay; other columns are ignored; texts of any length are taken whole. Empty table: empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
