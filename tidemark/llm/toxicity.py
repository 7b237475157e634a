"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon (words, and word beginnings of 4 to 6 letters, which stand for inflected or compounded stems)
is learnt from labelled rows by a G-squared test, so it follows the language of the corpus.  The features
are densities of lexicon hits, hits near second-person words, capitals, punctuation and obfuscation.
Spark ML fits the trees and the calibration on at most ``fit_rows`` labelled rows (the bounded sample, those with the
least hashes of their ids), and scores all rows in the JVM.

Edge cases: a null or empty text has all-zero features and gets the score of these; without labels of both kinds
every row gets the smoothed share of toxic labels, (toxic + 0.5) / (labels + 5); repeated labels or rows count as
often as they occur; null ids are never learnt from; very long texts are read whole, in linear time; other columns, whatever their names, aren't read,
and drop_toxic returns them as they were; an empty table gives an empty table.

Calibration is cross-fitted: trees of each half of the sample score the other half, and the isotonic curve is fitted on these scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frozen, labelled

FIT_ROWS = 20_000
MAX_TERMS = 2_000
PREFIXES = (4, 5, 6)
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split())
LETTERS = re.compile(r"[^\W\d_]+")
#: Begins where no letter stands before it, and gives nothing back: linear on any text.
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*#.\-]++[^\W\d_]++(?:[0-9@$!*#.\-]++[^\W\d_]++)*+")
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", ".": "", "-": "", "2": "", "6": "", "8": "", "9": ""})
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
EXCLAIMED = re.compile(r"[!?]")
REPEATED = re.compile(r"[!?]{2,}")
PUNCTUATION = re.compile(r"[^\w\s]")
FEATURES = ("word_hits", "stem_hits", "word_density", "stem_density", "distinct_hits", "addressed", "addressed_density", "second_person", "capitals", "shouted", "exclaimed", "repeated_marks", "punctuation", "masked", "masked_hits")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled rows outside the held-out fifth."""
    picked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
    return labelled(docs, picked, rows, text, doc_id)


def _terms(word: str) -> set[str]:
    """The word itself, marked as whole, and its beginnings."""
    return {"=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)}


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(b["text"], b["label"], strict=True):
            seen[int(label > 0)].update(set().union(*map(_terms, set(LETTERS.findall(text.lower())))))
        yield pd.DataFrame([(t, k, n) for k, c in seen.items() for t, n in c.items()], columns=["term", "label", "n"])


def learn_lexicon(sample: DataFrame, toxic: int, clean: int, least: float = 20.0, max_terms: int = MAX_TERMS) -> list[str]:
    """Terms that toxic rows of the sample hold far more often; ``max_terms`` at most."""
    counts = sample.select("text", "label").mapInPandas(_term_counts, "term string, label int, n long")
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    share = toxic / (toxic + clean)
    gain = lambda x, p: F.when(x > 0, x * F.log(x / ((F.col("a") + F.col("b")) * p))).otherwise(0.0)
    scored = counts.where("a >= 3").withColumn("g", 2 * (gain(F.col("a"), share) + gain(F.col("b"), 1 - share)))
    strong = scored.where((F.col("g") >= least) & (F.col("a") / toxic > 10 * F.col("b") / max(clean, 1)))
    return [r["term"] for r in strong.orderBy(F.desc("g"), "term").limit(max_terms).collect()]


def _dense(text: str, whole: frozenset, stems: frozenset) -> list[float]:
    words = LETTERS.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    hits = [i for i, w in enumerate(words) if w in whole]
    stem_hits = [i for i, w in enumerate(words) if w[:4] in stems or w[:5] in stems or w[:6] in stems]
    either = sorted({*hits, *stem_hits})
    spoken = sum(w in SECOND_PERSON for w in words)
    addressed = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in either)
    masked = [m.lower().translate(UNMASK) for m in MASKED.findall(text)]
    masked_hits = sum(m in whole or any(m[:k] in stems for k in PREFIXES) for m in masked)
    rate = lambda pattern: len(pattern.findall(text)) / chars
    return [
        float(len(hits)), float(len(stem_hits)), len(hits) / n, len(stem_hits) / n, float(len({words[i] for i in either})),
        float(addressed), addressed / n, spoken / n, rate(CAPITALS), len(SHOUTED.findall(text)) / n,
        rate(EXCLAIMED), len(REPEATED.findall(text)) / n, rate(PUNCTUATION), len(masked) / n, float(masked_hits),
    ]


def dense_features(text: Column, lexicon: list[str]) -> Column:
    """Vector of FEATURES; the lexicon is bounded by its maker."""
    whole, stems = frozenset(t[1:] for t in lexicon if t[0] == "="), frozenset(t for t in lexicon if t[0] != "=")

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([_dense(t, whole, stems) for t in texts], dtype=object)

    return array_to_vector(dense(F.coalesce(text, F.lit(""))))


@dataclass
class ToxicityModel:
    lexicon: list[str]
    prior: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(doc, score) of each row of ``docs``, as a struct, between 0 and 1."""
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        if self.trees is None:
            return own.withColumn("score", F.lit(self.prior))
        raw = self.trees.transform(own.withColumn("features", dense_features(F.col("doc")[text], self.lexicon))).withColumn("raw", vector_to_array("probability")[1])
        out = self.calibration.transform(raw.drop("features", "probability", "rawPrediction", "prediction"))
        return out.select("doc", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")).alias("score"))


def _grown(rows: DataFrame):
    """Trees of the rows; None if these have labels of one kind only."""
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=8, seed=7, checkpointInterval=-1, maxMemoryInMB=128).fit(rows)


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).select("label", vector_to_array("probability")[1].alias("raw"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Trees of the whole sample, calibrated on what trees of each half score the other half; if a half has labels of one kind only, so that
    nothing grows from it, the trees of the whole sample score the other half."""
    sample = fit_sample(docs, labels, "toxic", fit_rows, text, doc_id)
    n = {r["t"]: r["count"] for r in sample.groupBy((F.col("label") > 0).alias("t")).count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    prior = (toxic + 0.5) / (toxic + clean + 5)
    if not toxic or not clean:
        return ToxicityModel([], prior)
    lexicon = learn_lexicon(sample, toxic, clean)
    rows = sample.select("doc_id", (F.col("label") > 0).cast("double").alias("label"), dense_features(F.col("text"), lexicon).alias("features"))
    rows = frozen(rows.withColumn("part", F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string"))) % 4), "toxic-features")
    halves = [rows.where("part < 2"), rows.where("part >= 2")]
    ends = [_grown(h) for h in halves]
    trees = _grown(rows)
    raw = _raw(ends[0] or trees, halves[1]).unionByName(_raw(ends[1] or trees, halves[0]))
    calibration = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(raw)
    return ToxicityModel(lexicon, prior, trees, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = fit(docs, labels, **how).score(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc.doc_id"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    return fit(docs, labels, **how).score(docs).where("score < 0.5").select("doc.*")
