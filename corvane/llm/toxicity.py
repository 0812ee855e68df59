"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of a learned lexicon, second-person words near its hits, capitals, punctuation
and obfuscation (digits or signs inside words, stretched and masked letters). The lexicon weighs
words and word beginnings by their log odds in labelled documents; nothing but the text is an input.

The labelled rows (a bounded sample, ``TRAIN_ROWS``) are split by hash: each half weighs the words of the
other half's documents, three quarters train the trees and one calibrates them. Null and empty texts have all-zero features and get a score like any
other. Without labels of both kinds every score is the share of label 1 (0 without labels). Equal
texts get equal scores; all input columns are kept, ``score`` is added.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import arrow_map, unused, utf8
from corvane.session import materialise

#: Most labelled documents that are learned from, and most entries of the lexicon.
TRAIN_ROWS = 20_000
LEXICON_SIZE = 4_000
LEAST_COUNT = 3
LEAST_WEIGHT = 1.5
TREES, DEPTH = 24, 4
REJECT = 0.7
BEGINNINGS = (4, 5, 6)  # ascending
#: Words that a task remembers; then it starts afresh.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRETCHED = re.compile(r"(.)\1\1", re.DOTALL)
_WIDE = re.compile(r"[^\x00-\x7F]")
_CAPITALS = string.ascii_uppercase.encode()
_EDGE = "\"'.,;:!?()[]{}<>|/\\-–—…«»¿¡"
# Signs that stand for letters, and words that address the reader.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
SECOND_PERSON = frozenset(
    """you your yours yourself u ur tu te toi vous votre vos ton du dich dir dein deine ihr euch usted ustedes ti tus""".split()
)
FEATURES = (
    "log_words", "hit_share", "hits", "weight_density", "top_weight", "top_mean", "distinct_hits", "second_share",
    "hits_near_second", "capital_share", "shouted_share", "exclaim_rate", "question_rate", "sign_rate", "digit_in_word",
    "stretched", "masked", "disguised_hits", "word_length", "repetition",
)
NEAR = 5


def plain_word(word: str) -> str:
    """A word without outer signs, lower-cased, signs read as letters, stretched letters shortened."""
    word = word.strip(_EDGE).lower()
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_DISGUISE).replace("*", "").replace(".", "").replace("-", "").replace("_", "")
    return word


def terms_of(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in BEGINNINGS if len(word) > n]


def word_weight(word: str, lexicon: dict[str, float]) -> float:
    own = lexicon.get(word)
    if own is not None:
        return own
    most = None
    for n in BEGINNINGS:
        if len(word) <= n:
            break
        own = lexicon.get(word[:n] + "~", 0.0)
        if most is None or own > most:
            most = own
    return most or 0.0


def word_facts(word: str, lexicon: dict[str, float]) -> tuple | None:
    """What ``features`` takes of a word: (weight, disguised, second person, masked, mixed, shouted, stretched).

    None where all of them are nothing, as for most words.
    """
    plain = plain_word(word)
    weight = word_weight(plain, lexicon)
    disguised = masked = mixed = shouted = stretched = False
    if not word.isalpha():
        core = word.strip(_EDGE)
        disguised = bool(weight) and not core.isalpha()
        masked = "*" in core and not core.isalnum()
        mixed = any(map(str.isdigit, core)) and any(map(str.isalpha, core))
    if len(word) > 2:
        shouted = word.isupper()
        stretched = _STRETCHED.search(word) is not None
    facts = (weight, disguised, plain in SECOND_PERSON, masked, mixed, shouted, stretched)
    return facts if any(facts) else None


def capitals(text: str) -> int:
    """The code points that are upper-case letters."""
    raw = utf8(text)
    n = len(raw) - len(raw.translate(None, _CAPITALS))
    return n if text.isascii() else n + sum(map(str.isupper, _WIDE.findall(text)))


def features(text: str | None, lexicon: dict[str, float], remembered: dict[str, tuple | None]) -> list[float]:
    """The values of ``FEATURES`` for the whole text; ``remembered`` holds the ``word_facts`` of this lexicon."""
    words = _WORD.findall(text or "")
    if not words:
        return [0.0] * len(FEATURES)
    n, counts = len(words), Counter(words)
    hits = weight = disguised = second = shouted = mixed = stretched = masked = 0.0
    tops, hit_words, second_words = [], set(), set()
    for word, times in counts.items():
        facts = remembered.get(word, word)
        if facts is word:
            facts = word_facts(word, lexicon)
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            if len(word) <= 64:
                remembered[word] = facts
        if facts is None:
            continue
        own, is_disguised, is_second, is_masked, is_mixed, is_shouted, is_stretched = facts
        if own:
            hits += times
            weight += times * own
            tops.append(own)
            hit_words.add(word)
            disguised += times * is_disguised
        if is_second:
            second += times
            second_words.add(word)
        masked += times * is_masked
        mixed += times * is_mixed
        shouted += times * is_shouted
        stretched += times * is_stretched
    near = 0
    if hits and second:
        spots = [(i, w in hit_words) for i, w in enumerate(words) if w in hit_words or w in second_words]
        for (i, a), (j, b) in zip(spots, spots[1:]):
            near += a != b and j - i <= NEAR
    tops.sort(reverse=True)
    letters = capitals(text)
    size = len(text)
    return [
        math.log1p(n), hits / n, hits, weight / n, tops[0] if tops else 0.0, sum(tops[:5]) / 5, float(len(hit_words)), second / n,
        float(near), letters / size, shouted / n, text.count("!") / n, text.count("?") / n,
        sum(text.count(c) for c in ".,;:") / n, mixed / n, stretched / n, masked / n, disguised, size / n, len(counts) / n,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the lexicon, the trees and the calibration, or one constant score."""

    lexicon: dict[str, float]
    trees: object = None
    calibration: object = None
    constant: float = 0.0


def with_features(docs: DataFrame, lexicon: dict[str, float], name: str = "_features") -> DataFrame:
    """``docs`` plus ``name`` (array of double)."""
    own = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in own]
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        remembered: dict[str, tuple | None] = {}
        for batch in batches:
            values = [features(t, held.value, remembered) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], [*names, name])

    return arrow_map(docs.select(*names), run, T.StructType([*own, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of words and word beginnings ("abcd~") from (text, label); counted by partial aggregates."""
    sums = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    positive, total = int(sums[0] or 0), int(sums[1])

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            toxic: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own = {t for w in set(_WORD.findall(text or "")) for t in terms_of(plain_word(w)) if 1 < len(t) <= 40}
                seen.update(own)
                if label:
                    toxic.update(own)
            arrays = [pa.array(list(seen), pa.string()), pa.array([toxic[t] for t in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "toxic", "seen"])

    counts = arrow_map(rows.select("text", "label"), count, "term string, toxic bigint, seen bigint")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))
    share = lambda part, whole: F.log((part + 0.5) / F.lit(whole + 1.0))
    weight = share(F.col("toxic"), positive) - share(F.col("seen") - F.col("toxic"), total - positive)
    found = counts.select("term", "toxic", weight.alias("weight"))
    found = found.where((F.col("toxic") >= LEAST_COUNT) & (F.col("weight") >= LEAST_WEIGHT))
    top = found.orderBy((F.col("weight") * F.sqrt("toxic")).desc(), "term").limit(LEXICON_SIZE).collect()
    return {r["term"]: r["weight"] for r in top}


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 7) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Of more than ``train_rows`` labelled ids, those with the smallest hash are taken; the sample is the
    one thing here that is bounded, and it is small enough to meet the texts by a broadcast.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    total = known.count()
    mark = F.xxhash64(F.lit(seed), "doc_id")
    if total > train_rows:
        share = min(1.0, 1.2 * train_rows / total)
        known = known.where(F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    known = known.orderBy(mark).limit(train_rows).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(100)))
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label", "_part"), "labelled")
    sums = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    constant = float(sums[0] or 0) / max(1, sums[1])
    if constant in (0.0, 1.0):
        return ToxicityModel({}, constant=constant)
    # Words weigh by the other half of the sample: a document never sees a lexicon learned from it.
    halves = [sample.where("_part % 2 = 0"), sample.where("_part % 2 = 1")]
    first, second = (learn_lexicon(half) for half in halves)
    rows = with_features(halves[0], second).unionByName(with_features(halves[1], first))
    rows = materialise(rows.select("_part", F.col("label").cast("double").alias("label"), "_features"), "features")
    rows = rows.withColumn("features", array_to_vector("_features"))
    train, hold = rows.where("_part < 75"), rows.where("_part >= 75")
    lexicon = learn_lexicon(sample)
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return ToxicityModel(lexicon, constant=constant)
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(train)
    raw = trees.transform(hold).select("label", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw) if hold.agg(F.countDistinct("label")).first()[0] == 2 else None
    return ToxicityModel(lexicon, trees, curve, constant)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` plus ``score`` between 0 and 1. A map; nothing is shuffled."""
    names = [c for c in docs.columns if c != "score"]
    if model.trees is None:
        return docs.select(*names, F.lit(model.constant).alias("score"))
    listed, vector, label, p, r, raw, curved = (unused(names, c) for c in ("_features", "_vector", "_label", "_p", "_r", "_raw", "_curved"))
    rows = with_features(docs, model.lexicon, listed).withColumn(vector, array_to_vector(listed))
    trees = model.trees.copy().setFeaturesCol(vector).setPredictionCol(label).setProbabilityCol(p).setRawPredictionCol(r)
    rows = trees.transform(rows).withColumn(raw, vector_to_array(p)[1])
    score = F.col(raw)
    if model.calibration is not None:
        rows = model.calibration.copy().setFeaturesCol(raw).setPredictionCol(curved).transform(rows)
        # The curve has steps; the trees order documents within one.
        score = 0.999 * F.col(curved) + 0.001 * F.col(raw)
    return rows.select(*names, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
