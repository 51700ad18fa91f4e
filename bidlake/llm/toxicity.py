"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.session import cut, unused

#: Labelled rows that the models are fitted on at most, those with the smallest hashes; everything else covers all rows.
SAMPLE = 20_000
#: Learned entries of the lexicon at most, toxic documents that one must be in, and odds that it must raise.
ENTRIES, LEAST, ODDS = 400, 4, 10.0
#: Words between a second person and an insult that still count as near.
NEAR = 5
#: From this score on a text is toxic.
THRESHOLD = 0.7

# Common insults to begin with, and words of the second person.
SEED = frozenset(
    """
    idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown fool jerk ugly filthy vermin
    dumm idiotin trottel depp abschaum ekelhaft versager widerlich
    imbécile stupide crétin ordure dégoûtant minable débile
    idiota estúpido estúpida imbécil basura asqueroso inútil escoria
    """.split()
)
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
LEET = str.maketrans("013457@$!|+", "oieastasilt")
STRIP = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*#%&$"

FEATURES = (
    "log_words", "seed_hits", "seed_density", "learned_hits", "learned_density", "distinct_hits", "hidden_hits", "near_second",
    "second_density", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "digits", "obfuscated", "repeated",
)
SEEDED, LEARNED, SECOND_PERSON, SHOUTED, OBFUSCATED, HIDDEN, REPEATED = (1 << i for i in range(7))
_mixed = re.compile(r"[^\W\d_][\d@$!|+*]+[^\W\d_]").search
_repeated = re.compile(r"(\w)\1\1").search
_PUNCT = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])


def terms(word: str) -> list[str]:
    """What of a word can be an entry of the learned lexicon: the whole, marked, and its stems of 4 to 6 letters."""
    return [f"{word}$", *(word[:n] for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


class Words(dict):
    """What each word is, as bits; remembers a bounded number of words."""

    def __init__(self, learned: frozenset[str]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = token.strip(STRIP)
        word = bare.lower()
        bits = SEEDED * (word in SEED) | SECOND_PERSON * (word in SECOND) | LEARNED * any(t in self.learned for t in terms(word))
        bits |= SHOUTED * (len(bare) > 2 and bare.isupper()) | REPEATED * bool(_repeated(word))
        if _mixed(word) or (len(word) > 4 and word[1::2] == word[1] * (len(word) // 2) and not word[1].isalnum()):
            plain = "".join(c for c in word.translate(LEET) if c.isalpha())
            bits |= OBFUSCATED | HIDDEN * (not bits & (SEEDED | LEARNED) and (plain in SEED or any(t in self.learned for t in terms(plain))))
        self[token] = bits
        return bits


def features(text: str, words: Words) -> list[float]:
    """FEATURES of one text; an empty one has zeros."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    bits = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
    have = [int(np.count_nonzero(bits & b)) for b in (SEEDED, LEARNED, SECOND_PERSON, SHOUTED, OBFUSCATED, HIDDEN, REPEATED)]
    hit = np.flatnonzero(bits & (SEEDED | LEARNED | HIDDEN))
    second = np.flatnonzero(bits & SECOND_PERSON)
    near = 0
    if len(hit) and len(second):
        after = np.searchsorted(second, hit)
        gaps = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - hit), np.abs(second[np.maximum(after - 1, 0)] - hit))
        near = int(np.count_nonzero(gaps <= NEAR))
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    capitals, letters = int(counts[65:91].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    size = len(data)
    return [
        math.log1p(n), have[0], have[0] / n, have[1], have[1] / n, len({tokens[i].strip(STRIP).lower() for i in hit}), have[5], near / max(1, len(hit)),
        have[2] / n, capitals / max(1, letters), have[3] / n, counts[33] / size, counts[63] / size, counts[_PUNCT].sum() / size, counts[48:58].sum() / size, have[4] / n, have[6] / n,
    ]


def with_features(docs: DataFrame, text_col: str, learned: list[str], out: str = "_features") -> DataFrame:
    """Add FEATURES of every whole text; null texts as empty ones."""
    entries = frozenset(learned)
    kept = docs.columns
    place = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(entries)
        for batch in batches:
            rows = [features(x.as_py() or "", words) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*kept, out])

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _counted(texts: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, n): the number of texts with each term, of ``wanted`` or all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                found = {t for word in {w.strip(STRIP).lower() for w in (text.as_py() or "").split()} for t in terms(word)}
                seen.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    return texts.mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Entries that toxic texts of (text, label) have far more often than others; at most ENTRIES, from a bounded sample, of which the 20,000 most frequent terms are looked at."""
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    least = max(LEAST, math.ceil(toxic / 500))
    often = _counted(sample.filter("label = 1").select("text"), None).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(20_000).collect()
    counts = {row["term"]: row["n"] for row in often}
    others = {row["term"]: row["n"] for row in _counted(sample.filter("label = 0").select("text"), frozenset(counts)).collect()} if counts else {}
    odds = {t: (n + 0.5) / (toxic + 1) / ((others.get(t, 0) + 0.5) / (clean + 1)) for t, n in counts.items()}
    return sorted((t for t in odds if odds[t] >= ODDS), key=lambda t: (-counts[t] * math.log(odds[t]), t))[:ENTRIES]


def fold(id_col: str) -> F.Column:
    """crc32 of the id's text modulo 3; rows of fold 1 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row of ``docs``.

    Fitted on at most ``sample`` labelled rows outside of fold 1: lexicon and trees on three quarters of them, the
    isotonic calibration on the rest. Only the text goes into a score, and null and empty texts are scored like any other. An id with several labels counts as
    toxic if one says so; null labels don't count. Where there aren't rows of both classes in both parts, the
    score is 1 - exp(-20 * density of the seed lexicon). A null id isn't held out. Clashing columns are replaced.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    docs = docs.select(*kept)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    mixed = F.xxhash64(id_col)
    drawn = known.filter(fold(id_col) != 1).withColumn("_calibrates", F.pmod(F.shiftright(mixed, 32), F.lit(4)) == 0).orderBy(mixed, id_col).limit(sample)
    joined = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col)  # ``sample`` rows at most
    rows = cut(joined.select("text", "label", "_calibrates"))
    classes = {(row["_calibrates"], row["label"]) for row in rows.select("_calibrates", "label").distinct().collect()}
    able = {(x, y) for x in (False, True) for y in (0.0, 1.0)} <= classes
    learned = learn_lexicon(rows.filter("not _calibrates")) if able else []
    held = F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out")
    b = unused([*docs.columns, "label"])
    found = with_features(docs, text_col, learned, f"{b}features")
    if able:
        fitted = cut(with_features(rows, "text", learned, f"{b}features").select("label", "_calibrates", array_to_vector(f"{b}features").alias(f"{b}vector")))
        learner = GBTClassifier(featuresCol=f"{b}vector", labelCol="label", predictionCol=f"{b}guess", maxIter=20, maxDepth=3, maxBins=64, seed=1)
        trees = learner.fit(fitted.filter("not _calibrates").select("label", f"{b}vector")).setRawPredictionCol(f"{b}raw").setProbabilityCol(f"{b}probability")

        def rated(frame: DataFrame) -> DataFrame:
            return trees.transform(frame).withColumn(f"{b}p", vector_to_array(f"{b}probability")[1])

        steps = IsotonicRegression(featuresCol=f"{b}p", labelCol="label", predictionCol=f"{b}calibrated").fit(rated(fitted.filter("_calibrates")).select(f"{b}p", "label"))
        found = rated(found.withColumn(f"{b}vector", array_to_vector(f"{b}features")))
        bounds, values = [float(x) for x in steps.boundaries], [float(x) for x in steps.predictions]
        found = found.withColumn(f"{b}score", _interpolated(f"{b}p", bounds, values))
    else:
        found = found.withColumn(f"{b}score", 1 - F.exp(-20 * F.col(f"{b}features")[FEATURES.index("seed_density")]))
    score = F.col(f"{b}score")
    return found.select(*kept, held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def _interpolated(column: str, bounds: list[float], values: list[float]) -> F.Column:
    """The isotonic steps, linear between their bounds; ties keep the trees' order by a share of a thousandth of their own probability."""
    p = F.col(column)
    step = F.lit(values[0])
    for (a, b), (u, v) in zip(zip(bounds, bounds[1:]), zip(values, values[1:])):
        step = F.when(p >= a, F.lit(u) + (F.least(p, F.lit(b)) - a) * ((v - u) / (b - a) if b > a else 0.0)).otherwise(step)
    return 0.999 * F.least(F.greatest(step, F.lit(0.0)), F.lit(1.0)) + 0.001 * p
