"""Toxicity scores from a classifier with counterfactual regularisation.

A logistic model over the set of a text's words (each word and its first
three, four and five letters, hashed) is fitted on labelled rows. Sentences of
those rows are set against counterfactuals of theirs: where one names a group,
the name is swapped for others of its kind; where it names none, it is put
into a template that does, with one name and with another, and beside itself
without. The fit penalises the squared change of the score, the probability of
the whole sentence, between the two, so a neutral mention of a group does not
raise it.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Group names by kind; a name is swapped for another of its kind.
IDENTITY_TERMS = {
    "religion": ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic", "protestant", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch", "musulmán", "cristiano", "judío"],
    "origin": ["black", "white", "asian", "african", "american", "european", "arab", "latino", "mexican", "chinese", "indian", "immigrant", "immigrants", "refugee", "refugees", "étranger", "réfugié", "ausländer", "flüchtling", "extranjero", "refugiado"],
    "gender": ["woman", "women", "man", "men", "girl", "boy", "female", "male", "transgender", "femme", "homme", "frau", "mann", "mujer", "hombre"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual", "schwul", "lesbisch", "lesbienne", "lesbiana"],
    "ability": ["disabled", "blind", "deaf", "autistic", "handicapé", "behindert", "discapacitado"],
}
KIND = {w: k for k, ws in IDENTITY_TERMS.items() for w in ws}

#: Neutral mentions that a labelled sentence is set into, lower-cased.
TEMPLATES = ["said a {} neighbour", "and the {} people next door", "my {} friend told me", "as a {} person i read", "the {} family wrote"]

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
HASH_BITS = 22
#: Labelled rows that the model is fitted on, at most (expected number of a seeded sample of each label).
SAMPLE_ROWS = 6000
#: Features that the fit keeps: those whose presence differs most between the labels.
MAX_FEATURES = 4096
THRESHOLD = 0.3
#: Weight of the mean squared score change between a sentence and its counterfactual.
PENALTY = 4.0


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its prefixes."""
    parts = [f"={word}", *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) > k)]
    return tuple(xxhash.xxh32_intdigest(p.encode()) >> (32 - HASH_BITS) for p in parts)


def text_features(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), dtype=np.int32))


def sentences(text: str, most: int = 2) -> list[set[str]]:
    """Word sets of up to ``most`` sentences of three words or more, those of least hash."""
    found = {s.strip() for s in SENTENCE.split(text.lower()) if len(set(WORD.findall(s))) >= 3}
    return [set(WORD.findall(s)) for s in sorted(found, key=lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")))[:most]]


def counterfactuals(words: set[str], swaps: int = 2) -> tuple[set[str], list[tuple[str, str]]]:
    """(common words, pairs of what is added to them on either side, words joined by spaces) of a sentence's words.

    Names and templates are drawn by the sentence alone.
    """
    rng = random.Random(" ".join(sorted(words)))
    named = sorted(words & KIND.keys())
    if named:
        term = rng.choice(named)
        others = rng.sample([w for w in IDENTITY_TERMS[KIND[term]] if w != term], swaps)
        return words - {term}, [(term, w) for w in others]
    template = rng.choice(TEMPLATES)
    one, two = rng.sample(IDENTITY_TERMS[rng.choice(sorted(IDENTITY_TERMS))], 2)
    return words, [(template.format(one), template.format(two)), ("", template.format(one))]


@dataclass(frozen=True)
class Model:
    """weights by feature hash; the score is the logistic of bias and the weights of a text's words."""

    weights: dict[int, float]
    bias: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, texts: pd.Series, cache: dict[str, float]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = set(WORD.findall(text.lower())) if text else set()
            total = self.bias
            for w in words:
                weight = cache.get(w)
                if weight is None:
                    weight = cache[w] = self.word_weight(w)
                total += weight
            out[i] = total
            if len(cache) > 200_000:
                cache.clear()
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _rows(features: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the kept features; columns are hashes."""
    at = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    at[columns] = np.arange(len(columns))
    kept = [at[f] for f in features]
    kept = [f[f >= 0] for f in kept]
    return np.repeat(np.arange(len(kept)), [len(f) for f in kept]), np.concatenate(kept).astype(np.int64)


def _largest(times, size: int, rounds: int = 12) -> float:
    """The largest eigenvalue of a map of vectors, by power iteration from one fixed start."""
    v, norm = np.ones(size) / np.sqrt(max(1, size)), 0.0
    for _ in range(rounds if size else 0):
        v = times(v)
        norm = float(np.linalg.norm(v))
        if norm == 0:
            return 0.0
        v /= norm
    return 1.1 * norm


def train(features: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]], max_features: int = MAX_FEATURES, l2: float = 1e-4, l1: float = 2e-4, penalty: float = PENALTY, rounds: int = 200) -> Model:
    """Accelerated proximal descent on logistic loss, ridge, lasso, and ``penalty`` times the mean squared score change of the pairs.

    pairs: of each sentence the features that both sides have, and for each
    pair the features that either side adds. Without both labels in the sample
    the model scores every text with the share of label 1 (0 for an empty
    sample).
    """
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model({}, -40.0 if share == 0 else 40.0)
    seen, pos = np.zeros(1 << HASH_BITS, dtype=np.int32), np.zeros(1 << HASH_BITS, dtype=np.int32)
    for f, label in zip(features, labels, strict=True):  # a text has a feature once
        seen[f] += 1
        pos[f] += int(label)
    columns = np.flatnonzero(seen > 1)
    seen, pos = seen[columns], pos[columns]
    p1, p0, p = pos / labels.sum(), (seen - pos) / (n - labels.sum()), seen / n
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1 / n) * (1 / labels.sum() + 1 / (n - labels.sum())))
    keep = np.sort(np.argsort(-z, kind="stable")[:max_features])
    columns = columns[keep][z[keep] > 2]
    k = len(columns)
    r, c = _rows(features, columns)
    sr, sc = _rows([base for base, _ in pairs], columns) if pairs else (np.empty(0, np.int64),) * 2
    flat = [(i, np.setdiff1d(one, base), np.setdiff1d(two, base)) for i, (base, each) in enumerate(pairs) for one, two in each]
    of = np.array([i for i, _, _ in flat], dtype=np.int64)
    sides = [_rows([x[j] for x in flat], columns) if flat else (np.empty(0, np.int64),) * 2 for j in (1, 2)]
    m, n_base = max(1, len(flat)), len(pairs)

    # w holds the weights and, last, the bias
    def main(w):  # the linear part of each text
        return np.bincount(r, weights=w[c], minlength=n) + w[k]

    def main_back(g):
        return np.append(np.bincount(c, weights=g[r], minlength=k), g.sum())

    def both(w):  # and of each side of each pair
        base = np.bincount(sr, weights=w[sc], minlength=n_base)[of] + w[k] if flat else np.empty(0)
        return [base + np.bincount(x, weights=w[y], minlength=len(flat)) for x, y in sides]

    def both_back(g1, g2):
        base = np.bincount(of, weights=g1 + g2, minlength=n_base)
        out = np.bincount(sc, weights=base[sr], minlength=k)
        for (x, y), g in zip(sides, (g1, g2), strict=True):
            out += np.bincount(y, weights=g[x], minlength=k)
        return np.append(out, (g1 + g2).sum())

    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    curved = _largest(lambda v: main_back(main(v)) / n, k + 1) / 4
    # the squared change has second derivatives of at most 2 * (1 / 8 + 0.0963) on either side
    bent = 0.443 * _largest(lambda v: both_back(*both(v)) / m, k + 1) if flat and penalty else 0.0
    step = 1.0 / (curved + penalty * bent + l2)

    w = np.zeros(k + 1)
    w[k] = np.log(share / (1 - share))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        g = main_back(sigmoid(main(v)) - labels) / n
        if flat and penalty:
            q1, q2 = (sigmoid(x) for x in both(v))
            g += 2 * penalty / m * both_back((q1 - q2) * q1 * (1 - q1), -(q1 - q2) * q2 * (1 - q2))
        g[:k] += l2 * v[:k]
        new = v - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    used = np.flatnonzero(w[:k])
    return Model({int(columns[i]): float(w[i]) for i in used}, float(w[k]))


def sample_of(labelled: DataFrame, rows: int, seed: int, key: str, label: str) -> tuple[DataFrame, dict, dict]:
    """A seeded sample by hash of key, of ``rows`` rows in expectation: half of it label 1, if there are so many.

    Returned with the numbers aimed at and the numbers there are, by label.
    """
    n = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # two rows
    ones = min(n.get(1, 0), max(rows // 2, rows - n.get(0, 0)))
    take = {1: ones, 0: min(n.get(0, 0), rows - ones)}
    rate = {k: take[k] / n[k] if n.get(k) else 0.0 for k in (0, 1)}
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = labelled.withColumn("__u", u).filter(F.col("__u") < F.when(F.col(label) == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])))
    return chosen.orderBy("__u", key).limit(2 * rows).drop("__u"), take, n


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **training) -> Model:
    """A model from labelled documents.

    Rows with a null id, text or label, or a label other than 0 and 1, are not
    used; of several labels of an id the largest counts, and of several texts
    one. The sample is at most 2 * rows ids (in expectation ``rows``), so it is
    small enough to send to every executor; sampling by label is undone in the
    bias. Texts become feature hashes on the executors. Ids may be of any type
    and are no input of the fit but by the sample.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    known = known.join(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")), "__id", "left_semi")
    chosen, take, n = sample_of(known, rows, seed, "__id", "__label")
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id").filter(F.col("__text").isNotNull())
    joined = joined.groupBy("__id", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def extract(batches):
        for b in batches:
            rows = []
            for y, t in zip(b["__label"], b["__text"], strict=True):
                made = [counterfactuals(w) for w in sentences(t)]
                rows.append((y, text_features(set(WORD.findall(t.lower()))).tobytes(), [text_features(w).tobytes() for w, _ in made], ["|".join(f"{x}:{y}" for x, y in each) for _, each in made]))
            yield pd.DataFrame(rows, columns=["label", "f", "base", "pairs"])

    # bounded by the sample: four bytes for each feature of a text or sentence
    got = joined.select("__label", "__text").mapInPandas(extract, "label int, f binary, base array<binary>, pairs array<string>").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["f"])))
    hashes = lambda x: np.frombuffer(x, dtype=np.int32)
    added = lambda x: text_features(set(x.split()))
    pairs = [(hashes(base), [tuple(map(added, p.split(":"))) for p in each.split("|")]) for r in got for base, each in zip(r["base"], r["pairs"], strict=True)]
    features, known_labels = [hashes(r["f"]) for r in got], np.array([r["label"] for r in got], dtype=float)
    del got
    model = train(features, known_labels, pairs, **training)
    if model.weights and take[0] and take[1]:
        model = Model(model.weights, model.bias + float(np.log((n[1] / n[0]) / (take[1] / take[0]))))
    return model


def toxicity(text: Column, model: Model) -> Column:
    """Score of each text, 0 to 1; a null text scores like an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts, cache))

    cache: dict[str, float] = {}
    return score(text)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs whose score is below the threshold, with their columns as they are; null texts score like empty ones, an empty table stays empty."""
    return docs.withColumn("__score", toxicity(F.col(text), model)).filter(F.col("__score") < threshold).drop("__score")


def op1_counterfactual(spark, sf_dir: str) -> DataFrame:
    """All documents; null texts score like empty ones, repeated rows each for themselves, ties can't arise."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = fit(docs, labels.filter(~held))
    out = docs.select("doc_id", held.alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
