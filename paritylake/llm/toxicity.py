"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs used as
letters to one Latin class, and is applied to lexicon and text alike. A match counts at
word boundaries and outside every match of an exception phrase that covers it. The sum of
the matched weights and that sum per word of the text go into a logistic curve.

Training reads at most `max_labels` labelled rows, taken in hash order; word counts by label
give the terms, and the same rows the exception phrases and the curve. The rows bound them all.

Null or empty texts have no match and get the curve's value at zero. Rows without an id
are never used for training and not held out. Repeated rows are scored one by one; of
repeated labels of one id the larger counts. A text is matched whole, in time linear in its length but
for the logarithm of its exceptions. Columns other than id and text are ignored, whatever their
names. Without labels every score is the curve's value at zero; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Look-alikes (fixed values): Cyrillic and Greek letters, signs and digits used as letters.
_LETTERS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l",
    "ø": "o", "ɡ": "g", "ɑ": "a", "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "è": "e", "é": "e", "ê": "e",
    "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u",
    "û": "u", "ü": "u", "ñ": "n", "ç": "c", "ý": "y",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
#: l and i share a class, since 1 and | stand for both.
_FOLD = {ord(k): v for k, v in {**_LETTERS, **_SIGNS, "l": "i"}.items()}
_FOLD |= {0xFF01 + i: _FOLD.get(0x21 + i, chr(0x21 + i)).lower() for i in range(94)}  # full-width forms
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
_BYTES = bytes(ord(_FOLD.get(c, chr(c))) if c < 128 else c for c in range(256))
_OTHERS = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLD if c > 127) + "]")
_LOOSE_SIGNS = re.compile(r"(?<!\w)[@$€]+(?!\w)|(?<=\w)[@$€]+(?![\w@$€])|(?<![\w@$€])[@$€]+(?=\W|$)")
_WORDS = re.compile(r"[^\W_]+")
#: A term that ends so is the stem of words: it matches their beginnings. Its "contexts" are those words.
STEM, _STEM = "*", 4


def fold(text: str) -> str:
    text = text.lower()
    if "$" in text or "@" in text or "€" in text:
        text = _LOOSE_SIGNS.sub(" ", text)  # decoration around a word is no letter
    if not text.isascii():
        text = _OTHERS.sub(lambda m: _FOLD[ord(m[0])] or "", text)
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).decode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Terms and phrases are kept folded."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 10.0)
    _auto: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._auto is None:
            a = ahocorasick.Automaton()
            for w in self.weights:
                a.add_word(w.rstrip(STEM), (len(w.rstrip(STEM)), w))
            for p in self.exceptions:
                if p not in self.weights:
                    a.add_word(p, (len(p), None))
            a.make_automaton()
            self._auto = a
        return self._auto

    def matches(self, folded: str) -> list[str]:
        """The terms found, with repeats."""
        if not self.weights:
            return []
        found, spared, n = [], [], len(folded)
        for end, (size, term) in self.automaton().iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            if end + 1 < n and folded[end + 1].isalnum() and not (term and term.endswith(STEM)):
                continue
            (spared if term is None else found).append((start, end, term))
        if spared:  # a term within an exception goes: of those that start before it one ends behind it
            starts, ends = zip(*sorted((a, b) for a, b, _ in spared))
            furthest = list(accumulate(ends, max))
            found = [f for f in found if (i := bisect_right(starts, f[0])) == 0 or furthest[i - 1] < f[1]]
        return [t for _, _, t in found]

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text or "")
        total = sum(self.weights[t] for t in self.matches(folded))
        if not total:
            return 0.0, 0.0
        words = max(1, len(folded.split()))
        return math.log1p(total), min(1.0, total / words)

    def score(self, text: str | None) -> float:
        x, d = self.features(text)
        b0, b1, b2 = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x + b2 * d))))

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Labelled rows outside the held-out fold, one per distinct text: copies add nothing.

    At most `most` labels are taken, in the order of a hash of the id. Their size is
    bounded by that, so they are broadcast and the corpus is not shuffled."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(taken), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text")).select("h", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, *, min_docs: int = 5, min_odds: float = 4.0,
          max_labels: int = 20_000, exceptions: tuple[str, ...] = ()) -> Model:
    rows = written(_training_rows(docs, labels, max_labels), "toxic-train")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: Counter = Counter()
            for y, t in zip(b["toxic"], b["text"]):
                found, seen = _WORDS.findall(fold(t)), {}
                for before, w in zip(["", *found], found):
                    if w not in seen:
                        seen[w] = before
                        if len(w) > _STEM:
                            seen.setdefault(w[:_STEM] + STEM, w)
                count.update((w, int(y > 0), before if y > 0 else "") for w, before in seen.items())
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["word", "y", "before", "n"])

    sizes = {int(r["y"]): int(r["n"]) for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model({}, curve=(-4.0 if neg or not pos else 4.0, 0.0, 0.0))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))
    counted = rows.mapInPandas(words, "word string, y int, before string, n bigint").groupBy("word", "before").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    # a word of one much-copied text stands after the same word every time; an insult does not
    least = F.when(F.endswith("word", F.lit(STEM)), F.lit(min_docs)).otherwise(F.greatest(F.lit(min_docs), F.col("p") / 2))
    spread = F.col("contexts") >= least
    listed = (
        counted.groupBy("word").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.count_if(F.col("p") > 0).alias("contexts"))
        .where((F.col("p") >= min_docs) & spread).withColumn("odds", odds)
        .where(F.col("odds") > F.when(F.endswith("word", F.lit(STEM)), 1.5 * min_odds).when(F.col("p") > pos / 20, min_odds / 2).otherwise(min_odds))
        .collect()  # as each word is in `min_docs` texts, their number is bounded by the labels
    )
    weights = {r["word"]: float(r["odds"]) for r in listed}
    # a word and a stem of the same letters would share an entry; words that a listed stem covers go
    weights = {w: v for w, v in weights.items() if w.endswith(STEM) or (w[:_STEM] + STEM) not in weights}
    model = Model(weights, tuple(fold(e) for e in exceptions))
    model = Model(weights, tuple(sorted({*model.exceptions, *_contexts(rows, model)})))

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(*model.features(t), int(y > 0)) for t, y in zip(b["text"], b["toxic"])]
            yield pd.DataFrame(got, columns=["x", "d", "y"]).groupby(["x", "d", "y"]).size().reset_index(name="n")

    pts = rows.mapInPandas(points, "x double, d double, y int, n bigint").groupBy("x", "d", "y").agg(F.sum("n").alias("n")).toPandas()
    return Model(model.weights, model.exceptions, _logistic(pts))


def _contexts(rows: DataFrame, model: Model) -> list[str]:
    """Two-word phrases around a term that nearly only clean texts use; their number is bounded by the labels of `train`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for y, t in zip(b["toxic"], b["text"]):
                w = _WORDS.findall(fold(t))
                at = [i for i, x in enumerate(w) if x in model.weights or x[:_STEM] + STEM in model.weights]
                c.update({(f"{w[j]} {w[j + 1]}", int(y > 0)) for i in at for j in (i - 1, i) if 0 <= j < len(w) - 1})
            yield pd.DataFrame([(p, y, n) for (p, y), n in c.items()], columns=["phrase", "y", "n"])

    if not model.weights:
        return []
    got = rows.mapInPandas(run, "phrase string, y int, n bigint").groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("n").alias("n"))
    return [r["phrase"] for r in got.where("clean >= 5 AND clean >= 0.9 * n").orderBy(F.desc("clean"), "phrase").collect()]


def _logistic(pts: pd.DataFrame) -> tuple[float, float, float]:
    """Newton steps with a small ridge; three parameters."""
    x = np.column_stack([np.ones(len(pts)), pts["x"], pts["d"]])
    y, n = pts["y"].to_numpy(float), pts["n"].to_numpy(float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t) for t in b.column("text").to_pylist()], dtype=float)
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype("int32"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
