"""Toxicity scores from a subsequence string kernel and a support vector machine.

Two strings are alike by the common subsequences of ``SUBSEQUENCE`` characters they
hold, each weighted by ``DECAY`` to the length it spans in either string. Gaps are
allowed, so a word with characters put in between still resembles the word. The units
compared are words and runs of single characters set apart ("w o r d" is one unit too).

Landmarks are units that the labelled training texts set apart, and some common ones.
A sentence is mapped to its greatest kernel value at every landmark and from there, by
the inverse square root of the landmarks' own kernel matrix (Nystroem), into a space
where a linear machine with squared hinge loss separates. It is trained twice: on whole
labelled texts, then on the one sentence of each that the first machine finds worst. A
text's score is the logistic image of its worst sentence.

Only labels whose ``crc32(doc_id) mod 5`` is not 0 are learned from, of them at most
``TRAINING_ROWS`` per class (the smallest hashes of their ids). Every whole text is
scored in place; nothing is shuffled but counts of units of the training rows.

Defined cases: a null or empty text scores as a sentence without any likeness. A null id
is never learned from and not held out. Contradicting labels of one id count as toxic.
Rows that repeat an id are scored each. Without labels of both classes every score is 0.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import small_batches

SUBSEQUENCE = 3
DECAY = 0.85
# Labelled rows used per class, at most.
TRAINING_ROWS = 3000
LANDMARKS = 64
COMMON_LANDMARKS = 8
CANDIDATES = 600
# Standard errors by which a unit has to stand out; chance among a million units stays below.
CLEARLY = 5.0
# Landmarks that mark a class are at most this alike.
APART = 0.6
# The kernel is raised to this power (a kernel again): it tells near from far better.
POWER = 2
# Longer units are read through windows of this many characters, half overlapping.
SPAN = 24
# Kernel values below this count as no likeness.
LEAST = 0.25
REMEMBERED = 300_000
FOLDS = 5
MARKS = ".,;:!?()[]{}\"'`*#$%&|<>-_=+~/\\"

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_APART = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


def subsequence_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of strings ``left[n, i]`` with ``right[n or 1, m, j]`` (-1 pads right)."""
    n, m, width = len(left), right.shape[1], right.shape[2]
    prefix = [np.ones((n, m, width + 1))] + [np.zeros((n, m, width + 1)) for _ in range(SUBSEQUENCE - 1)]
    total = np.zeros((n, m))
    for i in range(left.shape[1]):
        same = left[:, i, None, None] == right
        total += DECAY**2 * (same * prefix[-1][:, :, :width]).sum(axis=2)
        for k in range(SUBSEQUENCE - 1, 0, -1):
            ending = np.zeros((n, m))
            prefix[k] *= DECAY
            for j in range(width):
                ending = DECAY * ending + DECAY**2 * same[:, :, j] * prefix[k - 1][:, :, j]
                prefix[k][:, :, j + 1] += ending
    return total


def as_codes(strings: list[str]) -> np.ndarray:
    """Strings as a matrix of code points, padded with -1."""
    out = np.full((len(strings), max(map(len, strings), default=0)), -1, np.int64)
    for row, s in zip(out, strings, strict=True):
        row[: len(s)] = [ord(c) for c in s]
    return out


def windows_of(unit: str) -> list[str]:
    if len(unit) <= SPAN:
        return [unit]
    return [unit[at : at + SPAN] for at in range(0, len(unit) - SPAN // 2, SPAN // 2)]


class LandmarkKernel:
    """Normalised kernel of units with fixed landmarks.

    The kernel is the product of weights over common subsequences, so the landmarks'
    weights are laid out by subsequence once; a unit then adds up the rows of the
    subsequences it has. Its own norm is only worked out if a value could reach ``least``.
    """

    def __init__(self, landmarks: list[str]):
        letters = sorted({c for s in landmarks for c in s})
        self.base = len(letters) + 1  # 0 stands for every other character
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.base)
        rows: dict[int, np.ndarray] = {}
        for at, s in enumerate(landmarks):
            keys, weight = self._subsequences(self._codes([s]))
            for k, w in zip(keys[0].tolist(), weight.tolist(), strict=True):
                rows.setdefault(k, np.zeros(len(landmarks)))[at] += w
        self.row = np.zeros(self.base**SUBSEQUENCE, np.int32)  # under 2^31 keys: landmarks have few letters
        self.row[list(rows)] = np.arange(1, len(rows) + 1)
        self.weights = np.array([np.zeros(len(landmarks)), *rows.values()])
        self.weights /= np.sqrt((self.weights**2).sum(axis=0))
        self.most = self.weights.max(axis=1)
        self.width = len(landmarks)

    def _codes(self, strings: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.code[flat].reshape(len(strings), -1)

    def _subsequences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the subsequences at all places, and the places' weights. A character that no
        landmark has makes a key that none of them has."""
        places = np.array(list(combinations(range(codes.shape[1]), SUBSEQUENCE)))
        key = codes[:, places[:, 0]]
        for k in range(1, SUBSEQUENCE):
            key = key * np.int32(self.base) + codes[:, places[:, k]]
        return key, DECAY ** (places[:, -1] - places[:, 0] + 1.0)

    def values(self, units: list[str], least: float = 0.0) -> np.ndarray:
        """One row per unit; units shorter than a subsequence, and values below ``least``, are 0."""
        out = np.zeros((len(units), self.width))
        by_length: dict[int, list[tuple[int, str]]] = {}
        for at, unit in enumerate(units):
            for part in windows_of(unit):
                if len(part) >= SUBSEQUENCE:
                    by_length.setdefault(len(part), []).append((at, part))
        for length, parts in by_length.items():
            step = max(1, 1_000_000 // math.comb(length, SUBSEQUENCE))
            for first in range(0, len(parts), step):
                some = parts[first : first + step]
                keys, weight = self._subsequences(self._codes([part for _, part in some]))
                rows = self.row[keys]
                # a unit's squared norm is at least that of its places (equal subsequences add to
                # it), and no landmark gets more than the most that each place gives any
                lowest = least * np.sqrt((weight**2).sum())
                found = np.flatnonzero((self.most[rows] @ weight >= lowest) & rows.any(axis=1))
                if not len(found):
                    continue
                rows = rows[found]
                unit, place = np.nonzero(rows)
                starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
                sums = np.add.reduceat(self.weights[rows[unit, place]] * weight[place][:, None], starts)
                reach = sums.max(axis=1) >= lowest
                if not reach.any():
                    continue
                found, sums = found[reach], sums[reach]
                sums /= np.sqrt(_self_kernel(as_codes([some[i][1] for i in found])))[:, None]
                np.maximum.at(out, [some[i][0] for i in found], sums)
        out[out < least] = 0
        return out


@lru_cache(maxsize=2)
def likenesses(landmarks: tuple[str, ...]) -> Likenesses:
    """The worker's own memory of units for these landmarks."""
    return Likenesses(list(landmarks))


def likeness(units: list[str], landmarks: list[str]) -> np.ndarray:
    return LandmarkKernel(landmarks).values(units)


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    return subsequence_kernel(codes, codes[:, None, :])[:, 0]


_NO_MARKS = str.maketrans("", "", MARKS)


def clean_unit(word: str) -> str:
    """The word without marks, also inside ("w.o-rd")."""
    return word if word.isalnum() else word.translate(_NO_MARKS)


def sentences_of(text: str | None) -> list[list[str]]:
    """Words of every sentence, then every run of single characters as a sentence."""
    if not text:
        return []
    low = text.lower()
    sentences = [words for s in _SENTENCE.split(low) if (words := s.split())]
    return sentences + [["".join(run[0].split())] for run in _APART.finditer(low)]


class Likenesses:
    """Remembers the landmark vector of units; most units are like no landmark."""

    def __init__(self, landmarks: list[str]):
        self.kernel = LandmarkKernel(landmarks)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.vectors = np.zeros((1024, self.kernel.width))  # the first stays zero; grows by doubling
        self.filled = 1

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            self._reset()
            new = list(words)
        if not new:
            return
        cleaned = [clean_unit(w) for w in new]
        units = list(set(cleaned))
        values = self.kernel.values(units, LEAST) ** POWER
        place = dict.fromkeys(units, 0)
        like = np.flatnonzero(values.any(axis=1))
        end = self.filled + len(like)
        while end > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.filled : end] = values[like]
        place.update((units[at], self.filled + k) for k, at in enumerate(like.tolist()))
        self.filled = end
        self.place.update((word, place[unit]) for word, unit in zip(new, cleaned, strict=True))

    def documents(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text: one row per sentence that is like some landmark, and a row of zeros."""
        split = [sentences_of(t) for t in texts]
        self.learn({w for sentences in split for words in sentences for w in words})
        place_of, vectors = self.place.__getitem__, self.vectors
        for sentences in split:
            places, starts = [0], [0]
            for words in sentences:
                found = set(map(place_of, words))
                found.discard(0)
                if found:
                    starts.append(len(places))
                    places.extend(found)
            yield np.maximum.reduceat(vectors[places], starts, axis=0)


@dataclass
class Machine:
    """A trained scorer: landmarks, their whitening, weights, bias and the logistic line."""

    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.whiten @ self.weights + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit_hinge(x: np.ndarray, toxic: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike (Newton steps)."""
    y = np.where(toxic, 1.0, -1.0)
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty / len(x) * np.eye(a.shape[1]) + 1e-6 * np.eye(a.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        inside = y * (a @ w) < 1
        weighted = a[inside] * share[inside, None]
        step = np.linalg.solve(weighted.T @ a[inside] + ridge, weighted.T @ y[inside])
        if np.abs(step - w).max() < 1e-8:
            break
        w = step
    return w[:-1], float(w[-1])


def fit_logistic(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic line through the margins (targets drawn in a little)."""
    goal = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (goal - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most ``TRAINING_ROWS`` labelled rows per class, none held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for kind in (0, 1):
        some = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
        chosen = some if chosen is None else chosen.union(some)
    # at most 2 x TRAINING_ROWS ids
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def choose_landmarks(rows: DataFrame) -> list[str]:
    """Units that mark one class, apart from each other, and the most common ones."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kinds = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {clean_unit(w) for words in sentences_of(text) for w in words}
                own = {u for u in own if SUBSEQUENCE <= len(u) <= SPAN}
                names.extend(own)
                kinds.extend([toxic] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.int32())], names=["unit", "toxic"]
            )

    counts = (
        rows.mapInArrow(units, "unit string, toxic int")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    seen = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in seen}
    if set(n) != {0, 1}:
        return []
    # how many standard errors the unit's shares of toxic and clean texts are apart
    both = (F.col("bad") + F.col("good")) / (n[0] + n[1])
    lift = (F.col("bad") / n[1] - F.col("good") / n[0]) / F.sqrt(both * (1 / n[0] + 1 / n[1]))
    lifted = counts.select("unit", lift.alias("lift")).where(F.col("lift") >= CLEARLY)
    marked = lifted.orderBy(F.desc("lift"), "unit").limit(CANDIDATES).collect()
    common = counts.select("unit", (F.col("bad") + F.col("good")).alias("n")).orderBy(F.desc("n"), "unit")
    landmarks: list[str] = []
    wanted = LANDMARKS - COMMON_LANDMARKS
    names = [r["unit"] for r in marked]
    if names:
        alike = likeness(names, names)
        chosen: list[int] = []
        for at in range(len(names)):
            if len(chosen) < wanted and all(alike[at, c] < APART for c in chosen):
                chosen.append(at)
        landmarks = [names[c] for c in chosen]
    for row in common.limit(COMMON_LANDMARKS).collect():
        if row["unit"] not in landmarks:
            landmarks.append(row["unit"])
    return landmarks


def whitening(landmarks: list[str]) -> np.ndarray:
    values, vectors = np.linalg.eigh(likeness(landmarks, landmarks) ** POWER)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine, from labelled documents (doc_id, text); None without both classes."""
    rows = training_rows(docs, labels).repartition(16)
    landmarks = choose_landmarks(rows)
    if not landmarks:
        return None
    whiten = whitening(landmarks)

    def vectors(pick):
        """(toxic, one vector) per training text; ``pick`` makes it of the sentences' rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = likenesses(tuple(landmarks))
            for batch in batches:
                found = [pick(r).tolist() for r in known.documents(batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "vector"]
                )

        # at most 2 x TRAINING_ROWS vectors of LANDMARKS numbers
        got = rows.mapInArrow(run, "toxic int, vector array<double>").toPandas()
        return np.array(got["vector"].tolist()), got["toxic"].to_numpy() == 1

    bags, toxic = vectors(lambda r: r.max(axis=0))
    first = Machine(landmarks, whiten, *fit_hinge(bags @ whiten, toxic))
    worst, toxic = vectors(lambda r: r[int(np.argmax(first.margins(r)))])
    machine = Machine(landmarks, whiten, *fit_hinge(worst @ whiten, toxic))
    machine.slope, machine.offset = fit_logistic(machine.margins(worst), toxic)
    return machine


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(remainder() == 0, F.lit(False))
    machine = train(rows, labels)
    if machine is None:
        return rows.select(
            "doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).cast("int").alias("predicted")
        )
    shared = spark.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        known = likenesses(tuple(machine.landmarks))
        for batch in batches:
            scores = [
                machine.score(float(machine.margins(r).max())) for r in known.documents(batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    scored = rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        score, "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
