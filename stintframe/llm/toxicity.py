"""Toxicity by multiple-instance learning: sentences are the instances, only documents carry labels.

A sentence's probability is logistic in the summed weights of its words and their beginnings (inflected and compounded
forms share them); a document's is the noisy-or of its sentences that hold a weighted feature, ``1 - prod(1 - p)``: neutral sentences add
nothing, however many there are.  Weights are fitted by gradient ascent on the documents' likelihood, so that the sentences that make
a document toxic are found without sentence labels and can be located afterwards.  Clean documents are also learnt from joined
into longer and longer ones, which are as clean: weak evidence must not add up with length.

A clean sentence is taken for a toxic one now and then, so a long text gathers such errors.  ``Leak`` is what so many clean sentences gather
by chance, learnt on folds that the weights were not fitted on, and a document's log odds are lowered by it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import release, slices
from .wordunits import Memory, split, spread

_WORD = re.compile(r"[^\W\d_]+")
#: Features are words (marked by an end) and their first letters in these numbers.
BEGINNINGS = (4, 5, 6)
#: A feature is fitted if its share of toxic documents exceeds the sample's by so many standard errors, and is so many
#: times its share of the others.
EVIDENCE, TIMES = 4.0, 3.0
#: Clean documents that are joined into one.
JOINED = (4, 16, 64, 256, 1024)
#: Standard deviations above the mean at which the evidence of clean sentences is bounded.
BOUND = 3.0
#: Times that the sample is halved to measure it: the errors are few, and one halving's models make some by chance.
HALVINGS = 3
#: Errors that may go unseen in any sample, with 95 % confidence three at most, and the evidence of each (a probability of 0.7).
UNSEEN, ERROR = 3, 1.2
#: What ends a sentence, quotes and brackets that may follow it, and marks that need no space after them.
ENDS, CLOSING, FULL_WIDTH = (".", "!", "?", "…"), "\"'”’»)]", "。！？"


def unit_features(unit: str) -> list[str]:
    """Features of the words in a unit: each word, and its beginnings."""
    out = []
    for word in _WORD.findall(unit.lower()):
        out.append(word + "$")
        out += [word[:n] for n in BEGINNINGS if len(word) > n]
    return out


class Sentences(NamedTuple):
    """Units of texts and the sentence of each; sentences are numbered through, and ``text_of`` has the text of each."""

    codes: np.ndarray
    dictionary: pa.Array
    sentence: np.ndarray
    text_of: np.ndarray

    def text(self, k: int) -> str:
        a, b = np.searchsorted(self.sentence, [k, k + 1])
        return " ".join(self.dictionary.take(pa.array(self.codes[a:b])).to_pylist()).strip()


def sentences(texts: pa.Array) -> Sentences:
    """Sentences end with a unit that ends in a mark of ``ENDS`` (and closing quotes), after a full-width mark, at a line end,
    and with the text."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n ")
    for mark in FULL_WIDTH:
        texts = pc.replace_substring(texts, mark, mark + " ")
    units = split(texts, every_space=True)
    marks = (*ENDS, *FULL_WIDTH, "\n")
    ends = np.fromiter((x.rstrip(CLOSING).endswith(marks) for x in units.unique), bool, len(units.dictionary))[units.codes]
    new = np.r_[True, ends[:-1]] | units.first if len(ends) else ends
    sentence = np.cumsum(new) - 1
    text = np.repeat(np.arange(len(units.offsets) - 1), np.diff(units.offsets))
    return Sentences(units.codes, units.dictionary, sentence, text[new])


class Leak(NamedTuple):
    """Mean and deviation of a clean sentence's evidence ``-log(1 - p)``: among all with a word, and among those that count."""

    mean: float = 0.0
    deviation: float = 0.0
    counted_mean: float = 0.0
    counted_deviation: float = 0.0

    def bound(self, worded: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """What so many clean sentences gather at most, up to chance: the lower of the bounds by either number."""
        by_worded = worded * self.mean + BOUND * self.deviation * np.sqrt(worded)
        return np.minimum(by_worded, counted * self.counted_mean + BOUND * self.counted_deviation * np.sqrt(counted))


class Model:
    """Weight of each feature that has one, a bias, and the leak of clean sentences."""

    def __init__(self, weights: dict[str, float], bias: float, leak: Leak = Leak()):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.memory = Memory(self._work_out)

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.leak)

    def _work_out(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Weight of each unit, whether it has a word, and whether one of its features has a weight."""
        found = [unit_features(x) for x in units]
        held = [[self.weights[w] for w in x if w in self.weights] for x in found]
        n = len(units)
        return np.fromiter(map(sum, held), float, n), np.fromiter(map(bool, found), bool, n), np.fromiter(map(bool, held), bool, n)

    def evidence(self, texts: pa.Array) -> tuple[Sentences, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentences with their log odds (-inf without a word); of each text the summed evidence, and the numbers of its sentences
        with a word and of those that count."""
        parts = sentences(texts)
        weight, worded, counted = self.memory.look_up(parts.dictionary)
        if not self.weights and self.bias >= 0:  # without weights, the model is its bias alone: labels of one class
            counted = worded
        n, k = len(parts.text_of), len(texts)
        worded, counted = (np.bincount(parts.sentence, x[parts.codes], n) > 0 for x in (worded, counted))
        z = np.bincount(parts.sentence, weight[parts.codes], n) + self.bias
        z[~worded] = -np.inf
        total = np.bincount(parts.text_of, np.where(counted, np.logaddexp(0, z), 0), k)
        return parts, z, total, np.bincount(parts.text_of, worded, k), np.bincount(parts.text_of, counted, k)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
        """Of each text: noisy-or of its sentences, its log odds lowered by the leak; number, text and probability of its worst
        sentence (-1, null and 0 without any word)."""
        parts, z, total, worded, counted = self.evidence(texts)
        n = len(z)
        with np.errstate(divide="ignore", over="ignore"):
            odds = total + np.log(-np.expm1(-total)) - self.leak.bound(worded, counted)
            total = 1 / (1 + np.exp(-odds))
        starts = np.searchsorted(parts.text_of, np.arange(len(texts)))
        worst, place, where = np.zeros(len(texts)), np.full(len(texts), -1), []
        for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)):
            k = a + int(np.argmax(z[a:b]))
            if np.isfinite(z[k]):
                worst[i], place[i] = 1 / (1 + np.exp(-z[k])), k - a
            where.append(parts.text(k) if np.isfinite(z[k]) else None)
        return total, place, where, worst


def learn(texts: list[str], labels: list[int]) -> Model:
    """The model fitted on all texts, with the leak of the clean ones.

    Their evidence is measured by models fitted on the other half of the texts, since a model's own texts are cleaner to it than others are.
    Halves go by bits of a checksum of the text, so copies share one.  A half without texts of both classes measures nothing.
    """
    y = np.array(labels, int)
    checksum = np.array([crc32(x.encode()) for x in texts], np.int64)
    found = []
    for bit, k in product(range(HALVINGS), (0, 1)):
        half = checksum >> bit & 1 == k
        others = np.flatnonzero(~half)
        clean = [texts[i] for i in np.flatnonzero(half & (y == 0))]
        if clean and len({*y[others].tolist()}) == 2:
            found.append(fit([texts[i] for i in others], y[others].tolist()).evidence(pa.array(clean, pa.large_string()))[2:])
    model = fit(texts, labels)
    if found:
        gathered, *numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        model.leak = Leak(*(x for n in numbers for x in moments(gathered, n)))
    return model


def moments(gathered: np.ndarray, numbers: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of one sentence's evidence, from what documents with these numbers of sentences gathered in all halvings, and
    ``UNSEEN`` errors more a halving."""
    n, unseen = float(numbers.sum()), UNSEEN * HALVINGS
    if not n:
        return 0.0, 0.0
    mean = (float(gathered.sum()) + unseen * ERROR) / n
    return mean, float(np.sqrt((((gathered - mean * numbers) ** 2).sum() + unseen * ERROR**2) / n))


def fit(texts: list[str], labels: list[int], rounds: int = 400, rate: float = 0.1, decay: float = 1e-4, start: float = -5.0) -> Model:
    """Full-batch Adam on the noisy-or likelihood, classes weighted to equal shares, weights shrunk by ``decay``.

    Only features with evidence (see ``EVIDENCE``) get a weight, so that the sample's rare words stay at zero.
    Without labels of both classes the model is its bias alone.
    """
    y = np.array(labels, float)
    if len({*labels}) < 2:
        return Model({}, 6.0 if labels and labels[0] else start)
    parts = sentences(pa.array(texts, pa.large_string()))
    names: dict[str, int] = {}
    features, lengths = array("i"), array("q")
    for x in parts.dictionary.to_pylist():
        before = len(features)
        features.extend(names.setdefault(w, len(names)) for w in unit_features(x))
        lengths.append(len(features) - before)
    features, lengths = np.frombuffer(features, np.int32), np.frombuffer(lengths, np.int64)
    doc_of, n = parts.text_of, len(parts.text_of)
    # each unit of each document once, then each feature
    held = np.unique(parts.codes * np.int64(len(texts)) + doc_of[parts.sentence])
    at, times = spread(held // len(texts), np.cumsum(lengths) - lengths, lengths)
    held = np.unique(features[at] * np.int64(len(texts)) + np.repeat(held % len(texts), times))
    feature, doc = held // len(texts), held % len(texts)
    del held, at, times
    toxic = np.bincount(feature, y[doc], len(names))
    count = np.bincount(feature, minlength=len(names))
    del feature, doc
    prior = y.mean()
    good = toxic - count * prior > EVIDENCE * np.sqrt(count * prior * (1 - prior))
    good &= (count > 0) & ((toxic + 0.5) / y.sum() > TIMES * (count - toxic + 0.5) / (1 - y).sum())
    used = np.flatnonzero(good)
    # of the sentences, only the units with such a feature
    number = np.where(good, np.cumsum(good) - 1, -1)
    kept = np.add.reduceat(np.r_[good[features], False], np.minimum(np.cumsum(lengths) - lengths, len(features))) * (lengths > 0) > 0
    held = np.flatnonzero(kept[parts.codes])
    at, times = spread(parts.codes[held], np.cumsum(lengths) - lengths, lengths)
    word, of = number[features[at]], np.repeat(parts.sentence[held], times)
    word, of = word[word >= 0], of[word >= 0]
    counted = np.bincount(of, minlength=n) > 0
    # the documents as bags of their counted sentences, then clean ones joined; either half of the clean share
    sentence, bag = np.flatnonzero(counted), doc_of[counted]
    clean_number = np.where(y == 1, -1, np.cumsum(1 - y) - 1).astype(np.int64)
    share, bags, of_clean = np.where(y == 1, 0.5 / y.sum(), 0.25 / (1 - y).sum()), [bag], np.flatnonzero(y[bag] == 0)
    n_clean = int((1 - y).sum())
    levels = [k for k in JOINED if k < 2 * n_clean]
    for k in levels:
        joined = -(-n_clean // k)
        bags.append(len(share) + clean_number[bag[of_clean]] // k)
        share = np.r_[share, np.full(joined, 0.25 / joined / len(levels))]
    sentence = np.concatenate([sentence, np.tile(sentence[of_clean], len(levels))])
    bag = np.concatenate(bags)
    y = np.r_[y, np.zeros(len(share) - len(y))]
    w = np.zeros(len(used) + 1)  # the bias last
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[word], n) + w[-1]
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(bag, np.logaddexp(0, z)[sentence], len(share))  # -log of the probability that no sentence is toxic
        doc = np.clip(-np.expm1(-clean), 1e-9, 1)
        g = share * np.where(y == 1, (1 - doc) / doc, -1.0)
        dz = np.bincount(sentence, g[bag], n) * p
        grad = np.r_[np.bincount(word, dz[of], len(used)), dz.sum()]
        grad[:-1] -= decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    named = [*names]
    return Model({named[i]: float(x) for i, x in zip(used, w[:-1], strict=True)}, float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample: labelled documents outside the held-out third, half of them toxic if possible.

    The sample is the first of each class in the order of a hash of the id, up to the first that exceeds the class's half of
    ``most_rows`` or ``most_bytes``, so it does not depend on partitioning or length; only a text that alone exceeds that half
    is left to scoring.  It is chosen by ids and sizes, and only its own texts reach the driver.  Null ids, labels and texts
    are not learnt from; an id's texts count once.
    """
    known = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & ~held_out("id"))
    named = rows.select("id", F.octet_length("text").alias("size")).join(known, "id").withColumn("order", F.xxhash64("id"))
    chosen = []
    for c in (0, 1):
        of_class = named.filter(F.col("toxic") == c).groupBy("order", "id", "toxic").agg(F.max("size").alias("size"))
        room = most_bytes // 2
        for r in of_class.filter(F.col("size") <= room).orderBy("order", "id").limit(most_rows // 2).collect():
            room -= r.size
            if room < 0:
                break
            chosen.append(r)
    ids = docs.sparkSession.createDataFrame([(r.id, int(r.toxic), r.order) for r in chosen], "id long, toxic int, order long")
    texts = rows.join(F.broadcast(ids), "id").groupBy("order", "id", "toxic").agg(F.min("text").alias("text"))  # most_rows ids
    found = sorted(texts.collect(), key=lambda r: (r.order, r.id))
    return [r.text for r in found], [r.toxic for r in found]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2400, most_bytes: int = 6 << 20) -> Model:
    """Fit on at most ``most_rows`` labelled documents and ``most_bytes`` of text, the documented bound of the sample."""
    model = learn(*training_rows(docs, labels, most_rows, most_bytes))
    release()
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (double), ``worst_sentence`` (int, -1 without any), ``worst_text``,
    ``worst_score``.

    The score is the noisy-or of the sentences with the odds lowered by the model's leak, so a long text needs more evidence than a short one.
    Only the text is read for the score, so repeated rows score alike.  Null or empty text scores 0.  Whole texts are scored,
    of any length, with some 30 times a text's size in memory.  Columns of these names in ``docs`` are replaced.  An empty
    table gives an empty result.  Without labels of both classes every text with a word has the model's bias alone.
    """
    new = "toxicity double, worst_sentence int, worst_text string, worst_score double"
    names = [x.split()[0] for x in new.split(", ")]
    kept = docs.drop(*names)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    at, out_names = kept.columns.index(text_col), [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        named = (batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]) for batch in batches)
        for part in slices(named, f"c{at}"):
            total, place, where, worst = model.score(part.column(at))
            new_columns = [pa.array(total), pa.array(place, pa.int32()), pa.array(where, pa.string()), pa.array(worst)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new_columns], out_names)

    schema = StructType([*kept.schema.fields, *StructType.fromDDL(new).fields])
    return kept.mapInArrow(run, schema)
