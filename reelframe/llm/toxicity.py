"""Counterfactually regularised toxicity classifier.

A sparse logistic regression over which words and word beginnings a text contains.  For every labelled sentence that names
a group, the group is swapped for others, and the squared change of the score is added to the loss, so that a neutral
mention of a group carries no weight of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, crc_mod, hash_order

#: Labelled rows that a fit may use: the first so many by a hash of doc_id.  A documented bound.
TRAIN_BOUND = 10_000
BINS = 1 << 22
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: Identity terms, each line a set within which terms are exchanged.
IDENTITY = [
    ["women", "men", "girls", "boys", "females", "males"],
    ["woman", "man", "girl", "boy", "female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "african", "arab", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["immigrant", "refugee", "foreigner", "native", "citizen"],
    ["disabled", "blind", "deaf", "elderly", "young", "old"],
    ["disabilities", "blindness", "deafness"],
    ["americans", "mexicans", "chinese", "indians", "russians", "turks", "poles", "nigerians", "germans", "french"],
    ["frauen", "männer"], ["muslime", "christen", "juden", "hindus"], ["schwarze", "weiße", "asiaten"], ["flüchtlinge", "ausländer", "einwanderer", "einheimische"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos", "asiáticos", "latinos"], ["inmigrantes", "refugiados", "extranjeros"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs", "asiatiques", "arabes"], ["immigrés", "réfugiés", "étrangers"],
]
_SWAP = {word: [w for w in line if w != word] for line in IDENTITY for word in line}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    names = [b"w" + word.encode("utf-8", "surrogatepass")] + [f"p{word[:k]}".encode("utf-8", "surrogatepass") for k in PREFIXES if len(word) > k]
    return [xxhash.xxh64_intdigest(x) % BINS for x in names]


class _TokenFeatures(dict):
    """From a token between white space to the features of its words; forgets all when it grows too large."""

    def __init__(self, wanted=None, most=500_000):
        super().__init__()
        self.wanted, self.most = wanted, most

    def __missing__(self, token: bytes):
        found = tuple(dict.fromkeys(f for w in _WORD.findall(token.decode("utf-8", "replace").lower()) for f in word_features(w)))
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted)
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found


def text_features(text: str | None, cache: _TokenFeatures) -> set[int]:
    found: set[int] = set()
    for hit in map(cache.__getitem__, set((text or "").encode("utf-8", "surrogatepass").lower().split())):
        if hit:
            found.update(hit)
    return found


def counterfactuals(text: str | None) -> list[tuple[str, str]]:
    """(sentence, sentence with its identity terms exchanged) for each sentence that has any, one per replacement turn."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        if any(w in _SWAP for w in _WORD.findall(sentence)):
            for turn in range(3):
                swapped = _WORD.sub(lambda m, turn=turn: (s := _SWAP.get(m[0])) and s[turn % len(s)] or m[0], sentence)
                out.append((sentence, swapped))
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


def _soft(x, by):
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def fit_arrays(features, labels, pairs, l1=2e-5, l2=1e-5, fairness=1.0, rounds=300) -> Model:
    """features: an int array per text; labels 0 or 1; pairs: (array, array) per original and swapped sentence.

    Minimises log loss + l1 |w| + l2 w^2 / 2 + fairness * mean squared score change over pairs, by accelerated proximal
    gradient.  No row, or one class only: the smoothed base rate.
    """
    y = np.asarray(labels, float)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return Model(base, {})
    # Features of one text are distinct, so counts grow by plain indexing, text by text, without one array of all of them.
    pos, all_ = np.zeros(BINS), np.zeros(BINS)
    for f, label in zip(features, y, strict=True):
        all_[f] += 1
        if label:
            pos[f] += 1
    rate = y.mean()
    # Features too rare or too even to get past the l1 term are left out at once.
    chi = (pos - rate * all_) ** 2 / np.maximum(all_ * rate * (1 - rate), 1e-9)
    used = np.flatnonzero((all_ >= 3) & (chi >= 6))
    if not len(used):
        return Model(base, {})
    to = np.full(BINS, -1, np.int32)
    to[used] = np.arange(len(used))
    kept = [t[t >= 0] for t in (to[f] for f in features)]
    col, row = np.concatenate(kept), np.repeat(np.arange(len(y), dtype=np.int32), [len(k) for k in kept])
    pc, pr, pv = [], [], []
    for i, (a, b) in enumerate(pairs):
        for f, v in [(f, 1.0) for f in a] + [(f, -1.0) for f in b]:
            if to[f] >= 0:
                pc.append(to[f]), pr.append(i), pv.append(v)
    pc, pr, pv = np.array(pc, np.int64), np.array(pr, np.int64), np.array(pv)
    n, d, m = len(y), len(used), max(len(pairs), 1)
    lipschitz = 0.25 * max(np.bincount(row, minlength=n).mean(), 1) + l2 + (2 * fairness * np.bincount(pr).max() if len(pr) else 0)
    step = 4.0 / lipschitz
    w, b, t = np.zeros(d), base, 1.0
    u, c = w.copy(), b

    def loss(w, b):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        fair = np.bincount(pr, weights=pv * w[pc], minlength=m) if len(pr) else np.zeros(1)
        return z, fair, np.mean(np.logaddexp(0, z) - y * z) + l2 * (w @ w) / 2 + fairness * np.sum(fair**2) / m

    for _ in range(rounds):
        z, fair, value = loss(u, c)
        err = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, weights=err[row], minlength=d) + l2 * u
        if len(pr):
            grad += np.bincount(pc, weights=2 * fairness * pv * fair[pr] / m, minlength=d)
        gb = err.sum()
        while True:  # backtracking
            w2, b2 = _soft(u - step * grad, step * l1), c - step * gb
            dw, db = w2 - u, b2 - c
            if loss(w2, b2)[2] <= value + grad @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t, step = w2, b2, t2, step * 1.5
    on = np.flatnonzero(w)
    return Model(float(b), dict(zip(used[on].tolist(), w[on].tolist(), strict=True)))


def _training_batches(batches):
    cache = _TokenFeatures()
    pack = lambda f: np.fromiter(f, np.uint32, len(f)).tobytes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        own = [pack(text_features(t, cache)) for t in texts]
        pairs = [[x for a, b in counterfactuals(t) for x in (pack(text_features(a, cache)), pack(text_features(b, cache)))] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, pa.binary()), pa.array(pairs, pa.list_(pa.binary()))], ["label", "own", "pairs"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND, fairness: float = 1.0) -> Model:
    """Fits on labelled rows whose crc32(doc_id) mod 3 is not 1, at most bound of them (the first by a hash of doc_id).

    fairness weighs the penalty on score changes when groups are exchanged.

    Rows without doc_id or label are no examples; a document labelled twice counts once, as toxic if any label says so; of
    several texts with one doc_id the smallest counts.
    """
    spark = docs.sparkSession
    usable = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), "toxic")
    usable = usable.filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    ids = usable.orderBy(hash_order("doc_id"), "doc_id").limit(bound).collect()
    chosen = spark.createDataFrame(ids, "doc_id long, label int")
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    joined = joined.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    rows = joined.mapInArrow(_training_batches, "label int, own binary, pairs array<binary>").toArrow()
    read = lambda x: np.frombuffer(x, np.uint32)
    order = sorted(zip(rows["own"].to_pylist(), rows["label"].to_pylist(), rows["pairs"].to_pylist(), strict=True), key=lambda r: r[:2])
    pairs = [(read(p[i]), read(p[i + 1])) for _, _, p in order for i in range(0, len(p), 2)]
    return fit_arrays([read(o) for o, _, _ in order], [v for _, v, _ in order], pairs, fairness=fairness)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The keep columns with the score (0 to 1) and its decision at 0.7; a null or empty text gets the score of no evidence.

    Repeated rows get repeated scores, an empty table gives an empty one; other columns are ignored, and score_col and
    predicted_col must not be in keep.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # bounded: only weights that l1 left

    def make():
        bias, weights = sent.value
        cache = _TokenFeatures(frozenset(weights))

        def work(texts):
            z = np.array([bias + sum(weights[f] for f in sorted(text_features(t, cache))) for t in texts])
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]

        return work

    return annotate(docs, text, keep, [(score_col, "double"), (predicted_col, "int")], make)
