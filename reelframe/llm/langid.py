"""Language identification with a blended-spectrum presence kernel.

k(x, z) is the number of character n-grams (n = 1 to 4) that both texts contain, over the root of both texts' own numbers.
Nystroem features over landmark texts and one-versus-rest kernel ridge regression reduce to one coefficient matrix, so a
batch is scored by two matrix products: presence by landmarks, kernel rows by coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import annotate, crc_mod, hash_order

ORDERS = 4
BINS = 1 << 15
#: Training rows and landmarks per language, the first by a hash of doc_id.  Documented bounds.
PER_LANG, LANDMARKS = 400, 16
RIDGE = 1e-3
#: Odd multipliers that mix the characters of an n-gram.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(float32 matrix of 0 and 1 by text and n-gram bin, letters per text); runs of other characters count as one space."""
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    out = np.zeros((len(texts), BINS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    if not points:
        return out, letters
    code = np.concatenate(points)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in points])
    is_letter = _letters()[code]
    np.add.at(letters, row[is_letter], 1) if len(code) < 64 else letters.__iadd__(np.bincount(row[is_letter], minlength=len(texts)))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
    code, row = np.where(is_letter, code, 32)[keep].astype(np.uint64), row[keep]
    flat, mixed = out.reshape(-1), np.zeros(len(code), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        mixed = mixed[: len(code) - n + 1] + code[n - 1 :] * _MIX[n - 1]
        bins = (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 15)).astype(np.int64)
        same = row[n - 1 :] == row[: len(row) - n + 1]
        flat[(row[: len(bins)].astype(np.int64) * BINS + bins)[same]] = 1
    return out, letters


@dataclass(frozen=True)
class Model:
    langs: list[str]
    landmarks: np.ndarray  # BINS x m, columns scaled to norm 1
    beta: np.ndarray  # m x languages
    floor: float = 0.0  # scores below speak for no language: see floor_of


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return present @ landmarks / np.sqrt(np.maximum(present.sum(1, dtype=np.float64), 1))[:, None].astype(np.float32)


def fit_texts(texts: list[str], langs: list[str], per_lang: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on texts in the given order; the first texts of each language become landmarks.  No text: no language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BINS, 1), np.float32), np.zeros((1, 0), np.float32))
    seen: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_lang:
            chosen.append(i)
    rows = presence([texts[i] for i in chosen])[0]
    land = np.ascontiguousarray((rows / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]).T)
    k = np.vstack([kernel(presence(texts[i : i + 256])[0], land) for i in range(0, len(texts), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh((land.T @ land).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(names, land, (root @ solved).astype(np.float32))


def floor_of(texts: list[str], langs: list[str]) -> float:
    """A score below which no text of the training rows lies, by half: each half of them is scored by a model of the other.

    A text that shares nothing with the landmarks scores one half, whatever its language; the floor lies midway between that
    and the lowest score of a training text with letters, and is 0 if that score is no higher, or a half has no model.
    """
    lowest = 1.0
    for k in (0, 1):
        model = fit_texts(texts[k::2], langs[k::2])
        if len(model.langs) < len(set(langs)):
            return 0.0
        for i in range(1 - k, len(texts), 512):
            present, letters = presence(texts[i : i + 512 : 2])
            best = (kernel(present, model.landmarks) @ model.beta).max(1)
            lowest = min([lowest, *((best[letters > 0].astype(np.float64) + 1) / 2).tolist()])
    return (0.5 + lowest) / 2 if lowest > 0.5 else 0.0


def fit(docs: DataFrame, per_lang: int = PER_LANG, with_floor: bool = False) -> Model:
    """Fits on documents with a language whose crc32(doc_id) mod 5 is not 0, at most per_lang of each language.

    The choice ranks ids only (Spark keeps per_lang of each language before it shuffles); then the chosen texts are read, of
    several with one doc_id and language the smallest.  with_floor also validates a floor for scores within these rows.
    """
    usable = docs.select(F.col("doc_id").cast("long"), "lang", "text")
    usable = usable.filter("doc_id is not null and lang is not null and lang <> '' and text is not null").filter(crc_mod("doc_id", 5) != 0)
    place = W.partitionBy("lang").orderBy(hash_order("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_lang)
    chosen = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, lang string, place int")
    rows = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("place").alias("place"), F.min("text").alias("text")).toArrow()
    rows = sorted(zip(*[rows[c].to_pylist() for c in ("place", "lang", "doc_id", "text")], strict=True))
    texts, langs = [r[3] for r in rows], [r[1] for r in rows]
    model = fit_texts(texts, langs)
    return replace(model, floor=floor_of(texts, langs)) if with_floor else model


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The keep columns with the predicted language and its score (0 to 1).

    Null texts and texts without a letter are 'und' with score 0; so is everything if nothing was learned.  Repeated rows get
    repeated results, an empty table gives an empty one; other columns are ignored, and lang_col and score_col must not be
    in keep.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.landmarks, model.beta))  # BINS x landmarks floats

    def make():
        langs, land, beta = sent.value

        def chunks(texts):
            part, size = [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size >= 400_000 or len(part) >= 128:
                    yield part
                    part, size = [], 0
            if part:
                yield part

        def work(texts):
            names, scores = [], []
            for part in chunks(texts):
                present, letters = presence(part)
                if not langs:
                    names += ["und"] * len(part)
                    scores.append(np.zeros(len(part)))
                    continue
                f = kernel(present, land) @ beta
                best = f.argmax(1)
                names += [langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
                scores.append(np.where(letters > 0, np.clip((f[np.arange(len(part)), best].astype(np.float64) + 1) / 2, 0, 1), 0.0))
            return [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]

        return work

    return annotate(docs, text, keep, [(lang_col, "string"), (score_col, "double")], make)
