"""Interpolated modified Kneser-Ney language model of word bigrams.

Counting is one job with two shuffles.  Tasks turn documents into sorted, pre-counted runs of bigrams, packed as a few binary
rows per task and shard instead of a row per bigram.  A shard is a range of first-word hashes crossed with some bits of the
second word, so that the contexts of a very common word are spread over many shards.  Each shard merges its runs, stores its
bigrams as a sorted hash array with one-byte counts in the shared folder, and passes on sums per word; word shards merge
those and store a sorted hash array too.  Scoring tasks memory-map the arrays and look sorted queries up, so pages are
touched in order and shared by all workers of a machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir

#: Tokens counted before a run is sorted and sent, and tokens scored at once.  They bound a task's memory, not its input.
RUN = 1_500_000
SPREAD_BITS = 4
#: White space cannot be part of a token, so no token has these hashes' names.
BEGIN, END = xxhash.xxh64_intdigest(b" begin"), xxhash.xxh64_intdigest(b" end")
#: What is stored of a word: its bigrams as first word (all, distinct ones with counts 1, 2, 3 or more), words before it, count.
WORD = ("total", "n1", "n2", "n3", "before", "count")
#: Text a shard of bigrams and one of words may stand for: their counts are merged in one task's memory.
SHARD_BYTES, WORD_SHARD_BYTES = 1 << 26, 1 << 28


class _Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


def _tokens(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashes of the text's tokens and its end."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(tokens) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    out[-1] = END
    return out


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ second >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _pack(counts: np.ndarray, kind=np.uint8) -> tuple[bytes, bytes]:
    """Counts in a narrow kind, with its largest value for those listed in the second part as (position, count)."""
    top = np.iinfo(kind).max
    large = np.flatnonzero(counts >= top)
    return np.minimum(counts, top).astype(kind).tobytes(), np.stack([large, counts[large]], 1).astype("<i8").tobytes()


def _unpack(small: bytes, large: bytes, kind=np.uint8) -> np.ndarray:
    out = np.frombuffer(small, kind).astype(np.int64)
    place = np.frombuffer(large, "<i8").reshape(-1, 2)
    out[place[:, 0]] = place[:, 1]
    return out


def _sum_by(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order (the first of keys leads) and the sums of each of values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


RUNS = "shard int, firsts binary, repeats binary, seconds binary, small binary, large binary"


def _count_runs(shards: int):
    bits = shards.bit_length() - 1
    high, low = bits - min(SPREAD_BITS, bits), min(SPREAD_BITS, bits)

    def send(words: list[np.ndarray]):
        second = np.concatenate(words)
        first = np.empty_like(second)
        first[1:], first[0] = second[:-1], BEGIN
        first[np.cumsum([len(w) for w in words])[:-1]] = BEGIN
        (first, second), (count,) = _sum_by([first, second], [np.ones(len(first), np.int64)])
        shard = np.zeros(len(first), np.int64)
        if high:
            shard = (first >> np.uint64(64 - high)).astype(np.int64)
        shard = shard << low | (second >> np.uint64(64 - low)).astype(np.int64) if low else shard
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = {k: [] for k in ("shard", "firsts", "repeats", "seconds", "small", "large")}
        for s in range(shards):
            at = order[cuts[s] : cuts[s + 1]]
            if not len(at):
                continue
            f = first[at]
            new = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            small, large = _pack(count[at])
            values = (s, f[new].tobytes(), np.diff(np.r_[new, len(f)]).astype(np.uint32).tobytes(), second[at].tobytes(), small, large)
            for k, v in zip(rows, values, strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32())] + [pa.array(rows[k], pa.binary()) for k in list(rows)[1:]], list(rows))

    def run(batches):
        hashes, words, n = _Hashes(), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words.append(_tokens(batch.column(0)[i].as_py(), hashes))
                n += len(words[-1])
                if n >= RUN:
                    yield from send(words)
                    words, n = [], 0
        if words:
            yield from send(words)

    return run


def _write(folder: str, name: str, data: np.ndarray) -> None:
    """Stores the array under its name; equal attempts replace each other whole."""
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(data).tobytes())
    system.move(part, f"{path}/{name}")


def _map(folder: str, name: str, kind) -> np.ndarray:
    """The stored array, memory-mapped; from a store without local paths it is fetched to an unlinked local file first."""
    system, path = pafs.FileSystem.from_uri(folder)
    where = f"{path}/{name}"
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(where, kind, "r") if os.path.getsize(where) else np.zeros(0, kind)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(where) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, kind, "r") if copy.tell() else np.zeros(0, kind)


PARTS = "shard int, words binary, small binary, large binary, tally binary"


def _merge_runs(folder: str, word_shards: int):
    """Runs of whole shards in shard order -> the shard's stored bigrams, and sums per word for the word shards."""
    bits = word_shards.bit_length() - 1

    def finish(shard: int, runs: list[tuple]):
        firsts = np.concatenate([np.repeat(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.uint32)) for r in runs])
        seconds = np.concatenate([np.frombuffer(r[2], np.uint64) for r in runs])
        counts = np.concatenate([_unpack(r[3], r[4]) for r in runs])
        (firsts, seconds), (counts,) = _sum_by([firsts, seconds], [counts])
        keys = bigram_keys(firsts, seconds)
        order = np.argsort(keys)
        small, large = _pack(counts[order])
        _write(folder, f"bigram-{shard}.keys", keys[order])
        _write(folder, f"bigram-{shard}.small", np.frombuffer(small, np.uint8))
        _write(folder, f"bigram-{shard}.large", np.frombuffer(large, "<i8"))
        one = np.ones(len(counts), np.int64)
        (f,), left = _sum_by([firsts], [counts, (counts == 1) * one, (counts == 2) * one, (counts >= 3) * one])
        (s,), right = _sum_by([seconds], [one, counts])
        words, n = np.concatenate([f, s]), len(f)
        values = np.zeros((len(words), 6), np.int64)
        values[:n, :4] = np.stack(left, 1)
        values[n:, 4:] = np.stack(right, 1)
        (words,), sums = _sum_by([words], list(values.T))
        values = np.stack(sums, 1)
        tally = np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(counts)], "<i8").tobytes()
        at = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        cuts = np.searchsorted(at, np.arange(word_shards + 1))  # words are in order, and so are their shards
        full = [w for w in range(word_shards) if cuts[w + 1] > cuts[w]]
        small, large = zip(*(_pack(values[cuts[w] : cuts[w + 1]].ravel(), np.uint32) for w in full), strict=True)
        columns = [[words[cuts[w] : cuts[w + 1]].tobytes() for w in full], small, large, [tally] + [b""] * (len(full) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32())] + [pa.array(c, pa.binary()) for c in columns], ["shard", "words", "small", "large", "tally"])

    return _by_shard(finish)


def _by_shard(finish):
    """Rows in shard order, first column the shard -> what finish makes of each shard's rows."""

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != shard and held:
                    yield from finish(shard, held)
                    held = []
                shard = row[0]
                held.append(row[1:])
        if held:
            yield from finish(shard, held)

    return run


STATS = "words long, tokens long, bigrams array<long>, before array<long>, known long"


def _merge_words(folder: str):
    def finish(shard: int, rows: list[tuple]):
        words = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        values = np.concatenate([_unpack(r[1], r[2], np.uint32).reshape(-1, len(WORD)) for r in rows])
        tally = sum((np.frombuffer(r[3], "<i8") for r in rows if r[3]), np.zeros(5, np.int64))
        (words,), sums = _sum_by([words], list(values.T))
        small, large = _pack(np.stack(sums, 1).ravel(), np.uint32)
        _write(folder, f"word-{shard}.keys", words)
        _write(folder, f"word-{shard}.small", np.frombuffer(small, np.uint8))
        _write(folder, f"word-{shard}.large", np.frombuffer(large, "<i8"))
        before, count = sums[4], sums[5]
        tallies = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int(before.sum()), int((before >= 3).sum())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(words)]), pa.array([int(count.sum())]), pa.array([tally.tolist()], pa.list_(pa.int64())), pa.array([tallies], pa.list_(pa.int64())), pa.array([int((count > 0).sum())])],
            ["words", "tokens", "bigrams", "before", "known"],
        )

    return _by_shard(finish)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        found.append(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) if a else 0.5 * k)
    return tuple(found)


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    word_shards: int
    tokens: int  # all training tokens, ends included
    known: int  # distinct ones
    discount: tuple[float, float, float]
    types: int  # distinct bigrams
    low: tuple[float, float, float]  # discounts of the numbers of preceding words
    rest: float  # share of the unigram level left for the uniform one


def fit(texts: DataFrame) -> Model:
    """Counts the single string column of texts.  An empty table gives a model with no tokens."""
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    shards = 1 << max(SPREAD_BITS, (max(2 * width, size // SHARD_BYTES) - 1).bit_length())
    word_shards = 1 << (max(width, size // WORD_SHARD_BYTES) - 1).bit_length()
    tasks = max(width, shards // 4)
    folder = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    runs = texts.mapInArrow(_count_runs(shards), RUNS)
    parts = runs.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_merge_runs(folder, word_shards), PARTS)
    stats = parts.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(_merge_words(folder), STATS).collect()
    total = lambda get: sum((np.array(get(r), np.int64) for r in stats), np.zeros_like(get(stats[0]))) if stats else None
    bigrams = [int(x) for x in total(lambda r: r["bigrams"])] if stats else [0] * 5
    before = [int(x) for x in total(lambda r: r["before"])] if stats else [0] * 6
    low = discounts(before[:4])
    rest = (low[0] * before[0] + low[1] * before[1] + low[2] * before[5]) / before[4] if before[4] else 1.0
    return Model(folder, shards, word_shards, sum(r["tokens"] for r in stats), sum(r["known"] for r in stats), discounts(bigrams[:4]), before[4], low, rest)


class Reader:
    """The mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.maps: dict[tuple, np.ndarray | None] = {}
        system, path = pafs.FileSystem.from_uri(model.folder)
        found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        self.names = {f.base_name for f in found}

    def _get(self, name: str, kind):
        if name not in self.maps:
            self.maps[name] = _map(self.model.folder, name, kind) if name in self.names else np.zeros(0, kind)
        return self.maps[name]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def words(self, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Values of words given by ascending hashes; zeros for unknown ones."""
        out = np.zeros((len(wanted), len(WORD)), np.int64)
        bits = self.model.word_shards.bit_length() - 1
        shard = (wanted >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(wanted), np.int64)
        cuts = np.searchsorted(shard, np.arange(self.model.word_shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[s], cuts[s + 1]
            at, hit = self._find(self._get(f"word-{s}.keys", np.uint64), wanted[a:b])
            if not hit.any():
                continue
            found = self._get(f"word-{s}.small", np.uint32).reshape(-1, len(WORD))[at[hit]].astype(np.int64)
            if (big := np.argwhere(found == 0xFFFFFFFF)).size:
                large = np.asarray(self._get(f"word-{s}.large", "<i8")).reshape(-1, 2)
                where = at[hit][big[:, 0]] * len(WORD) + big[:, 1]
                found[big[:, 0], big[:, 1]] = large[np.searchsorted(large[:, 0], where), 1]
            out[a:b][hit] = found
        return dict(zip(WORD, out.T, strict=True))

    def bigrams(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of bigrams; each is looked up once."""
        bits = self.model.shards.bit_length() - 1
        high, low = bits - min(SPREAD_BITS, bits), min(SPREAD_BITS, bits)
        key = bigram_keys(first, second)
        shard = (first >> np.uint64(64 - high)).astype(np.int64) if high else np.zeros(len(first), np.int64)
        shard = shard << low | (second >> np.uint64(64 - low)).astype(np.int64) if low else shard
        order = np.argsort(key)
        order = order[np.argsort(shard[order], kind="stable")]
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        out = np.zeros(len(first), np.int64)
        for s in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[s] : cuts[s + 1]]
            at, hit = self._find(self._get(f"bigram-{s}.keys", np.uint64), key[mine])
            if not hit.any():
                continue
            found = self._get(f"bigram-{s}.small", np.uint8)[at[hit]].astype(np.int64)
            if (big := np.flatnonzero(found == 255)).size:
                large = np.asarray(self._get(f"bigram-{s}.large", "<i8")).reshape(-1, 2)
                found[big] = large[np.searchsorted(large[:, 0], at[hit][big]), 1]
            out[mine[hit]] = found
        return out


def score_tokens(words: list[np.ndarray], reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base log10 probability, model log10 probability) of each text, from its token hashes."""
    m = reader.model
    sizes = np.array([len(w) for w in words])
    text = np.repeat(np.arange(len(words)), sizes)
    second = np.concatenate(words)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(sizes) - sizes] = BEGIN
    names, of = np.unique(np.concatenate([second, np.array([BEGIN], np.uint64)]), return_inverse=True)
    table = reader.words(names)
    of_second = of[:-1]
    of_first = np.empty_like(of_second)
    of_first[1:] = of_second[:-1]
    of_first[np.cumsum(sizes) - sizes] = of[-1]
    d = np.array([0.0, *m.discount])
    low = np.array([0.0, *m.low])
    before = table["before"].astype(np.float64)
    unigram = np.maximum(before - low[np.minimum(table["before"], 3)], 0) / max(m.types, 1) + m.rest / (m.known + 1)
    total = table["total"].astype(np.float64)
    share = np.where(total > 0, (d[1] * table["n1"] + d[2] * table["n2"] + d[3] * table["n3"]) / np.maximum(total, 1), 1.0)
    pair, back = np.unique(of_first * np.int64(len(names)) + of_second, return_inverse=True)
    f, s = pair // len(names), pair % len(names)
    count = reader.bigrams(names[f], names[s])
    p = np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(total[f], 1) + share[f] * unigram[s]
    raw = table["count"].astype(np.float64)
    base = np.log10((raw + 0.1) / (m.tokens + 0.1 * (m.known + 1)))
    add = lambda v: np.bincount(text, weights=v, minlength=len(words))
    return add((raw > 0)[of_second].astype(float)).astype(np.int64), add(base[of_second]), add(np.log10(p)[back])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score per row of docs (doc_id, text); null texts are empty."""

    def run(batches):
        reader, hashes = Reader(model), _Hashes()
        for batch in batches:
            ids, low = batch.column("doc_id"), 0
            words, n = [], 0
            for i in range(batch.num_rows):
                words.append(_tokens(batch.column("text")[i].as_py(), hashes))
                n += len(words[-1])
                if n >= RUN or i == batch.num_rows - 1:
                    known, base, own = score_tokens(words, reader)
                    sizes = np.array([len(w) for w in words], np.int64)
                    yield pa.RecordBatch.from_arrays([ids.slice(low, len(words)), pa.array(sizes), pa.array(known), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                    low, words, n = i + 1, [], 0

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Fits on documents whose crc32(doc_id) mod 10 is not 0 and scores all.

    A null doc_id is trained on (it has no remainder); repeated rows count each; an empty table gives no rows.
    """
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    model = fit(docs.filter(~held).select(F.col("text").cast("string")))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
