"""Maximal periodic runs of words: every shift of a text's word ids is compared with the ids themselves.

For lag q the ids are compared with themselves q places on; a stretch of m equal places is a run of m + q words with
period q.  A run counts if it is at least max(min_len, min_exp * q) words long, its smallest period is q and no
neighbouring word extends it.  Lags go up to n / min_exp, so a text of n words costs n * n / min_exp comparisons: texts
of up to LIGHT_BYTES are scanned where they are read, longer ones are dealt out in pieces of about PIECE comparisons,
each a range of lags with the word ids, and the runs found are joined to their text again.

Null and empty texts have no words and no runs.  Repeated rows give repeated results.  Equal words, however many, are
one run with period 1.  An empty table gives an empty one; columns other than text and those in keep are ignored, and
only names in keep are returned, beside the result's n_words, runs and collapsed, which must not be in keep.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_EXP, MIN_LEN = 4, 6
#: Longer texts are dealt out by lags.
LIGHT_BYTES = 65_536
#: Comparisons in a piece; a text has at most PIECES of them, since each carries its ids.
PIECE, PIECES = 1 << 28, 1024
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, in the narrowest type."""
    seen: dict[bytes, int] = {}
    found = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(found, np.min_scalar_type(max(len(seen) - 1, 0)))


def _prime_factors(q: int) -> list[int]:
    found, f = [], 2
    while f * f <= q:
        if q % f == 0:
            found.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return [*found, q] if q > 1 else found


def scan(ids: np.ndarray, low: int, high: int, min_exp: int = MIN_EXP, min_len: int = MIN_LEN) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with a period of low to high - 1.

    A smaller period of a stretch of at least two periods q divides q, so q is the smallest if no q / f with f prime is one.
    """
    found = []
    for q in range(low, min(high, len(ids) // min_exp + 1)):
        equal, need = ids[q:] == ids[:-q], max(min_len, min_exp * q) - q
        if np.count_nonzero(equal) < need:
            continue
        edges = np.flatnonzero(np.diff(equal, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        for s, e in zip(starts[long := ends - starts >= need].tolist(), ends[long].tolist(), strict=True):
            run = ids[s : e + q]
            if not any(np.array_equal(run[d:], run[:-d]) for d in (q // f for f in _prime_factors(q))):
                found.append((s, e + q - s, q))
    return found


def collapse(words: list[bytes], runs) -> bytes:
    """The words but those that any run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    ends = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        ends[start + period] += 1
        ends[start + length] -= 1
    covered = np.cumsum(ends)[:-1] > 0
    return b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


def _arrow(columns, texts: list, found: list):
    """A batch of kept columns, n_words, runs and collapsed from lists of words and of runs."""
    import pyarrow as pa

    flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)
    n_words = pa.array([len(w) for w in texts], pa.int64())
    collapsed = pa.array([collapse(w, r) for w, r in zip(texts, found, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, n_words, lists, collapsed], [*[f"k{i}" for i in range(len(columns))], "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", prepare: Callable | None = None, prepare_by: str | None = None) -> DataFrame:
    """keep with n_words, runs (by start, then period) and collapsed (see collapse) of every row's text.

    prepare, if given, maps (words, value of column prepare_by) to the words to scan; both are given or neither.
    """
    import pyarrow as pa

    n, names = len(keep), [f"k{i}" for i in range(len(keep))]
    by = F.col(f"`{prepare_by}`") if prepare_by else F.lit(None).cast("int")
    source = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], by.alias("by"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("t")
    )
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in names)
    schema = ", ".join(x for x in (kinds, f"n_words bigint, runs {RUNS}, collapsed binary") if x)

    def words_of(batch) -> list[list[bytes]]:
        texts = [t.split() for t in batch.column("t").to_pylist()]
        return texts if prepare is None else [prepare(w, b) for w, b in zip(texts, batch.column("by").to_pylist(), strict=True)]

    def slices(batches, rows):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                yield batch.slice(low, rows)

    def whole(batches):
        for part in slices(batches, 512):
            texts = words_of(part)
            found = [sorted(scan(word_ids(w), 1, len(w) // MIN_EXP + 1), key=lambda r: (r[0], r[2])) for w in texts]
            yield _arrow([part.column(i) for i in range(n)], texts, found)

    def deal(batches):
        for part in slices(batches, 1):
            ids, key = word_ids(words_of(part)[0]), part.column("key")
            lags = len(ids) // MIN_EXP
            step = -(-max(lags, 1) // min(PIECES, max(1, -(-len(ids) * lags // PIECE))))
            for low in range(1, lags + 1, step):
                yield pa.RecordBatch.from_arrays([key, pa.array([low], pa.int64()), pa.array([low + step], pa.int64()), pa.array([ids.itemsize], pa.int32()), pa.array([ids.tobytes()], pa.binary())], ["key", "low", "high", "width", "ids"])

    def scan_pieces(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                key, low, high, width, ids = (batch.column(c)[row].as_py() for c in ("key", "low", "high", "width", "ids"))
                found = np.array(scan(np.frombuffer(ids, f"u{width}"), low, high), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), *[pa.array(found[:, i]) for i in range(3)]], ["key", "start", "length", "period"])

    def finish(batches):
        for part in slices(batches, 16):
            runs = [sorted(((r["start"], r["length"], r["period"]) for r in found or ()), key=lambda r: (r[0], r[2])) for found in part.column("found").to_pylist()]
            yield _arrow([part.column(i) for i in range(n)], words_of(part), runs)

    light = source.filter(F.octet_length("t") <= LIGHT_BYTES).mapInArrow(whole, schema)
    heavy = materialize(source.filter(F.octet_length("t") > LIGHT_BYTES).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = heavy.mapInArrow(deal, "key bigint, low bigint, high bigint, width int, ids binary").repartition(spread, "key", "low")
    runs = pieces.mapInArrow(scan_pieces, "key bigint, start bigint, length bigint, period bigint")
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))  # fewer than its text's words
    out = light.unionByName(heavy.join(runs, "key", "left").select(*names, "by", "t", "found").mapInArrow(finish, schema))
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def digest(runs: DataFrame, keep: list[str]) -> DataFrame:
    """keep with the number of runs, the longest one (then the first, then of the smallest period), and hashes of find_runs()'s results."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = runs.withColumn("best_", best)
    length, period = F.col("best_.length"), -F.col("best_.period")
    return found.select(
        *keep, F.size("runs").cast("long").alias("n_runs"), (-F.col("best_.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best_.length) div (-best_.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
