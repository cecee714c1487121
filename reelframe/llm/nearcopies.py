"""Near copies by five-word shingles, for the pipeline: MinHash bands propose pairs, the exact Jaccard similarity decides.

Two texts whose shingle sets are 0.8 alike miss each other in all 30 bands of 5 minima with probability 7e-6, and more
alike ones more rarely.  A group that shares a band is first tied to its most frequent text.  What is then outside the group's
largest component is compared with the whole group by products of matrices: the group is dealt to blocks, each text to one,
and only the texts outside go to all blocks.  So a group of G shingles with O of them outside shuffles about
G + O * G / SHINGLES of them, O * G / SHINGLES twice over where O is more than a block; no pairs are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize
from .components import connected_components

WORDS, BANDS, ROWS = 5, 30, 5
#: Shingles of a block of texts, and cells of a matrix: bounds of a task's memory.
SHINGLES, CELLS = 1_000_000, 1 << 24
_random = np.random.default_rng(simhash.SEED)
FLIP = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
TIMES = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FOLD = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def band_keys(lists: list[list[int]]) -> list[np.ndarray]:
    """For each non-empty list of shingle hashes one key per band: equal where all minima of the band are."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    if not len(lists):
        return []
    flat = np.fromiter((h >> 32 for x in lists for h in x), np.uint32, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    low = [np.minimum.reduceat((flat ^ c) * a, starts) for c, a in zip(FLIP, TIMES, strict=True)]
    minima = np.stack(low, axis=1).astype(np.uint64).reshape(len(lists), BANDS, ROWS) + np.uint64(1)
    mixed = (minima * FOLD) ^ (minima * FOLD >> np.uint64(29))
    keys = np.zeros((len(lists), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ mixed[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return list(keys.view(np.int64))


def _print_batches(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = part.column("text").to_pylist()
            lists = [simhash.shingle_hashes(t) for t in texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            fp = simhash.majority(flat, np.cumsum(counts) - counts, counts)
            wide = [simhash.shingle_hashes(t, WORDS) for t in texts]
            keys = iter(band_keys([x for x in wide if x]))
            keys = pa.array([next(keys) if x else [] for x in wide], pa.list_(pa.int64()))
            n = pa.array([len(set(x)) for x in wide], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(fp.view(np.int64)), n, keys], ["doc_id", "t", "fp", "n", "keys"])


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp, n, keys) of each row: hash of the text, op9's fingerprint, number of shingles, band keys."""
    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string"))
    return rows.mapInArrow(_print_batches, "doc_id long, t long, fp long, n int, keys array<long>")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _stars(batches):
    """Rows in the order of (key, t) -> each row but the first of its key, with that first row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, t, fp, n = (batch.column(c).to_numpy() for c in ("key", "t", "fp", "n"))
        if last is not None:
            key, t, fp, n = (np.r_[np.array([x], c.dtype), c] for x, c in zip(last, (key, t, fp, n), strict=True))
        first = np.r_[True, key[1:] != key[:-1]]
        of = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        last = tuple(c[of[-1]] for c in (key, t, fp, n))
        rest = np.flatnonzero(~first)
        arrays = [key[rest], t[rest], fp[rest], n[rest], t[of[rest]], fp[of[rest]], n[of[rest]]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "t", "fp", "n", "t1", "fp1", "n1"])


def _compare(sizes: np.ndarray, sets: np.ndarray, roots: np.ndarray, home: np.ndarray, outside: np.ndarray):
    """Index pairs of texts with different roots that are at least 0.8 alike: those marked outside against those marked home.

    sets: the texts' shingles one text after the other.  Shingles of one text only cannot be common; of the others a matrix
    of texts by shingles is multiplied with itself, a part at a time.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(sets, kind="stable")
    value, text = sets[order], text[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1 if len(column) else column
    column, text = column[common], text[common]
    used, column = np.unique(column, return_inverse=True)
    by_text = np.argsort(text, kind="stable")
    column, first = column[by_text], np.searchsorted(text[by_text], np.arange(len(sizes) + 1))

    def rows(of: np.ndarray) -> np.ndarray:
        out = np.zeros((len(of), max(len(used), 1)), np.float32)
        n = first[of + 1] - first[of]
        at = np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(of)), n), column[at]] = 1
        return out

    _, part = np.unique(roots, return_inverse=True)
    outside, home = np.flatnonzero(outside), np.flatnonzero(home)
    step = max(1, CELLS // max(len(used), 1))
    for low in range(0, len(outside), step):
        mine = outside[low : low + step]
        left = rows(mine)
        for at in range(0, len(home), step):
            them = home[at : at + step]
            both = left @ rows(them).T
            near = (9 * both >= 4 * (sizes[mine][:, None] + sizes[them][None, :])) & (part[mine][:, None] != part[them][None, :])
            i, j = np.nonzero(near)
            yield mine[i], them[j]


def _across(batches):
    """Rows of whole (key, block, part) in that order, with their texts' shingles -> links between different components."""
    held: list[pa.RecordBatch] = []

    def links():
        table = pa.Table.from_batches(held).combine_chunks()
        h = table.column("h").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
        sizes = pc.list_value_length(h).to_numpy(zero_copy_only=False).astype(np.int64)
        fp, root, home, outside = (table.column(c).to_numpy() for c in ("fp", "root", "home", "outside"))
        found = list(_compare(sizes, pc.list_flatten(h).to_numpy(zero_copy_only=False), root, home, outside))
        if a := [fp[i] for i, _ in found if len(i)]:
            x, y = simhash._forest(np.concatenate(a), np.concatenate([fp[j] for _, j in found if len(j)]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    group = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(c).to_numpy() for c in ("key", "block", "part")])
        cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if group != (now := tuple(of[:, low].tolist())):
                if held:
                    yield from links()
                held, group = [], now
            held.append(batch.slice(low, high - low))
    if held:
        yield from links()


def _set_batches(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            sets = [np.unique(np.array(simhash.shingle_hashes(t, WORDS), np.uint64)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(sets, pa.list_(pa.int64()))], ["t", "h"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) fingerprints of the pairs whose shingle sets are at least 0.8 alike."""
    left, right = sets.select(F.col("t").alias("a"), F.col("h").alias("ha")), sets.select(F.col("t").alias("b"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    found = pairs.join(left, "a").join(right, "b").filter(9 * both >= 4 * (F.size("ha") + F.size("hb")))
    return found.select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct()


def roots(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints linked by op9's two bits or by texts at least 0.8 alike; rows: prints(docs), written."""
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    copies = rows.select("fp").distinct().repartition(width).mapInArrow(simhash._replicate, "anchor int, fp long, home boolean")
    links = copies.repartition(width, "anchor").sortWithinPartitions("anchor").mapInArrow(simhash._links, "a long, b long")

    keyed = rows.filter("n > 0").groupBy("t").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("times"))
    # The text with most copies leads its keys: near copies are mostly nearer to it than to each other.
    keyed = keyed.select(F.explode("keys").alias("key"), "t", "fp", "n", (-F.col("times")).alias("rank"))
    keyed = keyed.repartition(width, "key").sortWithinPartitions("key", "rank", "t").drop("rank")
    met = materialize(keyed.mapInArrow(_stars, "key long, t long, fp long, n int, t1 long, fp1 long, n1 int"), "met")
    members = met.select("key", "t", "fp", "n").union(met.select("key", F.col("t1").alias("t"), F.col("fp1").alias("fp"), F.col("n1").alias("n")).distinct())
    texts = materialize(members.select("t").distinct(), "met-texts")
    sets = docs.select(text_hash().alias("t"), F.col("text").cast("string")).join(texts, "t", "left_semi")
    sets = sets.groupBy("t").agg(F.first("text").alias("text")).mapInArrow(_set_batches, "t long, h array<long>")
    sets = materialize(sets, "sets")

    fits = "fp <> fp1 and 5L * least(n, n1) >= 4L * greatest(n, n1)"
    stars = met.filter(fits).select(F.col("t1").alias("a"), F.col("t").alias("b"), F.col("fp1").alias("fa"), F.col("fp").alias("fb")).distinct()
    links = materialize(links.union(_alike(stars, sets)), "near")
    found = materialize(connected_components(links), "roots")

    split = members.join(found, members["fp"] == found["node"], "left").select("key", "t", "fp", "n", F.coalesce("root", "fp").alias("root"))
    more = materialize(_open_groups(split, sets, width), "near")
    # The components found so far are stars already; only what is new has to be joined to them.
    return materialize(connected_components(found.toDF("a", "b").union(more)), "roots") if more.take(1) else found


def _open_groups(split: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(a, b) fingerprints of alike texts that share a key and are in different components so far.

    split: (key, t, fp, n, root).  A key's texts are dealt to blocks by their hash, as many as its shingles need; those
    outside its largest component go to every block, in as many parts as their own shingles need.  A group of a block and a
    part holds about two million shingles, whatever the corpus.
    """
    own = split.groupBy("key", "root").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    several = own.groupBy("key").agg(F.max_by("root", F.struct("texts", "root")).alias("largest"), F.max_by("n", F.struct("texts", "root")).alias("inside"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    need = lambda n: F.ceil(n / F.lit(SHINGLES)).cast("int")
    several = several.filter("roots > 1").select("key", "largest", need(F.col("n")).alias("blocks"), need(F.col("n") - F.col("inside")).alias("parts"))
    rows = split.join(several, "key").withColumn("out", F.col("root") != F.col("largest"))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "t"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = rows.withColumns({"own_block": deal("blocks", 1), "own_part": deal("parts", 2)})
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    place = lambda b, p: F.struct(b.alias("block"), p.alias("part"))
    # A text meets all parts in its own block; one outside meets all blocks in its own part too.
    here = F.transform(every("parts"), lambda p: place(F.col("own_block"), p))
    there = F.transform(every("blocks"), lambda b: place(b, F.col("own_part")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("out"), F.array_union(here, there)).otherwise(here)))
    home = F.col("at.block") == F.col("own_block")
    rows = rows.select("key", "at.block", "at.part", "t", "fp", "root", home.alias("home"), (F.col("out") & (F.col("at.part") == F.col("own_part"))).alias("outside"))
    dealt = rows.join(sets, "t").select("key", "block", "part", "t", "fp", "root", "home", "outside", "h").repartition(width, "key", "block", "part")
    return dealt.sortWithinPartitions("key", "block", "part").mapInArrow(_across, "a long, b long")


def first_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t) of one row of each component: the smallest id, null ids last, then the smallest text hash."""
    rows = materialize(prints(docs), "prints")
    found = roots(docs, rows)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    firsts = rows.groupBy("fp").agg(F.min(name).alias("name"))
    firsts = firsts.join(found, firsts["fp"] == found["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("name").alias("name"))
    return firsts.select("name.doc_id", "name.t")
