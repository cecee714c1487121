"""SimHash near-duplicates: 64-bit fingerprints compared only at the anchors of a covering code.

A covering code of length 64 is built as a product: two binary Golay codes (23 bits each, covering radius 3) and 18 free
bits.  A fingerprint's home is the codeword pair its two blocks decode to.  Every fingerprint is replicated to each
anchor that a word within the link threshold of it has as home, so two linked fingerprints always meet at the home of
either.  All comparing is done per anchor.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
BLOCK = 23
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Rows of hot fingerprints, and so the rows of a broadcast, are at most so many.
HOT = 1000
#: Beyond so many comparisons at one anchor, partners are looked up instead: 2081 words lie within two bits of a word.
DENSE = 2_000_000


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of the text, repeats included; of the whole sequence if it is shorter; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)] if tokens else []
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist(), strict=False)]


@lru_cache(1)
def _lanes() -> np.ndarray:
    """For each byte a word whose eight bytes are the byte's bits, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: a bit is 1 if more than half of the run have it; 0 for an empty run.

    Bits are added eight at a time in byte lanes over at most 255 hashes, then widened.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts, counts = starts[full], counts[full]
    pieces = (counts + 254) // 255
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = _lanes()[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64)
    sums = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    bits = (2 * sums > counts[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        texts, done = batch.column("text"), []
        for low in range(0, len(texts), 256):
            lists = [shingle_hashes(t) for t in texts.slice(low, 256).to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            done.append(majority(flat, np.cumsum(counts) - counts, counts))
        fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row; null and empty texts get 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """(correction by syndrome, syndrome by word) of the perfect Golay code; a word xor its correction is its codeword."""
    words = np.arange(1 << BLOCK, dtype=np.uint32)
    left = words.copy()
    for bit in range(BLOCK - 1, 10, -1):
        left ^= np.where(left >> np.uint32(bit) & np.uint32(1), np.uint32(GOLAY << (bit - 11)), np.uint32(0))
    syndrome = left.astype(np.uint16)
    fix = np.zeros(2048, np.uint32)
    errors = [0] + [1 << i for i in range(BLOCK)]
    errors += [1 << i | 1 << j for i in range(BLOCK) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(BLOCK) for j in range(i) for k in range(j)]
    errors = np.array(errors, np.uint32)
    fix[syndrome[errors]] = errors
    return fix, syndrome


def _codewords(words: np.ndarray) -> np.ndarray:
    """Information bits (the upper 12) of the codeword that each word decodes to."""
    fix, syndrome = _decoder()
    return (words ^ fix[syndrome[words]]) >> np.uint32(11)


def _flips(most: int) -> list[np.ndarray]:
    """Block error patterns by their weight, 0 to most."""
    by = [[0], [1 << i for i in range(BLOCK)], [1 << i | 1 << j for i in range(BLOCK) for j in range(i)]]
    return [np.array(x, np.uint32) for x in by[: most + 1]]


def _reached(block: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each word its distinct codewords reachable by flips, with the fewest flips: (row, codeword, flips)."""
    rows, codes, costs = [], [], []
    n = len(block)
    for cost, patterns in enumerate(_flips(most)):
        for p in patterns:
            rows.append(np.arange(n, dtype=np.int64))
            codes.append(_codewords(block ^ p))
            costs.append(np.full(n, cost, np.int64))
    key = np.concatenate(rows) << 14 | np.concatenate(codes).astype(np.int64) << 2 | np.concatenate(costs)
    key = np.sort(key)
    key = key[np.r_[True, key[1:] >> 2 != key[:-1] >> 2]] if len(key) else key
    return key >> 14, key >> 2 & 4095, key & 3


def anchors(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor a fingerprint must be replicated to."""
    low = (fp & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)
    high = (fp >> np.uint64(BLOCK) & np.uint64((1 << BLOCK) - 1)).astype(np.uint32)
    ra, ca, ka = _reached(low, threshold)
    rb, cb, kb = _reached(high, threshold)
    nb = np.bincount(rb, minlength=len(fp))
    firstb = np.cumsum(nb) - nb
    times = nb[ra]
    left = np.repeat(np.arange(len(ra)), times)
    right = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(firstb[ra], times)
    cost = ka[left] + kb[right]
    keep = cost <= threshold
    left, right, cost = left[keep], right[keep], cost[keep]
    return ra[left], ca[left] << 12 | cb[right], cost == 0


def _replicate(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for low in range(0, len(fps), 2048):
            part = fps[low : low + 2048]
            row, anchor, home = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.astype(np.int32)), pa.array(part[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"]
            )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between keys -> (key, smallest key of its component) for keys that are not the smallest."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _near_patterns(threshold: int) -> np.ndarray:
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for i in range(64) for j in range(i)]
    return np.array(([], one, one + two)[threshold], np.uint64)


def _pairs_at(fp: np.ndarray, home: np.ndarray, group: np.ndarray):
    """Linked pairs (home, other) of rows sorted by anchor; group: start of each anchor's rows."""
    bounds = np.r_[group, len(fp)]
    homes = np.add.reduceat(home.astype(np.int64), group)
    sizes = np.diff(bounds)
    work = homes * sizes
    for g in np.flatnonzero(work > DENSE):
        rows = slice(bounds[g], bounds[g + 1])
        here, mine = np.unique(fp[rows]), fp[rows][home[rows]]
        for p in _near_patterns(THRESHOLD):
            seek = mine ^ p
            at = np.minimum(np.searchsorted(here, seek), len(here) - 1)
            hit = here[at] == seek
            yield mine[hit], seek[hit]
    usual = np.flatnonzero((work > 0) & (work <= DENSE) & (sizes > 1))
    if not len(usual):
        return
    load = np.cumsum(work[usual])
    for part in np.split(usual, np.flatnonzero(np.diff(load // DENSE)) + 1):
        rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in part])
        of = np.repeat(np.arange(len(part)), sizes[part])
        mine = home[rows]
        left, times = rows[mine], sizes[part][of[mine]]
        start = bounds[part][of[mine]]
        a = np.repeat(left, times)
        b = np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD) & (fp[a] != fp[b])
        yield fp[a[near]], fp[b[near]]


def _links(batches):
    """Rows of whole anchors in anchor order -> links, each chunk reduced to a forest."""
    held: list[pa.RecordBatch] = []

    def compare(table: pa.Table):
        anchor = table.column("anchor").to_numpy()
        fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        group = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        for a, b in _pairs_at(fp, home, group):
            if len(a):
                a, b = _forest(a.view(np.int64), b.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        if cut:
            held.append(batch.slice(0, cut))
            yield from compare(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        elif held and held[0].column("anchor")[0].as_py() != anchor[-1]:
            yield from compare(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from compare(pa.Table.from_batches(held))


def with_components(prints: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of prints with the component_id of their fp; nodes: (fp, n, component_id) with n rows of prints each.

    Fingerprints that make up a thousandth of all rows or more are at most HOT, so their nodes are broadcast; their rows, a
    large group of copies, stay where they are.  All others meet their nodes by a shuffle.
    """
    total = prints.count()
    hot = F.col("n") * HOT >= total
    few = F.broadcast(nodes.filter(hot).select("fp", "component_id"))
    rest = prints.join(few, "fp", "left_anti").join(nodes.filter(~hot).select("fp", "component_id"), "fp")
    columns = [*columns, "component_id"]
    return prints.join(few, "fp").select(*columns).unionByName(rest.select(*columns))


def near_components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) rows -> the same rows with component_id, the smallest doc_id reachable by links.  prints must be stored.

    Equal fingerprints are one node from the start, so a group of copies of any size costs one row beyond its map-side
    combined minimum.  Null doc_ids belong to a component but never name one unless it has nothing else.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fps")
    spark = prints.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())
    copies = nodes.select("fp").repartition(width).mapInArrow(_replicate, "anchor int, fp long, home boolean")
    links = copies.repartition(width, "anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long")
    roots = connected_components(links)
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first_id")
    named = linked.groupBy("root").agg(F.min("first_id").alias("low"))
    moved = linked.join(named, "root").select(F.col("fp").alias("fp2"), "low")
    all_nodes = nodes.join(moved, nodes["fp"] == moved["fp2"], "left").select("fp", "n", F.coalesce("low", "first_id").alias("component_id"))
    return with_components(prints, materialize(all_nodes, "named"), ["doc_id", "fp"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null or empty texts have fingerprint zero and link like any other; repeated rows stay; an empty table gives no rows;
    other columns of docs are not read.
    """
    prints = materialize(fingerprints(docs), "prints")
    found = near_components(prints)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
