"""Removal of lines that many documents share, by two Bloom filters.

1. Every task hashes the keys of its long lines, once a document, and writes the hashes by segment of the hash space: four
   bytes a key, with those of two documents of the task apart.
2. A segment's task tests each hash against the filter of keys seen once, and puts it there; hashes that were there
   already make the filter of keys seen twice.  That filter is as large as the repeated keys need, and for all segments
   together at most TWICE_BYTES: beyond that more lines are suspected, with the same results.
3. The texts are read again; only lines whose key the second filter has are suspects and are shuffled, as a digest of 128
   bits with their document and places.  Counting them is exact, and chooses the document that keeps the line.
4. The places to drop meet their texts by a join, a broadcast one if they are few.

A key is a line without ASCII white space at its ends, A-Z in lower case.  A null text is empty; an empty text is one
empty line.  Every row is a document.  Of the rows that hold a repeated key, those with the largest id keep its lines:
all of them if several rows share that id; a null id is smaller than any other.  An empty table gives an empty one;
other columns are ignored; n_lines, n_dropped and kept must not be in keep.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Parts of the hash space, 2 ** 12 of them; a key is a place of 32 bits in one.
SEGMENT_BITS = 12
#: Bits a key of both filters, and hash functions; about 1 % of other keys pass.
BITS_A_KEY, MIX = 10, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Bound of the second filter, which is broadcast; of confirmed keys to broadcast, else only hot ones; of places to broadcast.
TWICE_BYTES, BROADCAST_KEYS, BROADCAST_BYTES = 1 << 25, 400_000, 1 << 25
#: Hashes that a task gathers before it writes them.
FLUSH = 1 << 20


def long_keys(text: bytes | None, least: int = LEAST_CHARS) -> dict[bytes, list[int]]:
    """Keys of at least so many code points, with the numbers of their lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= least and len(key := line.strip(WHITE).lower()) >= least and (key.isascii() or len(key.decode(errors="replace")) >= least):
            found.setdefault(key, []).append(i)
    return found


def _places(where: np.ndarray, bits) -> list[np.ndarray]:
    """Bit numbers of 32-bit places in filters of 2 ** bits bits, one array for each hash function."""
    shift = np.uint64(64) - np.asarray(bits, np.uint64)
    return [(where.astype(np.uint64) * np.uint64(m)) >> shift for m in MIX]


def _has(bitmap: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(places[0]), bool)
    for p in places:
        found &= (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _put(bitmap: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(bitmap, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def _bits_for(keys: int, most: int = 40) -> int:
    """A power of two of bits for so many keys, as its exponent; at least a byte's."""
    return min(most, max(3, int(keys * BITS_A_KEY - 1).bit_length()))


class Repeated:
    """The filter of keys seen twice: a bitmap for each segment, in one array."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.bits = np.zeros(1 << SEGMENT_BITS, np.int64)
        self.base = np.zeros(1 << SEGMENT_BITS, np.uint64)
        at = 0
        for segment, bits, bitmap in parts:
            self.bits[segment], self.base[segment], at = bits, at * 8, at + len(bitmap)
        self.bitmap = np.frombuffer(b"".join(b for _, _, b in parts) or b"\0", np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        segment = (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
        found = self.bits[segment] > 0
        h, s = hashes[found], segment[found]
        found[found] = _has(self.bitmap, [self.base[s] + p for p in _places(h & np.uint64(0xFFFFFFFF), self.bits[s])])
        return found


def _repeated(texts: DataFrame, least: int) -> Repeated:
    import pyarrow as pa

    def hashed(batches):
        waiting, n = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(waiting), return_counts=True)
            segments = (keys >> np.uint64(64 - SEGMENT_BITS)).astype(np.int32)
            places = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cut = np.flatnonzero(np.diff(segments, prepend=-1, append=-1))
            ends = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array(segments[cut[:-1]]), pa.array([b - a for a, b in ends], pa.int64()), pa.array([places[a:b].tobytes() for a, b in ends], pa.binary()),
                pa.array([places[a:b][times[a:b] > 1].tobytes() for a, b in ends], pa.binary()),
            ], ["segment", "n", "once", "twice"])

        for batch in batches:
            for text in batch.column("t").to_pylist():
                if found := long_keys(text, least):
                    waiting.append(np.array([xxhash.xxh3_64_intdigest(k) for k in found], np.uint64))
                    n += len(found)
                    if n >= FLUSH:
                        yield flush()
                        waiting, n = [], 0
        if waiting:
            yield flush()

    seen = materialize(texts.select("t").mapInArrow(hashed, "segment int, n bigint, once binary, twice binary"), "line-hashes")
    total = seen.agg(F.sum("n")).first()[0] or 0
    bits, most = _bits_for(-(-total >> SEGMENT_BITS) + 1), (TWICE_BYTES * 8 >> SEGMENT_BITS).bit_length() - 1

    def filters(batches):
        at, once, again = None, None, []

        def close():
            keys = np.unique(np.concatenate(again)) if again else np.zeros(0, np.uint32)
            own = _bits_for(len(keys), most)
            bitmap = np.zeros(1 << own - 3, np.uint8)
            _put(bitmap, _places(keys, own))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own], pa.int32()), pa.array([bitmap.tobytes()], pa.binary())], ["segment", "bits", "bitmap"])

        for batch in batches:
            for segment, first, repeats in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if segment != at:
                    if again:
                        yield close()
                    at, once, again = segment, np.zeros(1 << bits - 3, np.uint8), []
                keys = np.frombuffer(first, np.uint32)
                places = _places(keys, bits)
                if len(known := keys[_has(once, places)]):
                    again.append(known)
                if repeats:
                    again.append(np.frombuffer(repeats, np.uint32))
                _put(once, places)
        if again:
            yield close()

    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = seen.select("segment", "once", "twice").repartition(spread, "segment").sortWithinPartitions("segment")
    parts = sorted_.mapInArrow(filters, "segment int, bits int, bitmap binary").collect()  # at most TWICE_BYTES
    return Repeated([tuple(p) for p in parts])


def _suspects(texts: DataFrame, least: int) -> DataFrame:
    """id_, row_, key and lines: the places of every line whose key may be in several documents."""
    import pyarrow as pa

    kind = texts.schema["id_"].dataType.simpleString()
    filter_ = texts.sparkSession.sparkContext.broadcast(_repeated(texts, least))

    def probe(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [(i, k, lines) for i, text in enumerate(part.column("t").to_pylist()) for k, lines in long_keys(text, least).items()]
                if not found:
                    continue
                hit = filter_.value.has(np.array([xxhash.xxh3_64_intdigest(k) for _, k, _ in found], np.uint64))
                kept = [x for x, h in zip(found, hit.tolist(), strict=True) if h]
                rows = pa.array([i for i, _, _ in kept], pa.int32())
                keys = pa.array([hashlib.blake2b(k, digest_size=16).digest() for _, k, _ in kept], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id_").take(rows), part.column("row_").take(rows), keys, pa.array([x for _, _, x in kept], pa.list_(pa.int32()))], ["id_", "row_", "key", "lines"])

    return materialize(texts.mapInArrow(probe, f"id_ {kind}, row_ bigint, key binary, lines array<int>"), "suspects")


def drop_repeated(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """keep with n_lines, n_dropped and kept: each text without the lines that at least least_docs documents share."""
    import pyarrow as pa

    names = [f"k{i}" for i in range(len(keep))]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(f"`{id}`").alias("id_"), F.xxhash64(whole).alias("row_"), whole.cast("binary").alias("t"))
    suspects = _suspects(source.select("id_", "row_", "t"), least_chars)
    shared = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id_").alias("keeper")).filter(F.col("n") >= least_docs)
    shared = materialize(shared, "shared-lines")
    sizes = shared.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    # Keys with a ten-thousandth of the rows are at most 10,000; they are always broadcast, so no task of the other join meets a hot one.
    few = sizes["keys"] <= BROADCAST_KEYS
    hot = shared if few else shared.filter(F.col("n") * 10_000 >= sizes["rows"])
    dropped = suspects.join(F.broadcast(hot), "key")
    if not few:
        rest = suspects.join(F.broadcast(hot.select("key")), "key", "left_anti")
        dropped = dropped.unionByName(rest.join(shared.filter(F.col("n") * 10_000 < sizes["rows"]), "key"))
    dropped = dropped.filter(~F.col("id_").eqNullSafe(F.col("keeper"))).groupBy("id_", "row_").agg(F.flatten(F.collect_set("lines")).alias("lines"))
    dropped = materialize(dropped, "dropped-lines")
    if (dropped.agg(F.sum(40 + 4 * F.size("lines"))).first()[0] or 0) <= BROADCAST_BYTES:
        dropped = F.broadcast(dropped)
    met = source.alias("s").join(dropped.alias("d"), F.col("s.id_").eqNullSafe(F.col("d.id_")) & (F.col("s.row_") == F.col("d.row_")), "left")

    def rewrite(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                n_lines, n_dropped, kept = [], [], []
                for t, gone in zip(part.column("t").to_pylist(), part.column("lines").to_pylist(), strict=True):
                    n_lines.append(t.count(b"\n") + 1)
                    n_dropped.append(len(gone or ()))
                    if gone:
                        gone = set(gone)
                        t = b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in gone])
                    kept.append(t)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_lines", "n_dropped", "kept"])

    kinds = ", ".join([f"{k} {source.schema[k].dataType.simpleString()}" for k in names] + ["n_lines bigint, n_dropped bigint, kept binary"])
    out = met.select(*[F.col(f"s.{k}") for k in names], "s.t", "d.lines").mapInArrow(rewrite, kinds)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)], "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
