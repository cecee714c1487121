"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

A document of a source with target t and size s is wanted t / s times.  The whole part is taken outright; the fractional
parts are rounded by pairs: words move at random from one document's expected share to the other's until one of the two is
taken fully or not at all.  Each pairing keeps the expected words of every document and the exact words of the pair, so a
source ends within one document of its target.  Leaves of the tree hold a bounded number of documents and leave at most
one fractional document each; the residuals of 64 nodes meet in one node of the next level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TOKEN_RE, fresh, materialize

LEAF = 4096
FAN = 64
#: Equal rows that one task may number or return; more are dealt out in pieces of so many.
HOT = 4096
MOST = 3.0
CYCLE = (1, 2, 3)


def targets(sizes: dict, most: float = MOST) -> dict:
    """Source -> words: weights 1, 2, 3 repeating by code point (null last) share all words; none above most times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: float(CYCLE[i % len(CYCLE)]) for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        for s in full or open_:
            out[s] = most * sizes[s] if full else unit * weight[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def with_targets(sized: DataFrame) -> tuple[DataFrame, int]:
    """(sized with source_size and target, number of rows).

    The driver holds one row per source; a mixture names its sources by hand, so that number does not follow the corpus.
    """
    rows = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    want = targets(sizes)
    table = sized.sparkSession.createDataFrame([(s, n, want[s]) for s, n in sizes.items()], "s string, source_size long, target double")
    joined = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["s"])).drop("s")
    return joined, sum(r["n"] for r in rows)


def pivot(share: np.ndarray, size: np.ndarray, seed: int) -> int:
    """Rounds share in place to 0 or 1 by pairs, keeping sum(share * size); returns the index left fractional, or -1."""
    draws = np.random.default_rng(seed).random(len(share))
    p, s = share.tolist(), size.tolist()
    held = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        up = min(s[held] * (1 - p[held]), s[j] * p[j])  # words that held can gain
        down = min(s[held] * p[held], s[j] * (1 - p[j]))
        gain = draws[j] * (up + down) < down
        moved = up if gain else -down
        a, b = p[held] + moved / s[held], p[j] - moved / s[j]
        # Exactly one side that met its limit is made exact.
        if gain:
            a, b = (1.0, b) if s[held] * (1 - p[held]) <= s[j] * p[j] else (a, 0.0)
        else:
            a, b = (0.0, b) if s[held] * p[held] <= s[j] * (1 - p[j]) else (a, 1.0)
        a, b = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (a, b))
        p[held], p[j] = a, b
        held = held if 0 < a < 1 else j if 0 < b < 1 else -1
    share[:] = p
    return held


def _seed(node, source) -> int:
    return xxhash.xxh64_intdigest(f"{node}/{'' if source is None else 's' + source}".encode("utf-8", "surrogatepass"), 7)


def _round_nodes(batches):
    """Rows sorted by node and source -> the same rows with the share rounded; at most one fractional row per group."""
    held: list[pa.RecordBatch] = []

    def finish(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        node, source = t.column("node").to_pylist(), t.column("source").to_pylist()
        share, size = t.column("share").to_numpy().copy(), t.column("size").to_numpy()
        cuts = [0] + [i for i in range(1, len(node)) if node[i] != node[i - 1] or source[i] != source[i - 1]] + [len(node)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pivot(share[a:b], size[a:b], _seed(node[a], source[a]))
        yield from t.set_column(t.schema.get_field_index("share"), "share", pa.array(share)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        node, source = batch.column("node").to_pylist(), batch.column("source").to_pylist()
        cut = batch.num_rows - 1
        while cut > 0 and (node[cut - 1], source[cut - 1]) == (node[-1], source[-1]):
            cut -= 1
        first = (held[0].column("node")[0].as_py(), held[0].column("source")[0].as_py()) if held else None
        if held and (cut or first != (node[-1], source[-1])):
            yield from finish(held + ([batch.slice(0, cut)] if cut else []))
            held = [batch.slice(cut)]
        elif cut:
            yield from finish([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from finish(held)


def _row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def _copies(docs: DataFrame) -> DataFrame:
    """row_hash (of id, source and text), doc_id, source, size, source_size, target, equal, copies: how often the equal rows
    of that hash are taken together.

    Equal rows are one row of the tree, wanted as often as they are, so a leaf holds a bounded number of rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(TOKEN_RE)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), _row_hash().alias("row_hash"))
    sized = materialize(sized.groupBy("row_hash", "doc_id", "source", "size").agg(F.count("*").alias("equal")), "sized")
    aimed, n = with_targets(sized)
    wanted = F.when(F.col("size") > 0, F.col("equal") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaves = max(1, -(-n // LEAF))
    rows = aimed.select("*", F.floor(wanted).alias("whole"), (wanted - F.floor(wanted)).alias("share"), F.pmod(F.xxhash64(F.lit(3), "row_hash"), F.lit(leaves)).alias("node"))
    schema = rows.schema
    order = ["node", "source", F.xxhash64(F.lit(5), "row_hash"), "row_hash", "doc_id", "size"]
    fraction = (F.col("share") > 0) & (F.col("share") < 1)
    settled = []
    nodes = leaves
    while True:
        parts = max(1, min(nodes, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rounded = rows.filter(fraction).repartition(parts, "node", "source").sortWithinPartitions(*order).mapInArrow(_round_nodes, schema)
        level = materialize(rounded.union(rows.filter(~fraction)), "level")
        if nodes == 1:
            settled.append(level)
            break
        settled.append(level.filter(~fraction))
        rows = level.filter(fraction).withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        nodes = -(-nodes // FAN)
    done = settled[0]
    for level in settled[1:]:
        done = done.unionByName(level)
    # The root's last fractional row is rounded by the nearer number of words, in one fixed way.
    taken = F.col("whole") + F.when(F.col("share") >= 0.5, 1).otherwise(0)
    return done.select("row_hash", "doc_id", "source", "size", "source_size", "target", "equal", taken.alias("copies"))


def _own(place, equal, copies):
    """Copies of one of equal rows: all of them nearly the same number."""
    return (F.floor(copies / equal) + F.when(place <= copies % equal, 1).otherwise(0)).cast("int")


def _dealt(rows: DataFrame, n: str, key: str, piece: str) -> DataFrame:
    """Rows, of which n are wanted of each, as pieces of at most HOT with piece their number and n their size.

    Pieces of rows with more than HOT are spread over tasks; the others stay where they are.
    """
    pieces = lambda df: df.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(n) - 1, F.lit(HOT).cast("long")))))
    spread = pieces(rows.filter(F.col(n) > HOT)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, piece)
    both = rows.filter((F.col(n) > 0) & (F.col(n) <= HOT)).withColumn(piece, F.lit(0).cast("long")).unionByName(spread)
    return both.withColumn(n, F.least(F.lit(HOT).cast("long"), F.col(n) - F.col(piece) * HOT))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs.

    Reruns agree: rows are dealt to leaves and ordered by hashes of their contents, and draws come from the node's name.  A
    null or empty text has size 0 and is not taken (its share of words is nothing); null sources are one source; equal rows
    are interchangeable; an empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    each = _dealt(_copies(docs).withColumn("left", F.col("equal")), "left", "row_hash", "piece")
    each = each.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    place = F.col("piece") * HOT + F.col("place")
    return each.select("doc_id", "source", "size", "source_size", "target", _own(place, F.col("equal"), F.col("copies")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it; columns as in docs.  Nulls, empty texts and repeated rows as
    in copies().

    Rows meet their numbers of copies by a hash of id, source and text, of which there is one row, and take their part by
    their place among equal rows.  The texts are shuffled once: numbering and join share the partitioning.  Rows with more
    equals than HOT, and than a ten-thousandth of all, are counted instead of numbered: grouped by all columns, where they
    are read first, they are returned in pieces by many tasks.
    """
    names = []
    for wanted in ("hash_", "place_", "equal_", "times_", "copy_", "many_", "piece_"):
        names.append(fresh([*docs.columns, *names], wanted))
    key, place, equal, times, copy, many, piece = names
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = _copies(docs).filter(F.col("copies") > 0).select(F.col("row_hash").alias(key), F.col("equal").alias(equal), F.col("copies").alias(times))
    # Two rows of one hash but unequal contents are as good as impossible; were there any, they would share their copies.
    taken = materialize(taken.groupBy(key).agg(F.sum(equal).alias(equal), F.sum(times).alias(times)), "taken")
    total, most = taken.agg(F.sum(equal), F.max(equal)).first()
    limit = max(HOT, (total or 0) // 10_000)
    rows, few = docs.withColumn(key, _row_hash()), taken
    if (most or 0) > limit:
        hot = taken.filter(F.col(equal) > limit)  # at most 10,000 keys
        grouped = rows.join(F.broadcast(hot), key).groupBy(key, equal, times, *[f"`{c}`" for c in docs.columns if c != "text"]).agg(F.first("text").alias("text"), F.count("*").alias(many))
        # Rows that differ in other columns follow each other; the first equal rows get one copy more.
        before = F.coalesce(F.sum(many).over(W.partitionBy(key).orderBy(*[F.xxhash64(*own[:1]), *own]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        extra = F.greatest(F.least(F.col(times) % F.col(equal) - before, F.col(many)), F.lit(0))
        wanted = grouped.withColumn(copy, (F.col(many) * F.call_function("div", F.col(times), F.col(equal)) + extra).cast("long"))
        dealt = _dealt(wanted, copy, key, piece)
        returned = dealt.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))).alias(copy)).drop(copy)
        rows, few = rows.join(F.broadcast(hot.select(key)), key, "left_anti"), taken.filter(F.col(equal) <= limit)
    ranked = rows.withColumn(place, F.row_number().over(W.partitionBy(key).orderBy(key)))
    joined = ranked.join(few, key).withColumn(times, _own(F.col(place), F.col(equal), F.col(times))).filter(F.col(times) > 0)
    out = joined.select(*own, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
    return out.unionByName(returned) if (most or 0) > limit else out
