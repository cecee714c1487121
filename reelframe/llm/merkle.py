"""Merkle manifests: a tree of hashes for each group of rows, a tree over the groups' roots, a proof for every row.

A leaf is the hash of a row's columns.  Leaves are put in order by one range partitioning; blocks of 2 ** k consecutive
leaves are reduced where they meet.  What is left of the tree, at most TOP blocks and one for each group, is small: the
driver builds it, and every block's path to the root is broadcast to the tasks, which put together each row's proof and
fold its present digest along it.  The rows of a block and its path are all that a task holds.

Null columns are hashed as "-", null groups come first, null order values too.  Rows equal in group and order follow each
other by leaf; equal rows are leaves of their own.  An empty table has no rows and no root.  Columns that are not named
are ignored.  More than TOP groups raise ValueError, since they would not fit the driver's part of the tree.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Blocks that the driver and a broadcast may hold, some 64 MB with their paths.
TOP = 1 << 16
#: Leaves of a block are 2 ** k, k this at least; larger tables have larger blocks, never more than TOP.
LEAST_BITS = 10


def row_digest(columns: dict[str, Column]) -> Column:
    """sha256 of the values in order, each as its UTF-8 byte count, a colon and itself, or - where null; in hex."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def digest_of(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], depth: int | None = None) -> list[list[str]]:
    """The nodes and each level above them, two to one, up to depth levels or to a single node."""
    found = [nodes]
    while len(found) <= depth if depth is not None else len(found[-1]) > 1:
        last = found[-1]
        found.append([digest_of(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return found


def path(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Sides and siblings of a node of the lowest level: L or R where a sibling stands, a blank for none."""
    found = []
    for nodes in tree[:-1]:
        other = place ^ 1
        found.append(("L" if other < place else "R", nodes[other]) if other < len(nodes) else (" ", ""))
        place >>= 1
    return found


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node and its path lead to."""
    for side, sibling in steps:
        node = digest_of(sibling, node) if side == "L" else digest_of(node, sibling)
    return node


def _ordered(docs: DataFrame, columns: list[str], group: str, order: str, now: dict[str, Column]) -> DataFrame:
    """group_, id_, leaf, now_ and at: a number that ascends by group, order and leaf over all tasks.

    Digests are written first, so that the range partitioning samples them and not the texts; equal rows are told apart by
    tie, so that no partition has to hold all of them.
    """
    plain = {c: F.col(f"`{c}`") for c in columns}
    rows = docs.select(
        plain.get(group, F.col(f"`{group}`")).alias("group_"), F.col(f"`{order}`").alias("id_"), row_digest(plain).alias("leaf"),
        row_digest(plain | now).alias("now_"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialize(rows.withColumn("now_", F.when(F.col("now_") != F.col("leaf"), F.unhex("now_"))).withColumn("leaf", F.unhex("leaf")), "leaves")
    keys = [F.col("group_").asc_nulls_first(), F.col("id_").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(spread, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.select("group_", "id_", "leaf", "now_", F.monotonically_increasing_id().alias("at")), "ordered")


def prove(docs: DataFrame, columns: list[str], group: str, order: str, now: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """Each row's order column, leaf, subroot, root, proof_sha256, folded_root and verified; with proofs also sides and proof.

    The manifest is that of columns as they are; folded_root starts at the row's digest with the columns in now in place of
    theirs, so verified tells whether the row is still the one in the manifest.  proof has the siblings' digests from the
    leaf up, sides a letter a level (L, R or a blank for no sibling), proof_sha256 is the digest of proof.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    kind = docs.schema[order].dataType.simpleString()
    rows = _ordered(docs, columns, group, order, now or {})
    # A row for each range partition and group in it: where the group's leaves of that partition begin.
    part = F.shiftright("at", 33).alias("part")
    spans = rows.groupBy(part, "group_").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()
    groups = sorted({s["group_"] for s in spans}, key=lambda g: (g is not None, b"" if g is None else str(g).encode()))
    if len(groups) > TOP:
        raise ValueError(f"{len(groups)} groups are more than the {TOP} of the upper tree")
    number, total = {g: i for i, g in enumerate(groups)}, defaultdict(int)
    starts = []
    for s in sorted(spans, key=lambda s: s["first"]):
        g = number[s["group_"]]
        starts.append((s["part"], s["group_"], g, total[g] - s["first"]))
        total[g] += s["n"]
    bits = max(LEAST_BITS, (max(sum(total.values()), 1) // TOP).bit_length())
    depth = {g: min(bits, (n - 1).bit_length()) for g, n in total.items()}
    starts = spark.createDataFrame([(*s, depth[s[2]]) for s in starts], f"part bigint, group_ {rows.schema['group_'].dataType.simpleString()}, g int, shift bigint, depth int")
    placed = (
        rows.withColumn("part", part).alias("r").join(F.broadcast(starts.alias("s")), (F.col("r.part") == F.col("s.part")) & F.col("r.group_").eqNullSafe(F.col("s.group_")))
        .select("g", "depth", (F.col("at") + F.col("shift")).alias("pos"), "id_", "leaf", "now_").withColumn("block", F.shiftright("pos", bits))
    )

    def reduce(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("pos")
        leaves, now_ = table["leaf"].to_pylist(), table["now_"].to_pylist()
        top = levels([x.hex() for x in leaves], table["depth"][0].as_py())[-1][0]
        row = {"g": table["g"][0].as_py(), "block": table["block"][0].as_py(), "depth": table["depth"][0].as_py(), "ids": table["id_"].to_pylist(), "leaves": b"".join(leaves), "changed": [i for i, x in enumerate(now_) if x is not None], "now_": b"".join(x for x in now_ if x is not None), "top": top}
        return pa.Table.from_pylist([row], pa.schema([("g", pa.int32()), ("block", pa.int64()), ("depth", pa.int32()), ("ids", pa.list_(table["id_"].type)), ("leaves", pa.binary()), ("changed", pa.list_(pa.int32())), ("now_", pa.binary()), ("top", pa.string())]))

    blocks = materialize(placed.groupBy("g", "block").applyInArrow(reduce, f"g int, block bigint, depth int, ids array<{kind}>, leaves binary, changed array<int>, now_ binary, top string"), "blocks", rows)
    tops = defaultdict(list)
    for b in blocks.select("g", "block", "top").orderBy("g", "block").collect():  # at most TOP and one for each group
        tops[b["g"]].append(b["top"])
    trees = [levels(tops[g]) for g in range(len(groups))]
    crown = levels([t[-1][0] for t in trees]) if trees else [[""]]
    root = crown[-1][0]
    paths = []
    for g, tree in enumerate(trees):
        upper = path(crown, g)
        for b in range(len(tree[0])):
            steps = path(tree, b) + upper
            paths.append((g, b, tree[-1][0], "".join(s for s, _ in steps), "".join(x for _, x in steps)))
    paths = spark.createDataFrame(paths, "g int, block bigint, subroot string, sides string, proof string")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                leaves = [row["leaves"][i : i + 32].hex() for i in range(0, len(row["leaves"]), 32)]
                present = dict(zip(row["changed"], (row["now_"][i : i + 32].hex() for i in range(0, len(row["now_"]), 32)), strict=True))
                tree, rest = levels(leaves, row["depth"]), iter(range(0, len(row["proof"]), 64))
                upper = [(s, "" if s == " " else row["proof"][(i := next(rest)) : i + 64]) for s in row["sides"]]
                for low in range(0, len(leaves), 4096):
                    out = defaultdict(list)
                    for i in range(low, min(low + 4096, len(leaves))):
                        steps = path(tree, i) + upper
                        out["proof"].append("".join(x for _, x in steps))
                        out["sides"].append("".join(s for s, _ in steps))
                        out["folded"].append(fold(present.get(i, leaves[i]), steps))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["ids"][low : low + 4096], batch.schema.field("ids").type.value_type), pa.array(leaves[low : low + 4096]), pa.array([row["subroot"]] * len(out["proof"])),
                        pa.array([digest_of(p) for p in out["proof"]]), pa.array(out["folded"]), pa.array(out["sides"] if proofs else [None] * len(out["proof"]), pa.string()), pa.array(out["proof"] if proofs else [None] * len(out["proof"]), pa.string()),
                    ], ["id_", "leaf", "subroot", "proof_sha256", "folded_root", "sides", "proof"])

    told = blocks.drop("top").join(F.broadcast(paths), ["g", "block"])
    out = told.mapInArrow(finish, f"id_ {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, sides string, proof string")
    return out.select(
        F.col("id_").alias(order), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"), *(["sides", "proof"] if proofs else []),
    )
