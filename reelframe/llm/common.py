"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token rule of most contracts: maximal runs without ASCII white space.  ``bytes.lower().split()`` gives the same
#: tokens in Python, since both only know ASCII.
TOKEN_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a temporary one is set on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="reelframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage: df written to the shared folder and read back, so a lost executor costs only its running tasks.

    instead_of, a result of this function that nothing needs any more, is removed from the folder afterwards.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead_of.stored_at)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return out


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null for null."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % n


def fresh(names, wanted: str) -> str:
    """wanted, or a variant of it that is not among names (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hash_order(*columns):
    """A fixed pseudo-random order that does not depend on partitioning."""
    return F.xxhash64(F.lit(20_011), *[F.col(c) for c in columns])


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning into n partitions deals to n different ones; plain numbers would collide."""
    ids = spark.range(64 * n).select(F.col("id").cast("int").alias("i"))
    rows = ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()
    found = {r["p"]: r["i"] for r in rows}
    return [found.get(p, p) for p in range(n)]


def annotate(df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, str]], make) -> DataFrame:
    """The keep columns of df with further columns computed from its text column, in one Arrow pass without a shuffle.

    make() runs once per partition and returns a function from a list of texts (or None) to one Arrow array per field.
    Texts reach Python whole; a batch is cut into slices of 512 rows, so memory follows the texts of one slice.
    """
    import pyarrow as pa

    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    kinds = [source.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    schema = ", ".join([f"k{i} {k}" for i, k in enumerate(kinds)] + [f"f{i} {k}" for i, (_, k) in enumerate(fields)])
    n, names = len(keep), [f"k{i}" for i in range(len(keep))] + [f"f{i}" for i in range(len(fields))]

    def run(batches):
        work = make()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + list(work(part.column(n).to_pylist())), names)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"f{i}").alias(c) for i, (c, _) in enumerate(fields)])
