"""What the operators of this subpackage share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, for what executors must all see.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error, as executors
    don't share local folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints of frames that nothing refers to any more.

    Spark removes them once the driver's garbage is collected, which may not happen for long; asking for it between the
    steps of an operator keeps the disk in use to what the next steps need.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL that has no function for it: a fold over the characters, bit by bit."""
    byte = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), lambda s, b: {byte}), 4294967295)"


@contextmanager
def written(df: DataFrame, *by: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, for as long as the block runs: smaller and faster to read again than a
    checkpoint. What the block makes of it must be cut within the block. Of the columns in ``by`` each value has a folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)  # of no rows there may be no file
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of one or two numbers that may be broadcast; their number is counted first.
BROADCAST_ROWS = 1_000_000


def near(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else any join of it is shuffled. ``df`` should be cut."""
    return F.broadcast(df) if df.count() <= most else df


#: Edges, two numbers each, that one task takes; beyond that they are spread.
SINGLE_TASK_EDGES = 250_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps; nothing is gathered per node.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``(node, component)``: for each node that has an edge to
    another node and isn't its component's smallest node, that smallest node. Loops and edges with a null end link
    nothing. No edges: no rows. Each step takes minima by node (combined before the shuffle) and joins them back, so
    that a hub's edges are spread by the skew handling of joins. Few edges, by their count, are one partition, which needs
    no shuffles; steps never make more of them.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(ordered)
    before = _state(now)
    single = before[0] <= SINGLE_TASK_EDGES
    gathered = lambda df: df.coalesce(1) if single else df
    now = gathered(now)
    for _ in range(rounds):
        if not before[0]:
            break
        ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = now.select(F.inline(ways))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(gathered(moved.union(small)).distinct())
        release(edges.sparkSession)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
