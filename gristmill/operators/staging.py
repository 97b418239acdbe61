"""Lineage is cut, and texts aren't made twice, by a reliable checkpoint in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session without it gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="gristmill-stages-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def staged(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``staged``, in a table: smaller than a checkpoint, and only the columns that are asked for are read again."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast; their number is counted first.
BROADCAST_IDS = 2_000_000


def near(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, to be broadcast if it has at most ``most`` rows; else a join of it is shuffled. It should be staged."""
    return F.broadcast(ids) if ids.count() <= most else ids
