"""Intermediate tables that outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session within one process (``local``) gets a temporary one; a cluster's must be named.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Bytecode of one generated method beyond which HotSpot leaves it to its interpreter; Spark's default lets such methods run.
SMALL_METHODS = "8000"
_LIMIT_KEY, _LIMIT_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def compiled(df: DataFrame) -> DataFrame:
    """The same rows; wide projections of this session run as many small methods, which are compiled, not as one that is not.

    Done only where the session leaves Spark's default.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT_KEY, _LIMIT_DEFAULT) == _LIMIT_DEFAULT:
        conf.set(_LIMIT_KEY, SMALL_METHODS)
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
