"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a file of a cut of which it is known how many rows it has at most.
ROWS_A_FILE = 1 << 16


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder that lineage cuts are written to.

    A cluster names it in ``spark.checkpoint.dir``, without which it is refused. Only local masters, as in tests, take
    a fresh local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weldrow-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage.

    The copy is replicated by the shared store, so a lost executor costs no recomputation and a
    non-deterministic input (row tags, partition ids) is fixed from here on. Where ``df`` is known to have ``most`` rows
    at most, as many tasks write as these need: every file, however small, has a price (on a local folder Hadoop
    starts two chmod processes for it, each of which looks as large as the executor until it runs).
    """
    ensure_checkpoint_dir(df.sparkSession)
    if most is not None:
        df = df.coalesce(max(1, -(-most // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, for wide rows of which later steps read some columns: a Parquet table in the same folder.

    Without the marker file that the driver would add: nobody looks for it here, and on a local folder the children that set its
    rights look as large as the driver until they run.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.parquet(path)
