"""Session helpers shared by the batch jobs, the stream and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on.  Skewed joins are left to AQE, which splits
# a hot key's partition between tasks; the force flag keeps that split even when
# an aggregate on the same key follows the join.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


#: State of keys lives on disk beside the executor and in the checkpoint, not on its heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def build_session(name: str = "gleanmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for staged tables.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster session
    fails here, since folders of its machines are not shared.  Only a session on
    one machine gets a temporary folder.
    """
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gleanmill-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Materialise rows as a table in the shared folder and go on from there.

    A lost executor cannot change what is read later, the rows are computed
    once, and later steps read only the columns they need.
    """
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out anew where a costly expression would run in fewer tasks than there are cores.

    A file of one row group is one task however many cores wait; a table of many
    splits stays as it is and is not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
