"""A table that grows by batches, each of which takes effect exactly once.

Every attempt to add a batch writes its own folder under ``data``; then a small file under ``commits`` that is named by
the batch and must not exist yet makes the attempt the batch's. A rerun of a finished batch writes nothing, a job that failed
before the commit leaves a folder that no reader looks at, and of two writers of one batch only one is read. Readers
see all committed batches or, while one is written, all but that.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "batch string, attempt string"


def _file(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _commit_path(path: str, batch: str) -> str:
    return f"{path}/commits/{hashlib.md5(batch.encode()).hexdigest()}.json"


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    store, commit = _file(spark, _commit_path(path, batch))
    return store.exists(commit)


def append_once(df: DataFrame, path: str, batch: str, fmt: str = "parquet", **options) -> bool:
    """Add the rows as ``batch``; False, without running the query, if that batch is there already."""
    spark = df.sparkSession
    if committed(spark, path, batch):
        return False
    attempt = uuid.uuid4().hex
    df.write.format(fmt).options(**options).save(f"{path}/data/attempt={attempt}")
    store, commit = _file(spark, _commit_path(path, batch))
    try:
        out = store.create(commit, False)  # fails if another writer was first
    except Exception:  # noqa: BLE001  a Java exception, of another class in each store
        if committed(spark, path, batch):
            return False
        raise
    out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
    out.close()
    return True


def read_batches(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """All rows of committed batches; none if there is no batch yet."""
    store, commits = _file(spark, f"{path}/commits")
    if not store.exists(commits):
        return spark.createDataFrame([], schema)
    known = spark.read.schema(COMMIT).json(f"{path}/commits").select("attempt")
    whole = StructType([*schema.fields]).add("attempt", "string")
    rows = spark.read.schema(whole).format(fmt).options(basePath=f"{path}/data", **options).load(f"{path}/data")
    # a row for each batch; folders of other attempts are pruned, not read
    return rows.join(F.broadcast(known), "attempt", "left_semi").select(*schema.fieldNames())
