"""Fitted pipelines on disk, in Spark's own model format."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model, path: str) -> None:
    """Overwrite the model at ``path``; parent folders are made as needed."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Load a pipeline; a missing path is reported as such."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(path)
