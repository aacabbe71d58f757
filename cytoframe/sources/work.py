"""Work tables: intermediate results that several later steps read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, where no shared folder is set.
_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cytoframe-")
        root = _OWN[app]
    return root.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """``df`` written and read back: computed once, lineage cut.  Python gets so many ``rows`` at once at most, for rows that are large."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/cytoframe/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    if rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        df.write.parquet(path)
    finally:
        if rows:
            spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)
    return spark.read.schema(df.schema).parquet(path)
