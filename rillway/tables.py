"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a run within one machine gets a temporary folder of its
    own; a cluster has no folder that all its machines see, so there the setting is asked for."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="rillway-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, under the session's application."""
    return f"{shared_dir(spark)}/rillway-{spark.conf.get('spark.app.id', 'session')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back: the lineage before it is never computed again, so later stages
    survive lost executors and what lies before them takes effect once."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote into the shared folder; results not yet read are lost with them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rillway-{spark.conf.get('spark.app.id', 'session')}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
