"""Sessions and the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the session comes from its own settings."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("quirework").config(map=conf).getOrCreate()


def shared_top(spark: SparkSession, name: str) -> str:
    """The folder that spark.checkpoint.dir names; where it names none, a new temporary folder, on a single machine only."""
    context = spark.sparkContext
    if top := context.getConf().get("spark.checkpoint.dir"):
        return top
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return tempfile.mkdtemp(prefix=f"quirework-{name}-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; under a temporary folder where that is unset, on a single machine."""
    return f"{shared_top(spark, name)}/{name}-{uuid.uuid4().hex}"
