"""A scratch folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, gone at the driver's end; where that is unset, a local one under a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="boundwave-")
        root = _OWN[app]
    name = f"{root.rstrip('/')}/scratch/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path.getParent())
    system.deleteOnExit(path)
    return name
