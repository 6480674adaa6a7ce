"""Where the driver and the executors may leave files for each other."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: dict[int, str] = {}


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or else the one set on the context.

    Where neither is set, a local master (tests on one machine) gets a temporary folder; a cluster's executors
    do not share one, so there it is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise NoSharedFolder(f"master {master}: set spark.checkpoint.dir to a folder that driver and executors share")
    if id(sc) not in _own:
        _own[id(sc)] = "file://" + tempfile.mkdtemp(prefix="ctxloom-")
        sc.setCheckpointDir(_own[id(sc)])
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
