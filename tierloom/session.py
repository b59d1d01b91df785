"""Session settings and the shared work folder.

Library code never creates its own session; it takes the caller's. The
helpers here are for the places that must own one (tests, ``bench.py``)
and for finding a folder every executor can see.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs are designed around, for every session (tests, bench,
# cluster). AQE re-plans at every shuffle: it coalesces the small partitions
# left after an aggregation, splits skewed join partitions, and can turn a
# join into a broadcast once it has measured the smaller side's real size.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Input splits of 1 GiB, safe at any size: Spark caps a split at the input
# divided by the cluster's cores (4 MiB at least), so small inputs still
# spread over the cores, and large ones get an eighth of the default task
# count (100 TB of landing CSV: 100k ingest tasks instead of 800k).
SCAN_CONF = {"spark.sql.files.maxPartitionBytes": str(1 << 30)}


#: Shuffle data per reduce partition. Fewer, larger partitions keep the
#: number of shuffle blocks (map tasks x partitions) down; aggregation
#: spills by sorting where one does not fit.
REDUCE_BYTES = 2 << 30


def cluster_conf(input_bytes: int, shuffle_ratio: float = 1.5, reduce_bytes: int = REDUCE_BYTES) -> dict[str, str]:
    """Sizing for running one layer job over ``input_bytes`` of its input.

    ``shuffle_ratio`` estimates the shuffled bytes per input byte. Silver's
    dedup moves every column of every row, so its shuffle is about as large
    as bronze itself (Parquet decodes to ~3x, shuffle compression takes back
    ~2x: 1.5). Gold moves partial sums only (``GOLD_RATIO``).

    The cost of a shuffle grows with map tasks x reduce partitions (blocks),
    so both are kept few and large: 1 GiB input splits, and one reduce
    partition per ``reduce_bytes``. 30 TiB of bronze is 30,720 map tasks x
    23,040 partitions. AQE coalesces down from there;
    ``parallelismFirst=false`` makes it coalesce to the advisory size, so
    silver comes out as ~256 MiB files instead of many small ones.
    """
    partitions = max(200, math.ceil(input_bytes * shuffle_ratio / reduce_bytes))
    return {
        **BASE_CONF,
        **SCAN_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


#: Gold shuffles at most two of silver's five columns, summed per map task.
GOLD_RATIO = 0.4


def apply_conf(spark: SparkSession, settings: dict[str, str], keep: frozenset[str] = frozenset()) -> None:
    """Set what the submitter has not: keys in ``keep`` stay as they are."""
    for key, value in settings.items():
        if key not in keep:
            spark.conf.set(key, value)


def submitted_keys(spark: SparkSession) -> frozenset[str]:
    """Settings that came with the application (``--conf``, defaults file)."""
    return frozenset(key for key, _ in spark.sparkContext.getConf().getAll())


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tierloom") -> SparkSession:
    """A ``local[cores]`` session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIERLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Written intermediate tables and landing copies go here, never to a
    machine-local temporary folder, because any executor may read them. Only
    a ``local`` master without the setting (as in tests) gets a fresh local
    folder, registered as the checkpoint dir; anywhere else a missing
    setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    unset = "set spark.checkpoint.dir to a folder that all executors and the driver share"
    try:
        context = spark.sparkContext
    except NotImplementedError as err:  # Spark Connect: no way to tell the folder is shared
        raise RuntimeError(unset) from err
    base = context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError(f"{unset} (master is {context.master})")
        base = tempfile.mkdtemp(prefix="tierloom-work-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


# One owner per process: its folder under the work folder and its databases.
_RUN = uuid.uuid4().hex
_DATABASES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused location under the work folder.

    Every call gets its own folder, so a job never overwrites a path that
    an earlier, still-lazy DataFrame reads from. All of a process's scratch
    lies in one folder, which ``clear_scratch`` removes.
    """
    return f"{work_dir(spark)}/tierloom/{_RUN}/{uuid.uuid4().hex}/{name}"


def scratch_database(spark: SparkSession) -> str:
    """A fresh database whose managed tables live under the work folder."""
    name = f"tierloom_{uuid.uuid4().hex[:16]}"
    location = scratch_path(spark, f"{name}.db")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")
    _DATABASES.append(name)
    return name


def clear_scratch(spark: SparkSession) -> None:
    """Drop the databases and the folder that this process made.

    DataFrames are lazy: what was returned by a query still reads its
    scratch. So nothing calls this on its own; call it when the last result
    has been read (tests and the bench do so at their end).
    """
    while _DATABASES:
        spark.sql(f"DROP DATABASE IF EXISTS `{_DATABASES.pop()}` CASCADE")
    delete_path(spark, f"{work_dir(spark)}/tierloom/{_RUN}")


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, qualified path)`` of a location: with scheme and
    authority, without ``//``, ``.`` or a trailing slash; a relative path
    is under the file system's working folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(found)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, found = hadoop_path(spark, path)
    fs.delete(found, True)
