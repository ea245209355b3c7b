"""Session settings and shared-folder staging."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A workflow with more tasks than this is never gathered into one array: the
# operators that fold a workflow inside one row send it down a distributed path.
MAX_FOLD_TASKS = 4096

#: Stored bytes of input for each partition that a shuffle begins with: rows take some twenty times that in memory.
PARTITION_BYTES = 8 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Temporary folders, in the system's place for them, of applications with a local master
# and without ``spark.checkpoint.dir``.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "fleetplan", **conf) -> SparkSession:
    """A session with the settings the operators rely on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only on a local
    master: on a cluster such a folder would live on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if not context.master.startswith("local") and folder.startswith("file:"):
            raise RuntimeError("spark.checkpoint.dir is a folder of one machine; executors need a shared one")
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="fleetplan-")
    return _LOCAL_DIRS[app]


def fit_shuffles(spark: SparkSession, paths: list[str]) -> None:
    """Let shuffles begin with as many partitions as these inputs ask for, so that what a task sorts does not grow with
    the input and stays in memory. Adaptive execution joins the partitions that turn out small; a higher
    number that is set already stays."""
    size = 0
    for path in paths:
        files, target = _file_system(spark, path)
        size += files.getContentSummary(target).getLength() if files.exists(target) else 0
    wanted = -(-size // PARTITION_BYTES)
    if wanted > shuffle_partitions(spark):
        spark.conf.set(_INITIAL, str(wanted))


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of partitions that a shuffle begins with."""
    return int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage of iterative jobs: a lost executor costs a re-read of the
    files, and each round is computed exactly once.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/staged/{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged. Results that still read
    staged files must have been written or collected before."""
    folder = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table that replaces its own parts."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text, unless there is one: False then. The text is written beside and takes its
    name in one step that never replaces a file, so of several writers one succeeds and no reader sees half of it."""
    files, target = _file_system(spark, path)
    files.mkdirs(target.getParent())
    jvm = spark.sparkContext._jvm
    _, draft = _file_system(spark, f"{target.getParent()}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(text.encode())
    out.close()
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    keep[0] = getattr(fs, "Options$Rename").NONE
    try:
        context.rename(draft, target, keep)
        return True
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=N`` in a folder; none if it does not exist."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return [int(n.partition("=")[2]) for n in names if n.startswith(f"{name}=")]


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def spread(df: DataFrame) -> DataFrame:
    """Raise the number of partitions to the number of cores where a small input
    sits in fewer; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def large_groups(df: DataFrame, key: str, max_rows: int) -> DataFrame | None:
    """The keys with more than ``max_rows`` rows and their counts, or None.

    Counts combine before the shuffle; there are at most rows / ``max_rows``
    such keys. The result is a stored table, so later joins know its size.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    large = stage(counts.where(F.col("n_rows") > max_rows), "large-groups")
    return None if large.isEmpty() else large
