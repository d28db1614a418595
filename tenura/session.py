"""Session building and the shared folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tenura", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    On a cluster leave `master` unset and let the launcher provide it together with
    `spark.checkpoint.dir` and the number of shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The JVM never compiles a method beyond 8000 bytes; past that, smaller per-operator methods are faster.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Recording the Python line of every column expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tenura-")
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession, label: str) -> str | None:
    """A path of its own below the shared folder as plain files see it; None where the folder is on another kind of file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, label))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time, as a barrier job needs them; 0 where their number is not fixed."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    if not conf.get("spark.default.parallelism"):
        cores = spark.sparkContext.defaultParallelism
    elif spark.sparkContext.master.startswith("local["):
        cores = 1  # threads are not told from the setting
    else:
        executors = spark._jsc.sc().getExecutorMemoryStatus().size() - 1
        cores = executors * int(conf.get("spark.executor.cores", "1"))
    return cores // int(conf.get("spark.task.cpus", "1"))


def enable_checkpoints(spark: SparkSession) -> None:
    """Point `checkpoint()` and the iterative learners at the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
