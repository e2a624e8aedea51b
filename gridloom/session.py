"""Session helpers: the shared folder for cut lineage, and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .errors import WorkspaceError

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one machine, may fall back to a
    folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise WorkspaceError("checkpoint_dir_missing", f"Set {CHECKPOINT_CONF} to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of a batch that Spark hands to Python at most, once ``small_batches`` was called.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in small batches; smaller ones that it has set stay.

    By default a batch holds up to 10000 rows or 64 MB, once in the executor and once in each of its Python workers.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as their file systems list them; 0 where it reads none."""
    context = df.sparkSession.sparkContext
    conf, jvm = context._jsc.hadoopConfiguration(), context._jvm
    found = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in found)


_staged: list[str] = []


def staged() -> int:
    """How many folders ``stage`` has written so far; a mark for ``drop_staged``."""
    return len(_staged)


def drop_staged(spark: SparkSession, start: int, end: int | None = None) -> None:
    """Delete the folders staged between two marks; only for a caller whose results no longer need them."""
    context = spark.sparkContext
    for i, path in enumerate(_staged[start:end], start):
        if path:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            _staged[i] = ""


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage cut, survives lost executors.

    File names carry the partition number, so reading them by path keeps the order of ``df``.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the caller's own; one that is not there is no error."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content; False where it is there already.

    This is a hard link on a local file system and a rename without overwriting elsewhere; the file system has to make
    that atomic, as HDFS does.
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    entry = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(entry.getParent(), f".{uuid.uuid4().hex}")
    files = entry.getFileSystem(conf)
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            local = [jvm.java.io.File(files.makeQualified(p).toUri().getPath()).toPath() for p in (entry, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            hadoop = jvm.org.apache.hadoop.fs
            plain = context._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(files.getUri(), conf).rename(draft, entry, plain)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(draft, False)
    return True
