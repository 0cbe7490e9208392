"""Shared storage for cutting lineage; never a machine-local folder on a cluster."""

import tempfile
import uuid
from contextlib import ExitStack, contextmanager

from pyspark.sql import types as T


def shared_dir(spark):
    """The folder named in `spark.checkpoint.dir`; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="twinframe-")
    return folder


def new_path(spark, label):
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark, path):
    """Delete a folder that `new_path` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(df):
    """A frame read from files with at least one partition per core.

    A small or unsplittable file arrives in one task; work in Python wants all
    cores. Larger inputs have enough partitions and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def setting(spark, name, value):
    """The setting has this value for what is run in the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_freed(spark):
    """Queries that end in the block leave no shuffle files, which else stay until the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def short_methods(spark):
    """Steps whose generated method the JVM would refuse to compile, at 8,000 bytes, run as several methods that it compiles."""
    return setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def written(df, label="written", folders=None, **options):
    """Write the frame to the shared folder once and go on from there; `options` are the Parquet writer's.

    The files stay, as checkpoint files do, unless `folders`, an ExitStack, is
    there to delete them. Columns without a type cannot be written; such a frame
    is returned as it is.
    """
    if any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return df
    path = new_path(df.sparkSession, label)
    if folders is not None:
        folders.callback(remove, df.sparkSession, path)
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df, folders, label="stored"):
    """The frame, written to the shared folder once and read from there; `folders`, an ExitStack, deletes the files."""
    path = new_path(df.sparkSession, label)
    folders.callback(remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df, label="kept"):
    """The frame, written to the shared folder once and read from there; the files go when the block ends."""
    with ExitStack() as folders:
        yield stored(df, folders, label)
