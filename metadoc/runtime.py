"""Session settings and the few helpers that touch the cluster: shared tables, checked broadcasts."""

import uuid
from collections import deque
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def session(name="metadoc", master=None, shuffle_partitions=None, **settings):
    """A session with the settings the operators count on; AQE splits skewed join partitions."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/metadoc-shared"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df, label):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and lets several readers share one pass.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/metadoc/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark, path):
    """File system and path object of ``path``, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark, path, marker="_SUCCESS"):
    """Names of the folders in ``path`` that hold ``marker``, as a finished write does; none without ``path``."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(at)
                  if s.isDirectory() and fs.exists(child(s.getPath(), marker)))


def remove(spark, path):
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def reserve_number(spark, path, least=0):
    """A number from ``least`` up that no other call with this ``path`` gets, in any application.

    Each number is a file in the folder ``path``; who creates it owns it, and a failed run wastes its number.
    The file system has to create files exclusively, as HDFS and local disks do.
    """
    fs, folder = _hadoop(spark, path)
    fs.mkdirs(folder)
    jvm = spark._jvm
    while True:
        taken = [int(name) for s in fs.listStatus(folder) if (name := s.getPath().getName()).isdigit()]
        number = max([least - 1, *taken]) + 1
        file = jvm.org.apache.hadoop.fs.Path(folder, str(number))
        try:
            if fs.getScheme() == "file":
                # Hadoop's local file system looks first and creates then.
                attributes = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(file.toUri().getPath()).toPath(), attributes)
            else:
                fs.create(file, False).close()
            return number
        except Py4JJavaError as problem:
            if "AlreadyExists" not in problem.java_exception.getClass().getName():
                raise


def in_order(rows, call, lane=None, lanes=16, waiting=64):
    """``call(row)`` for each row, ``lanes`` at a time; results come in the order of the rows.

    No more than ``waiting`` calls are begun ahead of the result that is asked for, so rows stream. Rows with
    equal ``lane(row)`` are called one after another, in order. ``call`` should not raise.
    """
    pools = [ThreadPoolExecutor(1) for _ in range(lanes)]
    begun = deque()
    try:
        for at, row in enumerate(rows):
            pool = pools[(at if lane is None else hash(lane(row))) % lanes]
            begun.append(pool.submit(call, row))
            if len(begun) >= waiting:
                yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()
    finally:
        for pool in pools:
            pool.shutdown(wait=True, cancel_futures=True)


def append_each(spark, path, makers, failed, batch=32):
    """Append one small frame per maker to the table at ``path``, many frames per Spark job.

    ``makers`` yields (label, function without arguments). A job that fails leaves nothing behind; its
    frames are then written one by one, and ``failed(label, problem)`` makes the row of a failing one.
    """

    def write(frames):
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        whole.write.mode("append").parquet(path)

    def write_each(pending):
        for label, make in pending:
            try:
                write([make()])
            except Exception as problem:
                write([failed(label, problem)])

    pending = []

    def flush():
        if pending:
            try:
                write([make() for _, make in pending])
            except Exception:
                write_each(pending)
            pending.clear()

    for maker in makers:
        pending.append(maker)
        if len(pending) >= batch:
            flush()
    flush()


# Narrow frames are broadcast only after counting that they have no more rows than this; larger ones
# join by shuffle.
BROADCAST_ROWS = 200_000


def spread(df, *keys):
    """Rows of a plain scan with fewer splits than the cluster has cores, dealt out to all of them.

    For frames ahead of a step that costs much more than reading them. A scan with enough splits, as
    any large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def deal(df, *keys):
    """Rows dealt out by ``keys`` over all shuffle partitions, for a costly step per row.

    The number is given, so that AQE does not merge partitions that are small but slow.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
