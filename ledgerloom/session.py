"""Sessions, the shared working folder, and joins that broadcast only what was measured."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes as held in memory; beyond it the join shuffles.
BROADCAST_LIMIT = 64 << 20
#: Bytes that a row takes in a broadcast table besides its strings.
ROW_OVERHEAD = 64


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session given."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_roots: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, which need not have it installed; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="ledgerloom-code-")  # read by the driver only, which serves it
        archive = os.path.join(folder, "ledgerloom_code.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for at, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(here)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; removed when Python ends.

    Where the setting is missing (tests on a local master) a temporary folder takes its place; on a real cluster its
    absence is an error, as a machine-local folder would lose data with the machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _open[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the stages that were written within: for sessions that run many queries one after another.

    A query's result must be consumed inside, as it reads its stages. Indexes and states with a root of their own stay.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for p in paths:
            _remove(spark, p)


def stored(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: later reads neither repeat its work nor depend on executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """stored(), and aggregates of the rows taken in the same pass instead of by a further job."""
    seen = Observation()
    observed = df.observe(seen, *(m.alias(k) for k, m in measures.items()))
    return stored(observed, name), seen.get


def publish(df: DataFrame, root: str, keep: int = 2) -> str:
    """Write df as a new version below root, then make it current by one rename; readers see all of it or none.

    Spark's own commit puts the files in place; the pointer file is written aside and renamed, the atomic step.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(f"{root}/{version}")
    tmp, fs = _hadoop(spark, f"{root}/_current.{version}")
    out = fs.create(tmp, True)
    out.write(version.encode())
    out.close()
    current, _ = _hadoop(spark, f"{root}/_current")
    fc = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = fc.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(fc.Options.Rename, 1)
    options[0] = fc.Options.Rename.valueOf("OVERWRITE")
    context.rename(tmp, current, options)
    versions = sorted((s for s in fs.listStatus(current.getParent()) if s.getPath().getName().startswith("v-")), key=lambda s: s.getModificationTime())
    for s in versions[:-keep]:
        if s.getPath().getName() != version:
            fs.delete(s.getPath(), True)
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that publish() made current last."""
    p, fs = _hadoop(spark, f"{root}/_current")
    stream = fs.open(p)
    try:
        version = bytes(b & 255 for b in stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{root}/{version}")


def measured(df: DataFrame, limit: int = BROADCAST_LIMIT) -> tuple[DataFrame, bool]:
    """df stored once, and whether it is small enough in memory to be broadcast.

    The size is taken from all rows: overhead for each plus the length of every string, binary and array column.
    """
    kept = stored(df, "side")
    width = F.lit(ROW_OVERHEAD)
    for name, kind in kept.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
        else:
            width = width + F.lit(8)
    total = kept.agg(F.sum(width).alias("b")).first()["b"] or 0
    return kept, total <= limit


def join_measured(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """big join small, broadcast if small's measured size allows it, else shuffled (AQE then splits skewed keys)."""
    kept, fits = measured(small, limit)
    return big.join(F.broadcast(kept) if fits else kept.hint("merge"), on, how)


def known_size(df: DataFrame) -> int | None:
    """The planner's estimate of df's bytes, or None where it knows nothing of its source; runs no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """Enough partitions for the rows, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
