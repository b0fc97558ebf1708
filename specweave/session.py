"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_DIRS: list[str] = []


def build_session(app: str = "specweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``; ``cols`` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def schema_plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only on one machine (a local master)
    a temporary folder, removed at exit, takes its place; on a cluster its absence is an error, as
    every executor would write to a disk of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("stage tables need a folder that all executors share: set spark.checkpoint.dir")
        where = tempfile.mkdtemp(prefix="specweave-")
        _LOCAL_DIRS.append(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def drop_stages(spark: SparkSession) -> None:
    """Remove the stage tables that this application wrote; what was read from them is gone with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read and not a recomputation. Columnar and compressed, hence smaller
    than ``checkpoint()``. :func:`drop_stages` removes all of an application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_width(df: DataFrame, least: int = 1) -> DataFrame:
    """Spread a scan of one small file over the cores when Python work follows it.

    A large input already has more splits than cores and is left alone, so no shuffle is added
    where it would cost anything."""
    want = max(least, df.sparkSession.sparkContext.defaultParallelism)
    have = df.rdd.getNumPartitions()
    return df if have * 2 > want else df.repartition(want)


@atexit.register
def _clean() -> None:
    for d in _LOCAL_DIRS:
        shutil.rmtree(d, ignore_errors=True)
