"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder of its own (tests, one machine).
LOCAL_SCRATCH = "file:///tmp/checkpoints/manyvec"

_held: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings one."""
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("manyvec")
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or LOCAL_SCRATCH where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root or LOCAL_SCRATCH


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: its lineage
    ends here, so a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(release, spark)
    _held.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paths(df: DataFrame) -> list[str] | None:
    """The files of a stored table as paths that all executors have; None where the shared folder isn't mounted."""
    urls = [urlparse(f) for f in df.inputFiles()]
    return sorted(unquote(u.path) for u in urls) if all(u.scheme in ("", "file") for u in urls) else None


def held() -> list[str]:
    """Tables that ``stored`` wrote and that still exist."""
    return list(_held)


def release(spark: SparkSession, paths: list[str] | None = None, keep: DataFrame | None = None) -> None:
    """Deletes scratch tables (all, or those named), but for those that ``keep`` reads. For callers who know that
    nothing else is still to be computed from them."""
    files = keep.inputFiles() if keep is not None else []
    for path in held() if paths is None else [p for p in paths if p in _held]:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
            _remove(spark, path)
            _held.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the JVM may be gone by now; the folder is the cluster's to clean
        pass
