"""Session set-up and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def object_store_conf(
    env: Mapping[str, str] = os.environ, package: str | None = None
) -> dict[str, str]:
    """S3A settings. Keys come from the environment; without them the cluster's
    own credential chain is left alone."""
    conf = {}
    if package:
        conf["spark.jars.packages"] = package
    if env.get("AWS_ACCESS_KEY_ID") and env.get("AWS_SECRET_ACCESS_KEY"):
        conf |= {
            "spark.hadoop.fs.s3a.aws.credentials.provider": (
                "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
            ),
            "spark.hadoop.fs.s3a.access.key": env["AWS_ACCESS_KEY_ID"],
            "spark.hadoop.fs.s3a.secret.key": env["AWS_SECRET_ACCESS_KEY"],
        }
    return conf


def build_session(
    app: str = "ordermart",
    master: str | None = None,
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution; master and sizes are the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="ordermart-")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir for one run's written tables.

    Every executor must see it, so a machine-local folder stands in for an unset
    one only where the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_dir()
    return f"{root.rstrip('/')}/ordermart-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def put_folder(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder, if it is there, to where another one may be, which goes. File systems
    with folders only rename it."""
    remove_folder(spark, target)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(old):
        return
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"{path} could not be moved to {target}")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so that joins with it cost
    no scan and no shuffle."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).select(*columns).filter(F.lit(False))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).parent
    file = Path(tempfile.mkdtemp(prefix="ordermart-")) / "ordermart.zip"
    with zipfile.ZipFile(file, "w") as packed:
        for source in sorted(home.rglob("*.py")):
            packed.write(source, source.relative_to(home.parent))
    context.addPyFile(str(file))
    _shipped.add(context.applicationId)


#: Applications that have the package.
_shipped: set[str] = set()
