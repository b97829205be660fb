"""Session helpers: a tuned local session, and the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench, with a shared folder of its own; on a cluster the submitter
    configures the session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tillmark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, for those that do not have it installed.

    Once for a session is enough. Needed wherever the package lies on the driver's path only.
    """
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tillmark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session within one process (``local[...]``) without that setting gets a folder of its own:
    on a cluster a machine-local folder would lose data together with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tillmark-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return (named or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tillmark/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Evaluate once and keep the rows in the shared folder, so that several readers see
    the same rows even when executors are lost in between."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require_steady_clock(spark: SparkSession) -> None:
    """Refuse session time zones with clock changes.

    Transactions carry local times without a zone. In a zone with clock changes Spark would move
    those that fall into a change, and rows would merge.
    """
    name = spark.conf.get("spark.sql.session.timeZone")
    if re.fullmatch(r"Z|UTC|GMT|(UTC|GMT|UT)?[+-]\d{1,2}(:?\d{2})?(:?\d{2})?", name):
        return
    zone = ZoneInfo(name)
    offsets = {datetime(year, month, 1, tzinfo=zone).utcoffset() for year in range(1970, 2038) for month in range(1, 13)}
    if len(offsets) > 1:
        raise ValueError(f"clocks change in {name}: set spark.sql.session.timeZone to UTC")
