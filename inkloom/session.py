"""Session helpers: table access, the shared working folder, size-checked broadcasts."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object (bytes) that is ever sent to every executor as a broadcast variable.
MAX_BROADCAST_BYTES = 32 << 20

#: Python's notion of white space as a Java character class.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_inkloom_shipped", False):
        return
    package, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/inkloom-code-{uuid.uuid4().hex[:12]}.zip")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(place.toString())
    sc._inkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a local one in local mode (tests),
    an error on a cluster."""
    ship(spark)
    return _folder(spark)


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/inkloom-{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut``, as a compressed table: for wide rows, whose checkpoint would take several times the space."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checked_broadcast(spark: SparkSession, value: object, n_bytes: int):
    """A broadcast variable for data whose size has been measured."""
    if n_bytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"{n_bytes} bytes are more than the {MAX_BROADCAST_BYTES} that may be broadcast")
    ship(spark)
    return spark.sparkContext.broadcast(value)


def small_side(df: DataFrame, most: int = MAX_BROADCAST_BYTES // 4) -> DataFrame:
    """``df`` for one side of a join: hinted as broadcast where its rows, measured, take at most ``most`` bytes as text;
    else as it is, for a join by exchange that adaptive execution may split. ``df`` should be stored: it is read twice."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).head()[0] or 0
    return F.broadcast(df) if size <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` in a fixed number, for work that costs far more CPU than its bytes suggest: adaptive
    execution would join small partitions into a few tasks. A later groupBy, window or join on the keys needs no
    further exchange."""
    spark = df.sparkSession
    ship(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def is_blank(col):
    """True for null or white-space-only text."""
    return col.isNull() | col.rlike(BLANK)


def latest_blocks(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row per (book_id, block_id), whatever rows repeat; of differing rows the greatest is kept."""
    keys = ("book_id", "block_id")
    rest = [c for c in columns if c not in keys]
    return (
        spread(blocks.select(*keys, *rest).where("book_id is not null and block_id is not null"), *keys)
        .groupBy(*keys)
        .agg(F.max(F.struct(*rest)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )
