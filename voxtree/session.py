"""Session set-up, and how this library cuts a lineage.

Tables are written to the folder that ``spark.checkpoint.dir`` names, which every executor shares, so that a
lost executor costs a re-read and never a recomputation of the whole plan. A session of one process that
names no folder gets one beside its shuffle files; a cluster must name one.
"""

from __future__ import annotations

import io
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def get_session(app: str = "voxtree", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries are written for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once; they may have neither its folder nor its path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    name = f"{shared_dir(spark)}/packages/{uuid.uuid4().hex}/voxtree.zip"
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(at)
    out.write(held.getvalue())
    out.close()
    files.deleteOnExit(at)
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session that runs in one process may have none: nothing there is
    read by another machine."""
    context = spark.sparkContext
    named = spark.conf.get(KEY, None) or context.getConf().get(KEY, None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {KEY} to a folder that all executors share")
        scratch = context.getConf().get("spark.local.dir", None) or spark._jvm.System.getProperty("java.io.tmpdir")
        context.setCheckpointDir(named or f"file:{scratch.split(',')[0]}/voxtree-{context.applicationId}")
        current = context.getCheckpointDir()
    return named or current.rsplit("/", 1)[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read it.

    Unlike a checkpoint the plan runs once, and the table has its true size in its statistics, so that
    the planner broadcasts it only where it is below ``spark.sql.autoBroadcastJoinThreshold``. The
    files are removed when the application ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(hadoop).deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    _places[id(table)] = (weakref.ref(table), at)
    return table


#: Where the tables of ``materialize`` are.
_places: dict[int, tuple] = {}


def release(table: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    known, at = _places.pop(id(table), (None, None))
    if known is not None and known() is table:
        at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
