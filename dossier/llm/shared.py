"""The shared folder of the cluster, tables written there to cut lineage, and names of columns."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most bytes of a batch of rows between Spark and its Python workers, unless the session has its own setting.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one that was set on the context. Where there is neither and Spark is
    local, a temporary folder is made and set on the context, once."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows survives lost executors and never runs its plan again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` of which all that follows has been written itself."""
    for df in tables:
        if path := _paths.pop(df, None):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of a session by bytes, so that a Python worker's memory doesn't follow the length of its rows."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` under names without dots and backticks, which Arrow functions don't resolve; ``toDF`` with the old names goes back."""
    odd = [c for c in df.columns if "." in c or "`" in c]
    new = dict(zip(odd, free_names(df, *(f"odd{k}" for k in range(len(odd)))), strict=True))
    return df.toDF(*(new.get(c, c) for c in df.columns)) if odd else df


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
