"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwright.session import BATCH_BYTES, BATCH_ROWS, in_small_batches  # noqa: F401 - for the operators

#: Stands for a null id inside joins; results turn it back into null.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tierwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table that ``stored`` has returned and that nothing still to be run reads."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark drop what finished jobs have left on the executors, broadcast tables and shuffle files.

    Spark does so when the driver collects its garbage, which a driver with little to do may put off for a whole chain
    of jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(df: DataFrame, column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def key_of(df: DataFrame, column: str = "doc_id") -> Column:
    return F.coalesce(df[column].cast("long"), F.lit(NO_ID))


def id_of(column: str = "doc_id") -> Column:
    """What ``key_of`` stands for: the id, or null."""
    return F.nullif(F.col(column), F.lit(NO_ID))


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id as text leaves the remainder 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of strings, binaries and arrays up to which a table is broadcast.
BROADCAST_BYTES = 48 << 20


def sized(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint where counts prove that it has at most ``rows`` rows and ``most`` bytes of values of
    no fixed width; as it is beyond."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    width = sum((F.coalesce(wide[t](c) if t in wide else F.size(c) * 8, F.lit(0)) for c, t in df.dtypes if t in wide or t.startswith("array")), F.lit(0))
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most else df


def commonest(df: DataFrame, column: str, rows: int) -> Column:
    """The condition that holds for the rows of the greatest values (1 or more) of ``column``: ``rows`` of them at most.

    The cut lies between two classes of values, some 1,000 in all, so no order over all rows is needed.
    """
    of = F.floor(F.log2(F.col(column)) * 16)
    cut, total = None, 0
    for r in sorted(df.groupBy(of.alias("class")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        total += r["n"]
        if total > rows:
            break
        cut = r["class"]
    return F.lit(False) if cut is None else of >= cut


def words_of(text: str) -> list[str]:
    """The words between runs of ASCII white space, with A-Z in lower case."""
    # on bytes, lower() and split() know ASCII only
    words = text.encode("utf-8", "replace").lower().split()
    return b" ".join(words).decode().split(" ") if words else []
