"""Writers that leave an unchanged target alone, and markdown blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwright.sinks.manifest import manifest, stale_parts

#: A folder that readers of the table do not see.
MANIFEST = "_manifest"


def freeze(df: DataFrame, path: str, kind: str = "json") -> None:
    """Replaces what is at the path by the table, as JSON or Parquet.

    The table may read the path itself: it is written beside it first, and what was there goes when that is complete.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    getattr(df.write, kind)(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(beside), hadoop.Path(path)
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old):
        files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{beside} is complete, but could not be moved to {path}")


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def freeze_if_changed(df: DataFrame, path: str) -> bool:
    """Writes the table as Parquet if the path has none, or other rows; says whether it wrote.

    A manifest of the rows is kept beside the files, so the table that is there is not read again.
    """
    spark, kept = df.sparkSession, f"{path.rstrip('/')}/{MANIFEST}"
    if there(spark, kept) and spark.read.parquet(path).schema.simpleString() == df.schema.simpleString():
        if not stale_parts(spark.read.parquet(kept), manifest(df, F.lit(0))).limit(1).count():
            return False
    freeze(df, path, "parquet")
    # of what was written: the table may give other rows, or read the path, a second time
    manifest(spark.read.parquet(path), F.lit(0)).write.parquet(kept)
    return True


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A table of report size as markdown; more than ``most`` rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *([("" if v is None else str(v)) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def rendered(text: str, blocks: dict[str, str]) -> str:
    """The text with each block put between its markers ``<!-- name -->`` and ``<!-- /name -->``."""
    for name, block in blocks.items():
        begin, end = f"<!-- {name} -->", f"<!-- /{name} -->"
        i, j = text.find(begin), text.find(end)
        if i < 0 or j < i:
            raise ValueError(f"markers of {name} are missing or the wrong way round")
        text = f"{text[: i + len(begin)]}\n{block}\n{text[j:]}"
    return text


def stale_blocks(text: str, blocks: dict[str, str]) -> list[str]:
    """The names of the blocks that the text does not show as they are."""
    return [n for n, b in blocks.items() if rendered(text, {n: b}) != text]
