"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.plans.materialize import checkpointed, shared_folder

__all__ = ["Guarded", "bounded_sample", "checkpointed", "chunks", "crc_mod", "dropped", "released", "stored", "table", "text_bytes", "tidied"]


class Guarded:
    """A table under column names of our own, so that no name of an input column can clash with ours.

    ``guarded["text"]`` is our name for a column (the first, if several have the name).
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_in{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"_in{self.names.index(name)}"

    def restored(self, df: DataFrame) -> DataFrame:
        """The input's columns of ``df`` under their names again."""
        return df.select(*self.df.columns).toDF(*self.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null counting as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Like :func:`checkpointed`, but columnar and compressed: for larger intermediate tables.
    The files stay until the folder is cleared, as checkpoints do.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of :func:`stored` tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[-1].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Let the driver forget the plans of finished steps and give back memory, and Spark delete the shuffle files that only these used."""
    gc.collect()
    released()
    spark._jvm.System.gc()


def released() -> None:
    """Give memory that a task no longer uses back to the system: its process lives on for the next tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(texts: Iterable[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    """Consecutive texts, gathered up to about ``most`` bytes (one text at least)."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def bounded_sample(rows: DataFrame, by: str, most: int, total: int, seed: int = 0) -> DataFrame:
    """``(doc_id, by)`` of up to ``most`` rows for each value of ``by`` and about ``total`` in all, five of each at least.

    Chosen by a hash of the id, in two steps: each of 256 parts of a group gives four times its share at
    most (so all of a small group), and the first of these are taken.  No task gets a large group.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    found = rows.select("doc_id", by, order.alias("_o")).withColumn("_part", F.pmod("_o", F.lit(256)))
    groups = rows.select(by).distinct().count()
    most = max(5, min(most, total // max(1, groups)))
    for keys, first in (([by, "_part"], -(-4 * most // 256)), ([by], most)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "doc_id"))
        found = found.withColumn("_rank", rank).where(F.col("_rank") <= first).drop("_rank")
    return found.select("doc_id", by).distinct()
