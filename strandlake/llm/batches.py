"""Shared helpers: Arrow batch mapping, word splitting, scratch checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words of kind ``[^\x20\x09-\x0D]+``.
BLANKS = "[ \t-\r]+"

#: Byte table: A-Z to lower case, every other ASCII byte that is no digit or letter to a space.
#: Bytes from 0x80 stay, so splitting the result gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def folded_words(data: bytes | None) -> list[bytes]:
    """Lower-cased alphanumeric words of a UTF-8 text; none for null."""
    return data.translate(FOLD).split() if data else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """A text column as bytes objects, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_rows(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: list[tuple[str, T.DataType]],
    keep: list[str] | None = None,
    rows: int = 1024,
) -> DataFrame:
    """Append columns computed by ``work`` from slices of at most ``rows`` rows.

    ``keep`` names the input columns that stay (all by default).  Slices bound the Python objects that
    exist at a time, whatever the size of the Arrow batches.
    """
    stay = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in stay] + [T.StructField(n, t) for n, t in fields])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in stay] + [made[n] for n in names],
                    names=[*stay, *names],
                )

    return df.mapInArrow(run, schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later stage reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out() -> F.Column:
    """True for the rows that no learner may take labels from: crc32 of the id's text divisible by 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


os.environ.setdefault("OMP_NUM_THREADS", "1")
