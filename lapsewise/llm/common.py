"""What the operators share: word patterns, folds, table reads and Arrow mapping."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# A word is a run of anything but ASCII white space, in Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
MAX_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key written as text, modulo folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_shipped: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Hand this package to the executors, and bound Arrow batches by bytes as well as
    rows: a table of very long texts must not make a batch a worker cannot hold."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        if (root / "lapsewise").is_dir():  # not when it runs from an archive already
            folder = tempfile.mkdtemp(prefix="lapsewise-code-")
            with zipfile.ZipFile(f"{folder}/lapsewise_code.zip", "w") as archive:
                for file in sorted((root / "lapsewise").rglob("*.py")):
                    archive.write(file, file.relative_to(root))
            spark.sparkContext.addPyFile(f"{folder}/lapsewise_code.zip")
        _shipped.add(app)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("-1", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(key, str(MAX_BATCH_BYTES))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator is about to write."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def append_columns(
    df: DataFrame,
    fields: list[tuple[str, DataType]],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
) -> DataFrame:
    """df with columns made from each Arrow batch. A column of df that has the name of
    a new one is replaced, after make has seen it."""
    prepare_workers(df.sparkSession)
    names = [name for name, _ in fields]
    kept = without(df, *names)
    schema = StructType(
        [*kept.schema.fields, *[StructField(name, kind, True) for name, kind in fields]]
    )
    keep = kept.columns

    def run(batches):
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *made], names=[*keep, *names]
            )

    return df.mapInArrow(run, schema)
