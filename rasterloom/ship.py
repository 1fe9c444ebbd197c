"""What a cluster needs: this package on the executors, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session, once. Operators whose functions run in Python workers call it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, the warehouse, which driver and executors share too; with a local master, a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="spark-") if sc.master.startswith("local[") or sc.master == "local" else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stored"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_group(df: DataFrame, key: str, make: Callable[[list[dict]], dict | list[dict]], schema: str) -> DataFrame:
    """The row or the rows make(rows) for each key of df. Keys are dealt by hash and come one after another, so thousands of small groups cost no frame each, and a task holds one group and one batch. Partitions aren't merged by size, as the work is in Python."""

    def made(rows: list[dict]) -> list[dict]:
        got = make(rows)
        return got if isinstance(got, list) else [got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if rows and row[key] != rows[0][key]:
                    out += made(rows)
                    rows = []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if rows:
            yield pa.RecordBatch.from_pylist(made(rows), kind)

    kind = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).mapInArrow(run, schema)
