"""Shared plumbing of the text operators: tables, shared storage and bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text and rows that one Python step holds at a time.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1024
#: Entries after which a per-worker word cache is emptied.
CACHE_WORDS = 400_000


_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "decimal": T.DecimalType(38, 0)}


def fields(text: str) -> T.StructType:
    """The schema of "name kind, ..."; a kind with [] behind it is an array. Needs no session."""
    pairs = (f.split() for f in text.split(","))
    return T.StructType([T.StructField(n, T.ArrayType(_KINDS[k[:-2]]) if k.endswith("[]") else _KINDS[k]) for n, k in pairs])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers get small whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception as e:  # noqa: BLE001  older releases lack the setting
        if "CONFIG" not in str(e).upper():
            raise


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only in a local session without one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage is cut there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of at most CHUNK_ROWS rows and about CHUNK_BYTES of text, with the texts as UTF-8."""
    raw = batch.column(column).cast(pa.binary())
    sizes = pa.compute.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > CHUNK_BYTES or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start), raw.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start), raw.slice(start).to_pylist()


def map_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list[bytes | None]], dict]], schema: T.StructType, column: str = "text") -> DataFrame:
    """Rows of `keep` plus what the step says of each text.

    `make` runs once a task and returns a step from a list of UTF-8 texts to columns of equal length; `schema` names the
    step's columns. Other columns of `df` are never read.
    """
    source = df.select(*keep, *[F.col(column)] * (column not in keep))
    fields = [source.schema[c] for c in keep] + list(schema)
    full = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(full)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part, texts in chunks(batch, column):
                out = step(texts)
                arrays = [part.column(c).cast(target.field(c).type) for c in keep]
                arrays += [pa.array(out[n], type=target.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return source.mapInArrow(run, full)


def sampled(df: DataFrame, rows: int, column: str = "doc_id") -> DataFrame:
    """The `rows` rows whose ids come first by a hash; only a few times as many leave the tasks, however many `df` has."""
    value = F.pmod(F.xxhash64(column), F.lit(1 << 31))
    most = int((1 << 31) * min(1.0, (3 * rows + 1000) / max(1, df.count())))
    return df.where(value < most).orderBy(value, *df.columns).limit(rows)


def held_out(column: str = "doc_id"):
    """The fold that nothing may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
