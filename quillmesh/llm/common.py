"""Helpers shared by the operators: shared folder, materialised tables, column guards."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table of the benchmark tokeniser: A-Z to a-z, every ASCII byte that is neither digit nor letter to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8 bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a local session may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="quillmesh-"))
    return _FALLBACK[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder belongs to the cluster
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing still to be computed reads."""
    for t in tables:
        if t is not None:
            _remove(t.sparkSession, t.written_at)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, can't clash with those an operator adds."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def ident(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches again, of at most ``rows`` rows each, so that Python holds few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        trim()
    trim()


def trim() -> None:
    """Gives freed memory back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
