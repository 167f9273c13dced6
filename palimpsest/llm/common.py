"""What the operators share: the shared folder, written intermediate tables, size-checked joins, Arrow rows."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.shared import delete, new_folder, shared_dir  # noqa: F401  shared_dir for the operators and their tests

#: Java and Python spelling of the contract's word separators.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Largest size of a side that is broadcast, as ``size_of`` counts; beyond it the join shuffles.
BROADCAST_BYTES = 24_000_000
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a context, for sessions that were started without it."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    held = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(held))
    context._palimpsest_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage, whose first argument is the session, that ships the package first."""
    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


#: The tables of the enclosing ``scratch`` of this thread or task.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators have written within it; not those written with ``keep``."""
    mark = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            delete(spark, path)
        _scope.reset(mark)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors.

    The files go with the enclosing ``scratch``, else when the application's file system closes. The write's shuffle files, which
    nothing will read again, go at its end.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
    if _scope.get() is not None and not keep:
        _scope.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` has returned."""
    delete(df.sparkSession, df._written_to)


def size_of(df: DataFrame) -> int:
    """About how many bytes ``df`` takes on the heap of a task that holds it, counted up to somewhat above BROADCAST_BYTES."""
    def extra(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0))
        return F.coalesce(F.size(name) * 8, F.lit(0)) if isinstance(kind, T.ArrayType) else F.lit(0)

    row = sum((extra(f.name, f.dataType) for f in df.schema), F.lit(32 + 8 * len(df.columns)))
    return df.select(row.alias("n")).limit(BROADCAST_BYTES // 32).agg(F.sum("n")).first()[0] or 0


def join_sized(big: DataFrame, small: DataFrame, size: int, on: Column | list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins with ``small`` broadcast if its ``size_of`` is within ``limit``; else both sides shuffle."""
    return big.join(F.broadcast(small) if size <= limit else small.hint("merge"), on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once for ``body``, so that a lambda inside it does not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def arrow_rows(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """The column's values as UTF-8 bytes."""
    for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()):
        yield x.as_py()
