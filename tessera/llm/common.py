"""Helpers of the training-data operators: shared storage, batches, registry."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: White space of the contracts: space, \t, \n, \v, \f and \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[tuple[SparkSession, str]] = []
_registered: list = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application.

    Functions that run there refer to the package's modules; executors may have
    neither the driver's folders nor its path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="tessera-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    context.addPyFile(str(path))


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it.

    Written tables survive the loss of any executor. They are removed when the
    driver's Python ends, or by :func:`remove_written` (a service calls it once
    it has stored its results).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _registered:
        _registered.append(atexit.register(remove_written))
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Delete every table of :func:`materialize`; frames that read them are of no use afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone; the folder belongs to the job
            return


#: So many of the heaviest keys may be cut into pieces, each of such a part of all rows.
HOT = 2000


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, spread: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys``, a written table with one row for each ``on``, whatever share of ``rows`` one key has.

    ``weight`` says how many rows a key has. The 2000 heaviest keys are
    broadcast: their rows are dealt by ``spread`` into pieces of a 2000th of
    all rows, and each piece meets its own copy of the key. Lighter keys are
    one piece. ``total`` is the sum of the weights, if known. ``weight`` is
    dropped.
    """
    if total is None:
        total = keys.agg(F.sum(weight)).first()[0]
    if not total:
        return rows.join(keys.drop(weight), on)
    pieces = F.ceil(F.col(weight) * HOT / total).cast("int")
    heavy = keys.orderBy(F.desc(weight)).limit(HOT).select(*on, pieces.alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_pieces")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(heavy), on, "left").withColumn("_piece", piece).drop("_pieces")
    copied = keys.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(weight)
    return dealt.join(copied, [*on, "_piece"]).drop("_piece")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the memory of Arrow batches of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Like :func:`small_batches`, for jobs that run inside; the session then has its own settings again."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    small_batches(spark, rows)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone. Texts of single bytes take the fast built-in."""
    plain = F.length(column) == F.octet_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
