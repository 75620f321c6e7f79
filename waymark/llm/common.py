"""Shared pieces: durable intermediate tables, hash folds, and batching of texts for Arrow tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: the space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Arrow tasks gather texts until they hold this many characters, then compute.
CHUNK_CHARS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where that is not set, a folder of this machine for a local master; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of the tables stored in the innermost ``scratch`` block of this thread; none outside of one.
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, however it ends, the tables that this thread stored in it, for work whose result is by then stored elsewhere."""
    token = _kept.set([])
    try:
        yield
    finally:
        paths = _kept.get()
        _kept.reset(token)
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        for path in paths:
            hadoop.Path(path).getFileSystem(conf).delete(hadoop.Path(path), True)


#: The setting by which Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table", read_once: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and outlives executors. Where nothing else will run ``df`` (``read_once``), its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    if read_once:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (kept := _kept.get()) is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote, once nothing reads them any more. Results that are still to be computed need theirs."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/waymark-" in path:
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: rows with remainder 1 are held out of every training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def sample_rank(doc_id: Column, seed: int) -> Column:
    """A hash order of ids, for bounded samples that do not depend on the layout of the table."""
    return F.xxhash64(doc_id.cast("string"), F.lit(seed))


#: What frees the caches that an operator keeps in reused workers, once another operator runs there.
forget: list[Callable[[], None]] = []


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS, most: int = 1024, keep_caches: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of up to ``limit`` characters and ``most`` rows; a longer text stands alone."""
    if not keep_caches:
        for free in forget:
            free()
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(column(batch, text)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate([*sizes, limit + 1]):
            if i > begin and (held + size > limit or i - begin >= most):
                part = batch.slice(begin, i - begin)
                yield part, [t or "" for t in column(part, text).to_pylist()]
                begin, held = i, 0
            held += size


def one_per_id(rows: DataFrame, id_col: str, *others: str) -> DataFrame:
    """The id, its text and the least of the other columns, one row for each id. Of the texts of a repeated id the one with the least hash counts, whatever the order of rows."""
    least = [F.min(c).alias(c) for c in others]
    return rows.groupBy(id_col).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), *least)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def plainly(docs: DataFrame, kept: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with neutral names for all columns but ``kept``, and a function that gives a result its own names back.

    Names that a stage adds then never clash with those of the table.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{n}`").alias(n if n in kept else f"c{i}") for i, n in enumerate(names)])
    return plain, lambda out: out.select(*[F.col(p).alias(n) for p, n in zip(plain.columns, names, strict=True)])


def shingles_sql(table: str, key: str) -> str:
    """SQL of (key, shingle) pairs: the distinct runs of five words of each text, or all words of a shorter one, as joined texts."""
    words = f"SELECT {key}, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS shingle FROM ({words}) WHERE len(w) > 0"
