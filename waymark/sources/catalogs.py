"""Loading and publishing catalogs of JSON documents as tables."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed schemas of the four documents of a catalog.
SCHEMAS = {
    "routes": "route_id string, route_number string, name string, short_name string, former_name string, category string, status string, is_active boolean, effective_from string, effective_to string, source_url string, last_verified_at string, verification_status string, superseded_by string, merged_into string, ordinal int",
    "stops": "route_id string, direction string, idx int, ord int, name string, street string, lat double, lng double, status string",
    "places": "place_id string, display_name string, address string, lat double, lng double, type string, keywords array<string>, ordinal int",
    "streets": "route_id string, direction string, pos int, street string",
}


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All documents of a catalog (``name``.json, a record on each line); a malformed record fails the query that reads it."""
    return {n: spark.read.schema(SCHEMAS[n]).option("mode", "FAILFAST").json(f"{path}/{n}.json") for n in names or SCHEMAS}


def health(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each document; raises if one can't be read."""
    return {n: t.count() for n, t in tables.items()}


def nodes_in(nodes: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Named map nodes (osm_id, lat, lng, name) inside an area; filters reach the scan."""
    return nodes.where(F.col("name").isNotNull() & F.col("lat").between(area[0], area[1]) & F.col("lng").between(area[2], area[3]))


def patched(rows: DataFrame, patches: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows with the values of their patch, even null ones, where ``key`` has a patch. Patches have unique keys."""
    p = patches.select(F.col(key).alias("patch_key"), *[F.col(v).alias(f"patch_{v}") for v in values])
    joined = rows.join(p, F.col(key) == F.col("patch_key"), "left")
    return joined.select(*[F.when(F.col("patch_key").isNotNull(), F.col(f"patch_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


#: The folder of a published table that holds a file for each version: its number as name, the folder of its data as content.
VERSIONS = "_versions"


class Conflict(Exception):
    """Another writer has published, or is publishing, the version that was to be written."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = lambda *parts: hadoop.Path("/".join([path, *parts]))
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """The data folder of each version by number; empty for one whose writer hasn't finished."""
    fs, place = _files(spark, path)
    if not fs.exists(place(VERSIONS)):
        return {}
    found = {}
    for entry in fs.listStatus(place(VERSIONS)):
        name = entry.getPath().getName()
        if name.isdigit():
            stream = fs.open(entry.getPath())
            found[int(name)] = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
    return found


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions that are still there, oldest first."""
    return sorted(n for n, data in _manifests(spark, path).items() if data)


def publish(rows: DataFrame, path: str, how: str = "parquet", partitions: list[str] | None = None, after: int | None = None) -> int:
    """Write a table as the next version under ``path`` and return its number. Readers of ``published`` see whole versions only.

    The number is claimed by creating its file where none may exist, so of two writers that both build on version ``after`` (by default the last one when the call begins) one is refused with
    Conflict, and its data are removed. This needs a file system whose creation without overwriting is atomic; no rename is used. A writer that ends between claim and content
    leaves an empty claim, which refuses others until ``withdraw`` removes it.
    """
    spark = rows.sparkSession
    known = _manifests(spark, path)
    last = max(known, default=0)
    if (after is not None and after != last) or (known and not known[last]):
        raise Conflict(f"version {last} of {path} is {'there' if known[last] else 'being published'}")
    data = f"data-{uuid.uuid4().hex}"
    writer = rows.write.format(how)
    (writer.partitionBy(*partitions) if partitions else writer).save(f"{path}/{data}")
    fs, place = _files(spark, path)
    try:
        out = fs.create(place(VERSIONS, f"{last + 1:010d}"), False)
    except Py4JJavaError as e:
        fs.delete(place(data), True)
        if "FileAlreadyExists" in e.java_exception.toString():
            raise Conflict(f"version {last + 1} of {path} was published meanwhile") from None
        raise
    out.write(bytearray(data, "utf-8"))
    out.close()
    return last + 1


def published(spark: SparkSession, path: str, how: str = "parquet", version: int | None = None) -> DataFrame:
    """The newest version of a published table, or the one named."""
    known = {n: data for n, data in _manifests(spark, path).items() if data}
    if (version or max(known, default=0)) not in known:
        raise ValueError(f"no version {version or ''} of {path}")
    return spark.read.format(how).load(f"{path}/{known[version or max(known)]}")


def withdraw(spark: SparkSession, path: str) -> bool:
    """Remove the last claim if its writer left it empty. Only for writers that are known to have ended."""
    known = _manifests(spark, path)
    fs, place = _files(spark, path)
    return bool(known) and not known[max(known)] and fs.delete(place(VERSIONS, f"{max(known):010d}"), False)


def prune(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> list[int]:
    """Remove all versions but the newest ``keep``, and data folders that no version names and that are older than ``hours`` (of writers that ended early); returns the numbers removed."""
    if keep < 1:
        raise ValueError("at least one version stays")
    known = _manifests(spark, path)
    fs, place = _files(spark, path)
    old = sorted(n for n, data in known.items() if data)[:-keep]
    for n in old:
        # first the number, then the data: a reader that finds the number finds the data
        fs.delete(place(VERSIONS, f"{n:010d}"), False)
        fs.delete(place(known[n]), True)
    limit = (time.time() - 3600 * hours) * 1000
    for entry in fs.listStatus(place()) if fs.exists(place()) else []:
        name = entry.getPath().getName()
        if name.startswith("data-") and name not in known.values() and entry.getModificationTime() < limit:
            fs.delete(entry.getPath(), True)
    return old


def constants(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A small relation of fixed rows with the schema of a catalog's document, such as places of interest or popular destinations."""
    return spark.createDataFrame(rows, SCHEMAS[name])
