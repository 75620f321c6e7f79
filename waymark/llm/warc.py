"""WARC archives of pages, and a Merkle audit that finds damaged records in a replica.

``write_warc`` stores pages as resource records (there are no HTTP headers to keep) with a digest in WARC files of about BYTES_PER_FILE bytes, RECORDS_PER_FILE records at most, each as a gzip member of its own whose extra field
holds its number and offset (offsets count uncompressed bytes); ``read_warc`` reads such files as records with file, offset, length and digest, and with
stored range and digest. Bytes that can't be decoded become unnamed records of length 0 in the places of the records they hide; reading goes on at the next member
that is whole. For the audit, each record's leaf is a hash of its offset range, its bytes and its stored bytes. Records are placed
in segments by position; each node above hashes the leaves or nodes of FANOUT places below in order and spans their offset range. Trees are
tables, one for each level, so no task holds more than the children of one node. Two replicas are compared from the root; only the
children of nodes that differ are looked at, down to the records.

Defined cases: null urls and payloads count as empty; a null page id is archived as an empty one and read back as null; repeated rows are records of their
own; a record that is absent from one replica, or has other bytes or another place, is damaged; empty tables have one root, the hash
of nothing; other columns do not matter. Payloads may hold any text; the length in the header, not a separator, ends a record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, shared_dir

#: Records of a file, and children of a tree's node.
RECORDS_PER_FILE, FANOUT = 1000, 16
#: Bytes that the records of a file have on average at most, before compression.
BYTES_PER_FILE = 32 << 20
#: Fixed values of the record format.
BREAK, RECORD_END = "\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Start of a gzip member; name, size and layout of the extra field (number, offset, checksum of both); compression level; bytes given to a decoder at once.
MAGIC, FIELD, PLACE, LEVEL, PIECE = b"\x1f\x8b\x08", struct.pack("<H2sH", 24, b"WM", 20), struct.Struct("<QQI"), 1, 1 << 16


def header(page_id: Column, url: Column, digest: Column, length: Column) -> Column:
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), url), f"WARC-Date: {DATE}", F.concat(F.lit("WARC-Block-Digest: sha256:"), digest), "Content-Type: text/html", F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws(BREAK, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(RECORD_END))


def with_records(pages: DataFrame) -> DataFrame:
    """Add ``record``: the text of each page's WARC record. Line breaks in urls, which would end a header line, become spaces."""
    body = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", " ")
    return pages.withColumn("record", F.concat(header(F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(body.cast("binary"), 256), F.octet_length(body)), body))


def member(raw: bytes, position: int, offset: int) -> bytes:
    """A gzip member of a record, without its last byte if that is 0, as it is under 16 MB."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    place = struct.pack("<QQ", position, offset)
    head = MAGIC + b"\x04" + b"\0" * 5 + b"\xff" + FIELD + place + struct.pack("<I", zlib.crc32(place))
    out = head + deflate.compress(raw) + deflate.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return out[:-1] if out[-1] == 0 else out


def records_per_file(pages: DataFrame) -> int:
    """RECORDS_PER_FILE, or fewer where records are long: a file holds about BYTES_PER_FILE bytes at most, as it is read whole."""
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    return max(1, min(RECORDS_PER_FILE, int(BYTES_PER_FILE / (mean + 1))))


def write_warc(pages: DataFrame, path: str, per_file: int | None = None) -> None:
    """Write the pages as compressed WARC files under ``path``, in the order and the tasks that the table has; nothing is shuffled."""
    per_file = per_file or records_per_file(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = offset = 0
        for batch in batches:
            out = []
            for record in column(batch, "record"):
                raw = record.as_py() + RECORD_END.encode()
                if position == per_file:
                    position = offset = 0
                out.append(member(raw, position, offset))
                position, offset = position + 1, offset + len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = with_records(pages).select(F.col("record").cast("binary").alias("record")).mapInArrow(run, "member binary")
    # the separator is the last byte of a member, or padding that readers skip
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def decoded(raw: bytes, at: int) -> tuple[int, bytes] | None:
    """(end, content) of the gzip member at a place of a file, or None if there is no whole one."""
    if not raw.startswith(MAGIC, at):
        return None
    inflate, out = zlib.decompressobj(31), []
    try:
        while not inflate.eof:
            if at >= len(raw):
                return None
            out.append(inflate.decompress(raw[at : at + PIECE]))
            at += PIECE
    except zlib.error:
        return None
    return min(at, len(raw)) - len(inflate.unused_data), b"".join(out)


def stretches(raw: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(begin, end, content) of the members of a stored file in order; content is None for bytes that are no whole member."""
    at, bad = 0, -1
    while at < len(raw):
        found = decoded(raw, at)
        if not found:
            later = raw.find(MAGIC, at + 1)
            # zeros between members are padding, other bytes are damage
            if bad < 0 and raw[at : later if later >= 0 else len(raw)].strip(b"\0"):
                bad = at
            at = later if later >= 0 else len(raw)
            continue
        if bad >= 0:
            yield bad, at, None
            bad = -1
        yield at, found[0], found[1]
        at = found[0]
    if bad >= 0:
        yield bad, at, None


def stored_records(name: str, raw: bytes) -> list[tuple]:
    """The rows of RECORD of a stored file. What has no place among the records (stray bytes, members out of order) follows behind the last one."""
    if raw.startswith(b"WARC/"):
        return [(*r, r[2], r[3], r[5]) for r in records_of(name, raw)]
    out, extra, number, offset, hidden = [], [], 0, 0, None
    for begin, end, content in stretches(raw):
        stored = (begin, end - begin, hashlib.sha256(raw[begin:end]).hexdigest())
        if content is None:
            hidden = stored
            continue
        place = None
        if raw.startswith(FIELD, begin + 10):
            at = begin + 10 + len(FIELD)
            position, first, check = PLACE.unpack_from(raw, at)
            place = (position, first) if zlib.crc32(raw[at : at + 16]) == check else None
        ahead = place[0] - number if place else 0
        if hidden:
            (out if ahead > 0 else extra).extend((name, number + k, offset, 0, None, hidden[2], *hidden) for k in range(max(ahead, 1)))
            hidden = None
        late = ahead < 0
        if place and not late:
            number, offset = place
        for _, k, at, length, page, digest in records_of(name, content):
            (extra if late else out).append((name, number + k, (place[1] if late else offset) + at, length, page, digest, *stored))
        if not late:
            number, offset = (out[-1][1] + 1, offset + len(content)) if out else (0, 0)
    if hidden:
        out.append((name, number, offset, 0, None, hidden[2], *hidden))
        number += 1
    return out + [(name, number + k, *row[2:]) for k, row in enumerate(extra)]


def records_of(name: str, raw: bytes) -> list[tuple]:
    """(file, position, offset, length, page id, sha256) of each record of a file; bytes that are no record end the list as a last, unnamed one."""
    out, at = [], 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in raw[at : max(head, at)].split(b"\r\n")[1:] if b": " in x)
        size = fields.get(b"Content-Length", b"")
        if head < 0 or not raw.startswith(b"WARC/", at) or not size.isdigit():
            end, page = len(raw), None
        else:
            end = min(len(raw), head + 8 + int(size))
            found = fields.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:page:").removesuffix(b">")
            page = int(found) if found.lstrip(b"-").isdigit() else None
        out.append((name, len(out), at, end - at, page, hashlib.sha256(raw[at:end]).hexdigest()))
        at = end
    return out


RECORD = "file string, position long, offset long, length long, page_id long, sha256 string, stored_offset long, stored_length long, stored_sha256 string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``; files are of bounded size and read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for name, content in zip(column(batch, "path").to_pylist(), column(batch, "content"), strict=True):
                raw = content.as_py()
                rows = stored_records(name.rsplit("/", 1)[1], raw)
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of a Merkle tree as stored tables (place, first, end, digest), leaves first and the root last.

    ``leaves`` has place (long, unique and dense or nearly so), offset, length, sha256 and perhaps stored_sha256.
    """
    last = F.col("offset") + F.col("length")
    level = leaves.select("place", F.col("offset").alias("first"), last.alias("end"), F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), *[c for c in ("sha256", "stored_sha256") if c in leaves.columns]).cast("binary"), 256).alias("digest"))
    levels = [materialize(level, "leaves")]
    top = levels[0].agg(F.max("place")).first()[0] or 0
    while top > 0 or len(levels) == 1:
        below = F.array_sort(F.collect_list(F.struct("place", "digest")))
        up = levels[-1].groupBy(F.expr(f"place div {fanout}").alias("place")).agg(F.min_by("first", "place").alias("first"), F.max_by("end", "place").alias("end"), below.alias("below"))
        joined = F.array_join(F.transform("below", lambda x: F.concat_ws("=", x["place"].cast("string"), x["digest"])), ",")
        levels.append(materialize(up.select("place", "first", "end", F.sha2(joined.cast("binary"), 256).alias("digest")), "nodes"))
        top //= fanout
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """place and which replica holds it (``only``: a, b or null for both) of every leaf that differs, found from the roots down."""
    depth = max(len(a), len(b))
    spark = a[0].sparkSession
    below: DataFrame | None = None
    for k in range(depth - 1, -1, -1):
        sides = [levels[k] if k < len(levels) else None for levels in (a, b)]
        if any(s is None for s in sides):
            continue  # a taller tree has more records: the common levels below its root differ anyhow
        left, right = (s.select(F.col("place"), F.col("digest").alias(n)) for s, n in zip(sides, ("da", "db"), strict=True))
        if below is not None:
            left, right = (s.join(below, F.expr(f"place div {fanout}") == F.col("parent"), "left_semi") for s in (left, right))
        both = left.join(right, "place", "full_outer").where(~F.col("da").eqNullSafe(F.col("db")))
        found = materialize(both.select("place", F.when(F.col("db").isNull(), F.lit("a")).when(F.col("da").isNull(), F.lit("b")).alias("only")), "differing")
        if not k or not found.limit(1).count():
            return found if not k else spark.createDataFrame([], "place long, only string")
        below = found.select(F.col("place").alias("parent"))
    raise ValueError("a tree has no levels")


def placed(*replicas: DataFrame) -> list[DataFrame]:
    """Add ``place``: a task's files follow each other in steps of the least power of FANOUT that holds every file, so a file is one branch of the tree.

    Steps and files of a task are those of all replicas together, so what one of them lost moves nothing.
    """
    task, number = (F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\.[^-]*$"))
    most = [r.agg(F.max("position").alias("position"), F.max(number).alias("number")).first() for r in replicas]
    last, files = (max(m[c] or 0 for m in most) for c in ("position", "number"))
    step = FANOUT
    while step <= last:
        step *= FANOUT
    return [r.withColumn("place", (task * (files + 1) + number) * F.lit(step) + F.col("position")) for r in replicas]


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of ``original`` and those that only ``replica`` has, with ``damaged``: whether the trees differ at their place.

    Both have file, position, offset, length, page_id and sha256; a replica keeps the files of the original.
    """
    a, b = placed(materialize(original, "original"), materialize(replica, "replica"))
    found = differing(tree(a), tree(b)).select(F.col("place").alias("p"), "only")
    names = ["place", "file", "position", "offset", "length", "page_id", "sha256"]
    known = a.select(names).join(found, F.col("place") == F.col("p"), "left")
    added = b.select(names).join(found.where("only = 'b'"), F.col("place") == F.col("p"))
    return known.unionByName(added).select(*names[1:], F.col("p").isNotNull().alias("damaged"))


def op6_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, archive them again with one byte of every 97th page's payload changed, and audit the second archive against the first.

    Both archives come from the same scan, so they have the same files.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    bad = (F.col("page_id") % 97 == 0) & (F.octet_length("html") > 0)
    harmed = pages.withColumn("html", F.when(bad & F.col("html").startswith("<"), F.concat(F.lit("("), F.substring("html", 2, 2147483647))).otherwise(F.col("html")))
    at = f"{shared_dir(spark)}/waymark-warc-{uuid.uuid4().hex}"
    per_file = records_per_file(pages)
    write_warc(pages, f"{at}/original", per_file)
    write_warc(harmed, f"{at}/replica", per_file)
    out = audit(read_warc(spark, f"{at}/original"), read_warc(spark, f"{at}/replica"))
    return out.select("page_id", "length", "sha256", "damaged")


#: What the query returns, from the format's description: page, record length, digest and whether the page's payload was changed.
AUDIT_SQL = f"""
WITH parts AS (SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
texts AS (SELECT page_id, body,
  'WARC/1.0' || e'\\r\\n' || 'WARC-Type: resource' || e'\\r\\n' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e'\\r\\n' || 'WARC-Target-URI: ' || url || e'\\r\\n' ||
  'WARC-Date: {DATE}' || e'\\r\\n' || 'WARC-Block-Digest: sha256:' || sha256(body) || e'\\r\\n' || 'Content-Type: text/html' || e'\\r\\n' || 'Content-Length: ' || strlen(body) || e'\\r\\n\\r\\n' || body || e'\\r\\n\\r\\n' AS record FROM parts)
SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256, page_id % 97 = 0 AND starts_with(body, '<') AS damaged FROM texts"""
