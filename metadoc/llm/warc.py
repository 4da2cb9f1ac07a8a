"""WARC archives as a data source of Spark: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files. Of each record the header lines are parsed first; equality
predicates on the record type and other header columns are taken over from Spark, and the block of a
record that they rule out is skipped (by a seek in plain files, without keeping it in compressed ones).
With the option ``payload=false`` no block is read at all. ``write_pages`` and ``read_pages`` keep pages in
such archives, equal payloads once.
"""

import gzip
import posixpath
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage)

from metadoc.llm.shared import small
from metadoc.runtime import shared_dir

#: Columns that come from header lines, and the lines.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, content_type string, content_length long, payload_length long, payload binary, "
    "file string, position long")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.IGNORECASE)


def _filesystem(path):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or path
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.per_partition = int(options.get("partitionbytes", 64 << 20))
        self.wanted, self.present = {}, set()

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS and isinstance(f.value, str):
                self._want(name, {f.value})
            elif isinstance(f, In) and name in HEADERS:
                self._want(name, {v for v in f.value if v is not None})
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.present.add(name)
            else:
                yield f

    def _want(self, name, values):
        self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self):
        """Files in the order of their names, some small ones together."""
        from pyarrow import fs

        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(path, recursive=True))
        else:
            infos = [info]
        files = sorted((i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and re.search(
            r"\.warc(\.gz)?$", i.path) and not posixpath.basename(i.path).startswith((".", "_")))
        parts, size = [], 0
        for name, length in files:
            if not parts or size + length > self.per_partition:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += length
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition):
        schema = _arrow_schema()
        rows, size = [], 0
        system, _ = _filesystem(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                plain = not path.endswith(".gz")
                stream = raw if plain else gzip.GzipFile(fileobj=raw)
                for row in self._records(stream, path, plain):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 400
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, stream, path, plain):
        lines = _Lines(stream)
        while True:
            at = lines.at
            header = lines.header()
            if header is None:
                return
            length = int(header.get("content-length", 0))
            row = {column: header.get(line.lower()) for column, line in HEADERS.items()}
            if any(row[name] not in values for name, values in self.wanted.items()) or any(
                    row[name] is None for name in self.present):
                lines.skip(length, plain)
                continue
            row |= {"content_length": length, "payload_length": None, "payload": None, "file": path, "position": at}
            if not self.payload and row["warc_type"] != "revisit":
                lines.skip(length, plain)
            else:
                block = lines.take(length)
                if (row["content_type"] or "").startswith("application/http"):
                    head, _, body = block.partition(b"\r\n\r\n")
                    found = _HTTP_LENGTH.search(head)
                    row["payload_length"] = int(found[1]) if found else len(body)
                    block = body if row["warc_type"] != "revisit" else None
                else:
                    row["payload_length"] = length
                row["payload"] = block if self.payload else None
            yield row


class _Lines:
    """A buffered stream that can skip."""

    def __init__(self, stream, chunk=1 << 16):
        self.stream, self.chunk, self.buffer, self.at = stream, chunk, b"", 0

    def _more(self):
        data = self.stream.read(self.chunk)
        self.buffer += data
        return bool(data)

    def header(self):
        """The header lines of the next record by lower-case name; none at the end of the file."""
        while True:
            self.buffer, before = self.buffer.lstrip(b"\r\n"), len(self.buffer)
            self.at += before - len(self.buffer)
            if b"\r\n\r\n" in self.buffer:
                break
            if not self._more():
                if self.buffer.strip():
                    raise ValueError(f"the archive ends within a header at {self.at}")
                return None
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        self.at += len(head) + 4
        first, *rest = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at {self.at}: {first[:40]!r}")
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in rest)}

    def take(self, n):
        parts, got = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[n:]
        while got < n:
            data = self.stream.read(n - got)
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(data)
            got += len(data)
        self.at += n
        return b"".join(parts)

    def skip(self, n, seek):
        held = min(n, len(self.buffer))
        self.buffer = self.buffer[held:]
        self.at += n
        n -= held
        if n and seek:
            self.stream.seek(n, 1)
        while n and not seek:
            data = self.stream.read(min(n, 1 << 20))
            if not data:
                raise ValueError("the archive ends within a record")
            n -= len(data)


def _arrow_schema():
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ") for c in SCHEMA.split(","))])


def record(row):
    """The bytes of one record. A revisit has the HTTP header of its payload, but not the payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n"
    block = http.encode() + (b"" if row["warc_type"] == "revisit" else payload)
    lines = ["WARC/1.1"]
    for column, line in HEADERS.items():
        if row.get(column) is not None and column != "content_type":
            lines.append(f"{line}: {row[column]}")
    if row["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    """Each task writes files of bounded size under hidden names, which the commit renames.

    What a lost or repeated task leaves behind keeps its hidden name and is never read.
    """

    def __init__(self, options):
        self.path, self.gz = options["path"], options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("filebytes", 256 << 20))

    def write(self, iterator):
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        suffix, files, out, size = ".warc.gz" if self.gz else ".warc", [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out:
                        out.close()
                    name = f"pages-{uuid.uuid4().hex}{suffix}"
                    out, size = system.open_output_stream(f"{folder}/.{name}", compression=None), 0
                    files.append(name)
                data = record(row)
                data = gzip.compress(data, 1) if self.gz else data
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                system.move(f"{folder}/.{name}", f"{folder}/{name}")

    def abort(self, messages):
        system, folder = _filesystem(self.path)
        for message in messages:
            for name in message.files if message else ():
                system.delete_file(f"{folder}/.{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are written to a new folder, or appended to")
        return Writer({k.lower(): v for k, v in self.options.items()})


def register(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


_ID = "urn:metadoc:page:"


def roles(pages, id_col="page_id", url_col="url", html_col="html", least_bytes=1000):
    """The records of ``pages``: of equal payloads of ``least_bytes`` and more, one is kept."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_length"), F.sha1(payload).alias("digest"))
    # Only digests that occur more than once go to the join; their pages do not, if they are few.
    kept = rows.filter(F.col("payload_length") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1 and kept_id is not null").drop("n")
    rows = rows.join(small(kept), "digest", "left")
    return rows.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id")))


def _uri(id_col, *rest):
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(id_col.cast("string"), F.concat_ws(":", F.lit(""), *rest)), F.lit(">"))


def _header_value(url):
    """A URL with control characters or outer spaces, which a header line cannot hold, is encoded whole."""
    return F.when(url.rlike(r"[\x00-\x1f\x7f]|^ | $"), F.url_encode(url)).otherwise(url)


def write_pages(pages, path, date="2000-01-01T00:00:00Z", compression="none", **options):
    """Writes one record per row of ``pages`` to archives in the folder ``path``.

    Null payloads are empty. Rows with the largest id of their payload are responses, and so are rows
    with smaller payloads; all others, rows without an id included, revisit the former.
    """
    register(pages.sparkSession)
    rows = roles(pages, **options)
    rows.select(
        F.when(F.col("refers").isNull(), "response").otherwise("revisit").alias("warc_type"),
        _uri(F.col("page_id"), F.col("digest"), F.xxhash64("url").cast("string")).alias("record_id"),
        _header_value(F.col("url")).alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(F.col("refers").isNotNull(), _uri(F.col("refers"))).alias("refers_to"),
        "payload_length", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("compression", compression).save(path)


def read_pages(spark, path, id_type="long"):
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` per record.

    Responses are measured by what their block holds; revisits are read without their blocks, and tell
    the length and digest of the payload they refer to. An empty folder gives no rows.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, rf"^<{_ID}([^:>]+)>$", 1)
    named = lambda c: F.when(page(c) != "", page(c)).cast(id_type)
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(path)
    whole, brief = read("true").filter("warc_type = 'response'"), read("false").filter("warc_type = 'revisit'")
    first = [named(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url"), "payload"]
    last = [F.col("warc_type").alias("record_type"), named(F.col("refers_to")).alias("refers_to")]
    return whole.select(
        *first, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), *last
    ).unionByName(brief.select(
        *first, F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), *last))


def round_trip(pages, label="warc", **options):
    """``pages`` written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/metadoc/{label}-{uuid.uuid4().hex}"
    write_pages(pages, path, **options)
    id_type = dict(pages.dtypes)[options.get("id_col", "page_id")]
    return read_pages(spark, path, id_type)
