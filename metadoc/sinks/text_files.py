"""Many small text files as a data source of Spark: ``df.write.format("named_text")``.

Spark's own writer gives each file of a ``partitionBy`` a folder to itself, and on local disks sets the mode of
each folder, file and checksum by a command of its own; for files by the hundred thousand that takes far longer
than their contents, and so does listing the folders. Here a task writes all of its files into one folder.
"""

import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _filesystem(path):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: str


class Writer(DataSourceArrowWriter):
    """Each task writes to a hidden folder, which the commit renames: one rename per task.

    What a lost or repeated task leaves behind keeps its hidden name and is never read.
    """

    def __init__(self, path):
        self.path = path

    def write(self, iterator):
        system, folder = _filesystem(self.path)
        part, out, last = f"part-{uuid.uuid4().hex}", None, None
        try:
            for batch in iterator:
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if out is None or name != last:
                        if out is not None and name < last:
                            raise ValueError("rows are not in the order of their names")
                        if not name or "/" in name or name[0] in "._":
                            raise ValueError(f"no name of a file: {name!r}")
                        if out is None:
                            system.create_dir(f"{folder}/.{part}", recursive=True)
                        else:
                            out.close()
                        out, last = system.open_output_stream(f"{folder}/.{part}/{name}", compression=None), name
                    if line.is_valid:
                        out.write(line.as_buffer())
                    out.write(b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(part if out is not None else "")

    def commit(self, messages):
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        for message in messages:
            if message and message.part:
                system.move(f"{folder}/.{message.part}", f"{folder}/{message.part}")

    def abort(self, messages):
        """Hidden folders are never read."""


class NamedTextSource(DataSource):
    @classmethod
    def name(cls):
        return "named_text"

    def schema(self):
        return "name string, line string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("files are written to a new folder")
        return Writer(self.options["path"])


def write_texts(rows, folder, name, line, order):
    """One text file per ``name`` below ``folder``: its lines by ``order``, each ended, null ones empty.

    Files lie in folders of the tasks that wrote them. ``folder`` is new: names are not looked for in it.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedTextSource)
    named = rows.select(name.alias("name"), line.cast("string").alias("line"), *[F.col(o).alias(f"_{o}") for o in order])
    named.repartition("name").sortWithinPartitions("name", *[f"_{o}" for o in order]).select("name", "line").write.format(
        "named_text").mode("append").save(folder)
