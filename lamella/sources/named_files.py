"""A batch sink that writes one named text file per row, all of them or none.

Spark's file sinks choose their own file names.  Here a task writes its files to a folder of
its own below the target; when all tasks are done the driver moves the files of the attempts
that count to their names.  A job that fails leaves no file: its folder is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..streaming.log_files import filesystem

FORMAT = "named_text"


def file_name(name: str, suffix: str) -> str:
    """name as a file name: characters with a meaning in paths, and a dot or line in front, as %XX."""
    safe = quote(name, safe=" ()+,;=@~")
    return (f"%{ord(safe[0]):02X}{safe[1:]}" if safe[:1] in (".", "_") else safe) + suffix


@dataclass
class Written(WriterCommitMessage):
    """What an attempt hands to the driver: where its files are, never their names."""

    folder: str


class NamedText(DataSource):
    """``df.write.format(FORMAT)`` of rows (name, text), once the class is registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:  # noqa: ANN001
        return NamedTextWriter(self.options["path"], self.options.get("suffix", ""))


class NamedTextWriter(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix
        self.job = f"_named-{uuid.uuid4().hex}"

    def _places(self):  # noqa: ANN202
        system, root = filesystem(self.folder)
        return system, root.rstrip("/"), f"{root.rstrip('/')}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, job = self._places()
        mine, seen = f"{job}/{uuid.uuid4().hex}", set()
        system.create_dir(mine, recursive=True)
        for name, text in iterator:
            if name is None or name == "":
                raise ValueError("a file needs a name")
            if name in seen:
                raise ValueError(f"two rows are named {name!r}")
            seen.add(name)
            with system.open_output_stream(f"{mine}/{file_name(name, self.suffix)}") as f:
                f.write((text or "").encode())
        return Written(mine)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root, job = self._places()
        for message in messages:
            if message is not None:
                for info in system.get_file_info(fs.FileSelector(message.folder)):
                    system.move(info.path, f"{root}/{info.base_name}")
        self._remove(system, job)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, job = self._places()
        self._remove(system, job)

    def _remove(self, system, job: str) -> None:  # noqa: ANN001
        from pyarrow import fs

        if system.get_file_info(job).type == fs.FileType.Directory:
            system.delete_dir(job)


def write_named(df: DataFrame, name: str, text: str, path: str, suffix: str) -> None:
    """A file ``path/<name><suffix>`` with the text of each row of df; a file of that name is replaced.

    Names are cast to text; a null text is an empty file.  A null or empty name, and two rows of one name (which meet in
    one task), fail the job, and no file of it is left.  An empty table writes nothing.  If the driver is lost while it
    moves files, those moved are whole and the rest are missing: write again.
    """
    df.sparkSession.dataSource.register(NamedText)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    rows.repartition("name").write.format(FORMAT).option("path", path).option("suffix", suffix).mode("append").save()
