"""A sink that writes one file a song, all or none.

Tasks write into folders of their own beside the files, under names that readers skip; the commit moves the files to
their places, so a write that fails changes no song's file, whatever its tasks had written. A task that fails clears
its folder and so does the abort; a folder _attempt-... of a task that was killed after the abort may stay."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.run = path, suffix, uuid.uuid4().hex

    def _folders(self) -> list[Path]:
        return list(Path(self.path).glob(f"_attempt-{self.run}-*"))

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = Path(self.path, f"_attempt-{self.run}-{uuid.uuid4().hex}")
        folder.mkdir(parents=True)
        names = []
        try:
            for row in iterator:
                names.append(quote(str(row[0]), safe=" ") + self.suffix)
                (folder / names[-1]).write_bytes((row[1] or "").encode())
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Written(str(folder), names)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.names if m else []:
                os.replace(Path(m.folder, name), Path(self.path, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Folders of failed attempts too."""
        for folder in self._folders():
            shutil.rmtree(folder, ignore_errors=True)


class SongFiles(DataSource):
    """Format song_files; options path, a folder that the driver and all executors share, and suffix."""

    @classmethod
    def name(cls) -> str:
        return "song_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ""))


def write_song_files(files: DataFrame, path: str, suffix: str = ".ass") -> None:
    """Writes files (song_id, content), one row a song, as <song_id><suffix> in UTF-8; a file of that name is
    replaced, others stay. Characters that paths cannot hold are percent-encoded; null contents are empty files and
    rows without a song_id are refused. A write that fails changes no file."""
    files.sparkSession.dataSource.register(SongFiles)
    rows = files.select(F.coalesce(F.col("song_id").cast("string"), F.raise_error(F.lit("a file without a song_id"))).alias("song_id"), F.col("content").cast("string").alias("content"))
    rows.write.format("song_files").option("suffix", suffix).mode("append").save(path)
