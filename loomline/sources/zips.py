"""Archives as a data source: read, they are their listings; written, rows become their members.

Reading seeks to an archive's central directory and takes nothing else but the few bytes of its type, so memory and time depend on the number of members, not on the
size. Writing streams members in the order of the rows into one archive after another; no archive and no group of rows is held in memory. Both go through the file
systems that Arrow knows by a path's scheme. For stores that only Spark can read, epub.archives() reads whole files.
"""

from __future__ import annotations

import io
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.dealing import bounded, dealt, release

LISTING = "path string, bytes long, is_zip boolean, bad_zip boolean, inspect_error string, mimetype string, position int, name string, size long, encrypted boolean"
MEMBERS = "archive string, position int, name string, content binary, stored boolean"
# Characters of the type that are kept, and what stands for one that can't be read.
TYPE_BYTES, UNREADABLE = 64, "(unreadable)"
#: Files that one task lists, and rows of a batch.
FILES_PER_TASK, BATCH_ROWS = 256, 4096


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there; one without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), os.path.abspath(path)


class _Seekable(io.RawIOBase):
    """An Arrow file that refuses to seek before its beginning as Python's files do."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.file.tell(), self.size)[whence]
        if to < 0:
            raise OSError("before the beginning of a file")
        self.file.seek(to)
        return to

    def readinto(self, into: memoryview) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_seekable(fs: pafs.FileSystem, path: str) -> BinaryIO:
    return io.BufferedReader(_Seekable(fs.open_input_file(path)), 1 << 16)


@dataclass
class _Files(InputPartition):
    """Files of one task below a folder, with their sizes."""

    base: str
    folder: str
    names: list[tuple[str, int | None]]

    @property
    def files(self) -> Iterator[tuple[str, int | None]]:
        return ((self.folder + name, size) for name, size in self.names)


class ListingReader(DataSourceReader):
    def __init__(self, path: str, per_task: int, most: float = math.inf) -> None:
        self.path, self.per_task, self.most = path, per_task, most

    def partitions(self) -> list[InputPartition]:
        fs, at = file_system(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File)
        folder = os.path.commonprefix([files[0][0], files[-1][0]]) if files else ""
        parts, held = [_Files(self.path, folder, [])], 0
        for name, size in files:
            if (own := parts[-1].names) and (len(own) >= self.per_task or held + (size or 0) > self.most):
                parts.append(_Files(self.path, folder, []))
                held = 0
            parts[-1].names.append((name[len(folder) :], size))
            held += size or 0
        return parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(partition.base)
        rows = []
        for path, size in partition.files:
            for row in listing(path, size, lambda path=path: open_seekable(fs, path)):
                rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of LISTING."""
    types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
    names = [f.split()[0] for f in LISTING.split(", ")]
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def listing(path: str, size: int | None, open_: Callable[[], BinaryIO]) -> Iterator[tuple]:
    """LISTING of one file: a row for each member in the order of its directory, or one row without a name if it has none or can't be listed."""
    try:
        if size is not None and size < zipfile.sizeEndCentDir:
            raise zipfile.BadZipFile
        with open_() as f, zipfile.ZipFile(f) as z:
            members = z.infolist()
            kind = None
            if any(m.filename == "mimetype" for m in members):
                try:
                    with z.open("mimetype") as m:
                        kind = m.read(TYPE_BYTES).decode("ascii", "replace")
                except Exception:  # noqa: BLE001  a broken member is no reason to lose the listing
                    kind = UNREADABLE
            for k, m in enumerate(members):
                yield path, size, True, False, None, kind, k, m.filename, m.file_size, m.filename.endswith("encryption.xml")
            if not members:
                yield path, size, True, False, None, None, None, None, None, False
    except zipfile.BadZipFile:
        yield path, size, False, True, None, None, None, None, None, False
    except Exception as e:  # noqa: BLE001  one bad file is a status
        yield path, size, False, False, type(e).__name__, None, None, None, None, False


@dataclass
class _Written(WriterCommitMessage):
    """Archives that a task has finished: the k-th has the name k in its folder."""

    folder: str
    names: list[str]


class _ArchiveWriter(DataSourceArrowWriter):
    """Each task writes under _temporary; commit() moves what the tasks that counted have written to its place, abort() leaves nothing."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = file_system(self.path)
        folder = f"{base}/{self.temporary}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        done: list[str] = []
        now = held = archive = None

        def finish() -> None:
            archive.close()
            held.seek(0)
            at = f"{folder}/{len(done)}"
            with fs.open_output_stream(at) as out:
                shutil.copyfileobj(held, out, 1 << 20)
            held.close()
            done.append(now)

        for rows in iterator:
            for k in range(rows.num_rows):
                name = rows["archive"][k].as_py()
                if name != now:
                    if now is not None:
                        finish()
                    # the archive grows on the task's own disk, where it can be closed properly, and goes to the shared folder when it is whole
                    now, held = name, tempfile.TemporaryFile()
                    archive = zipfile.ZipFile(held, "w")
                member = zipfile.ZipInfo(rows["name"][k].as_py(), (1980, 1, 1, 0, 0, 0))  # a fixed time, so that equal rows are equal bytes
                stored = rows["stored"][k].as_py()
                archive.writestr(member, rows["content"][k].as_py() or b"", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        if now is not None:
            finish()
        release()
        return _Written(folder, done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        names = [name for m in messages if m for name in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks have written one archive: rows of an archive must be in one partition, in order, as write() puts them")
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                if old.type == pafs.FileType.File and self.temporary not in old.path:
                    fs.delete_file(old.path)
        for folder in {f"{base}/{name}".rpartition("/")[0] for name in names}:
            fs.create_dir(folder, recursive=True)
        for m in filter(None, messages):
            for k, name in enumerate(m.names):
                fs.move(f"{m.folder}/{k}", f"{base}/{name}")
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/{self.temporary}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.temporary}")


class Archives(DataSource):
    """Options: path, a file or a folder; filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: object) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("filespertask", FILES_PER_TASK)))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """LISTING of the archives at or below path."""
    spark.dataSource.register(Archives)
    return spark.read.format("archives").option("filesPerTask", files_per_task).load(path)


def write(members: DataFrame, path: str, mode: str = "append") -> None:
    """members: MEMBERS. Writes each archive, a name below path, with its members by position. An archive is one task's work, member by member."""
    members.sparkSession.dataSource.register(Archives)
    bounded(members.sparkSession)
    own = members.select(*[F.col(f.split()[0]) for f in MEMBERS.split(", ")])
    dealt(own, "archive").sortWithinPartitions("archive", "position").write.format("archives").mode(mode).option("path", path).save()
