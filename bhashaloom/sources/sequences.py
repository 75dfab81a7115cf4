"""Files of packed sequences: rows of a fixed number of 16-bit ids, little-endian, without a header."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Sequences that one task reads.
TASK_ROWS = 65_536


class SequenceFiles(DataSource):
    """Format "sequences". Options: path (a folder or file), length (tokens of a sequence, 1024), suffix ("_train.bin").

    The language of a file is its name before the first underscore. A partial sequence at the end of a file is ignored.
    Paths are of any file system that pyarrow knows by its address: local files, HDFS, S3, Google Cloud Storage.
    """

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "lang string, file_name string, seq bigint, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int):
        super().__init__(0)
        self.path, self.first, self.rows = path, first, rows


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def sequence_files(path: str, suffix: str = ".bin", language: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, or of one file, by name. With a language, those that hold it in their names; none is then an error."""
    system, place = located(path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place))
    kept = sorted((x.path, x.size) for x in found if x.is_file and (info.is_file or x.base_name.endswith(suffix)) and (language or "") in x.base_name)
    if language is not None and not kept:
        raise ValueError(f"no file ending in {suffix} for {language} in {path}")
    return kept


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.length = options, int(options.get("length", 1024))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path, size in sequence_files(self.options["path"], self.options.get("suffix", ".bin"), self.options.get("language")):
            rows = size // (2 * self.length)
            parts += [_Range(path, a, min(TASK_ROWS, rows - a)) for a in range(0, rows, TASK_ROWS)]
        return parts or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        name, width = posixpath.basename(part.path), 2 * self.length
        with located(self.options["path"])[0].open_input_file(part.path) as file:
            for at in range(part.first, part.first + part.rows, 4096):
                n = min(4096, part.first + part.rows - at)
                ids = np.frombuffer(file.read_at(n * width, at * width), "<u2").astype(np.int32)
                ends = np.arange(n + 1, dtype=np.int32) * self.length
                columns = [pa.array([name.split("_")[0]] * n), pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "file_name", "seq", "tokens"])


class _Written(WriterCommitMessage):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its own for each language; the files get their names when the job has ended well."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.suffix, self.overwrite = options["path"], options.get("suffix", ".bin"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        part = TaskContext.get()
        system, folder = located(self.folder)
        system.create_dir(folder, recursive=True)
        pairs: dict[str, tuple[str, str]] = {}
        files: dict[str, pa.NativeFile] = {}
        try:
            for batch in batches:
                names = pc.fill_null(batch.column("lang"), "None")
                for lang in names.unique().to_pylist():
                    if lang not in pairs:
                        end = posixpath.join(folder, f"{lang}_{part.partitionId():07d}{self.suffix}")
                        pairs[lang] = (f"{end}.{part.taskAttemptId()}.tmp", end)
                        files[lang] = system.open_output_stream(pairs[lang][0])
                    own = batch.column("tokens").filter(pc.equal(names, lang))
                    files[lang].write(own.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes())
        finally:
            for file in files.values():
                file.close()
        return _Written(list(pairs.values()))

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = located(self.folder)
        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for path, _ in sequence_files(self.folder, self.suffix):
                system.delete_file(path)
        for m in messages:
            for temporary, end in m.pairs if m else []:
                system.move(temporary, end)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = located(self.folder)
        for m in messages:
            for temporary, _ in m.pairs if m else []:
                if system.get_file_info(temporary).is_file:
                    system.delete_file(temporary)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SequenceFiles)


def read_sequences(spark: SparkSession, path: str, length: int = 1024, suffix: str = ".bin", language: str | None = None) -> DataFrame:
    """(lang, file_name, seq, tokens) of the files of a folder that all workers reach; with a language, of those that hold it in their names."""
    register(spark)
    reader = spark.read.format("sequences").option("path", path).option("length", length).option("suffix", suffix)
    if language is not None:
        sequence_files(path, suffix, language)  # fails here, and not when the table is read
        reader = reader.option("language", language)
    return reader.load()


def write_sequences(frame: DataFrame, path: str, suffix: str = ".bin", mode: str = "overwrite") -> None:
    """Writes (lang, tokens) as files of a folder that all workers reach. Ids must be under 65536."""
    register(frame.sparkSession)
    rows = frame.selectExpr("lang", "CAST(NULL AS STRING) AS file_name", "CAST(NULL AS BIGINT) AS seq", "tokens")
    rows.write.format("sequences").option("path", path).option("suffix", suffix).mode(mode).save()
