"""Data source for prompts laid out as text files ``<problem type>/<name>/<execution model>``.

The columns ``problem_type``, ``name`` and ``parallelism_model`` come from the path. A selection of their values is part of
the read: only folders and files that match are listed, and only they are planned. Files are dealt to tasks by
their sizes. Paths may be local or name a store (``file:``, ``hdfs:``, ``s3:`` ...) that all tasks reach. Like Spark's own
file sources, it lists on the driver and reads and writes in the tasks.

    read_prompt_tree(spark, root, parallelism_model=["omp", "mpi"])

The selection is an option and not taken from ``where``: Spark 4.1 keeps one reader for all uses of a loaded frame, so
filters that are pushed into a Python source in one branch of a query would also hold in the others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "problem_type string, language string, name string, parallelism_model string, prompt string"
LEVELS = ("problem_type", "name", "parallelism_model")
#: bytes of files per task, what opening a file counts as, and bytes per Arrow batch
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 64 << 20, 256 << 10, 4 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    if re.match(r"file:", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def to_part(value: str) -> str:
    """A path part that any text fits into; names of hidden files do not come out of it."""
    part = quote(value, safe="+ ,;=@()[]{}!$&'-_.~")
    return "%" + format(ord(part[0]), "02X") + part[1:] if part[:1] in ("_", ".") else part


class Files(InputPartition):
    """Files of one task: their parts (type, name, model) and paths."""

    def __init__(self, files: list[tuple[list[str], str]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.wanted: dict[str, list[str]] = json.loads(options.get("select", "{}"))

    def _entries(self, store: fs.FileSystem, folder: str, level: int) -> list[fs.FileInfo]:
        """Visible entries of a folder that are selected, by name."""
        wanted = self.wanted.get(LEVELS[level])
        if wanted is None:
            found = [e for e in store.get_file_info(fs.FileSelector(folder)) if not e.base_name.startswith(("_", "."))]
        else:
            found = store.get_file_info([f"{folder}/{to_part(w)}" for w in sorted(set(wanted))])
            found = [e for e in found if e.type != fs.FileType.NotFound]
        kind = fs.FileType.File if level == 2 else fs.FileType.Directory
        for e in found:
            if e.type != kind:
                raise ValueError(f"expected {e.path} to be a {'file' if level == 2 else 'directory'}")
        return sorted(found, key=lambda e: e.base_name)

    def partitions(self):
        store, root = place(self.root)
        planned: list[list] = []
        size = self.task_bytes
        for kind in self._entries(store, root, 0):
            for name in self._entries(store, kind.path, 1):
                for file in self._entries(store, name.path, 2):
                    weight = file.size + OPEN_BYTES
                    if size + weight > self.task_bytes:
                        planned.append([])
                        size = 0
                    size += weight
                    planned[-1].append(([unquote(e.base_name) for e in (kind, name, file)], file.path))
        return [Files(files) for files in planned]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = place(self.root)

        def batch(rows):
            kinds, names, models, prompts = zip(*rows)
            columns = [kinds, ["cpp"] * len(rows), names, models, prompts]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

        rows, size = [], 0
        for parts, path in partition.files if partition else []:
            with store.open_input_stream(path) as stream:
                content = stream.read()
            rows.append((*parts, content.decode()))
            size += len(content)
            if size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class TreeWriter(DataSourceArrowWriter):
    """Every file is written under a hidden name and renamed when it is whole, so a task may run more than once."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = place(self.root)
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*LEVELS, "prompt")]
            for row in zip(*columns):
                *parts, prompt = (value.as_py() for value in row)
                if not all(parts):
                    raise ValueError("a prompt needs a problem type, a name and an execution model")
                folder = "/".join([root, *map(to_part, parts[:2])])
                store.create_dir(folder, recursive=True)
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as stream:
                    stream.write((prompt or "").encode())
                store.move(hidden, f"{folder}/{to_part(parts[2])}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        """Nothing is left to do: the files stand."""

    def abort(self, messages) -> None:
        """Files that stand are whole; a second run writes them again."""


class PromptTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prompt_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a prompt tree is only added to; choose a new folder")
        return TreeWriter(self.options)


def read_prompt_tree(spark: SparkSession, root: str, task_bytes: int = TASK_BYTES, **select: list[str]) -> DataFrame:
    """Prompts below ``root``, a row per file; ``select`` names the wanted values of ``problem_type``, ``name`` and
    ``parallelism_model``. Hidden files are left out; a file where a folder belongs is an error."""
    unknown = set(select) - set(LEVELS)
    if unknown:
        raise ValueError(f"{sorted(unknown)} do not come from the path")
    spark.dataSource.register(PromptTree)
    return spark.read.format("prompt_tree").options(taskBytes=task_bytes, select=json.dumps(select)).load(root)


def write_prompt_tree(prompts: DataFrame, root: str) -> None:
    """Write prompts below ``root``, a file per row; a null prompt is an empty file.

    Two rows with one path are refused before anything is written, as only one of them could stay.
    """
    prompts.sparkSession.dataSource.register(PromptTree)
    rows = prompts.select(*LEVELS, "prompt")
    twice = rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['n']} prompts for {'/'.join(str(twice[c]) for c in LEVELS)}")
    rows = rows.select(LEVELS[0], F.lit("cpp").alias("language"), *LEVELS[1:], "prompt")
    rows.write.format("prompt_tree").mode("append").save(root)
