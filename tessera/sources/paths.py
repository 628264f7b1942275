"""Files of any file system that pyarrow knows (a local or mounted path, file:, hdfs:, s3:, ...)."""

from __future__ import annotations

import fnmatch
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it)"""
    if re.match(r"(?!file:)\w+:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, of the files of the folder, or of those that the last part, a pattern, names; hidden files
    (that begin with a dot or _) aren't seen."""
    fs, base = located(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    kind = fs.get_file_info(base).type
    if kind == pafs.FileType.File:
        found = [fs.get_file_info(base)]
    else:
        folder, pattern = (base, "*") if kind == pafs.FileType.Directory else base.rsplit("/", 1)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = [x for x in found if x.type == pafs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern) and x.base_name[0] not in "._"]
    if not found:
        raise ValueError(f"no file at {path}")
    return sorted((prefix + x.path, x.size) for x in found)


class Parts:
    """Files of a task, written under hidden names; they get their own when the job commits."""

    def __init__(self, folder: str):
        self.fs, self.folder, self.names = *located(folder), {}
        self.fs.create_dir(self.folder, recursive=True)

    def open(self, name: str):
        if name in self.names:
            raise ValueError(f"rows of {name} aren't side by side")
        self.names[name] = f"{self.folder}/.{uuid.uuid4().hex}"
        return self.fs.open_output_stream(self.names[name])


def commit(folder: str, parts: list[dict[str, str]], overwrite: bool = False, pattern: str = "*") -> None:
    """parts: of each task, hidden files by name. A name that two tasks wrote is an error."""
    names = [n for p in parts for n in p]
    if len(names) != len(set(names)):
        raise ValueError("rows of one file came in several partitions")
    fs, base = located(folder)
    if overwrite:
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.type == pafs.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern) and not x.base_name.startswith("."):
                fs.delete_file(x.path)
    for p in parts:
        for name, hidden in p.items():
            fs.move(hidden, f"{base}/{name}")


def abort(folder: str, parts: list[dict[str, str]]) -> None:
    fs, _ = located(folder)
    for p in parts:
        for hidden in p.values():
            if fs.get_file_info(hidden).type == pafs.FileType.File:
                fs.delete_file(hidden)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the application ends. Where all run on one machine and no
    folder is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    path = f"{base.rstrip('/')}/files_{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
