"""Small text files on any file system that Spark's Hadoop client knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class FileExists(RuntimeError):
    """There is a file of this name already."""


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _system(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """The files of a folder, in order; none if there is no such folder."""
    where, system = _system(spark, folder)
    if not system.exists(where):
        return []
    return sorted(name for s in system.listStatus(where) if s.isFile() and (name := s.getPath().getName()).endswith(suffix) and not name.startswith("."))


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _system(spark, path)
    return system.exists(where)


def replace(spark: SparkSession, folder: str, names_: list[str], by: str, text: str) -> None:
    """Put one file in place of several, whose content it has. While that lasts they are in
    a hidden folder; if it ends half-way, those that are left there are hidden rather than
    read twice."""
    aside = f"{folder}/_{by}"
    make_folder(spark, aside)
    for name in names_:
        rename(spark, f"{folder}/{name}", f"{aside}/{name}")
    write_text(spark, f"{folder}/{by}", text)
    where, system = _system(spark, aside)
    system.delete(where, True)


def any_file(spark: SparkSession, folder: str, suffix: str = "") -> bool:
    """Whether a folder, or one in it, has such a file, hidden ones aside."""
    where, system = _system(spark, folder)
    if not system.exists(where):
        return False
    todo = [where]
    while todo:
        for status in system.listStatus(todo.pop()):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                if status.isFile() and name.endswith(suffix):
                    return True
                if status.isDirectory():
                    todo.append(status.getPath())
    return False


def make_folder(spark: SparkSession, path: str) -> None:
    where, system = _system(spark, path)
    system.mkdirs(where)


def rename(spark: SparkSession, path: str, to: str) -> None:
    where, system = _system(spark, path)
    if not system.rename(where, _system(spark, to)[0]):
        raise OSError(f"{path} can't be renamed to {to}")


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write a file that appears whole or not at all: another name is written first and
    renamed. Unless ``replace``, a file that is there stays and FileExists is raised, so
    of several writers one succeeds. Stores without a rename of that kind, as most
    object stores, give neither promise."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    where, system = _system(spark, path)
    part = fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = system.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = gateway.new_array(fs.Options.Rename, int(replace))
    if replace:
        options[0] = fs.Options.Rename.OVERWRITE
    files = fs.FileContext.getFileContext(system.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(system.makeQualified(part), system.makeQualified(where), options)
    except Exception as error:
        system.delete(part, False)
        if "FileAlreadyExistsException" in str(error):
            raise FileExists(path) from error
        raise
