"""Small files and folders on whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p) and system.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    p, system = _at(spark, path)
    system.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is none."""
    p, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, system = _at(spark, path)
    stream = system.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """The whole file or none of it: it gets its name when it is written."""
    draft, system = _at(spark, f"{path}.draft")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    target, _ = _at(spark, path)
    if not system.rename(draft, target):
        system.delete(target, False)
        system.rename(draft, target)


def joined(spark: SparkSession, pieces: list[str | tuple[str]], path: str) -> None:
    """One file of pieces: texts, and the part files of (folder,) in order of their names; these are copied by blocks, and deleted one by one as they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, system = _at(spark, path)
    out = system.create(target, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode("utf-8")))
                continue
            for name in names(spark, piece[0]):
                if name.startswith("part-"):
                    source, _ = _at(spark, f"{piece[0]}/{name}")
                    stream = system.open(source)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                    finally:
                        stream.close()
                    system.delete(source, False)
    finally:
        out.close()
