"""Folders of runs on any file system that Spark reaches: ids, digests, copies, archives; fenced JSON.

All files go through Hadoop's FileSystem of the running session, so a run's
folder can lie in a cluster's store as well as on this machine.
"""
from __future__ import annotations

import json
import re
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed value: the characters of a run id or a file name
SAFE = re.compile(r"[a-zA-Z0-9_\-\.]+")


class StoredPath:
    """A file or folder of the session's file systems."""

    def __init__(self, place, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.place = str(place)
        self.path = self.spark._jvm.org.apache.hadoop.fs.Path(self.place)
        self.conf = self.spark._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(self.conf)

    def __truediv__(self, name: str) -> "StoredPath":
        return StoredPath(f"{self.place.rstrip('/')}/{name}", self.spark)

    def __str__(self) -> str:
        return self.place

    def __fspath__(self) -> str:
        return self.place

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def resolved(self) -> str:
        return self.fs.makeQualified(self.path).toString()

    def read_text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def files(self):
        """(path, name within the folder) of all files below, in the order of their names."""
        found, walk, root = [], self.fs.listFiles(self.path, True), self.resolved().rstrip("/") + "/"
        while walk.hasNext():
            path = walk.next().getPath()
            found.append((path.toString().removeprefix(root), path))
        return [(path, name) for name, path in sorted(found, key=lambda x: x[0])]


def new_run_id() -> str:
    return secrets.token_hex(6)


def safe_name(name: str) -> str:
    """The name itself; names with other characters, and those of folders, are refused."""
    if not SAFE.fullmatch(name) or not name.strip("."):
        raise ValueError(f"unsafe name: {name!r}")
    return name


def run_dir(base, run_id: str) -> StoredPath:
    folder = StoredPath(base) / safe_name(run_id)
    folder.fs.mkdirs(folder.path)
    return folder


def file_sha256(place) -> str:
    at = StoredPath(place)
    stream = at.fs.open(at.path)
    try:
        return at.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and an order-free 256-bit digest of a table's rows."""
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(8)]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256).alias("sha256"))


def copy_input(source, target) -> StoredPath:
    """Copy a file between file systems; onto itself it stays as it is."""
    a, b = StoredPath(source), StoredPath(target)
    if a.resolved() != b.resolved():
        a.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.fs, a.path, b.fs, b.path, False, True, a.conf)
    return b


def zip_run(folder, target) -> StoredPath:
    """All files below ``folder``, but for the archive itself, streamed into one archive."""
    a, b = StoredPath(folder), StoredPath(target)
    jvm, own = a.spark._jvm, b.resolved()
    entries = [(path, name) for path, name in a.files() if path.toString() != own and not name.endswith(".crc")]
    out = jvm.java.util.zip.ZipOutputStream(b.fs.create(b.path, True))
    try:
        for path, name in entries:
            out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            stream = a.fs.open(path)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
            out.closeEntry()
    finally:
        out.close()
    return b


FENCE = re.compile(r"\A\s*```[^\n`]*\n?(.*?)\n?\s*```\s*\Z", re.DOTALL)


def parse_fenced_json(text: str):
    """JSON, bare or inside one fenced block."""
    inside = FENCE.match(text)
    return json.loads(inside[1] if inside else text)
