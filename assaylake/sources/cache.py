"""Write-once tables that know whether they are complete.

A cached table lives in ``<base>/<name>/<key>``, where the key is a hash of
the settings it was made with and of the files it was made from (path, length,
time). Its data are written to a folder of their own; when Spark has committed
them, a manifest that lists every file with its length, the rows and the
schema is put beside it, and only that makes the table exist. A run that dies
leaves a folder without a manifest, which nobody reads; a table whose files do
not match its manifest counts as missing and is built again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assaylake.sources.io import read_assay, write_assay

MANIFEST = "manifest.json"


class _Folder:
    """The few file operations needed, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, uri: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, uri: str) -> dict[str, list[int]]:
        """``path -> [length, time]`` of all visible files below; none where there is no such path."""
        root = self._path(uri)
        if not self._fs.exists(root):
            return {}
        found, at = {}, self._fs.listFiles(root, True)
        while at.hasNext():
            s = at.next()
            if not s.getPath().getName().startswith((".", "_")):
                found[s.getPath().toString()] = [s.getLen(), s.getModificationTime()]
        return found

    def read(self, uri: str) -> str | None:
        """Text of a file; None where there is none, or one that fails its checksum."""
        path = self._path(uri)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "ChecksumException":
                return None
            raise
        finally:
            stream.close()

    def put(self, uri: str, text: str) -> None:
        """Write beside and rename, so that no reader meets half a file."""
        draft, path = self._path(f"{uri}.{uuid.uuid4().hex}"), self._path(uri)
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self._fs.exists(path):
            self._fs.delete(path, False)
        if not self._fs.rename(draft, path):
            raise OSError(f"cannot put {uri}")

    def folders(self, uri: str) -> list[str]:
        root = self._path(uri)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(root) if s.isDirectory())


def cache_key(spark: SparkSession, settings: dict[str, Any], inputs: Sequence[str] = ()) -> str:
    """Hash of the settings and of the input files as they are now."""
    files = {p: sorted(_Folder(spark, p).files(p).items()) for p in inputs}
    told = json.dumps({"settings": settings, "inputs": files}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def complete(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a finished table, or None: no manifest, or files that do not match it."""
    store = _Folder(spark, folder)
    try:
        manifest = json.loads(store.read(f"{folder}/{MANIFEST}") or "null")
    except ValueError:
        return None
    if manifest is None:
        return None
    there = {p: v[0] for p, v in store.files(f"{folder}/{manifest['data']}").items()}
    want = {f"{p}": n for p, n in manifest["files"].items()}
    return manifest if there == want else None


def cached(spark: SparkSession, base: str, name: str, build: Callable[[], DataFrame],
           settings: dict[str, Any] | None = None, inputs: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """The table ``name`` made by ``build`` with these settings from these input files.

    Built once: later calls read it back and do not call ``build``. Other
    settings or changed inputs are another table. Two builders at the same
    time both finish, and the manifest written last counts. ``fmt`` is
    ``parquet`` or a delimited one (``tsv``, ``csv``).
    """
    folder = f"{base.rstrip('/')}/{name}/{cache_key(spark, settings or {}, inputs)}"
    manifest = complete(spark, folder)
    if manifest is None:
        manifest = write_part(spark, folder, build(), fmt)
    schema = schema_of(manifest)
    files = sorted(manifest["files"])
    if not files:
        return spark.createDataFrame([], schema)
    if manifest["format"] == "parquet":
        return spark.read.schema(schema).parquet(*files)
    return read_assay(spark, files, schema, manifest["format"])


def schema_of(manifest: dict) -> T.StructType:
    return T.StructType.fromJson(manifest["schema"])


def parts(spark: SparkSession, folder: str) -> list[dict]:
    """Manifests of the finished tables in the folders below ``folder``."""
    found = (complete(spark, f) for f in _Folder(spark, folder).folders(folder))
    return [m for m in found if m is not None]


def write_part(spark: SparkSession, folder: str, df: DataFrame, fmt: str = "parquet", more: dict | None = None) -> dict:
    """Write ``df`` to a new folder and finish it with its manifest, which holds ``more`` as well."""
    store, data = _Folder(spark, folder), f"data-{uuid.uuid4().hex}"
    write_assay(df, f"{folder}/{data}", mode="error", fmt=fmt)
    manifest = {**(more or {}), "name": folder.rsplit("/", 1)[1], "format": fmt, "data": data, "schema": json.loads(df.schema.json()),
                "files": {p: v[0] for p, v in store.files(f"{folder}/{data}").items()}}
    store.put(f"{folder}/{MANIFEST}", json.dumps(manifest))
    return manifest
