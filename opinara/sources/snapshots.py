"""Tables as atomic snapshots: a fresh folder per write, then a numbered manifest moved in, which readers follow.

``path/data/<name>/`` holds a version's files, ``path/manifests/<number>`` a line of JSON that tells which folder it is. A manifest is
written beside and renamed in, and none is ever replaced: until that one step readers see the version before, whole, and of two
writers that start from one version the later fails. A write that dies leaves a folder that no manifest names; ``expire`` takes these away with
old versions. On a store whose rename isn't atomic, put only the manifests where it is (``manifests``).
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has moved in the same version."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, manifests: str | None = None):
        self.spark, self.path, self.manifests = spark, path.rstrip("/"), (manifests or f"{path.rstrip('/')}/manifests").rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(self.manifests)
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What is told of a version, the latest if none is given; None if there is none at all."""
        known = self.versions()
        if version is None:
            if not known:
                return None
            version = known[-1]
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}; it has {known}")
        p, fs = self._fs(f"{self.manifests}/{version:020d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, df: DataFrame, form: str = "parquet", partition_by: tuple[str, ...] = (), expected: int | None = None, told: dict | None = None, **options) -> int:
        """The new version's number. expected: the version this one follows (0 for the first); by default the latest when the write begins."""
        before = (self.versions() or [0])[-1] if expected is None else expected
        if expected is not None and (self.versions() or [0])[-1] != expected:
            raise Conflict(f"{self.path} is at version {(self.versions() or [0])[-1]}, not {expected}")
        name = f"{before + 1:020d}-{uuid.uuid4().hex}"
        df.write.options(**options).partitionBy(*partition_by).format(form).save(f"{self.path}/data/{name}")
        self._move_in(before + 1, {"version": before + 1, "folder": name, "form": form, "at": time.time(), "schema": df.schema.jsonValue(), **(told or {})})
        return before + 1

    def _move_in(self, version: int, content: dict) -> None:
        target, fs = self._fs(f"{self.manifests}/{version:020d}")
        fs.mkdirs(target.getParent())
        beside, _ = self._fs(f"{self.manifests}/_{version:020d}-{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, target, none)  # fails if the version is there
        except Exception as e:
            fs.delete(beside, False)
            if version in self.versions():
                raise Conflict(f"{self.path} has a version {version} already") from e
            raise

    def read(self, schema=None, version: int | None = None, **options) -> DataFrame | None:
        """A version's rows, the latest by default; None if there is none. Files are those of the manifest, whatever is written meanwhile."""
        from pyspark.sql.types import StructType

        found = self.manifest(version)
        if found is None:
            return None
        reader = self.spark.read.format(found["form"]).options(**options).schema(schema or StructType.fromJson(found["schema"]))
        return reader.load(f"{self.path}/data/{found['folder']}")

    def expire(self, keep: int = 2, orphans_after: float = 86_400.0) -> list[str]:
        """Take away all but the last ``keep`` versions, and folders that no manifest names and that nobody has touched for so many seconds. The folders' names."""
        known = self.versions()
        held = {self.manifest(v)["folder"] for v in known[-keep:]} if keep else set()
        named = {self.manifest(v)["folder"] for v in known}
        folder, fs = self._fs(f"{self.path}/data")
        gone = []
        for v in known[:-keep] if keep else known:
            fs.delete(self._fs(f"{self.manifests}/{v:020d}")[0], False)  # first, so that no manifest names what is gone
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f.getPath().getName()
            if name not in held and (name in named or f.getModificationTime() / 1000 < time.time() - orphans_after):
                fs.delete(f.getPath(), True)
                gone.append(name)
        return sorted(gone)
