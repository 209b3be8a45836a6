"""Fitted models and their tables, published as a whole.

A version is written to a folder of its own.  Only then is its manifest created, whose name
counts on from the newest and ends in characters of its own, so no save replaces another's.
Readers follow the last manifest that is complete, so they see one version or the next and
never a mixture; a save that fails on the way leaves a folder that nothing points to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(path)] if self.files.exists(path) else []

    def _manifest(self, version: str) -> dict | None:
        """None while the manifest is being written."""
        stream = self.files.open(self._path(f"manifests/{version}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[str]:
        """Oldest first.  Of two saves at the same time either may count as the newer."""
        names = self._names("manifests")
        return sorted(n[:-5] for n in names if n.endswith(".json") and not n.startswith("."))

    def publish(self, models: dict[str, PipelineModel], **tables: DataFrame) -> str:
        """Save models and tables as the next version; returns its name."""
        own = uuid.uuid4().hex
        folder = f"versions/{own}"
        for name, model in models.items():
            model.write().save(f"{self.path}/{folder}/models/{name}")
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/{folder}/tables/{name}")
        text = json.dumps({"folder": folder, "models": list(models), "tables": list(tables)})
        number = max((int(v.split("-")[0]) for v in self.versions()), default=0) + 1
        version = f"{number:08d}-{own}"
        stream = self.files.create(self._path(f"manifests/{version}.json"), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        return version

    def latest(self) -> str:
        for version in reversed(self.versions()):
            if self._manifest(version):
                return version
        raise FileNotFoundError(f"no version in {self.path}")

    def read(self, version: str | None = None) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
        """Models and tables of a version, or of the newest."""
        found = self._manifest(version or self.latest())
        base = f"{self.path}/{found['folder']}"
        return (
            {name: PipelineModel.load(f"{base}/models/{name}") for name in found["models"]},
            {name: self.spark.read.parquet(f"{base}/tables/{name}") for name in found["tables"]},
        )

    def forget(self, keep: int = 2) -> None:
        """Remove all but the newest versions: manifests first, so no reader starts on one."""
        for version in self.versions()[:-keep] if keep else self.versions():
            found = self._manifest(version)
            self.files.delete(self._path(f"manifests/{version}.json"), False)
            if found:
                self.files.delete(self._path(found["folder"]), True)
