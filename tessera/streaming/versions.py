"""Tables of JSON lines that grow by whole versions.

A version is written to a folder of its own and becomes visible when its entry
is created in the manifest folder, which fails if it is there already.  So a
failed or repeated version leaves nothing that readers see, and readers see
whole versions only.  The first entry fixes the table's protocol; versions of
another one are an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str
    schema: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[str, dict]:
        """Name to folder and protocol of the committed versions; there is one for each write."""
        if not self._files().exists(self._path("manifest")):
            return {}
        rows = self.spark.read.text(f"{self.path}/manifest", wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).collect()
        return {r.name: json.loads(r.value) for r in rows}

    def read(self) -> DataFrame:
        """All rows of the committed versions."""
        folders = [f"{self.path}/{e['folder']}" for e in self.entries().values()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(folders)

    def commit(self, rows: DataFrame, name: str, protocol: str = "") -> bool:
        """Write a version and make it visible; false, and nothing is written, if that name is committed already."""
        known = self.entries()
        other = {e["protocol"] for e in known.values()} - {protocol}
        if other:
            raise ValueError(f"the table has protocol {sorted(other)}, not {protocol!r}")
        if name in known:
            return False
        folder = f"data/{name}-{uuid.uuid4().hex}"
        try:
            rows.write.json(f"{self.path}/{folder}")
            entry = self._files().create(self._path(f"manifest/{name}"), False)
        except Exception:
            self._files().delete(self._path(folder), True)
            raise
        entry.write(bytearray(json.dumps({"folder": folder, "protocol": protocol}).encode()))
        entry.close()
        return True
