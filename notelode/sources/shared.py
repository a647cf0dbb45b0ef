"""Small files on any file system Spark can reach, written so that a reader sees all of one or nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self) -> None:
        self.fs.mkdirs(self._at(""))

    def names(self, name: str = "") -> list[str]:
        if not self.fs.exists(self._at(name)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(name)))

    def sizes(self, name: str) -> list[int]:
        """Bytes of the data files below a folder, one entry each."""
        out, found = [], self.fs.listFiles(self._at(name), True)
        while found.hasNext():
            x = found.next()
            if not x.getPath().getName().startswith(("_", ".")):
                out.append(x.getLen())
        return out

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def put(self, name: str, value: dict) -> None:
        """Write JSON under a name of its own, then rename: the last step is the one that counts."""
        temporary = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        if not self.fs.rename(temporary, self._at(name)) and not self.exists(name):
            raise OSError(f"can't write {name}")

    def get(self, name: str) -> dict:
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
