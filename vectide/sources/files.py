"""Small files and renames through Hadoop's file systems, so a store may lie wherever Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.root = root.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self._fs.getUri(), self._conf)
        self._options = jvm.org.apache.hadoop.fs.Options.Rename
        self._jvm, self._gateway = jvm, spark.sparkContext._gateway

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        at = self._path(self.path(name) if name else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, names: list[str]) -> int:
        """Bytes of all files in these folders; -1 if one is missing."""
        paths = [self._path(self.path(n)) for n in names]
        return sum(self._fs.getContentSummary(p).getLength() for p in paths) if all(map(self._fs.exists, paths)) else -1

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(self.path(name) if name else self.root))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes a file beside the old one and renames it over: a reader sees the old text or the new one, never a part."""
        new = self._path(self.path(f".{name.replace('/', '_')}.new"))
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
        finally:
            out.close()
        self._move(new, self._path(self.path(name)), True)

    def rename(self, old: str, new: str) -> None:
        self._move(self._path(self.path(old)), self._path(self.path(new)), False)

    def _move(self, old, new, over: bool) -> None:
        kinds = self._gateway.new_array(self._options, 1)
        kinds[0] = self._options.OVERWRITE if over else self._options.NONE
        self._context.rename(self._context.makeQualified(old), self._context.makeQualified(new), kinds)
