"""Analyses that are replaced as a whole: data in folders of their own, a manifest, and one pointer that moves last.

A swap writes the new rows to a folder, then a manifest that says of each slick
in which folder its rows are, and then renames a small file over the pointer.
Readers take the manifest that the pointer names, so they see all of a swap or
nothing of it, also when it fails at any step or while it runs.  A manifest has
a row a slick; a table of more than ``MOST_FOLDERS`` folders is written anew as
one.  There is one writer at a time (``single_flight``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of data that a manifest may name.
MOST_FOLDERS = 32


class Analyses:
    def __init__(self, spark: SparkSession, path: str, key: str = "slick_id", most_folders: int = MOST_FOLDERS) -> None:
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), key, most_folders
        self.fs = spark._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        return self.fs.Path(f"{self.path}/{name}")

    def current(self) -> str | None:
        """The version that readers see; none before the first swap."""
        pointer = self._file("current")
        files = pointer.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(pointer):
            return None
        stream = files.open(pointer)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _point(self, version: str) -> None:
        """One rename over the pointer; a failure before it leaves the old one."""
        temporary, pointer = self._file(f".{version}"), self._file("current")
        files = pointer.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = files.create(temporary, True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        context = self.fs.FileContext.getFileContext(files.makeQualified(pointer).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.fs.Options.Rename, 1)
        options[0] = self.fs.Options.Rename.OVERWRITE
        context.rename(files.makeQualified(temporary), files.makeQualified(pointer), options)

    def _manifest(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest/{version}")

    def read(self) -> DataFrame:
        """All rows of the current version."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"nothing was published at {self.path}")
        manifest = self._manifest(version)
        folders = [r.folder for r in manifest.select("folder").distinct().collect()]  # at most ``most``
        if not folders:
            return self.spark.read.parquet(f"{self.path}/data").drop("folder").limit(0)
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/folder={f}" for f in folders))
        kept = rows.withColumn("folder", F.col("folder").cast("string")).join(manifest, [self.key, "folder"], "left_semi")
        return kept.drop("folder")

    def swap(self, analysis: DataFrame, replaced: DataFrame | None = None) -> str:
        """Replaces the rows of the keys in ``analysis``, and of those in ``replaced`` (they may have none now); all others stay."""
        version, old = uuid.uuid4().hex, self.current()
        analysis.write.parquet(f"{self.path}/data/folder={version}")
        written = self.spark.read.schema(analysis.schema).parquet(f"{self.path}/data/folder={version}")
        new = written.select(self.key).distinct()
        manifest = new.withColumn("folder", F.lit(version))
        if old is not None:
            gone = new if replaced is None else new.union(replaced.select(self.key)).distinct()
            manifest = self._manifest(old).join(gone, self.key, "left_anti").unionByName(manifest)
        manifest.write.parquet(f"{self.path}/manifest/{version}")
        if self._manifest(version).select("folder").distinct().count() > self.most:
            version = self._whole(version, written.columns)
        self._point(version)
        return version

    def _whole(self, version: str, columns: list[str]) -> str:
        """The rows that a version names, in one folder."""
        manifest, one = self._manifest(version), uuid.uuid4().hex
        folders = [r.folder for r in manifest.select("folder").distinct().collect()]
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/folder={f}" for f in folders))
        rows.withColumn("folder", F.col("folder").cast("string")).join(manifest, [self.key, "folder"], "left_semi").select(*columns).write.parquet(f"{self.path}/data/folder={one}")
        manifest.select(self.key, F.lit(one).alias("folder")).write.parquet(f"{self.path}/manifest/{one}")
        return one

    def clean(self) -> list[str]:
        """Deletes the folders and manifests that the current version doesn't need, once no reader has an older one open."""
        version, gone = self.current(), []
        if version is None:
            return gone
        needed = {f"folder={r.folder}" for r in self._manifest(version).select("folder").distinct().collect()}
        for parent, keep in (("data", needed), ("manifest", {version})):
            folder = self._file(parent)
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in files.listStatus(folder):
                if s.getPath().getName() not in keep:
                    files.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return gone
