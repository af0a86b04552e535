"""Tables cut from their lineage in the folder that all executors share, and files on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Files and folders by their paths, with or without a scheme, through the file systems of the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> str:
        p, fs = self._at(path)
        fs.mkdirs(p)
        return path

    def names(self, folder: str) -> list[str]:
        """The sorted names in a folder."""
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def state(self, path: str) -> list[tuple[str, int, int]]:
        """Path, size and time of a file, or of all files below a folder but hidden ones."""
        p, fs = self._at(path)
        out = []
        for s in fs.globStatus(p) or []:
            found = fs.listFiles(s.getPath(), True)
            while found.hasNext():
                f = found.next()
                if f.getPath().getName()[0] not in "._":
                    out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def move(self, old: str, new: str) -> None:
        """A rename; what is at the new path is replaced."""
        p, fs = self._at(old)
        q = self.jvm.org.apache.hadoop.fs.Path(new)
        if q.getParent() is not None:
            fs.mkdirs(q.getParent())
        fs.delete(q, True)
        if not fs.rename(p, q):
            raise OSError(f"{old} couldn't be renamed to {new}.")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> None:
        """A new file; one that is there already is an error."""
        p, fs = self._at(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, path: str, text: str) -> None:
        """A file written whole or not at all."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        self.move(temporary, path)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        source = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of one's own in local mode, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    path = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_own: set[str] = set()


def table_path(spark: SparkSession) -> str:
    """A path for a table of this application; all of them are removed when the driver ends."""
    folder = f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        files = Files(spark)
        atexit.register(lambda: _removed(files, folder))
    return f"{folder}/{uuid.uuid4().hex}"


def _removed(files: Files, folder: str) -> None:
    try:
        files.delete(folder)
    except Exception:  # noqa: BLE001, S110
        pass  # the driver's JVM has ended already


def materialised(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: later reads survive lost executors and repeat no work."""
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
