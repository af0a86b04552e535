"""The session: where steps are kept, how they are named, and when an earlier result is used again."""

from __future__ import annotations

import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftline.cluster import ship
from weftline.functions.text import safe_name
from weftline.storage import Files, table_path

MEMORY = ":memory:"


class Session:
    """A context manager: with Session(spark, folder) as s. One is active at a time; ':memory:' keeps nothing on disk.

    A step saved under its name with an equal fingerprint is read instead of run. One with another fingerprint is moved to
    the backups, and comes back from there if a later run asks for it again.
    """

    active: Session | None = None

    def __init__(self, spark: SparkSession, path: str = MEMORY, saves: bool = False) -> None:
        """saves: what a model or a Python function makes is saved as soon as its step is made, or taken from an earlier run."""
        self.saves = saves
        self.spark, self.path, self.files = ship(spark), path.rstrip("/"), Files(spark)
        self.steps: dict[str, Any] = {}
        self.parents: list[str] = []
        self.composite = False
        self.lock = threading.RLock()
        self.pool = ThreadPoolExecutor(4)

    def __enter__(self) -> Session:
        if Session.active is not None:
            raise RuntimeError("Another session is active.")
        Session.active = self
        if self.path != MEMORY:
            self._lock = f"{self.files.make(self.path)}/.lock"
            if self.files.exists(self._lock):
                Session.active = None
                raise RuntimeError(f"Another session works in {self.path}; if none does, remove {self._lock}.")
            self.files.create(self._lock, str(os.getpid()))
        return self

    def __exit__(self, *_: Any) -> None:
        Session.active = None
        self.pool.shutdown()
        if self.path != MEMORY:
            self.files.delete(self._lock)

    @property
    def in_memory(self) -> bool:
        return self.path == MEMORY

    def unique(self, name: str) -> str:
        """The name below its parent, with #2, #3 ... if it is taken."""
        with self.lock:
            whole = " / ".join([*self.parents, name])
            out, n = whole, 1
            while out in self.steps:
                n += 1
                out = f"{whole} #{n}"
            self.steps[out] = None
            return out

    def folder(self, name: str) -> str:
        return f"{self.path}/{safe_name(name)}"

    def scratch(self, name: str) -> str:
        """A folder of the step's own for other files."""
        root = f"{self.folder(name)}/_files" if not self.in_memory else f"{table_path(self.spark)}/{safe_name(name)}"
        return self.files.make(root)

    def found(self, name: str, fingerprint: str) -> dict[str, Any] | None:
        """The metadata of a saved result to use again; a result of other contents is put aside first."""
        if self.in_memory:
            return None
        folder, backups = self.folder(name), f"{self.path}/.backups/{safe_name(name)}"
        meta = self._metadata(folder)
        if meta and meta["fingerprint"] == fingerprint:
            return meta
        if meta:
            self.files.move(folder, f"{backups}/{meta['fingerprint']}")
        kept = f"{backups}/{fingerprint}"
        if self._metadata(kept):
            self.files.move(kept, folder)
            return self._metadata(folder)
        return None

    def _metadata(self, folder: str) -> dict[str, Any] | None:
        path = f"{folder}/step.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def save(self, name: str, df: DataFrame, metadata: dict[str, Any]) -> tuple[DataFrame, int]:
        """df written once, and its number of rows, which is read from the files; the metadata file comes last and at once, so a broken write never looks finished."""
        df.write.mode("overwrite").parquet(f"{self.folder(name)}/_dataset")
        saved = self.load(name)
        n = saved.count()
        self.files.write(f"{self.folder(name)}/step.json", json.dumps(metadata | {"num_rows": n}, default=str))
        return saved, n

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(name)}/_dataset")


def concurrent(*functions: Any) -> list[Any]:
    """Calls of several functions at the same time, each submitting Spark jobs of its own; their results in order."""
    with ThreadPoolExecutor(len(functions) or 1) as pool:
        return [f.result() for f in [pool.submit(f) for f in functions]]
