"""A catalogue of snapshots: immutable versions, published by renaming one small file.

A version is a folder of tables that is never written again. The newest manifest
says which version every name stands for; a change writes the next manifest
beside the others and renames it into place, so a reader sees the state before or
after, and a run that breaks off leaves the old one. Who has pinned a version
reads it until vacuum() takes what no kept manifest names.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from canopyrank.storage import exists, files, move, read_text, remove, write_text

#: Times that a change is tried again where others change the catalogue meanwhile.
TRIES = 20


class Conflict(RuntimeError):
    """Others kept changing the catalogue."""


class Catalogue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> list[str]:
        return sorted(f for f in files(self.spark, f"{self.root}/manifests") if f.endswith(".json"))

    def _state(self) -> tuple[int, dict[str, dict]]:
        names = self._manifests()
        if not names:
            return 0, {}
        return int(names[-1].split(".")[0]), json.loads(read_text(self.spark, f"{self.root}/manifests/{names[-1]}"))

    def _change(self, change) -> None:
        """change(state) edits the entries by name in place; published as the next manifest, tried anew if another run took its number."""
        for _ in range(TRIES):
            number, state = self._state()
            change(state)
            beside, at = f"{self.root}/manifests/_{uuid.uuid4().hex}", f"{self.root}/manifests/{number + 1:012d}.json"
            write_text(self.spark, beside, json.dumps(state, sort_keys=True))
            if not exists(self.spark, at):
                try:
                    move(self.spark, beside, at)
                    return
                except OSError:
                    pass
            remove(self.spark, beside)
        raise Conflict(f"{self.root} is changed by others all the time")

    def save(self, name: str, tables: dict[str, DataFrame], note: str = "") -> str:
        """Write the tables as a new version and let the name stand for it; the version."""
        if not name or not tables or any(not t or "/" in t for t in tables):
            raise ValueError("a snapshot has a name, and tables with plain names")
        version = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{table}")

        def put(state):
            state[name] = {"version": version, "saved": time.time(), "note": note, "tables": sorted(tables)}

        self._change(put)
        return version

    def list(self) -> list[dict]:
        """name, version, saved (seconds), note and tables of every snapshot, by name."""
        return [{"name": n, **e} for n, e in sorted(self._state()[1].items())]

    def pin(self, name: str) -> str:
        """The version that a name stands for now."""
        state = self._state()[1]
        if name not in state:
            raise KeyError(name)
        return state[name]["version"]

    def load(self, name: str, table: str, version: str | None = None) -> DataFrame:
        """A table of a snapshot, or of a pinned version of it."""
        at = f"{self.root}/versions/{version or self.pin(name)}/{table}"
        if not exists(self.spark, at):
            raise KeyError(table)
        return self.spark.read.parquet(at)

    def rename(self, old: str, new: str) -> None:
        def put(state):
            if old not in state:
                raise KeyError(old)
            if new in state and new != old:
                raise ValueError(f"there is a snapshot {new} already")
            state[new] = state.pop(old)

        self._change(put)

    def update(self, name: str, note: str) -> None:
        """Another note."""
        def put(state):
            if name not in state:
                raise KeyError(name)
            state[name]["note"] = note

        self._change(put)

    def delete(self, name: str) -> None:
        """The name goes; its version stays for who has pinned it, until vacuum()."""
        def put(state):
            if name not in state:
                raise KeyError(name)
            del state[name]

        self._change(put)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the newest manifests and what they do not name, versions of broken-off runs included; no run may be saving meanwhile."""
        names = self._manifests()
        used = {e["version"] for n in names[-keep:] for e in json.loads(read_text(self.spark, f"{self.root}/manifests/{n}")).values()}
        gone = [v for v in files(self.spark, f"{self.root}/versions") if v not in used]
        for v in gone:
            remove(self.spark, f"{self.root}/versions/{v}")
        for n in files(self.spark, f"{self.root}/manifests"):
            if n not in names[-keep:]:
                remove(self.spark, f"{self.root}/manifests/{n}")
        return sorted(gone)
