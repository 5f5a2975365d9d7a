"""Writes of several tables to a folder that all happen or none, also if the driver is lost in the middle.

Tables are written to path/.writing-<id>/new. When all of them are whole, one rename puts the record into place that says so; from then on
the write will be finished, before it is undone. Every later step is a rename of one table (or, where rows are added, of one
file), and what has been done can be told from what lies where, so that any step can be repeated. A last rename marks the write
as done, after which its folder only has to go.

    no record: the tables stand as before, the folder goes
    record:    each table is in new or in place; the rest is moved
    done:      the folder goes

recover(spark, path) brings a folder that a lost driver left behind to one of the two ends. One writer at a time may use a path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession

RECORD, DONE, PREFIX = "record", "done", ".writing-"


class WriteError(RuntimeError):
    pass


class Files:
    """The few operations on a store that commits are made of."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.at(a), self.at(b)):
            raise WriteError(f"{a} could not be moved to {b}")

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def names(self, path: str, pattern: str = "*") -> list[str]:
        found = self.fs.globStatus(self.at(f"{path}/{pattern}")) or ()
        return sorted(x.getPath().getName() for x in found)

    def files(self, path: str, at: str = "") -> Iterator[str]:
        """The data files below path, relative to it."""
        for x in self.fs.listStatus(self.at(f"{path}/{at}" if at else path)):
            name = f"{at}/{x.getPath().getName()}" if at else x.getPath().getName()
            if x.isDirectory():
                yield from self.files(path, name)
            elif not x.getPath().getName().startswith(("_", ".")):
                yield name

    def put(self, path: str, text: str) -> None:
        """Writes a file beside and renames it: it is there as a whole or not at all."""
        out = self.fs.create(self.at(f"{path}.part"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(f"{path}.part", path)

    def text(self, path: str) -> str:
        source = self.fs.open(self.at(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


class Commit:
    """A write under way: tables go to self.new, then finish() puts all of them into place."""

    def __init__(self, files: Files, path: str, name: str | None = None):
        self.files, self.path = files, path
        self.beside = f"{path}/{name or PREFIX + uuid.uuid4().hex}"
        self.new, self.old, self.record = f"{self.beside}/new", f"{self.beside}/old", f"{self.beside}/{RECORD}"

    def finish(self, tables: Sequence[str], add: bool = False) -> None:
        """Puts the tables of new into the places of those that are there, or adds their files to them. If a step fails, those before it
        are undone; if that fails too, everything stays as it lies, for recover."""
        f = self.files
        f.mkdirs(self.old)
        moves = {n: list(f.files(f"{self.new}/{n}")) if add and f.exists(f"{self.path}/{n}") else None for n in tables}
        f.put(self.record, json.dumps(moves))
        try:
            self.move(moves)
        except Exception as e:
            try:
                self.undo(moves)
            except Exception as again:
                raise WriteError(f"{e}; undoing failed as well ({again}): recover() finishes or undoes what lies in {self.beside}") from e
            raise
        self.close()

    def move(self, moves: dict[str, list[str] | None]) -> None:
        """moves: by table the files to add, or None for the table as a whole. What has been moved before is passed over."""
        f = self.files
        for n, added in moves.items():
            new, place = f"{self.new}/{n}", f"{self.path}/{n}"
            if added is None and f.exists(new):
                if f.exists(place):
                    f.rename(place, f"{self.old}/{n}")
                f.rename(new, place)
            for name in added or ():
                if f.exists(f"{new}/{name}"):
                    f.mkdirs(f"{place}/{name}".rpartition("/")[0])
                    f.rename(f"{new}/{name}", f"{place}/{name}")

    def undo(self, moves: dict[str, list[str] | None]) -> None:
        """Takes the new tables or files out again, puts the old tables back, and removes the write."""
        f = self.files
        for n, added in reversed(moves.items()):
            new, place = f"{self.new}/{n}", f"{self.path}/{n}"
            if added is None:
                if not f.exists(new):
                    f.rename(place, new)
                if f.exists(f"{self.old}/{n}"):
                    f.rename(f"{self.old}/{n}", place)
            for name in added or ():
                if not f.exists(f"{new}/{name}"):
                    f.rename(f"{place}/{name}", f"{new}/{name}")
        self.close()

    def close(self) -> None:
        self.files.rename(self.record, f"{self.beside}/{DONE}")
        self.files.delete(self.beside)


def recover(spark: SparkSession, path: str, undo: bool = False) -> dict[str, str]:
    """Ends the writes that a lost driver left under path: "dropped" those whose tables were not yet whole, "finished" (or with
    undo "undone") those whose were, "cleared" those that had only to be removed. Can itself be stopped and repeated at any step."""
    files, out = Files(spark, path), {}
    for name in files.names(path, PREFIX + "*"):
        c = Commit(files, path, name)
        if not files.exists(c.record):
            out[name] = "cleared" if files.exists(f"{c.beside}/{DONE}") else "dropped"
            files.delete(c.beside)
            continue
        moves = json.loads(files.text(c.record))
        if undo:
            c.undo(moves)
        else:
            c.move(moves)
            c.close()
        out[name] = "undone" if undo else "finished"
    return out
