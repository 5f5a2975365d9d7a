import itertools

import pytest

from weftline.plans.model import Column, ForeignKey, Schema, Table
from weftline.sources import commits, stores

SCHEMA = Schema.of(Table("one", (Column("a", "integer", primary=True),), ("a",)), Table("two", (Column("a", "integer"),), (), (ForeignKey(("a",), "one", ("a",)),)))


class Crash(BaseException):
    """A driver that is lost: nothing is cleaned up."""


def write(spark, path, n, mode):
    return stores.write_tables(spark, {"one": spark.range(n).toDF("a"), "two": spark.range(n).toDF("a")}, SCHEMA, path, mode)


def rows(spark, path):
    return {n: spark.read.parquet(f"{path}/{n}").count() if stores.exists(spark, f"{path}/{n}") else None for n in ("one", "two")}


def breaking(monkeypatch, after, error):
    """Every rename, and every deletion, from the one after so many fails."""
    calls = itertools.count()
    for name in ("rename", "delete"):
        real = getattr(commits.Files, name)

        def step(self, *args, real=real):
            if next(calls) >= after:
                raise error
            return real(self, *args)

        monkeypatch.setattr(commits.Files, name, step)


@pytest.mark.parametrize("mode", ["truncate", "append"])
def test_a_crash_after_each_step(spark, tmp_path, monkeypatch, mode):
    """Whatever step a driver is lost at, recovery gives all the old rows or all the new ones, and leaves nothing behind."""
    new = {"truncate": 3, "append": 8}[mode]
    ends = []
    for undo, after in itertools.product((False, True), range(12)):
        path = f"{tmp_path}/{mode}-{undo}-{after}"
        write(spark, path, 5, "fresh")
        with monkeypatch.context() as m:
            breaking(m, after, Crash())
            try:
                write(spark, path, 3, mode)
                whole = True
            except Crash:
                whole = False
        commits.recover(spark, path, undo)
        got = rows(spark, path)
        assert got in ({"one": new, "two": new}, {"one": 5, "two": 5}), (after, got)
        assert not whole or got["one"] == new
        assert commits.Files(spark, path).names(path, ".writing-*") == [] and commits.recover(spark, path) == {}
        ends.append((undo, got["one"]))
        if whole:
            assert after > 4
    assert {(False, new), (False, 5), (True, 5)} <= set(ends)


def test_recovery_can_be_stopped_too(spark, tmp_path, monkeypatch):
    for undo, after in itertools.product((False, True), range(6)):
        path = f"{tmp_path}/{undo}-{after}"
        write(spark, path, 5, "fresh")
        with monkeypatch.context() as m:
            breaking(m, 2, Crash())
            with pytest.raises(Crash):
                write(spark, path, 3, "truncate")
        with monkeypatch.context() as m:
            breaking(m, after, Crash())
            try:
                commits.recover(spark, path, undo)
            except Crash:
                pass
        commits.recover(spark, path)
        assert rows(spark, path) in ({"one": 3, "two": 3}, {"one": 5, "two": 5})


@pytest.mark.parametrize("mode", ["truncate", "append"])
def test_a_failed_rename_loses_nothing(spark, tmp_path, monkeypatch, mode):
    """One rename fails: the old tables stand. All renames fail from some call on: the old rows are kept for recovery."""
    path = str(tmp_path / "x")
    write(spark, path, 5, "fresh")
    for after in range(1, 5 if mode == "truncate" else 3):
        with monkeypatch.context() as m:
            real, calls = commits.Files.rename, itertools.count()
            m.setattr(commits.Files, "rename", lambda self, a, b: real(self, a, b) if next(calls) != after else (_ for _ in ()).throw(commits.WriteError("no")))  # noqa: B023
            with pytest.raises(commits.WriteError, match="no"):
                write(spark, path, 3, mode)
        assert rows(spark, path) == {"one": 5, "two": 5} and commits.Files(spark, path).names(path, ".writing-*") == []
    with monkeypatch.context() as m:
        breaking(m, 4 if mode == "truncate" else 2, commits.WriteError("never"))
        with pytest.raises(commits.WriteError, match="recover"):
            write(spark, path, 3, mode)
    assert list(commits.recover(spark, path, undo=True).values()) == ["undone"] and rows(spark, path) == {"one": 5, "two": 5}


def test_the_next_write_finishes_what_was_left(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    write(spark, path, 5, "fresh")
    with monkeypatch.context() as m:
        breaking(m, 2, Crash())
        with pytest.raises(Crash):
            write(spark, path, 3, "truncate")
    write(spark, path, 1, "append")
    assert rows(spark, path) == {"one": 4, "two": 4}


def derby(spark, url, text):
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        s = c.createStatement()
        if text.startswith("SELECT"):
            found = s.executeQuery(text)
            found.next()
            return found.getLong(1)
        return s.executeUpdate(text)
    finally:
        c.close()


def test_jdbc_all_tables_or_none(spark):
    """Against Derby, which comes with Spark: keys hold, a row that breaks one leaves every table as it was."""
    url = "jdbc:derby:memory:weft;create=true"
    derby(spark, url, 'CREATE TABLE "one" ("a" BIGINT PRIMARY KEY)')
    derby(spark, url, 'CREATE TABLE "two" ("a" BIGINT REFERENCES "one" ("a"))')
    count = lambda n: derby(spark, url, f'SELECT count(*) FROM "{n}"')
    made = lambda a, b: {"two": spark.range(b).toDF("a"), "one": spark.range(a).toDF("a")}
    assert stores.write_jdbc(made(5, 5), SCHEMA, url, "fresh") == {"one": 5, "two": 5}
    with pytest.raises(stores.WriteError, match="5 rows"):
        stores.write_jdbc(made(5, 5), SCHEMA, url, "fresh")
    with pytest.raises(Exception, match="(?i)foreign key"):
        stores.write_jdbc(made(3, 4), SCHEMA, url, "truncate")
    assert (count("one"), count("two")) == (5, 5)
    assert stores.write_jdbc(made(3, 2), SCHEMA, url, "truncate") == {"one": 3, "two": 2}
    assert stores.write_jdbc({"two": spark.range(1).toDF("a")}, SCHEMA, url) == {"two": 1} and (count("one"), count("two")) == (3, 3)
    assert stores.write_jdbc({"other": spark.range(4).toDF("a")}, SCHEMA, url) == {"other": 4} and count("other") == 4
    assert derby(spark, url, "SELECT count(*) FROM SYS.SYSTABLES WHERE TABLENAME LIKE '%__new'") == 0
