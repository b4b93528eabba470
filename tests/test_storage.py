"""Scopes of temporary tables."""

from pathlib import Path

import pytest

from eventlens.functions import storage
from eventlens.functions.storage import materialize, temporary_tables


def paths(df):
    return {Path(f.removeprefix("file:")) for f in df.inputFiles()}


def test_tables_go_with_their_scope(spark, tmp_path):
    before = materialize(spark.range(3), "t")
    with temporary_tables(spark):
        outer = materialize(spark.range(5), "t")
        with temporary_tables(spark):
            inner = materialize(outer.where("id > 1"), "t")
            gone = paths(inner)
            inner.write.parquet(str(tmp_path / "result"))
        assert gone and not any(p.exists() for p in gone)
        assert outer.count() == 5
        gone |= paths(outer)
    assert not any(p.exists() for p in gone)
    assert spark.read.parquet(str(tmp_path / "result")).count() == 3
    after = materialize(spark.range(4), "t")
    assert before.count() == 3 and after.count() == 4


def test_tables_go_after_an_error(spark):
    with pytest.raises(ValueError), temporary_tables(spark) as folder:
        materialize(spark.range(3), "t")
        assert Path(folder.removeprefix("file:")).exists()
        raise ValueError
    assert not Path(folder.removeprefix("file:")).exists()
    assert storage._scope.get() is None


def test_an_empty_scope(spark):
    with temporary_tables(spark):
        pass
