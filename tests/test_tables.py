"""Tables of a run are removed when it ends."""

import os

import pytest

from quarryline.sources import tables


def folders(spark):
    return {n for n in os.listdir(tables.shared_folder(spark).removeprefix("file:")) if n.startswith("table-")}


def test_only_what_is_kept_stays(spark):
    before = folders(spark)
    with tables.scratch(spark) as keep:
        inner = tables.written(spark.range(5))
        with tables.scratch(spark) as keep_inner:
            other, _ = keep_inner(inner.where("id > 1"))
            tables.written(spark.range(1))
        out, path = keep(other.where("id > 2"))
        assert len(folders(spark) - before) == 3
    assert out.count() == 2 and [path.endswith(n) for n in folders(spark) - before] == [True]
    tables.remove(spark, path)
    assert folders(spark) == before


def test_a_run_that_fails_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), tables.scratch(spark):
        tables.written(spark.range(5))
        raise ZeroDivisionError
    assert folders(spark) == before
