"""Written intermediate tables: their folder, their scopes."""

from __future__ import annotations

import os

import pytest

from folioloom.operators import tables


def test_scopes_delete_all_but_what_is_kept(spark):
    place = lambda df: tables._PATHS[df].removeprefix("file://")
    with tables.scratch(spark) as outer:
        with tables.scratch(spark) as inner:
            gone, kept = (tables.materialized(spark.range(3), "t") for _ in range(2))
            inner.keep(kept)
            assert os.path.exists(place(gone))
        assert not os.path.exists(place(gone)) and kept.count() == 3
        last = tables.materialized(kept.selectExpr("id + 1 AS id"), "t")
        outer.keep(last)
    assert not os.path.exists(place(kept)) and sorted(r.id for r in last.collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError), tables.scratch(spark) as failed:
        lost = tables.materialized(spark.range(1), "t")
        failed.keep(lost)
        raise RuntimeError
    assert not os.path.exists(place(lost))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": master}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(type("Session", (), {"conf": Conf()})())
