import os

import pytest

from sediment.llm._common import Scratch, new_folder, shared_folder, written


def folders(spark):
    at = shared_folder(spark).removeprefix("file://")
    return {x for x in os.listdir(at) if x.startswith("scratch-test")}


def test_tables_go_with_their_owner(spark):
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            written(spark.range(3), "scratch-test-a")
            kept = inner.keep(written(spark.range(4), "scratch-test-b"))
            assert len(folders(spark)) == 2
        assert kept.count() == 4 and len(folders(spark)) == 1
        last = outer.keep(written(kept, "scratch-test-c"))
    assert last.count() == 4 and len(folders(spark)) == 1
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
