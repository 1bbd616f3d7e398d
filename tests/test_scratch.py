"""Tables that cut lineage: where they lie and how they go."""

import os
from urllib.parse import urlparse

import pytest

from readlake import scratch


def local(path):
    return urlparse(path).path


def test_scopes_delete_what_was_saved_inside(spark):
    outer = scratch.saved(spark.range(3))
    with scratch.scope(spark):
        inner = scratch.saved(spark.range(5))
        path = local(os.path.dirname(inner.inputFiles()[0]))
        assert inner.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and outer.count() == 3
    scratch.delete(spark, path)  # nothing is there any more


def test_an_error_ends_a_scope_too(spark):
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        path = local(os.path.dirname(scratch.saved(spark.range(1)).inputFiles()[0]))
        1 / 0
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        scratch.checkpoint_dir(Session)
