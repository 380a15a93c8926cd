import os

import pytest

from symscape import storage


class Session:
    """As much of a session as shared_dir() asks for."""

    def __init__(self, master, where=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = self
        self.where = where

    def get(self, key, default=None):
        return self.where or default

    def set(self, key, value):
        self.where = value


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session(master))
    assert storage.shared_dir(Session(master, "hdfs://h/x/")) == "hdfs://h/x"


def test_one_machine_may_use_its_own():
    s = Session("local[2]")
    assert storage.shared_dir(s) == storage.shared_dir(s) == s.where


def test_tables_are_written_and_removed(spark):
    a = storage.written(spark.range(3), "a")
    place = a._written_at.removeprefix("file://")
    assert os.path.isdir(place) and a.count() == 3
    b = storage.written(a.where("id > 0"), "b", a)
    assert not os.path.exists(place) and b.count() == 2
    storage.drop(b)
    storage.drop(spark.range(1))
    assert not os.path.exists(b._written_at.removeprefix("file://"))
