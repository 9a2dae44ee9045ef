import os

import pytest

from jobmargin.session import run_folder, shared_root


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    """Stands for a session with or without ``spark.checkpoint.dir``."""

    def __init__(self, master, **settings):
        self.sparkContext, self.conf = _Context(master), settings


def test_the_named_folder_is_used():
    session = _Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///shared"})
    assert shared_root(session) == "hdfs:///shared" == session.sparkContext.folder
    assert run_folder(session, "x").startswith("hdfs:///shared/jobmargin/x-")


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(_Session("yarn"))


def test_a_bare_local_session_gets_its_own():
    session = _Session("local[2]")
    assert os.path.isdir(shared_root(session)) and shared_root(session) == session.sparkContext.folder


def test_run_folders_differ(spark):
    assert run_folder(spark, "a") != run_folder(spark, "a")
