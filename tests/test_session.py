import pytest

from millrace import workspace
from millrace.session import SETTINGS, shuffle_settings


def test_settings_apply(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value


def test_shuffle_pieces_follow_the_data():
    pieces = [int(shuffle_settings(size)["spark.sql.shuffle.partitions"]) for size in (1, 10**12, 10**14)]
    assert pieces == [200, 3726, 372_530]


def test_shared_folder_is_the_configured_one(spark):
    assert workspace.fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert workspace.fresh_path(spark, "x") != workspace.fresh_path(spark, "x")


class Conf:
    def get(self, key, default=None):
        return default


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master):
        self.conf, self.sparkContext = Conf(), Context(master)


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session("spark://host:7077"))


def test_local_session_may_use_its_own_folder():
    session = Session("local[2]")
    first = workspace.shared_dir(session)
    assert first.startswith("/tmp/run-") and workspace.shared_dir(session) == first
