import pytest

from orderlens.session import ensure_skew_handling, scratch_path, scratch_root


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class FakeContext:
    folder = None

    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"

    def getCheckpointDir(self):
        return self.folder


class FakeSession:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), FakeContext(master)


def test_configured_folder_is_used():
    session = FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch_root(session) == "hdfs:///shared"
    assert scratch_path(session, "t").startswith("hdfs:///shared/orderlens/t-")
    assert scratch_path(session, "t") != scratch_path(session, "t")


def test_temporary_folder_only_on_one_machine():
    local = FakeSession("local[2]")
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(ValueError):
        scratch_root(FakeSession("yarn"))


def test_checkpoint_folder_of_the_context_is_used():
    session = FakeSession("yarn")
    session.sparkContext.folder = "hdfs:///checkpoints/"
    assert scratch_root(session) == "hdfs:///checkpoints"


def test_skew_handling_is_switched_on(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    ensure_skew_handling(spark)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
