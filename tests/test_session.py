"""The scratch area follows the session's checkpoint folder."""

import pytest

from riskrank import session


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Session:
    """Stands in for a session: only the setting and the master are read."""

    def __init__(self, master, shared):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}


def test_scratch_uses_the_shared_folder():
    assert session.scratch_root(Session("yarn", "hdfs://nn/ckpt/")) == "hdfs://nn/ckpt/riskrank/app-1"


def test_a_session_without_a_shared_folder_is_refused(monkeypatch):
    monkeypatch.setattr(session, "_folder_where_unset", [])
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session("yarn", None))


def test_a_folder_can_stand_in_where_the_setting_is_missing(monkeypatch):
    monkeypatch.setattr(session, "_folder_where_unset", [])
    session.use_folder("/shared")
    assert session.scratch_root(Session("local[2]", None)) == "/shared/riskrank/app-1"
    assert session.scratch_root(Session("local[2]", "/set")) == "/set/riskrank/app-1"


def test_materialise_reads_back_what_it_wrote(spark):
    kept = session.materialise(spark.range(5), "numbers")
    assert kept.count() == 5 and "FileScan" in kept._jdf.queryExecution().executedPlan().toString()


def test_small_scans_are_dealt_over_all_slots(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.use_all_slots(one).rdd.getNumPartitions() == 8
    many = spark.range(0, 100, 1, 16)
    assert session.use_all_slots(many) is many
