"""The checkpoint folder: a caller's choice, the setting, a scratch folder only for local sessions."""
from types import SimpleNamespace

import pytest

from subseg.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master, have=None):
        self.master, self.have = master, have

    def getCheckpointDir(self):
        return self.have

    def setCheckpointDir(self, d):
        self.have = d


def session(master, have=None, named=None):
    return SimpleNamespace(sparkContext=Context(master, have), conf=SimpleNamespace(get=lambda k, d=None: named if named else d))


def test_a_callers_choice_stays():
    s = session("yarn", have="hdfs:///mine", named="hdfs:///other")
    assert ensure_checkpoint_dir(s) == "hdfs:///mine" and s.sparkContext.have == "hdfs:///mine"


def test_the_setting_is_used():
    assert ensure_checkpoint_dir(session("yarn", named="hdfs:///shared")) == "hdfs:///shared"


def test_a_cluster_without_either_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session("yarn"))


def test_a_local_session_gets_a_folder():
    assert ensure_checkpoint_dir(session("local[2]"))
