"""The checkpoint-folder rule: use the cluster's shared folder; a local
temporary folder only for a local session without one; never on a cluster."""

import pytest

from regionpanel.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _RemoteSession:
    """A session without a SparkContext on this side (remote session)."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext on a remote session")


def test_shared_folder_is_used_when_set():
    s = _RemoteSession({"spark.checkpoint.dir": "/shared/ckpt", "spark.master": "yarn"})
    assert checkpoint_dir(s) == "/shared/ckpt"


def test_local_session_without_folder_gets_a_temporary_one():
    s = _RemoteSession({"spark.master": "local[4]"})
    first = checkpoint_dir(s)
    assert first and checkpoint_dir(s) == first


def test_cluster_without_folder_refuses_local_scratch():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_RemoteSession({"spark.master": "yarn"}))


def test_classic_session_uses_its_configured_folder(spark):
    assert checkpoint_dir(spark)          # the test session names one in spark.checkpoint.dir
