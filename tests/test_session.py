"""The shared checkpoint folder: taken from the session; a machine-local
fallback only in local mode."""

import pytest

from panelkit.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def getConf(self):
        return _Conf({})

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.sparkContext = _Ctx(master, ckpt)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used_as_is():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://nn/ckpt"
    assert ensure_checkpoint_dir(_Session("k8s://x", ckpt="s3a://b/c")) == "s3a://b/c"


def test_local_mode_falls_back_to_a_temp_folder():
    d = ensure_checkpoint_dir(_Session("local[2]"))
    assert d and "panelkit-ckpt-" in d
