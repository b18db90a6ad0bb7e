from types import SimpleNamespace

import pytest

from tessera.storage import shared_dir


def session(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", "hdfs://host/shared/")) == "hdfs://host/shared"
    assert shared_dir(session("local[4]")).startswith("file:///")
