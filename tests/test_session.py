"""The shared folder comes from the session; only a local application may have one of its own."""

import os
from types import SimpleNamespace

import pytest

from leadlens.session import shared_dir


def application(name, master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" and folder else default),
        sparkContext=SimpleNamespace(master=master, applicationId=name),
    )


def test_shared_dir():
    assert shared_dir(application("a", "spark://x", "s3://bucket/run")) == "s3://bucket/run"
    own = shared_dir(application("b", "local[2]"))
    assert os.path.isdir(own) and shared_dir(application("b", "local[2]")) == own != shared_dir(application("c", "local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(application("d", "spark://x"))
