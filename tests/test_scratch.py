from __future__ import annotations

from types import SimpleNamespace

import pytest

from quillon import scratch


def session(master: str, folder: str | None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=f"app {master}"))


def test_a_cluster_has_to_name_its_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_folder(session(master, None))
        assert scratch.shared_folder(session(master, "file:///shared/")) == "file:///shared"
    own = scratch.shared_folder(session("local[2]", None))
    assert own == scratch.shared_folder(session("local[2]", None)) and own.startswith("file://")
    assert scratch.new_path(session("yarn", "s3a://b/c"), "x").startswith("s3a://b/c/x-")
