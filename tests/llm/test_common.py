"""What the operators share."""

from types import SimpleNamespace

import pytest

from prosemill.llm import common


def session(folder, master):
    context = SimpleNamespace(master=master, applicationId=f"test-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, otherwise: folder), sparkContext=context)


def test_the_shared_folder():
    assert common.shared_dir(session("s3://x/y", "spark://h:1")) == "s3://x/y"
    for master in ("local", "local[4]"):
        made = common.shared_dir(session(None, master))
        assert made.startswith("file:///") and common.shared_dir(session(None, master)) == made
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(None, master))
