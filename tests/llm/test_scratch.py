"""Tables of a block of work go at its end, also if it fails, and those of other threads stay."""

import threading
from pathlib import Path
from urllib.parse import urlparse

import pytest

from waymark.llm.common import CLEANUP, materialize, scratch


def test_tables_go_with_their_block(spark):
    outside = materialize(spark.range(3))
    seen = {}

    def other():
        seen["other"] = materialize(spark.range(4))

    with scratch(spark):
        first = materialize(spark.range(5))
        paths = first.inputFiles()
        with scratch(spark):
            inner = materialize(spark.range(6), read_once=True)
            files = inner.inputFiles()
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert first.count() == 5
    with pytest.raises(ValueError), scratch(spark):
        failed = materialize(spark.range(7))
        lost = failed.inputFiles()
        raise ValueError
    assert not any(Path(urlparse(p).path).exists() for p in [*paths, *files, *lost])
    assert outside.count() == 3 and seen["other"].count() == 4
    assert spark.conf.get(CLEANUP) == "false"
