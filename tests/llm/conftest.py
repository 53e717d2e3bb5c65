from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark(spark, tmp_path_factory):
    """The shared session, with a checkpoint folder of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


def documents(spark, texts, first=0):
    """A documents table; ids count up, the language turns."""
    rows = [(first + i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or ""))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
