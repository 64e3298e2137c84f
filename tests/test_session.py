"""Intermediate tables are written to the folder the session names and dropped on demand."""

import os

from assaylake.session import cut_lineage, drop_intermediates, ensure_checkpoint_dir


def test_intermediates_are_dropped(spark):
    drop_intermediates(spark)
    base = ensure_checkpoint_dir(spark)
    assert base.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/")) or "shared" in base
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and drop_intermediates(spark) == 1
    local = base.removeprefix("file:")
    assert not os.path.isdir(f"{local}/tables") or os.listdir(f"{local}/tables") == []
    assert drop_intermediates(spark) == 0
