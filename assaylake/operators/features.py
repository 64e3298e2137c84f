"""Features of texts, computed once for each distinct text.

Featurising a text (hashing all its n-grams, running a dictionary of patterns
over it) costs far more than moving it once, and corpora are full of copies.
So texts are addressed by their content, a SHA-256 key:

* :func:`by_content` brings each distinct text together by its key, computes
  its features there, and joins them back to the rows;
* :class:`FeatureTable` keeps features between queries under the settings they
  were made with: a request computes only texts that no earlier one has seen
  (an anti-join on the key) and appends them. A request whose texts are all
  known reads the texts for their keys and computes nothing else.

``compute`` maps ``(key, text)`` to ``(key, features...)``, one row a text,
and must depend on the text alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.keys import qcol
from assaylake.session import cut_lineage, ensure_checkpoint_dir
from assaylake.sources import cache

KEY = "__text_key"
Compute = Callable[[DataFrame], DataFrame]


def content_key(text):
    """Key of a text; a NULL text has a key of its own."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("-"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(qcol(id_col), content_key(qcol(text_col)).alias(KEY))


def _distinct(df: DataFrame, text_col: str) -> DataFrame:
    """``(key, text)`` of each distinct text: one exchange by key, which the features' own grouping reuses."""
    texts = df.select(content_key(qcol(text_col)).alias(KEY), qcol(text_col).alias("text"))
    return texts.dropDuplicates([KEY])


def by_content(df: DataFrame, id_col: str, text_col: str, compute: Compute) -> DataFrame:
    """``(id, features...)`` of every row, computed once for each distinct text."""
    found = compute(_distinct(df, text_col))
    return _keyed(df, id_col, text_col).join(found, KEY).drop(KEY)


class FeatureTable:
    """Features kept in a folder, addressed by text and settings.

    ``settings`` must name everything the features depend on beside the text;
    another setting is another folder. Each request that meets new texts
    appends one part, which exists once its manifest does (see
    :mod:`assaylake.sources.cache`). Two requests at once may both compute a
    text; readers take one of the equal rows.
    """

    def __init__(self, spark, base: str | None, name: str, settings: dict[str, Any], compute: Compute):
        told = json.dumps(settings, sort_keys=True, default=str)
        base = base or f"{ensure_checkpoint_dir(spark).rstrip('/')}/features"
        self.folder = f"{base}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"
        self.spark, self.compute = spark, compute

    def known(self) -> DataFrame | None:
        """``(key, features...)`` of all texts met so far."""
        parts = cache.parts(self.spark, self.folder)
        if not parts:
            return None
        files = [f for p in parts for f in p["files"]]
        schema = cache.schema_of(parts[0])
        if not files:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(*files)
        return out if len(parts) == 1 else out.dropDuplicates([KEY])

    def add(self, df: DataFrame, text_col: str) -> None:
        """Compute the features of the texts that are new, and append them."""
        known = self.known()
        if known is not None:
            keys = df.select(content_key(qcol(text_col)).alias(KEY)).distinct()
            new = keys.join(known.select(KEY), KEY, "left_anti")
            if new.isEmpty():
                return
            df = df.withColumn(KEY, content_key(qcol(text_col))).join(
                known.select(KEY), KEY, "left_anti").drop(KEY)
        cache.write_part(self.spark, f"{self.folder}/part-{uuid.uuid4().hex}", self.compute(_distinct(df, text_col)))

    def of(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``(id, features...)`` of every row, written once; new texts are computed now, others are looked up."""
        known = self.known()
        if known is not None:
            found = cut_lineage(_keyed(df, id_col, text_col).join(known.withColumn("__hit", F.lit(True)), KEY, "left"))
            if found.where("__hit IS NULL").isEmpty():
                return found.drop(KEY, "__hit")
        self.add(df, text_col)
        return cut_lineage(_keyed(df, id_col, text_col).join(self.known(), KEY)).drop(KEY)
