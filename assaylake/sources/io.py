"""Readers and writers for assay tables.

TSV is the workflow's hand-over format: header row, no index, empty field =
missing. Schemas are declared, never inferred (inference turns a column that
holds the text ``nan`` into a string). NaN is mapped to NULL on read, so the
rest of the library only ever sees SQL NULL as "missing".
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.session import ensure_checkpoint_dir
from assaylake.sources.delimited import read_delimited


# The words that data-frame CSV readers take for a missing number.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _dialect(fmt: str) -> dict[str, str]:
    """Options shared by reader and writer: fields with a separator, a quote or
    a line end are quoted, quotes inside are doubled, outer blanks stay."""
    return {"sep": "\t" if fmt == "tsv" else ",", "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _nan_to_null(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _from_text(f: T.StructField, missing: Sequence[str]):
    """A number column read as text: missing words are NULL, other text that is no number raises."""
    c = F.col(f"`{f.name}`")
    value = c.try_cast(f.dataType)
    bad = F.raise_error(F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), c)).cast(f.dataType)
    return (F.when(c.isNull() | F.trim(c).isin(list(missing)), F.lit(None).cast(f.dataType))
            .when(value.isNull(), bad).otherwise(value).alias(f.name))


def read_assay(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
               fmt: str = "tsv", missing: Sequence[str] = MISSING_WORDS, multi_line: bool = True) -> DataFrame:
    """Read an assay table (``tsv``, ``csv``, ``parquet`` or ``json``).

    In delimited files the words in ``missing`` are NULL in number columns; an
    empty text is NULL. Files are read in splits by many tasks, texts with
    line ends included (:mod:`assaylake.sources.delimited`); ``multi_line=False``
    saves counting the quotes first where no text holds a line end.
    """
    if fmt in ("tsv", "csv"):
        if schema is None:
            raise ValueError("declare the schema of a delimited file")
        declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        as_text = [isinstance(f.dataType, T.NumericType) for f in declared.fields]
        read = T.StructType([T.StructField(f.name, T.StringType() if t else f.dataType)
                             for f, t in zip(declared.fields, as_text)])
        if multi_line:
            df = read_delimited(spark, path, read, _dialect(fmt))
        else:
            df = spark.read.schema(read).options(header="true", mode="FAILFAST", **_dialect(fmt)).csv(path)
        df = df.select(*[_from_text(f, missing) if t else F.col(f"`{f.name}`")
                         for f, t in zip(declared.fields, as_text)])
    elif fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif fmt == "json":
        df = spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return _nan_to_null(df)


def write_assay(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "tsv",
                partition_by: Sequence[str] = ()) -> None:
    """Write with a header and no index. ``mode='ignore'`` = write-once cache.

    ``path`` is any Hadoop path (``file:``, ``s3a://``, ``gs://``, ...).
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt in ("tsv", "csv"):
        w.options(header="true", **_dialect(fmt)).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_folds(folds: DataFrame, path: str, mode: str = "overwrite",
                fold_col: str = "fold", fmt: str = "tsv") -> None:
    """All folds in one pass, one directory per fold (``fold=k``)."""
    write_assay(folds, path, mode=mode, fmt=fmt, partition_by=[fold_col])


def write_chat_jsonl(df: DataFrame, path: str, record_col: str = "record",
                     mode: str = "overwrite") -> None:
    """One JSON document per line; NULL struct fields are left out."""
    df.select(F.to_json(F.col(record_col)).alias("value")).write.mode(mode).text(path)


def prompt_path(base: str, k_target: int, k_external: int, stem: str = "records") -> str:
    """Output name carrying the retrieval settings."""
    return f"{base.rstrip('/')}/{stem}_top{k_target}target_{k_external}ext_train.jsonl"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def flatten_records(df: DataFrame, id_col: str, label_col: str,
                    endpoints: Sequence[str], id_alias: str | None = None) -> DataFrame:
    """``(x, {label: y})`` records -> one column per endpoint.

    ``label_col`` may be a map, a struct, or a JSON object string. Missing
    labels become NULL; an empty ``endpoints`` keeps only the id column.
    """
    dtype = df.schema[label_col].dataType
    lab = F.col(label_col)
    if isinstance(dtype, T.StringType):
        lab = F.from_json(lab, T.MapType(T.StringType(), T.DoubleType()))
        dtype = T.MapType(T.StringType(), T.DoubleType())
    cols = [F.col(id_col).alias(id_alias or id_col)]
    for e in endpoints:
        v = lab[e] if isinstance(dtype, T.MapType) else lab.getField(e)
        cols.append(v.cast("double").alias(e))
    return df.select(*cols)


def union_assays(*dfs: DataFrame, tags: Sequence[str] | None = None,
                 tag_col: str = "split") -> DataFrame:
    """Union by name, missing columns NULL, optional origin tag.

    Spark resolves names case-insensitively, so ``smiles`` and ``SMILES`` would
    merge into one column; a later table's column that clashes by case only is
    renamed ``{lower}_{tag}`` (or ``{lower}_{i}``) to keep both.
    """
    seen: dict[str, str] = {}
    out = None
    for i, df in enumerate(dfs):
        suffix = tags[i] if tags else str(i)
        renames = {}
        for c in df.columns:
            low = c.lower()
            if low in seen and seen[low] != c:
                renames[c] = f"{low}_{suffix}"
            else:
                seen.setdefault(low, c)
        if renames:
            df = df.withColumnsRenamed(renames)
        if tags:
            df = df.withColumn(tag_col, F.lit(tags[i]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
