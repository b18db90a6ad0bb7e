"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import checkpointed, shared_dir

__all__ = ["checkpointed", "fold", "hash_sample", "sample_rate", "shared_dir", "table", "whole_groups", "written"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table; all of them if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the held-out split of the labelled operators.

    A null id falls into fold -1, which no split holds out or learns from by name.
    """
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(folds), F.lit(-1)).cast("int")


def sample_rate(rows: int, wanted: int) -> float:
    """The share of ``rows`` that gives about ``wanted`` of them."""
    return 1.0 if rows <= wanted else wanted / rows


def hash_sample(df: DataFrame, key: str, rate: float, seed: int = 7) -> DataFrame:
    """The rows whose key hashes below ``rate``: the same rows on every run and retry."""
    if rate >= 1.0:
        return df
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(unit < rate)


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, in no more than ``files`` files.

    A table of known size is broadcast where it is small, and its small files are read together.
    """
    folder = f"{shared_dir(df.sparkSession)}/written-{uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Columns of rows whose equal first values (numbers) stand together, in parts of whole groups, and the places where groups begin.

    At most a batch and one group are held.
    """
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        both = b if held is None else pa.concat_batches([held, b])
        value = both.column(0).to_numpy()
        other = np.flatnonzero(value != value[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield both.slice(0, last).columns, np.flatnonzero(np.r_[True, value[1:last] != value[: last - 1]])
        held = both.slice(last)
    if held is not None:
        yield held.columns, np.zeros(1, np.int64)
