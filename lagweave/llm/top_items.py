"""The N best items of every group.

Method. A secondary sort: rows are hash-partitioned by group and sorted within partitions by group, score and identifier;
Arrow batches stream past and the first N of each run go on. No group is buffered: the state is one key and one count.

Scale. The same cut is made before the shuffle, on each input partition's own sorted rows, so a group of any size sends
at most N rows per input task, and one task receives no more than that of a hot group. One shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions.keys import encode_key


def _first_n(key: str, n: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
            if keys[0].as_py() == last:
                end = starts[1] if len(starts) > 1 else len(codes)
                place[:end] += seen
            last, seen = keys[-1].as_py(), int(place[-1]) + 1
            out = batch.filter(pa.array(place < n))
            if out.num_rows:
                yield out

    return cut


def top_items(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, with all columns of df (select the needed ones first).

    order must be total for a consistent result: end it with an identifier. NULL is a group of its own. A group with fewer
    rows gives all of them; an empty table or n < 1 gives none.
    """
    key = "_group_key"
    while key in df.columns:
        key += "_"
    rows = df.withColumn(key, encode_key(F.col(group)))
    cut = _first_n(key, n)
    picked = rows.sortWithinPartitions(key, *order).mapInArrow(cut, rows.schema)
    return picked.repartition(key).sortWithinPartitions(key, *order).mapInArrow(cut, rows.schema).drop(key)
