"""The N best items of every group by mergeable bounded heaps."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_id

#: Heap entries of a task before it hands them on.
HOLD = 1_000_000


def _best(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The heaps of a table of (group, item, score): per group the n items of greatest score, equal scores by item; and their positions."""
    rows = rows.group_by(["group", "item"]).aggregate([("score", "max")]).rename_columns({"score_max": "score"})
    rows = rows.take(pc.sort_indices(rows, [("group", "ascending"), ("score", "descending"), ("item", "ascending")])).combine_chunks()
    group = rows.column("group").combine_chunks()
    if isinstance(group, pa.ChunkedArray):
        group = pa.concat_arrays(group.chunks)
    new = np.concatenate(([True], pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False))) if len(group) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    pos = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    on = pos < n
    return rows.filter(pa.array(on)).select(["group", "item", "score"]), pos[on]


def _heaps(n: int, hold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < max(50_000, held.num_rows if held is not None else 0):
                continue
            held, _ = _best(pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches(waiting)]), n)
            waiting, size = [], 0
            if held.num_rows > hold:
                yield from held.to_batches()
                held = None
        if waiting or held is not None:
            held, _ = _best(pa.concat_tables(([held] if held is not None else []) + ([pa.Table.from_batches(waiting)] if waiting else [])), n)
            yield from held.to_batches()

    return run


def _last(n: int):
    """Heaps merged group by group: rows arrive sorted by group, so only the group that a batch breaks off is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            best, pos = _best(rows, n)
            yield from best.append_column("pos", pa.array(pos + 1, pa.int32())).to_batches()

        carry = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if carry is not None:
                rows = pa.concat_tables([carry, rows])
            if not rows.num_rows:
                continue
            final = pc.equal(rows.column("group"), rows.column("group")[-1])
            carry = rows.filter(final)
            if carry.num_rows > 4 * n:
                carry, _ = _best(carry, n)
            if (whole := rows.filter(pc.invert(final))).num_rows:
                yield from out(whole)
        if carry is not None:
            yield from out(carry)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, hold: int = HOLD) -> DataFrame:
    """Per group its n items of greatest score with their positions: group, pos (from 1), item, score.

    Equal scores come in the word order of the items. Of several rows of one group and item the greatest score counts.
    Every task keeps a heap of at most n items a group and hands on heaps only, so a group of any size crosses the
    exchange as n rows a task; the heaps are merged with the same comparison. Items fall out of a heap only for n better
    ones, which holds for merged heaps too.

    Rows with null or NaN score, null or blank group or item don't count; spaces at the ends of ids are trimmed; a group
    of fewer than n items comes out whole; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(clean_id(group).alias("group"), clean_id(item).alias("item"), F.col(score).cast("double").alias("score")).where("group is not null and item is not null and score is not null and not isnan(score)")
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))  # -0.0 becomes 0.0
    schema = "group string, item string, score double"
    heaps = rows.mapInArrow(_heaps(n, hold), schema)
    merged = heaps.repartition("group").sortWithinPartitions("group").mapInArrow(_last(n), schema + ", pos int")
    return merged.select("group", "pos", "item", "score")
