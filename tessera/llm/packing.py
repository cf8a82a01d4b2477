"""Sum-of-squares packing of token sequences.

Every document becomes one or more pieces of at most ``capacity`` tokens. A piece goes to the
bin gap that makes the sum of squares of the counts of open bins per residual gap smallest.
Pieces are dealt at random (by a hash of their identity) to groups of about ``GROUP`` pieces that
are packed apart, each with memory for its own lengths only; a group leaves a handful of bins
partly filled, so the loss does not grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import SLICE_BYTES, encoder

GROUP = 40_000


def sum_of_squares(lengths: np.ndarray, capacity: int, open_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, packing longest first (ties: by position).

    Placing length s in a bin of gap g changes the sum by 1 - 2 n(g) for the gap that it leaves
    and by 1 + 2 n(g - s) for the gap that it makes; full and unopened bins do not count. With
    ``open_first`` a new bin is opened only where no open one has room.
    """
    n_open = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    cost_in = np.zeros(capacity + 1, np.int64)  # 1 + 2 n(g), 0 for a full bin
    cost_in[1:] = 1
    cost_out = np.full(capacity + 1, 1 << 40, np.int64)  # 1 - 2 n(g) where a bin is open, 0 for a new bin
    cost_out[capacity] = 0
    made = 0

    def changed(g: int) -> None:
        if 0 < g < capacity:
            n = n_open[g]
            cost_in[g] = 1 + 2 * n
            cost_out[g] = 1 - 2 * n if n else 1 << 40

    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        cost = cost_out[s:] + cost_in[: capacity + 1 - s]
        # of equal costs the tightest gap
        g = s + int(np.argmin(cost))
        if open_first and g == capacity and s < capacity:
            best = int(np.argmin(cost[:-1]))
            g = s + best if cost[best] < 1 << 39 else g
        if g == capacity:
            b, made = made, made + 1
        else:
            b = stacks[g].pop()
            n_open[g] -= 1
            changed(g)
        bins[i], offsets[i] = b, capacity - g
        rest = g - s
        if rest:
            stacks[rest].append(b)
            n_open[rest] += 1
            changed(rest)
    return bins, offsets


def fewest_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing with new bins at any time, or only where nothing open has room, whichever
    takes fewer bins (ties: the former)."""
    ways = [sum_of_squares(lengths, capacity, way) for way in (False, True)]
    return min(ways, key=lambda way: way[0].max(initial=-1))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): a document's ids, then ``end_id``, cut only where longer
    than ``capacity``; then the first piece is the short one. Null text: the end id alone."""
    common.ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for big in batches:
            for b in common.byte_slices(big, "text", SLICE_BYTES):
                rows, piece, start, length, crc = [], [], [], [], []
                for r, text in enumerate(b.column(1).to_pylist()):
                    ids = enc.ids(text).astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    at, k = 0, 0
                    stop = n % capacity or capacity
                    while at < n:
                        rows.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * stop]))
                        at, stop, k = stop, stop + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(cut, f"id {dict(src.dtypes)['id']}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` (1 to ``capacity``).

    Rows are hashed with all their columns, so repeated rows may meet in a group; each is placed.
    An empty table gives an empty table. Deterministic: within a group rows are sorted first.
    """
    common.ship(cut.sparkSession)
    cut = common.written(cut, "pieces")
    total = cut.count()
    groups = max(1, -(-total // group))

    def place(rows: pa.Table) -> pa.Table:  # Arrow all the way, as pandas would make doubles of ids beside a null
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offset = fewest_bins(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array(rows["bin_group"][0].as_py() + groups * bins)).append_column("offset", pa.array(offset))

    deal = F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(groups)).cast("int")
    src = cut.select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32", deal.alias("bin_group"))
    out = src.groupBy("bin_group").applyInArrow(place, f"id {dict(src.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, bin_group int, sequence_id long, offset long")
    return out.drop("bin_group").withColumnRenamed("id", id_col)
