"""SimHash near-duplicates: segment-popcount embedding, grid join, exact check, components.

A 64-bit fingerprint is embedded as the bit counts of its ``SEGMENTS`` segments (twice as many for very many fingerprints). The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so it is a
lower bound to search by. Two integer points within distance 2 have a grid point within distance 1
of both: each fingerprint is entered in the grid cells of its radius-1 ball (1 + 2 x SEGMENTS rows
instead of the 545 of a radius-2 probe), and fingerprints that meet in a cell are compared bit by
bit. A crowded cell (over ``CROWD`` distinct fingerprints, as with thousands of edited copies) is
not compared pair by pair: its fingerprints are linked exactly through shared *Hamming* midpoints
(x and y differ in at most 2 bits iff some word differs from both in at most 1), which costs 65
rows a fingerprint whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEGMENTS = 16
#: Beyond so many distinct fingerprints segments are half as long: 65 cells a fingerprint instead of 33, but 2^48
#: likely embeddings instead of 2^32, so that cells of unrelated fingerprints stay small.
FEW = 1 << 27
CROWD = 64
SEED = 42
#: Fixed value: what white space is for this operator (space, and tab to carriage return).
WORD_SEPARATORS = "\t\n\v\f\r"


def words(text: str) -> list[str]:
    """Lower-cased (A-Z only) maximal runs without space, tab, line feed, VT, FF or CR."""
    t = text.translate(_FOLD)
    return [w for w in t.split(" ") if w]


_FOLD = common.LOWER | {ord(c): " " for c in WORD_SEPARATORS}


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Brute-force free function: 64-bit SimHash of a text's word shingles (none: 0)."""
    import xxhash

    w = words(text) if text else []
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(" ".join(w[i : i + width]), SEED) for i in range(n)), np.uint64, n)
    return int(bit_majority(h))


def bit_majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of ``h``."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row; null or wordless text has fingerprint 0. Rows with a null id are kept."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for big in batches:
            for b in common.byte_slices(big, "text", 8 << 20):
                out = np.zeros(b.num_rows, np.uint64)
                for r, text in enumerate(b.column(1).to_pylist()):
                    w = words(text) if text else []
                    if not w:
                        continue
                    if len(w) <= width:
                        grams = [" ".join(w)]
                    else:
                        grams = map(" ".join, zip(*(w[i:] for i in range(width)), strict=False))
                    out[r] = bit_majority(np.array([digest(g, SEED) for g in grams], np.uint64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ball_cells(fp: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """(n, 1 + 2 x segments) cell keys: the embedding itself and one step up or down each axis.

    A cell's key is a sum of per-axis hashes, so that a step changes one term. Equal keys of
    different cells only make needless comparisons.
    """
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(len(fp), segments, 64 // segments).sum(axis=2).astype(np.int64) + 1
    with np.errstate(over="ignore"):
        table = _mix((np.arange(segments, dtype=np.uint64)[:, None] * np.uint64(97) + np.arange(64 // segments + 3, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        axis = np.arange(segments)
        own = table[axis, counts]
        total = own.sum(axis=1, dtype=np.uint64)[:, None]
        up = total - own + table[axis, counts + 1]
        down = total - own + table[axis, counts - 1]
    return np.concatenate([total, up, down], axis=1)


def _cells(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                fp = b.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
                c = ball_cells(fp.view(np.uint64), segments)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64).ravel()), pa.array(np.repeat(fp, c.shape[1]))], ["cell", "fp"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, fp). Small runs: links from the first fp of each group
    that hangs together by verified pairs to the others;
    crowded runs: every fp with a null partner. Holds one batch and at most CROWD carried rows."""
    cell0, kept, crowded = None, np.empty(0, np.uint64), False

    def settle(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        while (wider := near @ near).sum() > near.sum():  # who can be reached over verified links
            near = wider
        first = near.argmax(axis=1)
        i = np.flatnonzero(first != np.arange(len(fps)))
        return fps[first[i]], fps[i]

    for b in batches:
        cell = b.column(0).to_numpy(zero_copy_only=False)
        fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(cell):
            continue
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts = np.concatenate([[0], cuts])
        stops = np.concatenate([cuts, [len(cell)]])
        left, right, alone = [], [], []
        # the first run may go on from the last batch, and the last may go on in the next
        many = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(cell)))
        for k in many:
            s, e = starts[k], stops[k]
            run = fp[s:e]
            if s == 0 and cell0 is not None:
                if cell[0] == cell0:
                    if crowded:
                        alone.append(run)
                        run = run[:0]
                    else:
                        run = np.concatenate([kept, run])
                else:
                    if not crowded and len(kept) > 1:
                        p, q = settle(kept)
                        left.append(p)
                        right.append(q)
                    crowded = False
            elif s:
                crowded = False
            if len(run) > CROWD:
                alone.append(run)
                crowded, run = True, run[:0]
            if e == len(cell):
                cell0, kept = cell[-1], run
            elif len(run) > 1:
                p, q = settle(run)
                left.append(p)
                right.append(q)
        yield _links(left, right, alone)
    if not crowded and len(kept) > 1:
        p, q = settle(kept)
        yield _links([p], [q], [])


def _links(left: list, right: list, alone: list) -> pa.RecordBatch:
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    a, b, c = cat(left), cat(right), cat(alone)
    src = pa.array(np.concatenate([a, c]).view(np.int64))
    dst = pa.array(np.concatenate([b, np.zeros(len(c), np.uint64)]).view(np.int64), mask=np.arange(len(a) + len(c)) >= len(a))
    return pa.RecordBatch.from_arrays([src, dst], ["src", "dst"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in batches:
        for at in range(0, b.num_rows, 10_000):
            fp = b.column(0).slice(at, 10_000).to_numpy(zero_copy_only=False).view(np.uint64)
            m = fp[:, None] ^ flips[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64).ravel()), pa.array(np.repeat(fp, 65).view(np.int64))], ["mid", "fp"])


def links(distinct_fp: DataFrame) -> DataFrame:
    """(src, dst) fingerprint links (at most 2 bits apart) whose components are those of all such pairs."""
    spark = distinct_fp.sparkSession
    common.ship(spark)
    segments = SEGMENTS if distinct_fp.count() <= FEW else 2 * SEGMENTS
    grid = distinct_fp.select("fp").mapInArrow(_cells(segments), "cell long, fp long")
    met = grid.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_compare, "src long, dst long")
    met = common.written(met, "simhash-links")
    pairs = met.where("dst is not null").distinct()
    crowd = met.where("dst is null").select(F.col("src").alias("fp")).distinct()
    mid = crowd.mapInArrow(_midpoints, "mid long, fp long")
    hub = mid.groupBy("mid").agg(F.min("fp").alias("src"), F.max("fp").alias("top")).where("src < top").select("mid", "src")
    star = mid.join(hub, "mid").where("fp <> src").select("src", F.col("fp").alias("dst")).distinct()
    return pairs.union(star)


def grouped(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (id, fp and any others) with component_id and label.

    component_id is the smallest id reachable over links, itself included; several components can have
    one if an id is repeated, whereas label is a component's own. Equal fingerprints are one vertex, so groups of
    copies of any size cost one row each. Null ids belong to their fingerprint's component but never
    name it. Empty in, empty out.
    """
    fps = common.written(fps, "simhash-fp")
    vertex = common.written(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-vertex")
    label = connected_components(links(vertex))  # node, label: of fingerprints that have links
    owned = vertex.join(label, vertex.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    best = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    named = owned.join(best, "label").select("fp", "component_id", "label")
    return fps.join(named, "fp").select(*fps.columns, "component_id", "label")


def components(fps: DataFrame) -> DataFrame:
    """(id, fp, component_id) of the rows of ``fps``, as :func:`grouped` finds them."""
    return grouped(fps).select("id", "fp", "component_id")
