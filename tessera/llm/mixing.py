"""Language-model scores by online logistic context mixing.

A token is coded as bits: the prefix code (:class:`Code`) of the kind of document that the words so far point to
leads through binary nodes to a unit, which is one of the ``UNITS`` most frequent words, or a group of rarer words
alike in count and kind of document, or that of rarer words that the document had before, or that of words never seen.
Each bit is predicted from several hashed contexts: the node alone (which knows the kind), with the last word, with
the last two words, and, over the document so far, by itself. The predictions are combined in the logistic domain by weights that a gate selects, and refined by an adaptive probability map. Weights and map start as learned from the corpus and move, chunk by chunk of a document, towards what its
bits turned out to be; a score doesn't depend on other documents to be scored, nor a bit's probability on itself.

What is left of a rarer word is its share of its group's tokens, or of the document's. A word never seen is spelled:
its bytes are coded bit by bit from hashed contexts of the last 1, 2, 3 and 5 bytes and the word so far, mixed and refined in
the same way (:class:`Speller`).

Everything learned is gathered from all training texts. Words are counted with the kind of document they are
found in (an expectation-maximisation step over all documents, which starts from a fit to how often two words of a
document go together, summed over all of them). The counts are exact, shuffled, and only joined; broadcast are ``UNITS`` words, code tables, and the slots of
hashed contexts, whose number follows the square root of the corpus up to a bound. Weights and maps are learned
where the texts lie, from documents and words that the slots leave out until then, and averaged.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

END = b"\n"  # the end of a text as a token; no word holds a line feed
#: Words that are units of their own: the most frequent ones, seen ``LEAST_COUNT`` times at least. All units fit 16 bits, one number to spare.
UNITS = 65_000
LEAST_COUNT = 8
KINDS = 6
#: Kinds are told apart by the counts of so many cells of words, dealt by hash, so that no word is left out.
CELLS = 512
CELL_ROWS = 16  # of the sums of pairs of cells, sent together
CELL_TEXTS = 256  # counted by cell at a time
LONG = 4_096  # bytes of a word whose cell comes from its checksum
#: One in so many training documents teaches weights before it is counted.
TUNING = 16
DELTA = 0.4
PULL = 100.0  # a kind's counts lean on those of all documents with so many tokens
OWN_PULL = 2.0  # and a document's own counts of a node on its kind's
PREDICTORS = 5  # with a constant
SURE = 12.0  # log odds of a prediction at most, so that its probability stays within single precision
LEVELS, SEEN = 3, 4  # a gate: how deep a node lies, how often the document came by before
GATES = LEVELS * SEEN
BUCKETS = 17
SPREAD = 8.0  # the map covers log odds of -8 to 8
OWN_BITS = 11  # slots of a document's own contexts
RATE, CALM, MAP_CALM = 1.0, 30.0, 60.0
MOST_SHIFT = 2.0
GROWTH = 1.3  # chunks of a document: the next ends at this many times the tokens
FIRST_CHUNKS = (4, 8, 12, 18)
GROUP_TOKENS = 20_000  # tokens side by side
SPAN_TOKENS = 50_000  # and of those that are longer at a time
MOST_CHUNK = 8_192
TASK_TOKENS = 10_000_000
PART = 1 << 10
BLOCK_BYTES = 2 << 20
HELD_ROWS = 600_000  # counts that a task merges before it sends them
OTHER = 65_535  # stands for a word that isn't a unit of its own
SPELL_SLICE = 1 << 15


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, split at space, tab, LF, VT, FF and CR; no end token."""
    return text.encode().lower().split() if text else []


def parts_of(text: str | None, size: int = 1 << 22) -> Iterator[str]:
    """Consecutive parts of a text of about ``size`` characters, cut at white space (else not at all), so that a long
    text's tokens needn't be listed all at once."""
    text = text or ""
    start = 0
    while len(text) - start > size:
        m = _SPACE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of about ``limit`` in size, one item at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, stop)
        at = stop


class Refined:
    """Weights and map of each gate, in use and while they are learned."""

    def __init__(self, gates: int, predictors: int, levels: int):
        self.weights = np.full((predictors, gates), 0.25, np.float32)
        self.map = np.tile((1 / (1 + np.exp(-np.linspace(-SPREAD, SPREAD, BUCKETS)))).astype(np.float32), (levels, 1))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.map.ravel()]).astype(float)

    def set(self, values: np.ndarray) -> None:
        n = self.weights.size
        self.weights = values[:n].reshape(self.weights.shape).astype(np.float32)
        self.map = values[n:].reshape(self.map.shape).astype(np.float32)


def mean_of(rows: DataFrame) -> np.ndarray | None:
    """Mean by ``weight`` of the arrays ``values``, summed up by place; None without rows."""
    got = rows.select("weight", F.posexplode("values").alias("at", "x")).groupBy("at").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x")).collect()
    return np.array([r.x for r in sorted(got)]) if got else None


def slot_bits(total: int) -> int:
    return int(min(24, max(16, math.ceil(0.5 * math.log2(max(2, total))) + 6)))


def slot_counts(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], slots: int, tasks: int) -> DataFrame:
    """(part, counts): zeros and ones by turns of ``PART`` slots. Every task adds up its own counts in an array and sends
    it in parts, which are summed part by part; a sum takes as many parts of some kilobytes as there are tasks, which are
    bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * slots, np.int32)
        count(batches, seen)
        parts = seen.reshape(-1, 2 * PART)
        for some in np.array_split(np.flatnonzero(parts.any(axis=1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some.tolist()], pa.binary())], ["part", "counts"])
        del seen, parts
        common.trim()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * PART, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    return rows.coalesce(tasks).mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")


def summed_slots(counts: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretched prediction in 1/15, class of how often seen) of each slot, from rows of :func:`slot_counts`."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((PART, 2), np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64).reshape(PART, 2)
        seen = total.sum(axis=1)
        st = np.clip(np.rint(np.log((total[:, 1] + DELTA) / (total[:, 0] + DELTA)) * 15), -120, 120).astype(np.int8)
        sure = ((seen > 0).astype(np.int8) + (seen >= 4) + (seen >= 64)).astype(np.int8)
        return pa.table([table.column("part").slice(0, 1), pa.array([st.tobytes()], pa.binary()), pa.array([sure.tobytes()], pa.binary())], names=["part", "st", "sure"])

    sums = counts.groupBy("part").applyInArrow(add, "part int, st binary, sure binary").toArrow()
    out, sure = np.zeros((slots // PART, PART), np.int8), np.zeros((slots // PART, PART), np.int8)
    for at, a, b in zip(sums.column("part").to_pylist(), sums.column("st"), sums.column("sure"), strict=True):
        out[at], sure[at] = np.frombuffer(a.as_buffer(), np.int8), np.frombuffer(b.as_buffer(), np.int8)
    return out.ravel(), sure.ravel()


# --- kinds of documents ---


def cell_of(words: pa.Array) -> np.ndarray:
    """The cell of each word: the upper bits of a polynomial hash of its bytes, or its checksum if over ``LONG`` bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    first, size = ends[:-1], np.diff(ends)
    if len(far := np.flatnonzero(size > LONG)):
        out = np.empty(len(words), np.int64)
        near = np.flatnonzero(size <= LONG)
        out[near] = cell_of(words.take(pa.array(near)))
        out[far] = [zlib.crc32(words[i].as_buffer()) % CELLS for i in far.tolist()]
        return out
    flat = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    first = first - ends[0]
    with np.errstate(over="ignore"):
        flat *= np.cumprod(np.full(int(size.max()), _M)).take(np.arange(len(flat)) - np.repeat(first, size))
        known = np.add.reduceat(flat, first)  # no word is empty
        known ^= known >> np.uint64(32)
        known *= _M
    return (known >> np.uint64(32)).astype(np.int64) % CELLS


def cell_pairs(x: np.ndarray) -> np.ndarray:
    """How often two tokens of a text fall in two cells, summed over texts (rows of counts by cell): of each text all
    ordered pairs of its tokens, weighed so that they come to as many as it has tokens."""
    size = x.sum(axis=1)
    x = x[size > 1] / np.sqrt(size[size > 1] - 1.0)[:, None]
    y = x.astype(np.float32)
    return (y.T @ y).astype(float)


class Kinds:
    """Kinds of documents: a mixture of distributions over cells of words.

    It is fitted on ``pairs``, the sums of :func:`cell_pairs` over the texts to learn from (or those of ``texts``), by
    expectation maximisation: two tokens of a text share its kind, and nothing else. A cell's pairs with itself, mostly
    one word that a text repeats, are left to the model."""

    def __init__(self, texts: list[list[bytes]] = (), pairs: np.ndarray | None = None, rounds: int = 200):
        if pairs is None:
            pairs = cell_pairs(np.stack([self.vector(t) for t in texts])) if texts else np.zeros((CELLS, CELLS))
        pairs = pairs.copy()
        np.fill_diagonal(pairs, 0.0)
        mass = pairs.sum(axis=1)
        whole = (mass + 1) / (mass + 1).sum()
        rows = (pairs + whole) / (mass + 1)[:, None]
        # spread out: each start is a cell's row of pairs that the former fit worst
        centre, own = [], (rows * np.log(rows)).sum(axis=1)
        far = mass * (own - rows @ np.log(whole))
        for _ in range(KINDS):
            centre.append((rows[int(np.argmax(far))] + whole) / 2)
            far = np.minimum(far, mass * (own - rows @ np.log(centre[-1])))
        p, w = np.stack(centre), np.full(KINDS, 1 / KINDS)
        for _ in range(rounds if mass.any() else 0):
            ratio = pairs / (p.T @ (w[:, None] * p))
            np.fill_diagonal(ratio, 1.0)
            g = w[:, None] * p * (p @ ratio)
            w = (g.sum(axis=1) + 1) / (g.sum() + KINDS)
            p = g + 20 * whole
            p /= p.sum(axis=1, keepdims=True)
        self.log_p, self.log_w = np.log(p), np.log(w)

    def vector(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(cell_of(pa.array(words, pa.binary())), minlength=CELLS).astype(np.float32)

    def of(self, block: Block) -> np.ndarray:
        """The likeliest kind of each text of a block."""
        return np.concatenate([(x @ self.log_p.T + self.log_w).argmax(axis=1) for x in block.cells()])


class Block:
    """The tokens of a few texts (null: empty), each with its end, as numbers of the block's distinct words."""

    def __init__(self, texts: list[str | None]):
        flat: list[bytes] = []
        held, size = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for part in parts_of(t):
                own = tokens(part)
                flat += own
                size[i] += len(own)
                if len(flat) > 1 << 20:
                    held.append(pa.array(flat, pa.binary()))
                    flat = []
            flat.append(END)
            size[i] += 1
        coded = pa.chunked_array([*held, pa.array(flat, pa.binary())]).dictionary_encode().unify_dictionaries().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.size, self.first = size, np.cumsum(size) - size

    def found(self, words: pa.Array) -> np.ndarray:
        """For each of the block's words its place in ``words``, or -1."""
        return pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False)

    def cells(self) -> Iterator[np.ndarray]:
        """How many words of each text, without its end, are in each cell, a few texts at a time."""
        cell = cell_of(self.words)
        codes = np.delete(self.codes, self.first + self.size - 1)
        ends = np.append(0, np.cumsum(self.size - 1))
        for at in range(0, len(self.size), CELL_TEXTS):
            n = min(CELL_TEXTS, len(self.size) - at)
            doc = np.repeat(np.arange(n), self.size[at : at + n] - 1)
            yield np.bincount(doc * CELLS + cell[codes[ends[at] : ends[at + n]]], minlength=n * CELLS).reshape(n, CELLS)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``BLOCK_BYTES`` of text."""
    for b in batches:
        yield from common.byte_slices(b, "text", BLOCK_BYTES)


def start_kinds(texts: DataFrame) -> Kinds:
    """Kinds fitted on all rows of ``texts`` (text). Every task adds up the pairs of cells of its own texts, and sends
    the upper half in parts of ``CELL_ROWS`` rows, which are summed part by part."""
    common.ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CELLS, CELLS))
        for b in blocks(batches):
            for x in Block(b.column(0).to_pylist()).cells():
                sums += cell_pairs(x)
        common.trim()
        if sums.any():
            at = range(0, CELLS, CELL_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([sums[i : i + CELL_ROWS, i:].tobytes() for i in at], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    got = texts.mapInArrow(count, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").toArrow()
    pairs = np.zeros((CELLS, CELLS))
    for at, x in zip(got.column("part").to_pylist(), got.column("sums"), strict=True):
        pairs[at : at + CELL_ROWS, at:] = np.frombuffer(x.as_buffer()).reshape(CELL_ROWS, -1)
    return Kinds(pairs=np.triu(pairs) + np.triu(pairs, 1).T)


def word_counts(texts: DataFrame, kinds: Kinds) -> DataFrame:
    """(word binary, n, kind, by_kind) over all rows of ``texts`` (text), with one end token a row: how often, in
    which kind of document most (ties: the first), and in each."""
    common.ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> list[pa.RecordBatch]:
            sums = pa.concat_tables(held).group_by(["word", "kind"], use_threads=False).aggregate([("n", "sum")]).select(["word", "kind", "n_sum"]).rename_columns(["word", "kind", "n"])
            return sums.combine_chunks().to_batches()

        for b in blocks(batches):
            block = Block(b.column(0).to_pylist())
            n = np.bincount(block.codes * np.int64(KINDS) + np.repeat(kinds.of(block), block.size), minlength=len(block.words) * KINDS)
            used = np.flatnonzero(n)
            held.append(pa.table([block.words.take(pa.array(used // KINDS)), pa.array((used % KINDS).astype(np.int32)), pa.array(n[used])], names=["word", "kind", "n"]))
            size += len(used)
            if size > HELD_ROWS:
                yield from flush()
                held, size = [], 0
                common.trim()
        if held:
            yield from flush()
        held = []
        common.trim()

    rows = texts.mapInArrow(count, "word binary, kind int, n long")
    by_kind = F.array(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)) for i in range(KINDS)])
    sums = rows.groupBy("word").agg(F.sum("n").alias("n"), by_kind.alias("by_kind"))
    return sums.select("word", "n", (F.array_position("by_kind", F.array_max("by_kind")) - 1).cast("int").alias("kind"), "by_kind")


# --- the code ---


def _huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: the root) and bit of each leaf, as numbered, and each inner node, numbered after them."""
    n = len(weights)
    heap = list(zip(weights.tolist(), range(n), strict=True))
    heapq.heapify(heap)
    parent, bit = np.full(2 * n - 1, -1, np.int64), np.zeros(2 * n - 1, np.int64)
    for up in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = up
        bit[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], up))
    return parent, bit


class Code:
    """For each kind of document a prefix code of the units, and what the counts alone say about its nodes.

    ``by_kind`` (units, KINDS) has the tokens of each unit; a kind's counts are smoothed by those of all. ``steps`` are
    the paths, node * 2 + bit, of which a unit has ``size`` from ``first`` on."""

    def __init__(self, by_kind: np.ndarray):
        units = len(by_kind)
        weight = by_kind.sum(axis=1)
        share = (weight + 1) / (weight.sum() + units)
        mass = by_kind.sum(axis=0)
        self.size, self.first = np.zeros((KINDS, units), np.int64), np.zeros((KINDS, units), np.int64)
        steps, inner, at = [], max(1, units - 1), 0
        self.plain, self.level = np.zeros(KINDS * inner, np.float32), np.zeros(KINDS * inner, np.int64)
        for k in range(KINDS):
            n = by_kind[:, k] + PULL * share
            parent, bit = _huffman(n)
            now, way = np.arange(units), []
            while (live := parent[now] >= 0).any():
                way.append(np.where(live, (parent[now] - units + k * inner) * 2 + bit[now], -1))
                now = np.where(live, parent[now], now)
            way = np.stack(way, axis=1) if way else np.empty((units, 0), np.int64)
            there = way >= 0
            self.size[k] = there.sum(axis=1)
            self.first[k] = at + np.cumsum(self.size[k]) - self.size[k]
            own = way[there]
            steps.append(own.astype(np.int32))
            at += len(own)
            seen = np.bincount(own - 2 * k * inner, np.repeat(n, self.size[k]), 2 * inner).reshape(-1, 2)
            part = slice(k * inner, (k + 1) * inner)
            self.plain[part] = np.clip(np.log((seen[:, 1] + 1e-9) / (seen[:, 0] + 1e-9)), -SURE, SURE)
            total = seen.sum(axis=1) / max(1.0, n.sum())
            self.level[part] = np.where(total >= 0.1, 0, np.where(total >= 0.01, 1, 2))
        self.steps = np.concatenate(steps)
        self.log_p = np.log((by_kind + 20 * share[:, None]) / (mass + 20)).astype(np.float32)
        self.log_w = np.log((mass + 1) / (mass.sum() + KINDS))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x * np.uint32(0x297A2D39)


def chunk_bounds(longest: int) -> np.ndarray:
    """Places at which chunks of a document end."""
    out = [*FIRST_CHUNKS]
    while out[-1] < longest:
        out.append(min(math.ceil(out[-1] * GROWTH), out[-1] + MOST_CHUNK))
    return np.array(out)


def spans(docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of whole chunks, of about ``SPAN_TOKENS`` tokens over all documents, so that long ones are walked
    with bounded memory."""
    size = np.array([len(d) for d in docs])
    longest, begin, end = int(size.max(initial=0)), 0, 0
    for bound in chunk_bounds(longest).tolist():
        if end > begin and (np.minimum(size, bound) - np.minimum(size, begin)).sum() > SPAN_TOKENS:
            yield begin, end
            begin = end
        end = bound
        if end >= longest:
            break
    yield begin, end


class Events:
    """The bits of a few documents' tokens from ``begin`` to ``end``, chunk by chunk and in a chunk document by document, and
    their contexts. Without ``whole``, in any order, and only the contexts that are counted in the corpus."""

    def __init__(self, code: Code, bits: int, docs: list[np.ndarray], begin: int, end: int, known: np.ndarray, whole: bool = True):
        live = np.flatnonzero([len(d) > begin for d in docs])
        cut = [docs[i][begin:end] for i in live]
        size = np.array([len(d) for d in cut], np.int64)
        unit = np.concatenate(cut).astype(np.int64)
        first = np.cumsum(size) - size
        doc = np.repeat(live, size)
        place = np.arange(len(unit)) - np.repeat(first, size) + begin
        one, two = np.zeros(len(unit), np.uint32), np.zeros(len(unit), np.uint32)
        one[1:] = unit[:-1]
        one[1:] += np.uint32(1)
        one[first] = [docs[i][begin - 1] + 1 if begin else 0 for i in live]
        two[1:] = one[:-1]
        two[first] = [docs[i][begin - 2] + 1 if begin > 1 else 0 for i in live]
        chunk = np.searchsorted(chunk_bounds(end), place, side="right").astype(np.uint16)
        # the kind that a document's finished chunks point to; ``known`` has the sums of those before this span
        starts = np.flatnonzero((np.diff(chunk, prepend=0) != 0) | (place == begin))
        sums = np.add.reduceat(code.log_p[unit], starts, axis=0, dtype=np.float64)
        own = np.flatnonzero(place[starts] == begin)
        runs = np.diff(np.append(own, len(starts)))
        before = np.cumsum(sums, axis=0) - sums
        before += np.repeat(known[live] - before[own], runs, axis=0)
        known[live] += np.add.reduceat(sums, own, axis=0)
        kind = np.repeat((before + code.log_w).argmax(axis=1), np.diff(np.append(starts, len(unit))))
        if whole:
            order = np.argsort(chunk, kind="stable")
            chunk = chunk[order]
            unit, doc, one, two, kind = unit[order], doc[order], one[order], two[order], kind[order]
        cell = kind * code.size.shape[1] + unit
        n = code.size.take(cell)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]))
        at += np.repeat(code.first.take(cell) - (ends - n), n)
        step = code.steps.take(at)
        self.node, self.bit = step >> 1, (step & 1).astype(np.float32)
        node = self.node.astype(np.uint32) * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - bits)
        one *= np.uint32(0x85EBCA77)
        self.last = (_mixed(node + np.repeat(one, n)) >> shift).astype(np.int64)
        self.level = code.level.take(self.node)
        self.upper = np.flatnonzero(self.level < 2)  # further down, pairs of words are too rare to tell anything
        two = np.repeat(one + two * np.uint32(0xC2B2AE3D) + np.uint32(1), n)
        self.pair = (_mixed(node[self.upper] + two[self.upper]) >> shift).astype(np.int64)
        self.pair += 1 << bits
        if whole:
            self.doc = np.repeat(doc, n)
            self.starts = np.concatenate([[0], ends])[np.append(np.flatnonzero(np.diff(chunk.astype(np.int32), prepend=-1)), len(unit))]
            self.own = (self.doc << OWN_BITS) + (_mixed(node) >> np.uint32(32 - OWN_BITS))


class Model:
    """Predicts the bits of documents, which are arrays of units."""

    def __init__(self, code: Code, bits: int, slots: np.ndarray, sure: np.ndarray):
        self.code, self.bits = code, bits
        self.slots = np.rint(slots * (sure / 3.0)).astype(np.int8)  # a slot hardly seen says little
        self.start = Refined(GATES, PREDICTORS, LEVELS)

    def known(self, e: Events) -> np.ndarray:
        """Inputs that don't depend on the document's own counts (rows; row 3 is left empty)."""
        x = np.empty((PREDICTORS, len(e.node)), np.float32)
        x[0] = self.code.plain.take(e.node)
        np.multiply(self.slots.take(e.last), np.float32(1 / 15), out=x[1])
        x[2] = 0
        x[2, e.upper] = self.slots.take(e.pair) * np.float32(1 / 15)
        x[4] = 0.3
        return x

    def _chunks(self, docs: list[np.ndarray], kinds: np.ndarray) -> Iterator[tuple]:
        for begin, end in spans(docs):
            e = Events(self.code, self.bits, docs, begin, end, kinds)
            x = self.known(e)
            for a, b in zip(e.starts, e.starts[1:], strict=False):
                if a < b:
                    yield e, x, e.level, a, b

    def walk(self, docs: list[np.ndarray], learn: Refined | None = None, rate: float = 0.0) -> np.ndarray:
        """Natural log probability of each document's bits. Documents go side by side, chunk by chunk; each
        has a shift of the gated weights, a map and counts of its own, which its finished chunks move.

        With ``learn``, the gated weights and the map are those, moved by all documents, and no document has its own."""
        n_docs = len(docs)
        seen = np.zeros(2 * n_docs << OWN_BITS, np.float32)  # zeros and ones of each slot
        gated = (learn or self.start).weights
        shift = np.zeros((PREDICTORS, n_docs), np.float32)
        table = self.start.map[None].repeat(n_docs, axis=0) if learn is None else learn.map
        flat, fresh = table.reshape(-1), table.reshape(-1).copy()
        hits = np.zeros((2, flat.size))
        out, kinds = np.zeros(n_docs), np.zeros((n_docs, KINDS))
        for e, x, level, a, b in self._chunks(docs, kinds):
            doc, bit, own = e.doc[a:b], e.bit[a:b], 2 * e.own[a:b]
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            each, count = doc[begin], np.diff(np.append(begin, b - a))
            p = 1 / (1 + np.exp(-x[0, a:b]))
            zero, one = seen.take(own), seen.take(own + 1)
            n = zero + one
            gate = level[a:b] * SEEN + (n > 0) + (n > 3) + (n > 15)
            x[3, a:b] = np.log((one + OWN_PULL * p) / (zero + OWN_PULL * (1 - p)))
            s = np.zeros(b - a, np.float32)
            for k in range(PREDICTORS):
                w = gated[k].take(gate)
                if learn is None:
                    w += np.repeat(shift[k, each], count)
                w *= x[k, a:b]
                s += w
            np.clip(s, 0.01 - SPREAD, SPREAD - 0.01, out=s)
            p = 1 / (1 + np.exp(-s))
            err = bit - p
            # refine: the mean of what is mixed and what the map makes of it
            s += np.float32(SPREAD)
            s *= np.float32((BUCKETS - 1) / (2 * SPREAD))
            low = s.astype(np.int64)
            s -= low
            low += level[a:b] * BUCKETS
            if learn is None:
                low += doc * (LEVELS * BUCKETS)
            left, right = flat.take(low), flat.take(low + 1)
            p += left + s * (right - left)
            p = np.abs(1 - bit - 0.5 * p)
            out[each] += np.add.reduceat(np.log(np.maximum(p, np.float32(1e-6))), begin, dtype=np.float64)
            # learn from the chunk
            for k in range(PREDICTORS):
                pull = err * x[k, a:b]
                if learn is None:
                    moved = shift[k, each] + RATE * np.add.reduceat(pull, begin) / (count + CALM)
                    shift[k, each] = np.clip(moved, -MOST_SHIFT, MOST_SHIFT)
                else:  # no further than a quadratic bound of the loss allows
                    steep = np.bincount(gate, np.square(x[k, a:b]), GATES) * (PREDICTORS / 4)
                    gated[k] += rate * np.bincount(gate, pull, GATES) / (steep + CALM)
            low += s >= 0.5
            hits[0] += np.bincount(low, minlength=flat.size)
            hits[1] += np.bincount(low, bit, flat.size)
            flat[:] = (fresh * MAP_CALM + hits[1]) / (MAP_CALM + hits[0])
            np.add.at(seen, own + bit.astype(np.int64), np.float32(1))
        return out


def walk_all(docs: list[np.ndarray], walk: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Groups of documents alike in length, each document whole."""
    size = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(size, kind="stable")
    out = np.zeros(len(docs))
    for s in slices(size[order], GROUP_TOKENS):
        out[order[s]] = walk([docs[i] for i in order[s]])
    return out


# --- spelling ---

ORDERS = (1, 2, 3, 5)
SPELLINGS = len(ORDERS) + 1  # and the word so far
_PAD = bytes(5) + b" "
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to code (flat; a space ends each word), context hashes (bytes, predictors), where each word begins."""
    parts = [w + b" " for w in words]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join([_PAD + p for p in parts]), np.uint8)
    first = np.cumsum(sizes + len(_PAD)) - sizes
    at = np.arange(sizes.sum()) + np.repeat(len(_PAD) * np.arange(1, len(parts) + 1), sizes)
    out = np.empty((len(at), SPELLINGS), np.uint64)
    with np.errstate(over="ignore"):
        known = np.zeros(len(at), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            known = (known + flat[at - back].astype(np.uint64) + np.uint64(1)) * _M
            if back in ORDERS:
                out[:, ORDERS.index(back)] = known + np.uint64(back)
        power = np.cumprod(np.full(len(flat), _M))
        sums = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power)
        inverse = np.cumprod(np.full(len(flat), _M_INVERSE))
        start = np.repeat(first, sizes)
        out[:, -1] = (sums[at - 1] - sums[start - 1]) * inverse[start - 1]
    return flat[at], out, np.cumsum(sizes) - sizes


def _spelled(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, slots (bits, predictors), each predictor in its own range, and the first bit of each word."""
    values, contexts, start = _contexts(words)
    v = values.astype(np.uint32)[:, None]
    j = np.arange(8, dtype=np.uint32)
    node = ((np.uint32(1) << j) | (v >> (np.uint32(8) - j))) * np.uint32(0x9E3779B1)
    bit = ((v >> (np.uint32(7) - j)) & np.uint32(1)).astype(np.float32)
    short = (contexts >> np.uint64(32)).astype(np.uint32)
    x = _mixed(short[:, None, :] + node[:, :, None])
    slot = (x >> np.uint32(32 - bits)).astype(np.int64) + (np.arange(SPELLINGS) << bits)
    return bit.ravel(), slot.reshape(-1, SPELLINGS), start * 8


def spelled_parts(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words as they are spelled, and which word each belongs to: one of over ``SPELL_SLICE`` bytes in parts of
    that size, each like a word of its own."""
    if max(map(len, words), default=0) <= SPELL_SLICE:
        return words, np.arange(len(words))
    parts = [(w[at : at + SPELL_SLICE], i) for i, w in enumerate(words) for at in range(0, max(1, len(w)), SPELL_SLICE)]
    return [p for p, _ in parts], np.array([i for _, i in parts])


class Speller:
    """Probabilities of words that are spelled; frozen once learned, as each word stands alone."""

    gates = 12

    def __init__(self, bits: int, slots: np.ndarray, sure: np.ndarray):
        self.bits, self.slots, self.sure = bits, slots, sure
        self.start = Refined(self.gates, SPELLINGS + 1, self.gates)

    def _mix(self, words: list[bytes]) -> tuple:
        bit, slot, start = _spelled(words, self.bits)
        x = np.empty((SPELLINGS + 1, len(bit)), np.float32)
        for k in range(SPELLINGS):
            x[k] = self.slots[slot[:, k]] * np.float32(1 / 15)
        x[-1] = 0.3
        gate = 3 * self.sure[slot[:, -1]].astype(np.int64) + np.tile([0, 1, 1, 1, 2, 2, 2, 2], len(bit) // 8)
        s = np.clip((self.start.weights[:, gate] * x).sum(axis=0), -SPREAD + 0.01, SPREAD - 0.01)
        cell = (s + SPREAD) * ((BUCKETS - 1) / (2 * SPREAD))
        return bit, x, gate, s, cell, start

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word."""
        parts, of = spelled_parts(words)
        out = np.zeros(len(parts))
        for s in slices(np.array([len(w) + 1 for w in parts]), SPELL_SLICE) if parts else ():
            bit, _, gate, mix, cell, start = self._mix(parts[s])
            low = cell.astype(np.int64)
            part = cell - low
            p = 0.5 / (1 + np.exp(-mix)) + 0.5 * (self.start.map[gate, low] * (1 - part) + self.start.map[gate, low + 1] * part)
            p = np.clip(p, 1e-5, 1 - 1e-5)
            out[s] = np.add.reduceat(np.log(np.where(bit > 0, p, 1 - p)), start)
        return np.bincount(of, out, len(words))

    def learn(self, words: list[bytes], rate: float) -> None:
        """One online step: predict a few words' bits, then move weights and map towards them."""
        bit, x, gate, s, cell, _ = self._mix(words)
        err = bit - 1 / (1 + np.exp(-s))
        n = np.bincount(gate, minlength=self.gates)
        for k in range(SPELLINGS + 1):
            self.start.weights[k] += rate * np.bincount(gate, err * x[k], self.gates) / np.maximum(n, 20)
        near = gate * BUCKETS + np.rint(cell).astype(np.int64)
        seen = np.bincount(near, minlength=self.start.map.size)
        want = np.bincount(near, bit, self.start.map.size) / np.maximum(seen, 1)
        pull = np.minimum(0.3, seen / 600)
        self.start.map += (pull * (want - self.start.map.ravel())).reshape(self.start.map.shape).astype(np.float32)


def learn_speller(once: DataFrame, n_once: int) -> Speller:
    """From the words seen once, each standing for one never seen: seven in eight fill the slots while the others teach
    the weights, where they lie; then those are counted too."""
    spark = once.sparkSession
    bits = min(22, slot_bits(8 * n_once))
    tuning = F.pmod(F.xxhash64("word"), F.lit(8)) == 0

    def count(batches: Iterator[pa.RecordBatch], seen: np.ndarray) -> None:
        for b in batches:
            words = spelled_parts(b.column(0).to_pylist())[0]
            for s in slices(np.array([len(w) + 1 for w in words]), SPELL_SLICE):
                bit, slot, _ = _spelled(words[s], bits)
                np.add.at(seen, (2 * slot + bit[:, None].astype(np.int64)).ravel(), np.int32(1))

    tasks = max(1, min(1 << 14, n_once // 500_000))
    counts = common.written(slot_counts(once.where(~tuning).select("word"), count, SPELLINGS << bits, tasks), "spelling-counts", codec="zstd")
    sent = spark.sparkContext.broadcast(summed_slots(counts, SPELLINGS << bits))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, n = Speller(bits, *sent.value), 0
        for b in batches:
            words = spelled_parts(b.column(0).to_pylist())[0]
            for s in slices(np.array([len(w) + 1 for w in words]), 1000):
                n += 1
                speller.learn(words[s], 2.0 / (1 + n / 40))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([speller.start.flat().tolist()])], ["weight", "values"])

    taught = mean_of(once.where(tuning).select("word").mapInArrow(teach, "weight double, values array<double>"))
    sent.destroy()
    out = Speller(bits, *summed_slots(counts.union(slot_counts(once.where(tuning).select("word"), count, SPELLINGS << bits, max(1, tasks // 8))), SPELLINGS << bits))
    if taught is not None:
        out.start.set(taught)
    common.forget(counts)
    return out


# --- the corpus ---


def code_of(counts: DataFrame) -> tuple[Code, dict]:
    """The code of a table of :func:`word_counts`, and what scoring needs beside it: ``words`` and their ``n`` (units
    in order), ``groups`` ((kind, class of count) -> unit and tokens), the units ``again`` and ``spelled``, ``total``
    and ``distinct``.

    A group's weight is that of the tokens that would be in it if their own were not counted, so that what is
    seen once weighs for what is not seen at all. To the driver come ``UNITS`` words at most and a few rows for
    each kind and class of counts."""
    total, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0])
    many = counts.where(F.col("n") >= LEAST_COUNT)
    fine = F.floor(F.log2("n") * 8).cast("int")
    floor, so_far = 1 << 30, 0  # under the counts of the most frequent words
    for r in sorted(many.groupBy(fine.alias("fine")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.fine):
        floor, so_far = r.fine, so_far + r.words
        if so_far >= UNITS:
            break
    top = many.where(fine >= floor).orderBy(F.desc("n"), "word").limit(UNITS).collect()
    last = (int(top[-1].n), bytes(top[-1].word)) if len(top) == UNITS else (LEAST_COUNT, None)
    is_unit = F.col("n") >= LEAST_COUNT if last[1] is None else (F.col("n") > last[0]) | ((F.col("n") == last[0]) & (F.col("word") <= F.lit(bytearray(last[1]))))
    size = lambda n: F.floor(F.log2(n)).cast("int")
    rest = counts.where(~is_unit)
    held = {(r.kind, r.size): int(r.n) for r in rest.groupBy("kind", size("n").alias("size")).agg(F.sum("n").alias("n")).collect()}
    own = [F.sum(F.col("by_kind")[i]).alias(f"k{i}") for i in range(KINDS)]
    weight = {(r.kind, r.size): np.array(r[2:], np.int64) for r in rest.where("n > 1").groupBy("kind", size(F.col("n") - 1).alias("size")).agg(*own).collect()}
    once = np.array([x or 0 for x in rest.where("n = 1").agg(*own).collect()[0]], np.int64)
    none = np.zeros(KINDS, np.int64)
    groups = sorted(held)
    table = np.array([*[r.by_kind for r in top], *[weight.get(k, none) for k in groups], sum(weight.values(), once) // 4, once], np.int64).reshape(-1, KINDS)
    found = {
        "words": [bytes(r.word) for r in top], "n": np.array([r.n for r in top], np.int64), "groups": {k: (len(top) + i, held[k]) for i, k in enumerate(groups)},
        "again": len(table) - 2, "spelled": len(table) - 1, "total": total, "distinct": distinct, "once": int(once.sum()),
    }
    return Code(table), found


class Groups:
    """Units of rarer words and their shares, by count and kind."""

    def __init__(self, rest: dict):
        self.unit = np.full((KINDS, 64), rest["spelled"], np.uint16)
        self.log_total = np.zeros((KINDS, 64))
        for (k, s), (unit, total) in rest["groups"].items():
            self.unit[k, s], self.log_total[k, s] = unit, math.log(total)
        self.spelled = rest["spelled"]

    def of(self, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of words of these counts, and the log of their shares of the groups (0 if spelled)."""
        size = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        unit = np.where(n > 0, self.unit[kind, size], np.uint16(self.spelled)).astype(np.uint16)
        return unit, np.where(unit == self.spelled, 0.0, np.log(np.maximum(n, 1)) - self.log_total[kind, size])


def encode(units: list[np.ndarray], rare: list[np.ndarray], learnable: np.ndarray, n: np.ndarray, kind: np.ndarray, new: list[bytes], rest: dict, speller: Speller) -> tuple:
    """(n_tokens, n_known, base, spelt, units, places, instead) of a block's texts, arrays and lists by text.

    ``units`` have ``OTHER`` where a word isn't a unit of its own; those words follow in ``rare``, as numbers into ``n`` and
    ``kind``; ``new`` are the words without a count, in order. ``instead`` are the units, at ``places``, that a learnable text's
    rarer words would have were its own tokens not counted."""
    groups = Groups(rest)
    unit, open_ = groups.of(n, kind)
    open_[n == 0] = speller.log_prob(new)
    log_n = lambda c: np.log10((c + 0.1) / (rest["total"] + 0.1 * (rest["distinct"] + 1)))
    n_docs, size = len(units), np.array([len(u) for u in units], np.int64)
    flat, doc = np.concatenate(units), np.repeat(np.arange(n_docs), size)
    at = np.flatnonzero(flat == OTHER)
    own, of = np.concatenate(rare).astype(np.int64), doc[at]
    # how often a word came before in its text, and comes in all
    order = np.argsort(of * max(1, len(n)) + own, kind="stable")
    run = np.flatnonzero(np.diff((of * max(1, len(n)) + own)[order], prepend=-1))
    length = np.diff(np.append(run, len(order)))
    before, mine = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    before[order] = np.arange(len(order)) - np.repeat(run, length)
    mine[order] = np.repeat(length, length)
    count = np.bincount(of, minlength=n_docs)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    again = before > 0
    spelt = np.bincount(of, np.where(again, np.log(np.maximum(before, 1) / np.maximum(place, 1)), open_[own]), n_docs)
    known = size - np.bincount(of, n[own] == 0, n_docs).astype(np.int64)
    plain = np.append(log_n(rest["n"]), 0.0)
    base = np.bincount(doc, plain[np.minimum(flat, len(plain) - 1)], n_docs) + np.bincount(of, log_n(n)[own], n_docs)
    flat = flat.copy()
    flat[at] = np.where(again, np.uint16(rest["again"]), unit[own])
    left = groups.of(np.maximum(n[own] - mine, 0), kind[own])[0]
    moved = np.flatnonzero(learnable[of] & ~again & (left != unit[own]))
    first = np.cumsum(size) - size
    cuts = np.searchsorted(of[moved], np.arange(n_docs + 1))
    places, instead = (at[moved] - first[of[moved]]).astype(np.uint32), left[moved]
    ends = first + size
    return (
        size, known, base, spelt, [flat[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)],
        [places[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], [instead[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)],
    )


def coded_texts(src: DataFrame, counts: DataFrame, rest: dict, speller: Speller) -> DataFrame:
    """(id, learnable, tuning, n_bytes, n_tokens, n_known, base, spelt, units, places, instead) of rows (id, text,
    learnable): units as 16-bit numbers, the log probability of all that units leave open, and see :func:`encode`.

    Texts are read in blocks where they lie. A block's texts, and its words that aren't units of their own, are written
    to one table, so that whichever attempt of a task is kept, its blocks are whole; a join gives the words' counts, and
    texts and words meet again by block."""
    spark = src.sparkSession
    own_units = spark.sparkContext.broadcast(rest["words"])
    sent = spark.sparkContext.broadcast(({k: v for k, v in rest.items() if k != "words"}, speller))
    kind = dict(src.dtypes)["id"]
    names = ["block", "local", "word", "id", "learnable", "tuning", "n_bytes", "units", "rare"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, known = TaskContext.get().partitionId() << 32, pa.array(own_units.value, pa.binary())
        for number, b in enumerate(blocks(batches)):
            texts = b.column(b.schema.get_field_index("text"))
            block = Block(texts.to_pylist())
            unit = (block.found(known) & OTHER).astype(np.uint16)  # -1 becomes OTHER
            other = np.flatnonzero(unit == OTHER)
            local = np.zeros(len(unit), np.uint32)
            local[other] = np.arange(len(other))
            flat = unit[block.codes]
            rare = local[block.codes[flat == OTHER]]
            ends = np.cumsum(block.size)
            cuts = np.concatenate([[0], np.cumsum(flat == OTHER)])[np.concatenate([[0], ends])]
            none = lambda n, t: pa.nulls(n, t)
            n, m = b.num_rows, len(other)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task + number)), pa.array(np.arange(m, dtype=np.int32)), block.words.take(pa.array(other)), none(m, b.schema.field("id").type), none(m, pa.bool_()), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.binary()), none(m, pa.binary())], names)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, task + number)), none(n, pa.int32()), none(n, pa.binary()), *(b.column(b.schema.get_field_index(c)) for c in ("id", "learnable", "tuning")),
                pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array([flat[e - k : e].tobytes() for e, k in zip(ends.tolist(), block.size.tolist(), strict=True)], pa.binary()),
                pa.array([rare[x:y].tobytes() for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.binary()),
            ], names)
        block = texts = flat = rare = None
        common.trim()

    tuning = F.coalesce(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(TUNING)) == 0, F.lit(False))
    table = src.select("id", "text", "learnable", tuning.alias("tuning")).mapInArrow(cut, f"block long, local int, word binary, id {kind}, learnable boolean, tuning boolean, n_bytes long, units binary, rare binary")
    table = common.written(table, "token-blocks", codec="zstd")
    words = table.where("local is not null").select("word", "block", "local").join(counts.select("word", "n", "kind"), "word", "left")
    words = words.select(F.col("block").alias("of"), "local", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kind", F.lit(0)).alias("kind"), F.when(F.col("n").isNull(), F.col("word")).alias("new"))
    texts = table.where("units is not null").select("block", "id", "learnable", "tuning", "n_bytes", "units", "rare")

    def meet(docs: pa.Table, found: pa.Table) -> pa.Table:
        rest, speller = sent.value
        local = found.column("local").to_numpy()
        n, kind = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        n[local], kind[local] = found.column("n").to_numpy(), found.column("kind").to_numpy()
        new = dict(zip(local.tolist(), found.column("new").to_pylist(), strict=True))
        learnable = docs.column("learnable").to_numpy(zero_copy_only=False).astype(bool)
        raw = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in docs.column(c)]
        out = encode(raw("units", np.uint16), raw("rare", np.uint32), learnable, n, kind, [new[i] for i in np.flatnonzero(n == 0).tolist()], rest, speller)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([*(docs.column(c) for c in ("id", "learnable", "tuning", "n_bytes")), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["id", "learnable", "tuning", *CODED, "places", "instead"])

    coded = texts.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(meet, f"id {kind}, learnable boolean, tuning boolean, n_bytes long, n_tokens long, n_known long, base double, spelt double, units binary, places binary, instead binary")
    out = common.written(coded, "coded-texts", codec="zstd")
    own_units.destroy()
    sent.destroy()
    common.forget(table)
    return out


CODED = ["n_bytes", "n_tokens", "n_known", "base", "spelt", "units"]


def _units(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _left_out(b: pa.RecordBatch) -> list[np.ndarray]:
    """Units of texts to learn from: those of words that their own text made known are replaced."""
    out = []
    for units, places, instead in zip(_units(b.column(0)), b.column(1), _units(b.column(2)), strict=True):
        units = units.copy()
        units[np.frombuffer(places.as_buffer(), np.uint32)] = instead
        out.append(units)
    return out


def learn_model(coded: DataFrame, code: Code, total: int) -> tuple[Model, Callable[[], Model]]:
    """The model, and a small function that makes it in a worker. Weights and map are learned on one training text in
    ``TUNING``, where they lie in one or more passes, and averaged by the number of steps, with the context counts of
    the others; then those texts are counted too, so that a score has the counts of all. Code and slots, the large
    parts, are broadcast, once and twice."""
    spark = coded.sparkSession
    bits = slot_bits(total)
    train = coded.where("learnable")
    sent = spark.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch], seen: np.ndarray) -> None:
        for b in batches:
            docs = _left_out(b)
            for s in slices(np.array([len(d) for d in docs]), GROUP_TOKENS):
                kinds = np.zeros((len(docs[s]), KINDS))
                for begin, end in spans(docs[s]):
                    e = Events(sent.value, bits, docs[s], begin, end, kinds, whole=False)
                    bit = e.bit.astype(np.int64)
                    np.add.at(seen, 2 * e.last + bit, np.int32(1))  # of the same type, else it takes many times as long
                    np.add.at(seen, 2 * e.pair + bit[e.upper], np.int32(1))

    tasks = max(1, min(1 << 14, total // TASK_TOKENS))
    counts = common.written(slot_counts(train.where("not tuning").select("units", "places", "instead"), count, 2 << bits, tasks), "slot-counts", codec="zstd")
    others = spark.sparkContext.broadcast(summed_slots(counts, 2 << bits))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start, n = Model(sent.value, bits, *others.value), Refined(GATES, PREDICTORS, LEVELS), 0
        for b in batches:
            docs = _left_out(b)
            size = np.array([len(d) for d in docs])
            for again in range(max(1, min(8, 100_000 // max(1, int(size.sum()))))):  # short batches several times
                for s in slices(size, GROUP_TOKENS // 3):
                    n += 1
                    model.walk(docs[s], learn=start, rate=2.0 / (1 + n / 200))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([start.flat().tolist()])], ["weight", "values"])

    start = Refined(GATES, PREDICTORS, LEVELS)
    taught = mean_of(train.where("tuning").select("units", "places", "instead").mapInArrow(teach, "weight double, values array<double>"))
    if taught is not None:
        start.set(taught)
    others.destroy()
    filled = spark.sparkContext.broadcast(summed_slots(counts.union(slot_counts(train.where("tuning").select("units", "places", "instead"), count, 2 << bits, max(1, tasks // TUNING))), 2 << bits))
    common.forget(counts)

    def make() -> Model:
        model = Model(sent.value, bits, *filled.value)
        model.start = start
        return model

    return make(), make


def score_texts(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from rows where ``learnable`` holds. Scores are log10 probabilities of the token sequence
    (lower-cased words and one end). Null text is empty and has no bits per byte; null ids and repeated rows are kept.
    """
    spark = docs.sparkSession
    common.ship(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(learnable, F.lit(False)).alias("learnable"))
    texts = src.where("learnable").select("text")
    counts = common.written(word_counts(texts, start_kinds(texts)), "word-counts")
    code, rest = code_of(counts)
    common.release(spark)
    coded = coded_texts(src, counts, rest, learn_speller(counts.where("n = 1"), rest["once"]))
    _, make = learn_model(coded, code, rest["total"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(walk_all(_units(b.column(b.num_columns - 1)), model.walk))], ["id", *CODED[:-1], "mixed"])

    kind = dict(src.dtypes)["id"]
    out = coded.select("id", *CODED).mapInArrow(score, f"id {kind}, n_bytes long, n_tokens long, n_known long, base double, spelt double, mixed double")
    nats = F.col("mixed") + F.col("spelt")
    return out.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", "n_known", F.lit(rest["total"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (nats / math.log(10)).alias("score"), F.when(F.col("n_bytes") > 0, -nats / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
