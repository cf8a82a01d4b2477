"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
windows, and labels every byte of every text; a document's probabilities are the means over its
positions. Long texts are read in spans of ``SPAN`` bytes, each from a fresh state, side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN = 8
SPAN = 256
LANES = 4096
#: The model is fitted on at most so many labelled documents, as many of each language as there are (least
#: hashes first), one window of ``WINDOW`` characters from anywhere in each.
SAMPLE_DOCS = 4_000
WINDOW = 160
TRAIN_STEPS = 220
TRAIN_LANES = 192
TRAIN_SPAN = 40
UNKNOWN = "und"
REJECT_BELOW = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights have a leading axis of 2: forward and backward reading."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(labels)
        self.labels, self.hidden = labels, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),  # input weights by byte, gates z, r and the candidate
            "u": rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32),
            "c": np.zeros((2, hidden, 1), np.float32),  # the candidate's recurrent bias, inside its reset gate
            "o": rng.normal(0, 0.3, (2, n, hidden)).astype(np.float32),
            "b": np.zeros((n, 1), np.float32),
        }

    def train(self, data: np.ndarray, label: np.ndarray, steps: int, lanes: int, rate: float = 0.03, seed: int = 11) -> None:
        """Adam over minibatches of equally long windows (rows of bytes)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(data), lanes)
            start = rng.integers(0, data.shape[1] - TRAIN_SPAN + 1)
            grad = self.gradient(data[rows, start : start + TRAIN_SPAN], label[rows])[1]
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def gradient(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradient, through time."""
        p, H = self.p, self.hidden
        B, T = data.shape
        x = np.stack([data.T, data.T[::-1]])  # (2, T, B)
        a = np.stack([p["x"][d][x[d]] for d in (0, 1)]).transpose(0, 1, 3, 2)  # (2, T, 3H, B)
        h = np.zeros((2, H, B), np.float32)
        kept = []
        for t in range(T):
            g = p["u"] @ h
            zr = _sigmoid(a[:, t, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            q = g[:, 2 * H :] + p["c"]
            n = np.tanh(a[:, t, 2 * H :] + r * q)
            kept.append((h, z, r, q, n))
            h = n + z * (h - n)
        hs = np.stack([k[0] for k in kept[1:]] + [h])  # (T, 2, H, B) after each step
        lined = np.stack([hs[:, 0], hs[::-1, 1]], axis=1)  # both directions at each position
        logit = np.einsum("dlh,tdhb->tlb", p["o"], lined) + p["b"]
        logit -= logit.max(axis=1, keepdims=True)
        e = np.exp(logit)
        prob = e / e.sum(axis=1, keepdims=True)
        lane = np.arange(B)
        loss = float(-np.log(prob[:, label, lane] + 1e-12).mean())
        d_logit = prob
        d_logit[:, label, lane] -= 1
        d_logit /= T * B
        grad = {k: np.zeros_like(w) for k, w in p.items()}
        grad["b"] = d_logit.sum(axis=(0, 2))[:, None]
        grad["o"] = np.einsum("tlb,tdhb->dlh", d_logit, lined)
        d_lined = np.einsum("dlh,tlb->tdhb", p["o"], d_logit)
        d_hs = np.stack([d_lined[:, 0], d_lined[::-1, 1]], axis=1)
        back = np.zeros((2, H, B), np.float32)
        d_a = np.empty_like(a)
        for t in range(T - 1, -1, -1):
            h0, z, r, q, n = kept[t]
            dh = d_hs[t] + back
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h0 - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            d_g = np.concatenate([dz, dr, dn * r], axis=1)
            d_a[:, t, : 2 * H] = d_g[:, : 2 * H]
            d_a[:, t, 2 * H :] = dn
            grad["u"] += d_g @ h0.transpose(0, 2, 1)
            grad["c"] += d_g[:, 2 * H :].sum(axis=2, keepdims=True)
            back = dh * z + p["u"].transpose(0, 2, 1) @ d_g
        for d in (0, 1):
            np.add.at(grad["x"][d], x[d].ravel(), d_a[d].transpose(0, 2, 1).reshape(-1, 3 * H))
        return loss, grad

    def spans(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(labels, B): sums over positions of the label probabilities of rows of bytes (B, T), of
        which the first ``lengths`` count; rows come longest first."""
        p, H = self.p, self.hidden
        B, T = data.shape
        x = np.ascontiguousarray(data.T)
        live = np.searchsorted(-lengths, -np.arange(T), side="left")  # rows longer than t
        logit = np.empty((T, len(self.labels), B), np.float32)
        for d in (0, 1):
            table = np.ascontiguousarray(p["x"][d].T)
            table[: 2 * H] *= 0.5  # the gates' sigmoid as 0.5 + 0.5 tanh(x / 2)
            u = p["u"][d].copy()
            u[: 2 * H] *= 0.5
            h = np.zeros((H, B), np.float32)
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                k = live[t]
                if not k:
                    continue
                own = h[:, :k]
                a = table[:, x[t, :k]]
                g = u @ own
                zr = a[: 2 * H]
                zr += g[: 2 * H]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                q = g[2 * H :]
                q += p["c"][d]
                q *= zr[H:]
                q += a[2 * H :]
                np.tanh(q, out=q)
                own -= q
                own *= zr[:H]
                own += q
                if d == 0:
                    np.matmul(p["o"][0], own, out=logit[t, :, :k])
                    logit[t, :, :k] += p["b"]
                else:
                    logit[t, :, :k] += p["o"][1] @ own
        total = np.zeros((len(self.labels), B), np.float64)
        for t in range(T):
            k = live[t]
            if k:
                y = logit[t, :, :k]
                y -= y.max(axis=0)
                np.exp(y, out=y)
                y /= y.sum(axis=0)
                total[:, :k] += y
        return total

    def texts(self, texts: list[bytes], span: int = SPAN, lanes: int = LANES) -> np.ndarray:
        """(texts, labels) mean probabilities over all bytes; an empty text gets zeros."""
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // span)
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        start = np.repeat(first, parts) + span * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(span, np.repeat(first + sizes, parts) - start)
        flat = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(order), lanes):
            own = order[at : at + lanes]
            T = int(length[own[0]])
            data = flat[start[own][:, None] + np.arange(T)]
            np.add.at(out, owner[own], self.spans(data, length[own]).T)
        return out / np.maximum(sizes, 1)[:, None]


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> Network | None:
    """Train on at most ``sample`` rows where ``learnable`` holds and text and language aren't null.

    Every language with a text that has a letter gets an equal share of the sample (one row at least), so
    rare ones can be predicted too. Rows are taken by least hash of id and text, so the sample is the
    same for any partitioning. None if nothing can be learned from."""
    n = F.char_length(F.col("text"))
    at = F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), n - WINDOW + 1)).cast("int")
    src = docs.where(learnable).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = common.lowest_of_each(src.select(F.xxhash64("id", "text").alias("k"), F.substring("text", at, F.lit(WINDOW)).alias("window"), "lang"), "k", "lang", sample)
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    net = Network(labels)
    raw = [r.window.encode() for r in rows]
    width = max(TRAIN_SPAN, *map(len, raw))
    data = np.stack([np.resize(np.frombuffer(w, np.uint8), width) for w in raw])  # short windows repeat, none is cut
    net.train(data, np.array([labels.index(r.lang) for r in rows]), TRAIN_STEPS, TRAIN_LANES)
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def label_batch(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; ``und`` and 0 without a letter."""
    known = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if known:
        prob = net.texts([texts[i].encode() for i in known])
        best = prob.argmax(axis=1)
        score[known] = np.clip(prob[np.arange(len(known)), best], 0, 1)
        for i, k in zip(known, best.tolist(), strict=True):
            label[i] = net.labels[k]
    return label, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; null ids and repeated rows stay as they are."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in common.byte_slices(big, "text", 2 << 20):
                label, score = label_batch(net, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), pa.array(score)], ["id", "lang_pred", "score"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def filter_rows(docs: DataFrame, keep: Callable[[list], np.ndarray], text_col: str) -> DataFrame:
    """Rows (all columns, whatever their names) whose texts ``keep`` marks; in place, without a join."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            sized = big.rename_columns([f"c{i}" for i in range(big.num_columns)])
            for b in common.byte_slices(sized, f"c{at}", 2 << 20):
                marks = pa.array(keep(b.column(at).to_pylist()).astype(bool))
                yield pa.RecordBatch.from_arrays([pc.filter(c, marks) for c in b.columns], schema=b.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def keep_known(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """Drop documents without a language: no letter, or a score under ``least``."""

    def keep(texts: list) -> np.ndarray:
        label, score = label_batch(net, texts)
        return (np.array(label) != UNKNOWN) & (score >= least)

    return filter_rows(docs, keep, text_col)
