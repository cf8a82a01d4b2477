"""Token ids and token counts of whole texts with public tokenizer files.

``.json`` files are read with ``tokenizers``, ``.tiktoken`` files with ``tiktoken`` and
``.model`` files with ``sentencepiece``; which one is a matter of the path parameter.

A byte-level BPE file without a normaliser is run by ``tiktoken``'s engine over the file's own
vocabulary, several times as fast and with the same ids; texts that hold an added token's string
go to ``tokenizers`` itself. Its pieces never span a single space between two characters that
aren't white space other than at their start, so long texts are cut there (*safe boundaries*).
Any other kind of file gets each whole text in one call.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

#: Fixed value: the public split pattern of byte-level BPE vocabularies of this family.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1 << 16
SLICE_BYTES = 4 << 20

_SAFE = re.compile(r"\S(?= \S)")



def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stands for
    itself, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, cut only before a single space that stands
    between two characters that aren't white space. Without such a space there is one part."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start() + 1]
        start = m.start() + 1
    yield text[start:]


class Encoder:
    """Ids of texts for one tokenizer file; ``ids(text)`` are unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.special: list[str] = []
        self.whole = None
        plain = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text, num_threads=1)
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.whole = lambda text: tok.encode(text, add_special_tokens=False).ids
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            plain = self._byte_level(spec)
        self.plain = plain

    @staticmethod
    def _byte_level(spec: dict):
        """A fast encoder for a byte-level BPE file, else None. Ranks are the ids, as merges are listed
        in the order of the ids they make."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        import tiktoken

        to_byte = _byte_alphabet()
        added = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
        made = [model["vocab"].get(m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)) for m in model["merges"]]
        if sorted(ranks.values()) != list(range(len(ranks))) or made != list(range(len(ranks) - len(made), len(ranks))):
            return None
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if not self.plain or any(s in text for s in self.special):
            return np.array(self.whole(text), np.uint32)
        parts = [self.plain.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; only lengths leave the workers.

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are.
    Columns beside the two named are not read. Batches are cut by bytes, not rows, so that one
    long text does not hold up a batch of its neighbours.
    """
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for big in batches:
            for b in common.byte_slices(big, "text", SLICE_BYTES):
                n = np.fromiter((len(enc.ids(t)) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
