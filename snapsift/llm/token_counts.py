"""Token counts (7): rank-synchronous merging of ragged numpy arrays.

A SentencePiece BPE model joins adjacent symbols whose concatenation is a piece, best score first, leftmost on ties.
No piece holds the word mark behind another character, so a text falls apart before every mark that follows a
non-mark, and equal chunks need to be merged only once for a batch. All distinct new chunks of a batch are held as one flat
symbol array with offsets; each round finds every chunk's best pair at once (``searchsorted`` on the pair table,
``minimum.reduceat`` per chunk), applies it in all chunks and compresses the arrays, until no chunk has a pair. Chunks of more than
``LONG_CHARS`` characters are merged by a heap to the same result, so that a text without spaces takes n log n steps.

Defined results: null or empty text has 0 tokens and 0 bytes; characters outside the vocabulary count one token for each UTF-8 byte;
texts and chunks of any length are counted whole; of equal scores the leftmost pair is merged; repeated rows are counted like any row; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, held, merge_long, slices

MARK = "▁"
LIMIT = 4096
#: Longer chunks (lumps of characters without a space) are merged by a heap: symbols and rounds of the arrays both grow with a chunk's length.
LONG_CHARS = 256


class PieceTable:
    """The model's pieces as a sorted pair table: (left symbol, right symbol) -> (rank, merged symbol)."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.symbols: dict[str, int] = {}
        self.known: list[bool] = []
        self.width: list[int] = []
        for piece in scores:
            self.symbol(piece, True)
        for piece in scores:
            for c in piece:
                self.symbol(c, c in scores)
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [
            (self.symbols[p[:k]], self.symbols[p[k:]], rank[s], self.symbols[p])
            for p, s in scores.items()
            for k in range(1, len(p))
            if p[:k] in self.symbols and p[k:] in self.symbols
        ]
        a = np.array(pairs, dtype=np.int64)
        key = (a[:, 0] << 32) | a[:, 1]
        order = np.argsort(key)
        self.key, self.rank, self.merged = key[order], a[order, 2], a[order, 3]
        self.cache: dict[str, int] = {}
        self.pairs: dict[int, tuple[int, int]] = {}

    def symbol(self, text: str, known: bool) -> int:
        if (got := self.symbols.get(text)) is None:
            got = self.symbols[text] = len(self.known)
            self.known.append(known)
            self.width.append(len(text.encode("utf-8")))
        return got

    def merge_long(self, chunk: str) -> int:
        """Tokens of one chunk, by a heap."""
        if not self.pairs:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        left = merge_long([self.symbol(c, False) for c in chunk], self.pairs)
        return sum(1 if self.known[s] else self.width[s] for s in left)

    def merge(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk."""
        if not chunks:
            return np.zeros(0, dtype=np.int64)
        flat = np.fromiter((self.symbol(c, False) for x in chunks for c in x), dtype=np.int64)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        known, width = np.array(self.known), np.array(self.width)
        counts = np.zeros(len(chunks), dtype=np.int64)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        none = np.iinfo(np.int64).max
        while len(flat):
            best = np.full(len(flat), none)
            into = np.zeros(len(flat), dtype=np.int64)
            pair = (flat[:-1] << 32) | flat[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            hit = np.flatnonzero((self.key[at] == pair) & (owner[:-1] == owner[1:]))
            best[hit], into[hit] = self.rank[at[hit]], self.merged[at[hit]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(best, starts)
            lengths = np.diff(np.r_[starts, len(flat)])
            done = np.repeat(least == none, lengths)
            if done.any():  # no pair is left in these chunks: count what survives
                weight = np.where(known[flat[done]], 1, width[flat[done]])
                counts += np.bincount(owner[done], weights=weight, minlength=len(chunks)).astype(np.int64)
            candidates = np.flatnonzero((best == np.repeat(least, lengths)) & ~done)
            first = candidates[np.r_[True, owner[candidates][1:] != owner[candidates][:-1]]] if len(candidates) else candidates
            flat[first] = into[first]
            stay = ~done
            stay[first + 1] = False
            flat, owner = flat[stay], owner[stay]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        split = [chunks_of(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = set(chain.from_iterable(split)).difference(cache)
        short = [c for c in new if len(c) <= LONG_CHARS]
        cache.update(zip(short, self.merge(short).tolist(), strict=True))
        cache.update((c, self.merge_long(c)) for c in new if len(c) > LONG_CHARS)
        return [sum(map(cache.__getitem__, x)) for x in split]


def chunks_of(text: str) -> list[str]:
    """The escaped text cut before each mark that follows a non-mark; the first chunk has the dummy prefix."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    escaped = MARK + text.replace(" ", MARK)
    return re.findall(f"{MARK}+[^{MARK}]*", escaped)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. ``model_file`` must be readable on every executor."""

    def run(batches):
        pieces = held(("pieces", model_file), lambda: PieceTable(model_file))
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                        pa.array(pieces.count(texts), pa.int64()),
                    ],
                    names=["id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
