"""Byte-level BPE encoding and decoding (4): DuckDB recursive queries inside each partition.

A text is cut into chunks before every space that a non-space follows (always a boundary of the split pattern), chunks are
cut by the pattern into pre-tokens, and the distinct new pre-tokens of a batch go to DuckDB in one call: a
recursive query holds (word, position, symbol) rows, joins adjacent rows to the merge table and contracts each word's
leftmost pair of minimum rank until no pair is left; an ordered aggregation renders the ids and decodes them to bytes.
Results are remembered by chunk as long as the Python worker lives, so a frequent chunk is merged once for each worker, and every document is
assembled from its own chunks. Pre-tokens of more than ``LONG_BYTES`` bytes are merged by a heap to the same result, so that a text without spaces takes
n log n steps. A pre-token that is a token itself is looked up.

Defined results: null or empty text has no ids (hash of the empty string for both digests); special-token strings inside a text are
ordinary text; of equal ranks the leftmost pair is merged; texts and pre-tokens of any length are encoded whole; repeated rows are encoded like any row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, merge_long, slices

#: Distinct chunks and distinct pre-tokens of one generation that a worker remembers (bounds its memory); there are two, so that what is in use stays.
CACHE_CHUNKS = 100_000
#: Longer pre-tokens (lumps of letters without a space) are merged by a heap: rows and rounds of a recursion both grow with a word's length.
LONG_BYTES = 256
#: Rows that the recursive query of one batch of pre-tokens piles up at most (bounds DuckDB's memory, which has nowhere to spill to).
QUERY_ROWS = 2_000_000
#: Contractions of one recursive query; words that need more go on in the next one (bounds the rows it piles up).
ROUNDS = 64

#: A word's number and a symbol's position are one key (position in the lower 16 bits, which ``LONG_BYTES`` leaves room for), so that one sort serves the window.
#: A pair that can be merged is one number too (rank, position, position of the symbol that goes), so that a word's next merge is a plain minimum; the rank is the merged symbol.
#: A word that has no pair left is said once more, with n = -1, and goes.
_MERGE = """
WITH RECURSIVE step(k, sym, n) AS (
    SELECT word * 65536 + pos, sym, 0 FROM symbols
  UNION ALL
    SELECT s.k, CASE WHEN (s.k & 65535) = ((b.best >> 16) & 65535) THEN b.best >> 32 ELSE s.sym END, CASE WHEN b.best IS NULL THEN -1 ELSE s.n + 1 END
    FROM step s LEFT JOIN (
        SELECT p.k >> 16 AS word, min((m.rank << 32) | ((p.k & 65535) << 16) | (p.gone & 65535)) AS best
        FROM (SELECT k, gone, (sym << 32) | nxt AS pair FROM (SELECT k, sym, lead(sym) OVER w AS nxt, lead(k) OVER w AS gone FROM step WHERE n >= 0 WINDOW w AS (ORDER BY k)) WHERE (gone >> 16) = (k >> 16)) p
        JOIN merges m ON m.pair = p.pair
        GROUP BY 1
    ) b ON b.word = (s.k >> 16)
    WHERE s.n >= 0 AND s.n < {rounds} AND (b.best IS NULL OR (s.k & 65535) <> (b.best & 65535))
)
SELECT k >> 16 AS word, k & 65535 AS pos, sym, n FROM step WHERE n = -1 OR n = {rounds}
"""
_RENDER = """
SELECT word, encode(string_agg(t.name, ' ' ORDER BY pos)) AS ids, unhex(string_agg(t.hex, '' ORDER BY pos)) AS text
FROM done JOIN tokens t ON t.id = done.sym GROUP BY word
"""


class Remembered:
    """Values by key. At ``CACHE_CHUNKS`` keys a new generation begins, and takes over what is asked for of the one before."""

    def __init__(self):
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that have no values; those that have are in ``new`` then."""
        if len(self.new) > CACHE_CHUNKS:
            self.old, self.new = self.new, {}
        keys = keys.difference(self.new)
        again = keys.intersection(self.old)
        self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return keys - again


class Encoder:
    """One worker's merge table and what it has merged so far."""

    def __init__(self, ranks_file: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.merges = np.array([(ranks[p[:k]], ranks[p[k:]], r) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks], dtype=np.int64)
        self.pairs: dict[int, tuple[int, int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._load("merges", pa.table({"pair": (self.merges[:, 0] << 32) | self.merges[:, 1], "rank": self.merges[:, 2]}))
        self._load("tokens", pa.table({"id": pa.array(ranks.values(), pa.int64()), "name": [str(r) for r in ranks.values()], "hex": [t.hex() for t in ranks]}))
        self.pattern = regex.compile(pattern)
        self.space = regex.compile(r" (?=\S)")
        self.uneven = re.compile(r" (?:\s|$)")  # re's \s holds all of regex's: a needless slow path at worst
        #: Of each chunk, the ids as text and the decoded bytes. The space that every chunk but a text's first begins with is left out of the key.
        self.chunks = Remembered()
        #: The same of each pre-token, which may stand in many chunks.
        self.words = Remembered()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def merge(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """(ids, decoded bytes) of distinct pre-tokens, by recursive queries; those beyond ``LONG_BYTES`` by a heap."""
        out = {}
        raw = [(w, w.encode("utf-8")) for w in words]
        for w, text in raw:
            if (rank := self.ranks.get(text)) is not None:  # a whole token is looked up, as the library does
                out[w] = str(rank).encode(), text
            elif len(text) > LONG_BYTES:
                out[w] = self._merge_long(text)
        raw = [x for x in raw if x[0] not in out]
        batch = np.cumsum([len(x) * min(len(x), ROUNDS) for _, x in raw], dtype=np.int64) // QUERY_ROWS
        bounds = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(raw)] if raw else []
        done = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = raw[start:end]
            sizes = np.fromiter((len(x) for _, x in part), dtype=np.int64, count=len(part))
            word = np.repeat(np.arange(start, end), sizes)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.table({"word": word, "pos": pos, "sym": self.byte_ids[np.frombuffer(b"".join([x for _, x in part]), dtype=np.uint8)]})
            while rows.num_rows:
                self._load("symbols", rows)
                rows = self.db.sql(_MERGE.format(rounds=ROUNDS)).to_arrow_table()
                going_on = pc.equal(rows["n"], ROUNDS)
                done.append(rows.filter(pc.invert(going_on)))
                rows = rows.filter(going_on).select(["word", "pos", "sym"])
        if done:  # rendered together: the join with the tokens has a price of its own
            self._load("done", pa.concat_tables(done))
            found = self.db.sql(_RENDER).to_arrow_table()
            keys = (raw[w][0] for w in found["word"].to_pylist())
            out.update(zip(keys, zip(found["ids"].to_pylist(), found["text"].to_pylist(), strict=True), strict=True))
        return out

    def _merge_long(self, text: bytes) -> tuple[bytes, bytes]:
        if not self.pairs:
            self.pairs = {a << 32 | b: (r, r) for a, b, r in self.merges.tolist()}
            self.tokens = {r: t for t, r in self.ranks.items()}
        ids = merge_long(self.byte_ids[np.frombuffer(text, dtype=np.uint8)].tolist(), self.pairs)
        return " ".join(map(str, ids)).encode(), b"".join([self.tokens[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Cut before each space that a non-space follows; such a cut is always a boundary of the pattern. The spaces at the cuts go."""
        return self.space.split(text) if self.uneven.search(text) else text.split(" ")

    def _learn(self, chunks: set[str], before: str, known: dict[str, tuple[bytes, bytes]]) -> None:
        cut = {c: self.pattern.findall(before + c) for c in chunks}
        missing = self.words.missing(set(chain.from_iterable(cut.values())))
        of = self.words.new
        of.update(self.merge(list(missing)))
        for c, x in cut.items():
            if len(x) == 1:
                known[c] = of[x[0]]
            else:
                ids, decoded = zip(*[of[w] for w in x], strict=True)
                known[c] = b" ".join(ids), b"".join(decoded)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, digest of the ids, digest of the decoded bytes) of each text."""
        split = [self.split(t) for t in texts]
        heads = {}
        self._learn({x[0] for x in split if x[0]}, "", heads)
        missing = self.chunks.missing(set(chain.from_iterable(x[1:] for x in split)))
        of = self.chunks.new
        self._learn(missing, " ", of)
        out = []
        for first, *rest in split:
            found = [*([heads[first]] if first else []), *map(of.__getitem__, rest)]
            ids, decoded = map(list, zip(*found, strict=True)) if found else ([], [])
            ids = b" ".join(ids)
            out.append((ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()))
        return out


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256. ``ranks_file`` must be readable on every executor."""

    def run(batches):
        encoder = held(("byte_bpe", ranks_file, pattern), lambda: Encoder(ranks_file, pattern))
        for whole in batches:
            for batch in slices(whole, 1):
                gc.disable()  # hundreds of thousands of small lists and no cycles: the collector would go through them again and again
                try:
                    got = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                finally:
                    gc.enable()
                n, ids, back = zip(*got, strict=True) if got else ((), (), ())
                columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
