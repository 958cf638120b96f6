"""Vector code compression (12): product quantisation that looks for nearest entries among the few that a grid cell leaves.

Components become integers and vectors ``PARTS`` equal parts; each part's codebook starts as that part of the first vectors and is refined in rounds of
assignment and averaging. To assign a part, its cell in a grid of width ``CELL`` is looked up: the first part in a cell computes each
entry's least and greatest distance to the cell's box and remembers the entries that no other one beats all over the box (least distance
at most the smallest greatest distance); only these are evaluated exactly. Ties stay among them, so the result is that of a full search. Remembered cells
belong to one codebook; a worker starts over beyond ``HELD_CELLS``. A round is one pass over the written integers: each task sums its parts by
entry, and only entries x components sums reach the driver, so nothing grows with the vectors but the passes.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped; a component beyond ``BOUND`` counts as ``BOUND``, so that
sums of squares stay whole numbers of 64 bits; the dimension is that of the smallest id with components (a null id is the greatest; of equal ids the
smallest vector), and rows of another one, empty vectors included, have a null code and error; parts are padded with zeros if they do not come out
equal; with fewer vectors than entries there are as many entries as vectors; repeated rows count each; rows with a null label share its error, which is null
where no row of the label has one; other columns, of whatever name, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held
from .skew import join_groups

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BOUND = 1 << 26
#: Width of the grid's cells, and cells that a worker remembers for each part position.
CELL = 512
HELD_CELLS = 100_000
#: Rows that a task handles together.
ROWS = 4_096


class Cells:
    """One part position's entries, and for each cell met so far those that can be nearest in it."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.known: dict[bytes, np.ndarray] = {}

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """Cells x entries: whether an entry can be the nearest of some place in the cell's box."""
        low = cells[:, None, :] * CELL
        under, over = low - self.book, self.book - (low + CELL - 1)
        least = np.maximum(np.maximum(under, over), 0)
        greatest = np.maximum(np.abs(under), np.abs(over))
        return (least**2).sum(axis=2) <= (greatest**2).sum(axis=2).min(axis=1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray(x // CELL)
        keys, first, of = np.unique(cells.view(np.dtype((np.void, 8 * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys]
        if len(self.known) + len(names) > HELD_CELLS:
            self.known.clear()
        new = [k for k, name in enumerate(names) if name not in self.known]
        if new:
            self.known.update(zip([names[k] for k in new], self.possible(cells[first[new]]), strict=True))
        return np.stack([self.known[name] for name in names])[of.ravel()]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part the nearest entry (of equally near ones the first) and its squared distance."""
        row, entry = np.nonzero(self.candidates(x))
        distance = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(x))))
        best = np.flatnonzero(distance == least[row])
        best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
        return entry[best], distance[best]


def _grids(books: np.ndarray) -> list[Cells]:
    """The cells that this worker remembers for these codebooks; those of other codebooks go."""
    kept, name = held("grid cells", dict), books.tobytes()
    if kept.get("of") != name:
        kept |= {"of": name, "grids": [Cells(b) for b in books]}
    return kept["grids"]


def _parts(column: pa.Array, size: int, width: int) -> np.ndarray:
    """Rows x parts x components of vectors of ``size`` components each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
    return np.pad(flat, ((0, 0), (0, PARTS * width - size))).reshape(len(column), PARTS, width)


def _assigned(batches, column: int, size: int, books: np.ndarray):
    """Slices of the batches with their parts, entries and distances."""
    grids = _grids(books)
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            x = _parts(batch.column(column), size, books.shape[2])
            found = [g.nearest(x[:, p]) for p, g in enumerate(grids)]
            yield batch, x, np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v: the rows whose vectors are whole, as integers."""
    x = vectors[vector_col].cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    scaled = F.transform(x, lambda e: F.least(F.greatest(F.floor(e * SCALE), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return kept.select(kept[id_col].alias("id"), kept[label_col].alias("label"), scaled.alias("v"))


def train(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The dimension and the codebooks (parts x entries x components) of written integer vectors."""
    in_order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    first = rows.where(F.size("v") > 0).orderBy(*in_order).select("v").first()
    if first is None:
        return 0, np.zeros((PARTS, 0, 0), dtype=np.int64)
    size = len(first.v)
    width = -(-size // PARTS)
    usable = rows.where(F.size("v") == size).select("v", "id")
    start = usable.orderBy(*in_order).limit(ENTRIES).select("v").collect()
    books = np.ascontiguousarray(_parts(pa.array([r.v for r in start], pa.list_(pa.int32())), size, width).transpose(1, 0, 2))

    def sums_of(now: np.ndarray):
        def run(batches):
            sums, counts = np.zeros_like(now), np.zeros(now.shape[:2], dtype=np.int64)
            for _, x, entries, _ in _assigned(batches, 0, size, now):
                for p in range(PARTS):
                    np.add.at(sums[p], entries[:, p], x[:, p])
                    counts[p] += np.bincount(entries[:, p], minlength=now.shape[1])
            part, entry, place = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, sums.shape))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, place, sums[part, entry, place], counts[part, entry])], names=["part", "entry", "place", "total", "n"])

        return run

    for _ in range(ROUNDS):
        sums = usable.select("v").mapInArrow(sums_of(books), "part long, entry long, place long, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # entries x components rows
            books[r.part, r.entry, r.place] = r.total // r.n
    return size, books


def encode(rows: DataFrame, size: int, books: np.ndarray) -> DataFrame:
    """id, label, code, error of each row."""

    def run(batches):
        for batch, _, entries, distances in _assigned(batches, 2, size, books):
            digits = entries.astype(np.uint8).tobytes().hex()
            codes = pa.array([digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(distances.sum(axis=1))], names=["id", "label", "code", "error"])

    types = dict(rows.dtypes)
    fits = F.size("v") == size if size else F.lit(False)
    coded = rows.where(fits).mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long")
    return coded.unionByName(rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))


def listing(books: np.ndarray) -> str:
    """All entries' components by part, entry and place, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256: the codes of all whole vectors, with codebooks fitted to all of them."""
    rows = cut(integers(vectors, id_col, vector_col, label_col))
    size, books = train(rows)
    coded = cut(encode(rows, size, books).select("id", F.struct("label").alias("of"), "code", "error"))  # a struct is not null, whatever the label
    sums = cut(coded.groupBy("of").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    done = join_groups(coded, sums, "of", "n")
    return done.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(listing(books).encode()).hexdigest()).alias("codebooks_sha256"))
