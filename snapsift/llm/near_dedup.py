"""MinHash near-dedup (1): a multi-index Hamming join on b-bit signatures, confirmed on full shingle sets.

A signature holds ``POSITIONS`` minima of 16 bits each; its distance counts positions that differ. Two documents of similarity s
differ in Binomial(POSITIONS, 1 - s) positions; the threshold ``distance`` is the least that such pairs exceed less than once in
``1 / MISSED`` times. Signatures are split into ``distance // 2 + 1`` chunks; by the pigeonhole principle two signatures within the
distance have a chunk with at most one error, and enumerating the allowed error (leaving out each position of the
chunk in turn) makes them meet in a bucket: every pair under the distance is found.

Equal sets (by 128 bits of hash sums) are one representative (their smallest id), so exact copies never meet. In a bucket, all members are first
measured against its leader; confirmed links make components, and one more round looks only at members of different components, in
cells of two blocks of ``BLOCK`` shingles: signatures meet there first, the members of pairs within the distance meet again with their full sets, pairs
are measured there, and only links that join two components leave it. So a group of any size costs rows in
proportion to its members, whether its pairs link or not, and no bucket is ever held by one task.

Defined results: null or empty texts and texts without words have an empty set and link with nothing (component is the own id); a null
id is never linked (component null, kept); repeated rows of one id are one document and are all kept or all dropped; other
columns are ignored by ``link`` and kept by ``keep_one``; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, cut, mix, ngrams, slices, utf8
from .components import components

POSITIONS = 64
MISSED = 1e-6
#: Shingles of a block of a bucket's members, and those measured at once (they bound a task's memory).
BLOCK = 1 << 18
PART = 1 << 20

_ODD = (np.random.default_rng(20240501).integers(1, 2**63, POSITIONS, dtype=np.uint64) << U(1)) | U(1)


def distance_for(percent: int, positions: int = POSITIONS, missed: float = MISSED) -> int:
    """The signature distance that pairs of the least similarity stay within, but for a share of ``missed``."""
    p, tail = 1 - percent / 100, 1.0
    for t in range(positions):
        tail -= math.comb(positions, t) * p**t * (1 - p) ** (positions - t)
        if tail < missed:
            return t
    return positions


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes; a shorter text is one shingle, whatever its length."""
    if not len(hashes):
        return hashes
    return np.unique(ngrams(hashes, min(words, len(hashes))) + U(min(words, len(hashes))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each position's minimum, finalised so that they are spread evenly."""
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=U)
    step = (1 << 18) // POSITIONS
    for start in range(0, len(shingles), step):
        part = mix(shingles[start : start + step])
        out = np.minimum(out, (part[:, None] * _ODD).min(0))
    return (mix(out) >> U(48)).astype(np.uint16)


def bucket_keys(signatures: np.ndarray, distance: int) -> np.ndarray:
    """(documents, POSITIONS) keys: for each chunk and each position left out, a hash of the chunk's other positions."""
    wide = signatures.astype(U)
    keys = np.empty(wide.shape, dtype=U)
    chunks = distance // 2 + 1
    bounds = np.linspace(0, POSITIONS, chunks + 1).round().astype(int)
    for c in range(chunks):
        for left_out in range(bounds[c], bounds[c + 1]):
            key = np.full(len(wide), left_out + 1, dtype=U)
            for k in range(bounds[c], bounds[c + 1]):
                if k != left_out:
                    key = mix(key * U(0x9E3779B97F4A7C15) + wide[:, k])
            keys[:, left_out] = key
    return keys


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, set (two hashes of the set), sig."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [shingle_set(hashes.of((t or b"").lower().split()), words) for t in batch.column(1).to_pylist()]
                one = [int(mix(s).sum().view(np.int64)) if len(s) else None for s in sets]
                two = [int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "set1", "set2", "sig"])

    return docs.mapInArrow(run, "id long, n long, set1 long, set2 long, sig binary")


def _keys(reps: DataFrame, distance: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS)
                keys = bucket_keys(sigs, distance).reshape(-1).view(np.int64)
                ids = np.repeat(batch.column(0).to_numpy(), POSITIONS)
                slots = np.tile(np.arange(POSITIONS, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(slots), pa.array(ids)], names=["key", "slot", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, slot int, rep long")


CELL = ["key", "slot", "kind", "i", "j"]


def _near(percent: int):
    """The pairs of a cell that have to be measured: a function of its columns that yields (member, array of later members).

    These are pairs of different components, of sizes that can link, within the signature distance, in the first bucket in which they
    meet. ``label`` is read anew for every member, so links found meanwhile rule out what they connect.
    """
    distance, chunks = distance_for(percent), distance_for(percent) // 2 + 1
    bounds = np.linspace(0, POSITIONS, chunks + 1).round().astype(int)
    chunk_of = np.searchsorted(bounds, np.arange(POSITIONS), "right") - 1

    def first_slot(differ: np.ndarray) -> np.ndarray:
        """The first slot in which each pair (a row of differing positions) meets."""
        errors = np.add.reduceat(differ, bounds[:-1], axis=1, dtype=np.int64)
        chunk = (errors <= 1).argmax(1)
        own = differ & (chunk_of == chunk[:, None])
        return np.where(own.any(1), own.argmax(1), bounds[chunk])

    def pairs(kind: int, slot: int, rep: np.ndarray, label: np.ndarray, side: np.ndarray, n: np.ndarray, sig: np.ndarray):
        for i in range(len(rep)):
            j = np.flatnonzero((rep > rep[i]) & (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((side != side[i]) if kind else (side == 0)))
            if len(j):
                differ = sig[j] != sig[i]
                j = j[(differ.sum(1) <= distance) & (first_slot(differ) == slot)]
                if len(j):
                    yield i, j

    return pairs


def _by_cell(handle, schema: pa.Schema):
    """Rows sorted by cell (key, slot, kind, i, j, then the members' columns) -> what ``handle`` makes of each cell of two members or more."""

    def run(batches):
        cell, members = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: len(CELL)] != cell:
                    if len(members) > 1 and (out := handle(cell, members)):
                        yield pa.RecordBatch.from_pylist(out, schema)
                    cell, members = row[: len(CELL)], []
                members.append(row[len(CELL) :])
        if len(members) > 1 and (out := handle(cell, members)):
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _columns(members: list[tuple]) -> list[np.ndarray]:
    """rep, label, side, n and the signatures of a cell's members."""
    numbers = [np.array([m[k] for m in members], dtype=np.int64) for k in range(4)]
    return [*numbers, np.frombuffer(b"".join(m[4] for m in members), dtype=np.uint16).reshape(-1, POSITIONS)]


def _open_members(percent: int):
    """Cells -> their members that are in any pair to be measured."""
    near = _near(percent)
    names = [*CELL, "rep", "label", "side", "n", "sig"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def handle(cell, members):
        need = np.zeros(len(members), dtype=bool)
        for i, j in near(cell[2], cell[1], *_columns(members)):
            need[i] = need[j] = True
        return [dict(zip(names, cell + members[k], strict=True)) for k in np.flatnonzero(need)]

    return _by_cell(handle, pa.schema(list(zip(names, types, strict=True))))


def _confirm(percent: int):
    """Cells whose members carry their full sets -> the confirmed links of a spanning forest of each cell.

    Pairs are measured on full sets right here, so a pair that does not link never becomes a row, and of those that
    link only the ones that join two components do.
    """
    near = _near(percent)

    def handle(cell, members):
        rep, label, side, n, sig = _columns(members)
        sets = [np.frombuffer(m[5], dtype=U) for m in members]
        starts = np.r_[0, np.cumsum(n)]
        values, number = np.unique(np.concatenate(sets), return_inverse=True)  # shingles by number, so that a set can be marked in an array
        mark = np.zeros(len(values), dtype=bool)
        out = []
        for i, j in near(cell[2], cell[1], rep, label, side, n, sig):
            mark[number[starts[i] : starts[i + 1]]] = True
            for part in np.array_split(j, -(-int(n[j].sum()) // PART)):
                same = np.concatenate([mark[number[starts[k] : starts[k + 1]]] for k in part])
                both = np.add.reduceat(same, np.r_[0, np.cumsum(n[part])[:-1]], dtype=np.int64)
                for k in part[100 * both >= percent * (n[part] + n[i] - both)].tolist():
                    if label[k] != label[i]:
                        label[label == label[k]] = label[i]
                        out.append({"a": int(rep[i]), "b": int(rep[k])})
            mark[number[starts[i] : starts[i + 1]]] = False
        return out

    return _by_cell(handle, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rep, shingles: the full sets of the listed documents."""

    def run(batches):
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, 1):
                found = [shingle_set(hashes.of((t or b"").lower().split()), words).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    picked = docs.join(ids.distinct(), "id", "left_semi").select("id", "text")
    return picked.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def _linked(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members and leaders that link, measured on full sets."""

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                linked.append(similar(len(x), len(y), int((both[1:] == both[:-1]).sum()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = stars.join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b").join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. ``percent`` is the least similarity in hundredths.

    Links are confirmed exactly, so none is wrong; the signature distance follows from ``percent``.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), utf8(text_col).alias("text"))
    signed = cut(_signatures(rows, words))
    named = signed.where("id is not null and n > 0")
    reps = cut(named.groupBy("set1", "set2").agg(F.min(F.struct("id", "n", "sig")).alias("r")).select("set1", "set2", F.col("r.id").alias("rep"), "r.n", "r.sig"))
    keys = cut(_keys(reps, distance_for(percent)))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1")
    members = cut(keys.join(cut(sizes), "key"))
    sets = cut(_sets(rows, members.select(F.col("rep").alias("id")), words))

    stars = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    labels = components(_linked(stars, sets, percent))
    about = reps.select("rep", "sig", "n").join(sets, "rep")
    found = _across(members.where("size > 2"), labels, about, percent)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))
    classes = cut(reps.join(labels, F.col("rep") == F.col("node"), "left").select("set1", "set2", F.coalesce("label", "rep").alias("class")))
    joined = signed.join(classes, ["set1", "set2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _across(members: DataFrame, labels: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket that belong to different components so far.

    A bucket's members in the leader's component (side 1) need no pairs among themselves: they are laid out in blocks against
    the blocks of the others (side 0), which also meet each other. A block holds ``BLOCK`` shingles, however many members these are.
    """
    of = lambda c, to: labels.withColumnsRenamed({"node": c, "label": to})
    m = members.join(of("rep", "own"), "rep", "left").join(of("leader", "main"), "leader", "left")
    m = m.select("key", "slot", "rep", F.coalesce("own", "rep").alias("label"), (F.coalesce("own", "rep") == F.coalesce("main", "leader")).cast("int").alias("side"))
    m = m.join(about.select("rep", "n"), "rep")
    weigh = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    counts = m.groupBy("key").agg(weigh(1).alias("mains"), weigh(0).alias("others")).where("others > 0")
    m = m.drop("n").join(cut(counts), "key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spread: Column = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 1, blocks("mains")).otherwise(blocks("others")))
    m = m.withColumn("block", spread.cast("int"))
    against = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda o: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), o.alias("j")))
    inner = F.transform(F.sequence(F.lit(0), blocks("others") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    outer = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(0), F.greatest(blocks("mains") - 1, F.lit(0))), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), F.col("block").alias("j")))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    laid = m.withColumn("cell", F.explode(F.when(F.col("side") == 1, against).otherwise(F.concat(inner, outer)))).select("key", "slot", "rep", "label", "side", "cell.*")
    # a cell of one component has nothing to confirm
    mixed = laid.groupBy(*CELL).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select(*CELL)
    laid = laid.join(mixed, CELL, "left_semi").join(about.select("rep", "n", "sig"), "rep")
    dealt = lambda rows: rows.repartition(*CELL).sortWithinPartitions(*CELL)
    columns = [*CELL, "rep", "label", "side", "n", "sig"]
    schema = "key long, slot int, kind int, i int, j int, rep long, label long, side int, n long, sig binary"
    # signatures meet first; full sets travel only for members, and to the cells, that have a pair to measure
    need = cut(dealt(laid.select(*columns)).mapInArrow(_open_members(percent), schema))
    return dealt(need.join(about.select("rep", "shingles"), "rep").select(*columns, "shingles")).mapInArrow(_confirm(percent), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group, with all their columns."""
    gone = link(docs, id_col, text_col, words, percent).where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("gone"))
    return rows.join(cut(gone), "gone", "left_anti").select("row.*")
