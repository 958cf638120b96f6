"""Substring dedup (5): relative Lempel-Ziv parsing against indexed blocks of reference windows.

The reference of a document is every document with a smaller id. It is indexed by windows of ``WIDTH`` words in blocks, one for each
range of window fingerprints: a document meets exactly the blocks that can hold one of its windows, which keeps the work in proportion to the
corpus where parsing every document against every run of documents would be quadratic. A look-up gives the window's place in the reference: a document with
a smaller id, and the word there. The parse is greedy: a factor starts at a window that the reference holds and grows word by word while the
next window goes on at the next word of the same document; where it does not, the factor ends. The windows across that boundary have been looked up
themselves, so the next factor starts there if another document (or another place) goes on, and no repeated word between two factors is missed. Factors
are at least ``WIDTH`` words long, each stands verbatim at one place of one document, and they are the duplicate spans.

Three steps keep the volume near that of the repeats:
1. Every window has an anchor, the least hash of its ``GRAM``-word runs; equal windows have equal anchors. Anchors that two documents
   share are found by a shuffle of hashes and set in a bit filter of at most ``FILTER_BITS`` bits (a fixed bound: more anchors only
   make it pass more windows, never fewer).
2. Windows with a shared anchor are compared first inside the task that read them: all but the smallest document of equal
   windows are hits at once, and only the smallest goes to the block of its fingerprint, where the smallest over all tasks is found.
   A window that a third of all documents hold costs one row for each task.
3. Hits are gathered by ranges of documents and joined to the texts, which are parsed and cut.

Blocks and ranges are sorted by Spark and handled one at a time, so a task holds one of them. Windows are equal if 96 bits of two independent
fingerprints are (among 10^13 windows two meet by chance in less than one corpus of a thousand). Defined results: null or empty text has no words; a document of fewer words than
a window loses none; texts of any length are parsed whole; where several smaller documents have a window, the smallest that the task or the block holds is the reference;
a null id is no reference and loses nothing; repeated rows of one id are one document, no smaller than itself; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WordHashes, cut, mix, ngrams, partitions_for, slices, utf8

WIDTH = 13
GRAM = 6
FILTER_BITS = 1 << 28
BITS_FOR_EACH = 16
#: Bytes of hits that a task holds before it hands them on.
HELD_BYTES = 64 << 20


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least of its runs' hashes."""
    m, span, want = ngrams(h, GRAM), 1, WIDTH - GRAM + 1
    while span < want:
        step = min(span, want - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    return m


def fingerprints(h: np.ndarray) -> np.ndarray:
    g = ngrams(h, GRAM)
    n = len(h) - WIDTH + 1
    return mix(mix(g[:n] * U(0x9E3779B97F4A7C15) + g[GRAM : GRAM + n]) + h[2 * GRAM : 2 * GRAM + n])


def second_hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes that have nothing to do with those of ``WordHashes``."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 77) for w in words), dtype=U, count=len(words))


def _windows(batch, hashes: WordHashes):
    """(row, word hashes, words) of a batch's documents that have a window."""
    for row, text in enumerate(batch.column(1).to_pylist()):
        words = (text or b"").split()
        if len(words) >= WIDTH:
            yield row, hashes.of(words), words


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """Sorted 64-bit values -> bounds of ``ranges`` equal parts of their space."""
    edges = np.array([-(-(k << 32) // ranges) << 32 for k in range(1, ranges)], dtype=U)  # so that (value >> 32) * ranges >> 32 is the part
    return np.r_[0, np.searchsorted(values, edges), len(values)]


def _distinct(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, shared = values[order], shared[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.logical_or.reduceat(shared, first) if len(first) else shared


def _anchors_by_range(ranges: int):
    """Documents -> (range, distinct anchors of this task, whether two of its documents share them)."""

    def run(batches):
        hashes = WordHashes()
        kept, flags = np.zeros(0, dtype=U), np.zeros(0, dtype=bool)
        for whole in batches:
            for batch in slices(whole, 1):
                each = [np.unique(anchors(h)) for _, h, _ in _windows(batch, hashes)]
                if each:
                    mine = np.concatenate(each)
                    mine.sort()
                    twice = np.r_[mine[1:] == mine[:-1], False]
                    values, shared = _distinct(mine, twice)
                    both = np.concatenate([kept, values])
                    order = np.argsort(both, kind="stable")
                    again = np.r_[both[order][1:] == both[order][:-1], False]
                    flags = np.concatenate([flags, shared])
                    flags[order[again]] = True
                    kept, flags = _distinct(both, flags)
        bounds = _range_of(kept, ranges)
        parts = [(k, kept[a:b].tobytes(), flags[a:b].tobytes()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        yield _batch(parts, ["part", "anchors", "flags"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _grouped(batches, names: list[str]):
    """(part, [tuple of the named columns, ...]) of one part after the other, from rows sorted by ``part``."""
    part, rows = None, []
    for batch in batches:
        for own, *rest in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ["part", *names]), strict=True):
            if own != part:
                if rows:
                    yield part, rows
                part, rows = own, []
            rows.append(tuple(rest))
    if rows:
        yield part, rows


def _joined(rows: list[tuple], types: list) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[k], dtype=t) for r in rows]) for k, t in enumerate(types)]


def _shared(batches):
    """Anchors of a range that two documents share, in this task or in different ones."""
    for part, rows in _grouped(batches, ["anchors", "flags"]):
        values, flags = _joined(rows, [U, bool])
        order = np.argsort(values, kind="stable")
        values, flags = values[order], flags[order].copy()
        flags[:-1] |= values[1:] == values[:-1]
        values, flags = _distinct(values, flags)
        yield _batch([(part, int(flags.sum()), values[flags].tobytes())], ["part", "n", "anchors"], [pa.int32(), pa.int64(), pa.binary()])


def _bit_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(values + U(k)) % U(bits)).astype(np.int64) for k in (1, 2)]


def _filter_bits(bits: int):
    def run(batches):
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                field = np.zeros(bits, dtype=bool)
                for places in _bit_places(np.frombuffer(values, dtype=U), bits):
                    field[places] = True
                yield _batch([(part, np.packbits(field).tobytes())], ["part", "bits"], [pa.int32(), pa.binary()])

    return run


#: What a window carries: two fingerprints, its document and place, and (once found) its reference's document and place.
_ENTRY = ["print1", "print2", "docs", "places", "refs", "ref_places"]
_SCHEMA = "kind int, part int, " + ", ".join(f"{n} binary" for n in _ENTRY)


def _rows(kind: int, bounds: np.ndarray, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each part that has entries."""
    rows = [(kind, k, *(b"" if c is None else c[a:b].tobytes() for c in columns)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return _batch(rows, ["kind", "part", *_ENTRY], [pa.int32(), pa.int32(), *[pa.binary()] * len(_ENTRY)])


def _candidates(ranges: int, doc_ranges: int, bits: int, held):
    """Documents -> index entries by range of fingerprints (kind 0), and the hits that this task finds itself by range of documents (kind 1)."""

    def run(batches):
        field = np.frombuffer(held.value, dtype=np.uint8)
        width = -(-bits // 8)
        hashes = WordHashes()
        found = []
        for whole in batches:
            for batch in slices(whole, 1):
                ids = batch.column(0).to_numpy()
                for row, h, words in _windows(batch, hashes):
                    a = anchors(h)
                    part = ((a >> U(32)) * U(ranges) >> U(32)).astype(np.int64)  # as _range_of() cuts
                    passes = np.ones(len(a), dtype=bool)
                    for bit in _bit_places(a, bits):
                        passes &= (field[part * width + (bit >> 3)] >> (7 - (bit & 7)) & 1).astype(bool)
                    at = np.flatnonzero(passes)
                    if len(at):
                        found.append((fingerprints(h)[at], (fingerprints(second_hashes(words))[at] >> U(32)).astype(np.uint32), np.full(len(at), ids[row], dtype=np.int64), at.astype(np.int32)))
        if found:
            yield from _split_hits(*(np.concatenate(c) for c in zip(*found, strict=True)), doc_ranges, ranges)

    return run


def _split_hits(one: np.ndarray, two: np.ndarray, doc: np.ndarray, place: np.ndarray, doc_ranges: int, ranges: int = 0):
    """Entries of which a smaller document has the same window are hits; the others go on to their range, if asked for."""
    order = np.lexsort((place, doc, two, one))
    one, two, doc, place = one[order], two[order], doc[order], place[order]
    start = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    hit = doc > doc[first]
    if ranges:
        yield _rows(0, _range_of(one[~hit], ranges), [one[~hit], two[~hit], doc[~hit], place[~hit], None, None])
    d, p, first = doc[hit], place[hit], first[hit]
    part = (mix(d.view(U)) % U(doc_ranges)).astype(np.int64)
    order = np.lexsort((p, d, part))
    d, p, first = d[order], p[order], first[order]
    yield _rows(1, np.searchsorted(part[order], np.arange(doc_ranges + 1)), [None, None, d, p, doc[first], place[first]])


def _put_together(hits: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each range of documents, from rows of hits."""
    found: dict[int, list[dict]] = {}
    for batch in hits:
        for row in batch.to_pylist():
            found.setdefault(row["part"], []).append(row)
    rows = [(1, part, *(b"".join([r[n] for r in mine]) for n in _ENTRY)) for part, mine in sorted(found.items())]
    return _batch(rows, ["kind", "part", *_ENTRY], [pa.int32(), pa.int32(), *[pa.binary()] * len(_ENTRY)])


def _look_up(doc_ranges: int):
    """All entries of a range meet: those with a smaller document's window are hits. Hits found before pass through."""

    def run(batches):
        def entries():
            for batch in batches:
                mask = np.asarray(batch.column(0)) == 1
                if mask.any():
                    passed.append(batch.filter(pa.array(mask)))
                yield batch.filter(pa.array(~mask))

        passed: list[pa.RecordBatch] = []
        for _, rows in _grouped(entries(), _ENTRY[:4]):
            passed += _split_hits(*_joined(rows, [U, np.uint32, np.int64, np.int32]), doc_ranges)
            if sum(b.nbytes for b in passed) > HELD_BYTES:  # so the hits of many blocks leave in one row for each range of documents
                yield _put_together(passed)
                passed.clear()
        yield _put_together(passed)

    return run


def _by_document(batches):
    """(document, places of its hits, documents and places of their references) for each document."""
    for _, rows in _grouped(batches, _ENTRY[2:]):
        doc, place, ref, at = _joined(rows, [np.int64, np.int32, np.int64, np.int32])
        order = np.lexsort((place, doc))
        doc, place, ref, at = doc[order], place[order], ref[order], at[order]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ends = np.r_[first[1:], len(doc)]
        out = [(int(doc[a]), place[a:b].tobytes(), ref[a:b].tobytes(), at[a:b].tobytes()) for a, b in zip(first, ends, strict=True)]
        yield _batch(out, ["hit_id", "hits", "refs", "ref_places"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def factors(hits: np.ndarray, refs: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, end, reference document, start there) of each factor, from the sorted places of windows that the reference holds."""
    if not len(hits):
        return []
    once = np.r_[True, hits[1:] != hits[:-1]]  # repeated rows of one document
    hits, refs, places = hits[once], refs[once], places[once]
    new = np.r_[True, (hits[1:] != hits[:-1] + 1) | (refs[1:] != refs[:-1]) | (places[1:] != places[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(hits)] - 1
    return list(zip(hits[first].tolist(), (hits[last] + WIDTH).tolist(), refs[first].tolist(), places[first].tolist(), strict=True))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(hit_id, hits, refs, ref_places): for documents (id, text) the places of windows that a document with a smaller id has, and where it has them."""
    spark = docs.sparkSession
    docs = docs.where("id is not null")
    n = partitions_for(spark)
    ranges = 4 * n
    mine = docs.mapInArrow(_anchors_by_range(ranges), "part int, anchors binary, flags binary")
    shared = cut(mine.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared, "part int, n long, anchors binary"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(1024, BITS_FOR_EACH * total)) // ranges // 8 * 8 + 8
    field = bytearray(ranges * (bits // 8))
    for row in shared.select("part", "anchors").mapInArrow(_filter_bits(bits), "part int, bits binary").toLocalIterator():
        field[row.part * (bits // 8) : (row.part + 1) * (bits // 8)] = row.bits
    held = spark.sparkContext.broadcast(bytes(field))
    entries = docs.mapInArrow(_candidates(ranges, n, bits, held), _SCHEMA)
    hits = entries.repartition(n, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_look_up(n), _SCHEMA)
    return hits.drop("print1", "print2").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_by_document, "hit_id long, hits binary, refs binary, ref_places binary")


_SPANS = "array<struct<start:int,end:int,reference:long,reference_start:int>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one space), spans."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), utf8(text_col).alias("text"))
    joined = rows.join(repeated_windows(rows), F.col("id") == F.col("hit_id"), "left")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for text, hits, refs, at in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    words = (text or b"").split()
                    parsed = factors(*(np.frombuffer(x or b"", dtype=t) for x, t in ((hits, np.int32), (refs, np.int64), (at, np.int32))))
                    left, end = [], 0
                    for a, b, *_ in parsed:  # factors may share words at their boundaries
                        left += words[end:a]
                        end = max(end, b)
                    left += words[end:]
                    spans = [dict(zip(("start", "end", "reference", "reference_start"), f, strict=True)) for f in parsed]
                    out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8"), spans))
                types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("reference", pa.int64()), ("reference_start", pa.int32())]))]
                made = _batch(out, ["n_words", "n_removed", "kept", "spans"], types)
                yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["id", *made.schema.names])

    done = joined.select("id", "text", "hits", "refs", "ref_places").mapInArrow(run, f"id long, n_words long, n_removed long, kept string, spans {_SPANS}")
    return done.withColumnRenamed("id", id_col)
