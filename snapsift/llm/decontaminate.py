"""Benchmark decontamination (9): suffix arrays over shards of the training text.

Each batch of documents is a shard. Its words become ids of the benchmark's vocabulary (0: a word that no benchmark item has,
which also ends every suffix), and the shard's suffix array is the sorted order of the suffixes that can hold a whole
window, that is those that start a long enough run of known words. Every suffix of the test items is binary-searched in
the shard's array; the range it finds gives all verbatim occurrences of its window, with their places, and consecutive
occurrences on one diagonal give the longest matches.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is ``width`` consecutive words of an item; an
item with fewer words, but at least one, is one window. A Spark job deals the benchmark into blocks of bounded size and builds each one's vocabulary and
windows in a task; blocks travel to the shards one by one, ``HELD_BLOCKS`` of them in one pass over the documents. What a pass finds is written by
the digest of the text, for texts with hits alone, before the next blocks come; the last pass carries the documents and joins the findings of
the others. So neither the driver nor a task ever holds more than these, documents are written once at most, and no set of them is collected.

Defined results: null or empty texts, and texts without words, have 0 words and 0 hits; items without words never match; items with
null ids match words but are left out of the item list; texts of any length are searched whole; repeated documents are judged one by one, repeated items once;
other columns are ignored by ``contamination`` and kept by ``remove_contaminated``; empty tables give no hits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial, reduce
from itertools import islice
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8

WIDTH = 10
#: Bytes of benchmark text of one block (an item of more is a block of its own), and blocks that are held at once (they bound a task's memory).
BLOCK_BYTES = 2 << 20
HELD_BLOCKS = 8

_WORDS = bytes((b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class TestBlock:
    """Vocabulary and window suffixes of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        suffixes, lengths, owners, places = [], [], [], []
        for item, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(width, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                suffixes.append(ids[at : at + length] + [0] * (width - length))
                lengths.append(length)
                owners.append(item)
                places.append(at)
        self.suffixes = _keys(np.array(suffixes, dtype=np.int64).reshape(-1, width))
        self.lengths = np.array(lengths, dtype=np.int64)
        after = np.array(suffixes, dtype=np.int64).reshape(-1, width)
        if len(after):  # the first key beyond all suffixes that begin with the window
            after[np.arange(len(after)), self.lengths - 1] += 1
        self.beyond = _keys(after)
        self.owners = owners
        self.places = np.array(places, dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(lengths) else width


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort as the rows do (an end mark of 0 sorts first)."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").reshape(-1)


def search_shard(texts: list[bytes | None], block: TestBlock | SimpleNamespace) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the block's windows in a shard: (document's row, word position, window, words of each document)."""
    width, known = block.width, block.vocabulary
    per_doc = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, per_doc), dtype=np.int64, count=len(per_doc))
    none = np.zeros(0, dtype=np.int64)
    if not known or not counts.sum():
        return none, none, none, counts
    get = known.get
    starts = np.r_[0, np.cumsum(counts + 1)]  # an end mark after each document
    ids = np.zeros(starts[-1] + width, dtype=np.int64)
    for words, at in zip(per_doc, starts, strict=False):
        ids[at : at + len(words)] = [get(w, 0) for w in words]
    stops = np.flatnonzero(ids == 0)
    ends = stops[np.searchsorted(stops, np.arange(len(ids) - width))]
    able = np.flatnonzero(ends - np.arange(len(ids) - width) >= block.shortest)
    if not len(able):
        return none, none, none, counts
    grid = ids[able[:, None] + np.arange(width)]
    grid[np.arange(width) >= (ends[able] - able)[:, None]] = 0
    keys = _keys(grid)
    order = np.argsort(keys, kind="stable")
    array, keys = able[order], keys[order]
    low, high = np.searchsorted(keys, block.suffixes, "left"), np.searchsorted(keys, block.beyond, "left")
    found = np.flatnonzero(high > low)
    if not len(found):
        return none, none, none, counts
    window = np.repeat(found, (high - low)[found])
    places = np.concatenate([array[low[w] : high[w]] for w in found])
    doc = np.searchsorted(starts, places, "right") - 1
    return doc, places - starts[doc], window, counts


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[bytes]:
    """The benchmark's blocks, each built by a task from its distinct items and handed on one by one."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).dropDuplicates()
    size, items = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, min(items, -(-(size or 0) // block_bytes)))

    def build(batches):
        block, held = None, []
        for batch in batches:
            for own, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block and held:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(TestBlock(held, width)))], pa.binary())], names=["body"])
                    held = []
                block = own
                held.append((item, text))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(TestBlock(held, width)))], pa.binary())], names=["body"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))).repartition(n, "block").sortWithinPartitions("block")
    for row in cut(dealt.select("block", "id", "text").mapInArrow(build, "body binary")).toLocalIterator():
        yield bytes(row.body)


_FOUND = "struct<n_words:long,n_hit:long,hit:binary,items:array<long>,matches:array<struct<item:long,item_at:int,doc_at:int,words:int>>>"


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``row`` (the document) and ``found``: n_words, n_hit, hit (a bit for each word), items and longest verbatim matches."""
    bodies = _blocks(benchmark, item_col, item_text_col, width, block_bytes)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), utf8(text_col).alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    texts = rows.select(F.sha2("text", 256).alias("row"), "text", "found")
    held, following = list(islice(bodies, HELD_BLOCKS)), next(bodies, None)
    before = []
    while following is not None:
        sent = [docs.sparkSession.sparkContext.broadcast(body) for body in held]
        before.append(cut(_pass(texts, sent, width).where("found.n_hit > 0").select("row", "found").dropDuplicates(["row"])))
        for old in sent:
            old.destroy()
        held, following = [following, *islice(bodies, HELD_BLOCKS - 1)], next(bodies, None)
    last = _pass(rows, [docs.sparkSession.sparkContext.broadcast(body) for body in held], width)
    if not before:
        return last.select("row", "found")
    earlier = reduce(DataFrame.unionAll, before).groupBy(F.col("row").alias("digest")).agg(F.collect_list("found").alias("earlier"))  # one of each pass at most
    joined = last.withColumn("digest", F.sha2("text", 256)).join(earlier, "digest", "left").select("row", "found", "earlier")
    merged = joined.mapInArrow(lambda batches: map(_merge, batches), joined.schema)
    return merged.select("row", "found")


def _pass(rows: DataFrame, sent: list, width: int) -> DataFrame:
    """Fills ``found`` by the blocks that were sent."""

    def run(batches, sent=None):
        block = SimpleNamespace(**pickle.loads(sent.value)) if sent else TestBlock([], width)
        for whole in batches:
            for batch in slices(whole, 1):
                yield _judge(batch, block)

    for one in sent or [None]:
        rows = rows.mapInArrow(partial(run, sent=one), rows.schema)
    return rows


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds what earlier passes found in the same text: hits of any pass are hits."""
    out = []
    for found, earlier in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        every = [found, *(earlier or [])]
        bits = [np.frombuffer(f["hit"], dtype=np.uint8) for f in every if f["hit"]]
        hit = np.bitwise_or.reduce(bits) if bits else None
        found["hit"] = None if hit is None else hit.tobytes()
        found["n_hit"] = 0 if hit is None else int(np.unpackbits(hit).sum())
        found["items"] = sorted({item for f in every for item in f["items"]})
        found["matches"] = [m for f in every for m in f["matches"]]
        out.append(found)
    return batch.set_column(1, batch.schema.field(1), pa.array(out, type=batch.schema.field(1).type))


def _judge(batch: pa.RecordBatch, block: TestBlock | SimpleNamespace) -> pa.RecordBatch:
    doc, place, window, counts = search_shard(batch.column(1).to_pylist(), block)
    before = batch.column(2).to_pylist()
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
    out = []
    for row, n in enumerate(counts.tolist()):
        old = before[row] or {"n_words": n, "n_hit": 0, "hit": None, "items": [], "matches": []}
        if bounds[row] == bounds[row + 1]:
            out.append(old)
            continue
        mine = order[bounds[row] : bounds[row + 1]]
        hit = np.unpackbits(np.frombuffer(old["hit"], dtype=np.uint8))[:n].astype(bool) if old["hit"] else np.zeros(n, dtype=bool)
        cover = np.zeros(n + 1, dtype=np.int64)
        np.add.at(cover, place[mine], 1)
        np.add.at(cover, place[mine] + block.lengths[window[mine]], -1)
        hit |= np.cumsum(cover[:-1]) > 0
        items = {block.owners[w] for w in window[mine].tolist()} - {None} | set(old["items"])
        matches = old["matches"] + _longest(place[mine], window[mine], block)
        out.append({"n_words": n, "n_hit": int(hit.sum()), "hit": np.packbits(hit).tobytes(), "items": sorted(items), "matches": matches})
    return batch.set_column(2, batch.schema.field(2), pa.array(out, type=batch.schema.field(2).type))


def _longest(place: np.ndarray, window: np.ndarray, block: TestBlock | SimpleNamespace) -> list[dict]:
    """The longest verbatim match of each item in one document: consecutive windows on one diagonal join up."""
    best: dict[int | None, dict] = {}
    runs: dict[tuple, tuple[int, int]] = {}
    for at, w in sorted(zip(place.tolist(), window.tolist(), strict=True)):
        item, item_at, length = block.owners[w], int(block.places[w]), int(block.lengths[w])
        key = (item, at - item_at)
        first, end = runs.get(key, (at, at))
        first = first if at <= end else at
        runs[key] = (first, at + length)
        if item not in best or best[item]["words"] < at + length - first:
            best[item] = {"item": item, "item_at": first - (at - item_at), "doc_at": first, "words": at + length - first}
    return list(best.values())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_hit, items, matches, contaminated."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return search(rows, benchmark, **how).select(
        F.col("row.id").alias(id_col), "found.n_words", "found.n_hit", "found.items", "found.matches", (F.col("found.n_hit") > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that share no window with any benchmark item, with all their columns."""
    return search(docs, benchmark, text_col, **how).where("found.n_hit = 0").select("row.*")
