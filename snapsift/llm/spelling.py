"""Spelling variant grouping (11): k-d trees over letter-count vectors find the words that one edit can turn into each other.

One inserted, deleted or replaced letter changes a word's letter counts by an L1 distance of one (lengths differ by one) or two (same length: one count
falls, another rises). For each length a k-d tree, laid out on a bounded sample of the vocabulary, cuts the count vectors into boxes; every word is a point
of one box of its length's tree, and a query to all boxes within that distance, of its own length's tree and of the next length's. A task gets a
box's points and queries, searches the boxes of a finer tree over their distinct vectors, and verifies the order of letters: the letter that falls is
replaced, at each place where a query has it, by the one that rises (or the one that rises is inserted at each place), and the result is looked up among
the points and compared byte by byte. So anagrams cost their number, not its square. Boxes of more than ``CELL`` points or queries are cut by hashes.

Words are handled as bytes of ISO-8859-1, which has all their letters, in code-point order.

Defined results: a null text has no words and a null id is written as an empty one; words of any length are whole; repeated rows count as often as they
stand there; of near words with equal counts the first in code-point order is the form; a word without near words has none and is its own root; other
columns, of whatever name, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = r"[A-Za-zÀ-ÿ]"
#: Letters as bytes: a-z and the Latin-1 letters with the two signs among them.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
PLACE = np.zeros(256, dtype=np.int64)
PLACE[LETTERS] = np.arange(len(LETTERS))
#: Words on which the trees are laid out (every word is indexed), and the longest of them; a longer word's length has one box.
SAMPLE = 50_000
LONGEST = 64
#: Words that a box should hold, and points or queries that a task gets of one box.
BOX_WORDS = 8_000
CELL = 50_000
#: Distinct vectors that a box of a task's own tree holds, and rows of words that are verified together.
FINE = 16
ROWS = 100_000
POINT, SAME, SHORTER = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (string), word: every run of at least ``least`` letters, with A-Z lower-cased."""
    words = F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(words).alias("word"))
    lower = F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return found.select("id", F.when(F.col("word").rlike("[A-Z]"), lower).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """word (bytes), n: the distinct words of at least ``least`` letters that occur often enough. Counted in each task first."""
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)
    return counted.select(F.encode("word", "ISO-8859-1").alias("word"), "n")


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of bytes."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def vectors(matrix: np.ndarray) -> np.ndarray:
    """How often each word has each letter."""
    at = PLACE[matrix] + np.arange(len(matrix))[:, None] * len(LETTERS)
    return np.bincount(at.ravel(), minlength=len(matrix) * len(LETTERS)).reshape(len(matrix), -1).astype(np.int32)


def best_split(v: np.ndarray) -> tuple[int, int] | None:
    """The letter whose count, against its mean, halves the vectors best; none if all are equal."""
    at = np.floor(v.mean(axis=0))
    share = (v <= at).mean(axis=0)
    letter = int(np.abs(share - 0.5).argmin())
    return (letter, int(at[letter])) if share[letter] < 1 else None


def plant(v: np.ndarray, weight: float, first: int = 0) -> tuple:
    """A tree over sampled vectors, each of which stands for ``weight`` words, and the number after its last box's. A tree is a box's number or (letter, most on the left, left, right)."""
    split = best_split(v) if len(v) * weight > BOX_WORDS else None
    if split is None:
        return first, first + 1
    left = v[:, split[0]] <= split[1]
    low, following = plant(v[left], weight, first)
    high, following = plant(v[~left], weight, following)
    return (*split, low, high), following


def narrow(v, letter: int, at: int, down, up):
    """Which queries go to the side with at most ``at`` of a letter and which to the other, and the letters that fall or rise on the way.

    A query of the same length becomes its near word by one letter that falls (``down``) and a later one that rises (``up``), one of another
    length by one that rises; -1 stands for a letter that is not known yet, -2 for one that may not change.
    """
    now = v - (down == letter) + (up == letter)
    stays = now <= at
    falls = (now == at + 1) & (down == -1) & ((up == -1) | (letter < up))
    rises = (now == at) & (up == -1) & (down < letter)
    return stays | falls, np.where(falls, letter, down), ~stays | rises, np.where(rises, letter, up)


def visits(tree, v: np.ndarray, kind: int):
    """Pairs of a box's number and the rows that visit it: points their own box, queries all boxes that may hold a near word."""
    start = np.full(len(v), -1)
    stack = [(tree, np.arange(len(v)), start if kind == SAME else start - 1, start)]
    while stack:
        node, rows, down, up = stack.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        letter, at, low, high = node
        if kind == POINT:
            left = v[rows, letter] <= at
            right, fallen, risen = ~left, down, up
        else:
            left, fallen, right, risen = narrow(v[rows, letter], letter, at, down, up)
        stack.append((low, rows[left], fallen[left], up[left]))
        stack.append((high, rows[right], down[right], risen[right]))


def vector_pairs(points: np.ndarray, queries: np.ndarray, kind: int):
    """Arrays of rows (query, point) whose vectors are as far apart as one edit puts them, in the one direction that ``narrow`` follows."""
    start = np.full(len(queries), -1)
    stack = [(np.arange(len(points)), np.arange(len(queries)), start if kind == SAME else start - 1, start)]
    while stack:
        p, q, down, up = stack.pop()
        if not len(p) or not len(q):
            continue
        split = best_split(points[p]) if len(p) > FINE else None
        if split is None:
            for k in range(0, len(q), 1 << 12):
                some = q[k : k + (1 << 12)]
                near = np.abs(points[p][None] - queries[some][:, None]).sum(axis=2, dtype=np.int64) == (2 if kind == SAME else 1)
                a, b = np.nonzero(near)
                a, b = some[a], p[b]
                if kind == SAME:
                    change = points[b] - queries[a]
                    forward = change.argmin(axis=1) < change.argmax(axis=1)
                    a, b = a[forward], b[forward]
                yield a, b
            continue
        left, fallen, right, risen = narrow(queries[q, split[0]], *split, down, up)
        inside = points[p, split[0]] <= split[1]
        stack.append((p[inside], q[left], fallen[left], up[left]))
        stack.append((p[~inside], q[right], down[right], risen[right]))


def classes(v: np.ndarray):
    """The distinct vectors, the rows in order of their vector, and where each vector's rows start."""
    v = np.ascontiguousarray(v)
    _, first, of = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    return v[first], order, np.r_[0, np.cumsum(np.bincount(of.ravel(), minlength=len(first)))]


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, and whose they are."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


class Points:
    """Words of one length that can be looked up by the sum of their letters times powers of a base; a match is compared letter by letter."""

    def __init__(self, words: list[bytes]):
        self.m = letters(words)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.m.shape[1], _BASE)], dtype=np.uint64)
        sums = (self.m * self.power[:-1]).sum(axis=1, dtype=np.uint64)
        self.order = np.argsort(sums)
        self.sums = sums[self.order]

    def find(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which sum is which point's."""
        low, high = np.searchsorted(self.sums, sums, "left"), np.searchsorted(self.sums, sums, "right")
        at, of = spread(low, high - low)
        return of, self.order[at]

    def replaced(self, m: np.ndarray, fallen: np.ndarray, risen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, place = np.nonzero(m == fallen[:, None])
        sums = (m * self.power[:-1]).sum(axis=1, dtype=np.uint64)[row] + (risen[row].astype(np.uint64) - fallen[row].astype(np.uint64)) * self.power[place]
        of, p = self.find(sums)
        row = row[of]
        right = (self.m[p] != m[row]).sum(axis=1) == 1
        return row[right], p[right]

    def inserted(self, m: np.ndarray, risen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.zeros((len(m), m.shape[1] + 1), dtype=np.uint64)
        np.cumsum(m * self.power[: m.shape[1]], axis=1, dtype=np.uint64, out=upto[:, 1:])
        sums = upto + risen.astype(np.uint64)[:, None] * self.power[: upto.shape[1]] + (upto[:, -1:] - upto) * _BASE
        of, p = self.find(sums.ravel())
        row = of // upto.shape[1]
        before = np.logical_and.accumulate(self.m[p, :-1] == m[row], axis=1).sum(axis=1)
        after = np.logical_and.accumulate((self.m[p, 1:] == m[row])[:, ::-1], axis=1).sum(axis=1)
        right = before + after >= m.shape[1]
        return row[right], p[right]


def near_words(points: list[bytes], queries: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) of words that one edit turns into each other, in the one direction that ``narrow`` follows."""
    known, m = Points(points), letters(queries)
    pv, qv = vectors(known.m), vectors(m)
    used = np.flatnonzero(pv.any(axis=0) | qv.any(axis=0))
    kind_of = np.int16 if max(known.m.shape[1], m.shape[1]) < 1 << 14 else np.int32
    pv, _, _ = classes(pv[:, used].astype(kind_of))
    qv, order, starts = classes(qv[:, used].astype(kind_of))
    found = []
    for q, p in vector_pairs(pv, qv, kind):
        sizes = starts[q + 1] - starts[q]
        ends = np.cumsum(sizes)
        for k in range(0, int(ends[-1]) if len(ends) else 0, max(1, ROWS // m.shape[1])):
            some = slice(np.searchsorted(ends, k, "right"), np.searchsorted(ends, k + max(1, ROWS // m.shape[1]), "right"))
            at, of = spread(starts[q[some]], sizes[some])
            if not len(at):
                continue
            change = (pv[p[some]] - qv[q[some]])[of]
            words, risen = order[at], LETTERS[used[change.argmax(axis=1)]]
            row, point = known.replaced(m[words], LETTERS[used[change.argmin(axis=1)]], risen) if kind == SAME else known.inserted(m[words], risen)
            found.append(words[row] * len(points) + point)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs // len(points), pairs % len(points)


def search(cell: pa.Table) -> pa.Table:
    """For each word of a cell that has near words here: their number, and the most frequent one (of those the first in code-point order)."""
    words, side = cell.column("word").to_pylist(), cell.column("side").to_numpy()
    n = cell.column("n").to_numpy()
    points = np.flatnonzero(side == POINT)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for kind in (SAME, SHORTER):
        queries = np.flatnonzero(side == kind)
        if len(points) and len(queries):
            q, p = near_words([words[k] for k in points], [words[k] for k in queries], kind)
            a += [queries[q], points[p]]
            b += [points[p], queries[q]]
    a, b = np.concatenate(a), np.concatenate(b)
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
    counts = np.diff(np.r_[first, len(a)])
    return pa.table({"word": pa.array([words[k] for k in a[first]], pa.binary()), "n_near": counts, "near": pa.array([words[k] for k in b[first]], pa.binary()), "near_n": n[b[first]]})


def routed(vocab: DataFrame) -> DataFrame:
    """length, box, side, word, n: each word as a point of its box, and as a query to every box that may hold near words."""
    spark = vocab.sparkSession
    short = vocab.where(F.length("word") <= LONGEST)
    totals = dict(tuple(r) for r in short.groupBy(F.length("word")).count().collect())  # LONGEST rows at most
    share = SAMPLE / max(SAMPLE, sum(totals.values()))
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40))  # about SAMPLE words, the same ones on every run
    sample = [bytes(r[0]) for r in short.where(drawn).select("word").collect()]
    trees = {}
    for size in totals:
        of_size = [w for w in sample if len(w) == size]
        trees[size] = plant(vectors(letters(of_size)), totals[size] / len(of_size))[0] if of_size else 0
    shipped = spark.sparkContext.broadcast(trees)

    def run(batches):
        trees = shipped.value
        for whole in batches:
            for k in range(0, whole.num_rows, 10_000):
                batch = whole.slice(k, 10_000)
                words = batch.column(0).to_pylist()
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                for size in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == size)
                    v = vectors(letters([words[j] for j in own]))
                    for kind, into in ((POINT, size), (SAME, size), (SHORTER, size + 1)):
                        if into <= LONGEST and into not in trees:
                            continue
                        for box, rows in visits(trees.get(into, 0), v, kind):
                            part = batch.take(pa.array(own[rows]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x), t) for x, t in ((into, pa.int32()), (box, pa.int32()), (kind, pa.int32()))] + part.columns, names=["length", "box", "side", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "length int, box int, side int, word binary, n long")


def near(vocab: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: partial results, one for each word and cell in which it has near words."""
    rows = cut(routed(vocab))
    is_point = F.col("side") == POINT
    loads = rows.groupBy("length", "box").agg(F.count_if(is_point).alias("points"), F.count_if(~is_point).alias("queries"))
    large = loads.where((F.col("points") > CELL) | (F.col("queries") > CELL))  # one for each CELL rows at most, so it is small beside the rows
    parts = lambda c: F.ceil(F.coalesce(c, F.lit(1)) / CELL).cast("int")
    joined = rows.join(large, ["length", "box"], "left").select("length", "box", "side", "word", "n", parts(F.col("points")).alias("p"), parts(F.col("queries")).alias("q"))
    own = F.pmod(F.xxhash64("word"), F.when(is_point, F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_point, F.col("q")).otherwise(F.col("p")) - 1))
    dealt = joined.select("*", own.alias("own"), other.alias("other"))
    cells = dealt.select("length", "box", F.when(is_point, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(is_point, F.col("other")).otherwise(F.col("own")).alias("q"), "side", "word", "n")
    return cells.groupBy("length", "box", "p", "q").applyInArrow(search, "word binary, n_near long, near binary, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (``links``: word, root, without circles), by joins that double the steps taken."""
    links = cut(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ahead.where("moved").isEmpty():
            return links
        links = ahead.select("word", "root")


def variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: the form of a word is its most frequent near word, if that is at least ``ratio`` (> 1) times as frequent."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1, so that forms form no circle")
    vocab = cut(vocab)
    found = near(vocab).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")).alias("best"))
    own = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<order: long, near: binary>").alias("best"))
    words = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.order") >= ratio * F.col("n")
    words = cut(words.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n")))
    links = roots(words.where("form is not null").select("word", F.col("form").alias("root")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    joined = words.join(links, "word", "left")
    return joined.select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
