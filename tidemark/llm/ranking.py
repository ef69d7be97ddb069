"""Ranked lexical search: branch and bound over a trie of restricted term vectors.

Documents are reduced to the terms that the items ask for. Blocks of documents become a trie whose paths
list their terms, the most frequent first, so that common beginnings are shared. A node knows the greatest
frequency of every term and the least length factor below it, which together bound the score of every
document there. Each item goes down the trie depth first, best bound first, and leaves out what cannot
reach its best documents so far.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import keep

# Fixed values of the score: scale of the weights, of the saturation and of the length factor.
_WEIGHT, _SCALE, _FLAT, _STEEP, _SLOPE = 1000, 1_000_000_000, 75, 25, 12
#: Bytes read as terms, A-Z as a-z; all others separate.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text that are split at once.
_SLICE = 1 << 20
#: Postings of a block, and documents a leaf of the trie holds.
_POSTINGS, _LEAF = 1 << 20, 64
#: Bytes of the items that are searched in one pass over the documents.
_ITEMS = 8 << 20


def term_runs(text: str) -> Iterator[list[bytes]]:
    """Terms of a text in order, a long text in slices that end between terms."""
    raw = text.encode().translate(_FOLD)
    start = 0
    while len(raw) - start > _SLICE:
        cut = raw.find(b" ", start + _SLICE)
        if cut < 0:
            break
        yield raw[start:cut].split(b" ")
        start = cut
    yield raw[start:].split(b" ")


def term_counts(text: str) -> Counter:
    found: Counter = Counter()
    for run in term_runs(text):
        found.update(run)
    found.pop(b"", None)
    return found


def vectors(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """Written rows (doc_id, n, terms, tfs): number of all terms, and those among ``terms`` with their frequencies."""
    code = {t: i for i, t in enumerate(terms)}

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, own, tfs = [], [0], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py() or "")
                sizes.append(sum(found.values()))
                held = found.keys() & code.keys()
                own += [code[t] for t in held]
                tfs += [found[t] for t in held]
                places.append(len(own))
            at = pa.array(places, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(own, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return keep(rows.mapInArrow(restricted, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"), "vectors")


@dataclass(frozen=True)
class Items:
    """Items as counts of terms, by code, and the weights of the terms. Codes ascend from the most frequent term."""

    counts: list[dict[int, int]]
    weights: np.ndarray

    def prices(self, item: int) -> np.ndarray:
        """Weight of every term for one item, 0 for terms it does not hold; repeats count."""
        price = np.zeros(len(self.weights), np.int64)
        for code, times in self.counts[item].items():
            price[code] = times * self.weights[code]
        return price


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight: more for a greater tf, less for a greater m."""
    return (_SCALE * tf) // (1000 * tf + _SLOPE * m)


class Trie:
    """Documents of a block in the order of their paths, and for every node what bounds the scores below it.

    Nodes are runs of documents that share the beginning of their path; children of a node that together
    hold few documents are one leaf. The entries of all children of a node lie side by side.
    """

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray):
        """Terms of a document ascend by code. No document is empty."""
        names = terms.astype(">u4").tobytes()
        order = sorted(range(len(m)), key=lambda i: names[4 * offsets[i] : 4 * offsets[i + 1]])
        sizes = np.diff(offsets)[order]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(offsets[:-1][order] - self.offsets[:-1], sizes) + np.arange(self.offsets[-1])
        self.terms, self.tfs, self.m, self.ids = terms[take], tfs[take], m[order], ids[order]
        self.value = saturation(self.tfs, np.repeat(self.m, sizes))
        self.best = np.zeros(int(terms.max()) + 1, np.int64)
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        shared = self._shared()
        self._build(0, len(m), shared)
        self.bounds = [self._bounds(own) for own in self.children]

    def _shared(self) -> np.ndarray:
        """Number of terms every document's path has in common with the one before it."""
        n = len(self.m)
        shared = np.zeros(n, np.int64)
        alive = np.arange(1, n)
        depth = 0
        sizes = np.diff(self.offsets)
        while len(alive):
            alive = alive[(sizes[alive] > depth) & (sizes[alive - 1] > depth)]
            alive = alive[self.terms[self.offsets[alive] + depth] == self.terms[self.offsets[alive - 1] + depth]]
            shared[alive] += 1
            depth += 1
        return shared

    def _build(self, low: int, high: int, shared: np.ndarray) -> int:
        """Add the node of the documents from ``low`` to ``high`` and all below it, without recursion; return its number."""
        root = self._node(low, high)
        todo = [root]
        made = []
        while todo:
            node = todo.pop()
            made.append(node)
            low, high = self.ranges[node]
            if high - low <= _LEAF:
                continue
            inside = shared[low + 1 : high]
            starts = low + 1 + np.flatnonzero(inside == inside.min())
            edges = [low, *starts.tolist(), high]
            # Small children that follow each other are one leaf; equal documents are cut by number.
            begin = low
            own = []
            for left, right in zip(edges, edges[1:]):
                if right - left > _LEAF or right - begin > _LEAF:
                    if left > begin:
                        own.append(self._node(begin, left))
                    begin = left
                if right - left > _LEAF:
                    own.append(self._node(left, right))
                    begin = right
            if high > begin:
                own.append(self._node(begin, high))
            self.children[node] = own
            todo += own
        for node in reversed(made):
            self.entries[node] = self._maxima(node)
        return root

    def _node(self, low: int, high: int) -> int:
        self.ranges.append((low, high))
        self.children.append([])
        self.entries.append(None)
        return len(self.ranges) - 1

    def _maxima(self, node: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms below a node, their greatest frequencies, and the least m."""
        low, high = self.ranges[node]
        if self.children[node]:
            parts = [self.entries[c] for c in self.children[node]]
            terms, tfs, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), min(p[2] for p in parts)
        else:
            own = slice(self.offsets[low], self.offsets[high])
            terms, tfs, m = self.terms[own], self.tfs[own], int(self.m[low:high].min())
        np.maximum.at(self.best, terms, tfs)
        held = np.unique(terms)
        tfs = self.best[held]
        self.best[held] = 0
        return held, tfs, m

    def _bounds(self, children: list[int]):
        if not children:
            return None
        parts = [self.entries[c] for c in children]
        places = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])[:-1]])
        return np.concatenate([p[0] for p in parts]), np.concatenate([saturation(p[1], np.int64(p[2])) for p in parts]), places

    def search(self, price: np.ndarray, best: list[tuple[int, int, int]], top: int) -> None:
        """Put the documents that belong to the ``top`` best of an item into its heap ``best`` of (score, -id, id is null)."""
        todo = [(math.inf, 0)]
        while todo:
            bound, node = todo.pop()
            least = best[0][0] if len(best) == top else 1
            if bound < least:
                continue
            if self.bounds[node] is None:
                self._judge(node, price, best, top)
                continue
            terms, value, places = self.bounds[node]
            bounds = np.add.reduceat(price[terms] * value, places)
            # The best child is searched first. Equal scores may still matter: the lesser id wins.
            for i in np.argsort(bounds).tolist():
                if bounds[i] >= least:
                    todo.append((int(bounds[i]), self.children[node][i]))

    def _judge(self, node: int, price: np.ndarray, best: list[tuple[int, int, int]], top: int) -> None:
        low, high = self.ranges[node]
        places = self.offsets[low : high + 1]
        own = slice(places[0], places[-1])
        scores = np.add.reduceat(price[self.terms[own]] * self.value[own], places[:-1] - places[0])
        least = best[0][0] if len(best) == top else 1
        for i in np.flatnonzero(scores >= least).tolist():
            found = (int(scores[i]), *self.ids[low + i])
            if len(best) < top:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)


def _blocks(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[Trie]:
    """Tries of about ``_POSTINGS`` postings each, in the order of the rows."""
    rows: list[tuple] = []
    held = 0

    def trie() -> Trie:
        sizes = np.concatenate([r[0] for r in rows])
        ids = [key for r in rows for key in r[4]]
        terms, tfs, m = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
        keys = np.empty(len(ids), object)
        keys[:] = ids
        return Trie(offsets, terms[order], tfs[order], m, keys)

    for batch in batches:
        for low in range(0, batch.num_rows, 1024):
            part = batch.slice(low, 1024)
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            ids = part.column(0).to_pylist()
            keys = [(-ids[i], 0) if ids[i] is not None else (-math.inf, 0) for i in some]
            m = part.column(1).to_numpy(zero_copy_only=False)[some]
            rows.append((sizes[some], ranks[lists.flatten().to_numpy()], part.column(3).flatten().to_numpy(zero_copy_only=False), m, keys))
            held += int(sizes.sum())
            if held >= _POSTINGS:
                yield trie()
                rows, held = [], 0
    if rows:
        yield trie()


def _ranked(found: DataFrame, numbers: DataFrame, total: int, length: int, texts: list[str], terms: list[bytes], top: int) -> DataFrame:
    """Rows (item, doc_id, score): the best documents of every item among those of each task."""
    df = np.zeros(len(terms), np.int64)
    for row in numbers.collect():
        df[row["term"]] = row["df"]
    order = np.lexsort((np.arange(len(terms)), -df))
    ranks = np.empty(len(terms), np.int64)
    ranks[order] = np.arange(len(terms))
    weights = np.array([math.floor(_WEIGHT * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df[order]], np.int64)
    code = {t: int(r) for t, r in zip(terms, ranks)}
    items = Items([{code[t]: c for t, c in term_counts(t).items()} for t in texts], weights)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in items.counts]
        for trie in _blocks(batches, ranks):
            for item, own in enumerate(best):
                price = items.prices(item)[: len(trie.best)]
                trie.search(price, own, top)
        rows = [(item, None if key == -math.inf else -key, score) for item, own in enumerate(best) for score, key, _ in own]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    # Decimals: 25 times the length times the number of documents may pass 64 bits.
    m = f"{_FLAT} + CAST({_STEEP} AS DECIMAL(38, 0)) * n * {total}L DIV {max(length, 1)}L"
    return found.select("doc_id", F.expr(m).cast("long").alias("m"), "terms", "tfs").mapInArrow(searched, "item int, doc_id bigint, score bigint")


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Items that have terms, in blocks of about ``_ITEMS`` bytes."""
    block, held = [], 0
    for row in items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        held += len(row["text"]) + 100
        if held >= _ITEMS:
            yield block
            block, held = [], 0
    if block:
        yield block


def rank(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = 20,
) -> DataFrame:
    """The ``top`` best documents of every item: (item_id, rank, doc_id, score), scores above 0, ties by id, a null id last.

    Items are read in blocks of bounded size, all documents are searched for a block in one pass; terms and
    their document counts of one block, so many at most, travel to the tasks. A task keeps the best documents
    of each item and one block of postings. No list of a term is ever gathered, however frequent it is.
    Null and empty texts hold no terms, match nothing and are not counted. Repeated rows are ranked one by
    one, and so are items that repeat an id. Without items or documents there are no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    result = None
    for block in _item_blocks(items, item_id, item_text):
        texts = [t for _, t in block]
        terms = sorted({t for own in texts for t in term_counts(own)})
        if not terms:
            continue
        found = vectors(docs, terms, doc_id, text)
        stats = found.agg(F.count_if(F.col("n") > 0).alias("total"), F.sum("n").alias("length")).first()
        numbers = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        ranked = _ranked(found, numbers, stats["total"], stats["length"] or 0, texts, terms, top)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = ranked.withColumn("rank", place).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        own = keep(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        result = own if result is None else result.unionByName(own)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return result
