"""Removal of word sequences that an earlier document already holds.

Every window of words belongs to the segment of neighbouring windows with the same anchor, the least of
the hashes of the short word runs inside the window. Equal windows have equal anchors, so they meet in
the same shard, and no document is compared with a shard that it shares no anchor with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import words
from tidemark.llm.fm_index import FMIndex
from tidemark.shared import keep

WINDOW = 13
RUN = 4
#: Bits of the filter of shared anchors that every worker holds: 16 MB at most.
FILTER_BITS = 1 << 27
#: Words of one shard, about.
SHARD_WORDS = 1_500_000
#: Bytes of a word's hash that travel to a shard.
_BYTES = 6
_WORD = re.compile("[^\x20\x09-\x0d]+")
_CHUNK = 2_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW, run: int = RUN):
    """Segments of texts laid end to end: first word, number of windows, anchor and text of each.

    ``ends`` holds where each text ends. All windows of a segment lie in one text.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    runs = np.zeros(len(hashes) - run + 1, np.uint64)
    for j in range(run):
        runs = _mixed(runs * np.uint64(31) + hashes[j : j + len(runs)])
    marked = (runs & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(runs), dtype=np.uint64)
    least, reach, span = marked, 1, window - run + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: n], least[span - reach : span - reach + n])
    at = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + window <= ends[owner]
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(change & inside)
    bounds = np.flatnonzero(change | ~inside)
    following = np.searchsorted(bounds, first, side="right")
    stop = np.where(following < len(bounds), bounds[np.minimum(following, len(bounds) - 1)], n)
    return first, stop - first, runs[at[first]], owner[first]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about ``_CHUNK`` words, their hashes end to end, and where each row ends."""
    for batch in batches:
        sizes = np.diff(batch.column("hashes").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int32)
        group = np.cumsum(sizes, dtype=np.int64) // _CHUNK
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]]).astype(int)
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high > low:
                part = batch.slice(low, high - low)
                hashes = part.column("hashes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield part, hashes, np.cumsum(sizes[low:high], dtype=np.int64)


def _long_runs(hashes: np.ndarray, ends: np.ndarray, size: int = 4 * _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of a chunk; a very long chunk is read in overlapping slices so that places fit the marks."""
    for low in range(0, max(len(hashes) - WINDOW + 1, 1), size):
        stop = min(low + size + WINDOW - 1, len(hashes))
        cut = np.minimum(np.maximum(ends - low, 0), stop - low)
        first, count, anchor, owner = segments(hashes[low:stop], cut)
        yield first + low, count, anchor, owner


def _contents(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the words of every segment, its length included."""
    length = count + WINDOW - 1
    found = _mixed(length.astype(np.uint64))
    order = np.argsort(-length, kind="stable")
    alive = len(order)
    ordered = length[order]
    for j in range(int(ordered[0]) if len(ordered) else 0):
        alive = int(np.searchsorted(-ordered, -j, side="left"))
        some = order[:alive]
        found[some] = _mixed(found[some] * np.uint64(31) + hashes[first[some] + j])
    return found


class Shared:
    """Which anchors may lie in several documents, and which of them are so frequent that each of their windows goes its own way."""

    def __init__(self, words: np.ndarray, hot: np.ndarray):
        self.words, self.hot = words, hot

    def survivors(self, hashes: np.ndarray, ends: np.ndarray):
        """Segments of a chunk with a shared anchor; those with a hot one are cut into single windows."""
        found = []
        for first, count, anchor, owner in _long_runs(hashes, ends):
            slot = anchor & np.uint64(len(self.words) * 64 - 1)
            chosen = (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            first, count, anchor, owner = first[chosen], count[chosen], anchor[chosen], owner[chosen]
            hot = np.isin(anchor, self.hot)
            if hot.any():
                times = np.where(hot, count, 1)
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, owner, cut = np.repeat(first, times) + offset, np.repeat(owner, times), np.repeat(hot, times)
                count, anchor = np.where(cut, 1, np.repeat(count, times)), np.repeat(anchor, times)
                anchor[cut] = _contents(hashes, first[cut], count[cut])
            found.append((first, count, anchor, owner))
        first, count, anchor, owner = (np.concatenate(x) for x in zip(*found))
        return first, count, anchor, owner, _contents(hashes, first, count)


def _shared_anchors(rows: DataFrame, hot_least: int) -> tuple[Shared, int]:
    """Filter of the anchors that at least two rows hold, as a bitmap of bounded size, and the words in their segments."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, ends in _chunks(batches):
            for _, _, anchor, owner in _long_runs(hashes, ends):
                order = np.lexsort((owner, anchor))
                anchor, owner = anchor[order], owner[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64))], ["anchor"])

    counted = rows.select("hashes").mapInArrow(anchors, "anchor bigint").groupBy("anchor").count().where("count > 1")
    counted = keep(counted, "anchors")
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = counted.where(F.col("count") >= max(hot_least, total // 10_000)).select("anchor").toArrow()
    slot = F.col("anchor").bitwiseAND(FILTER_BITS - 1)
    bit = F.expr("shiftleft(1L, cast(anchor & 63 AS int))")
    # One row per word of the bitmap reaches the driver, a fixed number at most.
    table = counted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Shared(bits, hot["anchor"].to_numpy().astype(np.int64).view(np.uint64)), total * (WINDOW + RUN)


def _statistics(contents: pa.Table) -> pa.Table:
    """Intervals of the segments of one shard that occur elsewhere, or in several documents, with the least of those.

    Rows of equal content are united first. The index holds every content once; each of its windows is
    searched, and the least document among the suffixes found is the least that holds the window.
    """
    empty = pa.table({"content": pa.array([], pa.int64()), "from": pa.array([], pa.int32()), "upto": pa.array([], pa.int32()), "least": pa.array([], pa.int64())})
    if not contents.num_rows:
        return empty
    key = contents["content"].to_numpy()
    low, high = contents["least"].to_numpy(), contents["most"].to_numpy()
    unique, place, inverse = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(unique), np.iinfo(np.int64).max)
    most = np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, low)
    np.maximum.at(most, inverse, high)
    column = contents["words"].combine_chunks().take(pa.array(place)).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    stored = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _BYTES)
    raw = np.zeros((len(stored), 8), np.uint8)
    raw[:, :_BYTES] = stored
    raw = raw.view(np.uint64).ravel()
    length = np.diff(offsets) // _BYTES
    start = np.cumsum(length) - length + np.arange(len(length))
    names, symbols = np.unique(raw, return_inverse=True)
    text = np.zeros(len(raw) + len(length), np.int64)
    owner = np.repeat(np.arange(len(length)), length + 1)
    solid = np.ones(len(text), bool)
    solid[start + length] = False
    text[solid] = symbols + 1
    index = FMIndex(text, len(names) + 1, WINDOW)
    windows = length - WINDOW + 1
    segment = np.repeat(np.arange(len(length)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    holder = least[owner][index.order]
    found = least[segment].copy()
    for block in range(0, len(segment), 1 << 19):
        here = slice(block, block + (1 << 19))
        reached, left, right = index.statistics(text, start[segment[here]] + offset[here] + WINDOW, WINDOW)
        several = np.flatnonzero((reached == WINDOW) & (right - left > 1))
        if len(several):
            intervals, which = np.unique(left[several], return_inverse=True)
            stops = np.zeros(len(intervals), np.int64)
            stops[which] = right[several]
            # Matches of full length have disjoint intervals, so one pass gives the least of each.
            bounds = np.stack([intervals, stops], axis=1).ravel()
            sentinel = np.append(holder, np.iinfo(np.int64).max)
            found[here][several] = np.minimum(found[here][several], np.minimum.reduceat(sentinel, bounds)[::2][which])
    useful = found < most[segment]
    change = np.ones(len(found), bool)
    change[1:] = (segment[1:] != segment[:-1]) | (found[1:] != found[:-1])
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], len(found))
    chosen = useful[begin]
    begin, stop = begin[chosen], stop[chosen]
    return pa.table(
        {
            "content": pa.array(unique[segment[begin]]),
            "from": pa.array(offset[begin].astype(np.int32)),
            "upto": pa.array((offset[stop - 1] + WINDOW).astype(np.int32)),
            "least": pa.array(found[begin]),
        }
    )


@arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n_words, n_removed, kept = [], [], []
    for text, found in zip(texts, spans):
        own = _WORD.findall(text.as_py() or "")
        change = np.zeros(len(own) + 1, np.int64)
        for span in found.as_py() or []:
            change[span["from"]] += 1
            change[span["upto"]] -= 1
        gone = np.cumsum(change[:-1]) > 0
        n_words.append(len(own))
        n_removed.append(int(gone.sum()))
        kept.append(" ".join([w for w, g in zip(own, gone.tolist()) if not g]))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_least: int = 20_000) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept) per row of ``docs``; other columns are ignored.

    A word goes if a window of thirteen words that covers it also starts in a row with a smaller id;
    ``kept`` joins the others by one space. Null and empty texts have no words. A row with a null id
    neither loses words nor makes others lose any. Rows that repeat an id are judged one by one.

    Anchors are counted first; a bitmap of those found in several rows, of fixed size, prunes the
    segments that can be repeated nowhere. The others go to shards by anchor, each content once per task.
    Anchors with ``hot_least`` rows or more (a ten-thousandth of all segments at least, so that their
    list stays short) spread over all shards, window by window.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    row = F.xxhash64("doc_id", "text")
    hashed = named.where("doc_id IS NOT NULL").select("doc_id", row.alias("row"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    shared, total = _shared_anchors(hashed, hot_least)
    shards = max(1, -(-total // SHARD_WORDS))
    session = docs.sparkSession
    known = session.sparkContext.broadcast((shared.words, shared.hot))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Shared(*known.value)
        for part, hashes, ends in _chunks(batches):
            first, count, anchor, owner, content = filter_.survivors(hashes, ends)
            ids = part.column("doc_id").to_numpy()[owner]
            order = np.lexsort((ids, content))
            new = np.ones(len(order), bool)
            new[1:] = content[order][1:] != content[order][:-1]
            begin = np.flatnonzero(new)
            chosen = order[begin]
            last = order[np.append(begin[1:], len(order)) - 1] if len(order) else order
            length = (count[chosen] + WINDOW - 1).astype(np.int64)
            places = np.concatenate([[0], np.cumsum(length)])
            at = np.arange(places[-1]) - np.repeat(places[:-1], length) + np.repeat(first[chosen], length)
            symbols = np.ascontiguousarray(hashes[at].view(np.uint8).reshape(-1, 8)[:, :_BYTES])
            data = pa.Array.from_buffers(pa.large_binary(), len(chosen), [None, pa.py_buffer((places * _BYTES).astype(np.int64)), pa.py_buffer(symbols)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((anchor[chosen] % np.uint64(shards)).astype(np.int32)),
                    pa.array(content[chosen].view(np.int64)),
                    data.cast(pa.binary()),
                    pa.array(ids[chosen]),
                    pa.array(ids[last]),
                ],
                ["shard", "content", "words", "least", "most"],
            )

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Shared(*known.value)
        for part, hashes, ends in _chunks(batches):
            first, _, _, owner, content = filter_.survivors(hashes, ends)
            start = first - (ends[owner] - np.diff(np.concatenate([[0], ends]))[owner])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(content.view(np.int64)),
                    pa.array(part.column("doc_id").to_numpy()[owner]),
                    pa.array(part.column("row").to_numpy()[owner]),
                    pa.array(start.astype(np.int32)),
                ],
                ["content", "doc_id", "row", "start"],
            )

    held = hashed.select("doc_id", "hashes").mapInArrow(contents, "shard int, content bigint, words binary, least bigint, most bigint")
    found = held.groupBy("shard").applyInArrow(_statistics, "content bigint, from int, upto int, least bigint")
    placed = hashed.mapInArrow(postings, "content bigint, doc_id bigint, row bigint, start int")
    hits = placed.join(found, "content").where("least < doc_id")
    span = F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("upto")).alias("upto"))
    spans = hits.groupBy("doc_id", "row").agg(F.collect_set(span).alias("spans"))
    joined = named.withColumn("row", row).join(spans, ["doc_id", "row"], "left")
    own = words(F.col("text"))
    whole = F.struct(F.size(own).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(own, " ").alias("kept"))
    touched = F.col("spans").isNotNull()
    cut = _without(F.when(touched, F.col("text")), F.col("spans"))
    return joined.select("doc_id", F.when(touched, cut).otherwise(whole).alias("found")).select("doc_id", "found.*")
