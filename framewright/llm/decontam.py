"""Benchmark decontamination with a distributed positional inverted index.

The index holds all terms of the corpus, is partitioned by document and stored in the shared folder: for each document
its terms (64 bits of hash), each with its list of positions.  It does not depend on a benchmark, so further benchmarks are
searched without reading the documents again.  Corpus counts of a benchmark's terms order every window from its
rarest term on; the lists of a window, shifted back by the terms' offsets, are intersected in that order.  What
survives all lists is an exact phrase match; with slack, lists are met within that many words: proximity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import durable, release

#: Bytes become spaces unless they are ASCII letters or digits or part of a longer UTF-8 sequence; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Benchmark words that one pass over the index serves: their windows, about 60 bytes each, are sent to every executor.
BLOCK_WORDS = 2_000_000
#: Document words that are intersected at once.
CHUNK_WORDS = 2_000_000


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in tokens], dtype=np.uint64).view(np.int64)


@dataclass
class Windows:
    """Different windows of a block of items, in flat arrays.

    terms: sorted hashes.  by_length: for each window length, the windows' terms as places in `terms` (one row each), the
    offsets of each row from its rarest term on, and the number of its first window.  The items of window w are
    `items[starts[w]:starts[w + 1]]`, places in ids.
    """

    terms: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, int]]
    starts: np.ndarray
    items: np.ndarray
    ids: list

    def order(self, counts: np.ndarray) -> None:
        """Put the rarest term of every window first; equal counts by place."""
        self.by_length = [(g, np.argsort(counts[g], axis=1, kind="stable").astype(np.int32), at) for g, _, at in self.by_length]


def windows(items: list[tuple[object, bytes]], n: int) -> Windows:
    ids = list(dict.fromkeys(k for k, _ in items))
    place = {k: i for i, k in enumerate(ids)}
    tokens = [(place[k], _hashes(words(raw))) for k, raw in items]
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(t for _, t in tokens)]))
    rows: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, t in tokens:
        if len(t):
            size = min(n, len(t))
            rows.setdefault(size, []).append((item, np.lib.stride_tricks.sliding_window_view(np.searchsorted(terms, t).astype(np.int32), size)))
    by_length, starts, owners, at = [], [np.zeros(1, np.int64)], [], 0
    for size in sorted(rows):
        grams = np.concatenate([g for _, g in rows[size]])
        owner = np.repeat([i for i, _ in rows[size]], [len(g) for _, g in rows[size]]).astype(np.int32)
        grams, which = np.unique(grams, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0)
        by_length.append((grams, np.zeros((0, size), np.int32), at))
        starts.append(starts[-1][-1] + np.cumsum(np.bincount(pairs[:, 0], minlength=len(grams))))
        owners.append(pairs[:, 1].astype(np.int32))
        at += len(grams)
    return Windows(terms, by_length, np.concatenate(starts), np.concatenate([np.zeros(0, np.int32), *owners]), ids)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, terms, counts, gaps), stored: positions of all terms of each document, as steps from one to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, t_off, p_off, all_t, all_n, all_g = [], [0], [0], [], [], []
            for x in b.column(1):
                h = _hashes(words(x.as_buffer().to_pybytes()) if x.is_valid else [])
                n_words.append(len(h))
                at = np.argsort(h, kind="stable").astype(np.int32)
                h = h[at]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                gaps = np.diff(at, prepend=np.int32(0))
                gaps[first] = at[first]
                all_t.append(h[first])
                all_n.append(np.diff(first, append=len(h)).astype(np.int32))
                all_g.append(gaps.astype(np.int32))
                t_off.append(t_off[-1] + len(first))
                p_off.append(p_off[-1] + len(h))
            flat = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), flat(v, kind)) for o, v, kind in ((t_off, all_t, np.int64), (t_off, all_n, np.int32), (p_off, all_g, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *lists], ["id", "n_words", "terms", "counts", "gaps"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, n_words long, terms array<long>, counts array<int>, gaps array<int>")
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "decontam-index")


def _places(terms: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of terms: which are known, and their places."""
    at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
    there = known[at] == terms if len(known) else np.zeros(len(terms), dtype=bool)
    return there, at[there]


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in the corpus; the driver gets one row per term of the benchmark block."""
    shared, n_terms = index.sparkSession.sparkContext.broadcast(terms), len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            t, n = (c.flatten().to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1)))
            there, at = _places(t, shared.value)
            if len(at):
                total += np.bincount(at, weights=n[there], minlength=n_terms).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def _survivors(starts: np.ndarray, lists: list[tuple[np.ndarray, int]], slack: int) -> np.ndarray:
    """Starts for which every list has a position within slack of start + offset."""
    for positions, offset in lists:
        if not len(starts) or not len(positions):
            return starts[:0]
        want = starts + offset
        at = np.searchsorted(positions, want - slack)
        starts = starts[(at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] <= want + slack)]
    return starts


def _match(term: np.ndarray, pos: np.ndarray, bases: np.ndarray, size: int, win: Windows, slack: int):
    """Spans, items and near items by document of a chunk; pos counts through all its documents, with gaps between."""
    order = np.argsort(term, kind="stable")
    term, pos = term[order], pos[order]
    ends = np.searchsorted(term, np.arange(len(win.terms) + 1))
    have = np.diff(ends) > 0
    cover = np.zeros(size + 1, dtype=np.int32)
    exact, near = [], []
    for grams, offsets, at in win.by_length:
        length = grams.shape[1]
        for row in np.flatnonzero(have[grams].all(axis=1)):
            lists = [(pos[ends[t] : ends[t + 1]], int(o)) for t, o in zip(grams[row][offsets[row]], offsets[row], strict=True)]
            first, offset = lists[0]
            close = _survivors(first - offset, lists[1:], slack)
            if not len(close):
                continue
            # the rarest term stands in the document; with slack, the window's start may lie before it
            near.append((at + row, np.unique(np.searchsorted(bases, close + offset, side="right") - 1)))
            hit = _survivors(close, lists[1:], 0) if slack else close
            if len(hit):
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + length, -1)
                exact.append((at + row, np.unique(np.searchsorted(bases, hit, side="right") - 1)))
    return np.cumsum(cover[:-1]) > 0, exact, near


def match(index: DataFrame, win: Windows, n: int, slack: int, item_type: str) -> DataFrame:
    """(row, id, n_words, n_hit, spans, items, near_items) of every indexed document; slack: words that proximity allows."""
    shared = index.sparkSession.sparkContext.broadcast(win)
    gap = n + slack + 1
    id_type = index.schema["id"].dataType.simpleString()

    def chunk(n_words, terms, reps, gaps, t_len):
        win = shared.value
        bases = np.cumsum(n_words + gap) - n_words  # each document stands behind a gap that no window crosses
        there, place = _places(terms, win.terms)
        doc = np.repeat(np.arange(len(n_words)), t_len)[there]
        steps, reps = gaps[np.repeat(there, reps)], reps[there]
        # steps to positions: a running sum within each (document, term) list
        total = np.cumsum(steps, dtype=np.int64)
        starts = np.cumsum(reps) - reps
        carried = np.where(starts > 0, total[starts - 1], 0) if len(starts) else np.zeros(0, np.int64)
        pos = total - np.repeat(carried - bases[doc], reps)
        size = int(bases[-1] + n_words[-1] + gap)
        hit, exact, near = _match(np.repeat(place, reps), pos, bases, size, win, slack)
        items, close = [set() for _ in n_words], [set() for _ in n_words]
        for found, out in ((exact, items), (near, close)):
            for w, docs in found:
                for d in docs:
                    out[d].update(win.items[win.starts[w] : win.starts[w + 1]].tolist())
        edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans, n_hit = [[] for _ in n_words], np.zeros(len(n_words), dtype=np.int64)
        for d, a, b in zip(np.searchsorted(bases, begin, side="right") - 1, begin, end, strict=True):
            spans[d].append({"start": int(a - bases[d]), "stop": int(b - bases[d])})
            n_hit[d] += b - a
        return n_hit, spans, [[win.ids[i] for i in sorted(s)] for s in items], [[win.ids[i] for i in sorted(s)] for s in close]

    span_t = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kind = pa.list_(pa.int64() if item_type == "bigint" else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = b.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(n_words + gap) // CHUNK_WORDS)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                t_len = np.diff(part.column(3).offsets.to_numpy()).astype(np.int64)
                terms, reps, gaps = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4, 5))
                n_hit, spans, items, close = chunk(n_words[lo:hi], terms, reps.astype(np.int64), gaps, t_len)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n_hit), pa.array(spans, span_t), pa.array(items, kind), pa.array(close, kind)], ["row", "id", "n_words", "n_hit", "spans", "items", "near_items"])

    found = index.mapInArrow(run, f"row long, id {id_type}, n_words long, n_hit long, spans array<struct<start: long, stop: long>>, items array<{item_type}>, near_items array<{item_type}>")
    out = durable(found, "decontam-found")
    shared.unpersist()
    return out


def _blocks(rows: Iterator, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of about block_words words, one block at a time; there is one at least."""
    block, size, any_block = [], 0, False
    for key, raw in ((r[0], bytes(r[1] or b"")) for r in rows):
        block.append((key, raw))
        size += raw.count(b" ") + 1
        if size >= block_words:
            yield block
            block, size, any_block = [], 0, True
    if block or not any_block:
        yield block


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", n: int = 10, slack: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What `decontaminate` returns, from an index that build_index has stored; id is named `id`."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    if item_type in ("int", "smallint", "tinyint"):
        item_type = "bigint"
    elif item_type != "bigint":
        item_type = "string"
    rows = benchmark.select(F.col(item_col).cast(item_type), F.col(item_text).cast("binary"))
    parts = []
    for block in _blocks(rows.toLocalIterator(), block_words):
        win = windows(block, n)
        win.order(term_counts(index, win.terms))
        parts.append(match(index, win, n, slack, item_type))
    out = parts[0] if len(parts) == 1 else _merged(parts)
    return out.drop("row").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, slack: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, spans (word ranges of exact phrases), items, near_items, contaminated.

    A window is n consecutive words of an item, or the whole item where it has fewer.  items: ids with a window that
    occurs; near_items: ids with a window whose words all occur within `slack` words of their places (items included).
    The benchmark is read in blocks of about block_words words, one block at a time; each costs a pass over the index.
    Words are equal if 64 bits of their hashes are.

    Null or empty text: no words, no items.  Null item ids are an id like others (null in the lists).  Repeated
    items count once.  Repeated documents: a row each.  Empty tables: no rows, or no items.  Documents of any length are
    matched whole.  Other columns are not read.
    """
    index = build_index(docs, id_col, text_col)
    out = search(index, benchmark, item_col, item_text, n, slack, block_words).withColumnRenamed("id", id_col)
    release(index)
    return out


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Blocks' answers by document: items are joined, overlapping spans become one.  Later blocks add only the documents that they have found something in."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p.where(F.size("near_items") > 0))
    grouped = every.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
    start = "cast(array() as array<struct<start: bigint, stop: bigint>>)"
    spans = F.expr(f"aggregate(spans, {start}, (a, s) -> if(size(a) > 0 and element_at(a, -1).stop >= s.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, s.stop)))), concat(a, array(s))))")
    grouped = grouped.withColumn("spans", spans).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)"))
    return grouped.select("row", "id", "n_words", "n_hit", "spans", "items", "near_items")
