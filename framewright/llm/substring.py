"""Substring dedup over a compacted de Bruijn graph of words.

Nodes are sequences of k - 1 words; every window of k words is an edge from its first k - 1 words to its last k - 1.  To
keep the graph small, a first pass counts the windows' minimizers (the smallest hash of seven consecutive words in
the window, which equal windows share): windows whose minimizer occurs in one document only are unique and make no edge.

The other windows become edges with their coordinates (document, position).  An edge that documents share is known by
its first source.  Edges that meet at a node which one edge enters and one leaves, and which follow each other in their
source, are compacted: meeting the two ends of all edges at their nodes tells which nodes do not branch, and one window
along the coordinates of each source names every edge's path.  A document's edges then make claims, runs that advance
along one path.  Nodes are known by 64 bits of hash only, so every claim is joined with the words that stand at the
path's coordinates in its source and compared word by word; removal rests on claims that hold.  Windows of claims
that fail are met again by their words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bloom
from ._util import durable, release

#: Words of a minimizer; it must be less than a window.
MINIMIZER = 7
#: Bits of a minimizer's hash that are kept.  Chance repeats only add edges to look at.
KEPT = np.uint64((1 << 48) - 1)
#: The filter of repeated minimizers that Python workers hold: 2**30 bits are 128 MiB.  Beyond, more windows make edges.
MOST_BITS = 1 << 30
#: Rows of a batch that a Python worker builds before it hands them on.
BATCH_ROWS = 200_000

_A = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out *= _A
        out += h[j : j + n]
    return _mixed(out)


def _minimizers(h: np.ndarray, k: int) -> np.ndarray:
    """The minimizer of each window of k words."""
    m = min(MINIMIZER, k)
    g = _grams(h, m) & KEPT
    width, span = k - m + 1, 1
    while span < width:  # the minimum over `span` doubles until it covers the window
        step = min(span, width - span)
        g = np.minimum(g[: len(g) - step], g[step:])
        span += step
    return g


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in tokens], dtype=np.uint64)


def _bytes(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): key tells rows apart that share an id, by 64 bits of the text; it is 0 where the id is alone.

    Rows equal in id and text get equal results, so they may share a key.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = durable(src.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "substring-shared")
    n, hashed = shared.count(), F.xxhash64(F.lit(7), "text")
    if not n:
        return src.select("id", F.when(F.col("id").isNull(), hashed).otherwise(F.lit(0).cast("long")).alias("key"), "text")
    tested = _bloom.from_keys(shared, F.xxhash64("id"), n, "substring-shared-filter").maybe(src, F.xxhash64("id"), "maybe")
    return tested.select("id", F.when(F.col("id").isNull() | F.col("maybe"), hashed).otherwise(F.lit(0).cast("long")).alias("key"), "text")


def survey(docs: DataFrame, k: int) -> DataFrame:
    """(id, key, n_words, sha, minimizers) of documents (id, key, text as binary); sha is of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, off, flat = [], [], [0], []
            for x in b.column(2):
                tokens = _bytes(x).split()
                n.append(len(tokens))
                sha.append(hashlib.sha256(b" ".join(tokens)).digest())
                m = np.unique(_minimizers(_hashes(tokens), k)) if len(tokens) >= k else np.zeros(0, np.uint64)
                flat.append(m)
                off.append(off[-1] + len(m))
            values = pa.array(np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)], ["id", "key", "n_words", "sha", "minimizers"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key long, n_words long, sha binary, minimizers array<long>")


def edges(docs: DataFrame, repeated: np.ndarray, k: int, bits: int) -> DataFrame:
    """(u, v, id, key, pos, fresh) of every window whose minimizer is possibly repeated.

    u and v are the nodes that the edge joins; fresh: the first like it in its document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    kept = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, x in enumerate(b.column(2)):
                tokens = _bytes(x).split()
                if len(tokens) < k:
                    continue
                h = _hashes(tokens)
                at = np.flatnonzero(_bloom.test(shared.value, _minimizers(h, k)))
                if len(at):
                    nodes = _grams(h, k - 1) & kept
                    u, v = nodes[at], nodes[at + 1]
                    fresh = np.ones(len(at), dtype=bool)
                    if len(np.unique(u)) < len(u):
                        order = np.lexsort((v, u))
                        fresh[order[1:]] = (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
                    rows.append((i, at, u, v, fresh))
                    held += len(at)
                if held > BATCH_ROWS:
                    yield out(b, rows)
                    rows, held = [], 0
            if rows:
                yield out(b, rows)

    def out(b: pa.RecordBatch, rows) -> pa.RecordBatch:
        take = pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]))
        at, u, v, fresh = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3, 4))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(fresh)], ["u", "v", "id", "key", "pos", "fresh"])

    return docs.mapInArrow(run, f"u long, v long, id {docs.schema['id'].dataType.simpleString()}, key long, pos int, fresh boolean")


def first_sources(e: DataFrame) -> DataFrame:
    """(u, v, src, skey, spos): edges of more than one document, each with its first source.

    Minima of numbers, so that they are gathered in a hash table and not by sorting.
    """
    g = e.where("fresh").groupBy("u", "v").agg(F.min("id").alias("src"), F.min_by("key", "id").alias("skey"), F.min_by("pos", "id").alias("spos"), F.max(F.col("id").isNull()).alias("nulls"), F.max("id").alias("last"))
    return g.where("src is not null and (nulls or last > src)").select("u", "v", "src", "skey", "spos")


def compacted(sources: DataFrame) -> DataFrame:
    """sources with `path`: the position in the source where the nonbranching path of the edge begins.

    All edges' ends meet at their nodes.  Where one edge enters and one leaves, and both have the same coordinates, the
    edges follow each other; the path begins at the nearest edge before that follows none.
    """
    ends = sources.select(F.explode(F.array(*[F.struct(F.col(x).alias("x"), "src", "skey", (F.col("spos") + i).alias("p"), F.lit(i).alias("enters")) for i, x in enumerate("uv")])).alias("e")).select("e.*")
    same = [F.min(c) == F.max(c) for c in ("src", "skey", "p")]
    nodes = ends.groupBy("x").agg(F.sum("enters").alias("n_in"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("src", "skey", "p")], (same[0] & same[1] & same[2]).alias("same"))
    joined = nodes.where("n = 2 and n_in = 1 and same").select("src", "skey", F.col("p").alias("spos"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(0).alias("edge"))
    along = Window.partitionBy("src", "skey").orderBy("spos", "edge")
    rows = sources.select("src", "skey", "spos", "u", "v", F.lit(1).alias("edge")).unionByName(joined)
    follows = (F.lag("edge").over(along) == 0) & (F.lag("spos").over(along) == F.col("spos"))
    rows = rows.withColumn("begins", F.when((F.col("edge") == 1) & ~F.coalesce(follows, F.lit(False)), F.col("spos")))
    return rows.withColumn("path", F.max("begins").over(along)).where("edge = 1").select("u", "v", "src", "skey", "spos", "path")


def arrow_type(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[simple]


def _claims(found: DataFrame, k: int, id_type: str) -> DataFrame:
    """From documents (id, key, text, hits, owned) three kinds of rows in one schema, told apart by `what`.

    path: the words of a path that begins in the document.  claim: words of the document, and where along which path they
    should stand as well.  doc: what is left of the document if all its claims hold; documents that only own paths
    have none, unless `owned` is null.
    """
    kind = arrow_type(id_type)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("source", kind), ("source_start", pa.int64())])
    fields = [("what", pa.string()), ("id", kind), ("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("src", kind), ("skey", pa.int64()), ("path", pa.int64()), ("offset", pa.int64()), ("words", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))]

    def one(i, key, tokens, hits, owned) -> Iterator[tuple]:
        for o in owned or ():
            yield ("path", i, key, None, None, None, None, o["path"], None, b" ".join(tokens[o["path"] : o["path"] + o["n"] + k - 1]), None, None, None, None)
        if hits is None or not len(hits):
            if owned is None:  # a document whose every claim has failed
                yield ("doc", i, key, None, None, None, None, None, None, None, len(tokens), 0, hashlib.sha256(b" ".join(tokens)).hexdigest(), [])
            return
        pos, spos, path, skey = (hits.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "spos", "path", "skey"))
        src = hits.field("src").to_numpy(zero_copy_only=False)
        order = np.argsort(pos, kind="stable")
        pos, spos, path, skey, src = pos[order], spos[order], path[order], skey[order], src[order]
        new_span = np.r_[True, (np.diff(pos) != 1) | (np.diff(spos) != 1) | (src[1:] != src[:-1]) | (skey[1:] != skey[:-1])]
        new_claim = new_span | np.r_[True, path[1:] != path[:-1]]
        cut = np.flatnonzero(new_claim)
        for a, z in zip(cut, np.r_[cut[1:], len(pos)] - 1, strict=True):
            start, stop = int(pos[a]), int(pos[z]) + k
            yield ("claim", i, key, start, stop, src[a], int(skey[a]), int(path[a]), int(spos[a] - path[a]), b" ".join(tokens[start:stop]), None, None, None, None)
        cut = np.flatnonzero(new_span)
        spans = [{"start": int(pos[a]), "stop": int(pos[z]) + k, "source": src[a], "source_start": int(spos[a])} for a, z in zip(cut, np.r_[cut[1:], len(pos)] - 1, strict=True)]
        gone = np.zeros(len(tokens) + 1, dtype=np.int32)
        np.add.at(gone, pos, 1)
        np.add.at(gone, pos + k, -1)
        keep = np.cumsum(gone[:-1]) == 0
        text = b" ".join([w for w, ok in zip(tokens, keep, strict=True) if ok])
        yield ("doc", i, key, None, None, None, None, None, None, None, len(tokens), len(tokens) - int(keep.sum()), hashlib.sha256(text).hexdigest(), spans)

    def batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for j in range(b.num_rows):
                tokens = _bytes(b.column(2)[j]).split()
                for r in one(b.column(0)[j].as_py(), b.column(1)[j].as_py(), tokens, b.column(3)[j].values, b.column(4)[j].as_py()):
                    rows.append(r)
                    held += 100 + len(r[9] or b"")
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    spans = f"array<struct<start: long, stop: long, source: {id_type}, source_start: long>>"
    return found.mapInArrow(run, f"what string, id {id_type}, key long, start long, stop long, src {id_type}, skey long, path long, offset long, words binary, n_words long, n_removed long, kept_sha256 string, spans {spans}")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def _met(src: DataFrame, lists: DataFrame, tag: str) -> DataFrame:
    """Documents with their lists (id, key, ...); only texts that a filter takes for one of them shuffle."""
    doc = F.xxhash64("id", "key")
    some = _bloom.from_keys(lists.select("id", "key"), doc, lists.count(), tag).maybe(src, doc, "maybe").where("maybe")
    return some.join(lists, _same(some, lists)).select(some["id"], some["key"], "text", *[c for c in lists.columns if c not in ("id", "key")])


def failed(told: DataFrame) -> DataFrame:
    """(id, key, start, stop) of claims whose words are not those at the path's coordinates in its source."""
    claim = told.where("what = 'claim'").select("id", "key", "start", "stop", "src", "skey", "path", "offset", "words")
    paths = told.where("what = 'path'").select(F.col("id").alias("src"), F.col("key").alias("skey"), "path", F.col("words").alias("source_words"))
    paths = paths.dropDuplicates(["src", "skey", "path"])  # rows alike in id and text tell the same
    paths = durable(paths, "substring-path-words")  # so that adaptive skew handling sees both sides of the join
    part = F.array_join(F.slice(F.split(F.col("source_words").cast("string"), " "), F.col("offset").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")), " ").cast("binary")
    holds = (F.col("words") == F.col("source_words")) | (F.col("words") == part)
    return claim.join(paths, ["src", "skey", "path"], "left").where(~F.coalesce(holds, F.lit(False))).select("id", "key", "start", "stop")


def _again(src: DataFrame, e: DataFrame, hits: DataFrame, bad: DataFrame, k: int, id_type: str) -> DataFrame:
    """The documents of failed claims anew: their windows under the nodes concerned are met by the words themselves."""
    lost = durable(bad.select("id", "key", F.explode(F.sequence(F.col("start").cast("int"), (F.col("stop") - k).cast("int"))).alias("pos")).distinct(), "substring-lost")
    named = durable(e.join(lost, _same(e, lost) & (e["pos"] == lost["pos"])).select("u", "v").distinct(), "substring-lost-edges")
    places = e.join(named, ["u", "v"]).groupBy("id", "key").agg(F.collect_set("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                tokens, at = _bytes(b.column(2)[j]).split(), b.column(3)[j].as_py()
                for lo in range(0, len(at), 10_000):
                    part = at[lo : lo + 10_000]
                    take = pa.array([j] * len(part))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(part, pa.int32()), pa.array([b" ".join(tokens[p : p + k]) for p in part], pa.binary())], ["id", "key", "pos", "words"])

    texts = durable(_met(src, durable(places, "substring-places"), "substring-places-filter").mapInArrow(run, f"id {id_type}, key long, pos int, words binary"), "substring-windows")
    first = texts.where("id is not null").groupBy("words").agg(F.min(F.struct("id", "key", "pos")).alias("s"))
    true = texts.join(first, "words").where("id is null or id > s.id")
    true = true.select("id", "key", F.struct("pos", F.col("s.id").alias("src"), F.col("s.key").alias("skey"), F.col("s.pos").alias("spos"), F.col("s.pos").alias("path")).alias("h"))
    docs = durable(bad.select("id", "key").distinct(), "substring-again")
    had = hits.join(docs, _same(hits, docs), "left_semi").select("id", "key", F.explode("hits").alias("h"))
    had = had.join(lost, _same(had, lost) & (had["h.pos"] == lost["pos"]), "left_anti")
    every = had.unionByName(true.join(docs, _same(true, docs), "left_semi")).groupBy("id", "key").agg(F.collect_set("h").alias("hits"))
    every = durable(docs.join(every, _same(docs, every), "left").select(docs["id"], docs["key"], "hits", F.lit(None).cast("array<struct<path: int, n: bigint>>").alias("owned")), "substring-again-hits")
    return durable(_claims(_met(src, every, "substring-again-filter"), k, id_type).where("what = 'doc'"), "substring-again-docs")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, most_bits: int = MOST_BITS, bits: int = 64) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and `spans` (start, stop, source, source_start).

    A word goes if a window of k words covers it whose words also start in a document with a smaller id.  Ids are
    bigint, int or string.  Documents equal word by word (by SHA-256) to one with a smaller id lose everything; their span is the
    whole text, with source_start 0, and they make no edges, so groups of copies cost one row each.  bits: of a node's
    hash; fewer only mean that more claims fail and are settled by words.

    Null and empty texts, and texts of fewer than k words: nothing is removed.  Null ids are larger than all others
    and no source to each other.  Rows that share an id are no source to each other.  Empty table: no rows.
    Very long texts are read whole.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_type(kind)
    src = _keyed(docs, id_col, text_col)
    rows = durable(survey(src, k), "substring-survey")

    firsts = durable(rows.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-copies")
    narrow = rows.select("id", "key", "n_words", "sha").join(firsts.select("sha", "first"), "sha", "left")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    narrow = durable(narrow.withColumn("copy", copy & (F.col("n_words") >= k)), "substring-docs")
    release(firsts)

    counts = rows.select(F.explode("minimizers").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = durable(counts.select("m"), "substring-minimizers")
    release(rows)
    repeated = _bloom.from_keys(counts, F.col("m"), counts.count(), "substring-filter", 16, most_bits).array()
    release(counts)

    # copies make no edges, and rows alike in id and text make them once: texts that the filter takes for one of these
    # meet the exact list of them, all others pass straight through
    doc = F.xxhash64("id", "key")
    repeats = narrow.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.first("copy").alias("copy")).where("copy or n > 1").select("id", "key", "copy")
    repeats = durable(repeats, "substring-repeats")
    tested = _bloom.from_keys(repeats, doc, repeats.count(), "substring-repeated").maybe(src, doc, "maybe")
    perhaps = tested.where("maybe").select("id", "key", "text")
    known = perhaps.join(repeats, _same(perhaps, repeats), "left").select(perhaps["id"], perhaps["key"], "text", "copy")
    once = known.where("not copy").dropDuplicates(["id", "key"]).unionByName(known.where("copy is null"))
    all_edges = edges(tested.where("not maybe").select("id", "key", "text").unionByName(once.select("id", "key", "text")), repeated, k, bits)
    e = durable(all_edges, "substring-edges")

    sources = durable(first_sources(e), "substring-sources")
    paths = durable(compacted(sources), "substring-paths")
    release(sources)
    hits = e.drop("fresh").join(paths, ["u", "v"]).where("id is null or id > src")
    hits = hits.select("id", "key", F.struct("pos", "src", "skey", "spos", "path").alias("h"), F.lit(None).cast("struct<path: int, n: bigint>").alias("o"))
    owned = paths.groupBy(F.col("src").alias("id"), F.col("skey").alias("key"), "path").agg(F.count(F.lit(1)).alias("n"))
    owned = owned.select("id", "key", F.lit(None).cast(hits.schema["h"].dataType).alias("h"), F.struct("path", "n").alias("o"))
    # one row per document that is a source or loses words; its lists are bounded by the document
    lists = durable(hits.unionByName(owned).groupBy("id", "key").agg(F.collect_list("h").alias("hits"), F.collect_list("o").alias("owned")), "substring-hits")
    release(e)
    release(paths)
    told = durable(_claims(_met(src, lists, "substring-touched"), k, kind), "substring-claims")
    bad = durable(failed(told), "substring-failed")
    changed = told.where("what = 'doc'")
    if not bad.isEmpty():
        changed = changed.join(bad, _same(changed, bad), "left_anti").unionByName(_again(src, durable(all_edges, "substring-edges-again"), lists, bad, k, kind))
    changed = changed.select("id", "key", "n_words", "n_removed", "kept_sha256", "spans")
    marked = durable(lists.where(F.size("hits") > 0).select("id", "key"), "substring-marked")
    release(lists)

    spans = f"array<struct<start: bigint, stop: bigint, source: {kind}, source_start: bigint>>"
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"), F.col("first").alias("source"), F.lit(0).cast("long").alias("source_start"))).cast(spans)
    copies = narrow.where("copy").select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), whole.alias("spans"))
    rest = narrow.where("not copy")
    rest = rest.join(marked, _same(rest, marked), "left_anti")
    rest = rest.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"), F.array().cast(spans).alias("spans"))
    return changed.drop("key").unionByName(copies).unionByName(rest).withColumnRenamed("id", id_col)
