"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of 3 * d segments, d being the most differing bits of a link.  If two
fingerprints differ in d bits at most, some chain of consecutive segments starts where, for every length l, the
first l segments differ in l * d / (3 d) = l / 3 bits at most: none in the first two, one in the first three to
five, and so on.  The first five segments of such a chain hold one differing bit at most, so either the third
segment agrees too, or the fourth and the fifth do: two exact keys per start find every chain.  Pairs that share
a key must pass the whole chain condition and then the full Hamming check.

near_copies links texts by the similarity of their shingle sets instead.  Sets of similarity 0.8 have fingerprints that
differ in about ten bits of 64 and in twenty at times; with such a budget no run of the ring is both sure to agree and long
enough to be a key.  There, candidates share a band of minimal shingle hashes, the ring with its proportional budgets
prunes them by their fingerprints, and the sets themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bloom
from ._components import components
from ._rows import HASH, ID, keyed
from ._util import durable, release

#: Distinct fingerprints that may share a key and still be paired; see `links`.
PAIRED = 32
#: Bands of minimal hashes, and hashes in a band: sets of similarity 0.8 share a band with probability 0.9993, those of 0.3 with 0.02.
BANDS, ROWS = 24, 6
#: Sets in a bucket that are paired at once, and turns in which the sets of larger buckets are compared with one of them.
SMALL, STARS = 4, 2
#: Segments of the ring that prunes candidates.  The condition is written out for each start and length, so they are few.
SEGMENTS = 8
#: Cells of the table of shingle counts that puts rare shingles first in `prefixes`; shingles that share one are only ordered worse.
CELLS = 1 << 22


def shingles(raw: bytes, words: int, seed: int) -> np.ndarray:
    """Hashes of the word shingles of UTF-8 text, repeats included; fewer words are one shingle, no words none."""
    tokens = raw.lower().split()  # of bytes: A-Z only, and spaces are 0x20 and 0x09 to 0x0D
    if not tokens:
        return np.zeros(0, dtype="<u8")
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, seed) for g in grams], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 text, repeats included; no words: 0."""
    return majority(shingles(raw, words, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42, carry: str | None = None) -> DataFrame:
    """(id, fp, and carry, a long): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], ["__id", "fp", "carry"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary"), (F.col(carry) if carry else F.lit(0)).cast("long")).mapInArrow(run, f"__id {kind}, fp long, carry long")


def ring(distance: int, m: int | None = None) -> list[int]:
    """Bit masks of the ring's segments, 3 * distance unless told."""
    m = m or max(1, 3 * distance)
    cuts = [64 * i // m for i in range(m + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def key_masks(distance: int) -> list[int]:
    """The masks under which two fingerprints with a viable chain agree, two for each start (one if d is 1)."""
    seg, m = ring(distance), 3 * distance
    out = []
    for i in range(m):
        first = seg[i] | seg[(i + 1) % m]
        out += [first | seg[(i + 2) % m], first | seg[(i + 3) % m] | seg[(i + 4) % m]] if distance > 1 else [first]
    return out


def viable(a: Column, b: Column, distance: int, m: int | None = None) -> Column:
    """Whether a chain keeps within the budget at every length: l of m segments differ in l * distance / m bits at most."""
    seg = ring(distance, m)
    m = len(seg)
    x = a.bitwiseXOR(b)
    d = [F.bit_count(x.bitwiseAND(F.lit(_signed(s)))) for s in seg]
    some = F.lit(False)
    for i in range(m):
        total, good = d[i], d[i] <= 0
        for n in range(2, m + 1):
            total = total + d[(i + n - 1) % m]
            good = good & (total <= n * distance // m)
        some = some | good
    return some


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) that join the same components as all links.

    A key under which at most PAIRED fingerprints meet gives its pairs, filtered by chain and Hamming distance.
    Where more meet, pairing would grow with the square: those fingerprints go the other exact way.  Each names
    itself and its 64 neighbours at one bit; any two that name the same value differ in two bits at most, and two
    that differ in two at most name a common value.  A value has 65 namers at most, so no group is large,
    and linking each namer to the smallest joins the same components without pairs.
    """
    masks = key_masks(distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for i, x in enumerate(masks)])).alias("x")).select("fp", "x.c", "x.k")
    met = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keyed.join(met, ["c", "k"]), "simhash-met")  # most keys are met by one fingerprint and end here
    groups = met.where(F.col("n") <= PAIRED).groupBy("c", "k").agg(F.collect_list("fp").alias("g"))
    pairs = groups.select(F.explode("g").alias("a"), "g").select("a", F.explode(F.filter("g", lambda b: (b > F.col("a")))).alias("b"))
    pairs = pairs.where(viable(F.col("a"), F.col("b"), distance)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    crowded = met.where(F.col("n") > PAIRED).select("fp").distinct()
    near = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    named = crowded.select("fp", F.explode(near).alias("x")).groupBy("x").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
    if distance == 1:  # only a value that is itself a fingerprint links its namers
        named = named.where(F.array_contains("g", F.col("x"))).withColumn("first", F.col("x"))
    else:
        named = named.withColumn("first", F.array_min("g"))
    stars = named.select(F.col("first").alias("a"), F.explode("g").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, words: int = 3, seed: int = 42, carry: str | None = None) -> DataFrame:
    """One row per row of docs: id, `fingerprint` (16 hex digits), `component_id`, the smallest id that links reach, and
    `component`, a number that names the component even where ids repeat.  carry: a long column to pass on.

    Texts are lower-cased (A-Z) and cut at 0x20 and 0x09 to 0x0D.  Fewer words than a shingle: the whole
    sequence is the shingle.  Null, empty and blank texts: fingerprint zero, linked like any other.  Null ids:
    kept, never chosen as component_id unless all of the component are null.  Repeated rows and equal texts share
    a fingerprint, are linked through it and not paired.  Empty table: no rows.  Other columns are not read.
    distance: 0, 1 or 2 bits; other values raise ValueError.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    fp = durable(fingerprints(docs, id_col, text_col, words, seed, carry), "simhash-fp")
    classes = durable(fp.groupBy("fp").agg(F.min("__id").alias("first")), "simhash-classes")
    if distance:
        roots = durable(components(links(classes.select("fp"), distance)), "simhash-roots")
        linked = roots.join(classes, roots["node"] == classes["fp"]).select("fp", "root", "first")
        least = linked.groupBy("root").agg(F.min("first").alias("component"))
        linked = linked.join(least, "root").select("fp", "root", "component")
        classes = classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("first")).alias("component"))
        classes = durable(classes, "simhash-components")  # so that adaptive skew handling sees both sides of the last join
    else:
        classes = classes.select("fp", F.col("fp").alias("root"), F.col("first").alias("component"))
    return fp.join(classes, "fp").select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"), F.col("root").alias("component"), *([F.col("carry").alias(carry)] if carry else []))


def bits_for(similarity: float) -> int:
    """Differing bits that fingerprints of two such sets keep within: the expected number and four deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(64, math.ceil(64 * p + 4 * math.sqrt(64 * p * (1 - p))))


def _bands(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each band's minima over the shingle hashes h."""
    low, least = h.astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[at : at + 2048, None] * a + b).min(axis=0))
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(id, hash, cls, fp, bands) of documents (id, hash, text): cls names the set of shingles, fp is its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        a = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
        b = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
        for batch in batches:
            cls, fps, bands = [], [], []
            for x in batch.column(2):
                h = np.unique(shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed))
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), seed))
                fps.append(majority(h))
                bands.append(_bands(h ^ (h >> np.uint64(32)), a, b))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            off = pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(cls, dtype=np.uint64).view(np.int64)), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(off, flat)], ["id", "hash", "cls", "fp", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hash long, cls long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(cls, s): the sorted set of shingle hashes of documents (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed)) for x in b.column(1)]
            off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["cls", "s"])

    return docs.mapInArrow(run, "cls long, s array<long>")


def _size_class(n: int) -> tuple[int, int]:
    """The least size of n's class, and the least one of the next: sizes that agree in their first four bits."""
    step = 1 << max(0, n.bit_length() - 4)
    return n // step * step, (n // step + 1) * step


def _levels(sets: DataFrame) -> np.ndarray:
    """Magnitude (bits of the count) of each cell of shingles of sets (s), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(CELLS)
            cell, k = np.unique(flat, return_counts=True)
            n[cell] += k
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["cell", "n"])

    cells = sets.select("s").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    found = cells.select("cell", F.length(F.bin("n")).cast("byte").alias("level")).toArrow()  # CELLS rows of 9 bytes at most
    out = np.ones(CELLS, dtype=np.uint8)
    out[found["cell"].to_numpy()] = found["level"].to_numpy()
    return out


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, cls, root, n, pos, low) of sets (cls, root, s): their n shingles that may be the first one shared with a similar set.

    Shingles are put in one order, rare ones first.  Where sets share k shingles, the first one that they share has k - 1 others behind it
    in both, so it stands early in both: only a prefix of each set is looked at, a shorter one the nearer the other set's size is.
    A key is a shingle and a class of sizes; the smaller set of a pair is `low` there, the other one names all classes of smaller
    sets.  Only keys at which roots and roles differ are returned.
    """
    share = similarity / (1 + similarity)
    level = sets.sparkSession.sparkContext.broadcast(_levels(sets))

    def needed(n: int) -> int:
        return math.ceil(share * n - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                row, key, pos, low = [], [], [], []
                size = np.array([len(x) for x in part.column(2)], dtype=np.int64)
                for i, x in enumerate(part.column(2)):
                    n, s = int(size[i]), x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    if not n:
                        continue
                    rank = level.value[s % np.uint64(CELLS)]
                    order = np.lexsort((s, rank))
                    s, rank = s[order], rank[order]
                    own, least = _size_class(n)[0], max(1, math.ceil(similarity * n - 1e-6))
                    at, ends = _size_class(least), [(own, needed(2 * n), True)]
                    while at[0] <= n:
                        ends.append((at[0], needed(max(at[0], least) + n), False))
                        at = _size_class(at[1])
                    for of, need, is_low in ends:
                        p = np.flatnonzero(rank[: n - need + 1] > 1)  # a shingle that is alone in its cell meets none
                        row.append(np.full(len(p), i))
                        key.append((s[p] ^ np.uint64(of)) * np.uint64(0x9E3779B97F4A7C15))
                        pos.append(p)
                        low.append(np.full(len(p), is_low))
                if row and sum(map(len, row)):
                    take = np.concatenate(row)
                    cols = [pa.array(np.concatenate(key).view(np.int64)), part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)), pa.array(size[take]), pa.array(np.concatenate(pos).astype(np.int64)), pa.array(np.concatenate(low))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "cls", "root", "n", "pos", "low"])

    rows = durable(sets.select("cls", "root", "s").mapInArrow(run, "key long, cls long, root long, n long, pos long, low boolean"), "near-prefixes")
    some = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("low").alias("none"), F.max("low").alias("any")).where("lo < hi and none <> any").select("key")
    met = durable(rows.join(some, "key"), "near-prefixes-met")
    release(rows)
    return met


def _room(x: str, y: str, similarity: float) -> Column:
    """Whether enough shingles stand behind the positions where two sets meet."""
    n, pos = (lambda side: F.col(f"{side}_n")), (lambda side: F.col(f"{side}_pos"))
    return F.least(n(x) - pos(x), n(y) - pos(y)) >= F.lit(similarity / (1 + similarity)) * (n(x) + n(y)) - 1e-6


def _told(met: DataFrame, side: str) -> DataFrame:
    return met.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "root", "n", "pos", "low")])


def _pairs(met: DataFrame) -> DataFrame:
    first = F.col("x_cls") < F.col("y_cls")
    pick = lambda c, one, other: F.when(first, F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))
    return met.select(*[pick(c, *ends).alias(out + tail) for c, tail in (("cls", ""), ("root", "_root")) for out, ends in (("a", "xy"), ("b", "yx"))]).distinct()


def starred(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_root, b_root): each set of prefixes with the one of each of its keys that has the fewest rare shingles, if roots differ."""
    center = met.groupBy("key").agg(F.min_by(F.struct("cls", "root", "n", "pos"), F.struct("pos", "cls")).alias("c"))
    center = center.select("key", *[F.col(f"c.{c}").alias(f"y_{c}") for c in ("cls", "root", "n", "pos")])
    return _pairs(_told(met, "x").join(center, "key").where("x_root <> y_root").where(_room("x", "y", similarity)))


def across(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_root, b_root): of prefixes, every pair of sets with different roots whose similarity may suffice.

    At a key, the members of the root that has most of them are not paired with each other.
    """
    tops = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("root", "k").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "top")
    met = durable(met.join(tops, "key"), "near-across")
    both = _told(met.where("root <> top"), "x").join(_told(met, "y"), "key").where("x_root <> y_root and x_low <> y_low and if(x_low, x_n <= y_n, y_n <= x_n)")
    return _pairs(both.where(_room("x", "y", similarity)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row per row of docs: its id, `text_hash` (as `keyed` gives it) and `component`, a number that rows share whose texts
    are linked, over others or at once.

    Two texts are linked if the sets of their shingles (`words` words, A-Z lower-cased; fewer words: the whole sequence) have a
    Jaccard similarity of `similarity` at least.  Candidates share one of BANDS bands, which linked pairs miss with
    probability 0.0007 at 0.8 and far less above; of those, the ring drops pairs whose fingerprints differ too much (about
    1 of 30,000 linked ones); the sets decide.  In a bucket of more than SMALL sets all are compared with one of them, another
    one each turn; what is linked to it drops out.  After STARS turns, the sets of buckets that still hold different
    components meet by their rarest shingles: once with the one that has the fewest rare ones, then with every set of another
    component that may be similar enough.  So groups of copies cost a few pairs a member, also where the members are not similar
    enough to each other, and no link is lost.

    Null, empty and blank texts: the empty set, one component.  Null ids, repeated rows, equal texts: linked by their
    set and not compared.  Empty table: no rows.  Texts of any length are read whole.  Other columns are not read.
    """
    bits = bits_for(similarity)
    d = keyed(docs, id_col, text_col)
    rows = durable(sketches(d.select(F.col(ID).alias("id"), F.col(HASH).alias("hash"), F.col(text_col).cast("binary").alias("text")), words, seed), "near-sketches")
    classes = rows.groupBy("cls").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    keys = classes.select("cls", "fp", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keys.join(met, "key"), "near-met")  # most bands are met by one set and end here

    need = durable(met.select("cls").distinct(), "near-need")
    order = F.struct(F.col("id").isNull(), "id", "hash")
    chosen = durable(rows.join(need, "cls").groupBy("cls").agg(F.min_by(F.struct("id", "hash"), order).alias("r")).select("cls", "r.id", "r.hash"), "near-chosen")
    key = F.xxhash64(ID, HASH)
    some = _bloom.from_keys(chosen, F.xxhash64("id", "hash"), chosen.count(), "near-filter").maybe(d, key, "__maybe").where("__maybe")
    texts = some.join(chosen, some[ID].eqNullSafe(chosen["id"]) & (some[HASH] == chosen["hash"])).select("cls", F.col(text_col).cast("binary").alias("text"))
    sets = durable(shingle_sets(texts.dropDuplicates(["cls"]), words, seed), "near-sets")

    def close(a: str, b: str) -> Column:
        return (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits) & viable(F.col(a), F.col(b), bits, SEGMENTS)

    def crossed(side: DataFrame) -> DataFrame:
        """Pairs of sets of one bucket that are in different components."""
        x, y = (side.select("key", F.col("cls").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("root").alias(f"{c}_root")) for c in "ab")
        return x.join(y, "key").where("a < b and a_root <> b_root").where(close("a_fp", "b_fp")).select("a", "b", "a_root", "b_root").distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, a_root, b_root), the roots of those whose sets are similar enough."""
        pairs = durable(pairs, "near-pairs")
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
        same = F.size(F.array_intersect("sa", "sb"))
        out = durable(both.where(same >= similarity * (F.size("sa") + F.size("sb") - same)).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "near-links")
        release(pairs)
        return out

    def merged(links: DataFrame) -> DataFrame:
        return durable(components(links), "near-roots").withColumnsRenamed({"node": "__node", "root": "__root"})

    def joined(side: DataFrame, to: DataFrame) -> DataFrame:
        """side with the roots that merged links leave."""
        return side.join(to, side["root"] == to["__node"], "left").withColumn("root", F.coalesce("__root", "root")).drop("__node", "__root")

    def split(side: DataFrame) -> DataFrame:
        """Buckets that hold more than one component."""
        some = side.groupBy("key").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi")).where("__lo < __hi").select("key")
        return side.join(some, "key")

    live = met.withColumn("root", F.col("cls"))
    to = merged(linked(crossed(live.where(F.col("n") <= SMALL))))
    roots = joined(need.withColumn("root", F.col("cls")), to)
    live = durable(split(joined(live.where(F.col("n") > SMALL), to)), "near-live")
    for turn in range(STARS):
        if live.isEmpty():
            break
        # all are compared with one of their bucket, another one each turn; those that are linked drop out
        first = live.groupBy("key").agg(F.min_by(F.struct("cls", "fp", "root"), F.xxhash64(F.lit(turn), "cls")).alias("r"))
        stars = live.join(first, "key").where("root <> r.root").withColumn("r_fp", F.col("r.fp")).where(close("fp", "r_fp"))
        to = merged(linked(stars.select(F.col("r.cls").alias("a"), F.col("cls").alias("b"), F.col("r.root").alias("a_root"), F.col("root").alias("b_root")).distinct()))
        roots, before = durable(joined(roots, to), "near-roots"), live
        live = durable(split(joined(live, to)), "near-live")
        release(before)
    if not live.isEmpty():
        left = durable(live.select("cls", "root").distinct().join(sets, "cls").select("cls", "root", "s"), "near-left")
        shared = prefixes(left, similarity)
        to = merged(linked(starred(shared, similarity)))
        roots = durable(joined(roots, to), "near-roots")
        roots = joined(roots, merged(linked(across(joined(shared, to), similarity))))
    roots = durable(roots, "near-components")
    release(met)
    release(sets)
    out = rows.select("id", "hash", "cls").join(roots.withColumnRenamed("cls", "__cls"), F.col("cls") == F.col("__cls"), "left")
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.coalesce("root", "cls").alias("component"))
