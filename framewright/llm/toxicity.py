"""Toxicity by noisy-channel deobfuscation.

Obfuscated spellings (digits and symbols for letters, separators, repeated or spaced letters) are taken as the output of a
noisy channel.  Each suspicious token opens a lattice of letters that may stand behind its characters; Viterbi search
under a character trigram model, counted over all documents, restores it.  Words of the restored text, and their
beginnings, are scored by logistic regression.

The search keeps STATES states of a lattice at each character.  Tokens of more than PIECE characters are decoded in pieces that
overlap by PIECE - STEP, and words that end inside a run of spaced letters have RUN letters at most.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import durable

# Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "¡": "i",
}
# Letters of other scripts that look like Latin ones, and characters that cannot be seen.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Characters that may stand for any letter.
ANY = "*#"
#: Channel costs (log probabilities): a letter for a symbol, any letter, a dropped separator, a dropped symbol that can stand for a letter, a dropped repetition.
SWAP, WILD, DROP, DROP_LEET, REPEAT = -1.0, -3.3, -0.8, -7.0, -0.5
#: Characters of a token that are decoded at once, and the step to the next piece; words to find are shorter than the overlap.
PIECE, STEP = 64, 40
#: Symbols of the trigram model: 0 stands for a boundary, 1 to 26 for letters, 27 for other ASCII, the rest for other characters by code point.
SYMBOLS = 64
#: States of a lattice that go on from a character; a state is the last two letters.
STATES = 48
#: Letters of a word that ends inside a run of spaced letters.
RUN = 16
#: Lengths of word beginnings that are features, besides the whole word.
BEGINNINGS = range(4, 9)
#: Weight of a row that counts with a part of its features.
PART = 0.02
#: Labelled documents that the classifier is fitted on, half of the bound of each class at most.
SAMPLE = 20_000
#: Features that the classifier keeps.
FEATURES = 2_000

_LOOKALIKES = str.maketrans(LOOKALIKES)
_ASCII = np.array([0 if c in b" \t\n\r\x0b\x0c" else (c | 32) - 96 if 65 <= (c & ~32) <= 90 else 27 for c in range(128)], dtype=np.int32)
_WORDS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_AROUND = ".,;:?\"'()[]{}|"
_JUNK = re.compile(r"([^\w\s])\1+")
_EDGES = re.compile(r"^[^\w@$€£¢¡|+(<*#]+|[^\w@$€£¢|+*#!]+$")
_SPACED = re.compile(r"(?<![^\W_])\S(?:[ \t]\S){2,}(?![^\W_])")


def symbols(text: str) -> np.ndarray:
    """Model symbols of a text, with a boundary before and behind."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = np.where(c < 128, _ASCII[np.minimum(c, 127)], 28 + c % 36).astype(np.int32)
    return np.concatenate([np.zeros(2, np.int32), out, np.zeros(1, np.int32)])


def trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of symbol trigrams over all documents; the driver gets at most 64 ** 3 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0

        def add() -> None:
            s = np.concatenate(held)
            total[:] += np.bincount(s[:-2] * (SYMBOLS * SYMBOLS) + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)

        for b in batches:
            for x in b.column(0):
                held.append(symbols(x.as_py() or ""))
                size += len(held[-1])
                if size > 1_000_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    out = np.zeros(SYMBOLS**3, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["code"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated log probabilities of a symbol after two others."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p3 = tri / np.maximum(tri.sum(axis=2, keepdims=True), 1)
    p2 = bi / np.maximum(bi.sum(axis=1, keepdims=True), 1)
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    return np.log(0.7 * p3 + 0.2 * p2[None] + 0.1 * p1).astype(np.float32)


class Restorer:
    """Restores texts under a model; remembers tokens that it has decoded."""

    def __init__(self, model: np.ndarray) -> None:
        self.log = model.reshape(-1).tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def _symbol(c: str) -> int:
        return int(_ASCII[ord(c)]) if c < "\x80" else 28 + ord(c) % 36

    def viterbi(self, token: str, best: int = 3) -> list[str]:
        """The `best` likeliest letter strings behind a token."""
        log, two = self.log, SYMBOLS * SYMBOLS
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for i, c in enumerate(token):
            if c.isalpha():
                options = [(c, 0.0)]
                if i and token[i - 1] == c:
                    options.append(("", REPEAT))
            else:
                options = [(x, SWAP) for x in LEET.get(c, "")] + ([(chr(97 + x), WILD) for x in range(26)] if c in ANY else [])
                options.append(("", DROP_LEET if c in LEET else DROP))
            new: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), paths in states.items():
                for letter, cost in options:
                    if letter:
                        s = self._symbol(letter)
                        step, to = cost + log[a * two + b * SYMBOLS + s], (b, s)
                    else:
                        step, to = cost, (a, b)
                    new.setdefault(to, []).extend((p + step, t + letter) for p, t in paths)
            kept = sorted(new.items(), key=lambda x: -max(x[1])[0])[:STATES]
            states = {k: sorted(set(v), reverse=True)[:best] for k, v in kept}
        ends = [(p + log[a * two + b * SYMBOLS], t) for (a, b), paths in states.items() for p, t in paths]
        return [t for _, t in sorted(ends, reverse=True)[:best]]

    def decode(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            pieces = [token[i : i + PIECE] for i in range(0, max(1, len(token) - PIECE + STEP), STEP)]
            got = tuple(dict.fromkeys(w for p in pieces for w in self.viterbi(p) if w))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token] = got
        return got

    def words(self, text: str | None) -> tuple[set[str], set[str]]:
        """Words of the restored text; and restored runs of spaced letters, in which a word may start anywhere."""
        text = (text or "").lower()
        if not text.isascii():
            if not unicodedata.is_normalized("NFKC", text):
                text = unicodedata.normalize("NFKC", text).lower()
            if _LOOKALIKE.search(text):
                text = text.translate(_LOOKALIKES)
        tokens, runs = set(text.split()), set()
        odd = [t for t in tokens if not t.isalpha()]
        out, rest = tokens.difference(odd), []
        for t in odd:
            bare = t.strip(_AROUND)
            if bare.isalpha():
                out.add(bare)
            else:
                rest.append(t)
        for x in {c for c in set(text) if c.isalpha()} if _TRIPLE.search(text) else ():
            x *= 3
            if x in text:
                for t in [t for t in out if x in t]:
                    out.update(self.decode(t))
        out.update(_WORDS.findall(" ".join(rest)))
        for t in rest:
            t = _EDGES.sub("", _JUNK.sub("", t))
            if any(c.isalpha() for c in t) and (not t.isalpha() or _TRIPLE.search(t)):
                out.update(self.decode(t))
        for m in _SPACED.finditer(text) if " " in text else ():
            t = "".join(m[0].split())
            if any(c.isalpha() for c in t):
                runs.update(self.decode(t))
        return out, runs


def features(words: set[str], runs: set[str], heads: set[str] | None = None) -> set[str]:
    """Whole words (marked by $) and their beginnings; heads, if given, are the first four letters worth looking at."""
    out = set()
    for w in words | {r[i:] for r in runs for i in range(len(r))}:
        if heads is None or w[:4] in heads:
            out.add(w + "$")
            out.update(w[:k] for k in BEGINNINGS if k < len(w))
    for r in runs:  # a word may also end inside a run
        for i in range(len(r)):
            out.update(r[i:j] + "$" for j in range(i + 3, min(len(r), i + RUN) + 1) if heads is None or r[i : i + 4] in heads or r[i:j] in heads)
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: list[tuple[int, list[int]]], weight: tuple[float, float], n: int, rounds: int = 1500, penalty: float = 0.01) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression with L2 penalty, by gradient steps with momentum (Adam).

    Each row also counts, at a small weight, with seeded parts of its features only, so that a feature need not lean on
    others that it comes with.
    """
    rng, whole = random.Random(5), len(rows)
    rows = [*rows, *((y, [rng.choice(f)] if rng.random() < 0.5 else [x for x in f if rng.random() < 0.4]) for y, f in rows for _ in range(6) if f)]
    y = np.array([r[0] for r in rows], dtype=np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    idx = np.array([i for r in rows for i in r[1]], dtype=np.int64)
    sw = np.where(y == 1, weight[1], weight[0]) * np.where(np.arange(len(y)) < whole, 1.0, PART)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=w[idx], minlength=len(y)) + w[n]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * sw
        g = np.append(np.bincount(idx, weights=e[doc], minlength=n)[:n], e.sum())
        g[:n] += penalty * w[:n]
        g[n] += 1e-3 * w[n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep: int = FEATURES) -> tuple[np.ndarray, dict[str, float], float]:
    """(trigram model, weight of each feature, bias).

    The model is counted over all documents.  The classifier sees `sample` labelled documents at most, drawn by hash
    from rows whose id is not held out; class weights undo the draw, so scores stay calibrated.
    """
    spark = docs.sparkSession
    model = log_model(trigrams(docs, text_col))
    y = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    y = durable(y.distinct(), "toxic-labels")
    all_n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = [y.where(F.col("y") == c).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample // 2) for c in (0, 1)]
    drawn = half[0].unionByName(half[1])  # `sample` rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("text", "y")
    rows = durable(rows, "toxic-sample")
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(shared.value)
        for b in batches:
            n = (Counter(), Counter())
            for text, c in zip(b.column(0), b.column(1), strict=True):
                n[c.as_py()].update(features(*r.words(text.as_py())))
            names = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1][f] for f in names], pa.int64()), pa.array([n[0][f] for f in names], pa.int64())], ["f", "a", "b"])

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = max(n.get(0, 0), 1), max(n.get(1, 0), 1)
    f = rows.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    f = f.where((F.col("a") >= 3) & (F.col("a") * n0 > F.col("b") * (3 * n1)))
    total = float(n0 + n1)
    seen = F.col("a") + F.col("b")
    part = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
    gain = part(F.col("a"), seen * (n1 / total)) + part(F.col("b"), seen * (n0 / total)) + part(n1 - F.col("a"), (total - seen) * (n1 / total)) + part(n0 - F.col("b"), (total - seen) * (n0 / total))
    chosen = [r["f"] for r in f.withColumn("g", gain).where("g > 15").orderBy(F.desc("g"), "f").limit(keep).collect()]
    place = spark.sparkContext.broadcast({x: i for i, x in enumerate(chosen)})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, at = Restorer(shared.value), place.value
        heads = {x.rstrip("$")[:4] for x in at}
        for b in batches:
            got = [sorted(at[x] for x in features(*r.words(t.as_py()), heads) if x in at) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.int32()))], ["y", "at"])

    fitted = [(r["y"], list(r["at"])) for r in rows.mapInArrow(found, "y int, at array<int>").toLocalIterator()]
    fitted.sort()
    w = fit(fitted, (all_n.get(0, 0) / n0, all_n.get(1, 0) / n1), len(chosen)) if fitted else np.zeros(len(chosen) + 1)
    return model, {x: float(w[i]) for i, x in enumerate(chosen)}, float(w[-1])


def score(docs: DataFrame, trained: tuple[np.ndarray, dict[str, float], float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`: the probability that the restored text is toxic.  Null and empty texts get the bias alone.

    A column named `out` in docs raises ValueError.
    """
    if out in docs.columns:
        raise ValueError(f"docs have a column {out!r} already")
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    names = docs.columns
    place = names.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = shared.value
        r, heads = Restorer(model), {x.rstrip("$")[:4] for x in weights}
        for b in batches:
            z = [bias + math.fsum(weights.get(x, 0.0) for x in features(*r.words(t.as_py()), heads)) for t in b.column(place)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], pa.float64())], [*names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted (1 from the threshold on).

    Ids whose crc32 as text is 2 modulo 4 are held out: their labels are never used.  Null ids and null or other labels:
    not used for training, but scored.  Null and empty texts: the score of a text without words.  Repeated documents: a
    row each; repeated labels count once, contradicting ones both.  Without any label all scores are 0.5.  Empty table:
    no rows.  Texts of any length are read whole.  Other columns are not read.
    """
    trained = train(docs, labels, id_col, text_col, label_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    s = score(d, trained).select("id", "score")
    return s.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
