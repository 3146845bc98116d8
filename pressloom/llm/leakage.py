"""Evaluation texts inside training texts.

Items and documents are cut into windows of ``size`` words, the length from which
a passage counts as leaked. A window is embedded by random walks over its words
(Chakraborty, Goldenberg and Koucký 2016): the walk copies the current word and
moves on by a random bit that depends on the step and the word, so windows at a
small edit distance become strings at a small Hamming distance. Keys are words of
the embedding at sampled places, several of several walks; how many there are
decides the recall (:meth:`Embedding.recall` measures it). Equal windows share
all keys, so they are never lost. Windows that share a key are compared by their
true edit distance.

Equal item windows are one. Documents are read once, however many items there
are: bit filters of bounded size tell which words and keys items have, document
windows whose key passes are joined with the item windows by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.words import U64, flat_words, mix, owners
from pressloom.schemas import fields
from pressloom.session import spool

PAD = U64(0x5851F42D4C957F2D)
BLOCK = 1 << 16  # windows embedded at a time
CELL = 32768  # bits of one row of a filter


@dataclass(frozen=True)
class Embedding:
    """``walks`` random walks of 7/3 steps a word; ``tables`` keys of ``places`` sampled places from each. (In three steps a word most walks have left the window, and what they sample there tells nothing.)"""

    size: int = 12
    walks: int = 8
    tables: int = 4
    places: int = 6
    seed: int = 1

    def keys(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """All keys of the windows at ``start``: one row each, walks * tables columns."""
        steps = 7 * self.size // 3
        out = np.zeros((len(start), self.walks * self.tables), U64)
        padded = np.append(flat, np.full(self.size, PAD))
        for w in range(self.walks):
            at = np.zeros(len(start), np.int64)
            walked = np.zeros((steps, len(start)), U64)
            for j in range(steps):
                inside = at < self.size
                word = np.where(inside, padded[start + np.minimum(at, self.size - 1)], PAD)
                walked[j] = word
                at += inside & ((mix(word, 7919 * self.seed + 97 * w + j) & U64(1)) == 1)
            for t in range(self.tables):
                rng = np.random.default_rng((self.seed, w, t))
                key = np.zeros(len(start), U64)
                for j in sorted(rng.choice(steps, self.places, replace=False)):
                    key = mix(key * U64(3) + walked[j], 5)
                out[:, w * self.tables + t] = mix(key, 31 + t + 1000 * w)
        return out

    def recall(self, edits: int, trials: int = 2000, seed: int = 3) -> float:
        """The share of windows that meet one with ``edits`` random word edits in some key, measured on random words."""
        rng = np.random.default_rng(seed)
        met = 0
        for _ in range(trials):
            a = rng.integers(1, 2**63, self.size).tolist()
            b = list(a)
            for _ in range(edits):
                kind, at = rng.integers(3), int(rng.integers(len(b)))
                b[at : at + (kind != 0)] = [int(rng.integers(1, 2**63))] if kind != 1 else []
            b += rng.integers(1, 2**63, self.size).tolist()
            flat = np.array(a + b, dtype=U64)
            x = self.keys(flat, np.array([0, self.size]))
            met += bool((x[0] == x[1]).any())
        return met / trials


def near_distances(items: np.ndarray, docs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, shift) for each row: the least edit distance, up to ``most`` (else most + 1), of the words in ``items`` to a run of the words in ``docs`` that begins at ``most`` + shift, |shift| <= most.

    For each diagonal of the comparison the row is kept that the edits so far
    reach (Ukkonen 1985); equal words are passed in one step by the lengths of
    the runs of matches. Words 0 in ``docs`` match nothing.
    """
    n, m = items.shape
    spread = 2 * most
    wide = np.pad(docs, ((0, 0), (most, most)))
    run = np.zeros((2 * spread + 1, m + 1, n), np.int8)
    for k in range(2 * spread + 1):
        for i in range(m - 1, -1, -1):
            run[k, i] = (items[:, i] == wide[:, i + k]) * (run[k, i + 1] + 1)
    none, rows = np.full(n, -1, np.int8), np.arange(n)
    reach = [run[k, 0] if abs(k - spread) <= most else none for k in range(2 * spread + 1)]
    begin = [np.full(n, k - spread, np.int8) for k in range(2 * spread + 1)]
    order = sorted(range(2 * spread + 1), key=lambda k: (abs(k - spread), k))
    distance, shift = np.full(n, most + 1), np.zeros(n, np.int64)
    for edits in range(most + 1):
        for k in order:
            new = (reach[k] >= m) & (distance > most)
            distance[new], shift[new] = edits, begin[k][new]
        if edits == most or (distance <= most).all():
            break
        after, origin = [], []
        for k in range(2 * spread + 1):
            far, source = np.where(reach[k] >= 0, np.minimum(reach[k] + 1, m), none), begin[k]
            for j, step in ((k - 1, 0), (k + 1, 1)):
                if 0 <= j <= 2 * spread:
                    other = np.where(reach[j] >= 0, np.minimum(reach[j] + step, m), none)
                    better = other > far
                    far, source = np.where(better, other, far), np.where(better, begin[j], source)
            after.append(np.where(far >= 0, far + run[k, np.maximum(far, 0), rows], none).astype(np.int8))
            origin.append(source)
        reach, begin = after, origin
    return distance, shift


def _packed(words: np.ndarray) -> pa.Array:
    """The rows of a table of hashes as bytes."""
    n, m = words.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (8 * m))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(words))])


WINDOWS = fields("item_id long, wid long, words binary, vocabulary long[], keys long[]")


def item_windows(items: DataFrame, item_id: str, item_text: str, embedding: Embedding) -> DataFrame:
    """(item_id, wid: hash of the window, words, vocabulary: its words as places of a filter, keys) of every window of every item."""
    size = embedding.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_words(batch.column(1).to_pylist())
            end = np.repeat(offsets[1:], np.diff(offsets))
            start = np.flatnonzero(np.arange(len(flat)) + size <= end)
            words = flat[start[:, None] + np.arange(size)]
            wid = np.zeros(len(start), U64)
            for i in range(size):
                wid = mix(wid * U64(3) + words[:, i], 9)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1)))
            own = batch.column(0).take(pa.array(owners(offsets)[start])) if len(start) else batch.column(0).slice(0, 0)
            yield pa.RecordBatch.from_arrays([own, pa.array(wid.view(np.int64)), _packed(words), lists(mix(words, 21)), lists(embedding.keys(flat, start))], names=WINDOWS.names)

    return items.select(F.col(item_id).cast("long"), F.col(item_text)).mapInArrow(run, WINDOWS)


def bit_filter(values: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits (a multiple of CELL) with a bit for each value of the one column (hashes); at most bits / 8 bytes come to the driver, whatever the values."""
    at = F.pmod(F.col(values.columns[0]), F.lit(bits))
    rows = values.select(at.alias("at")).groupBy(F.floor(F.col("at") / CELL).cast("int").alias("cell")).agg(F.bitmap_construct_agg(F.col("at") % CELL).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["cell"] * CELL // 8 : (r["cell"] + 1) * CELL // 8] = np.frombuffer(r["b"], np.uint8)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U64(len(bits) * 8 - 1)  # a power of two, so this is the positive remainder of the signed value too
    return (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


HITS = fields("doc_id long, start int, key long, words binary")
NEAR = fields("doc_id long, wid long, start int, distance int")


def leaks(docs: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, most: int = 2, embedding: Embedding | None = None, filter_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, item_id, distance, start_word, n_windows) of each document with a window within ``most`` word edits of an item's window.

    An edit is a word replaced, inserted or dropped. distance is the least of the
    matching windows, start_word (from 0) where the first of that distance begins
    in the document, n_windows the number of places in the document where a
    window of the item is matched. Windows at distance 0 are all found, others
    with the recall of the embedding. Documents and items of fewer than ``size``
    words, null and empty ones match nothing; equal documents and equal items are
    each reported. Document ids must be unique. The two filters have at most
    ``filter_bits`` bits (a power of two) together with what the items need.
    """
    embedding = embedding or Embedding()
    size, wide, span = embedding.size, embedding.size + most, embedding.size + 2 * most  # of a hit go ``most`` words more on either side
    found = spool(item_windows(items, item_id, item_text, embedding), "items")
    windows = found.groupBy("wid").agg(*[F.first(c).alias(c) for c in ("words", "vocabulary", "keys")])
    n = max(1, found.count())
    bits = lambda per: min(filter_bits, max(CELL, 1 << (n * per).bit_length()))
    vocabulary = bit_filter(windows.select(F.explode("vocabulary")), bits(2 * size))
    known = bit_filter(windows.select(F.explode("keys")), bits(8 * embedding.walks * embedding.tables))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, known))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_items, of_key = shared.value
        for batch in batches:
            flat, offsets = flat_words(batch.column(1).to_pylist())
            upto = np.concatenate([[0], np.cumsum(_passes(in_items, mix(flat, 21)))])
            end = np.repeat(offsets[1:], np.diff(offsets))
            start = np.flatnonzero(np.arange(len(flat)) + size <= end)
            start = start[upto[start + size] - upto[start] >= size - most]
            own = owners(offsets)
            padded = np.concatenate([np.zeros(most, U64), flat, np.zeros(most, U64)])
            first = np.repeat(offsets[:-1], np.diff(offsets))
            for i in range(0, len(start), BLOCK):
                part = start[i : i + BLOCK]
                keys = embedding.keys(flat, part)
                row, col = np.nonzero(_passes(of_key, keys))
                at = part[row]
                place = at[:, None] + np.arange(-most, wide)
                words = np.where((place < end[at][:, None]) & (place >= first[at][:, None]), padded[place + most], U64(0)) if len(at) else np.zeros((0, span), U64)
                ids = batch.column(0).take(pa.array(own[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array((at - offsets[own[at]]).astype(np.int32)), pa.array(keys[row, col].view(np.int64)), _packed(words)], names=HITS.names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.frombuffer(b"".join(batch.column(3).to_pylist()), U64).reshape(-1, span)
            item = np.frombuffer(b"".join(batch.column(4).to_pylist()), U64).reshape(-1, size)
            distance, start = np.zeros(len(doc), np.int64), batch.column(2).to_numpy().copy()
            unequal = np.flatnonzero((doc[:, most : most + size] != item).any(axis=1))
            for i in range(0, len(unequal), BLOCK):
                part = unequal[i : i + BLOCK]
                distance[part], shift = near_distances(item[part], doc[part], most)  # the passage may begin a little before or after the window
                start[part] = np.maximum(start[part] + shift, 0)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start.astype(np.int32)), pa.array(distance.astype(np.int32))], names=NEAR.names)
            yield out.filter(pa.array(distance <= most))

    left = docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(hits, HITS)
    right = windows.select(F.explode("keys").alias("key"), "wid", F.col("words").alias("item_words"))
    near = left.join(right, "key").select("doc_id", "wid", "start", "words", "item_words").mapInArrow(verify, NEAR)
    best = near.groupBy("doc_id", "wid", "start").agg(F.min("distance").alias("distance"))
    of_item = found.select("wid", "item_id").distinct()
    places = best.join(of_item, "wid").groupBy("doc_id", "item_id", "start").agg(F.min("distance").alias("distance"))
    first = F.min(F.struct("distance", "start"))
    return places.groupBy("doc_id", "item_id").agg(first.alias("f"), F.count("*").cast("int").alias("n_windows")).select("doc_id", "item_id", "f.distance", F.col("f.start").alias("start_word"), "n_windows")


def report(found: DataFrame) -> DataFrame:
    """How far each item leaked: documents with an exact window, documents with a near one."""
    return found.groupBy("item_id").agg(F.count_if(F.col("distance") == 0).alias("n_exact"), F.count_if(F.col("distance") > 0).alias("n_near"))
