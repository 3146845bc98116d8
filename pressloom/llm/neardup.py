"""Near-duplicate records by fast similarity sketching, banding and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup 2017) throws the elements of a set
into ``t`` bins, round by round with a fresh hash function, until every bin is
filled; rounds t to 2t-1 aim at one bin each, so all bins fill for any set. A bin
keeps its least (round, value), and two sketches agree in a bin with a
probability equal to the overlap of the sets, concentrated like a sample of
size t.

Bands of several bins give the keys; with ``bands`` bands a band has as many bins
as the recall asked for allows at the threshold. Nearly all keys of a text are
its own and meet none, so keys travel packed: a batch sends, for each part of the
key space, one row with four bytes a key and the gaps between the ids, and only
keys that two texts have go on as rows. Pairs that share a key are first compared
by one bit a bin (b-bit minwise hashing, Li and König 2010): what falls
``deviations`` standard deviations below the agreement expected at the threshold
is left out. The rest is verified with the whole sets of 64-bit shingles, which
only texts in such a pair are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.words import U64, flat_words, mix, owners, shingle_hashes
from pressloom.operators.components import components
from pressloom.schemas import fields
from pressloom.session import spool


def sketches(elements: np.ndarray, owner: np.ndarray, n: int, t: int, seed: int = 1000) -> np.ndarray:
    """Fast similarity sketches, ``n`` rows of ``t``; the rows of empty sets are all ones (no value)."""
    none = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, none, dtype=U64)
    left_e, left_o = elements, owner
    for i in range(2 * t):
        h = mix(left_e, seed + i)
        b = (h % U64(t)).astype(np.int64) if i < t else np.full(len(h), i - t, dtype=np.int64)
        value = (U64(i) << U64(48)) | (h >> U64(16))
        np.minimum.at(out, left_o * t + b, value)
        open_rows = (out.reshape(n, t) == none).any(axis=1)
        keep = open_rows[left_o]
        if not keep.any():
            break
        left_e, left_o = left_e[keep], left_o[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int, tag: int) -> np.ndarray:
    """One key for each band of ``rows`` bins."""
    n, t = sketch.shape
    bands = t // rows
    keys = np.zeros((n, bands), U64)
    for r in range(rows):
        keys = mix(keys * U64(5) + sketch[:, r : bands * rows : rows], r + 1)
    return mix(keys + np.arange(bands, dtype=U64)[None, :], 77 + tag).view(np.int64)


def least_overlap(bands: int, rows: int, recall: float) -> float:
    """The overlap from which two sets share one of ``bands`` bands of ``rows`` bins with a probability of ``recall``."""
    return (1 - (1 - recall) ** (1 / bands)) ** (1 / rows)


def most_rows(bands: int, threshold: float, recall: float) -> int:
    """The most bins a band may have, so that sets with an overlap of ``threshold`` share one of ``bands`` bands with a probability of ``recall``."""
    rows = 1
    while rows < 16 and least_overlap(bands, rows + 1, recall) <= threshold:
        rows += 1
    return rows


MARKS = 3  # longs of one bit a bin


def bin_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest bits of 64 * MARKS bins, as MARKS longs a text."""
    return np.packbits((sketch & U64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def least_agreeing(used: int, threshold: float, deviations: float) -> int:
    """The bits of ``used`` that two sketches agree in at least, ``deviations`` below what is expected at ``threshold``."""
    p = (1 + threshold) / 2
    return int(np.floor(used * p - deviations * np.sqrt(used * p * (1 - p))))


def _shingled(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingles, number of their text) of the second column, without repeats inside a text."""
    flat, offsets = flat_words(batch.column(1).to_pylist())
    sh, at = shingle_hashes(flat, offsets, size)
    own = owners(offsets)[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((sh, own))
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    return sh[new], own[new]


def _same(sh: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two independent hashes) of the set of each text."""
    size_of = np.bincount(own, minlength=n)
    sums = []
    for seed in (5, 6):
        total = np.zeros(n, U64)
        np.add.at(total, own, mix(sh, seed))
        sums.append(mix(total + size_of.astype(U64), seed + 2).view(np.int64))
    return size_of, *sums


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))


FEATURES = fields("id long, same long, also long, n int, " + ", ".join(f"b{i} long" for i in range(MARKS)))


def features(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, same, also: two hashes of the shingle set, n: its size, b0..: one bit a bin) of each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sh, own = _shingled(batch, size)
            size_of, same, also = _same(sh, own, n)
            bits = bin_bits(sketches(sh, own, n, 64 * MARKS, 5000))  # another sketch than that of the bands
            cols = [batch.column(0), pa.array(same), pa.array(also), pa.array(size_of.astype(np.int32)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(MARKS)]]
            yield pa.RecordBatch.from_arrays(cols, names=FEATURES.names).filter(pa.array(size_of > 0))

    return _texts(df, id_col, text).mapInArrow(run, FEATURES)


PACKED = fields("part int, width int, first long, keys binary, steps binary")


def packed_keys(df: DataFrame, id_col: str, text: str, size: int, bands: int, rows: int, parts: int) -> DataFrame:
    """All band keys, one row for each batch and part of the key space: the lower 32 bits of the keys, in the order of the ids, and the gaps between those.

    Texts of a batch with the same shingles send one set of keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sh, own = _shingled(batch, size)
            size_of, same, also = _same(sh, own, n)
            ids = batch.column(0).to_numpy()
            seen, first = np.unique(np.stack([same, also]), axis=1, return_index=True)
            first = first[size_of[first] > 0]
            first = first[np.argsort(ids[first], kind="stable")]
            number = np.full(n, -1)
            number[first] = np.arange(len(first))
            keep = number[own] >= 0
            keys = band_keys(sketches(sh[keep], number[own[keep]], len(first), bands * rows), rows, 1).view(U64).reshape(-1)
            owner = np.repeat(ids[first], bands)
            part = (keys % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            low, owner, part = (keys >> U64(32)).astype(np.uint32)[order], owner[order], part[order]
            out = {c: [] for c in PACKED.names}
            for x, y in zip(*_runs(part)):
                steps = np.diff(owner[x:y])
                width = next(w for w in (1, 2, 4, 8) if w == 8 or steps.max(initial=0) < 1 << (8 * w))
                for c, v in zip(PACKED.names, (part[x], width, owner[x], low[x:y].tobytes(), steps.astype(f"u{width}").tobytes())):
                    out[c].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(PACKED.names, kinds)], names=PACKED.names)

    return _texts(df, id_col, text).mapInArrow(run, PACKED)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return (np.concatenate([[0], edge]), np.append(edge, len(ordered))) if len(ordered) else (edge, edge)


SHARED = fields("key long, id long")


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key, id) of the keys that at least two texts have. A part holds a bounded share of all keys; the texts of one key are rows, never pairs."""

    def run(table: pa.Table) -> pa.Table:
        keys, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for width, first, low, steps in zip(*(table.column(c).to_pylist() for c in PACKED.names[1:])):
            keys.append(np.frombuffer(low, np.uint32))
            ids.append(first + np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"u{width}").astype(np.int64))]))
        key, id_ = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, id_ = key[order], id_[order]
        same = key[1:] == key[:-1]
        many = np.append(same, False) | np.concatenate([[False], same])
        whole = (np.int64(table.column("part")[0].as_py()) << 32) | key[many].astype(np.int64)
        return pa.table({"key": whole, "id": id_[many]})

    return packed.groupBy("part").applyInArrow(run, SHARED)


FILTER_BITS = 32768  # bits of one row of the filter, as bitmap_construct_agg makes them


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` whose id may be in ``ids`` (id): all that are, and few others. The broadcast filter has at most ``rows`` rows of 4 KB, whatever the ids."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(rows * FILTER_BITS))
    bits = ids.select(place("id").alias("at")).groupBy(F.floor(F.col("at") / FILTER_BITS).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("at") % FILTER_BITS).alias("_bits"))
    at = place(F.col(id_col).cast("long"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor((at % FILTER_BITS) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = (F.col("_bucket") == F.floor(at / FILTER_BITS)) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return df.join(F.broadcast(bits), hit).select(*df.columns)


SETS = fields("id long, shingles long[]")


def shingle_sets(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sh, own = _shingled(batch, size)
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(np.bincount(own, minlength=batch.num_rows), out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sh.view(np.int64)))], names=SETS.names)

    return _texts(df, id_col, text).mapInArrow(run, SETS)


def overlap_of(left: str, right: str):
    """Exact overlap of two sets held as arrays without repeats."""
    common = F.size(F.array_intersect(left, right))
    return common / (F.size(left) + F.size(right) - common)


def similar(df: DataFrame, id_col: str, text: str, size: int = 5, threshold: float = 0.8, bands: int = 24, recall: float = 0.995, deviations: float = 3.7, part_keys: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and the pairs of classes with an overlap of ``threshold`` or more.

    Returns (members: id, class_id; links: a, b, overlap with a < b); class_id is
    the least id of the texts with the same set of shingles. Ids must be unique.
    Texts of fewer than ``size`` words (null and empty too) have no shingles and
    are in neither table. Any number of copies is one class before pairs are
    sought, so a bucket is no larger than the number of different texts that look
    alike, and buckets are joined, never gathered. A pair at the threshold shares
    a band with a probability of ``recall`` or more and is then refuted by its
    bits with one of the normal tail beyond ``deviations``; pairs above it are
    lost less often. Rows of null id are left out. A part holds about ``part_keys`` keys.
    """
    rows = most_rows(bands, threshold, recall)
    df, id_col, text = _texts(df, id_col, text).where("id is not null"), "id", "text"
    feats = spool(features(df, id_col, text, size), "sketches")
    texts = feats.count()
    parts = max(16, -(-texts * bands // part_keys))
    heads = feats.groupBy("same", "also").agg(F.min("id").alias("class_id"))
    known = spool(feats.join(heads, ["same", "also"]).drop("same", "also"), "classes")
    members = known.select("id", "class_id")
    met = shared_keys(packed_keys(df, id_col, text, size, bands, rows, parts)).join(known, "id").select("key", "class_id", "n", *FEATURES.names[4:])
    left, right = (met.toDF("key", side, *[f"{c}{side}" for c in met.columns[2:]]) for side in ("a", "b"))
    sized = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)  # no overlap can be larger than the ratio of the sizes
    differ = sum((F.bit_count(F.col(f"b{i}a").bitwiseXOR(F.col(f"b{i}b"))) for i in range(MARKS)), F.lit(0))
    near = differ <= 64 * MARKS - least_agreeing(64 * MARKS, threshold, deviations)
    pairs = spool(left.join(right, "key").where((F.col("a") < F.col("b")) & sized & near).select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = shingle_sets(only_ids(df, id_col, ends, min(16384, max(16, texts * 8 // FILTER_BITS))), id_col, text, size)
    checked = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", overlap_of("sa", "sb").alias("overlap"))
        .where(F.col("overlap") >= threshold)
    )
    return members, checked


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links between classes and the copies within one, spelled out for single texts."""
    x, y = members.select(F.col("class_id").alias("a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    many = members.groupBy("class_id").count().where("count > 1").select("class_id")
    copies = members.join(many, "class_id", "left_semi")
    within = copies.select("class_id", F.col("id").alias("x")).join(copies.select("class_id", F.col("id").alias("y")), "class_id").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(df: DataFrame, id_col: str, text: str, **parameters) -> DataFrame:
    """One row for each text with shingles: id, class_id (equal texts), group_id (least id that links lead to), n_links.

    n_links counts the other classes that the class of the text is linked to.
    """
    members, links = similar(df, id_col, text, **parameters)
    links = spool(links, "links")
    both = links.select(F.col("a").alias("class_id")).union(links.select(F.col("b").alias("class_id")))
    degree = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    label = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    out = members.join(degree, "class_id", "left").join(label, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
