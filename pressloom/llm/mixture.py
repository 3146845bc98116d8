"""Mixing sources to target weights, measured in tokens.

Token totals are raked (iterative proportional fitting) to the marginals of
source, language and topic over the cells of the three, with no weight above the
repeats its source allows; the step for sources comes last, so their shares are
met exactly in expectation. A document's weight is the expected number of its
copies: the whole part is sure, the rest is drawn by sequential Poisson sampling
with random numbers that come from the id, cut where the tokens of the source
reach its part.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.words import U64, flat_words, mix, owners
from pressloom.schemas import fields
from pressloom.session import spool

# Fixed value: the published split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLACES = 4096  # hashed words of a topic vector


def encoder(path: str):
    """A tiktoken encoding over a public vocabulary file; no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of the texts: number of places of each text, then the places of all of them and how often each occurs."""
    flat, offsets = flat_words(texts)
    both, n = np.unique(owners(offsets).astype(np.int64) * PLACES + (flat % U64(PLACES)).astype(np.int64), return_counts=True)
    return np.bincount(both // PLACES, minlength=len(texts)), (both % PLACES).astype(np.uint16), n.astype(np.uint32)


def units(size: np.ndarray, places: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The values at the places when each text is a unit vector of damped counts times ``weight``; zeros for one without weight."""
    v, own = np.log1p(n) * weight[places], np.repeat(np.arange(len(size)), size)
    norm = np.sqrt(np.bincount(own, v * v, len(size)))
    return (v / np.maximum(norm, 1e-9)[own]).astype(np.float32)


def cosines(size: np.ndarray, places: np.ndarray, v: np.ndarray, centres: np.ndarray, at_once: int = 256) -> np.ndarray:
    """Texts x centres. A text's row is the same in any batch."""
    out, end = np.zeros((len(size), len(centres)), np.float32), np.cumsum(size)
    table, full = np.ascontiguousarray(centres.T), np.flatnonzero(size)
    for k in range(0, len(full), at_once):
        part = full[k : k + at_once]
        low = end[part[0]] - size[part[0]]
        at = slice(low, end[part[-1]])
        out[part] = np.add.reduceat(table[places[at]] * v[at, None], end[part] - size[part] - low)
    return out


@dataclass(frozen=True)
class Topics:
    """Centres of each language's topics, and the weights of the hashed words there."""

    weight: dict
    centres: dict

    def of(self, texts: list[str | None], langs: list[str]) -> list[str]:
        """The nearest topic of its language for each text; ``other`` without words that weigh something."""
        out = ["other"] * len(texts)
        for lang in set(langs) & set(self.centres):
            at = [i for i, x in enumerate(langs) if x == lang]
            size, places, n = bags([texts[i] for i in at])
            near = cosines(size, places, v := units(size, places, n, self.weight[lang]), self.centres[lang])
            some = np.bincount(np.repeat(np.arange(len(at)), size), v, len(at)) > 0
            for i, k in zip(np.array(at)[some], near[some].argmax(axis=1)):
                out[i] = f"{lang}-{k}"
        return out


BAGS = fields("doc_id long, lang string, places binary, n binary")
SUMS = fields("lang string, at int, sums binary")
PICKS = fields("lang string, at int, far double, doc_id long, places binary, n binary")
FINE = float(1 << 24)  # sums are of integers, so that no order of rows changes them


def _bag_table(docs: DataFrame) -> DataFrame:
    """The hashed words of (doc_id, lang, text), for texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, places, n = bags(batch.column(2).to_pylist())
            end = np.cumsum(size)
            cut = lambda x: pa.array([x[e - k : e].tobytes() for e, k in zip(end, size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut(places), cut(n)], names=BAGS.names).filter(pa.array(size > 0))

    return docs.where("lang is not null and length(text) > 0").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "lang", "text").mapInArrow(run, BAGS)


def _by_lang(batches: Iterator[pa.RecordBatch], langs: Mapping) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, its rows, size, places, n) of each batch of a bag table, for ``langs`` only."""
    for batch in batches:
        of = np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(of) & set(langs)):
            rows = batch.filter(pa.array(of == lang))
            places, n = (rows.column(i).to_pylist() for i in (2, 3))
            yield lang, rows, np.array([len(x) // 2 for x in places], np.int64), np.frombuffer(b"".join(places), np.uint16), np.frombuffer(b"".join(n), np.uint32)


def _summed(rows: DataFrame, part: Callable) -> dict[tuple[str, int], np.ndarray]:
    """Sums by (language, at) of what ``part(batches)`` gives as (language, at, whole numbers): first in each task, then by key, so one row a key comes to the driver."""

    def add(sums: Iterator[tuple[str, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for lang, at, x in sums:
            total[lang, at] = total[lang, at] + x if (lang, at) in total else x
        for (lang, at), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=SUMS.names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add((r["lang"], r["at"], np.frombuffer(r["sums"], np.int64)) for batch in batches for r in batch.to_pylist())

    out = rows.mapInArrow(lambda batches: add(part(batches)), SUMS).repartition("lang", "at").mapInArrow(again, SUMS)
    return {(r["lang"], r["at"]): np.frombuffer(r["sums"], np.int64) for r in out.collect()}


def _word_weights(rows: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """By language the weight of each place and the number of texts. Places that half of the texts have weigh nothing."""
    every = {r["lang"]: None for r in rows.select("lang").distinct().collect()}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
        for lang, _, size, places, _ in _by_lang(batches, every):
            yield lang, 0, np.append(np.bincount(places, minlength=PLACES), len(size))

    weight, texts = {}, {}
    for (lang, _), x in _summed(rows, part).items():
        seen, texts[lang] = x[:-1], int(x[-1])
        weight[lang] = np.where(2 * seen >= texts[lang], 0, np.log((1 + texts[lang]) / (1 + seen))).astype(np.float32)
    return weight, texts


def _next_centres(rows: DataFrame, weight: dict, centres: dict, seed: int) -> dict[str, np.ndarray]:
    """One more centre for each start: a text, drawn from all with chances by the squared distance to the centres so far.

    The least of exponential numbers over the chances is such a draw; the
    numbers come from the ids.
    """
    context = rows.sparkSession.sparkContext
    model = context.broadcast((weight, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, centres = model.value
        best: dict = {}
        for lang, part, size, places, n in _by_lang(batches, centres):
            v = units(size, places, n, weight[lang])
            some = np.bincount(np.repeat(np.arange(len(size)), size), v, len(size)) > 0
            starts, have, _ = centres[lang].shape
            ids = part.column(0).to_numpy()
            near = cosines(size, places, v, centres[lang].reshape(-1, PLACES)).reshape(len(size), starts, have)
            for s in range(starts):
                far = np.square(np.clip(1 - near[:, s].astype(float).max(axis=1), 0, None)) + 1e-12 if have else np.ones(len(size))
                chance = (mix(mix(ids.astype(U64), seed), s * 1000 + have) >> U64(11)).astype(float) + 0.5
                key = np.where(some, -np.log(chance / (1 << 53)) / far, np.inf)
                k = int(np.lexsort((ids, key))[0])
                if key[k] < np.inf and (key[k], int(ids[k])) < best.get((lang, s), (np.inf,))[:2]:
                    best[lang, s] = (float(key[k]), int(ids[k]), part.column(2)[k].as_py(), part.column(3)[k].as_py())
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(PICKS.names, (*at, *x))) for at, x in best.items()], schema=pa.schema([("lang", pa.string()), ("at", pa.int32()), ("far", pa.float64()), ("doc_id", pa.int64()), ("places", pa.binary()), ("n", pa.binary())]))

    least = rows.mapInArrow(run, PICKS).groupBy("lang", "at").agg(F.min(F.struct("far", "doc_id", "places", "n")).alias("r")).select("lang", "at", "r.*").collect()
    model.destroy()
    new: dict = {}
    for r in sorted(least, key=lambda r: (r["lang"], r["at"])):
        places, n = np.frombuffer(r["places"], np.uint16), np.frombuffer(r["n"], np.uint32)
        c = np.zeros((1, PLACES), np.float32)
        c[0, places] = units(np.array([len(places)]), places, n, weight[r["lang"]])
        new.setdefault(r["lang"], []).append(c)
    return {lang: np.concatenate([centres[lang], np.stack(c)], axis=1) for lang, c in new.items()}


def _nearest_sums(rows: DataFrame, weight: dict, centres: dict) -> dict[tuple[str, int], tuple[np.ndarray, int]]:
    """By language and start: the sums of the texts nearest to each centre, and the sum of their cosines."""
    model = rows.sparkSession.sparkContext.broadcast((weight, centres))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
        weight, centres = model.value
        for lang, _, size, places, n in _by_lang(batches, centres):
            v = units(size, places, n, weight[lang])
            starts, each, _ = centres[lang].shape
            near = cosines(size, places, v, centres[lang].reshape(-1, PLACES)).reshape(len(size), starts, each)
            fine = np.rint(v * FINE)
            for s in range(starts):
                own = np.repeat(near[:, s].argmax(axis=1), size)
                sums = np.bincount(own * PLACES + places, fine, each * PLACES)
                yield lang, s, np.append(sums, np.rint(near[:, s].max(axis=1) * FINE).sum(dtype=float)).astype(np.int64)

    out = {at: (x[:-1].reshape(-1, PLACES), int(x[-1])) for at, x in _summed(rows, part).items()}
    model.destroy()
    return out


def learn_topics(docs: DataFrame, each: int = 5, rounds: int = 8, starts: int = 4, seed: int = 5) -> Topics:
    """Spherical k-means of ``each`` topics a language, the best of ``starts`` starts, fitted to all texts of (doc_id, lang, text).

    The texts are stored once as counts of hashed words; each step reads all of
    them for all languages and starts together, and only sums come to the driver.
    Nothing depends on the order of rows.
    """
    rows = spool(_bag_table(docs), "bags")
    weight, texts = _word_weights(rows)
    centres = {lang: np.zeros((starts, 0, PLACES), np.float32) for lang in weight}
    for k in range(min(each, max(texts.values(), default=0))):
        centres |= _next_centres(rows, weight, {lang: c for lang, c in centres.items() if c.shape[1] == k < texts[lang]}, seed)
    centres = {lang: c for lang, c in centres.items() if c.shape[1]}
    for k in range(rounds + 1):
        found = _nearest_sums(rows, weight, centres)
        new = {lang: c.copy() for lang, c in centres.items()}
        for (lang, s), (sums, _) in found.items():
            some = sums.any(axis=1)
            new[lang][s, some] = sums[some] / np.linalg.norm(sums[some].astype(float), axis=1, keepdims=True)
        if k == rounds or all(np.array_equal(new[lang], centres[lang]) for lang in new):
            break
        centres = new
    return Topics(weight, {lang: c[max(range(starts), key=lambda s: found[lang, s][1])] for lang, c in centres.items()})


MEASURED = fields("doc_id long, source string, lang string, topic string, n_tokens long")


def measured(docs: DataFrame, path: str, topic: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of (doc_id, source, lang, text).

    ``topic`` names a column with topics; without one they are learned
    (:func:`learn_topics`). Null and empty texts have no tokens; a null or blank
    language is ``und``, a null topic ``other``. The vocabulary file at ``path``
    is sent to all executors.
    """
    context = docs.sparkSession.sparkContext
    context.addFile(path)
    name = path.rpartition("/")[2]
    lang = F.coalesce(F.lower(F.nullif(F.trim("lang"), F.lit(""))), F.lit("und"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", lang.alias("lang"), "text", F.coalesce(F.col(topic).cast("string"), F.lit("other")).alias("topic") if topic else F.lit(None).cast("string").alias("topic"))
    model = None if topic else context.broadcast(learn_topics(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            texts = batch.column(3).to_pylist()
            kinds = batch.column(4) if model is None else pa.array(model.value.of(texts, batch.column(2).to_pylist()), pa.string())
            sizes = [len(encode(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), kinds, pa.array(sizes, pa.int64())], names=MEASURED.names)

    return rows.mapInArrow(run, MEASURED)


@dataclass
class Cells:
    """Token totals of the cells, their source, language and topic."""

    tokens: np.ndarray
    labels: list[np.ndarray]

    def sums(self, weight: np.ndarray, side: int, size: int) -> np.ndarray:
        return np.bincount(self.labels[side], weights=self.tokens * weight, minlength=size)


def rake(cells: Cells, targets: list[np.ndarray | None], cap: np.ndarray, total: float, rounds: int = 200, close: float = 1e-6) -> np.ndarray:
    """Weights of the cells. ``targets[0]`` (sources) is met exactly where ``cap`` allows; the other marginals as far as they can be beside it."""
    weight = np.full(len(cells.tokens), 1.0)
    for _ in range(rounds):
        before = weight.copy()
        for side in range(len(targets) - 1, -1, -1):
            if (share := targets[side]) is None:
                continue
            for _ in range(20 if side == 0 else 1):  # what is cut at the cap goes to the other cells of the source
                have = cells.sums(weight, side, len(share))
                factor = np.divide(share * total, have, out=np.ones(len(share)), where=have > 0)
                weight = np.minimum(weight * factor[cells.labels[side]], cap)
                if np.allclose(factor, 1, atol=close):
                    break
        if np.max(np.abs(weight - before) / np.maximum(before, 1e-12), initial=0) < close:
            break
    return weight


def mixture(docs: DataFrame, targets: DataFrame, path: str, tokens: float | None = None, marginals: Mapping[str, Mapping[str, float]] | None = None, topic: str | None = None, bins: int = 2000, seed: int = 1) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, copies) of every document of the sources in ``targets``.

    ``targets``: source (unique), target_share, max_repeats; shares are scaled to
    sum to 1 over the sources that have tokens. ``tokens`` is the size of the
    mixture; by default the largest that the repeats allow. ``marginals`` are the
    target shares by label for ``lang`` and ``topic``, scaled to 1 over the labels
    that have tokens (labels left out get none); a side without targets keeps the
    shares it has in the
    sources' texts. Documents of other or null sources have no row; those
    without tokens have no copies. Doc ids must be unique. The cells (sources in
    ``targets`` x languages x topics) come to the driver; documents don't.
    """
    wanted = targets.where("source is not null and target_share > 0").select("source", F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    sizes = spool(measured(docs.join(wanted.select("source"), "source", "left_semi").select("doc_id", "source", "lang", "text", *([topic] if topic else [])), path, topic), "tokens")
    cell_rows = sizes.where("n_tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).orderBy("source", "lang", "topic").toPandas()
    goal = wanted.orderBy("source").toPandas().drop_duplicates("source").set_index("source")
    names = [sorted(set(cell_rows[c])) for c in ("source", "lang", "topic")]
    at = [np.array([names[i].index(x) for x in cell_rows[c]], dtype=np.int64) for i, c in enumerate(("source", "lang", "topic"))]
    cells = Cells(cell_rows["tokens"].to_numpy(float), at)
    share = goal["share"].reindex(names[0]).to_numpy(float)
    share = share / share.sum() if len(share) else share
    cap = goal["cap"].reindex(names[0]).to_numpy(float)
    ones = np.ones(len(cells.tokens))
    most = float((cap * cells.sums(ones, 0, len(share)) / share).min()) if len(share) else 0.0
    total = min(tokens or most, most)
    sides = []
    for i, side in ((1, "lang"), (2, "topic")):
        wanted_shares = (marginals or {}).get(side)
        value = np.array([wanted_shares.get(x, 0.0) for x in names[i]]) if wanted_shares else cells.sums(ones, i, len(names[i]))
        sides.append(value / max(value.sum(), 1e-12))
    weight = rake(cells, [share, *sides], cap[at[0]] if len(at[0]) else ones, total)
    spark = docs.sparkSession
    rows = [(s, la, t, float(w)) for s, la, t, w in zip(cell_rows["source"], cell_rows["lang"], cell_rows["topic"], weight)]
    weights = spark.createDataFrame(rows, "c_source string, c_lang string, c_topic string, weight double")
    on = (F.col("source") == F.col("c_source")) & (F.col("lang") == F.col("c_lang")) & (F.col("topic") == F.col("c_topic"))
    df = sizes.join(weights, on, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    df = df.withColumn("whole", F.floor("weight")).withColumn("rest", F.col("weight") - F.col("whole"))
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    order = F.when(F.col("rest") > 1e-9, chance / F.col("rest"))
    df = df.withColumn("bin", F.floor(order / (1 + order) * bins).cast("int"))
    by_bin = df.where("bin is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("rest")).alias("due")).toPandas()  # at most ``bins`` rows a source
    edge = []
    for source, part in by_bin.groupby("source"):
        part = part.sort_values("bin")
        run = part["t"].cumsum().to_numpy(float)
        due = float(part["due"].sum())
        k = int(np.searchsorted(run, due))
        if k > 0 and (k == len(run) or abs(run[k - 1] - due) <= abs(run[k] - due)):
            k -= 1
        take = int(part["bin"].iloc[k]) if len(run) and abs(run[k] - due) <= due else -1
        edge.append((source, take))
    edges = spark.createDataFrame(edge, "e_source string, edge int")
    df = df.join(edges, F.col("source") == F.col("e_source"), "left")
    copies = F.col("whole") + F.when(F.col("bin") <= F.col("edge"), 1).otherwise(0)
    return df.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), copies.cast("int").alias("copies"))


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share, tokens in the mixture, most copies of one document, documents used and unused. A source without documents has share 0."""
    per = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") > 0).alias("n_used"), F.count_if(F.col("copies") == 0).alias("n_unused")
    )
    whole = per.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").join(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    actual = F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0))
    return out.select("source", "target_share", F.round(actual, 6).alias("actual_share"), zero("tokens"), "max_repeats", zero("most_copies"), zero("n_used"), zero("n_unused"))


def gaps(mixed: DataFrame, targets: DataFrame, marginals: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(side, label, target_share, actual_share, gap) of every source, language and topic. Sides without targets are measured against the shares of all their texts."""
    rows = mixed.select("n_tokens", "copies", F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("label")) for c in ("source", "lang", "topic")])).alias("s"))
    per = rows.groupBy("s.side", "s.label").agg(F.sum("n_tokens").alias("natural"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    whole = per.groupBy(F.col("side").alias("w_side")).agg(F.sum("natural").alias("w_natural"), F.sum("tokens").alias("w_tokens"))  # three rows
    told = [(side, label, float(x)) for side, shares in (marginals or {}).items() for label, x in shares.items()]
    wanted = mixed.sparkSession.createDataFrame(told, "t_side string, t_label string, t_share double").unionByName(targets.select(F.lit("source").alias("t_side"), F.col("source").alias("t_label"), F.col("target_share").alias("t_share")))
    sides = [F.lit("source"), *[F.lit(x) for x in (marginals or {})]]
    out = per.join(F.broadcast(whole), F.col("side") == F.col("w_side")).join(wanted, (F.col("side") == F.col("t_side")) & F.col("label").eqNullSafe(F.col("t_label")), "left")
    target = F.when(F.col("side").isin(*sides), F.coalesce("t_share", F.lit(0.0))).otherwise(F.try_divide("natural", "w_natural"))
    actual = F.coalesce(F.try_divide("tokens", "w_tokens"), F.lit(0.0))
    return out.select("side", "label", F.round(target, 6).alias("target_share"), F.round(actual, 6).alias("actual_share"), F.round(actual - target, 6).alias("gap"))
