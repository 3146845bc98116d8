"""Text that was decoded with the wrong character encoding.

Adjacent characters are counted over the whole corpus. A pair's weight is its
log-probability, lowered by the mutual information where that is negative (two
characters that avoid each other); positive information isn't rewarded, because
the characters of garbled text attract each other. Runs of improbable pairs are
isolated as maximum-scoring segments, and inverse mappings are tried inside those
runs only. A mapping is accepted when it makes the runs much more probable.
Replacement characters, and question marks where the pairs of another character
are likely, are lost characters: found, but not restorable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.schemas import fields

FOLD = 0x3000  # from here on characters count by blocks of 256, so the pair table is bounded by the alphabets
SMALL = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(FOLD)], dtype=np.int64)
SMALL[ord("0") : ord("9") + 1] = ord("0")
SMALL[:33] = ord(" ")
LOST = "?"
SEQUENCE, LEAST = 6.0, 6.0  # bits


def classes(codes: np.ndarray) -> np.ndarray:
    """Code points folded: capitals to small letters, digits and white space to one each, ideographs to their block."""
    out = codes.astype(np.int64)
    high = out >= FOLD
    out = np.where(high, out, SMALL[np.minimum(out, FOLD - 1)])
    out[high] = FOLD + (out[high] >> 8)
    return out


def text_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each ended by 0; number of the text of each code point)."""
    clean = [(t or "").replace("\x00", " ") for t in texts]
    joined = "\x00".join(clean) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in clean])


def special_pairs(codes: np.ndarray) -> np.ndarray:
    """Positions of the pairs that matter: one of the two isn't ASCII, or is the sign of lost characters; none crosses texts."""
    special = (codes > 127) | (codes == ord(LOST))
    return np.flatnonzero((special[1:] | special[:-1]) & (codes[1:] != 0) & (codes[:-1] != 0))


PAIRS = fields("pair long, n long")


def count_pairs(texts: DataFrame) -> DataFrame:
    """(pair, n) over all texts of the one column, summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(0, len(texts), 512):
                codes, _ = text_codes(texts[i : i + 512])
                at = special_pairs(codes)
                k, n = np.unique((classes(codes[at]) << 21) | classes(codes[at + 1]), return_counts=True)
                keys.append(k)
                counts.append(n)
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(k), np.int64)
            np.add.at(n, inverse, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "n"])

    return texts.mapInArrow(run, PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class PairModel:
    """Weights of character pairs, in bits."""

    pairs: np.ndarray
    weights: np.ndarray
    unseen: float

    def __post_init__(self):
        self.table = dict(zip(self.pairs.tolist(), self.weights.tolist()))
        self.special = [c for c in np.unique(self.pairs & ((1 << 21) - 1)).tolist() if 127 < c < FOLD] if len(self.pairs) else []
        self.gaps: dict[tuple[str, str], bool] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(keys), self.unseen)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.weights[at], self.unseen)

    def missing(self, left: str, right: str) -> bool:
        """Whether another character is likely between two letters where a question mark stands; remembered.

        For a letter that was seen there it is enough to be a little less probable
        than the mark, which is frequent itself where much is damaged; a sign must
        be more probable.
        """
        if (known := self.gaps.get((left, right))) is None:
            x, y, get = fold(ord(left)), fold(ord(right)), self.table.get
            mark = get((x << 21) | ord(LOST), self.unseen) + get((ord(LOST) << 21) | y, self.unseen)

            def likely(c: int) -> bool:
                a, b = get((x << 21) | c), get((c << 21) | y)
                return a is not None and b is not None and a + b - mark >= (LETTER_GAIN if chr(c).isalpha() else SIGN_GAIN)

            known = self.gaps[left, right] = any(map(likely, self.special))
        return known

    def text(self, text: str) -> tuple[float, int]:
        """Sum of the weights of the pairs that matter, and their number."""
        if len(text) > 48:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at = special_pairs(codes)
            return float(self.of((classes(codes[at]) << 21) | classes(codes[at + 1])).sum()), len(at)
        get, total, n = self.table.get, 0.0, 0
        before, special = -1, False
        for c in text:
            code = ord(c)
            now = code > 127 or c == LOST
            code = fold(code)
            if before >= 0 and (now or special):
                total += get((before << 21) | code, self.unseen)
                n += 1
            before, special = code, now
        return total, n


def fold(code: int) -> int:
    return int(SMALL[code]) if code < FOLD else FOLD + (code >> 8)


def pair_model(counts: DataFrame) -> PairModel:
    """The model from the counted pairs; the table has at most (alphabet)² rows, whatever the corpus."""
    rows = counts.orderBy("pair").toPandas()
    pair, n = rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    total = max(n.sum(), 1.0)
    left, right = pair >> 21, pair & ((1 << 21) - 1)
    sums = []
    for side in (left, right):
        _, inverse = np.unique(side, return_inverse=True)
        own = np.zeros(inverse.max() + 1 if len(inverse) else 0)
        np.add.at(own, inverse, n)
        sums.append(own[inverse] if len(inverse) else own)
    information = np.log2(n * total / (sums[0] * sums[1])) if len(n) else n
    return PairModel(pair, np.log2(n / total) + 0.5 * np.clip(information, -6, 0), float(np.log2(0.25 / total)))


def _high(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half of a one-byte encoding; undefined bytes stand for the control characters of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_15")
WRITTEN_AS = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp850")


class Utf8Reader:
    """Undoes 'UTF-8 bytes were read as a one-byte encoding'."""

    def __init__(self, codec: str):
        self.name = f"utf-8 as {codec}"
        self.bytes = _high(codec)
        leads, tails = [np.zeros(1 << 16, bool) for _ in range(2)]
        for c, b in self.bytes.items():
            leads[ord(c)], tails[ord(c)] = 0xC2 <= b <= 0xF4, 0x80 <= b <= 0xBF
        self.leads, self.tails = leads, tails
        part = lambda low, high: "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"
        tail = part(0x80, 0xBF)
        self.pattern = re.compile(f"{part(0xC2, 0xDF)}{tail}|{part(0xE0, 0xEF)}{tail}{{2}}|{part(0xF0, 0xF4)}{tail}{{3}}")

    def _one(self, m: re.Match) -> str:
        try:
            return bytes(self.bytes[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self._one, text)

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """Positions where a sequence could start."""
        low = np.minimum(codes, (1 << 16) - 1)
        return np.flatnonzero(self.leads[low[:-1]] & self.tails[low[1:]])

    def worth(self, before: tuple[float, int], after: tuple[float, int], x: str, y: str) -> float:
        """Bits won; a valid sequence of bytes is hardly ever there by chance, which counts for SEQUENCE bits each."""
        return gained(before, after) + SEQUENCE * (len(x) - len(y)) / 2

    def enough(self, gain: float, changed: list[str], pairs: int) -> bool:
        return gain >= LEAST


class ByteReader:
    """Undoes 'bytes of one one-byte encoding were read as another'."""

    def __init__(self, written: str, read: str):
        self.name = f"{written} as {read}"
        back = {b: c for c, b in _high(written).items()}
        self.table = {ord(c): back[b] for c, b in _high(read).items() if b in back and back[b] != c}

    def __call__(self, text: str) -> str:
        return text.translate(self.table)

    def worth(self, before: tuple[float, int], after: tuple[float, int], x: str, y: str) -> float:
        return gained(before, after)

    def enough(self, gain: float, changed: list[str], pairs: int) -> bool:
        """One character alone must be very unlikely where it is, seen from both sides; several different ones support each other."""
        each = gain / max(1, len(changed))
        kinds = len(set(changed))
        return (each >= 12 and pairs >= 2 * len(changed)) or (kinds >= 2 and each >= 6 and gain >= 2 * LEAST) or (kinds >= 4 and each >= 2 and gain >= 5 * LEAST)


def readers() -> list:
    return [Utf8Reader(c) for c in READ_AS] + [ByteReader(w, r) for w in WRITTEN_AS for r in READ_AS if w != r and (w, r) != ("cp1252", "iso8859_15")]


def segments(positions: list[int], scores: list[float], gap: float = 1.0) -> list[tuple[int, int]]:
    """All maximal-scoring segments (Ruzzo and Tompa 1999) of a sparse sequence, as (first, last position); positions not given score ``-gap``."""
    stack: list[list] = []  # [left sum, right sum, first, last]
    total, before = 0.0, None
    for p, s in zip(positions, scores):
        if before is not None:
            total -= gap * (p - before - 1)
        before = p
        start = total
        total += s
        if s <= 0:
            continue
        item = [start, total, p, p]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= item[0]:
                j -= 1
            if j < 0 or stack[j][1] >= item[1]:
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
        stack.append(item)
    return [(x[2], x[3]) for x in stack]


def runs_of(text: str, model: PairModel, level: float) -> list[tuple[int, int]]:
    """The improbable runs [start, end) of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = special_pairs(codes)
    score = level - model.of((classes(codes[at]) << 21) | classes(codes[at + 1]))
    return [(a, b + 2) for a, b in segments(at.tolist(), score.tolist())]


def gained(before: tuple[float, int], after: tuple[float, int]) -> float:
    """Bits won by a change: the difference of the mean weights, over the pairs there were."""
    return (after[0] / after[1] if after[1] else 0.0) * before[1] - before[0]


LINK = re.compile(r"\S*(?:://|www\.)\S*|\S*\?[\w.%\[\]-]+=\S*|(?<![\w.])[\w-]+(?:\.[\w-]+)+/\S*|(?<!\S)/\S*/\S*")
LOST_ONE = re.compile(r"([^\W\d_])\?([^\W\d_])")
LETTER_GAIN, SIGN_GAIN = -6.0, 3.0  # bits
LOST_INSIDE = re.compile(r"[^\W\d_]\?{2,}[^\W\d_]|(?<![^\s(\[“\"„«‘'—–-])\?+[^\W\d_]|(?<!\S)\?+\s+\?")
LOST_END = re.compile(r"[^\W\d_]\?+[,;:]?[ \t]+([^\W\d_])")


def lost(text: str, model: PairModel) -> bool:
    """Whether characters of a text were replaced.

    U+FFFD always says so. A question mark between two letters does when some
    other character is likely there (:meth:`PairModel.missing`).
    Several in a row inside a word, one at its start, at its end where the
    sentence goes on, or in place of whole words do by their place. Links don't
    count.
    """
    if "\ufffd" in text:
        return True
    if "?" not in text:
        return False
    if "/" in text or "=" in text or "www." in text:
        text = LINK.sub(" ", text)
    if any(model.missing(m[1], m[2]) for m in LOST_ONE.finditer(text)):
        return True
    if LOST_INSIDE.search(text) or any(m[1].islower() for m in LOST_END.finditer(text)):
        return True
    return "??" in text and not any(c.isalnum() for c in text)


class Effects:
    """What each mapping makes of a short run, remembered: the same runs come up again and again."""

    def __init__(self, model: PairModel, limit: int = 200_000):
        self.model, self.limit, self.seen, self.base = model, limit, {}, {}

    def __call__(self, m, run: str) -> tuple[str, float, int] | None:
        """(result, bits won, pairs of the run), or None where the mapping changes or wins nothing."""
        key = (m.name, run)
        if key in self.seen:
            return self.seen[key]
        if len(self.seen) >= self.limit:
            self.seen.clear()
            self.base.clear()
        out = m(run)
        won = None
        if out != run:
            if (before := self.base.get(run)) is None:
                before = self.base[run] = self.model.text(run)
            if (more := m.worth(before, self.model.text(out), run, out)) > 0:
                won = (out, more, before[1])
        self.seen[key] = won
        return won


def restore(text: str, model: PairModel, effects: Effects, fit: list, maps: list, level: float, rounds: int = 3) -> tuple[str, str | None]:
    """(text with its garbled runs restored, names of the mappings used or None). ``fit`` are the mappings to try first, ``maps`` those for what a first one leaves."""
    used = []
    for _ in range(rounds):
        runs = runs_of(text, model, level)
        if not runs:
            break
        wide: list[list[int]] = []
        for x, y in runs:
            x, y = max(0, x - 1), min(len(text), y + 1)
            if wide and x <= wide[-1][1]:
                wide[-1][1] = y
            else:
                wide.append([x, y])
        old = [text[a:b] for a, b in wide]
        best = (0.0, None, None)
        for m in maps if used else fit:
            gain, new, changed, pairs = 0.0, [], [], 0
            for x in old:
                if (won := effects(m, x)) is None:
                    new.append(x)
                    continue
                y, more, n = won
                gain, pairs = gain + more, pairs + n
                new.append(y)
                changed += [p for p, q in zip(x, y) if p != q] if len(x) == len(y) else [x]
            if gain > best[0] and m.enough(gain, changed, pairs):
                best = (gain, new, m.name)
        if best[1] is None:
            break
        out, end = [], 0
        for (x, y), new in zip(wide, best[1]):
            out += [text[end:x], new]
            end = y
        text = "".join(out) + text[end:]
        used.append(best[2])
        if " as " in best[2] and not best[2].startswith("utf-8"):
            break
    return text, " + ".join(used) or None


FOUND = fields("id long, field_name string, restored string, mapping string, lost boolean")


def garbled(rows: DataFrame, id_col: str, columns: list[str], level: float = -7.0, rare: float = -13.0) -> DataFrame:
    """(id, field_name, restored, mapping, lost) of every field of ``columns`` that is garbled in all or part.

    ``level`` is the weight below which a pair is improbable. One-byte
    mappings are tried on fields with a pair below ``rare``, UTF-8 mappings on
    fields with a possible sequence in their encoding. ``lost`` marks fields with
    replacement characters or question marks in place of letters (:func:`lost`,
    asked of every field); their restored text still has them. Null and empty fields are never garbled. The pair counts
    cover all fields of all rows.
    """
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns]))
    texts = rows.select(F.col(id_col).cast("long").alias("id"), cols.alias("f")).select("id", "f.field_name", "f.text").where("text is not null")
    model = pair_model(count_pairs(texts.select("text")))
    shared = rows.sparkSession.sparkContext.broadcast((model.pairs, model.weights, model.unseen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maps = PairModel(*shared.value), readers()
        effects = Effects(known)
        by_sequence, by_byte = ([m for m in maps if isinstance(m, kind)] for kind in (Utf8Reader, ByteReader))
        for batch in batches:
            ids, names, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for i in range(0, len(texts), 512):
                codes, owner = text_codes(texts[i : i + 512])
                at = special_pairs(codes)
                weak = known.of((classes(codes[at]) << 21) | classes(codes[at + 1])) < rare
                look = dict.fromkeys(np.unique(owner[at[weak | (codes[at] == 0xFFFD)]]).tolist(), by_byte)
                for m in by_sequence:
                    for k in np.unique(owner[m.possible(codes)]).tolist():
                        look[k] = [*look.get(k, []), m]
                for k, text in enumerate(texts[i : i + 512]):
                    gone = lost(text, known)
                    fixed, mapping = restore(text, known, effects, look[k], maps, level) if k in look else (text, None)
                    if mapping or gone:
                        out.append((ids[i + k], names[i + k], fixed, mapping, gone))
            cols = list(zip(*out)) if out else [[] for _ in FOUND.names]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FOUND.names)

    return texts.mapInArrow(run, FOUND)
