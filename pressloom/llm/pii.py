"""Personal information in free text: found through disguises, replaced by typed placeholders.

A transducer rewrites a text into a plain shadow (look-alike letters, wide forms
and typographic signs become ASCII; spelled-out digits become figures; ``(at)``,
``[dot]`` and spaced signs become ``@`` and ``.``) and remembers for every shadow
character where it came from. Identifiers are found in the shadow, and their
spans are mapped back to the source, which is changed nowhere else.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import STOPWORDS
from pressloom.schemas import fields

# Given names.
GIVEN = frozenset(
    """
    Adam Agnes Alan Alex Alice Amelia Ana Anders Andrea Andrew André Anja Anna Anna-Lena Anouk Anton Antonio Arthur Astrid Aylin
    Bärbel Basil Beatriz Ben Birgit Björn Bruno Camille Carla Carlos Carmen Celia Charlotte Chloé Christian Clara Claire Daniel Dario David
    Diana Diego Edda Elena Elias Elif Elsa Emil Emily Emma Erik Ernst Eva Fabio Fatima Felix Fiona Francesca François Frank Frida
    Gabriel George Gilda Giulia Greta Gustav Hanna Hannah Hans Heidi Helen Henk Henrik Hugo Ida Ilse Ines Ingrid Irma Isabel Ivan
    Jack Jakob James Jan Jane Jean Jean-Luc Joana João John Jonas Jorge Joris José Juan Julia Karen Karin Karl Karla Kira Klaus
    Lars Laura Lea Lena Leo Liam Linda Lisa Lucas Lucía Luis Lukas Magda Marco Maria María Marie Mark Marta Martin Mary Matteo
    Max Michael Miguel Mila Milo Mina Miriam Nadia Nils Nina Noah Nora Olaf Olga Oscar Oskar Otto Pablo Paul Pavel Pedro Peter
    Petra Pierre Piet Rafael Renée Rita Robert Rolf Rosa Samuel Sara Selma Sofia Søren Stefan Susan Sven Teresa Thomas Tilda Tomas
    Ugo Ursa Vera Victor Viggo Walt Wanda William Yara Yusuf Zeno Zoë
    """.split()
)
# Given names in Cyrillic letters.
GIVEN_CYRILLIC = frozenset(
    """
    Александр Алексей Анастасия Андрей Анна Антон Борис Вадим Валентина Василий Вера Виктор Владимир Галина Григорий Дарья Дмитрий Евгений
    Екатерина Елена Иван Игорь Ирина Кирилл Ксения Людмила Максим Мария Михаил Надежда Наталья Никита Николай Ольга Павел Пётр Роман
    Светлана Сергей Татьяна Юлия Юрий
    """.split()
)
# Verbs of speech beside a name.
SAID = "said says told added argued wrote asked explained noted sagte erklärte betonte dijo afirmó señaló disse afirmou declarou dit déclaré сказал сказала заявил заявила сообщил сообщила"
# Offices that stand before a family name.
OFFICES = frozenset("Minister President Chancellor Mayor Judge Captain Officer Senator Governor Director Secretary General Colonel Chief King Queen Prince Princess Pope Saint Councillor Ministerin Präsident Kanzler Bürgermeister Ministre Président Maire Ministro Presidente Alcalde Prefeito".split())
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХавекмнорстухіѕјԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTYXaBekmHopctyxisjdgABEZHIKMNOPTYXoav"))
# Digits as words.
DIGITS = {w: str(i) for i, ws in enumerate(("zero oh null", "one eins", "two zwei", "three drei", "four vier", "five fünf", "six sechs", "seven sieben", "eight acht", "nine neun")) for w in ws.split()}
# Words that aren't family names.
NOT_FAMILY = frozenset("Street St Road Rd Avenue Ave Drive Lane Terrace Close Group Union Agency Institute Works Company University Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())

SIGNS = str.maketrans({"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "＠": "@", "．": ".", "＋": "+"})
ALIKE = str.maketrans(LOOKALIKES)
MIXED = re.compile("(?=\\S*[A-Za-z])(?=\\S*[" + "".join(LOOKALIKES) + "])\\S+")
HIDDEN = re.compile("[­​-‍⁠﻿]")
WIDE = re.compile("[！-～]")
_DIGIT = "|".join(DIGITS)
DISGUISE = re.compile(
    rf"""
    (?P<at>\s*[\[({{<]\s*(?:at|arroba|arobase)\s*[\])}}>]\s*|(?<=[\w])\s+@\s+(?=[\w])|(?<=[\w])\s+@(?=[\w.-]+\.\w)|(?<=[\w])@\s+(?=[\w.-]+\.\w))
  | (?P<dot>\s*[\[({{<]\s*(?:dot|punkt|punto|point)\s*[\])}}>]\s*)
  | (?P<words>(?<=\w)\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)+))
  | (?P<wdot>(?<=\w)\s+dot\s+(?=\w))
  | (?P<hidden>[­​-‍⁠﻿])
  | (?P<spell>\b(?:{_DIGIT})(?:[\s,.-]+(?:{_DIGIT})){{5,}}\b)
    """,
    re.X | re.I,
)
TRIGGER = re.compile(r"[­​-‍⁠﻿]|@\s|\s@|[\[({<]\s*(?:at|dot|arroba|arobase|punkt|punto|point)\s*[\])}>]|\sdot\s", re.I)
LOOKING = re.compile("[" + "".join(LOOKALIKES) + "]")
ODD = re.compile("[" + "".join(map(chr, SIGNS)) + "！-～]")


def spoken_digits(text: str) -> bool:
    """Whether a text has words for digits in such a number that six of them may stand together."""
    low = text.lower()
    return sum(low.count(w) for w in DIGITS) >= 6


def shadow(text: str) -> tuple[str, list[int] | None]:
    """(plain shadow, source position of each shadow character and of the end; None when they are the same)."""
    plain = text
    if not text.isascii() and ODD.search(text):
        plain = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text.translate(SIGNS))
    if not text.isascii() and LOOKING.search(plain):  # only where the scripts are mixed: words of another script stay
        plain = MIXED.sub(lambda m: m[0].translate(ALIKE), plain)
    if not TRIGGER.search(plain) and not spoken_digits(plain):
        return plain, None
    out, source, end = [], [], 0
    for m in DISGUISE.finditer(plain):
        out.append(plain[end : m.start()])
        source.extend(range(end, m.start()))
        kind = m.lastgroup
        if kind == "spell":
            spoken = list(re.finditer(_DIGIT, m[0], re.I))
            for k, w in enumerate(spoken):
                if len(spoken) == 10 and k in (3, 6):  # as a number of ten digits is written
                    out.append("-")
                    source.append(m.start() + w.start() - 1)
                out.append(DIGITS[w[0].lower()])
                source.append(m.start() + w.start())
        elif kind != "hidden":
            out.append("@" if kind in ("at", "words") else ".")
            source.append(m.start())
        end = m.end()
    out.append(plain[end:])
    source.extend(range(end, len(plain) + 1))
    return "".join(out), source


DIGIT_RUN = re.compile(r"\d")
EMAIL = re.compile(r"(?<![\w.+%-])[\w][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}", re.U)
PHONE = re.compile(
    r"""(?<![\w.,/@+-])(?:
    \+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\(?\d{1,4}\)?(?:[ .\-/]?\d{1,8}){1,6}
  | 00\d{2}[ ./-]?\(?\d{1,4}\)?(?:[ .\-/]\d{2,8}){1,5}
  | (?:1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}
  | \(?0\d{1,4}\)?[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}
  | 0\d(?:[ .-]\d\d){4}
    )(?![\w]|[.,-]\d)""",
    re.X,
)
ID_NUMBER = re.compile(
    r"""(?<![\w.,/@+$€£-])(?:
    \d{3}[ -]\d{2}[ -]\d{4}
  | \d{4}[ ]\d{4}[ ]\d{4}(?:[ ]\d{4})?
  | \d{1,2}\.\d{3}\.\d{3}-[\dKk]
  | [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]
  | [A-Z]{1,2}\d{7,8}
    )(?![\w]|[.,-]\d)""",
    re.X,
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
_TOWN = rf"(?:,?[ ](?:(?:[A-Z]{{1,2}}-)?\d{{5}}[ ]{_CAP}|{_CAP}(?:[ ]\d{{5}})?))?"
_KIND = r"(?:Street|St|Road|Rd|Drive|Dr|Avenue|Ave|Lane|Ln|Terrace|Close|Court|Ct|Place|Pl|Square|Sq|Row|Way|Crescent|Cres|Boulevard|Blvd|Gardens|Grove|Hill|Parade|Mews|Quay|Walk|Yard|View|Alley)\b\.?"
ADDRESS = re.compile(
    rf"""(?<![\w.,/-])(?:
    (?:(?:Apt|Apartment|Flat|Unit|Suite|Ste)\b\.?[ ]?\#?[\w-]{{1,5}},?[ ])?\d{{1,5}}[A-Za-z]?[ ](?:(?:[NSEW]|St|Mt|Ste)\.?[ ])?(?:{_CAP}[ ]){{1,3}}{_KIND}(?:,?[ ](?:Apt|Apartment|Flat|Unit|Suite)\b\.?[ ][\w-]{{1,5}})?(?:,{_TOWN})?
  | P\.?[ ]?O\.?[ ]?Box[ ]\d+(?:,{_TOWN})?
  | (?:Postfach|Apartado|Boîte[ ]postale|BP)[ ]\d+
  | \d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|quai|impasse|route|cours|passage|square)[ ](?:(?:de[ ]la|des|du|de|d’|d'|l’|l')[ ]?)*(?:[ ]?{_CAP})+{_TOWN}
  | (?:[A-ZÄÖÜ][\wäöüß-]*?(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|graben|markt|hof)|(?:Am|An[ ]der|An[ ]den|Im|In[ ]der|Zum|Zur|Auf[ ]dem|Unter[ ]den)(?:[ ]{_CAP}){{1,3}})[ ]\d{{1,4}}(?:[ ]?[a-z]\b)?{_TOWN}
  | (?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Carrera|Rua|Rúa|Travessa|Praça)[ ]?(?:(?:de[ ]la|de[ ]los|de[ ]las|del|de|do|da|dos|das)[ ])?{_CAP}(?:[ ]{_CAP}){{0,2}},?[ ](?:n\.?º?[ ]?)?\d{{1,4}}[a-z]?\b{_TOWN}
    )""",
    re.X,
)
_UPPER = "[" + "".join(c for c in map(chr, [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if c.isupper()) + "]"
_NAME = rf"{_UPPER}[^\W\d_]+(?:[-’']{_UPPER}[^\W\d_]+)*"
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Mx|Prof|Sir|Dame|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Senhora?|Dona)"
FORWARD = re.compile(rf"(?<![\w@-])({_NAME})((?:[  ]+{_UPPER}\.)*)[  ]+({_NAME})(?![\w@])")
BACKWARD = re.compile(rf"(?<![\w@-])({_NAME}),[  ]+({_NAME})((?:[  ]{_UPPER}\.)*)(?![\w@]|[  ]+{_UPPER})")
TITLED = re.compile(rf"(?<![\w@-]){_TITLE}\b\.?[  ]+$")
MORE = re.compile(rf"[  ]+({_NAME})(?![\w@])")
LISTED = re.compile(rf"(?:,?[  ]+(?:and|or|und|oder|et|ou|y|o|e|и)|,)[  ]+{_UPPER}")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


PAIR = re.compile(rf"(?<![\w@-])({_NAME})[   ]+({_NAME})(?![\w@])")
_SPEECH = "(?:" + "|".join(SAID.split()) + r")\b"
SPEAKS = re.compile(rf"(?:,[  ]+\d\d,)?[  ]+(?:a[  ]+)?{_SPEECH}")
SPOKEN = re.compile(rf"\b{_SPEECH}[  ]+\Z")
COMMON = frozenset(w.capitalize() for w in STOPWORDS)


@dataclass(frozen=True)
class Names:
    """Given names, and words that end names of organisations and places."""

    given: frozenset = GIVEN | GIVEN_CYRILLIC
    kinds: frozenset = NOT_FAMILY

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of persons: a known given name, any after a title, or any beside a verb of speech, with a family name.

        A family name that is a given name too is taken along with the family
        name after it ('Jean Paul Sartre'); after a comma it may also be the next
        of a list.
        """
        given, kinds, at = self.given, self.kinds, 0
        while m := FORWARD.search(text, at):
            if m[3] not in kinds and (m[1] in given or TITLED.search(text, max(0, m.start() - 12), m.start()) or self._speaks(text, m)):
                at = m.end()
                if m[3] in given and (more := MORE.match(text, at)) and more[1] not in kinds:
                    at = more.end()
                yield m.start(), at
            else:
                at = m.end(1)
        for m in BACKWARD.finditer(text):
            if m[2] in given and m[1] not in kinds:
                if m[1] not in given or m[3] or not (LISTED.match(text, m.end()) or text[: m.start()].rstrip().endswith(",")):
                    yield m.span()

    def _speaks(self, text: str, m: re.Match) -> bool:
        if m[1] in COMMON or m[1] in OFFICES or m[1] in self.kinds:
            return False
        return bool(SPEAKS.match(text, m.end()) or SPOKEN.search(text, max(0, m.start() - 14), m.start()))


BUILT_IN = Names()


def learn_kinds(docs: DataFrame, text: str, share: float = 0.002, person: float = 0.05) -> frozenset:
    """Words that end names of organisations and places, counted over all texts: second words of at least ``share`` of all capitalised pairs that don't begin with a known given name, unless ``person`` or more of their pairs do.

    At most 1 / ``share`` words come to the driver. Pairs are summed in each batch before the shuffle.
    """
    schema = fields("word string, n long, persons long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, persons = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                for first, second in PAIR.findall(t or ""):
                    (persons if first in BUILT_IN.given else n)[second] += 1
            words = list({**n, **persons})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([persons[w] for w in words], pa.int64())], names=schema.names)

    counts = docs.select(text).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("persons").alias("persons"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    rows = counts.join(total).where((F.col("n") >= F.greatest(F.lit(20.0), F.col("total") * share)) & (F.col("persons") < person * (F.col("n") + F.col("persons")))).select("word").collect()
    return frozenset(r["word"] for r in rows)


def spans(text: str | None, names: Names = BUILT_IN) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in source positions, sorted, without overlaps."""
    if not text:
        return []
    plain, source = shadow(text)
    found = []
    digits = DIGIT_RUN.search(plain)
    for rank, (kind, pattern) in enumerate((("email", EMAIL), ("address", ADDRESS), ("id_number", ID_NUMBER), ("phone", PHONE))):
        if kind == "email" and "@" not in plain or kind != "email" and not digits:
            continue
        for m in pattern.finditer(plain):
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            found.append((rank, *m.span(), kind))
    found += [(4, a, b, "name") for a, b in names.spans(plain)]
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(found):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))
    if source is not None:
        taken = [(source[a], source[b - 1] + 1 if source[b] == source[b - 1] + 1 else source[b], kind) for a, b, kind in taken]
    return sorted(taken)


def redact(text: str | None, found: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with every span (``found``, or else sought) replaced by its placeholder; null stays null."""
    if text is None:
        return None
    out, end = [], 0
    for a, b, kind in spans(text) if found is None else found:
        out += [text[end:a], PLACEHOLDER[kind]]
        end = b
    return "".join(out) + text[end:]


FOUND = fields("doc_id long, pii_kind string, start_pos int, end_pos int")


def occurrences(docs: DataFrame, id_col: str, text: str, given: frozenset = BUILT_IN.given) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos): one row per occurrence, positions in characters from 0.

    ``given`` are the known given names; the endings of other names are learned
    from all texts first. Texts aren't shuffled; null and empty ones have no row.
    """
    names = Names(given, NOT_FAMILY | learn_kinds(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, kind, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, kind in spans(t, names)]
            cols = list(zip(*rows)) if rows else [[] for _ in FOUND.names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=FOUND.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, FOUND)


def redacted(docs: DataFrame, id_col: str, text: str, given: frozenset = BUILT_IN.given) -> DataFrame:
    """(id, text, n_found) of every row, its text with placeholders; each text is scanned once for them."""
    schema = fields("doc_id long, text string, n_found int")
    names = Names(given, NOT_FAMILY | learn_kinds(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t, names) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()), pa.array([len(f) for f in found], pa.int32())], names=schema.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, schema)
