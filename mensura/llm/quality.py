"""Per-document text statistics and whether a text is prose, a list, a table or junk."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.session import cut

#: Common words of the corpus's languages (fixed values).
COMMON = frozenset(
    "a an and are as at be been but by can could for from had has have if in into is it its may more not of on one only or said so such than that the their then there these this to was were when where which while who will with without would "
    "der die das den dem des ein eine einen einer eines und oder ist sind war wird werden wurde von zu zum zur mit nach aus bei auf für im in nicht kann sein dass wenn als auch durch "
    "le la les un une des du de et ou est sont était être dans sur par pour avec que qui ne pas il elle ce cette se au aux "
    "el los las una unas y o es son fue ser en por para con que no se al del lo su sus como".split()
)
#: What is counted, in order.
COUNTS = ("chars", "words", "word_chars", "symbols", "lines", "ended_lines", "common_words", "letters", "prose", "list", "table", "junk", "spoken", "repeated", "pairs", "cost")
AT = {n: i for i, n in enumerate(COUNTS)}
#: Words within which a repeated pair of words counts as said again.
WINDOW = 64
#: Share of repeated pairs of words from which a text says the same over and over.
REPEATED = 0.7
ENDS = frozenset(".!?:;…\"”»")
#: 1 letter, 2 symbol, 0 digits, blanks and halves of characters beyond the basic plane.
CLASS = np.array([0 if 0xD800 <= i < 0xE000 else 1 if chr(i).isalpha() else 0 if chr(i).isalnum() or chr(i).isspace() else 2 for i in range(65536)], dtype=np.uint8)
#: Number of a letter: 1 to 26, 27 for letters beyond the alphabet, 0 for all other characters.
LETTER = np.array([0 if 0xD800 <= i < 0xE000 or not chr(i).isalpha() else ord(chr(i).lower()) - 96 if "a" <= chr(i).lower() <= "z" and len(chr(i).lower()) == 1 else 27 for i in range(65536)], dtype=np.int64)
LETTERS = 28
#: Fewest pairs of letters by which a text can be called unreadable.
LEAST_PAIRS = 20
BULLET = re.compile(r"^\s*(?:[•*▪◦‣·–—-]\s+\S|o\s+\S|\(?\d{1,4}[.)]\s|\(?[a-z][.)]\s|\(?[ivx]+[.)]\s|example\s+\d+\s*$|\d{1,4}\s*(?:\.{2,}|[-–—:=])\s)", re.I)
GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
CAPTIONS = ("table", "tabelle", "tableau", "tabla")
CAPTION = re.compile(r"^\s*\w+\s+\d+", re.I)
WIDE = re.compile(r"\S {3,}\S")
MACHINE = re.compile(r"0x[0-9a-f]{4,}|##\w+##|<img\b|\[formula\s*\d+\]|^\W*page\s+\d+(\s+of\s+\d+)?\W*$", re.I)
PAGE_NUMBER = re.compile(r"^\W*\d+\W*$")
RULER = re.compile(r"^[\s|+=_:.*-]*$")
CODE_LINE = re.compile(r"^[A-Za-z0-9+/=]{40,}$")
#: Signs of a broken encoding; text in a language that has some of them rarely has one in ten.
ODD = re.compile("[\ufffd\u25a1\u25a0\ufffe\x00-\x08\x0e-\x1f\x80-\xff\u0192\u20ac\u2018-\u201e\u2020-\u2022]")
CITATION = re.compile(r"^[A-Z]{2}[ -]?\d{5,}\b")
FORMULA_MARK = re.compile(r"\\frac|\$\$|[_^]\{|&(?:le|ge|times|lt|gt);|</?su[bp]|[₀-₉⁰-⁹□�]|\bln\(|[–-]\(?CH2\)|\bR ?\d[–-]")
CELL_MARK = re.compile(r"</?t[dhr]\b|</?table\b", re.I)
SHORT_FORMULA = re.compile(r"^(?:[A-Z][a-z]?\d*){3,}$")


def line_kind(line: str, words: list[str], common: int, tight: str) -> str:
    """prose, list, table or junk. ``words`` are the line's words in lower case, ``tight`` all their characters."""
    n, size, plain = len(words), len(tight), line.isascii()
    talk = common / n
    marked = "<t" in line or "</t" in line
    if n >= 6 and talk >= 0.15 and not (marked and CELL_MARK.search(line)):
        return "junk" if not plain and len(ODD.findall(line)) * 5 > size * 2 else "prose"
    if marked and CELL_MARK.search(line):
        return "table"
    solid = sum(map(str.isalnum, tight))
    letters = sum(map(str.isalpha, tight)) if solid else 0
    symbols = size - solid
    if line[0] in "+|-= " and size >= 3 and RULER.match(line) and ("+" in line or "|" in line or "---" in line or "===" in line):
        return "table" if "-" in line or "=" in line else "junk"
    if not solid or not letters and line.count("|") < 2 and PAGE_NUMBER.match(line):
        return "junk"
    if not plain and len(ODD.findall(line)) * 5 > size * 2:
        return "junk"
    if symbols > 0.6 * size and letters < 0.1 * size and "+++" not in line and line.count("&") < 2:
        return "junk"
    if line.count("|") >= 2 or line.count("\t") >= 2 or (" & " in line and line.rstrip().endswith("\\\\")):
        return "table"
    if MACHINE.search(line) or size >= 40 and any(len(w) >= 40 and CODE_LINE.match(w) for w in words):
        return "junk"
    if FORMULA_MARK.search(line) or SHORT_FORMULA.match(line.replace(" ", "")):
        return "junk" if talk < 0.15 else "prose"
    bullet = BULLET.match(line)
    rest = line[bullet.end() :] if bullet else line
    if talk < 0.15 and ("  " in rest and WIDE.search(rest) and len(GAPS.findall(rest)) >= 2 or "\t" in rest and n <= 6):
        return "table"
    commas = line.count(",")
    if commas and talk == 0:
        close = commas - line.count(", ")
        if close and size / (close + 1) <= 14 and not CITATION.match(line) and (commas >= 2 or any(map(str.isdigit, tight))):
            return "table"
    if talk < 0.1 and line.count(";") >= 3:
        return "list"
    if bullet:
        return "list" if n <= 5 or talk < 0.2 and n <= 20 else "prose"
    if CITATION.match(line):
        return "list"
    if words[0] in CAPTIONS and n <= 6 and CAPTION.match(line):
        return "table"
    return "list" if n <= 6 and talk < 0.2 else "prose"


@dataclass
class Said:
    """Repeats of neighbouring words within WINDOW words, with the first and last words, so that two stretches can be joined exactly."""

    repeated: int = 0
    first: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)

    @staticmethod
    def count(words: list[str]) -> int:
        seen: dict[tuple[str, str], int] = {}
        again = 0
        for i, pair in enumerate(zip(words, words[1:])):
            at = seen.get(pair)
            if at is not None and i - at <= WINDOW:
                again += 1
            seen[pair] = i
        return again

    @classmethod
    def of(cls, words: list[str]) -> Said:
        k = WINDOW + 2
        return cls(cls.count(words), words[:k], words[-k:])

    def then(self, other: Said) -> Said:
        k = WINDOW + 2
        across = self.count(self.last + other.first) - self.count(self.last) - self.count(other.first) if self.last and other.first else 0
        first = self.first if len(self.first) >= k else (self.first + other.first)[:k]
        last = other.last if len(other.last) >= k else (self.last + other.last)[-k:]
        return Said(self.repeated + other.repeated + across, first, last)


@dataclass
class Part:
    """Counts of the whole lines of a stretch of text, and the open fragments at its ends.

    ``head`` is what stands before the first line break, None if there is none (then all is ``tail``).
    """

    counts: list[float]
    said: Said
    head: str | None
    tail: str

    @classmethod
    def of(cls, text: str) -> Part:
        if "\n" not in text:
            return cls([0] * len(COUNTS), Said(), None, text)
        first, last = text.index("\n"), text.rindex("\n")
        counts, said = judge(text[first + 1 : last])
        return cls(counts, said, text[:first], text[last + 1 :])

    def take(self, line: str) -> None:
        counts, said = judge(line)
        self.counts = [x + y for x, y in zip(self.counts, counts)]
        self.said = self.said.then(said)

    def then(self, other: Part) -> Part:
        """The join of two neighbouring stretches; the line across the boundary is judged once it is whole."""
        out = Part(list(self.counts), self.said, self.head, self.tail)
        if other.head is None:
            out.tail += other.tail
            return out
        if out.head is None:
            out.head = out.tail + other.head
        else:
            out.take(out.tail + other.head)
        out.counts = [x + y for x, y in zip(out.counts, other.counts)]
        out.said = out.said.then(other.said)
        out.tail = other.tail
        return out

    def finish(self) -> list[float]:
        front, front_said = judge(self.head or "")
        back, back_said = judge(self.tail)
        counts = [x + y + z for x, y, z in zip(front, self.counts, back)]
        counts[AT["repeated"]] = front_said.then(self.said).then(back_said).repeated
        return counts

    def dump(self) -> bytes:
        return json.dumps([self.counts, self.said.repeated, self.said.first, self.said.last, self.head, self.tail]).encode()

    @classmethod
    def load(cls, raw: bytes) -> Part:
        counts, repeated, first, last, head, tail = json.loads(raw)
        return cls(counts, Said(repeated, first, last), head, tail)


def letter_pairs(text: str) -> np.ndarray:
    """Codes of the pairs of neighbouring letters in runs of three letters or more."""
    x = LETTER[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)]
    on = np.concatenate([[False], x > 0, [False]])
    both = on[1:-2] & on[2:-1]
    return (x[:-1] * LETTERS + x[1:])[both & (on[:-3] | on[3:])]


def judge(text: str, repeats: bool = True) -> tuple[list[float], Said]:
    """Counts over whole lines, and the words of its prose lines for the repeats.

    Without ``repeats`` they are only counted where they can matter: the first time a word comes up it
    opens a new pair, so repeats cannot reach the rule's share while the words are that various.
    The last count, the letter pairs' cost, is filled in by ``text_counts``, which knows the corpus.
    """
    n_words = word_chars = n_lines = ended_lines = common_words = 0
    kinds = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    spoken: list[str] = []
    for line, low in zip(text.split("\n"), text.lower().split("\n")):
        words = low.split()
        if not words:
            continue
        common = sum(map(COMMON.__contains__, words))
        tight = "".join(words)
        n_lines += 1
        n_words += len(words)
        word_chars += len(tight)
        common_words += common
        ended_lines += tight[-1] in ENDS
        kind = line_kind(line, words, common, tight)
        kinds[kind] += len(tight)
        if kind == "prose":
            spoken += words
    classes = CLASS[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)]
    said = Said.of(spoken) if repeats or len(set(spoken)) <= (1 - REPEATED) * len(spoken) + 1 else Said()
    pairs = letter_pairs(text)
    cost = float(COST.table[pairs].sum()) if COST.table is not None else 0.0
    return [word_chars, n_words, word_chars, int((classes == 2).sum()), n_lines, ended_lines, common_words, int((classes == 1).sum()), kinds["prose"], kinds["list"], kinds["table"], kinds["junk"], len(spoken), said.repeated, len(pairs), cost], said


class COST:
    """The letter pairs' cost table of the task at hand."""

    table: np.ndarray | None = None


@dataclass(frozen=True)
class Script:
    """What letters follow each other in the corpus: bits that each pair costs, and the mean cost from which a text is unreadable."""

    cost: np.ndarray
    unreadable: float


def learn_script(documents: DataFrame) -> Script:
    """Pairs of neighbouring letters, counted over all documents (LETTERS * LETTERS sums).

    A pair costs minus log2 of the probability of its second letter after its first. A text is unreadable
    when its pairs cost more on average than halfway between what the corpus's own text costs and
    what its letters would cost in random order: nothing is set by hand.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(letter_pairs(text), minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(total[on], pa.int64())], names=["pair", "n"])

    rows = documents.select("text").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(LETTERS * LETTERS)
    for r in rows:
        seen[r["pair"]] = r["n"]
    seen = seen.reshape(LETTERS, LETTERS)
    smooth = seen + 0.5
    cost = -np.log2(smooth / smooth.sum(1, keepdims=True))
    if not seen.sum():
        return Script(cost.ravel(), float("inf"))
    first, second = seen.sum(1) / seen.sum(), seen.sum(0) / seen.sum()
    own, mixed = float((seen * cost).sum() / seen.sum()), float(first @ cost @ second)
    return Script(cost.ravel(), (own + mixed) / 2)


def _whole(script: Script, chunk: int):
    """(.., counts, text): the counts of short texts; long ones are cut into chunks, which travel on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        COST.table = script.cost
        for batch in batches:
            ids, copies, nth, counts, parts = [], [], [], [], []
            for i, copy, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                pieces = [text[at : at + chunk] for at in range(0, len(text), chunk)] or [""]
                for n, piece in enumerate(pieces):
                    ids.append(i)
                    copies.append(copy)
                    nth.append(n)
                    counts.append([float(x) for x in judge(text, repeats=False)[0]] if len(pieces) == 1 else None)
                    parts.append(None if len(pieces) == 1 else piece)
                    if len(parts) >= 256 and len(pieces) > 1:
                        yield _frame(ids, copies, nth, counts, parts)
                        ids, copies, nth, counts, parts = [], [], [], [], []
            yield _frame(ids, copies, nth, counts, parts)

    return run


def _frame(ids: list, copies: list, nth: list, counts: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(nth, pa.int32()), pa.array(counts, pa.list_(pa.float64())), pa.array(parts, pa.string())], names=["doc_id", "copy", "nth", "counts", "text"])


def _open(script: Script):
    """The part of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        COST.table = script.cost
        for batch in batches:
            parts = [Part.of(t).dump() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.nulls(len(parts), pa.list_(pa.float64())), pa.array(parts, pa.binary())], names=["doc_id", "copy", "nth", "counts", "part"])

    return run


def _merge(last: bool, script: Script):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        COST.table = script.cost
        parts = [Part.load(p) for p in pdf.sort_values("nth")["part"]]
        total = parts[0]
        for p in parts[1:]:
            total = total.then(p)
        return pd.DataFrame({"doc_id": [key[0]], "copy": [key[1]], "nth": [key[2]], "counts": [[float(x) for x in total.finish()] if last else None], "part": [None if last else total.dump()]})

    return run


def text_counts(documents: DataFrame, script: Script | None = None, chunk: int = 32_768, fan_in: int = 16) -> DataFrame:
    """(doc_id, counts) of every document, ``counts`` in the order of COUNTS.

    Texts longer than ``chunk`` characters are cut into chunks at fixed places, whatever stands there, and
    the chunks are dealt over the cluster. Every chunk gives counts over its whole lines and keeps the
    fragments at both ends; neighbouring parts are joined ``fan_in`` at a time, level by level, the line
    across a boundary being judged when it is whole, however long it is. Line breaks of any kind count.
    Shares of texts without words or lines are 0. Null and empty texts are junk; a null doc_id is left
    out; repeated ids with the same text come out once. ``script`` is learnt from the documents unless
    it is given.
    """
    script = script or learn_script(documents)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\n?|[\\u2028\\u2029\\u0085\\u000b\\u000c]", "\n")
    docs = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    parts = cut(docs.mapInArrow(_whole(script, chunk), "doc_id bigint, copy bigint, nth int, counts array<double>, text string"))
    done = parts.filter("counts is not null").select("doc_id", "counts")
    chunks = parts.filter("counts is null").select("doc_id", "copy", "nth", "text").dropDuplicates(["doc_id", "copy", "nth"])
    most = chunks.agg(F.max("nth")).first()[0]
    if most is None:
        return done
    schema = "doc_id bigint, copy bigint, nth int, counts array<double>, part binary"
    level = chunks.mapInArrow(_open(script), schema)  # after the shuffle by chunk
    while True:
        last = most < fan_in
        level = level.groupBy("doc_id", "copy", F.floor(F.col("nth") / fan_in).cast("int").alias("up")).applyInPandas(_merge(last, script), schema)
        if last:
            return done.unionByName(level.select("doc_id", "counts"))
        most //= fan_in


def ratios(counted: DataFrame, script: Script) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ended_line_share, common_word_share, text_kind) out of the counts.

    The rule outcome: junk if there is no word, or no letter outside a table, if the letters follow each other as they do not
    in the corpus (see ``learn_script``), if most of the text is prose whose pairs of neighbouring words
    are mostly said again within WINDOW words, or if most characters stand in junk lines; else table
    or list if most stand in such lines; else the largest share.
    """
    c = lambda n: F.col("counts")[AT[n]]
    share = lambda a, b: F.round(F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0)), 6)
    total = c("chars")
    best = F.greatest(c("prose"), c("list"), c("table"), c("junk"))
    kind = (
        F.when((c("words") == 0) | (c("letters") == 0) & (c("table") <= 0.5 * total), "junk").when((c("pairs") >= LEAST_PAIRS) & (c("cost") > c("pairs") * script.unreadable), "junk")
        .when((c("spoken") >= 12) & (c("prose") > 0.5 * total) & (c("repeated") >= REPEATED * c("spoken")), "junk")
        .when(c("junk") > 0.5 * total, "junk").when(c("table") > 0.5 * total, "table").when(c("list") > 0.5 * total, "list")
        .when(c("prose") == best, "prose").when(c("list") == best, "list").when(c("table") == best, "table").otherwise("junk")
    )
    return counted.select(
        "doc_id", c("words").cast("long").alias("words"), share("word_chars", "words").alias("mean_word_length"), share("symbols", "chars").alias("symbol_ratio"),
        share("ended_lines", "lines").alias("ended_line_share"), share("common_words", "words").alias("common_word_share"), kind.alias("text_kind"),
    ).distinct()


def text_statistics(documents: DataFrame, **how: int) -> DataFrame:
    """The figures and the kind of every document."""
    script = learn_script(documents)
    return ratios(text_counts(documents, script, **how), script)
