"""Passages of held-out items inside training documents, found with suffix arrays of the training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hyphen at a line end and the break after it vanish.
HYPHEN_BREAK = re.compile("[-­‐‑]+[^\\S\\n]*\\r?\\n\\s*")
PUNCTUATION = re.compile(r"[\W_]+")
#: Words that a verbatim match has at least; a suffix that shares fewer with every item is left out of the array.
DEPTH = 4


class Words(dict):
    """Number of a raw token: 1 and up for the items' words, 0 for any other word, -1 for mere punctuation."""

    def __init__(self, vocabulary: dict[str, int], most: int = 500_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, token: str) -> int:
        bare = PUNCTUATION.sub("", token)
        n = self.vocabulary.get(bare, 0) if bare else -1
        if len(self) < self.most:
            self[token] = n
        return n


def plain(text: str | None) -> list[str]:
    """Lower-case tokens without hyphens at line ends."""
    text = (text or "").lower()
    if "\n" in text:
        text = HYPHEN_BREAK.sub("", text)
    return text.split()


@dataclass
class Items:
    """The held-out items of one block: ids, word numbers, the keys of all suffixes' first DEPTH words, and the words of all items in a row (0 between them)."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray
    item: np.ndarray
    start: np.ndarray
    flat: np.ndarray
    begin: np.ndarray


def key_of(words: np.ndarray) -> np.ndarray:
    """The first DEPTH words of every suffix as one number; equal numbers of unequal words are told apart when the match is measured."""
    w = words.astype(np.uint64)
    n = max(len(w) - DEPTH + 1, 0)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(DEPTH):
        key = key * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return key


def prepare(items: list[tuple[int, str]]) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item_id, text in items:
        bare = [b for b in (PUNCTUATION.sub("", t) for t in plain(text)) if b]
        ids.append(item_id)
        words.append(np.array([vocabulary.setdefault(b, len(vocabulary) + 1) for b in bare], dtype=np.int32))
    keys = [key_of(w) for w in words]
    item = np.repeat(np.arange(len(ids)), np.array([len(k) for k in keys], dtype=np.int64))
    start = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, dtype=np.int64)
    stop = np.zeros(1, dtype=np.int32)
    flat = np.concatenate([stop, *(x for w in words for x in (w, stop)), np.zeros(DEPTH, dtype=np.int32)])
    begin = np.cumsum([1] + [len(w) + 1 for w in words])[:-1]
    return Items(ids, words, vocabulary, np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), item, start, flat, begin)


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in the order of their words, ``depth`` words deep (no item is longer).

    Suffixes whose first DEPTH words begin no item suffix (``wanted``: sorted keys) match nothing and are
    left out. The others are sorted by those words and then, as long as some are equal, by the next one;
    0 is a word that no item has, or a document's end, where matches end too.
    """
    keys = key_of(text)
    at = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
    places = np.flatnonzero(wanted[at] == keys) if len(wanted) else np.zeros(0, dtype=np.int64)
    order = np.argsort(keys[places], kind="stable")
    places = places[order]
    group = np.concatenate([[0], np.cumsum(keys[places][1:] != keys[places][:-1])]) if len(places) else places
    padded = np.concatenate([text, np.zeros(depth + 1, dtype=text.dtype)])
    tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(places) else places
    for d in range(DEPTH, depth):
        word = padded[places[tied] + d]
        order = np.lexsort((word, group[tied]))
        places[tied], word = places[tied[order]], word[order]
        same = (group[tied][1:] == group[tied][:-1]) & (word[1:] == word[:-1]) & (word[1:] > 0)
        fresh = np.concatenate([[True], ~same])[: len(tied)]
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]  # a group is called by its first place in the array
        again = np.zeros(len(tied), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        tied = tied[again]
        if not len(tied):
            break
    return places


def matches(items: Items, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, item start, text place, length) of all maximal verbatim matches of DEPTH words or more, at every place they stand.

    Every item suffix is searched in the suffix array by binary search; the suffixes in its range begin
    with the same DEPTH words. A match that goes on to the left is the same as its left neighbour's and
    is left to that one; how far it goes to the right is read off word by word, for all at once.
    """
    wanted = np.unique(items.keys)
    places = suffix_array(text, wanted, max((len(w) for w in items.words), default=0))
    keys = key_of(text)[places] if len(places) else np.zeros(0, dtype=np.uint64)
    lo, hi = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    at = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    item, start = items.item[which], items.start[which]
    mine, here = items.begin[item] + start, at + 1
    padded = np.concatenate([np.zeros(1, dtype=text.dtype), text, np.zeros(1, dtype=text.dtype)])
    left = (items.flat[mine - 1] != padded[here - 1]) | (padded[here - 1] == 0)
    item, start, at, mine, here = item[left], start[left], at[left], mine[left], here[left]
    length = np.zeros(len(item), dtype=np.int64)
    going = np.arange(len(item))
    while len(going):
        w = items.flat[mine[going] + length[going]]
        going = going[(w > 0) & (w == padded[np.minimum(here[going] + length[going], len(padded) - 1)])]
        length[going] += 1
    long = length >= DEPTH
    return item[long], start[long], at[long], length[long]


def windows(one_in: int) -> tuple[tuple[int, int], ...]:
    """(words, edits) of the stretches that have to be looked for.

    A stretch of L >= 2 * one_in words with at most L / one_in edits holds one of 2 * one_in words with 2
    edits at most, or one of 3 * one_in with 3: below 3 * one_in words it has no third edit, below
    4 * one_in no fourth, and a longer one whose disjoint runs of 2 * one_in words all had 3 edits would
    have too many.
    """
    return (2 * one_in, 2), (3 * one_in, 3)


def promising(items: Items, text: np.ndarray, item: np.ndarray, start: np.ndarray, at: np.ndarray, one_in: int) -> np.ndarray:
    """Which matches lie in a window whose words mostly stand in the text near the match's diagonal (a necessary condition).

    Every window of ``windows`` has DEPTH words in a row unchanged, so it holds a match, and its other
    words lie at most ``edits`` diagonals away. All matches are judged at once.
    """
    reach = 3 * one_in
    gap = np.full(reach, -1, dtype=np.int32)
    flat = np.concatenate([x for w in items.words for x in (gap, w)] + [gap])
    begin = np.cumsum([0] + [len(w) + reach for w in items.words])[:-1] + reach
    padded = np.concatenate([np.zeros(reach + 3, dtype=text.dtype), text, np.zeros(reach + 3, dtype=text.dtype)])
    out = np.zeros(len(item), dtype=bool)
    around = np.arange(DEPTH - reach, reach)
    for a in range(0, len(item), 20_000):
        part = slice(a, a + 20_000)
        mine = flat[(begin[item[part]] + start[part])[:, None] + around]
        here = (at[part] + reach + 3)[:, None] + around
        same = np.stack([padded[here + shift] == mine for shift in range(-3, 4)])
        for length, edits in windows(one_in):
            band = np.stack([same[i : i + edits + 1].any(0) for i in range(7 - edits)])
            kept = np.cumsum(np.pad(band, ((0, 0), (0, 0), (1, 0))), axis=2, dtype=np.int32)
            out[part] |= (kept[..., length:] - kept[..., :-length] >= length - edits).any((0, 2))
    return out


def holds(item: np.ndarray, text: np.ndarray, one_in: int) -> bool:
    """Whether ``text`` holds a stretch of 2 * one_in or more words of ``item`` with at most one edit in ``one_in`` of them.

    Edit distances of the windows from every start in the item to every place in the text at once.
    """
    n, m = len(item), len(text)
    far = np.arange(m + 1, dtype=np.int32)
    for length, edits in windows(one_in):
        if n < length:
            continue
        d = np.zeros((n - length + 1, m + 1), dtype=np.int32)
        for t in range(length):
            new = d + 1  # word left out
            new[:, 1:] = np.minimum(new[:, 1:], d[:, :-1] + (item[t : t + n - length + 1, None] != text))
            d = np.minimum.accumulate(new - far, axis=1) + far  # words added
        if (d <= edits).any():
            return True
    return False


def _find(shared, one_in: int):
    least = 2 * one_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        number = Words(block.vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts, ends = [], []
            total = 0
            for t in texts:
                w = np.fromiter(map(number.__getitem__, plain(t)), dtype=np.int32)
                w = w[w >= 0]
                parts += [w, np.zeros(1, dtype=np.int32)]  # no match reaches across documents
                total += len(w) + 1
                ends.append(total)
            text = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
            ends = np.array(ends, dtype=np.int64)
            item, start, at, length = matches(block, text)
            good = (length >= least) | promising(block, text, item, start, at, one_in)
            item, start, at, length = item[good], start[good], at[good], length[good]
            doc = np.searchsorted(ends, at, "right")
            out = []
            order = np.lexsort((at, item, doc))
            cut = np.flatnonzero(np.diff(doc[order]) | np.diff(item[order])) + 1
            for run_ in np.split(order, cut) if len(order) else []:
                d, q = int(doc[run_[0]]), int(item[run_[0]])
                begin = int(ends[d - 1]) if d else 0
                words = block.words[q]
                leaked = length[run_].max() >= least
                if not leaked and len(words) >= least:
                    slack = len(words) // one_in + 1
                    spans: list[list[int]] = []
                    for h in run_:
                        a = max(begin, int(at[h] - start[h]) - slack)
                        b = min(int(ends[d]) - 1, int(at[h] + len(words) - start[h]) + slack)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    leaked = any(holds(words, text[a:b], one_in) for a, b in spans)
                if leaked:
                    out.append((ids[d], block.ids[q], [{"at_word": int(at[h]) - begin, "item_word": int(start[h]), "words": int(length[h])} for h in run_]))
            place = pa.struct([("at_word", pa.int64()), ("item_word", pa.int32()), ("words", pa.int32())])
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(place))], names=["doc_id", "item_id", "places"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, one_in: int = 6, block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id, longest, at_word, places): documents that hold a stretch of 2 * one_in or more words of an item, in order.

    At most one in ``one_in`` words of the stretch may be changed, left out or added; case, punctuation,
    blanks, line breaks and hyphens at line ends do not count. Every Arrow batch of documents is a shard
    with its own suffix array over word numbers, as deep as the longest item, in which all item suffixes
    are searched by binary search; a stretch of 12 words with 2 edits still has 4 in a row, so no stretch
    goes without a match, and an edit-distance pass decides where the matches alone are too short.
    ``places`` are all maximal verbatim matches of the pair (word of the document, word of the item,
    words), ``longest`` the words of the longest and ``at_word`` its place. Whole texts are read; there is no
    shuffle. Items are taken in blocks of about ``block_chars`` characters (which bounds what is sent to
    the tasks): a hundred thousand items of usual length take one scan of the documents, more take a
    scan a block. Null or empty texts and items shorter than a stretch match nothing; rows with a null id
    are left out; repeated rows come out once.
    """
    if one_in < 6:  # 2 * one_in words with 2 edits must have DEPTH in a row
        raise ValueError("at most one edit in 6 words can be searched for")
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    wanted = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    found = None
    schema = "doc_id bigint, item_id bigint, places array<struct<at_word: bigint, item_word: int, words: int>>"
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a bounded block
        part = docs.mapInArrow(_find(spark.sparkContext.broadcast(prepare(sorted((r["item_id"], r["text"]) for r in rows))), one_in), schema)
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("doc_id", "item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    best = F.array_max(F.transform("places", lambda p: F.struct(p["words"].alias("words"), (-p["at_word"]).alias("before"))))
    return whole.select("doc_id", "item_id", best["words"].alias("longest"), (-best["before"]).alias("at_word"), "places")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, whole, that hold no passage of any item. Rows with a null doc_id cannot be named by a leak and are left out."""
    return documents.filter("doc_id is not null").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
