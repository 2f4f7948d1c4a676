"""Documents into sequences of a fixed number of tokens, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import bisect
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.session import cut

#: A public byte-level vocabulary; every executor reads it from here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts text before merging bytes (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank before a space: there the tokenizer's pieces reach across spaces.
WIDE = re.compile(r"\s ")


class TokenCounter(dict):
    """Tokens of a text. Text between single spaces is counted once and remembered, up to ``most`` entries."""

    def __init__(self, path: str, most: int = 400_000):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def __missing__(self, word: str) -> int:
        n = len(self.encoding.encode_ordinary(" " + word))
        if len(self) < self.most:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if WIDE.search(text) or text[-1:] == " ":
            return len(self.encoding.encode_ordinary(text))
        words = text.split(" ")
        return len(self.encoding.encode_ordinary(words[0])) + sum(map(self.__getitem__, words[1:]))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null texts have none, null ids are left out, repeated ids come out once (the longer text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    docs = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


Bin = tuple[int, tuple[int, ...]]  # tokens, items


def best_fit(sizes: list[int], items: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Put the items, in the given order, each into the fullest bin that still takes it; open a new one if none does."""
    free = sorted((capacity - b[0], i) for i, b in enumerate(bins))
    held = [list(b[1]) for b in bins]
    for x in items:
        at = bisect.bisect_left(free, (sizes[x], -1))
        if at == len(free):
            room, i = capacity, len(held)
            held.append([])
        else:
            room, i = free.pop(at)
        held[i].append(x)
        bisect.insort(free, (room - sizes[x], i))
    room = {i: r for r, i in free}
    return [(capacity - room[i], tuple(h)) for i, h in enumerate(held)]


def fitness(bins: list[Bin], capacity: int) -> float:
    """Mean squared fill: fewer bins first, and of as many the more uneven ones, whose gaps are easier to use."""
    return sum((b[0] / capacity) ** 2 for b in bins) / max(1, len(bins))


def improve(sizes: list[int], bins: list[Bin], loose: list[int], capacity: int) -> tuple[list[Bin], list[int]]:
    """Swap one or two items of a bin for one or two loose ones that fill it better (Falkenauer's replacement), each bin once."""
    free = sorted(loose, key=lambda x: sizes[x])
    out = []
    for load, held in bins:
        room, best = capacity - load, None
        if room and free:
            tokens = [sizes[x] for x in free]
            gone = [(x,) for x in held] + [(held[i], held[j]) for i in range(len(held)) for j in range(i)][:64]
            for away in gone:
                was = sum(sizes[x] for x in away)
                k = bisect.bisect_right(tokens, was + room) - 1
                if k >= 0 and tokens[k] > was and (best is None or tokens[k] - was > best[0]):
                    best = (tokens[k] - was, away, (k,))
                for i in range(len(tokens) if len(away) == 2 else 0):
                    k = bisect.bisect_right(tokens, was + room - tokens[i], 0, i) - 1
                    if k >= 0 and tokens[i] + tokens[k] > was and (best is None or tokens[i] + tokens[k] - was > best[0]):
                        best = (tokens[i] + tokens[k] - was, away, (k, i))
                if best and best[0] == room:
                    break
        if best:
            more, away, taken = best
            held = tuple(x for x in held if x not in away) + tuple(free[k] for k in taken)
            free = sorted([x for k, x in enumerate(free) if k not in taken] + list(away), key=lambda x: sizes[x])
            load += more
        out.append((load, held))
    return out, free


def cross(a: list[Bin], b: list[Bin], sizes: list[int], capacity: int, share: float, rng: random.Random) -> list[Bin]:
    """Inject some of b's fullest bins whole into a, drop a's bins that share items with them, and best-fit what that displaces, after swaps that fill bins better."""
    ranked = sorted(b, key=lambda x: -x[0])
    top = ranked[: max(1, int(len(ranked) * share * 2))]
    taken = rng.sample(top, max(1, len(top) // 2))
    inside = set().union(*(t[1] for t in taken))
    kept, displaced = list(taken), []
    for one in a:
        if inside.isdisjoint(one[1]):
            kept.append(one)
        else:
            displaced += [x for x in one[1] if x not in inside]
    # the emptiest bins are opened again as well, and a few others (the mutation)
    kept.sort(key=lambda x: -x[0])
    loose = min(len(kept), max(1, len(kept) // 20))
    for one in kept[-loose:]:
        displaced += one[1]
    kept = kept[:-loose]
    for _ in range(min(2, len(kept))):
        displaced += kept.pop(rng.randrange(len(kept)))[1]
    kept, displaced = improve(sizes, kept, displaced, capacity)
    return best_fit(sizes, sorted(displaced, key=lambda x: (-sizes[x], x)), kept, capacity)


def evolve(sizes: list[int], capacity: int, elites: list[list[Bin]], population: int, generations: int, seed: int, patience: int = 40, full: float = 0.999) -> list[Bin]:
    """One island's epoch: its best solution after some generations, starting from the elites that came in.

    Bins that the best start fills to ``full`` or more are kept whole, but for one in twenty that is
    opened by chance; the population packs the other items. It ends when no packing can have fewer bins
    or after ``patience`` generations without a better best.
    """
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda x: (-sizes[x], x))
    starts = sorted((list(e) for e in elites), key=lambda e: -fitness(e, capacity)) or [best_fit(sizes, order, [], capacity)]
    kept = [one for one in starts[0] if one[0] >= full * capacity and rng.random() >= 0.05]
    set_aside = {x for one in kept for x in one[1]}
    rest = [x for x in order if x not in set_aside]
    people = []
    for start in starts:
        own = [one for one in start if set_aside.isdisjoint(one[1])]
        inside = {x for one in own for x in one[1]}
        people.append(best_fit(sizes, [x for x in rest if x not in inside], own, capacity))
    while len(people) < population:
        people.append(best_fit(sizes, sorted(rest, key=lambda x: -sizes[x] * rng.uniform(0.6, 1.0)), [], capacity))
    ranked = sorted(((fitness(p, capacity), p) for p in people), key=lambda x: -x[0])
    fewest, idle = -(-sum(sizes[x] for x in rest) // capacity), 0
    for _ in range(generations if rest else 0):
        if len(ranked[0][1]) <= fewest or idle >= patience:
            break
        i, j = rng.sample(range(len(ranked)), 2)
        child = cross(ranked[i][1], ranked[j][1], sizes, capacity, 0.3, rng)
        fit = fitness(child, capacity)
        idle = 0 if fit > ranked[0][0] else idle + 1
        if fit > ranked[-1][0] and all(fit != f for f, _ in ranked):
            ranked[-1] = (fit, child)
            ranked.sort(key=lambda x: -x[0])
    return kept + ranked[0][1]


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        base = pdf[pdf["origin"] == pdf["origin"].min()].sort_values("item")
        sizes, ids = base["size"].tolist(), base["item"].tolist()
        number = {x: i for i, x in enumerate(ids)}
        elites = []
        for origin, own in pdf[pdf["bin"] >= 0].groupby("origin"):
            held: dict[int, list[int]] = {}
            for x, b in zip(own["item"], own["bin"]):
                held.setdefault(b, []).append(number[x])
            elites.append([(sum(sizes[i] for i in h), tuple(h)) for h in held.values()])
        best = evolve(sizes, capacity, elites, population, generations, shard * 7919 + island * 104729 + epoch)
        score = fitness(best, capacity)
        rows = [(shard, island, ids[i], sizes[i], n, score) for n, b in enumerate(best) for i in b[1]]
        return pd.DataFrame(rows, columns=["shard", "island", "item", "size", "bin", "score"])

    return run


def pack_items(items: DataFrame, capacity: int, shard: int = 4000, islands: int = 3, epochs: int = 2, population: int = 12, generations: int = 400) -> DataFrame:
    """(item, size, shard, bin): items of at most ``capacity`` in bins.

    Items are dealt to shards of about ``shard`` by hash. Every shard is worked on by ``islands``
    populations; after each epoch the best solution of every island moves on to the next one, and at the
    end the best of them is kept. No task holds more than a shard's items.
    """
    out = "shard int, island int, item bigint, size bigint, bin int, score double"
    shards = max(1, -(-items.count() // shard))
    dealt = cut(items.select(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", "size"))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("origin", F.lit(-1)).withColumn("bin", F.lit(-1))
    tasks = min(shards * islands, 20_000)  # a group is little data and much work: they are not drawn together
    for e in range(epochs):
        best = cut(state.select("shard", "island", "item", "size", "origin", "bin").repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(_epoch(capacity, population, generations, e), out))
        stay = best.select("shard", "island", "item", "size", F.col("island").alias("origin"), "bin")
        state = stay.unionByName(stay.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))) if islands > 1 else stay
    won = best.groupBy("shard").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("island"))
    return best.join(won, ["shard", "island"]).select("item", "size", "shard", "bin")


def pack_documents(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, well_filled: float = 0.985, **how: int) -> DataFrame:
    """(doc_id, piece, start, n_tokens, sequence, offset): every document's tokens in sequences of ``capacity`` tokens.

    A document longer than ``capacity`` is cut into full sequences and a rest, which is packed like any
    other document; nothing else is ever cut. ``start`` is a piece's first token in the document and
    ``offset`` its place in the sequence. Bins that come out less than ``well_filled`` are emptied and
    packed once more with those of the other shards. Documents without tokens are in no sequence; an
    empty table gives no rows. Ties, repeated texts and extra columns change nothing.
    """
    counted = cut(token_counts(documents, tokenizer).filter("n_tokens > 0"))
    pieces = counted.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start")).cast("long").alias("n_tokens"))
    full = pieces.filter(F.col("n_tokens") == capacity).select("doc_id", "piece", "start", "n_tokens", F.concat_ws("-", F.lit("d"), "doc_id", "piece").alias("sequence"))
    rest = pieces.filter(F.col("n_tokens") < capacity)  # at most one a document, so doc_id names it
    first = pack_items(rest.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")), capacity, **how)
    fill = first.groupBy("shard", "bin").agg((F.sum("size") / capacity).alias("fill"))
    first = cut(first.join(fill, ["shard", "bin"]).withColumn("sequence", F.concat_ws("-", F.lit("a"), "shard", "bin")))
    again = pack_items(first.filter(F.col("fill") < well_filled).select("item", "size"), capacity, **how).withColumn("sequence", F.concat_ws("-", F.lit("b"), "shard", "bin"))
    placed = first.filter(F.col("fill") >= well_filled).select("item", "sequence").unionByName(again.select("item", "sequence"))
    all_pieces = full.unionByName(rest.join(placed, rest["doc_id"] == placed["item"]).drop("item").select("doc_id", "piece", "start", "n_tokens", "sequence"))
    before = W.partitionBy("sequence").orderBy("doc_id", "piece").rowsBetween(W.unboundedPreceding, -1)
    return all_pieces.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """capacity, n_sequences, n_tokens, fill: what share of the sequences' room is used."""
    return packed.agg(F.lit(capacity).alias("capacity"), F.countDistinct("sequence").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / (F.countDistinct("sequence") * capacity), 6).alias("fill"))
