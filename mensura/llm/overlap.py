"""Records of evaluation splits that are in train too, exactly or almost, by Aho-Corasick scans."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions.batches import packed, pair_similarities, unpack
from mensura.functions.fingerprint import N_BITS, SHIFT, code, code_text, positions
from mensura.functions.keys import molecule_key, present, with_molecule
from mensura.session import cut

#: Marks before and after a text, so that a whole text is a passage too. Below every position's character.
BEGIN, END = "\u0002", "\u0003"


def pieces(text: str, near: float) -> list[tuple[int, int]]:
    """Intervals of a text's passages.

    Two sets of similarity ``near`` or more differ in at most n * (1 - near) / near positions, n being
    the size of either. Cutting one sorted set into one piece more than that leaves at least one piece
    untouched, so it stands verbatim in the other: scanning for the pieces misses no such pair. A set
    for which that number is 0, and a key, is a single passage with both marks.
    """
    n = len(text) - 2
    d = int(n * (1 - near) / near + 1e-9) if n and ord(text[1]) >= SHIFT else 0
    if d == 0:
        return [(0, len(text))]
    cuts = [1 + n * i // (d + 1) for i in range(d + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def is_set(text: str) -> bool:
    return len(text) > 2 and ord(text[1]) >= SHIFT


def routed_pieces(text: str, near: float, rarity: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, pair) of a set's passages: the passage's rarest pair of neighbouring positions by the positions' counts, by which it is sharded."""
    pos = np.array([ord(c) - SHIFT for c in text[1:-1]])
    out = []
    for a, b in pieces(text, near):
        own = pos[a - 1 : b - 1]
        if len(own) == 1:
            out.append((a, b, int(own[0]) * N_BITS + int(own[0])))
        else:
            i = int((rarity[own[:-1]] * rarity[own[1:]]).argmin())
            out.append((a, b, int(own[i]) * N_BITS + int(own[i + 1])))
    return out


def _whole(text: str, near: float) -> bool:
    """Whether a text is a single passage: a key, or a set in which no position may differ."""
    return not is_set(text) or len(pieces(text, near)) == 1 and pieces(text, near)[0] == (0, len(text))


def _chosen(near: float, rarity: np.ndarray):
    """The pair of every passage of the held-out sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [pair for text in pdf["text"] if not _whole(text, near) for _, _, pair in routed_pieces(text, near, rarity)]
            yield pd.DataFrame({"pair": np.array(pairs, dtype=np.int64)})

    return run


def hash_text(text: str) -> int:
    h = 0
    for ch in text:
        h = (h * 1000003 + ord(ch)) & 0xFFFFFFFF
    return h


def own_units(hot: dict[int, int], shards: int) -> dict[int, int]:
    """First unit of every pair that has units of its own (as many as ``hot`` says), behind the shared ones."""
    out, at = {}, shards
    for pair in sorted(hot):
        out[pair], at = at, at + hot[pair]
    return out


def unit_of(pair: int, piece: str, hot: dict[int, int], own_unit: dict[int, int], shards: int) -> int:
    return own_unit[pair] + hash_text(piece) % hot[pair] if pair in hot else pair * 2654435761 % 4294967291 % shards


def _route(shared, near: float):
    """Rows (unit, role, text, splits): where each text's passages lie (role 0) and where a train text is scanned (role 1).

    A text that is one passage as a whole can only meet itself and goes to one unit, by its hash. A
    set's passage goes to the unit of its rarest pair, a train set to those of its own pairs that some
    passage was sharded by. A pair with too many passages has units of its own, over which they are
    dealt by hash; a train set that has the pair visits all of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity, chosen, hot, shards, wholes = shared.value
        own_unit = own_units(hot, shards)
        unit = lambda pair, piece: unit_of(pair, piece, hot, own_unit, shards)
        for pdf in batches:
            out = []
            for text, train, held in zip(pdf["text"], pdf["train"], pdf["held"]):
                if _whole(text, near):
                    at = -1 - hash_text(text) % wholes
                    if len(held) and len(train):  # else nothing in its unit can be equal to it
                        out += [(at, 0, text, held), (at, 1, text, train)]
                    continue
                if len(held):
                    out += [(u, 0, text, held) for u in {unit(pair, text[a:b]) for a, b, pair in routed_pieces(text, near, rarity)}]
                if is_set(text) and len(train):
                    pos = np.array([ord(c) - SHIFT for c in text[1:-1]])
                    pairs = np.concatenate([pos[:-1] * N_BITS + pos[1:], pos * (N_BITS + 1)])
                    units = set()
                    for pair in pairs[(chosen[pairs >> 3] >> (pairs & 7).astype(np.uint8)) & 1 == 1].tolist():
                        units.update(range(own_unit[pair], own_unit[pair] + hot[pair]) if pair in hot else [unit(pair, "")])
                    out += [(u, 1, text, train) for u in units]
            yield pd.DataFrame(out, columns=["unit", "role", "text", "splits"])

    return run


def _bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return packed(*unpack([t[1:-1].encode("utf-16-be") if is_set(t) else b"" for t in texts]))


class Shard:
    """The passages of one unit in an automaton; holders of one passage are verified a batch at a time."""

    def __init__(self, texts: list[str], splits: list[list[str]], passages: list[tuple[int, int, int]], near: float):
        """``passages`` are (number of the text, start, end)."""
        self.texts, self.near = texts, near
        self.names = sorted({s for own in splits for s in own})
        self.bits, self.n = _bits(texts)
        self.piece: dict[str, int] = {}
        piece = np.array([self.piece.setdefault(texts[t][a:b], len(self.piece)) for t, a, b in passages], dtype=np.int64)
        order = np.argsort(piece, kind="stable")
        entry = np.array(passages, dtype=np.int64).reshape(-1, 3)[order]
        self.holder, self.start, self.end = entry.T
        self.at = np.searchsorted(piece[order], np.arange(len(self.piece) + 1))
        wanted = np.array([[s in own for s in self.names] for own in splits], dtype=bool).reshape(len(texts), len(self.names))
        self.open = wanted[self.holder]  # which splits a passage still waits for
        self.automaton = ahocorasick.Automaton()
        for p, i in self.piece.items():
            self.automaton.add_word(p, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, texts: list[str], splits: list[list[str]]) -> Iterator[pd.DataFrame]:
        if not len(self.automaton):
            return
        hit_text, hit_piece, load = [], [], 0
        for i, text in enumerate(texts):
            for _, piece in self.automaton.iter(text):
                hit_text.append(i)
                hit_piece.append(piece)
                load += int(self.at[piece + 1] - self.at[piece])
            if load > 500_000:
                yield self._verify(texts, splits, np.array(hit_text), np.array(hit_piece))
                hit_text, hit_piece, load = [], [], 0
        if hit_text:
            yield self._verify(texts, splits, np.array(hit_text), np.array(hit_piece))

    def _verify(self, texts: list[str], splits: list[list[str]], hit_text: np.ndarray, hit_piece: np.ndarray) -> pd.DataFrame:
        used, text = np.unique(hit_text, return_inverse=True)
        own = [texts[i] for i in used]
        here = np.array([[s in splits[i] for s in self.names] for i in used], dtype=bool).reshape(len(used), len(self.names))
        bits, n = _bits(own)
        parts = []
        size = self.at[hit_piece + 1] - self.at[hit_piece]
        groups = np.cumsum(size) // 1_000_000
        for g in np.unique(groups):
            mine = groups == g
            s = size[mine]
            row = np.repeat(text[mine], s)
            entry = np.repeat(self.at[hit_piece[mine]] - np.cumsum(s) + s, s) + np.arange(s.sum())
            small, large = np.minimum(n[row], self.n[self.holder[entry]]), np.maximum(n[row], self.n[self.holder[entry]])
            alive = (small >= self.near * large - 1e-9) & (self.open[entry] & here[row]).any(1)
            row, entry = row[alive], entry[alive]
            holder = self.holder[entry]
            same, back = np.unique(row * len(self.texts) + holder, return_inverse=True)
            r, h = same // len(self.texts), same % len(self.texts)
            sets = (n[r] > 0) & (self.n[h] > 0)
            similarity = np.ones(len(same))  # whole texts: a hit is equality
            similarity[sets] = pair_similarities(bits, n, self.bits, self.n, r[sets], h[sets])
            similarity = similarity[back]
            for j, name in enumerate(self.names):
                met = np.flatnonzero((similarity >= self.near) & self.open[entry, j] & here[row, j])
                met = met[np.argsort(-similarity[met], kind="stable")]
                e, first = np.unique(entry[met], return_index=True)
                self.open[e, j] = False  # this passage is settled for this split
                parts += zip([self.texts[k] for k in self.holder[e]], [name] * len(e), similarity[met][first].tolist(), self.start[e].tolist(), self.end[e].tolist())
        return pd.DataFrame(parts, columns=["text", "split_name", "similarity", "a", "b"])


def _scan(shared, near: float):
    """Build a unit's automaton from its passages (which come first) and run its train texts through it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity, _, hot, shards, _ = shared.value
        own_unit = own_units(hot, shards)
        at, texts, splits, shard = None, [], [], None

        def build(unit: int) -> Shard:
            passages = []
            for i, text in enumerate(texts):
                if unit < 0:
                    passages.append((i, 0, len(text)))
                else:
                    passages += [(i, a, b) for a, b, pair in routed_pieces(text, near, rarity) if unit_of(pair, text[a:b], hot, own_unit, shards) == unit]
            return Shard(texts, splits, passages, near)

        for pdf in batches:
            key = pdf[["unit", "salt"]].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(pdf)]
            for a, b in zip(starts[:-1], starts[1:]):
                if (unit := tuple(key[a])) != at:
                    at, texts, splits, shard = unit, [], [], None
                own = pdf.iloc[a:b]
                passages, scanned = own[own["role"] == 0], own[own["role"] == 1]
                texts += passages["text"].tolist()
                splits += [list(x) for x in passages["splits"]]
                if len(scanned):
                    shard = shard or build(int(unit[0]))
                    yield from shard.scan(scanned["text"].tolist(), [list(x) for x in scanned["splits"]])

    return run


def covered(texts: DataFrame, near: float = 0.9, passages_per_shard: int = 100_000, texts_per_task: int = 50_000) -> DataFrame:
    """(text, split_name, similarity, coverage): held-out texts that train texts of the same split repeat.

    ``texts`` has text, train and held (arrays of split names), one row per distinct text. The automata
    are sharded: a whole text by its hash, a passage of a set by the rarest pair of neighbouring
    positions in it, and a pair with more than ``passages_per_shard`` passages is split over several
    units. A train set is sent to the units of those of its pairs that passages are sharded by. A unit
    with more than ``texts_per_task`` train texts is worked on in several copies. So no automaton and no
    task grows with the data, whatever the passages have in common. Sent to the tasks are the counts of
    the N_BITS positions, one bit for each of N_BITS * N_BITS pairs (512 KB), and the split pairs, of which
    there is at most one per ``passages_per_shard`` passages.
    ``coverage`` is the merged length of the intervals found in the train texts over the text's length.
    """
    spark = texts.sparkSession
    marked = texts.withColumn("set", (F.length("text") > 2) & (F.ascii(F.substring("text", 2, 1)) >= SHIFT))
    counts = marked.filter("set").select(F.explode(F.split(F.expr("substring(text, 2, length(text) - 2)"), "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()  # N_BITS rows
    rarity = np.zeros(N_BITS)
    for r in counts:
        rarity[ord(r["c"]) - SHIFT] = r["n"]
    pairs = cut(marked.filter(F.col("set") & (F.size("held") > 0)).select("text").mapInPandas(_chosen(near, rarity), "pair bigint").groupBy("pair").agg(F.count("*").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = {r["pair"]: -(-r["n"] // passages_per_shard) for r in pairs.filter(F.col("n") > passages_per_shard).collect()}
    chosen = np.zeros(N_BITS * N_BITS // 8, dtype=np.uint8)
    marks = pairs.groupBy(F.expr("bitmap_bucket_number(pair + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(pair + 1))").alias("m")).collect()  # one row a 32,768 pairs
    for r in marks:
        for i, byte in enumerate(bytes(r["m"])):
            if byte:
                chosen[(int(r["b"]) - 1) * 4096 + i] |= byte
    shards = max(1, -(-int(total) // passages_per_shard))
    wholes = max(1, -(-texts.filter(F.size("held") > 0).count() // passages_per_shard))
    shared = spark.sparkContext.broadcast((rarity, chosen, hot, shards, wholes))
    routed = cut(texts.mapInPandas(_route(shared, near), "unit int, role int, text string, splits array<string>"))
    busy = routed.groupBy("unit").agg(F.ceil(F.count_if(F.col("role") == 1) / texts_per_task).cast("int").alias("salts"), F.count_if(F.col("role") == 0).alias("n")).filter("salts > 0 and n > 0")
    placed = routed.join(F.broadcast(cut(busy)), "unit")  # one row a unit
    salt = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("text"), F.col("salts")).cast("int")))
    units = placed.select("unit", F.explode(salt).alias("salt"), "role", "text", "splits").repartition("unit", "salt").sortWithinPartitions("unit", "salt", "role")
    found = units.mapInPandas(_scan(shared, near), "text string, split_name string, similarity double, a int, b int")
    spans = F.array_sort(F.collect_set(F.struct("a", "b")))  # at most one a passage
    merged = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
    )["n"]
    whole = F.col("spans")[0]["b"] - F.col("spans")[0]["a"] == F.length("text")
    return (
        found.groupBy("text", "split_name").agg(F.max("similarity").alias("similarity"), spans.alias("spans"))
        .select("text", "split_name", "similarity", F.when(whole, 1.0).otherwise(merged / (F.length("text") - 2)).alias("coverage"))
    )


def overlapping_records(members: DataFrame, records: DataFrame, vectors: DataFrame, near: float = 0.9) -> DataFrame:
    """(split_name, rec_id, source, exact, near, coverage): valid and test records that train holds too.

    ``exact``: a train record of the same split has the same molecule (a record on both sides meets
    itself). ``near``: one of the molecule's vectors has similarity ``near`` or more to one of a train
    molecule's; of the same molecule that holds as well if it has a vector. Sides are read without case
    and blanks, 'validation' is valid; unknown sides, null splits and null records are left out.
    Repeated rows count once. A record whose molecule is unknown is its own molecule. Empty vectors
    match nothing. Empty tables give no rows. All copies of a molecule or of a bit set are one text.
    """
    side = F.lower(present("side"))
    m = members.select(F.lower(present("split_name")).alias("split_name"), "rec_id", F.when(side == "validation", "valid").otherwise(side).alias("side"))
    m = m.filter("split_name is not null and rec_id is not null and side in ('train', 'valid', 'test')").distinct()
    known = with_molecule(records.select("rec_id", "inchikey", "std_smiles", "source").dropDuplicates(["rec_id"])).select("rec_id", "molecule", F.coalesce(F.lower(present("source")), F.lit("unknown")).alias("source"))
    placed = cut(m.join(known, "rec_id", "left").select("split_name", "rec_id", "side", F.coalesce("molecule", F.concat(F.lit("#"), F.col("rec_id").cast("string"))).alias("molecule"), F.coalesce("source", F.lit("unknown")).alias("source")))
    where = placed.groupBy("molecule").agg(F.collect_set(F.when(F.col("side") == "train", F.col("split_name"))).alias("train"), F.collect_set(F.when(F.col("side") != "train", F.col("split_name"))).alias("held"))
    own = vectors.select(molecule_key("inchikey").alias("molecule"), positions().alias("p")).filter("molecule is not null and size(p) > 0")
    sets = cut(own.select("molecule", code_text(code("p")).alias("set")).distinct().join(where, "molecule"))
    framed = lambda c: F.concat(F.lit(BEGIN), c, F.lit(END))
    keys = where.select(framed(F.col("molecule")).alias("text"), "train", "held")
    bits = sets.groupBy("set").agg(F.array_distinct(F.flatten(F.collect_set("train"))).alias("train"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held")).select(framed(F.col("set")).alias("text"), "train", "held")
    hits = cut(covered(cut(keys.unionByName(bits)), near))
    of_set = sets.select("molecule", framed(F.col("set")).alias("text"))
    by_key = where.select("molecule", framed(F.col("molecule")).alias("text")).join(hits, "text").select("molecule", "split_name", F.lit(1).alias("exact"), F.lit(0).alias("near"), "coverage")
    by_set = of_set.join(hits, "text").select("molecule", "split_name", F.lit(0).alias("exact"), F.lit(1).alias("near"), "coverage")
    judged = by_key.unionByName(by_set).groupBy("molecule", "split_name").agg(F.max("exact").alias("exact"), F.max("near").alias("near"), F.max("coverage").alias("coverage"))
    held = placed.filter("side <> 'train'").select("split_name", "rec_id", "molecule", "source").distinct()
    return held.join(judged, ["molecule", "split_name"]).select("split_name", "rec_id", "source", "exact", "near", "coverage")


def overlap_report(found: DataFrame, members: DataFrame) -> DataFrame:
    """Per split and source: records that overlap, exact and near counts, mean coverage."""
    return found.groupBy("split_name", "source").agg(
        F.count("*").alias("n_overlapping"), F.sum("exact").cast("long").alias("exact_dupe_keys"), F.sum("near").cast("long").alias("near_dupes"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
