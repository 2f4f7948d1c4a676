"""Delimited files whose columns drift: profile, match by similarity flooding, report, cast and union."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions.keys import BLANK, MISSING, trimmed
from mensura.operators.components import connected_components
from mensura.session import cut
from mensura.sources.delimited import HEADERS

DELIMITERS = (";", "\t", ",", "|")
#: Smallest hashes kept for a column's values, one a bin: a fixed-size sketch however long the file.
BINS = 64
#: Most keys kept of the objects in a column.
MEMBERS = 64


def _cells(line: Column, delimiter: Column) -> Column:
    """The raw cells of a line: quoted cells may hold the delimiter and doubled quotes."""
    out = None
    for d in DELIMITERS:
        e = {"\t": "\\t", "|": "\\|"}.get(d, d)
        found = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f'{e}(\\s*"(?:[^"]|"")*"\\s*(?={e}|$)|[^{e}]*)'), 1)
        out = F.when(delimiter == d, found) if out is None else out.when(delimiter == d, found)
    return out.otherwise(F.array(line))


def _unquoted(c: Column) -> Column:
    t = trimmed(c)
    inner = F.replace(F.regexp_extract(t, '^"((?:[^"]|"")*)"$', 1), F.lit('""'), F.lit('"'))
    return trimmed(F.when(t.rlike('^"(?:[^"]|"")*"$'), inner).otherwise(t))


def form(v: Column) -> Column:
    """The form of a filled cell; null for placeholders of an empty one."""
    return (
        F.when(v.isNull() | F.upper(v).isin(*MISSING), F.lit(None).cast("string"))
        .when(v.rlike("^[+-]?\\d+$"), "whole")
        .when(v.rlike("^[+-]?(\\d+\\.\\d*|\\.\\d+)$"), "point")
        .when(v.rlike("^[+-]?\\d*,\\d+$"), "comma")
        .when(v.rlike("^[+-]?(\\d+([.,]\\d*)?|[.,]\\d+)[eE][+-]?\\d+$"), "exponent")
        .when(v.rlike("^(\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}|\\d{1,2}[-/.]\\d{1,2}[-/.]\\d{4})([T ]\\d{1,2}:\\d{2}.*)?$"), "date")
        .when(v.rlike("^\\{.*\\}$"), "json")
        .otherwise("text")
    )


def _token(v: Column, f: Column) -> Column:
    """What stays of a value when its form changes: bare digits of a number or numbered label, year of a date, first text in an object."""
    mantissa = F.regexp_replace(F.regexp_replace(v, "[eE][+-]?\\d+$", ""), "\\D", "")
    digits = F.regexp_replace(mantissa, "^0+(?=.)|(?<=.)0+$", "")
    single = v.rlike("^\\D{0,12}\\d+\\D{0,4}$")
    return F.lower(
        F.when(f == "json", F.regexp_extract(v, ':\\s*"([^"]*)"', 1))
        .when(f == "date", F.regexp_replace(F.regexp_extract(v, "(\\d{4})", 1), "^0+(?=.)|(?<=.)0+$", ""))
        .when(f.isin("whole", "point", "comma", "exponent") | single, digits)
        .otherwise(v)
    )


def read_lines(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, cells) of all files.

    columns: series_id, file_id, exported_at, pos, header (unquoted, trimmed), name (lower case).
    cells: file_id, line_no, pos, value, form; null values are left out.
    A line delivered twice counts once; a file without a header line has no columns; cells beyond the
    header's width are dropped; blank headers get no column.
    """
    body = lines.filter("line_text is not null").groupBy("file_id", "line_no").agg(F.min("line_text").alias("line_text"))
    text = F.regexp_replace("line_text", "^\\ufeff|[\\r\\n]+$", "")
    head = body.filter("line_no = 1").withColumn("t", text)
    bare = F.regexp_replace("t", '"(?:[^"]|"")*"', "")
    counts = [F.struct(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    delimiter = F.array_max(F.array(*counts))["d"]
    head = head.select("file_id", "t", delimiter.alias("delimiter"))
    info = files.groupBy("file_id").agg(F.min("series_id").alias("series_id"), F.min("exported_at").alias("exported_at"))
    columns = (
        head.select("file_id", F.posexplode(F.transform(_cells(F.col("t"), F.col("delimiter")), _unquoted)).alias("pos", "header"))
        .filter("header <> ''").withColumn("name", F.lower("header")).join(info, "file_id")
    )
    cells = (
        body.filter("line_no > 1").join(head.select("file_id", "delimiter"), "file_id")
        .select("file_id", "line_no", F.posexplode(F.transform(_cells(text, F.col("delimiter")), _unquoted)).alias("pos", "value"))
        .withColumn("form", form(F.col("value")))
    )
    return columns, cells


def profile(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per file: its columns with name, place, main form, the keys of objects in them and a fixed-size sketch of the values."""
    filled = cells.filter("form is not null").withColumn("h", F.xxhash64(_token(F.col("value"), F.col("form"))))
    forms = filled.groupBy("file_id", "pos", "form").agg(F.count("*").alias("n"), F.avg(F.length("value")).alias("len"))
    forms = forms.groupBy("file_id", "pos").agg(F.max_by("form", F.struct("n", "form")).alias("form"), F.sum("n").alias("n"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("len"))
    sketch = filled.groupBy("file_id", "pos", F.pmod("h", F.lit(BINS)).alias("b")).agg(F.min("h").alias("h"))
    sketch = sketch.groupBy("file_id", "pos").agg(F.collect_list("h").alias("sketch"))
    members = filled.filter("form = 'json'").select("file_id", "pos", F.explode(F.json_object_keys("value")).alias("k"))
    members = members.groupBy("file_id", "pos").agg(F.slice(F.sort_array(F.collect_set(F.lower("k"))), 1, MEMBERS).alias("members"))
    return (
        columns.join(forms, ["file_id", "pos"], "left").join(sketch, ["file_id", "pos"], "left").join(members, ["file_id", "pos"], "left")
        .groupBy("series_id", "file_id", "exported_at")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "header", "name", "form", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("len", F.lit(0.0)).alias("len"), F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch"), F.coalesce("members", F.array().cast("array<string>")).alias("members")))).alias("cols"))
    )


def _words(name: str) -> set[str]:
    return {w for w in "".join(x if x.isalnum() else " " for x in name.lower()).split() if w}


@lru_cache(maxsize=65_536)
def _name_similarity(a: str, b: str) -> float:
    """Mean of shared words and shared letter triples (Jaccard)."""
    wa, wb = _words(a), _words(b)
    ta, tb = ({f"  {' '.join(sorted(w))} "[i : i + 3] for i in range(len(" ".join(sorted(w))) + 1)} for w in (wa, wb))
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    return (jac(wa, wb) + jac(ta, tb)) / 2


#: Forms that numbers take.
NUMBERS = frozenset(("whole", "point", "comma", "exponent"))


@dataclass(frozen=True)
class Weights:
    """What an edge of each kind passes on."""

    name: float = 1.0
    type: float = 0.1
    order: float = 0.05
    member: float = 0.3
    value: float = 0.6


def _edges(items: list[list], nodes: list) -> np.ndarray:
    at = {x: k for k, x in enumerate(nodes)}
    out = np.zeros((len(items), len(nodes)))
    for i, own in enumerate(items):
        for x in own:
            if x in at:
                out[i, at[x]] = 1
    return out


def flood(a: list, b: list, weights: Weights | None = None, rounds: int = 100, eps: float = 1e-4) -> np.ndarray:
    """Similarity flooding over two files' schema graphs; scores of (column of a, column of b), 1 for the best pair.

    A schema graph has a node for each column and edges from it to its name, its type (main form), its
    members (the keys of the objects in it; a plain column's only member bears its name), the columns
    beside it and a fixed-size sample of its values. The pairwise connectivity graph pairs nodes of the
    two graphs that edges of one kind lead to: pairs of columns, names, types, members and equal values.
    Only the outer nodes begin with a similarity of their own - names and members by their text, types by
    kinship, equal values 1 -, pairs of columns begin with none and get theirs from what surrounds them.
    In every round each pair adds to its score what its neighbours pass on (shared out among the pairs an
    edge kind leads to) and its own beginning, and all are divided by the largest, until nothing
    moves by more than ``eps``.
    """
    w = weights or Weights()
    n, m = len(a), len(b)
    alike = lambda x, y: 1.0 if x == y else _name_similarity(x, y)
    name0 = np.array([[alike(x["name"], y["name"]) for y in b] for x in a]).reshape(n, m)
    types_a, types_b = (sorted({x["form"] for x in side if x["form"]}) for side in (a, b))
    kinship = lambda x, y: 1.0 if x == y else 0.5 if x in NUMBERS and y in NUMBERS else 0.1
    type0 = np.array([[kinship(x, y) for y in types_b] for x in types_a]).reshape(len(types_a), len(types_b))
    type_a, type_b = _edges([[x["form"]] for x in a], types_a), _edges([[y["form"]] for y in b], types_b)
    own_a, own_b = ([list(x.get("members", ())) or [x["name"]] for x in side] for side in (a, b))
    members_a, members_b = (sorted({k for own in side for k in own}) for side in (own_a, own_b))
    member0 = np.array([[alike(x, y) for y in members_b] for x in members_a]).reshape(len(members_a), len(members_b))
    member_a, member_b = _edges(own_a, members_a), _edges(own_b, members_b)
    shared = sorted({h for x in a for h in x["sketch"]} & {h for y in b for h in y["sketch"]})
    value_a, value_b = _edges([x["sketch"] for x in a], shared), _edges([y["sketch"] for y in b], shared)
    # shares: a pair's neighbours of one kind get or give equal parts
    per_type = np.maximum(type_a.sum(0)[:, None] * type_b.sum(0)[None], 1)
    per_member = np.maximum(member_a.sum(0)[:, None] * member_b.sum(0)[None], 1)
    of_member = np.maximum(member_a.sum(1)[:, None] * member_b.sum(1)[None], 1)
    per_value = np.maximum(value_a.sum(0) * value_b.sum(0), 1)
    sizes = lambda side: np.array([len(x["sketch"]) for x in side], dtype=float)
    of_value = np.maximum((sizes(a)[:, None] + sizes(b)[None]) / 2, 1)
    column, name, kind, member, value = np.zeros((n, m)), name0, type0, member0, np.ones(len(shared))
    for _ in range(rounds):
        names, kinds, parts, values = name + name0, kind + type0, member + member0, value + 1
        pad = np.pad(column, 1)
        new = (
            column + w.name * names + w.type * (type_a @ kinds @ type_b.T) + w.order * (pad[:-2, :-2] + pad[2:, 2:])
            + w.member * (member_a @ parts @ member_b.T) / of_member + w.value * ((value_a * values) @ value_b.T) / of_value
        )
        name = names + w.name * column
        kind = kinds + w.type * (type_a.T @ column @ type_b) / per_type
        member = parts + w.member * (member_a.T @ column @ member_b) / per_member
        value = values + w.value * ((value_a.T @ column) * value_b.T).sum(1) / per_value
        top = max([1e-12, *(x.max() for x in (new, name, kind, member, value) if x.size)])
        name, kind, member, value = name / top, kind / top, member / top, value / top
        moved = np.abs(new / top - column).max()
        column = new / top
        if moved < eps:
            break
    return column / max(column.max(), 1e-12)


def correspondences(a: list, b: list, least: float = 0.1, rounds: int = 100) -> list[tuple[int, int]]:
    """Pairs of columns that are one field: the stable matching on the flooding scores of ``least`` or more.

    Both sides rank each other by the same scores, so taking the best open pair again and again is
    the matching in which no two columns would rather have each other (ties by place). ``least`` is
    relative to the best pair: at sf0.1 the pairs that are one field have 0.129 and more, the best of the
    others 0.065.
    """
    if not a or not b:
        return []
    score = flood(a, b, rounds=rounds)
    pairs, left_a, left_b = [], set(range(len(a))), set(range(len(b)))
    for s, i, j in sorted((-score[i, j], i, j) for i in range(len(a)) for j in range(len(b))):
        if -s < least or not -s:
            break
        if i in left_a and j in left_b:
            pairs.append((i, j))
            left_a.discard(i)
            left_b.discard(j)
    return pairs


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for file_id, cols, before in zip(pdf["file_id"], pdf["cols"], pdf["before"]):
            a, b = list(before), list(cols)
            pairs = correspondences(a, b)
            for i, j in pairs:
                if a[i]["name"] != b[j]["name"]:
                    out.append((file_id, "renamed", b[j]["header"], a[i]["name"], b[j]["name"]))
                if a[i]["form"] and b[j]["form"] and a[i]["form"] != b[j]["form"]:
                    out.append((file_id, "retyped", b[j]["header"], a[i]["form"], b[j]["form"]))
            taken_a, taken_b = {i for i, _ in pairs}, {j for _, j in pairs}
            out += [(file_id, "removed", x["header"], x["name"], None) for i, x in enumerate(a) if i not in taken_a]
            out += [(file_id, "added", x["header"], None, x["name"]) for j, x in enumerate(b) if j not in taken_b]
        yield pd.DataFrame(out, columns=["file_id", "change_type", "column_name", "old", "new"])


def schema_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every change of a file against the one before it in its series: file_id, change_type, column_name, old, new.

    ``old`` and ``new`` are names, for 'retyped' forms. Files of a series are ordered by exported_at,
    ties by file_id. A column with no filled cell has no form and is never retyped. Empty tables give
    no rows; columns of the inputs beyond the needed ones are ignored.
    """
    per_file = profile(*read_lines(files, lines))
    order = W.partitionBy("series_id").orderBy("exported_at", "file_id")
    pairs = per_file.withColumn("before", F.lag("cols").over(order)).filter("before is not null").select("file_id", "cols", "before")
    return pairs.mapInPandas(_changes, "file_id bigint, change_type string, column_name string, old string, new string")


#: Header texts of the known fields in lower case.
KNOWN = {field: tuple(sorted({h.lower() for h in texts})) for field, texts in HEADERS.items()}


def _spread(known: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, field) of every node that ``links`` (old, new, n; both ways) join to a known one: of several fields as near, the one with most renames wins."""
    done, front = known, known
    for _ in range(rounds):
        more = links.join(front.withColumnRenamed("node", "old"), "old").groupBy(F.col("new").alias("node"), "field").agg(F.sum("n").alias("n"))
        more = more.groupBy("node").agg(F.max_by("field", F.struct("n", "field")).alias("field"))
        front = cut(more.join(done.select("node"), "node", "left_anti"))
        if front.isEmpty():
            return done
        done = cut(done.union(front))
    raise RuntimeError(f"field names did not settle in {rounds} rounds")


def field_names(changes: DataFrame, columns: DataFrame) -> DataFrame:
    """(series_id, name, field, known): what every header text of a series means.

    Known texts keep their meaning. It goes on along the series' renames until no text is added, then
    along the renames of all series for what is still open. Texts that lead to no known field make
    fields of their own: what renames join is one field, called by the text that most files have.
    """
    spark = columns.sparkSession
    known = spark.createDataFrame([(n, f) for f, names in KNOWN.items() for n in names], "name string, field string")
    used = cut(columns.groupBy("series_id", "name").agg(F.countDistinct("file_id").alias("files")))
    series = columns.select("file_id", "series_id").distinct()
    renames = changes.filter("change_type = 'renamed'").join(series, "file_id").select("series_id", "old", "new")
    links = renames.union(renames.select("series_id", "new", "old")).groupBy("series_id", "old", "new").agg(F.count("*").alias("n"))
    links = cut(links)

    node = lambda c: F.struct("series_id", F.col(c).alias("name"))
    own = _spread(used.join(known, "name").select(node("name").alias("node"), "field"), links.select(node("old").alias("old"), node("new").alias("new"), "n"))
    own = own.select("node.series_id", "node.name", "field")
    everywhere = links.groupBy("old", "new").agg(F.sum("n").alias("n"))
    other = _spread(known.select(F.col("name").alias("node"), "field"), everywhere).withColumnRenamed("node", "name")
    found = used.join(own, ["series_id", "name"], "left").join(other.withColumnRenamed("field", "shared"), "name", "left").withColumn("field", F.coalesce("field", "shared")).drop("shared")
    found = cut(found)

    rest = found.filter("field is null").groupBy("name").agg(F.sum("files").alias("files")).withColumn("id", F.xxhash64("name"))
    pairs = everywhere.join(rest.select(F.col("name").alias("old"), F.col("id").alias("a")), "old").join(rest.select(F.col("name").alias("new"), F.col("id").alias("b")), "new").select("a", "b")
    groups = rest.join(connected_components(pairs).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    called = groups.groupBy("component").agg(F.max_by("name", F.struct("files", "name")).alias("own"))
    named = groups.join(called, "component").select("name", "own")
    return found.join(named, "name", "left").select("series_id", "name", F.coalesce("field", "own").alias("field"), F.col("field").isNotNull().alias("known"))


def learnt_casts(filled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How the fields are written elsewhere: (field -> prefix, width), (field -> key), (file, field -> factor).

    A field's label is the start that most of its texts with a number behind it have, and the number of
    digits if that never changes. An object's member that holds a field is the key whose values are most
    often the field's plain values elsewhere. A file whose numbers are all whole where the field has
    decimals elsewhere is off by the power of ten that brings its median next to the field's.
    """
    known = filled.filter("known")
    label = known.filter("form = 'text'").select("field", F.regexp_extract("value", "^([A-Za-z_]{1,16})\\d+$", 1).alias("prefix"), F.length(F.regexp_extract("value", "^[A-Za-z_]{1,16}(\\d+)$", 1)).alias("width")).filter("prefix <> ''")
    label = label.groupBy("field", "prefix").agg(F.count("*").alias("n"), F.min("width").alias("lo"), F.max("width").alias("hi"))
    label = label.groupBy("field").agg(F.max_by(F.struct("prefix", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("width")), F.struct("n", "prefix")).alias("label")).select("field", "label.*")
    inner = known.filter("form = 'json'").select("field", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    plain = known.filter("form <> 'json'").select("field", "value").distinct()
    hits = inner.groupBy("field", "key", "value").agg(F.count("*").alias("n")).join(plain.withColumn("hit", F.lit(1)), ["field", "value"], "left")
    keys = hits.groupBy("field", "key").agg(F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("hits"), F.sum("n").alias("n")).groupBy("field").agg(F.max_by("key", F.struct("hits", "n", "key")).alias("key"))
    number = known.filter(F.col("form").isin(*NUMBERS)).withColumn("x", F.replace("value", F.lit(","), F.lit(".")).try_cast("double")).filter("x > 0")
    usual = number.filter("form <> 'whole'").groupBy("field").agg(F.percentile_approx("x", 0.5).alias("usual"))
    per_file = number.groupBy("file_id", "field").agg(F.percentile_approx("x", 0.5).alias("here"), F.min((F.col("form") == "whole").cast("int")).alias("whole"))
    factor = F.pow(F.lit(10.0), F.round(F.log10(F.col("usual") / F.col("here"))))
    factors = per_file.filter("whole = 1").join(usual, "field").select("file_id", "field", factor.alias("factor")).filter("factor <> 1")
    return label, keys, factors


def unified(files: DataFrame, lines: DataFrame, changes: DataFrame) -> DataFrame:
    """All files as one measurement table: file_id, line_no, gene, the known fields, cast, and the others as text.

    Every line after the header is a row. Numbers may be written with point, comma or exponent, years may
    stand inside a date or a text; bare numbers of labelled ids, members of objects and powers of ten
    are brought to what the field has elsewhere (see ``learnt_casts``). What cannot be read becomes null.
    ``other`` maps the name of every further field to its filled cells as written. A file's second column
    of the same field, one without a header and cells beyond the header's width are there too, under
    header (or nothing), '#' and place.
    """
    columns, cells = read_lines(files, lines)
    columns = cut(columns)
    names = field_names(changes, columns)
    of = columns.join(names, ["series_id", "name"])
    first = W.partitionBy("file_id", "field").orderBy("pos")
    of = of.withColumn("nth", F.row_number().over(first)).select("file_id", "pos", "header", "field", (F.col("known") & (F.col("nth") == 1)).alias("known"), "nth")
    of = cut(of)
    filled = cut(cells.filter("form is not null").join(of, ["file_id", "pos"], "left"))
    label, keys, factors = learnt_casts(filled)
    # a row for each of the eight fields, and one for a file and field that is off
    told = filled.filter("known").join(F.broadcast(label), "field", "left").join(F.broadcast(keys), "field", "left").join(factors, ["file_id", "field"], "left")
    bare = F.when(F.col("width").isNull(), F.col("value")).otherwise(F.lpad("value", F.greatest("width", F.length("value")), "0"))
    member = F.from_json("value", "map<string,string>")[F.col("key")]
    text = F.when((F.col("form") == "json") & F.col("key").isNotNull(), member).when((F.col("form") == "whole") & F.col("prefix").isNotNull(), F.concat("prefix", bare)).otherwise(F.col("value"))
    wide = told.groupBy("file_id", "line_no").pivot("field", list(KNOWN)).agg(F.first(F.struct("value", text.alias("text"), F.coalesce("factor", F.lit(1.0)).alias("factor"))))
    named = F.when((F.col("nth") == 1) & ~F.col("field").rlike("#\\d+$"), F.col("field")).otherwise(F.concat(F.coalesce("header", F.lit("")), F.lit("#"), F.col("pos") + 1))
    rest = filled.filter("not coalesce(known, false)").groupBy("file_id", "line_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(named, "value")))).alias("other"))
    every = lines.filter("line_no > 1").select("file_id", "line_no").distinct()
    wide = every.join(wide, ["file_id", "line_no"], "left").join(rest, ["file_id", "line_no"], "left")
    text_of = lambda f: F.col(f)["text"]
    number = F.replace(F.col("pchembl")["value"], F.lit(","), F.lit(".")).try_cast("double")
    gene = files.groupBy("file_id").agg(F.min("gene").alias("gene"))
    return wide.join(gene, "file_id", "left").select(
        "file_id", "line_no", "gene", text_of("smiles").alias("smiles"), F.upper(F.regexp_replace(text_of("endpoint"), BLANK, "")).alias("endpoint"),
        F.btrim(text_of("relation"), F.lit("'\"")).alias("relation"), F.round(number * F.col("pchembl")["factor"], 9).alias("pchembl"),
        F.regexp_extract(F.col("year")["value"], "((?:19|20)\\d{2})", 1).try_cast("int").alias("year"),
        text_of("assay_id").alias("assay_id"), text_of("mol_id").alias("mol_id"), text_of("target_chembl_id").alias("target_chembl_id"),
        F.coalesce("other", F.create_map().cast("map<string,string>")).alias("other"),
    )
