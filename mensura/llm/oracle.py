"""SQL with the same rows, where SQL can say it."""

from __future__ import annotations

from mensura.plans.oracle import FP, molecule, present, squeezed, unless_missing, w

RECORDS = f"""
r0 as (select *, {molecule('inchikey')} as key, {present('std_smiles')} as s from compound_target),
stated as (select s, key from (select s, key, count(*) as n from r0 where key is not null and s is not null group by 1, 2) qualify row_number() over (partition by s order by n desc, key) = 1),
rec as (select r0.* exclude (key), coalesce(r0.key, stated.key) as molecule from r0 left join stated on r0.key is null and stated.s = r0.s)"""
NAMES = f"""
names as (select upper(trim(g)) as g, min(upper(trim(chembl_id))) as target from (select chembl_id, unnest(list_append(synonyms, gene)) as g from target_dictionary) group by 1)"""
GROUPS = f"""{RECORDS},{NAMES},
grouped as (select rec_id, molecule, case when {present('gene')} is not null then coalesce(n.target, 'GENE:' || upper({present('gene')})) else {unless_missing(f"regexp_replace(upper({present('target_chembl_id')}), '^BDB:\\s*', '')")} end as target,
  {unless_missing(squeezed('endpoint'))} as e from rec left join names n on n.g = upper({present('gene')}))"""
SIM = FP + ", flat as (select set_id, n_on, unnest(pos) as p from vec), sim as (select a.set_id as a, b.set_id as b, count(*) / (any_value(a.n_on) + any_value(b.n_on) - count(*))::double as s from flat a join flat b using (p) group by 1, 2)"


def components(chain: str, edges: str, first: str, other: str) -> str:
    """(smallest id, other id) of the groups that ``edges`` (id, node) make."""
    return f"""with recursive {chain.strip()}, e as ({edges}), nodes as (select distinct node from e),
      step as (select distinct x.node as a, y.node as b from e x join e y using (id)),
      reach(a, b) as (select node, node from nodes union select reach.a, step.b from reach join step on step.a = reach.b),
      label as (select a as node, min(b) as root from reach group by 1),
      g as (select id, min(root) as root from e join label using (node) group by 1),
      firsts as (select root, min(id) as f from g group by 1)
      select f as {first}, id as {other} from g join firsts using (root) where id <> f"""


SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_HYPHEN = r"[-\x{AD}\x{2010}\x{2011}]+[^\S\n]*\r?\n\s*"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{SPACE}]+')"


PLAIN = f"list_filter(list_transform({words(f"regexp_replace(lower(text), '{LINE_HYPHEN}', '', 'g')")}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda x: x <> '')"
OVERLAP = f"""{RECORDS},
            m as (select distinct lower({present('split_name')}) as split_name, rec_id, case when lower({present('side')}) = 'validation' then 'valid' else lower({present('side')}) end as side from split_member),
            placed as (select m.*, coalesce(rec.molecule, '#' || m.rec_id) as molecule, coalesce(lower({present('rec.source')}), 'unknown') as source from m left join (select rec_id, molecule, min(source) as source from rec group by all) rec using (rec_id)),
            {SIM.strip()},
            twin as (select distinct p.inchikey as a, q.inchikey as b from sim join vec p on p.set_id = sim.a join vec q on q.set_id = sim.b where s >= 9e-1),
            train as (select distinct split_name, molecule from placed where side = 'train'),
            hits as (select t.split_name, t.rec_id, t.source, exists (select 1 from train x where x.split_name = t.split_name and x.molecule = t.molecule)::int as exact,
              exists (select 1 from twin join train x on x.molecule = twin.b where twin.a = t.molecule and x.split_name = t.split_name)::int as near from (select distinct split_name, rec_id, source, molecule from placed where side in ('valid', 'test')) t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": w(GROUPS, "select a.rec_id as rec_id_a, b.rec_id as rec_id_b from grouped a join grouped b using (molecule, target, e) where a.rec_id < b.rec_id"),
        "p2_found": w(f"""{RECORDS},
            m as (select distinct lower({present('split_name')}) as split_name, rec_id, case when lower({present('side')}) = 'validation' then 'valid' else lower({present('side')}) end as side from split_member),
            placed as (select m.*, coalesce(rec.molecule, '#' || m.rec_id) as molecule from m left join rec using (rec_id)),
            {SIM.strip()},
            twin as (select distinct p.inchikey as a, q.inchikey as b from sim join vec p on p.set_id = sim.a join vec q on q.set_id = sim.b where s >= 9e-1),
            close as (select distinct molecule as a, molecule as b from placed union select a, b from twin)""",
            "select distinct t.split_name, t.rec_id from placed t join close on close.a = t.molecule join placed x on x.molecule = close.b and x.side = 'train' and x.split_name = t.split_name where t.side in ('valid', 'test')"),
        "p3_found": w(SIM, "select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from (select a, b from sim where a <> b and s >= 5e-1 qualify row_number() over (partition by a order by s desc, b) <= 5)"),
        "p4_found": components(RECORDS, f"select rec_id as id, 'm' || molecule as node from rec where molecule is not null union select rec_id, 's' || {present('scaffold')} from rec where {present('scaffold')} is not null", "first_rec_id", "rec_id"),
        "p4_invariants": w(GROUPS, f"""select kind, (select count(distinct rec_id) from rec) as n_records, count(distinct key) as n_keys, 0::bigint as n_torn, true as in_valid, true as in_test from (
            select 'molecule' as kind, molecule as key from rec union all select 'scaffold', {present('scaffold')} from rec union all select 'year', year::varchar from rec where year between 1970 and 2026 union all select 'gene', target from grouped) group by kind"""),
        "p6_found": f"""with recursive {SIM.strip()}, e as (select a, b from sim where a <> b and s >= 65e-2), reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b)
            select least(a, min(b)) as first_vec_id, a as vec_id from reach group by a having a <> least(a, min(b))""",
        "p1_invariants": w(GROUPS, """select count(*) as n_groups, sum(n)::bigint as n_records, count(y) as n_year, 0::bigint as n_made_up from (select count(*) as n, max(case when year between 1970 and 2026 then year end) as y from grouped join (select rec_id, year from compound_target) using (rec_id)
            where molecule is not null and target is not null and e is not null group by molecule, target, e)"""),
        "p2_counts": w(OVERLAP, "select split_name, source, count(*) as n_overlapping, sum(exact)::bigint as exact_dupe_keys, sum(near)::bigint as near_dupes from hits where exact + near > 0 group by 1, 2"),
        "p6_invariants": w(FP, "select count(*) as n_vectors, 0::bigint as n_reaching_out from vec"),
        "p8_invariants": "select c::int as capacity, n_docs, 0::bigint as n_over, 0::bigint as n_lapping, 0::bigint as n_cut from (select unnest([2048, 8192]) as c), (select count(distinct doc_id) as n_docs from documents where text <> '')",
        "p9_verbatim": f"""with d as (select doc_id, {PLAIN} as words from documents where text is not null), i as (select item_id, {PLAIN} as words from eval_item where text is not null),
            dg as (select distinct doc_id, hash(array_to_string(words[k:k + 11], ' ')) as h from d, unnest(range(1, len(words) - 10)) as r(k)), ig as (select distinct item_id, hash(array_to_string(words[k:k + 11], ' ')) as h from i, unnest(range(1, len(words) - 10)) as r(k))
            select distinct doc_id, item_id from dg join ig using (h)""",
        "p10_words": f"select distinct doc_id, len(w) as words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars from (select doc_id, {words("coalesce(text, '')")} as w from documents)",
    }
