"""The same results in SQL over the same tables, for the side-by-side check."""

from __future__ import annotations

import re

MISSING = "('', 'NA', 'N/A', 'NAN', 'NONE', 'NULL', '-')"
B = r"[\s\x{00A0}\x{2007}\x{202F}\x{200B}\x{FEFF}]"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def t(c: str) -> str:
    return f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"


def present(c: str) -> str:
    return f"(case when upper({t(c)}) not in {MISSING} then {t(c)} end)"


def squeezed(c: str) -> str:
    return f"regexp_replace(upper({c}), '{B}', '', 'g')"


def unless_missing(x: str) -> str:
    return f"(case when {x} not in {MISSING} then {x} end)"


def molecule(c: str) -> str:
    return unless_missing(f"regexp_replace({squeezed(c)}, '^[A-Z_]+[=:]', '')")


def year(c: str) -> str:
    return f"(case when {c} between 1970 and 2026 then {c} end)"


FIRST = "arg_min({c}, {o}) filter (where {c} is not null) as {c}"
VALUE = "(case when not isnan(pchembl) and pchembl between 0 and 14 then pchembl end)"

CT = f"""
ct as (select * from (select rec_id, {molecule('inchikey')} as inchikey, upper({present('gene')}) as gene, {unless_missing(squeezed('endpoint'))} as endpoint, {present('std_smiles')} as std_smiles,
    {VALUE} as pchembl, {year('year')} as year, upper({present('target_chembl_id')}) as target_chembl_id, {present('scaffold')} as scaffold, coalesce(lower({present('source')}), 'unknown') as source from compound_target)
  where inchikey is not null and gene is not null and endpoint is not null and pchembl is not null),
m_src as (select inchikey, gene, endpoint, source, median(pchembl) as pchembl, count(*) as n_meas, min(year) as year, {FIRST.format(c='std_smiles', o='rec_id')}, {FIRST.format(c='target_chembl_id', o='rec_id')},
    {FIRST.format(c='scaffold', o='rec_id')}, min(rec_id) as ord from ct group by all),
m_merged as (select inchikey, gene, endpoint, median(pchembl) as pchembl, min(year) as year, {FIRST.format(c='std_smiles', o='ord')}, {FIRST.format(c='target_chembl_id', o='ord')}, {FIRST.format(c='scaffold', o='ord')},
    string_agg(distinct source, ',' order by source) as sources, min(ord) as ord from m_src group by all)"""
FP = f"""
v as (select vec_id, {molecule('inchikey')} as inchikey, list_sort(list_distinct(list_filter(coalesce(bits, list_transform(regexp_extract_all(bits_text, '(\\d+)', 1), lambda x: try_cast(x as int))), lambda x: x >= 0 and x < 2048))) as pos from fingerprint),
vec as (select vec_id as set_id, inchikey, pos, len(pos) as n_on from v where len(pos) > 0)"""
SETS = FP + """,
sets as (select inchikey, min(set_id) as set_id, arg_min(pos, set_id) as pos, arg_min(n_on, set_id) as n_on from vec where inchikey is not null group by inchikey),
bits as (select inchikey, n_on, unnest(pos) as p from sets),
mol_pairs as (select a.inchikey as a, b.inchikey as b, count(*) / (any_value(a.n_on) + any_value(b.n_on) - count(*))::double as similarity from bits a join bits b using (p) group by 1, 2)"""
ROWS = CT + """,
ic as (select * from m_merged where endpoint = 'IC50'),
filled as (select *, coalesce(scaffold, '') as sc, coalesce(year::double, (select median(year) from ic)) as yr from ic),
model_rows as (select concat_ws('|', inchikey, gene, endpoint) as key, inchikey, gene, sc as scaffold, yr as year, pchembl as y from filled)"""


def ranked(order: str, name: str, seed: int) -> str:
    return f"select '{name}' as split, {seed} as seed, *, case when row_number() over (order by {order}, key) <= round_even(count(*) over () * (1e0 - 25e-2), 0) then 'train' else 'test' end as side from model_rows"


def grouped(order: str, name: str, seed: int) -> str:
    return f"""select '{name}' as split, {seed} as seed, r.*, g.side from model_rows r join (select scaffold, case when coalesce(sum(n) over (order by {order}, scaffold rows between unbounded preceding and 1 preceding), 0)
        < round_even(sum(n) over () * 25e-2, 0) then 'test' else 'train' end as side from (select scaffold, count(*) as n from model_rows group by 1)) g using (scaffold)"""


SIDED = ROWS + ",\nsided as (" + " union all by name ".join([
    ranked("md5('1:' || key)", "random", 1), ranked("md5('2:' || key)", "random", 2), grouped("md5('1:' || scaffold)", "scaffold", 1), grouped("md5('2:' || scaffold)", "scaffold", 2), ranked("year", "time", 1),
]) + ")"
ROLES = SIDED + """,
roles as (select *, case when side = 'test' then 'test' when row_number() over (partition by split, seed, side order by md5(seed || 'cal:' || key), key) <= greatest(20, round_even(count(*) over (partition by split, seed, side) * 25e-2, 0)) then 'cal' else 'fit' end as role from sided)"""
PREDICTED = ROLES + "," + SETS + """,
near as (select a, b, similarity from mol_pairs where a <> b and similarity >= 5e-1 union all select distinct inchikey, inchikey, 1e0 from model_rows),
met as (select r.split, r.seed, r.key, n.similarity, f.y, row_number() over (partition by r.split, r.seed, r.key order by n.similarity desc, f.key) as nth
  from roles r join near n on n.a = r.inchikey join roles f on f.split = r.split and f.seed = r.seed and f.inchikey = n.b and f.role = 'fit' where r.role <> 'fit'),
near5 as (select split, seed, key, avg(y) as mu, stddev_pop(y) as sd, max(similarity) as nn from met where nth <= 5 group by all),
whole as (select split, seed, avg(y) as gmu, stddev_pop(y) as gsd from roles where role = 'fit' group by all),
predicted as (select r.split, r.seed, r.key, r.role, r.y, coalesce(n.mu, w.gmu) as mu, round(coalesce(n.sd, w.gsd) + 1e-6, 9) as sigma, coalesce(n.nn, 0e0) as nn
  from roles r left join near5 n using (split, seed, key) join whole w on w.split = r.split and w.seed = r.seed where r.role <> 'fit')"""


def quantile(rows: str, by: str) -> str:
    return f"select {by}, score as q, n from (select *, row_number() over (partition by {by} order by score) as nth, count(*) over (partition by {by}) as n from {rows}) where nth = least(n, ceil((n + 1) * (1e0 - 1e-1)) + 1)"


INTERVALS = PREDICTED + f""",
norm_scores as (select split, seed, abs(y - mu) / sigma as score from predicted where role = 'cal'),
norm_q as ({quantile('norm_scores', 'split, seed')}),
norm as (select p.*, q * sigma as half from predicted p join norm_q using (split, seed) where role = 'test'),
normal as (select *, y between mu - half and mu + half as covered from norm),
edges as (select split, seed, quantile_cont(sigma, [2e-1, 4e-1, 6e-1, 8e-1]) as e from predicted where role = 'cal' group by all),
binned as (select p.*, len(list_filter(e, lambda x: x <= sigma)) as bin, abs(y - mu) as score from predicted p join edges using (split, seed)),
cal as (select * from binned where role = 'cal'),
q_all as ({quantile('cal', 'split, seed')}),
q_bin as ({quantile('cal', 'split, seed, bin')}),
mond0 as (select b.*, coalesce(k.q, a.q) as half from binned b join q_all a using (split, seed) left join (select * from q_bin where n >= 10) k on k.split = b.split and k.seed = b.seed and k.bin = b.bin where role = 'test'),
mond as (select *, y between mu - half and mu + half as covered from mond0)"""


def points(rows: str) -> str:
    return f"""select split, seed, round(sqrt(avg((y - mu) * (y - mu))), 6) as rmse, round(avg(abs(y - mu)), 6) as mae, round(1 - sum((y - mu) * (y - mu)) / case when sum((y - m) * (y - m)) = 0 then 1e-12 else sum((y - m) * (y - m)) end, 6) as r2
      from (select *, avg(y) over (partition by split, seed) as m from {rows}) group by all"""


def rho(rows: str) -> str:
    rank = "rank() over (partition by split, seed order by {c}) + (count(*) over (partition by split, seed, {c}) - 1) / 2e0"
    return f"""select split, seed, round(case when count(*) > 2 then corr(ry, rm) end, 6) as spearman from (select split, seed, {rank.format(c='y')} as ry, {rank.format(c='mu9')} as rm from (select *, round(mu, 9) as mu9 from {rows})) group by all"""


def strata(rows: str) -> str:
    return f"""select split, seed, round(avg(covered::int), 6) as coverage, round(avg(2 * half), 6) as mean_width, round(avg(2 * half) filter (where nn >= 7e-1), 6) as width_low_novel, round(avg(2 * half) filter (where nn < 5e-1), 6) as width_high_novel from {rows} group by all"""


RESULTS = INTERVALS + f""",
pm as ({points('normal')}), sp as ({rho('normal')}), sn as ({strata('normal')}), sm as ({strata('mond')}),
results as (select pm.*, sp.spearman, sn.coverage, sn.mean_width as width, sn.width_low_novel as width_near, sn.width_high_novel as width_novel, sm.coverage as coverage_mondrian, sm.mean_width as width_mondrian
  from pm join sp using (split, seed) join sn using (split, seed) join sm on sm.split = pm.split and sm.seed = pm.seed),
summary as (select split, round(avg(r2), 6) as r2, round(stddev_pop(r2), 6) as r2_sd, round(avg(rmse), 6) as rmse, round(avg(coverage), 6) as coverage, round(stddev_pop(coverage), 6) as cov_sd, round(avg(width), 6) as width,
  round(avg(coverage_mondrian), 6) as cov_mond, round(avg(width_mondrian), 6) as width_mond from results group by 1)"""
ORDER = "(values ('random', 0), ('scaffold', 1), ('cluster', 2), ('time', 3)) o(split, ord)"
EXACT = "select s.split, s.seed, count(*) filter (where side = 'test' and exists (select 1 from sided x where x.split = s.split and x.seed = s.seed and x.side = 'train' and x.inchikey = s.inchikey)) as exact_dupe_keys from sided s group by all"
STRADDLE = "select s.split, s.seed, round(avg(exists(select 1 from sided x where x.split = s.split and x.seed = s.seed and x.side = 'train' and x.scaffold = s.scaffold)::int), 6) as scaffold_straddle_frac from sided s where side = 'test' group by all"
AUDIT = SIDED + "," + SETS + f""",
best as (select s.split, s.seed, s.key, coalesce(max(p.similarity), 0e0) as nn from sided s left join (mol_pairs p join sided x on x.inchikey = p.b and x.side = 'train') on p.a = s.inchikey and x.split = s.split and x.seed = s.seed where s.side = 'test' group by all),
figures as (select split, seed, round(quantile_cont(nn, 5e-1), 6) as nn_tanimoto_median, round(quantile_cont(nn, 9e-1), 6) as nn_tanimoto_p90, round(avg((nn >= 7e-1)::int), 6) as frac_test_nn_ge_0_7, round(avg((nn >= 9e-1)::int), 6) as frac_test_nn_ge_0_9 from best group by all),
sizes as (select split, seed, count(*) filter (where side = 'train') as n_train, count(*) filter (where side = 'test') as n_test from sided group by all),
audit as (select * from sizes join ({EXACT}) using (split, seed) join figures using (split, seed) join ({STRADDLE}) using (split, seed))"""


def w(chain: str, select: str) -> str:
    return f"with {chain.strip()}\n{select}"


def per_endpoint(chain: str) -> str:
    """A chain over IC50 rows with the endpoint as one more key, so over all rows."""
    chain = chain.replace("where endpoint = 'IC50')", ")").replace("(select median(year) from ic)", "(select median(i.year) from ic i where i.endpoint = ic.endpoint)")
    chain = chain.replace("model_rows as (select concat_ws", "model_rows as (select endpoint, concat_ws")
    chain = chain.replace("row_number() over (order by", "row_number() over (partition by endpoint order by").replace("count(*) over ()", "count(*) over (partition by endpoint)").replace("sum(n) over (order by", "sum(n) over (partition by endpoint order by").replace("sum(n) over ()", "sum(n) over (partition by endpoint)")
    chain = chain.replace("(select scaffold, case when", "(select endpoint, scaffold, case when").replace("from (select scaffold, count(*) as n from model_rows group by 1)) g using (scaffold)", "from (select endpoint, scaffold, count(*) as n from model_rows group by 1, 2)) g using (endpoint, scaffold)")
    chain = re.sub(r"((?:\w+\.)?)split, ((?:\w+\.)?)seed", r"\1endpoint, \1split, \2seed", chain)
    chain = re.sub(r"(\w+)\.split = (\w+)\.split", r"\1.endpoint = \2.endpoint and \1.split = \2.split", chain)
    # the summary has no seed; splits with too few rows are left out
    chain = chain.replace("summary as (select split,", "summary as (select endpoint, split,").replace("from results group by 1)", "from results group by 1, 2)")
    return chain


def evaluated(chain: str) -> str:
    """Only splits with ten test and forty train rows are given roles."""
    return chain.replace("end as role from sided)", "end as role from sided join (select endpoint, split, seed from sided group by all having count(*) filter (where side = 'test') >= 10 and count(*) filter (where side = 'train') >= 40) using (endpoint, split, seed))")


FIGURES = "rmse mae r2 spearman coverage width width_near width_novel coverage_mondrian width_mondrian"
LOGO = """
sided as (select 'logo' as split, 42 as seed, r.*, case when gene = 'KRZF' then 'test' else 'train' end as side from model_rows r
  where gene <> 'KRZF' or not exists (select 1 from model_rows x where x.gene <> 'KRZF' and x.endpoint = r.endpoint and x.inchikey = r.inchikey))"""


def rounded(columns: str, digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


REL = """list_extract(['''=''', '=', '', '>', '''''', null, ' "=" '], (row_id % 7 + 1)::int)"""
FRAGMENT = "(list_min(list_transform(string_split(trim(smiles), '.'), lambda x: {'n': -length(x), 'x': x}))).x"
TSV_VALUE = "case when row_id % 5 = 0 then '>' else '' end || coalesce(case when not isnan(pchembl) then printf('%.3f', power(10e0, 9 - pchembl)) end, 'nan')"


def oracle_sql() -> dict[str, str]:
    return {
        "scan_measurements": f"""select * from (select row_id, upper({present('gene')}) as gene, round(case when not isnan(pchembl) and not isinf(pchembl) then pchembl end, 6) as pchembl, {year('year')} as year, coalesce({present('source')}, 'ChEMBL') as source from measurement) where gene is not null and pchembl is not null""",
        "dump_join_chain": """select r_name, year(o_orderdate)::bigint as year, count(*) as n, count(c_custkey) as n_customer, round(sum(l_quantity), 2) as quantity from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
            join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_acctbal > 0
            where l_returnflag = 'A' and l_quantity is not null and r_name is not null and p_size > 5 group by 1, 2""",
        "relation_filter": f"""select gene, relation, count(*) as n from (select *, {REL} as relation from measurement) where trim(relation) <> '' and trim(trim(relation), '''"') in ('=', '') and upper(trim(endpoint)) = 'IC50' and {present('smiles')} is not null group by 1, 2""",
        "exact_value_guard": f"""select event_id, round(x, 6) as value, round(case when x > 0 then 9 - log10(x) end, 6) as p from (select event_id, case when regexp_matches(trim(cell), '{NUMBER}') then try_cast(trim(cell) as double) end as x
            from (select event_id, list_extract(['', '>', '<', '~', ' ', '=', 'nan', '-'], (event_id % 8 + 1)::int) || printf('%.4f', value) || case when event_id % 11 = 0 then 'd' else '' end as cell from events)) where x is not null""",
        "first_match_columns": """select row_id, hit, lower(hit) as name from (select row_id, coalesce(case when a in ('KRZA', 'KRZB', 'TGT40284', 'BindingDB') then a end, case when b in ('KRZA', 'KRZB', 'TGT40284', 'BindingDB') then b end, case when c in ('KRZA', 'KRZB', 'TGT40284', 'BindingDB') then c end) as hit
            from (select row_id, case when row_id % 3 = 0 then gene end as a, case when row_id % 2 = 0 then target_chembl_id end as b, source as c from measurement)) where hit is not null""",
        "tsv_tolerant_scan": f"""select row_id, case acc when 'TGT40210' then 'G0' when 'TGT40247' then 'G1' else 'G2' end as gene, 'BDB:' || acc as target_chembl_id, round(9 - log10(x), 4) as pchembl from (
            select row_id, coalesce(case when a in ('TGT40210', 'TGT40247', 'TGT40284') then a end, case when b in ('TGT40210', 'TGT40247', 'TGT40284') then b end) as acc, case when regexp_matches(cell, '{NUMBER}') then try_cast(cell as double) end as x, smiles from (
            select row_id, {present('smiles')} as smiles, {TSV_VALUE} as cell, {present("(case when row_id % 2 = 0 then target_chembl_id else 'X' end)")} as a, case when row_id % 4 = 0 then null else {present('target_chembl_id')} end as b from measurement where row_id % 13 <> 0))
            where acc is not null and x > 0 and smiles is not null""",
        "replicate_agg": f"""select upper(md5(std)) as inchikey, gene, endpoint, arg_min(std, row_id) as std_smiles, round(median(pchembl), 6) as pchembl, count(*) as n_meas, min(year) as year, arg_min(target_chembl_id, row_id) filter (where target_chembl_id is not null) as target_chembl_id
            from (select nullif({FRAGMENT}, '') as std, upper(trim(gene)) as gene, endpoint, {VALUE} as pchembl, {year('year')} as year, target_chembl_id, row_id from measurement) where std is not null and gene is not null and endpoint is not null and pchembl is not null group by 1, 2, 3""",
        "replicate_unique_check": f"""select 0::bigint as n_repeated, count(*) as n_keys from (select distinct nullif({FRAGMENT}, '') as std, upper(trim(gene)) as gene, endpoint from measurement where {VALUE} is not null) where std is not null and gene is not null and endpoint is not null""",
        "union_sources": w(CT, "select source, gene, count(*) as n, count(scaffold) filter (where source = 'bindingdb') as n_scaffold, round(avg(pchembl), 6) as mean from m_src where source in ('chembl', 'bindingdb') group by 1, 2"),
        "provenance": w(CT, "select inchikey, gene, endpoint, sources from m_merged"),
        "harmonise_merge": w(CT, "select inchikey, gene, endpoint, std_smiles, round(pchembl, 6) as pchembl, scaffold, year, target_chembl_id, sources, sources as source from m_merged"),
        "overlap_report": w(CT, """select *, n_naive - n_merged as n_removed, round((n_naive - n_merged) / n_naive::double, 6) as removed_share from (select count(*) as n_merged, count(*) filter (where contains(sources, ',')) as n_in_several, count(*) filter (where sources = 'chembl') as n_only_chembl,
            count(*) filter (where sources = 'bindingdb') as n_only_bindingdb, (select count(*) from m_src) as n_naive from m_merged)"""),
        "gene_counts": w(CT, "select gene, count(*) as n from m_merged group by 1"),
        "distinct_counts": w(CT, "select count(distinct gene) as genes, count(distinct scaffold) as scaffolds, count(distinct inchikey) as molecules from m_merged"),
        "fill_defaults": w(CT, "select inchikey, gene, endpoint, coalesce(scaffold, '') as scaffold, round(coalesce(year::double, (select median(year) from m_merged)), 6) as year from m_merged"),
        "fp_binarise": "select vec_id, len(b) as n_on, array_to_string(b, ',') as bits from (select vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) as b from embeddings)",
        "tanimoto_pairs": w(FP + ", flat as (select set_id, n_on, unnest(pos) as p from vec)", "select a, b, round(shared / (na + nb - shared)::double, 6) as similarity from (select a.set_id as a, b.set_id as b, any_value(a.n_on) as na, any_value(b.n_on) as nb, count(*) as shared from flat a join flat b using (p) where a.set_id % 100 = 0 and a.set_id <> b.set_id group by 1, 2)"),
        "nn_tanimoto": w(FP + ", flat as (select set_id, n_on, unnest(pos) as p from vec)", "select v.set_id as vec_id, coalesce(round(max(s.x), 6), 0) as nn from vec v left join (select a.set_id as a, count(*) / (any_value(a.n_on) + any_value(b.n_on) - count(*))::double as x from flat a join flat b using (p) where a.set_id % 100 = 0 and b.set_id % 100 <> 0 group by a.set_id, b.set_id) s on s.a = v.set_id where v.set_id % 100 = 0 group by 1"),
        "tanimoto_range_join": w(FP + ", one as (select pos, min(set_id) as set_id, any_value(n_on) as n_on from vec group by pos), flat as (select set_id, n_on, unnest(pos) as p from one)", "select a, b, round(x, 6) as similarity from (select a.set_id as a, b.set_id as b, count(*) / (any_value(a.n_on) + any_value(b.n_on) - count(*))::double as x from flat a join flat b using (p) where a.set_id < b.set_id group by 1, 2) where x >= 65e-2"),
        "cluster_invariants": w(SETS, "select count(*) as n, 0::bigint as near_centres, 0::bigint as stray_members from sets"),
        "split_random": w(SIDED, "select key, side from sided where split = 'random' and seed = 1"),
        "split_time": w(SIDED, "select key, side from sided where split = 'time'"),
        "split_grouped": w(SIDED, "select key, side from sided where split = 'scaffold' and seed = 1"),
        "split_grouped_smallest": w(ROWS, "select key, side from (" + grouped("n", "scaffold", 1) + ")"),
        "calibration_split": w(ROLES, "select split, seed, key, role from roles"),
        "exact_dupes": w(SIDED, EXACT),
        "scaffold_straddle": w(SIDED, STRADDLE),
        "leakage_audit": w(AUDIT, "select * from audit"),
        "logo_distinct": w(ROWS, """select *, n_held - n_distinct as n_duplicates, case when n_distinct >= 10 then 'evaluate' else 'too few' end as verdict from (select count(*) as n_held, count(*) filter (where inchikey not in (select inchikey from model_rows where gene <> 'KRZF')) as n_distinct from model_rows where gene = 'KRZF')"""),
        "knn_predict": w(PREDICTED, f"select split, seed, key, role, {rounded('mu sigma nn', 6)} from predicted"),
        "conformal_normalised": w(INTERVALS, "select split, seed, key, round(log10(half + 1), 6) as log_half, covered from normal"),
        "conformal_mondrian": w(INTERVALS, "select split, seed, key, bin, round(half, 6) as half, covered from mond"),
        "point_metrics": w(PREDICTED + ", test as (select * from predicted where role = 'test')", points("test")),
        "spearman": w(PREDICTED + ", test as (select * from predicted where role = 'test')", rho("test")),
        "coverage_strata": w(INTERVALS, strata("mond")),
        "evaluate_split": w(INTERVALS, f"select * from ({points('mond')}) join ({rho('mond')}) using (split, seed) join ({strata('mond')}) using (split, seed)"),
        "seed_summary": w(RESULTS, f"select split, {rounded('r2 r2_sd rmse coverage cov_sd width cov_mond width_mond', 4)} from summary"),
        "gap_verdict": w(RESULTS, """select round(gap, 4) as gap, round(gap_sd, 4) as gap_sd, case when round(abs(gap), 6) <= round(gap_sd, 6) then 'within noise' when gap > 0 then 'random over-estimates' else 'scaffold above random' end as verdict
            from (select a.r2 - b.r2 as gap, sqrt(a.r2_sd * a.r2_sd + b.r2_sd * b.r2_sd) as gap_sd from summary a, summary b where a.split = 'random' and b.split = 'scaffold')"""),
        "worst_split": w(RESULTS, "select split, round(r2, 4) as r2 from summary where split in ('scaffold', 'cluster', 'time') order by r2, split limit 1"),
        "overcoverage": w(RESULTS, f"select split, {rounded('coverage width cov_mond width_mond', 4)}, abs(cov_mond - (1e0 - 1e-1)) < abs(coverage - (1e0 - 1e-1)) and cov_mond >= round(1e0 - 1e-1 - 2e-2, 6) as improved from summary where split in ('scaffold', 'cluster', 'time') and coverage >= round(1e0 - 1e-1 + 3e-2, 6)"),
        "panel_a": w(AUDIT, f"select o.split, ord, exact_dupe_keys, frac_test_nn_ge_0_9, scaffold_straddle_frac from {ORDER} left join (select * from audit where seed = 1) a on a.split = o.split"),
        "panel_b": w(RESULTS, f"select o.split, ord, round(r2_mean, 4) as r2_mean, round(r2_sd, 4) as r2_sd from {ORDER} left join (select split, avg(r2) as r2_mean, coalesce(stddev_samp(r2), 0) as r2_sd from results group by 1) g on g.split = o.split"),
        "panel_c": w(RESULTS, f"select o.split, ord, {rounded('coverage_mean coverage_sd coverage_mondrian_mean coverage_mondrian_sd', 4)} from {ORDER} left join (select split, avg(coverage) as coverage_mean, coalesce(stddev_samp(coverage), 0) as coverage_sd, avg(coverage_mondrian) as coverage_mondrian_mean, coalesce(stddev_samp(coverage_mondrian), 0) as coverage_mondrian_sd from results group by 1) g on g.split = o.split"),
        "panel_d": w(RESULTS, f"select o.split, ord, {rounded('near novel', 4)} from {ORDER} left join (select split, avg(width_near) as near, avg(width_novel) as novel from results group by 1) g on g.split = o.split"),
        "endpoint_choice": w(CT, "select endpoint, n from (select endpoint, count(*) as n from m_merged group by 1) order by n desc, endpoint limit 1"),
        "endpoint_results": w(evaluated(per_endpoint(RESULTS)), f"select endpoint, split, seed, {rounded(FIGURES, 4)} from results"),
        "endpoint_audit": w(per_endpoint(AUDIT), "select * from audit"),
        "endpoint_overcoverage": w(evaluated(per_endpoint(RESULTS)), f"select endpoint, split, {rounded('coverage width cov_mond width_mond', 4)}, abs(cov_mond - (1e0 - 2e-1)) < abs(coverage - (1e0 - 2e-1)) and cov_mond >= round(1e0 - 2e-1 - 2e-2, 6) as improved from summary where split in ('scaffold', 'cluster', 'time') and coverage >= round(1e0 - 2e-1 + 3e-2, 6)"),
        "logo_evaluate": w(evaluated(per_endpoint(RESULTS.replace(SIDED, ROWS + "," + LOGO))), f"select endpoint, split, seed, {rounded(FIGURES, 4)} from results"),
        "pipeline_invariants": w(CT, "select endpoint, count(*) as n_rows, true as about_a_quarter, 0::bigint as n_torn from m_merged group by 1"),
        "dump_measurements": f"""with m as (select * from measurement where row_id is not null and mol_id is not null and target_chembl_id is not null), s as (select mol_id, min({present('smiles')}) as smiles from m group by 1)
            select case target_chembl_id when 'TGT40210' then 'G0' when 'TGT40247' then 'G1' else 'G2' end as gene, {year('year')} as year, count(*) as n, round(avg(pchembl), 6) as mean, count(assay_id) as n_assays from m join s using (mol_id)
            where target_chembl_id in ('TGT40210', 'TGT40247', 'TGT40284') and row_id % 5 <> 0 and row_id % 7 <> 0 and endpoint = 'IC50' and s.smiles is not null and not isnan(pchembl) and not isinf(pchembl) group by 1, 2""",
        "csv_directory": f"""select upper(gene) as gene, count(*) as n, round(sum(pchembl), 4) as total, count(year) as n_year from measurement where regexp_matches(gene, '^KRZ[A-Z]$') and {present('smiles')} is not null and upper(trim(endpoint)) = 'IC50' and row_id % 6 <> 0 and not isnan(pchembl) and not isinf(pchembl) group by 1""",
        "results_roundtrip": w(CT, "select endpoint, gene, count(*) as n from m_merged group by 1, 2"),
    }
