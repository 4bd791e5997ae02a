"""The registered queries once more, as DuckDB SQL on the same tables."""

from __future__ import annotations

from ..functions import fixed_values as V

_WORDS = lambda words: "|".join(w.replace(".", r"\.") for w in words)

NAMES = """names as (select p_partkey, case when p_partkey % 31 <> 30 then case p_partkey % 7
  when 0 then u || ' ' || p_name when 1 then p_name || ' (' || u || ')' when 2 then 'DNA ' || p_name || ' (EC) (AB' || (p_partkey % 90) || ')'
  when 3 then 'IGHV' || (p_partkey % 7 + 1) || '-' || (p_partkey % 40) || ' heavy chain variable' when 4 then 'Complement factor ' || p_name
  when 5 then 'Lipid kinase of ' || p_name || ', calcium' else 'immunoglobulin ' || p_brand end end as name, p_name, p_brand, p_type, p_size
  from (select *, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) as u from part))"""

BASE = """samples as (select n_nationkey as sample_id, case when n_regionkey in (1, 2, 3) then 1 else 0 end as y from nation where n_nationkey in (select s_nationkey from supplier)),
raw as (select s_nationkey as sample_id, l_partkey as feature, round(sum(l_extendedprice), 2) as value from lineitem join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey where l_linenumber <= 1 + p_size % 7 group by 1, 2),
matrix as (select sample_id, feature, round(log2(value), 9) as value from raw where value > 0),
features as (select p_partkey as feature from part),
membership as (select 'B:' || p_brand as set_id, p_partkey as feature from part union all select 'T:' || p_type, p_partkey from part union all select 'S:' || p_size, p_partkey from part),
scores as (select p_partkey as feature, case when p_partkey % 5 <> 0 then (p_partkey % 7)::double / 7.0::double end as d, case when p_partkey % 4 <> 0 then (p_partkey % 11)::double / 11.0::double end as s from part),
w as (select feature, case when coalesce(d, 0) > 0 or coalesce(s, 0) > 0 then 0.6::double * coalesce(d, 0) + 0.4::double * coalesce(s, 0) else 0.3::double end as w from scores),
rates as (select f.feature, count(m.value) as observed, (select count(*) from samples) - count(m.value) as missing, 1.0::double - count(m.value)::double / (select count(*) from samples) as rate
  from features f left join matrix m on f.feature = m.feature group by 1),
tiered as (select *, case when rate = 0 then 'Complete' when rate <= 0.5 then 'Tier1' when rate <= 0.8 then 'Tier2' else 'Tier3' end as tier from rates)"""

#: running sums over all ranks, as the score is defined
ES = """here as (select distinct set_id, feature from membership where feature in (select feature from matrix)),
present as (select * from here where set_id in (select set_id from here group by 1 having count(*) >= 3)),
ranked as (select *, row_number() over (partition by sample_id order by value desc, feature) as pos, count(*) over (partition by sample_id) as n from matrix),
grid as (select s.set_id, r.sample_id, r.pos, r.n, case when p.feature is null then 0 else 1 end as hit, case when p.feature is null then 0 else abs(r.value) * w.w end as a
  from (select distinct set_id from present) s cross join ranked r join w on w.feature = r.feature left join present p on p.set_id = s.set_id and p.feature = r.feature),
running as (select *, sum(a) over g as ra, sum(1 - hit) over g as rm, sum(a) over h as ta, sum(hit) over h as hits from grid
  window g as (partition by set_id, sample_id order by pos rows unbounded preceding), h as (partition by set_id, sample_id)),
scored as (select set_id, sample_id, case when any_value(n) < 10 then null when any_value(hits) = 0 or any_value(hits) = any_value(n) or any_value(ta) = 0 then 0.0::double
  else sum(ra / nullif(ta, 0) - rm::double / nullif(n - hits, 0)) / any_value(n) end as es from running group by 1, 2),
es as (select s.set_id, t.sample_id, round(x.es, 9) as es from (select distinct set_id from present) s cross join samples t left join scored x on x.set_id = s.set_id and x.sample_id = t.sample_id)"""

MEANS = """means as (select set_id, avg(case when y = 1 then es end) as mean_1, avg(case when y = 0 then es end) as mean_0 from es join samples using (sample_id) group by 1)"""

MWU = """mids as (select *, count(*) over (partition by set_id, es) as peers, rank() over (partition by set_id order by es) + (count(*) over (partition by set_id, es) - 1) / 2.0::double as mid
  from es join samples using (sample_id) where es is not null),
sums as (select set_id, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, sum(case when y = 1 then mid end) as r1, sum(peers * peers - 1)::double as ties from mids group by 1),
mwu as (select set_id, n1, n0, ties, coalesce(r1, 0) - n1 * (n1 + 1) / 2.0::double as u from sums),
rb as (select *, 1.0::double - 2.0::double * u / nullif(n1 * n0, 0)::double as r from mwu)"""


#: the same running sums for every weighting 1 + alpha d + beta s; rank-biserial r of each set under each
GRID = """cells as (select k.set_id, r.sample_id, r.pos, r.n, case when p.feature is null then 0 else 1 end as hit, case when p.feature is null then 0.0::double else abs(r.value) end as a,
  coalesce(c.d, 0.0::double) as d, coalesce(c.s, 0.0::double) as s
  from (select distinct set_id from present) k cross join ranked r join scores c on c.feature = r.feature left join present p on p.set_id = k.set_id and p.feature = r.feature),
walked as (select *, sum(a) over g as r0, sum(a * d) over g as r1, sum(a * s) over g as r2, sum(1 - hit) over g as rm from cells window g as (partition by set_id, sample_id order by pos rows unbounded preceding)),
walks as (select set_id, sample_id, any_value(n) as n, sum(hit) as hits, sum(a) as t0, sum(a * d) as t1, sum(a * s) as t2, sum(r0) as s0, sum(r1) as s1, sum(r2) as s2, sum(rm)::double as sm from walked group by 1, 2),
points as (select i / 4.0::double as alpha, j / 4.0::double as beta from range(5) x(i), range(5) y(j)),
weighed as (select alpha, beta, k.set_id, t.sample_id, t.y, round(case when n < 10 then null when hits = 0 or hits = n or t0 + alpha * t1 + beta * t2 = 0 then 0.0::double
  else ((s0 + alpha * s1 + beta * s2) / nullif(t0 + alpha * t1 + beta * t2, 0) - sm / nullif(n - hits, 0)) / n end, 9) as es
  from points cross join (select distinct set_id from present) k cross join samples t left join walks x on x.set_id = k.set_id and x.sample_id = t.sample_id),
gmids as (select *, rank() over (partition by alpha, beta, set_id order by es) + (count(*) over (partition by alpha, beta, set_id, es) - 1) / 2.0::double as mid from weighed where es is not null),
gsums as (select alpha, beta, set_id, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, coalesce(sum(case when y = 1 then mid end), 0) as r1 from gmids group by 1, 2, 3),
effects as (select *, 1.0::double - 2.0::double * (r1 - n1 * (n1 + 1) / 2.0::double) / nullif(n1 * n0, 0)::double as r from gsums)"""

def normal_p(u: str = "u", n1: str = "n1", n0: str = "n0", ties: str = "ties") -> str:
    z = f"((greatest({u}, {n1} * {n0} - {u}) - {n1} * {n0} / 2.0::double - 0.5::double) / sqrt({n1} * {n0} / 12.0::double * ({n1} + {n0} + 1 - {ties} / (({n1} + {n0}) * ({n1} + {n0} - 1)))))"
    x = f"(greatest({z}, 0.0::double) / sqrt(2.0::double))"
    t = f"(1.0::double / (1.0::double + 0.5::double * {x}))"
    series = "0.17087277::double"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = f"({c}::double + {t} * {series})"
    return f"least(1.0::double, {t} * exp(-{x} * {x} + {series}))"


#: how many subsets of k ranks out of i give U, item by item; then the share of them with U or more
TAILS = """subsets(i, k, u, c) as (select 0, 0, 0, 1.0::double union all select i + 1, k + s, u + s * (i - k), sum(c) from subsets cross join (values (0), (1)) taken(s)
  where i < (select count(*) from samples) and k + s <= 8 group by 1, 2, 3),
tails as (select i, k, u as u_or_more, sum(c) over (partition by i, k order by u desc rows unbounded preceding) / sum(c) over (partition by i, k) as tail from subsets)"""


def p_values(source: str, to: str) -> str:
    """p of all rows of source: exact for small groups without ties, else normal."""
    return f"""{to} as (select x.*, case when n1 = 0 or n0 = 0 then null when ties = 0 and tail is not null then least(1.0::double, 2 * tail) else {normal_p()} end as p
  from {source} x left join tails on i = n1 + n0 and k = least(n1, n0) and u_or_more = greatest(u, n1 * n0 - u))"""


def bh(source: str, keys: str) -> str:
    """q over all rows of source (columns keys, p)."""
    return f"""ranked_p as (select *, row_number() over (order by p, {keys}) as k, count(p) over () as m from {source}),
q as (select *, least(1.0::double, min(p * m / k) over (order by k desc rows unbounded preceding)) as q from ranked_p)"""


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


_P = TAILS + ",\n" + p_values("rb", "pv")
_CATEGORY = "case " + " ".join(f"when regexp_matches(lower(coalesce(name, '')), '{_WORDS(words)}') then '{label}'" for label, words in V.CATEGORIES) + " else 'Other' end"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_IG = f"coalesce(regexp_matches(name, '(?i){V.IMMUNOGLOBULIN}'), false)"
_SYMBOL = rf"""coalesce(case when nullif(regexp_extract(trim(name), '^([A-Z][A-Z0-9]{{1,14}})\b', 1), '') not in ({", ".join(repr(x) for x in V.NOT_A_LEADING_SYMBOL)})
  then nullif(regexp_extract(trim(name), '^([A-Z][A-Z0-9]{{1,14}})\b', 1), '') end,
  list_filter(regexp_extract_all(name, '\(([A-Z][A-Z0-9]{{1,14}})\)', 1), lambda s: s not in ({", ".join(repr(x) for x in V.NOT_A_BRACKETED_SYMBOL)}))[1])"""
_FILLED = "filled as (select s.sample_id, f.feature, coalesce(m.value, avg(m.value) over (partition by f.feature)) as filled from samples s cross join (select distinct feature from matrix) f left join matrix m on m.sample_id = s.sample_id and m.feature = f.feature)"
_JACCARD = """jm as (select distinct set_id, feature from membership), js as (select set_id, count(*) as n from jm group by 1),
jc as (select a.set_id as a, b.set_id as b, count(*) as c from jm a join jm b on a.feature = b.feature and a.set_id < b.set_id group by 1, 2),
jac as (select a, b, c::double / (x.n + y.n - c) as jaccard from jc join js x on x.set_id = a join js y on y.set_id = b)"""
_ES_FILLED = "esf as (select set_id, sample_id, coalesce(es, avg(es) over (partition by set_id)) as es from es)"
_COR = "cor as (select a.set_id as a, b.set_id as b, corr(a.es, b.es) as r from esf a join esf b on a.sample_id = b.sample_id and a.set_id < b.set_id where a.es is not null and b.es is not null group by 1, 2)"
_IQR = "iqrs as (select set_id, case when count(es) > 1 then quantile_cont(es, 0.75) - quantile_cont(es, 0.25) else 0.0::double end as iqr from es group by 1)"
_EMB = "emb as (select vec_id as sample_id, label, unnest(range(len(embedding))) as feature, unnest(embedding)::double as value from embeddings)"
_PAR = "par as (select range as feature, ((range % 7) - 3)::double / 10.0::double as coefficient, range::double / 1000.0::double as mean, (1 + range % 3)::double as deviation, 0.05::double as intercept from range(64))"
_PRED = f"""pred as (select sample_id, 1.0::double / (1.0::double + exp(-(sum(coefficient * (value - mean) / deviation) + any_value(intercept)))) as p0 from emb join par using (feature) group by 1),
predicted as (select sample_id, round(p0, 6) as probability, case when round(p0, 6) > 0.5 then 1 else 0 end as predicted, case when label < 5 then 1 else 0 end as y from pred join (select distinct sample_id, label from emb) using (sample_id))"""
_PHI = "phi as (select sample_id, feature, round(coefficient * (value - avg(value) over (partition by feature)), 9) as phi from emb join par using (feature))"
_RUNS = "runs as (select (20 * (1 + event_id % 9))::int as n_total, 0.75::double + 0.25::double * least(value, 50.0::double) / 50.0::double * ((event_id % 9 + 3)::double / 11.0::double) as accuracy from events)"
_COEF = "coefs as (select (event_id % 200)::int as b, case when user_id % 10 = 9 then 'one class' else 'ok' end as status, user_id as position, case when value > 10 then value - 30.0::double else 0.0::double end as coefficient from events)"
_GRID = "grid_runs as (select event_type as alpha, (user_id % 5)::int as beta, round(avg(value), 6) as acc from events group by 1, 2)"
_FREQ = "freq as (select user_id as position, avg(case when value > 10 then 1.0::double else 0.0::double end) as selection_prob from events group by 1)"

SQL: dict[str, str] = {
    # sources and routing
    "scan_unpivot": "select measure, count(*) as n, round(sum(value), 2) as total from (" + " union all ".join(f"select '{c}' as measure, {c} as value from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") where value is not null group by 1",
    "genesets_explode": "select event_type as set_id, json_extract_string(props, '$.k')::int as feature, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1, 2",
    "disease_fallback": _with(BASE) + "select feature, d as score from scores where d is not null union all select feature, s as score from scores join part on p_partkey = feature where d is null and s is not null and (p_brand, p_type) not in (select (p_brand, p_type) from scores join part on p_partkey = feature where d is not null group by p_brand, p_type having count(*) >= 10)",
    "degree_centrality": "with e as (select 's' || l_suppkey as node from lineitem union all select 'p' || l_partkey from lineitem), d as (select node, count(*) as degree from e group by 1) select node, degree, round(degree::double / max(degree) over (), 9) as centrality from d",
    "route_regex": _with(NAMES) + f"select p_partkey, {_IG} as is_ig from names",
    "route_split": _with(NAMES) + f"select case when {_IG} then 'ig' else 'canonical' end as route, count(*) as n, count(name) as named from names group by 1",
    "classify_category": _with(NAMES) + f"select p_partkey, {_CATEGORY} as category from names",
    "ig_subtype": _with(NAMES) + "select p_partkey, case when regexp_matches(lower(coalesce(name, '')), 'ighv|heavy chain variable|_heavy_') then 'Heavy Variable' when regexp_matches(lower(coalesce(name, '')), 'iglv|igkv|light chain variable|_light_') then 'Light Variable' else 'Other Ig' end as subtype from names",
    "v_genes_top": _with(NAMES) + r"select nullif(upper(regexp_extract(name, '(?i)(IG[HKL]V\d+-\d+)', 1)), '') as gene, count(*) as n from names where nullif(regexp_extract(name, '(?i)(IG[HKL]V\d+-\d+)', 1), '') is not null group by 1 order by n desc, gene limit 20",
    "gene_symbol_extract": _with(NAMES) + f"select p_partkey, {_SYMBOL} as gene from names",
    "name_parts": _with(NAMES) + r"select p_partkey, trim(regexp_extract(name, '^([^(]+)', 1)) as head, regexp_split_to_array(trim(name), '\s+')[1] as token, array_to_string(list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts, case when length(name) > 20 then substr(name, 1, 17) || '...' else name end as short from names",
    "keyword_crossref": _with(NAMES) + f"select p_partkey, array_to_string(list_filter({_LIST(V.DISEASE_KEYWORDS)}, lambda k: contains(lower(name), k)), ', ') as keywords from names where len(list_filter({_LIST(V.DISEASE_KEYWORDS)}, lambda k: contains(lower(name), k))) > 0",
    "keyword_spotlight": _with(NAMES) + "select k.word, arg_min(p_partkey, p_partkey) as first_part, count(*) as n from names join (select unnest(['complement', 'kinase', 'ring', 'bolt']) as word) k on contains(lower(name), k.word) group by 1",
    "label_parse": "select r_regionkey, case when lower(v) in ('ad', '1', 'patient', 'true') then 1 else 0 end as label from (select r_regionkey, case r_regionkey when 0 then 'AD' when 1 then '1' when 2 then 'Patient' when 3 then 'control' else 'TRUE' end as v from region)",
    "to_numeric": "select sum(try_cast(replace(p_brand, 'Brand#', '') as double)) as total, count(try_cast(p_name as double)) as bad, count(try_cast(p_size as double)) as good from part",
    "union_tables": "select source, count(*) as n from (select 'part' as source, p_name as name from part union all select 'customer', c_name from customer) group by 1",
    # matrix
    "missing_rate": _with(BASE) + "select feature, observed, missing, round(rate, 9) as rate from rates",
    "impute_tiers": _with(BASE) + "select feature, tier from tiered",
    "tier_counts": _with(BASE) + "select tier, count(*) as n, sum(missing)::bigint as missing from tiered group by 1",
    "detection_rate": _with(BASE) + "select sample_id, y, detected, round(detected::double / (select count(*) from features), 9) as rate, round(avg(detected::double / (select count(*) from features)) over (), 9) as mean_rate from (select s.sample_id, s.y, count(m.value) as detected from samples s left join matrix m using (sample_id) group by 1, 2)",
    "detection_ecdf": _with(BASE) + "select round(rate, 9) as rate, n, round((sum(n) over (order by rate rows unbounded preceding))::double / sum(n) over (), 9) as share from (select rate, count(*) as n from rates group by 1)",
    "category_missing": _with(BASE) + "select p_type, y, round(avg(m), 9) as mean_missing from (select p_type, s.y, s.sample_id, 1.0::double - count(m.value)::double / count(*) as m from part cross join samples s left join matrix m on m.sample_id = s.sample_id and m.feature = p_partkey group by 1, 2, 3) group by 1, 2",
    "dedup_keep_best": _with(BASE) + "select gene, feature, missing from (select p_name as gene, feature, missing, row_number() over (partition by coalesce(p_name, feature::varchar) order by missing, feature) as k from rates join part on p_partkey = feature) where k = 1",
    "fill_mean": _with(BASE, _FILLED) + "select sample_id, feature, round(filled, 3) as filled from filled",
    "row_zscore": _with(BASE) + "select sample_id, feature, round((value - avg(value) over (partition by feature)) / coalesce(nullif(stddev_pop(value) over (partition by feature), 0.0), 1.0), 6) as z from matrix where feature in (select feature from rates where observed >= 3)",
    "row_stats": _with(BASE) + "select feature, round(avg(value), 6) as mean, round(median(value), 6) as median, round(var_samp(value), 6) as variance, round(stddev_pop(value), 6) as sd from matrix group by 1",
    "median_of_medians": _with(BASE) + "select p_type, round(median(m), 6) as median from (select feature, median(value) as m from matrix group by 1) join part on p_partkey = feature group by 1 order by 2 desc",
    "feature_matrix": _with(BASE, _FILLED) + "select sample_id, count(*)::int as n, round(sum(filled * k), 3) as checksum from (select *, row_number() over (partition by sample_id order by feature) as k from filled) group by 1",
    "sharing": _with(BASE) + "select n_groups, count(*) as n, count(*) filter (where n_groups = 1) as unique_to_one from (select feature, count(distinct y) as n_groups from matrix join samples using (sample_id) group by 1) group by 1",
    "ranges": _with(BASE) + "select count(*) as n, count(distinct feature) as n_features, count(distinct sample_id) as n_samples, round(min(value), 6) as low, round(max(value), 6) as high from matrix",
    "log2_strict": _with(BASE) + "select count(case when value > 0 then 1 end) as positive, count(case when value > 0 and log2(value / 20000.0::double) > 0 then 1 end) as strict from raw",
    "hist_bins": _with(BASE) + "select floor((rate - 0.3::double) / 0.033::double)::bigint as bin, count(*) as n from rates group by 1",
    "kernel_density": _with(BASE) + "select point, round(sum(exp(-0.5::double * pow((point - x) / h, 2.0::double))) / (any_value(n) * any_value(h) * 2.5066282746310002::double), 6) as density from (select rate as x from rates) cross join (select count(*) as n, 0.9::double * least(stddev_samp(rate), (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) / 1.34::double) * pow(count(*), -0.2::double) as h from rates) cross join (select unnest([0.1, 0.3, 0.5, 0.7, 0.9])::double as point) group by 1",
    "qrilc_params": _with(BASE) + "select feature, round(mu, 6) as mu, round(sigma, 6) as sigma, round(lower, 6) as lower, round(case when q5 <= mu then mu + sigma else q5 end, 6) as upper from (select feature, quantile_cont(value, 0.01) as mu, 0.3::double * coalesce(nullif(stddev_samp(value), 0.0), 0.5) as sigma, min(value) - 2.0::double as lower, quantile_cont(value, 0.05) as q5 from matrix group by 1 having count(*) >= 3)",
    "impute_accounting": _with(BASE) + "select tier, count(distinct feature) as features, sum(case when value is null then 1 else 0 end)::bigint as missing, sum(case when value is null and mu is not null and tier <> 'Tier3' then 1 else 0 end)::bigint as imputed, sum(case when value is null and (mu is null or tier = 'Tier3') then 1 else 0 end)::bigint as left_missing from (select t.feature, t.tier, m.value, p.mu from samples s cross join tiered t left join matrix m on m.sample_id = s.sample_id and m.feature = t.feature left join (select feature, quantile_cont(value, 0.01) as mu from matrix group by 1 having count(*) >= 3) p on p.feature = t.feature) group by 1",
    # weights and sets
    "combined_weight": _with(BASE) + "select feature, round(w, 9) as w from w",
    "param_weight": _with(BASE) + "select alpha, beta, round(avg(1.0::double + alpha * coalesce(d, 0.0) + beta * coalesce(s, 0.0)), 6) as mean_w, round(max(1.0::double + alpha * coalesce(d, 0.0) + beta * coalesce(s, 0.0)), 6) as max_w from scores cross join (select unnest([0.0, 0.5, 1.0, 1.5, 2.0])::double as alpha) cross join (select unnest([0.0, 0.5, 1.0, 1.5, 2.0])::double as beta) group by 1, 2",
    "set_size_band": _with(BASE) + "select set_id, n_genes from (select set_id, count(*) as n_genes from membership group by 1) where n_genes between 3 and 100",
    "set_coverage": _with(BASE, ES) + "select set_id, count(*) as present from present group by 1",
    "invert_index": _with(BASE) + "select feature, array_to_string(list_sort(list(distinct set_id)), ',') as sets from membership group by 1",
    "set_algebra": _with(BASE) + "select len(list_intersect(a, b))::int as shared, len(list_distinct(list_concat(a, b)))::int as together, len(list_filter(a, lambda x: not list_contains(b, x)))::int as only_first from (select (select list(feature) from membership where set_id = 'T:ECONOMY') as a, (select list(feature) from membership where set_id = 'S:11') as b)",
    "unmapped": _with(BASE) + "select feature from features where feature not in (select feature from matrix)",
    "core_members": _with(BASE) + "select set_id, count(*) as detected from (select distinct set_id, feature from membership) where feature in (select feature from matrix where value > 14) group by 1",
    "first_match": "select c_mktsegment, min_by(c_custkey, c_custkey) as first_customer, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by 1",
    "join_metadata": _with(BASE) + "select s.set_id, coalesce(m.source, '') as source, coalesce(m.n, 0) as n_genes from (select distinct set_id from membership) s left join (select set_id, left(set_id, 1) as source, count(*) as n from membership where left(set_id, 1) <> 'S' group by 1, 2) m using (set_id)",
    "count_by_source": _with(BASE) + "select left(set_id, 1) as source, count(distinct set_id) as n from membership group by 1",
    "theme_match": "select p_type, case when p_type in ('ECONOMY', 'SMALL') and p_type in ('SMALL', 'PROMO') then 'Both' when p_type in ('ECONOMY', 'SMALL') then 'First' when p_type in ('SMALL', 'PROMO') then 'Second' else 'Neither' end as source_match, not (p_type in ('ECONOMY', 'SMALL', 'PROMO')) as novel, count(*) as n from part group by 1",
    # enrichment
    "ssgsea": _with(BASE, ES, MEANS) + "select set_id, round(mean_1, 6) as mean_1, round(mean_0, 6) as mean_0, round(mean_1 - mean_0, 6) as diff from means",
    "ssgsea_scores": _with(BASE, ES) + "select set_id, sample_id, round(es, 6) as es from es",
    "group_diff": _with(BASE, ES, MEANS) + "select set_id, round(mean_1 - mean_0, 6) as diff, round(abs(mean_1 - mean_0), 6) as abs_diff, case when mean_1 - mean_0 > 0 then 'up' when mean_1 - mean_0 < 0 then 'down' else '-' end as direction from means",
    "source_direction": _with(BASE, ES, MEANS) + "select left(set_id, 1) as source, count(*) filter (where mean_1 > mean_0) as up, count(*) filter (where mean_1 < mean_0) as down from means group by 1",
    "top_sets": _with(BASE, ES, MEANS) + "select set_id, round(abs(mean_1 - mean_0), 6) as abs_diff from means order by abs(mean_1 - mean_0) desc, set_id limit 20",
    "similar_sets": """with upto as (select distinct g || ':' || lpad(k::varchar, 2, '0') as set_id, p_partkey as feature from part, unnest(['all', p_brand]) as u(g), range(p_size, 51) as r(k)),
  sizes as (select set_id, count(*) as n from upto group by 1),
  common as (select x.set_id as a, y.set_id as b, count(*) as c from upto x join upto y on x.feature = y.feature and x.set_id < y.set_id group by 1, 2)
  select a, b, round(c::double / (p.n + q.n - c), 9) as jaccard from common join sizes p on p.set_id = a join sizes q on q.set_id = b where c::double / (p.n + q.n - c) >= 0.7""",
    "jaccard_pairs": _with(BASE, _JACCARD) + "select a, b, round(jaccard, 9) as jaccard from jac",
    "combined_similarity": _with(BASE, ES, _JACCARD, _ES_FILLED, _COR) + "select coalesce(jac.a, cor.a) as a, coalesce(jac.b, cor.b) as b, round(greatest(coalesce(jaccard, 0.0), abs(coalesce(case when isnan(r) then 0.0 else r end, 0.0))), 6) as s from jac full join cor on jac.a = cor.a and jac.b = cor.b",
    "iqr": _with(BASE, ES, _IQR) + "select set_id, round(iqr, 6) as iqr from iqrs",
    "iqr_filter": _with(BASE, ES, _IQR) + "select set_id, round(iqr, 6) as iqr from iqrs where round(iqr, 9) > (select quantile_cont(round(iqr, 9), 0.05) from iqrs)",
    "box_summary": _with(BASE, ES) + "select left(set_id, 1) as source, round(min(es), 6) as low, round(quantile_cont(es, 0.25), 6) as q1, round(median(es), 6) as mid, round(quantile_cont(es, 0.75), 6) as q3, round(max(es), 6) as high from es group by 1",
    # tests
    "mann_whitney": _with(BASE, ES, MWU) + "select set_id, n1, n0, u, ties from mwu",
    "rank_biserial": _with(BASE, ES, MWU) + "select set_id, round(r, 9) as r from rb",
    "bh_fdr": _with(BASE, ES, MWU, _P, bh("pv", "set_id")) + "select set_id, round(p, 6) as p, round(q, 6) as q, q <= 0.05 as significant from q",
    "differential": _with(BASE, ES, MEANS, MWU, _P, bh("pv", "set_id")) + """select set_id, round(mean_1, 6) as mean_1, round(mean_0, 6) as mean_0, round(mean_1 - mean_0, 6) as diff, u, round(r, 6) as r, round(p, 6) as p, round(q, 6) as q,
  q <= 0.05 as significant_fdr, p < 0.05 as significant, round(-log10(greatest(p, 1e-300::double)), 5) as neg_log10_p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars
  from q join means using (set_id) where n1 >= 3 and n0 >= 3""",
    "driver_features": _with(
        BASE,
        """fm as (select *, count(*) over (partition by feature, value) as peers, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double as mid from matrix join samples using (sample_id)),
fs as (select feature, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, sum(case when y = 1 then mid end) as r1, sum(peers * peers - 1)::double as ties from fm group by 1),
fu as (select feature, n1, n0, ties, coalesce(r1, 0) - n1 * (n1 + 1) / 2.0::double as u from fs where n1 >= 3 and n0 >= 2)""",
        TAILS,
        p_values("fu", "fp"),
        "ft as (select m.set_id, f.feature, n1, n0, 1.0::double - 2.0::double * u / (n1 * n0)::double as r, p from fp f join (select distinct set_id, feature from membership) m using (feature))",
        bh("ft", "set_id, feature"),
    )
    + "select set_id, feature, n1, n0, round(r, 6) as r, round(p, 6) as p, round(q, 6) as q, k2 as rank from (select *, row_number() over (partition by set_id order by abs(r) desc, feature) as k2 from q) where k2 <= 5",
    "mann_whitney_p": _with(
        BASE,
        """fm as (select *, count(*) over (partition by feature, value) as peers, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double as mid from matrix join samples using (sample_id)),
fs as (select feature, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0, sum(case when y = 1 then mid end) as r1, sum(peers * peers - 1)::double as ties from fm group by 1),
fu as (select feature, n1, n0, ties, coalesce(r1, 0) - n1 * (n1 + 1) / 2.0::double as u from fs)""",
        TAILS,
        p_values("fu", "fp"),
    )
    + "select feature, n1, n0, u, round(p, 6) as p from fp",
    "weight_grid": _with(BASE, ES, GRID) + "select alpha, beta, count(*) as sets, count(*) filter (where abs(r) >= 0.3::double) as n_large, round(max(abs(r)), 6) as max_r from effects group by 1, 2",
    "ablation": _with(
        BASE,
        ES,
        GRID,
        """large as (select case when alpha = 0 and beta = 0 then 'A' when beta = 0 then 'B' when alpha = 0 then 'C' else 'D' end as condition, set_id
  from effects where alpha in (0, 1) and beta in (0, 1) and abs(r) >= 0.3::double),
compared as (select condition, count(*) as n_sets, count(*) filter (where set_id in (select set_id from large where condition = 'D')) as shared from large group by 1)""",
    )
    + "select condition, n_sets, round(shared::double / (n_sets + (select count(*) from large where condition = 'D') - shared), 6) as overlap from compared",
    "complete_features": _with(BASE, ES) + "select set_id as feature, count(*) as n, round(avg(es), 6) as mean from es where es is not null group by 1 having count(*) = (select count(*) from samples)",
    "best_hits": _with(NAMES) + r"""select query_original, query_clean, p_partkey, hit from (select name as query_original, trim(regexp_extract(name, '^([^(]+)', 1)) as query_clean from (select distinct name from names)) q
  join (select p_partkey, lower(trim(p_name)) as key, row_number() over (partition by lower(trim(p_name)) order by p_partkey) as hit from part) on key = lower(query_clean) where query_clean <> '' and hit <= 5""",
    "usable_symbols": _with(NAMES) + f"select distinct {_SYMBOL} as gene from names where length({_SYMBOL}) >= 2",
    "mapped_features": _with(NAMES, BASE) + f"select feature, {_SYMBOL} as gene, count(*) as n from matrix left join names on p_partkey = feature group by 1, 2",
    "reproducibility": """with e as (select ts::date as day, round(avg(value), 2) as stored from events group by 1), a as (select ts::date as day, avg(value) as again from events group by 1)
select day, round(again, 6) as again, stored, coalesce(abs(again - stored) < 0.01, false) as same from e join a using (day)""",
    "significance_counts": _with(BASE, ES, MWU, _P) + "select count(*) filter (where p < 0.05) as nominal, count(*) filter (where p < 0.01) as strong, count(*) as tests from pv",
    "pairwise_corr": _with(BASE) + "select a.sample_id as a, b.sample_id as b, round(corr(a.value, b.value), 6) as r, count(*) as n from matrix a join matrix b on a.feature = b.feature and a.sample_id < b.sample_id group by 1, 2",
    "filled_corr": _with(BASE, ES, _ES_FILLED, _COR) + "select a, b, round(coalesce(case when isnan(r) then 0.0 else r end, 0.0), 6) as r from cor",
    "empirical_p": "select round((count(*) filter (where value >= 40)::double + 1) / (count(*) + 1), 9) as p, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, max(value) as max from events",
    "value_counts": "select event_type, count(*) as n from events group by 1 order by n desc, 1",
    # models
    "standardize": _with(_EMB) + "select sample_id, feature::int as feature, round((value - avg(value) over (partition by feature)) / coalesce(nullif(stddev_pop(value) over (partition by feature), 0.0), 1.0), 5) as z from emb",
    "score_logistic": _with(_EMB, _PAR, _PRED) + "select sample_id, probability, predicted, probability > 0.3 and probability < 0.7 as low_confidence from predicted",
    "classification_metrics": """with t as (select quality as y, 1 - toxic as predicted, (doc_id * 7 % 101)::double / 101.0::double as score from labels),
c as (select count(*) filter (where y = 1 and predicted = 1) as tp, count(*) filter (where y = 1 and predicted = 0) as fn, count(*) filter (where y = 0 and predicted = 1) as fp, count(*) filter (where y = 0 and predicted = 0) as tn, count(*) as n from t),
m as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as mid from t),
a as (select (sum(case when y = 1 then mid end) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0::double) / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0) as auc from m)
select tp, fn, fp, tn, round((tp + tn)::double / n, 9) as accuracy, round(((tp + tn)::double / n - chance) / nullif(1.0::double - chance, 0.0), 9) as kappa, round(auc, 9) as auc
from (select *, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn))::double / (n * n) as chance from c) cross join a""",
    "linear_shap": _with(_EMB, _PAR, _PHI) + "select feature::int as feature, round(avg(abs(phi)), 6) as importance from phi group by 1",
    "misclassified": _with(_EMB, _PAR, _PRED, _PHI) + """select sample_id, side, feature::int as feature, round(phi, 5) as phi, rank from (select *, row_number() over (partition by sample_id, side order by abs(phi) desc, feature) as rank from (select phi.sample_id, feature, phi,
  case when sign(phi) = case when y = 1 then 1 else -1 end then 'right' else 'wrong' end as side from phi join predicted using (sample_id) where predicted <> y and phi <> 0)) where (side = 'wrong' and rank <= 3) or (side = 'right' and rank <= 2)""",
    "representative_samples": _with(_EMB, _PAR, _PRED) + "select (select sample_id from predicted where y = 1 and predicted = 1 order by probability desc, sample_id limit 1) as right_1, (select sample_id from predicted where y = 0 and predicted = 0 order by probability, sample_id limit 1) as right_0, (select sample_id from predicted where y <> predicted order by abs(probability - 0.5::double) desc, sample_id limit 1) as wrong",
    "resample_summary": _with(_RUNS) + "select n_total, round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as sd, round(quantile_cont(accuracy, 0.025), 6) as ci_low, round(quantile_cont(accuracy, 0.975), 6) as ci_high from runs group by 1",
    "recommended_n": _with(_RUNS) + "select min(n_total) as recommended_n from (select n_total, avg(accuracy) as mean, quantile_cont(accuracy, 0.025) as low from runs group by 1) where mean >= 0.85 and low > 0.75",
    "threshold_sweep": _with(_FREQ) + "select t as threshold, count(*) filter (where selection_prob >= t) as n_stable from freq cross join (select unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9])::double as t) group by 1",
    "stable_by_point": _with(_COEF) + """, pts as (select position % 5 as alpha, (b % 5)::bigint as beta, status, position, coefficient from coefs),
  freq as (select alpha, beta, position, avg(case when abs(coefficient) > 1e-8 then 1.0::double else 0.0::double end) as p from pts where status = 'ok' group by 1, 2, 3)
  select g.alpha, g.beta, count(f.position) as n_stable from (select distinct alpha, beta from pts) g left join freq f on f.alpha = g.alpha and f.beta = g.beta and f.p >= 0.8 group by 1, 2""",
    "selection_frequency": _with(_COEF) + "select * from (select position, round(avg(case when abs(coefficient) > 1e-8 then 1.0::double else 0.0::double end), 6) as selection_prob, round(avg(coefficient), 6) as mean_coef, case when avg(coefficient) > 0 then 'up' when avg(coefficient) < 0 then 'down' else '-' end as direction from coefs where status = 'ok' group by 1) where selection_prob >= 0.5",
    "features_per_fold": _with(_COEF) + "select round(avg(n), 6) as mean, min(n) as low, max(n) as high from (select b, count(distinct position) as n from coefs where status = 'ok' and coefficient <> 0 group by 1)",
    "grid_pivot": _with(_GRID) + "select beta, " + ", ".join(f"max(case when alpha = '{k}' then acc end) as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from grid_runs group by 1",
    "grid_best": _with(_GRID) + "select alpha, beta, acc from grid_runs order by acc desc, alpha, beta limit 1",
    "theme_counts": "select p_type as theme, count(*) as n, count(distinct p_brand) as brands from part group by 1 order by n desc, theme",
    "jaccard_themes": "with t as (select n_regionkey, c_mktsegment || (c_custkey % 7) as theme from customer join nation on c_nationkey = n_nationkey group by 1, 2) select a.n_regionkey as a, b.n_regionkey as b, round(count(*) filter (where a.theme = b.theme)::double / ((select count(*) from t where n_regionkey = a.n_regionkey) + (select count(*) from t where n_regionkey = b.n_regionkey) - count(*) filter (where a.theme = b.theme)), 9) as jaccard from t a join t b on a.n_regionkey < b.n_regionkey group by 1, 2",
}
