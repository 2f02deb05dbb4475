"""The same answers in plain SQL."""

from __future__ import annotations

import unicodedata

from catalog import bills
from catalog.queries import CONTACTS, DEMO_DOCUMENT
from veritab.functions.text import ABBREVIATIONS
from veritab.operators.compare import NUMERIC_FIELDS
from veritab.operators.extract import PATTERNS
from veritab.sources.fixtures import COLUMN_TO_FIELD

ORACLE: dict[str, str] = {}

#: Squared weight of a gram that only one of two texts has.
UNSHARED = "power(1 + ln(1.5), 2)"

# Least score of each class of similarity.
SIMILARITY_CLASSES = [(0.95, "EXACT"), (0.80, "HIGH"), (0.60, "MEDIUM"), (0.40, "LOW")]

# Tariff, usual monthly use in kWh (low, high), price per kWh.
TARIFFS = """('R1/450', 20, 150, 415), ('R1/900', 50, 300, 605), ('R1M/900', 50, 300, 1352), ('R1/1300', 80, 500, 1444),
 ('R1/2200', 100, 800, 1444), ('R2/3500', 150, 1500, 1699), ('R2/5500', 200, 2500, 1699), ('R3/6600', 300, 5000, 1699),
 ('B1/1300', 100, 1000, 1444), ('B1/2200', 150, 1500, 1444), ('B2/6600', 300, 5000, 1444)"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def half_even(x: str, digits: int) -> str:
    scale = f"{10.0 ** digits}"
    return f"round_even(cast({x} as double) * {scale}, 0) / {scale}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    upper = f"replace(upper({strip(f'cast({x} as varchar)')}), 'ẞ', 'SS')"
    return rf"coalesce(regexp_replace({upper}, '\s+', ' ', 'g'), '')"


def bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace({norm(x)}, 'RP\.?\s*', '', 'g'), '[.,\s]', '', 'g')"


def address(x: str) -> str:
    text = strip(f"lower({x})")
    for short, long in ABBREVIATIONS:
        text = rf"regexp_replace({text}, '\b{short}\.?\b', '{long}', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[,.\-/\\]+', ' ', 'g'), '\s+', ' ', 'g')"
    return f"coalesce({strip(text)}, '')"


def key_of_tariff(x: str) -> str:
    text = f"replace(replace(upper({strip(x)}), ' ', ''), '-', '/')"
    bare_text = strip(f"replace(replace({text}, 'VA', ''), 'W', '')")
    return f"regexp_replace({bare_text}, '/+$', '')"


def number(x: str) -> str:
    return rf"case when regexp_matches({x}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') then try_cast({x} as double) end"


def amount(x: str) -> str:
    text = f"replace(replace(replace({strip(x)}, ',', ''), '.', ''), ' ', '')"
    for unit in ("Rp", "rp", "kWh", "kwh"):
        text = f"replace({text}, '{unit}', '')"
    return number(text)


def grade(x: str) -> str:
    cases = " ".join(f"when {x} >= {b} then '{n}'" for b, n in SIMILARITY_CLASSES)
    return f"case {cases} else 'NO_MATCH' end"


# --- filters, projections, cleaning -----------------------------------------------------

ORACLE["filter_chain"] = """
select * from orders where o_totalprice >= 100000 and o_totalprice < 400000
and o_orderstatus = 'F' and o_orderkey > 10"""
ORACLE["filter_contains"] = """
select * from part where regexp_matches(p_name, '(?i)RING|bo.t') and starts_with(p_brand, 'Brand#1') and p_size <= 40"""
ORACLE["filter_ne_null"] = """
with o as (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderpriority end as o_orderpriority from orders)
select * from o where o_orderpriority is distinct from '5-LOW'"""
ORACLE["computed_column"] = """
with n as (select *, l_extendedprice * (1 - l_discount) as net from lineitem)
select l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity * 2 as l_quantity, net,
       case when l_tax <> 0 then net / l_tax end as net_per_tax from n"""
ORACLE["bucketize"] = """
with o as (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_totalprice end as p from orders)
select o_orderkey, case when p >= 400000 then '400+' when p >= 300000 then '300-399' when p >= 200000 then '200-299'
 when p >= 100000 then '100-199' else 'below 100' end as bucket from o"""
ORACLE["drop_rename"] = """
select p_partkey, p_name, p_type, p_size as part_size, p_retailprice as retail_price from part"""
ORACLE["numeric_columns"] = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem"""
ORACLE["map_columns"] = bills.select_sql("p_partkey as row_idx", {f"m_{f}": s for f, s in bills.MASTER.items()})

JUNK = """(select o_orderkey,
 case when o_orderkey % 11 = 0 then 'e' when o_orderkey % 13 = 0 then null else cast(o_custkey as varchar) end as rank,
 case when o_orderkey % 22 = 0 then 'N' when o_orderkey % 7 = 0 then null
      else cast(cast(trunc(o_totalprice) as bigint) as varchar) end as rating from orders)"""
ORACLE["junk_drop"] = f"select * from {JUNK} where not coalesce(rank = 'e' and rating = 'N', false)"
ORACLE["non_numeric_rows"] = f"select * from {JUNK} where try_cast(rating as double) is null"
ORACLE["non_numeric_count"] = f"select count(*) as non_numeric from {JUNK} where try_cast(rank as double) is null"
ORACLE["value_count"] = f"""select count(*) filter (rank = 'e') as rank_is_e, count(*) filter (rating = 'N') as "rating_is_N" from {JUNK}"""
_JUNK_COLUMNS = ("o_orderkey", "rank", "rating")
ORACLE["observed_profile"] = " union all ".join(
    [
        f"""select 'rows' as metric, cast(null as varchar) as "column", count(*) as value from {JUNK}""",
        "select 'columns', null, 3", "select 'numeric_columns', null, 1", "select 'text_columns', null, 2",
        f"select 'total_nulls', null, sum((rank is null)::int + (rating is null)::int)::bigint from {JUNK}",
    ]
    + [f"select 'nulls', '{c}', count(*) filter ({c} is null) from {JUNK}" for c in _JUNK_COLUMNS]
    + [f"select 'non_null', '{c}', count({c}) from {JUNK}" for c in _JUNK_COLUMNS]
    + [f"select 'non_numeric', '{c}', count(*) filter (try_cast({c} as double) is null) from {JUNK}" for c in ("rank", "rating")]
    + [f"select 'equals', '{c}', count(*) filter ({c} = '{v}') from {JUNK}" for c, v in (("rank", "e"), ("rating", "N"))]
)
ORACLE["dropna_subset"] = f"select * from {JUNK} where rating is not null"
ORACLE["domain_check"] = """
with o as (select o_orderkey, case when o_orderkey % 9 = 0 then '' when o_orderkey % 8 = 0 then null else o_orderstatus end as status from orders)
select * from o where status is not null and status not in ('', 'F', 'O')"""
ORACLE["coerce_numbers"] = f"select o_orderkey, try_cast(rating as double) as rating from {JUNK}"
ORACLE["strict_cast_dates"] = """
select o_orderkey, cast(o_orderdate as date) as day,
 case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as day_or_null,
 cast(trunc(o_totalprice) as bigint) as price from orders"""
ORACLE["dedup"] = "select distinct text, lang from documents"
ORACLE["duplicate_members"] = """
with l as (select l_orderkey, case when l_linenumber = 7 then null else l_linenumber end as line from lineitem),
c as (select *, count(*) over (partition by l_orderkey, line) as n from l)
select l_orderkey, line from c where n > 1"""
ORACLE["duplicate_count"] = """
select cast(count(*) - count(distinct (text, lang)) as bigint) as duplicate_rows from documents"""

# --- profile ----------------------------------------------------------------------------

ORACLE["group_mean"] = f"""
select n_name, {half_even('avg(c_acctbal)', 4)} as c_acctbal_mean
from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name"""

_FUNCS = {
    "mean": "avg(p_size)", "sum": "sum(p_size)", "count": "count(p_size)", "size": "count(*)",
    "min": "min(p_size)", "max": "max(p_size)", "median": "quantile_cont(p_size, 0.5)",
    "std": "stddev_samp(p_size)", "var": "var_samp(p_size)", "nunique": "count(distinct p_size)",
    "prod": "exp(sum(ln(1 + whole / 100000)))", "sem": "stddev_samp(p_size) / sqrt(count(p_size))",
    "first": "arg_min(p_size, p_partkey)", "last": "arg_max(p_size, p_partkey)",
    "any": "cast(bool_or(whole > 1) as int)", "all": "cast(bool_and(whole > 1) as int)",
    "skew": "sqrt(count(p_size) * (count(p_size) - 1.0)) / (count(p_size) - 2) * "
    "((avg(power(p_size, 3)) - 3 * avg(p_size) * avg(power(p_size, 2)) + 2 * power(avg(p_size), 3)) / power(var_pop(p_size), 1.5))",
}
_SIZED = "(select p_brand, p_partkey, case when p_partkey % 13 = 0 then null else p_size end as p_size, p_size as whole from part)"
ORACLE["group_each_function"] = " union all ".join(
    f"select '{f}' as func, p_brand, {half_even(sql, 6)} as value from {_SIZED} group by p_brand" for f, sql in _FUNCS.items()
)
ORACLE["group_median_hot"] = f"""
select l_returnflag, {half_even('quantile_cont(l_extendedprice, 0.5)', 4)} as median from lineitem group by 1 order by 1"""
ORACLE["mean_count_bround"] = """
select p_name, cast(round_even(cast(avg(p_size) as double), 0) as int) as average_size, count(p_size) as part_count
from (select p_name, case when p_partkey % 13 = 0 then null else p_size end as p_size from part) group by p_name order by p_name"""
_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS = {
    "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
    "25%": "quantile_cont(cast({c} as double), 0.25)", "50%": "quantile_cont(cast({c} as double), 0.5)",
    "75%": "quantile_cont(cast({c} as double), 0.75)", "max": "max({c})",
}
ORACLE["describe"] = " union all ".join(
    f"select '{s}' as statistic, "
    + ", ".join(f"{half_even(sql.format(c=c), 2)} as {c}" for c in _NUMERIC)
    + " from lineitem"
    for s, sql in _STATS.items()
)


def _info(source: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", '{t}' as type, count({c}) as non_null, count(*) - count({c}) as \"null\", "
        f"count(distinct {c}) as \"unique\" from {source}"
        for c, t in columns.items()
    )


ORACLE["column_info"] = _info(
    "(select o_orderkey, case when o_orderkey % 10 = 0 then null else o_custkey end as o_custkey, o_orderstatus, o_orderpriority, "
    "case o_orderkey % 4 when 0 then 0.0 when 1 then 0.0 when 2 then null else o_totalprice end as price from orders)",
    {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string", "price": "double"},
)
ORACLE["column_info_text"] = _info(
    "documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
)
ORACLE["overview"] = """
select count(*) as total_rows, 6 as total_columns, 3 as numeric_columns, 2 as text_columns,
 count(*) filter (o_orderkey % 10 = 0) as total_nulls from orders"""
ORACLE["null_counts"] = " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as nulls from {JUNK}" for c in ("o_orderkey", "rank", "rating")
)
ORACLE["class_share"] = f"""
with c as (select lang, toxic, count(*) as n from labels join documents using (doc_id) group by 1, 2)
select lang, toxic, n, {half_even('n / sum(n) over (partition by lang)', 4)} as share from c"""
ORACLE["class_share_overall"] = f"""
select quality, count(*) as n, {half_even('count(*) / (select count(*) from labels)', 4)} as share from labels group by quality"""
ORACLE["top_n"] = "select * from orders where o_orderkey % 9 <> 0 order by o_totalprice desc, o_orderkey limit 10"
ORACLE["bottom_n"] = """
select o_orderkey, case when o_orderkey % 10 = 0 then null else o_totalprice end as o_totalprice
from orders order by 2 asc nulls last, 1 limit 25"""
ORACLE["preview"] = "select * from orders order by o_orderdate, o_orderkey limit 30"
ORACLE["preview_note"] = """
select case when count(*) > 50 then 'Showing 50 of ' || count(*) || ' rows.' else '' end as note from orders"""
ORACLE["exact_quantiles"] = " union all ".join(
    f"select l_linestatus, cast({q} as double) as q, count(*) as n, {half_even(f'quantile_cont(l_extendedprice, {q})', 4)} as value from lineitem group by 1"
    for q in (0.01, 0.5, 0.999)
)

# --- text and numbers -------------------------------------------------------------------

DOCS = f"({bills.DOCUMENT_SQL})"
ORACLE["text_normalize"] = f"select doc_id, md5({norm('text')}) as normalized from documents"
ORACLE["address_normalize"] = f"select doc_id, {address('alamat')} as alamat, {address('nama_pelanggan')} as nama from {DOCS}"
ORACLE["numeric_normalize"] = f"""
with s as (select o_orderkey, ' Rp. ' || cast(cast(trunc(o_totalprice) as bigint) as varchar) || ',-' as price from orders)
select o_orderkey, {bare('price')} as price from s"""
ORACLE["amounts"] = """
select o_orderkey, case o_orderkey % 4 when 0 then trunc(o_totalprice) when 2 then o_custkey * 1000.0 end as price from orders"""
ORACLE["tariff_keys"] = f"select doc_id, {key_of_tariff('tarif_daya')} as tarif_key from {DOCS}"
ORACLE["contains_two_way"] = f"""
with d as (select doc_id, {norm('nama_pelanggan')} as a, {norm('substring(alamat, 5, 9)')} as b from {DOCS})
select doc_id, a <> '' and b <> '' and (contains(a, b) or contains(b, a)) as inside from d"""
ORACLE["number_formats"] = f"""
select l_orderkey, l_linenumber, l_partkey, format('{{:,.0f}}', round_even(l_extendedprice, 0)) as whole,
 format('{{:,.2f}}', {half_even('l_extendedprice', 2)}) as two, format('{{:+.4f}}', l_discount) as signed,
 format('{{:.0f}}', round_even(l_tax * 100, 0)) || '%' as percent from lineitem"""
ORACLE["fixed_width"] = f"select doc_id, left(coalesce(alamat, ''), 20) as address, left(coalesce(nama_pelanggan, '—'), 25) as name from {DOCS}"
ORACLE["relative_deviation"] = f"""
with d as (select p_partkey,
  case when p_partkey % 9 = 0 then null when p_partkey % 8 = 0 then 0 else p_size * 3 end as a,
  case when p_partkey % 7 = 0 then 0 else p_size + 10 end as b from part)
select p_partkey, {half_even("case when a is null then 0.5 when b = 0 then 0 else least(abs(a - b) / cast(b as double), 1) end", 6)} as deviation from d"""
ORACLE["missing_fields"] = f"""
select doc_id, concat_ws(',', case when id_pelanggan is null then 'id_pelanggan' end,
 case when nama_pelanggan is null then 'nama_pelanggan' end, case when nomor_meter is null then 'nomor_meter' end) as missing from {DOCS}"""

# --- sources and sinks ------------------------------------------------------------------

ORACLE["source_summary"] = """
select '.parquet' as format, count(*) as row_count, 6 as column_count,
 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' as column_names from orders"""
ORACLE["file_metadata"] = "select 'orders.parquet' as file_name, count(*) as row_count from orders"
PAGES = f"({bills.PAGES_SQL})"
ORACLE["page_totals"] = f"select doc_id, count(*) as pages, cast(sum(length(text)) + 2 * (count(*) - 1) as bigint) as characters from {PAGES} group by 1"
ORACLE["printable_pages"] = f"""
select doc_id, page_number, 'Page ' || page_number as heading,
 case when {strip('text')} = '' then '[No extractable text on this page]' else {strip('text')} end as body from {PAGES}"""
ORACLE["csv_round_trip"] = "select o_orderkey, o_orderstatus, o_totalprice from orders"
ORACLE["report_sink"] = """
select 'overview' as name, 1 as n union all select 'column_info', 5 union all select 'statistics', 8
union all select 'full_data', (select count(*) from customer)
union all select 'grouped', (select count(distinct c_mktsegment) from customer)
union all select 'top_records', 10"""

# --- extraction -------------------------------------------------------------------------


def _search(text: str, pattern: str) -> str:
    import re

    group = 1 if re.compile(pattern).groups else 0
    return strip(f"nullif(regexp_extract({text}, {lit('(?im)' + pattern)}, {group}), '')")


def _extracted() -> str:
    """found(doc_id, field, value, confidence, page), documents and searched pages."""
    parts = []
    for field, patterns in PATTERNS.items():
        grade_ = "high" if len(patterns) == 1 else "medium"
        for i, p in enumerate(patterns):
            parts.append(
                f"select doc_id, '{field}' as field, {2 * i} as rank, page_number as page, '{grade_}' as confidence, {_search('text', p)} as value from pg"
            )
            parts.append(
                f"select doc_id, '{field}', {2 * i + 1}, null, 'low', {_search('full_text', p)} from full_texts"
            )
    return f"""pg as ({bills.PAGES_SQL}),
full_texts as (select doc_id, string_agg(text, chr(10) order by page_number) as full_text from pg group by doc_id),
hits as ({' union all '.join(parts)}),
found as (select doc_id, field, value, confidence, cast(page as int) as page from hits where value is not null
 qualify row_number() over (partition by doc_id, field order by rank, page) = 1)"""


_LONG_PAGES = """select 'S' || s_suppkey as doc_id, n as page_number, case n when 1 then 'Periode Januari 2026' || chr(10) || 'Nomor Meter'
 when 620 + s_suppkey % 50 then ': MTR' || s_suppkey when 621 + s_suppkey % 50 then 'Stand Awal 77' else '' end as text
 from (select s_suppkey, unnest(range(1, 622 + s_suppkey % 50)) as n from supplier)"""
ORACLE["extract_long"] = f"with {_extracted().replace(bills.PAGES_SQL, _LONG_PAGES)} select * from found"
ORACLE["extract_fields"] = f"with {_extracted()} select * from found"
ORACLE["extract_flat"] = (
    f"with {_extracted()} select doc_id, "
    + ", ".join(f"max(case when field = '{f}' then value end) as {f}" for f in PATTERNS)
    + " from full_texts left join found using (doc_id) group by doc_id"
)
_NAMES = sorted(PATTERNS)
ORACLE["extract_summary"] = f"""
with {_extracted()}, names as (select unnest([{', '.join(lit(n) for n in _NAMES)}]) as field),
pairs as (select doc_id, names.field, value from full_texts cross join names left join found using (doc_id, field))
select doc_id, cast(2 as bigint) as pages, cast(count(value) as int) as fields_found, cast({len(_NAMES)} - count(value) as int) as fields_missing,
 coalesce(string_agg(field, ',' order by field) filter (value is null), '') as missing from pairs group by doc_id"""
ORACLE["extract_coverage"] = f"""
with {_extracted()}, names as (select unnest([{', '.join(lit(n) for n in _NAMES)}]) as field)
select names.field as field, count(value) as documents_found, (select count(*) from full_texts) - count(value) as documents_missing
from names left join found using (field) group by names.field"""
ORACLE["extract_contacts"] = " union all ".join(
    f"select doc_id, '{f}' as field, {_search('text', ps[0])} as value, 'high' as confidence, 1 as page from documents where {_search('text', ps[0])} is not null"
    for f, ps in CONTACTS.items()
)

def _latin1(x: str) -> str:
    """Letters with marks become letter and '?', as their marks are no Latin-1; so does all else beyond it."""
    for code in range(0xA0, 0x180):
        parts = unicodedata.normalize("NFKD", chr(code))
        if parts != chr(code):
            x = f"replace({x}, '{chr(code)}', '{''.join(c if ord(c) < 256 else '?' for c in parts)}')"
    return rf"regexp_replace({x}, '[^\x00-\xFF]', '?', 'g')"


ORACLE["latin1_text"] = f"select doc_id, {_latin1('text')} as text from documents"
ORACLE["csv_title_rows"] = "select n_nationkey as key, n_name as name, n_regionkey as region from nation"

# --- similarity -------------------------------------------------------------------------


def grams_of(source: str, key: str, text: str) -> str:
    """Counted grams of normalised texts: (key, g, t)."""
    return f"""(select {key}, substring(w, cast(i as bigint), cast(n as bigint)) as g, count(*) as t
 from (select {key}, ' ' || unnest(string_split({text}, ' ')) || ' ' as w from {source} where {text} <> ''),
 (select unnest([2, 3, 4]) as n), (select unnest(range(1, 80)) as i)
 where i + n - 1 <= length(w) group by all)"""


def similarities(left: str, right: str, name: str) -> str:
    """CTEs ending in {name}(a, b, s): scores above 0 of all pairs of distinct texts."""
    return f"""{name}_t as (select txt, row_number() over () as id from (select distinct txt from ({left}) union select distinct txt from ({right})) where txt <> ''),
{name}_g as materialized {grams_of(f'{name}_t', 'id', 'txt')},
{name}_n as (select id, sum(t * t) as n from {name}_g group by id),
{name}_l as (select id, g, t from {name}_g join {name}_t using (id) where txt in (select txt from ({left}))),
{name}_r as (select id, g, t from {name}_g join {name}_t using (id) where txt in (select txt from ({right}))),
{name}_p as (select l.id as a, r.id as b, sum(l.t * r.t) as dot, sum(l.t * l.t) as sa, sum(r.t * r.t) as sb
 from {name}_l l join {name}_r r on l.g = r.g group by 1, 2),
{name} as materialized (select x.txt as a, y.txt as b, case when p.a = p.b then 1.0 else
 round(dot / sqrt((sa + {UNSHARED} * (nx.n - sa)) * (sb + {UNSHARED} * (ny.n - sb))), 4) end as s
 from {name}_p p join {name}_n nx on nx.id = p.a join {name}_n ny on ny.id = p.b
 join {name}_t x on x.id = p.a join {name}_t y on y.id = p.b)"""


_PAIRS = f"""pairs as (select p_partkey, {address("concat_ws(' ', p_name, p_brand, p_type, p_size)")} as a,
 {address("case p_partkey % 4 when 0 then replace(concat_ws(' ', p_name, p_brand, p_type), 'i', 'y') when 1 then concat_ws(' ', p_type, p_name) when 2 then concat_ws(' ', p_name, p_brand, p_type, p_size) else '' end")} as b from part)"""
_PAIR_GRAMS = f"""{_PAIRS},
ga as {grams_of('pairs', 'p_partkey', 'a')}, gb as {grams_of('pairs', 'p_partkey', 'b')},
pg as (select coalesce(ga.p_partkey, gb.p_partkey) as p_partkey, coalesce(ga.g, gb.g) as g, coalesce(ga.t, 0) as ta, coalesce(gb.t, 0) as tb
 from ga full join gb on ga.p_partkey = gb.p_partkey and ga.g = gb.g)"""
_PAIR_SCORES = f"""{_PAIR_GRAMS},
w as (select *, case when ta > 0 and tb > 0 then 1.0 else {UNSHARED} end as w from pg),
c as (select p_partkey, sum(ta * tb) / sqrt(sum(ta * ta * w) * sum(tb * tb * w)) as s from w group by 1 having sum(tb) > 0),
scored as (select p_partkey, case when a = '' or b = '' then 0 when a = b then 1 else round(coalesce(s, 0), 4) end as score from pairs left join c using (p_partkey))"""
ORACLE["pair_similarity"] = f"with {_PAIR_SCORES} select p_partkey, {half_even('score', 3)} as score, {grade('score')} as class from scored"
ORACLE["pair_similarity_long"] = f"with {_PAIR_SCORES} select p_partkey, {half_even('score', 3)} as score from scored"
ORACLE["batch_similarity"] = f"""
with {_PAIR_GRAMS},
df as (select g, sum(cast(ta > 0 as int) + cast(tb > 0 as int)) as df from pg group by g),
w as (select pg.*, power(ln((1.0 + 2 * (select count(*) from part)) / (1 + df)) + 1, 2) as w from pg join df using (g)),
c as (select p_partkey, sum(ta * tb * w) / sqrt(sum(ta * ta * w) * sum(tb * tb * w)) as s from w group by 1 having sum(tb) > 0)
select p_partkey, {half_even('round(coalesce(s, 0), 4)', 3)} as score from pairs left join c using (p_partkey)"""
ORACLE["best_candidate"] = f"""
with c as (select p_brand as q, p_partkey as idx, {address("concat_ws(' ', p_name, p_type, p_size)")} as txt from part),
a as (select p_brand as q, cast(-1 as bigint) as idx, {address("replace(arg_max(concat_ws(' ', p_name, p_type, p_size), p_partkey), 'i', 'y')")} as txt from part group by 1),
x as (select * from c union all select * from a),
g as {grams_of('x', 'q, idx', 'txt')},
n as (select q, count(*) as n from x group by q),
df as (select q, g, count(*) as df from g group by 1, 2),
w as (select g.*, power(ln((1.0 + n) / (1 + df)) + 1, 2) as w from g join df using (q, g) join n using (q)),
nr as (select q, idx, sum(t * t * w) as nn from w group by 1, 2),
d as (select c.q, c.idx, sum(c.t * a.t * c.w) as dot from w c join w a on a.q = c.q and a.g = c.g and a.idx = -1 where c.idx >= 0 group by 1, 2),
s as (select c.q, c.idx, coalesce(dot / sqrt(x.nn * y.nn), 0) as s from c left join d using (q, idx)
 left join nr x on x.q = c.q and x.idx = c.idx left join nr y on y.q = c.q and y.idx = -1)
select q as query_id, idx as best_index, {half_even('round(s, 4)', 3)} as best_score from s
qualify row_number() over (partition by q order by round(s, 10) desc, idx) = 1"""

# --- reconciliation ---------------------------------------------------------------------

_FIELDS = list(COLUMN_TO_FIELD.values())
_BASE = f"""m as materialized ({bills.MASTER_SQL}), d as materialized ({bills.DOCUMENT_SQL}),
mk as materialized (select row_idx, {bare('id_pelanggan')} as i, {norm('nomor_meter')} as mt, {address('nama_pelanggan')} as n, {address('alamat')} as a, {norm('nama_pelanggan')} as cn from m),
dk as materialized (select doc_id, {bare('id_pelanggan')} as i, {norm('nomor_meter')} as mt, {address('nama_pelanggan')} as n, {address('alamat')} as a, {norm('nama_pelanggan')} as cn from d)"""


def pair_scores(pairs: str, column: str, name: str) -> str:
    """CTEs ending in {name}(doc_id, row_idx, s) for the given pairs of dk and mk."""
    return f"""{name}_d as materialized {grams_of('dk', 'doc_id', column)},
{name}_m as materialized {grams_of('mk', 'row_idx', column)},
{name}_q as materialized (select p.doc_id, p.row_idx, x.g, x.t from {pairs} p join {name}_d x on x.doc_id = p.doc_id),
{name}_p as (select q.doc_id, q.row_idx, sum(q.t * y.t) as dot, sum(q.t * q.t) as sa, sum(y.t * y.t) as sb
 from {name}_q q join {name}_m y on y.row_idx = q.row_idx and y.g = q.g group by 1, 2),
{name} as materialized (select p.doc_id, p.row_idx, case when dk.{column} = mk.{column} then 1.0 else
 round(dot / sqrt((sa + {UNSHARED} * (nx.n - sa)) * (sb + {UNSHARED} * (ny.n - sb))), 4) end as s
 from {name}_p p join (select doc_id, sum(t * t) as n from {name}_d group by 1) nx using (doc_id)
 join (select row_idx, sum(t * t) as n from {name}_m group by 1) ny using (row_idx) join dk using (doc_id) join mk using (row_idx))"""


_POINTS = "(case when dk.i <> '' and dk.i = mk.i then 10.0 else 0 end) + (case when dk.mt <> '' and dk.mt = mk.mt then 5.0 else 0 end)"
# An address adds 2 points at most, so only rows within 2 of the best by the rest need one.
_BEST = f"""{_BASE},
{similarities("select n as txt from dk", "select n as txt from mk", "sn")},
without as materialized (select doc_id, row_idx, {_POINTS} + 4 * coalesce(sn.s, 0) as score
 from dk cross join mk left join sn on sn.a = dk.n and sn.b = mk.n),
near as materialized (select * from without where score >= 1 qualify score + 2.001 >= max(score) over (partition by doc_id)),
{pair_scores('near', 'a', 'sa')},
allpairs as (select near.doc_id, near.row_idx, near.score + 2 * coalesce(sa.s, 0) as score from near left join sa using (doc_id, row_idx)),
ranked as (select doc_id, max(score) as score, arg_min(row_idx, (-round(score, 6), row_idx)) as row_idx from allpairs group by doc_id),
best as materialized (select doc_id, case when score >= 3 then row_idx end as row_idx, case when score >= 3 then score end as score
 from dk left join ranked using (doc_id))"""
ORACLE["best_match_rows"] = f"with {_BEST} select doc_id, row_idx, {half_even('score', 3)} as match_score from best"
ORACLE["best_match_plain"] = f"""
with {_BASE},
allpairs as (select doc_id, row_idx, {_POINTS} + (case when dk.cn <> '' and mk.cn <> '' and (contains(dk.cn, mk.cn) or contains(mk.cn, dk.cn)) then 3.0 else 0 end) as score
 from dk cross join mk),
ranked as (select doc_id, max(score) as score, arg_min(row_idx, (-score, row_idx)) as row_idx from allpairs group by doc_id)
select doc_id, case when score >= 3 then row_idx end as row_idx, case when score >= 3 then {half_even('score', 3)} end as match_score from ranked"""


def _cell(column: str, field: str, position: int, ml: bool) -> str:
    """Compared field of joined rows j with d_, m_ values, and the scores of texts."""
    d, m = f"nullif(d_{field}, '')", f"nullif(m_{field}, '')"
    score = {"nama_pelanggan": "name_s", "alamat": "addr_s"}.get(field) if ml else None
    rules = [
        ("row_idx is null", "MISSING", "'No matching row found in Excel template'"),
        (f"{d} is null and {m} is null", "MISSING", "'Both PDF and Excel values are empty'"),
        (f"{d} is null", "MISSING", "'Not found in PDF document'"),
        (f"{m} is null", "MISSING", "'Not found in Excel template'"),
    ]
    if field in NUMERIC_FIELDS:
        rules.append((f"{bare(d)} = {bare(m)}", "MATCH", "'Exact numeric match'"))
        rules.append(("true", "MISMATCH", f"'PDF=''' || {bare(d)} || ''' vs Excel=''' || {bare(m)} || ''''"))
    else:
        x, y = norm(d), norm(m)
        differ = f"'PDF=''' || {d} || ''' vs Excel=''' || {m} || ''''"
        rules.append((f"{x} = {y}", "MATCH", "'Exact match'"))
        rules.append((f"{x} <> '' and {y} <> '' and (contains({x}, {y}) or contains({y}, {x}))", "MATCH", "'Partial/contains match'"))
        if score:
            shown = f"format('{{:.2f}}', {score})"
            rules.append((f"{score} >= 0.75", "MATCH", f"'ML similarity match (' || {grade(score)} || ', score=' || {shown} || ')'"))
            differ = f"'ML similarity=' || {shown} || ' (' || {grade(score)} || '). ' || {differ}"
        rules.append(("true", "MISMATCH", differ))
    status = " ".join(f"when {t} then '{s}'" for t, s, _ in rules)
    notes = " ".join(f"when {t} then {n}" for t, _, n in rules)
    rated = f"case when row_idx is not null then {score} end" if score else "cast(null as double)"
    return (
        f"select doc_id, cast({position} as int) as position, {lit(column)} as field_name, '{field}' as pdf_key, {d} as pdf_value, "
        f"{m} as excel_value, case {status} end as match_status, case {notes} end as notes, "
        f"{half_even(rated, 3)} as similarity_score, case when {rated} is not null then {grade(rated)} end as similarity_class from j"
    )


def _cells(ml: bool) -> str:
    return " union all ".join(_cell(c, f, i, ml) for i, (c, f) in enumerate(COLUMN_TO_FIELD.items()))


_SIDES = ", ".join(f"d.{f} as d_{f}, m.{f} as m_{f}" for f in _FIELDS)
_OWN_PAIRS = f"""{_BASE}, own as (select doc_id, cast(substring(doc_id, 2) as bigint) as row_idx from d),
j0 as (select d.doc_id, m.row_idx, {_SIDES} from own join d using (doc_id) join m on m.row_idx = own.row_idx)"""
_OWN = f"""{_OWN_PAIRS}, {pair_scores('own', 'n', 'xn')}, {pair_scores('own', 'a', 'xa')},
j as materialized (select j0.*, coalesce(xn.s, 0) as name_s, coalesce(xa.s, 0) as addr_s
 from j0 left join xn using (doc_id, row_idx) left join xa using (doc_id, row_idx))"""
_MATCHED = f"""{_BEST}, won as (select doc_id, row_idx from best where row_idx is not null),
{pair_scores('won', 'n', 'xn')}, {pair_scores('won', 'a', 'xa')},
j as materialized (select d.doc_id, best.row_idx, {_SIDES}, coalesce(xn.s, 0) as name_s, coalesce(xa.s, 0) as addr_s
 from d join best using (doc_id) left join m on m.row_idx = best.row_idx
 left join xn on xn.doc_id = d.doc_id left join xa on xa.doc_id = d.doc_id),
cells as materialized ({_cells(True)})"""
ORACLE["compare_fields"] = f"with {_OWN} {_cells(True)}"
ORACLE["compare_fields_plain"] = f"with {_OWN_PAIRS}, j as (select * from j0), cells as ({_cells(False)}) select doc_id, position, field_name, match_status, notes from cells"

_DEMO = ", ".join(f"{lit(DEMO_DOCUMENT[f])} as d_{f}, m.{f} as m_{f}" for f in _FIELDS)
_DEMO_BASE = _BASE.replace(bills.DOCUMENT_SQL, "select 'demo' as doc_id, " + ", ".join(f"{lit(v)} as {f}" for f, v in DEMO_DOCUMENT.items()))
ORACLE["all_rows"] = f"""
with {_DEMO_BASE}, own as (select doc_id, row_idx from dk, mk), {pair_scores('own', 'n', 'xn')}, {pair_scores('own', 'a', 'xa')},
j as (select cast(m.row_idx as varchar) as doc_id, m.row_idx, {_DEMO}, coalesce(xn.s, 0) as name_s, coalesce(xa.s, 0) as addr_s
 from m left join xn using (row_idx) left join xa using (row_idx)),
cells as ({_cells(True)})
select cast(doc_id as bigint) as row_idx, cast(doc_id as bigint) + 1 as row_number,
 cast(count(*) filter (match_status = 'MATCH') as int) as match_count,
 {half_even("count(*) filter (match_status = 'MATCH') / 11.0 * 100", 1)} as match_percentage from cells group by doc_id"""
_BRAND = "case when {key} % 3 = 0 then 'THIRD' else regexp_extract(alamat, ', ([^,]*)$', 1) end"
_NUMBER = "cast(substring(doc_id, 2) as bigint)"
ORACLE["all_rows_blocked"] = f"""
with {_BASE}, own as (select doc_id, row_idx from (select doc_id, {_BRAND.format(key=_NUMBER)} as block from d where {_NUMBER} % 20 = 0)
 join (select row_idx, {_BRAND.format(key='row_idx')} as block from m) using (block)),
{pair_scores('own', 'n', 'xn')}, {pair_scores('own', 'a', 'xa')},
j as materialized (select d.doc_id || '/' || m.row_idx as doc_id, m.row_idx, {_SIDES}, coalesce(xn.s, 0) as name_s, coalesce(xa.s, 0) as addr_s
 from own join d using (doc_id) join m using (row_idx) left join xn using (doc_id, row_idx) left join xa using (doc_id, row_idx)),
cells as ({_cells(True)})
select split_part(doc_id, '/', 1) as doc_id, cast(split_part(doc_id, '/', 2) as bigint) as row_idx, cast(split_part(doc_id, '/', 2) as bigint) + 1 as row_number,
 cast(count(*) filter (match_status = 'MATCH') as int) as match_count,
 {half_even("count(*) filter (match_status = 'MATCH') / 11.0 * 100", 1)} as match_percentage from cells group by all"""
_SUMMARY = f"""sums as (select doc_id, cast(count(*) filter (match_status = 'MATCH') as int) as total_match,
 cast(count(*) filter (match_status = 'MISMATCH') as int) as total_mismatch, cast(count(*) filter (match_status = 'MISSING') as int) as total_missing,
 {half_even("count(*) filter (match_status = 'MATCH') / 11.0 * 100", 1)} as match_percentage from cells group by doc_id)"""
_SUMMARY_SELECT = """select doc_id, row_idx as matched_row_index, row_idx + 1 as matched_row_number, 11 as total_fields_checked, total_match, total_mismatch,
 total_missing, match_percentage,
 case when match_percentage = 100 then 'VERIFIED' when row_idx is null then 'UNVERIFIED' else 'MISMATCH DETECTED' end as verdict,
 case when match_percentage = 100 then 'VERIFIED' when match_percentage >= 70 then 'PARTIAL MATCH' else 'MISMATCH' end as report_status
 from sums join best using (doc_id)"""
ORACLE["crosscheck_summary"] = f"with {_MATCHED}, {_SUMMARY} {_SUMMARY_SELECT}"
ORACLE["stream_crosscheck"] = ORACLE["crosscheck_summary"]
_FLAT = ORACLE["extract_flat"].removeprefix(f"with {_extracted()} ")
_FROM_PAGES = _MATCHED.replace(f"d as materialized ({bills.DOCUMENT_SQL})", f"{_extracted()}, d as materialized ({_FLAT})")
ORACLE["crosscheck_from_pages"] = f"with {_FROM_PAGES}, {_SUMMARY} {_SUMMARY_SELECT}"
ORACLE["crosscheck_errors"] = f"""
with {_MATCHED} select doc_id, cast(row_number() over (partition by doc_id order by position) as int) as error_number, field_name, pdf_value, excel_value, notes
from cells where match_status = 'MISMATCH'"""
ORACLE["crosscheck_detail"] = f"with {_MATCHED} select doc_id, position, field_name, pdf_value, excel_value, match_status, notes from cells"

# --- anomalies --------------------------------------------------------------------------

_TARIFF = f"tariffs(tarif_key, low, high, rate) as (values {TARIFFS})"
ORACLE["tariff_lookup"] = f"""
with {_TARIFF}, d as (select doc_id, {key_of_tariff("coalesce(tarif_daya, '')")} as tarif_key from {DOCS})
select doc_id, tarif_key, low, high, rate from d left join tariffs using (tarif_key)"""


def _flags(source: str, keys: str) -> str:
    rp = "format('{:,.0f}', round_even(%s, 0))"
    paid, total, due = rp % "b / u", rp % "b", rp % "rate * u"
    f = "format('{:.1f}', %s)"
    s, e, u, b, diff = f % "s", f % "e", f % "u", f % "b", f % "(e - s)"
    off = "abs(b / u - rate) / rate"
    rules = [
        ("e < s", "stand_meter_akhir", "CRITICAL", "'Stand meter akhir is LESS than stand meter awal (meter went backwards)'", f"'> ' || {s}", e),
        ("abs(e - s - u) > 1", "pemakaian_kwh", "CRITICAL", f"'Pemakaian (' || {u} || ') doesn''t match meter difference (' || {diff} || ')'", diff, u),
        ("u < low * 0.5", "pemakaian_kwh", "WARNING", "'Unusually LOW consumption for tariff ' || tarif_key", "low || ' - ' || high || ' kWh'", f"{u} || ' kWh'"),
        ("u > high * 1.5", "pemakaian_kwh", "WARNING", "'Unusually HIGH consumption for tariff ' || tarif_key", "low || ' - ' || high || ' kWh'", f"{u} || ' kWh'"),
        (
            f"u > 0 and {off} > 0.3", "biaya_listrik", "WARNING",
            f"'Billing rate Rp ' || {paid} || '/kWh deviates ' || format('{{:.0f}}', round_even({off} * 100, 0)) || '% from expected Rp ' || rate || '/kWh'",
            f"'~Rp ' || rate || '/kWh (total ~Rp ' || {due} || ')'",
            f"'Rp ' || {paid} || '/kWh (total Rp ' || {total} || ')'",
        ),
        ("u <= 0", "pemakaian_kwh", "WARNING", "'Zero or negative consumption'", "'> 0'", u),
        ("b <= 0", "biaya_listrik", "WARNING", "'Zero or negative billing amount'", "'> 0'", b),
    ]
    parts = " union all ".join(
        f"select {keys}, '{field}' as field, '{sev}' as severity, {msg} as message, {exp} as expected, {act} as actual from p where {test}"
        for test, field, sev, msg, exp, act in rules
    )
    key_sql = key_of_tariff("coalesce(tarif_daya, '')")
    return f"""{_TARIFF}, src as ({source}),
k as (select {keys}, {amount('stand_meter_awal')} as s, {amount('stand_meter_akhir')} as e, {amount('pemakaian_kwh')} as u,
 {amount('biaya_listrik')} as b, {key_sql} as tarif_key from src),
p as materialized (select * from k left join tariffs using (tarif_key)), flags as ({parts})"""


ORACLE["anomaly_rules"] = f"with {_flags(bills.DOCUMENT_SQL, 'doc_id')} select * from flags"
_LINES = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_orderkey as varchar) as stand_meter_awal,
 cast(l_orderkey + cast(l_quantity as bigint) * 10 - 3 as varchar) as stand_meter_akhir,
 cast(cast(l_quantity as bigint) * 10 as varchar) as pemakaian_kwh,
 'Rp ' || cast(cast(trunc(l_extendedprice) as bigint) * 5 as varchar) as biaya_listrik,
 case l_linenumber % 3 when 0 then 'R1-1300 VA' when 1 then 'r1m/900va' else 'P/1 W' end as tarif_daya from lineitem"""
ORACLE["anomaly_rules_lines"] = f"with {_flags(_LINES, 'l_orderkey, l_partkey, l_suppkey, l_linenumber')} select * from flags"
ORACLE["stream_rules"] = f"""
with {_flags(bills.DOCUMENT_SQL, 'doc_id')} select doc_id, cast(count(field) as int) as flags from src left join flags using (doc_id) group by doc_id"""


def _dev(d: str, m: str) -> str:
    v = f"case when coalesce({bare(d)}, '') = '' then 0 else {number(bare(d))} end"
    w = f"case when coalesce({bare(m)}, '') = '' then 0 else {number(bare(m))} end"
    return f"case when {v} is null or {w} is null then 0.5 when {w} = 0 then 0 else least(abs({v} - {w}) / ({w}), 1) end"


ORACLE["crosscheck_features"] = f"""
with {_MATCHED}, {_SUMMARY}, {_flags(bills.DOCUMENT_SQL, 'doc_id')},
counted as (select doc_id, count(*) as n from flags group by doc_id)
select doc_id, case when row_idx is not null then {half_even('total_match / 11.0', 3)} end as match_ratio,
 case when row_idx is not null then {half_even('name_s', 3)} end as name_similarity,
 case when row_idx is not null then {half_even('addr_s', 3)} end as address_similarity,
 case when row_idx is not null then {half_even(_dev('d_stand_meter_akhir', 'm_stand_meter_akhir'), 3)} end as meter_deviation,
 case when row_idx is not null then {half_even(_dev('d_biaya_listrik', 'm_biaya_listrik'), 3)} end as billing_deviation,
 case when row_idx is not null then cast(coalesce(n, 0) as int) end as anomaly_count,
 case when row_idx is not null then total_missing end as missing_fields
from j join sums using (doc_id) left join counted using (doc_id)"""
ORACLE["standardized"] = f"""
with s as (select avg(p_size) as m1, stddev_pop(p_size) as s1, avg(p_retailprice) as m2, stddev_pop(p_retailprice) as s2 from part)
select p_partkey, {half_even('(p_size - m1) / s1', 6)} as size, {half_even('(p_retailprice - m2) / s2', 6)} as price from part, s"""
ORACLE["isolation_share"] = """
select count(*) as n, count(*) filter (o_orderkey % 500 = 0) as planted, count(*) filter (o_orderkey % 500 = 0) as found from orders"""
ORACLE["anomaly_batch"] = f"""
with {_flags(bills.PLANTED_SQL, 'doc_id')} select doc_id, cast(count(field) as int) as flags, {_NUMBER} % 97 = 0 as planted, {_NUMBER} % 97 = 0 as found
from src left join flags using (doc_id) group by doc_id"""
ORACLE["crosscheck_report"] = f"""
with {_MATCHED}, {_flags(bills.DOCUMENT_SQL, 'doc_id')}
select 'detail' as name, count(*) as n from cells union all select 'summary', count(*) from d
union all select 'error_log', count(*) from cells where match_status = 'MISMATCH' union all select 'ml_scores', count(*) from d
union all select 'anomalies', count(*) from flags join best using (doc_id) where row_idx is not null"""

# --- models -----------------------------------------------------------------------------

ORACLE["confidence_train"] = f"""
with {_BEST}, h as (select substring(doc_id, 2)::bigint % 10 in (0, 4, 8) as faithful from best where row_idx is not null)
select 'samples' as metric, count(*)::double as value from h union all select 'valid_count', count(*)::double from h where faithful
union all select 'invalid_count', count(*)::double from h where not faithful"""
ORACLE["confidence_score"] = f"""
with {_BEST} select doc_id, row_idx is not null as scored, case when row_idx is not null then true end as fits from best"""
ORACLE["ordinal_onehot"] = """
with l as (select doc_id, lang, case when n_chars < 500 then 'low' when n_chars < 2000 then 'medium' else 'high' end as length_class from labels join documents using (doc_id))
select doc_id, length_class, cast(case length_class when 'low' then 0 when 'medium' then 1 else 2 end as double) as length_rank,
 cast(lang = 'de' as int) as lang_de, cast(lang = 'en' as int) as lang_en, cast(lang = 'es' as int) as lang_es, cast(lang = 'fr' as int) as lang_fr from l"""
ORACLE["stratified_split"] = """
with c as (select o_orderstatus, count(*) as n from orders group by 1),
k as (select o_orderstatus, n, cast(floor(0.6 * (n - 1)) as bigint) + 1 as a, cast(floor(0.8 * (n - 1)) as bigint) + 1 as b from c)
select o_orderstatus, 'train' as split, a as n from k union all select o_orderstatus, 'validate', b - a from k union all select o_orderstatus, 'test', n - b from k"""
_GUESS = "(select quality, cast(n_chars > 500 as int) as prediction from labels join documents using (doc_id))"
ORACLE["confusion"] = f"select quality as label, prediction, count(*) as n from {_GUESS} group by 1, 2"
ORACLE["recall"] = f"""
with c as (select count(*) filter (quality = 1 and prediction = 1) as tp, count(*) filter (quality = 1 and prediction <> 1) as fn from {_GUESS})
select tp as true_positives, fn as false_negatives, {half_even('tp / (tp + fn)', 4)} as recall from c"""

# --- player cleaning --------------------------------------------------------------------

_PLAYERS = """clean as (select distinct o_custkey as rank, 2000 + cast(trunc(o_totalprice / 500) as bigint) as rating, o_orderpriority as title,
 'C' || (o_custkey % 40) as country, cast(o_orderdate as date) as lastupdated
 from orders where o_orderkey % 17 <> 0 and o_orderkey % 19 <> 0 and o_orderkey % 5 <> 0)"""
ORACLE["players_clean"] = f"""
with {_PLAYERS} select *, case when rating >= 2800 then '2800+' when rating >= 2700 then '2700-2799' when rating >= 2600 then '2600-2699'
 when rating >= 2500 then '2500-2599' else 'Below 2500' end as rating_category from clean"""
for _by in ("title", "country"):
    ORACLE[f"players_by_{_by}"] = f"""
with {_PLAYERS} select {_by}, cast(round_even(cast(avg(rating) as double), 0) as int) as average_rating, count(rating) as player_count from clean group by {_by}"""
