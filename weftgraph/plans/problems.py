"""Queries of the general data problems p1 to p5, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import drift, error_parse, profile, references, skew
from weftgraph.session import read_table, shared_path, stored

NAME = "name:string:users"


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[error_parse.CellTable]]:
    """Raw lines, their files, and the tables of loaded cells with what is asked of them."""
    ends = {"c0": ("name", "string"), "c1": ("name", "string"), "c2": ("type", "string"), "c3": ("since", "string"), "c4": ("counter", "long")}
    tables = [
        error_parse.CellTable("nodes", read_table(spark, d, "nodes"), "row_id", {NAME: ("name", "string"), "age": ("age", "int"), "works_on": ("works_on", "string")}, checked=("age",)),
        error_parse.CellTable("rels", read_table(spark, d, "rels"), "row_id", ends, keys=("c0", "c1")),
    ]
    return read_table(spark, d, "raw_lines"), read_table(spark, d, "raw_files"), tables


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.failed_records(*_records(spark, d)).select("tbl", "row_key")


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with the rule that fails."""
    return error_parse.failed_records(*_records(spark, d)).select("tbl", "row_key", "rule")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every record of p1_found with its reason: the edits of a line, or what its cells or those of a row of nodes or rels aren't."""
    return error_parse.failed_records(*_records(spark, d)).select("tbl", "row_key", "file_no", "line_no", "rule", "cost", "cells", F.array_join("edits", "; ").alias("edits"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Every other record of the same tables as typed cells, with the load and the times that only rows of nodes and rels have."""
    return error_parse.loaded_records(*_records(spark, d), keep=("load_no", "loaded_at", "deleted_at"))


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """p1_loaded with a row for each cell."""
    each = p1_loaded(spark, d).select("tbl", "row_key", F.posexplode("cells").alias("position", "c"))
    return each.select("tbl", "row_key", "position", "c.field", "c.kind", "c.text", "c.whole", "c.real")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(read_table(spark, d, "rels"), [read_table(spark, d, t) for t in ("nodes", "nodes2")], NAME)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("row_id", "side")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(read_table(spark, d, "rels"), _orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rels = read_table(spark, d, "rels")
    return skew.dominant_keys(skew.salted_stats(rels, ["c0", "c2"], "c1", "load_no", distinct=False), rels.count())


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.salted_stats(read_table(spark, d, "rels"), ["c0", "c2"], "c1", "load_no").select("field_name", "key_value", "n_rows", "first_load", "last_load", "end_names")


def _measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and limits of the declared columns, of states that are kept in a folder of their own: no other run's are known here."""
    folder = shared_path(spark, "states")
    parts = [("nodes", [profile.AGE, profile.NAME]), ("rels", [profile.SINCE])]
    every = [profile.metrics(profile.History(spark, folder, t, checks).refresh(read_table(spark, d, t)).states()) for t, checks in parts]
    measured = every[0].unionByName(every[1])
    limits = [profile.limits_table(measured, t, checks) for t, checks in parts]
    return measured, limits[0].unionByName(limits[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.changes(*_measured(spark, d)).select("tbl", "field_name", F.col("load_no").cast("int").alias("load_no"), "measure_name")


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    # a mean whose seventh digit is a 5 and the last would be rounded up or down by the order in which its numbers are added: a billionth more settles it
    rounded = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("value", "centre", "deviation")]
    return profile.control_limits(_measured(spark, d)[0]).select("tbl", "field_name", "measure_name", "load_no", "n_before", "outside", *rounded)


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    nodes, rels = (profile.profile(read_table(spark, d, t), t, ("load_no",)) for t in ("nodes", "rels"))
    return nodes.unionByName(rels)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """What p4_profile has that is exact: counts, ranges and forms."""
    out = None
    for t in ("nodes", "rels"):
        table = read_table(spark, d, t)
        states = profile.scan_states(table, t, profile.checks_of(table, ("load_no",)), sketch=True)
        text = F.col("field_name").isin(*[f.name for f in table.schema if f.dataType.simpleString() == "string"])
        ranges = [F.when(text, F.col(c)).alias(c) for c in ("lowest", "highest")] + [f"{side}_{k}" for k in ("whole", "day", "time") for side in ("low", "high")]
        part = states.select("tbl", "field_name", "load_no", "n_rows", "n_blank", "n_good", *ranges, *profile.FORM_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """The control limits of p4_limits, whose SQL has three columns, for the measures of every column of p4_profile."""
    every = [profile.long_measures(profile.column_measures(read_table(spark, d, t), t, ("load_no",))) for t in ("nodes", "rels")]
    rounded = [F.round(c, 6).alias(c) for c in ("value", "centre", "deviation")]
    measured = stored(every[0].unionByName(every[1]), "measured")
    return profile.control_limits(measured).select("tbl", "field_name", "measure_name", "load_no", "n_before", "outside", *rounded)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, d, "raw_files"), read_table(spark, d, "raw_lines"))


def p5_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(drift.catalogue(drift.header_cells(read_table(spark, d, "raw_files"))))


def _all_nodes(spark: SparkSession, d: str, unread: bool) -> DataFrame:
    times = {"loaded_at": "loaded_at", "deleted_at": "deleted_at"}
    loaded = {
        "nodes": (read_table(spark, d, "nodes"), {NAME: "name", "age": "age", "works_on": "works_on", "load_no": "load_no"} | times),
        "nodes2": (read_table(spark, d, "nodes2"), {NAME: "name", "age": "age", "employer": "works_on"} | times),
    }
    # what the problems say of fields: names are texts, an age is an int whatever its header says
    return drift.one_table(read_table(spark, d, "raw_files"), read_table(spark, d, "raw_lines"), loaded, fixed={"name": "string", "age": "int"}, unread=unread)


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _all_nodes(spark, d, False)


def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the records in p5_nodes that aren't of their column's type and are null there."""
    return _all_nodes(spark, d, True).select("origin", "row_key", F.explode("unread").alias("u")).select("origin", "row_key", "u.column", "u.text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_rules, p1_reasons, p1_loaded, p1_cells, p2_found, p2_report, p3_found, p3_stats, p4_found, p4_limits, p4_profile, p4_counts, p4_columns, p5_found, p5_lifespans, p5_nodes, p5_unread)
}

_IS_KEY = "({c} is not null and not regexp_full_match({c}, ' *') and not regexp_matches({c}, '[\\x00-\\x1f\\x7f\\x{{fffd}}]') and (length({c}) - length(replace({c}, '\"', ''))) % 2 = 0)"
_INT = "(regexp_full_match({c}, '[+-]?[0-9]+') and try_cast({c} as {t}) is not null)"


def _key(c: str) -> str:
    return _IS_KEY.format(c=c)


_PARSE_SQL = r"""
recs as (
  select l.line_id, f.series, f.delim as dl, string_split(f.header, f.delim) as hd,
         case when l.line like '%' || chr(13) then left(l.line, length(l.line) - 1) else l.line end as rec
  from raw_lines l join raw_files f using (file_no)),
shaped as (
  select *, '(?s)(?:"(?:[^"\\]|\\.|"")*"|[^"' || dl || ']*)' as cell, case when dl = '|' then '\|' else dl end as de from recs),
whole as (
  select *, regexp_full_match(rec, cell || '(?:' || de || cell || ')*') as quoting_ok from shaped),
cut as (
  select *, regexp_extract_all(dl || rec, de || '(' || cell || ')', 1) as raw_cells from whole where quoting_ok),
typed as (
  select *, list_transform(raw_cells, lambda x: case when left(x, 1) = '"' then regexp_replace(x[2:-2], '(?s)\\(.)|"(")', '\1\2', 'g') else x end) as cells from cut),
checked as (
  select line_id, series, hd, cells, len(cells) = len(hd) or (series in ('nodes', 'nodes2') and len(cells) = len(hd) - 1) as count_ok,
         unnest(list_concat(list_transform(range(1, least(len(cells), len(hd)) + 1), lambda i: {'h': string_split(hd[i], ':')[1], 't': lower(coalesce(string_split(hd[i], ':')[2], '')), 'v': cells[i], 'i': i}), [{'h': '', 't': '', 'v': '', 'i': 0}])) as c
  from typed),
bad_lines as (
  select line_id from whole where not quoting_ok
  union
  select line_id from checked where not count_ok
  union
  select line_id from checked where c.v <> '' and (
    ((c.h = 'age' or c.t = 'int') and not """ + _INT.format(c="c.v", t="int") + r""") or
    (c.t = 'long' and not """ + _INT.format(c="c.v", t="bigint") + r""") or
    (c.t in ('double', 'float') and c.h <> 'age' and not regexp_full_match(c.v, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')))
  union
  select line_id from checked where series = 'rels' and c.i in (1, 2) and not """ + _key("c.v") + r""")
"""

_RULES = f"""
rules as (
  select line_id, 'quoting' as rule from whole where not quoting_ok
  union
  select line_id, case when count_ok then 'value' else 'count' end from checked where line_id in (select line_id from bad_lines)),
bad_rels as (select row_id from rels where not {_key('c0')} or not {_key('c1')}),
bad_nodes as (select row_id from nodes where age <> '' and not {_INT.format(c='age', t='int')})
"""
_REL_CELLS = "(select row_id, unnest([{'i': 0, 'f': 'name', 'k': 'string', 'v': c0}, {'i': 1, 'f': 'name', 'k': 'string', 'v': c1}, {'i': 2, 'f': 'type', 'k': 'string', 'v': c2}, {'i': 3, 'f': 'since', 'k': 'string', 'v': c3}, {'i': 4, 'f': 'counter', 'k': 'long', 'v': c4}]) as c from rels where row_id not in (select row_id from bad_rels))"
_NODE_CELLS = f"(select row_id, unnest([{{'i': 0, 'f': 'name', 'k': 'string', 'v': \"{NAME}\"}}, {{'i': 1, 'f': 'age', 'k': 'int', 'v': age}}, {{'i': 2, 'f': 'works_on', 'k': 'string', 'v': works_on}}]) as c from nodes where row_id not in (select row_id from bad_nodes))"
_LINE_CELLS = """(select line_id, unnest(list_transform(range(1, len(cells) + 1), lambda i: {'i': i - 1, 'f': string_split(hd[i], ':')[1],
  'k': case when string_split(hd[i], ':')[1] = 'age' then 'int' else coalesce(nullif(lower(string_split(hd[i], ':')[2]), ''), 'string') end, 'v': cells[i]})) as c from typed where line_id not in (select line_id from bad_lines))"""

_STANDING = f"""
refs as (
  select row_id, 'c0' as side, c0 as name, loaded_at from rels where {_key('c0')}
  union all select row_id, 'c1', c1, loaded_at from rels where {_key('c1')}),
parents as (
  select "{NAME}" as name, loaded_at, deleted_at from nodes union all select "{NAME}", loaded_at, deleted_at from nodes2),
missing as (
  select r.* from refs r where not exists (
    select 1 from parents p where p.name = r.name and p.loaded_at <= r.loaded_at and (p.deleted_at is null or p.deleted_at > r.loaded_at)))
"""

_WELL = {
    "age": _INT.format(c="v", t="int"),
    "name": r"regexp_full_match(v, '\p{Lu}[\p{L}''\-]*( \p{Lu}[\p{L}''\-]*)+')",
    "c3": "(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and v not like '0000%' and try_cast(v as date) is not null)",
}
_CELLS = f"""
cells as (
  select 'nodes' as tbl, 'age' as field_name, load_no, age as v, coalesce({_WELL['age'].replace('v,', 'age,').replace('v as', 'age as')}, false) as good, try_cast(age as int) as num, 0 as lo, 120 as hi from nodes
  union all
  select 'nodes', '{NAME}', load_no, v, coalesce({_WELL['name']}, false), length(v), null, null from (select load_no, "{NAME}" as v from nodes)
  union all
  select 'rels', 'c3', load_no, v, coalesce({_WELL['c3']}, false), year(try_cast(v as date)), 1950, 2025 from (select load_no, c3 as v from rels)),
states as (
  select tbl, field_name, load_no, count(*) as n, count(*) filter (v is null or v = '') as blank, count(*) filter (v <> '' and good) as good,
         count(*) filter (v <> '' and good and (lo is null or num between lo and hi)) as inside,
         sum(num) filter (v <> '' and good and (lo is null or num between lo and hi)) as total, count(distinct nullif(v, '')) as n_distinct
  from cells group by all),
measured as (
  select tbl, field_name, load_no, m.measure_name, m.value from (
    select *, unnest([{{'measure_name': 'null_rate', 'value': blank / n}}, {{'measure_name': 'bad_rate', 'value': (n - blank - good) / nullif(n - blank, 0)}},
                      {{'measure_name': 'out_rate', 'value': (good - inside) / nullif(good, 0)}}, {{'measure_name': 'mean', 'value': total / nullif(inside, 0)}},
                      {{'measure_name': 'distinct_rate', 'value': case when field_name = '{NAME}' then n_distinct / nullif(n - blank, 0) end}}]) as m from states)
  where m.value is not null)
"""

_FORM = {"whole": r"[+-]?[0-9]+", "real": r"[+-]?[0-9]*[.,][0-9]+", "day": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "name": r"\p{Lu}[\p{L}''\-]*( \p{Lu}[\p{L}''\-]*)+", "word": r"[\p{L}_]+", "spaces": r"[ \t\n\x0B\f\r]+"}
_FORM_CASE = "case " + " ".join(f"when regexp_full_match(v, '{f}') then '{n}'" for n, f in _FORM.items()) + " else 'other' end"


def _column_sql(tbl: str, column: str, good: str = "true", whole: str = "null::bigint", day: str = "null::date", time: str = "null::timestamp", text: bool = True) -> str:
    return f"""select '{tbl}' as tbl, '{column}' as field_name, load_no, v, {str(text).lower()} as is_text, coalesce(v <> '' and ({good}), false) as good, {whole} as w, {day} as dy, {time} as tm from (select *, "{column}"::varchar as v from {tbl})"""


_WHOLE_64 = "case when regexp_full_match(v, '[+-]?[0-9]+') then try_cast(v as bigint) end"
_COUNTS = "with cells as (" + " union all ".join(
    [
        *[_column_sql(t, "row_id", whole="row_id", text=False) for t in ("nodes", "rels")],
        *[_column_sql(t, c, time=c, text=False) for t, c in (("nodes", "loaded_at"), ("nodes", "deleted_at"), ("rels", "loaded_at"))],
        _column_sql("nodes", "age", _WELL["age"], "try_cast(v as int)"),
        _column_sql("nodes", NAME, _WELL["name"]),
        _column_sql("nodes", "works_on"),
        *[_column_sql("rels", c, _key("v")) for c in ("c0", "c1")],
        _column_sql("rels", "c2"),
        _column_sql("rels", "c3", _WELL["c3"], day="try_cast(v as date)"),
        _column_sql("rels", "c4", f"{_WHOLE_64} is not null", _WHOLE_64),
    ]
) + f"""), formed as (select *, case when v <> '' then {_FORM_CASE} end as form from cells)
select tbl, field_name, load_no, count(*) as n_rows, count(*) filter (v is null or v = '') as n_blank, count(*) filter (good) as n_good,
  case when any_value(is_text) then min(nullif(v, '')) end as lowest, case when any_value(is_text) then max(nullif(v, '')) end as highest,
  min(w) filter (good) as low_whole, max(w) filter (good) as high_whole, min(dy) filter (good) as low_day, max(dy) filter (good) as high_day, min(tm) filter (good) as low_time, max(tm) filter (good) as high_time,
  {', '.join(f"count(*) filter (form = '{n}') as form_{n}" for n in (*_FORM, 'other'))} from formed group by tbl, field_name, load_no"""

SQL: dict[str, str] = {
    "p1_found": "with " + _PARSE_SQL + f"""
select 'raw_lines' as tbl, line_id as row_key from bad_lines
union all select 'nodes', row_id from nodes where age <> '' and not {_INT.format(c='age', t='int')}
union all select 'rels', row_id from rels where not {_key('c0')} or not {_key('c1')}""",
    "p1_rules": "with " + _PARSE_SQL + "," + _RULES + """
select 'raw_lines' as tbl, line_id as row_key, rule from rules union all select 'nodes', row_id, 'value' from bad_nodes union all select 'rels', row_id, 'value' from bad_rels""",
    "p1_cells": "with " + _PARSE_SQL + "," + _RULES + f""",
cells_of(tbl, row_key, c) as (select 'raw_lines', line_id, c from {_LINE_CELLS} union all select 'nodes', row_id, c from {_NODE_CELLS} union all select 'rels', row_id, c from {_REL_CELLS})
select tbl, row_key, c.i as position, c.f as field, c.k as kind, nullif(c.v, '') as text, case when c.k in ('int', 'long') and {_INT.format(c='c.v', t='bigint')} then try_cast(c.v as bigint) end as whole,
  case when c.k in ('double', 'float') and regexp_full_match(c.v, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') then try_cast(c.v as double) end as "real" from cells_of""",
    "p2_found": f"with {_STANDING} select row_id, side from missing",
    "p2_report": f"""with {_STANDING},
n as (select side, strftime(loaded_at, '%Y-%m') as month, count(*) as n_refs from refs group by all),
m as (select side, strftime(loaded_at, '%Y-%m') as month, count(*) as n_orphans from missing group by all)
select 'rels' as tbl, n.side, n.month, n.n_refs, coalesce(m.n_orphans, 0) as n_orphans from n left join m on n.side = m.side and n.month is not distinct from m.month""",
    "p3_found": """with k as (select 'c0' as field_name, c0 as key_value from rels union all select 'c2', c2 from rels)
select field_name, key_value from k where key_value <> '' group by all having count(*) * 50 >= (select count(*) from rels)""",
    "p3_stats": """with k as (select 'c0' as field_name, c0 as key_value, c1, load_no from rels union all select 'c2', c2, c1, load_no from rels)
select field_name, key_value, count(*) as n_rows, min(load_no) as first_load, max(load_no) as last_load, count(distinct c1) as end_names from k where key_value <> '' group by field_name, key_value""",
    "p4_found": f"""with {_CELLS},
limits(tbl, field_name, measure_name, most) as (values ('nodes', 'age', 'null_rate', 0.06), ('nodes', 'age', 'bad_rate', 0.06), ('nodes', 'age', 'out_rate', 0.04), ('nodes', 'age', 'mean', 4),
  ('nodes', '{NAME}', 'null_rate', 0.06), ('nodes', '{NAME}', 'bad_rate', 0.06), ('nodes', '{NAME}', 'mean', 2), ('nodes', '{NAME}', 'distinct_rate', 0.06),
  ('rels', 'c3', 'null_rate', 0.06), ('rels', 'c3', 'bad_rate', 0.06), ('rels', 'c3', 'out_rate', 0.04), ('rels', 'c3', 'mean', 3))
select a.tbl, a.field_name, a.load_no, a.measure_name from measured a join measured b on a.tbl = b.tbl and a.field_name = b.field_name and a.measure_name = b.measure_name and a.load_no = b.load_no + 1
join limits l on a.tbl = l.tbl and a.field_name = l.field_name and a.measure_name = l.measure_name where abs(a.value - b.value) > l.most""",
    "p4_limits": f"""with {_CELLS},
h as (select a.tbl, a.field_name, a.measure_name, a.load_no, a.value, count(b.value) as n_before, avg(b.value) as centre, stddev_samp(b.value) as deviation
  from measured a left join measured b on a.tbl = b.tbl and a.field_name = b.field_name and a.measure_name = b.measure_name and b.load_no < a.load_no group by all)
select tbl, field_name, measure_name, load_no, n_before, coalesce(n_before >= 3 and abs(value - centre) > 3 * deviation + 1e-9, false) as outside, round(value + 1e-9, 6) as value, round(centre + 1e-9, 6) as centre, round(deviation + 1e-9, 6) as deviation from h""",
    "p4_counts": _COUNTS,
    "p5_unread": f"select 'nodes' as origin, row_id as row_key, 'age' as \"column\", age as text from nodes where age <> '' and not {_INT.format(c='age', t='int')}",
    "p5_lifespans": r"""with f as (select *, row_number() over (partition by series order by arrived_at, file_no) as seq from raw_files),
c as (select series, seq, string_split(unnest(string_split(header, delim)), ':') as p from f),
g as (select series, seq, p[1] as field, coalesce(nullif(lower(p[2]), ''), 'string') as t from c),
o as (select series, seq, field, array_to_string(list_sort(list_distinct(list(t))), ',') as type from g group by series, seq, field),
m as (select *, seq - row_number() over (partition by series, field, type order by seq) as island from o)
select series, field, type, min(seq) as first_seq, max(seq) as last_seq from m group by series, field, type, island""",
}
