"""Graph tables over the driver's tables, as SQL that Spark and DuckDB both run; every one reads whole tables.

Orders, customers, suppliers, parts, nations and regions are definitions; their keys are dotted names
below a module, and foreign keys and line items are references. So the graphs grow with the tables
and paths stay short.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "o": "concat('order.', {o}.o_orderpriority, '.', {o}.o_orderstatus)",
    "c": "concat('customer.', {c}.c_mktsegment)",
    "s": "concat('supplier.n', {s}.s_nationkey)",
    "p": "concat('part.', replace({p}.p_brand, '#', ''), '.', replace({p}.p_type, ' ', '_'))",
    "n": "concat('nation.r', {n}.n_regionkey)",
    "r": "'region'",
}
IDS = {"o": "o_orderkey", "c": "c_custkey", "s": "s_suppkey", "p": "p_partkey", "n": "n_nationkey", "r": "r_regionkey"}


def module_sql(t: str) -> str:
    return NAMES[t].replace("{" + t + "}", t)


def key_sql(t: str) -> str:
    return f"concat({module_sql(t)}, '.{t}', {t}.{IDS[t]})"


#: CTEs by name; {table} is a table of the driver. Later ones use earlier ones.
CTES = {
    "defs": f"""
  select {key_sql('o')} as key, {module_sql('o')} as module, concat('o', o.o_orderkey) as short,
    case o.o_orderstatus when 'O' then 'P' when 'P' then 'H' else 'D' end as state, 'function' as kind,
    cast(o.o_orderkey as bigint) as line, false as ignorable, false as where_helper, cast(2 as bigint) as arity from {{orders}} o
  union all select {key_sql('c')}, {module_sql('c')}, concat('c', c.c_custkey), 'D', 'datatype', cast(c.c_custkey as bigint), c.c_acctbal < 0, false, cast(1 as bigint) from {{customer}} c
  union all select {key_sql('s')}, {module_sql('s')}, concat('s', s.s_suppkey), 'D', 'record', cast(s.s_suppkey as bigint), s.s_acctbal < 2000, s.s_acctbal > 5000, cast(3 as bigint) from {{supplier}} s
  union all select {key_sql('p')}, {module_sql('p')}, concat('p', p.p_partkey), case when p.p_size > 40 then 'P' when p.p_size > 35 then 'H' else 'D' end, 'constructor', cast(p.p_partkey as bigint), false, p.p_size < 10, cast(p.p_size as bigint) from {{part}} p
  union all select {key_sql('n')}, {module_sql('n')}, concat('n', n.n_nationkey), 'P', 'postulate', cast(n.n_nationkey as bigint), false, false, cast(0 as bigint) from {{nation}} n
  union all select {key_sql('r')}, {module_sql('r')}, concat('r', r.r_regionkey), 'D', 'primitive', cast(r.r_regionkey as bigint), false, false, cast(0 as bigint) from {{region}} r""",
    "refs": f"""
  select {key_sql('o')} as src, {key_sql('c')} as dst, true as in_signature, false as in_body from {{orders}} o join {{customer}} c on o.o_custkey = c.c_custkey
  union all select {key_sql('o')}, {key_sql('p')}, bool_or(l.l_linenumber = 1), bool_or(l.l_linenumber > 2) from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey join {{part}} p on l.l_partkey = p.p_partkey group by 1, 2
  union all select {key_sql('o')}, {key_sql('s')}, false, bool_or(l.l_returnflag = 'R') from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey join {{supplier}} s on l.l_suppkey = s.s_suppkey group by 1, 2
  union all select {key_sql('c')}, {key_sql('n')}, true, true from {{customer}} c join {{nation}} n on c.c_nationkey = n.n_nationkey
  union all select {key_sql('c')}, {key_sql('r')}, false, true from {{customer}} c join {{nation}} n on c.c_nationkey = n.n_nationkey join {{region}} r on n.n_regionkey = r.r_regionkey
  union all select {key_sql('s')}, {key_sql('n')}, false, true from {{supplier}} s join {{nation}} n on s.s_nationkey = n.n_nationkey
  union all select {key_sql('n')}, {key_sql('r')}, false, false from {{nation}} n join {{region}} r on n.n_regionkey = r.r_regionkey""",
    "edges": """
  select refs.src, refs.dst, case when in_signature then 'signature' when coalesce(where_helper, false) then 'module-local' when in_body then 'body' else 'unknown' end as prov
  from refs left join defs on refs.dst = defs.key""",
    "imports": f"""
  select distinct {module_sql('s')} as src, {module_sql('p')} as dst from {{lineitem}} l join {{supplier}} s on l.l_suppkey = s.s_suppkey join {{part}} p on l.l_partkey = p.p_partkey""",
    "medges": """
  select distinct a.module as src, b.module as dst from edges join defs a on edges.src = a.key join defs b on edges.dst = b.key where a.module <> b.module
  union select src, dst from imports where src <> dst""",
    "mods": "select distinct module from defs union select src from imports union select dst from imports",
    # uses of a part or supplier by an order, with the quantity as the number of arguments applied
    "applied": f"""
  select {key_sql('o')} as src, {key_sql('p')} as dst, cast(l.l_quantity as bigint) as applied from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey join {{part}} p on l.l_partkey = p.p_partkey""",
    # a supplier provides for the parts it delivers
    "provides": f"""
  select distinct {key_sql('p')} as method_key, {key_sql('s')} as binder_key from {{lineitem}} l join {{supplier}} s on l.l_suppkey = s.s_suppkey join {{part}} p on l.l_partkey = p.p_partkey where l.l_returnflag = 'R'""",
    # one file per supplier: a comment, its module, and an import for each kind of part it delivers
    "source_lines": f"""
  select concat('src/', {module_sql('s')}, '/s', s.s_suppkey, '.agda') as file, cast(1 as bigint) as line_no, concat('-- module hidden.s', s.s_suppkey, ' import nothing') as text from {{supplier}} s
  union all select concat('src/', {module_sql('s')}, '/s', s.s_suppkey, '.agda'), cast(2 as bigint), case when s.s_acctbal < 0 then 'module _ where' else concat('module ', {module_sql('s')}, '.s', s.s_suppkey, ';x where') end from {{supplier}} s
  union all select concat('src/', {module_sql('s')}, '/s', s.s_suppkey, '.agda'), cast(3 as bigint), concat('module other.s', s.s_suppkey, ' where') from {{supplier}} s
  union all select concat('src/', {module_sql('s')}, '/s', s.s_suppkey, '.agda'), cast(10 + p.p_size as bigint), concat(case when min(l.l_linenumber) = 1 then '  open import ' else 'import ' end, {module_sql('p')}, ' using (x) -- import no') from {{lineitem}} l join {{supplier}} s on l.l_suppkey = s.s_suppkey join {{part}} p on l.l_partkey = p.p_partkey group by s.s_nationkey, s.s_suppkey, p.p_size, {module_sql('p')}""",
    "files": "select module, concat(case when length(module) > 16 then 'lib/' else 'proj/src/' end, replace(module, '.', '/'), '.agda') as file from mods",
    # lines as positions of arguments; (order, line) repeats, so each takes the least of its rows
    "positions": """
  select concat('o', l_orderkey) as key, cast(l_linenumber - 1 as bigint) as pos, case when min(l_quantity) <= 30 then 'Unused' else 'Mixed' end as occurrence,
    case when min(l_discount) <= 0.06 then 'Nonvariant' else 'Covariant' end as polarity, min(l_tax) <= 0.03 as hidden, min(l_suppkey) as s, min(l_partkey) as p, min(l_extendedprice) as x
  from {lineitem} group by l_orderkey, l_linenumber""",
    "free": """
  select a.key as key, 'syntactic' as view, a.pos as pos, b.pos as in_domain from positions a join positions b on a.key = b.key and a.pos < b.pos where a.s < b.s
  union all select a.key, 'reduced', a.pos, b.pos from positions a join positions b on a.key = b.key and a.pos < b.pos where a.s < b.s and a.p < b.p
  union all select key, 'syntactic', pos, cast(null as bigint) from positions where x > 45000
  union all select key, 'reduced', pos, cast(null as bigint) from positions where x > 47000""",
    # a tree per order: lines below it, and the brand and the supplier's nation below each line
    "terms": """
  select o_orderkey as tree, cast(0 as bigint) as node, cast(null as bigint) as parent, cast(0 as bigint) as ord, 'app' as tag, o_orderpriority as name from {orders}
  union all select l_orderkey, cast(l_linenumber as bigint), cast(0 as bigint), cast(l_linenumber as bigint), 'def', min(l_returnflag) from {lineitem} group by l_orderkey, l_linenumber
  union all select l_orderkey, cast(100 * l_linenumber as bigint), cast(l_linenumber as bigint), cast(0 as bigint), 'con', min(p_brand) from {lineitem} join {part} on l_partkey = p_partkey group by l_orderkey, l_linenumber
  union all select l_orderkey, cast(100 * l_linenumber + 1 as bigint), cast(l_linenumber as bigint), cast(1 as bigint), 'var', min(n_name) from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey group by l_orderkey, l_linenumber""",
    # an event is a span of its user's file, as long as its value
    "event_spans": "select concat('u', user_id) as file, event_id as lo, event_id + 1 + greatest(cast(floor(coalesce(value, 0)) as bigint), 0) as hi, event_type from {events}",
}

NEEDS = {"edges": ["refs", "defs"], "medges": ["edges", "imports"], "mods": ["defs", "imports"], "files": ["mods"], "free": ["positions"]}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def wanted(names: list[str]) -> list[str]:
    """names and what they need, in order of definition."""
    need: set[str] = set()

    def add(n: str) -> None:
        if n not in need:
            need.add(n)
            for m in NEEDS.get(n, []):
                add(m)

    for n in names:
        add(n)
    return [n for n in CTES if n in need]


def with_ctes(names: list[str], rest: str, recursive: bool = False) -> str:
    """rest with the named CTEs before it; rest is a select, or further CTEs and a select."""
    ctes = ",\n".join(f"{n} as ({CTES[n]})" for n in wanted(names))
    more = not re.match(r"\s*select\b", rest, re.IGNORECASE)
    if not ctes:
        return f"with {'recursive ' if recursive else ''}{rest}" if more else rest
    return f"with {'recursive ' if recursive else ''}{ctes}{',' if more else ''}\n{rest}"


def duck(names: list[str], rest: str, recursive: bool = False) -> str:
    """The same for DuckDB, where tables are views of their own names."""
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", with_ctes(names, rest, recursive))


class Bindings:
    """The CTEs as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CTES:
            raise AttributeError(name)
        return self.sql([name], f"select * from {name}")

    def sql(self, names: list[str], rest: str) -> DataFrame:
        text = with_ctes(names, rest)
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})
