"""The queries: each applies operators to the bound tables; its SQL says the same for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import names, text
from weftgraph.operators import argusage, edges, evidence, filters, fixpoint, indexes, layout, representations, rollups, terms, trees
from weftgraph.sources import scan
from weftgraph.sources.bindings import CTES, Bindings, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The prefix that exclusions use, the root of the project, and where searches begin.
EXCLUDED, ROOT, ENTRY = "part.Brand1", "proj", "order.1-URGENT.F"


def query(needs: list[str], sql: str, recursive: bool = False):
    def register(f: Callable[[Bindings], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Bindings(spark, sf_dir))
            return out.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        run.__name__ = run.__qualname__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = duck(needs, sql, recursive)
        return run

    return register


# ---- scans


HEADERS = r"""
tok as (select file, line_no, string_split(trim(regexp_replace(regexp_replace(text, '--.*$', ''), '\s+', ' ', 'g')), ' ') as w from source_lines),
named as (select file, line_no, case when w[1] = 'module' then 'module' when w[1] = 'import' or (w[1] = 'open' and w[2] = 'import') then 'import' end as kind,
  regexp_extract(case when w[1] = 'open' then w[3] else w[2] end, '^[._''\-\p{L}\p{N}]*') as name from tok),
hit as (select * from named where kind is not null and name <> ''),
mods as (select file, arg_min(name, line_no) as m from hit where kind = 'module' group by file),
hd as (select file, case when m = '_' then regexp_extract(file, '([^/]*)\.[^/.]*$', 1) else m end as module from mods)"""


@query(["source_lines"], HEADERS + r""",
imps as (select file, string_agg(distinct name, ',' order by name) as i from hit where kind = 'import' group by file)
select hd.file, hd.module, coalesce(i, '') as imports from hd left join imps on hd.file = imps.file""")
def scan_module_headers(b):
    return scan.headers(b.source_lines).select("file", "module", F.array_join("imports", ",").alias("imports"))


@query([], r"select conv_id, turn, concat(role, role, ' -}') as text, count(*) as n from conversations group by all")
def scan_strip_block_comments(b):
    plain = F.translate(F.coalesce("text", F.lit("")), "{}", "")
    nested = F.concat(F.col("role"), F.lit("{- "), plain, F.lit(" {- nested -} -}"), F.col("role"), F.lit(" -}"))
    return b.table("conversations").select("conv_id", "turn", text.without_block_comments(nested).alias("text")).groupBy("conv_id", "turn", "text").agg(F.count("*").alias("n"))


@query([], r"""select distinct regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as dst from pages""")
def scan_link_imports(b):
    return scan.link_imports(b.table("pages"))


@query(["source_lines"], HEADERS + r"""
select 'module' as kind, module as name, min(file) as value from hd group by module
union all select distinct 'import', hd.module, hit.name from hit join hd on hit.file = hd.file where hit.kind = 'import' and hd.module <> hit.name
union all select distinct 'file', file, '' from source_lines""")
def scan_sources(b):
    modules, imports, files = scan.scan_sources(b.source_lines)
    out = modules.select(F.lit("module").alias("kind"), F.col("module").alias("name"), F.col("file").alias("value"))
    return out.unionByName(imports.select(F.lit("import").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("value"))).unionByName(files.select(F.lit("file").alias("kind"), F.col("file").alias("name"), F.lit("").alias("value")))


# folders of the modules' files, with links that lead back, aliases, and hidden ones
FOLDERS = """
pieces as (select module, string_split(file, '/') as seg from files),
tree as (select distinct array_to_string(seg[1:k], '/') as folder, seg[k + 1] as name, array_to_string(seg[1:k + 1], '/') as target, k + 1 < len(seg) as is_dir from pieces, unnest(range(1, len(seg))) t(k)),
dirs as (select distinct folder from tree),
entries as materialized (select * from tree
  union all select folder, 'a loop', 'proj/src', true from dirs where folder like 'proj/src/%'
  union all select folder, 'b-alias', 'lib', true from dirs where folder like 'proj/src/s%'
  union all select folder, 'c-alias', replace(folder, 'lib/', 'proj/src/'), true from dirs where folder like 'lib/%' and replace(folder, 'lib/', 'proj/src/') in (select folder from dirs)
  union all select folder, '.hidden', 'secret', true from dirs
  union all select distinct 'secret', 'S' || seg[3], '', false from pieces)"""


def _folders(b):
    seg, files = F.split("file", "/"), fixpoint.settled(b.files)
    each = files.select(seg.alias("seg"), F.explode(F.sequence(F.lit(1), F.size(seg) - 1)).alias("k"))
    path = lambda n: F.array_join(F.slice("seg", 1, n), "/")
    tree = each.select(path(F.col("k")).alias("folder"), F.element_at("seg", F.col("k") + 1).alias("name"), path(F.col("k") + 1).alias("target"), (F.col("k") + 1 < F.size("seg")).alias("is_dir")).distinct()
    dirs = tree.select("folder").distinct()
    other = F.replace("folder", F.lit("lib/"), F.lit("proj/src/"))
    link = lambda df, name, target: df.select("folder", F.lit(name).alias("name"), target.alias("target"), F.lit(True).alias("is_dir"))
    twins = dirs.where("folder like 'lib/%'").withColumn("other", other).join(dirs.select(F.col("folder").alias("other")), "other", "left_semi")
    out = tree.unionByName(link(dirs.where("folder like 'proj/src/%'"), "a loop", F.lit("proj/src"))).unionByName(link(dirs.where("folder like 'proj/src/s%'"), "b-alias", F.lit("lib")))
    out = out.unionByName(link(twins, "c-alias", F.col("other"))).unionByName(link(dirs, ".hidden", F.lit("secret")))
    return fixpoint.settled(out.unionByName(files.select(F.lit("secret").alias("folder"), F.concat(F.lit("S"), seg[2]).alias("name"), F.lit("").alias("target"), F.lit(False).alias("is_dir")).distinct()))


@query(["files"], f"""{FOLDERS},
walk as (select 0 as ord, 'proj' as folder, 'proj' as path, []::varchar[] as steps, ['proj'] as been union all select 1, 'lib', 'lib', [], ['lib'] union all select 2, 'gone', 'gone', [], ['gone']
  union all select w.ord, e.target, w.path || '/' || e.name, list_append(w.steps, e.name), list_append(w.been, e.target) from walk w join entries e on e.folder = w.folder where e.is_dir and e.name not like '.%' and not list_contains(w.been, e.target)),
best as (select folder, arg_min(path, struct_pack(o := ord, n := len(steps), s := steps)) as path, min(ord) as ord from walk group by folder)
select best.ord::bigint as ord, best.path || '/' || e.name as file from best join entries e on e.folder = best.folder where not e.is_dir and e.name not like '.%'""", True)
def scan_discovery(b):
    """Source files below three roots, the last of which isn't there; links lead back, and from one root into the other."""
    entries = _folders(b)
    return scan.discovered(b.spark, [(r, r) for r in ("proj", "lib", "gone")], lambda folders: entries.join(folders.select("folder"), "folder", "left_semi")).select("ord", "file")


# ---- filters and names


@query(["defs"], f"select key, module from defs where not (module = '{EXCLUDED}' or module like '{EXCLUDED}.%')")
def exclude_module_prefix(b):
    return filters.excluded(b.defs, b.spark.createDataFrame([(EXCLUDED,)], "prefix string")).select("key", "module")


@query(["defs"], """
select concat(module, '._.', short) as raw, array_to_string(list_filter(string_split(concat(module, '._.', short), '.'), lambda x: x <> '_'), '.') as lifted,
  concat(array_to_string(list_filter(string_split(concat(module, '._.', short), '.'), lambda x: x <> '_'), '.'), '@', line) as node_key, short as short_name from defs""")
def lift_anonymous_names(b):
    raw = F.concat("module", F.lit("._."), "short")
    return b.defs.select(raw.alias("raw"), names.lifted(raw).alias("lifted"), names.node_key(raw, F.col("line")).alias("node_key"), names.short_name(raw).alias("short_name"))


@query(["defs", "provides"], """
select p.method_key as constructor, coalesce(d.key, p.binder_key) || '.' || c.short as key from provides p join defs c on p.method_key = c.key left join defs d on p.binder_key = d.key and not d.ignorable""")
def constructor_owner_key(b):
    own = b.defs.where("not ignorable").select(F.col("key").alias("owner"))
    short = b.defs.select(F.col("key").alias("method_key"), "short")
    return b.provides.join(short, "method_key").join(own, F.col("binder_key") == F.col("owner"), "left").select(F.col("method_key").alias("constructor"), F.concat(F.coalesce("owner", "binder_key"), F.lit("."), "short").alias("key"))


RAW = """raw as (select key, kind, state, line, ignorable, case when line % 101 = 0 then concat(module, '..', short) when line % 103 = 0 then concat(module, '.GeneralizeTel', short) when line % 107 = 0 then concat(module, '.generalizedField-', short) when kind = 'postulate' and line = 7 then 'Agda.Primitive.Level' else key end as raw_name,
  case when kind = 'postulate' then 'axiom' when kind = 'datatype' and line % 11 = 0 then 'primitive-sort' when kind = 'datatype' and line % 13 = 0 then 'signature-only' when kind = 'datatype' and line % 17 = 0 then 'generalizable' else kind end as tag from defs)"""


@query(["defs"], f"""{RAW}
select key from raw where not (ignorable or raw_name like '%..%' or regexp_matches(raw_name, '(GeneralizeTel|generalizedField-)[^.]*$')
  or (tag = 'function' and (state = 'H' or line % 19 = 0 or line % 23 = 0 or line % 29 = 0)) or (tag = 'primitive' and line % 2 = 1) or (tag = 'axiom' and raw_name = 'Agda.Primitive.Level') or tag in ('primitive-sort', 'signature-only', 'generalizable'))""")
def ignorable_filter(b):
    d = b.sql(["defs"], f"{RAW} select * from raw")
    every = lambda n: F.col("line") % n == 0
    d = d.select("key", "raw_name", "tag", F.col("ignorable").alias("is_copy"), (F.col("state") == "H").alias("is_inline"), every(19).alias("is_pattern_lambda"), every(23).alias("is_with_function"), every(29).alias("is_kan_operation"), every(2).alias("has_clauses"))
    return d.where(~filters.is_ignorable(d)).select("key")


@query(["defs", "refs"], """
m as (select src as key, count(distinct case when in_body then dst end) as open, bool_or(dst like 'unsolved#meta.%') as marked from refs group by src)
select defs.key, case when kind = 'function' and where_helper then 'projection' when kind = 'postulate' then 'postulate' else kind end as kind,
  case when defs.key like 'unsolved#meta.%' then 'H' when kind = 'postulate' then 'P' when coalesce(marked, false) or coalesce(open, 0) > 5 then 'H' else 'D' end as state, coalesce(open, 0) as metas
from defs left join m on defs.key = m.key""")
def classify_kind_state(b):
    m = b.refs.groupBy(F.col("src").alias("key")).agg(F.count_distinct(F.when(F.col("in_body"), F.col("dst"))).alias("open"), F.bool_or(F.col("dst").startswith(filters.UNSOLVED)).alias("marked"))
    tag = F.when(F.col("kind") == "postulate", "axiom").otherwise(F.col("kind"))
    metas = F.coalesce("open", F.lit(0))
    state = filters.state_of(F.col("key"), F.col("kind") == "postulate", F.coalesce("marked", F.lit(False)), F.greatest(metas - 5, F.lit(0)))
    return b.defs.join(m, "key", "left").select("key", filters.kind_of(tag, F.col("where_helper")).alias("kind"), state.alias("state"), metas.alias("metas"))


@query(["defs"], """
select key, concat_ws(',', case when arity > 30 then 'non-terminating' end, case when state = 'P' then 'trustme' end) as tags,
  (case when arity > 30 then 1 else 0 end + case when state = 'P' then 2 else 0 end)::bigint as bits from defs""")
def unsafe_tags_bitmask(b):
    tags = filters.unsafe_tags(F.col("arity") > 30, F.col("state") == "P")
    return b.defs.select("key", F.array_join(tags, ",").alias("tags"), filters.unsafe_bits(tags).cast("long").alias("bits"))


FLAGS = {"HIDDEN": ("state = 'H'", "--rewriting"), "POSTULATED": ("state = 'P'", "--allow-unsolved-metas"), "LARGE": ("arity > 45", "--type-in-type"), "SAFE": ("arity < 2", "--safe")}


@query(["defs"], """
f as (select module, unnest([case when state = 'H' then '--rewriting' end, case when state = 'P' then '--allow-unsolved-metas' end, case when arity > 45 then '--type-in-type' end]) as flag from defs)
select module, string_agg(distinct flag, ',' order by flag) as flags from f where flag is not null group by module""")
def option_flag_intersect(b):
    tokens = b.defs.select("module", F.explode(F.array(*[F.when(F.expr(c), F.lit(f)) for c, f in FLAGS.values()])).alias("flag")).where("flag is not null")
    each = tokens.groupBy("module").agg(F.collect_set("flag").alias("tokens")).select("module", F.explode(filters.option_escapes(F.col("tokens"))).alias("flag"))
    return rollups.flag_rollup(each).select("module", F.array_join("flags", ",").alias("flags"))


SIGNALS = "signals as (select module, file like 'proj/%' as in_root from files union all select module, kind = 'datatype' from defs union all select dst, false from imports)"


def _external(b):
    signals = b.files.select("module", names.under(F.col("file"), F.lit(ROOT)).alias("in_root")).unionByName(b.defs.select("module", (F.col("kind") == "datatype").alias("in_root"))).unionByName(b.imports.select(F.col("dst").alias("module"), F.lit(False).alias("in_root")))
    return filters.external_modules(signals)


EXTERNAL = f"{SIGNALS}, ext as (select module from signals group by module having not bool_or(in_root))"


@query(["files", "defs", "imports"], f"{EXTERNAL} select module from ext")
def external_modules(b):
    return _external(b)


@query(["files", "imports"], """
scanned as (select module, file from files where right(module, 2) <> '.O')
select module from scanned where not file like 'proj/%' union select dst from imports where dst not in (select module from scanned)""")
def external_modules_scan(b):
    return filters.external_scanned(b.files.where(~F.col("module").endswith(".O")), b.imports, ROOT)


@query(["files", "defs", "imports", "refs"], f"""{EXTERNAL}, gone as (select key from defs join ext on defs.module = ext.module)
select src, dst from refs where src not in (select key from gone) and dst not in (select key from gone)""")
def drop_externals(b):
    return filters.without_externals(b.defs, b.refs, _external(b))[1].select("src", "dst")


@query(["files", "defs", "imports"], f"""{EXTERNAL}
select ext.module, coalesce(string_agg(distinct case when state = 'P' then short end, ',' order by case when state = 'P' then short end), '') as postulates from ext left join defs on ext.module = defs.module group by ext.module""")
def externals_summary(b):
    return rollups.externals_summary(b.defs, _external(b)).select("module", F.array_join("postulates", ",").alias("postulates"))


@query(["files"], "select file, string_split(file, '/')[1] = 'proj' as inside from files")
def path_containment(b):
    return b.files.select("file", names.under(F.col("file"), F.lit(ROOT)).alias("inside"))


@query(["files"], """
v as (select file, unnest([replace(file, '/src/', '/src/../src/./'), replace(file, 'lib/', 'proj/../lib/'), 'proj/src/../../' || file, '../' || file, '/../proj//x/' || file]) as path from files),
s as (select path, list_reduce(list_prepend([]::varchar[], list_transform(string_split(path, '/'), lambda x: [x])), lambda a, x: case when x[1] in ('', '.') then a when x[1] <> '..' then list_append(a, x[1]) when len(a) > 0 and a[-1] <> '..' then a[1:len(a) - 1] when path like '/%' then a else list_append(a, '..') end) as seg from (select distinct path from v))
select path, (case when path like '/%' then '/' else '' end) || array_to_string(seg, '/') as plain, path not like '/%' and seg[1] = 'proj' as inside from s""")
def path_containment_normalised(b):
    """Whether paths with dots in them lie in the project."""
    f = F.col("file")
    ways = F.array(F.replace(f, F.lit("/src/"), F.lit("/src/../src/./")), F.replace(f, F.lit("lib/"), F.lit("proj/../lib/")), F.concat(F.lit("proj/src/../../"), f), F.concat(F.lit("../"), f), F.concat(F.lit("/../proj//x/"), f))
    paths = b.files.select(F.explode(ways).alias("path")).distinct()
    return paths.select("path", names.normalised(F.col("path")).alias("plain"), names.inside(F.col("path"), F.lit(f"./{ROOT}/")).alias("inside"))


# ---- edges


@query(["edges"], "select src, dst, prov from edges")
def edge_provenance(b):
    return edges.tagged_edges(b.refs, b.defs)


CLOSED = """
hid as (select key from defs where ignorable),
walk as (select h.key as src, h.key as mid from hid h union select walk.src, e.dst from walk join edges e on e.src = walk.mid join hid on hid.key = e.dst),
clo as (select distinct walk.src, e.dst from walk join edges e on e.src = walk.mid where e.dst not in (select key from hid))"""


@query(["defs", "edges"], f"{CLOSED} select src, dst from clo", True)
def ignored_closure(b):
    return edges.ignored_closure(b.edges, b.defs.where("ignorable"))


@query(["defs", "edges"], f"""{CLOSED},
kept as (select * from edges where src not in (select key from hid)),
allp as (select src, dst, prov from kept where dst not in (select key from hid) union all select kept.src, clo.dst, kept.prov from kept join clo on kept.dst = clo.src)
select src, dst, arg_max(prov, case prov when 'signature' then 4 when 'module-local' then 2 when 'body' then 1 else 0 end) as prov from allp group by src, dst""", True)
def contract_edges(b):
    return edges.contracted(b.edges, b.defs.where("ignorable"))


HIDING = "customer.BUILDING"


@query(["defs", "edges"], f"""gone as (select key from defs where module = '{HIDING}' or module like '{HIDING}.%'),
hid as (select key from defs where ignorable),
raw as (select * from edges where dst not in (select key from gone)),
walk as (select h.key as src, h.key as mid from hid h union select walk.src, e.dst from walk join raw e on e.src = walk.mid join hid on hid.key = e.dst),
clo as (select distinct walk.src, e.dst from walk join raw e on e.src = walk.mid where e.dst not in (select key from hid)),
kept as (select * from raw where src not in (select key from hid)),
allp as (select src, dst, prov from kept where dst not in (select key from hid) union all select kept.src, clo.dst, kept.prov from kept join clo on kept.dst = clo.src)
select src, dst, arg_max(prov, case prov when 'signature' then 4 when 'module-local' then 2 when 'body' then 1 else 0 end) as prov from allp group by src, dst""", True)
def exclude_before_contract(b):
    """No edge leads through a definition of an excluded module, though it is ignorable and would be contracted."""
    raw = filters.references_to_kept(b.edges, b.defs, b.spark.createDataFrame([(HIDING,)], "prefix string"))
    return edges.contracted(raw, b.defs.where("ignorable"))


@query(["edges", "provides"], """
more as (select distinct e.src, p.binder_key as dst from edges e join provides p on e.dst = p.method_key)
select src, dst, prov from edges union all select m.src, m.dst, 'unknown' from more m where not exists (select 1 from edges e where e.src = m.src and e.dst = m.dst)""")
def instance_provider_edges(b):
    return edges.with_providers(b.edges, b.provides)


@query(["defs", "applied"], """
least as (select src, dst, min(applied) as a from applied group by src, dst),
hit as (select distinct dst from least join defs on defs.key = least.dst where a < arity)
select key, key in (select dst from hit) as partially_applied from defs""")
def partially_applied(b):
    return edges.partially_applied(b.applied, b.defs)


@query(["defs", "edges"], """
k as (select key from defs where not ignorable union select dst from edges)
select k.key, coalesce(d.state, 'D') as state, coalesce(d.kind, 'other') as kind from k left join (select * from defs where not ignorable) d on k.key = d.key""")
def collect_nodes(b):
    return edges.collected_nodes(b.defs.where("not ignorable"), b.edges)


@query(["defs", "imports"], "select module from defs union select src from imports union select dst from imports union select 'Entry' union select 'Broken'")
def module_node_set(b):
    extra = b.spark.createDataFrame([("Entry",), ("Broken",)], "module string")
    return edges.module_nodes(b.defs, b.imports, extra)


@query(["medges"], "select src, dst from medges")
def module_edges(b):
    return edges.module_edges(b.edges, b.defs, b.imports)


@query(["provides", "defs"], """
r as (select h.module as host, d.module as source, d.short as name, case when d.where_helper then concat('my', d.short) end as alias from provides p join defs h on p.binder_key = h.key join defs d on p.method_key = d.key)
select host, source, string_agg(distinct coalesce(alias, name), ',' order by coalesce(alias, name)) as names, coalesce(array_to_string(list_transform(list_sort(list(distinct {'a': alias, 'n': name}) filter (alias is not null)), lambda x: x.a || '=' || x.n), ','), '') as renames
from r where host <> source group by host, source""")
def reexports_grouped(b):
    at = b.defs.select("key", "module", "short", "where_helper")
    rows = b.provides.join(at.select(F.col("key").alias("binder_key"), F.col("module").alias("host")), "binder_key").join(at.withColumnRenamed("key", "method_key"), "method_key")
    rows = rows.select("host", F.col("module").alias("source"), F.col("short").alias("name"), F.when(F.col("where_helper"), F.concat(F.lit("my"), "short")).alias("alias"))
    out = edges.reexports(rows)
    return out.select("host", "source", F.array_join("names", ",").alias("names"), F.array_join(F.transform("renames", lambda r: F.concat(r["alias"], F.lit("="), r["name"])), ",").alias("renames"))


@query(["defs", "refs"], "select d.key from defs d where not exists (select 1 from refs r where r.dst = d.key)")
def dead_private_definitions(b):
    return edges.dead_private(b.defs.select("key"), b.refs.select(F.col("dst").alias("key")))


# ---- graph algorithms

REACH = "clo as (select distinct src, dst from {e} union select clo.src, e.dst from clo join {e} e on e.src = clo.dst)"


@query(["refs"], REACH.format(e="refs") + " select src, dst from clo", True)
def reachability(b):
    return fixpoint.closure(b.refs)


TRANS = "select distinct e1.src, e1.dst from {e} e1 join {e} e2 on e1.src = e2.src and e2.dst <> e1.dst join clo on clo.src = e2.dst and clo.dst = e1.dst"


@query(["medges"], REACH.format(e="medges") + " " + TRANS.format(e="medges"), True)
def transitive_module_edges(b):
    return fixpoint.transitive_edges(b.medges)


@query(["edges"], REACH.format(e="edges") + " " + TRANS.format(e="edges"), True)
def transitive_def_edges(b):
    return fixpoint.transitive_edges(b.edges)


@query(["mods", "medges"], f"""
walk as (select '{ENTRY}' as node, 0 as depth union select e.dst, walk.depth + 1 from walk join medges e on e.src = walk.node),
best as (select node, min(depth) as depth from walk group by node)
select m.module, coalesce(b.depth, -1)::bigint as depth, (select count(*) from medges e where e.dst = m.module) as fan_in, (select count(*) from medges e where e.src = m.module) as fan_out from mods m left join best b on m.module = b.node""", True)
def bfs_module_depth(b):
    e = fixpoint.settled(b.medges)
    nodes = fixpoint.settled(b.mods.select(F.col("module").alias("node")))
    depth = fixpoint.bfs_depth(e, nodes, nodes.where(F.col("node") == ENTRY))
    fan_in, fan_out = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return depth.join(fan_in, "node", "left").join(fan_out, "node", "left").na.fill(0, ["fan_in", "fan_out"]).select(F.col("node").alias("module"), "depth", "fan_in", "fan_out")


RANKS = """
walk as (select module as node, 0 as r from mods union select e.dst, walk.r + 1 from walk join medges e on e.src = walk.node),
rk as (select node, max(r) as rank from walk group by node)"""


@query(["mods", "medges"], f"{RANKS} select node as module, rank::bigint as rank from rk", True)
def longest_path_rank(b):
    return fixpoint.longest_ranks(b.medges, b.mods.select(F.col("module").alias("node"))).select(F.col("node").alias("module"), "rank")


@query(["mods", "medges", "provides"], """
e as materialized (select src, dst from medges union select dst, src from medges where src like 'supplier.n1%' and dst like 'nation.%'),
clo as (select distinct src, dst from e union select clo.src, e.dst from clo join e on e.src = clo.dst),
stuck as (select distinct dst as node from clo where src in (select src from clo where src = dst)),
free as (select module as node from mods where module not in (select node from stuck)),
walk as (select node, 0 as r from free union select e.dst, walk.r + 1 from walk join e on e.src = walk.node join free on free.node = e.dst),
rk as (select node, max(r) as rank from walk group by node)
select node as module, rank::bigint as rank from rk union all select stuck.node, coalesce((select max(rk.rank) + 1 from rk join e on e.src = rk.node where e.dst = stuck.node), 0)::bigint from stuck""", True)
def ranks_with_cycles(b):
    """Some edges also lead back: what is in or below their cycles keeps the rank that its peeled predecessors give."""
    e = fixpoint.settled(b.medges)
    back = e.where(F.col("src").like("supplier.n1%") & F.col("dst").like("nation.%")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.longest_ranks(e.unionByName(back), b.mods.select(F.col("module").alias("node"))).select(F.col("node").alias("module"), "rank")


CIRCLES = """
e as materialized (select src, dst from medges union select dst, src from medges where src like 'supplier.n1%' and dst like 'nation.%' union select 'region', 'region'),
clo as (select distinct src, dst from e union select clo.src, e.dst from clo join e on e.src = clo.dst)"""


def _circled(b):
    e = fixpoint.settled(b.medges)
    back = e.where(F.col("src").like("supplier.n1%") & F.col("dst").like("nation.%")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.settled(e.unionByName(back).unionByName(b.spark.createDataFrame([("region", "region")], "src string, dst string")))


@query(["medges"], f"""{CIRCLES}
select a.src as node, min(a.dst) as component from clo a join clo z on z.src = a.dst and z.dst = a.src where a.src <> a.dst or exists (select 1 from clo o join clo p on p.src = o.dst and p.dst = o.src where o.src = a.src and o.dst <> a.src) group by a.src""", True)
def strong_components(b):
    """Modules on circles, some edges leading back, with the least module of their circle."""
    return fixpoint.strong_components(_circled(b))


@query(["medges"], f"{CIRCLES} " + TRANS.format(e="e"), True)
def transitive_edges_with_circles(b):
    return fixpoint.transitive_edges(_circled(b))


@query(["mods", "medges"], f"""{RANKS},
p as (select node, rank, row_number() over (partition by rank order by node) - 1 as i, count(*) over (partition by rank) as k, dense_rank() over (order by rank) - 1 as lv from rk)
select node as module, (-(k * 200 + (k - 1) * 30) / 2.0 + i * 230)::double as x, (lv * 132)::double as y, 200::double as w, 52::double as h from p""", True)
def pod_layout(b):
    return layout.pod_layout(fixpoint.longest_ranks(b.medges, b.mods.select(F.col("module").alias("node")))).withColumnRenamed("node", "module")


@query(["defs"], """
f as (select module, min(line) as first, count(*) as k from defs group by module),
t as (select module, k, row_number() over (order by first, module) - 1 as t, ceil(sqrt(count(*) over ()))::bigint as cols from f),
i as (select d.key, t.*, row_number() over (partition by d.module order by d.line desc, d.key) - 1 as i, ceil(sqrt(k))::bigint as side from defs d join t on d.module = t.module)
select key, ((t % cols) * 1000 + (i % side) * 40 - (side - 1) * 20.0)::double as x, ((t // cols) * 1000 + (i // side) * 40 - (side - 1) * 20.0)::double as y from i""")
def module_grid_layout(b):
    return layout.grid_layout(b.defs.select("key", "module", F.col("line").alias("ord")))


def force_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules moved by forces from their places in rows; sums of floating numbers have no equal in SQL, so tests hold it against all pairs."""
    b = Bindings(spark, sf_dir)
    e = fixpoint.settled(b.medges)
    start = layout.pod_layout(fixpoint.longest_ranks(e, b.mods.select(F.col("module").alias("node")))).select(F.col("node").alias("key"), "x", "y")
    return layout.force_layout(start, e, rounds=6).withColumnRenamed("key", "module")


QUERIES["force_layout"] = force_layout


@query(["edges"], """
two as (select distinct src, dst, 1 as d from edges union all select distinct a.src, b.dst, 2 from edges a join edges b on a.dst = b.src),
near as (select src, dst, min(d) as d from two group by src, dst),
n as (select *, row_number() over (partition by src order by d, dst) as i from near)
select src, dst, d::bigint as d, case when i > 6 then 'capped' else 'captured' end as status from n""")
def bounded_closure(b):
    """Depth 2 at most, and six targets a root; the others are said to be omitted."""
    return evidence.captured(b.edges, most=6)


# ---- rollups


@query(["defs", "mods"], """
select m.module, count(*) filter (d.state = 'D') as d, count(*) filter (d.state = 'P') as p, count(*) filter (d.state = 'H') as h, (case when m.module like '%.F' then 1 else 0 end)::bigint as f, (case when m.module like '%.F' then 1 else 0 end)::bigint as failed
from mods m left join defs d on m.module = d.module group by m.module""")
def module_state_counts(b):
    return rollups.state_counts(b.defs, b.mods, b.mods.where(F.col("module").endswith(".F")))


@query(["defs"], """
a as (select module, string_agg(line::varchar, ',' order by line) as meta_lines from defs where state = 'H' group by module),
c as (select module, string_agg(distinct arity::varchar, ',' order by arity::varchar) as constraint_lines from defs where state = 'P' group by module)
select coalesce(a.module, c.module) as module, coalesce(meta_lines, '') as meta_lines, coalesce(constraint_lines, '') as constraint_lines from a full join c on a.module = c.module""")
def unsolved_rollup(b):
    out = rollups.unsolved_rollup(b.defs.where("state = 'H'").select("module", "line"), b.defs.where("state = 'P'").select("module", F.col("arity").cast("string").alias("line")))
    return out.select("module", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("meta_lines", "constraint_lines")])


MERGED = """
o as (select *, max(hi) over (partition by file order by lo, hi rows between unbounded preceding and 1 preceding) as reach from event_spans where event_type <> 'error'),
n as (select *, sum(case when lo <= reach then 0 else 1 end) over (partition by file order by lo, hi rows unbounded preceding) as isl from o),
merged as (select file, min(lo) as lo, max(hi) as hi from n group by file, isl)"""


@query(["event_spans"], f"{MERGED} select file, lo, hi from merged")
def merge_spans(b):
    return rollups.merged_spans(b.event_spans.where("event_type != 'error'").select("file", "lo", "hi"))


@query([], """select doc_id, (length(substr(text, 1, (length(text) // 2)::int)) - length(replace(substr(text, 1, (length(text) // 2)::int), chr(10), '')) + 1)::bigint as line from documents""")
def offset_to_line(b):
    t = F.coalesce("text", F.lit(""))
    return b.table("documents").select("doc_id", text.line_of_offset(t, F.floor(F.length(t) / 2).cast("int")).alias("line"))


@query(["event_spans"], """
select e.file, e.lo as at, count(*) as n from event_spans e where e.event_type = 'error' and exists (select 1 from event_spans s where s.event_type = 'purchase' and s.file = e.file and s.lo <= e.lo and e.lo < s.hi) group by all""")
def silent_offsets(b):
    """Offsets inside a highlighted span of their file."""
    points = b.event_spans.where("event_type = 'error'").select("file", F.col("lo").alias("at"))
    return rollups.in_spans(points, b.event_spans.where("event_type = 'purchase'").select("file", "lo", "hi")).groupBy("file", "at").agg(F.count("*").alias("n"))


# conversations as files: a system or user turn is a private header, indented by the number of its short words
LINES = """
ln as (select conv_id as file, row_number() over (partition by conv_id order by turn, role, text)::bigint as line_no, length(text) - length(replace(text, ' ', '')) as sp, role, text from conversations),
w as (select file, line_no, least(sp, 12)::bigint as ind, role = 'user' as head, length(text) = 0 or text is null as blank from ln)"""


def _conversation_lines(b):
    t = F.col("text")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    ind = F.least(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))), F.lit(12))
    body = F.when(F.length(t) == 0, F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), ind), F.when(F.col("role") == "user", F.lit("private")).otherwise(F.lit("x"))))
    return b.table("conversations").select(F.col("conv_id").alias("file"), n.alias("line_no"), F.coalesce(body, F.lit("")).alias("text"))


RANGES = f"""{LINES},
b as (select h.file, h.line_no as lo, coalesce((select min(x.line_no) - 1 from w x where x.file = h.file and x.line_no > h.line_no and not x.blank and x.ind <= h.ind), (select max(x.line_no) from w x where x.file = h.file)) as hi from w h where h.head and not h.blank),
ranges as (select file, lo, hi from (select *, max(hi) over (partition by file order by lo rows between unbounded preceding and 1 preceding) as before from b) where before is null or lo > before)"""


@query([], f"{RANGES} select file, lo, hi from ranges")
def private_block_ranges(b):
    return rollups.private_ranges(_conversation_lines(b))


@query([], f"{RANGES} select w.file, w.line_no as at, case when exists (select 1 from ranges r where r.file = w.file and w.line_no between r.lo and r.hi) then 'private' else 'public' end as access from w")
def access_backfill(b):
    lines = fixpoint.settled(_conversation_lines(b))
    points = lines.select("file", F.col("line_no").cast("long").alias("at"))
    inside = rollups.in_spans(points, rollups.private_ranges(lines), closed=True).select("file", "at").distinct().withColumn("p", F.lit(True))
    return points.join(inside, ["file", "at"], "left").select("file", "at", F.when(F.col("p"), "private").otherwise("public").alias("access"))


@query(["mods", "files", "defs"], """
owners as (select distinct 'part.' || replace(p_brand, '#', '') as owner, 'own/' || replace(p_brand, '#', '') as file from part union select 'part', 'own/part'),
best as (select m.module, arg_max(o.file, length(o.owner)) as f1 from mods m join owners o on m.module = o.owner or starts_with(m.module, o.owner || '.') group by m.module)
select m.module, coalesce(f1, case when m.module like 'customer%' then f.file end, 'site/' || m.module) as file from mods m left join best on best.module = m.module left join files f on f.module = m.module""")
def module_source_file(b):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    owners = b.table("part").select(F.concat(F.lit("part."), brand).alias("owner"), F.concat(F.lit("own/"), brand).alias("file")).distinct().unionByName(b.spark.createDataFrame([("part", "own/part")], "owner string, file string"))
    return rollups.module_sources(b.mods, owners, b.files.where("module like 'customer%'"), b.mods.select("module", F.concat(F.lit("site/"), "module").alias("file")))


@query(["mods"], """
i as (select module, row_number() over (order by module) - 1 as idx, string_split(module, '.')[1] || '.agda' as file from mods)
select file, dense_rank() over (order by file) - 1 as file_idx, string_agg(idx::varchar, ',' order by idx) as modules from i group by file""")
def file_module_maps(b):
    m = indexes.indexed(b.mods, ["module"]).withColumn("file", F.concat(F.split("module", r"\.")[0], F.lit(".agda")))
    files = indexes.indexed(m.select("file").distinct(), ["file"], "file_idx")
    per = m.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("idx")), ",").alias("modules"))
    return files.join(per, "file").select("file", "file_idx", "modules")


@query(["provides"], "select method_key, string_agg(distinct binder_key, ',' order by binder_key) as binders from provides group by method_key")
def method_providers(b):
    return rollups.provider_groups(b.provides).select("method_key", F.array_join("binders", ",").alias("binders"))


# ---- argument usage

CLASSED = "cls as (select key, pos, case when occurrence = 'Unused' and polarity = 'Nonvariant' then 'removable' when occurrence = 'Unused' then 'erasable' end as verdict from positions where occurrence = 'Unused')"


@query(["positions"], f"{CLASSED} select key, pos, verdict from cls")
def argusage_classify(b):
    return argusage.classified(b.positions)


def _removable_sql(rounds: int = 9) -> str:
    out = [CLASSED, "r0 as materialized (select key, pos from cls where verdict = 'removable')"]
    for k in range(rounds):
        seen = f"(f.in_domain is null or not exists (select 1 from r{k} x where x.key = f.key and x.pos = f.in_domain))"
        out.append(f"seen{k} as materialized (select distinct f.key, f.view, f.pos from free f where {seen})")
        out.append(f"orph{k} as materialized (select p.key, v.view, p.pos from positions p join (select distinct key, view from free) v on p.key = v.key where p.hidden and not exists (select 1 from r{k} x where x.key = p.key and x.pos = p.pos) and not exists (select 1 from seen{k} s where s.key = p.key and s.view = v.view and s.pos = p.pos))")
        out.append(f"r{k + 1} as materialized (select r.key, r.pos from r{k} r where not exists (select 1 from seen{k} s where s.key = r.key and s.pos = r.pos) and not exists (select 1 from free f join orph{k} o on f.key = o.key and f.view = o.view and f.pos = o.pos where f.key = r.key and f.in_domain = r.pos))")
    return ", ".join(out)


@query(["positions", "free"], f"{_removable_sql()} select key, pos from r9")
def argusage_removable(b):
    return argusage.removable(b.positions, b.free)


@query(["positions", "free"], f"""{CLASSED},
rem as (select key, pos from cls where verdict = 'removable'),
dir as (select distinct f.key, f.pos, f.in_domain as needs from free f join rem a on a.key = f.key and a.pos = f.pos join rem b on b.key = f.key and b.pos = f.in_domain where f.in_domain > f.pos),
clo as (select key, pos, needs from dir union select clo.key, clo.pos, d.needs from clo join dir d on d.key = clo.key and d.pos = clo.needs)
select key, pos, needs from clo""", True)
def argusage_requires(b):
    return argusage.requires(argusage.classified(b.positions).where("verdict = 'removable'").select("key", "pos"), b.free)


@query(["positions"], f"{CLASSED}, k as (select key, case when max(s) > 60 then 2 else 0 end as k from positions group by key) select cls.key, (pos - k)::bigint as pos from cls join k on cls.key = k.key where pos >= k")
def argusage_section_shift(b):
    sections = b.positions.groupBy("key").agg(F.when(F.max("s") > 60, 2).otherwise(-1).alias("k"))
    return argusage.shifted(argusage.classified(b.positions), sections)


@query(["positions"], f"""{CLASSED}, rem as (select key, pos from cls where verdict = 'removable'),
cl as (select key, s as clause, pos, case when p > s * 10 then 'var' when x > 30000 then 'dot' else 'con' end as pattern, x > 60000 as free_in_body from positions),
each as (select distinct key, clause from cl)
select rem.key, rem.pos from rem join each on rem.key = each.key left join cl on cl.key = rem.key and cl.clause = each.clause and cl.pos = rem.pos
group by rem.key, rem.pos having bool_or(case when pattern is null then true when pattern = 'var' then free_in_body when pattern = 'dot' then false else true end)""")
def argusage_body_occurrence(b):
    clauses = b.positions.select("key", F.col("s").alias("clause"), "pos", F.when(F.col("p") > F.col("s") * 10, "var").when(F.col("x") > 30000, "dot").otherwise("con").alias("pattern"), (F.col("x") > 60000).alias("free_in_body"))
    return argusage.occurs_in_body(argusage.classified(b.positions).where("verdict = 'removable'").select("key", "pos"), clauses)


USAGE = f"""{CLASSED}, u as (select p.key, count(*)::bigint as arity, max(case when x > 20000 then p.pos else 0 end) as syn, list(p.pos order by p.pos) filter (verdict = 'removable') as rm, list(p.pos order by p.pos) filter (verdict = 'erasable') as er, list(p.pos order by p.pos) filter (p.hidden) as bi, case when max(s) > 60 then 2 else 0 end as k from positions p left join cls c on p.key = c.key and p.pos = c.pos group by p.key)"""


def _usage(b):
    at = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("pos").cast("int"))))
    return b.positions.join(argusage.classified(b.positions), ["key", "pos"], "left").groupBy("key").agg(
        F.count("*").alias("arity"),
        F.max(F.when(F.col("x") > 20000, F.col("pos")).otherwise(0)).alias("syntactic_arity"),
        at(F.col("verdict") == "removable").alias("removable"),
        at(F.col("verdict") == "erasable").alias("erasable"),
        at(F.col("hidden")).alias("binders"),
        F.when(F.max("s") > 60, 2).otherwise(0).alias("k"),
    )


def _text(c):
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",")


MOVED = "array_to_string(list_transform(list_filter(coalesce({c}, []), lambda i: i >= k), lambda i: i - k), ',')"


@query(["positions"], f"""{USAGE},
w as (select key, arity, case when k = 2 then arity + 1 else syn end as syn, coalesce(rm, []) as rm, coalesce(er, []) as er, coalesce(bi, []) as bi,
  list_concat(list_transform(coalesce(rm, []), lambda p: [p, 2 * p - 2]), list_transform(coalesce(bi, []), lambda p: [p, p + 1])) as rq from u),
v as (select key, unnest([
  case when len(list_filter(list_concat(rm, list_concat(er, list_concat(bi, flatten(rq)))), lambda i: i < 0 or i >= arity)) > 0 then 'position beyond the arity' end,
  case when len(list_filter(rq, lambda r: not list_contains(rm, r[1]))) > 0 then 'need of a position that stays' end,
  case when len(list_filter(rq, lambda r: not list_contains(rm, r[2]))) > 0 then 'need for a position that stays' end,
  case when len(list_filter(rq, lambda r: r[2] <= r[1])) > 0 then 'need of an earlier position' end,
  case when len(list_filter(bi, lambda i: not list_contains(rm, i) and not list_contains(er, i))) > 0 then 'binder of a position not reported' end,
  case when len(list_filter(er, lambda i: not list_contains(rm, i))) > 0 then 'body use of a position that stays' end,
  case when syn > arity then 'longer spine than arity' end,
  case when len(list_filter(bi, lambda i: i >= syn)) > 0 then 'binder beyond the spine' end]) as problem from w)
select key, problem from v where problem is not null""")
def argusage_violations(b):
    """Usage that breaks each rule somewhere: needs are made up, erasable positions are said to occur in bodies."""
    pair = lambda c, f: F.transform(c, lambda p: F.struct(p.alias("pos"), f(p).cast("int").alias("needs")))
    u = _usage(b).withColumn("requires", F.concat(pair("removable", lambda p: 2 * p - 2), pair("binders", lambda p: p + 1)))
    return argusage.violations(u.withColumns({"syntactic_arity": F.when(F.col("k") == 2, F.col("arity") + 1).otherwise(F.col("syntactic_arity")), "occurs": F.col("erasable")}))


@query(["positions"], f"""{USAGE}
select key, greatest(arity - k, 0)::bigint as arity, greatest(syn - k, 0)::bigint as syntactic_arity, {MOVED.format(c='rm')} as removable, {MOVED.format(c='er')} as erasable, {MOVED.format(c='bi')} as binders, {MOVED.format(c='rm')} as needs
from u where k = 0 or len(list_filter(coalesce(rm, []), lambda i: i >= k)) + len(list_filter(coalesce(er, []), lambda i: i >= k)) > 0""")
def argusage_shifted_usage(b):
    """Every field of a usage row moves with the section's prefix; each removable position but the first needs itself here."""
    u = _usage(b)
    pairs = F.transform("removable", lambda p: F.struct(p.alias("pos"), p.alias("needs")))
    out = argusage.shifted_usage(u.withColumns({"requires": pairs, "occurs": F.col("removable")}).drop("k"), u.select("key", "k"))
    return out.select("key", "arity", "syntactic_arity", *[_text(c).alias(c) for c in ("removable", "erasable", "binders")], _text(F.transform("requires", lambda r: r["needs"])).alias("needs"))


@query(["defs"], "select key from defs where kind = 'function' and not (state = 'H')")
def argusage_scope(b):
    return argusage.in_scope(b.defs.withColumn("projection_like", F.col("state") == "H")).select("key")


@query(["positions"], f"{CLASSED} select p.key, p.pos, 'a' || p.p as name, case when hidden then 'implicit' else 'explicit' end as hiding, 't' || p.s as type from positions p join cls on cls.key = p.key and cls.pos = p.pos where p.x > 20000")
def argusage_binders(b):
    spine = b.positions.where("x > 20000").select("key", "pos", F.concat(F.lit("a"), "p").alias("name"), F.when(F.col("hidden"), "implicit").otherwise("explicit").alias("hiding"), F.concat(F.lit("t"), "s").alias("type"))
    return argusage.binders(argusage.classified(b.positions), spine)


@query(["positions", "defs"], """
d as (select key, short, case when line % 4 = 0 then 1 else 0 end as indices from defs where kind = 'record'),
sp as (select po.key as split, po.pos, d.key as parent, d.indices from positions po left join d on d.short = concat('s', case when po.x > 30000 then po.s when po.pos < 2 then 1 else 2 end))
select split from sp group by split having count(distinct parent) = 1 and bool_and(coalesce(indices = 0, false))""")
def plain_splits(b):
    parts = b.positions.select(F.col("key").alias("split"), F.concat(F.col("key"), F.lit("/"), F.col("pos").cast("string")).alias("constructor"), F.concat(F.lit("s"), F.when(F.col("x") > 30000, F.col("s")).when(F.col("pos") < 2, F.lit(1)).otherwise(F.lit(2)).cast("string")).alias("short"))
    d = b.defs.where("kind = 'record'").select("key", "short", F.when(F.col("line") % 4 == 0, 1).otherwise(0).alias("indices"))
    parents = parts.join(d, "short").select("constructor", F.col("key").alias("parent"))
    return representations.plain_splits(parts.select("split", "constructor"), parents, d)


@query(["provides"], "select method_key, binder_key from provides where binder_key not like '%1'")
def instance_methods(b):
    clauses = b.provides.select("binder_key", F.lit(0).alias("clause"), F.when(F.col("binder_key").like("%1"), "var").otherwise("proj").alias("head"), F.col("method_key").alias("method"))
    return edges.method_providers(clauses)


@query(["defs"], "select module from defs group by module having not (module like '%.F') or max(line) % 2 = 0")
def cacheable_modules(b):
    from weftgraph.operators.incremental import cacheable

    return cacheable(b.defs.groupBy("module").agg(F.count("*").alias("definitions"), (F.max("line") % 2 == 0).alias("fresh")).withColumn("is_main", F.col("module").endswith(".F")))


@query(["applied"], "select distinct src, dst from applied where (src, dst) not in (select (src, dst) from applied where applied > 10)")
def side_channel_growth(b):
    from weftgraph.operators.incremental import grown

    return grown(b.applied.select("src", "dst").distinct(), b.applied.where("applied > 10"), ["src", "dst"])


# an order's lines, in order, as a list of brands; it had two or fewer of them before
GROWING = "ls as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 as pos, p_brand as value from {lineitem} join {part} on l_partkey = p_partkey), mk as (select o_orderkey as key, case when o_orderkey % 3 = 0 then 2 when o_orderkey % 3 = 1 then 0 when o_orderkey % 5 = 0 then 100 else 1 end as length from {orders} where o_orderkey % 7 <> 0)"


@query([], f"""{GROWING}, le as (select key, max(pos) + 1 as length from ls group by key)
select ls.key, pos, value from ls join le on le.key = ls.key left join mk on mk.key = ls.key where pos >= case when le.length < mk.length then 0 else coalesce(mk.length, 0) end""")
def list_growth(b):
    """What lists have gained since they were read, repeated values too; lists that were begun anew are read whole."""
    from weftgraph.operators.incremental import list_ends

    return list_ends(b.sql([], f"{GROWING} select * from ls"), b.sql([], f"{GROWING} select * from mk"))[0]


@query(["refs"], """
m as (select distinct src as key, 'unsolved#meta.' || dst as what from refs where in_signature), o as (select distinct src as key, dst as what from refs where in_body and (src, dst) not in (select (src, dst) from refs where dst like 'part.%5'))
select key, count(*)::bigint as silent from (select * from m union all select * from o) group by key""")
def silent_metas(b):
    markers = b.refs.where("in_signature").select(F.col("src").alias("key"), F.concat(F.lit(filters.UNSOLVED), "dst").alias("dst"))
    metas = b.refs.where("in_body").select(F.col("src").alias("key"), F.col("dst").alias("meta"))
    return filters.silent_metas(markers, metas, b.refs.where("dst like 'part.%5'").select(F.col("src").alias("key"), F.col("dst").alias("meta")))


@query(["defs"], "select module, string_agg(distinct case when arity > 40 then '--erasure' else '--safe' end, ',' order by case when arity > 40 then '--erasure' else '--safe' end) as flags from defs where arity > 40 or state = 'P' group by module")
def effective_options(b):
    flag = F.when(F.col("arity") > 40, "--erasure").when(F.col("state") == "P", "--safe").otherwise("--other")
    return filters.effective_options(b.defs.select("module", flag.alias("flag")), ["--erasure", "--safe"]).select("module", F.array_join("flags", ",").alias("flags"))


@query(["defs"], "select module as file, arg_max(key, line) as module from defs group by module")
def entry_lookup(b):
    return rollups.module_of_file(b.defs.select(F.col("module").alias("file"), F.col("key").alias("module"), F.col("line").alias("place")))


@query(["files"], "select distinct file from files where file like 'proj/%'")
def project_files(b):
    return filters.files_of_project(b.files, ROOT, True)


# ---- terms

HASHED = """
own as materialized (select *, concat_ws(':', tag, length(name), name) as o from terms),
inner_ as materialized (select distinct tree, parent as node from own where parent is not null),
h0 as materialized (select own.tree, own.node, own.parent, own.ord, md5(o || '()') as hash, 1 as depth from own anti join inner_ using (tree, node)),
k1 as (select tree, parent as node, string_agg(hash, ',' order by ord, hash) as b, max(depth) as d from h0 where parent is not null and parent > 0 group by tree, parent),
h1 as materialized (select own.tree, own.node, own.parent, own.ord, md5(o || '(' || b || ')') as hash, d + 1 as depth from own join k1 on own.tree = k1.tree and own.node = k1.node),
k2 as (select tree, 0 as node, string_agg(hash, ',' order by ord, hash) as b, max(depth) as d from (select * from h1 union all select * from h0 where parent = 0) group by tree),
h2 as (select own.tree, own.node, own.parent, own.ord, md5(o || '(' || b || ')') as hash, d + 1 as depth from own join k2 on own.tree = k2.tree where own.node = 0 and own.parent is null),
prints as (select tree, node, hash, depth from h0 union all select tree, node, hash, depth from h1 union all select tree, node, hash, depth from h2)"""


@query(["terms"], f"{HASHED} select tree, node, hash, depth::bigint as depth from prints")
def subterm_hashes(b):
    return terms.fingerprints(b.terms)


@query(["terms"], f"{HASHED} select tree, node, hash, depth::bigint as depth from prints where depth >= 3")
def subterm_hashes_deep(b):
    return terms.fingerprints(b.terms, 3)


@query(["terms"], f"{HASHED}, once as (select hash, min(tree * 1000 + node) as first, count(*) as uses from prints group by hash) select row_number() over (order by first) - 1 as id, hash, uses from once")
def hash_cons_terms(b):
    return terms.hash_consed(b.terms, ["tree", "node"])


@query(["terms"], "select distinct tree, name from terms where tag in ('def', 'con', 'proj') and tree in (select tree from terms where name = '1-URGENT')")
def term_references(b):
    return terms.references(b.terms, b.terms.where("name = '1-URGENT'"))


SIGS = "sigs as materialized (select tree, node, parent, case when parent is null then 0 when parent = 0 then ord - 1 else ord end as ord, case when parent is not null then tag when name like '1-%' then 'pi' when name like '2-%' then 'type' else 'app' end as tag, name from terms)"


def _sigs(b):
    return fixpoint.settled(b.sql(["terms"], f"{SIGS.replace('materialized ', '')} select * from sigs"))


@query(["terms"], f"""{SIGS}
select r.tree from sigs r join sigs c on r.tree = c.tree and c.parent = r.node where r.parent is null and c.tag = 'def' and c.name = 'R' and c.ord = case when r.tag = 'pi' then 1 else 0 end""")
def equation_signatures(b):
    return evidence.equation_signatures(_sigs(b), "R")


@query(["terms"], f"""{SIGS},
r as (select * from sigs where parent is null and tag = 'app'),
c as (select k.* from sigs k join r on k.tree = r.tree and k.parent = r.node),
occ as (select r.tree, r.node, '' as path from r join c on c.tree = r.tree and c.ord = 0 where c.tag in ('def', 'var') union all select tree, node, ord::varchar from c where tag in ('def', 'var'))
select tree, node, path from occ""")
def neutral_occurrences(b):
    return evidence.neutral_occurrences(_sigs(b)).select("tree", "node", F.array_join("path", "/").alias("path"))


@query(["terms"], f"""{SIGS},
ann as (select tree, ord, coalesce(parent, 0) as up from sigs where parent is not null),
have as (select r.tree, c.ord as a, g.ord as b from sigs r join sigs c on c.tree = r.tree and c.parent = r.node left join sigs g on g.tree = c.tree and g.parent = c.node where r.parent is null and not (r.tag = 'pi' and c.ord = 1))
select distinct a.tree, concat(a.ord, '/', 0) as path from ann a join have h on h.tree = a.tree and h.a = a.ord and h.b = 0""")
def retained_annotations(b):
    s = _sigs(b)
    asked = s.where("parent is not null").select("tree", F.array(F.col("ord").cast("int"), F.lit(0)).alias("path")).distinct()
    return evidence.retained_annotations(asked, s).select("tree", F.array_join("path", "/").alias("path"))


@query(["terms"], """
own as materialized (select tree, rank() over (order by case when name like '5-%' then 0 else 1 end) as place from terms where parent is null and name not like '1-%'),
ix as materialized (select t.tree, t.node, t.parent, row_number() over (order by own.place, t.tree, t.node) - 1 as id from terms t join own on own.tree = t.tree)
select a.id, a.tree, a.node, b.id as parent_id from ix a left join ix b on a.tree = b.tree and a.parent = b.node""")
def reindexed_terms(b):
    roots = b.terms.where("parent is null and name not like '1-%'")
    return evidence.reindexed(fixpoint.settled(b.terms), roots.select("tree", F.when(F.col("name").like("5-%"), 0).otherwise(1).alias("place")))


# places in the trees of the bindings, whose three levels are known
PLACES = """
pl as materialized (select *, case when node = 0 then 0 when node < 100 then node else node // 100 end as line, case when node = 0 then 0 when node < 100 then 1 else 2 end as lv from terms),
pre as materialized (select *, row_number() over (partition by tree order by line, lv, ord) as pre, row_number() over (partition by tree order by case when node = 0 then 1 else 0 end, line, case when lv = 1 then 9 else ord end) as post,
  case lv when 0 then count(*) over (partition by tree) when 1 then count(*) over (partition by tree, line) else 1 end as size from pl)"""


@query(["terms"], f"{PLACES} select tree, node, pre, post, size, (lv + 1)::bigint as level from pre")
def preorder_numbers(b):
    return trees.numbered(b.terms.select("tree", "node", "parent", "ord")).select("tree", "node", "pre", "post", "size", "level")


@query(["terms"], f"{PLACES} select tree, node, pre, post, size, (lv + 1)::bigint as level from pre")
def euler_tour_numbers(b):
    """The numbers as large trees get them: all steps of all tours double their pointers together."""
    return trees.toured(b.terms.select("tree", "node", "parent", "ord")).select("tree", "node", "pre", "post", "size", "level")


BUDGET = 11


@query(["terms"], f"""{PLACES}
select c.tree, c.node, case when c.pre > {BUDGET} then 'unsupported' else c.tag end as tag, case when c.pre > {BUDGET} then 'capture-node-limit' else c.name end as name
from pre c left join pre p on p.tree = c.tree and p.node = c.parent where c.pre <= {BUDGET} or p.pre <= {BUDGET}""")
def limited_terms(b):
    """The first eleven nodes of each tree, and a leaf for each subtree that is cut off."""
    return trees.limited(trees.numbered(b.terms), BUDGET).select("tree", "node", "tag", "name")


DAG = """
l2 as materialized (select *, tag || '|' || name as body from pre where lv = 2),
k1 as (select tree, parent as node, string_agg(body, ';' order by ord) as below from l2 group by tree, parent),
l1 as materialized (select p.*, p.tag || '|' || p.name || '(' || coalesce(below, '') || ')' as body from pre p left join k1 on k1.tree = p.tree and k1.node = p.node where lv = 1),
k0 as (select tree, string_agg(body, ',' order by ord) as below from l1 group by tree),
l0 as (select p.*, p.tag || '|' || p.name || '[' || coalesce(below, '') || ']' as body from pre p left join k0 on k0.tree = p.tree where lv = 0),
allb as materialized (select tree, node, parent, ord, post, tag, name, body from l2 union all select tree, node, parent, ord, post, tag, name, body from l1 union all select tree, node, parent, ord, post, tag, name, body from l0),
firsts as (select body, min(({place}) * 1000000000000 + tree * 1000 + post) as first, any_value(tag) as tag, any_value(name) as name, count(*) as uses, arg_min(tree * 1000 + node, tree * 1000 + node) as one from allb group by body),
ids as materialized (select *, row_number() over (order by first) - 1 as id from firsts),
kids as (select p.id, string_agg(i.id::varchar, ',' order by c.ord) as children from ids p join allb c on c.tree = p.one // 1000 and c.parent = p.one % 1000 join ids i on i.body = c.body group by p.id)
select ids.id, tag, name, coalesce(children, '') as children, uses from ids left join kids on kids.id = ids.id"""


def _shared_rows(shared):
    return shared.select("id", "tag", "name", F.array_join("children", ",").alias("children"), "uses")


@query(["terms"], f"{PLACES}, {DAG.format(place='0')}")
def shared_term_dag(b):
    """Every distinct subtree once, with the ids of its children, numbered by first appearance in post-order."""
    return _shared_rows(terms.interned(b.terms)[0])


PICKED = "pre as materialized (select p.*, case when r.name like '5-%' then 0 else 1 end as place from all_pre p join terms r on r.tree = p.tree and r.parent is null and r.name not like '1-%')"


@query(["terms"], f"{PLACES.replace('pre as mat', 'all_pre as mat')}, {PICKED}, {DAG.replace('post, tag, name, body from', 'post, tag, name, body, place from').format(place='place')}")
def reindexed_dag(b):
    """What the trees of selected owners share, numbered anew in the owners' order."""
    roots = b.terms.where("parent is null and name not like '1-%'")
    return _shared_rows(terms.interned(b.terms, roots.select("tree", F.when(F.col("name").like("5-%"), 0).otherwise(1).alias("place")))[0])


WAYS = """
kid as (select *, row_number() over (partition by tree, parent order by ord, node) - 1 as k from terms),
way as (select c.tree, c.tag, c.name, case when c.parent is null then '' when c.parent = 0 then c.k::varchar else p.k || '/' || c.k end as path from kid c left join kid p on p.tree = c.tree and p.node = c.parent)"""


@query(["terms"], f"{WAYS} select tree, path, tag, name from way")
def decoded_terms(b):
    """Trees made of the shared nodes again."""
    return terms.decoded(*terms.interned(b.terms)).select("tree", F.array_join("path", "/").alias("path"), "tag", "name")


@query(["terms"], f"{WAYS} select tree, path, tag, name from way")
def nested_terms(b):
    """Trees as nested values, and read again."""
    values = fixpoint.settled(terms.nested(b.terms))
    return terms.unnested(values).select("tree", F.array_join("path", "/").alias("path"), "tag", "name")


# order trees as syntax: an application of the order to its lines, which are definitions, projections, or odd in some way
SYNTAX = """
syn as (select tree, node, parent, ord, case when node = 0 then 'def' when node < 100 then case when node = 5 then 'iapply' when node = 6 then 'proj' else 'apply' end when node % 100 = 0 and (tree + parent) % 3 = 0 then 'lam' when node % 100 = 0 then 'con' else 'none' end as kind,
  name as text, node < 100 and not (node = 3 and tree % 7 = 0) or node >= 100 and name not like '%3' as plain, name like '%2' as binds from terms)"""


@query(["terms"], f"""{SYNTAX},
e as materialized (select tree, node as i, kind, plain, text, kind = 'iapply' or kind = 'apply' and not plain as bad, row_number() over (partition by tree order by ord, node) as nth, count(*) over (partition by tree) as k from syn where parent = 0),
b as materialized (select tree, coalesce(max(case when bad then nth end), 0) as last, arg_max(kind, nth) filter (bad) as why, max(k) as k from e group by tree),
heads as (select s.tree, concat('0.', coalesce(b.last, 0)) as node, case when coalesce(b.last, 0) < coalesce(b.k, 0) then concat('0.', coalesce(b.last, 0) + 1) end as parent, 0 as ord, case when why is null then 'def' else 'unsupported' end as tag, case why when 'iapply' then 'cubical-application' when 'apply' then 'application-modality' else text end as name from syn s left join b on b.tree = s.tree where s.node = 0),
steps as (select e.tree, concat('0.', nth) as node, case when nth < e.k then concat('0.', nth + 1) end as parent, 0 as ord, case kind when 'apply' then 'app' else 'proj' end as tag, case kind when 'apply' then '' else text end as name from e join b on b.tree = e.tree where nth > last),
args as (select s.tree, concat(s.node, '.0') as node, concat('0.', e.nth) as parent, 1 as ord, case when s.kind = 'lam' and not s.plain then 'unsupported' else s.kind end as tag, case when s.kind = 'lam' and not s.plain then 'lambda-modality' else s.text end as name, s.kind = 'lam' and s.plain and s.binds as binds
  from syn s join e on e.tree = s.tree and e.i = s.parent join b on b.tree = e.tree where s.node >= 100 and s.node % 100 = 0 and e.kind = 'apply' and nth > last)
select tree, node, parent, ord::bigint as ord, tag, name, false as binds from heads union all select tree, node, parent, ord, tag, name, false from steps union all select * from args""")
def encoded_terms(b):
    """Syntax as trees: eliminations nest to the left, and what has no encoding is a leaf that says why."""
    raw = b.sql(["terms"], f"{SYNTAX} select * from syn").where("kind <> 'none' and not (node >= 100 and parent in (5, 6))")
    raw = raw.withColumn("info", F.array(F.when(F.col("binds"), "hidden").otherwise("visible")))
    return terms.encoded(raw).drop("info")


# every part copies the next one in its brand, a chain of any length; some suppliers copy each other in a circle
COPIES = """
cp as (select concat(p_brand, '/', p_partkey) as copy, lead(concat(p_brand, '/', p_partkey)) over (partition by p_brand order by p_partkey) as target from {part}
  union all select concat('s', s_suppkey), concat('s', case when s_suppkey % 10 = 0 then s_suppkey - 9 else s_suppkey + 1 end) from {supplier})"""


@query([], f"""{COPIES},
walk as (select copy, target, 1 as n from cp where target is not null union all select w.copy, c.target, n + 1 from walk w join cp c on c.copy = w.target where n < 64 and c.target is not null)
select copy, arg_max(target, n) as original from walk group by copy""", True)
def copy_chains(b):
    """What definitions that copy each other stand for, after 64 replacements at most."""
    return terms.copies_removed(b.sql([], f"{COPIES} select copy, target from cp where target is not null"))


CAPTURED = """
cd as materialized (select key, module, case kind when 'constructor' then arity when 'datatype' then line % 60 else 5 end as nodes, case when kind = 'postulate' then line * 10 end as body_nodes from defs where not (kind = 'record' and line % 4 = 1)),
cr as materialized (select key from cd where module = 'order.1-URGENT.F' or (module like 'part.Brand1%' or nodes > 45) and key like '%5'),
cq as materialized (select key from cd where module like 'customer.%' and key like '%3')"""
LIMITS = evidence.Limits(depth=1, auxiliaries=40, nodes=45, equations=12, supports=42)


def _step(k: int, asked: str, most: int | None, limit: str, large: str) -> str:
    """A step of the capture: judged keys j, taken ones t, refused ones f."""
    before = " union all ".join(f"select key from t{i}" for i in range(k)) or "select null as key where false"
    room = f" and place <= {most}" if most is not None else ""
    return f"""
j{k} as materialized (select a.key, case when d.key is null then 'unavailable-definition' when d.module = 'part.Brand11' or d.module like 'part.Brand11.%' then 'excluded-module' when d.nodes > 45 then '{large}' end as reason from (select distinct key from ({asked}) where key not in ({before})) a left join cd d on d.key = a.key),
o{k} as materialized (select key, row_number() over (order by key) as place from j{k} where reason is null),
t{k} as materialized (select key from o{k} where true{room}),
f{k} as materialized (select key, reason, {2 * k} as step from j{k} where reason is not null union all select key, '{limit}', {2 * k + 1} from o{k} where key not in (select key from t{k}))"""


def _mentioned(k: int) -> str:
    return f"select dst as key from refs where src in (select key from t{k})"


@query(["defs", "refs"], f"""{CAPTURED}, {_step(0, 'select key from cr', None, '', 'signature-node-limit')}, {_step(1, _mentioned(0), 40, 'auxiliary-limit', 'signature-node-limit')},
{_step(2, 'select key from cq', 12, 'equation-signature-limit', 'equation-signature-node-limit')},
{_step(3, f"select key from ({_mentioned(2)}) where key in (select key from cd where body_nodes <= 128) and key not in (select key from cq)", 2, 'support-limit', 'signature-node-limit')},
deep as (select distinct key, 'closure-depth' as reason, 3.5 as step from ({_mentioned(1)}) where key not in (select key from t0 union all select key from t1)),
ref as (select * from f0 union all select * from f1 union all select * from deep union all select * from f2 union all select * from f3),
tk as (select key, 'selected-root' as role from t0 union all select key, 'auxiliary' from t1 union all select key, 'equation-signature' from t2 union all select key, 'support' from t3)
select key, role, null::varchar as reason from tk union all select key, 'omitted', arg_max(reason, step) from ref where key not in (select key from tk) group by key""")
def bounded_capture(b):
    """What a capture with small limits takes, and each refusal with its reason."""
    d = fixpoint.settled(b.sql(["defs"], f"{CAPTURED.replace('materialized ', '')} select * from cd"))
    roots = d.where("module = 'order.1-URGENT.F' or (module like 'part.Brand1%' or nodes > 45) and key like '%5'").select("key")
    return evidence.capture(d, b.refs, roots, d.where("module like 'customer.%' and key like '%3'").select("key"), b.spark.createDataFrame([("part.Brand11",)], "prefix string"), LIMITS)


REACHED = "sel as (select key from defs where module like 'supplier.n1%'), walk as (select key from sel union select r.dst from walk join refs r on r.src = walk.key), av as (select key from defs where not ignorable), om as (select w.key, case when d.kind = 'record' then 'auxiliary-limit' else 'unavailable-reference' end as reason from walk w left join defs d on d.key = w.key where w.key not in (select key from av))"


def _reached(b):
    d, selected = b.defs, b.defs.where("module like 'supplier.n1%'").select("key")
    reached = fixpoint.settled(evidence.references_closed(b.refs, selected))
    available = d.where("not ignorable").select("key")
    return selected, reached, available, evidence.omissions(reached, available, d.where("kind = 'record'").select("key", F.lit("auxiliary-limit").alias("reason")))


@query(["defs", "refs"], f"{REACHED} select key, reason from om", True)
def term_omissions(b):
    return _reached(b)[3]


@query(["defs", "refs", "terms"], f"{REACHED} select (select count(*) from sel) as selected, (select count(*) from walk) as reachable, (select count(*) from av) as available, (select count(*) from om) as omitted, (select string_agg(distinct name, ',' order by name) from terms where tag = 'var') as unsupported_reasons", True)
def term_coverage(b):
    nodes = b.terms.withColumn("tag", F.when(F.col("tag") == "var", "unsupported").otherwise(F.col("tag")))
    return evidence.coverage(*_reached(b), nodes).withColumn("unsupported_reasons", F.array_join("unsupported_reasons", ","))


@query(["defs"], """
i as (select module, count(*)::varchar as options, max(key) as interface_hash, min(key) as source_hash from defs group by module)
select 'options' as kind, module as name, options as value from i union all select 'interface_hash', module, interface_hash from i union all select 'source_hash', module, source_hash from i
union all select distinct 'rewrite', key, null from defs where arity > 45 union all select 'spelling', key, module || '.' || short from defs""")
def evidence_environment(b):
    d = b.defs
    own = d.groupBy("module").agg(F.count("*").cast("string").alias("options"), F.max("key").alias("interface_hash"), F.min("key").alias("source_hash"))
    return evidence.environment(own, d, d.where("arity > 45").select("key"))


@query(["provides"], "select method_key as id, string_agg(distinct binder_key, ',' order by binder_key) as keys from provides group by 1")
def compiler_builtins(b):
    return evidence.builtins(b.provides.select(F.col("method_key").alias("id"), F.col("binder_key").alias("key"))).select("id", F.array_join("keys", ",").alias("keys"))


@query(["event_spans"], """
have as (select distinct concat('u', c_custkey) as file from customer), s as (select distinct file, lo, hi from event_spans where event_type = 'click' and file in (select file from have))
select file, string_agg(lo || '-' || hi, ',' order by lo, hi) as spans from s group by file""")
def silent_span_index(b):
    files = b.table("customer").select(F.concat(F.lit("u"), "c_custkey").alias("file"))
    out = evidence.span_index(files, b.event_spans.where("event_type = 'click'"))
    return out.select("file", F.array_join(F.transform("spans", lambda s: F.concat(s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string"))), ",").alias("spans"))


# ---- representations: suppliers are declarations, each part is a member of one that delivers it

DECLS = """
dec as (select key, kind, arity as parameters, case when line % 7 = 0 then 1 else 0 end as indices, case when line % 5 = 0 then 'direct' else 'nonrecursive' end as recursion, where_helper as closed from defs where kind = 'record'),
mem as (select min(p.binder_key) as owner, p.method_key as key, case when d.arity < 20 then 'constructor' else 'field' end as role from provides p join defs d on d.key = p.method_key group by p.method_key, d.arity),
ret as (select key, case when line % 3 = 0 then 2 else 3 end as parameters from defs where kind = 'constructor' and state <> 'H'),
mis as (select distinct m.owner, m.key from mem m join dec on dec.key = m.owner left join ret on ret.key = m.key where ret.key is null or (m.role = 'constructor' and ret.parameters <> dec.parameters))"""


def _declared(b):
    own = b.sql(["defs"], "select key, kind, arity as parameters, case when line % 7 = 0 then 1 else 0 end as indices, case when line % 5 = 0 then 'direct' else 'nonrecursive' end as recursion, where_helper as closed from defs where kind = 'record'")
    members = b.sql(["defs", "provides"], "select min(p.binder_key) as owner, p.method_key as key, case when d.arity < 20 then 'constructor' else 'field' end as role from provides p join defs d on d.key = p.method_key group by p.method_key, d.arity")
    retained = b.sql(["defs"], "select key, case when line % 3 = 0 then 2 else 3 end as parameters from defs where kind = 'constructor' and state <> 'H'")
    return own, members, retained


@query(["defs", "provides"], f"{DECLS} select owner, key from mis")
def missing_members(b):
    return representations.missing_members(*_declared(b))


INVENTORY = f"""{DECLS},
lim as (select dec.*, (select count(*) from mem where mem.owner = dec.key and role = 'constructor') as n_constructors, (select count(*) from mem where mem.owner = dec.key and role = 'field') as n_fields, dec.key not in (select owner from mis) as complete from dec)"""


@query(["defs", "provides"], f"""{INVENTORY}
select key, n_constructors, n_fields, complete, concat_ws(',', case when closed then 'abstract-or-opaque' end, case when not complete then 'missing-member-signatures' end) as limitations from lim""")
def representation_inventories(b):
    out = representations.inventories(*_declared(b))
    return out.select("key", F.size("constructors").alias("n_constructors"), F.size("fields").alias("n_fields"), "complete", F.array_join("limitations", ",").alias("limitations"))


@query(["defs", "provides"], f"""{INVENTORY},
con as (select lim.*, mem.key as name, mem.key like '%0' as supported, mem.key like '%1_' as odd from lim join mem on mem.owner = lim.key and mem.role = 'constructor'),
bar as (select *, concat_ws(',', case when closed then 'abstract-or-opaque' end, case when indices <> 0 then 'indexed' end, case when n_constructors <> 1 then 'multiple-or-zero-constructors' end, case when recursion <> 'nonrecursive' then 'recursion-' || recursion end) as bars from con)
select name, key as owner, case when bars <> '' then 'unavailable' when not supported or odd or not complete then 'partial' else 'complete' end as status,
  case when bars <> '' then bars when not supported then 'unsupported-telescope' when odd then 'blocked-constructor-result' when not complete then 'owner-inventory-incomplete' else '' end as limitations from bar""")
def constructor_views(b):
    own, members, retained = _declared(b)
    inventory = fixpoint.settled(representations.inventories(own, members, retained))
    # a constructor's type ends in its owner, but for some
    each = inventory.select(F.col("key").alias("owner"), F.explode("constructors").alias("name"))
    results = each.select("name", F.when(~F.col("name").like("%1_"), F.col("owner")).alias("result_owner"), F.col("name").like("%0").alias("supported"))
    views = representations.constructor_views(inventory, results)
    return views.select("name", "owner", "status", F.array_join("limitations", ",").alias("limitations"))


# ---- encodings

IDX = "ix as (select module, row_number() over (order by module) - 1 as idx from mods), ie as (select a.idx as src, b.idx as dst from medges join ix a on medges.src = a.module join ix b on medges.dst = b.module)"


def _indexed_edges(b):
    ix = fixpoint.settled(indexes.indexed(b.mods, ["module"]))
    e = b.medges.join(ix.select(F.col("module").alias("src"), F.col("idx").alias("s")), "src").join(ix.select(F.col("module").alias("dst"), F.col("idx").alias("t")), "dst")
    return ix, e.select(F.col("s").alias("src"), F.col("t").alias("dst"))


@query(["mods", "medges"], f"""{IDX}, d as (select ix.idx, count(ie.src) as n from ix left join ie on ie.src = ix.idx group by ix.idx union all select (select max(idx) + 1 from ix), 0)
select idx, coalesce(sum(n) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from d""")
def csr_offsets(b):
    return indexes.csr_offsets(*_indexed_edges(b))


@query(["mods", "medges"], f"{IDX} select row_number() over (order by src, dst) - 1 as place, src, dst, (case when src < 60 then 0 else 4 end)::bigint as prov from ie")
def csr_targets(b):
    e = _indexed_edges(b)[1]
    return indexes.csr_targets(e.withColumn("prov", F.when(F.col("src") < 60, "signature").otherwise("unknown")))


@query(["mods"], """
a as (select module as path, true as own from mods union all select array_to_string(string_split(module, '.')[1:k], '.'), false from mods, unnest(range(1, len(string_split(module, '.')))) t(k)),
n as (select path, bool_or(own) as is_name, string_split(path, '.') as seg from a group by path),
i as (select *, row_number() over (order by seg) - 1 as idx from n)
select i.path, i.idx, coalesce(u.idx, -1)::bigint as parent, i.is_name from i left join i u on u.path = array_to_string(i.seg[1:len(i.seg) - 1], '.') and len(i.seg) > 1""")
def module_tree(b):
    return indexes.name_tree(b.mods.select(F.col("module").alias("name")), ".", r"\.")


@query(["files"], """
a as (select file as path, true as own from files union all select array_to_string(string_split(file, '/')[1:k], '/'), false from files, unnest(range(1, len(string_split(file, '/')))) t(k)),
n as (select path, bool_or(own) as is_name, string_split(path, '/') as seg from a group by path),
i as (select *, row_number() over (order by seg) - 1 as idx from n)
select i.path, i.idx, coalesce(u.idx, -1)::bigint as parent, i.is_name from i left join i u on u.path = array_to_string(i.seg[1:len(i.seg) - 1], '/') and len(i.seg) > 1""")
def file_tree(b):
    return indexes.name_tree(b.files.select(F.col("file").alias("name")), "/", "/")


@query(["mods"], """
ix as (select lower(module) as name, row_number() over (order by module) - 1 as idx from mods),
g as (select distinct idx, substr(name, k::int, 2) as bigram from ix, unnest(range(1, length(name))) t(k))
select bigram, string_agg(idx::varchar, ',' order by idx) as ids from g group by bigram""")
def search_bigrams(b):
    ids = indexes.indexed(b.mods, ["module"]).select(F.col("idx").alias("id"), F.col("module").alias("name"))
    return indexes.search_postings(ids).select("bigram", F.array_join("ids", ",").alias("ids"))


NAMES_OF_ALL = """
am as (select module as name, row_number() over (order by module) - 1 as id from mods),
ad as (select key as name, row_number() over (order by key) - 1 + (select count(*) from am) as id from defs),
al as materialized (select * from am union all select * from ad),
ag as materialized (select distinct id, id // 4096 as block, substr(lower(name), k::int, 2) as bigram from al, unnest(range(1, length(name))) t(k)),
st as (select *, id - lag(id) over (partition by bigram, block order by id) as step from ag),
pb as materialized (select bigram, block, count(*) as n, min(id) as first, coalesce(string_agg(step::varchar, ',' order by id) filter (step is not null), '') as deltas from st group by bigram, block)"""


def _blocks(b):
    name = lambda df, c: indexes.indexed(df.select(F.col(c).alias("name")), ["name"], "id")
    return indexes.posting_blocks(name(b.mods, "module"), name(b.defs, "key"))


@query(["mods", "defs"], f"{NAMES_OF_ALL} select * from pb")
def search_blocks(b):
    """Postings of modules, then definitions: many rows for a bigram that is in many names."""
    return _blocks(b).withColumn("deltas", F.array_join("deltas", ","))


@query(["mods", "defs"], f"""{NAMES_OF_ALL},
ask as (select distinct substr(lower(c_name), 1, 6) || right(c_name, 2) as text from customer union select 'r1.n' union select 'segment' union select 'brand11.' union select 'zz'),
aw as (select distinct text, substr(text, k::int, 2) as bigram from ask, unnest(range(1, length(text))) t(k)),
ak as (select text, count(*) as k from aw group by text)
select aw.text, ag.id from aw join ag on ag.bigram = aw.bigram join ak on ak.text = aw.text group by aw.text, ag.id, ak.k having count(*) = ak.k""")
def search_lookup(b):
    """Names with all bigrams of each text that is looked for."""
    c = b.table("customer").select(F.concat(F.substring(F.lower("c_name"), 1, 6), F.right("c_name", F.lit(2))).alias("text"))
    asked = c.unionByName(b.spark.createDataFrame([("r1.n",), ("segment",), ("brand11.",), ("zz",)], "text string"))
    return indexes.found_names(_blocks(b), asked)


@query(["defs"], """
k as (select distinct c_mktsegment as key from customer), a as (select distinct substr(c_mktsegment, 1, 4) || 'x' || substr(c_mktsegment, 5) as name from customer union select distinct o_orderpriority from orders),
n as (select name, key, levenshtein(name, key) as d from a, k where levenshtein(name, key) <= greatest(1, least(4, length(name) // 3)))
select name, arg_min(key, struct_pack(d := d, key := key)) as key, min(d)::bigint as d from n group by name""")
def nearest_key(b):
    known = b.table("customer").select(F.col("c_mktsegment").alias("key")).distinct()
    asked = known.select(F.concat(F.substring("key", 1, 4), F.lit("x"), F.substring("key", 5, 100)).alias("name")).unionByName(b.table("orders").select(F.col("o_orderpriority").alias("name")).distinct())
    return indexes.nearest_keys(asked, known)


# ---- validation and reuse


BROKEN = {
    "definitions": "select key, module, line - 2 as idx, case when line = 5 then 'X' else state end as state, case when line = 6 then 'odd' else kind end as kind from defs where not ignorable union all select key, module, line - 2, state, kind from defs where kind = 'primitive'",
    "edges": "select src, dst, case when in_signature then 'signature' when in_body then 'body' end as prov from refs",
    "modules": "select module from mods where module not like 'part.Brand1%' union all select module from mods where module like 'nation.%'",
    "module_edges": "select src, dst from imports union all select module, module from mods where module like 'nation.%'",
    "transitive_edges": "select src, dst from imports where src < 'supplier.n12' union all select dst, src from imports where src = 'supplier.n2'",
    "entry": "select 'nowhere' as module",
    "external": "select module from mods where module like 'part.%'",
    "failed": "select concat('lost.', module) as module from mods where module like '%.F'",
    "module_files": "select module, file from files union all select module, concat('other/', file) from files where module like 'nation.%'",
    "flags": "select module from mods where module like 'part.Brand11%'",
    "effective": "select 'gone' as module",
    "unsolved": "select module from mods where module like 'part.Brand12%'",
    "reexports": "select dst as host, src as source from imports",
}
GRAPH = ", ".join(f"g_{name} as ({sql})" for name, sql in BROKEN.items()) + ", gm as (select distinct module from g_modules)"


def _no_module(table: str, problem: str, column: str = "module") -> str:
    return f"select distinct '{problem}' as problem, {column} as example from g_{table} where {column} not in (select module from gm)"


def _no_ends(table: str, problem: str, known: str, a: str = "src", z: str = "dst") -> str:
    return f"select distinct '{problem}' as problem, {a} || ' -> ' || {z} as example from g_{table} where {a} not in ({known}) or {z} not in ({known})"


def _twice(table: str, column: str, problem: str) -> str:
    return f"select '{problem}' as problem, {column}::varchar as example from g_{table} group by {column} having count(*) > 1"


FOUND = " union all ".join(
    [
        _twice("modules", "module", "module listed twice"),
        _twice("definitions", "key", "definition listed twice"),
        _twice("definitions", "idx", "id given twice"),
        _twice("module_files", "module", "module with two files"),
        "select 'id below zero', key from g_definitions where idx < 0",
        "select 'unknown state or kind', key from g_definitions where state = 'X' or kind = 'odd'",
        "select 'untagged edge', src || ' -> ' || dst from g_edges where prov is null",
        _no_ends("edges", "edge to or from no definition", "select key from g_definitions"),
        _no_ends("module_edges", "module edge to or from no module", "select module from gm"),
        _no_ends("transitive_edges", "transitive edge to or from no module", "select module from gm"),
        _no_ends("reexports", "re-export to or from no module", "select module from gm", "host", "source"),
        "select 'module edge to itself', src from g_module_edges where src = dst",
        "select 'transitive edge that is no edge', src || ' -> ' || dst from g_transitive_edges t where not exists (select 1 from g_module_edges m where m.src = t.src and m.dst = t.dst)",
        _no_module("definitions", "definition of no module"),
        _no_module("entry", "entry is no module"),
        _no_module("external", "external is no module"),
        _no_module("failed", "failed is no module"),
        _no_module("module_files", "file of no module"),
        _no_module("flags", "flags of no module"),
        _no_module("effective", "flags or unsolved lines of no module"),
        _no_module("unsolved", "flags or unsolved lines of no module"),
    ]
)


@query(["defs", "refs", "imports", "mods", "files"], f"{GRAPH}, found as ({FOUND}) select problem, count(*) as n, min(example) as first, max(example) as last from found group by problem")
def validate_graph(b):
    """Every check, over tables that break each of them."""
    from types import SimpleNamespace

    from weftgraph.operators.validate import violations

    known = {"defs": b.defs, "refs": b.refs, "imports": fixpoint.settled(b.imports)}
    over = lambda sql: b.spark.sql(re.sub(r"\bfrom (\w+)", r"from {\1}", sql), **{n: df for n, df in known.items() if f"from {n}" in sql})
    known["mods"] = fixpoint.settled(over(CTES["mods"]))
    known["files"] = over(CTES["files"])
    tables = {name: over(sql) for name, sql in BROKEN.items()}
    tables |= {name: fixpoint.settled(tables[name]) for name in ("edges", "definitions")}  # read by several checks
    return violations(SimpleNamespace(**tables)).groupBy("problem").agg(F.count("*").alias("n"), F.min("example").alias("first"), F.max("example").alias("last"))


FRAGMENTS = """man as (select module, case when max(line) % 5 = 0 then 'old' else 'now' end as options_fp, min(key) as content_hash, cast(case when max(line) % 7 = 0 then 11 else 12 end as int) as format, cast(case when max(line) % 3 = 0 then 3 else 4 end as int) as key_version from defs where kind <> 'record' group by module),
src as (select module, case when min(line) % 2 = 0 then max(key) else min(key) end as content_hash from defs where kind <> 'postulate' group by module)"""


@query(["defs"], f"""{FRAGMENTS}
select man.module, 'good' as status from man join src on man.module = src.module and man.content_hash = src.content_hash where options_fp = 'now' and format = 12 and key_version = 4
union all select module, 'stale' from man where module not in (select module from src)""")
def reusable_fragments(b):
    from weftgraph.operators.incremental import stale_fragments, usable_fragments

    manifest, sources = b.sql(["defs"], f"{FRAGMENTS} select * from man"), b.sql(["defs"], f"{FRAGMENTS} select * from src")
    good = usable_fragments(manifest, "now", sources).withColumn("status", F.lit("good"))
    return good.unionByName(stale_fragments(manifest, sources).withColumn("status", F.lit("stale")))


@query(["defs"], """
n as (select module, md5(string_agg(key || state, ',' order by key)) as epoch from defs where line <= 900 or state <> 'H' group by module),
o as (select module, md5(string_agg(key || state, ',' order by key)) as epoch from defs where line > 20 or kind <> 'constructor' group by module)
select coalesce(n.module, o.module) as module, case when o.module is null then 'added' when n.module is null then 'removed' when n.epoch <> o.epoch then 'changed' else 'same' end as status from n full join o on n.module = o.module""")
def incremental_changed_modules(b):
    from weftgraph.operators.incremental import changed, epochs

    return changed(epochs(b.defs.where("line <= 900 or state != 'H'")), epochs(b.defs.where("line > 20 or kind != 'constructor'")))


@query(["medges", "mods", "files", "defs", "imports"], f"""{EXTERNAL}, have as (select distinct module from defs where not ignorable and state <> 'P')
select module, case when module like '%.F' then 'failed' when module in (select module from ext) then 'external' else 'filtered' end as reason from mods where module not in (select module from have)""")
def placeholder_details(b):
    from weftgraph.operators.incremental import placeholders

    have = b.defs.where("not ignorable and state != 'P'").select("module").distinct()
    return placeholders(b.mods, have, b.mods.where(F.col("module").endswith(".F")), _external(b))


@query([], """
select 'page' || page_id as module, case when html is null or length(html) = 0 then 'empty' when not contains(html, '</html>') then 'no end' else 'no title' end as reason from pages
where html is null or length(html) = 0 or not contains(html, '</html>') or not contains(html, '<title>')""")
def failed_sources(b):
    def parse(pages):
        reason = F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, "empty").when(~F.contains("html", F.lit("</html>")), "no end").when(~F.contains("html", F.lit("<title>")), "no title")
        return pages.select(F.concat(F.lit("page"), "page_id").alias("module"), reason.alias("reason"))

    return scan.keep_going(b.table("pages"), parse)[1]


@query(["defs"], """
e as (select module as slot, key, ('0x' || substr(md5(concat(key, state)), 1, 15))::bigint as epoch from defs),
l as (select slot, list_prepend(1469598103934665603::hugeint, list(epoch::hugeint order by key)) as l from e group by slot)
select slot, (list_reduce(l, lambda a, x: (a * 1099511628211::hugeint + x) % 18446744073709551616::hugeint))::varchar as epoch from l""")
def output_epochs(b):
    """One epoch of each module, of those of its definitions in order."""
    from weftgraph.sinks.manifest import combined_epochs

    digest = F.conv(F.substring(F.md5(F.concat("key", "state")), 1, 15), 16, 10)
    rows = b.defs.select(F.col("module").alias("slot"), "key", digest.cast("decimal(20,0)").alias("epoch"))
    return combined_epochs(rows, ["key"]).select("slot", F.col("epoch").cast("string").alias("epoch"))


@query(["terms"], f"""{WAYS}
select tree as name, case when path = '' then '' else '/children/' || replace(path, '/', '/children/') end || '/name' as path, '"' || name || '"' as golden, '"' || name || '!"' as now from way where name in ('A', 'CANADA')""")
def golden_differences(b):
    """Documents of trees against those that were made before two names changed."""
    from weftgraph.sinks.golden import differences

    some = fixpoint.settled(b.terms)
    later = some.withColumn("name", F.when(F.col("name").isin("A", "CANADA"), F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    documents = lambda df: terms.nested(df).withColumnRenamed("tree", "name")
    return differences(documents(later), documents(some))
