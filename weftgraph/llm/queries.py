"""Queries of the corpus operators, by name; oracle SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import op10_jaccard, op11_prefix_trie, op12_language, op13_infill, op1_sentencepiece, op2_token_counts, op3_quality, op4_mixing, op5_token_files, op6_substrings, op7_neighbours, op8_secrets, op9_tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece.query,
    "op2_token_counts": op2_token_counts.query,
    "op3_quality": op3_quality.query,
    "op4_mixing": op4_mixing.query,
    "op5_token_files": op5_token_files.query,
    "op6_substrings": op6_substrings.query,
    "op7_neighbours": op7_neighbours.query,
    "op8_secrets": op8_secrets.query,
    "op9_tiff": op9_tiff.query,
    "op10_jaccard": op10_jaccard.query,
    "op11_prefix_trie": op11_prefix_trie.query,
    "op12_language": op12_language.query,
    "op13_infill": op13_infill.query,
}

#: The Jaccard join in SQL: shingles as text, candidates by the rarest of each set (a quarter of it and one), components by recursion.
JACCARD = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
named as materialized (select doc_id, len(s)::bigint as n, md5(array_to_string(list_sort(s), chr(10))) as node from s),
nodes as materialized (select node, any_value(n) as n, min(doc_id) as least from named where n > 0 group by node),
each as materialized (select nodes.node, nodes.n, x from nodes join s on s.doc_id = nodes.least, unnest(s.s) t(x)),
ranked as materialized (select *, row_number() over (partition by node order by k, x) as r from (select each.*, count(*) over (partition by x) as k from each)),
few as materialized (select node, n, x from ranked where r <= n - ceil(0.75 * n) + 1),
pairs as materialized (select distinct a.node as a, b.node as b from few a join few b on a.x = b.x and a.node < b.node and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75),
links as materialized (select a, b from (select p.a, p.b, count(*) as common, any_value(ea.n) as m, any_value(nb.n) as n from pairs p join each ea on ea.node = p.a join each eb on eb.node = p.b and eb.x = ea.x join nodes nb on nb.node = p.b group by p.a, p.b) where 100 * common >= 75 * (m + n - common)),
sym as materialized (select a, b from links union select b, a from links),
walk as (select node, node as other from nodes union select walk.node, sym.b from walk join sym on sym.a = walk.other),
ids as (select walk.node, min(nodes.least) as component_id from walk join nodes on nodes.node = walk.other group by walk.node)
select doc_id, n as n_shingles, coalesce(component_id, doc_id) as component_id, case when n = 0 then 0 else (select count(*) from sym where sym.a = named.node) end as n_links from named left join ids on named.n > 0 and ids.node = named.node
"""

#: The other operators do what SQL can't (tokenizers, networks, sampling, images, window hashes of bytes, top lists by index): tests hold them against libraries and brute force.
ORACLE_SQL: dict[str, str] = {"op10_jaccard": JACCARD, "op11_prefix_trie": op11_prefix_trie.SQL, "op13_infill": op13_infill.SQL}
