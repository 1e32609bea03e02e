"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, licenses, lm, merkle, neardup, packing, periods, quality, tokenstore, topk, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.read(tokenstore.write(_table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontaminate.WINDOW)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), "allow").alias("label"))
    return urlrules.judge(_table(spark, sf_dir, "pages"), labels)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.judge(_table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_token_store, op4_decontamination, proximity_matches, op5_neighbours, op6_url_rules, op7_chat, op8_language_model, op9_licenses, op10_near_duplicates, op11_merkle_manifest, op12_periodic_runs, op13_exact_top_k)}

#: Words of the contract, from a text column.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op4_decontamination": f"""
with d as (select doc_id, row_number() over () as r, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark),
gram as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
seen as (select s.r, s.i, gram.k, gram.item_id from (
  select r, i, ks.k, array_to_string(w[i:i + ks.k - 1], ' ') as g from
  (select r, w, unnest(range(1, len(w) + 1)) as i from d), (select distinct k from gram) ks where i + ks.k - 1 <= len(w)) s join gram on s.k = gram.k and s.g = gram.g),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from seen) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from seen where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (r) left join items using (r)""",
    "op7_chat": """
with t as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place from conversations),
p as (select conv_id, place, to_json(list({'r': role, 't': text}) over (partition by conv_id order by place rows unbounded preceding)) as prefix,
  place = max(place) over (partition by conv_id) as whole from t),
kept as (select min(conv_id) as conv_id from p where whole and prefix not in (select prefix from p where not whole) group by prefix)
select t.conv_id, count(*) as n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by place) as text
from t join kept on t.conv_id is not distinct from kept.conv_id group by t.conv_id""",
}


def _template_sql(template: str) -> str:
    """A template as a regular expression over the text's words, each with a space after it."""
    out = []
    for part in licenses.parts(template):
        if part.startswith("<<"):
            out.append("(?:[^ ]+ ){" + part[2:-2].replace("..", ",") + "}")
        else:
            out.append({"[": "(?:", "]": ")?"}.get(part, f"{part} "))
    return "(^| )" + "".join(out)


def _license_sql() -> str:
    phrases = [(p, len(p.split()), label) for p, label in licenses.PHRASES.items()]
    found = ", ".join(f"list_filter(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ') = '{p}') as p{k}" for k, (p, n, _) in enumerate(phrases))
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    base = ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (_, _, label) in enumerate(phrases))
    lead = lambda t: " ".join(itertools.takewhile(lambda part: part[0] not in "[<", licenses.parts(t)))
    more = ", ".join(f"case when contains(t, '{lead(t)} ') then case when regexp_matches(t, '{_template_sql(t)}') then '{label}' end end" for label, t in licenses.TEMPLATES)
    named = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x is not null))), ','), '')"
    return f"""
with d as (select doc_id, {WORDS} as w from documents),
e as (select *, case when len(w) > 0 then array_to_string(w, ' ') || ' ' else '' end as t, {found} from d),
f as (select *, {every} as p, [{base}] as b, [{more}] as m from e)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base, cast(list_min(p) - 1 as bigint) as first_word, cast(list_max(p) - 1 as bigint) as last_word,
  {named('b')} as base_labels, {named('b || m')} as labels, case when len(list_filter(m, lambda x: x is not null)) > 0 then 1.0 when len(p) > 0 then 0.5 else 0.0 end::double as score
from f"""


ORACLE_SQL["op9_licenses"] = _license_sql()


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _steps_sql(name: str) -> str:
    """Of every node of ``name`` (tree, level, place, digest): what stands left and right of it in its run, around a bar."""
    return f"""select n.tree, n.level, n.place, coalesce(string_agg(s.digest, '' order by s.place) filter (s.place < n.place), '') || '|' || coalesce(string_agg(s.digest, '' order by s.place) filter (s.place > n.place), '') as step
  from (select *, max(level) over (partition by tree) as height from {name}) n join {name} s on n.tree = s.tree and n.level = s.level and n.place // 3 = s.place // 3 where n.level < n.height group by all"""


def _tree_sql(name: str, first: str) -> str:
    """A recursive table: the nodes of ``first`` and all above them."""
    return f"""{name} as ({first}
  union all select tree, level + 1, place // 3, sha256(string_agg(digest, '' order by place)) from (select *, count(*) over (partition by tree) as n from {name}) where n > 1 group by tree, level, place // 3)"""


ORACLE_SQL["op11_merkle_manifest"] = f"""
with recursive crc as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
leaves as (select row_number() over () as r, doc_id, coalesce('+' || source, '') as tree, {_LEAF("text")} as leaf,
  case when xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint)), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295) % 2 = 0
    then {_LEAF("replace(text, chr(10), '')")} end as claimed from documents, crc),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, claimed nulls first) - 1 as place from leaves),
{_tree_sql("node", "select tree, 0 as level, place, leaf as digest from placed")},
subroots as (select tree, arg_max(digest, level) as subroot from node group by tree),
{_tree_sql("upper", "select '' as tree, 0 as level, row_number() over (order by tree) - 1 as place, subroot as digest from subroots")},
root as (select arg_max(digest, level) as root from upper),
low_steps as ({_steps_sql("node")}),
high_steps as ({_steps_sql("upper")}),
high as (select s.tree, coalesce(list(h.step order by h.level) filter (h.step is not null), []) as steps from (select tree, row_number() over (order by tree) - 1 as place from subroots) s
  left join high_steps h on h.place = s.place // pow(3, h.level)::bigint group by s.tree),
low as (select p.r, coalesce(list(l.step order by l.level) filter (l.step is not null), []) as steps from placed p left join low_steps l on l.tree = p.tree and l.place = p.place // pow(3, l.level)::bigint group by p.r),
paths as (select p.*, l.steps || h.steps as steps from placed p join low l using (r) join high h using (tree)),
folded as (select *, list_reduce(list_concat([coalesce(claimed, leaf)], steps), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) as folded_root from paths)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from folded join subroots using (tree), root"""

ORACLE_SQL["op13_exact_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, min(v) as q from v where vec_id % 50 = 0 group by vec_id)
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
  from (select query_id, vec_id, cast(list_inner_product(q, v) as bigint) as score from q join v on len(q) = len(v) and query_id <> vec_id)) where rank <= 5"""


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
