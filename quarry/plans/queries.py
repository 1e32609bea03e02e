"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import languages, paths, text
from ..operators import context, corpus, coverage, detectors, diff, findings, ignore, nodes, search, shards, stats, syntax
from ..operators.corpus import DiscoverOptions
from ..sources import archives
from ..streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.from_documents(spark.read.parquet(f"{d}/documents.parquet"))


# DuckDB: the same corpus, its lines, and credentials.
FILES = """files as (select source || '/' || lang || '_' || cast(doc_id as varchar) || case lang when 'en' then '.py' when 'fr' then '.rs' when 'de' then '.js' when 'es' then '.sql' else '.txt' end as relative_path,
  coalesce(text, '') as content, strlen(coalesce(text, '')) as size_bytes, case lang when 'en' then 'python' when 'fr' then 'rust' when 'de' then 'javascript' when 'es' then 'sql' end as language from documents)"""
LINES = """arrays as (select *, case when content = '' then [] else string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') end as ls from files)"""
STYLE = "case language when 'python' then '#' when 'sql' then '--' else '//' end"
COUNTS = f"""counts as (select relative_path, language, len(ls) as n, len(list_filter(ls, lambda x: trim(x, ' \t\r') = '')) as blanks,
  len(list_filter(ls, lambda x: starts_with(trim(x, ' \t\r'), {STYLE}))) as comments from arrays where language is not null)"""
# The patterns in DuckDB's dialect: the same, without the flag for Unicode.
PATTERNS = {k: v.replace("(?iU)", "(?i)").replace("(?U)", "") for k, v in detectors.SECRETS.items()}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str) -> str:
    rule, value = _quoted(PATTERNS[kind]), "null" if kind == "private key" else f"regexp_extract(m, {_quoted(PATTERNS[kind])}, 1)"
    return f"""select relative_path, '{kind}' as kind, {value} as value, 1 + list_sum(list_transform(parts[:i], lambda x: len(x) - len(replace(x, chr(10), ''))))
  + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x) - len(replace(x, chr(10), '')))), 0) as line, len(m) - len(replace(m, chr(10), '')) as span
  from (select relative_path, ms, string_split_regex(content, {rule}) as parts, unnest(ms) as m, generate_subscripts(ms, 1) as i
  from (select relative_path, content, regexp_extract_all(content, {rule}) as ms from files where regexp_matches(content, {rule})))"""


MATCHES = "secrets as (" + " union all ".join(map(_matches, PATTERNS)) + ")"
PLACEHOLDER = f"""(starts_with(value, '${{') or starts_with(value, '{{{{') or starts_with(value, '<') or lower(value) in ({", ".join(map(_quoted, detectors.PLACEHOLDERS))})
  or {" or ".join(f"contains(lower(value), '{x}')" for x in detectors.PLACEHOLDER_PARTS)} or len(list_distinct(string_split(lower(value), ''))) < 4)"""


@query(f"with {FILES} select relative_path, size_bytes, language from files where regexp_extract(relative_path, '[.]([^.]*)$', 1) in ('py', 'rs')")
def discover_files(spark, d):
    return corpus.discover(_files(spark, d), DiscoverOptions(extensions=["py", "rs"]))


@query(f"with {FILES} select relative_path, size_bytes, language from files where split_part(relative_path, '/', 2) like '%\\_1%' escape '\\' order by relative_path limit 50")
def discover_by_pattern(spark, d):
    return corpus.discover(_files(spark, d), DiscoverOptions(pattern="_1", max_depth=2, max_results=50))


@query(f"with {FILES}, {LINES} select relative_path, cast(len(ls) as bigint) as n, len(string_split(relative_path, '/')) as depth, split_part(relative_path, '/', 1) as parent, split_part(relative_path, '/', 2) as name from arrays")
def path_parts(spark, d):
    p = F.col("relative_path")
    return _files(spark, d).select("relative_path", text.line_count("content").alias("n"), paths.depth(p).alias("depth"), paths.parent_dir(p).alias("parent"), paths.file_name(p).alias("name"))


@query(f"with {FILES}, {LINES} select relative_path as file, 'quality' as category, 'medium' as severity, 'The file has ' || len(ls) || ' lines; the limit is 20.' as description from arrays where len(ls) > 20")
def file_length(spark, d):
    return detectors.long_files(_files(spark, d), 20).select("file", "category", "severity", "description")


@query(f"with {FILES}, {LINES}, {COUNTS} select relative_path, language, cast(n - blanks - comments as bigint) as code, cast(comments as bigint) as comments, cast(blanks as bigint) as blanks from counts")
def line_counts(spark, d):
    return stats.line_counts(_files(spark, d))


@query(
    f"""with {FILES}, {LINES}, {COUNTS} select language, case language when 'javascript' then 'JavaScript' when 'sql' then 'SQL' when 'python' then 'Python' else 'Rust' end as name, count(*) as files,
  cast(sum(n - blanks - comments) as bigint) as code, cast(sum(comments) as bigint) as comments, cast(sum(blanks) as bigint) as blanks from counts group by language"""
)
def language_stats(spark, d):
    return stats.by_language(stats.line_counts(_files(spark, d)))


@query(f"with {FILES}, {LINES}, {COUNTS} select count(*) as files, cast(coalesce(sum(n), 0) as bigint) as lines, cast(coalesce(sum(n - blanks - comments), 0) as bigint) as code, cast(coalesce(sum(comments), 0) as bigint) as comments, cast(coalesce(sum(blanks), 0) as bigint) as blanks from counts")
def stats_totals(spark, d):
    return stats.totals(stats.line_counts(_files(spark, d)))


@query(f"with {FILES}, {LINES}, {COUNTS}, s as (select language, sum(n - blanks - comments) as code from counts group by language) select language, cast(code * 100 // sum(code) over () as bigint) as percent from s order by code desc, language limit 5")
def language_share(spark, d):
    return stats.shares(stats.by_language(stats.line_counts(_files(spark, d))))


@query(
    f"""with {FILES}, {LINES}, l as (select relative_path, ls, unnest(ls) as line, generate_subscripts(ls, 1) as i from arrays)
select relative_path, cast(i as bigint) as line_number, line, array_to_string(ls[greatest(1, i - 2):i - 1], '|') as before, array_to_string(ls[i + 1:i + 2], '|') as after
from l where regexp_matches(line, 'licen[cs]e|reserved', 'i') order by relative_path, i limit 500"""
)
def search_text(spark, d):
    found = search.search(_files(spark, d), "licen[cs]e|reserved", context=2)
    return found.select("relative_path", "line_number", "line", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"with {FILES}, {LINES} select relative_path, array_to_string(ls[2:4], chr(10)) as part from arrays")
def line_slice(spark, d):
    return _files(spark, d).select("relative_path", text.line_slice("content", 2, 4).alias("part"))


@query(
    f"""with {FILES}, {MATCHES} select 'VULN-' || lpad(cast(row_number() over (order by string_split(relative_path, '/'), line, line + span, 'Hard-coded ' || kind) as varchar), 3, '0') as id, relative_path as file,
  cast(line as bigint) as line_start, cast(line + span as bigint) as line_end, 'critical' as severity, 'vulnerability.hardcoded-secret' as rule, kind from secrets where value is null or not {PLACEHOLDER}"""
)
def secret_findings(spark, d):
    found = findings.finalize(detectors.secrets(_files(spark, d)))
    return found.select("id", "file", "line_start", "line_end", "severity", "rule", F.expr("substring(title, 12)").alias("kind"))


@query(f"with {FILES}, {MATCHES} select relative_path, kind, value, cast(line as bigint) as line_start, coalesce({PLACEHOLDER}, false) as placeholder from secrets")
def secret_placeholders(spark, d):
    found = detectors.every_secret(_files(spark, d))
    return found.select("relative_path", "kind", "value", "line_start", F.coalesce(detectors.is_placeholder(F.col("value")), F.lit(False)).alias("placeholder"))


#: Lines that are allowed in a file of the corpus of documents, so that some are too long.
FILE_LINES = 20
_TODO = "list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^\\s*(//|#)') and regexp_matches(ls[i], 'TODO|FIXME|HACK|XXX'))"


@query(
    f"""with {FILES}, {LINES}, {MATCHES},
found as (select relative_path as file, 'quality' as category, 'medium' as severity, 'high' as confidence, null as line_start, null as line_end, 'quality.file-length' as rule, 'Long file' as title, 'The file has ' || len(ls) || ' lines; the limit is {FILE_LINES}.' as description from arrays where len(ls) > {FILE_LINES}
  union all select relative_path, 'vulnerability', 'critical', 'medium', line, line + span, 'vulnerability.hardcoded-secret', 'Hard-coded ' || kind, 'A value that looks like a credential (' || kind || ') stands in the source.' from secrets where value is null or not {PLACEHOLDER}
  union all select relative_path, 'quality', 'low', 'high', i, i, 'quality.todo-comment', regexp_extract(ls[i], 'TODO|FIXME|HACK|XXX') || ' comment', regexp_extract(ls[i], 'TODO|FIXME|HACK|XXX') || ' marks unfinished work.' from (select relative_path, ls, unnest({_TODO}) as i from arrays)),
r as (select *, row_number() over (order by list_position(['info', 'low', 'medium', 'high', 'critical'], severity) desc, list_position(['low', 'medium', 'high'], confidence) desc, category, string_split(file, '/'), line_start nulls last, line_end nulls last, rule, title, description) as k from found)
select (case category when 'quality' then 'QUAL' else 'VULN' end) || '-' || case when k < 1000 then lpad(cast(k as varchar), 3, '0') else cast(k as varchar) end as id, file, category, severity, confidence, cast(line_start as bigint) as line_start, cast(line_end as bigint) as line_end, rule, title, description from r"""
)
def static_report(spark, d):
    """All static detectors over the corpus, as ordered, numbered findings: the flagship query."""
    found = findings.finalize(detectors.static_findings(_files(spark, d), ["quality", "vulnerability"], FILE_LINES))
    return found.select("id", "file", "category", "severity", "confidence", "line_start", "line_end", "rule", "title", "description")


# Source code made from the orders: credentials of each kind, comments and block comments, functions of different lengths.
CODE = """code as (select o_orderkey as k, 'src/' || o_custkey % 40 || '/f' || o_orderkey || ['.rs', '.js', '.go'][o_orderkey % 3 + 1] as relative_path, o_orderkey % 90 as n, o_orderkey % 5 as kind, substring(md5(cast(o_orderkey as varchar)), 1, 20) as value, o_orderkey % 4 as note from orders)"""


def _code(spark, d):
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    value = F.substring(F.md5(k.cast("string")), 1, 20)
    head = pick(["fn ", "function ", "func "], k)
    secret = pick(["api_key = '", "Password :\n '", "let secret='", 'aws_access_key_id = "AKIA', "-----BEGIN EC PRIVATE KEY-----"], k)
    secret = F.when(k % 5 == 3, F.concat(secret, F.upper(F.substring(value, 1, 16)), F.lit('"'))).when(k % 5 == 4, secret).otherwise(F.concat(secret, value, F.lit("'")))
    note = pick(["// TODO: first", "x(); // TODO behind code", "/* FIXME in a block\n XXX goes on */", "# HACK and TODO"], k)
    text = F.concat(head, F.lit("f"), k.cast("string"), F.lit("() {\n"), F.repeat(F.lit("  x();\n"), F.pmod(k, F.lit(90)).cast("int")), F.lit("}\n"), note, F.lit("\n"), secret, F.lit("\n"))
    path = F.concat(F.lit("src/"), F.pmod("o_custkey", F.lit(40)).cast("string"), F.lit("/f"), k.cast("string"), pick([".rs", ".js", ".go"], k))
    return corpus.with_language(spark.read.parquet(f"{d}/orders.parquet").select(path.alias("relative_path"), text.alias("content")))


@query(
    f"""with {CODE} select relative_path as file, ['API key', 'password', 'secret/token', 'AWS access key', 'private key'][kind + 1] as kind, cast(n + 4 + (note = 2)::int as bigint) as line_start, cast(n + 4 + (note = 2)::int + (kind = 1)::int as bigint) as line_end from code"""
)
def secret_kinds(spark, d):
    found = detectors.secrets(_code(spark, d))
    return found.select("file", F.expr("substring(title, 12)").alias("kind"), "line_start", "line_end")


@query(
    f"""with {CODE}, marks as (select relative_path, n + 3 as i, note, unnest(case when note = 2 then [0, 1] else [0] end) as more from code where note <> 1)
select relative_path as file, case when note = 0 then 'TODO comment' when note = 3 then 'TODO comment' when more = 0 then 'FIXME comment' else 'XXX comment' end as title, cast(i + more as bigint) as line_start,
  case when note = 0 then '// TODO: first' when note = 3 then '# HACK and TODO' when more = 0 then '/* FIXME in a block' else 'XXX goes on */' end as code_snippet from marks"""
)
def todo_comments(spark, d):
    return detectors.todo_comments(_code(spark, d)).select("file", "title", "line_start", "code_snippet")


@query(f"with {CODE} select relative_path, case when relative_path like '%.rs' then 'rust' when relative_path like '%.js' then 'javascript' else 'go' end as language, cast(1 as bigint) as line_start, cast(n + 2 as bigint) as line_end, 'function' as kind, 'f' || k as name from code")
def signatures(spark, d):
    return syntax.signatures(_code(spark, d)).drop("problem")


@query(f"with {CODE} select relative_path, cast(1 as bigint) as line_start, 'f' || k as name, ['fn ', 'function ', 'func '][k % 3 + 1] || 'f' || k || '() {{' as text from code")
def signature_lines(spark, d):
    return syntax.signature_lines(_code(spark, d)).select("relative_path", "line_start", "name", "text")


@query(
    f"""with {CODE}, calls as (select relative_path, k, n, unnest(range(n)) as i from code where k % 3 = 0)
select relative_path, cast(i + 2 as bigint) as line_start, cast(i + 2 as bigint) as line_end, 'x()' as matched_code from calls
union all select relative_path, 1, n + 2, 'fn f' || k || '() {{' || chr(10) || repeat('  x();' || chr(10), n::int) || '}}' from code where k % 3 = 0 and n = 0
union all select relative_path, n + 3, n + 3, '// TODO: first' from code where k % 3 = 0 and note = 0"""
)
def syntax_matches(spark, d):
    """Calls in the bodies of Rust functions, functions whose bodies call nothing, and comments, in a free syntax query."""
    query = """
    (function_item name: (identifier) body: (block (call_expression function: (identifier) arguments: (arguments)) @call))
    ((function_item body: (block) @block) @function (#eq? @block "{\n}"))
    ((line_comment) @comment (#match? @comment "TODO: f"))
    """
    return nodes.search_corpus(_code(spark, d), query, "rust")


@query(f"with {CODE} select relative_path as file, case when n + 2 > 80 then 'high' else 'medium' end as severity, 'Long function: f' || k as title, cast(1 as bigint) as line_start, cast(n + 2 as bigint) as line_end from code where n + 2 > 40")
def long_functions(spark, d):
    return detectors.long_functions(_code(spark, d), 40).select("file", "severity", "title", "line_start", "line_end")


@query(
    f"""with {CODE} select relative_path, cast(n + 3 + (kind = 1)::int + (note in (1, 3))::int as bigint) as code, cast(case note when 0 then 1 when 2 then 2 else 0 end as bigint) as comments,
  cast(0 as bigint) as blanks, note from code"""
)
def comment_counts(spark, d):
    rows = stats.line_counts(_code(spark, d))
    note = F.pmod(F.regexp_extract("relative_path", r"f(\d+)", 1).cast("long"), F.lit(4))
    return rows.select("relative_path", "code", "comments", "blanks", note.alias("note"))


def _findings(spark, d):
    """Line items as findings: a wide relation with all severities, confidences and categories."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    name = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))
    return findings.shaped(rows, category=name(list(findings.CATEGORIES), k), severity=name(findings.SEVERITIES, F.expr("o_orderkey div 4")), confidence=name(findings.CONFIDENCES, F.expr("o_orderkey div 20")), title=F.concat(F.lit("t"), (k % 7).cast("string")), description=F.concat(F.lit("d"), k.cast("string")), file=F.concat(F.lit("c/"), F.pmod("o_custkey", F.lit(50)).cast("string")), line_start=F.pmod(k, F.lit(97)) + 1, line_end=F.pmod(k, F.lit(97)) + 3, rule=F.concat(F.lit("x."), F.col("o_orderstatus")), source=name(findings.SOURCES, F.expr("o_orderkey div 60")))


FOUND = """found as (select ['bug', 'quality', 'solid', 'vulnerability'][o_orderkey % 4 + 1] as category, ['info', 'low', 'medium', 'high', 'critical'][(o_orderkey // 4) % 5 + 1] as severity, ['low', 'medium', 'high'][(o_orderkey // 20) % 3 + 1] as confidence,
  't' || (o_orderkey % 7) as title, 'd' || o_orderkey as description, 'c/' || (o_custkey % 50) as file, o_orderkey % 97 + 1 as line_start, o_orderkey % 97 + 3 as line_end, 'x.' || o_orderstatus as rule, ['static', 'ai'][(o_orderkey // 60) % 2 + 1] as source from orders)"""


@query(f"with {FOUND} select 'total' as kind, 'all' as name, count(*) as n from found union all select 'severity', severity, count(*) from found group by severity union all select 'category', category, count(*) from found group by category")
def summary(spark, d):
    return findings.summary(_findings(spark, d))


@query(f"with {FOUND} select count(*) filter (where severity in ('high', 'critical')) > 0 as fails from found")
def threshold(spark, d):
    return findings.above(_findings(spark, d), "high")


@query(f"with {FOUND} select category, severity, confidence, file, line_start, rule from found where confidence <> 'low' and category in ('bug', 'vulnerability')")
def min_confidence(spark, d):
    return findings.kept(_findings(spark, d), "medium", ["bug", "vulnerability"]).select("category", "severity", "confidence", "file", "line_start", "rule")


@query(
    f"""with {FOUND}, r as (select *, row_number() over (order by list_position(['info', 'low', 'medium', 'high', 'critical'], severity) desc, list_position(['low', 'medium', 'high'], confidence) desc, category, string_split(file, '/'), line_start, line_end, case source when 'static' then 0 else 1 end, rule, title, description) as k from found)
select (case category when 'bug' then 'BUG' when 'quality' then 'QUAL' when 'solid' then 'SOLID' else 'VULN' end) || '-' || case when k < 1000 then lpad(cast(k as varchar), 3, '0') else cast(k as varchar) end as id, category, severity, file, line_start, title, description from r"""
)
def finding_ids(spark, d):
    return findings.numbered(_findings(spark, d)).select("id", "category", "severity", "file", "line_start", "title", "description")


@query(f"with {FOUND} select lower(regexp_replace(substring(rule, 3), '[^A-Za-z0-9]', '', 'g')) as norm, count(*) as n, cast(sum(strlen(title) + strlen(description) + strlen(file) + strlen(rule)) as bigint) as bytes from found group by 1")
def rule_names(spark, d):
    return _findings(spark, d).groupBy(findings.normal_rule(F.col("rule")).alias("norm")).agg(F.count("*").alias("n"), F.sum(findings.retained_bytes()).alias("bytes"))


#: A fold in order, all groups side by side: a step takes the next finding of each group into the list of kept ones.
MERGED = f"""with recursive {FOUND},
f as (select *, cast(substring(description, 2) as bigint) as key, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) as sev, list_position(['low', 'medium', 'high'], confidence) as conf from found),
n as (select *, case when key % 3 = 0 then 's' || key end as snippet, case when key % 5 = 0 then 'u' || key end as hint,
  row_number() over (partition by category, file, rule order by sev desc, conf desc, line_start, line_end, case source when 'static' then 0 else 1 end, title, description) as k from f),
fold as (
  select distinct category, file, rule, cast(0 as bigint) as k, cast([] as struct(key bigint, source varchar, first bigint, last bigint, sev bigint, conf bigint, snippet varchar, hint varchar)[]) as kept from n
  union all
  select category, file, rule, k, case when spot = 0 then list_append(kept, item) else kept[:spot - 1] || [case when kept[spot].source = 'static'
      then {{'key': kept[spot].key, 'source': kept[spot].source, 'first': kept[spot].first, 'last': kept[spot].last, 'sev': greatest(kept[spot].sev, item.sev), 'conf': greatest(kept[spot].conf, item.conf), 'snippet': coalesce(kept[spot].snippet, item.snippet), 'hint': coalesce(kept[spot].hint, item.hint)}}
      else {{'key': item.key, 'source': item.source, 'first': item.first, 'last': item.last, 'sev': greatest(kept[spot].sev, item.sev), 'conf': greatest(kept[spot].conf, item.conf), 'snippet': coalesce(item.snippet, kept[spot].snippet), 'hint': coalesce(item.hint, kept[spot].hint)}} end] || kept[spot + 1:] end
  from (select n.category, n.file, n.rule, n.k, fold.kept, {{'key': n.key, 'source': n.source, 'first': n.line_start, 'last': n.line_end, 'sev': n.sev, 'conf': n.conf, 'snippet': n.snippet, 'hint': n.hint}} as item,
    coalesce(list_position(list_transform(fold.kept, lambda x: x.source <> n.source and x.first <= n.line_end and n.line_start <= x.last), true), 0) as spot
    from fold join n on fold.category = n.category and fold.file = n.file and fold.rule = n.rule and fold.k + 1 = n.k)),
ends as (select unnest(arg_max(kept, k)) as x from fold group by category, file, rule)
select category, ['info', 'low', 'medium', 'high', 'critical'][x.sev] as severity, title, description, file, line_start, line_end, x.snippet as code_snippet, x.hint as suggestion, rule, ['low', 'medium', 'high'][x.conf] as confidence, x.source as source
from ends join f on f.key = x.key"""


@query(MERGED)
def merge_pipelines(spark, d):
    key = F.expr("cast(substring(description, 2) as long)")
    rows = _findings(spark, d).withColumns({"code_snippet": F.when(key % 3 == 0, F.concat(F.lit("s"), key.cast("string"))), "suggestion": F.when(key % 5 == 0, F.concat(F.lit("u"), key.cast("string")))})
    return findings.merge_sources(rows)


@query(
    f"""with recursive {FOUND}, m as (select * replace (case when key % 6 = 0 then null else rule end as rule, case when key % 11 <> 0 then case when key % 13 = 0 then line_end else line_start end end as line_start, case when key % 11 <> 0 then case when key % 13 = 0 then line_start else line_end end end as line_end)
  from (select *, cast(substring(description, 2) as bigint) as key from found)),
n as (select *, least(line_start, line_end) as a, greatest(line_start, line_end) as z, row_number() over (partition by file order by key) as k from m where line_start is not null),
fold as (select distinct file, cast(0 as bigint) as k, cast([] as struct(a bigint, z bigint, rule varchar, title varchar)[]) as kept, '' as title, cast(null as varchar) as rule, cast(0 as bigint) as line_start, cast(0 as bigint) as line_end, false as stays from n
  union all
  select file, k, case when stays then list_append(kept, {{'a': a, 'z': z, 'rule': rule, 'title': title}}) else kept end, title, rule, line_start, line_end, stays
  from (select n.*, fold.kept, len(list_filter(fold.kept, lambda x: x.a <= n.z and n.a <= x.z and coalesce(x.rule = n.rule, (x.rule is null or n.rule is null) and x.title = n.title))) = 0 as stays
    from fold join n on fold.file = n.file and fold.k + 1 = n.k))
select file, title, rule, line_start, line_end from fold where stays union all select file, title, rule, line_start, line_end from m where line_start is null"""
)
def dedupe_within(spark, d):
    """With findings without a rule, without lines, and with lines in the wrong order."""
    key = F.expr("cast(substring(description, 2) as long)")
    start, end = F.col("line_start"), F.col("line_end")
    lines = lambda x, y: F.when(key % 11 != 0, F.when(key % 13 == 0, y).otherwise(x))
    rows = _findings(spark, d).withColumn("ordinal", key).withColumns({"rule": F.when(key % 6 != 0, F.col("rule")), "line_start": lines(start, end), "line_end": lines(end, start)})
    return findings.dedupe_run(rows).select("file", "title", "rule", "line_start", "line_end")


HUNKS = "hunks as (select 'c/' || (s_suppkey % 50) as path, s_suppkey % 90 as start, s_suppkey % 90 + 2 as stop from supplier)"


def _hunks(spark, d):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("c/"), F.pmod(k, F.lit(50)).cast("string")).alias("path"), F.pmod(k, F.lit(90)).alias("start"), (F.pmod(k, F.lit(90)) + 2).alias("end"))


@query(f"with {FOUND}, {HUNKS} select category, file, line_start, line_end, title, description from found where exists (select 1 from hunks where path = file and start <= line_end and line_start <= stop)")
def hunk_overlap(spark, d):
    return coverage.overlapping(_findings(spark, d), _hunks(spark, d)).select("category", "file", "line_start", "line_end", "title", "description")


@query(
    f"""with {HUNKS}, f as (select distinct 'c/' || (c_custkey % 40) as path from customer), g as (select path, bool_or(start < 1) as bad from hunks group by path),
w as (select 'c/' || (40 + n_nationkey % 7) as path, min(n_name) as why from nation group by 1)
select path, case when bad or f.path is null then 'skipped' else 'presented' end as status, case when bad then 'invalid range' when f.path is null then coalesce(why, 'absent') end as reason from g left join f using (path) left join w using (path)"""
)
def changed_coverage(spark, d):
    files = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c/"), F.pmod("c_custkey", F.lit(40)).cast("string")).alias("relative_path"))
    skipped = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("c/"), (F.col("n_nationkey") % 7 + 40).cast("string")).alias("relative_path"), F.col("n_name").alias("reason"))
    return coverage.classify_changes(_hunks(spark, d), files, skipped)


@query(f"with {FILES} select relative_path as path from files where relative_path not in (select relative_path from files where size_bytes % 3 = 0)")
def uninspected(spark, d):
    files = _files(spark, d)
    return coverage.uninspected(files.select(F.col("relative_path").alias("path")), files.filter("size_bytes % 3 = 0").select(F.col("relative_path").alias("path")))


@query(
    """with s as (select l_suppkey as k, datediff('day', date '1970-01-01', cast(l_shipdate as date)) as a, datediff('day', date '1970-01-01', cast(l_shipdate as date)) + cast(l_quantity as int) % 9 as b from lineitem),
o as (select *, case when a > max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from s),
i as (select *, sum(new) over (partition by k order by a, b rows unbounded preceding) as island from o)
select k, cast(min(a) as int) as start, cast(max(b) as int) as stop from i group by k, island"""
)
def interval_union(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), day.alias("start"), (day + F.rint("l_quantity").cast("int") % 9).alias("end"))
    return coverage.interval_union(rows, ["k"]).withColumnRenamed("end", "stop")


@query(
    """with f as (select source || '/' || doc_id % 10 || case when doc_id % 3 = 0 then '/sub/' else '_' end || doc_id || '.py' as relative_path from documents),
d as (select relative_path, regexp_replace(relative_path, '/[^/]*$', '') as directory from f),
n as (select *, coalesce(directory <> lag(directory) over (order by relative_path), true) as new from d)
select relative_path, directory, cast(sum(new::int) over (order by relative_path rows unbounded preceding) as bigint) as run from n"""
)
def shard_runs(spark, d):
    """Folders between the files of others, so that the byte order parts a directory into several runs."""
    k = F.col("doc_id")
    path = F.concat("source", F.lit("/"), (k % 10).cast("string"), F.when(k % 3 == 0, "/sub/").otherwise("_"), k.cast("string"), F.lit(".py"))
    files = corpus.with_language(spark.read.parquet(f"{d}/documents.parquet").select(path.alias("relative_path"), F.lit("").alias("content")))
    return shards.directory_runs(files).select("relative_path", "directory", F.col("run").cast("long").alias("run"))


@query(f"with {FILES} select relative_path, cast(greatest(1, (size_bytes + strlen(relative_path) + strlen(cast(size_bytes // 30 as varchar)) + 12) // 4) as bigint) as tokens, cast(size_bytes // 4 as bigint) as plain from files")
def token_estimates(spark, d):
    return _files(spark, d).select("relative_path", shards.file_tokens().alias("tokens"), text.token_estimate("size_bytes").alias("plain"))


@query(
    f"""with recursive {FILES}, f as (select *, parent as directory, row_number() over (order by relative_path) as place from (select relative_path, size_bytes, split_part(relative_path, '/', 1) as parent,
  greatest(1, (size_bytes + strlen(relative_path) + strlen(cast(size_bytes // 30 as varchar)) + 12) // 4) as tokens from files)),
g as (select *, place - row_number() over (partition by directory order by place) as island from f), h as (select *, sum(tokens) over (partition by directory, island) as total, min(place) over (partition by directory, island) as first from g),
u as (select row_number() over (order by min(place)) as k, unit, sum(tokens) as tokens from (select *, case when total > 16000 then place else first end as unit from h) group by unit),
r(k, shard, used) as (select 0::bigint, 0::bigint, 0::hugeint union all select u.k, case when used > 0 and used + tokens > 16000 then shard + 1 else shard end, case when used > 0 and used + tokens > 16000 then tokens else used + tokens end from r join u on u.k = r.k + 1)
select relative_path, cast(h.tokens as bigint) as tokens, shard as shard_id from h join u on u.unit = case when total > 16000 then place else first end join r on r.k = u.k"""
)
def shard_pack(spark, d):
    return shards.pack_shards(_files(spark, d), 16_000)


@query(
    f"""with {FILES}, s as (select relative_path, size_bytes, sum(size_bytes) over (order by relative_path rows unbounded preceding) as used from files)
select relative_path, size_bytes, cast(case when used > 200000 then 200000 - (used - size_bytes) end as bigint) as room from s where used <= 200000 or (used - size_bytes <= 200000 and 200000 - (used - size_bytes) >= 8)"""
)
def stop_at_budget(spark, d):
    return shards.stop_at_budget(_files(spark, d).select("relative_path", "size_bytes"), ["relative_path"], "size_bytes", 200_000)


@query(
    f"""with recursive {FILES}, f as (select relative_path, size_bytes, row_number() over (order by relative_path) as k from files),
r(k, n, used, ok) as (select 0::bigint, 0, 0::hugeint, false union all select f.k, n + (n < 400 and used + size_bytes <= 500000)::int, used + case when n < 400 and used + size_bytes <= 500000 then size_bytes else 0 end, n < 400 and used + size_bytes <= 500000 from r join f on f.k = r.k + 1)
select relative_path, size_bytes from f join r using (k) where ok"""
)
def admit_each(spark, d):
    return shards.admit_each(_files(spark, d).select("relative_path", "size_bytes"), ["relative_path"], "size_bytes", 400, 500_000)


@query(
    """with c as (select conv_id, turn, case turn % 3 when 1 then 'tool' else role end as role, repeat(text, 4) as text from conversations),
m as (select *, row_number() over (partition by conv_id order by turn) as place, count(*) over (partition by conv_id) as n from c)
select conv_id, turn, role, case when n <= 5 or place = 1 or place > n - 4 then text when role = 'tool' and strlen(text) > 500 then '[tool result removed]'
  when role <> 'tool' and strlen(text) > 2000 then substring(text, 1, list_max(list_filter(range(0, 501), lambda k: strlen(substring(text, 1, k)) <= 500))) || ' [text shortened]' else text end as text from m"""
)
def compact_conversation(spark, d):
    """Turns of four times their length, a third of them results of tools, so that all three cases occur."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role")).alias("role"), F.repeat("text", F.lit(4)).alias("text"))
    return context.compact(rows)


@query(
    """with m as (select conv_id, turn, strlen(coalesce(text, '')) as size, row_number() over (partition by conv_id order by turn) as place from conversations),
a as (select *, coalesce(sum(case when place > 1 then size else 0 end) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as after from m)
select conv_id, turn, cast(case when place = 1 then least(size, greatest(1000, 4000 - after)) else least(size, greatest(0, 4000 - 1000 - after)) end as bigint) as granted from a"""
)
def allocate_context(spark, d):
    return context.allocate(spark.read.parquet(f"{d}/conversations.parquet"), 4000)


RAW = "(select page_id, case page_id % 4 when 0 then substring(url, 9) when 1 then './' || substring(url, 9) || '//x' when 2 then replace(substring(url, 9), '/', '\\') else '../' || substring(url, 9) end as raw from pages)"


@query(
    f"""with r as {RAW}, p as (select page_id, raw, list_filter(string_split(replace(raw, '\\', '/'), '/'), lambda x: x not in ('', '.')) as parts from r)
select page_id, case when e is null then array_to_string(parts, '/') end as normalized, e as error from (select *, case when contains(raw, ':') then 'colon' when starts_with(replace(raw, '\\', '/'), '/') then 'absolute' when list_contains(parts, '..') then 'parent' end as e from p)"""
)
def path_normalize(spark, d):
    k, u = F.col("page_id"), F.substring("url", 9, 100000)
    raw = F.when(k % 4 == 0, u).when(k % 4 == 1, F.concat(F.lit("./"), u, F.lit("//x"))).when(k % 4 == 2, F.replace(u, F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.lit("../"), u))
    normal, error = paths.normalized(F.col("raw"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", raw.alias("raw")).select("page_id", normal.alias("normalized"), error.alias("error"))


_DIRS, _ENDS = ["src", *corpus.EXCLUDED_DIRS, ".GIT", ".Ssh"], ["", ".py", ".min.js", ".BUNDLE.js", *(f".{e}" for e in corpus.EXCLUDED_EXTENSIONS), ".PNG"]
_NAMES = ["", "/.env", "/.env.local", "/.environment", "/id_rsa", "/id_rsa.pub", "/.netrc"]
_list = lambda values: "[" + ", ".join(map(_quoted, values)) + "]"
MADE = f"""made as (select page_id, {_list(_DIRS)}[page_id % {len(_DIRS)} + 1] || '/' || substring(url, 9) || case when page_id % 11 = 3 then {_list(_NAMES)}[page_id % {len(_NAMES)} + 1] else {_list(_ENDS)}[page_id % {len(_ENDS)} + 1] end as p from pages)"""


@query(
    f"""with {MADE}, q as (select page_id, string_split(p, '/') as parts, list_extract(string_split(p, '/'), -1) as name from made)
select page_id, len(list_filter(parts, lambda x: list_contains({_list(corpus.PROTECTED_DIRS)}, lower(x)))) > 0 as protected, len(list_filter(parts[:-2], lambda x: list_contains({_list(corpus.EXCLUDED_DIRS)}, x))) > 0 as directory,
  list_contains({_list(corpus.EXCLUDED_EXTENSIONS)}, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1))) or {" or ".join(f"ends_with(lower(name), '{x}')" for x in corpus.EXCLUDED_SUFFIXES)} as ending,
  list_contains({_list(corpus.SENSITIVE_NAMES)}, name) or starts_with(name, '.env.') as sensitive from q"""
)
def exclusion_flags(spark, d):
    k = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    made = F.concat(pick(_DIRS), F.lit("/"), F.expr("substring(url, 9)"), F.when(k % 11 == 3, pick(_NAMES)).otherwise(pick(_ENDS)))
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", made.alias("p"))
    return rows.select("page_id", *(c.alias(n) for n, c in corpus.exclusion_flags(F.col("p")).items()))


ESCAPED = "replace(replace(replace(regexp_replace({}, '([\\\\`*_{{}}\\[\\]()#+\\-.!|=~])', '\\\\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"with {FILES} select relative_path, replace(replace({ESCAPED.format('content')}, chr(9), '\\u{{9}}'), chr(13), '\\u{{d}}') as shown from files")
def markdown_escape(spark, d):
    return _files(spark, d).select("relative_path", text.markdown_block("content").alias("shown"))


@query("select conv_id, turn, replace(replace(replace(coalesce(text, ''), chr(10), '\\u{a}'), chr(9), '\\u{9}'), chr(13), '\\u{d}') as shown, strlen(replace(replace(replace(coalesce(text, ''), chr(10), '\\u{a}'), chr(9), '\\u{9}'), chr(13), '\\u{d}')) <= 200 as whole from conversations")
def sanitized(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", text.sanitize("t").alias("shown"), (text.sanitize_bounded("t", 200) == text.sanitize("t")).alias("whole"))


@query(
    f"""with {FILES}, {LINES}, s as (select relative_path, content, ls[2] as part from arrays where len(ls) > 1 and ls[2] <> ''),
p as (select *, strpos(content, part) as pos from s)
select relative_path, cast(case when strpos(substring(content, pos + len(part)), part) = 0 then 1 + len(substring(content, 1, pos - 1)) - len(replace(substring(content, 1, pos - 1), chr(10), '')) end as bigint) as first_line from p"""
)
def exact_once(spark, d):
    rows = _files(spark, d).select("relative_path", "content", F.try_element_at(text.lines("content"), F.lit(2)).alias("part")).filter("part <> ''")
    return rows.select("relative_path", text.once_lines("content", "part")[0].alias("first_line"))


@query(
    f"""with {FILES}, c as (select relative_path, content, list_max(list_filter(range(1, 89), lambda k: strlen(substring(content, 1, k)) <= 86)) as k from files)
select relative_path, case when strlen(content) <= 100 then content else substring(content, 1, coalesce(k, 0)) || '…[truncated]' end as cut from c"""
)
def truncated(spark, d):
    return _files(spark, d).select("relative_path", text.truncate_marked("content", 100).alias("cut"))


_KNOWN = [(e, language) for language, ends in languages.EXTENSIONS.items() for e in ends.split()]
_SHEBANGS = [("#!/usr/bin/env python3", "python"), ("#!/usr/bin/node", "javascript"), ("#!/bin/bash -e", "bash"), ("#!/bin/sh", "bash"), ("#!/usr/bin/ruby", "ruby"), ("#!/usr/bin/perl", "perl"), ("python", None), ("#!/bin/zig", None)]


@query(
    f"""with p as (select p_partkey as k, {_list([e for e, _ in _KNOWN])}[p_partkey % {len(_KNOWN)} + 1] as ending, {_list([x for _, x in _KNOWN])}[p_partkey % {len(_KNOWN)} + 1] as by_ending, p_partkey % 3 as how,
  [{", ".join("null" if x is None else _quoted(x) for _, x in _SHEBANGS)}][p_partkey % {len(_SHEBANGS)} + 1] as by_line from part)
select k, case how when 0 then by_ending when 1 then by_line else case when k % 2 = 0 then 'dockerfile' end end as language from p"""
)
def language_detect(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    name = F.when(k % 3 == 0, F.concat(F.regexp_replace("p_name", "[./]", " "), F.lit("."), F.when(k % 2 == 0, F.upper(pick([e for e, _ in _KNOWN]))).otherwise(pick([e for e, _ in _KNOWN])))).when(k % 3 == 1, F.lit("run")).otherwise(F.when(k % 2 == 0, "Dockerfile").otherwise("dockerfile"))
    line = F.when(k % 3 == 1, pick([x for x, _ in _SHEBANGS])).otherwise("")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), languages.detect(F.concat(F.lit("a.b/"), name), line).alias("language"))


@query(
    """with t as (select cast(conv_id as varchar) as stream_id, turn, role, coalesce(text, '') as text, strlen(coalesce(text, '')) as size from conversations),
n as (select *, sum((role = 'assistant')::int) over (partition by stream_id order by turn) as nth from t),
calls as (select stream_id, nth, '{"id":"c' || min(turn) || '","name":"' || arg_max('f' || turn, turn) || '","arguments":"{' || chr(92) || '"n' || chr(92) || '":' || string_agg(cast(size as varchar), '' order by turn) || '}"}' as call from n where role = 'assistant' or role = 'user' and nth > 0 group by stream_id, nth)
select stream_id, coalesce(string_agg(case when role <> 'assistant' then text else '' end, '' order by turn), '') as text,
  (select coalesce('[' || string_agg(call, ',' order by nth) || ']', '[]') from calls c where c.stream_id = n.stream_id) as calls,
  case when bool_or(role = 'assistant') then 'tool_use' when max(stream_id::bigint) % 3 = 0 then 'max_tokens' else 'end_turn' end as stop_reason,
  true as complete, max(stream_id::bigint) % 5 = 0 as malformed, cast(null as varchar) as error, cast(count(*) as bigint) as input_tokens, cast(max(turn) as bigint) as output_tokens
from n group by stream_id"""
)
def sse_fold(spark, d):
    """Turns as chunks that cut their lines: texts, calls whose arguments go on in the user's turns, finish reasons, usage, and
    lines that are no UTF-8."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    size, turn = F.octet_length("text").cast("string"), F.col("turn").cast("string")
    chats = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumns({"nth": F.sum((F.col("role") == "assistant").cast("int")).over(chats), "until": F.lead(F.col("role") == "assistant", 1, True).over(chats)})
    lines = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    call = lambda *x: lines('data: {"choices":[{"delta":{"tool_calls":[{', *x, '}]}}]}\n')
    end = F.when(F.col("until"), call('"function":{"arguments":"}"}')).otherwise("")
    begin = call('"id":"c', turn, '","function":{"name":"f', turn, '","arguments":"{\\"n\\":', size, '"}')
    goes_on = call('"function":{"name":"","arguments":"', size, '"}')
    said = lines("data:", F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))), "\r\n\ndata: \n : note\n")
    asked = F.when((F.col("role") == "user") & (F.col("nth") > 0), goes_on).otherwise("")
    # A name of a call is replaced by the one that comes last.
    name = F.when((F.col("role") == "user") & (F.col("nth") > 0), call('"function":{"arguments":""},"index":', (F.col("nth") - 1).cast("string"))).otherwise("")
    rename = F.when((F.col("role") == "user") & (F.col("nth") > 0), call('"index":', (F.col("nth") - 1).cast("string"), ',"function":{"name":"f', turn, '"}')).otherwise("")
    body = F.when(F.col("role") == "assistant", lines(begin, end)).otherwise(lines(said, asked, name, rename, F.when(F.col("nth") > 0, end).otherwise("")))
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    n = F.count("*").over(Window.partitionBy("conv_id")).cast("string")
    closing = lines('  data: {"choices":[{"finish_reason":"', F.when(F.col("conv_id") % 3 == 0, "length").otherwise("stop"), '"}],"usage":{"prompt_tokens":', n, ',"completion_tokens":', turn, "}}\ndata: [DONE]\ndata: {\n")
    bad = F.when(F.col("conv_id") % 5 == 0, F.unhex(F.lit("646174613A20FF0A"))).otherwise(F.lit("").cast("binary"))
    chunk = F.concat(bad, F.encode(lines(body, F.when(F.col("turn") == last, closing).otherwise("")), "UTF-8"))
    halves = F.explode(F.array(F.struct((2 * F.col("turn")).alias("seq"), F.substring("chunk", 1, 45).alias("chunk")), F.struct((2 * F.col("turn") + 1).alias("seq"), F.substring("chunk", 46, 1 << 30).alias("chunk"))))
    cut = rows.withColumn("chunk", chunk).select(F.col("conv_id").cast("string").alias("stream_id"), halves.alias("h")).select("stream_id", "h.seq", "h.chunk")
    calls = F.to_json(F.transform("tool_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"))))
    return events.fold_streams(cut).withColumn("calls", calls).drop("tool_calls")


@query(
    """with p as (select p_partkey as k, p_partkey % 6 as how, p_size as n from part)
select k as diff_id, case how when 4 then null when 1 then 'new ' || k || '.rs' when 5 then 'src/d' || k else 'src/a' || k || '.rs' end as path,
  cast(case when how in (2, 4, 5) then null else n + 1 end as bigint) as start, cast(case when how in (2, 4, 5) then null else n + 2 end as bigint) as stop, case how when 4 then 'quoted path without end' end as error from p
union all select k, 'src/a' || k || '.rs', n + 20, n + 20, null from p where how = 3"""
)
def diff_parse(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    how = F.pmod(k, F.lit(6))
    name = F.concat(F.lit("src/a"), k.cast("string"), F.lit(".rs"))
    hunk = F.concat(F.lit("@@ -1,2 +"), (F.col("p_size") + 1).cast("string"), F.lit(",2 @@ fn\n x\n-y\n+++ z\n"))
    again = F.concat(F.lit("@@ -9 +"), (F.col("p_size") + 20).cast("string"), F.lit(" @@\n-a\n+b\n"))
    both = F.concat(F.lit("diff --git a/x b/x\n--- a/"), name, F.lit("\t2024\n+++ b/"), name, F.lit("\n"))
    quoted = F.concat(F.lit('--- /dev/null\n+++ "b/new\\040'), k.cast("string"), F.lit('.rs"\r\n'))
    text_ = F.when(how == 1, F.concat(quoted, hunk)).when(how == 2, F.concat(both, F.lit("@@ -1,2 +0,0 @@\n-x\n-y\n"))).when(how == 3, F.concat(both, hunk, again)).when(how == 4, F.concat(F.lit('--- "a/x\n+++ "b/'), n, F.lit("\n"))).when(how == 5, F.concat(F.lit("--- a/src/d"), k.cast("string"), F.lit("\n+++ /dev/null\n"))).otherwise(F.concat(both, hunk))
    out = diff.hunks(spark.read.parquet(f"{d}/part.parquet").select(k.alias("diff_id"), text_.alias("diff")))
    return out.select("diff_id", "path", "start", F.col("end").alias("stop"), "error")


@query("select 'f' || (p_partkey % 20) as path, p_partkey % 50 as start, p_partkey % 50 + p_partkey % 7 - 1 as stop from part where p_partkey % 50 > 0 and p_partkey % 7 > 0")
def hunk_ranges(spark, d):
    k = F.col("p_partkey")
    line = F.format_string("@@ -1,%d +%d,%d @@ fn", k, k % 50, k % 7)
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("f"), (k % 20).cast("string")).alias("path"), line.alias("line"))
    return diff.header_ranges(rows).withColumnRenamed("end", "stop")


_IGNORED = [("", "gitignore", "# all folders\n*.js\n!f1*.js\nbuild/\n"), ("d1", "gitignore", "!*.js\n"), ("d2", "ignore", "*.py\n!f2*\n"), ("d3", "gitignore", "/src/\n"), ("", "exclude", "*.min\n"), ("d4", "ignore", "!*.min\n"), ("d9", "ignore", "*\n")]


@query(
    """with p as (select o_orderkey as k, o_orderkey % 5 as d, ['build', 'src', 'keep'][o_orderkey % 3 + 1] as folder, 'f' || o_orderkey as stem, ['.js', '.tmp', '.py', '.min'][o_orderkey % 4 + 1] as ending from orders),
v as (select *, case when d = 2 and starts_with(stem, 'f2') then false when d = 2 and ending = '.py' then true when d = 4 and ending = '.min' then false end as by_ignore,
  case when ending = '.js' then d <> 1 and not starts_with(stem, 'f1') end as by_git, case when ending = '.min' then true end as by_exclude from p)
select 'd' || d || '/' || folder || '/' || stem || ending as relative_path from v where folder <> 'build' and not (d = 3 and folder = 'src') and not coalesce(by_ignore, by_git, by_exclude, false)"""
)
def ignore_rules(spark, d):
    """Paths that the ignore files of their folders keep."""
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    path = F.concat(F.lit("d"), F.pmod(k, F.lit(5)).cast("string"), F.lit("/"), pick(["build", "src", "keep"]), F.lit("/f"), k.cast("string"), pick([".js", ".tmp", ".py", ".min"]))
    files = spark.read.parquet(f"{d}/orders.parquet").select(path.alias("relative_path"))
    return ignore.kept(files, spark.createDataFrame(_IGNORED, "folder string, kind string, content string"))


# --- coverage, evidence, archives, admission over the tables ---------------------------------------------------------


@query(
    f"""with {FILES}, c as (select case when size_bytes % 7 = 0 then '../' || relative_path when size_bytes % 7 = 1 then 'none/' || relative_path else relative_path end as path from files)
select path, case when starts_with(path, '..') or f.relative_path is null or size_bytes % 2 = 0 then 'skipped' else 'inspectable' end as status, case when starts_with(path, '..') then 'unsafe path' when f.relative_path is null then 'absent' when size_bytes % 2 = 0 then 'excluded by filters' end as reason from c left join files f on f.relative_path = c.path"""
)
def changed_files(spark, d):
    files, p = _files(spark, d), F.col("relative_path")
    odd = F.col("size_bytes") % 7
    changed = files.select(F.when(odd == 0, F.concat(F.lit("../"), p)).when(odd == 1, F.concat(F.lit("none/"), p)).otherwise(p).alias("path"))
    return coverage.changed_coverage(changed, files, files.filter("size_bytes % 2 <> 0"))


@query(f"with {FILES} select count(*) as presented, count(*) - count(*) filter (size_bytes % 5 = 0) as inspected, count(*) filter (size_bytes % 5 = 0) as skipped, count(*) filter (size_bytes % 5 = 0) = 0 as complete from files")
def scan_status(spark, d):
    files = _files(spark, d)
    return coverage.scan_status(files, files.filter("size_bytes % 5 = 0").select("relative_path", F.lit("parse failure").alias("reason"))).select(*(F.col(c).cast("long") for c in ("presented", "inspected", "skipped")), "complete")


@query(f"with {FILES} select count(*) filter (size_bytes % 5 = 0) as failed, count(*) filter (size_bytes % 7 = 0) as skipped, count(*) filter (size_bytes % 11 = 0) as uninspected, cast(2 as bigint) as omitted, false as complete from files")
def scan_completeness(spark, d):
    files = _files(spark, d)
    return coverage.completeness(files.filter("size_bytes % 5 = 0"), files.filter("size_bytes % 7 = 0"), files.filter("size_bytes % 11 = 0"), 2)


@query(
    f"""with {FILES}, p as (select relative_path as path, size_bytes % 3 = 0 as read, size_bytes % 2 = 0 as skip from files)
select path, case when not skip or read then 'presented' else 'skipped' end as status from p"""
)
def reconciled(spark, d):
    files = _files(spark, d).withColumnRenamed("relative_path", "path")
    seen, left = coverage.reconciled(files.filter("size_bytes % 2 <> 0"), files.filter("size_bytes % 2 = 0").select("path"), files.filter("size_bytes % 3 = 0"))
    return seen.select("path", F.lit("presented").alias("status")).union(left.select("path", F.lit("skipped")))


@query(
    f"""with {FILES}, {LINES}, s as (select relative_path, content, len(ls) as n, size_bytes, case when size_bytes % 3 = 0 and len(ls) > 1 then ls[2] when size_bytes % 3 = 1 and len(ls) > 0 then ls[1] end as part from arrays),
p as (select *, strpos(content, part) as pos from s), o as (select *, part <> '' and strpos(substring(content, pos + len(part)), part) = 0 as once, 1 + len(substring(content, 1, pos - 1)) - len(replace(substring(content, 1, pos - 1), chr(10), '')) as line from p)
select relative_path as file, case when part is not null and not once then 'snippet does not occur exactly once' when part is null and 4 > n then 'lines outside the file' end as problem,
  cast(case when part is null then 2 when once then line end as bigint) as line_start, cast(case when part is null then 4 when once then line end as bigint) as line_end from o"""
)
def evidence(spark, d):
    files = _files(spark, d)
    lines = text.lines("content")
    part = F.when((F.col("size_bytes") % 3 == 0) & (F.size(lines) > 1), F.try_element_at(lines, F.lit(2))).when((F.col("size_bytes") % 3 == 1) & (F.size(lines) > 0), F.try_element_at(lines, F.lit(1)))
    rows = findings.shaped(files, file=F.col("relative_path"), title="t", description="d", code_snippet=part, line_start=2, line_end=4)
    return coverage.evidence(rows, files).select("file", "problem", "line_start", "line_end")


@query("select cast(l_orderkey as bigint) as k, string_agg(case when l_linenumber % 2 = 0 then cast(l_linenumber as varchar) else l_linenumber || '-' || (l_linenumber + l_orderkey % 5 + 1) end, ', ' order by l_linenumber, l_orderkey % 5) as shown from (select distinct l_orderkey, l_linenumber from lineitem) group by l_orderkey")
def ranges_shown(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("long").alias("start")).distinct()
    end = F.when(F.col("start") % 2 == 0, F.col("start")).otherwise(F.col("start") + F.col("l_orderkey") % 5 + 1)
    per = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("start", end.alias("end")))).alias("r"))
    return per.select(F.col("l_orderkey").cast("long").alias("k"), text.render_ranges("r").alias("shown"))


_ODD = ["a/b.txt", "/abs", "a\\b", "C:x", "a/../b", "//", "ok/" * 130 + "x", "link", "big", "dense", "same", "same"]
_PROBLEMS = [None, "absolute", "backslash", "drive", "dot component", "absolute", "too deep", "link or special file", "entry too large", "compression ratio", "duplicate", "duplicate"]


@query(
    f"""with p as (select p_partkey as k, p_partkey // {len(_ODD)} as g, p_partkey % {len(_ODD)} as i from part), q as (select *, count(*) filter (i in ({len(_ODD) - 2}, {len(_ODD) - 1})) over (partition by g) as same, count(distinct case i when 1 then 'abs' when 3 then 'C:x' when 5 then null else 'top' end) over (partition by g) > 1 as mixed from p)
select cast(g as bigint) as archive_id, k, case when i = 0 or i >= {len(_ODD) - 2} and same < 2 then case when mixed then 'more than one top-level folder' end else [{", ".join("null" if x is None else _quoted(x) for x in _PROBLEMS)}][i + 1] end as problem from q"""
)
def archive_preflight(spark, d):
    k = F.col("p_partkey")
    i = F.pmod(k, F.lit(len(_ODD)))
    raw = F.element_at(F.array(*map(F.lit, _ODD)), (i + 1).cast("int"))
    name = F.when(i.isin(1, 3, 5), raw).otherwise(F.concat(F.lit("top/"), raw))
    entries = spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("k"),
        F.floor(k / len(_ODD)).cast("long").alias("archive_id"),
        name.alias("name"),
        F.when(i == 8, F.lit(200 << 20)).when(i == 9, F.lit(2 << 20)).otherwise(F.lit(10)).cast("long").alias("size"),
        F.lit(5).cast("long").alias("compressed"),
        F.when(i == 7, F.lit(0o120777)).otherwise(F.lit(0o100644)).alias("mode"),
        F.lit(False).alias("is_dir"),
        F.when(i.isin(1, 3, 5), F.lit("odd")).otherwise(F.lit("top")).alias("_"),
    )
    found = archives.preflight(entries.drop("k", "_"))
    keyed = entries.select("k", "archive_id", "name").dropDuplicates(["k"])
    first = found.groupBy("archive_id", "name").agg(F.min("problem").alias("problem"))
    return keyed.join(first, ["archive_id", "name"]).select("archive_id", "k", "problem")


@query("select c_custkey as k, cast(greatest(c_custkey * 977 // 100 * 15, 8000) as bigint) as signatures, cast(greatest(c_custkey * 977 // 100 * 40, 16000) as bigint) as contents from customer")
def token_budgets(spark, d):
    context = F.col("c_custkey") * 977
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), text.signature_budget(context).alias("signatures"), text.shard_budget(context).alias("contents"))


@query(
    f"""with {FOUND}, n as (select count(*) as n, cast(sum(strlen(title) + strlen(description) + strlen(file) + strlen(rule) + case category when 'bug' then 4 when 'solid' then 6 else 5 end) as bigint) as fixed from found)
select n, cast(fixed + (select sum(greatest(3, length(cast(k as varchar)))) from range(1, n + 1) t(k)) as bigint) as bytes from n"""
)
def retained(spark, d):
    rows = findings.numbered(_findings(spark, d))
    return rows.agg(F.count("*").alias("n"), F.sum(findings.retained_bytes(True)).alias("bytes"))


@query(
    f"""with {FOUND}, s as (select o.*, o.line_start % 50 as submission from found o) select cast(submission as bigint) as submission, count(*) as n, case when count(*) > 1000 then 'too many findings' when min(case when confidence = 'low' and severity = 'info' then 'x' end) is not null then 'title is empty' end as problem from s group by submission"""
)
def submissions(spark, d):
    rows = _findings(spark, d).withColumn("submission", F.pmod("line_start", F.lit(50)))
    empty = rows.withColumn("title", F.when((F.col("confidence") == "low") & (F.col("severity") == "info"), " ").otherwise(F.col("title")))
    return findings.submitted(empty)
