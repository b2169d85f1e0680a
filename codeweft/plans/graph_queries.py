"""The graph engine's queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name, dir_name, normal_path, top_dir
from ..functions.text import ascii_lower, ascii_upper, lines, search_tokens, short_commit, strip, url_decode
from ..operators import calls as C
from ..operators import cypher, report
from ..operators import graph as G
from ..operators import imports as I
from ..operators import symbols as S
from ..operators import verbs as V
from ..session import cut
from ..sources import scan, store
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()

#: The symbols that the example queries ask about; every graph of the driver's tables has them.
HUB = "Function:platform-core/src/log/logger.ts:emitLine:12"
QUERY = "load graph store platform-core/src/log"


def q(name: str, sql: str | None = None) -> Callable:
    return REGISTRY.add(name, sql)


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- sources ----------------------------------------------------------------------------------------------------------

_NAME = "lower(regexp_extract(replace(path, '\\', '/'), '[^/]*$'))"
_IN_DIR = f"len(list_intersect(list_slice(string_split(replace(path, '\\', '/'), '/'), 1, len(string_split(replace(path, '\\', '/'), '/')) - 1), [{_in(scan.IGNORED_DIRS)}])) > 0"
_IGNORED = (
    f"({_IN_DIR} or {_NAME} in ({_in(scan.IGNORED_FILES)}) or regexp_matches({_NAME}, '(?:{'|'.join(chr(92) + e for e in scan.IGNORED_ENDINGS)})$')"
    f" or contains({_NAME}, '.bundle.') or contains({_NAME}, '.chunk.') or contains({_NAME}, '.generated.') or ends_with({_NAME}, '.d.ts'))"
)


def _language_sql(path: str = "path") -> str:
    whens = " ".join(f"when regexp_matches(lower({path}), '(?:{'|'.join(chr(92) + e for e in ends.split())})$') then '{name}'" for name, ends in scan.LANGUAGE_ENDINGS.items())
    return f"case {whens} end"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanned_files").select("path").distinct()


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """What a scan keeps, each file once, by its latest row."""
    rows = table(spark, d, "scanned_files")
    return scan.scan_table(rows.groupBy("file_id", "path").agg(F.max_by("size_bytes", "scanned_at").alias("size_bytes")))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, content, language) with separators in the normal form, as it lies; files that come twice are told apart by what is extracted."""
    rows = table(spark, d, "code_files").where("content is not null").select("repo", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "content")
    return rows.withColumn("language", scan.language_of(F.col("path")))


_CODE_SQL = f"code as (select repo, replace(path, '\\', '/') as path, min(content) as content, {_language_sql("replace(path, '\\', '/')")} as language from code_files where content is not null group by 1, 2)"
_LINES_SQL = _CODE_SQL + ", lines as (select repo, path, language, unnest(string_split_regex(content, '\\r?\\n')) as raw, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as line_no from code)"
_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(12288)"


@q("src_ignore_path", f"select distinct path, {_IGNORED} as ignored from scanned_files")
def src_ignore_path(spark, d):
    return _paths(spark, d).select("path", scan.ignored_path(F.col("path")).alias("ignored"))


@q("src_dir_prune", f"select distinct path, {_IN_DIR} as pruned from scanned_files")
def src_dir_prune(spark, d):
    return _paths(spark, d).select("path", scan.in_ignored_dir(F.col("path")).alias("pruned"))


@q("src_language", f"select distinct path, {_language_sql()} as language from scanned_files")
def src_language(spark, d):
    return _paths(spark, d).select("path", scan.language_of(F.col("path")).alias("language"))


@q("src_capability", f"select language, count(*) as n_files, language is not null as symbols, coalesce(language in ({_in(scan.IMPORT_LANGUAGES)}), false) as imports, coalesce(language in ({_in(scan.CALL_LANGUAGES)}), false) as relations from (select distinct path, {_language_sql()} as language from scanned_files) group by 1")
def src_capability(spark, d):
    rows = src_language(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
    return rows.select("language", "n_files", F.inline(F.array(scan.capability(F.col("language")))))


_SCAN_SQL = f"kept as (select *, coalesce(size_bytes > {scan.MAX_FILE_BYTES}, false) as skipped_large, {_language_sql()} as language_found from (select file_id, path, arg_max(size_bytes, scanned_at) as size_bytes from scanned_files group by 1, 2) where not {_IGNORED})"


@q("src_scan", f"with {_SCAN_SQL} select file_id, path, size_bytes, skipped_large, language_found from kept")
def src_scan(spark, d):
    return _scan(spark, d).select("file_id", "path", "size_bytes", "skipped_large", "language_found")


@q("agg_language", f"with {_SCAN_SQL} select language_found as language, count(*) as n_files from kept where language_found is not null and not skipped_large group by 1")
def agg_language(spark, d):
    return _scan(spark, d).where("language_found is not null and not skipped_large").groupBy(F.col("language_found").alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


# ---- row generators ---------------------------------------------------------------------------------------------------


def _symbols_sql() -> str:
    rules = ", ".join(f"('{lang}', '{k} ', '{label}')" for lang in S.RULES for k, label in S.rules(lang))
    return (
        _LINES_SQL + f""", rules(language, kw, label) as (values {rules}),
    stripped as (select path, language, line_no, trim(raw, {_WHITE}) as line from lines),
    hit as (select s.*, r.label, r.kw, instr(s.line, r.kw) as spot from stripped s join rules r using (language) where contains(s.line, r.kw)),
    named as (select *, regexp_extract(ltrim(substr(line, spot + length(kw)), {_WHITE}), '^([A-Za-z0-9_$]+)', 1) as name from hit where spot = 1 or not regexp_matches(substr(line, spot - 1, 1), '^[A-Za-z0-9_]$')),
    symbols as (select distinct label || ':' || path || ':' || name || ':' || line_no as id, label, name, path as file_path, line_no as start_line, language from named where name != '')"""
    )


def _symbols(spark, d):
    """Symbols, cut: they are far smaller than the content and are used several times."""
    return cut(S.symbols(_code(spark, d)))


@q("gen_symbols", f"with {_symbols_sql()} select * from symbols")
def gen_symbols(spark, d):
    return _symbols(spark, d)


_QUOTED = "coalesce(nullif(trim(regexp_extract({0}, '''([^'']*)''', 1)), ''), nullif(trim(regexp_extract({0}, '\"([^\"]*)\"', 1)), ''))"
_JS_SQL = f"""with {_LINES_SQL}, js as (select path, line_no, trim(raw, {_WHITE}) as line from lines where language in ('typescript', 'javascript')),
found as (select path, line_no, case when starts_with(line, 'import ') or (starts_with(line, 'export ') and contains(line, ' from ')) then {_QUOTED.format('line')}
  when contains(line, 'require(') then {_QUOTED.format("substr(line, instr(line, 'require(') + 8)")} end as specifier from js where not starts_with(line, '//'))
select * from found where specifier is not null"""


@q("gen_js_imports", _JS_SQL)
def gen_js_imports(spark, d):
    return I.import_specifiers(_code(spark, d).where("language in ('typescript', 'javascript')")).select("path", "line_no", "specifier")


@q(
    "gen_go_imports",
    f"""with {_LINES_SQL}, go as (select path, line_no, trim(raw, {_WHITE}) as line from lines where language = 'go'),
    marked as (select *, ltrim(regexp_replace(line, '^(import)+', '')) as rest, starts_with(line, 'import') and starts_with(ltrim(regexp_replace(line, '^(import)+', '')), '(') as opens from go where line != '' and not starts_with(line, '//')),
    state as (select *, coalesce(last_value(case when opens then 1 when starts_with(line, ')') then 0 end ignore nulls) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0) as inside from marked),
    found as (select path, line_no, case when inside = 1 then case when not starts_with(line, ')') then {_QUOTED.format('line')} end when starts_with(line, 'import') and not starts_with(rest, '(') then {_QUOTED.format('rest')} end as specifier from state)
    select * from found where specifier is not null""",
)
def gen_go_imports(spark, d):
    return I.import_specifiers(_code(spark, d).where("language = 'go'")).select("path", "line_no", "specifier")


@q("gen_php_use")
def gen_php_use(spark, d):
    return I.import_specifiers(_code(spark, d).where("language = 'php'")).select("path", "line_no", "specifier")


@q(
    "gen_csharp_using",
    f"""with {_LINES_SQL}, cs as (select path, line_no, trim(raw, {_WHITE}) as line from lines where language = 'csharp'),
    a as (select path, line_no, trim(regexp_replace(regexp_replace(line, '^(using )+', ''), ';+$', '')) as body from cs where starts_with(line, 'using ')),
    b as (select path, line_no, case when starts_with(body, 'static ') then trim(substr(body, 8)) else body end as body from a where body != '' and not starts_with(body, '(')),
    c as (select path, line_no, case when contains(body, '=') then trim(substr(body, instr(body, '=') + 1)) else body end as specifier from b)
    select * from c where regexp_full_match(specifier, '[A-Za-z0-9_.:<>]*')""",
)
def gen_csharp_using(spark, d):
    return I.import_specifiers(_code(spark, d).where("language = 'csharp'")).select("path", "line_no", "specifier")


@q("gen_calls")
def gen_calls(spark, d):
    return C.call_sites(_code(spark, d))


@q("gen_js_routes")
def gen_js_routes(spark, d):
    return C.js_routes(_code(spark, d))


@q("gen_laravel")
def gen_laravel(spark, d):
    return C.laravel_routes(_code(spark, d))


@q(
    "gen_path_tree",
    """with f as (select distinct replace(path, '\\', '/') as path from scanned_files), p as (select path, string_split(path, '/') as parts, unnest(generate_series(1, len(string_split(path, '/')))) as i from f),
    t as (select distinct array_to_string(parts[1:i], '/') as p, case when i = len(parts) then 'File' else 'Folder' end as label, i, parts[i] as name, array_to_string(parts[1:i - 1], '/') as up from p)
    select label || ':' || p as id, label, name, p as file_path, case when i > 1 then 'Folder:' || up end as parent_id from t""",
)
def gen_path_tree(spark, d):
    return G.path_tree(table(spark, d, "scanned_files").select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")))


@q(
    "gen_suffix_index",
    "with f as (select distinct repo, replace(path, '\\', '/') as path from scanned_files), p as (select repo, path, string_split(path, '/') as parts, unnest(generate_series(1, len(string_split(path, '/')))) as i from f) select repo, array_to_string(parts[i:], '/') as suffix, min(path) as path from p group by 1, 2",
)
def gen_suffix_index(spark, d):
    return I.suffix_index(table(spark, d, "scanned_files").select("repo", F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct())


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@q("gen_tokens", f"select token, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(list_filter(string_split_regex({_LOWER.format('text')}, '[^A-Za-z0-9_$/]+'), lambda x: length(x) >= 2)) as token from documents where text is not null) group by 1")
def gen_tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(search_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_NODES_SQL = "n as (select id, unnest(arg_max({label: label, name: name, file_path: file_path, start_line: start_line, language: language}, row(loaded_at, label, name, file_path, start_line, language))) from nodes where id is not null and deleted_at is null group by id)"
_EDGES_SQL = "e as (select id, unnest(arg_max({source_id: source_id, target_id: target_id, rel_type: rel_type, confidence: confidence, reason: reason}, edge_no)) from edges where id is not null and source_id is not null and target_id is not null group by id)"
_SYMBOL = "label not in ('File', 'Folder', 'Community', 'Process')"


def _nodes(spark, d):
    return G.current_nodes(table(spark, d, "nodes"))


def _edges(spark, d):
    return G.current_edges(table(spark, d, "edges"))


@q(
    "gen_snippet",
    f"""with {_CODE_SQL}, {_NODES_SQL}, j as (select n.id, start_line, string_split_regex(content, '\\r?\\n') as l from n join code on code.path = n.file_path where {_SYMBOL.replace('label', 'n.label')})
    select id, array_to_string(l[least(greatest(coalesce(start_line, 1) - 3, 0), len(l)) + 1 : least(greatest(coalesce(start_line, 1) - 3, 0), len(l)) + 25], chr(10)) as snippet from j""",
)
def gen_snippet(spark, d):
    return V.snippets(_nodes(spark, d), _code(spark, d))


_ALONE = "'(^|[^A-Za-z0-9_$])filter([^A-Za-z0-9_$]|$)'"


@q(
    "gen_rename_edits",
    f"with {_LINES_SQL} select path, line_no, trim(raw, {_WHITE}) as old_text, trim(regexp_replace(regexp_replace(raw, {_ALONE}, '\\1sift\\2', 'g'), {_ALONE}, '\\1sift\\2', 'g'), {_WHITE}) as new_text from lines where regexp_matches(raw, {_ALONE})",
)
def gen_rename_edits(spark, d):
    return V.rename_edits(_code(spark, d), "filter", "sift")


# ---- predicates and scalar functions --------------------------------------------------------------------------------------

_TEST = "(" + " or ".join(f"contains(lower(file_path), '{s}')" for s in ("/__tests__/", "/__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", ".test.", ".spec.", "/test_", "/conftest.")) + " or ends_with(lower(file_path), '_test.go') or ends_with(lower(file_path), '_test.py'))"


@q("flt_test_path", f"select distinct file_path, {_TEST} as is_test from nodes where file_path is not null")
def flt_test_path(spark, d):
    return table(spark, d, "nodes").where("file_path is not null").select("file_path", G.is_test_path(F.col("file_path")).alias("is_test")).distinct()


@q("flt_relation_conf", "select edge_no, rel_type, confidence from edges where rel_type in ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS') and coalesce(confidence, 1.0) >= 0.7")
def flt_relation_conf(spark, d):
    return G.filtered_edges(table(spark, d, "edges"), min_confidence=0.7).select("edge_no", "rel_type", "confidence")


@q("flt_symbol_label", f"select label, count(*) as n from nodes where {_SYMBOL} group by 1")
def flt_symbol_label(spark, d):
    return table(spark, d, "nodes").where(G.is_symbol(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@q("str_ascii_lower", f"select doc_id, md5({_LOWER.format('text')}) as lowered, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) as raised from documents")
def str_ascii_lower(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(ascii_lower(F.col("text"))).alias("lowered"), F.md5(ascii_upper(F.col("text"))).alias("raised"))


@q("str_strip", f"select doc_id, md5(trim(text, {_WHITE} || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287))) as stripped from documents")
def str_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(strip(F.col("text"))).alias("stripped"))


@q("str_url_decode", "select distinct path, url_decode(replace(replace(replace(replace(path, '/', '%2F'), '.', '%2e'), '-', '%2D'), '_', '%5f')) as decoded from scanned_files")
def str_url_decode(spark, d):
    c = F.col("path")
    for a, b in (("/", "%2F"), (".", "%2e"), ("-", "%2D"), ("_", "%5f")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return _paths(spark, d).select("path", url_decode(c).alias("decoded"))


@q("str_short_commit", "select name, path, indexed_at, case when coalesce(last_commit, '') = '' then 'unknown' else left(last_commit, 7) end as short_commit from registry")
def str_short_commit(spark, d):
    return table(spark, d, "registry").select("name", "path", "indexed_at", short_commit(F.col("last_commit")).alias("short_commit"))


_NORMAL = "array_to_string(coalesce(list_reduce(list_prepend(cast([] as varchar[]), list_transform(list_filter(string_split(replace(target_file, '\\', '/'), '/'), lambda x: x not in ('', '.')), lambda x: [x])), lambda a, x: case when x[1] = '..' then a[1:greatest(len(a) - 1, 0)] else list_concat(a, x) end), []), '/')"


@q("pth_normalize", f"select import_no, case when target_file is not null then {_NORMAL} end as target_file from imports")
def pth_normalize(spark, d):
    return table(spark, d, "imports").select("import_no", normal_path(F.col("target_file")).alias("target_file"))


@q("pth_parts", "with f as (select distinct replace(path, '\\', '/') as path from scanned_files) select path, regexp_extract(path, '[^/]*$') as base, regexp_replace(path, '/?[^/]*$', '') as dir, string_split(path, '/')[1] as top from f")
def pth_parts(spark, d):
    c = F.col("path")
    return _paths(spark, d).select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct().select("path", base_name(c).alias("base"), dir_name(c).alias("dir"), top_dir(c).alias("top"))


@q("jsn_get", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def jsn_get(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- resolution joins -----------------------------------------------------------------------------------------------------


def _repo_paths(spark, d):
    return _code(spark, d).select("repo", "path").distinct()


def _imports(spark, d):
    code = _code(spark, d)
    paths = cut(code.select("repo", "path").distinct())
    return cut(I.resolve_imports(I.import_specifiers(code, "repo"), paths))


@q("join_import_resolve")
def join_import_resolve(spark, d):
    return _imports(spark, d)


@q(
    "join_import_relative",
    f"""with {_LINES_SQL}, spec as ({_JS_SQL.partition('with ')[2].replace(_LINES_SQL + ', ', '', 1).replace('js as', 'with js as', 1)}),
    rel as (select distinct c.repo, s.path, c.language, s.specifier, array_to_string(list_reduce(list_prepend(cast([] as varchar[]), list_transform(list_filter(string_split(regexp_replace(s.path, '/?[^/]*$', '') || '/' || s.specifier, '/'), lambda x: x not in ('', '.')), lambda x: [x])), lambda a, x: case when x[1] = '..' then a[1:greatest(len(a) - 1, 0)] else list_concat(a, x) end), '/') as base
      from spec s join code c using (path) where starts_with(s.specifier, '.')),
    ends(language, rank, e) as (values {', '.join(f"('{lang}', {i}, '{e}')" for lang in ('typescript', 'javascript') for i, e in [(0, ''), *[(1 + i, e) for i, e in enumerate(I.ENDINGS[lang])], *[(100 + i, '/index' + e) for i, e in enumerate(I.ENDINGS[lang])]])})
    select distinct repo, source_file, target_file from (select r.repo, r.path as source_file, r.specifier, arg_min(c.path, rank) as target_file from rel r join ends using (language) join code c on c.repo = r.repo and c.path = r.base || e group by 1, 2, 3)""",
)
def join_import_relative(spark, d):
    code = _code(spark, d)
    spec = I.import_specifiers(code.where("language in ('typescript', 'javascript')"), "repo").where("specifier like '.%'")
    return I.resolve_imports(spec, code.select("repo", "path").distinct())


@q("join_import_configured")
def join_import_configured(spark, d):
    """Resolution with a project's own configuration: aliases, base folder, module, namespaces."""
    config = I.ProjectConfig(base="src", aliases=(("@/", "src/"), ("~/", "lib/")), go_module="example.com/app", psr4=(("App\\", "src/"),), csharp=(("src", "Acme.App"), ("", "Acme")))
    code = _code(spark, d)
    return I.resolve_imports(I.import_specifiers(code, "repo"), cut(code.select("repo", "path").distinct()), config)


@q(
    "join_import_dir",
    f"""with {_CODE_SQL}, p as (select repo, path, string_split(path, '/') as parts, case when ends_with(path, '.go') then 'go' when ends_with(path, '.php') then 'php' when ends_with(path, '.cs') then 'csharp' end as language from code),
    f as (select repo, language, path, array_to_string(parts[1:i], '/') as folder, parts[i] as leaf from (select *, unnest(generate_series(1, len(parts) - 1)) as i from p where language is not null and len(parts) > 1)),
    r as (select *, case when path = folder || '/' || leaf || case language when 'go' then '.go' when 'php' then '.php' else '.cs' end then 0 when ends_with(path, '_test.go') then 2 else 1 end as rank from f)
    select repo, language, folder, arg_min(path, row(rank, path)) as path from r group by 1, 2, 3""",
)
def join_import_dir(spark, d):
    return I.folder_modules(_repo_paths(spark, d))


@q(
    "join_caller_asof",
    f"with {_symbols_sql()}, sites as (select distinct path, line_no from lines where language in ('typescript', 'javascript') and contains(raw, 'return')), f as (select id, file_path, start_line from symbols where label in ('Function', 'Class'))"
    " select a.path, a.line_no, arg_max(f.id, row(f.start_line, f.id)) as caller_id from sites a join f on f.file_path = a.path and f.start_line <= a.line_no group by 1, 2",
)
def join_caller_asof(spark, d):
    code = _code(spark, d)
    at = lines(code.where("language in ('typescript', 'javascript')"), "path").where("contains(line, 'return')").select("path", "line_no", F.lit("return").alias("callee")).distinct()
    return C.callers(at, S.symbols(code)).select("path", "line_no", "caller_id")


@q("join_callee")
def join_callee(spark, d):
    code = _code(spark, d)
    return C.calls(code, _symbols(spark, d), _imports(spark, d))


@q("join_heritage")
def join_heritage(spark, d):
    code = _code(spark, d)
    return C.heritage(code, _symbols(spark, d), _imports(spark, d))


@q("join_routes")
def join_routes(spark, d):
    code = _code(spark, d)
    return C.route_calls(code, _symbols(spark, d), _imports(spark, d))


@q("join_endpoint_semi", f"with {_NODES_SQL}, {_EDGES_SQL} select id from e where source_id in (select id from n) and target_id in (select id from n)")
def join_endpoint_semi(spark, d):
    return G.with_endpoints(_edges(spark, d), _nodes(spark, d)).select("id")


@q("join_edge_nodes", f"with {_NODES_SQL}, {_EDGES_SQL} select e.id, s.name as source_name, s.label as source_label, t.name as target_name, t.label as target_label from e join n s on s.id = e.source_id join n t on t.id = e.target_id")
def join_edge_nodes(spark, d):
    n = _nodes(spark, d)
    ends = lambda side: n.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
    return _edges(spark, d).select("id", "source_id", "target_id").join(ends("source"), "source_id").join(ends("target"), "target_id").select("id", "source_name", "source_label", "target_name", "target_label")


_CHANGED = ["src/log/logger.ts", "platform-core/src/http/client.ts", "lib\\util", "no/such/file.py"]


def _changed(spark):
    return spark.createDataFrame([(x,) for x in _CHANGED], "file string")


_CHANGED_SQL = f"c as (select replace(unnest([{_in(_CHANGED)}]), '\\', '/') as file)"


@q("join_changed_theta", f"with {_NODES_SQL}, {_CHANGED_SQL} select id, file_path from n where {_SYMBOL} and exists (select 1 from c where contains(replace(n.file_path, '\\', '/'), file) or contains(file, replace(n.file_path, '\\', '/')))")
def join_changed_theta(spark, d):
    return V.changed_symbols(_nodes(spark, d), _changed(spark)).select("id", "file_path")


@q("join_repo_hint", "with r as (select name, path, lower(name) = 'platform-core' as exact from registry where lower(name) = 'platform-core' or path = 'platform-core' or contains(lower(name), 'platform-core') or contains(lower(path), 'platform-core')) select distinct name, path, exact from r where exact or not exists (select 1 from r where exact)")
def join_repo_hint(spark, d):
    return store.find_repos(table(spark, d, "registry"), "platform-core").select("name", "path", "exact").distinct()


@q("src_registry_latest", "select path, arg_max(name, row(try_cast(indexed_at as timestamptz), indexed_at)) as name, max(indexed_at) as indexed_at from registry group by 1")
def src_registry_latest(spark, d):
    return store.latest_registry(table(spark, d, "registry")).select("path", "name", "indexed_at")


def _components_sql(name: str, links: str) -> str:
    """A recursive term (id, comp) of the components of links (u, v), both ways; comp is the smallest id."""
    return f"""{name}(id, comp) using key (id) as (select distinct u, u from {links} union select l.v, min(c.comp) from {name} c join {links} l on l.u = c.id join recurring.{name} o on o.id = l.v where c.comp < o.comp group by l.v)"""


_FLOWS_SQL = f"""calls as (select distinct source_id as s, target_id as t from e where rel_type = 'CALLS' and source_id != target_id), both_ways as (select s as u, t as v from calls union all select t, s from calls), {_components_sql('cc', 'both_ways')},
    degree as (select t, count(*) as n from calls group by 1), members as (select comp as component, id, coalesce(n, 0) as in_degree from cc left join degree on t = id),
    heads as (select component, coalesce(min(id) filter (in_degree = 0), min(id)) as entry_symbol_id, count(*) as symbol_count from members group by 1),
    reached(id, component, depth) using key (id) as (select entry_symbol_id, component, 0 from heads union select c.t, min(r.component), min(r.depth) + 1 from reached r join calls c on c.s = r.id left join recurring.reached o on o.id = c.t where o.id is null group by c.t),
    flows as (select 'process_' || row_number() over (order by component) as id, entry_symbol_id, symbol_count, step_count, component from heads join (select component, cast(max(depth) + 1 as bigint) as step_count from reached group by 1) using (component)),
    steps as (select flows.id as process_id, members.id as symbol_id, row_number() over (partition by flows.id order by members.id) as step_index, step_count from members join flows using (component))"""
_MODULES_SQL = f"""links as (select distinct s.file_path as src, t.file_path as dst from e join n s on s.id = source_id join n t on t.id = target_id where rel_type in ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS') and s.file_path is not null and t.file_path is not null),
    links_both as (select src as u, dst as v from links union all select dst, src from links), {_components_sql('mc', 'links_both')}, modules as (select 'community_' || dense_rank() over (order by comp) as id, id as file_path from mc)"""


# ---- graph ----------------------------------------------------------------------------------------------------------------


@q("grf_current_nodes", f"with {_NODES_SQL} select id, label, name, file_path, start_line, language from n")
def grf_current_nodes(spark, d):
    return _nodes(spark, d)


@q(
    "grf_nodes",
    f"""with {_symbols_sql()}, p as (select path, language, string_split(path, '/') as parts, unnest(generate_series(1, len(string_split(path, '/')))) as i from code),
    t as (select distinct array_to_string(parts[1:i], '/') as p, case when i = len(parts) then 'File' else 'Folder' end as label, parts[i] as name, case when i = len(parts) then language end as language from p)
    select label || ':' || p as id, label, name, p as file_path, cast(null as bigint) as start_line, language from t union all select id, label, name, file_path, start_line, language from symbols""",
)
def grf_nodes(spark, d):
    code = _code(spark, d)
    return G.build_nodes(code.select("path", "language"), S.symbols(code))


@q("grf_edges")
def grf_edges(spark, d):
    code = _code(spark, d)
    symbols, imports = _symbols(spark, d), _imports(spark, d)
    calls = C.calls(code, symbols, imports).unionByName(C.route_calls(code, symbols, imports))
    return G.build_edges(code.select("path"), symbols, imports, calls, C.heritage(code, symbols, imports), G.build_nodes(code.select("path", "language"), symbols))


@q(
    "agg_degree",
    f"""with {_EDGES_SQL}, c as (select source_id as s, target_id as t from e where rel_type = 'CALLS'), d as (select s as id, 0 as i, 1 as o from c union all select t, 1, 0 from c),
    b as (select distinct s as id, t as x from c where s != t union select distinct t, s from c where s != t)
    select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, (select count(distinct x) from b where b.id = d.id) as n_neighbours from d group by id""",
)
def agg_degree(spark, d):
    return G.degrees(_edges(spark, d))


@q("grf_process_members", f"with recursive {_EDGES_SQL}, {_FLOWS_SQL} select component, id, in_degree from members")
def grf_process_members(spark, d):
    return G.process_members(_edges(spark, d))


@q("grf_processes", f"with recursive {_EDGES_SQL}, {_FLOWS_SQL} select id, entry_symbol_id, symbol_count, step_count, component from flows")
def grf_processes(spark, d):
    return G.processes(cut(_edges(spark, d)))


@q("grf_communities", f"with recursive {_NODES_SQL}, {_EDGES_SQL}, {_MODULES_SQL} select id, file_path from modules")
def grf_communities(spark, d):
    return G.communities(_edges(spark, d), _nodes(spark, d))


@q(
    "agg_community_label",
    f"with recursive {_NODES_SQL}, {_EDGES_SQL}, {_MODULES_SQL}, counts as (select id, string_split(file_path, '/')[1] as dir, count(*) as k from modules group by 1, 2) select id, cast(sum(k) as bigint) as file_count, arg_max(dir, row(k, dir)) as heuristic_label from counts group by 1",
)
def agg_community_label(spark, d):
    return G.community_labels(grf_communities(spark, d))


@q(
    "agg_module_edges",
    f"""with recursive {_NODES_SQL}, {_EDGES_SQL}, {_MODULES_SQL}, m as (select n.id, coalesce(modules.id, 'unknown') as module from n left join modules using (file_path))
    select s.module as src_module, t.module as dst_module, count(*) as n_edges from e join m s on s.id = source_id join m t on t.id = target_id where rel_type in ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS') and s.module != t.module group by 1, 2""",
)
def agg_module_edges(spark, d):
    nodes, edges = cut(_nodes(spark, d)), cut(_edges(spark, d))
    return G.module_edges(edges, nodes, cut(G.communities(edges, nodes)))


@q("top_module_edges", REGISTRY.sql["agg_module_edges"] + " order by n_edges desc, src_module, dst_module limit 20")
def top_module_edges(spark, d):
    return report.top_module_edges(agg_module_edges(spark, d))


@q("agg_fallback_communities", f"with {_NODES_SQL}, f as (select distinct string_split(file_path, '/')[1] as top, file_path from n where label = 'File' and file_path is not null) select 'community_' || dense_rank() over (order by top) as id, file_path from f")
def agg_fallback_communities(spark, d):
    """Communities of a graph without any link between files."""
    return G.communities(_edges(spark, d).where("false"), _nodes(spark, d).where("file_path is not null"))


@q(
    "agg_stats",
    f"with {_SCAN_SQL}, {_NODES_SQL}, {_EDGES_SQL} select (select count(*) from kept where not skipped_large) as total_files, (select count(*) from kept where language_found is not null and not skipped_large) as parseable_files, (select count(*) from kept where skipped_large) as skipped_large,"
    f" (select count(*) from n) as n_nodes, (select count(*) from n where {_SYMBOL}) as n_symbols, (select count(*) from e) as n_edges",
)
def agg_stats(spark, d):
    return G.statistics(_scan(spark, d), _nodes(spark, d), _edges(spark, d))


def _impact_sql(near: str, far: str, start: str = f"select '{HUB}' as id") -> str:
    step = lambda k: f"""s{k} as (select h.{far} as id, arg_min({{rel_type: h.rel_type, confidence: h.confidence}}, h.id) as by_edge from h join {f's{k - 1}' if k > 1 else 's0'} p on h.{near} = p.id join a on a.id = h.{far} where {' and '.join(f'h.{far} not in (select id from s{j})' for j in range(k))} group by 1)"""
    return f"""with {_NODES_SQL}, {_EDGES_SQL}, h as (select * from e where rel_type in ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS') and coalesce(confidence, 1.0) >= 0.5),
    a as (select * from n where {_SYMBOL} and not coalesce({_TEST}, false)), s0 as ({start}), {step(1)}, {step(2)}, {step(3)}
    select x.id, depth, name, label, file_path, by_edge.rel_type as rel_type, by_edge.confidence as confidence from (select *, 1 as depth from s1 union all select *, 2 from s2 union all select *, 3 from s3) x join a on a.id = x.id"""


@q("grf_impact_up", _impact_sql("target_id", "source_id"))
def grf_impact_up(spark, d):
    return V.impact(_nodes(spark, d), _edges(spark, d), HUB, min_confidence=0.5)


@q("grf_impact_down", _impact_sql("source_id", "target_id", "select source_id as id from e where rel_type = 'CALLS' group by 1 order by count(*) desc, 1 limit 1"))
def grf_impact_down(spark, d):
    """From the symbol that calls most."""
    edges = cut(_edges(spark, d))
    start = edges.where("rel_type = 'CALLS'").groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()
    return V.impact(_nodes(spark, d), edges, start["source_id"] if start else "", upstream=False, min_confidence=0.5)


@q("grf_impact_target", f"with {_NODES_SQL} select id, file_path from n where {_SYMBOL} and name = 'emitLine' order by file_path, id limit 1")
def grf_impact_target(spark, d):
    return V.impact_target(_nodes(spark, d), "emitLine").select("id", "file_path")


@q(
    "grf_context",
    f"""with {_NODES_SQL}, {_EDGES_SQL}, ends as (select 'incoming' as direction, lower(rel_type) as rel_type, source_id as uid, min(id) as edge_id from e where target_id = '{HUB}' group by all
      union all select 'outgoing', lower(rel_type), target_id, min(id) from e where source_id = '{HUB}' group by all),
    r as (select direction, rel_type, uid, name, file_path, label as kind, row_number() over (partition by direction, rel_type order by edge_id) as place from ends join n on n.id = uid)
    select direction, rel_type, uid, name, file_path, kind from r where place <= 30""",
)
def grf_context(spark, d):
    return V.context(_nodes(spark, d), _edges(spark, d), HUB)


def _steps(spark, d, edges=None):
    """The steps of the flows."""
    edges = cut(_edges(spark, d)) if edges is None else edges
    members = cut(G.process_members(edges))
    return cut(G.process_steps(G.processes(edges, members), members))


@q(
    "grf_step_order",
    f"with recursive {_EDGES_SQL}, {_FLOWS_SQL} select flows.id as process_id, members.id as symbol_id, row_number() over (partition by flows.id order by members.id != entry_symbol_id, members.id) as step_index, step_count from members join flows using (component)",
)
def grf_step_order(spark, d):
    edges = cut(_edges(spark, d))
    members = cut(G.process_members(edges))
    return G.process_steps(G.processes(edges, members), members, entry_first=True)


@q("grf_process_steps", f"with recursive {_EDGES_SQL}, {_FLOWS_SQL} select * from steps")
def grf_process_steps(spark, d):
    return _steps(spark, d)


@q(
    "grf_detect_changes",
    f"with recursive {_NODES_SQL}, {_EDGES_SQL}, {_FLOWS_SQL}, {_CHANGED_SQL}, x as (select id, name from n where {_SYMBOL} and exists (select 1 from c where contains(replace(n.file_path, '\\', '/'), file) or contains(file, replace(n.file_path, '\\', '/')))) select process_id, max(step_count) as step_count, count(*) as n_steps, min(step_index) as first_step from steps join x on x.id = symbol_id group by 1",
)
def grf_detect_changes(spark, d):
    return V.affected_by_change(_nodes(spark, d), _changed(spark), _steps(spark, d)).select("process_id", "step_count", "n_steps", F.col("changed_steps")[0]["step"].alias("first_step"))


@q(
    "agg_process_hits",
    f"with recursive imp as ({_impact_sql('target_id', 'source_id')}), {_EDGES_SQL}, {_FLOWS_SQL} select process_id, count(distinct symbol_id) as hits, min(step_index) as broken_at_step, max(step_count) as step_count from steps join imp on imp.id = symbol_id group by 1",
)
def agg_process_hits(spark, d):
    return V.affected_processes(grf_impact_up(spark, d), _steps(spark, d))


@q(
    "agg_module_hits",
    f"with recursive imp as ({_impact_sql('target_id', 'source_id')}), {_NODES_SQL}, {_EDGES_SQL}, {_MODULES_SQL} select modules.id as module, count(*) as hits, case when bool_or(depth = 1) then 'direct' else 'indirect' end as impact from imp join modules using (file_path) group by 1",
)
def agg_module_hits(spark, d):
    nodes, edges = cut(_nodes(spark, d)), cut(_edges(spark, d))
    return V.affected_modules(V.impact(nodes, edges, HUB, min_confidence=0.5), G.communities(edges, nodes))


_RISK_SQL = "case when direct >= 30 or total >= 200 then 'CRITICAL' when direct >= 15 or total >= 100 then 'HIGH' when direct >= 5 or total >= 30 then 'MEDIUM' else 'LOW' end"


@q("agg_risk", f"with {_EDGES_SQL} select target_id, direct, total, {_RISK_SQL} as risk from (select target_id, count(distinct source_id) as direct, count(*) as total from e group by 1)")
def agg_risk(spark, d):
    rows = _edges(spark, d).groupBy("target_id").agg(F.count_distinct("source_id").alias("direct"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("risk", V.risk_of_impact(F.col("direct"), F.lit(0), F.lit(0), F.col("total")))


@q("grf_rename_plan")
def grf_rename_plan(spark, d):
    return V.rename_plan(_code(spark, d), _nodes(spark, d), _edges(spark, d), HUB, "writeLine")


@q(
    "join_member_of",
    f"""with recursive {_NODES_SQL}, {_EDGES_SQL}, {_MODULES_SQL}, {_FLOWS_SQL} select 'MEMBER_OF:' || n.id || '->' || modules.id as id, n.id as source_id, modules.id as target_id, 'MEMBER_OF' as rel_type, cast(1 as double) as confidence, '' as reason from n join modules using (file_path) where {_SYMBOL.replace('label', 'n.label')}
    union all select 'STEP_IN_PROCESS:' || symbol_id || '->' || process_id, symbol_id, process_id, 'STEP_IN_PROCESS', cast(1 as double), cast(step_index as varchar) from steps""",
)
def join_member_of(spark, d):
    nodes, edges = cut(_nodes(spark, d)), cut(_edges(spark, d))
    return G.memberships(G.communities(edges, nodes), _steps(spark, d, edges), nodes)


# ---- search, top-k, patterns ----------------------------------------------------------------------------------------------

_TOKENS = [t for t in QUERY.replace("-", " ").split() if len(t) >= 2]
_SCORE_SQL = " + ".join(f"case when {_LOWER.format('name')} = '{t}' then 12.0 else 6.0 * cast(contains({_LOWER.format('name')}, '{t}') as int) + 2.0 * coalesce(cast(contains({_LOWER.format('file_path')}, '{t}') as int), 0) + cast(contains({_LOWER.format('label')}, '{t}') as int) end" for t in _TOKENS)
_SCORED_SQL = f"scored as (select id, cast({_SCORE_SQL} as double) as score from n where {_SYMBOL})"


@q("top_search_score", f"with {_NODES_SQL}, {_SCORED_SQL} select id, score from scored where score > 0")
def top_search_score(spark, d):
    return V.search_scores(_nodes(spark, d), QUERY).select("id", "score")


@q(
    "top_search_processes",
    f"""with recursive {_NODES_SQL}, {_EDGES_SQL}, {_SCORED_SQL}, {_FLOWS_SQL}, best as (select id, score from scored where score > 0 order by score desc, id limit 150), hits as (select s.*, score from steps s join best on best.id = s.symbol_id),
    ranked as (select process_id, priority, row_number() over (order by priority desc, process_id) as process_rank from (select process_id, sum(score) as priority from hits group by 1) order by priority desc, process_id limit 5)
    select process_id, round(priority, 3) as priority, process_rank, symbol_id, symbol_rank, score, step_index from (select h.process_id, priority, process_rank, symbol_id, row_number() over (partition by h.process_id order by score desc, symbol_id) as symbol_rank, score, step_index from hits h join ranked r on r.process_id = h.process_id) where symbol_rank <= 10""",
)
def top_search_processes(spark, d):
    return V.search(_nodes(spark, d), QUERY, _steps(spark, d))


@q("top_definitions", f"with recursive {_NODES_SQL}, {_EDGES_SQL}, {_SCORED_SQL}, {_FLOWS_SQL}, best as (select id, score from scored where score > 0 order by score desc, id limit 150) select id as symbol_id, score from best where id not in (select symbol_id from steps) order by score desc, id limit 20")
def top_definitions(spark, d):
    return V.definitions(_nodes(spark, d), QUERY, _steps(spark, d))


@q("top_symbol_fts")
def top_symbol_fts(spark, d):
    return V.search_index(cut(V.symbol_index(_nodes(spark, d), _code(spark, d))), "loading graphs from stores", 20)


_ASKED = "['blast', 'radius', 'of', 'the', 'snippet', 'store']"


@q(
    "top_fts_bm25",
    f"""with t as (select doc_id, list_filter(string_split_regex({_LOWER.format('text')}, '[^A-Za-z0-9_$/]+'), lambda x: length(x) >= 2) as terms from documents where text is not null), size as (select count(*) as n, avg(len(terms)) as avg_terms from t),
    hits as (select term, doc_id, any_value(n_terms) as n_terms, count(*) as tf from (select doc_id, len(terms) as n_terms, unnest(list_filter(terms, lambda x: list_contains({_ASKED}, x))) as term from t) group by 1, 2), d as (select term, count(*) as df from hits group by 1)
    select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / avg_terms))), 6) as score from hits join d using (term) cross join size group by 1 order by 2 desc, 1 limit 50""",
)
def top_fts_bm25(spark, d):
    return V.bm25(table(spark, d, "documents"), "doc_id", "text", "blast radius of the snippet store", 50)


_CY = "with " + _NODES_SQL + ", " + _EDGES_SQL


@q("cyp_node", _CY + " select name as \"f.name\", file_path as path from n where lower(label) = 'function' and language = 'python' order by id limit 100")
def cyp_node(spark, d):
    return cypher.run("MATCH (f:Function) WHERE f.language = 'python' RETURN f.name, f.filePath AS path", _nodes(spark, d), _edges(spark, d))


@q("cyp_edge", _CY + " select s.name as caller, t.name as callee, e.confidence as conf from e join n s on s.id = source_id join n t on t.id = target_id where rel_type = 'CALLS' and lower(s.label) = 'class' and contains(lower(t.name), 'line') order by e.id limit 500")
def cyp_edge(spark, d):
    return cypher.run("MATCH (a:Class)-[r:CodeRelation {type: 'CALLS'}]->(b) WHERE b.name CONTAINS 'Line' RETURN a.name AS caller, b.name AS callee, r.confidence AS conf LIMIT 500", _nodes(spark, d), _edges(spark, d))


@q("cyp_count", _CY + " select count(*) as total from e join n s on s.id = source_id join n t on t.id = target_id where rel_type = 'IMPORTS'")
def cyp_count(spark, d):
    return cypher.run("MATCH (a)-[r:CodeRelation {type: 'IMPORTS'}]->(b) RETURN COUNT(*) AS total", _nodes(spark, d), _edges(spark, d))


@q("cyp_contains", _CY + " select id as \"n.id\" from n where contains(lower(name), 'graph') and contains(lower(file_path), 'src/') order by id limit 1000")
def cyp_contains(spark, d):
    return cypher.run("MATCH (n) WHERE n.name CONTAINS 'GRAPH' AND n.filePath CONTAINS 'src/' RETURN n.id LIMIT 1000", _nodes(spark, d), _edges(spark, d))


@q("wiki_overview", f"with {_NODES_SQL} select label, count(*) as n_nodes, count(distinct file_path) as n_files from n group by 1")
def wiki_overview(spark, d):
    return report.overview(_nodes(spark, d))


@q("wiki_files", f"with {_NODES_SQL} select file_path, count(*) as n_symbols from n where {_SYMBOL} and file_path is not null group by 1 order by 2 desc, 1 limit 20")
def wiki_files(spark, d):
    return report.largest_files(_nodes(spark, d))
