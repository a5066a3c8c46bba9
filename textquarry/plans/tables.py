"""Queries over the documents, pages and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import expanded, terms, token_estimate
from ..operators import change, metrics, project, ranking, scans, search, symbols
from ..rules import lines as R
from ..rules import symbols as S
from ..rules.concepts import CONCEPTS, STOP_WORDS
from ..sources.corpus import lines_of
from .common import DOCS, LINES, PAGES, USAGE, doc_files, mark_count, page_files, quoted, table, trimmed, usage, word_count

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


QUERY = "license apache test"
HIT = "path, line_no, {column} AS \"column\", regexp_replace(text, '[ \\t\\r]+$', '') AS text"
POSITION = "length(regexp_extract(text, '^(.*?)(?:{p})', 1)) + 1"


def _search(name: str, pattern: str, java: dict, re2: str, extra: str = "", files: str = DOCS, source=doc_files) -> None:
    p = quoted(re2)
    sql = f"WITH {files}, {LINES} SELECT {HIT.format(column=f'(length(regexp_extract(text, {quoted("^(.*?)(?:" + re2 + ")")}, 1)) + 1)')} FROM lines WHERE regexp_matches(text, {p}) {extra}"
    register(name, lambda s, d: search.search(source(s, d), pattern, **java), sql)


_search("search_literal", "Licensed under", {"ignore_case": False}, "Licensed under")
_search("search_ignore_case", "license", {}, "(?i)license")
_search("search_regex", r"\+1 \([0-9]{3}\) 555", {"regex": True, "ignore_case": False}, r"\+1 \([0-9]{3}\) 555")
_search("search_whole_word", "token", {"whole_word": True, "ignore_case": False}, r"\btoken\b")
_search("search_glob", "License", {"ignore_case": False, "glob": "src1*/**"}, "License", "AND regexp_matches(path, '^src1[^/]*/.*$')")
_search("search_pages", "<h1>", {"ignore_case": False}, "<h1>", files=PAGES, source=page_files)
register(
    "search_per_file_limit",
    lambda s, d: search.search(doc_files(s, d), "that", ignore_case=False, per_file=2),
    f"WITH {DOCS}, {LINES} SELECT path, line_no, \"column\", text FROM (SELECT {HIT.format(column='strpos(text, chr(116) || chr(104) || chr(97) || chr(116))')}, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM lines WHERE contains(text, 'that')) WHERE k <= 2",
)
register(
    "search_context",
    lambda s, d: search.with_context(doc_files(s, d), "License", ignore_case=False).select("path", "line_no", "text", "before", "after"),
    f"WITH {DOCS}, {LINES} SELECT path, line_no, text, before, after FROM (SELECT *, lag(text) OVER (PARTITION BY path ORDER BY line_no) AS before, lead(text) OVER (PARTITION BY path ORDER BY line_no) AS after FROM lines) WHERE contains(text, 'License')",
)
register(
    "find_references",
    lambda s, d: search.references(doc_files(s, d), "token"),
    f"WITH {DOCS}, {LINES} SELECT path, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM lines WHERE regexp_matches(text, '\\btoken\\b') GROUP BY path",
)
register(
    "reference_lines",
    lambda s, d: search.search(doc_files(s, d), "token", ignore_case=False, whole_word=True).select("path", "line_no", "text"),
    f"WITH {DOCS}, {LINES} SELECT path, line_no, regexp_replace(text, '[ \\t\\r]+$', '') AS text FROM lines WHERE regexp_matches(text, '\\btoken\\b')",
)
register(
    "read_range",
    lambda s, d: search.read_range(doc_files(s, d), "src1/1", 2, 4),
    f"WITH {DOCS}, {LINES} SELECT path, line_no, text, count(*) OVER (PARTITION BY path) AS total_lines FROM lines WHERE path = 'src1/1' QUALIFY line_no BETWEEN 2 AND 4",
)
register(
    "read_batch",
    lambda s, d: search.read_batch(doc_files(s, d), ["src0/0", "src2/2", "src3/3"], 3),
    f"WITH {DOCS}, {LINES} SELECT path, line_no, text FROM lines WHERE path IN ('src0/0', 'src2/2', 'src3/3') AND line_no <= 3",
)
register(
    "file_tree",
    lambda s, d: search.file_tree(doc_files(s, d)).select("dir", "name", "depth", "size"),
    f"WITH {DOCS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name, len(string_split(path, '/')) AS depth, strlen(content) AS size FROM files",
)
register(
    "directory_sizes",
    lambda s, d: search.directories(doc_files(s, d)),
    f"WITH {DOCS} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files, count(*) AS files_below, sum(strlen(content))::BIGINT AS bytes_below FROM files GROUP BY 1",
)
register("find_large_files", lambda s, d: search.large_files(doc_files(s, d), 20), f"WITH {DOCS} SELECT path, language, len(string_split(content, chr(10))) AS lines FROM files WHERE len(string_split(content, chr(10))) > 20")

# line rules
RULE = "SELECT path, line_no, text FROM lines WHERE regexp_matches(text, {p})"
for _name, _pattern, _re2 in (("find_todos", R.TODOS, R.TODOS.replace("(?![A-Za-z0-9_])", r"\b")), ("find_debug_logs", R.DEBUG_LOGS, R.DEBUG_LOGS), ("find_secrets", R.SECRETS, R.SECRETS)):
    register(_name, lambda s, d, p=_pattern: scans.line_rule(doc_files(s, d), p), f"WITH {DOCS}, {LINES} {RULE.format(p=quoted('(?i)' + _re2))}")
register("search_pattern_places", lambda s, d: search.search(doc_files(s, d), "under the", ignore_case=False).select("path", "line_no"), f"WITH {DOCS}, {LINES} SELECT path, line_no FROM lines WHERE contains(text, 'under the')")


def _security_sql(files: str) -> str:
    rows = []
    for name, category, severity, pattern, ignore in R.SECURITY:
        p = quoted(("(?i)" if ignore else "") + pattern)
        if "(?!" in pattern:  # the look-ahead as two conditions
            test = r"(regexp_matches(text, 'new\s+Function\s*\(') OR regexp_matches(regexp_replace(text, '\beval\s*\([''\"][^''\"]+[''\"]', '', 'g'), '\beval\s*\('))"
        else:
            test = f"regexp_matches(text, {p})"
        rows.append(f"SELECT path, line_no, {quoted(name)} AS rule, {quoted(category)} AS category, {quoted(severity)} AS severity, substr({trimmed('text')}, 1, 120) AS snippet FROM kept WHERE {test}")
    return f"WITH {files}, {LINES}, kept AS (SELECT * FROM lines WHERE NOT regexp_matches({trimmed('text')}, '^(//|#|\\*)')), findings AS ({' UNION ALL '.join(rows)})"


_RANKS = " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(R.SEVERITIES))
for _name, _files, _source in (("security_scan", DOCS, doc_files), ("security_scan_pages", PAGES, page_files)):
    register(_name, lambda s, d, f=_source: scans.security_scan(f(s, d)), f"{_security_sql(_files)} SELECT * FROM findings")
register("security_by_severity", lambda s, d: scans.severity_histogram(scans.security_scan(doc_files(s, d))), f"{_security_sql(DOCS)} SELECT severity, count(*) AS findings, count(DISTINCT path) AS files, CASE severity {_RANKS} END AS rank FROM findings GROUP BY severity")
register("security_secrets_only", lambda s, d: scans.security_scan(doc_files(s, d), category="secrets", severity="critical"), f"{_security_sql(DOCS)} SELECT * FROM findings WHERE category = 'secrets' AND severity = 'critical'")


def _hook(p: str) -> str:
    return f"count(*) FILTER (regexp_matches(text, {quoted('(?i)' + p)}))"


register("hook_preview", lambda s, d: scans.hook_preview(doc_files(s, d)), f"WITH {DOCS}, {LINES} SELECT {_hook(R.SECRETS)} AS secrets, {_hook(R.DEBUG_LOGS)} AS debug_logs, {_hook(R.TODOS.replace('(?![A-Za-z0-9_])', chr(92) + 'b'))} AS todos FROM lines")

# terms and ranking
CLEAN = "regexp_replace(content, '''[^'']*''|\"[^\"]*\"|`[^`]*`', '', 'g')"
STOP = ", ".join(quoted(w) for w in STOP_WORDS)
TERMS = f"SELECT path, language, content, list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({CLEAN}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' +'), lambda w: length(w) > 2 AND w NOT IN ({STOP}))) AS terms FROM files"
register("tokenize", lambda s, d: doc_files(s, d).select("path", F.explode(terms(F.col("content"))).alias("term")), f"WITH {DOCS} SELECT path, unnest(terms) AS term FROM ({TERMS})")
register(
    "inverse_document_frequency",
    lambda s, d: ranking.inverse_frequency(doc_files(s, d).select(terms(F.col("content")).alias("terms"))).select("term", "df", F.round("idf", 6).alias("idf")),
    f"WITH {DOCS}, t AS ({TERMS}) SELECT term, df, round(ln((SELECT count(*) FROM files) / (1 + df)), 6) AS idf FROM (SELECT unnest(terms) AS term, count(*) AS df FROM t GROUP BY 1)",
)
_WANTED = ", ".join(quoted(w) for w in expanded(QUERY))
register(
    "semantic_search",
    lambda s, d: ranking.concept_search(doc_files(s, d), QUERY, ["path"], text="content").select("path", "score", F.array_join("matched", " ").alias("matched")),
    f"""WITH {DOCS}, t AS ({TERMS}), own AS (SELECT path, list_filter(terms, lambda w: w IN ({_WANTED})) AS terms FROM t),
    idf AS (SELECT term, CASE WHEN ln(n / (1 + df)) = 0 THEN 1 ELSE ln(n / (1 + df)) END AS w FROM (SELECT unnest(terms) AS term, count(*) AS df FROM own GROUP BY 1), (SELECT count(*) AS n FROM files))
    SELECT path, round(sum(w), 6) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM (SELECT path, unnest(terms) AS term FROM own) JOIN idf USING (term) GROUP BY path HAVING sum(w) > 0 ORDER BY score DESC, path LIMIT 20""",
)
_SYNONYMS = ", ".join(f"({quoted(t)}, [{', '.join(map(quoted, synonyms))}])" for c, synonyms in CONCEPTS.items() for t in dict.fromkeys([c, *synonyms]))
register(
    "expand_query",
    lambda s, d: ranking.expanded_queries(table(s, d, "events").select(F.concat_ws(" ", "event_type", F.lit("cache")).alias("query"))),
    f"WITH c(term, synonyms) AS (VALUES {_SYNONYMS}), q AS (SELECT DISTINCT event_type || ' cache' AS query, unnest([event_type, 'cache']) AS term FROM events) SELECT * FROM q UNION SELECT query, unnest(synonyms) FROM q JOIN c USING (term)",
)
register("token_estimates", lambda s, d: doc_files(s, d).select("path", token_estimate(F.col("content")).alias("tokens")), f"WITH {DOCS} SELECT path, ceil(length(content) / 4)::BIGINT AS tokens FROM files")
REGIONS = "regions AS (SELECT path, greatest(1, line_no - 2) AS start_line, line_no + 2 AS end_line FROM lines WHERE contains(text, 'that'))"
register(
    "merge_regions",
    lambda s, d: ranking.merged_regions(ranking.regions_of(doc_files(s, d), "that")),
    f"""WITH {DOCS}, {LINES}, {REGIONS}, marked AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM regions),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked)
    SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM runs GROUP BY path, run""",
)
_PACK = "license token apache"
_rel = " + ".join(f"CASE WHEN contains(lower(path), '{w}') THEN 0.3 ELSE 0 END + least((length(lower(content)) - length(replace(lower(content), '{w}', ''))) / {len(w)} * 0.1, 0.4)" for w in _PACK.split())
register(
    "context_pack",
    lambda s, d: ranking.context_pack(doc_files(s, d), _PACK, 4000),
    f"""WITH RECURSIVE {DOCS}, scored AS (SELECT path, round(least(1, greatest(0, {_rel} + greatest(0, 0.1 - len(string_split(path, '/')) * 0.01)))::DOUBLE, 6) AS score, ceil(length(content) / 4)::BIGINT AS tokens FROM files),
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS k FROM scored WHERE score > 0.2 ORDER BY score DESC, path LIMIT 20),
    fold AS (SELECT 0 AS k, 0::BIGINT AS used, false AS kept UNION ALL SELECT t.k, CASE WHEN used + tokens <= 4000 THEN used + tokens ELSE used END, used + tokens <= 4000 FROM fold f JOIN top t ON t.k = f.k + 1)
    SELECT path, score, tokens, row_number() OVER (ORDER BY t.k) AS rank FROM fold f JOIN top t USING (k) WHERE kept""",
)
# the fold over a file's lines: how many lines the open chunk holds before a line, and whether the line begins a new one
_IS_DEF = f"(regexp_matches({trimmed('text')}, {quoted(ranking.DEFINITION.replace('(?![A-Za-z0-9_])', chr(92) + 'b'))}) OR regexp_matches(text, {quoted(ranking.METHOD)}))"
register(
    "chunks",
    lambda s, d: ranking.chunks(doc_files(s, d)).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_line").alias("end_line")),
    f"""WITH RECURSIVE {DOCS}, {LINES}, marks AS (SELECT path, line_no, {_IS_DEF} AS d FROM lines),
    fold AS (SELECT path, 0::BIGINT AS line_no, 0 AS held, 1 AS chunks FROM files UNION ALL
      SELECT m.path, m.line_no, CASE WHEN (d AND held > {ranking.SOFT}) OR held >= {ranking.HARD} THEN 1 ELSE held + 1 END, chunks + CASE WHEN (d AND held > {ranking.SOFT}) OR held >= {ranking.HARD} THEN 1 ELSE 0 END FROM fold f JOIN marks m ON m.path = f.path AND m.line_no = f.line_no + 1)
    SELECT path, max(chunks)::BIGINT AS chunks, max(line_no)::BIGINT AS end_line FROM fold GROUP BY path""",
)

# symbols of pages by the patterns for any language, over whole texts
register(
    "symbol_names_pages",
    lambda s, d: symbols.symbols(page_files(s, d)).select("path", "name", "kind"),
    f"WITH {PAGES} SELECT DISTINCT path, name, kind FROM ({' UNION ALL '.join(f'SELECT path, {quoted(kind)} AS kind, unnest(regexp_extract_all(content, {quoted(p)}, 1)) AS name FROM files' for lang, kind, p in S.RULES if lang == S.GENERIC)}) WHERE length(name) >= 2",
)
register(
    "symbol_kinds_pages",
    lambda s, d: symbols.symbols(page_files(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files")),
    f"WITH {PAGES}, f AS (SELECT DISTINCT path, name, kind FROM ({' UNION ALL '.join(f'SELECT path, {quoted(kind)} AS kind, unnest(regexp_extract_all(content, {quoted(p)}, 1)) AS name FROM files' for lang, kind, p in S.RULES if lang == S.GENERIC)}) WHERE length(name) >= 2) SELECT kind, count(*) AS symbols, count(DISTINCT path) AS files FROM f GROUP BY kind",
)

# metrics
_complexity = " + ".join([*(word_count("content", w) for w in R.DECISION_WORDS), *(mark_count("content", m) for m in R.DECISION_MARKS)])
_cyclomatic = " + ".join([*(word_count("content", w) for w in R.CYCLOMATIC_WORDS), *(mark_count("content", m) for m in R.CYCLOMATIC_MARKS)])
register("complexity", lambda s, d: doc_files(s, d).select("path", metrics.complexity(F.col("content")).alias("complexity")), f"WITH {DOCS} SELECT path, 1 + {_complexity} AS complexity FROM files")
BALANCE = "(len(text) - len(replace(text, '{', '')) - len(text) + len(replace(text, '}', '')))"
DEPTH = f"""summed AS (SELECT *, sum({BALANCE}) OVER w AS s FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY line_no)) AS depth FROM summed)"""
register("brace_nesting", lambda s, d: metrics.nesting_by_line(lines_of(page_files(s, d))).select("path", "line_no", "depth"), f"WITH {PAGES}, {LINES}, {DEPTH} SELECT path, line_no, depth::BIGINT AS depth FROM deep")
COGNITIVE = f"""cog AS (SELECT path, sum(CASE WHEN regexp_matches(t, '\\b({R.NESTING_WORDS})\\b') THEN 1 + before ELSE 0 END + CASE WHEN regexp_matches(t, '\\belse\\b') AND NOT regexp_matches(t, 'else\\s+if') THEN 1 ELSE 0 END + len(regexp_extract_all(t, '&&|\\|\\|')))::BIGINT AS cognitive
FROM (SELECT path, {trimmed('text')} AS t, lag(depth, 1, 0) OVER (PARTITION BY path ORDER BY line_no) AS before FROM deep) GROUP BY path)"""
register("cognitive_complexity", lambda s, d: metrics.cognitive(lines_of(page_files(s, d))), f"WITH {PAGES}, {LINES}, {DEPTH}, {COGNITIVE} SELECT * FROM cog")
BRACES = """braces AS (SELECT path, generate_subscripts(c, 1) AS line_no, unnest(c) AS text FROM (SELECT path, string_split(regexp_replace(content, '[^{}]', '', 'g'), '') AS c FROM files))"""
MAXNEST = f"""bsum AS (SELECT *, sum({BALANCE}) OVER (PARTITION BY path ORDER BY line_no) AS s FROM braces), nest AS (SELECT path, max(s - least(0, m))::BIGINT AS nesting FROM (SELECT *, min(s) OVER (PARTITION BY path ORDER BY line_no) AS m FROM bsum) GROUP BY path)"""
HEAT = f"""WITH {PAGES}, {LINES}, {DEPTH}, {COGNITIVE}, {BRACES}, {MAXNEST},
m AS (SELECT path, 1 + {_cyclomatic} AS cyclomatic, cognitive, coalesce(nesting, 0) AS nesting, len(string_split(content, chr(10))) AS loc FROM files JOIN cog USING (path) LEFT JOIN nest USING (path)),
heat AS (SELECT *, floor(round((least(100.0::DOUBLE, cyclomatic / 30 * 100) * 0.3::DOUBLE + least(100.0::DOUBLE, cognitive / 50 * 100) * 0.3::DOUBLE + least(100.0::DOUBLE, nesting / 8 * 100) * 0.2::DOUBLE + least(100.0::DOUBLE, loc / 500 * 100) * 0.2::DOUBLE), 9) + 0.5)::BIGINT AS score FROM m),
graded AS (SELECT path, cyclomatic, cognitive, nesting, loc, score, CASE WHEN score <= 20 THEN 'A' WHEN score <= 40 THEN 'B' WHEN score <= 60 THEN 'C' WHEN score <= 80 THEN 'D' ELSE 'F' END AS grade FROM heat)"""


def _heat(s, d):
    files = page_files(s, d)
    return metrics.heatmap(files, lines_of(files))


register("max_nesting", lambda s, d: page_files(s, d).select("path", metrics.max_nesting(F.col("content")).alias("nesting")), f"WITH {PAGES}, {BRACES}, {MAXNEST} SELECT path, coalesce(nesting, 0) AS nesting FROM files LEFT JOIN nest USING (path)")
register("complexity_heatmap", _heat, f"{HEAT} SELECT * FROM graded")
register("heatmap_summary", lambda s, d: metrics.heat_summary(_heat(s, d)), f"{HEAT} SELECT count(*) AS files, floor(avg(score) + 0.5)::BIGINT AS avg_score, count(*) FILTER (grade IN ('D', 'F')) AS hot, count(*) FILTER (grade IN ('A', 'B')) AS healthy FROM graded")
register("language_breakdown", lambda s, d: metrics.language_breakdown(doc_files(s, d)), f"WITH {DOCS} SELECT language, count(*) AS files, floor(count(*) * 100 / (SELECT count(*) FROM files) + 0.5)::BIGINT AS percent FROM files GROUP BY language")
register("top_directories", lambda s, d: metrics.top_directories(doc_files(s, d)), f"WITH {DOCS} SELECT split_part(path, '/', 1) AS dir, count(*) AS files FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
_blank = f"len(list_filter(string_split(content, chr(10)), lambda x: {trimmed('x')} = ''))"
register("line_counts", lambda s, d: metrics.line_types(page_files(s, d)).select("path", "lines", "blank"), f"WITH {PAGES} SELECT path, len(string_split(content, chr(10))) AS lines, {_blank} AS blank FROM files")

# usage
register("usage_stats", lambda s, d: metrics.usage_stats(usage(s, d)), f"WITH {USAGE} SELECT tool, count(*) AS count, count(*) FILTER (NOT success) AS errors, round(avg(duration_ms), 6) AS avg_ms FROM usage GROUP BY tool")
register(
    "analytics_report",
    lambda s, d: metrics.analytics_report(usage(s, d)),
    f"WITH {USAGE} SELECT tool, count(*) AS count, floor(avg(duration_ms) + 0.5)::BIGINT AS avg_ms, round(max(duration_ms), 6) AS max_ms, count(*) FILTER (NOT success) AS errors, count(*) FILTER (cached) AS cache_hits, max(ts) AS last_called FROM usage GROUP BY tool",
)
register("recent_calls", lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type", "ts"), "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
_TOOLS = ["click", "view", "purchase", "error", "never_called"]
register(
    "suggested_actions",
    lambda s, d: metrics.suggested_actions(usage(s, d), _TOOLS),
    f"""WITH {USAGE}, st AS (SELECT tool, count(*) AS n, count(*) FILTER (NOT success) AS errors, avg(duration_ms) AS a FROM usage GROUP BY tool)
    SELECT t AS tool, 'unused' AS action FROM (SELECT unnest([{', '.join(map(quoted, _TOOLS))}]) AS t) WHERE t NOT IN (SELECT tool FROM st) UNION ALL SELECT tool, 'high error rate' FROM st WHERE errors * 100 > n * 30 UNION ALL SELECT tool, 'slow' FROM st WHERE a > 2000""",
)


def _windowed(s, d):
    from ..streaming.usage import windowed_stats

    return windowed_stats(usage(s, d))


def _bursts(s, d):
    from ..streaming.usage import bursts

    return bursts(usage(s, d))


register("tool_stats_windowed", _windowed, f"WITH {USAGE} SELECT tool, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS count, count(*) FILTER (NOT success) AS errors, round(avg(duration_ms), 6) AS avg_ms FROM usage GROUP BY 1, 2")
register(
    "usage_bursts",
    _bursts,
    f"""WITH {USAGE}, g AS (SELECT tool, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM usage WINDOW w AS (PARTITION BY tool ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY tool ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT tool, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS count FROM r GROUP BY tool, k""",
)

# duplicates
register(
    "find_duplicates",
    lambda s, d: scans.duplicate_texts(doc_files(s, d)),
    f"WITH {DOCS} SELECT md5(regexp_replace(content, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')) AS key, count(*) AS n, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM files WHERE length(content) > 50 GROUP BY 1 HAVING count(DISTINCT path) >= 2",
)
register("exact_duplicates", lambda s, d: scans.exact_duplicates(doc_files(s, d)), f"WITH {DOCS} SELECT sha256(content) AS key, count(*) AS n, count(DISTINCT path) AS n_paths, min(path) AS first_path FROM files GROUP BY 1 HAVING count(DISTINCT path) >= 2")


# change between two snapshots: the older one lacks documents of id 3 mod 10 and has other texts for id 5 mod 10
def _snapshots(s, d):
    docs = table(s, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 10 <> 3").select(F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    new = docs.where("doc_id % 10 <> 4").select(path.alias("path"), F.sha2("text", 256).alias("sha"))
    return old, new


_P = "source || '/' || doc_id::VARCHAR"
SNAPSHOTS = f"""older AS (SELECT CASE WHEN doc_id % 10 = 7 THEN 'moved/' || {_P} ELSE {_P} END AS path, sha256(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 10 <> 3),
newer AS (SELECT {_P} AS path, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 4),
raw AS (SELECT coalesce(o.path, n.path) AS path, o.sha AS o, n.sha AS n, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status FROM older o FULL JOIN newer n ON o.path = n.path WHERE o.sha IS DISTINCT FROM n.sha),
gone AS (SELECT path, o AS sha, row_number() OVER (PARTITION BY o ORDER BY path) AS k FROM raw WHERE status = 'D'), made AS (SELECT path, n AS sha, row_number() OVER (PARTITION BY n ORDER BY path) AS k FROM raw WHERE status = 'A'),
moved AS (SELECT made.path, 'R' AS status, gone.path AS old_path FROM made JOIN gone USING (sha, k)),
changes AS (SELECT path, status, NULL AS old_path FROM raw WHERE path NOT IN (SELECT path FROM moved) AND path NOT IN (SELECT old_path FROM moved) UNION ALL SELECT * FROM moved)"""
register("branch_compare", lambda s, d: change.compare(*_snapshots(s, d)), f"WITH {SNAPSHOTS} SELECT path, status, old_path FROM changes")
register("branch_status_counts", lambda s, d: change.status_counts(change.compare(*_snapshots(s, d))), f"WITH {SNAPSHOTS} SELECT status, count(*) AS files FROM changes GROUP BY status")


def _conflicts(s, d):
    old, new = _snapshots(s, d)
    base = table(s, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.concat(F.col("text"), F.lit("?")), 256).alias("sha"))
    return change.conflicts(base, old, new)


register(
    "conflict_files",
    _conflicts,
    f"""WITH {SNAPSHOTS}, base AS (SELECT {_P} AS path, sha256(text || '?') AS sha FROM documents), mine AS (SELECT coalesce(b.path, o.path) AS path FROM base b FULL JOIN older o ON b.path = o.path WHERE b.sha IS DISTINCT FROM o.sha), other AS (SELECT coalesce(b.path, n.path) AS path FROM base b FULL JOIN newer n ON b.path = n.path WHERE b.sha IS DISTINCT FROM n.sha)
    SELECT path FROM mine INTERSECT SELECT path FROM other EXCEPT SELECT o.path FROM older o JOIN newer n ON o.path = n.path AND o.sha = n.sha""",
)


def _commits(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.md5(F.col("o_orderkey").cast("string")).alias("hash"), F.col("c_name").alias("author"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("message"))


COMMITS = "commits AS (SELECT md5(o_orderkey::VARCHAR) AS hash, c_name AS author, o_orderdate AS date, o_orderpriority AS message FROM orders JOIN customer ON o_custkey = c_custkey)"
register("commit_log", lambda s, d: change.log(_commits(s, d)), f"WITH {COMMITS} SELECT hash, author, date, message FROM commits ORDER BY date DESC, hash LIMIT 15")
register("commit_log_author", lambda s, d: change.log(_commits(s, d), author="customer#00000001", since="1995-01-01"), f"WITH {COMMITS} SELECT hash, author, date, message FROM commits WHERE contains(lower(author), 'customer#00000001') AND date >= TIMESTAMP '1995-01-01' ORDER BY date DESC, hash LIMIT 15")
register(
    "commit_log_with_files",
    lambda s, d: project.log_with_files(_commits(s, d), table(s, d, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("hash"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"))).withColumn("files", F.array_join("files", " ")),
    f"""WITH {COMMITS}, latest AS (SELECT * FROM commits ORDER BY date DESC, hash LIMIT 10), own AS (SELECT md5(l_orderkey::VARCHAR) AS hash, list_sort(list_distinct(list('part/' || l_partkey::VARCHAR))) AS files FROM lineitem GROUP BY 1)
    SELECT hash, author, date, message, coalesce(array_to_string(files, ' '), '') AS files FROM latest LEFT JOIN own USING (hash)""",
)
register(
    "search_truncated",
    lambda s, d: project.truncated(search.search(doc_files(s, d), "license"), ["path", "line_no"], 20)[1],
    f"WITH {DOCS}, {LINES}, n AS (SELECT count(*) AS total FROM lines WHERE regexp_matches(text, '(?i)license')) SELECT total, least(total, 20)::BIGINT AS shown, total > 20 AS truncated FROM n",
)
register(
    "shown_tree",
    lambda s, d: project.shown_tree(doc_files(s, d)),
    f"WITH {DOCS} SELECT DISTINCT '0' || split_part(path, '/', 1) AS place, split_part(path, '/', 1) || '/' AS line FROM files UNION ALL SELECT '0' || split_part(path, '/', 1) || '/1' || split_part(path, '/', 2), '  ' || split_part(path, '/', 2) FROM files",
)
register("contributors", lambda s, d: change.contributors(_commits(s, d)), f"WITH {COMMITS} SELECT author, count(*) AS commits, min(date) AS first, max(date) AS last FROM commits GROUP BY author")
register(
    "change_churn",
    lambda s, d: change.churn(table(s, d, "lineitem").select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").cast("long").alias("insertions"), (F.col("l_orderkey") % 7).cast("long").alias("deletions"))),
    "SELECT 'part/' || l_partkey::VARCHAR AS path, sum(l_linenumber)::BIGINT AS insertions, sum(l_orderkey % 7)::BIGINT AS deletions, sum(l_linenumber + l_orderkey % 7)::BIGINT AS churn FROM lineitem GROUP BY 1 ORDER BY churn DESC, path LIMIT 50",
)
register(
    "ahead_behind",
    lambda s, d: change.ahead_behind(_commits(s, d).where("date >= '1994-01-01'"), _commits(s, d).where("date < '1996-01-01'")),
    f"WITH {COMMITS} SELECT (SELECT count(*) FROM commits WHERE date >= TIMESTAMP '1996-01-01') AS ahead, (SELECT count(*) FROM commits WHERE date < TIMESTAMP '1994-01-01') AS behind",
)

# links of pages
HREF = 'href="([^"]+)"'
register(
    "page_links",
    lambda s, d: page_files(s, d).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(HREF), F.lit(1)))).alias("target")),
    f"WITH {PAGES} SELECT path, unnest(list_distinct(regexp_extract_all(content, '{HREF}', 1))) AS target FROM files",
)
