"""Settings of configuration files as rows, and what infrastructure and pipeline files say, as expressions over them.

One scanner turns YAML (indentation, list items, flow lists, block scalars) and HCL (nested labelled blocks) into rows of
key path and value. Resources, jobs and findings are then filters, lookups and rule rows over that table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import web as W

#: doc counts the documents of a file; opens: the row begins a list item.
ROW = "doc:int,line_no:bigint,keys:array<string>,value:string,opens:boolean"
_SCHEMA = pa.schema([("path", pa.string()), ("rows", pa.list_(pa.struct([("doc", pa.int32()), ("line_no", pa.int64()), ("keys", pa.list_(pa.string())), ("value", pa.string()), ("opens", pa.bool_())])))])
_COMMENT = re.compile(r"""((?:[^"'#]|"(?:\\.|[^"\\])*"|'[^']*'|(?<=\S)#|["'])*)""")
_ENTRY = re.compile(r"""("[^"]*"|'[^']*'|[^\s:][^:]*?)\s*:(?:\s+(.*))?$""")
_HCL = re.compile(r"""(?P<skip>[ \t\r]+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<here><<[-~]?(?P<tag>\w+)\n.*?\n[ \t]*(?P=tag)\b)|(?P<text>"(?:\\.|\$\{[^}]*\}|[^"\\])*")|(?P<end>\n)|(?P<word>[\w.-]+)|(?P<mark>.)""", re.S)


def _plain(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _flow(value: str) -> list[str]:
    """Items of a one-line list in brackets, cut at its own commas."""
    out, depth, item = [], 0, ""
    for c in value.strip()[1:-1]:
        depth += (c in "[{") - (c in "]}")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [_plain(x) for x in [*out, item] if x.strip()]


def yaml_rows(text: str) -> Iterator[tuple]:
    lines = text.split("\n")
    doc, at = 0, 0
    open_: list[list] = []  # indentation, key, whether it is a list item, items so far
    while at < len(lines):
        number, raw = at + 1, lines[at].rstrip()
        at += 1
        if raw.startswith("---"):
            doc, open_ = doc + 1, []
            continue
        body = _COMMENT.match(raw)[1].rstrip()
        rest = body.lstrip(" ")
        if not rest:
            continue
        indent, opens = len(body) - len(rest), False
        while rest == "-" or rest.startswith("- "):
            while open_ and (open_[-1][0] > indent or open_[-1][0] == indent and open_[-1][2]):
                open_.pop()
            count = open_[-1][3] if open_ else 0
            if open_:
                open_[-1][3] += 1
            open_.append([indent, f"[{count}]", True, 0])
            opens, inner = True, rest[1:].lstrip(" ")
            indent, rest = indent + len(rest) - len(inner), inner
        entry = _ENTRY.match(rest) if rest and rest[0] not in "[{" else None
        if entry:
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            open_.append([indent, _plain(entry[1]), False, 0])
            rest = (entry[2] or "").strip()
        elif not opens:
            continue
        keys = [k[1] for k in open_]
        if re.fullmatch(r"[|>][+-]?\d*", rest):
            block = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > indent):
                block.append(lines[at].strip())
                at += 1
            rest = "\n".join(block).strip("\n")
        yield doc, number, keys, _plain(rest) if rest else None, opens
        if rest[:1] == "[" and rest[-1:] == "]":
            yield from ((doc, number, [*keys, f"[{k}]"], x, True) for k, x in enumerate(_flow(rest)))


def hcl_rows(text: str) -> Iterator[tuple]:
    line, labels, blocks = 1, [], []
    tokens = ((m.lastgroup if m.lastgroup != "tag" else "here", m[0]) for m in _HCL.finditer(text))
    for kind, token in tokens:
        here = line
        line += token.count("\n")
        if kind in ("word", "text"):
            labels.append(_plain(token))
        elif token == "{":
            blocks.append(labels)
            labels = []
            yield 0, here, [k for b in blocks for k in b], None, False
        elif token == "}":
            labels = []
            if blocks:
                blocks.pop()
        elif token == "=" and labels:
            depth, value, begun = 0, "", here
            for kind, token in tokens:  # the value reaches to the end of the line outside brackets
                line += token.count("\n")
                depth += (token in "([{") - (token in ")]}") if kind == "mark" else 0
                if depth < 0 or kind == "end" and not depth:
                    break
                value += " " if kind in ("skip", "end") else token
            yield 0, begun, [*(k for b in blocks for k in b), labels[-1]], value.strip(), False
            labels = []
            if depth < 0 and blocks:
                blocks.pop()
        elif kind == "end":
            labels = []


def settings(files: DataFrame) -> DataFrame:
    """(path, rows) of YAML and HCL files: rows is an array of ROW in order of lines. Null contents have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SCHEMA.field("rows").type.value_type]
        for b in batches:
            found = [[dict(zip(names, r, strict=True)) for r in (hcl_rows if p.endswith((".tf", ".tfvars", ".hcl")) else yaml_rows)(c or "")] for p, c in zip(*(k.to_pylist() for k in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SCHEMA.field("rows").type)], schema=_SCHEMA)

    given = files.where(F.col("path").rlike(r"\.(tf|tfvars|hcl|ya?ml)$")).select("path", F.col("content").cast("string").alias("content"))
    return given.mapInArrow(run, f"path string, rows array<struct<{ROW}>>")


def _path(row: Column) -> Column:
    return F.array_join(row["keys"], "/")


def _with(key: str, value: str | None) -> Callable[[Column], Column]:
    return lambda r: _path(r).rlike(key) & (F.lit(True) if value is None else F.coalesce(r["value"].rlike(value), F.lit(False)))


def iac(files: DataFrame) -> DataFrame:
    """path, what (resource or issue), type, name, severity, detail of Terraform, Compose and Kubernetes files.

    A resource's settings are gathered once; the rules of rules.web.MISCONFIGURED are tested on them, and those of
    MISCONFIGURED_ROWS on each row. Every document of a manifest is a resource.
    """
    each = settings(files.where(F.col("content").rlike("resource|data|module|services:|kind:"))).select("path", F.explode("rows").alias("r")).select("path", "r.*")
    first = F.get("keys", F.lit(0))
    tf, size = F.col("path").endswith(".tf"), F.size("keys")
    own = F.when(tf & first.isin("resource", "data") & (size > 2), F.slice("keys", 1, 3)).when(tf & (first == "module") & (size > 1), F.slice("keys", 1, 2)).when(~tf & (first == "services") & (size > 1), F.slice("keys", 1, 2)).when(~tf, F.array().cast("array<string>"))
    row = F.struct("line_no", "keys", "value")
    whole = each.withColumn("own", own).where("own IS NOT NULL").groupBy("path", "doc", "own").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    value = lambda test: F.get(F.transform(F.filter("rows", lambda r: test(r) & r["value"].isNotNull()), lambda r: r["value"]), F.lit(0))
    kind, at = F.get("own", F.lit(0)), lambda *keys: lambda r: r["keys"] == F.array(*map(F.lit, keys))
    of_kind = value(at("kind"))
    typed = whole.select(
        "path",
        "rows",
        F.when(kind == "resource", F.get("own", F.lit(1))).when(kind == "data", F.concat(F.lit("data."), F.get("own", F.lit(1)))).when(kind == "module", "module").when(kind == "services", "docker-service").otherwise(F.concat(F.lit("k8s/"), of_kind)).alias("type"),
        F.when(kind.isin("resource", "data"), F.get("own", F.lit(2))).when(kind.isNotNull(), F.get("own", F.lit(1))).otherwise(F.coalesce(value(at("metadata", "name")), F.lit("unnamed"))).alias("name"),
        F.when(kind.isin("resource", "data"), F.substring_index(F.get("own", F.lit(1)), "_", 1)).when(kind == "module", F.coalesce(F.regexp_replace(value(lambda r: (F.size(r["keys"]) == 3) & (r["keys"][2] == "source")), '^"|"$', ""), F.lit("unknown"))).when(kind.isNull(), value(lambda r: _path(r).rlike("(^|/)image$"))).alias("detail"),
    ).where("type IS NOT NULL")
    said: list[Column] = []
    for issue, severity, on, key, wanted in W.MISCONFIGURED:
        hits = F.filter("rows", _with(key, wanted))
        wrong = F.col("type").rlike(on) & (F.size(hits) == 0 if wanted is None else F.size(hits) > 0)
        said.append(F.when(wrong, F.struct(F.lit("issue").alias("what"), F.lit(issue).alias("type"), F.col("name"), F.lit(severity).alias("severity"), F.get(hits, F.lit(0))["value"].alias("detail"))))
    resource = F.struct(F.lit("resource").alias("what"), F.col("type"), F.col("name"), F.lit(None).cast("string").alias("severity"), F.col("detail"))
    out = typed.select("path", F.explode(F.array_compact(F.array(resource, *said))).alias("x")).select("path", "x.*")
    for issue, severity, ending, top, key, wanted, by_line in W.MISCONFIGURED_ROWS:
        hit = each.where(F.col("path").rlike(ending) & F.array_join("keys", "/").rlike(key) & F.col("value").rlike(wanted) & (F.lit(True) if top is None else first == top))
        name = F.col("line_no").cast("string") if by_line else F.lit(None).cast("string")
        out = out.unionByName(hit.select("path", F.lit("issue").alias("what"), F.lit(issue).alias("type"), name.alias("name"), F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("detail")).distinct())
    return out


def iac_summary(found: DataFrame) -> DataFrame:
    """Per platform: resources, types and issues. found: iac()."""
    platform = F.when(F.col("path").endswith(".tf"), "terraform").when(F.col("path").rlike("(^|/)(docker-)?compose[^/]*$"), "docker").otherwise("kubernetes")
    return found.groupBy(platform.alias("platform")).agg(F.count_if(F.col("what") == "resource").alias("resources"), F.count_distinct(F.when(F.col("what") == "resource", F.col("type"))).alias("types"), F.count_if(F.col("what") == "issue").alias("issues"))


#: Facts of a pipeline as SQL over `rows`, an array of (what, job, value) each.
_OF_JOBS = "filter(rows, r -> get(r.keys, 0) = 'jobs' AND size(r.keys) >= 2)"
_JOBS = f"array_distinct(transform({_OF_JOBS}, r -> get(r.keys, 1)))"
_NAMES = ", ".join(f"'{k}'" for k in W.GITLAB_KEYS)
_OWN = f"filter(rows, r -> get(r.keys, 0) NOT IN ({_NAMES}) AND get(r.keys, 0) RLIKE '^\\\\w[\\\\w-]*$')"
_ON = "filter(rows, r -> get(r.keys, 0) = 'on' AND (size(r.keys) = 2 OR size(r.keys) = 1 AND r.value IS NOT NULL AND NOT startswith(r.value, '[')))"


def _fact(what: str, job: str, value: str) -> str:
    return f"named_struct('what', '{what}', 'job', CAST({job} AS STRING), 'value', CAST({value} AS STRING))"


FACTS: dict[str, list[str]] = {
    "github-actions": [
        f"transform({_ON}, r -> {_fact('trigger', 'NULL', 'if(size(r.keys) = 1 OR startswith(get(r.keys, 1), "["), r.value, get(r.keys, 1))')})",
        f"if(size({_ON}) = 0, array({_fact('issue', 'NULL', '"no triggers"')}), array())",
        f"transform({_JOBS}, j -> {_fact('job', 'j', 'get(transform(filter(rows, r -> size(r.keys) = 3 AND array_join(r.keys, "/") = concat("jobs/", j, "/runs-on")), r -> r.value), 0)')})",
        f"transform(filter({_JOBS}, j -> NOT exists(rows, r -> startswith(array_join(r.keys, '/'), concat('jobs/', j, '/runs-on')))), j -> {_fact('issue', 'j', '"no runs-on"')})",
        f"transform(filter({_OF_JOBS}, r -> get(r.keys, 2) = 'needs' AND NOT startswith(r.value, '[')), r -> {_fact('needs', 'get(r.keys, 1)', 'r.value')})",
        f"array_distinct(flatten(transform({_OF_JOBS}, r -> transform(regexp_extract_all(coalesce(r.value, ''), '[$][{{]{{2}}\\\\s*secrets[.](\\\\w+)\\\\s*[}}]{{2}}', 1), s -> {_fact('secret', 'get(r.keys, 1)', 's')}))))",
        f"transform(filter({_OF_JOBS}, r -> get(r.keys, 2) = 'steps' AND size(r.keys) = 5 AND r.opens AND get(r.keys, 4) IN ('name', 'uses', 'run')), r -> {_fact('step', 'get(r.keys, 1)', 'trim(substring_index(r.value, chr(10), 1))')})",
        f"transform(filter({_OF_JOBS}, r -> get(r.keys, 2) = 'steps' AND get(r.keys, 4) = 'uses' AND r.value RLIKE '@(master|main)$'), r -> {_fact('issue', 'get(r.keys, 1)', '"unpinned action"')})",
        f"transform(filter(rows, r -> element_at(r.keys, -1) RLIKE '(?i)password|secret|token|api[_-]?key' AND r.value <> '' AND NOT contains(r.value, '${{{{') AND NOT contains(r.value, 'secrets.')), r -> {_fact('issue', 'NULL', 'concat("possible secret in line ", r.line_no)')})",
    ],
    "gitlab-ci": [
        f"transform(array_distinct(transform({_OWN}, r -> get(r.keys, 0))), j -> {_fact('job', 'j', 'NULL')})",
        f"transform(filter({_OWN}, r -> size(r.keys) = 2 AND get(r.keys, 1) = 'stage'), r -> {_fact('stage', 'get(r.keys, 0)', 'r.value')})",
        f"transform(filter({_OWN}, r -> get(r.keys, 1) = 'needs' AND (size(r.keys) = 3 OR get(r.keys, 3) = 'job') AND r.value IS NOT NULL), r -> {_fact('needs', 'get(r.keys, 0)', 'r.value')})",
        f"transform(filter({_OWN}, r -> size(r.keys) = 3 AND get(r.keys, 1) IN ('script', 'before_script', 'after_script') AND r.value IS NOT NULL), r -> {_fact('step', 'get(r.keys, 0)', 'r.value')})",
    ],
    "circleci": [f"transform({_JOBS}, j -> {_fact('job', 'j', 'NULL')})"],
}
PLATFORMS = {"github-actions": r"\.github/workflows/[^/]+\.ya?ml$", "gitlab-ci": r"\.gitlab-ci\.yml$", "circleci": r"\.circleci/config\.yml$"}


def cicd(files: DataFrame) -> DataFrame:
    """path, platform, what, job, value: triggers, jobs, needs, stages, steps, secrets and issues of pipelines."""
    platform = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(name)) for name, p in PLATFORMS.items()])
    known = settings(files.where(platform.isNotNull())).withColumn("platform", platform)
    facts = F.coalesce(*[F.when(F.col("platform") == name, F.expr(f"concat({', '.join(parts)})")) for name, parts in FACTS.items()])
    out = known.select("path", "platform", F.explode(facts).alias("x")).select("path", "platform", "x.*")
    stages = files.where(F.col("path").endswith("Jenkinsfile")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"stage\s*\(\s*['\"](.+?)['\"]\s*\)"), F.lit(1))).alias("job"))
    return out.unionByName(stages.select("path", F.lit("jenkins").alias("platform"), F.lit("job").alias("what"), "job", F.lit(None).cast("string").alias("value")))
