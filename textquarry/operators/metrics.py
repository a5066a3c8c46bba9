"""Line kinds, complexity, nesting, heat maps, corpus summaries and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, half_up, is_code, trimmed, words
from ..rules import lines as R
from ..rules.languages import COMMENTS
from ..sources.corpus import lines_of


def line_types(files: DataFrame, *more: Column) -> DataFrame:
    """path, language, lines, code, comment, blank, and columns of `more`; block comments are a state carried from line to line in a fold."""
    map_of = lambda k, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for lang, c in COMMENTS.items() for x in (lang, c[k] or "")]), F.col("language")), F.lit(other))
    given = files.select("path", "language", *more, F.transform(F.split("content", "\n"), trimmed).alias("_lines"), map_of(0, "//").alias("_one"), map_of(1, "").alias("_open"), map_of(2, "").alias("_close"))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("comment"), F.lit(0).cast("long").alias("blank"))

    def step(acc: Column, x: Column) -> Column:
        one, open_, close = F.col("_one"), F.col("_open"), F.col("_close")
        blank = x == ""
        opens = (open_ != "") & x.startswith(open_)
        body = F.substr(x, F.length(open_) + 1)
        shut_here = F.contains(body, close) & (close != "")
        comment = ~blank & (acc["inside"] | opens | ((one != "") & x.startswith(one)))
        inside = F.when(blank, acc["inside"]).when(acc["inside"], ~F.contains(x, close)).otherwise(opens & ~shut_here)
        return F.struct(inside.alias("inside"), (acc["code"] + F.when(blank | comment, 0).otherwise(1)).alias("code"), (acc["comment"] + F.when(comment, 1).otherwise(0)).alias("comment"), (acc["blank"] + F.when(blank, 1).otherwise(0)).alias("blank"))

    own = [c for c in given.columns if c not in ("path", "language", "_lines", "_one", "_open", "_close")]
    return given.select("path", "language", F.size("_lines").cast("long").alias("lines"), F.aggregate("_lines", zero, step).alias("n"), *own).select("path", "language", "lines", "n.code", "n.comment", "n.blank", *own)


def complexity(content: Column) -> Column:
    """1 and the decisions of a text."""
    return counted(content, [*_few_words(R.DECISION_WORDS), *_few_marks(R.DECISION_MARKS)]) + 1


def cyclomatic(content: Column) -> Column:
    return counted(content, [*_few_words(R.CYCLOMATIC_WORDS), *_few_marks(R.CYCLOMATIC_MARKS)]) + 1


def _few_words(patterns: list[str]) -> list[str]:
    """Whole words can't overlap, so one pattern counts them all; those of several words stay by themselves."""
    return words(["|".join(p for p in patterns if p.isalpha()), *(p for p in patterns if not p.isalpha())])


def _few_marks(patterns: list[str]) -> list[str]:
    """Marks of other first characters can't overlap, so one pattern counts the first of each."""
    first: dict[str, str] = {}
    rest = [p for p in patterns if first.setdefault(p[:2], p) != p]
    return ["|".join(first.values()), *rest]


def code_metrics(files: DataFrame) -> DataFrame:
    """path, language, lines, code, comment, blank, complexity, comment_ratio."""
    return line_types(files, complexity(F.col("content")).alias("complexity")).withColumn("comment_ratio", F.round(F.try_divide("comment", F.col("code") + F.col("comment")), 6))


def _balance(x: Column) -> Column:
    return counted(x, [r"\{"]) - counted(x, [r"\}"])


def nesting_by_line(lines: DataFrame) -> DataFrame:
    """lines with `depth`, the brace depth after each line, never below 0.

    A running sum that is held at zero equals the running sum less its own smallest value so far (or less 0), so two window
    sums over a file's lines do it.
    """
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("_x", _balance(F.col("text"))).withColumn("_s", F.sum("_x").over(w))
    return run.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_x", "_s")


def cognitive(lines: DataFrame) -> DataFrame:
    """path, cognitive: control words weigh 1 and their depth, a lone else and each && or || weigh 1."""
    w = Window.partitionBy("path").orderBy("line_no")
    given = nesting_by_line(lines).withColumn("_before", F.lag("depth", 1, 0).over(w))
    t = trimmed(F.col("text"))
    control, other = t.rlike(R.word(R.NESTING_WORDS)), t.rlike(R.word("else")) & ~t.rlike(r"else\s+if")
    each = F.when(control, 1 + F.col("_before")).otherwise(0) + F.when(other, 1).otherwise(0) + counted(t, [r"&&|\|\|"])
    return given.groupBy("path").agg(F.sum(each).cast("long").alias("cognitive"))


def max_nesting(content: Column) -> Column:
    """Deepest brace depth of a text, brace by brace, never below 0; a fold over its braces alone."""
    step = lambda acc, c: F.struct(F.when(c == "{", acc["d"] + 1).otherwise(F.greatest(acc["d"] - 1, F.lit(0))).alias("d"), F.greatest(acc["m"], F.when(c == "{", acc["d"] + 1).otherwise(0)).alias("m"))
    braces = F.filter(F.split(F.regexp_replace(content, r"[^{}]", ""), ""), lambda c: c != "")
    return F.aggregate(braces, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda a: a["m"]).cast("long")


def heat_score(c: Column, g: Column, n: Column, loc: Column) -> Column:
    part = lambda x, full, weight: F.least(F.lit(100.0), x / full * 100) * weight
    return half_up(F.round(part(c, 30, 0.3) + part(g, 50, 0.3) + part(n, 8, 0.2) + part(loc, 500, 0.2), 9))


def grade(score: Column) -> Column:
    return F.when(score <= 20, "A").when(score <= 40, "B").when(score <= 60, "C").when(score <= 80, "D").otherwise("F")


def heatmap(files: DataFrame, lines: DataFrame) -> DataFrame:
    """path, cyclomatic, cognitive, nesting, loc, score, grade."""
    per = files.select("path", cyclomatic(F.col("content")).alias("cyclomatic"), max_nesting(F.col("content")).alias("nesting"), F.size(F.split("content", "\n")).cast("long").alias("loc"))
    score = heat_score(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting"), F.col("loc"))
    return per.join(cognitive(lines), "path").withColumn("score", score).withColumn("grade", grade(F.col("score")))


def heatmap_functions(files: DataFrame, top: int = 20) -> DataFrame:
    """path, name, line_no, params, cyclomatic, cognitive, nesting, loc, score, grade of the `top` functions and classes, worst first."""
    from .symbols import bodies

    own = bodies(files).withColumn("_of", F.struct("path", "name", "line_no", "params")).select("_of", F.to_json("_of").alias("path"), "content")
    scored = heatmap(own, lines_of(own)).join(own.select("path", "_of"), "path").drop("path")
    return scored.select("_of.*", "cyclomatic", "cognitive", "nesting", "loc", "score", "grade").orderBy(F.desc("score"), "path", "line_no", "name").limit(top)


def heat_summary(map_: DataFrame) -> DataFrame:
    return map_.agg(F.count(F.lit(1)).alias("files"), half_up(F.avg("score")).alias("avg_score"), F.count_if(F.col("grade").isin("D", "F")).alias("hot"), F.count_if(F.col("grade").isin("A", "B")).alias("healthy"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """language, files, percent of all files."""
    by = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    total = by.agg(F.sum("files").alias("_all"))
    return by.join(F.broadcast(total)).select("language", "files", half_up(F.col("files") * 100 / F.col("_all")).alias("percent"))


def top_directories(files: DataFrame, most: int = 15) -> DataFrame:
    """The first parts of paths with the most files; a file at the top counts under its own name."""
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "dir").limit(most)


# Marks in paths of continuous integration.
CI_MARKS = [".github/workflows", ".gitlab-ci", "Jenkinsfile", ".circleci", ".travis.yml", "azure-pipelines"]


def codebase_map(files: DataFrame) -> DataFrame:
    """One row: counts, main language, size class and flags."""
    path, low = F.col("path"), F.lower("path")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    ci = path.contains(CI_MARKS[0])
    for mark in CI_MARKS[1:]:
        ci = ci | path.contains(mark)
    base = files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(is_code(F.col("language"))).alias("code_files"),
        F.count_distinct(F.when(folder != "", folder)).alias("directories"),
        some(low.rlike(R.word("test|spec|__tests__|tests|_test|_spec"))).alias("has_tests"),
        some(ci).alias("has_ci"),
        some(low.rlike("^(docs?|documentation)/") | (low == "readme.md")).alias("has_docs"),
        some(low.contains("dockerfile") | path.isin("docker-compose.yml", "docker-compose.yaml")).alias("has_docker"),
    )
    size = F.when(F.col("total_files") < 50, "small").when(F.col("total_files") < 500, "medium").when(F.col("total_files") < 5000, "large").otherwise("enterprise")
    ranked = files.where(is_code(F.col("language"))).groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("language", F.struct("n", "language")).alias("main_language"))
    return base.withColumn("size_class", size).join(F.broadcast(ranked))


# Framework, file names that show it (a name that starts with a dot is an ending), text that package.json must hold.
FRAMEWORKS: list[tuple[str, list[str], str | None]] = [
    ("React", ["package.json"], "react"),
    ("Next.js", ["next.config.js", "next.config.mjs", "next.config.ts"], None),
    ("Vue.js", ["vue.config.js", "nuxt.config.js", "nuxt.config.ts"], None),
    ("Angular", ["angular.json"], None),
    ("Svelte", ["svelte.config.js"], None),
    ("Django", ["manage.py"], None),
    ("Flask", ["wsgi.py"], None),
    ("FastAPI", ["main.py"], None),
    ("Spring Boot", ["pom.xml", "build.gradle"], None),
    ("Express.js", ["package.json"], "express"),
    ("Rails", ["Gemfile", "config/routes.rb"], None),
    ("Laravel", ["artisan", "composer.json"], None),
    ("Terraform", ["main.tf"], None),
    ("Flutter", ["pubspec.yaml"], None),
    ("SwiftUI", ["Package.swift"], None),
    (".NET", [".csproj", ".sln"], None),
]
# Package manager and the base names (lower case) that show it.
MANAGERS: list[tuple[str, list[str]]] = [
    ("npm", ["package-lock.json", "package.json"]),
    ("yarn", ["yarn.lock"]),
    ("pnpm", ["pnpm-lock.yaml"]),
    ("bun", ["bun.lockb"]),
    ("pip", ["requirements.txt", "pyproject.toml", "setup.py"]),
    ("poetry", ["poetry.lock"]),
    ("pipenv", ["pipfile.lock"]),
    ("cargo", ["cargo.toml"]),
    ("go modules", ["go.mod"]),
    ("bundler", ["gemfile"]),
    ("composer", ["composer.json"]),
    ("pub", ["pubspec.yaml"]),
    ("gradle", ["build.gradle", "build.gradle.kts"]),
    ("maven", ["pom.xml"]),
]


def frameworks(files: DataFrame) -> DataFrame:
    """framework, evidence (the first path), files."""
    low = F.lower("path")

    def shows(names: list[str], need: str | None) -> Column:
        named = F.lit(False)
        for n in names:
            named = named | (F.col("path").endswith(n) if n.startswith(".") else (low == n.lower()) | low.endswith("/" + n.lower()))
        return named & F.coalesce(F.col("content").contains(f'"{need}"'), F.lit(False)) if need else named

    hits = F.array_compact(F.array(*[F.when(shows(names, need), F.lit(name)) for name, names, need in FRAMEWORKS]))
    return files.select(F.explode(hits).alias("framework"), "path").groupBy("framework").agg(F.min("path").alias("evidence"), F.count(F.lit(1)).alias("files"))


def package_managers(files: DataFrame) -> DataFrame:
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    hits = F.array_compact(F.array(*[F.when(name.isin(names), F.lit(m)) for m, names in MANAGERS]))
    return files.select(F.explode(hits).alias("manager"), "path").groupBy("manager").agg(F.count(F.lit(1)).alias("files"))


def usage_stats(usage: DataFrame) -> DataFrame:
    """tool, count, errors, avg_ms, most used first when sorted by count."""
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("success")).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


def analytics_report(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tool").agg(F.count(F.lit(1)).alias("count"), half_up(F.avg("duration_ms")).alias("avg_ms"), F.round(F.max("duration_ms"), 6).alias("max_ms"), F.count_if(~F.col("success")).alias("errors"), F.count_if("cached").alias("cache_hits"), F.max("ts").alias("last_called"))


def suggested_actions(usage: DataFrame, tools: list[str]) -> DataFrame:
    """tool, action: never used, error rate above 30 %, average above 2 s."""
    stats = usage_stats(usage)
    named = usage.sparkSession.createDataFrame([(t,) for t in tools], "tool string") if tools else usage.select("tool").limit(0)
    unused = named.join(F.broadcast(stats.select("tool")), "tool", "left_anti").select("tool", F.lit("unused").alias("action"))
    errors = stats.where("errors * 100 > count * 30").select("tool", F.lit("high error rate").alias("action"))
    slow = stats.where("avg_ms > 2000").select("tool", F.lit("slow").alias("action"))
    return unused.unionByName(errors).unionByName(slow)
