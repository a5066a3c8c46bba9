"""Snapshots, diffs, impact of changes and commit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, half_up
from ..rules import changes as R
from ..sources.corpus import lines_of

# Definitions that a diff line adds or removes.
CHANGED = [
    r"^[-+]\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    r"^[-+]\s*(?:export\s+)?class\s+(\w+)",
    r"^[-+]\s*(?:export\s+)?interface\s+(\w+)",
    r"^[-+]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
    r"^[-+]\s*def\s+(\w+)",
    r"^[-+]\s*func\s+(\w+)",
]
# Paths of tests.
TESTS = r"\.(?:test|spec)\.|__tests__|/test/|/tests/|/spec/"


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (A, M, D, R), old_path of two snapshots (path, sha); a full outer join on paths.

    A removed and an added path of one hash are a rename, paired in the order of their paths.
    """
    a, b = old.select("path", F.col("sha").alias("_old")), new.select("path", F.col("sha").alias("_new"))
    both = a.join(b, "path", "full_outer").withColumn("status", F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(F.col("_old") != F.col("_new"), "M")).where("status IS NOT NULL")
    nth = lambda sha: F.row_number().over(Window.partitionBy(sha).orderBy("path"))
    gone = both.where("status = 'D'").select(F.col("path").alias("old_path"), F.col("_old").alias("_sha"), nth("_old").alias("_k"))
    made = both.where("status = 'A'").select("path", F.col("_new").alias("_sha"), nth("_new").alias("_k"))
    moved = made.join(gone, ["_sha", "_k"]).select("path", F.lit("R").alias("status"), "old_path")
    rest = both.select("path", "status").join(moved.select("path").unionByName(moved.select(F.col("old_path").alias("path"))), "path", "left_anti")
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(moved)


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Paths that both sides changed since their base, in different ways."""
    mine, other = compare(base, ours).select("path"), compare(base, theirs).select("path")
    same = ours.join(theirs, ["path", "sha"], "left_semi").select("path")
    return mine.intersect(other).join(same, "path", "left_anti")


def churn(stats: DataFrame, most: int = 50) -> DataFrame:
    return stats.groupBy("path").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")).withColumn("churn", F.col("insertions") + F.col("deletions")).orderBy(F.desc("churn"), "path").limit(most)


def ahead_behind(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Commits (hash) on one side only, as one row."""
    ahead = ours.join(theirs, "hash", "left_anti").agg(F.count(F.lit(1)).alias("ahead"))
    return ahead.join(F.broadcast(theirs.join(ours, "hash", "left_anti").agg(F.count(F.lit(1)).alias("behind"))))


def changed_symbols(diffs: DataFrame) -> DataFrame:
    """diff_id, file, name, change (added, removed, modified, renamed), old_name of diffs (diff_id, content).

    The file of a line is the last header above it. Removed and added names of one file pair up in order as renames.
    """
    lines = lines_of(diffs.select(F.col("diff_id").alias("path"), "content"))
    header = F.regexp_extract("text", r"^(?:\+\+\+|---)\s+[ab]/(.+)", 1)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    given = lines.withColumn("file", F.coalesce(F.last(F.when(header != "", header), ignorenulls=True).over(w), F.lit(""))).where((header == "") & F.col("text").rlike("^[-+]"))
    names = F.array_distinct(F.filter(F.array(*[F.regexp_extract("text", p, 1) for p in CHANGED]), lambda n: n != ""))
    each = given.select(F.col("path").alias("diff_id"), "file", "line_no", F.substr("text", F.lit(1), F.lit(1)).alias("sign"), F.explode(names).alias("name"))
    by = each.groupBy("diff_id", "file", "name").agg(F.count_if(F.col("sign") == "+").alias("p"), F.count_if(F.col("sign") == "-").alias("m"), F.min("line_no").alias("first"))
    by = by.withColumn("change", F.when((F.col("p") + F.col("m")) > 1, "modified").when(F.col("p") > 0, "added").otherwise("removed"))
    nth = F.row_number().over(Window.partitionBy("diff_id", "file", "change").orderBy("first", "name"))
    ranked = by.withColumn("_k", nth)
    pairs = ranked.groupBy("diff_id", "file", "_k").agg(F.max(F.when(F.col("change") == "removed", F.col("name"))).alias("_gone"), F.max(F.when(F.col("change") == "added", F.col("name"))).alias("_made")).where("_gone IS NOT NULL AND _made IS NOT NULL")
    met = ranked.where("change <> 'modified'").join(pairs, ["diff_id", "file", "_k"], "left")
    renamed = F.col("_made").isNotNull()
    out = met.where(~renamed | (F.col("change") == "added")).select("diff_id", "file", "name", F.when(renamed, "renamed").otherwise(F.col("change")).alias("change"), F.when(renamed, F.col("_gone")).alias("old_name"))
    return out.unionByName(ranked.where("change = 'modified'").select("diff_id", "file", "name", "change", F.lit(None).cast("string").alias("old_name")))


def categorised(diffs: DataFrame) -> DataFrame:
    """diff_id, category, confidence, indicators: the category with the most points of rules.changes, and its share of all points.

    What speaks for a diff is an array of (category, points, indicator); points are summed a category. Without any points
    the first category stands with no confidence.
    """
    count = lambda sign: F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith(sign)))
    given = diffs.withColumns({"up": count("+"), "down": count("-")})
    sign = lambda category, points, indicator: F.struct(F.lit(category).alias("category"), F.lit(points).alias("points"), F.lit(indicator).alias("indicator"))
    seen = [F.when(F.expr(condition), sign(*rest)) for *rest, condition in R.MEASURES] + [F.when(F.col("content").rlike(f"(?i){words}"), sign(*rest)) for *rest, words in R.WORDS]
    said = given.select("diff_id", F.array_compact(F.array(*seen)).alias("signs"))
    of = lambda category: F.aggregate(F.filter("signs", lambda x: x["category"] == category), F.lit(0), lambda n, x: n + x["points"])
    ranked = F.array(*[F.struct(of(c).alias("points"), F.lit(-k).alias("place"), F.lit(c).alias("category")) for k, c in enumerate(R.CATEGORIES)])
    best, total = F.array_max(ranked), F.aggregate("signs", F.lit(0), lambda n, x: n + x["points"])
    found = said.select("diff_id", best.alias("best"), total.alias("total"), F.transform("signs", lambda x: x["indicator"]).alias("indicators"))
    return found.select("diff_id", F.col("best.category"), F.when(F.col("total") > 0, half_up(F.col("best.points") * 100 / F.col("total"))).otherwise(F.lit(0).cast("long")).alias("confidence"), "indicators")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def impact(files: DataFrame, changed_files: DataFrame, changed: DataFrame) -> DataFrame:
    """path, reason (imports, uses), what: files that import a changed file's base name or name a changed symbol.

    The words of each line are joined with base names and symbols; no line is tried against every change.
    """
    words = lines_of(files).select("path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    bases = changed_files.select(stem(F.col("path")).alias("word"), F.col("path").alias("_own"))
    by_import = words.where(F.col("text").rlike("import|require|from|use|include")).join(bases, "word").where("path <> _own").select("path", F.lit("imports").alias("reason"), F.col("_own").alias("what"))
    by_name = words.join(changed.select(F.col("name").alias("word"), F.col("file").alias("_own")), "word").where("path <> _own").select("path", F.lit("uses").alias("reason"), F.col("word").alias("what"))
    return by_import.unionByName(by_name).distinct()


def affected_tests(files: DataFrame, hits: DataFrame, changed_files: DataFrame) -> DataFrame:
    """path of tests among affected files, and those named after changed files."""
    by_place = hits.where(F.col("path").rlike(TESTS)).select("path")
    base, ext = stem(F.col("path")), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    names = changed_files.select(F.explode(F.array(F.concat(base, F.lit(".test"), ext), F.concat(base, F.lit(".spec"), ext), F.concat(base, F.lit("_test"), ext), F.concat(F.lit("test_"), base, ext))).alias("_name"))
    return by_place.union(files.select("path", basename(F.col("path")).alias("_name")).join(names, "_name", "left_semi").select("path")).distinct()


def risk(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: affected files, changed symbols, breaking changes and the level of risk."""
    one = hits.agg(F.count_distinct("path").alias("affected")).join(F.broadcast(changed.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("change").isin("removed", "renamed")).alias("breaking"))))
    return one.withColumn("risk", F.when(F.col("breaking") > 0, "critical").when(F.col("affected") > 20, "high").when((F.col("affected") > 5) | (F.col("symbols") > 3), "medium").otherwise("low"))


def log(commits: DataFrame, author: str | None = None, since: str | None = None, most: int = 15) -> DataFrame:
    given = commits
    if author:
        given = given.where(F.contains(F.lower("author"), F.lit(author.lower())))
    if since:
        given = given.where(F.col("date") >= F.lit(since).cast("timestamp"))
    return given.orderBy(F.desc("date"), "hash").limit(most)


def contributors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.min("date").alias("first"), F.max("date").alias("last"))


def blame(porcelain: DataFrame) -> DataFrame:
    """path, line_no, hash (8 characters), author, date of porcelain text (path, content).

    Each content line (after a tab) takes the last header's hash; author and time come from the first header of that hash.
    """
    raw = lines_of(porcelain)
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    own = lambda p, k: F.nullif(F.regexp_extract("text", p, k), F.lit(""))
    rows = raw.select("path", "line_no", "text", last(own(head, 1)).alias("hash"), last(own(head, 2)).alias("at"))
    meta = rows.groupBy("path", "hash").agg(F.max(own("^author (.+)$", 1)).alias("author"), F.max(own(r"^author-time (\d+)$", 1).cast("long")).alias("time"))
    lines = rows.where(F.col("text").startswith("\t")).select("path", F.col("at").cast("long").alias("line_no"), "hash")
    return lines.join(meta, ["path", "hash"]).select("path", "line_no", F.substr("hash", F.lit(1), F.lit(8)).alias("hash"), "author", F.to_date(F.timestamp_seconds("time")).alias("date"))
