"""What a tree's manifests, reports and tests say about the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, glob_pattern

# Files that lock dependencies.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Cargo.lock", "go.sum"]

# Places of coverage reports and their formats, best first.
REPORT_PLACES: list[tuple[str, str]] = [
    ("coverage/lcov.info", "lcov"),
    ("coverage/coverage-final.json", "istanbul"),
    ("coverage/cobertura-coverage.xml", "cobertura"),
    ("lcov.info", "lcov"),
    (".coverage/lcov.info", "lcov"),
    ("coverage.json", "istanbul"),
    ("coverage/coverage-summary.json", "istanbul-summary"),
]

# Names and folders of tests, and folders that aren't looked at.
TEST_GLOBS = ["**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/*_spec.*", "**/test_*.*", "**/spec_*.*", "tests/**", "test/**", "__tests__/**", "spec/**"]
NO_TESTS = ["node_modules/", "dist/", "build/"]


def dependency_counts(files: DataFrame) -> DataFrame:
    """One row: direct and total dependencies by the manifests at the top, and whether any lock file lies there."""
    path, content = F.col("path"), F.col("content")
    keys = lambda *at: sum((F.coalesce(F.size(F.json_object_keys(F.get_json_object(content, f"$.{k}"))), F.lit(0)) for k in at), F.lit(0))
    locked = F.coalesce(F.size(F.json_object_keys(F.get_json_object(content, "$.packages"))), F.size(F.json_object_keys(F.get_json_object(content, "$.dependencies"))), F.lit(0))
    listed = F.size(F.filter(F.split(content, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")))
    at = lambda name, value: F.max(F.when(path == name, value)).cast("long")
    one = files.where("path NOT LIKE '%/%'").agg(at("package.json", keys("dependencies", "devDependencies")).alias("npm"), at("package-lock.json", locked).alias("lock"), at("requirements.txt", listed).alias("pip"), F.coalesce(F.bool_or(path.isin(LOCK_FILES)), F.lit(False)).alias("lockfile_found"))
    direct = F.coalesce("npm", "pip", F.lit(0))
    return one.select(direct.alias("direct"), F.when(F.col("npm").isNotNull(), F.coalesce("lock", "npm")).otherwise(direct).alias("total"), "lockfile_found")


def report_location(files: DataFrame) -> DataFrame:
    """path, format of the coverage report that counts: the first of REPORT_PLACES that is there, else an lcov.info at most three folders deep."""
    rank = F.coalesce(*[F.when(F.col("path") == place, F.lit(k)) for k, (place, _) in enumerate(REPORT_PLACES)], F.when((basename(F.col("path")) == "lcov.info") & (F.size(F.split("path", "/")) <= 4) & ~F.col("path").startswith("node_modules/"), F.lit(len(REPORT_PLACES))))
    kind = F.when(F.col("rank") == len(REPORT_PLACES), F.lit("lcov")).otherwise(F.get(F.array(*[F.lit(f) for _, f in REPORT_PLACES]), F.col("rank")))
    return files.select("path", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).select("path", kind.alias("format"))


def test_files(files: DataFrame) -> DataFrame:
    """path of files that are tests by their names or folders."""
    test = F.lit(False)
    for glob in TEST_GLOBS:
        test = test | F.col("path").rlike(glob_pattern(glob))
    for folder in NO_TESTS:
        test = test & ~F.col("path").startswith(folder)
    return files.where(test).select("path").distinct()


def file_coverage(coverage: DataFrame, path: str) -> DataFrame:
    """The rows of a coverage table (file, ...) whose file is the path, or of which one ends with the other."""
    return coverage.where((F.col("file") == path) | F.col("file").endswith(path) | F.lit(path).endswith(F.col("file")))


def log_with_files(commits: DataFrame, changes: DataFrame, most: int = 10) -> DataFrame:
    """hash, author, date, message, files (sorted) of the latest commits. changes: hash, path.

    The commits are chosen first, so only their changes are gathered.
    """
    latest = commits.orderBy(F.desc("date"), "hash").limit(most)
    own = changes.join(F.broadcast(latest.select("hash")), "hash").groupBy("hash").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return latest.join(own, "hash", "left").select("hash", "author", "date", "message", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def shown_tree(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """place, line: the files and folders of a tree as indented lines; sorted by place they read as the tree does, folders first."""
    parts = F.split("path", "/")
    each = files.where("path IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth))), lambda k: F.struct(F.slice(parts, 1, k).alias("at"), (k < F.size(parts)).alias("folder")))).alias("x")).select("x.*").distinct()
    mark = lambda name, folder: F.concat(F.when(folder, "0").otherwise("1"), name)
    depth = F.size("at")
    place = F.array_join(F.transform("at", lambda name, k: mark(name, (k < depth - 1) | F.col("folder"))), "/")
    return each.select(place.alias("place"), F.concat(F.repeat(F.lit("  "), depth - 1), F.element_at("at", -1), F.when(F.col("folder"), "/").otherwise("")).alias("line"))


def truncated(rows: DataFrame, order: list[str | Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows, and one row that says how many there are, how many are shown and whether any are left out."""
    told = rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(most).cast("long")).alias("shown"), (F.col("total") > most).alias("truncated"))
    return rows.orderBy(*order).limit(most), told
