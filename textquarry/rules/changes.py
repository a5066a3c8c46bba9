"""What speaks for a category of change, and how a line names a type."""

from __future__ import annotations

# Categories; of equal scores the first one counts.
CATEGORIES = ["refactor", "bugfix", "feature", "breaking"]

# Category, points, indicator, condition on the numbers of lines added (up) and removed (down).
MEASURES: list[tuple[str, int, str, str]] = [
    ("refactor", 3, "Balanced additions/removals", "up > 0 AND down > 0 AND abs(up - down) < greatest(up, down) * 0.3"),
    ("feature", 3, "Mostly new code", "up > down * 3"),
]

# Category, points, indicator, words of which the text holds one, without regard to case.
WORDS: list[tuple[str, int, str, str]] = [
    ("bugfix", 2, "Bug-fix keywords present", "fix|bug|patch|hotfix|issue|error|crash|null|undefined|NaN"),
    ("feature", 2, "Feature keywords present", "feat|feature|add|new|implement|create|introduce"),
    ("breaking", 3, "Breaking change keywords", "BREAKING|removed|deprecated|renamed"),
]

# Kind, patterns that a line fits all of, where NAME is the type and WORD the type as a word; the first kind counts.
TYPE_USES: list[tuple[str, list[str]]] = [
    ("definition", [r"^(export\s+)?(interface|type|class|enum|struct)\s+WORD"]),
    ("import", [r"^(import|from|use|using)\s"]),
    ("extends", [r"(extends|implements).*WORD"]),
    ("generic", [r"<[^>]*WORD"]),
    ("return-type", [r"\)\s*:.*NAME|->\s*NAME"]),
    ("parameter", [r"\(.*:.*NAME", r"function|def |func |fn "]),
    ("variable", [r":\s*NAME"]),
]

# Points of a file's relevance to a query.
IN_PATH, EACH_HIT, MOST_HITS = 0.3, 0.1, 0.4
SOURCE_FILE, TEST_FILE, CONFIG_FILE = 0.1, -0.1, -0.05
TOP, EACH_FOLDER = 0.1, 0.01
