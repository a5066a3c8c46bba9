"""Column functions on text whose results must not depend on a regex dialect or a locale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import languages as L
from ..rules.concepts import CONCEPTS, STOP_WORDS
from ..rules.lines import word

BLANK = "[ \\t\\n\\r\\x0B\\f]"


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def half_up(x: Column) -> Column:
    """The nearest integer, halves upward."""
    return F.floor(x + 0.5).cast("long")


def counted(x: Column, patterns: list[str]) -> Column:
    """Matches of all patterns together."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.regexp_count(x, F.lit(p)), F.lit(0)) for p in patterns)).cast("long")


def words(patterns: list[str]) -> list[str]:
    return [word(p) for p in patterns]


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def language_of(path: Column) -> Column:
    """The language of a path by its special name, else by its last extension, else `unknown`."""
    low = F.lower(path)
    out = F.when(low.contains("dockerfile."), "dockerfile")
    for name, language in L.SPECIAL_NAMES:
        out = out.when(low.endswith(name), language)
    pairs = [F.lit(x) for pair in L.LANGUAGE_OF.items() for x in pair]
    return out.otherwise(F.coalesce(F.element_at(F.create_map(*pairs), F.regexp_extract(low, r"\.[^.]*$", 0)), F.lit("unknown")))


def is_code(language: Column) -> Column:
    return (language != "unknown") & ~language.isin(L.NOT_CODE)


def category_of(language: Column) -> Column:
    """Comma-separated categories of a language, or `General`."""
    named = F.concat_ws(", ", *(F.when(language.isin(members), F.lit(name)) for name, members in L.CATEGORIES.items()))
    return F.when(named == "", "General").otherwise(named)


QUOTED = r"'[^']*'|\"[^\"]*\"|`[^`]*`"


#: A run of letters and digits up to where a capital follows a small letter.
TERM = r"[A-Za-z0-9](?:[a-z0-9]|(?<![a-z])[A-Z])*"


def terms(text: Column) -> Column:
    """Distinct lower-case terms of more than two characters: quoted spans go, camel case and punctuation split.

    Words are made distinct before they are lower-cased and compared with the stop words.
    """
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, QUOTED, ""), F.lit(TERM), F.lit(0)))
    return F.array_except(F.transform(F.filter(words, lambda w: F.length(w) > 2), F.lower), F.array(*[F.lit(w) for w in STOP_WORDS]))


def terms_of(text: str) -> list[str]:
    """terms() of a query, on the driver."""
    import re

    x = re.sub("[^a-zA-Z0-9]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", re.sub(QUOTED, "", text)))
    return list(dict.fromkeys(w for w in x.lower().split() if len(w) > 2 and w not in STOP_WORDS))


def expanded(query: str) -> list[str]:
    """The query's terms with all synonyms of the concepts they belong to."""
    out = dict.fromkeys(terms_of(query))
    for t in list(out):
        for concept, synonyms in CONCEPTS.items():
            if t == concept or t in synonyms:
                out |= dict.fromkeys(synonyms)
    return list(out)


def token_estimate(text: Column) -> Column:
    """Tokens of a text by a quarter of its code points, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of *, ** and ?."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^(?:.*/)?{out}$" if "/" not in glob else f"^{out}$"
