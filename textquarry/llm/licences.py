"""License scans, by DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line with a cue word, and every paragraph of several lines with one, is a passage. A passage's TF-IDF vector runs
over the templates' terms and its own (terms outside the templates weigh as ones that no template has), and its cosine
to each template is a join on terms. A file's licence is that of its best passage of `at_least` or more. A licence file
(by name, or because the best passage makes up `file_share` of its words) speaks for its directory; a file without a
licence of its own takes that of the nearest directory above it that has one, found by joins on the paths.

Only tables of the templates' terms are broadcast. Directories are aggregated before they are joined, and joins from
files to directories deal hot directories over slices.

Cases: a null or empty content has no passage and only inherits; a null path is a file in no directory and gets what its
own content says; repeated paths are one file with the best passage of all; ties of passages go to the licence later in
the alphabet; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, salted_join, stage, table

#: Notices by which files state these licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
]

def _gnu(name: str, licence: str, version: str) -> tuple[str, str]:
    return name, f"This program is free software; you can redistribute it and/or modify it under the terms of the {licence} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MAY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Titles, notices and grants of whole licences, and relatives that must win over their neighbours. Their terms weigh as
#: TEMPLATES have them; a term that TEMPLATES lacks weighs as one that no template has.
RELATIVES: list[tuple[str, str]] = [
    *[(f"CC-{k}-{v}", text.format(long=long, short=k, v=v)) for v in ("3.0", "4.0") for k, long in _CC.items() for text in ("This work is licensed under a Creative Commons {long} {v} International License.", "Licensed under CC {short} {v}.", "Creative Commons {long} {v} International Public License")],
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    *[_gnu(f"{short}-{v if '.' in v else v + '.0'}", f"GNU {long} General Public License", v) for short, long, vs in (("GPL", "", ("2", "3")), ("LGPL", "Lesser", ("2.1", "3")), ("LGPL", "Library", ("2",)), ("AGPL", "Affero", ("3",))) for v in vs],
    *[(n, f"GNU {long} General Public License Version {v}, {date}") for n, long, v, date in (("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), ("LGPL-2.0", "Library", "2", "June 1991"), ("LGPL-2.1", "Lesser", "2.1", "February 1999"), ("LGPL-3.0", "Lesser", "3", "29 June 2007"), ("AGPL-3.0", "Affero", "3", "19 November 2007"))],
    *[(n, f"This work is licensed under the GNU {long} General Public License, version {v}.") for n, long, v in (("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))],
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT + ", subject to the following conditions:"),
    ("X11", "X11 License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _MAY + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", _MAY + "."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", 'The BSD 2-Clause "Simplified" License'),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", 'The BSD 3-Clause "New" or "Revised" License'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "Eclipse Public License Version 1.0"),
    ("EPL-2.0", "Eclipse Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("CDDL-1.0", "Common Development and Distribution License (CDDL) Version 1.0"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Zlib", "zlib License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "The Unlicense"),
]
#: An identifier line, whose expression is taken as it stands, less the suffixes for later versions.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)"
CUE = r"(?i)licen[cs]e|copyright|spdx|hereby granted|redistribution and use|public domain|creative commons"
NAMES = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-][a-z0-9.-]*)?$"
AT_LEAST, FILE_SHARE = 0.5, 0.05
RESULT = "path, license, origin, score, from_dir"


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def vocabulary(templates: list[tuple[str, str]], more: list[tuple[str, str]] | None = None) -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """idf of the templates' terms, idf of any other term, and (license, term, weight) with unit-length templates.

    Templates in `more` get weights too, but leave idf as it is.
    """
    bags = [(name, Counter(terms_of(text))) for name, text in templates]
    df = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    other = math.log(1 + len(bags)) + 1
    rows = []
    for k, (name, bag) in enumerate(bags + [(name, Counter(terms_of(text))) for name, text in more or []]):
        norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in bag.items()))
        rows += [(f"{name}#{k}", t, n * idf.get(t, other) / norm) for t, n in bag.items()]
    return idf, other, rows


def _spdx(passage: Column, known: list[str]) -> Column:
    """The expression of an SPDX line, null where there is none; a known identifier in its usual letter case."""
    plain = F.regexp_replace(F.regexp_extract(passage, SPDX, 1), r"(?i)(-only|-or-later|\+)(?![a-z0-9.+-])", "")
    usual = F.create_map(*[F.lit(x) for name in known for x in (name.lower(), name)])
    return F.when(~F.lower(plain).isin("", "none", "noassertion"), F.coalesce(F.try_element_at(usual, F.lower(plain)), plain))


def own_licences(files: DataFrame, templates: list[tuple[str, str]] | None, at_least: float) -> DataFrame:
    """path, license, score, share (the passage's part of the words) of files with an SPDX line or a passage that is near a template.

    The first lines of the BSD licences are the same: one that goes on to binary form, but never to the clause on names,
    has two clauses.
    """
    spark = files.sparkSession
    templates, more = templates or TEMPLATES, [] if templates else RELATIVES
    idf, other, weights = vocabulary(templates, more)
    idf_table = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    weight_table = F.broadcast(spark.createDataFrame(weights, "template string, term string, weight double"))
    cued = files.where(F.col("content").rlike(CUE)).select("path", "content", F.regexp_count("content", F.lit(WORD)).alias("n_words"))
    two = files.where(F.col("content").rlike(r"(?i)redistributions\s+in\s+binary\s+form") & ~F.col("content").rlike(r"(?i)neither\s+the\s+name|names\s+of\s+(its|the)\s+contributors")).select("path").distinct().withColumn("two", F.lit(True))
    lines = F.split("content", "\n")
    paragraphs = F.filter(F.split("content", r"\n[\x20\x09-\x0D]*\n"), lambda x: x.contains("\n"))
    units = cued.select("path", "n_words", F.posexplode(F.filter(F.concat(lines, paragraphs), lambda x: x.rlike(CUE))).alias("unit", "passage"))
    counted = units.select("path", "unit", F.xxhash64("passage").alias("same"), "n_words", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    keys = ["path", "unit", "same", "n_words"]
    tf = counted.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")).join(idf_table, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    tf = stage(tf, "licence-terms", narrow=True)
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("n_terms"))
    dots = tf.join(weight_table, "term").groupBy(*keys, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, keys).select("path", "n_words", "n_terms", F.substring_index("template", "#", 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    if more:
        marks = units.where(~F.col("passage").contains("\n") & F.col("passage").rlike("(?i)spdx")).withColumn("license", _spdx(F.col("passage"), sorted({n for n, _ in templates + more})))
        marks = marks.where("license IS NOT NULL").select("path", "n_words", F.regexp_count(F.lower("passage"), F.lit("[a-z0-9]+")).alias("n_terms"), "license", F.lit(1.0).alias("score"))
        notices = scored.where(F.col("score") >= at_least).join(two.hint("merge"), "path", "left")
        named = F.when(F.col("two") & (F.col("license") == "BSD-3-Clause") & (F.col("n_terms") > 10), "BSD-2-Clause").otherwise(F.col("license"))
        scored = notices.withColumn("license", named).drop("two").unionByName(marks)
    best = scored.where(F.col("score") >= at_least).groupBy("path").agg(F.max(F.struct("score", "license", (F.col("n_terms") / F.col("n_words")).alias("share"))).alias("b"))
    return best.select("path", "b.license", "b.score", "b.share")


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, at_least: float = AT_LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """RESULT for each path of files(path, content). origin: own, licence file, inherited, or null."""
    given = files.select(F.col("path").cast("string"), F.col("content").cast("string"))
    own = stage(own_licences(given.withColumn("path", F.coalesce("path", F.lit("\0"))), templates, at_least), "own-licences", narrow=True)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "[^/]*$", 0)
    paths = given.select(F.coalesce("path", F.lit("\0")).alias("path")).distinct().join(own.hint("merge"), "path", "left")
    speaks = F.col("license").isNotNull() & (name.rlike(NAMES) | (F.col("share") >= file_share))
    paths = stage(paths.select("path", F.when(F.col("path") != "\0", folder).alias("dir"), "license", "score", F.coalesce(speaks, F.lit(False)).alias("speaks")), "licence-paths", narrow=True)
    spoken = paths.where("speaks AND dir IS NOT NULL").groupBy("dir").agg(F.max(F.struct("score", "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    climb = paths.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.inline(ups))
    climb = stage(climb.where("above = dir OR above <> ''").union(climb.where("above = '' AND depth = 0 AND dir <> ''")).distinct(), "licence-directories", narrow=True)
    nearest = salted_join(climb, spoken, "above", ["dir"]).groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), F.col("b.dir_license").alias("dir_license"))
    out = salted_join(paths, nearest, "dir", ["path"], "left")
    inherited = F.col("license").isNull() & F.col("dir_license").isNotNull()
    return out.select(
        F.when(F.col("path") != "\0", F.col("path")).alias("path"),
        F.coalesce("license", "dir_license").alias("license"),
        F.when(F.col("speaks"), "licence file").when(F.col("license").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        "score",
        F.when(inherited, F.col("from_dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """documents as a tree: source, then thousands and hundreds of identifiers."""
    i = F.col("doc_id")
    return F.concat(F.coalesce("source", F.lit("unknown")), F.format_string("/%04d/%02d/", F.floor(i / 1000), F.floor(F.pmod(i, F.lit(1000)) / 100)), i.cast("string"), F.lit(".txt"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select(document_path().alias("path"), F.col("text").alias("content"))).select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", "origin", "score", "from_dir")


def _oracle() -> str:
    idf, other, weights = vocabulary(TEMPLATES)
    idf_rows = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(idf.items()))
    weight_rows = ", ".join(f"('{n}', '{t}', {x!r}::DOUBLE)" for n, t, x in weights)
    cue = CUE
    return f"""WITH idf(term, idf) AS (VALUES {idf_rows}), weights(template, term, weight) AS (VALUES {weight_rows}),
    files AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || lpad((doc_id // 1000)::VARCHAR, 4, '0') || '/' || lpad(((doc_id % 1000) // 100)::VARCHAR, 2, '0') || '/' || doc_id || '.txt' AS path, text AS content FROM documents),
    units AS (SELECT path, n_words, generate_subscripts(u, 1) AS unit, unnest(u) AS passage FROM (
      SELECT path, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS n_words,
        list_filter(list_concat(string_split(content, chr(10)), list_filter(string_split_regex(content, '\\n[\\x20\\x09-\\x0D]*\\n'), lambda x: contains(x, chr(10)))), lambda x: regexp_matches(x, '{cue}')) AS u
      FROM files WHERE regexp_matches(content, '{cue}'))),
    tf AS (SELECT path, unit, n_words, term, count(*) AS tf FROM (SELECT path, unit, n_words, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
    x AS (SELECT tf.*, tf * coalesce(idf, {other!r}) AS x FROM tf LEFT JOIN idf USING (term)),
    norms AS (SELECT path, unit, sqrt(sum(x * x)) AS norm, sum(tf) AS n_terms FROM x GROUP BY ALL),
    dots AS (SELECT path, unit, n_words, template, sum(x * weight) AS dot FROM x JOIN weights USING (term) GROUP BY ALL),
    scored AS (SELECT path, n_terms / n_words AS share, split_part(template, '#', 1) AS license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (path, unit)),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license DESC, share DESC) AS k FROM scored WHERE score >= {AT_LEAST}) WHERE k = 1),
    paths AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, score, coalesce(license IS NOT NULL AND share >= {FILE_SHARE}, false) AS speaks FROM files LEFT JOIN own USING (path)),
    spoken AS (SELECT dir AS above, license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) AS k FROM paths WHERE speaks) WHERE k = 1),
    climb AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM paths))),
    nearest AS (SELECT dir, above AS from_dir, dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY depth DESC) AS k FROM climb JOIN spoken USING (above)) WHERE k = 1)
    SELECT regexp_extract(path, '([0-9]+)\\.txt$', 1)::BIGINT AS doc_id, path, coalesce(license, dir_license) AS license,
      CASE WHEN speaks THEN 'licence file' WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS origin, score,
      CASE WHEN license IS NULL AND dir_license IS NOT NULL THEN from_dir END AS from_dir
    FROM paths LEFT JOIN nearest USING (dir)"""


ORACLE_SQL = _oracle()
