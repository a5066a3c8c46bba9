"""Texts that hold any of many needles, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: Bytes of needles in one automaton; more needles are looked for in several passes over the texts.
AUTOMATON_BYTES = 16 << 20


def holds(files: DataFrame, needles: DataFrame, by_line: bool = False) -> DataFrame:
    """path, needle_id, n (places, overlaps included) and, by line, line_no of needles (needle_id, needle) in files.

    Needles are looked for as they are, by an automaton over all of a pass, so a text is read once a pass and not once a
    needle. A pass has needles of AUTOMATON_BYTES at most (a needle isn't split); they are broadcast. Needles that are
    equal are found each; null and empty needles and null texts give no rows.
    """
    spark = files.sparkSession
    own = checkpointed(needles.where("needle_id IS NOT NULL AND needle <> ''").select(F.col("needle_id").cast("long").alias("needle_id"), "needle"))
    size = own.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    passes = max(1, -(-size // AUTOMATON_BYTES))
    names = ["path", "needle_id", "line_no", "n"] if by_line else ["path", "needle_id", "n"]
    schema = ", ".join(f"{n} {'string' if n == 'path' else 'long'}" for n in names)
    found = spark.createDataFrame([], schema)
    for k in range(passes):
        by: dict[str, list[int]] = {}
        for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == k).toLocalIterator():
            by.setdefault(r["needle"], []).append(r["needle_id"])
        shared = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle, ids in shared.value.items():
                automaton.add_word(needle, ids)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                rows: dict[tuple, int] = {}
                for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = line = 0
                    for end, ids in automaton.iter(text):
                        if by_line:  # a place's line is that of its end; ends ascend, so newlines are counted once
                            line, at = line + text.count("\n", at, end), end
                        for i in ids:
                            key = (path, i, line + 1) if by_line else (path, i)
                            rows[key] = rows.get(key, 0) + 1
                if rows:
                    columns = [*zip(*rows, strict=True), list(rows.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        part = files.where("content IS NOT NULL").select("path", "content").mapInArrow(run, schema)
        found = found.unionByName(part)
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
