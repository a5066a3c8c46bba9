from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import database, same  # noqa: E402

from textquarry.llm import common, components, importance, jaccard, lexical, licences, mixing, packing, pii, quality, registry, simhash, sstable, substrings, tokens, topk, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = [prose(120) for _ in range(12)]


def edited(text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY) + "x"
    return " ".join(w)


@functools.cache
def corpus_rows() -> list[tuple]:
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(BASE)]
    rows += [(100 + k, edited(BASE[k % 4], k % 5), "de", "s0", 1) for k in range(40)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \t\n", "en", "s0", 3), (203, "a b", "en", "s0", 3), (204, "A b", "fr", "s1", 3), (205, "a b c d e f", "en", "s1", 11)]
    rows += [(0, BASE[0], "en", "s0", 5), (None, BASE[1], "en", "s1", 5), (300, BASE[5] * 40, "en", "s2", 1), (301, "é" * 3000 + " " + BASE[6], "fr", "s2", 1), (302, "x" * 500, "en", "s2", 500)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# --- plumbing


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(900)] + [(1000, None)], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("other", 3)], "key string, v int")
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in common.salted_join(left, right, "key", ["id"], how, slice_rows=50).select("id", "key", "v").collect())
        assert got == Counter(tuple(r) for r in left.join(right, "key", how).select("id", "key", "v").collect())


def test_all_of_many_hot_keys_are_dealt_out(spark):
    """1,000 hot keys: no slice of a key has far more than its share of rows."""
    left = spark.range(200_000).select("id", F.pmod("id", F.lit(1000)).alias("key"))
    hot = common.hot_keys(left, "key", 50)
    assert Counter(r["_slices"] for r in hot.collect()) == {4: 1000}
    dealt = left.join(hot, "key").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")))
    assert dealt.groupBy("key", "_slice").count().agg(F.max("count")).first()[0] <= 2 * 50
    right = spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    assert common.salted_join(left, right, "key", ["id"], slice_rows=50).count() == 200_000


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 230)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 1)]
    par: dict = {}

    def find(v):
        par.setdefault(v, v)
        while par[v] != v:
            v = par[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in par}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 licences


def test_licences_and_inheritance(spark):
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "Released under the MIT License."),
            ("a/x/y/code.py", "print(1)"),
            ("a/x/COPYING", "Licensed under the Apache License, Version 2.0."),
            ("b/readme", "words " * 300 + "\nThis work is licensed under the GNU General Public License, version 3.\n"),
            ("b/other", "words"),
            ("c/prose", "the driving license of my aunt expired in May and she was not amused at all by this"),
            (None, "Licensed under CC BY-NC 4.0."),
            ("e/null", None),
            ("e/empty", ""),
        ],
        "path string, content string",
    ).withColumn("license", F.lit("clash"))
    got = {r["path"]: (r["license"], r["origin"], r["from_dir"]) for r in licences.scan(files).collect()}
    assert got["a/x/y/code.py"] == ("Apache-2.0", "inherited", "a/x")
    assert got["a/LICENSE"][:2] == ("MIT", "licence file")
    assert got["b/readme"][:2] == ("GPL-3.0", "own") and got["b/other"] == (None, None, None)
    assert got["c/prose"] == (None, None, None) and got[None][0] == "CC-BY-NC-4.0"
    assert got["e/null"] == got["e/empty"] == (None, None, None)
    assert licences.scan(files.limit(0)).count() == 0


# --- 2 archives


def archive(version: int, blocks: list[bytes], form: str) -> bytes:
    """An ARC file: plain, in one gzip member, in one for each record, or in members that cut records anywhere."""
    parts = [warc.version_block("a.arc", version)]
    for k, block in enumerate(blocks):
        parts.append(warc.arc_record(version, "a.arc", sum(map(len, parts)), f"http://h/{k} x", block))
    whole = b"".join(parts)
    return {"plain": lambda: whole, "one": lambda: warc._member(whole), "each": lambda: b"".join(map(warc._member, parts)), "cut": lambda: b"".join(warc._member(whole[lo : lo + 777]) for lo in range(0, len(whole), 777)) + b"\0" * 512}[form]()


@pytest.mark.parametrize("form", ["plain", "one", "each", "cut"])
@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_each_version_and_form(tmp_path, version, form):
    name = tmp_path / "a.arc"
    blocks = [warc.http_block(7, b"x\nhttp://no header 1\n\n\r\n"), b"", warc.http_block(8, b"\n"), warc.http_block(9, bytes(range(256)) * 20_000)]
    name.write_bytes(archive(version, blocks, form))
    got = list(warc.arc_records(str(name)))
    assert [b for _, _, b in got] == blocks and [h["URL"] for _, h, _ in got] == [f"http://h/{k}%20x" for k in range(4)]
    assert all(len(h) == (5 if version == 1 else 10) and int(h["Archive-length"]) == len(b) for _, h, b in got)
    whole = archive(version, blocks, "plain")
    assert [o for o, _, _ in got] == sorted({o for o, _, _ in got}) and all(whole[o:].startswith(f"http://h/{k}%20x ".encode()) for k, (o, _, _) in enumerate(got))


def test_arc_files_of_others(tmp_path):
    """Carriage returns, spaces in a URL, no line between records; damaged files are refused, an empty one has no records."""
    body = b"1 0 Other\nURL IP-address Archive-date Content-type Archive-length\n"
    head = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n" % len(body) + body
    name = tmp_path / "x.arc"
    name.write_bytes(head + b"\r\n\nhttp://a/b c d 1.2.3.4 20010203040506 text/html 3\r\nabchttp://e 1.2.3.4 20010203040507 text/html 0\n")
    assert [(h["URL"], h["Archive-date"], b) for _, h, b in warc.arc_records(str(name))] == [("http://a/b c d", "20010203040506", b"abc"), ("http://e", "20010203040507", b"")]
    for data, message in ((head + b"u 0.0.0.0 1 text/html 99\nabc", "shorter"), (head + b"u 1\n", "fields"), (warc._member(head)[:-9], "gzip member"), (b"f://x 0.0.0.0 1 text/plain 4\n9 0\n", "version")):
        name.write_bytes(data)
        with pytest.raises(ValueError, match=message):
            list(warc.arc_records(str(name)))
    name.write_bytes(b"")
    assert list(warc.arc_records(str(name))) == []


def test_foreign_arc_files_become_warc(spark, tmp_path):
    """Plain and one-member files of both versions, and a payload of several MB, through the whole converter."""
    pages = [f"page {k}" for k in range(3)] + ["long " * 800_000, "page 1"]
    paths = []
    for version, form in ((1, "plain"), (2, "one"), (1, "each"), (2, "cut")):
        paths.append(f"{tmp_path}/{version}{form}.arc")
        Path(paths[-1]).write_bytes(archive(version, [warc.http_block(k, x.encode()) for k, x in enumerate(pages)], form))
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    resolved = warc.resolve(common.stage(warc.scan_arc(files), "f1"))
    got = common.stage(warc.scan_warc(common.stage(warc.convert(resolved, common.new_folder(spark, "f-warc")), "f2")), "f3").collect()
    assert Counter((r["page_id"], r["payload_digest"]) for r in got) == Counter((k, warc.digest(x.encode())) for k, x in enumerate(pages) for _ in paths)
    assert Counter(r["record_type"] for r in got) == {"response": 4, "revisit": 16}


def convert(spark, pages, least=0):
    arcs = common.stage(warc.write_arc(pages, common.new_folder(spark, "t-arc")), "t1")
    resolved = warc.resolve(common.stage(warc.scan_arc(arcs), "t2"), least)
    return common.stage(warc.scan_warc(common.stage(warc.convert(resolved, common.new_folder(spark, "t-warc")), "t3")), "t4")


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}", ["same", "", None, f"p{k} é"][k % 4]) for k in range(40)] + [(None, None, "same"), (3, "http://h/3", "p3 é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = convert(spark, pages).collect()
    best: dict = {}
    for k, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if k is None else k)
    ids = {r["record_id"]: r["page_id"] for r in got}
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((k, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for k, _, h in rows)
    for h in ("same", "", "p3 é"):
        d = warc.digest(h.encode())
        assert [r["page_id"] for r in got if r["payload_digest"] == d and r["record_type"] == "response"] == [best[h]]
        assert {ids[r["refers_to_id"]] for r in got if r["payload_digest"] == d and r["record_type"] == "revisit"} <= {best[h]}
    assert all(r["record_type"] == "response" for r in convert(spark, pages, least=10).collect())
    assert convert(spark, pages.limit(0)).count() == 0


# --- 3 n-gram Jaccard join


def brute_classes(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for k, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    par = {k: k for k, _ in sets if k is not None}

    def find(v):
        while par[v] != v:
            v = par[v]
        return v

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and find(a) != find(b) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                par[max(p, q)] = min(p, q)
    return Counter((k, len(s), None if k is None else find(k)) for k, s in sets)


def test_jaccard_against_all_pairs(spark, docs, none):
    extra = docs.withColumn("class", F.lit("clash")).withColumn("fp", F.lit(1))
    assert Counter(tuple(r) for r in jaccard.classes(extra).collect()) == brute_classes(corpus_rows())
    assert jaccard.classes(none).count() == 0


def test_jaccard_at_the_threshold(spark):
    words = [f"t{k}" for k in range(13)]  # 9 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:11])), (4, " ".join(words[:8])), (5, " ".join(words[:9]))]
    got = Counter(tuple(r) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)


def shared_passages(n: int, own: int) -> list[tuple]:
    """Texts of one common passage and own words, and near copies of each: long lists of many classes, and stars."""
    passage = prose(60)
    rows = []
    for k in range(n):
        text = f"{passage} " + " ".join(f"o{k}x{j}" for j in range(own + k % 5))
        rows += [(10 * k + j, edited(text, j) if j else text) for j in range(1 + k % 4)]
    return rows


def test_jaccard_with_lists_and_stars_dealt_out(spark, monkeypatch):
    """Every table that deals out hot lists, classes and pivots does so at a handful of rows; the rows stay the same."""
    for name, value in (("LIST_ROWS", 4), ("ANSWERS", 2), ("BLOCK", 2), ("HOT_CLASS", 1), ("HOT_SLICES", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "member_pairs", functools.partial(jaccard.member_pairs, chunk=3))
    rows = [r[:2] for r in corpus_rows()] + [(1000 + k, t) for k, t in shared_passages(24, 8)]
    got = Counter(tuple(r) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)


def test_jaccard_of_a_group_beyond_one_slice(spark):
    """2,100 near copies of one text, and lists of more classes than one task compares."""
    own = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(2100):
        w = list(base)
        for _ in range(own.randrange(1, 3)):
            w[own.randrange(60)] = f"x{own.randrange(40)}"
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, " ".join([*base[:30], *(f"u{k}x{j}" for j in range(7))])) for k in range(600)]
    got = Counter(tuple(r) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)


def test_answers_derived_from_a_pivots_are_those_of_the_texts(spark):
    own = random.Random(4)
    base = [f"w{k}" for k in range(300)]

    def near(w: list[str], n: int) -> list[str]:
        w = list(w)
        for _ in range(n):
            k = own.randrange(len(w))
            w[k : k + 1] = own.choice([[], [f"y{own.randrange(99)}"], [w[k], f"z{own.randrange(99)}"]])
        return w

    rows = [(k, " ".join(near(base, own.randrange(1, 9)))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stars = jaccard.star_links(spark.createDataFrame([(k, 0) for k in range(1, 30)], "a long, p long"), docs, 5, 80)
    derived = stars.select("a", F.col("b").alias("pivot"), "minus", "plus")
    pairs = spark.createDataFrame([(a, z) for a in range(1, 40) for z in range(40) if a != z], "a long, p long")
    got = {tuple(r) for r in jaccard.answers(pairs, derived, docs, 5, 80).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows)}
    assert derived.count() > 5 and 0 < len(got) < 39 * 39
    assert got == {(a, z) for a in range(1, 40) for z in range(40) if a != z and 100 * len(sets[a] & sets[z]) >= 80 * len(sets[a] | sets[z])}


def test_pairs_that_buckets_miss_are_found_by_the_index(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "_stars", lambda nodes, percent: nodes.select(F.col("node").alias("a"), F.col("node").alias("p")).limit(0))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in jaccard.classes(docs).collect()) == brute_classes(corpus_rows())


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
"""
GNU = """ * {0} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {1}General Public
 * License as published by the Free Software Foundation; either
 * version {2} of the License, or (at your option) any later version."""
HEADERS = [
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;"),
    ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
    ("BSD-3-Clause", "# Copyright 2021 Someone\n# SPDX-License-Identifier: bsd-3-clause\n"),
    ("GPL-3.0", "<!-- SPDX-License-Identifier: GPL-3.0-or-later -->"),
    ("Zlib", "// SPDX-License-Identifier: Zlib"),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse products."),
    ("BSD-2-Clause", BSD),
    ("ISC", "Copyright (c) 2019, Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", GNU.format("This library", "Lesser ", "2.1")),
    ("AGPL-3.0", GNU.format("Thing", "Affero ", "3")),
    ("GPL-2.0", GNU.format("Thing", "", "2")),
    ("GPL-3.0", GNU.format("Thing", "", "3")),
    ("CC-BY-SA-4.0", "The texts are licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-3.0", "This page is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS"),
    (None, "Copyright 2020 Someone. All rights reserved."),
    (None, "License"),
]


def test_licences_of_headers_that_the_tables_lack(spark):
    files = spark.createDataFrame([(f"d{k:02}/file", text) for k, (_, text) in enumerate(HEADERS)], "path string, content string")
    got = {r["path"]: r["license"] for r in licences.scan(files).collect()}
    assert got == {f"d{k:02}/file": name for k, (name, _) in enumerate(HEADERS)}


# --- 4 sorted string tables, tokens


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_of_words_are_the_ids_of_texts(texts):
    t = encoder()
    got = {k: ids.tolist() for k, ids in tokens.encoded(pa.array(texts, pa.string()), tokens.default_vocabulary())}
    assert got == {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}


@pytest.mark.parametrize("space", ["\u00a0", "\u2003", "\u2028", "\u0085", "\u3000"])
def test_words_of_unicode_space_dont_shift_ids(space):
    """A word that is only such a space vanishes in normalisation and one that holds one splits, so counts stay equal."""
    t, text = encoder(), f"alpha {space} beta gam{space}ma delta {space}"
    assert tokens.unit_ids(tokens.default_vocabulary()).direct
    ((_, got),) = tokens.encoded(pa.array([text]), tokens.default_vocabulary())
    assert got.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_every_character_by_itself_and_beside_others():
    t = encoder()
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [x for lo in range(0, len(chars), 64) for x in ("".join(chars[lo : lo + 64]), " ".join(chars[lo : lo + 64]), " ".join(f"a{c}B{c}1{c}, \u00c9{c}" for c in chars[lo : lo + 64]))]
    texts += ["<|startoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "don't DON'T 'll x's 12.5% \u00d7\u00f7 \u00c3\u0083 \u00df\u1e9e"]
    want = [[*e.ids, 1] for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    got = {k: ids.tolist() for k, ids in tokens.encoded(pa.array(texts), tokens.default_vocabulary())}
    assert [k for k, x in enumerate(want) if got[k] != x] == []


def test_ids_with_a_cache_that_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 200)
    monkeypatch.setattr(tokens, "SLOTS", 256)
    own, t = tokens.UnitIds(tokens.default_vocabulary()), encoder()
    for k in range(12):
        texts = [prose(rng.randrange(1, 400)) + f" x{k}, y{j}." for j in range(4)] + ["", "one"]
        raw = [x.encode() for x in texts]
        ids, base = own.texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
        assert [ids[a:b].tolist() for a, b in zip(base, base[1:], strict=False)] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_sstable_documents_and_lookup(spark, docs, none):
    manifest = common.gathered(sstable.write(docs, common.new_folder(spark, "t-sst"), shards=3))
    got = [tuple(r) for r in sstable.documents(manifest).collect()]
    t = encoder()
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    expect = Counter((k, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for k, x, *_ in corpus_rows())
    assert Counter((a, n, c) for a, _, n, c in got) == expect
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in corpus_rows()), key=lambda k: (k is not None, k))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    readers = [sstable.Reader(r["path"]) for r in manifest.collect()]
    for k, x in ((205, "a b c d e f"), (200, None)):
        assert [v.tolist() for r in readers for v in r.get(k)] == [ids(x)]
    assert sum(len(r.get(0)) for r in readers) == 2 and not any(r.get(999_999) for r in readers)
    assert sstable.documents(common.gathered(sstable.write(none, common.new_folder(spark, "t-sst"), shards=2))).count() == 0


def test_sstable_of_one_identifier_over_shards_blocks_and_wide_ids(spark, tmp_path, monkeypatch):
    """One identifier holds most rows: they are split over shards; a lookup finds all, across blocks too."""
    rows = [(7, f"text {k}") for k in range(300)] + [(k, "one") for k in range(20)] + [(None, f"null {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_h", F.lit("clash"))
    manifest = common.gathered(sstable.write(docs, common.new_folder(spark, "t-sst"), shards=6))
    got = sorted((tuple(r) for r in sstable.documents(manifest).collect()), key=lambda r: r[1])
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows) and [r[0] is not None and r[0] for r in got] == sorted(r[0] is not None and r[0] for r in got)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    readers = [sstable.Reader(r["path"]) for r in manifest.collect()]
    assert sum(len(r.get(7)) for r in readers) == 301 and sum(any(True for _ in r.get(7)) for r in readers) > 1 and sum(len(r.get(None)) for r in readers) == 30
    monkeypatch.setattr(sstable, "BLOCK", 64)
    with open(tmp_path / "x.sst", "wb") as out:
        own = sstable.Writer(out)
        given = [(k // 5, np.arange(k % 40, dtype=np.uint32) + (70_000 if k % 2 else 0)) for k in range(200)]
        for k, ids in given:
            own.add(sstable.key_of(k), ids)
        own.close()
    reader = sstable.Reader(str(tmp_path / "x.sst"))
    assert len(reader.blocks) > 40 and (reader.docs, reader.ids) == (200, sum(len(x) for _, x in given))
    for k in range(40):
        assert [v.tolist() for v in reader.get(k)] == [x.tolist() for j, x in given if j == k]
    assert [(sstable.id_of(k), v.tolist()) for k, v in reader.scan()] == [(k, x.tolist()) for k, x in given] and reader.get(999) == []


def test_shards_follow_the_input(spark, small, monkeypatch):
    docs = common.table(spark, small, "documents").select("doc_id", "text")
    assert sstable.shard_count(docs) == common.spread(spark)
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4096)
    assert sstable.shard_count(docs) > common.spread(spark)


def test_keys_sort_as_identifiers():
    ids = [None, -(2**63), -5, 0, 7, 256, 2**63 - 1]
    keys = [sstable.key_of(k) for k in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


# --- 5 pseudonyms


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = 'card 4785380592391139, 4785-3805-9239-1139 bad 4785380592391138 on 2024-02-29 not 2023-02-29 or 31/12/1999 at 10.0.0.255 not 10.0.0.256 call +1 (743) 555-3824 ssn 123-45-6789 iban DE89370400440532013000 v1.2.3 mail bob.1@x.com token = "abcdef0123"'
    rows = [(1, text), (2, "pay 4785380592391139"), (3, None), (4, ""), (5, "nothing"), (None, "10.0.0.255")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_pseudonyms", F.lit("clash")).withColumn("odd name`", F.lit(1)).drop("odd name`")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = got[1]["text"]
    for keep in ("4785380592391138", "2023-02-29", "10.0.0.256", "v1.2.3"):
        assert keep in new
    for gone in ("4785380592391139", "2024-02-29", "31/12/1999", "10.0.0.255", "555-3824", "123-45-6789", "DE8937", "bob.1", "abcdef0123"):
        assert gone not in new
    card = re.search(r"card (\d{16})", new)[1]
    assert luhn(card) and got[2]["text"] == f"pay {card}" and re.search(r"(\d{4}-){3}\d{4}", new)[0].replace("-", "") == card
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"token = \"[0-9a-f]{10}\"", new)
    iban = re.search(r"DE\d{20}", new)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[None]["text"] in new and (got[3]["text"], got[4]["text"], got[5]["text"]) == (None, "", "nothing")
    assert pii.pseudonymise(df.limit(0), "k").count() == 0
    assert pii.pseudonymise(df, "other").where("doc_id = 2").first()["text"] != got[2]["text"]


def brute_round(key: str, kind: str, i: int, value: int) -> int:
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{value}".encode()).hexdigest()[:15], 16)


def brute_feistel(a: int, b: int, na: int, nb: int, key: str, kind: str) -> tuple[int, int]:
    for i in range(8):
        if i % 2:
            b = (b + brute_round(key, kind, i, a)) % nb
        else:
            a = (a + brute_round(key, kind, i, b)) % na
    return a, b


def brute_digits(d: str, key: str, kind: str) -> str:
    h = len(d) // 2
    a, b = brute_feistel(int(d[:h] or 0), int(d[h:] or 0), 10**h, 10 ** (len(d) - h), key, kind)
    return (f"{a:0{h}}" if h else "") + f"{b:0{len(d) - h}}"


def brute_like(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def brute_value(m: str, key: str) -> str:
    """The pseudonym of one candidate, in plain Python."""
    import datetime

    d = re.sub("[^0-9]", "", m)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if "@" in m:
        h = sha(f"{key}|mail|{m.lower()}")
        return f"user.{h[:12]}@{h[12:20]}.example.invalid"
    if '"' in m:
        head, value = re.match(r'([^"]*")([^"]+)"', m).groups()
        return head + (sha(f"{key}|secret|{value}") * -(-len(value) // 64))[: len(value)] + '"'
    if "(" in m or re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", m):
        country, area, exchange, line = d[:-10], int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
        if country not in ("", "1"):
            return brute_like(m, country + brute_digits(d[-10:], key, "phone abroad"))
        if area >= 200 and exchange >= 200:
            a, b = brute_feistel((area - 200) * 100 + line // 100, (exchange - 200) * 100 + line % 100, 80_000, 80_000, key, "phone")
            return brute_like(m, f"{country}{a // 100 + 200}{b // 100 + 200}{a % 100:02}{b % 100:02}")
        outside = [(x, y) for x in range(1000) for y in range(1000) if x < 200 or y < 200]
        a, b = brute_feistel(outside.index((area, exchange)), line, len(outside), 10_000, key, "phone shape")
        return brute_like(m, f"{country}{outside[a][0]:03}{outside[a][1]:03}{b:04}")
    if re.fullmatch(r"\d{13,19}|\d{4}([ -]\d{4}){3}", m):
        if not luhn(d) or not d.strip("0"):
            return m
        body = brute_digits(d[:-1], key, "card")
        return brute_like(m, next(body + str(c) for c in range(10) if luhn(body + str(c))))
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = m.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in o):
            return m
        a, b = brute_feistel(int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), 65536, 65536, key, "ipv4")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return m
        a, b = brute_feistel(areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", m):
        mod = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if mod(m[4:] + m[:4]) != 1:
            return m
        tail = re.search("[0-9]{1,16}$", m[4:])
        body = m[4:] if not tail else m[4 : 4 + tail.start()] + brute_digits(tail[0], key, "iban")
        return f"{m[:2]}{98 - mod(body + m[:2] + '00'):02}{body}"
    for shape in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y"):
        if re.fullmatch(r"\d{4}([-/])\d\d\1\d\d" if shape[1] == "Y" else r"\d\d([./])\d\d\1\d{4}", m):
            try:
                at = (datetime.datetime.strptime(m, shape).date() - datetime.date(1800, 1, 1)).days
            except ValueError:
                continue
            if 0 <= at < 146_097:
                a, b = brute_feistel(at // 773, at % 773, 189, 773, key, "date")
                return (datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)).strftime(shape)
    return m


def brute_text(text: str | None, key: str) -> str | None:
    return text and re.sub(pii.PATTERN, lambda m: brute_value(m[0], key), text)


ODD_VALUES = "(123) 055-0000 (017) 555-7713 +44 (123) 055-0000 +1 (743) 555-3824 999-999-9999 555.123.4567 0000000000000000 12.12.2012 31.02.2012 1799-12-31 2199-12-31 2200-01-01 2012/12/12 00.0.0.1 1.2.3.4 256.1.1.1 666-12-1234 899-99-9999 001-01-0001 123-00-1234 GB82WEST12345698765432 GB82WEST12345698765433 NO9386011117947 4111 1111 1111 1111 4111-1111-1111-1112 6011000990139424 x@y.z a.b%c@d-e.co.uk password: \"p\" api_key=\"" + "k" * 130 + "\" 1.2 7 abc123"


def test_pseudonyms_against_plain_python(spark):
    """The registered query on all of sf0.01, and odd values, very long texts and repeated rows."""
    folder = "/root/testdata/sf0.01"
    docs = common.table(spark, folder, "documents").select("doc_id", "text").collect()
    got = Counter((r["doc_id"], r["text"]) for r in pii.query(spark, folder).collect())
    assert got == Counter((r["doc_id"], brute_text(r["text"], pii.KEY)) for r in docs)
    rows = [(1, ODD_VALUES), (1, ODD_VALUES), (2, "x " * 300_000 + ODD_VALUES + " y" * 300_000)]
    got = Counter((r["doc_id"], r["text"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k2").collect())
    assert got == Counter((k, brute_text(t, "k2")) for k, t in rows)


def test_the_owner_of_the_key_can_undo_numbers_and_dates(spark):
    text = re.sub(r"x@y.*api_key=\S+", "", ODD_VALUES)
    df = spark.createDataFrame([(1, text), (2, "4111 1111 1111 1111 on 2024-02-29"), (3, None)], "doc_id long, text string")
    hidden = pii.pseudonymise(df, "k")
    assert hidden.where("doc_id = 2").first()["text"] != "4111 1111 1111 1111 on 2024-02-29"
    assert [r["text"] for r in pii.restore(hidden, "k").orderBy("doc_id").collect()] == [text, "4111 1111 1111 1111 on 2024-02-29", None]
    assert pii.restore(hidden, "other").where("doc_id = 2").first()["text"] != "4111 1111 1111 1111 on 2024-02-29"


def test_permutations_are_one_to_one(spark):
    days = spark.range(146_097 // 40).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (F.col("id") * 40).cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days, "k").select("text").distinct().count() == days.count()
    ips = spark.range(2000).select(F.concat(F.lit("10.7."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    assert pii.pseudonymise(ips, "k").select("text").distinct().count() == 2000


# --- 6 substrings


def brute_removed(rows, size):
    first: dict = {}
    for k, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], k)
    out = Counter()
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1) if k is not None else ():
            if first[b[i : i + size]] < k:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_substrings_against_all_windows(spark, docs, none):
    rows = [r[:2] for r in corpus_rows()] + [(400, "ab" * 100), (401, "ab" * 80 + "tail"), (402, "x" * 51), (403, "x" * 49), (404, BASE[7][10:59] + "!" + BASE[7][100:160]), (2, "other text of id two " * 4)]
    got = Counter(tuple(r) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("clash"))).drop("kept").collect())
    assert got == brute_removed(rows, 50)
    assert substrings.remove(none).count() == 0


def test_substrings_of_hot_anchors_and_slabs(spark, monkeypatch):
    """Common strings in many contexts are dealt out, slabs and gathering are small: the same bytes go."""
    for name, value in (("SLAB", 50), ("HOT", 8), ("GATHER", 300), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(substrings, name, value)
    own = random.Random(6)
    common = "the very same words stand in very many texts here"
    letters = lambda n: "".join(own.choice("abcdefgh ") for _ in range(n))
    around = [letters(40) for _ in range(6)]
    rows = [(k, f"{letters(30)}{own.choice(around)}{common[own.randrange(9):]}{own.choice(around)}{letters(30)}") for k in range(120)]
    rows += [(200 + k, "ab" * (40 + k)) for k in range(20)] + [(300, None), (301, ""), (302, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (5, rows[5][1])]
    got = Counter(tuple(r) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("kept").collect())
    assert got == brute_removed(rows, 50)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=120), st.integers(1, 50))
def test_deep_shallow_order(bits, depth):
    data = bytes(97 + b for b in bits)
    buf = np.frombuffer(data + b"\0" * 80, np.uint8)
    order, cls = substrings.deep_shallow(buf, np.arange(len(data)), depth, shallow=8)
    raw = buf.tobytes()
    keys = [raw[i : i + depth] for i in order]
    assert keys == sorted(keys)
    assert all((cls[i] == cls[i + 1]) == (keys[i] == keys[i + 1]) for i in range(len(keys) - 1))


# --- 7 top-k


def test_topk_exact_with_ties_and_bad_rows(spark):
    r = np.random.default_rng(1)
    vecs = [(k, r.normal(size=8).tolist()) for k in range(300)] + [(300 + k, [0.25] * 8) for k in range(20)]
    bad = [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8)]
    df = topk.quantised(spark.createDataFrame(vecs + bad, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for row in topk.search(df, df.where("vec_id % 50 = 0"), n_pivots=6).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    x = {k: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int) for k, v in vecs}
    assert dict(got) == {q: [(v, -s) for s, v in sorted((-int(x[q] @ x[v]), v) for v in x if v != q)[:5]] for q in x if q % 50 == 0}
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2


def test_topk_over_groups_and_blocks(spark, monkeypatch):
    """Several blocks of queries, several groups a task, ragged vectors, repeated and clashing rows; few rows leave the tasks."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 512)
    monkeypatch.setattr(topk, "GROUP", 64)
    r = np.random.default_rng(2)
    vecs = [(k, r.normal(size=8 - (k % 7 == 0)).tolist()) for k in range(900)] + [(5, r.normal(size=8).tolist()), (50, r.normal(size=8).tolist())]
    df = topk.quantised(spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1)))
    seen = {}
    kept = topk.stage
    monkeypatch.setattr(topk, "stage", lambda x, name, **kw: seen.setdefault(name, kept(x, name, **kw)))
    got = defaultdict(list)
    for row in topk.search(df, df.where("vec_id % 50 = 0"), n_pivots=6).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    pad = [(k, np.floor(256 * np.array([*v, *[0.0] * (8 - len(v))])).astype(int)) for k, v in vecs]
    for q in range(100, 900, 50):
        x = next(v for k, v in pad if k == q)
        assert got[q] == [(v, -s) for s, v in sorted((-int(x @ y), k) for k, y in pad if k != q)[:5]]
    assert len(got[50]) == 5  # two rows ask under one identifier: the best of both
    assert seen["found"].count() < 0.4 * 19 * 5 * 902 / 64


@pytest.mark.parametrize("value", [1e30, 1e12])
def test_scores_beyond_64_bits_are_an_error(spark, value):
    df = topk.quantised(spark.createDataFrame([(0, [value, 1.0]), (1, [value, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, df.where("vec_id = 0")).collect()


def test_large_scores_are_exact(spark):
    rows = [(k, [4_000_000.0 + k, 3.0 * k]) for k in range(8)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    x = [[int(256 * c) for c in v] for _, v in rows]
    assert got == [(v, -s) for s, v in sorted((-(x[0][0] * x[v][0] + x[0][1] * x[v][1]), v) for v in range(1, 8))[:5]]


# --- 8 packing


def check_packing(rows, given):
    t = encoder()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    want = Counter()
    for k, x in given:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for n, lo in enumerate(range(0, len(ids), 4096)):
            want[(k, n, lo, len(ids[lo : lo + 4096]), zlib.crc32(np.array(ids[lo : lo + 4096], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    return len(seq), sum(r["length"] for r in rows)


def test_packing_is_whole_and_tight(spark, docs, none):
    many = [(k, prose(rng.randrange(5, 700))) for k in range(400)]
    n, total = check_packing(packing.pack(spark.createDataFrame(many, "doc_id long, text string").repartition(9)).collect(), many)
    assert n <= 1.02 * total / 4096 + 1
    check_packing(packing.pack(docs.withColumn("piece", F.lit("clash"))).collect(), [(r[0], r[1]) for r in corpus_rows()])
    assert packing.pack(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_bins(sizes):
    bins = packing.best_fit(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 64) * 1.5 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_over_counts_is_best_fit(sizes):
    kinds = packing.best_fit_counts(Counter(sizes), 64)
    fills = Counter()
    for n, parts in kinds:
        fills[sum(size * each for size, each in parts)] += n
    assert fills == Counter(sum(sizes[i] for i in b) for b in packing.best_fit(sizes, 64))
    assert sum((Counter({size: n * each}) for n, parts in kinds for size, each in parts), Counter()) == Counter(sizes)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_packing_of_clustered_lengths_is_best_fit_over_all(spark, monkeypatch, broadcast):
    """Long texts in one partition and short ones in others: as tight as best-fit over all pieces at once."""
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    own = random.Random(3)
    long = [(k, " ".join(["w"] * own.randrange(33, 47))) for k in range(5000)]
    short = [(10_000 + k, " ".join(["w"] * own.randrange(4, 23))) for k in range(9000)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(long, schema).coalesce(1).unionByName(spark.createDataFrame(short, schema).repartition(2))
    rows = packing.pack(docs, room=64).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in long + short)
    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 64
    assert len(fills) == len(packing.best_fit([r["length"] for r in rows], 64))


@pytest.mark.parametrize(("at_once", "most"), [(1500, 1.02), (300, 1.05)])
def test_underfull_sequences_are_merged_up_a_tree(spark, monkeypatch, at_once, most):
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 100)
    own = random.Random(9)
    texts = [(k % 2500, " ".join(["w"] * (own.randrange(30, 60) if k < 1500 else own.randrange(1, 25)))) for k in range(6000)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2), room=64, slack=0).collect()
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(rows) == 6000 and len(at) <= most * len(packing.best_fit([r["length"] for r in rows], 64))


# --- 9 quality


def test_signals_against_plain_python(spark, docs):
    rows = [r[:2] for r in corpus_rows()] + [(500, "one line\none line\n\n \none line\n# $ |"), (501, "a b c d e f g h " * 3), (502, "q " * 8 + "z"), (503, "é ü\tñ\x0bß")]
    got = Counter(tuple(r)[:7] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), quality.Model({})).drop("text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for k, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want[(k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))] += 1
    assert got == want


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    learn, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.score(docs.select("doc_id", "text"), quality.train(docs, learn)).join(rest, "doc_id").where("NOT base_failed")
    clean = got.where("quality = 1 AND toxic = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = got.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.9 and junk < 0.2


def test_quality_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, empty))
    assert got.count() == docs.count() and got.where("kept = base_failed").count() == 0
    assert quality.score(none, quality.train(none, empty)).count() == 0


def test_null_labels_train_nothing(spark):
    """Null labels are no class 0; one head can lack what the other has; repeated identifiers don't depend on order."""
    good, bad = "the cat sat on the mat by the door and looked out at rain " * 3, "buy pills $$$ now click win cash prize buy buy click " * 3
    rows = [(k, f"{good if k % 2 else bad} w{k}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    make = lambda f, g: spark.createDataFrame([(k, f(k), g(k)) for k in range(80)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, make(lambda k: 1 if k % 2 else None, lambda k: None)).heads == {}
    model = quality.train(docs, make(lambda k: k % 2, lambda k: None))
    assert list(model.heads) == ["quality"]
    got = quality.score(docs.select("doc_id", "text").withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(None).cast("int")), model).collect()
    assert all((r["p_quality"] >= 0.5) == bool(r["doc_id"] % 2) and r["p_toxic"] is None for r in got) and len(got) == 80
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' again') AS text"))
    models = [quality.train(twice.orderBy(F.rand(seed)), make(lambda k: k % 2, lambda k: 0)) for seed in (1, 2)]
    assert all(np.array_equal(models[0].heads["quality"][0], m.heads["quality"][0]) for m in models)


def test_quality_heads_are_fitted_by_one_task_and_the_driver_gets_weights_only(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.001", "documents"), common.table(spark, "/root/testdata/sf0.001", "labels")
    heads = quality.train(docs, labels).heads
    assert set(heads) <= {"quality", "toxic"} and all(h[0].shape == (quality.DIMS,) and h[0].dtype == np.float32 for h in heads.values())


# --- 10 mixing


def test_raking_meets_its_marginals(spark):
    cells = spark.createDataFrame([(s, lang, t, 1 + (k * 7919) % 100) for k, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in ("en", "de") for t in "xy")], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.25, "y": 0.75}}
    got = mixing.rake(cells, goal, 20)
    total = cells.agg(F.sum("tokens")).first()[0]
    for d, shares in goal.items():
        for r in got.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] / total - shares[r[d]]) < 1e-6


@pytest.mark.parametrize("most", [20_000, 0])
def test_expected_shares_of_the_draw_meet_the_targets(spark, monkeypatch, most):
    """Shares of tokens times probability, where raking alone would ask for probabilities above 1 in rare cells."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", most)
    sizes = {("a", "en"): 600, ("a", "de"): 100, ("b", "en"): 200, ("b", "de"): 100, ("c", "en"): 50, ("c", "de"): 4}
    docs = spark.createDataFrame([(k, s, lang, "w " * n) for k, ((s, lang), n) in enumerate(sizes.items())], "doc_id long, source string, lang string, text string")
    targets = {"source": {"a": 0.5, "b": 0.42, "c": 0.08}, "lang": {"en": 0.64, "de": 0.36}}
    got = mixing.mix(docs, targets, budget=0.5, **({} if most else {"rounds": 60})).toPandas()
    assert got.probability.max() == 1.0
    drawn = got.n_tokens * got.probability
    assert abs(drawn.sum() / got.n_tokens.sum() - 0.5) < 1e-4
    for d, shares in targets.items():
        for value, share in shares.items():
            assert abs(drawn[got[d] == value].sum() / drawn.sum() - share) < 1e-4


def test_the_query_draws_its_targets(spark):
    """Expected shares of the registered query's draw, over all documents of sf0.1, are its targets to a tenth of a per cent."""
    got = mixing.query(spark, "/root/testdata/sf0.1").toPandas()
    drawn = got.n_tokens * got.probability
    assert got.probability.max() <= 1.0 and abs(drawn.sum() / got.n_tokens.sum() - mixing.BUDGET) < 1e-3
    for d, target in mixing.TARGETS.items():
        own = got.groupby(d).n_tokens.sum()
        goal = {k: target[k] for k in own.index} if isinstance(target, dict) else own**target / (own**target).sum()
        for value in own.index:
            assert abs(drawn[got[d] == value].sum() / drawn.sum() - goal[value]) < 1e-3, (d, value)


def test_share_beyond_reach_is_drawn_whole_and_warned_of(spark):
    docs = spark.createDataFrame([(0, "a", "w " * 990), (1, "b", "w " * 10)], "doc_id long, source string, text string")
    with pytest.warns(UserWarning, match="source"):
        got = {r["source"]: r["probability"] for r in mixing.mix(docs, {"source": {"a": 0.5, "b": 0.5}}, budget=0.5).collect()}
    assert got["b"] == 1.0 and abs(got["a"] * 990 - 250) < 1e-6


def test_mixing_of_odd_rows(spark, docs, none, monkeypatch):
    got = mixing.mix(docs.withColumn("factor", F.lit("clash")))
    assert got.count() == docs.count() and got.where("probability IS NULL OR sampled IS NULL").count() == 0
    assert mixing.mix(none).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    by = lambda df: Counter((r["doc_id"], round(r["factor"], 9), r["sampled"]) for r in df.collect())
    assert by(mixing.mix(docs, rounds=2)) == by(_unsalted(docs, monkeypatch))


def _unsalted(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 20_000)
    return mixing.mix(docs, rounds=2)


# --- 11 importance resampling


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_resampled(docs, target, n, width, percent, least):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = word.findall(ascii_lower(t or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % width for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + width) / ((s[b] + 1) * (t_all + width))))
    rows = []
    for k, w, f in found:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(w), len(f), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0], r[2]))
    drawn = percent * len(order) // 100
    out = Counter((*r, k + 1 if k < drawn else None) for k, r in enumerate(order))
    return out + Counter((*r, None) for r in rows if r[1] < least or r[0] is None)


ODD_TEXTS = [(500, "Under_score; \u00c9t\u00e9 \u0130stanbul\u00a0x2 A" * 5), (501, "\u0000\u0001 1\u00002 [a] {B}"), (502, "q" * 5000), (503, "Z z Z " * 4000)]


@pytest.mark.parametrize(("n", "width", "percent"), [(1, 10_000, 10), (3, 70_000, 50)])
def test_resampling_against_plain_python(spark, docs, none, monkeypatch, n, width, percent):
    monkeypatch.setattr(importance, "FOLD", 1000)
    rows = [r[:2] for r in corpus_rows()] + ODD_TEXTS
    target = [BASE[3][:300], BASE[5], None, "", "w1 w2 W3"]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")).repartition(3)
    got = importance.resample(given, spark.createDataFrame([(t,) for t in target], "text string"), n, width, percent)
    assert Counter(tuple(r) for r in got.collect()) == brute_resampled(rows, target, n, width, percent, 20)
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(none, empty).count() == 0
    assert Counter(tuple(r) for r in importance.resample(given, empty).collect()) == brute_resampled(rows, [], 1, 10_000, 10, 20)


def test_resampling_of_the_table_against_plain_python(spark, small):
    rows = [tuple(r) for r in common.table(spark, small, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in common.table(spark, small, "benchmark").collect()]
    want = Counter((r[0], r[2], r[3], r[4], r[5]) for r in brute_resampled(rows, target, 1, 10_000, 10, 20).elements())
    assert Counter(tuple(r) for r in importance.query(spark, small).collect()) == want


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abZ9 _\u00e9-", max_size=60), st.integers(1, 4))
def test_ring_gives_the_crcs_of_runs(text, n):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", ascii_lower(text))
    want = [[zlib.crc32(" ".join(w[i - k + 1 : i + 1]).encode()) for k in range(1, min(n, i + 1) + 1)] for i in range(len(w))]
    assert list(importance.ring(ascii_lower(text).encode(), n)) == want


# --- 12 lexical search


def brute_search(docs, queries, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    tf = [(d, Counter(term.findall(ascii_lower(t or "")))) for d, t in docs if d is not None]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    total, df = sum(n for _, _, n in tf), Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c, n in tf:
            m = 50 + 50 * n * len(tf) // total
            found.append((-sum(math.floor(1000 * math.log((2 * len(tf) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(term.findall(ascii_lower(text or ""))) if c[t]), d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(x for x in found if x[0] < 0)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_against_plain_python(spark, docs, none, monkeypatch, k):
    monkeypatch.setattr(lexical, "SHARD", 3000)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    rows = [r[:2] for r in corpus_rows()] + ODD_TEXTS
    asked = [(1, BASE[2][:200]), (2, "w1 W1 \u00c9t\u00e9 nowhere"), (3, None), (4, "..."), (5, "unknown"), (6, BASE[5] + " " + BASE[6])]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(3)
    queries = spark.createDataFrame([*asked, (None, "w1")], "item_id long, text string")
    index = lexical.build(given)
    got = lexical.search(index, queries, k)
    assert Counter(tuple(r) for r in got.collect()) == brute_search(rows, asked, k)
    if k == 1:
        assert lexical.search(lexical.build(none), queries).count() == 0
        assert lexical.search(index, queries.limit(0)).count() == 0


def test_bounds_hold_and_rule_most_documents_out():
    own = np.random.default_rng(3)
    shard = lexical.Shard({f"t{k}": int(own.integers(0, 9000)) for k in range(30)})
    n = 2000
    m = lexical.lengths_weight(own.integers(1, 5000, n), n, 2_500_000)
    shard.add(None, np.arange(n).astype("<i8").tobytes(), b"", m.astype("<i8").tobytes())
    for t in shard.weights:
        places = np.flatnonzero(own.random(n) < 0.3)
        tf = own.geometric(0.3, len(places))
        shard.add(t, places.astype("<u4").tobytes(), (-(-lexical.impact(tf, m[places]) // lexical.STEP)).astype("<u1").tobytes(), tf.astype("<u4").tobytes())
    low, high = shard.bounds(list(shard.terms))
    exact = shard.exact(list(shard.terms), np.arange(n))
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.sort(low)[-50]).sum() < 100


# --- 13 fingerprints


def brute_fingerprint(text, n):
    w = [x for x in WORD.findall(ascii_lower(text or ""))]
    sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(prints, radius):
    """prints: (doc_id, fp) of documents with an identifier; the component of each fingerprint."""
    fps = sorted({f for _, f in prints})
    label = {f: f for f in fps}
    moved = True
    linked = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= radius]
    while moved:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = low
    least: dict = {}
    for d, f in prints:
        least[label[f]] = min(d, least.get(label[f], d))
    return {f: least[label[f]] for f in fps}


def test_fingerprints_against_plain_python(spark, docs, none, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 100)
    rows = [r[:2] for r in corpus_rows()] + ODD_TEXTS
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    prints = [(d, brute_fingerprint(t, 4)) for d, t in rows]
    of = brute_near([p for p in prints if p[0] is not None], 4)
    got = simhash.near_duplicates(given)
    assert Counter(tuple(r) for r in got.collect()) == Counter((d, f"{f:016x}", None if d is None else of[f]) for d, f in prints)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("kind", ["random", "clusters", "dense"])
def test_trees_find_all_links(spark, monkeypatch, kind):
    for name, value in (("SHARD", 40), ("PART", 25), ("GROUP", 8), ("PAIRS", 64)):
        monkeypatch.setattr(simhash, name, value)
    own = random.Random(8)
    if kind == "random":
        fps = {own.getrandbits(64) & 0xFFFF0000FFFF for _ in range(500)}
    else:
        centres, spread, each = ([own.getrandbits(64) for _ in range(30)], 6, 15) if kind == "clusters" else ([0, 2**64 - 1], 5, 150)
        fps = {c ^ sum(1 << own.randrange(64) for _ in range(own.randrange(spread))) % 2**64 for c in centres for _ in range(each)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp long").repartition(3)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(nodes, len(fps), 4).collect()]
    assert all(a != b for a, b in found) and len(found) <= 40 * len(fps)
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        before = dict(label)
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert label == brute_near([(f, f) for f in fps], 4)


# --- registered queries


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small), database(small), registry.ORACLES[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


# --- words that collide under sums of powers


def thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_of_one_structure_stay_apart(spark, n):
    word, other = thue_morse(n)
    tail = " ".join(f"t{k}" for k in range(30))
    texts = [word, other, f"{tail} {word}", f"{tail} {other}", f"xxxxxxxx{word}", f"xxxxxxxx{other}", f"{word}\n{other}\n{word}", (f"{word} b c d e f g h ") + (f"{other} b c d e f g h ")]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect()) == Counter(brute_classes(rows))
    own = tokens.UnitIds(tokens.default_vocabulary())
    ids = [own.encode.encode(t, add_special_tokens=False).ids + [tokens.END] for t in texts]
    assert [x.tolist() for _, x in tokens.encoded(pa.array(texts), tokens.default_vocabulary())] == ids
    crcs = {k: zlib.crc32(np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)}
    assert {r["doc_id"]: r["ids_crc32"] for r in sstable.documents(sstable.write(docs, common.new_folder(spark, "sstable"))).collect()} == crcs
    if max(map(len, ids)) <= 4096:
        assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs).collect()} == crcs
    x = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.score(docs, quality.Model({})).collect()}
    assert x[6] == (1, 0) and x[7] == (0, 0)
    assert Counter(tuple(r) for r in substrings.remove(docs).drop("kept").collect()) == brute_removed(rows, 50)


def test_units_whose_hashes_are_equal_stay_apart(monkeypatch):
    texts = [" ".join(f"unit{k}x{j}y" for j in range(50)) for k in range(4)]
    monkeypatch.setattr(tokens.K, "span_hashes", lambda buf, a, b: (b - a).astype(np.uint64) * np.uint64(2))
    own = tokens.UnitIds(tokens.default_vocabulary())
    for _ in range(2):
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            assert own.texts(raw, np.array([0, len(raw)]))[0].tolist() == own.encode.encode(t, add_special_tokens=False).ids + [tokens.END]
    spans = np.frombuffer(b"abc abd abc", np.uint8)
    assert tokens.K.span_classes(spans, np.array([0, 4, 8]), np.array([3, 7, 11])).tolist() == [0, 1, 0]
