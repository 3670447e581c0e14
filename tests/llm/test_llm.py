"""Edge cases and brute-force versions of the operators on small fixtures."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarbor.llm import ann_graph, byte_bpe, chat_format, html_extract, language_id, license_scan, line_dedup, mixing, ngram_join, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_lines long, size long, key string"


@pytest.fixture(scope="session")
def docs(spark):
    line = "This is a long line that is the same in a number of documents, as it were."
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line}\nown {i}", "en", "a", 1, 2, "k") for i in range(6)]
    rows += [(10, base, "en", "b", 1, 2, "k"), (11, base.upper(), "de", "b", 1, 2, "k"), (12, base + " more", None, None, None, None, None), (13, None, None, None, None, None, None), (14, "", "en", "", 1, 1, "k"), (None, base, "en", "a", 1, 1, "k"), (10, base, "en", "b", 1, 2, "k"), (15, "x " * 50_000, "en", "c", 1, 1, "k"), (16, "a b c ퟿ <|endoftext|>", "fr", "c", 1, 1, "k")]
    return spark.createDataFrame(rows, DOCS).cache()


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.where("doc_id < 10 OR doc_id IN (13, 14)")).collect()}
    assert rows[0]["text"] == "own 0" and rows[5]["text"].startswith("This is") and rows[13]["text"] is None
    assert (rows[0]["_n_lines"], rows[0]["n_dropped"], rows[14]["_n_lines"]) == (2, 1, 1)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_ngram_join_against_brute_force(docs):
    rows = docs.collect()
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.jaccard_components(docs, chunk_sets=3, block_shingles=100).collect()}
    assert len({k for k in found}) <= len(rows)
    assert found[11, 56] == 10 and found[12, 57] == 10 and found[13, 0] == 13 and found[14, 0] == 14 and found[None, 56] is None
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_ngram_join_of_families_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    shared, texts = [f"s{k}" for k in range(40)], []
    for family in range(6):
        base = shared[: 8 * family] + [f"f{family}_{k}" for k in range(80)]
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = f"r{rng.integers(10**9)}"
            texts.append(" ".join(words[: rng.integers(60, len(words) + 1)]))
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert 6 <= len(set(least)) < len(texts)
    found = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk_sets=4, block_shingles=500).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(own[i]), x) for i, x in enumerate(least)}


def test_byte_bpe_round_trip(docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = sorted((r["doc_id"] or -1, hashlib.sha256(np.array(own.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    got = sorted((r["doc_id"] or -1, r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs).collect())
    assert got == want


def test_language_id(spark):
    words = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{words[lang]} {i}", lang) for i in range(60) for lang in words] + [(900, None, None), (901, "123 !!", "en")]
    frame = spark.createDataFrame([(3 * i + k, *r[1:]) for k in range(1) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    out = language_id.predict(frame, language_id.train(frame)).collect()
    assert all(r["lang_pred"] == (r["lang"] if r["text"] and "1" != r["text"][0] else "und") and 0 <= r["score"] <= 1 for r in out)
    empty = language_id.train(frame.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(frame, empty).collect()} == {"und"}


PROSE = " ".join(f"word{i}" for i in range(30))


def test_html():
    page = "<nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one<br>two <b>three</b></article><script>var x = '<p>no</p>'</script><div class='comments'><p>said someone with many words here</p></div>"
    assert html_extract.main_text(page) == "A & B one two three"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == html_extract.main_text("<!-- a") == ""


@pytest.mark.parametrize("page", [
    f'<div class="content has-sidebar"><p>{PROSE}</p></div>', f'<div class="no-sidebar"><article>{PROSE}</article></div>', f'<div class="post-content social-enabled"><p>{PROSE}</p></div>',
    f'<article><div class="legal text">{PROSE}</div></article>', f"<article data-u=http://x/><p>{PROSE}</p></article>", f'<article><p title="5" tall">{PROSE}</p></article>', f'<article><p title="the hidden gem">{PROSE}</p></article>',
    f'<article><p><span class="ad">buy</span> {PROSE} <b style="display: none">x <b>y</b></b></p></article>', f"<html><head><title>t</title><body><article><!--><p>{PROSE}</article>", f"<article></section></i><div/><p>{PROSE}</article>",
    f'<body class="home sidebar"><div id=wrap><div id=content><p>{PROSE}</p></div></div>', f"<article><p>{PROSE}</p><aside>x</aside><form>y</form><div class=newsletter>z</div></article><div role=complementary><p>{PROSE}</p></div>",
    f"<article><style>p</p>{{}}</style><svg><path d=1 /><text>no</text></svg><p>{PROSE}</p><textarea></p>no</textarea></article>", f"<a href=/>home</a><p>{PROSE}</p><a href=x>imprint</a>",
])
def test_html_of_odd_pages(page):
    assert html_extract.main_text(page) == PROSE


def test_html_learns_from_words_and_links_where_nothing_is_named():
    links, more = "<div><a href=x>one</a> <a href=x>two words</a></div>", " ".join(["again"] * 40)
    assert html_extract.main_text(f"{links}<h1>The title</h1><p>{PROSE}</p><p>Tiny one.</p><p>{more}</p>{links}") == f"The title {PROSE} Tiny one. {more}"
    tree = html_extract.content_tree()
    row = html_extract.features(html_extract.blocks(f"<div>{PROSE}</div><div><a href=x>{PROSE}</a></div>"))
    assert tree.says(row[0]) and not tree.says(row[1])
    rows, labels = html_extract.labelled_table()
    assert np.mean([tree.says(r) == x for r, x in zip(rows.tolist(), labels, strict=True)]) > 0.98


def test_html_keeps_every_block_of_an_article_at_any_length():
    for n in (1, 3, 10, 40, 200):
        for m in (1, 4, 18, 90):
            a, b = " ".join(["a"] * n), " ".join(["b"] * m)
            for inside in (f"<p>{a}</p><ul><li>{b}</li></ul>", f"<div>{a}</div><div>{b}</div>", f"<p><a href=x>{a}</a></p><p><a href=x>{b}</a></p>", f"<table><tr><td>{a}<td>{b}</table>"):
                for page in (f"<article>{inside}</article>", f"<nav><a href=x>x</a></nav><div class=ad>x x</div><main>{inside}</main><footer>x x x</footer>"):
                    assert html_extract.main_text(page) == f"{a} {b}"


def test_html_of_deep_and_long_pages():
    assert html_extract.main_text("<article>" + "<div>a" * 20_000 + "<p>" * 20_000 + "</b>" * 20_000).split() == ["a"] * 20_000
    assert len(html_extract.main_text(f"<article>{'<p title=' * 20_000}>{PROSE * 10_000}")) == len(PROSE) * 10_000


def test_html_table(spark):
    page = f"<article><p>{PROSE}</p></article>"
    frame = spark.createDataFrame([(1, "u", page, "t", 5), (1, "u", page, "t", 5), (2, None, None, None, None), (None, "v", "", "x", 1), (3, "w", "\u00e9&eacute;&#x1F600;", "x", 1)], "page_id long, url string, html string, text string, n_chars long")
    rows = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_extract.extract(frame).collect()))
    assert rows == [(0, "v", "", 0), (1, "u", PROSE, len(PROSE)), (1, "u", PROSE, len(PROSE)), (2, "", "", 0), (3, "w", "\u00e9\u00e9\U0001f600", 3)]
    empty = html_extract.extract(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_html_finds_planted_articles(spark):
    """Pages made of shuffled surroundings and an article; what comes out is the article as it was planted."""
    rng, pages = np.random.default_rng(4), []
    words = lambda n: " ".join(f"w{rng.integers(1000)}" for _ in range(n))
    around = [lambda: f"<nav><ul><li><a href=x>{words(2)}</a></li></ul></nav>", lambda: f"<div class='ad-slot'>{words(12)}</div>", lambda: f"<footer>{words(15)}</footer>", lambda: f"<aside><p>{words(40)}</p></aside>", lambda: f"<section class=comments><p>{words(60)}</p></section>", lambda: f"<form><p>{words(9)}</p></form>", lambda: f"<div id=cookie-banner>{words(20)}</div>", lambda: f"<script>{words(9)}</script>", lambda: f"<!-- {words(5)} -->"]
    for i in range(200):
        parts = [words(n) for n in rng.integers(1, 60, rng.integers(1, 7))]
        inner = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<h2>{}</h2>"]).replace("{}", x) for x in parts)
        before, after = ("".join(around[k]() for k in rng.permutation(len(around))[:4]) for _ in range(2))
        outer = rng.choice(["<article>{}</article>", "<main class=no-sidebar>{}</main>", "<div class=post-content>{}</div>", "<div class='has-sidebar'><article>{}</article></div>"])
        pages.append((i, f"<body>{before}{outer.replace('{}', inner)}{after}</body>", " ".join(parts)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([(i, "u", h) for i, h, _ in pages], "page_id long, url string, html string")).collect()}
    assert [i for i, _, want in pages if got[i] != want] == []


def test_quality():
    assert quality_rules.repeated_words(b"a b c x a b c".split()) == 6
    assert quality_rules.base_counts("a #b\na #b\n\n") == (4, 6, 2, 1, 0)
    assert quality_rules.base_counts("") == (0, 0, 0, 0, 0)


def test_noise_is_out_of_band():
    import zstandard

    pack, rng = zstandard.ZstdCompressor(level=3).compress, np.random.default_rng(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n // 4, p=(w := 1 / np.arange(1, 401)) / w.sum()))[:n].encode()
    noise = lambda n, of: " ".join("".join(rng.choice(list(of), 6)) for _ in range(n // 6))[:n].encode()
    base64, verdict = letters + letters.upper() + "0123456789+/", lambda data: quality_rules.compression_verdict(data, pack)[0]
    assert all(verdict(prose(n)) for n in (300, 700, 1500, 5000, 20_000, 100_000))
    assert not any(verdict(noise(n, base64)) for n in (300, 500, 700, 1500, 5000, 20_000, 200_000))
    assert not any(verdict(noise(n, letters)) for n in (20_000, 200_000)) and not verdict(noise(200_000, "0123456789abcdef"))
    assert not verdict(prose(12_000) + noise(12_000, letters + "0123456789"))
    assert not verdict(prose(24_000) + b"buy this now " * 1280)
    assert not verdict(prose(4096) + noise(1500, base64))


def test_licenses(spark):
    text = "Hello. Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    rows = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [["MIT", "Apache-2.0"], [], []]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """{} is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

{} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2{0} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3{0} Neither the name of {1} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_licenses_as_published(spark):
    gpl, bsd = GPL.format("This program", "This program"), ["BSD-3-Clause"]
    cases = [(MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (gpl, ["GPL-3.0-or-later"]), (GPL.format("Foo", "Foo"), ["GPL-3.0-or-later"]), (BSD.format(".", "the copyright holder"), bsd), (BSD.format(")", "Some Company Inc."), bsd)]
    cases += [("".join(f"{mark} {line}\n" for line in text.split("\n")), want) for text, want in cases[:5] for mark in ("#", "//", " *", ";;", "dnl")]
    cases += [(gpl.replace("\n", " "), ["GPL-3.0-or-later"]), ("Released under the MIT License\nSee the file", ["MIT"]), ("Never released under the MIT License.", []), ("Released under the MIT License of old", []), ("Licensed under CC BY-NC 4.0\r\nand so on", ["CC-BY-NC-4.0"])]
    cases += [(BSD.format(".", "x").rpartition("3.")[0], ["BSD-2-Clause"]), (GPL.format("Foo bar", "Foo bar").replace("version 3", "version 2"), ["GPL-2.0-or-later"])]
    cases += [(GPL.format(x, x).replace("GNU", f"GNU {kind}").replace("version 3", f"version {v}"), [f"{name}-{v}{'.0' * (v != '2.1')}-or-later"]) for x, kind, v, name in (("This library", "Lesser", "2.1", "LGPL"), ("This library", "Lesser", "3", "LGPL"), ("This program", "Affero", "3", "AGPL"))]
    cases += [(MPL, ["MPL-2.0"]), (MPL.replace("\n", " "), ["MPL-2.0"]), (ISC, ["ISC"]), (ZLIB, ["Zlib"]), ("This is free and unencumbered software released into the public domain.\n\nAnyone", ["Unlicense"]), ("//          Copyright Joe 2015\n// Distributed under the Boost Software License, Version 1.0.\n//    (See", ["BSL-1.0"]), ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n", ["EPL-2.0"]), ("To the extent possible under law, Jane Roe has waived all copyright and related or\nneighboring rights to this work.", ["CC0-1.0"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"])]
    cases += [(MIT.replace("free of charge", "at a charge"), []), (APACHE.replace("2.0", "1.1"), []), (GPL.format("This", "This").replace("any later", "no later"), []), (BSD.format(".", "x").replace("binary form must", "binary form may"), []), ("\n\n".join(reversed(MIT.split("\n\n"))), []), (MIT + "\n\n" + APACHE, ["MIT", "Apache-2.0"])]
    cases += [("字" * 100_000 + ". . " * 50_000 + "- \n" * 50_000 + MIT + "!?" * 50_000 + " x" * 100_000, ["MIT"])]
    rows = license_scan.scan_licenses(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [want for _, want in cases]


def test_licenses_of_an_empty_table_repeated_rows_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, MIT, "x"), (1, MIT, "x"), (None, MIT, None)], "doc_id long, text string, licenses string")
    out = license_scan.scan_licenses(frame)
    assert out.columns == ["doc_id", "sentence_ids", "licenses"] and [r["licenses"] for r in out.collect()] == [["MIT"]] * 3
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_own_license_sentences(spark):
    frame = spark.createDataFrame([(1, "Free\nfor all."), (2, "free for some")], "doc_id long, text string")
    rows = license_scan.scan_licenses(frame, sentences={"own": "free for all"}, rules=(("Own", ("own",)),)).orderBy("doc_id").collect()
    assert [(r["sentence_ids"], r["licenses"]) for r in rows] == [([1], ["Own"]), ([], [])]


def test_chat_trees(spark):
    nodes = spark.createDataFrame([(1, "a", None, "user", "q\\<|x", 0.0), (1, "b", "a", "assistant", "good", 2.0), (1, "c", "a", "assistant", "bad", None)], "tree int, node string, parent string, role string, text string, score double")
    out = chat_format.format_conversations(nodes, best=None).withColumn("turns", chat_format.parse_conversation(F.col("formatted"))).orderBy("branch").collect()
    assert [[tuple(t) for t in r["turns"]] for r in out] == [[("user", "q\\<|x"), ("assistant", "good")], [("user", "q\\<|x"), ("assistant", "bad")]]


def test_nearest_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8)]
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    out = ann_graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    for q in got:
        want = sorted((i for i in good if i != q), key=lambda i: (-round(float(good[q] @ good[i]), 12), i))[:5]
        assert got[q] == want


def test_nearest_in_a_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    near = rng.standard_normal(32) + 0.001 * rng.standard_normal((600, 32))
    ties = np.sign(rng.standard_normal((100, 32))) @ np.diag([1.0] * 8 + [0.0] * 24)
    vectors = np.concatenate([near, 3 * near[:50], rng.standard_normal((1000, 32)), ties])[rng.permutation(1750)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_graph.nearest(frame, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1750, 20):
        sims = np.round(unit @ unit[q], 13)
        sims[q] = -2
        hits += len(got[q] & set(np.lexsort((np.arange(1750), -sims))[:5].tolist()))
    assert hits >= 0.98 * 5 * len(range(0, 1750, 20))


def nearest_by_hand(vectors, query, top=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit[query], 13)
    sims[query] = -2
    return np.lexsort((np.arange(len(vectors)), -sims))[: min(top, len(vectors) - 1)].tolist()


@pytest.mark.parametrize("partitions", ["1", "16", "200"])
def test_nearest_of_small_tables_is_whole_and_exact(spark, partitions):
    rng, was = np.random.default_rng(5), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in (0, 1, 5, 13, 200) if partitions == "16" else (13,):
            vectors = rng.standard_normal((n, 8))
            frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
            rows = ann_graph.nearest(frame, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()
            got = {q: [(r["rank"], r["vec_id"]) for r in rows if r["query_id"] == q] for q in range(0, n, 50)}
            assert got == {q: list(enumerate(nearest_by_hand(vectors, q), 1)) for q in range(0, n, 50)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_nearest_over_many_blocks_and_parts_without_links(spark):
    """4,000 rows in 60 blocks, in 40 far clusters of 4 rows (fewer than answers) and one of the rest: the graph falls apart."""
    rng = np.random.default_rng(6)
    far = np.repeat(rng.standard_normal((40, 24)) * 10, 4, 0) + 0.01 * rng.standard_normal((160, 24))
    vectors = np.concatenate([far, rng.standard_normal((3840, 24))])[rng.permutation(4000)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann_graph.nearest(frame, lambda i: i % 50 == 0, block=64, neighbours=8, starts=2).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(x) == 5 for x in got.values()) and len(got) == 80
    assert sum(len(set(x) & set(nearest_by_hand(vectors, q))) for q, x in got.items()) >= 0.95 * 5 * len(got)


def test_nearest_with_repeated_ids_hubs_and_clashing_columns(spark):
    """Rows around one row, a hub of the graph; an id that comes twice and a null id."""
    rng = np.random.default_rng(8)
    around = rng.standard_normal((600, 16))
    vectors = np.concatenate([np.ones((1, 16)), np.ones((600, 16)) + 0.5 * around])
    rows = [(i, v.tolist(), i, 0.0) for i, v in enumerate(vectors)] + [(3, vectors[3].tolist(), 3, 0.0), (None, vectors[4].tolist(), 4, 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, score double")
    got = {}
    for r in ann_graph.nearest(frame, lambda i: i % 100 == 0, block=50).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(x) & set(nearest_by_hand(vectors, q))) for q, x in got.items()) >= 0.95 * 35


def test_offers_are_merged_inside_the_task():
    offers = ann_graph.Offers(2, most=6)
    out = list(offers.add(np.array([1, 1, 1]), np.array([5, 6, 7]), np.array([0.5, 0.9, 0.9]))) + list(offers.add(np.array([1, 2, 1]), np.array([6, 1, 8]), np.array([0.9, 0.1, 1.0]))) + list(offers.close())
    assert [b.to_pylist() for b in out] == [[{"node": 1, "others": [8, 6], "sims": [1.0, 0.9]}, {"node": 2, "others": [1], "sims": [0.1]}]]


def mixed_by_hand(rows, weights=(1, 2, 3), most=3):
    """(taken words, target) by source for rows (source, words), by a plain loop over the resharing."""
    sizes = {}
    for source, n in rows:
        sizes[source] = sizes.get(source, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets, free, left = {}, list(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = most * sizes[s]
            left -= targets[s]
            free.remove(s)
    return sizes, targets


@pytest.mark.parametrize("name", ["shared id", "alike", "reshared", "huge", "empty"])
def test_mixing_meets_the_targets_by_hand(spark, name):
    words = lambda n: " ".join(["w"] * n)
    rows = {
        "shared id": [(None, words(1 + i % 9), "a" if i < 60 else "b") for i in range(90)],
        "alike": [(7, words(5), "a")] * 60 + [(7, words(5), "b")] * 31 + [(8, words(3), None)] * 40,
        "reshared": [(i, words(4), "a" if i < 200 else "b" if i < 203 else "c" if i < 208 else None) for i in range(212)],
        "huge": [(1, words(5000), "a")] + [(i, words(2), "b") for i in range(2, 400)],
        "empty": [(1, None, "a"), (2, "", "a"), (3, " \n", None)],
    }[name]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, key long, size long")
    out = mixing.mix_sources(frame).collect()
    sizes, targets = mixed_by_hand([(s, len((t or "").split())) for _, t, s in rows])
    assert len(out) == len(rows) and all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in out)
    most = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for source in sizes:
        own = [r for r in out if r["source"] == source]
        assert all(abs(r["target"] - targets[source]) < 1e-6 and r["source_size"] == sizes[source] for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[source]) <= most[source] / 2 + 1e-6
    again = mixing.mix_sources(frame.repartition(3)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(out, key=key) == sorted(again, key=key)
    taken = mixing.mixed_documents(frame).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    for r in taken:
        assert abs(r["n"] - targets[r["source"]]) <= most[r["source"]] / 2 + 1e-6
    assert {r["source"] for r in taken} == {s for s in sizes if targets[s] >= most[s] / 2 and targets[s] > 0}


def test_language_id_of_long_repeated_and_clashing_rows(spark):
    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    rows = [(2 * i + k, f"{words[lang]} {i}", lang, "x", 7.0) for i in range(40) for k, lang in enumerate(words)]
    rows += [(500, f"{words['de']} " * 40_000, "en", "y", 1.0)] * 2 + [(501, "", None, None, None), (None, words["en"], None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language_id.predict(frame, language_id.train(frame))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert got[500] == "de" and got[501] == "und" and got[None] == "en"
    odd = language_id.predict(frame.withColumnRenamed("text", "score_").drop("score"), language_id.train(frame), text_col="score_", lang_as="score_", score_as="s")
    assert odd.columns == ["doc_id", "lang", "lang_pred", "score_", "s"] and odd.where("score_ = 'de'").count() == 42


def test_language_scores_equal_the_dense_product():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefg "), 200)) for _ in range(20)]
    model = language_id.fit(texts, ["x", "y"] * 10, landmarks_per_lang=5)
    own = [language_id.grams(t) for t in texts]
    present = np.array([np.isin(model.vocabulary, g) for g in own], float)
    assert np.allclose(model.scores(own), present @ model.weights / np.sqrt([[len(g)] for g in own]), atol=1e-5)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(["a"] * 300, [str(i) for i in range(300)])


def test_chat_of_odd_trees(spark):
    """A wide tree, a cycle, an absent parent, nulls and line breaks in roles; and an empty table."""
    rows = [(1, "r", None, "user", "q", 0.0)] + [(1, f"l{i}", "r", "assistant", f"a{i}", float(i % 7)) for i in range(50)]
    rows += [(2, "x", "y", "user", "lost", 9.0), (2, "y", "x", "user", "lost", 9.0), (3, "o", "gone", "us\ner<|", "\\<|im_end|>", None), (4, "n", None, None, None, None)]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    nodes = nodes.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("leaf", F.lit(1)).withColumn("branch", F.lit(1))
    out = {r["tree"]: r for r in chat_format.format_conversations(nodes).withColumn("turns", chat_format.parse_conversation(F.col("formatted"))).collect()}
    assert set(out) == {1, 3, 4}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "q"), ("assistant", "a13")] and [tuple(t) for t in out[3]["turns"]] == [("us\ner<|", "\\<|im_end|>")] and [tuple(t) for t in out[4]["turns"]] == [("", "")]
    assert chat_format.format_conversations(nodes, best=None).where("tree = 1").count() == 50
    assert chat_format.format_conversations(nodes.limit(0)).count() == 0


def test_chat_round_trip_by_hand(spark):
    rng, said = np.random.default_rng(3), ["", "a", "<|im_end|>\n<|im_start|>assistant\n", "\\", "\\\\<|", "<\\|", "<\\n|", "\n"]
    rows = [(c, int(rng.integers(0, 3)), str(rng.choice(["user", "assistant", "to\nol"])), "".join(rng.choice(said, 3))) for c in range(12) for _ in range(int(rng.integers(1, 9)))]
    rows += [(20, None, None, None), (20, 1, "assistant", None), (20, 1, "assistant", None), (None, 0, "user", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(chat_format.thread_nodes(frame)).withColumn("turns", chat_format.parse_conversation(F.col("formatted"))).collect()
    for r in out:
        want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["tree"]))
        assert [tuple(t) for t in r["turns"]] == [x[2:] for x in want]
        assert "".join(p["piece"] for p in r["pieces"]) == r["formatted"] and [p["loss"] for p in r["pieces"]][1::3] == [x[2] == "assistant" for x in want]
    assert len(out) == len({r[0] for r in rows})


def test_byte_bpe_over_block_ends_long_texts_and_an_empty_table(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(0, 40))) for _ in range(60)] + ["", None, "long é字 text\n" * 100_000, "x" * 3000, "　 \t\r\n\n  a"]
    frame = spark.createDataFrame([(i // 2, t, "ids", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    encoded = byte_bpe.bpe_encode(frame, path, public_tokenizers.PATTERN, block_chars=100)
    want = sorted((i // 2, own.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect()) == want
    decoded = byte_bpe.bpe_decode(encoded, path).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in decoded) == sorted((i // 2, t or "") for i, t in enumerate(texts))
    assert byte_bpe.round_trip(frame.limit(0)).count() == 0 and byte_bpe.round_trip(frame).count() == len(texts)


def components_by_hand(texts, percent=75):
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return {i: (len(s), x) for i, (s, x) in enumerate(zip(own, least, strict=True))}


@pytest.mark.parametrize("visitors", [2, 4096])
def test_ngram_join_with_hot_shingles_equals_brute_force(spark, monkeypatch, visitors):
    """A third of all texts have the same passage, others are copies and near copies of one; few visitors a row."""
    monkeypatch.setattr(ngram_join, "VISITORS", visitors)
    rng, passage = np.random.default_rng(11), [f"hot{k}" for k in range(30)]
    texts = [" ".join([*passage, *(f"u{i}_{k}" for k in range(rng.integers(5, 30)))]) for i in range(80)]
    base = [f"b{k}" for k in range(70)]
    for _ in range(60):
        words = list(base)
        for at in rng.integers(0, 70, rng.integers(0, 3)):
            words[at] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 40 + [" ".join(passage)] * 30 + [None, "", " \n", "one two", "ONE two", "x " * 3000, "a b c d"]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    frame = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles long, component_id string")
    found = ngram_join.jaccard_components(frame, chunk_sets=4, block_shingles=700)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == components_by_hand(texts)


def test_quality_table_equals_plain_loops(spark):
    import re

    import zstandard

    rng, word = np.random.default_rng(9), re.compile(r"[^\x20\x09-\x0D]+")
    texts = ["\n".join(" ".join(f"w{rng.integers(40)}{rng.choice(list('#*$a'))}" for _ in range(rng.integers(0, 12))) for _ in range(rng.integers(1, 40))) for _ in range(40)] + [None, "", " \t\n", "a b c " * 400, "é字　x y " * 60]
    frame = spark.createDataFrame([(i // 2, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, kept string")
    pack, want = zstandard.ZstdCompressor(level=3).compress, []
    for i, t in enumerate(texts):
        words, lines = word.findall(t or ""), [x for x in (t or "").split("\n") if word.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and quality_rules.compression_verdict((t or "").encode(), pack)[0]
        want.append((i // 2, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed, kept))
    out = quality_rules.quality_scores(frame)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(want)
    assert quality_rules.quality_scores(frame.limit(0)).count() == 0


def test_line_dedup_of_ties_null_ids_and_repeated_ids(spark):
    line = "a line of more than forty characters that many documents of this table share"
    rows = [(i, f"{line}\nown", "c", 1) for i in range(4)] + [(4, f"  {line.upper()}\t\n{line}", "c", 1)] * 2 + [(None, line, "c", 1)] * 3
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_dropped string, __x int")).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["_n_dropped"]) for r in out)
    assert got == sorted([(i, "own", 1) for i in range(4)] + [(4, rows[4][1], 0)] * 2 + [(-1, "", 1)] * 3)
