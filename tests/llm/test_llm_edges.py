"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import base64
import hashlib
import math
import re
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldcast.llm import exact_dedup, licenses, mixing, near_dedup, packing, quality, sharding, token_files, tokens, topk, warc
from foldcast.llm.bytespans import mix, span_hashes
from foldcast.llm.common import scratch
from foldcast.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(9000))
ODD = [
    (1, "One two three four five six.", "en", "a", 28),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "", "", 4),
    (None, "no id here at all", "de", "b", 17),
    (None, None, None, None, None),
    (5, "One two three four five six.", "en", "a", 28),
    (5, "One two three four five six.", "en", "a", 28),
    (6, "One  two\tthree four five\nsix.", "en", "b", 29),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Ω λόγος 日本語 <|endoftext|> é it's ²³\x1c!", "el", "c", 40),
    (9, "ÀÉ ñ x DON'T", "fr", "c", 12),
]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, DOCS)
    names = "slot h size row page depth bucket src label id band cell sha256 keep_id".split()
    return frame.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def key(v):
    return (v is not None, v)


def library_ids(text, end):
    return [*tokens.encoder(tokens.default_path()).whole.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# --- token ids ---------------------------------------------------------------

def test_words_give_the_ids_of_whole_texts():
    import pyarrow as pa

    texts = [t for _, t, *_ in ODD] + ["a<|endoftext|>b", "<|ENDOFTEXT|>", "Σας ΟΔΟΣ", "we'll 's' 't", "x\x85y", "ÿ×÷ ßẞ", "!'s ''s 12ab"]
    encoder = tokens.WordEncoder(tokens.default_path())
    ids, at = encoder.encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library_ids(t, 2) for t in texts]
    encoder.forget()
    again, _ = encoder.encode(pa.array(texts), 2)
    assert again.tolist() == ids.tolist()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, encoding):
    out = scratch(spark, "tokens")
    token_files.write_tokens(odd, out, encoding=encoding)
    got = rows(token_files.read_tokens(spark, out).join(token_files.starts(token_files.read_tokens(spark, out)), "shard"))
    got.sort(key=lambda r: r["before"] + r["start_in_shard"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(library_ids(t, 2))) for d, t, *_ in ODD)
    assert [key(r["doc_id"]) for r in got] == sorted((key(d) for d, *_ in ODD))
    place = 0
    for r in got:
        assert (r["before"] + r["start_in_shard"], r["n_tokens"]) == (place, len(r["ids"]))
        place += len(r["ids"])


def test_token_files_of_nothing(spark, none):
    out = scratch(spark, "tokens")
    token_files.write_tokens(none, out)
    assert token_files.with_crc32(token_files.read_tokens(spark, out)).collect() == []


def test_token_files_hold_pages_and_row_groups(spark, folder):
    from glob import glob

    import pyarrow.parquet as pq

    out = scratch(spark, "tokens")
    token_files.write_tokens(spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet"), out)
    files = [pq.ParquetFile(f) for f in glob(f"{out.removeprefix('file:')}/*.parquet")]
    columns = [f.metadata.row_group(0).column(c) for f in files for c in range(5) if f.metadata.num_rows]
    assert all(c.has_offset_index for c in columns)
    assert any("DICTIONARY" in str(c.encodings) for c in columns if c.path_in_schema.startswith("ids"))


# --- packing -----------------------------------------------------------------

def check_pieces(pieces, docs, window, end):
    want = [(d, library_ids(t, end)) for d, t, *_ in docs]
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for members in by_window.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or at & (at - 1) == 0 and at < window
    for d in {d for d, _ in want}:
        ids = sorted(tuple(x) for e, x in want if e == d)
        if len(ids) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[0])
                assert np.frombuffer(r["ids"], "<u4").tolist() == list(ids[0][at : at + r["length"]])
                at += r["length"]
            assert at == len(ids[0])
        else:
            assert sum(r["length"] for r in by_doc[d]) == sum(map(len, ids))


@pytest.mark.parametrize("window,block", [(2048, 4_000_000), (16, 40)])
def test_packing(odd, none, window, block):
    check_pieces(rows(packing.pack(odd, window=window, block_tokens=block)), ODD, window, 1)
    assert packing.pack(none).collect() == []


def test_tightest_window_is_found():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 65, 200)
        got = packing.best_fit(lengths, 64)
        windows, room = [], []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(r, -w) for w, r in enumerate(room) if r >= lengths[k]]
            if not fits:
                windows.append([k])
                room.append(64 - lengths[k])
                continue
            best = min(r for r, _ in fits)
            assert best in [64 - sum(lengths[i] for i in w[: w.index(k)]) for w in got if k in w]
            w = next(w for w, items in enumerate(windows) if room[w] == best)
            windows[w].append(k)
            room[w] -= lengths[k]
        assert sorted(map(sum, ([lengths[i] for i in w] for w in got))) == sorted(sum(lengths[i] for i in w) for w in windows)


def test_plan_covers_all_and_pads_nothing():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, 300, n)
        for close in (True, False):
            windows = packing.plan(lengths, 64, close)
            covered = sorted((d, s, m) for w in windows for d, s, m in w)
            for d in range(n):
                at = 0
                for _, s, m in (p for p in covered if p[0] == d):
                    assert s == at
                    at += m
                assert at == lengths[d]
            fills = [sum(m for _, _, m in w) for w in windows]
            assert all(0 < f <= 64 for f in fills) and (not close or all(f & (f - 1) == 0 for f in fills))


# --- exact copies ------------------------------------------------------------

def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies(docs):
    groups = defaultdict(list)
    for d, t, *_ in docs:
        groups[spaced(t)].append(d)
    out = []
    for d, t, *_ in docs:
        g = groups[spaced(t)]
        keep = min((x for x in g if x is not None), default=None)
        if len(g) == 1:
            keep = d
        out.append((d, keep, len(g), d == keep, hashlib.sha256(spaced(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width", [1, 16])
def test_exact_copies(odd, none, width):
    got = exact_dedup.mark_copies(odd, width)
    assert Counter(map(tuple, got.collect())) == copies(ODD)
    assert exact_dedup.mark_copies(none).collect() == []


def test_narrow_identifiers_are_widened(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(600)], "doc_id long, text string")
    assert exact_dedup.collisions(docs, 1) and not exact_dedup.collisions(docs, 16)
    assert exact_dedup.mark_copies(docs, 1).where("kept").count() == 600


def test_chunks_depend_on_content_only():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    body = "".join(chr(97 + c) for c in rng.integers(0, 20, 60_000))
    parts = [{bytes(c) for c in chunks} for _, _, chunks in exact_dedup.chunked(pa.array([body, "some words before " + body, ""]))]
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0]) > 4
    assert all(b"".join(chunks) == text and all(len(c) <= exact_dedup.MOST for c in chunks) for _, text, chunks in exact_dedup.chunked(pa.array([body, "a  b", "x" * 99_999])))


def test_copies_are_dropped_with_all_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_, k, _ in copies(ODD) if k)
    twice = exact_dedup.drop_copies(odd.union(odd))
    assert Counter(r.doc_id for r in twice.collect()) == Counter(r.doc_id for r in kept.collect())


# --- near copies -------------------------------------------------------------

def near(docs, words, percent):
    sets = []
    for d, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = Counter()
    for k, (d, *_) in enumerate(docs):
        c = min((docs[j][0] for j in range(len(docs)) if group[j] == group[k] and docs[j][0] is not None), default=None) if sets[k] else d
        out[(d, len(sets[k]), c, d == c)] += 1
    return out


def test_near_copies_of_odd_rows(odd, none):
    got = near_dedup.near_groups(odd, near_dedup.CONTRACT)
    assert Counter(map(tuple, got.collect())) == near(ODD, 3, 85)
    assert near_dedup.near_groups(none).collect() == []


def test_different_texts_under_one_id_are_rows_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near_b, near_c = b + " more", c + " more"
    rows = [(5, a), (5, b), (1, near_b), (None, c), (7, near_c), (None, a + " end"), (None, "x y z q w e"), (None, "x y z q w e"), (9, "")]
    for docs in (rows, (rows + rows)[::-1]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert Counter(map(tuple, near_dedup.near_groups(df).collect())) == near(docs, 5, 80)
        stays = [tuple(r) for r in near_dedup.drop_near(df.withColumn("k1", F.lit("own"))).collect()]
        empty = [(9, "", "own")] * docs.count((9, ""))
        assert Counter(stays) == Counter([(1, near_b, "own"), (5, a, "own"), (7, near_c, "own"), (None, "x y z q w e", "own"), *empty])


@pytest.mark.parametrize("settings", [near_dedup.Settings(), near_dedup.CONTRACT])
def test_chains_and_hubs_of_near_copies(spark, monkeypatch, settings):
    monkeypatch.setattr(near_dedup, "CELL", 8)  # many small cells
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    docs, at = [], 0
    for k in range(60):  # a chain that drifts away from its start
        docs.append((1000 - k, " ".join(base)))
        base[at % 120] = f"new{k}"
        at += 1
    hub = [f"v{k}" for k in rng.integers(0, 5000, 200)]
    for k in range(60):  # copies of one text, each with an edit of its own
        copy = list(hub)
        copy[rng.integers(0, 200)] = f"edit{k}"
        docs.append((2000 + int(rng.integers(0, 10**6)), " ".join(copy)))
    for k in range(40):
        docs.append((10**7 + k, " ".join(f"u{x}" for x in rng.integers(0, 9, 5))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.near_groups(df, settings).collect())) == near(docs, settings.words, settings.percent)


def test_bit_counts_estimate_similarity():
    s = near_dedup.CONTRACT
    rng = np.random.default_rng(7)
    factor, shift = near_dedup.permutations(s.hashes)
    errors = []
    for share in (0.3, 0.6, 0.85, 1.0):
        pool = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
        cut = int(1000 * (1 - share) / (1 + share))
        a, b = pool[:1000], pool[cut : 1000 + cut]
        bits = [np.frombuffer(near_dedup.packed_bits(near_dedup.minima(x, factor, shift), s), np.uint8) for x in (a, b)]
        errors.append(abs(s.similarity(near_dedup.equal_places(*bits, s)) - (1000 - cut) / (1000 + cut)))
    assert max(errors) < 0.15 and errors[-1] == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- sharding ----------------------------------------------------------------

def test_sharding_limits_and_pages(spark):
    docs = [(k, "x" * (k % 50)) for k in range(400)] + [(None, "y" * 30)] * 90 + [(77, "z" * 40)] * 60 + [(900, "l" * 5000), (901, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows(sharding.assign(df, shard_bytes=1000))
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((d, len(t or "")) for d, t in docs)
    shards = defaultdict(list)
    for r in got:
        shards[r["depth"], r["prefix"], r["page"]].append(r["n_bytes"])
    assert all(sum(v) <= 1000 or len([x for x in v if x]) == 1 for v in shards.values())
    buckets = defaultdict(int)
    for r in got:
        buckets[r["depth"], r["prefix"]] += r["n_bytes"]
    for (depth, prefix), size in buckets.items():  # only oversized buckets split
        parent = sum(s for (d, p), s in buckets.items() if d >= depth and p >> (d - depth + 1) == prefix >> 1)
        assert depth == 0 or parent > 1000


def test_sharding_of_odd_rows(odd, none):
    assert Counter(r.doc_id for r in sharding.assign(odd).collect()) == Counter(d for d, *_ in ODD)
    assert sharding.assign(none).collect() == []


# --- licences ----------------------------------------------------------------

def test_licences(spark, odd, none):
    mit = '''MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'''
    docs = [
        (1, mit), (2, "Words. Released under the MIT  Licence. More words."), (3, "no licence at all"), (4, None), (5, ""),
        (6, "junk words\nLicensed under CC BY-NC 4.0.\nSee the GNU General Public License for more details."),
        (7, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0!\nMIT License"),
        (7, "Notreleased under the MIT License."), (8, LONG + "\nApache License, Version 2.0"),
    ]
    got = [(r.doc_id, r.licences, r.unread_ids) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([
        (1, "MIT", ""), (2, "MIT", ""), (3, "", ""), (4, "", ""), (5, "", ""), (6, "CC-BY-NC-4.0", "GPL_see"),
        (7, "MIT,Apache-2.0", ""), (7, "", ""), (8, "Apache-2.0", ""),
    ])
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).collect() == []


def test_every_known_sentence_is_found_plain_wrapped_and_in_comments(spark):
    docs, expected = [], {}
    for name, group in licenses.SENTENCES.items():
        for sentence in group:
            for before in ("", "/* ", " * ", "# ", "// ", "-- ", "; ", "> "):
                for width in (30, 72, 10_000):
                    lines = ["Copyright (c) 2010 Jane Doe <jane@doe.org>", "", *textwrap.wrap(sentence, width, break_on_hyphens=False, break_long_words=False)]
                    for end in ("", "\n" + before + "\n" + before + "next words", ". Next words"):
                        expected[len(docs)] = name
                        docs.append((len(docs), "\n".join(before + line for line in lines) + end))
    found = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == expected
    alone = {rule: licence for licence, rule in licenses.RULES if " " not in rule}
    assert all(v[1] == alone.get(v[0], "") for v in got.values())


def test_licence_headers(spark):
    isc = """/* Copyright (c) 2010 Jane Doe <jane@doe.org>
 *
 * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
 */"""
    gpl = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License as
# published by the Free Software Foundation; either version 2 of the
# License, or (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program."""
    docs = [
        (1, isc), (2, gpl), (3, "// SPDX-License-Identifier: MPL-2.0\n// code"), (4, "SPDX-License-Identifier: GPL-2.0-or-later"),
        (5, "This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy of the MPL was not distributed with this\n file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        (6, "(Released under the MIT License.) More."), (7, "Released under the MIT License and others."), (8, "Notes on the\nMIT License"),
        (9, "Released under the\n\n* MIT License\nMIT License"), (10, "a. -b- Released/ under ./the MIT.. License"),
    ]
    got = {r.doc_id: (r.licences, r.unread_ids) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {
        1: ("ISC", ""), 2: ("GPL-2.0-or-later", ""), 3: ("MPL-2.0", ""), 4: ("GPL-2.0-or-later", ""), 5: ("MPL-2.0", ""), 6: ("MIT", ""),
        7: ("", ""), 8: ("MIT", ""), 9: ("MIT", ""), 10: ("", ""),
    }


def test_known_sentences_are_bounded_and_anchored():
    assert len(licenses.KNOWN) < 200
    assert all(any(a in word for a in licenses.ANCHORS for word in n.split(" ")) for n, _ in licenses.KNOWN)
    assert {i for _, rule in licenses.RULES for i in rule.split()} <= set(licenses.SENTENCES)


# --- mixing ------------------------------------------------------------------

def test_mixing_holds_every_share_to_within_a_block(spark):
    docs = [(k, "abcdefghij", s) for s, n in (("a", 600), ("b", 200), ("c", 90), (None, 50)) for k in range(n)]
    df = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(docs)], "doc_id long, text string, source string")
    got = rows(mixing.interleave(df, {"a": 0.5, "b": 0.3, "c": 0.2}, block_bytes=10))
    assert len(got) == len(docs) and len({r["slot"] for r in got}) == len(docs)
    assert all(r["released"] <= r["slot"] < r["due"] for r in got)
    rounds = {s: [r for r in got if r["source"] == s] for s in ("a", "b", "c")}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        slots = sorted(r["slot"] for r in rounds[s])
        for done, slot in enumerate(slots):  # before and after each of its slots
            assert abs(done - share * 1000 / 1001 * slot) < 1.01 and abs(done + 1 - share * 1000 / 1001 * (slot + 1)) < 1.01


def test_mixing_keeps_the_given_weights_over_many_rounds(spark):
    weights = {"a": 0.9986, "b": 0.0014 - 1e-4, "c": 1e-4}
    df = spark.range(24_000).selectExpr("id AS doc_id", "'abcdefghij' AS text", "if(id < 23960, 'a', if(id < 23996, 'b', 'c')) AS source")
    got = rows(mixing.interleave(df, weights, block_bytes=10))
    assert len(got) == len({r["slot"] for r in got}) == 24_000 and all(r["released"] <= r["slot"] < r["due"] for r in got)
    for s, share in weights.items():
        for done, slot in enumerate(sorted(r["slot"] for r in got if r["source"] == s)):
            assert abs(done - share * slot) < 1.001 and abs(done + 1 - share * (slot + 1)) < 1.001


def test_mixing_with_many_sources(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "if(id < 1500, 'hot', concat('h', id % 150)) AS source")
    got = rows(mixing.interleave(df, {"hot": 0.5} | {f"h{k}": 0.5 / 150 for k in range(150)}, block_bytes=10))
    assert len(got) == len({r["slot"] for r in got}) == 3000 and all(r["released"] <= r["slot"] < r["due"] for r in got)
    hot = sorted(r["slot"] for r in got if r["source"] == "hot")
    assert all(abs(done - slot / 2) < 1.001 for done, slot in enumerate(hot))


def test_mixing_of_odd_rows(odd, none):
    got = mixing.interleave(odd, block_bytes=64)
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, *_ in ODD)
    assert mixing.interleave(none).collect() == []
    assert mixing.interleave(odd.where("text IS NULL")).count() == 2


# --- archives ----------------------------------------------------------------

PAGES = [
    (1, "http://www.Example.com:80/a?b=1", "<p>x</p>"), (2, "https://blog.example.com/", "<p>x</p>"), (3, None, None), (4, "", ""),
    (5, "no url\nat all", "<p>ö</p>"), (None, "http://a.b/", "<p>x</p>"), (None, None, "only"), (6, "http://[bad", LONG), (6, "http://[bad", LONG), (7, "http://x.y/ö ü", "<p>x</p>"),
]


def test_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("same", F.lit(2))
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    lines = warc.write_archives(df, archives, file_bytes=300)
    directory = warc.write_index(lines, index, block_lines=2)
    got = rows(warc.read_archives(warc.index_lines(directory, index), archives))
    payload = {d: (h or "").encode() for d, _, h in PAGES}
    want = []
    for d, _, h in PAGES:
        same = [x for x, _, o in PAGES if (o or "") == (h or "") and x is not None]
        first = max(same, default=None)
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        want.append((d, len((h or "").encode()), digest, "response" if d == first else "revisit", None if d == first else first))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)
    assert all(r["payload"] == payload[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert [r["page_id"] for r in rows(warc.lookup(spark, directory, index, archives, "http://EXAMPLE.com/a?b=1"))] == []
    assert [r["page_id"] for r in rows(warc.lookup(spark, directory, index, archives, "http://www.example.com/a?b=1"))] == [1]


def test_lookup_finds_all_captures_of_a_hot_url(spark):
    pages = [(k, "http://h.org/hot" if 310 <= k < 890 else f"http://h.org/{'a' if k < 310 else 'z'}{k}", f"<p>{k}</p>") for k in range(1200)]
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    directory = warc.write_index(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), archives), index, block_lines=7, page_blocks=5)
    assert directory.where("first_key <= 'org,h)/hot' AND last_key >= 'org,h)/hot'").select("file").distinct().count() > 1
    for order in ("last_key", "first_key"):  # several blocks to a batch, in whatever order files are read
        blocks = directory.coalesce(1).sortWithinPartitions(F.desc(order), F.desc("file"))
        got = warc.lookup(spark, blocks, index, archives, "http://h.org/hot").collect()
        assert sorted((r.page_id, r.url) for r in got) == [(k, "http://h.org/hot") for k in range(310, 890)]
    for key, n in (("org,h)/a17", 1), ("org,h)/hot", 580), ("org,h)/none", 0), ("org", 0), ("zzz", 0)):
        near = warc.index_blocks(directory, key).count()  # the search leaves few blocks beside those of the key
        assert warc.index_lines(directory, index, key).count() == n and near <= n / 7 + 2 * spark.sparkContext.defaultParallelism
        assert near <= 1 if n <= 1 else near > 1


def test_folders_that_tasks_can_open(spark):
    assert warc.qualified(spark, "s3a://bucket/a") == "s3://bucket/a" and warc.qualified(spark, "hdfs://n:1/a") == "hdfs://n:1/a"
    assert warc.qualified(spark, "file:///x y") == "file:///x y" and warc.qualified(spark, "file:/x") == "file:/x"
    assert warc.qualified(spark, "/x/y") == "file:///x/y"  # the default file system of a local session
    with pytest.raises(ValueError, match="dbfs"):
        warc.qualified(spark, "dbfs://x/y")


def test_archives_of_nothing(spark):
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    lines = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), archives)
    assert warc.read_archives(warc.index_lines(warc.write_index(lines, index), index), archives).collect() == []


def test_reversed_hosts():
    assert warc.host_reversed("http://a.Example.com:80/x?q") == "com,example,a)/x?q"
    assert warc.host_reversed("https://h.org:8443") == "org,h:8443)/"
    assert [warc.host_reversed(x) for x in (None, "", "plain")] == ["", "", "plain"]


# --- search ------------------------------------------------------------------

def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(8)
    data = [(k, [float(x) for x in rng.normal(0, 0.3, 12).round(2)]) for k in range(300)]
    data += [(1000 + k, data[0][1]) for k in range(20)] + [(300, None), (302, [None, 1.0]), (303, [math.nan] * 12), (304, [math.inf] * 12), (None, data[1][1]), (305, []), (306, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))
    ok = [(d, [math.floor(256 * x) for x in v]) for d, v in data if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, x in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), d) for d, y in ok if d != q)
            want |= {(q, k + 1, d, -s) for k, (s, d) in enumerate(scored[:5])}
    assert {tuple(r) for r in topk.top_k(df, 50).collect()} == want
    assert topk.top_k(df.where("vec_id IS NULL"), 50).collect() == []
    assert [r.vec_id for r in topk.top_k(df.where("vec_id IN (0, 1, 2)"), 50).orderBy("rank").collect()] in ([1, 2], [2, 1])


@pytest.mark.parametrize("n", [1, 3, 31, 500])
def test_bounds_keep_every_winner(n):
    rng = np.random.default_rng(9)
    x, q = np.floor(rng.normal(0, 80, (n, 16))), np.floor(rng.normal(0, 80, (40, 16)))
    own = np.zeros((40, n), bool)
    own[np.arange(min(n, 40)), np.arange(min(n, 40))] = True
    scores = np.where(own, -np.inf, q @ x.T)
    best = np.sort(scores, axis=1)[:, -min(n, 5)]
    for floor in (np.full(40, -np.inf), best, best + 1, np.where(np.arange(40) % 2, best - 100, -np.inf)):
        found, read = topk.nra(x, topk.SortedLists(x), own, q, floor, 5)
        for j, near in enumerate(found):
            assert set(np.flatnonzero((scores[j] >= max(best[j], floor[j])) & ~own[j])) <= set(near)
        assert read.max() <= n


def test_lists_are_not_read_to_their_ends():
    """64 components that are near uniform: without a floor most of the lists are read, with one from another block two thirds."""
    rng = np.random.default_rng(10)
    x, more = np.floor(rng.normal(0, 32, (2, 4000, 64)))
    q = np.floor(rng.normal(0, 32, (50, 64)))
    none = np.zeros((50, 4000), bool)
    _, read = topk.nra(x, topk.SortedLists(x), none, q, np.full(50, -np.inf), 5)
    assert np.median(read) < 0.95 * 4000
    found, less = topk.nra(more, topk.SortedLists(more), none, q, np.sort(q @ x.T, axis=1)[:, -5], 5)
    assert np.median(less) < 0.75 * 4000 and less.max() < 4000 and max(map(len, found)) <= 250


# --- quality -----------------------------------------------------------------

def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.accepted for r in quality.classify(odd, labels).collect())  # one class only: nothing to learn
    assert quality.classify(none, labels).collect() == []
    kept = quality.keep_good(odd, labels.where("quality IS NULL"))
    assert kept.schema == odd.schema and kept.count() == len(ODD)


def test_quality_on_held_out_labels(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    found = quality.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    right, total, good, kept = found.agg(
        F.sum((F.col("accepted") == (F.col("quality") == 1)).cast("int")), F.count(F.lit(1)),
        F.sum("quality"), F.sum((F.col("accepted") & (F.col("quality") == 1)).cast("int")),
    ).first()
    assert total > 60 and right / total > 0.95 and kept / good > 0.97


def test_views_teach_each_other(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.co_train(quality.views(docs), labels)
    assert len(model.rounds) == quality.ROUNDS and all(r["from_text"] > 0 for r in model.rounds)


def test_text_view_counts_bytes_and_words():
    texts = ["One one two. One one two.\n\nOne one two.", "", "AB12 é  \t- x" * 50, LONG]
    for text, got in zip(texts, quality.text_view(pa.array(texts)), strict=True):
        data, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x]
        kinds = Counter(int(quality.KINDS[b]) for b in data)
        upper, lower = kinds[quality.UPPER], kinds[quality.LOWER]
        one, w, k = max(1, len(data)), max(1, len(words)), max(1, len(lines))
        want = [kinds[c] / one for c in range(8)]
        want += [sum(min(40, len(x)) for x in words) / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w]
        want += [math.log1p(len(words)), len(words) < 20, len(lines) / w, len(set(lines)) / k, sum(a == b for a, b in zip(lines, lines[1:], strict=False)) / k]
        want += [upper / max(1, upper + lower), not data]
        said = Counter()
        for word in words:
            place = mix(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])))[0]
            said[int(place) % quality.WORDS] += 1
        want += [said[c] / w for c in range(quality.WORDS)]
        assert np.allclose(got, np.array(want, float), atol=1e-6)


def weighted_newton(x, y, weight, penalty, w, steps, least_bent=0.0):
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope, bend = penalty * w, np.diag(penalty)
        for row, target, part, much in zip(x, y, p, weight, strict=True):
            slope = slope + much * (part - target) * row
            bend = bend + much * max(part * (1 - part) + 1e-9, least_bent) * np.outer(row, row)
        w = w - np.linalg.solve(bend, slope)
    return w


def co_trained(text, meta, label, held, steps=quality.STEPS, rounds=quality.ROUNDS):
    """Both views' scores of all rows in plain numpy: all rows in memory, one weight a row; ``label`` is nan where unknown."""
    own = ~np.isnan(label) & ~held
    data, penalties, fits = [], [], []
    for x, penalty in ((text, [1.0] * 18 + [10.0] * quality.WORDS), (meta, [10.0] * quality.META_WIDTH)):
        spread = x[own].std(0)
        z = np.c_[(x - x[own].mean(0)) / np.where(spread < 1e-9, 1.0, spread), np.ones(len(x))]
        data.append(z)
        penalties.append(np.array([*penalty, 1e-3]))
        fits.append(weighted_newton(z[own], label[own], np.ones(own.sum()), penalties[-1], np.zeros(z.shape[1]), 25))
    for r in range(1, rounds + 1):
        says = [np.clip(z @ w, -30, 30) for z, w in zip(data, fits, strict=True)]
        moved = []
        for view in (0, 1):
            y, weight = label.copy(), own.astype(float)
            for c, sure in ((0, says[1 - view] <= -np.log(19)), (1, says[1 - view] >= np.log(19))):
                mine = sure & np.isnan(label)
                y[mine] = c
                if mine.any():
                    weight[mine] = min(1.0, r / rounds * (label[own] == c).sum() / mine.sum())
            at = weight > 0
            moved.append(weighted_newton(data[view][at], y[at], weight[at], penalties[view], fits[view], steps, 0.25))
        fits = moved
    out, rate = [], label[held & ~np.isnan(label)].mean()
    for z, w in zip(data, fits, strict=True):
        raw = np.clip(z @ w, -30, 30)
        part = held & ~np.isnan(label)
        mean, spread = raw[part].mean(), raw[part].std()
        one = np.c_[(raw - mean) / spread, np.ones(len(raw))]
        out.append(np.clip(one @ weighted_newton(one[part], label[part], np.ones(part.sum()), np.full(2, 1e-3), np.zeros(2), 25), -30, 30))
    both = out[0] + out[1] - np.log(rate / (1 - rate))
    return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*out, both)]


def test_co_training_equals_plain_numpy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd_rows = spark.createDataFrame([(None if d is None else d + 10_000_000, *rest) for d, *rest in ODD], DOCS)
    docs = docs.unionByName(odd_rows).unionByName(docs.where("doc_id < 20"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id % 3 > 0")
    known = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    seen = quality.views(docs).withColumn("h", F.xxhash64("doc_id", F.lit(17))).collect()
    text = np.array([r.text_view for r in seen], float)
    meta = np.zeros((len(seen), quality.META_WIDTH))
    for k, r in enumerate(seen):
        meta[k, [r.source_at, r.lang_at, r.length_at]] = 1
    label = np.array([known.get(r.doc_id, np.nan) for r in seen], float)
    held = np.array([r.h % 4 == 0 for r in seen])
    want = co_trained(text, meta, label, held)
    assert 0.1 < want[2].mean() < 0.95 and np.isnan(label).sum() > 50
    got = quality.classify(docs.withColumn("score", F.lit("x")), labels).collect()

    def order(rows):
        return np.array(sorted(tuple(row) for row in rows))

    ids = [-1 if r.doc_id is None else r.doc_id for r in seen]
    got = order((-1 if r.doc_id is None else r.doc_id, r.p_text, r.p_meta, r.score) for r in got)
    assert np.allclose(got, order(zip(ids, *want, strict=True)), atol=1e-5)
    again = quality.keep_good(docs, labels)
    assert Counter(r.doc_id for r in again.collect()) == Counter(None if d == -1 else int(d) for d, *_, score in got if score >= quality.THRESHOLD)
