"""The ten operators against brute-force versions, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, media, minhash, mixing, quality, queries, sharding, style_tree, token_counts, warc
from tidemark.llm.common import scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, __row string"


def odd_docs(spark):
    """Nulls, empties, repeats, a long text, near copies, and columns with clashing names."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base).upper(), "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, "one", "en", "a"),
        (7, "One ", "en", None), (8, " \t\n", "de", "b"), (9, "é ü 日本 " * 5000, "fr", "a"), (None, "null id", "en", "a"), (None, None, None, None), (6, "one", "en", "a"),
    ]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(40)), "en", "a" if i % 3 else "c") for i in range(60)]
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], DOCS)


def empty(df):
    return df.where("false")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(rows):
    sets, up = [(i, shingles(t)) for i, t in rows if i is not None], {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


@pytest.mark.parametrize("which", ["odd", "table"])
def test_near_duplicates(spark, which):
    docs = odd_docs(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected, sizes = components_of(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], r.doc_id == expected[r.doc_id])
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(set(expected.values()))
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_chains_and_hot_groups_are_whole(spark):
    """Near copies in a chain, and many copies that differ in one word each."""
    rng = random.Random(2)
    base = ["b%d" % rng.randrange(500) for _ in range(300)]
    rows = [(i, " ".join([*base[: 20 * i], *["x%d" % i] * (i > 0), *base[20 * i + 1 :]])) for i in range(14)]
    step = list(base)
    for i in range(30):
        step = [*step]
        step[rng.randrange(300)] = "s%d" % i
        rows.append((100 + i, " ".join(step)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = components_of(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == expected


def test_mixing_keeps_every_row_and_stays_within_a_block(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(1000 + i, "t", "en", "abcd"[min(3, i % 5)], None, "x", "y") for i in range(400)], DOCS))
    shares = {"a": 5, "b": 2}
    got = mixing.mix(docs, shares, default_share=3, block_rows=4).collect()
    assert len(got) == docs.count()
    blocks = {(r["__source"], r["__block"]): (r["__slot"], r["__release"], r["__deadline"]) for r in got}
    slots = sorted(s for s, _, _ in blocks.values())
    assert slots == list(range(len(slots)))
    assert all(a <= s < b for s, a, b in blocks.values())
    left = {}
    for (source, _), _ in blocks.items():
        left[source] = left.get(source, 0) + 1
    share = {s: shares.get(s, 3) for s in left}
    first_round_out = min(n // share[s] for s, n in left.items())
    length = sum(share.values())
    for t in range(1, first_round_out * length + 1):  # while all sources last
        for s in left:
            done = sum(1 for (x, _), (slot, _, _) in blocks.items() if x == s and slot < t)
            assert abs(done - t * share[s] / length) < 1
    for source, n in left.items():
        assert sorted(b for s, b in blocks if s == source) == list(range(n))
    assert mixing.mix(empty(docs), shares).count() == 0
    ordered = mixing.mixed(docs, shares, 3, 4)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()


def test_sharding(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id >= 100").withColumn("doc_id", F.col("doc_id") + 1000))
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    key = lambda r: (r.doc_id is None, r.doc_id, r.shard, r.slot, r.text or "")
    assert sorted(got, key=key) == sorted(sharding.shard(docs).collect(), key=key)  # seeded
    assert sorted(map(key, got)) != sorted(map(key, sharding.shard(docs, seed=2).collect()))
    assert sharding.shard(empty(docs)).count() == 0


def test_query_columns_of_sharding(spark):
    for r in queries.op2_sharding(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_archives(spark):
    long_ = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(1, "http://a/1", long_), (2, "http://a/2\r\nX: y", long_), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 600), (None, "u", "nothing")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "t")
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.catalog_of(warc.read_archives(spark, path)).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[4].record_type) == ("revisit", 2, "response", "response")
    path = scratch(spark, "t")
    warc.write_archives(empty(pages), path)
    assert warc.read_archives(spark, path).count() == 0


def plain_scan(text, gate=True):
    words = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", " " + re.sub("[A-Z]", lambda m: m[0].lower(), text or "") + " ").strip() + " "
    words = " " if not words.strip() else words
    found = []
    for n, (label, key, priority, rx) in enumerate(licenses.RULES):
        if not gate or f" {key} " in words:
            found += [(m.start(), m.end(), priority, n, label) for m in re.finditer(f"(?<= ){rx}(?= )", words)]
    kept = []
    for d in found:
        over = [e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], e[1], e[2]) != (d[0], d[1], d[2]) or e[3] < d[3])]
        if not over:
            kept.append(d)
    w = words.split()
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept}))


def test_license_scan(spark):
    texts = [
        None, "", "...", "CC BY cc-by-nc-sa 4.0 and CC  by", "GNU General Public License version 2 or GPLv2 gpl 3.0", "All rights reserved. all RIGHTS reserved\nCopyright (c) 2019 2020 X",
        "Permission is hereby granted, free of charge, to any person obtaining a copy under the MIT License", "SPDX-License-Identifier: GPL-2.0-or-later", "general public license " * 400,
        "Licensed under the Apache License, Version 2.0; see the BSD 3-Clause", "éall rights reserved", "ÀLL rights reserved all rights reserved",
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_scan(t), t
        assert 0 <= r.score <= 1
    for r in licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_scan(r.text)


def test_license_names_joined_to_versions(spark):
    texts = ["GPLv1", "under GPLv2 only", "gpl2", "GPLv3.0", "LGPLv2.1", "lgpl3", "LGPLv3 or later", "the AGPLv3", "agpl3.0", "MPL2", "mpl2.0", "mpl20", "mpl", "GPLv2 and GPLv3", "gplv2x xgplv2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) == plain_scan(t, gate=False), t
    assert [got[i].labels for i in (0, 1, 4, 6, 7, 10)] == ["gpl-1.0", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl"] and got[1].score > 0.6


def test_transport_streams(spark):
    docs = odd_docs(spark)
    stored = media.encoded(docs)
    got = [(r.doc_id, r) for r in media.digest(media.decoded(stored)).collect()]
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(media.padded(r.text))
    for i, r in got:
        assert any((n, len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-64:])) == (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for n, d in texts[i])
        assert r.media_bytes % 188 == 0 and "cc=0" in r.feature


def test_demux_of_damaged_streams():
    data = random.Random(1).randbytes(40_000)
    stream = media.mux(data)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    (track,) = media.demux(stream)
    assert track.data == data and track.stamps == [8000 * i * 90000 // 8000 for i in range(5)] and track.random_access == [True, False, False, False, True]
    assert media.demux(b"".join([*packets[:9], packets[8], *packets[9:]]))[0].data == data  # a packet repeated
    assert media.demux(b"".join([*packets[:9], *packets[10:]]))[0].continuity_errors == 1
    assert media.demux(b"".join([*packets[:9], packets[9].replace(b"\x47", b"\x48", 1), *packets[10:]]))[0].continuity_errors == 1
    assert media.demux(b"") == [] and media.demux(b"junk" * 100) == []


def smith_waterman(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y and x else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best / (2 * max(1, len(a)))


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    import numpy as np

    for _ in range(200):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 25))]
        share, s, e = decontam.align(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert math.isclose(share, smith_waterman(a, b)) and 0 <= s <= e <= len(b)
        assert math.isclose(smith_waterman(a, b[s:e]), share)


def test_leaks(spark):
    rng = random.Random(4)
    w = ["v%d" % i for i in range(2000)]
    items = [(i, " ".join(rng.choice(w) for _ in range(40))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny one"), (None, "null item here")]
    filler = lambda n: " ".join(rng.choice(w) for _ in range(n))
    edited = [x if k % 9 else "edit%d" % k for k, x in enumerate(items[3][1].split())]
    rows = [(1, filler(300)), (2, f"{filler(50)} {items[0][1].upper()}. {filler(50)}"), (3, f"{filler(200)} {' '.join(edited)} {filler(9)}"), (4, None), (5, ""), (6, items[5][1]), (None, items[6][1]), (7, "a tiny one here")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(2, 0), (3, 3), (6, 5), (None, 6), (7, 52)}
    assert sorted(r.doc_id or 0 for r in decontam.clean(docs, bench).collect()) == [1, 4, 5]
    assert decontam.leaks(empty(docs), bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0


def test_leaks_are_those_of_full_alignment(spark):
    """Copies edited at every 3rd to 6th word, by other words or more words, with and
    without the verbatim item elsewhere, against an alignment of all with all."""
    rng = random.Random(9)
    w = ["v%d" % i for i in range(120)]
    items = [(i, [rng.choice(w) for _ in range(rng.choice([3, 5, 6, 20, 37]))]) for i in range(24)]
    docs = [[rng.choice(w) for _ in range(60)] for _ in range(10)]
    for _, x in items:
        for step in (3, 4, 5, 6):
            swapped = [t if k % step else "e%d" % k for k, t in enumerate(x, 1)]
            longer = [t for k, y in enumerate(x, 1) for t in ([y] if k % step else [y, "f%d" % k])]
            docs += [[*docs[step], *swapped, "g"], ["g", *longer, *docs[step]]]
    docs += [x for _, x in items[::2]]
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)]
    bench = [(i, " ".join(x)) for i, x in items]
    expected = {(i, j): s for i, x in enumerate(docs) for j, y in items if (s := smith_waterman(y, x)) >= 0.6}
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(expected)
    assert all(math.isclose(r.score, expected[r.doc_id, r.item_id]) for r in got)


def plain_kneser_ney(texts, asked):
    """Modified Kneser-Ney by its definition: the probability of each asked window."""
    n = quality.ORDER
    levels = [{} for _ in range(n + 1)]
    for t in texts:
        t = "\x01" * (n - 1) + t + "\x02"
        for i in range(len(t) - n + 1):
            levels[n][t[i : i + n]] = levels[n].get(t[i : i + n], 0) + 1
    for k in range(n - 1, 0, -1):
        before = {}
        for g in levels[k + 1]:
            before.setdefault(g[1:], set()).add(g[0])
        levels[k] = {g: len(v) for g, v in before.items()}
    chars = {c for g in asked for c in g[-1]} | set(levels[1])
    ds = [None] + [quality.discounts([sum(1 for c in levels[k].values() if c == j) for j in (1, 2, 3, 4)]) for k in range(1, n + 1)]

    def p(g):
        if not g:
            return 1 / len(chars)
        k, q = len(g), p(g[1:])
        after = [c for h, c in levels[k].items() if h[:-1] == g[:-1]]
        if not after:
            return q
        off = lambda c: ds[k][min(c, 3) - 1] if c else 0
        c = levels[k].get(g, 0)
        return (c - off(c) + sum(map(off, after)) * q) / sum(after)

    return {g: p(g) for g in asked}


def test_kneser_ney_is_the_plain_model(spark):
    texts = ["abc abd abcabc", "abab! 12", "the theatre", "tä日本 ab", "aaaaaaa", None, ""]
    docs = spark.createDataFrame([(i, "en", i, t) for i, t in enumerate(texts)], "doc_id long, lang string, key long, text string")
    blocks = quality.packed(docs).cache()
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6)], "doc_id long")
    counts = quality.window_counts(blocks, trusted).cache()
    asked = {r.gram for r in counts.collect()}
    windows = lambda t: [p[i : i + 5] for p in ["\x01" * 4 + t + "\x02"] for i in range(len(t) + 1)]
    assert asked == {g for t in filter(None, texts) for g in windows(t)}
    expected = plain_kneser_ney([t for t in (texts[i] for i in (0, 1, 2))], asked)
    model = quality.kneser_ney(quality.orders(counts))
    got = {r.gram: r.p for r in model.collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[g], expected[g], rel_tol=1e-9) for g in got)
    for r in quality.perplexities(blocks, model).collect():
        w = windows(texts[r.doc_id])
        assert math.isclose(r.perplexity, math.exp(-sum(math.log(expected[g]) for g in w) / len(w)), rel_tol=1e-5)


def test_windows_of_large_alphabets():
    text = "".join(chr(c) for c in range(0x3000, 0xA000)) + "ab" * 50  # beyond 63 bits for five characters
    w = quality._Windows([text, "x", text[::-1]])
    assert w.heads is not None
    names = w.names().tolist()
    expected = {}
    for t in (text, "x", text[::-1]):
        t = "\x01" * 4 + t + "\x02"
        for i in range(len(t) - 4):
            expected[t[i : i + 5]] = expected.get(t[i : i + 5], 0) + 1
    assert dict(zip(names, w.counts().tolist(), strict=True)) == expected


def test_quality_keeps_good_and_rejects_junk(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.toxic]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.06 * len(junk)


def test_quality_thresholds_are_near_the_quantile(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    toxic = [r.kept for r in rows if r.toxic]
    assert sum(junk) <= 0.03 * len(junk) and sum(toxic) <= 0.6 * len(toxic)


def test_quality_on_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, 1, None, "z") for i in range(100, 160)] + [(None, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(r.kept for r in got if r.perplexity is None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id, r.lang or "", r.text or "")
    stay = {(r.doc_id, r.lang, r.key): r.kept for r in got}
    expected = [r for r in docs.withColumn("k", quality.text_key()).collect() if stay[r.doc_id, r.lang, r.k]]
    assert sorted(map(key, kept.collect())) == sorted(map(key, expected)) and len(expected) < docs.count()
    two = spark.createDataFrame([(1, "en", "wor" * 20), (1, "en", "\u0416\u0414" * 30)], "doc_id long, lang string, text string")
    assert quality.keep_good(docs.select(*two.columns).unionByName(two), labels).where("text like '%\u0416%'").count() == 0
    assert all(r.kept for r in quality.score(docs, labels.where("false")).collect())
    assert quality.score(empty(docs), labels).count() == 0


def test_main_text(spark):
    menu, foot = "<div class='x1'>Home About Contact</div>", "<div class='x2'>Same words on all pages</div>"
    rows = [(i, f"https://h.example/{i}", f"<html><body>{menu}<div class='x3'><p>Text number {i} &amp; more</p><p>line\n {i * i}</p></div>{foot}</body></html>") for i in range(12)]
    rows += [(100, None, None), (101, "x", ""), (102, "https://other/", f"<body>{menu}<article><h1>A</h1><p>b<br>c<nav>n</nav></article><footer>f</footer>"), (103, "https://h.example/z", "plain &lt;text")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in style_tree.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Text number {i} & more\n\nline {i * i}"
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("", "", "A\n\nb c", "plain <text")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert style_tree.extract(empty(pages)).count() == 0


def test_main_text_of_deep_pages(spark):
    """Surplus end tags, and menus, at any depth."""
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    page = f"<body><div><article><p>first</p>{deep(250, '')}<p>kept</p></article></div>"
    menu = f"<body>{deep(1000, '<p>text</p><nav>menu</nav>')}<footer>foot</footer>"
    unclosed = "<body>" + "<span>" * 100_000 + "text</b><nav>menu</nav><p>more</p>"
    assert [style_tree.main_text(x) for x in (page, menu, unclosed)] == ["first\n\nkept", "text", "text\n\nmore"]
    nodes = []
    style_tree.blocks(deep(1000, "<div class='x'>a</div>b") + "c", nodes=nodes)
    assert [n.leaves for n in nodes] == [1] + [2] * 1000
    same = []
    style_tree.blocks("<div><p>a</p><p>b</p></div><div>a<br><p>b</p></div><div><p>b</p><p>a</p></div>", nodes=same)
    text = {(n.tag, n.leaves): [m.content for m in same if (m.tag, m.leaves) == ("div", 2)] for n in same}["div", 2]
    assert text[0] == text[1] != text[2]


def test_token_counts_at_every_prefix(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    tokenizer, counter, rng = Tokenizer.from_file(path), token_counts.PrefixCounter(path), random.Random(6)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = ["", "it's  a\n\n test", "a<|endoftext|> b!<|endoftext|>", "日本語 éü 🎉", " 's", "\r\n\t x", "١٢ ½"]
    texts += ["".join(rng.choice("a b'sl\n \t!é1<|日e") for _ in range(rng.randrange(1, 20))) for _ in range(150)]
    for t in texts:
        assert counter(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t
    docs = odd_docs(spark)
    by = {}
    for r in docs.collect():
        by.setdefault(r.doc_id, []).append(count(r.text or ""))
    got = token_counts.token_counts(docs, path).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens in by[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in got)
    cut = token_counts.within_budget(docs.where("doc_id in (1, 9)"), path, 50)
    assert cut.columns == docs.columns and all(count(r.text) <= 50 for r in cut.collect())


def test_token_counts_of_long_runs_and_whole_texts(spark):
    """Long runs of one character against the library, in time in proportion to them; the
    whole table; the longest prefix within a budget against all prefixes."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    tokenizer, counter, rng = Tokenizer.from_file(path), token_counts.PrefixCounter(path), random.Random(7)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for run in (" ", "\n", "'", "a", "日", "!", "'s", " \n", "'re"):
        for text in (run * 20_000, run * 20_000 + "x", "x" + run * 20_000):
            assert counter.count(text, 512)[0] == count(text), run
    for _ in range(150):
        t = "".join(rng.choice(["a", " ", "'", "s", "re", "\n", "　", "é", "1", "<|endoftext|>", "<|"]) for _ in range(rng.randrange(1, 16)))
        for limit in (0, 1, 3, 7):
            prefixes = counter(t)
            assert counter.count(t, limit) == (count(t), int(max(i for i in range(len(t) + 1) if prefixes[i] <= limit))), t
    rows = token_counts.token_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    for r in rows.collect():
        n = count(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert token_counts.token_counts(rows.withColumn("text", F.lit("x")).where("false"), path).count() == 0
    held = token_counts.prefix_counts(spark.createDataFrame([(1, "it's"), (2, None)], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.counts for r in held} == {1: [count("it's"[:i]) for i in range(5)], 2: [0]}


def test_letters_of_one_form_are_not_all_compared(spark):
    """Letters that fill one form stay below the similarity: pairs that are compared come
    from what fills it, and results are those of brute force."""
    rng = random.Random(11)
    form = ["f%d" % i for i in range(300)]
    rows = []
    for i in range(240):
        words = list(form)
        for at in range(10, 300, 29):
            words[at] = "x%d" % rng.randrange(400)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1].replace("f5 ", "g5 ")) for i in range(0, 240, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = components_of(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == expected
    sets = minhash._reduced(minhash.shingle_sets(docs)).withColumn("part", F.col("node"))
    ids = {r.node: r.doc_id for r in minhash.signatures(docs).collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in minhash._rare_pairs(sets, 85).collect()}
    assert {tuple(sorted(p)) for p in itertools.combinations([i for i, _ in rows], 2) if expected[p[0]] == expected[p[1]]} <= found
    assert len(found) <= 6 * len(rows)


def test_rows_that_share_a_doc_id_are_judged_by_themselves(spark):
    base = " ".join("b%d" % i for i in range(200))
    other = " ".join("o%d" % i for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base.replace("b7 ", "c7 ")), (2, other), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in minhash.deduplicate(docs).collect()) == [(1, base), (2, other), (3, "")]


def test_windows_of_long_texts_are_those_of_their_parts(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c日") for _ in range(n)) for n in (1, 3, 49, 50, 51, 100, 333, 7)]
    whole = quality._Windows(texts)
    monkeypatch.setattr(quality, "_CHUNK", 50)
    parts = quality._Windows(texts)
    assert parts.names().tolist() == whole.names().tolist() and parts.counts().tolist() == whole.counts().tolist()
    weights = np.arange(len(whole.codes), dtype=np.float32)
    assert np.allclose(parts.means(weights), whole.means(weights))
    places = {g: i for i, g in enumerate(whole.names().tolist())}
    for t, mean in zip(texts, whole.means(weights), strict=True):
        t = "\x01" * 4 + t + "\x02"
        own = [places[t[i : i + 5]] for i in range(len(t) - 4)]
        assert math.isclose(mean, sum(own) / len(own))


def test_main_text_of_broken_markup():
    got = {
        '<a href="x>link</a>': "link",
        "<a href=it's>link</a> and it's <p>two": "link and it's\n\ntwo",
        "<body><svg><p>x</div><p>after": "x\n\nafter",
        "<div><svg><path>q</svg>a</div><object>b<p>c</object><p>after": "a\n\nafter",
        "<title>t</title x>a<script>x</scripted></script foo>b<SCRIPT>y": "ab",
        "<p title='a > b' data-x=\"<p>\">in</p>": "in",
        "<article><header><h1>Title</h1></header><p>x<p class='side'>y<p class=ad>z<div class='related'>r</div><div class='entry-header'>h</div></article>": "Title\n\nx\n\ny\n\nh",
        "<p>a<b><i><u><s>b<div>c": "ab\n\nc",
        "<p>a <button>x</button>b<select><option>y<p>z</select>c": "a b\n\nc",
        "<p>a<button>x<p>c<label>l": "a\n\nc",
        "<": "<", "a < b": "a < b", "<!-- x": "", "<p": "",
    }
    assert {k: style_tree.main_text(k) for k in got} == got


def test_style_tree_is_the_plain_one(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = {}
    for r in pages.select(style_tree._host().alias("host"), F.xxhash64("html").alias("page"), "html").collect():
        nodes = []
        style_tree.blocks(r.html, nodes=nodes)
        for n in nodes if r.host else ():
            seen.setdefault((r.host, n.path), set()).add((r.page, " ".join(n.kids), n.content, n.leaves))
    expected = {}
    for key, rows in seen.items():
        n_pages, m = len({r[0] for r in rows}), len(rows)
        if n_pages > 1:
            def entropy(at):
                counts = {}
                for r in rows:
                    counts[r[at]] = counts.get(r[at], 0) + 1
                return -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m)

            weight = style_tree.GAMMA ** (sum(r[3] for r in rows) / m)
            up = lambda x: (x * n_pages + style_tree.PRIOR) / (n_pages + style_tree.PRIOR)
            expected[key] = (n_pages, entropy(1), up(entropy(2)), up((1 - weight) * entropy(1) + weight * entropy(2)))
    got = {(r.host, r.node): (r.pages, r.presentation, r.content, r.importance) for r in style_tree.style_tree(pages).collect()}
    assert got.keys() == expected.keys() and expected
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in got for a, b in zip(got[k], expected[k], strict=True))


@pytest.mark.parametrize("n", [2, 3, 12])
def test_the_tree_alone_removes_what_a_host_repeats(spark, n):
    menu, notice, foot = "<nav><ul><li>Home<li>News</ul></nav>", "<div class='q'><p>We value you</p></div>", "<footer>All of us</footer>"
    page = lambda i: f"<body>{menu}{notice}<div class='c'><h2>Title {i}</h2><p>Text number {i}</p><p>line {i * i}</p></div>{foot}"
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(n)] + [(99, "https://alone.example/", page(99))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(pages, names=False).collect()}
    assert all(got[i] == f"Title {i}\n\nText number {i}\n\nline {i * i}" for i in range(n))
    assert got[99].startswith("Home") and style_tree.extract(pages).where("page_id = 99").first().text.startswith("We value you")


def test_leaks_of_every_spacing_and_of_shared_stems(spark):
    """Copies edited at every 2nd to 9th place, in clumps or at random, of items that share
    a long stem, and the given tables: against an alignment of all with all."""
    rng = random.Random(12)
    w = ["v%d" % i for i in range(400)]
    stem = "which of the following is the most likely reason why".split()
    items = [(i, [*stem, *[rng.choice(w) for _ in range(rng.choice([6, 15, 30]))]]) for i in range(30)]
    docs = [[*stem, *[rng.choice(w) for _ in range(40)]] for _ in range(20)]
    for _, x in items:
        for step in range(2, 10):
            docs.append([*docs[step], *[t if k % step else "e%d" % k for k, t in enumerate(x, 1)], "g"])
        for share in (0.1, 0.2, 0.3):
            docs.append([t if rng.random() > share else "r%d" % rng.randrange(999) for t in x])
        docs.append([*x[:4], *["c%d" % k for k in range(len(x) // 5)], *x[4 + len(x) // 5 :]])
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)]
    bench = [(i, " ".join(x)) for i, x in items]
    expected = {(i, j) for i, x in enumerate(docs) for j, y in items if smith_waterman(y, x) >= 0.6}
    block = decontam._Block(bench, 0.6)
    assert len(block.seeds) < len(np_unique_bigrams(items)) and len(expected) > 200
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected


def np_unique_bigrams(items):
    return {(a, b) for _, x in items for a, b in zip(x, x[1:], strict=False)}


def test_leaks_of_the_given_tables(spark):
    import numpy as np

    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r.doc_id, decontam.words_of(r.text)) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, decontam.words_of(r.text)) for r in bench.collect()][:60]
    ids = {}
    code = lambda x: np.array([ids.setdefault(t, len(ids) + 1) for t in x], np.int64)
    items = [(i, code(x)) for i, x in items]
    expected = set()
    for d, x in texts:
        x = np.array([ids.get(t, 0) for t in x], np.int64)
        for i, y in items:
            if len(x) and np.isin(x, y).sum() >= 0.6 * len(y) - 1e-9 and decontam.align(y, x)[0] >= 0.6:
                expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    names = {i for i, _ in items}
    assert {x for x in got if x[1] in names} == expected and expected


def test_archives_of_the_given_pages(spark, monkeypatch):
    """The whole table, repeated rows, and pages too long to share a file, against a plain
    resolution."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 18)
    long_ = "<p>" + "long " * 100_000
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10**6 + i, "http://x/", long_ if i % 2 else long_ + "é" * i) for i in range(5)] + [(10**7, None, "a" * 999), (10**7 + 1, "u", "a" * 999), (10**7 + 2, "u", "a" * 1000), (10**7 + 3, "u", "a" * 1000)], pages.schema)
    pages = pages.unionByName(extra).unionByName(pages.where("page_id % 7 = 0").withColumn("page_id", F.col("page_id") + 10**5))
    path = scratch(spark, "t")
    warc.write_archives(pages, path)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for i, data in rows:
        last[data] = max(last.get(data, i), i)
    expected = sorted((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if len(data) >= 1000 and last[data] != i else "response", last[data] if len(data) >= 1000 and last[data] != i else None) for i, data in rows)
    got = warc.catalog_of(warc.read_archives(spark, path)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert sum(1 for x in expected if x[3] == "revisit") > 3
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).count()
    assert sizes > 5


def test_sharding_of_hot_rows(spark, monkeypatch):
    """A third of the rows are one row again and again, a third share a doc_id: buckets are
    split, every row stays, and the order does not follow the session's partitions."""
    monkeypatch.setattr(sharding, "LEAST_BUCKETS", 4)
    rows = [(7, "same " * 200)] * 900 + [(8, "text %d " % i * 50) for i in range(900)] + [(1000 + i, None if i % 9 == 0 else "other " * (i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # each shard has its part of the hot row
    hot = [sum(1 for r in got if r.doc_id == 7 and r.shard == k) for k in range(8)]
    assert max(hot) < 500
    unequal = docs.where("doc_id <> 7")
    order = lambda: {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shard(unequal).collect()}
    one = order()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert order() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_repeated_and_missing_rows(spark):
    """The operators on empty tables, on rows that occur twice, and on very long texts."""
    rng = random.Random(21)
    long_ = " ".join(rng.choice(["all", "rights", "reserved", "cc", "by", "general", "public", "license", "mit", "x1"]) for _ in range(30_000))
    rows = [(1, long_), (2, "cc by"), (2, "cc by"), (None, "cc by"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "l", 5) for r in rows], "doc_id long, text string, labels string, n_words int")
    scans = licenses.scan(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base) for r in scans) == sorted((i or 0, *plain_scan(t)[:2]) for i, t in rows)
    assert licenses.scan(empty(docs)).count() == 0

    streams = media.digest(media.decoded(media.encoded(docs))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in streams) == sorted((i or 0, len((t or "").encode())) for i, t in rows)
    assert media.digest(media.decoded(media.encoded(empty(docs)))).count() == 0

    item = " ".join("i%d" % k for k in range(30))
    leaky = spark.createDataFrame([(1, long_ + " " + item), (1, long_ + " " + item), (2, long_), (5, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontam.leaks(leaky, bench).collect()) == [(1, 7, 1.0), (5, 7, 1.0)]
    assert [r.doc_id for r in decontam.clean(leaky, bench).collect()] == [2]

    body = "<article><p>" + "</p><p>".join("line %d" % k for k in range(40_000)) + "</p></article>"
    pages = spark.createDataFrame([(1, "http://a/", body), (1, "http://a/", body), (2, "http://a/b", "<nav>m</nav>"), (3, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text.count("\n\n")) for r in style_tree.extract(pages).collect())
    assert got[0] == got[1] and got[0][2] == 39_999 and got[2:] == [(2, 0, 0), (3, 0, 0)]
