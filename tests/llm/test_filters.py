"""Tokenizing, sharding, URL rules, licences, quality and decontamination."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from parlance.llm import decontaminate, licenses, quality, sentencepiece, sharding, url_filter

DOCS = "doc_id long, text string, node string"
needs_model = pytest.mark.skipif(not Path(sentencepiece.MODEL).exists(), reason="no tokenizer model here")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)


ODD = ["Hello  world\n▁x é漢 \t²² m².", "", " ", "  a", "\U0010fe05x", "\x00", None, "thontion " * 20_000, "x" * 30_000]


@needs_model
def test_encoding_round_trip(spark):
    rows = [*enumerate(ODD), (None, "null key"), (3, "  a")]
    frame = docs(spark, rows)
    coded = sentencepiece.encode(frame, keep=("node",))
    got = coded.collect()
    assert all(r.lossless for r in got if r.ids is not None) and sum(r.ids is None for r in got) == 1
    assert all(r.pieces == len(r.ids) for r in got if r.ids is not None)
    back = sentencepiece.decode(coded).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in back) == sorted((repr(i), repr(t)) for i, t in rows)
    again = {(r.doc_id, tuple(r.ids or ())) for r in sentencepiece.encode(frame.repartition(3)).collect()}
    assert again == {(r.doc_id, tuple(r.ids or ())) for r in got}
    other = {(r.doc_id, tuple(r.ids or ())) for r in sentencepiece.encode(frame, seed=2).collect()}
    assert other != again and sentencepiece.encode(frame.limit(0)).count() == 0


@needs_model
def test_sampling_follows_the_lattice():
    """Frequencies of whole segmentations equal their share of the weight of all, by enumeration."""
    sampler = sentencepiece.Sampler()
    weights = sampler.pieces.weights
    word = "▁there"

    def ways(s):
        if not s:
            return [((), 1.0)]
        return [((weights[s[:k]][0], *rest), weights[s[:k]][1] * w) for k in range(1, len(s) + 1) if s[:k] in weights for rest, w in ways(s[k:])]

    all_ways = dict(ways(word))
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in sampler.encode([b"there"] * n, sentencepiece.row_seeds([b"%d" % i for i in range(n)], 1)))
    total = sum(all_ways.values())
    assert set(drawn) <= set(all_ways)
    for way, w in all_ways.items():
        p = w / total
        assert abs(drawn[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


@needs_model
def test_lattices_built_together_equal_single_ones():
    pieces = sentencepiece.Pieces(sentencepiece.MODEL, 1.0)
    one, many = sentencepiece.Lattices(pieces), sentencepiece.Lattices(pieces)
    stretches = ["▁thontiontion", "▁the", "▁", "\n", "é", "▁漢x", "&&&", "▁" + "anlybleth" * 5, "y" * 90]
    many.add_many(stretches)

    def edges(lat, at, state):
        e, out, before = lat.first[lat.base[at] + state], {}, 0.0
        while True:
            c = lat.chance[e]
            out[lat.piece[e], lat.back[e]] = min(c, 1.0) - before
            before = c
            if c > 1:
                return out
            e += 1

    for s in stretches:
        k = one.add(s)
        assert one.size[k] == many.size[many.places[s]]
        for state in range(1, one.size[k] + 1):
            assert edges(one, k, state) == pytest.approx(edges(many, many.places[s], state))


def test_shard_table():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 997)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    less = sharding.fill_table(names[:-1], 997)
    moved = sum(a != b for a, b in zip(table, less) if a != 9)
    assert moved < 0.15 * 997
    assert sharding.fill_table(["a"], 2) == [0, 0]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 8)


def test_table_equals_a_naive_fill():
    """Each shard in turn claims the first free slot of its whole list of preferences, written out."""
    import xxhash

    for names, slots in (([f"s{i}" for i in range(7)], 101), (["a", "b", "c"], 3), (["one"], 13), ([f"x{i}" for i in range(40)], 211)):
        lists = []
        for s in names:
            offset, skip = (xxhash.xxh64_intdigest(s.encode(), k) for k in (1, 2))
            lists.append([(offset % slots + j * (skip % max(1, slots - 1) + 1)) % slots for j in range(slots)])
        assert all(sorted(p) == list(range(slots)) for p in lists)
        owner = {}
        while len(owner) < slots:
            for k, preferred in enumerate(lists):
                if len(owner) < slots:
                    owner[next(p for p in preferred if p not in owner)] = k
        assert sharding.fill_table(names, slots) == [owner[i] for i in range(slots)]


def test_sharding(spark, tmp_path):
    names = [f"s{i}" for i in range(4)]
    rows = [(i, "x", 7, {"a": 1}) for i in range(4000)] + [(None, str(i), 7, None) for i in range(2000)] + [(5000, "hot", i, None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, shard string, hash long, m map<string,int>")
    out = sharding.assign_shards(frame, ["k"], names, 997, spare=["hash"], hot_share=0.25)
    got = out.collect()
    assert out.columns == ["k", "hash", "m", "slot", "shard"] and len(got) == 8000
    table = sharding.fill_table(names, 997)
    assert all(r.shard == names[table[r.slot]] for r in got)
    share = Counter(r.shard for r in got if r.k is not None)
    assert max(share.values()) < 1.25 * 6000 / 4
    assert len({r.shard for r in got if r.k == 5000}) == 4
    together = sharding.assign_shards(frame, ["k"], names, 997, hot_share=None).collect()
    assert len({r.slot for r in together if r.k == 5000}) == 1
    assert sharding.assign_shards(frame.limit(0), ["k"], names, 997).count() == 0
    sharding.write_shards(out.drop("m"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_url_rules(spark):
    hosts = ["a.example.com", "EXAMPLE.com", "com", "xcom", "example.net", "b.c.example.net", "d.org", "org", "É.com", "example.com:80", "", ".com", "example.com."]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/de/", "/de/8#y", "/es/z", "?/en/", "#/en/", "/EN/7", "/en", "/de/é\n"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://x.com/en/", "a://b://c.com/en/", "ftp://x.com/en/7://q"]
    urls += urls[:5]
    frame = spark.createDataFrame([(i, u, "clash", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = url_filter.judge_urls(frame, "url", url_filter.rule_table(spark, RULES))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: judge(u, RULES) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(frame.limit(0), "url", url_filter.rule_table(spark, RULES)).count() == 0
    none = url_filter.judge_urls(frame, "url", url_filter.rule_table(spark, RULES).limit(0), "block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [("a.com", "/", "allow"), ("a.com", "/", "block")])


def test_license_scan(spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choice(["the", "of", "house", "work", "is", "public", "and", "river", "free", "general", "copy", "all"]) for _ in range(rng.randrange(5, 60))) for _ in range(300)]
    model = licenses.train(plain[:100])
    held = [(f, t) for f, all_ in licenses.TEMPLATES.items() for t in all_]
    notices = [(f, t if k % 2 else f"{t} {plain[k]}") for k, (f, t) in enumerate(held)]
    rows = [(i, f"{plain[i]}\n{t}\n{plain[i + 1]}") for i, (_, t) in enumerate(notices)]
    rows += [(1000 + i, p) for i, p in enumerate(plain[100:])] + [(3000, None), (3001, ""), (None, "Released under the MIT License."), (3002, "word " * 100_000)]
    got = licenses.scan(docs(spark, rows), model).collect()
    right = {r.doc_id: r.family for r in got if r.doc_id is not None and r.doc_id < 1000 and r.paragraph == 1}
    assert sum(right.get(i) == f for i, (f, _) in enumerate(notices)) >= 0.9 * len(notices)
    assert sum(r.doc_id is not None and r.doc_id >= 1000 for r in got) <= 2
    assert [r.family for r in got if r.doc_id is None] == ["MIT"]
    assert licenses.scan(docs(spark, []), model).count() == 0


HELD_OUT = {
    "Apache-2.0": ("Copyright 2019 The Example Authors. Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "This software is released under the Apache 2.0 license, see the file for details."),
    "MIT": ("This project is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this font software and associated documentation files, to deal in the software without restriction"),
    "BSD": ("Use of this source code is governed by a BSD-style license found in the LICENSE file of this tree.", "Redistributions in binary form and source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "GPL": ("This file is part of a program that you can redistribute and/or modify under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GNU General Public License, version 2."),
    "MPL-2.0": ("This file is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY": ("This article is licensed under a Creative Commons Attribution 4.0 International License.",),
    "Proprietary": ("Copyright 1999 Example Corporation. All rights reserved.",),
}


def test_licenses_on_held_out_notices(spark):
    """Notices that are no template, and other text with their words; a wrapped licence is one paragraph."""
    model = licenses.train()
    notices = [(f, t) for f, some in HELD_OUT.items() for t in some]
    other = ["The apache people of the plains had a general council.", "A license plate was stolen from a public library.", "He reserved all rights to the table by the window and left.", "Creative writing is a common course of the university."]
    rows = [(i, f"some line before\n\n{t}\n\nafter it") for i, (_, t) in enumerate(notices)] + [(100 + i, t) for i, t in enumerate(other)]
    got = {r.doc_id: r.family for r in licenses.scan(docs(spark, rows), model).collect()}
    assert sum(got.get(i) == f for i, (f, _) in enumerate(notices)) >= len(notices) - 1
    assert not {100 + i for i in range(len(other))} & got.keys()
    words = licenses.TEMPLATES["GPL"][1].split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    two = "Released under the MIT License.\nLicensed under the Mozilla Public License 2.0."
    got = [(r.doc_id, r.paragraph, r.last, r.family) for r in licenses.scan(docs(spark, [(1, f"intro\n{wrapped}\nend"), (2, two)]), model).collect()]
    assert sorted(got) == [(1, 1, len(wrapped.split("\n")), "GPL"), (2, 0, 0, "MIT"), (2, 1, 1, "MPL-2.0")]


def test_license_scores_equal_a_dense_product():
    model = licenses.train()
    paragraphs = [licenses.tokens(t.encode()) for some in HELD_OUT.values() for t in some] + [[], [b"nothing", b"known"]]
    x = np.zeros((len(paragraphs), len(model.features) + 1))
    for i, words in enumerate(paragraphs):
        at = sorted({model.features[g] for g in licenses.grams(words) if g in model.features})
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
        x[i, -1] = 1
    z = np.exp(x @ model.weights / model.temperature)
    assert model.probabilities(paragraphs) == pytest.approx(z / z.sum(axis=1, keepdims=True))


def test_ordinal_model_on_held_out_texts(spark):
    rng = random.Random(2)

    def text(g):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        if g == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        if g == 0:
            w = [x + "###" for x in w]
        return " ".join(w)

    rows, labels = [], []
    for i in range(900):
        g = i % 3
        rows.append((i, text(g)))
        labels.append((i, int(g > 0), None if g == 2 and i % 2 else int(g == 1)))
    train = docs(spark, rows[:600])
    rated = spark.createDataFrame([*labels, (None, 1, 0), (7000, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(train, rated)
    assert (model.weights <= 0).all() and (np.diff(model.thresholds) > 0).all()
    scored = {r.doc_id: r for r in quality.score_documents(docs(spark, rows[600:]), model).collect()}
    assert np.mean([scored[i].grade == i % 3 for i in range(600, 900)]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs(spark, rows[600:]), model).collect()}
    assert len(kept ^ {i for i in range(600, 900) if i % 3 == 2}) < 6
    for r in scored.values():
        assert r.expected_grade == pytest.approx(r.p_above_0 + r.p_above_1) and r.p_above_0 >= r.p_above_1
    same = quality.train(train.repartition(5), rated)
    assert np.allclose(same.weights, model.weights)
    odd = quality.score_documents(docs(spark, [(1, None), (2, ""), (None, "w1"), (3, "w " * 100_000)]), model).collect()
    assert len(odd) == 4 and quality.keep_good(docs(spark, []), model).count() == 0
    for empty in (quality.train(train, rated.limit(0)), quality.train(train.limit(0), rated), quality.train(train, rated.where("quality = 0"))):
        assert len(empty.thresholds) == 2 and quality.keep_good(train, empty).count() == 600
        assert {r.score for r in quality.score_documents(train, empty).collect()} == {0.0}


def test_ordinal_fit_equals_an_independent_optimum():
    """The same penalized likelihood, written plainly and minimized by projected descent with numerical gradients."""
    rng = np.random.default_rng(3)
    grades = np.repeat([0, 1, 2], 120)
    chance = {7: (0.9, 0.5, 0.1), 8: (0.8, 0.1, 0.1), 9: (0.5, 0.5, 0.5)}
    features = [np.array([f for f, p in chance.items() if rng.random() < p[g]], np.int32) for g in grades]
    model = quality.fit_ordinal(features, grades, steps=3000, rate=0.03)
    assert model.weights[9] == 0 and np.flatnonzero(model.weights).tolist() == [7, 8]
    x = np.array([[7 in f, 8 in f] for f in features], float)

    def loss(v):
        theta = np.array([v[2], v[2] + np.exp(v[3])])
        above = 1 / (1 + np.exp(-(x @ v[:2])[:, None] + theta))
        full = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
        p = full[np.arange(len(x)), grades] - full[np.arange(len(x)), grades + 1]
        return -np.log(p).sum() / len(x) + 0.15 * (v[:2] ** 2).sum() / len(x)

    v = np.array([-0.1, -0.1, -1.0, 0.0])
    for _ in range(6000):
        g = np.array([(loss(v + 1e-5 * e) - loss(v - 1e-5 * e)) / 2e-5 for e in np.eye(4)])
        v -= 0.3 * g
        v[:2] = np.minimum(v[:2], 0)
    assert model.weights[[7, 8]] == pytest.approx(v[:2], abs=0.02)
    assert model.thresholds == pytest.approx([v[2], v[2] + np.exp(v[3])], abs=0.02)


def tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows, items):
    out = {}
    for d, t in rows:
        a = shingles(tokens(t))
        for k, u in items:
            b = shingles(tokens(u))
            if k is None or not a or not b:
                continue
            width = min(len(a), len(b))
            for s in range(len(a) - width + 1):
                x, y = Counter(a[s : s + width]), Counter(b)
                common = sum((x & y).values())
                score = common / (width + len(b) - common)
                if score >= 0.8 and (score, s) >= out.get((d, k), (0, 0))[:2]:
                    out[d, k] = (score, s, width)
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 60)))) for k in range(25)]
    items += [(30, items[0][1]), (31, "the cat sat on the mat " * 6), (32, ""), (33, None), (None, "w1 w2"), (34, "ONE two, Three")]
    rows = []
    for d in range(60):
        t = [word() for _ in range(rng.randrange(0, 150))]
        if d % 2:
            u = (items[rng.randrange(25)][1] or "").split()
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(u))
                u[i : i + 1] = rng.choice([["zz"], [], [u[i], "yy"]])
            t[len(t) // 2 : len(t) // 2] = [x.upper() + "," for x in u]
        rows.append((d, " ".join(t)))
    rows += [(60, items[5][1]), (61, items[26][1] + " more"), (62, "one TWO\nthree!"), (63, None), (64, ""), (65, " ".join(items[6][1].split()[1:])), (66, "w1 " * 30_000)]
    frame, bench = docs(spark, rows), spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, n string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.shingles) for r in decontaminate.contaminated(frame, bench).collect()}
    want = brute(rows, items)
    assert got.keys() == want.keys() and len(want) > 20
    for k in want:
        assert got[k] == pytest.approx(want[k])
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    twice = docs(spark, [*rows, rows[60], (None, items[5][1])])
    assert sum(r.doc_id is None for r in decontaminate.contaminated(twice, bench).collect()) == 1
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0


def test_native_main_path(spark):
    """No Python in the plans of the operators that must be native."""
    frame = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    for df in (url_filter.judge_urls(frame, "url", url_filter.rule_table(spark, RULES)), decontaminate.with_simhash(decontaminate.with_shingles(docs(spark, [(1, "a b c")]), "text", 5), "shingles", "fp")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


CLASH = "doc_id long, text string, doc__key long, Key_ string, Rule_ string, rule_verdict string, host_ string, HASH_ long, hot_ long, id string, pieces string, `a.b` int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 777, "k", "r", "v", "h", 5, 6, "i", "p", 8) for i, t in enumerate(texts)], CLASH)


@needs_model
def test_columns_of_clashing_names_stay_as_they_are(spark):
    texts = ["one two three four five six seven", "http://x.com/en/1", "", None]
    frame = clashing(spark, texts)
    own = sorted(map(tuple, frame.collect()))
    bench = spark.createDataFrame([(1, "eight nine ten eleven twelve thirteen")], "item_id long, text string")
    judged = url_filter.judge_urls(frame, "text", url_filter.rule_table(spark, RULES))
    model = quality.OrdinalModel(np.zeros(1 << quality.BITS), np.array([-2.0, -1.0]))
    sharded = sharding.assign_shards(frame, ["doc_id"], ["a", "b"], 7)
    for out in (judged, sharded, decontaminate.drop_contaminated(frame, bench), quality.keep_good(frame, model)):
        assert out.columns[: len(frame.columns)] == frame.columns
        assert sorted(tuple(r)[: len(frame.columns)] for r in out.collect()) == own
    assert {r.doc_id: r.verdict for r in judged.collect()} == {0: "allow", 1: "block", 2: "allow", 3: "allow"}
    coded = sentencepiece.encode(frame, keep=tuple(frame.columns))
    assert coded.columns == ["doc_id", "pieces", "ids", "lossless", *[c for c in frame.columns if c not in ("doc_id", "pieces")]]
    back = sentencepiece.decode(coded)
    assert back.columns == [c for c in coded.columns if c != "text"] + ["text"]
    assert sorted((r.doc_id, r.text) for r in back.collect()) == list(enumerate(texts))
    other = sentencepiece.encode(frame, id_col="Key_")
    assert other.count() == 4 and sentencepiece.encode(frame, id_col="a.b").columns[0] == "a.b"


@needs_model
def test_texts_that_are_not_utf8(spark):
    frame = docs(spark, [(1, "abc def"), (2, ""), (3, None)]).selectExpr("doc_id", "cast(unhex(concat(hex(text), '80FF')) as string) text", "node")
    want = {r.doc_id: r.h for r in frame.selectExpr("doc_id", "hex(text) h").collect()}
    coded = sentencepiece.encode(frame)
    assert {r.doc_id: r.lossless for r in coded.collect()} == {1: True, 2: True, 3: None}
    assert {r.doc_id: r.h for r in sentencepiece.decode(coded).selectExpr("doc_id", "hex(text) h").collect()} == want
    by_bytes = frame.selectExpr("text as doc_id", "node as text")
    assert sentencepiece.encode(by_bytes).count() == 3
    model = quality.OrdinalModel(np.zeros(1 << quality.BITS), np.array([-2.0, -1.0]))
    assert {r.doc_id: r.h for r in quality.keep_good(frame, model).selectExpr("doc_id", "hex(text) h").collect()} == want
    bench = spark.createDataFrame([(1, "abc def")], "item_id long, text string")
    assert decontaminate.drop_contaminated(frame, bench).count() in (2, 3)
    assert licenses.scan(frame, licenses.train()).count() == 0
    assert url_filter.judge_urls(frame, "text", url_filter.rule_table(spark, RULES)).count() == 3
