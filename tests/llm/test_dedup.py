"""Duplicates: SimHash groups, lines, passages and embeddings, against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import embedding_dedup, line_dedup, simhash, substring_dedup
from parlance.llm.common import Block, Scratch, grouped, key_to_id
from parlance.llm.components import components
from parlance.llm.shingles import shingle_hashes, words

DOCS = "doc_id long, text string, lang string, node string, key long"


def classes(items, linked):
    """The smallest reachable item of each."""
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x] = low
                    changed = True
    return root


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        i = rng.randrange(len(w))
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in zip(ids, texts)], DOCS)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    want = classes({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3), edges[0]], "u long, v long"), Scratch(spark)).collect()}
    assert {k: got.get(k, k) for k in want} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def naive_print(text):
    w = [] if text is None else text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(40)]
    texts = base + [edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(120)]
    texts += ["", None, "  \n", "A b", "a B", "a", "É é ß", "a\x0bb\x1cc d e", base[0], "long " * 30_000]
    ids = [*range(len(texts) - 2), None, 500]
    got = simhash.simhash_groups(docs(spark, texts, ids)).collect()
    prints = [naive_print(t) for t in texts]
    root = classes(range(len(texts)), [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {r: min((ids[i] for i in root if root[i] == r and ids[i] is not None), default=None) for r in set(root.values())}
    want = sorted((repr(ids[i]), f"{prints[i]:016x}", least[root[i]]) for i in root)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_splits_hot_shards(spark):
    """One shard with more prints than two blocks hold gives the same groups."""
    rng = random.Random(2)
    center = rng.getrandbits(64)
    prints = list({center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(120)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    entries = spark.createDataFrame([(1, p, p) for p in signed], "key long, node long, fp long")
    links = [(r.u, r.v) for r in simhash.shard_links(entries, 3, Scratch(spark), shard=16).collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    assert classes(signed, links) == classes(signed, near)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    tree, values = simhash.BKTree(), [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ 1 << rng.randrange(64) for v in values[:100]] + values[:3]
    for v in values:
        tree.add(v)
    for v in values[::7]:
        for r in (0, 3, 25):
            assert sorted(tree.search(v, r)) == sorted(((v ^ x).bit_count(), i) for i, x in enumerate(values) if (v ^ x).bit_count() <= r)


def similarity(a, b):
    x, y = (set(shingle_hashes(words(t.encode()), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(4)
    base = [prose(rng, 150) for _ in range(30)]
    texts = list(base)
    for t in base[:20]:
        texts += [edited(rng, t, 2), t.upper(), t]
    texts += [edited(rng, base[25], 40), "", None, "one two", "ONE  two"]
    ids = [*range(len(texts))]
    texts += [base[3], "null id", "null id", base[4]]
    ids += [3, None, None, None]
    rows = simhash.drop_near_duplicates(docs(spark, texts, ids)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "node", "key"}
    kept = sorted(repr(r.doc_id) for r in rows)
    assert kept == sorted(map(repr, [*range(30), 90, 91, 93, None]))
    assert similarity(base[25], texts[90]) < 0.8
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_units_of_unlike_texts_with_like_prints():
    """Texts of one unit whose prints say nothing: links are exactly those that join what is alike."""
    rng = random.Random(26)
    base = [prose(rng, 40) for _ in range(6)]
    texts = base + [edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(30)] + ["", " "]
    rows = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["key", "node", "fp", "comp", "text"])
    got = [x for b in simhash._verify_units(5, 0.8, 3)(iter([rows.slice(0, 10), rows.slice(10)])) for x in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
    want = [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(texts[i], texts[j]) >= 0.8]
    assert set(map(lambda x: tuple(sorted(x)), got)) <= set(want) and classes(range(len(texts)), got) == classes(range(len(texts)), want)


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = prose(rng, 120)
    texts = [base] + [edited(rng, base, 1) for _ in range(700)] + [prose(rng, 120) for _ in range(20)]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect())
    assert kept == [0, *range(701, 721)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(7)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(10)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        k = rng.randrange(4)
        assert line_dedup.within(a, "".join(b), k) == (distance(a, "".join(b)) <= k)


def test_line_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 4)
    monkeypatch.setattr(line_dedup, "BLOCK", 6)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(21, 40))).strip().ljust(21, "z") for _ in range(12)]
    base.append("an item with the number 0000 in it")
    lines = list(base)
    for _ in range(150):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(x))
            x[i : i + rng.randrange(2)] = rng.choice(["", "q", "é"])
        lines.append("".join(x))
    lines += ["short", "shart", "short", "", "   ", "\t short ", "nine char", "nine chan", "ten chars!", "ten chars?", "ten chars!!", "ten chars", "nineteen characters", "nineteen charakterz", "nineteen charakters"] + [f"an item with the number {i:04d} in it" for i in range(0, 60, 3)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + ["", None, "\n\n", "tail\n" + "x" * 50_000]
    flat = [(d, n, s.strip(line_dedup.SPACE)) for d, t in enumerate(texts) for n, s in enumerate((t or "").split("\n")) if s.strip(line_dedup.SPACE)]
    at = range(len(flat))

    def alike(a, b):
        return a == b or abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, len(a) // 10, len(b) // 10)

    root = classes(at, [(i, j) for i, j in combinations(at, 2) if alike(flat[i][2], flat[j][2])])
    size = {r: sum(root[i] == r for i in at) for r in set(root.values())}
    want = {(flat[i][0], flat[i][1], *flat[root[i]][:2], size[root[i]], root[i] == i) for i in at}
    got = {(r.doc_id, r.line_no, r.class_doc, r.class_line, r.class_size, r.kept) for r in line_dedup.line_report(docs(spark, texts)).collect()}
    assert got == want
    assert line_dedup.line_report(docs(spark, [])).count() == 0


def test_repeated_lines_are_cut(spark):
    one, two = "the first of these lines is here", "another line, quite unlike others"
    texts = [f"{one}\n{two}", f"{one}!\n\nnew text that stands alone", None, "", f"{one}\n{two}", f"new words, many more of them than were seen before\n{one}"]
    frame = docs(spark, texts, [0, 1, 2, 3, 4, None])
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert got[0].text == texts[0] and got[1].text == "\nnew text that stands alone" and got[2].text is None and got[3].text == "" and got[4].text == ""
    assert got[None].text == "new words, many more of them than were seen before" and got[0].node == "clash"
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame, leave_above=0.6).collect()}
    assert left[4] == texts[4] and left[1] == got[1].text
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_sliding_minima_and_windows():
    rng = np.random.default_rng(9)
    for n, width in ((50, 7), (200, 20), (19, 20), (20, 20), (64, 1)):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        at = np.unique(substring_dedup.sliding_minima(h, width))
        assert at.tolist() == sorted({i + int(h[i : i + width].argmin()) for i in range(n - width + 1)})
        left, right = substring_dedup.compact_windows(h, 0, n, at)
        for c, lo, hi in zip(at, left, right):
            a = c
            while a and h[a - 1] > h[c]:
                a -= 1
            b = c
            while b + 1 < n and h[b + 1] > h[c]:
                b += 1
            assert (lo, hi) == (a, b) and hi - lo + 1 >= width


def test_repeated_passages(spark):
    rng = random.Random(10)
    passage, other = prose(rng, 70), prose(rng, 55)
    texts = [prose(rng, 100) for _ in range(30)]
    for d in (3, 8, 11):
        texts[d] = f"{prose(rng, 40 + d)} {passage} {prose(rng, 30)}"
    texts[14] = f"{prose(rng, 9)} {edited(rng, passage, 1)} {prose(rng, 77)}"
    texts[5], texts[6] = f"{other} {prose(rng, 500)}", f"{prose(rng, 20)} {other}"
    texts[20] = f"{passage[:100]} {prose(rng, 60)}"
    texts[21] = texts[22] = prose(rng, 90)
    inner = prose(rng, 60)
    texts[23] = f"{inner} {prose(rng, 30)} {inner}"
    texts += ["", None, "few words"]
    got = substring_dedup.passage_report(docs(spark, texts)).collect()
    spans = {(r.doc_id, r.source_doc_id): r for r in got}
    assert set(spans) == {(8, 3), (11, 3), (14, 3), (6, 5), (22, 21), (23, 23)}
    for (doc, source), r in spans.items():
        a, b = texts[doc].split()[r.first_word : r.end_word], texts[source].split()[r.source_first_word : r.source_end_word]
        assert similarity(" ".join(a), " ".join(b)) == pytest.approx(r.similarity) and r.similarity >= 0.8 and len(a) >= 50
    assert spans[8, 3].end_word - spans[8, 3].first_word == 70 and spans[6, 5].end_word == 75
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeated_passages(docs(spark, texts)).collect()}
    assert passage not in cut[8] and passage in cut[3] and cut[0] == texts[0] and cut[22] == "" and cut[31] is None
    assert len(cut[8].split()) == len(texts[8].split()) - 70
    assert substring_dedup.passage_report(docs(spark, [])).count() == 0


def test_embedding_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 20)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 64))
    rows = [(i, base[i % 30] + rng.normal(size=64) * 0.02 * (1 + i % 8), i % 2) for i in range(150)]
    rows += [(150 + i, base[0] + rng.normal(size=64) * 0.07, 0) for i in range(80)]
    rows = [(i, v.astype(np.float32).tolist(), k) for i, v, k in rows]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 64, 0), (303, rows[0][1], None), (304, [None] + [1.0] * 63, 0), (305, [float("nan")] + [1.0] * 63, 0)]
    odd += [(306, [float("inf")] + [1.0] * 63, 0), (307, rows[0][1], 0), (308, rows[0][1], 1), (309, [1.0, 2.0], 0), (310, [2.0, 4.0], 0), (311, rows[0][1] + [0.0], 0)]
    every = rows + odd
    good = [(i, np.array(v, np.float64), k) for i, v, k in every if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and k is not None]
    links = [(a[0], b[0]) for a, b in combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    root = classes([r[0] for r in every], links)
    want = {i: (sum(i in x for x in links), root[i], root[i] == i) for i in root}
    frame = spark.createDataFrame([(i, v, k, "clash") for i, v, k in every], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(frame).collect()}
    assert got == want and len(links) > 500
    assert embedding_dedup.embedding_groups(frame.limit(0)).count() == 0


def test_narrow_and_extreme_vectors_equal_brute_force(spark):
    """No link is lost in few dimensions, nor where squares of the components overflow or vanish."""
    rng = np.random.default_rng(23)
    rows = []
    for width, n in ((1, 6), (2, 60), (3, 120), (4, 120), (16, 60)):
        base = rng.normal(size=(n, width))
        rows += [(v * 10.0 ** rng.integers(-3, 3)).tolist() for x in base for v in (x, x + rng.normal(size=width) * np.linalg.norm(x) * 0.19 / np.sqrt(width))]
    rows += [[1e300, 1e300], [1.1e300, 1e300], [5e-324, 5e-324], [1e-320, 1.05e-320], [1e308] * 3, [-1e308, 1e308, 1e308]]
    unit = []
    for v in rows:
        x = np.array(v) / np.abs(v).max()
        unit.append(x / np.sqrt(x @ x))
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.98]
    close = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(rows[i]) == len(rows[j]) and abs(unit[i] @ unit[j] - 0.98) < 1e-9]
    assert not close and len(links) > 300
    root = classes(range(len(rows)), links)
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(frame).collect()}
    assert got == {i: (sum(i in x for x in links), root[i]) for i in root}


def test_embeddings_without_ids(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.001], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(frame).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("None", 0, None, False), ("None", 2, 5, False)]


def test_forest_leaves_nothing_unsaid():
    """Where links may prove false, those that were left out are told; what is joined already is not linked again."""
    prints = np.array([0b0, 0b11111, 0b1111111], np.int64)
    links, left = simhash.forest(prints, 8)
    assert links == [(0, 1), (1, 2)] and (left == -1).all()
    links, left = simhash.forest(prints, 8, sure=False)
    assert links == [(0, 1), (1, 2)] and len(set(left.tolist())) == 1 and left[0] >= 0
    links, left = simhash.forest(prints, 8, np.array([5, 5, 9]), sure=False)
    assert links == [(1, 2)] and (left >= 0).all()
    assert simhash.partners(prints, 2, np.array([0, 1, 2])).tolist() == [1, 2]
    assert simhash.partners(prints, 8, np.array([3, 3, 3])).tolist() == []


@pytest.mark.parametrize("trees", (10**6, 0))
def test_false_links_hide_no_true_ones(spark, monkeypatch, trees):
    """Of links that prove true or false by chance, the two rounds give the components of all true ones, in hot shards too."""
    monkeypatch.setattr(simhash, "MOST_TREES", trees)
    rng = random.Random(20)
    centers = [rng.getrandbits(63) for _ in range(6)]
    entries, near = [], []
    for key, size in enumerate((3, 9, 15, 16, 17, 130)):
        prints = sorted({centers[key] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(7))) for _ in range(size)})
        entries += [(key, p, p) for p in prints]
        near += [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 8]
    is_true = lambda a, b: (min(a, b) * 31 + max(a, b) * 17) % 1009 < 70
    udf = F.udf(is_true, "boolean")

    def units(frame):
        of = {}
        for r in frame.collect():
            of.setdefault(r.key, {})[r.node] = r.comp
        assert max(map(len, of.values())) <= 32
        pairs = {(a, b) for members in of.values() for a, b in combinations(sorted(members), 2) if members[a] != members[b] and (a ^ b).bit_count() <= 8 and is_true(a, b)}
        return spark.createDataFrame(sorted(pairs), "u long, v long")

    nodes = sorted({p for _, p, _ in entries})
    frame = spark.createDataFrame(entries, "key long, node long, fp long").repartition(3)
    links = [(r.u, r.v) for r in simhash.shard_links(frame, 8, Scratch(spark), shard=16, confirm=(lambda x: x.where(udf("u", "v")), units)).collect()]
    assert all(is_true(*x) for x in links)
    assert classes(nodes, links) == classes(nodes, [x for x in near if is_true(*x)])


def test_blocks_keep_to_the_limit_across_batches(spark):
    """A hot group that goes on in the next batch is cut like any other, and all its prints are linked."""
    key = np.repeat(np.array([1, 2, 3]), [40, 900, 5])
    for step in (33, 100, 300, 950):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(np.arange(len(key))[i : i + step])], names=["key", "node"]) for i in range(0, len(key), step)]
        got = [b for b in grouped(iter(batches), "key", 64) if isinstance(b, Block)]
        assert [b.number for b in got] == list(range(15)) and [b.last for b in got] == [False] * 14 + [True]
        assert max(len(b.cols["node"]) for b in got) <= 64
        assert np.concatenate([b.cols["node"] for b in got]).tolist() == list(range(40, 940))
    rng = random.Random(12)
    center = rng.getrandbits(63)
    prints = list({center ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(9))) for _ in range(400)})
    # The key after the hot one closes its group in the middle of a batch.
    entries = [(k, p, p) for k, some in ((1, prints), *((k, prints[:2]) for k in range(2, 60))) for p in some]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        links = [(r.u, r.v) for r in simhash.shard_links(spark.createDataFrame(entries, "key long, node long, fp long").coalesce(1), 3, Scratch(spark), shard=16).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    assert classes(prints, links) == classes(prints, near)


def brute_passages(texts, least=46):
    """For each pair of documents, the places of runs of ``least`` shingles that both have, by comparing all of them."""
    rows = [shingle_hashes(words((t or "").encode()), 5).tolist() if len((t or "").split()) >= 5 else [] for t in texts]
    at = {}
    for d, h in enumerate(rows):
        for i in range(len(h) - least + 1):
            at.setdefault(tuple(h[i : i + least]), []).append((d, i))
    return {(d, i, j) for some in at.values() for d, i in some for j, _ in some if j < d}


def test_exact_passages_equal_brute_force(spark):
    """Every word of a passage that an earlier document has too is in a span found; nothing else is."""
    rng = random.Random(24)
    pool = [prose(rng, n) for n in (50, 55, 60, 90, 150)]
    texts = []
    for _ in range(80):
        parts = [prose(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool).split()
            k = rng.randrange(0, 12) if rng.random() < 0.3 else 0
            parts += [" ".join(p[k:]), prose(rng, rng.randrange(5, 40))]
        texts.append(" ".join(parts))
    want = {}
    for d, i, _ in brute_passages(texts):
        want.setdefault(d, set()).update(range(i, i + 50))
    got = {}
    for r in substring_dedup.passage_report(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
        assert similarity(" ".join(texts[r.doc_id].split()[r.first_word : r.end_word]), " ".join(texts[r.source_doc_id].split()[r.source_first_word : r.source_end_word])) >= 0.8
    all_, found = sum(map(len, want.values())), sum(len(want[d] & got.get(d, set())) for d in want)
    assert all_ > 2000 and found >= 0.97 * all_, f"{found} of {all_}"
    assert sum(len(s - want.get(d, set())) for d, s in got.items()) < 0.2 * all_


@pytest.mark.parametrize("group", (256, 8))
def test_a_first_document_that_quotes_hides_no_copies(spark, monkeypatch, group):
    """An earlier document has only runs of 20 words of a passage of 60 that two later ones share; and a phrase that all have."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rng = random.Random(25)
    texts, want = [], set()
    phrase = prose(rng, 18)
    for _ in range(100):
        p = prose(rng, 60).split()
        quotes = " ".join(f"{' '.join(p[k : k + 20])} {prose(rng, 30)}" for k in (0, 20, 40))
        n = len(texts)
        texts += [f"{prose(rng, 30)} {quotes}", f"{prose(rng, 40)} {phrase} {' '.join(p)} {prose(rng, 40)}", f"{prose(rng, 30)} {phrase} {' '.join(p)} {prose(rng, 50)}"]
        want.add((n + 2, n + 1))
    got = {(r.doc_id, r.source_doc_id) for r in substring_dedup.passage_report(docs(spark, texts)).collect()}
    assert len(want & got) >= 97 and not got - want


def test_copies_in_far_blocks_of_a_large_group_meet(spark):
    """One minimum with the same twelve shingles to either side in 300 documents; what else is around it two each have, 150 places apart."""
    rng = np.random.default_rng(31)
    around = rng.integers(1, 1 << 16, (150, 91)).astype(np.uint16)
    around[:, 33:58] = np.arange(1, 26)
    rows = [(7, d, 100 << 32 | 45 << 15 | 45, around[d % 150].tobytes()) for d in range(300)]
    rows += [(8, d, 100 << 32 | 45 << 15 | 45, around[d].tobytes()) for d in range(50)]
    frame = spark.createDataFrame(rows, "key long, doc long, spot long, around binary").repartition(5)
    got = substring_dedup._compared(frame, Scratch(spark), 46, 16).collect()
    assert sorted((r.key, r.doc, r.other) for r in got) == [(7, d, d + 150) for d in range(150)]


def test_an_index_of_surroundings_finds_what_all_pairs_do():
    """Rows with 23 shingles in common, some with a few more, and long runs of one shingle: each that is alike an earlier one finds one."""
    rng = np.random.default_rng(33)
    around = rng.integers(1, 1 << 16, (600, 91)).astype(np.uint16)
    around[:, 34:57] = np.arange(1, 24)
    for i in range(300, 600):
        near, n = rng.integers(300), rng.integers(9)
        around[i, 57 : 57 + n] = around[near, 57 : 57 + n]
        if i % 10 == 0:
            around[i, 20:60], around[i, :3] = 40 + i % 3, 0
    doc = np.sort(rng.integers(0, 590, 600))
    cols = {"doc": doc, "spot": (100 + np.arange(600) * 5) << 32, "around": around}
    place, want = cols["spot"] >> 32, {}
    for i in range(600):
        far = np.flatnonzero((doc[:i] != doc[i]) | (place[i] - place[:i] >= 46))
        alike = far[substring_dedup._alike(around, far, np.full(len(far), i), 46)]
        if len(alike):
            want[i] = set(alike.tolist())
    hits = [(i, j) for i, s in want.items() for j in s if j != min(s)]
    assert 100 < len(want) < 500 and hits
    for got in (substring_dedup._first_by_index(cols, np.arange(600), 46), substring_dedup._first_alike(cols, np.arange(600), 46)):
        assert dict(zip(*(x.tolist() for x in got), strict=True)) == {i: min(s) for i, s in want.items()}
    got = dict(zip(*(x.tolist() for x in substring_dedup._earlier_alike(cols, np.arange(600), 46)), strict=True))
    assert set(got) == set(want) and all(j in want[i] for i, j in got.items())
    x, y = (rng.integers(1, 300, (200, 91)).astype(np.uint16) for _ in range(2))
    both, k = np.concatenate([x, y]), np.arange(200)
    hit = [[v in set(a.tolist()) for v in b.tolist()] for a, b in zip(x, y, strict=True)]
    assert substring_dedup._alike(both, k, k + 200, 46).tolist() == [max(sum(h[i : i + 46]) for i in range(46)) >= 28 for h in hit]


def test_spots_of_repeated_words_are_thinned_but_cover_all():
    """Within a long run of a word some minima stand for all; near its ends, and where nothing repeats, each is kept."""
    rng = random.Random(32)
    texts = [f"{prose(rng, 100)} {' '.join(['same'] * 600)} {prose(rng, 100)}", prose(rng, 300), " ".join(["one two"] * 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([t.encode() for t in texts])], names=["doc", "text"])
    got = next(substring_dedup._windows(5, 46)(iter([batch]))).to_pydict()
    for doc, text in enumerate(texts):
        h = substring_dedup.sequence(text.encode())
        for k in range(substring_dedup.HASHES):
            mixed = substring_dedup.mix(h ^ np.uint64(k * 0xD1342543DE82EF95 & (2**64 - 1)))
            all_ = substring_dedup.sliding_minima(mixed, 46).tolist()
            mine = [(s >> 32) for d, s in zip(got["doc"], got["spot"], strict=True) if d == doc and s >> 30 & 3 == k]
            around = lambda p: h[max(0, p - 45) : p + 46].tolist()
            assert set(mine) <= set(all_) and (doc != 1 or mine == all_) and (doc == 1 or len(mine) < len(all_) / 2)
            for p in set(all_) - set(mine):
                assert any(abs(p - q) <= 9 and around(p) == around(q) for q in mine)


def test_short_passages_near_the_similarity_are_found(spark):
    """Passages of 54 words of which one is changed: one shared minimum is enough to compare two documents."""
    rng = random.Random(13)
    texts = []
    for _ in range(200):
        passage = prose(rng, 54).split()
        other = [*passage[:26], "changed", *passage[27:]]
        assert 0.8 <= similarity(" ".join(passage), " ".join(other)) < 0.83
        texts += [f"{prose(rng, 200)} {' '.join(p)} {prose(rng, 200)}" for p in (passage, other)]
    got = {(r.doc_id, r.source_doc_id) for r in substring_dedup.passage_report(docs(spark, texts)).collect()}
    missed = {(i + 1, i) for i in range(0, 400, 2)} - got
    assert not missed, f"{len(missed)} of 200"


def test_passages_with_words_inserted_are_found_whole(spark):
    """Neither half of a passage of 90 words is long enough alone; with 7 or 12 words between them the whole is alike."""
    rng = random.Random(14)
    texts = []
    for i in range(40):
        passage = prose(rng, 90).split()
        other = [*passage[:45], *prose(rng, (7, 12)[i % 2]).split(), *passage[45:]]
        assert similarity(" ".join(passage), " ".join(other)) >= 0.8
        texts += [f"{prose(rng, 60)} {' '.join(p)} {prose(rng, 60)}" for p in (passage, other)]
    got = {(r.doc_id, r.source_doc_id): r for r in substring_dedup.passage_report(docs(spark, texts)).collect()}
    missed = {(i + 1, i) for i in range(0, 80, 2)} - set(got)
    assert not missed, f"{len(missed)} of 40"
    assert all(r.end_word - r.first_word >= 97 and r.similarity >= 0.8 for r in got.values())


CLASH = "doc_id long, text string, doc__key long, Key_ string, hash_ long, RANK_ int, gone_ int, `a.b` int, spans_ int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 777 + i, "k", 5, 6, 7, 8, 9) for i, t in enumerate(texts)], CLASH)


def test_columns_of_clashing_names_stay_as_they_are(spark):
    rng = random.Random(21)
    texts = [f"{prose(rng, 60)}\n{prose(rng, 20)}" for _ in range(3)]
    for drop in (simhash.drop_near_duplicates, line_dedup.drop_repeated_lines, substring_dedup.drop_repeated_passages):
        frame = clashing(spark, texts)
        got = sorted(drop(frame).collect(), key=lambda r: r.doc_id)
        assert got == sorted(frame.collect(), key=lambda r: r.doc_id)
        twice = drop(clashing(spark, [*texts, texts[0]])).columns
        assert twice == frame.columns


def test_texts_that_are_not_utf8(spark):
    """Bytes 80 FF in a string: nothing crashes, and untouched texts keep their bytes."""
    raw = "unhex(concat('80FF', hex(text)))"
    rng = random.Random(22)
    frame = docs(spark, [prose(rng, 60), prose(rng, 70), "", None]).withColumn("text", F.expr(f"if(text is null, null, cast({raw} as string))"))
    want = sorted(((r.doc_id, r.h) for r in frame.selectExpr("doc_id", "hex(text) h").collect()), key=repr)
    for drop in (simhash.drop_near_duplicates, line_dedup.drop_repeated_lines, substring_dedup.drop_repeated_passages):
        assert sorted(((r.doc_id, r.h) for r in drop(frame).selectExpr("doc_id", "hex(text) h").collect()), key=repr) == want
    assert simhash.simhash_groups(frame).count() == 4
    again = frame.unionAll(frame.selectExpr("doc_id + 10", "text", "lang", "node", "key"))
    cut = substring_dedup.drop_repeated_passages(again).selectExpr("doc_id", "hex(text) h").collect()
    assert {r.doc_id: r.h for r in cut}[10] == ""
