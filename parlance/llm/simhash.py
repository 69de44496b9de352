"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A BK-tree holds fingerprints whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius of
the distance found.  The trees' shards are groups of fingerprints that can be
near each other.  All trees together grow with the corpus, so a shard's tree is
dealt to its task by the shuffle, with the fingerprints that search it.  Of a
shard above ``SHARD`` one block makes a tree of bounded size, which is
broadcast while all such trees keep to a bound, and every other block searches
it.  What is not yet connected then meets all the rest in a second round, as
pairs of blocks; no case is dropped.  Shards give forests of links, not all
pairs, and the components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Block, Scratch, block_pairs, doc_key, free_names, grouped, longs, mix, names_of, record, slices, text_bytes
from .components import components
from .rotations import corner, rotate
from .shingles import fingerprints, pack_bits, shingle_hashes, votes, words

#: Fingerprints in a block; a unit has two blocks at most.
SHARD = 512
#: Fingerprints in hot shards' trees, 16 bytes each, that are broadcast; more are joined by shuffle.
MOST_TREES = 500_000
#: For groups by similarity: variants of the hashes (64 votes each), rotations of the votes, and the radius in 64 bits.
VARIANTS, TABLES, RADIUS = 4, 24, 20
#: Documents that are broadcast by their keys, 8 bytes each, to find their texts; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Documents that one task compares with a hub.
FAN = 512


class BKTree:
    """Distinct 64-bit fingerprints by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, place) of all values within the radius."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        """Adds a value; one that is there already is added below its equal's nearest place."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                return
            at = child


class Sets:
    """Sets of numbers that are joined."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def _near(prints: np.ndarray, radius: int, group: np.ndarray) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """The prints outside the largest group, and for each (distance, place) of what is within the radius in other groups.

    Each pair is told once: by the later of two such prints, or by the one
    that is outside the largest group.  Only these prints are in the tree.
    """
    sizes = np.bincount(group, minlength=1)
    big = int(sizes.argmax()) if sizes.max() > 1 else -1
    values, of = prints.view(np.uint64).tolist(), group.tolist()
    inside = np.flatnonzero(group != big).tolist()
    tree, near = BKTree(), []
    for i in inside:
        near.append([(d, inside[k]) for d, k in tree.search(values[i], radius) if of[inside[k]] != of[i]])
        tree.add(values[i])
    if inside:
        for i in np.flatnonzero(group == big).tolist():
            for d, k in tree.search(values[i], radius):
                near[k].append((d, i))
    return inside, near


def forest(prints: np.ndarray, radius: int, groups: np.ndarray | None = None, sure: bool = True) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) of prints within the radius, and a number for each print's group if links were left out there, else -1.

    ``groups`` says what is joined already (nothing by default).  Each print is
    linked to its nearest one of every other group, joined by links so far.
    That is enough where every link is true.  If links may prove false (not
    ``sure``), what a print has beyond its nearest ones is left for later.
    """
    n = len(prints)
    mine = np.arange(n) if groups is None else np.unique(groups, return_inverse=True)[1]
    group, sets, out, over = mine.tolist(), Sets(n), [], []
    for i, found in zip(*_near(prints, radius, mine), strict=True):
        got: set[int] = set()
        more = False
        for _, j in sorted(found):
            other = sets.root(group[j])
            if other in got or sure and other == sets.root(group[i]):
                more = True
                continue
            got.add(other)
            out.append((i, j) if i < j else (j, i))
        for other in got:
            sets.join(group[i], other)
        if more and not sure:
            over.append(group[i])
    left = np.full(n, -1, np.int64)
    if over:
        roots = np.array([sets.root(g) for g in range(n)])
        left = np.where(np.isin(roots, roots[over]), roots, -1)[mine]
    return out, left


def partners(prints: np.ndarray, radius: int, groups: np.ndarray) -> np.ndarray:
    """The places of prints that are within the radius of one of another group."""
    mine = np.unique(groups, return_inverse=True)[1]
    out = np.zeros(len(prints), bool)
    for i, found in zip(*_near(prints, radius, mine), strict=True):
        out[i] |= bool(found)
        out[[j for _, j in found]] = True
    return np.flatnonzero(out)


def block_keys(fp: str, radius: int) -> Column:
    """Keys of which two 64-bit values within the radius share one at least.

    Of radius + 2 blocks of bits, at most ``radius`` differ, so two blocks
    agree: there is a key for every two blocks, with all their bits.
    """
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    keys = [F.xxhash64(F.lit(k), block(i), block(j)) for k, (i, j) in enumerate(combinations(range(n), 2))]
    return F.array(*keys)


#: Kind 0 is a link (node, other), 1 a member of a hot shard's block, 2 a hot shard's numbers of blocks, 4 a member of a group with links left.
_LINKS = "kind int, key long, block int, blocks int, lead int, node long, fp long, comp long, other long"
_NARROW = ("kind", "block", "blocks", "lead")


def _out(kind: int, **cols: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    zero = np.zeros(n, np.int64)
    got = {"kind": np.full(n, kind)} | {k: cols.get(k, zero) for k in ("key", "block", "blocks", "lead", "node", "fp", "comp", "other")}
    return record(**{k: pa.array(v, pa.int32() if k in _NARROW else pa.int64()) for k, v in got.items()})


def _link_shards(radius: int, limit: int, mode: str, final: bool = False):
    """Rows sorted by key, with what is outside the key's largest group first: links, and what is left (``_LINKS``).

    ``mode`` is sure for links that are all true, nearest for those that may
    prove false, where the members of groups with links left out are given too,
    or partners for the members that have a print of another group within the
    radius, and no links.  In the ``final`` pass a shard above the limit is an
    error, as nothing would link its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = 0
        for g in grouped(batches, "key", limit):
            node, fp = g.cols["node"], g.cols["fp"]
            comp = g.cols.get("comp", node)
            if isinstance(g, Block):
                if final:
                    raise ValueError(f"a unit of blocks holds more than {limit} prints")
                n = len(node)
                if not g.number:
                    lead = 0
                lead += not g.cols["most"].all() if "most" in g.cols else 1
                yield _out(1, key=np.full(n, g.key), block=np.full(n, g.number), node=node, fp=fp, comp=comp)
                if g.last:
                    yield _out(2, key=np.array([g.key]), blocks=np.array([g.number + 1]), lead=np.array([lead]))
                continue
            two = g.starts[g.sizes == 2]
            near = two[(np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius) & (comp[two] != comp[two + 1])]
            if mode == "partners":
                a, b, rest, names = [], [], [near, near + 1], [g.cols["key"][near]] * 2
            else:
                a, b, rest, names = [near], [near + 1], [], []
            for k in np.flatnonzero(g.sizes > 2):
                begin, end = g.starts[k], g.ends[k]
                if mode == "partners":
                    some = partners(fp[begin:end], radius, comp[begin:end])
                    rest.append(some + begin)
                    names.append(np.full(len(some), g.cols["key"][begin]))
                    continue
                found, left = forest(fp[begin:end], radius, comp[begin:end], mode == "sure")
                if found:
                    pairs = np.array(found) + begin
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
                some = np.flatnonzero(left >= 0)
                if len(some):
                    rest.append(some + begin)
                    names.append(mix(g.cols["key"][begin].astype(np.uint64) ^ mix(left[some].astype(np.uint64))).view(np.int64))
            if a and len(first := np.concatenate(a)):
                yield _out(0, node=node[first], other=node[np.concatenate(b)])
            if rest and len(at := np.concatenate(rest)):
                yield _out(4, key=np.concatenate(names), node=node[at], fp=fp[at], comp=comp[at])

    return run


def _search_trees(radius: int):
    """(u, v) of a block's members and the tree's that are nearest to them, one of each group of the tree's.

    Rows have the block's and the tree's members, as lists of (node, fp).
    """

    def lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat, offsets = column.values, column.offsets.to_numpy()
        node, fp = longs(flat.field("node")), longs(flat.field("fp"))
        for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
            yield node[begin:end], fp[begin:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        for batch in batches:
            u, v = [], []
            for key, (members, prints), (nodes, own) in zip(batch.column("key").to_pylist(), lists(batch.column("members")), lists(batch.column("tree")), strict=True):
                if not known or known[0] != key:
                    tree, sets = BKTree(), Sets(len(own))
                    for value in own.view(np.uint64).tolist():
                        tree.add(value)
                    for i, j in forest(own, radius)[0]:
                        sets.join(i, j)
                    known = (key, tree, sets, dict(zip(nodes.tolist(), range(len(nodes)), strict=True)))
                _, tree, sets, place = known
                for node, value in zip(members.tolist(), prints.view(np.uint64).tolist(), strict=True):
                    at, got = place.get(node, len(own)), set()
                    for _, j in sorted(tree.search(value, radius)):
                        if j < at and sets.root(j) not in got:
                            got.add(sets.root(j))
                            u.append(node)
                            v.append(int(nodes[j]))
            yield record(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))

    return run


def _tree_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links of hot shards' members with those of their first block, whose trees are broadcast if there are few."""
    packed = hot.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("members"))
    trees = packed.where("block = 0").select("key", F.col("members").alias("tree"))
    few = hot.where("block = 0").limit(MOST_TREES + 1).count() <= MOST_TREES
    return packed.join(F.broadcast(trees) if few else trees, "key").select("key", "members", "tree").mapInArrow(_search_trees(radius), "u long, v long")


def _proposed(found: DataFrame) -> DataFrame:
    return found.where("kind = 0").select(F.col("node").alias("u"), F.col("other").alias("v"))


def shard_links(entries: DataFrame, radius: int, scratch: Scratch, shard: int = SHARD, confirm: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Links (u, v) whose components join all nodes which share a key, are within the radius, and prove true.

    ``entries`` has key, node and fp (long, without nulls).  By default all
    links are true.  Otherwise the first function of ``confirm`` takes distinct
    links and gives the true ones; the second takes units (key, node, fp, comp)
    of up to ``2 * shard`` nodes, and gives true links that join all which the
    unit's pairs within the radius do.

    The first round links each print to its nearest one in a shard, or in a
    hot shard to the nearest in the tree of its first block.  In proportion to
    the nodes, that joins nearly all there is.  The second round takes groups
    where links were left out, and of hot shards what is outside the largest
    component with all the rest, as far as there is a print of another
    component within the radius; so no link hides another.
    """
    dealt = entries.repartition("key").sortWithinPartitions("key", "node")
    found = scratch.table(dealt.mapInArrow(_link_shards(radius, shard, "nearest" if confirm else "sure"), _LINKS))
    proposed = _proposed(found)
    if found.where("kind = 2").limit(1).count():
        proposed = proposed.unionAll(_tree_links(found.where("kind = 1"), radius))
    distinct = proposed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    true = scratch.table(confirm[0](distinct) if confirm else distinct)
    left = found.where("kind in (1, 4)").select("key", "node", "fp")
    if not left.limit(1).count():
        return true
    members = left.join(components(true, scratch), "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("comp"))
    members = scratch.table(members)
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("most.comp").alias("largest"))
    rows = members.join(largest, "key").select("key", (F.col("comp") == F.col("largest")).cast("int").alias("most"), "node", "fp", "comp")
    mode = "partners" if confirm else "sure"
    again = scratch.table(rows.repartition("key").sortWithinPartitions("key", "most", "node").mapInArrow(_link_shards(radius, shard, mode), _LINKS))
    if again.where("kind = 2").limit(1).count():
        units = block_pairs(again.where("kind = 1").select("key", "block", "node", "fp", "comp"), again.where("kind = 2").select("key", "blocks", "lead"))
        units = units.select(F.col("unit").alias("key"), "node", "fp", "comp").repartition("key").sortWithinPartitions("key", "node")
        again = again.where("kind in (0, 4)").unionAll(units.mapInArrow(_link_shards(radius, 2 * shard, mode, final=True), _LINKS))
    scratch.drop(found, members)
    return true.unionAll(confirm[1](again.where("kind = 4").select("key", "node", "fp", "comp")) if confirm else _proposed(again))


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) for each row; a null text has no words, and no words give fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = [shingle_hashes(words(t), shingle) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprints(hashes))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(id, fingerprint, component_id) of each row: groups of fingerprints linked within the radius.

    ``component_id`` is the smallest id that links reach.  The result is exact:
    :func:`block_keys` brings any two fingerprints within the radius together.
    Texts without words, null ones too, have fingerprint zero and are linked
    like any other.  Rows with a null id are grouped, but name no group unless
    all of it are such, which gives a null component.  Repeated rows stay, in
    one group.  Other columns don't matter; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.table(fingerprint_rows(df, id_col, text_col, shingle))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("id"))
    entries = distinct.select(F.explode(block_keys("fp", radius)).alias("key"), F.col("fp").alias("node"), "fp")
    roots = components(shard_links(entries, radius, scratch, shard), scratch)
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = placed.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity of shingles -------------------------------------------


def _signatures(shingle: int):
    """key (document), node (hash of all words), fp, and a shard key for each rotation of the votes.

    A key names the two strongest directions of the rotated votes, one in each
    half, so near texts share many keys while the shards stay small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                parts = [words(t) for t in part.column("text").to_pylist()]
                whole = np.array([_text_hash(p) for p in parts], np.int64)
                hashes = [shingle_hashes(p, shingle) for p in parts]
                n = np.array([len(h) for h in hashes], np.int64)[:, None]
                lean = (2 * votes(hashes, VARIANTS) - n).astype(np.float64)
                fp = pack_bits(lean[:, :64] > 0)
                keys = np.empty((len(parts), TABLES), np.int64)
                half = lean.shape[1] // 2
                for t in range(TABLES):
                    r = rotate(lean, 7919 + t, 1) if t else lean
                    code = corner(r[:, :half]) * (2 * half) + corner(r[:, half:])
                    keys[:, t] = mix((code + t * (1 << 32)).astype(np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * TABLES, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(whole), pa.array(fp), lists], names=["doc", "node", "fp", "keys"])

    return run


def _text_hash(parts: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(parts), digest_size=8).digest(), "little", signed=True)


def _verify(shingle: int, similarity: float):
    """Streams rows sorted by (hub, part, member): a hub's own row comes first, its members are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                hub, salt, member, node = (longs(part.column(c)) for c in ("hub", "part", "member", "node"))
                out: list[tuple[int, int]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    if not member[i]:
                        at, own = (hub[i], salt[i]), np.unique(shingle_hashes(words(text), shingle))
                        continue
                    if at != (hub[i], salt[i]):
                        raise ValueError("a member came before its hub")
                    # The smaller set bounds the similarity, and the number of words bounds the set.
                    parts = words(text)
                    if max(1, len(parts) - shingle + 1) < similarity * len(own):
                        continue
                    got = np.unique(shingle_hashes(parts, shingle))
                    common = len(np.intersect1d(got, own, assume_unique=True))
                    union = len(got) + len(own) - common
                    if not union or common >= similarity * union:
                        out.append((hub[i], node[i]))
                a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
                yield record(u=a, v=b)

    return run


def _verify_units(shingle: int, similarity: float, radius: int):
    """Rows sorted by (key, node): links of a unit's nodes of different components whose prints are within the radius and whose texts are alike."""

    def links(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        nodes, prints, comps = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets, mine, out = Sets(len(rows)), np.unique(comps, return_inverse=True)[1], []
        own: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in own:
                own[i] = np.unique(shingle_hashes(words(rows[i][3]), shingle))
            return own[i]

        for i, found in zip(*_near(prints, radius, mine), strict=True):
            for _, j in sorted(found):
                if sets.root(mine[i]) == sets.root(mine[j]):
                    continue
                a, b = shingles(i), shingles(j)
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= similarity * (len(a) + len(b) - common):
                    sets.join(mine[i], mine[j])
                    out.append((nodes[i], nodes[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, node, fp, comp, text in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "fp", "comp", "text")), strict=True):
                if k != key:
                    out += links(rows)
                    key, rows = k, []
                if not rows or rows[-1][0] != node:
                    rows.append((node, fp, comp, text))
            yield record(u=np.array([x[0] for x in out], np.int64), v=np.array([x[1] for x in out], np.int64))
        out = links(rows)
        yield record(u=np.array([x[0] for x in out], np.int64), v=np.array([x[1] for x in out], np.int64))

    return run


def near_duplicate_groups(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, group): the key of each document (:func:`doc_key`) and that of its group's first one.

    Groups are the components of links between texts whose word shingles have
    a Jaccard similarity of at least ``similarity``; texts with the same words
    are alike.  Shards of SimHash prints propose links, which an exact
    comparison of the shingles confirms, in two rounds (:func:`shard_links`)
    that leave no print within the radius out.  The search is by chance only in
    that two alike texts may share no shard, or have prints beyond the radius.
    """
    docs = df.select(doc_key(id_col, text_col).alias("doc"), text_bytes(text_col).alias("text"))
    rows = scratch.table(docs.mapInArrow(_signatures(shingle), "doc long, node long, fp long, keys array<long>"))
    nodes = scratch.table(rows.groupBy("node").agg(F.min("doc").alias("first"), F.min(F.struct("fp", "keys")).alias("s")).select("node", "first", "s.fp", "s.keys"))

    def with_texts(wanted: DataFrame) -> DataFrame:
        named = scratch.table(wanted.join(nodes.select("node", F.col("first").alias("doc")), "node"))
        some = named.select("doc").distinct()
        few = some.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        return named.join(docs.join(F.broadcast(some), "doc", "left_semi") if few else docs, "doc")

    def confirm(links: DataFrame) -> DataFrame:
        # A node with many links is their hub; so its text moves once for FAN of them.
        degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        du, dv = degree.select(F.col("node").alias("u"), F.col("n").alias("nu")), degree.select(F.col("node").alias("v"), F.col("n").alias("nv"))
        turned = links.join(du, "u").join(dv, "v").withColumn("turn", F.col("nv") > F.col("nu"))
        turned = turned.select(F.when(F.col("turn"), F.col("v")).otherwise(F.col("u")).alias("hub"), F.when(F.col("turn"), F.col("u")).otherwise(F.col("v")).alias("node"), F.greatest("nu", "nv").alias("n"))
        dealt = scratch.table(turned.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / FAN)).cast("int")).select("hub", "part", "node"))
        wanted = dealt.select("hub", "part", "node", F.lit(1).alias("member")).unionAll(dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("node"), F.lit(0).alias("member")))
        return with_texts(wanted).select("hub", "part", "member", "node", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "member", "node").mapInArrow(_verify(shingle, similarity), "u long, v long")

    def confirm_units(units: DataFrame) -> DataFrame:
        rows = with_texts(units).select("key", "node", "fp", "comp", "text").repartition("key").sortWithinPartitions("key", "node")
        return rows.mapInArrow(_verify_units(shingle, similarity, RADIUS), "u long, v long")

    entries = nodes.select(F.explode("keys").alias("key"), "node", "fp")
    roots = components(shard_links(entries, RADIUS, scratch, confirm=(confirm, confirm_units)), scratch)
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("group"))
    return rows.join(placed.join(least, "root").select("node", "group"), "node").select("doc", "group")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near-duplicates: the first document of each group stays, with all columns.

    First is the smallest id; documents without an id come last, by their
    text's hash.  Of rows that share an id one stays, that with the smallest
    hash of its text.  Texts without words, null ones too, are one group.
    Columns of any name are kept as they are; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    groups = near_duplicate_groups(df, scratch, id_col, text_col, shingle, similarity)
    key, rank, first = free_names(df, "key", "rank", "hash")
    kept = groups.where("doc = group").select(F.col("doc").alias(key)).distinct()
    marked = df.withColumn(key, doc_key(id_col, text_col)).join(kept, key, "left_semi")
    order = Window.partitionBy(key).orderBy(first)
    return marked.withColumn(first, F.xxhash64(text_col)).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*names_of(df))
