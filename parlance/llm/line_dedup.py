"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``limit`` edits agree in one of ``limit + 1`` segments of the
shorter one, whose length sets the limit.  Lines are indexed by their own
segments and probe those of shorter lines, only at the places that the lengths
and the edits before a segment allow; banded bit-parallel edit distance
verifies.  The links' components are classes of lines.  The lines of a large
group meet one block of it first; only those that this doesn't join meet all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, block_pairs, doc_key, free_names, grouped, key_to_id, left_blocks, longs, names_of, record, slices, text_bytes
from .components import components

#: Edits between lines of one class, and the characters of the shorter line that each edit takes.
THRESHOLD, EDIT_CHARS = 2, 10
SPACE = " \t\r\f\x0b"
#: Members of a segment's group that are paired one by one, and those of a block in a larger group.
FEW, BLOCK = 32, 256
#: Candidate lines that are broadcast to find their texts, 8 bytes each; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
_SEEN = 200_000


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two strings is at most ``k``.

    Common ends are cut off; then bit d of band position i - j says that the
    first i characters turn into the first j with at most d edits (Wu and
    Manber's automaton, kept to the 2k + 1 diagonals that matter).
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.endswith(b[len(b) - mid :]) else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(b) <= k:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    band = (1 << 2 * k + 1) - 1
    state = [((1 << d + 1) - 1) << k & band for d in range(k + 1)]
    for j, c in enumerate(b, 1):
        shift = j - k - 1
        p = places.get(c, 0)
        match = (p >> shift if shift >= 0 else p << -shift) & band
        before = 0
        old_less = 0
        for d in range(k + 1):
            old = state[d]
            new = old & match
            if d:
                new |= old_less | old_less >> 1 | before << 1
            new &= band
            state[d], old_less, before = new, old, new
        if not state[k]:
            return False
    return bool(state[k] >> len(a) - len(b) + k & 1)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of threshold + 1 segments of nearly equal length; the longer ones come last."""
    n = threshold + 1
    size, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        s = size + (i >= n - more)
        out.append((at, s))
        at += s
    return out


def edits(length: int, threshold: int, edit_chars: int) -> int:
    """The edits between a line of this length and one that isn't shorter: one for every ``edit_chars`` characters, up to the threshold."""
    return min(threshold, length // edit_chars)


def probe_places(length: int, threshold: int, edit_chars: int) -> list[tuple[int, int, int, int, int]]:
    """(segment, indexed length, start, end, role) of the substrings that a line of this length has in the join.

    Role 1 is the line's own segment, role 0 a probe of another line's.
    """
    out = []
    for shorter in range(max(edit_chars, length - threshold), length + 1):
        limit, delta = edits(shorter, threshold, edit_chars), length - shorter
        if not limit or delta > limit:
            continue
        for i, (s, n) in enumerate(segments(shorter, limit)):
            begin = max(0, s - i, s + delta - (limit - i))
            end = min(length - n, s + i, s + delta + (limit - i))
            out += [(i, shorter, p, p + n, int(not delta and p == s)) for p in range(begin, end + 1)]
    return out


def _segments_of(threshold: int, edit_chars: int):
    """(key, line, role) of the substrings of each distinct line; a task gives a line once unless it forgot it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans: dict[int, list[tuple[int, int, int, int, int]]] = {}
        strip = SPACE.encode()
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                keys: list[int] = []
                lines: list[int] = []
                roles: list[int] = []
                for text in part.column("text").to_pylist():
                    for raw in text.split(b"\n"):
                        raw = raw.strip(strip)
                        if len(raw) < edit_chars:
                            continue
                        name = digest(raw, 42)
                        if name in seen:
                            continue
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(name)
                        line = raw.decode("utf-8", "surrogateescape")
                        n = len(line)
                        plan = plans.get(n)
                        if plan is None:
                            if len(plans) > 5000:
                                plans.clear()
                            plan = plans[n] = probe_places(n, threshold, edit_chars)
                        # ASCII lines are cut as bytes, where places are the same
                        if n == len(raw):
                            keys += [digest(raw[s:e], i << 32 | size) for i, size, s, e, _ in plan]
                        else:
                            keys += [digest(line[s:e].encode("utf-8", "surrogateescape"), i << 32 | size) for i, size, s, e, _ in plan]
                        roles += [p[4] for p in plan]
                        lines += [name] * len(plan)
                yield record(
                    key=pa.array(np.array(keys, np.uint64).view(np.int64)),
                    line=pa.array(np.array(lines, np.uint64).view(np.int64)),
                    role=pa.array(np.array(roles, np.int8)),
                )

    return run


def _propose(few: int, block: int):
    """Rows sorted by key: kind 0 pairs (line, other), kind 1 members of large groups, kind 2 their numbers of blocks."""

    def out(kind: int, n: int, **cols: np.ndarray) -> pa.RecordBatch:
        got = {"kind": np.full(n, kind)} | {k: cols.get(k, np.zeros(n, np.int64)) for k in ("key", "block", "blocks", "line", "other")}
        return record(**{k: pa.array(v, pa.int32() if k in ("kind", "block", "blocks") else pa.int64()) for k, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "key", block):
            if isinstance(g, Block):
                line = np.unique(g.cols["line"])
                yield out(1, len(line), key=np.full(len(line), g.key), block=np.full(len(line), g.number), line=line)
                if g.last:
                    yield out(2, 1, key=np.array([g.key]), blocks=np.array([g.number + 1]))
                continue
            line, role = g.cols["line"], g.cols["role"]
            two = g.starts[g.sizes == 2]
            two = two[(line[two] != line[two + 1]) & ((role[two] == 1) | (role[two + 1] == 1))]
            pairs = [np.stack([line[two], line[two + 1]])]
            for k in np.flatnonzero(g.sizes > 2):
                here, own = line[g.starts[k] : g.ends[k]], role[g.starts[k] : g.ends[k]] == 1
                all_ = np.unique(here)
                if len(all_) < 2 or not own.any():
                    continue
                if len(all_) > few:
                    key = g.cols["key"][g.starts[k]]
                    yield out(1, len(all_), key=np.full(len(all_), key), line=all_)
                    yield out(2, 1, key=np.array([key]), blocks=np.array([1]))
                    continue
                index = np.unique(here[own])
                a, b = np.repeat(index, len(all_)), np.tile(all_, len(index))
                pairs.append(np.stack([a, b])[:, a != b])
            got = np.concatenate(pairs, axis=1)
            if got.shape[1]:
                got = np.unique(np.sort(got, axis=0), axis=1)
                yield out(0, got.shape[1], line=got[0], other=got[1])

    return run


def _verify(threshold: int, edit_chars: int):
    """Rows sorted by (unit, line): links (u, v) that join the unit's lines which are near each other and not joined yet."""

    def links(names: list[int], comps: list[int], texts: list[str]) -> list[tuple[int, int]]:
        first: dict[int, int] = {}
        parent = [first.setdefault(c, i) for i, c in enumerate(comps)]

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        many = len(names) > 8
        if many:
            counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 31, minlength=32) for t in texts]).astype(np.int32)
        for i in range(1, len(names)):
            # An edit changes the counts of characters by two at most
            near = np.flatnonzero(np.abs(counts[:i] - counts[i]).sum(axis=1) <= 2 * threshold).tolist() if many else range(i)
            for j in near:
                a, b = root(i), root(j)
                if a != b and within(texts[i], texts[j], edits(min(len(texts[i]), len(texts[j])), threshold, edit_chars)):
                    parent[max(a, b)] = min(a, b)
                    out.append((names[j], names[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: int | None = None
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for u, name, comp, raw in zip(*(batch.column(c).to_pylist() for c in ("unit", "line", "comp", "text")), strict=True):
                if u != unit:
                    out += links(*held)
                    unit, held = u, ([], [], [])
                if not held[0] or held[0][-1] != name:
                    for x, y in zip(held, (name, comp, raw.decode("utf-8", "surrogateescape")), strict=True):
                        x.append(y)
            yield record(u=pa.array([x[0] for x in out], pa.int64()), v=pa.array([x[1] for x in out], pa.int64()))
        out = links(*held)
        yield record(u=pa.array([x[0] for x in out], pa.int64()), v=pa.array([x[1] for x in out], pa.int64()))

    return run


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, text, line) of every line that isn't blank; ``line`` is the hash of its text without outer space."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc", "line_no", _stripped(F.col("raw")).alias("text")).where("text <> ''").withColumn("line", F.xxhash64("text"))


def line_classes(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(doc, line_no, line, first_doc, first_line, size) of every line that isn't blank.

    Lines are what newlines part, without outer space; equal ones are of one
    class, and so are those which chains of few edits (insertions, deletions or
    replacements of a character) join: one edit for every ``edit_chars``
    characters of the shorter line, ``threshold`` at most, so lines of fewer
    characters are alike only to their equals.  A class is named by its first
    line, in the order of documents' keys (:func:`common.doc_key`) and line
    numbers; ``size`` is the number of its lines.  Rows that share an id are
    one document, whose line counts once for its number and text.
    """
    docs = df.select(doc_key(id_col, text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_segments_of(threshold, edit_chars), "key long, line long, role byte")
    dealt = rows.repartition("key").sortWithinPartitions("key", "line")
    found = scratch.table(dealt.mapInArrow(_propose(FEW, BLOCK), "kind int, key long, block int, blocks int, line long, other long"))

    def links(units: DataFrame) -> DataFrame:
        units = scratch.table(units)
        wanted = scratch.table(units.select("line").distinct())
        few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        texts = _lines(docs).select("line", "text").join(F.broadcast(wanted) if few else wanted, "line", "left_semi").groupBy("line").agg(F.max("text").alias("text"))
        compared = units.join(texts, "line").select("unit", "line", "comp", F.col("text").cast("binary").alias("text")).repartition("unit").sortWithinPartitions("unit", "line")
        out = scratch.table(compared.mapInArrow(_verify(threshold, edit_chars), "u long, v long"))
        scratch.drop(units, wanted)
        return out

    pairs = found.where("kind = 0").select("line", "other").distinct()
    units = pairs.select(F.xxhash64("line", "other", F.lit(0)).alias("unit"), F.explode(F.array("line", "other")).alias("line"))
    members, ends = found.where("kind = 1").select("key", "block", "line"), found.where("kind = 2").select("key", "blocks")
    large = ends.limit(1).count() > 0
    if large:
        units = units.unionAll(block_pairs(members, ends.withColumn("lead", F.lit(1))).select("unit", "line"))
    near = links(units.withColumn("comp", F.col("line")))
    roots = components(near, scratch)
    if large and (left := left_blocks(members.select("key", F.col("line").alias("node")), roots, BLOCK // 2, scratch)) is not None:
        rest = links(block_pairs(*left).select("unit", F.col("node").alias("line"), "comp"))
        roots = components(near.unionAll(rest), scratch)
    scratch.drop(found)
    places = scratch.table(_lines(docs).select("doc", "line_no", "line"))
    stats = places.groupBy("line").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("size"))
    named = stats.join(roots, stats.line == roots.node, "left").select("line", "first", "size", F.coalesce("root", "line").alias("root"))
    by_class = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    classes = named.select("line", "root").join(by_class, "root").select("line", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_line"), "size")
    return places.join(classes, "line").select("doc", "line_no", "line", "first_doc", "first_line", "size")


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, line_no, line, class_doc, class_line, class_size, kept): :func:`line_classes` with ids; the first line of a class is kept.

    Ids are null for documents without one.  Null and empty texts have no
    lines, repeated rows of a document count once, other columns don't
    matter, and an empty table gives no rows.
    """
    out = line_classes(df, Scratch(df.sparkSession), id_col, text_col, **options)
    kept = (F.col("doc") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    return out.select(key_to_id("doc").alias(id_col), "line_no", "line", key_to_id("first_doc").alias("class_doc"), F.col("first_line").alias("class_line"), F.col("size").alias("class_size"), kept.alias("kept"))


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", leave_above: float = 1.0, length_col: str | None = None, keep_emptied: bool = True, **options) -> DataFrame:
    """``df`` with each text cut to the lines that are the first of their class.

    Blank lines stay.  A document of whose lines' characters more than the
    share ``leave_above`` would go is a copy as a whole and is left as it is,
    for the deduplication of documents; at 1.0 none is left.  A text without
    repeated lines, null and empty ones too, stays untouched; one that loses
    all its lines becomes empty, or goes unless ``keep_emptied``.
    ``length_col`` names a column with the text's length, which then follows it.
    Rows that share an id are one document: a line that stands at one place in
    several of them counts once.  Columns of any name are kept as they are; an
    empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    classes = line_classes(df, scratch, id_col, text_col, **options)
    key, gone = free_names(df, "key", "gone")
    repeated = classes.where("doc <> first_doc or line_no <> first_line").groupBy(F.col("doc").alias(key)).agg(F.collect_set("line_no").alias(gone))
    joined = df.withColumn(key, doc_key(id_col, text_col)).join(repeated, key, "left")
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))

    def chars(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    cut = F.when(F.col(gone).isNotNull() & (chars(lines) - chars(kept) <= leave_above * chars(lines)), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, cut)
    if not keep_emptied:
        out = out.where(F.col(gone).isNull() | (F.trim(F.col(text_col), F.lit(SPACE + "\n")) != ""))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(gone).isNotNull(), F.length(text_col).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*names_of(df))
