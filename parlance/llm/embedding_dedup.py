"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by random signs and Hadamard transforms; the largest
coordinates of two rotations name a bucket, and each vector also probes the
buckets it is likely to have fallen into but for small changes.  Vectors that
share a bucket are compared exactly, in double precision.  Links are counted in
the task that finds them, each once, and never written out one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, Scratch, block_pairs, grouped, longs, mix, record
from .components import components
from .rotations import probes, rotate

#: Tables, and buckets that a vector probes in each, its own included.  At a cosine of 0.98 in 64
#: dimensions two vectors meet in one table with a probability of 0.93, in one of TABLES with over 0.9999999.
TABLES, PROBES = 6, 4
#: Vectors of one bucket, or block of a larger one, that are compared at once; a unit has two blocks at most.
BUCKET = 1000
#: Signs of rotated coordinates that must agree before vectors are fetched: a cosine of 0.98 changes 4 of 64 on average.
#: Signs of narrower vectors than SKETCH_WIDTH depend on each other too much to tell, so all of them are fetched.
SKETCH, SKETCH_RADIUS, SKETCH_WIDTH = 64, 24, 16


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(unit: np.ndarray) -> np.ndarray:
    """(rows, TABLES, PROBES) bucket numbers; the first in each table is the vector's own."""
    out = np.empty((len(unit), TABLES, PROBES), np.int64)
    for t in range(TABLES):
        out[:, t] = probes(rotate(unit, 2 * t), rotate(unit, 2 * t + 1), PROBES)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds node: a hash of label and vector, null for what can't be compared."""
    for batch in batches:
        nodes: list[int | None] = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            good = label is not None and v and None not in v
            a = np.array(v, np.float64) if good else None
            if not good or not np.isfinite(a).all() or not a.any():
                nodes.append(None)
            else:
                h = blake2b(label.encode() + b"\x00" + (a + 0.0).tobytes(), digest_size=8)
                nodes.append(int.from_bytes(h.digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])


def _by_width(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each width."""
    widths = np.array([len(v) for v in vectors])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, np.array([vectors[i] for i in at], np.float64)


def _label_hash(label: str, width: int) -> int:
    return int.from_bytes(blake2b(f"{width} {label}".encode(), digest_size=8).digest(), "little")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, place, own, sketch): a row for each bucket of each vector; place is the table and the bucket's number."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        node = longs(batch.column("node"))
        for at, matrix in _by_width(batch.column("vector").to_pylist()):
            for begin in range(0, len(at), 2000):
                part, unit = at[begin : begin + 2000], _unit(matrix[begin : begin + 2000])
                c = codes(unit)
                place = (c + (np.arange(TABLES) << 40)[None, :, None]).reshape(len(part), -1)
                group = np.array([_label_hash(labels[i], matrix.shape[1]) for i in part], np.uint64)
                key = mix(place.astype(np.uint64) ^ group[:, None]).view(np.int64)
                width = place.shape[1]
                flat = np.concatenate([rotate(unit, 1000 + k) for k in range(-(-SKETCH // max(2, unit.shape[1])))], axis=1)[:, :SKETCH] > 0
                bits = np.zeros((len(part), SKETCH), bool)
                if unit.shape[1] >= SKETCH_WIDTH:
                    bits[:, : flat.shape[1]] = flat
                sketch = np.packbits(bits, axis=1, bitorder="little").copy().view("<i8").ravel()
                yield record(key=key.ravel(), node=np.repeat(node[part], width), place=place.ravel(), own=np.tile(np.tile(np.arange(PROBES) == 0, TABLES).astype(np.int64), len(part)), sketch=np.repeat(sketch, width))


def _meet(bucket: int):
    """Rows sorted by key: kind 1 members of buckets worth comparing, in blocks; kind 2 a bucket's number of blocks.

    A member that is far from all others by its sketch is left out.
    """

    def out(kind: int, n: int, **cols) -> pa.RecordBatch:
        got = {"kind": np.full(n, kind)} | {k: np.broadcast_to(cols.get(k, 0), n) for k in ("key", "block", "blocks", "node", "place")}
        return record(**{k: pa.array(v, pa.int32() if k in ("kind", "block", "blocks") else pa.int64()) for k, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, "key", bucket):
            if isinstance(g, Block):
                yield out(1, len(g.cols["node"]), key=g.key, block=g.number, node=g.cols["node"], place=g.cols["place"])
                if g.last:
                    yield out(2, 1, key=g.key, blocks=g.number + 1)
                continue
            kept, ends = [], []
            for k in np.flatnonzero(g.sizes > 1):
                rows = np.arange(g.starts[k], g.ends[k])
                own = g.cols["own"][rows] == 1
                if not own.any():
                    continue
                s = g.cols["sketch"][rows].view(np.uint64)
                near = (np.bitwise_count(s[:, None] ^ s[None, :]) <= SKETCH_RADIUS) & (own[:, None] | own[None, :])
                np.fill_diagonal(near, False)
                some = near.any(axis=1)
                if some.any():
                    kept.append(rows[some])
                    ends.append(g.cols["key"][rows[0]])
            if kept:
                rows = np.concatenate(kept)
                yield out(1, len(rows), key=g.cols["key"][rows], node=g.cols["node"][rows], place=g.cols["place"][rows])
                yield out(2, len(ends), key=np.array(ends), blocks=1)

    return run


def _compare(cosine: float):
    """Rows of units: how many vectors each one links with that it meets there first, and links that join them."""

    def unit_links(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node, mult, block = (np.array(rows[k], np.int64) for k in ("node", "mult", "block"))
        n, m, u, v = [], [], [], []
        place = rows["place"][0]
        table, code, cross = place >> 40, place & ((1 << 40) - 1), rows["lo"][0] != rows["hi"][0]
        label = np.array(rows["label"], object)
        for at, matrix in _by_width(rows["vector"]):
            unit = _unit(matrix)
            close = unit @ unit.T >= cosine
            close &= label[at][:, None] == label[at][None, :]
            np.fill_diagonal(close, False)
            if cross:
                close &= block[at][:, None] != block[at][None, :]
            some = np.flatnonzero(close.any(axis=1))
            if not len(some):
                continue
            close, at = close[np.ix_(some, some)], at[some]
            c = codes(unit[some])
            own = c[:, :, 0]
            here = (own[:, table] == code)[:, None] | (own[:, table] == code)[None, :]
            earlier = np.zeros_like(close)
            for t in range(int(table) + 1):
                i_probes_j = np.zeros_like(close)
                for p in range(PROBES):
                    i_probes_j |= c[:, t, p][:, None] == own[:, t][None, :]
                if t < table:
                    earlier |= i_probes_j | i_probes_j.T
                else:
                    # in this table the pair also meets in a bucket with a smaller number
                    earlier |= (i_probes_j & (own[:, t][None, :] < code)) | (i_probes_j.T & (own[:, t][:, None] < code))
            close &= here
            counted = close & ~earlier
            links = counted @ mult[at]
            n.append(node[at])
            m.append(links)
            least = np.arange(len(at))
            while True:
                new = np.minimum(least, np.where(close, least[None, :], len(at)).min(axis=1, initial=len(at)))
                new = np.minimum(new, new[new])
                if (new == least).all():
                    break
                least = new
            far = least != np.arange(len(at))
            u.append(node[at[least[far]]])
            v.append(node[at[far]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cat(n), cat(m), cat(u), cat(v)

    def emit(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if rows and len(rows["node"]) > 1:
            n, m, u, v = unit_links(rows)
            some = m > 0
            if some.any():
                yield record(kind=np.zeros(some.sum(), np.int32), a=n[some], b=m[some])
            if len(u):
                yield record(kind=np.ones(len(u), np.int32), a=u, b=v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        rows: dict[str, list] = {}
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            unit = np.array(cols["unit"])
            starts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1)] if len(unit) else []
            for begin, end in zip(starts, [*starts[1:], len(unit)], strict=True):
                if unit[begin] != at:
                    yield from emit(rows)
                    at, rows = unit[begin], {c: [] for c in cols}
                for c in cols:
                    rows[c] += cols[c][begin:end]
        yield from emit(rows)

    return run


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: near vectors among those of one label.

    Two vectors are linked if their labels are equal and not null and their
    cosine, in double precision, is at least ``cosine``.  Vectors that are
    null, empty or zero, that hold null or non-finite values, or whose label is
    null link with nothing; nor do vectors of different widths.  ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id
    that links reach, the own one included, and a row is kept if it has that id.
    Equal vectors of a label are found by their hash and count with all their
    rows.  A row without an id counts in its neighbours' links; it has a null
    component if no row of it has an id, and is not kept.  Rows that share an id
    stay apart.  The search is by chance, but with TABLES tables it misses less
    than one in a million links of a cosine of 0.98 in 64 dimensions.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = scratch.table(rows.mapInArrow(_nodes, "id long, label string, vector array<double>, node long"))
    nodes = vectors.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.min("label").alias("label"), F.min("vector").alias("vector"))
    nodes = scratch.table(nodes)
    met = nodes.select("node", "label", "vector").mapInArrow(_buckets, "key long, node long, place long, own long, sketch long")
    met = scratch.table(met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet(BUCKET), "kind int, key long, block int, blocks int, node long, place long"))
    units = block_pairs(met.where("kind = 1").select("key", "block", "node", "place"), met.where("kind = 2").select("key", "blocks"))
    units = units.join(nodes.select("node", "mult", "label", "vector"), "node").select("unit", "lo", "hi", "block", "place", "node", "mult", "label", "vector")
    compared = scratch.table(units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_compare(cosine), "kind int, a long, b long"))
    links = compared.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = components(compared.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    placed = nodes.select("node", "least", "mult").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    components_ = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(components_, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    alone = F.col("node").isNull()
    out = vectors.select("id", "node").join(known, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(alone, F.col("id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )
