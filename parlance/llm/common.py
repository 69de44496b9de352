"""What the operators share: scratch tables, document keys, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents without an id get keys from here on, made of their text's hash.
NULL_KEYS_FROM = 1 << 62
#: Bytes of text that a Python worker handles in one go; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode; on a cluster
    that would lose data with an executor, so it is refused.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_scratch.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="parlance-"))


#: The scratch folders of each open :func:`released`, the innermost last.
_scopes: list[list[Scratch]] = []


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    A result may read them as long as it is used, so they stay, unless
    :func:`released` deletes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0
        if _scopes:
            _scopes[-1].append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again; its path is kept for :meth:`drop`."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        """Deletes all tables."""
        self._delete(self.path)


@contextmanager
def released() -> Iterator[None]:
    """Deletes at its end the scratch tables of all operators called within; their results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.clear()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that ``df`` lacks in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(c for c in (f"{n}{'_' * i}" for i in range(1, len(taken) + 2)) if c not in taken) for n in names]


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def names_of(df: DataFrame) -> list[str]:
    """The columns of ``df``, quoted."""
    return [quoted(c) for c in df.columns]


def text_bytes(col: str | Column) -> Column:
    """A text as its bytes; null is the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def doc_key(id_col: str, text_col: str) -> Column:
    """An integer that names a document: its id, or for a null id one made of its text's hash.

    Rows that share an id are one document.  Ids must be below 2**62.
    """
    spare = F.lit(NULL_KEYS_FROM) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(id_col).cast("long"), spare)


def key_to_id(col: str | Column) -> Column:
    """The id of a key of :func:`doc_key`, null for a document without one."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c < F.lit(NULL_KEYS_FROM), c)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in ``column``; every row is in one."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def longs(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as int64."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: well mixed 64-bit values, one for each input."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# Groups in streams that are sorted by a key ---------------------------------


class Groups:
    """Whole groups: columns, and where each group begins."""

    def __init__(self, cols: dict[str, np.ndarray], starts: np.ndarray):
        self.cols, self.starts = cols, starts
        self.ends = np.append(starts[1:], len(next(iter(cols.values()))))
        self.sizes = self.ends - starts


class Block:
    """A part of a group that is larger than the limit; ``last`` closes the group."""

    def __init__(self, key: int, number: int, cols: dict[str, np.ndarray], last: bool):
        self.key, self.number, self.cols, self.last = key, number, cols, last


def _cut(cols: dict[str, np.ndarray], begin: int, end: int | None = None) -> dict[str, np.ndarray]:
    return {k: v[begin:end] for k, v in cols.items()}


def _blocks(cols: dict[str, np.ndarray], key: str, limit: int, given: int = 0) -> Iterator[Block]:
    n = len(cols[key])
    for i, begin in enumerate(range(0, n, limit), given):
        yield Block(int(cols[key][0]), i, _cut(cols, begin, begin + limit), begin + limit >= n)


def grouped(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[Groups | Block]:
    """Groups of up to ``limit`` rows whole; larger ones as blocks, so memory stays bounded.

    The batches are sorted by ``key``; all columns are integers without nulls.
    """
    held: dict[str, np.ndarray] | None = None
    given = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: longs(batch.column(n)) for n in batch.schema.names}
        if held is not None:
            cols = {n: np.concatenate([held[n], v]) for n, v in cols.items()}
        k = cols[key]
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if given and len(cut):
            yield from _blocks(_cut(cols, 0, cut[0]), key, limit, given)
            cols, cut, given = _cut(cols, cut[0]), cut[1:] - cut[0], 0
        if len(cut):
            starts = np.concatenate([[0], cut[:-1]])
            sizes = cut - starts
            if (sizes > limit).any():
                begin = 0
                for i in np.flatnonzero(sizes > limit):
                    if starts[i] > begin:
                        inner = (starts >= begin) & (starts < starts[i])
                        yield Groups(_cut(cols, begin, starts[i]), starts[inner] - begin)
                    yield from _blocks(_cut(cols, starts[i], cut[i]), key, limit)
                    begin = cut[i]
                if begin < cut[-1]:
                    inner = starts >= begin
                    yield Groups(_cut(cols, begin, cut[-1]), starts[inner] - begin)
            else:
                yield Groups(_cut(cols, 0, cut[-1]), starts)
            cols = _cut(cols, cut[-1])
        held = cols
        while len(held[key]) > limit:
            yield Block(int(held[key][0]), given, _cut(held, 0, limit), False)
            held, given = _cut(held, limit), given + 1
    if held is not None and len(held[key]):
        if given:
            yield Block(int(held[key][0]), given, held, True)
        else:
            yield Groups(held, np.array([0]))


def block_pairs(members: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of hot groups, dealt to units that hold one pair of blocks each.

    ``members`` has (key, block, ...), ``ends`` (key, blocks).  Any two rows of
    a group meet in a unit, and a unit holds two blocks at most, whatever the
    size of the group.  If ``ends`` has ``lead`` too, only pairs with one of
    the first ``lead`` blocks are made.  Adds unit, lo and hi.
    """
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    if "lead" in ends.columns:
        blocks = F.when(F.col("block") < F.col("lead"), blocks).otherwise(F.sequence(F.lit(0), F.col("lead") - 1))
    return (
        members.join(ends, "key")
        .withColumn("other", F.explode(blocks))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .withColumn("unit", F.xxhash64("key", "lo", "hi"))
        .drop("other", "blocks", "lead")
    )


def left_blocks(members: DataFrame, roots: DataFrame, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Blocks of about ``block`` rows, for :func:`block_pairs`, of hot groups whose ``members`` (key, node) are joined in part.

    ``roots`` has (node, root) of what is joined.  The first blocks of a group
    hold what is outside its largest component, and ``lead`` is their number:
    pairs with them are all that is left to compare.  Groups of one component
    are left out; None says that no other is there.
    """
    of = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    sizes = of.groupBy("key", "comp").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    lead, rest = (F.ceil(x / block).cast("int") for x in (F.col("n") - F.col("most.n"), F.col("most.n")))
    groups = scratch.table(groups.select("key", F.col("most.comp").alias("largest"), lead.alias("lead"), (lead + rest).alias("blocks")))
    if not groups.limit(1).count():
        return None
    spread = F.xxhash64("key", "node")
    dealt = of.join(groups, "key").withColumn("block", F.when(F.col("comp") != F.col("largest"), F.pmod(spread, F.col("lead"))).otherwise(F.col("lead") + F.pmod(spread, F.col("blocks") - F.col("lead"))).cast("int"))
    return dealt.select("key", "block", "node", "comp"), groups.select("key", "blocks", "lead")
