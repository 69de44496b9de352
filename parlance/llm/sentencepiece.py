"""SentencePiece segmentations sampled from the piece lattice, and their decoding.

For every stretch of text, forward filtering sums the weights of all ways to
cut its beginning into pieces; backward sampling draws a way from the end, one
piece after the other, in proportion.  Draws come from a counter-based
generator seeded by the row's key, so a row has the same segmentation in any
batch, order or cluster.  Characters that the vocabulary lacks are bytes, so
decoding restores every text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, quoted, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A piece of rank r has the weight (r + 2) ** -SMOOTHING; higher values favour frequent pieces.
SMOOTHING = 1.0
SEED = 1
#: Edges and stretches that a worker remembers before it begins anew.
MOST_EDGES, MOST_STRETCHES = 6_000_000, 400_000
#: Stretches of a text that are sampled at once.
AT_ONCE = 100_000
_SPACE = "▁"
#: Characters that stand for bytes; in a text, they and the space mark are bytes themselves.
_BYTE = 0x10FE00
_BASE = np.uint64(0x9E3779B97F4A7C55)
#: Longer stretches get their lattice one by one, shorter ones together, so many characters at once.
SHORT, TOGETHER = 48, 10_000
_ESCAPED = re.compile(f"[{_SPACE}{chr(_BYTE)}-{chr(_BYTE + 255)}]")


def _as_bytes(s: str) -> str:
    return "".join(chr(_BYTE + b) for b in s.encode("utf-8", "surrogateescape"))


class Pieces:
    """The vocabulary of a model file, and how texts fall into stretches that no piece crosses."""

    def __init__(self, path: str, smoothing: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[bytes] = []
        self.weights: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.weights[chr(_BYTE + int(piece[3:5], 16))] = (i, 1.0)
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                self.weights[piece] = (i, (2.0 - model.get_score(i)) ** -smoothing)
                self.texts.append(piece.replace(_SPACE, " ").encode())
        if sum(chr(_BYTE + b) in self.weights for b in range(256)) < 256:
            raise ValueError("the model has no piece for every byte, so texts could not be restored")
        self.longest = max(map(len, self.weights))
        self.known = {c for p in self.weights for c in p if len(p) == 1}
        self._index()
        names = [p for p in self.weights if len(p) > 1]
        self.stretch = self._stretches(names)

    def _index(self) -> None:
        """The pieces by a hash of their characters, for many look-ups at once."""
        keys = np.zeros(len(self.weights), np.uint64)
        for k, p in enumerate(self.weights):
            codes = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            h = np.zeros(1, np.uint64)
            for c in codes:
                h = h * _BASE + mix(np.array([c], np.uint64))
            keys[k] = mix(h + np.uint64(len(p)))[0]
        order = np.argsort(keys)
        values = np.array(list(self.weights.values()))
        self.keys, self.ids, self.chances = keys[order], values[order, 0].astype(np.int32), values[order, 1]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places in ``ids`` of the pieces with these rolling hashes and this length; -1 for none."""
        keys = mix(hashes + np.uint64(length))
        out = np.full(len(keys), -1, np.int32)
        some = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        right = self.keys[at] == keys[some]
        out[some[right]] = at[right]
        return out

    @staticmethod
    def _stretches(names: list[str]) -> re.Pattern:
        """Cuts that no piece crosses: before a space mark, around newlines, between letters and other characters.

        A letter that pieces join to others counts as one of them; with many
        such letters only the first two kinds of cuts are made, or none.
        """
        if any("\n" in p or re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names):
            return re.compile(r"(?s).+")
        odd: set[str] = set()
        letter = re.compile(r"[^\W\d_]")
        for _ in range(4):
            kinds = [(p, [bool(letter.match(c)) and c not in odd for c in p.lstrip(_SPACE)]) for p in names]
            crossing = [p for p, k in kinds if any(k) and not all(k)]
            if not crossing:
                chars = re.escape("".join(sorted(odd)))
                return re.compile(rf"{_SPACE}*[^\W\d_{chars}]+|{_SPACE}*(?:[^\w{_SPACE}\n]|[\d_{chars}])+|{_SPACE}+|\n+")
            odd |= {c for p in crossing for c in p if letter.match(c)}
            if len(odd) > 20:
                break
        return re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n+")

    def symbols(self, stretch: str) -> str:
        """A stretch with unknown characters as bytes."""
        known = self.known
        return "".join(c if c in known else c if _BYTE <= ord(c) <= _BYTE + 255 else _as_bytes(c) for c in stretch)


class Lattices:
    """Edges into each position of known stretches, with cumulated probabilities; the likeliest edge comes first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.size = array("i")
        self.base = array("q")
        self.first = array("q")
        self.chance, self.piece, self.back = array("d"), array("i"), array("i")

    def add(self, stretch: str) -> int:
        s = self.pieces.symbols(stretch)
        weights, longest = self.pieces.weights, self.pieces.longest
        n = len(s)
        self.size.append(n)
        self.base.append(len(self.first))
        self.first.append(len(self.chance))
        ahead = [1.0]
        for j in range(1, n + 1):
            edges = []
            total = 0.0
            for i in range(max(0, j - longest), j):
                got = weights.get(s[i:j])
                if got is not None:
                    w = ahead[i] * got[1]
                    total += w
                    edges.append((w, got[0], j - i))
            ahead.append(total)
            if total < 1e-150:  # only ratios within the longest piece matter
                low = max(0, j - longest)
                ahead[low:] = [x * 1e150 for x in ahead[low:]]
            self.first.append(len(self.chance))
            if len(edges) > 1:
                edges.sort(reverse=True)
                sums = 0.0
                for w, _, _ in edges[:-1]:
                    sums += w
                    self.chance.append(sums / total)
            self.chance.append(2.0)
            self.piece.extend([e[1] for e in edges])
            self.back.extend([e[2] for e in edges])
        return len(self.size) - 1

    def add_many(self, stretches: list[str]) -> None:
        """Lattices of distinct new stretches."""
        known, symbols = self.pieces.known, self.pieces.symbols
        texts = [(x, x) if known.issuperset(x) else (symbols(x), x) for x in stretches]
        texts.sort(key=lambda t: len(t[0]))
        begin = 0
        while begin < len(texts):
            n = len(texts[begin][0])
            if n > SHORT:
                for _, x in texts[begin:]:
                    self.places[x] = self.add(x)
                return
            end = min(len(texts), begin + max(1, TOGETHER // max(1, n)))
            while len(texts[end - 1][0]) > min(SHORT, n + 2 + n // 4):
                end -= 1
            self._add_short(texts[begin:end])
            begin = end

    def _add_short(self, texts: list[tuple[str, str]]) -> None:
        pieces, m, width = self.pieces, len(texts), len(texts[-1][0])
        size = np.array([len(t) for t, _ in texts], np.int32)
        codes = np.frombuffer("".join(t.ljust(width, "\0") for t, _ in texts).encode("utf-32-le"), np.uint32).reshape(m, width).T
        one = mix(codes.astype(np.uint64))
        reach = min(pieces.longest, width)
        found = np.full((reach, width, m), -1, np.int32)
        chance = np.zeros((reach, width, m))
        h = np.zeros((width, m), np.uint64)
        for back in range(1, reach + 1):  # h[j] is the hash of the characters j - back + 1 to j
            h = (np.concatenate([np.zeros((1, m), np.uint64), h[:-1]]) if back > 1 else h) * _BASE + one
            part = pieces.find(h[back - 1 :].ravel(), back).reshape(width - back + 1, m)
            found[back - 1, back - 1 :] = part
            chance[back - 1, back - 1 :] = np.where(part >= 0, pieces.chances[part], 0.0)
        ahead = np.zeros((width + 1, m))
        ahead[0] = 1.0
        for j in range(1, width + 1):
            for back in range(1, min(reach, j) + 1):
                chance[back - 1, j - 1] *= ahead[j - back]
            ahead[j] = chance[: min(reach, j), j - 1].sum(axis=0)
        inside = np.arange(width)[:, None] < size[None, :]
        # Edges by stretch, position and length, the longest first
        share = (chance / np.where(ahead[1:] > 0, ahead[1:], 1.0) * inside)[::-1].transpose(2, 1, 0)
        real = share > 0
        sums = np.cumsum(share, axis=2)[real]
        ends = np.cumsum(real.sum(axis=2).ravel()).reshape(m, width)
        sums[ends[inside.T] - 1] = 2.0
        offset, states = len(self.chance), len(self.first)
        starts = np.concatenate([ends[:, :1] * 0, ends], axis=1)
        starts[:, 1:] -= real.sum(axis=2)
        keep = np.arange(width + 1)[None, :] <= size[:, None]
        self.base.frombytes((states + np.concatenate([[0], np.cumsum(size + 1)[:-1]])).astype(np.int64).tobytes())
        for k, (_, x) in enumerate(texts, len(self.size)):
            self.places[x] = k
        self.size.frombytes(size.tobytes())
        self.first.frombytes((starts[keep] + offset).astype(np.int64).tobytes())
        self.chance.frombytes(sums.tobytes())
        self.piece.frombytes(pieces.ids[found[::-1].transpose(2, 1, 0)[real]].tobytes())
        self.back.frombytes((reach - np.nonzero(real)[2]).astype(np.int32).tobytes())

    def places_of(self, stretches: list[str]) -> list[int]:
        if new := set(stretches).difference(self.places):
            self.add_many(list(new))
        return list(map(self.places.__getitem__, stretches))

    def sample(self, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all stretches in order, and their number for each stretch."""
        base, size = np.frombuffer(self.base, np.int64), np.frombuffer(self.size, np.int32)
        first = np.frombuffer(self.first, np.int64)
        chance, piece, back = np.frombuffer(self.chance, np.float64), np.frombuffer(self.piece, np.int32), np.frombuffer(self.back, np.int32)
        count = np.zeros(len(at), np.int64)
        who, left, start, draw = np.arange(len(at)), size[at].astype(np.int64), base[at], seeds
        steps = []
        while len(who):
            draw = mix(draw)
            u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[start + left]
            more = np.flatnonzero(chance[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[chance[edge[more]] <= u[more]]
            steps.append((who, piece[edge]))
            count[who] += 1
            left = left - back[edge]
            on = left > 0
            if not on.all():
                who, left, start, draw = who[on], left[on], start[on], draw[on]
        end = np.cumsum(count)
        out = np.empty(end[-1] if len(end) else 0, np.int32)
        for k, (w, p) in enumerate(steps):
            out[end[w] - 1 - k] = p
        return out, count


@cache
def _pieces(path: str, smoothing: float) -> Pieces:
    return Pieces(path, smoothing)


class Sampler:
    """Encodes texts; remembers lattices within bounds."""

    def __init__(self, path: str = MODEL, smoothing: float = SMOOTHING):
        self.pieces = _pieces(path, smoothing)
        self.lattices = Lattices(self.pieces)

    def encode(self, texts: list[bytes], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, drawn with its seed.  An empty text has none."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        stretches: list[str] = []
        pending: list[tuple[int, int, int]] = []

        def flush() -> None:
            if not pending:
                return
            lat = self.lattices
            if len(lat.chance) > MOST_EDGES or len(lat.places) > MOST_STRETCHES:
                lat.clear()
            at = np.array(lat.places_of(stretches), np.int64)
            n = np.array([p[1] for p in pending])
            ordinal = np.concatenate([np.arange(k) + p for _, k, p in pending]).astype(np.uint64)
            with np.errstate(over="ignore"):
                draws = mix(np.repeat(seeds[[p[0] for p in pending]], n) + ordinal * np.uint64(0xD1342543DE82EF95))
            ids, count = lat.sample(at, draws)
            ends = np.cumsum(count)[np.cumsum(n) - 1]
            for (row, _, _), begin, end in zip(pending, np.concatenate([[0], ends[:-1]]), ends, strict=True):
                out[row].append(ids[begin:end])
            stretches.clear()
            pending.clear()

        for row, raw in enumerate(texts):
            if not raw:
                continue
            text = raw.decode("utf-8", "surrogateescape")
            if _ESCAPED.search(text):
                text = _ESCAPED.sub(lambda m: _as_bytes(m[0]), text)
            found = self.pieces.stretch.findall(_SPACE + text.replace(" ", _SPACE))
            for begin in range(0, len(found), AT_ONCE):
                part = found[begin : begin + AT_ONCE]
                stretches += part
                pending.append((row, len(part), begin))
                if len(stretches) >= AT_ONCE:
                    flush()
        flush()
        return [np.concatenate(p) if p else np.empty(0, np.int32) for p in out]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Texts of piece ids: without the space that begins every encoded text."""
        texts = self.pieces.texts
        return [b"".join([texts[i] for i in x.tolist()])[1:] for x in ids]


@cache
def sampler(path: str = MODEL, smoothing: float = SMOOTHING) -> Sampler:
    """The worker process's own sampler: its lattices serve all of the worker's tasks."""
    return Sampler(path, smoothing)


def row_seeds(keys: list[bytes | None], seed: int) -> np.ndarray:
    """A seed for each row key; all null keys have the same."""
    return np.array([xxhash.xxh64_intdigest(b"\x00" if k is None else b"\x01" + k, seed) for k in keys], np.uint64)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, smoothing: float = SMOOTHING, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, pieces, ids, lossless, *keep): a sampled segmentation of each row's text.

    ``lossless`` says that decoding the ids gives the text, byte for byte.  A
    null text has null in all three; an empty one has no ids.  Rows with equal
    keys and texts, and rows with null keys and equal texts, are segmented
    alike.  Columns in ``keep`` are carried along, but for those with the name
    of one of the first four; an empty table gives no rows.  ``model`` is the
    path of a SentencePiece model with byte pieces, readable on all executors.
    """
    own_names = (id_col, "pieces", "ids", "lossless")
    taken = {c.lower() for c in own_names}
    if len(taken) < 4:
        raise ValueError("the id's column bears the name of a result")
    plain = [c for c in keep if c.lower() not in taken]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, smoothing)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                texts = part.column("text").to_pylist()
                ids = own.encode(texts, row_seeds(part.column("key").to_pylist(), seed))
                same = [a == b for a, b in zip(own.decode(ids), texts, strict=True)]
                n = np.array([len(x) for x in ids], np.int32)
                null = part.column("null").to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
                kept = [part.column(f"c{i}") for i in range(len(plain))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, mask=null), lists, pa.array(same, mask=null), *kept], names=["id", "pieces", "ids", "lossless", *(f"c{i}" for i in range(len(plain)))])

    # Keys that are bytes, as a string may hold others than UTF-8
    text, key = quoted(text_col), quoted(id_col)
    chosen = df.select(F.col(key).alias("id"), F.col(key).cast("string").cast("binary").alias("key"), F.col(text).isNull().alias("null"), text_bytes(text).alias("text"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(plain)])
    kinds = "".join(f", c{i} {chosen.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(plain)))
    coded = chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, pieces int, ids array<int>, lossless boolean{kinds}")
    return coded.toDF(*own_names, *plain)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text of each array of piece ids in column ``out``, which is replaced if it is there.

    A null array gives a null text, an empty one the empty text; a null among
    the ids, or an id that the model lacks, is an error.  Texts come back byte
    for byte, also those that are not valid UTF-8.  Repeated rows are decoded
    alike; other columns may have any name; an empty table gives no rows.
    """
    names = [c for c in df.columns if c.lower() != out.lower() or c == ids_col]
    if ids_col.lower() == out.lower():
        raise ValueError("the text needs a column of its own")
    numbered = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model)
        for batch in batches:
            texts = [None if x is None else own.decode([np.array(x, np.int64)])[0] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "text"])

    decoded = numbered.mapInArrow(run, numbered.withColumn("text", F.lit(None).cast("binary")).schema)
    return decoded.withColumn("text", F.col("text").cast("string")).toDF(*names, out)
