"""Byte-level BPE encoding and decoding (operator 4).

Method: a batch's distinct pre-tokens go, by length, into padded numpy matrices of
symbol ids. In each round every row merges its leftmost pair of minimum rank; pair ranks
come from a hash table over whole matrices, and each round compacts the matrix by the
merged column. Rows with nothing left to merge leave the matrix. Pre-tokens of over
``LONGEST_ROW`` bytes lie end to end in one array instead of being padded; a round there
also merges the further places of the same rank that would come next.

One map over the rows: no shuffle, nothing is collected, a lost task is simply rerun.
Memory is bounded by the slices a batch is cut into, not by its longest text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import NEVER, PairTable, merge_long

#: Pre-tokens of more bytes are not padded.
LONGEST_ROW = 256
#: Characters of text, and pre-tokens, that are held as Python objects at a time.
SLICE_CHARS, SLICE_TOKENS = 4_000_000, 1_000_000
#: Entries of the cache of pre-tokens, which a task drops when it ends.
CACHE = 400_000
_ROWS = 32_768
#: Bytes of long pre-tokens that share rounds.
_LONG = 1_000_000


class ByteBPE:
    """An encoder for a file of ``base64 rank`` lines and a pre-token pattern."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.find = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.text_of_id = {i: str(i) for i in self.tokens}
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    left.append(a), right.append(b), rank.append(r)
        order = np.array(rank, np.int32)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), order, order)
        self._cache: dict[str, tuple[int, ...]] = {}

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of 2 to ``width`` bytes."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width - 1), NEVER, np.int32)
        i, j = np.nonzero(ids[:, 1:] >= 0)
        rank[i, j] = self.table.ranks(ids[i, j], ids[i, j + 1])
        rows, out = np.arange(n), [()] * n

        def finish(rows: np.ndarray, ids: np.ndarray) -> None:
            """Rows that leave: what is not padding, which is on the right."""
            for r, own, k in zip(rows.tolist(), ids.tolist(), (ids >= 0).sum(axis=1).tolist()):
                out[r] = tuple(own[:k])

        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            best = rank[every, at]
            if (done := best == NEVER).any():
                finish(rows[done], ids[done])
                ids, rank, rows, at, best = ids[~done], rank[~done], rows[~done], at[~done], best[~done]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = best
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[every, np.minimum(at + 1, rank.shape[1] - 1)] = False
            rank = rank[keep].reshape(len(rows), -1)
            for k in (at - 1, at):
                ok = (k >= 0) & (k < rank.shape[1])
                r, c = every[ok], k[ok]
                a, b = ids[r, c], ids[r, np.minimum(c + 1, ids.shape[1] - 1)]
                real = b >= 0
                rank[r, c] = NEVER
                rank[r[real], c[real]] = self.table.ranks(a[real], b[real])
            if not rank.shape[1]:
                finish(rows, ids)
                break
        return out

    def _encode_new(self, words: list[str]) -> None:
        """Put the ids of distinct pre-tokens into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        long: list[str] = []
        held = 0

        def flush() -> None:
            rows = [self.bytes_to_id[np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)] for w in long]
            for w, ids in zip(long, merge_long(rows, self.table)):
                self._cache[w] = tuple(ids.tolist())
            long.clear()

        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(b)) is not None:
                self._cache[w] = (whole,)
            elif len(b) > LONGEST_ROW:
                long.append(w)
                held += len(b)
                if held > _LONG:
                    flush()
                    held = 0
            else:
                width = max(4, 1 << (len(b) - 1).bit_length()) if len(b) > 16 else 2 * ((len(b) + 1) // 2)
                buckets.setdefault(width, []).append((w, b))
        flush()
        for width, own in buckets.items():
            for i in range(0, len(own), _ROWS):
                part = own[i : i + _ROWS]
                for (w, _), ids in zip(part, self._matrix([b for _, b in part], width)):
                    self._cache[w] = ids

    def _learn(self, words: set[str]) -> None:
        """Have the cache hold all of ``words``."""
        if len(new := words.difference(self._cache)) + len(self._cache) > CACHE:
            self._cache.clear()
            new = words
        self._encode_new(list(new))

    def ids(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, slice by slice; short texts share the rounds of merges.

        A text's slices must be consumed before the next text's.
        """
        short = {i: self.find.findall(t) for i, t in enumerate(texts) if len(t) <= SLICE_CHARS}
        words = set(chain.from_iterable(short.values()))
        self._learn(words)
        for i, t in enumerate(texts):
            if i in short:
                yield iter([list(chain.from_iterable(map(self._cache.__getitem__, short.pop(i))))])
            else:
                yield self._long(t)
                self._learn(words)

    def _long(self, text: str) -> Iterator[list[int]]:
        found = (m.group() for m in self.find.finditer(text))
        while part := list(islice(found, SLICE_TOKENS)):
            self._learn(set(part))
            yield list(chain.from_iterable(map(self._cache.__getitem__, part)))

    def forget(self) -> None:
        self._cache = {}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(next(self.ids([text]))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(rank_path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process."""
    if (key := (rank_path, pattern)) not in _LOADED:
        _LOADED[key] = ByteBPE(rank_path, pattern)
    return _LOADED[key]


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about ``chars`` characters; null is the empty text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars or i == len(texts) - 1:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, total = i + 1, 0


#: Columns that :func:`encode_texts` can add, and their types.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def encode_texts(
    df: DataFrame, rank_path: str, pattern: str, *, keys: list[str], text_col: str = "text", outputs: list[str]
) -> DataFrame:
    """``keys`` of every row with the encoding of its whole text.

    rank_path: the vocabulary, on every worker; pattern: splits a text before the merges;
    outputs: of ``n_tokens``, ``ids``, ``ids_sha256`` (of the decimal ids, comma-joined),
    ``decoded`` (bytes of the decoded ids) and ``decoded_sha256``.

    Null and empty texts have no ids. Repeated rows give repeated results; rows do not
    affect each other. Other columns than keys and text are not read. Empty tables give
    empty results. Texts of any length are encoded whole, in slices.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    if clash := set(keys) & set(outputs):
        raise ValueError(f"key columns clash with outputs: {sorted(clash)}")
    source = df.select(*keys, F.col(text_col).alias("__text"))
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(rank_path, pattern)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.forget()  # the worker process may go on to other work

    def encoded(bpe: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            for start, part in _arrow_slices(texts):
                made: dict[str, list] = {o: [] for o in outputs}
                for pieces in bpe.ids(part):
                    n, ids, said, decoded, plain = 0, [], hashlib.sha256(), hashlib.sha256(), []
                    for own in pieces:
                        if "ids_sha256" in made and own:
                            said.update(("," * (n > 0) + ",".join(map(bpe.text_of_id.__getitem__, own))).encode())
                        if "decoded" in made or "decoded_sha256" in made:
                            back = bpe.decode(own)
                            decoded.update(back)
                            if "decoded" in made:
                                plain.append(back)
                        if "ids" in made:
                            ids.extend(own)
                        n += len(own)
                    row = {"n_tokens": n, "ids": ids, "ids_sha256": said.hexdigest(), "decoded": b"".join(plain), "decoded_sha256": decoded.hexdigest()}
                    for o in outputs:
                        made[o].append(row[o])
                kept = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(k) for k in keys), *(pa.array(made[o], arrow[o]) for o in outputs)], names=[*keys, *outputs]
                )

    return source.mapInArrow(run, schema)


def _arrow_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """As :func:`slices`, without all texts of a batch as Python objects at once."""
    for at in range(0, len(texts), 1000):
        for start, part in slices(texts.slice(at, 1000).to_pylist()):
            yield at + start, part
