"""Token counts of a piece BPE model (operator 9).

Method: a batch's distinct pre-tokens lie as ragged numpy arrays, one flat array of
symbols with row lengths. In each round all rows at once merge their lowest-ranked pair,
the leftmost among equals; rows without one leave, and what survives is counted.

One map over the rows: no shuffle, nothing is collected, a lost task is simply rerun.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import NEVER, PairTable, merge_long

#: What the model writes for a space.
SPACE = "▁"
#: Pre-tokens of more symbols share rounds that keep their places by rank.
LONGEST_ROW = 256
#: Characters of text, and pre-tokens, that are held as Python objects at a time.
SLICE_CHARS, SLICE_TOKENS = 4_000_000, 1_000_000
CACHE = 600_000
_FLAT = 2_000_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


def unsupported(model: bytes) -> str | None:
    """What a model asks for that :class:`PieceCounter` does not do, if anything.

    Fields of the public model format: 2 the trainer's settings (3 kind of model, where 2
    is BPE; 24 spaces as suffixes; 35 bytes for unknown characters), 3 the normaliser's (2
    a table of replaced characters; 3 a space before the text; 4 spaces removed; 5 spaces
    written as a sign).
    """
    parts = dict(_fields(model))
    trainer, normaliser = (dict(_fields(parts.get(k, b""))) for k in (2, 3))
    wanted = [
        (trainer.get(3, 1) == 2, "only BPE models are supported"),
        (not trainer.get(24, 0), "spaces as suffixes are not supported"),
        (trainer.get(35, 0), "unknown characters must fall back to bytes"),
        (not normaliser.get(2), "a table of replaced characters is not supported"),
        (normaliser.get(3, 1) and normaliser.get(5, 1), "spaces must be written as a sign, with one before the text"),
        (not normaliser.get(4, 1), "spaces may not be removed"),
    ]
    return next((why for ok, why in wanted if not ok), None)


class PieceCounter:
    """Counts tokens as the model's library would, with its byte fallback.

    Supports models whose text is not normalised beyond spaces and that put a space before
    the text; others are refused. Where no piece has a space after another character, no
    merge crosses such a place, and texts are cut there.
    """

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if why := unsupported(sp.serialized_model_proto()):
            raise ValueError(f"{model_path}: {why}")
        ids = {}
        score = {}
        for i in range(sp.vocab_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                ids[p := sp.id_to_piece(i)] = i
                score[p] = sp.get_score(i)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids)
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        left, right, rank, merged = [], [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    left.append(a), right.append(b), rank.append(rank_of[score[p]]), merged.append(i)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32), np.array(merged, np.int32))
        #: a character outside the vocabulary is this symbol, which never merges
        self.unknown = sp.vocab_size()
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}
        self._cache: dict[str, int] = {}

    def _symbols(self, word: str) -> tuple[list[int], int]:
        """Symbols, and the byte tokens of characters that have none."""
        get, unknown = self.char_ids.get, self.unknown
        symbols = [get(c, unknown) for c in word]
        more = 0
        if unknown in symbols:
            more = sum(len(c.encode("utf-8", "surrogatepass")) for c, s in zip(word, symbols) if s == unknown)
        return symbols, more

    def _ragged(self, rows: list[list[int]]) -> np.ndarray:
        """How many known symbols survive in each row."""
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((s for r in rows for s in r), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(rows)), lengths)
        counts = np.zeros(len(rows), np.int64)

        def pair_ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, merged = np.full(len(at), NEVER, np.int32), np.full(len(at), -1, np.int32)
            inside = at < len(flat) - 1
            inside[inside] = owner[at[inside]] == owner[at[inside] + 1]
            i = at[inside]
            rank[inside], merged[inside] = self.table.ranks_and_merged(flat[i], flat[i + 1])
            return rank, merged

        rank, merged = pair_ranks(np.arange(len(flat)))
        while len(flat):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(flat)])
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            if (over := best == NEVER).any():
                counts += np.bincount(owner[over & (flat != self.unknown)], minlength=len(rows))
                flat, owner, rank, merged, best = (x[~over] for x in (flat, owner, rank, merged, best))
                if not len(flat):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]
            flat[hit] = merged[hit]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, owner, rank, merged = flat[keep], owner[keep], rank[keep], merged[keep]
            now = hit - np.arange(len(hit))
            around = np.unique(np.r_[now, now[now > 0] - 1])
            rank[around], merged[around] = pair_ranks(around)
        return counts

    def _count_new(self, words: list[str]) -> None:
        short: list[tuple[str, list[int], int]] = []
        long: list[tuple[str, list[int], int]] = []
        held = 0

        def flush() -> None:
            for (w, _, more), n in zip(short, self._ragged([s for _, s, _ in short])):
                self._cache[w] = int(n) + more
            for (w, _, more), left in zip(long, merge_long([np.array(s, np.int64) for _, s, _ in long], self.table)):
                self._cache[w] = int((left != self.unknown).sum()) + more
            short.clear(), long.clear()

        for w in words:
            symbols, more = self._symbols(w)
            (long if len(symbols) > LONGEST_ROW else short).append((w, symbols, more))
            held += len(symbols)
            if held > _FLAT:
                flush()
                held = 0
        flush()

    def forget(self) -> None:
        self._cache = {}

    def _learn(self, words: set[str]) -> None:
        """Have the cache hold all of ``words``."""
        if len(new := words.difference(self._cache)) + len(self._cache) > CACHE:
            self._cache.clear()
            new = words
        self._count_new(list(new))

    def _long(self, marked: str) -> int:
        """Tokens of a long text, whose words are held slice by slice."""
        found, n = (m.group() for m in _CHUNK.finditer(marked)), 0
        while part := list(islice(found, SLICE_TOKENS)):
            self._learn(set(part))
            n += sum(map(self._cache.__getitem__, part))
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; short texts share the rounds of merges."""
        marked = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        if not self.cuts:
            words = [[t] * bool(t) for t in marked]
        else:
            words = [_CHUNK.findall(t) if len(t) <= SLICE_CHARS else [] for t in marked]
        long = [self._long(t) if self.cuts and len(t) > SLICE_CHARS else 0 for t in marked]
        self._learn(set().union(*words))
        return [n + sum(map(self._cache.__getitem__, w)) for n, w in zip(long, words)]


_LOADED: dict[str, PieceCounter] = {}


def loaded(model_path: str) -> PieceCounter:
    if model_path not in _LOADED:
        _LOADED[model_path] = PieceCounter(model_path)
    return _LOADED[model_path]


def count_tokens(df: DataFrame, model_path: str, *, keys: list[str], text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``keys`` of every row with ``n_bytes``, ``n_tokens`` and ``over_limit`` of its whole text.

    Null and empty texts count 0. Repeated rows give repeated results, and rows do not
    affect each other. Columns other than keys and text are not read; key columns may
    not bear the result's names. Empty tables give empty results.
    """
    if clash := set(keys) & {"n_bytes", "n_tokens", "over_limit"}:
        raise ValueError(f"key columns clash with outputs: {sorted(clash)}")
    source = df.select(*keys, F.col(text_col).alias("__text"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model_path)
        try:
            yield from counted(counter, batches)
        finally:
            counter.forget()  # the worker process may go on to other work

    def counted(counter: PieceCounter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            counts: list[int] = []
            held: list[str] = []
            chars = 0
            for t in batch.column("__text"):
                t = t.as_py() or ""
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                held.append(t)
                chars += len(t)
                if chars >= SLICE_CHARS:
                    counts += counter.counts(held)
                    held, chars = [], 0
            counts += counter.counts(held)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[*keys, "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(run, schema)
