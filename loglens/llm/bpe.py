"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no pattern matching. Every code point is mapped to a class by one
array look-up; the few look-aheads of the public pattern become classes of their own by
comparing shifted arrays. Each class is a function from states to states, functions compose
associatively, and so the state in front of each code point is a scan: the text is cut into columns,
all columns advance together from every possible state at once, the columns' functions are composed, and the
states then follow. A boundary is a property of (state, class). The slices between boundaries are looked up
in a cache of merged pairs; byte offsets of all tokens are kept, and decoding checks against them.

The vocabulary is a file of ranks, given by its path and read by each worker; its size is fixed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import bounded_batches, free_name, returning_memory, text_or_empty, with_columns

# Classes of code points. Some depend on what follows.
LETTER, NUMBER, OTHER, SPACE, BLANK, GAP, SHORT, LONG, END = range(9)
# LETTER \p{L}; NUMBER \p{N}; OTHER neither of these nor \s; SPACE " " in front of a visible character;
# BLANK other \s in front of a visible character; GAP \s in front of \s or of the end;
# SHORT an apostrophe followed by one of s t m d; LONG one followed by re, ve or ll; END stands behind a text.

# States: what is open in front of a code point.
NOTHING, AFTER_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, ONE_MORE, TWO_MORE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) for each state and class."""
    follow = np.full((8, 9), NOTHING, np.uint8)
    begins = np.ones((8, 9), bool)
    goes_to = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: AFTER_SPACE, BLANK: NOTHING, GAP: IN_GAP}
    for kind, state in goes_to.items():
        follow[:, kind] = state
    follow[:, SHORT], follow[:, LONG] = ONE_MORE, TWO_MORE
    for kind in (OTHER, SHORT, LONG):  # within a run of others or behind its space, an apostrophe is one of them
        follow[[AFTER_SPACE, IN_OTHERS], kind] = IN_OTHERS
        begins[[AFTER_SPACE, IN_OTHERS], kind] = False
    begins[[AFTER_SPACE, IN_LETTERS], LETTER] = False
    begins[[AFTER_SPACE, IN_NUMBERS], NUMBER] = False
    begins[IN_GAP, GAP] = False
    follow[TWO_MORE, LETTER], begins[TWO_MORE, LETTER] = ONE_MORE, False
    follow[ONE_MORE, LETTER], begins[ONE_MORE, LETTER] = NOTHING, False
    return follow, begins


FOLLOW, BEGINS = _automaton()
_COLUMN = 128
_STOP = 0x110000  # no code point
_AT_ONCE = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, look-aheads left out."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    kinds = np.full(_STOP + 1, OTHER, np.uint8)
    kinds[_STOP] = END
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[points[m.start() : m.end()]] = kind
    # Separators U+001C to U+001F are white space for some libraries, not for the Unicode property.
    kinds[0x1C:0x20] = OTHER
    return kinds


def _kinds(points: np.ndarray) -> np.ndarray:
    kinds = _classes()[points]
    ahead = np.append(kinds[1:], END)
    space = kinds == BLANK
    out = kinds.copy()
    out[space & (points == 0x20)] = SPACE
    out[space & ((ahead == BLANK) | (ahead == END))] = GAP
    at = np.flatnonzero(points == 0x27)
    if len(at):
        one = np.append(points, [0, 0])[at + 1]
        two = np.append(points, [0, 0])[at + 2]
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        out[at[is_one]] = SHORT
        out[at[is_two]] = LONG
    return out


def _states(kinds: np.ndarray) -> np.ndarray:
    """The state in front of each code point, by composing transition functions."""
    n = len(kinds)
    columns = -(-n // _COLUMN)
    grid = np.full(columns * _COLUMN, LETTER, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(columns, _COLUMN).T)
    moves = np.ascontiguousarray(FOLLOW.T)  # class, state
    reach = np.broadcast_to(np.arange(8, dtype=np.uint8), (columns, 8))
    for step in grid:  # reach[c, s]: where column c leads from state s
        reach = moves[step[:, None], reach]
    shift = 1
    while shift < columns:  # reach[c]: where columns 0..c lead
        earlier = reach[:-shift]
        reach = np.concatenate([reach[:shift], np.take_along_axis(reach[shift:], earlier.astype(np.intp), 1)])
        shift *= 2
    state = np.concatenate([[np.uint8(NOTHING)], reach[:-1, NOTHING]])
    out = np.empty_like(grid)
    for i, step in enumerate(grid):
        out[i] = state
        state = moves[step, state]
    return out.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, where tokens begin, as byte offsets into its UTF-8 form, with its length at the end.

    Many texts go through one scan, each followed by an END.
    """
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and size < _AT_ONCE:
            some += [np.frombuffer(texts[at].encode("utf-32-le"), "<u4"), np.array([_STOP], "<u4")]
            size += len(some[-2]) + 1
            at += 1
        points = np.concatenate(some)
        kinds = _kinds(points)
        begins = BEGINS[_states(kinds), kinds]
        widths = (points < _STOP).astype(np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        widths[points == _STOP] = 0
        starts = np.cumsum(widths) - widths
        stops = np.flatnonzero(points == _STOP)
        cuts = np.flatnonzero(begins)  # an END always begins something: it closes its text
        first = 0
        for last in np.searchsorted(cuts, stops):
            yield starts[cuts[first : last + 1]] - starts[cuts[first]]
            first = last + 1


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank is joined first, of equal ones the leftmost."""
    if piece in table:
        return [table[piece]]
    return _merge_short(piece, table) if len(piece) <= 100 else _merge_long(piece, table)


def _merge_short(piece: bytes, table: dict[bytes, int]) -> list[int]:
    get, none = table.get, 1 << 40
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) < none:
        i = pairs.index(lowest)
        parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, none)
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], none)
    return [table[x] for x in parts]


def _merge_long(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """The same by a heap over linked parts, which keeps very long slices at n log n."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := table.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (rank := table.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (p := before[i]) >= 0 and (rank := table.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (rank, p, stop))
    return [table[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts with a cache of merged slices that is emptied when it grows too large."""

    def __init__(self, path: str, most_cached: int = 500_000):
        self.table, self.cache, self.most = ranks(path), {}, most_cached

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (ids, byte offset at which each id's bytes begin)."""
        for text, cuts in zip(texts, boundaries(texts)):
            yield self._slices(text.encode("utf-8"), cuts.tolist())

    def _slices(self, raw: bytes, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        cache, table = self.cache, self.table
        if len(cache) > self.most:
            cache.clear()
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            piece = raw[a:b]
            found = cache.get(piece)
            if found is None:
                found = merge(piece, table)
                if b - a <= 64:
                    cache[piece] = found
            ids += found
        numbers = np.array(ids, "<u4")
        widths = vocabulary_widths(table)[numbers]
        return numbers, (np.cumsum(widths) - widths).astype("<u4")


_WIDTHS: dict[int, np.ndarray] = {}


def vocabulary_widths(table: dict[bytes, int]) -> np.ndarray:
    """Bytes of each id, made once for each table."""
    if id(table) not in _WIDTHS:
        widths = np.zeros(max(table.values()) + 1, np.int64)
        widths[list(table.values())] = [len(piece) for piece in table]
        _WIDTHS[id(table)] = widths
    return _WIDTHS[id(table)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps its cache from task to task."""
    return Encoder(path)


def _encode_batches(path: str, at: int, names: list[str]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            done = list(encoder.encode(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for i, c in enumerate(batch.columns) if i != at),
                    pa.array([len(i) for i, _ in done], pa.int64()),
                    pa.array([i.tobytes() for i, _ in done], pa.binary()),
                    pa.array([o.tobytes() for _, o in done], pa.binary()),
                ],
                names=names,
            )

    return encoded


def encode(
    docs: DataFrame, path: str, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",),
    n_tokens: str = "n_tokens", ids: str = "ids", offsets: str = "offsets",
) -> DataFrame:
    """The columns ``carry`` and, of each row's whole text, the number of tokens, the ids and their offsets.

    A null text counts as empty and has no ids. ``ids`` and ``offsets`` are binary: 32-bit unsigned little-endian
    numbers, in order; an offset is the byte of the UTF-8 text at which the id's bytes begin. One row for each
    row of ``docs``, in tasks of its own: repeated rows, null ids and other columns don't matter. A text must be
    below 4 GB.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*carry, text_or_empty(text_column).alias(free_name(docs, "text_to_encode")))
    step = _encode_batches(path, len(carry), [*carry, n_tokens, ids, offsets])
    schema = with_columns(docs.select(*carry), **{n_tokens: "long", ids: "binary", offsets: "binary"})
    return rows.mapInArrow(returning_memory(step), schema)


def _decode_batches(path: str, ids: str, offsets: str | None, names: list[str]):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        pieces = np.empty(max(table.values()) + 1, object)
        for piece, i in table.items():
            pieces[i] = piece
        widths = vocabulary_widths(table)
        for batch in batches:
            out = []
            kept = batch.column(offsets).to_pylist() if offsets else [None] * batch.num_rows
            for raw, at in zip(batch.column(ids).to_pylist(), kept):
                numbers = np.frombuffer(raw or b"", "<u4")
                if at is not None:
                    begins = np.cumsum(widths[numbers]) - widths[numbers]
                    if not np.array_equal(begins, np.frombuffer(at, "<u4")):
                        raise ValueError("offsets don't fit the ids")
                out.append(b"".join(pieces[numbers].tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return decoded


def decode(
    rows: DataFrame, path: str, ids: str = "ids", offsets: str | None = "offsets", decoded: str = "decoded"
) -> DataFrame:
    """``rows`` with the bytes that each row's ids stand for; null ids give no bytes.

    With ``offsets`` the kept offsets must agree with the ids, or the job fails.
    """
    bounded_batches(rows.sparkSession)
    names = [*rows.columns, decoded]
    step = _decode_batches(path, ids, offsets, names)
    return rows.mapInArrow(returning_memory(step), with_columns(rows, **{decoded: "binary"}))


def round_trip(
    docs: DataFrame, path: str, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``decode(encode(docs))`` in one step: ``carry``, n_tokens, ids, offsets and decoded.

    Each batch is decoded by the Python worker that encoded it, so that neither texts nor ids pass through the
    JVM in between and a task needs one worker.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*carry, text_or_empty(text_column).alias(free_name(docs, "text_to_encode")))
    coded = [*carry, "n_tokens", "ids", "offsets"]
    encoded = _encode_batches(path, len(carry), coded)
    decoded = _decode_batches(path, "ids", "offsets", [*coded, "decoded"])
    schema = with_columns(docs.select(*carry), n_tokens="long", ids="binary", offsets="binary", decoded="binary")
    return rows.mapInArrow(returning_memory(lambda batches: decoded(encoded(batches))), schema)
