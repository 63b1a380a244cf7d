"""Byte-level BPE that encodes chunks shared across documents once.

A rolling hash over code points cuts each text into chunks wherever the last 32 of them hash to a given pattern, so equal
passages are cut alike wherever they stand. Documents are brought into the order of their smallest chunk hash, which puts
copies and near copies next to each other without gathering any group in one task; each task encodes a chunk when it
first meets it and takes it from its dictionary, found by the whole chunk's text, when it comes again.

A chunk's own encoding is right except near its ends, where a token of the text may reach over the cut or depend on what
follows it. Behind a visible character and in front of white space a token always ends, whatever else the text holds: no
alternative of the pattern crosses such a place, and none looks beyond it. So from a chunk's first such place to
its last its ids are those of the text. What lies between two of these parts, the join, is put together
again from the chunks' texts, widened to the next such place on either side, over whole chunks where
need be, and encoded anew: there both encodings agree on where tokens begin.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.llm.common import bounded_batches, free_name, returning_memory, text_or_empty, with_columns

# Fixed: the pre-tokeniser's pattern, with the Unicode property for white space.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Where a token ends whatever surrounds it: a visible character, then white space.
_SURE = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
LEAST_CHUNK, CHUNK_BITS = 64, 8
_LONGEST = 4096  # longer texts are not kept in a dictionary
_NEVER = 1 << 40  # a rank behind all others
_ID = (1 << 32) - 1


def _hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the 32 code points that end at each place: multipliers, each shifted out after 32 steps."""
    h = points * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    for bits in (1, 2, 4, 8, 16):
        shifted = h[:-bits] << np.uint32(bits)
        h[bits:] += shifted
    return h


def cuts(text: str) -> list[int]:
    """Where the chunks of a text begin, without 0 and in order."""
    if len(text) <= LEAST_CHUNK:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    places = np.flatnonzero(_hashes(points) >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    out, last = [], 0
    for place in places.tolist():
        if place - last >= LEAST_CHUNK and place < len(text):
            out.append(place)
            last = place
    return out


def smallest_chunk(text: str) -> int:
    """The smallest checksum of a text's chunks: equal for copies, and mostly for near copies."""
    edges = [0, *cuts(text), len(text)]
    return min(zlib.crc32(text[a:b].encode()) for a, b in zip(edges, edges[1:]))


class Vocabulary:
    """Ids and merges of a tokeniser file: byte-level BPE with added tokens taken out of the text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, split = whole["model"], whole["pre_tokenizer"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if whole["normalizer"] or any(split.get(k) != v for k, v in plain.items()):
            raise ValueError("texts must be split by the byte-level pattern, unchanged")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c in _white() for c in t["content"]) for t in whole["added_tokens"]):
            raise ValueError("an added token must neither hold white space nor depend on what surrounds it")
        letters = _byte_letters()
        self.bytes_of = {letter: byte for byte, letter in enumerate(letters)}
        self.pieces = np.empty(max([*model["vocab"].values(), *(t["id"] for t in whole["added_tokens"])]) + 1, object)
        for token, i in model["vocab"].items():
            self.pieces[i] = bytes(self.bytes_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.single = np.array([model["vocab"][c] for c in letters])
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # One number for each merge: its rank, then the id that it makes.
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        made = {merge & _ID: merge >> 32 for merge in self.merges.values()}
        if any(max(made.get(a, -1), made.get(b, -1)) >= merge >> 32 for (a, b), merge in self.merges.items()):
            raise ValueError("a merge stands in front of one that it needs")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None

    @cached_property
    def _sorted_merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids as numbers, ascending, with rank and joined id; a last pair that is none."""
        size = len(self.pieces)
        rows = sorted((a * size + b, merge >> 32, merge & _ID) for (a, b), merge in self.merges.items())
        return tuple(np.array(column, np.int64) for column in zip(*rows, (size * size, _NEVER, 0)))

    def _ranks(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, ranks, joined = self._sorted_merges
        pair = ids[at] * len(self.pieces) + ids[at + 1]
        found = np.searchsorted(keys, pair)
        return np.where(keys[found] == pair, ranks[found], _NEVER), joined[found]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as bytes: its pair of lowest rank is joined first, of equal ones the leftmost.

        All pieces take a step at once. A step joins all places of a piece's lowest rank: joining a pair makes only pairs
        of later merges, so none of an earlier rank appears meanwhile.
        """
        done: list[bytes] = [b""] * len(pieces)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank, joined = np.full(len(ids), _NEVER), np.zeros(len(ids), np.int64)
        changed = np.flatnonzero(owner[:-1] == owner[1:])
        while len(ids):
            rank[changed], joined[changed] = self._ranks(ids, changed)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            lowest = np.minimum.reduceat(rank, first)
            ready = lowest == _NEVER
            if ready.any():
                out = ids.astype("<u4").tobytes()
                for who, start, size in zip(owner[first[ready]].tolist(), first[ready].tolist(), sizes[ready].tolist()):
                    done[who] = out[4 * start : 4 * (start + size)]
                going = np.repeat(~ready, sizes)
                ids, owner, rank, joined = ids[going], owner[going], rank[going], joined[going]
                lowest, sizes = lowest[~ready], sizes[~ready]
                if not len(ids):
                    break
            places = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of overlapping places every second one counts, from the left.
            group = np.cumsum(np.append(True, np.diff(places) > 1))
            places = places[(np.arange(len(places)) - np.searchsorted(group, group)) % 2 == 0]
            ids[places] = joined[places]
            stay = np.ones(len(ids), bool)
            stay[places + 1] = False
            moved = np.cumsum(stay) - 1
            ids, owner, rank, joined = ids[stay], owner[stay], rank[stay], joined[stay]
            here = moved[places]
            rank[here] = _NEVER
            near = np.zeros(len(ids) + 1, bool)
            near[here] = near[here - 1] = True  # in front of the first stands the spare place at the end
            around = np.flatnonzero(near[: len(ids) - 1])
            rank[around] = _NEVER
            changed = around[owner[around] == owner[around + 1]]
        return done


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Recent:
    """Values by text, forgotten when not asked for since the dictionary last filled up."""

    def __init__(self, most: int, make: Callable[[list[str]], list]):
        self.most, self.make = most, make
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, keys: set[str]) -> dict:
        """A dictionary with all of ``keys``, those not known made together."""
        if len(self.young) > self.most:
            self.old, self.young = {k: v for k, v in self.young.items() if len(k) <= _LONGEST}, {}
        missing = list(keys.difference(self.young))
        again = [k for k in missing if k in self.old]
        self.young.update(zip(again, map(self.old.get, again)))
        fresh = [k for k in missing if k not in self.old]
        self.young.update(zip(fresh, self.make(fresh)))
        return self.young


class ChunkEncoder:
    """Encodes texts chunk by chunk, ids as bytes of 32-bit numbers; its dictionaries keep what came up recently."""

    def __init__(self, path: str, most_chunks: int = 20_000, most_words: int = 200_000):
        self.vocabulary = Vocabulary(path)
        self.chunks = Recent(most_chunks, self._chunks)
        self.words = Recent(most_words, self._words)  # behind one space
        self.units = Recent(most_words // 4, self._units)
        self.pieces = Recent(most_words, lambda pieces: self.vocabulary.merge([p.encode() for p in pieces]))
        self.characters = self.encoded = 0  # seen, and encoded anew

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they stand."""
        self.encoded += sum(map(len, texts))
        special = self.vocabulary.special
        marked = [bool(special and special.search(t)) for t in texts]
        out = iter(self._ordinary([t for t, m in zip(texts, marked) if not m]))
        return [self._marked(t) if m else next(out) for t, m in zip(texts, marked)]

    def _marked(self, text: str) -> bytes:
        """Ids of a text with added tokens."""
        found = list(self.vocabulary.special.finditer(text))
        edges = [0, *(e for m in found for e in m.span()), len(text)]
        between = self._ordinary([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
        marks = [self.vocabulary.added[m.group()].to_bytes(4, "little") for m in found] + [b""]
        return b"".join(x for pair in zip(between, marks) for x in pair)

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        # A space behind a visible character is a sure place, so words between such spaces are encoded on their own.
        split = [t.split(" ") for t in texts]
        wanted: set[str] = set()
        for parts in split:
            wanted.update(parts[1:])
        words = self.words.ready(wanted)
        out: list = []
        whole = set()
        for text, (first, *rest) in zip(texts, split):
            found = list(map(words.get, rest))
            if None in found or (rest and first and first[-1] in _white()):
                whole.add(text)
                out.append(None)
            else:
                whole.add(first)
                out.append((first, found))
        units = self.units.ready(whole)
        return [units[t] if o is None else b"".join([units[o[0]], *o[1]]) for t, o in zip(texts, out)]

    def _words(self, words: list[str]) -> list[bytes | None]:
        """Ids of words behind a space; None for those that white space touches, whose space is in no sure place."""
        white = _white()
        ids = self._units([f" {w}" for w in words])
        return [i if w and w[0] not in white and w[-1] not in white else None for w, i in zip(words, ids)]

    def _units(self, units: list[str]) -> list[bytes]:
        parts = [PIECES.findall(u) for u in units]
        known = self.pieces.ready(set(chain.from_iterable(parts)))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def _chunks(self, chunks: list[str]) -> list[tuple[int, int, bytes]]:
        """(first sure place, last sure place, ids in between) of each chunk; (-1, -1, none) without a sure place."""
        white = _white()
        places = []
        for text in chunks:
            first = _SURE.search(text)
            if first is None:
                places.append((-1, -1))
                continue
            stop = len(text) - 1
            while not (text[stop] in white and text[stop - 1] not in white):
                stop -= 1
            places.append((first.start(), stop))
        ids = iter(self.plain([t[a:b] for t, (a, b) in zip(chunks, places) if a >= 0]))
        return [(a, b, next(ids) if a >= 0 else b"") for a, b in places]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        self.characters += sum(map(len, texts))
        edges = [[0, *cuts(t), len(t)] for t in texts]
        chunked = [[t[a:b] for a, b in zip(e, e[1:])] if len(e) > 2 else [] for t, e in zip(texts, edges)]
        known = self.chunks.ready(set(chain.from_iterable(chunked)))
        parts: list[list[bytes]] = []
        joins: list[str] = []
        for text, at, chunks in zip(texts, edges, chunked):
            mine, settled = [], 0  # up to there the ids are the text's
            for begin, chunk in zip(at, chunks):
                start, stop, ids = known[chunk]
                if start >= 0:
                    joins.append(text[settled : begin + start])
                    mine.append(ids)
                    settled = begin + stop
            joins.append(text[settled:])
            parts.append(mine)
        joined = iter(self.plain(joins))
        return [b"".join([next(joined), *(x for ids in mine for x in (ids, next(joined)))]) for mine in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.vocabulary.pieces[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _white() -> frozenset[str]:
    """The characters with the Unicode property White_Space."""
    return frozenset(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, which keeps its dictionaries from task to task."""
    return ChunkEncoder(path)


def _coded_batches(path: str, at: int, names: list[str]):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids = encoder.encode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for i, c in enumerate(batch.columns) if i != at),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([encoder.decode(i) for i in ids], pa.string()),
                ],
                names=names,
            )

    return coded


@F.pandas_udf(T.LongType())
def _smallest_chunk(texts: pd.Series) -> pd.Series:
    return texts.map(smallest_chunk).astype("int64")


def by_shared_chunks(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` in the order of each text's smallest chunk hash, in ranges; equal hashes may lie in several ranges."""
    key, salt = free_name(docs, "smallest_chunk"), free_name(docs, "salt")
    keyed = docs.withColumn(key, _smallest_chunk(F.col(text_column))).withColumn(salt, F.monotonically_increasing_id())
    return keyed.repartitionByRange(key, salt).sortWithinPartitions(key).drop(key, salt)


def round_trip(
    docs: DataFrame, path: str, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",),
    n_tokens: str = "n_tokens", ids: str = "ids", decoded: str = "decoded",
) -> DataFrame:
    """The columns ``carry`` and, of each row's whole text, the number of tokens, their ids and the text decoded from them.

    ``path`` is a tokeniser file with a byte-level BPE model; strings of its added tokens in a text are
    these tokens, and no others are added. ``ids`` is binary: 32-bit unsigned little-endian numbers, in order. A null text
    counts as empty and has no ids. One row for each row of ``docs``: repeated rows, null ids and other columns don't
    matter, and an empty table gives an empty one. A chunk is encoded once for each task that meets it, unless
    the task's dictionary was emptied in between, which bounds its memory; ids do not depend on that.
    """
    bounded_batches(docs.sparkSession)
    text = free_name(docs, "text_to_encode")
    rows = by_shared_chunks(docs.select(*carry, text_or_empty(text_column).alias(text)), text)
    step = _coded_batches(path, len(carry), [*carry, n_tokens, ids, decoded])
    schema = with_columns(docs.select(*carry), **{n_tokens: "long", ids: "binary"}).add(decoded, T.StringType())
    return rows.mapInArrow(returning_memory(step), schema)
