"""Fuzzy line deduplication by MinHash.

Lines become sets of character shingles, signatures of ``BANDS`` x ``ROWS`` minima over salted hashes, and band
keys of high recall. Lines that share a band are compared by their exact Jaccard similarity, and a
distributed union-find turns verified links into components, of which one line stays. Equal lines enter the search
once, however often they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.llm.common import bounded_batches, free_name, free_shuffles, frozen, numbered, text_or_empty
from loglens.llm.linking import planes, similar_components, sketches
from loglens.llm.near_dedup import band_keys, best_of, compared, grouped, mixed

CHARS, SIMILARITY = 7, 0.8
BANDS, ROWS = 14, 5
#: Hashes of the longer signatures that decide which unsettled lines are compared.
SLOTS = 512
_STEP = 1 << 15
_BASE = np.uint64(0x100000001B3)
#: Seven characters with code points below this are one 64-bit number.
_NARROW = (1 << 9) - 1
_SEEN = 200_000
#: What Java's ``\\s``, ``\\p{Z}`` and the next-line character are; a line of these alone is blank.
BLANK = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Band keys travel packed, without the bits that say which part they are in: five bytes, and eight of the node.
_KEY_BITS, _KEY_BYTES, _ENTRY = 40, 5, 13
#: Entries of a part, entries that a task packs at once, and lines that it signs at once.
_PART, _PACKED, _AT_ONCE = 1_000_000, 2_000_000, 20_000
#: Bits of the filter for each line that is looked for; two of them are set.
_FILTER_BITS = 16
#: A line's node is made of the two halves of its checksum, in the first of these ways that gives no two lines the same one.
NODES: dict[str, Callable] = {"first": lambda a, b: a, "second": lambda a, b: b, "both": lambda a, b: a ^ b}


def plain(line: str) -> str:
    """What is compared: lower case, white space as single blanks."""
    line = line.lower()
    if line.isprintable() and "  " not in line:  # blanks are its only white space
        return line.strip(" ")
    return " ".join(line.split())


def shingles(line: str) -> set[str]:
    """Runs of ``CHARS`` characters; a shorter line is one."""
    line = plain(line)
    return {line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def _salts(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | 1


def minima(lines: list[str], n: int = BANDS * ROWS) -> np.ndarray:
    """(lines, n): the least salted hash of each line's shingles; the first ones are the same for any ``n``."""
    texts = [plain(x) for x in lines]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # Behind each line as many zeros as make a short line one whole shingle, and no shingle run into the next line.
    points = np.frombuffer(("\0" * CHARS).join([*texts, ""]).encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum(lengths + CHARS)[:-1]])
    sizes = np.maximum(1, lengths - CHARS + 1)
    n_points = len(points) - CHARS + 1
    mixed_points = np.empty(n_points, np.uint32)
    for begin in range(0, n_points, _STEP):
        one = points[begin : begin + _STEP + CHARS - 1].astype(np.uint64)
        two = one[:-1] * _BASE + one[1:]
        four = two[:-2] * _BASE**2 + two[2:]
        seven = four[:-3] * _BASE**3 + two[4:-1] * _BASE + one[6:]
        mixed_points[begin : begin + _STEP] = mixed(seven) >> np.uint64(32)
    step = np.zeros(n_points + 1, np.int8)
    step[starts] = 1
    step[starts + sizes] = -1
    hashes = mixed_points[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.full((n, len(lines)), 0xFFFFFFFF, np.uint32)
    # Stretches small enough for the processor's cache, each with the lines it touches.
    salted = np.empty(_STEP, np.uint32)
    for begin in range(0, len(hashes), _STEP):
        part = hashes[begin : begin + _STEP]
        now = salted[: len(part)]
        lo = np.searchsorted(starts, begin, "right") - 1
        hi = np.searchsorted(starts, begin + len(part), "left")
        at = np.maximum(starts[lo:hi] - begin, 0)
        for row, salt in zip(out, _salts(n)):
            np.bitwise_xor(part, salt >> 1, out=now)
            np.multiply(now, salt, out=now)
            np.minimum(row[lo:hi], np.minimum.reduceat(now, at), out=row[lo:hi])
    return np.ascontiguousarray(out.T)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.reshape(-1))


def _lines(texts: list[str]) -> tuple[list[int], list[int], list[str]]:
    """Lines that are not blank: each one's text, its number there, and itself."""
    found = [(i, n, x) for i, text in enumerate(texts) for n, x in enumerate(text.split("\n")) if x.strip(BLANK)]
    return tuple(map(list, zip(*found))) if found else ([], [], [])


def _checksums(lines: list[str]) -> list[bytes]:
    return [md5(x.encode(), usedforsecurity=False).digest() for x in lines]


def _halves(checksums: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(checksums), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, numbers, lines = _lines(batch.column(2).to_pylist())
        a, b = _halves(_checksums(lines))
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(a), pa.array(b)],
            names=["row", "doc_id", "line_no", "a", "b"],
        )


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Batch by batch the checksums and lines that this task has not met lately."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > _SEEN:
            seen.clear()
        lines = _lines(batch.column(0).to_pylist())[2]
        new = {key: x for key, x in zip(_checksums(lines), lines) if key not in seen}
        seen.update(new)
        if new:
            yield list(new), list(new.values())


def _buckets(found: np.ndarray, parts: int) -> np.ndarray:
    """(lines, BANDS): the buckets of signatures; what is above ``_KEY_BITS`` is the part, below ``parts``."""
    return (band_keys(found.astype(np.uint64), BANDS).view(np.uint64) % np.uint64(parts << _KEY_BITS)).view(np.int64)


def _pack(buckets: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """One row for each part: its number and its entries."""
    order = np.argsort(buckets >> _KEY_BITS, kind="stable")
    buckets, nodes = buckets[order], nodes[order]
    entries = np.empty((len(buckets), _ENTRY), np.uint8)
    entries[:, :_KEY_BYTES] = buckets.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
    entries[:, _KEY_BYTES:] = nodes.astype("<i8").view(np.uint8).reshape(-1, 8)
    parts, first = np.unique(buckets >> _KEY_BITS, return_index=True)
    ends = (np.append(first, len(buckets)) * _ENTRY).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(entries)])
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), packed], names=["part", "entries"])


def _signing(parts: int, node: str):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for checksums, lines in _unseen(batches):
            nodes = NODES[node](*_halves(checksums))
            for begin in range(0, len(lines), _AT_ONCE):
                buckets = _buckets(minima(lines[begin : begin + _AT_ONCE]), parts)
                waiting.append((buckets.reshape(-1), np.repeat(nodes[begin : begin + _AT_ONCE], BANDS)))
                size += buckets.size
                if size > _PACKED:
                    yield _pack(*map(np.concatenate, zip(*waiting)))
                    waiting, size = [], 0
        if waiting:
            yield _pack(*map(np.concatenate, zip(*waiting)))

    return sign


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their parts: the buckets of two or more different nodes."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for part, own in groupby(rows, lambda row: row[0]):
        entries = np.frombuffer(b"".join(packed for _, packed in own), np.uint8).reshape(-1, _ENTRY)
        keys = np.zeros((len(entries), 8), np.uint8)
        keys[:, :_KEY_BYTES] = entries[:, :_KEY_BYTES]
        keys = keys.view("<i8")[:, 0]
        order = np.argsort(keys)
        keys = keys[order]
        again = keys[1:] == keys[:-1]
        some = np.append(again, False) | np.append(False, again)
        keys, nodes = keys[some], np.ascontiguousarray(entries[order[some], _KEY_BYTES:]).view("<i8")[:, 0]
        order = np.lexsort((nodes, keys))  # copies of a line lie in its buckets once for each task that met them
        keys, nodes = keys[order], nodes[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
        keys, nodes = keys[new], nodes[new]
        _, at, members = np.unique(keys, return_inverse=True, return_counts=True)
        members = members[at]
        some = members > 1
        buckets = keys[some] | np.int64(part << _KEY_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets), pa.array(nodes[some]), pa.array(members[some], pa.int64())], names=["bucket", "node", "members"]
        )


def _places(nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return nodes % bits, (nodes >> 17) % bits


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bit map that holds two bits of each of ``nodes``, a stored table; about one line in seventy gets past it by chance."""
    words = max(1, nodes.count() * _FILTER_BITS // 64)
    bits = words * 64
    places = nodes.select(F.explode(F.array(F.pmod("node", F.lit(bits)), F.pmod(F.shiftright("node", 17), F.lit(bits)))).alias("place"))
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")
    ).toArrow()
    out = np.zeros(words, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _holding(filter_of, node: str):
    """The lines whose nodes the broadcast filter lets pass."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_of.value
        for checksums, lines in _unseen(batches):
            nodes = NODES[node](*_halves(checksums))
            one, two = ((words[x >> 6] >> (x & 63)) & 1 for x in _places(nodes, len(words) * 64))
            some = np.flatnonzero(one & two)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array([lines[i] for i in some.tolist()], pa.string())], names=["node", "text"]
            )

    return hold


def _sketching(parts: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = minima(batch.column(1).to_pylist(), SLOTS)
            bands = _buckets(found[:, : BANDS * ROWS], parts)
            words = planes(sketches(mixed(found.astype(np.uint64) + np.uint64(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bands), _lists(words)], names=["node", "bands", "sketch"])

    return sketch


def _coded(texts: list[str]) -> list[np.ndarray]:
    """Each text's different shingles as sorted numbers; its characters lie below ``_NARROW``, nine bits for each."""
    points = np.frombuffer(("\0" * CHARS).join([*texts, ""]).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + CHARS)[:-1]])
    n = len(points) - CHARS + 1
    codes = np.zeros(n, np.uint64)
    for i in range(CHARS):
        codes <<= np.uint64(9)
        codes |= points[i : i + n]
    found = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        if length < CHARS:  # a shingle of its own length, with zeros in front
            found.append(codes[start : start + 1] >> np.uint64(9 * (CHARS - length)))
            continue
        own = np.sort(codes[start : start + length - CHARS + 1])
        found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        _, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
        texts = [plain(x) for x in pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)).to_pylist()]
        narrow = [i for i, x in enumerate(texts) if x.isascii() or ord(max(x)) < _NARROW]
        sets = dict(zip(narrow, _coded([texts[i] for i in narrow]))) if narrow else {}
        found = []
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            if i in sets and j in sets:
                all_of = np.concatenate([sets[i], sets[j]])
                all_of.sort()
                both, total = int(np.count_nonzero(all_of[1:] == all_of[:-1])), len(all_of)
            else:
                x, y = shingles(texts[i]), shingles(texts[j])
                both, total = len(x & y), len(x) + len(y)
            found.append(both / (total - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )


def _classes(listed: DataFrame, order: list) -> tuple[str, DataFrame, DataFrame]:
    """How nodes are made, the lines with theirs as ``key``, and the classes of equal lines, stored."""
    made = {"first": F.col("a"), "second": F.col("b"), "both": F.col("a").bitwiseXOR(F.col("b"))}
    for node, key in made.items():
        keyed = listed.select("row", "doc_id", "line_no", key.alias("key"), F.col("b" if node == "first" else "a").alias("other"))
        classes = frozen(best_of(keyed, order, F.min("other").alias("least"), F.max("other").alias("most")), "classes")
        if classes.filter("least < most").isEmpty():
            return node, keyed.drop("other"), classes.drop("least", "most")
    raise ValueError("different lines have the same node in every way of making it")


def line_groups(
    docs: DataFrame, row: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every line that is not blank, with its group: row, doc_id, line_no, keep_id, keep_line, group_size, kept.

    Lines end at line feeds and are numbered from 0. Two lines are linked when their sets of seven-character shingles (lower
    case, white space as single blanks) have a Jaccard similarity of 0.8 or more, a shorter line being a
    single shingle; a group is a connected component. The line of the smallest id (null ids last), then of the first row, then the first
    line stays. Blank lines take no part; null and empty texts have no lines. Repeated rows have lines of their own. Other
    columns play no part; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(id_column).alias("doc_id"),
        text_or_empty(text_column).alias("text"),
    )
    schema = T.StructType([
        *rows.drop("text").schema.fields, T.StructField("line_no", T.IntegerType()),
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
    ])
    listed = frozen(rows.mapInArrow(_list, schema), "lines")
    order = [F.col("doc_id").isNull(), "doc_id", "row", "line_no"]
    node, listed, classes = _classes(listed, order)
    free_shuffles(spark)

    parts = max(64, listed.count() * BANDS // _PART)
    signed = rows.select("text").mapInArrow(_signing(parts, node), "part long, entries binary")
    together = signed.repartition(parts, "part").sortWithinPartitions("part")
    buckets = frozen(together.mapInArrow(_share, "bucket long, node long, members long").withColumn("weight", F.lit(1)), "buckets")
    free_shuffles(spark)
    wanted = frozen(buckets.select("node").distinct(), "wanted")
    held = _holding(spark.sparkContext.broadcast(_filter(wanted)), node)
    texts = rows.select("text").mapInArrow(held, "node long, text string").join(wanted, "node", "left_semi").distinct()
    texts = frozen(texts, "texts")
    free_shuffles(spark)
    found = similar_components(
        buckets,
        lambda nodes: texts.join(nodes, "node", "left_semi").mapInArrow(
            _sketching(parts), "node long, bands array<long>, sketch array<long>"
        ),
        lambda pairs: compared(pairs, texts, _compare), 0.0, SLOTS, SIMILARITY,
    )
    found = frozen(found.select(F.col("node").alias("key"), F.col("component").alias("group")), "groups")
    return grouped(listed, classes, found, order)


def drop_near_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, its texts without the lines that are not kept; blank lines stay."""
    rows, row = numbered(docs)
    marked = line_groups(rows, row, id_column, text_column).filter(~F.col("kept"))
    gone_name = free_name(rows, "lines_gone")
    gone = frozen(
        marked.groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone_name)), "lines_gone"
    )
    keep = F.array_join(
        F.filter(F.split(F.col(text_column), "\n"), lambda x, i: ~F.array_contains(gone_name, i)), "\n"
    )
    text = F.when(F.col(gone_name).isNull(), F.col(text_column)).otherwise(keep)
    return rows.join(gone, row, "left").withColumn(text_column, text).drop(row, gone_name)
