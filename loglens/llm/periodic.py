"""Periodic runs of words: where a text repeats itself word for word.

A run is a stretch of consecutive words with smallest period q whose length is at least ``least`` words and
``repeats`` periods, and which no neighbouring word extends keeping that period. Every word of a run occurs at least
``repeats`` times in it, so a word that is rarer than that within its segment cannot belong to one: it splits the
segment, which makes further words rare in the pieces, and so on until nothing changes. In ordinary prose
hardly a segment survives this. Surviving segments are scanned lag by lag: words that equal the one a lag
later form stretches, and as a run's stretch has a known least length, one position in that many is looked at.

All texts of an Arrow batch are split and scanned together as arrays; a text is never cut. Work for a surviving
segment of n words is about n log n comparisons beside the lengths of the runs found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loglens.llm.common import bounded_batches, free_name, returning_memory, text_or_empty

LEAST, REPEATS = 12, 2
_TRIED = 3  # words next to an equal pair that are compared for all pairs at once

Run = tuple[int, int, int]  # start, length, period


def surviving_segments(words: np.ndarray, texts: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the segments without a word too rare in its segment to be in a run.

    ``words`` are word numbers of all texts in order, ``texts`` the number of each word's text.
    """
    order = np.argsort(words, kind="stable").astype(np.int64)  # by word, then by position
    segment = texts.astype(np.int64)
    alive = np.ones(len(words), bool)
    while len(order):
        same = words[order]
        place = segment[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (same[1:] != same[:-1]) | (place[1:] != place[:-1])
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(order)))
        enough = np.repeat(counts >= repeats, counts)
        sizes = np.bincount(place)
        enough &= sizes[place] >= least
        if enough.all():
            break
        alive[order[~enough]] = False
        order = order[enough]
        # Segments anew: what is alive and adjacent within one text belongs together.
        edge = np.zeros(len(words), bool)
        edge[0] = True
        edge[1:] = ~alive[:-1] | (texts[1:] != texts[:-1])
        segment = np.cumsum(edge)
    at = np.flatnonzero(alive)
    if not len(at):
        return at, at
    gap = (np.diff(at) > 1) | (np.diff(texts[at]) != 0)
    return at[np.append(True, gap)], at[np.append(gap, True)] + 1


def _agreeing(a: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j > i on; a last word of its own ends every stretch."""
    n, step = 0, 32
    while True:
        x, y = a[i + n : i + n + step], a[j + n : j + n + step]
        differ = x[: len(y)] != y
        k = int(differ.argmax()) if len(y) else 0
        if len(y) == 0 or differ[k]:
            return n + k
        n += len(y)
        step *= 2


def lag_scan(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int, repeats: int) -> Iterator[Run]:
    """The runs within the segments [start, stop) of ``words``, positions as in ``words``."""
    by_length = np.argsort(starts - stops, kind="stable")
    starts, stops = starts[by_length], stops[by_length]
    lengths = stops - starts
    # The segments side by side, each followed by words that equal nothing.
    begins = np.cumsum(np.append(_TRIED, lengths[:-1] + _TRIED))
    size = int(lengths.sum()) + _TRIED * (len(lengths) + 1)
    a = -1 - np.arange(size, dtype=np.int64)
    inside = np.repeat(begins - starts, lengths)
    origin = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(int(lengths.sum()))
    a[origin + inside] = words[origin]
    back = a[::-1]
    covered = np.zeros(size, np.int64)  # end of a run over this position, and its period
    period = np.ones(size, np.int64)
    known: set[tuple[int, int]] = set()
    shift = begins - starts
    lag = 0
    active = len(lengths)
    while True:
        lag += 1
        need = max(least, repeats * lag)
        while active and lengths[active - 1] < need:
            active -= 1
        if not active:
            return
        window = need - lag  # a run has at least so many neighbouring pairs, so one of each so many is looked at
        counts = (lengths[:active] - lag) // window
        ends = np.cumsum(counts)
        total = int(ends[-1])
        nth = np.arange(total) - np.repeat(ends - counts, counts)
        at = np.repeat(begins[:active] + window - 1, counts) + nth * window
        at = at[a[at] == a[at + lag]]
        if not len(at):
            continue
        # Within a run whose period divides the lag there is nothing new.
        at = at[~((at + lag < covered[at]) & (lag % period[at] == 0))]
        tried = min(_TRIED, (window - 1) // 2)
        if tried and len(at):
            right, left = np.ones(len(at), bool), np.ones(len(at), bool)
            for t in range(1, tried + 1):
                right &= a[at + t] == a[at + t + lag]
                left &= a[at - t] == a[at - t + lag]
            at = at[right | left]
        done = -1
        for i in at.tolist():
            if i < done:
                continue
            right = _agreeing(a, i, i + lag)
            left = _agreeing(back, size - i - lag, size - i)
            done = i + right
            if left + right < window:
                continue
            start, length = i - left, left + right + lag
            if (start, length) in known:  # a smaller period has it
                continue
            known.add((start, length))
            stretch = slice(start, start + length)
            better = covered[stretch] < start + length
            covered[stretch][better] = start + length
            period[stretch][better] = lag
            holder = int(np.searchsorted(begins, start, side="right")) - 1
            yield start - int(shift[holder]), length, lag


def runs_of(texts: list[list], least: int = LEAST, repeats: int = REPEATS) -> list[list[Run]]:
    """For each list of words its runs (start, length, period), by start, then by period."""
    numbers: dict = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, total)
    offsets = np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, stops = surviving_segments(words, owner, least, repeats)
    if len(starts):
        for start, length, lag in lag_scan(words, starts, stops, least, repeats):
            text = int(owner[start])
            found[text].append((start - int(offsets[text]), length, lag))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats behind its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, lag in runs:
        keep[start + lag : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _scan_batches(at: int, names: list[str], least: int, repeats: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bytes are split at exactly the six ASCII white space characters.
            words = [t.as_buffer().to_pybytes().split() for t in batch.column(at)]
            found = runs_of(words, least, repeats)
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS.value_type)),
            )
            texts = [b" ".join(collapsed(w, r)) for w, r in zip(words, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for i, c in enumerate(batch.columns) if i != at), pa.array([len(w) for w in words], pa.int64()),
                    runs.cast(_RUNS), pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=names,
            )

    return scanned


def periodic_runs(
    docs: DataFrame, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",), least: int = LEAST,
    repeats: int = REPEATS, n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """The columns ``carry`` and, of each row's whole text, the number of words, all runs and the collapsed text.

    Words are what stands between the characters U+0009 to U+000D and U+0020, numbered from 0. ``runs`` is an array of
    (start, length, period) by start, then period. ``collapsed`` joins by one space the words that no run holds
    behind its first period. A null text counts as empty: no words, no runs, an empty collapsed text. One row for
    each row of ``docs``, found from that row alone: repeated rows, null ids and other columns don't matter, and an
    empty table gives an empty one. ``repeats`` must be at least 2.
    """
    if repeats < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    bounded_batches(docs.sparkSession)
    place = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    kept = docs.select(*carry)
    schema = T.StructType(
        [
            *kept.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(runs, T.ArrayType(place)),
            T.StructField(collapsed, T.StringType()),
        ]
    )
    rows = docs.select(*carry, text_or_empty(text_column).alias(free_name(docs, "text_to_scan")))
    step = _scan_batches(len(carry), schema.names, least, repeats)
    return rows.mapInArrow(returning_memory(step), schema)
