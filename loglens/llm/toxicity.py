"""Toxicity by class-conditional Kneser-Ney language models.

Each class, toxic and ordinary, has a bigram model over words, interpolated with its own continuation model, that with a
continuation model of word beginnings, and that with backoff counts which both classes share: after how many different
words each word stands in the whole corpus. A text's score follows from the length-normalised difference of its two
log-likelihoods. What no class has seen cancels out, so rare expressions decide nothing.

The shared counts are a stored table with a line for every different word of the corpus. Class models learn from a bounded
sample of labelled rows (``max_rows``), so their words, and the shared counts of these words, are bounded too. The counts
of all other words are the same factor in both likelihoods, so a score needs no more than these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import bounded_batches, folds, free_name, frozen, refuse_name, returning_memory, text_or_empty, with_columns
from loglens.llm.near_dedup import mixed
from loglens.llm.quality import sample

STEM = 4
_CACHE = 400_000
#: Pairs of words that a task holds before it hands them on.
_HELD = 4_000_000
#: Characters of all texts for each bucket of pairs, over how many buckets a frequent word's pairs are spread, and bytes of a history.
_BUCKET_CHARACTERS = 1 << 23
_PARTS = 16
_BYTES = 6


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def _key(word: str) -> int:
    """31 bits of a word's first letters, then 32 of the whole word."""
    plain = word.strip(".,;:!?\"'()[]{}<>*%$&#|-")
    whole = zlib.crc32(plain.encode("utf-8", "replace"))
    return zlib.crc32(plain[:STEM].encode("utf-8", "replace"), 99) >> 1 << 32 | whole


def _codes(words: list[str]) -> np.ndarray:
    """The key of each word."""
    known = _known()
    if len(known) > _CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = _key(w)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class _Numbered(dict):
    """Numbers of written words, in the order in which their keys were met; 0 is the mark of a beginning."""

    def __init__(self) -> None:
        super().__init__()
        self.numbers = {0: 0}  # of keys

    def __missing__(self, word: str) -> int:
        found = self[word] = self.numbers.setdefault(_key(word), len(self.numbers))
        return found

    def of(self, text: str) -> np.ndarray:
        found = text.lower().split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def keys_from(self, first: int) -> np.ndarray:
        return np.fromiter(islice(self.numbers, first, None), np.int64, len(self.numbers) - first)


def words(text: str) -> np.ndarray:
    """Keys of the words of a text, with a mark for its beginning in front."""
    return np.concatenate([[0], _codes(text.lower().split())])


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among the sorted ones; their number for those that are not there."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    return np.where(sorted_keys[np.minimum(at, n - 1)] == keys, at, n)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Chen and Goodman's discounts for what was seen once, twice and more often, from how many were seen 1 to 4 times."""
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
    return np.clip(found, [0.1, 0.2, 0.3], [0.95, 1.9, 2.85])


def _discounted(counts: np.ndarray) -> np.ndarray:
    """Counts less their discounts; every count from 1 on keeps something."""
    return np.where(counts > 0, counts - _discounts(counts)[np.clip(counts, 1, 3) - 1], 0)


def _level(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Discounted shares, and the mass left over."""
    share = _discounted(counts) / max(1, counts.sum())
    return share, float(1 - share.sum())


@dataclass
class ClassModel:
    """One class: its words' keys with the mass left after each and their continuations, those of stems, and bigrams.

    Bigrams are numbers: the place of the first word among ``vocabulary`` times its length, plus that of the second.
    """

    vocabulary: np.ndarray
    left: np.ndarray
    word: np.ndarray
    word_left: float
    stems: np.ndarray
    stem: np.ndarray
    stem_left: float
    bigrams: np.ndarray
    bigram: np.ndarray


def class_model(texts: list[np.ndarray]) -> ClassModel:
    """Kneser-Ney counts of the words of one class's texts."""
    none = np.zeros(0, np.int64)
    both = np.concatenate([none, *(w[:-1] for w in texts), *(w[1:] for w in texts)])
    vocabulary, at = np.unique(both, return_inverse=True)
    history, whole = at[: len(at) // 2], at[len(at) // 2 :]
    size = max(1, len(vocabulary))
    bigrams, counts = np.unique(history * size + whole, return_counts=True)
    first, second = bigrams // size, bigrams % size
    bigram = _discounted(counts) / np.bincount(history, minlength=size)[first]
    left = 1 - np.bincount(first, bigram, len(vocabulary))
    # Lower levels count different neighbours, not occurrences.
    word, word_left = _level(np.bincount(second, minlength=len(vocabulary)))
    stems, stem_of = np.unique(vocabulary >> 32, return_inverse=True)
    fresh = np.unique(first * size + stem_of[second])
    stem, stem_left = _level(np.bincount(fresh % size, minlength=len(stems)))
    return ClassModel(vocabulary, left, word, word_left, stems, stem, stem_left, bigrams, bigram)


def _spread(values: np.ndarray, places: np.ndarray, size: int, other: float) -> np.ndarray:
    """``values`` at their places of an array of ``size`` and one more place, for what is unknown; ``other`` elsewhere."""
    out = np.full(size + 1, other, float)
    out[places] = values
    return out


class Models:
    """Both classes over their common words, with the shared counts of these, and the final score's coefficients."""

    def __init__(self, toxic: ClassModel, ordinary: ClassModel, shared: Shared) -> None:
        parts = (toxic, ordinary)
        self.vocabulary, self.stems, self.slope = shared.vocabulary, shared.stems, np.zeros(4)
        n = len(self.vocabulary) + 1
        moved = []
        for m in parts:
            at = _places(self.vocabulary, m.vocabulary)
            size = max(1, len(m.vocabulary))
            moved.append(at[m.bigrams // size] * n + at[m.bigrams % size] if len(m.bigrams) else m.bigrams)
        self.bigrams = np.unique(np.concatenate(moved))
        of_stem = _places(self.stems, self.vocabulary >> 32)
        # A word that no class has seen has the same shared probability in both: any number will do, and 1 is taken.
        within = np.append(shared.words / shared.of_stems[of_stem], 1.0)
        chance = np.append(shared.of_stems / max(1, shared.total), 1.0)
        self.classes = []
        for m, pairs in zip(parts, moved):
            at = _places(self.vocabulary, m.vocabulary)
            low = _spread(m.stem, _places(self.stems, m.stems), len(self.stems), 0) + m.stem_left * chance
            self.classes.append((
                _spread(m.bigram, _places(self.bigrams, pairs), len(self.bigrams), 0), _spread(m.left, at, n - 1, 1),
                _spread(m.word, at, n - 1, 0), m.word_left * within, low,
            ))

    def alone(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words, and how likely each is by itself in toxic and in ordinary texts, from the level of words down."""
        at, stem = _places(self.vocabulary, keys), _places(self.stems, keys >> 32)
        return at, *(word[at] + rest[at] * low[stem] for _, _, word, rest, low in self.classes)

    def after(self, history: np.ndarray, whole: np.ndarray, *alone: np.ndarray) -> np.ndarray:
        """How much more likely words are in toxic texts after the words in front of them, as a logarithm; both by their places."""
        pair = _places(self.bigrams, history * (len(self.vocabulary) + 1) + whole)
        toxic, ordinary = (bigram[pair] + left[history] * x for (bigram, left, *_), x in zip(self.classes, alone))
        return np.log(toxic / ordinary)

    def gains(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word after the first, how much more likely it is in toxic texts, as a logarithm: after the word in front
        of it, and by itself.
        """
        at, toxic, ordinary = self.alone(w)
        return self.after(at[:-1], at[1:], toxic[1:], ordinary[1:]), np.log(toxic[1:] / ordinary[1:])

    def evidence(self, w: np.ndarray) -> np.ndarray:
        """Inputs of the final score: the mean difference by word, and that of clear words by length and by its root.

        Clear words are judged by themselves: two words that met once by chance are clear after one another, but a word
        that met many others is not chance.
        """
        if len(w) < 2:
            return np.zeros(3)
        gain, alone = self.gains(w)
        return _evidence(gain, _clear(alone))

    def score(self, w: np.ndarray) -> float:
        return self.scored(self.evidence(w))

    def scored(self, evidence: np.ndarray) -> float:
        raw = self.slope[0] + self.slope[1:] @ evidence
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def _clear(alone: np.ndarray) -> np.ndarray:
    return np.clip(alone - 3, 0, 4)  # words that e**3 times rather stand in toxic texts


def _evidence(gain: np.ndarray, clear: np.ndarray) -> np.ndarray:
    if not len(gain):
        return np.zeros(3)
    total = clear.sum()
    return np.array([gain.mean(), total / len(gain), total / np.sqrt(len(gain)) / 10])


class Scorer:
    """Scores of texts, batch after batch. What a word says by itself is worked out when it is first met."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self._forget()

    def _forget(self) -> None:
        self.words = _Numbered()
        self.at = np.zeros(0, np.int64)
        self.toxic = self.ordinary = self.clear = np.zeros(0)

    def _learn(self) -> None:
        at, toxic, ordinary = self.models.alone(self.words.keys_from(len(self.at)))
        self.at = np.concatenate([self.at, at])
        self.toxic, self.ordinary = np.concatenate([self.toxic, toxic]), np.concatenate([self.ordinary, ordinary])
        self.clear = np.concatenate([self.clear, _clear(np.log(toxic / ordinary))])

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.words) > _CACHE:
            self._forget()
        found = [self.words.of(t) for t in texts]
        self._learn()
        ends = np.cumsum([0, *map(len, found)])
        whole = np.concatenate([np.zeros(0, np.int64), *found])
        history = np.empty_like(whole)
        history[1:] = whole[:-1]
        history[ends[:-1][np.diff(ends) > 0]] = 0
        gain = self.models.after(self.at[history], self.at[whole], self.toxic[whole], self.ordinary[whole])
        clear = self.clear[whole]
        return [self.models.scored(_evidence(gain[i:j], clear[i:j])) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _different(values: np.ndarray) -> np.ndarray:
    """Different values in order, by sorting, which is much faster here than hashing them."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def _packed(keys: np.ndarray, pairs: np.ndarray, buckets: int, frequent: np.ndarray) -> pa.RecordBatch:
    """Different pairs of numbered words as one row a bucket: its words, how many pairs each has, and their histories.

    A word's pairs lie in one bucket, those of a frequent word in up to ``_PARTS`` by their history. A history is told apart by 48 bits.
    """
    hashed = mixed(keys.view(np.uint64))
    split = np.isin(keys, frequent)
    word, history = pairs >> 32, pairs & 0xFFFFFFFF
    at = hashed[word]
    at[split[word]] += hashed[history[split[word]]] % np.uint64(_PARTS)
    bucket = (mixed(at) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, word, history = bucket[order], word[order], hashed[history[order]] >> np.uint64(16)
    runs = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1])]))
    sizes = np.diff(np.append(runs, len(word))).astype("<u4")
    which, first = np.unique(bucket[runs], return_index=True)
    # Where each bucket's runs, and its pairs, begin and end.
    run_ends = np.append(first, len(runs))
    ends = np.append(runs[first], len(word))

    def blobs(values: bytes, edges: np.ndarray, width: int) -> pa.Array:
        return pa.array([values[i * width : j * width] for i, j in zip(edges[:-1], edges[1:])], pa.binary())

    low = history.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(which.astype(np.int64)), blobs(keys[word[runs]].astype("<i8").tobytes(), run_ends, 8),
            blobs(sizes.tobytes(), run_ends, 4), blobs(low, ends, _BYTES),
        ],
        names=["bucket", "words", "sizes", "histories"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch], buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word with each word in front of it, packed by bucket; most repetitions within a task left out."""
    written = _Numbered()
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seq = written.of(text)
            held.append(seq << 32 | np.concatenate([[0], seq[:-1]]) if len(seq) else seq)
            n += len(seq)
            if n >= _HELD:
                held = [_different(np.concatenate(held))]
                n = len(held[0])
                if n >= _HELD // 2:
                    yield _packed(written.keys_from(0), held[0], buckets, frequent)
                    written, held, n = _Numbered(), [], 0
    if n:
        yield _packed(written.keys_from(0), _different(np.concatenate(held)), buckets, frequent)


def _distinct(words: list[np.ndarray], histories: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, ordered by word."""
    w, h = np.concatenate(words), np.concatenate(histories)
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    new = np.ones(len(w), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return w[new], h[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each bucket, whose rows follow one another: different histories of each word."""
    words, histories, held, most, now = [], [], 0, _HELD, None

    def counts() -> pa.RecordBatch:
        found, n = np.unique(_distinct(words, histories)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for bucket, w, sizes, h in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != now and held:
                yield counts()
                words, histories, held, most = [], [], 0, _HELD
            now = bucket
            words.append(np.repeat(np.frombuffer(w, "<i8"), np.frombuffer(sizes, "<u4")))
            whole = np.zeros((len(h) // _BYTES, 8), np.uint8)
            whole[:, :_BYTES] = np.frombuffer(h, np.uint8).reshape(-1, _BYTES)
            histories.append(whole.view("<i8").ravel())
            held += len(whole)
            if held > most:
                words, histories = ([x] for x in _distinct(words, histories))
                held = len(words[0])
                most = max(_HELD, 2 * held)
    if held:
        yield counts()


def shared_backoff(docs: DataFrame, text_column: str = "text", frequent: np.ndarray | None = None) -> DataFrame:
    """(word, n): after how many different words each word of the corpus stands, by keys, stored.

    The table has a line for every different word of all documents; a text's beginning counts as a word in front. Pairs
    travel packed, in buckets whose number grows with the characters of all texts. ``frequent`` lists keys of words whose
    pairs are spread over several buckets; whichever these are, the counts are the same.
    """
    bounded_batches(docs.sparkSession)
    often = np.unique(np.zeros(0, np.int64) if frequent is None else frequent)
    texts = docs.select(text_or_empty(text_column).alias("text"))
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, characters // _BUCKET_CHARACTERS)
    packed = texts.mapInArrow(
        returning_memory(lambda batches: _neighbours(batches, buckets, often)),
        "bucket long, words binary, sizes binary, histories binary",
    )
    lined_up = packed.repartition("bucket").sortWithinPartitions("bucket")
    parts = frozen(lined_up.mapInArrow(returning_memory(_counted), "word long, n long"), "neighbours")
    if not len(often):
        return parts
    split = F.col("word").isin(often.tolist())
    return parts.filter(~split).unionByName(parts.filter(split).groupBy("word").agg(F.sum("n").alias("n")))


def _frequent(texts: list[np.ndarray]) -> np.ndarray:
    """Keys of the words that are at least one in a thousand of these texts' words."""
    found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]), return_counts=True)
    return found[n * 1000 >= n.sum()]


@dataclass
class Shared:
    """Shared counts of the classes' words and stems, in the order of their keys, and of all words."""

    vocabulary: np.ndarray
    words: np.ndarray
    stems: np.ndarray
    of_stems: np.ndarray
    total: int


def _shared(counts: DataFrame, *classes: ClassModel) -> Shared:
    """What the classes need of the stored counts; a stem's count is that of all the corpus's words with it."""
    vocabulary = np.unique(np.concatenate([m.vocabulary for m in classes]))
    stems = np.unique(vocabulary >> 32)

    def looked_up(table: DataFrame, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys))  # the mark of a beginning is no word and has no count
        if len(keys):
            wanted = table.sparkSession.createDataFrame(pa.table({"key": keys}))
            found = table.join(wanted, "key").select("key", F.col("n").cast("double")).toArrow()
            out[_places(keys, found.column(0).to_numpy())] = found.column(1).to_numpy()
        return out

    by_stem = counts.groupBy(F.shiftright("word", 32).alias("key")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return Shared(
        vocabulary, looked_up(counts.withColumnRenamed("word", "key"), vocabulary), stems, looked_up(by_stem, stems), total or 0
    )


def calibrate(inputs: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression by Newton's method, both classes weighing the same."""
    x = np.column_stack([np.ones(len(y)), inputs])
    b = np.zeros(x.shape[1])
    if not len(y):
        return b
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    keep = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + keep, x.T @ (weight * (p - y)) + keep @ b)
        b -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return b


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [words(t).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["words", "y"])


def fit(
    docs: DataFrame, labels: DataFrame, wanted: Column, label: str = "toxic", max_rows: int = 4000,
    id_column: str = "doc_id", text_column: str = "text",
) -> Models:
    """Class models from at most ``max_rows`` labelled rows of each class for which ``wanted`` holds.

    One row in four of them is not counted; it sets the threshold. Labels other than 0 and 1, null ids and labels without
    a document are left out; a class without rows has an empty model.
    """
    bounded_batches(docs.sparkSession)
    chosen = sample(docs, labels, label, wanted, max_rows, id_column, text_column)
    found = chosen.select("text", "y").mapInArrow(_word_rows, "words binary, y int").collect()
    rows = sorted(((r["words"], r["y"]) for r in found), key=lambda r: (zlib.crc32(r[0]), r[0]))
    texts = [np.frombuffer(w, np.int64) for w, _ in rows]
    y = np.array([k for _, k in rows], int)
    checked = np.arange(len(rows)) % 4 == 3
    parts = [class_model([t for t, k, c in zip(texts, y, checked) if k == kind and not c]) for kind in (1, 0)]
    models = Models(*parts, _shared(shared_backoff(docs, text_column, _frequent(texts)), *parts))
    inputs = np.array([models.evidence(t) for t, c in zip(texts, checked) if c]).reshape(-1, 3)
    models.slope = calibrate(inputs, y[checked])
    return models


def score(docs: DataFrame, models: Models, into: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns and the score, 0 to 1, of every whole text.

    Null and empty texts get the score of no evidence. Each row is scored by itself. A column named ``into`` is an error.
    """
    refuse_name(docs, into)
    bounded_batches(docs.sparkSession)
    text = free_name(docs, "text_to_score")
    rows = docs.withColumn(text, text_or_empty(text_column))
    names = [*rows.columns, into]
    shipped = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            scores = scorer.scores(batch.column(len(names) - 2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(scored, with_columns(rows, **{into: "double"})).drop(text)


def training_rows(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return folds(id_column, 5) != 0
