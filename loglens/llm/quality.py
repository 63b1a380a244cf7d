"""Quality classification with a factorisation machine.

A text becomes hashed words (square roots of their shares), statistics of its structure and metadata, all of
them sparse inputs x. The machine scores w0 + sum(w_i x_i) + sum over pairs <v_i, v_j> x_i x_j, with the pairs
in linear time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2, for each of ``RANK`` factors. It is trained by Adam on a
bounded sample of labelled rows (``max_rows``, a parameter); its own size is fixed (``BUCKETS``), whatever the corpus.
Every text is read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import bounded_batches, folds, free_name, refuse_name, returning_memory, text_or_empty, with_columns

BUCKETS, RANK = 1 << 14, 8
#: Structure statistics and metadata, each cut into steps of an input of its own.
STATISTICS = (
    "log_chars", "log_words", "log_lines", "mean_word", "upper", "digits", "symbols", "blank", "distinct", "top_word",
    "same_as_before", "marked_words", "stated_length",
)
STEPS = 12
_CACHE = 400_000


@lru_cache(maxsize=1)
def _buckets() -> dict[str, int]:
    return {}


def _bucket(word: str, known: dict[str, int]) -> int:
    found = known.get(word)
    if found is None:
        if len(known) >= _CACHE:
            known.clear()
        found = known[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return found


def _statistics(text: str, words: list[str], counts: Counter, stated: int | None) -> list[float]:
    """Shares between 0 and 1; sizes on a log scale."""
    n, k = len(text), len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(1, len(raw))
    kinds = np.bincount(_KINDS[raw], minlength=5)
    same = sum(map(str.__eq__, words, words[1:]))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".," for w in words)
    gap = 0.5 if stated is None else min(1.0, abs(stated - n) / max(1, n))
    return [
        min(1.0, np.log1p(n) / 16), min(1.0, np.log1p(k) / 14), min(1.0, np.log1p(text.count("\n")) / 10),
        min(1.0, n / max(1, k) / 24), kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size,
        len(counts) / max(1, k), max(counts.values(), default=0) / max(1, k), same / max(1, k - 1),
        marked / max(1, k), gap,
    ]


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)  # letters and bytes above ASCII
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 if c.isupper() else 2 if c.isdigit() else 4 if c.isspace() else 0 if c.isalpha() else 3
    return kinds


_KINDS = _byte_kinds()


def features(text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, values) of one text; an empty one has its statistics alone."""
    known = _buckets()
    words = text.split()
    counts = Counter(words)
    total = max(1, len(words))
    summed: dict[int, int] = {}
    for word, n in counts.items():
        b = _bucket(word, known)
        summed[b] = summed.get(b, 0) + n
    at = [*summed]
    values = np.sqrt(np.fromiter(summed.values(), float, len(summed)) / total)
    steps = np.clip(np.array(_statistics(text, words, counts, stated)) * STEPS, 0, STEPS - 1)
    low = steps.astype(int)
    base = BUCKETS + np.arange(len(STATISTICS)) * STEPS
    share = steps - low
    return (
        np.concatenate([np.array(at, np.int32), base + low, base + np.minimum(low + 1, STEPS - 1)]).astype(np.int32),
        np.concatenate([values, 1 - share, share]).astype(np.float32),
    )


@dataclass
class Machine:
    """Weights of a factorisation machine: a constant, one per input, ``RANK`` factors per input."""

    constant: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[at] * values[:, None]
        s = v.sum(0)
        return float(self.constant + self.linear[at] @ values + 0.5 * (s @ s - (v * v).sum()))

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, values), -30, 30))))


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.02, penalty: float = 1e-4, seed: int = 7
) -> Machine:
    """Adam on the logistic loss over mini-batches, both classes weighing the same.

    Without rows, or with rows of one class, the machine gives 1/2, or nearly that class, to everything.
    """
    size = BUCKETS + len(STATISTICS) * STEPS
    rng = np.random.default_rng(seed)
    w = {"c": np.zeros(1), "l": np.zeros(size), "f": rng.normal(0, 0.05, (size, RANK))}
    if not rows:
        return Machine(0.0, w["l"], w["f"] * 0)
    y = np.array([r[2] for r in rows], float)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    first = {k: np.zeros_like(x) for k, x in w.items()}
    second = {k: np.zeros_like(x) for k, x in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for some in np.array_split(order, max(1, len(order) // 128)):
            at = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some]).astype(float)
            doc = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            v = w["f"][at] * x[:, None]
            s = np.zeros((len(some), RANK))
            np.add.at(s, doc, v)
            own = np.bincount(doc, (v * v).sum(1), len(some))
            raw = w["c"][0] + np.bincount(doc, w["l"][at] * x, len(some)) + 0.5 * ((s * s).sum(1) - own)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * weight[some] / len(some)
            used, place = np.unique(at, return_inverse=True)
            e = error[doc] * x
            grad = {
                "c": (slice(None), np.array([error.sum()])),
                "l": (used, np.bincount(place, e, len(used)) + penalty * w["l"][used]),
                "f": (used, _sums(place, e[:, None] * (s[doc] - v), len(used)) + penalty * w["f"][used]),
            }
            step += 1
            for k, (where, g) in grad.items():
                first[k][where] = 0.9 * first[k][where] + 0.1 * g
                second[k][where] = 0.999 * second[k][where] + 0.001 * g * g
                up = first[k][where] / (1 - 0.9**step)
                w[k][where] -= rate * up / (np.sqrt(second[k][where] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(w["c"][0]), w["l"], w["f"])


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, values[:, k], n) for k in range(values.shape[1])], 1)


def sample(
    docs: DataFrame, labels: DataFrame, label: str, wanted: Column, max_rows: int, id_column: str, text_column: str
) -> DataFrame:
    """(text, n_chars, label) of at most ``max_rows`` labelled rows of each class.

    Rows are taken in the order of a hash of the id, so every labelled row has the same chance. The choice is made on
    ids alone; only chosen texts move.
    """
    marks = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
        .select(id_column, F.col(label).cast("int").alias("y")).filter(wanted).dropDuplicates([id_column])
    )
    order = F.xxhash64(F.col(id_column), F.lit("sample"))
    chosen = (
        marks.filter("y = 1").orderBy(order, id_column).limit(max_rows)
        .unionByName(marks.filter("y = 0").orderBy(order, id_column).limit(max_rows))
    )
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    texts = docs.select(id_column, text_or_empty(text_column).alias("text"), stated.alias("n_chars"))
    return texts.join(chosen, id_column).select("text", "n_chars", "y", order.alias("h")).orderBy("h").limit(2 * max_rows)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, stated, y = (batch.column(i).to_pylist() for i in range(3))
        done = [features(t, n) for t, n in zip(text, stated)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(y, pa.int32()), pa.array([a.tobytes() for a, _ in done], pa.binary()),
                pa.array([v.tobytes() for _, v in done], pa.binary()),
            ],
            names=["y", "at", "x"],
        )


def fit(
    docs: DataFrame, labels: DataFrame, wanted: Column, label: str = "quality", max_rows: int = 2500,
    id_column: str = "doc_id", text_column: str = "text",
) -> Machine:
    """A machine trained on labelled rows for which ``wanted`` holds, at most ``max_rows`` of each class.

    The driver gets at most 2 * max_rows rows of at most BUCKETS inputs each. Labels other than 0 and 1, null ids and
    labels without a document are left out.
    """
    bounded_batches(docs.sparkSession)
    chosen = sample(docs, labels, label, wanted, max_rows, id_column, text_column)
    found = chosen.select("text", "n_chars", "y").mapInArrow(_featured, "y int, at binary, x binary").collect()
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), r["y"]) for r in found]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the same machine from the same rows
    return train(rows)


def score(
    docs: DataFrame, machine: Machine, into: str = "score", text_column: str = "text"
) -> DataFrame:
    """``docs`` with all its columns and the score, 0 to 1, of every whole text.

    Null and empty texts get the score of an empty text. Each row is scored by itself. A column named ``into`` is an error.
    """
    refuse_name(docs, into)
    bounded_batches(docs.sparkSession)
    text, stated = free_name(docs, "text_to_score"), free_name(docs, "length_to_score")
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.withColumns({text: text_or_empty(text_column), stated: length})
    names = [*rows.columns, into]
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts, lengths = batch.column(len(names) - 3).to_pylist(), batch.column(len(names) - 2).to_pylist()
            scores = [model.score(*features(t, n)) for t, n in zip(texts, lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(returning_memory(scored), with_columns(rows, **{into: "double"})).drop(text, stated)


def training_rows(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return folds(id_column, 4) != 2


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs``, its columns as they are, without documents that score below ``least``.

    Null and empty texts are judged like others, repeated rows each by itself. An empty table stays empty; documents without
    a labelled row to learn from are an error, as nothing could be judged.
    """
    wanted = training_rows() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    learnt = labels.filter(wanted).select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    if not learnt.head(1) and docs.head(1):
        raise ValueError("no labelled document to learn quality from")
    machine = fit(docs, labels, training_rows())
    name = free_name(docs, "score")
    return score(docs, machine, name).filter(F.col(name) >= least).drop(name)
