"""Periodic runs, chunked BPE and whitening against their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loglens.llm import chunk_bpe, periodic, queries, whitening
from loglens.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute_runs(words, least=12, repeats=2):
    """Every lag, every pair."""
    found, seen = [], set()
    for lag in range(1, len(words)):
        i = 0
        while i + lag < len(words):
            j = i
            while j + lag < len(words) and words[j] == words[j + lag]:
                j += 1
            length = j - i + lag
            if j > i and length >= max(least, repeats * lag) and (i, length) not in seen:
                seen.add((i, length))
                found.append((i, length, lag))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {i for start, length, lag in runs for i in range(start + lag, start + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


@pytest.mark.parametrize(("least", "repeats"), [(12, 2), (4, 2), (3, 3), (1, 2)])
def test_runs_equal_brute_force(least, repeats):
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, letters = rng.choice([0, 1, 7, 30, 80]), rng.choice([1, 2, 3, 8, 40])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                q = rng.randrange(1, n - a + 1)
                words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
            texts.append(words + [99] + words if rng.random() < 0.3 else words)
        assert periodic.runs_of(texts, least, repeats) == [brute_runs(t, least, repeats) for t in texts]


def test_splitting_leaves_no_rare_word():
    rng = np.random.default_rng(2)
    words, texts = rng.integers(0, 60, 400), np.repeat([0, 1, 2, 3], 100)
    for start, stop in zip(*periodic.surviving_segments(words, texts, 5, 3)):
        assert len(set(texts[start:stop])) == 1 and stop - start >= 5
        assert np.unique(words[start:stop], return_counts=True)[1].min() >= 3


def test_periodic_runs(docs, awkward, nothing):
    more = docs([(1, "x " * 40 + "y z " * 9), (2, " \n".join(["a", "b", "c"] * 5)), (3, "a\xa0b " * 12)])
    for frame in (awkward, more):
        got = periodic.periodic_runs(frame, carry=("doc_id", "text")).collect()
        assert len(got) == frame.count()
        for r in got:
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
            assert r["n_words"] == len(words)
            assert [tuple(x) for x in r["runs"]] == runs
            assert r["collapsed"] == " ".join(brute_collapsed(words, runs))
    assert periodic.periodic_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(more, repeats=1)


def test_op11_equals_its_contract(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF_DIR).collect()}
    texts = table(spark, SF_DIR, "documents").collect()
    assert len(got) == len(texts)
    changed = 0
    for d in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 1500:
            continue
        runs = brute_runs(words)
        top = min(((-length, start, q) for start, length, q in runs), default=None)
        first = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(brute_collapsed(words, runs)))]
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len(runs), *first, *digests)
    assert changed > 5


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_chunks_equal_library(library):
    rng = random.Random(8)
    parts = [
        "a", "s", "t", "re", "ve", "ll", "l", "v", "'", " ", "  ", "\n", "\t", " ", "1", "٣", "!", "é", "漢", "😀", "\x1c", "́", "'s", "²", "　",
        "\x85", "<|endoftext|>", "<|endo", "ftext|>", "word ", " the", " \n ", "   ",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(2000)]
    texts += ["".join(rng.choices(parts, k=rng.randrange(3000))) for _ in range(150)]
    texts += ["", "q" * 3000 + "xyz" * 400, "ab" * 900, "漢字仮名" * 500, "word " * 5000, "<|endoftext|>" * 90]
    points = [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 211)]
    texts += ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)}a" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    encoder = chunk_bpe.ChunkEncoder(JSON, most_chunks=50, most_words=500)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for at in range(0, len(texts), 97):  # dictionaries fill up and are emptied between batches
        for text, ids, want in zip(texts[at:], encoder.encode(texts[at : at + 97]), wanted[at:]):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:200]
            assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_shared_chunks_are_encoded_once():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000))
    others = [" ".join("".join(rng.choices("klmnop", k=5)) for _ in range(20)) for _ in range(30)]
    encoder = chunk_bpe.ChunkEncoder(JSON)
    encoder.encode([o + " " + passage + " " + o for o in others])
    # The passage once, what stands around it, and the joins of each copy.
    assert encoder.encoded < 0.15 * encoder.characters
    assert len({chunk_bpe.smallest_chunk(o + " " + passage) for o in others}) == 1


def test_chunk_round_trip(awkward, nothing, library):
    got = chunk_bpe.round_trip(awkward, JSON, carry=("doc_id", "kept")).collect()
    want = sorted((repr(r["doc_id"]), r["text"] or "") for r in awkward.collect())
    assert sorted((repr(r["doc_id"]), r["decoded"]) for r in got) == want
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["decoded"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["kept"] == "yes"
    assert chunk_bpe.round_trip(nothing, JSON).count() == 0


def test_op12_equals_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_chunk_bpe(spark, SF_DIR).collect()}
    texts = table(spark, SF_DIR, "documents").collect()
    assert len(got) == len(texts)
    for d in texts:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_spectral(n):
    rng = np.random.default_rng(n)
    turn = np.linalg.qr(rng.normal(size=(n, n)))[0]
    wide = rng.normal(size=(2 * n, n))
    for a in (wide.T @ wide, np.eye(n), np.zeros((n, n)), np.outer(wide[0], wide[0]), turn @ np.diag(np.arange(n) % 3 + 1.0) @ turn.T,
              turn @ np.diag(10.0 ** -np.arange(n)) @ turn.T):
        values, vectors = whitening.spectral(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert abs(values - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() <= 1e-13 * size
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * size
        assert np.linalg.norm(vectors.T @ vectors - np.eye(n)) <= 1e-12


def brute_whitened(x, components):
    n = len(x)
    s = [sum(c) for c in zip(*x)]
    exact = [[n * v - t for v, t in zip(row, s)] for row in x]
    centred = np.array(exact, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    return [sum(v * v for v in row) for row in exact], white, values[:components] / values.sum()


def test_op13_equals_brute_force(spark):
    got = queries.op13_whitening(spark, SF_DIR).toPandas()
    rows = [
        (r["vec_id"], [math.floor(1024 * c) + 100_000 for c in r["embedding"]])
        for r in table(spark, SF_DIR, "embeddings").collect()
        if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])
    ]
    deviation, white, explained = brute_whitened([x for _, x in rows], 8)
    ids = [i for i, _ in rows]
    assert len(got) == 8 * len(ids) and set(got["n"]) == {len(ids)}
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == deviation
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(50)] + [(7, [0.5, 0.25, 0.0])] * 3
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 1.0]), (104, [1.0, float("inf"), 0.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, x int, n int")
    got = whitening.whiten(whitening.fit(whitening.whole_numbers(frame), 8)).toPandas()
    assert len(got) == 3 * 54 and set(got["component"]) == {1, 2, 3} and got["identity_error"].max() < 1e-9
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-12
    for same in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4):  # nothing varies
        alone = whitening.whole_numbers(spark.createDataFrame(same, "vec_id long, embedding array<double>"))
        flat = whitening.whiten(whitening.fit(alone)).collect()
        assert len(flat) == 2 * len(same) and all(r["whitened"] is None and r["identity_error"] is None for r in flat)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    rank_one = whitening.whiten(whitening.fit(whitening.whole_numbers(line))).toPandas()
    assert rank_one[rank_one["component"] == 2]["whitened"].isna().all() and rank_one["identity_error"].max() < 1e-9
    assert whitening.whiten(whitening.fit(whitening.whole_numbers(frame.limit(0)))).count() == 0
    far = spark.createDataFrame([(i, [1e13 * (i % 2)]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(whitening.fit(whitening.whole_numbers(far))).collect()
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        whitening.fit(whitening.whole_numbers(mixed))
