"""Tokenising, chat views, mixing and search against their definitions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from comparing import differences, duckdb_tables

from loglens.llm import bpe, mixing, oracle, perspectives, queries, topk

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_encoder_equals_library(library):
    rng = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "l", "v", "'", " ", "  ", "\n", "\t", " ", "1", "٣", "!", "é", "漢", "😀", "\x1c", "́", "'s", "²", "　", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)] + ["", "q" * 3000 + "xyz" * 400]
    # Every code point class by class would take minutes; a stride of them is enough here.
    points = [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 211)]
    texts += ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)}a" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, (ids, offsets) in zip(texts, bpe.Encoder(PATH).encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        raw = text.encode()
        assert [raw[a:b] for a, b in zip(offsets, [*offsets[1:], len(raw)])] == [library.decode_single_token_bytes(i) for i in ids]


def test_encode_and_decode(awkward, nothing, library):
    coded = bpe.decode(bpe.encode(awkward, PATH), PATH).collect()
    want = sorted((repr(r["doc_id"]), (r["text"] or "").encode()) for r in awkward.collect())
    assert sorted((repr(r["doc_id"]), bytes(r["decoded"])) for r in coded) == want
    for r in coded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(bytes(r["decoded"]).decode())
        assert r["n_tokens"] == len(r["ids"]) // 4 == len(r["offsets"]) // 4
    once = bpe.round_trip(awkward, PATH)
    assert once.columns == ["doc_id", "n_tokens", "ids", "offsets", "decoded"]
    assert sorted(map(repr, once.collect())) == sorted(map(repr, coded))
    assert bpe.encode(nothing, PATH).count() == 0
    assert bpe.round_trip(nothing, PATH).count() == 0


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert differences(queries.queries()[name](spark, SF_DIR), duckdb_tables(SF_DIR), oracle.oracle_sql()[name]) is None


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|> ho"), (1, 3, "ann", None), (1, 3, "ann", None),
        (1, None, None, "late"), (None, 1, "cy", "alone"), (2, 1, "system", "nobody"), (3, 2000, "ann", "b"), (3, 1, "ann", "a"),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, name string")
    views = perspectives.perspectives(messages).collect()
    whole = defaultdict(list)
    for r in views:
        whole[r["conv_id"], r["perspective"]].append(r)
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy"), (3, "ann")}
    for (conv, who), said in whole.items():
        said.sort(key=lambda r: r["offset"])
        text = "".join(r["rendered"] for r in said)
        at = 0
        for r in said:
            assert r["offset"] == at
            at += len(r["rendered"])
            assert r["trained"] == (r["role"] == "assistant") == (r["mask_start"] is not None)
            if r["trained"]:
                assert text[r["mask_start"] : r["mask_end"]].endswith(perspectives.END)
        assert len(said) == sum(r[0] == conv for r in rows)
    ann = "".join(r["rendered"] for r in sorted(whole[1, "ann"], key=lambda r: r["offset"]))
    assert ann.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n< |im_end|> ho")
    parts = perspectives.dialogues(perspectives.perspectives(messages)).collect()
    assert sum(len(p["text"]) for p in parts) == sum(len(r["rendered"]) for r in views)
    assert perspectives.perspectives(messages.limit(0)).count() == 0


def test_names_are_kept_apart(spark):
    names = ["a<", "a ", "a>", "a\n", "a%3C", "a%", "a", None, "unknown", "%75nknown", "System"]
    messages = spark.createDataFrame([(1, i, n, f"text {i}") for i, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    views = perspectives.perspectives(messages).collect()
    assert len({r["perspective"] for r in views}) == len(names) and len(views) == len(names) ** 2
    for view in {r["perspective"] for r in views}:
        mine = [r for r in views if r["perspective"] == view and r["trained"]]
        assert len(mine) == 1 and not set("\n<>") & set(view)


def test_what_mixing_refuses(docs):
    frame = docs([(1, "a b", "s"), (2, "c", "t")])
    with pytest.raises(ValueError, match="epochs"):
        mixing.plan(frame, epochs=9, max_repeats=4)
    with pytest.raises(ValueError, match="choose other names"):
        mixing.mix(frame, mixing.plan(frame), block="KEY")


def test_pruned_search_equals_products():
    """Few entries reach the bound here, so that later lists are resolved one by one."""
    rng = np.random.default_rng(11)
    for size, low in ((1, -300), (3000, -3_000_000)):
        data = rng.integers(low, -low, (700, 16)) // (1 + rng.integers(0, 40, (700, 1)))
        queries = rng.integers(low, -low, (9, 16))
        own = rng.random((9, 700)) < 0.01
        whole = np.where(own, np.iinfo("i8").min, queries @ data.T)
        bounds = np.sort(whole, axis=1)[:, -5].copy()
        bounds[0] = np.iinfo("i8").min
        q, c, scores = topk._sufficient(queries, data, own, bounds)
        want = [(a, b) for a in range(9) for b in range(700) if not own[a, b] and whole[a, b] >= bounds[a]]
        assert list(zip(q.tolist(), c.tolist())) == want
        assert (scores == whole[q, c]).all()
        for n, at, found in topk._gathered(queries, data, own, 5):
            assert len(at) == 5 and (found == whole[n, at]).all() and found.min() <= np.sort(whole[n])[-5]


def test_search_refuses_what_does_not_fit(spark):
    for rows in ([(0, [1e18]), (1, [1.0])], [(0, [1e13, 1e13]), (1, [1e13, 1e13])]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(frame).collect()


def test_temperature_and_quotas(spark, docs, awkward, nothing):
    rows = [(i, "w " * (1 + i % 7) + str(i), "big" if i % 3 else f"s{i % 9}") for i in range(600)] + [(None, "x y", None)] * 3
    frame = docs(rows)
    plan = mixing.plan(frame, target_share=0.98, max_repeats=3.0).collect()
    weights = {r["source"]: r["weight"] for r in plan}
    tokens = {r["source"]: r["tokens"] for r in plan}
    total = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    limit = max(weights[s] * total / tokens[s] for s in weights)
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert limit <= 3.0 + 1e-6
    assert abs(entropy - 0.98 * math.log(len(weights))) < 1e-6 or abs(limit - 3.0) < 1e-6
    mixed = mixing.mix(frame, mixing.plan(frame, target_share=0.98, max_repeats=3.0))
    assert mixed.columns == [*frame.columns, "block", "position"]
    got = mixed.withColumn("n", mixing.white_space_tokens()).collect()
    for r in plan:
        used = sum(x["n"] for x in got if x["source"] == r["source"])
        most = max(len((x[1] or "").split(" ")) for x in rows if x[2] == r["source"])
        assert r["quota"] <= used + 0 < r["quota"] + 3 * most
        blocks = Counter((x["doc_id"], x["block"]) for x in got if x["source"] == r["source"] and x["doc_id"] is not None)
        assert not blocks or max(blocks.values()) == 1
    odd = mixing.plan(awkward)
    assert mixing.mix(awkward, odd, block=None, order=None).columns == awkward.columns
    assert mixing.mix(nothing, mixing.plan(nothing)).count() == 0


def brute_top(rows, k, every):
    x = [(i, np.floor(256 * np.array(v, float)).astype(int).astype(object)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, (i, v) in enumerate(x):
        if i % every == 0:
            best = sorted((-int(v @ w), j) for m, (j, w) in enumerate(x) if m != n and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, (scale * rng.normal(size=6)).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(300, [1.0, 2.0]), (301, [1.0, 0.5]), (310, []), (311, None), (312, [1.0, None] * 3), (313, [float("nan")] * 6), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    for k in (5, 200):
        got = sorted(tuple(r) for r in topk.top_k(frame, k, 10).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute_top(rows, k, 10)
    assert topk.top_k(frame.limit(0)).count() == 0
