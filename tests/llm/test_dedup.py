"""Deduplication against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglens.llm import components, exact_dedup, line_dedup, linking, near_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def variants(seed: int, bases: int, copies: int, size: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(size)]
        for _ in range(copies):
            text = base[:]
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(size)] = rng.choice(WORDS)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def groups_of(links, nodes) -> set[frozenset]:
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    found = {}
    for n in nodes:
        found.setdefault(top(n), set()).add(n)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9)], [(i, i + 1) for i in range(40)]])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    got = {}
    for r in components.connected(frame).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert {frozenset(g) for g in got.values()} == groups_of([x for x in links if x[0] != x[1]], nodes)
    assert all(c == min(g) for c, g in got.items())


def brute_exact(rows):
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, (_, t) in enumerate(rows)}
    out = []
    for i, (doc, t) in enumerate(rows):
        same = [j for j in plain if plain[j] == plain[i]]
        best = min(same, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((doc, rows[best][0], len(same), sha256(plain[i].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, awkward, bits):
    """With three bits nearly all chunks share a hash, so that identifiers need their slots."""
    base = " ".join(w * 3 for w in WORDS) * 20
    rows = [(i, base[: 3000 + i % 5] + "\n" * (i % 3)) for i in range(30)] + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = exact_dedup.exact_duplicates(docs(rows), hash_bits=bits).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], key=repr) == brute_exact(rows)
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})


def test_chunks_follow_content(spark, docs):
    text = " ".join(WORDS[i * i % 19] + str(i) for i in range(3000))
    chunks = {r["chunk"] for r in exact_dedup.chunk_ids(docs([(1, text)])).collect()}
    moved = {r["chunk"] for r in exact_dedup.chunk_ids(docs([(1, "something in front " + text)])).collect()}
    assert len(chunks) > 10 and len(chunks & moved) > 0.8 * len(chunks)
    assert sum(map(len, chunks)) <= len(text)


def test_drop_exact_keeps_columns(awkward, nothing):
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == 7
    assert exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_bag_min_hash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingles = np.arange(1, 60, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.integers(0, 9, 59), rng.integers(0, 9, 59)
    bags = [(shingles[x > 0], x[x > 0]) for x in (a, b)]
    found = near_dedup.signatures(bags, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    # One document's signature does not depend on its neighbours in the batch.
    assert (near_dedup.signatures(bags[1:], 4096)[0] == found[1]).all()


def test_sketches_count_slots():
    slots = np.random.default_rng(2).integers(0, 2**63, (2, 40)).astype(np.uint64)
    slots[1, :25] = slots[0, :25]
    a, b = linking.sketches(slots)
    differing = sum(1 for i in range(40) if (int(slots[0, i]) ^ int(slots[1, i])) & 15)
    x = [int(p) ^ int(q) for p, q in zip(a.view(np.uint64), b.view(np.uint64))]
    assert sum(1 for w in x for k in range(16) if w >> 4 * k & 15) == differing


def test_near_dedup(docs, awkward, nothing):
    rows = variants(3, 12, 9, 60)
    rows += [(i + 1000, t) for i, t in rows[:20]]
    bags = {i: near_dedup.bag(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(bags, 2) if near_dedup.overlap(bags[a], bags[b]) >= 0.8]
    want = groups_of(links, bags)
    found = near_dedup.near_duplicates(docs(rows)).collect()
    got = {}
    for r in found:
        got.setdefault(r["keep_id"], set()).add(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert {frozenset(g) for g in got.values()} == want
    assert all(r["group_size"] == len(got[r["keep_id"]]) for r in found)

    odd = near_dedup.near_duplicates(awkward).collect()
    assert len(odd) == awkward.count()
    assert {r["group_size"] for r in odd if r["doc_id"] == 6} == {4}
    assert sum(r["kept"] for r in odd) == 8
    assert near_dedup.drop_near_duplicates(awkward).columns == awkward.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_line_dedup(docs, awkward, nothing):
    rng = random.Random(5)
    rows = [(i, "\n".join(t for _, t in rng.sample(POOL, 6))) for i in range(25)]
    lines = [(i, n, x) for i, t in rows for n, x in enumerate(t.split("\n"))]
    sets = {x: line_dedup.shingles(x) for _, _, x in lines}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of = {x: g for g in groups_of(links, sets) for x in g}
    keeper = {}
    for i, n, x in sorted(lines):
        keeper.setdefault(of[x], (i, n))
    found = line_dedup.line_groups(docs(rows)).collect()
    got = sorted((r["doc_id"], r["line_no"], r["keep_id"], r["keep_line"], r["kept"]) for r in found)
    assert got == sorted((i, n, *keeper[of[x]], keeper[of[x]] == (i, n)) for i, n, x in lines)

    kept = line_dedup.drop_near_lines(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[9] == "a\nb\n" and texts[1] is None and texts[3] == " \t\n"
    assert line_dedup.line_groups(nothing).count() == 0


POOL = variants(8, 6, 5, 25)


def test_lines_of_documents_equal_brute_force(spark):
    """No link of the given documents is lost: every line of every text against every other."""
    found = line_dedup.line_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    lines = {(r["doc_id"], i): x for r in docs for i, x in enumerate((r["text"] or "").split("\n")) if x.strip()}
    assert {(r["doc_id"], r["line_no"]) for r in found} == set(lines)
    sets = {x: line_dedup.shingles(x) for x in set(lines.values())}
    holders = {}
    for x, s in sets.items():
        for shingle in s:
            holders.setdefault(shingle, []).append(x)
    links = []
    for x, s in sets.items():
        shared = Counter(y for shingle in s for y in holders[shingle] if y < x)
        links += [(x, y) for y, n in shared.items() if n / (len(s) + len(sets[y]) - n) >= line_dedup.SIMILARITY]
    assert len(links) > 10
    group = {x: g for g in groups_of(links, sets) for x in g}
    want = {}
    for at, x in lines.items():
        want.setdefault(group[x], []).append(at)
    for r in found:
        same = want[group[lines[r["doc_id"], r["line_no"]]]]
        assert (r["keep_id"], r["keep_line"], r["group_size"]) == (*min(same), len(same))
        assert r["kept"] == ((r["doc_id"], r["line_no"]) == min(same))


def test_lines_are_compared_exactly_as_numbers(monkeypatch):
    """Lines of few characters need no sets of texts; short, padded, wide and mixed ones are as similar as their sets are."""
    plain = ["", "a", "ab", "AB ", "\0b", "aaaaaaa", "aaaaaaaa", "née à la carte", "nee a la carte", "x" * 300 + "end of it", "x" * 290 + "end"]
    wide = ["漢字 née à la carte", "漢字漢字漢字漢字漢字", "漢", "ǿ" * 8]

    def check(lines):
        pairs = [(i, j) for i in range(len(lines)) for j in range(len(lines))]
        columns = [[i for i, _ in pairs], [j for _, j in pairs], [lines[i] for i, _ in pairs], [lines[j] for _, j in pairs]]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "left", "right"])
        return [r["similarity"] for b in line_dedup._compare(iter([batch])) for r in b.to_pylist()]

    def want(lines):
        sets = [line_dedup.shingles(x) for x in lines]
        return [len(x & y) / len(x | y) for x in sets for y in sets]

    expected = want(plain)
    assert check(wide) == want(wide) and check(plain + wide) == want(plain + wide)
    monkeypatch.delattr(line_dedup, "shingles")
    assert check(plain) == expected


def test_members_too_far_apart_are_not_compared(spark):
    """Distances from the centre (here 3) of 0.05 and 0.7 leave no room for a similarity of 0.8."""
    similar = {(1, 3): 0.95, (2, 3): 0.3, (1, 2): 0.35, (3, 4): 0.75, (2, 4): 0.3, (1, 4): 0.8}
    table = spark.createDataFrame([(a, b, s) for (a, b), s in similar.items()], "a long, b long, similarity double")
    buckets = spark.createDataFrame([(10, n, 1, 4) for n in (1, 2, 3, 4)] + [(11, 3, 1, 1)], "bucket long, node long, weight int, members long")
    asked = []

    def verify(pairs):
        asked.append({(r["a"], r["b"]) for r in pairs.collect()})
        return pairs.join(table, ["a", "b"])

    def sketched(nodes):
        return nodes.selectExpr("node", "array(10L) AS bands", "array(0L) AS sketch")

    found = linking.similar_components(buckets, sketched, verify, 0.0, 16, 0.8).collect()
    assert asked == [{(1, 3), (2, 3), (3, 4)}, {(1, 4)}]
    assert {r["node"]: r["component"] for r in found} == {1: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("slots", [16, 64, 200, 512])
def test_planes_count_the_same_slots(spark, slots):
    found = np.random.default_rng(3).integers(0, 2**63, (2, slots)).astype(np.uint64)
    found[1, ::3] = found[0, ::3]
    a, b = linking.planes(linking.sketches(found)).tolist()
    pair = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    differing = int(np.count_nonzero((found[0] ^ found[1]) & np.uint64(15)))
    assert pair.select(linking._differing("a", "b", len(a))).first()[0] == differing


def test_centres_settle_buckets(spark):
    """Members of a bucket of two have met; in one of three (centre 3) the two others have not."""
    pairs = spark.createDataFrame([(1, 3, 0.75), (2, 3, 0.75), (4, 5, 0.1), (1, 2, 0.9)], "a long, b long, similarity double")
    buckets = [(10, 1, 1, 3), (10, 2, 1, 3), (10, 3, 1, 3), (11, 3, 1, 1), (12, 4, 1, 2), (12, 5, 1, 2)]
    unsettled = []

    def sketched(nodes):
        unsettled.extend(r["node"] for r in nodes.collect())
        return nodes.selectExpr("node", "array(10L) AS bands", "array(0L) AS sketch")

    found = linking.similar_components(
        spark.createDataFrame(buckets, "bucket long, node long, weight int, members long"), sketched,
        lambda asked: asked.join(pairs, ["a", "b"]), 0.0, 16, 0.8,
    ).collect()
    assert sorted(unsettled) == [1, 2]
    assert {r["node"]: r["component"] for r in found} == {1: 1, 2: 1}


def test_packed_buckets_equal_brute_force():
    """Buckets of two or more different nodes; a copy of a line that another task met makes no second member."""
    rng = np.random.default_rng(4)
    buckets = (rng.integers(0, 3, 400) << line_dedup._KEY_BITS) + rng.integers(0, 150, 400) * 7_000_000_000
    nodes = rng.integers(-(2**63), 2**63, 30)[rng.integers(0, 30, 400)]
    rows = pa.Table.from_batches([line_dedup._pack(buckets[i::4], nodes[i::4]) for i in range(4)]).sort_by("part")
    assert sum(len(x) for x in rows["entries"].to_pylist()) == 13 * 400
    members = {}
    for bucket, node in zip(buckets.tolist(), nodes.tolist()):
        members.setdefault(bucket, set()).add(node)
    want = {(b, n, len(found)) for b, found in members.items() for n in found if len(found) > 1}
    got = [tuple(r.values()) for batch in line_dedup._share(iter(rows.to_batches())) for r in batch.to_pylist()]
    assert len(got) == len(want) > 50 and set(got) == want


def test_only_lines_that_share_a_bucket_are_looked_up(spark):
    lines = [f"line number {i}" for i in range(4000)]
    nodes = line_dedup._halves(line_dedup._checksums(lines))[0]
    words = line_dedup._filter(spark.createDataFrame([(int(n),) for n in nodes[:2000]], "node long"))

    class Sent:
        value = words

    text = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines[i : i + 40]) for i in range(0, 4000, 40)])], names=["text"])
    held = [r["text"] for b in line_dedup._holding(Sent, "first")(iter([text, text])) for r in b.to_pylist()]
    assert held[:2000] == lines[:2000] and len(held) < 2100


def test_different_lines_have_different_nodes(spark):
    """Where the first halves of two checksums are equal, the second ones tell their lines apart, or both together."""
    order = [F.col("doc_id").isNull(), "doc_id", "row", "line_no"]
    schema = "row long, doc_id long, line_no int, a long, b long"

    def made(*halves):
        node, _, classes = line_dedup._classes(spark.createDataFrame([(i, i, 0, *x) for i, x in enumerate(halves)], schema), order)
        return node, sorted((r["key"], r["n"]) for r in classes.collect())

    assert made((1, 5), (2, 5), (1, 5)) == ("first", [(1, 2), (2, 1)])
    assert made((1, 5), (1, 6), (1, 5)) == ("second", [(5, 2), (6, 1)])
    assert made((1, 5), (1, 6), (4, 5)) == ("both", [(1, 1), (4, 1), (7, 1)])


def test_blank_lines_and_plain_lines(spark):
    """As the pattern of Java tells blank lines, and as cutting at white space makes lines plain, for every character."""
    points = [chr(i) for i in range(0x3100)]
    marked = spark.createDataFrame([(x,) for x in points], "x string").filter(F.col("x").rlike(r"[^\s\p{Z}\x85]"))
    full = {r["x"] for r in marked.collect()}
    assert {x for x in points if x.strip(line_dedup.BLANK)} == full
    for x in points:
        for line in (x, f"{x}A b{x}", f" A{x}{x}B ", f"A  {x} b", f"ΑΣ{x}b"):
            assert line_dedup.plain(line) == " ".join(line.lower().split())
