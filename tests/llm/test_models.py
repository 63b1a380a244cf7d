"""Classifiers by held-out accuracy, the secret scan by planted findings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loglens.llm import quality, queries, secrets, toxicity


def test_machine_scores_all_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    at, x = np.arange(3, 12), rng.normal(size=9)
    pairs = sum(
        m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i + 1, 9)
    )
    assert np.isclose(m.raw(at, x), 0.3 + m.linear[at] @ x + pairs)


def _held_out(spark, sf_dir, query, label):
    scored = query(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return scored, scored.join(labels, "doc_id").filter("held_out").collect()


def test_quality_on_held_out_rows(spark):
    scored, rows = _held_out(spark, "/root/testdata/sf0.01", queries.op2_quality, "quality")
    assert scored.count() == 1000
    right = sum((r["predicted"] == 1) == (r["y"] == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    _, rows = _held_out(spark, "/root/testdata/sf0.1", queries.op10_toxicity, "toxic")
    toxic = [r["predicted"] for r in rows if r["y"] == 1]
    clean = [r["predicted"] for r in rows if r["y"] == 0]
    assert sum(toxic) >= 0.85 * len(toxic)
    assert sum(clean) <= 0.03 * len(clean)


def test_class_model_is_a_distribution():
    """Discounted shares and the mass that is left add up to one at each level."""
    texts = [toxicity.words("the cat sat on the mat and the cat sat on the dog " * 4), toxicity.words("a dog")]
    m = toxicity.class_model(texts)
    assert abs(float(m.word.sum()) + m.word_left - 1) < 1e-5
    assert abs(float(m.stem.sum()) + m.stem_left - 1) < 1e-5
    assert 0 < m.left.min() and m.left.max() <= 1


def test_rare_words_of_a_class_are_evidence(spark):
    """From one occurrence on, at every level."""
    plain = [f"the day was number{i} and the road was long" for i in range(30)]
    parts = [toxicity.class_model([toxicity.words(t) for t in texts]) for texts in (["you zounds", *["the utter grobian"] * 3], plain)]
    m = parts[0]
    assert (m.word[np.isin(m.vocabulary, toxicity.words("you zounds utter grobian")[1:])] > 0).all() and (m.bigram > 0).all()
    assert (m.stem[m.stems != 0] > 0).all()
    pairs = {p for t in (*plain, "you zounds", "the utter grobian") for w in [toxicity.words(t).tolist()] for p in zip(w, w[1:])}
    n = [(w, sum(b == w for _, b in pairs)) for w in {b for _, b in pairs}]
    models = toxicity.Models(*parts, toxicity._shared(spark.createDataFrame(n, "word long, n long"), *parts))
    gain = models.gains(toxicity.words("zounds utter grobian road"))[1]
    assert gain[:3].min() > 2 > 1 > gain[3]


def test_few_labelled_rows_find_toxic_texts(spark):
    """Learnt from the smallest labels, where insults are rare; judged on the next larger ones."""
    few, more = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
    read = lambda sf, name: spark.read.parquet(f"{sf}/{name}.parquet")
    models = toxicity.fit(read(few, "documents"), read(few, "labels"), F.lit(True))
    rows = toxicity.score(read(more, "documents").select("doc_id", "text"), models).join(read(more, "labels"), "doc_id").collect()
    toxic = [r["score"] >= 0.5 for r in rows if r["toxic"] == 1]
    clean = [r["score"] >= 0.5 for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.6 * len(toxic)
    assert sum(clean) <= 0.1 * len(clean)


def test_shared_backoff_counts_every_neighbour(spark, docs):
    """More neighbours than a set of fixed size tells apart, over several documents and tasks."""
    rows = [(i, " ".join(f"w{j} common w{j} other{j % 3}" for j in range(i * 100, i * 100 + 200))) for i in range(20)]
    often = toxicity.words("common w7 absent")[1:]
    found = [toxicity.shared_backoff(docs(rows).repartition(5), frequent=x).collect() for x in (None, often)]
    n, split = ({r["word"]: r["n"] for r in rows} for rows in found)
    assert n == split and len(found[1]) == len(n)
    pairs = set()
    for _, text in rows:
        w = toxicity.words(text).tolist()
        pairs |= set(zip(w, w[1:]))
    assert n == {w: sum(b == w for _, b in pairs) for w in {b for _, b in pairs}}
    assert n[toxicity.words("common")[1]] == 2100


def test_packed_pairs_are_counted_however_they_are_cut(monkeypatch):
    """Small holds, many buckets of one word, and repeats over tasks."""
    monkeypatch.setattr(toxicity, "_HELD", 50)
    texts = [" ".join(f"w{(i * j) % 37} x" for j in range(60)) for i in range(9)] + ["", "x"]
    pairs = {p for t in texts for w in [toxicity.words(t).tolist()] for p in zip(w, w[1:])}
    rows = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 3])], names=["text"]) for i in range(0, len(texts), 3)]
    packed = [b for r in rows for b in toxicity._neighbours(iter([r]), 5, toxicity.words("x")[1:])]
    lined_up = pa.Table.from_batches(packed).sort_by("bucket").to_batches()
    total = {}
    for b in toxicity._counted(iter(lined_up)):
        for w, n in zip(*(c.to_pylist() for c in b.columns)):
            total[w] = total.get(w, 0) + n
    assert total == {w: sum(b == w for _, b in pairs) for w in {b for _, b in pairs}}


def test_scores_need_no_counts_of_words_that_no_class_has(spark):
    """Scores equal those from the shared counts of every word of the text."""
    texts = [toxicity.words(t) for t in ("you awful fool " * 9, "the cat sat on the mat " * 9, "the dog fooled unseen words awfully")]
    parts = [toxicity.class_model([t]) for t in texts[:2]]
    every = toxicity.class_model(texts)
    pairs = {p for t in texts for p in zip(t.tolist(), t[1:].tolist())}
    n = [(w, sum(b == w for _, b in pairs)) for w in {b for _, b in pairs}]
    counts = spark.createDataFrame(n, "word long, n long")
    few = toxicity.Models(*parts, toxicity._shared(counts, *parts))
    whole = toxicity.Models(*parts, toxicity._shared(counts, *parts, every))
    assert len(whole.vocabulary) > len(few.vocabulary)
    assert np.allclose(few.gains(texts[2]), whole.gains(texts[2]))


def test_words_are_looked_up_once_for_each_task(monkeypatch):
    """Scores of batches are those of single texts, also after words were forgotten; a word is looked up when it is first met."""
    texts = ["", "you awful fool " * 9, "the cat sat on the mat", " \n", "You fool, the unseen mat!", ""]
    parts = [toxicity.class_model([toxicity.words(t)]) for t in texts[1:3]]
    keys = np.unique(np.concatenate([m.vocabulary for m in parts]))
    stems = np.unique(keys >> 32)
    models = toxicity.Models(*parts, toxicity.Shared(keys, np.full(len(keys), 2.0), stems, np.full(len(stems), 3.0), 99))
    models.slope = np.array([0.1, 0.2, 0.3, 0.4])
    want = [models.score(toxicity.words(t)) for t in texts]
    looked_up, places = [], toxicity._places
    monkeypatch.setattr(toxicity, "_places", lambda known, x: looked_up.extend(x[: 0 if known is models.bigrams else None]) or places(known, x))
    scorer = toxicity.Scorer(models)
    assert [scorer.scores(texts[:3]) + scorer.scores(texts[3:]), scorer.scores([])] == [want, []]
    words = {k for t in texts for k in toxicity.words(t).tolist()}
    assert len(looked_up) == 2 * len(words)
    monkeypatch.setattr(toxicity, "_CACHE", 2)
    assert [s for t in texts for s in scorer.scores([t])] == want


def test_scores_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for marks in (labels, labels.limit(0)):
            model = module.fit(awkward, marks, F.lit(True))
            rows = module.score(awkward, model, "result").collect()
            assert len(rows) == awkward.count() and all(0 <= r["result"] <= 1 for r in rows)
            assert module.score(nothing, model, "result").count() == 0
    assert quality.keep_good(awkward, labels).columns == awkward.columns


def test_secret_scan(spark, docs, awkward, nothing):
    texts = []
    for i in range(40):
        texts += [
            (4 * i, f"Server started. password=a{i}f9c{i * 7919 % 10**6:06d}bd{i}e1 was set"),
            (4 * i + 1, f"call +49 1{i:04d}5678{i:02d} or card 4{i:03d}894974608{i:03d} now"),
            (4 * i + 2, f"token = \"{i:04d}be{i * 104729 % 10**9:09d}af8854f0e01b4ad40cd\" end"),
            (4 * i + 3, f"see pages 2023-11-{i:02d}-17 and é漢 18{i:06d}99 there"),
        ]
    found = secrets.scan(docs(texts)).collect()
    assert {r["doc_id"] % 4 for r in found} == {0, 1, 2, 3}
    by_id = dict(texts)
    for r in found:
        assert by_id[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["candidate"]
        assert r["is_secret"] == (r["doc_id"] % 4 in (0, 2)), r
    reviewed = spark.createDataFrame(
        [(r["doc_id"], r["start"], int(not r["is_secret"])) for r in found], "doc_id long, start long, label int"
    )
    # The forest learns what it is told, whatever the seed forms say.
    turned = secrets.scan(docs(texts), reviewed).collect()
    assert all(r["is_secret"] == (r["doc_id"] % 4 in (1, 3)) for r in turned)
    assert secrets.scan(awkward).count() == 0 and secrets.scan(nothing).count() == 0
    unsure = secrets.scan(docs([(1, "key ab12cd34ef56gh")])).collect()
    assert [(r["is_secret"], r["score"]) for r in unsure] == [(True, None)]


def test_assigned_values_are_candidates(docs):
    """Without digits, with symbols, short, quoted or bare; and what stands in front is taken from the whole text."""
    texts = [
        (1, "password=CorrectHorseBattery end"), (2, 'password = "P@ssw0rd!" end'), (3, "passwd: T0p$ecret!x"),
        (4, "api_token_v2=9f8e7d6c5b4a39281706"), (5, "é {'db_secret': 'pa ss, wörd', 'x': 1}"), (6, "auth=ab, pwd=cd; none"),
    ]
    by_id = dict(texts)
    found = secrets.candidates(docs(texts)).collect()
    for r in found:
        text, end = by_id[r["doc_id"]], r["start"] + len(r["candidate"])
        assert text[r["start"] : end] == r["candidate"]
        assert text[max(0, r["start"] - 40) : r["start"]] == r["before"] and text[end : end + 40] == r["after"]
    values = {(r["doc_id"], r["candidate"]) for r in found}
    assert values >= {
        (1, "CorrectHorseBattery"), (2, "P@ssw0rd!"), (3, "T0p$ecret!x"), (4, "9f8e7d6c5b4a39281706"), (5, "pa ss, wörd"),
        (6, "ab"), (6, "cd"),
    }
    marked = secrets.seed_findings(secrets.candidates(docs(texts[3:4]))).collect()
    assert [r["label"] for r in marked] == [1]


def test_planted_secrets_are_found(spark):
    """Every value of 40 hexadecimal digits that documents assign to a token is reported; candidates stand where they say."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = secrets.scan(docs).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["candidate"] for r in found)
    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    assert len(planted) >= 10 and planted <= {(r["doc_id"], r["start"]) for r in found if r["is_secret"]}
