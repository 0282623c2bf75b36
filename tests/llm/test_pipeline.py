"""The pipeline's stages on the smallest tables: whole results, own columns, brute force where it is cheap."""

import re

import corpus_pipeline
import numpy as np

from barframe.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    first = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == first, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def brute_kept(texts, words=5, similarity=80):
    """The smallest index of each group that links of word shingles connect."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= similarity * (len(a) + len(sets[j]) - n):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i for i, r in enumerate(root) if r == i}


def test_near_copies(spark):
    """Word edits, cut and added text: links of 5 words and 0.8, not those of op9_jaccard."""
    r = np.random.default_rng(21)
    prose = lambda n: [f"w{k}" for k in r.integers(0, 5000, n)]
    base, other, third = prose(200), prose(150), prose(400)
    texts = [" ".join(base), " ".join(other), " ".join(third), None, "", "one two"]
    for edits in (1, 2, 3, 4, 5, 6, 9):
        for of in (base, third):
            w = list(of)
            for k in r.choice(len(w), edits, replace=False):
                w[k] = f"e{r.integers(1 << 30)}"
            texts.append(" ".join(w))
    texts += [" ".join(other[: len(other) - cut]) for cut in (15, 25, 40)] + [" ".join(other + prose(n)) for n in (15, 25, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    want = brute_kept(texts)
    assert got == want and want != brute_kept(texts, 3, 90)


ODD = "doc_id long, text string, lang string, row string, n int, node long, hit_spans string, item_ids int, pii_spans string, tox_score int, tox_hits int, n_words string, longest_match int, n_chars int"


def odd_rows():
    """Nulls, repeats, two texts under one id, ties, a very long text, a toxic one, a benchmark passage, and columns named like results."""
    r = np.random.default_rng(33)
    prose = lambda n: " ".join(f"v{k}" for k in r.integers(0, 4000, n))
    long, one, two = prose(30_000), prose(120), prose(90)
    texts = [(1, one), (1, one), (2, one + " w"), (3, None), (3, None), (4, ""), (5, two), (5, prose(70)), (None, prose(40)), (None, None), (6, long), (7, long), (8, "mail a.b@example.com now"), (9, "you idiot moron idiot clown stupid loser " * 3)]
    return [(i, t, None, "r", 1, 2, "h", 3, "p", 0, 4, "w", 5, len(t or "")) for i, t in texts]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == names, name
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert all(r["row"] == "r" and r["node"] == 2 and r["pii_spans"] == "p" and r["hit_spans"] == "h" for r in docs.collect()), name
    before = kept["toxicity"]
    ids = [i for i, _ in kept["near_copies"]]
    assert ids.count(1) == 1 and 2 not in ids and 7 not in ids and ids.count(5) == 2 and ids.count(None) == 2 and ids.count(3) == 2 and ids.count(4) == 1 and 6 in ids
    assert set(kept["near_copies"]) <= set(before)
    (mail,) = [t for i, t in kept["personal_data"] if i == 8]
    assert "example.com" not in mail and "[EMAIL]" in mail
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == {i for i, _ in kept["personal_data"]}


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.count() == 0 and docs.columns == [c.split()[0] for c in ODD.split(", ")], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_toxic_documents_go(spark):
    """The stage rejects what its model scores at the threshold or above, by brute force over the model's own lexicon."""
    docs = common.table(spark, SF, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    words = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()
    told = {r["doc_id"]: sum(re.findall(rf"(?i)\b{w}\b", r["text"] or "") != [] for w in words) for r in docs.collect()}
    assert all(i not in kept for i, n in told.items() if n >= 3) and all(i in kept for i, n in told.items() if not n and i not in {r["doc_id"] for r in common.table(spark, SF, "labels").where("toxic = 1").collect()})
