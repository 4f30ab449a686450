"""MinHash near-duplicates against all pairs of sets, on the given table, on random families of copies and on crowded tables."""

import random

import pytest
from pyspark.sql import functions as F

from provena.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def shingles(text, n=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if text else []
    words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if w]
    if not words:
        return frozenset()
    return frozenset({tuple(words)} if len(words) <= n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)})


def expected(rows):
    """By brute force over the distinct sets: row -> (n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    of = {s: find(i) for i, s in enumerate(distinct)}
    least = {}
    for (k, _), s in zip(rows, sets, strict=True):
        if s and k is not None:
            least[of[s]] = min(k, least.get(of[s], k))
    out = []
    for (k, _), s in zip(rows, sets, strict=True):
        component = least.get(of[s]) if s else k
        out.append((k, len(s), component, k == component))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def families(vocabulary, seed, n, size, words, rates):
    """Texts in families: a base and copies with some words changed."""
    r, out = random.Random(seed), []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(*words))]
        for _ in range(size):
            rate = r.choice(rates)
            out.append(" ".join(r.choice(vocabulary) if r.random() < rate else w for w in base))
    r.shuffle(out)
    return list(enumerate(out))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op12_minhash(spark, SF)) == expected(rows)


@pytest.mark.parametrize("seed", range(2))
def test_families(spark, documents, vocabulary, seed):
    rows = families(vocabulary, seed, 12, 9, (5, 150), (0.0, 0.01, 0.03, 0.05, 0.1))
    assert found(minhash.near_duplicates(documents(rows))) == expected(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_one_family_of_a_third_of_the_rows(spark, documents, vocabulary, rounds):
    """Many nodes of one table, some only connected through others, some at just under the similarity."""
    rows = families(vocabulary, 7, 1, 120, (80, 80), (0.01, 0.03, 0.05, 0.07)) + [(1000 + k, t) for k, t in families(vocabulary, 8, 60, 2, (20, 60), (0.0, 0.04))]
    assert found(minhash.near_duplicates(documents(rows), dense=4, rounds=rounds)) == expected(rows)


def test_edge_cases(spark, documents, prose):
    long = prose(30_000, 3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, None), (5, "a"), (6, "A"), (7, "a b c d"), (8, "a  b\nc d"), (9, long), (10, long + " more"), (9, long), (None, long), (None, "x y z"), (None, "x y z"), (11, "é É")]
    assert found(minhash.near_duplicates(documents(rows))) == expected(rows)
    assert minhash.near_duplicates(documents([])).collect() == []
    assert found(minhash.near_duplicates(documents([(1, None)]))) == [(1, 0, 1, True)]


def test_keys_agree_where_sets_do():
    """Half keys agree about as often as the similarity to the third says, and two collections differ."""
    import numpy as np

    made, r = minhash.Sketcher(400, 3), np.random.default_rng(1)
    base = r.integers(-(1 << 63), 1 << 63, 900)
    a, b = made.keys(np.sort(base[:850])), made.keys(np.sort(np.concatenate([base[:800], base[850:900]])))
    assert abs((a == b).mean() - (800 / 900) ** 3) < 0.06
    assert len(set(a.tolist())) == 800


def test_pairs_are_made_once(spark, documents, vocabulary):
    """Near copies agree in up to 576 tables, yet a pair is made by one row of the join, and only of nodes that agree in both collections."""
    texts = documents(families(vocabulary, 5, 4, 12, (150, 200), (0.01, 0.015))).dropDuplicates(["text"])
    nodes = minhash.materialise(texts.select(F.col("doc_id").alias("k"), F.col("doc_id").alias("l"), minhash.sketch(F.col("text")).alias("s")).select("k", "l", "s.*"), "nodes")
    held = nodes.collect()

    def meet(x, y):
        apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x["bitmap"], y["bitmap"], strict=True))
        return set(x["u"]) & set(y["u"]) and set(x["v"]) & set(y["v"]) and 5 * min(x["n"], y["n"]) >= 4 * max(x["n"], y["n"]) and 9 * apart <= x["n"] + y["n"]

    want = sorted((x["k"], y["k"]) for x in held for y in held if x["k"] < y["k"] and meet(x, y))
    assert len(want) > 50
    assert sorted(tuple(r) for r in minhash._meetings(nodes).collect()) == want


def test_a_crowd_of_near_copies_is_not_paired_with_itself(spark, documents, vocabulary, monkeypatch):
    """Most of a crowd is connected in rounds, so that what is left to pair is no more than a few pairs a row."""
    rows, made = families(vocabulary, 9, 1, 300, (150, 150), (0.005, 0.01, 0.015)), {}

    def counted(df, name, write=minhash.materialise):
        made[name] = (out := write(df, name)).count()
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    assert found(minhash.near_duplicates(documents(rows), dense=4)) == expected(rows)
    assert made["rest"] <= 3 * len(rows)
