import random

import corpus_pipeline
from provena.llm import shingles, simhash


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def slow_pairs(rows):
    sets = {i: slow_set(t) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def edited(prose, seed, n_words, n_edits, per_line=12):
    r, words = random.Random(seed * 1000 + n_edits), prose(n_words, seed).split()
    for i in r.sample(range(n_words), n_edits):
        words[i] = f"changed{r.randrange(10**6)}"
    return " ".join(words)


def test_all_similar_pairs(spark, prose):
    common = prose(30, 777)
    texts = [edited(prose, seed, n, k) for seed, n in ((1, 120), (2, 300), (3, 700)) for k in (0, 1, 2, 4, 6, 8, 12, 20)]
    texts += [f"{prose(60, 100 + k)}\n{common}\n{prose(60, 300 + k)}" for k in range(60)] + [f"{common} {prose(4, 500 + k)}" for k in range(6)]
    texts += [None, "", " \n", "one", "One", "two three", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    want = slow_pairs(rows)
    assert len(want) > 20
    got = [(r["a"], r["b"]) for r in shingles.similar_pairs(spark.createDataFrame(rows, "k long, text string"), "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert shingles.similar_pairs(spark.createDataFrame([], "k long, text string"), "k").count() == 0


def test_stage_leaves_no_similar_pair(spark, documents, prose):
    rows = [(10 * seed + k, edited(prose, seed, 250, k)) for seed in range(1, 5) for k in range(7)] + [(900, prose(200, 90)), (None, prose(200, 91)), (901, None)]
    far = [(a, b) for a, b in slow_pairs(rows[:28]) if (simhash.fingerprint(dict(rows)[a].encode()) ^ simhash.fingerprint(dict(rows)[b].encode())).bit_count() > 4]
    assert far
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()]
    assert slow_pairs([x for x in kept if x[0] is not None]) == set()
    assert {10, 20, 30, 40, 900, 901, None} <= {d for d, _ in kept}
