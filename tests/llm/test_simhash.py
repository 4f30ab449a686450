import random

import xxhash

from provena.llm import sets, shingles, simhash
from provena.operators import graph


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def slow_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints(prose):
    for seed in range(6):
        text = prose(3 + 7 * seed, seed)
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0


def near(prose, n, seed):
    base, r = prose(300, seed).split(), random.Random(seed)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


def check(docs, rows, **options):
    prints = {d: slow_fingerprint(t or "") for d, t in rows}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, **options).collect()}
    assert got == {d: (prints[d], want[d]) for d in prints}


def test_components_match_brute_force(documents, prose):
    texts = near(prose, 25, 1) + near(prose, 10, 2) + [prose(100, s) for s in range(10, 30)] + [None, "", "one", "one"]
    rows = list(enumerate(texts))
    check(documents(rows), rows)


def test_large_buckets_lose_no_link(documents, prose):
    rows = list(enumerate(near(prose, 60, 3) + near(prose, 20, 4)))
    check(documents(rows), rows, dense=1)


def test_random_fingerprints_chain(spark):
    r = random.Random(9)
    values = {r.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(6):
            for bit in r.sample(range(64), r.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    signed = lambda v: v - 2**64 if v >> 63 else v
    from provena.operators.graph import components

    for dense in (1, 3, 1000):
        links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), dense=dense)
        assert all((a["a"] % 2**64 ^ a["b"] % 2**64).bit_count() <= 4 for a in links.collect())
        labels = {x["id"] % 2**64: x["label"] for x in components(links).collect()}
        ids = {v: i for i, v in enumerate(sorted(values))}
        want = slow_components({i: v for v, i in ids.items()})
        for v in values:
            for w in values:
                same = v == w or labels.get(v) is not None and labels.get(v) == labels.get(w)
                assert same == (want[ids[v]] == want[ids[w]])


def test_keep_one(documents, prose):
    a = prose(200, 1)
    rows = [(5, a), (3, a), (3, a), (7, prose(200, 2)), (None, a), (None, prose(200, 3)), (None, prose(200, 3))]
    kept = shingles.keep_one(documents(rows))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (False, 7), (True, None)]
    assert kept.columns == documents(rows).columns
    assert shingles.keep_one(documents([])).count() == 0


def final_plans(monkeypatch, *modules):
    """Plans as they ran of what the modules write from now on."""
    plans = []

    def planned(df, name, write=simhash.materialise):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    for module in modules:
        monkeypatch.setattr(module, "materialise", planned)
    return plans


def test_links_send_no_table_through_the_driver(spark, monkeypatch):
    """However small the tables are, none that grows with the documents is broadcast: rows after an explode are sized too low."""
    plans = final_plans(monkeypatch, simhash, graph)
    prints = spark.createDataFrame([(i, (1 << i % 9) + (i // 9 << 40)) for i in range(40)], "doc_id long, fp long")
    assert simhash.classes(prints, dense=3).count() == 40
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) > 5


def test_keep_one_sends_no_table_through_the_driver(documents, prose, monkeypatch):
    plans = final_plans(monkeypatch, simhash, graph, sets, shingles)
    rows = list(enumerate(near(prose, 6, 3) + [prose(100, 10)]))
    assert shingles.keep_one(documents(rows)).count() == 2
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) > 10
