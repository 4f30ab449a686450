import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from provena.llm import suffix


def slow(rows):
    size = suffix.LENGTH
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[i : i + size] for i in range(len(data) - size + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - size + 1):
            if count[data[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(docs):
    found = suffix.dedup_substrings(docs).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in found), key=str)


def corpus(prose):
    shared, r = prose(60, 100), random.Random(1)
    rows = []
    for i in range(30):
        text = prose(60 + i, i)
        at = r.randrange(len(text))
        rows.append((i, text[:at] + shared[: r.randint(150, len(shared))] + text[at:]))
    rows += [(40, "ab " * 300), (41, "ä" * 150), (42, "ä" * 99), (43, None), (44, ""), (45, "short"), (46, rows[0][1]), (46, rows[0][1]), (None, rows[3][1])]
    words = rows[5][1].split(" ")
    for i in range(50, 90):  # near copies
        words[r.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [1 << 16, 3, 0])
def test_against_brute_force(documents, prose, monkeypatch, hot):
    rows = corpus(prose)
    monkeypatch.setattr(suffix, "HOT", hot)
    assert run(documents(rows)) == slow(rows)


def test_groups_against_all_pairs():
    """Segments that share a gram: the tree of branches finds the windows that comparing all pairs finds."""
    r = random.Random(7)
    size = suffix.LENGTH
    for trial in range(60):
        gram = bytes(r.choice(b"xy") for _ in range(suffix.GRAM))
        base = [bytes(r.choice(b"ab") for _ in range(170)) for _ in range(4)]
        keys = {}
        for k in range(r.randint(2, 40)):
            left, right = bytearray(r.choice(base)[: r.randint(0, 168)]), bytearray(r.choice(base))
            for side in (left, right):
                if side and r.random() < 0.7:
                    side[r.randrange(len(side))] = r.choice(b"abc")
            right = right[: r.randint(max(0, size - len(left) - suffix.GRAM), 168)]
            if len(left) + suffix.GRAM + len(right) >= size:
                keys[gram + bytes(right) + suffix.END + bytes(left)] = (k, 0, 1000) if r.random() < 0.9 else None
        group, last = [], b""
        for key in sorted(keys):
            group.append((suffix.shared_prefix(last, key), key, keys[key]))
            last = key
        rows = suffix._Rows()
        suffix.settle(group, rows)
        got = {(d, i) for d, _, lo, hi, _, _ in rows.rows for i in range(lo - 1000, hi - 999)}

        def windows(key):
            right, _, left = key.partition(suffix.END)
            data = left[::-1] + right
            return {i: (len(left) - i, data[i : i + size]) for i in range(len(data) - size + 1)}

        cut = {key: windows(key) for key in keys}
        want = {(place[0], i) for key, place in keys.items() if place for i, w in cut[key].items() if any(w in cut[o].values() for o in keys if o != key)}
        assert got == want, trial


def test_long_text_makes_several_runs(documents, prose, monkeypatch):
    monkeypatch.setattr(suffix, "RUN_BYTES", 20_000)
    rows = [(1, prose(3000, 1) * 2), (2, prose(900, 2) + prose(3000, 1)[4000:9000])]
    assert run(documents(rows)) == slow(rows)


def test_no_documents(documents):
    assert run(documents([])) == []
    assert run(documents([(1, None), (2, "x")])) == slow([(1, None), (2, "x")])


def test_long_text_in_slices(documents, prose, monkeypatch):
    rows = [(1, prose(3000, 1)), (2, prose(500, 2) + prose(3000, 1)[4000:9000])]
    monkeypatch.setattr(suffix, "BUFFER", 2048)
    held = [b for texts in ([t.encode() for _, t in rows],) for b in suffix._buffers(texts, suffix.LENGTH)]
    assert len(held) > 5
    assert run(documents(rows)) == slow(rows)


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(3)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(400)]
    runs = []
    for k in range(7):
        mine = sorted(set(keys[k::7]))
        row = suffix.front_code(0, [(x, False, [(k, 1, 2)]) for x in mine])
        runs.append(suffix.read_run(row))
    merged, last = [], b""
    for lcp, key, _, count, place in suffix.LoserTree(runs):
        assert lcp == suffix.shared_prefix(last, key) and count == 1 and place[1:] == (1, 2)
        merged.append(key)
        last = key
    assert merged == sorted(k for i in range(7) for k in set(keys[i::7]))
    assert list(suffix.LoserTree([iter(())])) == []


def test_merge_of_an_empty_part():
    assert suffix.merge_part(pa.table([[]] * len(suffix.RUN_SCHEMA), schema=suffix.RUN_SCHEMA)).num_rows == 0
