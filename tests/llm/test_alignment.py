"""Cross-tokenizer alignment against encoding whole texts and comparing every pair of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from provena.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", "a  b   c\n\n d", "x</s>y <|endoftext|> <unk> <0x41>", "▁under▁", "naïve café — “quoted” … 3.14€", "日本語のテキスト 混ぜて ascii", "éa b c​d", "🙂🙃 emoji 👩‍👩‍👧", "a\0b\x1c\x85c",
    "don't we'll I'VE", "x" * 5000, "ab " * 4000, "日" * 700, "\t\t tab\r\nline", "９９ ① Ⅻ ٣", "ﬁne ǅ ꙮ \U0001d518",
]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte = alignment._byte_of()
    spell_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return lambda t: a.encode(f" {t}", add_special_tokens=False).ids, b.encode, spell_a, spell_b


def groups(text, models):
    """Groups of (A ids, B ids) by common ends; none if a side does not spell the text."""
    encode_a, encode_b, spell_a, spell_b = models
    if not text:
        return []
    a, b = encode_a(text), encode_b(text)
    if any(b"".join(s[i] for i in ids) != f" {text}".encode() for ids, s in ((a, spell_a), (b, spell_b))):
        return []
    ends_a, ends_b = (np.cumsum([len(s[i]) for i in ids]).tolist() for ids, s in ((a, spell_a), (b, spell_b)))
    out, common = [], set(ends_a) & set(ends_b)
    for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
        g = 0
        for i, end in zip(ids, ends, strict=True):
            if g == len(out):
                out.append(([], []))
            out[g][side].append(i)
            g += end in common
    return out


def expected(texts, models):
    cut = [groups(t, models) for t in texts]
    links = [Counter() for _ in texts]
    for gs, held in zip(cut, links, strict=True):
        for a, b in gs:
            for (x, i), (y, j) in ((p, q) for p in Counter(a).items() for q in Counter(b).items()):
                held[x, y] += i * j
    counts = Counter(p for held in links for p in held)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    text = lambda gs: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
    return [
        (
            sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(held.values()), sum(m for p, m in held.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in held.items()),
            hashlib.sha256(text(gs).encode()).hexdigest() if gs else "",
        )
        for gs, held in zip(cut, links, strict=True)
    ]


def rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in df.collect())


@pytest.mark.parametrize("top", [alignment.TOP, 40, 0])
def test_odd_texts(spark, documents, models, top):
    texts = [*ODD, ODD[5], "ab ab"]
    found = rows(alignment.alignment(documents(list(enumerate(texts))), top=top))
    assert [r[1] for r in found] == expected(texts, models)


def test_query_equals_brute_force(spark, models):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = rows(queries.op11_cross_tokenizer_alignment(spark, SF))
    assert found == [((False, d.doc_id), e) for d, e in zip(docs, expected([d.text for d in docs], models), strict=True)]


def test_null_ids_and_empty_table(spark, documents):
    assert [r[1][:2] for r in rows(alignment.alignment(documents([(None, "a b"), (None, "a b"), (3, "a b")])))] == [(2, 2)] * 3
    assert alignment.alignment(documents([])).collect() == []
    assert alignment.overlaps(documents([])).collect() == []


def test_overlaps(spark, documents, models):
    encode_a, encode_b, spell_a, spell_b = models
    texts = [t for t in ODD if t and len(t) < 1000]
    found = alignment.overlaps(documents(list(enumerate(texts)))).collect()
    for d, text in enumerate(texts):
        mine, want = sorted(tuple(r)[1:6] for r in found if r.doc_id == d), []
        if groups(text, models):
            a, b = encode_a(text), encode_b(text)
            start_a = np.concatenate([[0], np.cumsum([len(spell_a[i]) for i in a])])
            start_b = np.concatenate([[0], np.cumsum([len(spell_b[i]) for i in b])])
            for i in range(len(a)):
                for j in range(len(b)):
                    if (shared := min(start_a[i + 1], start_b[j + 1]) - max(start_a[i], start_b[j])) > 0:
                        want.append((i, j, a[i], b[j], int(shared)))
        assert mine == want
        assert {r.group for r in found if r.doc_id == d} == set(range(len(groups(text, models))))


@pytest.mark.parametrize("entries", [1, 7, 1 << 22])
def test_product_of_random_matrices(entries):
    r = np.random.default_rng(4)
    a, b = ((r.random(s) < 0.3) * r.integers(1, 5, s) for s in ((9, 13), (13, 6)))
    csr = lambda m: alignment.Csr.of_rows(*np.nonzero(m), m[np.nonzero(m)], *m.shape)
    out = np.zeros((9, 6), np.int64)
    for first, part in alignment.products(csr(a), csr(b), entries):
        out[first + part.rows, part.indices] = part.values
    assert (out == a @ b).all()
    assert (csr(a).transposed().indptr == csr(a.T).indptr).all()


def test_wide_groups_are_put_together_by_id():
    r = random.Random(9)
    a, b = (np.array([r.randrange(5) for _ in range(n)]) for n in (300, 200))
    keys, numbers = alignment.shared_pairs(a, b, np.zeros(300, np.int64), np.zeros(200, np.int64), np.array([3]), entries=10)
    want = Counter((int(x), int(y)) for x in a for y in b)
    assert {(int(k) >> 20 & 0xFFFFF, int(k) & 0xFFFFF): int(n) for k, n in zip(keys, numbers, strict=True)} == want
    assert set((keys >> 40).tolist()) == {3}
