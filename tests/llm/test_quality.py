import time

from provena.llm import quality
from provena.llm.quality import base_figures, repeat_words


def test_repeat_words_counts_first_occurrence():
    assert repeat_words(b"a b c x a b c".split()) == 6
    assert repeat_words(b"a b c".split()) == 0
    assert repeat_words(b"a a a a".split()) == 4
    assert repeat_words([]) == 0


def test_repeat_words_against_brute_force(prose):
    for seed in range(5):
        words = (prose(80, seed) + " " + prose(30, seed)).encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert repeat_words(words) == len(hit)


def test_base_figures_use_ascii_white_space_only():
    b = base_figures("ä b c\x1fd\t#x\n\n#x\n#x".encode())
    assert (b.n_words, b.word_chars, b.n_symbols, b.n_lines, b.n_dup_lines) == (5, 12, 3, 3, 1)


def test_verdicts_and_edge_cases(documents, prose):
    good = prose(200, 1)
    rows = [
        (1, good), (1, good), (None, good), (2, None), (3, ""), (4, "short text"), (5, " ".join(w + "***" for w in good.split())), (6, good.upper() + "!!"),
        (7, "spam " * 500), (8, prose(50_000, 2)), (9, " ".join(w + "!!" for w in good.split())), (10, "\n".join("- " + x for x in good.split("\n"))),
        (11, "\n".join(x + "..." for x in good.split("\n"))), (12, "\n".join("  • " + x + " …" for x in good.split("\n"))),
    ]
    found = [(r["doc_id"], r["base_failed"], r["kept"]) for r in quality.quality(documents(rows)).collect()]
    kept = [d for d, _, k in found if k]
    assert sorted(kept, key=str) == [1, 1, 8, None]
    assert {d for d, failed, _ in found if failed} == {2, 3, 4, 7}
    assert sorted(r["doc_id"] or 0 for r in quality.keep_good(documents(rows)).collect()) == [0, 1, 1, 8]
    assert set(quality.keep_good(documents(rows)).columns) == set(documents(rows).columns)


def test_order_does_not_change_the_verdict(documents, prose):
    docs = documents([(i, prose(60 + 10 * i, i) + (" ###" * (i % 40))) for i in range(60)])
    a = quality.quality(docs).orderBy("doc_id").collect()
    for order in (quality.RULES, quality.RULES[::-1], quality.RULES[5:] + quality.RULES[:5]):
        assert a == quality.quality(docs, order=order).orderBy("doc_id").collect()
    assert 0 < sum(r["kept"] for r in a) < 60


def test_rules_run_by_rejections_for_their_cost(documents, prose):
    """Of rules that cost the same the one that rejects more goes first; what the base rule rejects does not count."""
    docs = documents([(i, prose(60, i) + (" zz" if i % 3 == 0 else "") + (" qq" if i % 20 == 0 else "")) for i in range(60)] + [(100 + i, "qq") for i in range(300)])
    def rule(name, word):
        def rejects(data, base):
            time.sleep(0.001)
            return word in data.split()
        return quality.Rule(name, rejects)
    rules = [rule("none", b"yy"), rule("few", b"qq"), rule("many", b"zz")]
    assert [r.name for r in quality.fit_order(docs, rules)] == ["many", "few", "none"]
    assert [r.name for r in quality.fit_order(docs.limit(0), rules)] == ["none", "few", "many"]


def test_empty_table(documents):
    assert quality.quality(documents([])).count() == 0
