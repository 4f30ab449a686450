import gzip
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provena.llm import chat, decontam, lines, mixing, quality, queries, simhash, tokens, urls, warc
from provena.llm.common import WORD, new_path


# --- mixing -----------------------------------------------------------------------------------


def test_mix_nears_targets_and_agrees(documents, prose):
    rows = [(i, prose(20 + i % 50, i), f"s{i % 4}" if i % 4 else None) for i in range(400)] + [(9000 + i, prose(30, i), "tiny") for i in range(3)]
    rows += [(None, "a b c", "s1"), (7, None, "s2"), (8, "", "s3"), (1, prose(21, 1), "s1"), (1, prose(21, 1), "s1")]
    out = mixing.mix(documents(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        s = by.setdefault(r["source"], {"target": r["target"], "size": r["source_size"], "taken": 0})
        s["taken"] += r["taken"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in out)
    assert abs(sum(s["target"] for s in by.values()) - total) < 1e-6 * total
    assert all(abs(s["taken"] - s["target"]) <= 150 for s in by.values())
    assert by["tiny"]["target"] == 3 * by["tiny"]["size"]
    order = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert order(out) == order(mixing.mix(documents(rows[::-1])).collect())


def test_mix_of_nothing(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def test_mixed_rows(documents, prose):
    rows = [(i, prose(30, i), "ab"[i % 2]) for i in range(40)] + [(1, prose(30, 1), "b")] * 2
    clashing = documents(rows).withColumns({c: F.lit("own") for c in ("size", "taken", "row", "row_key", "nth", "_key")})
    found = mixing.mixed(clashing)
    assert found.columns == [*clashing.columns, "_size", "_source_size", "_target", "_taken"]
    assert {(r["size"], r["taken"], r["row_key"]) for r in found.collect()} == {("own", "own", "own")}
    assert sum(r["_taken"] for r in found.collect()) == sum(r["taken"] for r in mixing.mix(documents(rows)).collect())


def test_mixed_rows_have_their_own_sources_figures(documents, prose):
    """Two sources with one id and text, copies, null ids, texts and sources: row by row as mix says."""
    rows = [(1, prose(10, 1), "a"), (1, prose(10, 1), "b")] + [(i, prose(20 + 3 * i, i), "ab"[i % 3 == 0]) for i in range(2, 40)]
    rows += [(1, prose(10, 1), "b")] * 5 + [(3, prose(29, 3), "b")] * 4 + [(None, prose(9, 77), None), (None, prose(9, 77), "a"), (50, None, "a"), (51, "", None)]
    figures = lambda r, _="": (str(r["doc_id"]), str(r["source"]), *[r[f"{_}{c}"] for c in ("size", "source_size", "target", "taken")])
    want = sorted(figures(r) for r in mixing.mix(documents(rows)).collect() if r["taken"])
    found = mixing.mixed(documents(rows)).collect()
    assert sorted(figures(r, "_") for r in found) == want and {r["source"] for r in found} >= {"a", "b"}
    assert all(r["_size"] == len(r["text"].split()) for r in found)
    assert mixing.mixed(documents([])).count() == 0


def test_targets_of_many_sources(spark):
    """Against filling up by hand: weights 1, 2, 3, repeating, and no target above three times its source's size."""
    r = random.Random(3)
    size = {f"h{k:03d}": r.choice([1, 5, 40, 900, 12_000]) for k in range(90)}
    weight = {name: 1 + k % 3 for k, name in enumerate(sorted(size))}
    want, left, open_ = {}, sum(size.values()), set(size)
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if level * weight[x] > 3 * size[x]}
        for x in full or open_:
            want[x] = 3 * size[x] if full else level * weight[x]
            left -= want[x] if full else 0
        open_ -= full or open_
    rows = spark.createDataFrame([(0, k, v) for k, v in size.items()], "no_source int, source string, size long")
    got = {x["source"]: x["target"] for x in mixing.targets(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)


# --- decontamination ------------------------------------------------------------------------------


def slow_hits(text, items):
    words = decontam.words_of((text or "").encode())
    hit, ids = set(), set()
    for item_id, body in items:
        for w in decontam.windows_of(decontam.words_of((body or "").encode())):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    ids |= {str(item_id)} if item_id is not None else set()
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("max_bits", [1 << 20, 1 << 3])
def test_decontamination_against_brute_force(spark, documents, prose, max_bits):
    items = [(i, prose(10 + 5 * i, i)) for i in range(6)] + [(3, prose(40, 77)), (50, "Three short words"), (51, ""), (52, None), (None, prose(20, 88)), (53, "!!! ...")]
    rows = [(i, prose(50, 100 + i)) for i in range(10)]
    rows += [(20, prose(20, 7) + "\n" + prose(40, 77).upper().replace(" ", ",  ")), (21, prose(300, 5) + " " + prose(35, 5)), (22, "x three SHORT--words y"), (23, None), (24, ""), (25, prose(20, 88))]
    rows += [(26, " ".join(prose(35, 5).split()[:20]) + " gap " + " ".join(prose(35, 5).split()[5:30])), (20, rows[0][1]), (20, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judged(documents(rows), bench, max_bits=max_bits).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = slow_hits(r["text"], items)
        assert (r["_n_words"], r["_n_hit"], list(r["_items"]), r["_contaminated"]) == (n, hit, ids, hit > 0 and 20 * hit >= n)
    clashing = documents(rows).withColumns({c: F.lit("own") for c in ("_hits", "row", "nth", "p", "items", "_items")})
    assert {r["_hits"] for r in decontam.judged(clashing, bench).collect()} == {"own"}
    assert decontam.clean(clashing, bench).columns == clashing.columns
    assert decontam.clean(documents(rows), bench.limit(0)).count() == len(rows)
    assert decontam.clean(documents([]), bench).count() == 0


def test_decontamination_of_very_long_texts(spark, prose, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(decontam, "STRETCH", 20)
    items = [(i, prose(60, 500 + i)) for i in range(5)]
    body = " ".join(prose(300, i) + " " + items[i % 5][1] for i in range(40))
    rows = [(1, body), (2, "x" * 5000 + " " + items[0][1]), (3, items[1][1] * 3)]
    got = decontam.judged(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        n, hit, ids = slow_hits(r["text"], items)
        assert (r["_n_words"], r["_n_hit"], list(r["_items"])) == (n, hit, ids)


def test_word_hashes_tell_words_apart():
    data = "Ab  cd é1! ab \u4e2d ".encode()
    hashes, starts, stops = decontam.word_hashes(data.translate(decontam.FOLD))
    words = [data.translate(decontam.FOLD)[a:b] for a, b in zip(starts, stops, strict=True)]
    assert words == decontam.words_of(data)
    assert [[x == y for y in hashes] for x in hashes] == [[x == y for y in words] for x in words]


# --- lines --------------------------------------------------------------------------------------------


def test_lines_remove_later_copies_only(documents, prose):
    block = prose(120, 1)
    rows = [(1, block + "\n" + prose(50, 2)), (2, prose(50, 3) + "\n" + block + "\n" + prose(30, 4)), (3, None), (4, ""), (5, prose(60, 9)), (5, prose(60, 9)), (None, block), (7, "\n\n\n\n\n\n")]
    clashing = documents(rows).withColumns({c: F.lit("own") for c in ("_id", "id", "row", "t", "k1", "lines", "marks", "_n_lines")})
    out = {(r["doc_id"], r["text"] is None): r for r in lines.dedup_lines(clashing).collect()}
    assert set(lines.dedup_lines(clashing).columns) == {*clashing.columns, "_n_removed_lines"} and out[1, False]["_id"] == out[1, False]["row"] == "own"
    assert out[1, False]["text"] == rows[0][1] and out[1, False]["_n_removed_lines"] == 0
    assert out[2, False]["_n_removed_lines"] == 10 and out[2, False]["text"] == prose(50, 3) + "\n" + prose(30, 4)
    assert out[3, True]["_n_lines"] == 0 and out[4, False]["_n_lines"] == 1
    assert out[5, False]["_n_removed_lines"] == 0 and out[7, False]["_n_removed_lines"] == 0
    assert (out[None, False]["_n_removed_lines"], out[None, False]["text"]) == (10, "")
    assert lines.dedup_lines(documents([])).count() == 0


def test_equal_hashes_of_different_chunks(documents, prose, monkeypatch):
    """Chunks are compared by bytes: with a hash of two values the result is the same."""
    rows = [(k, f"{prose(36, 10 + k)}\n{prose(24, k // 3)}\n{prose(36, 20 + k)}") for k in range(6)]
    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(rows)).collect()}
    real = F.xxhash64
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)) if isinstance(c[0], str) and c[0] == "body" else real(*c))
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(rows)).collect()} == want
    assert sum(len(t) for t in want.values()) < sum(len(t) for _, t in rows)


def test_short_passages_go_whole(documents, prose):
    rows, want = [], {}
    for n in range(2, 7):
        for k in range(4):
            passage, before, after = prose(12 * n, 50 + n), prose(36, 1000 + 10 * n + k), prose(36, 2000 + 10 * n + k)
            rows.append((10 * n + k, f"{before}\n{passage}\n{after}"))
            want[10 * n + k] = rows[-1][1] if k == 0 else f"{before}\n{after}"
    rows += [(100, "a b\n\nc d\nown"), (101, "x\na b\n\nc d\n"), (102, "a b\nc d"), (103, "r\nr\nr\nr\nr"), (104, None), (105, ""), (None, "x y\nown\nc d\nown")]
    want |= {100: rows[20][1], 101: "x\n", 102: "a b\nc d", 103: "r\nr", 104: None, 105: "", None: "x y\nown"}
    out = lines.dedup_lines(documents(rows + rows[:1]), least_words=1).collect()
    assert len(out) == len(rows) + 1
    assert {r["doc_id"]: r["text"] for r in out} == want
    n_lines = lambda t: len(t.split("\n")) if t is not None else 0
    for r in out:
        whole = dict(rows)[r["doc_id"]]
        assert (r["_n_lines"], r["_n_removed_lines"]) == (n_lines(whole), n_lines(whole) - n_lines(r["text"]))
    assert lines.dedup_lines(documents([])).count() == 0


def test_few_words_are_no_passage(documents):
    """Two texts that share a pair of short lines keep it; a run of them that holds ten words goes."""
    verse = "one two\nthree four\n\nfive six\nseven eight"
    rows = [(1, "else\nreturn x\nown"), (2, "a\nelse\nreturn x\nb"), (3, f"{verse}\nnine ten\nx"), (4, f"y\n{verse}\nnine ten"), (5, f"z\n{verse}\nw")]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(rows)).collect()}
    assert out == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "y", 5: rows[4][1]}


def test_line_stage_cuts_short_passages(spark, documents, prose):
    rows = [(k, f"{prose(36, 10 + k)}\n{prose(24, 1)}\n{prose(36, 20 + k)}") for k in range(6)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, documents(rows), "").collect()}
    assert [prose(24, 1) in out[k] for k in range(6)] == [True] + [False] * 5
    assert all(prose(36, 10 + k) in out[k] and prose(36, 20 + k) in out[k] for k in range(6))


# --- urls -----------------------------------------------------------------------------------------------


def test_urls_against_brute_force(spark):
    r = random.Random(2)
    day = lambda k: f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}"
    names = ["a.com", "x.a.com", "b.org", "x.a.com/p", "b.org/p/q", "c.net"]
    entries = [(r.choice(names), r.choice(["block", "allow", "remove"]), day(r.randrange(300))) for _ in range(60)] + [(None, "block", day(1)), ("c.net", "odd", day(1)), ("c.net", "block", None)]
    hosts = ["http://x.a.com/p/1", "https://y.x.a.com/", "http://b.org/p/q/r?z", "http://B.org:80/p", "http://user@c.net", "nonsense", None, "http://a.com.evil/"]
    captures = [(i, r.choice(hosts), day(r.randrange(330))) for i in range(200)] + [(900, hosts[0], None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date")).withColumn("action", F.lit("clash")).withColumn("best", F.lit("clash")).withColumn("pattern", F.lit("clash"))
    e = spark.createDataFrame(entries, "pattern string, action string, listed_on string").withColumn("listed_on", F.col("listed_on").cast("date"))
    rank = ["block", "allow", "remove"]

    def verdict(url, at):
        if not url or "://" not in url or at is None:
            return None
        host, _, path = url.split("://")[1].partition("/")
        host = host.split("@")[-1].split(":")[0].lower()
        path = path.split("?")[0]
        best = None
        for p in {x[0] for x in entries if x[0]}:
            ph, _, pp = p.partition("/")
            if pp and not (host == ph and (path + "/").startswith(pp + "/")) or not pp and not (host == ph or host.endswith("." + ph)):
                continue
            seen = [(d, -rank.index(a), a) for q, a, d in entries if q == p and d and a in rank and d <= at]
            if seen and max(seen)[2] != "remove":
                best = max(filter(None, [best, ("/" in p, len(p), p, max(seen)[2])]))
        return best and (best[2], best[3])

    for row in urls.judge_urls(c, e).collect():
        at = row["fetched_on"] and str(row["fetched_on"])
        want = verdict(row["url"], at)
        assert (row["_pattern"], row["_action"]) == (want or (None, None)), row
        assert row["_kept"] == (not want or want[1] != "block")
    assert urls.judge_urls(c, e.limit(0)).where("_kept").count() == len(captures)
    assert urls.judge_urls(c.limit(0), e).count() == 0


# --- warc -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compress", [False, True])
def test_warc_round_trip(spark, compress):
    pages = [(5, "http://a/x y", "same"), (2, "http://b", "same"), (9, None, "WARC/1.1\r\n\r\nsly"), (3, "http://c", None), (4, "http://d", ""), (7, "http://e", "é" * 40_000), (None, "http://f", "same"), (None, "g", "own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    folder = new_path(spark, "warc-test")
    assert sum(r["n_records"] for r in warc.write_archives(df, folder, compress=compress).collect()) == len(pages)
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.archived_pages(spark, folder).collect()}
    assert got == {(2, 4): ("response", None), (5, 4): ("revisit", 2), (None, 4): ("revisit", 2), (9, 15): ("response", None), (3, 0): ("response", None), (4, 0): ("revisit", 3), (7, 80_000): ("response", None), (None, 3): ("response", None)}
    payload = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, folder, ["page_id", "record_type", "payload"]).where("record_type = 'response'").collect()}
    assert payload == {"2": "same", "9": pages[2][2], "3": "", "7": pages[5][2], None: "own"}
    plan = warc.read_archives(spark, folder, ["page_id", "record_type"]).where("record_type = 'revisit' and page_id in ('5', '4')")
    assert sorted(r["page_id"] for r in plan.collect()) == ["4", "5"]


def test_unwanted_payloads_are_not_inflated(spark):
    """The payloads' compressed bytes are spoilt: whoever asks for headers alone does not notice."""
    pages = [(k, f"http://a/{k}", "".join(random.Random(k).choices("abcdefgh ", k=60_000))) for k in range(8)] + [(9, "http://b", "small")]
    folder = new_path(spark, "warc-test")
    paths = [r["path"] for r in warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, compress=True, archive_bytes=50_000).collect()]
    assert len(paths) > 3
    headers = lambda: sorted(r["page_id"] for r in warc.read_archives(spark, folder, ["page_id", "record_type"]).where("record_type = 'response'").collect())
    sizes = lambda: {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(spark, folder, ["page_id", "payload_bytes"]).collect()}
    assert sizes() == {str(k): len(html) for k, _, html in pages}
    for path in paths:
        data, at = bytearray(Path(path).read_bytes()), 0
        while at < len(data):
            size = warc.member_length(bytes(data[at : at + 64]))
            if size > 8000:
                data[at + 6000 : at + size - 8] = b"\xff" * (size - 6008)
            at += size
        Path(path).write_bytes(data)
        Path(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc").unlink(missing_ok=True)
    assert headers() == sorted(str(k) for k, _, _ in pages)
    with pytest.raises(Exception, match="invalid|incorrect|Error -3"):
        sizes()


def test_archives_of_other_writers(spark):
    """Members without lengths, two records in one member, and a record cut off."""
    record = lambda k, body: warc.response_record(k, "http://x", body, "D" * 32)
    folder = new_path(spark, "warc-test")
    at = Path(folder.removeprefix("file://"))
    at.mkdir()
    (at / "other.warc.gz").write_bytes(warc.member(record(1, b"one")) + gzip.compress(record(2, b"two" * 9000) + record(3, b"three")) + gzip.compress(record(4, b"")))
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, folder, ["page_id", "payload"]).where("page_id <> '1'").collect()}
    assert got == {"2": b"two" * 9000, "3": b"three", "4": b""}
    (at / "cut.warc.gz").write_bytes(warc.member(record(5, random.Random(5).randbytes(9000)))[:-3000])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, folder, ["payload"]).collect()


def test_small_payloads_are_always_responses(spark):
    folder = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbbb"), (4, "u", "bbbbbb")], "page_id long, url string, html string"), folder, min_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.archived_pages(spark, folder).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_warc(spark):
    folder = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.archived_pages(spark, folder).count() == 0


# --- tokens -------------------------------------------------------------------------------------------------


PATHS = [f"{tokens.vocabulary_dir()}/{name}" for name in tokens.VOCABULARIES]


def slow_count(text, path):
    return len(tokens.encoder(Path(path).read_bytes()).encode_ordinary(text or ""))


def test_token_counts_equal_the_encoder(documents, prose):
    texts = [prose(200, 1), "It's 3,000€ — naïve  \n\n  x\t", None, "", "日本語テキスト", " leading", "a" * 5000]
    got = [r["n"] for r in documents(list(enumerate(texts))).orderBy("doc_id").select(tokens.token_counts(F.col("text"), PATHS).alias("n")).collect()]
    assert got == [[slow_count(t, p) for p in PATHS] for t in texts]


def test_ledger_replays_revisions_and_deletes(spark, documents):
    path = PATHS[:1]
    docs = documents([(1, "one two", "a"), (2, "three", "a"), (3, "four five six", None), (4, None, "b"), (1, "one two", "a"), (None, "seven", "d")])
    ledger = tokens.Ledger(spark)
    assert ledger.totals().count() == 0 and ledger.committed() == []
    assert ledger.apply("b1", tokens.changes(docs, path)) and not ledger.apply("b1", tokens.changes(docs, path))
    state = lambda: {r["source"]: (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    first = state()
    assert first["a"][0] == 3 and first[None][0] == 1 and first["b"] == (1, 0) and first["d"][0] == 1
    version = tokens.version_of(path[0])
    schema = "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long"
    batch = [(2, "delete", "a", "en", version, None), (3, "revise", "c", "en", version, 7), (None, "delete", None, None, version, None), (99, "delete", "a", "en", version, None), (3, "revise", "x", "en", "other", 5)]
    assert ledger.apply("b2", spark.createDataFrame(batch, schema)) and not ledger.apply("b2", spark.createDataFrame(batch, schema))
    now = state()
    assert now["c"] == (1, 7) and None not in now and "d" not in now and now["a"][0] == 2 and now["b"] == (1, 0) and now["x"] == (1, 5)
    assert ledger.apply("b3", tokens.changes(docs.where("doc_id = 1"), path)) and state() == now  # booked already
    assert ledger.apply("b4", tokens.changes(docs.where("doc_id = 2"), path)) and state()["a"][0] == 3
    assert ledger.committed() == ["b1", "b2", "b3", "b4"]


def test_ledger_writers_meet(spark, documents, monkeypatch):
    """A writer whose number is taken while it writes starts over and sees what the other one booked."""
    ledger, path = tokens.Ledger(spark), PATHS[:1]
    docs = documents([(1, "one two", "a")])
    ledger.apply("b1", tokens.changes(docs, path))
    real, calls = ledger.commits, []

    def stale():
        calls.append(1)
        return real()[:1] if len(calls) == 1 else real()

    delete = tokens.changes(docs, path, "delete")
    ledger.apply("b2", delete)
    monkeypatch.setattr(ledger, "commits", stale)
    assert ledger.apply("b3", delete) and ledger.totals().count() == 0 and ledger.committed() == ["b1", "b2", "b3"]


def test_maintained_totals_against_brute_force(spark, documents, prose):
    rows = [(i, prose(20 + i, i) + (f" write to a{i}.b@mail.example.org now" if i % 3 == 0 else ""), f"s{i % 2}") for i in range(30)]
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \n\t", None), (7, prose(9, 9), "s0"), (None, "x@y.zz", None), (103, "no@host", "s1")]
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in tokens.maintained(tokens.Ledger(spark), documents(rows), PATHS).collect()}
    want = {}
    for _, text, source in rows:
        if text and text.split():
            for p in PATHS:
                key = (source, "en", tokens.version_of(p))
                n, total = want.get(key, (0, 0))
                want[key] = n + 1, total + slow_count(re.sub(tokens.EMAIL, "<email>", text), p)
    assert got == want
    assert tokens.maintained(tokens.Ledger(spark), documents([]), PATHS).count() == 0


def test_op8_totals_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r["text"] and re.search(WORD, r["text"]):
            for p in PATHS:
                key = (r["source"], r["lang"], tokens.version_of(p))
                n, total = want.get(key, (0, 0))
                want[key] = n + 1, total + slow_count(re.sub(tokens.EMAIL, "<email>", r["text"]), p)
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op8_token_counts(spark, sf).collect()} == want


# --- chat ---------------------------------------------------------------------------------------------------


def test_quotes_link_to_first_originals(spark):
    rows = [
        (1, 0, "u", "Hello there\nfriend.\n\nSecond part."), (1, 1, "a", "On Monday u wrote:\n> Hello   there friend.\n\nMy answer."),
        (1, 2, "u", ">> hello there\n>> FRIEND.\n>\n> My answer.\nThanks"), (2, 0, "u", "> Second part.\nnot mine"), (2, 1, "a", "> nobody said this\nok"),
        (3, 0, "u", None), (3, None, "u", "text"), (None, 4, "u", ""), (1, 1, "a", "On Monday u wrote:\n> Hello   there friend.\n\nMy answer."), (4, 5, "u", "alone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash"))
    out = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(df).collect()}
    assert chat.link_quotes(df).count() == len(rows)
    r = out[1, 1]
    assert (r["reply_conv_id"], r["reply_turn"], r["n_quotes"], r["n_linked"], r["text"]) == (1, 0, 1, 1, "My answer.")
    r = out[1, 2]
    assert (r["reply_turn"], r["n_quotes"], r["n_linked"], r["text"]) == (1, 2, 2, "Thanks")
    assert (out[2, 0]["reply_conv_id"], out[2, 0]["reply_turn"], out[2, 0]["text"]) == (1, 0, "not mine")
    assert (out[2, 1]["reply_conv_id"], out[2, 1]["reply_turn"], out[2, 1]["n_linked"]) == (2, 0, 0)
    assert out[3, 0]["text"] == "" and out[4, 5]["reply_turn"] is None
    assert sorted(r["position"] for r in chat.link_quotes(df).collect() if r["conv_id"] == 1) == [0, 1, 2, 3]
    odd = chat.link_quotes(spark.createDataFrame([("x", "one", "u", "a"), ("x", "2", "a", "> a\nb"), (None, None, None, None)], "conv_id string, turn string, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"], r["position"]) for r in odd} == {("x", None, 0), ("x", 2, 1), (None, None, 0)}
    assert chat.link_quotes(df.limit(0)).count() == 0


def test_replies_are_ordered_depth_first(spark):
    """Random trees of quotes, one conversation far larger than the others, against a walk of the tree."""
    r = random.Random(4)
    rows, parents = [], {}
    for c, n in [("a", 120), ("b", 1), ("c", 7), (None, 12), ("d", 30)]:
        for t in range(n):
            if t and r.random() < 0.02:
                continue  # a missing turn begins a thread
            kind, q = r.random(), None
            if t and kind < 0.4:
                q = r.choice([x for k, x in parents if k == c])
            parents[c, t] = q if q is not None else t - 1 if (c, t - 1) in parents else None
            rows.append((c, t, "u", (f"> said {c} {q}\n" if q is not None else "") + f"said {c} {t}"))
    want = {}
    for c in {k for k, _ in parents}:
        stack, place = sorted([t for k, t in parents if k == c and parents[k, t] is None], reverse=True), 0
        while stack:
            t = stack.pop()
            want[c, t] = place
            place += 1
            stack += sorted([u for k, u in parents if k == c and parents[k, u] == t], reverse=True)
    r.shuffle(rows)
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {(x["conv_id"], x["turn"]): x["position"] for x in got} == want
    assert {(x["conv_id"], x["turn"]): x["reply_turn"] for x in got} == parents


def test_quotes_of_other_conversations(spark):
    """The first conversation that says a passage may be the quoting one, which says it later only: the next one is linked."""
    rows = [(1, 0, "u", "> shared words\nown"), (1, 1, "a", "shared words"), (2, 3, "u", "Shared  words"), (3, 0, "u", "shared words")]
    out = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[1, 0]["reply_conv_id"], out[1, 0]["reply_turn"], out[1, 0]["n_linked"]) == (2, 3, 1)
    assert (out[1, 1]["reply_conv_id"], out[1, 1]["reply_turn"], out[3, 0]["reply_turn"]) == (1, 0, None)


# --- all ----------------------------------------------------------------------------------------------------


def test_very_long_texts(spark, documents, prose):
    """A text of 60,000 words, its copy and a short one go through every operator whole."""
    long = prose(60_000, 1)
    docs = documents([(1, long), (2, long), (3, "> " + long[:500])])
    assert [(r["n_words"], r["kept"]) for r in quality.quality(docs).orderBy("doc_id").collect()[:2]] == [(60_000, True)] * 2
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 60_000, 2: 60_000, 3: len(("> " + long[:500]).split())}
    assert {r["doc_id"]: r["_n_removed_lines"] for r in lines.dedup_lines(docs).collect()}[2] == 5_000
    bench = spark.createDataFrame([(7, long)], "item_id long, text string")
    assert {r["doc_id"]: (r["_n_words"], r["_n_hit"]) for r in decontam.judged(docs, bench).collect()}[2] == (60_000, 60_000)
    totals = {r["doc_id"]: r["n_tokens"] for r in tokens.changes(docs, PATHS[:1]).collect()}
    assert totals[1] == totals[2] == slow_count(long, PATHS[0])
    talk = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("u").alias("role"), "text")
    assert sorted(len(r["text"]) for r in chat.link_quotes(talk).collect())[1:] == [len(long)] * 2
    folder = new_path(spark, "warc-test")
    warc.write_archives(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/" + "y" * 20_000).alias("url"), F.col("text").alias("html")), folder, compress=True)
    assert {r["page_id"]: r["payload_bytes"] for r in warc.archived_pages(spark, folder).collect()}[2] == len(long.encode())
    urls_of = docs.select(F.concat(F.lit("http://a.com/"), F.replace("text", F.lit("\n"), F.lit("/"))).alias("url"), F.lit("2024-01-02").cast("date").alias("fetched_on"))
    entries = spark.createDataFrame([("a.com", "block", "2024-01-01")], "pattern string, action string, listed_on string").withColumn("listed_on", F.col("listed_on").cast("date"))
    assert urls.judge_urls(urls_of, entries).where("not _kept").count() == 3
