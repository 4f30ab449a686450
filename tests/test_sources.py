import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from provena.sources import extracts, register_files, shared, sink, snapshots
from provena.sources.shared import new_path
from provena.streaming import facts as stream


def make_zip(path, name, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, text)
    return str(path)


def test_csv_zip(spark, tmp_path):
    text = '﻿ariregistri_kood;nimi;extra\n10065762;"Kaks\nrida ""AS""";x\n10000018;OÜ Õun;y\n'
    paths = [make_zip(tmp_path / "a.zip", "data.csv", text), make_zip(tmp_path / "b.zip", "d.csv", "ariregistri_kood;nimi\n1;z\n")]
    folder, report = register_files.stage(spark, paths, "csv")
    assert sorted(r["n_rows"] for r in report.collect()) == [1, 2]
    both = register_files.read_csv_zip(spark, paths, ["ariregistri_kood", "nimi"]).collect()
    assert sorted(map(tuple, both)) == [("1", "z"), ("10000018", "OÜ Õun"), ("10065762", 'Kaks\nrida "AS"')]
    single = register_files.read_csv_zip(spark, [make_zip(tmp_path / "c.zip", "d.csv", "﻿a;b\n1;x\n2;\n")], ["a", "b", "none"])
    assert sorted(tuple(r) for r in single.collect()) == [("1", "x", None), ("2", None, None)]
    with pytest.raises(ValueError, match="not one"):
        register_files.stage_zip(make_zip(tmp_path / "e.zip", "x.txt", ""), folder.removeprefix("file://"), "csv")


def test_json_arrays(spark, tmp_path):
    rows = [{"ariregistri_kood": i, "nimi": f"n{i}", "yldandmed": {"kapitalid": [{"kapitali_suurus": "2500"}]}} for i in range(50)]
    path = make_zip(tmp_path / "j.zip", "g.json", json.dumps(rows))
    found = register_files.read_json_zip(spark, [path], "ariregistri_kood int, yldandmed struct<kapitalid: array<struct<kapitali_suurus: string>>>")
    assert found.count() == 50 and found.where("yldandmed.kapitalid[0].kapitali_suurus = '2500'").count() == 50
    for size in (1, 3, 7, 1000):
        assert list(register_files.json_elements(io.StringIO(' [1, 22,{"a":[3]} , "x]"]'), size)) == [1, 22, {"a": [3]}, "x]"]
    for bad in ("", "{}", "[1, 2", '[{"a": '):
        with pytest.raises(ValueError):
            list(register_files.json_elements(io.StringIO(bad)))


def test_manifest_and_links(spark, tmp_path):
    a = tmp_path / "a.bin"
    a.write_bytes(b"abc")
    sums = register_files.checksums(spark, [str(a)])
    row = sums.first()
    assert row["n_bytes"] == 3 and row["sha256"].startswith("ba7816bf")
    manifest = spark.createDataFrame([(str(a), "https://x/ok", 3, row["sha256"]), (str(a) + "2", "ftp://", 1, "")], "path string, url string, n_bytes long, sha256 string")
    problems = {r["path"][-1]: list(r["problems"]) for r in register_files.verified(manifest, sums, "https://x/").collect()}
    assert problems == {"n": [], "2": ["file missing", "not an official address"]}
    assert register_files.missing_datasets([("basic", None), ("reports", None), ("indicators", 2024)], [2024, 2025]) == ["activity", "indicators 2025"]
    html = spark.createDataFrame([('<a href="/f/ettevotja_rekvisiidid__lihtandmed.csv.zip">x</a> <a href="/f/4.2024_aruannete_elemendid_kuni_20260101.zip">y</a> <a href="/z.zip">',)], "html string")
    assert {(r["kind"], r["year"]) for r in register_files.discover_links(html).collect()} == {("basic", None), ("indicators", 2024)}


def test_extracts(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("Företagsnamn;Ort;Anställda;Övrigt\nÅkeri AB;Umeå;20-49;x\n  ;Lund;;y\n".encode("cp1252"))
    rows, ignored = extracts.read_extract(spark, str(path), {"företagsnamn": "legal_name", "ORT": "city", "anställda": "employees"}, ["legal_name", "city", "employees"])
    assert ignored == ["Övrigt"]
    assert [(r["legal_name"], r["city"], r["employees"]) for r in rows.orderBy("row_number").collect()] == [("Åkeri AB", "Umeå", "20-49"), (None, "Lund", None)]
    assert [extracts.delimiter_of(h) for h in ("a,b;c,d", '"a,b";c;d', "a\tb", "one")] == [",", ";", "\t", ","]
    path.write_bytes('a;b\n"two\nlines";ü\n'.encode())
    rows, _ = extracts.read_extract(spark, str(path), {"a": "legal_name", "b": "city"}, ["legal_name", "city"])
    assert [tuple(r)[:2] for r in rows.collect()] == [("two\nlines", "ü")]
    path.write_bytes(b"a;b\n")
    assert extracts.read_extract(spark, str(path), {"a": "legal_name"}, ["legal_name"])[0].count() == 0
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        extracts.read_extract(spark, str(path), {}, [])


def test_records_and_elements_are_bounded():
    """Quotes and brackets are carried over parts of any size; what is not closed is an error, not the rest of the file."""
    rows = ['a;"b\n', 'c";d\n', '"x ""y"" z";1\n', "last"]
    assert list(register_files.csv_records(iter(rows))) == [rows[0] + rows[1], rows[2], "last\n"]
    with pytest.raises(ValueError, match="not closed"):
        list(register_files.csv_records(iter(['a"b\n'] + ["c;d\n"] * 100), longest=40))
    with pytest.raises(ValueError, match="within quotes"):
        list(register_files.csv_records(iter(['a"b\n', "c\n"])))
    deep = [{"a": ["]", "}", '\\"', {"b": [1, [2, {}]]}], "ü,": "[x,{"}, "a,b", -1.5e3, [], {}, None, True, "\\\\"]
    text = json.dumps(deep, ensure_ascii=False)
    for size in (1, 2, 3, 7, 1000):
        assert list(register_files.json_elements(io.StringIO(f" \n{text} tail"), size)) == deep
    for bad in ("", "[", "[1, 2", '{"a": 1}', "x [1]", "1, [2]", '["a', "[1, x]", "[1}x"):
        with pytest.raises(ValueError):
            list(register_files.json_elements(io.StringIO(bad), 2))
    with pytest.raises(ValueError, match="of over"):
        list(register_files.json_elements(io.StringIO('["' + "x" * 100), 4, longest=50))


def test_snapshots(spark):
    at = F.lit("2025-01-02").cast("timestamp")
    signals = spark.createDataFrame([("1", '{"verdict":"watch"}'), ("9", "{}")], "registry_code string, signal string").withColumn("observed_at", at)
    path = new_path(spark, "signals")
    snapshots.export(signals, path)
    loaded = snapshots.load(spark, path)
    companies = spark.createDataFrame([(100, "1")], "company_id long, registry_code string")
    stored = spark.createDataFrame([], "company_id long, signal string, observed_at timestamp")
    first = snapshots.import_signals(stored, loaded, companies)
    assert sorted((r["company_id"] or 0, r["outcome"]) for r in first.collect()) == [(0, "unknown_code"), (100, "new")]
    again = snapshots.import_signals(first.where("company_id = 100"), loaded, companies)
    assert {r["outcome"] for r in again.collect()} == {"unchanged", "unknown_code"}
    assert snapshots.to_markdown(companies) == "| company_id | registry_code |\n| --- | --- |\n| 100 | 1 |"


def test_stream_equals_batches(spark):
    source, folder, checkpoint = (new_path(spark, n) for n in ("in", "facts", "cp"))
    rows = lambda *x: spark.createDataFrame(x, "company_id long, source_id string, field_name string, value string, at string").withColumn("observed_at", F.col("at").cast("timestamp")).drop("at")
    rows((1, "s", "f", "a", "2025-01-01"), (1, "s", "g", "b", "2025-01-01")).write.parquet(source)
    stream.start(spark.readStream.schema(stream.FACTS).parquet(source), folder, checkpoint).awaitTermination()
    rows((1, "s", "f", "c", "2025-01-03"), (2, "s", "f", "d", "2025-01-02")).write.mode("append").parquet(source)
    stream.start(spark.readStream.schema(stream.FACTS).parquet(source), folder, checkpoint).awaitTermination()
    got = sorted((r["company_id"], r["field_name"], r["value"]) for r in stream.current_facts(spark, folder).collect())
    assert got == [(1, "f", "c"), (1, "g", "b"), (2, "f", "d")]
    assert not stream.merge_batch(rows((9, "s", "f", "x", "2025-01-01")), 0, folder)
    assert stream.recent_counts(rows((1, "s", "f", "a", "2025-01-01"))).count() == 18


def test_wanted_files(spark):
    links = spark.createDataFrame([("u/1", "basic", None), ("u/2", "basic", None), ("u/a", "indicators", 2020), ("u/b", "indicators", 2024), ("u/c", "indicators", 2021)], "url string, kind string, year int")
    assert sorted(tuple(r) for r in register_files.wanted_files(links, [2021]).collect() if r["kind"] == "indicators") == [("indicators", 2021, "u/c"), ("indicators", 2024, "u/b")]
    assert register_files.wanted_files(links, []).where("kind = 'basic'").first()["url"] == "u/2"


def test_sink_publishes_both_kinds_together(spark):
    built = spark.createDataFrame([(1, []), (2, ["bad"]), (3, [])], "row long, errors array<string>")
    store = new_path(spark, "store")
    assert sink.published(spark, store).count() == 0
    assert sink.publish(built, store, "r1") == {"accepted": 2, "rejected": 1, "repeated": 0}
    assert sink.publish(built, store, "r1")["repeated"] == 1
    assert sink.publish(built.limit(0), store, "r2") == {"accepted": 0, "rejected": 0, "repeated": 0}
    built.withColumn("kind", F.lit("accepted")).write.partitionBy("kind").parquet(f"{store}/rows/part=cut-off")
    assert sorted((r["row"], r["run"]) for r in sink.rows_of(spark, store, "accepted", built).collect()) == [(1, "r1"), (3, "r1")]
    assert [(r["row"], list(r["errors"])) for r in sink.rows_of(spark, store, "rejected", built).collect()] == [(2, ["bad"])]


def test_purge_keeps_audit_and_suppressions(spark):
    some = lambda n: spark.range(n).withColumnRenamed("id", "x")
    audit = spark.createDataFrame([("a", "login", "{}", None)], "actor string, action string, details string, at timestamp")
    tables = {"companies": some(3), "contacts": some(2), "contact_suppressions": some(4), "audit_events": audit, "sources": spark.createDataFrame([("s",), ("old",)], "source_id string")}
    after = {k: v.collect() for k, v in sink.purge(tables, ["s"], "me", "2025-01-01").items()}
    assert {k: len(v) for k, v in after.items()} == {"companies": 0, "contacts": 0, "contact_suppressions": 4, "audit_events": 2, "sources": 1}
    assert json.loads(next(r["details"] for r in after["audit_events"] if r["actor"] == "me")) == {"companies": 3, "contacts": 2, "sources": 1}


def test_shared_folder_is_demanded_of_clusters(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://x"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())
