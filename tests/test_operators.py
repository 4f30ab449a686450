import datetime as dt
import itertools
import random
from difflib import SequenceMatcher
from decimal import Decimal

from pyspark.sql import functions as F

from provena.operators import confidence, corrections, funnel, governance, identity, records, register, signals, versions
from provena.operators.graph import canonical, components

ROW = (
    "company_id long, fiscal_year int, period_start date, period_end date, currency string, unit string, statement_scope string, revenue decimal(20,2), operating_profit decimal(20,2), "
    "ebitda decimal(20,2), total_assets decimal(20,2), equity decimal(20,2), employees_fte decimal(12,2), filing_id string, review_status string"
)


def row(company, year, revenue=10_000_000, op=1_000_000, ebitda=2_000_000, scope="standalone", status="current", assets=20_000_000, equity=6_000_000, days=365, filing=None, currency="EUR"):
    d = lambda x: None if x is None else Decimal(str(round(x, 2)))
    start = dt.date(year, 1, 1)
    return (company, year, start, start + dt.timedelta(days=days - 1), currency, "EUR", scope, d(revenue), d(op), d(ebitda), d(assets), d(equity), Decimal(30), f"R{company}{year}" if filing is None else filing, status)


def test_financial_signal_and_cash(spark):
    rows = [row(1, y) for y in (2022, 2023, 2024)]
    rows += [row(2, 2023), row(2, 2024)]
    rows += [row(3, y) for y in (2022, 2023, 2024)] + [row(3, 2024, filing="X")]
    rows += [row(4, y, op=-5 if y == 2022 else 5) for y in (2022, 2023, 2024)]
    rows += [row(5, y, scope="consolidated") for y in (2022, 2023, 2024)]
    rows += [row(6, y, revenue=10_000_000 * 1.03 ** (y - 2022), ebitda=1_500_000 * 1.03 ** (y - 2022)) for y in (2022, 2023, 2024)]
    rows += [row(7, y, ebitda=None) for y in (2022, 2023, 2024)]
    rows += [row(8, y, status="superseded") for y in (2022, 2023, 2024)]
    rows += [row(9, y, op=None) for y in (2022, 2023, 2024)]
    df = spark.createDataFrame(rows, ROW)
    s = {r["company_id"]: r for r in signals.financial_signal(df, 5_000_000, 50_000_000, 2025).collect()}
    assert (s[1]["focus_band"], s[1]["quality_band"], s[1]["evidence_status"], s[1]["positive_profit_years"], list(s[1]["issues"])) == ("core", "core", "complete", 3, [])
    assert s[1]["three_year_median_margin"] == 0.1 and s[1]["three_year_revenue_cagr"] == 0 and s[1]["stable_revenue"] and s[1]["latest_equity_ratio"] == 0.3
    assert list(s[1]["filing_ids"]) == ["2022:R12022", "2023:R12023", "2024:R12024"]
    assert s[2]["evidence_status"] == "needs_data" and s[2]["quality_band"] == "unknown" and s[2]["issues"][0].startswith("Three consecutive")
    assert list(s[3]["issues"])[:2] == ["Latest fiscal year lacks one unique comparable standalone EUR report", "2024 has multiple current comparable reports"] and s[3]["latest_year"] == 2023
    assert s[4]["quality_band"] == "borderline" and s[5]["focus_band"] == "unknown" and s[5]["issues"][-1] == "No comparable annual revenue and operating profit"
    assert 8 not in s and s[9]["latest_year"] is None
    old = {r["company_id"]: r for r in signals.financial_signal(df, 5_000_000, 50_000_000, 2030).collect()}
    assert list(old[1]["issues"]) == ["Latest comparable fiscal year is older than two years"] and old[1]["evidence_status"] == "needs_data"
    c = {r["company_id"]: r for r in signals.cash_harvesting(df).collect()}
    assert c[1]["cash_harvesting_candidate"] and c[9]["cash_harvesting_candidate"] and c[9]["cash_year"] == 2024
    assert c[6]["cash_evidence_status"] == "evaluated" and not c[6]["cash_harvesting_candidate"]  # margin must be above 15 %
    assert c[7]["cash_evidence_status"] == "insufficient_evidence" and list(c[7]["cash_issues"]) == ["EBITDA is not available for FY2024, the latest comparable year"]
    assert not c[2]["cash_harvesting_candidate"] and not c[3]["cash_harvesting_candidate"]


def test_funnel_of_fourteen_companies(spark):
    """Nine peers, a group parent, a holding, a closing, a large and a gap company."""
    rows, companies = [], []
    for k in range(9):
        companies.append((k, f"Peer {k}", "R", ["62011"]))
        rows += [row(k, y, op=10_000_000 * (0.04 + 0.02 * k), equity=20_000_000 * (0.30 + 0.04 * k)) for y in (2022, 2023, 2024)]
    companies += [(9, "Parent", "R", ["62011"]), (10, "Holding", "R", ["64201"]), (11, "Closing", "L", ["62011"]), (12, "Large", "R", ["62011"]), (13, "Gap", "R", ["62011"])]
    rows += [row(k, y) for k in (9, 10, 11) for y in (2022, 2023, 2024)] + [row(9, 2024, revenue=50_000_000, scope="consolidated")]
    rows += [row(12, y, revenue=90_000_000, op=9_000_000) for y in (2022, 2023, 2024)] + [row(13, y) for y in (2022, 2024)]
    df = spark.createDataFrame(companies, "company_id long, legal_name string, registry_status string, industry_codes array<string>")
    items = funnel.prospects(df, spark.createDataFrame(rows, ROW), 5_000_000, 50_000_000, 2025).cache()
    assert [r["n"] for r in funnel.stages(items).orderBy("position").collect()] == [14, 13, 12, 11, 11, 10, 0]
    found = {r["company_id"]: r for r in items.collect()}
    assert found[0]["peer_count"] == 10 and found[10]["peer_count"] is None and found[12]["next_action"] == "outside_size_band" and found[11]["next_action"] == "exclude"
    assert found[9]["flags"] == ["group_parent", "cash_harvesting_candidate"] and found[9]["consolidated_revenue"] == 50_000_000
    ranked = [r["company_id"] for r in funnel.listed(items).collect()]
    assert ranked[0] == 8 and ranked[-1] == 11 and set(ranked[:10]) == set(range(10))
    options = {r["code"]: r["n"] for r in funnel.sector_options(df).collect()}
    assert options == {"62": 13, "others": 1}
    others = funnel.in_sector(items, funnel.sector_options(df), "Others")
    assert [r["company_id"] for r in others.collect()] == [10]
    assert funnel.header_counts(items).first()["advisor_review"] == 10
    text = {r["company_id"]: r["review_reasons"] for r in funnel.brief(items, 5_000_000, 50_000_000).collect()}
    assert text[8][0] == "Sales of €10.0m in 2024, within the band of €5.0m to €50.0m" and any("Parent of a group in 2024, with sales of €50.0m" in x for x in text[9])


def test_histories(spark):
    rows = [(1, "a", "2025-01-01"), (1, "a", "2025-01-02"), (1, "b", "2025-01-03"), (1, "a", "2025-01-04"), (2, None, "2025-01-01")]
    df = spark.createDataFrame(rows, "k int, v string, at string").withColumn("id", F.monotonically_increasing_id())
    got = [(r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in versions.history(df, ["k"], "v", "at", "id").orderBy("k", "version").collect()]
    assert got == [(1, "a", "2025-01-01", "2025-01-03"), (1, "b", "2025-01-03", "2025-01-04"), (1, "a", "2025-01-04", None), (2, None, "2025-01-01", None)]
    assert versions.versions_once(df.where("k = 1"), ["k"], "v", "at").count() == 2
    a, b = df.where("at = '2025-01-02' or k = 2"), spark.createDataFrame([(1, "a", "2025-02-01"), (3, "z", "2025-02-01")], "k int, v string, at string")
    outcome = {r["k"]: (r["outcome"], r["at"]) for r in versions.merge(a, b, ["k"], "v", "at").collect()}
    assert outcome == {1: ("unchanged", "2025-02-01"), 2: ("kept", "2025-01-01"), 3: ("new", "2025-02-01")}
    again = versions.merge(b, b, ["k"], "v", "at")
    assert {r["outcome"] for r in again.collect()} == {"unchanged"}


def slow_confidence(evidence, now):
    """Greedy clusters, written out."""
    fresh = [e for e in evidence if not e[6] and now - e[4] <= 365]
    clusters = []
    width = lambda e: (e[3] if e[3] is not None else 10**12) - e[2]
    for e in sorted(fresh, key=lambda e: (e[5], width(e), -e[4])):
        for c in clusters:
            hi = lambda x: x[3] if x[3] is not None else 10**12
            if c[0][2] <= hi(e) and e[2] <= hi(c[0]):
                c.append(e)
                break
        else:
            clusters.append([e])
    fixed = [e for e in evidence if e[6]]
    if fixed:
        best = max(fixed, key=lambda e: e[4])
        return "manually-corrected", best[2]
    if len(clusters) > 1:
        return "conflicting", min(clusters[0], key=lambda e: (width(e), e[5]))[2]
    if clusters:
        multi = len({e[1] for e in clusters[0]}) > 1
        return "multi-source" if multi else clusters[0][0][7], min(clusters[0], key=lambda e: (width(e), e[5]))[2]
    return ("old", min(evidence, key=lambda e: (e[5], -e[4]))[2]) if evidence else ("unknown", None)


def test_confidence_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for company in range(150):
        for _ in range(r.randint(1, 6)):
            lo, source = r.randint(0, 60), r.randint(0, 3)
            rows.append((company, f"s{source}", lo, r.choice([lo, lo + r.randint(0, 40), None]), r.randint(0, 700), source, r.random() < 0.05, "verified" if source == 0 else "estimated"))
    df = spark.createDataFrame(rows, "company_id long, source_id string, lo long, hi long, day int, trust_rank int, is_correction boolean, base_confidence string")
    df = df.withColumn("observed_at", F.expr("timestamp'2023-01-01' + make_dt_interval(day)")).withColumn("field_name", F.lit("employees"))
    got = {x["company_id"]: (x["status"], x["lo"]) for x in confidence.resolve(df, F.expr("timestamp'2023-01-01' + make_dt_interval(700)")).collect()}
    for company in range(150):
        mine = [x for x in rows if x[0] == company]
        if len({(x[5], x[4]) for x in mine}) < len(mine):
            continue  # ties have no order in the brute force
        assert got[company] == slow_confidence(mine, 700), mine


def test_ordered_resolution(spark):
    keys = [
        (1, "registry_id", "EE:1", False), (1, "domain", "a.ee", False), (2, "domain", "a.ee", False), (2, "vat_id", "V1", False), (3, "vat_id", "V1", False),
        (4, "registry_id", "EE:2", False), (4, "domain", "a.ee", False), (5, "registry_id", "EE:2", False), (6, "registry_id", "EE:1", False), (6, "vat_id", "V9", False), (7, "vat_id", "V9", False),
        (8, "source_key", "s|1", False),
    ]
    df = spark.createDataFrame(keys, "row long, kind string, value string, derived boolean")
    got = {r["row"]: (r["company"], r["outcome"], r["links"]) for r in identity.resolve(df).collect()}
    assert got == {1: (1, "new", 0), 2: (1, "matched", 0), 3: (1, "matched", 0), 4: (4, "new", 1), 5: (4, "matched", 0), 6: (1, "matched", 0), 7: (1, "matched", 0), 8: (8, "new", 0)}


def test_pair_scores(spark):
    rows = [(1, "oun ko", "EE", "Tallinn", "EE:1", None, "a.ee", "62011"), (2, "oun ko", "EE", "tallinn", None, "V", "a.ee", "62020"), (3, "oun kool", "EE", "Tartu", "EE:2", "V", None, "01"), (4, "oun ko", "FI", None, None, None, None, None)]
    rows = [(*r[:4], *[[x] if x else None for x in r[4:7]], r[7]) for r in rows]
    p = spark.createDataFrame(rows, "id long, name string, country string, city string, registry_keys array<string>, vat_keys array<string>, domains array<string>, industry_code string")
    pairs = identity.candidate_pairs(p)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]
    got = {(r["a"], r["b"]): (r["score"], r["band"]) for r in identity.score_pairs(p, pairs).collect()}
    assert got == {(1, 2): (100, "likely"), (1, 3): (0, "none"), (2, 3): (85, "likely")}
    assert identity.new_candidates(p, spark.createDataFrame([(1, 2)], "a long, b long")).count() == 1
    reasons = {(r["a"], r["b"]): [(x["signal"], x["effect"]) for x in r["reasons"]] for r in identity.score_pairs(p, pairs).collect()}
    assert reasons[1, 3] == [("registry_id", "against"), ("name", "for"), ("city", "against")] and ("vat_id", "for") in reasons[2, 3]
    foreign = identity.score_pairs(p, spark.createDataFrame([(1, 4)], "a long, b long")).first()
    assert (foreign["score"], foreign["band"], [x["effect"] for x in foreign["reasons"]]) == (0, "none", ["block"])


def test_pair_scores_against_brute_force(spark):
    """Random profiles with several keys each; the bounds before the matcher change no score."""
    r = random.Random(8)
    words = ["oun", "kool", "kooli", "puit", "puidu", "tallinn", "ehitus", "ehitused"]
    some = lambda pool: r.sample(pool, r.randint(0, 2))
    rows = [
        (i, " ".join(r.choices(words, k=r.randint(0, 3))), r.choice(["EE", "FI"]), r.choice(["Tartu", "tartu", "Narva", None, ""]), some(["EE:1", "EE:2", "FI:1"]), some(["V1", "V2"]), some(["a.ee", "b.ee"]), r.choice(["6201", "6202", "01", None]))
        for i in range(60)
    ]
    p = spark.createDataFrame(rows, "id long, name string, country string, city string, registry_keys array<string>, vat_keys array<string>, domains array<string>, industry_code string")
    every = [(a, b) for a in range(60) for b in range(a + 1, 60)]

    def slow(x, y):
        if x[2] != y[2]:
            return 0
        points = 0
        nx, ny = ({k for k in v[4] if k.startswith(v[2])} for v in (x, y))
        points -= 60 if nx and ny and not nx & ny else 0
        points += 60 if set(x[5]) & set(y[5]) else 0
        points += 45 if set(x[6]) & set(y[6]) else 0
        if x[1] and y[1]:
            wx, wy = set(x[1].split()), set(y[1].split())
            s = 1 if x[1] == y[1] else max(SequenceMatcher(None, x[1], y[1]).ratio(), len(wx & wy) / len(wx | wy))
            points += 50 if s >= 0.999 else 35 if s >= 0.85 else 0
        if x[3] and y[3]:
            points += 15 if x[3].lower() == y[3].lower() else -10
        points += 5 if x[7] and y[7] and x[7][:2] == y[7][:2] else 0
        return max(0, min(100, points))

    got = {(x["a"], x["b"]): x["score"] for x in identity.score_pairs(p, spark.createDataFrame(every, "a long, b long")).collect()}
    assert got == {(a, b): slow(rows[a], rows[b]) for a, b in every} and len(set(got.values())) > 8


def test_merge_guards(spark):
    c = spark.createDataFrame([(1, "EE"), (2, "EE"), (3, "FI"), (4, "EE"), (5, "EE")], "company_id long, country string")
    ids = spark.createDataFrame([(1, "registry_id", "EE:1", False), (2, "registry_id", "EE:1", False), (2, "registry_id", "EE:2", False), (4, "registry_id", "EE:4", False), (5, "registry_id", "EE:1", True)], "company_id long, kind string, value string, derived boolean")
    asked = [(1, 2, 1, "open"), (1, 3, 3, "open"), (1, 4, 4, "open"), (1, 5, 1, "open"), (1, 5, 2, "dismissed"), (1, 9, 1, "open")]
    checked = identity.merge_problems(spark.createDataFrame(asked, "a long, b long, survivor long, status string"), c, ids)
    got = {(r["a"], r["b"], r["survivor"]): list(r["problems"]) for r in checked.collect()}
    assert got == {(1, 2, 1): [], (1, 3, 3): ["different countries"], (1, 4, 4): ["different register numbers"], (1, 5, 1): [], (1, 5, 2): ["already dismissed", "survivor is neither of the two"], (1, 9, 1): ["unknown company"]}
    assert sorted(map(tuple, identity.merges_of(checked).collect())) == [(2, 1), (5, 1)]
    assert identity.merge_audit(checked, "me", F.current_timestamp()).count() == 2


def test_text_evidence_and_labels(spark):
    """Every fact's label and the chosen value against a fold over the facts of each field."""
    r = random.Random(12)
    pool = {"legal_name": ["Õun OÜ", "OUN", "Kool AS"], "industry_code": ["62.01", "6201", "6202"], "website": ["A.ee ", "a.ee", "b.ee"], "sector": ["Food", "food", "Wood"]}
    rows = []
    for company in range(60):
        for field, values in pool.items():
            for _ in range(r.randint(1, 5)):
                source = r.randint(0, 2)
                rows.append((len(rows), company, field, f"s{source}", r.choice(values), r.randint(0, 700), source, r.random() < 0.08, "verified" if source == 0 else "estimated"))
    df = spark.createDataFrame(rows, "fact_id long, company_id long, field_name string, source_id string, value string, day int, trust_rank int, is_correction boolean, base_confidence string")
    df = df.withColumn("observed_at", F.expr("timestamp'2023-01-01' + make_dt_interval(day)"))
    now = F.expr("timestamp'2023-01-01' + make_dt_interval(700)")
    same = {"Õun OÜ": 0, "OUN": 0, "Kool AS": 1, "62.01": 0, "6201": 0, "6202": 1, "A.ee ": 0, "a.ee": 0, "b.ee": 1, "Food": 0, "food": 0, "Wood": 1}
    want, labels = {}, {}
    for company, field in {(x[1], x[2]) for x in rows}:
        mine = [x for x in rows if x[1:3] == (company, field)]
        if len({(x[6], x[5], x[7]) for x in mine}) < len(mine):
            continue  # ties have no order in the brute force
        facts, fixes = [x for x in mine if not x[7]], sorted((x for x in mine if x[7]), key=lambda x: -x[5])
        current = sorted((x for x in facts if x[5] >= 335), key=lambda x: (x[6], -x[5]))
        groups = []
        for x in current:
            fitting = [g for g in groups if same[g[0][4]] == same[x[4]]]
            if fitting:
                fitting[0].append(x)
            else:
                groups.append([x])
        wordings = field == "sector"
        status = "conflicting" if len(groups) > 1 and not wordings else "multi-source" if groups and len({x[3] for x in groups[0]}) > 1 else groups[0][0][8] if groups else "old" if facts else "unknown"
        old = min(facts, key=lambda x: (x[6], -x[5]), default=None)
        shown = fixes[0] if fixes else groups[0][0] if groups else old
        want[company, field] = ("manually-corrected" if fixes else status, shown and shown[4])
        for x in facts:
            chosen = groups and x in groups[0]
            label = "old" if x[5] < 335 else "conflicting" if status == "conflicting" else "multi-source" if status == "multi-source" and chosen else x[8]
            labels[x[0]] = (label, not fixes and bool(chosen or not groups and x is old))
        for k, x in enumerate(fixes):
            labels[x[0]] = ("old" if k else "manually-corrected", not k)
    got = {(x["company_id"], x["field_name"]): (x["status"], x["value"]) for x in confidence.resolve(df, now).collect()}
    assert {k: got[k] for k in want} == want and len({s for s, _ in want.values()}) == 6
    found = {x["fact_id"]: (x["label"], x["supporting"]) for x in confidence.label_facts(df, now).collect()}
    assert {k: found[k] for k in labels} == labels and len(found) == len(rows)


def test_graphs(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["id"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in itertools.chain(*edges) if x in got} and len(got) >= len({x for e in edges for x in e if e[0] != e[1]})
    chain = [(1, 2), (2, 3), (3, None), (4, None), (5, 6), (6, 7), (7, 5)] + [(i, i - 1) for i in range(101, 160)] + [(100, None)]
    got = {x["id"]: x["root"] for x in canonical(spark.createDataFrame(chain, "id long, to long"), rounds=8).collect()}
    assert got[1] == got[2] == 3 and got[4] == 4 and got[159] == 100 and got[5] == got[6] == got[7] == 5


def test_records(spark):
    rows = [("OÜ Õun", "Eesti", "10065762", "www.oun.ee", "20-49", "5m", "eur", "family"), (None, "EE", None, None, None, None, None, None), ("X", "Atlantis", None, None, None, None, None, None),
            ("Y", "FI", "bad", "gmail.com", "many", "5m", None, "owned"), ("Z", "DE", None, None, "5", None, None, "unknown")]
    df = spark.createDataFrame(rows, "legal_name string, country string, registry_id string, website string, employees string, revenue string, currency string, ownership_type string")
    out = records.build(df, ["EE", "FI"], ["EE", "FI"]).collect()
    assert (out[0]["registry_key"], out[0]["domain"], out[0]["key"], out[0]["region"], len(out[0]["warnings"])) == ("EE:10065762", "oun.ee", "EE:10065762", "baltics", 0)
    assert out[0]["facts"]["employees"] == '{"min":20,"max":49}' and out[0]["facts"]["revenue"] == '{"min":5000000,"max":5000000,"currency":"EUR"}' and out[0]["facts"]["ownership_type"] == '{"v":"family-owned"}'
    assert [len(r["errors"]) for r in out] == [0, 1, 1, 0, 1] and out[1]["facts"] is None
    for verified in (False, True):
        facts = records.build(df, ["EE", "FI"], ["EE", "FI"], enrichment=True, verified_website=verified).first()["facts"]
        assert "registry_id" not in facts and ("website" in facts) == verified
    assert len(out[3]["warnings"]) == 6 and out[3]["key"].startswith("row:") and set(out[3]["facts"]) == {"legal_name", "website"}


def test_governance(spark):
    s = spark.createDataFrame([("a", "approved", True, "csv", "open", "n", ["FI"]), ("b", "pending", False, "api", "odd", "n", ["DE"]), ("c", None, None, None, None, "zz", ["FI"])],
                              "source_id string, permission_status string, enabled boolean, connector_type string, source_mode string, region string, countries array<string>")
    got = {r["source_id"]: len(r["reasons"]) for r in governance.ingestion_gate(s, {"n": (["FI"], ["open"])}, ["csv"], ["open"], ["FI"]).collect()}
    assert got == {"a": 0, "b": 7, "c": 5}
    catalog = spark.createDataFrame([("a", "denied"), ("n", "approved")], "source_id string, permission_status string")
    sync = {r["source_id"]: (r["permission_status"], r["enabled"], r["outcome"]) for r in governance.sync_sources(catalog, s).collect()}
    assert sync == {"a": ("denied", False, "kept"), "n": ("approved", False, "added"), "b": ("pending", False, "unlisted"), "c": (None, False, "unlisted")}
    done = corrections.accepted(spark.createDataFrame([("city", "x"), ("city", " "), ("vat_id", "x")], "field_name string, value string"))
    assert [r["problem"] is None for r in done.collect()] == [True, False, False]


def test_capital_and_metrics(spark):
    entries = [(1, "2500", "EUR", "2020-01-01"), (2, "5000", "EUR", None), (3, "9", "EUR", "2021-01-01")]
    df = spark.createDataFrame([(entries,)], "e array<struct<entry_no: int, amount: string, currency: string, ends: string>>")
    assert df.select(register.current_capital(F.col("e")).alias("c")).first()["c"]["amount"] == "5000"
    rows = [("R", "standalone", "Bilanss", "Assets", "1 000,50", 0, 1), ("R", "standalone", "Bilanss detailne", "Assets", "9", 1, 0), ("R", "standalone", "Bilanss", "Revenue", "x", 0, 2), ("R", "standalone", "Muu", "Other", "1", 0, 3)]
    found = register.choose_metrics(spark.createDataFrame(rows, "report_id string, scope string, table_name string, element string, raw string, is_detail int, line_no int"), register.ELEMENTS).first()
    assert found["total_assets"] == Decimal("1000.50") and found["revenue"] is None and found["differing"] == 1
