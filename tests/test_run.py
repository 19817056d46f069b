"""A whole run over a handful of recorded pages."""


from factweave.operators import report as P
from factweave.plans import run

SHELL = "<html><head><title>{t}</title><meta property='og:site_name' content='Northfield'></head><body><nav><a href='/'>Home</a></nav><main>{b}</main><footer>© 2024 Northfield University.</footer></body></html>"


def page(title, duration, fee, extra="", subject="Finance"):
    body = f"<h1>Online MBA in {subject}</h1><p>Duration: {duration}</p><h2>Eligibility</h2><p>Graduation with 50% marks</p><h2>Fees</h2><p>Total program fee {fee}</p>{extra}"
    return SHELL.format(t=title, b=body)


LIST = "<h2>Specializations</h2><ul><li>Corporate Finance</li><li>Risk Analytics</li>{more}</ul><p>Earn 90 credits</p>"
PAGES = [
    (1, "https://partner.org/mba-finance", page("Online MBA Finance", "24 months", "₹1,20,000", LIST.format(more=""))),
    (2, "https://www.northfield.edu/mba-finance", page("MBA Finance | Northfield University", "2 years", "₹1.3 lakh", LIST.format(more="<li>Market Law</li>"))),
    (3, "https://www.northfield.edu/", SHELL.format(t="Northfield University", b="<h1>Welcome</h1>")),
    (4, "https://www.northfield.edu/mba-marketing", page("MBA Marketing", "2 years", "₹1,10,000", subject="Marketing")),
    (5, "https://partner.org/law", SHELL.format(t="Bachelor of Arts in Law", b="<h1>BA in Law</h1><p>Mode: Online</p>")),
]


def test_run(spark, tmp_path):
    pages = run.parsed(spark.createDataFrame(PAGES, "page_id long, url string, html string")).cache()
    targets = spark.createDataFrame([(0, "https://partner.org/mba-finance/"), (1, "https://partner.org/law"), (2, "https://gone.org/")], "target_idx int, url string")
    found = run.resolve(run.identities(pages), targets, "northfield.edu", "https://www.northfield.edu/").cache()
    got = {r.target_idx: (r.outcome, r.master_page) for r in found.collect()}
    assert got == {0: ("success", 2), 1: ("authoritative_page_not_found", None), 2: ("target_unreachable", None)}
    summary = P.run_summary(found).first()
    assert (summary.targets, summary.success, summary.not_found, summary.unreachable) == (3, 1, 1, 1)
    rows = run.report(pages, found).cache()
    said = {r.field: r.status for r in rows.collect()}
    assert list(said) and len(said) == 10
    assert said["Course Duration"] == "MATCH" and said["Eligibility"] == "MATCH" and said["Fee Structure"] == "UNMATCH" and said["Credits"] == "MATCH"
    assert said["Specializations"] == "PARTIAL" and said["Discount"] == "MATCH" and said["Others"] == "MATCH" and said["Accreditation"] == "NEEDS_REVIEW"
    wide = P.wide(rows, ["target_idx"]).first()
    assert wide["Fee Structure"] == "UNMATCH"
    run.write_report(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "fields")).count() == 10
    first = [r.field for r in P.sorted_report(rows, "status", "position", descending=True).collect()]
    assert first[0] == "Fee Structure"
    assert P.sorted_report(rows, "field", "position", equals={"status": "PARTIAL"}).count() == 1


def test_small_report_parts(spark):
    df = spark.createDataFrame([(1, "Page 10"), (2, "page 9"), (3, None)], "i int, name string")
    assert [r.i for r in P.sorted_report(df, "name", "i").collect()] == [2, 1, 3] and [r.i for r in P.sorted_report(df, "name", "i", True).collect()] == [3, 1, 2]
    log = spark.createDataFrame([("r", 1, 0, "queued"), ("r", 2, 0, "success"), ("r", 1, 1, "queued"), ("r", 2, 1, "processing")], "run string, ts int, target_idx int, state string")
    p = P.progress(log, ["run"]).first()
    assert (p.queued, p.processing, p.completed) == (0, 1, 1)
    words = spark.createDataFrame([(1, f"w{i:02d}", i) for i in range(20)], "k int, word string, n int")
    tip = P.misspelling_tip(words, "k").first()
    assert tip.words[0] == "w19" and len(tip.words) == 15 and tip.more == 5
    t = spark.createDataFrame([(1, 0, "10% discount")], "k int, idx int, raw_value string")
    facts = spark.createDataFrame([(1, 0, "X", "target_missing", "₹5", None, None)], "k int, idx int, name string, status string, master_value string, target_value string, note string")
    assert P.reconcile_discounts(facts, t, t, ["k"]).first().status == "match"
