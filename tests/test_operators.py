"""Comparison, order-dependent, resolution and understanding operators on small relations."""

import random

from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import compare as C
from factweave.operators import resolve as R
from factweave.operators import understand as U
from factweave.operators import windows as W
from factweave.sources import crawl as S


def claims(spark, rows):
    return spark.createDataFrame(rows, "k int, field_key string, idx int, raw_value string")


def test_fields_take_the_first_claim_and_keep_missing_sides(spark):
    t = claims(spark, [(1, "duration", 1, "24 months"), (1, "duration", 2, "3 years"), (1, "fees", 3, "$100"), (1, "mode", 4, "Online"), (2, "fees", 1, "soon ₹")])
    m = claims(spark, [(1, "duration", 1, "2 years"), (1, "fees", 1, "₹100"), (1, "eligibility", 2, "any"), (2, "fees", 1, "₹5")])
    got = {(r.k, r.field_key): r.status for r in C.compare_fields(t, m, ["k"]).collect()}
    assert got == {
        (1, "duration"): "match", (1, "fees"): "mismatch", (1, "mode"): "source_missing", (1, "eligibility"): "asset_missing", (2, "fees"): "normalization_issue",
    }
    fields = spark.createDataFrame([("fees",), ("mode",)], "field_key string")
    got = {(r.k, r.field_key): r.status for r in C.compare_fields(t, m, ["k"], fields).collect()}
    assert got[(2, "mode")] == "both_missing" and len(got) == 4


def items(spark, rows):
    return spark.createDataFrame(rows, "k int, idx int, value string")


def test_list_diff_orders_master_first(spark):
    m = items(spark, [(1, 0, "Finance"), (1, 1, " HR "), (1, 2, "finance")])
    t = items(spark, [(1, 0, "Law"), (1, 1, "hr"), (2, 0, "X")])
    got = [(r.k, r.item, r.status, r.position) for r in C.list_diff(t, m, ["k"]).orderBy("k", "position").collect()]
    assert got == [(1, "finance", "removed", 1), (1, "hr", "match", 2), (1, "law", "added", 3), (2, "x", "added", 1)]
    said = {r.k: r.status for r in C.list_status(C.list_diff(t, m, ["k"]), ["k"]).collect()}
    assert said == {1: "partial_match", 2: "master_missing"}


def test_set_diff_reuses_targets_and_knows_concepts(spark):
    m = items(spark, [(1, 0, "HRM"), (1, 1, "Human Resources (Optional)"), (1, 2, "Supply Chain Analytics"), (1, 3, "Law")])
    t = items(spark, [(1, 0, "Human Resource Management"), (1, 1, "Supply chain")])
    got = {r.value: r.target_value for r in C.set_diff(m, t, ["k"]).collect()}
    assert got["HRM"] == "Human Resource Management" and got["Supply Chain Analytics"] == "Supply chain" and got["Law"] is None
    assert C.set_diff(m, t, ["k"], stems=True).count() == 4


def test_greedy_pairs_use_each_target_once(spark):
    m = items(spark, [(1, 0, "data science"), (1, 1, "data mining"), (1, 2, "law")])
    t = items(spark, [(1, 0, "data engineering"), (1, 1, "LAW"), (1, 2, "art")])
    got = {(r.m_value, r.t_value, r.status) for r in C.greedy_pairs(m, t, ["k"]).collect()}
    assert got == {
        ("data science", "data engineering", "needs_review"), ("data mining", None, "target_missing"), ("law", "LAW", "match"), (None, "art", "master_missing"),
    }


def facts(spark, rows):
    return spark.createDataFrame(rows, "k int, idx int, name string, status string, master_value string, target_value string, note string")


def test_sub_facts(spark):
    rows = [
        (1, 0, "A", "match", "1", "1", None), (1, 1, "B", "changed", "1", "2", None), (1, 2, "C", "target_missing", "1", None, None), (1, 3, "D", "needs_review", None, None, None),
        (2, 0, "A", "match", "1", "1", None), (2, 1, "B", "target_missing", "1", None, None), (3, 0, "A", "target_missing", "1", None, None),
        (4, 0, "A", "needs_review", None, None, "look"), (4, 1, "B", "match", "1", "1", None), (5, 0, "A", "master_missing", None, "1", None), (6, 0, "A", "needs_review", None, None, "look"),
    ]
    got = {r.k: (r.status, r.notes) for r in C.aggregate_sub_facts(facts(spark, rows), ["k"]).collect()}
    assert got[1] == ("changed", 'A matches. B differs (Master: "1" / Target: "2"). C is missing on Target. (+1 more difference.)')
    assert got[2] == ("partial_match", "A matches. B is missing on Target.") and got[3] == ("target_missing", "A is missing on Target.")
    assert got[4] == ("partial_match", "look") and got[5] == ("match", None) and got[6] == ("needs_review", "look")


def pool(spark, rows):
    return spark.createDataFrame(rows, "k int, idx int, raw_value string, role string")


def test_fee_slots_and_comparison(spark):
    m = pool(spark, [(1, 0, "Semester fee: ₹50,000", None), (1, 1, "EMI ₹5,000 monthly", None), (1, 2, "Application fee $10", None), (1, 3, "Total fee soon", None), (1, 4, "Annual fee ₹1 lakh", None)])
    t = pool(spark, [(1, 0, "Semester fee: $700", None), (1, 1, "Tuition ₹50,000", None), (1, 2, "EMI from ₹5,006 per month", None), (1, 3, "Application fee $12", None), (1, 4, "Annual fee ₹90,000 ₹1,00,000", "original")])
    got = {r.component: r.status for r in C.compare_fees(t, m, ["k"]).collect()}
    assert got == {"Semester Fee": "match", "Monthly EMI": "match", "Application Fee": "changed", "Full Fee": "needs_review", "Annual/Yearly Fee": "match"}
    fixed = spark.createDataFrame([(1, "Full Fee", 300000.0, "INR", "Full Fee: ₹3,00,000")], "k int, component string, amount double, currency string, raw_value string")
    fixed = fixed.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.component: r.status for r in C.compare_fees(t, m, ["k"], fixed).collect()}
    assert got["Full Fee"] == "target_missing"


def test_eligibility(spark):
    df = spark.createDataFrame([(1, "Graduation with 50%", "Bachelor's degree, 55%, 2 years of experience"), (2, "12th", "12th")], "k int, t string, m string")
    got = {(r.k, r.name): r.status for r in C.eligibility_sub_facts(df, ["k"], "t", "m").collect()}
    assert got == {(1, "Qualification requirement"): "match", (1, "Minimum percentage requirement"): "changed", (1, "Work experience requirement"): "target_missing", (2, "Qualification requirement"): "match"}


def test_phrases_and_attributes(spark):
    c = claims(spark, [(1, "r", 0, "NIRF Rank 12, 2023 and Top 10 Universities"), (1, "r", 1, "Well known"), (1, "r", 2, "Please wait"), (1, "r", 3, "benefits")])
    got = [r.raw_value for r in C.fact_phrases(c, C.RANKINGS, C.EXCLUDED).orderBy("idx", "part").collect()]
    assert got == ["NIRF Rank 12, 2023", "Top 10 Universities", "Well known"]
    t = claims(spark, [(1, "mode", 0, "Online only"), (1, "internship", 0, "Not included"), (1, "certifications", 0, "3 certificates")])
    m = claims(spark, [(1, "mode", 0, "online ONLY"), (1, "internship", 0, "Included"), (1, "studyMaterial", 0, "Books"), (1, "certifications", 0, "2 certificates")])
    got = {r.name: r.status for r in C.compare_others(t, m, ["k"]).collect()}
    assert got == {"Learning Mode": "match", "Internship": "changed", "Study Material": "target_missing", "Certification": "changed"}


def test_curriculum_states(spark):
    values = ["Semester 1", "Accounting", "Specialization:", "Menu A", "Semester 2", "Statistics", "HRM", "AI", "Menu B", "Core Subjects", "Ethics", "AI", "Law"]
    f = items(spark, [(1, i, v) for i, v in enumerate(values)])
    s = spark.createDataFrame([(1, "Human Resources"), (1, "Artificial Intelligence")], "k int, value string")
    assert [r.value for r in C.keep_curriculum(f, ["k"], s).orderBy("idx").collect()] == ["Accounting", "Statistics", "Ethics", "AI", "Law"]


def test_report(spark):
    rows = spark.createDataFrame([(1, "match"), (1, "partial_match"), (2, "not_applicable")], "k int, status string").withColumn("status", C.report_status("status"))
    got = {r.k: (r.n_match, r.n_partial, r.overall_status) for r in C.report_summary(rows, ["k"]).collect()}
    assert got == {1: (1, 1, "changes_found"), 2: (1, 0, "verified_match")}


def test_heading_context_and_labels(spark):
    b = spark.createDataFrame(
        [(1, 0, "h", "Fees", False), (1, 1, "p", "Total Fee", False), (1, 2, "p", "₹1,20,000", True), (1, 3, "p", "₹1,00,000", False), (1, 4, "p", "A long sentence about nothing in particular here", False), (1, 5, "p", "₹5", False)],
        "k int, idx int, tag string, text string, struck boolean",
    )
    rows = W.heading_context(b, ["k"], F.col("tag") == "h", "text").where("tag = 'p'")
    got = [(r.text, r.fee_role) for r in W.label_value_pairs(rows, ["k"]).orderBy("idx").collect()]
    assert got == [("Total Fee: ₹1,20,000", "original"), ("Total Fee: ₹1,00,000", "discounted")]


def test_skip_levels(spark):
    h = [(1, 1, "Top"), (2, 2, "Other Programs"), (3, 3, "MBA"), (4, 2, "Fees"), (5, 2, "Related courses"), (6, 4, "deep"), (7, 1, "End")]
    df = spark.createDataFrame([(h,)], "h array<struct<idx:int,level:int,text:string>>")
    kept = df.select(W.skip_levels(F.col("h"), lambda x: x["text"].rlike("(?i)(other|related).*(programs|courses)")).alias("k")).first().k
    assert [x.text for x in kept] == ["Top", "Fees", "End"]


def test_runs_states_snapshots(spark):
    e = spark.createDataFrame([(1, i, c) for i, c in enumerate("abbaaabcb")], "k int, idx int, c string")
    assert [r.idx for r in W.runs(e, ["k"], F.col("c") == "a").orderBy("idx").collect()] == [3, 4, 5]
    assert [r.idx for r in W.state_filter(e, ["k"], F.col("c") == "b", F.col("c") == "c").orderBy("idx").collect()] == [0]
    assert W.latest(e, ["k"], ["c"], ["idx"]).first().c == "b"
    assert sorted((r.c, r.idx, r.n_duplicates) for r in W.keep_first(e, ["k", "c"]).collect()) == [("a", 0, 3), ("b", 1, 3), ("c", 7, 0)]
    assert [r.idx for r in W.top_k(e, ["k"], [F.desc("idx")], 2).orderBy("rank").collect()] == [8, 7]


def pair(spark, **more):
    base = {
        "t_url": "https://a.org/mba", "c_url": "https://m.org/online-mba-finance", "t_title": None, "c_title": "Online MBA", "t_headings": None, "c_headings": ["Finance"], "t_degree": "MBA", "c_degree": "mba",
        "t_program": "MBA Finance", "c_program": "MBA in Finance", "t_institution": None, "c_institution": None, "t_brand": "X Online", "c_brand": "x  online", "t_page_type": "pg", "c_page_type": "pg",
    } | more
    kinds = ", ".join(f"{k} {'array<string>' if k.endswith('headings') else 'string'}" for k in base)
    return spark.createDataFrame([tuple(base.values())], kinds)


def test_scores(spark):
    r = R.score(pair(spark)).first()
    assert r.score == 60 + 15 + 10 + 15 + 5 and [b.signal for b in r.breakdown] == ["degree", "institution", "heading_keyword", "url_keyword", "page_type"]
    nothing = {"c_degree": "BBA", "c_brand": "y", "c_title": "Home", "c_headings": [], "c_url": "https://m.org/", "c_page_type": "other"}
    assert R.score(pair(spark, **nothing), homepage="https://m.org").first().score == -20
    assert R.score(pair(spark, **nothing)).first().score == 0


def test_selection_boundaries(spark):
    def choose(*scores):
        df = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(scores)], "t int, c int, score int, c_degree string")
        r = R.select_page(df, "t", "c", "c").first()
        return r.selected, r.confidence, r.failure_reason

    assert choose((39, "MBA")) == (None, None, "authoritative_page_not_found")
    assert choose((40, "MBA")) == (0, "medium", None) and choose((69, "MBA")) == (0, "medium", None) and choose((70, "MBA")) == (0, "high", None)
    assert choose((80, "MBA"), (66, "MBA")) == (None, None, "ambiguous_candidates") and choose((66, "MBA"), (81, "MBA")) == (1, "high", None)
    assert choose((80, "PGDP"), (80, "MBA")) == (1, "high", None) and choose((80, "MBA"), (80, "BBA")) == (None, None, "ambiguous_candidates")
    assert choose((80, "PGDP"), (80, "MBA"), (80, "MBA")) == (None, None, "ambiguous_candidates") and choose((80, None), (80, "MBA")) == (None, None, "ambiguous_candidates")


def test_gates(spark):
    rows = [("A", "a ", None, None, False), ("A", "B", 1, 1, False), ("A", "B", 1, 2, False), ("A", "B", 1, None, False), ("A", None, None, None, False), ("A", "A", None, None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string, xi int, yi int, shared boolean")
    got = [r[0] for r in df.orderBy("i").select(R.registry_verdict("x", "y", "xi", "yi", "shared")).collect()]
    assert got == ["agree", "agree", "conflict", "inconclusive", "inconclusive", "inconclusive"]
    gate = lambda n, f, s: spark.range(1).select(R.institution_gate(F.lit(n), F.lit(f), F.lit(s).cast("double"))).first()[0]
    assert gate("agree", "conflict", None) is False and gate("agree", "inconclusive", 0.1) is True
    assert gate("inconclusive", "inconclusive", 0.74) is False and gate("inconclusive", "inconclusive", 0.75) is True and gate("inconclusive", "inconclusive", None) is True
    sub = spark.range(1).select(R.subject_tokens(F.lit("Online MBA in HR"), F.lit("MBA"))).first()[0]
    assert sub == ["human", "resource"]


def test_identity_tiers(spark):
    def tiers(*ids, default=None):
        r = spark.range(1).select(R.combine_tiers(*[F.lit(i).cast("string") for i in ids], F.lit(default).cast("string"), F.lit("single_university_default")).alias("x")).first().x
        return r.institution_id, r.method, r.fallback_applied, r.conflicting_ids

    assert tiers("a", None, None) == ("a", "url_identifier", False, None) and tiers("a", "a", None) == ("a", "combined_signals", False, None)
    assert tiers("a", "b", "a") == (None, "conflict", False, ["a", "b"]) and tiers(None, None, None) == (None, "unresolved", False, None)
    assert tiers(None, None, None, default="d") == ("d", "single_university_default", True, None)
    said = lambda *v: spark.range(1).select(R.compare_identity(*[F.lit(x) for x in v[:3]], F.lit(v[3]).cast("double"))).first()[0]
    assert said("agree", "conflict", "agree", 0.99) == "wrong_identity" and said("inconclusive", "inconclusive", "agree", None) == "verified" and said("inconclusive", "inconclusive", "inconclusive", 0.8) == "inconclusive"


def test_registry(spark):
    t = spark.createDataFrame(
        [(0, "https://go.a.org/x", None, None), (1, "https://z.net", "Uni A", "MBA"), (2, "https://z.net", "Uni B", "BBA"), (3, "https://z.net", "Nobody", None), (4, "https://z.net", "Uni B", "Law")],
        "idx int, url string, institution string, program string",
    )
    sources = spark.createDataFrame([("s1", "a", "a.org"), ("s2", "b", "b.org"), ("s3", "b", "bb.org")], "source_id string, institution_id string, host string")
    aliases = spark.createDataFrame([("uni  a", "a"), ("Uni B", "b")], "alias string, institution_id string")
    programs = spark.createDataFrame([("BBA", "s3")], "alias string, source_id string")
    got = {r.idx: (r.source_id, r.confidence, r.reason) for r in R.resolve_source(t, sources, aliases, programs).collect()}
    assert got == {0: ("s1", "high", None), 1: ("s1", "medium", None), 2: ("s3", "medium", None), 3: (None, None, "institution_not_registered"), 4: (None, None, "program_not_registered")}


def test_claims_by_label(spark):
    b = spark.createDataFrame(
        [(1, 0, None, "Course Duration: Please wait"), (1, 1, None, "Duration - 2 years"), (1, 2, "Eligibility", "Read more"), (1, 3, "Eligibility", "Graduates"), (1, 4, None, "Earn 90 credits here"), (1, 5, None, "100 Credits")],
        "page int, idx int, heading_context string, text string",
    )
    h = spark.createDataFrame([(1, 0, "Eligibility")], "page int, idx int, text string")
    got = {r.field_key: (r.raw_value, r.method) for r in U.labelled_claims(b, h, "page", U.CLAIM_LABELS).collect()}
    assert got == {"duration": ("2 years", "labeled_pattern"), "eligibility": ("Graduates", "heading_scoped")}
    assert U.credits_claim(b, "page").first().raw_value == "100 Credits"
    many = b.withColumn("text", F.concat(F.lit("Exam Fee: "), F.col("idx").cast("string")))
    assert U.labelled_claims(many.unionByName(many), h, "page", U.ITEM_LABELS, multiple=True).count() == 6


def test_sections_and_classes(spark):
    b = spark.createDataFrame([(1, 0, "Fees", "Total fee"), (1, 1, "Fees", "One sentence. Another sentence follows it here"), (1, 2, "Gone", "x")], "page int, idx int, heading_context string, text string")
    h = spark.createDataFrame([(1, 0, 2, "Fees"), (1, 3, 3, "Fees")], "page int, idx int, level int, text string")
    r = U.sections(b, h, "page").collect()
    assert len(r) == 1 and r[0].items == ["Total fee"] and len(r[0].paragraphs) == 1 and r[0].level == 2
    rows = [
        ("Programme Fees", [], [], "FEES", "HIGH"), ("Is it recognized by UGC?", [], [], "OTHER", "LOW"), ("Choose", [], ["Data Science", "Law", "Arts"], "SPECIALIZATION", "MEDIUM"),
        ("Career options", [], ["Data Analyst", "Lawyer"], "OTHER", "LOW"), ("Related articles", ["fee"], [], "OTHER", "LOW"), ("Hello", ["course duration"], [], "COURSE_DURATION", "MEDIUM"),
    ]
    df = spark.createDataFrame([(x[0], x[1], x[2], []) for x in rows], "h string, p array<string>, i array<string>, t array<string>")
    got = {r.h: (r.category, r.confidence) for r in U.classify_sections(df, "h", "p", "i", "t").collect()}
    assert got == {x[0]: (x[3], x[4]) for x in rows}


def test_degree_and_page_type(spark):
    df = spark.createDataFrame(
        [("Online Master of Business Administration", [], "https://x.org/a"), (None, [(0, 1, "About us")], "https://x.org/about"), (None, [], "https://x.org/bba-online"), ("Dual Degree BBA", [], "https://x.org")],
        "title string, headings array<struct<idx:int,level:int,text:string>>, url string",
    )
    df = df.withColumn("texts", U.search_texts(df)).withColumn("d", U.degree_match(F.col("texts")))
    got = [(r.d.degree if r.d else None, r.d.confidence if r.d else None, r.t) for r in df.select("d", U.page_type(F.col("texts"), F.col("d")).alias("t")).collect()]
    assert got == [("MBA", "high", "pg"), (None, None, "institution_page"), ("BBA", "low", "other"), ("BBA", "high", "combined_course")]
    name = lambda t: spark.range(1).select(U.footer_name(F.lit(t))).first()[0]
    assert name("© 2024 Uni X. All rights reserved.") == "Uni X" and name("© 2024") is None and name(None) is None
    inst = spark.range(1).select(U.institution_match(F.lit("MBA | Uni X University"), F.lit("uni x university"), F.lit(None).cast("string"), F.lit("Other"))["confidence"]).first()[0]
    assert inst == "high"


def test_spelling(spark):
    df = spark.createDataFrame([(1, "The <b>Univercity</b> offers MBA and univercity's fees fees")], "k int, t string")
    known = spark.createDataFrame([("the",), ("offers",), ("and",), ("fees",)], "word string")
    got = {r.word: (r.n, r.surface) for r in U.spell_check(df, "k", "t", known, ["univercity's"]).collect()}
    assert got == {"univercity": (1, "Univercity")}


def test_logo_precedence(spark):
    rows = [
        ([(0, "h1", None, False), (1, "h2", "Logo", True)], ['{"logo":"j"}'], {"og:image": "o"}), ([(0, "h1", None, False)], [], {}), ([], ['{"a":1}', '{"logo":{"url":"j"}}'], {"og:image": "o"}),
        ([], [], {"og:image": "o"}), ([], [], {}),
    ]
    df = spark.createDataFrame(rows, "logos array<struct<idx:int,url:string,alt:string,hinted:boolean>>, json_ld array<string>, open_graph map<string,string>")
    got = [(r.x.url, r.x.method) for r in df.select(U.detect_logo().alias("x")).collect()]
    assert got == [("h2", "header_logo_selector"), ("h1", "header_logo_selector"), ("j", "structured_data_logo"), ("o", "og_image_fallback"), (None, "not_found")]


def test_understanding_fallbacks(spark):
    df = spark.createDataFrame([("MBA and BBA | X", [(0, 1, "Deep Learning Systems")], "https://x.org")], "title string, headings array<struct<idx:int,level:int,text:string>>, url string")
    texts = U.search_texts(df)
    r = df.select(U.subject_only_program(texts, ["deep"]).alias("p"), U.other_degrees(texts, F.lit("MBA")).alias("o")).first()
    assert r.p == "Deep Learning Systems" and r.o == ["BBA"]
    said = spark.createDataFrame([("50% off today only",), ("Minimum 50% marks required",), ("Graduates may apply here",), ("read more about eligibility",), ("two words",)], "t string")
    assert [x[0] for x in said.select(U.eligibility_sentence("t")).collect()] == [False, True, True, False, False]
    cells = spark.createDataFrame([(["Fee", " ", "₹5", "now"],), (["x"],), ([],)], "c array<string>")
    assert [x[0] for x in cells.select(U.table_row_fact("c")).collect()] == ["Fee: ₹5 now", "x", None]


def test_overrides_and_fallback(spark):
    targets = spark.createDataFrame([(0, "a"), (1, "b")], "target_idx int, url string")
    resolved = spark.createDataFrame([(0, "m0", "medium", "success"), (1, None, None, "ambiguous_candidates")], "target_idx int, master_url string, confidence string, outcome string")
    o = spark.createDataFrame([("b", "fixed")], "url string, master_url string")
    got = {r.target_idx: (r.master_url, r.method, r.outcome) for r in R.with_overrides(targets, resolved, o).collect()}
    assert got == {0: ("m0", "discovery", "success"), 1: ("fixed", "override", "success")}
    t = spark.createDataFrame([(0, ["finance"]), (1, ["law"]), (2, ["data"])], "target_idx int, subject array<string>")
    e = spark.createDataFrame([(1, "u1", 0, "Corporate Finance"), (1, "u1", 1, "Data Law"), (2, "u2", 0, "Data Science")], "page_id int, url string, idx int, entry string")
    got = {r.target_idx: (r.selected, r.failure_reason) for r in R.specialization_fallback(t, e).collect()}
    assert got == {0: ("u1", None), 1: ("u1", None), 2: (None, "ambiguous_candidates")}
    ev = spark.createDataFrame([(0, True, True, 80), (0, True, False, None), (0, False, True, None)], "t int, identity_ok boolean, program_ok boolean, score int")
    s = R.match_stats(ev, "t").first()
    assert (s.candidates, s.identity_ok, s.eligible, s.best) == (3, 2, 1, 80)


def test_token_pairs_and_first_free_against_brute_force(spark):
    """Sets of common and rare tokens in two groups; then each item, in order, takes the first free one."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    pick = lambda: sorted({words[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randint(0, 9))})
    a, b = ([(g, i, pick()) for g in (1, 2) for i in range(40)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "k int, idx int, toks array<string>")
    for num, den in ((1, 2), (3, 5)):
        pairs = C.token_pairs(frame(a), frame(b), ["k"], num, den)
        want = {(g, i, j) for g, i, x in a for h, j, y in b if g == h and x and y and den * len(set(x) & set(y)) >= num * min(len(x), len(y))}
        assert sorted(tuple(r) for r in pairs.select("k", "a_idx", "b_idx").collect()) == sorted(want)
    taken = set()
    for g in (1, 2):
        free = set(range(40))
        for i in range(40):
            j = min((j for h, x, j in want if (h, x) == (g, i) and j in free), default=None)
            if j is not None:
                free.remove(j)
                taken.add((g, i, j))
    edges = spark.createDataFrame(sorted(want), "k int, a_idx int, b_idx int")
    assert {tuple(r) for r in C.first_free(edges, ["k"]).select("k", "a_idx", "b_idx").collect()} == taken
    assert C.first_free(edges.where("k > 5"), ["k"]).count() == 0


def test_phrases_are_those_of_one_look_each(spark):
    phrases = ["fee", "course fee", "on-campus", "area of specialization", "qs world", "b2b"]
    texts = ["Course FEE, fees", "feed on-campus", "area  of specialization", "Area of Specialization/fee", "on campus QS world2", "xb2b b2b", "", None, "course-fee", "the fee\ncourse fee"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: sorted(r.p) for r in rows.select("i", T.phrases_in("t", phrases).alias("p")).collect()}
    one = rows.select("i", *[F.coalesce(T.word_bounded("t", w), F.lit(False)).alias(f"p{n}") for n, w in enumerate(phrases)])
    assert got == {r.i: sorted(w for n, w in enumerate(phrases) if r[f"p{n}"]) for r in one.collect()}


def test_positions_are_those_of_a_global_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("i"), F.when(F.col("id") % 3 > 0, F.col("id") % 17).alias("v")).repartition(7)
    got = W.with_positions(rows, [F.col("v").desc_nulls_first(), "i"]).collect()
    order = sorted(got, key=lambda r: (r.v is not None, -(r.v or 0), r.i))
    assert [r.position for r in order] == list(range(1, 5001))
    assert W.with_positions(rows.where("i < 0"), ["i"]).count() == 0


def test_robots_of_one_site_leave_others_alone(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x"), ("b", "User-agent: *\nDisallow: /\nAllow: /x/y")], "site string, body string")
    urls = spark.createDataFrame([(1, "a", "/x/y"), (2, "a", "/z"), (3, "b", "/x/y"), (4, "b", "/z"), (5, "c", "/x")], "i int, site string, p string")
    got = S.robots_allowed(urls, S.parse_robots(files, "site", "body"), ["i"], "p", "site").collect()
    assert {r.i: r.allowed for r in got} == {1: False, 2: True, 3: True, 4: False, 5: True}


def _some_pages(spark):
    """Pages of two institutions, some with equal ids, with addresses that name programs or nothing."""
    rng = random.Random(11)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        (rng.randint(0, 45), f"https://{pick('alpha', 'beta')}.org/{pick('mba', 'finance', 'x', '')}/{rng.randint(0, 9)}", pick("Finance at Alpha", "Law", None), pick(["MBA"], [], None, ["Law", "finance"]),
         pick("MBA", "mba ", "", None), pick("Finance", "Law", None), pick("Alpha", "Beta", None), pick("Beta", None), pick("pg", "ug", None))
        for _ in range(60)
    ]
    return spark.createDataFrame(rows, "page_id long, url string, title string, headings array<string>, degree string, program string, institution string, brand string, page_type string")


def test_scores_of_classes_are_those_of_all_pairs(spark):
    p = _some_pages(spark)
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c}") for c in p.columns])
    pairs = R.score(side("t").join(side("c"), F.col("t_institution") == F.col("c_institution")).where("t_page_id <> c_page_id")).select("t_page_id", "c_page_id", "score").cache()
    pages, scores = R.class_scores(p)
    of = lambda s: pages.select(F.col("page_id").alias(f"{s}_page_id"), f"{s}_class")
    got = R.all_of_classes(of("t"), of("c"), scores).where("t_page_id <> c_page_id").select("t_page_id", "c_page_id", "score")
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, got.collect())) == want and len({w[2] for w in want}) > 5
    chosen = lambda df: sorted(map(str, R.select_page(df, "t_page_id", "c_page_id", "c_page_id").collect()))
    assert chosen(R.best_of_classes(pages, scores, 2)) == chosen(pairs)
    first = lambda df: sorted((r.t_page_id, r.score, r.c_page_id, r["rank"]) for r in W.top_k(df, ["t_page_id"], [F.desc("score"), "c_page_id"]).collect())
    assert first(R.best_of_classes(pages, scores, 5)) == first(pairs)
