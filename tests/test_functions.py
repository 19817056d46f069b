"""Column functions, one row per case in a single batch per function."""

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.functions import text as T
from factweave.functions import urls as U
from factweave.functions import values as V


def column(spark, values, make, schema="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(make).collect()]


def check(spark, cases, make, schema="v string"):
    got = column(spark, [c[0] for c in cases], make, schema)
    assert got == [c[1] for c in cases]


def test_durations(spark):
    cases = [
        ("2 years", ("NORMALIZED", 24.0)), ("18-month course", ("NORMALIZED", 18.0)), ("4 Semesters", ("NORMALIZED", 24.0)), ("1.5 years", ("NORMALIZED", 18.0)),
        ("2 years / 24 months", ("NORMALIZED", 24.0)), ("2 years or 3 years", ("AMBIGUOUS", None)), ("6 weeks", ("UNSUPPORTED_FORMAT", None)),
        ("2 years, 300 hours", ("AMBIGUOUS", None)), ("flexible", ("NOT_FOUND", None)), ("", ("NOT_FOUND", None)), ("2 years", ("NORMALIZED", 24.0)),
    ]
    check(spark, cases, V.normalize_duration("v"))


def test_refined_durations(spark):
    cases = [("A two-year programme", "2 year"), ("lasts 1.50 years", "1.5 years"), ("twelve months", "12 months"), ("no time", None), ("20 months", "20 months")]
    check(spark, cases, V.refine_duration("v"))


def test_currencies(spark):
    got = column(
        spark,
        ["₹1,20,000", "INR 50000", "Rs. 2,000 only", "$1,234.50", "€ 99", "£10", "₹1,200,000", "$1,20,000", "₹100 or ₹200", "₹100 and $5", "100", "fees", "₹ soon", "EUROPE 100", "₹1,000 / ₹1,000"],
        V.normalize_currency("v"),
    )
    said = [(r.status, None if r.amount is None else float(r.amount), r.currency) for r in got]
    ok = "NORMALIZED"
    assert said == [
        (ok, 120000.0, "INR"), (ok, 50000.0, "INR"), (ok, 2000.0, "INR"), (ok, 1234.5, "USD"), (ok, 99.0, "EUR"), (ok, 10.0, "GBP"),
        ("UNSUPPORTED_FORMAT", None, None), ("UNSUPPORTED_FORMAT", None, None), ("AMBIGUOUS", None, None), ("AMBIGUOUS", None, None),
        ("UNSUPPORTED_FORMAT", None, None), ("NOT_FOUND", None, None), ("NOT_FOUND", None, None), ("UNSUPPORTED_FORMAT", None, None), (ok, 1000.0, "INR"),
    ]


def test_lakh_and_crore(spark):
    cases = [("Fee 2.5 lakh", "Fee₹2,50,000"), ("₹1 crore and 3 lacs", "₹1,00,00,000 and₹3,00,000"), ("Rs. 1.25 Lakhs total", "Rs.1,25,000 total"), ("no words", "no words")]
    got = column(spark, [c[0] for c in cases], V.expand_lakh_crore("v"))
    assert [g.replace(" ", "") for g in got] == [c[1].replace(" ", "") for c in cases]


def test_split_amounts(spark):
    cases = [("₹100 then ₹200", ["₹100 then", "₹200"]), ("only ₹100", ["only ₹100"]), ("from $5 to €6 or £7", ["$5 to", "€6 or", "£7"]), ("none", ["none"])]
    check(spark, cases, V.split_amounts("v"))


def test_fee_classes(spark):
    cases = [
        ("Application Fee: ₹500", ("application", "unspecified", False)), ("Tuition per semester", ("tuition", "semester", False)), ("EMI at 5% off", ("tuition", "monthly", True)),
        ("Total program fee (discounted)", ("tuition", "total_program", True)), ("Caution deposit yearly", ("other_charges", "annual", False)),
    ]
    check(spark, cases, V.classify_fee("v"))


def test_eligibility(spark):
    got = column(spark, ["Bachelor's degree with 50% from a recognized university and 2+ years of work experience", "10+2 or diploma", "anyone"], V.eligibility_facts("v"))
    assert (got[0].groups, got[0].percentage, got[0].recognized, got[0].experience_years) == (["bachelor"], 50.0, True, 2.0)
    assert got[1].groups == ["higher_secondary", "diploma"] and got[2].groups == [] and got[2].percentage is None


def test_semantic_values(spark):
    cases = [
        ("  • Data Science ", "data science"), ("Finance & Banking (Optional)", "finance and banking"), ("Elective", "elective"), ("HR Specialization.", "hr specialization"),
        ("HR Specialization", "hr"), ("–– Marketing Track ", "marketing"), ("a  b;", "a b"), ("", ""),
    ]
    check(spark, cases, T.semantic_value("v"))


def test_concepts_and_overlap(spark):
    pairs = [("HRM", "Human Resources"), ("AI", "Artificial Intelligence"), ("Finance", "Marketing")]
    assert column(spark, pairs, T.concept_key("a") == T.concept_key("b"), "a string, b string") == [True, True, False]
    near = [("data science basics", "basics of data"), ("data", "datum"), ("", "data"), ("ab cd", "ab cd")]
    assert column(spark, near, T.tokens_overlap("a", "b"), "a string, b string") == [True, False, False, False]
    assert column(spark, [("managing finances", "management of finance")], T.stems_overlap("a", "b"), "a string, b string") == [True]


def test_prefixes_and_abbreviations(spark):
    assert column(spark, [("MBA Finance", "mba"), ("MBAFinance", "MBA"), ("Finance", None), ("x.y z", "x.y")], T.strip_prefix("a", "b"), "a string, b string") == ["Finance", "MBAFinance", "Finance", "z"]
    check(spark, [("MSc DS", "MSc DS Data Science"), ("hr hrm", "hr hrm Human Resource Management Human Resource Management"), ("plain", "plain")], T.expand_abbreviations("v"))


def test_predicates(spark):
    check(spark, [("Enter the OTP", True), ("Please wait…", True), ("Optional subjects", False), ("Read  more", True), ("readmore", True)], T.is_chrome("v"))
    check(spark, [("₹1,20,000 per annum", True), ("2 years", True), ("Two years", False), ("INR 5", True), ("  ", False)], T.value_shaped("v"))
    check(spark, [("Course Fee", True), ("Fee 2024", False), ("a b c d e f g", False)], T.short_label("v"))
    check(spark, [("Data Science", True), ("data", False), ("Cost: 5", False), ("A B C D E F G", False)], T.named_offering("v"))
    check(spark, [("not included", True), ("notable", False), ("without fees", True)], T.has_negation("v"))
    assert column(spark, [("2 of 3", "3 or 2"), ("2", "3"), ("2", "none")], T.numbers_differ("a", "b"), "a string, b string") == [False, True, False]


def test_display(spark):
    check(spark, [("a" * 100, "a" * 100), ("b" * 101, "b" * 99 + "…"), (" c ", "c")], T.truncate_value("v"))
    names = [(["a"],), (["a", "b", "c"],), (["a", "b", "c", "d", "e"],), ([],)]
    assert column(spark, names, T.summarize_names("v"), "v array<string>") == ["a", "a, b, c", "a, b, c, and 2 more", ""]
    assert column(spark, names, T.join_clauses("v"), "v array<string>") == ["a", "a b c", "a b c (+2 more differences.)", ""]
    assert column(spark, [("Full Fee", "₹5"), ("Full Fee", "full course fee ₹5"), ("Fee (After Discount)", "discount fee")], T.labelled("a", "b"), "a string, b string") == ["Full Fee: ₹5", "full course fee ₹5", "discount fee"]
    check(spark, [("&amp;lt;a&gt; &quot;", '<a> "')], T.decode_xml("v"))
    check(spark, [("https://x.org/a/Logo-NAAC_2.png?x", ["logo", "naac", "2"])], T.filename_tokens("v"))


def test_urls(spark):
    cases = [
        ("HTTPS://www.Example.com:443/a/b/?q=1#f", "www.example.com/a/b?q=1"), ("http://x.org/", "x.org"), ("http://u:p@x.org//", "x.org"), ("Not A Url/", "not a url"), ("http://x.org?", "x.org"),
    ]
    check(spark, cases, U.url_key("v"))
    inside = [("http://a.b.com/", "b.com"), ("http://ab.com/", "b.com"), ("http://b.com", "B.com"), ("junk", "b.com")]
    assert column(spark, inside, U.within_domain("a", "b"), "a string, b string") == [True, False, True, False]


def test_addresses(spark):
    ips = ["10.0.0.1", "8.8.8.8", "172.31.255.255", "172.32.0.0", "256.1.1.1", "1.2.3", "192.168.1.1", "100.64.0.1", "", "01.2.3.4", "::1", "2001:4860:4860::8888", "fe80::1", "::ffff:10.0.0.1"]
    want = [True, False, True, False, True, True, True, True, True, True, True, False, True, True]
    v4 = column(spark, ips, U.blocked_v4("v"))
    assert v4[:10] == want[:10]
    assert column(spark, ips, U.blocked_any("v")) == want


def test_addresses_of_either_family(spark):
    """Against the standard library, whole ranges' ends and texts that are no addresses included."""
    nets = [ipaddress.ip_network(n) for n in [*U.RESERVED_V4, *U.RESERVED_V6]]
    ends = [(n, x) for n in nets for x in (int(n.network_address), int(n.broadcast_address), int(n.network_address) - 1, int(n.broadcast_address) + 1)]
    ips = [str(type(n.network_address)(x)) for n, x in ends if 0 <= x < 1 << n.max_prefixlen]
    ips += [ipaddress.ip_address(x).exploded for x in ips if ":" in x] + [f"::ffff:{x}" for x in ips if ":" not in x]
    ips += ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "FE80::A", "fe80::1%eth0", "64:ff9b::8.8.8.8", "::ffff:a00:1", "::ffff:808:808", "2001:DB8::5", "2606:4700::1111"]
    ips += ["1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "g::1", "12345::", "::1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7:8::", "::1.2.3.4:5", "x", "", " ::1", "1.2.3.4:80"]

    def blocked(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return True
        both = [ip, getattr(ip, "ipv4_mapped", None)]
        return any(x is not None and x.version == n.version and x in n for n in nets for x in both)

    assert dict(zip(ips, column(spark, ips, U.blocked_any("v")), strict=True)) == {x: blocked(x) for x in ips}


@settings(max_examples=25, deadline=None)
@given(a=st.integers(0, 2**256 - 1), b=st.integers(0, 2**256 - 1))
def test_hash_similarity(spark, a, b):
    got = column(spark, [(f"{a:064x}", f"{b:064x}")], U.hash_similarity("x", "y"), "x string, y string")[0]
    assert got == pytest.approx(1 - (a ^ b).bit_count() / 256)


def test_hash_similarity_edges(spark):
    pairs = [("ff", "ff"), ("ff", "f"), ("zz", "zz"), ("", "")]
    assert column(spark, pairs, U.hash_similarity("x", "y"), "x string, y string") == [1.0, 0.0, 0.0, 0.0]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**9))
def test_indian_grouping_round_trip(spark, n):
    text = column(spark, [(n,)], V.indian_grouping("v"), "v long")[0]
    assert int(text.replace(",", "")) == n
    back = column(spark, [f"₹{text}"], V.normalize_currency("v"))[0]
    assert back.status == "NORMALIZED" and back.amount == n


def test_typed_claims(spark):
    rows = [("duration", "2 years"), ("fees", "₹5"), ("mode", " Online  ONLY "), ("mode", " ")]
    got = column(spark, rows, V.normalize_claim("k", "v"), "k string, v string")
    assert [(r.status, r.type) for r in got] == [("NORMALIZED", "duration_months"), ("NORMALIZED", "currency"), ("NORMALIZED", "text"), ("NOT_FOUND", "text")]
    assert (got[0].norm_months, float(got[1].norm_amount), got[2].norm_text) == (24.0, 5.0, "online only")
