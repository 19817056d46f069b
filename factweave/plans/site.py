"""A recorded crawl made from the ids of ``pages``: one target and its authoritative page for each
id, with differences that follow from the id alone, so an oracle can tell every result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN = "northfield.edu"
HOME = f"https://www.{DOMAIN}/"
TARGETS = "https://partner.org/"
DEGREES = ["MBA", "MCA", "BBA"]

#: What the oracles need to know of an id ``p``, as SQL: the same rules as below, in words.
RULES = """
r as (select page_id as p, page_id % 11 = 10 as gone, page_id % 13 = 12 as unlisted, page_id % 17 = 16 as doubled,
             page_id % 4 as d, page_id % 5 as c, page_id % 3 as e, page_id % 7 as f, page_id % 2 as s, page_id % 9 as a,
             page_id % 8 as x, page_id % 6 as u, page_id % 10 as n, page_id % 12 as k, page_id % 16 as g from pages)
"""


def _by(p: Column, n: int, texts: list[str | None]) -> Column:
    """The text of ``p`` modulo ``n``; the last one stands for all further remainders."""
    out = F.lit(texts[-1])
    for i, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(p % n == i, F.lit(t)).otherwise(out)
    return out


def _page(title: Column, heading: Column, *parts: Column | str) -> Column:
    body = [F.coalesce(F.lit(x) if isinstance(x, str) else x, F.lit("")) for x in parts]
    return F.concat(
        F.lit("<html><head><title>"), title, F.lit("</title><meta property='og:site_name' content='Northfield'></head><body><nav><a href='/'>Home</a></nav><main><h1>"),
        heading, F.lit("</h1>"), *body, F.lit("</main><footer>© 2024 Northfield University.</footer></body></html>"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): targets have odd ids, their authoritative pages even ones, and the
    second of two equal ones a negative id."""
    p = F.col("page_id")
    subject = F.concat(F.element_at(F.array(*[F.lit(x) for x in DEGREES]), (p % 3 + 1).cast("int")), F.lit(" in Subject"), p.cast("string"))
    plan = "<h2>Specializations</h2><ul><li>Corporate Finance</li><li>Risk Analytics</li>"
    # a fee that is a picture, or one with a discount of its own; what follows the Fees heading
    m_fees = [F.when(p % 16 == 13, F.lit("")).otherwise(F.lit("<p>Total program fee ₹1,20,000</p>")), F.when((p % 16 != 13) & (p % 8 != 0), _by(p, 8, [None, *["<p>Total program fee after discount ₹1,00,000</p>"] * 3, "<p>Total program fee after 20% discount ₹1,00,000</p>", "<p>Total program fee after discount ₹1,00,000</p>"]))]
    t_cut = F.when((p % 7 != 1) & (p % 16 != 13), _by(p, 8, [None, None, "<p>Total program fee after discount ₹1,00,000</p>", "<p>Total program fee after discount ₹90,000</p>", "<p>Flat 20% discount for early birds</p>", "<p>Total program fee after discount ₹1,00,000</p>"]))
    lines = lambda head, *xs: f"<h2>{head}</h2><ul>{''.join(f'<li>{x}</li>' for x in xs)}</ul>"
    taught = ("Semester 1", "Financial Accounting", "Business Law", "Marketing Basics")
    menu = ("Corporate Finance", "Risk Analytics")  # two specializations in a row open a menu, which is left out
    m_lists = [
        _by(p, 6, [*[lines("Curriculum and Syllabus", *taught, *menu, "Quantum Studies", "Core Subjects")] * 4, None]),
        _by(p, 10, [*[lines("Accreditations", "NAAC A+", "UGC entitled")] * 3, None, None, lines("Accreditations", "NAAC A+", "UGC entitled")]),
        _by(p, 12, [*[lines("Rankings", "NIRF Rank 25", "QS World Ranking 500")] * 3, None, None, lines("Rankings", "NIRF Rank 25", "QS World Ranking 500")]),
    ]
    t_lists = [
        _by(p, 6, [None, lines("Curriculum and Syllabus", "Semester 1", "Financial Accounting", "Business Law"), lines("Curriculum and Syllabus", *taught, *menu, "Harmless Menus"), lines("Curriculum and Syllabus", "Law of Business", "Accounts and Financing", "Basics of Marketing"), lines("Curriculum and Syllabus", *taught), None]),
        _by(p, 10, [None, lines("Accreditations", "UGC entitled"), lines("Accreditations", "AICTE approved"), lines("Accreditations", "NAAC A+"), None, lines("Accreditations", "UGC entitled", "NAAC A+")]),
        _by(p, 12, [None, lines("Rankings", "NIRF Rank 25"), lines("Rankings", "Top 10 Universities"), lines("Rankings", "NIRF Rank 25"), None, lines("Rankings", "QS World Ranking 500", "NIRF Rank 25")]),
    ]
    target = _page(
        F.concat(F.lit("Online "), subject), F.concat(F.lit("Online "), subject),
        _by(p, 4, ["<p>Duration: 24 months</p>", "<p>Duration: 2 years</p>", "<p>Duration: 3 years</p>", None]),
        _by(p, 5, ["<p>Earn 80 credits</p>", None, "<p>Earn 90 credits</p>"]),
        "<h2>Eligibility</h2>", _by(p, 3, ["<p>Graduation with 60% marks</p>", "<p>Graduation with 50% marks</p>"]),
        F.when(p % 16 == 13, F.concat(F.lit("<h2>Fees</h2><img src='/img/fees"), p.cast("string"), F.lit(".png' alt=''>")))
        .otherwise(_by(p, 7, ["<h2>Fees</h2><p>Total program fee ₹1,30,000</p>", None, "<h2>Fees</h2><p>Total program fee ₹1.2 lakh</p>"])), t_cut,
        *t_lists, plan, _by(p, 2, ["<li>Market Law</li>", None]), "</ul>",
        _by(p, 9, ["<p>Placement Support: no placement support</p>", "<p>Placement Support: career services for all</p>"]),
    )
    master = _page(
        F.concat(subject, F.lit(" | Northfield University")), F.concat(F.lit("Online "), subject),
        "<p>Duration: 2 years</p><p>Earn 90 credits</p><h2>Eligibility</h2><p>Graduation with 50% marks</p>",
        "<h2>Fees</h2>", *m_fees, *m_lists, plan, "<li>Market Law</li></ul>", "<p>Placement Support: career services for all</p>",
    )
    one = lambda i, url, html: F.struct(i.cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    at = lambda start, tail: F.concat(F.lit(start), F.lit("p"), p.cast("string"), F.lit(tail))
    rows = F.array_compact(F.array(
        F.when(p % 11 != 10, one(p * 2 + 1, at(TARGETS, ""), target)),
        F.when(p % 13 != 12, one(p * 2, at(HOME, ""), master)),
        F.when((p % 13 != 12) & (p % 17 == 16), one(-p - 1, at(HOME, "/again"), master)),
    ))
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def known_fees(pages: DataFrame) -> DataFrame:
    """(page_id, component, amount, currency, raw_value) of some authoritative pages, for sure."""
    return pages.where("page_id % 16 = 15").select(
        (F.col("page_id") * 2).alias("page_id"), F.lit("Full Fee").alias("component"), F.lit(130000.0).alias("amount"), F.lit("INR").alias("currency"), F.lit("₹1,30,000").alias("raw_value")
    )


def readings(pages: DataFrame) -> DataFrame:
    """(url, text, confidence): what pictures of fees say, where anything was read at all."""
    return pages.where("page_id % 16 = 13 and page_id % 32 = 13").select(
        F.concat(F.lit("https://partner.org/img/fees"), F.col("page_id").cast("string"), F.lit(".png")).alias("url"), F.lit("Fee on request").alias("text"), F.lit("LOW").alias("confidence")
    )


def targets(pages: DataFrame) -> DataFrame:
    """(target_idx, url) of every id."""
    return pages.select(F.col("page_id").alias("target_idx"), F.concat(F.lit(TARGETS + "p"), F.col("page_id").cast("string")).alias("url"))


#: What the oracle of a large crawl needs to know of an id ``p``: see ``large_crawl``.
LARGE_RULES = """
r as (select page_id as p, page_id % 11 = 10 as gone, page_id % 17 = 16 as sent_home, page_id % 19 = 18 as fixed, page_id % 31 = 30 as torn, page_id % 29 = 28 as registered,
             page_id % 23 = 22 as hub, page_id % 13 <> 12 and page_id % 23 <> 22 as listed, page_id % 7 in (3, 4) as late, page_id % 7 = 4 as wrong from pages)
"""
MORE = 20


def large_crawl(pages: DataFrame) -> dict[str, DataFrame]:
    """A site of more pages than its crawl's budget takes: ``store(page_id, url, final_url, html)``, ``candidates``,
    ``overrides`` and the tables of a registry.

    For an id ``p``: a target (8p), which is gone, leads to the home page or has the logo of another
    institution for some ids; its right page (8p + 1), beyond the budget if late; a page of its
    subject and another degree (8p + 2), within it; a page it is fixed to (8p + 3); one whose list
    names its subject (8p + 4); one that the registry names (8p + 5)."""
    p = F.col("page_id")
    degree = lambda n: F.element_at(F.array(*[F.lit(x) for x in DEGREES]), (n % 3 + 1).cast("int"))
    word = F.concat(F.lit("Subject"), F.translate(p.cast("string"), "0123456789", "abcdefghij"))  # names of offerings have no digits
    subject = lambda d: F.concat(d, F.lit(" in "), word)
    at = lambda start: F.concat(F.lit(start), p.cast("string"))
    page = lambda d: _page(F.concat(subject(d), F.lit(" | Northfield University")), F.concat(F.lit("Online "), subject(d)), "<p>Duration: 2 years</p>")
    own = _page(F.concat(F.lit("Online "), subject(degree(p))), F.concat(F.lit("Online "), subject(degree(p))), "<p>Duration: 2 years</p>")
    torn = F.replace(own, F.lit("<nav>"), F.lit("<nav><img class='logo' src='https://cdn.org/southfield.png' alt=''>"))
    hub = _page(F.lit("Northfield Offerings"), F.lit("Northfield Offerings"), "<h2>Specializations</h2><ul><li>", word, " Analytics</li><li>Corporate Finance</li></ul>")
    listed, late = (p % 13 != 12) & (p % 23 != 22), (p % 7).isin(3, 4)
    home = F.lit(HOME)
    parts = [
        (0, p % 11 != 10, at(TARGETS + "p"), F.when(p % 17 == 16, home).otherwise(at(TARGETS + "p")), F.when(p % 31 == 30, torn).otherwise(own)),
        (1, listed, F.concat(F.lit(HOME + "courses/"), F.lower(word)), None, page(degree(p))),
        (2, p % 7 == 4, F.concat(F.lit(HOME + "short/"), F.lower(word)), None, page(degree(p + 1))),
        (3, p % 19 == 18, at(HOME + "fixed/p"), None, page(degree(p))),
        (4, p % 23 == 22, at(HOME + "hub/h"), None, hub),
        (5, p % 29 == 28, at(HOME + "registered/p"), None, page(degree(p))),
    ]
    rows = F.array_compact(F.array(*[
        F.when(ok, F.struct((p * 8 + i).cast("long").alias("page_id"), url.alias("url"), F.coalesce(url if final is None else final, url).alias("final_url"), html.alias("html")))
        for i, ok, url, final, html in parts
    ]))
    spark = pages.sparkSession
    front = spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), home.alias("url"), home.alias("final_url"), _page(F.lit("Northfield University"), F.lit("Northfield University")).alias("html"))
    found = [F.when(listed, F.struct(parts[1][2].alias("url"), F.lit("sitemap").alias("method"), (F.when(late, 1 << 40).otherwise(0) + p).cast("long").alias("idx")))]
    found += [F.when(parts[i][1], F.struct(parts[i][2].alias("url"), F.lit("navigation").alias("method"), p.cast("long").alias("idx"))) for i in (2, 4)]
    start = spark.range(1).select(home.alias("url"), F.lit("homepage").alias("method"), F.lit(0).cast("long").alias("idx"))
    registered = pages.where(p % 29 == 28).select(F.when(p % 2 == 0, "s1").otherwise("s2").alias("source_id"), parts[5][2].alias("url"), F.concat(F.lit("Online "), subject(degree(p))).alias("program"))
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "store": pages.select(F.explode(rows).alias("r")).select("r.*").unionByName(front),
        "candidates": pages.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.*").unionByName(start),
        "overrides": pages.where(parts[3][1]).select(parts[0][2].alias("url"), parts[3][2].alias("master_url")),
        "names": table([("northfield", "Northfield"), ("southfield", "Southfield")], "institution_id string, name string"),
        "sources": table([("s1", "northfield", "one.example"), ("s2", "northfield", "two.example")], "source_id string, institution_id string, host string"),
        "aliases": table([("Northfield", "northfield")], "alias string, institution_id string"),
        "programs": registered.select(F.col("program").alias("alias"), "source_id"),
        "pages": registered,
        "svg": table([], "url string, text string"),
    }
