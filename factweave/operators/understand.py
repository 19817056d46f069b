"""What a parsed page says: degree, institution, page type, claims, sections, spelling.

Dictionaries are small tables or literals; every choice of "the first" goes by ordinals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions.patterns import literal, p

# fixed values: degrees with their aliases and levels
DEGREES = [
    ("mba", "MBA", ["Master of Business Administration", "MBA"], "pg"),
    ("mca", "MCA", ["Master of Computer Applications", "MCA"], "pg"),
    ("bba", "BBA", ["Bachelor of Business Administration", "BBA"], "ug"),
    ("bca", "BCA", ["Bachelor of Computer Applications", "BCA"], "ug"),
    ("bcom", "B.Com", ["Bachelor of Commerce", "B.Com", "BCom"], "ug"),
    ("mcom", "M.Com", ["Master of Commerce", "M.Com", "MCom"], "pg"),
    ("ma_jmc", "MA JMC", ["Master of Arts in Journalism and Mass Communication", "MA in Journalism and Mass Communication", "MA JMC"], "pg"),
    ("btech", "B.Tech", ["Bachelor of Technology", "B.Tech", "BTech"], "ug"),
    ("mtech", "M.Tech", ["Master of Technology", "M.Tech", "MTech"], "pg"),
    ("bsc", "B.Sc", ["Bachelor of Science", "B.Sc", "BSc"], "ug"),
    ("msc", "M.Sc", ["Master of Science", "M.Sc", "MSc"], "pg"),
    ("ba", "BA", ["Bachelor of Arts", "BA"], "ug"),
    ("ma", "MA", ["Master of Arts", "MA"], "pg"),
    ("phd", "PhD", ["Doctor of Philosophy", "Ph.D", "PhD"], "pg"),
    ("diploma", "Diploma", ["Diploma"], "other"),
    ("pgcp", "PGCP", ["Post Graduate Certificate Programme", "Post Graduate Certificate Program", "PGCP"], "pg"),
    ("pgdp", "PGDP", ["Post Graduate Diploma Programme", "Post Graduate Diploma Program", "PGDP"], "pg"),
]
# fixed values: words of page types and of institutions
PAGE_TYPES = {
    "combined_course": ["combined course", "integrated program", "integrated course", "dual degree"],
    "institution_page": ["about us", "overview", "who we are", "about the university", "about the institute"],
    "ug": ["undergraduate", "bachelor", "ug"],
    "pg": ["postgraduate", "post graduate", "master", "pg"],
}
INSTITUTION_WORDS = ["University", "Institute", "Institute of Technology", "College", "Academy", "Vidyapeeth", "Vishwavidyalaya"]
# fixed values: labels of claims
CLAIM_LABELS = {
    "duration": ["Duration", "Course Duration", "Program Duration"],
    "eligibility": ["Eligibility", "Eligibility Criteria", "Who Can Apply"],
    "fees": ["Fees", "Program Fee", "Course Fee", "Total Fees", "Fee Structure"],
    "mode": ["Mode", "Delivery Mode", "Mode of Learning"],
    "accreditation": ["Accreditation", "Approved By", "Approvals"],
}
ITEM_LABELS = {
    "feeCandidate": [
        "Semester Fee", "Fee per Semester", "Per Semester Fee", "Program Fee", "Course Fee", "Total Fee", "Total Fees", "Total Program Fee", "Fee Structure",
        "Fees", "Application Fee", "Admission Fee", "Registration Fee", "Examination Fee", "Exam Fee", "Annual Fee", "Tuition Fee",
    ],
    "accreditationItem": ["Accreditation", "Accreditations", "Approvals", "Approved By", "Accredited By", "Recognition"],
    "rankingItem": ["Rankings", "Ranking", "Awards", "Awards & Rankings", "Ranked"],
}
OTHER_LABELS = {
    "placementSupport": ["Placement", "Placement Support", "Career Support", "Career Services", "Placement Assistance"],
    "internship": ["Internship", "Internships", "Internship Opportunities", "Internship Program"],
    "capstoneProject": ["Project", "Projects", "Capstone Project", "Live Project", "Live Projects"],
    "industryExposure": ["Industry Exposure", "Industry Interaction", "Industry Visit", "Industry Partners", "Industry Partnership", "Guest Lecture", "Guest Lectures"],
    "examinationMode": ["Examination Mode", "Exam Mode", "Mode of Examination", "Assessment Mode"],
    "certifications": ["Certification", "Certifications", "Certificate"],
    "studyMaterial": ["Study Material", "Study Materials", "Learning Material", "Course Material"],
}
LONGEST_CLAIM = 300


def search_texts(page: DataFrame) -> Column:
    """Title, headings in order, words of the url."""
    one = lambda text, where: F.struct(text.alias("text"), F.lit(where).alias("location"))
    title = F.filter(F.array(one(F.col("title"), "title")), lambda t: t["text"].isNotNull())
    heads = F.transform(F.coalesce("headings", F.array().cast("array<struct<idx:int,level:int,text:string>>")), lambda h: one(h["text"], "heading"))
    words = F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ")
    return F.concat(title, heads, F.array(one(words, "url")))


def degree_match(texts: Column) -> Column:
    """``struct(degree, level, alias, location, confidence)`` of the first text that names a
    degree; within a text longer aliases come first."""
    aliases = sorted(((a, name, level) for _, name, names, level in DEGREES for a in names), key=lambda x: -len(x[0]))
    found = None
    for alias, name, level in reversed(aliases):
        found = _or_else(alias, F.struct(F.lit(name).alias("degree"), F.lit(level).alias("level"), F.lit(alias).alias("alias")), found)
    matches = F.transform(texts, lambda t: F.struct(found(t["text"]).alias("m"), t["location"].alias("location")))

    def choose(x: Column) -> Column:
        every = F.filter(x["all"], lambda y: y["m"].isNotNull())
        title = F.get(F.filter(every, lambda y: y["location"] == "title"), F.lit(0))
        head = F.get(F.filter(x["all"], lambda y: y["location"] == "heading"), F.lit(0))  # the page's first heading alone
        first = F.when(title["m"].isNotNull() & head["m"].isNotNull() & (title["m"]["degree"] != head["m"]["degree"]), head).otherwise(F.get(every, F.lit(0)))
        return T.let(_said, first=first)

    return T.let(choose, all=matches)


def _said(x: Column) -> Column:
    first = x["first"]
    confidence = F.when(first["location"] == "title", "high").when(first["location"] == "heading", "medium").otherwise("low")
    return F.when(first.isNotNull(), F.struct(first["m"]["degree"].alias("degree"), first["m"]["level"].alias("level"), first["m"]["alias"].alias("alias"), first["location"].alias("location"), confidence.alias("confidence")))


def program_text(title, headings, degree, stopwords: list[str], window: int = 2) -> Column:
    """What a page calls its program: of the headings that name its degree, the first or, up to
    ``window`` headings after it, the one with most words that are neither the degree's nor
    ``stopwords`` (the first of equals); else the title's first segment if longer than the degree's
    name; else that name."""
    degree = T._c(degree)
    named = F.array(*[F.lit(n) for _, n, _, _ in DEGREES])
    own = F.create_map(*[x for _, n, names, _ in DEGREES for x in (F.lit(n), F.array(*[F.lit(t) for t in sorted({t for a in [n, *names] for t in re.findall("[a-z0-9]{3,}", a.lower())})] or [F.lit("")]))])

    def names_it(text: Column) -> Column:
        hits = F.array(*[T.any_of(text, [rf"(?<![a-z0-9]){literal(a)}(?![a-z0-9])" for a in names]) for _, _, names, _ in DEGREES])
        return F.coalesce(F.get(hits, F.array_position(named, degree).cast("int") - 1), F.lit(False))

    def special(text: Column) -> Column:
        words = F.filter(T.tokens(text), lambda w: ~w.isin(stopwords))
        return F.size(F.filter(words, lambda w: ~F.coalesce(F.array_contains(F.try_element_at(own, degree), w), F.lit(False))))

    heads = F.transform(T._c(headings), lambda h, i: F.struct(i.alias("i"), h["text"].alias("text"), names_it(h["text"]).alias("ok")))

    def best(x: Column) -> Column:
        near = F.filter(x["fit"], lambda h: h["i"] - F.get(x["fit"], F.lit(0))["i"] <= window)
        ranked = F.array_sort(F.transform(near, lambda h: F.struct((-special(h["text"])).alias("o"), h["i"].alias("i"), h["text"].alias("text"))))
        return F.trim(F.get(ranked, F.lit(0))["text"])

    segment = F.trim(F.get(F.split(T._c(title), r"[|\-–—:]"), F.lit(0)))
    return F.coalesce(T.let(best, fit=F.filter(heads, lambda h: h["ok"])), F.when(F.length(segment) > F.length(degree), segment), degree)


def _or_else(alias: str, value: Column, rest):
    def test(text: Column) -> Column:
        hit = F.when(T.word_bounded(text, alias), value)
        return hit if rest is None else hit.otherwise(rest(text))

    return test


def page_type(texts: Column, degree: Column) -> Column:
    """The first rule that applies: combined course, level of a sure degree, institution page
    (never by url), undergraduate, postgraduate, other."""
    any_in = lambda words, arr: F.exists(arr, lambda t: T.any_of(t["text"], [rf"(?<![a-z0-9]){literal(w)}(?![a-z0-9])" for w in words]))
    offline = F.filter(texts, lambda t: t["location"] != "url")
    sure = degree["level"].isin("ug", "pg") & (degree["confidence"] != "low")
    return (
        F.when(any_in(PAGE_TYPES["combined_course"], texts), "combined_course")
        .when(F.coalesce(sure, F.lit(False)), degree["level"])
        .when(any_in(PAGE_TYPES["institution_page"], offline), "institution_page")
        .when(any_in(PAGE_TYPES["ug"], texts), "ug")
        .when(any_in(PAGE_TYPES["pg"], texts), "pg")
        .otherwise("other")
    )


def institution_match(title, og_site_name, org_name, copyright_name) -> Column:
    """``struct(institution, confidence)``: candidates in fixed order; two that agree are sure."""
    words = "|".join(literal(w) for w in INSTITUTION_WORDS)
    segments = F.split(T._c(title), r"\s+[|\-–—:]\s+|\s*[|:]\s*")
    segment = F.get(F.filter(segments, lambda s: s.rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])")), F.lit(0))
    one = lambda v, c: F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.struct(F.trim(v).alias("value"), F.lit(c).alias("confidence")))
    found = F.array_compact(F.array(one(T._c(org_name), "high"), one(T._c(og_site_name), "medium"), one(segment, "medium"), one(T._c(copyright_name), "low")))
    first = F.get(found, F.lit(0))
    agree = F.size(F.filter(found, lambda x: T.comparison_key(x["value"]) == T.comparison_key(first["value"]))) > 1
    return F.when(first.isNotNull(), F.struct(first["value"].alias("institution"), F.when(agree, "high").otherwise(first["confidence"]).alias("confidence")))


def footer_name(footer) -> Column:
    """The legal name after a copyright sign, shorter than 100 characters."""
    name = F.regexp_extract(T._c(footer), r"(?i)©\s*\d{4}(?:[-–]\d{2,4})?\s*,?\s*(.+)", 1)
    name = F.trim(F.regexp_replace(F.get(F.split(name, p(r"\ball rights reserved\b", True)), F.lit(0)), r"[.,]\s*$", ""))
    return F.when(F.length(name).between(1, 99), name)


def labelled_claims(blocks: DataFrame, headings: DataFrame, key: str, labels: dict[str, list[str]], multiple: bool = False) -> DataFrame:
    """Claims (key, field_key, claim_idx, raw_value, method) by label.

    ``blocks(key, idx, heading_context, text)``, ``headings(key, idx, text)``.  A block
    ``label: value`` beats the first block under a heading that names a label; blocks come
    before labels.  With ``multiple`` every match counts, once per text, and the whole text is
    kept as ``excerpt``.  Labels form one
    literal pattern per field, so no pattern is built from a column.
    """
    parts = []
    for field, names in labels.items():
        alternatives = "|".join(literal(n) for n in sorted(names, key=len, reverse=True))
        value = F.trim(F.regexp_extract("text", p(rf"\b(?:{alternatives})\b\s*[:\-–—]\s*(.+)", True), 1))
        direct = blocks.where((value != "") & ~T.is_chrome(value)).select(key, F.lit(field).alias("field_key"), F.lit(0).alias("pass"), "idx", F.lit(0).alias("sub"), value.alias("raw_value"), F.col("text").alias("excerpt"))
        named = headings.where(F.col("text").rlike(rf"(?i)(?<![a-z0-9])(?:{alternatives})(?![a-z0-9])")).select(key, F.col("text").alias("heading_context"), F.col("idx").alias("h_idx"))
        under = blocks.where(~T.is_chrome("text")).join(named, [key, "heading_context"]).select(
            key, F.lit(field).alias("field_key"), F.lit(1).alias("pass"), F.col("h_idx").alias("idx"), F.col("idx").alias("sub"), F.col("text").alias("raw_value"), F.col("text").alias("excerpt")
        )
        if not multiple:
            under = under.groupBy(key, "field_key", "pass").agg(F.min(F.struct("idx", "sub", "raw_value", "excerpt")).alias("x")).select(key, "field_key", "pass", "x.*")
        parts.append(direct.unionByName(under))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    group = [key, "field_key", F.lower(F.trim("excerpt")).alias("e")] if multiple else [key, "field_key"]
    best = rows.groupBy(*group).agg(F.min(F.struct("pass", "idx", "sub", "raw_value", "excerpt")).alias("x"))
    # the place of a claim among all of its page and field: whatever the page's length, no two share one
    order = Window.partitionBy(key, "field_key").orderBy("x.pass", "x.idx", "x.sub", "x.excerpt")
    return best.select(
        key, "field_key", (F.row_number().over(order) - 1).cast("long").alias("claim_idx"),
        F.left("x.raw_value", F.lit(LONGEST_CLAIM)).alias("raw_value"), F.when(F.col("x.pass") == 0, "labeled_pattern").otherwise("heading_scoped").alias("method"),
        F.left("x.excerpt", F.lit(LONGEST_CLAIM)).alias("excerpt"),
    )


def credits_claim(blocks: DataFrame, key: str) -> DataFrame:
    """A bare ``n credits`` anywhere beats the first mention within a text."""
    bare = F.col("text").rlike(p(r"^\d+\s*credits?$", True))
    found = F.regexp_extract("text", p(r"\b(\d+\s*credits?)\b", True), 1)
    return blocks.where(found != "").groupBy(key).agg(F.min_by(found, F.struct(~bare, "idx")).alias("raw_value")).select(key, F.lit("credits").alias("field_key"), "raw_value")


# fixed values: section categories in order of precedence, with their keywords
CATEGORIES = {
    "ACCREDITATION": ["accreditation", "accreditations", "accredited", "approval", "approvals", "approved by", "recognition", "recognized", "recognised", "entitled", "naac", "ugc", "aicte", "nba accredited", "iso certified", "wes recognized"],
    "SPECIALIZATION": ["specialization", "specializations", "specialisation", "specialisations", "elective", "electives", "combination", "combinations", "concentration", "concentrations", "major", "majors", "track", "tracks", "stream", "streams", "area of specialization", "areas of specialization"],
    "FEES": ["fee", "fees", "tuition", "cost", "price", "payment", "instalment", "installment", "emi", "programme fee", "program fee", "course fee"],
    "COURSE_DURATION": ["duration", "course length", "program length", "programme length", "how long", "semesters", "months to complete", "years to complete"],
    "RANKINGS": ["ranking", "rankings", "ranked", "rank", "nirf", "qs world", "qs ranking", "times higher", "ariia", "award", "awards", "awarded"],
    "ELIGIBILITY": ["eligibility", "eligible", "who can apply", "prerequisite", "prerequisites", "minimum qualification", "eligibility criteria", "admission requirements", "academic requirements", "qualification required", "qualifications required"],
    "MODE": ["mode", "format", "delivery mode", "distance learning", "on-campus", "hybrid", "blended"],
    "ADMISSION": ["admission", "admissions", "application process", "how to apply", "enrollment", "enrolment", "registration process", "selection process"],
    "PLACEMENT": ["placement", "placements", "hiring partner", "hiring partners", "career support", "recruiters", "job assistance"],
    "CURRICULUM": ["curriculum", "syllabus", "subjects covered", "modules covered"],
    "PROGRAM_STRUCTURE": ["program structure", "programme structure", "course structure", "semester wise", "credit structure"],
}
# fixed values: headings whose sections state no fact
OTHER_HEADINGS = [
    r"\brelated\s*(blogs?|articles?|posts?)\b", r"\byou\s*may\s*also\s*like\b", r"\brecommended\s*(for\s*you|articles?|posts?)\b", r"\bpopular\s*(posts?|articles?)\b",
    r"\b(featured\s*)?alumni\b", r"\b(student|success)\s*stor(y|ies)\b", r"\breal\s*stories\b", r"\bshare\s*your\s*details\b", r"\bproceed\s*with\s*the\s*download\b",
    r"\bdownload\s*(the\s*)?brochure\b", r"\brequest\s*a\s*call\s*?back\b", r"\bup\s*your\s*career\s*trajectory\b", r"\bbroaden\s*your\s*skillset\b",
    r"\bdevelop\s*core\s*competenc(?:y|ies)\b", r"\bestablish\s*(a\s*)?high-paying\s*career\b", r"\bget\s*a\s*prestigious\b(\s*\w+){0,2}\s*degree\b",
    r"\bwill\s*the\s*online\b.{0,40}\bbe\s*recognized\b", r"\brecognized\s*while\s*applying\s*for\s*jobs\b",
]
# fixed values: headings of lists that name no specializations
UNRELATED_LISTS = [
    r"\bfoundation\s*courses?\b", r"\bcareer\s*(options?|paths?|opportunities|prospects)\b", r"\bjob\s*(profiles?|roles?)\b", r"\bpotential\s*careers?\b",
    r"^\s*industries\s*$", r"\b(additional|extra)?\s*skill\s*(enhancement|building|development)\b", r"\bupskilling\b", r"\bmeet\s*(your|our)?\s*(expert\s*)?faculty\b",
    r"\bmeet\s*the\s*team\b", r"\bour\s*(instructors?|mentors?|trainers?)\b", r"\b(additional\s*)?tools\s*(&|and)\s*certifications?\b",
    r"\b(additional\s*)?certifications?\s*(&|and)\s*tools\b", r"\bwho\s*should\s*(pursue|take|do|join|opt\s*for|enroll|enrol)\b",
    r"\bwho\s*is\s*this\s*(course|program|programme|certification|degree)?\s*for\b", r"\bideal\s*for\b", r"\btarget\s*audience\b",
]


def list_shape(heading, items) -> Column:
    """2 to 20 items of content, at least two and seven in ten of which look like names."""
    heading = T._c(heading)
    counts = T.let(lambda x: F.struct(F.size(x["real"]).alias("real"), F.size(F.filter(x["real"], T.named_offering)).alias("named")), real=F.filter(T._c(items), lambda x: ~T.is_chrome(x)))
    fits = heading.rlike("[A-Za-z]{3,}") & ~heading.rlike(r"(?i)^\s*(INR|USD|Rs\.?|₹|\$)\s*[\d,.]") & ~T.any_of(heading, UNRELATED_LISTS)
    named = T.let(lambda x: x["n"]["real"].between(2, 20) & (x["n"]["named"] >= 2) & (x["n"]["named"] * 10 >= x["n"]["real"] * 7), n=counts)
    return F.when(fits, named).otherwise(False).cast("int")


def classify_sections(df: DataFrame, heading: str, paragraphs: str, items: str, table_headers: str) -> DataFrame:
    """``df`` with category, confidence and secondary categories: twice the keywords in the
    heading, those in short texts and table headers, and one for a list of names; ties by
    precedence.  All keywords are looked up in one pass of a text; later steps read what was found."""
    short = F.filter(F.col(paragraphs), lambda t: T.word_count(t) <= 12)
    body = F.concat_ws(" ", F.array_join(short, " "), F.array_join(F.col(table_headers), " "))
    rows = df.withColumn("_body", body).withColumn("_shape", list_shape(heading, items))
    every = [w for words in CATEGORIES.values() for w in words]
    rows = rows.withColumn("_h", T.phrases_in(heading, every)).withColumn("_b", T.phrases_in("_body", every))
    of = lambda c: F.array(*[F.size(F.filter(c, lambda x: x.isin(words))) for words in CATEGORIES.values()])  # noqa: E731, B023
    rows = rows.withColumn("_h", of("_h")).withColumn("_b", of("_b"))
    question = F.col(heading).rlike(r"\?\s*$")
    entries = []
    for i, name in enumerate(CATEGORIES):
        total = F.get("_h", F.lit(i)) * 2 + F.get("_b", F.lit(i)) + (F.col("_shape") if name == "SPECIALIZATION" else F.lit(0))
        if name in ("ACCREDITATION", "RANKINGS"):
            total = F.when(question, 0).otherwise(total)
        entries.append(F.struct((-total).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("category"), (F.get("_h", F.lit(i)) > 0).alias("sure")))
    rows = rows.withColumn("_ranked", F.array_sort(F.filter(F.array(*entries), lambda e: e["o"] < 0)))
    rows = rows.withColumn("_none", T.any_of(heading, OTHER_HEADINGS) | (F.size("_ranked") == 0))
    first = F.get("_ranked", F.lit(0))
    return (
        rows.withColumn("category", F.when(F.col("_none"), "OTHER").otherwise(first["category"]))
        .withColumn("confidence", F.when(F.col("_none"), "LOW").when(first["sure"], "HIGH").otherwise("MEDIUM"))
        .withColumn("secondary", F.when(F.col("_none"), F.array().cast("array<string>")).otherwise(F.transform(F.slice("_ranked", F.lit(2), F.greatest(F.size("_ranked"), F.lit(1))), lambda e: e["category"])))
        .drop("_body", "_shape", "_h", "_b", "_ranked", "_none")
    )


def sections(blocks: DataFrame, headings: DataFrame, key: str, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Blocks grouped by heading text: the first heading of a text wins, orphans are left out.
    Texts of at most eight words without a sentence break are items, others paragraphs.

    With ``tables(key, idx, heading_context, headers, rows)`` and ``images(key, idx, heading_context,
    url)`` a section also has table_headers, table_rows and image_urls, and needs no text."""
    h = headings.groupBy(key, F.col("text").alias("heading_context")).agg(F.min("idx").alias("h_idx"), F.min_by("level", "idx").alias("level"))
    item = (F.size(F.split(T.collapse_ws("text"), " ")) <= 8) & ~F.col("text").rlike(r"[.!?]\s+\S")
    texts = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("idx", "text")))), lambda x: x["text"])
    g = blocks.groupBy(key, "heading_context").agg(texts(item).alias("items"), texts(~item).alias("paragraphs"))
    names = ["items", "paragraphs"]
    listed = lambda *c: F.array_sort(F.collect_list(F.struct("idx", *c)))
    if tables is not None:
        t = tables.groupBy(key, "heading_context").agg(listed("headers", "rows").alias("t"))
        t = t.select(key, "heading_context", F.flatten(F.transform("t", lambda x: x["headers"])).alias("table_headers"), F.flatten(F.transform("t", lambda x: x["rows"])).alias("table_rows"))
        g, names = g.join(t, [key, "heading_context"], "full_outer"), [*names, "table_headers", "table_rows"]
    if images is not None:
        i = images.groupBy(key, "heading_context").agg(F.transform(listed("url"), lambda x: x["url"]).alias("image_urls"))
        g, names = g.join(i, [key, "heading_context"], "full_outer"), [*names, "image_urls"]
    none = {n: F.array().cast("array<array<string>>" if n == "table_rows" else "array<string>") for n in names}
    return g.join(h, [key, "heading_context"]).select(key, "h_idx", "level", F.col("heading_context").alias("heading"), *[F.coalesce(n, none[n]).alias(n) for n in names])


#: Categories that state facts, and which of them may both be read out of one section.
FACT_CATEGORIES = ["ACCREDITATION", "RANKINGS", "SPECIALIZATION", "CURRICULUM", "PROGRAM_STRUCTURE", "ELIGIBILITY", "FEES"]
TOGETHER = [("ACCREDITATION", "RANKINGS"), ("CURRICULUM", "PROGRAM_STRUCTURE")]


def section_facts(rows: DataFrame, key: str) -> DataFrame:
    """What classified sections state: (key, field, h_idx, i, value, source_type, image_url, confidence).

    ``rows`` are sections with tables and images, category, confidence and secondary categories.
    Every category has its own filter: names of offerings for lists of them, requirements for
    eligibility, anything but page chrome for the rest; tables state fees and subjects by row, and
    a picture among fees is a fact still to be read.
    """
    cats = F.array("category")
    for both in TOGETHER:
        more = F.array_intersect("secondary", F.array(*[F.lit(x) for x in both]))
        cats = F.when(F.col("category").isin(list(both)), F.array_distinct(F.concat(F.array("category"), more))).otherwise(cats)
    clean = lambda c: F.filter(c, lambda v: ~T.is_chrome(v))
    names = lambda c: F.filter(c, lambda v: T.named_offering(v) & ~T.is_chrome(v))
    needs = lambda c: F.filter(c, eligibility_sentence)
    of = lambda c, kind: F.transform(c, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("source_type"), F.lit(None).cast("string").alias("image_url")))
    pictures = F.transform("image_urls", lambda u: F.struct(F.lit("").alias("value"), F.lit("image_ocr").alias("source_type"), u.alias("image_url")))
    subjects = F.transform("table_rows", lambda r: F.trim(F.get(F.filter(r, lambda c: F.trim(c) != ""), F.lit(0))))
    fees = F.filter(F.transform("table_rows", table_row_fact), lambda v: v.isNotNull())
    c = F.col("field")
    stated = (
        F.when(c == "SPECIALIZATION", of(names("items"), "heading_and_text"))
        .when(c.isin("ACCREDITATION", "RANKINGS"), F.concat(of(clean("items"), "heading_and_text"), of(clean("paragraphs"), "text")))
        .when(c == "ELIGIBILITY", F.concat(of(needs("items"), "heading_and_text"), of(needs("paragraphs"), "text")))
        .when(c.isin("CURRICULUM", "PROGRAM_STRUCTURE"), F.concat(of(names("items"), "heading_and_text"), of(names(F.filter(subjects, lambda v: v.isNotNull())), "table")))
        .when(c == "FEES", F.concat(of(clean(F.concat("items", "paragraphs")), "text"), of(clean(fees), "table"), pictures))
    )
    each = rows.withColumn("field", F.explode(cats)).where(c.isin(FACT_CATEGORIES))
    found = each.select(key, "field", "h_idx", "confidence", F.posexplode(stated).alias("i", "x"))
    low = F.when(F.col("x.source_type") == "image_ocr", "LOW").otherwise(F.col("confidence"))
    return found.select(key, "field", "h_idx", "i", "x.value", "x.source_type", "x.image_url", low.alias("confidence"))


def read_images(facts: DataFrame, ocr: DataFrame) -> DataFrame:
    """Facts with what a reader made of their pictures (``ocr``: url, text, confidence): a sure reading
    is a fact like any other, an unsure one stays marked, and none leaves the value empty."""
    seen = ocr.dropDuplicates(["url"]).select(F.col("url").alias("image_url"), F.col("text").alias("_text"), F.col("confidence").alias("_sure"))
    rows = facts.join(seen, "image_url", "left")
    return rows.select(
        *[c for c in facts.columns if c not in ("value", "confidence")], F.coalesce("_text", "value").alias("value"), F.coalesce("_sure", "confidence").alias("confidence")
    ).select(*facts.columns)


def cross_sell(heading: Column) -> Column:
    """Whether a heading opens a section of other offers."""
    # fixed value: how such headings read
    return T.any_of(heading["text"], [r"\b(other|related|similar|popular|more)\b[\s\S]{0,30}\b(programs?|courses?|degrees?|specializations?|electives?)\b"])


# fixed values: headings of specialization lists
SPECIALIZATION_LABELS = ["Specializations", "Specialisations", "Specialization", "Specialisation", "Electives", "Elective"]


def specializations(headings, blocks) -> Column:
    """The items of the first heading that names specializations: the headings below it, down to the
    next of its level or above; without any, the texts that stand under it."""
    heads, blocks = T._c(headings), T._c(blocks)
    label = lambda h: T.any_of(h["text"], [rf"(?<![a-z0-9]){literal(w)}(?![a-z0-9])" for w in SPECIALIZATION_LABELS])

    def items(x: Column) -> Column:
        first = x["first"]
        after = F.filter(heads, lambda h: h["idx"] > first["idx"])
        end = F.array_min(F.transform(F.filter(after, lambda h: h["level"] <= first["level"]), lambda h: h["idx"]))
        below = F.transform(F.filter(after, lambda h: (end.isNull() | (h["idx"] < end)) & (h["text"] != "")), lambda h: h["text"])
        under = F.transform(F.filter(blocks, lambda b: (b["heading_context"] == first["text"]) & (b["text"] != "")), lambda b: b["text"])
        found = F.when(F.size(below) > 0, below).otherwise(under)
        return F.when(first.isNotNull(), F.transform(found, lambda v: F.left(v, F.lit(LONGEST_CLAIM)))).otherwise(F.array().cast("array<string>"))

    return T.let(items, first=F.get(F.filter(heads, label), F.lit(0)))


def merged_specializations(lists: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, idx, value): a page's list (key, idx, value) and then its specialization facts (key, idx,
    value), each item once whatever its case, in order."""
    both = lists.select(key, F.lit(0).alias("rank"), "idx", "value").unionByName(facts.select(key, F.lit(1).alias("rank"), "idx", "value"))
    rows = both.withColumn("item", F.lower(F.trim("value"))).where("item <> ''")
    first = rows.groupBy(key, "item").agg(F.min(F.struct("rank", "idx", "value")).alias("x"))
    by = Window.partitionBy(key).orderBy("x.rank", "x.idx", "item")
    return first.select(key, (F.row_number().over(by) - 1).alias("idx"), F.col("x.value").alias("value"))


def guess_claims(pages: DataFrame, key: str) -> DataFrame:
    """Program, degree and institution of pages as claims (key, field_key, idx, raw_value); what a
    page doesn't have makes none."""
    fields = ("program", "degree", "institution")
    rows = F.array(*[F.struct(F.lit(f).alias("field_key"), F.col(f).alias("raw_value")) for f in fields])
    return pages.select(key, F.explode(rows).alias("x")).where("x.raw_value is not null").select(key, "x.field_key", F.lit(0).alias("idx"), "x.raw_value")


def proper_nouns(*values) -> Column:
    """Words of at least two letters of a page's names: these are never misspelt."""
    words = F.split(F.lower(F.concat_ws(" ", *[T._c(v) for v in values])), "[^a-z']+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def spell_check(sources: DataFrame, key: str, text: str, known: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """Words unknown to ``known(word)``: per key the count and first surface form, words of at
    least three letters that are no acronyms."""
    words = F.regexp_extract_all(F.regexp_replace(text, "<[^>]*>", " "), F.lit(r"([A-Za-z]+(?:'[A-Za-z]+)?)"), 1)
    rows = sources.select(key, F.posexplode(words).alias("pos", "surface")).where((F.length("surface") >= 3) & ~F.col("surface").rlike("^[A-Z]{2,}$"))
    rows = rows.withColumn("word", F.lower("surface"))
    if allowed:
        rows = rows.where(~F.col("word").isin(list(allowed)))
    counted = rows.groupBy(key, "word").agg(F.count("*").alias("n"), F.min_by("surface", "pos").alias("surface"))
    return counted.join(known.select("word"), "word", "left_anti")


def detect_logo(logos="logos", json_ld="json_ld", open_graph="open_graph") -> Column:
    """``struct(url, alt, method)``: a header image that hints at a logo, the first header image,
    a logo of structured data, the page's share image, or not found."""
    found = T._c(logos)
    head = F.coalesce(F.get(F.filter(found, lambda x: x["hinted"]), F.lit(0)), F.get(found, F.lit(0)))
    of = lambda x, path: F.try_variant_get(F.try_parse_json(x), path, "string")
    data = F.get(F.array_compact(F.transform(T._c(json_ld), lambda x: F.coalesce(of(x, "$.logo.url"), of(x, "$.logo")))), F.lit(0))
    share = F.nullif(F.try_element_at(T._c(open_graph), F.lit("og:image")), F.lit(""))
    one = lambda url, alt, method: F.struct(url.alias("url"), alt.alias("alt"), F.lit(method).alias("method"))
    none = F.lit(None).cast("string")
    return (
        F.when(head.isNotNull(), one(head["url"], head["alt"], "header_logo_selector"))
        .when(data.isNotNull(), one(data, none, "structured_data_logo"))
        .when(share.isNotNull(), one(share, none, "og_image_fallback"))
        .otherwise(one(none, none, "not_found"))
    )


def subject_only_program(texts: Column, stopwords: list[str]) -> Column:
    """Without a degree: the first heading, else the title's first segment, that has two
    telling words of three letters or more."""
    telling = lambda t: F.size(F.filter(F.array_distinct(T.tokens(t)), lambda w: ~w.isin(stopwords))) >= 2
    head = F.get(F.filter(texts, lambda t: t["location"] == "heading"), F.lit(0))["text"]
    title = F.get(F.filter(texts, lambda t: t["location"] == "title"), F.lit(0))["text"]
    segment = F.trim(F.get(F.split(title, r"\s[|\-–—:]\s|[|:]"), F.lit(0)))
    return F.when(telling(head), head).when(telling(segment), segment)


def other_degrees(texts: Column, but: Column) -> Column:
    """Names of further degrees the texts name, each once, in dictionary order."""
    named = F.array(*[F.when(_named_in(texts, names), F.lit(name)) for _, name, names, _ in DEGREES])
    return F.filter(F.array_compact(named), lambda n: ~F.coalesce(n == but, F.lit(False)))


def _named_in(texts: Column, names: list[str]) -> Column:
    return F.exists(texts, lambda t: T.any_of(t["text"], [rf"(?<![a-z0-9]){literal(n)}(?![a-z0-9])" for n in names]))


# fixed values: words of eligibility, and of marks
_TOPIC = [r"\b(eligib\w*|qualif\w*|degree|graduat\w*|diploma|10\s*\+\s*2|experience|university|institution|board)\b"]
_MARKS = [r"\b(marks?|aggregate|score[ds]?|cgpa|grade|minimum|percentile)\b"]


def eligibility_sentence(text) -> Column:
    """At least three words with letters, no chrome, and a requirement: a percentage counts only
    beside words about marks."""
    from factweave.functions import values as V

    text = T._c(text)
    words = F.size(F.filter(F.split(T.collapse_ws(text), " "), lambda w: w != ""))

    def says(x: Column) -> Column:
        f = x["f"]
        solid = (F.size(f["groups"]) > 0) | f["recognized"] | f["experience_years"].isNotNull()
        return solid | (f["percentage"].isNotNull() & x["marks"]) | x["topic"]

    need = T.let(says, f=V.eligibility_facts(text), marks=T.any_of(text, _MARKS), topic=T.any_of(text, _TOPIC))
    return (words >= 3) & text.rlike("[A-Za-z]") & ~T.is_chrome(text) & need


def table_row_fact(cells) -> Column:
    """A table row as ``first: rest``."""
    full = F.filter(T._c(cells), lambda c: F.trim(c) != "")
    rest = F.array_join(F.slice(full, F.lit(2), F.greatest(F.size(full), F.lit(1))), " ")
    return F.when(F.size(full) > 1, F.concat(F.get(full, F.lit(0)), F.lit(": "), rest)).otherwise(F.get(full, F.lit(0)))


def page_warnings(page: DataFrame) -> Column:
    """What a page lacks, as readable lines."""
    return F.array_compact(F.array(
        F.when(F.col("title").isNull(), F.lit("no title")), F.when(F.col("meta_description").isNull(), F.lit("no meta description")),
        F.when(F.size("headings") == 0, F.lit("no headings")), F.when(~F.col("ok"), F.concat(F.lit("not parsed: "), F.coalesce("error", F.lit("")))),
    ))
