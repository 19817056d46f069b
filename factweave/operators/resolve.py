"""Which authoritative page a target page corresponds to: gates, scores, selection.

Targets and candidates are pairs of page identities in one row, with columns ``t_*`` and
``c_*``: url, title, headings (array), degree, program, institution, brand, page_type.
Gates are plain expressions and come before scores, so Catalyst can push them down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import urls as U
from factweave.operators.windows import top_k
from factweave.sources.store import BROADCAST_NUMBERS, cut, small


@dataclass(frozen=True)
class Scoring:
    degree: int = 60
    program: int = 25
    institution: int = 15
    heading_keyword: int = 10
    url_keyword: int = 15
    page_type: int = 5
    homepage: int = -20
    identity: int = 20
    least_confidence: int = 40
    high_confidence: int = 70
    least_margin: int = 15


# fixed values: words that say nothing about a subject
STOPWORDS = [
    "online", "program", "programme", "course", "degree", "from", "with", "the", "and", "for", "learn", "apply", "now", "get", "started",
    "your", "our", "top", "best", "new", "science", "arts", "engineering", "studies", "management", "technology", "master", "masters",
    "bachelor", "bachelors", "courses", "programs", "programmes", "degrees", "university", "universities", "college", "colleges",
    "institute", "institutes", "institution", "institutions",
]
CERTIFICATES = ["PGCP", "PGDP"]


def _same(a, b) -> Column:
    """Equal by comparison key; NULL or blank is never evidence."""
    x, y = T.comparison_key(a), T.comparison_key(b)
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def text_verdict(a, b) -> Column:
    a, b = F.nullif(T._c(a), F.lit("")), F.nullif(T._c(b), F.lit(""))
    return F.when(a.isNull() | b.isNull(), "inconclusive").when(T.comparison_key(a) == T.comparison_key(b), "agree").otherwise("conflict")


def registry_verdict(a, b, id_a, id_b, shared_brand) -> Column:
    """Names that differ are judged by the institution each resolves to; an unresolved side or
    a brand shared by several institutions is inconclusive."""
    plain = text_verdict(a, b)
    id_a, id_b = T._c(id_a), T._c(id_b)
    by_id = F.when(id_a.isNull() | id_b.isNull(), "inconclusive").when(id_a == id_b, "agree").otherwise("conflict")
    judged = F.when(plain == "conflict", by_id).otherwise(plain)
    return F.when((judged == "agree") & F.coalesce(T._c(shared_brand), F.lit(False)), "inconclusive").otherwise(judged)


def institution_gate(name_verdict, footer_verdict, logo_similarity=None, enabled: bool = True, least_similarity: float = 0.75) -> Column:
    """Any conflict fails, any agreement passes; only if both are silent the logo decides."""
    n, f = T._c(name_verdict), T._c(footer_verdict)
    logo = F.lit(True) if logo_similarity is None else F.coalesce(T._c(logo_similarity) >= least_similarity, F.lit(True))
    return F.lit(not enabled) | F.when((n == "conflict") | (f == "conflict"), False).when((n == "agree") | (f == "agree"), True).otherwise(logo)


def needs_logo(name_verdict, footer_verdict, t_logo, c_logo) -> Column:
    """Only where both texts are silent and both pages have a logo are logos worth comparing."""
    silent = (T._c(name_verdict) == "inconclusive") & (T._c(footer_verdict) == "inconclusive")
    return silent & T._c(t_logo).isNotNull() & T._c(c_logo).isNotNull()


def logo_similarity(pairs: DataFrame, hashes: DataFrame, t_logo: str = "t_logo", c_logo: str = "c_logo", needed: str = "needs_logo") -> DataFrame:
    """``pairs`` with ``logo_similarity``: that of the two logos' hashes (url, hash) where it is needed
    and both are known, else NULL.  Pairs that don't need one ask for nothing; each image is hashed
    once however many pairs it is in."""
    ask = lambda c: F.when(F.col(needed), F.col(c))
    of = lambda s: hashes.dropDuplicates(["url"]).select(F.col("url").alias(f"_{s}_url"), F.col("hash").alias(f"_{s}_hash"))
    rows = pairs.withColumn("_t_ask", ask(t_logo)).withColumn("_c_ask", ask(c_logo))
    rows = rows.join(of("t"), F.col("_t_ask") == F.col("_t_url"), "left").join(of("c"), F.col("_c_ask") == F.col("_c_url"), "left")
    return rows.withColumn("logo_similarity", U.hash_similarity("_t_hash", "_c_hash")).drop("_t_ask", "_c_ask", "_t_url", "_c_url", "_t_hash", "_c_hash")


def pair_gate(t_id, c_id, name_verdict, footer_verdict, similarity=None) -> Column:
    """Two institutions resolved on their own evidence decide at once: the same passes, different
    ones fail.  Without both, names, footers and logos decide."""
    t, c = T._c(t_id), T._c(c_id)
    return F.when(t.isNotNull() & c.isNotNull(), t == c).otherwise(institution_gate(name_verdict, footer_verdict, similarity))


def institution_tiers(pages: DataFrame, names: DataFrame, key: str = "page_id") -> DataFrame:
    """Which registered institution a page is about, by three kinds of evidence: (key, url_id, page_id_, logo_id).

    ``pages`` has the key, url, institution, brand and logos (array of struct<url, alt>);
    ``names(institution_id, name)`` are names and short names.  A tier that points to several
    institutions is silent.  Words of the address, the page's own names and the words of logo
    files and texts are looked up by equi-joins.
    """
    known = names.select("institution_id", T.comparison_key("name").alias("name")).where("name <> ''").distinct()
    address = F.split(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " "), " ")
    logos = F.coalesce("logos", F.array().cast("array<struct<url:string,alt:string>>"))
    logo = F.flatten(F.transform(logos, lambda x: F.concat(T.filename_tokens(x["url"]), F.array(T.comparison_key(F.coalesce(x["alt"], F.lit("")))))))
    said = F.array_compact(F.array(T.comparison_key("institution"), T.comparison_key("brand")))
    told = pages.select(key, F.explode(F.array(
        F.struct(F.lit("url").alias("tier"), address.alias("words")), F.struct(F.lit("page").alias("tier"), said.alias("words")), F.struct(F.lit("logo").alias("tier"), logo.alias("words")),
    )).alias("x")).select(key, "x.tier", F.explode(F.array_distinct("x.words")).alias("name"))
    one = told.join(small(known), "name").groupBy(key, "tier").agg(F.min("institution_id").alias("lo"), F.max("institution_id").alias("hi")).where("lo = hi")
    tier = lambda t: F.max(F.when(F.col("tier") == t, F.col("lo")))
    g = one.groupBy(key).agg(tier("url").alias("url_id"), tier("page").alias("name_id"), tier("logo").alias("logo_id"))
    return pages.select(key).join(g, key, "left")


def target_identity(pages: DataFrame, names: DataFrame, svg_texts: DataFrame, key: str = "page_id", default_id=None, default_method=None) -> DataFrame:
    """(key, identity) in two passes: what address, page and logos say; then, only for pages on
    which all three are silent, the texts inside their svg logos (url, text)."""
    first = institution_tiers(pages, names, key)
    silent = first.where("url_id is null and name_id is null and logo_id is null").select(key)
    logos = pages.join(silent, key, "left_semi").select(key, F.explode("logos").alias("logo")).select(key, F.col("logo.url").alias("url"))
    read = logos.join(svg_texts.dropDuplicates(["url"]), "url").groupBy(key).agg(F.collect_list(F.struct(F.lit("").alias("url"), F.col("text").alias("alt"))).alias("logos"))
    none = F.lit(None).cast("string")
    again = institution_tiers(read.select(key, F.lit("").alias("url"), none.alias("institution"), none.alias("brand"), "logos"), names, key).select(key, F.col("logo_id").alias("svg_id"))
    rows = first.join(again, key, "left")
    return rows.select(key, combine_tiers("url_id", "name_id", F.coalesce("logo_id", "svg_id"), default_id, default_method).alias("identity"))


def discover_pages(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages (source_id, url, program) of each target's source (idx, source_id); targets without
    a source have none."""
    return resolved.where("source_id is not null").select("idx", "source_id").join(pages.select("source_id", "url", "program"), "source_id").select("idx", "source_id", "url", "program")


def resolve_for_analysis(analyses: DataFrame, sources: DataFrame, aliases: DataFrame, programs: DataFrame, pages: DataFrame) -> DataFrame:
    """Analyses (idx, url, institution, program) with their source and how many pages it has."""
    found = resolve_source(analyses, sources, aliases, programs)
    return found.join(discover_pages(found, pages).groupBy("idx").agg(F.count("*").alias("n_pages")), "idx", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))


def precedence(targets: DataFrame, overrides: DataFrame, conflicts: DataFrame, registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """One answer per target (target_idx, url) out of four branches, the first that has one: an exact
    override (url, master_url); a conflict of identities (target_idx), which leaves it unresolved; the
    registry's page (target_idx, master_url, identity_ok), if its identity holds; discovery
    (target_idx, master_url, confidence, outcome)."""
    rows = (
        targets.join(small(overrides.select("url", F.col("master_url").alias("o_url"))), "url", "left")
        .join(conflicts.select("target_idx", F.lit(True).alias("torn")).distinct(), "target_idx", "left")
        .join(registry.where("identity_ok").select("target_idx", F.col("master_url").alias("r_url")), "target_idx", "left")
        .join(discovered.select("target_idx", F.col("master_url").alias("d_url"), F.col("confidence").alias("d_confidence"), F.col("outcome").alias("d_outcome")), "target_idx", "left")
    )
    pick = lambda o, torn, r, d: F.when(F.col("o_url").isNotNull(), o).when(F.col("torn"), torn).when(F.col("r_url").isNotNull(), r).otherwise(d)
    none, lit = F.lit(None).cast("string"), F.lit
    return rows.select(
        "target_idx", pick(F.col("o_url"), none, F.col("r_url"), F.col("d_url")).alias("master_url"), pick(lit("high"), none, lit("high"), F.col("d_confidence")).alias("confidence"),
        pick(lit("success"), lit("institution_conflict"), lit("success"), F.coalesce("d_outcome", lit("authoritative_page_not_found"))).alias("outcome"),
        pick(lit("override"), lit("identity"), lit("registry"), lit("discovery")).alias("method"),
    )


def needs_top_up(outcome, t_degree, t_confidence, m_degree) -> Column:
    """Unresolved, or resolved to a page of another degree than the one the target surely has."""
    o, t, m = T._c(outcome), T._c(t_degree), T._c(m_degree)
    return (o != "success") | F.coalesce((T._c(t_confidence) == "high") & (t != m), F.lit(False))


def to_homepage(target, final, homepage) -> Column:
    """A target that was redirected to its site's home page isn't the page that was asked for."""
    return F.coalesce((U.page_key(final) == U.page_key(homepage)) & (U.page_key(target) != U.page_key(homepage)), F.lit(False))


def exhausted(outcome, out_of_budget) -> Column:
    """Not found may mean that the crawl ended too soon; what is ambiguous stays so."""
    return F.when((T._c(outcome) == "authoritative_page_not_found") & T._c(out_of_budget), "crawl_budget_exhausted").otherwise(T._c(outcome))


def subject_tokens(text, exclusions) -> Column:
    """Distinct tokens of a text with abbreviations spelled out, without those of the degree and
    institution and without stopwords."""
    found = F.array_distinct(T.tokens(T.expand_abbreviations(F.coalesce(T._c(text), F.lit("")))))
    out = F.array_except(found, T.tokens(F.coalesce(T._c(exclusions), F.lit(""))))
    return F.array_except(out, F.array(*[F.lit(w) for w in STOPWORDS]))


def program_gate(target_subject: Column, candidate_tokens: Column, least: int = 1) -> Column:
    """Passes without a subject, or with ``least`` shared tokens."""
    return (F.size(target_subject) == 0) | (F.size(F.array_intersect(target_subject, candidate_tokens)) >= least)


def score(pairs: DataFrame, homepage: str | None = None, s: Scoring = Scoring()) -> DataFrame:
    """``pairs`` with score and breakdown (array of struct<signal, points>)."""
    t_name = F.coalesce("t_institution", "t_brand")
    c_name = F.coalesce("c_institution", "c_brand")
    known = F.array_distinct(T.tokens(F.concat_ws(" ", "t_degree", "t_program", t_name)))
    heads = F.concat_ws(" ", "c_title", F.array_join(F.coalesce("c_headings", F.array().cast("array<string>")), " "))
    signals = [
        ("degree", s.degree, _same("t_degree", "c_degree")),
        ("program", s.program, _same("t_program", "c_program")),
        ("institution", s.institution, _same(t_name, c_name)),
        ("heading_keyword", s.heading_keyword, F.arrays_overlap(T.tokens(heads), known)),
        ("url_keyword", s.url_keyword, F.arrays_overlap(T.tokens("c_url"), known)),
        ("page_type", s.page_type, F.coalesce(F.col("t_page_type") == F.col("c_page_type"), F.lit(False))),
    ]
    hit = F.lit(False)
    for _, _, c in signals:
        hit = hit | c
    if homepage is not None:
        signals.append(("homepage", s.homepage, ~hit & F.coalesce(U.page_key("c_url") == U.page_key(F.lit(homepage)), F.lit(False))))
    if "identity_match" in pairs.columns:
        signals.append(("identity", s.identity, F.coalesce("identity_match", F.lit(False))))
    breakdown = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(p).alias("points"))) for n, p, c in signals]))
    return pairs.withColumn("breakdown", breakdown).withColumn("score", F.aggregate("breakdown", F.lit(0), lambda a, x: a + x["points"]))


def class_scores(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of all pairs of pages of one institution, by classes: pages (page_id, t_class, c_class) and
    (t_class, c_class, score).  ``pages`` has page_id, url, title, headings, degree, program,
    institution, brand and page_type.

    A target is read for its identity alone.  Of a candidate's title, headings and address only tokens
    count that some target of the institution knows; candidates that agree in these and in identity
    score alike.  So pairs of classes are scored, which pages' numbers don't square.
    """
    own = ["institution", "degree", "program", "brand", "page_type"]
    blank = F.array().cast("array<string>")
    known = F.array_distinct(T.tokens(F.concat_ws(" ", "degree", "program", F.coalesce("institution", "brand"))))
    every = pages.where("institution is not null")
    said = every.select("institution", F.explode(known).alias("token")).groupBy("institution").agg(F.collect_set("token").alias("vocabulary"))
    shown = lambda text: F.array_join(F.sort_array(F.array_intersect(T.tokens(text), F.coalesce("vocabulary", blank))), " ")
    rows = every.join(said, "institution", "left").select(
        "page_id", *own, shown(F.concat_ws(" ", "title", F.array_join(F.coalesce("headings", blank), " "))).alias("title"), shown(F.coalesce("url", F.lit(""))).alias("url"),
    )
    classes = lambda keys, name: cut(rows.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()))
    t, c = classes(own, "t_class"), classes([*own, "title", "url"], "c_class")

    def classed(df: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        there = of.select(*[F.col(k).alias(f"_{k}") for k in keys], of.columns[-1])
        return df.join(small(there), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])

    found = cut(classed(classed(rows, t, own), c, [*own, "title", "url"]).select("page_id", "t_class", "c_class"))
    side = lambda df, s, rest: df.select(*[F.col(x).alias(f"{s}_{x}") for x in [*own, *rest]], f"{s}_class")
    pairs = side(t, "t", []).join(side(c, "c", ["title", "url"]), F.col("t_institution") == F.col("c_institution"))
    return found, cut(score(pairs.withColumn("c_headings", blank)).select("t_class", "c_class", "score"))


def best_of_classes(pages: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(t_page_id, c_page_id, score): for each page of ``class_scores`` at least the best ``k`` others, by score
    and then id.  Of a class and of the classes a target meets, as many first pages do as are asked for
    and as may be the target itself."""
    most = k + (pages.groupBy("page_id").count().agg(F.max("count")).first()[0] or 0)
    firsts = top_k(pages.select("c_class", F.col("page_id").alias("c_page_id")), ["c_class"], ["c_page_id"], most).drop("rank")
    listed = top_k(scores.join(small(cut(firsts)), "c_class"), ["t_class"], [F.desc("score"), "c_page_id"], most).drop("rank", "c_class")
    return pages.select(F.col("page_id").alias("t_page_id"), "t_class").join(small(cut(listed)), "t_class").where("t_page_id <> c_page_id").drop("t_class")


def all_of_classes(t: DataFrame, c: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of rows of ``t`` (a number, t_class) and ``c`` (a number, c_class) whose classes are in
    ``pairs`` (t_class, c_class, ...).  Each row of ``t`` is dealt out by its number, meets its classes and
    then the numbers in these, so tasks are even; memory holds no pair, and of a class the 64th part at a
    time.  A number that is NULL is in no pair."""
    tasks, number = 4 * t.sparkSession.sparkContext.defaultParallelism, c.columns[0]
    lists = cut(c.groupBy("c_class", F.pmod(number, F.lit(64)).alias("part")).agg(F.collect_list(number).alias("list")).drop("part"))
    few = c.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS
    met = t.repartition(tasks, t.columns[0]).join(small(pairs), "t_class").join(F.broadcast(lists) if few else lists, "c_class")
    return met.drop("t_class", "c_class").withColumn(number, F.explode("list")).drop("list")


def select_page(scored: DataFrame, target: str, candidate: str, idx: str, s: Scoring = Scoring()) -> DataFrame:
    """One row per target: the candidate chosen, or why none is.

    Below the confidence threshold nothing is chosen; a runner-up within the margin makes the
    choice ambiguous, unless exactly two share the best score and one of them alone is a
    certificate: then the full degree wins.  ``scored`` may have ``c_degree`` and ``eligible``.
    """
    rows = scored.where("eligible") if "eligible" in scored.columns else scored
    degree = F.col("c_degree") if "c_degree" in rows.columns else F.lit(None).cast("string")
    best = Window.partitionBy(target)
    rows = rows.withColumn("_top", F.max("score").over(best)).where(F.col("score") > F.col("_top") - s.least_margin)
    entry = F.struct((-F.col("score")).alias("o"), F.col(idx).alias("i"), F.col(candidate).alias("c"), F.col("score").alias("s"), degree.alias("d"))
    g = rows.groupBy(target).agg(
        F.max("_top").alias("top"), F.count("*").alias("near"), F.count_if(F.col("score") == F.col("_top")).alias("tied"),
        F.min(entry).alias("a"),
        F.max(F.when(F.col("score") == F.col("_top"), entry)).alias("b"),
    )
    cert = lambda e: F.col(e)["d"].isin(CERTIFICATES)
    broken = (F.col("tied") == 2) & F.col("a.d").isNotNull() & F.col("b.d").isNotNull() & (cert("a") != cert("b"))
    winner = F.when(F.col("near") == 1, F.col("a.c")).when(F.coalesce(broken, F.lit(False)), F.when(cert("a"), F.col("b.c")).otherwise(F.col("a.c")))
    weak = F.col("top") < s.least_confidence
    return g.select(
        target, F.col("top").alias("top_score"),
        F.when(~weak, winner).alias("selected"),
        F.when(~weak & winner.isNotNull(), F.when(F.col("top") >= s.high_confidence, "high").otherwise("medium")).alias("confidence"),
        F.when(weak, "authoritative_page_not_found").when(winner.isNull(), "ambiguous_candidates").alias("failure_reason"),
    )


def resolve_source(urls: DataFrame, sources: DataFrame, aliases: DataFrame, programs: DataFrame) -> DataFrame:
    """Target (idx, url, institution, program) to a registered source.

    ``sources(source_id, institution_id, host)`` by host or parent host, else by institution
    alias (``aliases(alias, institution_id)``); one remaining source is taken without a program
    check, several need ``programs(alias, source_id)`` to agree.  Hosts are matched by an
    equi-join on every parent of the host.
    """
    labels = F.split(U.host("url"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    t = urls.withColumn("t_host", F.explode_outer(F.when(U.host("url").isNotNull(), parents)))
    by_host = t.join(small(sources), F.col("t_host") == F.lower("host")).select("idx", "program", "source_id", F.lit("high").alias("confidence")).distinct()
    rest = urls.join(by_host.select("idx").distinct(), "idx", "left_anti").withColumn("key", T.comparison_key("institution"))
    by_alias = (
        rest.join(small(aliases.withColumn("key", T.comparison_key("alias"))), "key")
        .join(small(sources), "institution_id").select("idx", "program", "source_id", F.lit("medium").alias("confidence")).distinct()
    )
    found = by_host.unionByName(by_alias)
    named = small(programs.select(T.comparison_key("alias").alias("p_key"), F.col("source_id").alias("p_source"), F.lit(True).alias("fits")).distinct())
    marked = found.join(named, (T.comparison_key("program") == F.col("p_key")) & (F.col("source_id") == F.col("p_source")), "left")
    g = marked.groupBy("idx").agg(
        F.count("*").alias("n"), F.count_if("fits").alias("n_fit"), F.min("source_id").alias("only"), F.min(F.when(F.col("fits"), F.col("source_id"))).alias("fit"), F.min("confidence").alias("confidence")
    )
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_fit") == 1, F.col("fit"))
    reason = F.when(F.col("n").isNull(), "institution_not_registered").when(chosen.isNotNull(), F.lit(None)).when(F.col("n_fit") == 0, "program_not_registered").otherwise("ambiguous_match")
    return urls.select("idx").join(g, "idx", "left").select("idx", chosen.alias("source_id"), F.when(chosen.isNotNull(), F.col("confidence")).alias("confidence"), reason.alias("reason"))


def combine_tiers(url_id, page_id, logo_id, default_id=None, default_method=None) -> Column:
    """Institution identity out of three tiers: distinct ids conflict, two that agree combine,
    one stands alone, none falls back to a default."""
    tiers = [("url_identifier", T._c(url_id)), ("page_identity", T._c(page_id)), ("logo", T._c(logo_id))]
    ids = F.array_compact(F.array(*[c for _, c in tiers]))
    distinct = F.array_distinct(ids)
    alone = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in tiers])
    fallback = F.lit(None).cast("string") if default_id is None else T._c(default_id)
    how = F.lit("unresolved") if default_method is None else F.when(fallback.isNotNull(), T._c(default_method)).otherwise("unresolved")
    method = F.when(F.size(distinct) > 1, "conflict").when(F.size(ids) > 1, "combined_signals").when(F.size(ids) == 1, alone).otherwise(how)
    return F.struct(
        F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) == 0, fallback).alias("institution_id"),
        method.alias("method"),
        ((F.size(ids) == 0) & fallback.isNotNull()).alias("fallback_applied"),
        F.when(F.size(distinct) > 1, F.array_sort(distinct)).alias("conflicting_ids"),
    )


def compare_identity(institution, brand, footer, logo_similarity) -> Column:
    """Strong identity checks as one assessment; any conflict means the wrong identity."""
    sim = T._c(logo_similarity)
    logo = F.when(sim.isNull(), "inconclusive").when(sim >= 0.95, "agree").when(sim < 0.75, "conflict").otherwise("inconclusive")
    verdicts = F.array(T._c(institution), T._c(brand), T._c(footer), logo)
    return F.when(F.array_contains(verdicts, "conflict"), "wrong_identity").when(F.array_contains(verdicts, "agree"), "verified").otherwise("inconclusive")


def with_overrides(targets: DataFrame, resolved: DataFrame, overrides: DataFrame) -> DataFrame:
    """Targets (target_idx, url) whose url is in ``overrides(url, master_url)`` exactly take that
    page with high confidence; others keep what ``resolved`` has."""
    fixed = targets.join(small(overrides.select("url", F.col("master_url").alias("_fixed"))), "url", "left").select("target_idx", "_fixed")
    rows = resolved.join(fixed, "target_idx", "left")
    set_ = F.col("_fixed").isNotNull()
    return rows.select(
        "target_idx", F.when(set_, F.col("_fixed")).otherwise(F.col("master_url")).alias("master_url"),
        F.when(set_, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(set_, "success").otherwise(F.col("outcome")).alias("outcome"),
        F.when(set_, "override").otherwise("discovery").alias("method"),
    )


def specialization_fallback(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """For targets (target_idx, subject array) without an eligible candidate: pages whose
    specialization list (page_id, url, idx, entry) shares a token.  One url is taken with medium
    confidence, several are ambiguous; the first such entry of a page is its evidence."""
    probes = entries.withColumn("token", F.explode(F.array_distinct(T.tokens("entry"))))
    hits = targets.select("target_idx", F.explode("subject").alias("token")).join(probes, "token").groupBy("target_idx", "url").agg(F.min_by("entry", "idx").alias("term"))
    g = hits.groupBy("target_idx").agg(F.count("*").alias("n"), F.min(F.struct("url", "term")).alias("x"))
    one = F.col("n") == 1
    return targets.select("target_idx").join(g, "target_idx", "left").select(
        "target_idx", F.when(one, F.col("x.url")).alias("selected"), F.when(one, F.col("x.term")).alias("term"), F.when(one, "medium").alias("confidence"),
        F.when(F.col("n").isNull(), "authoritative_page_not_found").when(~one, "ambiguous_candidates").alias("failure_reason"),
    )


def match_stats(evaluations: DataFrame, target: str) -> DataFrame:
    """Per target how many candidates were seen, passed each gate, and the best score."""
    return evaluations.groupBy(target).agg(
        F.count("*").alias("candidates"), F.count_if("identity_ok").alias("identity_ok"), F.count_if(F.col("identity_ok") & F.col("program_ok")).alias("eligible"), F.max("score").alias("best")
    )
