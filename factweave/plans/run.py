"""A whole run over a recorded crawl: parse once, resolve every target, compare, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import urls as U
from factweave.operators import report as P
from factweave.operators import resolve as R
from factweave.operators import understand as N
from factweave.operators import windows as W
from factweave.sources import crawl as S
from factweave.sources import html as H
from factweave.sources.store import cut, small


def parsed(pages: DataFrame) -> DataFrame:
    """The only Python stage of a run; persist it, since everything else reads it."""
    return H.parse_pages(pages)


def identities(pages: DataFrame) -> DataFrame:
    p = pages.withColumn("texts", N.search_texts(pages)).withColumn("d", N.degree_match(F.col("texts")))
    org = F.get(F.filter(F.transform("json_ld", lambda x: F.try_variant_get(F.try_parse_json(x), "$.name", "string")), lambda x: x.isNotNull()), F.lit(0))
    site = F.try_element_at("open_graph", F.lit("og:site_name"))
    p = p.withColumn("i", N.institution_match(F.col("title"), site, org, N.footer_name("footer_text")))
    own = F.coalesce("headings", F.array().cast("array<struct<idx:int,level:int,text:string>>"))
    program = F.when(F.col("d.degree").isNotNull(), N.program_text("title", own, "d.degree", R.STOPWORDS)).otherwise(N.subject_only_program(F.col("texts"), R.STOPWORDS))
    # headings of other offers say nothing about this page
    kept = W.skip_levels(own, N.cross_sell)
    return p.select(
        "page_id", "url", "title", F.transform(kept, lambda h: h["text"]).alias("headings"), F.col("d.degree").alias("degree"),
        program.alias("program"), F.col("d.confidence").alias("degree_confidence"), N.other_degrees(F.col("texts"), F.col("d.degree")).alias("other_degrees"), N.detect_logo()["url"].alias("logo"), F.concat_ws(" ", "d.alias", "d.degree").alias("exclude"), F.col("i.institution").alias("institution"),
        F.when(T.comparison_key(site) != T.comparison_key(F.col("i.institution")), site).alias("brand"), N.page_type(F.col("texts"), F.col("d")).alias("page_type"),
    )


def claims(pages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(page_id, field_key, idx, raw_value) of every page: all label dictionaries, credits, and what
    the page is taken to be.  Pairs of a label and the values after it count as texts of their own."""
    blocks = pages.select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.idx", "b.heading_context", "b.text", "b.struck")
    pairs = W.label_value_pairs(blocks, ["page_id"]).select("page_id", (F.col("idx") + F.lit(1 << 30)).cast("long").alias("idx"), "heading_context", "text")  # after all others
    blocks = blocks.select("page_id", F.col("idx").cast("long").alias("idx"), "heading_context", "text").unionByName(pairs)
    heads = pages.select("page_id", F.explode("headings").alias("h")).select("page_id", "h.idx", "h.text")
    single = N.labelled_claims(blocks, heads, "page_id", {**N.CLAIM_LABELS, **N.OTHER_LABELS})
    many = N.labelled_claims(blocks, heads, "page_id", N.ITEM_LABELS, multiple=True)
    credit = N.credits_claim(blocks, "page_id").withColumn("claim_idx", F.lit(0).cast("long"))
    guessed = N.guess_claims(identities(pages) if ids is None else ids, "page_id").withColumnRenamed("idx", "claim_idx")
    cols = ["page_id", "field_key", F.col("claim_idx").cast("long").alias("idx"), "raw_value"]
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (single, many, credit, guessed)])


def facts(pages: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(page_id, field, idx, value, source_type, confidence): what classified sections state, with
    the readings of their pictures (``ocr``: url, text, confidence) where there are any."""
    part = lambda name, *cols: pages.select("page_id", F.explode(name).alias("x")).select("page_id", *[f"x.{c}" for c in cols])
    rows = N.sections(
        part("blocks", "idx", "heading_context", "text"), part("headings", "idx", "level", "text"), "page_id",
        part("tables", "idx", "heading_context", "headers", "rows"), part("images", "idx", "heading_context", "url"),
    )
    found = N.section_facts(N.classify_sections(rows, "heading", "paragraphs", "items", "table_headers"), "page_id")
    found = found if ocr is None else N.read_images(found, ocr)
    order = Window.partitionBy("page_id", "field").orderBy("h_idx", "i")
    return found.select("page_id", "field", (F.row_number().over(order) - 1).cast("long").alias("idx"), "value", "source_type", "confidence")


def subject_of(ids: DataFrame) -> DataFrame:
    """``ids`` with the words of a page's subject, without those of its degree and institution."""
    return ids.withColumn("subject", R.subject_tokens("program", F.concat_ws(" ", "exclude", "institution", "brand")))


def resolve(
    ids: DataFrame, targets: DataFrame, domain: str, homepage: str | None = None, index: DataFrame | None = None, extra: DataFrame | None = None
) -> DataFrame:
    """Each target (target_idx, url) with its authoritative page within ``domain``, or why none.
    With ``index`` (page_id) only its pages are candidates, and for one target those of
    ``extra`` (t_page_id, c_page_id).

    No pair is made that couldn't be chosen.  A target with a subject only passes the program
    gate with pages that share a token of it, so those tokens are the probes.  One without passes
    with any page; but a page that counts has its degree, program or institution in common, or
    else a word of these in its address, so these are.
    """
    blank = F.lit("")
    name = F.coalesce("institution", "brand")
    words = F.concat_ws(" ", "title", F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " "), "program")
    exclude = F.concat_ws(" ", "exclude", "institution", "brand")
    told = lambda tag, c: F.when(T.comparison_key(c) != "", F.concat(F.lit(tag), T.comparison_key(c)))
    keys = F.array_compact(F.array(told("d:", F.coalesce("degree", blank)), told("p:", F.coalesce("program", blank)), told("i:", F.coalesce(name, blank))))
    marked = lambda tag, toks: F.transform(toks, lambda x: F.concat(F.lit(tag), x))
    keyed = subject_of(ids.withColumn("key", U.url_key("url"))).withColumn("own", R.subject_tokens(words, exclude))
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in [*ids.columns, "subject", "own"]])
    probes = lambda df, s, x: df.select(F.col("page_id").alias(f"{s}_page_id"), F.explode(F.array_distinct(x)).alias("probe"))
    known = marked("u:", T.tokens(F.concat_ws(" ", "degree", "program", name)))
    asked = F.when(F.size("subject") > 0, marked("s:", F.col("subject"))).otherwise(F.concat(keys, known))
    offered = F.concat(keys, marked("u:", T.tokens("url")), marked("s:", F.col("own")))
    t = keyed.join(targets.select(U.url_key("url").alias("key")).distinct(), "key", "left_semi")
    c = keyed.where(U.within_domain("url", F.lit(domain)))
    # ids meet first; what is compared is fetched for distinct pairs
    met = probes(t, "t", asked).join(probes(c, "c", offered), "probe").where("t_page_id <> c_page_id").select("t_page_id", "c_page_id").distinct()
    if index is not None:
        shared = met.join(index.select(F.col("page_id").alias("c_page_id")), "c_page_id", "left_semi")
        met = shared if extra is None else shared.unionByName(met.join(extra, ["t_page_id", "c_page_id"], "left_semi")).distinct()
    pairs = met.join(side(t, "t"), "t_page_id").join(side(c, "c"), "c_page_id")
    verdict = R.text_verdict(F.coalesce("t_institution", "t_brand"), F.coalesce("c_institution", "c_brand"))
    gated = pairs.where(R.institution_gate(verdict, F.lit("inconclusive")) & R.program_gate(F.col("t_subject"), F.col("c_own")))
    chosen = R.select_page(R.score(gated, homepage), "t_page_id", "c_page_id", "c_page_id")
    where = targets.select("target_idx", U.url_key("url").alias("key")).join(ids.select(F.col("page_id").alias("t_page_id"), U.url_key("url").alias("key")), "key", "left")
    return where.join(chosen, "t_page_id", "left").select(
        "target_idx", F.col("t_page_id").alias("target_page"), F.col("selected").alias("master_page"), "confidence", "top_score",
        F.when(F.col("t_page_id").isNull(), "target_unreachable").when(F.col("selected").isNotNull(), "success")
        .otherwise(F.coalesce("failure_reason", F.lit("authoritative_page_not_found"))).alias("outcome"),
    )


@dataclass(frozen=True)
class Registry:
    """What is known of institutions beforehand: ``names(institution_id, name)``, ``sources(source_id,
    institution_id, host)``, ``aliases(alias, institution_id)``, ``programs(alias, source_id)`` and
    ``pages(source_id, url, program)``; ``svg(url, text)`` are texts inside logos."""

    names: DataFrame
    sources: DataFrame
    aliases: DataFrame
    programs: DataFrame
    pages: DataFrame
    svg: DataFrame


def fetch_new(wanted: DataFrame, parsed_keys: DataFrame | None, store: DataFrame) -> DataFrame:
    """Of the url keys (key) that are wanted, each one not parsed before, parsed once however often it
    is asked for.  ``store(page_id, url, final_url, html)`` are the recorded answers; of several
    with one key the first counts."""
    keys = wanted.select("key").where("key is not null").distinct()
    if parsed_keys is not None:
        keys = keys.join(parsed_keys.select("key"), "key", "left_anti")
    keyed = store.withColumn("key", U.url_key("url"))
    first = keyed.join(keys, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("page_id", "url", "final_url", "html"), "page_id").alias("x"))
    pages = first.select("x.page_id", "x.url", "x.html", "key", "x.final_url")
    found = parsed(pages.select("page_id", "url", "html"))
    return found.join(pages.select("page_id", "key", "final_url"), "page_id")


def two_pass(
    store: DataFrame, targets: DataFrame, candidates: DataFrame, domain: str, homepage: str, budget: int, overrides: DataFrame, registry: Registry, most: int = 20
) -> DataFrame:
    """Every target (target_idx, url) resolved over an index that grows by what its targets need.

    1. The index takes ``budget`` of the ``candidates`` (url, method, idx); its pages, the targets and
       the pages of ``overrides`` (url, master_url) are parsed, each url key once.
    2. Every target is resolved against the index.
    3. Those left unresolved, or resolved to a page of another degree than they surely have, each
       ask for ``most`` of the urls that the budget left; of these, keys that aren't in the
       index are parsed, once for all targets, and appended.  These targets alone are resolved
       again, against the index and what they asked for.
    4. A target without any eligible page may be named by one page's list of specializations.
    5. An override comes before a conflict of the target's own identity, that before the registry,
       that before what was found.  A target that leads to the home page has no page, and one
       that had no page and took all it could ask for has run out of budget.

    ``(target_idx, outcome, master_page, master_url, confidence, method, times_parsed)``.
    """
    keyed = lambda df, c: df.withColumn("key", U.url_key(c))
    index, unfetched = S.page_index(candidates, domain, budget)
    index = cut(index.select("key"))
    asked_first = reduce(DataFrame.unionByName, [index, keyed(targets, "url").select("key"), keyed(overrides, "master_url").select("key"), keyed(registry.pages, "url").select("key")])
    pages = cut(fetch_new(asked_first, None, store))
    ids = cut(identities(pages).join(pages.select("page_id", "key", "final_url"), "page_id"))
    known = ids.select("key", "page_id")
    in_index = known.join(index, "key", "left_semi").select("page_id")
    own = [c for c in ids.columns if c not in ("key", "final_url")]

    # reachable targets that are pages of their own
    asked = keyed(targets, "url").select("target_idx", "url", "key")
    there = asked.join(ids.select("key", F.col("page_id").alias("t_page_id"), "final_url", "degree", "degree_confidence", "institution", "program", "exclude", "brand"), "key", "left")
    there = cut(subject_of(there.withColumn("home", R.to_homepage("url", "final_url", F.lit(homepage)))))
    real = there.where("t_page_id is not null and not home")

    first = cut(resolve(ids.select(own), real.select("target_idx", "url"), domain, homepage, in_index))
    degree = ids.select(F.col("page_id").alias("master_page"), F.col("degree").alias("m_degree"))
    rest = first.join(degree, "master_page", "left").join(real.select("target_idx", "url", "t_page_id", "subject", F.col("degree").alias("t_degree"), "degree_confidence"), "target_idx")
    rest = cut(rest.where(R.needs_top_up("outcome", "t_degree", "degree_confidence", "m_degree") & (F.size("subject") > 0)).select("target_idx", "url", "t_page_id", "subject"))

    more = cut(S.top_up(rest.select("target_idx", F.col("subject").alias("keywords")), unfetched.select("url", "idx"), most).select("target_idx", "url", U.url_key("url").alias("key")))
    added = cut(fetch_new(more, known, store))
    every = ids.select(own).unionByName(identities(added).select(own))
    pairs = more.join(added.select("key", F.col("page_id").alias("c_page_id")).unionByName(known.withColumnRenamed("page_id", "c_page_id")), "key")
    pairs = pairs.join(rest.select("target_idx", "t_page_id"), "target_idx").select("t_page_id", "c_page_id").distinct()
    second = resolve(every, rest.select("target_idx", "url"), domain, homepage, in_index, pairs)
    took = more.groupBy("target_idx").agg(F.count("*").alias("took"))
    both = first.join(second.select("target_idx", *[F.col(c).alias(f"second_{c}") for c in ("master_page", "confidence", "outcome", "top_score")]), "target_idx", "left").join(took, "target_idx", "left")
    again = F.col("second_master_page").isNotNull()
    pick = lambda c: F.when(again, F.col(f"second_{c}")).otherwise(F.col(c))
    found = cut(both.select(
        "target_idx", pick("master_page").alias("master_page"), pick("confidence").alias("confidence"), pick("outcome").alias("outcome"),
        F.when(again & ~F.col("master_page").eqNullSafe(F.col("second_master_page")), "top_up").otherwise("index").alias("how"),
        (F.coalesce("took", F.lit(0)) >= most).alias("spent"), (F.col("top_score").isNull() & F.col("second_top_score").isNull()).alias("no_candidate"),
    ))

    # lists of specializations, for targets that no page is eligible for
    lists = facts(pages.join(in_index, "page_id", "left_semi").drop("key", "final_url")).where("field = 'SPECIALIZATION'")
    entries = lists.join(ids.select("page_id", "url"), "page_id").select("page_id", "url", "idx", F.col("value").alias("entry"))
    lost = found.where("no_candidate").join(real.select("target_idx", "subject"), "target_idx").select("target_idx", "subject")
    listed = R.specialization_fallback(lost, entries).where("selected is not null").select("target_idx", F.col("selected").alias("listed_url"))
    urls = ids.select("page_id", "url").unionByName(added.select("page_id", "url"))
    found = found.join(urls.withColumnRenamed("page_id", "master_page").withColumnRenamed("url", "master_url"), "master_page", "left").join(listed, "target_idx", "left")
    fell = F.col("listed_url").isNotNull()
    found = found.select(
        "target_idx", F.when(fell, F.col("listed_url")).otherwise(F.col("master_url")).alias("master_url"), F.when(fell, "medium").otherwise(F.col("confidence")).alias("confidence"),
        F.when(fell, "success").otherwise(R.exhausted("outcome", F.col("spent"))).alias("outcome"), F.when(fell, "specialization").otherwise(F.col("how")).alias("how"),
    )

    # who the target is by its own evidence, and the page its registered source names
    said = pages.select("page_id", "url", F.transform("logos", lambda x: F.struct(x["url"].alias("url"), x["alt"].alias("alt"))).alias("logos")).join(ids.select("page_id", "institution", "brand"), "page_id")
    who = R.target_identity(said.join(real.select(F.col("t_page_id").alias("page_id")), "page_id", "left_semi"), registry.names, registry.svg)
    who = real.join(who.select(F.col("page_id").alias("t_page_id"), "identity"), "t_page_id").select("target_idx", "identity")
    sourced = R.resolve_source(real.select(F.col("target_idx").alias("idx"), F.lit(homepage).alias("url"), "institution", "program"), registry.sources, registry.aliases, registry.programs)
    primary = R.discover_pages(sourced, registry.pages).join(real.select(F.col("target_idx").alias("idx"), F.col("program").alias("t_program")), "idx")
    primary = primary.where(T.comparison_key("program") == T.comparison_key("t_program")).groupBy("idx", "source_id").agg(F.min("url").alias("master_url"))
    primary = primary.join(small(registry.sources.select("source_id", "institution_id")), "source_id").join(who.withColumnRenamed("target_idx", "idx"), "idx")
    trusted = primary.select(F.col("idx").alias("target_idx"), "master_url", F.coalesce(F.col("identity.institution_id") == F.col("institution_id"), F.lit(False)).alias("identity_ok"))
    torn = who.where("identity.method = 'conflict'").select("target_idx")

    decided = R.precedence(real.select("target_idx", "url"), overrides, torn, trusted, found)
    decided = decided.join(found.select("target_idx", "how"), "target_idx", "left").select(
        "target_idx", "master_url", "confidence", F.when(F.col("method") == "identity", "ambiguous_candidates").otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("outcome") == "success", F.when(F.col("method") == "discovery", F.col("how")).otherwise(F.col("method"))).alias("method"),
    )
    log = known.unionByName(added.select("key", "page_id")).groupBy("key").agg(F.count("*").alias("times_parsed"), F.min("page_id").alias("master_page"))
    chosen = keyed(decided, "master_url").join(log, "key", "left").drop("key")
    none = F.when(F.col("t_page_id").isNull(), "target_unreachable").otherwise("authoritative_page_not_found")
    return there.select("target_idx", "t_page_id").join(chosen, "target_idx", "left").select(
        "target_idx", F.coalesce("outcome", none).alias("outcome"), "master_page", "master_url", "confidence", "method", "times_parsed"
    )


def report(pages: DataFrame, resolved: DataFrame, ids: DataFrame | None = None, overrides: DataFrame | None = None, ocr: DataFrame | None = None) -> DataFrame:
    """The report rows of every target that has an authoritative page.

    ``overrides`` (page_id, component, amount, currency, raw_value) are fees of authoritative pages
    known for sure, ``ocr`` readings of pictures.  What pages say is one relation, which is dealt by
    target once; every field groups and joins it where it lies."""
    pairs = resolved.where("outcome = 'success'").select("target_idx", F.explode(F.array(
        F.struct(F.lit("t").alias("side"), F.col("target_page").alias("page_id")), F.struct(F.lit("m").alias("side"), F.col("master_page").alias("page_id")),
    )).alias("p")).select("target_idx", "p.*")
    none = F.lit(None).cast("string")
    said = claims(pages, ids).select("page_id", F.lit("claim").alias("kind"), F.col("field_key").alias("field"), "idx", F.col("raw_value").alias("value"), none.alias("source_type"))
    found = facts(pages, ocr).select("page_id", F.lit("fact").alias("kind"), "field", "idx", "value", F.when((F.col("source_type") == "image_ocr") & (F.col("confidence") == "HIGH"), "image_read").otherwise(F.col("source_type")).alias("source_type"))
    dealt = lambda df: cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target_idx"))
    told = dealt(pairs.join(said.unionByName(found), "page_id").drop("page_id"))
    side = lambda s, kind: told.where((F.col("side") == s) & (F.col("kind") == kind))
    claimed = lambda s: side(s, "claim").select("target_idx", F.col("field").alias("field_key"), "idx", F.col("value").alias("raw_value"))
    stated = lambda s: side(s, "fact").select("target_idx", "field", "idx", "value", "source_type")
    known = None if overrides is None else pairs.where("side = 'm'").join(small(overrides), "page_id").drop("page_id", "side")
    return P.field_rows(claimed("t"), claimed("m"), stated("t"), stated("m"), dealt(pairs.where("side = 't'").select("target_idx")), ["target_idx"], known)


def write_report(rows: DataFrame, path: str) -> None:
    """The two relations of an export: overview and field details."""
    P.wide(rows, ["target_idx"]).write.mode("overwrite").option("header", True).csv(f"{path}/overview")
    rows.write.mode("overwrite").json(f"{path}/fields")
