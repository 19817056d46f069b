"""Recorded crawl inputs: fetch outcomes, robots rules, sitemaps, bounded walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import urls as U
from factweave.sources.store import cut, small


def fetch_outcome(status, content_type, body, url=None, hops=None) -> Column:
    """What a recorded fetch amounts to; NULL means success."""
    s, c, b = T._c(status), F.lower(F.coalesce(T._c(content_type), F.lit(""))), T._c(body)
    out = F
    if url is not None:
        out = out.when(~F.coalesce(T._c(url).rlike("^(?i)https?://[^/]"), F.lit(False)), "invalid_url")
    if hops is not None:
        out = out.when(T._c(hops) > 5, "too_many_redirects")
    return (
        out.when(s.isNull(), "unreachable").when(~s.between(200, 299), "http_error").when(~c.contains("text/html"), "non_html")
        .when(F.coalesce(F.trim(b), F.lit("")) == "", "empty_body")
    )


def parse_robots(files: DataFrame, key: str, text: str, agent: str = "*") -> DataFrame:
    """Rules (key, kind, path) for an agent.

    Lines are cut at comments; consecutive agents share a group until a rule appears, which a
    running sum over the starts of groups makes an island; groups that name the agent replace
    those of ``*``.
    """
    lines = files.select(F.col(key).alias("_key"), F.posexplode(F.split(text, r"\r?\n")).alias("_n", "_line"))
    cut = F.trim(F.regexp_replace("_line", r"#.*$", ""))
    lines = lines.withColumn("kind", F.lower(F.trim(F.regexp_extract(cut, r"^([^:]*):", 1)))).withColumn("path", F.trim(F.regexp_extract(cut, r"^[^:]*:(.*)$", 1)))
    is_agent = F.col("kind") == "user-agent"
    lines = lines.where(is_agent | (F.col("kind").isin("allow", "disallow") & (F.col("path") != "")))
    by = Window.partitionBy("_key").orderBy("_n")
    first = is_agent & F.coalesce(F.lag("kind").over(by) != "user-agent", F.lit(True))
    lines = lines.withColumn("_g", F.sum(first.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_g > 0")
    group = Window.partitionBy("_key", "_g")
    lines = lines.withColumn("_named", F.bool_or(is_agent & (F.lower("path") == agent.lower())).over(group))
    lines = lines.withColumn("_any", F.bool_or(is_agent & (F.col("path") == "*")).over(group))
    lines = lines.withColumn("_has", F.bool_or("_named").over(Window.partitionBy("_key")))
    return lines.where(~is_agent & F.when(F.col("_has"), F.col("_named")).otherwise(F.col("_any"))).select(F.col("_key").alias(key), "kind", "path")


def robots_allowed(urls: DataFrame, rules: DataFrame, keys: list[str], path: str, site: str | None = None) -> DataFrame:
    """The longest matching prefix decides; allow wins only if strictly longer; none: allowed.

    A path asks for its own prefixes by an equi-join, so rules are never compared one by one;
    only lengths that rules have are asked for.  With ``site``, a column of both sides, a site's rules
    judge its own urls alone.
    """
    at = [] if site is None else [site]
    rules = rules.select(*at, "kind", F.col("path").alias("prefix"), F.length("path").alias("len")).distinct()
    lengths = rules.select(*at, "len").distinct()
    longer = F.length(path) >= F.col("len")
    asked = urls.join(small(lengths), longer) if site is None else urls.join(small(lengths), site).where(longer)
    asked = asked.withColumn("prefix", F.substring(F.col(path), F.lit(1), F.col("len"))).drop("len")
    best = asked.join(small(rules), [*at, "prefix"]).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "allow", F.col("len"))).alias("allow"), F.max(F.when(F.col("kind") == "disallow", F.col("len"))).alias("disallow")
    )
    ok = F.col("disallow").isNull() | (F.coalesce("allow", F.lit(-1)) > F.col("disallow"))
    return urls.join(best, keys, "left").select(*keys, path, ok.alias("allowed"))


def sitemap_directives(text) -> Column:
    return F.transform(F.regexp_extract_all(T._c(text), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1), lambda x: F.trim(x))


def parse_sitemap(xml, most: int = 500) -> Column:
    """``struct(kind, locs, truncated)`` of a sitemap or sitemap index."""
    locs = F.transform(F.regexp_extract_all(T._c(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), T.decode_xml)
    kind = F.when(T._c(xml).rlike(r"(?i)<sitemapindex[\s>]"), "sitemapindex").otherwise("urlset")
    return F.struct(kind.alias("kind"), F.slice(locs, 1, most).alias("locs"), (F.size(locs) > most).alias("truncated"))


def walk(start: DataFrame, links: DataFrame, domain: str, depth: int = 2, most: int = 40) -> DataFrame:
    """Breadth-first over recorded ``links(from_url, to_url, idx)``: (url, level, idx) within a domain.

    One join per level; pages seen before are left out by an anti-join on the url key.  A level
    has ``most`` pages at most, which is the crawl's whole budget, taken in order."""
    found = start.select(F.col("url"), F.lit(0).alias("level"), F.col("idx").cast("long")).withColumn("key", U.url_key("url"))
    frontier = found
    for level in range(1, depth + 1):
        nxt = frontier.alias("f").join(links.alias("l"), F.col("f.url") == F.col("l.from_url")).select(
            F.col("l.to_url").alias("url"), F.lit(level).alias("level"), F.col("l.idx").cast("long").alias("idx")
        )
        nxt = nxt.where(U.within_domain("url", F.lit(domain))).withColumn("key", U.url_key("url"))
        nxt = nxt.groupBy("key").agg(F.min_by(F.struct("url", "level", "idx"), F.struct("idx", "url")).alias("x")).select("key", "x.*")
        nxt = nxt.join(found.select("key"), "key", "left_anti").orderBy("idx", "url").limit(most)
        found, frontier = found.unionByName(nxt), nxt
    return found.orderBy("level", "idx", "url").limit(most)


def walk_sitemaps(roots: DataFrame, files: DataFrame, domain: str, depth: int = 2) -> DataFrame:
    """Pages that sitemaps name: (url, method, idx), each url once, first named first.

    ``roots(url, idx)`` are read from ``files(url, body)``, and the sitemaps an index names in their
    turn, to ``depth`` levels, within ``domain``.  A page's place is that of its sitemap, then its own."""
    level = roots.where(U.within_domain("url", F.lit(domain))).select("url", F.array(F.col("idx").cast("long")).alias("at"))
    pages = None
    for _ in range(depth):
        read = level.join(files.select("url", parse_sitemap("body").alias("map")), "url").select(
            "at", F.col("map.kind").alias("kind"), F.posexplode("map.locs").alias("n", "url")
        ).withColumn("at", F.concat("at", F.array(F.col("n").cast("long"))))
        named = read.where("kind = 'urlset'").select("url", "at")
        pages = named if pages is None else pages.unionByName(named)
        level = read.where("kind = 'sitemapindex'").where(U.within_domain("url", F.lit(domain))).groupBy("url").agg(F.min("at").alias("at"))
    return frontier(pages.select("url", F.lit("sitemap").alias("method"), F.col("at").alias("idx")))


#: How a page was found, the surest way first.
METHODS = ["homepage", "navigation", "sitemap", "harvest"]


def frontier(found: DataFrame) -> DataFrame:
    """Candidates (url, method, idx) once per url key: the first method, then the first place."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    best = found.withColumn("key", U.url_key("url")).groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "idx", "url", "method")).alias("x"))
    return best.select("key", "x.url", "x.method", "x.idx")


def page_index(candidates: DataFrame, domain: str, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """``(index, unfetched)``: candidates (url, method, idx) within the domain that a crawl's budget
    of ``most`` pages takes, in order, and those it leaves for a top-up.  Every run reads one
    index; ``most`` is a feature of the crawl, so the rest is kept and not dropped."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    every = frontier(candidates.where(U.within_domain("url", F.lit(domain))))
    index = every.orderBy(rank, "idx", "url").limit(most)
    return index.orderBy("key"), every.join(index.select("key"), "key", "left_anti")


def crawl_sites(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame, files: DataFrame, links: DataFrame, depth: int = 2, map_depth: int = 2) -> DataFrame:
    """The page index of many sites in one crawl: (site, key, url, method, level, fetched).

    ``sites(site, homepage, budget)`` are domains; ``robots(site, body)`` their rules; ``sitemaps(site,
    url, idx)`` the sitemaps to start from, whose bodies are in ``files(url, body)``; ``links(from_url,
    to_url, idx, navigation)`` what recorded pages link to.  A site's home page, the navigation links
    on it, its sitemaps' pages and its other links are one frontier, once per url key, the surest way
    first.  Each level takes, site by site, what is left of the budget, in order, and the pages
    taken add their links to the next; keys seen before are left out by an anti-join.  What a site's
    own rules forbid is never a candidate; the rest comes back as not fetched, for a top-up.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    rules = parse_robots(robots, "site", "body")
    none = F.array().cast("array<bigint>")

    def fresh(found: DataFrame, seen: DataFrame | None, level: int) -> DataFrame:
        """Of found (site, url, method, at) those that may be crawled and are new, once per key."""
        rows = found.where(U.within_domain("url", F.col("site"))).withColumn("key", U.url_key("url"))
        best = rows.groupBy("site", "key").agg(F.min(F.struct(rank.alias("rank"), "at", "url", "method")).alias("x")).select("site", "key", "x.*")
        if seen is not None:
            best = best.join(seen.select("site", "key"), ["site", "key"], "left_anti")
        judged = robots_allowed(best.withColumn("path", F.concat(U.path("url"), F.lit(""))), rules, ["site", "key"], "path", "site").where("allowed")
        return best.join(judged.select("site", "key"), ["site", "key"]).withColumn("level", F.lit(level))

    def mapped() -> DataFrame:
        level, pages = sitemaps.select("site", "url", F.array(F.col("idx").cast("bigint")).alias("at")), None
        for _ in range(map_depth):
            read = level.where(U.within_domain("url", F.col("site"))).join(files.select("url", parse_sitemap("body").alias("map")), "url").select(
                "site", "at", F.col("map.kind").alias("kind"), F.posexplode("map.locs").alias("n", "url")
            ).withColumn("at", F.concat("at", F.array(F.col("n").cast("bigint"))))
            named = read.where("kind = 'urlset'").select("site", "url", F.lit("sitemap").alias("method"), "at")
            pages = named if pages is None else pages.unionByName(named)
            level = read.where("kind = 'sitemapindex'").groupBy("site", "url").agg(F.min("at").alias("at"))
        return pages

    def linked(pages: DataFrame, first: bool) -> DataFrame:
        """Links of pages (site, url, at): their place is the page's, then their own."""
        met = pages.withColumn("key", U.url_key("url")).select("site", "key", "at").join(links.withColumn("key", U.url_key("from_url")), "key")
        method = F.when(F.col("navigation"), "navigation").otherwise("harvest") if first else F.lit("harvest")
        return met.select("site", F.col("to_url").alias("url"), method.alias("method"), F.concat("at", F.array(F.col("idx").cast("bigint"))).alias("at"))

    def within_budget(rows: DataFrame, used: DataFrame | None) -> DataFrame:
        """``rows`` with ``fetched``: the first of each site that its budget has room for."""
        left = sites.select("site", "budget")
        if used is not None:
            left = left.join(used.where("fetched").groupBy("site").agg(F.count("*").alias("n")), "site", "left").select("site", (F.col("budget") - F.coalesce("n", F.lit(0))).alias("budget"))
        most = left.agg(F.max("budget")).first()[0] or 0
        by = Window.partitionBy("site").orderBy("rank", "at", "url")
        # a rank bounded by the largest budget: Spark keeps that many of a site in each task before it sorts them together
        taken = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most).join(small(left), "site").where("n <= budget")
        return rows.join(taken.select("site", "key", F.lit(True).alias("fetched")), ["site", "key"], "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))

    front = sites.select("site", F.col("homepage").alias("url"), F.lit("homepage").alias("method"), none.alias("at"))
    first = front.unionByName(mapped()).unionByName(linked(front, True))
    index = cut(within_budget(fresh(first, None, 1), None))
    newest = index
    for level in range(2, depth + 1):
        found = fresh(linked(newest.where("fetched and method <> 'homepage'"), False), index, level)
        newest = cut(within_budget(found, index))
        index = index.unionByName(newest)
    return index.select("site", "key", "url", "method", "level", "fetched")


def crawl_stats(log: DataFrame) -> DataFrame:
    """One row of counts out of a fetch log (url, method, failure): what a crawl met and why it failed."""
    failed = lambda *kinds: F.count_if(F.col("failure").isin(*kinds))
    return log.agg(
        F.count("*").alias("requested"), F.count_if(F.col("failure").isNull()).alias("fetched"),
        *[F.count_if(F.col("method") == m).alias(f"from_{m}") for m in METHODS],
        failed("resolved_ip_blocked", "redirect_target_blocked").alias("blocked"), failed("http_error").alias("http_errors"),
        failed("non_html", "empty_body").alias("unusable"), failed("unreachable", "dns_resolution_failed").alias("unreachable"),
        failed("too_many_redirects").alias("too_many_redirects"), failed("invalid_url", "body_too_large").alias("refused"),
    )


# fixed values: paths that hold no program pages
UNLIKELY = ["blog", "news", "press", "article", "insight", "resource"]


def top_up(targets: DataFrame, unfetched: DataFrame, most: int = 20) -> DataFrame:
    """Unfetched urls (url, idx) per target (target_idx, keywords), most keyword hits first, then in
    order; urls without a hit come last.

    A target takes ``most`` urls, so of those without a hit only the first ``most`` can be taken
    beside the first it has hits on: a list of one length for all targets, checked by its limit.
    """
    likely = unfetched.where(~F.lower(U.path("url")).rlike(r"(^|/)(" + "|".join(UNLIKELY) + r")s?(/|-|$)"))
    worded = likely.withColumn("token", F.explode(T.tokens("url")))  # a word of an address counts as often as it occurs
    asked = targets.select("target_idx", F.explode(F.array_distinct("keywords")).alias("token"))
    hits = asked.join(worded, "token").groupBy("target_idx", "url", "idx").agg(F.count("*").alias("hits"))
    by = Window.partitionBy("target_idx").orderBy(F.desc("hits"), "idx", "url")
    best = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("rank")
    # of any ``2 * most`` first urls a target has at most ``most`` among its best
    first = likely.select("url", "idx").orderBy("idx", "url").limit(2 * most).agg(F.collect_list(F.struct("url", "idx")).alias("x")).scalar()
    rest = targets.select("target_idx", F.explode(first).alias("f")).select("target_idx", "f.url", "f.idx").join(hits.select("target_idx", "url"), ["target_idx", "url"], "left_anti")
    every = best.unionByName(rest.withColumn("hits", F.lit(0).cast("long")))
    return every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("target_idx", "url", "idx", "hits", "rank")
