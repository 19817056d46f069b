"""The report: field rows of every target, their summary, and the shapes readers ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import compare as C
from factweave.operators import windows as W
from factweave.sources.store import cut

# fixed values: the rows of a report in order
PRIMARY = ["Fee Structure", "Discount", "Eligibility", "Specializations", "Course Duration", "Course Curriculum", "Credits", "Others"]
SECONDARY = ["Accreditation", "Rankings & Accreditations"]
PLURAL = ["Specializations", "Credits", "Rankings & Accreditations"]
#: Facts come after all claims of a page, which are numbered from 0.
AFTER = 1 << 40
STATUS_RANK = {"MATCH": 0, "PARTIAL": 1, "NEEDS_REVIEW": 2, "UNMATCH": 3}


def _claims(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    return df.where(F.col("field_key") == field).select(*keys, "idx", "raw_value")


def _facts(df: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    return df.where(F.col("field").isin(list(fields)) & (F.col("value") != "")).select(*keys, "idx", "value")  # unread pictures have none


def _sub_facts(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    cols = [F.col(c).cast("string").alias(c) for c in ("name", "status", "master_value", "target_value", "note")]
    return df.select(*keys, F.lit(field).alias("field"), F.col("idx").cast("long").alias("idx"), *cols)


def _ordered(fees: DataFrame, keys: list[str]) -> DataFrame:
    names = [c[0] for c in C.FEE_COMPONENTS]
    idx = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("component"))
    return fees.select(*keys, idx.cast("int").alias("idx"), F.col("component").alias("name"), "status", "master_value", "target_value", F.lit(None).cast("string").alias("note"))


def reconcile_discounts(facts: DataFrame, target: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    """Where both sides name the same discount percentage, missing and unreadable amounts match."""
    from factweave.functions import values as V

    def first(df, name):
        rows = df.withColumn("p", V.discount_percentage("raw_value")).where("p is not null")
        return rows.groupBy(*keys).agg(F.min_by("p", "idx").alias(name))

    same = first(target, "tp").join(first(master, "mp"), keys).where("tp = mp").select(*keys, F.col("tp").alias("pct"))
    up = F.col("pct").isNotNull() & F.col("status").isin("target_missing", "needs_review")
    said = F.concat(F.regexp_replace(F.col("pct").cast("string"), r"\.0$", ""), F.lit("% discount confirmed"))
    return facts.join(same, keys, "left").select(
        *keys, "idx", "name", F.when(up, "match").otherwise(F.col("status")).alias("status"), "master_value",
        F.when(up, said).otherwise(F.col("target_value")).alias("target_value"), "note",
    )


def image_fees(fees: DataFrame, tf: DataFrame, mf: DataFrame, keys: list[str]) -> DataFrame:
    """The fee row of pairs that have no fee to compare, where a side's fees are a picture."""
    one = lambda f, s: C.image_fee_note(f, keys).select(*keys, F.col("note").alias(f"{s}_note"), F.col("value").alias(f"{s}_value"))
    both = one(tf, "t").join(one(mf, "m"), keys, "full_outer").join(fees.select(*keys).distinct(), keys, "left_anti")
    return both.select(
        *keys, F.lit("Fee Structure").alias("field"), F.lit("needs_review").alias("status"), F.col("m_value").alias("master_value"), F.col("t_value").alias("target_value"),
        F.concat_ws(" ", "t_note", "m_note").alias("notes"),
    )


def field_rows(tc: DataFrame, mc: DataFrame, tf: DataFrame, mf: DataFrame, pairs: DataFrame, keys: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """All ten rows of every pair: (keys, field, position, status, values, notes).

    ``tc``/``mc`` are claims (keys, field_key, idx, raw_value), ``tf``/``mf`` facts (keys, field,
    idx, value, source_type) of the target and its authoritative page; ``pairs`` has every key once.
    What was read off a picture without certainty (source type ``image_ocr``) is no fee.
    ``overrides`` (keys, component, amount, currency, raw_value) replace fees of authoritative pages.
    """
    on_fee = lambda c, f: _claims(c, keys, "feeCandidate").unionByName(
        _facts(f.where("source_type is null or source_type <> 'image_ocr'"), keys, "FEES").select(*keys, (F.col("idx") + F.lit(AFTER)).alias("idx"), F.col("value").alias("raw_value")))
    t_pool, m_pool = on_fee(tc, tf), on_fee(mc, mf)
    fees = _ordered(C.compare_fees(t_pool, m_pool, keys, overrides), keys).withColumn("idx", F.col("idx").cast("int"))
    fees = cut(fees.unionByName(C.emi_tenure(t_pool, m_pool, keys)))
    # all fields that are made of sub-facts form one relation, which is aggregated once
    parts = [
        _sub_facts(fees, keys, "Fee Structure"),
        _sub_facts(reconcile_discounts(fees.where(F.col("name").contains("After Discount")), t_pool, m_pool, keys), keys, "Discount"),
    ]
    rows = [image_fees(fees, tf, mf, keys)]
    text = lambda c, f: (
        _facts(f, keys, "ELIGIBILITY").select(*keys, "idx", "value", F.lit(0).alias("rank"))
        .unionByName(_claims(c, keys, "eligibility").select(*keys, "idx", F.col("raw_value").alias("value"), F.lit(1).alias("rank")))
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "value"))).alias("x"))
        .select(*keys, F.array_join(F.transform(F.filter("x", lambda v: v["rank"] == F.get(F.col("x"), F.lit(0))["rank"]), lambda v: v["value"]), " ").alias("text"))
    )
    both = text(tc, tf).withColumnRenamed("text", "t").join(text(mc, mf).withColumnRenamed("text", "m"), keys, "full_outer")
    both = cut(both)
    whole = both.where("t is not null and m is not null")
    needs = C.eligibility_sub_facts(whole, keys, "t", "m")
    plain = whole.join(needs.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0).alias("idx"), F.lit("Eligibility").alias("name"),
        F.when(T.semantic_value("t") == T.semantic_value("m"), "match").otherwise("needs_review").alias("status"), F.col("m").alias("master_value"), F.col("t").alias("target_value"),
        F.lit("Eligibility text differs and could not be read as requirements; review manually.").alias("note"),
    )
    one_side = both.where("t is null or m is null").select(
        *keys, F.lit("Eligibility").alias("field"), F.when(F.col("t").isNull(), "target_missing").otherwise("master_missing").alias("status"),
        F.col("m").alias("master_value"), F.col("t").alias("target_value"), F.lit(None).cast("string").alias("notes"),
    )
    parts += [_sub_facts(needs, keys, "Eligibility"), _sub_facts(plain, keys, "Eligibility")]
    rows.append(one_side)

    def set_field(field, t, m, stems, empty, note):
        """The difference of two lists; where only the target has one, its own status and note."""
        diff = C.set_diff(m, t, keys, stems).select(
            *keys, "idx", F.col("value").alias("name"), "status", F.col("value").alias("master_value"), "target_value", F.lit(None).cast("string").alias("note")
        )
        only_target = t.select(*keys).distinct().join(m.where(T.semantic_value("value") != "").select(*keys).distinct(), keys, "left_anti")
        none = F.lit(None).cast("string")
        free = only_target.select(*keys, F.lit(field).alias("field"), F.lit(empty).alias("status"), none.alias("master_value"), none.alias("target_value"), F.lit(note).alias("notes"))
        return _sub_facts(diff, keys, field), free

    t_spec, m_spec = _facts(tf, keys, "SPECIALIZATION"), _facts(mf, keys, "SPECIALIZATION")
    subjects = t_spec.select(*keys, "value").unionByName(m_spec.select(*keys, "value"))
    plan = lambda f: cut(C.keep_curriculum(_facts(f, keys, "CURRICULUM", "PROGRAM_STRUCTURE"), keys, subjects))
    for field, t, m, stems, empty, note in (
        ("Specializations", t_spec, m_spec, False, "not_applicable", "No specialization variant is involved."),
        ("Course Curriculum", plan(tf), plan(mf), True, "both_missing", "Course Curriculum not found on either page."),
    ):
        diff, free = set_field(field, t, m, stems, empty, note)
        parts.append(diff)
        rows.append(free)

    def scalar(field, key):
        from factweave.functions import values as V

        refined = F.coalesce(V.refine_duration("raw_value"), F.col("raw_value")) if key == "duration" else F.col("raw_value")
        side = lambda c: c.where(F.col("field_key") == key).withColumn("raw_value", refined)
        d = C.compare_fields(side(tc), side(mc), keys)
        status = F.when(F.col("status") == "mismatch", "changed").when(F.col("status") == "asset_missing", "target_missing").when(F.col("status") == "source_missing", "master_missing").otherwise(F.col("status"))
        return d.select(*keys, F.lit(field).alias("field"), status.alias("status"), "master_value", "target_value", F.when(status == "changed", f"{field} differs.").alias("notes"))

    rows += [scalar("Course Duration", "duration"), scalar("Credits", "credits")]
    parts.append(_sub_facts(C.compare_others(tc, mc, keys), keys, "Others"))

    def phrases(field, key, category, pattern, other):
        side = lambda c, f: C.fact_phrases(
            _claims(c, keys, key).unionByName(_facts(f, keys, category).select(*keys, (F.col("idx") + F.lit(AFTER)).alias("idx"), F.col("value").alias("raw_value"))), pattern, [other, *C.EXCLUDED]
        ).select(*keys, F.struct("idx", "part").alias("idx"), F.col("raw_value").alias("value"))
        d = C.list_status(C.list_diff(side(tc, tf), side(mc, mf), keys), keys)
        none = F.lit(None).cast("string")
        return d.select(*keys, F.lit(field).alias("field"), "status", none.alias("master_value"), none.alias("target_value"), none.alias("notes"))

    rows.append(phrases("Accreditation", "accreditationItem", "ACCREDITATION", C.ACCREDITATIONS, C.RANKINGS))
    rows.append(phrases("Rankings & Accreditations", "rankingItem", "RANKINGS", C.RANKINGS, C.ACCREDITATIONS))
    made = C.aggregate_sub_facts(reduce(DataFrame.unionByName, parts), [*keys, "field"]).select(*keys, "field", "status", "master_value", "target_value", "notes")
    found = reduce(DataFrame.unionByName, [made, *rows])
    defaults = {r[0]: r[1:] for r in [
        ("Fee Structure", "both_missing", "Fee Structure not found on either page."), ("Discount", "not_applicable", "No discount mentioned on either page."),
        ("Eligibility", "both_missing", "Eligibility not found on either page."), ("Specializations", "not_applicable", "No specialization variant is involved."),
        ("Course Duration", "both_missing", "Course Duration not found on either page."), ("Course Curriculum", "both_missing", "Course Curriculum not found on either page."),
        ("Credits", "both_missing", "Credits not found on either page."), ("Others", "match", "No additional comparable attributes found."),
        ("Accreditation", "both_missing", "Accreditation not found on either page."), ("Rankings & Accreditations", "both_missing", "Rankings & Accreditations not found on either page."),
    ]}
    every = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(i + 1).alias("position"), F.lit(defaults[f][0]).alias("d_status"), F.lit(defaults[f][1]).alias("d_note")) for i, f in enumerate([*PRIMARY, *SECONDARY])
    ]))
    grid = pairs.select(*keys, every.alias("e")).select(*keys, "e.*")
    status = F.coalesce("status", "d_status")
    matches = F.concat(F.col("field"), F.when(F.col("field").isin(PLURAL), " match").otherwise(" matches"), F.lit(" the authoritative page."))
    note = F.coalesce("notes", F.when(F.col("status").isNull(), F.col("d_note")), F.when(status == "match", matches), F.concat(F.col("field"), F.lit(" differs from the authoritative page.")))
    return grid.join(found, [*keys, "field"], "left").select(
        *keys, "field", "position", (F.col("position") > len(PRIMARY)).alias("secondary"), C.report_status(status).alias("status"),
        T.truncate_value("master_value").alias("master_value"), T.truncate_value("target_value").alias("target_value"), T.truncate_value(note, 300).alias("notes"),
    )


def wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, a status column per field, a dash for what is missing."""
    names = [*PRIMARY, *SECONDARY]
    w = rows.groupBy(*keys).pivot("field", names).agg(F.first("status"))
    return w.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit("—")).alias(n) for n in names])


# fixed values: the columns of an overview beside the ten statuses
FEES_SHOWN = ["Full Fee", "Semester Fee", "Annual/Yearly Fee", "Monthly EMI"]


def overview(rows: DataFrame, targets: DataFrame, fees: DataFrame, spelling: DataFrame, ts) -> DataFrame:
    """The overview of a run, a row per target (target_idx, url, program, institution, master_url,
    outcome): the target and its outcome, four fee statuses (``fees``: target_idx, name, status), the
    ten fields, the number of misspelt words and the first of them (``spelling``: target_idx, word, n),
    and the time; a dash for whatever is missing."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    fee = fees.where(F.col("name").isin(FEES_SHOWN)).groupBy("target_idx").pivot("name", FEES_SHOWN).agg(F.first(C.report_status("status")))
    words = misspelling_tip(spelling, "target_idx").select("target_idx", (F.size("words") + F.col("more")).alias("n_words"), F.array_join("words", ", ").alias("some"))
    out = targets.join(fee, "target_idx", "left").join(wide(rows, ["target_idx"]), "target_idx", "left").join(words, "target_idx", "left")
    return out.select(
        "target_idx", *[dash(c).alias(n) for c, n in (("url", "Target URL"), ("program", "Program"), ("institution", "Institution"), ("master_url", "Master URL"), ("outcome", "Outcome"))],
        *[dash(f"`{n}`").alias(n) for n in FEES_SHOWN], *[dash(f"`{n}`").alias(n) for n in [*PRIMARY, *SECONDARY]],
        F.coalesce("n_words", F.lit(0)).alias("Misspellings"), dash("some").alias("Misspelt Words"), T._c(ts).alias("Checked At"),
    )


# fixed values: outcomes as the report shows them
OUTCOMES = {
    "success": "Compared", "ambiguous_candidates": "Ambiguous", "authoritative_page_not_found": "Not found", "target_unreachable": "Target unreachable",
    "master_unreachable": "Master unreachable", "comparison_failed": "Comparison failed",
}


def shown(value, vocabulary: dict[str, str]) -> Column:
    """A status in the words of a vocabulary; unknown ones with blanks for underscores."""
    words = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.coalesce(F.try_element_at(words, T._c(value)), F.replace(T._c(value), F.lit("_"), F.lit(" ")))


def report_pages(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Every target (target_idx, outcome) with its rows in order, or why it has none."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "field", "status", "notes"))), lambda x: F.struct(x["field"], x["status"], x["notes"]))
    return targets.join(rows.groupBy("target_idx").agg(listed.alias("rows")), "target_idx", "left").select(
        "target_idx", "rows", F.when(F.col("rows").isNull(), shown("outcome", OUTCOMES)).alias("unavailable")
    )


def parse_targets(lists: DataFrame, text: str) -> DataFrame:
    """Targets (target_idx, url) of pasted lists: a line each, trimmed, blank ones left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(*[c for c in lists.columns if c != text], F.posexplode(lines).alias("target_idx", "url"))


def highlighted(excerpt, word: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of a word in an excerpt, whatever its case, between two marks."""
    from factweave.functions.patterns import literal

    return F.regexp_replace(T._c(excerpt), f"(?i)({literal(word)})", f"{before}$1{after}")


def changed_fields(claims: DataFrame, keys: list[str]) -> DataFrame:
    """How many compared fields (keys, field_key, status) differ; what is missing doesn't count."""
    return claims.groupBy(*keys).agg(F.count_if(F.col("status") == "mismatch").alias("n_changed"))


def natural_key(value) -> Column:
    """Case-insensitive, with numbers padded, so that 9 sorts before 10."""
    v = F.lower(T._c(value))
    cut = F.regexp_extract_all(v, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(cut, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def sorted_report(rows: DataFrame, by: str, idx: str, descending: bool = False, equals: dict[str, str] | None = None) -> DataFrame:
    """Filtered by exact statuses (``all`` filters nothing) and sorted by one column, index last;
    missing values come last ascending and first descending."""
    rows, key = _filtered(rows, by, equals)
    return rows.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), idx)


def report_positions(rows: DataFrame, by: str, idx: str, descending: bool = False, equals: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``sorted_report`` with their ``position``, from 1, to be paged through as a table."""
    rows, key = _filtered(rows, by, equals)
    return W.with_positions(rows.withColumn("_key", key), [F.col("_key").desc_nulls_first() if descending else F.col("_key").asc_nulls_last(), idx]).drop("_key")


def _filtered(rows: DataFrame, by: str, equals: dict[str, str] | None) -> tuple[DataFrame, Column]:
    for c, v in (equals or {}).items():
        if v != "all":
            rows = rows.where(F.col(c) == v)
    is_status = F.try_element_at(F.create_map(*[F.lit(x) for k, v in STATUS_RANK.items() for x in (k, str(v))]), F.col(by).cast("string"))
    key = F.coalesce(is_status, natural_key(F.col(by).cast("string")))
    return rows, key


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome of all targets (target_idx, outcome)."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count("*").alias("targets"), F.count_if(o == "success").alias("success"), F.count_if(o == "ambiguous_candidates").alias("ambiguous"),
        F.count_if(o == "authoritative_page_not_found").alias("not_found"), F.count_if(o.isin("target_unreachable", "master_unreachable")).alias("unreachable"),
        F.count_if(o == "comparison_failed").alias("failed"),
    )


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """The latest snapshot of a run out of its append-only log (keys, ts, target_idx, state)."""
    last = events.groupBy(*keys, "target_idx").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"))
    s = F.col("state")
    return last.groupBy(*keys).agg(
        F.count_if(s == "queued").alias("queued"), F.count_if(s == "processing").alias("processing"), F.count_if(~s.isin("queued", "processing")).alias("completed"), F.max("ts").alias("ts")
    )


def misspelling_tip(words: DataFrame, key: str, most: int = 15) -> DataFrame:
    """Per key the most frequent unknown words (word, n) and how many more there are."""
    by = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    r = words.withColumn("rank", F.row_number().over(by))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "word")))), lambda x: x["word"])
    return r.groupBy(key).agg(listed.alias("words"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
