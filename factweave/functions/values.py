"""Comparable values out of claim text: durations in months, money, fees, eligibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import literal, p
from .text import _c, any_of, collapse_ws, let

MONEY = "decimal(18,2)"

# fixed values: months in a unit; currencies, their signs and digit grouping
UNITS = {"years?": 12, "months?": 1, "semesters?": 6}
CURRENCIES = {
    "INR": (["₹", "Rs.", "Rs", "INR"], "indian"),
    "USD": (["$", "USD"], "western"),
    "EUR": (["€", "EUR"], "western"),
    "GBP": (["£", "GBP"], "western"),
}
GROUPINGS = {"western": r"^\d{1,3}(,\d{3})+(\.\d+)?$", "indian": r"^\d{1,2}(,\d{2})*,\d{3}(\.\d+)?$"}
FIELD_TYPES = {"duration": "duration_months", "fees": "currency"}


def normalize_text(raw) -> Column:
    value = F.lower(collapse_ws(raw))
    return F.when(value == "", F.struct(F.lit("NOT_FOUND").alias("status"), F.lit(None).cast("string").alias("value"))).otherwise(
        F.struct(F.lit("NORMALIZED").alias("status"), value.alias("value"))
    )


def _times(months: int):
    return lambda x: x.cast("double") * months


def normalize_duration(raw) -> Column:
    """``struct(status, months)``: one distinct value, all number-unit pairs understood."""
    raw = _c(raw)
    hits = [
        F.transform(F.regexp_extract_all(raw, F.lit(p(rf"(\d+(?:\.\d+)?)\s*-?\s*{unit}\b", True)), 1), _times(months))
        for unit, months in UNITS.items()
    ]
    pairs = F.size(F.regexp_extract_all(raw, F.lit(p(r"(\d+(?:\.\d+)?\s*-?\s*[A-Za-z]+)")), 1))

    def judge(x: Column) -> Column:
        distinct = F.array_distinct(x["known"])
        status = (
            F.when(x["pairs"] == 0, "NOT_FOUND")
            .when(F.size(x["known"]) == 0, "UNSUPPORTED_FORMAT")
            .when((F.size(distinct) > 1) | (F.size(x["known"]) < x["pairs"]), "AMBIGUOUS")
            .otherwise("NORMALIZED")
        )
        return F.struct(status.alias("status"), F.when(status == "NORMALIZED", F.get(distinct, F.lit(0))).alias("months"))

    return let(judge, known=F.concat(*hits), pairs=pairs)


def normalize_currency(raw) -> Column:
    """``struct(status, amount, currency)``: exactly one currency, one distinct well-grouped amount."""
    raw = _c(raw)
    amounts = F.regexp_extract_all(raw, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)
    named = F.filter(
        F.array(*[F.when(any_sign(raw, signs), F.lit(code)) for code, (signs, _) in CURRENCIES.items()]), lambda c: c.isNotNull()
    )
    westerns = [c for c, (_, style) in CURRENCIES.items() if style == "western"]

    def read(x: Column) -> Column:
        code = F.get(x["named"], F.lit(0))
        grouped = lambda v: ~F.contains(v, F.lit(",")) | F.when(code.isin(westerns), v.rlike(GROUPINGS["western"])).otherwise(v.rlike(GROUPINGS["indian"]))
        good = F.array_distinct(F.transform(F.filter(x["amounts"], grouped), lambda v: F.regexp_replace(v, ",", "").cast("decimal(30,10)")))
        return F.struct(x["amounts"].alias("amounts"), x["named"].alias("named"), code.alias("code"), good.alias("good"))

    def judge(x: Column) -> Column:
        status = (
            F.when((F.size(x["amounts"]) == 0) & (F.size(x["named"]) == 0), "NOT_FOUND")
            .when(F.size(x["named"]) == 0, "UNSUPPORTED_FORMAT")
            .when(F.size(x["amounts"]) == 0, "NOT_FOUND")
            .when(F.size(x["named"]) > 1, "AMBIGUOUS")
            .when(F.size(x["good"]) == 0, "UNSUPPORTED_FORMAT")
            .when(F.size(x["good"]) > 1, "AMBIGUOUS")
            .otherwise("NORMALIZED")
        )
        ok = status == "NORMALIZED"
        return F.struct(status.alias("status"), F.when(ok, F.get(x["good"], F.lit(0)).cast(MONEY)).alias("amount"), F.when(ok, x["code"]).alias("currency"))

    return F.get(F.transform(F.array(let(read, amounts=amounts, named=named)), judge), F.lit(0))


def any_sign(raw, signs: list[str]) -> Column:
    edge = lambda c: r"\b" if c.isalpha() else ""
    return _c(raw).rlike(p("|".join(f"{edge(s[0])}{literal(s)}{edge(s[-1])}" for s in signs), True))


def normalize_claim(field_key, raw) -> Column:
    """The typed value of a claim: text unless its field is a duration or money."""
    field_key, raw = _c(field_key), _c(raw)
    kind = F.when(field_key == "duration", "duration_months").when(field_key == "fees", "currency").otherwise("text")
    # each reading is made only for its own kind
    text = F.when(kind == "text", normalize_text(raw))
    months = F.when(kind == "duration_months", normalize_duration(raw))
    money = F.when(kind == "currency", normalize_currency(raw))
    return let(lambda x: _typed(x["kind"], x["text"], x["months"], x["money"]), kind=kind, text=text, months=months, money=money)


def _typed(kind: Column, text: Column, months: Column, money: Column) -> Column:
    return F.struct(
        F.when(kind == "duration_months", months["status"]).when(kind == "currency", money["status"]).otherwise(text["status"]).alias("status"),
        kind.alias("type"),
        F.when(kind == "text", text["value"]).alias("norm_text"),
        F.when(kind == "duration_months", months["months"]).alias("norm_months"),
        F.when(kind == "currency", money["amount"]).alias("norm_amount"),
        F.when(kind == "currency", money["currency"]).alias("currency"),
    )


# fixed values: number words of durations
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def refine_duration(raw) -> Column:
    """The first ``number unit`` of a sentence as text, number words as digits."""
    pattern = p(rf"\b({'|'.join(NUMBER_WORDS)}|\d+(?:\.\d+)?)[\s-]*(years?|months?|semesters?)\b", True)
    number = F.lower(F.regexp_extract(_c(raw), pattern, 1))
    unit = F.lower(F.regexp_extract(_c(raw), pattern, 2))
    table = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i + 1))])
    plain = F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
    return F.when(unit != "", F.concat(F.coalesce(F.try_element_at(table, number), plain), F.lit(" "), unit))


def indian_grouping(n) -> Column:
    """Digits as 12,34,567."""
    return F.regexp_replace(_c(n).cast("string"), r"(?<=\d)(?=(\d\d)+\d$)", ",")


def expand_lakh_crore(v) -> Column:
    """``2.5 lakh`` becomes ₹2,50,000; a currency sign before it stays.

    The text is cut at each mention by a mark, each part's leading mention is multiplied out,
    and the parts are joined again, so everything stays in the JVM.
    """
    mention = r"(₹|Rs\.?|INR)?\s*(\d+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?)\b"
    mark = "\x02"
    cut = F.split(F.regexp_replace(_c(v), p(mention, True), f"{mark}$0"), mark)
    lead = p(f"^{mention}", True)

    def expand(part):
        number = F.regexp_extract(part, lead, 2)
        crore = F.lower(F.regexp_extract(part, lead, 3)).startswith("c")
        amount = F.floor(number.cast("decimal(20,6)") * F.when(crore, 10_000_000).otherwise(100_000) + F.lit(0.5).cast("decimal(2,1)")).cast("long")
        sign = F.regexp_extract(part, lead, 1)
        text = F.concat(F.when(sign == "", "₹").otherwise(sign), indian_grouping(amount))
        return F.when(number != "", F.concat(text, F.regexp_replace(part, lead, ""))).otherwise(part)

    return F.array_join(F.transform(cut, expand), "")


def split_amounts(v) -> Column:
    """A text with two currency signs or more, cut at each; else the text alone."""
    signs = "|".join((rf"\b{literal(s)}" if s[0].isalpha() else literal(s)) for signs, _ in CURRENCIES.values() for s in signs)
    marks = F.regexp_count(_c(v), F.lit(p(f"(?:{signs})", True)))
    parts = F.split(_c(v), p(f"(?={signs})", True))
    from_first = F.when(F.get(parts, F.lit(0)).rlike(p(f"^(?:{signs})", True)), parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))
    return F.when(marks >= 2, F.transform(F.filter(from_first, lambda x: x != ""), lambda x: F.trim(x))).otherwise(F.array(_c(v)))


# fixed values: words that tell kinds and periods of fees, in order of precedence
FEE_TYPES = [
    ("application", r"application\s*fee"),
    ("admission", r"admission\s*fee"),
    ("registration", r"registration\s*fee"),
    ("examination", r"exam(ination)?\s*fee"),
    ("other_charges", r"caution\s*deposit|mandatory\s*(additional\s*)?charges|other\s*(mandatory\s*)?charges|additional\s*charges"),
]
FEE_PERIODS = [
    ("semester", r"per[\s-]*semester|/\s*semester|semester[\s-]*wise|each\s*semester|semester\s*fee"),
    ("annual", r"per[\s-]*annum|per[\s-]*year|annual(ly)?|yearly"),
    ("monthly", r"\bemi\b|per[\s-]*month|monthly|installment|instalment|payment\s*plan"),
    (
        "total_program",
        r"total(\s*(program(me)?|course|fee))?|entire\s*program(me)?|full\s*(program(me)?|fee)|complete\s*program(me)?|whole\s*course|one[\s-]*time|programme\s*fee|program\s*fee|course\s*fee|tuition\s*fee",
    ),
]
DISCOUNT = r"\bdiscount(ed)?\b|\bconcession(al)?\b|\d+(?:\.\d+)?%\s*off\b|\beffective\b"


def _first(column: Column, table, otherwise: str) -> Column:
    out = F
    for name, pattern in table:
        out = out.when(column.rlike(p(pattern, True)), name)
    return out.otherwise(otherwise)


def classify_fee(v, role=None) -> Column:
    """``struct(fee_type, period, discounted)``; a structural role outweighs discount words."""
    v = _c(v)
    said = v.rlike(p(DISCOUNT, True))
    discounted = said if role is None else F.when(_c(role).isNotNull(), _c(role) == "discounted").otherwise(said)
    return F.struct(
        _first(v, FEE_TYPES, "tuition").alias("fee_type"), _first(v, FEE_PERIODS, "unspecified").alias("period"), discounted.alias("discounted")
    )


def discount_percentage(v) -> Column:
    number = F.regexp_extract(_c(v), p(r"(\d+(?:\.\d+)?)\s*%"), 1)
    return F.when(any_of(v, [r"\b(discount(ed)?|concession(al)?)\b"]) & (number != ""), number.try_cast("double"))


# fixed values: qualifications by group
QUALIFICATIONS = {
    "higher_secondary": [r"\b10\s*\+\s*2\b", r"\bhigher\s+secondary\b", r"\bsenior\s+secondary\b", r"\bclass\s*12\b", r"\b12th\b", r"\bintermediate\b"],
    "diploma": [r"\b10\s*\+\s*3\s+diploma\b", r"\bdiploma\b"],
    "bachelor": [r"\bgraduation\b", r"\bbachelor(?:'s|s'|’s|s’)", r"\bbachelor'?s?\s+degree\b", r"\bundergraduate\s+degree\b", r"\bgraduate\s+degree\b"],
    "master": [r"\bpost[\s-]?graduation\b", r"\bpostgraduate\s+degree\b", r"\bmaster'?s?\s+degree\b"],
}


def eligibility_facts(v) -> Column:
    """``struct(groups, percentage, recognized, experience_years)``."""
    v = _c(v)
    groups = F.filter(F.array(*[F.when(any_of(v, ps), F.lit(g)) for g, ps in QUALIFICATIONS.items()]), lambda x: x.isNotNull())
    number = lambda pattern: F.regexp_extract(v, p(pattern, True), 1).try_cast("double")
    return F.struct(
        groups.alias("groups"),
        number(r"(\d{1,3}(?:\.\d+)?)\s*%").alias("percentage"),
        any_of(v, [r"\brecognized\s+(university|institution|board|college)\b"]).alias("recognized"),
        number(r"(\d+(?:\.\d+)?)\s*\+?\s*years?\s*(?:of\s+)?(?:work\s+)?experience").alias("experience_years"),
    )


def currency_sign(code) -> Column:
    table = F.create_map(*[F.lit(x) for c, (signs, _) in CURRENCIES.items() for x in (c, signs[0])])
    return F.coalesce(F.try_element_at(table, _c(code)), F.concat(_c(code), F.lit(" ")))
