"""Text functions as Column expressions: keys, tokens, labels, lists, display."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WS, any_pattern, literal, p


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(column, patterns, fold: bool = True) -> Column:
    """Whether any of the patterns is found; NULL counts as not found."""
    return F.coalesce(_c(column).rlike(any_pattern(list(patterns), fold)), F.lit(False))


def let(body, **values: Column) -> Column:
    """``body`` of a struct of the values, each worked out once however often it is used."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


# white space; letters, digits and other plain characters are ruled out by the first range
_SPACE = f"[\\x00-\\x20\\x80-\\uFFFF&&{WS}]"


def collapse_ws(v) -> Column:
    return F.trim(F.regexp_replace(_c(v), f"{_SPACE}+", " "))


def comparison_key(v) -> Column:
    return F.lower(collapse_ws(v))


def word_bounded(haystack, needle: str) -> Column:
    """Case-insensitive containment between characters that are no letters or digits."""
    return _c(haystack).rlike(f"(?i)(?<![a-z0-9]){literal(needle)}(?![a-z0-9])")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def phrases_in(text, phrases: list[str]) -> Column:
    """The distinct ones of ``phrases`` (lower case) that ``word_bounded`` finds in a text, in one pass:
    at each word the runs of one word, two and so on, to as many as the longest phrase has, with what
    is between them, are looked up in a set of all phrases."""
    longest = max(len(re.findall("[a-z0-9]+", x)) for x in phrases)
    low = F.translate(F.coalesce(_c(text), F.lit("")), _UPPER, _UPPER.lower())

    def look(x: Column) -> Column:
        words, pieces = x["words"], x["pieces"]  # a piece is a word and what follows it
        runs, heads = [words], pieces
        for n in range(2, longest + 1):
            rest = lambda c: F.slice(c, F.lit(n), F.size(c))  # noqa: E731, B023
            runs.append(F.zip_with(heads, rest(words), lambda h, w: F.concat(h, w)))
            heads = F.zip_with(heads, rest(pieces), lambda h, w: F.concat(h, w))
        return F.array_distinct(F.filter(F.concat(*runs), lambda r: r.isin(phrases)))

    return let(look, words=F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1), pieces=F.regexp_extract_all(low, F.lit("([a-z0-9]+[^a-z0-9]*)"), 1))


def word_count(v) -> Column:
    return F.regexp_count(_c(v), F.lit(f"[^{WS[1:-1]}]+"))


# fixed values: bullets and boilerplate endings of list items
_BULLETS = "•◦▪➤●○*\\-–—"
_BULLET = "[\\x00-\\x20*\\-\\x80-\\uFFFF&&" + p(f"[\\s{_BULLETS}]") + "]"
_ENDINGS = [r"\s*\(optional\)\s*$", r"\s*specialization\s*$", r"\s*specialisation\s*$", r"\s*elective\s*$", r"\s*track\s*$"]


def _without(value: Column, ending: str) -> Column:
    """The value without an ending, unless nothing else would be left; worked out once."""
    def choose(x: Column) -> Column:
        cut = F.regexp_replace(x["v"], ending, "")
        return F.when(collapse_ws(cut) != "", cut).otherwise(x["v"])

    return let(choose, v=value)


# the words that each of the endings above has at its end
_LAST_WORDS = ["optional", "specialization", "specialisation", "elective", "track"]
# words of characters without meaning here, single blanks between them, a letter or digit at either end
_PLAIN = "^(?=[0-9A-Za-z\\xC0-\\u0233])[ -%'-~\\xA1-\\u167F]++(?<=[0-9A-Za-z\\xC0-\\u0233])$"
#: What is in every text with a line that ``plain_item`` rules out.
ODD_ITEMS = f"(?iu)&|{'|'.join(_LAST_WORDS)}"


def semantic_value(v) -> Column:
    """A list item without bullets, boilerplate ending and trailing punctuation, lower-cased.
    An ending stays where nothing else would.  Words of plain characters with a blank between,
    without an ending, stay as they are."""
    def named(x: Column) -> Column:
        return F.when(F.contains(x["v"], F.lit("&")), F.regexp_replace(x["v"], p(r"\s*&\s*"), " and ")).otherwise(x["v"])

    ends = lambda c: reduce(lambda a, b: a | b, [F.endswith(c, F.lit(w)) for w in [*_LAST_WORDS[1:], "optional)"]])

    def ended(x: Column) -> Column:
        out = x["v"]
        for ending in _ENDINGS:
            out = _without(out, p(ending, True))
        return F.when(ends(F.lower(F.right(x["v"], F.lit(20)))), out).otherwise(x["v"])

    def full(c: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(collapse_ws(c), f"^{_BULLET}+", ""), f"{_BULLET}++$", "")
        return F.lower(collapse_ws(F.regexp_replace(let(ended, v=let(named, v=out)), "[.,;:]+$", "")))

    return let(lambda x: F.when(x["v"].rlike(_PLAIN) & ~F.contains(x["v"], F.lit("  ")) & ~ends(x["low"]), x["low"]).otherwise(full(x["v"])), v=_c(v), low=F.lower(_c(v)))


def plain_item(v, words) -> Column:
    """Whether a text of these ``tokens`` has them in its ``semantic_value`` as well: it has no ampersand,
    which would be written out, and no ending that might go."""
    last = F.coalesce(F.try_element_at(_c(words), F.lit(-1)), F.lit(""))
    return ~F.contains(_c(v), F.lit("&")) & ~reduce(lambda a, b: a | b, [F.endswith(last, F.lit(w)) for w in _LAST_WORDS])


def strip_prefix(v, hint) -> Column:
    """``v`` without a leading ``hint`` and the blanks after it, whatever its case."""
    hint = collapse_ws(F.trim(_c(hint)))
    rest = F.substring(_c(v), F.length(hint) + 1, F.length(_c(v)))
    fits = (F.lower(F.substring(_c(v), F.lit(1), F.length(hint))) == F.lower(hint)) & rest.rlike(f"^{WS}")
    return F.when(hint.isNotNull() & (hint != "") & fits, collapse_ws(rest)).otherwise(_c(v))


# fixed values: groups of names of one concept
CONCEPTS = [
    ["hr", "hr management", "human resource", "human resources", "human resource management", "hrm"],
    ["it", "it management", "information technology"],
    ["ai", "artificial intelligence"],
    ["ml", "machine learning"],
    ["hrm and od", "human resource management and organizational development"],
]


def concept_key(v) -> Column:
    """The same key for values that are equal or name one concept, so concepts equi-join."""
    pairs = [F.lit(x) for i, group in enumerate(CONCEPTS) for name in group for x in (name, f"concept:{i}")]
    return let(lambda x: F.coalesce(F.try_element_at(F.create_map(*pairs), x["v"]), x["v"]), v=semantic_value(v))


def tokens(v, least: int = 3) -> Column:
    """Lower-case runs of a-z and 0-9 of at least ``least`` characters, repeats kept."""
    return F.regexp_extract_all(F.lower(_c(v)), F.lit(f"([a-z0-9]{{{least},}})"), 1)


def _share(a: Column, b: Column, num: int, den: int) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    low = F.least(F.size(a), F.size(b))
    return (low > 0) & (F.size(F.array_intersect(a, b)) * den >= low * num)


def tokens_overlap(a, b) -> Column:
    """Half of the smaller token set is shared."""
    return _share(tokens(a), tokens(b), 1, 2)


def stems(v) -> Column:
    return F.array_distinct(F.transform(tokens(v), lambda x: F.left(x, F.lit(5))))


def stems_overlap(a, b) -> Column:
    """Three fifths of the smaller set of five-letter stems are shared."""
    return _share(stems(a), stems(b), 3, 5)


# fixed values: abbreviations of subjects
ABBREVIATIONS = {
    "ds": "Data Science",
    "lsc": "Logistics and Supply Chain Management",
    "lscm": "Logistics and Supply Chain Management",
    "hrm": "Human Resource Management",
    "hr": "Human Resource Management",
}


def expand_abbreviations(v) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    words = F.split(collapse_ws(v), " ")
    found = F.filter(F.transform(words, lambda w: F.try_element_at(table, F.lower(w))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.concat_ws(" ", _c(v), F.array_join(found, " "))).otherwise(_c(v))


# fixed values: phrases of page chrome
CHROME = [
    r"\bOTP\b", r"\d\s*[-\s]?digit\s*(otp|code|pin)\b", r"\bCVV\b", r"\bcaptcha\b", r"\b(log[\s-]?in|sign[\s-]?in|sign[\s-]?up)\b",
    r"\bforgot\s*(your\s*)?password\b", r"\bcookie(s)?\s*(policy|consent|preferences)\b", r"\bprivacy\s*policy\b",
    r"\bterms\s*(and|&)\s*conditions\b", r"\badd\s*to\s*cart\b", r"\bcheckout\b", r"\bsubscribe\s*to\s*(our\s*)?newsletter\b",
    r"\bclick\s*here\b", r"\bsession\s*(has\s*)?expired\b", r"\bplease\s*wait\b", r"\bpage\s*not\s*found\b", r"\baadhaar\b",
    r"\bdate\s*of\s*birth\b", r"\bmobile\s*number\b", r"\broll\s*number\b", r"\bread\s*more\b", r"\bview\s*more\b", r"\bsee\s*more\b",
    r"^advantages$", r"\bugc-entitled\s*degrees\b", r"\bwebinars\s*(&|and)?\s*simulations\b", r"\battend\s*webinars\s*by\s*industry\s*experts\b",
    r"\bscholarships?\s*up\s*to\s*\d+%", r"\bavail\s*scholarship\s*benefits\s*under\s*merit\b",
    r"\b(reputed|prestigious)\s*(\w+\s*)?alumni\s*(status|network)\b", r"\byears?\s*of\s*\w*\s*legacy\b",
]


def is_chrome(v) -> Column:
    return any_of(v, CHROME)


def truncate_value(v, most: int = 100) -> Column:
    v = F.regexp_replace(_c(v), f"^{WS}+|{WS}+$", "")
    return F.when(F.length(v) <= most, v).otherwise(
        F.concat(F.regexp_replace(F.substring(v, 1, most - 1), f"{WS}+$", ""), F.lit("…"))
    )


def summarize_names(names, most: int = 3) -> Column:
    names = _c(names)
    more = F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(", and "), (F.size(names) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(more)


def join_clauses(parts, most: int = 3) -> Column:
    parts = _c(parts)
    rest = F.size(parts) - most
    more = F.concat(
        F.array_join(F.slice(parts, 1, most), " "), F.lit(" (+"), rest.cast("string"), F.lit(" more difference"),
        F.when(rest == 1, "").otherwise("s"), F.lit(".)"),
    )
    return F.when(F.size(parts) <= most, F.array_join(parts, " ")).otherwise(more)


# fixed values: words of a label that need not be repeated
_LABEL_FILLERS = ["after", "the", "for", "of", "in", "on", "and"]


def labelled(name, value) -> Column:
    """``name: value``, or the value alone where it has all words of the name."""
    words = F.filter(F.split(F.lower(_c(name)), r"[ /()]+"), lambda w: (w != "") & ~w.isin(_LABEL_FILLERS))
    low = F.lower(_c(value))
    there = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w))
    return F.when(there, _c(value)).otherwise(F.concat(_c(name), F.lit(": "), _c(value)))


def value_shaped(v) -> Column:
    """Nothing but numbers, units and currencies: no run of three letters is left without them."""
    rest = F.regexp_replace(_c(v), r"(?i)\d[\d,.]*", " ")
    rest = F.regexp_replace(
        rest, p(r"\b(inr|usd|eur|gbp|rs|lakhs?|lacs?|crores?|years?|months?|semesters?|weeks?|days?|hours?|hrs?|per|annum|credits?)\b", True), " "
    )
    return (F.length(collapse_ws(_c(v))) > 0) & ~rest.rlike("[A-Za-z]{3,}")


def short_label(v) -> Column:
    return ~_c(v).rlike("[0-9]") & F.size(F.filter(F.split(collapse_ws(v), " "), lambda w: w != "")).between(1, 6)


def named_offering(v) -> Column:
    """Starts with a capital, at most six words, no digit, colon, percent or currency sign."""
    return _c(v).rlike("^[A-Z]") & (F.size(F.split(collapse_ws(v), " ")) <= 6) & ~_c(v).rlike("[0-9:%₹$€£]")


def numbers_differ(a, b) -> Column:
    """Both name numbers, and not the same ones."""
    x, y = (F.array_sort(F.regexp_extract_all(_c(v), F.lit(r"(\d+(?:\.\d+)?)"), 1)) for v in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def has_negation(v) -> Column:
    return any_of(v, [r"\b(not|no|without|doesn't|does not|excluded|except)\b"])


def filename_tokens(url) -> Column:
    name = F.regexp_extract(F.regexp_replace(_c(url), r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")), "[^a-z0-9]+"), lambda t: t != "")


def decode_xml(v) -> Column:
    """The five entities; the ampersand comes first, so ``&amp;lt;`` is decoded twice."""
    steps = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, _c(v))
