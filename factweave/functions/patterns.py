"""Regular expressions that mean the same here as in the pages' own world of browsers.

``\\s`` there covers Unicode spaces and ``\\b`` is about ASCII words; the JVM's defaults differ,
so both are spelled out before a pattern reaches Spark.
"""

from __future__ import annotations

import re

WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def p(pattern: str, fold: bool = False) -> str:
    """``pattern`` with ``\\s`` and ``\\b`` made explicit; ``fold`` ignores case.  Where a ``\\b``
    opens or closes an alternative beside a word character, one look is enough."""
    out = re.sub(r"\[([^\]\[]*)\\s([^\]\[]*)\]", lambda m: f"[{m[1]}{WS[1:-1]}{m[2]}]", pattern)
    out = re.sub(r"(^|\||\((?:\?:)?)\\b(?=[A-Za-z0-9(]|\\d|\\w)", lambda m: m[1] + START, out)
    out = re.sub(r"(?<=[A-Za-z0-9)?}])\\b(?=$|\||\))", lambda m: END, out)
    out = out.replace("\\s", WS).replace("\\b", _EDGE)
    return f"(?i){out}" if fold else out


def any_pattern(patterns: list[str], fold: bool = True) -> str:
    """One pattern for all: those that open at a word's start share that look."""
    inner = [re.sub(r"^\\b", "", x) for x in patterns if re.match(r"\\b(?:[A-Za-z0-9(]|\\d|\\w)", x) and not _top_level_or(x)]
    rest = [x for x in patterns if not (re.match(r"\\b(?:[A-Za-z0-9(]|\\d|\\w)", x) and not _top_level_or(x))]
    parts = ([f"{START}(?:{'|'.join(inner)})"] if inner else []) + [f"(?:{x})" for x in rest]
    return p("|".join(parts), fold)


def _top_level_or(pattern: str) -> bool:
    depth = 0
    for i, c in enumerate(pattern):
        if pattern[i - 1 : i] == "\\":
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            return True
    return False


def literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", text)
