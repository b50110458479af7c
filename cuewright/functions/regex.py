"""Rule patterns: from the Python dialect they are written in to one JVM expression.

Python's ``\\w \\b \\d \\s`` look at Unicode properties; Java's defaults are ASCII,
and its Unicode mode counts combining marks as word characters. Each token is
therefore spelled out as an explicit class, once, on the driver.
"""

from __future__ import annotations

from functools import reduce
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content of character classes, to be put between brackets.
SPACE = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85"
# U+20000 is a letter already covered by \p{L}; written out, it makes Java's
# look-behind step by code point instead of by UTF-16 unit.
WORD = "\\p{L}\\p{N}_\U00020000"
DIGIT = r"\p{Nd}"

_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Two rules need a form of their own on the JVM: (necessary condition, pattern).
#
# Dotted names: repeating a group once per label is done by recursion in Java, and a
# long dotted string would exhaust the stack. For the yes/no answer it is enough to
# look at the last label a hit can start in; the labels after it are those that
# offer no start: hyphens, "www", or both in this order.
#
# Both rules may start at any word boundary of a long run of name characters, and
# each start would read the run to its end. Here a run is read once, from its own
# start, and what precedes the dot or "@" says whether a boundary lies in it: at its
# start, or between a word character and another inside.
#
# The condition is one pass for a rare anchor, and spares the rest where it is missing.
_TLD = "(?:com|ir|org|net|in|co|us|me|app|tv|xyz|info|online)"
_LABEL, _ALNUM = "[A-Za-z0-9-]", "[A-Za-z0-9]"
_LOCAL, _LOCAL_WORD, _LOCAL_OTHER = "[A-Za-z0-9._%+-]", "[A-Za-z0-9_]", "[.%+-]"
# The keys are two rules of ``rules/full.txt`` as they stand there.
GUARDED = {
    r"\b(?!www\.)([A-Za-z0-9-]+\.)+(com|ir|org|net|in|co|us|me|app|tv|xyz|info|online)\b": (
        rf"\.{_TLD}",
        rf"(?<!{_LABEL})(?:\b(?!www\.){_LABEL}++|-*+{_ALNUM}++-{_LABEL}*+|-++(?!www\.){_ALNUM}{_LABEL}*+)"
        rf"\.(?:(?:-++(?:www)?+|www)\.)*+{_TLD}\b",
    ),
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b": (
        "@",
        rf"(?<!{_LOCAL})(?:\b{_LOCAL}++|{_LOCAL_WORD}++{_LOCAL_OTHER}{_LOCAL}*+|{_LOCAL_OTHER}++{_LOCAL_WORD}{_LOCAL}*+)"
        r"@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    ),
}


def to_jvm(pattern: str) -> str:
    """Translate one Python pattern; only the class tokens differ between the dialects."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        token = pattern[i + 1 : i + 2] if ch == "\\" else ""
        if token:
            i += 1
            if token.lower() in _CLASSES:
                body = _CLASSES[token.lower()]
                if token.islower():
                    out.append(body if in_class else f"[{body}]")
                else:
                    out.append(f"[^{body}]")
            elif token == "b" and not in_class:
                out.append(BOUNDARY)
            else:
                out.append(ch + token)
        else:
            if ch == "[" and in_class:
                ch = r"\["
            elif ch == "[":
                in_class = True
            elif ch == "]":
                in_class = False
            out.append(ch)
        i += 1
    return "".join(out)


def load_rules(ruleset: str = "full") -> list[str]:
    """Patterns of a bundled rule set (``full`` or ``lite``)."""
    text = resources.files("cuewright").joinpath("rules", f"{ruleset}.txt").read_text("utf-8")
    return [line for line in text.splitlines() if line and not line.startswith("# ")]


def compile_rules(patterns: list[str]) -> str:
    """One case-insensitive JVM expression that finds a hit wherever any pattern does.

    Only "is there a hit" is asked, so the order of alternatives is free. They are
    grouped by how they open: behind a word boundary or anywhere, with an ASCII
    character or another. A look-ahead for the possible first characters of a group
    dismisses most positions of a text with one check instead of one per rule.
    """
    groups: dict[tuple[bool, bool], list[tuple[set[str], str]]] = {}
    other = []
    for pattern in (part for p in patterns for part in _alternatives(p)):
        bounded = pattern.startswith(r"\b")
        heads = first_characters(pattern[2:] if bounded else pattern)
        if not heads or (bounded and not all(h.isalnum() for h in heads)):
            other.append(f"(?:{to_jvm(pattern)})")
        else:
            body = to_jvm(pattern[2:] if bounded else pattern)
            groups.setdefault((bounded, max(heads).isascii()), []).append((heads, body))
    out = []
    for (bounded, is_ascii), members in groups.items():
        heads = sorted(set().union(*(h for h, _ in members)))
        gate = f"(?=[{''.join(heads)}])" if is_ascii else f"(?=[{heads[0]}-{heads[-1]}])"
        gate += f"(?<![{WORD}])" if bounded else ""
        out.append(f"{gate}(?:{'|'.join(f'(?:{body})' for _, body in members)})")
    return "(?iu)" + "|".join(out + other)


def first_characters(pattern: str) -> set[str] | None:
    """Characters a hit can start with, or None where that is not plain from the pattern."""
    heads: set[str] = set()
    for alternative in _alternatives(pattern):
        found = _first_of_sequence(alternative)
        if found is None:
            return None
        heads |= found
    return heads


def _first_of_sequence(pattern: str) -> set[str] | None:
    if pattern.startswith("(?:"):
        end = _closing(pattern)
        heads, rest = first_characters(pattern[3:end]), pattern[end + 1 :]
    elif pattern[:1].isalnum() or pattern[:1] == "@":
        heads, rest = {pattern[0]}, pattern[1:]
    else:
        return None
    if heads is None or rest[:1] in ("*", "{"):
        return None
    if rest[:1] == "?":
        after = _first_of_sequence(rest[1:])
        return None if after is None else heads | after
    return heads


def _top_level(pattern: str):
    """(position, character, depth) of the characters outside classes and escapes."""
    depth, in_class, escaped = 0, False, False
    for i, ch in enumerate(pattern):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        else:
            depth += (ch == "(") - (ch == ")")
            yield i, ch, depth


def _closing(pattern: str) -> int:
    return next(i for i, ch, depth in _top_level(pattern) if ch == ")" and depth == 0)


def _alternatives(pattern: str) -> list[str]:
    bars = [i for i, ch, depth in _top_level(pattern) if ch == "|" and depth == 0]
    edges = [-1, *bars, len(pattern)]
    return [pattern[a + 1 : b] for a, b in zip(edges, edges[1:])]


def matches_rules(text: Column, ruleset: str | list[str] = "full") -> Column:
    """True where the (already normalised) text holds a hit of the rule set."""
    patterns = load_rules(ruleset) if isinstance(ruleset, str) else list(ruleset)
    plain = [p for p in patterns if p not in GUARDED]
    hits = [text.rlike(compile_rules(plain))] if plain else []
    for pattern in patterns:
        if pattern in GUARDED:
            condition, full = (f"(?iu){to_jvm(p)}" for p in GUARDED[pattern])
            hits.append(text.rlike(condition) & text.rlike(full))
    return reduce(lambda a, b: a | b, hits, F.lit(False))
