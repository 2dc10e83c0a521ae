"""Regular expressions written for a browser-style engine, made safe for Java."""

from __future__ import annotations

from collections.abc import Iterable

# The characters beyond ASCII that a browser-style \\s matches and
# trim() removes, as code points.
WIDE_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE_CLASS = r"\s" + "".join(rf"\x{{{code:X}}}" for code in WIDE_SPACES)
SPACE_CHARS = " \t\n\x0b\f\r" + "".join(chr(code) for code in WIDE_SPACES)

# A run of blanks, but for a single plain one, which would be replaced by itself.  Printable ASCII is passed by
# one test: without it each letter is held against all the wide spaces, one after another.
BLANK_RUN = rf"(?=[^!-~])(?: [{SPACE_CLASS}]+|(?! )[{SPACE_CLASS}]+)"

# ASCII word boundary: Java's own \b treats Hangul as word characters.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def portable(pattern: str) -> str:
    """Rewrite \\s, \\b and $ so that Java finds what a browser engine finds."""
    out: list[str] = []
    in_class = False
    chars = iter(pattern)
    for char in chars:
        if char == "\\":
            nxt = next(chars, "")
            if nxt == "s":
                out.append(f"[{SPACE_CLASS}]")
            elif nxt == "S":
                out.append(f"[^{SPACE_CLASS}]")
            elif nxt == "b" and not in_class:
                out.append(WORD_EDGE)
            else:
                out.append(char + nxt)
        elif char == "$" and not in_class:
            out.append(r"\z")
        else:
            if char == "[":
                in_class = True
            elif char == "]":
                in_class = False
            out.append(char)
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern ready for rlike / regexp_*: optional Unicode-aware case folding."""
    return ("(?iu)" if ignore_case else "") + portable(pattern)


def alternatives(pattern: str) -> list[str]:
    """Split at the | signs outside brackets."""
    parts, depth, in_class, start, at = [], 0, False, 0, 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            at += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*parts, pattern[start:]]


def is_literal(pattern: str) -> bool:
    return pattern != "" and not set(pattern) & set(r"\.[](){}*+?^$|")


def any_of(patterns: Iterable[str]) -> str:
    """One alternation, so a whole set costs one regex pass and stays in codegen."""
    return "|".join(f"(?:{pattern})" for pattern in patterns)


def escape(text: str) -> str:
    """Quote the metacharacters of a literal keyword."""
    return "".join("\\" + char if char in ".*+?^${}()|[]\\" else char for char in text)


def keyword_pattern(keywords: Iterable[str]) -> str:
    """Case-insensitive alternation of literal keywords."""
    return "(?iu)" + "|".join(escape(keyword) for keyword in keywords)
