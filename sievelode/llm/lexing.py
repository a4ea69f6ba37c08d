"""Lexer of comments and string literals for several languages, as functions from a state to a state.

``lex`` starts in any state, so a text may be cut anywhere between two plain characters and its parts lexed apart.
"""

from __future__ import annotations

import re

from sievelode.functions.languages import FAMILIES, family

__all__ = ["FAMILIES", "family", "lex", "masked"]

CODE, LINE, BLOCK, DOUBLE, SINGLE, TRIPLE_DOUBLE, TRIPLE_SINGLE, BACKTICK = range(8)
STATES = 8
PLAIN_SETS = frozenset("\"'`/*#\\\r\n")
_REGEX = r"(?P<skip>(?<=[(,=:\[!&|?{};])\s*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)|"
_OPEN = {
    "py": re.compile(r"#|\"\"\"|'''|\"|'"),
    "js": re.compile(_REGEX + r"//|/\*|\"|'|`"),
    "java": re.compile(r"//|/\*|\"\"\"|\"|'"),
    "go": re.compile(r"//|/\*|\"|'|`"),
    "conf": re.compile(r"(?<![^\s])#|(?:(?<=\n)|\A)[ \t]*(?:;|//)|\"\"\"|'''|\"|(?<![\w])'"),
}
_STATE_OF = {"#": LINE, "//": LINE, ";": LINE, "/*": BLOCK, '"': DOUBLE, "'": SINGLE, '"""': TRIPLE_DOUBLE, "'''": TRIPLE_SINGLE, "`": BACKTICK}
_BODY = {DOUBLE: re.compile(r"(?:[^\"\\\n]+|\\[\s\S])*"), SINGLE: re.compile(r"(?:[^'\\\n]+|\\[\s\S])*")}
_END = {TRIPLE_DOUBLE: re.compile(r"\\[\s\S]|\"\"\""), TRIPLE_SINGLE: re.compile(r"\\[\s\S]|'''"), BACKTICK: re.compile(r"\\[\s\S]|`")}


def lex(text: str, fam: str, state: int = CODE, at: int = 0) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(tokens, end state)``: a token is ``(state, start, inner start, inner end)``; the end mark is not included.

    A token that the text's end cuts off reaches to the end, and its state is the end state. An unclosed one-line
    string ends with its line. What stands before ``at`` is only looked back upon.
    """
    out: list[tuple[int, int, int, int]] = []
    find, n = _OPEN[fam].search, len(text)
    start = inner = at
    while True:
        if state == CODE:
            m = find(text, at)
            if not m:
                return out, CODE
            at = m.end()
            if m.lastgroup:
                continue
            state, start, inner = _STATE_OF[m.group().strip()], m.start(), at
        if state == LINE:
            end = text.find("\n", at)
            if end < 0:
                out.append((LINE, start, inner, n))
                return out, LINE
            at = end
        elif state == BLOCK:
            end = text.find("*/", at)
            if end < 0:
                out.append((BLOCK, start, inner, n))
                return out, BLOCK
            at = end + 2
        elif state in _BODY:
            end = _BODY[state].match(text, at).end()
            if end >= n:
                out.append((state, start, inner, n))
                return out, state
            at = end + (text[end] != "\n")
            if text[end] == "\\":  # a lone backslash at the text's end
                out.append((state, start, inner, n))
                return out, state
        elif state == BACKTICK and fam == "go":
            end = text.find("`", at)
            if end < 0:
                out.append((state, start, inner, n))
                return out, state
            at = end + 1
        else:
            for m in _END[state].finditer(text, at):
                if m.group()[0] != "\\":
                    end, at = m.start(), m.end()
                    break
            else:
                out.append((state, start, inner, n))
                return out, state
        out.append((state, start, inner, end))
        state = CODE


def masked(text: str, tokens: list[tuple[int, int, int, int]]) -> str:
    """The text with comments and strings blanked out; lengths and line breaks stay."""
    out, last = [], 0
    for _, start, _, end in tokens:
        piece = text[start:end]
        out.append(text[last:start])
        out.append(re.sub(r"[^\n]", " ", piece) if "\n" in piece else " " * len(piece))
        last = end
    out.append(text[last:])
    return "".join(out)


def cuts_of(text: str, size: int, fam: str) -> list[int]:
    """Offsets at which the text may be cut into chunks of about ``size``: behind a line break, or, in very long lines,
    between two plain characters. Lines of a language with pattern literals stay whole, since such a literal is one line
    whose end tells what its begin is.
    """
    cuts, at = [], size
    while at < len(text):
        cut = text.find("\n", at, len(text) if fam == "js" else at + size) + 1
        if not cut and fam != "js":
            cut = at
            while cut < len(text) and (text[cut] in PLAIN_SETS or text[cut - 1] in PLAIN_SETS or text[cut].isspace() or text[cut - 1].isspace()):
                cut += 1
        if not cut or cut >= len(text):
            break
        cuts.append(cut)
        at = cut + size
    return cuts


def context_of(text: str, cut: int) -> str:
    """What a chunk that begins at ``cut`` looks back upon: the last character that is no blank, and a line break."""
    at = cut
    while at and text[at - 1].isspace():
        at -= 1
    return text[max(0, at - 1) : at] + ("\n" if cut and text[cut - 1] == "\n" else "")
