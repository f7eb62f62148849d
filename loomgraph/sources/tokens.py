"""A tolerant tokenizer for TypeScript and JavaScript, with templates, regular expressions and JSX.

It never raises: what it cannot read becomes a one-character token, and
unclosed strings end with their line.
"""

from __future__ import annotations

import re
from typing import NamedTuple

WORD, NUMBER, STRING, TEMPLATE, REGEX, PUNCT, TAG = range(7)

#: Words after which an expression starts, so that a slash opens a pattern and a brace an object.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends".split())

_NEXT = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>\#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\.?[0-9](?:[eE][+-]|[\w.])*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<punct>=>|\.\.\.|\?\.(?![0-9])|===|!==|==|!=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_TAG_TEXT = re.compile(r"[^<{]*")


class Token(NamedTuple):
    kind: int
    text: str
    start: int
    end: int


def ends_value(token: Token | None) -> bool:
    """Whether an operand ends with this token, so that an operator may follow."""
    if token is None:
        return False
    if token.kind == WORD:
        return token.text not in BEFORE_VALUE
    return token.kind != PUNCT or token.text in (")", "]", "}")


def tokenize(source: str, jsx: bool) -> list[Token]:
    """Tokens without blanks and comments.

    A template is a TEMPLATE token per piece of text, with ``${`` and ``}``
    around the code between.  A JSX element is a TAG token with its name
    (empty for a fragment) and the code of its attributes and children in
    braces; closing tags leave nothing.
    """
    out: list[Token] = []
    modes: list[str] = []  # "{" code in braces, "`" template text, "<" inside a tag, ">" children of an element
    at, size = 0, len(source)

    def add(kind: int, start: int, end: int, text: str | None = None) -> None:
        out.append(Token(kind, source[start:end] if text is None else text, start, end))

    while at < size:
        mode = modes[-1] if modes else ""
        if mode == "`":
            end = _TEMPLATE.match(source, at).end()
            add(TEMPLATE, at, end)
            at = end
            if source.startswith("${", at):
                add(PUNCT, at, at + 2, "{")
                modes.append("{")
                at += 2
            else:
                modes.pop()
                at += 1
            continue
        if mode == ">":
            at = _TAG_TEXT.match(source, at).end()
            if source.startswith("</", at):
                modes.pop()
                close = source.find(">", at)
                at = size if close < 0 else close + 1
                add(TEMPLATE, at, at, "")
            elif source.startswith("<", at):
                tag = _TAG.match(source, at)
                add(TAG, at, tag.end(), tag.group(1) or "")
                modes.append("<")
                at = tag.end()
            elif at < size:
                add(PUNCT, at, at + 1)
                modes.append("{")
                at += 1
            continue
        found = _NEXT.match(source, at)
        kind, end, text = found.lastgroup, found.end(), found.group()
        if kind == "blank":
            at = end
            continue
        if mode == "<":
            if source.startswith("/>", at):
                modes.pop()
                at += 2
                add(TEMPLATE, at, at, "")
            elif text == ">":
                modes[-1] = ">"
                at = end
            elif text == "{":
                add(PUNCT, at, end)
                modes.append("{")
                at = end
            elif text[0] in "\"'":  # attribute strings may span lines
                close = source.find(text[0], at + 1)
                at = size if close < 0 else close + 1
            else:
                at = end
            continue
        last = out[-1] if out else None
        if text == "`":
            modes.append("`")
            at = end
            continue
        if text == "/" and not ends_value(last):
            pattern = _REGEX.match(source, at)
            if pattern:
                add(REGEX, at, pattern.end())
                at = pattern.end()
                continue
        if text == "<" and jsx and not ends_value(last):
            tag = _TAG.match(source, at)
            after = source[tag.end() : tag.end() + 10].lstrip()
            if (tag.group(1) or after.startswith(">")) and not after.startswith((",", "extends ", "=")):
                add(TAG, at, tag.end(), tag.group(1) or "")
                modes.append("<")
                at = tag.end()
                continue
        if text == "{":
            modes.append("{")
        elif text == "}" and mode == "{":
            modes.pop()
        add({"word": WORD, "number": NUMBER, "string": STRING}.get(kind, PUNCT), at, end)
        at = end
    return out


def pairs(tokens: list[Token]) -> list[int]:
    """For every bracket the index of its partner, else -1; strays are left unmatched."""
    partner = [-1] * len(tokens)
    opened: list[int] = []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != PUNCT:
            continue
        if t.text in "([{" and len(t.text) == 1:
            opened.append(i)
        elif t.text in closes:
            for back in range(len(opened) - 1, max(-1, len(opened) - 4), -1):
                if tokens[opened[back]].text == closes[t.text]:
                    partner[opened[back]], partner[i] = i, opened[back]
                    del opened[back:]
                    break
    for i in opened:  # an unclosed bracket reaches to the end
        partner[i] = len(tokens)
    return partner
