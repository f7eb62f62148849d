"""Symbols and calls of one source text, from its tokens in one pass.

The reader looks for the few constructs that define symbols, notes the token
span of each, and decides ownership, export and parents by nesting of spans.
There is no recursion and nothing raises on broken code.
"""

from __future__ import annotations

import bisect
import itertools
import itertools
import re
from dataclasses import dataclass, field

from ..schema import MODULE
from .tokens import BEFORE_VALUE, PUNCT, STRING, TAG, TEMPLATE, WORD, Token, ends_value, pairs, tokenize

# Words that never name a called function, and modifiers of class members.
NOT_CALLED = frozenset("if for while switch catch function return typeof super import await yield new delete void in of instanceof case do else throw with this null true false".split())
MODIFIERS = frozenset("public private protected static readonly async override declare abstract accessor get set".split())
DECLARATION_BEFORE = frozenset("export default declare async abstract".split())


class Spans:
    """Half-open spans, and whether any of them covers a place."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self._upto: list[int] | None = []  # furthest end of the spans up to each

    def append(self, span: tuple[int, int]) -> None:
        in_order = not self.spans or span >= self.spans[-1]
        self.spans.append(span)
        if in_order and self._upto is not None:
            self._upto.append(max(span[1], self._upto[-1] if self._upto else 0))
        else:
            self._upto = None

    def cover(self, i: int) -> bool:
        if self._upto is None:
            self.spans.sort()
            self._upto = list(itertools.accumulate((b for _, b in self.spans), max))
        at = bisect.bisect_right(self.spans, (i, 1 << 60))
        return at > 0 and self._upto[at - 1] > i


@dataclass
class Symbol:
    name: str
    kind: str
    first: int  # tokens of the whole construct
    last: int
    body: tuple[int, int] | None = None  # tokens of the body that owns calls
    node: tuple[int, int] | None = None  # tokens of the function itself, with its parameters
    parent: str | None = None
    static: bool = False
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    show: int | None = None  # token with which the shown text begins


class Reader:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx = source, jsx
        self.tokens: list[Token] = tokenize(source, jsx)
        self.partner = pairs(self.tokens)
        self.lines = [m.end() for m in re.finditer("\n", source)]
        self.symbols: list[Symbol] = []
        self.exports: list[tuple[int, int]] = []
        self.spaces: list[tuple[int, int, str]] = []
        self.objects: dict[int, str | None] = {}  # object literals by their brace, with the binding
        self.declared: set[int] = set()  # names that a definition introduces, so no calls
        self.typed = Spans()  # that hold types only
        self._angles: dict[int, int] = {}
        self.values: set[int] = set()  # where function values of names begin
        self.bound: dict[int, str] = {}  # object literals that are a variable's value
        self._read()
        for s in self.symbols:
            if s.kind in ("interface", "type"):
                self.typed.append((s.first, s.last))

    # --- tokens -------------------------------------------------------------
    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind in (WORD, PUNCT) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == WORD

    def close(self, i: int) -> int:
        return self.partner[i] if self.partner[i] >= 0 else i

    def where(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, offset)
        return line + 1, offset - (self.lines[line - 1] if line else 0) + 1

    def new_line(self, i: int) -> bool:
        """Whether token i stands on a later line than the one before it."""
        return i == 0 or i >= len(self.tokens) or "\n" in self.source[self.tokens[i - 1].end : self.tokens[i].start]

    def angles(self, i: int) -> int:
        """Index after the type arguments that open at i, or i if it does not open any.

        One pass also tells it for the angles passed on the way, so that a
        text of many open angles is not read again for each.
        """
        if i in self._angles:
            return self._angles[i]
        opened, j = [], i
        while j < len(self.tokens):
            t = self.tokens[j]
            if t.kind == PUNCT:
                if t.text == "<":
                    opened.append(j)
                elif t.text == ">" and opened:
                    self._angles[opened.pop()] = j + 1
                elif t.text in ("(", "[", "{"):
                    j = self.close(j)
                elif t.text in (";", "&&", "||", ")", "]", "}", "+", "===", "!=="):
                    break
            if not opened:
                break
            j += 1
        self._angles |= {k: k for k in opened}
        return self._angles.setdefault(i, i)

    def statement_start(self, i: int) -> bool:
        if i == 0:
            return True
        before = self.tokens[i - 1]
        if before.kind == PUNCT:
            return before.text in (";", "{", "}", ")") or (before.text == ":" and not self.in_object(i))
        return before.text in DECLARATION_BEFORE or before.text == "else" or (self.new_line(i) and ends_value(before))

    def in_object(self, i: int) -> bool:
        depth = self.around[i]
        return depth >= 0 and depth in self.objects

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Index of the first stop outside brackets from i on."""
        while i < len(self.tokens):
            t = self.text(i)
            if t in stops:
                return i
            if t == "<":
                i = max(i + 1, self.angles(i))
                continue
            if t in ("(", "[", "{"):
                if t == "{" and "{" in stops:
                    return i
                i = self.close(i)
            elif t in (")", "]", "}"):
                return i
            i += 1
        return i

    def statement_end(self, i: int) -> int:
        """Index after the statement that begins at i: at a semicolon, or where a new line starts another."""
        j = i
        while j < len(self.tokens):
            t = self.text(j)
            if t == ";":
                return j + 1
            if t in (")", "]", "}"):
                return j
            if j > i and self.new_line(j) and ends_value(self.tokens[j - 1]) and (self.tokens[j].kind != PUNCT or t in ("{", "@")) and self.tokens[j].kind != TEMPLATE and t not in ("as", "satisfies", "in", "of", "instanceof", "extends", "implements"):
                return j
            if t in ("(", "[", "{"):
                j = self.close(j)
            j += 1
        return j

    # --- functions ----------------------------------------------------------
    def signature_end(self, i: int, in_class: bool = False) -> int:
        """From the parenthesis at i over parameters and result type, to the body's brace or the arrow."""
        j = min(self.close(i) + 1, len(self.tokens))
        if self.text(j) == ":":
            k = j + 1
            while k < len(self.tokens):  # a brace straight after the colon or an operator is a type
                t = self.text(k)
                if t == "{" and self.text(k - 1) not in (":", "|", "&", "is", "=>"):
                    break
                if t in (";", "=>", ")", "]", "}", ",", "=") or (in_class and self.new_line(k) and self.text(k - 1) not in ("|", "&", ":")):
                    break
                if t == "<":
                    k = max(k + 1, self.angles(k))
                    continue
                if t in ("(", "[", "{"):
                    k = self.close(k)
                    if self.text(k + 1) == "=>" and t == "(" and self.text(self.type_end(k + 2, ("{", "=>", ";"))) in ("{", "=>"):
                        k += 1  # a function type as the result
                k += 1
            self.typed.append((j, k))
            j = k
        return j

    def function_value(self, i: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """(node, body) of the arrow or function expression that begins at i."""
        j = i + 1 if self.text(i) == "async" and not self.new_line(i + 1) and self.text(i + 1) != "=>" else i
        if self.text(j) == "function":
            k = j + 1 + (self.text(j + 1) == "*")
            k += self.word(k)
            k = self.angles(k) if self.text(k) == "<" else k
            if self.text(k) != "(":
                return None
            brace = self.signature_end(k)
            return ((i, self.close(brace)), (brace, self.close(brace))) if self.text(brace) == "{" else None
        k = self.angles(j) if self.text(j) == "<" else j
        if self.text(k) == "(":
            arrow = self.signature_end(k)
        elif self.word(k) and self.text(k + 1) == "=>":
            arrow = k + 1
        else:
            return None
        if self.text(arrow) != "=>":
            return None
        if self.text(arrow + 1) == "{":
            return (i, self.close(arrow + 1)), (arrow + 1, self.close(arrow + 1))
        end = self.statement_end(arrow + 1)
        comma = self.type_end(arrow + 1, (",", ";"))
        end = max(arrow + 1, min(end, comma) - 1)
        return (i, end), (arrow + 1, end)

    def property_name(self, i: int) -> tuple[str, int]:
        """Name of a member at i and the index after it; empty if there is none."""
        if i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == PUNCT and t.text == "[":
                end = self.close(i)
                if end < len(self.tokens):
                    return self.source[t.start : self.tokens[end].end], end + 1
            elif t.kind != PUNCT and t.kind not in (TAG, TEMPLATE):
                return t.text, i + 1
        return "", i

    # --- constructs ---------------------------------------------------------
    def _read(self) -> None:
        n = len(self.tokens)
        self.around = [-1] * n
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if stack and self.partner[stack[-1]] == i:
                stack.pop()
            self.around[i] = stack[-1] if stack else -1
            if t.kind == PUNCT and t.text in ("(", "[", "{") and self.partner[i] > i:
                stack.append(i)
        skip = 0
        for i, t in enumerate(self.tokens):
            if i < skip:
                continue
            if t.kind == PUNCT:
                if t.text == "{" and i not in self.objects and self._object_opens(i):
                    self.objects[i] = self._binding(i)
                if self.text(i) in ("{", ",") and self.around_object(i):
                    self._object_member(i + 1)
                continue
            if t.kind != WORD or self.text(i - 1) in (".", "?."):
                continue
            word = t.text
            if word == "export" and self.statement_start(i):
                self.exports.append((i, self._export_end(i)))
            elif word == "function":
                self._function(i)
            elif word == "class":
                self._class(i)
            elif word in ("interface", "enum", "type", "namespace", "module"):
                skip = self._named(i, word)
            elif word in ("const", "let", "var") and self.text(i + 1) != "enum":
                self._variables(i)
        self.symbols.sort(key=lambda s: (s.first, -s.last))

    def around_object(self, i: int) -> bool:
        return (i if self.text(i) == "{" else self.around[i]) in self.objects

    def _object_opens(self, i: int) -> bool:
        before = self.tokens[i - 1] if i else None
        if before is None or self._is_type(i):
            return False
        if before.kind == PUNCT:
            if before.text == ":":
                return self.in_object(i) or self.around[i] >= 0 and self.text(self.around[i]) in ("(", "[")
            return before.text in ("=", "(", ",", "[", "?", "&&", "||", "??", "...", "??=", "||=")
        return before.kind == WORD and before.text in BEFORE_VALUE - {"do", "else", "extends", "of"}

    def _is_type(self, i: int) -> bool:
        return self.typed.cover(i)

    def _binding(self, i: int) -> str | None:
        """Name of the variable that an object literal, or the one around it, is the value of."""
        around = self.around[i]
        if around in self.objects and self.text(i - 1) in (":", ","):
            return self.objects[around]
        return self.bound.get(i)

    def _export_end(self, i: int) -> int:
        j = i + 1
        while self.text(j) in ("default", "declare", "async", "abstract", "const") and self.text(j + 1) in ("default", "declare", "async", "abstract", "function", "class", "interface", "enum", "namespace", "module"):
            j += 1
        if self.text(j) in ("function", "class", "interface", "enum", "namespace", "module"):
            k = j + 1
            while k < len(self.tokens) and self.text(k) not in ("{", ";"):
                if self.text(k) == "(":
                    k = self.signature_end(k)
                    continue
                k = max(k + 1, self.angles(k)) if self.text(k) == "<" else k + 1
            return (self.close(k) + 1) if k < len(self.tokens) and self.text(k) == "{" else k
        return self.statement_end(i)

    def _function(self, i: int) -> None:
        j = i + 1 + (self.text(i + 1) == "*")
        name = self.text(j) if self.word(j) else ""
        k = j + bool(name)
        k = self.angles(k) if self.text(k) == "<" else k
        if self.text(k) != "(":
            return
        self.declared.add(j if name else i)
        brace = self.signature_end(k)
        if self.text(brace) != "{":
            return  # an overload or a declaration without a body
        first = i - 1 if self.text(i - 1) == "async" else i
        end = self.close(brace)
        if self.statement_start(first):
            default = self.text(first - 1) == "default"
            if name or default:
                keyed = ((first, end), (brace, end)) if name else (None, None)
                self.symbols.append(Symbol(name or "default", "function", first, end, keyed[1], keyed[0], parent="\0namespace"))
        elif name and first not in self.values:
            self.symbols.append(Symbol(name, "function", first, end, (brace, end), (first, end)))

    def _class(self, i: int) -> None:
        default = self.text(i - 1) == "default"
        if self.text(i - 1) == "abstract" or not (self.statement_start(i) or self.text(i - 1) == ")"):
            return
        j = i + 1
        name = self.text(j) if self.word(j) and self.text(j) not in ("extends", "implements") else ""
        if not name and not default:
            return
        j += bool(name)
        j = self.angles(j) if self.text(j) == "<" else j
        heritage: dict[str, list[str]] = {"extends": [], "implements": []}
        brace = self._heritage(j, heritage)
        if self.text(brace) != "{":
            return
        end = self.close(brace)
        self.symbols.append(Symbol(name or "default", "class", i, end, **heritage))
        self._members(brace, end, name or "default")

    def _heritage(self, j: int, found: dict[str, list[str]]) -> int:
        """Read base names from j up to the body's brace; type arguments are left out."""
        at = ""
        while j < len(self.tokens) and self.text(j) not in ("{", ";"):
            if self.text(j) in found:
                at, j = self.text(j), j + 1
                continue
            if at and self.word(j):
                start = j
                while self.text(j + 1) == "." and self.word(j + 2):
                    j += 2
                if self.text(j + 1) != "(":
                    found[at].append(self.source[self.tokens[start].start : self.tokens[j].end])
            if self.text(j) == "<":
                j = max(j + 1, self.angles(j))
            elif self.text(j) in ("(", "["):
                j = self.close(j) + 1
            else:
                j += 1
        return j

    def _members(self, brace: int, end: int, owner: str) -> None:
        i = brace + 1
        while i < end:
            if self.text(i) == "@":
                i += 2
                while self.text(i) == ".":
                    i += 2
                i = self.close(i) + 1 if self.text(i) == "(" else i
                continue
            if self.text(i) in (";", ","):
                i += 1
                continue
            i = max(i + 1, self._member(i, end, owner))

    def _member(self, i: int, end: int, owner: str) -> int:
        j, marks = i, set()
        while self.text(j) in MODIFIERS and self.text(j + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}"):
            marks.add(self.text(j))
            j += 1
        if self.text(j) == "*":
            j += 1
        name, k = self.property_name(j)
        if not name:
            return self.close(j) + 1 if self.text(j) == "{" else j + 1
        named = j
        if self.text(k) in ("?", "!"):
            k += 1
        opens = self.angles(k) if self.text(k) == "<" else k
        if self.text(opens) != "(":
            if self.text(k) == ":":
                stop = self.type_end(k + 1, ("=", ";"))
                self.typed.append((k, min(stop, self.statement_end(k + 1))))
            return self.statement_end(j)
        self.declared.add(named)
        stop = self.signature_end(opens, in_class=True)
        body = (stop, self.close(stop)) if self.text(stop) == "{" else None
        last = body[1] if body else stop - 1
        kind = "getter" if "get" in marks else "setter" if "set" in marks else "method"
        if "abstract" not in marks:
            self.symbols.append(Symbol(name, kind, i, last, body, (i, last) if body else None, owner, "static" in marks))
        return last + 1

    def _object_member(self, i: int) -> None:
        """A method, function value or unique-symbol value of an object literal, if one begins at i."""
        around = self.around[i] if i < len(self.tokens) else -1
        if around not in self.objects:
            return
        j, marks = i, set()
        while self.text(j) in ("async", "get", "set", "static") and self.text(j + 1) not in ("(", ":", ",", "=", "}"):
            marks.add(self.text(j))
            j += 1
        j += self.text(j) == "*"
        name, k = self.property_name(j)
        if not name:
            return
        opens = self.angles(k) if self.text(k) == "<" else k
        if self.text(opens) == "(":
            stop = self.signature_end(opens)
            if self.text(stop) == "{":
                self.declared.add(j)
                end = self.close(stop)
                kind = "getter" if "get" in marks else "setter" if "set" in marks else "method"
                self.symbols.append(Symbol(name, kind, i, end, (stop, end), (i, end), self.objects[around]))
        elif self.text(k) == ":" and self.word(j):
            value = self.function_value(k + 1)
            if value:
                self.values.add(k + 1)
                self.symbols.append(Symbol(name, "variable", i, value[0][1], None, None, self.objects[around]))
            elif self.text(k + 1) == "Symbol" and self.text(k + 2) == "(":
                self.symbols.append(Symbol(name, "variable", i, self.close(k + 2)))

    def _named(self, i: int, word: str) -> int:
        if not (self.word(i + 1) or (word in ("module",) and i + 1 < len(self.tokens) and self.tokens[i + 1].kind == STRING)) or not (self.statement_start(i) or self.text(i - 1) == "const") or self.new_line(i + 1):
            return 0
        name, j = self.text(i + 1) or self.tokens[i + 1].text, i + 2
        if word in ("namespace", "module"):
            while self.text(j) == "." and self.word(j + 1):
                name, j = f"{name}.{self.text(j + 1)}", j + 2
            if self.text(j) == "{":
                self.spaces.append((j, self.close(j), name))
            return 0
        j = self.angles(j) if self.text(j) == "<" else j
        heritage: dict[str, list[str]] = {"extends": [], "implements": []}
        if word == "type":
            if self.text(j) != "=":
                return 0
            end = self.statement_end(j + 1) - 1
            while self.text(end + 1) in ("|", "&"):
                end = self.statement_end(end + 2) - 1
        else:
            j = self._heritage(j, heritage)
            if self.text(j) != "{":
                return 0
            end = self.close(j)
        first = i - 1 if self.text(i - 1) == "const" else i
        self.symbols.append(Symbol(name, word, first, end, **heritage))
        return end + 1 if word != "enum" else 0

    def _variables(self, i: int) -> None:
        """Declarators after const, let or var: those whose value or annotation is a function become symbols."""
        j = i + 1
        while j < len(self.tokens):
            start = j
            if self.text(j) in ("{", "["):
                name, j = "", self.close(j) + 1
            elif self.word(j):
                name, j = self.text(j), j + 1
            else:
                return
            j += self.text(j) == "!"
            functional = False
            if self.text(j) == ":":
                stop = self.type_end(j + 1, ("=", ",", ";"))
                stop = min(stop, max(self.statement_end(j + 1), j + 2))
                functional = any(t.kind == PUNCT and t.text == "=>" for t in self.tokens[j:stop])
                self.typed.append((j, stop))
                j = stop
            value, last = None, j - 1
            if self.text(j) == "=":
                value = self.function_value(j + 1)
                if self.text(j + 1) == "{" and name:
                    self.bound[j + 1] = name
                if value:
                    last = value[0][1]
                    self.values.add(j + 1)
                    j = last + 1
                else:
                    after = min(self.type_end(j + 1, (",", ";")), self.statement_end(j + 1))
                    last, j = after - 1, after
            if name and (value or functional):
                self.symbols.append(Symbol(name, "variable", start, max(last, start), value[1] if value else None, value[0] if value else None, show=i))
            if self.text(j) != ",":
                return
            j += 1

    def exported(self, i: int) -> bool:
        """Whether an export statement spans token i."""
        if not hasattr(self, "_export_starts"):
            self._export_starts = [a for a, _ in self.exports]
            self._export_ends = list(itertools.accumulate((b for _, b in self.exports), max))
        at = bisect.bisect_right(self._export_starts, i)
        return at > 0 and self._export_ends[at - 1] > i

    # --- calls --------------------------------------------------------------
    def callee_start(self, i: int) -> int:
        """First token of the member chain that ends with the name at i."""
        while self.text(i - 1) in (".", "?."):
            j = i - 2
            if j >= 0 and self.text(j) == "!":
                j -= 1
            while j >= 0 and self.text(j) in (")", "]") and self.partner[j] >= 0:
                j = self.partner[j] - 1
                if not (j >= 0 and ends_value(self.tokens[j]) and not (self.word(j) and self.text(j) in NOT_CALLED - {"this", "super"})):
                    j += 1
                    break
            if j < 0 or j == i:
                break
            i = j
        return i - 1 if self.text(i - 1) == "new" else i

    def calls(self) -> list[tuple[int, int, str]]:
        """(first token, last token, called name), outer calls before inner ones at the same place."""
        found = []
        for i, t in enumerate(self.tokens):
            if t.kind == TAG:
                name = t.text.rsplit(".", 1)[-1]
                if name[:1].isupper() and (t.text[:1].isupper() or "." in t.text):
                    found.append((i, i, name))
                continue
            if t.kind != WORD or i in self.declared or self._typed_at(i):
                continue
            member = self.text(i - 1) in (".", "?.")
            if t.text == "new" and not member:
                j = i + 1
                while self.text(j + 1) == "." and self.word(j + 2):
                    j += 2
                if self.word(j) and self.text(j) not in ("function", "class", "this", "new", "target"):
                    found.append((i, j, self.text(j)))
                continue
            if t.text in NOT_CALLED and not member:
                continue
            j = i + 1
            if self.text(j) == "?.":
                j += 1
            if self.text(j) == "<":
                after = self.angles(j)
                j = after if after > j and self.text(after) == "(" else j
            tagged = j < len(self.tokens) and self.tokens[j].kind == TEMPLATE and self.source[self.tokens[j].start - 1 : self.tokens[j].start] == "`" and not self.new_line(j)
            if (self.text(j) != "(" and not tagged) or (self.text(j) == "(" and self.text(i - 1) == "function"):
                continue
            start = self.callee_start(i)
            if self.text(start) == "new" and self._plain_chain(start + 1, i):
                continue  # told by its keyword
            if t.text == "async" and self.text(self.close(j) + 1) == "=>":
                continue
            found.append((start, j, t.text))
        return sorted(found, key=lambda c: (c[0], -c[1]))

    def _plain_chain(self, i: int, end: int) -> bool:
        return all(self.word(k) or self.text(k) == "." for k in range(i, end + 1))

    def _typed_at(self, i: int) -> bool:
        return self.typed.cover(i)


def read_source(source: str, path: str) -> tuple[list[dict], list[dict]]:
    """(symbols, calls) of one file as rows, ids relative to ``path``; the module's own symbol comes last.

    A call belongs to the innermost function that is a symbol and whose body
    holds it; calls in that function's parameters belong to nothing, and calls
    outside all such functions to the module.
    """
    reader = Reader(source, path.lower().endswith((".tsx", ".jsx", ".js")))
    tokens, last = reader.tokens, len(reader.tokens) - 1
    symbols, ids = [], []
    for s in reader.symbols:
        start = tokens[min(s.first, last)].start
        line, column = reader.where(start)
        finish = tokens[max(0, min(s.last, last))].end
        parent = s.parent
        if parent == "\0namespace":
            around = [(a, name) for a, b, name in reader.spaces if a < s.first <= b]
            parent = max(around)[1] if around else None
        shown = source[tokens[s.show].start if s.show is not None else start : finish]
        ids.append(f"{path}#{parent + '.' if parent else ''}{s.name}@{line}")
        symbols.append({"id": ids[-1], "name": s.name, "kind": s.kind, "file": path, "line": line, "column": column, "end_line": reader.where(max(start, finish - 1))[0], "signature": shown.split("\n", 1)[0].strip(), "exported": reader.exported(s.first), "parent": parent, "is_static": True if s.static else None, "extends": s.extends or None, "implements": s.implements or None})
    keyed = sorted((s.node[0], -s.node[1], n) for n, s in enumerate(reader.symbols) if s.node)
    calls, outside = [], []
    opened: list[tuple[int, int]] = []
    at = 0
    owned: dict[int, list[dict]] = {}
    for first, _, name in reader.calls():
        while at < len(keyed) and keyed[at][0] <= first:
            opened.append((-keyed[at][1], keyed[at][2]))
            at += 1
        while opened and opened[-1][0] < first:
            opened.pop()
        live = [o for o in opened if o[0] >= first]
        line, column = reader.where(tokens[first].start)
        row = {"to_name": name, "file": path, "line": line, "column": column}
        if not live:
            outside.append(row | {"from_id": f"{path}#{MODULE}"})
            continue
        owner = live[-1][1]
        body = reader.symbols[owner].body
        if body[0] <= first <= body[1]:
            owned.setdefault(owner, []).append(row | {"from_id": ids[owner]})
    for owner in sorted(owned):
        calls += owned[owner]
    if outside:
        symbols.append({"id": f"{path}#{MODULE}", "name": MODULE, "kind": "module", "file": path, "line": 1, "column": 1, "end_line": len(reader.lines) + 1, "signature": "<module scope>", "exported": False, "parent": None, "is_static": None, "extends": None, "implements": None})
    return symbols, calls + outside


def list_functions(source: str, path: str) -> list[str]:
    """Names of the functions, methods and function values of a text, in order."""
    return [s["name"] for s in read_source(source, path)[0] if s["kind"] in ("function", "method", "getter", "setter", "variable")]
