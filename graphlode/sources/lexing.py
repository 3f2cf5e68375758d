"""Tokens of six languages: comments, strings and the rest, robust against broken source.

One compiled pattern per language finds everything that is not plain code. What is left open at the end of
a line (a short string) ends there; what may span lines (block comment, long string, template) runs to the
end of the text. Positions are code points.
"""

from __future__ import annotations

import re
from functools import lru_cache

EXTENSIONS = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java"}

COMMENT, STRING, NAME, NUMBER, SIGN, NEWLINE, REGEX, LIFETIME, BAD = range(9)

_NAME = r"(?P<name>[^\W\d]\w*)"
_JS_NAME = r"(?P<name>[$#]?(?:[^\W\d]|[$\\])[\w$‌‍\\]*)"
_NUMBER = r"(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"

_PATTERNS = {
    "python": rf"(?P<comment>#[^\n]*)|(?P<string>(?:[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)|{_DOUBLE}|{_SINGLE}))|{_NAME}|{_NUMBER}",
    "go": rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>`[^`]*(?:`|\Z)|{_DOUBLE}|{_SINGLE})|{_NAME}|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)",
    "java": rf"(?P<comment>{_LINE}|{_BLOCK})|(?P<string>\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|{_DOUBLE}|{_SINGLE})|(?P<name>(?:[^\W\d]|\$)[\w$]*)|{_NUMBER}",
    "rust": rf"(?P<comment>{_LINE}|/\*(?P<deep>))|(?P<string>(?:br|cr|r)(?P<fence>#*)\"[\s\S]*?(?:\"(?P=fence)|\Z)|[bc]?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\n]|\\(?:u\{{[^}}\n]*\}}|x[0-9a-fA-F]{{2}}|[^\n]))')|(?P<lifetime>'[^\W\d]\w*)|(?P<name>r#[^\W\d]\w*|[^\W\d]\w*)|(?P<number>\d(?:[eE][+-](?=\d)|\w|\.(?=\d))*\.?(?![.\w])|\d\w*)",
    "javascript": rf"(?P<comment>{_LINE}|{_BLOCK}|\A#![^\n]*)|(?P<string>{_DOUBLE}|{_SINGLE}|`(?P<template>))|{_JS_NAME}|{_NUMBER}",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]

_SIGNS = {
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^",
    "java": r"\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<=|<<",
    "rust": r"<<=|\.\.\.|\.\.=|->|=>|::|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|\.\.",
    "javascript": r"<<=|\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|\*\*|\?\?|\?\.(?!\d)|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
}
_SIGNS["typescript"] = _SIGNS["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
#: Names after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default", "extends"}


@lru_cache(None)
def _compiled(language: str) -> re.Pattern[str]:
    return re.compile(rf"(?P<newline>\r?\n)|[^\S\n]+|{_PATTERNS[language]}|(?P<sign>{_SIGNS[language]}|[!-/:-@\[-^{{-~])|(?P<bad>.)")


def _template_end(text: str, at: int) -> int:
    """End of the template literal that begins before ``at``, with nested expressions and templates."""
    open_braces: list[int] = []  # depth of braces in each open expression
    n = len(text)
    while at < n:
        c = text[at]
        if open_braces:
            if c == "{":
                open_braces[-1] += 1
            elif c == "}":
                open_braces[-1] -= 1
                if not open_braces[-1]:
                    open_braces.pop()
            elif c == "`":
                at = _template_end(text, at + 1)
                continue
            elif c in "'\"":
                end = at + 1
                while end < n and text[end] not in (c, "\n"):
                    end += 2 if text[end] == "\\" else 1
                at = end
        elif c == "\\":
            at += 1
        elif c == "`":
            return at + 1
        elif c == "$" and text.startswith("{", at + 1):
            open_braces.append(1)
            at += 1
        at += 1
    return n


_OPENING = re.compile(r"([rRbBuUfFtT]{0,2})(\"\"\"|'''|\"|')")


def _format_end(text: str, at: int, quote: str) -> tuple[int, bool]:
    """(end, closed) of the formatted string whose text begins at ``at``; its fields may hold any strings."""
    n = len(text)
    fields: list[int] = []  # open brackets of each open field; -1: in its format
    while at < n:
        c = text[at]
        if not fields or fields[-1] < 0:
            if c == "\\":
                at += 2
                continue
            if text.startswith(quote, at):
                return at + len(quote), not fields
            if c == "\n" and len(quote) == 1:
                return at, False
            if c == "{":
                if not fields and text.startswith("{{", at):
                    at += 2
                    continue
                fields.append(0)
            elif c == "}":
                if fields:
                    fields.pop()
                elif not text.startswith("}}", at):
                    return at, False
                else:
                    at += 1
        elif c in "\"'":
            m = _OPENING.match(text, at)
            start = at
            while start > 0 and text[start - 1] in "rRbBuUfFtT" and at - start < 2:
                start -= 1
            if text.startswith(quote, at) and len(quote) >= len(m[2]) and len(quote) == 3:
                return at + 3, False
            if any(x in "fFtT" for x in text[start:at]):
                at, closed = _format_end(text, at + len(m[2]), m[2])
                if not closed:
                    return at, False
            else:
                body = re.compile(r"(?:[^\\]|\\[\s\S])*?" + m[2]).match(text, at + len(m[2]))
                if not body or (len(m[2]) == 1 and "\n" in body[0]):
                    return min([x for x in (text.find("\n", at), n) if x >= 0]), False
                at = body.end()
            continue
        elif c in "([{":
            fields[-1] += 1
        elif c in ")]":
            fields[-1] -= 1
        elif c == "}":
            if fields[-1] > 0:
                fields[-1] -= 1
            else:
                fields.pop()
        elif c == ":" and fields[-1] == 0 and not text.startswith(":=", at):
            fields[-1] = -1
        at += 1
    return n, False


def _nested_comment_end(text: str, at: int) -> int:
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str, language: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each token; white space is left out, line ends are tokens."""
    match = _compiled(language).match
    script = language in ("javascript", "typescript")
    out: list[tuple[int, int, int]] = []
    kinds = {"comment": COMMENT, "string": STRING, "name": NAME, "number": NUMBER, "sign": SIGN, "newline": NEWLINE, "lifetime": LIFETIME, "bad": BAD}
    at, n = 0, len(text)
    while at < n:
        m = match(text, at)
        kind = m.lastgroup
        end = m.end()
        if kind is None:
            at = end
            continue
        if language == "python" and kind == "string" and (f := _OPENING.match(text, at)) and any(x in "fFtT" for x in f[1]):
            end, closed = _format_end(text, f.end(), f[2])
            end = max(end, f.end())
            kind = "string" if closed else "bad"
        elif kind == "template" or (script and kind == "string" and text[at] == "`"):
            end, kind = _template_end(text, at + 1), "string"
        elif kind == "fence":
            kind = "string"
        elif kind == "deep" or (language == "rust" and kind == "comment" and text.startswith("/*", at)):
            end, kind = _nested_comment_end(text, at + 2), "comment"
        elif script and kind == "sign" and text[at] == "/":
            last = next((t for t in reversed(out) if t[0] not in (COMMENT, NEWLINE)), None)
            if last is None or (last[0] == SIGN and text[last[1]] not in ")]}") or (last[0] == NAME and text[last[1] : last[2]] in _BEFORE_REGEX):
                r = _REGEX.match(text, at)
                if r:
                    out.append((REGEX, at, r.end()))
                    at = r.end()
                    continue
        out.append((kinds[kind], at, end))
        at = end
    return out


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if path and "." in path else None


#: Names that begin a definition in each language; what may stand before them on the line.
_DEFINES = {
    "python": ({"def", "class"}, {"async"}),
    "go": ({"func", "type"}, set()),
    "rust": ({"fn", "struct", "impl", "enum", "trait", "union"}, {"pub", "async", "unsafe", "const", "extern", "default"}),
    "java": ({"class", "interface", "enum", "record"}, {"public", "private", "protected", "static", "final", "abstract", "sealed", "strictfp", "non"}),
    "javascript": ({"function", "class"}, {"export", "default", "async"}),
    "typescript": ({"function", "class", "interface", "enum"}, {"export", "default", "async", "abstract", "declare", "const"}),
}


class Layout:
    """Lines of a text: which begin a definition at which indent, and which are comments or attributes."""

    def __init__(self, text: str, language: str | None):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        n = len(self.starts)
        self.length = len(text)
        self.only_comment = [False] * n  # a comment and nothing else
        self.attribute = [False] * n
        self.inside = [False] * n  # the line begins within a string or comment
        self.blank = [not text[s:e].strip() for s, e in zip(self.starts, [*self.starts[1:], len(text)])]
        self.defines: dict[int, int] = {}  # line -> indent of the definition that begins there
        if language is None:
            return
        words, before = _DEFINES[language]
        line = 0
        i = 0
        toks = tokens(text, language)
        code = [False] * n
        while i < len(toks):
            kind, a, b = toks[i]
            while line + 1 < n and self.starts[line + 1] <= a:
                line += 1
            if kind == NEWLINE:
                i += 1
                continue
            last = line
            while last + 1 < n and self.starts[last + 1] < b:
                last += 1
                self.inside[last] = True
            if kind == COMMENT:
                for k in range(line, last + 1):
                    self.only_comment[k] = self.only_comment[k] or not code[k]
                i += 1
                continue
            begins = not code[line] and not self.inside[line]
            for k in range(line, last + 1):
                code[k] = True
                self.only_comment[k] = False
            if begins and not text[self.starts[line] : a].strip():
                indent = a - self.starts[line]
                sign = text[a:b]
                if sign == "@" and language != "go" or sign == "#" and language == "rust":
                    if not (language == "java" and i + 1 < len(toks) and text[toks[i + 1][1] : toks[i + 1][2]] == "interface"):
                        i = self._attribute(text, language, toks, i, line, code)
                        if i < len(toks) and toks[i][0] != NEWLINE and toks[i][0] != COMMENT:  # code follows on the attribute's last line
                            at = line
                            while at + 1 < n and self.starts[at + 1] <= toks[i][1]:
                                at += 1
                            if self._defines(text, language, toks, i, words, before):
                                self.defines[line] = indent
                                for k in range(line, at + 1):
                                    self.attribute[k] = False
                        continue
                if kind == NAME and self._defines(text, language, toks, i, words, before):
                    self.defines[line] = indent
            i += 1

    def _attribute(self, text, language, toks, i, line, code) -> int:
        """Mark the lines of a decorator, annotation or attribute; the token after it."""
        n = len(self.starts)
        depth, first = 0, i
        while i < len(toks):
            kind, a, b = toks[i]
            if kind == NEWLINE and depth == 0:
                break
            sign = text[a:b]
            if kind == SIGN:
                if sign in "([{":
                    depth += 1
                elif sign in ")]}":
                    depth -= 1
                    if depth <= 0 and language != "python":
                        i += 1
                        if language == "rust" or i < len(toks):
                            break
            elif language != "python" and depth == 0 and i > first and kind == NAME and toks[i - 1][0] == NAME:
                break  # `@Name class ...`
            i += 1
        end = toks[min(i, len(toks)) - 1][2] if i else 0
        k = line
        while k < n and self.starts[k] < end:
            self.attribute[k] = True
            code[k] = True
            self.only_comment[k] = False
            k += 1
        return i

    @staticmethod
    def _defines(text, language, toks, i, words, before) -> bool:
        seen = 0
        while i < len(toks) and seen < 12:
            kind, a, b = toks[i]
            word = text[a:b]
            if kind == NAME and word in words and not (word == "union" and toks[i + 1 : i + 2] and toks[i + 1][0] != NAME):
                if language == "go" and word == "type":
                    rest = [text[t[1] : t[2]] for t in toks[i + 1 : i + 40] if t[0] != NEWLINE]
                    return len(rest) > 1 and ("struct" in rest[1:2] or "interface" in rest[1:2] or rest[1] == "[" and ("struct" in rest or "interface" in rest))
                if word == "record" or word in ("enum", "interface"):
                    return i + 1 < len(toks) and toks[i + 1][0] == NAME
                return True
            if language == "rust" and (kind == STRING or word in "()" or word in ("crate", "super", "self", "in", "::")) and seen:
                pass
            elif language == "java" and word == "-":
                pass
            elif kind != NAME or word not in before:
                return False
            seen += 1
            i += 1
        return False

    def line_of(self, position: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, position) - 1

    def head(self, line: int) -> int:
        """First line of the attributes and comments directly above a definition."""
        while line > 0 and (self.only_comment[line - 1] or self.attribute[line - 1]):
            line -= 1
        return line

    def top_level(self) -> list[int]:
        """First lines of the definitions that begin at column 0, or at the text's own indent if nothing does."""
        base = min(self.defines.values(), default=0)
        return [self.head(k) for k in sorted(self.defines) if self.defines[k] == base]
