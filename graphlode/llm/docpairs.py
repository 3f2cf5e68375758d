"""Functions paired with their documentation.

Recursive patterns of the regex library capture the comments and attributes above a definition, its
signature and its balanced body in one match. Strings, comments and regular expressions are atoms of these
patterns, so that brackets and definitions within them mean nothing. A class is captured in the same way and
its inside searched for methods. Python bodies are balanced by indent instead of brackets.

Captures without use are dropped: blank text, the function's name in other words, names of parameters,
placeholders, directives, rows of signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.sources.lexing import language_of
from graphlode.plans.session import spread

#: Texts that stand where a description is missing, without case, signs around them or a stop at the end.
PLACEHOLDERS = {
    "auto-generated method stub", "description", "docs", "documentation", "document", "document me", "doc", "function description", "inheritdoc", "@inheritdoc", "missing", "method description", "n/a", "na", "nil",
    "no description", "no description provided", "no docs", "none", "null", "placeholder", "see code", "see source", "stub", "tba", "tbd", "undefined", "undocumented", "wip", "xxx",
}
_MARKS = r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack)\b"
_DIRECTIVE = r"(?i)^\W*(?:eslint|noqa|nolint|pylint|prettier-ignore|istanbul|@ts-|ts-ignore|type:\s*ignore|fmt:\s*(?:off|on|skip)|go:\w+|mypy:|ruff:|@?suppresswarnings|clippy::|rustfmt|jshint|jslint|global\s|c8\s|isort:|pragma)"
_TAGS = r"(?im)^[ \t*]*(?:[@\\](?:param|arg|argument|returns?|throws|exception|example|since|author|see|type|deprecated|template|yields?)\b|:(?:param|type|return|returns|rtype|raises)\b|(?:args|arguments|parameters|params|returns?|raises|yields|examples?|note)\s*:[ \t]*$)[\s\S]*\Z"
_FILLER = {"the", "a", "an", "function", "method", "to", "this", "of", "func", "procedure", "routine", "that", "which", "will", "def", "it"}

_STRINGS = {
    "go": r"`[^`]*+`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'",
    "java": r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'",
    "rust": r"\b(?:br|r)(?P<fence>\#*)\"(?:(?!\"(?P=fence))[\s\S])*+\"(?P=fence)|\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]{2}|.))'",
    "javascript": r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|(?P<template>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$(?&braces))*+`)|(?<=[(=:,;!&|?{}\[>\n]\s{0,40}|\breturn\s)/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[\w$]*+",
}
_COMMENTS = {"go": r"//[^\n]*+|/\*[\s\S]*?\*/", "java": r"//[^\n]*+|/\*[\s\S]*?\*/", "javascript": r"//[^\n]*+|/\*[\s\S]*?\*/", "rust": r"//[^\n]*+|(?P<nest>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&nest))*+\*/)"}
_ATTRIBUTE = {"go": r"(?!)", "java": r"@(?!interface\b)[\w.]++(?:[ \t]*+(?&parens))?", "javascript": r"@[\w.$]++(?:[ \t]*+(?&parens))?", "rust": r"\#!?(?&squares)"}
_JS_FUNCTION = r"(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:async\s++)?function\s*+\*?\s*+(?P<name>[\w$]++)\s*+(?&angles)?\s*+(?P<params>(?&parens))\s*+(?::(?:[^{};=()]|(?&parens)|\{[^{};]*+\}(?=\s*+[>|&\[{]))++)?"
_FUNCTIONS = {
    "go": r"func\s++(?:\((?P<receiver>[^()]*+)\)\s*+)?(?P<name>\w++)\s*+(?&squares)?\s*+(?P<params>(?&parens))(?:[^{}\n()\"`]|(?&parens)|\b(?:interface|struct)\s*+\{[^{}]*+\})*+",
    "java": r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s++)*+(?:<(?:[^<>{}();]|<[^<>]*+>)*+>\s*+)?(?:[\w.$]++(?:\s*+(?&angles))?(?:\s*+\[\s*+\])*+\s++)?(?P<name>[\w$]++)\s*+(?P<params>(?&parens))(?:\s*+\[\s*+\])*+\s*+(?:throws\s++[\w.,\s]++)?",
    "rust": r"(?:pub(?:\s*+\([^()]*+\))?\s++)?(?:default\s++)?(?:const\s++)?(?:async\s++)?(?:unsafe\s++)?(?:extern\s++(?:\"[^\"]*+\"\s*+)?)?fn\s++(?P<name>\w++)\s*+(?:<(?:[^<>{}();]|->|<(?:[^<>]|<[^<>]*+>)*+>)*+>)?\s*+(?P<params>(?&parens))(?:[^{};\"])*+",
    "javascript": _JS_FUNCTION,
}
_METHOD = r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|accessor)\s++(?=[\w$#*\[]))*+\*?\s*+(?P<name>(?!(?:if|for|while|switch|catch|with|function|return)\b)\#?[\w$]++)\s*+(?&angles)?\s*+(?P<params>(?&parens))\s*+(?::(?:[^{};=()]|(?&parens)|\{[^{};]*+\}(?=\s*+[>|&\[{]))++)?"
_CLASSES = {
    "go": r"(?!)",
    "java": r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s++)*+(?:class|interface|enum|record)\s++(?P<class>[\w$]++)[^{};]*+",
    "rust": r"(?:unsafe\s++)?(?:impl\b\s*+(?:<(?:[^<>]|<[^<>]*+>)*+>)?\s*+(?:[^{};]*?\bfor\s++)?&?(?:mut\s++)?(?:\w++::)*+(?P<class>\w++)[^{};]*+|(?:pub(?:\s*+\([^()]*+\))?\s++)?trait\s++(?P<class>\w++)[^{};]*+)",
    "javascript": r"(?:export\s++)?(?:default\s++)?(?:declare\s++)?(?:abstract\s++)?(?:class|interface)\s++(?P<class>(?!extends\b|implements\b)[\w$]++)[^{};]*+",
}


def _run(language: str) -> str:
    """Code without a sign that could begin a string, a comment or a bracket; it is the most of a text and tried first."""
    signs = r"(){}\[\]\"'`/\#@"
    return rf"(?:[^{signs}br]++|[br](?!r?\#*+\"))++" if language == "rust" else rf"[^{signs}]++"


def _nested(language: str, mark: str) -> str:
    """Balanced brackets; those behind the mark never close."""
    free = f"(?<!{mark})" if mark else ""
    inside = rf"(?:{_run(language)}|(?&parens)|(?&braces)|(?&squares)|(?&string)|(?&comment)|[br]|'(?![^'\n]?')|[/\#@'\"`])*+"
    return rf"""(?P<braces>{free}\{{{inside}\}})
        (?P<parens>{free}\({inside}\))
        (?P<squares>{free}\[{inside}\])"""


@lru_cache(None)
def _pattern(language: str, inside: bool, mark: str = "", unclosed: bool = False):
    """The pattern of one language; ``inside`` a class body, methods are definitions too.

    A class that never closes is a type without members; what follows it may be inside or, ``unclosed``, not.
    """
    import regex

    strings, comments = _STRINGS[language], _COMMENTS[language]
    function = _FUNCTIONS[language]
    if language == "javascript" and inside:
        function = rf"(?P<free>{_JS_FUNCTION})|{_METHOD}" if unclosed else _METHOD
    if language == "java" and not inside:
        function = r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s++)*+(?:<(?:[^<>{}();]|<[^<>]*+>)*+>\s*+)?(?:[\w.$]++(?:\s*+(?&angles))?(?:\s*+\[\s*+\])*+\s++)(?P<name>[\w$]++)\s*+(?P<params>(?&parens))\s*+(?:throws\s++[\w.,\s]++)?"
    never = rf"|(?<={mark})\{{" if mark else ""
    skip = (r"[;,)}\]]" if language == "javascript" and inside else r"[\s;,)}\]]") + (rf"|{mark}[(\[{{]" if mark else "")  # where nothing begins
    text = rf"""(?(DEFINE)
        (?P<string>{strings})
        (?P<comment>{comments})
        {_nested(language, mark)}
        (?P<angles><(?:[^<>(){{}};]|(?&angles)|(?&parens)|=>)*+>)
      )
      (?:{skip})++|(?P<lead>(?:(?:(?&comment)|{_ATTRIBUTE[language]})[ \t]*+(?:\r?\n[ \t]*+)?)*+)
      (?<![\w$.])(?:(?P<function>{function})\s*+(?P<body>(?&braces))|(?P<type>{_CLASSES[language]})(?:(?P<members>(?&braces)){never}))
      |{"" if language == "rust" else r"[\w$]++|"}(?&string)|(?&comment)|(?&braces)|[\w$]++|."""
    return regex.compile(text, regex.VERBOSE | regex.DOTALL | regex.VERSION1)


@lru_cache(1)
def _python():
    import regex

    return regex.compile(
        r"""(?(DEFINE)
          (?P<long>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''))
          (?P<string>(?&long)|[rRbBuUfFtT]{0,2}(?:\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'))
          (?P<nest>[(\[{](?:[^()\[\]{}\"'\#]++|(?&string)|\#[^\n]*+|(?&nest)|["'])*+[)\]}])
          (?P<line>(?:[^\n\"'\#()\[\]{}\\]++|\\\r?\n|(?&string)|\#[^\n]*+|(?&nest)|["'()\[\]{}\\])*+(?:\n|\Z))
        )
        ^(?P<indent>[ \t]*+)(?P<lead>)(?:
            (?P<function>(?:async[ \t]++)?def[ \t]++(?P<name>\w++)[ \t]*+(?:\[[^\]]*+\])?(?P<params>(?&nest))[^:\n]*+:)
          | (?P<type>class[ \t]++(?P<class>\w++)[^:\n(]*+(?&nest)?[^:\n]*+:)
        )
        (?P<body>(?&line)(?:(?:[ \t]*+\r?\n)|(?=(?P=indent)[ \t])(?&line)|[ \t]*+\#[^\n]*+(?:\n|\Z))*+)
        |(?&line)|.""",
        regex.VERBOSE | regex.MULTILINE | regex.VERSION1,
    )


@lru_cache(1)
def _docstring():
    import regex

    return regex.compile(r"""\A(?:[ \t]*+(?:\#[^\n]*+)?\r?\n)*+[ \t]*+[rRuU]?(?P<q>\"\"\"|'''|\"|')(?P<doc>(?:(?!(?P=q))(?:\\[\s\S]|[\s\S]))*+)(?P=q)""", regex.VERSION1)


def extract(text: str, language: str | None, outer: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(local name, description, parameters, code) of each function and method; outer is the class that is open."""
    if language is None or not text or not text.strip():
        return
    text = text.replace("\r\n", "\n")
    if language == "python":
        yield from _extract_python(text, outer)
        return
    language = "javascript" if language == "typescript" else language
    yield from _extract_braces(*_marked(text, language), language, outer)


@lru_cache(None)
def _brackets(language: str):
    """Each bracket of code, with the atoms before it."""
    import regex

    text = rf"""(?(DEFINE)
        (?P<string>{_STRINGS[language]})
        (?P<comment>{_COMMENTS[language]})
        {_nested(language, "")}
      )
      (?:{_run(language)}|(?&string)|(?&comment)|[br]|["'`/\#@])*+(?:(?P<bracket>[(){{}}\[\]])|\Z)"""
    return regex.compile(text, regex.VERBOSE | regex.DOTALL | regex.VERSION1)


def _marked(text: str, language: str) -> tuple[str, str]:
    """(text, mark): the mark, a character of no other use in the text, stands before each bracket that never closes.

    Such a bracket fails at once in the patterns, instead of being searched to the end of the text. The mark is
    empty where all brackets close.
    """
    opening = {")": "(", "]": "[", "}": "{"}
    open_: list[int] = []
    never: list[int] = []
    for m in _brackets(language).finditer(text):
        c = m["bracket"]
        if not c:
            continue
        if c not in opening:
            open_.append(m.end() - 1)
        elif open_ and text[open_[-1]] == opening[c]:
            open_.pop()
        else:  # the wrong one: nothing around it is balanced
            never += open_
            open_.clear()
    never += open_
    if not never:
        return text, ""
    never.sort()
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)
    return mark.join(text[a:b] for a, b in zip([0, *never], [*never, len(text)])), mark


def _extract_python(text: str, outer: str) -> Iterator[tuple[str, str, str, str]]:
    for m in _python().finditer(text):
        if m["function"]:
            doc = _docstring().match(m["body"])
            yield outer + m["name"], doc["doc"] if doc else "", m["params"], m[0]
        elif m["type"]:
            yield from _extract_python(m["body"], outer + m["class"] + ".")


def _extract_braces(text: str, mark: str, language: str, outer: str) -> Iterator[tuple[str, str, str, str]]:
    at, column = 0, -1  # column: the indent of the class that never closes, after its line
    while at >= 0:
        matches = _pattern(language, bool(outer), mark, column >= 0).finditer(text, at)
        start, at = at, -1
        for m in matches:
            if m["function"]:
                name = m["name"]
                if language == "go" and m["receiver"]:
                    kind = m["receiver"].split()[-1].lstrip("*").split("[")[0]
                    name = f"{kind}.{name}"
                elif language == "java" and name in ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new"):
                    continue
                owner = outer
                if column >= 0 and (language == "javascript" and m["free"] or language == "rust" and "\n" in text[start : m.start("function")] and _indent(text, m.start("function")) <= column):
                    owner = ""
                lead, params, code = (x.replace(mark, "") if mark else x for x in (m["lead"], m["params"], m[0]))
                yield owner + name, description(lead, language, name.rpartition(".")[2]), params, code
            elif m["type"]:
                if m["members"]:
                    yield from _extract_braces(m["members"][1:-1], "", language, m["class"] + ".")
                else:
                    outer, at, column = m["class"] + ".", m.end(), _indent(text, m.start("type"))
                    break


def _indent(text: str, at: int) -> int:
    """White space before the first sign of the line of ``at``."""
    line = text[text.rfind("\n", 0, at) + 1 : at + 1]
    return len(line) - len(line.lstrip())


def description(lead: str, language: str, name: str) -> str:
    """The text of the documentation comment in what stands above a definition."""
    import regex

    if not lead:
        return ""
    if language == "go":
        kept: list[str] = []
        for line in lead.split("\n"):
            line = line.strip()
            if line.startswith("//"):
                if not regex.match(r"//(?:[a-z]+:|nolint|line )", line):
                    kept.append(line[2:].strip())
            elif line:
                kept = []  # a block comment in between: what is above it is not directly above
        text = "\n".join(kept).strip()
        return regex.sub(rf"\A{regex.escape(name)}\b[:.,]?\s*", "", text)
    parts = []
    blocks = regex.findall(r"/\*\*(?![*/])((?:(?!\*/).)*+)\*/|/\*\*/", lead, regex.DOTALL)
    parts += [regex.sub(r"(?m)^[ \t]*\*?[ \t]?", "", b) for b in blocks[-1:]]
    if language == "rust":
        parts += ["\n".join(x for x in regex.findall(r"(?m)^[ \t]*///(?!/)[ \t]?([^\n]*)", lead))]
        parts += regex.findall(r"#\[\s*doc\s*=\s*r?#*\"((?:[^\"\\]|\\.)*)\"", lead)
    return "\n".join(p.strip() for p in parts if p.strip())


@lru_cache(1)
def _words():
    import regex

    return regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Lo}+|\p{N}+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _words().findall(text)]


def useful(text: str | None, name: str, params: str = "") -> str | None:
    """The description without its tags, or None if it says nothing."""
    import regex

    if not text:
        return None
    text = text.strip()
    lead = regex.sub(_TAGS, "", text).strip()
    if not regex.search(r"[\p{L}\p{N}]", lead):
        return None
    if regex.match(_MARKS, lead) or regex.match(_DIRECTIVE, lead):
        return None
    plain = regex.sub(r"\s+", " ", lead.lower()).strip(" .!:;*{}()[]<>-_/\"'`")
    if plain in PLACEHOLDERS or lead.lower().strip() in PLACEHOLDERS:
        return None
    said, named = [w for w in words(lead) if w not in _FILLER], words(name)
    if not said:
        return None
    rest = list(named)
    for w in said:
        hit = next((x for x in rest if w == x or (w[: len(x) - 1] == x[:-1] and len(x) > 2 and w[len(x) - 1 :] in (x[-1] + "s", x[-1] + "es", x[-1] + "ed", x[-1] + "d", x[-1] + "ing", "ing", "ed", "ies"))), None)
        if hit is None:
            break
        rest.remove(hit)
    else:
        return None
    if params:
        listed = {w for p in regex.findall(r"[\p{L}_$][\w$]*", params) for w in (p.lower(), *words(p))}
        if all(w in listed or w in ("param", "params", "args", "arguments", "returns", "return", "and") for w in words(lead)):
            return None
    return lead


def pairs(df: DataFrame) -> DataFrame:
    """(project, qualified_name, description, code): one row for each function with code and a useful description.

    df has project, qualified_name, type, file_path, docstring and source_code. Rows of type Function and Method
    give their own function, Module and Class rows all functions within them. Description and code may come
    from different rows; the longest of each is kept (ties by the greater text). Blank source is no code; rows without a
    file path or of an unknown language only give what their columns hold.
    """
    source = spread(df.select("project", "qualified_name", "type", "file_path", "docstring", "source_code").where("qualified_name is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def add(project, qn, text, code):
                for column, value in zip(out, (project, qn, text, code)):
                    column.append(value)

            for project, qn, kind, path, doc, code in zip(*(b.column(i).to_pylist() for i in range(6))):
                has_code = bool(code and code.strip())
                file, _, local = qn.rpartition(":")
                file, local = (path or file, local) if file else (path or qn, "")
                language = language_of(file)
                if kind in ("Function", "Method"):
                    name = local.rpartition(".")[2]
                    params = ""
                    if has_code:
                        outer = local.rpartition(".")[0]
                        found = list(extract(code, language, outer + "." if outer and language != "go" else "")) or (list(extract(code, language)) if outer else [])
                        for full, text, params_, _ in found:
                            if full.rpartition(".")[2] == name:
                                params = params_
                                add(project, qn, useful(text, name, params), code)
                                break
                        else:
                            add(project, qn, None, code)
                    add(project, qn, useful(doc, name, params), None)
                elif kind in ("Module", "Class") and has_code:
                    for full, text, params, part in extract(code, language):
                        add(project, f"{file}:{full}", useful(text, full.rpartition(".")[2], params), part)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["project", "qualified_name", "description", "code"])

    found = source.mapInArrow(run, "project string, qualified_name string, description string, code string")
    longest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.length(c).alias("n"), F.col(c).alias("text"))))["text"].alias(c)
    return found.groupBy("project", "qualified_name").agg(longest("description"), longest("code")).where("description is not null and code is not null")
