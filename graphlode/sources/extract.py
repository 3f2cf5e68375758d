"""From source text to rows: definitions, bases, imports, calls, fields, types, comments and literals.

``facts`` is a table-generating function over (project, path, text): each file is read once, where it is, and gives many
flat rows. Python goes through its own ``ast``; TypeScript, JavaScript, Go, Rust and Java through a token walk that
keeps a stack of scopes. Other languages give their module and comment rows only.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.plans.session import spread
from graphlode.sources import lexing

SCHEMA = (
    "project string, path string, kind string, name string, qn string, owner string, start_line int, end_line int, parameters array<string>, decorators array<string>, docstring string, exported boolean, text string, target string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Calls of these names are builtin nodes in JavaScript and TypeScript.
BUILTINS = {
    "Object.create", "Object.keys", "Object.values", "Object.entries", "Object.assign", "Object.freeze", "Object.seal", "Object.defineProperty", "Object.getPrototypeOf", "Object.setPrototypeOf", "Array.from",
    "Array.of", "Array.isArray", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURIComponent", "decodeURIComponent", "setTimeout", "clearTimeout", "setInterval", "clearInterval", "console.log",
    "console.error", "console.warn", "console.info", "console.debug", "JSON.parse", "JSON.stringify", "Math.random", "Math.floor", "Math.ceil", "Math.round", "Math.abs", "Math.max", "Math.min", "Date.now", "Date.parse",
}


@dataclass
class Fact:
    kind: str
    name: str
    qn: str = ""
    owner: str = ""
    start_line: int = 0
    end_line: int = 0
    parameters: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    docstring: str | None = None
    exported: bool = False
    text: str | None = None
    target: str | None = None


def extract(text: str, path: str) -> Iterator[Fact]:
    """All facts of one file. A Python file that does not parse gives its module row only."""
    lines = text.count("\n") + 1
    yield Fact("module", path.rpartition("/")[2], path, "", 1, lines)
    language = lexing.language_of(path)
    if language == "python":
        yield from _python(text, path)
    elif language:
        yield from _braces(text, path, language)


# -- Python ----------------------------------------------------------------------------------------------------
def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    return None


def _python(text: str, path: str) -> Iterator[Fact]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    out: list[Fact] = []

    def calls(node: ast.AST, owner: str, cls: str) -> None:
        for child in ast.walk(node):
            if isinstance(child, ast.Call) and (target := _dotted(child.func)):
                out.append(Fact("call", target, owner=owner, start_line=child.lineno, text=cls))

    def visit(body: list[ast.stmt], prefix: str, cls: str) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                local = f"{prefix}{s.name}"
                qn = f"{path}:{local}"
                args = [a.arg for a in (*s.args.posonlyargs, *s.args.args, *([s.args.vararg] if s.args.vararg else []), *s.args.kwonlyargs, *([s.args.kwarg] if s.args.kwarg else []))]
                first = min([s.lineno, *(d.lineno for d in s.decorator_list)])
                decorators = [x for d in s.decorator_list if (x := _dotted(d.func if isinstance(d, ast.Call) else d))]
                out.append(Fact("method" if cls and prefix == cls + "." else "function", s.name, qn, cls, first, s.end_lineno or s.lineno, args, decorators, ast.get_docstring(s), not s.name.startswith("_")))
                if s.returns is not None:
                    out.append(Fact("return", local, qn, cls, s.lineno, target=ast.unparse(s.returns)))
                for a in (*s.args.args, *s.args.kwonlyargs):
                    if a.annotation is not None:
                        out.append(Fact("variable", a.arg, owner=qn, start_line=s.lineno, target=ast.unparse(a.annotation)))
                for child in ast.walk(s):
                    if isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and len(child.targets) == 1:
                        made, to = _dotted(child.value.func), _dotted(child.targets[0])
                        if made and to and made.rpartition(".")[2][:1].isupper():
                            if to.startswith("self.") and to.count(".") == 1:
                                out.append(Fact("field", to[5:], owner=cls, start_line=child.lineno, target=made))
                            elif "." not in to:
                                out.append(Fact("variable", to, owner=qn, start_line=child.lineno, target=made))
                    elif isinstance(child, ast.AnnAssign) and (to := _dotted(child.target)) and to.startswith("self."):
                        out.append(Fact("field", to[5:], owner=cls, start_line=child.lineno, target=ast.unparse(child.annotation)))
                calls(s, qn, cls)
                visit(s.body, f"{local}.", cls)
            elif isinstance(s, ast.ClassDef):
                name = f"{prefix}{s.name}"
                out.append(Fact("class", s.name, f"{path}:{name}", "", min([s.lineno, *(d.lineno for d in s.decorator_list)]), s.end_lineno or s.lineno, [], [x for d in s.decorator_list if (x := _dotted(d.func if isinstance(d, ast.Call) else d))], ast.get_docstring(s), not s.name.startswith("_")))
                out.extend(Fact("base", x, f"{path}:{name}", name, s.lineno) for b in s.bases if (x := _dotted(b)))
                for c in s.body:
                    if isinstance(c, ast.AnnAssign) and isinstance(c.target, ast.Name):
                        out.append(Fact("field", c.target.id, owner=name, start_line=c.lineno, target=ast.unparse(c.annotation)))
                visit(s.body, f"{name}.", name)
            elif isinstance(s, ast.Import):
                out.extend(Fact("import", a.asname or a.name, start_line=s.lineno, target=a.name) for a in s.names)
            elif isinstance(s, ast.ImportFrom):
                base = "." * s.level + (s.module or "")
                out.extend(Fact("import", a.asname or a.name, start_line=s.lineno, text="from", target=base if a.name == "*" else f"{base}:{a.name}") for a in s.names)
            elif isinstance(s, (ast.If, ast.Try, ast.With)):
                for part in (s.body, getattr(s, "orelse", []), getattr(s, "finalbody", [])):
                    visit(part, prefix, cls)

    visit(tree.body, "", "")
    for s in tree.body:
        if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            calls(s, path, "")
    yield from out
    line = 1
    for kind, a, b in lexing.tokens(text, "python"):
        if kind == lexing.COMMENT:
            line = text.count("\n", 0, a) + 1
            body = text[a:b].lstrip("#").strip()
            column = a - (text.rfind("\n", 0, a) + 1)
            yield Fact("comment", body[:80], f"{path}:comment@{line}:{column}", "", line, line, text=body)


# -- languages with braces -------------------------------------------------------------------------------------
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "else", "do", "throw", "super", "sizeof", "with", "in", "of", "case", "try", "assert", "yield"}
_MORE = {"go": {"func", "go", "defer", "range", "select", "make"}, "rust": {"fn", "match", "loop", "move", "where", "impl", "unsafe"}, "java": {"synchronized"}}
_CLASS_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "struct": "class", "trait": "interface", "record": "class", "union": "class"}


_ATTRIBUTES = re.compile(r"@[\w.$]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?|#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]")
_MODIFIERS = {"private", "public", "protected", "readonly", "override"}


def _braces(text: str, path: str, language: str) -> Iterator[Fact]:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    from bisect import bisect_right

    at_line = lambda p: bisect_right(starts, p)
    raw = lexing.tokens(text, language)
    code = [(k, text[a:b], a, b) for k, a, b in raw if k not in (lexing.COMMENT, lexing.NEWLINE)]
    comments = [(a, b) for k, a, b in raw if k == lexing.COMMENT]
    ends = [b for _, b in comments]

    def doc(position: int) -> str | None:
        """The comment directly above: nothing but layout, attributes and modifiers between."""
        i = bisect_right(ends, position) - 1
        if i < 0:
            return None
        between = _ATTRIBUTES.sub("", text[comments[i][1] : position])  # any number of them
        if sum(1 for x in between.split("\n") if x.strip()) > 3 or re.search(r"\n\s*\n", text[comments[i][1] : position]) or not re.fullmatch(r"[\s\w@#\[\]()=\",.<>:&?']*", between) or ";" in between:
            return None
        a, b = comments[i]
        if text.startswith("//", a):
            while i > 0 and text.startswith("//", comments[i - 1][0]) and not text[comments[i - 1][1] : a].strip() and text.count("\n", comments[i - 1][1], a) == 1:
                i -= 1
                a = comments[i][0]
        body = "\n".join(re.sub(r"^\s*(?:/\*+|\*+/|///?!?|\*)\s?|\s*\*+/\s*$", "", x) for x in text[a:b].split("\n")).strip()
        return body or None

    keywords = _KEYWORDS | _MORE.get(language, set())
    depth = 0
    scopes: list[tuple[int, str, str, Fact]] = []  # depth within, kind, local name, fact
    pending: tuple[str, str, Fact] | None = None
    out: list[Fact] = []
    parens = 0
    n = len(code)
    env: dict[tuple[str, str], str] = {}  # (scope, variable): type

    def cls() -> str:
        return next((s[2] for s in reversed(scopes) if s[1] == "class"), "")

    def inner() -> str:
        return next((s[3].qn for s in reversed(scopes) if s[1] == "function"), path)

    def group(i: int, opening: str, closing: str) -> int:
        """The index after the bracket that closes the one at i."""
        d = 0
        while i < n:
            d += code[i][1] == opening
            d -= code[i][1] == closing
            i += 1
            if not d:
                break
        return i

    def parameters(i: int) -> tuple[list[str], int]:
        end = group(i, "(", ")")
        names_, d, fresh = [], 0, True
        for k in range(i + 1, end - 1):
            kind, word = code[k][0], code[k][1]
            if word in "([{<":
                d += 1
            elif word in ")]}>":
                d -= 1
            elif word == "," and d <= 0:
                fresh = True
            elif kind == lexing.NAME and d <= 0 and fresh and word not in ("mut", "final", "private", "public", "protected", "readonly", "ref", "const", "var", "static"):
                if language == "java" and k + 1 < end - 1 and (code[k + 1][0] == lexing.NAME or code[k + 1][1] in "<[." or code[k + 1][1] == "..."):
                    j = k + 1
                    if code[j][1] == "<":
                        dd = 0
                        while j < end - 1:
                            dd += (code[j][1] == "<") - (code[j][1] == ">")
                            j += 1
                            if not dd:
                                break
                    while j < end - 1 and code[j][1] in ("[", "]", ".", "..."):
                        j += 1
                    if j < end - 1 and code[j][0] == lexing.NAME:
                        names_.append(code[j][1])
                        fresh = False
                        continue
                names_.append(word)
                fresh = False
        return names_, end

    def type_end(i: int) -> int:
        """The index after the TypeScript type that begins at i."""
        d, wanted = 0, True  # wanted: a part of the type must follow
        while i < n:
            w = code[i][1]
            if w in ("<", "(", "[") or w == "{" and (d or wanted):
                d, wanted = d + 1, True
            elif w in (">", ")", "]", "}"):
                if not d:
                    return i
                d, wanted = d - 1, False
            elif not d:
                if w in ("|", "&", "=>", ".", "is", "keyof", "typeof", "readonly", "infer", "new", "extends", "?", ":"):
                    if w in ("?", ":") and wanted:
                        return i
                    wanted = True
                elif w in (";", ",", "=", "{") or not wanted:
                    return i
                else:
                    wanted = False
            i += 1
        return n

    def written(a: int, z: int) -> str:
        return "".join(x[1] + (" " if x[0] == lexing.NAME and k + 1 < z and code[k + 1][0] == lexing.NAME else "") for k, x in enumerate(code[a:z], a))

    def typed(i: int, end: int) -> list[tuple[str, bool, str]]:
        """(name, whether it has a modifier, type) of the annotated parameters of a TypeScript list."""
        if language != "typescript":
            return []
        found, k, modified, d = [], i + 1, False, 0
        while k < end - 1:
            word = code[k][1]
            after = k + 1 + (code[k + 1][1] == "?") if k + 1 < end else k + 1
            if d == 0 and code[k][0] == lexing.NAME and after < end and code[after][1] == ":" and code[k - 1][1] in ("(", ",", *_MODIFIERS):
                z = min(type_end(after + 1), end - 1)
                found.append((word, modified, written(after + 1, z)))
                k = z
                continue
            modified = d == 0 and word in _MODIFIERS or modified and word != ","
            d += (word in "([{") - (word in ")]}")
            k += 1
        return found

    def callback(j: int) -> tuple[int, list[str], str, int] | None:
        """(index of its body, parameters, return type, index of its first sign) if a function expression begins at j."""
        first = j
        if j < n and code[j][1] == "async":
            j += 1
        if j < n and code[j][1] == "function":
            j += 1 + (j + 1 < n and code[j + 1][1] == "*")
            j += j < n and code[j][0] == lexing.NAME
            arrow = False
        else:
            arrow = True
        if j < n and code[j][1] == "<":
            j = group(j, "<", ">")
        if arrow and j + 1 < n and code[j][0] == lexing.NAME and code[j + 1][1] == "=>":
            return j + 2, [code[j][1]], "", first
        if j >= n or code[j][1] != "(":
            return None
        args, k = parameters(j)
        result = ""
        if k < n and code[k][1] == ":":
            z = type_end(k + 1)
            # the arrow of the function itself ends its type, unless the type is one of a function
            if arrow and (cut := next((m for m in range(z - 1, k, -1) if code[m][1] == "=>"), None)) is not None and not (z < n and code[z][1] == "=>"):
                z = cut
            result, k = written(k + 1, z), z
        if arrow:
            return (k + 1, args, result, first) if k < n and code[k][1] == "=>" else None
        return (k, args, result, first) if k < n and code[k][1] == "{" else None

    def begin(kind: str, local: str, fact: Fact) -> None:
        nonlocal pending
        out.append(fact)
        pending = (kind, local, fact)

    i = 0
    while i < n:
        kind, word, a, b = code[i]
        previous = code[i - 1][1] if i else ""
        in_class = bool(scopes) and scopes[-1][1] == "class" and scopes[-1][0] == depth and not pending
        if word == "{":
            depth += 1
            if pending and parens == 0:
                scopes.append((depth, pending[0], pending[1], pending[2]))
                pending = None
        elif word == "}":
            if scopes and scopes[-1][0] == depth:
                scopes.pop()[3].end_line = at_line(a)
            depth = max(0, depth - 1)
        elif word == "(":
            parens += 1
        elif word == ")":
            parens = max(0, parens - 1)
        elif word == ";" and pending and parens == 0:
            pending = None
        elif kind == lexing.NAME and parens >= 0:
            nxt = code[i + 1][1] if i + 1 < n else ""
            line = at_line(a)
            exported = _exported(language, code, i, word, nxt)
            if word in _CLASS_WORDS and i + 1 < n and code[i + 1][0] == lexing.NAME and previous not in (".", "::") and not (language == "go"):
                name = nxt
                begin("class", name, Fact(_CLASS_WORDS[word], name, f"{path}:{name}", "", line, line, [], _annotations(language, code, i), doc(a), exported))
                j = i + 2
                mode, begins, angle = "", False, 0
                while j < n and (angle or code[j][1] not in ("{", ";", "(")):
                    w = code[j][1]
                    if w in "<>":
                        angle = max(0, angle + (1 if w == "<" else -1))
                    elif angle:
                        pass  # type parameters and arguments are no bases
                    elif w in ("extends", "implements"):
                        mode, begins = w, True
                    elif w == ",":
                        begins = True
                    elif mode and begins and code[j][0] == lexing.NAME:
                        while j + 2 < n and code[j + 1][1] == "." and code[j + 2][0] == lexing.NAME:
                            j += 2  # of a dotted name the last part
                        out.append(Fact("implements" if mode == "implements" else "base", code[j][1], f"{path}:{name}", name, line))
                        begins = False
                    j += 1
                i += 2
                continue
            if language == "go" and word == "type" and i + 2 < n and code[i + 2][1] in ("struct", "interface"):
                fact = Fact("class" if code[i + 2][1] == "struct" else "interface", nxt, f"{path}:{nxt}", "", line, line, [], [], doc(a), nxt[:1].isupper())
                begin("class", nxt, fact)
                i += 3
                continue
            if language == "rust" and word == "impl":
                j = i + 1
                words = []
                while j < n and code[j][1] not in ("{", ";"):
                    words.append(code[j][1])
                    j += 1
                flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", " ".join(words))).split(" where ")[0].split(" for ")
                own = (flat[-1].split() or [""])[-1]
                fact = Fact("impl", own, f"{path}:{own}", "", line, line)
                pending = ("class", own, fact)
                if len(flat) == 2 and flat[0].split():
                    out.append(Fact("implements", flat[0].split()[-1], f"{path}:{own}", own, line))
                i = j
                continue
            named = None
            if word in ("function", "func", "fn") and previous not in (".",):
                j = i + 1
                receiver = ""
                if language == "go" and nxt == "(":
                    end = group(j, "(", ")")
                    kinds = [c[1] for c in code[j:end] if c[0] == lexing.NAME]
                    receiver = kinds[1] if len(kinds) > 1 else kinds[0] if kinds else ""
                    j = end
                if j < n and code[j][1] == "*":
                    j += 1
                if j < n and code[j][0] == lexing.NAME:
                    named = (code[j][1], j + 1, receiver or (cls() if in_class else ""))
            elif in_class and (nxt == "(" or nxt == "<" and (g := group(i + 1, "<", ">")) < n and code[g][1] == "(") and word not in keywords and language in ("java", "typescript", "javascript") and previous not in (".", "new", "=", "@"):
                named = (word, i + 1, cls())
            if named:
                name, j, owner = named
                while j < n and code[j][1] == "<" or j < n and code[j][1] not in ("(", "{", ";"):
                    j += 1
                if j < n and code[j][1] == "(":
                    args, end = parameters(j)
                    k = type_end(end + 1) if language == "typescript" and end < n and code[end][1] == ":" else end
                    while k < n and code[k][1] not in ("{", "}", ";", "=>"):
                        k += 1
                    result = "".join(x[1] + (" " if x[0] == lexing.NAME else "") for x in code[end:k])
                    if (k < n and code[k][1] == "{") or language != "javascript" and k < n and code[k][1] in (";", "}") and in_class:
                        enclosing = next((s[2] for s in reversed(scopes) if s[1] == "function"), "")
                        local = f"{owner}.{name}" if owner else f"{enclosing}.{name}" if enclosing else name
                        fact = Fact("method" if owner else "function", name, f"{path}:{local}", owner, line, line, args, _annotations(language, code, i), doc(a), exported)
                        returned = re.sub(r"^\s*(?::|->)\s*", "", result).strip()
                        for name_, modified, kind_ in typed(j, end):
                            out.append(Fact("variable", name_, owner=fact.qn, start_line=line, target=kind_))
                            if modified and name == "constructor" and owner:
                                out.append(Fact("field", name_, owner=owner, start_line=line, target=kind_))
                        if previous == "get" and owner and returned and language in ("typescript", "javascript"):
                            out.append(Fact("field", name, owner=owner, start_line=line, target=returned))
                        begin("function", local, fact)
                        if code[k][1] != "{":  # a declaration has no body
                            pending = None
                        if returned:
                            out.append(Fact("return", local, fact.qn, owner, line, target=returned))
                        parens = 0
                        i = k
                        continue
            if word == "import" or (word == "use" and language == "rust"):
                found, i = _imports(language, code, i, path)
                out.extend(Fact("import", x, start_line=line, target=y) for x, y in found)
                continue
            if nxt == "=" and i + 2 < n and code[i + 2][1] == "require":
                if i + 4 < n and code[i + 4][0] == lexing.STRING:
                    out.append(Fact("import", word, start_line=line, target=code[i + 4][1][1:-1]))
            if word in ("const", "let", "var") and language in ("javascript", "typescript") and i + 2 < n and code[i + 1][0] == lexing.NAME and previous not in (".",):
                name, j, kind_ = nxt, i + 2, ""
                if code[j][1] == ":" and language == "typescript":
                    z = type_end(j + 1)
                    kind_, j = written(j + 1, z), z
                    out.append(Fact("variable", name, owner=inner(), start_line=line, target=kind_))
                if j + 1 < n and code[j][1] == "=":
                    found = callback(j + 1)
                    if found:
                        body, args, result, _ = found
                        enclosing = next((s[2] for s in reversed(scopes) if s[1] == "function"), "")
                        local = f"{enclosing}.{name}" if enclosing else name
                        fact = Fact("function", name, f"{path}:{local}", "", line, line, args, [], doc(a), exported)
                        if result:
                            out.append(Fact("return", local, fact.qn, "", line, target=result))
                        for name_, _, t in typed(next((m for m in range(j, body) if code[m][1] == "("), body), body):
                            out.append(Fact("variable", name_, owner=fact.qn, start_line=line, target=t))
                        if body < n and code[body][1] == "{":
                            begin("function", local, fact)
                            parens = 0
                        else:
                            out.append(fact)
                        i = body
                        continue
                    if kind_ and code[j + 1][1] == "{":
                        # an object that stands for an interface: its functions are methods
                        face = re.sub(r"[<\[].*$", "", next((x for x in kind_.replace(" ", "").split("|") if x not in ("null", "undefined", "void")), ""))
                        fact = Fact("function", name, f"{path}:{name}", "", line, line, [], [], f"Object literal implementing {face}", exported)
                        begin("object", name, fact)
                        out.append(Fact("implements", face, fact.qn, name, line))
                        parens = 0
                        i = j + 1
                        continue
                    known_ = env.get((inner(), code[j + 1][1])) or env.get((path, code[j + 1][1]))
                    if code[j + 1][0] == lexing.NAME and not kind_ and known_ and (j + 2 >= n or code[j + 2][1] not in (".", "?.", "(", "[", "<")):
                        kind_ = known_  # another name of a variable with a known type
                        out.append(Fact("variable", name, owner=inner(), start_line=line, target=kind_))
                    elif not kind_ and code[j + 1][1] != "new":
                        k = j + 1 + (code[j + 1][1] == "await")
                        chain = []
                        while k < n and code[k][0] == lexing.NAME:
                            chain.append(code[k][1])
                            if k + 1 < n and code[k + 1][1] in (".", "?."):
                                k += 2
                            else:
                                break
                        if chain and k + 1 < n and code[k + 1][1] == "(":  # what the call returns is looked up with all files
                            out.append(Fact("assigned", name, owner=inner(), start_line=line, text=cls(), target=".".join(chain)))
                    if code[j + 1][1] == "new" and j + 2 < n and code[j + 2][0] == lexing.NAME:
                        kind_ = kind_ or code[j + 2][1]
                if kind_:
                    env[inner(), name] = kind_
            if scopes and scopes[-1][1] == "object" and scopes[-1][0] == depth and not pending and previous in ("{", ",", "async", "*", "get", "set"):
                holder, found = scopes[-1][2], None
                if nxt == ":":
                    found = callback(i + 2)
                elif nxt == "(":
                    args, k = parameters(i + 1)
                    z = type_end(k + 1) if k < n and code[k][1] == ":" else k
                    found = (z, args, written(k + 1, z) if z > k else "", i) if z < n and code[z][1] == "{" else None
                if found:
                    body, args, result, _ = found
                    local = f"{holder}.{word}"
                    fact = Fact("method", word, f"{path}:{local}", holder, line, line, args, [], doc(a), False)
                    if result:
                        out.append(Fact("return", local, fact.qn, holder, line, target=result))
                    if body < n and code[body][1] == "{":
                        begin("function", local, fact)
                        parens = 0
                    else:
                        out.append(fact)
                    i = body
                    continue
            if in_class and nxt in (":", "?", "!") and previous not in ("?",) and language == "typescript":
                j = i + (2 if nxt == ":" else 3)
                if nxt == ":" or i + 2 < n and code[i + 2][1] == ":":
                    out.append(Fact("field", word, owner=cls(), start_line=line, target=written(j, type_end(j))))
            if nxt == "=" and i + 3 < n and code[i + 2][1] == "new" and code[i + 3][0] == lexing.NAME and previous not in (":", "|", "&"):
                out.append(Fact("field" if in_class or previous == "." else "variable", word, owner=cls() if in_class or previous == "." else inner(), start_line=line, target=code[i + 3][1]))
            if nxt == "(" and word not in keywords and word not in _CLASS_WORDS:
                chain, j = [word], i - 1
                while j > 0 and code[j][1] in (".", "?.", "::") and code[j - 1][0] == lexing.NAME:
                    chain.insert(0, code[j - 1][1])
                    j -= 2
                if not (j >= 0 and code[j][1] in (".", "?.")):
                    target = ".".join(chain)
                    made = j >= 0 and code[j][1] == "new"
                    out.append(Fact("call", target, owner=inner(), start_line=line, text=cls()))
                    if language in ("javascript", "typescript") and target in BUILTINS and not made:
                        column = a - starts[line - 1]
                        out.append(Fact("builtin", target, f"{path}:builtin.{target}@{line}:{column}", "", line, line))
        elif kind in (lexing.STRING, lexing.NUMBER) and language in ("javascript", "typescript"):
            line = at_line(a)
            body = word[1:-1] if kind == lexing.STRING else word
            out.append(Fact("literal", body[:80], f"{path}:literal@{line}:{a - starts[line - 1]}", "", line, line, text=body))
        i += 1
    yield from out
    for a, b in comments:
        line = at_line(a)
        body = re.sub(r"^(?:/\*+|//+!?)\s*|\s*\*+/$", "", text[a:b]).strip()
        yield Fact("comment", body[:80], f"{path}:comment@{line}:{a - starts[line - 1]}", "", line, at_line(b), text=body)


def _exported(language: str, code: list, i: int, word: str, nxt: str) -> bool:
    before = [c[1] for c in code[max(0, i - 5) : i]]
    if language == "go":
        return nxt[:1].isupper() or word[:1].isupper()
    return any(x in before for x in ("export", "pub", "public"))


def _annotations(language: str, code: list, i: int) -> list[str]:
    out = []
    for k in range(max(0, i - 12), i - 1):
        if code[k][1] == "@" and code[k + 1][0] == lexing.NAME:
            out.append(code[k + 1][1])
        if code[k][1] in ("}", ";"):
            out = []
    return out


def _imports(language: str, code: list, i: int, path: str) -> tuple[list[tuple[str, str]], int]:
    """((local name, target), ...) of the import that begins at i, and the index after it."""
    n = len(code)
    j = i + 1
    if language in ("javascript", "typescript"):
        words = []
        while j < n and code[j][0] != lexing.STRING and code[j][1] not in (";", "(") and j - i < 200:
            words.append(code[j][1])
            j += 1
        if j >= n or code[j][0] != lexing.STRING:
            return [], i + 1
        source = code[j][1][1:-1]
        text = " ".join(words)
        out = []
        if m := re.search(r"\* as (\S+)", text):
            out.append((m[1], source))
        if m := re.search(r"\{(.*)\}", text):
            for part in m[1].split(","):
                p = part.replace("type ", "", 1).split(" as ") if part.strip().startswith("type ") else part.split(" as ")
                if p[0].strip():
                    out.append((p[-1].strip(), f"{source}:{p[0].strip()}"))
        if m := re.match(r"(?:type )?([\w$]+)\b(?! as)", text):
            if m[1] not in ("type", "from"):
                out.append((m[1], f"{source}:default"))
        return out, j + 1
    if language == "go":
        out = []
        stop = j
        if j < n and code[j][1] == "(":
            stop = j
            while stop < n and code[stop][1] != ")":
                stop += 1
        else:
            while stop < n and code[stop][0] != lexing.STRING:
                stop += 1
        for k in range(j, min(stop + 1, n)):
            if code[k][0] == lexing.STRING:
                target = code[k][1][1:-1]
                alias = code[k - 1][1] if code[k - 1][0] == lexing.NAME and code[k - 1][1] != "import" else target.rpartition("/")[2]
                out.append((alias, target))
        return out, stop + 1
    words = []
    while j < n and code[j][1] != ";":
        words.append(code[j][1])
        j += 1
    text = "".join(f" {w} " if w == "as" else w for w in words)
    if language == "java":
        text = re.sub(r"^static", "", text)
        return [("*" if text.endswith("*") else text.rpartition(".")[2], re.sub(r"\.\*$", "", text))], j + 1
    return _use_tree(text), j + 1


def _use_tree(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """Rust's nested imports, flat."""
    out: list[tuple[str, str]] = []
    depth = begin = 0
    parts = []
    for k, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(text[begin:k])
            begin = k + 1
    parts.append(text[begin:])
    for part in parts:
        part = part.strip()
        if not part:
            continue
        if "{" in part:
            head, _, rest = part.partition("{")
            out += _use_tree(rest.rsplit("}", 1)[0], prefix + head)
        else:
            path, _, alias = part.partition(" as ")
            full = prefix + path.strip()
            out.append((alias.strip() or full.rpartition("::")[2], full.removesuffix("::*") if full.endswith("*") else full))
    return out


def facts(files: DataFrame) -> DataFrame:
    """The facts of all files (project, path, text) as one flat table; null texts give none."""
    source = spread(files.select("project", "path", "text").where(F.col("text").isNotNull() & F.col("path").isNotNull()))
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [types[c.split()[1]] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for project, path, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows += [(project, path, f.kind, f.name, f.qn, f.owner, f.start_line, f.end_line, f.parameters, f.decorators, f.docstring, f.exported, f.text, f.target) for f in extract(text, path)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], COLUMNS)

    return source.mapInArrow(run, SCHEMA)
