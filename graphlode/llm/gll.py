"""A generalised LL recogniser with a graph-structured stack.

A grammar is text: ``name: alternatives ;`` with 'literals', TOKEN kinds, rule names, ``( ) ? * +``, ``|`` and two
zero-width conditions: ``-'x'`` (the next token is not x) and ``LINE`` (a line ends before the next token, or it is a
closing brace or the end). Each right side becomes an automaton without empty moves; choices
that one token of look-ahead cannot settle run side by side. Stack nodes are (rule, position): parses that call
the same rule at the same place share one node, so ambiguity and left recursion cost no repeated work.
Dialects are several start rules over one token sequence, run together on one stack; the text is accepted if any of
them reaches its end.
"""

from __future__ import annotations

import re
from collections import defaultdict

_END = "END"
STEP, CALL, RETURN, SEVERAL, NOTHING = range(5)


class Grammar:
    def __init__(self, text: str, starts: tuple[str, ...], reserved: set[str], kinds: tuple[str, ...] = ("NAME", "NUMBER", "STRING")):
        self.starts = starts
        self.rules: dict[str, object] = {}
        for m in re.finditer(r"(\w+)\s*:((?:'[^'\n]*'|[^';])*);", text):
            self.rules[m[1]] = self._parse(m[2])
        self.literals: set[str] = set()
        self._collect()
        # classes of tokens: kinds, literals; a soft keyword is a NAME too
        self.classes = {k: i for i, k in enumerate([_END, "BAD", *kinds, *sorted(self.literals)])}
        self.soft = {x for x in self.literals if re.match(r"[^\W\d]", x) and x not in reserved}
        self.reserved = reserved
        name = self.classes["NAME"]
        self.matches = {t: {i} for t, i in self.classes.items()}
        self.matches["NAME"] = {name, *(self.classes[s] for s in self.soft)}
        words = {i for t, i in self.classes.items() if re.match(r"[^\W\d]", t) and t not in (_END, "BAD", *kinds)}
        self.matches["WORD"] = {name, *words}  # any name, reserved or not
        if "RESERVED" not in self.classes:
            self.classes["RESERVED"] = len(self.classes)
        self.matches["WORD"].add(self.classes["RESERVED"])
        self._build()

    # -- reading -------------------------------------------------------------------------------------------
    @staticmethod
    def _parse(text: str):
        tokens = re.findall(r"'[^']*'|\w+|[()?*+|]|-(?=[('A-Z])", text)
        at = 0

        def alternatives():
            nonlocal at
            out = [sequence()]
            while at < len(tokens) and tokens[at] == "|":
                at += 1
                out.append(sequence())
            return out[0] if len(out) == 1 else ("or", out)

        def sequence():
            nonlocal at
            out = []
            while at < len(tokens) and tokens[at] not in ("|", ")"):
                out.append(item())
            return ("seq", out)

        def item():
            nonlocal at
            token = tokens[at]
            at += 1
            if token == "-":
                node = ("not", item())
            elif token == "(":
                node = alternatives()
                at += 1
            elif token[0] == "'":
                node = ("t", token[1:-1])
            elif token.isupper():
                node = ("line",) if token == "LINE" else ("t", token)
            else:
                node = ("n", token)
            while at < len(tokens) and tokens[at] in "?*+":
                node = (tokens[at], node)
                at += 1
            return node

        return alternatives()

    def _collect(self) -> None:
        kinds = {"NAME", "NUMBER", "STRING", "WORD", "REGEX", "LIFETIME", "NEWLINE", "INDENT", "DEDENT", _END}

        def walk(n):
            if n[0] == "t":
                if n[1] not in kinds:
                    self.literals.add(n[1])
            elif n[0] == "n":
                if n[1] not in self.rules:
                    raise ValueError(f"no rule {n[1]}")
            elif n[0] in ("seq", "or"):
                for x in n[1]:
                    walk(x)
            elif n[0] != "line":
                walk(n[1])

        for r in self.rules.values():
            walk(r)

    # -- automata ------------------------------------------------------------------------------------------
    def _build(self) -> None:
        self.moves: list[list[tuple[tuple, int]]] = []  # of each state: (symbol, next state)
        self.accepts: list[bool] = []
        self.rule_of: list[str] = []
        self.start: dict[str, int] = {}
        for name, body in self.rules.items():
            self._automaton(name, body)
        self._first()
        self.table = [[None] * len(self.classes) for _ in self.moves]

    def _automaton(self, name: str, body) -> None:
        edges: list[list[tuple[tuple | None, int]]] = [[], []]

        def new() -> int:
            edges.append([])
            return len(edges) - 1

        def build(n, a: int, b: int) -> None:
            if n[0] in ("t", "n", "line", "not"):
                edges[a].append((n if n[0] != "not" else ("not", n[1][1] if n[1][0] == "t" else tuple(x[1][0][1] if x[0] == "seq" else x[1] for x in n[1][1])), b))
            elif n[0] == "or":
                for x in n[1]:
                    build(x, a, b)
            elif n[0] == "seq":
                for k, x in enumerate(n[1]):
                    z = b if k == len(n[1]) - 1 else new()
                    build(x, a, z)
                    a = z
                if not n[1]:
                    edges[a].append((None, b))
            elif n[0] == "?":
                build(n[1], a, b)
                edges[a].append((None, b))
            else:
                x, y = new(), new()
                edges[a].append((None, x))
                build(n[1], x, y)
                edges[y] += [(None, x), (None, b)]
                if n[0] == "*":
                    edges[a].append((None, b))

        build(body, 0, 1)

        def closure(states: frozenset[int]) -> frozenset[int]:
            out, todo = set(states), list(states)
            for s in todo:
                for symbol, to in edges[s]:
                    if symbol is None and to not in out:
                        out.add(to)
                        todo.append(to)
            return frozenset(out)

        base = len(self.moves)
        sets = [closure(frozenset([0]))]
        index = {sets[0]: 0}
        for states in sets:
            by = defaultdict(set)
            for s in states:
                for symbol, to in edges[s]:
                    if symbol is not None:
                        by[symbol].add(to)
            row = []
            for symbol, to in by.items():
                target = closure(frozenset(to))
                if target not in index:
                    index[target] = len(sets)
                    sets.append(target)
                row.append((symbol, base + index[target]))
            self.moves.append(row)
            self.accepts.append(1 in states)
            self.rule_of.append(name)
        self.start[name] = base

    def _first(self) -> None:
        """First classes and emptiness of each state, and the classes that may follow each rule."""
        n = len(self.moves)
        self.empty = [self.accepts[s] for s in range(n)]
        first: list[set[int]] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                size, empty = len(first[s]), self.empty[s]
                for symbol, to in self.moves[s]:
                    if symbol[0] == "t":
                        first[s] |= self.matches[symbol[1]]
                    elif symbol[0] == "n":
                        first[s] |= first[self.start[symbol[1]]]
                        if self.empty[self.start[symbol[1]]]:
                            first[s] |= first[to]
                            self.empty[s] = self.empty[s] or self.empty[to]
                    else:
                        first[s] |= first[to]
                        self.empty[s] = self.empty[s] or self.empty[to]
                changed |= size != len(first[s]) or empty != self.empty[s]
        follow: dict[str, set[int]] = {r: set() for r in self.rules}
        for s in self.starts:
            follow[s].add(self.classes[_END])
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for symbol, to in self.moves[s]:
                    if symbol[0] == "n":
                        f = follow[symbol[1]]
                        size = len(f)
                        f |= first[to]
                        if self.empty[to]:
                            f |= follow[self.rule_of[s]]
                        changed |= size != len(f)
        self.first, self.follow = first, follow

    def _row(self, state: int, c: int):
        """(next states by the token, calls (start, next state), conditions, may end) for a state and a class."""
        steps, calls, conditions = [], [], []
        follow = self.follow[self.rule_of[state]]
        for symbol, to in self.moves[state]:
            if symbol[0] == "t":
                if c in self.matches[symbol[1]]:
                    steps.append(to)
            elif symbol[0] == "n":
                s = self.start[symbol[1]]
                if c in self.first[s] or (self.empty[s] and (c in self.first[to] or self.empty[to])):
                    calls.append((s, to))
            elif symbol[0] == "line":
                if c in self.first[to] or self.empty[to]:
                    conditions.append(to)
            else:
                banned = symbol[1] if isinstance(symbol[1], tuple) else (symbol[1],)
                if not any(c in self.matches[b] for b in banned) and (c in self.first[to] or self.empty[to]):
                    calls.append((-1, to))
        ends = self.accepts[state] and c in follow
        # what one token of look-ahead settles: a step, a call, a return or nothing
        if len(steps) + len(calls) + len(conditions) + ends == 1 and not conditions and not (calls and calls[0][0] < 0):
            kind = STEP if steps else CALL if calls else RETURN
        else:
            kind = SEVERAL if steps or calls or conditions or ends else NOTHING
        one = steps[0] if kind == STEP else calls[0] if kind == CALL else None
        row = (kind, one, tuple(steps), tuple(calls), tuple(conditions), ends)
        self.table[state][c] = row
        return row

    # -- running -------------------------------------------------------------------------------------------
    def accepts_tokens(self, classes: list[int], breaks: list[bool]) -> bool:
        """Whether any start rule derives the tokens. breaks[i]: LINE holds before token i. The last class is END."""
        return self.furthest(classes, breaks) is None

    def furthest(self, classes: list[int], breaks: list[bool]) -> int | None:
        """None for an accepted text, else the last token that any parse came to."""
        table, make = self.table, self._row
        end = len(classes)  # after the token END
        classes, breaks = [*classes, self.classes[_END]], [*breaks, True]
        size = end + 2
        nodes: dict[int, int] = {}  # start state * size + position -> number
        edges: list[list[tuple[int, int]]] = []
        popped: list[list[int]] = []
        todo: list[tuple[int, int, int]] = []
        seen: set[tuple[int, int, int]] = set()
        for name in self.starts:
            nodes[self.start[name] * size] = len(edges)
            todo.append((self.start[name], len(edges), 0))
            edges.append([])
            popped.append([])
        tops = len(edges)
        far = 0
        while todo:
            state, node, at = todo.pop()
            while True:
                row = table[state][classes[at]] or make(state, classes[at])
                kind = row[0]
                if kind == STEP:
                    state = row[1]
                    at += 1
                    continue
                if kind == CALL:
                    s, to = row[1]
                    child = nodes.get(s * size + at)
                    if child is None:
                        nodes[s * size + at] = child = len(edges)
                        edges.append([(to, node)])
                        popped.append([])
                        state, node = s, child
                        continue
                elif kind == RETURN:
                    back = popped[node]
                    if at in back:
                        break
                    if node < tops and at == end:
                        return None
                    back.append(at)
                    parents = edges[node]
                    if len(parents) == 1:
                        state, node = parents[0]
                        d = (state, node, at)
                        if d in seen:
                            break
                        seen.add(d)
                        continue
                    for to, parent in parents:
                        d = (to, parent, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                    break
                if at > far:
                    far = at
                if kind == NOTHING:
                    break
                _, _, steps, calls, conditions, ends = row
                if ends and at not in popped[node]:
                    if node < tops and at == end:
                        return None
                    popped[node].append(at)
                    for to, parent in edges[node]:
                        d = (to, parent, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                for s, to in calls:
                    if s < 0:
                        d = (to, node, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                        continue
                    child = nodes.get(s * size + at)
                    if child is None:
                        nodes[s * size + at] = child = len(edges)
                        edges.append([(to, node)])
                        popped.append([])
                        todo.append((s, child, at))
                    elif (to, node) not in edges[child]:
                        edges[child].append((to, node))
                        for p in popped[child]:
                            d = (to, node, p)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                if conditions and breaks[at]:
                    for to in conditions:
                        d = (to, node, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                if len(steps) == 1 and not conditions:
                    state = steps[0]
                    at += 1
                    continue
                for to in steps:
                    d = (to, node, at + 1)
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
                break
        return far
