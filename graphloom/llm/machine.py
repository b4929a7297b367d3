"""Recognisers made from grammars in EBNF: bracket groups are symbols, states are found as they are needed.

A grammar is a text of rules ``name = ...`` with ``|``, ``( )``, ``*``, ``+``, ``?``,
quoted tokens, token classes in capitals and groups: ``P:rule`` is a pair of round
brackets whose content follows ``rule``, ``Q`` square, ``B`` curly, ``N`` an indented
block, and ``K.word`` a group that a keyword opens.

Every token is one character of a class string. The content of a group is read once
for all rules that any group of its kind may follow; the set of rules it satisfies is
the symbol that stands for the group in the text around it. So nesting is reduced from
the inside out, and no choice has to be guessed.
"""

from __future__ import annotations

import re

BOF, EOF, STRAY, SOFT = "⊢", "⊣", "¿", "¶"
#: token classes that all languages share
CLASSES = {"ID": "i", "NUM": "0", "STR": "S", "TPL": "T", "NL": "n", "LT": "L", "ASI": "§", "WORD": "w", "ATTR": "A", "RX": "R", "CONST": "C", "SYM": "Y", "LABEL": "l", "LABELEND": "e", "DEFNAME": "d", "ARITH": "a", "COND": "c", "ARRAY": "r", "REDIR": ">", "ARM": "m", "ARMEND": "E"}
BRACKETS = {"P": "()", "Q": "[]", "B": "{}", "N": "‹›"}
#: brackets of groups that hold no other group
INLINE = {"(": "\x11", ")": "\x12", "[": "\x13", "]": "\x14", "{": "\x15", "}": "\x16"}
_OPEN_OF = {INLINE[o]: o for o in "([{"}
_UNMARKED = {v: k for k, v in INLINE.items()}
#: known states of one machine and runs of tokens remembered with them; beyond that they are found anew
MOST_STATES, MOST_RUNS = 100_000, 400_000

_codes: dict[str, str] = {}


def code(token: str) -> str:
    """The character of a token; the same in every process, since grammars are read in one order."""
    if token in "()[]{}" and len(token) == 1:
        return token
    return _codes.setdefault(token, chr(0x100 + len(_codes)))


def name(char: str) -> str:
    for k, v in _codes.items():
        if v == char:
            return k
    if char in _UNMARKED:
        return _UNMARKED[char]
    return {"i": "name", "0": "number", "S": "string", BOF: "start", EOF: "end", STRAY: "stray character"}.get(char, char)


class State:
    __slots__ = ("to", "configs", "accepts")

    def __init__(self, configs, accepts):
        self.to, self.configs, self.accepts = {}, configs, accepts


class Machine:
    def __init__(self, text: str, closers: dict[str, str] | None = None, soft: bool = False):
        self.words: dict[str, str] = {}
        self.eps: list[list[int]] = []
        self.tok: list[dict[str, list[int]]] = []
        self.calls: list[list[tuple[str, int]]] = []
        self.groups: list[list[tuple[str, int, int]]] = []
        self.roles: dict[str, list[str]] = {"": ["file"]}
        self.closers = {o: c for o, c in BRACKETS.values()}
        self.closers.update({code(o): code(c) for o, c in (closers or {}).items()})
        self.soft = soft
        bodies = dict(re.findall(r"(?m)^(\w+) =((?:.|\n(?!\w+ =))*)", text))
        self._asts = {k: self._parse(v) for k, v in bodies.items()}
        self.rules = {k: (self._node(), self._node()) for k in bodies}
        for k, ast in self._asts.items():
            self._build(ast, *self.rules[k])
        self.ends = {end for _, end in self.rules.values()}
        self.tail = [self._ends_only(n) for n in range(len(self.eps))]
        opening = re.escape("".join(self.closers))
        self._structure = re.compile(f"[{opening}{re.escape(''.join(self.closers.values()))}{EOF}]")
        inner = "|".join(f"{INLINE[o]}[^{INLINE[c]}]*+{INLINE[c]}" for o, c in ("()", "[]", "{}"))
        self._parts = re.compile(f"[^{opening}\x11\x13\x15]++|[{opening}]|{inner}")
        self._clear()

    # --- reading the grammar -------------------------------------------------------------------------

    def _parse(self, body: str):
        toks = re.findall(r"'[^'\s]+'|[PQBN]:\w+|K\.[\w]+:\w+|\w+|[()|*+?]", body)
        at = 0

        def alternatives():
            nonlocal at
            out = [sequence()]
            while at < len(toks) and toks[at] == "|":
                at += 1
                out.append(sequence())
            return ("or", out) if len(out) > 1 else out[0]

        def sequence():
            nonlocal at
            out = []
            while at < len(toks) and toks[at] not in "|)":
                t = toks[at]
                at += 1
                if t == "(":
                    item = alternatives()
                    assert toks[at] == ")", body
                    at += 1
                elif t[0] == "'":
                    item = ("tok", self._token(t[1:-1]))
                elif ":" in t:
                    kind, rule = t.split(":")
                    opener = BRACKETS[kind][0] if kind in BRACKETS else self._token(kind[2:])
                    known = self.roles.setdefault(opener, [])
                    if rule not in known:
                        known.append(rule)
                    item = ("group", opener, known.index(rule))
                elif t in CLASSES:
                    item = ("tok", CLASSES[t])
                else:
                    item = ("call", t)
                while at < len(toks) and toks[at] in ("*", "+", "?"):
                    item = (toks[at], item)
                    at += 1
                out.append(item)
            return ("seq", out)

        ast = alternatives()
        assert at == len(toks), body
        return ast

    def _token(self, text: str) -> str:
        self.words[text] = code(text)
        return self.words[text]

    def _node(self) -> int:
        self.eps.append([])
        self.tok.append({})
        self.calls.append([])
        self.groups.append([])
        return len(self.eps) - 1

    def _build(self, ast, a: int, b: int) -> None:
        kind = ast[0]
        if kind == "tok":
            self.tok[a].setdefault(ast[1], []).append(b)
        elif kind == "call":
            assert ast[1] in self.rules, ast[1]
            self.calls[a].append((ast[1], b))
        elif kind == "group":
            self.groups[a].append((ast[1], ast[2], b))
        elif kind == "or":
            for x in ast[1]:
                self._build(x, a, b)
        elif kind == "seq":
            for x in ast[1][:-1]:
                mid = self._node()
                self._build(x, a, mid)
                a = mid
            if ast[1]:
                self._build(ast[1][-1], a, b)
            else:
                self.eps[a].append(b)
        else:
            inner, out = self._node(), self._node()
            self.eps[a].append(inner)
            self._build(ast[1], inner, out)
            self.eps[out].append(b)
            if kind in "*?":
                self.eps[a].append(b)
            if kind in "*+":
                self.eps[out].append(inner)

    def _ends_only(self, n: int) -> bool:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            if self.tok[x] or self.calls[x] or self.groups[x]:
                return False
            todo += self.eps[x]
        return bool(seen & self.ends)

    # --- pairs ---------------------------------------------------------------------------------------

    def pairs(self) -> set[tuple[str, str]]:
        """Every two tokens that can stand side by side in a text of the grammar."""
        rules = list(self._asts)
        null = dict.fromkeys(rules, False)
        first = {r: set() for r in rules}
        last = {r: set() for r in rules}

        def sets(ast):
            kind = ast[0]
            if kind == "tok":
                return False, {ast[1]}, {ast[1]}
            if kind == "group":
                return False, {ast[1]}, {self.closers[ast[1]]}
            if kind == "call":
                return null[ast[1]], first[ast[1]], last[ast[1]]
            if kind == "or":
                parts = [sets(x) for x in ast[1]]
                return any(p[0] for p in parts), set().union(*[p[1] for p in parts]), set().union(*[p[2] for p in parts])
            if kind == "seq":
                n, f, z = True, set(), set()
                for pn, pf, pl in map(sets, ast[1]):
                    f = f | pf if n else f
                    z = pl | z if pn else pl
                    n = n and pn
                return n, f, z
            n, f, z = sets(ast[1])
            return n or kind in "*?", f, z

        while True:
            before = [(null[r], len(first[r]), len(last[r])) for r in rules]
            for r in rules:
                n, f, z = sets(self._asts[r])
                null[r] = null[r] or n
                first[r] = first[r] | f
                last[r] = last[r] | z
            if before == [(null[r], len(first[r]), len(last[r])) for r in rules]:
                break
        out = {(a, b) for a in last["file"] | {BOF} for b in (first["file"] if a == BOF else {EOF})} | {(BOF, EOF)}

        def walk(ast):
            kind = ast[0]
            if kind in ("or", "seq"):
                for x in ast[1]:
                    walk(x)
            if kind == "seq":
                ends: set[str] = set()
                for n, f, z in map(sets, ast[1]):
                    out.update((a, b) for a in ends for b in f)
                    ends = ends | z if n else set(z)
            elif kind in ("*", "+", "?"):
                walk(ast[1])
                if kind != "?":
                    _, f, z = sets(ast[1])
                    out.update((a, b) for a in z for b in f)
            elif kind == "group":
                rule, o = self.roles[ast[1]][ast[2]], ast[1]
                c = self.closers[o]
                out.update((o, b) for b in first[rule])
                out.update((a, c) for a in last[rule])
                if null[rule]:
                    out.add((o, c))

        for r in rules:
            walk(self._asts[r])
        if self.soft:  # what a line break may end ends as well before a closing bracket and at the end
            asi = CLASSES["ASI"]
            out.update((a, c) for a, b in list(out) if b == asi for c in ["}", ")", EOF])
        return out

    # --- states --------------------------------------------------------------------------------------

    def _clear(self) -> None:
        self.states: dict = {}
        self._inner: dict[str, int] = {}
        self.held = 0
        self.dead = State(frozenset(), 0)
        self.starts = {o: self._closed([(self.rules[r][0], k) for k, r in enumerate(rules)]) for o, rules in self.roles.items()}

    def _closed(self, configs) -> State:
        seen, keep, accepts, todo = set(), set(), 0, list(configs)
        while todo:
            c = todo.pop()
            if c in seen:
                continue
            seen.add(c)
            node, stack = c
            if node in self.ends:
                if isinstance(stack, int):
                    accepts |= 1 << stack
                else:
                    todo.append(stack)
            if self.tok[node] or self.groups[node]:
                keep.add(c)
            for n in self.eps[node]:
                todo.append((n, stack))
            for rule, ret in self.calls[node]:
                todo.append((self.rules[rule][0], stack if self.tail[ret] else (ret, stack)))
        key = (frozenset(keep), accepts)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(key[0], accepts)
        return got

    def step(self, state: State, symbol) -> State:
        if not state.configs:
            return self.dead
        out = []
        if isinstance(symbol, tuple):
            opener, mask = symbol
            for node, stack in state.configs:
                for o, role, to in self.groups[node]:
                    if o == opener and mask >> role & 1:
                        out.append((to, stack))
        elif symbol == SOFT:
            ended = self.step(state, CLASSES["ASI"])
            new = self._closed([*state.configs, *ended.configs]) if ended.configs or ended.accepts else state
            accepts = state.accepts | ended.accepts | new.accepts
            if accepts != new.accepts:
                key = (new.configs, accepts)
                new = self.states.get(key) or self.states.setdefault(key, State(*key))
            state.to[symbol] = new
            return new
        else:
            for node, stack in state.configs:
                for to in self.tok[node].get(symbol, ()):
                    out.append((to, stack))
        new = self._closed(out) if out else self.dead
        state.to[symbol] = new
        return new

    def accepted(self, state: State) -> int:
        if self.soft and state.configs:
            return state.accepts | (state.to.get(CLASSES["ASI"]) or self.step(state, CLASSES["ASI"])).accepts
        return state.accepts

    def judge(self, text: str) -> str | None:
        """First fault of a file, or None.

        ``text`` holds the content of the file's groups, outer levels first, each ended by
        its closing bracket (the file itself by ``EOF``), nested groups as their opening bracket.
        """
        if len(self.states) > MOST_STATES or self.held > MOST_RUNS:
            self._clear()
        # the children of each group follow those of the groups before it
        openers, child_of, parts, begin = [""], [1], [], 0
        for m in self._structure.finditer(text):
            c = m.group()
            if c in self.closers:
                openers.append(c)
            else:
                parts.append((begin, m.start()))
                begin = m.end()
                child_of.append(len(openers))
        if len(openers) != len(parts) or begin != len(text):
            return "nesting"
        masks = [0] * len(parts)
        for g in range(len(parts) - 1, -1, -1):
            a, z = parts[g]
            if g and text[z] != self.closers[openers[g]]:
                return f"nesting: {name(openers[g])} closed by {name(text[z])}"
            child = child_of[g]
            start = state = self.starts.get(openers[g], self.dead)
            for part in self._parts.findall(text[a:z]):
                new = state.to.get(part)
                if new is None:
                    if part in self.closers:
                        symbol = (part, masks[child])
                        child += 1
                        new = state.to.get(symbol) or self.step(state, symbol)
                    else:
                        new = self._run(state, part)
                if new is self.dead:
                    return self._where(start, text[a:z], masks[child_of[g] :])
                state = new
            masks[g] = self.accepted(state)
            if not masks[g]:
                return "production: " + _shown(text[max(a, z - 6) : z + 1])
        return None

    def _run(self, state: State, part: str) -> State:
        """The state after a run of tokens or a whole inner group; both are remembered with the state they start from."""
        begun = state
        if part[0] in _OPEN_OF:
            mask = self._inner.get(part)
            if mask is None:
                inside = self.starts.get(_OPEN_OF[part[0]], self.dead)
                for sub in self._parts.findall(part[1:-1]):
                    inside = inside.to.get(sub) or self._run(inside, sub)
                    if inside is self.dead:
                        break
                mask = self._inner[part] = self.accepted(inside)
            symbol = (_OPEN_OF[part[0]], mask)
            state = state.to.get(symbol) or self.step(state, symbol)
        else:
            for c in part:
                state = state.to.get(c) or self.step(state, c)
                if state is self.dead:
                    break
        begun.to[part] = state
        self.held += 1
        return state

    def _where(self, state: State, text: str, masks: list[int]) -> str:
        """The fault of a group, token by token."""
        child = 0
        for m in self._parts.finditer(text):
            part = m.group()
            if part in self.closers:
                steps = [(m.end(), (part, masks[child]))]
                child += 1
            elif part[0] in _OPEN_OF:
                self._run(state, part)
                steps = [(m.end(), (_OPEN_OF[part[0]], self._inner[part]))]
            else:
                steps = [(m.start() + k + 1, c) for k, c in enumerate(part)]
            for end, symbol in steps:
                state = state.to.get(symbol) or self.step(state, symbol)
                if state is self.dead:
                    return "production: " + _shown(text[max(0, end - 7) : end])
        return "production"


def _shown(text: str) -> str:
    return " ".join(name(c) for c in text)


