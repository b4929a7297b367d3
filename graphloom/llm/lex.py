"""Lexers of the analysed languages (problem 1): a text becomes a string of one character per token.

Each language has one pattern for the next token; a token's class is found once per distinct
token and worker. What no rule lexes (an unclosed quote, a foreign character) becomes
``STRAY``, which no grammar knows. Comments and blanks vanish; line breaks stay where they count.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from graphloom.llm.grammar import GRAMMARS, RUBY_RESERVED
from graphloom.llm.machine import CLASSES, EOF, SOFT, STRAY, code

#: distinct tokens that a worker remembers per language
MEMO = 300_000

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
_WORD = r"[^\W\d][\w$]*+"
_NUMBER = r"(?:\d|\.\d)(?:[\w.]|(?<=[eEpP])[+-](?=\d))*+"
_RANGED = r"\d\w*+(?:\.(?!\.|[^\W\d])\w*+)?+(?:(?<=[eE])[+-]\d++)?"
_BREAK = r"\n\s*+"


class Lexicon(dict):
    """Class string of each distinct token of one language."""

    def __init__(self, lang: str, rule: Callable[[str], str | None] | None = None):
        super().__init__()
        self.words, self.rule, self.slashes = GRAMMARS[lang].words, rule, lang not in ("python", "ruby", "shell")

    def __missing__(self, token: str) -> str:
        if self.slashes and token[:2] in ("//", "/*"):
            out = SOFT if "\n" in token else ""
        else:
            out = self.rule(token) if self.rule else None
        if out is None:
            out = self.classed(token)
        if len(self) >= MEMO:
            self.clear()
        self[token] = out
        return out

    def classed(self, token: str) -> str:
        known = self.words.get(token)
        if known:
            return known
        c = token[0]
        if token in "()[]{}":
            return token
        if c == "\n":
            return SOFT
        if c.isdecimal() or (c == "." and token[1:2].isdecimal()):
            return CLASSES["NUM"]
        if token[-1] in "\"'`" and len(token) > 1:
            return CLASSES["STR"]
        if c == "_" or c.isalpha() or c == "$":
            return CLASSES["ID"]
        return STRAY


def _operators(lang: str) -> str:
    """Operators and brackets, the longest first; those that begin no other in one class before all."""
    by: dict[str, list[str]] = {}
    for w in [*(w for w in GRAMMARS[lang].words if not (w[0].isalnum() or w[0] in "_§")), *"()[]{}"]:
        by.setdefault(w[0], []).append(w[1:])
    alone = [c for c, rest in by.items() if rest == [""]]
    out = ["[" + "".join(re.escape(c) for c in alone) + "]"]
    for c, rest in by.items():
        if c not in alone:
            longer = "|".join(re.escape(r) for r in sorted(filter(None, rest), key=lambda r: (-len(r), r)))
            out.append(f"{re.escape(c)}(?:{longer})" + ("?+" if "" in rest else ""))
    return "|".join(out)


def _no_breaks(cls: str) -> str:
    return cls.replace(SOFT, "")


# --- javascript and typescript ---------------------------------------------------------------------------

_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
_BEFORE_REGEX = r"[-+*%&|^~<>=!?:;,({\[]{1,3}+\s*+"
_AFTER_WORD = "(?:" + "|".join(f"(?<={w}{b})" for w in ("return", "typeof", "case", "delete", "void", "throw", "await", "yield", "[^\\w$.]in", "[^\\w$.]of") for b in (" ", "")) + ")"


def _template() -> str:
    inner = rf"(?:[^{{}}'\"`]|{_SQ}|{_DQ}|{_BLOCK})"
    level = "`(?:[^`\\\\]|\\\\[\\s\\S])*+`"
    for _ in range(3):
        braces = rf"\{{(?:{inner}|{level}|\{{(?:{inner}|{level}|\{{(?:{inner}|{level})*+\}})*+\}})*+\}}"
        level = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${braces})*+`"
    return level


_TPL = _template()
_HOLE = re.compile(_TPL[1:-1].split(r"|\$(?!\{)|", 1)[1].rsplit(")*+", 1)[0] + r"|\\[\s\S]")


_MARKUP = re.compile(r"(?:[(,=?:&|{\[]|=>|\breturn|\bdefault)\s*+(?=<(?:>|[^\W\d]))")
_TAG_NAME = re.compile(r"[^\W\d][\w.:-]*+")
_ATTRIBUTE = re.compile(r"\s*+(?:[^\W\d][\w:-]*+(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|(?=[{<])))?|(?=\{))")
_BRACED = re.compile(rf"{_BLOCK}|{_LINE}|{_DQ}|{_SQ}|{_TPL}|[{{}}]")


def _braced(text: str, at: int) -> int:
    """End of the braces that open at ``at``, or -1."""
    depth = 0
    for m in _BRACED.finditer(text, at):
        c = m.group()
        depth += (c == "{") - (c == "}")
        if not depth:
            return m.end()
    return -1


def _element(text: str, at: int, held: list[str]) -> int:
    """End of the markup element at ``at``, or -1; the expressions it holds are added to ``held``."""
    m = _TAG_NAME.match(text, at + 1)
    tag = m.group() if m else ""
    at = m.end() if m else at + 1
    while True:
        m = re.compile(r"\s*+(/?>)").match(text, at)
        if m:
            at = m.end()
            break
        m = _ATTRIBUTE.match(text, at)
        if not m or m.end() == at and text[at : at + 1] != "{":
            return -1
        at = m.end()
        if text[at : at + 1] == "{" and m.group(1) is None:
            end = _braced(text, at)
            if end < 0:
                return -1
            held.append(text[at + 1 : end - 1])
            at = end
        elif text[at : at + 1] == "<" and m.group().rstrip().endswith("="):
            at = _element(text, at, held)
            if at < 0:
                return -1
    if m.group(1) == "/>":
        return at
    while True:
        m = re.compile(r"[^<{]*+").match(text, at)
        at = m.end()
        if text.startswith("</", at):
            m = re.compile(rf"</\s*+{re.escape(tag)}\s*+>").match(text, at)
            return m.end() if m else -1
        if text[at : at + 1] == "{":
            end = _braced(text, at)
            if end < 0:
                return -1
            held.append(text[at + 1 : end - 1])
            at = end
        elif text[at : at + 1] == "<":
            at = _element(text, at, held)
            if at < 0:
                return -1
        else:
            return -1


def _without_markup(text: str) -> str:
    """Markup elements as lists of the expressions they hold."""
    out, at = [], 0
    for m in _MARKUP.finditer(text):
        if m.end() < at:
            continue
        held: list[str] = []
        end = _element(text, m.end(), held)
        if end < 0:
            continue
        inner = [_without_markup(e) for e in held if re.sub(rf"{_BLOCK}|{_LINE}|\s", "", e)]
        out += [text[at : m.end()], "[0", *(f", {e.strip()}\n" for e in inner), "]"]
        at = end
    return "".join(out) + text[at:]


def _script_lexer(lang: str) -> Callable[[str], str]:
    name = r"(?:[^\W\d]|\$)[\w$]*+"
    after = rf"{_LINE}|{_BLOCK}|{_AFTER_WORD}{_REGEX}|{_DQ}|{_SQ}|{_NUMBER}|{_operators(lang)}|{_TPL}|\\u\{{?[0-9a-fA-F]++\}}?[\w$]*+|\S"
    plain, token = re.compile(rf"[ \t]*+({name}|{_BREAK}|{after})"), re.compile(rf"[ \t]*+({name}|{_BEFORE_REGEX}{_REGEX}|{_BREAK}|{after})")
    slashed = re.compile(r"[-+*%&|^~<>=!?:;,({\[]\s*+/(?![/*])")
    tail = re.compile(rf"([\s\S]*?)\s*({_REGEX})")

    def rule(t: str) -> str | None:
        if t[0] == "`" and len(t) > 1:
            return "T" + "".join("(" + lex(m.group()[2:-1]) + ")" for m in _HOLE.finditer(t) if m.group()[0] == "$")
        if t[0] == "/" and len(t) > 2 and t[1] not in "/*":
            return "R"
        if "/" in t[1:] and t[0] not in "\"'/":
            m = tail.fullmatch(t)
            if m:
                return lex(m.group(1)) + "R"
        if t[0] == "\\" and len(t) > 1:
            return CLASSES["ID"]
        return None

    lexicon = Lexicon(lang, rule)

    def lex(text: str) -> str:
        return "".join([lexicon[t] for t in (token if slashed.search(text) else plain).findall(text)])

    def whole(text: str) -> str:
        if "</" in text or "/>" in text:
            text = _without_markup(text)
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        elif text.startswith("/"):
            text = "\n" + text
        return re.sub(f"{SOFT}{SOFT}+", SOFT, lex(text)).strip(SOFT)

    return whole


# --- go, java, c, rust ------------------------------------------------------------------------------------


def _go_lexer() -> Callable[[str], str]:
    rune = r"'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))'"
    token = re.compile(rf"[ \t]*+({_WORD}|{_BREAK}|{_LINE}|{_BLOCK}|{_DQ}|`[^`]*+`|{rune}|{_NUMBER}|{_operators('go')}|\S)")
    lexicon, words = Lexicon("go"), GRAMMARS["go"].words
    ends = "i0S)]}" + "".join(words[w] for w in ("break", "continue", "fallthrough", "return", "++", "--"))
    ending = re.compile(f"(?<=[{re.escape(ends)}]){SOFT}+")

    def lex(text: str) -> str:
        return _no_breaks(ending.sub(words[";"], "".join([lexicon[t] for t in token.findall(text)]) + SOFT))

    return lex


def _java_lexer() -> Callable[[str], str]:
    char = r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
    token = re.compile(rf"\s*+((?:[^\W\d]|\$)[\w$]*+(?<!\bnon)|{_LINE}|{_BLOCK}|non-sealed\b|{_WORD}|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|{char}|{_NUMBER}|{_operators('java')}|\S)")
    lexicon = Lexicon("java")
    return lambda text: _no_breaks("".join([lexicon[t] for t in token.findall(text)]))


_C_SAME = {"__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__restrict__": "restrict", "__volatile__": "volatile", "__volatile": "volatile", "__const": "const", "__const__": "const", "__signed__": "signed", "__asm__": "asm", "__asm": "asm", "__typeof__": "typeof", "__typeof": "typeof", "typeof_unqual": "typeof", "_Static_assert": "_Static_assert", "__thread": "_Thread_local", "_Alignof": "_Alignof", "__alignof__": "_Alignof", "__extension__": ""}
_DIRECTIVE = r"include|define|undef|ifdef|ifndef|if|elifdef|elifndef|elif|else|endif|error|warning|pragma|line|import|include_next|embed"


def _c_lexer() -> Callable[[str], str]:
    directive = rf"#[ \t]*+(?:(?:{_DIRECTIVE})\b(?:{_BLOCK}|[^\n\\/]|\\[\s\S]|/(?!\*))*+|(?=\n))"
    attr = r"(?:__attribute__|__declspec|_Pragma)\s*+\((?:[^()\"]|\"(?:[^\"\\\n]|\\.)*+\"|\((?:[^()\"]|\"(?:[^\"\\\n]|\\.)*+\"|\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\))*+\))*+\)|\[\[[^\[\]]*+\]\]"
    char = r"(?:u8|[uUL])?'(?:[^'\\\n]|\\.)++'"
    token = re.compile(rf"\s*+((?!__[ad]|_P|(?:u8|[uUL])[\"']){_WORD}|{_LINE}|{_BLOCK}|{directive}|(?:u8|[uUL])?{_DQ}|{char}|{_NUMBER}|{attr}|{_WORD}|{_operators('c')}|\S)")
    # names that are macros by custom
    macro = re.compile(r"[A-Z][A-Z0-9_]+|__\w+|[A-Z]\w*_(?:FUNC|DATA|API|EXPORT|EXTERN)")
    # the arms of a condition after its first
    other = re.compile(r"(?m)^[ \t]*#[ \t]*(?:(if|ifdef|ifndef)|(elif|elifdef|elifndef|else)|(endif))\b(?:[^\n\\]|\\[\s\S])*+")

    def rule(t: str) -> str | None:
        if t in _C_SAME:
            return words[_C_SAME[t]] if _C_SAME[t] else ""
        if t.lstrip(" \t")[0] == "#":
            return "" if len(t) > 1 or t == "#" else None
        if t[-1] == ")" and len(t) > 1 or t[:2] == "[[" and len(t) > 2:
            return CLASSES["ATTR"]
        if t not in words and macro.fullmatch(t):
            return CLASSES["CONST"]
        return None

    lexicon, words = Lexicon("c", rule), GRAMMARS["c"].words

    def lex(text: str) -> str:
        return "".join([lexicon[t] for t in token.findall(text)])

    def first_arms(text: str) -> str:
        out, at, skipping, depth = [], 0, 0, 0
        for m in other.finditer(text):
            if m.group(1):
                depth += 1
            elif m.group(2) and not skipping:
                out.append(text[at : m.start()])
                skipping = depth
            elif m.group(3):
                if skipping and depth == skipping:
                    at, skipping = m.start(), 0
                depth -= 1
        return "".join(out) + ("" if skipping else text[at:])

    def whole(text: str) -> str:
        """Both arms of a condition are read, unless their brackets then don't pair; the first arms alone count in that case."""
        cls = _no_breaks(lex(text))
        if "#el" in text.replace(" ", "") and not _paired(cls):
            cls = _no_breaks(lex(first_arms(text)))
        return cls

    return whole


def _paired(cls: str) -> bool:
    left = re.sub(r"[^()\[\]{}]", "", cls)
    while True:
        less = left.replace("()", "").replace("[]", "").replace("{}", "")
        if less == left:
            return not left
        left = less


def _rust_lexer() -> Callable[[str], str]:
    block = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)*+\*/)*+\*/"
    char = r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"
    raw = r'(?:b|c)?r(?P<h>#*+)"[\s\S]*?"(?P=h)'
    token = re.compile(rf"\s*+(?:{_WORD}(?![#\"'])|{_LINE}|{block}|{raw}|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|{char}|'[^\W\d]\w*+|(?:r#)?{_WORD}|{_RANGED}|{_operators('rust')}|\S)")

    def rule(t: str) -> str | None:
        if t[0] == "'" and t[-1] != "'":
            return CLASSES["LT"] if len(t) > 1 else STRAY
        if t[-1] in "\"#" and len(t) > 1:
            return CLASSES["STR"]
        if t[:2] == "r#":
            return CLASSES["ID"]
        return None

    lexicon, words = Lexicon("rust", rule), GRAMMARS["rust"].words
    bang, mark = words["!"], words["#"]
    free = re.compile(rf"(?:i{bang}i?|{mark}{bang}?(?=\[))([(\[{{])")
    bracket = re.compile(r"[()\[\]{}]")
    pairs = {"(": ")", "[": "]", "{": "}"}

    def lex(text: str) -> str:
        """Contents of macro calls and attributes are free tokens: only their brackets are checked, here."""
        if text.startswith("#!") and not text.startswith("#!["):
            text = text[text.find("\n") :] if "\n" in text else ""
        cls = _no_breaks("".join([lexicon[m.group().lstrip()] for m in token.finditer(text)]))
        out, at = [], 0
        while m := free.search(cls, at):
            stack, end = [], -1
            for b in bracket.finditer(cls, m.start(1)):
                if b.group() in pairs:
                    stack.append(pairs[b.group()])
                elif stack.pop() != b.group():
                    break
                if not stack:
                    end = b.start()
                    break
            if end < 0 or STRAY in cls[m.end() : end] and mark not in cls[m.end() : end]:
                out.append(cls[at : m.end()])
                at = m.end()
                continue
            out.append(cls[at : m.end()])
            at = end
        return "".join(out) + cls[at:]

    return lex


# --- python -----------------------------------------------------------------------------------------------


def _python_lexer() -> Callable[[str], str]:
    long = r"(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+''')"
    hole = r"\{(?:[^{}'\"\n]|\"[^\"\n{}]*\"|'[^'\n{}]*'|\{[^{}\n]*\})*\}"
    holes = rf"(?i:f|fr|rf|t|tr|rt)(?:\"(?:[^\"\\\n{{]|\\[\s\S]|\{{\{{|{hole}|\{{)*\"|'(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|{hole}|\{{)*')"
    short = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"
    number = r"(?:0[xXoObB]\w++|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][+-]?\d[\d_]*+)?[jJ]?)"
    token = re.compile(rf"[ \t\f]*+({_WORD}(?![\"'])|(?:(?:#[^\n]*+)?\n[ \t\f]*+)++|{long}|{short}|{number}|{_operators('python')}|#[^\n]*+|\\\n|(?i:[rbuft]|br|rb|fr|rf|tr|rt){long}|{holes}|(?i:[rbu]|br|rb)(?:{short})|{_WORD}|\S)")

    def rule(t: str) -> str | None:
        if t == "\\\n":
            return ""
        if t[-1] in "\"'" and len(t) > 1 and t[0] not in "# \t\f\n":
            return CLASSES["STR"]
        if "\n" in t:
            return "\n"
        if t[0] == "#":
            return ""
        if t[0] == "$":
            return STRAY
        return None

    lexicon = Lexicon("python", rule)
    points = re.compile(r"[()\[\]{}\n]")
    newline = CLASSES["NL"]

    def lex(text: str) -> str:
        toks = token.findall("\n" + text.rstrip(" \t\f\\") + "\n")
        parts = [lexicon[t] for t in toks]
        indents = [len(t.rpartition("\n")[2].expandtabs().replace("\f", "")) for t, p in zip(toks, parts) if p == "\n"]
        cls = "".join(parts)
        out, at, depth, levels, k = [], 0, 0, [0], -1
        for m in points.finditer(cls):
            c = m.group()
            if c != "\n":
                depth += 1 if c in "([{" else -1
                continue
            k += 1
            out.append(cls[at : m.start()])
            at = m.end()
            if depth > 0:
                continue
            if out[-1] or len(out) > 1:
                out.append(newline)
            width = indents[k] if m.end() < len(cls) else 0
            if width > levels[-1]:
                levels.append(width)
                out.append("‹")
            while width < levels[-1]:
                levels.pop()
                out.append("›")
                if width > levels[-1]:
                    out.append(STRAY)
                    break
        out.append(cls[at:])
        return "".join(out)

    return lex


# --- ruby ---------------------------------------------------------------------------------------------------


def _ruby_lexer() -> Callable[[str], str]:
    quoted = r"\"(?:[^\"\\#]|\\[\s\S]|#(?!\{)|#\{(?:[^{}\"']|\"(?:[^\"\\#]|\\.|#(?!\{)|#\{[^{}]*+\})*+\"|'[^'\n]*+'|\{[^{}]*+\})*+\})*+\""
    single = r"'(?:[^'\\]|\\[\s\S])*+'"
    regex = r"/(?:[^/\\\n]|\\[^\n])++/[a-z]*+"
    before = r"(?:=>|[=!]~|==|&&|\|\||<<|[-+*%&|<>=!?:;,({\[~]|(?<![\w.])(?:if|elsif|unless|when|and|or|not|while|until|return|in|then|split|match)(?!\w)|\n)"
    percent = r"%[wWiIqQr]?(?:\((?:[^()\\]|\\.|\([^()]*+\))*+\)|\[(?:[^\[\]\\]|\\.)*+\]|\{(?:[^{}\\]|\\.|\{[^{}]*+\})*+\}|<[^<>\n]*+>|(?<=[a-zA-Z])([|!/])[^|!/\n]*+[|!/])[a-z]*+"
    method = r"(?:\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[+\-~!]@|[+\-*/%<>&|^~`]|[^\W\d]\w*+(?:[?!]|=(?![=~>]|\s*[^\s(]))?)"
    symbol = rf"(?<![:\w)\]}}]):(?:{quoted}|\[\]=?|(?:@@?|\$)?[^\W\d]\w*+[?!=]?(?![=>]|(?<==)[~>])|\*\*|<=>|===?|=~|!=?|<<|>>|<=|>=|[+\-~!]@|[+\-*/%<>&|^~])|(?<![:\w)\]}}]):[^\W\d]\w*+(?==>)"
    name = r"[^\W\d]\w*+(?:[?!](?![=]))?"
    token = re.compile(
        rf"(?m:^)=begin\b[\s\S]*?\n=end\b[^\n]*+|#[^\n]*+|\\\n|{before}[ \t]*+{regex}|(?<=\w ){regex}(?=[,.\s)]|$)|{_BREAK}|(?<![\w.])def\s++(?:(?:self|[^\W\d]\w*+)\.)?{method}|(?:&\.|(?<!\.)\.(?!\.)|(?<=[\w)\]}}])::)\s*+{name}|{percent}|{symbol}|(?<!\?)(?<!\? ){name}:(?![:\w])|(?<=[(,{{|] )[^\W\d]\w*+:(?!:)"
        rf"|{quoted}|{single}|`[^`\n]*+`|\$(?:\w++|[!@&~0-9_./,;<>\"'`+*?:\\$])|@@?\w++|(?<![\w)\]}}])\?[A-Za-z](?!\w)|{name}|{_RANGED}|{_operators('ruby')}|\S"
    )
    words = GRAMMARS["ruby"].words
    reserved = set(RUBY_RESERVED)
    tail = re.compile(rf"([\s\S]*?)[ \t]*({regex})")
    member = re.compile(r"(&\.|\.|::)\s*(.*)")

    def rule(t: str) -> str | None:
        c = t[0]
        if c == "#" or t.startswith("=begin") or t == "\\\n":
            return ""
        if c == "\n" and "/" not in t:
            return CLASSES["NL"]
        if c == "/" and len(t) > 2:
            return "R"
        if c == "%" and len(t) > 2 and not t[1] == "=":
            return "S"
        if t.startswith("def") and t[3:4].isspace():
            return words["def"] + "d"
        if c == ":" and len(t) > 1 and t != "::":
            m = member.fullmatch(t)
            return CLASSES["SYM"] if not m else words["::"] + ("C" if m.group(2)[0].isupper() else "i")
        m = member.fullmatch(t)
        if m and m.group(2) and m.group(2)[0] not in ".:&":
            return words[m.group(1)] + ("C" if m.group(2)[0].isupper() else "i")
        if "/" in t[1:] and c not in "\"'`":
            m = tail.fullmatch(t)
            if m:
                return (lexicon[m.group(1)] if m.group(1) else "") + "R"
        if t[-1] == ":" and len(t) > 1 and c not in ":?":
            return "l"
        if c in "@$" or c == "?" and len(t) == 2:
            return "i" if c != "?" else "S"
        if (c == "_" or c.isalpha()) and t not in reserved and t not in words:
            return "C" if c.isupper() else "i"
        return None

    lexicon = Lexicon("ruby", rule)
    nl = CLASSES["NL"]
    value = "iC0SYRd)]}" + "".join(words[w] for w in ("end", "self", "nil", "true", "false", "super", "yield", "return", "next", "break", "redo", "retry", "__method__"))
    modifier = re.compile(f"(?<=[{re.escape(value)}])(" + "|".join(words[w] for w in ("if", "unless", "while", "until", "rescue")) + ")")
    marked = {words[w]: words["§" + w] for w in ("if", "unless", "while", "until", "rescue")}
    loop = re.compile(f"([{words['while']}{words['until']}{words['for']}][^{nl}{words[';']}{words['do']}]*){words['do']}")
    endless = re.compile(rf"{words['def']}(?=d(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?{words['=']})")
    going_on = re.compile(f"(?<=[{re.escape(''.join(words[w] for w in (',', '=', '==', '!=', '&&', '||', '+', '-', '.', '&.', '::', '=>', '<<', '+=', '-=', '||=', '&&=', 'and', 'or', 'not', '<', '>', '<=', '>=', '=~')))}(\\[]){nl}+|{nl}+(?=[{words['.']}{words['&.']}])")
    heredoc = re.compile(r"<<[~-]?(['\"`]?)([A-Z_]\w*+)\1([^\n]*+)\n(?:[\s\S]*?\n)??[ \t]*+\2(?=\n|\Z)")

    def lex(text: str) -> str:
        text = re.split(r"(?m)^__END__$", text, maxsplit=1)[0]
        for _ in range(text.count("<<")):
            text, n = heredoc.subn(r'"h"\3', text)
            if not n:
                break
        cls = "".join([lexicon[m.group()] for m in token.finditer(text)])
        cls = going_on.sub("", re.sub(f"{nl}{nl}+", nl, cls))
        cls = modifier.sub(lambda m: marked[m.group()], cls)
        cls = loop.sub(rf"\g<1>{words['then']}", cls)
        return endless.sub(words["edef"], cls).strip(nl)

    return lex


# --- shell --------------------------------------------------------------------------------------------------


def _shell_lexer() -> Callable[[str], str]:
    single, plain = r"\$?'(?:[^'\\]|(?<!\$)\\|\\[\s\S])*?'|'[^']*+'", r"[^()'\"`\\]"
    sub, double = r"\$\((?:[^()'\"]|'[^']*+'|\"[^\"]*+\")*+\)", r"\"(?:[^\"\\]|\\[\s\S])*+\""
    for _ in range(3):
        brace = rf"\$\{{(?:[^{{}}'\"\\$`]|\\[\s\S]|'[^']*+'|\$(?![({{])|{double}|{sub}|\$\{{[^{{}}]*+\}})*+\}}"
        double = rf"\"(?:[^\"\\`$]|\\[\s\S]|\$(?![({{])|{sub}|{brace}|`(?:[^`\\]|\\[\s\S])*+`)*+\""
        round_ = rf"\((?:{plain}|\\[\s\S]|'[^']*+'|{double}|`[^`]*+`|\((?:{plain}|\\[\s\S]|'[^']*+'|{double}|\([^()]*+\))*+\))*+\)"
        sub = rf"\$(?:\(\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)\)|{round_})"
    piece = rf"[^\s;&|<>()'\"`$\\#]|(?<!\s)#|\\[\s\S]|'[^']*+'|\$'(?:[^'\\]|\\[\s\S])*+'|\$?{double}|{sub}|{brace}|`(?:[^`\\]|\\[\s\S])*+`|\$(?![('\"{{])|(?<=[?*+@!])\((?:[^()]|\([^()]*+\))*+\)"
    array = rf"[\w]++(?:\[[^\]\n]*+\])?\+?=\((?:[^()'\"`\\$#]|(?<=\s)#[^\n]*+|#|\\[\s\S]|'[^']*+'|{double}|{sub}|{brace}|`[^`]*+`|\$)*+\)"
    token = re.compile(
        rf"(?<![^\s;&|()])#[^\n]*+|\\\n|\n\s*+|\(\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)\)|(?<![^\s;&|(!])\[\[\s(?:[^\]'\"]|\](?!\])|'[^']*+'|{double})*?\s\]\](?=[\s;&|)]|\Z)|{array}|[<>]{round_}|(?<!\S)(?:\d+|\{{\w+\}})(?=[<>])|&>>|&>|<<<|<<-|<<|>>|<&|>&|<>|>\||[<>]|;;&|;&|;;|&&|\|\||\|&|[;&|()]|(?:{piece})++|\S"
    )
    heredoc = re.compile(r"(?<![<(\w])<<-?(?!<)[ \t]*+\\?(['\"]?)([^\W\d]\w*+)\1([^\n]*+)\n(?:[\s\S]*?\n)??[ \t]*+\2(?=\n|\Z)")
    words = GRAMMARS["shell"].words
    opening = {"then", "else", "elif", "if", "while", "until", "do", "!", "time"}
    closing = {"fi", "done", "esac"}
    redirects = {"&>>", "&>", "<<<", "<<-", "<<", ">>", "<&", ">&", "<>", ">|", "<", ">"}
    nl = CLASSES["NL"]

    def lex(text: str) -> str:
        for _ in range(text.count("<<")):
            text, n = heredoc.subn(r"<<h\3", text)
            if not n:
                break
        out: list[str] = []
        start, arms, name_next, want_in = True, False, "", ""
        toks = [m.group() for m in token.finditer(text)]
        k = 0
        while k < len(toks):
            t = toks[k]
            k += 1
            if t[0] == "#" or t == "\\\n":
                continue
            if t[0] == "\n":
                if out and out[-1] != nl:
                    out.append(nl)
                start = start or not want_in
                continue
            if arms and t != "esac":
                # the pattern of an arm up to its bracket
                while k < len(toks) and t != ")":
                    t = toks[k]
                    k += 1
                out.append(CLASSES["ARM"] if t == ")" else STRAY)
                arms, start = False, True
                continue
            if t in (";;", ";&", ";;&"):
                out.append(CLASSES["ARMEND"])
                arms = start = True
            elif t in redirects:
                out.append(CLASSES["REDIR"])
                start = False
            elif t in ("&&", "||", "|&", "|", "&", ";"):
                out.append(words[t])
                start, want_in = True, ""
            elif t in "()":
                out.append(t)
                start = True
            elif len(t) == 1 and t in "'\"`$\\":
                out.append(STRAY)
            elif (t.isdigit() or t[0] == "{" and t[-1] == "}") and k < len(toks) and toks[k] in redirects:
                continue
            elif want_in and t == "in" and want_in != "name":
                out.append(words["in"])
                arms, start, want_in = want_in == "case", False, ""
            elif want_in == "do" and t == "do":
                out.append(words["do"])
                start, want_in = True, ""
            elif name_next:
                if t.startswith("(("):
                    out.append(CLASSES["ARITH"])
                else:
                    out.append(CLASSES["WORD"])
                want_in, name_next, start = ("case" if name_next == "case" else "do"), "", False
            elif start and t in opening:
                out.append(words[t])
            elif start and t in closing:
                out.append(words[t] if t in words else code(t))
                arms = False
            elif start and t in ("for", "select", "case"):
                out.append(words[t])
                name_next = t
            elif start and t == "function":
                out.append(words[t])
                start = False
                if k < len(toks):
                    out.append(CLASSES["WORD"])
                    k += 1
                    start = True
            elif start and t in "{}":
                out.append(t)
            elif t.startswith("((") and start:
                out.append(CLASSES["ARITH"])
            elif t.startswith("[[") and len(t) > 2:
                out.append(CLASSES["COND"])
                start = False
            elif t[-1] == ")" and "=(" in t and t[0] not in "\"'$(`":
                out.append(CLASSES["ARRAY"])
                start = False
            else:
                out.append(CLASSES["WORD"])
                start = False
        return "".join(out).strip(nl)

    return lex


LEXERS: dict[str, Callable[[str], str]] = {
    "javascript": _script_lexer("javascript"),
    "typescript": _script_lexer("typescript"),
    "go": _go_lexer(),
    "java": _java_lexer(),
    "c": _c_lexer(),
    "rust": _rust_lexer(),
    "python": _python_lexer(),
    "ruby": _ruby_lexer(),
    "shell": _shell_lexer(),
}


def token_pairs(cls: str) -> list[str]:
    """Distinct adjacent tokens of a class string and of its ends, as strings of two; tokens parted by a line break that may end a statement are none."""
    codes = np.frombuffer(("⊢" + cls + EOF).encode("utf-16-le"), np.uint16).astype(np.uint32)
    pairs = np.unique(codes[:-1] << 16 | codes[1:]).tolist()
    soft = ord(SOFT)
    return [chr(p >> 16) + chr(p & 0xFFFF) for p in pairs if p >> 16 != soft and p & 0xFFFF != soft]
