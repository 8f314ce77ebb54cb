"""Source files that do not parse (problem 1): lexers, and charts over whole files."""

from __future__ import annotations

import re
from functools import lru_cache

from cairn.llm.chart import OPEN, RANGES, Grammar
from cairn.llm.grammars import TEXTS

BAD = ""
_SEP = ""
_CLOSE = {")": "(", "]": "[", "}": "{"}
_INDENT = 0xF0000
_INDENTS = re.compile("[\U000f0000-\U000fffff]")
_INNERMOST = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

_WORD = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_SLASHES = r"//[^\n]*"
_BLOCK = r"/\*[\s\S]*?\*/"
_TEMPLATE_CODE = r"(?:[^{}`]|\{(?:[^{}]|\{[^{}]*\})*\}|`[^`]*`)*"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_TEMPLATE_CODE}\}})*`"
_LINE_STARTS = "|".join([*(rf"(?<=\n {{{k}}})" for k in range(1, 41)), *(rf"(?<=\n\t{{{k}}})" for k in range(1, 11))])
_REGEX = (
    r"(?=/(?![*/]))(?:(?<=[=(,:\[!&|?{};~^+*%<>\n-])|(?<=[=(,:\[!&|?{};~^+*%<>-] )|(?<=return )|(?<=typeof )|(?<=case )|"
    + _LINE_STARTS
    + r")/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"
)

_SKIP = {
    "go": rf"[ \t\r﻿]+|{_SLASHES}",
    "js": rf"[ \t\r\f﻿ ]+|{_SLASHES}|(?<![\s\S])#![^\n]*|<!--[^\n]*",
    "ts": rf"[ \t\r\f﻿ ]+|{_SLASHES}|(?<![\s\S])#![^\n]*",
    "rs": rf"[ \t\r\n﻿]+|{_SLASHES}|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/|(?<![\s\S])#!(?!\[)[^\n]*",
    "py": r"[ \t\r\f﻿]+|\\\r?\n|#[^\n]*",
}
_LITERAL = {
    "go": rf"{_BLOCK}|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n'][^'\n]*|\\')'|{_NUMBER}i?(?!\w)",
    "js": rf"{_BLOCK}|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}|{_NUMBER}n?(?!\w)",
    "ts": rf"{_BLOCK}|{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}|{_NUMBER}n?(?!\w)",
    "rs": rf"""b?c?r(#*)"[\s\S]*?"\2|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\[^\n'][^'\n]*|\\')'|'{_WORD}(?!')|r\#{_WORD}|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)""",
    "py": rf"""(?:[rRuUbBfF]|[bBfF][rR]|[rR][bBfF])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')|{_NUMBER}[jJ]?(?!\w)""",
}
#: Newlines are tokens where they matter; Python's hold the blank and comment lines before them, and the next line's indent.
_NEWLINE = {"go": r"\n", "js": r"\n", "ts": r"\n", "rs": None, "py": r"(?:[ \t\r\f]*(?:#[^\n]*)?\n)+[ \t\f]*"}
#: Tokens after which Go ends a statement at a line end; for scripts, tokens that can't end one or can't begin one.
_GO_ENDERS = ("i", "n", "s", "++", "--", "return", "break", "continue", "fallthrough")
_JS_OPENERS = (". ?. , ; : ? = => in instanceof extends implements as is satisfies else catch finally of from".split(), ("%BOP", "%ASG"), ("+", "-", "*", "<", ">"))


class _Kinds(dict):
    """Token text -> kind character, filled as tokens come up."""

    def __init__(self, language: str, grammar: Grammar):
        super().__init__()
        self.language, self.grammar = language, grammar
        #: Columns of an indent, tabs going to multiples of eight and counting one, by the place of its kind.
        self.columns: list[tuple[int, int]] = [(0, 0)]

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        kind = self[token] = self._kind(token)
        return kind

    def _kind(self, token: str) -> str:
        words, first, last = self.grammar.words, token[0], token[-1]
        if token in ("\n", *"()[]{}") and not (token == "\n" and self.language == "py"):
            return token
        if token in words and token not in ("i", "n", "s", "t", "l"):
            return words[token]
        if first == "\n" or (self.language == "py" and last in " \t\f\n" and "\n" in token and first in " \t\r\f#\n"):
            if self.language != "py":
                return "\n"
            indent = re.split("[\n\f]", token)[-1]
            columns = (len(indent.expandtabs(8)), len(indent))
            if columns not in self.columns:
                self.columns.append(columns)
            return chr(_INDENT + self.columns.index(columns))
        if self.language == "py" and first in " \t\r\f#" and "\n" in token:
            return chr(_INDENT)
        if token.startswith("/*"):
            return "\n" if "\n" in token and self.language != "rs" else ""
        if first == "`" and self.language in ("js", "ts"):
            return words.get("t", BAD) if len(token) > 1 and last == "`" and self._template(token) else BAD
        if first == "'" and self.language == "rs" and (last != "'" or len(token) == 1):
            return words["l"] if len(token) > 1 else BAD
        if self.language == "py" and last in "\"'" and (m := _F_START.match(token)):
            return words["s"] if self._fields(token, m) else BAD
        if len(token) > 1 and (last in "\"'`" or (first == "/" and self.language in ("js", "ts")) or (self.language == "rs" and last == "#")):
            return words["s"]
        if first.isdigit() or (first == "." and len(token) > 1 and token[1].isdigit()):
            return words["n"] if _number(token, self.language) else BAD
        if first == "r" and token[1:2] == "#":
            return words["i"]
        if first.isalpha() or first in "_$":
            return words["i"]
        return BAD

    def _template(self, token: str) -> bool:
        holes: list[str] = []
        checker = checker_of(self.language)
        return _template_end(token, 1, holes) == len(token) and all(checker.derives_text(code, "expr") for code in holes)

    def _fields(self, token: str, start: re.Match) -> bool:
        fields: list[str] = []
        checker = checker_of("py")
        return _f_end(token, start.end(), start.group(2), fields) == len(token) and all(checker.derives_text(code, "field") for code in fields)


#: What matters inside a template, in the code inside it, inside an f-string and inside a replacement field of it.
_IN_TEMPLATE = re.compile(r"`|\\[\s\S]|\$\{")
_IN_CODE = re.compile(rf"{_DQ}|{_SQ}|{_SLASHES}|{_BLOCK}|[`{{}}]")
_F_START = re.compile(r"(?<!\w)([fF][rR]?|[rR][fF])(\"\"\"|'''|\"|')")
_IN_F = re.compile(r"\\[^{}]|\{\{|\}\}|\"\"\"|'''|[\"'{}\n]")
_IN_FIELD = re.compile(r"([A-Za-z]*)(\"\"\"|'''|\"|')|!=|[()\[\]{}:!]|#[^\n]*")
_PLAIN = {q: re.compile(rf"(?:[^\\]|\\[\s\S])*?{q}" if len(q) == 3 else rf"(?:[^{q}\\\n]|\\[\s\S])*{q}") for q in ('"""', "'''", '"', "'")}
_REGEX_BODY = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of instanceof new delete void throw do else yield await".split())
_HEADS = frozenset(("if", "while", "for", "with"))


def _template_end(text: str, at: int, holes: list[str] | None = None) -> int:
    """Where the template ends whose text begins at `at`, -1 if nowhere; its own code goes to `holes`.

    The stack holds what is open: 0 for a template's text, else the number of open braces of code in one.
    """
    stack, began = [0], at
    while stack:
        m = (_IN_CODE if stack[-1] else _IN_TEMPLATE).search(text, at)
        if not m:
            return -1
        at, mark = m.end(), m.group()
        if mark == "`":
            if stack[-1]:
                stack.append(0)
            else:
                stack.pop()
        elif mark == "${":
            stack.append(1)
            began = at if len(stack) == 2 else began
        elif mark in ("{", "}") and stack[-1]:
            stack[-1] += 1 if mark == "{" else -1
            if not stack[-1]:
                stack.pop()
                if len(stack) == 1 and holes is not None:
                    holes.append(text[began : at - 1])
    return at


def _f_end(text: str, at: int, quote: str, fields: list[str]) -> int:
    """Where the f-string ends whose text begins at `at`, -1 if nowhere; its expressions go to `fields`.

    The stack holds what is open: a string's quote, a replacement field as [start of its expression, its open
    brackets], and ":" for a format.
    """
    stack: list = [quote]
    while stack:
        top = stack[-1]
        if isinstance(top, list):
            m = _IN_FIELD.search(text, at)
            if not m:
                return -1
            at, mark = m.end(), m.group()
            if m.group(2):
                if "f" in m.group(1).lower():
                    stack.append(m.group(2))
                else:
                    m = _PLAIN[m.group(2)].match(text, at)
                    if not m:
                        return -1
                    at = m.end()
            elif mark in "([{":
                top[1] += 1
            elif mark in ")]}" and top[1]:
                top[1] -= 1
            elif mark in ":!}" and not top[1]:
                fields.append(text[top[0] : at - 1])
                if mark == "!":
                    m = re.compile(r"\s*[rsa]\s*([:}])").match(text, at)
                    if not m:
                        return -1
                    at, mark = m.end(), m.group(1)
                stack.pop()
                if mark == ":":
                    stack.append(":")
            elif mark[0] in ")]":
                return -1
            continue
        m = _IN_F.search(text, at)
        if not m:
            return -1
        at, mark = m.end(), m.group()
        if mark == "{" or (top == ":" and mark == "{{"):
            at = m.start() + 1
            stack.append([at, 0])
        elif top == ":":
            if mark in ("}", "}}"):
                at = m.start() + 1
                stack.pop()
            elif mark == "\n" or mark[0] in "\"'":
                whole = next(x for x in reversed(stack) if isinstance(x, str) and x != ":")
                if mark == whole or (mark == "\n" and len(whole) == 1):
                    return -1
        elif mark == top:
            stack.pop()
        elif len(top) == 1 and (mark == "\n" or (len(mark) == 3 and mark[0] == top)):
            if mark == "\n":
                return -1
            at = m.start() + 1
            stack.pop()
        elif mark == "\\N" and text[at : at + 1] == "{":
            at = text.find("}", at) + 1 or len(text)
        elif mark == "}":
            return -1
    return at


def _number(token: str, language: str = "") -> bool:
    if language == "py" and token[0] == "0" and token.replace("_", "").isdigit() and token.strip("0_"):
        return False
    return not (token.endswith("_") or "__" in token or (len(token) > 1 and token[0] == "0" and token.isdigit() and token.strip("0") != "" and set(token) & set("89")))


class Checker:
    """Lexer, grammar and lists of one language; keeps what it has parsed."""

    def __init__(self, language: str):
        self.language = language
        text, self.lists = TEXTS[language]
        self.grammar = g = Grammar(text)
        words = sorted((w for w in g.words if w not in ("i", "n", "s", "t", "l") and not re.fullmatch(r"\w+", w)), key=len, reverse=True)
        ops = "|".join(map(re.escape, words))
        newline = _NEWLINE[language]
        word = "[^\\W\\d][\\w\U000e0100-\U000e01ef]*" if language == "py" else r"[^\W\d]\w*" if language in ("go", "rs") else r"(?:[^\W\d]|\$)[\w$]*"
        lead = f"({newline}|" if newline else "("
        body = f"{_LITERAL[language]}|{word}|{ops}|[\\s\\S])"
        skip = _SKIP[language]
        if language == "py":  # its newlines begin with blanks
            self._tokens = re.compile(f"({newline})|{skip}|({body[:-1]})")
        else:
            self._tokens = re.compile(f"{skip}|{lead}{body}")
        self.kinds = _Kinds(language, g)
        self._memo: dict[str, str] = {}
        c = lambda *names: "".join(g.words[n] for n in names if n in g.words)
        groups = {k: f"{chr(a)}-{chr(b)}" for k, (a, b) in RANGES.items()}
        if language == "go":
            self._end = re.compile(f"(?<=[{c(*_GO_ENDERS)}{groups['P']}{groups['B']}{groups['C']}])\n+")
        elif language in ("js", "ts"):
            plain, classes, more = _JS_OPENERS
            before = c(*plain, *more, "new", "typeof", "void", "delete", "await", "!", "~", "function", "class", "const", "let", "var", "throw", "case", "do", "if", "while", "for", "async", "type", "interface", "@", "|")
            after = c(*plain, *more, "!==", "|")
            both = "".join(g._char(name) for name in classes)
            before = "".join(x for x in before if x not in c("async", "type", "interface", "of", "from", "as", "is", "satisfies", ">"))
            after = "".join(x for x in after if x not in c("of", "from", "is", "implements", "extends", "*") + c("async"))
            heads = c("if", "while", "for", "with")
            self._glue = re.compile(f"(?<=[{re.escape(before + both)}])\n+|\n+(?=[{re.escape(after + both)}])|(?<=[{heads}][{groups['P']}])\n+|(?<=[{groups['P']}])\n+(?=[{groups['C']}])|^\n+|\n+$")
            self._else = re.compile(f"{c(';')}(?=\n*{c('else')})")
            #: An arrow function with a block as its body is no operand.
            self._called_arrow = re.compile(f"{c('=>')}[{groups['C']}][{groups['P']}{groups['B']}{c('.', '?.')}{g._char('%BOP')}]")
        #: A statement doesn't begin with a function or class that has no name.
        self._nameless = re.compile(f"{c('async')}?{c('function')}{c('*')}?[{groups['P']}]|{c('class')}[{c('extends')}{groups['C']}]") if language in ("js", "ts") else None
        keywords = {
            "rs": "let for while loop return match pub fn struct impl use enum trait mod const static".split(),
            "js": "if for const let var return function class export import throw try switch break continue".split(),
        }
        keywords["ts"] = keywords["js"]
        if language in keywords:
            self._boundary = re.compile(f"(?<=[{groups['C']}])(?=[{c(*keywords[language])}])")

    def _found(self, source: str):
        """(place, token) of all tokens, one after the other: slower than `tokens`, but it knows what may nest
        without end (templates, f-strings) and, by what came before, where a slash begins a regular expression."""
        at, size, python, script = 0, len(source), self.language == "py", self.language in ("js", "ts")
        before, line_end, heads, headed = "", False, [], False
        while at < size:
            end = 0
            if python:
                m = _F_START.match(source, at)
                end = _f_end(source, m.end(), m.group(2), []) if m else 0
            elif script and source[at] == "`":
                end = _template_end(source, at + 1)
            elif script and source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*"):
                ready = not before or before in _BEFORE_REGEX or (before == ")" and headed) or (before == "}" and line_end) or not (before[-1].isalnum() or before[-1] in "_$\"'`)]}" or before in ("++", "--"))
                m = _REGEX_BODY.match(source, at) if ready else None
                end = m.end() if m else at + 1 + (source[at + 1 : at + 2] == "=")
            if end > at:
                token = source[at:end]
            else:
                m = self._tokens.match(source, at)
                end = m.end()
                token = next((t for t in m.groups()[: 1 + python] if t), "")
            if token:
                yield at, token
                if token == "(":
                    heads.append(before in _HEADS)
                elif token == ")":
                    headed = bool(heads) and heads.pop()
                line_end = token == "\n" or (line_end and token.startswith("/*"))
                if token != "\n" and not token.startswith("/*"):
                    before = token
            at = end

    def tokens(self, text: str, nested: bool = False) -> list[str]:
        """Kinds of the tokens, brackets as they are."""
        kinds = self.kinds
        if nested:
            return [kinds[t] for _, t in self._found("\n" + text if self.language == "py" else text)]
        if self.language == "rs":
            return [kinds[t] for t, _ in self._tokens.findall(text) if t]
        if self.language == "py":
            return [kinds[a or b] for a, b in self._tokens.findall("\n" + text) if a or b]
        return [kinds[t] for t in self._tokens.findall(text) if t]

    # contents
    def _units(self, content: str, name: str = "") -> list[str]:
        g = self.grammar
        if self.language == "go":
            parted = self._end.sub(_SEP, content).replace("\n", "")
            if name not in ("block", "switch", "select"):  # whose headers hold semicolons as well
                parted = parted.replace(g.words[";"], _SEP)
            return [u for u in parted.split(_SEP) if u]
        if self.language == "rs":
            flat = content if g.words["=>"] in content else self._boundary.sub(g.words[";"], content)
            return [u for u in flat.split(g.words[";"]) if u]
        flat = self._glue.sub("", content).replace("\n", g.words[";"])
        flat = self._else.sub(_SEP, self._boundary.sub(g.words[";"], flat))
        units = [u.replace(_SEP, g.words[";"]) for u in flat.split(g.words[";"]) if u]
        for i in range(len(units) - 1, 0, -1):  # do x; while (y)
            if units[i][0] == g.words["while"] and g.words["do"] in units[i - 1] and g.words["while"] not in units[i - 1]:
                units[i - 1 : i + 1] = [units[i - 1] + g.words[";"] + units[i]]
        return units

    def _is_list(self, content: str, kind: str, name: str) -> bool:
        allowed, rest = self.lists[(kind, name)]
        if self.language == "js" and self._called_arrow.search(content):
            return False
        for unit in self._units(content, name):
            found = self.grammar.derives(unit, allowed)
            if not found or self._nameless and self._nameless.match(unit):
                return False
            allowed = self._later(found, rest)
        return True

    def _later(self, found: frozenset[str], rest: tuple[str, ...]) -> tuple[str, ...]:
        """What may come after a unit: in Go no import after another declaration."""
        return ("decl",) if self.language == "go" and found == {"decl"} else rest

    def _flat(self, content: str) -> str:
        if self.language == "go":
            return self._end.sub(_SEP, content).replace("\n", "")
        if self.language == "py":
            return _INDENTS.sub("", content)
        return content.replace("\n", "")

    def names_of(self, kind: str, content: str) -> frozenset[str]:
        """What a bracket's content can be."""
        if self.language == "js" and self._called_arrow.search(content):
            return frozenset()
        listed = [n for k, n in self.lists if k == kind]
        plain = tuple(n for n in self.grammar.group_names[kind] if n not in listed)
        found = self.grammar.derives(self.grammar.squeezed(self._flat(content)), plain) if plain else frozenset()
        return found | {n for n in listed if self._is_list(content, kind, n)}

    def _close(self, group: str) -> str:
        char = self._memo.get(group)
        if char is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            kind = OPEN[group[0]]
            char = self._memo[group] = self.grammar.group_char(kind, self.names_of(kind, group[1:-1]))
        return char

    def collapsed(self, kinds: str) -> str:
        while True:
            kinds, n = _INNERMOST.subn(lambda m: self._close(m.group()), kinds)
            if not n:
                return kinds

    def derives_text(self, text: str, start: str) -> bool:
        for nested in (False, True):
            flat = self._flat(self.collapsed("".join(self.tokens(text, nested))))
            if self.grammar.derives(flat, (start,)):
                return True
            if self.language not in ("js", "ts", "py"):
                break
        return False

    # files
    def valid(self, text: str) -> bool:
        """Whether the whole file is in the language."""
        if self.grammar.crowded():
            self._memo.clear()
            self.grammar.forget()
        if self._valid("".join(self.tokens(text))):
            return True
        nests = ("`" in text or "/" in text) if self.language in ("js", "ts") else self.language == "py" and _F_START.search(text)
        return bool(nests) and self._valid("".join(self.tokens(text, True)))

    def _valid(self, kinds: str) -> bool:
        if BAD in kinds:
            return False
        flat = self.collapsed(kinds)
        if any(b in flat for b in "()[]{}"):
            return False
        if self.language == "py":
            return self._python(flat) is None
        if self.language == "go" and not self._units(flat):
            return False
        return self._is_list(flat, "", "file")

    _BODY = {"def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case"}
    _AFTER = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}

    def _python(self, flat: str) -> int | None:
        """Number (from 0) of the first logical line that is wrong, None if all are right."""
        g = self.grammar
        parts = re.split("([\U000f0000-\U000fffff])", flat)
        stack: list[list] = [[(0, 0), None]]  # indent, what the last statement there began with
        opened = False
        decorated = False
        number = -1
        for indent_char, line in zip(parts[1::2], parts[2::2], strict=True):
            if not line:
                continue
            number += 1
            indent = self.kinds.columns[ord(indent_char) - _INDENT]
            if opened:  # deeper however tabs are counted
                if indent[0] <= stack[-1][0][0] or indent[1] <= stack[-1][0][1]:
                    return number
                stack.append([indent, None])
            elif indent[0] > stack[-1][0][0]:
                return number
            else:
                while indent[0] < stack[-1][0][0]:
                    if stack.pop()[1] == "try":
                        return number
                if indent != stack[-1][0]:
                    return number
            kinds = g.derives(g.squeezed(line), ("simple", "header", "decorator"))
            if not kinds:
                return number
            head, before = self._head(line), stack[-1][1]
            if "header" in kinds and head:
                if head in self._AFTER:
                    if before not in self._AFTER[head]:
                        return number
                elif before == "try" or (head == "case") != (len(stack) > 1 and stack[-2][1] == "match"):
                    return number
                if decorated and head not in ("def", "class"):
                    return number
                opened = line.endswith(g.words[":"])
                stack[-1][1] = head
                decorated = False
            else:
                if before == "try" or decorated and "decorator" not in kinds or len(stack) > 1 and stack[-2][1] == "match":
                    return number
                opened = False
                decorated = "decorator" in kinds
                stack[-1][1] = None
        if opened or decorated or any(s[1] == "try" for s in stack):
            return number + 1
        return None

    def _head(self, line: str) -> str | None:
        names = self._names
        head = names.get(line[0])
        if head == "async":
            head = names.get(line[1:2])
        return head if head in self._BODY else None

    @property
    def _names(self) -> dict[str, str]:
        if "_name_cache" not in self.__dict__:
            self.__dict__["_name_cache"] = {v: k for k, v in self.grammar.words.items()}
        return self.__dict__["_name_cache"]

    def first_error(self, text: str) -> tuple[int, str]:
        """Line (from 1) and nature of the first error no parse recovers from; (0, '') for a valid text.

        A second pass for files known to be wrong: brackets are closed one by one, so the first content that
        can be nothing is found with its line.
        """
        if self.valid(text):
            return 0, ""
        source = "\n" + text if self.language == "py" else text
        stack: list[list] = [["", 1, []]]
        line, at = 1 - (self.language == "py"), 0
        for start, token in self._found(source):
            line += source.count("\n", at, start)
            at = start
            kind = self.kinds[token]
            if kind == BAD:
                return line, "token"
            if kind in OPEN:
                stack.append([kind, line, []])
            elif kind in _CLOSE:
                if stack[-1][0] != _CLOSE[kind]:
                    return line, "bracket"
                _, began, content = stack.pop()
                char = self._close(_CLOSE[kind] + "".join(k for k, _ in content) + kind)
                if not self.grammar.can_be(char):
                    return self._first_bad(content, OPEN[_CLOSE[kind]], began), "content"
                stack[-1][2].append((char, began))
            else:
                stack[-1][2].append((kind, line + (token.count("\n") if self.language == "py" and token[0] in "\n# \t" else 0)))
        if len(stack) > 1:
            return stack[-1][1], "unclosed"
        content = stack[0][2]
        if self.language == "py":
            wrong = self._python("".join(k for k, _ in content))
            starts = [ln for (k, ln), (after, _) in zip(content, content[1:] + [("", 0)], strict=True) if _INDENTS.match(k) and after and not _INDENTS.match(after)]
            return (starts[wrong] if wrong is not None and wrong < len(starts) else line), "statement"
        return self._first_bad(content, "", 1), "statement"

    def _first_bad(self, content: list[tuple[str, int]], kind: str, began: int) -> int:
        """Line where the shortest prefix ends that nothing right begins with, among the lists of this kind."""
        flat = "".join(k for k, _ in content)
        far = 0
        for (k, name), (first, rest) in self.lists.items():
            if k != kind:
                continue
            place, allowed = 0, first
            for unit in self._units(flat, name):
                found = self.grammar.derives(unit, allowed)
                if not found:
                    break
                place += len(unit)
                allowed = self._later(found, rest)
            far = max(far, place)
        seen = 0
        for k, ln in content:
            if k == "\n" or k == self.grammar.words.get(";"):
                continue
            if seen >= far:
                return ln
            seen += 1
        return began


@lru_cache(maxsize=None)
def checker_of(language: str) -> Checker:
    return Checker(language)
