"""A chart parser over bracket-collapsed token strings, driven by grammars given as text.

A token kind is one character. A pair of brackets and what it encloses is replaced, innermost first, by one
character that stands for the set of things its content can be (arguments, a block, a type ...), so each
content is a short flat string. The chart (Earley's) of a distinct content is computed once per process and
kept; files share nearly all of their contents, which makes the full parse of a file a few dictionary look-ups.
"""

from __future__ import annotations

import re

OPEN = {"(": "P", "[": "B", "{": "C"}
_GRAMMAR_TOKEN = re.compile(r"'[^']*'|[PBC]:\w+|%\w+|\w+|[()|*+?]")
_PRIVATE = 0xE000
#: Ranges of the characters of bracket groups, and from how many kinds on they are given out anew (between files).
RANGES = {"P": (0x100000, 0x104FFF), "B": (0x105000, 0x109FFF), "C": (0x10A000, 0x10EFFF)}
CROWDED = 10_000


class Grammar:
    """Rules `name : alternatives` in EBNF, one per line (continued lines are indented).

    'x' is a token, P:name, B:name and C:name a bracket group whose content is a `name`, %NAME a token class
    given by a line `%NAME = tok tok ...` (tokens that are also quoted somewhere stay tokens of their own).
    """

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.words: dict[str, str] = {}
        self.classes: dict[str, set[str]] = {}
        self._helpers = 0
        self._chars: dict[str, str] = {}
        logical: list[str] = []
        for line in text.strip().splitlines():
            if not line.strip() or line.startswith("#"):
                continue
            if line[0].isspace() and logical:
                logical[-1] += " " + line.strip()
            else:
                logical.append(line.strip())
        quoted = set(re.findall(r"'([^']*)'", "\n".join(line for line in logical if not line.startswith("%"))))
        for line in logical:
            if line.startswith("%"):
                name, members = line.split("=", 1)
                name = name.strip()
                self.rules[name] = [("'" + self._char(name),)]
                for word in members.split():
                    if word in quoted:
                        self.rules[name].append(("'" + self._word(word),))
                    else:
                        self.words[word] = self._char(name)
        for line in logical:
            if not line.startswith("%"):
                name, body = line.split(":", 1)
                self._tokens, self._at = _GRAMMAR_TOKEN.findall(body), 0
                self.rules.setdefault(name.strip(), []).extend(self._alternatives())
        unknown = {s for alts in self.rules.values() for alt in alts for s in alt if s[0] != "'" and s[1:2] != ":" and s not in self.rules}
        if unknown:
            raise ValueError(f"undefined in the grammar: {sorted(unknown)}")
        self.comma = self._word(",")
        self._repeat = re.compile(rf"((?:[^{self.comma}]{{1,4}}){self.comma})\1{{2,}}")
        self.nullable = self._nullable()
        self.group_names = {k: sorted({s[2:] for alts in self.rules.values() for alt in alts for s in alt if s[:2] == f"{k}:"} - {"any"}) for k in "PBC"}
        self._charts: dict[tuple[str, tuple[str, ...]], frozenset[str]] = {}
        self._group_sets: dict[str, frozenset[str]] = {}
        self._group_chars: dict[frozenset[str], str] = {}
        self._groups = dict.fromkeys(RANGES, 0)

    def _char(self, symbol: str) -> str:
        return self._chars.setdefault(symbol, chr(_PRIVATE + len(self._chars)))

    def _word(self, word: str) -> str:
        return self.words.setdefault(word, self._char(f"'{word}'"))

    # EBNF -> BNF
    def _alternatives(self) -> list[tuple[str, ...]]:
        alts, seq = [], []
        while self._at < len(self._tokens) and self._tokens[self._at] != ")":
            token = self._tokens[self._at]
            self._at += 1
            if token == "|":
                alts.append(tuple(seq))
                seq = []
                continue
            if token == "(":
                inner = self._alternatives()
                self._at += 1
                symbol = self._helper(inner)
            elif token[0] == "'":
                symbol = "'" + self._word(token[1:-1])
            else:
                symbol = token
            if self._at < len(self._tokens) and self._tokens[self._at] in "*+?":
                mark = self._tokens[self._at]
                self._at += 1
                if mark == "?":
                    symbol = self._helper([(), (symbol,)])
                else:
                    name = f"_{self._helpers}"
                    self._helpers += 1
                    self.rules[name] = [() if mark == "*" else (symbol,), (name, symbol)]
                    symbol = name
            seq.append(symbol)
        alts.append(tuple(seq))
        return alts

    def _helper(self, alts: list[tuple[str, ...]]) -> str:
        name = f"_{self._helpers}"
        self._helpers += 1
        self.rules[name] = alts
        return name

    def _nullable(self) -> set[str]:
        found: set[str] = set()
        while True:
            more = {n for n, alts in self.rules.items() if any(all(s in found for s in alt) for alt in alts)} - found
            if not more:
                return found
            found |= more

    # contents
    def derives(self, content: str, starts: tuple[str, ...]) -> frozenset[str]:
        """Which of `starts` derive `content`."""
        key = (content, starts)
        known = self._charts.get(key)
        if known is None:
            if len(self._charts) > 200_000:
                self._charts.clear()
            known = self._charts[key] = frozenset(self._earley(content, starts))
        return known

    def group_char(self, kind: str, names: frozenset[str]) -> str:
        """The character of a bracket group that can be any of `names`."""
        key = frozenset(f"{kind}:{n}" for n in names) | {f"{kind}:any"}
        char = self._group_chars.get(key)
        if char is None:
            char = chr(RANGES[kind][0] + self._groups[kind])
            self._groups[kind] += 1
            self._group_chars[key] = char
            self._group_sets[char] = key
        return char

    def crowded(self) -> bool:
        """Whether so many kinds of groups are known that all should be forgotten before the next file."""
        return max(self._groups.values()) > CROWDED

    def forget(self) -> None:
        for known in (self._charts, self._group_sets, self._group_chars):
            known.clear()
        self._groups = dict.fromkeys(RANGES, 0)

    def squeezed(self, content: str) -> str:
        """`content` with runs of equal comma-separated elements cut to two: no list rule tells two from more."""
        return self._repeat.sub(r"\1\1", content) if len(content) > 12 else content

    def can_be(self, char: str) -> frozenset[str]:
        """What the group of `char` can be, apart from `any`."""
        return frozenset(n for n in self._group_sets.get(char, ()) if not n.endswith(":any"))

    def _earley(self, content: str, starts: tuple[str, ...]) -> list[str]:
        rules, nullable = self.rules, self.nullable
        sets: list[dict] = [{}]
        waiting: list[dict[str, list]] = [{}]
        for start in starts:
            for alt in rules[start]:
                sets[0][(start, alt, 0, 0)] = None
        size = len(content)
        for at in range(size + 1):
            here, waits = sets[at], waiting[at]
            queue = list(here)
            following: dict = {}
            char = content[at] if at < size else ""
            matches = self._group_sets.get(char) or {"'" + char}
            predicted: set[str] = set()
            for item in queue:
                name, alt, dot, origin = item
                if dot < len(alt):
                    symbol = alt[dot]
                    if symbol in rules:
                        waits.setdefault(symbol, []).append(item)
                        if symbol not in predicted:
                            predicted.add(symbol)
                            for option in rules[symbol]:
                                new = (symbol, option, 0, at)
                                if new not in here:
                                    here[new] = None
                                    queue.append(new)
                        if symbol in nullable:
                            new = (name, alt, dot + 1, origin)
                            if new not in here:
                                here[new] = None
                                queue.append(new)
                    elif symbol in matches:
                        following[(name, alt, dot + 1, origin)] = None
                elif origin < at or not alt or dot:
                    for waiter in waiting[origin].get(name, ()):
                        new = (waiter[0], waiter[1], waiter[2] + 1, waiter[3])
                        if new not in here:
                            here[new] = None
                            queue.append(new)
            if at < size:
                if not following:
                    return []
                sets.append(following)
                waiting.append({})
        ends = sets[size]
        return [s for s in starts if any((s, alt, len(alt), 0) in ends for alt in rules[s])]
