"""Layout of one source file against its canonical re-emission (helper of problem 2)."""

from __future__ import annotations

import re

from collections import Counter

import xxhash

_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
_LEX = {
    "py": re.compile(r"(?P<c>#[^\n]*)|(?P<s>[rbuRBUfF]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|" + _STRING + r"))|(?P<n>(?<!\w)-?[\d.][\w.]*)|(?P<w>[^\W\d]\w*)|(?P<l>\n\s*)|(?P<p>[^\s\w])"),
    "rs": re.compile(
        r"""(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>b?r?#*"(?:[^"\\]|\\[\s\S])*"#*|b?'(?:[^'\\\n]|\\[^\n]{1,8})')|(?P<n>(?<!\w)-?\d[\w.]*)|(?P<w>'?[^\W\d]\w*)|(?P<l>\n\s*)|(?P<p>[^\s\w])"""
    ),
    "c": re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>" + _STRING + r")|(?P<n>(?<!\w)-?\d[\w.]*)|(?P<w>[^\W\d][\w$]*)|(?P<l>\n\s*)|(?P<p>[^\s\w])"),
}
_KEYWORDS = frozenset(
    "func function def fn class struct enum interface trait impl type return if else for while switch case match let const var import from package use pub export async await try except catch".split()
)
_MARKS = re.compile(r"(?m)^\s*(?:/\*+!?|\*+/|//+!?|\*|#+!?|\"\"\"|''')|\*+/\s*$")

# How a tool's output says of itself that it is one, and how libraries head their files.
_MACHINE = re.compile(
    r"code generated\b.*\bdo not|auto-?generated (?:file|by|from|code)|<auto-?generated>|@generated\b|automatically generated|machine[- ](?:written|generated|made)|generated by (?!the (?:server|client|user)\b).*(?:compiler|do not|tool|generator|\bv\d)"
    r"|(?:this file|file) (?:is|was|has been) (?:auto\w*[- ]?)?(?:generated|produced|emitted|written) by|do not (?:edit|modify)[^\n]*(?:generated|by hand)|(?:manual|hand) edits? (?:get|will be|are) (?:overwritten|lost)|changes (?:to this file )?will be (?:lost|overwritten)|generated (?:file|code)\b[^\n]*do not"
    r"|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée]e? automatiquement|automatiquement g[ée]n[ée]r|generad[oa] autom[áa]ticamente|autom[áa]ticamente generad|gerad[oa] automaticamente|generato automaticamente"
    r"|(?:автоматически (?:создан|сгенерирован)|(?:создан|сгенерирован)\w* автоматически)|自动生成|自動生成|自动产生|자동(?:으로)? ?생성|αυτόματα|स्वचालित|تلقائي|อัตโนมัติ",
    re.I,
)
_HOLDER = re.compile(r"(?:copyright|\(c\)|©)[^\n\w]*(?:\(c\)\s*)?(?:\d{4}(?:\s*[-–,]\s*\d{4})*,?\s+)?(?:the\s+)?([\w.-]+(?: [\w.-]+)?)\s+(?:contributors|authors|developers|project|foundation|team|inc)\b", re.I)
_LICENCE = re.compile(r"released under|licen[cs]ed under|distributed under|SPDX-|\b(?:MIT|BSD|Apache|ISC|MPL|GPL|LGPL)\b[^\n]*licen[cs]e|permission is hereby granted|redistribution and use", re.I)


def language(ext: str) -> str:
    return "py" if ext == ".py" else "rs" if ext == ".rs" else "c"


def compared(emitted: Counter, own: Counter) -> tuple[int, int]:
    """How many emitted lines, given with their depth, are lines of the file, given with their indent; and how many of
    these are indented by the file's step for each level of depth."""
    columns: dict[str, Counter] = {}
    for (column, line), n in own.items():
        columns.setdefault(line, Counter())[column] += n
    met = [(depth, Counter(columns[line]), n) for (depth, line), n in emitted.items() if line in columns]
    steps: Counter = Counter()
    for depth, at, n in met:
        for column in at:
            if depth > 0 and column and column % depth == 0:
                steps[column // depth] += n
    step = steps.most_common(1)[0][0] if steps else 0
    return sum(min(n, at.total()) for _, at, n in met), sum(min(n, at[depth * step]) for depth, at, n in met)


def measured(text: str, ext: str) -> dict:
    """Figures of one file: see FIELDS in authorship.py.

    The file is lexed and emitted again in canonical form: each statement on a line of its own, what a brace opens
    one step further in, one blank between tokens. The emitted lines are compared with the file's own, line by line
    as a multiset: what share of them the file has at all (`kept`), and with the same indent in steps (`indented`).
    A shape is the row of token kinds of a top-level unit, names and literals reduced to their kind, with its line
    breaks; a unit's print is that of its exact tokens.
    """
    lang = language(ext)
    lines, canonical, literal, total = 0, 0, 0, 0
    head: list[str] = []
    upper: list[str] = []  # comments after the imports, before the first unit of code
    coded = begun = False
    depth = brackets = 0
    units: list[tuple[str, str, int]] = []
    shape: list[str] = []
    exact: list[str] = []
    statement: list[str] = []
    emitted: Counter = Counter()  # canonical lines with their depth
    own: Counter = Counter()  # the file's lines with their indent
    line: list[str] = []
    line_coded, indent, level = False, 0, 0

    def close_unit() -> None:
        nonlocal begun
        if exact:
            begun = begun or (len(exact) >= 8 and exact[0] not in ("import", "use", "package", "from", "const", "log"))
            units.append((" ".join(shape).strip(" /"), " ".join(exact), len(exact)))
            shape.clear()
            exact.clear()

    def close_statement() -> None:
        nonlocal canonical
        if statement:
            canonical += 1
            emitted[level, " ".join(statement)] += 1
            statement.clear()

    def close_line() -> None:
        if line:
            own[indent, " ".join(line)] += 1
            line.clear()

    for m in _LEX[lang].finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "l":
            if line_coded:
                lines += 1
                line_coded = False
                shape.append("/")
            close_line()
            indent = len(token[token.rfind("\n") + 1 :].expandtabs(4))
            if lang == "py" and not brackets:
                close_statement()
                if not token[token.rfind("\n") + 1 :] and not text.startswith(("else", "elif", "except", "finally", ")", "]", "}"), m.end()):
                    close_unit()
            elif lang == "c" and ext == ".go" and not brackets:
                close_statement()
                if depth == 0:
                    close_unit()
            elif depth == 0 and "\n" in token[1:] and not brackets:
                close_statement()
                close_unit()
            continue
        if kind == "c":
            if not coded:
                head.append(token)
            elif depth == 0 and not begun:
                upper.append(token)
            continue
        size = len(token)
        total += size
        doc = kind == "s" and lang == "py" and not statement
        if kind == "s" and not coded and lang == "py":
            head.append(token)
            continue
        line_coded = True
        if kind in "sn" and not doc:
            literal += size
        elif kind == "p" and token in ",:[](){}-+":
            literal += token in ",-"
        if kind == "s" and "\n" in token:
            lines += token.count("\n")
            canonical += token.count("\n")
        coded = True
        symbol = token if kind == "p" or token in _KEYWORDS else "S" if kind == "s" else "N" if kind == "n" else "I"
        if not statement:
            level = depth - (token == "}") if lang != "py" else indent
        statement.append(token)
        line.append(token)
        shape.append(symbol)
        exact.append(token)
        begun = begun or (depth > 0 and len(exact) >= 8 and exact[0] not in ("import", "use", "package", "from"))
        if kind == "p":
            if token in "([":
                brackets += 1
            elif token in ")]":
                brackets = max(0, brackets - 1)
            elif token == "{" and lang != "py":
                depth += 1
                close_statement()
            elif token == "}" and lang != "py":
                depth = max(0, depth - 1)
                close_statement()
                if depth == 0 and not brackets:
                    close_unit()
            elif token == ";" and not brackets:
                close_statement()
                if depth == 0:
                    close_unit()
    if line_coded:
        lines += 1
    close_line()
    close_statement()
    close_unit()
    kept, indented = compared(emitted, own)
    head_text = _MARKS.sub("", "\n".join(head))
    bodies = [u for u in units if u[2] >= 8]
    common = Counter(u[0] for u in bodies).most_common(1)
    holder = _HOLDER.search(head_text)
    return {
        "lines": lines,
        "canonical": canonical,
        "kept": kept,
        "indented": indented,
        "chars": total,
        "literal_chars": literal,
        "units": len(bodies),
        "same_shape": common[0][1] if common else 0,
        "machine": bool(_MACHINE.search(head_text) or _MACHINE.search(_MARKS.sub("", "\n".join(upper)))),
        "holder": holder.group(1).lower() if holder and _LICENCE.search(head_text) else None,
        "prints": sorted({xxhash.xxh3_64_intdigest(e.encode()) >> 1 for _, e, _ in bodies if len(e) >= 80}),
    }
