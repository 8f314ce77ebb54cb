"""Whether a comment describes its function (helper of problem 3)."""

from __future__ import annotations

import re

# What directives, notes, legal lines and stand-ins look like.
_DIRECTIVE = re.compile(
    r"^\s*(?:nolint|noqa|noinspection|go:\w+|\+build|eslint[-\w]*|ts[-_](?:ignore|expect-error|nocheck)|@ts-\w+|type:\s*ignore|pragma\b|pylint\b|mypy\b|pyright\b|flake8\b|ruff\b|isort\b|fmt:|yapf\b"
    r"|istanbul\b|c8\b|v8 ignore|jshint\b|jslint\b|tslint\b|prettier-ignore|biome-ignore|rustfmt\b|clippy\b|allow\(|cfg\(|@(?:internal|inherit\w*|override|private|public|protected|hidden|ignore|deprecated|api)\b"
    r"|\{@inheritDoc\}|#?region\b|#?endregion\b|sourceMappingURL|lint\b|coverage:|nosec\b|NOSONAR)",
    re.I,
)
_LEGAL = re.compile(r"copyright\b|\(c\)\s*\d{4}|all rights reserved|licen[cs]ed under|SPDX-|released under|permission is hereby|\blicen[cs]e\b.*\b(?:file|terms|apache|mit|bsd|gpl)", re.I)
_NOTE = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|WIP|TBD|BUG|OPTIMI[SZ]E|REVISIT)\b(?:\([^)]*\))?[:\s-]*", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?:params?|arg|argument|returns?|throws?|exception|raises?|type|template|typeparam|example|see|since|author|version|yields?|memberof|class|function|name|property)\b|:\w+(?: [^:]*)?:|\* `[^`]*`(?:\s*[-–:].*)?$)", re.I)
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args?|arguments?|params?|parameters?|returns?|raises?|yields?|errors?|panics?|examples?|throws?|safety|attributes|see also|notes?)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:return\b.*[();]|(?:if|for|while|switch|match)\b.*[({:]\s*$|(?:let|const|var|import|from|def|func|fn|class|pub)\b.*[=({;:]|[\w.\[\]]+\s*(?::=|[-+*/|&]?=)(?!=)\s*\S|[\w.:]+\([^)]*\)(?:\.\w+\([^)]*\))*;?\s*$|[)\]}]+;?$|else\b|try\b\s*[:{]|>>> |\$ )"
)
_STAND_INS = frozenset(
    "description, function description, method description, add description, add a description here, no description, no description available, missing docs, missing documentation, no docs, no docs yet, undocumented,"
    " documentation, docs, see above, see below, ditto, same as above, as above, self explanatory, self-explanatory, obvious, tbd, wip, todo, n/a, na, none, nothing, comment, comment here, doc, inherit, inheritdoc, placeholder, summary, helper, internal, lorem ipsum".split(",")
)
_STAND_INS = frozenset(s.strip() for s in _STAND_INS)
_GENERIC = frozenset(
    "a an the this that these those of for to in on at by with from and or is are be it its as into given function func method procedure routine fn does do performs perform implements implementation implement "
    "returns return gets get sets set handles handle helper utility method's called used use simple new value values result results param params parameter parameters arg args argument arguments object data "
    "void string int bool error err nil null none true false ctx context self cls any promise list map vec option usize u8 str".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_WIDE = re.compile("[฀-໿぀-ヿ㐀-鿿가-힯]")
#: How many words (or four times as many characters of a script without spaces) a description must add.
LEAST = 4


def bare_text(comment: str) -> str:
    """A comment or doc string without its marks, line by line."""
    lines = []
    text = re.sub(r"^\s*(?:[rRuUbBfF]{0,2})(\"\"\"|'''|\"|')([\s\S]*?)\1\s*$", r"\2", comment)
    for line in text.replace("\r", "").split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|///?!?/*|\*+/|\*(?!\w)|#+!?(?=\s|$)(?!\s*(?:Arguments|Returns|Errors|Panics|Examples|Safety)\b)|--|<!--|\"\"\"|''')", "", line)
        line = re.sub(r"(?:\*+/|-->|\"\"\"|''')\s*$", "", line)
        lines.append(re.sub(r"^\s*//+!?\s?", "", line).rstrip())
    return "\n".join(lines).strip()


def prose(text: str) -> str:
    """The sentences of a bare comment: no tags, sections, directives, legal lines, code or notes to oneself."""
    kept, section = [], False
    for line in text.split("\n"):
        if not line.strip():
            kept.append("")
            section = False
            continue
        if _SECTION.match(line):
            section = True
            continue
        if section and re.match(r"^\s+|^\s*[*-] |^\s*\w+\s*(?:\([^)]*\))?:", line):
            continue
        section = False
        if _TAG.match(line) or _DIRECTIVE.match(line) or _LEGAL.search(line) or _CODE.search(line):
            continue
        kept.append(line.strip())
    text = " ".join(kept)
    note = _NOTE.search(text)
    while note:  # the note is its own sentence; what follows may still describe
        rest = re.search(r"[.!?](?:\s+|$)", text[note.end() :])
        text = text[: note.start()] + (text[note.end() + rest.end() :] if rest else "")
        note = _NOTE.search(text)
    return text.strip()


def _stem(word: str) -> str:
    for suffix in ("ations", "ation", "ings", "ing", "ies", "ers", "er", "ed", "es", "s", "e", "y"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            word = word[: -len(suffix)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def added_words(text: str, name: str, signature: str) -> float:
    """How many different words the prose has beyond those of the name and signature and mere filler."""
    own = {_stem(p.lower()) for p in _PARTS.findall(f"{name} {signature}")}
    wide = len(_WIDE.findall(text))
    words = {w.lower() for w in _WORD.findall(_WIDE.sub(" ", text))}
    parts = {p.lower() for w in words for p in [w]}
    return wide / 4 + sum(1 for p in parts if len(p) > 1 and p not in _GENERIC and _stem(p) not in own and p not in own)


def describes(comment: str | None, name: str | None, signature: str | None) -> bool:
    """Whether `comment` says in prose something that the name and signature don't."""
    if not comment:
        return False
    text = prose(bare_text(comment))
    if text.lower().strip(" .!:[]<>()*-\n") in _STAND_INS:
        return False
    start = text.lstrip(" `'\"*_") if name else text
    if name and start.startswith(name):  # a doc comment that begins with its function's name
        text = start[len(name) :]
    return added_words(text, name or "", signature or "") >= LEAST
