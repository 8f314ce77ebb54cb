"""Sentence boundaries of one text: a pushdown automaton over its marks (helper of problem 9)."""

from __future__ import annotations

import re

# Abbreviations after which a sentence goes on, without their last full stop, in lower case.
_ABBREVIATIONS = (
    # English
    "mr mrs ms dr prof st jr sr rev hon gen col capt lt sgt gov pres e.g i.e cf vs approx max min fig figs no nos sect sec ch vol pp ed eds al resp incl excl est dept univ "
    "jan feb mar apr jun jul aug sep sept oct nov dec mt ft p c ca viz "
    # German
    "z b d h u a o ä bzw vgl abb nr evtl ggf bspw sog inkl exkl zzgl s str tel hr fr dipl ing mio mrd usf v n chr bd "
    # French
    "m mm mlle mme env p ex c-à-d éd art chap av boul n fig réf tél "
    # Spanish
    "sr sra srta dr dra ud uds pág págs ej aprox núm tel av gral lic ing vol cap art "
    # Russian
    "г гг т е д п к пр др см рис стр табл напр им ул тыс млн млрд руб коп проф акад обл р ч св "
    # Greek
    "κ κα κος π χ λ μ βλ αρ σελ δηλ κεφ εικ "
    # Arabic, Hindi
    "د أ م ص ج هـ डॉ श्री पं प्रो सं "
)
#: Abbreviations that may also end a sentence: they do before a capital.
_MAY_END = frozenset("etc usw uvm a.m p.m am pm inc ltd co corp u.s u.k jr".split())
#: Abbreviations that are words as well, so they count only before a number.
_BEFORE_NUMBER = frozenset("no nos nr núm cap art vol ch sec sect fig figs ed max min jan mar jun dec sept tel im est part gen col".split())
_NEVER_END = frozenset(_ABBREVIATIONS.split()) - _MAY_END - _BEFORE_NUMBER
_MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep okt nov dez".split()
)
_ORDINAL_BEFORE = frozenset("am der die das dem den des zum zur vom im beim ab bis seit jeden jeder".split())

_NEVER, _MAY, _NUMBER = 1, 2, 4


def _trie() -> dict:
    """The abbreviations by their letters from the last to the first; "" holds what an abbreviation is."""
    root: dict = {}
    for kind, words in ((_NEVER, _NEVER_END), (_MAY, _MAY_END), (_NUMBER, _BEFORE_NUMBER)):
        for word in words:
            node = root
            for letter in reversed(word):
                node = node.setdefault(letter, {})
            node[""] = node.get("", 0) | kind
    return root


_TRIE = _trie()
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "»": "«", "〔": "〕", "［": "］"}
_CLOSERS = frozenset(")]}”“»›」』）】》〉«〕］\"'’")
_MARK = re.compile(r"""`+|["“”„«»‹›「」『』()（）\[\]{}［］〔〕《》〈〉【】]|[.!?…。！？｡．؟।॥;؛;]+""")
_MARK_THAI = re.compile(_MARK.pattern + r"|[ \t]*\n[ \t]*|[ \t]+")
_TERMINATORS = frozenset(".!?…。！？｡．؟।॥;;")
_WIDE_STOPS = frozenset("。！？｡．")
_LINE = re.compile(r"[^\n]*\n?")
_FENCE = re.compile(r"[ \t>]*(```+|~~~+)")
_HEADING = re.compile(r"(?:[ \t]*>)*[ \t]{0,3}#{1,6}(?=[ \t]|$)[ \t]*")
_ITEM = re.compile(r"(?:[ \t]*>)*[ \t]*(?:[-*+•‣◦–]|(\d{1,9})[.)]|\(?[a-z]\))[ \t]+(?:\[[ xX]\][ \t]+)?")
_LEAD = re.compile(r"(?:[\s>]|(?<![^\n])[ \t]*>)*")
_QUOTE_LEAD = re.compile(r"(?:[ \t]*>)+[ \t]*")
_EDGES = frozenset("()[]{}\"“”„«»")
_LEADING = frozenset("¿¡'‘`*_-—")
_NEXT = re.compile(r"[\s>]*[\"“”„«»‹›「『(（\[¿¡'‘*_]*")
_FILE_LIKE = re.compile(r"[a-z][\w-]*(?:_\w+|\.\w{1,5}(?!\w)|\.\w+\()")
_SHORT = re.compile(r"(?:[^\W\d_]|ej|ex)\.")
_SHORT_BEFORE = re.compile(r"(?<!\w)[^\W\d_]\.\s*$")
_THAI = re.compile("[฀-๿]")
_SPACES = " \t\n\r\f\v 　​﻿   "


def _uncased(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "　" <= c <= "〿" or "＀" <= c <= "￯"


def _greek(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"


def blocks(text: str):
    """(start, end, kind) of the text's blocks: paragraphs, headings and list items, outside code fences.

    The stack holds the levels of the list that is open, each with its indent and whether it is numbered; an item
    closes the levels that are indented more. A blank line ends any block and closes all levels; within a block a
    number begins an item only on a level that is numbered, or if it is 1, so a wrapped "3. Mai" doesn't.
    """
    at, start, kind, fence = 0, None, "", ""
    levels: list[tuple[int, bool]] = []
    size = len(text)
    while at < size:
        m = _LINE.match(text, at)
        line_start, at = at, m.end()
        line = m.group()
        mark = _FENCE.match(line)
        if fence:
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
            continue
        bare = line.strip(_SPACES)
        if mark or not bare.strip("> \t"):
            if start is not None:
                yield start, line_start, kind
                start = None
            if mark:
                fence = mark.group(1)
            levels.clear()
            continue
        head = _HEADING.match(line)
        if head and line[head.end() :].strip():
            if start is not None:
                yield start, line_start, kind
                start = None
            yield line_start + head.end(), at, "heading"
            levels.clear()
            continue
        item = _ITEM.match(line)
        if item and line[item.end() :].strip():
            lead = item.group()
            indent, number = len(lead) - len(lead.lstrip("> \t")), item.group(1)
            outer = next((k for k, (column, _) in enumerate(levels) if column > indent), len(levels))
            begins = start is None or number in (None, "1") or any(numbered for _, numbered in levels[:outer])
            if begins and not (start is not None and not levels and lead.strip()[:1] in "–("):
                if start is not None:
                    yield start, line_start, kind
                del levels[outer:]
                if not levels or levels[-1][0] < indent:
                    levels.append((indent, number is not None))
                elif number is not None:
                    levels[-1] = (indent, True)
                start, kind = line_start + item.end(), "item"
                continue
        if start is None:
            lead = _QUOTE_LEAD.match(line)
            start, kind = line_start + (lead.end() if lead else 0), "paragraph"
    if start is not None:
        yield start, size, kind


def _begins(text: str, at: int) -> bool:
    """Whether a word begins at `at`, marks of emphasis before it left out."""
    if not at or text[at - 1] == "/":
        return True
    while at and text[at - 1] in _LEADING:
        at -= 1
    return not at or text[at - 1].isspace() or text[at - 1] in _EDGES


def _abbreviation(text: str, at: int) -> int:
    """What the word that ends at `at` is among the abbreviations, 0 if none: the trie is walked back from the
    mark, and the longest that begins a word counts, or one of two letters at most after another full stop."""
    node, k, kind = _TRIE, at, 0
    while k:
        node = node.get(text[k - 1].lower())
        if node is None:
            break
        k -= 1
        held = node.get("")
        if held:
            if _begins(text, k):
                kind = held
            elif at - k <= 2 and held & _NEVER and text[k - 1] == ".":
                kind = _NEVER
    return kind


def _previous(text: str, at: int) -> str:
    """The word before the white space before `at`."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at].lower()


def _spans(text: str, marks: list[re.Match]) -> dict[int, int]:
    """Start -> end of the outermost closed quotations, brackets and code spans among a block's marks.

    The stack holds what is open; a closing mark pops down to its opener and is passed over where there is
    none (as in a smiley), an opener that is never closed covers nothing.
    """
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    code, code_at = "", 0
    for m in marks:
        mark, at = m.group(), m.start()
        if mark[0] == "`":
            if not code:
                code, code_at = mark, at
            elif code == mark:
                pairs.append((code_at, m.end()))
                code = ""
            continue
        if mark[0] in _TERMINATORS or mark[0] in _SPACES or len(mark) != 1:
            continue
        closes = None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == mark:
                closes = depth
                break
        if mark == '"':
            if closes is not None and (at + 1 >= len(text) or not text[at + 1].isalnum() or text[at - 1 : at] not in " \n"):
                pairs.append((stack[closes][1], m.end()))
                del stack[closes:]
            else:
                stack.append(('"', at))
        elif closes is not None:
            pairs.append((stack[closes][1], m.end()))
            del stack[closes:]
        elif mark in _PAIRS:
            stack.append((_PAIRS[mark], at))
    outer: dict[int, int] = {}
    reach = -1
    for a, b in sorted(pairs, key=lambda p: (p[0], -p[1])):
        if a >= reach:
            outer[a] = reach = b
    return outer


def _goes_on(text: str, at: int, end: int, limit: int, run: str, flat: bool = False) -> bool:
    """Whether the sentence goes on after the terminators `run` at `at`, with closing marks up to `end`.

    In a `flat` block, without any capital, a small letter says nothing.
    """
    if run[-1] in _WIDE_STOPS:
        return False
    before = text[at - 1] if at else " "
    if run[0] in ";;":
        return not _greek(before) or (end < limit and text[end] not in _SPACES)
    if end < limit and text[end] not in _SPACES:
        follow = text[end]
        return not (run[-1] in "!?" and (_cjk(before) or before in "`)\"”」』" or _cjk(follow)) and (_cjk(follow) or (_cjk(before) and follow.isalnum()) or follow in "「『“《‘（"))
    place = _NEXT.match(text, end, limit).end()
    if place >= limit:
        return False
    follow = text[place]
    if run[-1] in "!?؟।॥":
        return follow.islower() and end > at + len(run) and not _FILE_LIKE.match(text, place)
    if run == ".":
        alone = at > 0 and _begins(text, at - 1)
        if alone and "a" <= text[at - 1] <= "z":  # one plain small letter: only beside another, or before a number
            return follow.isdigit() or bool(_SHORT.match(text, place)) or bool(_SHORT_BEFORE.search(text, max(0, at - 8), at - 1))
        kind = _abbreviation(text, at)
        if kind and text[at - 2 : at] == "ms" and _begins(text, at - 2):  # milliseconds
            return follow.islower() and not flat
        if kind & _NEVER or kind & _NUMBER and (follow.isdigit() or follow in "¹²³"):
            return True
        if alone and before.isalpha() and before.isupper() and not _uncased(before):
            return True
        if kind & _MAY:
            return not follow.isupper()
        digits = 2 if text[max(0, at - 2) : at].isdigit() and at > 1 else 1
        if before.isdigit() and _begins(text, at - digits):
            if re.match(r"\w*", text[place : place + 20]).group().lower() in _MONTHS or _previous(text, at - digits) in _ORDINAL_BEFORE:
                return True
    if follow.islower():
        return not (flat and run[-1] != "…" or _uncased(before) or bool(_FILE_LIKE.match(text, place)) and run == ".")
    return follow in ",;:-–—"


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets (start, end) in code points of the sentences of `text`, in order.

    Blank text has none; a block of marks alone (a rule, say) gives none unless it asks or exclaims.
    """
    out: list[tuple[int, int]] = []
    for start, end, kind in blocks(text):
        if kind != "paragraph":
            _emit(text, start, end, out)
            continue
        thai = bool(_THAI.search(text, start, end))
        flat = text[start:end].islower()
        marks = list((_MARK_THAI if thai else _MARK).finditer(text, start, end))
        spans = _spans(text, marks)
        at, reach = start, start
        for m in marks:
            place = m.start()
            if place < reach:
                continue
            mark = m.group()
            if place in spans:
                reach = spans[place]
                inner = text[place + 1 : reach - 1].rstrip(_SPACES)
                if mark[0] != "`" and inner and inner[-1] in ".!?…؟।" and not _cjk(text[reach - 1]):
                    follow = _NEXT.match(text, reach, end).end()
                    if reach < end and text[reach] in _SPACES and follow < end and text[follow].isupper():
                        if not _goes_on(text, place + 1 + len(inner) - 1, reach, end, inner[-1]) and mark not in "„":
                            _emit(text, at, reach, out)
                            at = reach
                continue
            if mark[0] in _SPACES:
                if place > at and (_THAI.match(text, place - 1) or (m.end() < end and _THAI.match(text, m.end()))):
                    _emit(text, at, place, out)
                    at = m.end()
                continue
            if mark[0] not in _TERMINATORS:
                continue
            stop = m.end()
            while stop < end and text[stop] in _CLOSERS and stop not in spans:
                stop += 1
            if stop <= at or _goes_on(text, place, stop, end, mark, flat):
                continue
            _emit(text, at, stop, out)
            at = reach = stop
        _emit(text, at, end, out)
    return out


def _emit(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    start = _LEAD.match(text, start, end).end()
    while end > start and text[end - 1] in _SPACES:
        end -= 1
    if any(c.isalnum() or c in "?!？！؟" for c in text[start:end]):
        out.append((start, end))
