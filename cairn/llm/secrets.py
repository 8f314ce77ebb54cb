"""What counts as a credential: detection patterns, look-alikes and exact places (helper of problem 4)."""

from __future__ import annotations

import base64
import bisect
import binascii
import re

_KEYWORD = (
    r"(?:password|passwd|passphrase|passcode|smtp[_-]?pwd|db[_-]?pwd|[_-]pwd|[_-]pass(?!\w)|(?:admin|db|user|root|login|mail|ftp|redis|mysql)pass(?!\w)|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key"
    r"|private[_-]?key|auth[_-]?key|master[_-]?key|account[_-]?key|shared[_-]?key|license[_-]?key|credential)"
)
_VALUE = r"""(?:"([^"\n]*)"|'([^'\n]*)'|`([^`\n]*)`|([^\s"'`,;(){}<>\[\]]+))"""
_ASSIGNED = r"""(?:["'`]?\]?\s{0,8}(?::=|=>|==|[=:,])\s{0,8}(?:(?:str|string|String|&str|&'static str|any)\s*=\s*)?(?:concat!\(\s{0,8})?|["']\s{1,4}value\s?=\s?|>\s{0,8})"""

#: Detector -> pattern. Groups hold the secret. The pattern's required trigrams are those of its index look-up.
DETECTORS: dict[str, str] = {
    "private_key": r"(-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----)",
    "assigned": rf"(?i){_KEYWORD}s?(?![\w]){_ASSIGNED}{_VALUE}",
    "url": r"""(?<=\w)://[^\s/:@"'`<>]*+:([^\s/@"'`<>]++)@""",
    "connection": r"""(?i);\s{0,4}(?:password|pwd|accountkey|sharedaccesskey)\s{0,4}=\s{0,4}([^;"'`\s]++)""",
    "header": r"""(?i)authorization["'`]?\]?\s{0,8}(?::=|=>|[=:,])\s{0,8}["'`]?(?:bearer|basic|token|apikey)\s{1,4}([A-Za-z0-9+/=_.~-]{8,})""",
    "stripe": r"(?<![A-Za-z0-9])([sr]k_(?:live|test|prod)_[A-Za-z0-9]{16,})",
    "slack": r"(?<![A-Za-z0-9])(xox[abeprs]-[A-Za-z0-9-]{16,})",
    "gitlab": r"(?<![A-Za-z0-9])(glpat-[A-Za-z0-9_-]{16,})",
    "github": r"(?<![A-Za-z0-9])((?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,})",
    "aws": r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])",
    "jwt": r"(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,})",
    "google": r"(?<![A-Za-z0-9])(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])",
    "sendgrid": r"(?<![A-Za-z0-9])(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})",
    "npm": r"(?<![A-Za-z0-9])(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "pypi": r"(?<![A-Za-z0-9])(pypi-[A-Za-z0-9_-]{40,})",
    "huggingface": r"(?<![A-Za-z0-9])(hf_[A-Za-z0-9]{30,})",
}
_KEYWORDS = re.compile(_KEYWORD)
_NAME = re.compile(r"[\w-]*")
_COMPILED = {name: re.compile(pattern) for name, pattern in DETECTORS.items()}
TOKENS = frozenset(DETECTORS) - {"private_key", "assigned", "url", "connection", "header"}

#: Values that stand in for a secret, in lower case without separators.
PLACEHOLDERS = frozenset(
    "changeme changeit replaceme replace placeholder redacted secret password passwd pass pwd token key apikey yourapikey yourtoken yourpassword yoursecret insertkeyhere inserttokenhere"
    " example sample dummy test testing foobar default none null nil undefined unknown empty true false todo tbd fromvault notset unset hidden masked removed string bearer basic user username admin"
    " primarykey authorization xauthtoken".split()
)
_REFERENCE = re.compile(r"^(?:\$[{(A-Za-z_]|%\w+%|\{\{|<%|<[^>]*>$|\[[^\]]*\]$|\{[^}]*\}$|@\w+[.@{]|vault:|env[:.]|ssm:|kms:|secretsmanager|arn:|op://|file:|/[\w.-]+/|\./|~/|[A-Za-z]:\\|https?://|process\.env|os\.|env::|System\.|config\.|ENC\[)")
_FILLER = re.compile(r"^(.)\1{2,}$|^[x*.•#?_-]+$|^(?:x{3,}|\*{3,}|\.{3,})|(?:\.{3}|\*{3,}|x{4,})$", re.I)
_TEXT_EXT = frozenset((".yaml", ".yml", ".env", ".sh", ".ini", ".cfg", ".conf", ".properties", ".toml", ".xml", ".json", ""))
_CONCAT = re.compile(r'concat!\(\s*"[^"\\]*"(?:\s*,\s*"[^"\\]*")+')
_BETWEEN = re.compile(r'"\s*,\s*"')
#: Names after which words are a secret too, and words that no passphrase but a sentence about one has.
_WORDY = re.compile(r"(?i)pass(?:word|wd|phrase|code)?s?$|pwd$")
_TOLD = frozenset("a an and are at be by can enter for from here in invalid is it least must new no not of on or please required set should that the this to too use was with wrong you your".split())
_NAMED = re.compile(r"(?i)pass|secret|token|key|cred|field|name|input|label|type|text|prompt|hash|vault|store|manager|value")
_JOINED = re.compile(r'"\s*\+\s*"|\'\s*\+\s*\'|`\s*\+\s*`|"\s*\.\s*"')
_BODY = re.compile(r"""(?:\\[nr]|[\s"'`+,\\]|#|//|\*|[A-Za-z-]{3,20}: [^\n]{1,80}\n)*[A-Za-z0-9+/=]{16,}""")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(r"""(?:[\s"'`+,\\]|\\[nr]|#|//|[A-Za-z0-9+/=]{16,}|[A-Za-z-]{3,20}: [^\n]{1,80}\n)*[A-Za-z0-9+/=]*""")


def is_placeholder(value: str) -> bool:
    bare = re.sub(r"[\s_.-]", "", value.lower())
    return (
        not bare
        or bare in PLACEHOLDERS
        or bool(_REFERENCE.match(value))
        or bool(_FILLER.search(value))
        or bool(re.match(r"(?i)(?:your|my|insert|enter|replace|put|add|set|the)[_ -].*(?:here|key|token|secret|password|me)$", value))
        or bool(re.search(r"(?i)example|placeholder|change[_-]?me|redacted|dummy|not[_-]?a[_-]?real", value))
    )


def is_secret_value(value: str, quoted: bool, name: str = "") -> bool:
    """Whether the value of a secret's name looks like the secret itself, not a name, reference or word.

    Beside a password's name a quoted value may also be letters alone, or a passphrase of three words or more
    that aren't those of a sentence.
    """
    if len(value) < 6 or is_placeholder(value):
        return False
    wordy = quoted and bool(_WORDY.search(name))
    if re.search(r"\s", value):
        parts = value.lower().split()
        return wordy and len(parts) >= 3 and all(len(p) > 2 and p.isalnum() and p not in _TOLD and not _NAMED.search(p) for p in parts)
    if wordy and re.fullmatch(r"[A-Za-z]{8,}", value) and not _NAMED.search(value):
        return True
    if re.fullmatch(r"[A-Za-z_-]+", value) and not (len(value) >= 20 and re.search(r"[a-z][A-Z].*[A-Z][a-z]|[a-z]{2}[A-Z]{2}", value) and "_" not in value):
        return False
    if re.fullmatch(r"[a-z]+(?:[:.][a-z0-9]+)+", value) or re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+)+", value) or re.fullmatch(r"\d{1,8}", value):
        return False
    if re.match(r"sha\d+[:-]|md5:", value):
        return False
    return quoted or bool(re.search(r"\d", value) or re.search(r"[^\w.:/-]", value))


def _basic(value: str) -> bool:
    try:
        user, _, word = base64.b64decode(value, validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return True
    return bool(word) and not is_placeholder(word)


def _in_comment(text: str, at: int) -> bool:
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return bool(re.search(r"(?:^|\s)(?://|#|--|\*|;)|<!--|/\*", line))


class _Spliced:
    """A text whose string concatenations are closed up, with the way back to its own offsets."""

    def __init__(self, text: str):
        self.cuts: list[tuple[int, int]] = []  # (place in the closed text, characters left out up to there)
        parts, at, gone, size = [], 0, 0, 0
        joints = list(_JOINED.finditer(text))
        if "concat!" in text:
            joints += [m for c in _CONCAT.finditer(text) for m in _BETWEEN.finditer(text, c.start(), c.end())]
            joints.sort(key=lambda m: m.start())
        for m in joints:
            parts.append(text[at : m.start()])
            size += m.start() - at
            gone += m.end() - m.start()
            at = m.end()
            self.cuts.append((size, gone))
        self.text = "".join(parts) + text[at:] if parts else text

    def original(self, place: int) -> int:
        k = bisect.bisect_right(self.cuts, (place, 1 << 60)) - 1
        return place + (self.cuts[k][1] if k >= 0 else 0)

    def pieces(self, start: int, end: int) -> list[tuple[int, int]]:
        edges = [start, *(p for p, _ in self.cuts if start < p < end), end]
        return [(self.original(a), self.original(b - 1) + 1) for a, b in zip(edges, edges[1:], strict=False)]


def _matches(name: str, text: str):
    pattern = _COMPILED[name]
    if name != "assigned":
        return pattern.finditer(text)
    lower = text.lower()
    if len(lower) != len(text):
        return pattern.finditer(text)
    at = (pattern.match(text, m.start()) for m in _KEYWORDS.finditer(lower))  # much faster than ignoring case
    return (m for m in at if m)


def find_secrets(text: str, ext: str, detectors=None) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(detector, line from 1, offsets of the secret's pieces) of each credential, one per secret, in order."""
    if not text:
        return []
    joined = _Spliced(text)
    t = joined.text
    found: list[tuple[int, int, str]] = []
    for name in detectors or DETECTORS:
        for m in _matches(name, t):
            group = m.lastindex
            value, start, end = m.group(group), m.start(group), m.end(group)
            if name == "private_key":
                stop = _KEY_END.search(t, end)
                body = _BODY.match(t, end)
                if not body and t[end:].strip():
                    continue
                end = stop.end() if stop and _KEY_LINES.fullmatch(t, end, stop.start()) else _KEY_LINES.match(t, end).end()
            elif name == "assigned":
                quoted = group < 4
                if not is_secret_value(value, quoted, _NAME.match(m.group()).group()):
                    continue
                if not quoted and ext not in _TEXT_EXT and not _in_comment(t, m.start()):
                    continue
            elif name == "header":
                kind = m.group()[: start - m.start()].rstrip().rsplit(None, 1)[-1].lower().lstrip("\"'`")
                if is_placeholder(value) or (kind == "basic" and not _basic(value)):
                    continue
            elif name in ("url", "connection"):
                if is_placeholder(value) or re.search(r"\$\{|\{\{|\$\(", value):
                    continue
            elif is_placeholder(value):
                continue
            found.append((start, end, name))
    found.sort(key=lambda f: (f[0], -f[1]))
    kept: list[tuple[int, int, str]] = []
    for start, end, name in found:
        if kept and start < kept[-1][1]:
            continue
        kept.append((start, end, name))
    return [(name, text.count("\n", 0, joined.original(start)) + 1, joined.pieces(start, end)) for start, end, name in kept]


_TAIL = re.compile(r"""\A(?:[\s"'`+,\\]|\\[nr]|[A-Za-z0-9+/=]{16,})*[A-Za-z0-9+/=]*-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----""")


def redacted(text: str, ext: str, detectors=None, mark: str = "[REDACTED]") -> str:
    """`text` with each secret replaced by `mark` and everything around it, line breaks too, unchanged.

    A private key whose BEGIN line lies in an earlier window is replaced as well, up to its END line.
    """
    spans = [(a, b, i == 0) for _, _, pieces in find_secrets(text, ext, detectors) for i, (a, b) in enumerate(pieces)]
    tail = _TAIL.match(text)
    if tail:
        spans.insert(0, (0, tail.end(), True))
    out, at = [], 0
    for a, b, first in spans:
        if a < at:
            continue
        out += [text[at:a], (mark if first else "") + "\n" * text.count("\n", a, b)]
        at = b
    return "".join(out) + text[at:]
