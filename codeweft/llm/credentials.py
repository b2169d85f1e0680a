"""Credentials embedded in source and configuration files, and their redaction.

First whatever can be decoded is decoded: every run of base64, hex, percent or backslash escapes and every list of bytes, alone
or within a longer literal, on one line or wrapped over several (joined literals, triple quotes, here documents, block
scalars). A layer that is a private key's container is told by its binary grammar (keyformats.py); a layer that is text is
scanned again like a file, and its runs are decoded in turn, however deep: every layer is shorter than the one around it.
Two layers are read by their own grammar: JSON web tokens and the user:password of Basic headers. If a layer holds a
credential, the enclosing encoded literal is the place, and is what is redacted.

What is written plainly is judged after that: quoted strings, unquoted values of configuration lines and XML elements,
passwords in URLs and connection strings, Authorization headers, user and password pairs in calls, values named in comments, and
PEM blocks. A literal is judged by the name it is bound to and by its own shape; if it decodes to text, by that text too, so
that an encoded placeholder is none.

Redaction leaves quotes, names, comment signs, line ends and line counts as they are: a value becomes MARK, a block over
several lines keeps its shape with every letter and digit an `x`, a list of bytes its shape with zeros.

Defined results: null and empty content hold none; placeholders, references to the environment or a secret store, hashes,
checksums, random ids and public keys are none; several values on a line are one place; repeated rows give each place once.
Whole files are scanned, whatever their length; a row whose id is null is redacted but names no place.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from .keyformats import private_key

MARK = "REDACTED"

#: Words of names that say the value opens something.
_SECRET_NAME = re.compile(
    r"(?i)pass(?!ed|ing|es\b|ive|age|enger|through)|passw|pwd|(?:^|[^a-z])pw(?:[^a-z]|$)|(?:^|[^a-z])pin(?:[^a-z]|$)|secret|token|(?:^|[^a-z])tok(?:[^a-z]|$)|api[_.-]?key|account[_.-]?key|access[_.-]?key|"
    r"signing[_.-]?key|encryption[_.-]?key|private[_.-]?key|master[_.-]?key|auth(?!or|_?mode|s?entic$)|cred|bearer|(?:^|[^a-z])psk(?:[^a-z]|$)"
)
#: Other keys: their values must look random.
_KEY_NAME = re.compile(r"(?i)(?<!public)(?<!public[_.-])(?<!pub[_.-])(?<!primary[_.-])(?<!foreign[_.-])(?<!sort[_.-])(?<!partition[_.-])(?<!cache[_.-])(?<!map[_.-])(?<!object[_.-])(?<=[a-z_.-])key$")
#: Words of names that say the value is about a secret, or names a thing, but is none.
_OTHER_NAME = re.compile(
    r"(?i)(?:header|label|param|prefix|suffix|kind|type|name|limit|path|mode|level|timeout|count|size|len|length|min|max|field|hint|policy|help|text|title|desc\w*|url|uri|endpoint|homepage|expir\w*|ttl|rotation|regex|pattern|"
    r"sha\d*|hash|checksum|digest|etag|integrity|commit|rev|trace|tenant|request[_-]?id|uuid|guid|id|icon|image|file|dir|store|provider|issuer|audience|scope|enabled|required|public[_.-]?key|pub[_.-]?key|fingerprint|nonce|salt)$"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|0{6,}|(?:change|replace|fill|set|insert|put|add|enter)[ _-]?(?:me|this|it|in|here)?(?:[ _-].*)?|your[ _-].*|my[ _-]?(?:password|secret|token|key)|<.*>|\[.*\]|todo.*|tbd|none|null|nil|undefined|n/?a|true|false|"
    r"example.*|sample.*|dummy.*|placeholder.*|redacted.*|masked|hidden|secret|password|passwd|token|test|foo|bar|key)$"
)
_REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|^\$[A-Za-z_]\w*$|^%\w+%$|^%\(\w+\)s$|^#\{|<%|secretref|vault[:/ ]|^(?:env|file|ssm|kv|sm|op|arn|gcp|aws|azure|keyvault|sops|doppler|k8s)[:/]|://(?:kv|vault|secret)|^ENC\[|getenv|environ|process\.env|(?-i:^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$)|secrets?[./]\w*$|\.\w+\("
)
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|h1)[-:]|^data:")
_B64 = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2,4}={0,2})\Z|[A-Za-z0-9_-]+={0,2}\Z")

_ESCAPE = re.compile(r"\\[xu0-7]")

# fixed values: how well-known issuers begin their tokens
_KNOWN = (
    r"(?:A3T[A-Z0-9]|AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}|gh[opusr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}|AIza[\w-]{20,}|ya29\.[\w-]{20,}|"
    r"pypi-[\w-]{20,}|dop_v1_[0-9a-f]{40,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{20,}|shpat_[0-9a-f]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"
)
_KNOWN_TOKEN = re.compile(rf"(?<![A-Za-z0-9_])(?:{_KNOWN})(?![A-Za-z0-9_])")
#: An issuer's prefix of one to three lower-case parts, then a random part.
_PREFIXED = re.compile(r"[a-z][a-z0-9]{1,7}(?:[._-][a-z]{2,7}){0,2}[._-]([A-Za-z0-9_-]{16,})\Z")

_QUOTED = re.compile(r'"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|(?<![A-Za-z0-9])\'([^\'\\\n]*(?:\\.[^\'\\\n]*)*)\'|`([^`\n]{4,})`')
_JOIN = re.compile(r"""["'`]\s*(?:\+|\.\.?|<>|,|\\)?\s*["'`]""")
_BARE = re.compile(r"""(?m)^[ \t]*(?:(?:#|//|;|--|[-*])[ \t]*)?(?:export[ \t]+|ENV[ \t]+|ARG[ \t]+|set[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*(?:=|:[ \t])[ \t]*([^\s"'`<>{}|&][^\s"'`<>{}]{3,}),?[ \t]*\r?$""")
_ENV_SPACE = re.compile(r"""(?m)^[ \t]*(?:ENV|ARG)[ \t]+([A-Za-z_]\w*)[ \t]+([^\s"'=]{4,})[ \t]*\r?$""")
_XML = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]{4,})</")
_URL = re.compile(r"""://[^\s:/@'"`<>{}$]*:([^\s@/'"`<>]{3,})@""")
_DSN = re.compile(r"""(?i)[;?&](?:password|pwd|passwd|pass|secret|accountkey|sharedaccesskey|access_token|sig)=([^;&\s"'`<>]{4,})""")
_HEADER = re.compile(r"""\b(?:Basic|Bearer|Token)\s+([A-Za-z0-9+/=._~-]{8,})""")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_PAIR = re.compile(
    r"""(?i)(?:log_?in|connect\w*|credentials?|basic(?:_?auth)?|auth\w*|sign_?in|(?:open|create|new)_?(?:pool|session|connection|client|db)\w*|set_?(?:user|auth|credentials?)\w*|dial|bind)\s*\(((?:\s*(?:["'][^"'\n]*["']|\d+|[A-Za-z_][\w.]*)\s*,){1,4})\s*["']([^"'\n\s]{6,})["']\s*[,)]"""
)
_CURL = re.compile(r"""\bcurl\b[^\n]*?\s(?:-u|--user)[ =]["']?[^\s:"']+:([^\s"']{4,})""")
_SAID = re.compile(
    r"(?i)\b(?:login|creds?|credentials?|pass(?:word|wd|phrase|code)?|pwd?|hard-?coded \w+|secret|key|token)(?:(?: \w+){0,4}?\s*(?:is|are|was|->|=>|:|=)\s+|\s+)(?:\S+ / )?(\S{6,})|\b(?:changed|rotated|reset|set|updated) (?:it|this|that|them|the \w+) (?:back )?to (\S{6,})|\baccess (?:via|with|using|by) (\S{6,})|\b(?:account|user|login) \S+ [|/:] (\S{6,})"
)
_COMMENT = re.compile(r"(?:#|//|/\*|<!--|--|;|\*)[^\n]*")
_CODE_END = re.compile(r"(?i)\.(?:py|pyi|js|jsx|mjs|cjs|ts|tsx|java|kt|kts|go|rs|c|h|cc|cpp|cxx|hpp|hh|cs|php|rb|swift|scala|m|mm|vue|svelte|map|lock|sum)$")
_NAMES = re.compile(r"[A-Za-z_][\w.-]*")
# fixed values: words before a literal that bind nothing
_NOT_NAMES = frozenset("const let var val final static private public protected readonly export default string str char unsigned new from setenv putenv getenv define environ setdefault os env insert set setitem put get localstorage sessionstorage process override value add key config cfg self this headers header string::from return client connect unsigned true false if else".split())


def _mixed(v: str) -> bool:
    """Letters of both cases and digits in no order: like something random."""
    kinds = (any(c.isupper() for c in v)) + (any(c.islower() for c in v)) + (any(c.isdigit() for c in v))
    return kinds == 3 and len(set(v)) >= min(12, len(v) * 0.5)


def _harmless(v: str) -> bool:
    return not v or bool(_PLACEHOLDER.match(v) or _REFERENCE.search(v) or _DIGEST.match(v)) or len(set(v)) < 4


def _opens(v: str) -> bool:
    """Whether a value bound to a secret's name is one."""
    if len(v) < 6 or _harmless(v) or " " in v or v.startswith(("/", "./", "http://", "https://")) and not _mixed(v):
        return False
    if v.replace(".", "").isdigit():
        return False
    return any(c.isdigit() for c in v) or not v.replace("-", "").replace("_", "").isalpha() and not v.rstrip("/").replace("/", "").isalpha() or (any(c.isupper() for c in v[1:]) and any(c.islower() for c in v) and len(v) >= 12 and "-" not in v)


def _token(v: str) -> bool:
    """Whether a value is a credential by its own shape, whatever its name."""
    if _KNOWN_TOKEN.fullmatch(v):
        return True
    m = _PREFIXED.match(v)
    return bool(m) and _mixed(m[1]) and not _UUID.search(v)


# ---- decoding ------------------------------------------------------------------------------------------------------------

#: A run that may be base64 (either alphabet) or hex.
_RUN = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]{16,}={0,2}")
#: Two runs that are one, wrapped: what may stand between them where a line ends.
_WRAP = re.compile(r"""[ \t"'`+.,;\\()#*/|>&-]*(?:\r?\n|\\r?\\n|\\n)[ \t"'`+.,;\\(#*/|>&-]*|["'`][ \t]*(?:[+.,&]|\.\.|<>)?[ \t]*["'`]""")
#: And what is left of the last line.
_TAIL = re.compile(rf"(?:{_WRAP.pattern})([A-Za-z0-9+/_-]{{1,15}}={{0,2}})(?![A-Za-z0-9+/=_-])")
_BYTES = re.compile(r"(?<![\w])(?:0x[0-9A-Fa-f]{1,2}(?:\s*,\s*0x[0-9A-Fa-f]{1,2}){15,}|[0-9A-Fa-f]{2}(?::\s*[0-9A-Fa-f]{2}){15,}|\d{1,3}(?:\s*,\s*\d{1,3}){15,})(?!\w)")
_BYTE = re.compile(r"0x([0-9A-Fa-f]{1,2})|([0-9A-Fa-f]{1,3})")
_ESCAPES = re.compile(r"""(?:\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]+\}|[0-7]{3})[^\s"'`\\]*){2,}""")
_PERCENT = re.compile(r"""(?:%[0-9A-Fa-f]{2}[^\s"'`<>%]*){2,}""")
_TOKEN_HEAD = re.compile(r"[^\s\"'`<>%]*\Z")
_BASIC = re.compile(r"(?i)\bbasic\s+\Z")
_USER_PASSWORD = re.compile(r"[^\s:]+:(\S{4,})\Z")


def _as_text(raw: bytes) -> str | None:
    """The bytes as text, None where they are none."""
    try:
        text = raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and (text.isprintable() or all(c.isprintable() or c in "\r\n\t" for c in text)) else None


def _base64(v: str) -> bytes | None:
    v = v.rstrip("=")
    if len(v) % 4 == 1:
        return None
    try:
        return base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unescaped(v: str) -> Iterator[bytes]:
    """What backslash escapes stand for: bytes, of a container or of UTF-8, where all are below 256; else characters."""
    try:
        text = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else m[0], v).encode("latin-1", "backslashreplace").decode("unicode_escape")
    except (UnicodeDecodeError, ValueError):
        return
    if text and max(text) < "\u0100":
        yield text.encode("latin-1")
    if text and not text.isascii():
        yield text.encode("utf-8", "replace")


def _layers(v: str) -> Iterator[bytes]:
    """What the value may stand for, one layer down; always shorter than the value."""
    if _ESCAPE.search(v):
        yield from _unescaped(v)
    if v.count("%") >= 2:
        raw = unquote_to_bytes(v)
        if len(raw) < len(v.encode("utf-8", "surrogatepass")):
            yield raw
    if len(v) >= 16 and len(v) % 2 == 0 and _HEX.match(v):
        yield bytes.fromhex(v)
    if len(v) >= 8 and _B64.match(v) and (raw := _base64(v)) is not None:
        yield raw


def _holds(raw: bytes, basic: bool = False) -> bool:
    """Whether a decoded layer is or holds a credential."""
    if private_key(raw):
        return True
    text = _as_text(raw)
    if text is None:
        return False
    bare = text.strip()
    if basic and (m := _USER_PASSWORD.match(bare)):
        return not _harmless(m[1])
    if _token(bare) and not _harmless(bare):
        return True
    return next(places(text), None) is not None or any(_holds(inner) for inner in _layers(bare))


def _web_token(text: str, start: int, end: int) -> int | None:
    """The end of a JSON web token that begins with this run: header and claims are JSON, a signature follows."""
    if not text.startswith("eyJ", start) or text[end : end + 1] != ".":
        return None
    claims = _RUN_PART.match(text, end + 1)
    signed = claims and text[claims.end() : claims.end() + 1] == "." and _RUN_PART.match(text, claims.end() + 1)
    if not signed or len(signed[0]) < 8:
        return None
    for part in (text[start:end], claims[0]):
        try:
            whole = json.loads(_base64(part) or b"")
        except (ValueError, RecursionError):
            return None
        if not isinstance(whole, dict):
            return None
    return signed.end()


_RUN_PART = re.compile(r"[A-Za-z0-9_-]+")


def encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the encoded literals that hold a credential in some layer."""
    group: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        own = (m.start(), m.end())
        if group and _WRAP.fullmatch(text, group[-1][1], own[0]):
            group.append(own)
            continue
        if group:
            yield from _decoded(text, group)
        group = [own]
    if group:
        yield from _decoded(text, group)
    if "," in text or ":" in text:
        for m in _BYTES.finditer(text):
            base = 16 if "x" in m[0] or ":" in m[0] else 10
            values = [int(a or b, base) for a, b in _BYTE.findall(m[0])]
            if max(values) < 256 and _holds(bytes(values)):
                yield m.start(), m.end(), "bytes"
    if "%" in text:
        for m in _PERCENT.finditer(text):
            start = m.start() - len(_TOKEN_HEAD.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start()])[0])
            if any(_holds(raw) for raw in _layers(text[start : m.end()])):
                yield start, m.end(), "value"
    if "\\" in text:
        for m in _ESCAPES.finditer(text):
            if any(_holds(raw) for raw in _unescaped(m[0])):
                yield m.start(), m.end(), "value"


def _decoded(text: str, group: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    tail = _TAIL.match(text, group[-1][1]) if group[-1][1] - group[-1][0] >= 32 else None
    if len(group) > 1 or tail:
        whole = "".join(text[s:e] for s, e in group)
        for more, end in ((tail[1], tail.end()), ("", group[-1][1])) if tail else (("", group[-1][1]),):
            if (more or len(group) > 1) and any(_holds(raw) for raw in _layers(whole + more)):
                yield group[0][0], end, "block" if "\n" in text[group[0][0] : end] else "value"
                return
    for s, e in group:
        v = text[s:e]
        if (stop := _web_token(text, s, e)) is not None:
            yield s, stop, "value"
        elif any(_holds(raw, bool(_BASIC.search(text[max(0, s - 40) : s]))) for raw in _layers(v)):
            yield s, e, "value"


def _innermost(v: str) -> str:
    """The text that a value decodes to, layer by layer; itself where it decodes to none."""
    while True:
        inner = next((t.strip() for raw in _layers(v) if (t := _as_text(raw)) is not None and t.strip()), None)
        if inner is None:
            return v
        v = inner


# ---- what is written plainly ---------------------------------------------------------------------------------------------


def _name_before(text: str, line: int, end: int) -> tuple[str, bool]:
    """The last name between two places that binds something, and whether it is called; only as much is read as that needs."""
    size = 160
    while True:
        start = max(line, end - size)
        part = text[start:end]
        names = [m for m in _NAMES.finditer(part) if m[0].lower() not in _NOT_NAMES]
        if names and (names[-1].start() > 0 or start == line):
            name = names[-1][0].rstrip(".-")
            return name, part.rstrip().endswith(name + "(")
        if start == line:
            return "", False
        size *= 4


def _judge(v: str, text: str, line: int, end: int) -> bool:
    """Whether a literal is a credential; text from line to end is what stands before it."""
    if len(v) < 6:
        return False
    if _token(v):
        return not _harmless(v)
    if len(v) >= 16 and "\\" in v and _ESCAPE.search(v) and any(_holds(raw) for raw in _unescaped(v)):
        return True
    name, called = _name_before(text, line, end)
    if called:
        name = ""  # what is called binds nothing
    if name and _SECRET_NAME.search(name) and not _OTHER_NAME.search(_snake(name)):
        return _opens(v) and not _harmless(_innermost(v))
    if name and _KEY_NAME.search(name) and _opens(v) and (_mixed(v) or len(v) >= 32 and _HEX.match(v) or any(not c.isalnum() for c in v) and any(c.isdigit() for c in v)) and not _UUID.match(v):
        return not _harmless(_innermost(v))
    if " " in v or len(v) < 24 or _harmless(v) or _UUID.match(v) or "\\" in v or "%" in v or _HEX.match(v):
        return False
    # a random token of no known issuer under a name that says nothing
    return len(v) <= LONGEST_TOKEN and _BLAND.search(name) is not None and _mixed(v) and _B64.match(v) is not None


#: Random literals under names that say nothing are tokens up to this length, and data beyond (what they decode to is looked at apart from that).
LONGEST_TOKEN = 88
#: Names that say nothing.
_BLAND = re.compile(r"(?i)^(?:k\d+|arg\d*|x|y|v|val|value|data|default|p\d*|a\d*|key\d*|conn|tmp|foo)$")


def _snake(name: str) -> str:
    """camelCase parted, so that a name's last word stands alone."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)


_PART = re.compile(r"""(\s*(?:\+|\.\.?|<>|,|\\)?\s*)(["'`])([^"'`\n]*)\2""")
_ARRAY_END = re.compile(r"\s*,?\s*\]\s*\.\s*join\b")


def _joined(text: str, end: int, lists: list[int]) -> tuple[str, int]:
    """Further quoted parts that the literal ending at `end` is joined with, by an operator, side by side or in a joined array.

    lists[0] is how far lists have been read that are not joined, so that each is read to its end once.
    """
    more, at, listed = [], end, None
    while m := _PART.match(text, at):
        if "\n" in m[1] and not m[1].strip():
            break
        if listed is None and "," in m[1]:
            listed = len(more), at
            if m.end() <= lists[0]:
                break
        more.append(m[3])
        at = m.end()
    if listed is not None and (at <= lists[0] or _ARRAY_END.match(text, at) is None):
        lists[0] = max(lists[0], at)
        del more[listed[0] :]
        at = listed[1]
    return "".join(more), at


def places(text: str, path: str = "") -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what is to be redacted; kind is value, block or bytes. Places may repeat or overlap."""
    yield from encoded(text)
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[2])
            if len(body) >= 40 and len(set(body)) > 8:
                yield m.start(), m.end(), "block"
    for m in _KNOWN_TOKEN.finditer(text):
        if not _harmless(m[0]) and _mixed_enough(m[0]):
            yield m.start(), m.end(), "value"
    if "://" in text:
        for m in _URL.finditer(text):
            v = m[1]
            if not _harmless(v) and not v.startswith(("$", "<", "{", "%(")):
                yield m.start(1), m.end(1), "value"
    if "=" in text:
        for m in _DSN.finditer(text):
            if not _harmless(m[1]):
                yield m.start(1), m.end(1), "value"
    if "curl" in text:
        for m in _CURL.finditer(text):
            if not _harmless(m[1]):
                yield m.start(1), m.end(1), "value"
    for m in _HEADER.finditer(text):
        v = m[1]
        inner = _innermost(v)
        pair = _USER_PASSWORD.match(inner)
        if _harmless(v) or _harmless(pair[1] if pair else inner) or not (_mixed(v) or len(v) >= 20 and any(c.isdigit() for c in v)):
            continue
        yield m.start(1), m.end(1), "value"
    for m in _PAIR.finditer(text):
        if _opens(m[2]):
            yield m.start(2), m.end(2), "value"
    lists, joined = [0], 0
    for m in _QUOTED.finditer(text):
        i = m.lastindex
        if i is None or m.end(i) - m.start(i) < 4:
            continue
        v, start = m[i], m.start(i)
        end = m.end(i)
        more, stop = _joined(text, m.end(), lists) if m.start() >= joined else ("", end)
        if more:
            v, end, joined = v + more, stop - 1, stop
        if " " in v and not _ESCAPE.search(v):
            continue
        line = text.rfind("\n", 0, start) + 1
        if _judge(v, text, line, start - 1):
            yield start, end, "value"
    if not _CODE_END.search(path):
        for pattern in (_BARE, _ENV_SPACE):
            for m in pattern.finditer(text):
                if _judge(m[2].rstrip(",;"), m[1], 0, len(m[1])):
                    yield m.start(2), m.start(2) + len(m[2].rstrip(",;")), "value"
        for m in _XML.finditer(text):
            if _judge(m[2], m[1], 0, len(m[1])):
                yield m.start(2), m.end(2), "value"
    for m in _COMMENT.finditer(text):
        for s in _SAID.finditer(m[0]):
            i = s.lastindex
            v = s[i].rstrip(".,;)")
            if not _harmless(v) and not v.startswith("http") and (_token(v) or _opens(v) and (_mixed(v) or len(v) >= 32 and _HEX.match(v) or any(c.isdigit() for c in v) and any(not c.isalnum() for c in v))):
                yield m.start() + s.start(i), m.start() + s.start(i) + len(v), "value"


def _mixed_enough(v: str) -> bool:
    return len(set(v)) >= 8


def find(content: str | None, path: str | None = None) -> list[tuple[int, int, str]]:
    """The places of a file, in order, overlapping ones united."""
    if not content:
        return []
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(places(content, path or "")):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), "block" if "block" in (kind, out[-1][2]) else kind)
        else:
            out.append((start, end, kind))
    return out


_BODY = re.compile(r"\\[nrt]|-----[A-Z0-9 ]+-----|[A-Za-z0-9+/=_-]+")
_DIGITS = re.compile(r"(?<=0x)[0-9A-Fa-f]+|(?<![0-9A-Fa-f])[0-9A-Fa-f]+(?!x)")


def redact(content: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in found:
        parts.append(content[at:start])
        if kind == "bytes":
            # decimal numbers would be octal with zeros before them
            parts.append(_DIGITS.sub(lambda m: "0" * len(m[0]) if ":" in content[start:end] or "x" in content[start:end] else "0", content[start:end]))
        elif kind == "block":
            parts.append(_BODY.sub(lambda m: m[0] if m[0][0] == "\\" or m[0].startswith("-----") else "x" * len(m[0]), content[start:end]))
        else:
            # a value in several parts keeps what joins them
            pieces = _JOIN.split(content[start:end])
            joints = _JOIN.findall(content[start:end])
            parts.append(MARK + "".join(j for j in joints[: len(pieces) - 1]))
        at = end
    parts.append(content[at:])
    return "".join(parts)


def credential_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no): the lines, from 1, on which a credential starts; each once. files: file_id, path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines = [], []
            for i, path, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                for n in sorted({content.count("\n", 0, s) + 1 for s, _, _ in find(content, path)}):
                    ids.append(i)
                    lines.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["file_id", "line_no"])

    rows = files.where("file_id is not null").select("file_id", "path", "content")
    return rows.mapInArrow(run, "file_id bigint, line_no bigint").distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """(file_id, path, n_places, content): every row, its credentials masked and all else unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, out = [], []
            for path, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = find(content, path)
                counts.append(len(found))
                out.append(redact(content, found) if found else content)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(out, pa.string())], names=["file_id", "path", "n_places", "content"])

    return files.select("file_id", "path", "content").mapInArrow(run, "file_id bigint, path string, n_places bigint, content string")
