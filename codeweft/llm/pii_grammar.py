"""The exact form of each kind of personal information.

snap() gives the exact bounds of a case that the model has pointed at. Where none of the exact forms is there, the model's own
stretch stands, brought to whole words, if it has what its kind can't be without (a sign for `at`, enough digits, two words).
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_U = "A-Z" + chr(0xC0) + "-" + chr(0xD6) + chr(0xD8) + "-" + chr(0xDE) + "".join(map(chr, (0x100, 0x10C, 0x106, 0x110, 0x118, 0x130, 0x141, 0x150, 0x15A, 0x15E, 0x160, 0x170, 0x179, 0x17B, 0x17D)))
_L = "a-z" + chr(0xDF) + "-" + chr(0xF6) + chr(0xF8) + "-" + chr(0xFF) + chr(0x101) + "-" + chr(0x17F)
_Q = "'" + chr(0x2019)
_WORD = rf"[{_U}][{_L}{_Q}]+(?:-[{_U}{_L}][{_L}{_Q}]+)*"
#: A word of a name: also with a capital inside after a prefix, or in capitals.
_NAME_WORD = rf"(?:(?:Mc|Mac|O{_Q}|D{_Q}|L{_Q})?{_WORD}|[{_U}]{{2,}}(?:-[{_U}]{{2,}})*)"
_PARTICLE = r"(?:(?:de|del|della|der|den|van|von|zu|zum|af|av|da|das|do|dos|di|du|la|le|ter|ten|bin|ibn|el|DE|DEL|VAN|VON|DER|DA|LA) ){0,3}(?:(?:al|el|d|l|AL)[-" + _Q + r"])?"
_INITIAL = rf"[{_U}]\."
_FAMILY = rf"{_PARTICLE}{_NAME_WORD}"

NAME = re.compile(
    rf"(?<![\w@./-])(?!(?:The|Die|Das|Der|Den|Ein|Eine|Les?|La|Los|Las|Im|Do|Did|If|As|In|On|At|No|Any|Thanks|Reported|Author|Gemeldet|Merci|Danke|Gracias|According|Copyright) )(?:{_FAMILY}, {_NAME_WORD}(?: {_INITIAL})?(?![\w@])|{_FAMILY}, {_INITIAL}|{_NAME_WORD}(?:-{_NAME_WORD})?(?: {_INITIAL}){{0,2}} {_FAMILY}(?![\w@/])|(?:{_INITIAL} ?){{1,2}}{_FAMILY}(?![\w@/]))"
)
_ANY = rf"[{_U}{_L}][{_U}{_L}{_Q}]*"
_PART = rf"(?:{_ANY}(?:-{_ANY})*|[{_U}{_L}]\.)"
#: Words of any case; how a name of no exact form looks once its bounds are known.
ANY_NAME = re.compile(rf"(?:[{_U}{_L}]\. ?){{1,2}}(?:{_PART} ){{0,3}}{_ANY}(?:-{_ANY})*|{_PART}(?: {_PART}){{1,4}}|{_PART}(?: {_PART}){{0,3}}, {_PART}(?: {_PART}){{0,2}}")
_IN_WORD = re.compile(rf"[{_U}{_L}{_Q}-]")
#: German says by whom with a word that is also part of names.
_BY = re.compile(r"(?i)(?:gemeldet|geschrieben|gefunden|berichtet|verfasst|erstellt|genehmigt|freigegeben) $")
_TITLE = re.compile(r"^(?:(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Herr|Frau|Mme|Mlle|M|Ing|Dipl|Sir|Señor|Señora|Hr|Fr)\.? )+(?=\S)")

_AT = r"(?: ?@ ?| ?\[ ?at ?\] ?| ?\( ?at ?\) ?| ?\{ ?at ?\} ?| at |&#64;|&#x40;|%40| ?<at> ?)"
_DOT = r"(?:\.| ?\[ ?dot ?\] ?| ?\( ?dot ?\) ?| ?\{ ?dot ?\} ?| dot |&#46;|%2[eE]| ?<dot> ?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?i)(?<![\w.+%/@-])[^\W_][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,18}}(?![\w@])(?!-\w)")
_NO_MAILBOX = re.compile(r"(?i)^(?:git|hg|svn|user|username|you|your[._-]?name|yourname|name|first\.last|someone|somebody|foo|bar|me|email|xxx+)\b *(?:@|\[|\(|at )")

_SEP = r"[ .\-]"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:\+\d{{1,3}}(?:{_SEP}?\(0\))?(?:{_SEP}?\(?\d{{1,12}}\)?){{1,5}}|00\d{{2}}(?:[ -]\d{{2,9}}){{2,4}}|\(\d{{3,5}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,5}}|\d{{3}}([-.])\d{{3}}\1\d{{4}}|"
    r"0\d(?: \d\d){4}|0\d{2} \d{4} \d{4}|0\d{2} \d{5} \d{3}|0\d{3} \d{3} \d{4}|0\d{4} \d{3} \d{3}|0\d{4} \d{6}|0\d{2,4}[/-]\d{5,8}|0\d{9,10}|1?[2-9]\d{9})(?![\w-]|[.]\d)"
)

_ID_LABEL = r"(?:ssn|social[ -]security(?: (?:number|no\.?))?|steuer-?id(?:nr\.?)?|steuer(?:identifikations)?nummer|tin|tax[ -]?(?:id|number|no\.?)|national[ -]?id(?:entity)?(?: (?:number|no\.?|card))?|nino|ni (?:number|no\.?)|national insurance(?: (?:number|no\.?))?|passport(?: (?:no\.?|number|nr\.?))?|reisepass\w*|pasaporte|passeport|dni|nie|nif|cpf|pesel|aadhaar|bsn|curp|insee|nir|num[eé]ro de s[eé]curit[eé] sociale|personalausweis\w*|ausweis\w*|id (?:card|no\.?|number)|identity (?:card|number|no\.?)|insurance (?:number|no\.?|id)|driver'?s? licen[cs]e(?: (?:no\.?|number))?)"
ID_LABEL = re.compile(rf"(?i)(?<![a-z]){_ID_LABEL}(?![a-z])")
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{4}-\d{4}-\d{3,4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|(?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z][A-Z0-9]{6,10}|\d{9,12})(?![\w-])"
)

_STREET = r"(?:Road|Street|Avenue|Lane|Drive|Close|Way|Court|Crescent|Terrace|Place|Boulevard|Square|Row|Hill|Gardens|Park|Parade|Mews|Grove|St|Rd|Ave|Dr|Ln|Blvd)\b\.?"
_UNIT = r"(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|Fl\.?|Room|#) ?\d{1,5}[A-Za-z]?|, \d{1,2}\.?[" + chr(0xBA) + chr(0xAA) + chr(0xB0) + r"] ?[A-Z]?|, (?:Whg\.?|Wohnung|appt?\.?|apt\.?|piso) ?\d+\w?)"
_NEXT = r"(?:,\s*|[ \t]*\r?\n[ \t>*|#/]*| - )"
_TOWN = rf"{_WORD}(?:[ -](?:{_WORD}|(?:am|an der|upon|sur|de|del|la|le|of|on|bei) {_WORD})){{0,2}}"
_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{4,6}|[A-Z]\d[A-Z] \d[A-Z]\d)"
_PLACE = rf"(?:\d{{4,6}} {_TOWN}|{_TOWN},? {_CODE}|{_TOWN})"
_LINE1 = rf"(?:\d{{1,5}}[A-Za-z]? (?:{_WORD} ){{1,3}}{_STREET}|\d{{1,5}}(?: bis| ter)?,? (?:rue|avenue|boulevard|chemin|place|impasse|quai|all[eé]e|cours) (?:de la |de l{_Q[0]}|des |du |de |d{_Q[0]}|la |le )?{_WORD}(?:[ -]{_WORD})*|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|C/) ?(?:(?:del|de|la|las|los|el) )*{_WORD}(?: {_WORD}){{0,2}},? \d{{1,4}}[A-Za-z]?|[{_U}][{_L}]+(?:-[{_U}][{_L}]+)*(?:stra(?:ss|{chr(0xDF)})e|str\.|weg|allee|platz|gasse|ring|damm|ufer) \d{{1,4}} ?[a-z]?|[{_U}][{_L}]+(?:[- ][{_U}][{_L}]+)? (?:Stra{chr(0xDF)}e|Weg|Allee|Platz|Ring) \d{{1,4}} ?[a-z]?|(?:P\.? ?O\.? ?Box|PO Box|Postfach|Apartado(?: de Correos)?|Case postale|BP|Casilla) \d{{1,6}})"
ADDRESS = re.compile(rf"(?<![\w.-])(?:{_LINE1}){_UNIT}?(?:{_NEXT}|(?<=\w) (?=\d{{5}} )){_PLACE}(?![\w{_L}])")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _phone_ok(text: str, m: re.Match) -> bool:
    s = m[0]
    n = _digits(s)
    if not 9 <= n <= 15:
        return False
    groups = re.findall(r"\d{3}", re.sub(r"^\+\d+ ", "", s))
    if s.startswith("+") and len(groups) >= 3 and len(set(groups)) == 1:
        return False
    # a number of three parts whose first two are the same counts something
    if (parts := re.fullmatch(r"(\d{3})[-.](\d{3})[-.]\d{4}", s)) and parts[1] == parts[2]:
        return False
    # a label of another kind of number, on the same line
    return not ID_LABEL.search(text[max(0, m.start() - 30) : m.start()].rpartition("\n")[2])


def candidates(kind: str, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The exact forms of a kind that touch a stretch of the text."""
    low, high = max(0, start - 130), min(len(text), end + 160)
    out = []
    if kind == "email":
        for m in EMAIL.finditer(text, low, high):
            if _NO_MAILBOX.match(m[0]) or re.match(r":[\w.-]+/", text[m.end() : m.end() + 40]) or text[max(0, m.start() - 2) : m.start()] == "//":
                continue
            s = m.start()
            # a sentence's words before a spelt-out address belong to it only as one word
            if text[s : m.end()].lower().startswith("mailto:"):
                s += 7
            out.append((s, m.end()))
    elif kind == "phone":
        out = [(m.start(), m.end()) for m in PHONE.finditer(text, low, high) if _phone_ok(text, m)]
        out = [(s, e) for s, e in ((s, s + len(text[s:e].rstrip(" .-()"))) for s, e in out)]
    elif kind == "id_number":
        for m in ID_NUMBER.finditer(text, low, high):
            if ID_LABEL.search(text[max(0, m.start() - 40) : m.start()]):
                out.append((m.start(), m.end()))
    elif kind == "address":
        out = [(m.start(), m.end()) for m in ADDRESS.finditer(text, low, high)]
    else:
        for m in NAME.finditer(text, low, high):
            s = m.start()
            skip = t.end() if (t := _TITLE.match(m[0])) else 4 if m[0].lower().startswith("von ") and _BY.search(text, max(0, s - 16), s) else 0
            if skip:
                if (again := NAME.match(text, s + skip)) is not None:
                    out.append((s + skip, again.end()))
                elif m[0].startswith("M. "):  # an initial, if only a family name follows
                    out.append((s, m.end()))
            else:
                out.append((s, m.end()))
    return [(s, e) for s, e in out if s < end and start < e]


#: What a stretch that the model has marked must have for its kind, where it has none of the exact forms.
_OWN = {
    "email": re.compile(rf"(?is)(?=[^\n]*[^\W_])[^\s@][^\n@]*{_AT}[^\n@]*[A-Za-z]"),
    "phone": re.compile(r"(?=(?:\D*\d){7,15}\D*\Z)[+(\d][\d ().,/-]*\d"),
    "id_number": re.compile(r"(?=(?:\D*\d){5})[A-Z\d][A-Z\d ./-]{4,24}[A-Z\d]"),
    "address": re.compile(rf"(?s)(?=.*\d)(?=.*\b[{_U}][{_L}]+.*\b[{_U}][{_L}]+)[\w(].{{10,}}[\w)]"),
}


def _own(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The stretch itself, at the bounds of its words, if it can be of its kind."""
    if kind == "name":
        return _own_name(text, start, end)
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if start == end or text[start].isalnum() and start and (text[start - 1].isalnum() or text[start - 1] in "_-/") or text[end : end + 1].isalnum() or text[end : end + 1] in ("_", "-"):
        return None
    s = text[start:end]
    groups = re.findall(r"\d+", s)
    if kind == "phone" and any(a == b for a, b in zip(groups, groups[1:]) if len(a) > 2):
        return None  # equal groups count something
    if _OWN[kind].fullmatch(s) is None or kind == "email" and (_NO_MAILBOX.match(s) or text[end : end + 1] == ":"):
        return None
    return start, end


def _own_name(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The whole words of a stretch, if they may be a name: any words may be one where the model has marked them."""
    while start < end and not text[start].isalpha():
        start += 1
    while start < end and not (text[end - 1].isalpha() or text[end - 1] == "."):
        end -= 1
    # a mark that misses a word's first or last letters
    low, high = max(0, start - 12), min(len(text), end + 12)
    while start > low and _IN_WORD.match(text[start - 1]):
        start -= 1
    while end < high and _IN_WORD.match(text[end]):
        end += 1
    if (t := _TITLE.match(text[start:end])) is not None and " " in text[start + t.end() : end]:
        start += t.end()
    s = text[start:end]
    if ANY_NAME.fullmatch(s) is None or re.search(r"\. +[a-z]", s):
        return None
    return None if re.match(r"[\w@./-]", text[start - 1 : start]) or re.match(r"[\w@/]", text[end : end + 1]) else (start, end)


def snap(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The exact form that shares most with a stretch the model has marked, if it shares half of it or of itself."""
    best, most = None, 0
    for s, e in candidates(kind, text, start, end):
        shared = min(e, end) - max(s, start)
        if shared > most:
            best, most = (s, e), shared
    if best and 2 * most >= min(end - start, best[1] - best[0]):
        return best
    return _own(kind, text, start, end)
