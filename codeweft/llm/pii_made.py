"""Lines with personal information whose labels are known because the pieces were put there, not found by any form.

A line is a template with slots; a slot is filled with a made piece of its kind, whose place is the label. Lines without a
labelled slot hold what only looks alike. Used for training (pii_train.py) and to measure recall apart from the exact forms.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "ba be bo ca co da de du el fa fi ga go ha he in ja ka ki la le li lo ma me mi mo na ne no or pa po ra re ri ro sa se si so ta te ti to ul va ve vi wa we ya za zo ner son sen ski man berg ton ley field wood worth stein mann ova ic".split()
_TOWN_ENDS = "bury field ton mere ford haven brook wick stedt hausen ville court moor gate".split()
_PARTICLES = "de del della der den van von zu zum af da das do dos di du la ter ten bin ibn".split()
_HOSTS = "example example.com example.org test invalid mail.example post.example.org".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))


def _cap(r: random.Random) -> str:
    return word(r).capitalize()


def _digits(r: random.Random, form: str) -> str:
    return re.sub("[#@]", lambda m: str(r.randint(0 if m[0] == "#" else 1, 9)), form)


def name(r: random.Random) -> str:
    given, family = _cap(r), _cap(r)
    x = r.random()
    if x < 0.12:
        family = f"{family}-{_cap(r)}"
    elif x < 0.24:
        family = f"{r.choice(_PARTICLES)} {family}"
    elif x < 0.34:
        family = r.choice(["Mc", "Mac", "O'", "O" + chr(0x2019), "D'", "Fitz"]) + family
    elif x < 0.38:
        family = family.replace(r.choice(family[1:]), r.choice("éáñüöåøçšłő"), 1)
    y = r.random()
    if y < 0.10:
        given = given[0] + "."
    elif y < 0.20:
        given = f"{given} {r.choice('ABCDEFGHJKLMNPRSTVW')}."
    elif y < 0.26:
        given = f"{given}-{_cap(r)}"
    z = r.random()
    if z < 0.14:
        out = f"{family}, {given}"
    elif z < 0.20:
        out = f"{given} {family.upper()}"
    else:
        out = f"{given} {family}"
    u = r.random()
    return out.lower() if u < 0.2 else out.upper() if u < 0.26 else out


def email(r: random.Random) -> str:
    local = r.choice([word(r), f"{word(r)}.{word(r)}", f"{word(r)}_{word(r)}", f"{word(r)[0]}{word(r)}", f"{word(r)}{r.randint(1, 99)}", f"{word(r)}+{word(r)}", f"{word(r)}-{word(r)}", r.choice(["support", "security", "billing", "abuse", "oncall", "hello", "press"])])
    host = r.choice([f"{word(r)}.{r.choice(_HOSTS)}", f"{word(r)}-{word(r)}.{r.choice(_HOSTS)}", r.choice(_HOSTS[1:3])])
    x = r.random()
    if x < 0.6:
        out = f"{local}@{host}"
    elif x < 0.85:
        a, d = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" (at) ", "."), (" [AT] ", "."), ("(at)", "(dot)"), (" at ", " dot "), (" at ", "."), (" {at} ", " {dot} "), (" <at> ", " <dot> "), ("(AT)", "."), (" @ ", " . ")])
        out = local + a + host.replace(".", d)
    else:
        out = f"{local}{r.choice(['&#64;', '%40', '&#x40;'])}{host}"
    return out.upper() if r.random() < 0.05 else out


def phone(r: random.Random) -> str:
    form = r.choice(
        "+@@ @## ######|+@@ @## ### ####|+@@@ @@ ### ## ##|+@@ (0)@## #######|+@ (@##) ###-####|(@##) ###-####|@##-###-####|@##.###.####|0@ ## ## ## ##|+33 @ ## ## ## ##|0@## ### ####|0@### ######|0@##/######|0@##-#######|+@@@########|+@@ @@ #### ####|00@@ @## ######|0@# #### ####|0@#########|+@@-@##-###-####|(0@##) ### ####|(0@#) #### ####|+@ @## ### ####|+@@.@##.######|0@@ ##### ###".split("|")
    )
    return _digits(r, form)


def id_number(r: random.Random) -> tuple[str, str]:
    """(label, number)"""
    label, form = r.choice(
        [("SSN", "@##-##-####"), ("SSN", "@## ## ####"), ("social security number", "@##-##-####"), ("Steuer-ID", "@# ### ### ###"), ("Steuernummer", "@##########"), ("TIN", "@########"), ("tax id", "@#-#######"), ("NINO", "QQ ## ## ## A"), ("NI number", "AB######C"), ("passport", "X########"), ("passport no.", "@########"), ("Reisepass", "C#@##@##@"), ("DNI", "########K"), ("NIE", "Y#######L"), ("CPF", "@##.###.###-##"), ("national ID", "####-####-###"), ("national id", "@#########"), ("PESEL", "@##########"), ("Aadhaar", "@### #### ####"), ("BSN", "@########"), ("insurance number", "@#########"), ("ID card", "AB#######"), ("driver's license", "D#######"), ("NIR", "@ ## ## ## ### ### ##"), ("Personalausweis", "L#@##@##@")]
    )
    number = re.sub("[A-Z]", lambda m: r.choice("ABCDEFGHJKLMNPRSTXYZ"), _digits(r, form))
    return label, number


def address(r: random.Random) -> str:
    street, n, town = _cap(r), r.randint(1, 400), r.choice([_cap(r), word(r).capitalize() + r.choice(_TOWN_ENDS), f"{r.choice(['Lower', 'Upper', 'Saint', 'North', 'Bad'])} {_cap(r)}", f"{_cap(r)}-{_cap(r)}"])
    code = _digits(r, "@####")
    uk = r.choice(["QX", "ZZ", "QV"]) + _digits(r, "@ #") + r.choice("ABDE") + r.choice("XYZ")
    sep = r.choice([", ", ", ", ", ", "\n", ",\n", "\n> ", "\n  ", " - "])
    unit = r.choice(["", "", "", f", Flat {r.randint(1, 60)}", f" Apt. {r.randint(1, 60)}", f", Unit {r.randint(1, 60)}", f", Suite {r.randint(100, 900)}"])
    kind = r.randint(0, 6)
    if kind == 0:
        return f"{n}{r.choice(['', '', 'A', 'b'])} {street} {r.choice('Road Street Avenue Lane Drive Close Way Court Terrace Place Square Row Hill St. Rd. Ave. Dr.'.split())}{unit}{sep}{town}{r.choice([' ' + uk, ', ' + uk, '', ' ' + code, ', ZQ ' + code])}"
    if kind == 1:
        return f"{street}{r.choice(['straße', 'strasse', 'str.', 'weg', 'allee', 'platz', 'gasse', 'ring'])} {n}{r.choice(['', '', 'a', ' b'])}{r.choice(['', '', f', Whg. {n % 30 + 1}'])}{sep}{code} {town}"
    if kind == 2:
        return f"{n}{r.choice(['', '', ' bis', ' ter', ','])} {r.choice(['rue', 'avenue', 'boulevard', 'quai', 'allée', 'impasse', 'chemin'])} {r.choice(['', 'de la ', 'du ', 'des ', 'de '])}{street}{sep}{code} {town}"
    if kind == 3:
        return f"{r.choice(['Calle', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'C/', 'Camino', 'Ronda'])} {r.choice(['', 'de la ', 'del ', 'de '])}{street}{r.choice([' ', ', '])}{n}{r.choice(['', '', f', {n % 9 + 1}º {r.choice("ABC")}'])}{sep}{code} {town}"
    if kind == 4:
        return f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'Postfach', 'Apartado', 'BP', 'Case postale', 'Casilla'])} {r.randint(10, 9999)}{sep}{r.choice([f'{code} {town}', f'{town} {code}', f'{town} {uk}'])}"
    if kind == 5:
        return f"{street} {r.choice(['Straße', 'Weg', 'Allee', 'Platz'])} {n}{sep}{code} {town}"
    return f"{n} {street} {_cap(r)} {r.choice(['Road', 'Lane', 'Street', 'Gardens', 'Crescent'])}{unit}{sep}{town} {uk}"


#: {n} name, {m} mail, {p} phone, {i} label and number, {a} address; the rest is filled with what is no case.
_LINES = """
Signed-off-by: {n} <{m}>|Co-authored-by: {n} <{m}>|Reviewed-by: {n} <{m}>|Author: {n}|Author: {n} <{m}>|Reported by {n} during the {w} run.|Thanks to {n} for the {w} trace.|thanks {n}, that fixed it|cc {n}|cc: {n}, {n}
{n} wrote:|On Monday {n} ({m}) wrote:|I paired with {n} on this line.|Co-reviewed with {n} ({w}).|- [ ] ask {n} about the {w} budget|@{w} asked whether {n} has access|Danke an {n} für den Hinweis.|Gemeldet von {n} im Bereitschaftsdienst.|Merci à {n} pour la relecture.
Gracias a {n} por la revisión.|Mme {n} a signalé le défaut.|Herr {n} ruft zurück.|Dr. {n} owns the {w} queue.|Mr. {n} asked for the log.|{n};{m};{p}|{n},{m},{p},{a}|"{n}","{m}","{p}"|name={n} mail={m}|# maintainer: {n} <{m}>|// TODO({w}): ask {n}|/* (c) 2021 {n} */
Contact: {m}|Write to {m} if the {w} queue is late.|mail {m} or call {p}|mailto:{m}|user {m} cannot log in|Bounce from {m}: mailbox full|"email": "{m}"|Call me on {p} when the {w} is back.|Tel. {p}|phone: {p}|T {p}|Llámame al {p}.|Rückruf unter {p} bitte|Tél. : {p}|on-call: {n}, {p}|WhatsApp {p}|Ring {p} and ask for {n}.
Customer gave {i} in the ticket.|{i}|{i} was in the log|The form shows {i}, delete it.|Ship the replacement node to {a}|Ship it to {a}.|Enviar a {a}.|Versand an {a}|Deliver to: {a}|Office: {a}|Livraison : {a}|address = "{a}"|My new address is {a}, from May on.|{n}, {a}|{n}
{d} {W} Lane slots were free|opcode table +{d} {d} {d} {d}|firmware {d}.{d}.{d} fails to boot|The {W} {W} restarted twice.|clone git@{w}.example:core/{w}.git first|docs say user@<host>, replace it|ping @ {d} ms, p99 @ {d} ms|hash {d}{d}{d}-{d}{d} differs|ticket {d}-{d}-{d}|order {d} of {d}|See {W} {W} for details.|class {W}{W}:|npm i @{w}/{w}@{d}.{d}.{d}|{w}.{w}({d}, {d})|commit {d}{d}{d}{d}|From: the {W} team|Ask the {W} Team about {W} Store.|{d} {w} road blocks were hit|{W} Street is a metric|the {w} and the {w} differ|Author: platform team|reviewed by the {w} group|seed {d} {d} {d}|range {d}-{d}|at line {d} of {w}|IBAN checks use {d}{d}{d}{d}|build {d}{d}{d}{d}{d} at {d}|thanks to everyone for the {w}|{W} {w} {w} is late.|rename {w} to {w}|"{w} {w}. {W} {w}"|{W}. {W} {w} the {w}.
""".strip().replace("\n", "|").split("|")


def line(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made line and (start, end, kind) of its pieces; kinds by their place in KINDS."""
    text, own = "", []
    for part in re.split(r"(\{\w\})", r.choice(_LINES)):
        if part == "{n}":
            piece, kind = name(r), 4
        elif part == "{m}":
            piece, kind = email(r), 0
        elif part == "{p}":
            piece, kind = phone(r), 1
        elif part == "{a}":
            piece, kind = address(r), 3
        elif part == "{i}":
            label, piece = id_number(r)
            text += label + r.choice([": ", " ", " is ", " no. ", ":\t", "=", " # "])
            kind = 2
        else:
            text += word(r) if part == "{w}" else _cap(r) if part == "{W}" else str(r.randint(1, 99999)) if part == "{d}" else part
            continue
        own.append((len(text), len(text) + len(piece), kind))
        text += piece
    return text, own
