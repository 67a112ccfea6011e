"""Problem 8: e-mail addresses, phone numbers, identity numbers, street addresses and names in free text.

Anchor expansion: an Aho-Corasick automaton over the folded text finds at-signs and their spellings,
cues of numbers and of people, verbs of saying and street words; a second one finds the names of known people; numbers and postal codes are
anchored by their digits. From each anchor a deterministic parser expands to both sides, validates what it finds and sets
its boundaries. Types are tried from the most to the least certain, and no two mentions overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import product, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .hot import salted

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: Words of known people's names that are sent to the workers; more are joined.
PEOPLE = 200_000

# Spellings and cues that anchor a mention.
_AT = "@ \uff20 &#64; %40 [at (at {at <at".split() + [" at ", " at\n", "[ at", "( at", "{ at"]
_PHONE_CUES = "phone tel. tel: tel= tel  telefon teléfono téléphone tél. tél: call call me mobile mobil handy cell fax whatsapp ring reach me on dial hotline rufnummer appeler contacter guardia sms signal".split(" ")
_ID_CUES = "ssn,social security,ni number,nino,national insurance,steuer-id,steuernummer,steuer id,idnr,nir,sécurité sociale,insee,passport,reisepass,passeport,pasaporte,pass-nr,dni,nie,nif,tax id,tin,taxpayer,id card,ausweis,identity card,carte d'identité,personal number,sozialversicherung".split(",")
_PERSON_CUES = (
    "author authors maintainer maintainers reviewer owner contact name assignee reporter attn from to with by cc bcc von par por mit avec con thanks merci danke gracias an à a for für asked ask ping dear hi hello "
    "liebe lieber hallo bonjour hola signed-off-by co-authored-by reviewed-by acked-by tested-by reported-by suggested-by mr mrs ms miss dr prof sir herr frau mme mlle sr sra don doña señor señora monsieur madame m "
    "contacter contactar ansprechpartner ansprechpartnerin colleague kollege kollegin collègue colega"
).split()
_SAYING = (
    "asked asks wrote writes said says signed reviewed reviews reported reports approved approves suggested suggests noted notes pointed replied confirmed confirms thinks agreed agrees fixed commented "
    "prüft prüfte schreibt schrieb meint meinte fragt fragte sagt sagte demande écrit dit pense pregunta preguntó escribió dice dijo"
).split()
#: Cues that places, products and reasons follow as well.
_WEAK_CUES = frozenset("from to with by an à a for für mit avec con von par por".split())
#: Letters up to which a cue of people is looked for as a word by itself.
SHORT = 3
#: Before such a cue they make it a sure one: what people do, and what is done by people.
_DONE = frozenset(
    "ask asked approved call changed confirmed contributed fixed found merged noted reported requested reviewed sent signed spotted suggested tested thanks thank written speak spoke talk talked "
    "geändert gemeldet geprüft geschrieben gefunden rückfragen vorgeschlagen dank danke écrit modifié relu revu signalé merci parler proposé avisar escrito gracias modificado hablar propuesto revisado".split()
)
#: What stands before a name on its line without being a word: a dash, the field of a list or form, an opening bracket after a mark.
_MARK = re.compile(r"(?:^\s*--|[—–]|\b(?:todo|fixme)\(|\w+ line \d+:|=)[ \t]*$", re.I)
_TITLES = frozenset("mr mrs ms miss dr prof sir herr frau mme mlle sr sra m don doña".split())
# Function words of the four languages and names of days and months, which open sentences; nouns for groups and firms; what opens names of places.
_FUNCTION = frozenset(
    "the this that these those a an and or if it its we you they he she i as at in on to for of with by from please thanks thank dear hi hello regards best see note set run each can there which how what when where who why not no yes is are was were be been do does did "
    "has have had will would should must may some any all both one two first second last next new our your their his her my also but so then than after before since until while because use using used cc re fwd tel phone fax mail email subject todo fixme ps "
    "der die das den dem des ein eine einen bitte für mit und oder wir sie ich er es ist sind nicht auch wie was wer wo wenn aber nach vor bei aus zu "
    "le la les l el los las un une una unos des du de del et ou y o si no nous vous il elle est sont pas este esta hay para con por pour avec dans sur que qui "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo".split()
)
_GROUP = frozenset("team teams group committee council board department dept office institute university college school company inc corp corporation ltd llc gmbh ag sa foundation association club project community list street road lane avenue square park".split())
_PLACE = frozenset("new san santa saint st los las el north south east west northern southern eastern western upper lower great united port fort mount lake river".split())
_ARTICLE = re.compile(r"(?<!\w)(?:the|a|an|this|that|our|your|their|its|der|die|das|dem|den|des|ein|eine|einem|einen|le|la|les|un|une|ce|cette|el|los|las|una|este|esta)\s+$|(?<!\w)[ld]['’]$", re.I)

# e-mail
_LOCAL = re.compile(r"[\w!#$%&'*+/=?^{|}~.-]+$")
_ZERO = r"[\u200b\u200c\u2060\ufeff]*"
_SPELT_AT = re.compile(rf"\s*[\[({{<]\s*at\s*[\])}}>]\s*|\s(?:@|\uff20){_ZERO}\s|(?:@|\uff20|&#64;|%40){_ZERO}|\s+at\s+", re.I)
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_DOT = rf"(?:\.{_ZERO}|\uff0e|\s*[\[({{<]\s*(?:dot|punkt|point|punto)\s*[\])}}>]\s*|\s+(?:dot|DOT|Dot)\s+)"
_DOMAIN = re.compile(rf"({_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[^\W\d_]{{2,24}}(?:{_DOT}[^\W\d_]{{2,24}})*)(?![\w-])")
_SPELT_DOT = re.compile(r"\bdot\b", re.I)

# numbers
_S = r"(?:[ \u00a0\u2007\u2009\u202f]|\r?\n[ \t]*)"
_EXT = rf"(?:{_S}?,?{_S}?(?:ext\.?|extension|ext:|durchwahl|dw\.?|poste|int\.|x){_S}?\d{{1,6}})?"
_L, _R = r"(?<![\w+@#/])(?<![\d][.:-])", r"(?![\w@])(?![.:-]\d)"
_IDS = [
    re.compile(rf"{_L}[1-478]{_S}?\d\d{_S}?\d\d{_S}?(?:\d\d|2[AB]){_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d\d{_R}"),
    re.compile(rf"{_L}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}{_R}"),
    re.compile(rf"{_L}\d{{3}}(?:-|{_S}|‑|–)\d\d(?:-|{_S}|‑|–)\d{{4}}{_R}"),
    re.compile(rf"{_L}[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]{_R}"),
    re.compile(rf"{_L}[A-Z]{{1,2}}\d{{7,8}}{_R}"),
    re.compile(rf"{_L}(?:\d{{8}}-?|[XYZ]-?\d{{7}}-?)[A-Z]{_R}"),
]
#: With a cue before them: digits in any grouping.
_CUED_ID = re.compile(rf"{_L}(?=(?:[\w]{_S}?){{6,}})[A-Z]{{0,3}}\d(?:(?:{_S}|[-./])?[\dA-Z]){{5,17}}{_R}")
_PHONES = [
    re.compile(rf"(?<![\w+])\+{_S}?\d{{1,3}}(?:(?:{_S}|[.\-/‑])?\(0\))?(?:(?:{_S}|[.\-/‑])?\(?\d{{1,8}}\)?){{1,7}}{_EXT}(?![\w@])", re.I),
    re.compile(rf"{_L}00[1-9]\d{{0,2}}(?:{_S}|[.\-/])(?:\(0\)(?:{_S}|[.\-/])?)?\d{{1,5}}(?:(?:{_S}|[.\-/])\d{{2,8}}){{1,5}}{_EXT}{_R}", re.I),
    re.compile(rf"(?<![\w+])\(\d{{2,5}}\)(?:{_S}|[-.])?\d{{3,4}}(?:{_S}|[-.‑])\d{{3,4}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}(?:1[-. ])?\d{{3}}([-.‑])\d{{3}}\1\d{{4}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}0[1-9](?:(?:{_S}|[.-])\d\d){{4}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}0\d{{2,5}}{_S}?/{_S}?\d{{3,8}}(?:(?:{_S}|-)\d{{1,5}}){{0,3}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}(?:1|3[0-9]|4[0-9]|55|61|81|91){_S}\d{{2,5}}{_S}\d{{5,8}}{_EXT}{_R}", re.I),
    re.compile(rf"{_L}\d{{3}}[-.‑]\d{{4}}{_S}?,?{_S}?(?:ext\.?|extension|x){_S}?\d{{1,6}}{_R}", re.I),
]
_CUED_PHONE = re.compile(rf"(?<![\w+@#])[+(]?\d(?:(?:{_S}|[.\-/()‑]){{0,2}}\d){{6,14}}{_EXT}(?![\w@])", re.I)

# street addresses
_U = r"[^\W\d_a-zß-ÿ](?:[^\W\d_]|['’\u0300-\u036f])*"
_W = rf"{_U}(?:-{_U})*(?!\w)"
_B = r"(?:,[ ]?|[ ])"
_NL = r"(?:[ ]|[ ]?\r?\n[ \t]*)"
_UNIT = rf"(?:flat|apt|apartment|unit|suite|ste|room|floor|appt|bât|esc|piso|whg){_NL}?\.?{_NL}?#?\w{{1,5}}"
_STREETS = "street st road rd lane ln avenue ave row close court ct drive dr boulevard blvd way place pl terrace square sq hill park gardens crescent cres mews parade walk quay wharf highway hwy circle trail grove green yard gate rise view".split()
_TYPES = rf"(?:{'|'.join(_STREETS)})\b\.?"
_PART = r"(?:de|del|della|des|du|la|las|le|les|los|am|an|auf|bei|der|dem|den|im|in|sur|sous|en|upon|on|of|the|el|y|et|und)"
_TOWN = rf"{_W}(?:[ ](?:{_PART}[ ]){{0,2}}{_W}){{0,3}}"
_UK = r"[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2}\b"
_ENGLISH = re.compile(rf"(?:{_UNIT},{_NL})?(?<![\w.:-])\d{{1,5}}[a-z]?(?:[-/]\d{{1,4}}[a-z]?)?[ ](?:{_W}[ ]){{1,4}}?(?i:{_TYPES})(?:,{_NL}{_UNIT})?(?:,{_NL}(?:{_TOWN}(?:,{_NL}{_TOWN})?)(?:,?{_NL}[A-Z]{{2}}\b)?(?:,?{_NL}(?:\d{{5}}(?:-\d{{4}})?|{_UK}))?)?".replace("(?:flat|", "(?i:flat|"))
_ROMANCE_TYPES = r"(?:rue|quai|allée|allee|avenue|av\.|boulevard|bd|place|impasse|chemin|route|cours|passage|square|sentier|via|viale|piazza|corso)"
_FRENCH = re.compile(rf"(?:{_UNIT},{_NL})?(?<![\w.:-])\d{{1,5}}(?:[ ]?(?:bis|ter|quater|[a-dA-D]\b))?,?[ ]{_ROMANCE_TYPES}[ ](?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les)[ ]?){{0,2}}{_W}(?:[ -](?:(?:de|du|des|la|le|et)[ ]){{0,2}}{_W}){{0,4}}(?:,{_NL}{_UNIT})?,{_NL}\d{{5}}[ ]{_TOWN}".replace("(?:flat|", "(?i:flat|").replace("(?:rue|", "(?i:rue|"))
_SPANISH = re.compile(rf"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carretera|Ronda|Travesía|Glorieta|Rambla)[ ](?:(?:de|del|la|las|los|el)[ ]){{0,3}}{_W}(?:[ ](?:(?:de|del|la|las|los|el|y)[ ]){{0,2}}{_W}){{0,4}},?[ ](?:n\.?º?[ ]?)?\d{{1,4}}[a-zA-Z]?(?:,{_NL}[^\n,]{{1,14}})?,{_NL}\d{{5}}[ ]{_TOWN}")
_GERMAN = re.compile(rf"{_W}(?:[ ](?:(?:der|dem|den|des|am|im)[ ])?{_W}){{0,4}}[ ]\d{{1,4}}(?:[ ]?[a-z]\b)?(?:[-/]\d{{1,4}})?(?:,{_NL}{_UNIT})?,{_NL}(?:[A-Z]{{1,2}}-)?\d{{5}}[ ]{_TOWN}")

# names
_PARTICLE = r"(?:(?:van|von|de|del|della|der|den|di|da|dos|du|la|le|ten|ter|zu|zum|bin|ibn|al|el|af|av|Van|Von|De|Del|Della|Di|Da|Du|La|Le|Mac|Mc)[ ])"
_FAMILY = rf"(?:{_PARTICLE}{{0,3}}{_W})"
_N = r"(?:[ \u00a0\u2009\u202f]|[ ]?\r?\n[ \t]*)"
_INITIAL = r"[^\W\d_a-zß-ÿ]\."
_DIRECT = re.compile(rf"(?<![\w@/.-])({_INITIAL}|{_W}){_N}(?:{_INITIAL}{_N}?){{0,2}}({_FAMILY})(?![\w@])")
_INVERTED = re.compile(rf"(?<![\w@/.-])({_FAMILY}),{_N}({_INITIAL}|{_W})(?:{_N}{_INITIAL})?(?![\w@])")


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, cues in (("id", _ID_CUES), ("phone", _PHONE_CUES), ("at", _AT), ("street", [f" {w}" for w in _STREETS]), ("person", [w for w in _PERSON_CUES if len(w) > SHORT]), ("says", [f" {w}" for w in _SAYING])):
        for cue in cues:
            if cue.strip():
                a.add_word(cue, (*a.get(cue, ()), (kind, len(cue))))
    # short ones with what stands around a word, since they lie in many others
    for cue in (w for w in _PERSON_CUES if len(w) <= SHORT):
        for before, after in product(" \n(>*:,", " .:,\n(="):
            a.add_word(before + cue + after, (("short", len(cue)),))
    a.make_automaton()
    return a


class Known:
    """Names of known people, folded; of families the last word. An automaton finds them in a text."""

    def __init__(self, given: set[str], families: set[str]):
        self.given, self.families = given, families
        self.automaton = ahocorasick.Automaton()
        for name in given | families:
            self.automaton.add_word(name, len(name))
        if len(self.automaton):
            self.automaton.make_automaton()

    def anchors(self, low: str) -> Iterator[tuple[int, int]]:
        return ((end - n + 1, end + 1) for end, n in self.automaton.iter(low)) if len(self.automaton) else iter(())


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


class Found:
    """Mentions of a text, none within another."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, str]] = []  # in order and apart

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.spans, (e,))
        return i == 0 or self.spans[i - 1][1] <= s

    def add(self, s: int, e: int, kind: str) -> bool:
        while e > s and self.text[e - 1].isspace():
            e -= 1
        if e > s and self.free(s, e):
            insort(self.spans, (s, e, kind))
            return True
        return False


def _emails(text: str, anchors: list[int], found: Found) -> None:
    for at in anchors:
        if not found.free(at, at + 1):
            continue
        begin = at
        while begin > 0 and text[begin - 1] in " \t":
            begin -= 1
        m = _SPELT_AT.match(text, begin)
        if m is None:
            begin = at
            m = _SPELT_AT.match(text, at)
        if m is None:
            continue
        local = _LOCAL.search(text[max(0, begin - 80) : begin])
        if local is None:
            continue
        s = begin - len(local[0])
        name = re.split(r"[<({\[=:,;\"'`/|]|mailto:", local[0])[-1].strip(".!#$%&*?^~'{}|")
        s = begin - len(name) if local[0].endswith(name) else -1
        d = _DOMAIN.match(text, m.end())
        if s < 0 or not name or d is None or not name[0].isalnum():
            continue
        e = d.end()
        word = m[0].strip().lower() == "at"
        if word and not _SPELT_DOT.search(d[0]):
            # "look at build.log": only a name no word looks like, or the capitals of a disguise, make it an address
            if not (m[0].strip() == "AT" or re.search(r"[\d._+]", name)) or text[d.end() : d.end() + 1] in "(/":
                continue
        if text[e : e + 1] in (":", "/") and text[e + 1 : e + 2].strip() and name.lower() in ("git", "hg", "svn", "ssh"):
            continue
        if _PATH.match(text, e):
            continue
        found.add(s, e, "email")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


#: A stretch of all that the patterns of numbers may read, from what may stand before the first digit; with fewer than six digits it holds no number of interest.
_STRETCH = re.compile(rf"(?:\+{_S}?|\(|[A-Z]{{1,2}}{_S}?|[XYZ]-)?\d(?:(?i:extension|ext|durchwahl|dw|poste|int\.|x)|[\d\s().,:\-/+\u2011\u2013A-Z])*+")


def _windows(spans: Iterator[tuple[int, int]], before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Where to look around anchors, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        s, e = max(0, s - before), min(size, e + after)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _numbers(text: str, cues: list[tuple[int, str]], found: Found) -> None:
    # a pattern looks at two characters behind what it reads
    near = _windows((m.span() for m in _STRETCH.finditer(text) if _digits(m[0]) >= 6), 0, 2, len(text))
    if not near:
        return
    for p in _IDS:
        for low, high in near:
            for m in p.finditer(text, low, high):
                found.add(*m.span(), "idnum")
    for end, kind in cues:
        # what follows a cue: a few words like "is" or "no.", then the number
        m = re.compile(r"[\s.:=#\-]*(?:(?:is|no|nr|number|num|nummer|numéro|número|me|on|at|under|unter|au|en|it|de|als|ist|est|es)\b[\s.:=#]*){0,3}").match(text, end)
        p = (_CUED_ID if kind == "id" else _CUED_PHONE).match(text, m.end())
        if p and found.free(*p.span()):
            n = _digits(p[0])
            if kind == "id" and n >= 6 and n >= 0.6 * len(re.sub(r"\W", "", p[0])):
                found.add(*p.span(), "idnum")
            elif kind == "phone" and 7 <= n <= 20:
                found.add(p.start(), p.start() + len(p[0].rstrip("-./( ")), "phone")
    for k, p in enumerate(_PHONES):
        for low, high in near:
            for m in p.finditer(text, low, high):
                body = m[0].rstrip("-./( \r\n")
                if 7 <= _digits(body) <= 20 and (k or _digits(body) >= 8):
                    found.add(m.start(), m.start() + len(body), "phone")


_POSTAL = re.compile(r"(?<!\w)\d{5}(?!\w)")


def _line(text: str, at: int) -> int:
    """``at``, or the end of the word it falls into."""
    while 0 < at < len(text) and not text[at - 1].isspace():
        at += 1
    return at


def _addresses(text: str, streets: list[tuple[int, int]], found: Found) -> None:
    postal = _windows((m.span() for m in _POSTAL.finditer(text)), 160, 100, len(text))
    streets = _windows(iter(streets), 90, 160, len(text))
    for p in (_SPANISH, _FRENCH, _ENGLISH, _GERMAN):
        for m in (m for low, high in (streets if p is _ENGLISH else postal) for m in p.finditer(text, _line(text, low), high)):
            value = m[0]
            s, e = m.span()
            if p is _ENGLISH and value.endswith(".") and not re.search(r"(?<!\w)\w{2}\.$", value):
                e -= 1  # it ends the sentence
            if p is _GERMAN:
                # sentence openers before the street
                words = value.split(" ")
                while len(words) > 2 and words[0].lower() in _FUNCTION:
                    s += len(words[0]) + 1
                    words = words[1:]
            found.add(s, e, "address")


_PATH = re.compile(r":[\w~./-]*/")
_BEFORE = re.compile(r"(?:([^\W\d_][\w'’-]*)\s+)?([^\W\d_][\w'’-]*)\.?[\s:,(=]*$")
_AFTER = re.compile(r"[ \t]+(?:a )?([^\W\d_]+)")
#: Characters looked at before and after an anchor of a name.
REACH = 120


def _persons(text: str, near: list[tuple[int, int]], known: Known, found: Found) -> None:
    """Names in stretches of the text that hold an anchor of one."""
    last = -1  # where the name before ends
    for low, high in near:
        at = low
        while 0 < at < len(text) and (text[at - 1].isalnum() or text[at - 1] in "@/.-_"):
            at += 1  # not from within a word
        a, b = _DIRECT.search(text, at, high), _INVERTED.search(text, at, high)
        while at < high:
            a = _DIRECT.search(text, at, high) if a and a.start() < at else a
            b = _INVERTED.search(text, at, high) if b and b.start() < at else b
            if a is None and b is None:
                break
            left = min(m.start() for m in (a, b) if m)
            end = 0
            for m, direct in ((a, True), (b, False)):
                if m is None or m.start() > left:
                    continue
                first, family, s = (m[1], m[2], left) if direct else (m[2], m[1], left)
                if not direct and (lead := _PREPOSITION.match(family)) and re.search(r"\w\s+$", text[max(0, s - 3) : s]):
                    s, family = s + lead.end(), family[lead.end() :]
                listed = last == s - 2 and text[last:s] == ", "
                if _person(text, s, m.end(), first, family, direct, known, listed) and found.add(s, m.end(), "person"):
                    end = last = m.end()
                    break
            at = end or left + len(re.match(r"[\w.'’-]+", text[left : left + 200])[0])


def _common(text: str, word: str) -> bool:
    """Whether the text has ``word`` in small letters too, other than in an address or a path."""
    return len(word) > 2 and re.search(rf"(?<![\w.@+/-]){re.escape(word.lower())}(?![\w@+/-]|\.\w)", text) is not None


def _person(text: str, s: int, e: int, first: str, family: str, direct: bool, people: Known, listed: bool) -> bool:
    """Whether what has the form of a name is one: by known names, by what stands before and after it, and by what else the words are."""
    last = family.split(" ")[-1]
    words = [first.lower().rstrip("."), *(w.lower() for w in last.split("-"))]
    initial = len(words[0]) == 1 and first.endswith(".")
    if len(last) < 2 or any(w in _FUNCTION or w in _GROUP for w in words[initial:]) or words[0] in _TITLES and len(words[0]) > 1:
        return False
    named, known = words[0] in people.given, last.lower() in people.families
    before = text[max(0, s - 40) : s].split("\n")[-1]
    lead = _BEFORE.search(before)
    cue = lead[2].lower() if lead and lead[2].lower() in _CUES else "mark" if _MARK.search(before) else "list" if listed else None
    if cue in _WEAK_CUES and lead[1] and lead[1].lower() in _DONE:
        cue = "done by"
    follow = _AFTER.match(text, e)
    says = bool(follow) and follow[1] in _SAYS
    if cue != "done by" and _ARTICLE.search(text[max(0, s - 12) : s]) and not (named and known):
        return False  # the Elena Scheduler
    if initial:
        return known or says or cue is not None and cue not in _WEAK_CUES
    if named and known:
        return direct or cue is not None or says or _opens(text, s)
    if follow and follow[1][0].isupper() and follow[1].lower() in _GROUP:
        return False
    sure = says or cue is not None and cue not in _WEAK_CUES
    if known or named:
        if direct:
            return (sure or cue is not None or not (named and _common(text, last))) and (named and first.isupper() == family.isupper() or known and (sure or cue is not None))
        return sure or cue is not None or named and _opens(text, s)
    if words[0] in _PLACE or "\n" in text[s:e] or not direct and not says and cue in (None, "cc", "to"):
        return False
    if sure:
        return not (_common(text, first) and _common(text, last))
    return cue is not None and not _common(text, first) and not _common(text, last) and not first.isupper() and not family.isupper()


def _opens(text: str, s: int) -> bool:
    """Whether a line or a part of a list begins at ``s``."""
    before = text[max(0, s - 40) : s].rstrip(" \t>*#/-")
    return not before or before[-1] in ",(:;=\n"


_CUES, _SAYS = frozenset(_PERSON_CUES), frozenset(_SAYING)

#: Particles that are prepositions too: after a word, as in "changed by", they are no part of the name.
_PREPOSITION = re.compile(r"(?:von|de|di|du|del|da)[ ]")


def mentions(text: str, known: Known) -> list[tuple[int, int, str]]:
    """Begin, end and type of each mention, in order."""
    found = Found(text)
    at, streets, last, people = [], [], {}, []
    low = _fold(text)
    for end, cues in _automaton().iter("\n" + low):
        end -= 1
        for kind, size in cues:
            begin = end - size + 1
            if kind == "short":
                if _CAPITAL.match(text, end):
                    people.append((begin - 1, end))
            elif kind == "at":
                at.append(begin)
            elif low[end + 1 : end + 2].isalnum() and kind in ("street", "person", "says"):
                continue
            elif kind == "street":
                streets.append((begin, end + 1))
            elif kind == "says":
                people.append((begin, end + 1))
            elif begin == 0 or not low[begin - 1].isalnum():
                if kind != "person":
                    last[(begin, kind)] = end + 1
                elif _CAPITAL.match(text, end + 1):
                    people.append((begin, end + 1))
    people += (span for span in known.anchors(low) if text[span[0]].isupper() and not low[span[1] : span[1] + 1].isalnum() and not (span[0] and low[span[0] - 1].isalnum()))
    people += (m.span() for m in _MARKED.finditer(text))
    cues = sorted((end, kind) for (_, kind), end in last.items())
    _emails(text, at, found)
    _numbers(text, cues, found)
    _addresses(text, sorted(streets), found)
    _persons(text, _windows(iter(sorted(people)), REACH, REACH, len(text)), known, found)
    return sorted(found.spans)


#: A capital letter after a cue, with what may stand between.
_CAPITAL = re.compile(r"\.?[\s:,(=]*[^\W\d_a-zß-ÿ]")
#: A capital letter after a mark that names follow.
_MARKED = re.compile(r"(?:^[ \t]*--|[—–]|(?:[Tt][Oo][Dd][Oo]|[Ff][Ii][Xx][Mm][Ee])\(|\w line \d+:|=)[ \t]*[^\W\d_a-zß-ÿ]", re.M)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("value", pa.string())]))
FOUND = "doc_id bigint, mentions array<struct<start: int, end: int, pii_type: string, value: string>>, redacted string"


def _searched(ids: pa.Array, texts: list[str | None], known: Iterator[Known]) -> pa.RecordBatch:
    spans = [mentions(t, k) if t else [] for t, k in zip(texts, known)]
    found = pa.array([[{"start": s, "end": e, "pii_type": k, "value": t[s:e]} for s, e, k in x] for t, x in zip(texts, spans)], _ARROW)
    redacted = pa.array([None if t is None else redact(t, x) for t, x in zip(texts, spans)], pa.string())
    return pa.RecordBatch.from_arrays([ids, found, redacted], ["doc_id", "mentions", "redacted"])


def _names(contributors: DataFrame) -> DataFrame:
    """``word, family``: the first word of each given name and the last one of each family, in small letters."""
    given = contributors.select(F.lower(F.regexp_extract("given_name", r"^\s*(\S+)", 1)).alias("word"), F.lit(False).alias("family"))
    family = contributors.select(F.lower(F.regexp_extract("family_name", r"(\S+)\s*$", 1)).alias("word"), F.lit(True).alias("family"))
    return given.unionByName(family).filter(F.length("word") > 0).distinct()


_TOKEN = re.compile(_W)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, and the parts of words with a hyphen, that begin with a capital."""
    for b in batches:
        rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in {x for m in set(_TOKEN.findall(t)) for x in (m.lower(), *m.lower().split("-"))}]
        ids, found = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["text_id", "word"])


def find_pii(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    """``doc_id, mentions, redacted``: the mentions of each text in order, and the text with each replaced by its type.

    ``contributors`` are known people; others are found by what stands before and after them. A
    null text has null ``redacted`` and no mentions, an empty one stays empty; each row is treated by itself,
    so documents delivered again give as many rows. Up to PEOPLE words of names are sent to the workers; of
    more, those that occur in a text are joined to it, with the same result.
    """
    spark = documents.sparkSession
    names = _names(contributors)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    few = names.limit(PEOPLE + 1).collect()
    if len(few) <= PEOPLE:
        shared = spark.sparkContext.broadcast(({r[0] for r in few if not r[1]}, {r[0] for r in few if r[1]}))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Known(*shared.value)
            for b in batches:
                yield _searched(b.column(0), b.column(1).to_pylist(), repeat(known))

        return rows.mapInArrow(search, FOUND)
    texts = rows.withColumn("text_id", F.xxhash64("text"))
    words = cut(texts.filter(F.length("text") > 0).select("text_id", "text").mapInArrow(_words, "text_id bigint, word string").distinct())
    asked, held = salted(words, names, "word", ["text_id"])
    own = asked.join(held, ["word", "salt"]).groupBy("text_id").agg(F.collect_set(F.when(~F.col("family"), F.col("word"))).alias("given"), F.collect_set(F.when(F.col("family"), F.col("word"))).alias("families"))

    def search_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = (Known(set(g or ()), set(f or ())) for g, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield _searched(b.column(0), b.column(1).to_pylist(), known)

    return texts.join(own, "text_id", "left").select("doc_id", "text", "given", "families").mapInArrow(search_own, FOUND)


def found_pii(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    found = find_pii(documents, contributors).select("doc_id", F.explode("mentions").alias("m"))
    return found.select("doc_id", "m.pii_type", "m.value")
