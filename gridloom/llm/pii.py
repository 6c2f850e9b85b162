"""Personal information in free text: found through disguises, replaced by typed placeholders.

Transducers rewrite a text into a plain form and remember where each rewritten character came from: homoglyphs and
odd dashes or blanks one for one, entities, damaged encodings, zero-width characters, doubled blanks and hyphenated
line ends many for one, worded or bracketed at and dot signs of addresses to @ and a point, and spoken numbers of four
languages to figures. Detectors run on the plain form alone, and their spans are mapped back to the source characters,
so every offset is a code point position of the source.

One automaton passes over each text and stops only at cues (labels, titles, street words, at signs); each cue starts
one anchored pattern. Numbers are found by one pattern and told apart by their shape and by the label before them.
Where a pattern begins before its cue, the search goes back as many words as the pattern can have and so cuts nothing;
local parts, domains and whatever follows a cue may have any length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")

# --- transducers ---------------------------------------------------------------------------------------------------

# Look-alikes of Latin letters, and characters read as a plain one.
_LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсхуԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESIJKMHOPCTXaesijopcxydABEZHIKMNOPTYXo", strict=True))
_PLAIN = {" ": " ", " ": " ", " ": " ", "‐": "-", "‑": "-", "‒": "-", "−": "-", "’": "'", "‘": "'", "ʼ": "'", "․": "."}
_ONE_TO_ONE = _LOOKALIKE | _PLAIN | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_ODD = re.compile(r"[   ‐-‒−’‘ʼ․Ͱ-ӿԁ！-～]")
#: What has to be rewritten, each with what gives it away; a text is searched only for what it holds.
_EDITS = (
    (("&",), r"&(?:#\d{1,5}|#x[0-9a-fA-F]{1,4}|[a-zA-Z]{2,8});"),  # entities
    (("Ã", "Â"), r"[ÃÂ][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]"),  # UTF-8 read as Latin
    (("\u200b", "\u00ad", "\u2060", "\ufeff", "\u200c", "\u200d"), r"[\u00ad\u200b-\u200d\u2060\ufeff]+"),  # invisible
    (("-\n",), r"-\n(?:(?<=[a-zà-öø-ÿ]-\n)(?=[a-zà-öø-ÿ])|(?<=[A-ZÀ-Þ]{2}-\n)(?=[A-ZÀ-Þ]{2}))"),  # hyphenated line ends
    (("  ", "\u00a0 ", " \u00a0", "\u00a0\u00a0"), r"[ \u00a0]{2,}"),
)


@lru_cache(maxsize=1 << len(_EDITS))
def _edit(wanted: tuple[int, ...]) -> re.Pattern:
    return re.compile("|".join(_EDITS[i][1] for i in wanted))


def _rewritten(found: str) -> str:
    first = found[0]
    if first == "&":
        plain = html.unescape(found)
        if plain == found:
            plain = html.unescape(found.lower())
        return plain if len(plain) == 1 and plain != found else found
    if first in "ÃÂ":
        try:
            return found.encode("cp1252").decode("utf-8")
        except UnicodeError:
            try:
                return found.encode("latin-1").decode("utf-8")
            except UnicodeError:
                return found
    return " " if first in "  " else ""


class Plain:
    """A text in plain form; ``source`` maps a span of it to code point positions of the source."""

    __slots__ = ("text", "_at", "_shift", "_made")

    def __init__(self, text: str) -> None:
        self._at: list[int] = []  # where each edit ends in the plain text
        self._shift: list[int] = []  # source minus plain position from there on
        self._made: list[bool] = []  # whether the edit left a character
        wanted = tuple(i for i, (signs, _) in enumerate(_EDITS) if any(x in text for x in signs))
        if wanted:
            parts, done, length = [], 0, 0
            for m in _edit(wanted).finditer(text):
                new = _rewritten(m.group())
                if new == m.group():
                    continue
                parts += [text[done : m.start()], new]
                length += m.start() - done + len(new)
                done = m.end()
                self._at.append(length)
                self._shift.append(done - length)
                self._made.append(bool(new))
            if parts:
                text = "".join([*parts, text[done:]])
        if not text.isascii() and _ODD.search(text):
            for odd in _ONE_TO_ONE.keys() & set(text):
                text = text.replace(odd, _ONE_TO_ONE[odd])
        self.text = text

    def source(self, start: int, end: int) -> tuple[int, int]:
        """A character that an edit left stands for all that the edit replaced."""
        if not self._at:
            return start, end
        k = bisect_right(self._at, start) - 1
        left = start + (self._shift[k] if k >= 0 else 0)
        j = bisect_right(self._at, end - 1)
        if j < len(self._at) and self._at[j] == end and self._made[j]:
            return left, end + self._shift[j]
        return left, end + (self._shift[j - 1] if j else 0)


def _spoken_numbers() -> dict[str, str]:
    """Spoken numbers from 0 to 99 in four languages, with the figures each stands for."""
    out: dict[str, str] = {}
    plain = (
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
        "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
        "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve"
        " veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve",
    )
    en, de, fr, es = (w.split() for w in plain)
    for words in (en, de, fr, es):
        out |= {w: str(i) for i, w in enumerate(words)}
    out |= {"oh": "0", "nought": "0", "zwo": "2", "fuenf": "5", "zwoelf": "12", "une": "1", "veintidos": "22", "veintitres": "23", "dieciseis": "16", "veintiseis": "26"}
    for i, (e, d) in enumerate(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split(), strict=True), 2):
        out |= {e: f"{i}0", d: f"{i}0", d.replace("ß", "ss"): f"{i}0"}
        for k in range(1, 10):
            unit = ("ein" if k == 1 else de[k]) + "und"
            out |= {f"{e}-{en[k]}": f"{i}{k}", f"{e} {en[k]}": f"{i}{k}", unit + d: f"{i}{k}", unit + d.replace("ß", "ss"): f"{i}{k}"}
    for i, w in enumerate("treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(), 3):
        out |= {w: f"{i}0"} | {f"{w} y {es[k]}": f"{i}{k}" for k in range(1, 10)}
    for i, w, most in ((2, "vingt", 9), (3, "trente", 9), (4, "quarante", 9), (5, "cinquante", 9), (6, "soixante", 19), (8, "quatre-vingt", 19)):
        out |= {w: f"{i}0", w + "s": f"{i}0"} if i == 8 else {w: f"{i}0"}
        for k in range(1, most + 1):
            out |= {f"{w}{join}{fr[k]}": str(10 * i + k) for join in (("-", " et ", "-et-") if k in (1, 11) else ("-",) if i == 8 or k > 9 else ("-", " "))}
    return out


_SPOKEN = _spoken_numbers()
_TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
_SAID = rf"(?:(?:{'|'.join(_TIMES)})[ -]?)?(?:{'|'.join(sorted(map(re.escape, _SPOKEN), key=len, reverse=True))})(?!\w)"
_BETWEEN = r"(?:\s?[,./-]\s?|\s)"
_RUN = re.compile(rf"(?<![\w.,/+-])(?:(?:plus|más)\s|\+\s?)?(?:{_SAID}|\d+)(?:{_BETWEEN}(?:{_SAID}|\d+))+(?!\w)", re.I)
_PART = re.compile(rf"(?P<plus>plus|más|\+)|(?P<times>{'|'.join(_TIMES)})[ -]?|(?P<said>{_SAID})|(?P<figures>\d+)", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
#: Words that spoken numbers are made of as 1, and any figures as 2 (``_speaks`` reads them as 0).
_TOKENS = {w: b"\1" for n in (*_SPOKEN, *_TIMES) for w in _TOKEN.findall(n) if w not in ("et", "y")} | {"0": b"\2"}
_FIGURES = re.compile(r"\d+")


def _speaks(t: str) -> bool:
    """Whether a word of a spoken number is next to another or to figures, which holds for few texts."""
    words = _TOKEN.findall(_FIGURES.sub("0", t.lower()))
    if _TOKENS.keys().isdisjoint(words):
        return False
    row = b"".join(map(_TOKENS.get, words, repeat(b"\0")))
    return b"\1\1" in row or b"\1\2" in row or b"\2\1" in row


def _figures(run: str) -> str | None:
    """The figures of a spoken run of at least seven, three of them spoken; None for anything shorter."""
    out, spoken, times = [], 0, 1
    for m in _PART.finditer(run):
        if m["plus"]:
            out.append("+")
        elif m["times"]:
            times = _TIMES[m["times"].lower()]
        elif m["said"]:
            out.append(_SPOKEN[m["said"].lower()] * times)
            spoken += len(out[-1])
            times = 1
        else:
            out.append(m["figures"] * times)
            times = 1
    new = "".join(out)
    return new if spoken >= 3 and len(new.lstrip("+")) >= 7 else None


def spoken_to_figures(t: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """``t`` with spoken numbers as figures, and for each its (start, end) there and (start, end) in ``t``."""
    if not _speaks(t):
        return t, []
    parts, runs, done, length = [], [], 0, 0
    for m in _RUN.finditer(t):
        if (new := _figures(m.group())) is None:
            continue
        parts += [t[done : m.start()], new]
        length += m.start() - done
        runs.append((length, length + len(new), *m.span()))
        length += len(new)
        done = m.end()
    return "".join([*parts, t[done:]]), runs


def _unspoken(runs: list[tuple[int, int, int, int]], start: int, end: int) -> tuple[int, int]:
    """A span of a rewritten text in the text before; a run (its place there and before) that it touches is taken whole."""
    left, right = start, end
    for a, b, source, stop in runs:
        if a >= end:
            break
        left = source if a <= start < b else start + stop - b if start >= b else left
        right = stop if a < end <= b else end + stop - b if end > b else right
    return left, right


# Words for the at sign, each with those for the point that go with it.
_AT_WORDS = {"at": "dot|punkt|punto", "arroba": "punto|dot", "arobase": "point|dot", "arrobase": "point|dot", "ät": "punkt", "klammeraffe": "punkt"}
_AT_SIGN = re.compile(rf"\s?@\s?|\s?[\[({{<]\s?({'|'.join(_AT_WORDS)})\s?[\])}}>]\s?|\s({'|'.join(_AT_WORDS)})\s", re.I)
_BRACKETED = r"\s?[\[({<]\s?(?:dot|punto|point|punkt)\s?[\])}>]\s?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: What gives a disguised address away, in lower case; other texts are not searched.
_AT_GIVEN = ("dot", "@ ", " @", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", "arroba", "robase", "klammeraffe", "punkt")


@lru_cache(maxsize=len(_AT_WORDS) + 1)
def _disguised(word: str | None) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """For an at word (None for the sign): a domain after it, one of its points, and a point that ends a text."""
    point = rf"(?:\.|{_BRACKETED}|\s(?:{_AT_WORDS[word] if word else 'dot|punto'})\s)"
    said = point.replace(r"\.|", "")
    return re.compile(rf"{_HOST}(?:{point}{_HOST})*{point}[A-Za-z]{{2,}}(?!\w)", re.I), re.compile(said, re.I), re.compile(rf"{said}$", re.I)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.+%'-")


def _local_start(t: str, at: int) -> int:
    """Where the local part that ends before ``at`` begins; ``at`` if there is none."""
    i = at
    while i and t[i - 1] in _LOCAL:
        i -= 1
    while i < at and t[i] in ".'":
        i += 1
    return at if i and t[i - 1].isalnum() else i


def mail_to_plain(t: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """``t`` with disguised addresses in plain form, and for each its (start, end) there and (start, end) in ``t``.

    An at sign with blanks around, in brackets or as a word, a domain right after it and a local part right before. As
    a bare word it counts only where a point of the domain is bracketed or a word as well.
    """
    low = t.lower()
    if not any(g in low for g in _AT_GIVEN):
        return t, []
    parts, runs, done, length = [], [], 0, 0
    for m in _AT_SIGN.finditer(t):
        word = (m[1] or m[2] or "").lower() or None
        domain, point, ending = _disguised(word)
        if m.start() < done or not (host := domain.match(t, m.end())) or m[2] and not point.search(host.group()):
            continue
        start, pieces = m.start(), []
        while (i := _local_start(t, start)) < start:
            pieces.append(t[i:start])
            start = i
            # No sign for a point is longer than 12 characters.
            if not (dot := ending.search(t, max(done, i - 12), i)) or _local_start(t, dot.start()) == dot.start():
                break
            start = dot.start()
        if not pieces or start < done:
            continue
        new = ".".join(reversed(pieces)) + "@" + point.sub(".", host.group())
        if new == t[start : host.end()]:
            continue
        parts += [t[done:start], new]
        length += start - done
        runs.append((length, length + len(new), start, host.end()))
        length += len(new)
        done = host.end()
    return "".join([*parts, t[done:]]), runs


# --- patterns ------------------------------------------------------------------------------------------------------

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
# Words inside surnames, and words that never belong to a name although a text in capitals makes them look so.
_PARTICLE = r"(?:[Vv]on|[Vv]an|[Dd]e|[Dd]el|[Dd]ella|[Dd]i|[Dd]u|[Dd]a|[Dd]os|[Ll]a|[Ll]e|[Ll]os|[Dd]er|[Dd]en|[Tt]er|[Zz]u|[Zz]ur|[Dd]es|VON|VAN|DE|DEL|DU|LA|LE|DER|DEN)"
_NEVER = (
    r"(?:AT|WAS|WROTE|THE|AS|WHO|IN|AND|OF|ON|NAMES|HOLDS|WILL BE|IST|DOIT|DEBE|THAT|WITH|FOR|TO|BY|TEL|E-MAIL|FROM|The|This|That|A|At|In|On|No|Bids|Staff|Part|Parcel|Docket"
    r"|Substation|Energy|Grid|Wind|Solar|Power|Holdings|Partners|Renewables|Drilling|LLC|Ltd|Inc|County|Road|Street|Council|Authority|Board|Department|Commission|Company"
    r"|SUBSTATION|ENERGY|GRID|WIND|SOLAR|POWER|HOLDINGS|PARTNERS|RENEWABLES|COUNTY|ROAD|STREET)\b"
)
_CORE = rf"(?!{_NEVER})(?:(?:[OD]')?[{_U}][{_L}]+(?:[{_U}][{_L}]+)*|(?:[OD]')?(?:Mc|Mac)?[{_U}]{{2,}})"
_WORD = rf"{_CORE}(?:-\n?{_CORE})*"
_INITIAL = rf"[{_U}]\.(?:-[{_U}]\.)?"
_SURNAME = rf"(?:(?:{_PARTICLE}\s){{0,3}})(?:(?:d|D)')?{_WORD}"
_FULL = rf"(?:{_WORD}\s(?:{_INITIAL}\s)?|{_INITIAL}\s(?:{_INITIAL}\s){{0,2}}){_SURNAME}"
_LONG = rf"(?:{_WORD}|{_INITIAL})\s(?:{_INITIAL}\s){{0,3}}(?:{_WORD}\s){{0,1}}{_SURNAME}"
_NAME = re.compile(rf"\s{{0,2}}({_LONG})(?![\w])")
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Professor|Commissioner|Councillor|Councilor|Councilwoman|Councilman|Mayor|Judge|Sir|Rev|Herrn|Herr|Frau|Mme|Mlle|Me|Monsieur|Madame|Maître|Sra|Srta|Sr|Dña|Don|Doña|MRS|MR|MS|DR|PROF|HERR|FRAU|MME|SRA|SR|DÑA|COMMISSIONER)"
_AFTER_TITLE = re.compile(rf"\.?\s(?:(?:{_TITLE})\.?\s)?({_FULL}|{_SURNAME})(?![\w])")
_TITLED = re.compile(rf"\s{{0,2}}(?:{_TITLE})\b")
_TITLE_FIRST = re.compile(rf"(?:{_TITLE})\.?\s")
_LETTER = re.compile(r"[MD]\.\s")
#: Letters that are a title in the language of what follows the name; elsewhere they are initials.
_TITLE_LETTERS = {"M. ": (", domicilié", ", demeurant"), "D. ": (", con domicilio", ", vecino")}
_PLACE = re.compile(rf"{_WORD}\s(?=(?:{_FULL})$)")
_NAME_BEFORE = re.compile(rf"(?:^|(?<=[^\w.'-]))({_FULL}|{_SURNAME})$")
_ATTENDEE = re.compile(rf"\s*({_SURNAME},\s(?:{_WORD}|{_INITIAL})(?: {_INITIAL})*)(?=\s*[;–—.\n]|$)")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOMAIN = re.compile(rf"@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?!\w)")

_NUMBER = re.compile(r"(?<![\w.,/$£€#-])(?:\+\s?|\()?(?=[\d ./()-]{7})\d+(?:(?:[ ./-]|\)[ -]?| ?\(| / )\(?\d+\)?)*(?![\w])")
_NO_DIGIT = re.compile(r"\D+")
_DATE = re.compile(r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.]\d{1,2}[/.](?:\d{4}|\d{2}))$")
_NOT_PERSONAL = re.compile(
    r"(?:serial|serie|série|Zählernummer|Zähler|compteur|contador|meter|plan|parcel|docket|queue|listing|lot|part|item|turbine|schedule|stage|cluster|page|invoice|account|deposit|Aktenzeichen|dossier|expediente|Verfahren)"
    r"(?:\s(?:no|number|nr|n°|nº|num|número|numéro|bears|con))?[.:°]*\s*(?:(?:n°|no\.|nº|number|serial|serie|série)\s*)?$",
    re.I,
)
_PHONE_CUE = re.compile(r"(?:tel|tél|teléfono|telefono|Telefon|Fon|phone|mobile|mob|cell|office|fax|call|dial|ring|text|texts?\sfrom|reach\w*|Handy|portable|móvil)[.:]*\s*(?:on|at|from|no\.?|number|under|:|unter|au|al)?\s*$", re.I)
_PHONE_SHAPES = re.compile(
    r"^(?:"
    r"\+\s?\d{1,3}[ .-]?(?:\(0\)\s?)?\(?\d{1,5}\)?(?:(?:[ .-]| ?/ ?)?\d{2,}){1,5}(?:-\d{2,4})?"  # international
    r"|00\d{1,2}[ .-]?(?:\(0\)\s?)?\d{1,5}(?:(?:[ .-]| ?/ ?)?\d{2,}){1,5}(?:-\d{2,4})?"
    r"|(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"  # North America
    r"|\(0\d{2,4}\)\s?\d{2,4}(?:[ -]?\d{2,4}){1,3}"
    r"|0\d{2,4}[ /.-]\s?\d{3,8}(?:[ -]\d{2,4}){0,2}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2}(?:[ .-]\d{2}){3}|0\d{2}(?:[ .-]\d{3}){2}|0\d{8,10}"
    r")$"
)
_LOCAL_PHONE = re.compile(r"^\d{3}[ .-]\d{4}$")
_ID_CUE_NEAR = re.compile(r"(?:social security|taxpayer|insurance|passport|identity)", re.I)
_NINE = re.compile(r"^\d{9}$")
_ID_SHAPES = re.compile(r"^(?:\d{3}([ .-])\d{2}\1\d{4}|[1-4]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}\s\d{2}|[1-4]\d{14})$")
_ID_AFTER = re.compile(
    r"(?:[\s:.]|n°|no\.?|No\.?|nº|number|NUMBER|NO\.?|Nr\.?|num\.?|número|numéro|de|ist|is|lautet|:)*?\s?"
    r"((?=[A-Z0-9]*[ ./-]?\d)(?:[A-Z]{1,2}[ -]?)?\d(?:[ ./-]?\d){5,14}(?:[ -]?[A-Z](?![\w]))?(?: ?/ ?\d{2}(?!\d))?)(?!\w)"
)

# Street words, with a stop where the short form is written with one.
_STREETS_EN = "Street|Avenue|Road|Lane|Drive|Court|Terrace|Boulevard|Way|Close|Place|Circle|Crescent|Square|Parkway|Highway|Trail|Grove|Hill|Gardens|Mews|Row|Walk|Blvd|Pkwy|Hwy|Ave|St|Rd|Ln|Dr|Ct|Pl|Ter|Cir|Sq"
#: A stop that is not the sentence's: another stop, a comma, a line end or a word in the middle of a sentence follows.
_STOP_IS_OWN = re.compile(r"\.(?:[.,;\n]|\s+(?:[a-zß-ÿ(]|(?:IN|LIES|AND|TO|NEAR|AT|ON|IS|WAS)\b))")
_STOPPED = frozenset(("st", "rd", "ln", "dr", "ct", "pl", "ter", "cir", "sq"))
_BEFORE_EN = rf"(?:(?:[NSEW]|NE|NW|SE|SW)\.?\s|(?i:North|South|East|West|Old|New|Upper|Lower|Great|Little)\s){{0,3}}(?:[{_U}0-9][\w'-]*\.?\s){{1,3}}"
_ADDRESS_EN = re.compile(rf"(?<![\w.,/-])(\d{{1,5}}(?:[-/]\d{{1,4}})?\s?[A-Za-z]?\s{_BEFORE_EN}(?i:({_STREETS_EN}))\b)")
_ADDRESS_FR = re.compile(rf"(?<![\w.,/-])(\d{{1,4}}(?:\s?(?:bis|ter|quater|BIS|TER|[A-D]))?,?\s(?i:rue|avenue|av\.|chemin|boulevard|bd|place|impasse|allée|quai|cours|route|square|passage|ruelle|sentier)\s(?:(?i:de la|de l'|des|du|de|d'|la|le|les)\s?)?[{_U}][\w'-]*(?:\s(?:(?:de|du|des|la|le)\s)?[{_U}][\w'-]*)*)")
_ADDRESS_ES = re.compile(rf"((?i:Avda\.?|Avenida|Av\.|Calle|C/|C\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Cno\.|Ronda|Carretera|Ctra\.?|Travesía|Glorieta)\s?(?:(?i:de la|de los|de las|del|de)\s)?[{_U}][\w'-]*(?:\s(?:(?:de|del|la)\s)?[{_U}][\w'-]*)*,?\s(?i:n\.?\s?[ºo°]\.?\s|núm\.\s|número\s)?\d{{1,4}}(?:\s?(?:bis|[A-D]))?)(?!\w)")
_ADDRESS_DE = re.compile(rf"((?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|AM|IM|ZUM|ZUR)\s[{_U}][\w-]+|[{_U}][\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|STRASSE|STRAßE|WEG|PLATZ|GASSE|ALLEE|RING|DAMM|UFER|STEIG)|[{_U}][\w-]+\s(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer|Chaussee|STRASSE|STRAßE|WEG|PLATZ|ALLEE|RING))\s\d{{1,4}}(?:\s?[a-dA-D](?!\w))?)(?!\w)")

# --- cues ----------------------------------------------------------------------------------------------------------

# What stands before a name, what stands after one, labels of lists, labels of identity numbers, street words.
_NAME_FOLLOWS = (
    "hown by ", "taken by ", "ccording to ", "estimony of ", "he landowner ", "he owner ", "poke w/ ", "poke with ", "elongs to ", "Contact: ", "Contact : ", "Contact person: ",
    "Contacto: ", "Ansprechpartner: ", "Ansprechpartnerin: ", "Protokoll: ", "Fait par ", "Rédigé par ", "edactada por ", "igned,\n", "igned by ", "igned: ", "repared by ", "ubmitted by ",
    " names ", "be sent to ", "I, ", "ezeichnet: ", "irmado: ", "irmado por ", "igné : ", "igné par ", "ttn: ", "ttention: ", "el propietario ", "der Eigentümer ", "le propriétaire ",
    "itness ", "he applicant's agent ", "poke to ", "etter from ", "all from ",
)
_NAME_PRECEDES = (
    "'s letter of", "'s letter", ", who lives", ", who resides", ", residing at", ", resident", ", wohnhaft", ", domicilié", ", demeurant", ", con domicilio", ", vecino de", " doit être masqu",
    " ist zu schwärzen", " debe ocultarse", " conteste le trac", " se opone al", ", taxpayer number",
)
_TITLES = (
    "Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Miss ", "Dr. ", "Dr ", "Prof. ", "Prof ", "Professor ", "Commissioner ", "Councillor ", "Councilor ", "Mayor ", "Judge ", "Herr ", "Herrn ", "Frau ",
    "Mme ", "Mlle ", "Madame ", "Monsieur ", "Maître ", "Me ", "Sr. ", "Sra. ", "Srta. ", "Dña. ", "Doña ", "Don ",
)
_LISTS = ("Attendees:", "Present:", "Présents :", "Participants :", "Anwesend:", "Teilnehmer:", "Asistentes:", "Presentes:")
_IDS = (
    "SSN", "ocial security", "axpayer number", "axpayer no", "ax ID", "TIN ", "assport", "asseport", "eisepass", "asaporte", "nsurance no", "nsurance number", "DNI", "NIE ", "NIF", "Steuer-ID",
    "teuer-Identifikationsnummer", "teuernummer", "ersonalausweis", "ozialversicherungsnummer", "écurité sociale", "eguridad social", "NIR ", "dentity card", "dentity number", "carte d'identité",
)
_STREET_CUES_EN = tuple(f" {w}" for w in _STREETS_EN.split("|"))
_STREET_CUES_FR = tuple(f" {w} " for w in ("rue", "avenue", "av.", "chemin", "boulevard", "bd", "place", "impasse", "allée", "quai", "cours", "route", "square", "passage", "ruelle", "sentier"))
_STREET_CUES_ES = ("Avda", "Avenida", "Calle", "C/", "Plaza", "Paseo", "Camino", "Ronda", "Carretera", "Travesía", "Glorieta")
_STREET_CUES_DE = (
    "traße ", "trasse ", "tr. ", "weg ", "platz ", "gasse ", "allee ", "ring ", "damm ", "ufer ", "steig ", " Weg ", " Platz ", " Allee ", " Ring ", "Am ", "An der ", "Auf der ", "Im ", "In der ", "Zum ", "Zur ",
)
_MAIL_CUES = ("@",)
_PHONE_CUES = ("phone", "call", "tel.", "dial", "mobile")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    groups = (
        ("follows", _NAME_FOLLOWS), ("precedes", _NAME_PRECEDES), ("title", _TITLES), ("list", _LISTS), ("id", _IDS), ("en", _STREET_CUES_EN), ("fr", _STREET_CUES_FR), ("es", _STREET_CUES_ES),
        ("de", _STREET_CUES_DE), ("mail", _MAIL_CUES), ("spelled", _PHONE_CUES),
    )
    for kind, cues in groups:
        for cue in cues:
            for form in {cue, cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _digits(s: str) -> int:
    return len(_NO_DIGIT.sub("", s))


def _numbers(t: str) -> Iterator[tuple[str, int, int]]:
    for m in _NUMBER.finditer(t):
        start, end = m.span()
        if end - start < 7:
            continue
        s = m.group()
        if _DATE.match(s) or _digits(s) < 7:
            continue
        before = t[max(0, start - 48) : start]  # no label is longer
        if _NOT_PERSONAL.search(before):
            continue
        if _ID_SHAPES.match(s) or _NINE.match(s) and before.endswith("number ") and _ID_CUE_NEAR.search(t, end, end + 48):
            yield "id_number", start, end
        elif _PHONE_SHAPES.match(s) or (_LOCAL_PHONE.match(s) or _digits(s) <= 15) and _PHONE_CUE.search(before):
            yield "phone", start, end


def find_plain(t: str, spoken: Sequence[tuple[int, int, int, int]] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in a plain text, overlaps resolved in favour of the earlier kind of the cue order.

    ``spoken``: where figures stand for a spoken number, as ``spoken_to_figures`` gives it.
    """
    found: list[tuple[str, int, int]] = []
    far: list[tuple[str, int, int]] = []
    for last, (kind, size) in _automaton().iter(t):
        end = last + 1
        start = end - size
        if kind == "mail":
            local = _local_start(t, start)
            if local < start and (m := _DOMAIN.match(t, start)):
                found.append(("email", local, m.end()))
        elif kind == "follows":
            at = end - 1 if t[end - 1].isspace() else end
            if (m := _TITLED.match(t, at)) is None and (m := _NAME.match(t, at)):
                found.append(("name", *m.span(1)))
        elif kind == "title":
            if start and (t[start - 1].isalnum() or t[start - 1] in "'-."):
                continue
            at = end - 1
            if t[at - 1] == ".":
                at -= 1
            if m := _AFTER_TITLE.match(t, at):
                found.append(("name", *m.span(1)))
        elif kind == "precedes":
            # The longest name that ends here; a title before it is no part of it.
            for m in _names_ending(t, start):
                found.append(("name", *m))
        elif kind == "list":
            at = end
            while m := _ATTENDEE.match(t, at):
                found.append(("name", *m.span(1)))
                at = m.end()
                while at < len(t) and (t[at].isspace() or t[at] in ";–—"):
                    at += 1
        elif kind == "id":
            if m := _ID_AFTER.match(t, end):
                found.append(("id_number", *m.span(1)))
        elif kind == "en":
            if end < len(t) and (t[end].isalnum() or t[end] in "-'"):
                continue
            for m in _ADDRESS_EN.finditer(t, _back(t, start, 9), end):
                if m.end(1) == end:
                    stop = m.group(2).lower() in _STOPPED and _STOP_IS_OWN.match(t, end) is not None
                    found.append(("address", m.start(1), end + stop))
        elif kind == "fr":
            if m := _covering(_ADDRESS_FR, t, _back(t, start, 3), start):
                found.append(("address", *m))
        elif kind == "es":
            if start and t[start - 1].isalnum():
                continue
            if m := _ADDRESS_ES.match(t, start):
                found.append(("address", *m.span(1)))
        elif kind == "de":
            if m := _covering(_ADDRESS_DE, t, _back(t, start, 3), start):
                found.append(("address", *m))
        elif kind == "spelled":
            # A spoken number counts as a phone's anywhere in the line, unless a label makes it another.
            near = next(((a, b) for a, b, *_ in spoken if a >= end), None)
            if near and t.find("\n", end, near[0]) < 0 and not _NOT_PERSONAL.search(t[max(0, near[0] - 48) : near[0]]):
                far.append(("phone", *near))
    taken = {(s, e) for _, s, e in found}
    spans = sorted(taken)
    for kind, s, e in _numbers(t):
        if not any(a < e and s < b for a, b in spans[max(0, bisect_right(spans, (s, e)) - 3) : bisect_right(spans, (e, e)) + 1]):
            found.append((kind, s, e))
    found += [f for f in far if not any(s < f[2] and f[1] < e for _, s, e in found)]
    return _without_overlap(found)


def _back(t: str, at: int, words: int) -> int:
    """A position at least ``words`` words before ``at``."""
    for _ in range(words):
        at = t.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


_WORD_START = re.compile(r"(?<![\w-])\w")


def _covering(pattern: re.Pattern, t: str, lo: int, at: int) -> tuple[int, int] | None:
    """The first match from ``lo`` on that begins with a word and covers position ``at`` + 1."""
    for w in _WORD_START.finditer(t, lo, at + 2):
        if (m := pattern.match(t, w.start())) and m.end(1) > at + 1:
            return m.span(1)
    return None


def _names_ending(t: str, end: int) -> Iterator[tuple[int, int]]:
    lo = _back(t, end, 10)
    window = t[lo:end]
    if not (m := _NAME_BEFORE.search(window)):
        return
    start = lo + m.start(1)
    if t[max(0, start - 2) : start] == ", " and (place := _PLACE.match(window, m.start(1))):
        start = lo + place.end()  # a town after its street, with no stop before the name
    title = _TITLE_FIRST.match(t, start, end)
    if not title and (letter := _TITLE_LETTERS.get(t[start : start + 3])) and t.startswith(letter, end):
        title = _LETTER.match(t, start, end)
    if title:
        yield title.end(), end
    else:
        # A lone word counts only after a title.
        before = t[max(0, start - 14) : start]
        if re.search(r"\s", t[start:end]) or re.search(rf"(?:{_TITLE})\.?\s$", before):
            yield start, end


def _without_overlap(found: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Longest first within a place: a span inside or across another is dropped."""
    out: list[tuple[str, int, int]] = []
    for kind, s, e in sorted(set(found), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if out and s < out[-1][2]:
            if e - s > out[-1][2] - out[-1][1]:
                out[-1] = (kind, s, e)
            continue
        out.append((kind, s, e))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention, in code points of ``text``, in order and without overlap."""
    plain = Plain(text)
    t, mails = mail_to_plain(plain.text)
    t, spoken = spoken_to_figures(t)
    found = find_plain(t, spoken)
    for runs in (spoken, mails):
        if runs:
            found = [(kind, *_unspoken(runs, s, e)) for kind, s, e in found]
    return [(kind, *plain.source(s, e)) for kind, s, e in found]


def redact(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its placeholder, as [EMAIL]."""
    parts, done = [], 0
    for kind, s, e in spans:
        parts += [text[done:s], f"[{kind.upper()}]"]
        done = e
    return "".join([*parts, text[done:]])


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos: long): every mention in every text; null and empty texts have none.

    A map over Arrow batches without shuffle; whole texts are read, however long.
    """
    schema = f"key {dict(docs.dtypes)[key]}, kind string, start_pos long, end_pos long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for kind, s, e in find(value) if value else ():
                    at.append(i)
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "kind", "start_pos", "end_pos"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``docs`` with column ``out``: the text with typed placeholders, null where the text is null."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        return s.map(lambda v: redact(v, find(v)) if v else v)

    return docs.withColumn(out, run(F.col(text)))
