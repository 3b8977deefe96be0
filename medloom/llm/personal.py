"""Personal information in free text: finding it and replacing it by typed placeholders.

E-mail addresses, postal addresses and phone numbers have forms that patterns describe. Names and most identity numbers
don't: "Tarvaud" is a name after "Mme" and a sign after "signe de", ten digits are a patient's or a device's. They are
found by what the corpus says about a term:

1. Over all texts, every capitalised word is counted, and how often it stands in a protected position (after a title, a
   family relation, "dictated by" and the like). The pointwise mutual information of the word and the protected position
   is its disclosure in bits; a word that discloses so much that at most LEFT bits of the surprise of a protected position
   are left reveals persons, a word seen often that doesn't is harmless.
2. Positions without such a cue ("... signed the form") are counted with the words that fill them; a position that
   discloses as much about disclosing words (LEFT_POSITION) is protected too.
3. Likewise the words before numbers: a context discloses by how often numbers in it have a form that only identity
   numbers have. A number of another form is an identity number if its context discloses (LEFT_CONTEXT).
4. Every run of capitalised words is then judged: words that disclose, or stand in a protected position and are not known
   to be harmless, are names.

The decisions travel as Bloom filters, sized by the number of their members for a stated share of false ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.runtime import cut

KINDS = ("NAME", "PHONE", "EMAIL", "IDNUM", "ADDRESS")
#: Share of strangers that a filter takes for members, and bits set for each member; 38 bits a member give that share. A
#: filter ends at MOST_BITS (256 MB), which 56 million members fill; with more its share of false ones rises.
FALSE_MEMBERS, HASHES, MOST_BITS = 1e-4, 4, 1 << 31
#: Bits of a filter that one row brings to the driver.
BLOCK_BITS = 1 << 20
#: Bits of surprise about what is protected that a disclosing term leaves at most: a word about its position, a position about
#: its words, a context about its number. What a term discloses is the surprise without it, log2 of one over how often
#: anything is protected, less what it leaves.
LEFT, LEFT_POSITION, LEFT_CONTEXT = 1.75, 0.75, 3.25
#: Occurrences from which a word below that is known to be harmless.
HARMLESS_FROM = 4
#: Occurrences from which a position may be protected.
POSITION_FROM = 5
#: Letters of an ending, disclosing words that share it, and their share of all words that do.
ENDING, ENDING_FROM, ENDING_SHARE = 4, 8, 0.7

# Words before which a person is named (titles, relations, reports), in lower case.
CUE_WORDS = frozenset(
    "dr dr. pr pr. prof prof. mme mlle m. mr mr. mrs mrs. ms ms. miss nurse docteur professeur infirmier infirmière doctor professor cc contact selon patient: patiente: fille: fils: mère: père: frère: sœur: "
    "daughter: son: mother: father: brother: sister: wife: husband: kin: confiance: accompagnant(e): frère, sœur, fils, fille, mère, père, épouse, mari, brother, sister, son, daughter, mother, father, wife, husband, référent".split()
)
CUE_PAIRS = frozenset(
    "patient :|patiente :|fille :|fils :|mère :|père :|frère :|sœur :|confiance :|accompagnant(e) :|dicté par|saisi par|transmis par|rédigé par|signé par|accompagné par|accompagnée par|dictated by|entered by|reviewed by|"
    "accompanied by|signed by|written by|over by|according to|discussed with|spoke to|jour avec|vu avec|vue avec|appel de|call from|nom de|name of|key worker|soignant référent|médecin référent".split("|")
)
#: Titles that may start a run of capitalised words; the name begins after them.
TITLES = frozenset("dr pr prof mme mlle m mr mrs ms miss nurse docteur professeur doctor professor selon contact cc".split())
PARTICLES = frozenset("de la le les du des d l van der den von o".split())

_UP, _LOW = "A-ZÀ-ÖØ-ÞŒ", "a-zß-öø-ÿœ"
_WORD = rf"(?:[OoDdLl]['’])?[{_UP}](?:['’]?[{_UP}{_LOW}]+)+"
_UNIT = rf"(?:{_WORD}(?:-{_WORD})*|[{_UP}]\.(?:-[{_UP}]\.)*)"
_B = r"[ \u00a0\u202f]"
_GLUE = rf"(?:(?:de{_B}la|de|du|des|van{_B}der|van|von|le){_B}|d['’])"
#: A run of capitalised words, initials and particles, with one more word after a comma.
RUN = re.compile(rf"(?<![\w@.+'’-]){_UNIT}(?:{_B}{_GLUE}?{_UNIT})*(?:,{_B}{_WORD}(?:-{_WORD})*)?(?![\w@+]|\.\w)")
_PIECES = re.compile(rf"[{_UP}{_LOW}]+(?:['’][{_UP}{_LOW}]+)?\.?")
_LEAD = re.compile(rf"(?:{_GLUE})+$")
_START = re.compile(r"(?:^|[.!?;:)»>]\s+|\n\s*(?:[-•*]\s*)?)$")
_AHEAD = re.compile(r"\s*([^\W\d_]+['’]?|\d+|[^\w\s])(?:\s*([^\W\d_]+['’]?|\d+|[^\w\s]))?")

_SEP = r"[ .\-  ]?"
PHONE = re.compile(
    rf"(?<![\w+.(\-])(?:(?:\+|00)33{_SEP}(?:\(0\){_SEP})?[1-9](?:{_SEP}\d\d){{4}}|0[1-9](?:{_SEP}\d\d){{4}}|0[1-9]\d\d[ .\- ]\d{{3}}[ .\- ]\d{{3}}|(?:\+|00)44{_SEP}(?:\(0\){_SEP})?\d{{2,4}}{_SEP}\d{{3,4}}{_SEP}\d{{3,4}}|07\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}"
    r"|(?:\+?1[ .\-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{4})(?![\w]|[.\-]\d)"
)
_BRACKETED = re.compile(rf"\((?:(?:\+|00)\d|0\d)")
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*\w)?(?: ?(?:@|\[at\]|\(at\)) ?| (?:at|arobase) )[A-Za-z0-9][\w-]*(?:(?:\.| (?:dot|point) )[A-Za-z0-9][\w-]*)+(?![\w@])", re.A)
_N = r"[ .\-  ]?"
_NIR = rf"[12]{_N}\d\d{_N}(?:0[1-9]|1[0-2]|[2-9]\d){_N}\d[\dAB]{_N}\d{{3}}{_N}\d{{3}}(?:{_N}(?:clé{_N})?\d\d)?"
#: Forms that are an identity number wherever they stand.
SURE_ID = re.compile(rf"(?<![\w.+\-])(?:{_NIR}|[A-Z]-\d{{3}}-\d{{5}}|[A-Z]{{2}} \d\d \d\d \d\d [A-Z]|\d{{3}}-\d\d-\d{{4}})(?![\w]|[.\-]\d)")
#: Forms that are one after words that say so.
CUED_ID = re.compile(
    rf"(?<![\w.+\-])(?:{_NIR}|[A-Z]{{1,2}}[ \-]?\d{{6,9}}|[A-Z]{{2}} \d\d \d\d \d\d [A-Z]|[A-Z]-\d{{3}}-\d{{5}}|\d\d[A-Z]{{2}}\d{{5}}|\d{{3}}[ \-]\d{{2,3}}[ \-]\d{{4}}|\d{{8,15}})(?![\w]|[.\-]\d)"
)
_SAYS_ID = re.compile(
    r"(?:\b(?:IPP|NIR|NHS|SSN|MRN|INS|[Pp]asseport|[Pp]assport|identité|sécurité sociale|[Aa]ssurée?|[Ii]mmatriculation|[Rr]elevés sous|[Rr]egistered under|[Cc]hecked against|[Ii]dentité vérifiée|"
    r"(?:[Ii]nsurance|[Hh]ealth|[Hh]ospital|[Pp]atient|[Nn]ational|[Ii]dentity|[Ss]ecurity|[Mm]ember|pt|NHS)\s+(?:[Nn]umber|[Nn]umbers|[Nn]o\.?|ID|card))|[Nn]°\s*(?:de )?(?:patient|sécurité sociale|assurée?|dossier|passeport))"
    r"\s*(?:n°|no\.?|:|=|#)?\s*$"
)
_TOWN = rf"[{_UP}][\w'’]*(?:-[\w'’]+)*"
STREETS_FR = "|".join(f"[{s[0].upper()}{s[0]}]{s[1:]}" for s in r"rue avenue av\. boulevard bd\.? chemin allée impasse place quai route cours square passage sentier ruelle faubourg".split())
STREETS_EN = "[Ss]treet|[Rr]oad|[Ll]ane|[Cc]lose|[Aa]venue|[Aa]ve|[Dd]rive|Court|Place|Way|Terrace|Crescent|Square|Gardens|[Ss]t|[Rr]d|[Ll]n|Dr"
_FR = (
    rf"(?<![\w.,/])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-F])\b)?,? (?:{STREETS_FR})\s(?:de la |de l['’]|des |du |de |d['’])?(?:(?:le|la|les) )?[{_UP}][\w'’-]*(?: (?:[{_UP}][\w'’-]+|(?:de|du|des|la|le)(?= [{_UP}])))*"
    rf"(?:(?:,| -)?\s\d{{5}} {_TOWN}(?: (?:sur|sous|lès|les|la|le|en) {_TOWN})?(?: (?:Cedex|CEDEX)(?: \d+)?)?|,? à {_TOWN}|, {_TOWN}(?=[.\s,;)]))?"
)
ADDRESS_FR = re.compile(_FR)
#: What may stand before number and street and belongs to the address.
BUILDING_FR = re.compile(r"(?:[Rr]ésidence|[Bb]âtiment|[Ii]mmeuble|[Aa]ppartement|[Aa]ppt\.?)[^,\n.]{1,40},(?: ?(?:bât\.|bâtiment|esc\.|appt\.?|étage) ?\w+,)* ?$")
BUILDING_EN = re.compile(r"\b(?:Apt|Apartment|Flat|Unit|Suite) \w+, $")
ADDRESS_EN = re.compile(
    rf"(?<![\w.,/])\d{{1,4}}[A-D]? [{_UP}][\w'’]+(?: [{_UP}][\w'’]+)* ?\b(?:{STREETS_EN})\b\.?(?:(?<=\.)(?=,)|(?<!\.))"
    rf"(?:, {_TOWN}(?:,? (?:[A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}|[A-Z]{{2}} \d{{5}}))?)?"
)
#: Where either may begin: one pass over the text instead of two.
_HOUSE = re.compile(r"[0-9](?<![\w.,/][0-9])[0-9]{0,3}(?=[ ,A-F])")


def patterned(text: str, identifies=None) -> list[tuple[int, int, str]]:
    """Spans of everything but names, without overlaps; the earlier kind in the order below wins.

    ``identifies`` says of a text and a place whether an identity number is expected there; by default words that say so."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            found.append((start, end, kind))

    if "@" in text or "at" in text or "arobase" in text:
        if "@" in text or "[at]" in text or "(at)" in text or " dot " in text or " point " in text:
            for m in EMAIL.finditer(text):
                if "@" in m[0] or "[at]" in m[0] or "(at)" in m[0] or " dot " in m[0] or " point " in m[0]:
                    add(m.start(), m.end(), "EMAIL")
    houses = [m.start() for m in _HOUSE.finditer(text)]
    for pattern, building in ((ADDRESS_FR, BUILDING_FR), (ADDRESS_EN, BUILDING_EN)) if houses else ():
        upto = 0
        for start in houses:
            if start < upto or not (m := pattern.match(text, start)):
                continue
            upto = m.end()
            before = building.search(text[max(0, start - 80) : start])
            add(start - len(before[0]) if before else start, m.end(), "ADDRESS")
    if "clé" in text or _LONG.search(text):
        for m in CUED_ID.finditer(text):
            if (identifies or says_identity)(text, m.start()):
                add(m.start(), m.end(), "IDNUM")
        for m in PHONE_ANY.finditer(text):
            add(m.start(), m.end(), "PHONE")
        for m in SURE_ID.finditer(text):
            add(m.start(), m.end(), "IDNUM")
    return found


#: A phone number, or one in brackets, of which only its own brackets belong to it.
PHONE_ANY = re.compile(PHONE.pattern.replace(r"(?<![\w+.(\-])", r"(?<![\w+.\-])", 1))
#: Six digits close to each other, the fewest that a number of the forms above has: texts without have none.
_LONG = re.compile(r"[0-9](?:[ .()\-  A-Z]{0,3}[0-9]){5}")


def says_identity(text: str, at: int) -> bool:
    """Whether words before a number say that it identifies a person."""
    return bool(_SAYS_ID.search(text[max(0, at - 40) : at]))


#: Before a context in the sets that words and contexts share.
_CONTEXT = "\x01"


def contexts(text: str, at: int) -> tuple[str, str]:
    """The two words before a number, and the last of them, as members of the sets."""
    words = [w.lower() for w in _LETTERS.findall(text[max(0, at - 40) : at])[-2:]]
    return _CONTEXT + " ".join(words), _CONTEXT + (words[-1] if words else "")


_LETTERS = re.compile(r"[^\W\d_]+")


def filter_bits(members: int) -> int:
    """Bits of a filter: a power of two with at least 38 for each member, at least 2^20, at most MOST_BITS."""
    each = -HASHES / math.log(1 - FALSE_MEMBERS ** (1 / HASHES))
    return min(MOST_BITS, max(BLOCK_BITS, 1 << math.ceil(math.log2(max(1, members) * each))))


def _places(word: str, bits: int) -> list[int]:
    h = hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class BitSet(dict):
    """A Bloom filter in bytes; as a dict it remembers the answers of one worker."""

    def __init__(self, filled: bytes):
        super().__init__()
        self.filled, self.bits = filled, len(filled) * 8

    def __missing__(self, key: str) -> bool:
        yes = all(self.filled[at >> 3] >> (at & 7) & 1 for at in _places(key, self.bits))
        if len(self) < 400_000:
            self[key] = yes
        return yes


class _SmallWords(dict):
    """Whether a stretch without white space is a disclosing word in small letters; remembers the stretches it has met."""

    def __init__(self, disclosing):
        super().__init__()
        self.disclosing = disclosing

    def __missing__(self, chunk: str) -> bool:
        yes = chunk[0].islower() and len(chunk) > 2 and self.disclosing[chunk.strip(".,;:()<>").replace("’", "'")]
        if len(self) < 300_000:
            self[chunk] = yes
        return yes


def _ahead(text: str, at: int) -> str:
    """The two words or signs after a run, numbers alike."""
    m = _AHEAD.match(text, at)
    if not m:
        return "$"
    return " ".join("0" if w[0].isdigit() else w.lower() for w in m.groups() if w)


def _cued(text: str, start: int) -> bool:
    """Whether the words before a run say that a person follows."""
    before = text[max(0, start - 32) : start]
    if before[-1:] in (" ", "\u00a0", "\u202f"):
        words = before.lower().split()[-2:]
        return bool(words) and (words[-1] in CUE_WORDS or " ".join(words) in CUE_PAIRS)
    return False


class Run:
    """A part of a run of capitalised words that a title doesn't interrupt."""

    __slots__ = ("start", "end", "cued", "opens", "tokens", "title")

    def __init__(self, start: int, end: int, cued: bool, opens: bool, tokens: list[tuple[int, int, str]], title: bool = False):
        self.start, self.end, self.cued, self.opens, self.tokens, self.title = start, end, cued, opens, tokens, title


def runs(text: str) -> list[Run]:
    """Runs of capitalised words, cut at titles, with where they stand."""
    out = []
    for m in RUN.finditer(text):
        start, end = m.span()
        tokens = [(start + p.start(), start + p.end(), p[0].lower().replace("’", "'")) for p in _PIECES.finditer(m[0])]
        if len(tokens) == 1 and tokens[0][2].rstrip(".") in TITLES:
            continue
        lead = _LEAD.search(text, max(0, start - 12), start)
        begin = lead.start() if lead and _cued(text, lead.start()) else start
        cued = begin != start or _cued(text, start)
        opens = bool(_START.search(text, max(0, start - 6), start))
        part: list[tuple[int, int, str]] = []
        title = False
        for token in tokens:
            word = token[2].rstrip(".")
            # after another cue "M." is an initial, and so it is within a name
            if word in TITLES and (len(word) > 1 or (not part and opens and not cued)):
                if part:
                    out.append(Run(begin, part[-1][1], cued, opens, part, title))
                part, cued, opens, title = [], True, False, word == "m"
                begin = -1
                continue
            if part and f"{part[-1][2]} {token[2]}" in CUE_PAIRS:
                part, cued, opens, title, begin = [], True, False, False, -1
                continue
            if begin < 0:
                begin = token[0]
            part.append(token)
        if part:
            out.append(Run(begin, end, cued, opens, part, title))
    return out


def _bare(token: str) -> str:
    return token[2:] if token[1:2] == "'" else token.rstrip(".")


def count_words(texts) -> tuple[Counter, Counter, Counter]:
    """Occurrences of each capitalised word and of each context of a number, those in protected positions or of numbers of a
    sure form, and (position, word) of the runs that open a sentence without a cue."""
    all_, protected, positions = Counter(), Counter(), Counter()
    for text in texts:
        for run in runs(text):
            for _, _, token in run.tokens:
                word = _bare(token)
                if len(word) > 1:
                    all_[word] += 1
                    if run.cued:
                        protected[word] += 1
            if run.opens and not run.cued:
                ahead = _ahead(text, run.end)
                for _, _, token in run.tokens:
                    if len(word := _bare(token)) > 1:
                        positions[(ahead, word)] += 1
        if "clé" in text or _LONG.search(text):
            for m in CUED_ID.finditer(text):
                sure = SURE_ID.fullmatch(m[0]) is not None or says_identity(text, m.start())
                for context in set(contexts(text, m.start())):
                    all_[context] += 1
                    protected[context] += sure
    return all_, protected, positions


class Judge:
    """Decides about runs with the three sets: disclosing words, harmless words, protected positions."""

    def __init__(self, disclosing: BitSet, harmless: BitSet, positions: BitSet):
        self.disclosing, self.harmless, self.positions = disclosing, harmless, positions
        self.small = _SmallWords(disclosing)

    def identifies(self, text: str, at: int) -> bool:
        """Whether the words before a number disclose: both of them, or where they are rare the last."""
        two, one = contexts(text, at)
        return self.disclosing[two] or (not self.harmless[two] and self.disclosing[one])

    def names(self, text: str) -> list[tuple[int, int]]:
        """Spans of names."""
        out = []
        for run in runs(text):
            kept = self._judged(text, run)
            if kept:
                out.append(kept)
        if any(map(self.small.__getitem__, text.split())):
            out += self._lower(text, out)
        return out

    def _judged(self, text: str, run: Run) -> tuple[int, int] | None:
        end, strong, comma = run.start, 0, False
        first = None
        tokens = run.tokens
        for i, (a, b, token) in enumerate(tokens):
            word = _bare(token)
            if i and text[tokens[i - 1][1] : a][:1] == "," and not self.disclosing[word]:
                break
            if len(word) == 1:
                # an initial is kept between or before the words of a name
                if not any(len(_bare(t[2])) > 1 and not self.harmless[_bare(t[2])] for t in tokens[i + 1 :]) and strong == 0:
                    break
                if token.endswith(".") and i + 1 < len(tokens) and not self.harmless[_bare(tokens[i + 1][2])]:
                    first = a if first is None else first
                continue
            if self.disclosing[word]:
                strong += 1
            elif word in PARTICLES and (after := next((_bare(t[2]) for t in tokens[i + 1 :] if _bare(t[2]) not in PARTICLES), None)) and (self.disclosing[after] or not self.harmless[after]):
                first = a if first is None else first
                continue
            elif strong and end == a - 1 and text[end] == "-":
                pass
            elif self.harmless[word]:
                if strong or first is None and run.cued:
                    break
                if not strong:
                    first = None
                    continue
                break
            first = a if first is None else first
            end = b
        if first is None or end <= first:
            return None
        ahead = _ahead(text, end)
        if not (strong or run.cued or (run.opens and self.positions[ahead])):
            return None
        start = run.start if first == tokens[0][0] else first
        if run.title and self.positions[ahead] and text[max(0, start - 3) : start] == "M. ":
            start -= 3
        if not run.cued and not run.opens and strong and text[max(0, start - 1) : start] == "-":
            return None
        return start, end

    def _lower(self, text: str, have: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Names written in small letters: two or more disclosing words in a row, or one after a cue or before a protected
        position at the start of a sentence."""
        out = []
        for m in _SMALL.finditer(text):
            words = [(w.start(), w.end(), w[0].replace("’", "'")) for w in _SMALL_WORD.finditer(text, m.start(), m.end())]
            i = 0
            while i < len(words):
                if not self._known(words[i][2], _cued(text, words[i][0])):
                    i += 1
                    continue
                j, n, last = i, 0, i
                while j < len(words):
                    if self._known(words[j][2], True):
                        n, last = n + 1, j
                    elif words[j][2] not in PARTICLES and not re.fullmatch(r"[a-zé]\.?", words[j][2]):
                        break
                    j += 1
                begin, end = words[i][0], words[last][1]
                while i and words[i - 1][2] in PARTICLES and not _cued(text, begin):
                    i -= 1
                    begin = words[i][0]
                if text[end : end + 2] == ", " and (m2 := _SMALL_WORD.match(text, end + 2)) and self._known(m2[0], True):
                    end, n = m2.end(), n + 1
                opens = bool(_START.search(text, max(0, begin - 6), begin))
                if n > 1 or _cued(text, begin) or (opens and self.positions[_ahead(text, end)]):
                    if all(end <= a or begin >= b for a, b in have + out):
                        out.append((begin, end))
                i = last + 1
        return out

    def _known(self, word: str, after: bool = False) -> bool:
        """Whether a word in small letters discloses; one after a name or a cue also by its ending."""
        if after:
            return any(self.disclosing[w] or (len(w) > ENDING + 1 and self.disclosing["~" + w[-ENDING:]]) for w in map(_bare, word.split("-")))
        return len(word) > 2 and all(self.disclosing[_bare(p)] for p in word.split("-"))


_SMALL_WORD = re.compile(rf"[{_LOW}]+(?:['’-][{_LOW}]+)*\.?")
_SMALL = re.compile(rf"(?<![\w@.+'’-])[{_LOW}]+(?:['’-][{_LOW}]+)*\.?(?: [{_LOW}]+(?:['’-][{_LOW}]+)*(?![\w@]))*")


def items(text: str, judge: Judge) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every personal item, in order, without overlaps. Names inside other items are no items."""
    found = patterned(text, judge.identifies)
    spans = [(a, b) for a, b, _ in found]
    for start, end in judge.names(text):
        if all(end <= a or start >= b for a, b in spans):
            found.append((start, end, "NAME"))
            spans.append((start, end))
        else:
            # a run may reach into an address or number that follows it without a sign between
            for a, b in spans:
                if start < a < end and (cut_text := text[start:a].rstrip(" ,<(")):
                    found.append((start, start + len(cut_text), "NAME"))
                    break
    return sorted(found)


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each item replaced by its kind in square brackets."""
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def threshold(base: float, left: float) -> float:
    """Bits from which a term discloses, where anything is protected with probability ``base``."""
    return -math.log2(base) - left


def _shares(words: DataFrame) -> tuple[float, float]:
    """How often any word is protected, and any number a sure one."""
    rows = words.groupBy(F.col("word").startswith(_CONTEXT).alias("context")).agg(F.sum("n").alias("n"), F.sum("n_protected").alias("p")).collect()
    found = {r["context"]: (r["p"] + 1.0) / (r["n"] + 1.0) for r in rows}
    return found.get(False, 1.0), found.get(True, 1.0)


def disclosure(texts: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """(word, n, n_protected, disclosure in bits) of every capitalised word and every context of a number (after a control
    character), (position, word, n) of open positions, and how often any word and any number is protected.

    In: one column, text. Counts are of all texts; each task sends one row for each term or position it met.
    """

    def run(batches):
        total = [Counter(), Counter(), Counter()]

        def rows():
            words, protected, positions = total
            keys = list(words) + [f"{p}" for p, _ in positions]
            second = [None] * len(words) + [w for _, w in positions]
            n = [*words.values(), *positions.values()]
            p = [protected[w] for w in words] + [0] * len(positions)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(second, pa.string()), pa.array(n, pa.int64()), pa.array(p, pa.int64())], names=["key", "word", "n", "p"])

        for batch in batches:
            for sum_, more in zip(total, count_words(t for t in batch.column(0).to_pylist() if t)):
                sum_.update(more)
            if len(total[0]) + len(total[2]) > 300_000:
                yield rows()
                total = [Counter(), Counter(), Counter()]
        yield rows()

    counts = cut(texts.select("text").filter("text is not null").mapInArrow(run, "key string, word string, n bigint, p bigint"))
    words = cut(counts.filter("word is null").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n"), F.sum("p").alias("n_protected")))
    base = _shares(words)
    chance = F.when(F.col("word").startswith(_CONTEXT), base[1]).otherwise(base[0])
    words = words.withColumn("disclosure", F.log2((F.col("n_protected") + 0.01) / F.col("n") / chance))
    positions = counts.filter("word is not null").groupBy(F.col("key").alias("position"), "word").agg(F.sum("n").alias("n"))
    return words, positions, base


def _bit_set(members: DataFrame) -> bytes:
    """The filter of a one-column table of strings. Blocks of it are made where their members are; the driver receives the
    blocks only, MOST_BITS at most."""
    bits = filter_bits(members.count())
    blocks = -(-bits // BLOCK_BITS)

    def run(batches):
        for batch in batches:
            at = np.array([x for key in batch.column(0).to_pylist() for x in _places(key, bits)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK_BITS).astype(np.int32)), pa.array((at % BLOCK_BITS).astype(np.int32))], names=["block", "at"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(BLOCK_BITS, bool)
        block[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"block": pdf["block"][:1], "filled": [np.packbits(block, bitorder="little").tobytes()]})

    rows = members.mapInArrow(run, "block int, at int").groupBy("block").applyInPandas(fill, "block int, filled binary").toPandas()
    made = dict(zip(rows["block"], rows["filled"]))
    empty = bytes(BLOCK_BITS // 8)
    return b"".join(bytes(made.get(i, empty)) for i in range(blocks))


def learn(texts: DataFrame) -> tuple[bytes, bytes, bytes]:
    """The sets of disclosing terms (words, endings, contexts of numbers), harmless ones and protected positions of a corpus.

    Positions are learned from the words that titles and the like reveal; then words are counted again with these
    positions, and endings that many disclosing words and hardly any other words share disclose too.
    """
    words, positions, base = disclosure(texts)
    context = F.col("word").startswith(_CONTEXT)
    bits = F.log2((F.col("n_protected") + 0.01) / F.col("n") / F.when(context, base[1]).otherwise(base[0]))
    discloses = (bits >= F.when(context, threshold(base[1], LEFT_CONTEXT)).otherwise(threshold(base[0], LEFT))).alias("discloses")
    filled = cut(positions.join(words.select("word", discloses), "word").groupBy("position").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("discloses").cast("int")).alias("k")))
    k, n = filled.agg(F.sum("k"), F.sum("n")).first()
    chance = ((k or 0) + 1.0) / ((n or 0) + 1.0)
    found = F.log2(F.col("k") / F.col("n") / chance) >= threshold(chance, LEFT_POSITION)
    protected = cut(filled.filter((F.col("n") >= POSITION_FROM) & (F.col("k") > 0) & found).select("position"))
    more = positions.join(protected, "position").groupBy("word").agg(F.sum("n").alias("more"))
    words = words.join(more, "word", "left").withColumn("n_protected", F.col("n_protected") + F.coalesce("more", F.lit(0)))
    words = cut(words.select("word", "n", discloses))
    endings = words.filter(~context & (F.length("word") > ENDING + 1)).groupBy(F.concat(F.lit("~"), F.substring("word", -ENDING, ENDING)).alias("word"))
    endings = endings.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("discloses").cast("int")).alias("k")).filter((F.col("k") >= ENDING_FROM) & (F.col("k") >= ENDING_SHARE * F.col("n")))
    return (
        _bit_set(words.filter("discloses").select("word").unionByName(endings.select("word"))),
        _bit_set(words.filter(~F.col("discloses") & (F.col("n") >= HARMLESS_FROM)).select("word")),
        _bit_set(protected),
    )


def _per_text(rows: DataFrame, sets: tuple[bytes, bytes, bytes], schema: str, each) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tuple(sets))

    def run(batches):
        judge = Judge(*map(BitSet, shared.value))
        for batch in batches:
            yield each(batch, judge)

    return rows.mapInArrow(run, schema)


def find_personal(rows: DataFrame, sets) -> DataFrame:
    """(tbl, row_key, kind, found_text), each distinct item of a row once, of rows (tbl, row_key, text).

    Null, empty and blank texts have no items; rows with the same tbl and row_key count as one.
    """

    def each(batch, judge):
        columns: list[list] = [[], [], [], []]
        for tbl, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for kind, item in {(kind, text[a:b]) for a, b, kind in items(text, judge)} if text else ():
                for column, x in zip(columns, (tbl, key, kind, item)):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["tbl", "row_key", "kind", "found_text"])

    found = _per_text(rows.select("tbl", "row_key", "text").filter("text is not null"), sets, "tbl string, row_key string, kind string, found_text string", each)
    return found.distinct()


def sanitise(rows: DataFrame, sets) -> DataFrame:
    """(tbl, row_key, text) with every personal item replaced by its placeholder; null texts stay null."""

    def each(batch, judge):
        texts = [t if not t else replaced(t, items(t, judge)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["tbl", "row_key", "text"])

    return _per_text(rows.select("tbl", "row_key", "text"), sets, "tbl string, row_key string, text string", each)
