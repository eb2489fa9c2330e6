"""Sentence units of texts in any script.

Boundaries follow the sentence-break rules over character properties (Sentence_Break values of Unicode: sentence
terminators of all scripts, ambiguous terminators, closing marks, lower case), with these refinements:

* lines: blank lines and stand-alone lines (headings, list entries, lines of tags) are units. A line break inside a
  running sentence is a blank: it is recognised by greedy filling, the next word would not have fitted the width of the text.
* abbreviations of the languages of the passage: titles, written with a capital, do not end a sentence, words like
  approx. never do, reference words (vol., no., fig.) do not before digits, and words like etc. or Inc. end one where
  a capital follows. The languages are those whose script or function words the passage holds; where it has none, the
  language the record states.
* quotations and brackets: nothing inside a closed pair ends the sentence around it; after a closed quotation the
  sentence goes on where a verb of saying, a particle or a small letter follows.
* Thai: a blank between two Thai letters separates sentences.
* texts whose sentences start with small letters are cut at ambiguous terminators before small letters too.

A text is read once: terminators and opening marks are found by plain character classes, and what stands around them is
looked at in place, so that the time is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviated titles in front of a name, by language; fixed lists of common usage. They count where written with a capital.
TITLES = {
    "en": "mr mrs ms dr prof st rev gen sen rep gov capt cpt cmdr adm maj lt col sgt cpl pvt hon pres supt mt ft messrs",
    "de": "dr prof hr fr frl st ing mag dipl",
    "es": "sr sra srta sres dr dra d dña ud uds prof gral lic ing sto sta",
    "fr": "m mm mme mmes mlle mlles dr pr me mgr st ste",
    "pt": "sr sra srta dr dra d prof profa eng gen sto sta",
    "ru": "г-н г-жа д-р",
}
#: Abbreviations that never end a sentence.
GOING_ON = {
    "en": "vs cf approx e.g i.e viz dept est incl resp ca",
    "de": "ca bzw vgl z.b u.a d.h z.t i.d.r evtl ggf sog str inkl zzgl geb bspw",
    "es": "aprox p.ej ej av ee avda",
    "fr": "env p.ex ex av c.-à-d cf",
    "pt": "aprox p.ex ex av",
    "ru": "г гг гл ок т т.е т.к т.н т.д т.п им ул стр рис см ср напр акад проф д-р св н.э",
    "hi": "डॉ श्री श्रीमती पं प्रो सु",
    "ar": "د أ م ص ج ت هـ",
}
#: Abbreviations that do not end a sentence before a number.
REFERENCES = {
    "en": "no nos fig figs vol vols p pp ch chap ep eps rev art sec sect ver pt pts op ed",
    "de": "nr bd bde abb kap s abs art",
    "es": "cap caps pág págs núm n.º vol fig art p",
    "fr": "chap p pp vol no n° fig art",
    "pt": "cap caps pág págs nº n.º vol fig art p",
    "ru": "гл стр рис п с № т ч",
}
#: Abbreviations that may end a sentence: they do before a capital letter.
EITHER = {
    "en": "etc inc co corp ltd jr al a.m p.m bros u.s u.k esq",
    "de": "usw etc gmbh jr u.ä o.ä",
    "es": "etc s.a ee.uu",
    "fr": "etc cie",
    "pt": "etc ltda s.a",
    "ru": "др пр т.п т.д",
}
#: In texts whose sentences start with small letters only these of EITHER end a sentence.
EITHER_ENDS_SMALL = frozenset("inc corp ltd al gmbh".split())
#: Frequent function words that tell the languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is it was for on that with as at by this be are from or an he she his her has had its not",
    "de": "der die das und ist nicht ein eine zu den mit auf für im von dem wurde hat sich als auch nach bei aus am vom zum zur",
    "es": "el la los las de y una por con del en es se lo su al un está más pero fue",
    "fr": "le les la de des et est une dans sur du au pas qui ne ce il elle avec pour par",
    "pt": "o os as de e em um uma por para com não na no do da são se ao foi mais",
}


def _sets(lists: dict[str, str]) -> dict[str, frozenset[str]]:
    return {lang: frozenset(words.split()) for lang, words in lists.items()}


_TITLES, _GOING, _REFERENCES, _EITHER = map(_sets, (TITLES, GOING_ON, REFERENCES, EITHER))
_LISTED = frozenset().union(*_TITLES.values(), *_GOING.values(), *_REFERENCES.values(), *_EITHER.values())
_LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGES_OF.setdefault(_w, []).append(_lang)
_ALL = frozenset(_TITLES) | frozenset(_GOING)
#: No abbreviation is longer than this; more letters in front of a terminator are not looked at.
LONGEST = 24
#: Characters on either side of an abbreviation whose function words count by themselves, as a block may mix languages.
AROUND = 48

#: Verbs of saying and their forms after a quotation; fixed lists of common usage.
SAYING = (
    "said|says|say|asked|asks|replied|replies|answered|answers|shouted|shouts|cried|cries|called|calls|whispered|whispers|muttered|mutters|murmured|added|adds"
    "|exclaimed|exclaims|wrote|writes|yelled|yells|screamed|remarked|remarks|insisted|explained|explains|continued|told|warned|begged|demanded|noted|sighed|repeated|announced"
    "|sagte|sagt|fragte|fragt|rief|ruft|antwortete|antwortet|erwiderte|flüsterte|schrie|meinte|murmelte|erklärte"
    "|dijo|dice|preguntó|pregunta|gritó|grita|respondió|responde|contestó|exclamó|susurró|añadió|murmuró"
    "|dit|demanda|demande|cria|crie|répondit|répond|murmura|ajouta|chuchota|s'écria|s’écria"
    "|disse|diz|perguntou|pergunta|gritou|grita|respondeu|responde|sussurrou|exclamou|acrescentou|murmurou"
    "|сказала?|говорит|спросила?|спрашивает|крикнула?|кричит|ответила?|отвечает|прошептала?|воскликнула?|добавила?|закричала?"
    "|قال|قالت|سأل|سألت|صاح|صاحت|أجاب|أجابت|همس|همست|هتف|هتفت|أضاف|أضافت|ने (?:कहा|पूछा|चिल्लाया|बताया|जवाब)"
)
_SPEAKER = regex.compile(rf"\s*[—–-]?\s*(?:(?:{SAYING})\b|(?:[\p{{L}}\p{{M}}'’-]++[ \n]++){{1,3}}?(?:{SAYING})\b)")
_SPEAKER_ZH = regex.compile(r"[^。！？\n“”]*?(?:喊道|说道|问道|答道|叫道|说：|喊：)")
_GOES_ON_JA = re.compile(r"\s*(?:と|という|って|は|が|を|に|の|も|で|や|など|、|，|,)")
_GOES_ON_KO = re.compile(r"(?:라고|이라고|고|라며|라는|는|은|이|가|을|를|와|과|의|에)")
#: Words by which a sentence goes on behind a quotation, and verbs that do so unless they begin a question.
_LINKS = re.compile(r"\s*(?:and|or|that|which|who)\b")
_VERBS = re.compile(r"\s*(?:is|are|was|were|has|have|had|does|did)\b")
_NEXT_END = re.compile(r"[.!?]+(?=\s|$)")

_SPACE = r"[ \t   -   　]"
_CLOSERS = r"""["'”’»›」』】》〉）\)\]\}＂］｝]"""
_CLOSER_SET = frozenset("\"'”’»›」』】》〉）)]}＂］｝")
_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
#: Sentence and ambiguous terminators of all scripts, from the character properties.
_STERM = frozenset(regex.findall(r"\p{SB=STerm}", _EVERY))
_ATERM = frozenset(regex.findall(r"\p{SB=ATerm}", _EVERY))
del _EVERY
_TERMINATORS = "".join(re.escape(c) for c in sorted(_STERM | _ATERM))
_TERMINAL = re.compile(f"[{_TERMINATORS}]")
_RUN = regex.compile(rf"(?:[{_TERMINATORS}](?:{_SPACE}?[!?](?=[\s!?»]|$))*)+(?:[{_TERMINATORS}]|\p{{M}}|[️‍])*")
_CLOSING = re.compile(rf"(?:{_SPACE}?[»›]|{_CLOSERS})*")
_OPENER = re.compile(r"""[“„«「『《〈【"(（\[`]""")
_PAIR = regex.compile(
    r"""“[^“”\n]*+(?:\n(?!\n)[^“”\n]*+)*+”|„[^„“”]*+[“”]|«[^«»]*+»|「(?:[^「」]|「[^「」]*+」)*+」|『[^『』]*+』|《[^《》]*+》|〈[^〈〉]*+〉|【[^【】]*+】"""
    r"""|(?<![^\s(\[{—–-])"[^"\n]*+(?:\n(?!\n)[^"\n]*+)*+"(?!\w(?<![\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}])[\p{Ll}\p{Nd}])|\([^()\n]*+(?:\n(?!\n)[^()\n]*+)?+\)|（[^（）]*+）|\[[^\[\]\n]*+\]|`[^`\n]*+(?:\n(?!\n)[^`\n]*+)?+`"""
)
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_BULLET = re.compile(rf"{_SPACE}*(?:[-*+•·‣◦▪–—]{_SPACE}+|[・●○◆■□])")
_NUMBERED = re.compile(rf"{_SPACE}*(?:\(?\d{{1,3}}[.)]|\(?[a-zA-Z][)]|[①-⑳]){_SPACE}+\S")
_TAGS = regex.compile(rf"{_SPACE}*+(?=[^\W_]*+_)\w++(?:,{_SPACE}++[\w-]++)++{_SPACE}*+$|{_SPACE}*+[\w-]++(?:,{_SPACE}++(?=(?:[^\W_]|-)*+_)[\w-]++){{2,}}+{_SPACE}*+$")
_THAI = r"[ก-ฺเ-๎]"
_HAS_THAI = re.compile(_THAI)
_THAI_GAP = regex.compile(rf"(?<={_THAI})(?:{_SPACE}|[\r\n])++(?={_THAI})")
_OPENING = frozenset("\"'“‘„«‹([¿¡—–-")
_ACRONYM_AFTER = regex.compile(r"\p{Lu}[.\p{Lu}\d_]")
_SHOUT_AFTER = regex.compile(r"\p{Lu}\p{Lu}+\s")
_LETTER_AFTER = regex.compile(r"\s*\p{Lo}")
_DIGIT_AFTER = re.compile(r"\s*\d")
_INITIALS = regex.compile(r"(?:\p{L}\.)+\p{L}")
_NO_ORDINAL = re.compile(r"[.,\d]$|(?i:\b(?:nr|bd|bde|abb|kap|s|abs|art|band|kapitel|nummer|seite)\.?\s+)$")
_FULL_STOPS = frozenset("。！？｡．।॥؟۔")
_SMALL_START = regex.compile(r"(?:\.(?!\.)|[!?]+)[ \t\xa0]+[\"“]?\p{Ll}+(?![\p{L}])")
_REFERENCE_END = regex.compile(rf"\b(?:{'|'.join(map(regex.escape, sorted(frozenset().union(*_REFERENCES.values()))))})\.$", regex.IGNORECASE)
_SPACED = regex.compile(r"[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = {"ru": re.compile("[а-яёА-ЯЁ]"), "hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[\u0621-\u064a]")}
#: Characters by which lines may fall short of the longest and still be full.
SLACK = 3


def stated_language(lang: str | None) -> str | None:
    """The code of a stated language in lower case without its region; None where it is missing or none of those known."""
    code = re.split("[-_]", (lang or "").strip().lower())[0]
    return code if code in _ALL else None


def languages(text: str, start: int, stop: int) -> frozenset[str]:
    """Languages whose script or (at least half as often as those of any other) function words the passage holds."""
    counts: Counter[str] = Counter()
    for m in _LETTERS.finditer(text, start, stop):
        for lang in _LANGUAGES_OF.get(m.group().lower(), ()):
            counts[lang] += 1
    most = max(counts.values(), default=0)
    found = {lang for lang, n in counts.items() if 2 * n >= most}
    return frozenset(found | {lang for lang, letters in _SCRIPTS.items() if letters.search(text, start, stop)})


def _caseless(c: str) -> bool:
    return c > "\x7f" and category(c) in ("Lo", "Lm", "Mn", "Mc", "Me")


def _upper_after(text: str, at: int, stop: int) -> bool:
    """Whether a capital, or a word with one inside, follows behind blanks and opening marks."""
    while at < stop and (text[at] in _OPENING or text[at].isspace()):
        at += 1
    while at < stop:
        kind = category(text[at])
        if kind != "Ll":
            return kind in ("Lu", "Lt")
        at += 1
        if at < stop and category(text[at]) not in ("Ll", "Lu"):
            return False
    return False


def _lower_after(text: str, at: int, stop: int) -> bool:
    while at < stop and (text[at] in _OPENING and text[at] not in "¿¡" or text[at].isspace()):
        at += 1
    return at < stop and category(text[at]) == "Ll"


def _rest_blank(text: str, at: int, stop: int) -> bool:
    while at < stop and text[at].isspace():
        at += 1
    return at >= stop


def _is_ended(text: str, start: int, stop: int) -> bool:
    """Whether the passage ends with a terminator, closing marks behind it."""
    at = stop
    while at > start and text[at - 1] in _CLOSER_SET:
        at -= 1
    for k in (at, at - 1) if at > start and text[at - 1] in " \t\xa0\u202f\u3000" else (at,):
        if k > start and (text[k - 1] in _STERM or text[k - 1] in _ATERM or text[k - 1] == "…"):
            return True
    return False


def _ended(line: str) -> bool:
    return _is_ended(line, 0, len(line))


def _word_before(text: str, start: int, at: int) -> str:
    """Letters, digits and inner points in front of a terminator, at most LONGEST + 1 of them."""
    k, least = at, max(start, at - LONGEST - 1)
    while k > least:
        c = text[k - 1]
        if not (c.isalnum() or c in "°º№-." or c > "\x7f" and category(c) in ("Mn", "Mc", "Me")):
            break
        k -= 1
    word = text[k:at]
    while word.startswith(".") or ".." in word:
        word = word[word.find(".") + 1 :]
    return word


def _runs_on(text: str, lines: list[tuple[int, int]]) -> bool:
    """Whether some line without an end mark goes on with a small letter."""
    pairs = zip(lines, lines[1:])
    return any(text[c:d].strip()[:1].islower() and text[a:b].strip() and not _ended(text[a:b].rstrip()) and "_" not in text[c:d] for (a, b), (c, d) in pairs)


def _line_blocks(text: str) -> list[tuple[int, int]]:
    """Blocks of lines that belong to running text; breaks between blocks always separate."""
    lines, at = [], 0
    for m in _BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    if len(lines) == 1:
        return lines
    lengths = sorted(len(text[a:b].rstrip()) for a, b in lines)
    # One line may stick out of the width that the others keep to.
    width = lengths[-2] if len(lengths) > 3 and lengths[-1] - lengths[-2] <= 10 else lengths[-1]
    wrapped = 50 <= width <= 120 or width < 50 and _runs_on(text, lines)
    blocks: list[tuple[int, int]] = []
    last: tuple[int, int] | None = None
    for a, b in lines:
        line = text[a:b].strip()
        if not line:
            last = None
            continue
        joined = False
        if last is not None:
            before = text[last[0] : last[1]].rstrip()
            first = line.split(None, 1)[0]
            # A line can break at any character of a script without spaces. The longest line may stick out of the width.
            full = wrapped and len(before) + 1 + max(1, _SPACED.match(first).end()) > width - SLACK
            bullet, ended = _BULLET.match(text, a, b), _ended(before)
            if bullet and not full or bullet and line[0] in "*•-+" and (ended or _TAGS.match(before)):
                joined = False
            elif _NUMBERED.match(text, a, b) and (not full or ended and not _REFERENCE_END.search(before, max(0, len(before) - LONGEST))):
                joined = False
            elif "_" in before and _TAGS.match(before):
                joined = False
            elif full:
                joined = not (ended and _TAGS.match(line))
            else:
                # A longer text may have been broken at other places: only a small letter or an open pair goes on.
                joined = line[0].islower() and not ended and (before[-1:].isalnum() or before[-1:] in ",;–—") and before[:1] not in "-*•" and not _TAGS.match(line) and "_" not in first and len(before) > 0.6 * width
        if joined:
            blocks[-1] = (blocks[-1][0], b)
        else:
            blocks.append((a, b))
        last = (a, b)
    return blocks


class _Block:
    """A block of running text with what is looked up at most once in it."""

    def __init__(self, text: str, start: int, stop: int, small: bool, stated: str | None) -> None:
        self.text, self.start, self.stop, self.small, self.stated = text, start, stop, small, stated
        self._languages: frozenset[str] | None = None

    @property
    def languages(self) -> frozenset[str]:
        """Languages of the block, with the stated one; all where nothing tells."""
        if self._languages is None:
            found = languages(self.text, self.start, self.stop)
            self._languages = found | {self.stated} if self.stated else found or _ALL
        return self._languages

    def _is(self, word: str, lists: dict[str, frozenset[str]], at: int) -> bool:
        """Whether the lists have the word for a language of the block, or of the words around it at ``at``."""
        owners = [lang for lang, listed in lists.items() if word in listed]
        if not owners or not self.languages.isdisjoint(owners):
            return bool(owners)
        return not languages(self.text, max(self.start, at - AROUND), min(self.stop, at + AROUND)).isdisjoint(owners)

    def ends(self, start: int, at: int, end: int) -> bool:
        """Whether the terminator at text[at:end] closes a sentence that began at ``start``; ``end`` is behind closing marks."""
        text, stop, small = self.text, self.stop, self.small
        if _rest_blank(text, end, stop):
            return True
        following = text[end]
        spaced = following.isspace()
        run = text[at:end]
        first = next((c for c in run if c in _STERM), None)
        strong = first is not None
        if first in _FULL_STOPS:
            return following not in "、，,；;：:"
        before = text[at - 1] if at > start else ""
        if not spaced:
            # No blank behind: only a capital after a word or a closing mark starts a sentence here.
            if _caseless(following):
                return bool(before) and _caseless(before) or strong
            if not (category(following) == "Lu" or following in "¡¿„«“"):
                return False
            if not strong and _ACRONYM_AFTER.match(text, end, stop) and not _SHOUT_AFTER.match(text, end, stop):
                return False
            if not strong and len(_word_before(text, start, at)) == 1:
                return False
        if strong:
            return bool(small or before and _caseless(before) or not _lower_after(text, end, stop) or _upper_after(text, end, stop))
        # Ambiguous terminator.
        dots = len(run) - len(run.lstrip("."))
        if dots >= 2:
            if small:
                # A single word with points behind it opens the sentence.
                return at - start > 2 * LONGEST or not text[start:at].lstrip().lstrip("\"“«([").isalpha()
            return _upper_after(text, end, stop) or bool(_DIGIT_AFTER.match(text, end, stop)) or bool(_LETTER_AFTER.match(text, end, stop))
        name = key = ""
        if end == at + 1:
            name = _word_before(text, start, at)
            key = name.lower()
            if len(name) == 1 and name.isalpha() and not _caseless(name):
                # An initial, or a piece of one like p. ex. or U.K.
                return False
            if key in _LISTED and not self._abbreviated(name, key, at, end):
                return False
            if "." in name and _INITIALS.fullmatch(name) and not self._is(key, _EITHER, at):
                return False
            if small and key in _LISTED and self._is(key, _EITHER, at):
                return key in EITHER_ENDS_SMALL
            if name.isdigit() and len(name) <= 2 and spaced and category(text[end + 1 : end + 2] or " ") == "Lu":
                begin = at - len(name)
                german = "de" in languages(text, max(self.start, at - AROUND), min(stop, at + AROUND))
                if german and not _NO_ORDINAL.search(text[max(start, begin - 12) : begin]):
                    return False
        if small:
            return True
        if _lower_after(text, end, stop) and not _upper_after(text, end, stop):
            # A caseless script in front of the mark: small letters of another script begin the next sentence.
            back = at
            while back > start and text[back - 1] in "\"'”»)]）":
                back -= 1
            return back > start and _caseless(text[back - 1]) and not (key in _LISTED and (self._is(key, _EITHER, at) or self._is(key, _GOING, at)))
        return True

    def _abbreviated(self, name: str, key: str, at: int, end: int) -> bool:
        """Whether a sentence may end behind an abbreviation."""
        either, capital = self._is(key, _EITHER, at), _upper_after(self.text, end, self.stop)
        if either and capital:
            return True
        if self._is(key, _GOING, at):
            return False
        if self._is(key, _TITLES, at) and (self.small or not name.islower()):
            return False
        return not (self._is(key, _REFERENCES, at) and _DIGIT_AFTER.match(self.text, end, self.stop))

    def goes_on(self, opening: str, end: int) -> bool:
        """Whether the sentence goes on behind a closed quotation that ends at ``end``."""
        text, stop = self.text, self.stop
        if opening in "「『《〈【":
            return opening != "「" or bool(_GOES_ON_JA.match(text, end, stop))
        if opening in "(（[`":
            return True
        if end >= stop:
            return False
        if text[end] in ",;:、，；：":
            return True
        if opening in "“\"" and ("a" <= text[end].lower() <= "z" or "\u3400" <= text[end] <= "\u9fff") and _SPEAKER_ZH.match(text, end, stop):
            return True
        if opening == '"' and _GOES_ON_KO.match(text, end, stop):
            return True
        return bool(_SPEAKER.match(text, end, stop))

    def linked(self, at: int) -> bool:
        """Whether a word links what follows to a quotation in front, in a text without capitals."""
        if _LINKS.match(self.text, at, self.stop):
            return True
        if not _VERBS.match(self.text, at, self.stop):
            return False
        for end in _NEXT_END.finditer(self.text, at, self.stop):
            if end.group() != "." or _word_before(self.text, at, end.start()).lower() not in _LISTED:
                return "?" not in end.group()
        return True

    def pairs(self) -> list[tuple[int, int]]:
        out, at = [], self.start
        while m := _OPENER.search(self.text, at, self.stop):
            pair = _PAIR.match(self.text, m.start(), self.stop)
            if pair:
                out.append((pair.start(), pair.end()))
            at = pair.end() if pair else m.end()
        return out

    def cuts(self) -> list[int]:
        """Ends of sentences inside the block."""
        text, a, b = self.text, self.start, self.stop
        out: list[int] = []
        pairs = self.pairs()
        k, start = 0, a
        lead = _NUMBERED.match(text, a, b)
        at = lead.end() - 1 if lead else a
        while at < b:
            found = _TERMINAL.search(text, at, b)
            if found is None:
                break
            where = found.start()
            while k < len(pairs) and pairs[k][1] <= where:
                k += 1
            if k < len(pairs) and pairs[k][0] <= where:
                # Inside a pair: only its end can end the sentence, and only if it closes right behind a terminator.
                p, q = pairs[k]
                inner = q - 1
                while inner > p + 1 and text[inner - 1].isspace():
                    inner -= 1
                closed = _CLOSING.match(text, q, b).end()
                if inner > p + 1 and _is_ended(text, p + 1, inner) and not self.goes_on(text[p], closed):
                    lower = _lower_after(text, closed, b) and not _upper_after(text, closed, b)
                    if not lower or _rest_blank(text, closed, b) or (self.small and text[inner - 1] in ".!?" and text[closed].isspace() and not self.linked(closed)):
                        out.append(closed)
                        start = closed
                at = max(q, where + 1)
                continue
            run = _RUN.match(text, where, b).end()
            end = _CLOSING.match(text, run, b).end()
            # A quote that opens the next sentence is not a closing mark of this one.
            for p, q in pairs[k : k + 2]:
                if run <= p < end:
                    end = p
            if self.ends(start, where, end):
                out.append(end)
                start = end
            at = max(end, run)
        return out


def _without_capitals(text: str) -> bool:
    """Whether sentences of the text start with small letters: one does behind a word that is no abbreviation."""
    for m in _SMALL_START.finditer(text):
        at = m.start()
        word = _word_before(text, 0, at)
        if word.isdigit():
            # A number counts behind a word or a comma only.
            back = at - len(word)
            if back >= 2 and text[back - 1] == " " and (text[back - 2].isalpha() or text[back - 2] == ","):
                return True
        elif len(word) > 1 and "." not in word and word.isalpha() and word[1:].islower() and word.lower() not in _LISTED:
            return True
    return False


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of every sentence, in code points; both ends stand on visible characters.

    NULL and blank texts have none. Nothing visible is left out: the spans cover all characters but blanks. ``lang`` is
    what the record states; it is used where the text itself does not tell.
    """
    if not text or not text.strip():
        return []
    small, stated, thai = _without_capitals(text), stated_language(lang), bool(_HAS_THAI.search(text))
    out: list[tuple[int, int]] = []
    for a, b in _line_blocks(text):
        cuts = _Block(text, a, b, small, stated).cuts()
        if thai:
            cuts = sorted({*cuts, *(m.start() for m in _THAI_GAP.finditer(text, a, b))})
        begin = a
        for cut in [*cuts, b]:
            piece = text[begin:cut]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                out.append((begin + left, begin + len(piece.rstrip())))
            begin = cut
    return out


def split_sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(id_col, begin_at int, end_at int) for every sentence of every row; other columns are not carried.

    ``lang_col`` names a column with the stated language, in any spelling. NULL and blank texts give no rows, repeated
    rows repeat theirs, an empty frame gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, begins, ends = [], [], []
                for k, (text, lang) in enumerate(zip(part.column("_text").to_pylist(), part.column("_lang").to_pylist())):
                    for begin, end in sentence_spans(text, lang):
                        rows.append(k)
                        begins.append(begin)
                        ends.append(end)
                ids = part.column("_id").take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["_id", "begin_at", "end_at"])

    kind = df.schema[id_col].dataType.simpleString()
    lang = F.lit(None).cast("string") if lang_col is None else F.col(f"`{lang_col}`").cast("string")
    ready = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), lang.alias("_lang"))
    return ready.mapInArrow(run, f"_id {kind}, begin_at int, end_at int").withColumnRenamed("_id", id_col)
