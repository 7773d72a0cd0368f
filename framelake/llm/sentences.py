"""Sentence units across languages and scripts.

Boundaries are decided by segmentation rule tables: ordered pairs of regular
expressions for the text before and after a candidate position, each a break or
a no-break rule; the first pair that matches decides.  Tables cascade: those of
a language come first, then those of its script, then the common ones.

Candidates are the places after an end mark with its closing quotes and
brackets.  Above the rules lies the layout: blank lines and heading lines end a
unit, a numbered claim is one unit with all its lines, and a paragraph number
like [0012] belongs to the sentence after it.  Line breaks are no boundary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- fixed values: abbreviations -------------------------------------------
# always followed by more of the sentence
NEVER = {
    "": "dr prof st no nos fig figs eq ex pat vs cf ca approx e.g i.e vol pp col ll resp math mr mrs ms mt u.s ph nr tab abb",
    "en": "wt sec ref refs ser",
    "de": "z.b d.h u.a i.d ggf bzw sog gem vgl gl usf bspw bes inkl ev evtl o.g s.o zzgl abs art aufl bd hrsg str",
    "fr": "p.ex env max min art al mme mlle n° chap",
    "es": "sr sra srta dra pág págs aprox p.ej núm art ud uds",
    "ru": "см стр рис т.е т.к гл п пп напр проф акад табл им ул",
    "hi": "डॉ मि मि.मी श्री प्रो क्र सं",
}
# may also be the last word of a sentence: a break if a new one clearly begins
MAYBE = {
    "": "etc al inc ltd co corp jr sr ff",
    "en": "in min hrs hr sec ft lb oz",
    "de": "usw std min u.a.m f gmbh ag",
    "fr": "etc",
    "es": "etc",
    "ru": "т.д т.п др пр г гг руб тыс млн",
    "hi": "",
}
# words before an ordinal number in German, and months after it
ORDINAL = "am|der|die|das|dem|den|des|im|zum|zur|vom|beim|ein|eine|einer|einem|einen|jeder|jede|jedes|dieser|diese|bis|seit|ab"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# headings of the parts of a patent, whole lines
HEADINGS = """
ABSTRACT|DESCRIPTION|DETAILED DESCRIPTION|BACKGROUND OF THE INVENTION|BACKGROUND|SUMMARY|TECHNICAL FIELD|EXAMPLES
ZUSAMMENFASSUNG|BESCHREIBUNG|STAND DER TECHNIK|AUSFÜHRUNGSBEISPIELE
ABRÉGÉ|MODES DE RÉALISATION|ÉTAT DE LA TECHNIQUE
RESUMEN|DESCRIPCIÓN|REALIZACIONES|ANTECEDENTES
РЕФЕРАТ|ОПИСАНИЕ|ПРИМЕРЫ|УРОВЕНЬ ТЕХНИКИ
摘要|说明书|背景技术|具体实施方式|发明内容|附图说明
सारांश|विवरण|पृष्ठभूमि|उदाहरण
บทสรุป|รายละเอียด|ภูมิหลัง|ตัวอย่าง
"""
CLAIM_HEADINGS = """
What is claimed is|What is claimed|We claim|I claim|Claims|CLAIMS
Patentansprüche|Ansprüche|Revendications|Reivindicaciones|Формула изобретения
权利要求书|权利要求|特許請求の範囲|请求项|दावे|ข้อถือสิทธิ
"""

_END = ".!?。！？｡।॥…．"
_CLOSE = "\"'”’»›“」』】〕）)\\]}›"
_OPEN = "\"'“„«‹「『【〔（(\\[¿¡"
_SPACE = "\\s\u00a0\u202f"
_THAI = re.compile(r"(?<=[ก-ฺเ-๎])[ \t\u00a0]*(?:\r?\n)?[ \t\u00a0]+(?=[ก-ฺเ-๎])|(?<=[ก-ฺเ-๎])\r?\n(?=[ก-ฺเ-๎])")
#: What opens a quotation or bracket, and what closes it; the same mark may do
#: both in other languages, so an opening one closes what waits for it.
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", '"': '"'}
_CLOSERS = {c for closers in _PAIRS.values() for c in closers}
_QUOTE = re.compile("[“”„«»「」『』（）\"]")
_MARK = re.compile(r"\[\s?\d{3,5}\s?\]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")
_CLAIM = re.compile(r"\s*(\d+)\s?[.)．、](?!\d)\s*(?=\S)")
_TERMINAL = re.compile(rf"[{_END}][{_CLOSE}{_SPACE}]*$")
_ENDS = frozenset(_END)  # an empty text is none
_TRAILING = "\"'”’»›“」』】〕）)]} \t\u00a0\u202f"


def _words(group: str, lang: str) -> set[str]:
    table = NEVER if group == "never" else MAYBE
    return {w for key in ("", lang) for w in table.get(key, "").split()}


_CL = rf"(?:[{_CLOSE}]|[ \u00a0\u202f]+[»›])"


class Rule:
    """A break or no-break pair: what stands before and after a position."""

    __slots__ = ("breaks", "before", "after", "text")

    def __init__(self, breaks: bool, before: str, after: str) -> None:
        self.breaks = breaks
        self.before = re.compile(f"(?:{before})$")
        self.after = re.compile(after)
        self.text = before

    def may_follow(self, kind: str) -> bool:
        """Whether ``before`` can match at all after a full stop of this kind:
        one after a letter, a digit, or something else."""
        last = self.text.removesuffix(f"{_CL}*")
        if not last.endswith(r"\."):
            return False
        last = last[:-2]
        if last.endswith((r"\d", r"\d{1,3}", r"\d{1,2}")):
            return kind == "digit"
        if last.endswith((r"[^\W\d_]", r"[^\W\d_]{1,2}", r"[^\W\d_]{3,}", r"[^\W\d_A-Z]{2}", "[A-Za-z]{3,}")):
            return kind == "letter"
        return True


@dataclass(frozen=True)
class Layout:
    """Rules of the layer above the sentences, which callers may replace.

    ``headings`` and ``claim_headings`` are whole lines, without case;
    ``upper_headings`` makes lines of upper-case words headings as well.  After
    a claim heading each line that begins with a number is a new unit if the
    number is above the last one by at most ``claim_step``, so that a claim may
    be lost and a wrapped line that begins with a number is no claim.
    """

    headings: str = HEADINGS
    claim_headings: str = CLAIM_HEADINGS
    upper_headings: bool = True
    claim_step: int = 5


def quotations(block: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of any length, by a stack.

    A mark that closes one of the open ones ends it and drops what was opened
    inside it and is not closed; what is never closed is no quotation.  A plain
    quotation mark opens before a word and closes after one.
    """
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    size = len(block)
    for m in _QUOTE.finditer(block):
        c, at = m.group(), m.start()
        before, after = block[at - 1 : at], block[at + 1 : at + 2]
        if c in _CLOSERS and (c != '"' or (before and not before.isspace() and not (after.isalnum() or after == "_"))):
            k = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[k][0]] and (c != '"' or stack[k][1] < at - 1)), -1)
            if k >= 0:
                start = stack[k][1]
                del stack[k:]
                while found and found[-1][0] > start:
                    found.pop()
                found.append((start, at + 1))
                continue
        if c in _PAIRS and (c != '"' or (at + 1 < size and not after.isspace() and not (before.isalnum() or before in ("_", '"')))):
            stack.append((c, at))
    return found


#: Letters that scanning confuses, as they may stand in an abbreviation.
_DIGITS = str.maketrans("03456789", "22222222")
_SCANNED = {"e": "[ec]", "l": "[l1]"}


def _any(words: set[str]) -> str:
    """An alternation of abbreviations, also as a scan may have read them."""
    out = []
    for w in sorted(words, key=lambda x: (-len(x), x)):
        if w == "ll":
            out.append("ll|l1|1l")
            continue
        out.append(r"\.\s?".join("".join(_SCANNED.get(c, re.escape(c)) for c in p) for p in w.split(".")))
    return "|".join(out)


_START = rf"\s*[{_OPEN}]?\s?(?:[^\W\d_a-zß-öø-ÿа-яё]|[∆∑$¿¡]|[a-z][A-Z])"  # an upper-case or caseless letter
_DIGIT = r"\s+\d"
_UNIT = r"\d\s(?:[A-Za-zµ°%℃Ω]{1,3}|kPa|U/min|tr/min|rpm|degrees|[а-яА-Я]{1,3})"


def rules_of(lang: str) -> list[Rule]:
    """The cascade of a language: its own rules, its script's, the common ones."""
    never, maybe = _any(_words("never", lang)), _any(_words("maybe", lang))
    word = r"(?<![A-Za-z./])" if lang in ("zh", "ja") else r"(?<![\w./])"
    own: list[Rule] = []
    if lang == "de":
        own += [
            Rule(False, rf"(?i:\b(?:{ORDINAL.replace('e', '[ec]').replace('l', '[l1]')}))\s+(?:\d{{1,3}}\.\s+)?\d{{1,3}}\.", r"\s"),
            Rule(False, r"\b\d{1,2}\.", rf"\s+(?:{MONTHS})\b"),
            Rule(False, r"\bGew\.", r"-"),
        ]
    if lang == "ru":
        own += [Rule(False, r"(?<!\w)т\.", r"\s?[екдпн]\.")]
    if lang in ("zh", "ja"):
        own += [
            Rule(False, r"…+", r""),
            Rule(False, rf"[。！？｡]\s?[）)】\]]+", r"\s*\S"),
            Rule(False, r"[。！？｡!?]+[”」』]+", r"\s*[^\s“「『\[A-Z0-9]"),
            Rule(True, rf"[。！？｡]+{_CL}*", r""),
            Rule(True, rf"[\u3040-\u30ff\u3400-\u9fff）][!?]+{_CL}*", r"\s*\S"),
        ]
    common = [
        Rule(False, r"\s\.{2,}", r"\s"),
        Rule(False, r"\s…+", r"\s"),
        Rule(True, rf"[।॥]{_CL}*", r""),
        Rule(True, rf"[。！？｡]+{_CL}*", r""),
        # a sign in a formula; French has a space before the mark
        Rule(False, r"\(\w+ \?" if lang == "fr" else r"[\s(=]\?", r"\s*[^\sA-ZÀ-ÞА-Я]"),
        # marks that ask or call: a sentence after a quotation goes on in small letters
        Rule(False, rf"[!?]+{_CL}+", r"\s*[a-zß-öø-ÿа-яё,;:]"),
        Rule(False, rf"[!?]+", r"[,;:)\w]" if lang in ("zh", "ja") else r"[,;:)a-zß-öø-ÿа-яё0-9_(]"),
        Rule(True, rf"[!?]+{_CL}*", r""),
        # abbreviations
        Rule(False, rf"(?i:{word}(?:{never}))\.", r""),
        Rule(True, rf"(?i:{word}(?:{maybe}))\.{_CL}*", _START + "|" + _DIGIT) if maybe else Rule(False, r"(?!)", r""),
        Rule(False, rf"(?i:{word}(?:{maybe}))\.", r"") if maybe else Rule(False, r"(?!)", r""),
        # initials, unless the letter is a unit after a number
        Rule(True, rf"\d\s[A-Zµ°%sgmVNKА-Я]\.{_CL}*", _START + "|" + _DIGIT + r"|\s+[a-zа-я]{2}"),
        Rule(False, r"(?<![^\W_\u3040-\u9fff])(?<![)\]%°=#])[^\W\d_]\.", r"\s?\S"),
        Rule(False, r"(?<!\w)(?:[^\W\d_]\.\s?)+[^\W\d_]{1,2}\.", r"\s?[a-zß-öø-ÿа-яё,]"),
        # closing brackets: the mark inside ends the sentence only before a new one
        Rule(True, rf"[.…][)\]]+{_CL}*", r"\s+[A-ZÀ-ÞА-ЯЁ]|\s*$"),
        Rule(False, r"[.…][)\]]+", r""),
        Rule(True, rf"[.…]{_CL}+", _START + "|" + _DIGIT),
        Rule(False, rf"[.…]{_CL}+", r"\s*\S"),
        # numbers: a sentence may end with one, a list item begins with one
        Rule(True, r"(?i:\b(?:fig|figs|no|nos|nr|tab|table|abb|gl|claim|claims|n°|рис|стр|п|pág|p|art|al|eq|col|vol|pp)\.?)\s?[\d\-–]+[A-Z]?\.", r"\s+(?:\d|[^\W\d_])" if lang != "en" else _START + r"|\s+\d"),
        Rule(True, r"\d\.", _START + r"|\s+\d{2,}|\s+[∆∑$]"),
        Rule(False, r"(?<![\w.,])\d{1,3}\.", r"\s"),
        Rule(True, rf"{_UNIT}\.", r"\s+\S"),
        Rule(True, r"\)\.", r"\s*\S"),
        # a new sentence, also where the space is missing
        Rule(True, r"[\w)\]%°\"”»}′²□]\.", r"\s+(?:[A-ZÀ-ÞА-ЯЁ\d]|[¿¡\"“„«‹「(\[$∆∑]|[a-z][A-Z])"),
        Rule(True, r"[^\W\d_A-Z]{2}\.", r"[A-ZÀ-ÞА-ЯЁ][^\W\d_A-Z.]|[¿¡]|[A-ZÀ-ÞА-ЯЁ]\s"),
        Rule(True, r"[\d)\]%°A-Z]\.", r"[A-ZÀ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+[\s,]|[A-Z]\s[a-z]|[¿¡]"),
        Rule(False, r"\.", r"\S"),
        # lower case after an ordinary word: an article was lost, or is none
        Rule(True, r"[^\W\d_]{3,}\.", r"\s+[^\W\d_]") if lang not in ("hi", "th", "zh", "ja") else Rule(True, r"[A-Za-z]{3,}\.", r"\s+[A-Z]"),
        Rule(True, r"\.{3,}|…", r"\s+[A-ZÀ-ÞА-ЯЁ]"),
    ]
    return own + common


#: Chinese and Japanese: a quotation after a colon is the end of its sentence,
#: unless the sentence goes on with a particle or comma; it may have any length.
_SPOKEN = re.compile(r"^.?[:：]\s?[“「『].*[。！？｡!?]+[”」』]+$", re.S), re.compile(r"(?!\s*[とやをがはのにでも，、。；：])")
_LATIN = {
    "en": (" the ", " of ", " is "),
    "de": (" der ", " die ", " das "),
    "fr": (" le ", " est ", " une "),
    "es": (" el ", " los ", " mide "),
}
_SCRIPTS = (("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")))
_ALIAS = {"eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "hin": "hi", "tha": "th"}


_OTHER_SCRIPT = re.compile("[Ѐ-ӿऀ-ॿ฀-๿぀-ヿ一-鿿]")


def language(text: str, declared: str | None) -> tuple[str, bool]:
    """The language of the rules, and whether paragraphs may be in others: by
    script, then by frequent words; what is declared decides between equals."""
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        letters = sum(map(text.count, "aeinrt")) * 2
        for lang, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if n and n * (2 if lang != "ja" else 6) > letters:
                return lang, False
    said = re.split(r"[-_]", (declared or "").strip().lower())[0]
    return frequent(text, _ALIAS.get(said, said))[:2]


def frequent(text: str, said: str) -> tuple[str, bool, int]:
    """The Latin-script language of most frequent words; whether there are
    others; and how much it leads the one that is said."""
    counts = {lang: sum(map(text.count, words)) for lang, words in _LATIN.items()}
    most = max(counts.values())
    said = said if said in _LATIN else "en"
    best = said if counts[said] == most else max(counts, key=counts.get)
    return best, sum(counts.values()) - most > max(2, most // 6), most - counts[said]


#: Candidates: an end mark, or several, and what closes after it (French closes
#: after a space).  Without the group: a boundary that every cascade decides alike,
#: so none is asked: a full stop after a word of five letters that is no
#: abbreviation, before a space and a capital; the full stops of other scripts
#: between two letters of theirs.
_LETTER, _KANA_HAN = r"[^\W\d_]", r"[\u3040-\u30ff\u3400-\u9fff]"
_PLAIN = re.compile(
    rf"[{_END}](?:(?<=\.)(?=[ \n][A-ZÀ-ÞА-ЯЁ])(?<={_LETTER * 5}\.)(?<!approx\.)(?<!aprox\.)|(?<=[。｡])(?=\s?{_KANA_HAN})(?<={_KANA_HAN}.)|(?<=[।॥])(?=\s[\u0900-\u0963])(?<=[\u0900-\u0963].)"
    rf"|([{_END}]*(?:[{_CLOSE}]|[ \u00a0\u202f]+[»›])*(?=[{_SPACE}]|$|[^{_SPACE}\d,;:)\]])))"
)
#: Characters before a position in which a rule's pattern may begin; what stands
#: before the pattern is seen wherever it is.
LOOK_BACK = {"letter": 14, "other": 10, "digit": 24, "": 10}
#: A new sentence after a full stop and a space, as the common rules have it.
_NEW = re.compile(r"\s+(?:[A-ZÀ-ÞА-ЯЁ\d]|[¿¡\"“„«‹「(\[$∆∑]|[a-z][A-Z])")
_BEGINS = re.compile(_START + "|" + _DIGIT)
_CAPITAL = re.compile(_START)
_ITEM = re.compile(r"(?<![\w.,])\d{1,3}\.$")
#: Letters that a scan may have put for each other, to find doubtful words.
_ALIKE = str.maketrans("c1", "el")
_BEFORE_WORD = frozenset("([\"'“„«‹")


class Segmenter:
    """Compiled cascades; one for each process.

    ``remember`` keeps the boundaries of that many paragraphs, for a corpus that
    repeats its paragraphs.
    """

    def __init__(self, layout: Layout | None = None, remember: int = 0) -> None:
        self.rules: dict[tuple[str, str], list[tuple]] = {}
        self.layout_rules, self.remember = layout or Layout(), remember
        self.blocks: dict[tuple[str, str], tuple[int, ...]] = {}
        self.known: dict[str, tuple[set[str], set[str], set[str]]] = {}
        flat = lambda s: {h.strip().casefold() for line in s.split("\n") for h in line.split("|") if h.strip()}
        self.headings, self.claims = flat(self.layout_rules.headings), flat(self.layout_rules.claim_headings)
        self.longest = max(map(len, self.headings | self.claims), default=0)

    def cascade(self, lang: str, kind: str) -> list[tuple]:
        """The rules of a language that can apply at all: all, or those for a
        full stop after a letter, a digit or something else."""
        got = self.rules.get((lang, kind))
        if got is None:
            got = self.rules[lang, kind] = [(r.before.search, r.after.match, r.breaks) for r in rules_of(lang) if not kind or r.may_follow(kind)]
        return got

    def words(self, lang: str) -> tuple[set[str], set[str], set[str]]:
        """Abbreviations of one part that never end a sentence, that may, and
        all of them as a scan may have changed them."""
        got = self.known.get(lang)
        if got is None:
            never, maybe = _words("never", lang), _words("maybe", lang)
            got = self.known[lang] = (never, maybe - never, {w.translate(_ALIKE) for w in never | maybe} | {"gew", "ll"} | {w[-1] for w in maybe if "." in w})
        return got

    def decide(self, lang: str, block: str, at: int) -> bool:
        """Whether the first rule that matches at this position is a break."""
        got = self.shortcut(lang, block, at)
        return self.first_rule(lang, block, at) if got is None else got

    def shortcut(self, lang: str, block: str, at: int) -> bool | None:
        """What the cascade gives in the most frequent cases, without its
        expressions; None in all others."""
        mark, c, after = block[at - 1], block[at - 2 : at - 1], block[at : at + 2]
        if mark == ".":
            if c.isalpha():
                end = at - 1
                begin = max(block.rfind(" ", 0, end), block.rfind("\n", at - 40 if at > 40 else 0, end)) + 1
                word = block[begin:end]
                if word[:1] in _BEFORE_WORD:
                    begin, word = begin + 1, word[1:]
                if not word or word[-1] > "\u058f":
                    return None
                never, maybe, doubtful = self.words(lang)
                if not word.isalpha():
                    return False if word.lower() in never else None
                if not word.isascii() and (max(word) > "\u058f" or lang in ("zh", "ja")):
                    return None
                if len(word) == 1:
                    # an initial or a part of an abbreviation, not a unit after a number
                    before = block[begin - 3 : begin].strip()[-1:] if begin > 2 else ""
                    if before and (before.isalpha() or before in ",;.") and word.lower() not in doubtful and (not after[:1].isspace() or not (after[1:] or " ").isspace()) and after:
                        return False
                    return None
                word = word.lower()
                if word in never:
                    return False
                if word in maybe:
                    return _BEGINS.match(block, at) is not None
                if word.translate(_ALIKE) not in doubtful and _NEW.match(block, at):
                    return True
            elif lang in ("zh", "ja"):
                return None
            elif c == ")":
                return True
            elif c.isdecimal():
                if lang != "de" and _CAPITAL.match(block, at):
                    return True
                if lang == "en" and after[:1] == " " and after[1:].islower() and _ITEM.search(block, at - 5 if at > 5 else 0, at):
                    return False
            elif c == "." and after[:1].isspace():
                back = at - 2
                while back and block[back - 1] == ".":
                    back -= 1
                if block[back - 1 : back].isspace():
                    return False  # dots that stand alone
            return None
        if lang in ("zh", "ja"):
            return None
        if mark in "!?" and c.isalpha() and after[:1].isspace() and after[1:].isupper():
            return True
        if mark in "\"”’»“" and c in ("!", "?") and after[:1] == " " and after[1:].islower() and after[1:] < "\u0450":
            return False
        return None

    def first_rule(self, lang: str, block: str, at: int) -> bool:
        kind = ""
        if block[at - 1] == "." and at > 1:
            c = block[at - 2]
            if c not in ".…":  # groups of marks ask all rules
                kind = "letter" if c.isalpha() else "digit" if c.isdecimal() else "other"
        start = at - LOOK_BACK[kind]
        if start < 0:
            start = 0
        for before, after, breaks in self.cascade(lang, kind):
            if after(block, at) and before(block, start, at):
                return breaks
        return False

    def heading(self, line: str, opens: bool) -> int:
        """0 no heading, 1 a heading, 2 the heading of the claims."""
        bare = line.strip("【】[]:： \t\u00a0.")
        if len(bare) <= self.longest:
            bare = bare.casefold()
            if bare in self.claims:
                return 2
            if bare in self.headings and not line.rstrip().endswith("."):
                return 1
        if not opens:
            return 0
        if line[0] == "【" and line[-1] == "】":
            return 1
        if self.layout_rules.upper_headings and line.isupper() and not any(c.isdigit() for c in line) and len(line) >= 4:
            words = line.split()
            if all(w.replace("-", "").replace("'", "").isalpha() and len(w) <= 22 for w in words) and not _TERMINAL.search(line) and not set(line) <= set("ACGT \t-"):
                return 1
        return 0

    def layout(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Forced boundaries, and the blocks of running text between them."""
        cuts, blocks = [], []
        claims, last, opens, begin = False, 0, True, 0
        end = 0
        for m in _LINE.finditer(text):
            s, e = m.span()
            line = text[s:e].strip()
            if not line:
                continue
            gap = not end or (s - end > 1 and _BLANK.search(text, end, s) is not None)
            kind = self.heading(line, opens or gap)
            if kind:
                if begin < s:
                    cuts.append(s)
                    if not claims:
                        blocks.append((begin, s))
                cuts.append(e)
                begin, claims, last, opens, end = e, kind == 2, 0, True, e
                continue
            if claims:
                n = _CLAIM.match(text, s, e)
                if n and (last < int(n.group(1)) <= last + self.layout_rules.claim_step or last == 0):
                    if begin < s and text[begin:s].strip():
                        cuts.append(s)
                    last, begin = int(n.group(1)), s
                elif last == 0:  # text between the heading and the first claim
                    pass
            elif gap and begin < s:
                cuts.append(s)
                if text[begin:s].strip():
                    blocks.append((begin, s))
                begin = s
            opens, end = line.rstrip(_TRAILING)[-1:] in _ENDS, e
        if not claims:
            blocks.append((begin, len(text)))
        cuts.append(len(text))
        return cuts, blocks

    def inside(self, lang: str, block: str) -> tuple[int, ...]:
        """Boundaries in running text."""
        if not self.remember:
            return tuple(self._inside(lang, block))
        key = (lang, block)
        got = self.blocks.get(key)
        if got is None:
            if len(self.blocks) >= self.remember:
                self.blocks.clear()
            got = self.blocks[key] = tuple(self._inside(lang, block))
        return got

    def _inside(self, lang: str, block: str) -> Iterator[int]:
        spans = quotations(block) if _QUOTE.search(block) else []
        k, n, cjk = 0, len(spans), lang in ("zh", "ja")
        size = len(block.rstrip())
        for m in _PLAIN.finditer(block):
            p = m.end()
            if p >= size:  # the block ends here anyhow
                break
            if n:
                at = m.start()
                while k < n and spans[k][1] < p:
                    k += 1
                if k < n and spans[k][0] < at:
                    if p < spans[k][1]:
                        continue  # inside a quotation
                    if cjk and block[p - 1] in "”」』":
                        whole = block[max(0, spans[k][0] - 2) : p]
                        if _SPOKEN[0].search(whole) and _SPOKEN[1].match(block, p):
                            yield p
                            continue
            if m.lastindex is None and (not cjk or block[p - 1] != ".") or self.decide(lang, block, p):
                yield p
        if lang == "th":
            yield from (m.start() for m in _THAI.finditer(block))
        if "[" in block:
            yield from (m.start() for m in _MARK.finditer(block))

    def ends(self, text: str, declared: str | None = None) -> list[int]:
        """The end of every unit: code points before and with its last
        non-space character."""
        if not text or text.isspace():
            return []
        whole, mixed = language(text, declared)
        lang = whole
        cuts, blocks = self.layout(text)
        for s, e in blocks:
            block = text[s:e]
            if mixed:
                other, _, lead = frequent(block, whole)
                lang = other if lead >= 3 else whole
            cuts += [s + c for c in self.inside(lang, block)]
        out, begin, marked = [], 0, -1
        for p in sorted(set(cuts)):
            done = p
            while done > begin and text[done - 1].isspace():
                done -= 1
            if done == begin:
                continue
            while text[begin].isspace():
                begin += 1
            first, begin = begin, p
            if not text[first].isalnum():
                body = text[first:done]
                if body[0] == "[" and _MARK.fullmatch(body):  # waits for its sentence
                    marked = done
                    continue
                if out and marked < 0 and all(unicodedata.category(c)[0] in "PZC" for c in body):
                    out[-1] = done  # marks without a word belong to what is before
                    continue
            out.append(done)
            marked = -1
        if marked >= 0:
            out.append(marked)
        return out


_shared: dict[tuple[Layout, int], Segmenter] = {}


def sentence_units(documents: DataFrame, doc_id: str, text: str, lang: str | None = None, *, with_text: bool = True, layout: Layout | None = None, remember: int = 0) -> DataFrame:
    """Columns doc_id, n (from 0), end_pos and, if wanted, unit.

    Units cover the text but for the space between them.  Null, empty and blank
    texts have no units; a document stored twice gives its units twice.
    """
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("n", T.IntegerType()), T.StructField("end_pos", T.LongType())]
        + ([T.StructField("unit", T.StringType())] if with_text else [])
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (layout or Layout(), remember)
        if key not in _shared:
            _shared[key] = Segmenter(*key)
        seg = _shared[key]
        for b in batches:
            ids, ns, ends, units = [], [], [], []
            for d, t, la in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not t:
                    continue
                found = seg.ends(t, la)
                ids += [d] * len(found)
                ns += range(len(found))
                ends += found
                if with_text:
                    units += [t[a:e].strip() for a, e in zip([0, *found], found)]
            cols = [ids, ns, ends] + ([units] if with_text else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    la = F.col(f"`{lang}`") if lang else F.lit(None).cast("string")
    rows = documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"), la.alias("l"))
    return rows.mapInArrow(split, schema)
