"""Titles of works brought to comparable forms, whatever their script, order of words, spelling or numbering."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

# Hepburn romanisation of kana, without voicing marks being composed by rule.
_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ",
    "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
}
_KANA = {kana: start + vowel for start, row in _ROWS.items() for kana, vowel in zip(row, "aiueo")}
_KANA |= {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n"}
_SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}
_ROMAN = {r: i + 1 for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii".split())}
# Words that carry no meaning of their own in a title.
STOP_WORDS = frozenset("the a an of for and no to story s".split())

_KANA_RUN = re.compile(r"[ぁ-ゖァ-ヺー]+")
_NATIVE_NUMBER = re.compile(r"第\s*(\d+)\s*[期部章]|(?:シーズン|パート)\s*(\d+)")
_NUMBERS = (
    re.compile(r"\b(\d{1,2})\s*(?:st|nd|rd|th)\s+s\w{2,7}\b"),
    re.compile(r"\b(?:season|part|cour)\s*(\d{1,2}|[ivx]+)\b"),
    re.compile(r"\bs(\d{1,2})\b"),
    re.compile(r"\b(\d{1,2})$"),
    re.compile(r"\b(i{2,3}|iv|vi{0,3}|ix|x)$"),
)
_COUNTERS = ("season", "part", "cour")
_KIND = re.compile(r"\s*\((?:tv|ova|ona|movie|film|special|anime|(?:19|20)\d\d)\)\s*$", re.IGNORECASE)
_MOVIE = re.compile(r"\b(?:the movie|movie|gekijouban|gekijoban)\b|劇場版")
_ABBREVIATION = re.compile(r"^\w{2,6} \w$")


def romanise(text: str) -> str:
    """Kana to Latin letters; katakana and hiragana runs become words, and の or と after katakana a word of its own."""

    def run(match: re.Match) -> str:
        words, kind, out = [], None, ""
        for c in match.group():
            now = kind if c == "ー" else "hiragana" if c <= "ゖ" else "katakana"
            if now != kind and out:
                words.append((kind, out))
                out = ""
            kind = now
            out += c
        words.append((kind, out))
        parts: list[str] = []
        for i, (kind, word) in enumerate(words):
            if kind == "hiragana" and i and word[0] in "のと" and len(word) > 1:
                parts += [word[0], word[1:]]
            else:
                parts.append(word)
        return " " + " ".join(_spell(p) for p in parts) + " "

    return _KANA_RUN.sub(run, text)


def _spell(word: str) -> str:
    out, double = "", False
    for c in word:
        if "ァ" <= c <= "ヶ":
            c = chr(ord(c) - 96)
        if c == "っ":
            double = True
            continue
        if c == "ー":
            continue
        if c in _SMALL:
            vowel = _SMALL[c]
            if vowel[0] == "y" and out.endswith("i"):
                out = out[:-1] + (vowel[1:] if out[-3:] in ("shi", "chi") or out[-2:] == "ji" else vowel)
            else:
                out += vowel
            continue
        latin = _KANA.get(c, c)
        if double:
            out, double = out + ("t" if latin.startswith("ch") else latin[:1]), False
        out += latin
    return out


@dataclass(frozen=True)
class Title:
    """A title: its words in order, the number of the instalment, whether it calls itself a film, and whether it has the form
    of an abbreviation such as ``Kasub V``."""

    words: tuple[str, ...]
    number: int | None
    movie: bool
    short: bool = False

    @property
    def flat(self) -> str:
        """The words in order, joined."""
        return "".join(self.words)

    @property
    def bag(self) -> str:
        """The words in alphabetical order, joined."""
        return " ".join(sorted(self.words))

    def abbreviates(self, other: Title) -> bool:
        """Whether this is a short form of another title, whose word its first word begins."""
        return self.short and not other.short and any(w.startswith(self.words[0]) and w != self.words[0] for w in other.words)


def parse(text: str | None) -> Title | None:
    """The parts of a title; null for blank titles and those without a word of meaning."""
    if not text:
        return None
    plain = _KIND.sub("", unicodedata.normalize("NFKC", text).replace("・", "").strip(" 『』「」。"))
    if not plain:
        return None
    short = bool(_ABBREVIATION.match(plain)) and not plain[-1].isdigit()
    plain, number = unicodedata.normalize("NFC", plain), None
    native = _NATIVE_NUMBER.search(plain)
    if native:
        number = int(native.group(1) or native.group(2))
        plain = plain[: native.start()] + " " + plain[native.end() :]
    movie = "劇場版" in plain
    plain = romanise(plain.replace("劇場版", " "))
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c)).lower()
    plain = re.sub(r"['’`]s\b", " s ", plain.replace("&", " and "))
    plain = re.sub(r"['’`]", "", plain)
    plain = " ".join(re.sub(r"[^\w]+|_", " ", plain).split())
    found = _MOVIE.search(plain)
    if found:
        movie, plain = True, " ".join((plain[: found.start()] + " " + plain[found.end() :]).split())
    if number is None:
        for pattern in _NUMBERS:
            match = pattern.search(plain)
            if match:
                value = match.group(1)
                number = int(value) if value.isdigit() else _ROMAN.get(value)
                before = plain[: match.start()].split()
                if before and difflib.get_close_matches(before[-1], _COUNTERS, 1, 0.75):  # a misspelt counter
                    before.pop()
                plain = " ".join([*before, *plain[match.end() :].split()])
                break
    words = tuple(w for w in plain.split() if w not in STOP_WORDS)
    return Title(words, number, movie, short) if words else None


def parse_all(texts: Iterable[str | None]) -> list[Title]:
    """The parts of all titles of a record; short forms of another one of its titles say nothing more and are left out."""
    known = [x for x in (parse(t) for t in sorted({t for t in texts if t is not None})) if x]
    return [x for x in known if not (x.short and any(x.abbreviates(y) for y in known))]
