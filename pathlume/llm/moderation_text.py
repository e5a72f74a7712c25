"""Bringing disguised and damaged texts to plain lower-case tokens."""

from __future__ import annotations

import html
import unicodedata

import regex

# Letters of other scripts and the Latin ones they pass for; used only in words that mix scripts.
LOOKALIKES = str.maketrans(dict(p.split(">") for p in "а>a в>b с>c ԁ>d е>e һ>h і>i ј>j к>k м>m н>h о>o р>p ԛ>q ѕ>s т>t у>y х>x ѡ>w α>a β>b ε>e ι>i κ>k ν>v ο>o ρ>p τ>t υ>u χ>x".split()))
#: Digits and signs that pass for letters; used only inside words that have letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

#: Names of markup elements that are taken out with their attributes; other words in angle brackets are text.
_ELEMENTS = "a abbr b blockquote body br button center code dd div dl dt em font form h1 h2 h3 h4 h5 h6 head hr html i iframe img input label li link meta ol option p pre s script select small span strike strong style sub sup table tbody td th thead title tr u ul".replace(" ", "|")
_TAG = regex.compile(rf"</?(?:{_ELEMENTS})(?:[\s/][^<>]*)?>|<!--|-->", regex.I)
_LINK = regex.compile(r"(?:https?://|www\.)\S+")
_INVISIBLE = regex.compile(r"[[\p{Cf}\p{Cc}\uFE00-\uFE0F]--\s]", regex.V1)
_MOJIBAKE = regex.compile(r"[ÃÂâÐÑã][\x80-\xBFŒ-Ÿ‐-›€™]")
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}[ .\-_*·]{1,3}){3,}\p{L}(?![\p{L}\p{N}])")
_BROKEN = regex.compile(r"(?<=\p{L})[.\-_*·+~^](?=\p{L})")
_LETTERS = regex.compile(r"(?<!\p{L})(?:\p{L}[.\-_*·+~^]){2,}\p{L}(?!\p{L})")  # single letters held apart
_LEET = regex.compile(r"[\p{L}\p{N}@$!|€*]*\p{L}[\p{L}\p{N}@$!|€*]*")
_MASKED = regex.compile(r"(?<=\p{L})[*#]{2,}")
_INNER = regex.compile(r"(?<=\p{L})[0134578@$!|€]+(?=\p{L})")
_RUN = regex.compile(r"(\p{L})\1{2,}")
_TOKEN = regex.compile(rf"[{_CJK}]|\p{{L}}[\p{{L}}\p{{M}}]*(?:['’*][\p{{L}}\p{{M}}]+)*\*?|\p{{N}}+|[!?]")
_LATIN, _CYRILLIC, _GREEK = (regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Greek"))


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were once read as a one-byte code, read aright; other text as it is."""
    if not _MOJIBAKE.search(text):
        return text
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return _MOJIBAKE.sub(lambda m: _pair(m[0]), text)
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return _MOJIBAKE.sub(lambda m: _pair(m[0]), text)


def _pair(two: str) -> str:
    try:
        return b"".join(c.encode("cp1252") if ord(c) > 255 or c.encode("latin-1") == c.encode("cp1252", "ignore") else c.encode("latin-1") for c in two).decode("utf-8")
    except UnicodeError:
        return two


def _undisguised(word: str) -> str:
    if _LATIN.search(word) and (_CYRILLIC.search(word) or _GREEK.search(word)):
        word = word.translate(LOOKALIKES)
    # figures and signs stand for letters between letters, signs also before them; others are what they are (4kg, size5, wow!)
    word = _INNER.sub(lambda m: "".join(SIGNS.get(c, c) for c in m[0]), word)
    if word[0] in "@$!" and len(word) > 2:
        word = SIGNS[word[0]] + word[1:]
    return word


def plain(text: str | None) -> str:
    """Lower-case text without markup, invisible characters, look-alike letters, stretched or spaced-out words."""
    if not text:
        return ""
    text = _LINK.sub(" ", _TAG.sub(" ", html.unescape(repaired(text))))
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower()
    if any(c in text for c in " .-_*·+~^"):
        text = _SPACED.sub(lambda m: regex.sub(r"[ .\-_*·]", "", m[0]), text)
    text = _MASKED.sub("*", text)
    text = _LEET.sub(lambda m: _undisguised(m[0]), text)
    text = _LETTERS.sub(lambda m: _BROKEN.sub("", m[0]), text)
    return _RUN.sub(r"\1", text)


def tokens(text: str | None) -> list[str]:
    """Words, figures, single characters of scripts without blanks, and ``!`` and ``?``."""
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(plain(text))]


STRETCH = 32


def stretches(word: str) -> list[str]:
    """A word of up to ``STRETCH`` characters as it is; a longer one as stretches of that length, each half over the one before, which cover
    it: whatever lies within half a stretch lies whole in one."""
    if len(word) <= STRETCH:
        return [word]
    step = STRETCH // 2
    return [word[i : i + STRETCH] for i in range(0, len(word) - step, step)]


class Segmenter:
    """Cuts words that were run together into known words, by least cost; leaves what cannot be cut."""

    def __init__(self, costs: dict[str, float], longest: int = 18, at_least: int = 13):
        self.costs, self.at_least = costs, at_least
        self.longest = min(longest, max(map(len, costs), default=1))

    def cut(self, word: str) -> list[str]:
        if len(word) < self.at_least or word in self.costs or not word.isalpha():
            return [word]
        n = len(word)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
        unknown = 14.0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                part = word[start:end]
                cost = best[start][0] + (self.costs.get(part) or unknown + 3.0 * len(part))
                if cost < best[end][0]:
                    best[end] = (cost, start)
        parts, end = [], n
        while end:
            start = best[end][1]
            parts.append(word[start:end])
            end = start
        parts.reverse()
        known = sum(len(p) for p in parts if p in self.costs and len(p) > 1)
        return parts if len(parts) > 2 and known >= 0.7 * n else [word]

    def tokens(self, text: str | None) -> list[str]:
        """Tokens with run-together words cut; what cannot be cut and is longer than ``STRETCH`` comes as overlapping stretches."""
        return [s for t in tokens(text) for p in self.cut(t) for s in stretches(p)]
