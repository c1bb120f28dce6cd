"""Texts garbled by a wrong character decoding.

Method: what characters turn into under each pair of (true, assumed) encodings is computed once and put into two
multi-pattern automata. The first holds UTF-8 read in single-byte and multi-byte encodings and is matched longest
first; the second holds pairs of letters of single-byte and double-byte encodings read in others, signs that such a
reading puts inside words, and the replacement character. Only matched spans, or the words around them, are replaced,
so correct text stays as it is. Text garbled several times is restored pass by pass: every pass makes the text shorter
in UTF-8, so it ends by itself.

Evidence. A sequence that cannot stand in correct text by chance is strong. One that can (a capital accented letter
before a closing quote, box-drawing or mathematical signs, a lone CJK character, a Cyrillic pair) counts only inside
a word of the other script, next to another sequence, or in a document with a strong sequence of the same pair.
Replacement characters prove a lossy decoding; what they stood for is lost. A hit of the second automaton is a place to
look: the words around it are read again in the encodings that may be meant and count only if they are words of that
script and were none of the one they stood in (letter frequencies, capitals inside words, signs between letters).

Defined results: null, empty and pure ASCII texts are never cases; repeated rows are treated alike; text beyond the
matched spans comes back unchanged, so repairing a correct text returns it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that UTF-8 bytes are taken for. `sloppy` ones keep bytes without a meaning as C1 controls.
SINGLE_BYTE = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7",
    "iso8859-9", "iso8859-15", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "koi8-u",
)
MULTI_BYTE = ("gbk", "big5", "cp932", "cp949", "euc_jp")
#: Single-byte encodings of Cyrillic that are taken for one another.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: Western single-byte pairs (true, assumed) in which accented letters turn into signs inside words.
WESTERN = tuple((a, b) for a in ("cp1252", "mac_roman", "cp850", "cp437") for b in ("cp1252", "mac_roman", "cp850", "cp437") if a != b)
#: Central European pairs of the same kind.
CENTRAL = tuple((a, b) for a in ("cp1250", "iso8859-2", "cp852") for b in ("cp1252", "latin-1"))
#: Encodings of other scripts that are read in a Western one: single-byte ones by script, and double-byte ones.
GREEK = ("cp1253", "iso8859-7")
DOUBLE_BYTE = ("euc_jp", "shift_jis", "euc_kr", "gb2312", "big5")

#: Characters that correct text of the covered languages holds beyond ASCII.
LETTERS = "".join(chr(c) for c in (*range(0xC0, 0x180), 0x218, 0x219, 0x21A, 0x21B, *range(0x391, 0x3CA), *range(0x410, 0x450), 0x401, 0x451)
                  if chr(c).isalpha())
SIGNS = "".join(chr(c) for c in range(0x80, 0xC0)) + "ƒˆ˜ˇ˘˙˛˝×÷‐‑–—―‘’‚“”„†‡•…‰′″‹›⁄€№™←↑→↓∂∆∏∑−√∞∫≈≠≤≥─│┌┐└┘├┤┬┴┼═║■□▪●◦★✓✔﻿​"
TARGETS = LETTERS + SIGNS
#: Signs that correct text may hold right behind a letter.
_CLOSERS = set("”’…»–—™›")
#: Frequencies of Russian letters, per ten thousand, in alphabetical order from а to я with ё last (fixed values).
_RUSSIAN = [801, 159, 454, 170, 298, 845, 94, 165, 735, 121, 349, 440, 321, 670, 1097, 281, 473, 547, 626, 262, 26, 97, 48, 144, 73, 36, 4, 190, 174, 32, 64, 201, 4]
_CYRILLIC_LOG = {c: math.log(n / 10000) for c, n in zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", _RUSSIAN)}
#: Frequencies, per ten thousand, of letters of the other Cyrillic alphabets (fixed values).
_OTHERS = {"і": 575, "ї": 65, "є": 61, "ґ": 5, "ў": 120, "ј": 510, "љ": 54, "њ": 61, "ћ": 65, "ђ": 22, "џ": 5, "ѕ": 5, "ѓ": 10, "ќ": 20}
_ANY_CYRILLIC_LOG = _CYRILLIC_LOG | {c: math.log(n / 10000) for c, n in _OTHERS.items()}
#: Frequencies of Greek letters without accents, per ten thousand, from α to ω with ς last (fixed values).
_GREEK = [1200, 60, 170, 170, 840, 50, 490, 130, 900, 410, 290, 340, 640, 60, 980, 400, 430, 490, 790, 430, 80, 120, 10, 200, 340]
_GREEK_LOG = {c: math.log(n / 10000) for c, n in zip("αβγδεζηθικλμνξοπρστυφχψως", _GREEK)}
#: Frequent characters that tell double-byte readings apart (fixed values).
_FREQUENT = {"euc_kr": "이가는을를다의에하고요은니로한지기사도서", "gb2312": "的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年", "big5": "的一是不了在人有我他這中大來上國個到說們為子和你地出道也時年", "shift_jis": "のにはをたがでてとしれさるなもこいりすんくまっ", "euc_jp": "のにはをたがでてとしれさるなもこいりすんくまっ"}
_FLOOR = math.log(2e-5)
#: Mean log frequency that Russian phrases exceed.
LIKELY = -3.8

_LONG_RUN = re.compile(r"[^\x00-\x7f]{6,}")
_CYRILLIC_PHRASE = re.compile(r"[Ѐ-ӿ]+(?:[ ,.!?;:()\"'-]{1,3}[Ѐ-ӿ]+)*")
_HIGH = "\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_HIGH_PHRASE = re.compile(rf"(?<![A-Za-z0-9{_HIGH}])[{_HIGH}]+(?:[ ,.!?;:()\"'-]{{1,3}}[{_HIGH}]+)*(?![A-Za-z0-9{_HIGH}])")
_LETTER_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = "�"
_CJK = re.compile("[⺀-鿿가-힯豈-﫿｡-ﾟ]")


def sloppy(data: bytes, encoding: str) -> str:
    """`data` decoded byte by byte, bytes without a meaning as C1 controls."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _strong(garbled: str) -> bool:
    """Whether the sequence cannot stand in correct text by chance, whatever is around it."""
    if len(garbled) > 2:
        return not all("─" <= c <= "▟" for c in garbled)
    lead, tail = garbled
    if "─" <= lead <= "▟" and "─" <= tail <= "▟":
        return False
    if lead in "√¬":
        return tail.isalpha() and tail not in "πΩƒªº" or tail in "©®™"
    if "Ѐ" <= lead <= "ӿ":
        return not (tail.isalpha() or tail in _CLOSERS or tail in "«“„")
    if "Α" <= lead <= "ω":
        return not (tail.isalpha() or tail in _CLOSERS)
    if not lead.isalpha():
        return False
    if tail in _CLOSERS or tail in "“‘" and lead not in "ÃÅ":
        return False
    return not tail.isalpha() or tail in "ĂÃÂÐ" or not (lead.isupper() and tail.isupper())


def _plain_letters(garbled: str) -> bool:
    """Whether it is two letters that one correct word may well hold side by side."""
    return len(garbled) == 2 and (all(c in _ANY_CYRILLIC_LOG for c in garbled.lower()) or all("À" <= c <= "ÿ" and c.isalpha() for c in garbled))


class Sequence:
    """A garbled sequence: what it stands for by encoding, and how much it proves."""

    def __init__(self, text: str, strong: bool, multi: bool, plain: bool = False):
        self.text, self.strong, self.multi, self.plain = text, strong, multi, plain
        self.targets: dict[str, str] = {}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Every garbled sequence as a `Sequence`."""
    found: dict[str, Sequence] = {}

    def add(garbled: str, encoding: str, target: str, strong: bool, multi: bool, plain: bool = False) -> None:
        if not garbled.isascii() and (garbled not in found or found[garbled].multi == multi):
            found.setdefault(garbled, Sequence(garbled, strong, multi, plain)).targets.setdefault(encoding, target)

    for encoding in SINGLE_BYTE:
        for target in TARGETS:
            garbled = sloppy(target.encode("utf-8"), encoding)
            # in cp1251 such a pair is a common Russian letter; one that stands next to others is no chance
            plain = _plain_letters(garbled) and encoding != "cp1251"
            add(garbled, encoding, target, not plain and _strong(garbled), False, plain)
    for encoding in MULTI_BYTE:
        for target in TARGETS:
            data = target.encode("utf-8")
            try:
                garbled = data[:2].decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(data) == 3:
                if data[:2] not in (b"\xe2\x80", b"\xe2\x82", b"\xe2\x84", b"\xe2\x88", b"\xe2\x89"):
                    continue
                add(garbled, encoding, "", True, True)
                for low in range(0x20, 0x7F):
                    # the third byte and the character behind it are read as one
                    try:
                        pair = (data[2:] + bytes([low])).decode(encoding)
                    except UnicodeDecodeError:
                        continue
                    if len(pair) == 1:
                        add(garbled + pair, encoding, target + chr(low), True, True)
            elif len(garbled) == 1 or encoding in ("cp932", "euc_jp") and len(garbled) == 2:
                add(garbled, encoding, target, False, True)
        for second in range(0x80, 0x84):
            # the first two bytes of kana and CJK punctuation
            try:
                garbled = bytes([0xE3, second]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(garbled) == 1:
                add(garbled, encoding, "", True, True)
    machine = ahocorasick.Automaton()
    for garbled, sequence in found.items():
        machine.add_word(garbled, sequence)
    machine.make_automaton()
    return machine


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def sequences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, original) of each garbled sequence with enough evidence, in order and apart.

    Every proven sequence speaks for the encodings that it may come from; a sequence stands for what it is in the
    encoding for which most of the text speaks.
    """
    hits = [(end + 1 - len(s.text), end + 1, s) for end, s in automaton().iter_long(text)]
    if not hits:
        return []
    proven: Counter[str] = Counter()
    for k, (start, end, s) in enumerate(hits):
        if s.strong or not s.plain and _evident(text, hits, k):
            proven.update(s.targets.keys())
    if not proven:
        return []
    best = max(proven.values())
    any_multi = any(e in MULTI_BYTE for e in proven)
    out = whole_runs(text, [e for e in MULTI_BYTE if e in proven])
    taken = {i for start, end, _ in out for i in range(start, end)}
    for start, end, s in hits:
        if start in taken or end - 1 in taken:
            continue
        known = [e for e in s.targets if e in proven]
        if s.plain:
            known = [e for e in known if proven[e] == best]
        if known:
            out.append((start, end, s.targets[max(known, key=lambda e: proven[e])]))
        elif s.multi and any_multi:
            out.append((start, end, next(iter(s.targets.values()))))
    return sorted(out)


def whole_runs(text: str, encodings: list[str]) -> list[tuple[int, int, str]]:
    """Runs beyond ASCII, with the character behind them if need be, that are UTF-8 read in a multi-byte encoding."""
    out = []
    for m in _LETTER_RUN.finditer(text) if encodings else ():
        for encoding in encodings:
            for end in (m.end(), m.end() + 1):
                try:
                    again = text[m.start() : end].encode(encoding).decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                if again != text[m.start() : end]:
                    out.append((m.start(), min(end, len(text)), again))
                    break
            else:
                continue
            break
    return out


def _evident(text: str, hits: list[tuple[int, int, Sequence]], k: int) -> bool:
    """Whether a sequence that may be correct text is proven by what stands next to it."""
    start, end, s = hits[k]
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    near = k and hits[k - 1][1] == start and not hits[k - 1][2].plain or k + 1 < len(hits) and hits[k + 1][0] == end and not hits[k + 1][2].plain
    inside = _letter(before) or _letter(after)
    lead, letter = text[start], all(t.isalpha() for t in s.targets.values())
    if s.multi:
        if (_CJK.match(before) or _CJK.match(after)) and not near:
            return False
        return letter and inside
    if "Ѐ" <= lead <= "ӿ" or lead in "–—─═":
        return bool(near)
    if lead.isalpha():
        return bool(near or _letter(after))
    return bool(near or letter and inside and lead != "¬")


@lru_cache(maxsize=1)
def places() -> ahocorasick.Automaton:
    """Where to look: what is garbled there as "lost", "cjk", "high", "cyrillic" or "inner"."""
    found: dict[str, str] = {"\ufffd": "lost"}
    for sign in _SIGN_TARGETS:
        found[sign] = "inner"
    found["Ã "] = "inner"
    for capital in "".join(chr(c) for c in (*range(0xC0, 0xDF), 0x160, 0x17D, 0x152, 0x178) if c != 0xD7):
        for small in "abcdefghijklmnopqrstuvwxyz":
            found[small + capital] = "inner"
    for encoding in SINGLE_BYTE:
        for lead in range(0xE3, 0xF0):
            for second in range(0x80, 0xC0):
                found.setdefault(sloppy(bytes([lead, second]), encoding), "cjk")
    letters = [chr(c) for c in (*range(0x410, 0x450), 0x401, 0x451)]
    pairs = [a + b for a in letters for b in letters if b.islower()]
    for true in CYRILLIC:
        for assumed in CYRILLIC:
            if true == assumed:
                continue
            table = {c: sloppy(c.encode(true), assumed) for c in letters}
            for a, b in pairs:
                garbled = table[a] + table[b]
                # what a correct word holds is no place to look
                if not (garbled.isalpha() and garbled[1].islower()):
                    found.setdefault(garbled, "cyrillic")
    high = bytes(range(0x80, 0x100))
    for assumed in ("cp1252", "latin-1", "mac_roman"):
        table = sloppy(high, assumed)
        for a in table:
            for b in table:
                if not (a + b).isspace():
                    found[a + b] = "high+cjk" if found.get(a + b) in ("cjk", "high+cjk") else "high"
    machine = ahocorasick.Automaton()
    for garbled, kind in found.items():
        if not garbled.isascii():
            machine.add_word(garbled, kind)
    machine.make_automaton()
    return machine


def _regular(word: str) -> bool:
    """Whether small and capital letters stand as words have them."""
    return word[1:].islower() or word.isupper() or len(word) == 1


def _likely(phrase: str, log: dict[str, float]) -> float:
    """Mean log frequency of a phrase's letters beyond ASCII, less in words of mixed case."""
    total, n = 0.0, 0
    for word in _LETTER_RUN.findall(phrase):
        total += sum(log.get(c, _FLOOR) for c in word.lower())
        if not _regular(word):
            total -= 2.0 * len(word)
        n += len(word)
    return total / max(1, n)


def _bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def cyrillic_rereadings(text: str) -> list[tuple[int, int, str]]:
    """Phrases of Cyrillic read in another Cyrillic encoding, with their text read again.

    The pair of encodings that gains most over the document stands. A phrase that is likely in any Cyrillic alphabet as
    it is doesn't gain, so correct text of each of them is left alone.
    """
    best: list[tuple[int, int, str]] = []
    gain = 0.0
    phrases = [m.span() for m in _CYRILLIC_PHRASE.finditer(text)]
    for true in CYRILLIC if phrases else ():
        for assumed in CYRILLIC:
            if true == assumed:
                continue
            out, better, letters = [], 0.0, 0
            for start, end in phrases:
                phrase = text[start:end]
                again = _again(phrase, true, assumed)
                n = sum(c.lower() in _CYRILLIC_LOG for c in again)
                if not n or n != sum(not c.isascii() for c in again):
                    continue
                before, after = _likely(phrase, _ANY_CYRILLIC_LOG), _likely(again, _CYRILLIC_LOG)
                more = after - before
                # beside proven phrases, those that lose nothing by it
                if more > -0.3:
                    out.append((start, end, again))
                if more > 0.5 and after > LIKELY and len(set(again)) > 4:
                    better += more * n
                    letters += n
            if letters >= 5 and better > max(gain, 5.0):
                best, gain = out, better
    return best


def _again(text: str, true: str, assumed: str) -> str:
    """`text` read in `true` instead of `assumed`; empty where that cannot be."""
    data = _bytes_of(text, assumed)
    try:
        return "" if data is None else data.decode(true)
    except UnicodeDecodeError:
        return ""


def high_rereadings(text: str) -> list[tuple[int, int, str]]:
    """Phrases of Western accented letters and signs that are words of another script, with their text read again.

    Such a phrase has no ASCII letter, a run of four or more characters and isn't UTF-8; the reading in which it is
    likeliest stands. Shorter and rarer phrases follow the reading that most of the document's phrases have.
    """
    out, rest = [], []
    votes: Counter[tuple[str, str]] = Counter()
    for m in _HIGH_PHRASE.finditer(text):
        phrase = m.group()
        ways = [(a, data) for a in ("cp1252", "latin-1", "mac_roman") if (data := _bytes_of(phrase, a)) is not None]
        if any(_is_utf8(data) for _, data in ways):
            continue
        longest = max(map(len, _LETTER_RUN.findall(phrase)))
        best, value, pair = "", LIKELY, None
        for assumed, data in ways if longest >= 4 else ():
            for encodings, log in _SCRIPTS:
                for true in encodings:
                    v, again = _as_script(data, true, log, 4)
                    if again and v > value:
                        best, value, pair = again, v, (true, assumed)
            if best:
                break
            if not all(c.isalpha() or c.isascii() for c in phrase) or longest >= 8:
                n = 0
                for true in DOUBLE_BYTE:
                    read = _double(data, true)
                    common = sum(c in _FREQUENT[true] for c in read)
                    if read and (common, not best) > (n, False) and (common or longest >= 6):
                        best, n, pair = read, common, (true, assumed)
            if best:
                break
        if best:
            out.append((*m.span(), best))
            votes[pair] += 1
        else:
            rest.append((m, dict(ways)))
    if not votes:
        return out
    true, assumed = votes.most_common(1)[0][0]
    for m, ways in rest:
        if assumed in ways:
            log = next((log for encodings, log in _SCRIPTS if true in encodings), None)
            again = _as_script(ways[assumed], true, log, 1)[1] if log else _double(ways[assumed], true)
            if again:
                out.append((*m.span(), again))
    return sorted(out)


_SCRIPTS = ((CYRILLIC, _CYRILLIC_LOG), (GREEK, _GREEK_LOG))


def _as_script(data: bytes, true: str, log: dict[str, float], different: int) -> tuple[float, str]:
    """(mean log frequency, text) of `data` read in `true` if it is words of that script with enough different letters."""
    try:
        again = data.decode(true)
    except UnicodeDecodeError:
        return _FLOOR, ""
    plain = _bare(again) if log is _GREEK_LOG else again
    words = _LETTER_RUN.findall(plain)
    if not words or not all(c.lower() in log for w in words for c in w) or len(set("".join(words).lower())) < different or not all(map(_regular, words)):
        return _FLOOR, ""
    return _likely(plain, log), again


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _double(data: bytes, encoding: str) -> str:
    """`data` in a double-byte encoding if all of it beyond ASCII is of the characters in everyday use there."""
    try:
        read = data.decode(encoding)
    except UnicodeDecodeError:
        return ""
    wide = [c for c in read if not c.isascii()]
    if len(wide) < 2:
        return ""
    for c in wide:
        lead = c.encode(encoding)[0]
        kana = "\u3001" <= c <= "\u30ff"
        if encoding == "euc_kr" and not "가" <= c <= "힣":
            return ""
        if encoding == "gb2312" and not (0xB0 <= lead <= 0xD7 or lead in (0xA1, 0xA3)):
            return ""
        if encoding == "big5" and not (0xA4 <= lead <= 0xC6 or lead in (0xA1, 0xA2)):
            return ""
        if encoding == "euc_jp" and not (kana or 0xB0 <= lead <= 0xCF):
            return ""
        if encoding == "shift_jis" and not (kana or 0x88 <= lead <= 0x97):
            return ""
    if encoding in ("euc_jp", "shift_jis") and not any("\u3041" <= c <= "\u30ff" for c in wide):
        return ""
    return read


def foreign(text: str) -> list[tuple[int, int, str]]:
    """Runs that are two or more CJK characters in UTF-8, read in a single-byte encoding."""
    out = []
    for m in _LONG_RUN.finditer(text):
        if all(c.isalpha() and "Ͱ" <= c <= "ӿ" for c in m.group()):
            continue
        for encoding in SINGLE_BYTE:
            data = _bytes_of(m.group(), encoding)
            if data is None:
                continue
            try:
                again = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(again) > 1 and all(_CJK.match(c) or "\u3000" <= c <= "\u30ff" or "\uff00" <= c <= "\uffef" for c in again):
                out.append((*m.span(), again))
                break
    return out


def _bytes_of(text: str, encoding: str) -> bytes | None:
    """The bytes that `sloppy` reads as `text`."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def inner_rereadings(text: str) -> list[tuple[int, int, str]]:
    """Words with a sign, or a capital, where a Western or Central European pair would have put an accented letter.

    A sign between letters proves a pair, capitals inside words only together. The pair that makes letters of most such
    words stands for the document; the other words that it makes regular, and that weren't, are read again as well.
    """
    out, signs, odd = [], set(), set()
    for m in _SIGN_IN_WORD.finditer(text):
        if m.group(2):
            out.append((m.start(2), m.end(2), "à"))
        else:
            (signs if m.group(1) else odd).add(_word_at(text, m.start()))
    proven = signs | odd if len(signs) + len(odd) > 1 else signs
    if not proven:
        return out
    votes: Counter[tuple[str, str]] = Counter()
    readings = {}
    for a, b in proven:
        readings[a, b] = own = {pair: again for pair in (*WESTERN, *CENTRAL) if (again := _reread_word(text[a:b], pair))}
        votes.update(own.keys())
    order = {pair: k for k, pair in enumerate((*WESTERN, *CENTRAL))}
    ranked = sorted(votes, key=lambda p: (-votes[p], order[p]))
    done = {}
    for span, own in readings.items():
        pair = next((p for p in ranked if p in own), None)
        if pair is not None:
            done[span] = own[pair]
    for a, b in signs - done.keys():
        known = [(i, _SIGN_TARGETS[text[i]][0]) for i in range(a, b) if text[i] in _SIGN_TARGETS and a < i]
        for i, letter in known:
            done[i, i + 1] = letter
    for m in _MIXED_WORD.finditer(text) if ranked and done else ():
        if m.span() not in done and not (m.group().isalpha() and _regular(m.group())):
            again = _reread_word(m.group(), ranked[0])
            if again and not any(a < m.end() and m.start() < b for a, b in done):
                done[m.span()] = again
    return sorted([*out, *((a, b, again) for (a, b), again in done.items())])


def _word_at(text: str, at: int) -> tuple[int, int]:
    """The span of letters and signs around a place."""
    a = b = at
    while a and (text[a - 1].isalpha() or text[a - 1] in _SIGN_TARGETS):
        a -= 1
    while b < len(text) and (text[b].isalpha() or text[b] in _SIGN_TARGETS):
        b += 1
    return a, b


def _reread_word(word: str, pair: tuple[str, str]) -> str:
    """The word read again where that gives a regular word of known letters, else nothing."""
    again = _again(word, *pair)
    good = again != word and again.isalpha() and _regular(again) and all(x in _TARGET_LETTERS for x in again.lower() if not x.isascii())
    return again if good else ""


#: What a sign inside a word may stand for, by sign, and all such letters.
_SIGN_TARGETS: dict[str, list[str]] = {}
_TARGET_LETTERS = set("äöüéèêàáíóúñçãõâîôûïëåßøæœąćęłńśźżěščřžýůďťňőű")
for _true, _assumed in (*WESTERN, *CENTRAL):
    for _c in "äöüéèêàáíóúñçãõâîôûïëåßøæœąćęłńśźżěščřžýůďťňőű":
        try:
            _g = _c.encode(_true).decode(_assumed)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if not _g.isalpha() and not _g.isspace() and not _g.isascii() and _g not in _CLOSERS and _g not in "·\xad‐‑":
            _SIGN_TARGETS.setdefault(_g, []).append(_c)
_SIGNS_OF = re.escape("".join(_SIGN_TARGETS))
#: A sign between letters or a block at a word's end; an à whose second character was taken for a blank; a capital
#: between small letters.
_SIGN_IN_WORD = re.compile(
    f"((?<=[A-Za-z])[{_SIGNS_OF}](?=[a-zà-ÿšžœ])|(?<=[a-zà-ÿšžœ])[{_SIGNS_OF}](?=[a-z])|(?<=[a-z])▀)"
    "|((?<![^ \\n(«“\"a-z])Ã)(?= [a-z])|(?<=[a-z])[À-ÖØ-ÞŠŽŒŸ](?=[a-z])"
)
_MIXED_WORD = re.compile(f"(?:[^\\W\\d_]|[{_SIGNS_OF}”’\x80-\x9f])*[^\x00-\x7f](?:[^\\W\\d_]|[{_SIGNS_OF}”’\x80-\x9f])*")


def repair(text: str) -> tuple[str, int, int, bool]:
    """(restored text, sequences replaced, characters lost, whether anything is garbled)."""
    whole, counts = restored(text)
    lost = counts.pop("lost", 0)
    replaced = sum(counts.values())
    return whole, replaced, lost, bool(replaced or lost)


def restored(text: str) -> tuple[str, dict[str, int]]:
    """(restored text, spans by what found them: utf, cjk, cyrillic, high, inner; lost counts replacement characters)."""
    counts: Counter[str] = Counter()
    kinds = {k for _, kind in places().iter(text) for k in kind.split("+")} if not text.isascii() else set()
    if "lost" in kinds:
        counts["lost"] = text.count(_LOST)
    text = _found(text, "high", high_rereadings, kinds, counts)
    wide = "cjk" in kinds
    while not text.isascii():
        spans, name = foreign(text) if wide else [], "cjk"
        if not spans:
            spans, name = sequences(text), "utf"
        if not spans:
            break
        again = _replace(text, spans)
        counts[name] += len(spans)
        if len(again.encode("utf-8", "surrogatepass")) >= len(text.encode("utf-8", "surrogatepass")):
            break
        text = again
        wide = True
    text = _found(text, "cyrillic", cyrillic_rereadings, kinds, counts)
    text = _found(text, "inner", inner_rereadings, kinds, counts)
    return text, dict(counts)


def _found(text: str, name: str, find, kinds: set[str], counts: Counter) -> str:
    spans = find(text) if name in kinds else []
    if spans:
        counts[name] += len(spans)
        text = _replace(text, spans)
    return text


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, original in spans:
        parts += [text[at:start], original or text[start:end]]
        at = end
    return "".join([*parts, text[at:]])


def find_garbled(df: DataFrame, key: list[Column], text: Column, restore: bool = True) -> DataFrame:
    """(key columns, n_replaced, n_lost[, restored]) of the rows with garbled text; one pass without a shuffle.

    Pure ASCII texts are left out before they reach Python.
    """
    slim = df.select(F.struct(*key).alias("key"), text.alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    fields = [slim.schema["key"], T.StructField("n_replaced", T.IntegerType()), T.StructField("n_lost", T.IntegerType())]
    if restore:
        fields.append(T.StructField("restored", T.StringType()))
    schema = T.StructType(fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, replaced, lost, restored = [], [], [], []
            for row, body in enumerate(batch.column("text").to_pylist()):
                whole, n, gone, garbled = repair(body)
                if garbled:
                    rows.append(row)
                    replaced.append(n)
                    lost.append(gone)
                    restored.append(whole)
            if rows:
                arrays = [batch.column("key").take(pa.array(rows)), pa.array(replaced, pa.int32()), pa.array(lost, pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(restored, pa.string())] if restore else [])], schema.names)

    names = [f.name for f in slim.schema["key"].dataType.fields]
    return slim.mapInArrow(search, schema).select(*(F.col("key")[c].alias(c) for c in names), *schema.names[1:])
