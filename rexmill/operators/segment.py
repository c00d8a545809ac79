"""Grapheme clusters and words (UAX #29 rules over the categories Python knows)."""

from __future__ import annotations

import functools
import unicodedata

from ..plans.charset import PICTOGRAPHIC, cat

#: Prepended concatenation marks (fixed values).
_PREPEND = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_MID_LETTER, _MID_NUM, _MID_BOTH = set(":··՟״‧︓﹕："), set(",;;։،؍٬߸⁄︐︔﹐﹔，；"), set(".‘’․﹒＇．")


@functools.lru_cache(65536)
def grapheme_class(c: str) -> str:
    cp = ord(c)
    if c == "\r":
        return "CR"
    if c == "\n":
        return "LF"
    if cp == 0x200D:
        return "ZWJ"
    if 0x1F1E6 <= cp <= 0x1F1FF:
        return "RI"
    if 0x1100 <= cp <= 0x115F or 0xA960 <= cp <= 0xA97C:
        return "L"
    if 0x1160 <= cp <= 0x11A7 or 0xD7B0 <= cp <= 0xD7C6:
        return "V"
    if 0x11A8 <= cp <= 0x11FF or 0xD7CB <= cp <= 0xD7FB:
        return "T"
    if 0xAC00 <= cp <= 0xD7A3:
        return "LV" if (cp - 0xAC00) % 28 == 0 else "LVT"
    if cp in _PREPEND:
        return "Prepend"
    k = cat(cp)
    if k in ("Mn", "Me") or 0x1F3FB <= cp <= 0x1F3FF or cp == 0x200C or 0xE0020 <= cp <= 0xE007F:
        return "Extend"
    if k == "Mc":
        return "SpacingMark"
    if k in ("Cc", "Zl", "Zp"):
        return "Control"
    if k == "Cf":
        return "Extend"
    return "Picto" if PICTOGRAPHIC.test(cp) else "Any"


def grapheme_boundary(s: str, i: int) -> bool:
    if i <= 0 or i >= len(s):
        return bool(s) or i == 0
    a, b = grapheme_class(s[i - 1]), grapheme_class(s[i])
    if a == "CR" and b == "LF":
        return False
    if a in ("Control", "CR", "LF") or b in ("Control", "CR", "LF"):
        return True
    if (a == "L" and b in ("L", "V", "LV", "LVT")) or (a in ("LV", "V") and b in ("V", "T")) or (a in ("LVT", "T") and b == "T"):
        return False
    if b in ("Extend", "ZWJ", "SpacingMark") or a == "Prepend":
        return False
    if a == "ZWJ" and b == "Picto":
        j = i - 2
        while j >= 0 and grapheme_class(s[j]) == "Extend":
            j -= 1
        return not (j >= 0 and grapheme_class(s[j]) == "Picto")
    if a == b == "RI":
        j = i - 1
        while j >= 0 and grapheme_class(s[j]) == "RI":
            j -= 1
        return (i - 1 - j) % 2 == 0
    return True


@functools.lru_cache(65536)
def word_class(c: str) -> str:
    cp, k = ord(c), cat(ord(c))
    if c in "\r\n":
        return "CR" if c == "\r" else "LF"
    if c in "\x0b\x0c\x85  ":
        return "Newline"
    if cp == 0x200D:
        return "ZWJ"
    if 0x1F1E6 <= cp <= 0x1F1FF:
        return "RI"
    if k in ("Mn", "Me", "Mc") or 0x1F3FB <= cp <= 0x1F3FF or cp == 0x200C:
        return "Extend"
    if k == "Cf" and cp != 0x200B:
        return "Format"
    name = unicodedata.name(c, "")
    if name.startswith(("KATAKANA", "HALFWIDTH KATAKANA")) or cp in (0x309B, 0x309C, 0x30FC):
        return "Katakana"
    if name.startswith("HEBREW LETTER"):
        return "Hebrew"
    if c == "'":
        return "Single"
    if c == '"':
        return "Double"
    if c in _MID_BOTH:
        return "MidNumLet"
    if c in _MID_LETTER:
        return "MidLetter"
    if c in _MID_NUM:
        return "MidNum"
    if k == "Nd":
        return "Numeric"
    if k == "Pc" or cp == 0x202F:
        return "ExtendNumLet"
    if k == "Zs" and cp != 0xA0:
        return "Space"
    if k[0] == "L" or k == "Nl":
        if name.startswith(("CJK", "HIRAGANA", "THAI", "LAO", "KHMER", "MYANMAR")):
            return "Any"
        return "ALetter"
    return "Any"


_LETTER = ("ALetter", "Hebrew")


def word_boundary(s: str, i: int) -> bool:
    if i <= 0 or i >= len(s):
        return bool(s) or i == 0
    a, b = word_class(s[i - 1]), word_class(s[i])
    if a == "CR" and b == "LF":
        return False
    if a in ("CR", "LF", "Newline") or b in ("CR", "LF", "Newline"):
        return True
    if a == "ZWJ" and PICTOGRAPHIC.test(ord(s[i])):
        return False
    if a == b == "Space":
        return False
    skip = ("Extend", "Format", "ZWJ")
    if b in skip:
        return False

    def before(j):
        while j >= 0 and word_class(s[j]) in skip:
            j -= 1
        return j

    def after(j):
        while j < len(s) and word_class(s[j]) in skip:
            j += 1
        return word_class(s[j]) if j < len(s) else ""

    j = before(i - 1)
    a = word_class(s[j]) if j >= 0 else ""
    k = before(j - 1)
    aa, bb = (word_class(s[k]) if k >= 0 else ""), after(i + 1)
    if a in _LETTER and b in _LETTER:
        return False
    if a in _LETTER and b in ("MidLetter", "MidNumLet", "Single") and bb in _LETTER:
        return False
    if aa in _LETTER and a in ("MidLetter", "MidNumLet", "Single") and b in _LETTER:
        return False
    if a == "Hebrew" and (b == "Single" or (b == "Double" and bb == "Hebrew")) or (aa == "Hebrew" and a == "Double" and b == "Hebrew"):
        return False
    if (a == "Numeric" and b in ("Numeric", *_LETTER)) or (a in _LETTER and b == "Numeric"):
        return False
    if aa == "Numeric" and a in ("MidNum", "MidNumLet", "Single") and b == "Numeric":
        return False
    if a == "Numeric" and b in ("MidNum", "MidNumLet", "Single") and bb == "Numeric":
        return False
    if a == b == "Katakana" or (b == "ExtendNumLet" and a in (*_LETTER, "Numeric", "Katakana", "ExtendNumLet")) or (a == "ExtendNumLet" and b in (*_LETTER, "Numeric", "Katakana")):
        return False
    if a == b == "RI":
        n = 0
        while j >= 0 and word_class(s[j]) == "RI":
            n, j = n + 1, before(j - 1)
        return n % 2 == 0
    return True


def boundary(s: str, i: int, kind: str) -> bool:
    return (word_boundary if kind == "w" else grapheme_boundary)(s, i)


def segment_end(s: str, i: int, kind: str) -> int:
    j = i + 1
    while j < len(s) and not boundary(s, j, kind):
        j += 1
    return j
