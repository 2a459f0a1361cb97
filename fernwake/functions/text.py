"""Words of texts, compared without case, accents, typographic variants and markup."""

from __future__ import annotations

import re
import unicodedata

TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*[\r\n]+\s*")
# Letters that Unicode does not take apart, and signs inside words that are not seen.
LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "­": None, "‌": None, "‍": None, "﻿": None})


def plain(text: str) -> str:
    """``text`` without tags, case and accents, ligatures and letter variants taken apart."""
    t = TAG.sub(" ", text)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", t).casefold()).translate(LETTERS)
        return "".join(c for c in t if not unicodedata.combining(c))
    return t.lower()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain text."""
    return WORD.findall(plain(text))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; a sentence ends at a full stop, question or exclamation mark, or a line's end."""
    return [w for w in (WORD.findall(s) for s in SENTENCE.split(plain(text))) if w]
