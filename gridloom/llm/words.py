"""Texts as sequences of plain words: markup, quoting, case, punctuation and character variants gone."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e", "ї": "i",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ℓ": "l", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
_LOOK = str.maketrans(LOOKALIKES)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>|\[/?[a-zA-Z*]{1,10}(?:=[^\[\]]*)?\]")
_LINK = re.compile(r"\]\(\s*[^()\s]+\s*\)|\b(?:https?|ftp)://\S+|\bwww\.\S+", re.I)
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_MARK = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text without markup, accents, invisible characters and case."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    text = _LINK.sub(" ", _TAG.sub(" ", text))
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        return _MARK.sub("", text).casefold().translate(_LOOK)
    return text.lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []
