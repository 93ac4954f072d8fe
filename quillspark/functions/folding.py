"""Unicode folding shared by the comparing operators.

``fold`` ignores letter case, accents, character width and invisible characters and keeps
punctuation; ``fold_words`` gives its words, ``fold_letters`` its letters and digits only.
"""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_REST = re.compile(r"[\W_]+")
_ASCII_SPACED = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)
_ASCII_REST = bytes(c for c in range(128) if not chr(c).isalnum())


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    out = unicodedata.normalize("NFKD", text.casefold())
    if not out.isascii():
        for c in set(out):
            if c > "\x7f" and unicodedata.category(c) in ("Mn", "Cf"):
                out = out.replace(c, "")
    return out.casefold()


def fold_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = fold(text)
    if text.isascii():
        return text.encode().translate(_ASCII_SPACED).decode().split()
    return _WORD.findall(text)


def fold_letters(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_REST).decode()
    # marks and invisible characters are no word characters and fall out with the punctuation
    return _REST.sub("", unicodedata.normalize("NFKD", text.casefold()).casefold())
