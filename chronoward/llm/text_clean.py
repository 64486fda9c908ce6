"""Plain words of wiki-like text: markup, comments, references and entities removed."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash

# a comment or reference that is not closed before the next one opens loses its tag only
_COMMENT = re.compile(r"<!--((?:(?!<!--).)*?)-->", re.S)
_EMPTY_REFERENCE = re.compile(r"<ref\b[^<>]*/>", re.I)
_REFERENCE = re.compile(r"<ref\b[^<>]*>([^<]*(?:<(?!/?ref\b)[^<]*)*)</ref\s*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_CITATION = re.compile(r"\{\{\s*(?:citation needed|cn|fact|clarify|when|who|dubious)\b[^{}]*\}\}", re.I)
_PARAMETER = re.compile(r"\{\{\{[^|{}]*\|?")
_TEMPLATE = re.compile(r"\{\{[^|{}]*\|?(?:text=)?")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_URL_LINK = re.compile(r"\[\s*(?:https?|ftp)://\S+\s*([^\]]*)\]")
_QUOTES = re.compile(r"'{2,}")
#: Invisible characters (soft hyphen, zero-width and direction marks, joiners, BOM).
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)*")


def plain_text(text: str) -> str:
    """``text`` without comments, references, templates' names, link targets and other markup."""
    out = text
    if "<" in out:
        out = _COMMENT.sub("", out).replace("<!--", "")
        out = _REFERENCE.sub("", _EMPTY_REFERENCE.sub("", out))
    if "{{" in out:
        out = _CITATION.sub("", out)
    if "<" in out:
        out = _TAG.sub("", _BREAK.sub(" ", out))
    if "{{" in out or "}}" in out:
        out = _PARAMETER.sub(" ", out).replace("}}}", " ")
        out = _TEMPLATE.sub(" ", out).replace("}}", " ")
    if "[" in out:
        for _ in range(2):  # a link may hold a link
            out = _LINK.sub(r"\1", out)
        out = _URL_LINK.sub(r"\1", out)
    if "&" in out:
        out = html.unescape(out)
    if "''" in out:  # runs of two or three signs need no pattern
        out = _QUOTES.sub("", out) if "''''" in out else out.replace("'''", "").replace("''", "")
    return out if out.isascii() else _INVISIBLE.sub("", out)


def words(text: str | None) -> list[str]:
    """Lower-case words of the plain text; none for null."""
    if not text:
        return []
    plain = plain_text(text).lower()
    return (_WORD if "'" in plain or "’" in plain else _PLAIN_WORD).findall(plain)


#: Signs between words (the others are looked at one word at a time).
_BETWEEN = "[]|<>{}=().,;:/\"#?!*+-_&%~^\\`@$"
_BETWEEN_WIDE = "“”„«»‹›–—…·•‘¡¿"


class WordNumbers(dict):
    """64-bit hashes of the :func:`words` of many texts, each spelling looked at once.

    Spelling -> number of its word; -1 if it holds none, -2 if it holds several.
    """

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self._new: list[int] = []
        self._table = np.zeros(0, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        found = (_WORD if "'" in token or "’" in token else _PLAIN_WORD).findall(token)
        number = len(self._table) + len(self._new) if len(found) == 1 else -1 if not found else -2
        if number >= 0:
            self._new.append(xxhash.xxh64_intdigest(found[0]) - (1 << 63))
        self[token] = number
        return number

    def hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, text of each word); null texts have no words."""
        if len(self) > self.LIMIT:
            self.clear()
            self._table = self._table[:0]
        look_up = self.__getitem__
        numbers: list[int] = []
        sizes: list[int] = []
        for text in texts:
            before = len(numbers)
            if text:
                plain = plain_text(text).lower()
                for sign in _BETWEEN:
                    plain = plain.replace(sign, " ")
                if not plain.isascii():
                    for sign in _BETWEEN_WIDE:
                        plain = plain.replace(sign, " ")
                tokens = plain.split()
                own = list(map(look_up, tokens))
                if -2 in own:
                    pattern = _WORD if "'" in plain or "’" in plain else _PLAIN_WORD
                    own = [look_up(w) for t, n in zip(tokens, own, strict=True) for w in (pattern.findall(t) if n == -2 else (t,))]
                numbers += own
            sizes.append(len(numbers) - before)
        if self._new:
            self._table = np.concatenate([self._table, np.array(self._new, dtype=np.int64)])
            self._new = []
        number = np.array(numbers, dtype=np.int64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        some = number >= 0
        return self._table[number[some]], text_of[some]


_NUMBERS = WordNumbers()


def shared_numbers() -> WordNumbers:
    """The words this Python worker has met in any task, bounded by ``LIMIT``."""
    return _NUMBERS
