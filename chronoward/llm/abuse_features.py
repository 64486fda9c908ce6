"""Dense features of abusive, hateful or sexual language, for a batch of whole texts.

Words are looked up once each (disguises undone: look-alike letters, digits for
letters, spaced, masked, repeated or hyphenated letters, markup inside words) and
carry bits of the lexicons' categories. Everything after that is array work over the
words of all texts of a batch: densities, the fullest window of a few words, pairs of
categories that meet in one window (an insult and an addressee, violence and a
speaker), and words and word pairs whose weight was learned from labels.
"""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import chain

import numpy as np
import xxhash

from chronoward.llm.abuse_lexicon import CATEGORIES, LEET, LOOK_ALIKE

BIT = {name: i for i, name in enumerate(CATEGORIES)}
#: Words in a window; a sentence or a short remark.
WINDOW = 14
#: Words to either side of a hit that may show an addressee or a neutral register.
REACH = 8

_LOOK_ALIKE_TABLE = str.maketrans(LOOK_ALIKE)
_LOOK_ALIKE_CHAR = re.compile("[" + "".join(LOOK_ALIKE) + "]")
#: Invisible characters (soft hyphen, zero-width and direction marks, joiners, BOM).
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_QUOTES = re.compile(r"''+(?=\w)")
_COMMENT = re.compile(r"<!--((?:(?!<!--).)*?)-->", re.S)
_STYLE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|span|small|sup|sub|font|nowiki)\b[^<>]*>", re.I)
_LINK_END = re.compile(r"\]\](?=\w)")
_SPACED = re.compile(r"(?<![\w*])[^\W_]([ .·_-])[^\W_](?:\1[^\W_])+(?![\w*])")
#: Signs between words; the others may belong to a disguised word.
_BETWEEN = "[]|<>{}=().,;:/\"#?&%~^\\`"
_BETWEEN_WIDE = "“”„«»‹›–—…·•‘¡¿"
_LONG_REPEAT = re.compile(r"(.)\1\1+")
_REPEAT = re.compile(r"(.)\1+")


def _bare(word: str) -> str:
    """``word`` without accents."""
    plain = unicodedata.normalize("NFD", word.replace("ß", "ss"))
    return "".join(c for c in plain if not unicodedata.combining(c))


def _tables() -> tuple[dict[str, int], dict[str, int]]:
    """(whole words, stems) with the bits of their categories; long words also without accents."""
    exact: dict[str, int] = {}
    stems: dict[str, int] = {}
    for name, words in CATEGORIES.items():
        for word in words:
            target, form = (stems, word[:-1]) if word.endswith("*") else (exact, word)
            for f in {form, _bare(form) if len(form) > 4 else form}:
                target[f] = target.get(f, 0) | 1 << BIT[name]
    return exact, stems


_EXACT, _STEMS = _tables()
_SHORTEST_STEM = min(map(len, _STEMS))
_STRONG = sum(1 << BIT[c] for c in ("insult", "dehumanise", "profane", "sexual"))
#: What the lexicons know, for cutting and unmasking.
_KNOWN = {w: b for table in (_STEMS, _EXACT) for w, b in table.items() if len(w) > 1}
_LONGEST = max(map(len, _KNOWN))
_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(_KNOWN):
    if _KNOWN[_w] & (_STRONG | 1 << BIT["violence"]):
        _BY_LENGTH.setdefault(len(_w), []).append(_w)


def category_bits(word: str) -> int:
    """Bits of the categories of a lower-case word."""
    bits = _EXACT.get(word, 0)
    for size in range(len(word), _SHORTEST_STEM - 1, -1):
        stem = _STEMS.get(word[:size])
        if stem:
            return bits | stem
    return bits


def _cut(run: str) -> str:
    """Letters without spaces as words: the longest known word first, the rest as it is."""
    low = run.lower()
    out, unknown, i = [], "", 0
    while i < len(low):
        for size in range(min(_LONGEST, len(low) - i), 1, -1):
            if low[i : i + size] in _KNOWN and (size > 2 or not unknown):
                if unknown:
                    out.append(unknown)
                    unknown = ""
                out.append(low[i : i + size])
                i += size
                break
        else:
            unknown += low[i]
            i += 1
    if unknown:
        out.append(unknown)
    return " ".join(out)


def _unmask(token: str) -> str:
    """The known word that a token with stars may stand for, or the token."""
    for word in _BY_LENGTH.get(len(token), ()):
        if all(a in ("*", b) for a, b in zip(token, word, strict=True)):
            return word
    for size in range(len(token) - 1, 3, -1):  # a known stem with an ending
        if token[size:].isalpha():
            for word in _BY_LENGTH.get(size, ()):
                if word in _STEMS and all(a in ("*", b) for a, b in zip(token, word, strict=False)):
                    return word
    return token


#: Kinds of disguise of one word.
LEETED, MASKED, REPEATED, HYPHENED = 1, 2, 4, 8


def canonical(token: str) -> tuple[str, int, int]:
    """(lower-case word without disguise, category bits, kinds of disguise)."""
    low = token.lower()
    kinds = 0
    if not low.isalpha():
        inner = low.rstrip("*")
        if "*" in inner or low.count("*") > 1:
            kinds |= MASKED
            low = _unmask(low)
        else:
            low = inner
        low = low.strip("'’-_").removesuffix("'s").removesuffix("’s")
        if low.rstrip("!+").isalpha():
            low = low.rstrip("!+")
        elif any(c in LEET for c in low) and any(c.isalpha() for c in low):
            letters = "".join(LEET.get(c, c) for c in low)
            if category_bits(letters.replace("-", "")) & ~(1 << BIT["register"]):
                kinds |= LEETED
                low = letters
        if "-" in low or "_" in low:
            parts = re.split("[-_]+", low)
            whole = "".join(parts)
            if category_bits(whole) & _STRONG and not any(category_bits(p) & _STRONG for p in parts):
                return whole, category_bits(whole), kinds | HYPHENED
            bits = 0
            for p in parts:
                bits |= category_bits(p)
            return low, bits, kinds
    bits = category_bits(low)
    if not bits and not low.isascii() and len(low) > 4:
        bits = category_bits(_bare(low))
    if not bits and len(low) > 3 and _REPEAT.search(low):
        forms = [_LONG_REPEAT.sub(r"\1\1", low), _LONG_REPEAT.sub(r"\1", low), _REPEAT.sub(r"\1", low)]
        for form in forms if _LONG_REPEAT.search(low) else ():
            if category_bits(form):
                return form, category_bits(form), kinds | REPEATED
    return low, bits, kinds


class Vocabulary(dict):
    """Word as written -> number; what is known of each word lies in lists by number."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # of words seen since the last table
        self.known = np.zeros((0, 6), dtype=np.int64)

    def __missing__(self, token: str) -> int:
        word, bits, kinds = canonical(token)
        letters = len(token) if token.isalpha() else sum(map(str.isalpha, token))
        upper = 0 if token.islower() else sum(map(str.isupper, token))
        h = xxhash.xxh64_intdigest(word) >> 1
        number = self[token] = len(self)
        self.rows.append((bits, kinds, letters, upper, h, len(token) == 1))
        return number

    def table(self) -> np.ndarray:
        """rows x (bits, kinds, letters, capitals, hash, single letter)."""
        if self.rows:
            self.known = np.concatenate([self.known, np.array(self.rows, dtype=np.int64)])
            self.rows = []
        return self.known

    def trim(self) -> None:
        """Bound the memory of a long task."""
        if len(self) > self.LIMIT:
            self.clear()
            self.rows, self.known = [], self.known[:0]


_VOCABULARY = Vocabulary()


def shared_vocabulary() -> Vocabulary:
    """The words this Python worker has met in any task, bounded by :meth:`Vocabulary.trim`."""
    _VOCABULARY.trim()
    return _VOCABULARY


def _closed_up(pattern: re.Pattern, text: str) -> tuple[str, int, list[str]]:
    """``text`` without matches inside a word, their number, and what their groups held."""
    inside: list[str] = []
    count = 0

    def drop(match: re.Match) -> str:
        nonlocal count
        start, end = match.span()
        if not (start and end < len(text) and text[start - 1].isalnum() and text[end].isalnum()):
            return match.group(0)
        count += 1
        inside.extend(match.groups())
        return ""

    return pattern.sub(drop, text), count, inside


def clean(text: str) -> tuple[str, tuple[int, int, int, int]]:
    """(text whose words are whole, (look-alikes, markup inside words, ``!``, ``?``))."""
    inner = look_alike = 0
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text, inner = _INVISIBLE.subn("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _LOOK_ALIKE_CHAR.search(text):
            look_alike = len(_LOOK_ALIKE_CHAR.findall(text))
            text = text.translate(_LOOK_ALIKE_TABLE)
    if "''" in text:
        text, n, _ = _closed_up(_QUOTES, text)
        inner += n
    if "<!--" in text:
        text, n, hidden = _closed_up(_COMMENT, text)
        text = " \n".join([text, *hidden])
        inner += n
    if "<" in text:
        text, n, _ = _closed_up(_STYLE_TAG, text)
        inner += n
    if "]]" in text:
        text = _LINK_END.sub("", text)
    return text, (look_alike, inner, text.count("!"), text.count("?"))


def split_words(text: str) -> list[str]:
    """Words as written, with the signs that may disguise letters."""
    for sign in _BETWEEN:
        text = text.replace(sign, " ")
    if not text.isascii():
        for sign in _BETWEEN_WIDE:
            text = text.replace(sign, " ")
    return text.split()


def join_spaced(text: str) -> tuple[str, int]:
    """``text`` with letters written apart as words, and how many such runs there were."""
    count = 0

    def join(match: re.Match) -> str:
        nonlocal count
        run = match.group(0)
        letters = run[::2]
        if run[1] != " " and (len(letters) < 4 or letters.isupper()) or letters.isdigit():
            return run
        count += 1
        return _cut(letters)

    return _SPACED.sub(join, text), count


#: Categories whose density and fullest window are features.
_DENSE = ["insult", "dehumanise", "profane", "sexual", "violence", "expel", "contempt", "lure"]
#: Categories that do not count in windows beside words of a neutral register, unless disguised.
_EXCUSED = {"insult", "dehumanise", "sexual", "violence", "expel"}
#: Pairs of categories that may meet in one window.
_PAIRS = [
    ("insult", "second"), ("insult", "third"), ("profane", "second"), ("violence", "second"), ("violence", "first"),
    ("violence", "third"), ("violence", "modal"), ("dehumanise", "group"), ("dehumanise", "modal"), ("dehumanise", "third"),
    ("expel", "group"), ("expel", "modal"), ("group", "modal"), ("contempt", "second"), ("contempt", "third"),
    ("menace", "first"), ("menace", "second"), ("sexual", "lure"), ("sexual", "second"), ("sexual", "third"), ("sexual", "first"),
]
FEATURES = [
    *(f"{c}_density" for c in _DENSE), *(f"{c}_window" for c in _DENSE), *(f"{a}_with_{b}" for a, b in _PAIRS),
    "heat_window", "open_heat_window", "open_hits", "neutral_hits", "second_person_density", "second_person_near",
    "first_person_density", "capital_share", "capital_words", "exclamation_rate", "question_rate", "leet_rate", "masked_rate",
    "spaced_rate", "look_alike_rate", "inner_markup_rate", "repeat_rate", "hyphen_rate", "obfuscated_hits",
    "learned_window", "learned_top", "learned_hits", "log_words",
]

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams_of(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of words, word pairs, and word pairs around one word, within documents."""
    u = h.astype(np.uint64)
    at = np.arange(len(h))
    hashes, places = [u], [at]
    with np.errstate(over="ignore"):
        for step, m in ((1, _M2), (2, _M3)):
            ok = np.flatnonzero(doc[step:] == doc[:-step]) if len(h) > step else np.zeros(0, dtype=np.int64)
            hashes.append((u[ok] * _M1) ^ (u[ok + step] * m) ^ np.uint64(step))
            places.append(ok)
    return (np.concatenate(hashes) >> np.uint64(1)).astype(np.int64), np.concatenate(places)


class Weights:
    """Learned weights of grams, for look-up of many hashes."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(grams)
        self.grams, self.weights = grams[order], weights[order]
        self.mask = (1 << 20) - 1
        self.may = np.zeros(self.mask + 1, dtype=bool)
        self.may[self.grams & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, row of the gram) of those known."""
        maybe = np.flatnonzero(self.may[hashes & self.mask])
        row = np.searchsorted(self.grams, hashes[maybe])
        row = np.minimum(row, max(len(self.grams) - 1, 0))
        same = self.grams[row] == hashes[maybe] if len(self.grams) else np.zeros(len(maybe), dtype=bool)
        return maybe[same], row[same]


def _top(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Greatest value per document (0 if it has none); ``doc`` is sorted."""
    out = np.zeros(n_docs)
    if len(values):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[starts]] = np.maximum.reduceat(values, starts)
    return out


def words_of(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, document of each word, marks) of whole texts.

    Marks per document: look-alikes, markup inside words, ``!``, ``?``, spaced words.
    """
    look_up = vocabulary.__getitem__
    marks = np.zeros((len(texts), 5))
    cleaned: list[str] = []
    own: list[list[int]] = []
    for i, text in enumerate(texts):
        text, marks[i, :4] = clean(text) if text else ("", (0, 0, 0, 0))
        cleaned.append(text)
        own.append(list(map(look_up, split_words(text))))

    def joined() -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
        return np.fromiter(chain.from_iterable(own), dtype=np.int64, count=len(doc)), doc

    ids, doc = joined()
    single = vocabulary.table()[ids, 5] > 0
    apart = single[2:] & single[1:-1] & single[:-2] & (doc[2:] == doc[:-2])
    some = np.unique(doc[2:][apart]).tolist()
    for i in some:  # letters written apart
        text, marks[i, 4] = join_spaced(cleaned[i])
        own[i] = list(map(look_up, split_words(text)))
    return (*(joined() if some else (ids, doc)), marks)


def abuse_features(
    texts: list[str | None], vocabulary: Vocabulary, learned: Weights | list[Weights] | None = None,
    use: np.ndarray | None = None,
) -> np.ndarray:
    """documents x :data:`FEATURES`; zeros for a null or empty text.

    ``learned`` are the weights of grams; of a list, ``use`` names the one of each document.
    """
    ids, doc, marks = words_of(texts, vocabulary)
    n_docs = len(texts)
    known = vocabulary.table()[ids]
    bits, kinds, letters, upper, h, _ = known.T if len(ids) else np.zeros((6, 0), dtype=np.int64)
    count = np.bincount(doc, minlength=n_docs)
    n = np.maximum(count, 1)
    place = np.arange(len(ids)) + doc * (WINDOW + REACH)  # windows never reach into the next text

    # windows that begin at each word of any category
    at = np.flatnonzero(bits)
    p, b, d = place[at], bits[at], doc[at]
    end = np.searchsorted(p, p + WINDOW)
    lo, hi = np.searchsorted(p, p - REACH), np.searchsorted(p, p + REACH, side="right")
    begin = np.arange(len(at))

    def sums(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[last] - total[first]

    has = {name: (b >> bit) & 1 for name, bit in BIT.items()}
    around = {name: sums(has[name], lo, hi) for name in ("register", "second")}
    odd = kinds[at] > 0
    calm = (around["register"] > 0) & ~odd  # such words are in place there
    within = {name: sums(has[name] * ~calm if name in _EXCUSED else has[name], begin, end) for name in BIT}
    raw_heat = sums((b & _STRONG) > 0, begin, end)

    def tally(mask: np.ndarray, of: np.ndarray = d) -> np.ndarray:
        return np.bincount(of, mask, n_docs) if len(of) else np.zeros(n_docs)

    out = [tally(has[c]) / n for c in _DENSE]
    out += [_top(np.minimum(within[c], 6), d, n_docs) for c in _DENSE]
    out += [_top(np.minimum(np.minimum(within[x], within[y]), 4), d, n_docs) for x, y in _PAIRS]
    heat = (
        within["insult"] + within["dehumanise"] + within["profane"] + within["sexual"]
        + 0.5 * (within["violence"] + within["contempt"] + within["expel"] + within["menace"] + within["lure"])
        + 0.25 * (within["second"] + within["group"] + within["modal"] + within["first"])
    )
    strong = (b & _STRONG) > 0
    neutral = strong & calm
    out += [
        _top(raw_heat, d, n_docs), _top(heat, d, n_docs),
        tally(strong & ~neutral), tally(neutral), tally(has["second"]) / n, tally(strong & (around["second"] > 0)),
        tally(has["first"]) / n,
    ]
    n_letters = np.maximum(np.bincount(doc, letters, n_docs) if len(doc) else np.zeros(n_docs), 1)
    capital = tally(upper, doc)
    out += [capital / n_letters, tally((letters >= 3) & (upper == letters), doc), marks[:, 2] / n, marks[:, 3] / n]
    out += [
        tally(kinds & LEETED > 0, doc) / n, tally(kinds & MASKED > 0, doc) / n, marks[:, 4] / n, marks[:, 0] / n_letters,
        marks[:, 1] / n, tally(kinds & REPEATED > 0, doc) / n, tally(kinds & HYPHENED > 0, doc) / n, tally(strong & odd),
    ]
    out += _learned(h, doc, place, n_docs, learned, use)
    out.append(np.log1p(count))
    return np.stack(out, axis=1) if n_docs else np.zeros((0, len(FEATURES)))


def _learned(h, doc, place, n_docs, learned, use) -> list[np.ndarray]:
    """Fullest window, greatest and number of learned weights per document."""
    if learned is None or not len(h):
        return [np.zeros(n_docs)] * 3
    hashes, at = grams_of(h, doc)
    spots, weights = [], []
    for number, one in enumerate(learned if isinstance(learned, list) else [learned]):
        hit, row = one.find(hashes)
        if isinstance(learned, list):
            mine = use[doc[at[hit]]] == number
            hit, row = hit[mine], row[mine]
        spots.append(at[hit])
        weights.append(one.weights[row])
    spot, weight = np.concatenate(spots), np.concatenate(weights)
    order = np.argsort(spot, kind="stable")
    spot, weight = spot[order], weight[order]
    total = np.concatenate(([0.0], np.cumsum(weight)))
    end = np.searchsorted(place[spot], place[spot] + WINDOW)
    d = doc[spot]
    window = total[end] - total[np.arange(len(spot))]
    return [_top(window, d, n_docs), _top(weight, d, n_docs), np.bincount(d, minlength=n_docs).astype(float)]
