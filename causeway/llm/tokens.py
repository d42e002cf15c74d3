"""Tokenizer calls with a bounded cache of words.

Both vocabularies cut a text into pre-tokens before they merge bytes. A single space between two
visible characters always ends a pre-token, a single line end between two is one of its own, and
punctuation never shares one with the letter or digit before it; so the ids of a text are the ids of such
pieces, joined. Each worker keeps the ids of the words it met (CACHE_WORDS, and one batch's more) and asks
the library for new words only, many in one call: they are put in one text, with a separator whose id no
word has. Words of plain letters are single pre-tokens, so the library need not look for any in them. Texts
with other white space beside a space are cut at the safe spaces alone.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import keep_only

CACHE_WORDS = 600_000
#: Words of one text, and texts of one call.
JOINED, CALL = 256, 16
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Punctuation that is cut off a word's end, after one of these letters or digits; no apostrophe, and nothing of a special token's end.
_TAIL = ".,;:!?%&$#*)]"
_BEFORE_TAIL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))
#: Words that are one pre-token whatever the library's Unicode version: of the lower-casing vocabulary, and of the other.
_LETTERS = {"word": re.compile("[a-z]+").fullmatch, "byte": re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch}
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """The worker's own encoder; kind: ``byte`` (white space counts) or ``word`` (lower case, white space dropped)."""
    keep_only(f"tokens {path}", _ENCODERS.clear)
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.word, self.letters = Tokenizer.from_file(path), kind == "word", _LETTERS[kind]
        #: the same vocabulary for words that are known to be one pre-token
        self.plain = Tokenizer.from_file(path)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed" if self.word else "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.word:
            self.plain.normalizer = None
        #: word -> ids, as it stands after a space; and as it stands first in a text or line; punctuation at a word's end
        self.cache: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what stands between the words of one call, and its id
        self.between = " \x01 " if self.word else "\n"
        (self.separator,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.end_of_line = b"" if self.word else self._ask(["\n"])[0]
        self.plain_between = "\n\x01\n" if self.word else "\n"

    def _ask(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they are."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str], lead: str, plain: bool = False) -> list[bytes]:
        """Ids of words without white space, each after lead."""
        out: list[bytes] = []
        tokenizer, between = (self.plain, self.plain_between) if plain else (self.tokenizer, self.between)
        for k in range(0, len(words), JOINED * CALL):
            part = words[k : k + JOINED * CALL]
            texts = [lead + (between + lead).join(part[j : j + JOINED]) for j in range(0, len(part), JOINED)]
            for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(e.ids, "<u4")
                raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.separator)).tolist()
                out += [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]
        return out

    def _learn(self, words, cache: dict[str, bytes], lead: str) -> None:
        """Ids of words that have no white space."""
        cut, ask, plain, tails, letters = [], set(), set(), set(), self.letters
        for w in words:
            core = w.rstrip(_TAIL)
            if core == w:
                tail = ""
            elif core[-1:] in _BEFORE_TAIL:
                tail = w[len(core) :]
                tails.add(tail)
            else:
                core, tail = w, ""
            if self.word and core.isascii():
                core = core.lower()
            if tail or core is not w:
                cut.append((w, core, tail))
            if core not in cache:
                (plain if letters(core) else ask).add(core)
        known = [t for t in tails if t not in self.tail]
        self.tail.update(zip(known, self._ask(known)))
        odd = [w for w in ask if "\x01" in w or any(s in w for s in self.special)]
        cache.update(zip(odd, self._ask([lead + w for w in odd])))
        rest, simple = list(ask.difference(odd)), list(plain)
        cache.update(zip(rest, self._ask_words(rest, lead)))
        cache.update(zip(simple, self._ask_words(simple, lead, plain=True)))
        for w, core, tail in cut:
            cache[w] = cache[core] + self.tail[tail] if tail else cache[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        for kept in (self.cache, self.first, self.tail):
            if len(kept) > CACHE_WORDS:  # between calls only, so what a call has learnt stays until its end
                kept.clear()
        return self._words(texts) if self.word else self._bytes(texts)

    def _words(self, texts: list[str]) -> list[bytes]:
        cut = [(t.lower() if t.isascii() else t).replace("\n", " ").split(" ") for t in texts]
        words = set(chain.from_iterable(cut))
        new = words.difference(self.cache)
        odd = [w for w in new if w and not _solid(w)]
        self.cache.update(zip(odd, self._ask(odd)))
        self.cache[""] = b""
        self._learn(new.difference(odd, ("",)), self.cache, "")
        return [b"".join(map(self.cache.__getitem__, w)) for w in cut]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        heads = [p[0] for p in cut]
        pieces = set(chain.from_iterable(p[1:] for p in cut))
        new = list(pieces.difference(self.cache))
        # pieces that begin or end with white space, or are empty: the single spaces around them are no safe cut
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        odd_text = [not odd.isdisjoint(p[1:]) or h[-1:].isspace() for p, h in zip(cut, heads)]
        lines = [p for p in new if p not in odd and not _solid(p)]
        plain, firsts, whole = set(new).difference(odd, lines), set(), []
        for p in lines:
            parts = p.split("\n")
            if all(map(_solid, parts)):
                plain.add(parts[0])
                firsts.update(parts[1:])
            else:
                whole.append(p)
        heads_plain = {h for h in heads if _solid(h)}
        self._learn(plain.difference(self.cache), self.cache, " ")
        self._learn((firsts | heads_plain).difference(self.first), self.first, "")
        self.cache.update(zip(whole, self._ask([" " + p for p in whole])))
        for p in lines:
            if p not in self.cache:
                parts = p.split("\n")
                self.cache[p] = self.cache[parts[0]] + b"".join(self.end_of_line + self.first[x] for x in parts[1:])
        get = self.cache.__getitem__
        out = []
        for text, p, h, slow in zip(texts, cut, heads, odd_text):
            if slow:
                safe = _SAFE_SPACE.split(text)
                out.append(b"".join(self._ask(safe[:1] + [" " + x for x in safe[1:]])))
            else:
                start = (self.first[h] if h in heads_plain else self._ask([h])[0]) if h else b""
                out.append(start + b"".join(map(get, p[1:])))
        return out


def _solid(text: str) -> bool:
    """Something without white space."""
    parts = text.split()
    return len(parts) == 1 and len(parts[0]) == len(text)
