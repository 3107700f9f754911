"""Token ids of whole texts through a public tokenizer, with a bounded cache of word encodings.

Both supported vocabularies split a text before every blank or line feed that stands between two characters
which aren't white space, so a text's ids are the ids of its words in a row. Texts with any other white
space are encoded whole. A new word of Latin letters, digits and ASCII signs is cut into the pieces that the
vocabulary's own pattern cuts, which the tokenizer's model encodes one by one; any other word goes through the
whole tokenizer. Ids are the same either way.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from tracewright.llm.common import cached

#: Words kept in each of the cache's two generations; a word is a few dozen bytes.
CACHE_WORDS = 600_000
#: Longer words are encoded anew each time.
LONG_WORD = 200
_LOADED: dict[tuple, Encoder] = cached(__name__, {})
# The vocabularies' patterns, for these letters; the first one's is for texts in lower case.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = {False: re.compile(rf"{_ENDINGS}|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"), True: re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+")}
#: Words that the patterns above cut as the tokenizer does; a letter whose lower case is two characters is left out.
_PLAIN = re.compile("[\n ]?[!-~À-ÖØ-öø-įı-ɏ]*")
_ALPHA = re.compile(f" ?[{_LETTER.replace('ø-ɏ', 'ø-įı-ɏ')}]+")
_TAIL = ".,!?;:*$&%#)"
#: A byte-level vocabulary writes bytes as characters: printable ones as themselves, the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_BLANK = chr(_BYTES[32])


class Cache(dict):
    """Words to ids; a word that isn't here is noted in ``missing``."""

    def __init__(self):
        self.missing: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.missing.add(word)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. ``blank``: whether a word's ids depend on the blank before it.

    If so, the cache has words and pieces after a blank as they are, words after a line feed with it, its id too,
    and pieces after neither behind a carriage return. Else it has them as they are.
    """

    def __init__(self, path: str, blank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.blank, self.pieces = self.tokenizer.model, blank, _PIECES[blank].findall
        self.mark = self.whole("\n") if blank else b""
        self.new = Cache()
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the pattern has cut; what isn't cached is encoded by the model alone."""
        key = (piece[1:] or "\r ") if self.blank and piece[0] == " " else "\r" + piece if self.blank else piece
        ids = self.new.get(key) or self.old.get(key)
        if ids is None:
            shown = piece.replace(" ", _BLANK) if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(_BYTES)
            found = self.model.tokenize(shown)
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            if len(piece) <= LONG_WORD:
                self.new[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word by its key."""
        text = word if not self.blank or word[0] == "\n" else " " + word
        bare = text.rstrip(_TAIL)
        if _ALPHA.fullmatch(bare):  # nearly every word; signs after letters are one piece
            head = self._piece(bare if self.blank else bare.lower())
            return head if len(bare) == len(text) else head + self._piece(text[len(bare) :])
        if not _PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self._piece, self.pieces(text if self.blank else text.lower())))

    def _learn(self, words: set[str]) -> None:
        """Put words into the cache."""
        if len(self.new) > CACHE_WORDS:
            self.new, self.old = Cache(), self.new
        get, new, word = self.old.get, self.new, self._word
        for w in words:
            new[w] = get(w) or word(w)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        get, found, waiting = self.new.__getitem__, [], []
        for text in batch:
            words = text.split()
            if not words or _odd(text, words):
                found.append([self.mark, self.whole(text)] if text else [])
                continue
            if self.blank:  # the first one too, without the line feed in the end
                k = 0
                for line in text.split("\n"):
                    words[k] = "\n" + words[k]
                    k += line.count(" ") + 1
            ids = list(map(get, words))
            if None in ids:
                waiting.append((len(found), words))
            found.append(ids)
        if waiting:
            missing, self.new.missing = self.new.missing, set()
            # the cache may be a fresh one after this, so what was found above is kept
            self._learn(missing)
            for i, words in waiting:
                ids, get = found[i], self.new.__getitem__
                found[i] = [get(w) if x is None else x for w, x in zip(words, ids)]  # noqa: B905
            for w in missing:
                if len(w) > LONG_WORD:
                    del self.new[w]
        out = map(b"".join, found)
        return [x[len(self.mark) :] for x in out] if self.blank else list(out)


def _odd(text: str, words: list[str]) -> bool:
    """Whether a text of these words has other white space than one blank or line feed between any two."""
    return len(" ".join(words)) != len(text) or len(words) != text.count(" ") + text.count("\n") + 1


def encoder(path: str, blank: bool) -> Encoder:
    """This worker's encoder; loaded once."""
    if (path, blank) not in _LOADED:
        _LOADED[path, blank] = Encoder(path, blank)
    return _LOADED[path, blank]
