"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces between blanks.

A text is cut at single blanks that stand between two non-blanks: there both vocabularies always end a token, so the
ids of a text are the ids of its pieces, joined. Each process keeps the ids of the pieces it has met in two generations
of MEMO: a full one becomes the old one, and what is met again moves on to the new. Texts
with other white space around a blank, where a cut could change ids, go to the library whole, and so do texts that
hold the string of a token added to the vocabulary (``<|endoftext|>``): as the library does on a plain call, it
becomes that token. With ``specials_as_text`` such strings are ordinary text instead.

New pieces cost most. One of Latin letters alone is one word to both vocabularies, so it goes to the library's model itself, in
the alphabet of bytes, without the normalisers and patterns before it. Punctuation after a letter, where tokens end too, is looked
up apart from the word before it.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array

MEMO = 400_000
#: Longer pieces are encoded but not kept.
LONG = 80
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that no normal form changes and whose small form is one letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: What is before the first piece of a text; before others is one line break at most.
START = "\n\n"
#: START or a line break, a word of letters, and the marks after it.
PLAIN = re.compile(f"(\n*)([{LETTERS}]+)([{re.escape(MARKS)}]*)").fullmatch
#: The characters that byte-level vocabularies write for the 256 bytes: those that don't show follow Latin-1.
UNSHOWN = [*range(33), *range(127, 161), 173]
ALPHABET = "".join(chr(256 + UNSHOWN.index(b) if b in UNSHOWN else b) for b in range(256))


class Coder(dict):
    """``encode(texts)`` gives each text's ids as little-endian 32-bit bytes. ``lead``: a blank belongs to the piece after it.

    The dictionary is the memory's new generation: a piece that it lacks comes from the old one or is encoded.
    """

    def __init__(self, file: str, lead: bool, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lead = lead
        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = specials_as_text
        added = [] if specials_as_text else list(self.model.get_added_tokens_decoder().values())
        # a string that is looked for in the normalised text may be anywhere: then no text is cut
        self.special = [""] if any(t.normalized for t in added) else [t.content for t in added]
        self.old: dict = {}
        self.tails: dict = {}
        self.tokenize = self.model.model.tokenize
        # letters go to the model itself only where that gives the library's ids
        words = [f"{b}{x}{y}" for b in ("", " ") for x in map(chr, range(256)) if PLAIN(x) for y in ("", "a", "\u00c9")]
        self.plain = PLAIN if [self._word(w) for w in words] == self._ids(words) else lambda key: None

    @property
    def memo(self) -> dict:
        return self

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """What ``_ids`` gives for a word of LETTERS, with the blank that belongs to it."""
        if not self.lead:
            word = word.strip(" ").lower()
        shown = codecs.charmap_decode(word.encode(), "strict", ALPHABET)[0]
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 50_000:
                self.tails.clear()
            self.tails[marks] = self._ids([marks])[0]
        return self.tails[marks]

    def __missing__(self, key: str) -> bytes | None:
        """The piece's ids, kept unless it is LONG; None if it can't be encoded apart from what surrounds it."""
        ids = self.old.get(key)
        if ids is None:
            plain = self.plain(key)
            if plain:
                before, word, marks = plain.groups()
                if marks:
                    ids = self[before + word] + self._tail(marks)
                elif before:
                    ids = self._word(word) if before == START else self._tail(before) + self._word(word)
                else:
                    ids = self._word(" " + word if self.lead else word)
            else:
                ids = self._other(key)
        if len(key) <= LONG:
            self[key] = ids
        return ids

    def _other(self, key: str) -> bytes | None:
        stem = key.rstrip(MARKS)
        # letters that every Unicode version knows, and whose small form is a letter alone
        if len(stem) < len(key) and stem and stem[-1] < "\u0250" and stem[-1].lower().isalpha():
            ids = self[stem]
            return None if ids is None else ids + self._tail(key[len(stem) :])
        literal = self._literal(key)
        return None if literal is None else self._ids([literal])[0]

    def _literal(self, key: str) -> str | None:
        """The characters that a key stands for; None if they can't be encoded apart from what surrounds them."""
        if not self.lead:
            return key
        if key.startswith(START):
            return None if key[len(START) :][-1:].isspace() else key[len(START) :]
        body = key[1:] if key[:1] == "\n" else key
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return key if key[0] == "\n" else " " + key

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        return [self._ids([t])[0] if any(x in t for x in self.special) else self._pieced(t) for t in texts]

    def _pieced(self, text: str) -> bytes:
        if self.lead:
            pieces = (START + text.replace("\n", " \n")).split(" ")
        else:
            pieces = text.replace("\n", " ").split(" ")  # white space only parts words
        try:
            return b"".join(map(self.__getitem__, pieces))
        except TypeError:  # a piece that has no ids of its own
            return self._ids([text])[0]


_CODERS: dict[tuple[str, bool, bool], Coder] = {}


def coder(name: str, lead: bool, specials_as_text: bool = False) -> Coder:
    """The process's coder for a public vocabulary file; ``name`` may also be a path."""
    key = (name, lead, specials_as_text)
    if key not in _CODERS:
        if os.path.sep in name:
            file = name
        else:
            import public_tokenizers

            file = public_tokenizers.path(name)
        _CODERS[key] = Coder(file, lead, specials_as_text)
    return _CODERS[key]


def text_batches(batches, size: int = 2 << 20):
    """(doc_id column, texts) of the rows (doc_id, text), about ``size`` characters at a time; null text: empty."""
    for b in batches:
        texts = b.column(1).to_pylist()
        lo, held = 0, 0
        for i, t in enumerate(texts):
            texts[i] = t or ""
            held += len(texts[i])
            if held >= size or i + 1 == len(texts):
                yield b.column(0).slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, held = i + 1, 0
