"""Token ids of whole texts from a public tokenizer file, as bytes of a fixed width.

The tokenizer drops white space and never merges across it, nor between a word and
the punctuation behind it, and it ignores case. So a text's ids are the ids of its
pieces between blanks and such punctuation, one after the other. Pieces repeat, so
their ids are remembered in a bounded memory that a worker keeps; a piece is never
cut. New pieces go to the tokenizer many at a time and are told apart by its word-end
tokens or, where they are not plain words, by its end-of-text token between them."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

_PIECES = 600_000
#: New pieces that go to the tokenizer at once; what it makes of them is many times their size.
_AT_ONCE = 8192
_LONGEST = 40
#: Letters beyond these have rules of their own for lower case.
_FAR = re.compile("[^\\x00-\u024f]")
#: Punctuation that stands alone between a letter and a blank.
_STOP = re.compile("(?<=[a-zß-öø-ÿ])([.,;:!?])(?=[ \\n])")


def public_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str = "<u4", special_as_text: bool = False) -> Encoder:
    """One encoder, with its memory, for all tasks of a worker."""
    return Encoder(path, dtype, special_as_text)


class Encoder:
    """Ids of texts as bytes of dtype."""

    def __init__(self, path: str, dtype: str = "<u4", special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special_as_text = special_as_text
        self._dtype = np.dtype(dtype)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._between = self._special[-1]
        self._between_id = self._tokenizer.token_to_id(self._between)
        vocabulary = self._tokenizer.get_vocab()
        self._word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self._word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {"": b""}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, from the tokenizer itself."""
        if odd := [k for k, p in enumerate(pieces) if any(s in p for s in self._special)]:
            self._tokenizer.encode_special_tokens = self._special_as_text
            out = dict(zip(odd, [np.array(self._tokenizer.encode(pieces[k], add_special_tokens=False).ids, self._dtype).tobytes() for k in odd]))
            rest = iter(self._ids([p for k, p in enumerate(pieces) if k not in out]))
            return [out[k] if k in out else next(rest) for k in range(len(pieces))]
        if not pieces:
            return []
        self._tokenizer.encode_special_tokens = False
        coded = self._tokenizer.encode_batch_fast([self._between.join(pieces)], add_special_tokens=False)
        ids = np.array(coded[0].ids, np.int64)
        cuts = np.flatnonzero(ids == self._between_id)
        width, whole = self._dtype.itemsize, ids.astype(self._dtype).tobytes()
        starts = [0, *((cuts + 1) * width).tolist()]
        ends = [*(cuts * width).tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(starts, ends)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters: each ends with its first word-end token."""
        coded = self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(coded[0].ids, np.int64)
        width, whole = self._dtype.itemsize, ids.astype(self._dtype).tobytes()
        ends = ((np.flatnonzero(self._word_end[ids]) + 1) * width).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        words = [p for p in pieces if p.isalpha() and p.islower() and not _FAR.search(p)]
        others = list(set(pieces).difference(words))
        new = {}
        for some, ids in ((words, self._word_ids), (others, self._ids)):
            for at in range(0, len(some), _AT_ONCE):
                part = some[at : at + _AT_ONCE]
                new |= zip(part, ids(part))
        self._known.update(new if max(map(len, new), default=0) <= _LONGEST else {p: b for p, b in new.items() if len(p) <= _LONGEST})
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The id bytes of each text; a null text has none."""
        if len(self._known) > _PIECES:
            self._known = {"": b""}
        split = [_pieces(t) if t else [] for t in texts]
        known, out = self._known, []
        new = self._learn(list(set().union(*split).difference(known)))
        for pieces in split:
            try:
                out.append(b"".join(map(known.__getitem__, pieces)))
            except KeyError:
                out.append(b"".join([known[p] if p in known else new[p] for p in pieces]))
        return out


def _pieces(text: str) -> list[str]:
    """Pieces whose ids, one after the other, are the ids of the text."""
    if not _FAR.search(text) and "<|" not in text:
        text = _STOP.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")
