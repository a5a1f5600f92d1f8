"""Words of whole texts as UTF-8 bytes, cut at memory speed."""

from __future__ import annotations

import re

_KEEP = bytes(range(0x80, 0x100))


def _table(is_word) -> bytes:
    """Bytes table: A-Z to a-z, what is no word byte to a blank."""
    out = bytearray(256)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        out[b] = low if is_word(low) else 0x20
    return bytes(out)


#: Letters, digits and everything beyond ASCII make words.
_ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Everything but the blank and the control characters 9 to 13 makes words.
_SOLID = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: The words of _ALNUM where they stand in the original text.
ALNUM_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_ALNUM).split() if text else []


def solid_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_SOLID).split() if text else []
