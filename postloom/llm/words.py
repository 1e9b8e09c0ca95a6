"""Words of whole texts: runs of ASCII letters, digits and non-ASCII characters, A to Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: On UTF-8 bytes; ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A to Z are lower case.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text whose words are lists of Python objects at one time.
PIECE = 1 << 20


def words_of(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for about every ``piece`` bytes; cuts are between words."""
    text, at = (text or b"").lower(), 0  # bytes.lower() changes A to Z only
    while at < len(text):
        gap = GAP.search(text, at + piece)
        end = gap.start() if gap else len(text)
        if found := WORD.findall(text, at, end):
            yield found
        at = end
