"""Words as the contracts take them."""

from __future__ import annotations

import string

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()
