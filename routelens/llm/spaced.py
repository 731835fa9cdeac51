"""Encoding of whole texts piece by piece with a bounded cache.

Byte-level BPE splits a text by a pattern before merging. A single space between two characters that aren't white space
is always the start of a new match, so a text can be cut at such spaces; each cut piece is encoded once and found again
in the cache. Other white space stays inside its piece.
"""

from __future__ import annotations

from collections.abc import Callable


class SpacedEncoder:
    """text -> ids as little-endian unsigned 32-bit integers. ``encode`` gives them for any piece of text."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 400_000, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.held: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.encode(" " + piece)
        if len(piece) <= self.longest:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[piece] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        held, out = self.held.get, []
        pieces = [first]
        bad = not first or first[-1].isspace()
        if not bad:
            for p in parts:
                got = held(p)
                if got is None:
                    if not p or p[0].isspace() or p[-1].isspace():
                        bad = True
                        break
                    got = self._piece(p)
                out.append(got)
        if not bad:
            return self.encode(first) + b"".join(out)
        for p in parts:
            if pieces[-1] and not pieces[-1][-1].isspace() and p and not p[0].isspace():
                pieces.append(p)
            else:
                pieces[-1] += " " + p
        return self.encode(pieces[0]) + b"".join([held(p) or self._piece(p) for p in pieces[1:]])
