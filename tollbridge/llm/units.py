"""Texts as units that a byte-level tokenizer can encode one by one, and a cache of encoded units.

The pretokenizer never joins a space to what stands before it, and a space before a visible character
begins a pretoken. So a text may be cut at every such space, and the ids of the pieces, one after the
other, are the ids of the text. Most pieces recur, so that a cache saves most of the work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Units kept per Python worker: about 200 bytes each.
CACHED_UNITS = 1_200_000


def cut(text: str) -> list[str]:
    """The text at its cuts: all but the first piece have lost the space before them."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def special_tokens(tokenizer_json: str) -> dict[str, int]:
    """The strings that stand for one id wherever they are; those with side conditions aren't known here."""
    added = json.loads(tokenizer_json)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token with side conditions: {token['content']!r}")
    return {token["content"]: token["id"] for token in added}


class UnitCache:
    """Encodes texts by their units; ``encode`` gives the ids of each of a list of strings as bytes."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], specials: dict[str, bytes], limit: int = CACHED_UNITS):
        self.encode, self.specials, self.limit = encode, specials, limit
        self.clear()
        longest_first = sorted(specials, key=len, reverse=True)
        self.split_specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if specials else None

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        parts, flat = [], []
        for text in texts:
            own = []
            for segment in self._segments(text):
                special = self.specials.get(segment)
                if special is not None:
                    own.append((special, "", len(flat)))
                    continue
                head, *units = cut(segment)  # only the first piece has no space before it
                flat += units
                own.append((b"", head, len(flat)))
            parts.append(own)
        ids = self._ids(flat)
        heads = list({head for own in parts for _, head, _ in own})
        head_ids, at, out = dict(zip(heads, self.encode(heads))), 0, []
        for own in parts:
            pieces = []
            for special, head, end in own:
                pieces += (special, head_ids[head], *ids[at:end])
                at = end
            out.append(b"".join(pieces))
        return out

    def _segments(self, text: str) -> list[str]:
        if self.split_specials is None or not any(s in text for s in self.specials):
            return [text]
        return [p for p in self.split_specials.split(text) if p]

    def _ids(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, with the space before it; the missing ones are encoded together, each once."""
        if len(self.young) > self.limit // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        ids = list(map(young.get, units))
        wanted, missing = {u for u, i in zip(units, ids) if i is None}, []
        for unit in wanted:
            known = old.get(unit)
            if known is None:
                missing.append(unit)
            else:
                young[unit] = known
        young.update(zip(missing, self.encode([" " + unit for unit in missing])))
        return [young[u] if i is None else i for u, i in zip(units, ids)] if wanted else ids
