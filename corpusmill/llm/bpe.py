"""Rank tables of byte-level BPE and the test whether two tokens may stand side by side."""

from __future__ import annotations

import base64
import json

#: The usual byte-to-character table of byte-level vocabularies in JSON: printable bytes stand for
#: themselves, the others for the characters from U+0100 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ranks:
    """Token bytes by rank, and adjacency of tokens, memoised."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self._split: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}

    @classmethod
    def from_tiktoken(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        assert sorted(ranks.values()) == list(range(len(ranks)))
        return cls(sorted(ranks, key=ranks.__getitem__))

    @classmethod
    def from_json(cls, path: str) -> Ranks:
        """The base tokens, then the result of each merge in order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_characters()
        decode = lambda s: bytes(map(to_byte.__getitem__, s))
        base = sorted((t for t in model["vocab"] if len(t) == 1), key=model["vocab"].__getitem__)
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        return cls([*map(decode, base), *map(decode, merged)])

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made `token`; a byte is its own pair."""
        if (have := self._split.get(token)) is None:
            text, rank = self.tokens[token], self.rank
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                _, i = min((rank.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            have = self._split[token] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (token, token)
        return have

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves `left` and `right` side by side: no merge across the seam comes first."""
        key = left << 32 | right
        if (have := self.known.get(key)) is not None:
            return have
        tokens, rank, a, b, limit, out = self.tokens, self.rank, left, right, 1 << 31, True
        while True:
            made = rank.get(tokens[a] + tokens[b])
            if made is not None and made < limit and self.split(made) == (a, b):
                out = False
                break
            # Undo the later of the two merges at the seam, then look again.
            if a > b:
                limit, a2 = a, self.split(a)[1]
                if a2 == a:
                    limit, b2 = b + 1, self.split(b)[0]
                    if b2 == b:
                        break
                    b = b2
                else:
                    a = a2
            else:
                limit, b2 = b + 1, self.split(b)[0]
                if b2 == b:
                    limit, a2 = a, self.split(a)[1]
                    if a2 == a:
                        break
                    a = a2
                else:
                    b = b2
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[key] = out
        return out
