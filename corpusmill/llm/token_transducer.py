"""Token counts by a finite-state tokenizer, compiled as it is used.

The tokenizer (piece pattern and BPE merges together) is one deterministic
transducer over bytes.  A transition carries the change of the number of tokens
of what was read so far; a final output closes what is still open.  A state is
what the rest of a text can still depend on: the open kind of piece, an
unfinished UTF-8 character, and for the BPE of the open piece each suffix that
begins a longer token, with the last token and the number of tokens before it.
Transitions are worked out when first met and kept in a table.

A batch of texts is cut into chunks where a non-space ASCII byte is followed by a
space, which puts the transducer in the same state whatever came before.  So the
map of a chunk, from entry state to exit state and count, is constant, and equal
chunks have equal maps: only chunks not seen before are run, all in step, one
table lookup moving each of them by a byte.  Maps are composed by a prefix scan
over the chunks, read off where texts end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Ranks
from .pieces import LETTER, NUMBER, OTHER, SPACE, classes
from .wordhash import BASE_BYTES, mix, powers, prefix_sums, runs

#: Texts' bytes in a batch, and states and chunk maps after which their tables start anew.
RUN_BYTES, STATES, MAPS = 2 << 20, 200_000, 600_000
#: Chunks of at most so many bytes are remembered.
MAP_BYTES = 64

#: Contraction endings of one letter, and the two-letter ones by their first letter.
ONE, TWO = set(b"stmd"), {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}

BYTE = [bytes((b,)) for b in range(256)]
BEGIN = ("begin", b"", None, b"")


class Transducer:
    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        #: For bytes that begin a longer token, 1; for tokens, twice one more than the rank.
        self.parts = dict.fromkeys((t[:n] for t in ranks.tokens for n in range(1, len(t))), 1)
        for i, t in enumerate(ranks.tokens):
            self.parts[t] = self.parts.get(t, 0) | (i + 1) << 1
        self.kinds = classes()
        #: BPE state: (longest suffix that begins a token, entries (suffix length, last token, tokens before, relative to now)).
        self.none = (b"", ((0, -1, 0),))
        self.steps: dict = {}
        #: Counts of chunks, by whether they open a text (1) and close it (2).
        self.maps: list[dict[bytes, int]] = [{} for _ in range(4)]
        self.clear()

    def clear(self) -> None:
        self.ids: dict = {}
        self.states: list = []
        #: By byte and state: (next state << 8) + 128 + change of the count, or 0 where not yet worked out.
        #: States met early, which are the frequent ones, lie close together.
        self.bits = 18  # zeros take memory only where they are written
        self.moves = np.zeros(256 << self.bits, np.int32)
        self.begin = self.state(BEGIN)
        self.resting = self.state(("space", b"", self.none, b" "))

    def state(self, value: tuple) -> int:
        if (have := self.ids.get(value)) is None:
            have = self.ids[value] = len(self.states)
            self.states.append(value)
            if have >> self.bits:
                wider = np.zeros((256, 2 << self.bits), np.int32)
                wider[:, : 1 << self.bits] = self.moves.reshape(256, -1)
                self.bits += 1
                self.moves = wider.ravel()
        return have

    def bpe(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The BPE state after one more byte of a piece, and the change of its token count."""
        if (have := self.steps.get((state, byte))) is not None:
            return have
        suffix, entries = state
        longer = suffix + BYTE[byte]
        end, known, parts = len(longer) - 1, self.ranks.known.get, self.parts.get
        last, gain, open_ = -1, 0, []
        for length, before, count in entries:
            part = longer[end - length :]
            what = parts(part)  # of most suffixes nothing can come
            if what is None:
                continue
            if what > 1 and last < 0:
                token = (what >> 1) - 1
                if before < 0 or (self.ranks.fits(before, token) if (ok := known(before << 32 | token)) is None else ok):
                    last, gain = token, count + 1
            if what & 1:
                open_.append((length + 1, before, count))
        new = (*[(length, before, count - gain) for length, before, count in open_], (0, last, 0))
        width = new[0][0]
        have = (longer[end + 1 - width :] if width else b"", new), gain
        if len(self.steps) > 60_000:
            self.steps.clear()
        self.steps[state, byte] = have
        return have

    def feed(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for byte in data:
            state, gain = self.bpe(state, byte)
            total += gain
        return state, total

    def step(self, value: tuple, byte: int) -> tuple[tuple, int]:
        """One byte: wait for the end of a character, then act on its class."""
        mode, part, bpe, held = value
        data = part + bytes((byte,))
        lead = data[0]
        if lead >= 0x80 and len(data) < (4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2):
            return (mode, data, bpe, held), 0
        return self.character(mode, bpe, held, data, int(self.kinds[ord(data.decode())]))

    def character(self, mode: str, bpe, held: bytes, data: bytes, kind: int) -> tuple[tuple, int]:
        if mode == "space":
            if kind == SPACE:
                run, gain = self.feed(bpe, held)
                return ("space", b"", run, data), gain
            if held == b" ":  # the space opens the next piece
                run, gain = self.feed(self.none, held + data)
                return (kind, b"", run, b""), gain
            _, gain = self.feed(self.none, held)
            new, more = self.character("begin", None, b"", data, kind)
            return new, gain + more
        if mode == "quote":  # an apostrophe that opened a piece, perhaps with the first of two letters
            if not held:
                if len(data) == 1 and data[0] in ONE:
                    return BEGIN, self.feed(self.none, b"'" + data)[1] - 1
                if len(data) == 1 and data[0] in TWO:
                    run, gain = self.feed(self.none, data)
                    return ("quote", b"", run, data), gain
                mode = OTHER
            elif len(data) == 1 and TWO[held[0]] == data[0]:
                return BEGIN, self.feed(self.none, b"'" + held + data)[1] - 2
            else:
                mode = LETTER
        if mode == kind:
            run, gain = self.feed(bpe, data)
            return (kind, b"", run, b""), gain
        if kind == SPACE:
            return ("space", b"", self.none, data), 0
        run, gain = self.feed(self.none, data)
        return ("quote" if data == b"'" else kind, b"", run, b""), gain

    def final(self, state: int) -> int:
        """Tokens that the end of the text adds: white space held back."""
        mode, _, bpe, held = self.states[state]
        return self.feed(bpe, held)[1] if mode == "space" else 0

    def learn(self, state: int, byte: int) -> None:
        value, gain = self.step(self.states[state], byte)
        to = self.state(value)
        self.moves[byte << self.bits | state] = to << 8 | gain + 128

    def run(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of lanes that read data[at:stop] from their states, all in step."""
        order = np.argsort(at - stop, kind="stable")  # longest first
        at, state = at[order], state[order].astype(np.int32)
        sizes = (stop[order] - at).astype(np.int64)
        total = -128 * sizes
        live = len(at)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= k:
                live -= 1
            byte, here = data[at[:live] + k].astype(np.int32), state[:live]
            move = self.moves[(byte << self.bits) + here]
            if not move.all():
                missing = np.flatnonzero(move == 0)
                for key in np.unique(here[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self.learn(key >> 8, key & 255)
                move = self.moves[(byte << self.bits) + here]
            total[:live] += move & 255
            state[:live] = move >> 8
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def chunk_counts(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray, role: np.ndarray) -> np.ndarray:
        """Counts of chunks data[at:stop]; role has bit 1 for the first of a text, bit 2 for the last."""
        whole, found, missing = data.tobytes(), np.zeros(len(at), np.int64), []
        if sum(map(len, self.maps)) > MAPS:
            for known in self.maps:
                known.clear()
        for i, (a, b, r) in enumerate(zip(at.tolist(), stop.tolist(), role.tolist(), strict=True)):
            if (have := self.maps[r].get(whole[a:b])) is None:
                missing.append(i)
            else:
                found[i] = have
        if missing:
            m = np.array(missing)
            exits, count = self.run(data, at[m], stop[m], np.where(role[m] & 1, self.begin, self.resting))
            last = np.flatnonzero(role[m] & 2)
            kinds, which = np.unique(exits[last], return_inverse=True)
            count[last] += np.array([self.final(int(s)) for s in kinds], np.int64)[which]
            found[m] = count
            for i, n in zip(missing, count.tolist(), strict=True):
                if stop[i] - at[i] <= MAP_BYTES:
                    self.maps[role[i]][whole[at[i] : stop[i]]] = n
        return found

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each text."""
        if len(self.states) > STATES:
            self.clear()
        out = np.zeros(len(texts), np.int64)
        some = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(some):
            return out
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in some])
        opens = np.append(0, ends[:-1])
        first = np.zeros(len(data) + 1, bool)
        first[opens] = True
        sure = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127) & ~first[1:-1]) + 2
        # A chunk may be empty, at the end of a text; it comes before the next text's first.
        at, role = np.concatenate((sure, opens)), np.repeat((0, 1), (len(sure), len(opens)))
        order = np.lexsort((role, at))
        at, role = at[order], role[order]
        stop = np.append(at[1:], len(data))
        role = role | np.append(role[1:], 1) << 1
        up, down = powers(BASE_BYTES, len(data) + 1)
        sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), down)
        keys = mix((sums[stop] - sums[at]) * up[at], 1) + ((stop - at) << 2 | role).astype(np.uint64)
        _, where, kind = np.unique(keys, return_index=True, return_inverse=True)
        shift = np.repeat(at[where][kind] - at, stop - at)
        if not np.array_equal(data[np.arange(len(data)) + shift], data):  # hashes met
            where = kind = np.arange(len(at))
        scan = np.cumsum(self.chunk_counts(data, at[where], stop[where], role[where])[kind])
        out[some] = np.diff(scan[(role & 2) > 0], prepend=0)
        return out


@lru_cache(2)
def transducer(path: str) -> tuple[Transducer, list[str]]:
    import json

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    return Transducer(Ranks.from_json(path)), special


def token_counts(docs: DataFrame, path: str, *, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Add the number of tokens that the byte-level BPE of a tokenizer's JSON file makes of each text.

    Strings of added tokens count as one token each and part what surrounds them.
    Null and empty texts have none.  Other columns pass; one named `out_col` is replaced.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, special = transducer(path)
        for column in batches:
            texts = [(t or "").encode() for t in column]
            out = np.zeros(len(texts), np.int64)
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                parts, owner = texts[a:b], np.arange(a, b)
                for mark in (s.encode() for s in special):
                    if any(mark in t for t in parts):
                        cut = [t.split(mark) for t in parts]
                        np.add.at(out, owner, [len(c) - 1 for c in cut])
                        owner = np.repeat(owner, [len(c) for c in cut])
                        parts = [t for c in cut for t in c]
                np.add.at(out, owner, machine.counts(parts))
            yield pd.Series(out)

    return docs.withColumn(out_col, count(F.col(text_col)))
