"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import gc
import re
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns


_BYTES = [bytes((b,)) for b in range(256)]
MARKS = "!#$%&*+,-./:;=?@^_|~"  # neither letters, digits nor spaces, and no apostrophe


class Transducer:
    """Merges compiled into a finite-state transducer over bytes, determinised as inputs ask for it.

    Two facts carry the construction. A token sequence is the merge procedure's output exactly if every two
    neighbours are (``joins``); so each prefix of the input has one last token, and the last tokens link the
    prefixes into a tree. A boundary can only be built on by later input while the bytes after it still are a
    proper prefix of some token. A state is therefore the last emitted token and the pending bytes; on a byte,
    tokens up to the deepest tree node shared by all boundaries in reach are emitted, which happens after at
    most a token's length of lookahead. A move is made when it is asked for the ``OFTEN``-th time (most tails of
    words come once), or where over ``TAIL`` bytes follow; states and moves are dropped beyond ``limit``. A tail
    for which there is no move is settled with its at most TAIL bytes as lookahead.
    """

    TAIL = 48
    OFTEN = 64

    def __init__(self, ranks: dict[bytes, int], limit: int = 20_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.own, self.parts = {}, {}  # tokens that merging can reach, and what their last merge joined
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            before = [i] if len(token) == 1 else self._merge(token, below=i)
            if len(before) <= 2:
                self.own[token] = i
                if len(before) == 2:
                    self.parts[i] = tuple(before)
        self.size_of = [len(t) for t in self.bytes_of] + [1, 1]  # the last two for -2 and -1
        self.starts = {t[:k] for t in self.own for k in range(1, len(t))}
        self.longest: dict[bytes, int] = {}  # of the tokens with these four first bytes
        for t in self.own:
            for k in range(1, 5):
                self.longest[t[:k]] = max(len(t), self.longest.get(t[:k], 0)) if k == 4 else max(min(k, len(t)), self.longest.get(t[:k], 0))
        self._joins: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: moves by byte (the next state and what is emitted, or how often it was asked for), pending bytes,
        # last token at each boundary, boundaries that later bytes can build on
        self.start = ({}, b"", (-1,), [0])
        self.states = {(-1, b""): self.start}

    def _merge(self, piece: bytes, below: int = 1 << 40) -> list[int]:
        """Reference merging of a short piece: the lowest-ranked adjacent pair, leftmost first, of ranks ``below`` alone."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def joins(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are.

        Undoes the two tokens' merges, the latest first, and asks at each step whether the parts that then meet
        at the boundary would have merged before the merge just undone.
        """
        key = a << 20 | b
        if (known := self._joins.get(key)) is None:
            if len(self._joins) > 400_000:
                self._joins.clear()
            ranks, of, parts, undone = self.ranks, self.bytes_of, self.parts, 1 << 40
            left, right = a, b
            while True:
                met = ranks.get(of[left] + of[right])
                if met is not None and met < undone:
                    known = False
                    break
                # of equal ranks the pair further left merges first; so an undone right token lets its own rank win at the boundary
                if (left > right and left in parts) or right not in parts:
                    if left not in parts:
                        known = True
                        break
                    undone, left = left, parts[left][1]
                else:
                    undone, right = right + 1, parts[right][0]
            self._joins[key] = known
        return known

    def _move(self, state: tuple, byte: int) -> tuple[tuple, tuple]:
        moves, pending, last, live = state
        pending += _BYTES[byte]
        n, own, starts = len(pending), self.own, self.starts
        found, reach = -2, []  # -2: no sequence of tokens ends here (a byte that is no token)
        for j in live:
            rest = pending[j:] if j else pending
            if found == -2 and (token := own.get(rest)) is not None:
                before = last[j]
                if before == -1 or (before >= 0 and self.joins(before, token)):
                    found = token
            if rest in starts:
                reach.append(j)
        last += (found,)
        reach.append(n)
        out = ()
        if reach[0]:  # else later bytes can still build on the first boundary, and nothing is certain yet
            tops, size = set(reach), self.size_of
            while len(tops) > 1:  # the deepest boundary that all in reach are built on
                deep = max(tops)
                tops.discard(deep)
                tops.add(deep - size[last[deep]])
            if top := tops.pop():
                j, emitted = top, []
                while j > 0:
                    emitted.append(last[j])
                    j -= size[last[j]]
                out = tuple(reversed(emitted))
                pending, last, reach = pending[top:], last[top:], [j - top for j in reach]
        key = (last[0], pending)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = ({}, pending, last, reach)
        made = moves[byte] = (to, out)
        return made

    def _rest(self, state: tuple, rest: bytes) -> list[int]:
        """What a state still emits if ``rest`` ends the input: the one sequence of tokens whose neighbours all join.

        The longest token that joins the one before is tried first; a boundary that led nowhere is not tried again
        (each has one last token, so it cannot lead on later).
        """
        _, pending, last, _ = state
        piece, own, longest, known = pending + rest, self.own, self.longest, self._joins
        n, at, before, out, dead = len(piece), 0, last[0], [], set()
        size = min(n, longest.get(piece[:4], 3))
        while at < n:
            while size:
                token = own.get(piece[at : at + size])
                if token is not None and at + size not in dead:
                    if before == -1:
                        break
                    fits = known.get(before << 20 | token)
                    if fits or (fits is None and self.joins(before, token)):
                        break
                size -= 1
            if size:
                out.append(token)
                at += size
                before = token
                size = longest.get(piece[at : at + 4], 3)
                if size > n - at:
                    size = n - at
            else:
                dead.add(at)
                size = self.size_of[out.pop()]
                at -= size
                before = out[-1] if out else last[0]
                size -= 1
        return out

    def encode(self, piece: bytes) -> tuple:
        """Ids of one match of the split pattern: known moves, and a short tail without."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(self.states) > self.limit:
            self._reset()
        state, out, left = self.start, [], len(piece)
        for byte in piece:
            made = state[0].get(byte, 0)
            if made.__class__ is int:
                if made < self.OFTEN - 1 and left <= self.TAIL:
                    state[0][byte] = made + 1
                    break
                made = self._move(state, byte)
            state, more = made
            if more:
                out += more
            left -= 1
        return (*out, *self._rest(state, piece[len(piece) - left :]))


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the text that is complete, and keeps the bytes of an unfinished character.

    The state is the unfinished tail (at most three bytes); bytes that can never be valid become U+FFFD.
    """

    def __init__(self):
        self.tail = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end may still become a character."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b < 0x80:
                return 0
            if b >= 0xC0:  # a leading byte: it needs 2, 3 or 4 bytes
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if need <= k:
                    return 0
                if k > 1:  # the second byte's range depends on the first
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    if not low <= data[-k + 1] <= high:
                        return 0
                return k
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.tail + data
        k = 0 if last else self.unfinished(data)
        self.tail = data[len(data) - k :] if k else b""
        return (data[: len(data) - k] if k else data).decode("utf-8", "replace")


class Codec:
    """Encodes and decodes whole texts with the vocabulary of a rank file."""

    def __init__(self, rank_path: str, pattern: str, remember: int = 150_000):
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fst, self.pattern, self.remember = Transducer(ranks), regex.compile(pattern), remember
        self.bytes_of = self.fst.bytes_of
        # A space after a non-space always starts a match of this family of patterns, so texts are cut there and units remembered.
        self.unit_cut = re.compile(r"(?<=\S) ") if r"\s+(?!\S)|\s+" in pattern and r" ?\p{L}+" in pattern else None
        self.spaced = re.compile(r"\s ")  # without it, each space but a text's first is a cut
        # what units gave: the latest, and those before, which are kept if met again
        self.units: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.newline = self.fst.encode(b"\n")

    def unit(self, unit: str) -> tuple:
        if (out := self.older.get(unit)) is None:
            if self.unit_cut is None:
                out = self.pieces(unit)
            elif unit.isalpha() or (unit[0] == " " and unit[1:].isalpha()):
                out = self.fst.encode(unit.encode("utf-8", "surrogatepass"))  # letters are one match
            else:
                out = self.parts(unit)
        return self.keep(unit, out)

    def parts(self, unit: str) -> tuple:
        """A unit with more than a word in it: a newline between others is a match, and so are the marks after a word."""
        head, line, tail = unit.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            known = self.units
            return (known.get(head) or self.unit(head)) + self.newline + (known.get(tail) or self.unit(tail))
        word = unit.rstrip(MARKS)
        if 1 < len(word) < len(unit) and (word[1:] if word[0] == " " else word).isalpha():
            return (self.units.get(word) or self.unit(word)) + self.fst.encode(unit[len(word) :].encode())
        return self.pieces(unit)

    def pieces(self, unit: str) -> tuple:
        return tuple(chain.from_iterable(self.fst.encode(p.encode("utf-8", "surrogatepass")) for p in self.pattern.findall(unit)))

    def keep(self, unit: str, out: tuple) -> tuple:
        if len(unit) <= 64:
            self.units[unit] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.unit_cut is None:
            return list(self.unit(text))
        known, unit = self.units, self.unit
        if text[0] != " " and "\x00" not in text and self.spaced.search(text) is None:
            got = [known.get(u) or unit(u) for u in text.replace(" ", "\x00 ").split("\x00")]
        else:
            first, *rest = self.unit_cut.split(text)
            got = [known.get(first) or unit(first)] if first else []
            got += [known.get(u) or unit(u) for u in map(" ".__add__, rest)]
        return list(chain.from_iterable(got))

    def decode(self, ids) -> str:
        """Streams the ids' bytes through the UTF-8 machine in chunks."""
        stream, of, out = Utf8Stream(), self.bytes_of, []
        for i in range(0, len(ids), 8192):
            out.append(stream.feed(b"".join(map(of.__getitem__, ids[i : i + 8192]))))
        return "".join([*out, stream.feed(b"", last=True)])

    def trim(self) -> None:
        """Bounds the memory of what is remembered; called between batches."""
        if len(self.units) > self.remember:
            self.older, self.units = self.units, {}

    def rest(self) -> None:
        """Forgets all that was remembered, for other work that follows in this process."""
        self.older, self.units = {}, {}
        self.fst._joins.clear()
        self.fst._reset()


@contextmanager
def working(rank_path: str, pattern: str, release: bool):
    """A worker's codec for a task. What it makes holds no cycles, and millions of tuples make searching for some dear."""
    c = codec(rank_path, pattern)
    gc.disable()
    try:
        yield c
    finally:
        gc.enable()
        if release:
            c.rest()
            gc.collect()


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str) -> Codec:
    """One per Python worker, rank file and pattern."""
    return Codec(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, release: bool = False) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) and, if named, one with the text decoded from those ids.

    One pass, no shuffle; encoding and decoding share a Python worker. A null or empty text gives no ids and an
    empty decoded text. Other columns pass through unchanged (``ids``/``decoded`` replace columns so named);
    rows may repeat; an empty table gives an empty table. With ``release`` a task leaves nothing remembered in its
    Python worker, which costs the next task some time and leaves the memory to other stages.
    """

    def run(parts):
        with working(rank_path, pattern, release) as c:
            for _, texts in parts:
                all_ids = [c.encode(t.as_py()) for t in texts]
                ends = np.cumsum([0, *map(len, all_ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(all_ids), np.int32, int(ends[-1]))
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    made.append(pa.array([c.decode(x) for x in all_ids], pa.string()))
                c.trim()
                yield made

    return with_columns(docs, text, {ids: "array<int>", **({decoded: "string"} if decoded else {})}, run)


def decode(rows: DataFrame, rank_path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column ``text`` decoded from the array ``ids`` (null or empty: empty text)."""
    src = rows.select(*[c for c in rows.columns if c != text])
    at = src.columns.index(ids)

    def run(batches):
        c = codec(rank_path, pattern)
        for b in batches:
            out = pa.array([c.decode([i for i in x or [] if i is not None]) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), f"`{text}` string"])
    return src.mapInArrow(run, schema)
