"""Byte-level BPE as a lazily determinised finite-state transducer.

The transducer reads the bytes of a piece of text and writes token ids. Its
nondeterministic form walks a trie of the vocabulary from one token boundary to
the next; a boundary after token t, reached from one after token p, is allowed
only if merging the bytes of p and t gives exactly [p, t]. A token sequence all
of whose neighbours agree in this way is the one that the merges give, so one
and only one path ends at every boundary.

What a path may still become is all that tells it apart from others: where it
stands in the trie, and which tokens below that place its last token forbids.
Most last tokens forbid nothing there, and paths that may become nothing are
dropped. A deterministic state is the set of live paths in this reduced form,
which keeps neither the last tokens nor those not yet written, so few states
serve all text. Each transition says which token ends at its byte; what is
written follows by going back from boundary to boundary, up to the place that
all live paths have in common.

States and transitions are made when first needed. Beyond a bound the half that
was not used for longest is forgotten, and made again should it be needed again.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

# Fixed value: how the public byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_ASCII = re.compile(PIECES.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII)

# Blanks that a unit may be cut before, and the UTF-8 ends of the other blanks of Unicode.
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
_OTHER_BLANKS = ("\x0b", "\x0c", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")

TOKEN_BITS = 20
TOKEN_MASK = (1 << TOKEN_BITS) - 1
ROW = array("q", [-1]) * 256
WINDOW = 512
LONG_PIECE = 128
PIECES_AT_ONCE = 20_000
KEPT_LENGTH = 48
MAX_STATES = 40_000


def _code(raw: bytes) -> int:
    return int.from_bytes(raw.rjust(3, b"\0"))


_OTHER_CODES = np.array(sorted(_code(c.encode()) for c in _OTHER_BLANKS))


def unit_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of texts: at each text and at each blank after something that is none.

    No piece has a blank after something else, so units can be split into
    pieces one by one, and equal ones alike.
    """
    blank = _BLANK[data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    # runs of blanks with others of Unicode among them stay whole
    before = data[at - 1]
    maybe = np.flatnonzero((before >= 0x80) | (before == 0x0B) | (before == 0x0C))
    if len(maybe):
        end = at[maybe]
        one = data[end - 1].astype(np.int64)
        two = np.where(one >= 0x80, data[np.maximum(end - 2, 0)], 0).astype(np.int64)
        three = np.where((one >= 0x80) & (two < 0xC0), data[np.maximum(end - 3, 0)], 0).astype(np.int64)
        at = np.delete(at, maybe[np.isin(three << 16 | two << 8 | one, _OTHER_CODES)])
    marks = np.zeros(len(data) + 1, bool)
    marks[at] = True
    marks[text_starts] = True
    return np.flatnonzero(marks[: len(data)])


def pieces(text: str) -> list[str]:
    """The pieces of a text or a unit, which concatenate to it."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id, of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Merges:
    """What the ranks say about pairs of tokens. Tokens are also known by their place in the order of their bytes, in which those with a common beginning stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.top = max(ranks.values(), default=-1) + 1
        self.halves: dict[int, tuple[int, int]] = {}
        pairs = []
        get = ranks.get
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            splits = [(a, b) for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
            pairs += [(a, rank, b) for a, b in splits]
            made = splits if len(splits) == 1 else [s for s in splits if max(s) < rank and self._stood(*s, rank)]
            self.halves[rank] = made[0] if made else (rank, rank) if len(token) == 1 else self._outer_parts(token)
        self._lay_out()
        self._index(pairs)

    def merged(self, raw: bytes, stop: int = 1) -> list[int]:
        """The merges applied one by one, lowest rank and then leftmost first, down to ``stop`` parts; for short inputs."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > stop:
            found = [(self.ranks[both], i) for i in range(len(parts) - 1) if (both := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _outer_parts(self, token: bytes) -> tuple[int, int]:
        parts = self.merged(token, stop=2)
        return parts[0], parts[-1]

    def _stood(self, left: int, right: int, before: int) -> bool:
        """Whether the boundary between two tokens stood until merges of rank ``before``.

        Merges happen in order of rank, so time is run backwards: the later of
        the two tokens beside the boundary is taken apart, and a merge across
        the boundary that would have come before it means that it never stood
        there. Of equal ranks the left one comes first.
        """
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            inner = self.halves[left][1] if len(self.bytes_of[left]) > 1 else left
            outer = self.halves[right][0] if len(self.bytes_of[right]) > 1 else right
            if inner == left and outer == right:
                return True
            if outer == right or (inner != left and left > right):
                left, before = inner, left
            else:
                right, before = outer, right + 1

    def agree(self, left: int, right: int) -> bool:
        """Whether [left, right] is what merging their bytes gives."""
        return self._stood(left, right, self.top)

    def _lay_out(self) -> None:
        """Tokens in an order in which each is followed by those that begin with it as a left half, the latest of them first."""
        below: dict[int, list[int]] = {}
        for token, (left, _) in self.halves.items():
            if left != token:
                below.setdefault(left, []).append(token)
        order, ends = [], np.zeros(self.top + 1, np.int64)
        open_ = [t for t in sorted(self.bytes_of) if self.halves[t][0] == t]
        while open_:
            token = open_.pop()
            if token < 0:
                ends[~token] = len(order)
                continue
            order.append(token)
            open_.append(~token)
            open_ += sorted(below.get(token, ()))
        place = np.zeros(self.top + 1, np.int64)
        place[order] = np.arange(len(order))
        by_bytes = sorted(self.ranks)
        self.lexical = np.zeros(self.top + 1, np.int32)
        self.lexical[[self.ranks[t] for t in by_bytes]] = np.arange(len(by_bytes), dtype=np.int32)
        self.by_bytes, self._place, self._ends = by_bytes, place, ends
        self._lexical_of = self.lexical[order]
        self._below = np.array([(left, self.top - token, ends[token]) for left, some in below.items() for token in some], np.int64).reshape(-1, 3)

    def _index(self, pairs: list[tuple[int, int, int]]) -> None:
        """For each token the others that merge with it on its right, by rank, and the stretch of tokens which that forbids after it.

        A merge of rank r with x forbids x itself, and whatever took x in as its left half not before r.
        """
        rows = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        left, rank, right = rows.T
        key = self._below[:, 0] * (self.top + 1) + self._below[:, 1]
        by = np.argsort(key)
        key, ends = key[by], self._below[by, 2]
        at = np.searchsorted(key, right * (self.top + 1) + self.top - rank, "right") - 1
        inside = (at >= 0) & (key[at] // (self.top + 1) == right) if len(key) else np.zeros(len(rows), bool)
        begin = self._place[right]
        stop = np.where(inside, ends[at] if len(key) else 0, begin + 1)
        self._rank, self._begin, self._stop = rank.tolist(), begin, stop
        self._from = np.searchsorted(left, np.arange(self.top + 2)).tolist()

    def forbidding(self, token: int) -> tuple[tuple[int, int], ...]:
        """Which rows of the index forbid something after this token: those of its right halves, each before it was taken in."""
        found, before = [], self.top
        while True:
            begin, end = self._from[token], self._from[token + 1]
            stop = bisect_left(self._rank, before, begin, end)
            if stop > begin:
                found.append((begin, stop))
            inner = self.halves[token][1]
            if inner == token or len(self.bytes_of[token]) == 1:
                return tuple(found)
            token, before = inner, token

    def forbidden(self, rows: tuple[tuple[int, int], ...]) -> np.ndarray:
        """Places, in the order of bytes, of the tokens that these rows forbid, ascending."""
        if not rows:
            return np.empty(0, np.int32)
        which = np.concatenate([np.arange(a, b) for a, b in rows])
        begin = self._begin[which]
        many = self._stop[which] - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        marks = np.zeros(len(self.by_bytes), bool)
        marks[self._lexical_of[at]] = True
        return np.flatnonzero(marks).astype(np.int32)


class Transducer:
    def __init__(self, merges: Merges | dict[bytes, int], max_states: int = MAX_STATES):
        """``merges`` may be given as the ranks themselves. Memory is about 4 KB a state."""
        self.merges = merges if isinstance(merges, Merges) else Merges(merges)
        self.max_states = max_states
        self.bytes_of = self.merges.bytes_of
        self.pieces_read = 0
        self.size = [len(self.bytes_of.get(t, b"")) for t in range(self.merges.top)]
        self.sizes = np.array(self.size, np.int64)
        self._grow_trie()
        self.clock = self.evictions = 0
        self._clear()

    def _grow_trie(self) -> None:
        """Nodes with their depth, their token, and the stretch of tokens below them in the order of bytes."""
        self.child: dict[int, int] = {}
        self.token_at, self.depth, self.low, self.high = [-1], [0], [0], [0]
        path, before = [0], b""
        ordered = self.merges.by_bytes
        for place, token in enumerate(ordered):
            same = 0
            while same < len(before) and before[same] == token[same]:
                same += 1
            for node in path[same + 1 :]:
                self.high[node] = place
            del path[same + 1 :]
            for byte in token[same:]:
                node = self.child[path[-1] << 8 | byte] = len(self.token_at)
                self.token_at.append(-1)
                self.depth.append(len(path))
                self.low.append(place)
                self.high.append(place)
                path.append(node)
            self.token_at[path[-1]] = self.merges.ranks[token]
            self.low[path[-1]] = place + 1
            before = token
        for node in path:
            self.high[node] = len(ordered)

    # what a path is forbidden: numbered sets of places, 0 being none

    def _clear(self) -> None:
        self.sets = [array("i")]
        self.set_number: dict[bytes, int] = {b"": 0}
        self._after_token: dict[int, int] = {}
        self._after_rows: dict[tuple, int] = {}
        self._narrowed: dict[tuple[int, int], int] = {}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {(0,): 0}
        self.table = array("q", ROW)
        self.used = array("q", [0])

    def _number_of(self, raw: bytes) -> int:
        known = self.set_number.get(raw)
        if known is None:
            known = self.set_number[raw] = len(self.sets)
            self.sets.append(array("i", raw))
        return known

    def _after(self, token: int) -> int:
        known = self._after_token.get(token)
        if known is None:
            rows = self.merges.forbidding(token)
            known = self._after_rows.get(rows)
            if known is None:
                known = self._after_rows[rows] = self._number_of(self.merges.forbidden(rows).tobytes())
            self._after_token[token] = known
        return known

    def _below(self, barred: int, node: int) -> int:
        """What of a set lies below a node: its number, or -1 if that is everything there."""
        if not barred:
            return 0 if self.high[node] > self.low[node] else -1
        known = self._narrowed.get((barred, node))
        if known is None:
            low, high, places = self.low[node], self.high[node], self.sets[barred]
            begin = bisect_left(places, low)
            end = bisect_left(places, high, begin)
            known = -1 if end - begin == high - low else self._number_of(places[begin:end].tobytes())
            self._narrowed[barred, node] = known
        return known

    def _learn(self, state: int, byte: int) -> int:
        """The step from a state by a byte: (number of the next state << TOKEN_BITS) | token that ends here.

        A state is what the last token forbids, then (node, forbidden below it) of each open path, the longest first.
        """
        key = self.states[state]
        paths, token = [], -1
        for i in range(1, len(key) + 1, 2):
            node, barred = (key[i], key[i + 1]) if i < len(key) else (0, key[0])
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            ends = self.token_at[node]
            if token < 0 <= ends and not (barred and self._holds(barred, ends)):
                token = ends
            barred = self._below(barred, node)
            if barred >= 0:
                paths += (node, barred)
        fresh = (self._after(token), *paths)
        number = self.numbers.get(fresh)
        if number is None:
            number = self.numbers[fresh] = len(self.states)
            self.states.append(fresh)
            self.table.extend(ROW)
            self.used.append(self.clock)
        step = self.table[state << 8 | byte] = number << TOKEN_BITS | token
        return step

    def _holds(self, barred: int, token: int) -> bool:
        places, place = self.sets[barred], self.merges.lexical[token]
        at = bisect_left(places, place)
        return at < len(places) and places[at] == place

    def _evict(self, state: int = 0) -> int:
        """Forget the half of the states that was not used for longest, and sets that no other has; returns the new number of ``state``."""
        used = np.array(self.used, np.int64)
        kept = np.argsort(-used, kind="stable")[: self.max_states // 2]
        kept = np.unique(np.concatenate([[0, state], kept]))
        new = np.full(len(used), -1, np.int64)
        new[kept] = np.arange(len(kept))
        rows = np.array(self.table, np.int64).reshape(-1, 256)[kept]
        target = np.where(rows < 0, -1, new[np.maximum(rows, 0) >> TOKEN_BITS])
        rows = np.where(target < 0, -1, target << TOKEN_BITS | rows & TOKEN_MASK)
        keys, sets = [self.states[i] for i in kept], self.sets
        self._clear()
        self.states = [tuple(x if i % 2 else self._number_of(sets[x].tobytes()) for i, x in enumerate(key)) for key in keys]
        self.numbers = {key: i for i, key in enumerate(self.states)}
        self.table, self.used = array("q", rows.tobytes()), array("q", used[kept].tobytes())
        self.evictions += 1
        return int(new[state])

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece; empty for an empty piece. Linear in its length.

        Bytes are read in windows; after each, the tokens before the place that
        all open paths go through are written, so output lags by no more than a
        window and the tokens of paths that stay open.
        """
        out: list[int] = []
        ends: list[int] = []
        state = 0
        for begin in range(0, len(raw), WINDOW):
            if len(self.states) > self.max_states:
                state = self._evict(state)
            table = self.table
            for byte in raw[begin : begin + WINDOW]:
                step = table[state << 8 | byte]
                if step < 0:
                    step = self._learn(state, byte)
                state = step >> TOKEN_BITS
                ends.append(step & TOKEN_MASK)
                self.used[state] = self.clock
            done = len(ends) if begin + WINDOW >= len(raw) else self._settled(state, ends)
            out += self._back(ends, done)
            del ends[:done]
        self.pieces_read += 1
        return out

    def encode_pieces(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, all in one array, and where each piece's begin, with the end of the last.

        Pieces go through the same table side by side, one byte at a time; long
        ones, of which few are at the same place, one by one.
        """
        ids, sizes = [np.empty(0, np.int32)], []
        for begin in range(0, len(raws), PIECES_AT_ONCE):
            some = raws[begin : begin + PIECES_AT_ONCE]
            one, many = self._side_by_side(some)
            ids.append(one)
            sizes.append(many)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))])

    def _side_by_side(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.states) > self.max_states:
            self._evict()
        self.clock += 1
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        stops = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raws), np.uint8)
        # the token that ends at each byte: first of every path, then of the one that is left
        ends = np.full(len(data), -1, np.int64)
        chosen = np.full(len(data), -1, np.int32)
        order = np.argsort(-lengths, kind="stable")
        order = order[np.searchsorted(-lengths[order], -LONG_PIECE) :]
        start, length = (stops - lengths)[order], lengths[order]
        state = np.zeros(len(order), np.int64)
        for at in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -at))
            where = start[:live] + at
            step = self._steps(state[:live] << 8 | data[where])
            state[:live] = step >> TOKEN_BITS
            ends[where] = step & TOKEN_MASK
            np.frombuffer(self.used, np.int64)[state[:live]] = self.clock
        start, back = start[length > 0], length[length > 0]
        while len(back):
            where = start + back - 1
            token = ends[where]
            chosen[where] = token
            back = back - self.sizes[token]
            start, back = start[back > 0], back[back > 0]
        self.pieces_read += len(order)
        for i in np.flatnonzero(lengths > LONG_PIECE):
            # tokens are at least a byte long, so they have room at the end of the piece's own bytes
            found = self.encode_piece(raws[i])
            chosen[stops[i] - len(found) : stops[i]] = found
        there = chosen >= 0
        before = np.concatenate([[0], np.cumsum(there)])
        return chosen[there], before[stops] - before[stops - lengths]

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        steps = np.frombuffer(self.table, np.int64)[keys]
        unknown = np.flatnonzero(steps < 0)
        if len(unknown):
            for key in np.unique(keys[unknown]).tolist():
                self._learn(key >> 8, key & 255)
            steps[unknown] = np.frombuffer(self.table, np.int64)[keys[unknown]]
        return steps

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to the boundary ``at``, found from there backwards."""
        size, found = self.size, []
        while at:
            token = ends[at - 1]
            found.append(token)
            at -= size[token]
        return found[::-1]

    def _settled(self, state: int, ends: list[int]) -> int:
        """The last boundary that all open paths of a state have behind them."""
        places = {len(ends), *(len(ends) - self.depth[node] for node in self.states[state][1::2])}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.size[ends[last - 1]])
        return places.pop()


class _Met(dict):
    """Texts met so far, numbered; new ones are listed, and long ones, which hardly come again, are not kept by name."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, text: str) -> int:
        number = len(self.starts) - 1 + len(self.new)
        self.new.append(text)
        if len(text) <= KEPT_LENGTH:
            self[text] = number
        return number

    def add(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """The ids of the new ones."""
        self.new = []
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given ones, all in one array, and where each one's begin, with the end of the last."""
        many = self.starts[which + 1] - self.starts[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        return self.ids[np.repeat(self.starts[which] - ends[:-1], many) + np.arange(ends[-1])], ends


class Encoder:
    """Texts to ids. Units and pieces are remembered up to ``max_pieces`` each, then forgotten together; every piece that is not remembered goes through the transducer."""

    def __init__(self, merges: Merges | dict[bytes, int], max_pieces: int = 250_000, max_states: int = MAX_STATES):
        self.transducer, self.max_pieces = Transducer(merges, max_states), max_pieces
        self.units, self.pieces = _Met(), _Met()

    def encode(self, texts: pa.StringArray | Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin and end in it. Null and empty texts have none."""
        if not isinstance(texts, pa.StringArray):
            texts = pa.array(list(texts), pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or bounds[0] == bounds[-1]:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = data[int(bounds[0]) : int(bounds[-1])]
        bounds -= bounds[0]
        starts = unit_starts(np.frombuffer(raw, np.uint8), bounds)
        cut = np.append(starts, bounds[-1]).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), raw).dictionary_encode()
        numbers = self._numbers(units.dictionary.to_pylist())
        ids, ends = self.units.gather(numbers[units.indices.to_numpy()])
        return ids, ends[np.searchsorted(starts, bounds)]

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        """Numbers of units, whose ids are then known."""
        for met in (self.units, self.pieces):
            if len(met.starts) > self.max_pieces:
                met.forget()
        numbers = np.fromiter(map(self.units.__getitem__, distinct), np.int64, len(distinct))
        if self.units.new:
            split = [pieces(unit) for unit in self.units.new]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            which = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            if self.pieces.new:
                self.pieces.add(*self.transducer.encode_pieces([p.encode() for p in self.pieces.new]))
            ids, ends = self.pieces.gather(which)
            self.units.add(ids, ends[np.concatenate([[0], np.cumsum(sizes)])])
        return numbers


class Utf8Tail:
    """An incremental UTF-8 decoder: bytes in, the text that is complete out.

    Its state is the unfinished sequence at the end, at most three bytes: a lead
    byte says how many follow. Bytes that cannot be UTF-8 give U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte >= 0xC0:
                wants = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(raw) - back if back < wants else cut
                break
            if byte < 0x80:
                break
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], block: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, in parts of about ``block`` bytes; tokens may end within a character."""
    machine, waiting, size = Utf8Tail(), [], 0
    for i in ids:
        raw = bytes_of[i]
        waiting.append(raw)
        size += len(raw)
        if size >= block:
            yield machine.feed(b"".join(waiting))
            waiting, size = [], 0
    yield machine.feed(b"".join(waiting))
    yield machine.finish()
