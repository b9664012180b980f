"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation runs without a regular expression.  Every code point becomes a symbol
(its class, with what the next one or two characters say), every symbol is a function
from state to state of a small automaton, and the functions are composed block-wise with
numpy: composition is associative, so the blocks are scanned side by side and only the
block totals one after the other.  State and symbol then tell where a token begins.

Long texts are cut where a token begins whatever stands before and after: at white space behind
something else, and between letters and numbers.  Portions of some ``LONGEST`` characters are
encoded one after the other, so that no array grows with the text but that of its ids.

Nulls are read as empty texts; an empty text has no ids and decodes to no bytes; an empty table
gives an empty result.  Repeated rows are encoded each for itself.  Columns other than the id and
the text are left out, so that none can clash with the results.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks

#: Characters of ``\s`` and not of ``\S``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
#: What may follow an apostrophe that begins a token.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

#: Letters and numbers that version 16 of Unicode added to version 15.1,
#: which Python's tables may not have yet.
ADDED_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 "
    "11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
ADDED_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
)

#: About how many characters are encoded at once.
LONGEST = 1 << 18
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[^\\W\\d_])(?=[0-9])|(?<=[0-9])(?=[^\\W\\d_])")

LETTER, NUMBER, OTHER, SHORT, LONG, INNER, BLANK, WIDE, END = range(9)
NONE, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_LEFT, TWO_LEFT = range(8)
_STATES = range(8)


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {ONE_LEFT: NONE, TWO_LEFT: ONE_LEFT}.get(state, LETTERS)
    if symbol in (SHORT, LONG) and state not in (OTHERS, PREFIX):
        return ONE_LEFT if symbol == SHORT else TWO_LEFT
    return {NUMBER: NUMBERS, INNER: SPACES, WIDE: SPACES, BLANK: PREFIX, END: NONE}.get(
        symbol, OTHERS
    )


def _begins(state: int, symbol: int) -> bool:
    goes_on = {
        LETTER: (LETTERS, PREFIX, ONE_LEFT, TWO_LEFT),
        NUMBER: (NUMBERS, PREFIX),
        OTHER: (OTHERS, PREFIX),
        SHORT: (OTHERS, PREFIX),
        LONG: (OTHERS, PREFIX),
        INNER: (SPACES,),
    }
    return state not in goes_on.get(symbol, ())


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Functions by number, their compositions, the symbols' functions, beginnings."""
    functions = [tuple(_step(s, x) for s in _STATES) for x in range(9)]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    for f in functions:  # grows while it is read, until it is closed under composition
        for g in functions[:9]:
            h = tuple(g[f[s]] for s in _STATES)
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
    n = len(functions)
    composed = np.empty((n, n), np.uint8)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            composed[i, j] = known[tuple(g[f[s]] for s in _STATES)]
    begins = np.array([[_begins(s, x) for x in range(9)] for s in _STATES])
    return np.array(functions, np.uint8), composed, begins


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, OTHER, SHORT (apostrophe), INNER (white)."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
        np.uint8,
        0x110000,
    )
    for kind, added in ((LETTER, ADDED_LETTERS), (NUMBER, ADDED_NUMBERS)):
        for first, last in (x.split("-") for x in added.split()):
            table[int(first, 16) : int(last, 16) + 1] = kind
    table[[ord(c) for c in WHITE]] = INNER
    table[ord("'")] = SHORT
    return table


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    symbol = classes()[points]
    apostrophes = np.flatnonzero(symbol == SHORT)
    symbol[ends] = END
    white = symbol == INNER
    last = white[:-1] & ~white[1:] & (symbol[1:] != END)
    found = np.flatnonzero(last)
    symbol[found] = np.where(points[found] == 0x20, BLANK, WIDE)
    if apostrophes.size:
        apostrophes = apostrophes[symbol[apostrophes] != END]
        padded = np.append(np.where(symbol == END, 0, points), [0, 0])
        one, two = padded[apostrophes + 1], padded[apostrophes + 2]
        kind = np.full(apostrophes.size, OTHER, np.uint8)
        for suffix in SUFFIXES:
            if len(suffix) == 1:
                kind[one == ord(suffix)] = SHORT
            else:
                kind[(one == ord(suffix[0])) & (two == ord(suffix[1]))] = LONG
        symbol[apostrophes] = kind
    return symbol


def token_starts(points: np.ndarray, ends: np.ndarray, width: int = 128) -> np.ndarray:
    """Where tokens begin among code points; ``ends`` are the places of end marks."""
    functions, composed, begins = _tables()
    symbol = _symbols(points, ends)
    rows = -(-len(symbol) // width)
    padded = np.full(rows * width, END, np.uint8)
    padded[: len(symbol)] = symbol
    turned = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, n = composed.ravel(), np.uint16(len(composed))
    scan = np.empty_like(turned)
    scan[0] = turned[0]
    for k in range(1, width):
        np.take(flat, scan[k - 1] * n + turned[k], out=scan[k])
    first = np.empty(rows, np.uint8)
    state = NONE
    totals = functions[scan[-1]].tolist()
    for row, total in enumerate(totals):
        first[row] = state
        state = total[state]
    before = np.empty_like(turned)
    before[0] = first
    before[1:] = functions.ravel()[scan[:-1].astype(np.uint16) * 8 + first]
    starts = begins.ravel()[before.astype(np.uint16) * 9 + turned]
    return np.flatnonzero(starts.T.ravel()[: len(symbol)])


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def distinct_slices(
    points: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One index of each distinct slice, and for each slice which of these it equals.

    Slices are told apart by polynomial hashes, taken from one running sum; then every
    slice is compared with the one that stands for it.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    power, inverse = _powers(1 << (len(points) + 1).bit_length())
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed * power[: len(points)], out=sums[1:])
    sizes = stops - starts
    hashes = (sums[stops] - sums[starts]) * inverse[starts]
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    back = starts[first][which] - starts
    end = np.cumsum(sizes)
    place = np.arange(end[-1]) + np.repeat(starts - (end - sizes), sizes)
    same = np.array_equal(sizes, sizes[first][which]) and np.array_equal(
        points[place], points[place + np.repeat(back, sizes)]
    )
    if not same:  # two hashes fell together
        seen: dict[bytes, int] = {}
        keys = [points[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
        which = np.array([seen.setdefault(k, len(seen)) for k in keys])
        _, first = np.unique(which, return_index=True)
    return first, which


def portions(text: str) -> Iterator[str]:
    """A text cut at sure beginnings of tokens, the next one behind every ``LONGEST`` characters."""
    at = 0
    while len(text) - at > LONGEST:
        cut = _CUT.search(text, at + LONGEST)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary(dict):
    """Pieces of text to their ids: merged on first sight, then remembered.

    Pieces not seen before are merged together, a round of numpy operations making one
    merge in each.  Once ``most`` pieces are remembered, the memory starts anew.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 100_000):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        self.pairs = self.made = None

    def _pair_up(self) -> None:
        """Every way in which two ids make a third, sorted by the two."""
        left, right, made = [], [], []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(key)
        self.pairs = np.append(key[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], len(self.bytes_of))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of ids merges to; beyond all ids if to none."""
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], len(self.bytes_of))

    def _merged(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """Merge in each piece the leftmost pair of lowest rank until none is known."""
        if self.pairs is None:
            self._pair_up()
        never, n = len(self.bytes_of), len(raws)
        size = np.fromiter(map(len, raws), np.int64, n)
        wide = int(size.max())
        padded = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in raws), np.uint8)
        ids = self.single[padded].reshape(n, wide)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        column = np.arange(wide)
        rank[column[1:] >= size[:, None]] = never
        done: list[tuple[int, ...]] = [()] * n
        row = np.arange(n)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            open_ = best < never
            for i, k, x in zip(row[~open_].tolist(), size[~open_].tolist(), ids[~open_].tolist()):
                done[i] = tuple(x[:k])
            if not open_.any():
                return done
            if not open_.all():
                row, size, ids, rank = row[open_], size[open_], ids[open_], rank[open_]
                at, best = at[open_], best[open_]
            each, size = np.arange(len(row)), size - 1
            ids[each, at] = best
            ids[:, 1:-1] = np.where(column[1:-1] > at[:, None], ids[:, 2:], ids[:, 1:-1])
            rank[:, :-1] = np.where(column[:-2] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = never
            inside = at + 1 < size
            i, k = each[inside], at[inside]
            rank[i, k] = self._rank(ids[i, k], ids[i, k + 1])
            i, k = each[at > 0], at[at > 0]
            rank[i, k - 1] = self._rank(ids[i, k - 1], ids[i, k])

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of all these pieces."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self[piece] = (rank,)
            elif len(raw) > 64:
                self[piece] = self._merged_long(raw)
            else:
                by_width.setdefault(-(-len(raw) // 4), []).append((piece, raw))
        for group in by_width.values():
            for first in range(0, len(group), 20_000):
                part = group[first : first + 20_000]
                self.update(zip([x for x, _ in part], self._merged([x for _, x in part])))

    def _merged_long(self, raw: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for very long pieces."""
        get, n = self.ranks.get, len(raw)
        stop, after = list(range(1, n + 1)), list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = get(raw[i : stop[j]])
                if rank is not None:
                    heap.append((rank, i, stop[j])) if not ready else heapq.heappush(
                        heap, (rank, i, stop[j])
                    )

        ready = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or stop[j] != end:
                continue
            stop[i], alive[j], after[i] = end, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        found, i = [], 0
        while i < n:
            found.append(self.ranks[raw[i : stop[i]]])
            i = after[i]
        return tuple(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        found: list[np.ndarray] = []
        waiting: list[str] = []
        held = 0
        for text in texts:
            if waiting and held + len(text) > LONGEST:
                found += self._encoded(waiting)
                waiting, held = [], 0
            if len(text) > LONGEST:
                found.append(np.concatenate([self._encoded([x])[0] for x in portions(text)]))
            else:
                waiting.append(text)
                held += len(text)
        return found + self._encoded(waiting) if waiting else found

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        marks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = token_starts(points, marks)
        of_mark = np.searchsorted(starts, marks)  # an end mark is a token of its own
        stops = np.delete(np.append(starts[1:], len(whole)), of_mark)
        starts = np.delete(starts, of_mark)
        first, which = distinct_slices(points, starts, stops)
        pieces = [
            whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())
        ]
        if len(self) > self.most:
            self.clear()
        new = [x for x in pieces if x not in self]
        self.learn(new)
        known = [self[x] for x in pieces]
        for piece in new:
            if len(piece) > 64:
                self.pop(piece, None)
        flat = np.fromiter(chain.from_iterable(known), "<u4")
        count = np.fromiter(map(len, known), np.int64, len(known))
        many = count[which]
        stop = np.cumsum(many)
        offset = (np.cumsum(count) - count)[which] - (stop - many)
        ids = flat[np.repeat(offset, many) + np.arange(many.sum())]
        cut = np.append(0, stop)[of_mark - np.arange(len(of_mark))]
        return np.split(ids, cut[:-1])

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """Bytes of the ids; with the tokens' end offsets their length is checked."""
        parts = (ids[first : first + LONGEST].tolist() for first in range(0, len(ids), LONGEST))
        raw = b"".join([b"".join(map(self.bytes_of.__getitem__, part)) for part in parts])
        if ends is not None and len(raw) != (int(ends[-1]) if len(ends) else 0):
            raise ValueError("the ids don't fit their offsets")
        return raw

    def decode_span(self, ids: np.ndarray, ends: np.ndarray, start: int, stop: int) -> bytes:
        """The bytes from start to stop, decoding only the tokens that hold them."""
        first = int(np.searchsorted(ends, start, "right"))
        last = min(int(np.searchsorted(ends, stop)) + 1, len(ids))
        base = int(ends[first - 1]) if first else 0
        return self.decode(ids[first:last])[start - base : max(stop, start) - base]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids`` and ``ends``.

    ``ids`` packs the token ids and ``ends`` the end offset of each token in the text's
    UTF-8 bytes, both as little-endian unsigned 32-bit integers.  ``path`` is the rank
    file, which every executor has installed under the same name.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in blocks(batches, most_bytes=1 << 19):
            ids = words.encode([x or "" for x in batch.column(1).to_pylist()])
            ends = [np.cumsum(words.sizes[x]).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array(ends, pa.binary()),
                ],
                [id_col, "n_tokens", "ids", "ends"],
            )

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, ends binary"
    )


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """What ``encode`` returned, with ``decoded``: the bytes of the ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in blocks(batches, text=2):
            packed = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            raw = [
                words.decode(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in packed
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())],
                [id_col, "n_tokens", "ids", "ends", "decoded"],
            )

    return encoded.select(id_col, "n_tokens", "ids", "ends").mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, ends binary, decoded binary"
    )


def round_trip(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row the number of ids and digests of the ids and of what these decode to.

    Encodes and decodes in one pass of one worker, so that ids needn't travel in between and
    only half as many workers hold a vocabulary as for ``decode(encode(...))``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in blocks(batches, most_bytes=1 << 19):
            ids = words.encode([x or "" for x in batch.column(1).to_pylist()])
            raw = [words.decode(x, np.cumsum(words.sizes[x])) for x in ids]
            packed = [x.tobytes() for x in ids]
            arrays = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha256(x).hexdigest() for x in packed]),
                pa.array([sha256(x).hexdigest() for x in raw]),
            ]
            arrays += [pa.array(packed, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *columns])

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
