"""Byte-level BPE of whole Arrow columns, exactly as the tokenizer file says.

The split pattern of the tokenizer is evaluated on byte classes with array
operations; every distinct piece of a batch is then encoded once and the ids
are gathered.  Rows with characters outside ASCII and the Latin letters
U+00C0-U+024F (other than the two signs among them) go through the library
itself, so the ids never depend on our classes.
"""

from __future__ import annotations

import base64

import numpy as np

from docprism.llm import textvec as tv

U64 = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _NUMBER
_CLASS[0x80:] = _LETTER  # rows with other characters never get here
_EXACT = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.zeros(256, bool)
_ODD[[0x80 + i for i in range(0x80)]] = True
_ODD[0x80:0xC0] = False
_ODD[0xC3:0xCA] = False
#: Slots of a worker's cache of encoded pieces, and ids it holds before it starts anew; both bound memory only.
SLOT_BITS = 20
SLOTS, FLAT_LIMIT = 1 << SLOT_BITS, 1 << 23


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        if path.endswith(".json"):
            import json

            vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
            to_byte = _byte_alphabet()
            ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if all(c in to_byte for c in t) and t != "<|endoftext|>"}
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.lib = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self):
        """An empty direct-mapped cache: a slot holds one piece's hash, first place in ``flat`` and number of ids."""
        self.keys = np.zeros(SLOTS, U64)
        self.firsts = np.zeros(SLOTS, np.int64)
        self.sizes = np.zeros(SLOTS, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.filled = 0

    def _look_up(self, part: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``flat`` and number of ids of each piece; pieces that the cache lacks are encoded once."""
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        first, size = self.firsts[slot], self.sizes[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            fresh, at, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            single = self.lib._core_bpe.encode_single_piece
            ids = [single(part[a:b].tobytes()) for a, b in zip(start[at], end[at])]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            firsts = self.filled + np.cumsum(sizes) - sizes
            total = self.filled + int(sizes.sum())
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(total, np.uint32)])
            self.flat[self.filled : total] = np.fromiter((x for y in ids for x in y), np.uint32)
            self.filled = total
            first[miss], size[miss] = firsts[inverse], sizes[inverse]
            slot = (fresh >> U64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[slot], self.firsts[slot], self.sizes[slot] = fresh, firsts, sizes
            # of two fresh pieces in one slot the last written counts in all three arrays
        return first, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows and ``n + 1`` offsets."""
        n = len(offsets) - 1
        base = int(offsets[0])
        part, off = data[base : int(offsets[-1])], offsets - base
        odd = _ODD[part]
        hard = (part[:-1] == 0xC3) & ((part[1:] == 0x97) | (part[1:] == 0xB7)) if len(part) else np.zeros(0, bool)
        odd[:-1] |= hard
        bad = np.zeros(n, bool)
        if odd.any():
            bad[np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)] = True
        start = _piece_starts(part, off)
        end = np.append(start[1:], len(part))
        first = np.searchsorted(start, off)
        h = _hashes(part, start, end)
        use = ~np.repeat(bad, np.diff(first))
        if self.filled > FLAT_LIMIT:
            self._reset()
        places, sizes = self._look_up(part, start[use], end[use], h[use])
        flat = self.flat[np.repeat(places, sizes) + _ramp(sizes)]
        piece_row = np.repeat(np.arange(n), np.diff(first))[use]
        counts = np.bincount(piece_row, weights=sizes, minlength=n).astype(np.int64)
        if bad.any():
            runs, ends = [], np.concatenate([[0], np.cumsum(counts)])
            for r in range(n):
                if bad[r]:
                    ids = np.array(self.lib.encode_ordinary(part[off[r] : off[r + 1]].tobytes().decode()), np.uint32)
                    counts[r] = len(ids)
                    runs.append(ids)
                else:
                    runs.append(flat[ends[r] : ends[r + 1]])
            flat = np.concatenate(runs)
        return flat, np.concatenate([[0], np.cumsum(counts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, whatever the number of tasks it runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..s-1 for each size."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exact (case kept) hash of each piece, in blocks."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + tv.BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = tv._powers(b - a + 1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(_EXACT[part[a:b]] * power[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = tv.mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def _piece_starts(part: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the pieces that the split pattern makes.

    Runs of letters, of numbers and of other signs take one plain space before
    them; a longer run of white space gives up its last character for that, or
    as a piece of its own; contractions begin at an apostrophe that begins a run.
    """
    n = len(part)
    if not n:
        return np.zeros(0, np.int64)
    cls = _CLASS[part]
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    row_start = row_start[:n]
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    change |= row_start
    space = cls == _SPACE
    starts = change.copy()
    # the last character of a white-space run that a run of another class follows in the row
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row_start[1:]
    starts |= last
    joined = last & (part == 32)  # it opens the next piece
    starts[1:] &= ~joined[:-1]
    # contractions
    quote = np.flatnonzero((part == 39) & starts)
    if len(quote):
        stop = np.append(row_start, True)

        def at(k):
            p = quote + k
            inside = p < n
            value = np.zeros(len(quote), np.uint8)
            value[inside] = part[p[inside]]
            open_ = np.ones(len(quote), bool)
            for q in range(1, k + 1):
                open_ &= ~stop[np.minimum(quote + q, n)]
            return np.where(open_, value, 0)

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
            starts[found + 1] = False
            after = found + size
            starts[after[after < n]] = True
    return np.flatnonzero(starts)
