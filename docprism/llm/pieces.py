"""Sentence-piece BPE of whole Arrow columns, exactly as the model file says.

No piece of such a vocabulary holds a space behind another character, and some
characters stand in no piece of several characters at all.  Merges never cross those
places, so texts are cut there, every distinct cut is encoded once by the library, and
the ids are gathered.
"""

from __future__ import annotations

import numpy as np

from docprism.llm import bpe

U64 = np.uint64
_SPACE = "▁"


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        single = [self.lib.is_byte(i) for i in range(n)]
        plain = [not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i)) for i in range(n)]
        for p, ok in zip(pieces, plain):
            if ok and _SPACE in p.lstrip(_SPACE):
                raise ValueError("a piece holds a space behind another character")
        joined = {c for p, ok in zip(pieces, plain) if ok and len(p) > 1 for c in p}
        #: Bytes each id stands for.
        self.length = np.array([1 if s else len(p.replace(_SPACE, " ").encode()) if ok else 0 for p, s, ok in zip(pieces, single, plain)], np.int64)
        self.alone = np.zeros(256, bool)  # ASCII characters that no longer piece holds
        self.alone[[b for b in range(128) if chr(b) not in joined and b != 32]] = True
        self.space = self.lib.piece_to_id(_SPACE)
        self.opening = len(self.lib.encode("\n"))  # ids of the space and line feed that open what begins without a space
        self._reset()

    def _reset(self):
        self.keys = np.zeros(bpe.SLOTS, U64)
        self.firsts = np.zeros(bpe.SLOTS, np.int64)
        self.sizes = np.zeros(bpe.SLOTS, np.int64)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.filled = 0

    def _encoded(self, cuts: list[bytes]) -> list[list[int]]:
        ids = self.lib.encode([c[1:].decode() if c[:1] == b" " else "\n" + c.decode() for c in cuts], num_threads=1)
        return [[self.space] if c == b" " else x if c[:1] == b" " else x[self.opening :] for c, x in zip(cuts, ids)]

    def _look_up(self, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``flat`` and number of ids of each cut."""
        h = bpe._hashes(part, start, end)
        slot = (h >> U64(64 - bpe.SLOT_BITS)).astype(np.int64)
        first, size = self.firsts[slot], self.sizes[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            fresh, at, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            ids = self._encoded([part[a:b].tobytes() for a, b in zip(start[miss[at]], end[miss[at]])])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            firsts = self.filled + np.cumsum(sizes) - sizes
            total = self.filled + int(sizes.sum())
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(total, np.uint16)])
            self.flat[self.filled : total] = np.fromiter((x for y in ids for x in y), np.uint16)
            self.filled = total
            first[miss], size[miss] = firsts[inverse], sizes[inverse]
            slot = (fresh >> U64(64 - bpe.SLOT_BITS)).astype(np.int64)
            self.keys[slot], self.firsts[slot], self.sizes[slot] = fresh, firsts, sizes
        return first, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ``n + 1`` offsets of rows that each begin with the space that the model adds."""
        base = int(offsets[0])
        part, off = data[base : int(offsets[-1])], offsets - base
        if self.filled > bpe.FLAT_LIMIT:
            self._reset()
        if not len(part):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        space, alone = part == 32, self.alone[part]
        begins = space | alone
        begins[1:] &= alone[1:] | ~space[:-1]  # the first of several spaces
        begins[1:] |= alone[:-1]
        begins[off[:-1][off[:-1] < len(part)]] = True
        start = np.flatnonzero(begins)
        places, sizes = self._look_up(part, start, np.append(start[1:], len(part)))
        upto = np.append(0, np.cumsum(sizes))
        return self.flat[np.repeat(places, sizes) + bpe._ramp(sizes)], upto[np.searchsorted(start, off)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
