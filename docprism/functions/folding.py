"""Unicode folding of whole Arrow batches: code points as one array, tables by code point, run lengths for the places.

Each different code point of a batch is folded once (NFKC, case folding, format
controls dropped); its expansion goes into a table, and the batch is put together with
repeats and sums over lengths.  Only rows that hold a character which may compose with
another one are also folded whole: where that gives another text there is no place for
each character, and the map is null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprism.functions.text import LOOK_ALIKES

def folded_char(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", c).casefold() if unicodedata.category(x) != "Cf")


def _without_controls(text: str) -> str:
    """The text without format controls; each different character is looked up once."""
    gone = [c for c in set(text) if unicodedata.category(c) == "Cf"]
    return text.translate(dict.fromkeys(map(ord, gone))) if gone else text


def _may_compose(c: str) -> bool:
    """Whether the character may melt into one before it, or change its order: marks, and the vowels and finals of Hangul."""
    return any(unicodedata.combining(x) or unicodedata.category(x)[0] == "M" or 0x1161 <= ord(x) <= 0x11FF for x in unicodedata.normalize("NFKD", c))


class _Points:
    """What is known of the code points met so far, as arrays by number."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int32)
        self.flat: list[int] = []
        self.first: list[int] = []
        self.size: list[int] = []
        self.marks: list[bool] = []

    def of(self, points: np.ndarray) -> np.ndarray:
        for p in np.unique(points[self.number[points] < 0]).tolist():
            self.number[p] = len(self.first)
            self.first.append(len(self.flat))
            text = folded_char(chr(p)) if not 0xD800 <= p < 0xE000 else chr(p)
            self.flat += map(ord, text)
            self.size.append(len(text))
            self.marks.append(p > 127 and not 0xD800 <= p < 0xE000 and _may_compose(chr(p)))
        return self.number[points]


_POINTS = _Points()
_LATIN = np.zeros(0x110000, bool)
_WORD = np.zeros(0x110000, bool)
_KNOWN = np.zeros(0x110000, bool)
_ALIKE = np.arange(0x110000, dtype=np.uint32)
for _from, _to in LOOK_ALIKES.items():
    _ALIKE[ord(_from)] = ord(_to)


def _look_alikes(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Look-alikes as Latin letters in the words (runs of letters and digits within a row) that hold a Latin one."""
    for p in np.unique(points[~_KNOWN[points]]).tolist():
        _KNOWN[p], _WORD[p], _LATIN[p] = True, chr(p).isalnum(), unicodedata.name(chr(p), "").startswith("LATIN")
    inside = _WORD[points]
    if not len(points) or not (_ALIKE[points] != points).any():
        return points
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(begins) - 1
    latin = np.zeros(int(begins.sum()) + 1, bool)
    latin[word[inside & _LATIN[points]]] = True
    return np.where(inside & latin[word], _ALIKE[points], points)


#: Characters that are folded at a time: the arrays beside them take some 80 bytes a character.
SLICE = 1 << 18


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in runs of about ``SLICE`` characters; a longer text is one of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def fold_batch(texts: list[str | None]) -> tuple[list[str | None], list[np.ndarray | None]]:
    """Folded texts and, for each of their characters, the place in the original; null where characters composed."""
    folded: list[str | None] = []
    places: list[np.ndarray | None] = []
    for part in _slices(texts):
        made = _fold_slice(part)
        folded += made[0]
        places += made[1]
    return folded, places


def _fold_slice(texts: list[str | None]) -> tuple[list[str | None], list[np.ndarray | None]]:
    held = [t or "" for t in texts]
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in held], np.int64)
    upto = np.append(0, np.cumsum(sizes))
    number = _POINTS.of(points)
    first, size, marks = np.array(_POINTS.first, np.int64), np.array(_POINTS.size, np.int64), np.array(_POINTS.marks, bool)
    wide = size[number] if len(number) else np.zeros(0, np.int64)
    total = np.append(0, np.cumsum(wide))
    ramp = np.arange(int(total[-1])) - np.repeat(total[:-1], wide)
    out = np.array(_POINTS.flat, np.uint32)[np.repeat(first[number], wide) + ramp] if len(number) else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(held)), sizes)
    place = np.repeat((np.arange(len(points)) - upto[row]).astype(np.int32), wide)
    out_row = np.repeat(row, wide)
    plain = _look_alikes(out, out_row)
    at = total[upto]
    decode = lambda a: a.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    whole = decode(plain)
    folded: list[str | None] = [None if t is None else whole[a:b] for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())]
    places: list[np.ndarray | None] = [None if t is None else place[a:b] for t, a, b in zip(texts, at[:-1], at[1:])]
    for r in np.unique(row[marks[number]]).tolist() if len(number) else ():
        text = _without_controls(unicodedata.normalize("NFKC", held[r]).casefold())
        if text != decode(out[at[r] : at[r + 1]]):
            again = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            folded[r], places[r] = decode(_look_alikes(again, np.zeros(len(again), np.int64))), None
    return folded, places


FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(FOLDED)
def _folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        texts, places = fold_batch(batch.to_pylist())
        count = np.array([0 if p is None else len(p) for p in places], np.int64)
        flat = np.concatenate([p for p in places if p is not None] or [np.zeros(0, np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(flat), mask=pa.array([p is None for p in places]))
        yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], names=["text", "places"])


def folded(text: Column) -> Column:
    """Struct of the folded ``text`` and the ``places`` of its characters in the original, from one pass."""
    return _folded(text)
