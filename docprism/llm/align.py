"""Cross-tokenizer alignment (method: boundary counts over a whole batch, segmented prefix sums).

A text with a space before it is encoded by two tokenizers, A (byte-level BPE) and B
(sentence pieces).  The bytes of a whole block of documents are joined; one count of
A's and B's token ends over its byte offsets gives all borders: between two borders one
A token and one B token overlap (a link), and where both end a group is cut.  Prefix
sums over the borders number the tokens, links and groups, and their values at the
documents' offsets give each document's share.

A pair of ids counts the documents that hold it linked.  Counts are added up per task,
then by Spark.  The most frequent pairs, at most ``FREQUENT``, are sent to all tasks;
the links of all others join the table of counts by their pair, once for equal texts.

Texts are encoded again for the second pass instead of being stored.  Memory is bounded
by blocks of a megabyte of whole documents or by one single document.

Defined results: a null or empty text, and one whose joined token bytes are not its
own (it holds the sign that B uses for a space), has no tokens, only zeros and an empty
digest; special strings inside texts are plain text; repeated rows are documents of
their own in the counts; a null id is kept; other columns never take part; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprism.llm import bpe, pieces
from docprism.llm import textvec as tv
from docprism.llm.store import materialize

#: Pairs that are broadcast at most, pairs that a task adds up before it hands them on, and bytes of a block.
FREQUENT = 1 << 20
HELD = 1 << 21
BLOCK = 1 << 20
_WIDTH = 1 << 16
_SIGN = "▁".encode()


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")


_LENGTHS: dict[str, np.ndarray] = {}


def _byte_lengths(path: str) -> np.ndarray:
    if path not in _LENGTHS:
        lib = bpe.encoder(path).lib
        _LENGTHS[path] = np.array([len(lib.decode_single_token_bytes(i)) for i in range(lib.n_vocab)], np.int64)
    return _LENGTHS[path]


class Aligned:
    """One block of documents: ids ``a`` and ``b``, and by border the numbers of the link's tokens and its group."""

    def __init__(self, data: np.ndarray, off: np.ndarray, paths: tuple[str, str]):
        self.n = n = len(off) - 1
        size = np.diff(off)
        usable = size > 0
        sign = np.flatnonzero((data[:-2] == _SIGN[0]) & (data[1:-1] == _SIGN[1]) & (data[2:] == _SIGN[2])) if len(data) > 2 else np.zeros(0, np.int64)
        usable[np.searchsorted(off, sign, "right") - 1] = False
        while True:  # a second time only if a tokenizer changes the bytes of a text
            self.rows = np.flatnonzero(usable)
            self.off = np.append(0, np.cumsum(size[self.rows] + 1))
            text = np.full(int(self.off[-1]), 32, np.uint8)
            keep = np.repeat(usable, size)
            inside = np.ones(len(text), bool)
            inside[self.off[:-1]] = False
            text[inside] = data[keep]
            self.a, a_off = bpe.encoder(paths[0]).encode(text, self.off)
            b_coder = pieces.encoder(paths[1])
            self.b, b_off = b_coder.encode(text, self.off)
            a_end = np.cumsum(_byte_lengths(paths[0])[self.a])
            b_end = np.cumsum(b_coder.length[self.b])
            reached = [np.diff(np.append(0, end)[o]) == np.diff(self.off) for end, o in ((a_end, a_off), (b_end, b_off))]
            whole = reached[0] & reached[1]
            if whole.all():
                break
            usable[self.rows[~whole]] = False
        total = len(text) + 1
        mark = np.bincount(a_end, minlength=total) + 2 * np.bincount(b_end, minlength=total)
        self.border = np.flatnonzero(mark)
        kind = mark[self.border]
        self.a_ends, self.b_ends, self.cut = (kind & 1) > 0, kind > 1, kind == 3
        before = lambda x: np.cumsum(x) - x
        self.link_a, self.link_b, self.group = before(self.a_ends), before(self.b_ends), before(self.cut)
        self.upto = np.searchsorted(self.border, self.off, "right")  # borders up to each document's end

    def share(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's borders, for all rows of the block."""
        out = np.zeros(self.n, np.int64)
        out[self.rows] = np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[self.upto])
        return out

    def pairs(self) -> np.ndarray:
        """Pair of ids of each link."""
        return self.a[self.link_a].astype(np.int64) * _WIDTH + self.b[self.link_b]

    def row_of_links(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.upto))

    def group_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;a3|b2,b3`` of all documents and the offsets of the documents that have tokens."""
        last_a, last_b = self.cut[self.a_ends], self.cut[self.b_ends]
        group_a, group_b = self.group[self.a_ends], self.group[self.b_ends]
        place_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
        ids = np.empty(len(place_a) + len(place_b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        tokens = np.append(0, np.cumsum(self.a_ends.astype(np.int64) + self.b_ends))[self.upto]
        mark[tokens[1:] - 1] = 0
        signs = _DIGITS[ids]
        width = _DIGIT_COUNT[ids]
        signs[np.arange(len(ids)), width] = mark
        upto = np.append(0, np.cumsum(width + (mark > 0)))
        flat = signs.reshape(-1)
        return flat[flat > 0], upto[tokens]


_DIGIT_COUNT = np.char.str_len(np.arange(_WIDTH).astype("U5")).astype(np.int64)
_DIGITS = np.zeros((_WIDTH, 6), np.uint8)
_DIGITS[:, :5] = np.arange(_WIDTH).astype("S5").view(np.uint8).reshape(-1, 5)


def _aligned(texts: pa.Array, paths: tuple[str, str]) -> Iterator[tuple[int, int, Aligned]]:
    data, off = tv.buffers(texts)
    for i, j in tv.row_blocks(off, BLOCK):
        yield i, j, Aligned(data[off[i] : off[j]], off[i : j + 1] - off[i], paths)


def _count_pairs(paths):
    def run(batches):
        keys, counts, n = [], [], 0

        def added():
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for _, _, block in _aligned(batch.column(0), paths):
                held = np.sort(block.row_of_links() << 32 | block.pairs())
                held = held[np.append(True, held[1:] != held[:-1])[: len(held)]] & ((1 << 32) - 1)
                key, count = np.unique(held, return_counts=True)
                keys.append(key)
                counts.append(count)
                n += len(key)
                if n > HELD:
                    key, count = added()
                    keys, counts, n = [key], [count], len(key)
                    if n > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["pair", "n"])
                        keys, counts, n = [], [], 0
        if keys:
            key, count = added()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["pair", "n"])

    return tv.tidy(run)


def _pair_table(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``pair, n, best``: documents that hold the pair linked, and whether its A id has no more frequent one."""
    counted = materialize(docs.select("text").mapInArrow(_count_pairs(paths), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counted.groupBy(F.shiftright("pair", 16).alias("_a")).agg(F.max("n").alias("_most"))  # a row for each id of A's vocabulary at most
    return counted.join(F.broadcast(most), F.shiftright("pair", 16) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def pair_counts(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``a, b, documents, best`` of every pair of ids that some document holds linked."""
    table = _pair_table(docs, _paths(a, b))
    return table.select(F.shiftright("pair", 16).cast("int").alias("a"), (F.col("pair") % _WIDTH).cast("int").alias("b"), F.col("n").alias("documents"), "best")


def groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``doc_id, number, start, length, a, b``: each group's bytes in space + text and its ids."""
    paths = _paths(a, b)

    def run(batches):
        for batch in batches:
            for i, _, x in _aligned(batch.column(1), paths):
                at = np.flatnonzero(x.cut)
                end = x.border[at]
                start = np.append(0, end[:-1])[: len(end)]
                row = np.searchsorted(x.upto[1:], at, "right")
                upto = np.append(0, np.cumsum(x.cut))[x.upto]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(e)[at]), pa.int32()), pa.array(ids.astype(np.int32))) for e, ids in ((x.a_ends, x.a), (x.b_ends, x.b))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + x.rows[row])), pa.array(np.arange(len(at)) - upto[row]), pa.array(start - x.off[row]), pa.array(end - start), *lists], names=["doc_id", "number", "start", "length", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tv.tidy(run), "doc_id long, number long, start long, length long, a array<int>, b array<int>")


_MEASURED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _measure(paths, shared):
    """The digest's row of each document; links of pairs that are not among the frequent ones are listed with their numbers."""

    def run(batches):
        held, count, best = shared.value
        for batch in batches:
            columns = [[] for _ in range(6)]
            digests, rest_rows, rest_pairs, rest_times = [], [], [], []
            for i, j, x in _aligned(batch.column(1), paths):
                pair, back = np.unique(x.pairs(), return_inverse=True)
                at = np.minimum(np.searchsorted(held, pair), max(len(held) - 1, 0))
                known = held[at] == pair if len(held) else np.zeros(len(pair), bool)
                n, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
                n[known], top[known] = count[at[known]], best[at[known]]
                shares = (x.a_ends, x.b_ends, x.cut, np.ones(len(back), np.int64), top[back], n[back])
                for out, values in zip(columns, shares):
                    out.append(x.share(values))
                text, upto = x.group_texts()
                digest = [""] * (j - i)
                for r, s, e in zip(x.rows.tolist(), upto[:-1].tolist(), upto[1:].tolist()):
                    digest[r] = hashlib.sha256(text[s:e]).hexdigest()
                digests += digest
                rare = np.flatnonzero(~known[back])
                key, times = np.unique(x.row_of_links()[rare] << 32 | pair[back[rare]], return_counts=True)
                rest_rows.append(i + x.rows[key >> 32])
                rest_pairs.append(key & ((1 << 32) - 1))
                rest_times.append(times)
            rest_rows, rest_pairs, rest_times = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (rest_rows, rest_pairs, rest_times))
            pairs = pa.StructArray.from_arrays([pa.array(rest_pairs), pa.array(rest_times)], names=["pair", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest_rows, np.arange(len(batch) + 1)), pa.int32()), pairs)
            measured = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *measured, pa.array(digests, pa.string()), rest], names=[*(c.split()[0] for c in _MEASURED.split(", ")), "rest"])

    return tv.tidy(run)


def report(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row a document: numbers of tokens, groups and links, how many links are their A id's most frequent, the sum of counts, digest of the groups."""
    spark = docs.sparkSession
    paths = _paths(a, b)
    table = materialize(_pair_table(docs, paths), "pair-counts")
    level = F.floor(F.log2("n")).alias("level")
    levels = sorted(table.groupBy(level).count().collect(), reverse=True)  # some sixty rows
    held, cut = 0, None
    for lowest, n in levels:
        held += n
        if held > FREQUENT:
            break
        cut = lowest
    frequent = table.where(level >= cut if cut is not None else F.lit(False)).toArrow()  # FREQUENT rows at most
    order = np.argsort(frequent["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy()[order] for c in ("pair", "n", "best")))
    columns = [c.split()[0] for c in _MEASURED.split(", ")]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure(paths, shared), f"{_MEASURED}, rest array<struct<pair:long,times:long>>")
    if held <= FREQUENT:
        return out.select(columns)
    out = materialize(out, "measured")
    links = out.where(F.size("rest") > 0).groupBy("groups_sha256").agg(F.first("rest").alias("rest"))  # equal texts have equal links
    links = links.select("groups_sha256", F.inline("rest")).join(table, "pair")
    more = links.groupBy("groups_sha256").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    out = out.join(more, "groups_sha256", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(columns)
