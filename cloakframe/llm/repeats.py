"""Repeated passages: every window of ``least`` words, grouped by its hash.

1. Texts that are equal word for word are joined to one; longer ones of such
   copies repeat as a whole.
2. A position is retained if its word gram has the smallest hash of some window
   of grams; windows are sized so that every passage of ``least`` words holds a
   retained position, the same one wherever the passage stands.
3. Windows whose smallest gram occurs in one document are left out (by a bitmap
   of fixed size).  The others are hashed and grouped, with the first and last
   document of each; partial aggregation leaves one row per hash and task, so a
   passage of very many documents is no burden for a single task.
4. The hashes of more than one document are looked up by the windows again (a
   second bitmap, then an equi-join).  The windows of a document that touch are
   merged, so passages of any length are whole.

No number of equal or similar neighbours limits the search.  Words and grams are
compared by 64-bit codes and windows by 96-bit ones.

Defined cases: null, empty and short texts repeat nothing; rows without doc_id
are not searched; rows with the same doc_id and text count as one document, so a
repeated row alone is no repeat; texts that share a doc_id are each searched
against the other documents, and ``text_id`` tells them apart; repeats inside one
document are not reported; of equally good partners the one with the smallest or
greatest doc_id is named; texts of any length are searched whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cloakframe.llm.common import hash64, slices, stored, text_array, words_of

GRAM = 10
LEAST = 50
BITS = 1 << 24
MARKS = 1 << 20


def _digest(code: np.ndarray) -> bytes:
    return hashlib.blake2b(code.tobytes(), digest_size=16).digest()


def _text_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _digests(batches):
    for batch in batches:
        texts, n, key = text_array(batch.column("text")), [], []
        for lo, hi in slices(texts, 4 << 20):
            code, first = _codes(texts.slice(lo, hi - lo))
            n += np.diff(first).tolist()
            key += [_digest(code[first[k] : first[k + 1]]) for k in range(hi - lo)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_text_id(k) for k in key], pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary())],
            names=["doc_id", "text_id", "n", "key"],
        )


def _marked(bits: np.ndarray):
    """Pass documents on, those whose id may be in the bitmap with the number of their text."""

    def run(batches):
        for batch in batches:
            texts, mark = text_array(batch.column("text")), bits[batch.column("doc_id").to_numpy() % len(bits)]
            text: list[int | None] = [None] * len(mark)
            for k in np.flatnonzero(mark).tolist():
                text[k] = _text_id(_digest(_codes(texts.slice(k, 1))[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(text, pa.int64())], names=["doc_id", "text", "text_id"])

    return run


def _gram_hashes(code: np.ndarray, gram: int) -> np.ndarray:
    grams = np.zeros(max(0, len(code) - gram + 1), np.uint64)
    for k in range(gram):
        grams = (grams ^ code[k : k + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(31)
    return grams


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window by doubling: low[i] = smallest of h[i : i + width]."""
    low, size = h, 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return low


def window_hashes(code: np.ndarray, least: int, salt: int) -> np.ndarray:
    """64-bit hash of every ``least`` words in a row, from hashes of twice as many words each time."""
    odd = [np.uint64(x) for x in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))[salt]]

    def joined(a, b):
        h = ((a * odd[0]) ^ (a >> np.uint64(29))) + b * odd[1]
        h = (h ^ (h >> np.uint64(32))) * odd[0]
        return h ^ (h >> np.uint64(31))

    n = len(code) - least + 1
    power, size, out, done = code, 1, None, 0
    while done < least:
        if least & size:
            part = power[done : done + n]
            out, done = part if out is None else joined(out, part), done + size
        if done < least:
            power, size = joined(power[:-size], power[size:]), 2 * size
    return out


def retained(code: np.ndarray, first: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the minimisers of every text; ``code`` holds the words of all texts in order."""
    grams = _gram_hashes(code, gram)
    at = []
    width = least - gram + 1
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < least:
            continue
        h = grams[a : b - gram + 1]
        low = _smallest(h, width)
        # A gram is a minimiser if some window around it has it as its smallest.
        best, size = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), 1
        while size < width:
            step = min(size, width - size)
            best = np.maximum(best[:-step], best[step:])
            size += step
        mark = best[: len(h)] == h
        at.append(a + np.flatnonzero(mark))
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    return at, grams[at]


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, first = words_of(texts)
    coded = words.dictionary_encode()
    return (hash64(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)), first


def _grams(gram: int, least: int):
    def run(batches):
        for batch in batches:
            texts = text_array(batch.column("text"))
            for lo, hi in slices(texts, 4 << 20):
                code, first = _codes(texts.slice(lo, hi - lo))
                at, h = retained(code, first, gram, least)
                doc = np.searchsorted(first, at, side="right")
                # A gram counts once per document.
                order = np.lexsort((h, doc))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[order][new].astype(np.int64))], names=["gram"])

    return run


def _bitmap(key, grams):
    bits = np.zeros(BITS // 256, bool)
    bits[(grams.column("gram").to_numpy().astype(np.uint64) >> np.uint64(8)) % np.uint64(BITS // 256)] = True
    return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("bits", pa.binary())]))


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[(h & np.uint64(255)).astype(np.int64), ((h >> np.uint64(8)) % np.uint64(BITS // 256)).astype(np.int64)]


def _windows(gram: int, least: int, bits: np.ndarray, keys: np.ndarray | None = None):
    """Windows whose smallest gram may be in ``bits`` and whose hash may be in ``keys``: hash (two parts), document, text, first word."""

    def run(batches):
        for batch in batches:
            texts, docs = text_array(batch.column("text")), batch.column("doc_id")
            for lo, hi in slices(texts, 4 << 20):
                code, first = _codes(texts.slice(lo, hi - lo))
                if len(code) < least:
                    continue
                some = _held(bits, _smallest(_gram_hashes(code, gram), least - gram + 1))
                # A window lies in one text.
                n = np.diff(first)
                left = np.repeat(first[1:], n) - np.arange(len(code))
                at = np.flatnonzero(some & (left[: len(some)] >= least))
                h = window_hashes(code, least, 0)[at]
                if keys is not None:
                    kept = _held(keys, h)
                    at, h = at[kept], h[kept]
                check = (window_hashes(code, least, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc = np.repeat(np.arange(hi - lo), n)[at]
                text = np.zeros(hi - lo, np.int64)
                for k in np.unique(doc).tolist() if keys is not None else []:
                    text[k] = _text_id(_digest(code[first[k] : first[k + 1]]))
                for p in range(0, len(at), 100_000):
                    q = slice(p, p + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[q].view(np.int64)), pa.array(check[q]), docs.slice(lo, hi - lo).take(pa.array(doc[q])), pa.array(text[doc[q]]), pa.array(at[q] - first[doc[q]])],
                        names=["key", "check", "doc_id", "text_id", "begin"],
                    )

    return run


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the 64-bit values of the column ``gram``."""
    parts = keys.groupBy(F.pmod("gram", F.lit(256)).cast("int")).applyInArrow(_bitmap, "part int, bits binary").collect()
    bits = np.zeros((256, BITS // 256), bool)
    for r in parts:
        bits[r.part] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return bits


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_id, start_word, end_word, n_words, other_doc_id): maximal stretches that repeat in other documents.

    Every passage of ``least`` or more words that stands in two documents is
    covered, in each of them; ``other_doc_id`` is one document that shares it.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    keys = stored(named.mapInArrow(_digests, "doc_id long, text_id long, n long, key binary").where(F.col("n") >= least).distinct())
    groups = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = keys.join(groups.where("first <> last"), "key")
    whole = copies.select("doc_id", "text_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"),
                          F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other_doc_id"))
    # One document of each group of copies is searched.  A bitmap of fixed size tells which texts cannot be spare
    # copies; only the others are shuffled, once, to be looked up by id and text, and few of them stay.
    spare = stored(copies.where("doc_id <> first").select("doc_id", "text_id").distinct())
    maybe = np.zeros(MARKS, bool)
    maybe[spare.select(F.pmod("doc_id", F.lit(MARKS)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    marked = stored(named.mapInArrow(_marked(maybe), "doc_id long, text string, text_id long"))
    unsure = stored(marked.where("text_id is not null").join(spare, ["doc_id", "text_id"], "left_anti"))
    single = marked.where("text_id is null").unionByName(unsure).drop("text_id")

    shared = single.mapInArrow(_grams(gram, least), "gram long").groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    bits = _bits(shared.select("gram"))
    row = "key long, check int, doc_id long, text_id long, begin long"
    groups = single.mapInArrow(_windows(gram, least, bits), row).groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    common = stored(groups.where("first <> last"))
    again = single.mapInArrow(_windows(gram, least, bits, _bits(common.select(F.col("key").alias("gram")))), row)
    found = again.join(common, ["key", "check"]).select("doc_id", "text_id", "begin", (F.col("begin") + least).alias("end"),
                                                        F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other_doc_id"))

    rows = found.unionByName(whole)
    line = Window.partitionBy("doc_id", "text_id").orderBy("begin", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("begin"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    merged = rows.withColumn("island", island).groupBy("doc_id", "text_id", "island").agg(
        F.min("begin").alias("start_word"), F.max("end").alias("end_word"), F.min("other_doc_id").alias("other_doc_id")
    )
    return merged.select("doc_id", "text_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
