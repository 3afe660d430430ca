"""Language-model scores by context-tree weighting.

Every byte is predicted bit by bit from the bytes before it.  For each context of
0 to ``depth`` bytes and each node of the bit tree the training texts give a
Krichevsky-Trofimov estimate; the weighted probability of a node is the mean of
its own estimate and of the product over its longer contexts.  All counts come
from the whole corpus: longest grams are counted once, shorter contexts are sums
of longer ones, bottom-up, and the mixture flows back top-down, all by joins and
aggregations.  A text's score is the sum over its grams.

Texts are dealt into blocks of bounded size.  Each block states its distinct
grams and words, the model answers them by an equi-join, and the block is scored
from the answers; so no table has to fit in memory and none is broadcast.

Defined cases: a null or empty text is its end alone; bytes before a text and its
end are one symbol that occurs in no text; contexts never seen in training count
as empty nodes; without training texts every bit costs one bit; repeated rows
count each; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.common import discard, fold, hash64, raw, slices, stored, text_array, words_of

DEPTH = 4
BLOCK_BYTES = 24 << 20
END = 0xFF
GRAM, WORD = 0, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _blocks(most: int):
    def run(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            texts = text_array(batch.column("text"))
            for lo, hi in slices(texts, 2 << 20):
                part = texts.slice(lo, hi - lo)
                n = len(raw(part)[0]) + 64 * (hi - lo)
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (hi - lo), pa.int64()), batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), part],
                    names=["block", "doc_id", "held_out", "text"],
                )

    return run


def grams_of(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all predictions (the predicted byte lowest, then the bytes before it), and where each text's begin.

    Every text is followed by its end; the bytes before it count as ends.
    """
    body, offsets = raw(texts)
    n = len(texts)
    begin = offsets + (depth + 1) * np.arange(n + 1) + depth  # first byte of every text in the line
    line = np.full(begin[-1] + 1, END, np.uint8)
    line[np.arange(len(body)) + np.repeat(begin[:-1] - offsets[:-1], np.diff(offsets))] = _LOWER[body]
    keys = line[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        keys |= line[depth - k : len(line) - k].astype(np.int64) << (8 * k)
    wanted = np.ones(len(keys), bool)  # all places but the paddings before each text
    for k in range(1, depth + 1):
        wanted[begin[1:] - depth - k] = False
    wanted[begin[-1] - depth :] = False
    return keys[wanted], offsets + np.arange(n + 1)


def _tally(known: tuple[np.ndarray, np.ndarray], keys: pa.Array, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Add the distinct ``keys`` with their counts times ``weight``."""
    got = pc.value_counts(keys)
    k = np.concatenate([known[0], got.field(0).to_numpy(zero_copy_only=False)])
    n = np.concatenate([known[1], got.field(1).to_numpy(zero_copy_only=False) * weight])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def _asked(depth: int):
    """Distinct grams and words of every block with their counts in its training texts."""

    def run(batches):
        block, none = None, (np.empty(0, np.int64), np.empty(0, np.int64))
        tallies = {GRAM: none, WORD: none}

        def out():
            for kind, (keys, n) in tallies.items():
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), block)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])],
                        names=["block", "kind", "key", "n"],
                    )

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block is not None and numbers[a] != block:
                    yield from out()
                    tallies = {GRAM: none, WORD: none}
                block = int(numbers[a])
                part = batch.slice(a, b - a)
                held = part.column("held_out")
                for mask, weight in ((pc.invert(held), 1), (held, 0)):
                    texts = text_array(part.column("text").filter(mask))
                    for lo, hi in slices(texts, 4 << 20):
                        some = texts.slice(lo, hi - lo)
                        tallies[GRAM] = _tally(tallies[GRAM], pa.array(grams_of(some, depth)[0]), weight)
                        coded = words_of(some)[0].dictionary_encode()
                        times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)) * weight
                        keys = hash64(coded.dictionary).astype(np.int64)
                        known = tallies[WORD]
                        k, n = np.concatenate([known[0], keys]), np.concatenate([known[1], times])
                        k, back = np.unique(k, return_inverse=True)
                        tallies[WORD] = k, np.bincount(back, n, len(k)).astype(np.int64)
        if block is not None:
            yield from out()

    return run


def _lgamma(x: Column) -> Column:
    """log of the gamma function for x >= 0.5: Stirling's series after a shift by 8."""
    z = x + 8
    tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shift


def log_kt(a: Column, b: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return F.when(a + b == 0, 0.0).otherwise(_lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1.0))


def _bits(grams: DataFrame) -> DataFrame:
    """One row per gram and bit: context, node of the bit tree, bit."""
    rows = grams.select("*", F.explode(F.expr("sequence(0, 7)")).alias("i"), F.col("key").bitwiseAND(F.lit(255)).alias("y"))
    one = F.lit(1).cast("long")
    node = F.expr("shiftleft(1L, i) | shiftright(y, 8 - i)")
    return rows.select(
        *grams.columns, F.shiftright("key", 8).alias("ctx"), node.alias("node"), F.expr("shiftright(y, 7 - i)").bitwiseAND(one).alias("bit")
    )


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 of the weighted probability of the last byte of every gram, given counts (key, n)."""
    zeros = F.sum(F.col("n") * (1 - F.col("bit"))).cast("double")
    level = _bits(grams).groupBy("ctx", "node").agg(zeros.alias("a"), F.sum(F.col("n") * F.col("bit")).cast("double").alias("b"))
    levels = [stored(level.withColumn("own", log_kt(F.col("a"), F.col("b"))).withColumn("w", F.lit(1.0)).withColumn("all", F.col("own")))]
    for d in range(depth - 1, -1, -1):
        shorter = levels[-1].select(F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("ctx"), "node", "a", "b", "all")
        level = shorter.groupBy("ctx", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("all").alias("longer"))
        level = level.withColumn("own", log_kt(F.col("a"), F.col("b")))
        more = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("longer")))) - math.log(2)
        levels.append(stored(level.withColumn("w", 1 / (1 + F.exp(F.col("longer") - F.col("own")))).withColumn("all", more)))
    mix = None
    kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    for d, level in enumerate(reversed(levels)):
        if mix is None:
            at = level.withColumn("done", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            outer = mix.select(F.col("ctx").alias("short"), "node", "done", "left")
            at = level.withColumn("short", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))).join(outer, ["short", "node"])
        mix = at.select("ctx", "node", (F.col("done") + F.col("left") * F.col("w") * kt).alias("done"), (F.col("left") * (1 - F.col("w"))).alias("left"))
    paths = _bits(grams.select("key")).join(mix, ["ctx", "node"])
    cost = F.log10(F.when(F.col("bit") == 1, F.col("done")).otherwise(1 - F.col("done")))
    out = stored(paths.groupBy("key").agg(F.sum(cost).alias("value")))
    discard(*levels)
    return out


def _scored(depth: int, total: int, distinct: int, docs: int):
    """Scores of the texts of one block from the answers to its questions."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
    ])

    def run(texts, answers):
        kind = answers.column("kind").to_numpy()
        keys, values = answers.column("key").to_numpy(), answers.column("value").to_numpy()
        gram_keys, gram_values = pa.array(keys[kind == GRAM]), values[kind == GRAM]
        word_keys, word_values = pa.array(keys[kind == WORD]), values[kind == WORD]
        out = []
        column = text_array(texts.column("text"))
        for lo, hi in slices(column, 4 << 20):
            part = column.slice(lo, hi - lo)
            grams, at = grams_of(part, depth)
            score = np.add.reduceat(gram_values[pc.index_in(pa.array(grams), value_set=gram_keys).to_numpy()], at[:-1])
            words, first = words_of(part)
            coded = words.dictionary_encode()
            place = pc.index_in(pa.array(hash64(coded.dictionary).astype(np.int64)), value_set=word_keys).to_numpy(zero_copy_only=False)
            times = word_values[place] if len(place) else np.empty(0)
            times = times[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else times
            cost = np.log10((np.append(times, docs) + 1) / (total + distinct + 1))
            sums, known = np.concatenate([[0.0], np.cumsum(cost[:-1])]), np.concatenate([[0], np.cumsum(times > 0)])
            size = np.diff(at)
            out.append(pa.table([
                pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in (
                    texts.column("doc_id").slice(lo, hi - lo), texts.column("held_out").slice(lo, hi - lo), pa.array(np.diff(first) + 1),
                    pa.array(np.diff(known[first]) + (docs > 0)), pa.array(np.full(hi - lo, total)),
                    pa.array(np.diff(sums[first]) + cost[-1]), pa.array(score), pa.array(-score * math.log2(10) / size),
                )
            ], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def model_scores(docs: DataFrame, depth: int = DEPTH, folds: int = 7, held: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Base and context-tree scores of every document, learned from those outside the held fold.

    log10 probabilities; a document is held out if crc32(doc_id) mod ``folds`` is ``held``.
    """
    rows = docs.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "text")
    dealt = stored(rows.mapInArrow(_blocks(block_bytes), "block long, doc_id long, held_out boolean, text string"))
    asked = stored(dealt.mapInArrow(_asked(depth), "block long, kind int, key long, n long"))
    counts = stored(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind") == WORD)
    said = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    trained = dealt.where("not held_out").count()
    grams = counts.where(F.col("kind") == GRAM).select("key", "n")
    answers = gram_scores(grams, depth).select(F.lit(GRAM).alias("kind"), "key", "value").unionByName(
        words.select("kind", "key", F.col("n").cast("double").alias("value"))
    )
    known = asked.select("block", "kind", "key").join(answers, ["kind", "key"])
    score = _scored(depth, said[0] + trained, said[1] + (trained > 0), trained)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
