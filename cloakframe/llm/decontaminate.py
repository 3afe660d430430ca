"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts and benchmark items are read as words (lower case, outer punctuation
dropped).  A window of an item's size at a word of a document is embedded by a
random walk: at each step the current word is written out and the walk moves on
or stays by a random bit of step and word.  Few edits then change few places, so
hashes of three or more sampled places, repeated over many walks and samples,
meet with the target recall; the numbers of places and repetitions are chosen by
simulation at the largest number of edits allowed, with the same keys as the search.  Items of about the same length share their
samples: a walk of as many steps as the shortest of them has words ends inside
each window, so one embedding of a place serves all.  Every hit is confirmed by
the exact edit distance of the item to the best stretch of words around it.

Windows that cannot match are skipped beforehand by necessary conditions: with
at most e edits, at most e words of the window are foreign to all items, and of
any e + q words of the item at least q stand in the stretch; the item's rarest
words at hand are taken for these.  The same count ends hits before the edit
distance is computed.

Defined cases: null and empty texts and items match nothing; items of any length
are searched, those under 1 / rate words for exact copies (``min_words`` leaves
shorter ones out where that is asked for); equal items are reported each; of
equally near stretches the first is reported; rows with a null id are reported
with it; repeated rows are reported each; texts of any length are searched whole;
an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.common import slices, text_array, words_of

REPEATS = (64, 128, 256, 512)  # repetitions, more only where fewer miss the target recall; four share a walk
LEAST_PLACES = 3  # sampled by each repetition (fewer only if the window has fewer words)
RECALL = 0.99
ITEMS = 2_000  # items searched in one scan
STARTS = 100_000  # windows embedded at once
MARKS = ".,;:!?\"'()[]{}<>|#*$%&-_/\\=+`~«»“”‘’…"
SCHEMA = "doc_id long, item_id long, edits int, item_words int, word_start long"


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes (never 0) of all texts in order, and where each text's begin."""
    words, first = words_of(texts)
    d = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(d.dictionary), characters=MARKS)
    live = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    code = np.where(live, pd.util.hash_array(plain.to_numpy(zero_copy_only=False), categorize=False) | np.uint64(1), np.uint64(0)) if len(plain) else np.empty(0, np.uint64)
    code = code[d.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    live = code != 0
    return code[live], np.concatenate([[0], np.cumsum(live)])[first]


def embed(code: np.ndarray, starts: np.ndarray, walk: int, places: np.ndarray) -> np.ndarray:
    """Symbols at ``places`` (ascending) of the embedded windows that begin at ``starts``, none shorter than the walk."""
    turn = np.random.default_rng([walk, 77]).integers(0, 2**63, int(places[-1]) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at, out = starts.astype(np.int64), np.empty((len(places), len(starts)), np.uint64)
    row = {int(p): k for k, p in enumerate(places)}
    for j in range(len(turn)):
        symbol = code[at]
        if j in row:
            out[row[j]] = symbol
        at = at + (((symbol + np.uint64(j + 1)) * turn[j]) >> np.uint64(63)).astype(np.int64)
    return out


def samples(steps: int, k: int, repeats: int) -> list[tuple[int, np.ndarray]]:
    """For every repetition: its walk, and the places it samples."""
    r = np.random.default_rng([steps, k])
    return [(i // 4, np.sort(r.choice(steps, k, replace=False))) for i in range(repeats)]


def keys(code: np.ndarray, starts: np.ndarray, steps: int, k: int, repeats: int) -> np.ndarray:
    """LSH keys (repetition, window)."""
    plan = samples(steps, k, repeats)
    out = np.empty((repeats, len(starts)), np.uint64)
    for walk in range(repeats // 4):
        mine = range(4 * walk, 4 * walk + 4)
        places = np.unique(np.concatenate([plan[i][1] for i in mine]))
        symbols = embed(code, starts, walk, places)
        for i in mine:
            h = np.full(len(starts), i + 1, np.uint64)
            for row in np.searchsorted(places, plan[i][1]):
                h = (h ^ symbols[row]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[i] = h
    return out


def places_for(n: int, steps: int, edits: int, recall: float, trials: int = 300) -> tuple[int, int]:
    """(places, repetitions): the fewest repetitions, then the most places up to 8, that reach ``recall``.

    Measured on items of ``n`` random words with ``edits`` random edits, one of
    them at the first word in every second item.
    """
    least = min(LEAST_PLACES, steps)
    r = np.random.default_rng([n, edits, 5])
    line: list[int] = []
    for t in range(trials):
        a = r.integers(1, 2**62, n).tolist()
        b = list(a)
        for e, (kind, at, new) in enumerate(zip(r.integers(0, 3, edits), r.random(edits), r.integers(1, 2**62, edits).tolist(), strict=True)):
            at = int(at * len(b)) if e or t % 2 else 0
            b[at : at + (kind != 1)] = [new] if kind < 2 else []
        line += a + (b + r.integers(1, 2**62, n).tolist())[:n]
    line, starts = np.array(line, np.uint64), n * np.arange(2 * trials)
    for repeats in REPEATS:
        for k in range(min(8, steps), least - 1, -1):
            made = keys(line, starts, steps, k, repeats)
            if (made[:, ::2] == made[:, 1::2]).any(axis=0).mean() >= recall:
                return k, repeats
    return least, REPEATS[-1]


def substring_edits(item: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Smallest edit distance of the item to any run of words of each row of ``stretch``."""
    width = stretch.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    last = np.zeros((len(stretch), width + 1), np.int32)
    for k, w in enumerate(item, 1):
        now = last + 1
        np.minimum(now[:, 1:], last[:, :-1] + (stretch != w), out=now[:, 1:])
        now[:, 0] = k
        last = np.minimum.accumulate(now - ramp, axis=1) + ramp
    return last.min(axis=1)


@dataclass
class Items:
    """One block of benchmark items, ready for search."""

    ids: list[int | None]
    code: np.ndarray
    begin: np.ndarray
    rate: float
    vocabulary: np.ndarray
    groups: list[tuple[int, int, list[int]]]  # words that must be checked at least, foreign words at most, item lengths
    places: list[np.ndarray] = field(default_factory=list)  # of each item, its words' numbers in the vocabulary
    tables: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # of each group: places, repetitions, sorted keys, their items
    longest: int = 0


def prepare(ids: list[int | None], texts: list[str | None], rate: float, min_words: int, recall: float) -> Items | None:
    code, first = coded(text_array(pa.array(texts, pa.string())))
    sizes = np.diff(first)
    use = [k for k in range(len(ids)) if sizes[k] >= min_words]
    if not use:
        return None
    lengths = sorted({int(sizes[k]) for k in use})
    groups: list[tuple[int, int, list[int]]] = []
    for n in lengths:
        if groups and n <= 1.2 * groups[-1][0]:
            low, _, ns = groups.pop()
            groups.append((low, math.floor(rate * n), [*ns, n]))
        else:
            groups.append((n, math.floor(rate * n), [n]))
    out = Items(ids, code, first, rate, np.unique(np.concatenate([code[first[k] : first[k + 1]] for k in use])), groups, longest=lengths[-1])
    out.places = [np.searchsorted(out.vocabulary, code[first[k] : first[k + 1]]) if k in set(use) else np.empty(0, np.int64) for k in range(len(ids))]
    for low, _, ns in groups:
        # Within a group the shortest and the longest item may meet with the most edits for their size.
        plans = [places_for(n, low, math.floor(rate * n), recall) for n in {low, ns[-1]}]
        k, repeats = min(p[0] for p in plans), max(p[1] for p in plans)
        own = np.array([i for i in use if low <= sizes[i] <= ns[-1]])
        made = keys(code, first[own], low, k, repeats)
        order = np.argsort(made.reshape(-1), kind="stable")
        out.tables.append((k, repeats, made.reshape(-1)[order], np.tile(own, repeats)[order]))
    return out


def search(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, first word of the stretch) of every item found in every text, the best place each."""
    code, first = coded(texts)
    n_texts, pad = len(first) - 1, items.longest
    begin = first + pad * np.arange(n_texts + 1)  # the texts with zeros between them
    line = np.zeros(begin[-1] + pad, np.uint64)
    line[np.arange(len(code)) + pad * np.repeat(np.arange(n_texts), np.diff(first))] = code
    place = np.minimum(np.searchsorted(items.vocabulary, line), len(items.vocabulary) - 1)
    member = items.vocabulary[place] == line
    before = np.concatenate([[0], np.cumsum(member)])
    seen = np.bincount(place[member], minlength=len(items.vocabulary))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (low, foreign, lengths), (k, repeats, known, owner) in zip(items.groups, items.tables, strict=True):
        count = before[low:] - before[: len(before) - low]
        # Words by which a window shows itself: of each item, the rarest here, q more than it may lose.
        telling, least = np.zeros(len(items.vocabulary), bool), len(line)
        for own in items.places:
            if len(own) in lengths:
                e = math.floor(items.rate * len(own))
                q = -(-(len(own) - e) // 2)
                telling[own[np.argsort(seen[own], kind="stable")[: e + q]]] = True
                least = min(least, q)
        told = np.concatenate([[0], np.cumsum(telling[place] & member)])
        reach = np.minimum(np.arange(len(count)) + lengths[-1] + foreign, len(line))
        starts = np.flatnonzero((line[: len(count)] != 0) & (count >= low - foreign) & (told[reach] - told[: len(count)] >= least))
        pairs = [np.empty(0, np.int64)]
        for part in range(0, len(starts), STARTS):
            some = starts[part : part + STARTS]
            made = keys(line, some, low, k, repeats).reshape(-1)
            lo = np.searchsorted(known, made, "left")
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == made)
            many = np.searchsorted(known, made[hit], "right") - lo[hit]
            which = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.unique(owner[which] * len(line) + some[np.repeat(hit % len(some), many)]))
        pairs = np.unique(np.concatenate(pairs))
        edges = np.searchsorted(pairs, np.unique(pairs // len(line)) * len(line)) if len(pairs) else []
        for at in np.split(pairs, edges[1:]) if len(pairs) else []:
            item = int(at[0] // len(line))
            at, word = at % len(line), items.code[items.begin[item] : items.begin[item + 1]]
            n, own = len(word), np.unique(word)
            slack = math.floor(items.rate * n)
            for part in range(0, len(at), 20_000):
                some = at[part : part + 20_000]
                text = np.searchsorted(begin, some, side="right") - 1
                span = some[:, None] - slack + np.arange(n + 3 * slack)
                inside = (span >= begin[text][:, None]) & (span < len(line))
                stretch = np.where(inside, line[np.clip(span, 0, len(line) - 1)], np.uint64(0))
                at_own = np.minimum(np.searchsorted(own, stretch), len(own) - 1)
                can = np.count_nonzero(own[at_own] == stretch, axis=1) >= n - slack
                some, text, stretch = some[can], text[can], stretch[can]
                if not len(some):
                    continue
                edits = substring_edits(word, stretch)
                for t, s, e in zip(text[edits <= slack].tolist(), some[edits <= slack].tolist(), edits[edits <= slack].tolist(), strict=True):
                    if (t, item) not in best or (e, s) < best[t, item]:
                        best[t, item] = e, s
    return [(t, int(i), e, int(s - begin[t])) for (t, i), (e, s) in sorted(best.items())]


def _found(items: Items):
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            texts, docs, rows = text_array(batch.column("text")), batch.column("doc_id"), []
            for lo, hi in slices(texts, 24 << 20):
                for t, i, e, s in search(items, texts.slice(lo, hi - lo)):
                    rows.append((docs[lo + t].as_py(), items.ids[i], e, int(items.begin[i + 1] - items.begin[i]), s))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "word_start"]
            )

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, min_words: int = 1, recall: float = RECALL, items: int = ITEMS) -> DataFrame:
    """One row per document and item found in it with at most ``rate`` * its words edits.

    The benchmark is searched in blocks of about ``items`` rows, each one scan
    of the documents with bounded memory; nothing is shuffled.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-benchmark.count() // items))
    found = []
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select(F.col("item_id").cast("long"), "text").collect()
        part.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
        ready = prepare([r.item_id for r in part], [r.text for r in part], rate, min_words, recall)
        if ready is not None:
            found.append(docs.select("doc_id", "text").mapInArrow(_found(ready), SCHEMA))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, min_words: int = 1) -> DataFrame:
    """The documents in which no item was found, with their own columns.  Rows without doc_id are searched by text."""
    found = contaminations(docs, benchmark, rate, min_words)
    clean = docs.where("doc_id is not null").join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    unnamed = docs.where("doc_id is null").withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = contaminations(unnamed, benchmark, rate, min_words).select("doc_id").distinct()
    kept = unnamed.join(found, "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return clean.unionByName(kept.select(*docs.columns))
