"""Phrase collocations by direct-address tiling of ranked ids.

Words that occur often enough are numbered by frequency.  A pair of ids is a
cell of a plane, and the plane is dealt into tiles whose sides double with the
rank: the common corner is dense and counted with numpy bincount at the cell's
address, the thin outskirts are counted as sorted coordinate lists.  Frequent
pairs are ranked in turn and paired with the word behind them, which gives
phrases of three words, and so on: a phrase can only be frequent if both its
parts without the last and without the first word are.

Texts are cut into blocks of whole documents.  Neither the vocabulary nor the
frequent phrases are broadcast or held by a task: a block states its words, a
row per bucket of hashes (later its cells, a row per tile), gets back the ranks
of the frequent ones, and goes on with numbers only.  Counts of a tile are
summed in two rounds, so a tile that every block fills is not one task's work.

Defined cases: A-Z is lower-cased; pieces end at . , ; : ! ? and at line ends,
words at blanks and tabs.  A null text is empty, a null lang is ``und``.  A
repeated row counts as often as it stands.  Of equal scores the more frequent
phrase comes first, then the one that is least by UTF-8.  Where no phrase is
frequent, and for an empty table, there are no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cloakframe.llm.common import discard, raw, slices, small_batches, stored, text_array
from cloakframe.llm.mixing import along

SIDE = 512  # side of the first tile
DENSE = SIDE * SIDE  # cells that are counted by address
BLOCK = 8 << 20  # bytes of text in a block
BATCH = 2500  # documents that go to Python at a time
BUCKET_BITS = 8  # words are dealt to buckets by these bits of their hash
WORD_BITS, PHRASE_BITS = 28, 35
_END = np.zeros(256, bool)
_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _END.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ROWS = "block long, kind int, tile int, a binary, b binary"
_ROWS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("tile", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as bytes: differences if they rise, in the narrowest width that holds them, compressed."""
    values = np.ascontiguousarray(values, np.int64)
    if rising:
        values = np.diff(values, prepend=0)
    top = int(np.abs(values).max()) if len(values) else 0
    width = 1 if top < 1 << 7 else 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    body = values.astype(f"<i{width}").tobytes()
    return bytes([width, rising]) + len(body).to_bytes(8, "little") + bytes(pa.compress(body, "zstd", asbytes=True))


def unsqueeze(body: bytes) -> np.ndarray:
    data = pa.decompress(body[10:], int.from_bytes(body[2:10], "little"), "zstd", asbytes=True)
    values = np.frombuffer(data, f"<i{body[0]}").astype(np.int64)
    return np.cumsum(values) if body[1] else values


def _rows(rows: list[tuple], schema: pa.Schema = _ROWS) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, schema, strict=True)], schema=schema)


# Cells and tiles -----------------------------------------------------------


def _band(ids: np.ndarray) -> np.ndarray:
    """0 for the first SIDE ids, 1 for as many more, then twice as many each; wide tiles are cut by the phrase."""
    return np.where(ids < SIDE, 0, np.frexp((ids // SIDE).astype(np.float64))[1]).astype(np.int64)


def _first(band: int) -> int:
    return 0 if band == 0 else SIDE << (band - 1)


def _shape(tile: int) -> tuple[int, int, int, int, int]:
    """(first phrase, first word, words across, cuts, cells) of a tile number."""
    row, column = tile >> 16, tile >> 8 & 0xFF
    cuts = 1 << min(max(row - 4, column - 4, 0), 6)
    wide, high = max(SIDE, _first(column)), max(SIDE, _first(row))
    return _first(row), _first(column), wide, cuts, -(-high // cuts) * wide


def tiles_of(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Tile number of each cell: bands of both ids, and the cut of the phrase in a thin tile."""
    row, column = _band(phrases), _band(words)
    cuts = np.left_shift(1, np.clip(np.maximum(row, column) - 4, 0, 6))
    return row << 16 | column << 8 | phrases & (cuts - 1)


def addresses(tile: int, phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    first, start, wide, cuts, _ = _shape(tile)
    return (phrases - first) // cuts * wide + (words - start)


def cells(tile: int, address: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word) of addresses in a tile."""
    first, start, wide, cuts, _ = _shape(tile)
    # Bands start at multiples of the number of cuts, so the cut is what is left of the phrase.
    return address // wide * cuts + (tile & 0xFF) + first, address % wide + start


def counted(tile: int, address: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct addresses in order and their counts: by direct address if the tile is dense, else by sorting."""
    n = _shape(tile)[4]
    if n <= min(DENSE, 4 * len(address)):
        full = np.bincount(address, minlength=n)
        used = np.flatnonzero(full)
        return used, full[used]
    return np.unique(address, return_counts=True)


class Sum:
    """Counts of one tile, added up: an array of its cells if that is small, else sorted coordinates."""

    def __init__(self, tile: int):
        self.dense = np.zeros(n, np.int64) if (n := _shape(tile)[4]) <= DENSE else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.least = 0, 1 << 18

    def add(self, address: np.ndarray, n: np.ndarray) -> None:
        if self.dense is not None:
            self.dense[address] += n
            return
        self.parts.append((address, n))
        self.held += len(address)
        if self.held >= self.least:
            self._merge()
            self.least = max(1 << 18, 2 * self.held)

    def _merge(self) -> None:
        address, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(address, kind="stable")
        address, n = address[order], n[order]
        begin = np.flatnonzero(np.append(True, address[1:] != address[:-1]))
        self.parts = [(address[begin], np.add.reduceat(n, begin))]
        self.held = len(begin)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            used = np.flatnonzero(self.dense)
            return used, self.dense[used]
        self._merge()
        return self.parts[0]


# Blocks --------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words in order, the row of each, and the number of its piece."""
    body, offsets = raw(texts)
    end, keep = _END[body], ~_GAP[body]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begins = offsets[:-1][offsets[:-1] < len(body)]
    first[begins] = keep[begins]
    at = np.flatnonzero(first)
    row = np.searchsorted(offsets, at, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(end), at) + row
    starts = np.append(np.flatnonzero(first[keep]), np.count_nonzero(keep)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(_LOWER[body[keep]])))
    return words, row, piece


_FIRST = pa.schema([*_ROWS, ("c", pa.binary()), ("d", pa.binary()), ("base", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])
FIRST = f"{ROWS}, c binary, d binary, base long, lang string, n long"


def _shelf(langs: list[str], entries: list[str]) -> bytes:
    """Words of a bucket with their languages, compressed; words hold no line ends."""
    body = "\n".join([json.dumps(langs), *entries]).encode()
    return len(body).to_bytes(8, "little") + bytes(pa.compress(body, "zstd", asbytes=True))


def _unshelf(body: bytes) -> tuple[list[str], list[str]]:
    first, *entries = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True).decode().split("\n")
    return json.loads(first), entries


def _tokenize(batches):
    """Blocks: a row of local word numbers (kind 1, -1 between pieces), rows of distinct words by bucket (kind 0), and words per language (kind 2).

    Words are known by 96 bits of a hash of language and word; local numbers
    follow the order of the hashes, so a bucket's words are numbered in a row.
    """
    task, block = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts, langs = text_array(batch.column("text")), batch.column("lang").dictionary_encode()
        lang_of, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary.to_pylist()
        for lo, hi in slices(texts, BLOCK):
            words, row, piece = _split(texts.slice(lo, hi - lo))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            used, local, n = np.unique(lang_of[lo + row] * size + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
            spelled = coded.dictionary.take(pa.array(used % size)).to_pylist()
            entries = [f"{k}\t{w}" for k, w in zip((used // size).tolist(), spelled, strict=True)]
            hashes = [xxhash.xxh3_128_intdigest(f"{names[k]}\t{w}") for k, w in zip((used // size).tolist(), spelled, strict=True)]
            high = np.array([h >> 64 for h in hashes], np.uint64).astype(np.int64)
            tag = np.array([h & 0x7FFFFFFF for h in hashes], np.int64)
            order = np.lexsort((tag, high))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            local, n, high, tag = place[local], n[order], high[order], tag[order]
            of = np.bincount(lang_of[lo + row], minlength=len(names))
            breaks = piece[1:] != piece[:-1]
            del hashes, coded, words, row, piece
            line = np.full(len(local) + int(breaks.sum()), -1, np.int64)
            line[np.arange(len(local)) + np.append(0, np.cumsum(breaks))] = local
            number = task | block
            block += 1
            rows = [(number, 1, None, squeeze(line), None, None, None, None, None, None)]
            bucket = high >> (64 - BUCKET_BITS)
            bounds = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            for at, end in zip(bounds, [*bounds[1:], len(order)], strict=True):
                shelf = _shelf(names, [entries[k] for k in order[at:end].tolist()])
                rows.append((number, 0, int(bucket[at]), squeeze(high[at:end], True), squeeze(n[at:end]), squeeze(tag[at:end]), shelf, at, None, None))
            rows += [(number, 2, None, None, None, None, None, None, name, int(k)) for name, k in zip(names, of, strict=True) if k]
            yield _rows(rows, _FIRST)


def _stated(block: int, grams: np.ndarray, words: np.ndarray, size: int) -> list[tuple]:
    """Rows of a block of phrases of ``size`` words: its numbers (kind 1), and per tile the cells of longer phrases (kind 2)."""
    ahead = len(grams) - size
    if ahead <= 0:
        return []
    cover = np.zeros(len(grams), bool)
    for d in range(size):
        cover[d:] |= grams[: len(grams) - d] >= 0
    if not cover.any():
        return []
    # Of a run that no phrase covers one place is left, to keep its sides apart.
    keep = cover | np.append(True, cover[:-1])
    words = words[keep]
    grams = words if size == 1 else grams[keep]
    ahead = len(grams) - size
    if ahead <= 0:
        return []
    pair = np.flatnonzero((grams[:ahead] >= 0) & (grams[1 : ahead + 1] >= 0))
    if not len(pair):
        return []
    phrase, word = grams[pair], words[pair + size]
    tile = tiles_of(phrase, word)
    order = np.argsort(tile, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0))
    rows = [(block, 1, None, squeeze(grams), None if grams is words else squeeze(words))]
    for lo, hi in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        mine = order[lo:hi]
        t = int(tile[mine[0]])
        address, n = counted(t, addresses(t, phrase[mine], word[mine]))
        rows.append((block, 2, t, squeeze(address, True), squeeze(n)))
    return rows


def _name_words(batches):
    """Blocks with ranked words, from their answers (kind 0: local numbers, ranks) and then the block's line (kind 1)."""
    block, local, ids = None, [], []
    for batch in batches:
        for b, kind, x, y in zip(*(batch.column(k) for k in ("block", "kind", "a", "b")), strict=True):
            if b.as_py() != block:
                block, local, ids = b.as_py(), [], []
            if kind.as_py() == 0:
                local.append(unsqueeze(x.as_py()))
                ids.append(unsqueeze(y.as_py()))
                continue
            if not local:
                continue
            line = unsqueeze(x.as_py())
            rank = np.full(int(line.max()) + 2, -1, np.int64)
            rank[np.concatenate(local)] = np.concatenate(ids)
            words = rank[line]  # a break, -1, is the last entry
            if words.max() >= 1 << WORD_BITS:
                raise ValueError("more frequent words than ids")
            yield _rows(_stated(block, words, words, 1))


def _name_phrases(size: int):
    """Blocks with ranked phrases of ``size`` words, from their answers (kind 0) and numbers of the level before (kind 1)."""

    def run(batches):
        block, codes, ids = None, [], []
        for batch in batches:
            for b, kind, tile, x, y in zip(*(batch.column(k) for k in ("block", "kind", "tile", "a", "b")), strict=True):
                if b.as_py() != block:
                    block, codes, ids = b.as_py(), [], []
                if kind.as_py() == 0:
                    phrase, word = cells(tile.as_py(), unsqueeze(x.as_py()))
                    codes.append(phrase << WORD_BITS | word)
                    ids.append(unsqueeze(y.as_py()))
                    continue
                if not codes:
                    continue
                grams = unsqueeze(x.as_py())
                words = unsqueeze(y.as_py()) if y.is_valid else grams
                known, number = np.concatenate(codes), np.concatenate(ids)
                order = np.argsort(known)
                known, number = known[order], number[order]
                ahead = len(grams) - size + 1
                pair = np.flatnonzero((grams[:ahead] >= 0) & (grams[1 : ahead + 1] >= 0))
                code = grams[pair] << WORD_BITS | words[pair + size - 1]
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                longer = np.full(len(grams), -1, np.int64)
                longer[pair] = np.where(known[at] == code, number[at], -1)
                if longer.max() >= 1 << PHRASE_BITS:
                    raise ValueError("more frequent phrases than ids")
                yield _rows(_stated(block, longer, words, size))

    return run


# Sums, ranks and answers ---------------------------------------------------

_SUMS = "tile int, a binary, b binary"
_SUMS_SCHEMA = pa.schema([("tile", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _add_up(least: int):
    """Rows of one tile after the other, summed; counts under ``least`` go."""

    def run(batches):
        tile, total = None, None

        def out():
            address, n = total.result()
            keep = n >= least
            return _rows([(tile, squeeze(address[keep], True), squeeze(n[keep]))] if keep.any() else [], _SUMS_SCHEMA)

        for batch in batches:
            for t, a, n in zip(batch.column("tile").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if t != tile:
                    if tile is not None:
                        yield out()
                    tile, total = t, Sum(t)
                total.add(unsqueeze(a.as_py()), unsqueeze(n.as_py()))
        if tile is not None:
            yield out()

    return run


def _open_tiles(batches):
    """One row per frequent cell: tile, address, phrase, word, f."""
    for batch in batches:
        for t, a, n in zip(batch.column("tile").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            address = unsqueeze(a.as_py())
            phrase, word = cells(t, address)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(address), t, np.int32)), pa.array(address), pa.array(phrase), pa.array(word), pa.array(unsqueeze(n.as_py()))],
                names=["tile", "address", "phrase_id", "word_id", "f"],
            )


def _close_tiles(batches):
    """Addresses and ranks of a tile's frequent cells, gathered again."""
    tile, address, ids = None, [], []

    def out():
        return _rows([(tile, squeeze(np.concatenate(address), True), squeeze(np.concatenate(ids)))], _SUMS_SCHEMA)

    for batch in batches:
        tiles = batch.column("tile").to_numpy()
        a, i = batch.column("address").to_numpy(), batch.column("id").to_numpy()
        bounds = np.flatnonzero(np.append(True, tiles[1:] != tiles[:-1])) if len(tiles) else []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(tiles)).astype(int), strict=True):
            if tile is not None and tiles[lo] != tile:
                yield out()
                address, ids = [], []
            tile = int(tiles[lo])
            address.append(a[lo:hi])
            ids.append(i[lo:hi])
    if tile is not None:
        yield out()


def _answer(batches):
    """Ranks of the frequent cells that a block states; a tile's frequent cells (kind 0) stand before the blocks."""
    tile, known, ids = None, None, None
    for batch in batches:
        rows = []
        for b, kind, t, x, y in zip(*(batch.column(k) for k in ("block", "kind", "tile", "a", "b")), strict=True):
            t = t.as_py()
            if kind.as_py() == 0:
                tile, known, ids = t, unsqueeze(x.as_py()), unsqueeze(y.as_py())
            elif t == tile:
                address = unsqueeze(x.as_py())
                at = np.minimum(np.searchsorted(known, address), len(known) - 1)
                hit = known[at] == address
                if hit.any():
                    rows.append((b.as_py(), 0, t, squeeze(address[hit], True), squeeze(ids[at[hit]])))
        yield _rows(rows)


_WORDS = "tile int, a binary, b binary, c binary, d binary"
_WORDS_SCHEMA = pa.schema([("tile", pa.int32()), *[(k, pa.binary()) for k in "abcd"]])


def _add_words(least: int):
    """Hashes, counts, tags and the least block that has each word, of one bucket after the other, summed; counts under ``least`` go.

    Rows come from blocks (with their number, and no d) or are sums already.
    """

    def run(batches):
        tile, parts, held, limit = None, [], 0, 1 << 18

        def merged():
            high, n, tag, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((tag, high))
            high, n, tag, owner = high[order], n[order], tag[order], owner[order]
            first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (tag[1:] != tag[:-1])))
            return high[first], np.add.reduceat(n, first), tag[first], np.minimum.reduceat(owner, first)

        def out():
            high, n, tag, owner = merged()
            keep = n >= least
            row = (tile, squeeze(high[keep], True), squeeze(n[keep]), squeeze(tag[keep]), squeeze(owner[keep]))
            return _rows([row] if keep.any() else [], _WORDS_SCHEMA)

        for batch in batches:
            for t, block, a, n, c, d in zip(batch.column("tile").to_pylist(), batch.column("block").to_pylist(), *(batch.column(k) for k in "abcd"), strict=True):
                if t != tile:
                    if tile is not None:
                        yield out()
                    tile, parts, held, limit = t, [], 0, 1 << 18
                high = unsqueeze(a.as_py())
                owner = unsqueeze(d.as_py()) if d.is_valid else np.full(len(high), block, np.int64)
                parts.append((high, unsqueeze(n.as_py()), unsqueeze(c.as_py()), owner))
                held += len(high)
                if held >= limit:
                    parts = [merged()]
                    held = len(parts[0][0])
                    limit = max(1 << 18, 2 * held)
        if tile is not None:
            yield out()

    return run


def _open_words(batches):
    """One row per frequent word: bucket, hash, tag, f, owner."""
    for batch in batches:
        for t, a, n, c, d in zip(batch.column("tile").to_pylist(), *(batch.column(k) for k in "abcd"), strict=True):
            high = unsqueeze(a.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(high), t, np.int32)), *[pa.array(unsqueeze(x.as_py())) for x in (a, c, n, d)]], names=["tile", "high", "tag", "f", "owner"]
            )


def _close_words(batches):
    """Hashes, ranks, tags and owners of a bucket's frequent words, gathered again."""
    tile, parts = None, []

    def out():
        high, ids, tag, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _rows([(tile, squeeze(high, True), squeeze(ids), squeeze(tag), squeeze(owner))], _WORDS_SCHEMA)

    for batch in batches:
        tiles = batch.column("tile").to_numpy()
        columns = [batch.column(k).to_numpy() for k in ("high", "id", "tag", "owner")]
        bounds = np.flatnonzero(np.append(True, tiles[1:] != tiles[:-1])) if len(tiles) else []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(tiles)).astype(int), strict=True):
            if tile is not None and tiles[lo] != tile:
                yield out()
                parts = []
            tile = int(tiles[lo])
            parts.append([c[lo:hi] for c in columns])
    if tile is not None:
        yield out()


_NAMED = "block long, kind int, a binary, b binary, id long, lang string, word string"
_NAMED_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string())])


def _answer_words(batches):
    """Ranks of the frequent words of a block (kind 0), and the spelling of those that it owns (kind 3); a bucket's frequent words stand first."""
    tile, high, tag, ids, owner = None, None, None, None, None
    for batch in batches:
        rows = []
        for b, kind, t, a, n, c, d, base in zip(*(batch.column(k) for k in ("block", "kind", "tile", "a", "b", "c", "d", "base")), strict=True):
            t, b = t.as_py(), b.as_py()
            if kind.as_py() == -1:
                tile, high, ids, tag, owner = t, *(unsqueeze(x.as_py()) for x in (a, n, c, d))
                continue
            if t != tile:
                continue
            mine, marks = unsqueeze(a.as_py()), unsqueeze(c.as_py())
            at = np.searchsorted(high, mine)
            hit = np.zeros(len(mine), bool)
            found = np.zeros(len(mine), np.int64)
            left = np.flatnonzero(at < len(high))
            while len(left):  # words of one 64-bit hash differ in the tag
                same = high[at[left]] == mine[left]
                left = left[same]
                ok = tag[at[left]] == marks[left]
                hit[left[ok]], found[left[ok]] = True, at[left[ok]]
                left = left[~ok]
                at[left] += 1
                left = left[at[left] < len(high)]
            if not hit.any():
                continue
            local = np.flatnonzero(hit)
            rows.append((b, 0, squeeze(local + base.as_py(), True), squeeze(ids[found[local]]), None, None, None))
            own = local[owner[found[local]] == b]
            if len(own):
                langs, entries = _unshelf(d.as_py())
                for k in own.tolist():
                    code, word = entries[k].split("\t")
                    rows.append((b, 3, None, None, int(ids[found[k]]), langs[int(code)], word))
        yield _rows(rows, _NAMED_SCHEMA)


def frequent_phrases(docs: DataFrame, least: int = 100, most_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases that occur ``least`` times, and (lang, n) with the words of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession, BATCH):
        first = stored(rows.mapInArrow(_tokenize, FIRST), "none")
    sizes = stored(first.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("n")))
    with small_batches(docs.sparkSession, 64):  # rows are blocks and tiles
        levels = _levels(first, least, most_words)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "phrase", "n_words", "f"), sizes


def _levels(first: DataFrame, least: int, most_words: int) -> list[DataFrame]:
    """Frequent words, then frequent phrases of two words and more, with their ranks; all stored, and ``first`` and all else removed."""
    lines, vocabulary = first.where("kind = 1"), first.where("kind = 0")
    n_blocks = lines.count()
    salts = max(1, min(n_blocks // 256, 8 + math.isqrt(n_blocks)))  # a tile's rows, in both rounds of adding up
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def added(rows: DataFrame, add, schema: str, columns: list[str]) -> DataFrame:
        """Rows of a tile added up by salts, then over them."""
        if salts > 1:
            dealt = rows.select("tile", salt, *columns).repartition("tile", "salt").sortWithinPartitions("tile", "salt")
            rows = dealt.select("tile", *columns).mapInArrow(add(1), schema).withColumn("block", F.lit(None).cast("long"))
        return stored(rows.select("tile", *columns).repartition("tile").sortWithinPartitions("tile").mapInArrow(add(least), schema), "none")

    bare = vocabulary.select("tile", "block", "a", "b", "c", F.lit(None).cast("binary").alias("d"))
    sums = added(bare, _add_words, _WORDS, ["block", "a", "b", "c", "d"])
    opened = sums.mapInArrow(_open_words, "tile int, high long, tag long, f long, owner long")
    ranked = stored(along(opened, [F.col("f").desc(), F.col("high").asc(), F.col("tag").asc()], "id"))
    shelves = ranked.select("tile", "high", "tag", "id", "owner").repartition("tile").sortWithinPartitions("tile", "high", "tag")
    shelved = stored(shelves.mapInArrow(_close_words, _WORDS), "none")
    asked = shelved.select("tile", "a", "b", "c", "d", F.lit(-1).alias("kind"), every_salt)
    asked = asked.unionByName(vocabulary.select("block", "kind", "tile", "a", "c", "d", "base", salt), allowMissingColumns=True)
    asked = asked.repartition("tile", "salt").sortWithinPartitions("tile", "salt", "kind").select("block", "kind", "tile", "a", "b", "c", "d", "base")
    named = stored(asked.mapInArrow(_answer_words, _NAMED))
    words = stored(named.where("kind = 3").select("id", "lang", "word").join(ranked.select("id", "f"), "id"))
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "f")]
    both = named.where("kind = 0").select("block", "kind", "a", "b").unionByName(lines.select("block", "kind", "a", "b"))
    blocks = stored(both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_name_words, ROWS), "none")
    discard(first, sums, ranked, shelved, named)
    for size in range(2, most_words + 1):
        tiles = blocks.where("kind = 2")
        sums = added(tiles, _add_up, _SUMS, ["block", "a", "b"])
        if sums.isEmpty():
            discard(sums)
            break
        opened = sums.mapInArrow(_open_tiles, "tile int, address long, phrase_id long, word_id long, f long")
        found = stored(along(opened, [F.col("f").desc(), F.col("phrase_id").asc(), F.col("word_id").asc()], "id"))
        head = levels[-1].select(F.col("id").alias("phrase_id"), "lang", F.col("phrase").alias("_head"))
        tail = words.select(F.col("id").alias("word_id"), "word")
        level = found.join(head, "phrase_id").join(tail, "word_id")
        levels.append(stored(level.select("id", "lang", F.concat_ws(" ", "_head", "word").alias("phrase"), F.lit(size).alias("n_words"), "f")))
        if size == most_words:
            discard(sums, found)
            break
        ranks = found.select("tile", "address", "id").repartition("tile").sortWithinPartitions("tile", "address").mapInArrow(_close_tiles, _SUMS)
        ranks = stored(ranks, "none")
        asked = ranks.select(F.lit(None).cast("long").alias("block"), F.lit(0).alias("kind"), "tile", "a", "b", every_salt)
        asked = asked.unionByName(tiles.withColumn("salt", salt))
        answers = asked.repartition("tile", "salt").sortWithinPartitions("tile", "salt", "kind").select("block", "kind", "tile", "a", "b").mapInArrow(_answer, ROWS)
        both = answers.unionByName(blocks.where("kind = 1"))
        used, blocks = blocks, stored(both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_name_phrases(size), ROWS), "none")
        discard(used, sums, found, ranks)
    discard(blocks)
    return levels


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int | None = 2000, covered: int = 100) -> DataFrame:
    """Phrases of 2 to ``most_words`` words by the score of their weakest cut, best ``top`` of each language.

    score = floor(1000 * a * n / (l * r)), exact; a phrase that a longer
    frequent one holds with ``covered`` per cent of its occurrences is left out.
    """
    phrases, sizes = frequent_phrases(docs, least, most_words)
    phrases = stored(phrases)
    part = lambda first, length: F.array_join(F.slice("_w", first, length), " ")
    longer = phrases.where("n_words > 2").withColumn("_w", F.split("phrase", " "))
    spans = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for k in range(2, most_words) for i in range(1, most_words - k + 2)]
    if spans:
        inner = longer.select("lang", "f", "n_words", "_w", F.explode(F.array(*spans)).alias("s"))
        inner = inner.where((F.col("s.k") < F.col("n_words")) & (F.col("s.i") + F.col("s.k") - 1 <= F.col("n_words")))
        inner = inner.select("lang", part(F.col("s.i"), F.col("s.k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
        kept = phrases.where("n_words > 1").join(inner, ["lang", "phrase"], "left")
        kept = kept.where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("f"))).drop("_longer")
    else:
        kept = phrases.where("n_words > 1")
    cuts = kept.withColumn("_w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("_right"))
    left = phrases.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(sizes, "lang")
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) as decimal(22,0)) * cast(n as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = scored.withColumn("score", score.cast("long"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("c")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(least_cut).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()))
    best = best.withColumn("rank", rank.cast("long"))
    best = best if top is None else best.where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
