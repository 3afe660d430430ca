"""Near duplicates: bottom-k sketches of word shingles from one hash function.

1. Texts with equal shingle sets become one node, so copies are never paired.
2. A node keeps its k smallest shingle hashes.  Retained values are ordered by
   how common their hash bucket is among all retained values, rare ones first;
   two linked nodes share so many retained values that the first few of each in
   this order must meet (prefix filtering), so only those enter inverted lists.
3. Every list proposes its members to a pivot, not to each other.  Proposals
   whose sizes or 256-bit signatures (a bit of the smallest hash in each of 256
   classes) rule a link out end in the join; then a union sketch estimates the
   similarity, whole sets confirm it, and confirmed links are joined to
   components.
4. Lists whose other members still lie in different components go on: short
   ones with all remaining pairs, long ones with some pivots, more by turns,
   first those that are in most lists (a text whose edited copies fill the
   list); until every pair of a list is compared or already connected.  Now
   1024 parities of the whole sets rule links out, too, exactly: two sets
   differ in at least as many shingles as parities.

A linked pair falls below one of the estimates with probability under 1e-8 (six
standard deviations); sets of at most k shingles are compared exactly.

Defined cases: null, empty and blank texts have no shingles and stay alone; a
text with fewer words than a shingle is one shingle; rows without doc_id are
never linked and are kept (component_id null); repeated rows share a component;
texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cloakframe.llm.common import discard, hash64, slices, small_batches, stored, text_array, words_of
from cloakframe.llm.components import components

SKETCH = 96
BUCKETS = 1 << 17
SHORT_LIST = 24  # members of a list that are all compared with each other in the second turn
PIVOTS = 16  # members of a longer list that the second turn compares with it; eight times as many in each later turn
BITS = 256
SIGNATURE = [f"s{k}" for k in range(BITS // 64)]
PARITIES = 1024
PARITY = [f"o{k}" for k in range(PARITIES // 64)]
BITMAP = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int):
    """Yield (row, sorted distinct 63-bit shingle hashes) of every text; words are lower-cased (A-Z only)."""
    for lo, hi in slices(texts, 4 << 20):
        words, first = words_of(texts.slice(lo, hi - lo))
        coded = words.dictionary_encode()
        code = hash64(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
        grams = np.full(max(0, len(code) - width + 1), width, np.uint64)
        for k in range(width):
            grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(grams)])
        for k in range(hi - lo):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield lo + k, np.unique(grams[a : b - width + 1] >> np.uint64(1))
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for c in code[a:b]:
                    one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + c)
                yield lo + k, one >> np.uint64(1)
            else:
                yield lo + k, np.empty(0, np.uint64)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signature(values: np.ndarray) -> bytes:
    """One bit of the smallest hash in each of 256 classes; ``values`` ascend."""
    bits = np.zeros(BITS, bool)
    at = (values & np.uint64(BITS - 1)).astype(np.int64)[::-1]
    bits[at] = ((values >> np.uint64(8)) & np.uint64(1)).astype(bool)[::-1]  # the smallest is written last
    return np.packbits(bits).tobytes()


def parities(values: np.ndarray) -> bytes:
    """Whether each of 1024 classes holds an odd number of values: sets differ in at least as many values as these bits."""
    at = ((values >> np.uint64(16)) & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITIES) & 1).astype(bool)).tobytes()


def agreeing(need: float) -> int:
    """Signature bits in which two sets of similarity ``need`` agree, six standard deviations aside."""
    p = (1 + need) / 2
    return math.floor(BITS * p - 6 * math.sqrt(BITS * p * (1 - p)))


def _sketches(width: int, size: int):
    def run(batches):
        for batch in batches:
            n, key, sketch, sign, odd = [], [], [], [], []
            for _, s in shingle_sets(text_array(batch.column("text")), width):
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
                sketch.append(s[:size].tobytes())
                sign.append(signature(s))
                odd.append(parities(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()),
                 *[pa.array(np.ascontiguousarray(c)) for c in np.frombuffer(b"".join(sign), np.int64).reshape(-1, len(SIGNATURE)).T],
                 *[pa.array(np.ascontiguousarray(c)) for c in np.frombuffer(b"".join(odd), np.int64).reshape(-1, len(PARITY)).T]],
                names=["doc_id", "n", "key", "sketch", *SIGNATURE, *PARITY],
            )

    return run


def _bucket_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        body = b"".join(batch.column("sketch").to_pylist())
        total += np.bincount(np.frombuffer(body, np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def prefix_size(kept: int, n: int, size: int, need: float) -> int:
    """How many retained values must be listed so that any linked node with as many meets one of them."""
    if n <= size:
        shared = math.ceil(need * n - 1e-9)
    else:
        shared = math.floor(need * size - 6 * math.sqrt(size * need * (1 - need)))
    return max(1, kept - max(1, shared) + 1)


def _prefixes(level: np.ndarray, size: int, need: float):
    def run(batches):
        for batch in batches:
            values, nodes = [], []
            for key, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sketch")), strict=True):
                s = np.frombuffer(sketch, np.uint64)
                order = np.lexsort((s, level[s % np.uint64(BUCKETS)]))[: prefix_size(len(s), n, size, need)]
                values.append(s[order])
                nodes += [key] * len(order)
            flat = np.concatenate(values).astype(np.int64) if values else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(nodes, pa.binary())], names=["value", "node"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int]:
    """(values of the union sketch in both, size of the union sketch)."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)
    if len(a) < size and len(b) < size:
        return len(both), len(union)
    cut = union[min(size, len(union)) - 1]
    return int(np.searchsorted(both, cut, side="right")), min(size, len(union))


def _estimated(size: int, need: float):
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True):
                hit, of = estimate(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), size)
                ok.append(hit >= need * of - 6 * math.sqrt(of * need * (1 - need)))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _needed_texts(width: int, bits: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(bits[ids % len(bits)]))
            texts = text_array(batch.column("text"))
            keys = [set_key(s) if len(s) else None for _, s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), texts], names=["key", "text"])

    return run


def _confirmed(width: int, percent: int):
    def run(batches):
        for batch in batches:
            # A text in several pairs of a batch is cut into shingles once.
            keys = batch.column("a").to_pylist() + batch.column("b").to_pylist()
            place = {k: i for i, k in reversed(list(enumerate(keys)))}
            texts = pa.concat_arrays([text_array(batch.column("text_a")), text_array(batch.column("text_b"))])
            order = list(place)
            sets = {order[k]: s for k, s in shingle_sets(texts.take(pa.array(list(place.values()))), width)}
            ok = []
            for a, b in zip(keys[: len(batch)], keys[len(batch) :], strict=True):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                ok.append(100 * both >= percent * (len(sets[a]) + len(sets[b]) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


class _Links:
    """Turns candidate pairs (a, b) of nodes into confirmed links."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int, size: int):
        self.docs, self.nodes, self.width, self.percent, self.size = docs, nodes, width, percent, size

    def confirm(self, pairs: DataFrame) -> DataFrame:
        sketch = self.nodes.select("key", "sketch")
        both = pairs.join(sketch.withColumnsRenamed({"key": "a", "sketch": "sketch_a"}), "a")
        both = both.join(sketch.withColumnsRenamed({"key": "b", "sketch": "sketch_b"}), "b")
        likely = stored(both.mapInArrow(_estimated(self.size, self.percent / 100), "a binary, b binary"))
        if likely.isEmpty():
            return likely
        used = likely.select(F.col("a").alias("key")).unionByName(likely.select(F.col("b").alias("key"))).distinct()
        # Texts of the nodes concerned: a bitmap of fixed size keeps most others out of the shuffle.
        bits = np.zeros(BITMAP, bool)
        for r in self.nodes.join(used, "key", "left_semi").select(F.pmod("doc_id", F.lit(BITMAP)).alias("bit")).distinct().collect():
            bits[r.bit] = True
        texts = self.docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_needed_texts(self.width, bits), "key binary, text string")
        with small_batches(both.sparkSession, 2500):
            texts = stored(texts.where("key is not null").dropDuplicates(["key"]))
        both = likely.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
        both = both.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
        with small_batches(both.sparkSession, 1000):  # two whole texts a row
            links = stored(both.mapInArrow(_confirmed(self.width, self.percent), "a binary, b binary"))
        discard(likely, texts)
        return links


def _spanning(lists: DataFrame) -> DataFrame:
    """The rows of the lists whose members lie in several components."""
    spans = lists.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
    return lists.join(spans, "value", "left_semi")


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """(value, pivot, pivot_n, pivot_component): the members of every list to compare with the whole list now.

    First one member per list, one of two hash orders, so that the lists of a
    group of copies share few pivots.  Later those that are in most lists, as
    they have the fewest shingles of their own, in the same order in every list
    and in a number that grows by turns; a short list is compared completely.
    """
    told = [c for c in lists.columns if c != "value"]
    if not turn:
        order = F.xxhash64("node", F.pmod("value", F.lit(2)))
        best = lists.groupBy("value").agg(F.min(F.struct(order.alias("h"), *told)).alias("p"))
        return best.select("value", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in told])
    line = Window.partitionBy("value")
    held = lists.groupBy("node").agg(F.count("*").alias("held"))
    central = line.orderBy(F.col("held").desc(), F.xxhash64("node"), "node")
    ranked = lists.join(held, "node").withColumns({"members": F.count("*").over(line), "at": F.row_number().over(central)})
    chosen = ranked.where((F.col("members") <= SHORT_LIST) | (F.col("at") <= PIVOTS * 8 ** (turn - 1)))
    return chosen.select("value", *[F.col(c).alias(f"pivot_{c}") for c in told])


def _proposals(lists: DataFrame, pivots: DataFrame, need: float) -> DataFrame:
    """Distinct pairs (a, b) of list members and pivots that sizes, components and signatures allow."""
    x, y = lists.alias("x"), pivots.alias("y")
    alike = sum(F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.pivot_{s}"))) for s in SIGNATURE) <= BITS - agreeing(need)
    fits = (F.col("x.n") >= need * F.col("y.pivot_n") - 1e-9) & (F.col("y.pivot_n") >= need * F.col("x.n") - 1e-9)
    apart = (F.col("x.node") != F.col("y.pivot_node")) & (F.col("x.component") != F.col("y.pivot_component"))
    if PARITY[0] in lists.columns:
        odd = sum(F.bit_count(F.col(f"x.{o}").bitwiseXOR(F.col(f"y.pivot_{o}"))) for o in PARITY)
        alike &= odd <= (F.col("x.n") + F.col("y.pivot_n")) * ((1 - need) / (1 + need)) + 1e-9
    pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & apart & fits & alike)
    return pairs.select(F.least("x.node", "y.pivot_node").alias("a"), F.greatest("x.node", "y.pivot_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, size: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents with 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles are linked; a component's smallest doc_id is kept.
    """
    need = percent / 100
    signed = "".join(f", {c} long" for c in (*SIGNATURE, *PARITY))
    with small_batches(docs.sparkSession, 2500):
        rows = stored(docs.select("doc_id", "text").mapInArrow(_sketches(width, size), f"doc_id long, n long, key binary, sketch binary{signed}"), "none")
    live = rows.where("key is not null and doc_id is not null")
    nodes = stored(live.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("sketch", *SIGNATURE, *PARITY)]), "none")

    count = nodes.select("sketch").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(BUCKETS, np.int64)
    seen[count["bucket"].to_numpy(np.int64)] = count["n"].to_numpy(np.int64)
    level = np.log2(np.maximum(1, seen * BUCKETS / max(1, seen.sum()))).astype(np.int8)

    listed = stored(nodes.select("key", "n", "sketch").mapInArrow(_prefixes(level, size, need), "value long, node binary"), "none")
    shared = listed.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    told = nodes.select(F.col("key").alias("node"), "n", *SIGNATURE)
    lists = stored(listed.join(shared, "value", "left_semi").join(told, "node").withColumn("component", F.col("node")))
    discard(listed)
    finder = _Links(docs, nodes, width, percent, size)
    links, labels, turn = None, None, 0
    while True:
        top = stored(_pivots(lists, turn))
        found = finder.confirm(_proposals(lists, top, need))
        links = found if links is None else links.unionByName(found)
        if labels is None or not found.isEmpty():
            old, labels = labels, stored(components(links))
            if old is not None:
                discard(old)
        # What is left: members that were no pivots, in lists that span several components.
        rest = lists.drop("component").join(top.select("value", F.col("pivot_node").alias("node")), ["value", "node"], "left_anti")
        rest = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        left = _spanning(rest)
        if not turn:
            left = left.join(nodes.select(F.col("key").alias("node"), *PARITY), "node")
        done, lists = lists, stored(left.select("value", "node", "n", *SIGNATURE, *PARITY, "component"))
        discard(done, top)
        if lists.isEmpty():
            break
        turn += 1
    best = nodes.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left")
    best = best.withColumn("component", F.coalesce("component", "key"))
    first = best.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_key = best.join(first, "component").select("key", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_key, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each component; repeated rows of the same id and text stay once."""
    marks = near_duplicates(docs, width, percent)
    kept = marks.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    once, more = kept.where("copies = 1").select("doc_id"), kept.where("copies > 1").select("doc_id")
    out = docs.join(once, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return out.unionByName(docs.join(more, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)
