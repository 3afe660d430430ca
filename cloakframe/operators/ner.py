"""Post-processing of named-entity output.

The model is not part of this package; its token rows are an input table
(doc_id, chunk, pos, word, entity, score, start, end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.patterns import SPACE
from cloakframe.functions.sqltext import SOH, STX
from cloakframe.operators.detect import let


def chunk_text(df: DataFrame, text: str = "text", size: int = K.NER_CHUNK_WORDS,
               stride: int = K.NER_CHUNK_STRIDE) -> DataFrame:
    """Overlapping word windows of long texts, with code-point offsets.

    A text of up to ``size`` words is one chunk, kept as it is.
    """
    space = f"[{SPACE}]+"
    words = F.split(F.col(text), space)
    df = df.where(F.length(text) > 0).withColumn("_w", words).withColumn("_n", F.size("_w"))
    # Words and the spaces between them alternate; an offset is the length of all
    # parts before a word.  Each stride is summed once, then the strides' sums run on.
    fenced = rf"split(regexp_replace(replace(`{text}`, {SOH}, {STX}), r'{space}', '\u0001$0\u0001'), {SOH})"
    lengths = f"transform({fenced}, p -> length(p))"
    strides = let("lens", lengths, f"transform(sequence(0, (_n - 1) div {stride}), k -> "
                  f"aggregate(slice(lens, k * {2 * stride} + 1, {2 * stride}), 0, (a, n) -> a + n))")
    offsets = f"aggregate({strides}, array(0), (a, s) -> concat(a, array(element_at(a, -1) + s)))"
    starts = F.expr(f"if(_n <= {size}, array(0), sequence(0, _n - 1, {stride}))")
    keep = [c for c in df.columns if c not in ("_w", "_n", text)]
    out = (df.withColumn("_o", F.expr(f"if(_n <= {size}, array(0), {offsets})"))
           .select(*keep, text, "_w", "_n", "_o", F.posexplode_outer(starts).alias("chunk_no", "_s")))
    body = F.when(F.col("_n") <= size, F.col(text)).otherwise(
        F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " "))
    return (out.withColumn("chunk_text", body)
            .withColumn("start_offset", F.expr("_o[chunk_no]"))
            .withColumn("end_offset", F.col("start_offset") + F.length("chunk_text"))
            .select(*keep, "chunk_no", "start_offset", "end_offset", "chunk_text"))


def merge_tokens(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """Join sub-word and continuation tokens into entities.

    A token continues the open entity if it is a sub-word (``##``), or an
    ``I-`` token of the open entity's type; any other token opens a new one.
    Score is the least, end the last of its tokens.
    """
    kind = F.regexp_replace("entity", "^[BI]-", "")
    sub = F.startswith("word", F.lit("##"))
    earlier = (Window.partitionBy(*keys).orderBy("pos")
               .rowsBetween(Window.unboundedPreceding, -1))
    tokens = tokens.withColumn("_kind", kind).withColumn("_sub", sub)
    # A sub-word keeps the open type; any other token's type is the open one after it.
    open_type = F.coalesce(F.last(F.when(~F.col("_sub"), F.col("_kind")), ignorenulls=True).over(earlier),
                           F.first("_kind").over(Window.partitionBy(*keys).orderBy("pos")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) == 1
    joins = ~first & (F.col("_sub") | (F.startswith("entity", F.lit("I-")) & (F.col("_kind") == open_type)))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = (tokens.withColumn("_opens", F.when(joins, 0).otherwise(1))
              .withColumn("entity_no", F.sum("_opens").over(run)))
    piece = F.when(F.col("_opens") == 1, F.col("word")).when(
        F.col("_sub"), F.regexp_replace("word", "^##", "")).otherwise(F.concat(F.lit(" "), F.col("word")))
    return (marked.withColumn("_piece", piece).groupBy(*keys, "entity_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_piece"))),
                                          lambda x: x["_piece"]), "").alias("word"),
                 F.min_by("_kind", "pos").alias("entity"), F.min("score").alias("score"),
                 F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"),
                 F.count("*").alias("n_tokens")))


def _merged(batch: pa.RecordBatch, keys: list[str], tokens: str) -> pa.RecordBatch:
    """Entities of a batch of token lists; all lists at once, a place of the flattened tokens at a time."""
    lists = batch.column(tokens)
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    word, entity, score, start, end = (pc.struct_field(flat, n) for n in ("word", "entity", "score", "start", "end"))
    n, begin = len(flat), np.append(0, np.cumsum(sizes))
    labels = entity.dictionary_encode()
    names = labels.dictionary.to_pylist()
    kinds = pa.array([x[2:] if x[:2] in ("B-", "I-") else x for x in names], pa.string()).dictionary_encode()
    label = pc.fill_null(labels.indices, -1).to_numpy(zero_copy_only=False)
    kind = np.append(kinds.indices.to_numpy(zero_copy_only=False), -1)[label]
    inner = np.array([x[:2] == "I-" for x in names] + [False])[label]
    sub = pc.fill_null(pc.starts_with(word, "##"), False)
    at, own = np.arange(n), np.repeat(begin[:-1], sizes)
    whole = pc.fill_null(pc.invert(pc.starts_with(word, "##")), False).to_numpy(zero_copy_only=False)
    # A sub-word keeps the open type; any other token's type is the open one after it.
    last = np.append(-1, np.maximum.accumulate(np.where(whole & (kind >= 0), at, -1))[:-1])[:n]
    opened = kind[np.maximum(last, own)] if n else kind[:0]
    joins = (at != own) & (sub.to_numpy(zero_copy_only=False) | (inner & (kind >= 0) & (kind == opened)))
    first = np.flatnonzero(~joins)
    pieces = pc.if_else(pa.array(joins), pc.if_else(sub, pc.utf8_slice_codeunits(word, 2), pc.binary_join_element_wise(" ", word, "")), word)
    pieces = pc.fill_null(pieces, "")
    cut = np.frombuffer(pieces.buffers()[1], np.int32, n + 1, pieces.offset * 4)[np.append(first, n)] if n else np.zeros(1, np.int32)
    # Pieces of an entity lie side by side, so its word is one stretch of their letters.
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(cut)), pieces.buffers()[2])
    known = score.is_valid().to_numpy(zero_copy_only=False)
    value = np.where(known, pc.fill_null(score, 0.0).to_numpy(zero_copy_only=False), np.inf)
    least, scored = (np.minimum.reduceat(value, first), np.logical_or.reduceat(known, first)) if n else (value, known)
    ends = np.append(first[1:], n)[: len(first)]
    row = np.repeat(np.arange(len(sizes)), sizes)[first]
    number = np.arange(len(first)) - np.searchsorted(first, begin[:-1])[row] + 1
    shown = pc.take(kinds.dictionary, pa.array(kind[first], pa.int64(), mask=kind[first] < 0))
    out = {"entity_no": pa.array(number, pa.int64()), "word": words, "entity": shown, "score": pa.array(least, pa.float64(), mask=~scored),
           "start": start.take(pa.array(first)), "end": end.take(pa.array(ends - 1)), "n_tokens": pa.array(ends - first, pa.int64())}
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), *out.values()], [*keys, *out])


def merge_token_lists(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The entities of :func:`merge_tokens` for rows that hold the token list of one model call.

    ``tokens`` is an array of (word, entity, score, start, end) in order; the
    other columns are the keys.  Lists are merged where they lie, so no token
    is shuffled or sorted.
    """
    keys = [c for c in chunks.columns if c != tokens]
    chunks = chunks.select(*keys, F.col(tokens).cast("array<struct<word:string,entity:string,score:double,start:int,`end`:int>>").alias(tokens))
    schema = chunks.select(*keys).schema
    for name, kind in (("entity_no", "long"), ("word", "string"), ("entity", "string"), ("score", "double"), ("start", "integer"), ("end", "integer"), ("n_tokens", "long")):
        schema = schema.add(name, kind)
    return chunks.mapInArrow(lambda batches: (_merged(b, keys, tokens) for b in batches), schema)


def context_words(*parts: Column) -> Column:
    """Distinct lower-case words of class, id, tag and label text."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.array_distinct(F.filter(F.split(joined, rf"[{SPACE}\-_]+"), lambda w: w != ""))


def keep_entity(word: Column, entity: Column, score: Column, context: Column) -> Column:
    """Whether an entity is personal data in its context."""
    name = F.lower(F.trim(word))

    def near(words: list[str]) -> Column:
        return F.arrays_overlap(context, F.array(*[F.lit(w) for w in words]))

    person = (~name.isin(K.NER_BRANDS) & ~name.isin(K.NER_STOP_NAMES) & (score >= 0.75)
              & (near(K.NER_PERSON_CONTEXT) | (score >= 0.90)))
    place = ((~name.isin(K.NER_GENERIC_PLACES) | near(K.NER_ADDRESS_CONTEXT))
             & ~near(K.NER_PUBLIC_PLACE_CONTEXT) & (score >= 0.80))
    employer = near(K.NER_EMPLOYER_CONTEXT) & (score >= 0.90) & ~name.isin(K.NER_BRANDS)
    return (F.length(name) >= 2) & (
        F.when(entity == "PER", person).when(entity == "LOC", place).when(entity == "ORG", employer)
        .otherwise(False))


def as_spans(entities: DataFrame, offset: Column | None = None) -> DataFrame:
    """Entities as spans: mapped type, rounded score, absolute offsets."""
    mapping = F.create_map(*[F.lit(x) for kv in K.NER_TYPES.items() for x in kv])
    shift = offset if offset is not None else F.lit(0)
    return (entities.withColumn("type", mapping[F.col("entity")]).where(F.col("type").isNotNull())
            .withColumn("value", F.col("word")).withColumn("ner_label", F.col("entity"))
            .withColumn("start", (F.col("start") + shift).cast("int"))
            .withColumn("end", (F.col("end") + shift).cast("int"))
            .withColumn("confidence", F.round("score", 4)).withColumn("method", F.lit("NER"))
            .drop("word", "entity", "score"))


def _kept(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Spans kept of batches sorted by key and place; only the last kept span is carried on."""
    held = None  # the last kept span, as a batch of one row
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        n = rows.num_rows
        same = np.ones(n, bool)  # whether a row has the key and type of the one before it
        same[0] = False
        for name in [*keys, "type"]:
            code = rows.column(name).combine_chunks().dictionary_encode(null_encoding="mask" if name == "type" else "encode")
            code = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False)
            same[1:] &= (code[1:] == code[:-1]) & (code[1:] >= 0)
        end = rows.column("end").to_numpy().astype(float)  # null: NaN, past nothing and not passed
        sure = rows.column("confidence").to_numpy().astype(float)
        kept, last, reach, best = [], 0, end[0] + 5, sure[0]
        for i, (goes_on, e, c) in enumerate(zip(same.tolist(), end.tolist(), sure.tolist(), strict=True)):
            if goes_on and e <= reach:
                if c > best:
                    last, reach, best = i, e + 5, c
            elif i:
                kept.append(last)
                last, reach, best = i, e + 5, c
        if kept:
            yield from rows.take(pa.array(kept)).to_batches()
        held = rows.slice(last, 1).combine_chunks().to_batches()[0]
        # A surer span stands for all before it, so the next row is compared with it as with the row before.
    if held is not None:
        yield held


def dedupe_spans(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), dealt: bool = False) -> DataFrame:
    """Drop repeats from overlapping chunks, keeping the surer one.

    Compared with the last kept span: same type, start not before it, end at
    most five characters past it.  A task streams its sorted spans and holds
    the last kept one, so a key may have any number.  ``dealt``: the rows of a
    key already lie in one partition, and are not shuffled again.
    """
    order = ["start", "end", "type", "value", "confidence"]
    rows = spans.select(*keys, F.col("start").cast("int"), F.col("end").cast("int"), "type", "value", F.col("confidence").cast("double"))
    rows = (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    names = list(keys)
    return rows.mapInArrow(lambda batches: _kept(batches, names), rows.schema)
