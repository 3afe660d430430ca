"""Thin queries over the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.repeats import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.tokenfile import token_digest

    return token_digest(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, lower=True)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_contaminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.decontaminate import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.rules import quality_rules

    kept = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.ctw import model_scores

    return model_scores(table(spark, sf_dir, "documents"))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0, window=1024)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=100, most_words=5, top=2000)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.llm.conversations import damage, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damage(conversations), conversations)


QUERIES = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_token_files": op2_token_files,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_contaminations": op5_contaminations,
    "op6_quality_rules": op6_quality_rules,
    "op7_context_trees": op7_context_trees,
    "op8_quality_score": op8_quality_score,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_source_mix": op12_source_mix,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d
), e AS (SELECT doc_id, unnest(s) AS x FROM g),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, k.b FROM reach r JOIN both_ways k ON k.a = r.b
), least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept
FROM g JOIN least_id USING (doc_id)
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(size) WHERE len(w) >= size
), n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY lang, phrase, size HAVING count(*) >= 100),
c AS (
  SELECT s.lang, s.phrase, s.size, s.f FROM f s WHERE s.size > 1 AND NOT EXISTS (
    SELECT 1 FROM f t WHERE t.lang = s.lang AND t.size > s.size AND 100 * t.f >= 100 * s.f AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' '))
), k AS (
  SELECT c.lang, c.phrase, c.f AS a, k.k, array_to_string(string_split(phrase, ' ')[1:k.k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k.k + 1:], ' ') AS tail
  FROM c CROSS JOIN (VALUES (1), (2), (3), (4)) k(k) WHERE k.k < c.size
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.tail JOIN n ON n.lang = k.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
    "op12_source_mix": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, CASE rank % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS bend,
         3 * source_size AS cap, sum(source_size) OVER () AS words, sum(rank % 3 + 1) OVER () AS weights FROM s
), f AS (
  SELECT *, CAST(words - coalesce(sum(cap) OVER b, 0) AS BIGINT) AS rest, CAST(weights - coalesce(sum(rank % 3 + 1) OVER b, 0) AS BIGINT) AS unfilled,
         row_number() OVER (ORDER BY cap / weight, rank) AS place
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT place AS p, rest AS r, unfilled AS u FROM f WHERE rest <= cap / weight * unfilled ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, weight * (1 - bend) AS w0, weight * (1 + bend) AS w1,
         CASE WHEN place < p THEN CAST(cap AS DOUBLE) ELSE weight * r / u END AS target FROM f CROSS JOIN l
), q AS (
  SELECT d.*, source_size, target, w0, w1, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, source_size * pass + before AS start FROM q CROSS JOIN (VALUES (0), (1), (2)) v(pass) WHERE size > 0 AND source_size * pass + before < quota
), a AS (SELECT *, start / quota * ((w1 + w0) / 2) AS area FROM c),
m AS (
  SELECT *, 2 * area / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * area)) AS time FROM a
), o AS (
  SELECT *, row_number() OVER (ORDER BY time, source NULLS LAST, digest, pass, doc_id NULLS LAST) - 1 AS place FROM m
), taken AS (
  SELECT row, CAST(sum(least(size, quota - start)) AS BIGINT) AS taken, min(place) AS first_place, min(time) AS first_time FROM o GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_place, first_time FROM q LEFT JOIN taken USING (row)
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS draw
  FROM conversations CROSS JOIN crc
), faulty AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE draw <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM faulty
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS letter,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous, count(*) OVER (PARTITION BY conv_id) AS n FROM numbered
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         n - i AS behind FROM seen
), symbols AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM marked
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS done, {'c': 0, 'a': ''} AS v1, {'c': 6, 'a': 'II'} AS v2, {'c': 3, 'a': 'I'} AS v3, {'c': 0, 'a': ''} AS v4
  FROM symbols WHERE behind = 0
  UNION ALL
  SELECT conv_id, done + 1, least(b1, {'c': 3 + u.c, 'a': 'I' || u.a}), least(b2, {'c': 3 + u.c, 'a': 'I' || u.a}), u, least(b4, {'c': 3 + b3.c, 'a': 'I' || b3.a})
  FROM (SELECT *, least(b3, {'c': 3 + b4.c, 'a': 'I' || b4.a}) AS u FROM (
    SELECT p.conv_id, done,
      list_min([{'c': 4 + v1.c, 'a': 'D' || v1.a}, CASE WHEN NOT must AND letter = 's' THEN {'c': late + v2.c, 'a': 'K' || v2.a} END,
                CASE WHEN NOT must AND letter = 'u' THEN {'c': late + v3.c, 'a': 'K' || v3.a} END,
                CASE WHEN NOT must THEN {'c': 3 + late + v3.c, 'a': 'R' || v3.a} END]) AS b1,
      list_min([{'c': 4 + v2.c, 'a': 'D' || v2.a}, CASE WHEN NOT must AND letter = 'u' THEN {'c': late + v3.c, 'a': 'K' || v3.a} END,
                CASE WHEN NOT must THEN {'c': 3 + late + v3.c, 'a': 'R' || v3.a} END]) AS b2,
      list_min([{'c': 4 + v3.c, 'a': 'D' || v3.a}, CASE WHEN NOT must AND letter = 'a' THEN {'c': late + v4.c, 'a': 'K' || v4.a} END,
                CASE WHEN NOT must THEN {'c': 3 + late + v4.c, 'a': 'R' || v4.a} END]) AS b3,
      list_min([{'c': 4 + v4.c, 'a': 'D' || v4.a}, CASE WHEN NOT must AND letter = 'u' THEN {'c': late + v3.c, 'a': 'K' || v3.a} END,
                CASE WHEN NOT must THEN {'c': 3 + late + v3.c, 'a': 'R' || v3.a} END]) AS b4
    FROM best p JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.behind = p.done))
), solved AS (
  SELECT b.conv_id, b.v1.c AS cost, b.v1.a AS audit FROM best b JOIN (SELECT conv_id, max(i) AS n FROM symbols GROUP BY 1) s
    ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.done = s.n
), walked AS (
  SELECT conv_id, audit, 1 AS pos, CAST(1 AS BIGINT) AS i, 1 AS g, '' AS said FROM solved
  UNION ALL
  SELECT w.conv_id, audit, pos + 1, CASE WHEN e = 'I' THEN w.i ELSE w.i + 1 END, CASE WHEN e = 'D' THEN g ELSE to_ END,
         CASE WHEN e = 'D' THEN said ELSE said || CASE WHEN said = '' THEN '' ELSE chr(10) END ||
           CASE WHEN e = 'K' THEN s.role ELSE CASE WHEN to_ = 3 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE s.text END END
  FROM (SELECT *, substr(audit, pos, 1) AS e FROM walked WHERE pos <= length(audit)) w
  LEFT JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i,
  LATERAL (SELECT CASE WHEN e = 'K' AND letter = 's' THEN 2 WHEN g = 3 THEN 4 ELSE 3 END AS to_) x
), repaired AS (SELECT conv_id, said FROM walked WHERE pos > length(audit)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
}
