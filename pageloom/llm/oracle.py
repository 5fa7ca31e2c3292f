"""SQL for the registered queries that SQL can express."""

SHARDS = r"""
WITH RECURSIVE octets(value, register, step) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT value,
         CASE WHEN register & 1 = 1 THEN xor(register >> 1, 3988292384) ELSE register >> 1 END,
         step + 1
  FROM octets WHERE step < 8
), crc AS MATERIALIZED (
  SELECT list(register ORDER BY value) AS entry FROM octets WHERE step = 8
), sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), summed AS MATERIALIZED (
  SELECT doc_id, size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(range(0, size - 1),
                            lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda register, octet:
             xor(entry[(xor(register, octet) & 255) + 1], register >> 8))) AS text_crc32
  FROM sized, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
         sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place
  FROM summed
), cut AS (
  SELECT *, least(7, ((2 * start + size) * 8) // (2 * total)) AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law,
       shard::INTEGER AS shard,
       place - min(place) OVER (PARTITION BY shard) AS slot,
       NULL::INTEGER AS grown_shard
FROM cut
"""

MIX = r"""
WITH facts AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT
           AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM facts GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         (2 * source_size)::DOUBLE AS most
  FROM sources
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW filling AS (ORDER BY most / weight, source NULLS FIRST)
), targets AS (
  SELECT source, source_size,
         least(most, CASE WHEN level < most / weight
                          THEN weight * max(CASE WHEN level < most / weight THEN level END) OVER ()
                          ELSE most END) AS target
  FROM leveled
), budgets AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS copies FROM targets
), keys AS (
  SELECT source, key, sum(size) AS key_size, count(*) AS n,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before
  FROM facts GROUP BY source, key
)
SELECT f.doc_id, f.size::BIGINT AS size, b.source_size, b.target,
       (f.size * least(2, b.copies + CASE
          WHEN b.target - b.copies * b.source_size - k.before >= k.key_size THEN 1
          WHEN f.place <= floor((b.target - b.copies * b.source_size - k.before) * k.n / k.key_size + 0.5) THEN 1
          ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, key) AS place FROM facts) f
JOIN budgets b ON f.source IS NOT DISTINCT FROM b.source
JOIN keys k ON f.source IS NOT DISTINCT FROM k.source AND f.key = k.key
"""

SEARCH = r"""
WITH split AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT doc, doc_id, len(terms) AS n FROM split WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized
), counted AS MATERIALIZED (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM split) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals GROUP BY term, docs
), numbered AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, unnest(terms) AS term FROM numbered) GROUP BY ALL
), scored AS (
  SELECT item, item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (doc), totals
  GROUP BY ALL
)
SELECT item_id,
       (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

NEGATIVES = r"""
WITH clean AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, b.place AS other, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM clean a JOIN clean b ON a.place <> b.place
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.positive
                           ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor)
WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLE = {
    "op1_byte_shards": SHARDS,
    "op5_source_mix": MIX,
    "op11_ranked_search": SEARCH,
    "op12_hard_negatives": NEGATIVES,
}
