"""DuckDB counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

#: Windows of 13 words, judged by the smallest doc_id that has them.
RLZ_COPIES = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM texts WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
copied AS (SELECT doc_id, s FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS place FROM copied),
listed AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
per_word AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM texts),
kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS kept, count(*) AS n
    FROM per_word p ANTI JOIN gone USING (doc_id, place) GROUP BY p.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""

#: Base32 digits are taken five bits at a time from the hexadecimal SHA-1.
WARC_RECORDS = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
bits AS (
    SELECT p.*, first_id, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101',
        '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', hex[i])]), '') AS b
    FROM p JOIN firsts USING (payload))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        16 * CAST(b[i * 5 + 1] AS INT) + 8 * CAST(b[i * 5 + 2] AS INT) + 4 * CAST(b[i * 5 + 3] AS INT)
        + 2 * CAST(b[i * 5 + 4] AS INT) + CAST(b[i * 5 + 5] AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

#: Windows of 400 bytes, as digits so that bytes can be cut.
REPEATED_BYTES = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM texts),
windows AS (
    SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS win
    FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM sized WHERE n >= 400)),
repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
starts AS (SELECT doc_id, s FROM windows SEMI JOIN repeated USING (win)),
begun AS (SELECT doc_id, s, s > coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400, -1) AS fresh FROM starts),
numbered AS (SELECT doc_id, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM begun),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, sum(b - a) AS gone, count(*) AS runs FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN runs IS NULL THEN h ELSE array_to_string(list_transform(range(0, runs + 1), lambda i: substr(h,
        CAST(2 * (CASE WHEN i = 0 THEN 0 ELSE stops[i] END) + 1 AS BIGINT),
        CAST(2 * ((CASE WHEN i = runs THEN n ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE stops[i] END)) AS BIGINT))), '') END)) AS kept_sha256
FROM sized LEFT JOIN cuts USING (doc_id)
"""

#: All pairs of anchors and rows; integer scores are exact in doubles at this size.
HARD_NEGATIVES = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def importance_draw() -> str:
    """n-grams as strings; their crc-32 a byte at a time with the usual table of 256 steps."""
    steps = ", ".join(str(_crc_step(n)) for n in range(256))
    return rf"""
WITH texts AS (
    SELECT target, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark)),
grams AS (
    SELECT target, doc_id, array_to_string(w[s:s + n - 1], ' ') AS f, count(*) AS c
    FROM (SELECT target, doc_id, w, n, unnest(range(1, len(w) + 2 - n)) AS s FROM texts, (VALUES (1), (2), (3)) AS t(n) WHERE len(w) >= n)
    GROUP BY ALL),
coded AS (
    SELECT f, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, CAST([{steps}][xor(c & 255, b) + 1] AS BIGINT))), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams))),
found AS (SELECT target, doc_id, bucket, c FROM grams JOIN coded USING (f)),
counts AS (
    SELECT bucket, CAST(coalesce(sum(c) FILTER (NOT target), 0) AS DOUBLE) AS s, CAST(coalesce(sum(c) FILTER (target), 0) AS DOUBLE) AS t
    FROM found GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain
    FROM counts),
weights AS (
    SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight
    FROM found JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM texts LEFT JOIN weights USING (doc_id) WHERE NOT target),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
