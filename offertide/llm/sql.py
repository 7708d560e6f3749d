"""Longer SQL oracles, put together from repeated pieces."""

from __future__ import annotations


def resampling_sql(buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    words = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"""
    return rf"""
        WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        dw AS (SELECT r, {words} FROM docs), bw AS (SELECT {words} FROM benchmark),
        vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        crc AS (SELECT word, h, 0 AS pos, 4294967295 AS c FROM vocabulary
            UNION ALL SELECT word, h, pos + 2, xor(tab[(xor(c, ('0x' || substr(h, pos + 1, 2))::BIGINT) & 255) + 1], c >> 8)
            FROM crc, tab WHERE pos < length(h)),
        hashed AS (SELECT word, xor(c, 4294967295) % {buckets} AS bucket FROM crc WHERE pos = length(h)),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE
                / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        weight AS (SELECT r, count(*) AS n, sum(gain) AS w FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
        scored AS (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
            (coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM docs LEFT JOIN weight USING (r)),
        drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= {least_words}
            QUALIFY rank <= {share} * (count(*) OVER ()) // 100)
        SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM scored LEFT JOIN drawn USING (r)"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        d{k} AS MATERIALIZED (SELECT x.r, x.p, arg_min(b.entry, (list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries}
                + b.entry)::BIGINT) AS entry, min(list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS d
            FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.r, x.p)""")
        if k < rounds:
            steps.append(f"""
        n{k} AS (SELECT p, entry, list(m ORDER BY pos) AS c FROM (SELECT d.p, d.entry, pos, floor(sum(val) / count(*))::BIGINT AS m
                FROM (SELECT r, p, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM x) e JOIN d{k} d ON d.r = e.r AND d.p = e.p
                GROUP BY d.p, d.entry, pos) GROUP BY p, entry),
        b{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON b.p = n.p AND b.entry = n.entry)""")
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
                [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(p)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS entry, v AS c FROM x WHERE r <= {entries}),{",".join(steps)},
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS sha FROM b{rounds}),
        coded AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
        FROM k JOIN coded USING (r), digest"""
