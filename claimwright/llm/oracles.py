"""SQL of the operators on words, conversation prefixes and shards, with crc32 and sequential choices spelled out."""

from __future__ import annotations

#: crc_t: the table of the checksum, by its rule.
CRC_TABLE = """
        crc_b(i, k, v) AS (
          SELECT i, 0, i FROM range(256) r(i)
          UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_b WHERE k < 8),
        crc AS (SELECT list(v ORDER BY i) AS crc_t FROM crc_b WHERE k = 8)"""


def crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, where ``crc_t`` is in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, crc_t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295)"


OP11 = rf"""
        WITH RECURSIVE {CRC_TABLE},
        r AS (
          SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
          GROUP BY 1, 2),
        h AS (SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, crc WHERE length(run) >= 7),
        w AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
        e AS (
          SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.less = b.word
          UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.less = b.word),
        b AS (SELECT word, count(*) AS n_near, arg_min(near, {{'n': -near_n, 'w': near}}) AS near, max(near_n) AS near_n FROM e GROUP BY word),
        f AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
          FROM w LEFT JOIN b USING (word)),
        p(word, so_far) AS (SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.so_far WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.so_far AS root, f.n, f.n_near, f.form_n
        FROM f JOIN p USING (word) JOIN f last ON last.word = p.so_far AND last.form IS NULL
"""


OP12 = rf"""
        WITH RECURSIVE {CRC_TABLE},
        t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
          FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
        b AS (
          SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
          UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, role, text FROM b),
        x(conv_id, d, k, words) AS (
          SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM c
          UNION ALL SELECT r.conv_id, r.d, md5(x.k || md5(role) || md5(text)), CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT)
          FROM x JOIN r ON r.conv_id = x.conv_id AND r.d = x.d + 1),
        n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM x GROUP BY d, k),
        l AS (SELECT conv_id, max(d) AS d FROM x GROUP BY conv_id),
        e AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM x JOIN l USING (conv_id, d) GROUP BY d, k),
        a AS (SELECT n.d, n.k, n.conv_id, n_convs, n.words, x.d AS up_d, x.k AS up_k FROM n JOIN x ON x.conv_id = n.conv_id AND x.d <= n.d),
        h AS (SELECT up_d AS d, up_k AS k, count(*) AS n_children FROM a WHERE d = up_d + 1 GROUP BY 1, 2),
        s AS (
          SELECT up_d AS d, up_k AS k, count(*) FILTER (WHERE h.k IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
          FROM a LEFT JOIN h ON h.d = a.d AND h.k = a.k GROUP BY up_d, up_k),
        p AS (SELECT a.d, a.k, n.conv_id AS parent_conv_id FROM a JOIN n ON n.d = a.up_d AND n.k = a.up_k WHERE a.d = a.up_d + 1)
        SELECT n.conv_id, n.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN s USING (d, k) LEFT JOIN h USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN p USING (d, k)
"""


def dealt(sizes: str, before: str, shards: int, out: str) -> str:
    """CTEs that deal slots (rn, slot, b, here) to shards one after the other, by falling bytes; ``here`` is null in the first version."""
    load = "list_min(loads)"
    return f"""
        {out}_o AS (SELECT row_number() OVER (ORDER BY bytes DESC, slot) AS rn, slot, bytes AS b, {before} AS here FROM {sizes}),
        {out}_t AS (SELECT CAST(sum(b) AS BIGINT) AS total FROM {out}_o),
        {out}_i AS (SELECT list(l ORDER BY k) AS loads FROM (SELECT k, CAST(coalesce(sum(b), 0) AS BIGINT) AS l FROM range({shards}) r(k) LEFT JOIN {out}_o ON here = k GROUP BY k)),
        {out}(rn, slot, shard, loads) AS (
          SELECT CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(-1 AS INTEGER), loads FROM {out}_i
          UNION ALL
          SELECT o.rn, o.slot, x.t, [CASE WHEN k - 1 = x.t AND (o.here IS NULL OR x.t <> o.here) THEN s.loads[k] + o.b WHEN k - 1 = o.here AND x.t <> o.here THEN s.loads[k] - o.b ELSE s.loads[k] END FOR k IN range(1, {shards + 1})]
          FROM {out} s JOIN {out}_o o ON o.rn = s.rn + 1, {out}_t,
          LATERAL (SELECT CAST(CASE WHEN o.here IS NOT NULL AND (s.loads[o.here + 1] - o.b) * {shards} < total THEN o.here ELSE list_position(s.loads, {load}) - 1 END AS INTEGER) AS t) x)"""


OP13 = f"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text_crc32, size) - 1 AS copy FROM d),
        v AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_crc32 || '|' || size || '|' || copy), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS vslot FROM c),
        z AS (SELECT vslot AS slot, CAST(sum(size) AS BIGINT) AS bytes FROM v GROUP BY 1),
        {dealt("z", "CAST(NULL AS INTEGER)", 8, "one")},
        y AS (SELECT z.slot, z.bytes, one.shard FROM z JOIN one USING (slot)),
        {dealt("y", "shard", 9, "two")}
        SELECT doc_id, size, text_crc32, 'bytes' AS law, one.shard,
               row_number() OVER (PARTITION BY one.shard ORDER BY v.vslot, doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS slot,
               CAST(NULL AS INTEGER) AS grown_shard, v.vslot, 1 AS map_version, two.shard AS next_shard
        FROM v JOIN one ON one.slot = v.vslot JOIN two ON two.slot = v.vslot
"""
