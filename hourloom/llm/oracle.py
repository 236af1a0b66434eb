"""DuckDB SQL for the text queries that SQL can express."""

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH named AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, row_number() OVER () AS r
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               r = first_value(r) OVER w AS kept, sha256(body) AS text_sha256
        FROM named WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id, r)
    """,
    "op9_mix": r"""
        WITH RECURSIVE base AS (
            SELECT doc_id, coalesce(text, '') AS text, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), keyed AS (
            SELECT *, (('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(text))[1:13])::BIGINT + 0.5) / 4503599627370496.0 AS u,
                   greatest(pow(1 - len(regexp_extract_all(text, '[^\p{L}\s]')) / greatest(length(text), 1), 2.0), 0.01) AS w FROM base
        ), sources AS (
            SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
            FROM base GROUP BY source
        ), shared AS (
            SELECT 0 AS step, source, source_size, weight, false AS filled, 0.0::DOUBLE AS target, 1.5 * (SELECT sum(source_size) FROM sources) AS free FROM sources
            UNION ALL
            SELECT step + 1, source, source_size, weight, now_full, CASE WHEN now_full THEN 2.0 * source_size ELSE part END,
                   1.5 * (sum(source_size) OVER ()) - coalesce(sum(2.0 * source_size) FILTER (now_full) OVER (), 0)
            FROM (SELECT *, filled OR part >= 2.0 * source_size AS now_full
                  FROM (SELECT *, free * weight / sum(weight) FILTER (NOT filled) OVER () AS part FROM shared WHERE step < 40))
        ), targets AS (
            SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM shared WHERE step = 40
        ), summed AS (
            SELECT k.*, t.source_size, t.target, t.epochs,
                   sum(size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, doc_id) - size AS before
            FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 3) AS target,
               (size * (epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
    """,
    "op13_prefix_trie": r"""
        WITH turns AS (
            SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS seq FROM turns GROUP BY conv_id
        ), counted AS (
            SELECT *, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                        lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 4 AS h
            FROM own
        ), made AS (
            SELECT c.conv_id, coalesce(b.seq[1:c.h], []) || c.seq[c.h + 1:] AS seq FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), beginnings AS (
            SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM made
        ), keyed AS (
            SELECT conv_id, n, depth, array_to_string(list_transform(seq[1:depth], lambda t: t.id), '') AS path, CASE WHEN depth > 0 THEN seq[depth].words ELSE 0 END AS words
            FROM beginnings
        ), nodes AS (
            SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
            FROM keyed GROUP BY depth, path
        ), kids AS (
            SELECT depth - 1 AS depth, left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), own_sums AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, path)
        ), spread AS (
            SELECT unnest(range(0, depth + 1)) AS above, path, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM own_sums
        ), subtree AS (
            SELECT above AS depth, left(path, 64 * above) AS path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY ALL
        )
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
        FROM own_sums o JOIN subtree s ON s.depth = o.depth AND s.path = o.path
        LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.path = left(o.path, 64 * (o.depth - 1)) AND o.depth > 0
    """,
}
