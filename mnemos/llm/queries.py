"""The registered queries of this subpackage."""

from mnemos.llm.byte_bpe import op10_byte_bpe
from mnemos.llm.decontamination import op3_decontamination
from mnemos.llm.divergence import op13_source_divergence
from mnemos.llm.exact_dedup import op7_exact_dedup
from mnemos.llm.language_id import op8_language_id
from mnemos.llm.line_dedup import op2_line_dedup
from mnemos.llm.near_dedup import op1_near_dedup
from mnemos.llm.prefix_trie import op11_prefix_trie
from mnemos.llm.secrets import op6_secrets
from mnemos.llm.sharding import BUCKETS, op5_sharding
from mnemos.llm.token_counts import op9_token_counts
from mnemos.llm.token_files import op4_token_files
from mnemos.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
}


def _words(table: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT *, regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}"


def _crc_table() -> str:
    """Common tables that end in crc_table (t), the 256 remainders of CRC-32, by eight steps for each byte."""
    rows = ["c0 AS (SELECT unnest(range(0, 256)) AS n, unnest(range(0, 256)) AS c)"]
    rows += [f"c{k + 1} AS (SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})" for k in range(8)]
    return ", ".join([*rows, "crc_table AS (SELECT list(c ORDER BY n) AS t FROM c8)"])


def _least_shard(shards: int) -> str:
    return f"""list_min(list_transform(range(0, {shards}), lambda j: struct_pack(
        s := -ln((CAST(words[j + 1] AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)), shard := CAST(j AS INTEGER)))).shard"""


#: Lines by place; distinct ones with their first place; those one edit from an earlier one, which share a half with it.
_LINES = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, pos, line, length(line) AS n, doc_id * 10000000 + pos AS place FROM l WHERE length(line) >= 10 OR regexp_matches(line, '\S')),
    d AS (SELECT line, n, min(place) AS first FROM c GROUP BY line, n),
    k AS (SELECT line, first, longer, n - longer AS m, side, CASE side WHEN 0 THEN substr(line, 1, (n - longer) // 2) ELSE substr(line, CAST(n - (n - longer) // 2 + 1 AS BIGINT)) END AS half
          FROM d, (VALUES (0), (1)) a(longer), (VALUES (0), (1)) b(side) WHERE n >= 10),
    e AS (SELECT DISTINCT x.line AS a, x.first AS fa, y.line AS b, y.first AS fb, x.m, y.longer FROM k x JOIN k y ON x.m = y.m AND x.side = y.side AND x.half = y.half AND x.longer = 0 AND x.line <> y.line),
    near AS (SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS line FROM e WHERE CASE longer
        WHEN 0 THEN len(list_filter(range(1, m + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
        ELSE len(list_filter(range(1, m + 2), lambda i: concat(substr(b, 1, i - 1), substr(b, i + 1)) = a)) > 0 END),
    gone AS (SELECT doc_id, pos FROM c JOIN d USING (line) WHERE place <> first OR line IN (SELECT line FROM near))
"""

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH {_LINES}, r AS (SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text, count(g.pos) AS n_dropped FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
        SELECT doc_id, r.text, coalesce(n_dropped, 0) AS n_dropped FROM documents LEFT JOIN r USING (doc_id)
    """,
    "op3_decontamination": f"""
        WITH dw AS ({_words("documents")}), bw AS ({_words("benchmark")}),
             bi AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM bw WHERE len(w) > 0),
             win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase FROM bi),
             di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win)),
             met AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM di) d JOIN win USING (n, phrase)),
             hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
             its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op5_sharding": f"""
        WITH {_crc_table()},
             d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
             c AS (SELECT doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                       list_transform(range(0, strlen(text)), lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]))) AS text_crc32
                   FROM d, crc_table),
             k AS (SELECT *, flatten(list_transform(range(0, 11), lambda g: list_transform(range(0, 4), lambda j:
                       CAST(concat('0x', substr(md5(concat(CASE WHEN doc_id IS NULL THEN 'null' ELSE concat('k', doc_id) END, ':', g)), CAST(8 * j + 1 AS INTEGER), 8)) AS BIGINT)))) AS words FROM c),
             s AS (SELECT doc_id, size, text_crc32, {_least_shard(40)} AS shard, {_least_shard(41)} AS grown_shard FROM k)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY coalesce((doc_id % {BUCKETS} + {BUCKETS}) % {BUCKETS} + text_crc32 % {BUCKETS}, 0) % {BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM s
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op11_prefix_trie": rf"""
        WITH {_crc_table()},
             t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                       list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]))) % 4 AS h FROM o, crc_table),
             c AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.base),
             p AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
             v AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM p GROUP BY depth, prefix),
             w AS (SELECT v.*, u.conv_id AS parent_conv_id, CASE WHEN v.depth = 0 THEN 0 ELSE (v.n_convs - 1) * len(regexp_extract_all(v.prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
                   FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.prefix = v.prefix[1:v.depth - 1]),
             k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM w WHERE depth > 0 GROUP BY ALL),
             x AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN k USING (conv_id, depth)),
             b AS (SELECT y.conv_id, y.depth, sum(CASE WHEN z.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(z.saved) AS saved_tokens FROM x y JOIN x z ON z.depth >= y.depth AND z.prefix[1:y.depth] = y.prefix GROUP BY ALL)
        SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM x JOIN b USING (conv_id, depth)
    """,
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
             t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
             k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
             n AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
             l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
             g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
             s AS (SELECT lang, source, term, coalesce(n.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 1)) // (total + v) AS BIGINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (lang_total + v) AS BIGINT) AS q
                   FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
             pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
             tm AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM s WHERE n > 0 AND p > q),
             tr AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tm)
        SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pr
        UNION ALL SELECT lang, source, 'term', item, value, rank FROM tr WHERE rank <= 200
    """,
}
