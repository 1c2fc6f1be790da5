"""SQL beside those queries that SQL can express: plain, without signatures, samples or indexes."""

from __future__ import annotations

from changeguard.llm.contamination import OVERLAP, TELLING
from changeguard.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES
from changeguard.llm.line_dedup import LEAST_DOCS, LEAST_KEY
from changeguard.llm.quality_rules import HOST_SHARE, LEFT_SHARE, MIN_DOCS, MIN_WORDS

#: Documents with a row number, as ids and texts may repeat.
_DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents)"
_SPLIT = r"list_filter(string_split_regex({0}, '[\x09-\x0d\x20]+'), lambda x: x <> '')"
_PLAIN = r"list_filter(string_split_regex(lower({0}), '[\x00-/:-@\[-`{{-\x7f]+'), lambda x: x <> '')"


def _shingles(words: str, size: str) -> str:
    """List of the runs of ``size`` words; a shorter list is one run."""
    return f"list_transform(range(1, greatest(len({words}) - {size} + 1, 1) + 1), lambda i: array_to_string({words}[i : i + {size} - 1], ' '))"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSES = f"""
WITH t0(license, body) AS (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in TEMPLATES)}),
t1 AS (SELECT license, {_PLAIN.format('body')} AS w FROM t0),
t2 AS (SELECT license, least(len(w), {SHINGLE}) AS q, list_distinct({_shingles('w', f'least(len(w), {SHINGLE})')}) AS sh FROM t1),
t3 AS (SELECT license, q, len(sh) AS m, greatest(len(sh) // 4, 1) AS step, sh FROM t2),
t4 AS (SELECT license, q, m, step, m + step - 1 AS length, unnest(sh) AS s FROM t3),
e AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN.format('text')} AS w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
f AS (SELECT rid, doc_id, q, unnest(range(0, len(w) - q + 1)) AS i, w FROM e CROSS JOIN (SELECT DISTINCT q FROM t3) WHERE len(w) >= q),
g AS (SELECT rid, doc_id, q, i, array_to_string(w[i + 1 : i + q], ' ') AS s FROM f),
hits AS (SELECT rid, doc_id, license, m, s, unnest(generate_series((greatest(i - length + 1, 0) + step - 1) // step * step, i // step * step, step)) AS a
         FROM g JOIN t4 USING (q, s)),
windows AS (SELECT rid, doc_id, license, m, a, count(DISTINCT s) AS n FROM hits GROUP BY ALL HAVING count(DISTINCT s) >= {CONTAINMENT} * m)
SELECT any_value(doc_id) AS doc_id, license, CAST(max(n) AS INT) AS n_shared, CAST(any_value(m) AS INT) AS n_shingles,
       CAST(min(a) AS INT) AS first_word, CAST(count(*) AS INT) AS n_windows
FROM windows GROUP BY rid, license"""

_REPEATS = f"""
WITH {_DOCS},
h AS (SELECT rid, doc_id, hex(encode(body)) AS x, octet_length(encode(body)) AS n FROM d),
p AS (SELECT rid, unnest(range(0, n - 399)) AS i, x FROM h WHERE n >= 400),
w AS (SELECT rid, i, md5(substr(x, 2 * i + 1, 800)) AS name FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY name) AS c FROM w) WHERE c > 1),
b AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT rid, i, sum(first) OVER (PARTITION BY rid ORDER BY i) AS part FROM b),
spans AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY rid, part),
edges AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT rid, x, n, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS rest
         FROM edges JOIN h USING (rid) GROUP BY rid, x, n)
SELECT doc_id, h.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (rid)"""

_RULES = rf"""
WITH {_DOCS},
c AS (SELECT *, {_SPLIT.format('body')} AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0d\x20]')) AS ls FROM d),
grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM c WHERE len(w) >= 3),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS k FROM grams) WHERE k > 1),
again AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
base AS (SELECT rid, doc_id, source, body, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                coalesce(n, 0) AS n_repeat_words FROM c LEFT JOIN again USING (rid)),
lines AS (SELECT rid, coalesce(source, chr(0)) AS host, body,
                 unnest(list_transform(string_split(regexp_replace(regexp_replace(lower(body), '[1-9]', '0', 'g'), '[ \t\x0b\f\r]{{2,}}|[\t\x0b\f\r]', ' ', 'g'), chr(10)), lambda x: trim(x))) AS line FROM d),
held AS (SELECT host, line, count(DISTINCT md5(body)) AS k FROM lines WHERE line <> '' GROUP BY host, line),
hosts AS (SELECT coalesce(source, chr(0)) AS host, count(DISTINCT md5(body)) AS docs FROM d GROUP BY 1),
hot AS (SELECT host, line FROM held JOIN hosts USING (host) WHERE k > {MIN_DOCS} AND k > docs * {HOST_SHARE}),
gone AS (SELECT rid, sum(length(line) - length(replace(line, ' ', '')) + 1) AS k FROM lines JOIN hot USING (host, line) GROUP BY rid),
judged AS (SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_words - coalesce(k, 0) AS BIGINT) AS n_left_words
           FROM base LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words,
       NOT base_failed AND n_left_words >= n_words * {LEFT_SHARE} AS kept FROM judged"""

_NEAR = f"""
WITH RECURSIVE {_DOCS},
c AS (SELECT rid, doc_id, {_SPLIT.format("translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM d),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct({_shingles('w', '5')}) END AS sh FROM c),
e AS (SELECT rid, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.rid AS a, b.rid AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.rid <> b.rid
          GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a AS rid, min(doc_id) AS other FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM s LEFT JOIN least_id USING (rid)"""

_ITEMS = rf"""
WITH {_DOCS},
i0 AS (SELECT item_id, text, regexp_extract(regexp_replace(text, '\s+$', ''), '(?s)^(.*(?:[.?!]\s|\n))', 1) AS head FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT row_number() OVER () AS item, item_id, {_PLAIN.format('text')} AS w, len({_PLAIN.format("CASE WHEN head = '' THEN text ELSE head END")}) AS head FROM i0),
i2 AS (SELECT item, item_id, least(len(w), 5) AS q, head, {_shingles('w', 'least(len(w), 5)')} AS sh FROM i1 WHERE len(w) > 0),
i3 AS (SELECT item, item_id, q, greatest(0, least(len(sh), head - q + 1)) AS question, len(sh) AS m, unnest(range(1, len(sh) + 1)) AS i, unnest(sh) AS s FROM i2),
p1 AS (SELECT item, 1 AS part, w[1 : head] AS pw FROM i1 WHERE head > 0 UNION ALL SELECT item, 2, w[head + 1 :] FROM i1 WHERE len(w) > head),
p2 AS (SELECT item, part, len(pw) AS n, least(len(pw), 5) AS q, {_shingles('pw', 'least(len(pw), 5)')} AS sh FROM p1),
p3 AS (SELECT item, part, n, q, len(sh) AS m, unnest(sh) AS s FROM p2),
c AS (SELECT rid, doc_id, {_PLAIN.format('body')} AS w FROM d),
f AS (SELECT rid, doc_id, q, unnest(list_distinct({_shingles('w', 'q')})) AS s FROM c CROSS JOIN (SELECT q FROM i2 UNION SELECT q FROM p2) WHERE len(w) >= q),
whole AS (SELECT rid, item, count_if(i <= question) AS asked, count_if(i > question) AS told, count(*) >= {OVERLAP} * any_value(m) AS held FROM f JOIN i3 USING (q, s) GROUP BY rid, item),
parts AS (SELECT rid, item, part, any_value(n) AS n FROM f JOIN p3 USING (q, s) GROUP BY rid, item, part HAVING count(*) >= {OVERLAP} * any_value(m)),
leaks AS (SELECT rid, item FROM whole WHERE held
          UNION SELECT a.rid, a.item FROM parts AS a LEFT JOIN parts AS b ON b.rid = a.rid AND b.item = a.item AND b.part = 2 WHERE a.part = 1 AND (a.n >= {TELLING} OR b.rid IS NOT NULL)),
sizes AS (SELECT item, item_id, any_value(question) AS question, any_value(m) AS m FROM i3 GROUP BY item, item_id)
SELECT doc_id, item_id, CAST(coalesce(asked, 0) AS INT) AS question_shared, CAST(question AS INT) AS question_shingles,
       CAST(coalesce(told, 0) AS INT) AS answer_shared, CAST(m - question AS INT) AS answer_shingles
FROM leaks JOIN c USING (rid) JOIN sizes USING (item) LEFT JOIN whole USING (rid, item)"""

_TABLE = """list_transform(range(256), lambda i: list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END))"""


def _jump(shards: int) -> str:
    """The jump hash with its loop written out; ``shards`` steps are enough."""
    up = "((key * 2862933555777941757 + 1) % 18446744073709551616)"
    step = f"""SELECT * EXCLUDE (key, b, j), CASE WHEN j >= {shards} THEN key ELSE {up} END AS key, CASE WHEN j >= {shards} THEN b ELSE j END AS b,
        CASE WHEN j >= {shards} THEN j ELSE floor((j + 1) * (2147483648::DOUBLE / ({up} // 8589934592 + 1)))::BIGINT END AS j FROM k"""
    return ",\n".join(f"k{n + 1} AS ({step}{n})" for n in range(shards))


_SHARDS = f"""
WITH tab AS (SELECT {_TABLE} AS tab),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS body, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k0 AS (SELECT doc_id, h, octet_length(body) + 1 AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc,
       ('0x' || substr(h, 1, 8))::HUGEINT * 4294967296 + ('0x' || substr(h, 9, 8))::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM d, tab),
{_jump(8)}
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(b AS INT) AS shard,
       row_number() OVER (PARTITION BY b ORDER BY h, crc, size) - 1 AS slot, CAST(CASE WHEN j = 8 THEN 8 ELSE b END AS INT) AS grown_shard FROM k8"""

_TRIE = rf"""
WITH tab AS (SELECT {_TABLE} AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                 lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, pos) AS turns FROM r GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s USING (conv_id)),
m AS (SELECT conv_id, d, turns[1 : d] AS prefix, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM q)),
n AS (SELECT d, prefix, min(conv_id) AS least, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM m GROUP BY d, prefix),
up AS (SELECT n.d, n.prefix, n.least, k, n_convs, unnest(range(0, n.d + 1)) AS a FROM n LEFT JOIN (SELECT prefix[1 : d - 1] AS prefix, d - 1 AS d, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL) USING (d, prefix)),
sums AS (SELECT a AS d, prefix[1 : a] AS prefix, CAST(count_if(k IS NULL) AS BIGINT) AS n_leaves,
                sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END) AS saved FROM up GROUP BY ALL),
kids AS (SELECT least, d, prefix, coalesce(k, 0) AS k FROM up WHERE a = d)
SELECT n.least AS conv_id, n.d AS depth, p.least AS parent_conv_id, n.n_convs, kids.k AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sums USING (d, prefix) JOIN kids USING (d, prefix) LEFT JOIN n AS p ON p.d = n.d - 1 AND p.prefix = n.prefix[1 : n.d - 1]"""

_HARD = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_sum(list_transform(list_zip(a.x, o.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v AS a JOIN v AS o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

_LINES = rf"""
WITH {_DOCS},
s AS (SELECT rid, doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {LEAST_KEY} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
g AS (SELECT k.*, first IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY rid, doc_id"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _LICENSES,
    "op4_repeated_strings": _REPEATS,
    "op5_quality_rules": _RULES,
    "op6_minhash_near_dups": _NEAR,
    "op7_bm25_decontamination": _ITEMS,
    "op10_jump_shards": _SHARDS,
    "op11_conversation_trie": _TRIE,
    "op12_hard_negatives": _HARD,
    "op13_line_dedup": _LINES,
}
