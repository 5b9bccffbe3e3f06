"""DuckDB SQL for the registered queries of this folder that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Links are counted for all pairs with a common shingle; components grow by whole sets of reachable documents.
NGRAM_JACCARD = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM places),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_common >= 75 * (x.n + y.n - n_common)
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.root
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""

CHAT_PREFERENCES = """
WITH src AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
newest AS (SELECT conv_id, max(turn) AS last_turn FROM src WHERE role = 'assistant' GROUP BY conv_id),
older AS (
    SELECT s.conv_id, first(s.text ORDER BY s.turn DESC, s.text DESC NULLS LAST) AS before
    FROM src s JOIN newest n ON n.conv_id = s.conv_id AND s.turn < n.last_turn WHERE s.role = 'assistant' GROUP BY s.conv_id
),
sides AS (
    SELECT conv_id, 'chosen' AS side, turn, role, text FROM src
    UNION ALL
    SELECT s.conv_id, 'rejected', s.turn, s.role, CASE WHEN s.role = 'assistant' AND s.turn = n.last_turn THEN coalesce(o.before, '') ELSE s.text END
    FROM src s LEFT JOIN newest n USING (conv_id) LEFT JOIN older o USING (conv_id)
),
turns AS (
    SELECT conv_id, side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
    FROM sides
),
prefix AS (
    SELECT c.conv_id, coalesce(min(c.n) FILTER (c.role <> r.role OR c.text <> r.text) - 1, count(*)) AS k
    FROM turns c JOIN turns r ON r.conv_id = c.conv_id AND r.n = c.n AND r.side = 'rejected' WHERE c.side = 'chosen' GROUP BY c.conv_id
),
shown AS (
    SELECT t.*, p.k, length(replace(text, '<|', '< |')) + 8 AS size,
        '<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS part
    FROM turns t JOIN prefix p USING (conv_id)
),
placed AS (SELECT *, (sum(length(part)) OVER (PARTITION BY conv_id, side, n > k ORDER BY n))::BIGINT AS stop FROM shown)
SELECT conv_id,
    coalesce(string_agg(part, '' ORDER BY n) FILTER (side = 'chosen' AND n <= k), '') AS prompt,
    any_value(k)::INTEGER AS prompt_turns,
    coalesce(string_agg(part, '' ORDER BY n) FILTER (side = 'chosen' AND n > k), '') AS chosen,
    coalesce(string_agg(part, '' ORDER BY n) FILTER (side = 'rejected' AND n > k), '') AS rejected,
    coalesce(string_agg((stop - size) || '-' || stop, ';' ORDER BY n) FILTER (side = 'chosen' AND n > k AND role = 'assistant'), '') AS chosen_spans,
    coalesce(string_agg((stop - size) || '-' || stop, ';' ORDER BY n) FILTER (side = 'rejected' AND n > k AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""

# FP-growth's rules are those of all sets of up to three tokens; a set of tokens is a sorted list.
URL_FILTER = r"""
WITH rests AS (
    SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
parts AS (
    SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
    FROM hosts
),
fixed(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM parts), fixed
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
),
raw AS (
    SELECT page_id, 'host:' AS kind, unnest(string_split(host, '.')) AS t FROM parts
    UNION ALL SELECT page_id, 'path:', unnest(string_split_regex(path, '[/._-]')) FROM parts
    UNION ALL SELECT page_id, 'query:', unnest(string_split(regexp_replace(regexp_extract(url, '\?([^#]*)', 1), '=[^&]*', '', 'g'), '&')) FROM parts
),
tokens AS MATERIALIZED (SELECT DISTINCT page_id, kind || CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' ELSE t END AS item FROM raw WHERE t <> ''),
labelled AS MATERIALIZED (SELECT page_id, item, verdict FROM tokens JOIN fits USING (page_id)),
total AS (SELECT count(DISTINCT page_id) AS n FROM labelled),
sets AS (
    SELECT page_id, verdict, [item] AS s FROM labelled
    UNION ALL SELECT a.page_id, a.verdict, [a.item, b.item] FROM labelled a JOIN labelled b ON b.page_id = a.page_id AND b.item > a.item
    UNION ALL SELECT a.page_id, a.verdict, [a.item, b.item, c.item]
    FROM labelled a JOIN labelled b ON b.page_id = a.page_id AND b.item > a.item JOIN labelled c ON c.page_id = a.page_id AND c.item > b.item
),
by_verdict AS (SELECT s, verdict, count(*) AS n_both FROM sets GROUP BY s, verdict),
with_all AS (SELECT *, sum(n_both) OVER (PARTITION BY s) AS n_set FROM by_verdict),
rules AS MATERIALIZED (
    SELECT s, verdict, n_both::DOUBLE / n_set AS confidence, n_both::DOUBLE / n AS support, md5(to_json({'antecedent': s, 'verdict': verdict})::VARCHAR) AS rule_id
    FROM with_all, total WHERE n_both >= ceil(0.002 * n) AND n_both::DOUBLE / n_set >= 0.8
),
asked AS (SELECT page_id, list(item ORDER BY item) AS items FROM tokens WHERE page_id NOT IN (SELECT page_id FROM fits) GROUP BY page_id),
matched AS (
    SELECT page_id, r.* FROM (SELECT page_id, items, unnest(items) AS item FROM asked) a JOIN rules r ON r.s[1] = a.item WHERE list_has_all(items, s)
),
best AS (
    SELECT page_id, verdict, array_to_string(s, ' ') AS mined FROM matched
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, len(s) DESC, support DESC, rule_id DESC) = 1
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, b.verdict, 'allow') AS verdict, b.mined
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN best b USING (page_id)
"""

# Every seat of every source and shard is a row, and every word of the documents.
MIXING = r"""
WITH sized AS MATERIALIZED (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS digest, ('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 512 AS shard
    FROM documents
),
shards AS MATERIALIZED (SELECT skey, source, shard, ceil(sum(size) / 8)::BIGINT AS blocks, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
sources AS (
    SELECT skey, sum(words)::BIGINT AS words, sum(blocks)::BIGINT AS blocks, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM shards GROUP BY skey, source
),
weighed AS (SELECT *, [5.0, 2.0, 1.0][pos % 3 + 1]::DOUBLE AS weight, words * 2.0::DOUBLE AS most FROM sources),
filled AS (
    SELECT weight, most, most / weight AS full_at, 1.5::DOUBLE * sum(words) OVER () AS goal,
        coalesce(sum(most) OVER (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY most / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
    FROM weighed
),
level AS (SELECT arg_min((goal - capped) / others, full_at) AS level FROM filled WHERE full_at > (goal - capped) / others),
aimed AS MATERIALIZED (
    SELECT skey, words, blocks, pos, least(most, coalesce(level * weight, most)) AS target,
        CASE WHEN words > 0 THEN least(most, coalesce(level * weight, most)) / words * blocks ELSE 0 END AS votes
    FROM weighed, level
),
seats AS (SELECT skey, pos, votes, unnest(range(0, blocks * 2)) AS k FROM aimed WHERE votes > 0),
given AS MATERIALIZED (
    SELECT skey, count(*) AS given FROM (
        SELECT skey FROM seats QUALIFY row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, pos, k) <= (SELECT round(sum(votes)) FROM aimed)
    ) GROUP BY skey
),
shard_seats AS (SELECT skey, shard, blocks, unnest(range(0, blocks * 2)) AS k FROM shards),
quotas AS MATERIALIZED (
    SELECT skey, shard, count(*) AS quota FROM (
        SELECT s.skey, s.shard, given FROM shard_seats s JOIN given USING (skey)
        QUALIFY row_number() OVER (PARTITION BY s.skey ORDER BY s.blocks::DOUBLE / (2 * k + 1) DESC, s.shard, k) <= given
    ) GROUP BY skey, shard
),
plan AS (
    SELECT skey, shard, blocks, coalesce(quota, 0) // blocks AS times, coalesce(quota, 0) % blocks AS extra,
        ('0x' || substr(md5('mix-1/' || skey || '/' || shard), 1, 12))::BIGINT % blocks AS first
    FROM shards LEFT JOIN quotas USING (skey, shard) WHERE blocks > 0
),
placed AS (
    SELECT doc_id, skey, shard, size, coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized
),
words AS (SELECT doc_id, skey, shard, unnest(range(start, start + size)) // 8 AS block FROM placed WHERE size > 0),
turned AS (SELECT doc_id, (block + first) % blocks AS b, times, extra, blocks FROM words JOIN plan USING (skey, shard)),
takes AS (SELECT doc_id, sum(times + (b + 1) * extra // blocks - b * extra // blocks)::BIGINT AS taken FROM turned GROUP BY doc_id)
SELECT d.doc_id, d.size, a.words AS source_size, a.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM sized d JOIN aimed a USING (skey) LEFT JOIN takes t USING (doc_id)
"""

LEXICAL_SEARCH = r"""
WITH given AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
),
total AS MATERIALIZED (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM given),
docs AS MATERIALIZED (SELECT r, doc_id, t, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM given, total WHERE len(t) > 0),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (
    SELECT i, item_id, term, count(*) AS often
    FROM (
        SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
    ) GROUP BY ALL
),
counts AS MATERIALIZED (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
scored AS (
    SELECT i, item_id, r, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

HARD_NEGATIVES = """
WITH base AS MATERIALIZED (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: greatest(least(floor(256 * x::DOUBLE), 8388607), -8388607)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM base a JOIN base b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""

SQL = {"op1_ngram_jaccard": NGRAM_JACCARD, "op4_chat_preferences": CHAT_PREFERENCES, "op5_url_filter": URL_FILTER, "op10_mixing": MIXING, "op11_lexical_search": LEXICAL_SEARCH, "op12_hard_negatives": HARD_NEGATIVES}
