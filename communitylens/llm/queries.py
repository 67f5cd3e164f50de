"""The registered queries of this package, opN_<name>, and their SQL.

Each query is thin: it applies one operator to its whole table and derives
the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communitylens.llm import (
    byte_bpe,
    context_tree,
    divergence,
    exact_dedup,
    fingerprints,
    html_text,
    mixing,
    ngram_join,
    quality_model,
    token_counts,
    turn_repair,
    url_rules,
    warc,
)
from communitylens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@query()
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and number of links."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    held_out = quality_model.crc_remainder(F.col("row.doc_id"), 5) == 0
    return quality_model.score(docs.select("doc_id", "text"), model).select(
        "row.doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@query()
def op2_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability and the unigram one beside it."""
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


@query("""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS w
  FROM documents),
r AS (
  SELECT doc_id, sha256(w) AS text_sha256, w, length(t) AS n_chars, row_number() OVER (
           PARTITION BY w ORDER BY length(t) DESC, doc_id NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY w) AS group_size FROM n),
k AS (SELECT w, doc_id AS keep_id, n_chars AS keep_chars FROM r WHERE rn = 1)
SELECT r.doc_id, k.keep_id, r.group_size,
       (r.doc_id IS NOT DISTINCT FROM k.keep_id AND r.n_chars = k.keep_chars) AS kept, r.text_sha256
FROM r JOIN k USING (w)""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return (exact_dedup.decisions(table(spark, sf_dir, "documents"), digest_all=True)
            .select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's tokens, counted in flat token files of all texts."""
    import public_tokenizers
    ranks = byte_bpe.read_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, by_split=True)


@query()
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next one's."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN k USING (h)""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as archived and read back, in order of the merged index."""
    return (warc.capture_histories(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded with the 50k byte-level ranks."""
    import public_tokenizers
    ranks = byte_bpe.read_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def _mixing_sql() -> str:
    """The mix in SQL: the same passes over the sources, unrolled (a pass
    after the last one that caps a source changes nothing)."""
    weight = "(CASE (source_rank - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE"
    rates = ["r0 AS (SELECT 0.0::DOUBLE AS rate)"]
    for i in range(1, 13):
        rates.append(f"""r{i} AS (SELECT ((SELECT sum(source_size)::DOUBLE FROM s)
          - coalesce(sum(CASE WHEN most < p.rate * weight THEN most END), 0.0))
          / nullif(sum(CASE WHEN NOT most < p.rate * weight THEN weight END), 0.0) AS rate
          FROM s, r{i - 1} p GROUP BY p.rate)""")
    primes = ", ".join(map(str, mixing.PRIMES))
    depth = 4  # levels, enough for blocks of NESTED ** 3 words; levels after that of single words change nothing
    levels, choices = [], []
    for i in range(depth):
        keep = f"CASE WHEN length > 1 THEN least(greatest(coalesce(blocks, 0) - 1, 0), floor(miss / length)) ELSE coalesce(blocks, 0) END * length"
        levels.append(f"""n{i} AS (SELECT sum(miss) AS total, count(*) AS m, any_value(length) AS length FROM a{i}),
q{i} AS (SELECT source_rank, miss / (2 * k + 1) AS quotient
      FROM (SELECT source_rank, miss, unnest(range(0, ceil(miss * ((round(total / n{i}.length) + m / 2) / total) + 0.5)::BIGINT + 1)) AS k
            FROM a{i}, n{i} WHERE miss > 0 AND length0 > 1)),
w{i} AS (SELECT source_rank, row_number() OVER (ORDER BY quotient DESC, source_rank) AS rn FROM q{i}),
v{i} AS (SELECT source_rank, count(*) AS blocks FROM w{i}, n{i} WHERE rn <= round(total / length) GROUP BY source_rank),
a{i + 1} AS (SELECT a.* REPLACE (quota + ({keep})::BIGINT AS quota, target - quota - ({keep})::BIGINT AS miss,
        ceil(length / {mixing.NESTED}.0)::BIGINT AS length), length AS length0 FROM (SELECT * EXCLUDE (length0) FROM a{i}) a LEFT JOIN v{i} USING (source_rank))""")
        choices.append(f"""t{i} AS (SELECT *, greatest(ceil(size / len_::DOUBLE), 1)::BIGINT AS n_,
        ('0x' || substr(md5('{mixing.SEED}|' || source_rank::VARCHAR || '|{i}'), 1, 7))::BIGINT AS shift_ FROM s{i}_),
u{i} AS (SELECT *, ([{primes}])[shift_ % {len(mixing.PRIMES)} + 1] AS mult_, n_ * len_ - size AS short_ FROM t{i}),
y{i} AS (SELECT *, ((n_ - 1) * mult_ + shift_) % n_ AS last_ FROM u{i}),
z{i} AS (SELECT *, CASE WHEN last_ < (rest + short_) // len_ THEN (rest + short_) // len_ ELSE rest // len_ END AS k_ FROM y{i}),
o{i} AS (SELECT *, coalesce(list_filter(range(0, n_), lambda j: (j * mult_ + shift_) % n_ = k_)[1], 0) AS next_,
         struct_pack(base := base, size := size, length := len_, n := n_, k := k_, mult := mult_, shift := shift_) AS l{i} FROM z{i}),
s{i + 1}_ AS (SELECT * EXCLUDE (n_, shift_, mult_, short_, last_, k_, next_)
         REPLACE (base + next_ * len_ AS base, greatest(least(len_, size - next_ * len_), 0) AS size,
                  rest - (k_ * len_ - CASE WHEN last_ < k_ THEN short_ ELSE 0 END) AS rest,
                  ceil(len_ / {mixing.NESTED}.0)::BIGINT AS len_) FROM o{i})""")
    levels, choices = ",\n".join(levels), ",\n".join(choices)
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
       FROM d GROUP BY source),
s AS (SELECT *, {weight} AS weight, (source_size * {float(mixing.MAX_REPEATS)})::DOUBLE AS most FROM s0),
{", ".join(rates)},
t AS (SELECT s.*, least(most, r12.rate * weight) AS target FROM s, r12),
g AS (SELECT greatest(1, ceil(sum(source_size) / greatest({mixing.MIX_BLOCKS}, {mixing.BLOCKS_PER_SOURCE} * count(*))::DOUBLE))::BIGINT
        AS block, sum(target) AS total, count(*) AS m FROM t),
a0 AS (SELECT t.*, block AS length, 2::BIGINT AS length0, 0::BIGINT AS quota, target AS miss FROM t, g),
{levels},
p1 AS (SELECT *, least(quota, source_size * {mixing.MAX_REPEATS}) AS q FROM a{depth}),
s0_ AS (SELECT *, CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END AS passes, 0::BIGINT AS base, source_size AS size,
          q - source_size * (CASE WHEN source_size > 0 THEN q // source_size ELSE 0 END) AS rest, block AS len_ FROM p1, g),
{choices},
p AS (SELECT *, [{", ".join(f"l{i}" for i in range(depth))}] AS levels FROM s{depth}_),
x AS (SELECT d.doc_id, d.size AS words, p.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS LAST, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, words AS size, source_size, target, (passes * words + list_sum(list_transform(levels, lambda v:
  CASE WHEN v.k > 0 AND least(a + words, v.base + v.size) > greatest(a, v.base) THEN
    list_sum(list_transform(range((greatest(a, v.base) - v.base) // v.length, (least(a + words, v.base + v.size) - 1 - v.base) // v.length + 1),
      lambda j: CASE WHEN (j * v.mult + v.shift) % v.n < v.k
        THEN least(a + words, v.base + v.size, v.base + (j + 1) * v.length) - greatest(a, v.base, v.base + j * v.length) ELSE 0 END))
  ELSE 0 END)))::BIGINT AS taken
FROM x"""


@query(_mixing_sql())
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def _url_sql() -> str:
    """The stated rules, then all token combinations of the labelled URLs
    counted by subset, kept by support and confidence."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN "
            for h, p, _ in sorted(url_rules.STATED, key=lambda r: (-len(r[0] + r[1]), r))]
    by_length = sorted(url_rules.STATED, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"{f}'{h}{p}'" for f, (h, p, _) in zip(fits, by_length))
    stated = " ".join(f"{f}'{v}'" for f, (_, _, v) in zip(fits, by_length))
    part = lambda xs, mark: (f"list_transform(list_filter({xs}, lambda x: x <> ''), "  # noqa: E731
                             f"lambda x: '{mark}' || regexp_replace(x, '[0-9]+', '0', 'g'))")
    return f"""
WITH u AS (SELECT page_id, url, coalesce({rest}, '') AS rest FROM pages),
v AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM u),
w AS (SELECT *, CASE {rule} END AS rule, CASE {stated} END AS stated, list_sort(list_distinct(
        {part("string_split(host, '.')", 'h:')} || {part("string_split(path, '/')", 'p:')}
        || {part("list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*'))", 'q:')})) AS tokens FROM v),
lab AS (SELECT row_number() OVER () AS id, tokens, stated AS verdict FROM w WHERE stated IS NOT NULL AND url IS NOT NULL),
size AS (SELECT count(*) AS n FROM lab),
tok AS (SELECT id, unnest(tokens) AS token FROM lab),
seen AS (SELECT token, list(id ORDER BY id) AS ids FROM tok GROUP BY token HAVING count(*) >= {url_rules.MIN_SUPPORT} * (SELECT n FROM size)),
item AS (SELECT min(token) AS token FROM seen GROUP BY ids),
basket AS (SELECT lab.id, any_value(verdict) AS verdict, list_sort(list(token)) AS items
           FROM lab JOIN tok USING (id) JOIN item USING (token) GROUP BY lab.id),
sub AS (SELECT id, verdict, list_where(items, list_transform(range(0, len(items)), lambda k: (mask >> k) & 1 = 1)) AS s
        FROM (SELECT id, verdict, items, unnest(range(1, (1 << len(items))::BIGINT)) AS mask FROM basket)),
tally AS (SELECT s, verdict, count(*) AS hits FROM sub GROUP BY ALL),
r AS (SELECT s, verdict, hits, hits / total AS confidence FROM (SELECT *, sum(hits) OVER (PARTITION BY s) AS total FROM tally), size
      WHERE hits >= ceil({url_rules.MIN_SUPPORT} * n) AND hits / total >= {url_rules.MIN_CONFIDENCE}),
best AS (SELECT url, arg_min(r.verdict, struct_pack(c := -confidence, b := -hits, k := len(s), s := s, v := r.verdict)) AS mined
         FROM (SELECT DISTINCT url, tokens FROM w WHERE stated IS NULL) o JOIN r ON list_has_all(tokens, s) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(stated, mined, '{url_rules.DEFAULT}') AS verdict FROM w LEFT JOIN best USING (url)"""


@query(_url_sql())
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the stated rules, else by mined ones."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "row.page_id", "host", "path", "rule", "verdict")


@query(f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source
           FROM documents),
x AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
        '{url_rules.UPPER}', '{url_rules.LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM x GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM x JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(gn.n, 0) + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allp AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
apart AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (SELECT * FROM allp UNION ALL SELECT * FROM apart) QUALIFY part = 'pair' OR rank <= 10""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its own terms."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _repair_sql() -> str:
    """Damage, faults and reports; then, row by row, the cheapest edits so far
    for each state of the grammar (a cost and audit that sort as one string)."""
    crc = ("list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT), "
           "lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
           "lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))")
    return f"""
WITH RECURSIVE o AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, (xor({crc}, 4294967295) % 20) AS fate FROM o),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(0, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
e AS (SELECT *, rtrim(text, ' \t\n\v\f\r') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS i FROM (SELECT conv_id, turn, role, copy, text FROM d)),
a AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
        left(role, 1) || coalesce(lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), '') AS pair,
        i = max(i) OVER (PARTITION BY conv_id) AS final FROM e),
b AS (SELECT *, NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS broken FROM a),
rep AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
          count(*) FILTER (dup) AS duplicate, count(*) FILTER (broken) AS truncated,
          count(*) FILTER (NOT final AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM b GROUP BY conv_id),
st AS (SELECT * FROM (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) t(state, nxt)),
ins AS (SELECT state AS p, 0 AS k, state AS q FROM st UNION ALL SELECT state, 1, nxt FROM st),
nm AS (SELECT * FROM (VALUES ('u', 'user'), ('a', 'assistant')) t(l, name)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, '000000' AS best, '' AS lines FROM rep
  UNION ALL
  SELECT conv_id, i, state, min(best), arg_min(lines, best) FROM (
    SELECT dp.conv_id, b.i, dp.state, lpad((left(best, 6)::INT + 2)::VARCHAR, 6, '0') || substr(best, 7) || 'D' AS best, lines
    FROM dp JOIN b ON dp.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = dp.i + 1
    UNION ALL
    SELECT dp.conv_id, b.i, t.to_state, lpad((left(best, 6)::INT + 5 * ins.k + t.cost + CASE WHEN broken THEN 5 ELSE 0 END)::VARCHAR, 6, '0')
             || substr(best, 7) || repeat('I', ins.k) || t.edit,
           lines || CASE WHEN ins.k = 1 THEN chr(10) || (SELECT name FROM nm WHERE l = ins.q) || ':' ELSE '' END
             || chr(10) || CASE WHEN t.edit = 'K' THEN role ELSE (SELECT name FROM nm WHERE l = t.to_state) END || ':' || text
    FROM dp JOIN b ON dp.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = dp.i + 1 AND NOT blank AND NOT dup
    JOIN ins ON ins.p = dp.state JOIN st ON st.state = ins.q,
    LATERAL (SELECT 'K' AS edit, left(role, 1) AS to_state, 0 AS cost WHERE left(role, 1) = st.nxt OR (left(role, 1) = 's' AND st.state = '0')
             UNION ALL SELECT 'R', st.nxt, 1 WHERE left(role, 1) <> st.nxt) t) z GROUP BY conv_id, i, state),
fin AS (SELECT dp.conv_id, lpad((left(best, 6)::INT + CASE WHEN state = 'u' THEN 5 ELSE 0 END)::VARCHAR, 6, '0') || substr(best, 7)
               || CASE WHEN state = 'u' THEN 'I' ELSE '' END AS best, lines || CASE WHEN state = 'u' THEN chr(10) || 'assistant:' ELSE '' END AS lines
        FROM dp JOIN rep ON dp.conv_id IS NOT DISTINCT FROM rep.conv_id AND dp.i = rep.n WHERE state <> 's'),
res AS (SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM fin GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 6)::BIGINT, 0) AS cost,
  coalesce(substr(best, 7), '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rep ON c.conv_id IS NOT DISTINCT FROM rep.conv_id
LEFT JOIN res ON c.conv_id IS NOT DISTINCT FROM res.conv_id"""


@query(_repair_sql())
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and repair."""
    turns = turn_repair.read_turns(table(spark, sf_dir, "conversations"))
    out = turn_repair.repair(turn_repair.damage(turns), convs=turns)
    return out.withColumnRenamed("conv", "conv_id")
