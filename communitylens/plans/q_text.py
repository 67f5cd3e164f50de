"""Queries for class dictionaries and text features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from communitylens.functions.lexicons import GAZETTEERS, MANUAL_DICTIONARIES, TEXT_STOPWORDS
from communitylens.functions.text import normalise_post
from communitylens.operators import textfeat as tf
from communitylens.operators.windows import global_row_number
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.plans.sqlfrag import letters_tokens
from communitylens.session import scratch_path
from communitylens.sources import dictionaries as dic
from communitylens.sources import named_files as nf
from communitylens.sources.tables import Tables

PASS1_TOP, PROTO_TOP, S07_TOP = 200, 100, 100
LANGS = ("de", "en", "es", "fr")  # the four document languages of the fixture
SKIPGRAM_SHAPES = ((2, 1), (2, 2), (3, 1), (3, 2))

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in TEXT_STOPWORDS) + "]"


def _tok_sql(t: str, stop=True, min_len=1) -> str:
    s = letters_tokens(t)
    if stop:
        s = f"list_filter({s}, lambda x: NOT list_contains({_STOP}, x))"
    if min_len > 1:
        s = f"list_filter({s}, lambda x: length(x) >= {min_len})"
    return s


register("t_freq", f"""
SELECT class, word, count(*) AS freq FROM (SELECT lang AS class, unnest({_tok_sql('text', True, 2)}) AS word FROM documents) x
GROUP BY class, word""")
register("t_pass1", f"""
SELECT class, word, freq, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY freq DESC, word ASC) AS rank FROM t_freq) r
WHERE rank <= {PASS1_TOP}""")
register("t_goodness", """
SELECT p.class, p.word, (p.freq / w.fw) * (p.freq / l.fl) AS score FROM t_pass1 p
JOIN (SELECT word, sum(freq) AS fw FROM t_pass1 GROUP BY word) w ON p.word = w.word
JOIN (SELECT class, sum(freq) AS fl FROM t_pass1 GROUP BY class) l ON p.class = l.class""")
register("doc_tokens", f"""SELECT doc_id AS "user", unnest({_tok_sql('text', True, 2)}) AS word FROM documents""")


def _docs(t):
    return t.documents.select("doc_id", F.col("lang").alias("class"), "text")


def _freq(t):
    return tf.class_word_frequency(_docs(t), "class", "text")


def _pass1(t):
    return tf.top_per_class(_freq(t), "freq", PASS1_TOP)


def _doc_tokens(t):
    return tf.token_rows(t.documents, [F.col("doc_id").alias("user")], F.col("text"), "word", min_len=2)


@query("class_word_frequency", "SELECT class, word, freq, rank FROM t_pass1")
def q_t01(spark, d):
    return _pass1(Tables(spark, d)).select("class", "word", "freq", "rank")


@query("class_word_score", """
SELECT f.class, f.word, f.freq / t.total AS score FROM t_freq f JOIN (SELECT word, sum(freq) AS total FROM t_freq GROUP BY word) t
ON f.word = t.word WHERE f.freq / t.total <> 1.0""")
def q_t02(spark, d):
    return tf.class_word_score(_freq(Tables(spark, d)))


@query("class_word_goodness", "SELECT class, word, score FROM t_goodness")
def q_t03(spark, d):
    return tf.class_word_goodness(_pass1(Tables(spark, d)))


_PROTO_SQL = """
WITH f AS (SELECT class, term AS word, count(*) AS freq FROM items GROUP BY class, term),
t AS (SELECT word, sum(freq) AS total FROM f GROUP BY word),
df AS (SELECT term AS word, count(DISTINCT doc) AS df FROM items GROUP BY term),
s AS (SELECT f.class, f.word, f.freq / t.total AS score FROM f JOIN t ON f.word = t.word JOIN df ON f.word = df.word
      WHERE df.df >= 2 AND f.freq / t.total < 1.0)
SELECT class, word, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, word ASC) AS rank FROM s) r
WHERE rank <= {top}"""


@query("proto_words", "WITH items AS (SELECT lang AS class, doc_id AS doc, unnest(" + _tok_sql("text", True, 2)
       + ") AS term FROM documents), " + _PROTO_SQL.strip()[5:].replace("{top}", str(PROTO_TOP)))
def q_t04w(spark, d):
    t = Tables(spark, d)
    items = tf.token_rows(t.documents, [F.col("lang").alias("class"), F.col("doc_id").alias("doc")], F.col("text"), min_len=2)
    return tf.proto_terms(items, PROTO_TOP)


@query("proto_hashtags", """WITH items AS (
  SELECT u.label AS class, h.post_id AS doc, lower(unnest(regexp_extract_all(h.text, '\\B#\\w*[a-zA-Z]+\\w*'))) AS term
  FROM hashtag_texts h JOIN posts p ON p.id = h.post_id JOIN users u ON u.id = p.user_id
  WHERE u.label IS NOT NULL AND len(regexp_extract_all(h.text, '\\B#\\w*[a-zA-Z]+\\w*')) >= 2), """
       + _PROTO_SQL.strip()[5:].replace("{top}", str(PROTO_TOP)))
def q_t04h(spark, d):
    from communitylens.functions.text import extract_hashtags
    from communitylens.plans.q_scalar import hashtag_texts
    t = Tables(spark, d)
    h = hashtag_texts(t).withColumn("tags", extract_hashtags("text")).filter(F.size("tags") >= 2)
    lab = t.posts.select(F.col("id").alias("post_id"), "user_id").join(
        t.users.select(F.col("id").alias("user_id"), "label"), "user_id").filter(F.col("label").isNotNull())
    items = h.join(lab, "post_id").select(F.col("label").alias("class"), F.col("post_id").alias("doc"),
                                          F.explode(F.transform("tags", lambda x: F.lower(x))).alias("term"))
    return tf.proto_terms(items, PROTO_TOP)


def _match_sql(dict_view: str) -> str:
    return f"""
WITH toks AS (SELECT DISTINCT "user", word FROM doc_tokens), dv AS ({dict_view}),
m AS (SELECT t."user", dv.class AS dict, sum(dv.score) AS score_sum, count(*) AS match_count, max(dv.score) AS max_score
      FROM toks t JOIN dv ON t.word = dv.word GROUP BY t."user", dv.class)
SELECT u."user", l.dict, coalesce(m.score_sum, 0.0) AS score_sum, coalesce(m.match_count, 0) AS match_count,
       coalesce(m.max_score, 0.0) AS max_score, CAST(m.match_count IS NOT NULL AS INTEGER) AS any_match
FROM (SELECT DISTINCT "user" FROM doc_tokens) u, (SELECT DISTINCT class AS dict FROM dv) l
LEFT JOIN m ON m."user" = u."user" AND m.dict = l.dict"""


@query("dictionary_match", _match_sql("SELECT class, word, score FROM t_goodness"))
def q_t05(spark, d):
    t = Tables(spark, d)
    return tf.dictionary_match(_doc_tokens(t), tf.class_word_goodness(_pass1(t)))


_MANUAL_ROWS = [(lab, w) for lab, ws in MANUAL_DICTIONARIES.items() for w in ws]
_MANUAL_SQL = " UNION ALL ".join(f"SELECT '{lab}' AS class, '{w}' AS word, 0.0 AS score" for lab, w in _MANUAL_ROWS)


def manual_dictionary(spark):
    """The manual dictionaries as read from their list files (one word a
    line, the file's name is the dictionary's)."""
    base = scratch_path(spark, f"lists-{uuid.uuid4().hex[:12]}")
    for lab, ws in MANUAL_DICTIONARIES.items():
        dic.write_text_file(spark, f"{base}/{lab}.txt", "\n".join(ws) + "\n")
    return dic.read_word_lists(spark, base).select(F.col("list").alias("class"), "word", F.lit(0.0).alias("score"))


@query("manual_dictionary_match", _match_sql(_MANUAL_SQL))
def q_t06(spark, d):
    return tf.dictionary_match(_doc_tokens(Tables(spark, d)), manual_dictionary(spark))


def _register_t07():
    from communitylens.plans.registry import ORACLE, QUERIES
    proto = ("WITH items AS (SELECT lang AS class, doc_id AS doc, unnest(" + _tok_sql("text", True, 2)
             + ") AS term FROM documents), " + _PROTO_SQL.strip()[5:].replace("{top}", str(PROTO_TOP)))
    sql = f"""
WITH pw AS ({proto}),
n AS (SELECT "user", count(*) AS n FROM doc_tokens GROUP BY "user"),
h AS (SELECT t."user", pw.class AS dictionary, t.word, count(*) AS hits FROM doc_tokens t JOIN pw ON t.word = pw.word
      GROUP BY t."user", pw.class, t.word),
m AS (SELECT "user", dictionary, sum(hits) AS hits, count(*) AS n_entries FROM h GROUP BY "user", dictionary)
SELECT h."user", h.dictionary, h.word AS entry, h.hits / n.n AS share, 1::BIGINT AS n_entries FROM h JOIN n ON h."user" = n."user"
UNION ALL
SELECT n."user", l.dictionary, NULL, coalesce(m.hits / n.n, 0.0), coalesce(m.n_entries, 0)
FROM n CROSS JOIN (SELECT DISTINCT class AS dictionary FROM pw) l LEFT JOIN m ON m."user" = n."user" AND m.dictionary = l.dictionary"""

    def q_t07(spark, d):
        t = Tables(spark, d)
        items = tf.token_rows(t.documents, [F.col("lang").alias("class"), F.col("doc_id").alias("doc")], F.col("text"), min_len=2)
        pw = tf.proto_terms(items, PROTO_TOP).select(F.col("class").alias("dictionary"), "word")
        return tf.entry_shares(_doc_tokens(t), pw)

    QUERIES["proto_features"] = q_t07
    ORACLE["proto_features"] = sql


_register_t07()


@query("community_word_match", """
WITH x AS (SELECT post_id, text, regexp_matches(text, '#[\\w\\-]+') AS has_tag,
                  concat_ws(' ', text, array_to_string(list_transform(regexp_extract_all(text, '#[\\w\\-]+'), lambda h: substr(h, 2)), ' ')) AS full_text
           FROM hashtag_texts),
m AS (SELECT x.post_id, string_agg(DISTINCT w.community, ' ' ORDER BY w.community) AS communities FROM (
        SELECT post_id, unnest(list_filter(string_split(regexp_replace(lower(full_text), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '')) AS word
        FROM x WHERE has_tag) x JOIN word_dictionary w ON x.word = w.word GROUP BY x.post_id)
SELECT x.post_id, coalesce(m.communities, '') AS communities FROM x LEFT JOIN m ON x.post_id = m.post_id""")
def q_t08(spark, d):
    from communitylens.functions.text import append_hashtag_words, HASHTAG_HYPHEN_PATTERN
    from communitylens.functions.text import letters_only_tokens
    from communitylens.operators.joins import word_groups
    from communitylens.plans.q_joins import word_dictionary
    from communitylens.plans.q_scalar import hashtag_texts
    t = Tables(spark, d)
    h = hashtag_texts(t)
    toks = (h.filter(F.col("text").rlike(HASHTAG_HYPHEN_PATTERN))
            .select("post_id", F.explode(F.array_distinct(letters_only_tokens(append_hashtag_words("text")))).alias("word")))
    m = (word_groups(toks, word_dictionary(t.part), "post_id", "community")
         .select("post_id", F.array_join("values", " ").alias("communities")))
    return h.select("post_id").join(m, "post_id", "left").select("post_id", F.coalesce("communities", F.lit("")).alias("communities"))


def gazetteers(spark):
    """(list, word) of the gazetteers as read from their list files."""
    base = scratch_path(spark, f"gazetteers-{uuid.uuid4().hex[:12]}")
    for name, ws in GAZETTEERS.items():
        dic.write_text_file(spark, f"{base}/{name}.txt", "\n".join(ws) + "\n")
    return dic.read_word_lists(spark, base)


@query("gazetteer_match", f"""
SELECT "user", max(CAST(word IN ({', '.join(repr(w) for w in GAZETTEERS['title'])}) AS INTEGER)) AS has_title,
       max(CAST(word IN ({', '.join(repr(w) for w in GAZETTEERS['profession'])}) OR ends_with(word, 'ist') AS INTEGER)) AS has_profession
FROM doc_tokens GROUP BY "user\"""")
def q_t09(spark, d):
    return tf.gazetteer_match(_doc_tokens(Tables(spark, d)), gazetteers(spark))


@query("community_word_dictionary", "SELECT word, community FROM word_dictionary")
def q_t10(spark, d):
    from communitylens.plans.q_joins import word_dictionary
    return word_dictionary(Tables(spark, d).part)


def _n_docs(t):
    """N of the vectoriser: every document, empty ones included (a scalar
    subquery over a read of its own)."""
    return t.raw("documents").select(F.count(F.lit(1))).scalar()


def _tfidf_sql(items: str, min_df=2, max_df=0.501, max_features=10_000) -> str:
    return f"""
WITH it AS ({items}),
nd AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM it GROUP BY doc, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
top AS (SELECT term, df FROM st WHERE df >= {min_df} AND df <= (SELECT n FROM nd) * {max_df} ORDER BY cf DESC, term ASC LIMIT {max_features})
SELECT tf.doc, tf.term, tf.tf, round(tf.tf * (ln((SELECT n FROM nd) / top.df) + 1.0), 6) AS weight
FROM tf JOIN top ON tf.term = top.term"""


def _normalise_sql_text():
    from communitylens.plans.q_scalar import _normalise_sql
    return _normalise_sql("text")


@query("tfidf", _tfidf_sql(f"SELECT doc_id AS doc, unnest({_tok_sql(_normalise_sql_text(), True)}) AS term FROM documents"))
def q_t11(spark, d):
    t = Tables(spark, d)
    docs = t.documents
    items = tf.token_rows(docs, [F.col("doc_id").alias("doc")], normalise_post("text"))
    return tf.tfidf(items, _n_docs(t))


def _skip_sql(n, k):
    offs = tf.skipgram_offsets(n, k)
    toks = letters_tokens("text")
    parts = []
    for o in offs:
        last = o[-1]
        gram = " || ' ' || ".join(f"t[i + {x}]" for x in o)
        parts.append(f"list_transform(list_filter(range(1, len(t) + 1), lambda i: i + {last} <= len(t)), lambda i: {gram})")
    arr = parts[0]
    for p in parts[1:]:
        arr = f"list_concat({arr}, {p})"
    return f"SELECT doc, unnest({arr}) AS term FROM (SELECT doc_id AS doc, {toks} AS t FROM documents) x"


@query("skipgram_tfidf", " UNION ALL ".join(
    f"SELECT 'n{n}k{k}' AS shape, * FROM ({_tfidf_sql(_skip_sql(n, k))}) s{n}{k}" for n, k in SKIPGRAM_SHAPES))
def q_t12(spark, d):
    from communitylens.functions.text import letters_only_tokens
    t = Tables(spark, d)
    # texts lie by document, so that a document's grams are counted where they are made
    docs = t.documents.select(F.col("doc_id").alias("doc"), "text").repartition("doc")
    grams = tf.skipgram_rows(docs.select("doc", letters_only_tokens("text").alias("t")), "t", SKIPGRAM_SHAPES)
    return tf.tfidf_of_many(grams, "shape", _n_docs(t))


@query("vocabulary", f"""
WITH it AS (SELECT doc_id AS doc, unnest({_tok_sql(_normalise_sql_text(), True)}) AS term FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
st AS (SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM it GROUP BY term),
top AS (SELECT term, cf FROM st WHERE df <= (SELECT n FROM nd) * 0.99 ORDER BY cf DESC, term ASC LIMIT 500000)
SELECT term AS word, row_number() OVER (ORDER BY term) - 1 AS index, cf AS count FROM top""")
def q_t17(spark, d):
    t = Tables(spark, d)
    docs = t.documents
    items = tf.token_rows(docs, [F.col("doc_id").alias("doc")], normalise_post("text"))
    return tf.vocabulary(items, _n_docs(t))


def _placed_texts(t):
    """(doc_id, text) lying by document, so that its words are counted and put
    together where they are cut: the texts move once, their words do not."""
    return t.documents.select("doc_id", "text").repartition("doc_id")


def _fitted_vocabulary(spark, t):
    """The vocabulary of ``documents``, saved and read again."""
    path = scratch_path(spark, f"vocabulary-{uuid.uuid4().hex[:12]}")
    items = tf.token_rows(_placed_texts(t), [F.col("doc_id").alias("doc")], normalise_post("text"))
    tf.save_vocabulary(tf.vocabulary(items, _n_docs(t)), path)
    return spark.read.parquet(path)


def _sequence_sql(keys: str, table: str) -> str:
    return f"""
WITH it AS (SELECT doc_id AS doc, unnest({_tok_sql(_normalise_sql_text(), True)}) AS term FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
st AS (SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM it GROUP BY term),
top AS (SELECT term FROM st WHERE df <= (SELECT n FROM nd) * 0.99 ORDER BY cf DESC, term ASC LIMIT 500000),
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM top),
tok AS (SELECT {keys}, unnest(list_transform(toks, lambda x, i: struct_pack(place := i, term := x))) AS p
        FROM (SELECT {keys}, {_tok_sql(_normalise_sql_text(), True)} AS toks FROM {table}) z)
SELECT {keys}, count(*) AS n_words, string_agg(index::VARCHAR, ' ' ORDER BY p.place) AS sequence FROM tok JOIN voc ON voc.term = p.term
GROUP BY {keys}"""


@query("vocabulary_sequences", _sequence_sql("doc_id", "documents"))
def q_t17_sequences(spark, d):
    """Every document as the indexes of its words in the vocabulary
    fitted on all documents."""
    t = Tables(spark, d)
    seq = tf.index_sequences(tf.token_places(_placed_texts(t), ["doc_id"], normalise_post("text")), _fitted_vocabulary(spark, t), ["doc_id"])
    return seq.select("doc_id", F.size("sequence").cast("bigint").alias("n_words"), F.array_join("sequence", " ").alias("sequence"))


@query("vocabulary_reused", _sequence_sql("conv_id, turn", "conversations"))
def q_t17_reused(spark, d):
    """Conversation turns by the saved vocabulary of the documents; words
    that it does not have are skipped."""
    t = Tables(spark, d)
    keys = ["conv_id", "turn"]
    seq = tf.index_sequences(tf.token_places(t.raw("conversations"), keys, normalise_post("text")), _fitted_vocabulary(spark, t), keys)
    return seq.select(*keys, F.size("sequence").cast("bigint").alias("n_words"), F.array_join("sequence", " ").alias("sequence"))


_PROFILE_SQL = f"""SELECT id AS doc, unnest({_tok_sql(_normalise_sql_text().replace('text', 'user_desc'), True)}) AS term FROM users"""
_POSTS_SQL = f"""SELECT user_id AS doc, unnest({_tok_sql(_normalise_sql_text().replace('text', 'status_text'), True)}) AS term FROM posts"""


@query("tfidf_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", * FROM ({_tfidf_sql(sql).replace('FROM documents),', 'FROM users),', 1)}) {name}_"
    for name, sql in (("profile", _PROFILE_SQL), ("posts", _POSTS_SQL))))
def q_t11_columns(spark, d):
    """T11 over two text columns of a user side by side: profile and posts."""
    t = Tables(spark, d)

    def words(texts, doc, text):
        # the texts lie by user, their words do not move
        laid = texts.select(F.col(doc).alias("doc"), normalise_post(text).alias("text")).repartition("doc")
        return tf.token_rows(laid, ["doc"], F.col("text"))
    items = {"profile": words(t.users, "id", "user_desc"), "posts": words(t.posts, "user_id", "status_text")}
    return tf.tfidf_by_column(items, t.users.select(F.count(F.lit(1))).scalar())


@query("pairwise_cosine", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) + 0.0 AS cosine FROM v a JOIN v b ON a.id <> b.id)
SELECT id, other, round(cosine, 6) AS cosine, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM p) r WHERE rank <= 10""")
def q_t16(spark, d):
    """The 10 most similar vectors of every vector, exactly, by blocks."""
    from communitylens.operators.nearest import nearest_exact
    e = Tables(spark, d).raw("embeddings")
    return nearest_exact(e, 10, id_col="vec_id", vector_col="embedding").select("id", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query("pairwise_cosine_sketched")
def q_t16_sketched(spark, d):
    """T16 by random-hyperplane buckets; recall against the exact form is in
    the tests."""
    from communitylens.operators.nearest import nearest_sketched
    return nearest_sketched(Tables(spark, d).raw("embeddings"), 10, id_col="vec_id", vector_col="embedding")


register("post_words", f"""SELECT word, count(*) AS count FROM (SELECT unnest({letters_tokens('status_text')}) AS word FROM posts) x GROUP BY word""")
register("part_tags", "SELECT DISTINCT lower(replace(p_name, ' ', '')) AS tag FROM part")
register("tag_words", f"""
SELECT tag, words, cost FROM (
  WITH RECURSIVE s AS (
    SELECT tag, 0 AS pos, 0::BIGINT AS cost, 0 AS n, '' AS words FROM part_tags
    UNION ALL
    SELECT s.tag, s.pos + l.l, s.cost + round(1000000 * CASE WHEN w.count IS NOT NULL THEN ln(t.n) - ln(w.count)
             ELSE ln(t.n) + (l.l - 1) * ln(10.0::DOUBLE) END)::BIGINT, s.n + 1,
           CASE WHEN s.n = 0 THEN '' ELSE s.words || ' ' END || substr(s.tag, (s.pos + 1)::INT, l.l::INT)
    FROM s JOIN (SELECT unnest(range(1, 21)) AS l) l ON s.pos + l.l <= length(s.tag)
    CROSS JOIN (SELECT sum(count)::DOUBLE AS n FROM post_words) t
    LEFT JOIN post_words w ON w.word = substr(s.tag, (s.pos + 1)::INT, l.l::INT))
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY cost, n, words) AS rn FROM s WHERE pos = length(tag)) q WHERE rn = 1""")


def _post_words(t):
    from communitylens.operators.segmentation import unigram_counts
    return unigram_counts(tf.token_rows(t.posts, [], F.col("status_text"), "word", drop_stopwords=False))


@query("segment_hashtags", "SELECT tag, words, cost FROM tag_words")
def q_x11_segments(spark, d):
    """X11: every part's name written as one hashtag, cut into words by the
    word counts of all posts."""
    from communitylens.operators.segmentation import segment
    t = Tables(spark, d)
    return segment(t.part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("tag")), _post_words(t))


@query("normalise_post_words", f"""
SELECT post_id, {{}} AS text FROM (SELECT p_partkey AS post_id,
  'RT *new* ' || words || ' &amp; it is "here" we cannot wait' AS text FROM part JOIN tag_words ON tag = lower(replace(p_name, ' ', ''))) x
""".replace("{}", _normalise_sql_text()))
def q_x11_words(spark, d):
    """X11 in full over texts with a hashtag and contractions."""
    from communitylens.operators.segmentation import unpack_posts
    t = Tables(spark, d)
    posts = t.part.select(F.col("p_partkey").alias("post_id"), F.concat(
        F.lit("RT *new* #"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" &amp; It's \"here\" we can’t wait")).alias("text"))
    return unpack_posts(posts, _post_words(t), "post_id", "text")


_VOC_TOKENS_SQL = f"SELECT doc_id AS doc, unnest({_tok_sql(_normalise_sql_text(), True)}) AS term FROM documents"
# tokens of a user's posts, or of the profile where there are none
CLUSTER_ITEMS_SQL = f"""
SELECT doc AS "user", term FROM ({_VOC_TOKENS_SQL}) p UNION ALL
SELECT u.id, unnest({_tok_sql(_normalise_sql_text().replace('text', 'user_desc'), True)}) FROM users u
WHERE u.id NOT IN (SELECT doc FROM ({_VOC_TOKENS_SQL}) p2)"""


def cluster_items(t, counted=False):
    """T15's tokens (user, term): of the user's posts, or of the profile of a
    user without any; ``counted``: (user, term, n), posts cut once and kept."""
    def rows(tokens):
        return tokens.groupBy("user", "term").agg(F.count(F.lit(1)).alias("n")) if counted else tokens

    posts = rows(tf.token_rows(_placed_texts(t), [F.col("doc_id").alias("user")], normalise_post("text")))
    posts = posts.checkpoint() if counted else posts
    rest = t.users.select(F.col("id").alias("user"), "user_desc").join(posts.select("user").distinct(), "user", "left_anti")
    return posts.unionByName(rows(tf.token_rows(rest, ["user"], normalise_post("user_desc"))))


def cluster_counts(t, clusters):
    """Tokens of each user in each cluster of word vectors.  A word's
    vector is the one of its vocabulary index; a word without one gets one
    of the vectors by the md5 of the word, the same every time.  A user's
    different words meet their clusters, not every token."""
    items = cluster_items(t, counted=True)
    n_vectors = clusters.agg(F.max("vec_id") + 1).first()[0]
    voc = (global_row_number(items.select("term").distinct(), ["term"])
           .select("term", (F.col("row_number") - 1).alias("index")))
    spare = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % n_vectors
    words = (voc.withColumn("vec_id", F.when(F.col("index") < n_vectors, F.col("index")).otherwise(spare))
             .join(clusters, "vec_id").select("term", "cluster"))
    return items.join(words, "term").groupBy("user", "cluster").agg(F.sum("n").alias("n"))


@query("word_cluster_counts", f"""
WITH it AS ({CLUSTER_ITEMS_SQL}), nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS index FROM (SELECT DISTINCT term FROM it) x),
w AS (SELECT term, CASE WHEN index < n THEN index ELSE ('0x' || substr(md5(term), 1, 8))::BIGINT % n END AS vec_id FROM voc, nv)
SELECT it."user", e.label AS cluster, count(*) AS n FROM it JOIN w ON it.term = w.term JOIN embeddings e ON e.vec_id = w.vec_id
GROUP BY it."user", e.label""")
def q_t15(spark, d):
    t = Tables(spark, d)
    return cluster_counts(t, t.embeddings.select("vec_id", F.col("label").alias("cluster")))


@query("read_class_dictionaries", f"""
SELECT 'any' AS pos, class AS label, word, CAST(freq AS DOUBLE) AS score FROM t_pass1 WHERE rank <= {S07_TOP}""")
def q_s07(spark, d):
    path = scratch_path(spark, f"class-dicts-{uuid.uuid4().hex[:12]}")
    pass1 = _pass1(Tables(spark, d)).select(F.lit("any").alias("pos"), "class", "word", F.col("freq").cast("double").alias("score"))
    dic.write_class_dictionaries(pass1, path)
    return dic.read_class_dictionaries(spark, path, S07_TOP).select("pos", "label", "word", "score")


@query("read_class_dictionary_files", f"""
SELECT 'any' AS pos, class AS label, word, CAST(freq AS DOUBLE) AS score FROM t_pass1 WHERE rank <= {S07_TOP}""")
def q_s07_files(spark, d):
    """S07 in the layout of the dictionary builder: one ``label_n_pos.csv`` a
    list, best entries first; the first lines of each file are read."""
    path = scratch_path(spark, f"class-files-{uuid.uuid4().hex[:12]}")
    nf.write_class_dictionary_files(_pass1(Tables(spark, d)).select(F.lit("any").alias("pos"), "class", "word", F.col("freq").alias("score"), "rank"),
                                     path, PASS1_TOP)
    return nf.read_class_dictionary_lists(spark, path, S07_TOP).select("pos", "label", "word", "score")
