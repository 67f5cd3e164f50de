"""Queries for the scalar functions (X01-X24), each over a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from communitylens.functions import text as tx
from communitylens.functions.lexicons import (ANALYSER_STOPWORDS, FOLD_MULTI, FOLD_SINGLE,
                                              PRECEDENCE_OVER_ADVOCATE)
from communitylens.plans.oracle_views import register
from communitylens.plans.registry import query
from communitylens.plans.sqlfrag import collapse_ws, letters_tokens, split_ws
from communitylens.sources.tables import Tables


def hashtag_texts(t: Tables):
    """Post text with its tags appended as '#p<tag>' (FIXTURES §2)."""
    ht = t.post_tags.groupBy("post_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("tag")), lambda x: F.concat(F.lit("#p"), x.cast("string"))), " ").alias("ht"))
    return (t.posts.select(F.col("id").alias("post_id"), "status_text").join(ht, "post_id", "left")
            .select("post_id", F.concat_ws(" ", "status_text", "ht").alias("text")))


register("hashtag_texts", """
SELECT p.id AS post_id, concat_ws(' ', p.status_text, h.ht) AS text FROM posts p
LEFT JOIN (SELECT post_id, string_agg('#p' || CAST(tag AS VARCHAR), ' ' ORDER BY tag) AS ht FROM post_tags GROUP BY post_id) h
  ON p.id = h.post_id""")


@query("split_whitespace", f"""
SELECT doc_id, len({split_ws('text')}) AS n_tokens, {split_ws('text')}[1] AS first_token FROM documents""")
def q_x01(spark, d):
    w = tx.split_whitespace("text")
    return Tables(spark, d).documents.select("doc_id", F.size(w).alias("n_tokens"), F.try_element_at(w, F.lit(1)).alias("first_token"))


@query("collapse_whitespace", f"""
SELECT doc_id, length({collapse_ws('text')}) AS n_chars, md5({collapse_ws('text')}) AS digest FROM documents""")
def q_x02(spark, d):
    c = tx.collapse_whitespace("text")
    return Tables(spark, d).documents.select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


@query("extract_hashtags", """
SELECT post_id, len(regexp_extract_all(text, '\\B#\\w*[a-zA-Z]+\\w*')) AS n_hashtags,
       array_to_string(regexp_extract_all(text, '\\B#\\w*[a-zA-Z]+\\w*'), ' ') AS hashtags FROM hashtag_texts""")
def q_x03(spark, d):
    h = tx.extract_hashtags("text")
    return hashtag_texts(Tables(spark, d)).select("post_id", F.size(h).alias("n_hashtags"),
                                                  F.array_join(h, " ").alias("hashtags"))


@query("extract_hashtags_hyphen", """
SELECT post_id, concat_ws(' ', text, array_to_string(list_transform(regexp_extract_all(text, '#[\\w\\-]+'), lambda h: substr(h, 2)), ' ')) AS text
FROM hashtag_texts""")
def q_x04(spark, d):
    return hashtag_texts(Tables(spark, d)).select("post_id", tx.append_hashtag_words("text").alias("text"))


@query("trim_hash_char", """
SELECT DISTINCT '#p' || CAST(tag AS VARCHAR) AS line, regexp_replace('#p' || CAST(tag AS VARCHAR), '^#', '') AS tag FROM post_tags""")
def q_x05(spark, d):
    lines = Tables(spark, d).post_tags.select(F.concat(F.lit("#p"), F.col("tag").cast("string")).alias("line")).distinct()
    return lines.select("line", tx.trim_hash("line").alias("tag"))


register("bracket_lines", """
SELECT p_partkey, '#' || replace(p_name, ' ', '') || CASE WHEN p_size <= 5 THEN ' (' || lower(p_type) || ')' ELSE '' END AS line
FROM part""")


@query("parse_bracketed_tag", """
SELECT p_partkey, regexp_extract(line, '^#(\\S+)', 1) AS tag, regexp_matches(line, '\\(\\w+\\)$') AS bracketed,
       regexp_extract(line, '\\((\\w+)\\)$', 1) AS type FROM bracket_lines""")
def q_x06(spark, d):
    p = Tables(spark, d).part
    line = F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("")),
                    F.when(F.col("p_size") <= 5, F.concat(F.lit(" ("), F.lower("p_type"), F.lit(")"))).otherwise(F.lit("")))
    b = p.select("p_partkey", line.alias("line"))
    return b.select("p_partkey", F.regexp_extract("line", r"^#(\S+)", 1).alias("tag"),
                    F.col("line").rlike(r"\(\w+\)$").alias("bracketed"),
                    F.regexp_extract("line", r"\((\w+)\)$", 1).alias("type"))


_HREF = "href=\"([^\"]+)\""
_HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"


@query("url_domains", f"""
SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS host,
  len(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS n_urls,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '{_HREF}', 1), lambda u: regexp_extract(u, '{_HOST}', 1)), lambda h: h <> ''))) AS n_hosts
FROM pages""")
def q_x07(spark, d):
    pg = Tables(spark, d).pages
    hrefs = F.regexp_extract_all("html", F.lit(_HREF), 1)
    hosts = F.filter(F.transform(hrefs, lambda u: F.regexp_extract(u, _HOST, 1)), lambda h: h != "")
    return pg.select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"),
                     F.size(F.array_distinct(hrefs)).alias("n_urls"), F.size(F.array_distinct(hosts)).alias("n_hosts"))


@query("username_shape", """
SELECT id, length(regexp_replace(screen_name, '[^\\p{L}]', '', 'g')) AS n_alpha,
  length(regexp_replace(screen_name, '[^\\p{Nd}]', '', 'g')) AS n_digits,
  CASE WHEN length(regexp_replace(screen_name, '[^\\p{Lu}]', '', 'g')) = length(regexp_replace(screen_name, '[^\\p{L}]', '', 'g')) THEN 1
       WHEN length(regexp_replace(screen_name, '[^\\p{Lu}]', '', 'g')) = 0 THEN 2 ELSE 3 END AS case_class FROM users""")
def q_x08(spark, d):
    return Tables(spark, d).users.select("id", *tx.username_shape("screen_name"))


def _fold_sql(t: str) -> str:
    """Folding the other engine's way: accents stripped by its own function,
    then the letters that are not an accented base letter."""
    s = f"strip_accents({t})"
    for a, b in {**FOLD_SINGLE, **FOLD_MULTI}.items():
        s = "replace({}, '{}', '{}')".format(s, a, b.replace("'", "''"))
    return s


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ANALYSER_STOPWORDS) + "]"
_TOKEN_SQL = tx.TOKEN_PATTERN.replace("'", "''")
_ANALYSE_SQL = (f"list_transform(list_filter(regexp_extract_all({_fold_sql('text')}, '{_TOKEN_SQL}'), "
                f"lambda x: NOT list_contains({_STOP_SQL}, lower(x))), lambda x: lower(x))")


@query("analyse_text", f"""
SELECT doc_id, len({_ANALYSE_SQL}) AS n_tokens, md5(array_to_string({_ANALYSE_SQL}, ' ')) AS digest FROM documents""")
def q_x09(spark, d):
    a = tx.analyse_text("text")
    return Tables(spark, d).documents.select("doc_id", F.size(a).alias("n_tokens"), F.md5(F.array_join(a, " ")).alias("digest"))


@query("letters_only_tokens", f"""
SELECT doc_id, len({letters_tokens('text')}) AS n_tokens, md5(array_to_string({letters_tokens('text')}, ' ')) AS digest
FROM documents""")
def q_x10(spark, d):
    a = tx.letters_only_tokens("text")
    return Tables(spark, d).documents.select("doc_id", F.size(a).alias("n_tokens"), F.md5(F.array_join(a, " ")).alias("digest"))


def _normalise_sql(t: str) -> str:
    s = f"trim({t})"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "''")):
        s = "replace({}, '{}', '{}')".format(s, a, b.replace("'", "''"))
    s = f"regexp_replace({s}, '(^|\\s)RT(\\s|$)', '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '\"', ' ', 'g')"
    s = f"regexp_replace({s}, '\\*(\\w+)\\*', '\\1', 'g')"
    s = f"regexp_replace({s}, '#(\\w+)', '\\1', 'g')"
    return collapse_ws(s)


@query("normalise_post", f"SELECT post_id, {_normalise_sql('text')} AS text FROM hashtag_texts")
def q_x11(spark, d):
    return hashtag_texts(Tables(spark, d)).select("post_id", tx.normalise_post("text").alias("text"))


@query("is_retweet", """
SELECT id, starts_with(lower(status_text), 'rt ') AS is_rt_text, kind = 'retweet' AS is_rt_kind FROM posts""")
def q_x12(spark, d):
    p = Tables(spark, d).posts
    return p.select("id", F.lower("status_text").startswith("rt ").alias("is_rt_text"),
                    (F.col("kind") == "retweet").alias("is_rt_kind"))


@query("null_safe_ratio", """
SELECT id, coalesce(CAST(friends AS DOUBLE) / nullif(followers, 0), 0.0) AS friend_ratio FROM users""")
def q_x13(spark, d):
    return Tables(spark, d).users.select("id", tx.null_safe_ratio("friends", "followers").alias("friend_ratio"))


@query("parse_post_time", """
SELECT id, strftime(created_at, '%a %b %d %H:%M:%S +0000 %Y') AS created_at_str,
       CAST(strptime(strftime(created_at, '%a %b %d %H:%M:%S +0000 %Y'), '%a %b %d %H:%M:%S %z %Y') AS TIMESTAMP) AS parsed
FROM posts""")
def q_x14(spark, d):
    p = Tables(spark, d).posts
    s = F.date_format(F.col("created_at"), "EEE MMM dd HH:mm:ss +0000 yyyy")
    parsed = F.to_timestamp(F.substr(s, F.lit(5)), "MMM dd HH:mm:ss Z yyyy").cast("timestamp_ntz")
    return p.select("id", s.alias("created_at_str"), parsed.alias("parsed"))


@query("format_dates", """
SELECT id, strftime(created_at, '%d-%m-%Y %H:%M:%S') AS day_first, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM posts""")
def q_x15(spark, d):
    p = Tables(spark, d).posts
    return p.select("id", F.date_format("created_at", "dd-MM-yyyy HH:mm:ss").alias("day_first"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("add_days_seconds", """
SELECT id, created_at + INTERVAL 10 DAY AS plus_days, created_at + INTERVAL 10 DAY + INTERVAL 1 SECOND AS next_start FROM posts""")
def q_x16(spark, d):
    p = Tables(spark, d).posts
    plus = F.col("created_at") + F.make_dt_interval(F.lit(10))
    return p.select("id", plus.alias("plus_days"),
                    (plus + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))).alias("next_start"))


@query("json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events""")
def q_x17(spark, d):
    e = Tables(spark, d).events
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.cast("bigint").alias("k"), k.isNotNull().alias("has_k"))


@query("entities_to_string", """
SELECT post_id, string_agg(CAST(tag AS VARCHAR), ' ' ORDER BY CAST(tag AS VARCHAR)) AS hashtags FROM post_tags GROUP BY post_id""")
def q_x18(spark, d):
    pt = Tables(spark, d).post_tags
    return pt.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("tag").cast("string"))), " ").alias("hashtags"))


@query("array_size_or_zero", """
SELECT u.id, coalesce(n.n, 0) AS n_hashtags FROM users u
LEFT JOIN (SELECT p.user_id, count(DISTINCT pt.tag) AS n FROM posts p JOIN post_tags pt ON p.id = pt.post_id GROUP BY p.user_id) n
  ON u.id = n.user_id""")
def q_x19(spark, d):
    t = Tables(spark, d)
    n = (t.posts.select(F.col("id").alias("post_id"), "user_id").join(t.post_tags, "post_id")
         .select("user_id", "tag").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    return (t.users.select("id").join(n, t.users.id == n.user_id, "left")
            .select("id", F.coalesce("n", F.lit(0)).alias("n_hashtags")))


@query("screen_name_from_url", "SELECT page_id, regexp_extract(url, '[^/]*$') AS tail FROM pages")
def q_x20(spark, d):
    return Tables(spark, d).pages.select("page_id", tx.screen_name_from_url("url").alias("tail"))


register("label_columns", """
SELECT u.id, coalesce(u.label, '') AS l1,
  CASE WHEN l.quality = 1 THEN 'quality' ELSE '' END AS l2, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS l3
FROM users u LEFT JOIN labels l ON u.id = l.doc_id""")


def label_columns(t: Tables):
    lab = t.labels
    return (t.users.join(lab, t.users.id == lab.doc_id, "left")
            .select("id", F.coalesce("label", F.lit("")).alias("l1"),
                    F.when(F.col("quality") == 1, "quality").otherwise("").alias("l2"),
                    F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("l3")))


def merge_label_columns(cols):
    """Join non-blank labels with ','."""
    return F.array_join(F.filter(F.array(*[F.col(c) for c in cols]), lambda x: F.trim(x) != ""), ",")


_MERGE_SQL = "array_to_string(list_filter([l1, l2, l3], lambda x: trim(x) <> ''), ',')"


@query("merge_label_columns", f"SELECT id, {_MERGE_SQL} AS labels FROM label_columns")
def q_x22(spark, d):
    return label_columns(Tables(spark, d)).select("id", merge_label_columns(["l1", "l2", "l3"]).alias("labels"))


@query("split_labels", f"""
SELECT id, label FROM (SELECT id, unnest(string_split({_MERGE_SQL}, ',')) AS label FROM label_columns) x WHERE label <> ''""")
def q_x21(spark, d):
    m = label_columns(Tables(spark, d)).select("id", merge_label_columns(["l1", "l2", "l3"]).alias("labels"))
    return m.select("id", F.explode(F.split("labels", ",")).alias("label")).filter(F.col("label") != "")


_PREC = "[" + ", ".join(f"'{x}'" for x in PRECEDENCE_OVER_ADVOCATE) + "]"


@query("label_precedence", f"""
SELECT id, array_to_string(list_transform(
  CASE WHEN list_has_any(ls, {_PREC}) THEN list_filter(ls, lambda x: x <> 'advocate') ELSE ls END,
  lambda x: CASE WHEN x = 'P' THEN 'Patient' ELSE x END), ',') AS labels
FROM (SELECT id, list_filter([l1, l2, l3], lambda x: trim(x) <> '') AS ls FROM label_columns) z""")
def q_x23(spark, d):
    from communitylens.functions.labels import label_precedence
    lc = label_columns(Tables(spark, d))
    ls = F.filter(F.array("l1", "l2", "l3"), lambda x: F.trim(x) != "")
    return lc.select("id", F.array_join(label_precedence(ls), ",").alias("labels"))


@query("harmonic_mean", """
SELECT user_id, coalesce(2.0 * newtweet_count * retweet_count / nullif(newtweet_count + retweet_count, 0), 0.0) AS inclination
FROM user_rollup""")
def q_x24(spark, d):
    from communitylens.operators.stats import user_rollup
    r = user_rollup(Tables(spark, d).posts)
    return r.select("user_id", tx.harmonic_mean("newtweet_count", "retweet_count").alias("inclination"))
