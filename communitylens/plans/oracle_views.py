"""The canonical views as SQL text for the independent DuckDB oracle.

``with_views(sql)`` finds which views a query names and prepends them (and
what they depend on) as a WITH clause, so every oracle string runs on the
raw tables only.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def _view(name: str, body: str, deps: tuple[str, ...] = ()):
    VIEWS[name] = body.strip()


_view("post_tags", "SELECT DISTINCT l_orderkey AS post_id, l_partkey AS tag FROM lineitem")
_view("post_mentions", "SELECT DISTINCT l_orderkey AS post_id, l_suppkey AS mention FROM lineitem")
_view("communities", "SELECT p_partkey AS tag, p_brand AS community FROM part WHERE p_size <= 5")
_view("post_communities", """
SELECT DISTINCT pt.post_id, c.community FROM post_tags pt JOIN communities c ON pt.tag = c.tag
""", ("post_tags", "communities"))
_view("post_entities", """
SELECT DISTINCT post_id, kind, value FROM (
  SELECT l_orderkey AS post_id, 'hashtag' AS kind, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 'mention', CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT l_orderkey, 'symbol', p_type FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, 'url', 'https://shop.example/size/' || CAST(p_size AS VARCHAR)
            FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, 'media', arg_min(p_name, (l_linenumber, l_partkey))
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
) e
""")
_view("post_lines", """
SELECT l_orderkey,
  CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS INTEGER) AS retweet_count,
  CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS INTEGER) AS favorite_count,
  CAST(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS INTEGER) AS quote_count,
  CAST(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS INTEGER) AS reply_count,
  min(l_suppkey) AS first_mention,
  string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS txt
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey
""")
_view("posts", """
SELECT id, user_id, created_at, kind, retweet_count, favorite_count, quote_count, reply_count,
       in_reply_to_user_id, status_text FROM (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
    CASE o_orderpriority WHEN '5-LOW' THEN 'retweet' WHEN '4-NOT SPECIFIED' THEN 'quote'
                         WHEN '3-MEDIUM' THEN 'reply' ELSE 'original' END AS kind,
    coalesce(retweet_count, 0) AS retweet_count, coalesce(favorite_count, 0) AS favorite_count,
    coalesce(quote_count, 0) AS quote_count, coalesce(reply_count, 0) AS reply_count,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN first_mention END AS in_reply_to_user_id,
    (CASE WHEN o_orderpriority = '5-LOW' THEN 'RT ' ELSE '' END) || coalesce(txt, '') AS status_text
  FROM orders LEFT JOIN post_lines ON o_orderkey = l_orderkey) p
""", ("post_lines",))
_view("users", """
SELECT c_custkey AS id, c_name AS screen_name,
  CAST(floor(abs(c_acctbal)) AS BIGINT) AS followers,
  CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS friends,
  CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 THEN NULL
       ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'patient' WHEN 'BUILDING' THEN 'hpo'
            WHEN 'FURNITURE' THEN 'hpi' WHEN 'HOUSEHOLD' THEN 'advocate' WHEN 'MACHINERY' THEN 'research' END
  END AS label,
  d.text AS user_desc
FROM customer LEFT JOIN documents d ON c_custkey = d.doc_id
""")
_view("profile_facts", """
SELECT c_custkey AS id, c_mktsegment || ' ' || n_name AS user_name, CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS listed,
  CAST(coalesce(e.n, 0) AS BIGINT) AS favourites, d.lang AS language, CASE WHEN c_custkey % 4 <> 0 THEN n_name END AS location,
  CASE WHEN c_custkey % 4 <> 0 THEN 30 * n_regionkey - 60 END AS latitude,
  CASE WHEN c_custkey % 4 <> 0 THEN 14 * n_nationkey - 168 END AS longitude,
  c_acctbal >= 0 AS own_image, c_nationkey % 2 = 0 AS own_background
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN documents d ON c_custkey = d.doc_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) e ON e.user_id = c_custkey
""")
_view("profiles", 'SELECT doc_id AS "user", text, lang AS class FROM documents')


def register(name: str, body: str, deps: tuple[str, ...] = ()):
    """Add a derived view usable by later oracle strings."""
    _view(name, body, deps)


def _deps(n: str) -> list[str]:
    return [m for m in VIEWS if m != n and re.search(rf"\b{m}\b", VIEWS[n])]


def with_views(sql: str) -> str:
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in VIEWS:
        if re.search(rf"\b{n}\b", sql):
            visit(n)
    body = sql.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
