"""What a job lays on disk: the landed feed and the rows that move."""

import os
import re

from communitylens.sources.tables import Tables
from communitylens.streaming import stream as st

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _size(path):
    return sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))


def test_a_landed_feed_is_packed_and_read_as_lines(spark, tmp_path):
    lines = [('{"id_str":"%d","lang":"en","text":"old cold gear"}' % i,) for i in range(2000)]
    feed = spark.createDataFrame(lines, "value string")
    st.write_feed(feed, f"{tmp_path}/feed")
    feed.write.text(f"{tmp_path}/plain")
    assert _size(f"{tmp_path}/feed") < _size(f"{tmp_path}/plain") / 4
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/feed").collect()) == sorted(x for x, in lines)


def test_lines_move_by_post_without_lists_of_a_few(spark, tmp_path):
    t = Tables(spark, SF)
    for df in (t.posts, t.post_entities, t.posts_and_entities, t.community_posts):
        moved = re.findall(r"Exchange hashpartitioning\(l_orderkey[^\n]*\n[^\n]*", _plan(df))
        assert moved and not any("collect_list" in m for m in moved)


def test_words_of_a_feed_do_not_move_to_the_track_list(spark, monkeypatch):
    finish, plans = st._finish, []

    def note(writer, ckpt):
        plans.append(writer._df._jdf.queryExecution().analyzed().toString())
        finish(writer, ckpt)
    monkeypatch.setattr(st, "_finish", note)
    feed = ['{"id_str":"1","lang":"en","text":"Anvil gizmo"}', '{"id_str":"2","lang":"en","text":"x anvils"}',
            '{"id_str":"3","lang":"de","text":"anvil"}', '{"id_str":"4","lang":"en","text":"a  GIZMO"}', "{"]
    keywords = spark.createDataFrame([("anvil",), ("Gizmo",), ("gizmo",), (None,)], "keyword string")
    out = st.stream_filter(spark, spark.createDataFrame([(x,) for x in feed], "value string"), keywords)
    assert sorted((r.id, r.status_text) for r in out.collect()) == [(1, "Anvil gizmo"), (4, "a  GIZMO")]
    assert re.search(r"Join LeftSemi(?s:.*)ResolvedHint \(strategy=broadcast\)", plans[0])
