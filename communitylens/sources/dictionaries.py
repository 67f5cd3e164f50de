"""Dictionary sources (S04-S09, M15): community dictionaries, class
dictionaries and keyword lists, always as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWN_MAX_SIZE, CB_MAX_SIZE = 5, 10


def organise_tags(part: DataFrame) -> DataFrame:
    """M15 on the fixture: every part is a tag line of its brand's section;
    p_size <= 5 gives the community's own tags, <= 10 its
    community-building tags, larger ones are discarded lines of their type.
    Output (tag, community, role, type)."""
    role = (F.when(F.col("p_size") <= OWN_MAX_SIZE, "own")
            .when(F.col("p_size") <= CB_MAX_SIZE, "cb").otherwise("discarded"))
    return part.select(F.col("p_partkey").alias("tag"), F.col("p_brand").alias("community"),
                       role.alias("role"), F.col("p_type").alias("type"))


def write_community_tsv(part: DataFrame, path: str) -> None:
    """The community dictionary file of the fixture: one line per community,
    ``name<TAB>#own1|#own2|<TAB>#cb1|`` (no header), from the part table."""
    o = organise_tags(part).filter(F.col("role") != "discarded")

    def tags(role):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == role,
                                                               F.concat(F.lit("#P"), F.col("tag").cast("string"))))), "|")

    lines = o.groupBy("community").agg(tags("own").alias("own"), tags("cb").alias("cb"))
    (lines.select(F.concat_ws("\t", "community", F.concat(F.col("own"), F.lit("|")), F.concat(F.col("cb"), F.lit("|"))).alias("v"))
     .write.mode("overwrite").text(path))


def read_community_dict(spark, path: str) -> DataFrame:
    """(community, tag, kind) from the TSV; every '|' part loses its
    leading '#' and is lower-cased; empty parts are dropped.  No line is
    skipped (the file has no header)."""
    raw = spark.read.option("sep", "\t").option("header", "false").schema(
        "name string, own string, cb string").csv(path)

    def part(col, kind):
        return (raw.select(F.col("name").alias("community"), F.explode(F.split(F.col(col), r"\|")).alias("t"))
                .select("community", F.lower(F.regexp_replace("t", "^#", "")).alias("tag"), F.lit(kind).alias("kind")))

    return part("own", "own").unionByName(part("cb", "cb")).filter(F.col("tag") != "")


def invert_community_dict(long_dict: DataFrame, order_col: str = "community") -> DataFrame:
    """Tag -> one community; when a tag is listed by several
    communities the last one (greatest ``order_col``) wins."""
    return long_dict.groupBy("tag").agg(F.max_by("community", F.col(order_col)).alias("community"))


def write_text_file(spark, path: str, text: str) -> None:
    """One small named file on whatever file system the path names (fixture
    files whose name carries meaning; Spark's sinks choose names)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _file_name():
    """Base name of the file a row was read from, percent escapes undone."""
    return F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_word_lists(spark, path: str) -> DataFrame:
    """(list, word) from a folder of ``<list>.txt`` files with one word a
    line; blank lines are skipped."""
    rows = spark.read.text(path).select(F.regexp_replace(_file_name(), r"\.txt$", "").alias("list"),
                                        F.trim("value").alias("word"))
    return rows.filter(F.col("word") != "").distinct()


def write_class_dictionaries(dicts: DataFrame, path: str) -> None:
    """Class dictionaries (pos, class, word, score) as CSV ``word,score``
    lines in one folder per part of speech and label."""
    (dicts.select("pos", F.col("class").alias("label"), "word", "score")
     .write.mode("overwrite").partitionBy("pos", "label").csv(path))


def read_class_dictionaries(spark, path: str, top_n: int) -> DataFrame:
    """A folder of class dictionaries (one folder per pos and label,
    ``word,score`` lines) -> (pos, label, word, score): the first ``top_n``
    entries of each list (lists are kept best first); a missing score is
    0.0."""
    raw = (spark.read.schema("word string, score string, pos string, label string")
           .option("basePath", path).csv(path))
    x = raw.select("pos", "label", "word", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))
    from pyspark.sql import Window
    w = Window.partitionBy("pos", "label").orderBy(F.col("score").desc(), F.col("word").asc())
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n).drop("_r")


def _numbered_lines(spark, path: str) -> DataFrame:
    """(file, line, value) of a folder of small text files, lines from 0 in
    file order; a file is one row until its lines are cut, so their order is sure."""
    whole = spark.read.text(path, wholetext=True).select(_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read_class_dictionary_files(spark, path: str, top_n: int, pos=None) -> DataFrame:
    """S07 as files are named by the class dictionary builder,
    ``<label>_<pos>.csv`` or ``<label>_<n>_<pos>.csv`` (or .txt), ``word,score``
    lines best first -> (pos, label, word, score): the first ``top_n`` lines of
    each file, of the listed parts of speech if any; a line without a score has 0.0,
    and of a word listed twice the later line counts."""
    name = F.split(F.regexp_replace("file", r"\.(csv|txt)$", ""), "_")
    cells = F.from_csv("value", "word string, score string, more string")
    lines = (_numbered_lines(spark, path).filter((F.col("line") < top_n) & (F.col("value") != ""))
             .select("line", name.alias("n"), cells.alias("c")))
    exact_two = F.col("c.score").isNotNull() & F.col("c.more").isNull()
    rows = lines.select("line", F.when(F.size("n") == 3, F.try_element_at("n", F.lit(3))).otherwise(F.try_element_at("n", F.lit(2)))
                        .alias("pos"), F.col("n")[0].alias("label"), F.col("c.word").alias("word"),
                        F.when(exact_two, F.coalesce(F.col("c.score").try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("score"))
    if pos is not None:
        rows = rows.filter(F.col("pos").isin(*pos))
    return rows.groupBy("pos", "label", "word").agg(F.max_by("score", "line").alias("score"))


def read_user_files(spark, path: str) -> DataFrame:
    """S09 as per-user files: line 0 is the user, the others are
    ``ot|text`` or ``rt|text``; anything else before the bar counts as a
    retweet, a line without a bar is skipped -> (user, kind, text)."""
    lines = _numbered_lines(spark, path)
    user = lines.filter(F.col("line") == 0).select("file", F.col("value").alias("user"))
    cut = F.split("value", r"\|", 2)
    posts = lines.filter((F.col("line") > 0) & F.col("value").contains("|")).select(
        "file", F.when(cut[0] == "ot", "ot").otherwise("rt").alias("kind"), cut[1].alias("text"))
    return posts.join(user, "file").select("user", "kind", "text")


def read_multi_value_dict(spark, path: str) -> DataFrame:
    """``word,c1,c2,...`` lines -> (word, value) for non-empty values."""
    lines = spark.read.text(path)
    parts = F.split("value", ",")
    return (lines.select(F.try_element_at(parts, F.lit(1)).alias("word"), F.posexplode(parts).alias("pos", "v"))
            .filter((F.col("pos") > 0) & (F.trim("v") != "")).select("word", F.trim("v").alias("value")))
