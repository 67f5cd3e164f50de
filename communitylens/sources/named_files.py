"""Text files that carry a name, one a user or list.

Spark's file sinks choose their own file names, so this is a Python data
source.  A task writes the files of its names into a folder of its own; the
commit writes the list of the folders whose tasks succeeded.  Folders of lost
or repeated attempts are not in the list and are never read, and the driver
handles one entry a task, not one a file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "named_text"
MANIFEST = "_names.json"


def _open(path: str):
    """(file system, path in it) of a folder that all machines share."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class Folder(WriterCommitMessage):
    def __init__(self, name: str, files: int):
        self.name, self.files = name, files


class NamedTextWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Folder:
        fs, base = _open(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        name, out, files = None, None, 0
        try:
            for r in rows:
                if out is None or r.name != name:
                    if out is not None:
                        out.close()
                    name, files = r.name, files + 1
                    out = fs.open_output_stream(f"{base}/{folder}/{quote(name, safe=' ')}")
                out.write((r.value + "\n").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return Folder(folder, files)

    def commit(self, messages: list) -> None:
        fs, base = _open(self.path)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.files]).encode())

    def abort(self, messages: list) -> None:
        pass  # without the list nothing is read


class OneFolder(InputPartition):
    def __init__(self, name: str):
        self.name = name


class NamedTextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list:
        fs, base = _open(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            return [OneFolder(x) for x in json.loads(f.read())] or [OneFolder("")]

    def read(self, partition: OneFolder) -> Iterator[tuple]:
        if not partition.name:
            return
        import io

        from pyarrow.fs import FileSelector
        fs, base = _open(self.path)
        for info in fs.get_file_info(FileSelector(f"{base}/{partition.name}")):
            with fs.open_input_stream(info.path) as raw:
                lines = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", errors="surrogatepass", newline="\n")
                for place, line in enumerate(lines):
                    yield unquote(info.base_name), place, line.rstrip("\n")


class NamedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, place long, value string"

    def writer(self, schema, overwrite: bool) -> NamedTextWriter:
        return NamedTextWriter(self.options["path"])

    def reader(self, schema) -> NamedTextReader:
        return NamedTextReader(self.options["path"])


def write_named_files(lines: DataFrame, path: str) -> None:
    """Writes ``lines`` (name, place, value) as one file a name, lines by
    place.  A value's own line feeds become spaces; rows without a name go; a
    name may hold any characters.  All lines of a name pass through one task as
    a stream, as they are one file."""
    lines.sparkSession.dataSource.register(NamedText)
    (lines.where("name IS NOT NULL")
     .select("name", F.col("place").cast("long").alias("place"), F.regexp_replace(F.coalesce("value", F.lit("")), r"[\r\n]+", " ").alias("value"))
     .repartition("name").sortWithinPartitions("name", "place").write.format(FORMAT).mode("append").option("path", path).save())


def read_named_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, place, value): the lines of all files, places from 0."""
    spark.dataSource.register(NamedText)
    return spark.read.format(FORMAT).option("path", path).load()


def write_user_corpus(posts: DataFrame, path: str) -> None:
    """One file a user; line 0 is the user, then ``ot|text`` or
    ``rt|text`` for each post (user, post_id, kind, text) in order of its id."""
    heads = posts.select(F.col("user").cast("string").alias("name"), F.lit(-1).cast("long").alias("place"), F.col("user").cast("string").alias("value")).distinct()
    rows = posts.select(F.col("user").cast("string").alias("name"), F.col("post_id").cast("long").alias("place"), F.concat_ws("|", "kind", "text").alias("value"))
    write_named_files(heads.unionByName(rows), path)


def read_user_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(user, kind, text) of such files; ``ot`` is an own post, anything
    else before the bar a retweet, a line without a bar is skipped."""
    lines = read_named_files(spark, path)
    cut = F.split("value", r"\|", 2)
    return (lines.where((F.col("place") > 0) & F.col("value").contains("|"))
            .select(F.col("name").alias("user"), F.when(cut[0] == "ot", "ot").otherwise("rt").alias("kind"), cut[1].alias("text")))


def write_class_dictionary_files(dicts: DataFrame, path: str, n: int) -> None:
    """Class dictionaries (pos, class, word, score, rank) as
    ``<class>_<n>_<pos>.csv`` files of ``word,score`` lines, best first."""
    name = F.concat(F.col("class"), F.lit(f"_{n}_"), F.col("pos"), F.lit(".csv"))
    write_named_files(dicts.where(F.col("rank") <= n).select(name.alias("name"), F.col("rank").alias("place"),
                                                            F.concat_ws(",", "word", F.col("score").cast("string")).alias("value")), path)


def read_class_dictionary_lists(spark: SparkSession, path: str, top_n: int) -> DataFrame:
    """(pos, label, word, score) from the first ``top_n`` lines of each
    such file; a missing score is 0.0."""
    part = F.split(F.regexp_replace("name", r"\.csv$", ""), "_")
    cells = F.split("value", ",")
    return (read_named_files(spark, path).where((F.col("place") < top_n) & (F.col("value") != ""))
            .select(part[2].alias("pos"), part[0].alias("label"), cells[0].alias("word"),
                    F.coalesce(F.try_element_at(cells, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("score")))
