"""X11: hashtags cut into words, contractions written out.

A hashtag is cut where the product of its words' shares in a corpus is
largest (Viterbi over unigram counts).  The corpus counts are a table: the
pieces of the distinct hashtags meet them in one join, and each hashtag's
best path is found over its own pieces, so no task holds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.functions.text import normalise_post

#: Letters of the longest piece of a hashtag.
LONGEST = 20
#: Costs are whole millionths, so sums are exact.
UNIT = 1_000_000
# fixed values: English contractions
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he's": "he is", "i'd": "i would",
    "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not", "it's": "it is", "let's": "let us", "mustn't": "must not",
    "she's": "she is", "shouldn't": "should not", "that's": "that is", "there's": "there is", "they're": "they are",
    "they've": "they have", "wasn't": "was not", "we'll": "we will", "we're": "we are", "we've": "we have", "weren't": "were not",
    "what's": "what is", "won't": "will not", "wouldn't": "would not", "you'll": "you will", "you're": "you are", "you've": "you have",
}


def unigram_counts(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, count) of a table with one word a row."""
    return words.groupBy(F.col(word_col).alias("word")).agg(F.count(F.lit(1)).alias("count"))


def best_cut(tag: str, pieces: list[tuple[int, int, int]]) -> tuple[str, int]:
    """The cheapest cut of ``tag`` into ``pieces`` (start, length, cost): its
    words joined by spaces, and the cost.  Of equal costs the fewest words,
    then the least string."""
    best: list[tuple | None] = [None] * (len(tag) + 1)
    best[0] = (0, 0, "")
    by_start: dict[int, list] = {}
    for start, length, cost in pieces:
        by_start.setdefault(start, []).append((length, cost))
    for start in range(len(tag)):
        here = best[start]
        if here is None:
            continue
        for length, cost in by_start.get(start, ()):
            word = tag[start:start + length]
            to = (here[0] + cost, here[1] + 1, f"{here[2]} {word}" if here[2] else word)
            if best[start + length] is None or to < best[start + length]:
                best[start + length] = to
    return best[-1][2], best[-1][0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tags = b.column("tag").to_pylist()
        cuts = [best_cut(t, [(p["start"], p["length"], p["cost"]) for p in ps]) for t, ps in zip(tags, b.column("pieces").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("tag"), pa.array([c[0] for c in cuts], pa.string()), pa.array([c[1] for c in cuts], pa.int64())],
                                         names=["tag", "words", "cost"])


def segment(tags: DataFrame, counts: DataFrame, tag_col: str = "tag", longest: int = LONGEST) -> DataFrame:
    """(tag, words, cost) of the distinct tags.  A word costs -ln(count / N); a
    piece of L letters that the corpus lacks costs -ln(10 / (N * 10^L)), so a
    tag without any known word stays whole if it is not longer than
    ``longest``.  Null and empty tags are left out; a corpus of fewer than ten
    words counts as ten."""
    n = F.greatest(F.coalesce(counts.select(F.sum("count")).scalar(), F.lit(0)), F.lit(10)).cast("double")
    distinct = tags.select(F.col(tag_col).alias("tag")).where("tag <> ''").distinct()
    start = distinct.select("tag", F.explode(F.sequence(F.lit(0), F.length("tag") - 1)).alias("start"))
    piece = start.select("tag", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("tag") - F.col("start")))).alias("length"))
    piece = piece.withColumn("word", F.substring("tag", F.col("start") + 1, F.col("length")))
    known = F.log(n) - F.log(F.col("count").cast("double"))
    unknown = F.log(n) + (F.col("length") - 1) * F.log(F.lit(10.0))
    cost = F.round(F.coalesce(known, unknown) * UNIT).cast("long")
    pieces = (piece.join(counts, "word", "left").groupBy("tag")
              .agg(F.collect_list(F.struct("start", "length", cost.alias("cost"))).alias("pieces")))
    return pieces.mapInArrow(_cut, "tag string, words string, cost long")


def unpack_posts(posts: DataFrame, counts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """X11 in full: (id, text) with hashtags cut into words, contractions
    written out and the rest as ``normalise_post`` does it.  A hashtag is # and
    letters; its words come in lower case.  A null text is empty; every row of
    ``posts`` comes back once if ids are unique, empty ones too."""
    spaced = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")
    words = posts.select(F.col(id_col).alias("id"), F.posexplode(spaced).alias("place", "word"))
    tag = F.lower(F.regexp_extract("word", r"^#(\p{L}+)$", 1))
    plain = F.lower(F.replace("word", F.lit("’"), F.lit("'")))
    table = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])
    words = words.select("id", "place", "word", tag.alias("tag"), F.try_element_at(table, plain).alias("written"))
    cut = segment(words.where("tag <> ''"), counts).select("tag", "words")
    whole = (words.join(cut, "tag", "left").select("id", "place", F.coalesce("words", "written", "word").alias("word"))
             .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    return whole.select(F.col("id").alias(id_col), normalise_post(text).alias("text"))
