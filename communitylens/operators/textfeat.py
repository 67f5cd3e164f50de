"""Text features over dictionaries (T05-T09) and the text vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.functions.text import append_hashtag_words, letters_only_tokens, HASHTAG_HYPHEN_PATTERN


def community_word_match(texts: DataFrame, id_col: str, text_col: str, word_dict: DataFrame) -> DataFrame:
    """Number of distinct communities whose words occur in the text,
    hashtag words appended; only texts with a hashtag are matched (others
    get 0)."""
    has_tag = F.col(text_col).rlike(HASHTAG_HYPHEN_PATTERN)
    toks = (texts.filter(has_tag)
            .select(id_col, F.explode(F.array_distinct(letters_only_tokens(append_hashtag_words(text_col)))).alias("word")))
    m = word_groups(toks, word_dict, id_col, "community").select(id_col, F.size("values").cast("bigint").alias("n"))
    out = texts.select(id_col).join(m, id_col, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(id_col, (n > 0).alias("has_match"), n.alias("n_communities"))


from pyspark.sql import Window  # noqa: E402

from communitylens.functions.lexicons import TEXT_STOPWORDS  # noqa: E402
from communitylens.operators.joins import word_groups  # noqa: E402
from communitylens.operators.windows import global_row_number  # noqa: E402
from communitylens.session import scratch_path  # noqa: E402


def text_tokens(text_col, drop_stopwords: bool = True, min_len: int = 1):
    """X10 tokens, optionally without the text stopwords and short tokens."""
    t = letters_only_tokens(text_col)
    if drop_stopwords:
        # a long literal IN list becomes a hash-set probe (InSet) in codegen
        t = F.filter(t, lambda x: ~x.isin(*TEXT_STOPWORDS))
    if min_len > 1:
        t = F.filter(t, lambda x: F.length(x) >= min_len)
    return t


def token_rows(df: DataFrame, keys, text_col, out: str = "term", drop_stopwords: bool = True, min_len: int = 1) -> DataFrame:
    """``text_tokens`` as rows beside ``keys``: words are cut, exploded and
    then filtered as plain columns, all in one generated stage, instead of
    through array lambdas."""
    word = F.col(out)
    rows = df.select(*keys, F.explode(F.split(F.regexp_replace(F.lower(text_col), r"[^a-z]+", " "), " ")).alias(out))
    keep = (F.length(word) >= min_len) if min_len > 1 else (word != "")
    return rows.filter(keep & ~word.isin(*TEXT_STOPWORDS) if drop_stopwords else keep)


def class_word_frequency(docs: DataFrame, class_col: str, text_col: str) -> DataFrame:
    """(class, word, freq) over all texts of a class; stopwords and
    tokens shorter than 2 removed."""
    return (token_rows(docs, [F.col(class_col).alias("class")], F.col(text_col), "word", min_len=2)
            .groupBy("class", "word").agg(F.count(F.lit(1)).alias("freq")))


def top_per_class(df: DataFrame, value_col: str, n: int) -> DataFrame:
    w = Window.partitionBy("class").orderBy(F.col(value_col).desc(), F.col("word").asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def class_word_score(freq: DataFrame) -> DataFrame:
    """Equation 1, f(w,l) / sum_l f(w,l); words of a single class
    (score 1.0) removed.  The per-word total is a group-by joined back (no
    window over a hot word)."""
    tot = freq.groupBy("word").agg(F.sum("freq").alias("total"))
    return (freq.join(tot, "word").select("class", "word", (F.col("freq") / F.col("total")).alias("score"))
            .filter(F.col("score") != 1.0))


def class_word_goodness(pass1: DataFrame) -> DataFrame:
    """Within the pass-1 lists: f(w,l)/sum_labels f(w,.) * f(w,l)/sum_words f(.,l)."""
    # read three times: a few rows a class, kept so that the texts are counted once
    pass1 = pass1.checkpoint()
    by_word = pass1.groupBy("word").agg(F.sum("freq").alias("fw"))
    by_label = pass1.groupBy("class").agg(F.sum("freq").alias("fl"))
    return (pass1.join(by_word, "word").join(by_label, "class")
            .select("class", "word", ((F.col("freq") / F.col("fw")) * (F.col("freq") / F.col("fl"))).alias("score")))


def proto_terms(items: DataFrame, n: int = 100, min_df: int = 2) -> DataFrame:
    """T04 over (class, doc, term) rows: equation-1 score with document
    frequency >= 2 and score < 1, top n per class."""
    freq = items.groupBy("class", F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    df = items.groupBy(F.col("term").alias("word")).agg(F.count_distinct("doc").alias("df"))
    sc = class_word_score(freq).join(df.filter(F.col("df") >= min_df), "word").filter(F.col("score") < 1.0)
    return top_per_class(sc, "score", n).select("class", "word", "score", "rank")


def dictionary_match(user_tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(user, dict, score_sum, match_count, max_score, any_match) over
    the *set* of the user's tokens, a row for every user and dictionary
    (zeros without a match), whatever dictionaries there are.

    The texts are cut into words once: a user's words that no dictionary has
    count as one null, so that only entries are gathered and kept."""
    entries = dictionary.select(F.col("word").alias("_entry")).distinct()
    seen = (user_tokens.select("user", "word").join(F.broadcast(entries), F.col("word") == F.col("_entry"), "left")
            .select("user", F.col("_entry").alias("word")).distinct().checkpoint())
    toks = seen.filter(F.col("word").isNotNull())
    m = toks.join(dictionary.select(F.col("class").alias("dict"), "word", "score"), "word")
    g = m.groupBy("user", "dict").agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("match_count"),
                                      F.max("score").alias("max_score"))
    return (with_all_dictionaries(seen, dictionary.select(F.col("class").alias("dict")))
            .join(g, ["user", "dict"], "left").na.fill(0)
            .withColumn("any_match", (F.col("match_count") > 0).cast("int")))


def with_all_dictionaries(user_tokens: DataFrame, dicts: DataFrame) -> DataFrame:
    """(user, dict) for every user and dictionary: the list of dictionary
    names is one row, exploded beside each user."""
    names = dicts.agg(F.array_sort(F.collect_set("dict")).alias("names")).select("names").scalar()
    return user_tokens.select("user").distinct().select("user", F.explode(names).alias("dict"))


def entry_shares(user_tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(user, dictionary, entry, share, n_entries).  A row with entry
    null for every user and dictionary: the share of the user's tokens that
    are entries (0 without a hit) and the number of different entries; and a
    row for each entry that occurs: its relative frequency."""
    n = user_tokens.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    hits = (user_tokens.join(dictionary.select("dictionary", "word"), "word").groupBy("user", "dictionary", "word")
            .agg(F.count(F.lit(1)).alias("hits")).join(n, "user"))
    entries = hits.select("user", "dictionary", F.col("word").alias("entry"), (F.col("hits") / F.col("n")).alias("share"),
                          F.lit(1).cast("bigint").alias("n_entries"))
    totals = hits.groupBy("user", "dictionary").agg((F.sum("hits") / F.first("n")).alias("share"),
                                                    F.count(F.lit(1)).alias("n_entries"))
    every = with_all_dictionaries(user_tokens, dictionary.select(F.col("dictionary").alias("dict")))
    zeros = (every.withColumnRenamed("dict", "dictionary").join(totals, ["user", "dictionary"], "left").na.fill(0)
             .select("user", "dictionary", F.lit(None).cast("string").alias("entry"), "share", "n_entries"))
    return entries.unionByName(zeros)


def gazetteer_match(user_tokens: DataFrame, lists: DataFrame, names=("title", "profession")) -> DataFrame:
    """Per user and list of ``lists`` (list, word) a 0/1 flag (a token is
    in the list; professions also match tokens ending in 'ist')."""
    hits = (user_tokens.join(lists, "word").select("user", "list")
            .unionByName(user_tokens.filter(F.col("word").endswith("ist")).select("user", F.lit("profession").alias("list")))
            .distinct())
    flags = hits.groupBy("user").agg(*[F.max((F.col("list") == n).cast("int")).alias(f"has_{n}") for n in names])
    return user_tokens.select("user").distinct().join(flags, "user", "left").na.fill(0)


def tfidf(doc_terms: DataFrame, n_docs, min_df: int = 2, max_df: float = 0.501,
          max_features: int = 10_000) -> DataFrame:
    """T11 over (doc, term) rows (one per occurrence): terms with df >= min_df
    and df <= max_df * N, the max_features most frequent (ties: term asc);
    weight = tf * (ln(N / df) + 1), no normalisation.  Output sparse
    (doc, term, tf, weight).  ``n_docs`` (N) is the number of documents of
    the corpus, empty ones included (a scalar column)."""
    # read three times below: kept once, so texts are cut into words once
    tf = doc_terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).checkpoint()
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df)))
    # the most frequent terms by a range-partitioned rank: nothing is merged in one task
    top = (global_row_number(kept, [F.col("cf").desc(), F.col("term").asc()])
           .filter(F.col("row_number") <= max_features))
    idf = F.log(n_docs.cast("double") / F.col("df")) + 1.0
    return (tf.join(top.select("term", "df"), "term")
            .select("doc", "term", "tf", F.round(F.col("tf") * idf, 6).alias("weight")))


def skipgram_offsets(n: int, k: int):
    """Offsets (0, a1, ..., a_{n-1}) of the n-token grams inside a window of
    n + k tokens with the first token fixed (0 .. k skips)."""
    from itertools import combinations
    return [(0,) + c for c in combinations(range(1, n + k), n - 1)]


def skipgram_rows(docs: DataFrame, tokens: str, shapes) -> DataFrame:
    """(shape, doc, term) for all k-skip-n-grams of the token arrays, for
    every (n, k) of ``shapes`` in one pass.  A token makes one short array, the
    grams that begin with it; grams never gather in one array of the text."""
    t, i = F.col(tokens), F.col("_i")
    grams = [F.struct(F.lit(f"n{n}k{k}").alias("shape"),
                      F.when(i + offs[-1] < F.size(t), F.concat_ws(" ", *[F.try_element_at(t, i + 1 + o) for o in offs])).alias("term"))
             for n, k in shapes for offs in skipgram_offsets(n, k)]
    starts = docs.select("doc", tokens, F.posexplode(t).alias("_i", "_w"))
    return (starts.select("doc", F.explode(F.array(*grams)).alias("g")).select("g.shape", "doc", "g.term")
            .filter(F.col("term").isNotNull()))


def vocabulary(doc_terms: DataFrame, n_docs, max_df: float = 0.99, max_features: int = 500_000) -> DataFrame:
    """Kept terms (df <= max_df * N, the max_features most frequent)
    indexed 0.. in alphabetical order, as the vectoriser numbers them."""
    stats = doc_terms.groupBy("term").agg(F.count_distinct("doc").alias("df"), F.count(F.lit(1)).alias("cf"))
    kept = stats.filter(F.col("df") <= n_docs * F.lit(max_df)).select("term", "cf")
    # the max_features most frequent terms via a range-partitioned global
    # rank (no single-task merge of k rows per partition)
    by_freq = global_row_number(kept, [F.col("cf").desc(), F.col("term").asc()])
    top = by_freq.filter(F.col("row_number") <= max_features).drop("row_number")
    ranked = global_row_number(top, ["term"])
    return ranked.select(F.col("term").alias("word"), (F.col("row_number") - 1).alias("index"), F.col("cf").alias("count"))


def save_vocabulary(words: DataFrame, path: str) -> None:
    """A vocabulary (word, index, count) kept for later runs."""
    words.select("word", "index", "count").write.mode("overwrite").parquet(path)


def token_places(df: DataFrame, keys, text_col) -> DataFrame:
    """``token_rows`` with the place of each token in its text."""
    rows = df.select(*keys, F.posexplode(F.split(F.regexp_replace(F.lower(text_col), r"[^a-z]+", " "), " ")).alias("place", "term"))
    return rows.filter((F.col("term") != "") & ~F.col("term").isin(*TEXT_STOPWORDS))


def index_sequences(places: DataFrame, words: DataFrame, keys) -> DataFrame:
    """(keys, sequence) with the vocabulary indexes of a document's words
    in order; words outside the vocabulary are skipped, and a document
    without any word of it has no row.  ``words`` goes to every task: a
    ``vocabulary`` has ``max_features`` rows at most, whatever the corpus."""
    hit = places.join(F.broadcast(words.select(F.col("word").alias("term"), F.col("index").cast("int").alias("index"))), "term")
    whole = hit.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "index"))).alias("w"))
    return whole.select(*keys, F.transform("w", lambda x: x["index"]).alias("sequence"))


def tfidf_of_groups(items: DataFrame, by: str, n_docs, min_df: int = 2, max_df: float = 0.501,
                    max_features: int = 10_000) -> DataFrame:
    """``tfidf`` of several groups of (``by``, doc, term) rows at once: every
    group has its own terms, statistics and ``max_features``, all from one
    aggregate and one range-partitioned rank."""
    tf = items.groupBy(by, "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _weights_of_groups(tf, by, n_docs, min_df, max_df, max_features)


def _weights_of_groups(tf: DataFrame, by: str, n_docs, min_df: int = 2, max_df: float = 0.501,
                       max_features: int = 10_000) -> DataFrame:
    """The weights of counted (``by``, doc, term, tf) rows."""
    # read twice: kept as Parquet, where a term is a number of a column's dictionary
    path = scratch_path(tf.sparkSession, f"counts-{uuid.uuid4().hex[:12]}")
    tf.write.parquet(path)
    tf = tf.sparkSession.read.schema(tf.schema).parquet(path)
    stats = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df)))
    ranked = global_row_number(kept, [F.col(by), F.col("cf").desc(), F.col("term").asc()])
    first = ranked.groupBy(by).agg(F.min("row_number").alias("_first"))
    top = ranked.join(first, by).filter(F.col("row_number") < F.col("_first") + max_features)
    idf = F.log(n_docs.cast("double") / F.col("df")) + 1.0
    # max_features terms a group: they go to the counts, which do not move again
    return (tf.join(F.broadcast(top.select(by, "term", "df")), [by, "term"])
            .select(by, "doc", "term", "tf", F.round(F.col("tf") * idf, 6).alias("weight")))


#: Cells of a group's sketch of term counts.
SKETCH_CELLS = 1 << 20


def _frequent_candidates(items: DataFrame, by: str, n_docs, min_df: int, max_df: float, max_features: int, cells: int) -> DataFrame:
    """(by, term, df, cf) of eligible terms, among them each group's
    ``max_features`` most frequent ones.

    A cell counts the terms of one hash, so it bounds the count of each of
    them.  Terms of the heaviest cells are counted exactly first; a term
    outside matters only if its cell reaches the last place found there, and
    a second count takes all such cells."""
    cell = F.xxhash64(by, F.pmod(F.xxhash64("term"), F.lit(cells))).alias("cell")
    bounds = items.select(by, cell).groupBy(by, "cell").agg(F.count(F.lit(1)).alias("bound")).checkpoint()

    def counted(heavy):
        some = items.select(by, "doc", "term", cell).join(F.broadcast(heavy.select("cell").distinct()), "cell", "left_semi")
        tf = some.groupBy(by, "doc", "term").agg(F.count(F.lit(1)).alias("tf"))
        stats = tf.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        return stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df))).checkpoint()

    def nth(df, value, n):
        """(by, last): the n-th largest value of a group, none if there are fewer."""
        w = Window.partitionBy(by).orderBy(F.col(value).desc())
        return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == n).select(F.col(by).alias("_by"), F.col(value).alias("last"))

    def reaching(last):
        return bounds.join(F.broadcast(last), F.col(by).eqNullSafe(F.col("_by")), "left").filter(F.col("bound") >= F.coalesce("last", F.lit(0)))
    first = nth(bounds, "bound", 2 * max_features).checkpoint()
    found = counted(reaching(first))
    last = nth(found, "cf", max_features).checkpoint()
    missed = reaching(last).join(F.broadcast(first.withColumnRenamed("last", "from").withColumnRenamed("_by", "_group")),
                                 F.col(by).eqNullSafe(F.col("_group")), "left").filter(F.col("bound") < F.coalesce("from", F.lit(0)))
    return found if missed.isEmpty() else counted(reaching(last))


def tfidf_of_many(items: DataFrame, by: str, n_docs, min_df: int = 2, max_df: float = 0.501,
                  max_features: int = 10_000, cells: int = SKETCH_CELLS) -> DataFrame:
    """``tfidf_of_groups`` where most of the terms are rare, such as the grams
    of a text: the same rows, but only terms that can be among the
    ``max_features`` are gathered; ``items`` is made anew for each count.
    Rows of ``items`` that lie by ``doc`` are counted without a shuffle."""
    kept = _frequent_candidates(items, by, n_docs, min_df, max_df, max_features, cells)
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("cf").desc(), "term")))
    top = ranked.filter(F.col("_n") <= max_features).select(by, "term", "df").checkpoint()
    idf = F.log(n_docs.cast("double") / F.col("df")) + 1.0
    # the document frequency goes along with the term: it is the same in all rows of a gram
    tf = items.join(F.broadcast(top), [by, "term"]).groupBy(by, "doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("df").alias("df"))
    return tf.select(by, "doc", "term", "tf", F.round(F.col("tf") * idf, 6).alias("weight"))


def tfidf_by_column(items: dict, n_docs, **options) -> DataFrame:
    """T11 over several text columns side by side: (column, doc, term, tf,
    weight); each column has its own terms and statistics.  ``items`` maps a
    column's name to its (doc, term) rows; rows that lie by ``doc`` are
    counted where they are made."""
    tf = None
    for name, part in items.items():
        part = part.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).select(F.lit(name).alias("column"), "doc", "term", "tf")
        tf = part if tf is None else tf.unionByName(part)
    return _weights_of_groups(tf, "column", n_docs, **options)
