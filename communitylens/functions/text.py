"""Column expressions for text (X01-X24).  All are native Spark expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_whitespace(text) -> Column:
    """Lower + split on \\s+ with Java ``String.split`` semantics: a
    leading blank gives one empty token, trailing empty tokens are dropped,
    an all-blank non-empty text gives no token, the empty text one token."""
    t = F.lower(_c(text))
    r = F.regexp_replace(t, r"\s+$", "")
    return F.when((r == "") & (F.length(t) > 0), F.array().cast("array<string>")).otherwise(F.split(r, r"\s+"))


def collapse_whitespace(text) -> Column:
    """Runs of whitespace become one blank, then trim."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


# Fixed pattern values of the text extractors.
HASHTAG_PATTERN = r"\B#\w*[a-zA-Z]+\w*"
HASHTAG_HYPHEN_PATTERN = r"#[\w\-]+"


def extract_hashtags(text) -> Column:
    """Hashtags as written (with '#')."""
    return F.regexp_extract_all(_c(text), F.lit(HASHTAG_PATTERN), 0)


def extract_hashtags_hyphen(text) -> Column:
    """Hashtags incl. hyphens, without the '#'."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(HASHTAG_HYPHEN_PATTERN), 0), lambda h: F.substr(h, F.lit(2)))


def append_hashtag_words(text) -> Column:
    """The text with its hyphen-hashtags (hash removed) appended."""
    return F.concat_ws(" ", _c(text), F.array_join(extract_hashtags_hyphen(text), " "))


def trim_hash(tag) -> Column:
    """Drop one leading '#'."""
    return F.regexp_replace(_c(tag), r"^#", "")


def letters_only_tokens(text) -> Column:
    """Lower, non-letters become blanks, split, drop empty tokens."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(text)), r"[^a-z]+", " "), " "), lambda x: x != "")


def strip_retweet_prefix(text) -> Column:
    """lower-case and remove a leading 'rt '."""
    return F.regexp_replace(F.lower(_c(text)), r"^rt ", "")


def size_or_zero(arr) -> Column:
    """Number of values, 0 when the array is null."""
    return F.coalesce(F.size(_c(arr)), F.lit(0))


def null_safe_ratio(a, b) -> Column:
    """A / b, 0 when b is 0 or null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def harmonic_mean(a, b) -> Column:
    """2ab / (a + b), 0 when a + b is 0."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))


def screen_name_from_url(url) -> Column:
    """The text after the last '/'."""
    return F.substring_index(_c(url), "/", -1)


def r4(x) -> Column:
    """Reference output precision: 4 decimals."""
    return F.round(_c(x), 4)


# ---- X09 analyser -----------------------------------------------------------------------
import re  # noqa: E402
import unicodedata  # noqa: E402

from communitylens.functions.lexicons import ANALYSER_STOPWORDS, FOLD_MULTI, FOLD_SINGLE  # noqa: E402

TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"

#: Blocks whose letters and numbers fold to ASCII: Latin (all but the
#: modifier letters), superscripts and subscripts, circled numbers,
#: ligatures, full-width forms.
_FOLDED_BLOCKS = ((0xA0, 0x2B0), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2460, 0x2474), (0xFB00, 0xFB07), (0xFF10, 0xFF5B))
#: "LATIN SMALL LETTER B WITH STROKE": the letters that a name gives.
_NAMED = re.compile(r"LATIN (SMALL|CAPITAL) (?:LETTER|LIGATURE) (?:OPEN |TURNED |REVERSED |DOTLESS |SCRIPT )?([A-Z]{1,2})(?: WITH .*)?")


def fold_table() -> dict[str, str]:
    """Character -> ASCII letters: by its compatibility decomposition without
    marks, else by its Unicode name, else by the fixed values."""
    table = {}
    for c in map(chr, (i for block in _FOLDED_BLOCKS for i in range(*block))):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        named = _NAMED.fullmatch(unicodedata.name(c, ""))
        if not c.isalnum() or c.isascii():
            continue
        if base.isascii() and base.isalnum():
            table[c] = base
        elif named:
            table[c] = named[2].lower() if named[1] == "SMALL" else named[2]
    return table | FOLD_SINGLE | FOLD_MULTI


def fold_accents(text) -> Column:
    """ASCII folding of letters, numbers and apostrophes.  Other typographic
    signs separate tokens as they are, so they stay.  A text without a
    character that folds to several letters pays one pass."""
    table = fold_table()
    one = {a: b for a, b in table.items() if len(b) == 1}
    t = F.translate(_c(text), "".join(one), "".join(one.values()))
    several = {a: b for a, b in table.items() if len(b) > 1}
    whole = t
    for a, b in several.items():
        whole = F.replace(whole, F.lit(a), F.lit(b))
    return F.when(t.rlike("[" + "".join(several) + "]"), whole).otherwise(t)


def analyse_text(text) -> Column:
    """Standard tokens -> accent folding -> stopwords removed
    (case-insensitive) -> lower case."""
    toks = F.regexp_extract_all(fold_accents(text), F.lit(TOKEN_PATTERN), 0)
    return F.transform(F.filter(toks, lambda x: ~F.lower(x).isin(*ANALYSER_STOPWORDS)), lambda x: F.lower(x))


def normalise_post(text) -> Column:
    """X11: html entities fixed, 'RT' tokens and double quotes removed,
    *emphasis* and #hashtag marks unpacked, whitespace collapsed."""
    t = F.trim(_c(text))
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(^|\s)RT(\s|$)", "$1$2")
    t = F.regexp_replace(t, "\"", " ")
    t = F.regexp_replace(t, r"\*(\w+)\*", "$1")
    t = F.regexp_replace(t, r"#(\w+)", "$1")
    return collapse_whitespace(t)


def username_shape(name) -> list[Column]:
    """Number of letters, number of digits and the case class
    (1 all upper, 2 no upper, 3 mixed; no letters at all counts as 1), over
    all of Unicode's letters and digits."""
    n = _c(name)
    letters = F.length(F.regexp_replace(n, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(n, r"[^\p{Lu}]", ""))
    digits = F.length(F.regexp_replace(n, r"[^\p{Nd}]", ""))
    case = F.when(upper == letters, 1).when(upper == 0, 2).otherwise(3)
    return [letters.alias("n_alpha"), digits.alias("n_digits"), case.alias("case_class")]
