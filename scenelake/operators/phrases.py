"""Phrase tables met by equality: names of any number, no pattern per name.

A text is turned into the substrings that could be entries - runs of words of
the lengths that the table has, tokens, or stretches around blanks - and these
meet the table in one join. Only hits are grouped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.text import WORD, hyphenated_words

PIECE = f"[{WORD}]+|[^{WORD}]+"

# How an entry is found: as whole words, as one token that may carry hyphens, anywhere in the text.
WORDS, TOKEN, ANYWHERE = "words", "token", "anywhere"


def _pieces(text: Column) -> Column:
    """Runs of word characters and the runs between them."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def with_shape(phrases: DataFrame) -> DataFrame:
    """Add what the search needs to know of each entry: pieces, characters, and where its first blank is.

    ``phrases`` has ``phrase`` (lower case) and ``how``. Entries found as whole
    words must begin and end with a word character, those found anywhere must
    hold a blank; others raise an error. Null phrases are never found.
    """
    whole = F.col("phrase").rlike(f"(?s)^[{WORD}](.*[{WORD}])?$")
    sound = (F.col("how") == TOKEN) | ((F.col("how") == WORDS) & whole) | ((F.col("how") == ANYWHERE) & F.contains("phrase", F.lit(" ")))
    message = F.concat(F.lit("not a phrase that can be looked up: "), F.coalesce("phrase", F.lit("null")))
    return phrases.withColumns({
        "how": F.when(F.coalesce(sound, F.lit(False)), F.col("how")).otherwise(F.raise_error(message).cast("string")),
        "n_pieces": F.size(_pieces(F.col("phrase"))), "n_chars": F.length("phrase"), "blank": F.instr("phrase", F.lit(" "))})


def _runs(pieces: Column, sizes: Column) -> Column:
    """Concatenations of ``n`` pieces that begin and end with a word, for each n of ``sizes``."""
    places = F.sequence(F.lit(1), F.size(pieces))

    def of_size(n: Column) -> Column:
        starts = F.filter(places, lambda i: (i + n - 1 <= F.size(pieces)) & F.element_at(pieces, i).rlike(f"^[{WORD}]"))
        return F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, n), ""))

    return F.when(F.size(pieces) > 0, F.flatten(F.transform(sizes, of_size)))


def _around_blanks(text: Column, shapes: Column) -> Column:
    """Substrings whose first blank stands where that of an entry does, for each (blank, n_chars)."""
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)) == " ")
    return F.when(F.length(text) > 0, F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(shapes, lambda s: i >= s["blank"]), lambda s: F.substring(text, i - s["blank"] + 1, s["n_chars"])))))


def phrase_hits(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """(text, entry columns) for every entry of ``phrases`` (phrase, how, further columns) found in each distinct text.

    Matching ignores case. Null texts find nothing. A repeated text is searched
    once and an entry counts once per text, however often it occurs.
    """
    table = with_shape(phrases)
    sizes = table.where(F.col("how") == WORDS).agg(F.collect_set("n_pieces")).scalar()
    shapes = table.where(F.col("how") == ANYWHERE).agg(F.collect_set(F.struct("blank", "n_chars"))).scalar()
    distinct = texts.select(text).where(F.col(text).isNotNull()).distinct()
    low = distinct.withColumn("_low", F.lower(F.trim(F.col(text))))
    low = low.withColumns({"_pieces": _pieces(F.col("_low")), "_sizes": sizes, "_shapes": shapes})
    tagged = lambda how, grams: F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit(how).alias("how"), g.alias("phrase")))
    none = F.array().cast("array<struct<how:string,phrase:string>>")
    grams = F.concat(F.coalesce(tagged(WORDS, _runs(F.col("_pieces"), F.col("_sizes"))), none),
                     tagged(TOKEN, hyphenated_words(F.col("_low"))),
                     F.coalesce(tagged(ANYWHERE, _around_blanks(F.col("_low"), F.col("_shapes"))), none))
    rows = low.select(text, F.inline(grams))
    return rows.join(table.drop("n_pieces", "n_chars", "blank"), ["how", "phrase"])


def first_by(value: Column, order: str) -> Column:
    """The value of the entry that stands first in the table."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
