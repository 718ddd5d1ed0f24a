"""Fill-in-middle transformation by counted quantifiers.

``regexp_count`` gives a text's number of units n (code points, unless another pattern is given). Two numbers drawn
from the document's id cut the units into prefix, middle and suffix; a pattern made for the row, ``(unit{a}+)(unit{b-a}+)``
with possessive counts, captures all three in one match, and its replacement is the training text. Possessive counts
run in a loop, so texts of any length need no stack and no backtracking. Units are counted by whole blocks first, so
that counting holds as many strings as there are blocks, not units.

A text is left as it is (plain) if it is empty, holds a marker, is drawn to stay plain, or has something other than units
where its pattern wants them.
``restore`` gives back the text from the output and its form alone: a marker cannot arise where a piece meets another.

Null texts count as empty; a null id draws as an empty one. Equal rows are cut alike, each for itself. Texts must be valid
UTF-8. Extra columns are not looked at. Empty tables give empty tables. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed by the contract
POINT = "."  # a code point; patterns run with the flag that lets the dot match line ends
BLOCK = 1024  # units that are counted at once


def counted(text: Column, unit: str = POINT) -> Column:
    """How many units the text has."""
    block = f"(?s)(?:{unit}){{{BLOCK}}}+"
    blocks = F.regexp_count(text, F.lit(block)).cast("long")
    return blocks * BLOCK + F.regexp_count(F.regexp_replace(text, block, ""), F.lit(f"(?s){unit}"))


def draw(digest: Column, number: int) -> Column:
    """The digest's group of eight hexadecimal digits, from 1, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = POINT, seed: int = 1, plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """doc_id, text, n, form (psm, spm or plain), prefix_units, middle_units (null if plain) and the output.

    ``plain`` and ``suffix_first`` are per cent: of all texts, and of those that are cut.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.sha2(name, 256).alias("digest"))
    rows = rows.withColumn("n", counted(F.col("text"), unit))
    one, two = (F.pmod(draw(F.col("digest"), k), F.col("n") + 1) for k in (1, 2))
    rows = rows.withColumns({"low": F.least(one, two), "high": F.greatest(one, two)})

    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    stays = (F.col("n") == 0) | marked | (draw(F.col("digest"), 3) % 100 >= 100 - plain)
    drawn = F.when(stays, "plain").when(draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    pattern = F.format_string(rf"(?s)\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)(.*+)\z", "low", F.col("high") - F.col("low"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    rows = rows.withColumn("form", drawn).withColumn(
        "output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    )
    # a text that is not matched is not replaced
    form = F.when(F.col("output") == F.col("text"), "plain").otherwise(F.col("form"))
    cut = form != "plain"
    return rows.select(
        "doc_id", "text", "n", form.alias("form"),
        F.when(cut, F.col("low")).alias("prefix_units"), F.when(cut, F.col("high") - F.col("low")).alias("middle_units"), "output",
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
