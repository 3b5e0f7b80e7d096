"""Fill-in-the-middle: a text is cut in three and rearranged so that its middle comes last.

All of it is built-in column functions in one pass without a shuffle. A text is an array of units (a run of the
letters A-Z and a-z, or any other single character), so no word is cut. Where it is cut, and whether it is rearranged
at all, follows from the SHA-256 of the document's id and the seed: the same document gives the same output in any
job, whatever its partition.

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle        plain: the text

Each marker occurs exactly once in an arrangement: a text that contains one stays plain, and as a marker's only "<" is
its first character and its only ">" its last, no marker can arise where a piece and a marker meet. So
:func:`restored` gets the text back by looking for the markers.

Defined results: a null text is empty; an empty text is plain with 0 units; a text of one unit has pieces that are
empty; a null doc_id hashes as the empty string after the seed; rows that repeat get the same output each; an empty
table gives no rows; a text of any length is one array of its units, at most 2 GB in all; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those rearranged; of a hundred of these, those with the suffix first.
FIM_PERCENT = 90
SPM_PERCENT = 20


def draws(doc_id: Column, seed: int, n: int) -> list[Column]:
    """n unsigned 32-bit integers of a document, at most 8."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(n)]


def _between(text: Column, after: str, before: str) -> Column:
    """What stands between two markers that occur once each."""
    return F.substring_index(F.substring_index(text, before, 1), after, -1)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    psm = F.concat(_between(output, PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rearrange(docs: DataFrame, seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output of every row of docs."""
    names = ("h1", "h2", "h3", "h4")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = read.withColumn("units", F.regexp_extract_all("text", F.lit(UNITS), F.lit(0))).withColumns(dict(zip(names, draws(F.col("doc_id"), seed, 4), strict=True)))
    size = F.size("units")
    one, two = (F.pmod(F.col(h), size + 1).cast("int") for h in names[:2])
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.pmod("h3", F.lit(100)) >= fim_percent)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm_percent, "spm").otherwise("psm")
    placed = cut.select("doc_id", "text", "units", size.cast("bigint").alias("n"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    pieces = placed.select(
        "doc_id",
        "text",
        "n",
        "form",
        piece(F.lit(1), F.col("a")).alias("prefix"),
        piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        piece(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return pieces.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
