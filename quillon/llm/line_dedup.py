"""Line dedup with DataFrame functions alone: drop lines that many documents hold, keep one copy of each.

Lines are normalised and hashed to 128 bits; each document's distinct hashes are counted with map-side sums; the
positions of lines whose hash enough documents hold are gathered by document, which is put together again by position. A document is an id: each (hash, id) counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: space and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case.

    lower() is the same for a line of ASCII and much faster; it changes other letters too, so other lines go by
    translate().
    """
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line of text the 128-bit hash of its key, null where the key is shorter than min_chars."""
    keys = F.transform(F.split(text, "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(7), k).alias("g"))))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from ``text`` and, added, ``n_lines`` (before) and ``n_dropped``.

    A line's key is :func:`line_key`. Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except those in the largest ``id_col`` holding them. A null or empty text is one
    empty line and becomes ''. Rows that repeat an id are one document and count once; they keep a line together if
    that id is the largest holding it. Rows whose id is null are kept whole, and their lines count for nothing. Columns of
    docs called n_lines or n_dropped are replaced; names that start with ``__`` are reserved.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__t", F.xxhash64(F.lit(3), text))
    hashed = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__d"), "__t", line_hashes(text, min_chars).alias("__hs"))
    frequent = (
        hashed.select("__d", F.explode(F.array_distinct(F.filter("__hs", lambda x: x.isNotNull()))).alias("__x"))
        .select("__d", F.col("__x.h").alias("__h"), F.col("__x.g").alias("__g"))
        .distinct()  # once a document
        .groupBy("__h", "__g")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__d").alias("__keep"))
        .filter(F.col("__n") >= min_docs)
        .drop("__n")
    )
    lines = (
        hashed.select("__d", "__t", F.posexplode("__hs").alias("__i", "__x"))
        .filter(F.col("__x").isNotNull())
        .select("__d", "__t", "__i", F.col("__x.h").alias("__h"), F.col("__x.g").alias("__g"))
    )
    dropped = (
        salted_join(lines, frequent, ["__h", "__g"], "__d")
        .filter(F.col("__d") < F.col("__keep"))
        .groupBy("__d", "__t")
        .agg(F.collect_set("__i").alias("__drop"))  # positions within one text
    )
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    joined = rows.join(dropped, (rows[id_col] == dropped["__d"]) & (rows["__t"] == dropped["__t"]), "left").drop(dropped["__t"])
    return (
        joined.withColumn("__lines", F.split(text, "\n", -1))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.size(drop).cast("long"))
        .withColumn(
            text_col,
            F.when(F.col("__drop").isNull(), text).otherwise(
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), drop), lambda i: F.element_at("__lines", i + 1)), "\n")
            ),
        )
        .select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")
    )
