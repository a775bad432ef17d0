"""Which texts contain which reference values: an inverted index on the rarest token of each value.

A text that holds a value holds every whole token within it, so it is looked up by that one of these
tokens that the fewest texts have; the pairs found are then compared. Tokens at either end of a value
may be parts of longer ones in the text, and aren't used; values without a token between two others
are compared with all texts, in blocks.

Values of up to ``SMALL`` bytes in all are sent to where the texts are, so that neither texts nor their
tokens are moved. With more of them, tokens that very many texts have are joined apart, by a broadcast
whose size that very share bounds, and texts are moved once, to their own candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts tokens; all else is a token.
BLANKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tokens that at least one in so many (text, token) pairs has are joined by broadcast: there are no more of them.
HOT = 512
#: Values without a whole token within that one pass over the texts compares.
BLOCK = 500
#: Bytes of values, with their tokens, that every executor can hold.
SMALL = 16 << 20


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def inner_tokens(value: Column) -> Column:
    """The tokens that are whole in every text that holds the value: those with something that parts tokens on
    both sides."""
    parts = F.split(value, BLANKS)
    # The first part is empty if the value begins with what parts tokens, and so with the last.
    return F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda t: t != ""))


def leak_join(texts: DataFrame, values: DataFrame, *, key: str, text: str, value_key: str, value: str) -> DataFrame:
    """(key, value_key) of all pairs in which the text contains the value, each once.

    Null and empty texts hold nothing; null and empty values are held by nothing; rows with a null key are
    left out. Rows of one key are looked at together. Empty tables have no pairs."""
    spark = texts.sparkSession
    docs = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t <> ''")
    refs = values.select(F.col(value_key).alias("v"), F.col(value).alias("w")).where("v is not null and w <> ''").distinct()
    refs = refs.withColumn("tokens", inner_tokens(F.col("w")))
    indexed, rest = refs.where(F.size("tokens") > 0), refs.where(F.size("tokens") == 0).select("v", "w")

    token = F.explode(F.array_distinct(_tokens(F.col("t")))).alias("token")
    each = docs.select("k", token)
    # Counted where the texts are, those of one key apart: it is only to tell which is rarest.
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    by_token = indexed.select("v", "w", F.explode("tokens").alias("token"))
    known = by_token.join(counts, "token", "left")
    # A value with a token that no text has is in none.
    rarest = known.groupBy("v", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).where("r.n > 0").select("v", "w", "r.token", "r.n")
    if (refs.agg(F.sum(F.octet_length("w") + 64)).first()[0] or 0) <= SMALL:
        near = F.broadcast(rarest.select("v", "w", "token"))
        found = docs.select("k", "t", token).join(near, "token").where(F.col("t").contains(F.col("w"))).select("k", "v")
    else:
        looked_up = rarest.select("token", "n").distinct()
        total = looked_up.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(looked_up.where(F.col("n") * HOT >= total).select("token"))
        spread = each.join(hot, "token", "left_anti").join(rarest.where(F.col("n") * HOT < total).select("v", "w", "token"), "token")
        # At most HOT tokens, each with the values that have it as their rarest.
        common = each.join(hot, "token").join(rarest.where(F.col("n") * HOT >= total).select("v", "w", "token"), "token")
        pairs = spread.unionByName(common).select("k", "v", "w").distinct()
        found = pairs.join(docs, "k").where(F.col("t").contains(F.col("w"))).select("k", "v")

    blocks = spark.createDataFrame([], found.schema)
    block: list[tuple] = []
    for row in [*rest.orderBy("v", "w").toLocalIterator(), None]:
        if row is not None:
            block.append(tuple(row))
        if block and (row is None or len(block) == BLOCK):
            held = F.array(*[F.when(F.col("t").contains(F.lit(w)), F.lit(v)) for v, w in block])
            blocks = blocks.unionByName(docs.select("k", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("v")))
            block = []
    return found.unionByName(blocks).distinct().select(F.col("k").alias(key), F.col("v").alias(value_key))
