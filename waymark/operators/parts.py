"""An index for "is part of", both ways: which texts hold a token, and which texts a token holds. Equi-joins on character grams; no text meets tokens that it can't match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Least length of the tokens that are looked up, and the length of grams that longer ones are found by.
SHORT, LONG = 2, 3


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters; none in a shorter text."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def own_grams(text: Column) -> Column:
    """What a text is found by: its grams of LONG characters, or the whole text if it is shorter."""
    return F.when(F.length(text) >= LONG, grams(text, LONG)).otherwise(F.array(text))


@dataclass
class PartIndex:
    """Stored tables over the distinct texts of a column: texts (text_id, text), postings (gram, text_id), uses (gram, uses) and keys (gram, text_id), which has one row for each text."""

    texts: DataFrame
    postings: DataFrame
    uses: DataFrame
    keys: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, text: str) -> PartIndex:
        """The index of the texts in a column; nulls have none."""
        texts = stored(rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().select(F.monotonically_increasing_id().alias("text_id"), "text"), "texts")
        postings = stored(texts.select("text_id", F.explode(F.concat(grams(F.col("text"), SHORT), grams(F.col("text"), LONG))).alias("gram")), "postings")
        uses = stored(postings.groupBy("gram").agg(F.count("*").alias("uses")), "uses")
        own = texts.select("text_id", F.explode(own_grams(F.col("text"))).alias("gram"))
        # texts under SHORT characters have no postings, and one gram to choose from
        keys = own.join(uses, "gram", "left").groupBy("text_id").agg(F.min_by("gram", F.struct(F.coalesce("uses", F.lit(0)), "gram")).alias("gram"))
        return cls(texts, postings, uses, stored(keys, "keys"))

    def holding(self, tokens: DataFrame, token: str) -> DataFrame:
        """token and text of all texts that hold a token of SHORT characters or more. A token meets the postings of its rarest gram."""
        asked = tokens.where(F.length(token) >= SHORT).select(F.col(token).alias("token")).distinct()
        counted = asked.select("token", F.explode(own_grams(F.col("token"))).alias("gram")).join(self.uses, "gram", "left")
        rarest = counted.groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("uses", F.lit(0)), "gram")).alias("gram"))
        return rarest.join(self.postings, "gram").join(self.texts, "text_id").where(F.col("text").contains(F.col("token"))).select("token", "text")

    def held(self, tokens: DataFrame, token: str) -> DataFrame:
        """token and text of all texts that a token holds. A text is met under its rarest gram alone; an empty text is part of every token."""
        asked = tokens.where(F.col(token).isNotNull()).select(F.col(token).alias("token")).distinct()
        t = F.col("token")
        every = F.array_distinct(F.concat(F.array(F.lit("")), *[grams(t, n) for n in range(1, LONG + 1)]))
        return asked.select("token", F.explode(every).alias("gram")).join(self.keys, "gram").join(self.texts, "text_id").where(t.contains(F.col("text"))).select("token", "text")
