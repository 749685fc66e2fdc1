"""Lexical retrieval from one catalog of any size, shared by all queries.

Scoring every tool for every query would be a cross join. Here tools are found
by postings of their tokens, rarest first. Both sides are reduced to distinct
sets of tokens before anything meets: tools with equal tokens score alike, so
the first ``k`` of them stand for all.

The rarest token of a query, and others while their postings are few (``READ`` in
all), give candidates; these are scored in full. A set that none of
them holds shares at most the tokens left over. Where the k-th best score is
above that bound, the answer is final; all other queries read further tokens
until fewer than that score are left, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..session import checkpointed

READ = 500  #: sets that a query's rare tokens may bring up in the first pass; its rarest one is read in any case


def _sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set, tokens): a digest of each row's distinct tokens, and these, sorted; rows without tokens are left out."""
    tokens = F.array_sort(lexical_tokens(F.coalesce(F.col(text), F.lit(""))))
    return rows.select(F.col(key).alias("key"), tokens.alias("tokens")).filter(F.size("tokens") > 0).withColumn("set", F.md5(F.array_join("tokens", " ")))


def _scored(pairs: DataFrame, asked: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(set, tool, score) of the ``k`` best tools of each query set among (set, tools) pairs.

    A set of tools stands where its first tool does, so the ``k`` best sets
    hold the ``k`` best tools; only these sets' tools are listed.
    """
    both = pairs.join(asked.select("set", "tokens"), "set").join(kept.select(F.col("set").alias("tools"), F.col("tokens").alias("own"), F.element_at("firsts", 1).alias("tool")), "tools")
    each = both.select("set", "tools", F.size(F.array_intersect("tokens", "own")).alias("score"), "tool")
    w = Window.partitionBy("set").orderBy(F.desc("score"), "tool")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    sets = best(each).select("set", "tools", "score").join(kept.select(F.col("set").alias("tools"), "firsts"), "tools")
    return best(sets.select("set", "score", F.explode("firsts").alias("tool")))


def retrieve_global(queries: DataFrame, catalog: DataFrame, k: int = 5, query: str = "query_id", tool: str = "tool_id", text: str = "text") -> DataFrame:
    """(query, rank, tool, score): for each query the ``k`` tools of the whole catalog with the most tokens in common, ties to the smaller tool.

    Tools without a token in common are not returned, so a query may have
    fewer, or no, rows. Null texts have no tokens. Rows that repeat a query's
    key and text have their rows repeated; a tool that is listed more often is
    returned as often.
    """
    asked_rows, tools = _sets(queries, query, text), _sets(catalog, tool, text)
    first = Window.partitionBy("set").orderBy("key")
    # Of tools with equal tokens no more than k can be among the best.
    few = tools.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    kept = checkpointed(few.groupBy("set", "tokens").agg(F.array_sort(F.collect_list("key")).alias("firsts")))
    asked = checkpointed(asked_rows.select("set", "tokens").distinct())

    postings = kept.select(F.explode("tokens").alias("token"), F.col("set").alias("tools"))
    found = asked.select("set", F.explode("tokens").alias("token")).join(postings.groupBy("token").agg(F.count("*").alias("n")), "token")
    rare = Window.partitionBy("set").orderBy("n", "token")
    cost = F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(rare)
    by_rarity = checkpointed(found.withColumn("place", place).withColumn("read", (cost <= READ) | (F.col("place") == 1)))
    held = by_rarity.groupBy("set").agg(F.count("*").alias("size"), F.count_if(~F.col("read")).alias("unread"))
    pairs = by_rarity.filter("read").join(postings, "token").select("set", "tools").distinct()
    best = checkpointed(_scored(pairs, asked, kept, k))

    # To be as good as the k-th best a set must hold one of so many of the rarest tokens that fewer than its score are left.
    reached = best.groupBy("set").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    least = F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(1))
    open_sets = held.join(reached, "set", "left").select("set", "unread", (F.col("size") - least + 1).alias("enough"), least.alias("bound")).filter(F.col("unread") >= F.col("bound")).select("set", "enough")
    again = by_rarity.join(open_sets, "set").filter(F.col("read") | (F.col("place") <= F.col("enough"))).join(postings, "token").select("set", "tools").distinct()
    answers = best.join(open_sets.select("set"), "set", "left_anti").unionByName(_scored(again, asked, kept, k))
    return asked_rows.select("key", "set").join(answers, "set").select(F.col("key").alias(query), "rank", F.col("tool").alias(tool), "score")
