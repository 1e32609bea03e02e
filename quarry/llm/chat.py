"""Chat formatting after the collapse of cumulative snapshots.

Logged conversations are often snapshots: each holds all turns of an earlier one and some more. Every conversation gets
rolling hashes of its turn prefixes (128 bits, a running combination of hashes of place, role and text). A conversation
whose whole hash is the hash of a proper prefix of another is dropped by an anti join; of equal conversations the
smallest id stays. What remains is rendered as one text.

Turns stand in the order of turn, role and text (nulls first), and repeated rows are turns of their own. A null role or
text is rendered as an empty string but is not equal to one in the comparison. All rows with a null conv_id are one
conversation. Other columns are not read. An empty table gives an empty result. A conversation is one row of output, so
its turns meet in one task, where Spark sorts them, on disk if need be; a rendered text has to fit in a row (2 GB).
Turns are dealt by conversation once: hashes and rendering read the same exchange, all that follows holds no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(turns: DataFrame) -> DataFrame:
    """(conv, place, role, text): turns by their place. ``conv`` is conv_id in a struct, which is never null, so that joins
    by it are plain ones and keep the partitions that the windows need. Columns stand as the windows of ``rolling`` read
    them, so that all exchanges of turns are one."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return turns.select(F.struct("conv_id").alias("conv"), "role", "text", "turn").select("conv", F.row_number().over(order).alias("place"), "role", "text")


def rolling(turns: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, more): hashes of the conversation's first ``place`` turns, and whether others follow."""
    own = lambda seed: F.xxhash64(F.lit(seed), "place", F.isnull("role"), "role", F.isnull("text"), "text")
    hashed = _placed(turns).select("conv", "place", *(own(s).alias(f"h{s}") for s in (1, 2)))
    order = Window.partitionBy("conv").orderBy("place")
    kept = order.rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv", "place", *(F.bit_xor(f"h{s}").over(kept).alias(f"h{s}") for s in (1, 2)), F.lead("place").over(order).isNotNull().alias("more"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv): conversations that are no proper prefix of another one, one of each group of equal ones."""
    steps, key = rolling(turns), ["place", "h1", "h2"]
    # The smallest id of equal conversations, null only if there is no other.
    whole = steps.filter("not more").groupBy(*key).agg(F.min(F.struct(F.isnull("conv.conv_id"), "conv")).alias("least"))
    return whole.join(steps.filter("more").select(*key).distinct(), key, "left_anti").select("least.conv")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): each conversation as one text of marked turns."""
    return _rendered(_placed(turns))


def _rendered(placed: DataFrame) -> DataFrame:
    shown = placed.select("conv", "place", F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")).alias("t"))
    return shown.groupBy("conv").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", "t"))).alias("all")).select("conv.conv_id", "n_turns", F.array_join("all.t", "").alias("text"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of the maximal conversations of ``turns`` (conv_id, turn, role, text)."""
    return _rendered(_placed(turns).join(maximal(turns), "conv", "left_semi"))
