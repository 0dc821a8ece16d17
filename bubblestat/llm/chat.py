"""Chat formatting: logged snapshots collapse into the conversations they grew to, which are then rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut


def rendered(turns: DataFrame, before: str = "<|im_start|>", after: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, text): one row for each maximal conversation of turns (conv_id, turn, role, text).

    A conversation goes if its turns, as a whole, are how a longer one begins; of equal ones that of the least conv_id stays. Turns are ordered by
    turn (null first), ties by role and text; null role and text count as empty. Repeated rows are turns of their own. Rows of a null
    conv_id are one conversation. Other columns are ignored. Empty table: empty result.

    Each prefix is told by two rolling hashes, 128 bits: the XOR, so far, of hashes that hold a turn's place. Prefixes and whole
    conversations are made distinct before the anti-join, so a first turn or a conversation that very many logs share is one row there. Turns are
    rendered once, for what is left; a conversation is one row of the result, so its turns meet in one task.
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.select("*", F.row_number().over(order).alias("k"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    hashes = placed.select("conv_id", "turn", "role", "text", "k", "last", F.xxhash64("k", "role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role", "k").alias("b"))
    rolled = hashes.select("conv_id", "k", "last", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    prefixes = cut(rolled, "chat")
    key = ["k", "a", "b"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    left = whole.join(prefixes.where("not last").select(*key).distinct(), key, "left_anti").select(F.col("conv_id").alias("kept_id"))
    kept = own.join(left, own.conv_id.eqNullSafe(F.col("kept_id")), "left_semi")
    said = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")))
    one = lambda t: F.concat(F.lit(before), t["role"], F.lit("\n"), t["text"], F.lit(f"{after}\n"))
    return kept.groupBy("conv_id").agg(said.alias("t")).select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", one), "").alias("text"))


#: DuckDB: the same by comparing rendered prefixes as text.
SQL = """
WITH t AS (
    SELECT conv_id, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations
), p AS (
    SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY k) AS text
    FROM t
), m AS (
    SELECT min(conv_id) AS conv_id, n, text FROM p WHERE k = n GROUP BY n, text
)
SELECT conv_id, n AS n_turns, text FROM m
WHERE (n, text) NOT IN (SELECT (k, text) FROM p WHERE k < n)
"""
