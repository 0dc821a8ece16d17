"""Column expressions over nodes, edges and paths written as `>1<2>3` (`<`: reversed; node 0: some nested structure)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "([<>][0-9]+)"
WILDCARD = 0


def node_text(node: Column, reverse: Column) -> Column:
    return F.concat(F.when(reverse, "<").otherwise(">"), node.cast("string"))


def node_key(node: Column, reverse: Column) -> Column:
    """One long that tells node and orientation, for joins."""
    return node * 2 + reverse.cast("long")


def steps(path: Column) -> Column:
    """The node traversals of a path, as text; anything else between them is skipped."""
    return F.regexp_extract_all(path, F.lit(STEP), F.lit(1))


def step_node(step: Column) -> Column:
    return F.substring(step, 2, 20).cast("long")


def step_reverse(step: Column) -> Column:
    return F.substring(step, 1, 1) == "<"


def step_text(step_list: Column) -> Column:
    return F.array_join(step_list, "")


def edges(path: Column) -> Column:
    """Pairs of steps in a row, as text; none for a path of fewer than two."""
    pairs = lambda s: F.when(F.size(s) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    return F.get(F.transform(F.array(steps(path)), pairs), F.lit(0))  # the steps are cut out once, not at each use


def edge_keys(path: Column) -> Column:
    """Pairs (a, b) of node keys of steps in a row: two longs instead of text."""
    keys = F.transform(steps(path), lambda s: node_key(step_node(s), step_reverse(s)))
    pairs = lambda k: F.when(F.size(k) < 2, F.array().cast("array<struct<a:bigint,b:bigint>>")).otherwise(F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.get(F.transform(F.array(keys), pairs), F.lit(0))


def edges_of_list(paths: Column, separator: str = ",") -> Column:
    """The edges of each of several paths."""
    return F.transform(F.split(paths, separator), edges)


def edge_nodes(edge: Column) -> Column:
    """The ids at both ends of an edge."""
    s = steps(edge)
    return F.struct(step_node(F.get(s, F.lit(0))).alias("a"), step_node(F.get(s, F.lit(1))).alias("b"))


def touches_wildcard(edge: Column) -> Column:
    return F.exists(steps(edge), lambda s: step_node(s) == WILDCARD)


def pieces(path: Column) -> Column:
    """The paths before and behind the nested structure in a path, where it has some; else the path alone."""
    return F.filter(F.split(path, "[<>]0(?![0-9])"), lambda p: p != "")


def digits(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit("([0-9]+)"), F.lit(1))


def joined(paths: Column) -> Column:
    return F.array_join(paths, ",")


def separated(text: Column) -> Column:
    return F.split(text, ",")


def numbers(text: Column) -> Column:
    """A comma list as doubles; what is no number raises."""
    return F.transform(F.split(text, ","), lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")))


def site_id(start: Column, end: Column) -> Column:
    return F.concat_ws("_", start.cast("string"), end.cast("string"))


def site_ends(text: Column) -> Column:
    """The two boundary nodes of `a_b`; text without `_` raises."""
    parts = F.split(text, "_")
    ok = F.size(parts) == 2
    end = lambda i: F.when(ok, F.get(parts, F.lit(i)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a site: "), text)).cast("long"))
    return F.struct(end(0).alias("start"), end(1).alias("end"))


def flipped(path: Column) -> Column:
    """The path walked backwards: order and orientations reversed, the wildcard's orientation kept."""
    turn = lambda s: F.when(step_node(s) == WILDCARD, s).when(step_reverse(s), F.concat(F.lit(">"), F.substring(s, 2, 20))).otherwise(F.concat(F.lit("<"), F.substring(s, 2, 20)))
    return F.array_join(F.transform(F.reverse(steps(path)), turn), "")


def mostly_forward(path: Column) -> Column:
    """Flipped where more than half of the steps, rounded down, are reversed."""
    s = steps(path)
    return F.when(F.size(F.filter(s, step_reverse)) > F.floor(F.size(s) / 2), flipped(path)).otherwise(path)


def length_text(n_steps: Column, least: Column, most: Column) -> Column:
    """`min` or `min/max` for paths of three steps and more, 0 for two; else null."""
    both = F.when(least == most, least.cast("string")).otherwise(F.concat_ws("/", least.cast("string"), most.cast("string")))
    return F.when(n_steps >= 3, both).when(n_steps == 2, "0")


def site_length_text(least: Column, most: Column) -> Column:
    """`min,max` of a whole site; NA,NA without distances."""
    return F.concat_ws(",", F.coalesce(least.cast("string"), F.lit("NA")), F.coalesce(most.cast("string"), F.lit("NA")))


def kept(values: Column, places: Column) -> Column:
    """The values at some places, counted from 0, in their order; places beyond the end hold nothing."""
    return F.filter(values, lambda x, i: F.array_contains(places, i))


def group_text(first: Column, second: Column) -> Column:
    """`a:b,c:d` of two count arrays."""
    return F.array_join(F.zip_with(first, second, lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), ",")


def display_shares(p: Column, n_first: Column, n_second: Column) -> Column:
    """How a path's carriers show in the two alignment files, out of 60 in all.

    Each file starts from the other group's share; -ln p moves weight to the larger of the two (to the second where they are
    equal), within 0 to 60. Nobody at all shows as 0 and 0."""
    total = n_first + n_second
    start = 60.0 * n_second / total
    moved = start - F.log(F.greatest(p, F.lit(1e-20))) * F.when(start > 30.0, 1.0).otherwise(-1.0)
    a, b = (F.greatest(F.lit(0.0), F.least(F.lit(60.0), v)) for v in (moved, 60.0 - moved))
    shown = F.struct((60.0 * a / (a + b)).alias("first"), (60.0 * b / (a + b)).alias("second"))
    return F.when(total == 0, F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("second"))).otherwise(shown)


def sample_of_path(name: Column) -> Column:
    """`sample#haplotype#contig` names: sample and haplotype; a plain name is its own sample, haplotype 0."""
    parts = F.split(name, "#")
    named = F.size(parts) >= 2
    return F.struct(F.get(parts, F.lit(0)).alias("sample"), F.when(named, F.get(parts, F.lit(1)).try_cast("int")).otherwise(F.lit(0)).alias("hap"))


def p_or_one(p: Column) -> Column:
    """Missing p-values count as 1."""
    return F.coalesce(p, F.lit(1.0))


def significant(p: Column, threshold: float) -> Column:
    return F.coalesce(p < threshold, F.lit(False))


def close(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    return F.abs(a - b) <= epsilon
