"""Which records are one entity: shared emails, shared phones, or close names without conflict.

Exact keys give star edges to the smallest record of a key, never pairs. Names are close at an indel
ratio over 90; that counts only where neither kind of contact is present on both sides, since a
contact of one kind on both sides either already links the records or forbids the link. So pairs of
presence classes none-any and email only-phone only remain: the names of these classes alone are
compared, and where every record has an email, none.

Names of n and m characters are close if they share a subsequence of L = 9 (n + m) // 20 + 1. Where
they have few subsequences of that length, these are keys: names under one key are close by
definition, so they are linked by stars as well, however many share a first name or a prefix. Where
such keys are some hundred a name, names meet by fewer keys of their halves first: the few that meet
under one are compared one by one, and only names under a crowded one have all their keys.
Longer names are found by their rarest q-grams (of which some survive any admissible edits, at about
the same place; common q-grams are dealt into parts) and compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.near import bucket_batches, few, halved, heavy, keyed, lengths_of, light, other_side, partners, shared
from ..functions.scalar import entity_id, lcs_length
from .components import connected_components
from .scratch import discard, materialize

#: Characters of a q-gram.
Q = 3
#: Names with a q-gram that meet in one part.
PART = 2000
#: Presence classes (e: emails, p: phones) that a class may be linked with by name.
FITS = {"": ("", "e", "p", "ep"), "e": ("", "p"), "p": ("", "e"), "ep": ("",)}


def _prefix(n: int, lengths: Iterable[int]) -> int:
    """q-grams of a name of n characters of which at least one, at its place give or take the edits,
    is in any close name that keys do not find: one more than the edits can destroy (a character that
    goes takes Q of them, one that comes Q - 1). 0 where keys find all."""
    return max((Q * (n - shared(n, m)) + (Q - 1) * (m - shared(n, m)) + 1 for m in partners(n, lengths) if not few(n, m)), default=0)


def _long_pairs(names: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct names to the pairs (x < y) of close ones that keys do not find, and perhaps others."""
    needed = {n: p for n in lengths if (p := _prefix(n, lengths))}
    if not needed:
        return names.select(F.col("name").alias("x"), F.col("name").alias("y")).limit(0)
    prefix = F.create_map(*[F.lit(v) for kv in needed.items() for v in kv])
    rows = names.select("name", F.length("name").alias("n")).where(F.col("n").isin(list(needed)))
    grams = rows.select("name", "n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - (Q - 1), F.lit(1))), lambda i: F.struct(F.substring(F.col("name"), i, F.lit(Q)).alias("gram"), i.alias("at")))).alias("g")).select("name", "n", "g.*")
    grams = materialize(grams, "grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("common"))
    rarest = Window.partitionBy("name").orderBy("common", "gram", "at")
    chosen = grams.join(counts, "gram").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= F.element_at(prefix, F.col("n"))).drop("rank")
    chosen = materialize(chosen.withColumn("parts", (F.col("common") / PART + 1).cast("int")), "rare-grams")
    one = chosen.select("gram", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    two = chosen.select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    both = F.col("nx") + F.col("ny")
    least = F.floor(9 * both / 20).cast("int") + 1
    near = (F.col("x") < F.col("y")) & (least <= F.least("nx", "ny")) & (F.abs(F.col("ax") - F.col("ay")) <= F.greatest("nx", "ny") - least)
    met = one.join(two, ["gram", "part"]).where(near).select("x", "y").distinct()
    pairs = materialize(met.where(200 * lcs_length("x", "y") > 90 * (F.length("x") + F.length("y"))), "close")
    discard(grams, chosen)
    return pairs


def _halves_met(names: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """Distinct names to the pairs (x < y) of close ones whose halves meet few others, and the names
    whose halves meet more."""
    rows = halved(names, "name", lengths).repartition("key").sortWithinPartitions("key", "sign")
    met = materialize(rows.mapInArrow(bucket_batches, "a long, b long"), "met")
    ids = names.select(F.xxhash64("name").alias("id"), "name")
    of = lambda c, n: ids.select(F.col("id").alias(c), F.col("name").alias(n))
    pairs = met.where("a <> b").distinct().join(of("a", "one"), "a").join(of("b", "two"), "b")
    pairs = pairs.where(200 * lcs_length("one", "two") > 90 * (F.length("one") + F.length("two")))
    pairs = materialize(pairs.select(F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y")), "close")
    crowded = materialize(ids.join(met.where("a = b").select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("name"), "crowded")
    discard(met)
    return pairs, crowded


def close_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``name`` on two sides to the ordered pairs ``(x, y)``, x <> y, with indel ratio over
    90 between a name of one side and a name of the other."""
    left, right = left.select("name").distinct(), right.select("name").distinct()
    lengths = lengths_of(left.union(right), "name")
    ours = keyed(left, "name", lengths).select(F.col("name").alias("x"), "key", "side")
    theirs = keyed(right, "name", lengths).select(F.col("name").alias("y"), "key", other_side("side").alias("side"))
    met = ours.join(theirs, ["key", "side"]).where("x <> y").select("x", "y").distinct()
    long = _long_pairs(left.union(right).distinct(), lengths)
    long = long.union(long.select("y", "x"))
    long = long.join(left.select(F.col("name").alias("x")), "x", "left_semi").join(right.select(F.col("name").alias("y")), "y", "left_semi").select("x", "y")
    pairs = materialize(met.union(long), "close")
    return pairs.union(pairs.select("y", "x")).distinct()


def name_links(groups: DataFrame) -> DataFrame:
    """Groups ``(name, kind, least)`` of the records of one name and presence class, by their smallest
    record, to ``(least, hub)``: groups whose records are all to be linked to the record ``hub``.

    The links connect what links between all close names of fitting classes connect, but there are
    no more of them than keys, and pairs of long names. A name's own group is among them only in the
    class without contacts."""
    lengths = lengths_of(groups, "name")
    members = keyed(groups, "name", lengths, by=light)
    long = _long_pairs(groups.select("name").distinct(), lengths)
    if some := [n for n in lengths if any(heavy(n, m) for m in partners(n, lengths))]:
        pairs, crowded = _halves_met(groups.where(F.length("name").isin(some)).select("name").distinct(), lengths)
        members = members.union(keyed(groups.join(crowded, "name", "left_semi"), "name", lengths, by=heavy))
        long = long.union(pairs)
    members = materialize(members.drop("name"), "name-keys")
    spots = [(s, k) for s in "<>=" for k in FITS]
    least = [F.min(F.when((F.col("side") == s) & (F.col("kind") == k), F.col("least"))).alias(f"{s}{k}") for s, k in spots]
    hubs = members.groupBy("key").agg(F.count("*").alias("n"), *least).where("n > 1").drop("n")
    of = lambda s, k: F.array(*[F.col(f"`{s}{other}`") for other in FITS[k]])
    fitting = F.array().cast("array<long>")
    for s, k in spots:
        other = {"<": ">", ">": "<"}.get(s, s)
        fitting = F.when((F.col("side") == s) & (F.col("kind") == k), of(other, k)).otherwise(fitting)
    links = members.join(hubs, "key").select("least", F.explode(fitting).alias("hub")).where("hub is not null and hub <> least").distinct()

    one, two = groups.toDF("x", "kx", "lx"), groups.toDF("y", "ky", "ly")
    fits = " or ".join(f"(kx = '{a}' and ky = '{b}')" for a, some in FITS.items() for b in some)
    met = long.join(one, "x").join(two, "y").where(fits).select("lx", "ly")
    own = groups.where("kind = ''").select("least", F.col("least").alias("hub"))
    return links.union(met).union(met.select("ly", "lx")).union(own)


def identity_edges(keys: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(record_id, emails, phones, name)`` with normalized keys to edges ``(a, b)``."""

    def stars(column: str) -> DataFrame:
        flat = keys.select("record_id", F.explode(column).alias("key")).where("key is not null")
        least = flat.groupBy("key").agg(F.min("record_id").alias("b"))
        return flat.join(least, "key").select(F.col("record_id").alias("a"), "b")

    edges = stars("emails").union(stars("phones"))
    if not fuzzy:
        return edges
    has = lambda c: F.when(F.size(c) > 0, F.lit(c[0])).otherwise("")
    named = keys.where("name is not null").select("record_id", "name", F.concat(has("emails"), has("phones")).alias("kind"))
    groups = materialize(named.groupBy("name", "kind").agg(F.min("record_id").alias("least")), "names")
    kinds = {r.kind for r in groups.select("kind").distinct().collect()}  # at most four
    if "" not in kinds:  # only names with an email alone can be linked, to those with a phone alone
        if not {"e", "p"} <= kinds:
            return edges
        groups = groups.where("kind in ('e', 'p')")
    links = name_links(groups)
    ours = named.join(groups, ["name", "kind"]).select(F.col("record_id").alias("a"), "least")
    return edges.union(ours.join(links, "least").select("a", F.col("hub").alias("b")))


def resolve(keys: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(record_id, group_id, candidate_id)``: group_id is the smallest record of the group, and
    candidate_id the UUID of its smallest email, else phone, else name, else of where its records
    come from (column ``origin``, else their ids)."""
    if "origin" not in keys.columns:
        keys = keys.withColumn("origin", F.col("record_id").cast("string"))
    if not hasattr(keys, "_scratch_path"):  # a table already
        keys = materialize(keys, "keys")
    parts = connected_components(identity_edges(keys, fuzzy))
    grouped = keys.join(parts, keys.record_id == parts.id, "left").withColumn("group_id", F.coalesce("component", "record_id"))
    per = grouped.groupBy("group_id").agg(F.min(F.array_min("emails")).alias("e"), F.min(F.array_min("phones")).alias("p"), F.min("name").alias("n"), F.min("origin").alias("o"))
    # Records without email, phone and name are alone in their group, so the smallest origin is all there is.
    key = F.coalesce(F.concat(F.lit("email:"), "e"), F.concat(F.lit("phone:"), "p"), F.concat(F.lit("name:"), "n"), F.concat(F.lit("fallback:"), "o"))
    return grouped.select("record_id", "group_id").join(per.select("group_id", entity_id(key).alias("candidate_id")), "group_id").select("record_id", "group_id", "candidate_id")
