"""Mapping of typed names to a canonical list (problem 3).

A prefix-filter set-similarity join.  Every distinct name and every accepted
form of an entry becomes a set of features: the character pairs of its letters
and of its consonants, after folding case, accents, look-alike digits, doubled
letters, numbers and remarks in brackets.  Features are ordered from rare to
common over all names; two sets of Jaccard similarity t or more must share one
of their first |x| - ceil(t |x|) + 1 features, so only these are joined.  Pairs
pass a length filter and a positional filter, their Jaccard similarity is
computed exactly, and the most similar entry is kept.  Names that are less than
t similar to all entries, as those written without their vowels are, go through
the same join once more by the pairs of consonants alone; what that leaves has
no entry.

What people write around a name ("now", "per md", "bed") is learned from the
names: words at an end of names, alone or in twos, that at least MIN_RESTS
different names have whose rest is a name of the list or typed by itself.

Scale: rows are reduced to distinct names with map-side partial counts before
any feature is made, so a name that fills a third of the rows costs one row.
A feature is one of at most 2 * 36^2 strings per list, which bounds both the
frequency table and a set's size however long a name is.  The names' features
and the pairs are staged, so each is computed once.  The mapping is joined back
by name; a hot name there is split by adaptive skew handling, its other side
being one row.

Defined results: null names are no cases; empty or symbol-only names map to
'none'; names equal to a canonical name letter for letter are skipped by
``map_rows``; ties go to the smaller id; repeated rows each get their result;
lists without entries give 'none'; a column named canonical_id is replaced.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.runtime import stage

MIN_JACCARD = 0.35  # on the test lists, names meant for an entry have less only when an acronym or several letters are lost
MIN_CONSONANTS = 0.45  # the same of consonants alone
MIN_RESTS = 5
ROUNDS = 4  # wrappings taken off a name, at most
NO_ENTRY = "none"
_REMARK = re.compile(r"\([^)]*\)")
_WORD = re.compile(r"[a-z0-9]+")
_LOOKALIKE = str.maketrans("013457", "oieast")


def words(name: str) -> list[str]:
    """Folded words of a name; numbers and remarks only where there is nothing else."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    found = _WORD.findall(_REMARK.sub(" ", plain)) or _WORD.findall(plain)
    found = [w for w in found if not w.isdigit()] or found
    return [w if w.isdigit() else w.translate(_LOOKALIKE) for w in found]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(names: pd.Series) -> pd.Series:
    return names.map(words)


def features(parts: Column) -> Column:
    """Set of tagged character pairs of an array of words; l, i and 1 are one letter, a doubled letter is one."""
    letters = F.regexp_replace(F.translate(F.array_join(parts, ""), "l", "i"), r"(.)\1+", "$1")
    pairs = lambda x, tag: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.concat(F.lit(tag), F.substring(x, i, F.lit(2))))
    both = F.concat(pairs(letters, "f"), pairs(F.regexp_replace(letters, "[aeiou]", ""), "c"))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) > F.when(x.startswith("c"), 2).otherwise(1)))


def _forms(entries: DataFrame) -> DataFrame:
    """(list_name, canonical_id, form) of every accepted name."""
    names = F.concat(F.array("canonical_name"), F.coalesce(F.split("name_examples", r"\s*;\s*"), F.array().cast("array<string>")))
    rows = entries.select("list_name", "canonical_id", F.explode(names).alias("form"))
    return rows.where("list_name is not null and canonical_id is not null and trim(form) <> ''").distinct()


def wrappings(known: DataFrame) -> DataFrame:
    """(list_name, before, after): words written before and after the names of each list, as arrays of texts of one or two words.

    ``known`` has list_name and the array column words.
    """
    whole = known.where(F.size("words") > 0).select("list_name", "words").distinct()
    n = F.size("words")
    ends = F.array(*[
        F.when(n > k, F.struct(F.lit(side).alias("side"), F.array_join(part, " ").alias("w"), rest.alias("words")))
        for k in (1, 2)
        for side, part, rest in (("before", F.slice("words", 1, k), F.slice("words", F.lit(k + 1), n)), ("after", F.slice("words", -k, k), F.slice("words", F.lit(1), F.greatest(n - k, F.lit(0)))))
    ])
    cut = whole.select("list_name", F.explode(ends).alias("x")).where("x is not null").select("list_name", "x.side", "x.w", "x.words")
    rests = cut.join(whole, ["list_name", "words"], "left_semi").groupBy("list_name", "side", "w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_RESTS)
    one = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("w"))).alias(side)
    return rests.groupBy("list_name").agg(one("before"), one("after"))


def _unwrapped(parts: Column, before: Column, after: Column) -> Column:
    def once(w: Column, _: Column) -> Column:
        n = F.size(w)
        ends = lambda k, a, side: (n > k) & F.array_contains(side, F.array_join(F.slice(w, a, k), " "))
        tail = lambda k: F.slice(w, F.lit(1), F.greatest(n - k, F.lit(0)))
        return F.when(ends(2, -2, after), tail(2)).when(ends(1, -1, after), tail(1)).when(ends(2, 1, before), F.slice(w, F.lit(3), n)).when(ends(1, 1, before), F.slice(w, F.lit(2), n)).otherwise(w)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), parts, once)


def _ranked(sets: DataFrame, key: list[str], t: float, rank: DataFrame) -> DataFrame:
    """Prefix entries (key.., token, pos, size) of sets ordered from rare to common tokens."""
    placed = sets.select(*key, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(rank, ["list_name", "token"])
    ordered = placed.groupBy(*key, "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("a"))
    keep = F.col("size") - F.ceil(F.col("size") * t) + 1
    return ordered.select(*key, "size", F.posexplode(F.slice("a", 1, keep.cast("int"))).alias("pos", "x")).select(*key, "size", "pos", "x.token")


def similar(left: DataFrame, right: DataFrame, t: float = MIN_JACCARD) -> DataFrame:
    """(list_name, name, canonical_id, form, jaccard) of all pairs of Jaccard similarity ``t`` or more.

    ``left`` has list_name, name and tokens, ``right`` list_name, canonical_id,
    form and tokens.
    """
    left, right = left.where(F.size("tokens") > 0), right.where(F.size("tokens") > 0)
    each = left.select("list_name", F.explode("tokens").alias("token")).unionByName(right.select("list_name", F.explode("tokens").alias("token")))
    rank = each.groupBy("list_name", "token").agg(F.count("*").alias("n"))
    a = _ranked(left, ["list_name", "name"], t, rank)
    b = _ranked(right, ["list_name", "canonical_id", "form"], t, rank).withColumnsRenamed({"size": "size2", "pos": "pos2"})
    met = a.join(b, ["list_name", "token"]).where((F.col("size2") >= F.col("size") * t) & (F.col("size") >= F.col("size2") * t))
    pairs = met.groupBy("list_name", "name", "canonical_id", "form", "size", "size2").agg(F.min(F.struct("pos", "pos2")).alias("first"))
    needed = F.ceil((F.col("size") + F.col("size2")) * (t / (1 + t)))
    reach = 1 + F.least(F.col("size") - F.col("first.pos") - 1, F.col("size2") - F.col("first.pos2") - 1)
    left_over = pairs.where(reach >= needed)
    both = left_over.join(left, ["list_name", "name"]).join(right.withColumnRenamed("tokens", "tokens2"), ["list_name", "canonical_id", "form"])
    shared = F.size(F.array_intersect("tokens", "tokens2"))
    return both.withColumn("jaccard", shared / (F.col("size") + F.col("size2") - shared)).where(F.col("jaccard") >= t).select("list_name", "name", "canonical_id", "form", "jaccard")


def tokenised(names: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list_name, name, tokens) of distinct ``names`` and (list_name, canonical_id, form, tokens) of the entries' forms."""
    folded = names.select("list_name", F.lit(None).cast("string").alias("canonical_id"), "name", _words("name").alias("words"))
    accepted = _forms(entries).select("list_name", "canonical_id", F.col("form").alias("name"), _words("form").alias("words"))
    every = stage(folded.unionByName(accepted))
    wrapped = every.join(wrappings(every), "list_name", "left")
    typed = F.when(F.col("canonical_id").isNull() & F.col("before").isNotNull(), _unwrapped(F.col("words"), F.col("before"), F.col("after"))).otherwise(F.col("words"))
    tokens = stage(wrapped.withColumn("core", typed).select("list_name", "canonical_id", "name", features(F.col("core")).alias("tokens")))
    return tokens.where("canonical_id is null").drop("canonical_id"), tokens.where("canonical_id is not null").withColumnRenamed("name", "form")


def best_entries(names: DataFrame, entries: DataFrame, t: float = MIN_JACCARD) -> DataFrame:
    """(list_name, name, canonical_id, jaccard) for distinct ``names`` (list_name, name), staged.

    canonical_id is 'none' and jaccard null where no entry is meant.
    """
    left, right = tokenised(names, entries)

    def best(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
        return similar(a, b, least).groupBy("list_name", "name").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "canonical_id")).alias("b"))

    first = stage(left.join(best(left, right, t), ["list_name", "name"], "left").select("list_name", "name", "tokens", "b"))
    consonants = lambda d: d.withColumn("tokens", F.filter("tokens", lambda x: x.startswith("c")))
    second = best(consonants(first.where("b is null").drop("b")), consonants(right), MIN_CONSONANTS).withColumnRenamed("b", "c")
    chosen = first.join(second, ["list_name", "name"], "left").withColumn("b", F.coalesce("b", "c"))
    return stage(chosen.select("list_name", "name", F.coalesce("b.canonical_id", F.lit(NO_ENTRY)).alias("canonical_id"), (-F.col("b.j")).alias("jaccard")))


def map_rows(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` (with list_name and name) that are not written as a canonical name, plus canonical_id."""
    exact = entries.select("list_name", F.col("canonical_name").alias("name")).where("name is not null").distinct()
    kept = rows.drop("canonical_id").where("name is not null and list_name is not null")
    distinct = kept.groupBy("list_name", "name").agg(F.lit(1).alias("one")).select("list_name", "name")
    mapping = best_entries(distinct.join(exact, ["list_name", "name"], "left_anti"), entries).select("list_name", "name", "canonical_id")
    return kept.join(mapping, ["list_name", "name"])
