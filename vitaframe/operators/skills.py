"""Skill normalisation against an alias dictionary of any size, as rows or as one list per document."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaframe.functions.skillwords import (
    CATEGORY_PATTERNS,
    NAME_PREFIXES,
    NAME_SUFFIXES,
    SKILL_DICTIONARY,
    TECHNICAL_WORDS,
)
from vitaframe.functions.text import dialect, is_set, let, strip, title_case

# One row per spelling: ``rank`` settles which entry a spelling leads to (larger wins),
# ``place`` is the order in which spellings were written.
DICTIONARY_DDL = "canonical string, category string, spelling string, is_alias boolean, rank bigint, place bigint"
KNOWN, UNKNOWN = 0.95, 0.7


# ------------------------------------------------------------------ dictionary


def dictionary(spark: SparkSession, index_keys: bool = False) -> DataFrame:
    """The built-in dictionary, one row per spelling.

    An entry's own key is not a spelling unless ``index_keys`` asks for it.
    """
    rows = []
    for pos, (key, name, category, aliases) in enumerate(SKILL_DICTIONARY):
        spellings = [(name, False), *[(a, True) for a in aliases]] + ([(key, False)] if index_keys else [])
        rows += [(name, category, s, alias, pos, pos * 1000 + i) for i, (s, alias) in enumerate(spellings)]
    # as Arrow: the plan holds the rows and so knows their size
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    names = [part.split()[0] for part in DICTIONARY_DDL.split(", ")]
    return spark.createDataFrame(pa.table(columns, names=names), DICTIONARY_DDL)


def alias_rows(spellings: DataFrame) -> DataFrame:
    """Reverse lookup ``alias_lower -> canonical, category``; the later entry wins a spelling."""
    best = spellings.groupBy(F.lower("spelling").alias("alias_lower")).agg(
        F.max_by(F.struct("canonical", "category"), F.struct("rank", "place")).alias("e"), F.min("place").alias("dict_pos")
    )
    return best.select("alias_lower", "e.canonical", "e.category", "dict_pos")


@dataclass(frozen=True)
class Lookup:
    """Two keyed tables: where each spelling leads, and the aliases of each entry.

    A list of aliases is joined onto answers by the entry's name, never onto spellings, so an entry with very many of them
    costs a row for each and one list. All joins are left to Spark's byte threshold.
    """

    rows: DataFrame
    lists: DataFrame | None = None


def alias_lists(spellings: DataFrame) -> DataFrame:
    """``_name, aliases``: each entry's aliases in the order in which they were written."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "spelling"))), lambda x: x["spelling"])
    return spellings.where("is_alias").groupBy(F.col("canonical").alias("_name")).agg(ordered.alias("aliases"))


def lookup_table(spellings: DataFrame) -> Lookup:
    """A dictionary to look names up in; its answers carry their entry's aliases."""
    return Lookup(alias_rows(spellings), alias_lists(spellings))


_ADDED_RANK = 1_000_000


def add_custom_aliases(spellings: DataFrame, additions: DataFrame) -> DataFrame:
    """Extend the dictionary by rows ``(seq, canonical_name, alias, category)``.

    A known canonical name (any case) gains the alias unless it has it; an unknown one becomes
    an entry named and categorised by its first addition, and can be looked up by its own name.
    The last addition of a spelling decides where it leads. Everything stays one row per
    spelling, so a name that gains very many aliases is never gathered in one place.
    """
    named = additions.select("seq", "canonical_name", "alias", "category", F.lower("canonical_name").alias("_n"))
    first = named.groupBy("_n").agg(
        F.min_by(F.struct("canonical_name", F.coalesce("category", F.lit("other")).alias("category")), "seq").alias("_f"),
        F.min("seq").alias("_seq"),
    )
    known = spellings.groupBy(F.lower("canonical").alias("_n")).agg(
        F.first("canonical").alias("_canonical"), F.first("category").alias("_category")
    )
    entries = first.join(known, "_n", "left").select(
        "_n",
        F.coalesce("_canonical", "_f.canonical_name").alias("canonical"),
        F.coalesce("_category", "_f.category").alias("category"),
        F.col("_canonical").isNull().alias("_new"),
        "_seq",
    )
    own_names = entries.where("_new").select(
        "canonical", "category", F.col("canonical").alias("spelling"), F.lit(False).alias("is_alias"),
        F.lit(-1).cast("bigint").alias("rank"), (F.lit(_ADDED_RANK * 1000) + F.col("_seq")).alias("place"),
    )
    pairs = named.groupBy("_n", F.lower("alias").alias("_a")).agg(
        F.min_by("alias", "seq").alias("spelling"), F.min("seq").alias("_first"), F.max("seq").alias("_last")
    )
    held = spellings.where("is_alias").select(
        F.lower("canonical").alias("_n"), F.lower("spelling").alias("_a"), F.lit(True).alias("_held")
    ).distinct()
    added = pairs.join(entries, "_n").join(held, ["_n", "_a"], "left").select(
        "canonical", "category", "spelling", F.col("_held").isNull().alias("is_alias"),
        (F.lit(_ADDED_RANK) + F.col("_last")).alias("rank"), (F.lit(_ADDED_RANK * 1000) + F.col("_first")).alias("place"),
    )
    return spellings.unionByName(own_names).unionByName(added)


# ------------------------------------------------------------------ names and categories


def clean_name(raw: Column, boundary: str = "unicode") -> Column:
    """Blanks, a prefix, a suffix, a version, brackets, punctuation: cut in this order."""
    rx = lambda p, i=False: dialect(p, boundary, i)
    out = F.regexp_replace(strip(raw), rx(r"\s+"), " ")
    out = F.regexp_replace(out, rx(NAME_PREFIXES, True), "")
    out = F.regexp_replace(out, rx(NAME_SUFFIXES, True), "")
    out = F.regexp_replace(out, rx(r"\s+\d+(?:\.\d+)*$"), "")
    out = F.regexp_replace(out, rx(r"\s*\([^)]*\)\s*"), " ")
    out = F.regexp_replace(out, r"[.,;:!?]", "")
    return F.regexp_replace(strip(out), rx(r"\s+"), " ")


def infer_category(cleaned: Column, boundary: str = "unicode") -> Column:
    name = F.lower(cleaned)
    out = None
    for category, patterns in CATEGORY_PATTERNS:
        hit = name.rlike("(?d)" + dialect("|".join(patterns), boundary))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    technical = name.rlike("|".join(TECHNICAL_WORDS))
    return out.when(technical, "technical").otherwise("other")


def _entry(name: Column, cleaned: Column, canonical: Column, aliases: Column, category: Column, context: Column):
    known = canonical.isNotNull()
    return {
        "name": strip(name),
        "canonical_name": F.coalesce(canonical, title_case(cleaned)),
        "aliases": F.coalesce(aliases, F.array().cast("array<string>")),
        "category": F.coalesce(category, infer_category(cleaned)),
        "context": F.when(is_set(context), F.substring(context, 1, 500)),
        "confidence_score": F.when(known, F.lit(KNOWN)).otherwise(F.lit(UNKNOWN)),
    }


# ------------------------------------------------------------------ row form


def _looked_up(rows: DataFrame, dim: Lookup | DataFrame) -> DataFrame:
    """Rows with ``cleaned`` and, where it is a spelling, ``canonical``, ``category`` and the entry's ``aliases``."""
    dim = dim if isinstance(dim, Lookup) else Lookup(dim)
    found = rows.join(dim.rows.select("alias_lower", "canonical", "category"), F.lower("cleaned") == F.col("alias_lower"), "left")
    if dim.lists is None:
        return found.withColumn("aliases", F.lit(None).cast("array<string>"))
    return found.join(dim.lists, F.col("canonical") == F.col("_name"), "left")


def normalize_rows(skills: DataFrame, dim: Lookup | DataFrame, raw: str = "raw", context: str | None = None) -> DataFrame:
    """One normalised entry per raw skill row; ``dim`` comes from ``lookup_table`` or ``alias_rows``.

    With a small dictionary two map-side hash joins: the skill rows are not shuffled. ``alias_rows`` carry no lists of
    aliases (the entries' lists stay empty).
    """
    cleaned = skills.withColumn("cleaned", clean_name(F.col(raw)))
    looked = _looked_up(cleaned, dim)
    ctx = F.col(context) if context else F.lit(None).cast("string")
    fields = _entry(F.col(raw), F.col("cleaned"), F.col("canonical"), F.col("aliases"), F.col("category"), ctx)
    keep = [c for c in cleaned.columns if c not in fields]
    return looked.select(*keep, *[v.alias(k) for k, v in fields.items()])


def first_per_canonical(normalized: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """First occurrence per document and canonical name (any case).

    ``min_by`` merges on the map side, so a document with very many skills does not land
    unreduced in one task as it would under a window.
    """
    rest = [c for c in normalized.columns if c != doc]
    grouped = normalized.groupBy(doc, F.lower("canonical_name").alias("_c")).agg(
        F.min_by(F.struct(*rest), pos).alias("_s")
    )
    return grouped.select(doc, "_s.*")


def normalize_lists_by_row(skills: DataFrame, dim: DataFrame, doc: str = "doc_id", pos: str = "pos", raw: str = "raw"):
    """Skip blanks, normalise, keep the first of each canonical name. Order it with ``SKILL_ORDER``."""
    rows = skills.where(F.coalesce(strip(F.col(raw)) != "", F.lit(False)))
    return first_per_canonical(normalize_rows(rows, dim, raw), doc, pos)


def normalize_lists(lists: DataFrame, dim: Lookup | DataFrame, raws: str, doc: str = "doc_id") -> DataFrame:
    """``(doc, skills)``: the normalised, deduplicated and sorted skills of each document, with a dictionary of any size.

    ``doc`` is a key of ``lists``. Skills are looked up row by row and come together again per document, in one shuffle;
    there the first of each canonical name (any case) stays. Documents without a skill get an empty list.
    """
    rows = lists.select(doc, F.posexplode_outer(raws).alias("pos", "raw"))
    fields = ["name", "canonical_name", "aliases", "category", "context", "confidence_score"]
    known = normalize_rows(rows, dim, "raw").withColumn("_present", F.coalesce(F.col("name") != "", F.lit(False)))
    entry = F.struct(F.lower("canonical_name").alias("c"), F.col("pos").alias("i"), F.struct(*fields).alias("e"))
    grouped = known.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("_present"), entry))).alias("_all"))
    return grouped.select(doc, let(F.col("_all"), _first_of_each).alias("skills"))


def _first_of_each(runs: Column) -> Column:
    """Of entries sorted by name and position the first of each name, in the order of category and name."""
    kept = F.filter(runs, lambda x, i: (i == 0) | (F.get(runs, i - 1)["c"] != x["c"]))
    key = lambda x: F.struct(
        F.coalesce(x["e"]["category"], F.lit("z_other")).alias("k1"), x["e"]["canonical_name"].alias("k2"), x["i"].alias("k3"), x["e"].alias("e")
    )
    return F.transform(F.array_sort(F.transform(kept, key)), lambda x: x["e"])


def category_stats(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(
        F.count("*").alias("skills")
    )


# ------------------------------------------------------------------ for display


def by_category(skills: Column) -> Column:
    """``[{category, skills}]`` of one document's skill array, for display."""

    def group(items: Column) -> Column:
        category = lambda s: F.coalesce(s["category"], F.lit("other"))
        names = F.array_distinct(F.transform(items, category))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("category"),
                F.transform(
                    F.filter(items, lambda s: category(s) == n), lambda s: F.coalesce(s["canonical_name"], s["name"])
                ).alias("skills"),
            ),
        )

    return let(skills, group)


# ------------------------------------------------------------------ suggestions


def _bigrams(c: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    )


def suggest(terms: DataFrame, dim: DataFrame, term: str = "term", limit: int = 10) -> DataFrame:
    """Canonical names whose spellings contain a partial term, best first, ``limit`` per term.

    Containment is found by an equi-join on the term's first two characters against the
    two-character pieces of every spelling, then checked: no cross join, and any
    dictionary size works. Names that start with the term come first, then dictionary order.
    """
    asked = terms.select(F.col(term).alias("term")).where(F.length("term") >= 2).distinct()
    asked = asked.withColumn("_t", F.lower("term")).withColumn("_gram", F.substring("_t", 1, 2))
    pieces = dim.select("canonical", "dict_pos", "alias_lower", F.explode(_bigrams(F.col("alias_lower"))).alias("_gram"))
    hits = asked.join(pieces, "_gram").where(F.contains(F.col("alias_lower"), F.col("_t")))
    # One row per term and name; both sides of this are bounded by terms x dictionary.
    named = hits.groupBy("term", "_t", "canonical").agg(F.min("dict_pos").alias("dict_pos"))
    rank = F.row_number().over(
        Window.partitionBy("term").orderBy(
            ~F.startswith(F.lower("canonical"), F.col("_t")), F.col("dict_pos"), F.col("canonical")
        )
    )
    return named.select("term", "canonical", rank.cast("long").alias("rank")).where(F.col("rank") <= limit)
