"""Queries over raw skills: cleaning, categories, normalisation, suggestions, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaframe.functions import skillwords as W
from vitaframe.functions.text import confidence_tier, percent_of
from vitaframe.operators import skills as K
from vitaframe.queries.base import quote, register, strip_sql
from vitaframe.sources.tables import table

# Raw skills as people write them, one per customer.
_RAW = (
    "React.js", "Python 3", "Knowledge of SQL", "K8s", "AWS", "Spring Framework", ".NET", "Risk Management",
    "  golang ", "proficient in   PyTorch", "Node library", "c++", "Google Cloud Platform (GCP)", "vim", "NoSQL",
    "Certified Scrum Cert", "REST services", "Java 11", "java", "JAVA SCRIPT", "Machine-learning algorithm",
    "Team leadership!", "web development", "", "Windows Server 2019", "foo lang", "r", "Experience with CI/CD",
)
RAW_SKILL = (
    "CASE c_custkey % 29 "
    + " ".join(f"WHEN {i} THEN {quote(s)}" for i, s in enumerate(_RAW))
    + " ELSE concat(p_like, ' database 12.1') END"
)
RAW_EXPR = RAW_SKILL.replace("p_like", "lower(c_mktsegment)")


def _raw(spark, folder):
    customers = table(spark, folder, "customer")
    return customers.select(
        "c_custkey",
        F.floor(F.col("c_custkey") / 7).alias("doc_id"),
        F.col("c_custkey").alias("pos"),
        F.expr(RAW_EXPR).alias("raw"),
        F.col("c_mktsegment").alias("context"),
    )


# ------------------------------------------------------------------ the same in SQL

_RAW_CTE = f"raw AS (SELECT c_custkey, c_custkey // 7 AS doc_id, c_custkey AS pos, {RAW_EXPR} AS raw, c_mktsegment AS context FROM customer)"


def clean_sql(c: str) -> str:
    s = f"regexp_replace({strip_sql(c)}, '\\s+', ' ', 'g')"
    s = f"regexp_replace({s}, {quote('(?i)' + W.NAME_PREFIXES)}, '')"
    s = f"regexp_replace({s}, {quote('(?i)' + W.NAME_SUFFIXES)}, '')"
    s = f"regexp_replace({s}, '\\s+\\d+(?:\\.\\d+)*$', '')"
    s = f"regexp_replace({s}, '\\s*\\([^)]*\\)\\s*', ' ', 'g')"
    s = f"regexp_replace({s}, '[.,;:!?]', '', 'g')"
    return f"regexp_replace({strip_sql(s)}, '\\s+', ' ', 'g')"


def category_sql(c: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({c}), {quote('|'.join(ps))}) THEN '{cat}'" for cat, ps in W.CATEGORY_PATTERNS)
    return f"CASE {cases} WHEN regexp_matches(lower({c}), '{'|'.join(W.TECHNICAL_WORDS)}') THEN 'technical' ELSE 'other' END"


def title_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), lambda r: upper(r[1]) || r[2:]), '')"


def _values(index_keys: bool = False) -> str:
    rows = []
    for pos, (key, name, category, aliases) in enumerate(W.SKILL_DICTIONARY):
        spelled = [name.lower(), *[a.lower() for a in aliases]] + ([key.lower()] if index_keys else [])
        for i, s in enumerate(spelled):
            rows.append(f"({quote(s)}, {quote(name)}, {quote(category)}, {quote('|'.join(aliases))}, {pos}, {i})")
    return ", ".join(rows)


def _dim_cte(index_keys: bool = False) -> str:
    return (
        f"spelled(alias_lower, canonical, category, aliases, pos, i) AS (VALUES {_values(index_keys)}), "
        "dim AS (SELECT alias_lower, arg_max(canonical, pos) AS canonical, arg_max(category, pos) AS category, "
        "arg_max(aliases, pos) AS aliases, min(pos * 1000 + i) AS dict_pos FROM spelled GROUP BY 1)"
    )


def _norm_cte(where: str = "") -> str:
    return (
        f"cl AS (SELECT *, {clean_sql('raw')} AS cleaned FROM raw {where}), "
        f"norm AS (SELECT c_custkey, doc_id, pos, raw, context, cleaned, coalesce(canonical, {title_sql('cleaned')}) AS canonical_name, "
        f"coalesce(category, {category_sql('cleaned')}) AS category, coalesce(aliases, '') AS aliases, "
        "CASE WHEN canonical IS NULL THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence_score FROM cl LEFT JOIN dim ON lower(cleaned) = alias_lower)"
    )


# ------------------------------------------------------------------ queries


@register(f"WITH {_RAW_CTE} SELECT c_custkey, {clean_sql('raw')} AS cleaned FROM raw")
def clean_skill_names(spark, folder):
    return _raw(spark, folder).select("c_custkey", K.clean_name(F.col("raw"), "ascii").alias("cleaned"))


@register(f"WITH {_RAW_CTE}, c AS (SELECT c_custkey, {clean_sql('raw')} AS cleaned FROM raw) SELECT c_custkey, {category_sql('cleaned')} AS category FROM c")
def infer_skill_categories(spark, folder):
    cleaned = K.clean_name(F.col("raw"), "ascii")
    return _raw(spark, folder).select("c_custkey", K.infer_category(cleaned, "ascii").alias("category"))


_NORM_OUT = "c_custkey, {name} AS name, canonical_name, category, aliases, context, confidence_score".format(name=strip_sql("raw"))


@register(f"WITH {_RAW_CTE}, {_dim_cte()}, {_norm_cte()} SELECT {_NORM_OUT} FROM norm")
def normalize_skills(spark, folder):
    """Dictionary lookup of every raw skill; unknown ones get a title and an inferred category."""
    out = K.normalize_rows(_raw(spark, folder), K.lookup_table(K.dictionary(spark)), context="context")
    return out.select(
        "c_custkey", "name", "canonical_name", "category", F.array_join("aliases", "|").alias("aliases"), "context", "confidence_score"
    )


@register(f"WITH {_RAW_CTE}, {_dim_cte(True)}, {_norm_cte()} SELECT {_NORM_OUT} FROM norm")
def normalize_skills_with_keys(spark, folder):
    """The same with the entries' own keys as spellings (``aws``, ``gcp``, ``spring``)."""
    out = K.normalize_rows(_raw(spark, folder), K.lookup_table(K.dictionary(spark, index_keys=True)), context="context")
    return out.select(
        "c_custkey", "name", "canonical_name", "category", F.array_join("aliases", "|").alias("aliases"), "context", "confidence_score"
    )


def _skill_lists(spark, folder):
    lists = _raw(spark, folder).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw"))).alias("x"))
    lists = lists.select("doc_id", F.transform("x", lambda e: e["raw"]).alias("raws"))
    return K.normalize_lists(lists, K.lookup_table(K.dictionary(spark)), "raws")


_LISTS = (
    f"WITH {_RAW_CTE}, {_dim_cte()}, {_norm_cte('WHERE ' + strip_sql('raw') + quote('').join([' <> ', '']))}, "
    "firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(canonical_name) ORDER BY pos) AS rn FROM norm), "
    "kept AS (SELECT * FROM firsts WHERE rn = 1)"
)


@register(
    _LISTS + f" SELECT doc_id, {strip_sql('raw')} AS name, canonical_name, category, row_number() OVER (PARTITION BY doc_id ORDER BY category, canonical_name) AS rank FROM kept"
)
def normalize_skill_lists(spark, folder):
    """One list per document: blanks dropped, first of each name kept, sorted."""
    flat = _skill_lists(spark, folder).select("doc_id", F.posexplode("skills").alias("i", "s"))
    return flat.select("doc_id", "s.name", "s.canonical_name", "s.category", (F.col("i") + 1).cast("long").alias("rank"))


@register(
    "WITH x AS (SELECT l_orderkey, l_linenumber, 'part-' || l_partkey AS name, 'Family ' || (l_partkey % 7) AS canonical_name FROM lineitem), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, canonical_name ORDER BY l_linenumber, name) AS n FROM x) "
    "SELECT l_orderkey, name, canonical_name, 'parts' AS category, 0.95::DOUBLE AS confidence_score, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY canonical_name) AS rank FROM f WHERE n = 1"
)
def normalize_lists_with_added_aliases(spark, folder):
    """Lists of each order against a dictionary that gains one alias per part: no bound on its size."""
    family = F.concat(F.lit("Family "), F.col("p_partkey") % 7)
    added = table(spark, folder, "part").select(
        F.col("p_partkey").alias("seq"), family.alias("canonical_name"),
        F.concat(F.lit("part-"), F.col("p_partkey")).alias("alias"), F.lit("parts").alias("category"),
    )
    dim = K.alias_rows(K.add_custom_aliases(K.dictionary(spark), added))
    name = F.concat(F.lit("part-"), F.col("l_partkey"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", name.alias("raw")).alias("x"))
    lists = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["raw"]).alias("raws"))
    skills = K.normalize_lists(lists, dim, "raws", "l_orderkey")
    flat = skills.select("l_orderkey", F.posexplode("skills").alias("i", "s"))
    return flat.select(
        "l_orderkey", "s.name", "s.canonical_name", "s.category", "s.confidence_score", (F.col("i") + 1).cast("long").alias("rank")
    )


@register(_LISTS + f" SELECT doc_id, pos, {strip_sql('raw')} AS name, canonical_name, category FROM kept")
def first_skill_per_name(spark, folder):
    """The same as rows: a map-side merged aggregate instead of a window."""
    out = K.normalize_lists_by_row(_raw(spark, folder), K.lookup_table(K.dictionary(spark)))
    return out.select("doc_id", "pos", "name", "canonical_name", "category")


@register(_LISTS + " SELECT category, count(*) AS skills FROM kept GROUP BY 1")
def skill_category_stats(spark, folder):
    out = K.normalize_lists_by_row(_raw(spark, folder), K.lookup_table(K.dictionary(spark)))
    return K.category_stats(out)


@register(
    _LISTS + ", g AS (SELECT doc_id, category, string_agg(canonical_name, ',' ORDER BY canonical_name) AS skills FROM kept GROUP BY 1, 2) SELECT doc_id, category, skills FROM g"
)
def skills_by_category(spark, folder):
    """Skills of each document grouped for display."""
    flat = _skill_lists(spark, folder).select("doc_id", F.explode(K.by_category(F.col("skills"))).alias("g"))
    return flat.select("doc_id", "g.category", F.array_join("g.skills", ",").alias("skills"))


@register(
    f"WITH {_dim_cte()}, t AS (SELECT DISTINCT p AS term FROM (SELECT unnest([substr(p_name, 1, 2), substr(p_name, 2, 2), substr(p_type, 1, 3), right(p_name, 2)]) AS p FROM part)), "
    "h AS (SELECT term, canonical, min(dict_pos) AS dp FROM t JOIN dim ON contains(alias_lower, lower(term)) WHERE length(term) >= 2 GROUP BY 1, 2), "
    "r AS (SELECT term, canonical, row_number() OVER (PARTITION BY term ORDER BY NOT starts_with(lower(canonical), lower(term)), dp, canonical) AS rank FROM h) "
    "SELECT term, canonical, rank FROM r WHERE rank <= 10"
)
def suggest_skills(spark, folder):
    """Completions for partial terms (here: pieces of part names), ten per term."""
    parts = table(spark, folder, "part")
    terms = parts.select(
        F.explode(
            F.array(
                F.substring("p_name", 1, 2), F.substring("p_name", 2, 2), F.substring("p_type", 1, 3), F.expr("right(p_name, 2)")
            )
        ).alias("term")
    )
    return K.suggest(terms, K.alias_rows(K.dictionary(spark)))


_ADDED = (
    "add0 AS (SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'PYTHON' WHEN 1 THEN upper(p_name) ELSE p_type END AS canonical_name, "
    "concat(p_name, ' ', CAST(p_size AS STRING)) AS alias, CASE WHEN p_size > 25 THEN 'tools' ELSE 'cloud' END AS category FROM part)"
)


@register(
    f"WITH {_ADDED}, known(canonical, category, aliases) AS (VALUES "
    + ", ".join(f"({quote(n)}, {quote(c)}, {quote('|'.join(a))})" for _, n, c, a in W.SKILL_DICTIONARY)
    + "), g AS (SELECT lower(canonical_name) AS nl, arg_min(canonical_name, seq) AS cn, arg_min(category, seq) AS cat, count(DISTINCT alias) AS fresh FROM add0 GROUP BY 1) "
    "SELECT coalesce(k.canonical, cn) AS canonical, coalesce(k.category, cat) AS category, "
    "CAST(coalesce(len(list_filter(string_split(k.aliases, '|'), lambda a: a <> '')), 0) + coalesce(fresh, 0) AS BIGINT) AS n_aliases "
    "FROM known k FULL JOIN g ON lower(k.canonical) = g.nl"
)
def extend_dictionary(spark, folder):
    """Custom aliases, one per part: known names gain them, new names become entries."""
    parts = table(spark, folder, "part")
    additions = parts.select(
        F.col("p_partkey").alias("seq"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'PYTHON' WHEN 1 THEN upper(p_name) ELSE p_type END").alias("canonical_name"),
        F.expr("concat(p_name, ' ', CAST(p_size AS STRING))").alias("alias"),
        F.expr("CASE WHEN p_size > 25 THEN 'tools' ELSE 'cloud' END").alias("category"),
    )
    extended = K.add_custom_aliases(K.dictionary(spark), additions)
    return extended.groupBy("canonical", "category").agg(F.count_if("is_alias").alias("n_aliases"))


@register(
    f"WITH {_ADDED}, s AS (SELECT lower(alias) AS spelling, lower(canonical_name) AS nl, seq FROM add0), "
    "n AS (SELECT lower(canonical_name) AS nl, arg_min(canonical_name, seq) AS cn FROM add0 GROUP BY 1), "
    "w AS (SELECT spelling, arg_max(cn, seq) AS winner FROM s JOIN n USING (nl) GROUP BY 1) "
    "SELECT spelling AS alias_lower, CASE WHEN winner = 'PYTHON' THEN 'Python' ELSE winner END AS canonical FROM w"
)
def lookup_of_custom_aliases(spark, folder):
    """Which name each added spelling now leads to."""
    parts = table(spark, folder, "part")
    additions = parts.select(
        F.col("p_partkey").alias("seq"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'PYTHON' WHEN 1 THEN upper(p_name) ELSE p_type END").alias("canonical_name"),
        F.expr("concat(p_name, ' ', CAST(p_size AS STRING))").alias("alias"),
        F.expr("CASE WHEN p_size > 25 THEN 'tools' ELSE 'cloud' END").alias("category"),
    )
    dim = K.alias_rows(K.add_custom_aliases(K.dictionary(spark), additions))
    added = additions.select(F.lower("alias").alias("alias_lower")).distinct()
    return dim.join(added, "alias_lower", "left_semi").select("alias_lower", "canonical")


@register(
    "WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE round(c_custkey % 101 / 100, 2) END AS score FROM customer) "
    "SELECT c_custkey, CASE WHEN score IS NULL OR score = 0 THEN 'none' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS tier, "
    "CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent FROM s"
)
def confidence_tiers(spark, folder):
    score = F.expr("CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE round(c_custkey % 101 / 100, 2) END")
    scored = table(spark, folder, "customer").select("c_custkey", score.alias("score"))
    return scored.select(
        "c_custkey", confidence_tier(F.col("score")).alias("tier"), percent_of(F.col("score")).alias("percent")
    )
