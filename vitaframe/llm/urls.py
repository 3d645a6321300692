"""URL filter: rules first, gradient-boosted trees on lexical features for the rest. Built-in functions only.

The trees learn from the urls that rules judge: about ``TRAIN_ROWS`` distinct ones at most, chosen by a hash
of the url, half of them of each verdict (more where the other has fewer) and weighted back to the shares
that the verdicts have, so a rare verdict is learned at every size. Suffix statistics (how many urls a suffix has, and the share of blocked ones among the judged)
cover all rows; they are summed in the map tasks, and a suffix with a third of all urls is one row each.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import UPPER, written

TRAIN_ROWS = 10_000
SEED = 42
_SIGNS = string.ascii_lowercase + string.digits + "-._~/?#&=%:@+"


class Rule(NamedTuple):
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest fitting rule (of equals a block, then by code point); null if none fits."""
    arms = []
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        arms.append(F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*arms) if arms else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers from the letters of a url alone. Entropy is over letters, digits and the usual signs."""
    text = F.lower(F.coalesce(url, F.lit("")))
    length = F.length(text)
    total = F.greatest(length, F.lit(1))
    count = lambda of, sign: F.length(of) - F.length(F.translate(of, sign, ""))
    shares = F.array(*[count(text, sign) / total for sign in _SIGNS])
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    numbers = {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "host_labels": count(host, ".") + 1,
        "digit_ratio": count(text, string.digits) / total,
        "path_digits": count(path, string.digits),
        "hyphens": count(text, "-"),
        "percents": count(text, "%"),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "fragment": F.when(text.contains("#"), 1).otherwise(0),
        "entropy": entropy,
    }
    return {name: value.cast("double") for name, value in numbers.items()}


def suffix_of(host: Column) -> Column:
    """The host's last label."""
    return F.substring_index(host, ".", -1)


def _with_features(df: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    return rows.withColumns({"suffix": suffix_of(host), "judged": rule_of(host, path, rules), **{f"x_{n}": c for n, c in lexical(F.col("url"), host, path).items()}})


def train(rows: DataFrame, suffixes: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[PipelineModel | None, str]:
    """The model, or none and the only verdict that the rules gave (allow if they gave none)."""
    known = rows.where("judged IS NOT NULL").drop("id").dropDuplicates(["url"])
    seen = known.groupBy("judged.verdict").agg(F.count(F.lit(1)).alias("n")).collect()  # two verdicts at most
    if len(seen) < 2:
        return None, seen[0]["verdict"] if seen else "allow"
    total, shares = sum(r.n for r in seen), F.lit(None).cast("double")
    for r in seen:
        quota = max(train_rows / 2, train_rows - (total - r.n))
        shares = F.when(F.col("judged.verdict") == r.verdict, min(1.0, quota / r.n)).otherwise(shares)
    drawn = known.withColumn("share", shares).where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < F.col("share") * (1 << 40)).join(suffixes, "suffix")
    labelled = drawn.withColumn("label", (F.col("judged.verdict") == "block").cast("double")).withColumn("weight", 1 / F.col("share"))
    sample = written(labelled.drop("url", "host", "path", "judged", "share"), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None, max(seen, key=lambda r: (r.n, r.verdict))["verdict"]
    inputs = [c for c in sample.columns if c.startswith(("x_", "suffix_"))]
    packed = VectorAssembler(inputCols=inputs, outputCol="features")
    trees = GBTClassifier(maxIter=10, maxDepth=4, seed=SEED, weightCol="weight").fit(packed.transform(sample))
    return PipelineModel([packed, trees]), ""


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """``id, host, path, rule, verdict`` per row of ``df``.

    Null urls and urls without ``://`` are judged by the trees; a url of any length is judged whole. Repeated rows get the
    same verdict, each its own row; null ids pass through. Without two verdicts to learn from the one there is (or
    allow) is given. Other columns have no effect, whatever their names; an empty table gives no rows.
    """
    rows = _with_features(df, id_col, url_col, rules)
    blocked = F.count(F.when(F.col("judged.verdict") == "block", 1))
    sums = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.count("judged").alias("known"), blocked.alias("blocked"))
    rate = (F.col("blocked") + 1.0) / (F.col("known") + 2.0)
    suffixes = written(sums.select("suffix", F.log1p("n").alias("suffix_count"), rate.alias("suffix_blocked")), "url-suffixes")
    model, only = train(rows, suffixes, train_rows)
    out = rows.join(suffixes, "suffix")
    if model:
        guess = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        out = model.transform(out).withColumn("guess", guess)
    else:
        out = out.withColumn("guess", F.lit(only))
    return out.select("id", "host", "path", F.col("judged.rule").alias("rule"), F.coalesce(F.col("judged.verdict"), "guess").alias("verdict"))
