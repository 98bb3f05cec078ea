"""URL filters: fixed rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path. It fits the host and its subdomains when the URL's
path starts with the rule's; of the rules that fit, the longest decides. URLs that a
rule decides are the labelled ones: trees learn from them and judge all others.

Features are built by SQL functions: lengths, depth, digit ratio, entropy, parameter
counts, and for the host's suffix its smoothed share of blocked labels and its
frequency. Trees are ``pyspark.ml`` gradient-boosted trees over a bounded sample;
suffix statistics are one table over all rows, the frequency over every row and the
share over every row that a rule decides. A suffix without such rows gets the overall
share. Judging needs no Python, and no shuffle as long as that table is small enough
to be copied.

Defined results: a null URL, or one without ``://``, has an empty host and path and
fits no rule. If the labelled URLs are all of one verdict it is the method's verdict
too (those of the sample count); without labelled URLs it is "allow". Repeated rows are judged one by one and
other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import free_name, let
from sparkwave.plans.lineage import cut
from sparkwave.plans.sizing import broadcast_if_small

MAX_LABELLED = 20_000
TREES = 12
DEPTH = 4
SMOOTHING = 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_query_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digits",
    "f_hyphens", "f_parameters", "f_entropy", "f_host_entropy", "f_fragment", "f_secure", "f_suffix_share", "f_suffix_count",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def match(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index into ``rules`` (from 0) of the longest rule that fits, the earlier one of equals; null if none does."""
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k].text))
    fits = [((host == rules[k].host) | host.endswith("." + rules[k].host)) & path.startswith(rules[k].path) for k in order]
    return F.coalesce(*[F.when(fit, F.lit(k)) for fit, k in zip(fits, order, strict=True)], F.lit(None).cast("int"))


def entropy(text: Column) -> Column:
    """Bits per character: characters are sorted and the lengths of the runs summed up."""

    def flow(total: Column, run: Column) -> Column:
        return total + F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def runs(letters: Column) -> Column:
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

        def step(a: Column, c: Column) -> Column:
            same = a["c"] == c
            return F.struct(
                c.alias("c"),
                F.when(same, a["run"] + 1.0).otherwise(1.0).alias("run"),
                F.when(same, a["total"]).otherwise(flow(a["total"], a["run"])).alias("total"),
            )

        bits = F.aggregate(letters, start, step, lambda a: flow(a["total"], a["run"]))
        return F.when(F.size(letters) > 0, F.log2(F.size(letters)) - bits / F.size(letters)).otherwise(0.0)

    return let(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), runs)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    size = F.length(url).cast("double")
    return [
        size.alias("f_length"),
        F.length(host).cast("double").alias("f_host_length"),
        F.length(path).cast("double").alias("f_path_length"),
        F.length(query).cast("double").alias("f_query_length"),
        _count(path, "/[^/]").alias("f_depth"),
        (_count(host, r"\.") + 1).alias("f_labels"),
        F.when(size > 0, _count(url, r"\d") / size).otherwise(0.0).alias("f_digit_ratio"),
        _count(host, r"\d").alias("f_host_digits"),
        _count(url, "-").alias("f_hyphens"),
        _count(query, "[^&]+").alias("f_parameters"),
        entropy(url).alias("f_entropy"),
        entropy(host).alias("f_host_entropy"),
        url.contains("#").cast("double").alias("f_fragment"),
        url.startswith("https").cast("double").alias("f_secure"),
    ]


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


@dataclass
class Model:
    """Trees, or one verdict for all; ``suffix`` has a row ``(suffix, f_suffix_share, f_suffix_count)`` per suffix met."""

    trees: GBTClassificationModel | None
    constant: str
    suffix: DataFrame
    share: float

    def features(self, df: DataFrame, url: Column, host: Column, path: Column) -> DataFrame:
        """``df`` with the columns ``FEATURES``."""
        known = df.select("*", *lexical(url, host, path), suffix_of(host).alias("f_suffix")).join(self.suffix, F.col("f_suffix") == F.col("suffix"), "left")
        unmet = {"f_suffix_share": self.share, "f_suffix_count": 0.0}
        return known.drop("f_suffix", "suffix").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in unmet.items()})


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="f_all").transform(df)


def fit(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, most: int = MAX_LABELLED) -> Model:
    """Learn from the distinct URLs that a rule decides; at most ``most`` of them, those with the smallest hash.

    Suffixes are counted over all rows.
    """
    host, path = host_and_path(F.col(url))
    verdicts = F.array(*[F.lit(float(r.verdict == "block")) for r in rules])
    every = df.select(F.col(url).alias("u"), host.alias("host"), path.alias("path"))
    every = every.select("*", F.get(verdicts, match(F.col("host"), F.col("path"), rules)).alias("label"))
    blocked = F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")
    counted = cut(every.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), blocked))
    total = counted.agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    share = total["blocked"] / total["labelled"] if total["labelled"] else 0.0
    smoothed = (F.col("blocked") + F.lit(SMOOTHING * share)) / (F.col("labelled") + F.lit(SMOOTHING))
    stats = counted.select("suffix", smoothed.alias("f_suffix_share"), (F.col("n") / F.lit(total["n"] or 1)).alias("f_suffix_count"))
    sample = cut(every.where("label is not null").dropDuplicates(["u"]).orderBy(F.xxhash64("u"), "u").limit(most))
    met = sample.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    model = Model(None, "block" if met["low"] == 1.0 else "allow", broadcast_if_small(stats), share)
    if met["low"] != met["high"]:
        rows = model.features(sample, F.col("u"), F.col("host"), F.col("path"))
        learner = GBTClassifier(featuresCol="f_all", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7)
        model.trees = learner.fit(_assemble(rows).select("label", "f_all").coalesce(4))
    return model


def judge(df: DataFrame, model: Model, url: str = "url", rules: Sequence[Rule] = RULES, out: str = "filter") -> DataFrame:
    """``df`` with a struct ``out``: ``host``, ``path``, ``rule`` (its text, null if none fits), ``verdict`` and ``score`` (of the trees). A column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    row = free_name(df, "_row")
    host, path = host_and_path(F.col(url))
    u = F.coalesce(F.col(f"{row}.{url}"), F.lit(""))
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row), host.alias("f_host"), path.alias("f_path"))
    inner = inner.select("*", match(F.col("f_host"), F.col("f_path"), rules).alias("f_rule"))
    if model.trees is None:
        inner = inner.withColumn("f_score", F.lit(float(model.constant == "block")))
    else:
        scored = model.trees.transform(_assemble(model.features(inner, u, F.col("f_host"), F.col("f_path"))))
        inner = scored.withColumn("f_score", _second(scored))
    names = F.array(*[F.lit(r.text) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    own = F.when(F.col("f_score") > 0.5, "block").otherwise("allow")
    result = F.struct(
        F.col("f_host").alias("host"),
        F.col("f_path").alias("path"),
        F.get(names, F.col("f_rule")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("f_rule")), own).alias("verdict"),
        F.col("f_score").alias("score"),
    )
    return inner.select(*[F.col(f"{row}.`{c}`").alias(c) for c in kept], result.alias(out))


def _second(scored: DataFrame) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(scored["probability"]), 1)
