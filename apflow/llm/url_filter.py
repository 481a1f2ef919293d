"""URL filtering by rules and, where none fits, by gradient-boosted trees on lexical features.

A rule is (verdict, host, path prefix); it fits its host and all subdomains if the URL's path
begins with its path, and the longest rule that fits decides. The URLs that rules decide are
the labelled ones: on at most ``sample`` of them (distinct URLs, half of them of each verdict,
least hashed first, weighted by how many they stand for) Spark ML's gradient-boosted trees learn "block" from the URL's lexical features: lengths, depth, digit
ratio, character entropy, numbers of parameters, hyphens and host labels, and statistics of
its suffixes (smoothed share of blocked URLs with the same top-level domain, same registered
domain, same first path segment, same file extension). The statistics count all labelled rows, for a row
of the sample those of other folds only (a URL's fold follows from its hash): without its own label
alone, the statistic would differ by the label and so give it away. All other URLs get the trees' verdict.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is judged
by the trees like any other; with labels of one verdict only in the whole table, that verdict is given, and without any
label ``allow``; rows are judged one by one (repeated rows alike); ties of rule length cannot happen on one
URL unless the same rule is listed twice, then the first counts; an empty table gives an empty result;
extra columns are kept, those with names of outputs are replaced. The list of rules is compiled
into one expression, so it is meant for rule lists of at most some hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apflow.llm.samples import least_hashed_distinct
from apflow.operators.joins import materialize

SAMPLE = 20_000
TREES, DEPTH, SEED = 12, 3, 5
SMOOTHING = 5.0
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]
SUFFIXES = ("tld", "domain", "segment", "extension")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out.cast("struct<verdict:string,rule:string>")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.split(url, "")
    # -sum p log p over the distinct characters
    entropy = F.aggregate(
        F.array_distinct(letters), F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", F.lit(0.0)).otherwise(
            (n - F.length(F.replace(url, c, F.lit("")))) / n * F.log((n - F.length(F.replace(url, c, F.lit("")))) / n)),
    )
    return {
        "f_length": F.length(url), "f_path_length": F.length(path), "f_host_length": F.length(host),
        "f_depth": F.regexp_count(path, F.lit("/[^/]")), "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "f_entropy": entropy, "f_params": F.when(url.contains("?"), F.regexp_count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("[^&=]+=?[^&]*"))).otherwise(0),
        "f_hyphens": F.regexp_count(url, F.lit("[-_]")), "f_labels": F.regexp_count(host, F.lit("[^.]+")),
        "f_escapes": F.regexp_count(url, F.lit("%[0-9a-fA-F]{2}")), "f_https": url.startswith("https:").cast("int"),
        "f_fragment": url.contains("#").cast("int"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {
        "tld": F.regexp_extract(host, r"([^.]*)$", 1), "domain": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
        "segment": F.regexp_extract(path, r"^/?([^/]*)", 1), "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
    }


def with_suffixes(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(f"s_{k}") for k, c in suffixes(F.col("host"), F.col("path")).items()])


def statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """Of each kind of suffix: (s_<kind>, b, c, folds), the blocked and all rows of ``labelled`` (host, path, label, fold) that have it.

    ``folds`` has the same two numbers of each fold.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("suffix")) for k, c in suffixes(F.col("host"), F.col("path")).items()])
    folds = F.array(*[F.struct(F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0.0)).alias("b"),
                               F.count_if(F.col("fold") == k).alias("c")) for k in range(FOLDS)])
    counts = materialize(
        labelled.select("label", "fold", F.explode(kinds).alias("s")).groupBy("s.kind", "s.suffix")
        .agg(F.sum("label").alias("b"), F.count("*").alias("c"), folds.alias("folds")))
    # a table each, so that the size of each is known to its join
    return {k: materialize(counts.where(F.col("kind") == k).select(F.col("suffix").alias(f"s_{k}"), "b", "c", "folds")) for k in SUFFIXES}


def fit_sample(labelled: DataFrame, sample: int, url_col: str) -> DataFrame:
    """Up to ``sample`` / 2 distinct URLs of each verdict, with ``weight``: how many distinct URLs of its verdict each stands for."""
    half = max(1, sample // 2)
    distinct = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct(F.xxhash64(url_col)).alias("n")).collect()}
    drawn = []
    for label, n in sorted(distinct.items()):
        rows = least_hashed_distinct(labelled.where(F.col("label") == label), half, n, url_col)
        drawn.append(rows.withColumn("weight", F.lit(max(1.0, n / half))))
    return reduce(DataFrame.unionByName, drawn)


def judge(pages: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score (null where a rule decided)."""
    outputs = ["host", "path", "rule", "verdict", "block_score"]
    base = pages.drop(*outputs).withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    base = base.withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in outputs]
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))

    def with_features(df: DataFrame) -> DataFrame:
        features = lexical_features(url, F.col("host"), F.col("path"))
        return df.select("*", *[c.cast("double").alias(k) for k, c in features.items()])

    labelled = base.where("__r is not null").select(F.col(url_col), "host", "path", (F.col("__r.verdict") == "block").cast("double").alias("label"),
                                                     F.pmod(F.xxhash64(url_col), F.lit(FOLDS)).alias("fold"))
    stats = statistics(labelled)
    every = stats["tld"].agg(F.sum("c").alias("n"), F.sum("b").alias("blocked")).first()  # each labelled row has one
    if not every["n"] or every["blocked"] in (0.0, float(every["n"])):
        only = "block" if every["n"] and every["blocked"] else "allow"
        return base.select(*kept, "host", "path", F.col("__r.rule").alias("rule"),
                           F.coalesce(F.col("__r.verdict"), F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    train = materialize(with_features(with_suffixes(fit_sample(labelled, sample, url_col))), small=True)  # at most ``sample`` rows
    share = every["blocked"] / every["n"]

    def with_statistics(df: DataFrame, own: bool) -> DataFrame:
        """Shares of blocked URLs by suffix; ``own``: of a labelled row, without the rows of its fold."""
        less = F.element_at("folds", (F.col("fold") + 1).cast("int")) if own else F.struct(F.lit(0.0).alias("b"), F.lit(0).alias("c"))
        for s in SUFFIXES:
            # no broadcast hint: there can be as many suffixes as labelled rows
            df = df.join(stats[s], f"s_{s}", "left").withColumn(
                f"f_{s}", (F.coalesce("b", F.lit(0.0)) - less["b"] + SMOOTHING * share)
                / (F.coalesce("c", F.lit(0)) - less["c"] + SMOOTHING)).drop("b", "c", "folds")
        return df

    inputs = [*lexical_features(url, F.col("host"), F.col("path")), *[f"f_{s}" for s in SUFFIXES]]
    assemble = VectorAssembler(inputCols=inputs, outputCol="__features")
    model = GBTClassifier(
        featuresCol="__features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, checkpointInterval=-1,
    ).fit(assemble.transform(with_statistics(train, True)).select("__features", "label", "weight").coalesce(1))
    model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__pred")
    told = base.where("__r is not null").select(*kept, "host", "path", F.col("__r.rule").alias("rule"),
                                                F.col("__r.verdict").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    scored = model.transform(assemble.transform(with_features(with_statistics(with_suffixes(base.where("__r is null")), False))))
    score = vector_to_array("__p")[1]
    return told.unionByName(scored.select(*kept, "host", "path", F.col("__r.rule").alias("rule"),
                                          F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"), score.alias("block_score")))
