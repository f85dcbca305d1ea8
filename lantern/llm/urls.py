"""URL filters: host and path rules, then gradient-boosted trees on lexical features, in DataFrame operations only.

The trees are trained on labelled URLs: those of a table of labels, or, where there is none, those that a rule decides
and those whose host holds a blocked term. They read lengths, depths, digit ratios, entropies, parameter counts, and how often each suffix was blocked.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import broadcast_if_small, read, written

#: Labelled URLs that the trees are trained on at most, and the trees' number and depth.
MAX_SAMPLE, TREES, DEPTH = 20_000, 20, 4
#: Folds of hosts; a labelled URL's suffix statistics leave its own fold out.
FOLDS = 5
# Rules as (verdict, host, path); fixed values of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Terms in a host that label it blocked for training.
BLOCKED_TERMS = ("casino", "poker", "bets", "pills", "viagra", "adult", "porn", "spam", "warez", "crack")
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "depth", "longest_label", "longest_segment", "digit_ratio", "host_digit_ratio",
    "hyphens", "host_entropy", "path_entropy", "parameters", "has_fragment", "is_https", "suffix_rate", "ending_rate",
)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A to Z in lower case; empty for a null or other url."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; empty for a null or other url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like "com/fr/", and its verdict; nulls where none fits.

    A rule fits its host and all subdomains, on paths that start with its own. The list of rules is an argument and
    becomes one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, suffix, ending and the lexical features to the rows of urls."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) / F.greatest(F.length(x), F.lit(1))
    longest = lambda x: F.array_max(F.transform(x, F.length))
    df = urls.withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.withColumns(
        {
            "suffix": F.substring_index(host, ".", -1),
            "ending": F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,6}|/)$", 1)),
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "host_labels": F.size(F.split(host, r"\.")).cast("double"),
            "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
            "longest_label": longest(F.split(host, r"\.")).cast("double"),
            "longest_segment": longest(F.split(path, "/")).cast("double"),
            "digit_ratio": digits(url),
            "host_digit_ratio": digits(host),
            "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
            "host_entropy": entropy(host),
            "path_entropy": entropy(path),
            "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "is_https": url.startswith("https://").cast("double"),
        }
    )


def _rated(base: DataFrame, labelled: DataFrame, column: str, rate: str, overall: float) -> DataFrame:
    """Adds how often labelled URLs with the same value of column were blocked, drawn to the overall rate where they are few.

    A labelled URL's own fold of hosts is left out of its rate, so that the rate does not tell its label.
    """
    folds = labelled.groupBy(column, "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    total = folds.groupBy(column).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    each = total.withColumn("fold", F.explode(F.array(*map(F.lit, range(-1, FOLDS))))).join(folds, [column, "fold"], "left")
    left = lambda x: F.col(f"all_{x}") - F.coalesce(x, F.lit(0))
    rates = each.select(column, "fold", ((left("s") + 10 * overall) / (left("n") + 10)).alias(rate))
    return base.join(broadcast_if_small(written(rates)), [column, "fold"], "left").withColumn(rate, F.coalesce(rate, F.lit(overall)))


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, blocked_terms: tuple = BLOCKED_TERMS, max_sample: int = MAX_SAMPLE, labels: DataFrame | None = None, learn: Column | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability): one row per input row.

    The verdict is the rule's where one fits, else the trees': block from a probability of 0.5. Labels are those of
    table labels (url, blocked 0 or 1; of a url with both, blocked; other values and null urls teach nothing). Where
    that has no usable row, the rules' verdicts stand in and, where no rule fits, "block" for hosts that hold a blocked
    term. `learn`, on columns url and host, says which URLs may be learned from (all by default). Suffix statistics
    count all labelled rows; the trees see the labelled rows with the smallest url hashes, up to about max_sample.
    Without labels of both kinds every other row is allowed. Null and empty urls have an empty host and path and are
    judged like any other row; null ids and repeated rows are kept. Extra columns are not read, whatever their names.
    No rows give no rows.
    """
    base = features(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    given = None
    if labels is not None:
        usable = labels.where(F.col("blocked").isin(0, 1) & F.col("url").isNotNull())
        given = written(usable.groupBy("url").agg(F.max("blocked").cast("double").alias("label")))
    if given is not None and not given.isEmpty():
        base = base.join(broadcast_if_small(given), "url", "left")
    else:
        term = F.col("host").rlike("|".join(blocked_terms)) if blocked_terms else F.lit(False)
        base = base.withColumn("label", F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0).when(term, 1.0))
    if learn is not None:
        base = base.withColumn("label", F.when(learn, F.col("label")))
    base = written(base.withColumn("fold", F.when(F.col("label").isNull(), -1).otherwise(F.pmod(F.xxhash64("host"), F.lit(FOLDS))).cast("int")))
    labelled = base.where(F.col("label").isNotNull())
    rows, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < rows:
        return base.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("probability"))
    overall = blocked / rows
    rated = _rated(_rated(base, labelled, "suffix", "suffix_rate", overall), labelled, "ending", "ending_rate", overall)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated)
    sample = assembled.where(F.col("label").isNotNull())
    if rows > max_sample:
        sample = sample.where(F.xxhash64("url").bitwiseAND(F.lit((1 << 62) - 1)) < F.lit((1 << 62) * max_sample // rows))
    sample = written(sample.select("features", "label"))
    if sample.select("label").distinct().count() < 2:
        p = F.lit(overall)
        judged = rated
    else:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=32, seed=7).fit(sample)
        judged = model.transform(assembled)
        p = F.get(vector_to_array("probability"), F.lit(1))
    own = F.when(p >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), p.alias("probability"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages, by the default rules."""
    return filter_urls(read(spark, sf_dir, "pages"))
