"""URL filtering by host and path rules and by mined association rules.

Only DataFrame operations and Spark's own FP-growth.  A url's tokens are its host
suffixes, path words, and query keys.  FP-growth over the labelled urls' tokens
(with the token ``=bad`` for bad ones) gives rules tokens -> ``=bad``; those of
enough confidence and support stay, unless a part of their tokens makes a rule of
at least the same confidence.  Rules are matched by an inverted index: a rule is
filed under its rarest token, an url meets the rules of its own tokens, and a rule
fits if all its tokens are there.

Explicit rules come first: the longest that fits decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CONFIDENCE, MIN_COUNT, MIN_LIFT, Z = 0.6, 10, 1.3, 2.33
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_SPLIT = "(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes of two labels and more, path words that aren't numbers, query keys."""
    labels = F.split(host(url), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(F.lower(path(url)), "[^\\p{L}\\p{N}]+"), lambda w: ~w.rlike("^\\p{N}*$")), lambda w: F.concat(F.lit("p:"), w))
    rest = F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))
    keys = F.transform(F.regexp_extract_all(F.regexp_replace(rest, "(?s)#.*$", ""), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda w: F.concat(F.lit("q:"), F.lower(w)))
    return F.array_distinct(F.filter(F.concat(suffixes, words, keys), lambda t: t != "h:"))


def mine(labelled: DataFrame, min_support: float = 0.0, min_confidence: float | None = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(items, confidence, key) from rows (url, bad).

    A rule's tokens are in min_count urls at least, at any number of urls; min_support
    asks for a share of them too.  Where min_confidence is None, bad urls may be too few
    for any fixed confidence: a rule must then be MIN_LIFT times as sure as the share of
    bad ones among all, and the lower end of Wilson's interval of its confidence (Z
    standard errors) must be above that share.  Equal rows count once; a null url or
    label doesn't count.  Tokens that are in the same urls throughout are mined as one.
    """
    rows = labelled.where("url is not null and bad is not null").select("url", "bad").distinct()
    rows = rows.select("bad", F.xxhash64("url", "bad").alias("row"), tokens(F.col("url")).alias("has")).where(F.size("has") > 0)
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    none = labelled.sparkSession.createDataFrame([], "items array<string>, confidence double, key string")
    if not total["bad"]:
        return none
    base = total["bad"] / total["n"]
    sure = min_confidence if min_confidence is not None else min(1.0, MIN_LIFT * base)
    least = max(min_count, -(-min_support * total["n"] // 1))
    held = rows.select("bad", "row", F.explode("has").alias("t"))
    freq = held.groupBy("t").agg(F.count("*").alias("freq"), F.sum(F.col("row").cast("decimal(38,0)")).alias("mark"), F.bit_xor("row").alias("mark2")).where(F.col("freq") >= least)
    # One token stands for all that are in the same urls.
    alike = freq.groupBy("freq", "mark", "mark2").agg(F.min("t").alias("stands"), F.collect_list("t").alias("for"))
    items = held.join(alike.select(F.col("stands").alias("t")), "t").groupBy("row").agg(F.array_sort(F.collect_list("t")).alias("items"), F.any_value("bad").alias("bad"))
    baskets = items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    if not n:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min(1.0, sure)).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("items"), "confidence")
    if min_confidence is None:
        size = F.size("items")
        counts = model.freqItemsets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), "freq")
        rules = rules.join(counts, "items").where(_wilson(F.col("confidence"), F.col("freq")) > base).where(size > 0).select("items", "confidence")
    rules = rules.withColumn("rule", F.xxhash64("items"))
    # A rule goes if its tokens less one make a rule that is as sure (so the shortest of such a chain stay).
    less = rules.select("rule", "confidence", F.explode("items").alias("t"), "items").select("rule", "confidence", F.xxhash64(F.array_remove("items", F.col("t"))).alias("part"))
    weak = less.join(rules.select(F.col("rule").alias("part"), F.col("confidence").alias("sure")), "part").where("sure >= confidence").select("rule").distinct()
    rules = rules.join(weak, "rule", "left_anti")
    filed = rules.select("rule", "confidence", F.explode("items").alias("stands")).join(alike, "stands").select("rule", "confidence", "freq", F.explode("for").alias("t"))
    return filed.groupBy("rule").agg(F.array_sort(F.collect_list("t")).alias("items"), F.first("confidence").alias("confidence"), F.min_by("t", F.struct("freq", "t")).alias("key")).drop("rule")


def _wilson(share: Column, n: Column) -> Column:
    """Lower end of Wilson's interval of a share of n."""
    z2 = Z * Z
    return (share + z2 / (2 * n) - Z * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def judge(df: DataFrame, rules: DataFrame, explicit: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of carry, host, path, rule, verdict, confidence, for every row.

    rule is the explicit rule that decides, as host and path, or null; then the
    verdict is the mined rules': block if one fits, else allow, and confidence is
    that of the surest which fits.  A null url, and one without ``://``, has an
    empty host and path and is allowed.  Rows that repeat are judged alike.
    """
    if clash := set(carry) & {"host", "path", "rule", "verdict", "confidence", "__url"}:
        raise ValueError(f"carry holds names of the result: {sorted(clash)}")
    rows = df.select(*[df[c] for c in carry], df[url_col].alias("__url"))
    urls = rows.where("__url is not null").select("__url").distinct()
    met = urls.select("__url", tokens(F.col("__url")).alias("has")).select("__url", "has", F.explode("has").alias("key")).join(rules, "key")
    fit = met.where(F.size(F.array_except("items", "has")) == 0).groupBy("__url").agg(F.max("confidence").alias("sure"))
    h, p = F.col("host"), F.col("path")
    at = rows.withColumn("host", host(F.col("__url"))).withColumn("path", path(F.col("__url")))
    chosen = F.coalesce(*[F.when(((h == rh) | h.endswith("." + rh)) & p.startswith(rp), F.struct(F.lit(rh + rp).alias("rule"), F.lit(v).alias("verdict"))) for v, rh, rp in sorted(explicit, key=lambda r: -len(r[1] + r[2]))], F.lit(None).cast("struct<rule:string,verdict:string>"))
    at = at.withColumn("decided", chosen)
    # Rows without a url meet no rule, and don't go to one task to find that out.
    judged = at.where("__url is not null").join(fit, "__url", "left").unionByName(at.where("__url is null").withColumn("sure", F.lit(None).cast("double")))
    mined = F.when(F.col("sure").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    sure = F.when(F.col("decided").isNull(), F.col("sure")).alias("confidence")
    return judged.select(*carry, "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", mined).alias("verdict"), sure)
