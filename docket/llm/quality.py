"""Quality rules: per-document figures, and verdicts on hosts on which a rule fails far more often than on others.

Only built-in column expressions. A document's figures need its own text alone. Hosts are aggregated with a partial sum
before the shuffle, so that a host with a third of all rows is a few partial rows, and the join back is on a table with
a row per host, which is broadcast if it has at most 100,000 rows and otherwise joined by a shuffle with skewed keys
split.

Each rule's failures are counted by host. For each rule, a beta prior is fitted by moments to the rates of the hosts that
don't stand out: its mean, and the variance between hosts that chance within hosts doesn't explain. A host stands out if
it fails far more often than the median host, the scale being taken from the median down to the lower quartile, so that bad
hosts, up to nearly half of all, neither raise the mean nor hide each other. Median and quartile come from counts of hosts
in 1,001 bins of rates. A host's rate is shrunk towards the mean by the prior's strength, which is at most that of an average
host. A host is rejected when the shrunk rate of some rule is more than `deviations` standard deviations of the prior
above its mean; so hosts that differ by chance alone fall only beyond twice as many of their own standard errors.

Defined cases: a null or empty text has no words, so it fails; a null host is a host of its own; repeated rows count
each time; one host alone, or the worse of two, is never rejected; very long texts are taken whole, in arrays of their words; an empty table
gives no rows. Columns named as FIGURES, base_failed, host_rate, host_verdict or kept are replaced; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.shared import BLANKS, free_name, small, written

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The lower quartile of a normal distribution, in standard deviations below its median.
NORMAL_QUARTILE = 0.6745
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules, each true where a document fails. The first two are the base.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}


def bound(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in windows of five words that the text holds twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes of their words. Only where some window repeats, positions are sorted by hash:
    equal neighbours are repeats, and each repeated window adds the words up to the next one's start.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(o: Column) -> Column:
            last = F.size(o) - 1
            twice = F.filter(
                F.transform(
                    o,
                    lambda x, j: F.when(
                        ((j > 0) & (F.get(o, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(o, j + 1)["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.sort_array(twice)

        def total(starts: Column) -> Column:
            parts = F.transform(
                starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))
            )
            return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(bound(ordered, repeated), total)

    def windows(w: Column) -> Column:
        n = F.size(w) - (WINDOW - 1)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) < WINDOW + 1, none).otherwise(
        bound(
            windows(words),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)),
        )
    )


def figures(documents: DataFrame) -> DataFrame:
    """`documents` with FIGURES (long) and base_failed (boolean)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    counted = bound(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    name = free_name(documents, "counted")
    docs = documents.withColumn(name, counted)
    docs = docs.withColumns(
        {
            "n_words": F.col(f"{name}.n_words"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col(f"{name}.n_repeat_words"),
        }
    ).drop(name)
    return docs.withColumn("base_failed", F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})"))


def priors(counts: DataFrame, deviations: float) -> DataFrame:
    """(rule, mean, strength) of `counts` (host_docs, rule, fails): the prior of each rule, by the hosts that don't stand out."""
    rated = counts.withColumn("rate", F.col("fails") / F.col("host_docs"))
    bins = rated.groupBy("rule", F.floor(1000 * F.sqrt("rate")).alias("bin")).agg(
        F.count("*").alias("hosts"), F.sum("fails").alias("fails"), F.sum("host_docs").alias("host_docs")
    )
    rule = Window.partitionBy("rule")
    placed = bins.withColumns({"upto": F.sum("hosts").over(rule.orderBy("bin")), "every": F.sum("hosts").over(rule)})
    middle = placed.groupBy("rule").agg(
        F.pow((F.min(F.expr("if(2 * upto > every, bin, null)")) + 1) / 1000, 2).alias("centre"),
        F.pow(F.min(F.expr("if(4 * upto > every, bin, null)")) / 1000, 2).alias("quarter"),
        (F.sum("fails") / F.sum("host_docs")).alias("pooled"),
    )
    usual = F.col("host_docs") * (F.col("centre") + deviations * (F.col("centre") - F.col("quarter")) / NORMAL_QUARTILE)
    chance = deviations * F.sqrt(F.expr("host_docs * pooled * (1 - pooled)")) + deviations**2 / 3
    fitted = (
        rated.join(F.broadcast(middle), "rule")
        .where(F.col("fails") <= usual + chance)
        .groupBy("rule")
        .agg(
            (F.sum("fails") / F.sum("host_docs")).alias("mean"),
            F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("spread"),
            F.avg(1 / F.col("host_docs")).alias("noise"),
            F.avg("host_docs").alias("size"),
        )
    )
    binomial = F.col("mean") * (1 - F.col("mean"))
    between = F.col("spread") - binomial * F.col("noise")
    explained = F.least(F.greatest(F.try_divide(binomial, between) - 1, F.lit(1.0)), F.col("size"))
    return fitted.select("rule", "mean", F.when(between > 0, explained).otherwise(F.col("size")).alias("strength"))


def host_rates(scored: DataFrame, host: str = "source", deviations: float = 3.0) -> DataFrame:
    """A row per host: (host, host_docs, host_rate, host_verdict).

    host_rate is the greatest of the rules' shrunk rates; host_verdict names the rules that reject the host, '' if none do.
    """
    fails = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = written(scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), *fails), "host-counts")
    by_rule = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("fails")) for name in RULES))
    prior = priors(hosts.select("host_docs", F.inline(by_rule)), deviations)
    fitted = F.map_from_entries(F.collect_list(F.struct("rule", F.struct("mean", "strength"))))
    joined = hosts.join(F.broadcast(prior.agg(fitted.alias("prior"))))

    def shrunk(name: str) -> Column:
        """(rate, bound) of one rule on the host."""
        mean, strength = F.col("prior")[name]["mean"], F.col("prior")[name]["strength"]
        return F.struct(
            ((F.col(name) + mean * strength) / (F.col("host_docs") + strength)).alias("rate"),
            (mean + deviations * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bound"),
        )

    judged = joined.select("host", "host_docs", *(shrunk(name).alias(name) for name in RULES))
    falls = [F.when(F.col(f"{name}.rate") > F.col(f"{name}.bound"), F.lit(name)) for name in RULES]
    return judged.select(
        "host",
        "host_docs",
        F.greatest(*(F.col(f"{name}.rate") for name in RULES)).alias("host_rate"),
        F.concat_ws(",", *falls).alias("host_verdict"),
    )


def judge(documents: DataFrame, host: str = "source", deviations: float = 3.0) -> DataFrame:
    """`documents` with figures, base_failed, host_rate, host_verdict and kept.

    The figures are computed once: they are written with the given columns, as both the hosts' sums and the result
    need them. Select the columns to keep before the call.
    """
    return verdicts(written(figures(documents), "quality"), host, deviations)


def verdicts(scored: DataFrame, host: str = "source", deviations: float = 3.0) -> DataFrame:
    kept = scored.drop("host_rate", "host_verdict", "kept")
    name = free_name(kept, "host")
    rates = host_rates(scored, host, deviations).select(F.col("host").alias(name), "host_rate", "host_verdict")
    joined = kept.join(small(written(rates, "hosts")), F.col(host).eqNullSafe(F.col(name)), "left").drop(name)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") == ""))
