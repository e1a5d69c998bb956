"""URL filters (operator 6): a path-template tree for each host.

Segments that are variable by their form (numbers, dates, long hexadecimal or mixed names) become wildcards at once, so that
a host's urls shrink to counts of templates before anything is shuffled. Level by level, to the end of the longest path, a
node with too many different children makes a wildcard of those that hold a small share. Sibling templates that differ in
the last segment are merged, in order of their shares of good pages, as long as a two-proportion test doesn't tell them apart;
wildcards bound their number. A merged branch is rejected if its share of good labels, smoothed towards its parent's, that
towards its host's and that towards all pages', is under a threshold, or if the upper bound of Wilson's interval of its share
is under the share of all pages: then it is worse than the rest for certain.

Fixed rules on hosts and path beginnings go first; the longest that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut
from proselake.llm.site_style import host_of

#: Rules of the url query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, a hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_that_fits(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host and beginning of the path in one string) that fits, as (rule, verdict), or null.

    A rule fits its host and all subdomains. Of rules of one length the first in alphabetical order wins.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        cut = rule.find("/") if "/" in rule else len(rule)
        own, begin = rule[:cut].lower(), rule[cut:]
        on_host = (host == own) | F.endswith(host, F.lit("." + own))
        fits.append(F.when(on_host & F.startswith(path, F.lit(begin)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """All segments of the path; variable ones by form are wildcards."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = F.regexp_extract
    return F.transform(
        raw,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.concat(F.lit("{number}"), ending(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when(s.rlike(r"^(?=.*[0-9].*[0-9].*[0-9]).{8,}$"), F.lit("{mixed}"))
        .otherwise(s),
    )


def templates(urls: DataFrame, most_children: int = 24, least_share: float = 0.05) -> DataFrame:
    """(host, kinds, template) for each different row of (host, kinds, n, good, labelled), which come counted already."""
    tree = cut(urls.withColumn("t", F.col("kinds")))
    # only where a host has so many children over all prefixes can one prefix have them
    places = tree.select("host", F.posexplode("t").alias("level", "child")).groupBy("host", "level").agg(F.count_distinct("child").alias("children"))
    for level in sorted(r["level"] for r in places.where(F.col("children") > most_children).select("level").distinct().collect()):
        at = F.lit(level + 1)
        child = F.get("t", F.lit(level))
        prefix = F.array_join(F.slice("t", 1, level), "/") if level else F.lit("")
        level_of = tree.where(F.size("t") >= at).select("host", prefix.alias("prefix"), child.alias("child"), "n")
        counts = level_of.groupBy("host", "prefix", "child").agg(F.sum("n").alias("n"))
        total = counts.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("whole")).where(F.col("children") > most_children)
        small = counts.join(total, ["host", "prefix"]).where(F.col("n") < least_share * F.col("whole")).select("host", "prefix", "child", F.lit(True).alias("small"))
        small = cut(small)
        if small.isEmpty():
            continue
        tree = tree.withColumn("prefix", prefix).withColumn("child", child).join(small, ["host", "prefix", "child"], "left")
        wild = F.concat(F.slice("t", 1, level), F.array(F.lit("*")), F.slice("t", F.lit(level + 2), F.greatest(F.size("t"), F.lit(1))))
        tree = cut(tree.withColumn("t", F.when(F.col("small") & (F.size("t") >= at), wild).otherwise(F.col("t"))).drop("prefix", "child", "small"))
    return tree.withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/"))).drop("t")


def merged_siblings(own: DataFrame, alike_z: float) -> DataFrame:
    """(host, template, m_good, m_labelled, branch) from (host, parent, template, good, labelled): counts of the merged siblings.

    A parent has as many children as templates() leaves at most, so that they fit in one row. Branches are numbered by share;
    siblings without a label are merged with none, and have no number.
    """
    known = own.where(F.col("labelled") > 0)
    one = F.struct((F.col("good") / F.col("labelled")).alias("share"), "template", "good", "labelled")
    rows = known.groupBy("host", "parent").agg(F.array_sort(F.collect_list(one)).alias("siblings"))
    kind = "array<struct<good:bigint,labelled:bigint,templates:array<string>>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = (last["good"] + x["good"]) / (last["labelled"] + x["labelled"]).cast("double")
        spread = F.sqrt(both * (1 - both) * (1 / last["labelled"] + 1 / x["labelled"]))
        alike = F.abs(x["share"] - last["good"] / last["labelled"]) <= alike_z * spread
        alone = F.array(F.struct(x["good"].alias("good"), x["labelled"].alias("labelled"), F.array(x["template"]).alias("templates")))
        joined = F.array(F.struct((last["good"] + x["good"]).alias("good"), (last["labelled"] + x["labelled"]).alias("labelled"), F.concat(last["templates"], F.array(x["template"])).alias("templates")))
        return F.when(F.size(acc) == 0, alone).when(alike, F.concat(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.concat(acc, alone))

    branches = rows.select("host", F.posexplode(F.aggregate("siblings", F.array().cast(kind), step)).alias("branch", "b"))
    return branches.select("host", F.explode("b.templates").alias("template"), F.col("b.good").alias("m_good"), F.col("b.labelled").alias("m_labelled"), "branch")


def judged(rows: DataFrame, alike_z: float = 1.96, strength: float = 20.0, least_good: float = 0.5, certain_z: float = 1.96) -> DataFrame:
    """(host, kinds, template, purity, verdict) from templates(): siblings alike are merged, shares smoothed, and compared."""
    own = rows.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    own = own.withColumn("parent", F.regexp_replace("template", r"/[^/]*$", ""))
    branch = own.groupBy("host", "parent").agg(F.sum("good").alias("b_good"), F.sum("labelled").alias("b_labelled"))
    host = branch.groupBy("host").agg(F.sum("b_good").alias("h_good"), F.sum("b_labelled").alias("h_labelled"))
    every = host.agg(F.sum("h_good").alias("g_good"), F.sum("h_labelled").alias("g_labelled"))
    r = own.join(merged_siblings(own, alike_z), ["host", "template"], "left").join(branch, ["host", "parent"]).join(host, "host").crossJoin(F.broadcast(every))  # one row of sums
    on_all = F.coalesce(F.try_divide("g_good", F.col("g_labelled").cast("double")), F.lit(1.0))
    on_host = (F.col("h_good") + strength * on_all) / (F.col("h_labelled") + strength)
    on_parent = (F.col("b_good") + strength * on_host) / (F.col("b_labelled") + strength)
    good, n = F.coalesce("m_good", F.lit(0)), F.coalesce("m_labelled", F.lit(0)).cast("double")
    purity = (good + strength * on_parent) / (n + strength)
    share, z2 = F.try_divide(good, n), certain_z**2
    most = F.try_divide(share + F.try_divide(F.lit(z2 / 2), n) + certain_z * F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(F.lit(z2 / 4), n * n)), 1 + F.try_divide(F.lit(z2), n))
    worse = F.coalesce(most < on_all, F.lit(False))
    scored = r.select("host", "template", purity.alias("purity"), F.when((purity < least_good) | worse, "block").otherwise("allow").alias("verdict"))
    return rows.select("host", "kinds", "template").join(scored, ["host", "template"])


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row.

    `labels` tells good (1) from bad (0) pages by id; other and null values count for nothing, repeated ones each. A null url
    or one without :// has an empty host and path; they form a host of their own. Repeated rows stay. No pages: no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("kinds", segments(F.col("path")))
    value = F.col(label_col)
    known = labels.where(F.col(label_id).isNotNull() & value.isin(0, 1)).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.sum(value.cast("long")).alias("good"), F.count(F.lit(1)).alias("labelled"))
    counts = rows.join(known, "id", "left").groupBy("host", "kinds").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"))
    known_templates = judged(templates(counts)).withColumnRenamed("verdict", "by_template")
    found = rows.join(known_templates, ["host", "kinds"], "left").withColumn("fits", rule_that_fits(F.col("host"), F.col("path"), rules))
    return found.select("id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", "by_template", F.lit("allow")).alias("verdict"), "template", "purity")
