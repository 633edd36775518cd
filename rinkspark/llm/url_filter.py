"""URL filters by path templates, in DataFrame operations only.

1. An explicit rule list decides first: a rule ``host/path`` fits its host and
   all subdomains if the url's path starts with the rule's; the longest wins.
2. The rest is judged by a template tree. Per host, depth by depth, a segment
   of ``MIN_URLS`` urls or more below its parent is literal, however large the
   parent is; every other one becomes a wildcard (its extension is kept).
   Literal siblings that are statistically alike are merged into one branch:
   they are binned by bad share and by the share of urls that go deeper, and
   neighbouring bins that two-proportion tests cannot tell apart are joined
   (named ``{a|+2}``: the least segment and how many more). So a parent has as
   many branches as bins at most, and no window holds more than its bins. The
   tree ends where no parent has ``MIN_URLS`` urls left; what is below are
   wildcards.
3. A template with labelled urls whose smoothed share of bad ones reaches a
   bound is rejected. Labels are the rules' own verdicts, or a 0/1 column of the input.

Work per row is narrow (id, host, path); html is never read. Statistics are
plain aggregates (partial sums before each shuffle), so a host with a third of
all urls is combined map-side. Literal and template tables are broadcast only
if a bounded count proves them small, else joined by shuffle, where AQE splits
skewed partitions.

Defined results: a null url or one without ``://`` has empty host and path; an
empty path matches no rule, as rule paths begin with ``/``. Repeated urls count
as often as they occur. Input columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import ref, staged

#: A segment is literal from this many urls below its parent.
MIN_URLS = 8
#: Bins of the bad share and of the share of deeper urls.
BINS = 20
#: Two siblings differ if a two-proportion test exceeds this many deviations.
MERGE_Z = 1.96
#: Weights of the host's and the whole table's bad share, in urls.
TEMPLATE_PRIOR = 4.0
HOST_PRIOR = 8.0
#: Smoothed bad share from which a template is rejected.
REJECT = 0.8
#: Rows up to which a literal or template table is broadcast.
BROADCAST_ROWS = 50_000


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_struct(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null. Rules
    are (verdict, ``host/path``) pairs; of equally long ones the first in
    string order wins."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, tail = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + tail)
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def _differs(hits: Column, n: Column, other_hits: Column, other_n: Column) -> Column:
    """Two-proportion z test of hits/n against other_hits/other_n."""
    pooled = (hits + other_hits) / (n + other_n)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / other_n))
    return F.when((n > 0) & (other_n > 0) & (spread > 0), F.abs(hits / n - other_hits / other_n) > MERGE_Z * spread).otherwise(F.lit(False))


def _branches(rows: DataFrame, depth: int) -> DataFrame:
    """Literal children at a depth: host, template, segment, branch name."""
    child = rows.filter(F.size("segs") > depth).groupBy("host", "template", F.get("segs", F.lit(depth)).alias("seg"))
    child = child.agg(
        F.count("*").alias("n"),
        F.sum("labelled").alias("labelled"),
        F.sum("bad").alias("bad"),
        F.sum((F.size("segs") > depth + 1).cast("long")).alias("deeper"),
    ).filter(F.col("n") >= MIN_URLS)
    bad_bin = F.when(F.col("labelled") > 0, F.floor(BINS * F.col("bad") / F.col("labelled"))).otherwise(F.lit(-1))
    child = staged(child.withColumns({"bad_bin": bad_bin.cast("int"), "deep_bin": F.floor(BINS * F.col("deeper") / F.col("n")).cast("int")}), "url-children")

    keys = ["host", "template", "bad_bin", "deep_bin"]
    bins = child.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad", "deeper")], F.min("seg").alias("least"), F.count("*").alias("segments"))
    order = Window.partitionBy("host", "template").orderBy("bad_bin", "deep_bin")  # a few hundred bins at most
    before = {c: F.lag(c).over(order) for c in ("n", "labelled", "bad", "deeper")}
    parts = (
        before["n"].isNull()
        | ((F.col("labelled") > 0) != (before["labelled"] > 0))
        | _differs(F.col("bad"), F.col("labelled"), before["bad"], before["labelled"])
        | _differs(F.col("deeper"), F.col("n"), before["deeper"], before["n"])
    )
    grouped = bins.withColumn("opens", parts.cast("int")).withColumn("group", F.sum("opens").over(order))
    group = Window.partitionBy("host", "template", "group")
    grouped = grouped.withColumns({"name": F.min("least").over(group), "size": F.sum("segments").over(group)})
    branch = F.when(F.col("size") == 1, F.col("name")).otherwise(F.concat(F.lit("{"), "name", F.lit("|+"), (F.col("size") - 1).cast("string"), F.lit("}")))
    names = grouped.select(*keys, "group", branch.alias("branch"))
    return child.join(_small(staged(names, "url-bins")), keys).select("host", "template", "seg", "branch")


def with_templates(rows: DataFrame) -> DataFrame:
    """Add ``template`` to rows (host, segs, labelled, bad, ...)."""
    out, depth = rows.withColumn("template", F.lit("")), 0
    while True:
        parents = out.filter(F.size("segs") > depth).groupBy("host", "template").count()
        if (parents.agg(F.max("count")).first()[0] or 0) < MIN_URLS:
            break
        branches = staged(_branches(out, depth), "url-branches")
        seg = F.get("segs", F.lit(depth))
        out = out.withColumn("seg", F.coalesce(seg, F.lit(""))).join(_small(branches), ["host", "template", "seg"], "left")
        step = F.when(F.size("segs") > depth, F.concat(F.lit("/"), F.coalesce("branch", _wildcard(F.col("seg"))))).otherwise(F.lit(""))
        out = out.withColumn("template", F.concat("template", step)).drop("seg", "branch")
        if depth % 2:
            out = staged(out, "url-templates")
        depth += 1
    rest = F.transform(F.slice("segs", depth + 1, F.greatest(F.size("segs") - depth, F.lit(0))), lambda x: F.concat(F.lit("/"), _wildcard(x)))
    return out.withColumn("template", F.concat("template", F.array_join(rest, "")))


def rejected_templates(rows: DataFrame) -> DataFrame:
    """(host, template, purity) of the templates to reject; purity is the bad
    share of labelled urls, smoothed towards the host's, and that towards the
    share in the whole table. A template without labels is not rejected."""
    stats = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    labelled, bad = rows.agg(F.sum("labelled"), F.sum("bad")).first()
    share = (bad or 0) / labelled if labelled else 0.0
    host_share = (F.col("host_bad") + HOST_PRIOR * share) / (F.col("host_labelled") + HOST_PRIOR)
    purity = (F.col("bad") + TEMPLATE_PRIOR * host_share) / (F.col("labelled") + TEMPLATE_PRIOR)
    return stats.join(hosts, "host").filter("labelled > 0").select("host", "template", purity.alias("purity")).filter(F.col("purity") >= REJECT)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template.

    ``bad_col`` names a 0/1 label column (null: not labelled); without it the
    urls that a rule decides are the labelled ones, blocked ones being bad.
    """
    url = ref(pages, url_col)
    parsed = pages.select(
        ref(pages, id_col).alias("page_id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        *([ref(pages, bad_col).cast("long").alias("label")] if bad_col else []),
    )
    parsed = parsed.withColumn("r", rule_struct(F.col("host"), F.col("path"), rules))
    label = F.col("label") if bad_col else (F.col("r.verdict") == "block").cast("long")
    rows = staged(
        parsed.select(
            "page_id",
            "host",
            "path",
            F.col("r.rule").alias("rule"),
            F.col("r.verdict").alias("rule_verdict"),
            F.filter(F.split("path", "/"), lambda s: s != "").alias("segs"),
            label.isNotNull().cast("long").alias("labelled"),
            F.coalesce(label, F.lit(0)).alias("bad"),
        ),
        "urls",
    )
    rows = with_templates(rows)
    rejected = _small(staged(rejected_templates(rows), "url-rejected"))
    out = rows.join(rejected, ["host", "template"], "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
