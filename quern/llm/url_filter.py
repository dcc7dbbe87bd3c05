"""URL filter: rules first, then a path-template tree learnt from what the rules label.

Evidence is counted in distinct pages (host and path): rows that repeat a page add nothing, so a table
repeated any number of times has the same verdicts.

Every host has a tree of path segments. Segments with digits are variable and become wildcards at
once. Of the others a segment stays if at least `share` of its parent's pages go through it. Rarer
ones are one wildcard where they hold `varies` of the parent's pages together; else those without any
labelled page are kept apart from the labelled ones. No decision depends on an absolute count.
Labelled branches of one parent are sorted by block rate and each is tested against the one before it
(two proportions, pooled, at `z`): a branch that does not differ joins its cluster, whose name lists
its members. The tree goes as deep as templates branch; where one template is left the rest of
its path is kept.

Labelled evidence reaches other hosts through the form, the path of a template with its wildcards: a
form that names a segment is evidence wherever it occurs if the block rates of the hosts that label it
do not differ (dispersion over hosts, at `z`), and `support` of its labelled pages lie on hosts with
both verdicts; where a host knows one verdict only, a label tells of the host and not of the form. The
block rate of such a form, else that of all labelled pages, is what a template's own share of blocked
pages is smoothed with. A template is rejected when that purity reaches `purity`, on `support` labelled
pages of its own and its form's.

Pages are first counted by (host, template), with map-side combination: the tree works on these
counts, never on pages. Verdicts return to pages by a join on the template; templates with a 64th of
all rows or more, 64 of them at most, are joined by broadcast instead, so no task gathers a hot one.

Edges: a null url or one without `://` has empty host and path; no rule fits it, and its template is
the root of the empty host. Each input row gives one row, repeated ones and those with a null id too.
Rules of equal length cannot tie on one url unless they are equal; the later one wins then. A very long
url is one row; its segments are levels of the tree only as far as another url shares them. Columns
but the id and the url are not read. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, stored

#: Verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SHARE, VARIES, Z, SMOOTH, PURITY, SUPPORT, HOT = 0.02, 0.5, 1.96, 5.0, 0.8, 10, 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host, then path length; later ones win ties) and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def template_of(path: Column) -> Column:
    """Segments of a path, variable ones as wildcards."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def templates(counts: DataFrame, share: float = SHARE, varies: float = VARIES, z: float = Z) -> DataFrame:
    """Of (host, template, n, labelled, blocked) counts: (host, template, n, labelled, blocked, node, form), node being the merged template and form the one before merging."""
    none = F.array().cast("array<string>")
    now, done, level = counts.select("host", "template", "n", "labelled", "blocked", none.alias("node"), none.alias("form")), None, 0
    while True:
        now = now.withColumn("seg", F.coalesce(F.get("template", F.lit(level)), F.lit("")))
        child = now.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")), F.count(F.lit(1)).alias("rows"))
        parent = child.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.sum("rows").alias("all_rows"))
        child = child.join(parent, ["host", "node"]).withColumn("stays", (F.col("seg") == "") | F.startswith("seg", F.lit("*")) | (F.col("n") >= share * F.col("all_n")))
        tested = F.col("stays") & (F.col("seg") != "") & (F.col("labelled") > 0)
        rare = child.groupBy("host", "node").agg((F.sum(F.when(~F.col("stays"), F.col("n")).otherwise(0)) >= varies * F.first("all_n")).alias("variable"))
        child = child.join(rare, ["host", "node"])
        # branches that stay are at most 1 / share of a parent's, so the window's partitions are small
        by_rate = W.partitionBy("host", "node", "tested").orderBy("rate", "seg")
        child = child.withColumns({"tested": F.coalesce(tested, F.lit(False)), "rate": F.col("blocked") / F.greatest("labelled", F.lit(1))})
        other, of = F.lag("rate").over(by_rate), F.lag("labelled").over(by_rate)
        both = (F.col("blocked") + other * of) / F.greatest(F.col("labelled") + of, F.lit(1))
        error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-4)) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(of, F.lit(1))))
        child = child.withColumn("apart", F.when(F.col("tested"), F.coalesce(F.abs(F.col("rate") - other) > z * error, F.lit(True)).cast("int")).otherwise(0))
        child = child.withColumn("cluster", F.sum("apart").over(by_rate.rowsBetween(W.unboundedPreceding, 0)))
        inside = F.array_sort(F.collect_list(F.when(F.col("tested"), F.col("seg"))).over(W.partitionBy("host", "node", "tested", "cluster")))
        child = child.withColumn("members", F.when(F.col("tested"), inside))
        plain = F.when(F.col("stays"), F.col("seg")).when(F.col("variable") | (F.col("labelled") > 0), F.lit("*")).otherwise(F.lit("{rare}"))
        named = child.select("host", "node", "seg", "all_rows", plain.alias("plain"), F.when(F.size("members") > 1, F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}"))).otherwise(plain).alias("name"))
        # a path that ends here, or the only one that is left, is done
        ends = (F.col("seg") == "") | (F.col("all_rows") == 1)
        rest = F.slice("template", level + 1, F.greatest(F.size("template") - level, F.lit(0)))
        longer = lambda path, name: F.concat(path, F.when(ends, rest).otherwise(F.array(name))).alias(path)
        now = now.join(named, ["host", "node", "seg"])
        now = stored(now.select("host", "template", "n", "labelled", "blocked", longer("node", "name"), longer("form", "plain"), ends.alias("ends")), "tree")
        ended, now, level = now.where("ends").drop("ends"), now.where("not ends").drop("ends"), level + 1
        done = ended if done is None else done.unionAll(ended)
        if now.isEmpty():
            return done


def forms(tree: DataFrame, z: float = Z, support: int = SUPPORT) -> DataFrame:
    """(form, told, form_rate): the labelled pages and block rate of forms that are evidence on every host."""
    hosts = tree.where("labelled > 0").groupBy("host").agg((F.sum("blocked").between(1, F.sum("labelled") - 1)).alias("both"))
    named = F.exists("form", lambda s: ~F.startswith(s, F.lit("*")) & ~s.isin("{rare}"))
    of = tree.where((F.col("labelled") > 0) & named).groupBy("form", "host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).join(hosts, "host")
    of = of.groupBy("form").agg(F.sum("l").alias("told"), (F.sum("b") / F.sum("l")).alias("form_rate"), F.sum(F.when(F.col("both"), F.col("l")).otherwise(0)).alias("apart"), F.sum(F.col("b") * F.col("b") / F.col("l")).alias("squares"), (F.count(F.lit(1)) - 1).alias("free"))
    dispersion = (F.col("squares") - F.col("form_rate") * F.col("form_rate") * F.col("told")) / F.greatest(F.col("form_rate") * (1 - F.col("form_rate")), F.lit(1e-4))
    return of.where((dispersion <= F.col("free") + z * F.sqrt(2 * F.col("free")) + 1e-6) & (F.col("apart") >= support)).select("form", "told", "form_rate")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, smooth: float = SMOOTH, purity: float = PURITY, support: int = SUPPORT) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, template_purity)."""
    url = F.col(url_col)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    said = lambda df: df.select("*", name.alias("rule"), verdict.alias("said"), template_of(F.col("path")).alias("template"))
    pages_of = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"))
    counts = stored(said(pages_of).groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("blocked"), F.sum("rows").alias("rows")), "url-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    tree = templates(counts.drop("rows"))
    totals = tree.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = (totals[0] or 0) / totals[1] if totals[1] else 0.5
    pure = tree.groupBy("host", "node").agg(F.sum("labelled").alias("own"), F.sum("blocked").alias("own_blocked"))
    judged = tree.select("host", "template", "node", "form").join(pure, ["host", "node"]).join(forms(tree, support=support), "form", "left")
    judged = judged.withColumn("template_purity", (F.col("own_blocked") + smooth * F.coalesce("form_rate", F.lit(float(prior)))) / (F.col("own") + smooth))
    known = F.col("own") + F.coalesce("told", F.lit(0)) >= support
    judged = judged.select("host", "template", F.concat(F.lit("/"), F.array_join("node", "/")).alias("shown"), "template_purity", (known & (F.col("template_purity") >= purity)).alias("rejected"))
    judged = stored(judged.join(counts.select("host", "template", "rows"), ["host", "template"]).withColumn("hot", F.col("rows") * HOT >= F.lit(total)).drop("rows"), "judged")
    hot = judged.where("hot").select("host", "template", "hot", *(F.col(x).alias("hot_" + x) for x in ("shown", "template_purity", "rejected")))
    marked = said(rows).join(F.broadcast(hot), ["host", "template"], "left")
    shown = lambda x: F.coalesce("said", F.when(F.col(x + "rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    out = lambda df, x: df.select("page_id", "host", "path", "rule", shown(x), F.col(x + "shown").alias("template"), F.col(x + "template_purity").alias("template_purity"))
    cold = marked.where("hot is null").select("page_id", "host", "path", "rule", "said", "template").join(judged.where("not hot").drop("hot"), ["host", "template"])
    return out(marked.where("hot"), "hot_").unionAll(out(cold, ""))
