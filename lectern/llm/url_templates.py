"""URL filter by rules and, where no rule speaks, by a path-template tree per host.

Method.  A path's segments are generalised one by one: figures, long hexadecimal runs and the like
become placeholders at once; then, level by level under each host and to the longest path, a node
with many different children none of which prevails has its children replaced by a wildcard, and
labelled siblings are merged; but children whose share of rejected pages differs significantly from
their parent's stay branches of their own.  A template's purity is its share of rejected labels,
smoothed towards its parent's and so up to the host and the corpus; a node without a choice of ways
passes its purity on.  Templates at or above ``reject`` are rejected.

Everything is DataFrame operations.  Pages are first aggregated to (host, generalised path), so the
tree is built from counts; a host that holds a third of all pages is a few rows there.  A template
that is alone at its node is finished at once, so the rounds are as many as levels at which paths part.

Defined results: a null url, or one without ``://``, has empty host and path; urls of any length
count whole, segments above ``longest`` characters (a parameter) alike; repeated rows are judged
alike; pages without a label count in no purity; with no labels at all the prior decides; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import staged, unstage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(rules: list[Rule], host: Column, path: Column, what: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def template(path: Column, longest: int = 48) -> Column:
    """Segments with variable ones as placeholders; one of more than ``longest`` characters is ``{long}``."""
    def general(s: Column) -> Column:
        s = F.translate(s, _UPPER, _LOWER)
        s = F.regexp_replace(s, r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}")
        s = F.regexp_replace(s, r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,}", "{hex}")
        s = F.regexp_replace(s, r"[0-9]+", "{n}")
        return F.when(F.length(s) > longest, F.lit("{long}")).otherwise(s)

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), general)


def _smoothed(bad: Column, labelled: Column, prior: Column, weight: float) -> Column:
    return (bad + prior * weight) / (labelled + weight)


def tree(pages: DataFrame, children: int = 12, prevail: float = 0.25, weight: float = 8.0, z: float = 1.96, prior: float = 0.05) -> DataFrame:
    """``(host, segments, node, purity)`` for each (host, generalised path) of ``pages`` (host, segments, label 0/1 or
    null), down to the longest path."""
    now = pages.groupBy("host", "segments").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("*").alias("n"))
    now = staged(now, "templates")
    root = now.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"))
    share = root.select(((F.col("b") + prior * weight) / (F.col("l") + weight)).alias("p")).first()["p"]  # one row
    hosts = now.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("labelled").alias("hl"))
    start = now.join(hosts, "host").withColumn("purity", _smoothed(F.col("hb"), F.col("hl"), F.lit(share), weight)).drop("hb", "hl").withColumn("node", F.lit(""))
    here, left, level, done = staged(start, "level"), [now], 0, []
    while True:
        # A node that one template alone has reached keeps its purity to that template's end.
        part = F.when(F.size("segments") > level, F.element_at("segments", level + 1))
        rows = here.withColumn("part", part)
        parts = rows.groupBy("host", "node", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("pn"), F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
        parts = staged(parts, "parts")
        nodes = parts.groupBy("host", "node").agg(
            F.sum("rows").alias("rows"), F.count("part").alias("kinds"), F.count("*").alias("ways"), F.max(F.when(F.col("part").isNotNull(), F.col("pn"))).alias("most"),
            *(F.sum(F.when(F.col("part").isNotNull(), F.col(c))).alias(to) for c, to in (("pn", "total"), ("pl", "al"), ("pb", "ab"))),
        )
        open_nodes = nodes.filter((F.col("rows") > 1) & (F.col("kinds") > 0)).drop("rows")
        rate = F.col("ab") / F.greatest("al", F.lit(1))
        spread = z * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) / F.greatest("pl", F.lit(1)))
        near = F.abs(F.col("pb") / F.greatest("pl", F.lit(1)) - rate) <= spread
        wild = (F.col("kinds") >= children) & (F.col("most") <= prevail * F.col("total")) & ((F.col("pl") == 0) | near)
        name = F.when(F.col("ways") == 1, F.col("part")).when(wild, "*").when((F.col("pl") > 0) & near, "~").otherwise(F.col("part"))
        named = parts.filter("part IS NOT NULL").drop("rows").join(open_nodes, ["host", "node"]).withColumn("name", name)
        sums = named.groupBy("host", "node", "name").agg(F.sum("pl").alias("nl"), F.sum("pb").alias("nb"))
        named = named.select("host", "node", "part", "name", "ways").join(sums, ["host", "node", "name"])
        grown = rows.join(named, ["host", "node", "part"])
        after = grown.select(
            "host", "segments", "n", "labelled", "bad",
            F.when(F.col("ways") == 1, F.col("purity")).otherwise(_smoothed(F.col("nb"), F.col("nl"), F.col("purity"), weight)).alias("purity"),
            F.concat("node", F.lit("/"), "name").alias("node"),
        )
        # Templates that end here, or are alone here, have their result.
        rest = F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0)))
        tail = F.when(F.size(rest) > 0, F.concat("node", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("node"))
        done.append(rows.join(named.select("host", "node", "part"), ["host", "node", "part"], "left_anti").select("host", "segments", tail.alias("node"), "purity"))
        done[-1] = staged(done[-1], "done")
        after = staged(after, "level")
        left += [here, parts]
        here, level = after, level + 1
        if not here.limit(1).count():
            break
    unstage(*left, here)
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, rules: list[Rule], label: Column, reject: float = 0.5, longest: int = 48, id_col: str = "page_id", url_col: str = "url", **shape) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` for every page.

    ``label`` is 1 for pages to reject, 0 for good ones and null where nothing is known; a rule's
    verdict stands for the label where one fits.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.cast("int").alias("label"))
    rows = rows.withColumn("rule", rule_for(rules, F.col("host"), F.col("path"), "name")).withColumn("said", rule_for(rules, F.col("host"), F.col("path"), "verdict"))
    rows = rows.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).otherwise(F.col("label")))
    rows = rows.withColumn("segments", template(F.col("path"), longest))
    found = tree(rows.select("host", "segments", "label"), **shape)
    out = rows.join(found, ["host", "segments"], "left")
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat("host", "node").alias("template"), F.round("purity", 9).alias("purity"))
