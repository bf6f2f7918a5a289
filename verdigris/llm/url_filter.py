"""URL filter: explicit rules first, then a path-template tree per host with smoothed labelled purity.

The tree of a host has a node for each template of leading path segments.

* Variable segments become wildcards: by shape (``{n}`` digits, ``{x}`` long or mixed tokens), and of a node with more
  than ``max_children`` different children those become ``*`` whose labels are none or don't differ from the node's.
* The tree is as deep as the labels need: levels are added until no branch with labels of both kinds has further segments.
* Statistically similar branches are merged, which means that they share one estimate: the children of a node whose
  share of bad labels lies within ``z`` standard errors of the node's keep the node's; the others, in the order of their
  shares and on either side of the node's, are merged with the sibling before them as long as the two differ by less than
  ``z`` standard errors of their pooled share. Their subtrees stay apart, so what differs further down is still found.
* A branch's purity is its share of bad labels, drawn towards its parent's by ``smoothing`` pseudo-labels (the root
  of a host towards that of all hosts). Templates of ``reject_at`` or more are blocked, if there is any label at all.

Everything is aggregated by template before anything is joined: the labels of a page meet only the sums of its template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    """The host, lower-cased; empty for a null url or one without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Equally long ones go by code points."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else F.when(fits, value).otherwise(out)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segment_shape(segment: Column) -> Column:
    """A segment, or its wildcard if its shape is that of an id."""
    plain = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(plain.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when((F.length(plain) > 24) | plain.rlike(r"^[0-9A-Fa-f-]{8,}$") | plain.rlike(r"[0-9]{3,}"), F.lit("{x}"))
        .otherwise(segment)
    )


def template_tree(pages: DataFrame, *, max_children: int = 50, z: float = 1.96, smoothing: float = 10.0) -> DataFrame:
    """(host, template, bad_share) from rows (host, template, bad); bad is 1, 0 or null, a template segments with / between.

    The share is null if no row has a label.
    """
    tree = materialize(pages.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "templates")
    mixed = F.when((F.col("_k") > 0) & (F.col("_k") < F.col("_n")), F.col("_n")).otherwise(0)
    total = tree.agg(F.when(F.sum("n") > 0, (F.sum("k") + 1) / (F.sum("n") + 2)).alias("p_root"))
    root = tree.groupBy("host").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k")).crossJoin(F.broadcast(total))  # the total is one row
    root = root.withColumn("p", (F.col("_k") + smoothing * F.col("p_root")) / (F.col("_n") + smoothing)).select("host", "p", mixed.alias("labels"))
    columns = ["host", "template", "n", "k", "node", "p", "labels", "ended"]
    live = materialize(tree.join(root, "host").withColumns({"node": F.lit(""), "ended": F.lit(False)}).select(*columns), "tree")
    done, level = [], 0
    while True:
        over = F.col("ended") | (F.col("labels") == 0)  # nothing below tells its children apart
        done.append(live.where(over).select("host", "template", F.col("p").alias("bad_share")))
        rest = live.where(~over)
        if rest.isEmpty():
            break
        segments = F.split("template", "/")
        rest = rest.withColumn("segment", F.coalesce(F.get(segments, F.lit(level)), F.lit(""))).withColumn("ended", F.size(segments) <= level)
        child = rest.groupBy("host", "node", "segment").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("p").alias("p"))
        wide = child.groupBy("host", "node").agg(F.count("*").alias("_c"), ((F.sum("k") + 1) / (F.sum("n") + 2)).alias("_p")).where(F.col("_c") > max_children)
        own = F.abs(F.col("k") - F.col("n") * F.col("_p")) - 0.5 > z * F.sqrt(F.col("n") * F.col("_p") * (1 - F.col("_p")))
        kept = F.col("_c").isNull() | (F.col("segment") == "") | own & (F.col("n") > 0)
        child = child.join(wide, ["host", "node"], "left").withColumn("g", F.when(kept, F.col("segment")).otherwise(F.lit("*")))
        each = child.groupBy("host", "node", "g").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), F.first("p").alias("p"))
        spread = F.sqrt(F.col("p") * (1 - F.col("p")) / F.greatest(F.col("_n"), F.lit(1)))
        apart = (F.col("_n") > 0) & (F.abs(F.col("_k") / F.greatest(F.col("_n"), F.lit(1)) - F.col("p")) > z * spread)
        each = each.withColumns({"_side": F.when(apart, F.signum(F.col("_k") / F.greatest(F.col("_n"), F.lit(1)) - F.col("p"))).otherwise(0), "_own": F.col("_k") / F.greatest(F.col("_n"), F.lit(1))})
        side = Window.partitionBy("host", "node", "_side").orderBy("_own", "g")
        n, k, n0, k0 = F.col("_n"), F.col("_k"), F.lag("_n").over(side), F.lag("_k").over(side)
        pooled = (k + k0) / F.greatest(n + n0, F.lit(1))
        parts = F.abs(k / F.greatest(n, F.lit(1)) - k0 / F.greatest(n0, F.lit(1))) > z * F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(n0, F.lit(1))))
        each = each.withColumn("_new", F.when(F.coalesce(parts, F.lit(True)), 1).otherwise(0)).withColumn("_branch", F.sum("_new").over(side))
        branch = Window.partitionBy("host", "node", "_side", "_branch")
        drawn = (F.sum("_k").over(branch) + smoothing * F.col("p")) / (F.sum("_n").over(branch) + smoothing)
        each = each.select("host", "node", "g", F.when(F.col("_side") != 0, drawn).otherwise(F.col("p")).alias("p"), mixed.alias("labels"))
        step = child.select("host", "node", "segment", "g").join(each, ["host", "node", "g"])
        live = rest.drop("p", "labels").join(step, ["host", "node", "segment"]).withColumn("node", F.concat("node", F.lit("/"), "g"))
        live = materialize(live.select(*columns), "tree")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "page_id",
    bad_col: str = "bad",
    rules: tuple[tuple[str, str], ...] = RULES,
    reject_at: float = 0.5,
    max_children: int = 50,
) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, bad_share (of its template).

    ``labels`` has ids and ``bad`` (1 or 0; null is no label; of several labels of an id the largest counts). Null
    urls and those without ``://`` have an empty host and path, no rule, and the verdict of the empty host's root.
    Repeated rows are judged alike; an empty table gives no rows. Without any label the share is null, and ``allow`` the
    verdict of the method. Other columns are ignored, whatever their names; a url counts whole, however long it is.
    """
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "^/", ""), "/+$", ""), "/")
    rows = rows.withColumn("template", F.array_join(F.transform(parts, segment_shape), "/"))
    known = labels.where(labels[bad_col].isNotNull()).groupBy(labels[label_id].alias("page_id")).agg(F.max(labels[bad_col]).cast("int").alias("bad"))
    tree = template_tree(rows.join(known, "page_id", "left").select("host", "template", "bad"), max_children=max_children)
    on = (F.col("r.host") == F.col("t.host")) & (F.col("r.template") == F.col("t.template"))
    judged = rows.alias("r").join(tree.alias("t"), on, "left").select("r.page_id", "r.host", "r.path", "t.bad_share")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    judged = judged.withColumn("_rule", rule)
    return judged.select(F.col("page_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "bad_share")
