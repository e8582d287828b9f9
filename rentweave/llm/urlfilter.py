"""URL rules by a sort-merge range join, in DataFrame operations only.

A host is written with its labels reversed and each closed by a dot (``com.example.www.``),
so a rule for a host and its subdomains is the interval of keys that begin with the
rule's key; a path rule is the interval of paths that begin with it. Such intervals are
nested or apart. ``sweep`` sorts addresses and interval starts together and keeps a stack of
the nested intervals begun last, one window column per level; a level is popped when the
address no longer begins with it. The first sweep finds the rule hosts that an address
lies under, the second one the path rules of each such host.

A group (top label, rule host) is split into as many sorted runs as its addresses need;
each run gets the group's interval starts, so the copies of rules never outnumber the
addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Addresses per sorted run, unless the group has more rules than that.
RUN = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host and path; both empty for null or no ``://``."""
    mark = F.instr(F.col(url), "://")
    rest = F.when(mark > 0, F.substring(F.col(url), mark + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _depths(starts: DataFrame) -> DataFrame:
    """Each interval start with its level: the starts of its group that its key begins with, itself included."""
    heads = starts.select(
        "grp", "key", F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", 1, n))).alias("head")
    )
    keys = starts.select("grp", F.col("key").alias("head"))
    depth = heads.join(keys, ["grp", "head"]).groupBy("grp", "key").agg(F.count("*").alias("depth"))
    return starts.join(depth, ["grp", "key"])


def sweep(points: DataFrame, starts: DataFrame) -> DataFrame:
    """``points(grp, key, body)`` with ``stack``: the active starts' ``tag``, outermost first.

    ``starts(grp, key, tag)`` are distinct in ``(grp, key)``. Points of groups without starts
    are left out.
    """
    levels = _depths(starts)
    deepest = levels.agg(F.max("depth")).first()[0] or 1
    rules = starts.groupBy("grp").agg(F.count("*").alias("rules"))
    runs = points.groupBy("grp").agg(F.count("*").alias("n")).join(rules, "grp").select(
        "grp", F.ceil(F.col("n") / F.greatest(F.lit(RUN), "rules")).cast("int").alias("runs")
    )
    placed = points.join(runs, "grp").select(
        "grp", F.pmod(F.xxhash64("key", "body"), "runs").cast("int").alias("run"), "key", F.lit(1).alias("kind"),
        "body", F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast(starts.schema["tag"].dataType).alias("tag"),
    )
    copies = levels.join(runs, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast(points.schema["body"].dataType).alias("body"), "depth", "tag",
    )
    order = Window.partitionBy("grp", "run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    start = F.struct("key", "tag")
    open_at = [
        F.last(F.when(F.col("depth") == level, start), ignorenulls=True).over(order) for level in range(1, deepest + 1)
    ]
    merged = placed.union(copies).select("grp", "key", "kind", "body", F.array(*open_at).alias("begun"))
    active = F.filter("begun", lambda s: s.isNotNull() & F.col("key").startswith(s["key"]))
    return merged.where("kind = 1").select("grp", "key", "body", F.transform(active, lambda s: s["tag"]).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rules(action, host, path)``: a rule fits its host and all subdomains if the path begins
    with the rule's. The longest (host and path together) wins, then the longer host;
    of rules with equal host and path, ``block`` wins. No rule: null and ``default``. Null
    urls and urls without ``://`` have empty host and path. Repeated rows are judged
    alike; null ids are kept; no rules or no pages give the obvious results.
    """
    host, path = host_and_path("url")
    addressed = pages.select(F.col("page_id"), F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn(
        "rev", reversed_host(F.col("host"))
    )
    top = F.substring_index("key", ".", 1)
    hosts = rules.select(F.col("rev").alias("key"), F.col("rev").alias("tag")).distinct().withColumn("grp", top)
    points = addressed.distinct().select(
        reversed_host(F.col("host")).alias("key"), F.struct("host", "path").alias("body")
    ).withColumn("grp", top)
    under = sweep(points, hosts).select(F.explode("stack").alias("grp"), F.col("body.path").alias("key"), "body")
    of_host = rules.select(
        F.col("rev").alias("grp"), F.col("path").alias("key"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"), "action",
        ).alias("tag"),
    )
    judged = (
        sweep(under, of_host).where(F.size("stack") > 0)
        .groupBy("body").agg(F.max(F.element_at("stack", -1)).alias("best"))
        .select("body.host", "body.path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    return addressed.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
