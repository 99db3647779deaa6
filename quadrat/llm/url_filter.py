"""URL filters by a sort-merge range join.

A rule is a host with a path prefix.  It fits the host, all its subdomains and
every path that starts with its path.  The host is turned round label by label
and the path follows (``org.example./es/``): one key, and a rule is the interval of
all keys that begin with its own.  Such intervals are nested or disjoint.

A page has a key for its host and one for each parent host of a depth that some
rule has, each with the page's path.  Keys and rules are sorted together, by
ranges of the key; the sweep goes through a range and keeps the stack of rules.
A rule inside k others has level k, and rules of one level are disjoint, so of
each level only the last one passed can be open: the stack is one running "last"
for each level, and an entry that is no prefix of the key at hand has ended.
What is open at the start of a range is carried over from the ranges before,
whose last rules are a row a range.  The longest open rule wins, over all keys
of the page.

Ranges are drawn by key and row, so equal keys, however many, lie in as many
ranges as they need, and so do the rules of one host.

Defined results
- null url, or no ``://``: host and path are empty, no rule fits, verdict ``block``
- url with a host that no rule fits: verdict ``allow``
- equal rules (same host and path): the one that says ``block`` wins
- rules with a null or empty host are ignored; a null path counts as empty; a path that is neither empty nor begins with / fits nothing
- repeated pages: one result row each; an empty table gives an empty result
- extra columns of the pages are kept; those named like a result column are
  replaced by it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.llm.common import ascii_lower, stored

RULE = "struct<key:string,size:int,rule:string,verdict:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``; with a path behind it, a prefix is a rule that holds it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def levelled(rules: DataFrame) -> DataFrame:
    """key, rule (RULE), depth (labels of the host), level (how many rules hold it, itself included).

    A rule looks up every beginning of its key among the rules.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h is not null and h != '' and (p = '' or p like '/%')")
    r = r.groupBy("h", "p").agg(F.max("v").alias("v"))  # block > allow
    base = host_key(F.col("h"))
    entry = F.struct(F.concat(base, F.col("p")).alias("key"), F.length(F.concat("h", "p")).alias("size"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict"))
    r = r.select(entry.cast(RULE).alias("rule"), F.size(F.split("h", r"\.")).alias("depth"))
    key = F.col("rule.key")
    starts = r.select(key.alias("key"), F.explode(F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(key, F.lit(1), n))).alias("start"))
    level = starts.join(r.select(F.col("rule.key").alias("start")), "start").groupBy("key").agg(F.count("*").cast("int").alias("level"))
    return r.select(F.col("rule.key").alias("key"), "rule", "depth").join(level, "key")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", unparsed: str = "block", ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: columns host, path, verdict.  ``ranges``: into how many the sorted
    keys are cut, by default the session's number of shuffle partitions.  The
    row itself travels with one event of its page; pages without a host have no key.
    """
    out = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("`" + url + "`"))
    # names within a struct can't clash with those of the sweep
    p = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns], F.lit(0).alias("none")).alias("row"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id"))

    r = stored(levelled(rules), "url-filter-rules")
    known = r.agg(F.max("level").alias("levels"), F.collect_set("depth").alias("depths")).first()
    levels, depths = known["levels"] or 0, sorted(known["depths"])  # a host name has at most 127 labels
    n = F.size(F.split("host", r"\."))
    names = [F.when((F.col("host") != "") & (n >= d), F.concat(host_key(F.substring_index("host", ".", -d)), F.col("path"))) for d in depths]
    whole = F.struct("host", "path", "row")
    # an event that no rule holds carries the row; so ids are made once and needn't be alike in two readings
    carrier = F.struct(F.concat(F.lit(" "), F.col("id")).alias("key"), whole.alias("whole"))
    others = [F.struct(x.alias("key"), F.lit(None).cast(p.select(whole.alias("w")).schema["w"].dataType).alias("whole")) for x in names]
    keys = p.select("id", F.explode(F.array(carrier, *others)).alias("k")).select("id", "k.key", "k.whole").where("key is not null")

    # a rule comes before the pages with its very key
    events = keys.unionByName(r.select("key", "rule", "level", F.lit(-1).cast("long").alias("id")), allowMissingColumns=True)
    dealt = events.repartitionByRange(ranges, "key", "id") if ranges else events.repartitionByRange("key", "id")
    # stored: ranges are drawn from a sample and are read twice
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "url-filter-events")
    stack = [F.when(F.col("level") == k, F.col("rule")) for k in range(1, levels + 1)]
    ends = dealt.groupBy("range").agg(F.count("*").alias("n"), *[F.max(x).alias(f"end{k}") for k, x in enumerate(stack)])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", *[F.last(f"end{k}", ignorenulls=True).over(before).alias(f"carried{k}") for k in range(levels)])  # a row a range
    sweep = Window.partitionBy("range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.select("*", *[F.last(x, ignorenulls=True).over(sweep).alias(f"open{k}") for k, x in enumerate(stack)]).where("id >= 0").join(F.broadcast(carried), "range")
    held = [F.coalesce(f"open{k}", f"carried{k}") for k in reversed(range(levels))]
    best = F.coalesce(*[F.when(F.startswith(F.col("key"), x["key"]), F.struct(x["size"].alias("size"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))) for x in held], F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    one = swept.select("id", "whole", best.alias("best")).groupBy("id").agg(F.first("whole", ignorenulls=True).alias("whole"), F.max("best").alias("best"))
    one = one.select("whole.*", "best")
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in out]
    verdict = F.coalesce("best.verdict", F.when(F.col("host") == "", F.lit(unparsed)).otherwise(F.lit(default)))
    return one.select(*kept, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
