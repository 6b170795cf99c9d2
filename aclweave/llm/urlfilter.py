"""URL rules by a sort-merge range join over reversed-host keys.

A host's key is its labels in reverse, each closed by a space (`www.example.com` is `com example www `), so the hosts below
a rule's host are one interval of keys, and such intervals are nested or apart. Urls are sorted by key and swept against the
sorted rules; a stack holds the rules whose interval covers the current key, innermost last. Among those whose path the
url's path starts with, the rule with the longest text (host and path) wins, and of equally long ones that of the inner host.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule fits; of rules with the same
host and path the one with the last verdict by text counts (``block`` before ``allow``), in either way of running; hosts and
rules differ by A-Z in lower case alone; an empty table gives no rows; repeated rows are judged as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow_pass, saved, table, with_fields

#: The rules of op2: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Above this many rules they are no longer sent to every task but dealt out by key range.
RULES_IN_TASK = 200_000
#: Urls of a key range that one task sweeps, at about.
URLS_IN_TASK = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), " "), F.lit(" ")))


class Sweep:
    """Rules (key, path, text, verdict) against urls in ascending key order.

    Hosts' keys are sorted once; each knows the host that encloses it, so the stack of active rules is a chain of hosts from
    the innermost outwards. A url moves on from where the one before it stood.
    """

    def __init__(self, rules):
        hosts: dict[bytes, list[tuple[str, str, str]]] = {}
        for key, path, text, verdict in rules:
            hosts.setdefault(key.encode(), []).append((path, text, verdict))
        self.keys = sorted(hosts)
        self.paths = [sorted(hosts[k], key=lambda x: -len(x[1])) for k in self.keys]
        self.outer, stack = [], []
        for i, k in enumerate(self.keys):
            while stack and not k.startswith(self.keys[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def judge(self, keys: list[bytes], paths: list[str]) -> list[tuple[str, str] | None]:
        """The rule (text, verdict) of each url, whose keys may come in any order: they are swept in theirs."""
        found: list[tuple[str, str] | None] = [None] * len(keys)
        at = 0
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            key = keys[i]
            if not key:
                continue
            at = bisect_right(self.keys, key, at)
            top, best = at - 1, None
            while top >= 0:
                if key.startswith(self.keys[top]):
                    fit = next(((text, verdict) for path, text, verdict in self.paths[top] if paths[i].startswith(path)), None)
                    if fit and (best is None or len(fit[0]) > len(best[0])):
                        best = fit
                top = self.outer[top]
            found[i] = best
        return found


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", rules_in_task: int = RULES_IN_TASK) -> DataFrame:
    """pages with host, path, rule and verdict; ``rules`` has verdict, host and path.

    Up to ``rules_in_task`` rules (counted first) go to every task, where batches of urls are sorted and swept, without any
    shuffle. More rules are cut at every ``rules_in_task // 4``-th key; a range's tasks get the rules in it and those that
    cover its first key (as many as that key has labels); a range has as many tasks as its urls fill, so a crowded host is
    shared.
    """
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").dropna().withColumn("key", key_of(F.col("host")))
    rules = rules.withColumn("text", F.concat("host", "path")).groupBy("key", "path", "text").agg(F.max("verdict").alias("verdict"))
    known = ("host", "path", "rule", "verdict")
    base = pages.drop(*known).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    n = rules.count()
    if n > rules_in_task:
        return _by_ranges(base, rules, n, rules_in_task, default)
    few = base.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])  # rules_in_task rows at most

    def make():
        sweep = Sweep(few.value)

        def run(cols: dict) -> dict:
            keys = [(" ".join(reversed(h.split("."))) + " ").encode() if h else b"" for h in cols["host"]]
            found = sweep.judge(keys, cols["path"])
            return cols | {"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]}

        return run

    return arrow_pass(base, make, with_fields(base.schema, "rule string, verdict string"), rows=4096)


def _by_ranges(base: DataFrame, rules: DataFrame, n: int, rules_in_task: int, default: str) -> DataFrame:
    spark = base.sparkSession
    rules = saved(rules, "rules")
    ranges = max(2, 4 * n // rules_in_task)
    ends = rules.select("key").distinct().repartitionByRange(ranges, "key").withColumn("_r", F.spark_partition_id())
    cuts = sorted(r[1] for r in ends.groupBy("_r").agg(F.min("key")).collect())[1:]  # one for each range
    encoded = [c.encode() for c in cuts]

    def place(frame: DataFrame, col: str) -> DataFrame:
        def make():
            def run(cols: dict) -> dict:
                return cols | {"_range": [bisect_right(encoded, k.encode()) for k in cols[col]]}

            return run

        return arrow_pass(frame, make, with_fields(frame.schema, "_range int"), rows=4096)

    cover = [(i + 1, " ".join(c.split(" ")[:k]) + " ") for i, c in enumerate(cuts) for k in range(1, c.count(" "))]
    above = rules.join(F.broadcast(spark.createDataFrame(cover or [(0, "")], "_range int, key string")), "key")
    dealt = place(rules, "key").unionByName(above.select(*rules.columns, "_range"))
    names = [f.name for f in base.schema]
    urls = saved(place(base.select(F.struct(*names).alias("_row"), key_of(F.col("host")).alias("key")), "key"), "urls")
    # a crowded range is dealt to as many tasks as its urls fill; each of them gets the range's rules
    salts = urls.groupBy("_range").agg((1 + F.floor(F.count("*") / URLS_IN_TASK)).alias("_salts"))
    salts = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in salts.collect()], "_range int, _salts bigint"))  # one for each range
    urls = urls.join(salts, "_range").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts")))
    dealt = dealt.join(salts, "_range").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
    one = urls.select("_range", "_salt", "key", F.lit(1).alias("_kind"), "_row", F.lit(None).cast("struct<path:string,text:string,verdict:string>").alias("_rule"))
    two = dealt.select("_range", "_salt", "key", F.lit(0).alias("_kind"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct("path", "text", "verdict").alias("_rule"))
    both = one.unionByName(two).repartition("_range", "_salt").sortWithinPartitions("_range", "_salt", "key", "_kind")

    def make():
        state = {"at": None, "stack": []}

        def run(cols: dict) -> dict:
            out = {name: [] for name in [*names, "rule", "verdict"]}
            for r, s, key, kind, row, rule in zip(*(cols[c] for c in ("_range", "_salt", "key", "_kind", "_row", "_rule")), strict=True):
                if state["at"] != (r, s):
                    state.update(at=(r, s), stack=[])
                stack = state["stack"]
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule))
                    continue
                fits = [x for _, x in stack if key and row["path"].startswith(x["path"])]
                best = max(reversed(fits), key=lambda x: len(x["text"]), default=None)
                for name in names:
                    out[name].append(row[name])
                out["rule"].append(best and best["text"])
                out["verdict"].append(best["verdict"] if best else default)
            return out

        return run

    return arrow_pass(both, make, with_fields(base.schema, "rule string, verdict string"), rows=4096)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT p.*, r.verdict, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
