"""URL rules as a sort-merge range join with a stack of nested rules.

A host is written back to front, label by label, each label ended by a dot: ``blog.example.org`` gives
``org.example.blog.``. A rule for a host then covers exactly the keys that begin with its own key, which is one
interval of the sorted keys, and two such intervals are nested or disjoint. Rules and URLs are sorted together; one
sweep keeps the stack of rule hosts whose intervals are open. Each open host holds its paths in order, every path
with the longest other one it extends, so the longest path that a URL's path begins with is found by one search and
a climb. Among the open hosts the longest rule (host and path together) wins, then the longer host.

Ranges: the sorted keys are cut at quantiles of a bounded sample of the URLs. A key that fills several ranges has a
boundary for each, and its URLs are dealt among them by a hash of the row: no URL or host is too frequent. A rule
goes to every range its interval meets. Each range is sorted by Spark and read as a stream: a task holds the stack,
no group and no table.

Host and path of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered, and from there up
to ``?``, ``#`` or the end. Defined cases: null and texts without ``://`` have an empty host and path. No rule
fits an empty host. A URL that no rule fits gets the default verdict. Repeated URLs are judged alike, each row on
its own. Repeated rules count once; of rules with equal host and path the first verdict in code point order counts.
Without rules everything gets the default; an empty table gives no rows. Other columns of the URL table are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import ascii_lower, fresh_name
from veritab.llm.vocabulary import bound_batches

DEFAULT = "allow"
#: URLs in a range, about, sampled URLs for each range, and ranges at most: beyond that ranges grow, so that the
#: boundaries stay a short list. A range is sorted with spilling and read as a stream.
RANGE_ROWS, SAMPLED, MOST_RANGES = 200_000, 64, 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)([^?#]*)", 2)
    return ascii_lower(after), path


def host_key(host: Column) -> Column:
    """Labels back to front, each with a dot after it; empty for an empty host."""
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(turned)


class PathRules:
    """The rules of one host: paths in order, with the verdict and the place of the longest path each extends."""

    def __init__(self, key: str) -> None:
        self.key, self.paths, self.verdicts, self.outer = key, [], [], []

    def add(self, path: str, verdict: str) -> None:
        """Paths must come in order."""
        if self.paths and self.paths[-1] == path:
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.outer.append(at)

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def best_rule(stack: list[PathRules], path: str) -> tuple[str, str, str] | None:
    """(host key, path, verdict) of the longest rule on the stack; the stack's inner hosts are the longer ones."""
    best, length = None, -1
    for rules in reversed(stack):
        at = rules.longest(path)
        if at >= 0 and len(rules.key) + len(rules.paths[at]) > length:
            best, length = (rules.key, rules.paths[at], rules.verdicts[at]), len(rules.key) + len(rules.paths[at])
    return best


def spelled(key: str, path: str) -> str:
    return ".".join(reversed(key[:-1].split("."))) + path


def _cuts(keys: DataFrame, rows: int) -> list[str]:
    """Sorted boundaries, one fewer than ranges; a key that fills whole ranges comes repeatedly."""
    ranges = min(max(1, -(-rows // RANGE_ROWS)), MOST_RANGES)
    if ranges == 1:
        return []
    share = min(1.0, SAMPLED * ranges / rows)
    found = sorted(
        r["key"] for r in keys.where(F.pmod(F.xxhash64("row", "key"), F.lit(1_000_000)) < share * 1_000_000).collect()
    )  # SAMPLED for each range, about
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def judge(
    df: DataFrame,
    rules: DataFrame,
    url: str = "url",
    row: str = "page_id",
    default: str = DEFAULT,
) -> DataFrame:
    """``df`` with host, path, rule and verdict; ``rules``: (host, path, verdict). ``row`` deals out equal URLs."""
    spark = df.sparkSession
    bound_batches(spark)
    names = {n: fresh_name(df, n) for n in ("host", "path", "rule", "verdict")}
    host, path = host_and_path(df[url])
    urls = df.select(F.struct(*[df[c] for c in df.columns]).alias("kept"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("hkey", host_key(F.col("host"))).withColumn("key", F.concat("hkey", "path"))
    keys = urls.select("key", F.col(f"kept.`{row}`").alias("row"))
    cuts = _cuts(keys, keys.count())
    table = rules.where("host <> ''").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    table = table.withColumn("hkey", host_key(F.col("host")))

    @F.pandas_udf("int")
    def of_url(key: pd.Series, spread: pd.Series) -> pd.Series:
        low = np.array([bisect_left(cuts, k) for k in key], np.int64)
        high = np.array([bisect_right(cuts, k) for k in key], np.int64)
        return pd.Series((low + spread.to_numpy() % (high - low + 1)).astype(np.int32))

    @F.pandas_udf("array<int>")
    def of_rule(key: pd.Series) -> pd.Series:
        # Every key of the interval begins with the rule's; U+10FFFF comes after them all.
        return pd.Series([list(range(bisect_left(cuts, k), bisect_right(cuts, k + "\U0010ffff") + 1)) for k in key])

    spread = F.pmod(F.xxhash64(F.col(f"kept.`{row}`")), F.lit(1 << 30))
    events = table.select(
        F.explode(of_rule("hkey")).alias("range"), "hkey", F.lit(0).alias("kind"), "path", "verdict"
    ).unionByName(
        urls.select(
            of_url("key", spread).alias("range"), "hkey", F.lit(1).alias("kind"), "path", "host", "kept"
        ),
        allowMissingColumns=True,
    )

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[PathRules] = []
        here = None
        for batch in batches:
            found, verdicts = [], []
            urls_here = (batch["kind"] == 1).to_numpy()
            for number, key, kind, path, verdict in zip(
                batch["range"], batch["hkey"], batch["kind"], batch["path"], batch["verdict"]
            ):
                if number != here:
                    here, stack = number, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(PathRules(key))
                    stack[-1].add(path, verdict)
                else:
                    best = best_rule(stack, path)
                    found.append(spelled(best[0], best[1]) if best else None)
                    verdicts.append(best[2] if best else default)
            out = batch.loc[urls_here, ["kept", "host", "path"]]
            yield out.assign(rule=found, verdict=verdicts)

    kept = urls.schema["kept"].dataType.simpleString()
    judged = (
        events.repartition("range")
        .sortWithinPartitions("range", "hkey", "kind", "path", "verdict")
        .select("range", "hkey", "kind", "path", "verdict", "host", "kept")
        .mapInPandas(sweep, f"kept {kept}, host string, path string, rule string, verdict string")
    )
    return judged.select(
        *[F.col(f"kept.`{c}`").alias(c) for c in df.columns], *[F.col(n).alias(names[n]) for n in names]
    )
