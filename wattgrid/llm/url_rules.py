"""URL rules by a sorted sweep over reversed hosts.

The key of a host is the host read backwards and a final dot, so a rule for a host is an interval of keys:
all that begin with its own. Rows and rules are dealt by cut points of the key order; a rule goes
to every range that its interval touches, which nested intervals keep to the rules plus the depth of
a name for each cut. Each range is sorted and swept once with a stack of the rules that are active;
of those whose path fits, the longest decides. Cuts fall inside hosts as well (path and row number
follow the key), so one host with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wattgrid.llm.common import fresh, quoted, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows drawn on average to place the cuts (they decide how even the ranges are, never a result), and characters of each.
SAMPLED = 4096
SAMPLED_CHARS = 200
LAST = "\U0010ffff"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def host_key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def _cuts(rows: DataFrame, order: str, ranges: int) -> list[str]:
    share = min(1.0, SAMPLED / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) < int(share * (1 << 40))
    drawn = sorted(r["o"] for r in rows.select(F.substring(order, 1, SAMPLED_CHARS).alias("o"), draw.alias("d")).where("d").select("o").collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def judge_urls(rows: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``rows`` with host, path, rule and verdict; ``rules`` has host, path and verdict.

    A rule fits its host and the hosts below it, where the path begins with the rule's. Of several,
    the one with the longest host and path wins, then the longer host, then ``block``. Without one, rule
    is null and the verdict is ``otherwise``. Null urls have an empty host and path. Equal rules
    count once; rows are never merged. Other columns are kept, former result columns replaced.
    """
    spark = rows.sparkSession
    rows = without(rows, "host", "path", "rule", "verdict")
    order, kind, part = fresh(rows, "sweep_order", "sweep_kind", "sweep_part")
    host, path = url_parts(quoted(url).cast("string"))
    salt = F.hex(F.xxhash64(F.monotonically_increasing_id()))
    given = rows.withColumns({"host": host, "path": path}).withColumn(order, F.concat(host_key(F.col("host")), "path", salt))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(given, order, ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int32")

    named = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).dropna().distinct()
    named = named.withColumn(order, host_key(F.col("host"))).withColumns({
        part: F.explode(F.sequence(range_of(order), range_of(F.concat(order, F.lit(LAST))))), kind: F.lit(0)})
    points = given.withColumns({part: range_of(order), kind: F.lit(1), "verdict": F.lit(None).cast("string")})
    swept = points.unionByName(named, allowMissingColumns=True).repartitionById(ranges, F.col(part)).sortWithinPartitions(part, order, kind)
    kept = [c for c in points.columns if c not in (order, kind, part, "verdict")]
    schema = StructType([points.schema[c] for c in kept] + [StructField("rule", StringType()), StructField("verdict", StringType())])
    arrow_names = [*kept, "rule", "verdict"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[tuple[int, int, bool, str, str, str]]]] = []
        now = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (part, kind, "host", "path", "verdict")]
            chosen, verdicts = [], []
            for p, is_row, h, where, said in zip(*columns):
                key = h[::-1] + "."
                if p != now:
                    now = p
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_row:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(h) + len(where), len(h), said == "block", where, h + where, said))
                    continue
                fits = [rule for _, level in stack for rule in level if where.startswith(rule[3])]
                best = max(fits) if fits else None
                chosen.append(best[4] if best else None)
                verdicts.append(best[5] if best else otherwise)
            mask = pa.array([bool(k) for k in columns[1]], pa.bool_())
            out = batch.filter(mask)
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in kept], pa.array(chosen, pa.string()), pa.array(verdicts, pa.string())], names=arrow_names)

    return swept.mapInArrow(sweep, schema)
