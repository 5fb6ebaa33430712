"""URL rules by a sort-merge range join.

A host's labels are reversed into a canonical key, so a rule's host with all its subdomains
is one interval of keys. Rules and urls are cut into ranges of keys, each rule being copied
into the ranges its interval touches; a sweep over a sorted range keeps the stack of rules
whose interval is open, innermost last, and only that stack is asked about a url's path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys a range, from which the ranges are cut; it bounds what the driver sees.
SAMPLED = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def key_of(host: Column) -> Column:
    """Reversed labels, each closed by the lowest character, so subdomains follow their host at once."""
    labels = F.reverse(F.split(F.translate(host, "\0", "\1"), r"\.", -1))
    return F.concat(F.array_join(labels, "\0"), F.lit("\0"))


class _Open:
    """A host's rules on the stack: path to (rule, verdict), tried from the longest path down."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.paths:
            self.paths[path] = verdict
            self.lengths = sorted({len(p) for p in self.paths}, reverse=True)
        elif verdict == "block":
            self.paths[path] = verdict

    def fit(self, path: str) -> tuple[int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (verdict := self.paths.get(path[:n])):
                return len(self.host) + n, self.host + path[:n], verdict
        return None


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per url: its id, ``host``, ``path``, ``rule`` (host and path side by side, or null) and ``verdict``.

    ``rules`` has host, path and verdict ("allow" or "block"). A rule fits its host and all
    subdomains if the url's path starts with the rule's; of those that fit the longest wins,
    of equally long ones the one with the longer host, of a rule given twice the block. A
    rule with a null column or an empty host fits nothing; without a fit the verdict is
    ``default``. Null urls and urls without ``://`` have empty host and path. Repeated rows
    stay; a hot key is cut into several ranges by a second sort key.
    """
    spark = urls.sparkSession
    kind = urls.schema[id_col].dataType.simpleString()
    ranges = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("tie"))
    base = base.withColumn("key", key_of(F.col("host")))
    n = urls.count()
    sample = base.select("key", "tie").sample(min(1.0, SAMPLED * ranges / max(1, n)), 7).collect() if n else []
    keys = sorted((r.key, r.tie) for r in sample)
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    shared = spark.sparkContext.broadcast(bounds)  # fewer than ranges entries

    def place(batches):
        for b in batches:
            at = [bisect_right(shared.value, x) for x in zip(b.column(4).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(4), pa.array([1] * b.num_rows, pa.int32()), *b.columns[:3], pa.nulls(b.num_rows, pa.string())], names)

    def spread(batches):
        least = -(2**63)
        for b in batches:
            rows = []
            for host, path, verdict, key in zip(*[c.to_pylist() for c in b.columns]):
                for at in range(bisect_right(shared.value, (key, least)), bisect_left(shared.value, (key[:-1] + "\1", least)) + 1):
                    rows.append((at, key, 0, None, host, path, verdict))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], b_id), *[pa.array(c, pa.string()) for c in columns[4:]]], names)

    names = ["range", "key", "what", "id", "host", "path", "verdict"]
    b_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"range int, key string, what int, id {kind}, host string, path string, verdict string"
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host <> '' and path is not null and verdict is not null").withColumn("key", key_of(F.col("host")))
    events = base.mapInArrow(place, schema).unionByName(own.mapInArrow(spread, schema))

    def sweep(batches):
        open_, now = [], None
        for b in batches:
            out = []
            for at, key, what, id_, host, path, verdict in zip(*[c.to_pylist() for c in b.columns]):
                if at != now:
                    open_, now = [], at
                while open_ and not key.startswith(open_[-1].key):
                    open_.pop()
                if what == 0:
                    if not open_ or open_[-1].key != key:
                        open_.append(_Open(key, host))
                    open_[-1].add(path, verdict)
                    continue
                # Innermost first, so of equally long rules the one with the longer host stays.
                best = None
                for level in reversed(open_):
                    if host == level.host or host.endswith("." + level.host):
                        found = level.fit(path)
                        if found and (best is None or found[0] > best[0]):
                            best = found
                out.append((id_, host, path, best and best[1], best[2] if best else default))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b_id), *[pa.array(c, pa.string()) for c in columns[1:]]], [id_col, "host", "path", "rule", "verdict"])

    swept = events.repartition(ranges, "range").sortWithinPartitions("range", "key", "what")
    return swept.mapInArrow(sweep, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
