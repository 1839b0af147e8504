r"""URL filter: rules of hosts and paths in a sorted digest array.

A rule (host, path, action) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's.
The full strings of all rules stand in one file, sorted by their 64-bit xxhash; the digests alone are a second
file.  Tasks memory-map both, probe a batch of candidates with one vectorised binary search, and compare the stored string wherever a digest is
found, so a collision never makes a rule fit.  Hosts are entries too, each with the lengths of its rules' paths: first the suffixes of a url's host are probed,
then, for the hosts found, the starts of its path of just these lengths.  So the work for a url doesn't grow with the
number of rules.

The array is built by Spark (sorted by range partitioning, written to the shared folder) and handed to the executors as files of the job;
each executor lays it out once on its own disk, a new one when it joins.  It never passes through the driver's or a task's memory as a
whole.  The urls themselves are never shuffled.

Host and path: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path what follows up to ``?``,
``#`` or the end.  The longest rule (host and path together, in code points) wins; of equally long ones that of the longer host.

Edge cases: a null url, or one without ``://``, has an empty host and path; no rule fits, and its verdict is block, as there is nothing to fetch.  A url with a host
that no rule fits gets ``otherwise`` (allow).  Of rules with equal host and path, block wins; rules without a host or a known action are left out, a null path counts as empty.  Without rules every
verdict is the default.  Hosts and paths may be of any length: suffixes of more labels than any rule's host aren't probed.  Repeated rows are each judged.  Input columns named like
the new ones (host, path, rule, verdict) are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import shared, table

#: The seed of Spark's xxhash64.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    part = lambda k: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def entries(rules: DataFrame) -> DataFrame:
    """key, text, value: an entry ``r<host><path>`` for each rule, with its action, and ``h<host>`` for each host, with the
    lengths of its rules' paths."""
    host = F.translate("host", UPPER, LOWER)
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host != '' and action in ('allow', 'block')")
    one = rules.groupBy("host", "path").agg(F.max("action").alias("value"))  # block is the greater word
    lengths = one.select("host", F.length("path").alias("n")).distinct().groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("n")), ",").alias("value"))
    both = one.select(F.concat(F.lit("r"), "host", "path").alias("text"), "value").unionByName(lengths.select(F.concat(F.lit("h"), "host").alias("text"), "value"))
    return both.select(F.xxhash64("text").alias("key"), "text", "value")


def published(rules: DataFrame) -> tuple[list[str], int]:
    """Names of the files that hold the sorted entries, in order, and the most labels of a rule's host.  The files belong to the Spark application and go with it."""
    spark = rules.sparkSession
    labels = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    folder = shared(spark, "digests")
    entries(rules).repartitionByRange("key").sortWithinPartitions("key", "text").write.parquet(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    paths = sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith("part-"))
    for path in paths:
        spark.sparkContext.addFile(path)
    return [p.rpartition("/")[2] for p in paths], labels


class DigestArray:
    """Memory-mapped digests in rising order, and the texts and values that belong to them."""

    def __init__(self, names: list[str]) -> None:
        base = os.path.join(os.path.abspath(SparkFiles.getRootDirectory()), names[0])
        if not os.path.exists(f"{base}.keys"):
            self.lay_out(names, base)
        self.keys = np.memmap(f"{base}.keys", np.int64, "r") if os.path.getsize(f"{base}.keys") else np.empty(0, np.int64)
        self.ends = np.memmap(f"{base}.ends", np.int64, "r") if len(self.keys) else np.empty(0, np.int64)
        self.data = np.memmap(f"{base}.data", np.uint8, "r") if len(self.keys) else np.empty(0, np.uint8)

    @staticmethod
    def lay_out(names: list[str], base: str) -> None:
        """Write the flat files beside the executor's copies of the entries.  Each takes its name when it is whole, the keys last; workers
        that do so at once write the same bytes, so it doesn't matter whose file stays."""
        own, at = f"{base}.{uuid.uuid4().hex}", 0
        with open(f"{own}.keys", "wb") as keys, open(f"{own}.ends", "wb") as ends, open(f"{own}.data", "wb") as data:
            for name in names:
                for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(8192):
                    keys.write(batch.column("key").to_numpy().tobytes())
                    for text, value in zip(batch.column("text").to_pylist(), batch.column("value").to_pylist()):
                        for x in (text.encode(), value.encode()):
                            data.write(x)
                            at += len(x)
                            ends.write(at.to_bytes(8, "little"))
        for kind in ("data", "ends", "keys"):
            os.replace(f"{own}.{kind}", f"{base}.{kind}")

    def entry(self, at: int) -> tuple[bytes, bytes]:
        start = self.ends[2 * at - 1] if at else 0
        middle, end = self.ends[2 * at], self.ends[2 * at + 1]
        return self.data[start:middle].tobytes(), self.data[middle:end].tobytes()

    def values(self, texts: list[bytes]) -> list[bytes | None]:
        """The values of ``texts``; None for those that aren't entries."""
        digests = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)
        out: list[bytes | None] = [None] * len(texts)
        at = np.searchsorted(self.keys, digests)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests) if len(self.keys) else ():
            place = at[k]
            while place < len(self.keys) and self.keys[place] == digests[k]:
                text, value = self.entry(place)
                if text == texts[k]:
                    out[k] = value
                    break
                place += 1
        return out


def suffixes(host: str, labels: int) -> list[str]:
    """The host and its parent domains, of ``labels`` labels at most, longest first."""
    own = host.rsplit(".", labels)
    tail = own[-labels:] if labels else []
    return [".".join(tail[k:]) for k in range(len(tail))]


def judged(array: DigestArray, hosts: list[str], paths: list[str], labels: int) -> list[tuple[str, str] | None]:
    """Rule and action for every url of a batch."""
    of, texts = [], []
    for k, host in enumerate(hosts):
        for s in suffixes(host, labels) if host else ():
            of.append((k, s))
            texts.append(b"h" + s.encode())
    rules, keys = [], []
    for (k, s), lengths in zip(of, array.values(texts)):
        for n in map(int, lengths.split(b",")) if lengths else ():
            if n <= len(paths[k]):
                rules.append((len(s) + n, len(s), k, s + paths[k][:n]))
                keys.append(b"r" + rules[-1][3].encode())
    best: dict[int, tuple] = {}
    for (n, m, k, rule), action in zip(rules, array.values(keys)):
        if action and (n, m) > best.get(k, (0, 0))[:2]:
            best[k] = (n, m, rule, action.decode())
    return [best[k][2:] if k in best else None for k in range(len(hosts))]


def filtered(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", rows: int = 4096) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule and verdict."""
    names, labels = published(rules)
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    schema = T.StructType([*pages.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(names) if names else None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                hosts, paths = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
                found = judged(array, hosts, paths, labels) if array else [None] * len(hosts)
                rule = [f and f[0] for f in found]
                verdict = [f[1] if f else otherwise if h else "block" for f, h in zip(found, hosts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filtered(pages, rules_of(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op12_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return f"""
with cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(h, p, action) as (values {rules}),
fits as (
  select page_id, arg_max(h || p, (length(h || p), length(h))) as rule, arg_max(action, (length(h || p), length(h))) as action
  from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(action, case when host = '' then 'block' else 'allow' end) as verdict
from parsed left join fits using (page_id)
"""
