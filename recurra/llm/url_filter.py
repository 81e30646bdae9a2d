"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped, probed by vectorised binary search.

Entries of lists are strings: a host and a path prefix (`org/`, `example.org/en/1`; without a slash any path) fits its host and
all subdomains where the url's path starts with the entry's; `name.*` fits every host that has the label `name`. A url's
keys are its host's suffixes, each with the prefixes of its path in those lengths that entries have, and its labels.
Their digests are looked up in the array all at once; a hit counts only if the entry's stored string equals the key, so
collisions do nothing. Of the rules that fit, the longest string decides. Without a rule, the blocklist does: a url is
blocked if an entry fits it, and allowed otherwise.

Rules and blocklist are parameters: sequences, or tables of any size. Lists of up to FILE_BYTES become files in the shared
folder, which Spark sends to each executor once and workers map. Beyond that the urls' keys and the list meet in a join on
digest and string. The default blocklist is made by a rule: two words of a vocabulary of abuse make a label.

Defined results: null or no `://` gives an empty host and path, no rule, and the verdict allow; an empty host fits
nothing; of entries that differ in case of the host only, the last counts; repeated rows each return a row; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm.bytewise import U
from recurra.llm.storage import shared_folder, written

#: Lists of more bytes than this are joined instead of sent.
FILE_BYTES = 64 << 20
#: Words that name what is blocked, and words that go with them.
NOUNS = ("ad", "ads", "adult", "bet", "bets", "cams", "casino", "clicks", "crypto", "loans", "malware", "pharma", "phish", "pills", "poker", "popup", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
BESIDE = ("24", "best", "bonus", "cheap", "club", "farm", "free", "hot", "hub", "live", "online", "server", "shop", "track", "tracker", "win", "x", "zone")
BLOCKLIST = tuple(f"{a}-{b}.*" for x in NOUNS for y in BESIDE for a, b in ((x, y), (y, x)))
#: Rules of the contract: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_opened: dict[str, DigestArray] = {}


class DigestArray:
    """Sorted digests of strings, with the strings in the same order and a number for each."""

    def __init__(self, file: str) -> None:
        load = lambda part, kind: np.memmap(f"{file}.{part}", kind, "r") if os.path.getsize(f"{file}.{part}") else np.zeros(0, kind)
        self.keys, self.ends, self.text, self.value = load("keys", U), load("ends", np.int64), load("text", np.uint8), load("value", np.uint8)

    @staticmethod
    def parts(entries: dict[str, int]) -> dict[str, bytes]:
        """The files' bytes."""
        rows = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode(), v) for e, v in entries.items())
        numbers = {"keys": np.array([k for k, _, _ in rows], U), "ends": np.cumsum([0, *[len(e) for _, e, _ in rows]]).astype(np.int64), "value": np.array([v for _, _, v in rows], np.uint8)}
        return {**{k: a.tobytes() for k, a in numbers.items()}, "text": b"".join(e for _, e, _ in rows)}

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The number of each string, or -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), U, len(strings))
        out = np.full(len(strings), -1)
        place = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == digests) if len(self.keys) else ():
            p = int(place[i])
            while p < len(self.keys) and self.keys[p] == digests[i] and out[i] < 0:  # equal digests stand side by side
                if self.text[self.ends[p] : self.ends[p + 1]].tobytes() == strings[i]:
                    out[i] = self.value[p]
                p += 1
        return out


def _opened_array(name: str) -> DigestArray:
    if name not in _opened:
        _opened[name] = DigestArray(f"{SparkFiles.getRootDirectory()}/{name}")
    return _opened[name]


def _send(spark: SparkSession, entries: dict[str, int]) -> str:
    """Write an array to the shared folder and have it sent to the executors; its name."""
    name = f"list-{uuid.uuid4().hex}"
    for part, data in DigestArray.parts(entries).items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}.{part}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


def _keys(hosts: list[str], paths: list[str], lengths: list[int], labels: bool) -> tuple[list[bytes], list[int]]:
    """Strings that entries which fit a url may be, and the number of the url."""
    keys: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            parts = host.split(".")
            for k in range(len(parts)):
                suffix = ".".join(parts[k:])
                own = [suffix + path[:n] for n in lengths if n <= len(path)]
                if labels:
                    own.append(parts[k] + ".*")
                keys += [x.encode() for x in own]
                owner += [i] * len(own)
    return keys, owner


def _longest(array: DigestArray, lengths: list[int], labels: bool, hosts: list[str], paths: list[str]) -> list[tuple[str, int] | None]:
    """The longest entry that fits each url, and its number."""
    keys, owner = _keys(hosts, paths, lengths, labels)
    found: list[tuple[str, int] | None] = [None] * len(hosts)
    value = array.find(keys)
    for j in np.flatnonzero(value >= 0):
        entry, i = keys[j].decode(), owner[j]
        if found[i] is None or len(entry) > len(found[i][0]):
            found[i] = (entry, int(value[j]))
    return found


def _table(spark: SparkSession, entries: DataFrame | Sequence, columns: str) -> DataFrame:
    return entries if isinstance(entries, DataFrame) else spark.createDataFrame(list(entries), columns)


def _listed(rules: DataFrame, blocklist: DataFrame) -> DataFrame:
    """entry, kind (0: blocklist, 1: rule that allows, 2: rule that blocks) of both lists; hosts in lower case."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.substring_index("entry", "/", 1)
    blocked = blocklist.select(F.concat(lower(host), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")).alias("entry"), F.lit(0).alias("kind"))
    own = rules.select(F.concat(lower(F.col("host")), "path").alias("entry"), F.when(F.col("verdict") == "block", 2).otherwise(1).alias("kind"))
    return own.unionByName(blocked).where("entry is not null")


def _spans(listed: DataFrame) -> tuple[list[int], bool]:
    """Lengths of the entries' paths (at most as many as a path has characters), and whether there are labels."""
    path = F.expr("length(entry) - length(substring_index(entry, '/', 1))")
    label = F.col("entry").endswith(".*") & ~F.contains("entry", F.lit("/"))
    one = listed.agg(F.sort_array(F.collect_set(F.when(~label, path))).alias("n"), F.max(label).alias("labels")).first()
    return [int(n) for n in one["n"]], bool(one["labels"])


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence = RULES, blocklist: DataFrame | Sequence = BLOCKLIST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row. rules: (host, path, verdict); blocklist: entries, or a table of one column `entry`."""
    spark = pages.sparkSession
    rules = _table(spark, rules, "host string, path string, verdict string")
    blocklist = _table(spark, blocklist if isinstance(blocklist, DataFrame) else [(b,) for b in blocklist], "entry string")
    listed = _listed(rules, blocklist)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, length(substring_index(url, '://', 1)) + 4)")).otherwise("")
    split = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    if listed.agg(F.coalesce(F.sum(F.octet_length("entry") + 17), F.lit(0))).first()[0] > file_bytes:
        return _by_join(split, listed)
    own, blocked = ({r["entry"]: r["kind"] for r in listed.where(k).collect()} for k in ("kind > 0", "kind = 0"))
    names = [_send(spark, own), _send(spark, blocked)]
    spans = [_spans(listed.where(k)) for k in ("kind > 0", "kind = 0")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, block = (_longest(_opened_array(name), *span, hosts, paths) for name, span in zip(names, spans))
            verdict = ["block" if (r[1] == 2 if r else b) else "allow" for r, b in zip(rule, block)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path")], pa.array([r and r[0] for r in rule], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def _by_join(split: DataFrame, listed: DataFrame) -> DataFrame:
    """As filter_urls(), by a join of the urls' keys with the lists."""
    rows = written(split.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    lengths, labels = _spans(listed)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, owner = _keys(batch.column("host").to_pylist(), batch.column("path").to_pylist(), lengths, labels)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner, pa.int64())), pa.array([k.decode() for k in own], pa.string())], ["row", "entry"])

    asked = rows.select("row", "host", "path").mapInArrow(keys, "row long, entry string")
    found = asked.join(listed.groupBy("entry", (F.col("kind") > 0).alias("rule")).agg(F.max("kind").alias("kind")), "entry")
    best = found.groupBy("row").agg(F.max(F.when(F.col("rule"), F.struct(F.length("entry").alias("n"), "entry", "kind"))).alias("own"), F.bool_or(~F.col("rule")).alias("blocked"))
    out = rows.join(best, "row", "left")
    blocked = F.coalesce(F.col("own.kind") == 2, "blocked", F.lit(False))
    return out.select("page_id", "host", "path", F.col("own.entry").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))
