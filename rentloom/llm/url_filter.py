"""Allow and block rules over URLs: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is a canonical URL, host and beginning of the path, and fits its host, all subdomains and all longer paths. A
page's URL therefore has several keys: each of its host's suffixes with each beginning of its path that is as long as
some rule's path. The keys are looked up in a Bloom filter whose blocks are one cache line each, so a look-up touches
one block. Keys that pass are possible hits; a join on the key itself removes the false ones, and the longest wins.

The filter's size is bounded. A longer list makes more false hits, which the join removes; results do not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rentloom.llm.common import Stages, bounded_batches, mix64

WORDS = 8  # of 64 bits: a block of 64 bytes; each entry sets one bit in each word
KEYS_A_BLOCK = 32  # 16 bits an entry
MOST_BLOCKS = 1 << 20  # 64 MB, the bound of what is collected and broadcast
SALTS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def places(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each entry, and the bit it has in each word of the block."""
    block = ((hashed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.uint64(1) << ((hashed[:, None] * SALTS) >> np.uint64(58))
    return block.astype(np.int64), bits


def may_hold(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each entry; never false for one it holds."""
    block, bits = places(hashed, len(words))
    return ((words[block] & bits) == bits).all(1)


def bloom(rules: DataFrame) -> np.ndarray:
    """(blocks, words): the filter of all rules' keys and hosts, made in the tasks and joined by bitwise or."""
    count = rules.count()
    blocks = min(MOST_BLOCKS, max(1, -(-2 * count // KEYS_A_BLOCK)))
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys = batch.column("host").to_pylist(), batch.column("key").to_pylist()
            block, bits = places(hashes([h + "\n" for h in hosts] + keys), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(b.astype(np.int64)) for b in bits.T)], ["block", *names])

    rows = rules.select("host", "key").mapInArrow(run, ", ".join(f"{n} bigint" for n in ["block", *names]))
    found = rows.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    at = found.column("block").to_numpy()
    for i, name in enumerate(names):
        out[at, i] = found.column(name).to_numpy().astype(np.uint64)
    return out


def _suffixes(host: str) -> list[str]:
    """The host and its parents, longest first."""
    labels = host.split(".")
    return [host] + [s for i in range(1, len(labels)) if (s := ".".join(labels[i:]))]


class Probe:
    """Keys of URLs that pass the filter, best rule first: the longest key, then the longest host."""

    def __init__(self, words: np.ndarray, lengths: list[int]):
        self.words, self.lengths = words, sorted(lengths, reverse=True)
        self.hosts: dict[str, list[str]] = {}

    def listed(self, host: str) -> list[str]:
        """Suffixes of the host that may have rules."""
        if host not in self.hosts:
            if len(self.hosts) >= 100_000:
                self.hosts.clear()
            names = _suffixes(host)
            self.hosts[host] = [n for n, may in zip(names, may_hold(self.words, hashes([n + "\n" for n in names]))) if may]
        return self.hosts[host]

    def of(self, hosts: list[str], paths: list[str]) -> list[list[str]]:
        keys, owners = [], []
        for at, (host, path) in enumerate(zip(hosts, paths)):
            own = [(-len(s) - n, -len(s), s + path[:n]) for s in self.listed(host) for n in self.lengths if n <= len(path)]
            keys += [k for _, _, k in sorted(own)]
            owners += [at] * len(own)
        out: list[list[str]] = [[] for _ in hosts]
        if keys:
            for at in np.flatnonzero(may_hold(self.words, hashes(keys))).tolist():
                out[owners[at]].append(keys[at])
        return out


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(host, path, key, block) of each listed canonical URL once; hosts in lower case. A rule listed as both blocks."""
    fine = rules.filter("host is not null and path is not null and verdict in ('allow', 'block')")
    host = F.translate("host", UPPER, LOWER)
    named = fine.select(host.alias("host"), "path", (F.col("verdict") == "block").cast("int").alias("block"))
    once = named.groupBy("host", "path").agg(F.max("block").alias("block"))
    return once.withColumn("key", F.concat("host", "path"))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits if the host is its host or a subdomain of it and the path starts with its path. The longest rule wins,
    by the length of host and path together, then by the longer host; its name and verdict come back. Where none fits,
    rule is null and the verdict is ``otherwise``: URLs that are not listed pass.

    A null url, or one without ``://``, has an empty host and path. Repeated rows come back each; null and repeated
    page_ids do no harm. Rules with a null host or path, or another verdict than allow or block, do not count; one
    listed with both verdicts blocks. A path that is not empty must start with ``/`` to fit anything. No pages give no
    rows, no rules give every page ``otherwise``. Other columns are not read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    stages = Stages(spark, "urls")
    listed = stages.write(canonical_rules(rules), "rules")
    # One number for each length of a rule's path that occurs.
    lengths = [r.n for r in listed.select(F.length("path").alias("n")).distinct().collect()]
    words = spark.sparkContext.broadcast(bloom(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(words.value, lengths)
        for batch in batches:
            hits = probe.of(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "hits"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    probed = rows.mapInArrow(run, f"page_id {kind}, host string, path string, hits array<string>")
    # Numbers of rows hold because they are written with the rows.
    probed = stages.write(probed.withColumn("row", F.monotonically_increasing_id()), "possible")
    possible = probed.select("row", F.posexplode("hits").alias("place", "key"))
    confirmed = possible.join(listed.select("key", "block"), "key")
    best = confirmed.groupBy("row").agg(F.min(F.col("place") * 2 + F.col("block")).alias("best"))
    out = probed.join(best, "row", "left")
    rule = F.get("hits", F.shiftright("best", 1))
    verdict = F.when(F.col("best").isNull(), F.lit(otherwise)).when(F.col("best") % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
