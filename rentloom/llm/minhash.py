"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first scatters the shingles, the second is shifted circularly by one more
for every coordinate. Coordinates are cut into bands; documents that share a band are candidates and are confirmed on
their full sets of shingles.

Candidates never become rows of all pairs. Equal sets are one node from the start. In rounds, every node meets only the
leader of each of its buckets, after a look at their signatures, and buckets whose nodes are already connected are
dropped. What is left are families of similar texts of which some are linked with nothing or in small components.
Blocks of signatures from one bucket show which nodes belong to one family; then the sets of a family's nodes outside
its largest component are held against all its other sets, block by block, and only links that connect components
come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from rentloom.llm.common import HashCache, Stages, bounded_batches, giving_back, mix32, mix64, own_columns, ragged_index, text_slices
from rentloom.llm.components import components, least_reachable

BANDS, ROWS = 48, 6  # a pair at 0.8 shares no band with a chance of 5e-7
COORDINATES = BANDS * ROWS
LEAST_AGREEMENT = 0.65  # signatures of a pair at 0.8 agree less with a chance below 1e-8
LEADER_ROUNDS = 2
FAMILY_BLOCK, SET_BLOCK = 1024, 256  # signatures and sets that meet at a time
PIECE = 1 << 18


def shingle_sets(texts: list[bytes], words: int, cache: HashCache) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles: A-Z in lower case, words between ASCII white space.

    A text with fewer words than a shingle has its whole sequence as the one shingle; without words the set is empty.
    """
    out = []
    for text in texts:
        codes = cache.of(text.lower().split())
        width = min(words, len(codes))
        if not width:
            out.append(np.zeros(0, np.uint64))
            continue
        n = len(codes) - width + 1
        total = np.full(n, width, np.uint64)
        for j in range(width):
            total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n])
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(coordinates, texts) of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    first = mix32((np.concatenate(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    out = np.empty((COORDINATES, len(sets)), np.uint32)
    second, high = np.empty_like(first), np.empty_like(first)
    for k in range(COORDINATES):
        np.subtract(first, np.uint32(k), out=second)
        for shift, factor in ((16, 0x21F0AAAD), (15, 0xD35A2D97)):
            np.right_shift(second, np.uint32(shift), out=high)
            np.bitwise_xor(second, high, out=second)
            np.multiply(second, np.uint32(factor), out=second)
        np.right_shift(second, np.uint32(15), out=high)
        np.bitwise_xor(second, high, out=second)
        np.minimum.reduceat(second, starts, out=out[k])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(bands, texts): 64-bit keys, different for different bands."""
    parts = signature.reshape(BANDS, ROWS, -1).astype(np.uint64)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], parts.shape[2], axis=1)
    for j in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return keys.astype(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, keys of the bands, low bytes of the signature; the last three null for empty sets."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for a, b, texts in text_slices(batch, "text", PIECE):
                sets = shingle_sets(texts, words, cache)
                full = [s for s in sets if len(s)]
                digests, keys, marks = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    signature = signatures(full)
                    columns, low = band_keys(signature).T, (signature & np.uint32(0xFF)).astype(np.uint8).T
                    for at, (i, s) in enumerate((i, s) for i, s in enumerate(sets) if len(s)):
                        digests[i], keys[i], marks[i] = xxh3_128_digest(s.tobytes()), columns[at], low[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(marks, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "marks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>, marks binary"
    return own_columns(docs, "doc_id", "text").mapInArrow(giving_back(run), schema)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree enough, with the agreement; low bytes agree by chance once in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("x", "y"))
            share = ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)
            near = share >= LEAST_AGREEMENT
            kept = pa.array(near)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array(share[near])], ["a", "b", "share"]
            )

    return pairs.mapInArrow(giving_back(run), "a bigint, b bigint, share double")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                near.append(100 * common >= percent * (len(left) + len(right) - common))
            kept = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return pairs.mapInArrow(giving_back(run), "a bigint, b bigint")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) of the wanted documents, computed anew from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(texts, words, cache)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.binary())], ["id", "set"])

    wanted = own_columns(docs, "doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return wanted.mapInArrow(giving_back(run), "id bigint, set binary")


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs with ``value`` of both ends as x and y."""
    left = table.select(F.col("id").alias("a"), F.col(value).alias("x"))
    right = table.select(F.col("id").alias("b"), F.col(value).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (whether that is the row's own id).

    Two documents are linked if 100 · |A ∩ B| ≥ percent · |A ∪ B| for their sets of ``words``-word shingles. Documents
    without words have an empty set and no links. Repeated rows come back each; a null id takes no part in links and its
    component is null (kept); an empty table gives an empty result; other columns are not read. Ids are integers and
    name one text each.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = stages.write(sketches(docs, words), "sketches")
    linked = table.filter("digest is not null and doc_id is not null")
    first = F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands")).alias("first")
    # Written with their bands, so that the whole sketches are dealt out once only.
    classes = stages.write(linked.groupBy("digest").agg(first).select("digest", "first.*"), "classes")
    marks = linked.select(F.col("doc_id").alias("id"), "marks")
    rows = classes.select("id", "n", F.explode("bands").alias("key"))
    # Written, so that the join below is a plain one whose hot keys adaptive execution can split.
    shared = stages.write(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    buckets = stages.write(rows.join(shared, "key"), "buckets")
    stars = _stars(docs, buckets, marks, words, percent, stages)
    found = table.join(classes.select("digest", F.col("id").alias("_node")), "digest", "left")
    found = found.join(stars.select(F.col("a").alias("_node"), F.col("b").alias("_least")), "_node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "_node", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _stars(docs: DataFrame, buckets: DataFrame, marks: DataFrame, words: int, percent: int, stages: Stages) -> DataFrame:
    """(a, b): node and smallest node of its component, for all nodes but the smallest."""
    stars = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    sets, tried, known = [], [], False

    def all_sets(ids: DataFrame) -> DataFrame:
        """All sets computed so far and those of ``ids``; none is computed twice."""
        new = ids.join(stages.together(*sets).select("id"), "id", "left_anti") if sets else ids
        sets.append(stages.write(full_sets(docs, new, words), "sets"))
        return stages.together(*sets)

    for turn in range(LEADER_ROUNDS + 1):
        if known:
            named = buckets.join(stars.select(F.col("a").alias("id"), F.col("b").alias("_b")), "id", "left")
            named = named.select("key", "id", "n", F.coalesce("_b", "id").alias("comp"))
        else:
            named = buckets.select("key", "id", "n", F.col("id").alias("comp"))
        order = F.xxhash64("id", F.lit(turn))
        lead = [F.min_by(c, order).alias(o) for c, o in (("id", "other"), ("n", "other_n"), ("comp", "other_comp"))]
        mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), *lead)
        mixed = stages.write(mixed.filter("low < high").drop("low", "high"), "mixed")
        open_rows = named.join(mixed, "key")
        if turn == LEADER_ROUNDS:
            open_rows = stages.write(open_rows.select("key", "id", "comp", "size"), "open")
            families = stages.write(_families(open_rows, marks, stages), "families")
            stages.drop(open_rows)
            links, (found,) = stages.measured(_between(families, all_sets(families.select("id")), percent, stages), "between", F.count("*"))
        else:
            like = (F.col("n") * 100 >= F.col("other_n") * percent) & (F.col("other_n") * 100 >= F.col("n") * percent)
            pairs = open_rows.filter((F.col("comp") != F.col("other_comp")) & like)
            pairs = pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
            if tried:
                pairs = pairs.join(stages.together(*tried), ["a", "b"], "left_anti")
            # The likeliest partner only; whatever that leaves unconnected comes again.
            near = _agreeing(_with(pairs, marks, "marks")).groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
            near, (found,) = stages.measured(near, "near", F.count("*"))
            if found:
                tried.append(near)
                ends = all_sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
                links, (found,) = stages.measured(_confirmed(_with(near, ends, "set"), percent), "confirmed", F.count("*"))
        stages.drop(mixed)
        if found:
            stars, known = components(stars.unionByName(links) if known else links, stages), True
    return stars


def _packed(rows: DataFrame, keys: list[str], size: str, most: int, *columns: str) -> DataFrame:
    """Rows of each group packed into blocks of about ``most``: keys, part, parts, members."""
    parts = F.ceil(F.col(size) / most)
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return dealt.groupBy(*keys, "part", "parts").agg(F.collect_list(F.struct(*columns)).alias("members"))


def _families(open_rows: DataFrame, marks: DataFrame, stages: Stages) -> DataFrame:
    """(id, comp, family) of nodes that agree enough with a node of another component in one of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                sides = [(m.field("id").to_numpy(), m.field("comp").to_numpy(), m.field("marks")) for m in (x.values, y.values)]
                ids = np.concatenate([i for i, _, _ in sides])
                for a, b in zip(ids, _local_families(*sides)):
                    if b >= 0 and a != ids[b]:
                        out_a.append(a)
                        out_b.append(ids[b])
            ends = least_reachable(np.array(out_a, np.int64), np.array(out_b, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    rows = open_rows.select("key", "id", "comp", "size").join(marks, "id")
    packed = _packed(rows, ["key"], "size", FAMILY_BLOCK, "id", "comp", "marks")
    alone = packed.filter("parts = 1").select(F.col("members").alias("x"), F.col("members").alias("y"))
    large = packed.filter("parts > 1").select("key", "part", "members")
    other = large.select("key", F.col("part").alias("other"), F.col("members").alias("y"))
    crossed = large.withColumnRenamed("members", "x").join(other, "key").filter("part <= other").select("x", "y")
    # Written, so that a task never keeps two Python workers.
    edges = stages.write(alone.unionByName(crossed).mapInArrow(giving_back(run), "a bigint, b bigint"), "family-edges")
    stars = components(edges, stages)
    stages.drop(edges)
    named = stars.select(F.col("a").alias("id"), F.col("b").alias("family"))
    named = named.unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("family")).distinct())
    return named.join(open_rows.select("id", "comp").distinct(), "id")


def _local_families(x: tuple, y: tuple) -> np.ndarray:
    """Place of the first member of each member's family among both blocks; -1 where a member agrees with nobody."""
    (_, comp_x, marks_x), (_, comp_y, marks_y) = x, y
    left, right = (np.frombuffer(b"".join(m.to_pylist()), np.uint8).reshape(-1, COORDINATES) for m in (marks_x, marks_y))
    least = int(np.ceil(COORDINATES * (LEAST_AGREEMENT * (1 - 1 / 256) + 1 / 256)))
    near = np.zeros((len(left), len(right)), bool)
    for row in range(len(left)):
        near[row] = (left[row] == right).sum(1) >= least
    near &= comp_x[:, None] != comp_y
    label = np.arange(len(left) + len(right))
    a, b = label[: len(left)], label[len(left) :]
    far = len(label)
    for _ in range(far):
        new_a = np.minimum(a, np.where(near, b, far).min(1, initial=far))
        new_b = np.minimum(b, np.where(near.T, new_a, far).min(1, initial=far))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    return np.concatenate([np.where(near.any(1), a, -1), np.where(near.any(0), b, -1)])


def _between(families: DataFrame, sets: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """(a, b): links that connect different components of a family; families are staged (id, comp, family), sets (id, set).

    Blocks of nodes outside the family's largest component meet all blocks of the family once, each pair of blocks under its
    own key, so that a family with most of the rows is dealt out by its blocks. The families' counts are written before they
    join the ids, so that such a family can be split there too."""
    comps = families.groupBy("family", "comp").agg(F.count("*").alias("n"))
    largest = comps.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    largest = stages.write(largest, "largest")
    blocks = [F.ceil(size / SET_BLOCK).alias(name) for name, size in (("mains", F.col("top.n")), ("others", F.col("all") - F.col("top.n")))]
    sorted_in = families.join(largest, "family").select("id", "comp", "family", (F.col("comp") == F.col("top.comp")).alias("main"), *blocks)
    part = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).alias("part")
    packed = sorted_in.select("*", part).join(sets, "id").groupBy("family", "main", "part", "mains", "others")
    packed = stages.write(packed.agg(F.collect_list(F.struct("id", "comp", "set")).alias("members")), "set-blocks")
    met = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda q: F.struct(F.lit(True).alias("main"), q.cast("bigint").alias("part"))),
        F.transform(F.sequence("part", F.col("others") - 1), lambda q: F.struct(F.lit(False).alias("main"), q.cast("bigint").alias("part"))),
    )
    left = packed.filter(~F.col("main")).select("family", F.col("members").alias("x"), F.explode(met).alias("met")).select("family", "met.*", "x")
    right = packed.select("family", "main", "part", F.col("members").alias("y"))
    pairs = left.join(right, ["family", "main", "part"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                found += _links(*((m.field("id").to_numpy(), m.field("comp").to_numpy(), m.field("set")) for m in (x.values, y.values)), percent)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(giving_back(run), "a bigint, b bigint")


def _links(x: tuple, y: tuple, percent: int) -> list[tuple[int, int]]:
    """One link for each two components of two blocks that have one; overlaps are counted over the sorted shingles of ``y``."""
    (ids_x, comp_x, sets_x), (ids_y, comp_y, sets_y) = x, y
    right = [np.frombuffer(v.as_buffer(), np.uint64) for v in sets_y]
    sizes = np.array([len(v) for v in right])
    shingles = np.concatenate(right)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(right)), sizes)[order]
    seen: set[tuple[int, int]] = set()
    out = []
    for row, value in enumerate(sets_x):
        own = np.frombuffer(value.as_buffer(), np.uint64)
        low = np.searchsorted(shingles, own, "left")
        many = np.searchsorted(shingles, own, "right") - low
        common = np.bincount(owner[ragged_index(low, many)], minlength=len(right))
        near = (100 * common >= percent * (len(own) + sizes - common)) & (comp_y != comp_x[row])
        for at in np.flatnonzero(near).tolist():
            link = (int(comp_x[row]), int(comp_y[at]))
            if link not in seen:
                seen.add(link)
                out.append((int(ids_x[row]), int(ids_y[at])))
    return out


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that a smaller id of their component stands for.

    Rows with a null id stay. Rows are picked by id, so copies of the kept row itself stay too.
    """
    gone = near_duplicates(docs, words, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
