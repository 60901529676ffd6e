"""MinHash near-dedup by an LSH forest.

A document's set are its distinct word shingles.  Equal sets collapse to their smallest id first.
A signature holds ``TREES * DEPTH`` minima; tree ``t`` sorts documents by the signature
rotated to position ``t * DEPTH``, and a region is a run of documents whose common prefix
there is at least ``DEPTH`` long.  Two sets of similarity 0.8 share no region of 48 trees of
depth 6 with probability (1 - 0.8^6)^48 < 5e-7.

* Small regions give all their pairs.  In larger ones each document meets its neighbours
  by longest common prefix; regions beyond ``BLOCK`` documents are sorted at a depth that grows
  until they fit.
* Pairs whose signatures agree too little are dropped (bound: more than 4 standard deviations below
  0.8), the rest is confirmed on the full sets.  Best pairs come first, and their
  links give components.
* What is left are pairs between different components.  Small regions have listed them; in
  larger ones every document outside the region's main component meets all members, in blocks, so a hot region is
  spread over many tasks and no pair inside a component is made.  Signatures meet first; texts are sent only for
  the members of a block that have a candidate there, and a block gives back links between components only.

A document's trees travel as one row until they are grouped by region.  The forest finds candidates; only links
confirmed on full sets count.  Sets are compared as sorted 64-bit hashes, the same that give their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicflow.llm import bloom, words
from topicflow.llm.batches import small_batches
from topicflow.llm.components import components
from topicflow.scratch import Scratch

TREES, DEPTH = 48, 6
SIGNATURE = TREES * DEPTH
#: Members up to which a region lists all its pairs, and of a block of a larger one.
SMALL, BLOCK = 12, 1024
#: Shingles of the members of a block: 8 MB of hashes.
WEIGHT = 1 << 20
#: Bytes of text whose pairs are confirmed at a time (a longer pair is confirmed alone).
CONFIRMED = 16 << 20
#: Standard deviations of the estimate below the threshold that still count as candidates.
SIGMAS = 4.7

_rng = np.random.default_rng(20240517)
_MULT = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
_SHINGLE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, ordered by document, then hash."""
    start, end, first = words.word_spans(data, offsets)
    hashes = words.word_hashes(data, start, end, lower=True)
    count = np.diff(first)
    doc = np.repeat(np.arange(count.size), count)
    full = max(0, hashes.size - size + 1)
    total = np.zeros(full, np.uint64)
    for k in range(size):
        total += hashes[k : k + full] * _SHINGLE[k]
    whole = doc[:full] == doc[size - 1 :] if full else np.zeros(0, bool)
    owner, value = [doc[:full][whole]], [words.mix(total[whole])]
    for n in range(1, size):  # texts with fewer words: the whole sequence, salted by its length
        short = np.flatnonzero(count == n)
        if short.size:
            at = first[short]
            seq = sum((hashes[at + k] * _SHINGLE[k] for k in range(n)), np.zeros(short.size, np.uint64))
            owner.append(short)
            value.append(words.mix(seq ^ np.uint64(n)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    owner, value = owner[order], value[order]
    new = np.ones(owner.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in words.pieces(batch.column(1)):
            n = offsets.size - 1
            owner, value = _shingles(data, offsets, size)
            count = np.bincount(owner, minlength=n)
            some = np.flatnonzero(count)
            first = np.concatenate([[0], np.cumsum(count[some])])[:-1].astype(np.int64)
            minima = np.empty((some.size, SIGNATURE), np.uint32)
            equal = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            if some.size:
                small = (value >> np.uint64(32)).astype(np.uint32)
                for k in range(SIGNATURE):
                    minima[:, k] = np.minimum.reduceat((small ^ _XOR[k]) * _MULT[k], first)
                equal[0][some] = np.add.reduceat(value, first)
                equal[1][some] = np.add.reduceat(words.mix(value ^ np.uint64(0x5851F42D4C957F2D)), first)
            parts = minima.reshape(-1, TREES, DEPTH).astype(np.uint64)
            key = np.tile(np.arange(TREES, dtype=np.uint64), (some.size, 1))
            for k in range(DEPTH):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
            sig = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            place = np.full(n, -1)
            place[some] = np.arange(some.size)
            blank = [None] * n
            sigs, keys = blank.copy(), blank.copy()
            for d, p in zip(some.tolist(), range(some.size)):
                sigs[d] = sig[p].tobytes()
                keys[d] = words.signed(key[p])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, n).cast(pa.int64()),
                    pa.array(count.astype(np.int64)),
                    pa.array(words.signed(equal[0])),
                    pa.array(words.signed(equal[1])),
                    pa.array(sigs, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "e1", "e2", "sig", "keys"],
            )


def _agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).mean(axis=1)


def _least_agreement(threshold: float) -> float:
    return threshold - SIGMAS * (threshold * (1 - threshold) / SIGNATURE) ** 0.5


def _estimate(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sa", "sb")]
        share = (sides[0] == sides[1]).mean(axis=1)
        keep = pa.array(share >= least)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share).filter(keep)], ["a", "b", "share"]
        )


def _sigs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def _neighbours(least: float, near: int = 8, best: int = 2):
    """Each member of a block with the best of its predecessors in the tree's order."""

    def solve(table: pa.Table) -> pa.Table:
        ids, sig, tree = table["id"].to_numpy(), _sigs(table), table["tree"][0].as_py()
        turned = np.roll(sig, -tree * DEPTH, axis=1)
        order = np.lexsort((ids, *turned.T[DEPTH + 24 :: -1]))
        ids, sig = ids[order], sig[order]
        a, b, share = [], [], []
        for i in range(1, ids.size):
            others = np.arange(max(0, i - near), i)
            got = _agreement(sig[i], sig[others])
            for j in np.argsort(-got)[:best]:
                if got[j] >= least:
                    a.append(min(ids[i], ids[others[j]]))
                    b.append(max(ids[i], ids[others[j]]))
                    share.append(got[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "share": pa.array(share, pa.float64())})

    return solve


def _met(table: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """A block's minor members with their candidates in other components, the most similar first.

    A pair meets in the first tree whose region holds both, by the keys that make the regions: the signature's bytes
    may agree where the minima do not.
    """
    sig, comp, tree = _sigs(table), table["comp"].to_numpy(), table["tree"][0].as_py()
    minor = np.array(table["minor"].to_pylist(), bool)
    rest = np.flatnonzero(~minor)
    keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
    for i in np.flatnonzero(minor):
        got = _agreement(sig[i], sig[rest])
        near = (got >= least) & (comp[rest] != comp[i])
        hit = rest[near][np.argsort(-got[near], kind="stable")]
        if hit.size:
            yield int(i), hit[(keys[hit] == keys[i]).argmax(axis=1) == tree]


def _candidates(least: float):
    """The members of a block that have a candidate in it."""

    def solve(table: pa.Table) -> pa.Table:
        needed = np.zeros(table.num_rows, bool)
        for i, hit in _met(table, least):
            needed[hit] = True
            needed[i] |= hit.size > 0
        return table.filter(pa.array(needed))

    return solve


def _across(least: float, size: int, percent: int):
    """Confirmed links of a block's minor members with members of other components, one for each two components.

    The most similar come first, and only while nothing found in the block connects the two.
    """

    def solve(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
        sets = _sets(table["text"], size)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x] = root[root[x]]
            return x

        a, b = [], []
        for i, hit in _met(table, least):
            for j in hit.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and _similar(sets[i], sets[j], percent):
                    root[x] = y
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return solve


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    out = []
    for _, data, offsets in words.pieces(texts):
        owner, value = _shingles(data, offsets, size)
        out += np.split(value, np.searchsorted(owner, np.arange(1, offsets.size - 1)))
    return out


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(one.size, two.size) < percent * max(one.size, two.size):
        return False
    common = np.intersect1d(one, two, assume_unique=True).size
    return 100 * common >= percent * (one.size + two.size - common)


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = sum(np.array(pc.binary_length(batch.column(c)).to_pylist(), np.int64) for c in ("ta", "tb"))
        before = np.concatenate([[0], np.cumsum(sizes)])
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(before, before[row] + CONFIRMED, "right")) - 1)
            part = batch.slice(row, stop - row)
            row = stop
            left, right = _sets(part.column("ta"), size), _sets(part.column("tb"), size)
            keep = pa.array([_similar(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of ``docs(id, ...)`` that may be among ``ids(id)``; all others stay where they are."""
    bits = bloom.filter_bits(ids.count())
    pages = bloom.build(ids.select(F.xxhash64("id").alias("k")), "k", bits)
    return scratch.save(bloom.probe(docs, F.xxhash64("id"), pages, bits, "hit").filter("hit").select(docs.columns), f"{name}-texts")


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose full sets are similar enough.  Only texts in a pair move."""
    texts = _texts(pairs.select("a").union(pairs.select("b")).toDF("id").distinct(), docs, scratch, name)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    with small_batches(docs.sparkSession, 300):
        links = scratch.save(both.mapInArrow(lambda it: _confirm(it, size, percent), "a long, b long"), f"{name}-links")
    scratch.forget(texts)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Texts of fewer than ``shingle`` words have
    one shingle, the whole sequence; null, empty and blank texts have none, link with nothing
    and are kept.  Documents link when ``100 * |A & B| >= percent * |A | B|``;
    ``component_id`` is the smallest id reachable.  Ids must be unique integers; a row with a null
    id gets a null component and is kept.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    threshold = percent / 100
    least = _least_agreement(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(
        lambda it: _sign(it, shingle), "id long, n_shingles long, e1 long, e2 long, sig binary, keys array<long>"
    )
    with small_batches(spark):
        signed = scratch.save(signed, "signed")
    known = signed.filter("id is not null and n_shingles > 0")
    classes = known.groupBy("e1", "e2", "n_shingles").agg(F.min("id").alias("rep"))
    reps = known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    region = scratch.save(reps.select("id", F.posexplode("keys").alias("tree", "key")), "leaves")
    counted = scratch.save(region.groupBy("key").count().filter("count > 1"), "regions")
    bits = bloom.filter_bits(counted.count())
    pages = bloom.build(counted, "key", bits)
    shared = scratch.save(
        bloom.probe(region, F.col("key"), pages, bits, "hit").filter("hit").drop("hit").join(counted, "key"), "shared"
    )
    scratch.forget(region, counted)
    sig = reps.select("id", "sig")

    # small regions: all pairs
    listed = shared.filter(f"count <= {SMALL}").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("m"))
    pairs = listed.select(F.expr("inline(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b)))))")).distinct()
    with_sigs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"
    )
    small = scratch.save(with_sigs.mapInArrow(lambda it: _estimate(it, least), "a long, b long, share double"), "small")

    # larger ones: neighbours in the tree's order, at a depth at which they fit a block
    trees = shared.filter(f"count > {SMALL}").groupBy("id").agg(F.collect_list("tree").alias("trees"))  # at most TREES
    hubs = scratch.save(reps.select("id", "n_shingles", "sig", "keys").join(trees, "id"), "hubs")

    def by_tree(docs: DataFrame, *columns: str) -> DataFrame:
        """A row per document and larger region."""
        one = docs.withColumn("tree", F.explode("trees"))
        return one.withColumn("key", F.expr("element_at(keys, tree + 1)")).select("key", "tree", *columns)

    large = scratch.save(by_tree(hubs, "id", "sig"), "large")
    deeper = large.withColumn("k", F.col("key"))
    for step in (2, 4):
        start = f"pmod(tree * {DEPTH} + {DEPTH}, {SIGNATURE}) + 1"
        twice = "concat(sig, sig)"
        deep = F.xxhash64("key", F.expr(f"substring({twice}, {start}, {step})"))
        counts = deeper.groupBy("k").count().select("k", F.col("count").alias("now"))
        deeper = deeper.join(counts, "k").withColumn("k", F.when(F.col("now") > BLOCK, deep).otherwise(F.col("k"))).drop("now")
        deeper = scratch.save(deeper, "deeper")
    counts = deeper.groupBy("k").count().select("k", F.expr(f"(count + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    blocked = deeper.join(counts, "k").select("k", F.expr("pmod(xxhash64(id), blocks)").alias("block"), "id", "tree", "sig")
    near = blocked.groupBy("k", "block").applyInArrow(_neighbours(least), "a long, b long, share double")

    # each document's two best partners first: a few links hold a group together
    first = W.partitionBy("b").orderBy(F.desc("share"), "a")
    listed = small.union(near).groupBy("a", "b").agg(F.max("share").alias("share"))
    ranked = scratch.save(listed.withColumn("nth", F.row_number().over(first)), "ranked")
    scratch.forget(small)
    start = ranked.filter("nth <= 2").select("a", "b")
    links1 = _links(scratch.save(start, "start"), texts, shingle, percent, scratch, "first")
    comps = components(links1, scratch)

    def labelled(df: DataFrame, key: str, out: str) -> DataFrame:
        found = comps.select(F.col("node").alias(key), F.col("component").alias(out))
        return df.join(found, key, "left").withColumn(out, F.coalesce(out, key))

    scratch.forget(large)
    rest = labelled(labelled(ranked.filter("nth > 2").select("a", "b"), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    links2 = _links(scratch.save(rest, "rest"), texts, shingle, percent, scratch, "second")
    links = links1.union(links2)
    comps = components(links, scratch)

    members = by_tree(scratch.save(labelled(hubs, "id", "comp"), "labelled"), "id", "comp", "sig", "keys", "n_shingles")
    main = (
        members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
        .groupBy("key").agg(
            F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max(F.struct("n", "comp", "w")).alias("top"),
            F.sum("n").alias("n"), F.sum("w").alias("w"),
        )
        .filter("top.n < n")
        .select(
            "key", "main",
            F.expr(f"greatest((n + {BLOCK - 1}) div {BLOCK}, (w + {WEIGHT - 1}) div {WEIGHT})").alias("nj"),
            F.expr(f"greatest((n - top.n + {BLOCK - 1}) div {BLOCK}, (w - top.w + {WEIGHT - 1}) div {WEIGHT})").alias("ni"),
        )
    )
    mixed = scratch.save(members.drop("n_shingles").join(main, "key").withColumn("salt", F.xxhash64("id")), "mixed")
    columns = ["key", "i", "j", "id", "tree", "sig", "keys", "comp", "minor"]
    outside = mixed.filter("comp <> main").withColumn("i", F.expr("pmod(salt, ni)")).withColumn("minor", F.lit(True))
    inside = mixed.withColumn("j", F.expr("pmod(salt, nj)")).withColumn("minor", F.lit(False))
    met = outside.withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).select(columns).union(
        inside.withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).select(columns)
    )
    needed = scratch.save(met.groupBy("key", "i", "j").applyInArrow(_candidates(least), met.schema), "needed")
    with_texts = needed.join(_texts(needed.select("id").distinct(), texts, scratch, "needed"), "id")
    across = scratch.save(
        with_texts.groupBy("key", "i", "j").applyInArrow(_across(least, shingle, percent), "a long, b long"), "across"
    )
    final = components(links.union(across), scratch) if across.take(1) else comps

    result = (
        signed.select("id", "n_shingles", "e1", "e2")
        .join(classes, ["e1", "e2", "n_shingles"], "left")
        .join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    )
    out = scratch.save(result.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "result")
    scratch.forget(signed, shared, hubs, ranked, mixed, needed)
    return out.withColumnRenamed("id", id_col)
