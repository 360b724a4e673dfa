"""MinHash near-deduplication with an LSH forest.

Every distinct shingle set gets a ring of TREES * STEP MinHash values.  Tree t of the
forest sorts all sets by the values from place t * STEP on, DEEP of them, so sets
with long common prefixes are neighbours.  Depth adapts by region: a set's candidate
in a tree is the neighbour of its longest common prefix, whatever depth that has,
LEAST values at least.  The closest candidate over all trees is confirmed on full
sets, and links make components.

Regions (stretches of a tree that share LEAST values) whose sets lie in one component
are done.  The sets of the others go to an exact join: a set's shingles are ordered
from rare to common, and two sets at or above the bound share a shingle among the
first few of both.  Sets that this leaves open are compared on full sets, in blocks
of bounded size.  So no region is searched pair by pair, and none is capped.

A pair at the least similarity s shares a region with probability
1 - (1 - s**LEAST)**TREES: 0.99999 at 0.85 and at 0.8 (16 and 22 trees).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, id_columns, in_few_files, matching, partitions
from .components import components
from .shingles import MinHash, shingle_set, similar

#: Values that a region shares; values from one tree's start to the next; values of a tree's order.
LEAST, STEP, DEEP = 4, 8, 16
#: Counters of shingle frequencies, a fixed size whatever the input.
CELLS = 1 << 18
#: Rows that one task holds of a shingle's list, on each side; sets, and bytes of them, of a cluster's block.
BLOCK, BLOCK_BYTES = 1000, 16 << 20
#: Bytes of sets beyond which they are sent in rounds; rounds in which candidates are confirmed, at most.
ROUND_BYTES, ROUNDS = 256 << 20, 8
_HEAD = 1 + 2 * LEAST  # bytes of a region's name


def trees_for(percent: int) -> int:
    """Trees enough that a pair at the bound is missed with a probability of about 1e-5."""
    return int(np.ceil(np.log(1e-5) / np.log(1 - (percent / 100) ** LEAST)))


def words_of_values(v: np.ndarray) -> np.ndarray:
    """A hash of each whole MinHash value: those of large sets are small numbers, which agree in their leading bits."""
    word = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    word = (word ^ (word >> np.uint32(12))) * np.uint32(0x297A2D39)
    return word ^ (word >> np.uint32(15))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """doc_id, n, digest of the set, its ring of values (two bytes each), and one further bit of each value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHash(trees * STEP)
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingle_set(text, width)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                v = minhash.of(s)
                word = words_of_values(v)
                ring = np.r_[word, word[: DEEP - STEP]] >> np.uint32(16)
                bits = np.packbits((word & np.uint32(1)).astype(np.uint8))
                rows.append((len(s), _digest(s), ring.astype(">u2").tobytes(), bits.tobytes()))
            out = pd.DataFrame(rows, columns=["n", "digest", "ring", "sketch"])
            out.insert(0, "doc_id", pd.arrays.IntegerArray(b["doc_id"].to_numpy(), b["no_id"].to_numpy(bool)))
            yield out

    return docs.mapInPandas(run, "doc_id long, n int, digest binary, ring binary, sketch binary")


def _orders(reps: DataFrame, trees: int) -> DataFrame:
    """A row for each set and tree, sorted: the tree's number and its values as bytes."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = reps.select("rep", "n", "ring", "sketch", tree)
    prefix = F.substring("ring", F.col("tree") * (2 * STEP) + 1, F.lit(2 * DEEP))
    name = F.unhex(F.lpad(F.hex("tree"), 2, "0"))
    rows = rows.select(F.concat(name, prefix).alias("prefix"), "rep", "n", "sketch")
    return rows.repartitionByRange(partitions(reps.sparkSession), "prefix", "rep").sortWithinPartitions("prefix", "rep")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)


def _limit(percent: int, bits: int) -> int:
    """Differing sketch bits beyond which a pair is below the bound (at five standard deviations)."""
    p = (1 - percent / 100) / 2
    return int(bits * p + 5 * np.sqrt(bits * p * (1 - p))) + 1


def _neighbours(orders: DataFrame, percent: int, bits: int) -> DataFrame:
    """Sets that share a region, each with the set before it in the order: region, rep, other, likeness (null where sketches or sizes rule a link out).

    A task sees one stretch of the order.  Rows at its ends always pass, as their
    regions may go on beyond.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = _limit(percent, bits)
        held, out, shared, no_link, link = None, None, True, True, (0, 0)
        for b in batches:
            if not len(b):
                continue
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            prefix = np.frombuffer(b"".join(rows["prefix"]), np.uint8).reshape(len(rows), -1)
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
            n, rep = rows["n"].to_numpy().astype(np.int64), rows["rep"].to_numpy()
            same = (prefix[1:, :_HEAD] == prefix[:-1, :_HEAD]).all(axis=1)
            diff = _differing(sketch[1:], sketch[:-1])
            ok = same & (diff <= limit) & (100 * np.minimum(n[1:], n[:-1]) >= percent * np.maximum(n[1:], n[:-1]))
            without = np.r_[no_link, ~ok]
            out = pd.DataFrame({"region": [p[:_HEAD] for p in rows["prefix"]], "rep": rep})
            out["other"] = pd.arrays.IntegerArray(np.r_[link[0], rep[:-1]].astype(np.int64), without)
            out["likeness"] = pd.arrays.IntegerArray(np.r_[link[1], bits - diff].astype(np.int32), without.copy())
            before = np.r_[shared, same]
            yield out[:-1][(before[:-1] | same)]
            held, shared, no_link = rows.iloc[-1:], bool(before[-1]), bool(without[-1])
            link = (0, 0) if no_link else (int(out["other"].iloc[-1]), int(out["likeness"].iloc[-1]))
        if out is not None:
            yield out.iloc[-1:]

    return orders.mapInPandas(run, "region binary, rep long, other long, likeness int")


def _sets(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """The full shingle sets (members) of the documents in ``known`` (a written table of id, digest and other columns), beside its columns."""
    picked = matching(docs.filter("not no_id"), "doc_id", known, "id").select("text", *known.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b["text"]]
            # an id may come with several texts
            own = np.array([_digest(s) == d for s, d in zip(sets, b["digest"])], bool)
            yield b.drop(columns="text").assign(members=[s.tobytes() for s in sets])[own]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    return picked.mapInPandas(run, f"{schema}, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets (id, members)."""
    left = sets.select(F.col("id").alias("ia"), F.col("members").alias("sa"))
    right = sets.select(F.col("id").alias("ib"), F.col("members").alias("sb"))
    both = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["sa"], b["sb"])]
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _candidate_links(texts: DataFrame, pairs: DataFrame, reps: DataFrame, work: Workspace, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets.

    Sets are twice as large as their texts' file or more, and the joins send them
    three times.  Beyond ROUND_BYTES of them the pairs are dealt to rounds by a, and
    disk holds one round's sets and shuffles.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    count = pairs.count()
    ids = work.save(in_few_files(ids.join(reps, F.col("id") == F.col("rep")).select("id", "digest", "n"), 64 * count), "ids-1")
    size = ids.agg(F.sum(8 * F.col("n").cast("long"))).collect()[0][0] or 0
    rounds, found = min(ROUNDS, -(-size // ROUND_BYTES)) or 1, []
    known = ids.select("id", "digest")
    for k in range(rounds):
        tag, part, of = (f"1-{k}", pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k), known) if rounds > 1 else ("1", pairs, known)
        if rounds > 1:
            own = part.select(F.explode(F.array("a", "b")).alias("i")).distinct()
            of = work.save(in_few_files(known.join(own, F.col("id") == F.col("i"), "left_semi"), 64 * count // rounds), f"ids-{tag}")
        sets = work.save(_sets(texts, of, width), f"members-{tag}", "none")
        found.append(work.save(in_few_files(_confirmed(part, sets, percent), 16 * count // rounds, deal=True), f"links-{tag}"))
        work.drop(f"members-{tag}")
    return reduce(DataFrame.unionByName, found)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each of CELLS cells: a fixed number of counters, summed up by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["members"]), np.uint64) % np.uint64(CELLS), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    found = sets.select("members").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(CELLS, np.int32)
    cells[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), 0x7FFFFFFF)
    return cells


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """The shingles by which a set is found: shingle, id, root, n, sketch, indexed.

    In one order of all shingles, rare ones first, two sets at or above the bound
    share a shingle that is among the first n - ceil(s n) + 1 of the larger set
    and the first n - ceil(2 s n / (1 + s)) + 1 of the smaller one (``indexed``).
    """
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))  # CELLS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for b in batches:
            for lo in range(0, len(b), 200):
                part, found = b.iloc[lo : lo + 200], []
                for k, members in enumerate(part["members"]):
                    s = np.frombuffer(members, np.uint64)
                    n = len(s)
                    ask, hold = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                    first = s[np.lexsort((s, cells[s % np.uint64(CELLS)]))[:ask]]
                    found.append((first.view(np.int64), np.full(ask, k), np.arange(ask) < hold))
                at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                if len(at):
                    row = part.iloc[at]
                    yield pd.DataFrame({"shingle": np.concatenate([f[0] for f in found]), "id": row["id"].to_numpy(), "root": row["root"].to_numpy(), "n": row["n"].to_numpy(), "sketch": row["sketch"].to_numpy(), "indexed": np.concatenate([f[2] for f in found])})

    return sets.mapInPandas(run, "shingle long, id long, root long, n int, sketch binary, indexed boolean")


def _list_ties(rows: pd.DataFrame, limit: int, percent: int) -> pd.DataFrame:
    """Sets that parts of shingles' lists leave open, each tied to the first of its part (a star, not the pairs); rows are sorted by part, those asked before those held."""
    bits = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    n, ids, root, held = (rows[c].to_numpy() for c in ("n", "id", "root", "held"))
    n, first = n.astype(np.int64), _starts(rows)
    begin, part = np.flatnonzero(first), np.cumsum(first) - 1
    asked = np.add.reduceat((~held).astype(np.int64), begin)
    at = np.flatnonzero(held & (asked[part] > 0))
    upto = np.cumsum(asked[part[at]])
    hit, lo = np.zeros(len(rows), bool), 0
    while lo < len(at):  # about a million comparisons at a time
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right")))
        size, start = asked[part[at[lo:hi]]], begin[part[at[lo:hi]]]
        x = np.repeat(at[lo:hi], size)
        y = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ok = ((n[x] < n[y]) | ((n[x] == n[y]) & (ids[x] < ids[y]))) & (root[x] != root[y]) & (100 * n[x] >= percent * n[y])
        x, y = x[ok], y[ok]
        close = _differing(bits[x], bits[y]) <= limit
        hit[x[close]] = hit[y[close]] = True
        lo = hi
    hit = np.flatnonzero(hit)
    _, star, of = np.unique(part[hit], return_index=True, return_inverse=True)
    a, b = ids[hit], ids[hit[star[of]]] if len(hit) else ids[hit]
    tied = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    return pd.DataFrame({"a": tied[0], "b": tied[1]})


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Whether a row is the first of its part."""
    first = np.ones(len(rows), bool)
    key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
    first[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return first


def _whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut where a part ends."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = int(np.flatnonzero(_starts(b))[-1])
        ends = held and _starts(pd.concat([held[-1].iloc[-1:], b.iloc[:1]]))[1]
        if last or ends:
            done = pd.concat([*held, b.iloc[:last]], ignore_index=True)
            if len(done):
                yield done
            held = []
        held.append(b.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components among the sets of one block, or between two blocks; one for each pair of components at most."""
    first = rows["block"].to_numpy() == rows["low"].to_numpy()[0]
    sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
    rep, root = rows["id"].to_numpy(), rows["root"].to_numpy()
    same = rows["low"].iloc[0] == rows["high"].iloc[0]
    asked = np.flatnonzero(first)
    held = asked if same else np.flatnonzero(~first)
    if not len(held) or not len(asked):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    size = np.array([len(sets[k]) for k in held])
    flat, owner = np.concatenate([sets[k] for k in held]), np.repeat(np.arange(len(held)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    leader = {r: r for r in set(root.tolist())}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    # sets of the commonest component are only asked about, which spares most comparisons
    values, counts = np.unique(root[asked], return_counts=True)
    main = values[counts.argmax()]
    queries = asked[root[asked] != main] if same else asked
    out = []
    for q in queries:
        other = root[held] != root[q]
        if not other.any():
            continue
        lo, hi = np.searchsorted(flat, sets[q], "left"), np.searchsorted(flat, sets[q], "right")
        n = hi - lo
        both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(held))
        for k in np.flatnonzero(other & (100 * both >= percent * (len(sets[q]) + size - both))):
            x, y = find(int(root[q])), find(int(root[held[k]]))
            if x != y:
                leader[max(x, y)] = min(x, y)
                out.append((max(rep[q], rep[held[k]]), min(rep[q], rep[held[k]])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _links_across(sets: DataFrame, work: Workspace, percent: int, bits: int) -> DataFrame:
    """All links between components among ``sets`` (id, root, n, sketch, members), by an exact prefix join; one for each pair of components and task.

    A list of one component, or without an indexed row, leaves nothing open.  Long
    lists are dealt out in parts of about BLOCK rows on either side, a task for each
    two parts; rows carry sketches, not sets.  Open sets that hang together form a
    cluster, which is compared with itself in blocks of bounded size, every two
    blocks in a task of their own; no pair leaves its task unless it links two
    components.  The tasks are dealt to rounds, each of which sends about as many
    bytes as the clusters have (ROUND_BYTES at least).
    """
    rows = work.save(_rare_shingles(sets, percent), "rare")
    lists = rows.groupBy(F.col("shingle").alias("key")).agg(F.count(F.lit(1)).alias("ask"), F.count_if("indexed").alias("hold"), F.min("root").alias("low"), F.max("root").alias("high"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    live = lists.filter("hold > 0 and low <> high").select("key", parts("ask").alias("asks"), parts("hold").alias("holds"))
    rows = rows.join(work.save(in_few_files(live, 16 * rows.count()), "lists"), F.col("shingle") == F.col("key"))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["key", "id", "root", "n", "sketch"]
    asked = rows.select(*columns, F.lit(False).alias("held"), own("asks").alias("x"), every("holds").alias("y"))
    held = rows.filter("indexed").select(*columns, F.lit(True).alias("held"), every("asks").alias("x"), own("holds").alias("y"))
    limit = _limit(percent, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_parts(batches):
            yield _list_ties(rows, limit, percent)

    dealt = asked.unionByName(held).repartition(partitions(sets.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "held")
    number, size = sets.agg(F.count(F.lit(1)), F.sum(8 * F.col("n").cast("long"))).collect()[0]
    ties = work.save(in_few_files(dealt.mapInPandas(run, "a long, b long").distinct(), 16 * number), "ties")
    work.drop("rare")

    clusters = components(ties, work, "clusters")
    ids = ties.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    named = ids.join(clusters, F.col("i") == F.col("u"), "left").select("i", F.coalesce("v", "i").alias("cluster"))
    full = sets.join(named, F.col("id") == F.col("i")).select("id", "cluster", "root", "n", "members")
    full = work.save(in_few_files(full, size or 0), "clustered", "none")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(8 * F.col("n").cast("long")) / BLOCK_BYTES)).cast("int")
    sizes = work.save(in_few_files(full.groupBy(F.col("cluster").alias("c")).agg(size.alias("blocks")), 16 * number), "cluster-sizes")
    work.drop("members-2")  # those that are still needed are written
    placed = full.join(sizes, F.col("cluster") == F.col("c")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a cluster's sets are sent once for each of its blocks
    size = 8 * F.col("n").cast("long")
    once, sent = (int(v or 0) for v in placed.agg(F.sum(size), F.sum(size * F.col("blocks"))).collect()[0])
    rounds = -(-sent // max(once, ROUND_BYTES)) or 1

    def links(k: int) -> DataFrame:
        turn = lambda w: F.pmod(F.xxhash64("cluster", F.least("block", w), F.greatest("block", w)), F.lit(rounds)) == k
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), turn)
        tasks = placed.select("id", "cluster", "block", "root", "members", F.explode(others).alias("with"))
        tasks = tasks.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
        return tasks.groupBy("cluster", "low", "high").applyInPandas(lambda rows: _block_links(rows, percent), "a long, b long")

    return reduce(DataFrame.unionByName, [work.save(in_few_files(links(k), 16 * number, deal=True), f"links-2-{k}") for k in range(rounds)])


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for every row.

    Documents are linked when 100 * intersection >= percent * union of their shingle
    sets; a component is named after its smallest id.  Null and empty texts, and
    texts without words, have no shingles and are linked with nothing.  Rows with a
    null id are linked with nothing, get a null component_id and are kept.
    Repeated rows get equal results; rows of one id with different texts are one
    document with several texts.  An empty table gives an empty result.  Other
    columns of ``docs``, whatever their names, aren't read.

    Copies (equal sets) are merged on the map side before anything is compared, so
    a large group of copies is one set.  The trees' orders are dealt to tasks by
    ranges, so a large region is many tasks' work; every set brings one candidate to
    be confirmed.  All links are confirmed on full sets; nothing is capped.

    Texts are read where they lie: only those of sets to be compared are shuffled.
    Sets and shuffle files go when a step is done.  Tables that the result needs lie
    in ``work`` (by default a folder that goes with the session), which its owner may
    drop once the result is written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    work = work or Workspace(spark, "near-dedup", tidy=True)
    trees = trees_for(percent)
    bits = trees * STEP
    texts = docs.select(*id_columns(id_col), F.col(text_col).cast("string").alias("text"))
    rows = work.save(_signatures(texts, width, trees), "signatures")
    usable = rows.filter("n > 0 and doc_id is not null")
    reps = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("ring").alias("ring"), F.first("sketch").alias("sketch"))
    number = rows.count()
    reps = work.save(in_few_files(reps, number * 3 * trees * STEP), "sets")
    count = reps.count()
    regions = work.save(in_few_files(_neighbours(_orders(reps, trees), percent, bits), 32 * trees * count, deal=True), "regions")

    # of all trees each set keeps its closest neighbour; what that leaves apart is for the exact join
    best = regions.filter("other is not null").groupBy("rep").agg(F.max(F.struct("likeness", "other"))["other"].alias("other"))
    pairs = best.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).filter("a <> b").distinct()
    pairs = work.save(in_few_files(pairs, 16 * count), "pairs-1")
    links = _candidate_links(texts, pairs, reps, work, percent, width)
    roots = components(links, work, "roots-1")

    placed = regions.join(roots, F.col("rep") == F.col("u"), "left").select("region", "rep", F.coalesce("v", "rep").alias("root"))
    mixed = placed.groupBy(F.col("region").alias("r")).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("r")
    open_ = placed.join(mixed, F.col("region") == F.col("r"), "left_semi").select(F.col("rep").alias("id"), "root").distinct()
    open_ = open_.join(reps, F.col("id") == F.col("rep")).select("id", "root", "n", "sketch", "digest")
    open_ = work.save(in_few_files(open_, 64 * count), "open")
    full = work.save(_sets(texts, open_, width), "members-2", "none")
    links = links.unionByName(_links_across(full, work, percent, bits))
    links = work.save(in_few_files(links, 16 * links.count()), "links-2")
    work.drop("members-2", "clustered")
    roots = components(links, work, "roots-2")

    named = reps.select("digest", "rep").join(roots, F.col("rep") == F.col("u"), "left").select(F.col("digest").alias("g"), F.coalesce("v", "rep").alias("root"))
    small = rows.select("doc_id", "n", "digest")
    # rows without a set must not meet in one task
    key = F.coalesce("digest", F.xxhash64("doc_id").cast("string").cast("binary"))
    out = small.withColumn("k", key).join(named, F.col("k") == F.col("g"), "left")
    component = F.coalesce("root", "doc_id")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
    return in_few_files(out, 64 * number)

