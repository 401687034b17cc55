"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles has a signature of 128 minima, each cut to 16
bits.  It is split in 26 chunks.  Two signatures that differ in at most 51
places differ in at most one place of some chunk, by the pigeonhole principle;
so with every chunk's keys under one wildcard place (one enumerated error), all
such pairs meet.  Links are then confirmed on the full sets.  At a similarity of
0.75, 51 is four standard deviations above the mean distance, so a link is
missed with a probability of about 3 in 100,000, less for closer pairs.

No bucket emits all its pairs.  Equal sets are one class.  First each class is
compared with its least candidate, which joins most of a group of copies.  Then
only buckets that still hold several components are searched, by signature
distance in blocks of bounded size, for pairs of different components.

Defined cases: a text with fewer words than a shingle is one shingle, its whole
sequence; one without words, or null, is empty and linked with nothing; null
ids and repeated ids are told apart by their texts, and a component's id is its
least id that isn't null; repeated rows are one class; an empty table gives no
row; extra columns are ignored or, by ``keep_first``, kept.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._graph import components
from ._repeats import whole_groups
from ._state import checkpoint, drop, unused

PLACES, CHUNKS = 128, 26
#: Distance up to which all pairs meet.
FAR = 2 * CHUNKS - 1
#: Distance up to which a nearest neighbour is tried before all pairs: most links are within it.
NEAR = 38
#: First place of each chunk.
STARTS = np.array([x[0] for x in np.array_split(np.arange(PLACES), CHUNKS)])


@cache
def multipliers() -> np.ndarray:
    return V.mix(np.arange(1, PLACES + 1, dtype=V.U64) * V.U64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted, and row offsets into them."""
    buf = V.LOWER[buf]
    s, e, rows = V.words(buf, off)
    count = np.diff(rows)
    if not len(s):
        return np.empty(0, V.U64), np.zeros(len(off), np.int64)
    h = V.prefix(V.spans(V.prefix(buf), s, e))
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(s))
    inside = at - rows[row]
    # a short row's one shingle is its whole sequence
    pick = (inside + size <= count[row]) | ((inside == 0) & (count[row] < size))
    at, row = at[pick], row[pick]
    hashes = V.spans(h, at, at + np.minimum(size, count[row]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(count) + 1)).astype(np.int64)


def signatures(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """uint16 minima by row; rows without shingles are left out."""
    full = rows[:-1][np.diff(rows) > 0]
    out = np.empty((len(full), PLACES), np.uint16)
    if len(full):
        x = (hashes >> V.U64(32)).astype(np.uint32)
        for k, a in enumerate(multipliers()):
            low = np.minimum.reduceat(x * a, full)
            low ^= low >> np.uint32(16)
            out[:, k] = low * np.uint32(0x45D9F3B) >> np.uint32(16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """By signature, a 64-bit key for each wildcard place, over the other places of its chunk; its low bits name the place."""
    out = []
    for part in np.array_split(np.arange(PLACES), CHUNKS):
        value = V.mix(sig[:, part].astype(V.U64) + part.astype(V.U64) * V.U64(1 << 20))
        total = value.sum(axis=1, dtype=V.U64)
        for k, w in enumerate(part.tolist()):
            key = V.mix(total - value[:, k] + V.U64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            out.append(key & V.U64(~(PLACES - 1) & (1 << 64) - 1) | V.U64(w))
    return np.stack(out, axis=1)


def meeting_place(differ: np.ndarray) -> np.ndarray:
    """For rows of places in which two signatures differ, the one wildcard place whose bucket answers for the pair:
    in the first chunk with one difference at most, that difference, or the first place where there is none."""
    few = np.add.reduceat(differ.astype(np.uint8), STARTS, axis=1) <= 1
    lo = STARTS[few.argmax(axis=1)]
    hi = np.append(STARTS, PLACES)[few.argmax(axis=1) + 1]
    at = np.arange(PLACES)
    own = differ & (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(own.any(axis=1), own.argmax(axis=1), lo)


def _sign(size: int):
    def run(batches):
        for block in V.blocks(batches, "text"):
            hashes, rows = shingles(*V.buffer(V.col(block, "text")), size)
            n = np.diff(rows)
            total = np.concatenate([np.zeros(1, V.U64), np.cumsum(V.mix(hashes), dtype=V.U64)])
            cls = V.signed(V.mix((total[rows[1:]] - total[rows[:-1]]) ^ V.mix(n.astype(V.U64))))
            sig = signatures(hashes, rows)
            load = np.full(len(n), None, dtype=object)
            load[n > 0] = [x.tobytes() for x in sig]
            yield pa.RecordBatch.from_arrays([V.col(block, "id"), pa.array(n), pa.array(cls), pa.array(load, pa.binary())], ["id", "n_shingles", "cls", "sig"])

    return run


def _keys(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            sig = np.frombuffer(b"".join(V.col(part, "sig").to_pylist()), np.uint16).reshape(-1, PLACES)
            keys = chunk_keys(sig)
            node = np.repeat(V.col(part, "node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(V.signed(keys.reshape(-1))), pa.array(node)], ["key", "node"])


def _buckets(batches):
    """Rows of keys that more than one node has, with the least of them."""
    last = first = None  # the key that the last batch ended in, and its first node
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = V.col(batch, "key").to_numpy(), V.col(batch, "node").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is None or key[0] != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lead = np.where(at >= 0, node[np.maximum(at, 0)], first if first is not None else 0)
        follows = ~new
        out_key, out_node, out_lead = [], [], []
        more = np.append(follows[1:], False)
        if held is not None and follows[0]:
            out_key.append([held[0]]), out_node.append([held[1]]), out_lead.append([held[1]])
        pick = follows | (new & more)
        out_key.append(key[pick]), out_node.append(node[pick]), out_lead.append(lead[pick])
        held = (key[-1], node[-1]) if new[-1] else None  # it may yet get company
        last, first = key[-1], lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_key, out_node, out_lead)], ["key", "node", "lead"])


def _mixed(block: int):
    """Of buckets with several components, the rows, dealt to pairs of blocks where there are many."""

    def run(batches):
        for b in whole_groups(batches, ("key",)):
            if not b.num_rows:
                continue
            key, node, comp, tested = (V.col(b, c).to_numpy(zero_copy_only=False) for c in ("key", "node", "comp", "tested"))
            new = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(new) - 1
            lo = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            hi = np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(lo, group, comp)
            np.maximum.at(hi, group, comp)
            size = np.bincount(group)
            # two nodes whose pair has been looked at already
            pair = np.flatnonzero(new)[size == 2]
            done = np.zeros(len(size), dtype=bool)
            done[size == 2] = (tested[pair + 1] == node[pair]) | (tested[pair] == node[pair + 1])
            keep = np.flatnonzero((lo < hi)[group] & ~done[group])
            parts = -(-size // block)
            n = parts[group[keep]]
            own = (V.mix(node[keep].view(V.U64)) % n.astype(V.U64)).astype(np.int64)
            rows = np.repeat(keep, n)
            other, mine = V.ragged(np.zeros(len(n), np.int64), n), np.repeat(own, n)
            a, z = np.minimum(mine, other), np.maximum(mine, other)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(a * (1 << 31) + z), pa.array(mine != a), pa.array(a != z), pa.array(node[rows]), pa.array(comp[rows])], ["key", "pair", "second", "cross", "node", "comp"])

    return run


def _sets(size: int):
    """Sets of shingles, each cut to 32 bits."""

    def run(batches):
        for block in V.blocks(batches, "text"):
            hashes, rows = shingles(*V.buffer(V.col(block, "text")), size)
            low = (hashes >> V.U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([V.col(block, "id"), pa.array([low[x:y].tobytes() for x, y in zip(rows[:-1], rows[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return run


def _near(share: int):
    """Pairs of different components within the signature distance whose sets, cut to 32 bits, are alike enough.

    Each pair is looked at in one bucket only (see ``meeting_place``), and only likely links leave the task."""

    def run(batches):
        for b in whole_groups(batches, ("key", "pair")):
            if not b.num_rows:
                continue
            key, pair, second, cross, node, comp, n = (V.col(b, c).to_numpy(zero_copy_only=False) for c in ("key", "pair", "second", "cross", "node", "comp", "n_shingles"))
            sig = np.frombuffer(b"".join(V.col(b, "sig").to_pylist()), np.uint16).reshape(-1, PLACES)
            raw, off = V.buffer(V.col(b, "shingles"))
            elements, off = raw.view(np.uint32), off // 4
            edge = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))), len(key))
            us, vs = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                names = None
                place = int(key[lo]) & (PLACES - 1)
                for i in range(lo, hi):
                    if cross[i] and second[i]:
                        continue
                    j = np.arange(lo, hi) if cross[i] else np.arange(i + 1, hi)
                    ok = comp[j] != comp[i]
                    if cross[i]:
                        ok &= second[j]
                    ok &= (100 * n[j] >= share * n[i]) & (100 * n[i] >= share * n[j])
                    j = j[ok]
                    if not len(j):
                        continue
                    differ = sig[j] != sig[i]
                    near = differ.sum(axis=1) <= FAR
                    near[near] = meeting_place(differ[near]) == place
                    j = j[near]
                    if not len(j):
                        continue
                    if names is None:
                        distinct, names = np.unique(elements[off[lo] : off[hi]], return_inverse=True)
                        base = off[lo]
                    mark = np.zeros(len(distinct), np.int64)
                    mark[names[off[i] - base : off[i + 1] - base]] = 1
                    size = off[j + 1] - off[j]
                    same = np.add.reduceat(mark[names[V.ragged(off[j] - base, size)]], np.cumsum(size) - size)
                    j = j[100 * same >= share * (n[i] + n[j] - same)]
                    us.append(np.maximum(node[j], node[i]))
                    vs.append(np.minimum(node[j], node[i]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _nearest(share: int):
    """Of each node, the nearest one of another component, if near, among those not looked at before."""

    def run(batches):
        for b in whole_groups(batches, ("key", "pair")):
            if not b.num_rows:
                continue
            key, pair, second, cross, node, comp, n = (V.col(b, c).to_numpy(zero_copy_only=False) for c in ("key", "pair", "second", "cross", "node", "comp", "n_shingles"))
            sig = np.frombuffer(b"".join(V.col(b, "sig").to_pylist()), np.uint16).reshape(-1, PLACES)
            seen = V.col(b, "seen").to_pylist()
            edge = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))), len(key))
            best: dict[int, tuple[int, int]] = {}
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                for i in range(lo, hi):
                    j = np.arange(lo, hi)
                    ok = (comp[j] != comp[i]) & (100 * n[j] >= share * n[i]) & (100 * n[i] >= share * n[j])
                    if cross[i]:
                        ok &= second[j] != second[i]
                    for x in seen[i] or ():
                        ok &= node[j] != x
                    j = j[ok]
                    if not len(j):
                        continue
                    differ = sig[j] != sig[i]
                    d = differ.sum(axis=1)
                    own = d <= NEAR
                    own[own] = meeting_place(differ[own]) == int(key[lo]) & (PLACES - 1)  # each pair in one bucket only
                    j, d = j[own], d[own]
                    if len(j):
                        k = int(np.argmin(d))  # the least node of those as near
                        u = int(node[i])
                        if (int(d[k]), int(node[j[k]])) < best.get(u, (FAR + 1, 0)):
                            best[u] = (int(d[k]), int(node[j[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([x[0] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()], pa.int64())], ["u", "far", "v"])

    return run


def _confirm(size: int, share: int):
    """Pairs whose full sets have ``100 * intersection >= share * union``."""

    def run(batches):
        for batch in batches:
            for block in V.blocks(V.blocks([batch], "text_u"), "text_v"):
                hu, ru = shingles(*V.buffer(V.col(block, "text_u")), size)
                hv, rv = shingles(*V.buffer(V.col(block, "text_v")), size)
                nu, nv = np.diff(ru), np.diff(rv)
                row = np.concatenate([np.repeat(np.arange(len(nu)), nu), np.repeat(np.arange(len(nv)), nv)])
                h = np.concatenate([hu, hv])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(nu)) if len(h) else np.zeros(len(nu), np.int64)
                ok = (100 * same >= share * (nu + nv - same)) & (nu > 0) & (nv > 0)
                yield block.filter(pa.array(ok)).select(["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """The links among pairs (u, v); ``texts`` has id and text."""
    with_u = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
    with_both = with_u.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    return with_both.select("u", "v", "text_u", "text_v").mapInArrow(V.tidy(_confirm(size, share)), "u long, v long").distinct()


def row_id(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id where it tells all rows apart, else a hash of it and the text."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    doubtful = ids.where("doc_id is null").limit(1).count() or ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    own = F.col(id_col).cast("long")
    return F.xxhash64(own, F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if doubtful else own


def identified(docs: DataFrame, id_col: str, text_col: str, own: Column | None = None) -> DataFrame:
    """doc_id, text and ``id`` (see ``row_id``, which may be given)."""
    own = row_id(docs, id_col, text_col) if own is None else own
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), own.alias("id"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 75, block: int = 1024, rounds: int = 1) -> DataFrame:
    """doc_id, id, n_shingles, component_id and kept of every row.

    ``share`` is the similarity in percent, ``block`` the most rows of a bucket
    that are compared in one piece, ``rounds`` how often nearest neighbours are
    tried before all pairs that are left.
    """
    rows = identified(docs, id_col, text_col)
    signed = checkpoint(rows.select("id", "text").mapInArrow(V.tidy(_sign(size)), "id long, n_shingles long, cls long, sig binary"))
    classes = checkpoint(signed.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n_shingles")))
    keyed = classes.select("node", "sig").mapInArrow(V.tidy(_keys), "key long, node long")
    # few of the keys' rows are left: dealt anew, they go to no more files than they fill
    buckets = checkpoint(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(V.tidy(_buckets), "key long, node long, lead long").hint("rebalance"))
    stars = checkpoint(buckets.where("node <> lead").groupBy("node").agg(F.min("lead").alias("lead")))
    wanted = buckets.select("node").distinct()
    texts = rows.select("id", "text").join(wanted.withColumnRenamed("node", "id"), "id", "left_semi").dropDuplicates(["id"])
    texts = checkpoint(texts.withColumn("text", F.encode("text", "utf-8")))
    links = checkpoint(_confirmed(stars.select(F.col("node").alias("u"), F.col("lead").alias("v")), texts, size, share))
    comps = components(links)
    tried = checkpoint(stars.select("node", F.array("lead").alias("seen")))

    def mixed() -> DataFrame:
        """Rows of the buckets that still hold several components."""
        state = buckets.select("key", "node").join(comps, "node", "left").join(stars, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"), F.coalesce("lead", F.lit(-(1 << 63))).alias("tested"))
        rows = state.repartition("key").sortWithinPartitions("key", "node").mapInArrow(V.tidy(_mixed(block)), "key long, pair long, second boolean, cross boolean, node long, comp long")
        return checkpoint(rows)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("node", "sig", "n_shingles"), "node").repartition("key", "pair").sortWithinPartitions("key", "pair", "node")

    # each node's nearest one of another component, a few times: this finds the common source of a group of copies
    for _ in range(rounds):
        open_rows = mixed()
        pairs = dealt(open_rows.join(tried, "node", "left")).mapInArrow(V.tidy(_nearest(share)), "u long, far long, v long").groupBy("u").agg(F.min(F.struct("far", "v")).alias("x")).select("u", F.col("x.v").alias("v"))
        pairs = checkpoint(pairs, open_rows)
        if pairs.isEmpty():
            break
        links = checkpoint(links.unionByName(_confirmed(pairs, texts, size, share)).distinct(), links)
        drop(comps)
        comps = components(links)
        tried = checkpoint(tried.unionByName(pairs.select(F.col("u").alias("node"), F.array("v").alias("seen"))).groupBy("node").agg(F.flatten(F.collect_list("seen")).alias("seen")), tried, pairs)
    # whatever is left: all pairs of different components within the distance
    rows_left = mixed()
    drop(buckets, stars, comps)
    sets = texts.join(rows_left.select(F.col("node").alias("id")).distinct(), "id", "left_semi").mapInArrow(V.tidy(_sets(size)), "node long, shingles binary")
    near = dealt(rows_left.join(sets, "node")).mapInArrow(V.tidy(_near(share)), "u long, v long").distinct()
    gone = tried.select("node", F.explode("seen").alias("x")).select(F.greatest("node", "x").alias("u"), F.least("node", "x").alias("v"))
    near = checkpoint(near.join(gone, ["u", "v"], "left_anti"), rows_left, tried)
    more = _confirmed(near, texts, size, share)
    final = components(links.unionByName(more), links, near, texts)
    # classes to components, then the least doc_id of each
    named = signed.join(classes.select("cls", "node"), "cls", "left").join(final, "node", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("comp"))
    named = named.dropDuplicates(["id"])
    flat = rows.select("doc_id", "id").join(named, "id")
    least = flat.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = flat.join(least, "comp", "left").withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return cluster(docs, **options).drop("id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that of least id, and all rows of no group, with all their columns."""
    key, name = unused(docs, "key", "gone")
    gone = cluster(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.col("id").alias(name)).distinct()
    return docs.withColumn(key, row_id(docs, id_col, text_col)).join(gone, F.col(key) == F.col(name), "left_anti").drop(key)
