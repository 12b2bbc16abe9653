"""N-gram Jaccard join by count vectors in packed R-trees.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least `percent`/100.

1. Each document gives its set's size n, a set hash, and the first n - ceil(n * percent/100) + 1 shingles in one
   total order. Two linked documents share one of these, so documents that share a key form blocks; nothing is lost.
   The order puts shingles that are frequent in a bounded sample of documents last, which keeps passages that many
   documents share out of the keys. The sample only steers the order: any sample gives the same links.
2. Equal sets collapse to one representative. Blocks become groups: (smallest document of the block, member), distinct.
3. Each group indexes its members' count vectors: shingles are hashed into G groups and counted (G grows with n; a
   vector folds to half its length by adding neighbours). Packed R-trees, sorted by size, are joined top-down: the
   overlap of two nodes is at most the sum of the coordinate minima of their upper corners, of two documents the sum of
   the minima of their counts. Members with no partner left are dropped. No texts move in this step.
4. Texts of the members that are left (a bitmap of their ids keeps most others out of the shuffle) go to their groups; surviving pairs of different components are verified on the
   exact sets (of 64-bit hashes). Each task returns a spanning forest: g copies give g - 1 links and never all pairs.
5. A group of more than `block` members, or `shingles` shingles, is dealt to several tasks, each with the group's
   smallest document. Near copies link with it or with one another, so a group mostly is one component then, and what
   is linked already need not be compared. Only the members outside of the group's largest component meet the members
   of other tasks: a second pass deals them as pairs of parts, so a group of g members with r of them outside costs
   about g * r / block rows and not g * g / block.
6. Components of the links, by min-label propagation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import U64, components, discard, lists, materialize, meet, mix64, shingle_sets, sift, slices, without

#: A count of this or more may be any number.
FULL = 65535


def _vector(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in G groups by their top bits; G is the power of two from 16 to 1024 next to n/8."""
    bits = min(10, max(4, int(np.ceil(np.log2(max(1, len(s)) / 8))) if len(s) > 8 else 4))
    return np.minimum(np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint16)


def _upper(v: np.ndarray) -> np.ndarray:
    """Upper bounds of the counts of a vector."""
    return np.where(v == FULL, 1 << 40, v.astype(np.int64)) if v.max(initial=0) == FULL else v


def _fold(v: np.ndarray, size: int) -> np.ndarray:
    return v.reshape(size, -1).sum(1) if len(v) > size else v


def _features(percent: int, k: int, late):
    def run(batches):
        import pyarrow as pa

        last = late.value
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            keys, vectors, sums = [], [], np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(last) and len(s):
                    slow = np.isin(s, last, assume_unique=True)
                    s = np.concatenate([s[~slow], s[slow]]) if slow.any() else s
                keys.append(s[:p])
                vectors.append(_vector(s).tobytes() if len(s) else b"")
                sums[i] = s.sum(dtype=np.uint64), mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), lists(flat, np.fromiter(map(len, keys), np.int64, len(keys))), pa.array(vectors, pa.binary())],
                ["doc_id", "n", "s1", "s2", "keys", "vector"])
    return run


def _sampled(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])
    return run


def _pairs(n: np.ndarray, vectors: list[np.ndarray], side: np.ndarray, cross: bool, percent: int, leaf: int = 32):
    """Arrays of index pairs that may link: a join of packed R-trees over the count vectors, cut by sizes and summed minima."""
    order = np.argsort(n, kind="stable")
    classes = np.array([len(vectors[i]) for i in order])
    for g in np.unique(classes):
        own = order[classes == g]
        tree = np.concatenate([own, order[classes == 2 * g]])  # sizes within a factor of 2 differ by one halving at most
        low = np.stack([_fold(_upper(vectors[i]), g) for i in tree])
        low = low.astype(np.int32 if low.max() < 1 << 31 else np.int64)
        sizes = n[tree]
        cuts = np.arange(0, len(tree), leaf)
        upper = np.maximum.reduceat(low, cuts, axis=0)
        least, most = np.minimum.reduceat(sizes, cuts), np.maximum.reduceat(sizes, cuts)
        nodes = np.arange(0, len(cuts), leaf)
        node_upper, node_least, node_most = np.maximum.reduceat(upper, nodes, axis=0), np.minimum.reduceat(least, nodes), np.maximum.reduceat(most, nodes)
        room = lambda small, large: 100 * large >= percent * small
        for x in range(-(-len(own) // leaf)):
            a, b = cuts[x], min(cuts[x] + leaf, len(own))
            if a >= len(own):
                break
            ups, lo, hi = upper[x], least[x], sizes[a:b].max()
            near = room(lo, node_most) & room(node_least, hi) & ((100 + percent) * np.minimum(ups, node_upper).sum(1) >= percent * (lo + node_least))
            for y in np.flatnonzero(near):
                at = np.arange(nodes[y], min(nodes[y] + leaf, len(cuts)))
                at = at[at >= x]
                at = at[room(lo, most[at]) & room(least[at], hi) & ((100 + percent) * np.minimum(ups, upper[at]).sum(1) >= percent * (lo + least[at]))]
                for z in at:
                    c, d = cuts[z], min(cuts[z] + leaf, len(tree))
                    both = np.minimum(low[a:b, None, :], low[None, c:d, :]).sum(2)
                    total = sizes[a:b, None] + sizes[None, c:d]
                    ok = ((100 + percent) * both >= percent * total) & (tree[c:d][None, :] != tree[a:b][:, None])
                    if z == x:
                        ok &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
                    i, j = np.nonzero(ok)
                    i, j = tree[a + i], tree[c + j]
                    if cross:
                        keep = side[i] != side[j]
                        i, j = i[keep], j[keep]
                    if len(i):
                        yield i, j


#: A member x of group g in task (i, j), from its part `side`, known to be in component c.
MEMBER = ("g", "i", "j", "x", "side", "c")


def _groups(batches, columns: list[str]):
    """Rows of one group after another (columns g, i, j sorted); each as a dict of lists."""
    held: dict[str, list] = {c: [] for c in columns}
    now = None
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in columns}
        ids = list(zip(data["g"], data["i"], data["j"], strict=True))
        begin = 0
        for at in range(1, len(ids) + 1):
            if at == len(ids) or ids[at] != ids[begin]:
                if now is not None and ids[begin] != now:
                    yield now, held
                    held = {c: [] for c in columns}
                now = ids[begin]
                for c in columns:
                    held[c] += data[c][begin:at]
                begin = at
    if now is not None:
        yield now, held


def _survivors(percent: int):
    def run(batches):
        import pyarrow as pa

        out: dict[str, list] = {c: [] for c in MEMBER}
        for (_, i, j), rows in _groups(batches, [*MEMBER, "n", "vector"]):
            vectors = [np.frombuffer(v, np.uint16) for v in rows["vector"]]
            known, live = np.array(rows["c"]), np.zeros(len(vectors), bool)
            for a, b in _pairs(np.array(rows["n"]), vectors, np.array(rows["side"]), i != j, percent):
                new = known[a] != known[b]
                live[a[new]] = live[b[new]] = True
            for p in np.flatnonzero(live):
                for c in MEMBER:
                    out[c].append(rows[c][p])
            if len(out["g"]) > 5000:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
                out = {c: [] for c in out}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return run


def _links(percent: int, k: int):
    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        for (_, i, j), rows in _groups(batches, [*MEMBER, "text"]):
            sets = shingle_sets(rows["text"], k)
            x, n = rows["x"], np.fromiter(map(len, sets), np.int64, len(sets))
            label = np.unique(rows["c"], return_inverse=True)[1]
            for some, others in _pairs(n, [_vector(s) for s in sets], np.array(rows["side"]), i != j, percent):
                for a, b in zip(some.tolist(), others.tolist(), strict=True):
                    if label[a] == label[b]:
                        continue
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        label[label == label[b]] = label[a]
                        out.append((x[a], x[b]))
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
                out = []
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return run


def frequent_shingles(docs: DataFrame, k: int, sample_docs: int, share: float) -> np.ndarray:
    """Shingles in at least `share` of a seeded sample of about sample_docs documents: at most mean set size / share of them."""
    total = docs.count()
    part = docs if total <= sample_docs else docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_docs / total))
    least = max(8, int(share * min(total, sample_docs)))
    found = part.select("text").mapInArrow(_sampled(k), "h long").groupBy("h").count().where(F.col("count") >= least).select("h")
    return np.sort(np.array([r.h for r in found.collect()], np.int64).view(np.uint64))


def _parts(n: str, weight: str, block: int, shingles: int):
    return F.ceil(F.greatest(F.col(n) / block, F.col(weight) / shingles)).cast("int")


def linked(docs: DataFrame, percent: int = 85, k: int = 4, block: int = 1000, shingles: int = 2_000_000, sample_docs: int = 20_000, share: float = 0.002) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of docs (doc_id, text).

    n_shingles: size of the set of k-word shingles. component_id: the smallest doc_id that links reach, itself included.
    A null or empty text has no shingles and no links; a row without doc_id links with nothing and has a null component;
    rows of one doc_id are one document for links; an empty table gives no rows. block and shingles bound what a task
    compares at a time (one document at least) and change no result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = spark.sparkContext.broadcast(frequent_shingles(docs, k, sample_docs, share))
    t = materialize(docs.mapInArrow(_features(percent, k, late), "doc_id long, n long, s1 long, s2 long, keys array<long>, vector binary"), "features")
    own = t.where("n > 0 and doc_id is not null")
    sets = materialize(own.groupBy("s1", "s2").agg(F.min("doc_id").alias("x"), F.count("*").alias("_copies")), "sets")
    heads = own.join(sets.select(F.col("x").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"])
    heads = materialize(heads.select(F.col("doc_id").alias("x"), "n", "keys", "vector"), "heads")
    posts = heads.select("x", F.explode("keys").alias("key"))
    keys = materialize(posts.groupBy("key").agg(F.min("x").alias("g"), F.count("*").alias("_n")).where("_n > 1"), "keys")
    members = meet(sift(posts, keys, "key"), keys, ["key"], "_n", ["x"]).select("g", "x").distinct().join(heads.groupBy("x").agg(F.max("n").alias("_w")), "x")
    members = materialize(members, "members")
    groups = members.groupBy("g").agg(F.count("*").alias("_n"), F.sum("_w").alias("_weight"))
    groups = materialize(groups.select("g", "_n", _parts("_n", "_weight", block, shingles).alias("_m")), "groups")
    side = F.pmod(F.xxhash64("x"), F.col("_m"))
    dealt = meet(members, groups, ["g"], "_n", ["x"]).select("g", "x", "_m", side.alias("side"))
    first = dealt.where("x = g and _m > 1").select("g", "x", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_o"), F.col("side").alias("_s")).where("_o <> _s")
    dealt = dealt.select("g", "x", "side").unionByName(first.select("g", "x", F.col("_o").cast("long").alias("side")))
    dealt = dealt.select("g", F.col("side").alias("i"), F.col("side").alias("j"), "x", "side", F.col("x").alias("c"))

    def verified(dealt: DataFrame) -> DataFrame:
        with_vectors = dealt.join(heads.select("x", "n", "vector"), "x").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        alive = materialize(with_vectors.select(*MEMBER, "n", "vector").mapInArrow(_survivors(percent), ", ".join(f"{c} long" for c in MEMBER)), "alive")
        ids = materialize(alive.select(F.col("x").alias("doc_id")).distinct(), "ids")
        texts = sift(docs.where("doc_id is not null"), ids, "doc_id").join(ids, "doc_id").withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"])
        with_texts = alive.join(texts.select(F.col("doc_id").alias("x"), "text"), "x").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
        found = materialize(with_texts.select(*MEMBER, "text").mapInArrow(_links(percent, k), "a long, b long"), "links")
        discard(alive, ids)
        return found

    links = verified(dealt)
    repeated = _repeated(own, sets)
    if repeated is not None:
        links = materialize(links.unionByName(repeated), "links")
    comp = components(links)
    if groups.where("_m > 1").limit(1).count():
        more = verified(_apart(members, groups, comp, block, shingles))
        comp = components(links.unionByName(more))
        discard(more)
    discard(links, keys, members, groups, heads)
    # an empty set links with nothing; equal sets share their representative
    whole = sets.join(comp.withColumnRenamed("node", "x"), "x", "left").select("s1", "s2", "_copies", F.coalesce("component", "x").alias("component_id"))
    out = meet(own.select("doc_id", "n", "s1", "s2"), materialize(whole, "whole"), ["s1", "s2"], "_copies", ["doc_id"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = t.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def _repeated(own: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(a, b): edges between the representatives of the sets that rows of one doc_id have; None where each id has one set."""
    several = own.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi"), F.count("*").alias("_n")).where("lo <> hi").select("doc_id", "_n")
    several = materialize(several, "several")
    if not several.limit(1).count():
        return None
    each = meet(own.select("doc_id", "s1", "s2"), several, ["doc_id"], "_n", ["s1", "s2"]).distinct()
    each = materialize(meet(each, sets.select("s1", "s2", "x", "_copies"), ["s1", "s2"], "_copies", ["doc_id"]).select("doc_id", "x").distinct(), "each")
    first = materialize(each.groupBy("doc_id").agg(F.min("x").alias("a"), F.count("*").alias("_n")), "first")
    return meet(each, first, ["doc_id"], "_n", ["x"]).select("a", F.col("x").alias("b")).where("a <> b").distinct()


def _apart(members: DataFrame, groups: DataFrame, comp: DataFrame, block: int, shingles: int) -> DataFrame:
    """Tasks for the groups in several parts: each member outside of its group's largest component with all members of other components."""
    several = materialize(groups.where("_m > 1").select("g", "_n"), "several")
    held = meet(members, several, ["g"], "_n", ["x"]).join(comp.withColumnRenamed("node", "x"), "x", "left")
    held = materialize(held.select("g", "x", "_w", F.coalesce("component", "x").alias("c")), "labelled")
    each = held.groupBy("g", "c").agg(F.count("*").alias("_k"), F.sum("_w").alias("_v"))
    group = each.groupBy("g").agg(F.max(F.struct("_k", "c", "_v")).alias("_top"), F.count("*").alias("_several"), F.sum("_k").alias("_n"), F.sum("_v").alias("_all")).where("_several > 1")
    group = group.select("g", "_n", F.col("_top.c").alias("_main"), F.col("_top._k").alias("_k"), F.col("_top._v").alias("_v"), (F.col("_n") - F.col("_top._k")).alias("_r"), (F.col("_all") - F.col("_top._v")).alias("_u"))
    group = materialize(group.select("g", "_n", "_main", _parts("_r", "_u", block, shingles).alias("_rest"), _parts("_k", "_v", block, shingles).alias("_most")), "apart")
    dealt = meet(held, group, ["g"], "_n", ["x"]).withColumn("_out", F.col("c") != F.col("_main"))
    side = F.when(F.col("_out"), F.pmod(F.xxhash64("x"), F.col("_rest"))).otherwise(F.col("_rest") + F.pmod(F.xxhash64("x"), F.col("_most")))
    last = F.when(F.col("_out"), F.col("_rest") + F.col("_most")).otherwise(F.col("_rest")) - 1
    dealt = dealt.withColumn("side", side).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return dealt.select("g", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), "x", "side", "c")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """Of each group of linked documents (and of copies), the row with the smallest doc_id; all rows without links stay.

    Of rows with the same doc_id that of the least MD5 of its text stays; rows without doc_id all stay.
    """
    found = materialize(linked(docs, **options).where("doc_id is not null"), "linked")
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    copies = found.where("component_id <> doc_id").select("doc_id")
    alone = without(docs, copies.unionByName(repeated))
    # one row of each id that repeats is put back, the same whatever the order: a minimum, combined before the shuffle
    once = docs.join(repeated.join(copies, "doc_id", "left_anti"), "doc_id", "left_semi")
    key = F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"), F.xxhash64(*docs.columns).alias("h"))
    return alone.unionByName(once.groupBy(F.col("doc_id").alias("_leadspark_id")).agg(F.min_by(F.struct(*docs.columns), key).alias("_leadspark_row")).select("_leadspark_row.*"))
