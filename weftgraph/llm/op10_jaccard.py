"""n-gram Jaccard join by PartEnum signatures, and the components that its links make.

Sets of like size form instances: with bands I(i) = [l, 4l/3], instance i holds the pairs of I(i)
with I(i) and I(i+1). Two sets of it that are similar enough differ in at most k elements. The domain
of shingles is partitioned in two levels: into more than k/2 groups, so that some group holds at most
one element that differs, and each group into 3 cells, so that two of its cells hold none. A set's
signatures are its shares of every subset of 2 of the 3 cells of every group; two similar sets have
one in common. Shares that are empty say nothing and are left out: where two sets agree on nothing
else, most of their shares are empty or differ, and just for such sets the shingles of a prefix (in
the order of hashes, a quarter of the set) are signatures too. So no similar pair is missed. Equal
sets are one node from the start.

Signatures travel packed, some ten bytes each, in as many buckets as their number asks for. Sets that
share one in a small group become candidate pairs. A large group (a passage that many texts share)
makes none: a set with more signatures outside large groups than may change finds all its partners
there. The few sets that are left open get finer signatures, where a passage weighs less, and what
then is still open is mostly copies of one text: they are compared with a leader of each group, some
turns, and then with each other across the components that this has left, in blocks dealt to tasks.
Sizes and bitmaps of parities rule out most pairs by an exact bound; the rest are checked on their sets.

Components need no link within what is joined already, but numbers of links do. Every similar pair that
no small group has met is of two sets left open, and of one component: so a component's open sets are
compared with each other, blocks of them at once by products of matrices, and only counts come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import chunks, discard, free_names, kind_of, likely, mapped, prepare, schema_of, stored, table, utf8
from weftgraph.llm.components import components
from weftgraph.llm.shingles import mix, set_names, shingle_sets

WORDS, NUM, DEN = 5, 75, 100
#: Subsets of a group's three cells that make its signatures.
SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Groups for each element that may differ, on the first pass and on the second, over sets that the first leaves open. 0.5 is the least.
SPARE = (0.6, 2.0)
#: Groups up to this size give all their pairs at once.
SMALL = 12
#: Leaders that the groups of one large cluster have between them, and turns with other leaders.
LEADERS, TURNS = 32, 2
#: Bytes of text whose sets are made at once, and whose signatures are packed together.
AT_ONCE = 1 << 20
PACK = 2 << 20
#: Sets of a block of open sets, and their shingles, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 17
#: Bytes of packed signatures in a bucket, and about how many a shingle has on each pass.
BUCKET, PER_SHINGLE = 8 << 20, (11, 36)


def band_edges(top: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Smallest sizes of the bands up to one that holds top, and of one more."""
    out = [1]
    while out[-1] <= top or len(out) < 3:
        out.append(out[-1] * den // num + 1)
    return np.array([*out, out[-1] * den // num + 1])


def instance(i: int, edges: np.ndarray, spare: float, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """How many signatures of one of two similar sets of instance i may not be the other's, and the number of groups.

    An element that differs changes one cell: the first of a group changes two of its subsets, the second the third.
    """
    most = int(edges[i + 1]) - 1 + int(edges[i + 2]) - 1  # of the two sizes together
    differ = max(0, *(s - 2 * -(-num * s // (num + den)) for s in range(max(2, most - 16), most + 1)))
    groups = int(np.ceil(spare * (differ + 1)))
    return 2 * min(differ, groups) + max(0, differ - groups), groups


def cells(doc: np.ndarray, h: np.ndarray, n: int, level: int, num: int = NUM, den: int = DEN):
    """For each instance: (number, salt, how many signatures may change, its texts, their shingles d and x, texts x groups x 3 shares).

    A cell's share is a sum over the hashes in it; 0 if there are none.
    """
    size = np.bincount(doc, minlength=n)
    edges = band_edges(int(size.max(initial=1)), num, den)
    band = np.searchsorted(edges, size, side="right") - 1
    for i in range(int(band.max(initial=-1)) + 1):
        chosen = ((band == i) | (band == i + 1)) & (size > 0)
        if not chosen.any():
            continue
        rows = chosen[doc]
        d, x = doc[rows], h[rows]
        changed, groups = instance(i, edges, SPARE[level], num, den)
        salt = np.uint64((2 * i + level + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
        texts = np.flatnonzero(chosen)
        cell = ((x >> np.uint64(32)) * np.uint64(3 * groups) >> np.uint64(32)).astype(np.int64)  # ascending, as x is within a text
        at = np.searchsorted(texts, d) * 3 * groups + cell
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        share = np.zeros(len(texts) * groups * 3, np.uint64)
        share[at[cut]] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), cut) | np.uint64(1)
        yield i, salt, changed, texts, d, x, share.reshape(len(texts), groups, 3)


def spare_shares(doc: np.ndarray, h: np.ndarray, n: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text and parity of instances: its signatures less how many of them may change.

    If fewer than that many of a set's signatures are in large groups, more of the others remain than may
    change; so every similar set shares one of those, and the large groups can do without this set.
    """
    out = np.zeros((2, n), np.int64)
    for i, _, changed, texts, _, _, share in cells(doc, h, n, level):
        full = share != 0
        out[i & 1][texts] = sum((full[:, :, a] | full[:, :, b]).sum(axis=1) for a, b in SUBSETS) - changed
    return out[0], out[1]


def signatures(doc: np.ndarray, h: np.ndarray, n: int, level: int = 0, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(doc, signature) of n texts' sets; doc and h as shingle_sets gives them. The lowest bit is the instance's parity."""
    size = np.bincount(doc, minlength=n)
    out_doc, out_sig = [], []
    for i, salt, changed, texts, d, x, share in cells(doc, h, n, level, num, den):
        parity, full = np.uint64(i & 1), np.zeros(len(texts), np.int64)
        for k, (a, b) in enumerate(SUBSETS):
            row, group = np.nonzero((share[:, :, a] != 0) | (share[:, :, b] != 0))
            full += np.bincount(row, minlength=len(texts))
            both = mix(share[row, group, a]) + share[row, group, b] * np.uint64(0x9E3779B97F4A7C15)
            out_doc.append(texts[row])
            out_sig.append(mix(both + salt + mix((group * 3 + k).astype(np.uint64))) & ~np.uint64(1) | parity)
        lacking = np.zeros(n, bool)  # the empty shares may be all that a pair agrees on
        lacking[texts] = full <= changed
        if lacking.any():
            rows = lacking[d]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            rank = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
            rows &= rank < (size - -(-num * size // den) + 1)[d]
            out_doc.append(d[rows])
            out_sig.append(mix(x[rows] + salt + np.uint64(0x2545F4914F6CDD1D)) & ~np.uint64(1) | parity)
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def odd_sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set a bitmap of parities: bit b says whether an odd number of its hashes end in b.

    An element in just one of two sets turns one bit, so sketches differ in at most as many bits as
    the sets in elements. A bitmap has some four bits an element; the wider of two is folded to compare.
    """
    out = []
    ends = np.searchsorted(doc, np.arange(len(size) + 1))
    for k, n in enumerate(size.tolist()):
        bits = 64
        while bits < 4 * n:
            bits *= 2
        odd = np.bincount((h[ends[k] : ends[k + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def sketch_distance(x: bytes, y: bytes) -> int:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


NAMED = ["doc_id", "n_shingles", "node", "sketch", "spare_0_0", "spare_0_1", "spare_1_0", "spare_1_1"]


def _name_batches(batches, words: int):
    for batch in batches:
        texts = batch.column("data").to_pylist()
        for a, b in chunks([len(t) for t in texts], AT_ONCE):
            doc, h = shingle_sets(texts[a:b], words)
            size, name = set_names(doc, h, b - a)
            spare = [pa.array(x, pa.int32()) for level in (0, 1) for x in spare_shares(doc, h, b - a, level)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(odd_sketches(doc, h, size), pa.binary()), *spare], names=NAMED
            )


def _pack_batches(batches, words: int, buckets: int, level: int):
    for batch in batches:
        texts = batch.column("data").to_pylist()
        for a, b in chunks([len(t) for t in texts], PACK):
            doc, h = shingle_sets(texts[a:b], words)
            _, name = set_names(doc, h, b - a)
            nodes, code = np.unique(name, return_inverse=True)
            owner, sig = signatures(doc, h, b - a, level)
            owner, bucket = code[owner], (sig >> np.uint64(48)) % np.uint64(buckets)
            order = np.lexsort((sig, bucket))
            owner, sig, bucket = owner[order].astype("<u4"), sig[order], bucket[order]
            wide = 2 if len(nodes) < 1 << 16 else 4
            names, refs, sigs, keys = [], [], [], []
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(sig) else np.zeros(0, int)
            for p, q in zip(cuts, np.append(cuts[1:], len(sig))):
                own, ref = np.unique(owner[p:q], return_inverse=True)
                names.append(nodes[own].astype("<i8").tobytes())
                refs.append(ref.astype(f"<u{wide}").tobytes())
                low = sig[p:q] & np.uint64(0xFFFFFFFFFFFF)
                sigs.append((low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("<u2").tobytes())
                keys.append(int(bucket[p]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([wide] * len(keys), pa.int32()), pa.array(names, pa.binary()), pa.array(refs, pa.binary()), pa.array(sigs, pa.binary())], names=["bucket", "wide", "names", "refs", "sigs"])


def grouped_candidates(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) pairs of nodes that share a signature in a small group, once each; (signature, node) of large groups."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
    count = np.diff(np.append(first, len(sig)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL + 1):
        at = first[count == m]
        for i in range(m):
            for j in range(i + 1, m):
                a.append(node[at + i])
                b.append(node[at + j])
    rows = np.repeat(count > SMALL, count)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], sig[rows].view(np.int64), node[rows]


def _bucket_candidates(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sig, node = [], []
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["refs"]) // row["wide"]
            low = np.frombuffer(row["sigs"], "<u4", n).astype(np.uint64) | np.frombuffer(row["sigs"], "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
            sig.append(low)
            node.append(np.frombuffer(row["names"], "<i8")[np.frombuffer(row["refs"], f"<u{row['wide']}")])
    a, b, s, m = grouped_candidates(np.concatenate(sig), np.concatenate(node))
    s = s ^ np.int64(key[0].as_py()) << np.int64(48)
    kind = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(s), np.int32)])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a, s])), pa.array(np.concatenate([b, m]))], names=["kind", "a", "b"])


def _set_batches(batches, words: int):
    for batch in batches:
        texts = batch.column("data").to_pylist()
        for a, b in chunks([len(t) for t in texts], AT_ONCE):
            doc, h = shingle_sets(texts[a:b], words)
            own = batch.column("node").slice(a, b - a)
            # another row of the same id has other shingles
            same = set_names(doc, h, b - a)[1] == own.to_numpy(zero_copy_only=False)
            ends = np.searchsorted(doc, np.arange(b - a + 1))
            out = pa.RecordBatch.from_arrays([own, pa.array([h[p:q].tobytes() for p, q in zip(ends, ends[1:])], pa.binary())], names=["node", "hashes"])
            yield out.filter(pa.array(same))


def _verify_batches(batches, num: int, den: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(den * shared >= num * (len(both) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near_batches(batches, num: int, den: int):
    for batch in batches:
        keep = []
        for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n"))):
            differ = m + n - 2 * -(-num * (m + n) // (num + den))
            keep.append(abs(m - n) <= differ and sketch_distance(x, y) <= differ)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _on_both(pairs: DataFrame, sides: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """pairs with columns of the table sides (node, ...) for a and for b."""
    left = sides.select(F.col("node").alias("a"), *[F.col(c).alias(names[0]) for c, names in columns.items()])
    right = sides.select(F.col("node").alias("b"), *[F.col(c).alias(names[1]) for c, names in columns.items()])
    return pairs.join(right, "b").join(left, "a")


def _sets_of(stands: DataFrame, data: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of stands (node, doc_id), made again from the texts."""
    right = stands.withColumnRenamed("doc_id", "id")
    texts = likely(data, stands.select("doc_id"), "doc_id").join(right, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "data")
    return mapped(texts, partial(_set_batches, words=words), "node long, hashes binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, data: DataFrame, words: int) -> DataFrame:
    """The pairs whose sets are similar enough.

    Sizes and sketches (a tenth of a set) rule out pairs that differ in too much. The sets of those
    left are made again from the texts and compared.
    """
    near = _on_both(pairs, nodes, {"sketch": ("x", "y"), "n_shingles": ("m", "n")})
    near = stored(mapped(near, partial(_near_batches, num=NUM, den=DEN), "a long, b long"), "jaccard-near")
    if near.isEmpty():
        return near
    asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stands = stored(nodes.join(asked, "node", "left_semi").select("node", "doc_id"), "jaccard-stands")
    sets = stored(_sets_of(stands, data, words), "jaccard-sets")
    both = _on_both(near, sets, {"hashes": ("x", "y")})
    good = stored(mapped(both, partial(_verify_batches, num=NUM, den=DEN), "a long, b long"), "jaccard-verified")
    discard(near, stands, sets)
    return good


def near_pairs(node: np.ndarray, component: np.ndarray, size: np.ndarray, block: np.ndarray, sketches: list[bytes], num: int = NUM, den: int = DEN) -> Iterator[np.ndarray]:
    """Pairs of nodes of different components whose sizes and sketches don't rule them out, some rows at a time.

    The nodes are those of one block of a group, or of two blocks, between which the pairs are then.
    """
    width = min(len(x) for x in sketches)
    rows = []
    for x in sketches:
        p = np.frombuffer(x, np.uint64)
        while 8 * len(p) > width:
            p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        rows.append(p)
    bits = np.stack(rows)
    two = block.min() != block.max()
    step = max(1, (1 << 18) // len(node))
    for k in range(0, len(node), step):
        both = size[k : k + step, None] + size[None, :]
        differ = both - 2 * -(-num * both // (num + den))
        near = (component[k : k + step, None] != component[None, :]) & (node[k : k + step, None] < node[None, :]) & (np.abs(size[k : k + step, None] - size[None, :]) <= differ)
        if two:
            near &= block[k : k + step, None] != block[None, :]
        i, j = np.nonzero(near)
        some = max(1, (1 << 20) // bits.shape[1])
        for c in range(0, len(i), some):
            p, q = i[c : c + some] + k, j[c : c + some]
            good = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1) <= differ[p - k, q]
            yield np.stack([node[p[good]], node[q[good]]], axis=1)


def _compare_groups(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches)).sort_by([("sig", "ascending"), ("low", "ascending"), ("high", "ascending")])
    sig, low, high, node, component, size, block = (rows.column(c).to_numpy() for c in ("sig", "low", "high", "node", "component", "n_shingles", "block"))
    sketches = rows.column("sketch")
    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(sig) else []
    found, held = [np.zeros((0, 2), np.int64)], 0

    def packed():
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])

    for a, b in zip(first, np.append(first[1:], len(sig))):
        for pairs in near_pairs(node[a:b], component[a:b], size[a:b], block[a:b], sketches.slice(a, b - a).to_pylist()):
            found.append(pairs)
            held += len(pairs)
            if held >= 1 << 18:
                yield packed()
                found, held = [], 0
    if found:
        yield packed()


def _met_in_groups(members: DataFrame) -> DataFrame:
    """(a, b) of near sets of different components in groups: members (sig, node, component, n_shingles, sketch).

    A group is cut into blocks of BLOCK sets, and each two blocks of it are one piece of work, whichever task that falls to.
    """
    spark = members.sparkSession
    sizes = members.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = stored(dealt.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "n_shingles", "sketch"), "jaccard-dealt")
    rows, shingles = dealt.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (4 * BLOCK), shingles // (8 * BLOCK_SHINGLES))
    bucket = F.pmod(F.xxhash64("sig", "low", "high"), F.lit(buckets))
    met = stored(dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_compare_groups, "a long, b long").distinct(), "jaccard-met")
    discard(dealt)
    return met


def shared_counts(sizes: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one block shares with each of another; sizes and hashes of both blocks' sets."""
    own = [np.unique(h) for h in hashes]
    common = np.intersect1d(*own, assume_unique=True)
    m, n = map(len, sizes)
    out = np.zeros((m, n), np.float64)
    sides = []
    for size, h in zip(sizes, hashes):
        at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
        kept = np.flatnonzero(common[at] == h) if len(common) else np.zeros(0, np.int64)
        owner, column = np.repeat(np.arange(len(size)), size)[kept], at[kept]
        order = np.argsort(column, kind="stable")
        sides.append((owner[order], column[order]))
    step = max(1, (1 << 21) // max(1, m + n))
    for k in range(0, len(common), step):
        dense = []
        for rows, (owner, column) in zip((m, n), sides):
            a, b = np.searchsorted(column, (k, k + step))
            x = np.zeros((rows, min(step, len(common) - k)), np.float32)  # a sum of step ones is exact
            x[owner[a:b], column[a:b] - k] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _pack_sets(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches))
    hashes = rows.column("hashes").to_pylist()
    values = [*(k.as_py() for k in key), rows.column("node").to_numpy().astype("<i8").tobytes(), np.array([len(h) // 8 for h in hashes], "<i8").tobytes(), b"".join(hashes)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["component", "band", "block", "nodes", "sizes", "hashes"])


def _count_blocks(batches, num: int, den: int):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            nodes = [np.frombuffer(row[c], "<i8") for c in ("nodes", "o_nodes")]
            sizes = [np.frombuffer(row[c], "<i8") for c in ("sizes", "o_sizes")]
            shared = shared_counts(sizes, [np.frombuffer(row[c], np.uint64) for c in ("hashes", "o_hashes")])
            similar = den * shared >= num * (sizes[0][:, None] + sizes[1][None, :] - shared)
            if row["same"]:
                np.fill_diagonal(similar, False)
                node, n = nodes[0], similar.sum(axis=1)
            else:
                node, n = np.concatenate(nodes), np.concatenate([similar.sum(axis=1), similar.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(node[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["node", "n_links"])


def links_within(open_: DataFrame, joined: DataFrame, nodes: DataFrame, data: DataFrame, words: int) -> DataFrame:
    """(node, n_links), rows to be added up: how many other open nodes (node) of its component each is similar to.

    joined (node, component) are the components; nodes has node, doc_id and n_shingles. Blocks hold sets of
    a component and a band of sizes, and meet their own band and the next: similar sets' sizes are no further apart.
    """
    placed = open_.join(joined, "node").join(nodes.select("node", "doc_id", "n_shingles"), "node")
    placed = placed.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(1.05 * DEN / NUM)))).cast("int"))
    placed = stored(placed, "jaccard-placed")
    groups = placed.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    several = placed.groupBy("component").count().where("count > 1").select("component")
    groups = groups.join(several, "component").select("component", "band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = stored(placed.join(groups, ["component", "band"]).select("node", "doc_id", "component", "band", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")), "jaccard-dealt")
    sets = _sets_of(dealt.select("node", "doc_id"), data, words).join(dealt.drop("doc_id"), "node").select("node", "component", "band", "block", "hashes")
    schema = "component long, band int, block long, nodes binary, sizes binary, hashes binary"
    packed = stored(sets.groupBy("component", "band", "block").applyInArrow(_pack_sets, schema), "jaccard-blocks", "lz4")
    one = packed.select("component", "band", "block", F.explode(F.array("band", F.col("band") + 1)).alias("o_band"))
    other = packed.select("component", F.col("band").alias("o_band"), F.col("block").alias("o_block"))
    met = stored(one.join(other, ["component", "o_band"]).where("band < o_band or block <= o_block"), "jaccard-met")
    right = packed.select("component", *[F.col(c).alias(f"o_{c}") for c in packed.columns if c != "component"])
    both = met.join(packed, ["component", "band", "block"]).join(right, ["component", "o_band", "o_block"])
    both = both.select("nodes", "sizes", "hashes", "o_nodes", "o_sizes", "o_hashes", F.expr("band = o_band and block = o_block").alias("same"))
    counted = stored(mapped(both, partial(_count_blocks, num=NUM, den=DEN), "node long, n_links long"), "jaccard-within")
    discard(placed, dealt, packed, met)
    return counted


def _candidates(data: DataFrame, words: int, level: int, shingles: int) -> DataFrame:
    """data (doc_id, data) with so many shingles -> (kind, a, b): pairs of nodes (0), or signatures of large groups and their nodes (1)."""
    buckets = max(4 * int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles * PER_SHINGLE[level] // BUCKET))
    packed = mapped(data, partial(_pack_batches, words=words, buckets=min(buckets, 1 << 16), level=level), "bucket int, wide int, names binary, refs binary, sigs binary")
    return stored(packed.groupBy("bucket").applyInArrow(_bucket_candidates, "kind int, a long, b long"), f"jaccard-candidates-{level}")


def _still_open(found: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(sig, node) of large groups that can still bring similar sets together.

    Of a set's shares that aren't empty, at most as many as may differ do; so a similar set that has met it
    in no small group shares at least spare of its signatures in large ones. Sets with fewer are done, and
    of n signatures the n - spare + 1 rarest are enough: two sets that share that many have a common one
    among them.
    """
    large = found.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"), F.col("a").bitwiseAND(1).alias("parity")).distinct()
    large = stored(large.join(large.groupBy("sig").agg(F.count("*").alias("size")), "sig"), "jaccard-large")
    hot = large.groupBy("node", "parity").agg(F.count("*").alias("n"))
    spare = F.when(F.col("parity") == 0, F.col(f"spare_{level}_0")).otherwise(F.col(f"spare_{level}_1"))
    kept = hot.join(nodes.select("node", f"spare_{level}_0", f"spare_{level}_1"), "node").select("node", "parity", (F.col("n") - spare + 1).alias("enough")).where("enough > 0")
    rank = F.row_number().over(W.partitionBy("node", "parity").orderBy("size", "sig"))
    few = large.join(kept, ["node", "parity"]).withColumn("rank", rank).where("rank <= enough").select("sig", "node")
    few = stored(few, f"jaccard-few-{level}")
    open_ = stored(few.join(few.groupBy("sig").count().where("count > 1").select("sig"), "sig"), f"jaccard-open-{level}")
    discard(large, few)
    return open_


def links(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(documents with doc_id, n_shingles, node; links a, b between different nodes of similar sets; their components; nodes left open or None).

    Every link that the components need is there, and every link but those between two nodes left open. Sets that large groups leave open get finer signatures
    of their own; those that even these leave in large groups (most of such a set is common to many) are
    compared with leaders first, and then, across the components that this makes, with each other.
    """
    prepare(docs.sparkSession)
    data = docs.select("doc_id", utf8("text").alias("data"))
    schema = f"doc_id {kind_of(docs, 'doc_id')}, n_shingles long, node long, sketch binary, spare_0_0 int, spare_0_1 int, spare_1_0 int, spare_1_1 int"
    named = stored(mapped(data, partial(_name_batches, words=words), schema), "jaccard-nodes")
    # one document stands for its node
    rest = [F.first(c).alias(c) for c in NAMED if c not in ("doc_id", "node")]
    nodes = named.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *rest)
    total = F.coalesce(F.sum("n_shingles"), F.lit(0))
    found = _candidates(data, words, 0, named.agg(total).first()[0])
    pairs = found.where("kind = 0").select("a", "b")
    open_, finer = _still_open(found, nodes, 0), None
    again = not open_.isEmpty()
    if again:
        asked = open_.select("node").distinct()
        stands = stored(nodes.join(asked, "node", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n_shingles")), "jaccard-stands")
        texts = likely(data, stands.select("id"), "doc_id").join(stands, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "data")
        finer = _candidates(texts, words, 1, stands.agg(total).first()[0])
        coarse, open_ = open_, _still_open(finer, nodes, 1)
        pairs = pairs.unionByName(finer.where("kind = 0").select("a", "b"))
        discard(coarse, stands)
    pairs = stored(pairs.distinct(), "jaccard-pairs")
    discard(found, finer)
    good = _verified(pairs, nodes, data, words)
    joined = components(good)
    for turn in range(TURNS + 1) if again else ():
        placed = open_.join(joined, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("sig").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p != q").select("sig")
        rest = stored(placed.join(several, "sig"), "jaccard-several")
        if rest.isEmpty():
            break
        if turn < TURNS:
            order = F.xxhash64("node", F.col("sig") % LEADERS, F.lit(turn))
            leader = rest.groupBy("sig").agg(F.min_by(F.struct("node", "component"), order).alias("lead"))
            met = rest.join(leader, "sig").where("component != lead.component").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        else:
            met = _met_in_groups(rest.join(nodes.select("node", "n_shingles", "sketch"), "node").select("sig", "node", "component", "n_shingles", "sketch"))
        more = stored(met.join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
        fresh = _verified(more, nodes, data, words)
        if not fresh.isEmpty():
            joined = components(joined.toDF("a", "b").unionByName(fresh))
        good, pairs = stored(good.unionByName(fresh), "jaccard-links"), pairs.unionByName(more)
        discard(rest, fresh)
    return named.select("doc_id", "n_shingles", "node"), good, joined, open_.select("node").distinct() if again else None


def similar_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and n_links (the different sets similar to its own).

    Null, empty and wordless texts have empty sets and link with nothing. Equal sets link. Rows of one
    doc_id are told apart by their sets; null ids come last as representatives.
    """
    named, good, joined, open_ = links(docs, words)
    own = named.where("n_shingles > 0")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    within = None
    if open_ is not None:
        # links between two open nodes are counted by components, all others one by one
        open_ = stored(open_, "jaccard-open-nodes")
        within = links_within(open_, joined, nodes.withColumnRenamed("least", "doc_id"), docs.select("doc_id", utf8("text").alias("data")), words)
        left, right = open_.select(F.col("node").alias("a"), F.lit(True).alias("open_a")), open_.select(F.col("node").alias("b"), F.lit(True).alias("open_b"))
        good = good.join(left, "a", "left").join(right, "b", "left").where("open_a is null or open_b is null").select("a", "b")
    degree = good.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    if within is not None:
        degree = degree.unionByName(within).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    nodes = nodes.join(joined, "node", "left").join(degree, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(ids, "component").select("node", "component_id", "n_links")
    out = own.join(nodes, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _node_batches(batches, words: int, node: str):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for a, b in chunks([len(t) for t in texts], AT_ONCE):
            _, name = set_names(*shingle_sets(texts[a:b], words), b - a)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(name, pa.int64())], names=[*batch.schema.names, node])


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one document of each group of similar ones: that of the smallest doc_id. Texts without words all stay.

    Columns stay, whatever their names. Of rows alike in id and words one stays; null ids come after others.
    """
    named, _, joined, _ = links(docs, words)
    node, id_, n, nth = free_names(docs, "node", "id", "n", "nth")
    own = named.where("n_shingles > 0").join(joined, "node", "left")
    first = own.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("one"))
    chosen = first.select(F.col("one.doc_id").alias(id_), F.col("one.node").alias(n))
    chosen = chosen.unionByName(named.where("n_shingles = 0").select(F.col("doc_id").alias(id_), F.col("node").alias(n)).distinct())
    kept = mapped(docs, partial(_node_batches, words=words, node=node), schema_of(docs, docs.columns, f"`{node}` long"))
    kept = kept.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(node) == F.col(n)))
    # numbering rows costs a shuffle of texts, so only where some are alike
    if not named.where("n_shingles > 0").groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        alike = F.row_number().over(W.partitionBy("doc_id", node).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        kept = kept.withColumn(nth, alike).where((F.col(nth) == 1) | (F.col(node) == 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
