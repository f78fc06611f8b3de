"""Approximate nearest neighbours by additive quantisation.

A vector's direction is a sum of one codeword from each of several full-dimensional codebooks,
found by beam search over residuals; its norm is stored beside the codes. Inner products are
those of the query with every codeword, summed by code and scaled by the norm. The best of each
block are scored again exactly, in double precision, on the original vectors that the block
carries, so no second join fetches them. Bests are of distinct vec_ids: rows alike are
indexed once, and an id with several vectors in a block takes one place there, by its best score.

The codebooks are fitted on the driver on a bounded sample; every row is indexed. Blocks have
bounded bytes, however long vectors are. Groups of queries meet shards of the index in the cells
of a grid: a task holds a group's queries and their best finds, and index blocks pass one by one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import mapped, stored, table

NEAREST = 20
EVERY = 20
#: Rows the codebooks are fitted on at most, codebooks, codewords of each, and width of the beam.
TRAIN_ROWS, BOOKS, WORDS, BEAM = 8192, 8, 256, 4
#: Rows of an index block, queries of a query block, candidates of a block that are scored exactly.
BLOCK, QUERIES, SHORT = 16384, 1024, 2048
ROUNDS = 6
#: Bytes of vectors in a block at most, index blocks of a shard, and bytes of the queries and finds that a task holds.
BLOCK_BYTES, SHARD, HELD = 4 << 20, 32, 128 << 20
#: Looked-up scores that are held at once, and the longest vectors whose codewords are summed before they meet queries.
AT_ONCE, NARROW = 1 << 21, 512
#: From so many lengths of vectors on, each one's finds are stored before the next length is searched.
LENGTHS = 8


class Codebooks:
    def __init__(self, books: np.ndarray):
        """books: codebooks x codewords x dimensions."""
        self.books = books.astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of rows of x by beam search: each step keeps the beam's partial sums nearest to the row."""
        out = np.empty((len(x), len(self.books)), np.uint8)
        for a in range(0, len(x), 2048):
            out[a : a + 2048] = self._encode(x[a : a + 2048].astype(np.float32), beam)
        return out

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, rows = len(x), np.arange(len(x))[:, None]
        rest, codes, left = x[:, None], np.zeros((n, 1, 0), np.uint8), np.einsum("nd,nd->n", x, x)[:, None]
        for book in self.books:
            k = len(book)
            cost = left[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, k) + np.einsum("kd,kd->k", book, book)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            before, word = best // k, best % k
            left = flat[rows, best]
            rest = rest[rows, before] - book[word]
            codes = np.concatenate([codes[rows, before], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), left.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: queries x codebooks x codewords."""
        return np.einsum("qd,mkd->qmk", q.astype(np.float32), self.books, optimize=True)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3) -> Codebooks:
    """Codebooks for rows of x: k-means on residuals, then all of them at once by least squares on the beam's codes."""
    r = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x) // 4))
    rest, found = x.copy(), []
    for _ in range(books):
        book = rest[r.choice(len(rest), words, replace=False)].copy()
        for _ in range(ROUNDS):
            near = (rest @ book.T - 0.5 * np.einsum("kd,kd->k", book, book)).argmax(axis=1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            starts = np.cumsum(count) - count
            full = count > 0
            book[full] = np.add.reduceat(rest[order], starts[full], axis=0) / count[full][:, None]
            book[~full] = rest[r.integers(0, len(rest), (~full).sum())]
        near = (rest @ book.T - 0.5 * np.einsum("kd,kd->k", book, book)).argmax(axis=1)
        rest -= book[near]
        found.append(book)
    model = Codebooks(np.stack(found))
    codes = model.encode(x) + np.arange(books) * words
    n_words = books * words
    gram = np.bincount((codes[:, :, None] * n_words + codes[:, None, :]).ravel(), minlength=n_words * n_words).reshape(n_words, n_words).astype(np.float64)
    sums = np.zeros((n_words, x.shape[1]))
    for m in range(books):
        np.add.at(sums, codes[:, m], x)
    gram[np.diag_indices(n_words)] += 0.1
    # pull towards the codebooks that the codes were found with, so words seldom used stay
    solved = np.linalg.solve(gram, sums + 0.1 * model.books.reshape(n_words, -1))
    return Codebooks(solved.reshape(books, words, -1))


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector of finite numbers that isn't zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)


def _matrix(column) -> np.ndarray:
    """Rows of a list column that all have one length."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(column), -1)


def _index_blocks(batches, model: Codebooks, rows: int, with_codes: bool):
    """Packs rows into blocks of bounded bytes: ids, vectors and, for the index, codes and norms."""
    ids, vectors, held = [], [], 0

    def packed():
        i, x = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(i, kind="stable")
        i, x = i[order], x[order]
        norm = np.sqrt(np.einsum("nd,nd->n", x, x, dtype=np.float64))
        codes = model.encode(x / norm[:, None]).tobytes() if with_codes else b""
        return pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (i.astype("<i8").tobytes(), x.tobytes(), codes, norm.astype("<f4").tobytes(), x.dtype.str)], names=["ids", "vectors", "codes", "norms", "kind"]
        )

    for batch in batches:
        i, x = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("embedding")) if batch.num_rows else None
        if x is not None:
            x = x.astype("<f4" if x.dtype == np.float32 else "<f8", copy=False)
            rows = max(1, min(rows, BLOCK_BYTES // (x.itemsize * x.shape[1])))
        a = 0
        while a < batch.num_rows:
            ids.append(i[a : a + rows - held])
            vectors.append(x[a : a + rows - held])
            a += len(ids[-1])
            held += len(ids[-1])
            if held == rows:
                yield packed()
                ids.clear()
                vectors.clear()
                held = 0
    if held:
        yield packed()


def shortlist(score: np.ndarray, starts: np.ndarray, own: int, size: int) -> np.ndarray:
    """Ids with the best looked-up scores, best first, of equals the earlier; ties at the end are resolved so too.

    starts are the first rows of the ids, which come in order; own is left out (-1: none). Ids are told by their places in starts.
    """
    if len(starts) < len(score):
        score = np.maximum.reduceat(score, starts)
    if own >= 0:
        score[own] = -np.inf
    if len(score) > size:
        edge = np.partition(score, len(score) - size)[len(score) - size]
        found = np.flatnonzero(score >= edge)
    else:
        found = np.arange(len(score))
    found = found[found != own]
    return found[np.argsort(-score[found], kind="stable")][:size]


class _Block:
    """Rows of an index block, their ids in order."""

    def __init__(self, row: dict, model: Codebooks):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), -1)
        self.norms = np.frombuffer(row["norms"], "<f4")
        self.starts = np.flatnonzero(np.concatenate([[True], self.ids[1:] != self.ids[:-1]]))
        self.names, self.count = self.ids[self.starts], np.diff(np.append(self.starts, len(self.ids)))
        self.model = model
        self.sums = model.decode(self.codes) if self.x.shape[1] <= NARROW else None

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with the sums of codewords, scaled by the norms; short codewords are summed first, long ones looked up."""
        if self.sums is not None:
            return (q.astype(np.float32) @ self.sums.T) * self.norms
        out = np.zeros((len(q), len(self.ids)), np.float32)
        for score, tables in zip(out, self.model.tables(q)):
            for t, c in zip(tables, self.codes.T):
                score += t[c]
        return out * self.norms


class _Asked:
    """A query block and the best finds of each of its queries so far."""

    def __init__(self, row: dict, nearest: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        self.found = np.full((len(self.ids), nearest), -1, np.int64)
        self.best = np.full((len(self.ids), nearest), -np.inf)
        self.n = np.zeros(len(self.ids), np.int64)

    def meet(self, block: _Block, short: int) -> None:
        places = np.searchsorted(block.names, self.ids)
        own = np.where(block.names[np.minimum(places, len(block.names) - 1)] == self.ids, places, -1)
        step = max(1, AT_ONCE // len(block.ids))
        for a in range(0, len(self.ids), step):
            for k, score in enumerate(block.scores(self.x[a : a + step]), a):
                near = shortlist(score, block.starts, int(own[k]), short)
                if len(near):
                    self._keep(k, near, block)

    def _keep(self, k: int, near: np.ndarray, block: _Block) -> None:
        q, width = self.x[k].astype(np.float64), self.best.shape[1]
        if len(block.names) == len(block.ids):
            rows, owner = block.starts[near], near
        else:  # all rows of the ids in the list, id by id
            first = np.cumsum(block.count[near]) - block.count[near]
            rows = np.repeat(block.starts[near] - first, block.count[near]) + np.arange(block.count[near].sum())
            owner = np.repeat(near, block.count[near])
        # products of matrices aren't the same for equal rows, so they only rule out what is clearly worse
        rough = block.x[rows] @ self.x[k]
        slack = 1e-4 * float(np.sqrt(q @ q)) * float(block.norms[owner].max())
        edge = self.best[k, -1]
        if len(block.names) == len(block.ids) and len(rows) > width:
            edge = max(edge, np.partition(rough, len(rows) - width)[len(rows) - width] - slack)
        good = rough >= edge - slack
        if not good.any():
            return
        score = (block.x[rows[good]].astype(np.float64) * q).sum(axis=1)
        names, score = np.append(block.names[owner[good]], self.found[k, : self.n[k]]), np.append(score, self.best[k, : self.n[k]])
        order = np.lexsort((names, -score))
        names, score = names[order], score[order]
        first = np.sort(np.unique(names, return_index=True)[1])[:width]
        self.n[k] = len(first)
        self.found[k, : len(first)], self.best[k, : len(first)] = names[first], score[first]

    def packed(self) -> pa.RecordBatch:
        kept = np.arange(self.best.shape[1]) < self.n[:, None]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, self.n)), pa.array(self.found[kept]), pa.array(self.best[kept])], names=["query_id", "vec_id", "score"]
        )


def _search(batches, model: Codebooks, nearest: int, short: int):
    """Rows come cell by cell: its query blocks, which are held, and then its index blocks, one at a time."""
    cell, asked = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["cell"] != cell:
                yield from (a.packed() for a in asked)
                cell, asked = row["cell"], []
            if row["indexed"]:
                block = _Block(row, model) if asked else None
                for a in asked:
                    a.meet(block, short)
            else:
                asked.append(_Asked(row, nearest))
    yield from (a.packed() for a in asked)


def train(vectors: DataFrame, rows: int = TRAIN_ROWS) -> Codebooks | None:
    """Codebooks from at most that many rows, chosen by a hash; None if there are no vectors."""
    order, total = F.xxhash64("vec_id", "embedding"), vectors.count()
    if total > 4 * rows:  # about twice as many as are wanted, so that no task sorts more than these
        vectors = vectors.where(F.pmod(order, F.lit(1 << 40)) < (1 << 40) * 2 * rows // total)
    sample = vectors.orderBy(order, "vec_id").limit(rows).toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    x = _matrix(sample.column("embedding").combine_chunks()).astype(np.float64)
    return fit(x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, short: int = SHORT) -> DataFrame:
    """For each query (vec_id, embedding) its k nearest vectors found, by inner product: query_id, rank, vec_id, score.

    A query's own vec_id is no candidate. Each vec_id counts once a query, with its best score if rows
    repeat it, and each query id once, with its best score to a vec_id over its rows. Null, zero and
    non-finite vectors take no part. A query meets the vectors of its own length; each length has an index,
    and they are searched one after the other. Ids are whole numbers. Fewer candidates than k give all of them.
    """
    vectors, queries = usable(vectors), usable(queries)
    lengths = [r.d for r in vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_met(*(df.where(F.size("embedding") == d) for df in (vectors, queries)), k, short) for d in lengths[:LENGTHS]]
    found += [stored(_met(*(df.where(F.size("embedding") == d) for df in (vectors, queries)), k, short), "neighbours-found") for d in lengths[LENGTHS:]]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def grid(index_blocks: int, query_blocks: int, query_bytes: int, at_once: int) -> tuple[int, int]:
    """Shards of the index and groups of the queries: each shard meets each group in one cell.

    A group's queries and finds fit HELD bytes and a shard has about SHARD blocks. Shards and, where
    there are few index blocks, groups are more while that keeps more tasks (at_once) busy.
    """
    groups = max(1, -(-query_bytes // HELD))
    shards = max(1, -(-index_blocks // SHARD), min(index_blocks, -(-at_once // groups)))
    if index_blocks < at_once:
        groups = max(groups, min(query_blocks, -(-at_once // shards)))
    return shards, groups


def _met(vectors: DataFrame, queries: DataFrame, k: int, short: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest of each index shard, for vectors of one length."""
    spark = vectors.sparkSession
    # sorted, so that blocks are the same each time
    vectors = stored(vectors.dropDuplicates(["vec_id", "embedding"]).sortWithinPartitions("vec_id", "embedding"), "neighbours-vectors")
    queries = queries.dropDuplicates(["vec_id", "embedding"])
    model = train(vectors)
    block = "ids binary, vectors binary, codes binary, norms binary, kind string"
    index = stored(mapped(vectors, partial(_index_blocks, model=model, rows=BLOCK, with_codes=True), block), "neighbours-index", at_once=1)
    asked = stored(mapped(queries, partial(_index_blocks, model=model, rows=QUERIES, with_codes=False), block), "neighbours-asked", at_once=8)
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("vectors") + F.length("ids") * (1 + 2 * k)), F.lit(0))).first()
    shards, groups = grid(index.count(), *size, at_once=4 * spark.sparkContext.defaultParallelism)
    # each row goes to all cells of its shard or group; none is joined, so nothing is kept but a group's queries
    place = lambda n: F.pmod(F.crc32("ids"), F.lit(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    to_cells = index.select(F.lit(True).alias("indexed"), "*", place(shards).alias("shard"), F.explode(every(groups)).alias("group"))
    to_cells = to_cells.unionByName(asked.select(F.lit(False).alias("indexed"), "*", F.explode(every(shards)).alias("shard"), place(groups).alias("group")))
    cells = to_cells.select((F.col("group") * shards + F.col("shard")).cast("int").alias("cell"), "indexed", *index.columns)
    cells = cells.repartitionById(shards * groups, F.col("cell")).sortWithinPartitions("cell", "indexed")
    return mapped(cells, partial(_search, model=model, nearest=k, short=short), "query_id long, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
