"""Documents of nearly equal word n-grams: an exact Jaccard join by prefixes under several orders of the n-grams.

Two sets as alike as asked for share an n-gram among the first few of either, whatever order all n-grams are
in. Orders put common n-grams last (by a count sketch of fixed size over the whole corpus) and differ in how they mix the rest.
The first order's prefixes deal documents into buckets; a pair from a bucket must also share prefixes, at possible
positions, under every other order before its sets are compared. Any order gives all links; the sketch
only makes buckets small.

Documents of equal sets are one node. In a large bucket every node is first paired with the bucket's most central node
alone; once those links have made components, only nodes outside the central node's component are paired with the
others. A component therefore never costs all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistgrove.llm.common import attach, pieces, stored
from mistgrove.llm.components import components

#: Cells of each of the sketch's two rows, and how many are handled together.
CELLS, CHUNK = 1 << 22, 1 << 16
#: Odd factors: one for each row of the sketch, one for each order.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ORDERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Buckets of more rows start from their central node.
SMALL = 8
#: Parts of hash space in which a set's tokens are counted.
PARTS = 64
#: Bits of the table that says which documents' sets are wanted.
WANTED = 1 << 24
#: Words whose hashes a task keeps.
HELD = 400_000


class Shingler:
    """Texts to sorted arrays of 64-bit n-gram hashes; remembers word hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
        if len(self.known) > HELD:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashed = np.fromiter((known[w] for w in words), np.uint64, len(words))
        if not words:
            return hashed
        span = min(self.width, len(words))
        out = np.full(len(words) - span + 1, span, np.uint64)
        for k in range(span):
            out = (out ^ hashed[k : k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's cell in either row of the sketch."""
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    return tuple(((tokens * np.uint64(row)) >> shift).astype(np.int64) for row in ROWS)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


class Orders:
    """The global orders: common n-grams last, in steps of their counts, else by a mix of the hash."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.reshape(2, CELLS)
        mean = float((2 ** (self.codes[0].astype(np.float32) / 4) - 1).mean())  # what chance alone puts into a cell
        self.common = int(4 * np.log2(5 + mean + 3 * mean**0.5))

    def first(self, tokens: np.ndarray, p: int) -> list[np.ndarray]:
        """The first p of the tokens in every order; tokens come sorted."""
        one, two = cells(tokens)
        code = np.minimum(self.codes[0][one], self.codes[1][two]).astype(np.int64)
        rank = np.maximum(code - self.common, 0).astype(np.uint64) << np.uint64(56)
        out = []
        for factor in ORDERS:
            mixed = tokens * np.uint64(factor)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(ROWS[0])
            out.append(tokens[np.argsort(rank | (mixed >> np.uint64(8)), kind="stable")[:p]])
        return out


def read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))


def sets_and_sketches(docs: DataFrame, width: int) -> DataFrame:
    """Rows key, n, node of all documents (node: a hash of the set, null if empty), and rows chunk, counts of each task's sketch.

    A task's cells stop at 255.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, sketch = Shingler(width), np.zeros((2, CELLS), np.uint32)
        names = ["key", "n", "node", "chunk", "counts"]
        for batch in pieces(batches, 1):
            sets = [shingle(x) for x in batch.column(1).to_pylist()]
            for row, at in enumerate(cells(np.concatenate(sets))):
                np.add.at(sketch[row], at, np.uint32(1))  # in place: nothing as long as the sketch is made per batch
            nodes = [int.from_bytes(xxhash.xxh3_64_digest(x.tobytes()), "big", signed=True) if len(x) else None for x in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.int64()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for chunk, counted in enumerate(sketch.reshape(-1, CHUNK)):
            part = np.minimum(counted, 255).astype(np.uint8)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                                                  pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    return stored(docs.mapInArrow(gather, "key long, n long, node long, chunk int, counts binary"), "jaccard-sets")


def orders(sketches: DataFrame) -> Orders:
    """Add up the tasks' sketches; a cell's count comes to the driver as a byte, four steps to a doubling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
                total += np.frombuffer(counts.as_buffer(), np.uint8)
        for chunk, total in sums.items():
            code = np.minimum(np.round(4 * np.log2(1 + total)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=["chunk", "codes"])

    codes = np.zeros(2 * CELLS, np.uint8)
    for r in sketches.repartition("chunk").mapInArrow(add, "chunk int, codes binary").collect():  # 2 * CELLS bytes in all
        codes[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["codes"], np.uint8)
    return Orders(codes)


def prefixes(docs: DataFrame, order: Orders, width: int, percent: int) -> DataFrame:
    """Per document with words: node, n, first (prefix in the first order), others (16 bits of each token of the other orders' prefixes),
    counts (tokens in each part of hash space)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 2 * CELLS bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, known = Shingler(width), shared.value
        for batch in pieces(batches, 1):
            out, seen = [], set()
            for text in batch.column(1).to_pylist():
                tokens = shingle(text)
                if not len(tokens):
                    continue
                node = int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)
                if node in seen:
                    continue
                seen.add(node)
                first, *rest = known.first(tokens, prefix_size(len(tokens), percent))
                counts = np.minimum(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=PARTS), 65535).astype(np.uint16)
                out.append((node, len(tokens), first.view(np.int64), b"".join(x.astype(np.uint16).tobytes() for x in rest), counts.tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(5)], names=["node", "n", "first", "others", "counts"])

    return stored(docs.mapInArrow(cut, "node long, n int, first array<long>, others binary, counts binary"), "jaccard-prefixes")


def possible(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, percent: int) -> Column:
    """Whether sets of these sizes can be alike if their first shared token stands at these positions."""
    sizes = (100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n))
    return sizes & ((100 + percent) * F.least(a_n - a_pos, b_n - b_pos) >= percent * (a_n + b_n))


def pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def agreeing(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be alike by two exact bounds.

    What two sets share in a part of hash space is at most the smaller of their counts there; and their prefixes share a token
    at possible positions under every other order too.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(2).to_numpy() + batch.column(5).to_numpy()
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64) for i in (4, 7))
            most = np.where(np.maximum(one, two) == 65535, 1 << 40, np.minimum(one, two)).sum(1)
            keep = (100 + percent) * most >= percent * sizes
            for k in np.flatnonzero(keep).tolist():
                n_a, n_b = batch.column(2)[k].as_py(), batch.column(5)[k].as_py()
                for one, two in zip(*(np.frombuffer(batch.column(i)[k].as_py(), np.uint16).reshape(len(ORDERS) - 1, -1) for i in (3, 6)), strict=True):
                    i, j = shared_places(one, two)
                    keep[k] &= bool(((100 + percent) * np.minimum(n_a - i, n_b - j) >= percent * (n_a + n_b)).any())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (heads.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "others", "counts")]) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", *[f"{c}_{x}" for x in "ab" for c in ("n", "others", "counts")]) \
        .mapInArrow(test, "a long, b long")


def shared_places(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of equal values, each value's first in either array: enough, as later ones bound the overlap no better."""
    values, i = np.unique(one, return_index=True)
    others, j = np.unique(two, return_index=True)
    _, at, to = np.intersect1d(values, others, return_indices=True)
    return i[at], j[to]


def wanted_sets(docs: DataFrame, wanted: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Columns node, tokens (64-bit hashes, sorted, as bytes) of the nodes in `wanted`.

    A bit table of fixed size over the keys of one document of each node picks the documents whose texts are cut up; what it lets
    through by chance goes at the join.
    """
    keys = members.join(wanted, "node").groupBy("node").agg(F.min("key").alias("key")).select(F.pmod(F.xxhash64("key"), F.lit(WANTED)).alias("bit")).distinct()
    words = keys.groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    table = np.zeros(WANTED // 64, np.int64)
    found = words.toArrow()  # WANTED bits at most
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, bits = Shingler(width), shared.value
        for batch in pieces(batches, 1):
            nodes, sets = [], []
            for i in np.flatnonzero(bits[batch.column(2).to_numpy()]).tolist():
                tokens = shingle(batch.column(1)[i].as_py())
                if len(tokens):
                    nodes.append(int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True))
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    cut_up = docs.withColumn("bit", F.pmod(F.xxhash64("key"), F.lit(WANTED))).mapInArrow(cut, "node long, tokens binary")
    return stored(cut_up.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "jaccard-tokens")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike, with both sizes and the intersection's."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], names=["a", "b"])

    one, two = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long")


def ends_of(pairs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The nodes of stored pairs, marked for broadcasting where they are few (8 MB), so that wide tables stay where they are."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-ends")
    return F.broadcast(ends) if ends.count() <= broadcast_rows else ends


def compared(texts: DataFrame, members: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among the candidate pairs: those that agree under all orders, then in their sets. Stored."""
    pairs = stored(pairs.distinct(), "jaccard-candidates")
    own = stored(heads.select("node", "n", "others", "counts").join(ends_of(pairs), "node", "left_semi").dropDuplicates(["node"]), "jaccard-heads")
    pairs = stored(agreeing(pairs, own, percent), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    sets = wanted_sets(texts, ends_of(pairs), members, width)
    return stored(verified(pairs, sets, percent), "jaccard-links")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: key, n_shingles (different word n-grams, A-Z lower-cased) and component_id.

    Documents link when 100 * intersection >= percent * union; component_id is the smallest key of those
    reachable. Fewer words than `width` make one n-gram; without words (null, empty, white space) a
    document has none and its own key. Null keys count only where a component has no other. Repeated rows are
    equal sets. An empty table gives an empty result; other columns are not looked at. n-grams and sets are told apart by
    64-bit hashes.
    """
    texts = read(docs, key, text)
    gathered = sets_and_sketches(texts, width)
    members = gathered.where("chunk is null").select("key", "n", "node")
    heads = prefixes(texts, orders(gathered.where("chunk is not null").select("chunk", "counts")), width, percent)
    rows = heads.select("node", "n", F.posexplode("first").alias("pos", "token"))
    # most tokens have one node: they go before anything else is worked out
    several = rows.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("token")
    met = stored(rows.join(several, "token", "left_semi").distinct(), "jaccard-met")
    buckets = met.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("pos", "n", "node")).alias("centre"))
    shared = stored(met.join(buckets, "token"), "jaccard-buckets")
    small, large = shared.where(F.col("size") <= SMALL), shared.where(F.col("size") > SMALL)
    other = small.select("token", F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    n, pos = F.col("n"), F.col("pos")
    direct = small.join(other, "token").where((F.col("node") < F.col("node_b")) & possible(n, pos, F.col("n_b"), F.col("pos_b"), percent)) \
        .select(*pair(F.col("node"), F.col("node_b")))
    central = large.where((F.col("node") != F.col("centre.node")) & possible(n, pos, F.col("centre.n"), F.col("centre.pos"), percent)) \
        .select(*pair(F.col("node"), F.col("centre.node")))
    links = compared(texts, members, heads, direct.union(central), width, percent)
    found = components(links)
    # nodes of large buckets that the centre's component doesn't hold meet all others of their bucket
    named = found.select("node", "component")
    placed = large.join(named, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component") \
        .join(named.select(F.col("node").alias("at"), "component"), F.col("centre.node") == F.col("at"), "left") \
        .withColumn("main", F.coalesce("component", "centre.node")).drop("component", "at")
    placed = stored(placed.select("token", "node", "n", "pos", "own", "main"), "jaccard-placed")
    outside = placed.where("own <> main")
    all_others = placed.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "own", "main")])
    left = outside.join(all_others, "token").where(
        (F.col("own") != F.col("own_b")) & ((F.col("own_b") == F.col("main")) | (F.col("node") < F.col("node_b")))
        & possible(n, pos, F.col("n_b"), F.col("pos_b"), percent)).select(*pair(F.col("node"), F.col("node_b")))
    final = components(links.union(compared(texts, members, heads, left, width, percent)))
    nodes = members.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("members")) \
        .join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stored(nodes, "jaccard-nodes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    groups = stored(attach(nodes, stored(least, "jaccard-least"), "component", F.col("nodes"), nodes.count())
                    .select("node", "component_id", "members"), "jaccard-groups")
    filled = attach(members.where("node is not null"), groups, "node", F.col("members"), members.count())
    return filled.select("key", "n", "component_id").union(members.where("node is null").select("key", "n", "key")) \
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")
