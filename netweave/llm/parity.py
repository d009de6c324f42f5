"""Near-duplicate components by a parity-sketch join over word shingles.

A document's set of 4-word shingles is hashed to 64-bit tokens. Two bit sketches come from it:

* Block words. The hash range is cut into as many blocks as the size band asks for; a block's word is
  the XOR of its tokens (one parity bit each, and the whole hashes). A token changes one block, so the
  number of differing blocks is at most the symmetric difference. Sets that link differ in at most
  ``d`` tokens, so with ``d + 1 + slack`` blocks some non-empty block is equal: the pigeonhole join.
* A parity bit vector of a power-of-two length, at least 8 bits a token and 4096 in all. Its Hamming distance is at
  most the symmetric difference, too; candidates beyond the bound are dropped.

What is left is verified on the token sets. Candidates of a block are compared with its least
member first (a star); the links found join members to components, and only then are the members of
different components of a block compared, in tasks of at most ``2 * CHUNK`` members. A task gives a
spanning forest of its candidates, likeliest first, so fewer pairs than members. Where all of a forest's
pairs link, any other candidate of the task lies inside a component. The tasks of which a pair did not link
are done once more with the new components and those of their members that have a candidate, and give every candidate
between different ones. No pair
that could link two components is left out, and copies are never expanded into pairs: equal sets are
one node, named by a 64-bit hash of the set.

Two sets of a band pair meet in the band of the smaller one; a set is sketched for its own band and for those
below whose sets could be as large as 85 % of it. An empty block says nothing. The slack grows with the band, so that
about one set in ten thousand has more empty blocks than that; it joins on them as well, which keeps the pigeonhole whole.

Keys are cut to as many bits as the number of keys asks for; what meets by chance does not pass the vectors. Steps that
nothing reads any more are removed as the work goes on.

Defined results: null and empty texts, or texts without words, have size 0, link with nothing
and are their own component. Shorter texts are one shingle. Repeated rows and rows of one doc_id each get
a row. A null doc_id takes part; its component is the least id that is there, null if none.
Extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import packed, release, small_batches, stored

SHINGLE = 4
#: Sets link when they share so many percent of their union.
MIN_SHARE = 85
BAND_RATIO = 1.5
#: Blocks beyond the pigeonhole's: some, and a share of the differences.
SLACK, SLACK_SHARE = 2, 0.05
#: So many bits more than it takes to count all keys; they are counted high, so that few keys meet by chance.
SPARE_BITS = 2
#: Keys of a set for each of its shingles at most, all bands together: small sets have some blocks beyond their differences.
KEYS_A_SHINGLE = 10
BITS_PER_TOKEN = 8
#: In a short text a single collision is a large share of the bound, so no vector is shorter.
LEAST_BITS = 4096
CHUNK = 512
#: Up to so many ids (8 bytes each) are sent to all tasks to pick documents; beyond, the join shuffles.
SENT_IDS = 500_000
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct tokens of a text."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(SHINGLE, len(found))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * MIX_A + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_name(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of the set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def largest_difference(a, b):
    """The symmetric difference of linked sets of these sizes is at most this."""
    return (100 - MIN_SHARE) * (a + b) // (100 + MIN_SHARE)


def _edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return np.array(edges)


EDGES = _edges()


def _differences(band: int) -> int:
    top = int(EDGES[band + 1]) - 1
    return largest_difference(top, top * 100 // MIN_SHARE)


def slack(band: int) -> int:
    return SLACK + int(SLACK_SHARE * _differences(band))


def block_count(band: int) -> int:
    return _differences(band) + 1 + slack(band)


def bands(n: int) -> range:
    least = -(-n * MIN_SHARE // 100)
    return range(int(np.searchsorted(EDGES, least, "right")) - 1, int(np.searchsorted(EDGES, n, "right")))


def block_keys(tokens: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit key for every block that takes part, of band, block and what the block's tokens XOR to."""
    blocks = block_count(band)
    where = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the token
    starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    at = where[starts].astype(np.int64)
    parity, whole = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
    parity[at] = np.bitwise_xor.reduceat(np.uint64(1) << (tokens & np.uint64(63)), starts)
    whole[at] = np.bitwise_xor.reduceat(tokens, starts)
    chosen = at if blocks - len(at) <= slack(band) else np.arange(blocks)
    block = chosen.astype(np.uint64) + (np.uint64(band) << np.uint64(44))
    return mixed(mixed(mixed(block) + parity[chosen] * MIX_B) + whole[chosen])


def bit_vector(tokens: np.ndarray) -> np.ndarray:
    """Parity bits at the tokens' low bits, as 64-bit words; the length is a power of two."""
    bits = LEAST_BITS
    while bits < BITS_PER_TOKEN * len(tokens):
        bits *= 2
    odd, times = np.unique(tokens & np.uint64(bits - 1), return_counts=True)
    odd = odd[times % 2 == 1]
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (odd >> np.uint64(6)).astype(np.int64), np.uint64(1) << (odd & np.uint64(63)))
    return out


def folded(vectors: np.ndarray, words: int) -> np.ndarray:
    """Vectors of a smaller power-of-two length: positions are taken modulo the length."""
    while vectors.shape[1] > words:
        half = vectors.shape[1] // 2
        vectors = vectors[:, :half] ^ vectors[:, half:]
    return vectors


# ---------------------------------------------------------------- per document


def key_bits(keys: int) -> int:
    """Whole bytes, as many as so many keys need."""
    return min(64, -(-(max(keys, 1).bit_length() + SPARE_BITS) // 8) * 8)


def _node_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per document its set's name, size and vector, and the first ``bits`` of its keys, which equal sets met lately give once."""
    seen: set[int] = set()
    for batch in batches:
        names, sizes, vectors, keys = [], [], [], []
        for value in batch.column("text"):
            tokens = shingles(value.as_py())
            name = set_name(tokens) if len(tokens) else None
            names.append(name)
            sizes.append(len(tokens))
            vectors.append(bit_vector(tokens).tobytes() if len(tokens) else None)
            if name is None or name in seen:
                keys.append(None)
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(name)
            own = np.concatenate([block_keys(tokens, band) for band in bands(len(tokens))]) >> np.uint64(64 - bits)
            keys.append(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes())
        columns = [batch.column("doc_id"), *[pa.array(c, t) for c, t in ((names, pa.int64()), (sizes, pa.int64()), (vectors, pa.binary()), (keys, pa.binary()))]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "bits", "keys"])


def _key_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    width = bits // 8
    for batch in batches:
        packed = [k.as_py() for k in batch.column("keys")]
        body = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
        keys = np.zeros((len(body), 8), np.uint8)
        keys[:, :width] = body
        nodes = np.repeat(batch.column("node").to_numpy(), [len(k) // width for k in packed])
        # the bits that are left out stand last, beside the zeros of the row's head
        own = keys.view("<u8").ravel().astype(np.uint64) << np.uint64(64 - bits)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(nodes, pa.int64())], ["key", "node"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, data = [], [], []
        for value in batch.column("text"):
            tokens = shingles(value.as_py())
            if len(tokens):
                names.append(set_name(tokens))
                sizes.append(len(tokens))
                data.append(tokens.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["node", "n", "data"]
        )


# ---------------------------------------------------------------- comparisons in tasks of bounded size


def _close(a: np.ndarray, b: np.ndarray, n: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``b`` may link with ``a`` by sizes and Hamming distance, and the share of the bound it takes."""
    fits = (100 * np.minimum(n, m) >= MIN_SHARE * np.maximum(n, m)).nonzero()[0]
    distance, bound = np.bitwise_count(b[fits] ^ a).sum(1), largest_difference(n, m[fits])
    near = distance <= bound
    return fits[near], distance[near] / np.maximum(bound[near], 1)


def _candidates(sizes: np.ndarray, data: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left member, the right ones of other labels that may link with it, and how much of the bound they take."""
    lengths = np.array([len(d) // 8 for d in data])
    stacks = {}
    for words in np.unique(lengths):
        own = right[lengths[right] == words]
        if len(own):
            stacks[int(words)] = (own, np.stack([np.frombuffer(data[i], np.uint64) for i in own]))
    for i in left:
        for words, (own, vectors) in stacks.items():
            least = min(words, int(lengths[i]))
            if max(words, int(lengths[i])) > 2 * least:
                continue  # the sizes cannot fit
            mine = folded(np.frombuffer(data[i], np.uint64)[None, :], least)[0]
            fits, share = _close(mine, folded(vectors, least), int(sizes[i]), sizes[own])
            other = label[own[fits]] != label[i]
            yield int(i), own[fits[other]], share[other]


def _hamming_pairs(*members) -> list[tuple[int, int]]:
    return [(i, int(j)) for i, found, _ in _candidates(*members) for j in found]


def _forest(sizes: np.ndarray, data: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Candidates that join all labels that candidates connect, none superfluous, those of the least share first; then
    each member that has a candidate, beside itself."""
    at = np.unique(label, return_inverse=True)[1].tolist()
    above = list(range(len(at)))  # labels join as the forest grows

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    lefts, rights, shares = [], [], []
    for i, found, share in _candidates(sizes, data, label, left, right):
        lefts.append(np.full(len(found), i))
        rights.append(found)
        shares.append(share)
    if not lefts:
        return []
    a, b, share = np.concatenate(lefts), np.concatenate(rights), np.concatenate(shares)
    order = np.argsort(share, kind="stable")
    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = top(at[i]), top(at[j])
        if x != y:
            above[x] = y
            out.append((i, j))
    return out + [(i, i) for i in np.union1d(a, b).tolist()]


def _exact_pairs(sizes: np.ndarray, data: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    sets = [np.frombuffer(d, np.uint64) for d in data]
    out = []
    for i in left:
        for j in right:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= MIN_SHARE * (sizes[i] + sizes[j] - shared):
                out.append((i, j))
    return out


def _compare(tasks: DataFrame, payload: DataFrame, test: Callable) -> DataFrame:
    """Pairs of a task's left and right members that pass, and members that the test marks, as pairs with themselves.

    ``tasks``: task, side (0, 1; 2 is both), node, label."""

    def one(rows: list[tuple]) -> list[tuple[int, int, int]]:
        side = np.array([r[1] for r in rows])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        pairs = test(np.array([r[4] for r in rows]), [r[5] for r in rows], np.array([r[3] for r in rows]), left, right)
        names = {(min(rows[i][2], rows[j][2]), max(rows[i][2], rows[j][2])) for i, j in pairs if i == j or rows[i][2] != rows[j][2]}
        return [(rows[0][0], a, b) for a, b in sorted(names)]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in found:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += one(held)
                    held = []
                held.append(row)
            yield _pairs(out)
        if held:
            yield _pairs(one(held))
        held.clear()
        pa.default_memory_pool().release_unused()

    ordered = tasks.join(payload, "node").select("task", "side", "node", "label", "n", "data")
    return ordered.repartition("task").sortWithinPartitions("task", "node").mapInArrow(batches, "task long, a long, b long")


def _pairs(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(3)], ["task", "a", "b"])


def _distinct(compared: DataFrame) -> DataFrame:
    return compared.select("a", "b").distinct()


def _star_tasks(pairs: DataFrame) -> DataFrame:
    """Each ``a`` against its many ``b``, in tasks of about CHUNK; a common ``a`` is repeated per task."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    # pairs of one hub meet its count in a join that may be split where the hub is common
    salted = pairs.join(counts, "a").withColumn(
        "task", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / CHUNK)))
    )
    right = salted.select("task", F.lit(1).alias("side"), F.col("b").alias("node"), F.col("b").alias("label"))
    left = salted.groupBy("task", "a").agg(F.lit(0).alias("side")).select("task", "side", F.col("a").alias("node"), F.col("a").alias("label"))
    return left.unionByName(right)


def _verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link, by their token sets, which are made anew for the documents in question only."""
    spark = documents.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    firsts = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))  # before the join, copies are many
    ids = stored(firsts.join(wanted, "node", "left_semi"), "parity-ids")
    first = ids.select("doc_id").distinct().withColumnRenamed("doc_id", "first_id")
    if first.count() <= SENT_IDS:
        first = F.broadcast(first)
    chosen = documents.join(first, documents["doc_id"].eqNullSafe(F.col("first_id")), "left_semi")
    sets = chosen.select("text").mapInArrow(_set_batches, "node long, n long, data binary").dropDuplicates(["node"])
    found = stored(_compare(_star_tasks(pairs), sets.join(ids.select("node"), "node", "left_semi"), _exact_pairs).transform(_distinct), "parity-links")
    release(spark, ids)
    return found


def connected(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node in ``links`` (a, b)."""
    spark = links.sparkSession
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    last = labels
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = stored(moved.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        labels = moved.select("node", "label")
        done = moved.filter("label != old").isEmpty()
        release(spark, last, *([edges] if done else []))
        last = moved
        if done:
            labels.stored_at = moved.stored_at
            return labels


def components(documents: DataFrame) -> DataFrame:
    """doc_id, size of the shingle set, and component of every row."""
    with small_batches(documents.sparkSession):  # a row is a text, or a set of 8 bytes a shingle
        return _components(documents)


def _components(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    # a word has two characters at least with its space, a shingle begins at a word, and bands have at most KEYS_A_SHINGLE keys for it
    size = documents.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    width = key_bits(KEYS_A_SHINGLE * ((size[0] or 0) // 2 + size[1]))
    kept = "doc_id long, node long, n long, bits binary, keys binary"
    nodes = stored(documents.mapInArrow(lambda batches: _node_batches(batches, width), kept), "parity-nodes")
    full = nodes.filter("node is not null")
    bits = full.select("node", "n", F.col("bits").alias("data")).dropDuplicates(["node"])

    by_key = Window.partitionBy("key")
    keys = nodes.filter("keys is not null").select("node", "keys").mapInArrow(lambda batches: _key_batches(batches, width), "key long, node long")
    members = keys.repartition("key").dropDuplicates(["key", "node"]).withColumns({
        "together": F.count(F.lit(1)).over(by_key), "hub": F.min("node").over(by_key),
    }).filter("together > 1")
    members = stored(members, "parity-members")
    release(spark)

    stars = members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = stored(_distinct(_compare(_star_tasks(stars), bits, _hamming_pairs)), "parity-near")
    release(spark)
    links = _verified(documents, nodes, near)
    labels = connected(links)

    # blocks of three or more members that are not one component yet; what the hub links with is known
    open_members = (
        members.filter("together > 2 and node != hub").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        .withColumns({"low": F.min("label").over(by_key), "high": F.max("label").over(by_key)}).filter("low != high")
    )
    tasks = _group_tasks(open_members)
    release(spark, members)
    grown = stored(_compare(tasks, bits, _forest), "parity-forest")
    forest, marked = grown.filter("a != b"), grown.filter("a = b").select("task", F.col("a").alias("node"))
    release(spark)
    tried = near
    if not forest.isEmpty():
        more = _verified(documents, nodes, _distinct(forest).join(near, ["a", "b"], "left_anti"))
        both = stored(links.unionByName(more), "parity-links")
        release(spark, links, more, labels)
        links, labels = both, connected(both)
        tried = near.unionByName(_distinct(forest)).distinct()
    # where a pair of the forest does not link, other candidates of its task may still do so; members without any stay out
    failed = forest.join(links, ["a", "b"], "left_anti").select("task").distinct()
    met = marked.join(failed, "task", "left_semi")
    again = tasks.join(met, ["task", "node"], "left_semi").drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = stored(_distinct(_compare(again, bits, _hamming_pairs)).join(tried, ["a", "b"], "left_anti"), "parity-rest")
    release(spark, tasks, grown, near)
    if not rest.isEmpty():
        more = _verified(documents, nodes, rest)
        both = stored(links.unionByName(more), "parity-links")
        release(spark, links, more, labels)
        links, labels = both, connected(both)

    classes = full.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(labels, "node", "left")
    classes = classes.select("node", "first_id", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = stored(classes.join(least, "label").select("node", "component_id"), "parity-classes")
    rows = stored(nodes.select("doc_id", "node", F.col("n").alias("n_shingles")), "parity-rows")
    release(spark, links, labels, rest, nodes)
    return rows.join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _group_tasks(members: DataFrame) -> DataFrame:
    """Each block's members against each other: chunks of at most CHUNK, and tasks of two chunks.

    Blocks with the same members, of which copies of a passage give many, are compared once.
    """
    by_order = Window.partitionBy("key").orderBy("label", "node")
    placed = members.withColumn("chunk", F.floor((F.row_number().over(by_order) - 1) / CHUNK).cast("long"))
    chunks = placed.groupBy("key", "chunk").agg(
        F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"),
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("together").alias("together"),
    )
    chunks = stored(chunks.withColumn("sign", F.xxhash64("s1", "s2")).drop("s1", "s2"), "parity-chunks")
    other = chunks.select("key", *[F.col(c).alias(f"{c}2") for c in ("chunk", "sign", "low", "high")])
    pairs = chunks.join(other, "key").filter("chunk <= chunk2 and not (low = high and low2 = high2 and low = low2)")
    pairs = pairs.withColumn("task", F.xxhash64("sign", "sign2")).groupBy("task").agg(F.min(F.struct("key", "chunk", "chunk2")).alias("p"))
    pairs = pairs.select("task", "p.*")
    sides = pairs.select("task", "key", "chunk", F.when(F.col("chunk") == F.col("chunk2"), 2).otherwise(0).alias("side")).unionByName(
        pairs.filter("chunk != chunk2").select("task", "key", F.col("chunk2").alias("chunk"), F.lit(1).alias("side"))
    )
    found = placed.select("key", "chunk", "node", "label").join(sides, ["key", "chunk"]).select("task", "side", "node", "label")
    found = stored(found, "parity-tasks")
    release(members.sparkSession, chunks)
    return found


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, that of the least id, with all columns; rows without words stay."""
    found = components(documents).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(found.filter("kept").select(F.col("doc_id").alias("kept_id")).distinct(), "parity-kept")
    rows = documents.select(packed(documents), F.col("doc_id").cast("long").alias("id"))
    first = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("given.text"))))
    whole = first.filter(F.col("id").isNull() | (F.col("copy") == 1))
    chosen = whole.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return chosen.select(*[F.col("given")[c].alias(c) for c in documents.columns])
