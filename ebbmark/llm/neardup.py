"""Near-duplicates: MinHash with tensored banding, every link verified on full shingle sets.

Words are runs of bytes other than ASCII white space, A-Z lowered; a document's set holds its distinct shingles of five
words (fewer words: the whole sequence). Documents are linked where 100 * |intersection| >= 75 * |union|.

1. Each document gets 48 minhashes, in two collections of 12 pairs. A table's key joins one pair of either collection, so
   144 tables come from 24 pairs: documents of similarity 0.75 share a key with probability 0.9999. Keys with one document
   go early: a pair that no other document has makes no key.
2. Documents with equal sets become one.
3. In each bucket, documents with EQUAL of 48 minhashes are candidates, which hold documents together in families. The 12
   tables that share no pair go first; then all tables, but only buckets in which families still meet, so that a large group
   of copies isn't gone through 144 times.
4. In each family, candidates are verified on their full sets, by the texts, unless they are in one component already.

Steps 3 and 4 go through groups in the same way. A group is dealt in blocks of bounded size, each a key of its own in the
shuffle, so a large group is spread like all others. Within a block documents are compared in growing steps, and never with
one that they are connected to. Of a group with several blocks, one document of each component of each block goes through
the same again; then every document outside of the group's largest component is compared with all its blocks. So no pair
of documents is a row, no large group meets in a task, and none is dropped.

Null or empty texts, and texts without words, have an empty set and no links. Rows with a null id have no links. Rows of
one id are one node: it has the links of each of its texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrays, map_batches, text_of, written

WORDS = 5
#: Minhashes of a pair, pairs of a collection; tables: PAIRS * PAIRS.
ROWS, PAIRS = 2, 12
HASHES = 2 * PAIRS * ROWS
#: Similarity, as intersection >= LEAST / 100 * union.
LEAST = 75
#: Pairs with fewer equal minhashes of 48 are not candidates: at similarity 0.75 that has a probability of about 5e-6.
EQUAL = 21
#: Documents of a block of minhashes, and bytes of text in a block of texts; each document counts as OVERHEAD bytes besides.
BLOCK, BLOCK_BYTES, OVERHEAD = 4096, 8 << 20, 256
#: Candidates of a document from which on an index of its block is asked.
MANY = 16
#: Documents that the components of a task hold before they are written as links.
HELD = 200_000

_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64((int(_random.integers(1, 2**61)) * 8 + 3) % 2**64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIN = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    if len(words) < WORDS:
        return _mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = words[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += words[k : n + k] * _PLACE[k]
    return np.unique(_mix(total))


def minhashes(found: np.ndarray) -> np.ndarray:
    """16 bits of each minhash."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for a in range(0, len(found), 1024):
        least = np.minimum(least, (found[None, a : a + 1024] * _MIN[:, None]).min(axis=1))
    return (least >> np.uint64(24)).astype(np.uint16)


def linked(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    return 100 * common >= LEAST * (a + b - common)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, mark (a hash of the text, to find it again), n_shingles, and for sets that aren't empty a digest, the minhashes, and their pairs as integers."""
    types = {"key": pa.int64(), "mark": pa.int64(), "bytes": pa.int64(), "n_shingles": pa.int64(), "digest": pa.string(), "sketch": pa.binary(), "halves": pa.list_(pa.int32())}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, sketch, halves = [], [], [], []
        for x in batch.column("text").to_pylist():
            found = shingles(x)
            least = minhashes(found) if len(found) else None
            n.append(len(found))
            digest.append(f"{int(found.sum(dtype=np.uint64)):016x}{int(_mix(found).sum(dtype=np.uint64)):016x}" if len(found) else None)
            sketch.append(None if least is None else least.tobytes())
            halves.append(None if least is None else least.view(np.int32))
        return arrays(types, {"key": batch.column("key").to_pylist(), "mark": batch.column("mark").to_pylist(), "bytes": [len(x) for x in batch.column("text").to_pylist()], "n_shingles": n, "digest": digest, "sketch": sketch, "halves": halves})

    return map_batches(_marked(docs, key, text), run, "key long, mark long, bytes long, n_shingles long, digest string, sketch binary, halves array<int>", rows=256)


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))


def shared_halves(nodes: DataFrame) -> DataFrame:
    """(id, first, second): of nodes (id, halves) the pairs of either collection, as (k, h), that another document has too."""
    halves = nodes.select("id", F.posexplode("halves").alias("k", "h"))
    shared = halves.groupBy("k", "h").agg(F.count("*").alias("n")).filter("n > 1").select("k", "h")
    side = lambda low: F.filter("halves", lambda x: (x["k"] < PAIRS) == F.lit(low))
    mine = halves.join(shared.hint("merge"), ["k", "h"]).groupBy("id").agg(F.collect_list(F.struct("k", "h")).alias("halves"))  # at most 24 for an id
    return mine.select("id", side(True).alias("first"), side(False).alias("second"))


def bucket_rows(mine: DataFrame, whole: bool) -> DataFrame:
    """(bucket, n, id, label) for all buckets in which several labels meet, each set of members once. mine: id, label, first, second. whole: of all tables, else of the 12 that join the k-th pairs."""
    same = lambda a, b: F.lit(True) if whole else a["k"] + PAIRS == b["k"]
    key = lambda a, b: F.xxhash64(a["k"], b["k"], a["h"], b["h"])
    keys = F.flatten(F.transform("first", lambda a: F.transform(F.filter("second", lambda b: same(a, b)), lambda b: key(a, b))))
    rows = mine.select("id", "label", F.explode(keys).alias("bucket"))
    sums = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.min("id").alias("least"), F.max("id").alias("most"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    once = sums.filter("low < high").groupBy("n", "s", "least", "most").agg(F.min("bucket").alias("bucket"))
    return rows.join(once.select("bucket", "n").hint("merge"), "bucket").select("bucket", "n", "id", "label")


class _Forest:
    """Union-find; a root is the least of its tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self, nodes: list[int]) -> np.ndarray:
        return np.array([self.root(x) for x in nodes], np.int64)

    def links(self) -> list[tuple[int, int]]:
        """The root of each node that isn't one, with the node."""
        return [(self.root(x), x) for x in list(self.up) if self.up[x] != x]


class _Members:
    """Documents of a block; their sets are made when they are first needed. Without texts, minhashes decide."""

    def __init__(self, rows: list[dict]):
        self.rows, self.nodes, self.sets = rows, [r["node"] for r in rows], {}
        self.sizes = np.array([r["size"] for r in rows], np.int64)
        self.sketch = np.frombuffer(b"".join(r["sketch"] for r in rows) or bytearray(), np.uint16).reshape(len(rows), HASHES)
        self.texts = bool(rows) and rows[0]["text"] is not None
        self.index: tuple[np.ndarray, ...] | None = None

    def set_of(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = shingles(self.rows[k]["text"])
        return self.sets[k]

    def common(self, mine: np.ndarray) -> np.ndarray:
        """How many shingles each document shares with a set, by an index of all."""
        if self.index is None:
            sets = [self.set_of(k) for k in range(len(self.rows))]
            all_, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(all_, kind="stable")
            words, starts = np.unique(all_[order], return_index=True)
            self.index = words, np.append(starts, len(all_)), of[order]
        words, starts, of = self.index
        at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
        at = at[words[at] == mine]
        found = [of[a:b] for a, b in zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(found), minlength=len(self.rows)) if found else np.zeros(len(self.rows), np.int64)


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """Ranges below n that grow from one to 256: what the first ones connect, later ones need not compare."""
    a, width = 0, 1 if n > 16 else 16
    while a < n:
        yield a, min(n, a + width)
        a, width = a + width, min(256, 2 * width)


def _candidates(left: _Members, a: int, b: int, right: _Members, forest: _Forest, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left between a and b, j of right) that may be linked and aren't connected, by i, the most similar first. same: left is right, each pair once."""
    n, m = left.sizes[a:b, None], right.sizes[None, :]
    apart = forest.roots(left.nodes[a:b])[:, None] != forest.roots(right.nodes)[None, :]
    i, j = np.nonzero(apart & (100 * n >= LEAST * m) & (100 * m >= LEAST * n))
    i += a
    if same:
        i, j = i[j > i], j[j > i]
    equal = np.concatenate([(left.sketch[i[k : k + 100_000]] == right.sketch[j[k : k + 100_000]]).sum(axis=1) for k in range(0, len(i), 100_000)] or [np.zeros(0, np.int64)])
    at = np.flatnonzero(equal >= EQUAL)
    at = at[np.lexsort((-equal[at], i[at]))]
    return i[at], j[at]


def _connect(forest: _Forest, left: _Members, right: _Members, same: bool) -> None:
    """Joins what is linked: by full sets, or where there are no texts all candidates."""
    for a, b in _steps(len(left.nodes)):
        i, j = _candidates(left, a, b, right, forest, same)
        if not left.texts:
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(left.nodes[x], right.nodes[y])
            continue
        ends = np.flatnonzero(np.diff(i, append=-1)) + 1
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(i) else ():
            x, mine = int(i[start]), left.set_of(int(i[start]))
            common = right.common(mine) if end - start > MANY else None
            for y in j[start:end].tolist():
                if forest.root(left.nodes[x]) != forest.root(right.nodes[y]):
                    n = int(common[y]) if common is not None else len(np.intersect1d(mine, right.set_of(y), assume_unique=True))
                    if linked(n, len(mine), int(right.sizes[y])):
                        forest.join(left.nodes[x], right.nodes[y])


_MEMBER = pa.struct([("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("text", pa.string()), ("tree", pa.int64())])
_TREE = pa.struct([("tree", pa.int64()), ("m", pa.int64())])
_CUT = "a long, b long, group long, members array<struct<node:long,size:long,sketch:binary,text:string,tree:long>>, trees array<struct<tree:long,m:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and block. Blocks are gone through one by one: links (a, b), each from a component's least document; and of groups of several blocks the members, each with its component in the block, and the sizes of these."""
    types = {"a": pa.int64(), "b": pa.int64(), "group": pa.int64(), "members": pa.list_(_MEMBER), "trees": pa.list_(_TREE)}
    forest, held, now = _Forest(), [], None

    def links() -> Iterator[pa.RecordBatch]:
        if found := forest.links():
            nothing = [None] * len(found)
            yield arrays(types, {"a": [x for x, _ in found], "b": [y for _, y in found], "group": nothing, "members": nothing, "trees": nothing})
        forest.up.clear()

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            block = _Members(held)
            _connect(forest, block, block, True)
            if now[2] > 1:
                first: dict[int, int] = {}
                for row in held:
                    row["tree"] = first.setdefault(forest.root(row["node"]), row["node"])
                trees = [{"tree": tree, "m": m} for tree, m in Counter(row["tree"] for row in held).items()]
                yield arrays(types, {"a": [None], "b": [None], "group": [now[0]], "members": [held], "trees": [trees]})
            if len(forest.up) > HELD:
                yield from links()

    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            for row in batch.slice(a, 64).to_pylist():
                if (row["group"], row["block"], row["blocks"]) != now:
                    yield from done()
                    held, now = [], (row["group"], row["block"], row["blocks"])
                held.append({"node": row["node"], "size": row["size"], "sketch": row["sketch"], "text": row["text"]})
    yield from done()
    yield from links()


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that ask against all of another block, each under its component's label: links between labels."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = []
            for rows, labels in (("asks", "own_labels"), ("members", "labels")):
                label = {x["tree"]: x["label"] for x in batch.column(labels)[k].as_py()}
                sides.append(_Members([row | {"node": label[row["tree"]]} for row in batch.column(rows)[k].as_py()]))
            forest = _Forest()
            _connect(forest, *sides, False)
            found = forest.links()
            yield arrays({"a": pa.int64(), "b": pa.int64()}, {"a": [x for x, _ in found], "b": [y for _, y in found]})


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The links that blocks give, and the blocks of groups that have several: None where no group has."""
    dealt = rows.select("group", "blocks", F.pmod("place", "blocks").alias("block"), "node", "size", "sketch", "text")
    cut = written(dealt.repartition("group", "block").sortWithinPartitions("group", "block").mapInArrow(_cut, _CUT))
    parts = cut.filter("members IS NOT NULL")
    return cut.filter("members IS NULL").select("a", "b"), None if parts.isEmpty() else parts.select("group", "members", "trees")


def in_blocks(size, limit: int):
    """How many blocks of limit bytes a group of that size has."""
    return F.greatest(F.lit(1), F.ceil(size / limit)).cast("long")


def group_components(rows: DataFrame, limit: int, links: DataFrame | None = None) -> DataFrame:
    """(id, component): what the linked documents of all groups, and other links, connect; ids without a link are left out. rows: group, blocks (how many it has), place (a hash that deals its rows), node, size, sketch, text (null: by minhashes alone). limit: bytes of a block."""
    found, parts = _blocks(rows)
    links = found if links is None else found.unionAll(links)
    if parts is None:
        return components(links)
    blocks = written(parts.withColumn("block", F.monotonically_increasing_id()))
    # One document of each component of a block stands for it, as long as that makes them many fewer.
    deeper = blocks
    while deeper is not None:
        few = deeper.select("group", F.explode(F.filter("members", lambda m: m["node"] == m["tree"])).alias("m")).select("group", "m.*").drop("tree")
        if 2 * few.count() > deeper.agg(F.sum(F.size("members"))).head()[0]:
            break
        counts = few.groupBy("group").agg(in_blocks(F.sum(F.length(F.coalesce("text", F.lit(""))) + OVERHEAD), limit).alias("blocks"))
        found, deeper = _blocks(few.withColumn("place", F.xxhash64("node")).join(counts.hint("merge"), "group"))
        links = links.unionAll(found)
    labels = components(links)
    # Labels are looked up for the components of blocks, of which there are few, not for all members.
    trees = blocks.select("group", "block", F.explode("trees").alias("t")).select("group", "block", "t.*")
    known = trees.join(labels.hint("merge"), F.col("tree") == F.col("id"), "left").select("group", "block", "tree", "m", F.coalesce("component", "tree").alias("label"))
    sums = known.groupBy("group", "label").agg(F.sum("m").alias("m"))
    open_ = sums.groupBy("group").agg(F.max(F.struct("m", "label"))["label"].alias("largest"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    named = known.join(open_.hint("merge"), "group").groupBy("group", "block", "largest").agg(F.collect_list(F.struct("tree", "label")).alias("labels"))
    shown = written(named.join(blocks.select("block", "members").hint("merge"), "block"))
    # Pairs of different components have a document outside of the largest one: that one asks, in all blocks but its own.
    outside = F.transform(F.filter("labels", lambda x: x["label"] != F.col("largest")), lambda x: x["tree"])
    asking = shown.select(F.col("block").alias("own"), F.col("labels").alias("own_labels"), F.filter("members", lambda m: F.array_contains(outside, m["tree"])).alias("asks")).filter(F.size("asks") > 0)
    names = shown.select("group", "block")
    aimed = names.withColumnRenamed("block", "own").join(names.hint("merge"), "group").filter("own <> block").select("own", "block")
    met = asking.join(aimed.hint("merge"), "own").join(shown.select("block", "members", "labels").hint("merge"), "block").select("asks", "own_labels", "members", "labels")
    crossed = written(met.mapInArrow(_cross, "a long, b long"))
    return labels if crossed.isEmpty() else components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(crossed))


def family_labels(nodes: DataFrame) -> DataFrame:
    """Of nodes (id, sketch, halves, ..) those that are candidates with another one, with component: the family that candidates hold together."""
    mine = written(shared_halves(nodes))

    def merged(labelled: DataFrame, whole: bool, links: DataFrame | None) -> DataFrame:
        buckets = bucket_rows(labelled, whole).join(nodes.select("id", "sketch", "size").hint("merge"), "id")
        blocks = in_blocks(F.col("n") * OVERHEAD, BLOCK * OVERHEAD)
        rows = buckets.select(F.col("bucket").alias("group"), blocks.alias("blocks"), F.xxhash64("id").alias("place"), F.col("label").alias("node"), "size", "sketch", F.lit(None).cast("string").alias("text"))
        return group_components(rows, BLOCK * OVERHEAD, links)

    first = merged(mine.withColumn("label", F.col("id")), False, None)
    labelled = written(mine.join(first.hint("merge"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))
    last = merged(labelled, True, first.select(F.col("component").alias("a"), F.col("id").alias("b")))
    return written(nodes.drop("digest", "halves").join(last.hint("merge"), "id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (smallest key reachable), kept (key is component_id)."""
    rows = written(sketches(docs, key, text))
    whole = rows.filter("key IS NOT NULL AND digest IS NOT NULL")
    classes = whole.groupBy("digest", "n_shingles").agg(F.min(F.struct("key", "mark", "bytes")).alias("one"), F.first("sketch").alias("sketch"), F.first("halves").alias("halves"), F.count("*").alias("copies"))
    nodes = written(classes.select("digest", F.col("n_shingles").alias("size"), "one.*", "sketch", "halves", "copies").withColumn("id", F.monotonically_increasing_id()))
    families = family_labels(nodes)
    counts = families.groupBy("component").agg(in_blocks(F.sum(F.col("bytes") + OVERHEAD), BLOCK_BYTES).alias("blocks"))
    wanted = families.join(counts.hint("merge"), "component")
    found = written(_marked(docs, key, text).join(wanted.hint("merge"), ["key", "mark"]))
    texts = found.filter("copies = 1").unionAll(found.filter("copies > 1").dropDuplicates(["id"]))  # rows may be repeated
    node_of = rows.select("key", "digest", "n_shingles").join(nodes.select("digest", F.col("size").alias("n_shingles"), F.col("key").alias("node")).hint("merge"), ["digest", "n_shingles"], "left")
    several = whole.groupBy("key").agg(F.min(F.struct("digest", "n_shingles")).alias("a"), F.max(F.struct("digest", "n_shingles")).alias("z")).filter("a <> z").select("key")
    same = None
    if not several.isEmpty():  # keys with several texts
        same = node_of.filter("node < key").join(several.hint("merge"), "key").select(F.col("node").alias("a"), F.col("key").alias("b"))
    final = group_components(texts.select(F.col("component").alias("group"), "blocks", F.xxhash64("id").alias("place"), F.col("key").alias("node"), "size", "sketch", "text"), BLOCK_BYTES, same)
    out = node_of.join(final.hint("merge"), node_of.node == final.id, "left").withColumn("component_id", F.when(F.col("key").isNotNull(), F.coalesce("component", "node", "key")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller key. Rows of an equal key stay together."""
    dropped = near_duplicates(docs, key, text).filter("NOT kept").select(F.col(key).alias("__key")).distinct()
    return docs.join(dropped.hint("merge"), F.col(key) == F.col("__key"), "left_anti")
