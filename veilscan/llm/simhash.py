"""SimHash near-duplicates with BK-trees.

A text's fingerprint has a bit for each of 64 positions that is set in over half the XXH64 hashes of its word shingles, repeats included. Two
fingerprints link if they differ in at most RADIUS bits.

The search runs over distinct fingerprints. Those within RADIUS bits agree on at least one of RADIUS + 1 blocks of bits, so each
fingerprint stands under RADIUS + 1 keys (a block and its bits). A key with more than TREE fingerprints is split again over the bits that it
leaves free, which halts by itself: TREE fingerprints cannot be exceeded by so few free bits. Keys are dealt to shards of bounded size. In
a shard each key has a BK-tree, whose children are keyed by their integer Hamming distance to the parent. Shard trees are rows of a
table; they are joined to blocks of the shard's fingerprints as queries, so that Spark broadcasts the table of trees where it is
small and shuffles it where it is not. A query at distance d of a node follows only the edges d - RADIUS to d + RADIUS.

* Null, empty and wordless texts have fingerprint zero, which links like any other. Shorter texts are one shingle. A-Z count as a-z.
* Texts are read in segments, so a very long one takes no more memory than its bytes.
* Rows that share an id are one document with several fingerprints, linked with each other. Rows without an id get a fingerprint but
  no component, and link nothing.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import settle
from veilscan.llm.components import components

WORDS = 3
SEED = 42
BITS = 64
RADIUS = 2
#: Fingerprints under a key at most; fingerprints of a shard, about.
TREE = 1 << 12
SHARD = 1 << 12
#: Blocks in which a shard's fingerprints are queries to its trees.
QUERY_BLOCKS = 4
#: Pairs of a query and a node that are looked at in one step.
AT_ONCE = 1 << 20
#: Bytes of a text that are cut into words at a time, and shingles hashed at a time.
SEGMENT = 1 << 20
HASHED = 1 << 14

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# ---- fingerprints


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words in runs of at least WORDS; a run begins with the last WORDS - 1 words of the one before. Fewer words are one run."""
    start, carried, yielded = 0, [], False
    while start < len(data):
        cut = _BLANK.search(data, start + SEGMENT) if start + SEGMENT < len(data) else None
        end = cut.start() if cut else len(data)
        carried += data[start:end].split()
        if len(carried) >= WORDS:
            yield carried
            carried, yielded = carried[1 - WORDS :], True
        start = end
    if carried and not yielded:
        yield carried


def _bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many shingles of the words have each bit set, highest bit first, and how many shingles there are."""
    total, n = np.zeros(BITS, np.int64), max(1, len(words) - WORDS + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(begins[:n].tolist(), ends[-n:].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, HASHED):
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans[k : k + HASHED]], ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return total, n


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned integer."""
    total, n = np.zeros(BITS, np.int64), 0
    for words in _word_runs((text or "").encode().lower()):
        counts, shingles = _bit_counts(words)
        total, n = total + counts, n + shingles
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])


# ---- keys


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def blocks(mask: int) -> list[int]:
    """The mask with each of RADIUS + 1 blocks of the bits that it leaves free. Prints that differ in RADIUS of those agree on a block."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = np.array_split(free, RADIUS + 1)
    return [mask | sum(1 << int(b) for b in cut) for cut in cuts]


def _under(prints: DataFrame, masks: Column) -> DataFrame:
    """Each print under its keys: a mask, and the bits that it has there."""
    return prints.withColumn("mask", F.explode(masks)).withColumn("bits", F.col("print").bitwiseAND(F.col("mask")))


def _keyed(prints: DataFrame) -> DataFrame:
    """mask, bits, print, id: prints under keys that several share, none with more than TREE of them."""
    found, masks = None, [0]
    rows = prints.withColumn("mask", F.lit(0).cast("long"))
    while True:
        below = F.create_map(*[x for m in masks for x in (_long(m), F.array(*map(_long, blocks(m))))])
        rows = _under(rows, below[F.col("mask")]).select("mask", "bits", "print", "id")
        rows = settle(rows if found is None else rows.distinct(), "keys")  # several splits lead to one mask
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
        shared = settle(rows.join(sizes, ["mask", "bits"]), "shared")
        fitting, rows = shared.where(F.col("n") <= TREE).drop("n"), shared.where(F.col("n") > TREE).drop("n")
        found = fitting if found is None else found.unionByName(fitting)
        masks = list(dict.fromkeys(b for m in masks for b in blocks(m)))
        if rows.isEmpty():
            return found


# ---- trees

_STRIDE = BITS + 1 + 2 * RADIUS


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)]


def grown(prints: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over the prints, one for each key; keys are 0, 1, 2, ... in ascending order. Gives the root of each, and the edges: codes of
    (parent, distance) in ascending order, and the child that each leads to."""
    roots, waiting, group = np.flatnonzero(_firsts(key)), np.arange(len(key)), key
    codes, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(waiting):
        first = _firsts(group)
        parent = waiting[first][np.cumsum(first) - 1][~first]
        waiting = waiting[~first]
        code = _code(parent, np.bitwise_count(prints[waiting] ^ prints[parent]))
        order = np.argsort(code, kind="stable")
        group, waiting = code[order], waiting[order]
        first = _firsts(group)
        codes.append(group[first])
        children.append(waiting[first])
    code, child = np.concatenate(codes), np.concatenate(children)
    order = np.argsort(code)
    return roots, code[order], child[order]


def _code(node: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return node * _STRIDE + RADIUS + distance


def within(queries: np.ndarray, roots: np.ndarray, prints: np.ndarray, codes: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) at most RADIUS apart, each query from its root on."""
    query, node = np.arange(len(queries)), roots
    found = [(query[:0], node[:0])]
    while len(query):
        distance = np.bitwise_count(queries[query] ^ prints[node]).astype(np.int64)
        hit = distance <= RADIUS
        found.append((query[hit], node[hit]))
        edge = (_code(node, distance)[:, None] + np.arange(-RADIUS, RADIUS + 1)).ravel()
        at = np.minimum(np.searchsorted(codes, edge), len(codes) - 1)
        there = codes[at] == edge if len(codes) else np.zeros(len(edge), bool)
        query, node = np.repeat(query, 2 * RADIUS + 1)[there], children[at[there]]
    return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges with the same components: each node to the least that the given ones reach."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(names))
    return names[far], names[low[far]]


_TREE = "shard long, masks array<long>, bits array<long>, roots array<long>, prints array<long>, ids array<long>, codes array<long>, children array<long>"


def _tree(key, rows):
    """The trees of a shard's keys, as one row."""
    import pandas as pd

    rows = rows.sort_values(["mask", "bits", "print"])
    own = rows[["mask", "bits"]].to_numpy()
    first = np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])
    prints = rows["print"].to_numpy()
    roots, codes, children = grown(prints.view(np.uint64), np.cumsum(first) - 1)
    parts = [own[first, 0], own[first, 1], roots, prints, rows["id"].to_numpy(), codes, children]
    return pd.DataFrame([[key[0], *parts]], columns=["shard", "masks", "bits", "roots", "prints", "ids", "codes", "children"])


def _links(table: pa.Table) -> pa.Table:
    """Of a shard's trees and one block of queries: links that join what the near pairs join."""
    row = table.to_pylist()[0]
    masks, bits, roots, prints, ids, codes, children = (np.array(row[k], np.int64) for k in ("masks", "bits", "roots", "prints", "ids", "codes", "children"))
    asked = {k: np.array([q[k] for q in row["queries"]], np.int64) for k in ("mask", "bits", "print", "id")}
    root_of = dict(zip(zip(masks.tolist(), bits.tolist(), strict=True), roots.tolist(), strict=True))
    start = np.array([root_of[k] for k in zip(asked["mask"].tolist(), asked["bits"].tolist(), strict=True)], np.int64)
    step = max(1, AT_ONCE // TREE)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(0, len(start), step):
        query, node = within(asked["print"][k : k + step].view(np.uint64), start[k : k + step], prints.view(np.uint64), codes, children)
        x, y = asked["id"][k + query], ids[node]
        a, b = spanned(np.concatenate([a, x[x != y]]), np.concatenate([b, y[x != y]]))
    return pa.table({"a": a, "b": b})


def links(prints: DataFrame) -> DataFrame:
    """a, b: ids of prints at most RADIUS bits apart, enough of them to join what links. ``prints``: print and id, distinct prints."""
    keyed = settle(_keyed(prints), "keyed")
    shards = max(1, -(-keyed.count() // SHARD))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("mask", "bits"), F.lit(shards)))
    trees = settle(keyed.groupBy("shard").applyInPandas(_tree, _TREE), "trees")
    query = F.collect_list(F.struct("mask", "bits", "print", "id")).alias("queries")
    asked = keyed.groupBy("shard", F.pmod(F.xxhash64("print"), F.lit(QUERY_BLOCKS)).alias("block")).agg(query)
    return asked.join(trees, "shard").groupBy("shard", "block").applyInArrow(_links, "a long, b long")


# ---- documents


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = settle(own.mapInArrow(_fingerprints, "doc_id long, print long"), "prints")
    with_id = prints.where("doc_id is not null")
    nodes = settle(with_id.groupBy("print").agg(F.min("doc_id").alias("id")), "nodes")
    placed = with_id.join(nodes, "print").select("doc_id", "id")
    several = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("high")).where("a <> high")
    same_id = placed.join(several, "doc_id").select("a", F.col("id").alias("b"))
    labels = components(links(nodes).unionByName(same_id)).toDF("id", "component")
    found = nodes.join(labels, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    text = F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint")
    known = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(found, "print", "left").select("doc_id", text, known)
