"""SimHash near-duplicates: fingerprints, a binary trie self-join on them, and the groups its links make."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landheat.llm.common import slices, text_key, written

BITS = 64
#: First bit of each third of a fingerprint. Four differing bits leave at most one in some third.
THIRDS = (0, 21, 42)
#: Distinct fingerprints that one trie node should hold, and the most that one task takes at once.
NODE_ROWS, CELL_ROWS = 2048, 65536
#: Rows of one fingerprint from which its group's id is broadcast to them.
HOT_ROWS = 1_000_000
#: Node pairs and fingerprint pairs that are looked at together.
FRONTIER, LEAF_PAIRS = 1 << 17, 32


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of `words` words (fewer words: the whole sequence; none: 0)."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    begins = (stops - lengths)[:n].tolist()
    ends = stops[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(begins, ends)], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        prints = np.fromiter((fingerprint(t or b"", words, seed) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], names=[*batch.schema.names[1:], "fingerprint"])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carried, fingerprint long) of every whole text; A-Z are lower-cased, words end at ASCII white space."""
    rows = docs.select("text", *carried)
    kinds = [f"{c} {dict(rows.dtypes)[c]}" for c in carried]
    return rows.mapInArrow(partial(_fingerprints, words=words, seed=seed), ", ".join([*kinds, "fingerprint long"]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the groups of a[i] and b[i]; label holds the smallest index of each group."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def _turned(prints: np.ndarray, by: int) -> np.ndarray:
    return prints if not by else (prints << np.uint64(by)) | (prints >> np.uint64(BITS - by))


def _middle(values: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at `depth` turns 1 in the sorted values of the nodes that begin at low."""
    kept = np.uint64(0) if depth == 0 else (values[low] >> np.uint64(BITS - depth)) << np.uint64(BITS - depth)
    return np.searchsorted(values, kept | np.uint64(1 << (BITS - 1 - depth)))


def trie_links(values: np.ndarray, others: np.ndarray | None, label: np.ndarray, depth: int, used: int, head: int, head_budget: int, budget: int, shift: int = 0) -> np.ndarray:
    """Walks pairs of trie nodes together and unites what is within the budget; returns the labels.

    values: sorted fingerprints of one trie; others: those of a second one, or None to join the first with itself.
    Both begin at `depth`, with `used` differing bits above it. Differing bits are added up bit by bit: a pair of nodes
    is dropped as soon as it has over head_budget of them in the first `head` bits, or over `budget` in all. Index i of
    others has the label at shift + i. Small node pairs are compared directly, larger ones are opened in chunks.
    """
    same, right, left = others is None, values if others is None else others, budget - used
    if not len(values) or not len(right):
        return label
    first = lambda *x: [np.array([v], np.int64) for v in x]
    stack = [(depth, *first(0, len(values), 0, len(right), used))]
    while stack:
        depth, al, ah, bl, bh, acc = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, al[:half], ah[:half], bl[:half], bh[:half], acc[:half]), (depth, al[half:], ah[half:], bl[half:], bh[half:], acc[half:])]
            continue
        small = ((ah - al) * (bh - bl) <= LEAF_PAIRS) | (depth == BITS)
        if small.any():
            a, na, b, nb = al[small], (ah - al)[small], bl[small], (bh - bl)[small]
            pairs = na * nb
            ends = np.cumsum(pairs)
            for lo, hi in _runs(ends, FRONTIER * 8):
                n = pairs[lo:hi]
                node = np.repeat(np.arange(lo, hi), n)
                place = np.arange(n.sum()) - np.repeat(ends[lo:hi] - n - (ends[lo] - pairs[lo]), n)
                i, j = a[node] + place // nb[node], b[node] + place % nb[node]
                near = label[i] != label[shift + j]
                i, j = i[near], j[near]
                near = np.bitwise_count(values[i] ^ right[j]) <= left
                label = unite(label, i[near], shift + j[near])
        go = ~small
        if not go.any():
            continue
        al, ah, bl, bh, acc = al[go], ah[go], bl[go], bh[go], acc[go]
        am, bm = _middle(values, al, depth), _middle(right, bl, depth)
        am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
        twin = np.full(len(al), same) & (al == bl) & (ah == bh)
        kids = [(al, am, bl, bm, acc), (am, ah, bm, bh, acc), (al, am, bm, bh, acc + 1), tuple(x[~twin] for x in (am, ah, bl, bm, acc + 1))]
        al, ah, bl, bh, acc = (np.concatenate(x) for x in zip(*kids))
        keep = (ah > al) & (bh > bl) & (acc <= (head_budget if depth < head else budget))
        stack.append((depth + 1, *(x[keep] for x in (al, ah, bl, bh, acc))))
    return label


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose pairs add up to about `most` each."""
    lo, base = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, base + most)))
        yield lo, hi
        lo, base = hi, int(ends[hi - 1])


def node_links(rows: pd.DataFrame, depth: int, budget: int) -> pd.DataFrame:
    """Links of one trie node: its own fingerprints with one another and with guests from nodes one bit away."""
    which = int(rows["third"].iloc[0])
    by, node = THIRDS[which], np.uint64(rows["node"].iloc[0])
    head = ((*THIRDS[1:], BITS)[which]) - by
    turned = np.unique(_turned(rows["fingerprint"].to_numpy(np.int64).view(np.uint64), by))
    own = (turned >> np.uint64(BITS - depth)) == node if depth else np.ones(len(turned), bool)
    mine, guests = turned[own], turned[~own]
    low = np.uint64((1 << (BITS - depth)) - 1)
    guests = guests[np.argsort(guests & low)]
    label = np.arange(len(turned))
    # below the node's own depth only the lower bits tell fingerprints apart, whatever node they come from
    label = trie_links(mine & low, None, label, depth, 0, head, 1, budget)
    label = trie_links(mine & low, guests & low, label, depth, 1, head, 1, budget, len(mine))
    every = np.concatenate([mine, guests])
    moved = np.flatnonzero(label != np.arange(len(every)))
    back = lambda x: _turned(x, (BITS - by) % BITS).view(np.int64)
    return pd.DataFrame({"a": back(every[moved]), "b": back(every[label[moved]])})


def trie_self_join(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to join all that are within `budget` bits.

    Three tries, one per third of the bits, hold that third first. Two fingerprints with at most four differing bits
    have at most one in some third, so that trie's walk allows one there and `budget` in all. Tries are cut at a depth
    that grows with the number of fingerprints; a fingerprint goes to its node and, as a guest, to the nodes that
    lack one of its bits there. Nodes with too many rows are dealt over pairs of cells, so no task holds more than
    about two cells. Within a node only a spanning forest is returned, so copies never expand to all pairs.
    """
    if not 0 <= budget <= 5:
        raise ValueError("thirds with one free bit each find at most five differing bits")
    n = prints.count()
    depth = min(21, max(0, (max(n, 1) // NODE_ROWS).bit_length()))
    f = F.col("fingerprint")
    rows = []
    for third, by in enumerate(THIRDS):
        turned = f if not by else F.shiftleft(f, by).bitwiseOR(F.shiftrightunsigned(f, BITS - by))
        node = F.shiftrightunsigned(turned, BITS - depth) if depth else F.lit(0).cast("long")
        rows.append(prints.select(F.lit(third).alias("third"), node.alias("own"), "fingerprint"))
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2])
    homes = [F.col("own"), *(F.when(F.shiftright("own", k).bitwiseAND(1) == 1, F.col("own") - (1 << k)) for k in range(depth))]
    rows = rows.select("third", F.explode(F.array_compact(F.array(*homes))).alias("node"), "fingerprint")
    sizes = rows.groupBy("third", "node").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells"))
    large = written(sizes.filter("cells > 1"), "trie-large")
    rows = rows.join(large, ["third", "node"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("cells")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda k: F.least(k, mine) * F.col("cells") + F.greatest(k, mine))
    rows = rows.withColumn("cell", F.explode(F.array_distinct(both))).select("third", "node", "cell", "fingerprint")
    links = rows.groupBy("third", "node", "cell").applyInPandas(partial(node_links, depth=depth, budget=budget), "a long, b long")
    return links


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component, by alternating large and small stars.

    Each step is a minimum per node joined back, written to the shared folder; it ends when no link changes.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(b > a).join(lowest, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(a.alias("node"), b.alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, budget: int = 4, words: int = 4, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fingerprint string, component_id): one row per document, with the smallest doc_id it is linked to.

    Null and empty texts have fingerprint zero and link like any other; a null doc_id keeps its row and never becomes
    an id of a group that has others; repeated rows give repeated rows; texts of any length are read whole; ties of
    bits (set in exactly half of the hashes) count as not set; an empty table gives no rows; other columns are ignored,
    whatever their names. Fingerprints of over hot_rows rows, of which there can't be many, are broadcast; so no task
    has to join all rows of one group of copies.
    """
    prints = written(fingerprints(docs, words, seed), "fingerprints")
    one = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    one = rooted(one, budget)
    lowest = one.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = written(one.join(lowest, "root").select("fingerprint", "component_id", "n"), "known")
    hot, others = known.filter(F.col("n") > hot_rows), known.filter(F.col("n") <= hot_rows).select("fingerprint", "component_id")
    of_hot = prints.join(F.broadcast(hot), "fingerprint").select("doc_id", "fingerprint", "component_id")
    found = prints.join(F.broadcast(hot), "fingerprint", "left_anti").join(others, "fingerprint").select("doc_id", "fingerprint", "component_id")
    return found.unionByName(of_hot).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(one: DataFrame, budget: int) -> DataFrame:
    """Adds root to a written table of distinct fingerprints: the smallest one of each one's component."""
    roots = components(trie_self_join(one.select("fingerprint"), budget)).withColumnRenamed("node", "fingerprint")
    return one.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def deduplicated(docs: DataFrame, budget: int = 4, words: int = 4, seed: int = 42, keep_unnamed: bool = True) -> DataFrame:
    """The documents without near-duplicates: one row of each group stays, as it is, and every group has one.

    With keep_unnamed, rows without a doc_id all stay, since nothing else can name them, and each group among the others
    has one; without it they are judged like any other.

    That is the row with the smallest doc_id (null last), then the smallest hash of its text, then the smallest values;
    so rows that share a doc_id are judged each by its own text, and those without one are no exception. Null and empty
    texts are one group; an empty table stays empty; columns of any name are kept, but must be of kinds that Spark can
    order. Fingerprints and repeated rows are reduced in each partition first, so copies never meet in one task.
    """
    if keep_unnamed:
        named = deduplicated(docs.filter("doc_id is not null"), budget, words, seed, keep_unnamed=False)
        return named.unionByName(docs.filter("doc_id is null"))
    mark = F.xxhash64("text").alias("__mark")
    prints = fingerprints(docs.select("text", F.col("doc_id").alias("__id"), mark), words, seed, ("__id", "__mark"))
    first = F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__mark")).alias("first")
    one = rooted(written(prints.groupBy("fingerprint").agg(first), "distinct-fingerprints"), budget)
    keep = one.groupBy("root").agg(F.min("first").alias("first")).select(text_key("first.__id").alias("__key"), "first.__mark").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), text_key("doc_id").alias("__key"), mark)
    rows = rows.groupBy("__key", "__mark").agg(F.min("__row").alias("__row"))
    return rows.join(keep, ["__key", "__mark"], "left_semi").select("__row.*")
