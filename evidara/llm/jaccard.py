"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-gram incidence.

A document's set holds the 64-bit hashes of its distinct n-word shingles (of all its words as one where it has fewer than n).
Documents with equal sets are one class; a row of the incidence matrix is a class, a column a hash.

1. Heads. Two sets with Jaccard similarity t or more share at least ceil(t * n) hashes for either size n, so of the first
   n - ceil(t * n) + l hashes in ascending order of either, its head, the l smallest shared ones lie in both heads. Only heads
   enter the first product, and it discards pairs that share fewer than l. l grows with n such that a passage that two texts
   share, but that is not most of them, does not make them candidates.
2. The product runs over blocks of columns (hashes modulo the number of blocks). A light column, with under ``HEAVY`` rows,
   adds 1 to each of its pairs of compatible size; sums over all blocks plus what the two rows could still share in heavy
   columns must reach l. Heavy columns are never multiplied out: a row with l heavy entries or more is joined to the first row
   of each of the heavy columns that a partner would have to share (its first h - l + 1 of h).
3. Components of these candidate pairs hold every pair that can link. Each is a block of rows, and its full incidence matrix
   is multiplied in one task; one of more than ``BLOCK`` rows or ``ENTRIES`` entries is cut into chunks of rows of like size,
   and each pair of chunks whose sizes allow a link is a task. Overlaps below the bound from the two sizes are dropped, the
   rest link, and tasks give a spanning forest of the links.

Copies, near copies and frequent passages thus cost rows, not pairs of rows, between tasks; nothing is capped, so the result
is that of comparing all pairs. Sets and texts are told apart by 128 bits; the 64 bits of a row number in the products only
choose candidates, so two classes that share one are compared like any others. Shingles are 64-bit hashes.

Null or empty text, or text of white space only, has no set and links with nothing; so its component is its own doc_id. A null
doc_id never names a component, except that a component without any other id has a null one. Repeated rows are copies. An
empty table gives no rows; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.graph import components, merge
from evidara.llm.skew import attach, fresh
from evidara.llm.workspace import Workspace

HEAVY, BLOCK, ENTRIES, PAIRS, WORDS_HELD = 32, 1024, 1_000_000, 1_000_000, 250_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
ENTRY = np.dtype([("h", "<u8"), ("c", "<i8"), ("n", "<i4")])  # a hash, its row (class) and the row's size
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("n_a", "<i4"), ("n_b", "<i4"), ("v", "<i8")])
SETS = "doc_id long, text_key binary, key binary, cid long, n long, head binary"
PRODUCT = "kind int, a long, b long, n_a int, n_b int, v long"  # 0: v shared light columns of a and b; 1: heavy column b of row a


class WordHashes(dict):
    """64-bit hashes of words, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(data: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a text's bytes."""
    words = data.lower().split()  # of bytes: A to Z only, and at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    h = each[:n] * MIX[0]
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(31))) * MIX[1] + each[i : i + n]
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(k)) * MIX[2]
    return np.unique(h ^ (h >> np.uint64(32)))


class Rule:
    """Similarity num / den over shingles of ``size`` words, and the bounds that follow from it."""

    def __init__(self, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den

    def least(self, n):
        """Fewest shared hashes of a set of n with any that links with it."""
        return -(-self.num * n // self.den)

    def extra(self, n):
        """l: how many shared hashes heads are to hold; never less for a larger set."""
        return np.maximum(np.maximum(1, n // 20), np.minimum(n // 3, 40))

    def low(self, n):
        """Smallest l of a set of n and any that links with it."""
        return self.extra(self.least(n))

    def head(self, n):
        return np.minimum(n, n - self.least(n) + self.extra(n))

    def compatible(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def read_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``SETS`` for every row of ``docs`` (doc_id, text): key and cid are null without words; the head is given once for each
    class in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = WordHashes(), set()
        for batch in batches:
            keys, sizes, heads = [], [], []
            for item in batch.column("data"):
                found = shingles(item.as_py(), rule.size, hashes)
                sizes.append(len(found))
                keys.append(class_key(found) if len(found) else None)
                heads.append(None if keys[-1] is None or keys[-1] in told else found[: int(rule.head(len(found)))].tobytes())
                told.add(keys[-1])
            cids = pa.array([None if k is None else row_number(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), cids, pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())],
                ["doc_id", "text_key", "key", "cid", "n", "head"],
            )

    return with_keys(docs).mapInArrow(read, SETS)


def text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def class_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def row_number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def head_product(heads: DataFrame, rule: Rule, blocks: int) -> DataFrame:
    """``PRODUCT`` of ``heads`` (cid, n, head), block by block of columns."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("head")]
            sizes = [len(x) for x in each]
            entries = np.empty(sum(sizes), ENTRY)
            if not len(entries):
                continue
            entries["h"] = np.concatenate(each)
            entries["c"] = np.repeat(batch.column("cid").to_numpy(), sizes)
            entries["n"] = np.repeat(batch.column("n").to_numpy(), sizes)
            entries = entries[np.argsort(entries["h"], kind="stable")]
            starts = np.flatnonzero(np.r_[True, entries["h"][1:] != entries["h"][:-1]])
            counts = np.diff(np.r_[starts, len(entries)])
            # classes occur once here; a column that is heavy within this batch stays here but for its first row and its number of rows
            much = np.repeat(counts >= HEAVY, counts)
            rest, stay = entries[~much], entries[much]
            marks = entries[starts[counts >= HEAVY]].copy()
            marks["n"] = -counts[counts >= HEAVY]
            if len(stay):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(stay["c"][0]) % (1 << 20)], pa.int32()), pa.array([stay.tobytes()], pa.binary())], ["part", "entries"])
            sent = np.concatenate([rest, marks])
            to = (sent["h"] % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            parts, at = np.unique(to[order], return_index=True)
            cuts = np.split(sent[order], at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["part", "entries"])

    def rows(kind, a, b, n_a, n_b, v) -> pa.Table:
        return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": a, "b": b, "n_a": pa.array(n_a, pa.int32()), "n_b": pa.array(n_b, pa.int32()), "v": pa.array(v, pa.int64())})

    def heavy(e: np.ndarray) -> pa.Table:
        return rows(1, e["c"].copy(), e["h"].astype(np.int64), e["n"].copy(), np.zeros(len(e), np.int32), np.zeros(len(e), np.int64))

    def pairs_of(entries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fits = rule.compatible(entries["n"][i].astype(np.int64), entries["n"][j].astype(np.int64))
        i, j = i[fits], j[fits]
        swap = entries["c"][i] > entries["c"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        found = np.empty(len(i), PAIR)
        found["a"], found["b"], found["n_a"], found["n_b"], found["v"] = entries["c"][i], entries["c"][j], entries["n"][i], entries["n"][j], 1
        return found

    def summed(pairs: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return pairs
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        first = np.flatnonzero(np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])])
        found = pairs[first]
        found["v"] = np.add.reduceat(pairs["v"], first)
        return found

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
        if key[0].as_py() < 0:
            return heavy(entries)
        # a class that several tasks hold comes from each of them
        entries = entries[np.lexsort((-np.sign(entries["n"]), entries["c"], entries["h"]))]
        again = (entries["h"][1:] == entries["h"][:-1]) & (entries["c"][1:] == entries["c"][:-1]) & ((entries["n"][1:] < 0) == (entries["n"][:-1] < 0))
        entries = entries[np.r_[True, ~again]]
        starts = np.flatnonzero(np.r_[True, entries["h"][1:] != entries["h"][:-1]])
        lengths = np.diff(np.r_[starts, len(entries)])
        marked = np.maximum.reduceat(entries["n"] < 0, starts)
        much = marked | (lengths >= HEAVY)
        of_heavy = entries[np.repeat(much, lengths)]
        out = [heavy(of_heavy[of_heavy["n"] > 0])]
        held, waiting = [np.empty(0, PAIR)], 0
        for length in np.unique(lengths[~much & (lengths > 1)]):
            at = starts[~much & (lengths == length)]
            i, j = np.triu_indices(length, 1)
            for k in range(0, len(at), max(1, PAIRS // len(i))):
                part = at[k : k + max(1, PAIRS // len(i)), None]
                held.append(pairs_of(entries, (part + i).ravel(), (part + j).ravel()))
                waiting += len(held[-1])
                if waiting >= 2 * PAIRS:  # what is summed stays small, however many columns two rows share
                    held, waiting = [summed(np.concatenate(held))], 0
        p = summed(np.concatenate(held))
        out.append(rows(0, p["a"].copy(), p["b"].copy(), p["n_a"].copy(), p["n_b"].copy(), p["v"].copy()))
        return pa.concat_tables(out)

    return heads.select("cid", "n", "head").mapInArrow(deal, "part int, entries binary").groupBy("part").applyInArrow(multiply, PRODUCT)


def _extra(n):
    return F.greatest(F.lit(1), F.floor(n / 20), F.least(F.floor(n / 3), F.lit(40)))


def candidates(product: DataFrame, rule: Rule, space: Workspace) -> DataFrame:
    """Pairs (a, b) of classes whose components hold every pair that can link."""
    heavy = product.filter("kind = 1").select(F.col("a").alias("cid"), F.col("b").alias("h"), F.col("n_a").alias("n")).distinct()
    least = F.ceil(F.col("n") * rule.num / rule.den)
    count = space.save(heavy.groupBy("cid", "n").agg(F.count("*").alias("held")).withColumn("low", _extra(least)), "heavy")
    light = product.filter("kind = 0").groupBy("a", "b", "n_a", "n_b").agg(F.sum("v").alias("v"))
    # what two rows may share in heavy columns is looked up only for pairs that need it
    need = F.least(_extra(F.col("n_a")), _extra(F.col("n_b")))
    held = count.select("cid", "held")
    short = light.filter(F.col("v") < need)
    short = short.join(held.withColumnsRenamed({"cid": "a", "held": "held_a"}), "a").join(held.withColumnsRenamed({"cid": "b", "held": "held_b"}), "b")
    pairs = light.filter(F.col("v") >= need).select("a", "b").union(short.filter(F.col("v") + F.least("held_a", "held_b") >= need).select("a", "b"))
    # of h heavy columns in order, partners share one of the first h - low + 1: the (h - low + 1)-th smallest bounds them
    rich = count.filter("held >= low").select("cid", "low", "held")
    from_ = heavy.join(rich, "cid").groupBy("cid").agg(F.array_sort(F.collect_list("h")).alias("hs"), F.first("low").alias("low"))  # a head's length at most
    told = from_.select("cid", F.explode(F.slice("hs", F.lit(1), (F.size("hs") - F.col("low") + 1).cast("int"))).alias("h"))
    told = space.save(told, "told")
    first = told.groupBy("h").agg(F.min("cid").alias("b"))
    return pairs.union(told.join(first, "h").select(F.col("cid").alias("a"), "b").filter("a != b").distinct())


def node_of(row: str, key: str) -> Column:
    """A class as bytes that sort as the rows that name classes do: ``row`` (none, id, text_key), then the class ``key``."""
    shifted = F.lpad(F.hex(F.coalesce(F.col(f"{row}.id"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.when(F.col(f"{row}.none"), "01").otherwise("00")), F.unhex(shifted), F.col(f"{row}.text_key"), F.col(key))


def named_by(node: Column) -> tuple[Column, Column]:
    """doc_id and text key of the row that names a class."""
    id_ = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", id_), F.substring(node, 10, 16)


def full_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``wanted`` (node, block, part, chunks, below, above) with the hashes of each class, read from the one row that names it;
    rows that repeat both doc_id and text come once from each task."""
    kept = ["node", "block", "part", "chunks", "below", "above"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = WordHashes(), set()
        for batch in batches:
            found, at = [], []
            for i, (item, node) in enumerate(zip(batch.column("data"), batch.column("node").to_pylist(), strict=True)):
                if node not in told:
                    told.add(node)
                    at.append(i)
                    found.append(shingles(item.as_py(), rule.size, hashes).tobytes())
            rest = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *rest], ["hashes", *kept])

    first, key = named_by(F.col("node"))
    named = wanted.select(*kept, first.alias("first_id"), key.alias("first_key"))
    # Spark broadcasts the list of rows where its file is small
    picked = with_keys(docs).join(named, (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return picked.select("data", *kept).mapInArrow(read, "hashes binary, node binary, block long, part int, chunks long, below long, above long")


def placed(members: DataFrame, rule: Rule, space: Workspace) -> DataFrame:
    """``members`` (node, block, n) with the part of their block they stand in and the chunks of this, the next lower and the
    next higher part. A block of one chunk has one part; the parts of a larger one are ranges of set sizes, so wide that only
    sets of one part or of neighbours can link."""
    sizes = lambda table, *by: table.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ENTRIES)).alias("chunks"), F.count("*").alias("rows"))
    counts = lambda table, *by: table.select(*by, F.col("rows").alias("n"))
    blocks = space.save(sizes(members, "block"), "sizes")
    width = max(np.log(rule.den / rule.num), 1e-6) * (1 + 1e-6)
    part = F.when(F.col("chunks") > 1, F.floor(F.log(F.col("n")) / F.lit(float(width)))).otherwise(0).cast("int")
    parted = space.save(attach(members, blocks.drop("rows"), "block", counts(blocks, "block")).select("node", "block", "n", part.alias("part")), "parted")
    parts = space.save(sizes(parted, "block", "part"), "parts")
    beside = lambda by, name: parts.select("block", (F.col("part") + by).alias("part"), F.col("chunks").alias(name))
    every = parts.drop("rows").join(beside(1, "below"), ["block", "part"], "left").join(beside(-1, "above"), ["block", "part"], "left").fillna(0, ["below", "above"])
    return attach(parted, every, ["block", "part"], counts(parts, "block", "part"))


def block_product(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links as a spanning forest (a, b) of nodes within each pair of chunks of ``sets``: of one part (step 0) or of a part and
    the next higher one (step 1), by the chunks' numbers ``low`` and ``high`` in their parts."""
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    task = lambda part, step, low, high: F.struct(part.alias("part"), F.lit(step).alias("step"), low.alias("low"), high.alias("high"))
    own = F.col("own")
    within = F.transform(upto("chunks"), lambda c: task(F.col("part"), 0, F.least(own, c), F.greatest(own, c)))
    upward = F.transform(upto("above"), lambda c: task(F.col("part"), 1, own, c))
    downward = F.transform(upto("below"), lambda c: task(F.col("part") - 1, 1, c, own))
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("task", F.explode(F.concat(within, upward, downward)))

    def multiply(table: pa.Table) -> pa.Table:
        rows = dict(zip(table.column("node").to_pylist(), table.column("hashes").to_pylist(), strict=True))
        keys = sorted(rows)
        each = [np.frombuffer(rows[k], np.uint64) for k in keys]
        sizes = np.array([len(x) for x in each], np.int64)
        roots = np.arange(len(keys))
        for a, b, shared in overlaps(each, sizes):
            # shared * (num + den) >= num * (n_a + n_b) is shared / union >= num / den
            links = shared * (rule.num + rule.den) >= rule.num * (sizes[a] + sizes[b])
            merge(roots, a[links], b[links])
        moved = np.flatnonzero(roots != np.arange(len(keys)))
        return pa.table({"a": pa.array([keys[i] for i in moved], pa.binary()), "b": pa.array([keys[roots[i]] for i in moved], pa.binary())})

    by = ["part", "step", "low", "high"]
    return dealt.select("block", *[f"task.{c}" for c in by], "node", "hashes").groupBy("block", *by).applyInArrow(multiply, "a binary, b binary")


def overlaps(each: list[np.ndarray], sizes: np.ndarray, dense: int = 48, pairs: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows a < b with shared hashes, and how many: columns with ``dense`` rows or more are multiplied as dense
    matrices, the others pair by pair, ``pairs`` at a time; the sums of a block fill one matrix of rows by rows."""
    n = len(each)
    rows = np.repeat(np.arange(n), sizes)
    hashes = np.concatenate(each)
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    lengths = np.diff(np.r_[starts, len(hashes)])
    full = lengths >= dense
    shared = np.zeros((n, n), np.float32)
    for length in np.unique(lengths[~full & (lengths > 1)]):
        at = starts[~full & (lengths == length)]
        i, j = np.triu_indices(length, 1)
        step = max(1, pairs // len(i))
        for k in range(0, len(at), step):
            part = at[k : k + step, None]
            np.add.at(shared, (rows[(part + i).ravel()], rows[(part + j).ravel()]), 1)
    column = np.repeat(np.cumsum(full) - 1, lengths)
    inside = np.repeat(full, lengths)
    dense_rows, dense_columns, n_columns = rows[inside], column[inside], int(full.sum())
    for c in range(0, n_columns, 2048):
        mine = (dense_columns >= c) & (dense_columns < c + 2048)
        matrix = np.zeros((n, min(2048, n_columns - c)), np.float32)
        matrix[dense_rows[mine], dense_columns[mine] - c] = 1
        shared += matrix @ matrix.T
    for first in range(0, n, 512):
        x, y = np.nonzero(np.triu(shared[first : first + 512], k=first + 1))
        yield x + first, y, shared[x + first, y].astype(np.int64)


def link(docs: DataFrame, size: int, num: int, den: int, space: Workspace) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and the row that stands for the component (first_id, first_key: of its smallest
    doc_id, null last, the one with the smaller text key) of every row of ``docs`` (doc_id, text)."""
    rule = Rule(size, num, den)
    docs = docs.select("doc_id", "text")
    sets = space.save(read_sets(docs, rule), "sets")
    found = sets.filter("key is not null")
    heads = found.filter("head is not null").select("cid", "n", "head")
    entries = heads.agg(F.sum(F.length("head") / 8)).first()[0] or 0
    product = space.save(head_product(heads, rule, max(8, int(entries // ENTRIES) + 1)), "product")
    pairs = space.save(candidates(product, rule, space), "pairs")
    blocks = components(pairs, space)
    blocks = space.save(blocks.union(blocks.select("root", "root").distinct()).withColumnRenamed("root", "block"), "blocks")
    space.drop("product", "heavy", "told", "pairs")
    # the row that names a class: smallest doc_id, null last, then the smaller text key; a node is a class in that order, so
    # the smallest node of a component names it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_key")).alias("first")
    classes = found.groupBy("key").agg(first, F.any_value("cid").alias("cid"), F.any_value("n").alias("n"), F.count("*").alias("rows"))
    classes = space.save(classes.select("key", node_of("first", "key").alias("node"), "cid", "n", "rows"), "classes")
    members = space.save(blocks.withColumnRenamed("node", "cid").join(classes, "cid").select("node", "block", "n"), "members")
    wanted = space.save(placed(members, rule, space), "wanted")
    links = space.save(block_product(full_sets(docs, wanted, rule), rule), "links")
    space.drop("members", "sizes", "parted", "parts", "wanted", "blocks")
    roots = components(links, space)
    first_id, first_key = named_by(F.coalesce("root", "node"))
    told = classes.join(roots, "node", "left").select("key", first_id.alias("component_id"), first_key.alias("first_key"), F.col("rows").alias("n"))
    told = space.save(told, "told")
    known = attach(found.select("doc_id", "text_key", "key", F.col("n").alias("n_shingles")), told.drop("n"), "key", told.select("key", "n"))
    known = known.select("doc_id", "text_key", "n_shingles", "component_id", F.col("component_id").alias("first_id"), "first_key")
    own = F.col("doc_id")
    alone = sets.filter("key is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"), own.alias("first_id"), F.col("text_key").alias("first_key"))
    return known.unionByName(alone)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return link(docs, size, num, den, Workspace(docs.sparkSession, "jaccard")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id (null last; then the one
    with the smaller key of its text), and all rows without words. Keeps the columns of ``docs``, whatever their names."""
    space = Workspace(docs.sparkSession, "jaccard")
    linked = space.save(link(docs, size, num, den, space), "linked")
    space.drop("sets", "links", "classes", "told")
    # every row is its component's first one, or goes: two columns decide, so no component is gathered
    key, gone, id_ = fresh("text_key", docs), fresh("gone_key", docs), fresh("gone_id", docs)
    out = linked.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))))
    out = space.save(out.select(F.col("doc_id").alias(id_), F.col("text_key").alias(gone)).distinct(), "gone")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    same = (F.col(key) == F.col(gone)) & F.col("doc_id").eqNullSafe(F.col(id_))
    kept = keyed.join(out, same, "left_anti")
    # rows that repeat both doc_id and text are still there as often as before; only they are dealt again
    twice = linked.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    twice = space.save(twice.select(F.col("doc_id").alias(id_), F.col("text_key").alias(gone)), "repeated")
    if twice.isEmpty():
        return kept.drop(key)
    return kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", key])).drop(key)
