"""Prefix trie of rebuilt conversations from composable fingerprints; no rebuilt text is ever made.

A turn's fingerprint is x (three residues of a 128-bit hash of role and text), that of a sequence of
n turns is the pair (P, B^n) with P = x1 B^(n-1) + ... + xn modulo three primes. Pairs form a monoid:
(P, B^n) (Q, B^m) = (P B^m + Q, B^(n+m)). So with the prefix products P[k] of a conversation's own
turns, and the product H of the head it takes from its base, the rebuilt prefix up to its own turn k
has the product P[k] + (H - P[h]) B^(k-h): one multiplication on numbers, whatever the texts.

1. Turns are range-sorted without their texts; tasks number the turns of each conversation and
   multiply them up. A conversation that spans tasks is put together from one product per task.
2. Each conversation gets its base's first prefix products (eight at most) and its correction.
3. Every (conversation, depth) is a narrow row with the products of the prefix and of its parent;
   nodes are the groups of rows with one depth and product.
4. Groups are verified: all rows of a node must refer to turns of one 128-bit hash, and all stored
   turns of one hash must have the same role and text. The parent's product follows from the node's
   and its last turn, so by induction over depth equal products are equal texts. If a group fails,
   everything is done again under another seed.
5. Sums over subtrees need no walk: each node belongs to its smallest member; a node's subtree is what
   its members own at its depth or below, so members' totals are summed per node and the part of the
   owner's chain above the node is taken off.
6. Ids of the conversations that end at a node are sorted by ranges and hashed as they stream by;
   lists that span tasks are hashed from their pieces in order.

Defined cases: null role or text is empty; turns go by turn number, null first, then by role and a
64-bit hash of the text; rows with a null conv_id belong to no conversation; repeated rows are turns
of their own; a negative conv_id's base follows the sign of SQL's remainder; an empty table has no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from ..session import stage_table
from .common import column

#: Conversations of one base, turns a head has at most plus one.
FAMILY = 5
HEADS = 9
#: The largest primes below 2^31: products of residues fit 64 bits.
PRIMES = np.array([2147483647, 2147483629, 2147483587], np.uint64)
#: The base of the products for each prime, and its inverse.
BASES = np.array([1093726111, 1734908767, 1390486937], np.uint64)
INVERSES = np.array([pow(int(b), -1, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
#: Turns of a chain that one task sums; ids whose text is hashed or handed on at a time.
CHUNK = 4096
PIECE_IDS = 50_000

NODE = ["depth", "f1", "f2", "f3"]
_TURNS = "conv long, part int, place long, p1 long, p2 long, p3 long, k1 long, k2 long, bytes long, ends boolean"
_ROWS = ("conv long, depth long, f1 long, f2 long, f3 long, g1 long, g2 long, g3 long, "
         "k1 long, k2 long, bytes long, last boolean")


# --- the monoid ----------------------------------------------------------------------------------

def powers(exponents: np.ndarray) -> np.ndarray:
    """B^e modulo each prime, a row of three per exponent."""
    out = np.ones((len(exponents), 3), np.uint64)
    square, left = BASES.copy(), exponents.astype(np.uint64)
    while left.any():
        out = np.where((left & np.uint64(1)).astype(bool)[:, None], out * square % PRIMES, out)
        square, left = square * square % PRIMES, left >> np.uint64(1)
    return out


def residues(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The fingerprints of turns with these hashes."""
    a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
    return np.stack([a % PRIMES[0], (a >> np.uint64(33) ^ b) % PRIMES[1], b % PRIMES[2]], axis=1)


def combined(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """Product of sequences: rows of residues, and how many turns the right ones have."""
    return (left * powers(right_length) % PRIMES + right) % PRIMES


def prefix_products(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products of the prefixes of consecutive runs of turns; `first` marks where runs start.

    Doubling: after step s every product covers up to 2^s turns of its run.
    """
    place = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    out, step, power = x.copy(), 1, BASES.copy()
    while step <= (place.max() if len(place) else 0):
        reach = np.flatnonzero(place >= step)
        out[reach] = (out[reach - step] * power % PRIMES + out[reach]) % PRIMES
        step, power = 2 * step, power * power % PRIMES
    return out


def _lanes(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, axis=1).astype(np.uint64)


def _longs(lanes: np.ndarray) -> list[pa.Array]:
    return [pa.array(lanes[:, k].astype(np.int64)) for k in range(3)]


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


# --- turns ---------------------------------------------------------------------------------------

def _keyed(turns: DataFrame, names: tuple[str, str, str, str], seed: int, bits: int) -> DataFrame:
    conv, turn, role, text = (column(turns, n) for n in names)
    rows = turns.select(conv.cast("long").alias("conv"), turn.cast("long").alias("turn"),
                        F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                        F.coalesce(text.cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    mask = F.lit((1 << bits) - 1) if bits < 63 else F.lit(-1)
    return rows.withColumns({
        "k1": F.xxhash64(F.lit(2 * seed), "role", F.lit(0), "text").bitwiseAND(mask),
        "k2": F.xxhash64(F.lit(2 * seed + 1), "text", F.lit(1), "role").bitwiseAND(mask)})


def _numbered(keyed: DataFrame) -> DataFrame:
    """Each turn with its place and product inside its task's run of the conversation, staged."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, length, product, row = None, 0, np.zeros(3, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = _numpy(batch, "conv")
            first = np.append(True, conv[1:] != conv[:-1])
            x = residues(_numpy(batch, "k1"), _numpy(batch, "k2"))
            index = np.arange(len(conv))
            place = index - np.maximum.accumulate(np.where(first, index, 0)) + 1
            products = prefix_products(x, first)
            if row is not None:
                goes_on = conv[0] == held
                yield _with_end(row, not goes_on)
                if goes_on:  # the first run continues the one before
                    head = int(np.argmax(first[1:])) + 1 if first[1:].any() else len(conv)
                    products[:head] = combined(np.tile(product, (head, 1)), products[:head], place[:head])
                    place[:head] += length
            held, length, product = conv[-1], place[-1], products[-1]
            ends = np.append(first[1:], False)
            whole = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(place.astype(np.int64)), *_longs(products),
                 batch.column(2), batch.column(3), batch.column(4), pa.array(ends)],
                names=[c.split()[0] for c in _TURNS.split(", ")])
            if whole.num_rows > 1:
                yield whole.slice(0, whole.num_rows - 1)
            row = whole.slice(whole.num_rows - 1)
        if row is not None:
            yield _with_end(row, True)

    def _with_end(row: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([ends])], names=row.schema.names)

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "tie", "k1", "k2"]
    rows = keyed.withColumns({"tie": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")}).drop("text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = dealt.select("conv", F.spark_partition_id().alias("part"), "k1", "k2", "bytes")
    return stage_table(narrow.mapInArrow(multiply, _TURNS), "trie-turns")


def _joined_runs(turns: DataFrame) -> DataFrame:
    """Turns with places and products counted from their conversation's start.

    Only a task's first conversation can have begun before it: the driver puts together one
    length and product for each task that ends in the middle of a conversation.
    """
    ends = turns.where("ends")
    edge = ends.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"))
    edges = ends.join(edge, "part").where("conv = first OR conv = last")
    carried: dict[int, tuple[int, int, np.ndarray]] = {}
    conv, length, product = None, 0, np.zeros((1, 3), np.uint64)
    rows = edges.select("part", "conv", "place", "p1", "p2", "p3").orderBy("part", "conv").collect()
    for row in rows:  # two rows a task at most
        own = np.array([[row.p1, row.p2, row.p3]], np.uint64)
        if row.conv == conv:
            carried[row.part] = (conv, length, product[0])
            length, product = length + row.place, combined(product, own, np.array([row.place]))
        else:
            conv, length, product = row.conv, row.place, own

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _numpy(batch, "place").copy()
            products = _lanes([_numpy(batch, f"p{k}") for k in (1, 2, 3)])
            part, convs = _numpy(batch, "part"), _numpy(batch, "conv")
            for one in np.unique(part).tolist():
                if one in carried:
                    conv, length, product = carried[one]
                    rows = np.flatnonzero((part == one) & (convs == conv))
                    products[rows] = combined(np.tile(product, (len(rows), 1)), products[rows], place[rows])
                    place[rows] += length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place), *_longs(products), *batch.columns[6:9]],
                names=["conv", "place", "p1", "p2", "p3", "k1", "k2", "bytes"])

    return turns.mapInArrow(carry, "conv long, place long, p1 long, p2 long, p3 long, k1 long, k2 long, bytes long")


# --- rebuilt conversations -----------------------------------------------------------------------

def _conversations(turns: DataFrame) -> DataFrame:
    """conv, h (turns to take from the base), n, taken, heads and head_p/own_p, the products before own turns."""
    fields = ["place", "p1", "p2", "p3", "k1", "k2", "bytes"]
    heads = F.array_sort(F.collect_list(F.when(F.col("place") < HEADS, F.struct(*fields))))
    own = turns.groupBy("conv").agg(F.max("place").alias("n"), heads.alias("own"))
    own = own.withColumns({
        "h": F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS)).cast("int"),
        "base": F.col("conv") - F.col("conv") % FAMILY})
    base = own.select(F.col("conv").alias("base"), F.col("own").alias("heads"))
    joined = own.join(base, "base", "left").withColumn("heads", F.expr("slice(coalesce(heads, array()), 1, h)"))
    none = F.struct(*(F.lit(0).cast("long").alias(f"p{k}") for k in (1, 2, 3)))

    def product(items: str, at) -> F.Column:
        found = F.get(F.transform(F.col(items), lambda t: F.struct(t.p1, t.p2, t.p3)), at - 1)
        return F.when(at > 0, found).otherwise(none)

    taken = F.size("heads")
    return joined.select("conv", "h", "n", "heads", taken.alias("taken"), product("heads", taken).alias("head_p"),
                         product("own", F.when(F.col("n") >= F.col("h"), F.col("h")).otherwise(0)).alias("own_p"))


def _prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and depth (0 included): products of the prefix and of its parent."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: _numpy(batch, name)
            p, head, own = (_lanes([get(f"{s}{k}") for k in (1, 2, 3)]) for s in ("p", "head", "own"))
            shift = (head + PRIMES - own) % PRIMES
            f = (p + shift * powers(get("past")) % PRIMES) % PRIMES
            g = (f + PRIMES - residues(get("k1"), get("k2"))) % PRIMES * INVERSES % PRIMES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *_longs(f), *_longs(g),
                 *(batch.column(batch.schema.get_field_index(n)) for n in ("k1", "k2", "bytes", "last"))],
                names=[c.split()[0] for c in _ROWS.split(", ")])

    zero = [F.lit(0).cast("long").alias(f"{s}{k}") for s in ("head", "own") for k in (1, 2, 3)]
    total = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    behind = turns.join(convs.drop("heads"), "conv").where("place > h").select(
        "conv", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "p1", "p2", "p3",
        *(F.col(f"{s}_p.p{k}").alias(f"{s}{k}") for s in ("head", "own") for k in (1, 2, 3)),
        (F.col("place") - F.col("h")).alias("past"), "k1", "k2", "bytes", (F.col("place") == F.col("n")).alias("last"))
    front = convs.select("conv", total.alias("total"), F.explode("heads").alias("t")).select(
        "conv", F.col("t.place").alias("depth"), "t.p1", "t.p2", "t.p3", *zero, F.lit(0).cast("long").alias("past"),
        "t.k1", "t.k2", "t.bytes", (F.col("t.place") == F.col("total")).alias("last"))
    rows = behind.unionByName(front).mapInArrow(products, _ROWS)
    nothing = F.lit(0).cast("long")
    roots = convs.select("conv", *(nothing.alias(c) for c in NODE), *(F.lit(None).cast("long").alias(f"g{k}") for k in (1, 2, 3)),
                         *(nothing.alias(c) for c in ("k1", "k2", "bytes")), (total == 0).alias("last"))
    return stage_table(rows.unionByName(roots), "trie-rows")


def _same_texts(keyed: DataFrame, nodes: DataFrame) -> bool:
    """Whether every node refers to turns of one hash, and every hash stands for one role and text."""
    if not nodes.where("mixed").isEmpty():
        return False
    several = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = stage_table(several, "trie-keys")
    texts = keyed.join(several, ["k1", "k2"]).select("k1", "k2", F.struct("role", "text").alias("content"))
    return texts.groupBy("k1", "k2").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").isEmpty()


# --- lists of ends -------------------------------------------------------------------------------

def _end_hashes(rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of every node that conversations end at."""
    key_fields = [pa.int64()] * 4
    keys = ", ".join(f"{c} long" for c in NODE)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's runs of equal nodes: inner ones are hashed, its first and last are handed on in pieces."""
        out: list[tuple] = []
        key, ids, inner, pieces = None, [], False, 0

        def handed() -> None:
            nonlocal ids, pieces
            out.append((*key, None, pieces, ",".join(map(str, ids))))
            ids, pieces = [], pieces + 1

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            for name, conv in zip(names, batch.column(4).to_pylist(), strict=True):
                if name != key:
                    if inner:
                        out.append((*key, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0, None))
                    elif ids:
                        handed()
                    key, ids, pieces, inner = name, [], 0, key is not None
                ids.append(conv)
                if len(ids) >= PIECE_IDS:
                    handed()  # a long list is hashed later, also when it is a whole one
                    inner = False
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if ids:
            handed()
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [*key_fields, pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[*NODE, "sha", "piece", "ids"])

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for name, ids in zip(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True),
                                 batch.column(4).to_pylist(), strict=True):
                if name != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, sha.hexdigest())])

    def _hashes(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [*key_fields, pa.string()], strict=True)],
                                          names=[*NODE, "ends_sha256"])

    ends = rows.where("last").select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    found = ends.mapInArrow(join_ids, f"{keys}, sha string, piece long, ids string")
    found = stage_table(found.withColumn("task", F.spark_partition_id()), "trie-ends")
    parted = found.where("sha IS NULL").repartition(*NODE).sortWithinPartitions(*NODE, "task", "piece")
    hashed = parted.select(*NODE, "ids").mapInArrow(hash_pieces, f"{keys}, ends_sha256 string")
    return found.where("sha IS NOT NULL").select(*NODE, F.col("sha").alias("ends_sha256")).unionByName(hashed)


# --- the trie ------------------------------------------------------------------------------------

def conversation_trie(turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
                      first_bits: int = 63) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see the module's text).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    `first_bits` narrows the turn hashes of the first attempt, to test that collisions are found.
    """
    for attempt in range(64):
        keyed = _keyed(turns, names, attempt, first_bits if attempt == 0 else 63)
        numbered = _joined_runs(_numbered(keyed))
        rows = _prefix_rows(numbered, stage_table(_conversations(numbered), "trie-conversations"))
        nodes = rows.groupBy(*NODE).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
            *(F.max(f"g{k}").alias(f"g{k}") for k in (1, 2, 3)),
            ((F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))).alias("mixed"))
        nodes = stage_table(nodes, "trie-nodes")
        if _same_texts(keyed, nodes):
            return _measured(rows, nodes)
    raise RuntimeError("every seed of the turn hashes collides")


def _measured(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    parent = [(F.col("depth") - 1).alias("depth"), *(F.col(f"g{k}").alias(f"f{k}") for k in (1, 2, 3))]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "weight": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = stage_table(nodes.drop("mixed"), "trie-families")
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("weight").alias("weight"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    below = rows.select("conv", *NODE).join(owned, "conv").groupBy(*NODE).agg(
        F.sum("weight").alias("below"), F.sum("leaves").alias("n_leaves"))
    chains = running_total(nodes, ["conv_id"], F.expr(f"depth div {CHUNK}"), [F.col("depth")], F.col("weight"), "so_far")
    parents = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    up = F.struct(*parent)
    joined = chains.join(below, NODE).join(_end_hashes(rows), NODE, "left").withColumn("up", up)
    joined = joined.drop(*NODE[1:]).withColumnRenamed("depth", "own_depth")
    linked = joined.join(parents, [F.col("up.depth") == F.col("depth"), *(F.col(f"up.f{k}") == F.col(f"f{k}") for k in (1, 2, 3))], "left")
    saved = F.col("below") - (F.col("so_far") - F.col("weight"))
    return linked.select("conv_id", F.col("own_depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                         saved.cast("long").alias("saved_tokens"),
                         F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
