r"""Self-join of texts on the Jaccard similarity of their word shingles, by token-combination prefixes.

Words are ``[^\x20\x09-\x0D]+`` in lower ASCII case; a text's set is its distinct shingles of
`width` words, or the whole sequence when it has fewer. Tokens are 64-bit shingle hashes.

1. Equal word sequences become one node (64-bit sequence hash), so copies are never paired.
2. Token classes are `CLASSES` hash classes with counts over all texts (a fixed-size table).
   Tokens are ordered by (count of their class, hash); classes well above the mean count are
   frequent.
3. A set of n tokens can miss at most n - ceil(0.75 n) tokens of a partner. Its prefix is extended
   in that order until that many tokens can go and `spare(n)` signatures are still left: a rare
   token is a signature by itself; frequent tokens are dealt into groups by hash, and the
   signatures are all pairs inside a group (a group gives one less than its size at least). The
   number of groups goes with the size band of the set (powers of four); sets near the top of a
   band also sign for the next one. Two linked sets always share as many signatures as the smaller
   of their spares, however frequent their tokens are.
4. Signatures held by one node only go, then nodes with fewer signatures left than any partner
   would share with them. Among the rest, a node is compared with one hub: of the holders that
   most of its signatures point to, the one with the longest lists. Then components are formed; this
   goes on with other hubs as long as enough comparisons link, so a group of near copies costs a few
   comparisons a member.
5. Of nodes of different components, those with short lists on the average are compared with *all*
   that share enough signatures. The others get a second prefix, over their whole sets, by exact
   token counts among them and bounds for their sizes; all pairs that share a token of it are
   compared. Tokens that all members of a group hold come last there, so what isn't linked to a hub
   meets few others. Both ways are exact, and no link is lost.
6. Comparisons are exact intersections of the whole sets, made from the two texts.

Defined cases: null and wordless texts have an empty set and are linked with nothing; rows with a
null id keep their count, have no component and link nothing; repeated rows and equal texts share
a component; rows that share an id are joined through it; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_tables, stage_table
from .bytescan import SPACED, lowered, mixed, shingle_hashes, slices, utf8, word_hashes, words
from .common import column, small_batches
from .components import components
from .suffix_tree_lm import Bits

WIDTH = 5
CLASSES = 1 << 18
#: A class is frequent from so many standard deviations above the mean count on.
FREQUENT = 6
#: Hubs are compared as long as one of so many comparisons links.
HUB_ROUNDS = 8
#: Signature lists longer than this on the average of a node give way to its second prefix.
LONG_LIST = 16
#: Words of 64 bits in the bit table of wanted nodes (4 MB).
NODE_BITS = 1 << 19

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Of the texts of a buffer: node hashes, and the distinct tokens with the text they belong to."""
    starts, ends, first = words(data, offsets, SPACED)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = mixed((np.arange(len(hashes)) - first[owner] + 1).astype(np.uint64) * _GOLDEN)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ place), dtype=np.uint64)])
    node = mixed(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64) * _GOLDEN)
    token = shingle_hashes(hashes, width)
    at = np.arange(len(token))
    inside = at + width <= first[owner[:len(token)] + 1]
    doc, token = owner[:len(token)][inside], token[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    doc = np.concatenate([doc, short])
    token = np.concatenate([token, mixed(node[short] ^ _GOLDEN)])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return node, doc[new], token[new]


def _scan(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """Run `make(ids, nodes, doc, token)` over slices of whole texts; it returns columns of `schema`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a:b + 1] - offsets[a]
                made = make(batch.column(0)[a:b], *_sets(lowered(data[offsets[a]:offsets[b]]), part, width))
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return docs.select("id", "text").mapInArrow(run, schema)


def _class_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many (text, token) each hash class has over all texts; CLASSES numbers come to the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a:b + 1] - offsets[a]
                _, _, token = _sets(lowered(data[offsets[a]:offsets[b]]), part, width)
                total += np.bincount(_class_of(token), minlength=CLASSES)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["class", "n"])

    rows = docs.select("id", "text").mapInArrow(run, "class long, n long")
    found = rows.groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[found["class"].to_numpy()] = found["n"].to_numpy()
    return counts


def _class_of(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - 18)).astype(np.int64)


def missing(size: int | np.ndarray) -> int | np.ndarray:
    """How many tokens of a set a linked partner may lack, at 75 %."""
    return size - (3 * size + 3) // 4


def spare(size):
    """How many signatures two linked sets share at least, by the smaller of their values."""
    return 1 + size // 16


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one set whose tokens are in global order, frequent ones last."""
    size = len(tokens)
    need = int(missing(size) + spare(size))
    rare = int(len(tokens) - frequent.sum())
    out = [tokens[:min(need, rare)]]
    if need > rare:
        common = tokens[rare:]
        low = 1
        while 4 * low <= size:
            low *= 4
        bands = [low, 4 * low] if 4 * size >= 3 * 4 * low else [low]
        for band in bands:
            if band < 16:  # too few tokens to group: all are signatures by themselves
                out.append(common[:need - rare])
                continue
            group = (mixed(common + np.uint64(band)) % np.uint64(band // 8)).astype(np.int64)
            again = np.ones(len(common), bool)
            again[np.unique(group, return_index=True)[1]] = False
            reach = np.searchsorted(np.cumsum(again), need - rare) + 1
            common_, group = common[:reach], group[:reach]
            order = np.argsort(group, kind="stable")
            common_, group = common_[order], group[order]
            edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = common_[a:b]
                i, j = np.triu_indices(len(part), 1)
                out.append(mixed(mixed(np.minimum(part[i], part[j]) + np.uint64(band)) + np.maximum(part[i], part[j])))
    return np.unique(np.concatenate(out))


def _postings(docs: DataFrame, width: int, counts: np.ndarray) -> DataFrame:
    """(signature, node, set size) of all texts."""
    mean = counts.sum() / CLASSES
    bar = mean + FREQUENT * (mean ** 0.5 + 3) if FREQUENT else -1

    def make(ids, node, doc, token):
        load = counts[_class_of(token)]
        order = np.lexsort((token, load, doc))
        doc, token, often = doc[order], token[order], load[order] > bar
        size = np.bincount(doc, minlength=len(node))
        first = np.cumsum(size) - size
        need = missing(size) + spare(size)
        rare = size - np.bincount(doc, weights=often, minlength=len(node)).astype(np.int64)
        simple = rare >= need
        place = np.arange(len(doc)) - first[doc]
        taken = simple[doc] & (place < need[doc])
        sig, own = [token[taken]], [doc[taken]]
        for d in np.flatnonzero(~simple & (size > 0)).tolist():
            span = slice(int(first[d]), int(first[d] + size[d]))
            made = signatures(token[span], often[span])
            sig.append(made)
            own.append(np.full(len(made), d))
        sig, own = np.concatenate(sig), np.concatenate(own)
        named = ids.is_valid().to_numpy(zero_copy_only=False)[own]
        sig, own = sig[named], own[named]
        return {"sig": pa.array(sig.view(np.int64)), "node": pa.array(node.view(np.int64)[own]),
                "n": pa.array(size[own].astype(np.int32))}

    return _scan(docs, width, make, "sig long, node long, n int")


def _texts(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one text each.

    A bit table of fixed size drops most other texts in the task that reads them, so they aren't
    shuffled; the join is exact.
    """
    small_batches(docs.sparkSession)
    bits = Bits(wanted.select(F.col("node").alias("key")), NODE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            nodes = [_sets(lowered(data[offsets[a]:offsets[b]]), offsets[a:b + 1] - offsets[a], width)[0]
                     for a, b in slices(offsets)]
            nodes = np.concatenate(nodes) if nodes else np.empty(0, np.uint64)
            may = pa.array(bits.may(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)).filter(may), batch.column(0).filter(may)],
                                             names=["node", "text"])

    named = docs.where("id IS NOT NULL").select("text").mapInArrow(run, "node long, text string")
    return named.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _rows(docs: DataFrame, width: int) -> DataFrame:
    def make(ids, node, doc, token):
        return {"id": ids, "node": pa.array(node.view(np.int64)),
                "n": pa.array(np.bincount(doc, minlength=len(node)).astype(np.int64))}

    return _scan(docs, width, make, "id long, node long, n long")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b, linked) of node pairs, by exact intersection of the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [np.empty(0, bool)]
            (x, at), (y, to) = utf8(batch.column(2)), utf8(batch.column(3))
            for a, b in slices(at + to):
                _, one, left = _sets(lowered(x[at[a]:at[b]]), at[a:b + 1] - at[a], width)
                _, two, right = _sets(lowered(y[to[a]:to[b]]), to[a:b + 1] - to[a], width)
                pair, token = np.concatenate([one, two]), np.concatenate([left, right])
                order = np.lexsort((token, pair))
                pair, token = pair[order], token[order]
                same = (pair[1:] == pair[:-1]) & (token[1:] == token[:-1])
                both = np.bincount(pair[1:][same], minlength=b - a)
                union = np.bincount(pair, minlength=b - a) - both
                linked.append((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(linked))],
                                             names=["a", "b", "linked"])

    small_batches(pairs.sparkSession)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their node and the length of their list, where it spans components."""
    known = postings.select("sig", "node", "n")
    if labels is None:
        known = known.withColumn("label", F.col("node"))
    else:
        known = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    same = Window.partitionBy("sig")
    spans = known.select("*", F.min("label").over(same).alias("low"), F.max("label").over(same).alias("high"),
                         F.count(F.lit(1)).over(same).alias("held"), F.min("n").over(same).alias("least"))
    return spans.where("low < high").drop("low", "high")


def _spare(size: Column) -> Column:
    return F.lit(1) + F.floor(size / 16)


def _held_twice(postings: DataFrame) -> DataFrame:
    """Postings of signatures that more than one node has."""
    same = Window.partitionBy("sig")
    both = postings.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same))
    return both.where("low < high").select("sig", "node", "n")


def _pivot_pairs(open_: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """For each node the hub that most of its open signatures point to; at most one pair a node.

    The hub of a signature is the holder whose signatures have the longest lists together: the text
    in the middle of a group of near copies, whose own edits share nothing, comes last.
    """
    by_node, by_sig = Window.partitionBy("node"), Window.partitionBy("sig")
    scored = open_.withColumn("score", F.sum("held").over(by_node))
    met = scored.withColumn("p", F.max(F.struct("score", "node", "label", "n")).over(by_sig))
    met = met.where(F.col("label") != F.col("p.label"))
    met = met.where(_fits(F.col("n"), F.col("p.n"), percent))
    often = met.groupBy("node", F.col("p.node").alias("hub")).agg(F.count(F.lit(1)).alias("k"))
    often = often.withColumn("a", F.least("node", "hub")).withColumn("b", F.greatest("node", "hub"))
    if tested is not None:
        often = often.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    best = often.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("k", "hub")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def _tokens(texts: DataFrame, width: int) -> DataFrame:
    """(node, token) of the whole sets of (node, text)."""
    def make(ids, node, doc, token):
        return {"node": ids.take(pa.array(doc)), "token": pa.array(token.view(np.int64))}

    return _scan(texts.withColumnRenamed("node", "id"), width, make, "node long, token long")


def _shared_least(n: Column, m: Column, percent: int) -> Column:
    """How many tokens linked sets of these sizes share at least."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _open_pairs(open_: DataFrame, texts: DataFrame, tested: DataFrame, percent: int, width: int) -> DataFrame:
    """All pairs of different components that may still be linked.

    Only nodes that keep enough signatures take part. Those whose lists are short on the average meet
    all holders of their signatures; pairs of the others are found by `_prefix_pairs`.
    """
    near = F.min(F.greatest("least", F.ceil(F.col("n") * percent / 100))).alias("near")
    nodes = open_.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), near,
                                      F.count(F.lit(1)).alias("k"), F.sum("held").alias("load"))
    nodes = nodes.where(F.col("k") >= _spare(F.floor(F.col("n") * 0.75)))
    nodes = nodes.select("node", "n", "label", "near", (F.col("load") > LONG_LIST * F.col("k")).alias("heavy"))
    nodes = stage_table(nodes, "ngram-open")
    known = open_.select("sig", "node", "n", "label").join(nodes.select("node", "heavy"), "node")
    light = known.where("NOT heavy").select("sig", F.col("node").alias("x"), F.col("n").alias("m"),
                                            F.col("label").alias("other"))
    met = light.join(known, "sig").where(F.col("label") != F.col("other")).where("heavy OR x < node")
    met = met.where(_fits(F.col("n"), F.col("m"), percent))
    often = met.groupBy(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).agg(
        F.count(F.lit(1)).alias("k"), _spare(F.min(F.least("n", "m"))).alias("enough"))
    pairs = often.where("k >= enough").select("a", "b")
    pairs = pairs.unionByName(_prefix_pairs(nodes.where("heavy").drop("heavy"), texts, percent, width))
    return pairs.join(tested, ["a", "b"], "left_anti")


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of (node, n, label, near) that may be linked, by prefixes of their whole sets.

    Sets are ordered by how many of these nodes hold a token. A set of n tokens can miss
    n - ceil(6 n / 7) of a partner of its size or more, and n - ceil(3 (n + m) / 7) of a smaller
    one, m = near being the least size that fits in its signature lists; one token more is its prefix
    in either role. Linked sets share a prefix token: of the prefix that ends first one token at
    least is in the other set, and so in its prefix.
    """
    tokens = _tokens(texts.join(nodes.select("node"), "node", "left_semi").select("node", "text"), width)
    tokens = stage_table(tokens.join(nodes.select("node", "label"), "node"), "ngram-tokens")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("low"),
                                       F.max("label").alias("high"))
    order = Window.partitionBy("node").orderBy("held", "token")
    ranked = tokens.join(held, "token").withColumn("place", F.row_number().over(order)).where("low < high")
    ranked = ranked.select("node", "token", "place").join(nodes, "node")
    n = F.col("n")
    ranked = ranked.where(F.col("place") <= n - _shared_least(n, F.col("near"), percent) + 1)
    ranked = ranked.withColumn("small", F.col("place") <= n - _shared_least(n, n, percent) + 1)
    prefixes = stage_table(ranked.select("token", "node", "n", "label", "small"), "ngram-prefixes")
    one = prefixes.where("small").select("token", F.col("node").alias("x"), n.alias("m"), F.col("label").alias("other"))
    pairs = one.join(prefixes, "token").where(F.col("label") != F.col("other"))
    pairs = pairs.where("m < n OR m = n AND x < node").where(_fits(F.col("m"), n, percent))
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) of every row; texts link at a similarity of 75 %.

    component_id is the least id reachable by links, the row's own included.
    """
    percent = 75
    docs = docs.select(column(docs, key).cast("long").alias("id"), column(docs, text).cast("string").alias("text"))
    rows = stage_table(_rows(docs, width), "ngram-rows")
    counts = _class_counts(docs, width)
    postings = _postings(docs, width, counts)
    held = stage_table(_held_twice(postings).distinct(), "ngram-postings")
    # A partner has at least 75 % of the size, so it shares this many signatures or more.
    wanted = held.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    wanted = wanted.where(F.col("k") >= _spare(F.floor(F.col("n") * 0.75))).select("node")
    # Closed lists stay closed, so each round goes on from the open postings of the last one.
    open_ = stage_table(_labelled(held.join(wanted, "node", "left_semi"), None), "ngram-open-postings")
    drop_tables(held)
    texts = stage_table(_texts(docs, width, open_.select("node").distinct()), "ngram-texts")

    tested = None
    hubs = True
    while True:
        pairs = _pivot_pairs(open_, tested, percent) if hubs else _open_pairs(open_, texts, tested, percent, width)
        found = stage_table(_verified(pairs, texts, percent, width), "ngram-tested")
        tested = found if tested is None else tested.unionByName(found)
        labels = components(tested.where("linked").select("a", "b"))
        if not hubs:
            break
        many, linked = found.agg(F.count(F.lit(1)), F.count_if("linked")).first()
        hubs = linked * HUB_ROUNDS > many
        last, open_ = open_, stage_table(_labelled(open_, labels), "ngram-open-postings")
        drop_tables(last)
    drop_tables(open_, texts)
    return _named(rows, labels)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of nodes as least ids; rows that share an id are joined through it."""
    known = rows.where("id IS NOT NULL AND n > 0").select("id", "node").distinct()
    several = known.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top")
    through = known.join(several.select("id", "b"), "id").where("node <> b").select(F.col("node").alias("a"), "b")
    joined = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(joined.unionByName(through))
    named = rows.join(final, "node", "left").withColumn(
        "label", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("label", "node")))
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    out = named.join(least, "label", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
