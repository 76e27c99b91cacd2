"""Operators of the training-corpus package against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pricelode.llm import ngram_join as nj  # noqa: E402
from pricelode.llm.bytescan import ALNUM, utf8, word_hashes, words  # noqa: E402
from pricelode.llm.components import components  # noqa: E402
from pricelode.llm.decontamination import Phrases, find_contamination  # noqa: E402
from pricelode.llm.hilbert_shards import assign_shards, hilbert_index  # noqa: E402
from pricelode.llm.license_scan import scan_licenses, train_licenses, with_words  # noqa: E402
from pricelode.llm.line_quality import line_quality  # noqa: E402
from pricelode.llm.piece_ids import Chunks, encode_pieces  # noqa: E402
from pricelode.llm.pretokens import Pretokens, prepared  # noqa: E402
from pricelode.llm.suffix_tree_lm import (  # noqa: E402
    language_model_scores, score_texts, train_suffix_tables, train_suffix_tree)
from pricelode.llm.token_counts import count_tokens  # noqa: E402
from pricelode.llm.token_files import ShardReader, fetch_documents, read_token_files, write_token_files  # noqa: E402
from pricelode.llm.toxicity import fit_toxicity, score_toxicity, windows  # noqa: E402
from pricelode.session import fresh_path  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ODD_TEXTS = [None, "", " ", "\n\n", "One.", "it's  12 <|endoftext|> é中\n x", "a" * 3000, "x y " * 4000,
             "tab\there  and\x0bthere\r\n", "Ünï cödé — “quotes” ▁ mark\0"]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, a repeated row and columns with clashing names."""
    rows = [(k, text, "n", k, True) for k, text in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[3], "n", 3, True), (None, "a row without id", None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, `a.b` string, n_tokens long, kept boolean").withColumn("label", F.lit("x"))


def empty_docs(spark):
    return odd_docs(spark).where("false")


# --- 1, 8: byte-level BPE -------------------------------------------------------------------

@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def test_pretokens_give_the_librarys_ids(bpe):
    random.seed(3)
    parts = ["a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'S", "!", "<|endoftext|>",
             "中", "　", "\U00020000", "\U0001f600", " ", "\r\n", "​", "\x85"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    made = Pretokens(*prepared(BPE), limit=500)
    expected = [e.ids for e in bpe.encode_batch(texts, add_special_tokens=False)]
    found, counts = [], []
    for k in range(0, len(texts), 250):
        found += [x.tolist() for x in made.ids(texts[k:k + 250])]
        counts += made.counts(texts[k:k + 250])
    assert found == expected and counts == [len(x) for x in expected]


def test_token_files_round_trip(spark, bpe):
    docs = odd_docs(spark)
    folder = fresh_path(spark, "token-test")
    manifest = write_token_files(docs, BPE, folder)
    rows = read_token_files(manifest).orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    start, text = 0, {k: t or "" for k, t in enumerate(ODD_TEXTS)} | {None: "a row without id"}
    for r in rows:
        ids = np.array(bpe.encode(text[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: list(r.ids) for r in fetch_documents(manifest, [5, 7, 99]).collect()}
    assert got == {k: bpe.encode(ODD_TEXTS[k], add_special_tokens=False).ids + [0] for k in (5, 7)}
    reader = ShardReader(manifest.first().path)
    assert len(reader.counts) == manifest.first().documents
    none = write_token_files(empty_docs(spark), BPE, fresh_path(spark, "token-test"))
    assert read_token_files(none).count() == 0


def test_damaged_frame_is_noticed(spark):
    docs = spark.createDataFrame([(1, "some words to keep " * 50)], "doc_id long, text string")
    path = write_token_files(docs, BPE, fresh_path(spark, "token-test")).first().path
    name = path.removeprefix("file://")
    with open(name, "rb") as file:
        data = bytearray(file.read())
    data[20] ^= 0xFF
    with open(name, "wb") as file:
        file.write(data)
    with pytest.raises(Exception):
        list(ShardReader(path).documents())


def test_token_counts(spark, bpe):
    rows = count_tokens(odd_docs(spark), BPE, limit=40).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for r in rows:
        size = len(bpe.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), size, size > 40)
    assert count_tokens(empty_docs(spark), BPE).count() == 0


# --- 10: SentencePiece ----------------------------------------------------------------------

def test_piece_ids(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    random.seed(4)
    parts = ["a", "the", "é", "1", " ", "  ", "     ", "\n", "\t", "'", "!", "<s>", "</s>", "<unk>", "<0x0A>", "中",
             "▁", "\U0001f600", " ", "\r\n", "\0"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    chunks = Chunks(open(PIECES, "rb").read(), limit=200)
    assert chunks.proved
    for text, (ids, decimals) in zip(texts, chunks.ids(np.frombuffer(b"".join(raw), np.uint8), offsets), strict=True):
        assert ids == model.encode(text), repr(text)
        assert decimals.decode().split() == [str(i) for i in ids]
    for r in encode_pieces(odd_docs(spark), PIECES).collect():
        assert r.ids == model.encode(r.text or "") + [model.eos_id()] and r.n_tokens == len(r.ids)
        assert r.decoded == model.decode(r.ids)
    for r in encode_pieces(odd_docs(spark), PIECES, digests=True).collect():
        ids = model.encode(r.text or "") + [model.eos_id()]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert encode_pieces(empty_docs(spark), PIECES).count() == 0


# --- 2: decontamination ---------------------------------------------------------------------

def test_fm_index_finds_every_phrase():
    random.seed(5)
    for _ in range(60):
        width = random.choice([2, 3, 4])
        items = [(str(k), " ".join(random.choice("abcdef") for _ in range(random.randint(0, 6)))) for k in range(4)]
        docs = [" ".join(random.choice(["a", "b", "c", "d", "zz"]) for _ in range(random.randint(0, 40))) for _ in range(5)]
        phrases = Phrases(items, width)
        data, offsets = utf8(pa.array(docs))
        starts, ends, first = words(data, offsets, ALNUM)
        at, size, phrase = phrases.find(word_hashes(data, starts, ends), first)
        names = [[" ".join(t.split()[k:k + n]) for n in [min(width, len(t.split()))] for k in range(len(t.split()) - n + 1)]
                 if t.split() else [] for _, t in items]
        found = collections.Counter()
        every = [w for d in docs for w in d.split()]
        for a, n, p in zip(at.tolist(), size.tolist(), phrase.tolist(), strict=True):
            text = " ".join(every[a:a + n])
            assert all(text in names[k] for k in phrases.owners[p])
            found[text] += 1
        expected = collections.Counter()
        for text in {x for part in names for x in part}:
            n = len(text.split())
            for d in docs:
                w = d.split()
                expected[text] += sum(" ".join(w[k:k + n]) == text for k in range(len(w) - n + 1))
        assert found == +expected


def test_contamination_spans_blocks_and_edges(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame(
        [(1, f"é start, {passage.upper()}! end"), (2, "nothing here"), (3, None), (4, passage + " " + passage),
         (5, "short one"), (None, passage)], "doc_id long, text string")
    docs = docs.withColumn("spans", F.lit(1))
    items = spark.createDataFrame([(7, passage), (8, "Short one"), (8, "Short one"), (9, None), (None, passage), (10, "..")],
                                  "item_id long, text string")
    for block_words in (1_000_000, 3):
        rows = {r.doc_id: r for r in find_contamination(docs, items, block_words=block_words, cleaned="left").collect()}
        assert rows[1].n_hit == 12 and rows[1].item_ids == ["7"]
        (span,) = rows[1].spans
        assert rows[1].text[span.start:span.end] == passage.upper() and rows[1].left == "é start, \n! end"
        assert (rows[2].n_words, rows[2].n_hit, rows[2].left) == (2, 0, "nothing here")
        assert (rows[3].n_words, rows[3].n_hit, rows[3].left) == (0, 0, None)
        assert rows[4].n_hit == 24 and rows[5].item_ids == ["8"] and rows[5].left == "\n"
        assert rows[None].n_hit == 12
    assert find_contamination(docs, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert find_contamination(empty_docs(spark), items).count() == 0
    assert find_contamination(odd_docs(spark), items).count() == len(ODD_TEXTS) + 2


# --- 3: toxicity ----------------------------------------------------------------------------

def _synthetic_texts(toxic: int, ordinary: int):
    random.seed(6)
    syllables = ["an", "er", "the", "on", "is", "ti", "ha", "re", "ing", "nd"]

    def word():
        return "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))

    def text(bad):
        out = [word() for _ in range(random.randint(30, 120))]
        for _ in range(bad):
            out.insert(random.randrange(len(out)), random.choice(["grobnik", "vilesome", "drekulous"]))
        return " ".join(out).capitalize() + "."

    return [text(random.randint(2, 6)) for _ in range(toxic)], [text(0) for _ in range(ordinary)]


def test_toxicity_holds_out_and_edges(spark):
    toxic, ordinary = _synthetic_texts(240, 700)
    model = fit_toxicity([t.encode() for t in toxic[:180]], [t.encode() for t in ordinary[:500]])
    bad, good = model.scores([t.encode() for t in toxic[180:]]), model.scores([t.encode() for t in ordinary[500:]])
    assert (bad >= 0.5).mean() >= 0.85 and (good >= 0.5).mean() <= 0.03
    rows = score_toxicity(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    empty = {r.doc_id: r.score for r in rows}
    assert empty[0] == empty[1] == empty[2] < 0.5
    assert score_toxicity(empty_docs(spark), model).count() == 0
    for texts in (([], []), ([b"only bad"], []), ([], [b"only good"])):
        assert 0 < fit_toxicity(*texts).scores([b"", b"some words"]).max() < 1


def test_windows_cover_every_word():
    random.seed(7)
    for size in (0, 1, 7, 8, 9, 15, 16, 100):
        text = [f"w{k}" for k in range(size)]
        pieces, first = windows([b"x", " ".join(text).encode(), b""])
        own = pieces[first[1]:first[2]]
        assert [w for w in text if not any(f" {w} ".encode() in p for p in own)] == []
        assert first[3] == first[2] and (first[2] - first[1] > 0) == (size > 0)


# --- 4: n-gram join -------------------------------------------------------------------------

def brute_components(rows, width=5):
    sets, ids = [], [i for i, _ in rows]
    for _, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    random.seed(8)
    common = [random.choice("abcdefgh") + str(random.randint(0, 30)) for _ in range(120)]
    rows = []
    for family in range(12):
        base = common[:random.randint(3, 110)] + [f"f{family}x{k}" for k in range(random.randint(0, 60))]
        for _ in range(10):
            text = list(base)
            for _ in range(random.randint(0, 4)):
                text[random.randrange(len(text))] = f"e{random.randint(0, 10**6)}"
            rows.append((len(rows) + 5, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, "Two words"), (1003, "two WORDS"), (1004, "two words more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_components(rows)
    for frequent in (nj.FREQUENT, 0):  # with no bar, most tokens are frequent and signed in pairs
        monkeypatch.setattr(nj, "FREQUENT", frequent)
        found = {r.id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs).collect()}
        assert found == expected


def test_ngram_join_of_a_large_near_copy_group(spark):
    random.seed(21)
    base = [f"w{random.randint(0, 400)}" for _ in range(90)]
    other = base[:70] + [f"v{k}" for k in range(20)]
    rows = []
    for k in range(500):
        text = list(other if k % 3 == 0 else base)
        for _ in range(random.randint(0, 7)):
            at = random.randrange(len(text))
            text[at:at + random.randint(0, 1)] = random.choice(([], [f"e{random.randint(0, 40)}"]))
        rows.append((k, " ".join(text)))
    expected = brute_components(rows)
    assert len({c for _, c in expected.values()}) > 20  # copies far from all others stay alone
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs).collect()} == expected


def test_prefix_signatures_always_meet():
    random.seed(9)
    rng = np.random.default_rng(9)
    for trial in range(300):
        size = int(rng.integers(4, 90))
        tokens = rng.choice(2**62, 2 * size, replace=False).astype(np.uint64)
        common = rng.random(2 * size) < rng.random()
        order = {int(t): (bool(c), int(t)) for t, c in zip(tokens, common, strict=True)}
        x = set(tokens[:size].tolist())
        y = set(random.sample(sorted(x), size - int(rng.integers(0, size // 4 + 1))))
        while len(y) < size and rng.random() < 0.7:
            y.add(int(tokens[size + len(y) - 1]))
        both = len(x & y)
        if 100 * both < 75 * len(x | y):
            continue
        made = []
        for s in (x, y):
            ranked = sorted(s, key=order.get)
            flags = np.array([order[t][0] for t in ranked])
            made.append(set(nj.signatures(np.array(ranked, np.uint64), flags).tolist()))
        assert len(made[0] & made[1]) >= min(nj.spare(len(x)), nj.spare(len(y))), trial


def test_ngram_join_edges(spark):
    rows = {(r.id, r.n_shingles, r.component_id) for r in nj.ngram_join(odd_docs(spark)).collect()}
    assert {(None, 1, None), (0, 0, 0), (1, 0, 1), (3, 0, 3)} <= rows
    assert nj.ngram_join(empty_docs(spark)).count() == 0
    shared = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (2, "a b c d e f"), (9, "u v w x y z")],
                                   "doc_id long, text string")
    assert {r.component_id for r in nj.ngram_join(shared).collect()} == {1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)] + [(1000, 1001), (7, 7)], "a long, b long")
    rows = {r.node: r.label for r in components(edges).collect()}
    assert rows == {k: 0 for k in range(401)} | {1000: 1000, 1001: 1000}
    assert components(edges.where("false")).count() == 0


# --- 5: line quality ------------------------------------------------------------------------

def test_line_quality_counts_and_rules(spark):
    random.seed(10)

    def line():
        return " ".join("".join(random.choice("aeioubdkl") for _ in range(6)) for _ in range(14)).capitalize() + "."

    lines, good = [line() for _ in range(8)], line()
    texts = [
        "\n".join(lines),
        "\n".join(f"Home{k} | News{k} | Sport{k} | Contact{k} | About{k} us{k}" for k in range(20)) + "\n" + good,
        "\n".join(lines) + "\nAll rights reserved.\nHome\nread more >>",
        "w### " * 60, "same words here " * 40, good, None, "", " \n\t\n",
        " ".join("".join(random.choice("ab#|\n x") for _ in range(9)) for _ in range(80)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in line_quality(docs).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        w = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        runs = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert (rows[k].n_words, rows[k].word_chars, rows[k].n_symbols, rows[k].n_dup_lines, rows[k].n_repeat_words,
                rows[k].base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
                                         len(lines) - len(set(lines)), len(hit), failed)
    assert [rows[k].kept for k in range(6)] == [True, False, True, False, False, False]
    assert rows[2].cleaned == texts[0] and rows[6].cleaned is None and rows[7].cleaned == ""
    odd = line_quality(odd_docs(spark))
    assert odd.count() == len(ODD_TEXTS) + 2 and "a.b" in odd.columns
    assert line_quality(empty_docs(spark)).count() == 0


# --- 6: Hilbert sharding --------------------------------------------------------------------

@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_path(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(
        *(F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{k}") for k in range(n)))
    rows = cells.withColumn("h", hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(x[k] - y[k]) for k in range(n)) == 1 for x, y in zip(rows, rows[1:], strict=False))


def test_shards_are_runs_of_equal_size(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("a"), F.lit(1).alias("place"))
    rows = rows.unionByName(rows.limit(5))
    made = assign_shards(rows, [F.col("a").cast("int"), F.lit(0)], ["doc_id"], shards=16).collect()
    sizes = collections.Counter(r.shard for r in made)
    assert len(made) == 1008 and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in made if r.shard == shard) == list(range(sizes[shard]))
    order = [r.a for r in sorted(made, key=lambda r: (r.shard, r.slot))]
    assert sum(x != y for x, y in zip(order, order[1:], strict=False)) == 2
    assert assign_shards(rows.where("false"), [F.col("a").cast("int")], ["doc_id"]).count() == 0
    assert sorted(r.shard for r in assign_shards(rows.limit(1), [F.lit(None).cast("int")], ["doc_id"]).collect()) == [0]


# --- 7: suffix tree -------------------------------------------------------------------------

def test_suffix_tree_base_scores_and_distributions(spark):
    random.seed(11)
    phrases = ["the cat sat on the mat", "a dog ran to the park", "the end of the day"]
    texts = [" ".join(random.choice(phrases) if random.random() < 0.8 else f"rare{random.randint(0, 300)}" for _ in range(30))
             for _ in range(60)] + ["", None, "The unseen WORDS"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.id: r for r in language_model_scores(docs, lambda key: F.col(key) % 7 != 2).collect()}
    tokens = [SPACED.findall((t or "").translate(LOWER)) + ["\n"] for t in texts]
    count = collections.Counter(w for k, t in enumerate(tokens) if k % 7 != 2 for w in t)
    total, distinct = sum(count.values()), len(count)
    for k, t in enumerate(tokens):
        base = sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in t)
        assert (rows[k].n_tokens, rows[k].n_known, rows[k].train_tokens) == (len(t), sum(w in count for w in t), total)
        assert abs(rows[k].base_score - base) < 1e-6
    out = [k for k in range(60) if k % 7 == 2]
    assert sum(rows[k].score for k in out) > 0.7 * sum(rows[k].base_score for k in out)
    assert language_model_scores(empty_docs(spark), lambda key: F.lit(True)).count() == 0
    nothing = language_model_scores(odd_docs(spark), lambda key: F.lit(False)).collect()
    assert len(nothing) == len(ODD_TEXTS) + 2 and all(r.score == r.base_score == 0 for r in nothing)


def test_suffix_tree_distributions_sum_to_one(spark):
    random.seed(12)
    texts = [" ".join(random.choice(["a b c", "a b d", "x y", f"q{random.randint(0, 40)}"]) for _ in range(40))
             for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tree, _ = train_suffix_tree(docs, symbols=20)
    from pricelode.llm.suffix_tree_lm import _log
    every = np.arange(tree.symbols + 1)
    assert abs((10 ** tree.root()).sum() - 1) < 1e-9
    assert any(d.retained.any() for d in tree.depths)
    for depth, level in enumerate(tree.depths, 1):
        for context in range(len(level.contexts)):
            chance = 10 ** _log(tree, np.full(len(every), context), every, depth)
            assert abs(chance.sum() - 1) < 1e-9


def brute_scores(train, texts, depth=3, least_context=8, least_entry=2, discount=0.75):
    """Scores of the tree over all words, from dictionaries of whole word runs."""
    def split(t):
        return [*SPACED.findall((t or "").translate(LOWER)), "\n"]

    runs = collections.Counter(tuple(w[i:i + n]) for w in map(split, train) for n in range(1, depth + 2)
                               for i in range(len(w) - n + 1))
    one = {k[0]: n for k, n in runs.items() if len(k) == 1}
    total = sum(one.values()) + len(one) + 1
    following, kept = collections.defaultdict(dict), {}
    for run, n in runs.items():
        if len(run) > 1 and n >= least_entry and runs[run[:-1]] >= least_context:
            following[run[:-1]][run[-1]] = n

    def chance(context, word):
        if not context:
            return (one.get(word, 0) + 1) / total
        return inside(context, word) if kept.get(context) else chance(context[1:], word)

    def rest(context):
        next_, size = following[context], runs[context]
        return (discount * len(next_) + size - sum(next_.values())) / size

    def inside(context, word):
        own = max(following[context].get(word, 0) - discount, 0) / runs[context]
        return own + max(rest(context), 1e-12) * chance(context[1:], word)

    for context in sorted(following, key=len):
        next_, size = following[context], runs[context]
        gain = sum(n * np.log(inside(context, w) / chance(context[1:], w)) for w, n in next_.items())
        gain += (size - sum(next_.values())) * np.log(max(rest(context), 1e-12))
        kept[context] = gain > len(next_) * np.log(max(size, 2)) / 2
    out = []
    for w in map(split, texts):
        out.append(sum(np.log10(chance(tuple(w[max(0, i - depth):i]), w[i])) for i in range(len(w))))
    return out, sum(kept.values())


def test_suffix_tables_equal_brute_force_with_any_head(spark):
    random.seed(14)
    phrases = ["the cat sat on the mat", "a dog ran to the park", "the end of the day", "on the day"]
    texts = [" ".join(random.choice(phrases) if random.random() < 0.8 else f"rare{random.randint(0, 60)}" for _ in range(30))
             for _ in range(60)] + ["", None, "The unseen WORDS"]
    expected, kept = brute_scores(texts[:40], texts)
    assert kept > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = train_suffix_tables(docs.where("id < 40"))
    for head, tree_head in ((1 << 18, 1 << 20), (5, 9)):  # the head is a shortcut only
        rows = {r.id: r for r in score_texts(docs, model, head=head, tree_head=tree_head).collect()}
        assert max(abs(rows[k].score - expected[k]) for k in range(len(texts))) < 1e-6


def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(spark):
    rng = np.random.default_rng(15)
    filler = [" ".join(f"w{k}" for k in rng.permutation(20_000)) for _ in range(110)]  # over 2^21 tokens and 2^14 words
    docs = spark.createDataFrame([*enumerate(filler), *((1000 + k, "zig zag zog") for k in range(10))],
                                 "doc_id long, text string").repartition(8)
    rows = {r.id: r for r in language_model_scores(docs, lambda key: F.col(key) != 1009).where("id >= 1000").collect()}
    assert rows[1009].score > rows[1009].base_score + 10


# --- 9: licences ----------------------------------------------------------------------------

def test_license_scan(spark):
    random.seed(13)
    filler = [" ".join(random.choice(["stone", "river", "walk", "lamp", "green", "of", "the"]) for _ in range(12))
              for _ in range(40)]
    notices = {1: ("Released under the MIT License.", "MIT"), 2: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
               3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
               4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), 5: ("He lost his license in the river.", ""),
               6: ("The permission of the town was public.", "")}
    rows = [(k, "\n".join([filler[k], line, filler[-k]])) for k, (line, _) in notices.items()]
    rows += [(k + 100, "\n".join(filler[k:k + 3])) for k in range(30)] + [(200, None), (201, ""), (None, "\n\n")]
    found = {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    assert {k: found[k].families for k in notices} == {k: family for k, (_, family) in notices.items()}
    assert found[1].licenses[0].place == 1 and found[1].n_paragraphs == 3
    assert all(found[k].n_licensed == 0 for k in [*range(100, 130), 200, 201, None])
    assert scan_licenses(odd_docs(spark)).count() == len(ODD_TEXTS) + 2
    assert scan_licenses(empty_docs(spark)).count() == 0


def test_license_scan_reads_wrapped_notices_and_versions(spark):
    random.seed(16)
    filler = [" ".join(random.choice(["stone", "river", "walk", "lamp", "green", "of", "the"]) for _ in range(12))
              for _ in range(12)]
    wrapped = ("    This program is free software: you can redistribute it and/or modify\n"
               "    it under the terms of the GNU General Public License as published by\n"
               "    the Free Software Foundation, either version 3 of the License, or\n"
               "    (at your option) any later version.")
    notices = {1: (wrapped, "GPL-3.0"), 2: (wrapped.replace("version 3", "version 2"), ""),
               3: ("This work is licensed under the GNU General Public License, version 2.", ""),
               4: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
               5: ("Licensed under the Apache License, Version 1.1.", ""),
               6: ("Licensed under the\nApache License, Version 2.0.", "Apache-2.0")}
    rows = [(k, f"{filler[k]}\n\n{text}\n \n{filler[-k]}") for k, (text, _) in notices.items()]
    found = {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: found[k].families for k in notices} == {k: family for k, (_, family) in notices.items()}
    assert [x.place for x in found[1].licenses] == [2] and [x.place for x in found[4].licenses] == [2]


def test_license_scan_reads_every_window_of_a_line(spark):
    mit, apache, cc = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: CC-BY-4.0"
    fill = " ".join(f"stone{k % 50} river{k % 7} lamp" for k in range(60))
    rows = [(1, f"{mit} {apache}"), (2, f"{mit} {fill} {apache} {fill} {cc}"), (3, f"{fill} {mit} {fill}"), (4, fill),
            (5, "Licensed under the GNU Lesser General Public License, version 3.")]
    found = {r.id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k].families for k in range(1, 6)] == ["Apache-2.0,MIT", "Apache-2.0,CC-BY-4.0,MIT", "MIT", "", "LGPL-3.0"]
    assert found[2].n_licensed == 3 and found[2].n_candidates == 1


def test_license_threshold_comes_from_held_out_candidates(spark):
    near = [f"He has a licence of the town and version {k} of the general public map" for k in range(40)]
    docs = spark.createDataFrame([(0, "no stem in this text")], "doc_id long, text string")
    for lines in (near, []):
        found = with_words(spark.createDataFrame([(x,) for x in lines], "paragraph string"))
        weights, _, least = train_licenses(docs, found, sample=10)
        grams = {r.gram for r in weights.where("family = 'unknown'").select("gram").collect()}
        assert ("licence of the" in grams or "town" in grams or "map" in grams) == bool(lines) and 0.5 <= least <= 0.95


def test_long_blocks_are_scanned_in_time_in_proportion_to_their_words(spark):
    """A document without blank lines is one block: 20,000 words in 2,000 lines, with a notice among them."""
    random.seed(17)
    lines = [" ".join(random.choice(["stone", "river", "licence", "lamp", "green", "of", "the"]) for _ in range(10)) for _ in range(2000)]
    lines[1000:1000] = ["Licensed under the", "Apache License, Version 2.0."]
    docs = spark.createDataFrame([(k, "\n".join(lines)) for k in range(4)], "doc_id long, text string")
    started = time.monotonic()
    found = scan_licenses(docs).collect()
    assert len(found) == 4 and all("Apache-2.0" in r.families for r in found)
    assert time.monotonic() - started < 120
