"""WARC archives, the conversation trie and token alignment against brute force."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow.fs
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from pricelode.llm import catalog, conversation_trie as ct, token_alignment as ta  # noqa: E402
from pricelode.llm.warc_files import (  # noqa: E402
    MAGIC, chain_entries, chains, find_candidates, mark_revisits, read_warc, record_bytes, write_warc)
from pricelode.session import fresh_path  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- 11: archives ----------------------------------------------------------------------------

def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def hostile_pages():
    """Payloads that hold the magic, whole records, records that end at the real one's end, and copies."""
    inner = record_bytes(999, "http://in/", b"fake", 4, b32(b"fake"), None, False, "1970-01-01T00:00:00Z").decode()
    rng = random.Random(7)
    pages = [(1, "http://a/é x\n", "plain"), (2, None, inner), (3, "u", inner * 5), (4, "u", MAGIC.decode() * 40), (5, "u", ""),
             (6, "u", None), (7, "u", "plain"), (8, "u", "plain"), (None, "u", "plain"), (None, "u", "alone"), (9, "u", "twice"),
             (9, "u", "twice"), (10, "u", "x" * 5000), (-3, "u", inner + "\r\n\r\n"), (11, "u", "tail " + inner[:-4])]
    pages += [(100 + k, "u", "".join(rng.choice([inner, "text ", MAGIC.decode(), "\r\n\r\n", "é"]) for _ in range(rng.randrange(12))))
              for k in range(60)]
    return pages


def expected_records(pages):
    groups = collections.defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        data, ids = (html or "").encode(), groups[html or ""]
        best = max((i for i in ids if i is not None), default=None)
        again = len(ids) > 1 and page_id != best
        out.append((page_id, len(data), b32(data), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("split_bytes,file_bytes", [(150, 1 << 30), (1000, 4000), (1 << 24, 1 << 30)])
def test_archives_come_back_whole_whatever_payloads_hold(spark, split_bytes, file_bytes):
    pages = hostile_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("split", F.lit("x"))
    manifest = write_warc(mark_revisits(df).coalesce(2), fresh_path(spark, "warc"), file_bytes=file_bytes)
    rows = read_warc(manifest, split_bytes, payloads=True).collect()
    assert sorted((tuple(r[c] for c in FIELDS) for r in rows), key=str) == expected_records(pages)
    assert all(r.digest_ok and r.complete for r in rows)
    assert sorted(bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page_id not in (None, 9)) == sorted(
        html or "" for page_id, _, html in pages
        if (page_id, "response") in {(e[0], e[3]) for e in expected_records(pages)} and page_id not in (None, 9))
    assert find_candidates(manifest, split_bytes).count() > len(pages)  # payloads do hold candidates
    assert next(r.target_uri for r in rows if r.page_id == 1) == "http://a/%C3%A9%20x%0A"


def test_pointer_jumping_takes_logarithmically_many_rounds_and_reaches_every_split(spark):
    pages = [(k, "u", "p" * 100) for k in range(64)]
    manifest = write_warc(mark_revisits(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)),
                          fresh_path(spark, "warc"))
    size = manifest.first()["bytes"]
    candidates = find_candidates(manifest, 100)  # far more splits than records
    reached = {r.at for r in chain_entries(candidates, manifest, 100).collect()}
    assert reached == {r.at for r in candidates.collect()} | {size}


def test_broken_archives_keep_what_the_chain_reaches(spark):
    pages = [(k, "u", f"page {k}") for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(mark_revisits(df).coalesce(1).sortWithinPartitions("page_id"), fresh_path(spark, "warc"))
    path = manifest.first()["path"]
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        data = file.read()
    with fs.open_output_stream(name, compression=None) as out:
        out.write(data.replace(b"page 1", b"page X").replace(b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>",
                                                             b"\r\n\r\nWARC/9.9\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>"))
    rows = {r.page_id: r for r in read_warc(manifest, 128).collect()}
    assert sorted(rows) == [0, 1, 2] and not any(r.complete for r in rows.values())
    assert [rows[k].digest_ok for k in (0, 1, 2)] == [True, False, True]


def test_no_pages_give_no_records(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_warc(write_warc(mark_revisits(df), fresh_path(spark, "warc"))).count() == 0


def test_chain_intervals():
    rng = random.Random(3)
    for _ in range(50):
        at = sorted(rng.sample(range(100), 30))
        successor = [a + rng.randrange(1, 30) for a in at]
        leaves, tin, tout = chains(at, successor, 100)
        place = {a: k for k, a in enumerate(at)}
        for k in range(30):
            on, n = set(), k
            while n is not None:
                on.add(n)
                last, n = successor[n], place.get(successor[n])
            assert on == {j for j in range(30) if tin[j] <= tin[k] <= tout[j]}
            assert leaves[k] == (last if last >= 100 else -1)


# --- 12: conversations -----------------------------------------------------------------------

def trie_by_hand(turns):
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids.update(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n in members:
        weight = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += weight
            leaves[n[:d]] += not kids[n]
    return sorted(((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members), key=str)


def found_trie(spark, turns, **options):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df = df.withColumn("depth", F.lit("x")).withColumn("f1", F.lit(1)).repartition(5)
    return sorted((tuple(r) for r in ct.conversation_trie(df, **options).collect()), key=str)


def some_turns(seed, convs, texts, longest):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(-3 * convs, 3 * convs), convs):
        for t in range(rng.randrange(1, longest)):
            turns.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", "assistant", None]),
                          rng.choice(texts)))
    return turns


@pytest.mark.parametrize("seed,convs,texts,longest", [
    (1, 60, ["a", "b", None, "é" * 9], 12), (2, 20, ["a"], 40), (3, 200, ["a", "", "b" * 1000], 4)])
def test_trie_is_that_of_the_rebuilt_texts(spark, seed, convs, texts, longest):
    turns = some_turns(seed, convs, texts, longest) + [(None, 1, "user", "nobody's")]
    assert found_trie(spark, turns) == trie_by_hand(turns)


def test_colliding_fingerprints_are_found_and_done_again(spark, monkeypatch):
    turns = some_turns(4, 40, ["a", "b", "c", "d", "e"], 8)
    attempts = []
    inner = ct._same_texts
    monkeypatch.setattr(ct, "_same_texts", lambda keyed, nodes: attempts.append(inner(keyed, nodes)) or attempts[-1])
    assert found_trie(spark, turns, first_bits=1) == trie_by_hand(turns)
    assert attempts[0] is False and attempts[-1] is True


def test_long_conversations_and_long_lists_of_ends_span_tasks(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE_IDS", 7)
    monkeypatch.setattr(ct, "CHUNK", 16)
    turns = [(5, t, "user", str(t % 3)) for t in range(900)] + [(10 + 5 * k, 0, "user", "same") for k in range(300)]
    turns += [(10 + 5 * k, t, "user", "same") for k in range(300) for t in range(1, 9)]
    assert found_trie(spark, turns) == trie_by_hand(turns)


def test_trie_of_nothing_has_no_nodes_and_turnless_conversations_end_at_the_root(spark):
    assert found_trie(spark, []) == []
    lone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert found_trie(spark, [(lone, 0, "user", "cut off")]) == trie_by_hand([(lone, 0, "user", "cut off")])


def test_products_form_a_monoid():
    rng = np.random.default_rng(5)
    x = ct.residues(rng.integers(-2**63, 2**63, 50), rng.integers(-2**63, 2**63, 50))
    whole = ct.prefix_products(x, np.arange(50) == 0)
    by_hand = np.zeros(3, object)
    for k in range(50):
        by_hand = (by_hand * ct.BASES.astype(object) + x[k].astype(object)) % ct.PRIMES.astype(object)
        assert (whole[k].astype(object) == by_hand).all()
    back = ct.prefix_products(x[20:], np.arange(30) == 0)
    assert (ct.combined(np.tile(whole[19], (30, 1)), back, np.arange(1, 31)) == whole[20:]).all()


# --- 13: alignment ---------------------------------------------------------------------------

def aligned_by_hand(rows):
    byte_bpe = Tokenizer.from_file(BPE)
    byte_bpe.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    decoder = ta.byte_decoder()

    def piece(i):
        name = model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()

    def spans(ids, of):
        ends = np.cumsum([len(of(i)) for i in ids]).tolist()
        return list(zip([0, *ends], ends))

    docs = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = byte_bpe.encode(" " + text, add_special_tokens=False).ids if text else [], model.encode(text) if text else []
        token = lambda i: bytes(decoder[c] for c in byte_bpe.id_to_token(i))
        if not text or b"".join(map(token, a)) != whole or b"".join(map(piece, b)) != whole:
            docs.append(None)
            continue
        sa, sb = spans(a, token), spans(b, piece)
        pairs = [(x, y) for x, (p, q) in zip(a, sa) for y, (r, s) in zip(b, sb) if p < s and r < q]
        groups, low = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append("|".join(",".join(str(i) for i, (p, q) in zip(ids, span) if low <= p and q <= cut)
                                   for ids, span in ((a, sa), (b, sb))))
            low = cut
        docs.append((len(a), len(b), groups, pairs))
    count = collections.Counter(p for d in docs if d for p in d[3])
    highest = collections.Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return sorted(((k, len(d[2]) and d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == highest[p[1]] for p in d[3]),
                    sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) if d else (k,) + (0,) * 6 + ("",)
                   for (k, _), d in zip(rows, docs)), key=str)


ALIGNED_TEXTS = [None, "", " ", "\n", "Hello there, world.", "it's  12 <|endoftext|> é中\n x", "日本語のテキスト and 混ぜる", "mark ▁ here", "\0 nul",
                 "supercalifragilistic " * 30, "🎉🎊 naïve façade", "aaaa" * 50, "\t tab\r\n", "Hello there, world."]


@pytest.mark.parametrize("head_pairs", [0, 20, 1 << 20])
def test_alignment_and_counts(spark, head_pairs):
    rows = [*enumerate(ALIGNED_TEXTS), (4, ALIGNED_TEXTS[4]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit("x")).withColumn("a.b", F.lit(1))
    found = ta.aligned_counts(docs, BPE, PIECES, head_pairs=head_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == aligned_by_hand(rows)
    assert ta.aligned_counts(docs.where("false"), BPE, PIECES).count() == 0


def test_groups_are_the_two_texts(spark):
    docs = spark.createDataFrame([(1, ALIGNED_TEXTS[5]), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ta.token_groups(docs, BPE, PIECES).collect()}
    assert rows[2].a_ids == [] and sum(rows[1].a_sizes) == len(rows[1].a_ids) and len(rows[1].a_sizes) == len(rows[1].b_sizes)


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    with open(PIECES, "rb") as file:
        aligner = ta.Aligner(ta.prepared(BPE), file.read())
    text = "".join(rng.choice("ab é中 \n<>|x") for _ in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    a, b, last_a, last_b, ends_a, ends_b = next(aligner.documents(data, offsets))
    digest = aligner.groups_digest(a, b, last_a, last_b)
    small_a, small_b = ta.shared_ends(ends_a, ends_b, 7)
    assert (small_a == last_a).all() and (small_b == last_b).all()
    monkeypatch.setattr(ta, "BLOCK", 11)
    assert aligner.groups_digest(a, b, last_a, last_b) == digest
    left, right = ta.links(last_a, last_b, ends_a, ends_b)
    assert len(left) == len(a) + len(b) - len(last_a) == len(set(zip(left.tolist(), right.tolist())))


def test_registered_queries_return_their_columns(spark):
    wanted = {"op11_warc_records": FIELDS,
              "op12_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                         "ends_sha256"],
              "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]}
    for name, columns in wanted.items():
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns
