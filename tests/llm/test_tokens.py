"""Pre-tokenization, byte-level BPE and record files against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, pieces, records

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab'stmdrevl  \n\t1２²é中_!.\x1c\xa0 ｡😀"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n=400, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pieces_are_the_matches_of_the_pattern():
    pattern = regex.compile(P.PATTERN)
    own = texts(1, 2000)
    joined, bounds, hashes, first = pieces.split(own)
    for i, text in enumerate(own):
        got = [joined[bounds[j]:bounds[j + 1]] for j in range(first[i], first[i + 1])]
        assert got == [m.group() for m in pattern.finditer(text)]
    by_hash = {}
    for j, h in enumerate(hashes.tolist()):
        assert by_hash.setdefault(h, joined[bounds[j]:bounds[j + 1]]) == joined[bounds[j]:bounds[j + 1]]


def test_ids_are_those_of_the_library(reference):
    own = [*texts(2), "a" * 700, "ab" * 3000, "\n" * 300 + " " * 200, "é" * 900, "<|endoftext|> x", "", None]
    for text, ids in zip(own, bpe.encode(PATH, own)):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert bpe.decode(PATH, ids).decode() == (text or "")


def test_one_tree_and_many_trees_agree():
    vocabulary = bpe.Vocabulary(PATH)
    for text in texts(3, 200, 40):
        ids, size = bpe.encode_pieces(vocabulary, [text]) if text else (np.zeros(0, int), [0])
        if len(ids) > 1:
            assert bpe.merge_one(vocabulary, text.encode()) == ids.tolist()


def test_cache_forgets_without_changing_ids(reference):
    vocabulary = bpe.Vocabulary(PATH)
    cache = pieces.PieceCache(lambda p: bpe.encode_pieces(vocabulary, p), limit=20)
    for text in texts(4, 60):
        ids, first = cache.encode([text, text])
        assert ids[:first[1]].tolist() == ids[first[1]:].tolist() == reference.encode_ordinary(text)


def test_tokenize_awkward_rows(awkward, empty, reference):
    got = bpe.tokenize(awkward, PATH, keep_ids=True).collect()
    assert len(got) == awkward.count() and bpe.tokenize(empty, PATH).count() == 0
    want = sorted((r.doc_id or -1, reference.encode_ordinary(r.text or ""), r.text or "") for r in awkward.select("doc_id", "text").collect())
    for row, (_, ids, text) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.ids)), want):
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_frames_tell_damage():
    data = bytearray(records.frame(b"abc") + records.frame(b""))
    first, place = records.unframe(memoryview(data))
    assert bytes(first) == b"abc" and bytes(records.unframe(memoryview(data), place)[0]) == b""
    for i in range(place):
        data[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(data))
        data[i] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(data)[:-1], place)
    assert records.unpack(memoryview(records.pack(None, np.array([70000]))))[1].tolist() == [70000]


def _digest_by_hand(rows):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records_give_back_what_was_written(documents):
    got = sorted(map(tuple, records.write_and_digest(documents, P.path("byte_bpe_50k.json")).collect()))
    assert got == _digest_by_hand(sorted(map(tuple, documents.select("doc_id", "text").collect())))


def test_records_of_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = records.write_and_digest(awkward, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows) and records.write_and_digest(empty, P.path("byte_bpe_50k.json")).count() == 0
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert sorted(r.ids_crc32 for r in got) == sorted(x[3] for x in _digest_by_hand(rows))


def test_records_can_be_read_in_any_order(documents, spark):
    from tidemark.session import scratch_path

    index = records.write_records(documents, scratch_path(spark, "records"), P.path("byte_bpe_50k.json"))
    straight = {(r.file_no, r.start_in_file): bytes(r.ids) for r in records.read_records(index).collect()}
    shuffled = {(r.file_no, r.start_in_file): bytes(r.ids) for r in records.read_records(index.orderBy("size")).collect()}
    assert straight == shuffled and len(straight) == documents.count()


def test_added_tokens_are_those_of_the_unaltered_library(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    own = [f"a {end} b", end, end * 3 + "x", f"it {end}'s  {end}\n ", "<|endoftext|", f"é中{end}😀", "no such token", "", None, f"<|{end}|>", ("wort " * 5000 + end) * 3]
    own += ["".join(random.Random(i).choice([end, "<|", "|>", "endoftext", " ", "a", "'s", "é"]) for _ in range(i % 9)) for i in range(60)]
    rows, start, want = list(enumerate(own)), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, records.write_and_digest(docs, P.path("byte_bpe_50k.json")).collect())) == want


def thue_morse(letters="ab", rounds=10):
    """Two long words whose polynomial hashes modulo a power of two are equal."""
    a, b = letters
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_pieces_with_equal_hashes_keep_their_own_ids(spark, reference):
    a, b = thue_morse()
    assert len(set(pieces.split([a, b])[2].tolist())) == 1  # the hashes do meet
    own = [a, b, f"x {b} {a} y", None, f"{a}\n{b}", *(w[:1000] for w in (a, b))]
    for rows in (own, own[::-1]):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
        found = {r.doc_id: (r.ids, r.decoded_sha256) for r in bpe.tokenize(docs, PATH, keep_ids=True).collect()}
        assert found == {i: (reference.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(rows)}
        assert sorted(map(tuple, records.write_and_digest(docs, P.path("byte_bpe_50k.json")).collect())) == _digest_by_hand(list(enumerate(rows)))


def test_cache_is_bounded_by_characters():
    vocabulary = bpe.Vocabulary(PATH)
    cache = pieces.PieceCache(lambda p: bpe.encode_pieces(vocabulary, p), most=200)
    plain = pieces.PieceCache(lambda p: bpe.encode_pieces(vocabulary, p))
    for text in ["word " * 3, "long" * 100, "another one " * 20, *texts(8, 20)]:
        assert all(np.array_equal(x, y) for x, y in zip(cache.encode([text]), plain.encode([text])))
        assert cache._chars <= 200 or len(cache._place) <= len(set(pieces.split([text])[2].tolist()))
