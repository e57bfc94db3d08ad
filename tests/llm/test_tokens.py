"""Encoding, editing and shards against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from oddsloom.llm import binary_ids, bpe, lexicon, pretokens, token_edits
from pyspark.sql import functions as F

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "s", "the", "'", "'s", "'re", " ", "  ", "\n", "\t", "\xa0", "1", "²", "é", "!", "...", "ß", "e", "́", "中", "\x1c", "　", "😀", "Σ", "ΑΣ ", "<|endoftext|>", "<|end", "'LL"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 5, 20, 200]))) for _ in range(n)]


@pytest.mark.parametrize("pattern", ["spaced", "bare"])
def test_pretokens_equal_the_pattern(pattern):
    form = {"spaced": public_tokenizers.PATTERN, "bare": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}[pattern]
    batch = texts(600)
    found, bounds = pretokens.words(batch, pattern)
    d = pretokens.distinct(batch, pattern)
    vocabulary = d.words()
    assert [vocabulary[k] for k in d.which] == found and d.bounds.tolist() == bounds
    assert len(set(vocabulary)) == len(vocabulary) and d.chars.tolist() == list(map(len, vocabulary))
    for k, t in enumerate(batch):
        assert found[bounds[k] : bounds[k + 1]] == regex.findall(form, t)


def found(lex, words):
    size = np.array([len(w) for w in words])
    return lex.find(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size).tolist()


def test_all_code_points_equal_the_library():
    """Each alone, after a letter, a space and a digit, and in a row of neighbours."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    batch = [f"a{x}a {x}{x}1{x} {x}b" for x in points] + ["".join(points[k : k + 50]) for k in range(0, len(points), 50)]
    # Planes without any character are all alike: one code point in 50 will do.
    planes = [k for k, x in enumerate(batch) if k >= len(points) or ord(points[k]) < 0x33500 or 0xE0000 <= ord(points[k]) < 0xE0200 or k % 50 == 0]
    batch = [batch[k] for k in planes]
    for coder, path in ((lexicon.Coder(None, BYTE), BYTE), (binary_ids.WordCoder(WORD), WORD)):
        library = Tokenizer.from_file(path)
        ids, cut = coder.encode(batch)
        want = library.encode_batch_fast(batch, add_special_tokens=False)
        wrong = [batch[k] for k, e in enumerate(want) if ids[cut[k] : cut[k + 1]].tolist() != e.ids]
        assert not wrong, (path, len(wrong), wrong[:5])


def test_lexicon_and_merges(tmp_path):
    library, batch = Tokenizer.from_file(BYTE), [*texts(600), "a" * 3000, "ab" * 700]
    some = pretokens.words(batch[:300], "spaced")[0]
    (tmp_path / "x.bin").write_bytes(lexicon.compile_lexicon(some, BYTE))
    known = lexicon.Lexicon(str(tmp_path / "x.bin"))
    raw = sorted({w.encode() for w in some})
    assert found(known, raw) == list(range(len(raw))) and found(known, [b"not there", b""]) == [-1, -1]
    assert len(known.finals) < len({w[:k] for w in raw for k in range(len(w) + 1)})  # endings are shared
    for path in (BYTE, WORD):
        ids, at = bpe.merge_words(path, [*raw, b"a" * 3000, b""])
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [bpe.merge(bpe.load(path), w) for w in [*raw, b"a" * 3000, b""]]
    for lex in (known, None):
        coder = lexicon.Coder(lex, BYTE)
        ids, cut = coder.encode(batch)
        for k, e in enumerate(library.encode_batch(batch, add_special_tokens=False)):
            assert ids[cut[k] : cut[k + 1]].tolist() == e.ids
        assert coder.decode(ids, cut) == batch


def test_coding_query(spark):
    df = odd.docs(spark)
    library = Tokenizer.from_file(BYTE)
    file = lexicon.fit(df, n=20)
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.digests(df, file).collect()}
    want = set()
    for d, t, *_ in odd.ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows == want
    coded = lexicon.encode(df, file)
    assert coded.columns == [c for c in df.columns if c != "ids"] + ["ids"] and coded.count() == len(odd.ROWS)
    assert lexicon.digests(odd.docs(spark, []), file).collect() == []


def test_edits_equal_a_full_count(spark):
    count, rng = token_edits.Counter(BYTE), random.Random(3)
    for t in [*texts(150, 5), "x " * 3000]:
        lengths, tokens = count(t)
        tree = token_edits.TokenTree(t, lengths, tokens, count)
        for _ in range(rng.choice([1, 4])):
            at, cut, put = rng.randint(0, len(t) + 2), rng.choice([0, 1, 3, 500]), "".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 90])))
            tree.edit(at, cut, put)
            at = min(at, len(t))
            t = t[:at] + put + t[at + cut :]
            full = count(t)
            assert np.concatenate([b[0] for b in tree.blocks]).tolist() == full[0].tolist() and tree.n_tokens == full[1].sum()
    long = "some words here " * 5000
    tree = token_edits.TokenTree(long, *count(long), count)
    tree.edit(40_000, 3, "new")
    assert tree.rescanned < 500
    edits = F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("cut"), F.lit(" put").alias("put")))
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    rows = token_edits.count_edited(odd.docs(spark), edits).collect()
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted((n(t or ""), n((t or "")[:3] + " put" + (t or "")[5:])) for _, t, *_ in odd.ROWS)
    assert sorted((r.n_tokens, r.n_tokens_edited) for r in rows) == want


def test_shards(spark):
    rng = np.random.default_rng(1)
    for sizes in ([0], [3], [0, 0, 5], [1] * 200, [5000, 0, 1], [0] * 70 + [1 << 18], rng.integers(0, 2000, 500).tolist()):
        n = np.array(sizes, np.int64)
        who = np.sort(rng.integers(-(1 << 40), 1 << 40, len(n)))
        who[: len(n) // 3] = binary_ids.NO_ID
        shard = binary_ids.Shard(binary_ids.pack(who, n, np.arange(n.sum()) % 70_000))
        assert shard.bounds().tolist() == [0, *np.cumsum(n).tolist()] and shard.identifiers().tolist() == who.tolist()
        for k in range(len(n)):
            assert shard.document(k).tolist() == (np.arange(n[:k].sum(), n[: k + 1].sum()) % 70_000).tolist()
    big = np.arange(0, 10_000_000, 977)
    assert sum(map(len, binary_ids.Growing.coded(big))) < len(big) * 2  # 16 bits a number
    with pytest.raises(ValueError):
        binary_ids.Shard(binary_ids.pack(np.array([1]), np.array([3]), np.arange(3))[:-1])
    library = Tokenizer.from_file(WORD)
    rows = [(k, t, None, None, 0, 0.0) for k, t in enumerate(texts(120))] + odd.ROWS
    got = sorted(binary_ids.read_shards(binary_ids.write_shards(odd.docs(spark, rows), shard_ids=300)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = sorted((r[0] is not None, r[0] or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows for ids in [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert binary_ids.read_shards(binary_ids.write_shards(odd.docs(spark, []))).collect() == []
