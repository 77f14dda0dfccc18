"""SentencePiece, token counts and packing against brute force and the libraries themselves."""

import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import packing, pieces, token_counts, tokens

EDGE = [None, "", " ", "a", "  Two  blanks \n\n", "日本語 текст 😀 \x01 ﷽", "a" * 5000, "word " * 9000, "▁mark ▁", "<|endoftext|> </w> <0x41>", "é é İ ΑΣ ß", "x　y z\tq\x1cr"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGE + EDGE[3:8])], "doc_id long, text string, length long")
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "n_chars as length")
    return df.unionByName(more).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.model_path())


def plain_viterbi(model, text):
    """The same rule by all substrings of a dictionary."""
    known = {p: (i, s) for i, (p, s, k) in enumerate(model.pieces) if k == pieces.NORMAL}
    best = [(0.0, None)] + [None] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 20) + 1):
            hit = known.get(text[a:b])
            total = best[a][0] + (hit[1] if hit else model.unknown)
            if (hit or b == a + 1) and (best[b] is None or total > best[b][0]):
                best[b] = (total, (a, hit[0] if hit else None))
    out, n = [], len(text)
    while n:
        a, i = best[n][1]
        out += [i] if i is not None else [model.bytes[x] for x in reversed(text[a:n].encode())]
        n = a
    return out[::-1]


def test_double_array_holds_its_keys():
    random.seed(1)
    keys = sorted({bytes(random.choices(b"ab\x00\xff", k=random.randint(1, 6))) for _ in range(300)})
    trie = pieces.DoubleArray(keys)
    for text in (bytes(random.choices(b"ab\x00\xff", k=12)) for _ in range(300)):
        assert list(trie.prefixes(text, 2)) == [(e, keys.index(text[2:e])) for e in range(3, 13) if text[2:e] in keys]


def test_viterbi(model):
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choices("the ton re ▁ \né日😀", k=random.randint(1, 25)))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert list(model.encode(text)) == plain_viterbi(model, marked), text


def test_pieces_are_the_librarys(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert [p for p, _, _ in model.pieces] == [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    for text in (" Two  blanks\n", "日本語 😀 the end"):
        ids = [int(i) for i in model.encode(text)]
        assert sp.decode(ids) == model.decode(ids) == text


def test_pieces_round_trip(docs, model):
    rows = {r.doc_id: r for r in pieces.digest(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    encoded = pieces.encode(docs)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    for r in encoded.collect():
        text = (texts[r.doc_id] or "").replace(pieces.MARK, " ")
        assert back[r.doc_id] == text
        g = rows[r.doc_id]
        assert g.round_trip and g.n_pieces == len(r.ids)
        assert g.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.digest(docs.limit(0)).count() == 0


def test_token_counts(docs):
    encoding = token_counts.tokens.byte_bpe(token_counts.tokenizer_path())
    want = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()}
    for block in (7, 1000, 1 << 16):
        got = token_counts.scan(token_counts.token_streams(docs, block=block)).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(want.items())
        assert all(r.ended for r in got)
    assert token_counts.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_token_files(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_counts, "SPAN", 3)
    random.seed(block)
    want = []
    for k in range(6):
        ids = random.choices([1, 2, 9], k=random.choice([0, 1, 30, 200]))
        np.array(ids, "<u2").tofile(tmp_path / f"{k}.bin")
        docs, own = [], []
        for x in ids:
            if x == 9:
                docs.append((len(own), True))
                own = []
            else:
                own.append(x)
        docs += [(len(own), False)] * bool(own)
        want += [(f"{k}.bin", i, n, e) for i, (n, e) in enumerate(docs)]
    got = token_counts.scan(token_counts.token_files(spark, f"file://{tmp_path}/*.bin", block=block), separator=9, dtype="<u4").collect()
    assert sorted((r.stream.split("/")[-1], r.ordinal, r.n_tokens, r.ended) for r in got) == sorted(want)


def check_packed(rows, docs, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {r.doc_id for r in docs}
    for d in docs:
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()), d.doc_id
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += packing.slack(at, window)
    return padding


def test_packing(docs):
    rows, texts = packing.pack(docs).collect(), docs.collect()
    padding = check_packed(rows, texts, 4096)
    assert padding <= 4096
    assert packing.pack(docs.limit(0)).count() == 0
    small = docs.filter("doc_id < 1010")
    check_packed(packing.pack(small, window=64).collect(), small.collect(), 64)


def test_fill_is_the_best_by_brute_force():
    from itertools import product

    random.seed(5)
    for _ in range(300):
        window = 32
        left = {random.randint(1, window): random.randint(1, 3) for _ in range(random.randint(1, 5))}
        order = sorted(left, reverse=True)
        got = packing.fill(left, order, order[0], window)
        assert all(n <= left[k] for k, n in got.items()) and got[order[0]] >= 1
        sums = [sum(k * n for k, n in zip(order, ns)) for ns in product(*(range(left[k] + 1) for k in order)) if ns[0]]
        best = min(packing.slack(s, window) for s in sums if s <= window)
        assert packing.slack(sum(k * n for k, n in got.items()), window) == best
    made = packing.plan({5: 1000, 7: 333, 32: 4, 31: 2}, 32)
    assert made.sequences * 32 - made.padding == 1000 * 5 + 333 * 7 + 4 * 32 + 2 * 31
    assert made.padding < 0.03 * 32 * made.sequences


def test_known_words_are_not_encoded_again():
    asked = []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    cache = tokens.WordCache(str.split, encode, limit=4)
    for _ in range(3):
        assert list(cache(["a b", None, "c a"])) == [b"ab", b"", b"ca"]
    assert sorted(asked) == ["a", "b", "c"]  # what is known already doesn't count against the limit
    assert list(cache(["d e f a"])) == [b"defa"] and len(cache.known) == 4


def test_letters_before_other_signs_keep_their_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    encode = tokens.word_bpe(packing.tokenizer_path())
    words = ["étéonwh", "étéonwh,%%%", "a" * 60, "a" * 60 + "." * 60, "###", "x1y", "oneinst***", "oneinst.", "ŉa", "ǅx"]
    for _ in range(2):
        for w, got in zip(words, encode(words), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(w, add_special_tokens=False).ids, w
    assert not any(len(w) > tokens.LONGEST for w in encode.known)
