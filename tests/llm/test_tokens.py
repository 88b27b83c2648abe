import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cases import SF, documents, edge_docs, edge_rows
from dealerlens.llm import packing, token_files, token_orc
from dealerlens.llm import tokens as op
from dealerlens.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text, end, special_as_text=False):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = special_as_text
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_word_by_word_equals_whole_texts(monkeypatch):
    odd = ["", "a", "İstanbul KELİME İ", "T̈a é", "été, ouè.  nbsp x", "<|endoftext|> hi <|ENDOFTEXT|>", "it's don't ... a.b,c. x...",
           "1,000.50 $5 ###. ouier### é. ×. ÷, »,", "日本語。テスト, ok", "ﬁ ǅ ẞ ß ſ K Å", "a\x1cb \x85c\x0bd", "word.\n", "</w> a</w>", "ΑΣ ΟΔΟΣ.", "a_b _ _x, -- (y)"]
    texts = odd + documents().text.tolist()[:60]
    for limit in (op.MAX_WORDS, 10):
        monkeypatch.setattr(op, "MAX_WORDS", limit)
        tok = op.WordTokenizer(PATH)
        assert tok.encode(texts) == [tok.whole(t) for t in texts]


def test_new_letters_are_merged_without_normalising_and_kept_words_stay(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzßàéîñöøüÿ", k=rng.randint(1, 14))) for _ in range(4000)]
    odd = ["œuvre", "ÉTÉ", "Straße", "ªº", "µm", "÷", "ÿ÷ÿ", "ǆ", "ﬁn", "ΟΔΟΣ.", "it's", "'s", "été!!", "été''", "a1", "l'été,", "_", "ß_"]
    text = " ".join(rng.choice(words) + rng.choice(["", "", ".", "!?", "'s"]) for _ in range(5000)) + " " + " ".join(odd)
    tok, by_whole = op.WordTokenizer(PATH), []
    batch = tok._batch
    tok._batch = lambda texts, *other: by_whole.extend([] if other and other[0] is tok.merges else texts) or batch(texts, *other)
    assert tok.encode([text]) == [tok.whole(text)]
    assert not {w for t in by_whole for w in t.split()} & {w for w in words if len(w) > 1 and w.isascii()}
    monkeypatch.setattr(op, "MAX_WORDS", 100)
    learned, learn = [], tok._learn
    tok._learn = lambda new: learned.extend(new) or learn(new)
    again = f"{text} unheardofword"
    assert tok.encode([again]) == [tok.whole(again)] and learned == ["unheardofword"] and len(tok.known) < len(text.split()) + 2


def test_random_texts_equal_the_library():
    rng = random.Random(17)
    blocks = [(0x20, 0x7f), (0xa0, 0x24f), (0x250, 0x3ff), (0x400, 0x52f), (0x590, 0x5ff), (0x900, 0x97f), (0xe00, 0xe7f), (0x1e00, 0x1fff),
              (0x2000, 0x218f), (0x3040, 0x30ff), (0x4e00, 0x4e80), (0xac00, 0xac80), (0xf900, 0xfaff), (0xfb00, 0xfb4f), (0xff00, 0xffef),
              (0x1d400, 0x1d4ff), (0x1f600, 0x1f64f)]

    def char():
        r = rng.random()
        if r < .3:
            return rng.choice(" \t\n.,;:!?'\"-_/()#&<|>$%1234567890")
        if r < .6:
            return rng.choice("İIıiŞşĞğÇçÖöÜüsſßﬁΣςabcdefghijklmnopqrstuvwxyzABC")
        return chr(rng.randrange(*rng.choice(blocks)))

    texts = ["TÜRKİYE'Nİ, BELEDİYESİ. EVİ!", "VALİLİĞİ. ŞEHRİ, ESKİ; yeni."] + [f"İ{m} xİ{m}y İ{m}{m}" for m in map(chr, range(33, 127)) if not m.isalnum()]
    texts += ["".join(char() for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    tok = op.WordTokenizer(PATH)
    wrong = [t for t, ids in zip(texts, tok.encode(texts), strict=True) if ids != tok.whole(t)]
    assert wrong == []


def test_first_fit_decreasing_and_gaps():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 300).tolist() + [51] * 80
    bins = packing.first_fit_decreasing(lengths, 100)
    assert sorted(k for b in bins for k in b) == list(range(380)) and all(sum(lengths[k] for k in b) <= 100 for b in bins)
    cut = packing.fill_gaps([[(k, 0, lengths[k]) for k in b] for b in bins], 100, 2)
    parts = {}
    for b in cut:
        assert 0 < sum(p[2] for p in b) <= 100
        for k, start, n in b:
            parts.setdefault(k, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[k]):
            assert start == at and size > 0
            at += size
        assert at == n
    assert len(cut) <= sum(lengths) / 98 + 1


def check_pieces(got, rows):
    want = sorted((len(x := plain_ids(t, 2)), zlib.crc32(x.tobytes()), i) for i, t in rows if i is not None)
    assert (got.groupby("sequence_id").length.sum() <= 4096).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    docs = dict.fromkeys(i for i, _ in rows)
    for i in (i for i in docs if i is not None):
        g = got[got.doc_id == i].sort_values("start")
        n = sum(1 for r in rows if r[0] == i)
        ids = plain_ids(next(t for j, t in rows if j == i), 2)
        assert g.length.sum() == n * len(ids) and (g.doc_tokens == len(ids)).all()
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert len(want) == sum(1 for i, _ in rows if i is not None)


def test_packing_edge_cases(spark):
    rows = edge_rows()
    got = packing.packed_pieces(edge_docs(spark, rows)).toPandas()
    check_pieces(got, rows)
    assert got[got.doc_id.isna()].length.sum() == len(plain_ids(rows[8][1], 2))
    assert packing.packed_pieces(edge_docs(spark, [])).collect() == []


def test_packing_query(spark):
    d = documents()
    got = packing.op7_packing(spark, SF).toPandas()
    check_pieces(got, list(zip(d.doc_id.tolist(), d.text, strict=True)))
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.97


def test_awkward_copies_leave_no_padding(spark):
    text = " ".join(["house"] * 2500)
    got = packing.packed_pieces(edge_docs(spark, [(k, text) for k in range(40)])).toPandas()
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.95


@pytest.mark.parametrize("block", [2, 14, 1 << 20])
def test_token_files_scan(spark, block):
    rows = edge_rows() if block > 2 else [(1, "a house and a home"), (2, None), (3, "house")]
    folder = scratch_path(spark, "test_tokens")
    names = token_files.write_token_files(edge_docs(spark, rows).repartition(3, "doc_id"), folder, PATH)
    got = names.join(token_files.count_tokens(spark, folder, block_bytes=block), ["file", "ordinal"])
    want = sorted(((i, len(plain_ids(t, 0, True)) - 1) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == want


def test_unclosed_last_document_and_empty_folder(spark, tmp_path):
    np.array([7, 8, token_files.END_ID, token_files.END_ID, 9], dtype="<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (2, 4, 1 << 20):
        got = sorted((r.ordinal, r.start, r.n_tokens) for r in token_files.count_tokens(spark, str(tmp_path), block_bytes=block).collect())
        assert got == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
    empty = token_files.write_token_files(edge_docs(spark, []), scratch_path(spark, "test_tokens"), PATH)
    assert empty.collect() == []


def test_token_count_query(spark):
    d = documents()
    got = {r.doc_id: r.n_tokens for r in token_files.op8_token_counts(spark, SF).collect()}
    assert got == {i: len(plain_ids(t, 0, True)) - 1 for i, t in zip(d.doc_id.tolist(), d.text, strict=True)}


def offsets(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(plain_ids(r[1], 2)))):
        ids = plain_ids(t, 2)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_orc_round_trip(spark):
    path = scratch_path(spark, "test_orc")
    token_orc.write_token_orc(edge_docs(spark), path, PATH)
    got = token_orc.document_offsets(token_orc.read_token_orc(spark, path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(offsets(edge_rows()), key=repr)
    one = token_orc.read_token_orc(spark, path, [7])
    assert [r.ids for r in one.collect()] == [plain_ids(edge_rows()[7][1], 2).tolist()]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    path = scratch_path(spark, "test_orc")
    token_orc.write_token_orc(edge_docs(spark, []), path, PATH)
    assert token_orc.document_offsets(token_orc.read_token_orc(spark, path)).collect() == []


def test_orc_query(spark):
    d = documents()
    got = sorted(map(tuple, token_orc.op9_token_orc(spark, SF).collect()))
    assert got == offsets(list(zip(d.doc_id.tolist(), d.text, strict=True)))


def test_full_blocks_stay_out_of_the_groups(spark, monkeypatch):
    sizes, whole = [], packing.first_fit_decreasing
    rows = [{"row": k, "id": k, "start": s, "length": n, "doc_tokens": 4096 * 50 + 10, "ids": b"\1\0\0\0" * n, "slot": slot}
            for k in range(3) for s, n, slot in [*((4096 * j, 4096, -1 - j) for j in range(50)), (4096 * 50, 10, 0)]]
    rows.sort(key=lambda r: (r["slot"], r["row"]))
    monkeypatch.setattr(packing, "first_fit_decreasing", lambda lengths, capacity: sizes.append(len(lengths)) or whole(lengths, capacity))
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 5})())}))
    out = pa.Table.from_batches(packing._pack(4096, 32, 1)(pa.Table.from_pylist(rows).to_batches(max_chunksize=40)))
    monkeypatch.undo()
    assert sizes == [3] and out.num_rows == 153 and len(set(out["sequence_id"].to_pylist())) == 151
    got = packing.packed_pieces(edge_docs(spark, [(k, "word " * 30_000) for k in range(6)])).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    whole_blocks = got[got.length == 4096]
    assert len(whole_blocks) >= 6 and not whole_blocks.sequence_id.duplicated().any()
    assert (got.groupby("sequence_id").length.sum() <= 4096).all()
