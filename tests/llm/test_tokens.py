"""Operators 9 and 10: codes, files and codecs against the public libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import pieces, token_files

from ..conftest import SF01
from .conftest import nasty_rows

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

WORDS, MODEL = public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.randoms(use_true_random=False))
def test_dac_round_trip_and_random_access(values, rng):
    ids = np.array(values, np.uint32)
    dac = token_files.Dac(token_files.dac_encode(ids))
    assert len(dac) == len(ids) and (dac.slice(0, len(ids)) == ids).all()
    for _ in range(5):
        a, b = sorted((rng.randint(0, len(ids)), rng.randint(0, len(ids))))
        assert (dac.slice(a, b) == ids[a:b]).all()
        if len(ids):
            i = rng.randrange(len(ids))
            assert dac[i] == ids[i]


def test_widths_cost_least():
    ids = np.random.default_rng(1).integers(0, 49408, 5000).astype(np.uint32)
    best = len(token_files.dac_encode(ids))
    assert best <= 5000 * 16 // 8 + 200


def odd_texts():
    rng = random.Random(6)
    out = [t for _, t, *_ in nasty_rows()]
    out += ["I'm <|endoftext|>. H̱ he's x　 Å. İ <|ENDOFTEXT|>! 12.5% ... a.b.c. don't! ().", " \n",
            "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thethethe" * 30, "0123456789" * 30, "▁a ▁", "日本語🙂" * 40]
    out += ["".join(rng.choice("abcdeth  nio\nérs.,'") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    return out


def test_words_encode_as_whole_texts():
    whole = tokenizers.Tokenizer.from_file(WORDS)
    texts = odd_texts()
    ids, off = token_files.encode_block(pa.array(texts), WORDS)
    for i, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert ids[off[i]:off[i + 1]].tolist() == want


def test_token_files_nasty(spark, nasty, empty, tmp_path):
    token_files.write_token_files(nasty, f"{tmp_path}/a", WORDS)
    got = token_files.read_token_files(spark, f"{tmp_path}/a").orderBy("start").collect()
    whole = tokenizers.Tokenizer.from_file(WORDS)
    ids = {}
    for i, t, *_ in nasty_rows():
        code = whole.encode(t or "", add_special_tokens=False).ids + [1]
        ids.setdefault(i, []).append((len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in ids[r["id"]]
        start += r["n_tokens"]
    keys = [r["id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0)) and len(keys) == len(nasty_rows())
    token_files.write_token_files(empty, f"{tmp_path}/b", WORDS)
    assert token_files.read_token_files(spark, f"{tmp_path}/b").count() == 0


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = pieces.codec(MODEL)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(200).collect()]
    ids, off = c.encode(pa.array(texts))
    for i, t in enumerate(texts):
        mine = ids[off[i]:off[i + 1]]
        assert mine.tolist() == lib.encode(t or "")
        assert c.decode(mine) == (t or "").replace("▁", " ")
    for t in odd_texts()[-60:]:
        assert pieces.encode_text(c.v, t) == lib.encode(t)  # one uncut stream


def test_stream_holds_a_bounded_window():
    v = pieces.codec(MODEL).v
    stream, most = pieces.StreamingViterbi(v), 0
    for char in "abcthe" * 3000 + "é日本" * 500:
        stream.push(char)
        most = max(most, len(stream.state))
    assert most <= 4 * v.longest


def test_codec_nasty(spark, nasty, empty):
    coded = pieces.encode_documents(nasty, MODEL)
    got = coded.collect()
    assert len(got) == len(nasty_rows()) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = pieces.decode_documents(coded, MODEL).select("row.doc_id", "text").collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i), t or "") for i, t, *_ in nasty_rows())
    assert pieces.encode_documents(empty, MODEL).count() == 0


def test_other_tokenizers_get_the_librarys_ids(tmp_path):
    """Shortcuts are taken only where the tokenizer does the same."""
    import json

    import pyarrow as pa
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from tabscope.llm import token_files as T
    texts = ["Hello World. It's 3 o'clock!", "  two  blanks\n\tTABS ", "", None, "É ÉCOLE x.y?!", "Hello World.", "日本 3.14,"]
    plain = json.load(open(path("word_bpe_49k.json")))
    plain["normalizer"] = None
    (tmp_path / "plain.json").write_text(json.dumps(plain))
    for file, alone in ((path("word_bpe_49k.json"), True), (path("byte_bpe_50k.json"), False), (str(tmp_path / "plain.json"), None)):
        ids, off = T.encode_block(pa.array(texts), file)
        library = Tokenizer.from_file(file)
        want = [library.encode(t or "", add_special_tokens=False).ids + [T.END_ID] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
        assert alone is None or T._ENCODERS[file].alone == alone
    assert T._ENCODERS[path("word_bpe_49k.json")].cuts
    assert not T._ENCODERS[str(tmp_path / "plain.json")].folds
