import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pangrove.llm import tokens
from pangrove.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "\n\n  a  \t b",
    "don't we'll I'M it's 's ' s",
    "naïve café 12½ x² _under_score__ 3.14",
    "a<|endoftext|>b <|endoftext|>",
    "漢字 かな 한국어 עברית ​ \x1c x\x85y",
    "🙂🙂 é ẞ",
    "word " * 5000,
    "q" * 20000,
    "same",
    "same",
]
ROWS = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "null id", "clash", 7), (11, "same", "clash", 7)]
SCHEMA = "doc_id bigint, text string, n_tokens string, part int"


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_counts(spark):
    got = tokens.token_counts(spark.createDataFrame(ROWS, SCHEMA), PATH, 512).collect()
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 512) for r in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = shared_dir(spark, "t")
    manifest = tokens.write_token_files(docs, PATH, out, length=64)
    got = sorted(tokens.read_token_files(manifest, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    start, known = 0, {}
    for r in ROWS:
        packed = np.array(ids(r[1]) + [0], "<u4")
        known.setdefault(r[0], []).append((len(packed), zlib.crc32(packed.tobytes())))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in known[r.doc_id]
        start += r.n_tokens
    # Sequences have one length; masks hide only what follows a part's last id.
    for part in manifest.collect():
        reader = tokens.SequenceReader(f"{out}/{part.file}")
        n = -(-part.n_tokens // 64)
        masks = [reader.sequence(k)[1] for k in range(n)]
        assert all(m.all() for m in masks[:-1]) and sum(m.sum() for m in masks) == part.n_tokens
        assert all(len(reader.sequence(k)[0]) == 64 for k in range(n))


def test_no_text_is_encoded_whole(monkeypatch):
    """Every script and special strings go by pre-tokens, as the library counts them."""
    e = tokens.Encoder(PATH)
    monkeypatch.setattr(e, "whole", None)
    texts = [t or "" for t in TEXTS] + [
        "Привет, мир! Ещё раз.", "“quoted” — dash… don’t", "العربية ١٢٣ ४५६", "ไทย ภาษา", "a<|endoftext|>漢<|endoftext|>", "<|endoftext|><|endoftext|> x", "e\u0301 \u200d🙂\u200d", "\x00\x01 \x00", "ﬁ ½ ² Ⅷ ٣",
    ]
    assert e.count(texts) == [len(ids(t)) for t in texts]
    e.known.clear()  # counts and ids are remembered apart
    assert list(e.encode(texts, np.dtype("<u2"))) == [np.array(ids(t), "<u2").tobytes() for t in texts]


def test_rows_of_one_id_have_an_order(spark):
    rows = [(5, f"text {k} " * (k % 7)) for k in range(60)] + [(None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    read = lambda d: sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digest(d, PATH, 32).collect())
    assert read(docs.repartition(5)) == read(docs.repartition(2))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokens.token_counts(none, PATH).count() == 0
    assert tokens.token_digest(none, PATH).count() == 0


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    e = tokens.Encoder(PATH)
    texts = ["one two three four five six seven", "eight nine one", "ten two one three"]
    assert e.count(texts) == [len(ids(t)) for t in texts]
    e = tokens.Encoder(PATH)
    assert list(e.encode(texts, np.dtype("<u2"))) == [np.array(ids(t), "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = {r.doc_id: ids(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, PATH).collect()} == {k: len(v) for k, v in want.items()}
    got = {r.doc_id: r.ids_crc32 for r in tokens.token_digest(docs, PATH).collect()}
    assert got == {k: zlib.crc32(np.array(v + [0], "<u4").tobytes()) for k, v in want.items()}
