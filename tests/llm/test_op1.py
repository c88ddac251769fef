import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import op1_best_fit_packing as op1

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
TOK.encode_special_tokens = True
ENC = op1.Encoder(PATH)


def ids(text):
    return np.array(TOK.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZ9.,!é \n\t\r  \x85​中🙂<|>\\_-")), max_size=40))
def test_fast_ids_are_the_tokenizers(text):
    assert ENC.encode(text).tobytes() == ids(text)


def test_fast_ids_are_the_tokenizers_on_documents():
    import pyarrow.parquet as pq
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ENC.encode(text).tobytes() == ids(text)
    assert ENC.encode("a" * 3000).tobytes() == ids("a" * 3000)
    special = "a <|endoftext|> b  c \n\n d\n e \n f"
    assert ENC.encode(special).tobytes() == ids(special)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins_are_full_and_complete(lengths):
    counts = np.bincount(lengths, minlength=31).astype(np.int64)
    plan = op1.plan_bins(counts, 30)
    back = np.zeros(31, dtype=np.int64)
    for combo, bins in plan:
        assert sum(combo) <= 30 and bins > 0
        for x in combo:
            back[x] += bins
    assert (back == counts).all()
    assert sum(b for _, b in plan) <= 1.2 * -(-sum(lengths) // 30) + 1 or min(lengths) > 10


def test_every_token_has_its_place(spark):
    rows = [(i, "word " * (i % 37)) for i in range(900)] + [(None, None), (5000, ""), (5001, "long " * 5000), (5002, "x"), (5002, "x")]
    docs = spark.createDataFrame([(d, t, 1, 2, "z") for d, t in rows], "doc_id long, text string, piece int, rank int, grp string").repartition(4)
    out = op1.best_fit_packing(docs, PATH).toPandas()
    have, want = defaultdict(int), defaultdict(int)
    for d, t in rows:
        want[d] += len(ids(t or "")) // 4 + 1
    for r in out.itertuples():
        have[None if pd.isna(r.doc_id) else int(r.doc_id)] += r.length
    assert have == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() == -(-int(out.length.sum()) // 1024)
    raw = ids("long " * 5000) + np.array([2], "<u4").tobytes()
    for r in out[out.doc_id == 5001].itertuples():
        assert zlib.crc32(raw[4 * r.start: 4 * (r.start + r.length)]) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
    assert op1.best_fit_packing(docs.limit(0), PATH).count() == 0
