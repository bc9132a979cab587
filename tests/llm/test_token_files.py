import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import token_files as M
from siftline.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_gives_the_tokenizers_ids(tokenizer, texts):
    rng = random.Random(2)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", ".", "'", "s", "1", "_", "ā", "-", "!", "\xa0", "日", "\x1c", "<|endoftext|>", "Ⅷ", "²", "🙂"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    every = [t or "" for t in texts] + odd + ["it's don't 'll", "tail.\n", " \n a", "x\n\n\ny"]
    encoder = M.Encoder(PATH, cache=500)  # also across a cache that starts anew
    got = [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(every)]
    assert got == [e.ids for e in tokenizer.encode_batch(every, add_special_tokens=False)]


def expected(rows, tokenizer):
    out, start = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_odd_documents(spark, odd_docs, tokenizer, tmp_path):
    files = M.write_token_files(odd_docs, PATH, folder=f"file://{tmp_path}", seq_len=16, rows_per_batch=4)
    got = [tuple(r) for r in M.read_token_files(spark, files).collect()]
    assert len(got) == odd_docs.count()
    assert [g[1] for g in sorted(got, key=lambda g: g[1])] == list(np.cumsum([0] + [g[2] for g in sorted(got, key=lambda g: g[1])])[:-1])
    order = sorted(got, key=lambda g: g[1])
    ids = [g[0] for g in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    single = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    want = {(i, n, c) for i, _, n, c in expected(single.items(), tokenizer)}
    assert {(g[0], g[2], g[3]) for g in got if g[0] is not None} == want


def test_format_is_fixed_size_lists_with_masks_and_zero_copy(spark, odd_docs, tmp_path):
    files = M.write_token_files(odd_docs, PATH, folder=f"file://{tmp_path}", seq_len=16, rows_per_batch=4)
    for part in files.parts:
        reader = M.SequenceReader(files.folder, part.name)
        schema = reader.file.schema
        assert schema.field("ids").type == pa.list_(pa.uint16(), 16) and schema.field("mask").type == pa.list_(pa.bool_(), 16)
        n, real = 0, 0
        for k in range(reader.file.num_record_batches):
            batch = reader.file.get_batch(k)
            assert batch.num_rows == 4 or k == reader.file.num_record_batches - 1
            n += batch.num_rows
            real += batch.column("mask").flatten().to_numpy(zero_copy_only=False).sum()
        assert real == part.n_ids and n == -(-part.n_ids // 16)
        whole = reader.ids(0, part.n_ids)
        ids, mask = reader.sequence(n - 1)
        assert (ids[mask] == whole[(n - 1) * 16 :]).all() and not ids[~mask].any()
        assert reader._flat(0).base is not None  # a view of the mapped file


def test_empty_table(spark, no_docs, tmp_path):
    files = M.write_token_files(no_docs, PATH, folder=f"file://{tmp_path}")
    assert files.parts == [] and M.read_token_files(spark, files).count() == 0
