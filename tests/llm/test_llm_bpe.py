"""Byte-level BPE: how often pieces are encoded, and in how many Python workers."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def parts():
    from skyledger.llm.bpe import parse_ranks
    from skyledger.llm.catalog import vocabulary
    path, pattern = vocabulary()
    return parse_ranks(open(path, "rb").read()), pattern


def test_frequent_pieces_outlive_a_full_table(parts, monkeypatch):
    from skyledger.llm import bpe
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    own, seen, inner = bpe.ByteBPE(*parts), [], bpe.ByteBPE.encode_piece
    monkeypatch.setattr(bpe.ByteBPE, "encode_piece", lambda self, piece: seen.append(piece) or inner(self, piece))
    text = " ".join(f"qzxfrequent qzx{chr(97 + k // 26)}{chr(97 + k % 26)}rare" for k in range(200))
    assert own.decode(own.encode(text).tolist()) == text.encode()
    assert sum(b"frequent" in p for p in seen) <= 2 and len(own.pieces) + len(own.pieces.older) <= 20


def test_small_memo_of_pairs_changes_no_ids(parts, monkeypatch):
    import tiktoken
    from skyledger.llm import bpe
    monkeypatch.setattr(bpe, "PAIR_ENTRIES", 3)
    own, other = bpe.ByteBPE(*parts), tiktoken.Encoding("own", pat_str=parts[1], mergeable_ranks=parts[0], special_tokens={})
    rng = np.random.default_rng(4)
    for n in rng.integers(0, 40, 300):
        text = "".join(rng.choice(list("abcdeéçnrst 'ing"), n))
        assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_encoding_and_decoding_share_a_python_worker(corpus_spark, tmp_path):
    import corpus_pipeline
    from skyledger.llm import bpe
    from skyledger.llm.catalog import vocabulary
    docs = corpus_spark.createDataFrame([(1, "a text", "en", "s", 6), (2, None, "en", None, None)],
                                        "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    coded = corpus_pipeline.encode_tokens(corpus_spark, corpus_spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert coded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.doc_id, r.n_tokens, len(r.ids)) for r in coded.orderBy("doc_id").collect()][1] == (2, 0, 0)
    # ids that are there already
    given = corpus_spark.createDataFrame([(1, [72, 73]), (2, [])], "k int, ids array<int>")
    rows = bpe.decode(given, vocabulary()[0]).orderBy("k").collect()
    assert [list(r.ids) for r in rows] == [[72, 73], []] and [r.n_tokens for r in rows] == [2, 0] and bytes(rows[1].decoded) == b""
