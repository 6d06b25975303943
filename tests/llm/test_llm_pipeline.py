"""The pipeline against a plain restatement of its stages on small tables."""

import collections
import hashlib
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(corpus_spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = [], []
    for d in range(120):
        words = [f"{chr(97 + (d * 7 + i * i) % 26)}{chr(97 + (d + i * 3) % 26)}{(d * 31 + i) % 97}q" for i in range(60)]
        if d % 6 == 0:
            words[5] = "idiot"
        rows.append((d, " ".join(words), "en", f"s{d % 4}", 0))
        labels.append((d, 1, int(d % 6 == 0)))
    rows += [(200 + k, rows[1][1] + f" tail{k}", "en", "s0", 0) for k in range(5)]        # near copies of 1
    rows += [(300, "write to jane.roe@mail.example.com " + rows[2][1][:150], "de", None, 0), (301, None, None, None, None), (302, "", "en", "s1", 0)]
    corpus_spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    corpus_spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages_in_order(corpus_spark, tables):
    import corpus_pipeline
    docs = corpus_spark.read.parquet(f"{tables}/documents.parquet")
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(corpus_spark, docs, tables)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == COLUMNS
        out.write.parquet(f"{tables}/{k}-{name}")
        docs = corpus_spark.read.parquet(f"{tables}/{k}-{name}")
        outs.append(docs.collect())
    clean, single, safe, mixed, coded = outs
    assert {r.doc_id for r in clean} == {d for d in range(120) if d % 6} | set(range(200, 205)) | {300, 301, 302}
    assert {r.doc_id for r in single} == {r.doc_id for r in clean} - set(range(200, 205))
    assert {r.doc_id for r in safe} == {r.doc_id for r in single} and not any("jane.roe" in (r.text or "") for r in safe)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in safe}
    taken = collections.Counter()
    for r in mixed:
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[d] <= 2 * size[d] for d in taken) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 400
    import public_tokenizers as P
    import tiktoken
    from skyledger.llm.bpe import parse_ranks
    from skyledger.llm.catalog import vocabulary
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(open(vocabulary()[0], "rb").read()), special_tokens={})
    want = sorted((r.doc_id, tuple(other.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in coded) == want


def test_run_is_registered(corpus_spark, tables):
    import __spark_entry__
    import corpus_pipeline
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    rows = corpus_pipeline.run(corpus_spark, tables)
    assert rows.count() > 100
