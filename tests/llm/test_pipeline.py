import re

import corpus_pipeline
import pytest
from llm.helpers import SCHEMA, awkward

import __spark_entry__ as entry
from pairloom.llm import queries
from pairloom.llm.packing import document_pieces
from pairloom.llm.secret_scan import find_spans
from pairloom.llm.token_rollups import _encoding
from pairloom.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages_chain_over_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
        kept.append(docs)
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    assert not any(find_spans(r.text or "")[0] for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    want = document_pieces(docs, path)
    assert sorted(packed.select(*want.columns).collect()) == sorted(want.collect())
    assert corpus_pipeline.run(spark, SF).select(*want.columns).exceptAll(want).count() == 0


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    full = [(i, t, None, None, None) for i, t in awkward()]
    for name, rows in (("awkward", full), ("empty", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= 0


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op2_token_counts"}))
def test_queries_give_a_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == 200 and (name.startswith("op6") or got.count() == 200)


def test_totals_are_those_of_the_documents_left(spark):
    rows = queries.QUERIES["op2_token_counts"](spark, SF).where("tokenizer_version = 'words'").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    poor, toxic = {r.doc_id for r in labels if r.quality == 0}, {r.doc_id for r in labels if r.toxic == 1}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id not in poor]
    assert any(r.doc_id in toxic for r in docs)
    want = {}
    for r in docs:
        n, k = want.get((r.source, r.lang), (0, 0))
        text = (r.text.lower() if r.doc_id in toxic else r.text).encode()
        want[r.source, r.lang] = n + 1, k + len(text.split())
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rows} == want


def test_toxic_documents_are_revised_to_lower_case(spark, tmp_path):
    """Counts of both versions, on texts of which none has a licence line."""
    path = __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")
    encode = _encoding(path, __import__("public_tokenizers").PATTERN).encode_ordinary
    texts = {1: "WHAT A TERRIBLE Thing", 2: "WHAT A TERRIBLE Thing", 3: "GONE And REVISED", 4: None, 5: "Plain text"}
    toxic, poor = {1, 3, 4}, {3}
    spark.createDataFrame([(i, t, "en", f"s{i}", None) for i, t in texts.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), int(i not in poor)) for i in texts], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.source, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()}
    want = {}
    for i in texts.keys() - poor:
        text = (texts[i] or "").lower() if i in toxic else texts[i] or ""
        want[f"s{i}", "byte_bpe_50k"] = 1, len(encode(text))
        want[f"s{i}", "words"] = 1, len(text.split())
    assert got == want and got["s1", "byte_bpe_50k"] != got["s2", "byte_bpe_50k"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = queries.QUERIES[name](spark, SF)
    columns = sorted(result.columns)
    rows = [frame[columns].sort_values(columns).astype(object).values.tolist() for frame in (result.toPandas(), con.execute(queries.ORACLES[name]).df())]
    assert rows[0] and [[str(v) for v in r] for r in rows[0]] == [[str(v) for v in r] for r in rows[1]]
