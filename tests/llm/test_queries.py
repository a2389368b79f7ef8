"""The registered queries and the pipeline over whole small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_license_scan", "op8_source_mix", "op9_exact_topk", "op11_lm_score"])
def test_oracle(spark, entry, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = entry.queries()[name](spark, SF001).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name,columns", [
    ("op2_jaccard_join", "doc_id n_shingles component_id"), ("op3_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"),
    ("op4_language_id", "doc_id held_out lang_pred score"), ("op5_toxicity", "doc_id held_out score predicted"),
    ("op7_html_extract", "page_id url text n_chars"), ("op10_suffix_dedup", "doc_id n_bytes n_removed n_spans kept_sha256")])
def test_shape(spark, entry, name, columns):
    got = entry.queries()[name](spark, SF001)
    assert got.columns == columns.split()
    table = "pages" if name.startswith("op7") else "documents"
    assert got.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()


def test_near_and_repeated_equal_brute_force(spark, entry):
    from .helpers import component_ids, key, without_repeats

    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = [tuple(r) for r in entry.queries()["op2_jaccard_join"](spark, SF001).collect()]
    assert sorted(got) == sorted(component_ids(rows, 3, 90))
    got = [tuple(r) for r in entry.queries()["op10_suffix_dedup"](spark, SF001).collect()]
    assert sorted(got, key=key) == sorted(without_repeats(rows), key=key)


def test_pipeline(spark):
    import corpus_pipeline as P
    from pricelab.llm import mixing

    from .helpers import component_ids, docs_frame, normalised, odd_docs

    rows = [r for r in odd_docs() if r[0] != 16] + [(100 + k, f"der die das und nicht ein {k % 9} eine sind", "de", f"s{k % 3}") for k in range(60)]
    docs = docs_frame(spark, rows).drop("token_ids", "n_tokens")
    stage = dict(P.STAGES)
    assert list(stage) == ["language", "exact_dedup", "near_dedup", "mixture", "tokens"]
    kept = stage["language"](spark, docs, SF001)
    assert kept.columns == docs.columns and {5, 6, 7, 17}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert {100 + k for k in range(60)} <= {r["doc_id"] for r in kept.collect()}
    ids = [r for r in rows if r[0] is not None and r[0] != 20]
    docs = docs.where("doc_id is not null and doc_id <> 20")
    once = stage["exact_dedup"](spark, docs, SF001)
    first = {}
    for i, t, *_ in ids:
        first.setdefault(normalised(t), i)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted(first.values())
    near = stage["near_dedup"](spark, docs, SF001)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, _, c in component_ids(ids, 5, 80) if i == c)
    mix = stage["mixture"](spark, docs, SF001)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert sorted(r["doc_id"] for r in mix.collect()) == sorted(i for i, n in plan.items() for _ in range(n))
    out = stage["tokens"](spark, docs, SF001)
    assert out.columns == docs.columns + ["token_ids", "n_tokens"] and all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in out.collect())
    for name, f in P.STAGES:
        assert f(spark, docs.limit(0), SF001).count() == 0


def test_whole_pipeline(spark):
    import corpus_pipeline as P

    out = P.run(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 0
