"""The registered queries over whole tables, against SQL or plain Python."""

import sys
from collections import Counter

import __spark_entry__ as e
import corpus_pipeline
import pytest
from compare import connect, differences
from test_llm_edges import DOCS, ODD, check_pieces, crc, library_ids, near

from foldcast.llm import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


def test_all_thirteen_and_the_pipeline_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in e.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, folder):
    assert differences(spark, folder, QUERIES[name], SQL[name], connect(folder)) is None


def documents(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_token_files_query(spark, folder):
    got = sorted(map(tuple, QUERIES["op4_token_files"](spark, folder).collect()))
    want, at = [], 0
    for d, t in sorted(documents(spark, folder)):
        ids = library_ids(t, 2)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_packing_query(spark, folder):
    from foldcast.llm import packing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    check_pieces(pieces, documents(spark, folder), 2048, 1)
    got = Counter(map(tuple, QUERIES["op10_best_fit_packing"](spark, folder).collect()))
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    import zlib

    assert got == Counter(tuple(zlib.crc32(r[n]) if n == "ids" else r[n] for n in names) for r in pieces)


def test_near_query(spark, folder):
    got = Counter(map(tuple, QUERIES["op9_bbit_minhash"](spark, folder).collect()))
    assert got == near(documents(spark, folder), 3, 85)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == columns, name
        have = {r.doc_id: r.text for r in before.collect()}
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.items() <= have.items()
        if name == "exact dedup":
            assert sorted(kept) == sorted({" ".join(t.split()): d for d, t in sorted(have.items(), reverse=True)}.values())
        if name == "near dedup":
            assert sorted(kept) == sorted(d for (d, _, c, _) in near(list(have.items()), 5, 80) if d == c)
        if name == "mixing sources":
            assert kept == have
        before = after
    pieces = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()]
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_sequences_follow_the_mixing_schedule(spark):
    from foldcast.llm import mixing
    from foldcast.llm.common import staged

    text = "concat_ws(' ', transform(sequence(1, {}), x -> concat('w', (id * 31 + x) % 997)))"
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", f"CASE WHEN id < 3000 THEN {text.format(150)} WHEN id < 3900 THEN {text.format(300)} ELSE {text.format(6000)} END AS text",
        "'en' AS lang", "CASE WHEN id < 3000 THEN 'a' WHEN id < 3900 THEN 'b' ELSE 'c' END AS source", "0 AS n_chars",
    )
    slots = {r.doc_id: (r.source, r.slot) for r in mixing.interleave(docs).collect()}
    last = min(max(s for o, s in slots.values() if o == source) for source in "abc")  # until then no source is used up
    pieces = [r.asDict() for r in corpus_pipeline.pack(spark, staged(corpus_pipeline.mix(spark, docs, ""), "mixed"), "").collect()]
    tokens, seen, total = Counter(), Counter(), 0
    for r in pieces:
        tokens[slots[r["doc_id"]][0]] += r["length"] * (slots[r["doc_id"]][1] <= last)
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        seen[slots[r["doc_id"]][0]] += r["length"]
        total += r["length"]
        if total < 0.9 * sum(tokens.values()):
            assert all(abs(seen[s] - total * share[s]) < 0.5 * corpus_pipeline.RUN_TOKENS for s in share)


def test_pipeline_keeps_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id AS slot", "doc_id AS c0")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.where("slot <> doc_id OR c0 <> doc_id").isEmpty(), name


def test_pipeline_runs(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_of_odd_and_of_no_documents_without_labels(spark, tmp_path):
    for name, docs, want in (("odd", [*ODD, *ODD], {1, 2, 4, None, 7, 8, 9}), ("none", [], set())):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, None), (None, 1, 0)][: len(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        starts = Counter(r.doc_id for r in pieces if r.start == 0)  # a corpus loaded twice is there once
        assert set(starts) == want and set(starts.values()) <= {1}


def test_entry_imports_without_the_subpackage(tmp_path):
    import subprocess

    code = "import sys; sys.modules['foldcast.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert not any(n.startswith('op1_') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rpartition("/")[0])
