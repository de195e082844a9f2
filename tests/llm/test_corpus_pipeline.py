import re
import zlib

import corpus_pipeline
from leadlens.llm import mixing, queries, simhash, toxicity
from tests.llm.conftest import prose
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import whole
from tests.llm.test_toxicity import corpus


def write(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, labels = corpus(240)
    rows = [(d, t, lang, f"s{d % 3}", len(t), "x") for d, t, lang, _, _ in rows]
    base = prose(999, 400, 3000)
    rows += [(1000, base, "en", "s0", 1, "x"), (1001, base + "  ", "en", "s1", 1, "x"), (1002, base.replace(" ", "\n", 1), "en", "s2", 1, None)]
    rows += [(1010, base + " tail", "en", "s0", 1, "x"), (1011, None, None, None, None, None), (1012, "", "en", "s1", 0, "x"), (1013, prose(5, 9000, 3000), "en", "s2", 1, "x")]
    rows += [rows[0], (None, prose(6, 80, 3000), None, None, None, None)]
    write(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        out[name] = docs.collect()
    score = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).score
    clean = [r for r in rows if score(r[1]) < toxicity.ACCEPT]
    assert sorted(map(str, map(tuple, out["toxicity"]))) == sorted(map(str, clean))
    groups = {}
    for r in clean:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1] or ""), []).append(r)
    first = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(map(str, map(tuple, out["exact_dedup"]))) == sorted(map(str, first))
    roots = {}
    for r, root in zip(first, slow_components([slow_fingerprint(r[1]) for r in first]), strict=True):
        roots.setdefault(root, []).append(r)
    near = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in roots.values()]
    assert sorted(map(str, map(tuple, out["simhash_near_dedup"]))) == sorted(map(str, near))
    copies = mixing.mix_copies(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).collect()
    assert len(out["mixing"]) == sum(r.copies for r in copies)
    pieces = out["best_fit_packing"]
    want = sorted(
        (str(r.doc_id), k, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
        for r in out["mixing"]
        for ids in [whole(queries.WORD_VOCABULARY, r.text or "") + [0]]
        for k, part in enumerate([ids[a : a + 2048] for a in range(0, len(ids), 2048)])
    )
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in pieces) == want


def test_run_on_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_constants():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and simhash.RADIUS == 2
