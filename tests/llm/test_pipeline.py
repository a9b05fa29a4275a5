"""The pipeline's stages on a small corpus: what each does to its own input, and that all rows are accounted for."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from messy_tables import with_clashes

import corpus_pipeline as P
from corvane.llm import mixing, packing, tokens


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    root = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []

    def text(n):
        return [f"{rng.choice('bdgkt')}{rng.choice('aeiou')}{rng.choice('lnrs')}{rng.choice('aeiou')}{rng.choice('bdgkt')}" for _ in range(n)]

    passage = text(60)
    for i in range(400):
        words = text(rng.randrange(30, 120))
        if i % 40 == 1:
            words = words[:10] + passage + words[10:]
        junk = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words), "en", "hot" if i % 3 else f"s{i % 4}", None))
        if i % 4:
            labels.append((i, int(not junk), 0))
    copies = [r for r in rows if r[0] % 5 and r[0] % 40 != 1][:20]
    rows += [(1000 + k, r[1], *r[2:]) for k, r in enumerate(copies)]
    rows += [(2000 + k, r[1] + " end", *r[2:]) for k, r in enumerate(copies)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows, {r[0] for r in copies}, " ".join(passage)


def test_stages(spark, corpus, tmp_path):
    root, rows, copied, passage = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, root)
        if name != P.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]
    by = {k: {r[0]: r for r in v} for k, v in seen.items() if k != "best_fit_packing"}

    clean = {r[0]: r for r in rows if "!!" not in r[1]}
    assert set(by["quality_classifier"]) == set(clean) and all(clean[i] == r for i, r in by["quality_classifier"].items())

    once = by["simhash_near_dedup"]
    assert len(seen["simhash_near_dedup"]) == len(once) and {i for i in clean if i < 1000} == set(once)
    assert all(clean[i] == r for i, r in once.items())

    holders = sorted(i for i in once if passage in once[i][1])
    after = by["substring_dedup"]
    assert set(after) == set(once) and len(holders) > 3
    assert passage in after[holders[0]][1] and not any(passage in after[i][1] for i in holders[1:])
    assert all(after[i][1] == once[i][1].replace(passage + " ", "") for i in holders[1:]) and all(after[i] == once[i] for i in once if i not in holders)
    assert all(after[i][4] == len(after[i][1]) for i in holders[1:])

    mixed = by["source_mixing"]
    assert mixed == after
    order = [r["doc_id"] for r in mixing.mix(spark.createDataFrame(seen["substring_dedup"], docs_schema()), P.MIX_PARTS).orderBy("position").collect()]
    files = [r[0] for part in sorted(p.name for p in (tmp_path / "source_mixing").iterdir() if p.suffix == ".parquet") for r in spark.read.parquet(f"{tmp_path}/source_mixing/{part}").collect()]
    assert files == order

    pieces = defaultdict(int)
    for doc, _, _, length, *_ in seen["best_fit_packing"]:
        pieces[doc] += length
    texts = list(mixed.values())
    assert pieces == {r[0]: len(ids) for r, ids in zip(texts, tokens.encode(tokens.default_tokenizer(), [r[1] for r in texts]), strict=True)}


def test_packing_keeps_to_the_mixed_order(spark, tmp_path, monkeypatch):
    """Sequences in the order of their ids hold one stretch of the written order after another."""
    monkeypatch.setattr(packing.pack_in_order, "__defaults__", (20,))
    rows = [(i, f"text {i} " * (1 + i % 9), "en", f"src{i % 3}", 9) for i in range(150)] + [(150, "long " * 3000, "en", "src0", 15000), (151, None, "en", None, None)]
    P.mix_sources(spark, spark.createDataFrame(rows, docs_schema()).repartition(3), "").write.parquet(f"{tmp_path}/mixed")
    order = {r["doc_id"]: r["position"] for r in mixing.mix(spark.createDataFrame(rows, docs_schema()), P.MIX_PARTS).collect()}
    out = P.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert {r["doc_id"] for r in out} == set(order)
    stretches = [order[r["doc_id"]] // 20 for r in sorted(out, key=lambda r: r["sequence_id"])]
    assert stretches == sorted(stretches) and len(set(stretches)) == 8
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(at == sum(n for _, n in sorted(x)[:k]) and at + n <= 1024 for x in used.values() for k, (at, n) in enumerate(sorted(x)))


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_run_equals_the_stages(spark, corpus):
    out = P.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used = defaultdict(int)
    for r in out.collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= P.SEQUENCE_TOKENS


@pytest.mark.parametrize("table", ["messy", "nothing"])
def test_every_stage_takes_every_table(spark, request, table, tmp_path):
    docs = with_clashes(request.getfixturevalue(table))
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == P.STAGES[-1][0] or out.columns == docs.columns
        n = out.count()
        assert n == 0 if table == "nothing" else n > 0


def test_cut_keeps_to_the_sequence():
    assert packing.cut(2500, P.SEQUENCE_TOKENS) == [(0, 452), (452, 1024), (1476, 1024)]
