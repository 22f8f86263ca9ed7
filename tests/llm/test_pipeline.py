"""The pipeline's stages in a row, each against what it should do to a planted corpus."""

import random

import corpus_pipeline
from tests.llm.helpers import blanks_split, frame, prose
from tests.llm.test_minhash import brute
from tests.llm.test_quality import measures
from tests.llm.test_substrings import learn_contents, runs_elsewhere


def corpus():
    rnd = random.Random(6)
    texts = {i: " ".join(prose(rnd, rnd.randrange(80, 200))) for i in range(40)}
    passage = prose(rnd, 70)
    for i in (3, 9):
        texts[i] += " " + " ".join(passage) + " tail"
    texts[40] = texts[5]
    near = texts[6].split(" ")
    near[10] = "changed"
    texts[41] = " ".join(near)
    texts[42] = None
    texts[43] = "too short"
    texts[44] = "again and again we say it " * 30
    texts[7] += " password=hunter2hunter2"
    return texts


def test_stages(spark, tmp_path):
    texts = corpus()
    df = frame(spark, texts)
    docs = df
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        if len(seen) < 4:
            assert docs.columns == df.columns, name
        seen.append(docs)
    after = [{r.doc_id: r.text for r in d.collect()} for d in seen[:4]]
    assert after[0].keys() == texts.keys() - {42, 43, 44}
    assert after[1].keys() == after[0].keys() - {40, 41}
    assert after[2].keys() == after[1].keys()
    assert {i for i in after[2] if after[2][i] != after[1][i]} == {9} and len(after[2][9].split()) == len(texts[9].split()) - 71  # the passage and the tail behind it
    assert {i for i in after[3] if after[3][i] != after[2][i]} == {7} and after[3][7].endswith(" [SECRET]")
    rows = seen[4].collect()
    assert {r.doc_id for r in rows} == after[3].keys()
    assert all(sum(x.length for x in rows if x.doc_id == r.doc_id) == r.doc_tokens for r in rows)


def test_run(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() == 40
    frame(spark, {}).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_against_brute_force(spark, tmp_path):
    """Every stage's decisions, recomputed in plain Python from that stage's own input."""
    rnd = random.Random(11)
    texts = corpus()
    shared = [prose(rnd, rnd.randrange(52, 90)) for _ in range(3)]
    for i in range(100, 160):
        w = prose(rnd, rnd.randrange(5, 220))
        if rnd.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = rnd.choice(shared)
        texts[i] = " ".join(w)
    for i in range(160, 175):
        w = texts[rnd.randrange(100, 160)].split(" ")
        w[rnd.randrange(len(w))] = "edited"
        texts[i] = " ".join(w)
    docs = frame(spark, texts)
    seen = [texts]
    for _, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r.text for r in docs.collect()})

    good = set()
    for i, t in seen[0].items():
        n, chars, symbols, dups, repeats = measures(t)
        lines = sum(bool(blanks_split(x)) for x in (t or "").split("\n"))
        if n >= 10 and 100 * repeats <= 20 * n and 10 * symbols <= n and 10 * dups <= 3 * lines and 3 * n <= chars <= 10 * n:
            good.add(i)
    assert seen[1].keys() == good  # one host, whose rate stays low

    least = brute(seen[1], 5, 80)
    assert seen[2].keys() == {i for i, (_, c) in least.items() if c == i}

    learn_contents(spark, seen[2].values())
    repeats = runs_elsewhere(list(seen[2].items()))
    for i, t in seen[2].items():
        gone, _ = repeats[i, t]
        left = [w for w, g in zip(blanks_split(t), gone, strict=True) if not g]
        assert blanks_split(seen[3].get(i, "")) == left, i
    assert sum(any(gone) for gone, _ in repeats.values()) > 10

    from tessera.llm.secret_scan import masked, spans

    assert seen[4] == {i: masked(t, spans(t)) for i, t in seen[3].items()}


def test_large_sides_are_shuffled(spark, tmp_path, monkeypatch):
    """Beyond the broadcast bound the joins give the same rows."""
    from tessera.llm import shared

    df = frame(spark, corpus())
    want = corpus_pipeline.substring_dedup(spark, corpus_pipeline.minhash_near_dedup(spark, df, ""), "").collect()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    got = corpus_pipeline.substring_dedup(spark, corpus_pipeline.minhash_near_dedup(spark, df, ""), "")
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) > 30


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Texts that share an id are documents of their own: every unrelated row stays whole."""
    rnd = random.Random(13)
    text = lambda: " ".join(prose(rnd, 90))
    x, y, z, passage = text(), text(), text(), " ".join(prose(rnd, 60))
    rows = [(1, x), (2, x), (2, y), (3, f"{z} {passage}"), (4, f"{passage} {text()}"), (4, text()), (4, text())]
    df = spark.createDataFrame([(i, t, "host", "s", len(t), 0) for i, t in rows], "doc_id bigint, text string, host string, source string, n_chars bigint, content int")
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert docs.columns == df.columns, name
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert seen[0] == sorted(rows) and seen[1] == sorted(set(rows) - {(2, x)})
    assert seen[2] == sorted((i, t.removeprefix(passage) if i == 4 else t) for i, t in seen[1])


def test_nothing_is_left_behind(spark, tmp_path):
    """A run deletes all its tables but the result."""
    import os

    from tessera.llm.shared import shared_folder

    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{shared_folder(spark).removeprefix('file://')}/tessera"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0
