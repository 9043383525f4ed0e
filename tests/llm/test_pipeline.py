"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as pipeline
from sievework.llm import common


def test_stages(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "byte_bpe":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality_rules":
            hosts = {}
            norm = lambda x: (x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))).split()
            for r in before.values():
                for x in {" ".join(norm(x)) for x in (r.text or "").split("\n")} - {""}:
                    hosts[r.source, x] = hosts.get((r.source, x), 0) + 1
            want = {}
            for i, r in before.items():
                ws, left = (r.text or "").split(), [x for x in (r.text or "").split("\n") if hosts.get((r.source, " ".join(norm(x))), 0) < 20]
                runs = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
                twice = len({k + j for k, g in enumerate(runs) if runs.count(g) > 1 for j in range(3)}) if len(set(runs)) < len(runs) else 0
                n_left = len(" ".join(left).split())
                if len(ws) >= 50 and 2 * twice <= len(ws) and n_left >= 50 and 10 * n_left >= 3 * len(ws):
                    want[i] = "\n".join(left)
            assert {i: r.text for i, r in after.items()} == want
        if name == "line_dedup":
            assert set(after) == set(before)
            lines = [x.strip() for r in after.values() for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        if name == "near_dedup":
            sets = {}
            for i, r in before.items():
                w = r.text.lower().split()
                sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
            alike = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            for i in before:
                assert (i in after) or any(alike(i, j) for j in before if j != i)
            assert not any(alike(i, j) for i in after for j in after if i < j)
        if name == "decontamination":
            from sievework.llm import decontaminate as d

            items = [d.words(r.text.encode()) for r in common.table(spark, sf_dir, "benchmark").collect()]
            windows = [b" " + b" ".join(w) + b" " for x in items for w in d.windows(x, 10)]
            dirty = {i for i, r in before.items() if any(w in b" " + b" ".join(d.words(r.text.encode())) + b" " for w in windows)}
            assert set(before) - set(after) == dirty
        if name == "byte_bpe":
            assert set(after) == set(before) and all(r.round_trip and len(r.ids) == r.n_tokens for r in after.values())


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 100


def test_edges(spark, tmp_path):
    """Exact rows of each stage for nulls, empty and very long texts, repeated rows, clashing names and empty tables."""
    long = " ".join(f"u{i}" for i in range(40_000))
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, good, None, None, 5, "c"), (4, long, "en", "s", 1, "d"), (5, good + "\n\nx", "en", "s", 1, "e"), (5, good + "\n\nx", "en", "s", 1, "e"), (6, good + " q r s", "en", "s", 1, "f")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    spark.createDataFrame([(1, "q r s")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = lambda *places: [rows[i][:2] for i in places]
    want = {
        "quality_rules": at(2, 3, 4, 5, 6),
        "line_dedup": [*at(0, 1, 2, 3, 6), (5, "\nx"), (5, "\nx")],
        "near_dedup": at(0, 1, 3, 4),
        "decontamination": at(0, 1, 2, 3, 4, 5),
        "byte_bpe": None,
    }
    for name, stage in pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, shape), str(tmp_path))
        got = out.collect()
        if name == "byte_bpe":
            assert sorted((r.ids_given, r.round_trip, len(r.ids) == r.n_tokens, r.n_tokens > 0) for r in got) == sorted((r[5], True, True, bool(r[1])) for r in rows)
        else:
            assert out.columns == shape.replace(" long", "").replace(" string", "").split(", ")
            assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(want[name], key=str), name
            assert all(r.ids == {1: "a", 2: "b", None: "c", 4: "d", 5: "e", 6: "f"}[r.doc_id] for r in got)
        assert stage(spark, spark.createDataFrame([], shape), str(tmp_path)).count() == 0


def test_short_lines(spark):
    """Exact repeats of short lines go; blank lines and short lines that only look alike stay."""
    rows = [(1, "les.\n\nand ornd.\na"), (2, " les. \n\nles\nand ornd.\nb"), (3, "a\na line of sixteen bytes and more"), (4, "a line of sixteen bytes and moro\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "\nles\nb", 3: "a line of sixteen bytes and more", 4: ""}
