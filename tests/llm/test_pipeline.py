import random
from collections import Counter

import corpus_pipeline as P
from fixwright.llm import sharding, simhash
from fixwright.sources.staging import written


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def tables(spark, folder):
    rng = random.Random(9)
    items = [(i, say(rng, 25)) for i in range(4)]
    rows = {i: say(rng, rng.randint(80, 200)) for i in range(120)}
    kinds = {}
    for i in range(120, 132):  # exact copies
        rows[i], kinds[i] = rows[i - 120], "copy"
    for i in range(132, 144):  # near copies
        w = rows[i - 132 + 20].split()
        w[5] = "changed"
        rows[i], kinds[i] = " ".join(w), "near"
    for i in range(144, 150):
        rows[i], kinds[i] = say(rng, 60) + " " + items[i % 4][1] + " " + say(rng, 30), "leak"
    for i in range(150, 170):
        rows[i], kinds[i] = " ".join(w + "&&&" for w in say(rng, 90).split()), "junk"
    rows[170], kinds[170] = "too short", "short"
    docs = [(i, t, "en", f"s{i % 3}" if i % 2 else "hot", len(t), "x") for i, t in rows.items()]
    docs += [docs[3], (None, None, None, None, None, None), (171, "", "en", None, 0, "x")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(kinds.get(i) != "junk"), 0) for i in rows if i != 170]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, kinds


def test_stages_keep_clean_texts_and_catch_the_rest(spark, tmp_path):
    rows, kinds = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = Counter(r.doc_id for r in docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    clean = set(range(120)) | {i for i, k in kinds.items() if k in ("copy", "near", "leak")}
    assert set(seen["quality rules"]) == clean and seen["quality rules"][3] == 2
    sets = {i: set(simhash.shingles(t, P.WORDS)) for i, t in rows.items()}
    alike = {i for i in clean for j in clean if j < i and len(sets[i] & sets[j]) >= P.SIMILARITY * len(sets[i] | sets[j])}
    assert {i for i, k in kinds.items() if k in ("copy", "near")} == alike
    assert seen["near duplicates"] == Counter(clean - alike)
    left = Counter(i for i in clean - alike if kinds.get(i) != "leak")
    assert seen["decontamination"] == seen["mixing"] == seen["sharding"] == left
    assert set(docs.columns) == {*columns, "part", "row", "shard"}
    out = docs.collect()
    assert len({(r.part, r.row) for r in out}) == len(out) and all(r.shard in sharding.SHARDS for r in out)
    order = [r.source for r in sorted(out, key=lambda r: (r.part, r.row))]
    assert len(set(order[:64])) > 2


def test_run_is_the_stages_in_turn(spark, tmp_path):
    rows, kinds = tables(spark, str(tmp_path))
    got = sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect())
    assert got == list(range(120)) and P.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
    assert docs.count() == 0
