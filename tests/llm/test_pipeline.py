"""The pipeline on a small corpus, against its stages done by brute force."""

import random

import corpus_pipeline
from test_dedup import line_brute, near_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline(spark, tmp_path):
    draw = random.Random(12)
    words = [f"p{k}" for k in range(2000)]

    def text(n, mark=""):
        return "\n".join(" ".join(draw.choice(words) + mark for _ in range(9)) for _ in range(n))

    clean = [text(draw.randrange(4, 12)) for _ in range(150)]
    items = [text(4) for _ in range(5)]
    shared = text(9)
    docs = [(k, t) for k, t in enumerate(clean)]
    docs += [(1000 + k, text(6, "%%%")) for k in range(60)]  # junk
    docs += [(2000 + k, text(3) + "\n" + items[k] + "\n" + text(3)) for k in range(5)]  # leaks
    docs += [(3000 + k, text(2) + "\n" + shared + "\n" + text(2)) for k in range(6)]
    docs += [(4000 + k, clean[k].replace("\n", " ") + " more") for k in range(10)]  # near copies
    docs += [(4500 + k, clean[k].replace("\n", "  ")) for k in range(5)]
    docs += [(5000, None), (5001, ""), (5002, "one")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    labels = [(i, int(not 1000 <= i < 1060), 0) for i, _ in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    left = [(i, t) for i, t in docs if not 1000 <= i < 1060]
    cut = line_brute(left)
    left = [(i, cut[i][0]) for i, _ in left if not (cut[i][2] and not cut[i][0].strip())]
    roots = near_brute(left, 5, 80)
    left = [(i, t) for i, t in left if roots[i][1] == i]
    held = [" ".join(x.split()) for x in items]
    left = [(i, t) for i, t in left if not any(h in " ".join((t or "").split()) for h in held)]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == sorted(left)
    assert all(r.n_chars == len(r.text or "") for r in frame.collect())
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {i: len((t or "").split()) for i, t in left}
    assert {r.doc_id for r in mixed} <= set(sizes)
    assert all(r.size == sizes[r.doc_id] and 0 < r.taken <= 2 * r.size for r in mixed)
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(sizes.values())) < 16 * 6
