import random

import public_tokenizers
from brute import documents, similar
from pyspark.sql import functions as F
from test_linededup import brute as lines_of
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "in", "ou", "re"]) for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    shared, rows, labels = [" ".join(word() for _ in range(8)) for _ in range(4)], [], []
    for d in range(150):
        bad = d % 5 == 1
        text = [" ".join(w.upper() + "!!" if bad else w for w in (word() for _ in range(30))) for _ in range(2)]
        if d % 6 == 0:
            text += shared[:3]
        if d % 7 == 2:
            text.append("so " + items[d % 3][1] + " it goes")
        rows.append((d, "\n".join(text)))
        labels.append((d, int(not bad), 0))
    for d in range(150, 170):
        words = rows[d - 150][1].replace("\n", " ").split(" ")
        words[3] = "changed"
        rows.append((d, " ".join(words)))
    rows += [(170, None), (171, "")]
    where = f"file://{tmp_path}"
    documents(spark, rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{where}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(f"{where}/{name}.parquet")
        docs = spark.read.parquet(f"{where}/{name}.parquet")
        seen.append(docs)
    first, second, third, fourth, last = seen
    text = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for df in seen[:4]:
        assert df.columns == corpus_pipeline.COLUMNS
    kept = {d for d, _ in text(first)}
    assert all((d in kept) == (q == 1) for d, q, _ in labels)
    was = dict(text(first))
    assert text(second) == [(d, t) for d, t in lines_of(text(first), 2) if t or not was[d]]
    component = {d: c for d, _, c in similar(text(second), 5, 80, 100)}
    assert text(third) == [(d, t) for d, t in text(second) if component[d] == d]
    assert len(text(third)) < len(text(second)) < len(text(first)) + 1
    leaked = lambda t: any(x in (t or "").lower().replace("\n", " ") for _, x in items)
    assert text(fourth) == [(d, t) for d, t in text(third) if not leaked(t)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in text(fourth))
    assert sum(r["length"] for r in last.collect()) == total
    whole = sorted(map(tuple, corpus_pipeline.run(spark, where).drop("sequence_id", "offset").collect()))
    assert whole == sorted(map(tuple, last.drop("sequence_id", "offset").collect()))


def test_rows_are_told_apart(spark):
    """Repeated ids, equal rows, null ids and texts, and extra columns with the names that stages use inside."""
    words = [f"w{i}" for i in range(40)]
    near, other = " ".join(words), " ".join(reversed(words))
    copy = " ".join([*words[:-1], "changed"])
    rows = [(1, near), (2, copy), (2, other), (3, near), (3, near), (4, "lone text of its own"), (4, "lone text of its own"), (None, near), (None, near), (5, None), (5, None), (6, ""), (7, other)]
    docs = documents(spark, rows)
    for i, name in enumerate(["_doc", "_cut", "_tie", "n_removed", "n_lines", "text_hash", "score", "component", "cls", "h", "n"]):
        docs = docs.withColumn(name, F.lit(i))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, near), (2, other), (4, "lone text of its own"), (None, near), (None, near), (5, None), (5, None), (6, "")], key=str)
    by_line = corpus_pipeline.lines(spark, docs, "")
    assert by_line.columns == docs.columns and by_line.count() == len(rows)
    assert all(r["n_removed"] == 3 and r["_cut"] == 1 for r in by_line.collect())
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").collect() == []
    assert corpus_pipeline.lines(spark, docs.where("false"), "").collect() == []


def test_empty_tables(spark, tmp_path):
    where = f"file://{tmp_path}"
    documents(spark, []).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, where).collect() == []
