import random

from brute import documents

from wayfold.llm.decontaminate import Pattern, decontaminated, leaks, normal


def distance(item, text):
    """The least edit distance of the item to a substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(2)
    for _ in range(200):
        item = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 70)))
        text = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 90)))
        assert Pattern(item).best(text)[0] == distance(item, text)


def test_as_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 25)))) for i in range(12)] + [(12, None), (13, ""), (14, "short")]
    rows = [(0, None), (1, ""), (None, items[0][1])]
    for d in range(2, 60):
        text = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if d % 2:
            piece = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.choice([0, 1, 3, 9])):
                piece[rnd.randrange(len(piece))] = rnd.choice(["", "x", "zz"])
            text = f"{text}\n {''.join(piece).upper() if d % 3 else ''.join(piece)} {text}"
        rows.append((d, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in leaks(documents(spark, rows), bench, block_chars=700).collect()), key=str)
    expected = []
    for d, t in rows:
        for i, x in items:
            if normal(x) and (n := distance(normal(x), normal(t))) <= int(0.05 * len(normal(x))):
                expected.append((d, i, n))
    assert got == sorted(expected, key=str) and len(got) > 15
    kept = {r["doc_id"] for r in decontaminated(documents(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in expected}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(documents(spark, [(1, "a")]), none).collect() == []
    assert leaks(documents(spark, []), none).collect() == []
    assert decontaminated(documents(spark, [(1, "a")]), none).count() == 1


def test_places_and_blocks(spark):
    """start and end delimit a piece of the least distance, whatever the number of blocks."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(8)]
    rows = [(d, " ".join([word() for _ in range(d)] + [items[d % 8][1].replace("a", "x", d % 4)] + [word() for _ in range(5)])) for d in range(24)]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, leaks(docs, bench, block_chars=n).collect())) for n in (10**6, 150))
    assert one == many and len(one) >= 20
    text, known = dict(rows), dict(items)
    for d, i, n, start, end in one:
        piece = normal(text[d])[start:end]
        assert n == distance(normal(known[i]), normal(text[d])) == distance(normal(known[i]), piece)
    few = sorted(r["doc_id"] for r in decontaminated(docs, bench, block_chars=150).collect())
    assert few == sorted(set(dict(rows)) - {x[0] for x in one})
    extra = docs.withColumn("item_id", docs["doc_id"]).withColumnRenamed("lang", "distance")
    assert decontaminated(extra, bench).columns == extra.columns


def test_one_scan_of_the_documents(spark):
    """A benchmark over the bound is joined: the documents are read once; repeated rows and items, null ids and clashing names as in a small one."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(15))) for i in range(40)]
    items += [(90, items[0][1]), (None, items[1][1].upper()), (91, "zq"), (92, " "), (93, None)]
    rows = [(d, f"{word()} {items[d % 40][1]}\n\n{word()} {items[d % 7][1]} \U0001d400") for d in range(30)] + [(d, word()) for d in range(30, 40)]
    rows += [rows[0], (None, rows[1][1]), (77, rows[0][1]), (50, "a zq z"), (51, None), (52, "")]
    docs = documents(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "hash")
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    many = sorted(map(tuple, leaks(docs.mapInArrow(counted, docs.schema), bench, block_chars=200).collect()), key=str)
    assert read.value == len(rows)
    assert many == sorted(map(tuple, leaks(docs, bench).collect()), key=str) and len(many) > 60
    kept = decontaminated(docs, bench, block_chars=200)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, decontaminated(docs, bench).collect()))
