import corpus_pipeline


def test_stages(spark, tmp_path):
    word = lambda i: f"w{i}x"
    item = " ".join(f"bench{i}" for i in range(20))
    texts = {1: " ".join(map(word, range(60))), 2: " ".join(map(word, range(60))), 3: "12 34 !!", 4: "the plain text of a clean document mail me@here.org now", 5: "before " + item + " after", 6: None, 7: "an other clean text with nothing to hide in it"}
    rows = [(i, t, "en" if i != 7 else None, "s", len(t or ""), "kept") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, out, str(tmp_path)), "test")
        assert out.columns == docs.columns
        kept.append(sorted(r.doc_id for r in out.collect()))
    assert kept == [[1, 2, 4, 5, 7], [1, 4, 5, 7], [1, 4, 7], [1, 4, 7]]
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].text == "the plain text of a clean document mail <EMAIL> now" and by[4].n_chars == len(by[4].text) and by[7].lang == "en" and by[1].score == "kept"
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 4, 7]


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, equal rows, clashing column names, no rows: against a plain version of each stage but the last."""
    word = lambda i, n: " ".join(f"w{i}{chr(97 + j % 26)}{j}x" for j in range(n))
    item = " ".join(f"bench{i}" for i in range(20))
    data = [(1, word(1, 40)), (1, word(2, 40)), (None, word(3, 40)), (None, word(4, 40)), (7, word(2, 40)), (8, word(5, 40)), (8, word(5, 40)), (9, None), (10, ""), (11, "12 !!"), (12, f"xx {item} yy"), (13, f"{word(6, 900)} {item[:60]}"), (14, word(7, 30) + " a.b@c.org")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, _LANG_SCORE string, _h1 string, _k2 string, fp string, part string"
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", "s", len(t or ""), "p", "q", "r", "k", "f", "ab") for k, (i, t) in enumerate(data)], schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    lettered = [(i, t) for i, t in data if t and any(c.isalpha() for c in t)]
    one = stages[0](spark, docs, str(tmp_path))
    assert pairs(one) == sorted(lettered, key=str) and one.columns == docs.columns and all(r.lang == "en" and r._h1 == "r" and r["_LANG_SCORE"] == "q" for r in one.collect())
    least = {}
    for i, t in lettered:
        least[t] = min(least.get(t, i), i, key=lambda x: (x is None, x or 0))
    two = stages[1](spark, one, str(tmp_path))
    assert pairs(two) == sorted(((i, t) for t, i in least.items()), key=str) and two.columns == docs.columns
    three = stages[2](spark, two, str(tmp_path))
    assert pairs(three) == [p for p in pairs(two) if item not in p[1]] and pairs(stages[2](spark, two, f"{tmp_path}/none")) == pairs(two)
    four = stages[3](spark, three, str(tmp_path))
    assert pairs(four) == [(i, t.replace("a.b@c.org", "<EMAIL>")) for i, t in pairs(three)] and all(r.n_chars == len(r.text) for r in four.collect())
    assert stages[4](spark, four, str(tmp_path)).count() == four.count()
    for stage in stages:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
