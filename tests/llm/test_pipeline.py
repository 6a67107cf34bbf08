import random
from collections import defaultdict

import corpus_pipeline as C
from helixframe.llm.common import tokenizer_path
from helixframe.llm.packing import Encoder


def test_stages_do_their_work(spark, tmp_path):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    bench = [(i, say(25)) for i in range(5)]
    rows, labels, gone = [], [], {"quality": set(), "toxicity": set(), "near_duplicates": set(), "decontamination": set()}
    for i in range(400):
        text, good, toxic = say(rng.randrange(60, 200)), 1, 0
        if i % 7 == 1:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
            gone["quality"].add(i)
        elif i % 7 == 2:
            words = text.split()
            for k in range(6):
                words.insert(rng.randrange(len(words)), ["vile", "rotten", "scoundrel"][k % 3])
            text, toxic = " ".join(words), 1
            gone["toxicity"].add(i)
        elif i % 7 == 3 and i > 7:
            text = rows[i - 3][1]  # a copy of a clean text
            gone["near_duplicates"].add(i)
        elif i % 7 == 4:
            text += " " + bench[i % 5][1]
            gone["decontamination"].add(i)
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, good, toxic))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id for r in docs.collect()} == before - gone[name], name
    left = {r.doc_id for r in docs.collect()}
    pieces = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left
    coder, total, by = Encoder(tokenizer_path()), defaultdict(int), defaultdict(list)
    for r in pieces:
        total[r.doc_id] += r.length
        by[r.sequence_id].append((r.offset, r.length))
    assert all(total[i] == len(coder.plain([t])[0]) // 4 + 1 for i, t, *_ in rows if i in left)
    for own in by.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 2048
